"""Operators on records: empty tables, nulls, ties."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pairloom.operators import records

DAY = datetime(2024, 1, 31)


def test_within_class(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (None, 2, 0.7)], "doc_a long, doc_b long, sim double")
    members = spark.createDataFrame([(1,), (2,), (2,), (None,)], "doc_id long")
    assert [tuple(r) for r in records.within_class(pairs, members).collect()] == [(1, 2, 0.9)]


def test_emerging(spark):
    rows = [("a", "b", 0.9, DAY), ("a", "b", 0.7, DAY - timedelta(9)), ("a", "b", 0.7, DAY - timedelta(10)), ("a", "c", 0.9, DAY), ("a", "c", 0.9, None)]
    made = spark.createDataFrame(rows, "doc_a string, doc_b string, score double, flagged_at timestamp")
    assert [tuple(r) for r in records.emerging(made, 10).collect()] == [("a", "b", 2, 0.9)]
    assert records.emerging(made.limit(0), 10).count() == 0


def test_entropies_and_pauses(spark):
    rows = [(1, "x", DAY), (1, "y", DAY + timedelta(seconds=10)), (1, None, DAY + timedelta(seconds=4000)), (2, "x", DAY), (2, "x", DAY)]
    made = spark.createDataFrame(rows, "k int, v string, at timestamp")
    assert {tuple(r) for r in records.entropies(made, "k", "v", "e").collect()} == {(1, 1.585), (2, 0.0)}
    found = {r["k"]: r for r in records.pauses(made, "k", "at", 60).collect()}
    assert (found[1]["pauses"], found[1]["longest_pause"]) == (1, 3990.0)
    assert (found[2]["pauses"], found[2]["mean_pause"], found[2]["burstiness"]) == (0, 0.0, 0.0)


def test_outliers(spark):
    rows = spark.createDataFrame([(i, 1.0) for i in range(99)] + [(99, 50.0), (100, None)], "i int, v double")
    assert [r["i"] for r in records.outliers(rows, "v", 3).collect()] == [99]
    assert records.outliers(rows.where("i < 99"), "v", 0).count() == 0


def test_dedup_statistics(spark):
    docs = spark.createDataFrame([(i,) for i in range(4)], "doc_id long")
    pairs = spark.createDataFrame([(0, 1, 0.9), (2, 3, 0.5)], "doc_a long, doc_b long, sim double")
    r = records.dedup_statistics(pairs, docs).first()
    assert (r["documents"], r["pairs"], r["high"], r["low"], r["most_duplicated"], r["most_pairs"], r["rate"]) == (4, 2, 1, 1, 0, 1, 0.5)
    r = records.dedup_statistics(pairs.limit(0), docs.limit(0)).first()
    assert (r["documents"], r["pairs"], r["most_duplicated"], r["most_pairs"]) == (0, 0, None, 0)


def test_score_shape(spark):
    rows = [("wide", v) for v in (0.1, 0.9, 0.1, 0.9)] + [("one", 0.5)] + [("tight", v) for v in (0.5, 0.5, 0.5, 0.5, 0.6)] + [("none", None)]
    found = {r["k"]: (r["kind"], r["shift"]) for r in records.score_shape(spark.createDataFrame(rows, "k string, s double"), "k", "s").collect()}
    assert found == {"wide": ("heterogeneous", 0.03), "one": ("unknown", 0.0), "tight": ("homogeneous", -0.03), "none": ("unknown", 0.0)}


def test_gate(spark):
    rows = spark.createDataFrame([(95.0, ""), (59.0, "length"), (60.0, "length")], "s double, c string")
    made = rows.select(*[c.alias(k) for k, c in records.quality_gate(F.col("s"), F.col("c")).items()]).collect()
    assert [tuple(r) for r in made] == [("A", True, ""), ("F", False, "score; grade; critical: length"), ("D", True, "critical: length")]


def test_edit_velocity(spark):
    rows = spark.createDataFrame([(4.0, 20), (None, 3), (5.0, 0), (40.0, 20)], "m double, p int")
    made = rows.select(*[c.alias(k) for k, c in records.edit_velocity(F.col("m"), F.col("p")).items()]).collect()
    assert [tuple(r) for r in made] == [(0.2, True, 0.1), (None, False, 1.0), (None, False, 1.0), (2.0, False, 1.0)]


def test_index(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0])], "id long, v array<double>")
    gone = spark.createDataFrame([(2,), (3,), (4,), (4,), (None,)], "id long")
    left = records.without_documents(rows, "id", gone)
    assert tuple(records.index_check(left, "v").first()) == (1, 2, 2, 0, True)
    assert records.index_check(rows, "v").first()["bad"] == 2 and not records.index_check(rows, "v").first()["valid"]
    assert records.index_check(rows.limit(0), "v").first()["valid"] is False


def test_envelope(spark):
    rows = spark.createDataFrame([(1, "x", '{"b": 2, "a": 1}', DAY), (2, None, "{broken", None), (3, "x", None, DAY), (4, "x", "[1]", DAY)], "id long, kind string, props string, at timestamp")
    body, valid = records.envelope(F.col("kind"), F.col("props"), F.col("id"), F.col("at"))
    made = rows.select(body.alias("b"), valid.alias("v")).collect()
    assert [r["v"] for r in made] == [True, False, False, False]
    assert made[0]["b"].startswith('{"event_id":"1","event_type":"x","occurred_at":"2024-01-31')


def test_retained_and_iso(spark):
    rows = spark.createDataFrame([(DAY,), (DAY - timedelta(10),), (DAY - timedelta(11),), (None,)], "at timestamp")
    assert [r["kept"] for r in records.retained(rows, "at", 10).collect()] == [True, True, False, True]
    texts = spark.createDataFrame([("2024-02-30",), ("2024-02-29T10:00:00Z",), ("5",), (None,)], "t string")
    assert [r["x"] is None for r in texts.select(records.iso_timestamp(F.col("t")).alias("x")).collect()] == [True, False, True, True]


def test_cognitive_load(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 9.0)], "k string, g double, c double")
    found = {r["k"]: (r["synthetic"], r["probability"]) for r in records.cognitive_load(rows, "k", "g", "c").collect()}
    assert found == {"a": (True, 1.0), "b": (False, 0.0)}
