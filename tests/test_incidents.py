"""Incidents: identity, visibility, upserts, pages."""

from datetime import datetime

from pairloom.operators import incidents as op

T = datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_a string, doc_b string, score double, severity string, status string, flagged_at timestamp")


def test_pair_identity_ignores_order(spark):
    rows = frame(spark, [("b", "a", 0.9, "High", "Pending", T), ("a", "b", 0.7, "Low", "Pending", T), ("a", "a", 1.0, "High", "Pending", T)])
    found = op.best_of_pair(rows).collect()
    assert [(r.doc_a, r.doc_b, r.score, r.times_flagged) for r in found] == [("a", "b", 0.9, 2)]
    assert found[0].incident_id.startswith("INC-") and len(found[0].incident_id) == 16


def test_visible_hides_deleted_but_not_missing_documents(spark):
    rows = frame(spark, [("a", "b", 0.9, "High", "Pending", T), ("a", "gone", 0.9, "High", "Pending", T), ("x", "y", 0.9, "High", "Pending", T)])
    docs = spark.createDataFrame([("a", False), ("gone", True)], "filename string, is_deleted boolean")
    assert sorted((r.doc_a, r.doc_b) for r in op.visible(rows, docs).collect()) == [("a", "b"), ("x", "y")]


def test_upsert_keeps_review_and_counts(spark):
    old = op.best_of_pair(frame(spark, [("a", "b", 0.6, "Low", "Pending", T)])).selectExpr("*", "'Confirmed' AS status", "0.59D AS threshold")
    new = op.canonical(frame(spark, [("b", "a", 0.95, "High", "Pending", T), ("c", "d", 0.8, "Medium", "Pending", T)])).selectExpr("*", "0.75D AS threshold")
    got = {r.doc_a: r for r in op.upsert(old, new, datetime(2025, 1, 1)).collect()}
    assert (got["a"].status, got["a"].times_flagged, got["a"].score, got["a"].threshold, got["a"].severity) == ("Confirmed", 2, 0.95, 0.59, "High")
    assert (got["c"].status, got["c"].times_flagged, got["c"].threshold) == ("Pending", 1, 0.75)


def test_empty_tables(spark):
    none = frame(spark, [])
    docs = spark.createDataFrame([], "filename string, is_deleted boolean")
    assert op.visible(none, docs).count() == 0
    assert op.repeat_rate(none).first()[0] == 0.0
    assert {r.incident_count for r in op.threshold_sensitivity(none).collect()} == {0}


def test_watchlist_document_or_pair(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9)], "doc_a string, doc_b string, score double")
    watch = spark.createDataFrame([("e1", "document", "c", None, 0.5), ("e2", "pair", "b", "a", 0.5), ("e3", "pair", "a", "c", 0.5)], "entry_id string, kind string, target string, other string, min_score double")
    assert sorted((r.entry_id, r.doc_a) for r in op.watched(pairs, watch).collect()) == [("e1", "b"), ("e2", "a")]
