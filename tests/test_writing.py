"""Marks in texts, profiles and versions on small made texts."""

import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.functions import markup
from pairloom.operators import writing
from pairloom.plans import writing as plans

LONG = "word " * 30_000
TEXTS = [(1, "It was painted. We saw [1, 2] it! (Smith, 2020) was right."), (2, None), (3, ""), (4, "   \n "), (5, LONG), (5, LONG)]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "id long, text string")


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def test_citations_keep_their_surroundings(spark):
    found = one(spark, TEXTS[0][1], markup.cited("text"))
    assert [(c["sentence"], c["key"]) for c in found] == [(1, "1, 2"), (2, "Smith, 2020")]
    assert found[0]["context"] == TEXTS[0][1]
    assert one(spark, None, markup.cited("text")) == []


def test_rhetoric(spark):
    for text, name in ((" Introduction: ", "INTRODUCTION"), ("However, in conclusion we stop", "CONCLUSION"), ("thusly", "CLAIM"), (None, "CLAIM"), ("Critics argue", "REBUTTAL")):
        assert one(spark, text, markup.rhetorical_class("text")) == name


def test_macros(spark):
    source = r"\documentclass[a4paper]{article}\usepackage{amsmath,tikz}\newcommand{\foo}{x}\begin{figure*}"
    assert one(spark, source, markup.macros("text")) == ["macro:foo", "env:figure*", "class:article", "pkg:amsmath", "pkg:tikz"]


def test_hidden_mark(spark):
    digits = "00ff" * 7 + "1234"
    bits = "".join(f"{int(c, 16):04b}" for c in digits)
    hidden = bits.replace("0", markup.ZERO).replace("1", markup.ONE)
    assert one(spark, f"a{markup.BEGIN}{hidden}{markup.END}b", markup.hidden_mark("text")) == digits
    assert one(spark, f"a{hidden[:64]}b{hidden[64:]}", markup.hidden_mark("text")) == digits
    assert one(spark, f"{markup.BEGIN}{markup.ONE}{markup.END}", markup.hidden_mark("text")) == "0" * 31 + "1"
    assert one(spark, f"a{hidden[:9]}", markup.hidden_mark("text")) is None
    assert one(spark, None, markup.hidden_mark("text")) is None


def test_tags(spark):
    assert one(spark, "#hw1, FINAL,   #draft 123 #a#b final", markup.tags("text")) == ["#ab", "#draft", "#final", "#hw1"]
    assert one(spark, None, markup.tags("text")) == []


def test_normal_forms(spark):
    text = "ﬁne é Å ½"
    for form in ("NFC", "NFKC", "NFD", "NFKD"):
        assert one(spark, text, markup.normal_form("text", form)) == unicodedata.normalize(form, text)


def test_paraphrase_print(spark):
    rows = {r["id"]: r for r in writing.paraphrase_prints(frame(spark), "id", "text").collect()}
    assert rows[1]["transition_anomaly"] == 1.0 and rows[1]["tool"] == "quillbot"
    assert all(rows[i]["synonym_entropy"] == 0 and rows[i]["sentence_length_variance"] == 0 for i in (2, 3, 4, 5))


def test_profiles_of_blank_and_long_texts(spark):
    rows = writing.profiles(frame(spark), "id", "text").collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        if r["id"] in (2, 3, 4):
            assert all(r[c] == 0 for c in writing.WEIGHTS)
    assert writing.profiles(frame(spark, []), "id", "text").count() == 0


def test_drift_and_segments(spark):
    df = spark.createDataFrame([("A b c. D e.", "a b c. d e."), (None, ""), ("One. Two. One.", "zero one two")], "a string, b string")
    d = writing.drift("a", "b")
    rows = df.select(*[c.alias(k) for k, c in d.items()], writing.shared_segments("a", "b").alias("s")).collect()
    assert rows[0]["lexical_drift"] == 0 and rows[0]["structural_variance"] == 0
    assert rows[1]["lexical_drift"] == 0 and rows[1]["s"] == []
    assert rows[2]["s"] == ["One", "Two"]


def test_paragraph_matches(spark):
    df = spark.createDataFrame([("a b c d e\n\nx\n\nf g h i j", "f g h i j\n \na b c d q"), (None, "a b c d e"), ("a b c d e", None)], "a string, b string")
    rows = df.select(writing.paragraph_matches("a", "b").alias("m")).collect()
    assert [(m["at"], m["best"], round(m["score"], 3)) for m in rows[0]["m"]] == [(0, 1, 0.667), (1, 0, 1.0)]
    assert rows[1]["m"] == [] and rows[2]["m"][0]["score"] == 0


def test_two_text_tf_idf(spark):
    docs = frame(spark, [(1, "a b"), (2, "b a"), (3, None)])
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "doc_a long, doc_b long")
    found = {(r["doc_a"], r["doc_b"]): round(r["sim"], 9) for r in writing.two_text_tf_idf(pairs, docs, "id", "text").collect()}
    assert found == {(1, 2): 1.0, (1, 3): 0.0}


def test_rubric(spark):
    rows = spark.createDataFrame([(1, 0.5, None)], "id long, m double, n double")
    made = writing.rubric(rows, "id", ["m", "n"], [("m", 0.4, 30), ("n", 1.0, 10), ("gone", 0.0, 99)]).first()
    assert (made["points"], made["percent"]) == (30, 75.0)


def test_row_tf_idf_equals_the_joins_and_shuffles_nothing(spark, monkeypatch):
    monkeypatch.setattr(writing, "TAKEN", 8)
    texts = ["a b b c", "b a c c c d", "", None, "x y z " * 40, "z z y q", "a a a"]
    docs = frame(spark, list(enumerate(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j]
    asked = spark.createDataFrame(pairs, "doc_a long, doc_b long")
    want = {(r["doc_a"], r["doc_b"]): r["sim"] for r in writing.two_text_tf_idf(asked, docs, "id", "text").collect()}
    rows = spark.createDataFrame([(i, j, (texts[i] or "").split(), (texts[j] or "").split()) for i, j in pairs], "i long, j long, a array<string>, b array<string>")
    made = rows.select("i", "j", writing.row_tf_idf(writing.word_hashes("a"), writing.word_hashes("b")).alias("sim"))
    assert {(r["i"], r["j"]): pytest.approx(r["sim"]) for r in made.collect()} == want
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [plans.text_nfc, plans.text_nfkc])
def test_normal_forms_come_in_small_batches(spark, tmp_path, query):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.range(0, 1500, 1, 1).selectExpr("id AS doc_id", "repeat('é long ', 3000) AS text")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert query(spark, str(tmp_path)).count() == 1500 and int(spark.conf.get(key).rstrip("b")) <= 4 << 20

    @F.pandas_udf("long")
    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.map(len).sum())] * len(texts))

    assert docs.select(batch("text").alias("n")).agg(F.max("n")).first()[0] < 5 << 20
