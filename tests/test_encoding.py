"""Garbled text and its repair; ensemble scores of simple pairs."""

import pytest

from pairloom.functions import encoding
from pairloom.functions.text import words
from pairloom.operators.ensemble import ensemble


def garble(text):
    return "".join(encoding._char(b) for b in text.encode())


@pytest.mark.parametrize("text", ["café", "“Hello” — naïve façade…", "Âme et Ângela", "plain", "", "日本", "é"])
def test_mend(text):
    assert encoding.mend(text) == text
    assert encoding.mend(garble(text)) == text
    if "”" not in text:  # its last byte has no character, so a second garbling shows a control character
        assert encoding.mend(garble(garble(text))) == text


def test_mend_keeps_what_is_broken():
    assert encoding.mend("Ã© and ÃZ and â€") == "é and ÃZ and â€"


def test_garbled_share(spark):
    rows = spark.createDataFrame([(1, "ab" + garble("é")), (2, ""), (3, None), (4, "é")], "i int, t string")
    got = {r.i: (r.s, r.m) for r in rows.select("i", encoding.garbled_share("t").alias("s"), encoding.mended("t").alias("m")).collect()}
    assert got == {1: (0.5, "abé"), 2: (0.0, ""), 3: (0.0, ""), 4: (0.0, "é")}


def test_ensemble_of_equal_unlike_and_empty(spark):
    texts = {1: "one two three four five six. Seven!\n\nEight nine.", 2: "one two three four five six. Seven!\n\nEight nine.", 3: "z", 4: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").select("*", words("text").alias("w"))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 4)], "doc_a long, doc_b long")
    got = {(r.doc_a, r.doc_b): r for r in ensemble(pairs, docs, "doc_id", "text", "w").collect()}
    assert got[1, 2].score == 1 and got[1, 2].level == "critical"
    assert got[1, 3].semantic == got[1, 3].lexical == got[1, 3].fingerprint == 0 and got[1, 3].level == "clean"
    assert got[3, 4].semantic == 0 and got[3, 4].score < 0.3
