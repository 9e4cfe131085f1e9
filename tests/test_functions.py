"""Text and similarity columns on hand-made values."""

import math

import pytest
from pyspark.sql import functions as F

from pairloom.functions import similarity, style, text


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<double>' if isinstance(v, list) else 'string'}" for n, v in values.items())).select(column.alias("x")).first()[0] if names else None


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("", "x", 0.0), ("the of", "and to", 1.0), ("the", "apple", 0.0), ("red apple", "green apple", 1 / 3), (None, "x", 0.0)],
)
def test_jaccard_of_empty_and_stop_words(spark, a, b, want):
    assert one(spark, similarity.jaccard("a", "b"), a=a, b=b) == pytest.approx(want)


def test_set_metrics(spark):
    assert one(spark, similarity.dice("a", "b"), a="", b="") == 1.0
    assert one(spark, similarity.overlap("a", "b"), a="", b="") == 0.0
    assert one(spark, similarity.ngram_overlap("a", "b", 2), a="x y z", b="x y w") == pytest.approx(1 / 3)
    assert one(spark, similarity.char_ngram_similarity("a", "b", 5), a="abcd", b="abcde") == 0.0
    assert one(spark, similarity.levenshtein_similarity("a", "b"), a="", b="") == 1.0
    with pytest.raises(ValueError, match="n must be"):
        similarity.ngram_overlap("a", "b", 11)


def test_vectors(spark):
    assert one(spark, similarity.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[-1.0, 0.0]) == 0.0
    assert one(spark, similarity.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) == 0.0
    assert one(spark, similarity.euclidean(F.col("a"), F.col("b")), a=[0.0, 3.0], b=[4.0, 0.0]) == 5.0
    assert one(spark, similarity.js_divergence(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 1.0]) == pytest.approx(1.0)


def test_text_of_null(spark):
    assert one(spark, text.count_words("a"), a=None) == 0
    assert one(spark, F.size(text.sentences("a")), a="One. Two!\nThree") == 3
    assert one(spark, text.clean("a"), a="  “x” — y​  ") == '"x" - y'
    assert one(spark, text.strip_bibliography("a"), a="body\nReferences\n[1] x") == "body"
    assert one(spark, text.strip_markdown("a"), a="# T\n**b** [l](u)") == "T\nb l"
    assert one(spark, text.html_text("a"), a="<p>a&amp;b</p><script>x</script><nav>n</nav>") == "a&b"
    assert one(spark, F.size(text.ngrams(text.words("a"), 3)), a="a b") == 0


def test_style(spark):
    assert one(spark, style.burstiness("a"), a="one two. three four.") == 0.0
    assert one(spark, style.repetitiveness("a", 2), a="a b a b") == pytest.approx(1 / 3)
    assert one(spark, style.shannon_entropy(F.split("a", " ")), a="x y x y") == pytest.approx(1.0)
    assert one(spark, style.watermark_z(F.lit(75), F.lit(100)), a="") == pytest.approx(5.0)
    low, high = style.wilson(F.lit(50), F.lit(100))
    assert math.isclose(one(spark, low, a="") + one(spark, high, a=""), 1.0)


def test_tokens_and_scripts_are_made_once(spark, tmp_path):
    """Each text is split once for all scores; before, pair_metrics split texts 28 times and pair_severity 8 times."""
    from pairloom.plans import similarity as plans
    from pairloom.plans import writing

    rows = [(0, "the cat sat on a mat", "en"), (1, "a cat sat on the red mat", "en"), (2, "", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))

    def times(query, name):
        return query(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count(name + "(")

    assert times(plans.pair_metrics, "regexp_extract_all") == times(plans.pair_severity, "regexp_extract_all") == 2
    assert times(writing.pair_cross_script, "regexp_extract_all") == 12  # five scripts of two texts are counted by it too
    found = {r.doc_a: (r.jaccard, r.dice, r.overlap, r.ngram) for r in plans.pair_metrics(spark, str(tmp_path)).collect()}
    assert found == {0: (0.75, 0.857143, 1.0, 0.125), 1: (0.0, 0.0, 0.0, 0.0)}
