"""Pairs with a known label, made from documents, and how well scores of pairs tell them apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.similarity import set_jaccard
from pairloom.functions.text import ngrams, words
from pairloom.operators import scoring
from pairloom.operators.writing import row_tf_idf, word_hashes

#: Edits that take turns by key: none, halves swapped, every fourth word left out, every third word changed.
KINDS = ("copied", "moved", "thinned", "replaced")
METHODS = ("jaccard", "trigrams", "tf_idf")
#: Thresholds of the evaluation.
GRID = [round(0.30 + 0.01 * i, 2) for i in range(66)]


def _edited(w: Column, kind: Column) -> Column:
    half = (F.size(w) / 2).cast("int")
    moved = F.concat(F.slice(w, half + 1, F.size(w)), F.slice(w, F.lit(1), half))
    thinned = F.filter(w, lambda _, i: i % 4 != 3)
    replaced = F.transform(w, lambda x, i: F.when(i % 3 == 2, F.concat(x, F.lit("x"))).otherwise(x))
    return F.when(kind == "moved", moved).when(kind == "thinned", thinned).when(kind == "replaced", replaced).otherwise(w)


def labelled_pairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind, label, words_a, words_b``: each document beside an edited form of itself (label 1) and beside that of the following key (label 0).

    ``key`` is a whole number; null keys are left out, null texts have no words.
    """
    own = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text_a"))
    kind = F.get(F.array(*map(F.lit, KINDS)), F.pmod(F.col(key), F.lit(len(KINDS))).cast("int"))
    same = own.select(key, kind.alias("kind"), F.lit(1).alias("label"), words("text_a").alias("words_a")).withColumn("words_b", _edited(F.col("words_a"), F.col("kind")))
    # texts are joined and then split, as lists of words are more than twice as large
    following = own.select((F.col(key) - 1).alias(key), F.col("text_a").alias("text_b"))
    both = own.join(following, key).select(key, F.lit("unrelated").alias("kind"), F.lit(0).alias("label"), words("text_a").alias("words_a"), words("text_b").alias("words_b"))
    return same.unionByName(both)


def scored_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """``key, kind, label`` and the score of each of ``METHODS``; two texts without words score 0."""
    sets = lambda of: set_jaccard(F.array_distinct(of("words_a")), F.array_distinct(of("words_b")), 0.0)
    cosine = row_tf_idf(word_hashes("words_a"), word_hashes("words_b"))
    return pairs.select(key, "kind", "label", sets(F.col).alias("jaccard"), sets(lambda c: ngrams(F.col(c), 3)).alias("trigrams"), cosine.alias("tf_idf"))


def evaluate(scored: DataFrame, methods: tuple[str, ...] = METHODS, grid: list[float] = GRID) -> tuple[DataFrame, DataFrame, DataFrame]:
    """By method: the area under the ROC curve, confusion and rates at each threshold (precision 1 where nothing is found), and the best F1."""
    named = lambda rows, m: rows.select(F.lit(m).alias("method"), "*")
    areas = sweeps = bests = None
    for m in methods:
        sweep = named(scoring.threshold_sweep(scored, m, "label", grid, 1.0), m)
        area, best = named(scoring.roc_auc(scored, m, "label"), m), named(scoring.best_threshold(sweep), m)
        areas, sweeps, bests = (area, sweep, best) if areas is None else (areas.unionByName(area), sweeps.unionByName(sweep), bests.unionByName(best))
    return areas, sweeps, bests
