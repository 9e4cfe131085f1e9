"""What stays on disk, and what is done inside tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions.text import words
from pairloom.operators import blend, communities, ensemble, passages
from pairloom.operators.search import highest
from pairloom.operators.setjoin import containment_join
from pairloom.runtime import CLEANED, cut


def shuffled_bytes(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))


def test_cut_keeps_no_shuffle_files(spark):
    before = shuffled_bytes(spark)
    made = cut(spark.range(200_000).groupBy(F.xxhash64("id").alias("h")).count())
    assert shuffled_bytes(spark) - before < 10_000
    assert made.count() == 200_000 and spark.conf.get(CLEANED, "false") == "false"


def test_containment_shuffles_no_tokens(spark):
    rng = random.Random(2)
    rows = [(i, ["all", *(f"w{rng.randrange(400)}" for _ in range(40))]) for i in range(1500)] + [(None, ["all", "x"]), (3, ["all", "y", "z"]), (3, ["y", "all"])]
    before = shuffled_bytes(spark)
    got = containment_join(spark.createDataFrame(rows, "id long, w array<string>"), "id", "w", 0.9)
    found = sorted((r.doc_a, r.doc_b, r.overlap) for r in got.collect())
    assert (3, 3, 1.0) in found
    assert shuffled_bytes(spark) - before < 200_000


def test_passages_shuffle_no_windows(spark):
    words = [f"w{i}" for i in range(2000)]
    docs = spark.createDataFrame([(i, words[i:] + words[:i]) for i in range(30)], "id long, w array<string>")
    pairs = spark.createDataFrame([(i, j) for i in range(30) for j in range(i + 1, 30)], "doc_a long, doc_b long")
    before = shuffled_bytes(spark)
    found = {tuple(r) for r in passages.shared_passages(pairs, docs, "id", "w", 8).where("doc_b = doc_a + 1").collect()}
    assert found == {x for i in range(29) for x in ((i, i + 1, 1, 2000, 0, 1999, 1999),)}
    assert passages.highlighted(pairs, docs, "id", "w", 4).count() == 870
    assert shuffled_bytes(spark) - before < 3_000_000


def test_passages_of_repeated_keys_are_those_of_joins(spark):
    rows = [(1, list("abcdefghij")), (1, list("abcdefghij")), (2, list("xabcdefghij")), (None, ["q"]), (None, ["q"])]
    docs = spark.createDataFrame(rows, "id long, w array<string>")
    pairs = spark.createDataFrame([(1, 2)], "doc_a long, doc_b long")
    got = sorted(tuple(r) for r in passages.shared_passages(pairs, docs, "id", "w", 8).collect())
    assert got == sorted(tuple(r) for r in passages._joined_passages(pairs, docs, "id", "w", 8).collect())


def test_communities_take_few_jobs_and_equal_those_by_jobs(spark):
    rows = [(a, b, s) for g in (0, 10) for a, b, s in ((g, g + 1, 0.9), (g + 1, g + 2, 0.7), (g, g + 2, 0.8), (g + 2, g + 3, 0.6), (g + 3, g + 4, 0.9), (g + 4, g + 5, 1.0), (g + 3, g + 5, 0.8))]
    rows += [(None, 1, 1.0), (51, 50, 0.8), (50, 51, 0.9), (60, 61, 0.0)]
    pairs = cut(spark.createDataFrame(rows, "doc_a long, doc_b long, sim double"))
    spark.sparkContext.setJobGroup("communities", "")
    found = {tuple(r) for r in communities.communities(pairs).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("communities"))
    spark.sparkContext.setJobGroup("others", "")
    assert {(51, 50), (50, 50), (2, 0), (15, 13)} <= found and len(found) == 14
    assert {tuple(r) for r in communities.communities(pairs, held=8).collect()} == found  # components dealt to tasks
    assert {tuple(r) for r in communities.communities(pairs, held=4).collect()} == found  # two of them by jobs
    assert jobs < 15


def made_texts(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(["alpha", "Beta", "the", "a", "x", "été", "gamma", "delta."]) + rng.choice(["", "", "s", "."]) for _ in range(n))
    return [(i, "\n\n".join(words(rng.randrange(25)) for _ in range(rng.randrange(4)))) for i in range(24)] + [(24, None), (25, ""), (26, "one"), (27, "one two. three")]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def same_rows(got, want):
    assert len(got) == len(want) > 0
    for x, y in zip(got, want, strict=True):
        assert x[:2] == y[:2] and list(x[2:]) == pytest.approx(list(y[2:]), abs=2e-6)


def test_ensemble_by_groups_equals_joins_and_shuffles_no_sets(spark):
    rows = made_texts(1)
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("w", words("text"))
    pairs = spark.createDataFrame([(a, b) for a, _ in rows for b, _ in rows if a < b], "doc_a long, doc_b long")
    before = shuffled_bytes(spark)
    got = rows_of(ensemble.ensemble(pairs, docs, "id", "text", "w"))
    assert shuffled_bytes(spark) - before < 200_000
    want = rows_of(ensemble._joined(pairs, docs, "id", "text", "w"))
    assert [r[-1] for r in got] == [r[-1] for r in want]
    same_rows([r[:-1] for r in got], [r[:-1] for r in want])


def test_blend_by_groups_equals_joins(spark):
    rows = made_texts(2)
    pairs = spark.createDataFrame([(a, b) for a, _ in rows for b, _ in rows if a < b], "doc_a long, doc_b long")
    made = lambda more: rows_of(blend.lexical_blend(pairs, spark.createDataFrame(rows + more, "id long, text string"), "id", "text"))
    same_rows(made([]), made([(99, "twice"), (99, "twice")]))  # a key that repeats is joined


def test_highest_equals_a_sort():
    rng = np.random.default_rng(3)
    for many in (3, 5, 6, 400):
        scores = rng.integers(0, 4, (20, many)) / 4 * (rng.random((20, many)) < rng.random((20, 1)))
        rows, at = highest(scores, 5)
        want = np.argsort(-scores, axis=1, kind="stable")[:, :5]
        for row in range(20):
            assert list(at[rows == row]) == list(want[row])
