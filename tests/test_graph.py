"""Components, PageRank and set joins against brute force."""

import random

import pytest

from pairloom.operators import components, graph
from pairloom.operators.components import connected_components
from pairloom.operators.setjoin import jaccard_join


def brute_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 80)] + [(100, 101), (101, 102), (7, 7), (None, 3)],
    [(random.Random(3).randrange(200), random.Random(i).randrange(200)) for i in range(150)],
    [],
])
@pytest.mark.parametrize("few", [300_000, 0])
def test_components(spark, monkeypatch, edges, few):
    monkeypatch.setattr(components, "FEW", few)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components(edges)


def test_page_rank_sums_to_one_and_prefers_the_hub(spark):
    pairs = spark.createDataFrame([(0, i, 1.0) for i in range(1, 6)], "doc_a long, doc_b long, sim double")
    ranks = {r.doc: r["rank"] for r in graph.page_rank(pairs).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and max(ranks, key=ranks.get) == 0


def test_jaccard_join_is_exact(spark):
    rng = random.Random(5)
    sets = {i: sorted({f"t{rng.randrange(12)}" for _ in range(rng.randrange(1, 9))}) for i in range(60)}
    sets[60] = []
    docs = spark.createDataFrame([(i, "x", s) for i, s in sets.items()], "id long, part string, tokens array<string>")
    got = {(r.doc_a, r.doc_b): r.sim for r in jaccard_join(docs, "id", "tokens", 0.6, "part").collect()}
    first = {tuple(s): i for i, s in sorted(sets.items(), reverse=True)}
    want = {(first[tuple(s)], i): 1.0 for i, s in sets.items() if s and first[tuple(s)] != i}
    for a in first.values():
        for b in first.values():
            if a < b and sets[a] and sets[b]:
                s = len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
                if s >= 0.6:
                    want[a, b] = s
    assert got == pytest.approx(want)


def test_clusters_and_families(spark):
    pairs = spark.createDataFrame([(1, 2, 0.95), (2, 3, 0.8), (8, 9, 0.6)], "doc_a long, doc_b long, sim double")
    got = {r.cluster: (r.size, r.risk) for r in graph.clusters(pairs, 0.59).collect()}
    assert got == {1: (3, "critical"), 8: (2, "elevated")}
