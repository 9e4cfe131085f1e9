"""Alignment, spanning forest, cuts, greedy windows and prints against loops, on small fixtures."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions.alignment import alignment_cost, sequence_similarity
from pairloom.operators import dendrogram, fingerprints, greedy, lexical, navigable, topics
from pairloom.runtime import cut

PAIRS = "doc_a long, doc_b long, sim double"


def full_table(a, b, gap, mismatch):
    row = [j * gap for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i * gap]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + gap, new[-1] + gap, row[j - 1] + (0 if x == y else mismatch)))
        row = new
    return row[-1]


@pytest.mark.parametrize(("gap", "mismatch"), [(1, 1), (2, 3), (1, 2)])
@pytest.mark.parametrize("band", [1, 3, 12])
def test_band_equals_the_full_table(spark, band, gap, mismatch):
    rng = random.Random(band)
    some = lambda: [rng.choice("abc") for _ in range(rng.randrange(12))]
    rows = [(i, some(), some()) for i in range(60)]
    frame = spark.createDataFrame([*rows, (99, None, ["a"])], "i long, a array<string>, b array<string>")
    got = {r.i: r.c for r in frame.select("i", alignment_cost(F.col("a"), F.col("b"), band, gap, mismatch).alias("c")).collect()}
    assert got.pop(99) is None
    for i, a, b in rows:
        want = full_table(a, b, gap, mismatch)
        assert got[i] == want if want <= gap * band else got[i] is None or got[i] >= want


def test_sequence_similarity(spark):
    rows = [(1, [], []), (2, ["p", "ul"], ["p", "li"]), (3, ["p"] * 9, [])]
    frame = spark.createDataFrame(rows, "i long, a array<string>, b array<string>")
    assert {r.i: r.s for r in frame.select("i", sequence_similarity(F.col("a"), F.col("b"), 4).alias("s")).collect()} == {1: 1.0, 2: 0.5, 3: None}


def forest_of(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    out = []
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
            out.append((a, b, s))
    return out, {x: root(x) for x in list(parent)}


def test_forest_and_cuts_equal_kruskal(spark):
    """Many equal similarities; every cut of the forest has the components of the graph."""
    rng = random.Random(3)
    edges = [(i, j, rng.choice([0.6, 0.7, 0.8, 0.9])) for i in range(40) for j in range(i + 1, 40) if rng.random() < 0.1]
    rows = [*edges, (edges[0][1], edges[0][0], 0.1), (None, 1, 0.9), (2, 2, 1.0), (5, 6, None)]
    pairs = spark.createDataFrame(rows, PAIRS)
    forest = dendrogram.spanning_forest(pairs)
    assert sorted(map(tuple, forest.collect())) == sorted(forest_of(edges)[0])
    docs = spark.createDataFrame([(x,) for x in range(42)], "doc long")
    got = {(r.level, r.doc): r.cluster for r in dendrogram.clusters_at(forest, docs, (0.65, 0.85)).collect()}
    for level in (0.65, 0.85):
        of = forest_of([e for e in edges if e[2] >= level])[1]
        assert all(got[level, x] == of.get(x, x) for x in range(42))
    assert dendrogram.spanning_forest(pairs.limit(0)).count() == 0


def test_silhouettes_equal_a_loop(spark):
    rng = random.Random(6)
    edges = [(i, j, round(rng.uniform(0.5, 1), 3)) for i in range(14) for j in range(i + 1, 14) if rng.random() < 0.5]
    of = {x: x % 3 for x in range(14)} | {13: 9}
    near = {}
    for a, b, s in edges:
        near.setdefault(a, []).append((b, 1 - s))
        near.setdefault(b, []).append((a, 1 - s))
    total = 0.0
    for x in range(14):
        by = {}
        for y, d in near.get(x, []):
            by.setdefault(of[y], []).append(d)
        mean = {c: sum(d) / len(d) for c, d in by.items()}
        others = [m for c, m in mean.items() if c != of[x]]
        if of[x] in mean and others:
            total += (min(others) - mean[of[x]]) / max(min(others), mean[of[x]])
    members = spark.createDataFrame([(0.5, x, c) for x, c in of.items()], "level double, doc long, cluster long")
    got = dendrogram.silhouettes(members, spark.createDataFrame(edges, PAIRS)).first()
    assert got.clusters == 4 and got.silhouette == pytest.approx(total / 14)


@pytest.mark.parametrize("length", [5.0, 0.7, 100.0])
def test_greedy_windows_equal_the_loop(spark, length):
    """User 1 has a third of all events; equal times, gaps of many cells, null keys and times."""
    rng = random.Random(int(length))
    events = [(rng.choice([1, 1, 1, 2, 3, 4]), round(rng.choice([rng.random() * 30, rng.random() * 500]), 1)) for _ in range(400)]
    by, want = {}, []
    for u, t in [*events, (6, 7.0)]:
        by.setdefault(u, []).append(t)
    for u, times in by.items():
        now = None
        for t in sorted(times):
            if now is None or t >= now[1] + length:
                now = [u, t, t, 0]
                want.append(now)
            now[2] = t
            now[3] += 1
    frame = spark.createDataFrame([*events, (None, 1.0), (5, None), (6, 7.0)], "u long, t double")
    got = greedy.greedy_windows(frame, "u", "t", length)
    assert sorted((r.u, r.start, r.end, r.events) for r in got.collect()) == sorted(map(tuple, want))


@pytest.mark.parametrize(("distance", "spare"), [(0, 1), (3, 1), (3, 2), (6, 2)])
def test_hamming_pairs_equal_all_pairs(spark, distance, spare):
    rng = random.Random(distance)
    prints = []
    for i in range(60):
        base = rng.getrandbits(64) if i % 4 == 0 or not prints else prints[-1][1]
        for bit in rng.sample(range(64), rng.randrange(5)):
            base ^= 1 << bit
        prints.append((i, base))
    prints += [(100 + i, p) for i, p in prints[:7]]
    rep, want = {}, set()
    for i, p in prints:
        rep.setdefault(p, i)
    items = sorted(rep.items(), key=lambda x: x[1])
    for x, (p, i) in enumerate(items):
        want |= {(i, j, (p ^ q).bit_count()) for q, j in items[x + 1 :] if (p ^ q).bit_count() <= distance}
    want |= {(rep[p], i, 0) for i, p in prints if rep[p] != i}
    frame = spark.createDataFrame([(i, p >> 32, p & 0xFFFFFFFF) for i, p in prints] + [(None, 1, 2)], "id long, high long, low long")
    assert {tuple(r) for r in fingerprints.hamming_pairs(frame, "id", distance, spare).collect()} == want


def test_hamming_pairs_are_found_once_and_not_shuffled(spark, monkeypatch):
    """Prints that are all near, in several runs: no pair is shuffled or made distinct; before, each pair met under many choices of blocks."""
    monkeypatch.setattr(fingerprints, "RUNS", (5, 7))
    rng = random.Random(8)
    prints = {0xF0F0F0F0F0F0F0F0 ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))): i for i in range(90)} | {i * 0x9E3779B97F4A7C15 % 2**64: 100 + i for i in range(1, 40)}
    want = {(min(i, j), max(i, j), (p ^ q).bit_count()) for p, i in prints.items() for q, j in prints.items() if i < j and (p ^ q).bit_count() <= 6}
    frame = spark.createDataFrame([(str(i).zfill(3), p >> 32, p & 0xFFFFFFFF) for p, i in prints.items()], "id string, high long, low long")
    found = fingerprints.hamming_pairs(frame, "id", 6)
    assert sorted((int(r.doc_a), int(r.doc_b), r.distance) for r in found.collect()) == sorted(want) and len(want) > 1000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 1


def test_vote_of_copies_and_odd_texts(spark):
    words = [f"w{i}" for i in range(80)]
    changed = [*words[:40], "other", *words[41:]]
    texts = {1: " ".join(words), 2: " ".join(words), 3: " ".join(changed), 4: "", 5: None, 6: "ab", 7: "\U0001f600 x"}
    docs = spark.createDataFrame([(i, t, (t or "").split()) for i, t in texts.items()], "id long, t string, w array<string>")
    got = {(r.doc_a, r.doc_b): r for r in fingerprints.duplicate_vote(docs, "id", "t", "w", distance=12).collect()}
    assert set(got) == {(1, 2), (4, 5), (1, 3)} and got[1, 2].kind == got[4, 5].kind == "exact"
    assert got[1, 3].kind == "near" and got[1, 3].shingles == pytest.approx(71 / 81)


def test_simhash_shuffles_sums_alone(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (2, ["b", "c"])], "id long, w array<string>")
    made = fingerprints.simhash(docs, "id", "w")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    bits = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:16], 16)
    for r in made.collect():
        items = {1: ["a", "b", "a"], 2: ["b", "b", "c"]}[r.id]
        want = sum(1 << i for i in range(64) if sum(1 if bits(x) >> i & 1 else -1 for x in items) > 0)
        assert (r.high << 32) | r.low == want


def test_vote_pairs_all_texts_of_equal_shingles(spark, monkeypatch):
    """Texts that differ by their marks alone pair with each other, and no pair is made of SimHashes alone, which can't be rated near."""
    monkeypatch.setattr(fingerprints, "hamming_pairs", None)
    words = [f"w{i}" for i in range(60)]
    changed = [*words[:30], "other", *words[31:]]
    texts = [" ".join(words), " ".join(words) + ".", " ".join(words) + ",", " ".join(changed), " ".join(changed) + ";", " ".join(words)]
    docs = spark.createDataFrame([(i, t, [x.strip(".,;") for x in t.split()]) for i, t in enumerate(texts)], "id long, t string, w array<string>")
    got = [(r.doc_a, r.doc_b, r.shingles) for r in fingerprints.duplicate_vote(docs, "id", "t", "w", 6).collect()]
    assert len(got) == len(set(got)) and {(0, 1), (0, 2), (1, 2), (3, 4), (0, 5), (0, 3)} <= {x[:2] for x in got} and not any(5 in x[:2] and x[0] != 0 for x in got)


def test_factors_find_planted_topics_with_falling_error(spark):
    rng = random.Random(9)
    terms = {t: [f"{t}{i}" for i in range(12)] for t in "abc"}
    weights = [(d, w, 1.0 + rng.random()) for d in range(45) for t in ("abc"[d % 3],) for w in rng.sample(terms[t], 8)]
    weights += [(d, "common", 0.1) for d in range(45)] + [(99, "zero", 0.0)]
    frame = spark.createDataFrame(weights, "id long, token string, x double")
    known = frame.where("x > 0")
    errors = []
    for rounds in (0, 1, 2, 12):
        rows, columns = topics.factors(frame, "id", "token", 3, rounds=rounds)
        errors.append(topics.squared_error(known, "id", "token", rows, columns, 3))
    assert errors == sorted(errors, reverse=True) and errors[-1] < 0.5 * sum(x * x for *_, x in weights)
    main = {r.id: r.topic for r in topics.topic_shares(rows, "id", 3).collect()}
    assert set(main) == set(range(45)) and len(set(main.values())) == 3 and all(main[d] == main[d % 3] for d in main)
    named = {r.topic: set(r.terms.split()) for r in topics.topic_terms(columns, "token", 3, 8).collect()}
    assert all(named[main[i]] <= set(terms[t]) for i, t in enumerate("abc"))


def test_factors_of_few_columns_are_those_of_joins(spark, monkeypatch):
    """One pass a round over packed rows gives the factors of the general form; rows aren't joined or kept again in a round, as they were."""
    rng = random.Random(2)
    weights = [(d, f"t{w}", 0.5 + rng.random()) for d in range(30) for w in rng.sample(range(9), 4)] + [(77, "none", 0.0)]
    frame = spark.createDataFrame(weights, "id long, token string, x double")
    want = [{r[0]: r.f for r in x.collect()} for x in topics.factors(frame, "id", "token", 3, rounds=4)]
    monkeypatch.setattr(topics, "_updated", None)
    got = [{r[0]: r.f for r in x.collect()} for x in topics.factors(frame, "id", "token", 3, rounds=4, small=True)]
    for w, g in zip(want, got, strict=True):
        assert set(w) == set(g) and all(g[i] == pytest.approx(w[i], rel=1e-9) for i in w)


def test_packed_weights_equal_tf_idf(spark):
    """Repeated ids, null and empty lists, and words of no or all documents."""
    words = [(1, ["a", "b", "a", "the"]), (2, ["b", "c", "all"]), (3, ["c", "c", "a"]), (4, []), (5, None), (6, ["rare"]), (2, ["b", "a"])]
    docs = spark.createDataFrame(words, "id long, words array<string>")
    placed = topics.frequent_terms(docs, ("the",), 2)
    assert [tuple(r) for r in placed.orderBy("at").collect()] == [(0, "a", 3), (1, "b", 2)]
    got = {(r.id, "ab"[i]): x for r in topics.packed_tf_idf(docs, placed).collect() for i, x in zip(r.at, r.x, strict=True)}
    tokens = docs.select("id", F.explode("words").alias("token")).where("token IN ('a', 'b')")
    assert got == pytest.approx({(r.id, r.token): r.weight for r in lexical.tf_idf(tokens).collect()})


def test_squared_error_is_that_of_the_whole_table(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 2.0])], "id long, f array<double>")
    columns = spark.createDataFrame([("x", [1.0, 1.0]), ("y", [0.0, 3.0])], "token string, f array<double>")
    weights = spark.createDataFrame([(1, "x", 2.0), (2, "y", 5.0)], "id long, token string, x double")
    assert topics.squared_error(weights, "id", "token", rows, columns, 2) == pytest.approx((2 - 1) ** 2 + 0 + 2.5**2 + (5 - 6) ** 2)


def test_neighbour_graph_and_beam_recall(spark):
    """Recall of links and of searches against brute force; one vector that is near all others has a bounded list."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    x = np.array([centres[i % 12] + rng.normal(scale=0.5, size=8) for i in range(240)])
    x[0] = x.mean(0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 8), (999, None)], "id long, unit array<double>")
    score = x @ x.T
    np.fill_diagonal(score, -2)
    near = np.argsort(-score, axis=1, kind="stable")
    graph = cut(navigable.neighbour_graph(rows, k=8))
    got = {}
    for r in graph.collect():
        got.setdefault(r.id, set()).add(r.other)
    assert all(len(v) == 8 for v in got.values()) and sum(len(got[i] & set(near[i, :8].tolist())) for i in range(240)) >= 0.9 * 240 * 8
    assert navigable.both_ways(graph, 3).groupBy("id").count().agg({"count": "max"}).first()[0] <= 8 + 3
    found = {}
    for r in navigable.beam_search(rows.where("id % 10 = 0"), rows, graph, 5, beam=24).collect():
        found.setdefault(r["query"], {})[r["rank"]] = r.neighbour
    assert sorted(found) == list(range(0, 240, 10)) and all(sorted(v) == [1, 2, 3, 4, 5] for v in found.values())
    assert sum(len(set(v.values()) & set(near[i, :5].tolist())) for i, v in found.items()) >= 0.9 * 24 * 5


def test_sharded_search_of_plain_vectors(spark, monkeypatch):
    """Vectors without structure in several shards, some broken or of another length; the graph of joins finds about 0.6 of the nearest there, and shuffles vectors for each pair."""
    monkeypatch.setattr(navigable, "SHARD", 700)
    x = np.random.default_rng(7).normal(size=(2000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    odd = [(None, [1.0] * 48), (9001, None), (9020, [float("nan")] * 48), (9040, [None] + [1.0] * 47), (9060, [0.6, 0.8]), (9061, [0.8, 0.6]), (9080, [1.0] * 3)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "id long, unit array<double>")
    found = navigable.sharded_search(rows.where("id % 20 = 0"), rows, 5)
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r.neighbour, r.score)
    assert got.pop(9060) == {1: (9061, 0.96)} and sorted(got) == list(range(0, 2000, 20)) and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    score = np.round(x @ x.T, 9)
    np.fill_diagonal(score, -2)
    near = np.argsort(-score, axis=1, kind="stable")[:, :5]
    assert sum(len({n for n, _ in v.values()} & set(near[i].tolist())) for i, v in got.items()) >= 0.95 * 500
    assert all(s == pytest.approx(score[i, n], abs=2e-9) for i, v in got.items() for n, s in v.values())
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
