"""The set join against all pairs."""

import random
import re

import pytest

from pairloom.operators import setjoin
from pairloom.operators.setjoin import jaccard_join
from pairloom.plans import structure
from pairloom.runtime import cut


@pytest.mark.parametrize("threshold", [0.3, 0.59, 0.8])
def test_equals_all_pairs(spark, threshold):
    rng = random.Random(5)
    base = [rng.sample(range(40), rng.randint(1, 14)) for _ in range(40)]
    sets = [sorted({str(x if rng.random() < 0.85 else rng.randrange(40)) for x in rng.choice(base)}) for _ in range(150)] + [[], None]
    rows = [(i, s, rng.choice(["x", "y", None]) if i % 5 == 0 else "x") for i, s in enumerate(sets)]
    made = spark.createDataFrame(rows, "id long, tokens array<string>, part string")
    found = {(r["doc_a"], r["doc_b"]): round(r["sim"], 9) for r in jaccard_join(made, "id", "tokens", threshold, within="part").collect()}
    first, wanted = {}, {}
    for i, s, p in rows:
        if s and p is not None and first.setdefault((p, *sorted({*s})), i) != i:
            wanted[first[p, *sorted({*s})], i] = 1.0
    firsts = [r for r in rows if r[0] in first.values()]
    for i, s, p in firsts:
        for j, t, q in firsts:
            if i < j and p == q:
                sim = len({*s} & {*t}) / len({*s} | {*t})
                if sim >= threshold - 1e-12:
                    wanted[i, j] = round(sim, 9)
    assert found == wanted


def test_minhash_pairs_are_whole_and_exact(spark, tmp_path):
    rng = random.Random(3)
    texts = []
    for n in range(40):
        base = [f"w{n}x{j}" for j in range(60)]
        other = base[:45] + [f"v{n}x{j}" for j in range(rng.randrange(5, 25))]
        texts += [" ".join(base), " ".join(other)]
    texts += ["exact copy of these six words"] * 4 + ["short text"] * 3 + ["Short text", "other", "", None, "..."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"\w+", (t or "").lower())
        if w:
            sets[i] = frozenset(" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    first = {}
    for i, x in sets.items():
        first.setdefault(x, i)
    want = {(first[x], i): 1.0 for i, x in sets.items() if first[x] != i}
    for x, i in first.items():
        want |= {(i, j): len(x & y) / len(x | y) for y, j in first.items() if i < j and 2 * len(x & y) >= len(x | y)}
    got = structure.dedup_minhash_pairs(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.doc_a, r.doc_b): r.similarity for r in got} == pytest.approx(want)
    assert len(want) > 30 and (80, 83) in want and (84, 87) in want


@pytest.mark.parametrize("crowd", [2, 64])
def test_signatures_lose_nothing(spark, monkeypatch, crowd):
    """Candidates by MinHash, and by first tokens in crowded bands, are those of all pairs."""
    monkeypatch.setattr(setjoin, "MET", -1)
    monkeypatch.setattr(setjoin, "CROWD", crowd)
    rng = random.Random(8)
    sets = []
    for _ in range(60):
        base = {f"the{rng.randrange(30)}" for _ in range(20)} | {f"w{rng.randrange(2000)}" for _ in range(rng.choice([1, 20, 60]))}
        sets += [sorted(base), sorted({x if rng.random() < 0.85 else f"v{rng.randrange(2000)}" for x in base}), sorted(rng.sample(sorted(base), max(1, len(base) * 2 // 3)))]
    sets += [["the1", f"only{i}"] for i in range(80)] + [sets[0]] * 3
    made = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    found = {(r["doc_a"], r["doc_b"]): round(r["sim"], 9) for r in jaccard_join(made, "id", "tokens", 0.59).collect()}
    first, wanted = {}, {}
    for i, s in enumerate(sets):
        if first.setdefault(tuple(s), i) != i:
            wanted[first[tuple(s)], i] = 1.0
    for s, i in first.items():
        for t, j in first.items():
            sim = len({*s} & {*t}) / len({*s} | {*t})
            if i < j and sim >= 0.59 - 1e-12:
                wanted[i, j] = round(sim, 9)
    assert found == wanted and len(wanted) > 100


def test_unlike_sets_of_frequent_tokens_do_not_meet(spark, monkeypatch):
    """Unlike sets whose tokens are all frequent give next to no candidates; before, nearly all pairs met."""
    rng = random.Random(4)
    sets = [sorted({f"w{int(1200 * rng.random() ** 2)}" for _ in range(120)}) for _ in range(1500)]
    made = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    joined = []
    monkeypatch.setattr(setjoin, "cut", lambda df: joined.append(cut(df)) or joined[-1])
    assert jaccard_join(made, "id", "tokens", 0.59).count() == 0
    candidates = [x for x in joined if x.columns == ["ca", "cb"]]
    assert len(candidates) == 1 and candidates[0].count() < 1500


def test_candidates_are_screened_by_all_tokens(spark, monkeypatch):
    """Pairs that are a third alike meet in bands and are dropped by sketches; before, hundreds of a group's were compared whole."""
    monkeypatch.setattr(setjoin, "MET", -1)
    rng = random.Random(6)
    # 28 of 60 tokens shared by all of a group: a third alike, below the threshold; two equal but for a token
    sets = [sorted({f"g{n}x{j}" for j in range(28)} | {f"w{rng.randrange(9000)}" for _ in range(32)}) for n in range(4) for _ in range(40)]
    sets += [sorted([*x[:-1], "other"]) for x in sets[::40]]
    made = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    joined = []
    monkeypatch.setattr(setjoin, "cut", lambda df: joined.append(cut(df)) or joined[-1])
    found = {(r["doc_a"], r["doc_b"]) for r in jaccard_join(made, "id", "tokens", 0.59).collect()}
    assert found == {(40 * n, 160 + n) for n in range(4)}
    candidates = [x for x in joined if x.columns == ["ca", "cb"]]
    assert len(candidates) == 1 and candidates[0].count() < 400


def test_what_is_kept_is_narrow(spark, monkeypatch):
    """Checkpoints hold hashes and sketches; before, they held the tokens themselves and 240 bands for each set."""
    monkeypatch.setattr(setjoin, "MET", -1)
    sets = [[f"a long word {n} {j}" for j in range(30)] + ["more"] * (n % 2) for n in range(20)]
    sets += [[*s[1:], "other"] for s in sets]
    made = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    joined = []
    monkeypatch.setattr(setjoin, "cut", lambda df: joined.append(cut(df)) or joined[-1])
    assert {(r["doc_a"], r["doc_b"]) for r in jaccard_join(made, "id", "tokens", 0.59).collect()} == {(n, n + 20) for n in range(20)}
    assert joined and not any(t == "array<string>" or c == "bands" for x in joined for c, t in x.dtypes)


def test_crowded_sets_meet_inside_tasks(spark, monkeypatch):
    """Sets of crowded bands make no table of pairs by first tokens, sketches are half as wide, and whole sets are dealt by groups of links; before, pairs were shuffled."""
    monkeypatch.setattr(setjoin, "MET", -1)
    monkeypatch.setattr(setjoin, "CROWD", 2)
    monkeypatch.setattr(setjoin, "MEETINGS", 3)
    monkeypatch.setattr(setjoin, "_prefix_pairs", None)
    sets = [[f"g{n % 3}x{j}" for j in range(20)] + [f"own{n}"] for n in range(12)]
    made = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    joined = []
    monkeypatch.setattr(setjoin, "cut", lambda df: joined.append(cut(df)) or joined[-1])
    found = {(r["doc_a"], r["doc_b"]): round(r["sim"], 9) for r in jaccard_join(made, "id", "tokens", 0.59).collect()}
    assert found == {(i, j): round(20 / 22, 9) for i in range(12) for j in range(i + 3, 12, 3)}
    assert {len(r.sketch) for x in joined if x.columns == ["c", "sketch"] for r in x.collect()} == {setjoin.SKETCH // 16}
