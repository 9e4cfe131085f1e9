"""Scores over a corpus by bags of words, and pairs dealt by groups, against plain loops."""

import collections
import math
import random

import pytest

from pairloom.operators import evidence, lexical, passages, setjoin
from pairloom.plans import structure

rng = random.Random(7)
TEXTS = {i: [f"w{int(40 * rng.random() ** 2)}" for _ in range(rng.randrange(1, 25))] for i in range(30)} | {30: [], 31: ["only"], 32: None}


def docs(spark):
    rows = [(i, w) for i, w in TEXTS.items() if i != 4] + [(4, TEXTS[4][:3]), (4, TEXTS[4][3:]), (None, ["w1"])]  # one id twice, one null
    return spark.createDataFrame(rows, "id long, words array<string>")


def scores(a, b):
    """TF-IDF cosine and BM25 share of two documents."""
    held = [collections.Counter(w) for i, w in TEXTS.items() if w] + [collections.Counter(["w1"])]
    x, y = (collections.Counter(TEXTS[i] or []) for i in (a, b))
    df = collections.Counter(t for c in held for t in c)
    n, mean = len(held) - 1, sum(c.total() for c in held) / len(held)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    norm = [math.sqrt(sum((c[t] * idf[t]) ** 2 for t in c)) for c in (x, y)]
    dot = sum(x[t] * y[t] * idf[t] ** 2 for t in x.keys() & y.keys())
    part = lambda c, t: math.log(1 + (n + 1 - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean))
    own = sum(part(x, t) for t in x)
    return dot / (norm[0] * norm[1]) if dot else 0.0, min(1.0, sum(part(y, t) for t in x.keys() & y.keys()) / own) if own else 0.0


@pytest.mark.parametrize("frequent", [0, 5, 1000])
@pytest.mark.parametrize("beside", [True, False])
def test_scores_equal_a_loop(spark, monkeypatch, frequent, beside):
    """With all, some and no frequencies sent to all tasks; with groups of several blocks."""
    monkeypatch.setattr(lexical, "FREQUENT", frequent)
    monkeypatch.setattr(setjoin, "TOGETHER", 4)
    wanted = [(i, i + 1) for i in range(32)] if beside else [(i, j) for i in range(33) for j in range(i + 1, 33) if (i * j) % 7 == 1 or j > 29]
    pairs = spark.createDataFrame(wanted, "doc_a long, doc_b long")
    bags = lexical.bags(docs(spark))
    assert bags.count() == 32
    shared = lexical.shared_beside(bags) if beside else lexical.shared_by(pairs, bags)
    cosine = {(r.doc_a, r.doc_b): r.sim for r in lexical.tf_idf_cosine(pairs, bags, shared).collect()}
    share = {(r.doc_a, r.doc_b): r.sim for r in lexical.bm25(pairs, bags, shared).collect()}
    assert set(cosine) == set(share) == set(wanted)
    for p in wanted:
        assert (cosine[p], share[p]) == pytest.approx(scores(*p), abs=1e-9)


def test_a_document_of_many_pairs_is_dealt_once_a_group(spark, monkeypatch):
    """Vocabularies of pairs equal those counted by pair; before, a document's words were copied for each of its pairs."""
    texts = {i: w or [] for i, w in TEXTS.items()}
    pairs = spark.createDataFrame([(i, j) for i in range(33) for j in range(i + 1, 33) if j % 3 == i % 3], "doc_a long, doc_b long")
    frame = spark.createDataFrame(list(texts.items()), "id long, w array<string>")
    wide = [(r.doc_a, r.doc_b, texts[r.doc_a], texts[r.doc_b]) for r in pairs.collect()]
    want = evidence.vocabularies(spark.createDataFrame(wide, "doc_a long, doc_b long, wa array<string>, wb array<string>"), "wa", "wb").collect()
    dealt = []
    judged = setjoin._judged
    monkeypatch.setattr(setjoin, "_judged", lambda rows, *x: dealt.append(rows) or judged(rows, *x))
    got = evidence.vocabularies_of(pairs, frame, "id", "w")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    assert dealt[0].where("cb IS NULL").count() == len(texts)


def test_common_phrases_shuffle_no_text(spark, monkeypatch):
    """Phrases are found where their documents are, with the same result as by joins; before, all windows and texts were dealt."""
    rows = spark.createDataFrame([(i, [f"w{(i * i + j) % 11}" for j in range(20)]) for i in range(30)], "id long, w array<string>")
    made = passages.repeated_phrases(rows, "id", "w", n=5, k=4)
    assert "BroadcastNestedLoopJoin" in made._jdf.queryExecution().executedPlan().toString()
    got = made.collect()
    monkeypatch.setattr(passages, "FEW", -1)
    assert got and got == passages.repeated_phrases(rows, "id", "w", n=5, k=4).collect()


def test_citations_are_counted_in_small_tasks(spark, monkeypatch):
    """What meets is dealt to tasks by its number; before, one task took all that its works made meet."""
    monkeypatch.setattr(evidence, "MET", 10)
    cited = spark.createDataFrame([(d, w) for d in range(20) for w in range(d % 5, 9, 2)] * 2 + [(None, 1), (1, None)], "doc long, work long")
    made = evidence.shared_citations(cited)
    held = {d: set(range(d % 5, 9, 2)) for d in range(20)}
    want = {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b and len(held[a] & held[b]) > 1}
    assert {(r.doc_a, r.doc_b): r.shared for r in made.collect()} == want
    met = sum(len(held[a] & held[b]) for a in held for b in held if a < b)
    assert f", {-(-met // 10)})" in made._jdf.queryExecution().optimizedPlan().toString() or f", {-(-met // 10)}" in made._jdf.queryExecution().optimizedPlan().toString()


def test_shingles_are_hashes_of_windows(spark, tmp_path):
    """Shingles are hashed by doubling and never made as text; before, each was sliced and joined."""
    rows = [(i, " ".join(f"w{(i % 7) * 100 + j + (j == 3) * i}" for j in range(5 + 4 * (i % 7)))) for i in range(21)] + [(21, "one two"), (22, "two one"), (23, "One two"), (24, ""), (25, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = structure.dedup_minhash_pairs(spark, str(tmp_path))
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and sets[a] and sets[b] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert want and {(r.doc_a, r.doc_b): round(r.similarity, 6) for r in made.collect()} == want
    planned = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(structure.fingerprints, "minhash_pairs", lambda docs, *_: planned.append(docs) or docs)
        structure.dedup_minhash_pairs(spark, str(tmp_path))
    assert dict(planned[0].dtypes)["items"] == "array<bigint>"
