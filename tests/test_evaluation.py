"""Statements, the lexical blend and the labelled evaluation against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.operators import blend, evaluation, statements

TEXTS = [
    (1, "The old mill is a ruin. Heat causes rapid change in ice!  Rain was."), (2, "the OLD mill IS a ruin. Ice contains, well, trapped old air"), (3, None), (4, ""), (5, "is"), (6, "a is is b"),
    (1, "The old mill is a ruin. Heat causes rapid change in ice!  Rain was."), (7, "No end here is" + " word" * 5000 + " leads to x"),
]


def stated(text):
    out = []
    for i, sentence in enumerate(re.split(r"(?<=[.!?])\s+", text or "")):
        w = re.sub(r"[^\w\s]", "", sentence).split()
        out += [(i, k, " ".join(w[max(0, k - 3) : k]), w[k].lower(), " ".join(w[k + 1 : k + 4])) for k in range(1, len(w) - 1) if w[k].lower() in statements.VERBS]
    return out


def test_statements_equal_plain_python(spark):
    docs = spark.createDataFrame(TEXTS, "key long, text string").withColumn("sentence", F.lit("clash")).withColumn("w", F.lit(1))
    got = sorted(map(tuple, statements.statements(docs, "key", "text").collect()))
    assert got == sorted((k, *row) for k, t in TEXTS for row in stated(t)) and len(got) > 8
    assert statements.statements(docs.limit(0), "key", "text").count() == 0


def test_concepts_and_their_overlap(spark):
    docs = spark.createDataFrame(TEXTS, "key long, text string")
    found = statements.statements(docs, "key", "text")
    edges = statements.concept_edges(found, "key")
    want = Counter((s.lower(), p, o.lower()) for _, t in TEXTS for _, _, s, p, o in stated(t))
    assert {(r.subject, r.predicate, r.object): r.statements for r in edges.collect()} == want
    assert {tuple(r)[:3]: r.documents for r in edges.collect()}[("the old mill", "is", "a ruin")] == 2
    nodes = {r.node: (r.out_edges, r.in_edges) for r in statements.concept_nodes(edges).collect()}
    assert nodes["a"] == (1, 0) and nodes["is b"] == (0, 1) and nodes["a ruin"] == (0, 1)
    pairs = spark.createDataFrame([(1, 2), (3, 4), (1, 3)], "doc_a long, doc_b long")
    rows = {(r.doc_a, r.doc_b): r for r in statements.concept_overlap(pairs, found, "key").collect()}
    assert rows[1, 2].shared_edges == 1 and rows[1, 2].edge_jaccard == round(1 / 3, 4) and not rows[1, 2].flagged
    for pair in ((3, 4), (1, 3)):
        assert tuple(rows[pair])[2:] == (0, 0.0, 0.0, 0.0, False)


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_length_equals_the_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("ab c", k=rng.randrange(40))) for _ in range(2))
        assert blend.common_length(a, b) == subsequence(a, b)
    a, b = ("".join(rng.choices("abcdefgh ", k=400)) for _ in range(2))
    assert blend.common_length(a, b) == subsequence(a, b)
    assert blend.common_length("ab" * 20_000, "ba" * 20_000) == 39_999


def blended(x, y):
    if not x or not y:
        return [0.0] * 5
    grams = lambda t: {t[i : i + 3] for i in range(max(1, len(t) - 2))}
    share = lambda p, q: len(p & q) / len(p | q)
    ca, cb = (Counter(w for w in t.split() if len(w) > 1) for t in (x, y))
    weigh = lambda own, other: {w: c * (1 if w in other else math.log(1.5) + 1) for w, c in own.items()}
    a, b = weigh(ca, cb), weigh(cb, ca)
    length = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
    cosine = sum(v * b.get(w, 0) for w, v in a.items()) / length if length else 0.0
    p, q = x[:1000], y[:1000]
    row = list(range(len(q) + 1))
    for i, c in enumerate(p, 1):
        before, row[0] = row[0], i
        for j, e in enumerate(q, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != e))
    return [cosine, share(grams(x), grams(y)), share(set(x.split()), set(y.split())), 2 * subsequence(x, y) / (len(x) + len(y)), 1 - row[-1] / max(len(p), len(q))]


def test_blend_equals_plain_python(spark):
    rng = random.Random(5)
    pool = ["stone", "Bridge", "over", "the", "é", "river", "a", "b", "17", "mud"]
    texts = [" ".join(rng.choices(pool, k=rng.choice([1, 3, 12, 60]))) for _ in range(12)] + [None, "", "the of", "x", "river, river! " * 120]
    rows = list(enumerate(texts))
    clean = {i: " ".join(w for w in re.findall("[a-z]+", (t or "").lower()) if w not in blend.STOP) for i, t in rows}
    asked = [(i, j) for i, _ in rows for j, _ in rows if i < j]
    got = blend.lexical_blend(spark.createDataFrame(asked, "doc_a long, doc_b long"), spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert len(got) == len(asked)
    for r in got:
        want = blended(clean[r.doc_a], clean[r.doc_b])
        assert list(r)[2:7] == pytest.approx(want), (r, texts[r.doc_a], texts[r.doc_b])
        assert r.score == pytest.approx(sum(w * v for w, v in zip(blend.WEIGHTS.values(), want, strict=True)))


def test_evaluation_tells_edits_from_strangers(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 60)))) for i in range(80)] + [(80, None), (None, "no key"), (200, "")]
    pairs = evaluation.labelled_pairs(spark.createDataFrame(rows, "key long, text string"), "key", "text")
    made = {(r.key, r.label): r for r in pairs.collect()}
    assert len(made) == 82 + 80
    w = made[1, 1].words_a
    assert made[0, 1].words_b == made[0, 1].words_a and made[1, 1].words_b == w[len(w) // 2 :] + w[: len(w) // 2]
    assert made[2, 1].words_b == [x for i, x in enumerate(made[2, 1].words_a) if i % 4 != 3]
    assert made[3, 1].words_b == [x + "x" if i % 3 == 2 else x for i, x in enumerate(made[3, 1].words_a)]
    assert made[3, 0].words_b == made[4, 1].words_a and made[3, 0].kind == "unrelated"
    scored = evaluation.scored_pairs(pairs, "key").cache()
    assert scored.count() == len(made) and scored.where("key = 80 AND jaccard + trigrams + tf_idf = 0").count() == 1
    areas, sweeps, bests = evaluation.evaluate(scored.where("key < 80"))
    rows = scored.where("key < 80").collect()
    for method, auc in areas.collect():  # a third of the words changed leaves no run of three: such pairs tie with strangers
        won = [(x > y) + (x == y) / 2 for x in (r[method] for r in rows if r.label == 1) for y in (r[method] for r in rows if r.label == 0)]
        assert auc == pytest.approx(sum(won) / len(won), abs=1e-6) and auc > (0.85 if method == "trigrams" else 0.99)
    assert sweeps.count() == 66 * 3 and sweeps.where("tp + fp = 0 AND precision <> 1").count() == 0
    assert all(r.f1 > 0.9 for r in bests.where("method <> 'trigrams'").collect())
    scored.unpersist()


def test_texts_are_joined_before_they_are_split(spark):
    """The join of neighbours shuffles texts; before, it shuffled lists of words."""
    docs = spark.createDataFrame([(0, "a b c"), (1, "b c d"), (2, None)], "id long, text string").hint("merge")
    plan = evaluation.labelled_pairs(docs, "id", "text")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join ") :]
    assert "regexp_extract_all" not in below and "regexp_extract_all" in plan
