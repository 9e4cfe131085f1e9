"""Phrases, mixing and vector codes against brute force, on small fixtures."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from pairloom.llm import codes, mixing, phrases, secrets

DOCS = "doc_id long, text string, lang string, source string, k string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def phrase_counts(docs, longest=3):
    """f by (lang, words), and all words by lang."""
    f, first, total = Counter(), {}, Counter()
    for key, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    x = lang, tuple(w[i : i + n])
                    f[x] += 1
                    first[x] = min(first.get(x, (1, 0)), (1, 0) if key is None else (0, key))
    return f, first, total


def brute_collocations(docs, longest=3, least=10, k=2000, percent=50):
    f, first, total = phrase_counts(docs, longest)
    good = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    covered = set()
    for (lang, w), a in good.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                if 100 * a >= percent * good[lang, w[i : i + n]]:
                    covered.add((lang, w[i : i + n]))
    rows = defaultdict(list)
    for (lang, w), a in good.items():
        if (lang, w) in covered:
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, w[:j]] * f[lang, w[j:]]), j, f[lang, w[:j]], f[lang, w[j:]]) for j in range(1, len(w)))
        seen = first[lang, w]
        rows[lang].append((-score, -a, " ".join(w).encode(), l, r, None if seen == (1, 0) else seen[1]))
    out = []
    for lang, found in rows.items():
        for rank, (score, a, phrase, l, r, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score, doc))
    return sorted(out, key=str)


def word_docs(seed, n=60):
    rng = random.Random(seed)
    some = ["The", "a", "of", "é", "日本", "x-y", "B c", "it's", "\U0001f600", "in"]
    glue = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ! ", "\r\n", " "]
    docs = [(i, "".join(rng.choice(some) + rng.choice(glue) for _ in range(rng.randrange(60))), rng.choice(["en", "en", None, "und", ""]), "s", "k") for i in range(n)]
    return [*docs, (None, "the of the of the of", "en", "s", "k"), (7, None, "en", "s", None), (8, "", None, None, "k"), docs[3], docs[3]]


@pytest.mark.parametrize("bits", [64, 6])
def test_collocations_equal_brute_force(spark, bits):
    """Also with fingerprints of six bits, which collide everywhere."""
    docs = word_docs(bits)
    for longest in (2, 3, 4):
        got = phrases.collocations(spark.createDataFrame(docs, DOCS), "doc_id", "text", "lang", longest=longest, bits=bits)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "doc"]
        assert sorted(map(tuple, got.collect()), key=str) == brute_collocations(docs, longest)


def test_collocations_cut_at_k(spark):
    docs = word_docs(3)
    got = phrases.collocations(spark.createDataFrame(docs, DOCS), "doc_id", "text", "lang", k=7, least=3, percent=80)
    assert sorted(map(tuple, got.collect()), key=str) == brute_collocations(docs, least=3, k=7, percent=80)


def test_collocations_of_long_texts_and_no_rows(spark, monkeypatch):
    """Texts of several slices, one word longer than a slice and than a prefix sum, and empty tables."""
    long = "alpha beta gamma " * 9000 + "z" * 700_000 + " " + "alpha beta, " * 12
    docs = [(1, long, "en", "s", "k"), (2, "z" * 700_000 + " beta", "en", "s", "k")]
    rows = spark.createDataFrame(docs, DOCS)
    got = sorted(map(tuple, phrases.collocations(rows, "doc_id", "text", "lang").collect()), key=str)
    assert got == brute_collocations(docs)
    assert phrases.collocations(rows.limit(0), "doc_id", "text", "lang").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é.\t\n日x ", max_size=200), st.integers(1, 40), st.integers(1, 4))
def test_slices_count_each_run_once(text, span, longest):
    data = np.frombuffer(text.encode(), np.uint8)
    found = Counter()
    for words, _, _ in phrases.slices(data, longest, span):
        for n in range(1, longest + 1):
            keep = words.runs(n)
            keep[: max(0, words.old - n + 1)] = False
            found.update(words.phrase(i, n) for i in np.flatnonzero(keep))
    want = Counter()
    for piece in re.split(rb"[.,;:!?\n-\r]", lower(text).encode()):
        w = re.findall(rb"[^ \t]+", piece)
        want.update(b" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    assert found == want


def test_fingerprints_of_runs_are_those_of_their_bytes():
    words = phrases.Words(np.frombuffer(b"ab  cd, ab cd ef ab\tcd", np.uint8))
    one = words.prints(2, np.zeros(7, np.uint64), 64)
    assert one[0] == one[2] == one[5] and len(set(one.tolist())) == 4
    far = np.arange(3 * phrases.SPAN, dtype=np.int64) % 251
    for which in range(2):
        at = np.array([0, 5, phrases.SPAN, phrases.SPAN + 1, len(far)])
        p, b = phrases.PRIMES[which], phrases.BASES[which]
        want, power, total = [], 1, 0
        for i, x in enumerate([*far.tolist(), 0]):
            if i in at:
                want.append(total)
            total, power = (total + (x + 1) * power) % p, power * b % p
        assert phrases.prefixes(far.astype(np.uint8), at, which).tolist() == want


def brute_targets(sizes, weights, share, most):
    left, fixed = share * sum(sizes), {}
    while True:
        still = [i for i in range(len(sizes)) if i not in fixed]
        asked = {i: left * weights[i] / sum(weights[j] for j in still) for i in still}
        over = [i for i in still if asked[i] > most * sizes[i]]
        if not over:
            return [fixed.get(i, asked.get(i)) for i in range(len(sizes))]
        for i in over:
            fixed[i] = most * sizes[i]
            left -= fixed[i]


def mixed_docs(seed=5, n=300):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        source = rng.choice(["big"] * 4 + ["a", "b", "\U0001f600", "￿", None, "rare"] if rng.random() < 0.98 else ["tiny"])
        size = rng.choice([0, 1, 5, 40, 700]) if source != "rare" else rng.randrange(3)
        docs.append((i, " ".join(["w"] * size) if size else rng.choice([None, "", " \t\n"]), "en", source, "k"))
    return [*docs, (None, "null key", "en", "a", "k"), docs[5], docs[5], (1000, "x " * 5000, "en", "b", "k")]


def test_mix_takes_its_targets(spark):
    docs = mixed_docs()
    frame = spark.createDataFrame(docs, DOCS)
    made = []
    for parts in (4, 7):
        rows, pieces = mixing.mix(frame.repartition(parts), "doc_id", "text", "source")
        made.append((rows, pieces, sorted(map(tuple, mixing.taken(rows, pieces, "doc_id").collect()), key=str)))
    assert made[0][2] == made[1][2]  # however the rows are dealt out
    by = defaultdict(int)
    for d in docs:
        by[d[3]] += len((d[1] or "").split())
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, brute_targets([by[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2), strict=True))
    rows, pieces, taken = made[0]
    assert len(taken) == len(docs)
    source = {r.row: (r.key, r.size, r.source_size, r.target) for r in rows.collect()}
    assert sorted({(x[2], round(x[3], 6)) for x in source.values()}) == sorted({(by[s], round(want[s], 6)) for s in names})
    seen, shards = defaultdict(list), defaultdict(list)
    for r in pieces.collect():
        seen[r.row, r.epoch].append((r.start, r.start + r.length))
        shards[r.shard].append(r.position)
    for (row, _), spans in seen.items():  # an epoch draws no word twice
        spans.sort()
        assert spans[0][0] >= 0 and spans[-1][1] <= source[row][1] and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert all(sorted(p) == list(range(len(p))) for p in shards.values())
    total = defaultdict(int)
    for key, size, source_size, target, took, _ in taken:
        assert 0 <= took <= 2 * size
        total[source_size, target] += took
    for (_, target), took in total.items():
        assert abs(took - target) <= 1


def test_splitting_tree_keeps_quotas(spark):
    for shards in (1, 2, 7, 3000):
        quotas = [1000, 0, 77, 30_000]
        got = sorted(mixing.shard_quotas(spark.range(1), quotas, shards).collect())
        assert [r["first"] for r in got] == list(range(shards))
        before = np.zeros(4, np.int64)
        sizes = []
        for r in got:
            assert r["before"] == before.tolist() and min(r["quotas"]) >= 0
            before += r["quotas"]
            sizes.append(sum(r["quotas"]))
        assert before.tolist() == quotas and max(sizes) - min(sizes) <= np.ceil(np.log2(shards)) + 1
    halves = [r["quotas"] for r in mixing.shard_quotas(spark.range(1), [2000, 4000], 40).collect()]
    assert all(20 <= a <= 85 and 140 - a <= b <= 160 - a for a, b in halves)  # shares are near those of the whole


def test_draws_cover_their_source():
    for size, take, block in ((1, 2, 4), (10, 13, 4), (12, 24, 4), (12, 5, 4), (1000, 1999, 7), (3, 0, 4), (0, 0, 4)):
        drawn = 0
        for e in mixing.draws_of(3, size, take, block, 2):
            order = [(e["factor"] * b + e["shift"]) % e["blocks"] for b in range(e["blocks"])]
            assert sorted(order) == list(range(e["blocks"]))
            length = {order[b]: min(block, size - b * block) for b in range(e["blocks"])}
            before, words = 0, 0
            for d in range(e["drawn"]):
                ahead = d * block - (e["missing"] if d > e["short"] else 0)
                assert ahead == before
                words += min(length[d], e["words"] - ahead)
                before += length[d]
            assert words == e["words"]
            drawn += words
        assert drawn == take


def test_mix_of_no_rows_and_no_words(spark):
    frame = spark.createDataFrame([(1, None, "en", None, "k"), (2, "", "en", "a", "k")], DOCS)
    rows, pieces = mixing.mix(frame, "doc_id", "text", "source")
    assert sorted(map(tuple, mixing.taken(rows, pieces, "doc_id").collect())) == [(1, 0, 0, 0.0, 0, ""), (2, 0, 0, 0.0, 0, "")]
    rows, pieces = mixing.mix(frame.limit(0), "doc_id", "text", "source")
    assert mixing.taken(rows, pieces, "doc_id").count() == 0


def brute_codes(vectors, parts=16, entries=64, rounds=2):
    kept = sorted((v for v in vectors if v[1] is not None and len(v[1]) and all(x is not None and np.isfinite(x) for x in v[1])), key=lambda v: (v[0] is None, v[0] or 0, v[1]))
    x = np.array([[int(np.floor(256 * np.float64(c))) for c in v[1]] for v in kept])
    p = x.reshape(len(x), parts, -1).transpose(1, 0, 2)
    books = p[:, :entries].copy()
    near = lambda: np.stack([((p[i][:, None] - books[i][None]) ** 2).sum(2).argmin(1) for i in range(parts)])
    for _ in range(rounds):
        a = near()
        for i in range(parts):
            for e in set(a[i].tolist()):
                members = p[i][a[i] == e]
                books[i, e] = [int(s) // len(members) for s in members.sum(0)]
    a = near()
    error = sum(((p[i] - books[i][a[i]]) ** 2).sum(1) for i in range(parts)).tolist()
    by = Counter()
    for v, e in zip(kept, error, strict=True):
        by[v[2]] += e
    return [(v[0], v[2], "".join(f"{c:02x}" for c in a[:, i]), error[i], by[v[2]]) for i, v in enumerate(kept)], books


VECTORS = "vec_id long, embedding array<double>, label string, code string"


def vectors_of(seed, n, width, clusters=None):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters or n, width))
    rows = [(i, (centre[i % len(centre)] + rng.normal(scale=0.01, size=width)).tolist(), rng.choice(["a", "b", None]), "c") for i in range(n)]
    odd = [(n, None, "a", "c"), (n + 1, [], "a", "c"), (n + 2, [None] * width, "a", "c"), (n + 3, [float("nan")] * width, None, "c"), (n + 4, [float("inf")] * width, "b", "c"), (None, rows[0][1], "a", "c"), rows[1], rows[1], (5, rows[9][1], None, "c")]
    return [*rows, *odd, *((n + 10 + i, [0.0] * width, "zero", None) for i in range(9))]


@pytest.mark.parametrize(("n", "width", "clusters"), [(700, 32, None), (900, 64, 20), (20, 16, None)])
def test_codes_equal_brute_force(spark, n, width, clusters):
    rows = vectors_of(n, n, width, clusters)
    want, books = brute_codes(rows)
    got, made = codes.compress(spark.createDataFrame(rows, VECTORS).repartition(5))
    assert (made == books).all()
    assert codes.books_sha256(made) == hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    assert Counter(map(tuple, codes.with_label_error(got).collect())) == Counter(want)


def test_codes_of_no_rows_and_wrong_rows(spark):
    rows = spark.createDataFrame(vectors_of(1, 20, 16), VECTORS)
    got, _ = codes.compress(rows.limit(0))
    assert codes.with_label_error(got).columns == ["vec_id", "label", "code", "error", "label_error"] and got.count() == 0
    with pytest.raises(ValueError, match="components"):
        codes.compress(rows.unionByName(spark.createDataFrame([(99, [1.0] * 32, "a", "c")], VECTORS)))
    with pytest.raises(Exception, match="2\\^26"):
        codes.compress(rows.unionByName(spark.createDataFrame([(99, [1e12] * 16, "a", "c")], VECTORS)))


@pytest.mark.parametrize("width", [1, 2, 4])
def test_trees_are_cover_trees_and_skip_most_points(width):
    """Nets are separated, cover their points, and nest; on clustered points whole subtrees are assigned."""
    rng = np.random.default_rng(width)
    centre = rng.integers(-3000, 3000, (64, width))
    points = np.concatenate([centre[rng.integers(0, 64, 3000)] + rng.integers(-3, 4, (3000, width)), np.repeat(centre[:1], 50, axis=0)])
    net, radius, owner = codes.farthest_first(points[None].astype(float), 256)
    assert (np.diff(radius[0][1:]) <= 1e-9).all()
    for k in (2, 20, net.shape[1]):
        chosen = points[net[0][:k]]
        apart = np.sqrt(((chosen[:, None] - chosen[None]) ** 2).sum(2))[np.triu_indices(k, 1)]
        covered = np.sqrt(((points[:, None] - chosen[None]) ** 2).sum(2)).min(1).max()
        assert apart.min() >= radius[0][k - 1] - 1e-9 and (k == net.shape[1] or covered <= radius[0][k - 1] + 1e-9)
    tree = codes.Tree(points, net[0], radius[0], owner[0])
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for (a, *_), (b, *_) in zip(tree.levels, tree.levels[1:], strict=False):
        assert set(a.tolist()) <= set(b.tolist())  # nodes are made of nodes below
    for start, size, centre_, reach, sums in tree.levels:
        for i in range(len(start)):
            own = tree.points[start[i] : start[i] + size[i]]
            assert (own.sum(0) == sums[i]).all() and abs(np.sqrt(((own - centre_[i]) ** 2).sum(1)).max() - reach[i]) < 1e-6
    code, count, total, compared = codes.assign(tree, centre)
    want = ((tree.points[:, None] - centre[None]) ** 2).sum(2).argmin(1)
    assert (code == want).all() and (count == np.bincount(want, minlength=64)).all()
    assert all((total[e] == tree.points[want == e].sum(0)).all() for e in range(64))
    assert compared < len(points) * {1: 0.9, 2: 0.3, 4: 0.2}[width]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 200), st.integers(1, 3), st.integers(1, 12), st.integers(1, 60))
def test_assignment_is_exact_with_ties(seed, n, width, entries, spread):
    rng = np.random.default_rng(seed)
    points, book = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (entries, width))
    net, radius, owner = codes.farthest_first(points[None].astype(float), 16)
    tree = codes.Tree(points, net[0], radius[0], owner[0])
    code, count, _, _ = codes.assign(tree, book)
    want = ((tree.points[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert (code == want).all() and count.sum() == n


@pytest.mark.parametrize("n", [0, 1, 300, 20_000])
def test_spans_and_redaction_of_many_secrets(spark, n):
    """Twenty thousand secrets in one text, between letters of several bytes: spans and marks are those of a plain loop."""
    text = " é ".join(f"password=abcdef{i:06d} \U0001f600" for i in range(n)) + " tail"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "AKIA" + "A" * 20 + " token: abcdef" + "0" * 24)], "doc_id long, text string")
    ledger = secrets.scan(docs)
    found = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secrets.findings(docs, ledger, "doc_id").collect()}
    assert found[1] == [m.span() for m in re.finditer(r"password=[a-z0-9]+", text)] and found[2] == [] and len(found[3]) == 3
    marked = secrets.joined_back(docs.withColumn("blob", secrets.blob_id(F.col("text"))), ledger).select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("x"))
    got = {r.doc_id: r.x for r in marked.collect()}
    assert got == {1: re.sub(r"password=[a-z0-9]+", "[REDACTED]", text), 2: None, 3: "[REDACTED] [REDACTED]"}
    assert secrets.findings(docs.limit(0), secrets.scan(docs.limit(0)), "doc_id").count() == 0
