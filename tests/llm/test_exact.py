"""Operators of the llm folder against brute force, on small fixtures."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm import bpe, chat, langid, minhash, packing, polytope, secrets, shingles, streams, topk, urls, warc
from pairloom.runtime import cut

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = ["", "a" * 3000, "ab" * 500 + "é" * 99, " \n\n x\t y ", "password: hunter22", "\U0001f600 don't 12³ x_y", "aaa aaaa", "日本語" * 40, "<|endoftext|> ?!"]


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def shingles_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(n, links):
    parent = {x: x for x in n}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in n}


def near_texts(seed=1, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, key = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 7)):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((key, " ".join(own)))
            key += 1
    return [*rows, (key, None), (key + 1, ""), (key + 2, "  \n"), (key + 3, "One two"), (key + 4, "one TWO"), (None, "x y z"), (key + 5, rows[0][1]), (key + 5, rows[0][1])]


@pytest.mark.parametrize(("percent", "shingles", "rows", "bucket", "few"), [(85, 10**6, 256, 1024, 10**6), (80, 300, 3, 3, 0)])
def test_minhash_equals_brute_force(spark, monkeypatch, percent, shingles, rows, bucket, few):
    for name, value in (("BLOCK_SHINGLES", shingles), ("BLOCK_ROWS", rows), ("BUCKET", bucket)):
        monkeypatch.setattr(minhash, name, value)
    monkeypatch.setattr(streams, "SMALL_ROWS", few)
    rows = near_texts(percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash"))
    sets = {i: shingles_of(t) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = minhash.near_duplicates(docs, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_minhash_large_groups_of_unlike_texts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET", 5)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    monkeypatch.setattr(minhash, "ERRORS", 60.0)  # so that buckets give large clusters
    rng = random.Random(8)
    phrase = "the same five words here"
    rows = [(i, f"{phrase} " + " ".join(rng.choice("abcdefgh") * 3 + str(i // 3) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(100 + i, " ".join([f"w{j}" for j in range(100)] + [f"own{i}"])) for i in range(12)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    sets = {i: shingles_of(t) for i, t in rows}
    assert got == components(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])


def test_blocks_meet_two_by_two(spark, monkeypatch):
    """Every pair of rows of a group meets in some task or is known to be connected."""
    rows = [(1, i, 4, "x") for i in range(40)] + [(2, 100 + i, 1, "x") for i in range(3)]
    table = cut(spark.createDataFrame(rows, "grp long, rep long, blocks long, payload string"))
    odd = {(a, b) for a in range(40) for b in range(a + 1, 40) if (a + b) % 7 == 0 and a % 2 == 0} | {(100, 102)}

    def forests(batches):
        for frame, starts in streams.groups(batches, ["grp", "block"]):
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                rep, side, part = (frame[c].to_numpy(np.int64)[a:b] for c in ("rep", "side", "part"))
                assert b - a <= 40
                linked = lambda i, others, rep=rep: np.array([(min(rep[i], rep[j]), max(rep[i], rep[j])) in odd for j in others], bool)
                found, forest = minhash.forest_of(np.arange(b - a), side, part, linked)
                labels = minhash._labels(frame.iloc[a:b], forest) if frame["pivot"].iloc[a:b].any() else []
                yield minhash._found([(rep[i], rep[j]) for i, j in found], labels)

    blocks = table.select("grp", "blocks").distinct()
    links = [tuple(r) for r in minhash._block_links(table, ["payload"], forests, blocks, 5).collect()]
    nodes = [r[1] for r in rows]
    assert components(nodes, links) == components(nodes, odd)


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_of_one_structure_have_unlike_hashes(size):
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for x, y in ((word, other), (word + other + other + word, other + word + word + other), (f"one two {word}", f"one two {other}")):
        assert not len(np.intersect1d(shingles.shingle_set(x), shingles.shingle_set(y)))


def test_minhash_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@given(st.text(alphabet="aAb \n\t\x0bZé\x1f", max_size=60))
@settings(max_examples=150, deadline=None)
def test_shingle_sets(text):
    assert len(shingles.shingle_set(text)) == len(shingles_of(text))


def test_shingles_of_very_long_words():
    long = "x" * 200_000
    a, b = shingles.shingle_set(f"{long} a b c d e"), shingles.shingle_set(f"{long[:-1]}y a b c d e")
    assert len(np.intersect1d(a, b)) == 1 and len(a) == len(b) == 2
    assert (shingles.shingle_set(f"A b\n c {long} d") == shingles.shingle_set(f"a  b c {long} D")).all()


def test_sketch_estimates_jaccard():
    rng = np.random.default_rng(0)
    for shared in (50, 300, 900):
        base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
        other = np.sort(np.concatenate((base[:shared], rng.integers(0, 1 << 63, 1000 - shared, dtype=np.uint64) * np.uint64(2) + np.uint64(1))))
        x, y = minhash.registers(np.sort(base)), minhash.registers(other)
        found = minhash.estimate(np.array([((x == y) & (x > 0)).sum()]), np.array([((x > 0) | (y > 0)).sum()]), np.array([1000.0]), np.array([1000.0]))[0]
        assert abs(found - shared / (2000 - shared)) < 0.2


@given(st.lists(st.text(max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_bpe_equals_tiktoken(texts):
    vocab = bpe.vocabulary(RANKS, P.PATTERN)
    coder = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    got = vocab.encode(texts + ODD)
    assert got == [np.array(coder.encode_ordinary(t), "<u4").tobytes() for t in texts + ODD]
    assert [vocab.decode(x) for x in got] == [t.encode() for t in texts + ODD]


def test_bpe_column(spark):
    docs = spark.createDataFrame([(1, "hello"), (2, None), (3, "")], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode_documents(bpe.encode_documents(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    assert got == {1: b"hello", 2: b"", 3: b""}


def test_packing(spark):
    rng = random.Random(2)
    texts = [*ODD, None, *[" ".join(rng.choice(["red", "blue", "ünder", "x1"]) for _ in range(rng.randrange(1, 400))) for _ in range(120)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coder = Tokenizer.from_file(JSON)
    coder.encode_special_tokens = True
    for path, pattern in ((RANKS, P.PATTERN), (JSON, None)):
        got = packing.packed_documents(docs, "doc_id", "text", path, pattern, 256).collect()
        by_doc, by_sequence = defaultdict(dict), defaultdict(list)
        for r in got:
            by_doc[r.doc_id][r.piece] = r
            by_sequence[r.sequence_id].append((r.offset, r.length))
        for i, text in enumerate(texts):
            ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
            own, at = by_doc[i], 0
            for p in range(len(own)):
                r = own[p]
                assert r.start == at and (len(ids) <= 256 or p == 0 or r.length == 256)
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids)
        for parts in by_sequence.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 256
        assert len(by_sequence) <= 1.02 * math.ceil(sum(r.length for r in got) / 256) + 1


def test_packing_numbers_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 3)
    monkeypatch.setattr(packing, "GROUPS", 4)
    rows = cut(spark.createDataFrame([(i, 7 + i % 2, "clash") for i in range(301)], "id long, length long, sequence_id string"))
    got = packing.numbered(rows, rows.groupBy("length").count(), ["id"]).collect()
    assert sorted((r.length, r["rank"]) for r in got) == [(7, i) for i in range(151)] + [(8, i) for i in range(150)]


def test_packing_repeated_rows_and_bad_lengths(spark):
    same = cut(spark.createDataFrame([(1, 100)] * 50, "id long, length long"))
    got = packing.pack(same, ["id"], 256).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 50 and len({r.sequence_id for r in got}) == 25
    with pytest.raises(ValueError, match="length 300"):
        packing.pack(spark.createDataFrame([(1, 300)], "id long, length long"), ["id"], 256)
    assert packing.pack(spark.createDataFrame([], "id long, length long"), ["id"], 256).count() == 0


def brute_secrets(text):
    x = text or ""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(x) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", x) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


SECRETS = [
    None, "", "PassWord = 'abc_def-123' é token: short secret=abcdefgh", "AKIA" + "A" * 16 + "AKIA" + "B" * 12, "😀api_key:\"0123456789abcdef0123456789abcdef\" x", "token: secret: abcdefg",
    "f" * 23 + " " + "f" * 24, "password=" * 3, "token==abcdef", "x" * 50_000 + " api_key=abcdefghij " + "0a" * 5000,
]


def test_secrets_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*SECRETS, SECRETS[2]])], "doc_id long, text string").withColumn("blob", F.lit("clash"))
    got = {r.doc_id: r.s for r in secrets.findings(docs, cut(secrets.scan(docs)), "doc_id").select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    assert got == {i: brute_secrets(t) for i, t in enumerate([*SECRETS, SECRETS[2]])}


def test_ledger_scans_only_unseen_pairs(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(SECRETS)], "doc_id long, text string")
    old = cut(secrets.scan(docs.where("doc_id < 4"), rules=secrets.RULES[:2]))
    # a marked entry shows that the ledger is trusted and not scanned again
    marked = old.withColumn("results", F.transform_values("results", lambda k, v: F.array(F.struct(F.lit(7).alias("start"), F.lit(8).alias("end")))))
    made = secrets.scan(docs, ledger=cut(marked))
    assert made.count() == made.select("blob").distinct().count() == len({t or "" for t in SECRETS})
    got = {r.doc_id: r.s for r in secrets.findings(docs, made, "doc_id").select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    assert got[2].startswith("assign:7:8,access:7:8") and got[9] == brute_secrets(SECRETS[9]) and got[6] == brute_secrets(SECRETS[6])


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a password=abcdef1 b 0123456789abcdef0123456789 c")], "doc_id long, text string")
    found = secrets.joined_back(docs.select("*", secrets.blob_id(F.col("text")).alias("blob")), secrets.scan(docs))
    assert found.select(secrets.redact(F.col("text"), F.col("spans"), "#")).first()[0] == "a # b # c"


CHATS = [
    (1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "<\\| <\\\\| < | \\ <|x"), (1, 2, "as\n%0A<|im_end|>", "\n\n"), (1, 2, "as\n%0A<|im_end|>", "\n\n"),
    (2, None, None, None), (2, 5, "assistant", "é😀"), (2, 7, "assistant", ""), (None, 0, "assistant", "x"), (None, 1, "user", "y"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("leaf", F.lit("clash"))
    out = chat.format_trees(chat.linear_tree(rows, "conv_id", "turn", "role", "text"))
    got = {r.tree: r for r in out.select("tree", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(CHATS, key=lambda r: (r[0] or -9, r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert {k: [(t.role, t.text) for t in r.turns] for k, r in got.items()} == dict(want)
    assert {k: r.loss for k, r in got.items()} == {k: "".join(t for role, t in v if role == "assistant") for k, v in want.items()}


def test_reply_tree_paths_and_ranks(spark):
    nodes = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 3, "user", "c", 0.0), ("t", 5, 77, "user", "orphan", 0.5), ("t", 8, 9, "user", "loop", 0.0), ("t", 9, 8, "user", "loop", 0.0)]
    table = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    every = {r.leaf: [t.text for t in r.turns] for r in chat.format_trees(table).select("leaf", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert every == {2: ["q", "a"], 4: ["q", "b", "c"], 5: ["orphan"]}
    best = chat.format_trees(table, keep=2).collect()
    assert sorted((r.branch, r.leaf) for r in best) == [(1, 4), (2, 2)]
    chain = spark.createDataFrame([("c", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(37)], table.schema)
    assert [len(r.turns) for r in chat.format_trees(chain).select(chat.read_turns(F.col("formatted")).alias("turns")).collect()] == [37]
    assert chat.format_trees(table.limit(0)).count() == 0


def test_url_rules_and_verdicts(spark):
    rows = [(1, "HTTP://WWW.Example.COM/en/a?x=/es/"), (2, "http://example.com/en/b"), (3, "http://a.example.com/fr/"), (4, "http://x.com"), (5, "https://a.net/es/1#y"), (6, "http://b.org/de/1"), (7, None), (8, "no scheme"), (9, ""), (10, "http://notexample.com/en/"), (11, "x://y://z/p"), (12, "https://q.net/de/2")]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1)), "page_id").collect()}
    assert {k: r.rule for k, r in got.items()} == {1: "www.example.com/en/", 2: "example.com/en/", 3: "com/", 4: None, 5: "net/es/", 6: None, 7: None, 8: None, 9: None, 10: "com/", 11: None, 12: None}
    assert (got[1].host, got[1].path, got[1].verdict) == ("www.example.com", "/en/a", "allow")
    assert (got[4].host, got[4].path) == ("x.com", "") and (got[7].host, got[7].path) == ("", "") and (got[11].host, got[11].path) == ("y:", "//z/p")
    assert {r.verdict for r in got.values()} <= {"allow", "block"} and got[2].verdict == got[5].verdict == "block"


def test_url_classifier_learns_and_degenerate_tables(spark):
    train = spark.createDataFrame([(f"h{i}.org", f"/casino/{i}", "block") for i in range(60)] + [(f"h{i}.org", f"/science/{i}", "allow") for i in range(60)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://new.org/casino/x"), (2, "http://new.org/science/y")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages, "page_id", rules=(), labelled=train).collect()}
    assert got == {1: "block", 2: "allow"}
    assert {r.verdict for r in urls.filter_urls(pages, "page_id", rules=(), labelled=train.where("verdict = 'block'")).collect()} == {"block"}
    assert {r.verdict for r in urls.filter_urls(pages, "page_id", rules=()).collect()} == {"allow"}
    assert urls.filter_urls(pages.limit(0), "page_id").count() == 0


def test_url_table_judges_held_out_rows(spark):
    made = cut(urls.labelled_urls(spark).withColumn("page_id", F.monotonically_increasing_id()))
    held = F.pmod(F.xxhash64("host"), F.lit(4)) == 0
    pages = made.where(held).select("page_id", F.concat(F.lit("http://"), "host", "path").alias("url"))
    got = {r.page_id: r for r in urls.filter_urls(pages, "page_id", rules=(), labelled=made.where(~held)).collect()}
    truth = {r.page_id: r for r in made.where(held).collect()}
    assert sum(got[i].verdict == truth[i].verdict for i in truth) > 0.95 * len(truth)
    domains = {d: {r.verdict for r in truth.values() if r.host.endswith("." + d)} for d in urls.DOMAINS}
    assert all(v == {"allow", "block"} for v in domains.values())
    assert all(got[i].verdict == "allow" for i in truth if truth[i].host.startswith(("library.", "www.museum.")))


@pytest.mark.parametrize("fold", [0, 1])
def test_url_classifier_judges_words_it_has_not_seen(spark, fold):
    """Every fourth word is held out, with all its URLs; and pages of made-up words that are none of the table's."""
    made = cut(urls.labelled_urls(spark).withColumn("page_id", F.monotonically_increasing_id()))
    held = F.pmod(F.xxhash64("word"), F.lit(4)) == fold
    unseen = made.where(held & (F.col("path").rlike("/(go|click|r)/") | (F.col("verdict") == "allow")))
    pages = unseen.select("page_id", F.concat(F.lit("http://"), "host", "path").alias("url"))
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages, "page_id", rules=(), labelled=made.where(~held)).collect()}
    by = defaultdict(list)
    for r in unseen.collect():
        by[r.verdict].append(got[r.page_id] == r.verdict)
    assert all(len(x) > 40 and sum(x) >= 0.9 * len(x) for x in by.values()), {k: (sum(x), len(x)) for k, x in by.items()}
    clean = spark.createDataFrame([(i, f"https://{b}{w}.example.{d}/en/{i}") for i, (b, w, d) in enumerate((b, w, d) for b in ("", "m.", "blog.") for w in ("ththst", "rether", "ousheri", "lethion") for d in ("net", "org", "edu"))], "page_id long, url string")
    judged = urls.filter_urls(clean, "page_id", rules=()).collect()
    assert sum(r.verdict == "allow" for r in judged) >= 0.9 * len(judged)


def test_long_and_repeated_urls(spark):
    """A URL of a million characters costs in proportion; repeated rows have a row each."""
    rows = [(1, "http://blog.x.net/" + "abc-d/" * 170_000), (2, "http://a.org/x"), (2, "http://a.org/x")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), "page_id").collect()
    assert sorted((r.page_id, len(r.path)) for r in got) == [(1, 1_020_001), (2, 2), (2, 2)]


def test_packing_reads_long_runs_of_blanks(spark):
    """Two million blanks, line ends, blanks before a word, mixed with the special token: ids of the tokenizers library."""
    texts = [" " * 2_000_000, "\n" * 2_000_000, " " * 1_500_000 + "word", "a" + "\n \t" * 600_000 + "<|endoftext|>" + " " * 1_100_000 + "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in packing.packed_documents(docs, "doc_id", "text", RANKS, P.PATTERN, special=packing.SPECIAL).collect():
        got[r.doc_id].append(r)
    coder = Tokenizer.from_file(JSON)
    for i, text in enumerate(texts):
        ids = np.array([*coder.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert sum(r.length for r in got[i]) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got[i])


def brute_top_k(ids, vectors, own, queries, k):
    out = []
    for o, x in zip(own, queries, strict=True):
        score = vectors @ x
        best = sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if i != o)[:k]
        out += [(int(o), i, -s) for s, i in best]
    return sorted(out)


@pytest.mark.parametrize("sizes", [range(1, 61), [255, 256, 257, 700, 768, 769, 1100], range(2049, 2101, 10), [2816, 4100]])
def test_bounds_of_sorted_lists_equal_brute_force(sizes):
    rng = np.random.default_rng(len(sizes))
    for n in sizes:
        for coarse in (1, 300):  # coarse components give many ties
            vectors = np.floor(256 * rng.normal(size=(n, int(rng.integers(1, 12))))).astype(np.int64) // coarse
            ids = rng.permutation(n)
            own, queries = ids[::9], vectors[::9]
            *got, _ = topk.search((ids, vectors), (own, queries), 5)
            assert sorted(zip(*map(np.ndarray.tolist, got), strict=True)) == brute_top_k(ids, vectors, own, queries, 5)


def test_bounds_end_the_reading_early():
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * rng.normal(size=(6000, 16)) ** 3).astype(np.int64)
    ids = np.arange(6000)
    *got, read = topk.search((ids, vectors), (ids[::50], vectors[::50]), 5)
    assert sorted(zip(*map(np.ndarray.tolist, got), strict=True)) == brute_top_k(ids, vectors, ids[::50], vectors[::50], 5)
    assert read < 0.3 * 120 * vectors.size  # of all entries of all lists, for 120 queries


def test_scores_beyond_doubles_are_exact():
    ids = np.arange(400)
    vectors = np.full((400, 3), 2**28, np.int64)
    vectors[:, 0] += ids  # differences far below what a float32 or, in the score, a double tells
    *got, _ = topk.search((ids, vectors), (ids[:1], vectors[:1]), 3)
    assert got[1].tolist() == [399, 398, 397] and got[2].tolist() == [int(vectors[0] @ vectors[i]) for i in (399, 398, 397)]


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 90)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 16))
    vectors[50:60] = vectors[40:50]  # ties
    vectors[7] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 16), (303, [float("inf")] * 16), (None, [1.0] * 16), (304, [2.0, 2.0])]
    table = spark.createDataFrame(rows, "id long, v array<double>").select("id", topk.whole_numbers(F.col("v")).alias("ints")).withColumn("side", F.lit("clash")).withColumn("block", F.lit("clash"))
    assert topk.top_k(table.limit(0), table, 5).count() == topk.top_k(table, table.limit(0), 5).count() == 0
    got = [tuple(r) for r in topk.top_k(table, table.where("id % 7 = 0"), 5).orderBy("query_id", "rank").collect()]
    ints = {i: np.floor(256 * v).astype(int) for i, v in enumerate(vectors)} | {304: np.array([512, 512] + [0] * 14)}
    want = []
    for q in ints:
        if q % 7 == 0:
            best = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q)[:5]
            want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    assert got == want


@pytest.mark.parametrize("block", [1024, 7])
def test_cross_polytope_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(polytope, "BLOCK", block)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(20, 24))
    vectors = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0, 0.02, 0.05, 0.1, 0.2)])
    rows = [(i, [float(x) for x in v], i % 2 if i % 20 < 15 else None) for i, v in enumerate(vectors)]
    rows += [(500, None, 1), (501, [0.0] * 24, 1), (502, [float("nan")] * 24, 1), (503, [1.0], 0), (504, [1.0], 0), (None, [1.0] * 24, 1)]
    got = {r.vec_id: r for r in polytope.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = [(i, np.array(v), l) for i, v, l in rows if i is not None and v is not None and l is not None and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a, x, l in good for b, y, m in good if a < b and l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98]
    want = components([i for i, _, _ in rows if i is not None], links)
    number = defaultdict(int)
    for a, b in links:
        number[a] += 1
        number[b] += 1
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items() if i is not None} == {i: (number[i], want[i], want[i] == i) for i in want}
    assert got[None].n_links == 0 and len(got) == len(rows)


@pytest.mark.parametrize("hashes", [2, 3])
@pytest.mark.parametrize("width", [24, 64, 256])
def test_near_vectors_meet(hashes, width):
    """Planted pairs at the threshold: all of four thousand meet in a bucket that both fill."""
    rng = np.random.default_rng(width)
    x, z = rng.normal(size=(2, 4000, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    wide = polytope._wide(width)
    a, b = polytope.tops(x, hashes), polytope.tops(y, hashes)
    table, code = polytope._meets(a, b, wide)
    assert (table >= 0).mean() >= 0.9995
    each = np.flatnonzero(table >= 0)
    for side in (a, b):
        assert (polytope.buckets(side, wide)[each, table[each]] == code[each, None]).any(1).all()
    assert (polytope.buckets(a, wide)[:, :, 0] == polytope.homes(a, wide)).all()


def test_cross_polytope_planted_links_and_odd_tables(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 32))
    rows = [(i, [float(v) for v in np.float32(x[i // 3] + (i % 3) * 0.05 * rng.normal(size=32))], i % 2 == 0) for i in range(450)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label boolean").withColumn("kept", F.lit("clash")).withColumn("c", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in polytope.near_duplicates(table).collect()}
    unit = [np.array(v, np.float64) / np.linalg.norm(v) for _, v, _ in rows]
    links = [(a, b) for a in range(450) for b in range(a + 1, 450) if rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.98]
    want = components(range(450), links)
    number = defaultdict(int)
    for a, b in links:
        number[a] += 1
        number[b] += 1
    assert len(links) > 20 and got == {i: (number[i], want[i]) for i in range(450)}
    assert polytope.near_duplicates(table.limit(0)).count() == 0


def test_language_id(spark):
    rng = random.Random(1)
    syllables = {"en": ["the", "ing", "and", "th", "er"], "de": ["ung", "sch", "ein", "der", "ich"], "fr": ["eau", "les", "ou", "ment", "que"], "es": ["ción", "los", "que", "ado", "ñ"]}
    rows = []
    for i in range(400):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(20)), lang))
    odd = [(1000, None, "en"), (1001, "123 !?", "en"), (1002, "", None), (None, "the and thing", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = langid.held_out(F.col("doc_id"))
    got = {r.doc_id: r for r in langid.identify(docs, docs.where(~out)).select("doc_id", "lang_pred", "score", out.alias("held")).collect()}
    truth = {i: lang for i, _, lang in rows}
    assert all(got[i].held == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    held = [i for i in truth if got[i].held]
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.98
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(docs, docs.limit(0)).collect()} == {"und"}


def test_language_id_learns_every_label(spark):
    rng = random.Random(4)
    rows = []
    for n in range(70):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)]
        rows += [(100 * n + i, " ".join(rng.choice(own) for _ in range(12)), f"x{n}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, docs.where("doc_id % 100 > 1")).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_language_id_rows_of_a_machine_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "SIDE_ROWS", 40)

    def counted(x, y, **_):
        assert (y > 0).any() and (y < 0).any() and len(y) < 120
        return np.zeros(x.shape[1] + 1)

    monkeypatch.setattr(langid, "fit_machine", counted)
    rows = [(i, f"word{i % 7} text{i}", f"x{i % 20}") for i in range(400)]
    _, machines = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    assert len(machines) == 20


def b32(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    rows = [(1, "http://a/\r\nb", "same"), (2, None, "same"), (3, "u", None), (4, "u", "😀" * 9), (None, "u", "same"), (9, "u", ""), (9, "u", ""), (5, "u", "WARC/1.1\r\nx: y\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    monkeypatch.setattr(warc, "FILE_RUNS", 1)
    monkeypatch.setattr(warc, "LARGE_BYTES", 30)
    warc.write(pages, str(tmp_path / "w"), "page_id", "url", "html")
    found = warc.read(spark, str(tmp_path / "w")).collect()
    assert not [r for r in found if r.gap is not None]
    last = {"same": 2, "": 9}
    for key, _, html in rows:
        body, r = html or "", next(r for r in found if r.record_id == (None if key is None else str(key)))
        revisit = key is not None and body in last and key != last[body]
        assert (r.record_type, r.refers_to) == (("revisit", str(last[body])) if revisit else ("response", None))
        assert (r.payload_bytes, r.payload_digest) == (len(body.encode()), b32(body.encode()))
        assert revisit or bytes(r.payload) == body.encode()


def test_warc_salvage():
    records = [warc.record("response", str(i), None, b"payload %d" % i * 40, b32(b"payload %d" % i * 40), None, "d") for i in range(8)]
    packed = [warc.member(r) for r in records]
    broken = bytearray(packed[1])
    broken[40] ^= 0xFF
    lying = records[5].replace(b"payload 5payload", b"payload 5pAyload", 1)
    data = packed[0] + bytes(broken) + b"noise" + packed[2] + warc.member(b"") + records[3] + b"\x1f\x8b\x08junk" + records[4] + lying + warc.member(records[6] + records[7])[:-4]
    found = list(warc.salvage(data))
    assert [r[4] for r in found if len(r) > 3] == ["0", "2", "3", "4", "6", "7"]
    gaps = [r for r in found if len(r) == 3]
    covered = sum(b - a for a, b, _ in gaps)
    assert len(gaps) == 3 and covered == len(broken) + 5 + 7 + len(lying) + len(warc.member(records[6] + records[7])) - 4
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"nothing here")) == [(0, 12, "no version line")]


def test_warc_empty_table_and_large_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 9_000_000), (2, "u", "y" * 3_000_000), (3, "u", "z")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"), "page_id", "url", "html")
    assert {r.record_id: r.payload_bytes for r in warc.read(spark, str(tmp_path / "w")).collect()} == {"1": 9_000_000, "2": 3_000_000, "3": 1}
    warc.write(pages.limit(0), str(tmp_path / "none"), "page_id", "url", "html")
    assert warc.read(spark, str(tmp_path / "none")).count() == 0
