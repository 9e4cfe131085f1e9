"""The registered queries and the pipeline at the smallest scale."""

import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from pairloom.llm import packing, queries
from pairloom.runtime import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.SQL[name])
    names = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert Counter(map(str, map(tuple, df.select(*names).collect()))) == Counter(map(str, found.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_a_row_for_each_row(spark, name):
    made = queries.QUERIES[name](spark, SF)
    source = {"1": "embeddings", "2": "pages", "6": "documents", "7": "documents", "8": "documents", "9": "documents", "10": "pages", "12": "documents"}.get(name[2:].partition("_")[0])
    assert made.count() > 0 if source is None else made.count() == table(spark, SF, source).count()


def test_language_of_held_out_documents(spark):
    got = queries.op6_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_packing_of_documents_is_tight(spark):
    """Every document's ids are those of the tokenizers library, and hardly a sequence is more than the tokens need."""
    got = queries.op3_pattern_packing(spark, SF).collect()
    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    parts, ends, total = {}, {}, 0
    for r in got:
        parts.setdefault(r.doc_id, {})[r.piece] = r
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d in table(spark, SF, "documents").collect():
        ids, at = np.array([*coder.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in (parts[d.doc_id][i] for i in range(len(parts[d.doc_id]))):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes())) and r.length <= 2048
            at += r.length
        assert at == len(ids)
        total += at
    for places in ends.values():
        ordered = sorted(places)
        assert [a for a, _ in ordered] == [0, *np.cumsum([n for _, n in ordered])[:-1].tolist()] and sum(n for _, n in ordered) <= 2048
    assert len(ends) <= -(-total // 2048) + 2


def test_urls_equal_brute_force(spark):
    """Host, path and rule of every page; the rule's verdict where there is one."""
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    pages = {r.page_id: r.url for r in table(spark, SF, "pages").collect()}
    for r in queries.op2_url_filter(spark, SF).collect():
        url = pages[r.page_id]
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
            host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
            path = rest[: min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
        fits = [(len(t), t, v) for t, v in rules if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")


def test_session_settings_stay(spark):
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    for name in ("op1_cross_polytope", "op8_byte_bpe", "op10_warc"):
        queries.QUERIES[name](spark, SF).count()
    after = {r.key: r.value for r in spark.sql("SET").collect()}
    changed = {k for k in after if after[k] != before.get(k)}
    assert changed <= {"spark.sql.execution.arrow.maxBytesPerBatch"}


def test_pipeline(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        assert name == "pattern_packing" or docs.columns == columns
    deduped = kept["minhash_near_dedup"]
    assert kept["language_id"].count() >= deduped.count() == deduped.select("text").distinct().count()
    assert kept["secret_scan"].count() == deduped.count()
    assert kept["pattern_packing"].select("doc_id").distinct().count() == deduped.count()
    assert "pipeline" in entry.queries()
    assert corpus_pipeline.run(spark, SF).count() == kept["pattern_packing"].count()


def test_pipeline_of_odd_rows(spark):
    rows = [(1, "password=abcdef12 the and of", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "12 34", "en", "s", 5), (None, "the words of it", "en", "s", 15)]
    docs = spark.createDataFrame(rows, table(spark, SF, "documents").schema)
    left = corpus_pipeline.language_id(spark, docs, SF)
    assert {r.doc_id for r in left.collect()} == {1, None}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, left, SF).collect()} == {1, None}
    clean = {r.doc_id: r for r in corpus_pipeline.secret_scan(spark, left, SF).collect()}
    assert clean[1].text == "[REDACTED] the and of" and clean[1].n_chars == 21 and clean[None].n_chars == 15
    assert corpus_pipeline.pattern_packing(spark, docs.limit(0), SF).count() == 0


def test_pipeline_keeps_unlabelled_documents(spark):
    rows = [(1, "no label here", None, "s", 13), (2, "ein Text", None, "s", 8), (3, "12 34", None, "s", 5), (4, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, table(spark, SF, "documents").schema)
    assert {(r.doc_id, r.lang) for r in corpus_pipeline.language_id(spark, docs, SF).collect()} == {(1, "und"), (2, "und")}
    held = [(i, "a held out text", "en", "s", 15) for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(held, docs.schema), SF).collect()
    assert len(kept) == len(held) > 0 and {r.lang for r in kept} == {"en"}


def test_packing_queries_match_special_tokens(spark, tmp_path):
    texts = ["say <|endoftext|> now", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n b", "<|endoftext", "no token"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], table(spark, SF, "documents").schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for i, t in enumerate(texts):
        ids = [*coder.encode(t, add_special_tokens=False).ids, 0]
        want[i] = len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
    assert {r.doc_id: (r.length, r.ids_crc32) for r in queries.op3_pattern_packing(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: (r.length, r.ids_crc32) for r in corpus_pipeline.pattern_packing(spark, docs, str(tmp_path)).collect()} == want
    ids = docs.select("doc_id", packing.token_ids(F.col("text"), P.path("byte_bpe_50k.json"), special=packing.SPECIAL).alias("ids")).collect()
    assert {r.doc_id: (len(r.ids) // 4, zlib.crc32(r.ids)) for r in ids} == want
