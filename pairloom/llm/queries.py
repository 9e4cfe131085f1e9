"""The registered queries of the operators in this folder."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import bpe, chat, codes, langid, minhash, mixing, packing, phrases, polytope, secrets, topk, urls, warc
from pairloom.llm.streams import bounded_batches
from pairloom.runtime import cut, shared_dir, table

def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label linked at cosine 0.98."""
    bounded_batches(spark)
    return polytope.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op4_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector, against all rows."""
    bounded_batches(spark)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.whole_numbers(F.col("embedding")).alias("ints"))
    return topk.top_k(rows, rows.where(F.col("id") % 50 == 0), 5)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, longest rule and verdict."""
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 2048 tokens, packed into sequences.

    The vocabulary is that of byte_bpe_50k.json, read from its ranks, with its special token.
    """
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed_documents(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=packing.SPECIAL)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, the best branch of each formatted and read back."""
    said = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    out = chat.format_trees(chat.linear_tree(rows.unionByName(extra), "conv_id", "turn", "role", "text"), keep=1)
    turns = chat.read_turns(F.col("formatted"))
    back = out.select(F.col("tree").alias("conv_id"), "formatted", turns.alias("turns"), chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(chat.turns_text(F.col("turns")), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text, learnt from the rows not held out."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"))
    judged = langid.identify(docs.select("doc_id", "text"), docs.where(~out))
    return judged.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at Jaccard similarity 0.85 of their five-word shingles."""
    bounded_batches(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every whole text, as digests."""
    bounded_batches(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode_documents(bpe.encode_documents(docs, path, pattern), path, pattern)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: the ledger of a first half of the documents, then what the rest adds to it, joined back to all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    ledger = cut(secrets.scan(docs.where(first)))
    ledger = cut(secrets.scan(docs.where(~first), ledger=ledger))
    found = secrets.findings(docs, ledger, "doc_id")
    number = [secrets.number_of("spans", r.kind).alias(f"n_{r.kind}") for r in secrets.RULES]
    spans = secrets.joined(F.col("spans"))
    return found.select("doc_id", *number, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives in the shared folder, then read back; gaps, if any, are logged in a table beside them."""
    bounded_batches(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder, "page_id", "url", "html")
    found = cut(warc.read(spark, folder).drop("payload"))
    gaps = found.where("gap IS NOT NULL")
    if not gaps.isEmpty():
        gaps.select("file", "offset", "end", "gap").write.parquet(f"{folder}-gaps")
    found = found.where("gap IS NULL")
    return found.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two and three words of each language, with the least doc_id that holds each."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return phrases.collocations(docs, "doc_id", "text", "lang").withColumnRenamed("doc", "first_doc")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and the pieces of it by shard, start and length."""
    rows, pieces = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id", "text", "source")
    return mixing.taken(rows, pieces, "doc_id")


def op13_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of each vector, the error of its label, and a digest of the codebooks."""
    bounded_batches(spark)
    rows, books = codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return codes.with_label_error(rows).select("vec_id", "code", "error", "label_error", F.lit(codes.books_sha256(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cross_polytope": op1_cross_polytope,
    "op4_nra_search": op4_nra_search,
    "op2_url_filter": op2_url_filter,
    "op3_pattern_packing": op3_pattern_packing,
    "op5_chat_format": op5_chat_format,
    "op6_language_id": op6_language_id,
    "op7_minhash": op7_minhash,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_secret_scan": op9_secret_scan,
    "op10_warc": op10_warc,
    "op11_phrases": op11_phrases,
    "op12_mixing": op12_mixing,
    "op13_cover_tree_codes": op13_cover_tree_codes,
}

BASE32 = warc.BASE32
FOUR = ", ".join(f"substr('{BASE32}', ((x >> {5 * (3 - i)}) & 31) + 1, 1)" for i in range(4))
KINDS = {r.kind: (r.pattern.replace("'", "''"), r.group, r.least) for r in secrets.RULES}


def _spans_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of a rule from the pieces between its matches and the matches."""
    return f"""SELECT doc_id, unnest(list_transform(range(1, len(h) + 1), lambda i: {{'s': CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
      'l': length(h[i]), 'j': length(j[i])}})) AS x, {rank} AS rank, '{kind}' AS kind
    FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS h, regexp_extract_all(t, '{pattern}', {group}) AS j FROM d) WHERE len(h) > 0"""


SPANS = " UNION ALL ".join(f"SELECT doc_id, x.s AS s, x.s + x.l AS e, rank, kind FROM ({_spans_sql(i, k, *v)}) WHERE x.j >= {v[2]}" for i, (k, v) in enumerate(KINDS.items()))

#: What the driver's DuckDB runs beside the queries that SQL can express.
SQL: dict[str, str] = {
    "op4_nra_search": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.ints, c.ints), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op1_cross_polytope": r"""
WITH RECURSIVE g AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x
), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1), n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT c.x AS vec_id, coalesce(n.n, 0) AS n_links, component_id, c.x = component_id AS kept FROM c LEFT JOIN n ON n.x = c.x
""",
    "op7_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS x FROM s), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), k AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
""",
    "op9_secret_scan": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({SPANS}), g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM f GROUP BY 1
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
""",
    "op10_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS last, sha1(h) AS sha FROM p), b AS (
  SELECT page_id, last, strlen(h) AS payload_bytes, array_to_string(list_transform(list_transform(range(8), lambda i: ('0x' || substr(sha, CAST(1 + 5 * i AS INTEGER), 5))::INTEGER), lambda x: concat({FOUR})), '') AS payload_digest FROM m
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM b
""",
    "op5_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS body,
    replace(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '%', '%25'), chr(10), '%0A') AS head FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + length(head) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op11_phrases": r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT doc_id, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT doc_id, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT doc_id, lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS n, min(doc_id) AS doc FROM g GROUP BY 1, 2, 3),
t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
e AS (SELECT lang, phrase, n, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:len(w)], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
x AS (SELECT e.lang, e.phrase, e.n AS a, j, l.n AS l, r.n AS r, CAST(CAST(1000000 AS HUGEINT) * e.n * e.n // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
  FROM e JOIN f l ON l.lang = e.lang AND l.phrase = lp JOIN f r ON r.lang = e.lang AND r.phrase = rp),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
h AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, n FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), n FROM c WHERE k = 3),
m AS (SELECT lang, phrase, max(n) AS longer FROM h GROUP BY 1, 2),
z AS (SELECT y.*, row_number() OVER (PARTITION BY y.lang ORDER BY score DESC, a DESC, y.phrase) AS rank FROM y LEFT JOIN m ON m.lang = y.lang AND m.phrase = y.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT z.lang, rank, z.phrase, a, l, r, t.n, score, f.doc AS first_doc FROM z JOIN t ON t.lang = z.lang JOIN f ON f.lang = z.lang AND f.phrase = z.phrase WHERE rank <= 2000
""",
    "op13_cover_tree_codes": r"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (SELECT vec_id, part, v[1 + part * (len(v) // 16):(part + 1) * (len(v) // 16)] AS v FROM k, (SELECT unnest(range(16)) AS part)),
o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k),
b0 AS (SELECT part, e, v FROM p JOIN o USING (vec_id) WHERE e < 64),
a0 AS (SELECT p.vec_id, p.part, p.v, min(CAST(list_sum(list_transform(list_zip(p.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) * 64 + b.e) AS x FROM p JOIN b0 b ON b.part = p.part GROUP BY ALL),
u0 AS (SELECT part, x % 64 AS e, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS y FROM a0),
m0 AS (SELECT part, e, i, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS y FROM u0 GROUP BY 1, 2, 3),
n0 AS (SELECT part, e, list(y ORDER BY i) AS v FROM m0 GROUP BY 1, 2),
b1 AS (SELECT b0.part, b0.e, coalesce(n0.v, b0.v) AS v FROM b0 LEFT JOIN n0 ON n0.part = b0.part AND n0.e = b0.e),
a1 AS (SELECT p.vec_id, p.part, p.v, min(CAST(list_sum(list_transform(list_zip(p.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) * 64 + b.e) AS x FROM p JOIN b1 b ON b.part = p.part GROUP BY ALL),
u1 AS (SELECT part, x % 64 AS e, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS y FROM a1),
m1 AS (SELECT part, e, i, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS y FROM u1 GROUP BY 1, 2, 3),
n1 AS (SELECT part, e, list(y ORDER BY i) AS v FROM m1 GROUP BY 1, 2),
b2 AS (SELECT b1.part, b1.e, coalesce(n1.v, b1.v) AS v FROM b1 LEFT JOIN n1 ON n1.part = b1.part AND n1.e = b1.e),
a2 AS (SELECT p.vec_id, p.part, p.v, min(CAST(list_sum(list_transform(list_zip(p.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) * 64 + b.e) AS x FROM p JOIN b2 b ON b.part = p.part GROUP BY ALL),
c AS (SELECT vec_id, string_agg(lower(printf('%02x', x % 64)), '' ORDER BY part) AS code, CAST(sum(x // 64) AS BIGINT) AS error FROM a2 GROUP BY 1),
d AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2)
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k ON k.vec_id = c.vec_id, d
""",
}
