"""Queries that search all documents for the best of each twentieth, and on evidence for similar pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions import similarity as fn
from pairloom.functions.text import count_words, ngrams, words
from pairloom.operators import evidence, graph, hybrid, lexical, search, vectors
from pairloom.plans import similarity as sim_plans
from pairloom.plans.extras import W
from pairloom.plans.pairs import SQL as PAIR_SQL
from pairloom.plans.pairs import near_copies_word_jaccard
from pairloom.plans.similarity import NEXT, UNIT, WORDS
from pairloom.plans.structure import RANKED as RANKS
from pairloom.plans.structure import _pairs
from pairloom.plans.writing import SQL as WRITING_SQL
from pairloom.plans.writing import style_deviation
from pairloom.runtime import cut, table

#: Best matches of a query, terms of the vocabulary of hybrid scores, and the weight of vectors in them.
K, TERMS, DENSE = 5, 5000, 0.7
CHUNK, MATCHED = 50, 0.5
#: Distance up to which two texts count as one author's, and what a unit of it takes from the confidence.
SAME_AUTHOR, PER_UNIT = 3.5, 18.0
CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(words("text")).alias("token"))


def _asked(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id") % 20 == 0)


def tf_idf_top(spark: SparkSession, d: str) -> DataFrame:
    """The five documents of highest TF-IDF cosine of every twentieth, of all."""
    docs = cut(search.gathered(lexical.tf_idf(_tokens(spark, d)), "weight"))
    return search.top_k(_asked(docs), docs, K).select("query", "rank", "id", F.round("score", 6).alias("score"))


def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    """The five best documents by BM25 for the distinct words of every twentieth, as a share of its score of itself."""
    parts = lexical.bm25_parts(_tokens(spark, d))
    docs = cut(search.gathered(parts, "part"))
    own = parts.groupBy("id").agg(F.sum("part").alias("own"))
    asked = _asked(docs).join(own, "id").withColumn("weights", F.transform("weights", lambda _: 1 / F.col("own")))
    return search.top_k(asked, docs, K).select("query", "rank", "id", F.round(F.least("score", F.lit(1.0)), 6).alias("score"))


def hybrid_top(spark: SparkSession, d: str) -> DataFrame:
    """The five best by vectors and TF-IDF of words and pairs of words, within the most frequent terms, of every twentieth document."""
    own = words("text")
    docs = table(spark, d, "documents")
    terms = cut(docs.select(F.col("doc_id").alias("id"), F.explode(F.concat(own, ngrams(own, 2))).alias("token")))
    frequent = terms.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(TERMS).select("token")
    weights = search.gathered(lexical.tf_idf(terms.join(F.broadcast(frequent), "token")), "weight")  # at most TERMS rows
    units = vectors.normalised(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "embedding").select("id", "unit")
    both = cut(docs.select(F.col("doc_id").alias("id")).join(weights, "id", "left").join(units, "id", "left"))
    return search.top_k(_asked(both), both, K, DENSE).select("query", "rank", "id", F.round("score", 6).alias("score"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """For every twentieth vector the twenty best of all documents and vectors, by cosine and by words of a query that a document has."""
    hits = lexical.inverted_search(_tokens(spark, d), ["license", "work", "public", "general"], None).select("id", F.array(F.lit(1).cast("long")).alias("tokens"), F.array("score").alias("weights"))
    units = vectors.normalised(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "embedding").select("id", "unit")
    rows = cut(units.join(hits, "id", "full"))
    asked = _asked(units).select("id", "unit", F.array(F.lit(1).cast("long")).alias("tokens"), F.array(F.lit(1.0)).alias("weights"))
    best = search.top_k(asked, rows, 20, 0.6)
    kind = F.when(F.col("tokens").isNull(), "vector").when(F.col("unit").isNull(), "text").otherwise("both")
    return best.join(rows.select("id", kind.alias("kind")), "id").select("query", "rank", "id", F.round("score", 6).alias("score"), "kind")


def cross_language_top(spark: SparkSession, d: str) -> DataFrame:
    """Three nearest vectors among documents of another language, of every twentieth document."""
    lang = table(spark, d, "documents").where("lang IS NOT NULL").select(F.col("doc_id").alias("id"), "lang")
    units = vectors.normalised(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "embedding").select("id", "unit")
    rows = cut(units.join(lang, "id"))
    return vectors.nearest(_asked(rows), rows, 3, 0.0, exclude="lang").select("query", "rank", "neighbour", F.round("score", 6).alias("score"))


def _alike(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the similarity join with their texts."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    a, b = docs.select(F.col("doc_id").alias("doc_a"), F.col("text").alias("text_a")), docs.select(F.col("doc_id").alias("doc_b"), F.col("text").alias("text_b"))
    return cut(near_copies_word_jaccard(spark, d).select("doc_a", "doc_b").join(a, "doc_a").join(b, "doc_b"))


def copy_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard, Dice, overlap and word trigrams of the pairs of the similarity join."""
    return sim_plans.metrics(_alike(spark, d))


def copy_tf_idf(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF cosine of the pairs of the similarity join; 0 below the tenth percentile of all."""
    pairs, bags = cut(near_copies_word_jaccard(spark, d).select("doc_a", "doc_b")), sim_plans._bags(spark, d)
    made = lexical.tf_idf_cosine(pairs, bags, lexical.shared_by(pairs, bags)).select("doc_a", "doc_b", F.round("sim", 6).alias("sim"))
    return hybrid.percentile_filter(made, 10)


def copy_bm25(spark: SparkSession, d: str) -> DataFrame:
    """BM25 of the pairs of the similarity join, scaled to its range."""
    pairs, bags = cut(near_copies_word_jaccard(spark, d).select("doc_a", "doc_b")), sim_plans._bags(spark, d)
    made = lexical.bm25(pairs, bags, lexical.shared_by(pairs, bags))
    return hybrid.normalised_scores(made, "sim").select("doc_a", "doc_b", F.round("sim", 4).alias("sim"))


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", words("text").alias("w"))
    pairs = cut(near_copies_word_jaccard(spark, d).select("doc_a", "doc_b"))
    return pairs, evidence.chunk_pairs(pairs, docs, "doc_id", "w", CHUNK), docs.select(F.col("doc_id").alias("doc_a"), F.size("w").alias("words"))


def chunk_best_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The three best pairs of chunks of each similar pair, from 0.5."""
    return evidence.best_chunk_pairs(_scored(spark, d)[1]).select("doc_a", "doc_b", "rank", "chunk_a", "chunk_b", F.round("sim", 6).alias("sim"))


def pair_flags(spark: SparkSession, d: str) -> DataFrame:
    """Similar pairs flagged by their best chunks, with evidence and coverage."""
    made = evidence.flags(*_scored(spark, d))
    return made.select("doc_a", "doc_b", F.round("sim", 6).alias("sim"), "severity", "matched", F.round("coverage", 6).alias("coverage"), "evidence", "flagged")


def copy_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Shared and own words of similar pairs, shared trigrams, and multisets of words."""
    docs = table(spark, d, "documents").select("doc_id", words("text").alias("w"))
    return evidence.vocabularies_of(near_copies_word_jaccard(spark, d), docs, "doc_id", "w")


def citation_shared(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents that cite parts: those with two or more parts in common, and the Jaccard similarity of their lists."""
    cited = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("work"))
    return evidence.shared_citations(cited).select("doc_a", "doc_b", "shared", F.round("jaccard", 6).alias("jaccard"))


def vector_compacted(spark: SparkSession, d: str) -> DataFrame:
    """New ids from 0 of the vectors that stay when label 0 goes."""
    return evidence.compacted(table(spark, d, "embeddings").where("label <> 0").select("vec_id"), "vec_id").select("vec_id", F.col("place").cast("long").alias("place"))


def style_authorship(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document may be by the author of its source's mean profile, by distance, and how sure that is."""
    away = F.col("deviation")
    made = style_deviation(spark, d).select("doc_id", "source", "deviation", (away <= SAME_AUTHOR).alias("same_author"), F.greatest(F.lit(0.0), F.round(100 - away * PER_UNIT, 2)).alias("confidence"))
    return made.withColumn("trait", F.when(away <= 2.0, "function words").otherwise("sentence length and vocabulary"))


def graph_centrality(spark: SparkSession, d: str) -> DataFrame:
    """Degree, degree centrality and PageRank of every linked document."""
    pairs = _pairs(spark, d)
    return graph.degree_centrality(pairs).join(graph.page_rank(pairs), "doc").select("doc", "degree", "centrality", F.round("rank", 6).alias("rank"))


def text_reading_time(spark: SparkSession, d: str) -> DataFrame:
    """Minutes at 200 words a minute, at least 0.1; CJK characters count as words."""
    cjk = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(CJK))
    n = cjk + count_words(F.regexp_replace(F.coalesce("text", F.lit("")), CJK, " "))
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("words"), F.greatest(F.lit(0.1), F.round(n / 200, 1)).alias("minutes"))


def text_language_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The language whose hundred most frequent words a document's distinct words overlap most, as a share of them."""
    rows = table(spark, d, "documents").select("doc_id", "lang", F.explode(words("text")).alias("w"))
    counts = rows.where("lang IS NOT NULL").groupBy("lang", "w").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    known = cut(counts.withColumn("place", place).where("place <= 100").select("lang", "w"))
    own = cut(rows.select("doc_id", "w").distinct())
    size = own.groupBy("doc_id").agg(F.count("*").alias("size"))
    hits = own.join(F.broadcast(known), "w").groupBy("doc_id", "lang").agg(F.count("*").alias("hits"))  # a hundred rows a language
    best = hits.groupBy("doc_id").agg(F.min_by("lang", F.struct(-F.col("hits"), F.col("lang"))).alias("language"), F.max("hits").alias("hits"))
    made = table(spark, d, "documents").select("doc_id").join(size, "doc_id", "left").join(best, "doc_id", "left")
    share = F.when(F.col("size") > 0, F.coalesce("hits", F.lit(0)) / F.col("size")).otherwise(0.0)
    return made.select("doc_id", F.coalesce("language", F.lit("unknown")).alias("language"), F.round(share, 6).alias("overlap"))


QUERIES = {f.__name__: f for f in (
    tf_idf_top, bm25_top, hybrid_top, hybrid_search, cross_language_top, copy_metrics, copy_tf_idf, copy_bm25, chunk_best_pairs, pair_flags, copy_vocabulary, citation_shared,
    vector_compacted, style_authorship, graph_centrality, text_reading_time, text_language_overlap,
)}

ALIKE = f"n AS (SELECT p.doc_a, p.doc_b, a.text AS text_a, b.text AS text_b FROM ({PAIR_SQL['near_copies_word_jaccard']}) p JOIN documents a ON a.doc_id = doc_a JOIN documents b ON b.doc_id = doc_b)"
RANKED = "row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id)"
UNITS = UNIT.replace("u AS", "u0 AS") + ", u AS (SELECT id, v FROM u0)"
TF = """f AS (SELECT id, token, count(*) AS tf FROM t GROUP BY 1, 2), c AS (SELECT count(DISTINCT id) AS n FROM t), i AS (SELECT token, ln((1 + n) / (1 + count(*))::DOUBLE) + 1 AS idf FROM f, c GROUP BY token, n),
        w AS (SELECT id, token, tf * idf AS w FROM f JOIN i USING (token)), l AS (SELECT id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1), x AS (SELECT id, token, w / l AS w FROM w JOIN l USING (id))"""
BM = """f AS (SELECT id, token, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT id, sum(tf) AS l FROM f GROUP BY 1), c AS (SELECT count(*) AS n, avg(l) AS m FROM l), d AS (SELECT token, count(*) AS df FROM f GROUP BY 1),
        p AS (SELECT id, token, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m)) AS p FROM f JOIN l USING (id) JOIN d USING (token), c), o AS (SELECT id, sum(p) AS o FROM p GROUP BY 1)"""
CHUNKS = f"""{ALIKE}, w AS (SELECT doc_id, {W} AS w FROM documents), k0 AS (SELECT doc_id, w, unnest(range(0, (len(w) + {CHUNK - 1}) // {CHUNK})) AS chunk FROM w), k AS (SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, list_distinct(w[{CHUNK} * chunk + 1:{CHUNK} * chunk + {CHUNK}]) AS own, len(w[{CHUNK} * chunk + 1:{CHUNK} * chunk + {CHUNK}]) AS n FROM k0),
        s0 AS (SELECT n.doc_a, n.doc_b, a.chunk AS chunk_a, b.chunk AS chunk_b, a.n AS n, len(list_intersect(a.own, b.own)) AS i, len(a.own) AS x, len(b.own) AS y FROM n JOIN k a ON a.doc_id = n.doc_a JOIN k b ON b.doc_id = n.doc_b),
        s AS (SELECT *, i / (x + y - i)::DOUBLE AS sim FROM s0 WHERE i > 0)"""

SQL = {
    "tf_idf_top": f"""WITH {WORDS}, {TF}, s AS (SELECT a.id AS query, b.id AS id, sum(a.w * b.w) AS score FROM x a JOIN x b ON a.token = b.token AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY 1, 2), r AS (SELECT *, {RANKED} AS rank FROM s)
        SELECT query, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM r WHERE rank <= {K}""",
    "bm25_top": f"""WITH {WORDS}, {BM}, s AS (SELECT a.id AS query, b.id AS id, sum(b.p) / any_value(o) AS score FROM p a JOIN o ON o.id = a.id JOIN p b ON a.token = b.token AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY 1, 2), r AS (SELECT *, {RANKED} AS rank FROM s)
        SELECT query, CAST(rank AS INTEGER) AS rank, id, round(least(1.0, score), 6) AS score FROM r WHERE rank <= {K}""",
    "hybrid_top": f"""WITH w0 AS (SELECT doc_id AS id, {W} AS w FROM documents), t0 AS (SELECT id, unnest(list_concat(w, list_transform(range(1, greatest(1, len(w))), lambda i: w[i] || ' ' || w[i + 1]))) AS token FROM w0),
        v AS (SELECT token FROM t0 GROUP BY 1 ORDER BY count(*) DESC, token LIMIT {TERMS}), t AS (SELECT id, token FROM t0 JOIN v USING (token)), {TF}, {UNITS},
        k AS (SELECT a.id AS query, b.id AS id, sum(a.w * b.w) AS k FROM x a JOIN x b ON a.token = b.token WHERE a.id % 20 = 0 GROUP BY 1, 2), m AS (SELECT q.id AS query, u.id AS id, greatest(0, list_cosine_similarity(q.v, u.v)) AS m FROM u q JOIN documents e ON e.doc_id = q.id, u JOIN documents g ON g.doc_id = u.id WHERE q.id % 20 = 0),
        s AS (SELECT coalesce(k.query, m.query) AS query, coalesce(k.id, m.id) AS id, (1 - {DENSE}::DOUBLE) * coalesce(k, 0) + {DENSE}::DOUBLE * coalesce(m, 0) AS score FROM k FULL JOIN m ON k.query = m.query AND k.id = m.id),
        r AS (SELECT *, {RANKED} AS rank FROM s WHERE query <> id AND score > 0) SELECT query, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM r WHERE rank <= {K}""",
    "hybrid_search": f"""WITH {WORDS}, h AS (SELECT id, count(DISTINCT token) / 4.0::DOUBLE AS t FROM t WHERE token IN ('license', 'work', 'public', 'general') GROUP BY 1), {UNITS}, a AS (SELECT coalesce(u.id, h.id) AS id, v, t FROM u FULL JOIN h ON u.id = h.id),
        s AS (SELECT q.id AS query, a.id, 0.6::DOUBLE * coalesce(greatest(0, list_cosine_similarity(a.v, q.v)), 0) + 0.4::DOUBLE * coalesce(t, 0) AS score, CASE WHEN t IS NULL THEN 'vector' WHEN a.v IS NULL THEN 'text' ELSE 'both' END AS kind FROM u q, a WHERE q.id % 20 = 0 AND q.id <> a.id),
        r AS (SELECT *, {RANKED} AS rank FROM s WHERE score > 0) SELECT query, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score, kind FROM r WHERE rank <= 20""",
    "cross_language_top": f"""WITH {UNITS}, g AS (SELECT u.id, v, lang FROM u JOIN documents ON doc_id = u.id WHERE lang IS NOT NULL), s AS (SELECT q.id AS query, c.id, list_cosine_similarity(q.v, c.v) AS score FROM g q JOIN g c ON q.lang <> c.lang WHERE q.id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, id) AS rank FROM s WHERE score >= 0) SELECT query, CAST(rank AS INTEGER) AS rank, id AS neighbour, round(score, 6) AS score FROM r WHERE rank <= 3""",
    "copy_metrics": sim_plans.SQL["pair_metrics"].replace(NEXT, ALIKE),
    "copy_tf_idf": f"""WITH {ALIKE}, {WORDS}, {TF}, s AS (SELECT n.doc_a, n.doc_b, sum(a.w * b.w) AS sim FROM n JOIN x a ON a.id = n.doc_a JOIN x b ON b.id = n.doc_b AND a.token = b.token GROUP BY 1, 2), z AS (SELECT n.doc_a, n.doc_b, round(coalesce(sim, 0), 6) AS sim FROM n LEFT JOIN s USING (doc_a, doc_b)),
        q AS (SELECT quantile_cont(sim, 0.1) AS q FROM z) SELECT doc_a, doc_b, CASE WHEN sim >= q THEN sim ELSE 0 END AS sim FROM z, q""",
    "copy_bm25": f"""WITH {ALIKE}, {WORDS}, {BM}, s AS (SELECT n.doc_a, n.doc_b, sum(b.p) AS s FROM n JOIN p a ON a.id = n.doc_a JOIN p b ON b.id = n.doc_b AND a.token = b.token GROUP BY 1, 2),
        z AS (SELECT n.doc_a, n.doc_b, CASE WHEN o > 0 THEN least(1.0, coalesce(s, 0) / o) ELSE 0 END AS sim FROM n LEFT JOIN s USING (doc_a, doc_b) LEFT JOIN o ON o.id = n.doc_a), q AS (SELECT min(sim) AS lo, max(sim) AS hi FROM z)
        SELECT doc_a, doc_b, round(CASE WHEN hi > lo THEN (sim - lo) / (hi - lo) ELSE 0 END, 4) AS sim FROM z, q""",
    "chunk_best_pairs": f"""WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_a, doc_b ORDER BY round(sim, 9) DESC, chunk_a, chunk_b) AS rank FROM s WHERE sim >= {MATCHED})
        SELECT doc_a, doc_b, CAST(rank AS INTEGER) AS rank, chunk_a, chunk_b, round(sim, 6) AS sim FROM r WHERE rank <= 3""",
    "pair_flags": f"""WITH {CHUNKS}, b AS (SELECT doc_a, doc_b, chunk_a, max(sim) AS sim, any_value(n) AS n, arg_min(chunk_b, -round(sim, 9) * 1000000 + chunk_b / 1000000::DOUBLE) AS chunk_b FROM s GROUP BY 1, 2, 3),
        g AS (SELECT doc_a, doc_b, max(sim) AS sim, count(*) FILTER (sim >= {MATCHED}) AS matched, coalesce(sum(n) FILTER (sim >= {MATCHED}), 0) AS covered, arg_min(chunk_a || ':' || chunk_b, -round(sim, 9) * 1000000 + chunk_a / 1000000::DOUBLE) AS evidence FROM b GROUP BY 1, 2)
        SELECT n.doc_a, n.doc_b, round(coalesce(sim, 0), 6) AS sim, CASE WHEN coalesce(sim, 0) >= 0.9 THEN 'High' WHEN coalesce(sim, 0) >= 0.75 THEN 'Medium' ELSE 'Low' END AS severity, coalesce(matched, 0) AS matched,
        round(CASE WHEN len(w) > 0 THEN coalesce(covered, 0) / len(w)::DOUBLE ELSE 0 END, 6) AS coverage, coalesce(evidence, '') AS evidence, coalesce(matched, 0) > 0 AS flagged FROM n LEFT JOIN g USING (doc_a, doc_b) LEFT JOIN w ON w.doc_id = n.doc_a""",
    "copy_vocabulary": f"""WITH {ALIKE}, w AS (SELECT doc_a, doc_b, {W.replace('text', 'text_a')} AS a, {W.replace('text', 'text_b')} AS b FROM n), c AS (SELECT doc_a, doc_b, x, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS q FROM (SELECT doc_a, doc_b, 0 AS side, unnest(a) AS x FROM w UNION ALL SELECT doc_a, doc_b, 1, unnest(b) FROM w) GROUP BY 1, 2, 3),
        m AS (SELECT doc_a, doc_b, CAST(sum(least(p, q)) AS BIGINT) AS m, CAST(sum(greatest(p, q)) AS BIGINT) AS e, count(*) FILTER (p > 0 AND q > 0) AS s, count(*) FILTER (q = 0) AS oa, count(*) FILTER (p = 0) AS ob FROM c GROUP BY 1, 2)
        SELECT doc_a, doc_b, s AS shared, oa AS only_a, ob AS only_b, len(list_intersect(list_distinct(list_transform(range(1, greatest(1, len(a) - 1)), lambda i: array_to_string(a[i:i + 2], ' '))), list_distinct(list_transform(range(1, greatest(1, len(b) - 1)), lambda i: array_to_string(b[i:i + 2], ' '))))) AS trigrams, m AS both, e AS either FROM w JOIN m USING (doc_a, doc_b)""",
    "citation_shared": """WITH o AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS work FROM lineitem), n AS (SELECT doc, count(*) AS n FROM o GROUP BY 1), m AS (SELECT a.doc AS doc_a, b.doc AS doc_b, count(*) AS shared FROM o a JOIN o b ON a.work = b.work AND a.doc < b.doc GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT doc_a, doc_b, shared, round(shared / (x.n + y.n - shared)::DOUBLE, 6) AS jaccard FROM m JOIN n x ON x.doc = doc_a JOIN n y ON y.doc = doc_b""",
    "vector_compacted": "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings WHERE label <> 0",
    "style_authorship": f"SELECT doc_id, source, deviation, deviation <= {SAME_AUTHOR} AS same_author, greatest(0.0::DOUBLE, round(100 - deviation * {PER_UNIT}::DOUBLE, 2)) AS confidence, CASE WHEN deviation <= 2.0 THEN 'function words' ELSE 'sentence length and vocabulary' END AS trait FROM ({WRITING_SQL['style_deviation']})",
    "graph_centrality": f"{RANKS}, g AS (SELECT doc, count(*) AS degree FROM e GROUP BY 1) SELECT g.doc, degree, round(degree / greatest(1, (SELECT count(*) FROM g) - 1)::DOUBLE, 6) AS centrality, round(rank, 6) AS rank FROM g JOIN r20 USING (doc)",
    "text_reading_time": f"""WITH n AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{CJK}')) + len(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '{CJK}', ' ', 'g')), '[\\p{{L}}\\p{{N}}_]+')) AS n FROM documents)
        SELECT doc_id, n AS words, greatest(0.1::DOUBLE, round(n / 200.0::DOUBLE, 1)) AS minutes FROM n""",
    "text_language_overlap": f"""WITH w AS (SELECT doc_id, lang, unnest({W}) AS w FROM documents), c AS (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS place FROM w WHERE lang IS NOT NULL GROUP BY 1, 2), o AS (SELECT DISTINCT doc_id, w FROM w), z AS (SELECT doc_id, count(*) AS size FROM o GROUP BY 1),
        h AS (SELECT doc_id, c.lang, count(*) AS hits FROM o JOIN c ON c.w = o.w AND place <= 100 GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, lang) AS r FROM h)
        SELECT d.doc_id, coalesce(b.lang, 'unknown') AS language, round(CASE WHEN size > 0 THEN coalesce(hits, 0) / size::DOUBLE ELSE 0 END, 6) AS overlap FROM documents d LEFT JOIN z USING (doc_id) LEFT JOIN b ON b.doc_id = d.doc_id AND r = 1""",
}
