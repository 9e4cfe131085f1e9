"""Queries on pair similarity and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import similarity as fn
from pairloom.functions.text import STOP_WORDS, TOKEN, words
from pairloom.operators import lexical, vectors
from pairloom.operators.severity import severity
from pairloom.runtime import cut, table


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each document and the one with the following id."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("doc_b"), F.col("text").alias("text_b"))
    return docs.join(following, "doc_id").select(F.col("doc_id").alias("doc_a"), "doc_b", F.col("text").alias("text_a"), "text_b")


def pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard, Dice, overlap and word trigrams of neighbouring documents."""
    return metrics(_neighbours(spark, d))


def metrics(pairs: DataFrame) -> DataFrame:
    """Jaccard, Dice, overlap and word trigrams of pairs with their texts."""
    scored = pairs.select("doc_a", "doc_b", fn.token_scores("text_a", "text_b", 3).alias("s"))
    return scored.select("doc_a", "doc_b", *[F.round(F.col("s")[n], 6).alias(n) for n in ("jaccard", "dice", "overlap", "ngram")])


def pair_severity(spark: SparkSession, d: str) -> DataFrame:
    """Scaled Jaccard of neighbours and its band."""
    score = fn.sigmoid_scale(fn.jaccard("text_a", "text_b", stop=False))
    return _neighbours(spark, d).select("doc_a", "doc_b", F.round(score, 6).alias("score")).withColumn("severity", severity("score"))


def url_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    """Levenshtein and character n-gram similarity of neighbouring URLs."""
    pages = table(spark, d, "pages").select("page_id", "url")
    following = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    both = pages.join(following, "page_id")
    return both.select("page_id", F.round(fn.levenshtein_similarity("url", "next_url"), 6).alias("levenshtein"), F.round(fn.char_ngram_similarity("url", "next_url", 5), 6).alias("char_ngram"))


def _bags(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bags(table(spark, d, "documents").select(F.col("doc_id").alias("id"), words("text").alias("words")))


def tf_idf_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF cosine of neighbouring documents."""
    bags = _bags(spark, d)
    return lexical.tf_idf_cosine(_neighbours(spark, d).select("doc_a", "doc_b"), bags, lexical.shared_beside(bags)).select("doc_a", "doc_b", F.round("sim", 6).alias("sim"))


def bm25_neighbours(spark: SparkSession, d: str) -> DataFrame:
    bags = _bags(spark, d)
    return lexical.bm25(_neighbours(spark, d).select("doc_a", "doc_b"), bags, lexical.shared_beside(bags)).select("doc_a", "doc_b", F.round("sim", 6).alias("sim"))


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(words("text")).alias("token"))
    return lexical.inverted_search(tokens, ["license", "work", "public", "general"], 25)


def _units(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return vectors.normalised(rows, "embedding").select("id", "unit", "label")


def vector_pooled(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector of each label: length and cosine to the first label's."""
    pooled = cut(vectors.pool(table(spark, d, "embeddings"), "label", "embedding"))
    first = pooled.where("label = 0").select(F.col("pooled").alias("first"))
    return pooled.crossJoin(F.broadcast(first)).select("label", F.round(fn.norm(F.col("pooled")), 6).alias("length"), F.round(fn.cosine(F.col("pooled"), F.col("first")), 6).alias("cosine"))


def vector_knn(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest of every twentieth vector against all, exact."""
    units = cut(_units(spark, d))
    near = vectors.nearest(units.where("id % 20 = 0"), units, 5)
    return near.select("query", "rank", "neighbour", F.round("score", 6).alias("score"))


def vector_knn_other_label(spark: SparkSession, d: str) -> DataFrame:
    """Three nearest of another label, of every twentieth vector."""
    units = cut(_units(spark, d))
    near = vectors.nearest(units.where("id % 20 = 0"), units, 3, 0.0, exclude="label")
    return near.select("query", "rank", "neighbour", F.round("score", 6).alias("score"))


def vector_candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    units = cut(_units(spark, d))
    return vectors.candidate_pairs(vectors.nearest(units.where("id % 20 = 0"), units, 5))


def vector_ivf(spark: SparkSession, d: str) -> DataFrame:
    """Cell index with 16 cells: five nearest of every twentieth vector, in as many cells as a sample needs for a recall of 0.95."""
    units = cut(_units(spark, d))
    placed, centres = vectors.cell_index(units, 16)
    placed, asked = cut(placed), units.where("id % 20 = 0")
    return vectors.probe_search(asked, placed, centres, 5, vectors.enough_probes(asked, placed, centres, 5)).select("query", "rank", "neighbour", F.round("score", 6).alias("score"))


def vector_neighbour_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Cosine, Euclidean and Manhattan of neighbouring vectors."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    a, b = F.col("embedding"), F.col("next")
    return rows.join(following, "vec_id").select("vec_id", F.round(fn.cosine(a, b), 6).alias("cosine"), F.round(fn.euclidean(a, b), 6).alias("euclidean"), F.round(fn.manhattan_similarity(a, b), 6).alias("manhattan"))


def hashing_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Model-free encoding of conversations' turns, as components."""
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), words("text").alias("words"))
    return vectors.hashing_encoder(rows, "key", "words").select("key", "slot", F.round("x", 6).alias("x"))


QUERIES = {f.__name__: f for f in (
    pair_metrics, pair_severity, url_levenshtein, tf_idf_neighbours, bm25_neighbours, keyword_search, vector_pooled, vector_knn, vector_knn_other_label,
    vector_candidate_pairs, vector_ivf, vector_neighbour_metrics, hashing_vectors,
)}

TW = "[" + ", ".join(f"'{x}'" for x in STOP_WORDS) + "]"
PAT = TOKEN.replace("'", "''")
TOK = "regexp_extract_all(lower(coalesce({0}, '')), '" + PAT + "')"
SET = "list_distinct(list_filter(" + TOK + f", lambda x: NOT list_contains({TW}, x)))"
GRAM = "list_distinct(list_transform(range(1, greatest(1, len({0}) - 1)), lambda i: array_to_string({0}[i:i + 2], ' ')))"
NEXT = "n AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.text AS text_a, b.text AS text_b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"
WORDS = "t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS token FROM documents)"


def _j(i: str, n: str, m: str, empty: str) -> str:
    return f"CASE WHEN {n} = 0 AND {m} = 0 THEN {empty} ELSE {i} / greatest(1, {n} + {m} - {i})::DOUBLE END"


UNIT = "u AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
KNN = """WITH {unit}, s AS (SELECT q.id AS query, c.id AS neighbour, list_cosine_similarity(q.v, c.v) AS score FROM u q JOIN u c ON {on} WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, neighbour) AS rank FROM s WHERE score >= {least})"""

SQL = {
    "pair_metrics": f"""WITH {NEXT}, k AS (SELECT doc_a, doc_b, text_a, text_b, {SET.format('text_a')} AS a, {SET.format('text_b')} AS b, {TOK.format('text_a')} AS ta, {TOK.format('text_b')} AS tb FROM n),
        g AS (SELECT *, {GRAM.format('ta')} AS ga, {GRAM.format('tb')} AS gb FROM k), c AS (SELECT *, len(list_intersect(a, b)) AS i, len(a) AS na, len(b) AS nb, len(list_intersect(ga, gb)) AS gi, len(ga) AS gn, len(gb) AS gm FROM g)
        SELECT doc_a, doc_b, round(CASE WHEN text_a = '' OR text_b = '' THEN 0 ELSE {_j('i', 'na', 'nb', '1')} END, 6) AS jaccard,
        round(CASE WHEN na = 0 AND nb = 0 THEN 1 ELSE 2 * i / greatest(1, na + nb)::DOUBLE END, 6) AS dice, round(CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE i / greatest(1, least(na, nb))::DOUBLE END, 6) AS overlap,
        round({_j('gi', 'gn', 'gm', '0')}, 6) AS ngram FROM c""",
    "pair_severity": f"""WITH {NEXT}, k AS (SELECT doc_a, doc_b, list_distinct({TOK.format('text_a')}) AS a, list_distinct({TOK.format('text_b')}) AS b, text_a = '' OR text_b = '' AS blank FROM n),
        j AS (SELECT doc_a, doc_b, CASE WHEN blank THEN 0 ELSE {_j('len(list_intersect(a, b))', 'len(a)', 'len(b)', '1')} END AS s FROM k),
        z AS (SELECT doc_a, doc_b, round(CASE WHEN s <= 0 THEN 0 WHEN s >= 1 THEN 1 ELSE (1 / (1 + exp(-6 * (s - 0.5::DOUBLE))) - 1 / (1 + exp(3.0::DOUBLE))) / (1 / (1 + exp(-3.0::DOUBLE)) - 1 / (1 + exp(3.0::DOUBLE))) END, 6) AS score FROM j)
        SELECT *, CASE WHEN score >= 0.9 THEN 'High' WHEN score >= 0.75 THEN 'Medium' ELSE 'Low' END AS severity FROM z""",
    "url_levenshtein": """WITH n AS (SELECT a.page_id, a.url AS x, b.url AS y FROM pages a JOIN pages b ON b.page_id = a.page_id + 1), g AS (SELECT *,
        list_distinct(list_transform(range(1, greatest(1, length(x) - 3)), lambda i: substr(lower(x), i, 5))) AS gx, list_distinct(list_transform(range(1, greatest(1, length(y) - 3)), lambda i: substr(lower(y), i, 5))) AS gy FROM n)
        SELECT page_id, round(CASE WHEN x = y THEN 1 WHEN x = '' OR y = '' THEN 0 ELSE 1 - levenshtein(x, y) / greatest(1, length(x), length(y))::DOUBLE END, 6) AS levenshtein,
        round(CASE WHEN length(x) < 5 OR length(y) < 5 THEN 0 ELSE len(list_intersect(gx, gy)) / (len(gx) + len(gy) - len(list_intersect(gx, gy)))::DOUBLE END, 6) AS char_ngram FROM g""",
    "tf_idf_neighbours": f"""WITH {NEXT}, {WORDS}, f AS (SELECT id, token, count(*) AS tf FROM t GROUP BY 1, 2), c AS (SELECT count(DISTINCT id) AS n FROM t),
        i AS (SELECT token, ln((1 + n) / (1 + count(*))::DOUBLE) + 1 AS idf FROM f, c GROUP BY token, n), w AS (SELECT id, token, tf * idf AS w FROM f JOIN i USING (token)),
        l AS (SELECT id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1), x AS (SELECT id, token, w / l AS w FROM w JOIN l USING (id)),
        s AS (SELECT a.id AS doc_a, b.id AS doc_b, sum(a.w * b.w) AS sim FROM x a JOIN x b ON b.id = a.id + 1 AND a.token = b.token GROUP BY 1, 2)
        SELECT doc_a, doc_b, round(coalesce(sim, 0), 6) AS sim FROM n LEFT JOIN s USING (doc_a, doc_b)""",
    "bm25_neighbours": f"""WITH {NEXT}, {WORDS}, f AS (SELECT id, token, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT id, sum(tf) AS l FROM f GROUP BY 1), c AS (SELECT count(*) AS n, avg(l) AS m FROM l),
        d AS (SELECT token, count(*) AS df FROM f GROUP BY 1), p AS (SELECT id, token, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m)) AS p FROM f JOIN l USING (id) JOIN d USING (token), c),
        o AS (SELECT id, sum(p) AS o FROM p GROUP BY 1), s AS (SELECT a.id AS doc_a, b.id AS doc_b, sum(b.p) AS s FROM p a JOIN p b ON b.id = a.id + 1 AND a.token = b.token GROUP BY 1, 2)
        SELECT n.doc_a, n.doc_b, round(CASE WHEN o > 0 THEN least(1.0, coalesce(s, 0) / o) ELSE 0 END, 6) AS sim FROM n LEFT JOIN s ON s.doc_a = n.doc_a LEFT JOIN o ON o.id = n.doc_a""",
    "keyword_search": f"WITH {WORDS} SELECT id, count(DISTINCT token) / 4.0::DOUBLE AS score FROM t WHERE token IN ('license', 'work', 'public', 'general') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "vector_pooled": """WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), a AS (SELECT label, i, avg(x) AS x FROM p GROUP BY 1, 2), v AS (SELECT label, list(x ORDER BY i) AS v FROM a GROUP BY 1)
        SELECT v.label, round(sqrt(list_dot_product(v.v, v.v)), 6) AS length, round(least(1, greatest(0, list_cosine_similarity(v.v, f.v))), 6) AS cosine FROM v, v f WHERE f.label = 0""",
    "vector_knn": KNN.format(unit=UNIT, on="q.id <> c.id", least="-1") + " SELECT query, CAST(rank AS INTEGER) AS rank, neighbour, round(score, 6) AS score FROM r WHERE rank <= 5",
    "vector_knn_other_label": KNN.format(unit=UNIT, on="q.label <> c.label", least="0") + " SELECT query, CAST(rank AS INTEGER) AS rank, neighbour, round(score, 6) AS score FROM r WHERE rank <= 3",
    "vector_candidate_pairs": KNN.format(unit=UNIT, on="q.id <> c.id", least="-1") + " SELECT DISTINCT least(query, neighbour) AS doc_a, greatest(query, neighbour) AS doc_b FROM r WHERE rank <= 5",
    "vector_neighbour_metrics": f"""WITH {UNIT} SELECT a.id AS vec_id, round(least(1, greatest(0, list_cosine_similarity(a.v, b.v))), 6) AS cosine, round(list_distance(a.v, b.v), 6) AS euclidean,
        round(1 / (1 + list_sum(list_transform(list_zip(a.v, b.v), lambda x: abs(x[1] - x[2])))), 6) AS manhattan FROM u a JOIN u b ON b.id = a.id + 1""",
    "hashing_vectors": """WITH w AS (SELECT conv_id * 1000 + turn AS key, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM conversations), e AS (SELECT key, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM w),
        p AS (SELECT key, CAST(('0x' || right(sha256(word), 2))::INT & 127 AS BIGINT) AS slot, sum(1 + 0.01::DOUBLE * place) AS x FROM e GROUP BY 1, 2), l AS (SELECT key, sqrt(sum(x * x)) AS l FROM p GROUP BY 1)
        SELECT key, slot, round(x / l, 6) AS x FROM p JOIN l USING (key)""",
}
