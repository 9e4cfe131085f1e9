"""Queries on merged scores, extraction, change points and further aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions import extract, style, text
from pairloom.functions.text import STOP_WORDS
from pairloom.operators import fingerprints, hybrid
from pairloom.plans import similarity as sim_plans
from pairloom.plans.structure import POS
from pairloom.plans.texts import W
from pairloom.runtime import cut, table


def hybrid_pairs(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF and BM25 of neighbouring documents, each scaled to its range, weighted."""
    a = hybrid.normalised_scores(sim_plans.tf_idf_neighbours(spark, d).withColumnRenamed("sim", "a"), "a")
    b = hybrid.normalised_scores(sim_plans.bm25_neighbours(spark, d).withColumnRenamed("sim", "b"), "b")
    return a.join(b, ["doc_a", "doc_b"]).select("doc_a", "doc_b", F.round(hybrid.hybrid(F.col("a"), F.col("b")), 4).alias("score"))


def hybrid_z_scores(spark: SparkSession, d: str) -> DataFrame:
    made = hybrid.normalised_scores(sim_plans.tf_idf_neighbours(spark, d), "sim", "z")
    return made.select("doc_a", "doc_b", F.round("sim", 4).alias("z"))


def pair_percentile_filter(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.percentile_filter(sim_plans.tf_idf_neighbours(spark, d), 90)


def vector_storage(spark: SparkSession, d: str) -> DataFrame:
    """Vectors, components and bytes by label."""
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"), F.sum(F.size("embedding")).alias("components"), F.sum(F.size("embedding") * 4).alias("bytes"))


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """The JSON property k of events: count, sum and mean by type."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.round(F.avg(k), 6).alias("mean"))


def event_change_points(spark: SparkSession, d: str) -> DataFrame:
    """CUSUM change points of each event type's daily number of events."""
    days = table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").cast("double").alias("n"))
    ordered = days.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("s"))
    points = ordered.select("event_type", F.explode(extract.cusum(F.transform("s", lambda x: x["n"]))).alias("p"))
    return points.select("event_type", "p.at", "p.direction", F.round("p.score", 4).alias("score"))


def text_injections(spark: SparkSession, d: str) -> DataFrame:
    """Turns by number of steering phrases."""
    return table(spark, d, "conversations").groupBy(extract.injection_hits("text").cast("long").alias("phrases")).agg(F.count("*").alias("turns"))


def text_search_queries(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "documents").select("doc_id", F.posexplode(extract.search_queries("text")).alias("number", "q"))
    return q.select("doc_id", "number", "q.query", "q.weight")


def text_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Surroundings of the word license."""
    docs = table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("license")))
    return docs.select("doc_id", extract.snippet("text", ["license", "licence"]).alias("snippet"))


def url_file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", extract.safe_file_name("url").alias("file_name"), extract.natural_key("url").alias("sort_key"))


def text_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citation keys that two or more documents share."""
    keys = table(spark, d, "documents").select("doc_id", F.explode(extract.citation_keys("text")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("documents")).where("documents > 1")


def text_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """The twenty most frequent bigrams of each language."""
    grams = table(spark, d, "documents").select("lang", F.explode(text.ngrams(text.words("text"), 2)).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return grams.withColumn("rank", rank).where("rank <= 20")


def style_patchwriting(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring turns: Dice of the multisets of tag trigrams, and whether it is 0.6 or more."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.transform(text.words("text"), style.pos_tag).alias("tags"))
    grams = cut(rows.select("conv_id", "turn", F.explode(text.ngrams(F.col("tags"), 3)).alias("g")).groupBy("conv_id", "turn", "g").agg(F.count("*").alias("c")))
    total = cut(grams.groupBy("conv_id", "turn").agg(F.sum("c").alias("t")))
    before = lambda df, c: df.select("conv_id", (F.col("turn") + 1).alias("turn"), *[x for x in df.columns if x not in ("conv_id", "turn", c)], F.col(c).alias("before"))
    shared = grams.join(before(grams, "c"), ["conv_id", "turn", "g"]).groupBy("conv_id", "turn").agg(F.sum(F.least("c", "before")).alias("s"))
    both = total.join(before(total, "t"), ["conv_id", "turn"]).join(shared, ["conv_id", "turn"], "left")
    dice = 2 * F.coalesce("s", F.lit(0)) / (F.col("t") + F.col("before"))
    return both.select("conv_id", "turn", F.round(dice, 6).alias("dice"), (dice >= 0.6).alias("patchwriting"))


def table_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Columns of customers and suppliers by kind: shared kinds and closeness of means."""
    a = fingerprints.column_profile(table(spark, d, "customer")).select(F.col("name").alias("a"), "kind", F.col("mean").alias("ma"))
    b = fingerprints.column_profile(table(spark, d, "supplier")).select(F.col("name").alias("b"), "kind", F.col("mean").alias("mb"))
    close = F.when(F.col("ma").isNull() | F.col("mb").isNull(), 1.0).otherwise(1 - F.abs(F.col("ma") - F.col("mb")) / F.greatest(F.abs("ma"), F.abs("mb"), F.lit(1e-9)))
    return a.join(b, "kind").select("a", "b", "kind", F.round(F.greatest(F.lit(0.0), close), 4).alias("closeness"))


QUERIES = {f.__name__: f for f in (
    hybrid_pairs, hybrid_z_scores, pair_percentile_filter, vector_storage, event_properties, event_change_points, text_injections, text_search_queries, text_snippets,
    url_file_names, text_citations, text_bigrams, style_patchwriting, table_similarity,
)}

TF, BM = sim_plans.SQL["tf_idf_neighbours"], sim_plans.SQL["bm25_neighbours"]
STOP = "[" + ", ".join(f"'{x}'" for x in STOP_WORDS) + "]"
HITS = " + ".join("CASE WHEN regexp_matches(t, '" + p.replace("'", "''") + "') THEN 1 ELSE 0 END" for p in extract.INJECTIONS)


def _profile(name: str, columns: tuple[str, ...]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value FROM {name}" for c in columns)
    return f"""SELECT name, CASE WHEN k > 0.8 * f THEN 'numeric' WHEN u < 0.5 * f THEN 'categorical' ELSE 'text' END AS kind, CASE WHEN k > 0.8 * f THEN m END AS mean FROM (
      SELECT name, count(value) AS f, count(DISTINCT value) AS u, count(TRY_CAST(value AS DOUBLE)) AS k, round(avg(TRY_CAST(value AS DOUBLE)), 4) AS m FROM ({rows}) GROUP BY 1)"""


SQL = {
    "event_change_points": """WITH RECURSIVE c AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2),
        o AS (SELECT event_type, n, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, avg(n) OVER (PARTITION BY event_type) AS m, stddev_pop(n) OVER (PARTITION BY event_type) AS s FROM c),
        r AS (SELECT DISTINCT event_type, -1::BIGINT AS i, 0.0::DOUBLE AS s, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM o
          UNION ALL SELECT o.event_type, o.i, o.s, greatest(0.0, CASE WHEN r.up > 2 * r.s THEN 0.0 ELSE r.up END + (n - m) - o.s * 0.5::DOUBLE), greatest(0.0, CASE WHEN r.down > 2 * r.s THEN 0.0 ELSE r.down END - (n - m) - o.s * 0.5::DOUBLE)
          FROM r JOIN o ON o.event_type IS NOT DISTINCT FROM r.event_type AND o.i = r.i + 1)
        SELECT event_type, CAST(i AS INTEGER) AS at, 'increase' AS direction, round(up, 4) AS score FROM r WHERE i >= 0 AND s > 0 AND up > 2 * s UNION ALL SELECT event_type, CAST(i AS INTEGER), 'decrease', round(down, 4) FROM r WHERE i >= 0 AND s > 0 AND down > 2 * s""",
    "hybrid_pairs": f"""WITH a AS ({TF}), b AS ({BM}), x AS (SELECT doc_a, doc_b, (sim - min(sim) OVER ()) / (max(sim) OVER () - min(sim) OVER ()) AS s FROM a), y AS (SELECT doc_a, doc_b, (sim - min(sim) OVER ()) / (max(sim) OVER () - min(sim) OVER ()) AS s FROM b)
        SELECT doc_a, doc_b, round(least(1.0, greatest(0.0, 0.7::DOUBLE * x.s + 0.3::DOUBLE * y.s)), 4) AS score FROM x JOIN y USING (doc_a, doc_b)""",
    "hybrid_z_scores": f"WITH a AS ({TF}) SELECT doc_a, doc_b, round((sim - avg(sim) OVER ()) / stddev_pop(sim) OVER (), 4) AS z FROM a",
    "pair_percentile_filter": f"WITH a AS ({TF}) SELECT doc_a, doc_b, CASE WHEN sim >= (SELECT quantile_cont(sim, 0.9) FROM a) THEN sim ELSE 0 END AS sim FROM a",
    "vector_storage": "SELECT label, count(*) AS vectors, CAST(sum(len(embedding)) AS BIGINT) AS components, CAST(sum(len(embedding) * 4) AS BIGINT) AS bytes FROM embeddings GROUP BY 1",
    "event_properties": "WITH k AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, round(avg(k), 6) AS mean FROM k GROUP BY 1",
    "text_injections": f"WITH t AS (SELECT lower(coalesce(text, '')) AS t FROM conversations) SELECT CAST({HITS} AS BIGINT) AS phrases, count(*) AS turns FROM t GROUP BY 1",
    "text_search_queries": f"""WITH p AS (SELECT doc_id, string_split(lower(regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s.]', '', 'g')), '.') AS p FROM documents), s AS (SELECT doc_id, regexp_replace(unnest(p), '^\\s+|\\s+$', '', 'g') AS s, generate_subscripts(p, 1) AS i FROM p),
        r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY length(s) DESC, i) - 1 AS k FROM s WHERE length(s) > 30), q AS (SELECT doc_id, k, array_to_string(list_filter(string_split_regex(s, '\\s+'), lambda w: NOT list_contains({STOP}, w))[1:7], ' ') AS query FROM r WHERE k < 3)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS number, query, round(1 - 0.1::DOUBLE * k, 1) AS weight FROM q WHERE query <> ''""",
    "text_snippets": """SELECT doc_id, substr(text, greatest(1, least(nullif(instr(lower(text), 'license'), 0), nullif(instr(lower(text), 'licence'), 0)) - 60), 120) AS snippet FROM documents WHERE contains(lower(text), 'license')""",
    "url_file_names": """WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS f, regexp_extract_all(lower(url), '\\d+|\\D+') AS p FROM pages)
        SELECT page_id, CASE WHEN f = '' THEN 'file' ELSE substr(f, 1, 100) END AS file_name, array_to_string(list_transform(p, lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(x, 12, '0') ELSE x END), '') AS sort_key FROM u""",
    "text_bigrams": f"""WITH w AS (SELECT lang, {W} AS w FROM documents), g AS (SELECT lang, unnest(list_transform(range(1, greatest(1, len(w))), lambda i: array_to_string(w[i:i + 1], ' '))) AS gram FROM w), c AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY 1, 2)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS INTEGER) AS rank FROM c) WHERE rank <= 20""",
    "style_patchwriting": f"""WITH w AS (SELECT conv_id, turn, list_transform({W}, lambda w: {POS}) AS w FROM conversations), g AS (SELECT conv_id, turn, unnest(list_transform(range(1, greatest(1, len(w) - 1)), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w),
        c AS (SELECT conv_id, turn, g, count(*) AS c FROM g GROUP BY 1, 2, 3), t AS (SELECT conv_id, turn, sum(c) AS t FROM c GROUP BY 1, 2), s AS (SELECT a.conv_id, a.turn, sum(least(a.c, b.c)) AS s FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 AND a.g = b.g GROUP BY 1, 2),
        x AS (SELECT a.conv_id, a.turn, 2 * coalesce(s, 0) / (a.t + b.t)::DOUBLE AS d FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 LEFT JOIN s ON s.conv_id = a.conv_id AND s.turn = a.turn)
        SELECT conv_id, turn, round(d, 6) AS dice, d >= 0.6 AS patchwriting FROM x""",
    "table_similarity": f"""WITH a AS ({_profile('customer', ('c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'))}), b AS ({_profile('supplier', ('s_suppkey', 's_name', 's_nationkey', 's_acctbal'))})
        SELECT a.name AS a, b.name AS b, kind, round(greatest(0.0, CASE WHEN a.mean IS NULL OR b.mean IS NULL THEN 1 ELSE 1 - abs(a.mean - b.mean) / greatest(abs(a.mean), abs(b.mean), 1e-9) END), 4) AS closeness FROM a JOIN b USING (kind)""",
}
