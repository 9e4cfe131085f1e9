"""Queries on records: incidents by class and recency, rhythms of users, gates, indexes, envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.operators import graph, records
from pairloom.operators.severity import severity
from pairloom.plans import structure as graph_plans
from pairloom.plans import texts as text_plans
from pairloom.plans.base import WITH, catalogue, incidents
from pairloom.plans.structure import ENDS, GRADES, P
from pairloom.plans.texts import W
from pairloom.runtime import table

#: Days that count as recent, seconds of a pause, and standard scores of an outlier.
RECENT, PAUSE, FAR = 365, 3600.0, 1.7
# What is advised at each severity.
ADVICE = (("High", "review at once"), ("Medium", "review this week"), ("Low", "watch"))


def incident_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Incidents by severity, then by name without regard to case."""
    rows = incidents(spark, d).select("doc_a", "doc_b", "score", "severity")
    rank = F.when(F.col("severity") == "High", 0).when(F.col("severity") == "Medium", 1).otherwise(2)
    return rows.orderBy(rank, F.lower("doc_a"), F.lower("doc_b"), F.desc("score"))


def pair_class_filter(spark: SparkSession, d: str) -> DataFrame:
    """Near copies whose two documents are English."""
    members = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return records.within_class(graph_plans._pairs(spark, d), members).select("doc_a", "doc_b", "sim")


def graph_edges_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Incidents of 1996 of 0.75 or more between documents that are not deleted."""
    rows = incidents(spark, d).where((F.col("score") >= 0.75) & (F.year("flagged_at") == 1996)).select("doc_a", "doc_b", "score")
    return records.within_class(rows, catalogue(spark, d).where("NOT is_deleted").select("filename"))


def incident_score_summary(spark: SparkSession, d: str) -> DataFrame:
    """Scores and bands by status."""
    s = F.col("score")
    return incidents(spark, d).groupBy("status").agg(F.round(F.avg(s), 6).alias("mean"), F.min(s).alias("least"), F.max(s).alias("most"), *[F.count_if(F.col("severity") == b).alias(b.lower()) for b in ("High", "Medium", "Low")])


def event_span(spark: SparkSession, d: str) -> DataFrame:
    """Number, oldest and newest entry by type."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), at(F.min("ts")).alias("oldest"), at(F.max("ts")).alias("newest"))


def incident_emerging(spark: SparkSession, d: str) -> DataFrame:
    return records.emerging(incidents(spark, d), RECENT)


def graph_top_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The hundred documents of highest degree; ties by name."""
    ends = graph.ends(incidents(spark, d).withColumnRenamed("score", "sim"))
    return ends.groupBy("doc").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "doc").limit(100)


def event_pauses(spark: SparkSession, d: str) -> DataFrame:
    return records.pauses(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", PAUSE)


def event_rhythm(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of each user's hours and kinds, and a score of hidden collaboration with burstiness."""
    rows = table(spark, d, "events").select("user_id", "event_type", F.hour("ts").alias("hour"))
    met = records.entropies(rows, "user_id", "hour", "hour_entropy").join(records.entropies(rows, "user_id", "event_type", "type_entropy"), "user_id").join(event_pauses(spark, d).select("user_id", "burstiness"), "user_id")
    score = F.round(0.3 + 0.4 * F.col("burstiness") + 0.3 * F.least(F.lit(1.0), F.col("type_entropy") / 3), 6)
    return met.select("user_id", "hour_entropy", "type_entropy", score.alias("score"), (score > 0.75).alias("covert"))


def order_price_outliers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return records.outliers(rows, "o_totalprice", FAR).select("o_orderkey", F.round("z", 4).alias("z"))


def reviewer_weight(spark: SparkSession, d: str) -> DataFrame:
    bias = graph_plans.reviewer_bias(spark, d)
    return bias.select("l_suppkey", records.reviewer_weight(F.col("mae"), F.col("variance")).alias("weight"))


def dedup_statistics(spark: SparkSession, d: str) -> DataFrame:
    return records.dedup_statistics(graph_plans._pairs(spark, d), table(spark, d, "documents").select("doc_id"))


def graph_collusion(spark: SparkSession, d: str) -> DataFrame:
    return records.colluding(graph_plans.graph_clusters(spark, d))


def graph_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Documents at risk with the advice for their severity."""
    rules = spark.createDataFrame(list(ADVICE), "severity string, advice string")
    risks = graph_plans.graph_document_risk(spark, d).select("doc", F.col("severity"), "risk_score")
    return risks.join(F.broadcast(rules), "severity").select("doc", "severity", "risk_score", "advice")  # three rules


def calibration_score_shape(spark: SparkSession, d: str) -> DataFrame:
    """Kind of each source's type-token ratios and the shift of a threshold."""
    rows = table(spark, d, "documents").select("source", F.round(text.richness("text")["ttr"], 6).alias("score"))
    return records.score_shape(rows, "source", "score")


def health_gate(spark: SparkSession, d: str) -> DataFrame:
    """Grade and gate of every document by richness, length, lines, language and letters."""
    t = text.text_of("text")
    rows = table(spark, d, "documents").select("doc_id", F.round(100 * text.richness("text")["ttr"], 4).alias("richness"), F.least(F.lit(100.0), F.length(t) / 10).alias("length"), F.least(F.lit(100.0), F.size(F.split(t, "\n")) * 25.0).alias("structure"), F.when(F.col("lang").isNotNull(), 100.0).otherwise(0.0).alias("language"), F.when(F.length(t) > 0, F.round(100.0 * F.regexp_count(t, F.lit(r"\p{L}")) / F.length(t), 4)).otherwise(0.0).alias("letters"))
    score, critical = records.health({n: (F.col(n), w) for n, w in HEALTH.items()})
    made = rows.select("doc_id", score.alias("score"), critical.alias("critical"))
    return made.select("doc_id", "score", *[c.alias(k) for k, c in records.quality_gate(F.col("score"), F.col("critical")).items()])


def order_edit_velocity(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents: lines are pages, a tenth of the quantity the minutes of editing."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.sum("l_quantity") / 10).alias("minutes"), F.count("*").alias("pages"))
    return rows.select("l_orderkey", *[c.alias(k) for k, c in records.edit_velocity(F.col("minutes"), F.col("pages")).items()])


def source_cognitive_load(spark: SparkSession, d: str) -> DataFrame:
    """Variance of reading grades over each source's documents."""
    rows = text_plans.text_readability(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return records.cognitive_load(rows, "source", "flesch_grade", "coleman_liau")


def vector_index_check(spark: SparkSession, d: str) -> DataFrame:
    """The vectors less those of labelled toxic documents, and whether they make a valid index."""
    toxic = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return records.index_check(records.without_documents(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", toxic), "embedding")


def event_envelope(spark: SparkSession, d: str) -> DataFrame:
    body, valid = records.envelope(F.col("event_type"), F.col("props"), F.col("event_id"), F.col("ts"))
    return table(spark, d, "events").select("event_id", body.alias("envelope"), valid.alias("valid"))


def event_retention(spark: SparkSession, d: str) -> DataFrame:
    """Events kept and purged at ten days, by type."""
    return records.retained(table(spark, d, "events").select("event_type", "ts"), "ts", 10).groupBy("event_type").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("purged"))


def order_dates(spark: SparkSession, d: str) -> DataFrame:
    """Order dates written as ISO text, read back; and keys, which are no dates."""
    rows = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
    return rows.select("o_orderkey", F.date_format(records.iso_timestamp(F.col("iso")), "yyyy-MM-dd").alias("day"), records.iso_timestamp(F.col("o_orderkey").cast("string")).isNull().alias("key_is_none"))


def incident_heuristic_risk(spark: SparkSession, d: str) -> DataFrame:
    """Risk of suppliers: highest and mean score, number of incidents, share of high ones."""
    s = F.col("score")
    by = incidents(spark, d).groupBy("doc_b").agg(F.max(s).alias("x"), F.avg(s).alias("a"), F.count("*").alias("n"), F.avg(F.when(F.col("severity") == "High", 1.0).otherwise(0.0)).alias("h"))
    # Weights of the parts.
    score = 0.30 * F.col("x") + 0.25 * F.least(F.lit(1.0), F.col("n") / 10) + 0.15 * F.col("h") + 0.15 * F.col("a") + 0.10 * F.col("h")
    made = by.select(F.col("doc_b").alias("doc"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("risk"))
    return made.withColumn("severity", severity("risk"))


# Weights of the five dimensions of health.
HEALTH = {"richness": 0.25, "length": 0.25, "structure": 0.2, "language": 0.15, "letters": 0.15}

QUERIES = {f.__name__: f for f in (
    incident_sorted, pair_class_filter, graph_edges_by_year, incident_score_summary, event_span, incident_emerging, graph_top_nodes, event_pauses, event_rhythm, order_price_outliers, reviewer_weight,
    dedup_statistics, graph_collusion, graph_recommendations, calibration_score_shape, health_gate, order_edit_velocity, source_cognitive_load, vector_index_check, event_envelope, event_retention,
    order_dates, incident_heuristic_risk,
)}

SEVERITY = "CASE WHEN {0} >= 0.9 THEN 'High' WHEN {0} >= 0.75 THEN 'Medium' ELSE 'Low' END"
GAPS = f"g AS (SELECT user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts)) / 1e6::DOUBLE AS gap FROM events), pauses AS (SELECT user_id, count(*) FILTER (gap > {PAUSE}) AS pauses, round(coalesce(avg(gap) FILTER (gap > {PAUSE}), 0), 3) AS mean_pause, round(coalesce(max(gap) FILTER (gap > {PAUSE}), 0), 3) AS longest_pause, round(least(1.0, coalesce(var_pop(gap), 0) / 1e8::DOUBLE), 4) AS burstiness FROM g GROUP BY 1)"


def _entropy(value: str) -> str:
    return f"SELECT user_id, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 4) AS e FROM (SELECT user_id, {value} AS v, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1"


SQL = {
    "incident_sorted": f"WITH {WITH} SELECT doc_a, doc_b, score, severity FROM inc",
    "pair_class_filter": f"{P}, m AS (SELECT doc_id FROM documents WHERE lang = 'en') SELECT * FROM p WHERE doc_a IN (FROM m) AND doc_b IN (FROM m)",
    "graph_edges_by_year": f"WITH {WITH} SELECT doc_a, doc_b, score FROM inc WHERE score >= 0.75 AND year(flagged_at) = 1996 AND doc_a IN (SELECT filename FROM cat WHERE NOT is_deleted) AND doc_b IN (SELECT filename FROM cat WHERE NOT is_deleted)",
    "incident_score_summary": f"WITH {WITH} SELECT status, round(avg(score), 6) AS mean, min(score) AS least, max(score) AS most, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low FROM inc GROUP BY 1",
    "event_span": "SELECT event_type, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events GROUP BY 1",
    "incident_emerging": f"WITH {WITH} SELECT doc_a, doc_b, count(*) AS scans, max(score) AS best FROM inc WHERE flagged_at > (SELECT max(flagged_at) FROM inc) - INTERVAL {RECENT} DAY GROUP BY 1, 2 HAVING count(*) >= 2",
    "graph_top_nodes": f"WITH {WITH} SELECT doc, count(*) AS degree FROM sides GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "event_pauses": f"WITH {GAPS} FROM pauses",
    "event_rhythm": f"WITH {GAPS}, h AS ({_entropy('hour(ts)')}), k AS ({_entropy('event_type')}), s AS (SELECT user_id, h.e AS hour_entropy, k.e AS type_entropy, round(0.3::DOUBLE + 0.4::DOUBLE * burstiness + 0.3::DOUBLE * least(1.0, k.e / 3), 6) AS score FROM h JOIN k USING (user_id) JOIN pauses USING (user_id)) SELECT *, score > 0.75 AS covert FROM s",
    "order_price_outliers": f"WITH z AS (SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER () AS z FROM orders) SELECT o_orderkey, round(z, 4) AS z FROM z WHERE abs(z) >= {FAR}",
    "reviewer_weight": f"WITH b AS ({graph_plans.SQL['reviewer_bias']}) SELECT l_suppkey, round(greatest(0.1, least(1.0, 1 / (1 + mae * 2 + variance * 5))), 4) AS weight FROM b",
    "dedup_statistics": f"""{P}, {ENDS}, c AS (SELECT doc, count(*) AS n FROM e GROUP BY 1), x AS (SELECT doc, n FROM c ORDER BY n DESC, doc LIMIT 1),
        w AS (SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS pairs, round(avg(sim), 6) AS avg_similarity, count(*) FILTER (sim >= 0.8) AS high, count(*) FILTER (sim >= 0.6 AND sim < 0.8) AS medium, count(*) FILTER (sim < 0.6) AS low FROM p)
        SELECT w.*, x.doc AS most_duplicated, coalesce(x.n, 0) AS most_pairs, round(pairs / greatest(1, documents)::DOUBLE, 4) AS rate FROM w LEFT JOIN x ON true""",
    "graph_collusion": f"WITH k AS ({graph_plans.SQL['graph_clusters']}) SELECT *, avg_similarity >= 0.9 AS confirmed FROM k WHERE size >= 3",
    "graph_recommendations": f"WITH r AS ({graph_plans.SQL['graph_document_risk']}) SELECT doc, severity, risk_score, CASE severity {' '.join(f'WHEN {s!r} THEN {a!r}' for s, a in ADVICE)} END AS advice FROM r",
    "calibration_score_shape": f"""WITH w AS (SELECT source, {W} AS w FROM documents), s AS (SELECT source, round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w)::DOUBLE ELSE 0 END, 6) AS s FROM w), m AS (SELECT source, count(s) AS n, avg(s) AS m, stddev_pop(s) AS d FROM s GROUP BY 1),
        k AS (SELECT s.source, any_value(n) AS n, CASE WHEN any_value(m) > 0 THEN any_value(d) / any_value(m) ELSE 0 END AS cv, CASE WHEN any_value(n) > 3 AND any_value(d) > 0 THEN avg(pow(s - m, 3)) / pow(any_value(d), 3) ELSE 0 END AS k FROM s JOIN m ON s.source IS NOT DISTINCT FROM m.source GROUP BY 1),
        t AS (SELECT source, n, round(cv, 6) AS cv, round(k, 4) AS skewness, CASE WHEN n < 2 THEN 'unknown' WHEN cv < 0.15 AND k > 0.5 THEN 'homogeneous' WHEN cv > 0.4 THEN 'heterogeneous' ELSE 'mixed' END AS kind FROM k) SELECT *, CASE kind WHEN 'homogeneous' THEN -0.03::DOUBLE WHEN 'heterogeneous' THEN 0.03::DOUBLE ELSE 0 END AS shift FROM t""",
    "health_gate": f"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, {W} AS w FROM documents),
        h AS (SELECT doc_id, round(100 * CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w)::DOUBLE ELSE 0 END, 4) AS richness, least(100.0, length(t) / 10::DOUBLE) AS length, least(100.0, len(string_split(t, chr(10))) * 25.0::DOUBLE) AS structure, CASE WHEN lang IS NOT NULL THEN 100.0 ELSE 0.0 END AS language,
          CASE WHEN length(t) > 0 THEN round(100.0::DOUBLE * len(regexp_extract_all(t, '\\p{{L}}')) / length(t), 4) ELSE 0 END AS letters FROM w),
        s AS (SELECT doc_id, round({' + '.join(f'{k}::DOUBLE * {w}::DOUBLE' for k, w in HEALTH.items())}, 6) AS score, array_to_string(list_filter([{', '.join(f"CASE WHEN {k} < 25 THEN '{k}' END" for k in HEALTH)}], lambda x: x IS NOT NULL), ', ') AS critical FROM h), g AS (SELECT *, {GRADES} AS grade FROM s)
        SELECT doc_id, score, grade, score >= 60 AND grade <> 'F' AS passed, array_to_string(list_filter([CASE WHEN score < 60 THEN 'score' END, CASE WHEN grade = 'F' THEN 'grade' END, CASE WHEN critical <> '' THEN 'critical: ' || critical END], lambda x: x IS NOT NULL), '; ') AS reason FROM g""",
    "order_edit_velocity": "WITH r AS (SELECT l_orderkey, (sum(l_quantity) / 10) / count(*) AS r FROM lineitem GROUP BY 1) SELECT l_orderkey, round(r, 6) AS minutes_per_page, r < 2 AS anomaly, round(CASE WHEN r < 2 THEN greatest(0.0, r / 2) ELSE 1 END, 6) AS score FROM r",
    "source_cognitive_load": f"""WITH r AS ({text_plans.SQL['text_readability']}), v AS (SELECT source, count(*) AS n, var_samp(flesch_grade) AS g, var_samp(coleman_liau) AS c FROM r JOIN documents USING (doc_id) GROUP BY 1)
        SELECT source, CASE WHEN n >= 3 THEN round(g, 4) ELSE 0 END AS grade_variance, CASE WHEN n >= 3 THEN round(c, 4) ELSE 0 END AS index_variance, n >= 3 AND g < 2 AND c < 5 AS synthetic, CASE WHEN n >= 3 THEN round(0.6::DOUBLE * greatest(0.0, least(1.0, 1 - g / 10)) + 0.4::DOUBLE * greatest(0.0, least(1.0, 1 - c / 20)), 4) ELSE 0 END AS probability FROM v""",
    "vector_index_check": """WITH i AS (SELECT embedding AS e FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)), k AS (SELECT count(*) AS vectors, min(len(e)) AS least, max(len(e)) AS most, count(*) FILTER (e IS NULL OR list_dot_product(e, e) = 0) AS bad FROM i)
        SELECT *, coalesce(least = most AND bad = 0, false) AS valid FROM k""",
    "event_envelope": """SELECT event_id, '{"event_id":"' || event_id || '","event_type":"' || event_type || '","occurred_at":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","payload":{"k":"' || json_extract_string(props, '$.k') || '"},"schema_version":1}' AS envelope, json_valid(props) AS valid FROM events""",
    "event_retention": "WITH k AS (SELECT event_type, ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY AS k FROM events) SELECT event_type, count(*) FILTER (k) AS kept, count(*) FILTER (NOT k) AS purged FROM k GROUP BY 1",
    "order_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, true AS key_is_none FROM orders",
    "incident_heuristic_risk": f"""WITH {WITH}, k AS (SELECT doc_b AS doc, max(score) AS x, avg(score) AS a, count(*) AS n, avg(CASE WHEN severity = 'High' THEN 1.0::DOUBLE ELSE 0 END) AS h FROM inc GROUP BY 1), r AS (SELECT doc, round(greatest(0.0, least(1.0, 0.30::DOUBLE * x + 0.25::DOUBLE * least(1.0, n / 10::DOUBLE) + 0.15::DOUBLE * h + 0.15::DOUBLE * a + 0.10::DOUBLE * h)), 4) AS risk FROM k)
        SELECT doc, risk, {SEVERITY.format('risk')} AS severity FROM r""",
}
