"""Queries on fingerprints, graphs, thresholds and style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import style, text
from pairloom.operators import fingerprints, graph, passages, scoring
from pairloom.plans import pairs as pair_plans
from pairloom.plans.texts import S, W
from pairloom.runtime import cut, table

GRID = [round(0.05 * i, 2) for i in range(1, 20)]


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return cut(pair_plans.near_copies_word_jaccard(spark, d).select("doc_a", "doc_b", "sim"))


def dedup_minhash_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Documents of equal five-word shingles, each with the first, and pairs of such classes alike by half or more.

    A text of fewer words is one shingle; one without words is in no pair.
    """

    def shingled(words: Column) -> Column:
        whole = F.array(F.xxhash64(F.array_join(words, " ")))
        return F.when(F.size(words) >= 5, passages.window_hashes(words, 5)).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    docs = table(spark, d, "documents").select("doc_id", text.words("text").alias("words")).select("doc_id", shingled(F.col("words")).alias("items"))
    return fingerprints.minhash_pairs(docs, "doc_id", "items")


def dedup_simhash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", text.words("text").alias("items"))
    return fingerprints.simhash(docs, "doc_id", "items")


def dedup_winnowing(spark: SparkSession, d: str) -> DataFrame:
    """Number and sum of each document's winnowed fingerprints."""
    docs = table(spark, d, "documents").select("doc_id", fingerprints.winnow(text.words("text")).alias("f"))
    return docs.select("doc_id", F.size("f").cast("long").alias("prints"), F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def dedup_families(spark: SparkSession, d: str) -> DataFrame:
    return graph.families(_pairs(spark, d))


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.column_profile(table(spark, d, "customer"))


def graph_clusters(spark: SparkSession, d: str) -> DataFrame:
    return graph.clusters(_pairs(spark, d), 0.75)


def graph_document_risk(spark: SparkSession, d: str) -> DataFrame:
    return graph.document_risk(_pairs(spark, d))


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_centrality(_pairs(spark, d))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_stats(_pairs(spark, d))


def graph_page_rank(spark: SparkSession, d: str) -> DataFrame:
    return graph.page_rank(_pairs(spark, d)).select("doc", F.round("rank", 8).alias("rank"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.round(text.richness("text")["ttr"], 6).alias("score"))
    return docs.join(table(spark, d, "labels"), "doc_id")


def calibration_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Type-token ratio as a score of quality, at 19 thresholds."""
    return scoring.threshold_sweep(_labelled(spark, d), "score", "quality", GRID)


def calibration_best(spark: SparkSession, d: str) -> DataFrame:
    sweep = cut(scoring.threshold_sweep(_labelled(spark, d), "score", "quality", GRID))
    best = [scoring.best_threshold(sweep, s).withColumn("strategy", F.lit(s)) for s in ("f1", "precision", "recall", "youden", "balanced")]
    return best[0].unionByName(best[1]).unionByName(best[2]).unionByName(best[3]).unionByName(best[4])


def calibration_auc(spark: SparkSession, d: str) -> DataFrame:
    return scoring.roc_auc(_labelled(spark, d), "score", "quality")


def agreement_cohen(spark: SparkSession, d: str) -> DataFrame:
    return scoring.cohens_kappa(table(spark, d, "labels"), "quality", "toxic")


def agreement_fleiss(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    ratings = rows.select("doc_id", F.explode(F.array("quality", "toxic")).alias("category"))
    return scoring.fleiss_kappa(ratings, "doc_id", "category")


def reviewer_bias(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as reviewers: discount against tax."""
    return scoring.reviewer_bias(table(spark, d, "lineitem"), "l_suppkey", "l_discount", "l_tax")


def health_grades(spark: SparkSession, d: str) -> DataFrame:
    """Grades of documents by a score from richness and length."""
    t = table(spark, d, "documents").select(F.round(F.least(F.lit(100.0), 60 * text.richness("text")["ttr"] + F.least(F.lit(40.0), F.length("text") / 50)), 4).alias("score"))
    return t.groupBy(scoring.grade(F.col("score")).alias("grade")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"))


def style_features(spark: SparkSession, d: str) -> DataFrame:
    """Burstiness, repetitiveness and lexical complexity."""
    docs = table(spark, d, "documents")
    complexity = [F.round(c, 6).alias(k) for k, c in style.lexical_complexity("text").items()]
    return docs.select("doc_id", F.round(style.burstiness("text"), 5).alias("burstiness"), F.round(style.repetitiveness("text"), 6).alias("repetitiveness"), *complexity)


def style_watermark(spark: SparkSession, d: str) -> DataFrame:
    """Green words by keyed hash, their z score and Wilson interval."""
    docs = table(spark, d, "documents").select("doc_id", style.green_share("text").alias("g")).select("doc_id", "g.green", "g.total")
    low, high = style.wilson(F.col("green"), F.col("total"))
    return docs.select("doc_id", "green", "total", F.round(style.watermark_z(F.col("green"), F.col("total")), 6).alias("z"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def style_discourse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in style.discourse_counts("text").items()])


def style_pos(spark: SparkSession, d: str) -> DataFrame:
    """Tags of all words by source."""
    w = table(spark, d, "documents").select("source", F.explode(text.words("text")).alias("w"))
    return w.groupBy("source", style.pos_tag(F.col("w")).alias("tag")).agg(F.count("*").alias("n"))


def style_turn_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of each conversation's roles."""
    counts = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("role").alias("c"))
    n, bits = F.sum("c"), F.sum(F.when(F.col("c") > 0, F.col("c") * F.log2("c")).otherwise(0.0))
    return counts.groupBy("conv_id").agg(F.when(n > 0, F.round(F.log2(n) - bits / n, 6)).otherwise(0.0).alias("entropy"))


QUERIES = {f.__name__: f for f in (
    dedup_minhash_pairs, dedup_simhash, dedup_winnowing, dedup_families, column_profile, graph_clusters, graph_document_risk, graph_degrees, graph_stats, graph_page_rank,
    calibration_sweep, calibration_best, calibration_auc, agreement_cohen, agreement_fleiss, reviewer_bias, health_grades, style_features, style_watermark, style_discourse, style_pos, style_turn_entropy,
)}

HEX = "('0x' || {0})::BIGINT"
BITS = ", ".join(f"sum(CASE WHEN ({n} >> {i}) & 1 = 1 THEN 1 ELSE -1 END) AS {n}{i}" for n in "hl" for i in range(32))
SUMS = {n: " + ".join(f"CASE WHEN {n}{i} > 0 THEN {1 << i} ELSE 0 END" for i in range(32)) for n in "hl"}
P = "WITH p AS (SELECT doc_a, doc_b, sim FROM (" + pair_plans.SQL["near_copies_word_jaccard"] + "))"
ENDS = "e AS (SELECT doc_a AS doc, doc_b AS other, sim FROM p UNION ALL SELECT doc_b, doc_a, sim FROM p)"
REACH = """r AS (SELECT doc AS x, doc AS y FROM e UNION SELECT r.x, e.other FROM r JOIN e ON r.y = e.doc), c AS (SELECT x AS doc, min(y) AS c FROM r GROUP BY 1)"""
LAB = f"t0 AS (SELECT doc_id, {W} AS w FROM documents), t AS (SELECT doc_id, round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w)::DOUBLE ELSE 0 END, 6) AS score, quality FROM t0 JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"
SWEEP = f"""{LAB}, g AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in GRID)}]) AS threshold), k AS (SELECT threshold, count(*) FILTER (quality = 1 AND score >= threshold) AS tp,
  count(*) FILTER (quality <> 1 AND score >= threshold) AS fp, count(*) FILTER (quality = 1 AND score < threshold) AS fn, count(*) FILTER (quality <> 1 AND score < threshold) AS tn FROM t, g GROUP BY 1),
  m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM k),
  w AS (SELECT threshold, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy,
  round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0 END, 6) AS fpr, round(CASE WHEN tp + fn > 0 THEN fn / (tp + fn)::DOUBLE ELSE 0 END, 6) AS fnr FROM m)"""
VALUE = {"f1": "f1", "precision": "precision", "recall": "recall", "youden": "recall - fpr", "balanced": "-abs(precision - recall)"}
GRADES = "CASE WHEN score >= 97 THEN 'A+' WHEN score >= 93 THEN 'A' WHEN score >= 90 THEN 'A-' WHEN score >= 87 THEN 'B+' WHEN score >= 83 THEN 'B' WHEN score >= 80 THEN 'B-' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"
BW = "list_filter(string_split_regex(lower(coalesce(text, '')), '[\\s\\x0b]+'), lambda x: x <> '')"
POS = "CASE " + " ".join(f"WHEN regexp_matches(w, '{p}') THEN '{t}'" for t, p in style.POS_RULES) + " ELSE 'X' END"
PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))

#: The rounds of PageRank one after the other.
ROUNDS = ", ".join(
    f"r{i} AS MATERIALIZED (SELECT t.doc, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(sum(r.rank * l.share), 0) AS rank FROM t CROSS JOIN n LEFT JOIN l ON l.other = t.doc LEFT JOIN r{i - 1} r ON r.doc = l.doc GROUP BY t.doc, n)" for i in range(1, 21)
)
RANKED = f"{P}, {ENDS}, t AS (SELECT doc, sum(sim) AS total FROM e GROUP BY 1), l AS (SELECT doc, other, sim / total AS share FROM e JOIN t USING (doc)), n AS (SELECT count(*) AS n FROM t), r0 AS (SELECT doc, 1 / n::DOUBLE AS rank FROM t, n), {ROUNDS}"

SQL = {
    "graph_page_rank": f"{RANKED} SELECT doc, round(rank, 8) AS rank FROM r20",
    "dedup_minhash_pairs": f"""WITH w AS (SELECT doc_id, {W} AS w FROM documents), s AS (SELECT doc_id, list_sort(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [array_to_string(w, ' ')] END) AS s FROM w WHERE len(w) > 0),
        m AS (SELECT doc_id, len(s) AS n, s, min(doc_id) OVER (PARTITION BY s) AS rep FROM s), x AS (SELECT doc_id, n, unnest(s) AS x FROM m WHERE doc_id = rep),
        i AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS i, any_value(a.n) + any_value(b.n) AS n FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2)
        SELECT doc_a, doc_b, i / (n - i)::DOUBLE AS similarity FROM i WHERE 2 * i >= n - i UNION ALL SELECT rep, doc_id, 1.0::DOUBLE FROM m WHERE rep <> doc_id""",
    "dedup_simhash": f"""WITH w AS (SELECT doc_id, unnest({W}) AS item FROM documents), x AS (SELECT doc_id, {HEX.format('substr(md5(item), 1, 8)')} AS h, {HEX.format('substr(md5(item), 9, 8)')} AS l FROM w),
        v AS (SELECT doc_id, {BITS} FROM x GROUP BY 1) SELECT doc_id, CAST({SUMS['h']} AS BIGINT) AS high, CAST({SUMS['l']} AS BIGINT) AS low FROM v""",
    "dedup_winnowing": f"""WITH w AS (SELECT doc_id, {W} AS w FROM documents), g AS (SELECT doc_id, list_transform(range(1, greatest(1, len(w) - 3)), lambda i: {HEX.format("substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 8)")}) AS h FROM w),
        f AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(h) - 3) + 1), lambda i: list_min(h[i:i + 3]))) AS f FROM g) SELECT doc_id, len(f) AS prints, CAST(coalesce(list_sum(f), 0) AS BIGINT) AS total FROM f""",
    "dedup_families": f"WITH RECURSIVE {P[5:]}, {ENDS}, {REACH} SELECT doc, c AS family FROM c",
    "column_profile": f"""WITH l AS ({PROFILE}), a AS (SELECT name, count(*) AS n, count(value) AS f, count(DISTINCT value) AS uniques, count(TRY_CAST(value AS DOUBLE)) AS k, round(avg(TRY_CAST(value AS DOUBLE)), 4) AS mean,
        round(stddev_pop(TRY_CAST(value AS DOUBLE)), 4) AS sd, min(TRY_CAST(value AS DOUBLE)) AS least, max(TRY_CAST(value AS DOUBLE)) AS most FROM l GROUP BY 1),
        b AS (SELECT *, CASE WHEN k > 0.8 * f THEN 'numeric' WHEN uniques < 0.5 * f THEN 'categorical' ELSE 'text' END AS kind FROM a)
        SELECT name, kind, uniques, n - f AS nulls, CASE WHEN kind = 'numeric' THEN mean END AS mean, CASE WHEN kind = 'numeric' THEN sd END AS sd, CASE WHEN kind = 'numeric' THEN least END AS least, CASE WHEN kind = 'numeric' THEN most END AS most FROM b""",
    "graph_clusters": f"""WITH RECURSIVE p0 AS ({P} SELECT * FROM p), p AS (SELECT * FROM p0 WHERE sim >= 0.75), {ENDS}, {REACH}, s AS (SELECT c, count(*) AS size FROM c GROUP BY 1),
        i AS (SELECT c, avg(sim) AS a, max(sim) AS m FROM p JOIN c ON p.doc_a = c.doc GROUP BY 1)
        SELECT c AS cluster, size, round(a, 6) AS avg_similarity, round(m, 6) AS max_similarity, CASE WHEN m >= 0.9 AND size >= 3 THEN 'critical' WHEN m >= 0.9 OR (a >= 0.75 AND size >= 4) THEN 'high' WHEN a >= 0.59 AND size >= 2 THEN 'elevated' ELSE 'low' END AS risk FROM s JOIN i USING (c)""",
    "graph_document_risk": f"""{P}, {ENDS}, a AS (SELECT doc, max(sim) AS m, count(*) FILTER (sim >= 0.59) AS s, count(*) FILTER (sim >= 0.9) AS h FROM e GROUP BY 1), b AS (SELECT e.doc, min(other) AS o FROM e JOIN a ON a.doc = e.doc AND e.sim = a.m GROUP BY 1),
        c AS (SELECT *, CASE WHEN h >= 3 THEN least(1.0, m + 0.1::DOUBLE) ELSE m END AS x FROM a)
        SELECT doc, round(m, 6) AS max_similarity, o AS most_similar, s AS similar_pairs, h AS high_pairs, round(CASE WHEN s >= 5 THEN least(1.0, x + 0.05::DOUBLE) ELSE x END, 6) AS risk_score,
        CASE WHEN m >= 0.9 THEN 'High' WHEN m >= 0.75 THEN 'Medium' ELSE 'Low' END AS severity FROM c JOIN b USING (doc)""",
    "graph_degrees": f"{P}, {ENDS}, g AS (SELECT doc, count(*) AS degree FROM e GROUP BY 1) SELECT doc, degree, round(degree / greatest(1, (SELECT count(*) FROM g) - 1)::DOUBLE, 6) AS centrality FROM g",
    "graph_stats": f"""{P}, {ENDS}, g AS (SELECT doc, count(*) AS degree FROM e GROUP BY 1)
        SELECT count(*) AS nodes, CAST(sum(degree) / 2 AS BIGINT) AS edges, round(sum(degree) / (count(*) * (count(*) - 1))::DOUBLE, 6) AS density, round(avg(degree), 6) AS mean_degree, max(degree) AS max_degree FROM g""",
    "calibration_sweep": f"WITH {SWEEP} SELECT * FROM w",
    "calibration_best": f"WITH {SWEEP} " + " UNION ALL ".join(f"(SELECT threshold, f1, precision, recall, '{s}' AS strategy FROM w ORDER BY round({v}, 6) DESC, f1 DESC, precision DESC, recall DESC, threshold DESC LIMIT 1)" for s, v in VALUE.items()),
    "calibration_auc": f"WITH {LAB}, x AS (SELECT a.score AS p, b.score AS q FROM t a, t b WHERE a.quality = 1 AND b.quality <> 1) SELECT round(avg(CASE WHEN p > q THEN 1.0::DOUBLE WHEN p = q THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS auc FROM x",
    "agreement_cohen": """WITH n AS (SELECT count(*)::DOUBLE AS n, avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS po FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
        a AS (SELECT quality AS k, count(*) AS c FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1), b AS (SELECT toxic AS k, count(*) AS c FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
        e AS (SELECT sum(a.c::DOUBLE * b.c) AS e FROM a JOIN b USING (k)) SELECT round((po - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM n, e""",
    "agreement_fleiss": """WITH r AS (SELECT doc_id, unnest([quality, toxic]) AS k FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), c AS (SELECT doc_id, k, count(*) AS c FROM r GROUP BY 1, 2),
        i AS (SELECT doc_id, sum(c) AS r, sum(c * c) AS q FROM c GROUP BY 1), p AS (SELECT avg((q - r) / (r * (r - 1))) AS p FROM i), s AS (SELECT k, sum(c) AS c FROM c GROUP BY 1), e AS (SELECT sum(c::DOUBLE * c) / (sum(c)::DOUBLE * sum(c)) AS e FROM s)
        SELECT round((p - e) / (1 - e), 6) AS kappa FROM p, e""",
    "reviewer_bias": "SELECT l_suppkey, count(*) AS n, round(avg(l_discount - l_tax), 6) AS bias, round(avg(abs(l_discount - l_tax)), 6) AS mae, round(var_pop(l_discount - l_tax), 6) AS variance FROM lineitem GROUP BY 1",
    "health_grades": f"WITH w AS (SELECT text, {W} AS w FROM documents), s AS (SELECT round(least(100.0, 60 * CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w)::DOUBLE ELSE 0 END + least(40.0, length(text) / 50::DOUBLE)), 4) AS score FROM w) SELECT {GRADES} AS grade, count(*) AS n, round(avg(score), 4) AS mean FROM s GROUP BY 1",
    "style_features": f"""WITH a AS (SELECT doc_id, {W} AS w, {BW} AS b, list_transform({S}, lambda s: len(list_filter(string_split_regex(s, '[\\s\\x0b]+'), lambda x: x <> ''))) AS l FROM documents),
        g AS (SELECT *, list_transform(range(1, greatest(1, len(b) - 1)), lambda i: array_to_string(b[i:i + 2], ' ')) AS g FROM a)
        SELECT doc_id, round(CASE WHEN len(l) < 2 OR list_avg(l) = 0 THEN 0 ELSE least(1.0, list_stddev_pop(l) / list_avg(l)) END, 5) AS burstiness, round(CASE WHEN len(g) > 0 THEN 1 - len(list_distinct(g)) / len(g)::DOUBLE ELSE 0 END, 6) AS repetitiveness,
        round(len(list_distinct(w)) / greatest(1, len(w))::DOUBLE, 6) AS ttr, round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(1, len(w))::DOUBLE, 6) AS mean_word,
        round(len(list_filter(w, lambda x: length(x) >= 8)) / greatest(1, len(w))::DOUBLE, 6) AS long_share FROM g""",
    "style_watermark": f"""WITH w AS (SELECT doc_id, {W} AS w FROM documents), g AS (SELECT doc_id, greatest(0, len(w) - 1) AS total, len(list_filter(range(2, len(w) + 1), lambda i: {HEX.format("substr(sha256('pairloom:' || w[i - 1] || ':' || w[i]), 1, 8)")} / 4294967295.0::DOUBLE < 0.5)) AS green FROM w),
        p AS (SELECT *, greatest(1, total)::DOUBLE AS n, green / greatest(1, total)::DOUBLE AS p FROM g), k AS (SELECT *, p + 1.96::DOUBLE * 1.96::DOUBLE / (2 * n) AS c, 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE * 1.96::DOUBLE / (4 * n * n)) AS r, 1 + 1.96::DOUBLE * 1.96::DOUBLE / n AS s FROM p)
        SELECT doc_id, green, total, round(CASE WHEN total > 0 THEN (green - 0.5::DOUBLE * total) / sqrt(total * 0.25::DOUBLE) ELSE 0 END, 6) AS z, round(CASE WHEN total > 0 THEN (c - r) / s ELSE 0 END, 6) AS low, round(CASE WHEN total > 0 THEN (c + r) / s ELSE 1 END, 6) AS high FROM k""",
    "style_discourse": "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(lower(coalesce(text, '')), '\\b({'|'.join(m)})\\b')) AS {k}" for k, m in style.DISCOURSE.items()) + " FROM documents",
    "style_pos": f"WITH w AS (SELECT source, unnest({W}) AS w FROM documents) SELECT source, {POS} AS tag, count(*) AS n FROM w GROUP BY 1, 2",
    "style_turn_entropy": """WITH c AS (SELECT conv_id, count(*) AS c FROM conversations GROUP BY conv_id, role), t AS (SELECT conv_id, sum(c) AS t FROM c GROUP BY 1)
        SELECT conv_id, round(-sum(c / t * log2(c / t)), 6) + 0.0 AS entropy FROM c JOIN t USING (conv_id) GROUP BY 1""",
}
