"""Queries on significance, alerts, drift, hot spots, pages of exports and further text measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions import encoding
from pairloom.functions.stats import normal_cdf, t_two_tailed
from pairloom.functions.text import text_of, words
from pairloom.operators import ensemble
from pairloom.operators.ranges import running
from pairloom.plans import structure, texts
from pairloom.plans.pairs import SQL as PAIR_SQL
from pairloom.plans.pairs import near_copies_word_jaccard
from pairloom.plans.searches import ALIKE
from pairloom.plans.texts import T, W
from pairloom.runtime import cut, table

#: Rows of a page of an export; similarity of a hot spot.
PAGE, HOT = 500, 0.8
# Limits of trend alerts.
STEEP, RISING, SURGE, FAR, VOLATILE = 0.02, 0.01, 0.5, 2.0, 0.3
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("dr", "mr", "mrs", "ms", "prof", "sr", "jr", "st", "vs", "etc", "fig", "no", "vol", "al", "approx", "e.g", "i.e")
#: Full stops that end no sentence, between what stays, and the ends of sentences.
MASKS = (r"(?i)(^|[^a-z0-9_])(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.", r"(^|[^A-Za-z0-9_])([A-Za-z])\.", r"([0-9])\.([0-9])")
ENDS = r"[.!?]+[ \t\r\n]"
GARBLED_END, MENDED_END = " cafÃ© â€œHelloâ€\u009d Ã‚Â© Âme caf\u00e9", " café “Hello” © Âme café"
IGNORED = ("this work", "general public license", "the author")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    """Number and mean value of each event type's events by day; a row for each type and day."""
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("events"), F.avg("value").alias("mean_value"))


def trend_significance(spark: SparkSession, d: str) -> DataFrame:
    """Linear trend of each event type's daily events, with the p-value of its slope."""
    x = (F.row_number().over(Window.partitionBy("event_type").orderBy("day")) - 1).cast("double")
    rows = _daily(spark, d).select("event_type", x.alias("x"), F.col("events").alias("y"))
    made = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"))
    t = F.sqrt(F.col("r2") * (F.col("n") - 2) / F.greatest(1 - F.col("r2"), F.lit(1e-12)))
    return made.where("n > 2").select("event_type", "n", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), F.round(t_two_tailed(t, F.col("n") - 2), 6).alias("p"))


def style_watermark_p(spark: SparkSession, d: str) -> DataFrame:
    """One-sided p-value of each document's watermark score, and whether it is below 0.01."""
    made = structure.style_watermark(spark, d).where("total > 0").select("doc_id", "z", F.greatest(F.lit(0.0), 1 - normal_cdf(F.col("z"))).alias("p"))
    return made.select("doc_id", "z", F.round("p", 6).alias("p"), (F.round("p", 6) < 0.01).alias("marked"))


def trend_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts on daily events and their mean value: rise, surge, an outlying last day, volatility."""
    names = ("events", "mean_value")
    rows = cut(_daily(spark, d).unpivot(["event_type", "day"], list(names), "metric", "y"))
    w = Window.partitionBy("event_type", "metric").orderBy("day")
    placed = rows.withColumns({"x": (F.row_number().over(w) - 1).cast("double"), "step": F.col("y") - F.lag("y").over(w)})
    key = F.struct("day", "y")
    made = placed.groupBy("event_type", "metric").agg(
        F.regr_slope("y", "x").alias("slope"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"), F.stddev_pop("step").alias("volatility"), F.min(key)["y"].alias("first"), F.max(key)["y"].alias("last")
    )
    share, z = (F.col("last") - F.col("first")) / F.nullif(F.abs("first"), F.lit(0.0)), (F.col("last") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    cv = F.col("volatility") / F.nullif(F.abs("mean"), F.lit(0.0))
    rules = (
        ("rise", F.col("slope") > RISING, F.when(F.col("slope") > STEEP, "critical").otherwise("warning"), F.col("slope")),
        ("surge", share > SURGE, F.lit("critical"), share),
        ("outlier", F.abs(z) >= FAR, F.when(F.abs(z) > 3.5, "critical").otherwise("warning"), z),
        ("volatility", (F.col("volatility") > 0.1) & (cv > VOLATILE), F.lit("info"), cv),
    )
    told = [F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(name).alias("alert"), level.alias("level"), F.round(value, 6).alias("value"))) for name, hit, level, value in rules]
    each = made.select("event_type", "metric", F.explode(F.filter(F.array(*told), lambda x: x.isNotNull())).alias("a"))
    return each.select("event_type", "metric", "a.alert", "a.level", "a.value")


def event_drift(spark: SparkSession, d: str) -> DataFrame:
    """Jensen-Shannon divergence in bits between the event types of a day and of the day with events before it."""
    counts = cut(table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("c")))
    days = counts.groupBy("day").agg(F.sum("c").alias("n"))
    before = cut(days.select("day", "n", F.lag("day").over(Window.orderBy("day")).alias("b"), F.lag("n").over(Window.orderBy("day")).alias("bn")).where("b IS NOT NULL"))  # a row for each day
    own = before.join(counts, "day").select("day", "event_type", (F.col("c") / F.col("n")).alias("p"), F.lit(0.0).alias("q"))
    old = before.join(counts.withColumnRenamed("day", "b"), "b").select("day", "event_type", F.lit(0.0).alias("p"), (F.col("c") / F.col("bn")).alias("q"))
    both = own.unionByName(old).groupBy("day", "event_type").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return both.groupBy("day").agg(F.round(F.greatest(F.lit(0.0), F.sum(part(F.col("p")) + part(F.col("q"))) / 2), 6).alias("divergence"))


def pair_hotspots(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of at least 0.8 by the sources of both documents: number, mean and highest similarity."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    pairs = near_copies_word_jaccard(spark, d).where(F.col("sim") >= HOT)
    made = pairs.join(docs.select(F.col("doc_id").alias("doc_a"), F.col("source").alias("sa")), "doc_a").join(docs.select(F.col("doc_id").alias("doc_b"), F.col("source").alias("sb")), "doc_b")
    by = made.groupBy(F.least("sa", "sb").alias("source_a"), F.greatest("sa", "sb").alias("source_b"))
    return by.agg(F.count("*").alias("pairs"), F.round(F.avg("sim"), 6).alias("mean"), F.round(F.max("sim"), 6).alias("highest"))


def version_drift(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as lineages of versions: the twenty of two steps or more whose turns are least like the turn before."""
    made = texts.conversation_neighbours(spark, d).groupBy("conv_id").agg((F.count("*") + 1).alias("versions"), F.round(F.avg("jaccard"), 4).alias("mean"), F.round(F.min("jaccard"), 6).alias("least"))
    return made.where("versions >= 2").orderBy("mean", "conv_id").limit(20)


def version_most_revised(spark: SparkSession, d: str) -> DataFrame:
    """The twenty conversations of most turns, with how many roles took part."""
    made = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("versions"), F.count_distinct("role").alias("roles"))
    return made.orderBy(F.desc("versions"), "conv_id").limit(20)


def export_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 500 orders in the order of their keys: first and last key, rows, and a digest of prices."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    placed = running(rows, "o_orderkey", F.lit(1), "place").withColumn("page", F.floor(F.col("place") / PAGE))
    return placed.groupBy("page").agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def text_sentences_masked(spark: SparkSession, d: str) -> DataFrame:
    """Sentences by their ends, where full stops of abbreviations, single letters and decimals end none; one at least of a text with words."""
    t = F.concat(text_of("text"), F.lit(" Dr. A. Smith paid 3.50 vs. 4.25. Did J. Doe? Yes!"))
    for pattern in MASKS:
        t = F.regexp_replace(t, pattern, "$1$2")
    return table(spark, d, "documents").select("doc_id", F.greatest(F.lit(1), F.regexp_count(F.concat(t, F.lit(" ")), F.lit(ENDS))).cast("long").alias("sentences"))


def text_without_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Documents without some phrases of the caller's, in any case: characters left, and a digest."""
    t = F.regexp_replace(text_of("text"), "(?i)" + "|".join(IGNORED), "")
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("kept_md5"))


def text_mojibake(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a garbled end: share of garbled characters, whether it is 1 % or more, and a digest of the mended text."""
    t = F.concat(text_of("text"), F.lit(GARBLED_END))
    share = encoding.garbled_share(t)
    return table(spark, d, "documents").select("doc_id", F.round(share, 6).alias("share"), (share >= 0.01).alias("garbled"), F.md5(encoding.mended(t)).alias("mended_md5"))


def copy_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Ensemble score of the pairs of the similarity join, with its five parts."""
    docs = table(spark, d, "documents").select("doc_id", "text", words("text").alias("w"))
    return ensemble.ensemble(cut(near_copies_word_jaccard(spark, d).select("doc_a", "doc_b")), docs, "doc_id", "text", "w")


QUERIES = {f.__name__: f for f in (
    trend_significance, style_watermark_p, trend_alerts, event_drift, pair_hotspots, version_drift, version_most_revised, export_pages, text_sentences_masked, text_without_phrases, text_mojibake, copy_ensemble,
)}

ERF = "(CASE WHEN {0} = 0 THEN 0 WHEN abs({0}) >= 8 THEN sign({0}) ELSE sign({0}) * list_sum(list_transform(range(0, 200), lambda i: exp((2 * i + 1) * ln(abs({0})) - {0} * {0} - lgamma(i + 1.5::DOUBLE)))) END)"
#: The incomplete beta function by its power series, x not near 1.
BETA = "(exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b}) - lgamma({a} + 1) - lgamma({b})) * list_sum(list_transform(range(0, 600), lambda i: exp(lgamma({a} + {b} + i) - lgamma({a} + {b}) - lgamma({a} + 1 + i) + lgamma({a} + 1) + i * ln({x})))))"
DAILY = "s AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*)::DOUBLE AS events, avg(value) AS mean_value FROM events GROUP BY 1, 2)"
MASKED = f"({T} || ' Dr. A. Smith paid 3.50 vs. 4.25. Did J. Doe? Yes!')"
for pattern in MASKS:
    MASKED = f"regexp_replace({MASKED}, '{pattern}', '\\1\\2', 'g')"

GRAMS = "list_distinct(list_transform(range(1, greatest(1, len({0}) - {1} + 1)), lambda i: array_to_string({0}[i:i + {1}], ' ')))"
JACCARD = "(CASE WHEN len({0}_a) = 0 AND len({0}_b) = 0 THEN 0 ELSE len(list_intersect({0}_a, {0}_b)) / greatest(1, len({0}_a) + len({0}_b) - len(list_intersect({0}_a, {0}_b)))::DOUBLE END)"
RATIO = "(CASE WHEN greatest({0}, {1}) > 0 THEN least({0}, {1}) / greatest({0}, {1})::DOUBLE ELSE 0 END)"
FEATURES = ("own", "g2", "g3", "g5", "paras", "sentences", "chars", "words", "norm", "top")
JOINT = ", ".join(f"{s}.{c} AS {c}_{s}" for s in "ab" for c in FEATURES)

SQL = {
    "text_mojibake": f"SELECT doc_id, round(g / n::DOUBLE, 6) AS share, g / n::DOUBLE >= 0.01 AS garbled, md5({T} || '{MENDED_END}') AS mended_md5 FROM (SELECT doc_id, text, length({T} || '{GARBLED_END}') AS n, 12 AS g FROM documents)",
    "copy_ensemble": f"""WITH {ALIKE}, w AS (SELECT doc_id, {T} AS t, {W} AS w FROM documents), c AS (SELECT doc_id, x, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY 1, 2), k AS (SELECT doc_id, sqrt(sum(c * c)) AS norm, (list(x ORDER BY c DESC, x))[1:20] AS top FROM c GROUP BY 1),
        f AS (SELECT w.doc_id, list_distinct(w) AS own, {GRAMS.format('w', 1)} AS g2, {GRAMS.format('w', 2)} AS g3, {GRAMS.format('w', 4)} AS g5, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda p: trim(p)), lambda p: p <> '') AS paras, len(string_split_regex(t, '[.!?]+')) AS sentences, length(t) AS chars, len(w) AS words, coalesce(norm, 0) AS norm, coalesce(top, []) AS top FROM w LEFT JOIN k USING (doc_id)),
        d AS (SELECT n.doc_a, n.doc_b, sum(x.c * y.c) AS dot FROM n JOIN c x ON x.doc_id = n.doc_a JOIN c y ON y.doc_id = n.doc_b AND x.x = y.x GROUP BY 1, 2), j AS (SELECT n.doc_a, n.doc_b, coalesce(dot, 0) AS dot, {JOINT} FROM n JOIN f a ON a.doc_id = n.doc_a JOIN f b ON b.doc_id = n.doc_b LEFT JOIN d ON d.doc_a = n.doc_a AND d.doc_b = n.doc_b),
        p AS (SELECT doc_a, doc_b, round(least(1, 0.5 * {JACCARD.format('own')} + 0.5 * CASE WHEN norm_a * norm_b > 0 THEN dot / (norm_a * norm_b) ELSE 0 END), 6) AS semantic, round(0.6 * {JACCARD.format('g2')} + 0.4 * {JACCARD.format('g3')}, 6) AS lexical,
          round(0.4 * {RATIO.format('len(paras_a)', 'len(paras_b)')} + 0.3 * {RATIO.format('sentences_a', 'sentences_b')} + 0.3 * {RATIO.format('chars_a', 'chars_b')}, 6) AS structural,
          round(0.5 * (1 - abs(CASE WHEN words_a > 0 THEN len(own_a) / words_a::DOUBLE ELSE 0 END - CASE WHEN words_b > 0 THEN len(own_b) / words_b::DOUBLE ELSE 0 END)) + 0.5 * {JACCARD.format('top')}, 6) AS statistical,
          round(0.7 * {JACCARD.format('g5')} + 0.3 * CASE WHEN greatest(len(paras_a), len(paras_b)) > 0 THEN len(list_intersect(paras_a, paras_b)) / greatest(len(paras_a), len(paras_b))::DOUBLE ELSE 0 END, 6) AS fingerprint FROM j),
        s AS (SELECT *, round(({' + '.join(f'{k} * {w * c!r}::DOUBLE' for k, (w, c) in ensemble.PARTS.items())}) / {sum(w * c for w, c in ensemble.PARTS.values())!r}::DOUBLE, 6) AS score FROM p)
        SELECT *, CASE WHEN score >= 0.8 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'moderate' WHEN score >= 0.2 THEN 'low' ELSE 'clean' END AS level FROM s""",
    "trend_significance": f"""WITH {DAILY}, x AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS x, events AS y FROM s), g AS (SELECT event_type, count(*) AS n, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2 FROM x GROUP BY 1),
        t AS (SELECT *, r2 * (n - 2) / greatest(1 - r2, 1e-12) AS t2, (n - 2) / 2::DOUBLE AS a FROM g WHERE n > 2), u AS (SELECT *, (n - 2) / (n - 2 + t2) AS x FROM t)
        SELECT event_type, n, round(slope, 6) AS slope, round(r2, 6) AS r2, round(least(1, greatest(0, CASE WHEN x >= 1 THEN 1 WHEN x <= (a + 1) / (a + 2.5) THEN {BETA.format(a='a', b='0.5::DOUBLE', x='least(x, 0.9999999)')} ELSE 1 - {BETA.format(a='0.5::DOUBLE', b='a', x='greatest(1 - x, 1e-300)')} END)), 6) AS p FROM u""",
    "style_watermark_p": f"WITH z AS ({structure.SQL['style_watermark']}), p AS (SELECT doc_id, z, round(greatest(0.0::DOUBLE, 1 - (1 + {ERF.format('(z / sqrt(2.0::DOUBLE))')}) / 2), 6) AS p FROM z WHERE total > 0) SELECT *, p < 0.01 AS marked FROM p",
    "trend_alerts": f"""WITH {DAILY}, u AS (SELECT event_type, day, 'events' AS metric, events AS y FROM s UNION ALL SELECT event_type, day, 'mean_value', mean_value FROM s), x AS (SELECT *, row_number() OVER w - 1 AS x, y - lag(y) OVER w AS step FROM u WINDOW w AS (PARTITION BY event_type, metric ORDER BY day)),
        g AS (SELECT event_type, metric, regr_slope(y, x) AS slope, avg(y) AS mean, stddev_pop(y) AS sd, stddev_pop(step) AS volatility, arg_min(y, day) AS f, arg_max(y, day) AS l FROM x GROUP BY 1, 2), k AS (SELECT *, (l - f) / nullif(abs(f), 0) AS share, (l - mean) / nullif(sd, 0) AS z, volatility / nullif(abs(mean), 0) AS cv FROM g)
        SELECT event_type, metric, 'rise' AS alert, CASE WHEN slope > {STEEP} THEN 'critical' ELSE 'warning' END AS level, round(slope, 6) AS value FROM k WHERE slope > {RISING} UNION ALL SELECT event_type, metric, 'surge', 'critical', round(share, 6) FROM k WHERE share > {SURGE}
        UNION ALL SELECT event_type, metric, 'outlier', CASE WHEN abs(z) > 3.5 THEN 'critical' ELSE 'warning' END, round(z, 6) FROM k WHERE abs(z) >= {FAR} UNION ALL SELECT event_type, metric, 'volatility', 'info', round(cv, 6) FROM k WHERE volatility > 0.1 AND cv > {VOLATILE}""",
    "event_drift": """WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS c FROM events GROUP BY 1, 2), m AS (SELECT day, lag(day) OVER (ORDER BY day) AS b FROM (SELECT DISTINCT day FROM c)), n AS (SELECT day, event_type, c / sum(c) OVER (PARTITION BY day) AS p FROM c),
        t AS (SELECT day, b, event_type FROM m, (SELECT DISTINCT event_type FROM c) WHERE b IS NOT NULL), j AS (SELECT t.day, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q FROM t LEFT JOIN n x ON x.day = t.day AND x.event_type = t.event_type LEFT JOIN n y ON y.day = t.b AND y.event_type = t.event_type)
        SELECT day, round(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 6) AS divergence FROM j GROUP BY 1""",
    "pair_hotspots": f"""SELECT least(a.source, b.source) AS source_a, greatest(a.source, b.source) AS source_b, count(*) AS pairs, round(avg(sim), 6) AS mean, round(max(sim), 6) AS highest FROM ({PAIR_SQL['near_copies_word_jaccard']}) p JOIN documents a ON a.doc_id = doc_a JOIN documents b ON b.doc_id = doc_b WHERE sim >= {HOT} GROUP BY 1, 2""",
    "version_drift": f"WITH n AS ({texts.SQL['conversation_neighbours']}) SELECT conv_id, count(*) + 1 AS versions, round(avg(jaccard), 4) AS mean, round(min(jaccard), 6) AS least FROM n GROUP BY 1 ORDER BY 3, 1 LIMIT 20",
    "version_most_revised": "SELECT conv_id, count(*) AS versions, count(DISTINCT role) AS roles FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "export_pages": f"WITH p AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // {PAGE} AS page FROM orders) SELECT page, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM p GROUP BY 1",
    "text_sentences_masked": f"SELECT doc_id, greatest(1, len(regexp_extract_all({MASKED} || ' ', '{ENDS}'))) AS sentences FROM documents",
    "text_without_phrases": f"WITH k AS (SELECT doc_id, regexp_replace({T}, '(?i){'|'.join(IGNORED)}', '', 'g') AS t FROM documents) SELECT doc_id, length(t) AS chars, md5(t) AS kept_md5 FROM k",
}
