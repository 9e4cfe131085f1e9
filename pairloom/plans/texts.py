"""Queries on text columns of documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import text as fn
from pairloom.operators import passages
from pairloom.operators.filters import search_expression
from pairloom.runtime import cut, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _rounded(columns: dict, digits: int = 6) -> list:
    return [F.round(c, digits).alias(k) for k, c in columns.items()]


def text_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words, distinct words, sentences and characters of every document."""
    return _docs(spark, d).select("doc_id", fn.count_words("text").alias("words"), fn.count_unique_words("text").alias("unique_words"), F.size(fn.sentences("text")).cast("long").alias("sentences"), F.length("text").cast("long").alias("chars"))


def text_richness(spark: SparkSession, d: str) -> DataFrame:
    counts = _docs(spark, d).select("doc_id", fn.count_words("text").alias("n"), fn.count_unique_words("text").alias("v"))
    return counts.select("doc_id", *_rounded(fn.richness_of(F.col("n"), F.col("v"))))


def text_readability(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", fn.measures("text").alias("m")).select("doc_id", *_rounded(fn.readability(F.col("m"))))


def text_readability_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Range of the reading grade by source, and whether it is at most 2."""
    measured = _docs(spark, d).select("source", fn.measures("text").alias("m"))
    made = measured.select("source", fn.readability(F.col("m"))["flesch_grade"].alias("g")).groupBy("source")
    return made.agg(F.round(F.min("g"), 4).alias("least"), F.round(F.max("g"), 4).alias("most"), (F.max("g") - F.min("g") <= 2).alias("homogeneous"))


def text_token_set(spark: SparkSession, d: str) -> DataFrame:
    """Size of the token set without stop words, and the text without them as a digest."""
    return _docs(spark, d).select("doc_id", F.size(fn.token_set("text")).cast("long").alias("tokens"), F.md5(fn.without_stop_words("text")).alias("kept_md5"))


def text_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Distinct word trigrams of every document."""
    return _docs(spark, d).select("doc_id", F.size(F.array_distinct(fn.ngrams(fn.words("text"), 3))).cast("long").alias("trigrams"))


def text_clean(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(fn.clean("text")).alias("clean_md5"), F.length(fn.clean("text")).cast("long").alias("chars"))


def text_masked(spark: SparkSession, d: str) -> DataFrame:
    t = fn.mask_entities("text")
    return _docs(spark, d).select("doc_id", *[F.regexp_count(t, F.lit(rf"\[{m}\]")).cast("long").alias(m.lower()) for m in ("EMAIL", "DATE", "NUMBER")])


def text_marker_language(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", fn.marker_language("text").alias("language"))


def text_script(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy(fn.script("text").alias("script")).agg(F.count("*").alias("n"))


def text_obfuscation(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", *_rounded(fn.obfuscation("text")))


def text_language_stats(spark: SparkSession, d: str) -> DataFrame:
    """Documents, words and mean length by language."""
    made = _docs(spark, d).select("lang", fn.count_words("text").alias("w")).groupBy("lang")
    return made.agg(F.count("*").alias("documents"), F.sum("w").alias("words"), F.round(F.avg("w"), 4).alias("mean_words"))


def text_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 500 words every 250 words: words and type-token ratio of each."""
    w = _docs(spark, d).select("doc_id", F.posexplode(fn.window_texts("text", 500, 250)).alias("window", "w"))
    n = F.size("w")
    return w.select("doc_id", "window", n.cast("long").alias("words"), F.when(n > 0, F.round(F.size(F.array_distinct("w")) / n, 6)).otherwise(0.0).alias("ttr"))


def text_word_frequency(spark: SparkSession, d: str) -> DataFrame:
    """The hundred most frequent words; ties by word."""
    w = _docs(spark, d).select(F.explode(fn.words("text")).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


def text_hapax(spark: SparkSession, d: str) -> DataFrame:
    """Words that occur once or twice, and Yule's K, by language."""
    w = _docs(spark, d).select("lang", F.explode(fn.words("text")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("c"))
    by = w.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("hapax"), F.count_if(F.col("c") == 2).alias("dis"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s"))
    return by.select("lang", "hapax", "dis", F.round(F.lit(10000.0) * (F.col("s") - F.col("n")) / (F.col("n").cast("double") * F.col("n")), 6).alias("yule_k"))


def text_repeated_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of 20 words that two or more documents hold, the twenty most common."""
    docs = _docs(spark, d).select("doc_id", fn.words("text").alias("w"))
    return passages.repeated_phrases(docs, "doc_id", "w").select("phrase", "documents")


def text_search(spark: SparkSession, d: str) -> DataFrame:
    """A search expression over text and fields."""
    return _docs(spark, d).where(search_expression('license -lang:fr "this work"', "text", ["lang"])).select("doc_id", "lang")


def text_exact_hash(spark: SparkSession, d: str) -> DataFrame:
    """Groups of documents with equal normalised text: smallest id, size."""
    same = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)
    made = _docs(spark, d).groupBy(same.alias("same")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return made.where("copies > 1").select("first_id", "copies")


def text_duplicate_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of 40 characters or more that occur in several documents, the fifty most common."""
    lines = _docs(spark, d).select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.length("line") >= 40)
    return lines.groupBy("line").agg(F.count("*").alias("documents")).where("documents > 1").orderBy(F.desc("documents"), "line").limit(50)


def page_text(spark: SparkSession, d: str) -> DataFrame:
    t = fn.html_text("html")
    return table(spark, d, "pages").select("page_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("text_md5"))


def page_layout(spark: SparkSession, d: str) -> DataFrame:
    tags = fn.html_layout("html")
    return table(spark, d, "pages").select("page_id", F.size(tags).cast("long").alias("tags"), F.array_join(F.array_distinct(tags), ",").alias("kinds"))


def conversation_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Word Jaccard of each turn and the turn before."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(fn.words("text")).alias("w"))
    a, b = rows.alias("a"), rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("before"))
    both = a.join(b, ["conv_id", "turn"])
    union = F.size(F.array_union("w", "before"))
    return both.select("conv_id", "turn", F.when(union > 0, F.round(F.size(F.array_intersect("w", "before")) / union, 6)).otherwise(1.0).alias("jaccard"))


QUERIES = {f.__name__: f for f in (
    text_counts, text_richness, text_readability, text_readability_by_source, text_token_set, text_ngrams, text_clean, text_masked, text_marker_language, text_script,
    text_obfuscation, text_language_stats, text_windows, text_word_frequency, text_hapax, text_repeated_phrases, text_search, text_exact_hash, text_duplicate_lines,
    page_text, page_layout, conversation_neighbours,
)}

# Parts of the SQL below.
T = "coalesce(text, '')"
W = f"regexp_extract_all(lower({T}), '[\\p{{L}}\\p{{N}}_]+')"
S = f"list_filter(list_transform(string_split_regex(regexp_replace({T}, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x, ' ')), lambda x: x <> '')"
SYL = "greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN regexp_matches(x, '[^aeiouyl]e$') AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)"
READ = f"""r0 AS (SELECT doc_id, source, {W} AS w, greatest(1, len({S})) AS s FROM documents), r1 AS (
  SELECT doc_id, source, len(w) AS n, s, coalesce(list_sum(list_transform(w, lambda x: {SYL})), 0) AS y, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS l FROM r0
), r AS (SELECT doc_id, source,
  CASE WHEN n > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * (n / s::DOUBLE) - 84.6::DOUBLE * (y / n::DOUBLE) ELSE 0 END AS flesch_ease,
  CASE WHEN n > 0 THEN 0.39::DOUBLE * (n / s::DOUBLE) + 11.8::DOUBLE * (y / n::DOUBLE) - 15.59::DOUBLE ELSE 0 END AS flesch_grade,
  CASE WHEN n > 0 THEN 0.0588::DOUBLE * (l / n::DOUBLE * 100) - 0.296::DOUBLE * (s / n::DOUBLE * 100) - 15.8::DOUBLE ELSE 0 END AS coleman_liau FROM r1)"""
STOP = "[" + ", ".join(f"'{x}'" for x in fn.STOP_WORDS) + "]"
TOKENS = f"list_filter(regexp_extract_all(lower({T}), '{fn.TOKEN.replace(chr(39), chr(39) * 2)}'), lambda x: NOT list_contains({STOP}, x))"
ZERO, ALIKE = fn.ZERO_WIDTH, fn.LOOKALIKE


def _count(chars: str) -> str:
    return f"(length({T}) - length(translate({T}, '{chars}', '')))"


CLEAN = f"trim(regexp_replace(translate(translate({T}, '{ZERO}', ''), '{fn.CURLY}', '{fn.PLAIN.replace(chr(39), chr(39) * 2)}'), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g'), ' ')"
MASK = T
for pattern, mark in ((r"[\w.+-]+@[\w-]+\.[\w.]+", "[EMAIL]"), (r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b", "[DATE]"), (r"\b\d{6,}\b", "[NUMBER]")):
    MASK = f"regexp_replace({MASK}, '{pattern}', '{mark}', 'g')"
LANGS = ", ".join(f"{{'s': -(len(list_filter(w, lambda x: list_contains([{', '.join(repr(x) for x in m)}], x))) / greatest(1, len(w))::DOUBLE), 'code': '{k}'}}" for k, m in sorted(fn.MARKERS.items()))
BLOCKS = ", ".join(f"{{'n': -len(regexp_extract_all({T}, '\\p{{{k.title()}}}')), 'script': '{k}'}}" for k in ("arabic", "cyrillic", "greek", "han", "latin"))
PAGE = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g')"
for tag in fn.DROPPED_TAGS:
    PAGE = f"regexp_replace({PAGE}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
PAGE = f"regexp_replace({PAGE}, '(?s)<[^>]*>', ' ', 'g')"
for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    PAGE = f"replace({PAGE}, '{entity}', '{to}')"
PAGE = f"trim(regexp_replace({PAGE}, '\\s+', ' ', 'g'), ' ')"

SQL = {
    "text_counts": f"SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS unique_words, s AS sentences, chars FROM (SELECT doc_id, {W} AS w, len({S}) AS s, length(text) AS chars FROM documents)",
    "text_richness": f"""SELECT doc_id, round(CASE WHEN n > 0 THEN v / n::DOUBLE ELSE 0 END, 6) AS ttr, round(CASE WHEN n > 0 THEN v / sqrt(n) ELSE 0 END, 6) AS guiraud_r,
        round(CASE WHEN n > 1 AND v > 0 THEN ln(v) / ln(n) ELSE 0 END, 6) AS herdan_c FROM (SELECT doc_id, len({W}) AS n, len(list_distinct({W})) AS v FROM documents)""",
    "text_readability": f"WITH {READ} SELECT doc_id, round(flesch_ease, 6) AS flesch_ease, round(flesch_grade, 6) AS flesch_grade, round(coleman_liau, 6) AS coleman_liau FROM r",
    "text_readability_by_source": f"WITH {READ} SELECT source, round(min(flesch_grade), 4) AS least, round(max(flesch_grade), 4) AS most, max(flesch_grade) - min(flesch_grade) <= 2 AS homogeneous FROM r GROUP BY 1",
    "text_token_set": f"SELECT doc_id, len(list_distinct(t)) AS tokens, md5(array_to_string(t, ' ')) AS kept_md5 FROM (SELECT doc_id, {TOKENS} AS t FROM documents)",
    "text_ngrams": f"""WITH w AS (SELECT doc_id, {W} AS w FROM documents)
        SELECT doc_id, len(list_distinct(list_transform(range(1, greatest(1, len(w) - 1)), lambda i: array_to_string(w[i:i + 2], ' ')))) AS trigrams FROM w""",
    "text_clean": f"SELECT doc_id, md5({CLEAN}) AS clean_md5, length({CLEAN}) AS chars FROM documents",
    "text_masked": f"SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(m, '\\[{x}\\]')) AS {x.lower()}" for x in ("EMAIL", "DATE", "NUMBER")) + f" FROM (SELECT doc_id, {MASK} AS m FROM documents)",
    "text_marker_language": f"WITH w AS (SELECT doc_id, {W} AS w FROM documents), b AS (SELECT doc_id, list_min([{LANGS}]) AS b FROM w) SELECT doc_id, CASE WHEN -b.s > 0.15 THEN b.code ELSE 'unknown' END AS language FROM b",
    "text_script": f"WITH b AS (SELECT list_min([{BLOCKS}]) AS b FROM documents) SELECT CASE WHEN b.n < 0 THEN b.script ELSE 'none' END AS script, count(*) AS n FROM b GROUP BY 1",
    "text_obfuscation": f"""WITH c AS (SELECT doc_id, greatest(1, length({T}))::DOUBLE AS n, {_count(ZERO)} AS z, {_count(ALIKE)} AS a, len(regexp_extract_all({T}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')) AS k FROM documents)
        SELECT doc_id, round(z / n, 6) AS zero_width, round(a / n, 6) AS lookalike, round(k / n, 6) AS control, round(least(1.0, (z * 10 + a * 5 + k * 5) / n), 6) AS score FROM c""",
    "text_language_stats": f"SELECT lang, count(*) AS documents, CAST(sum(len({W})) AS BIGINT) AS words, round(avg(len({W})), 4) AS mean_words FROM documents GROUP BY 1",
    "text_windows": f"""WITH w AS (SELECT doc_id, {W} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 499) + 1, 250)) AS i FROM w), x AS (SELECT doc_id, CAST((i - 1) // 250 AS INTEGER) AS "window", w[i:i + 499] AS w FROM s)
        SELECT doc_id, "window", len(w) AS words, CASE WHEN len(w) > 0 THEN round(len(list_distinct(w)) / len(w)::DOUBLE, 6) ELSE 0.0 END AS ttr FROM x""",
    "text_word_frequency": f"WITH w AS (SELECT unnest({W}) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "text_hapax": f"""WITH w AS (SELECT lang, unnest({W}) AS word FROM documents), c AS (SELECT lang, word, count(*) AS c FROM w GROUP BY 1, 2)
        SELECT lang, count(*) FILTER (c = 1) AS hapax, count(*) FILTER (c = 2) AS dis, round(10000.0::DOUBLE * (sum(c * c) - sum(c))::DOUBLE / (sum(c)::DOUBLE * sum(c)), 6) AS yule_k FROM c GROUP BY 1""",
    "text_repeated_phrases": f"""WITH w AS (SELECT doc_id, {W} AS w FROM documents), p AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(1, len(w) - 18)), lambda i: array_to_string(w[i:i + 19], ' ')))) AS phrase FROM w)
        SELECT phrase, count(*) AS documents FROM p GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 20""",
    "text_search": "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') AND NOT lang = 'fr' AND contains(lower(text), 'this work')",
    "text_exact_hash": "SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY trim(regexp_replace(lower(text), '[\\s\\x0b]+', ' ', 'g'), ' ') HAVING count(*) > 1",
    "text_duplicate_lines": "WITH l AS (SELECT doc_id, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents) SELECT line, count(*) AS documents FROM l WHERE length(line) >= 40 GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "page_text": f"SELECT page_id, length({PAGE}) AS chars, md5({PAGE}) AS text_md5 FROM pages",
    "page_layout": """WITH t AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?i)<(h[1-6]|p|ul|ol|li|table|tr|td|div|section|article|blockquote|pre)\\b', 1), lambda x: lower(x)) AS t FROM pages),
        u AS (SELECT page_id, unnest(t) AS tag, generate_subscripts(t, 1) AS i FROM t), k AS (SELECT page_id, tag, min(i) AS i FROM u GROUP BY 1, 2), s AS (SELECT page_id, string_agg(tag, ',' ORDER BY i) AS kinds FROM k GROUP BY 1)
        SELECT page_id, len(t) AS tags, coalesce(kinds, '') AS kinds FROM t LEFT JOIN s USING (page_id)""",
    "conversation_neighbours": f"""WITH w AS (SELECT conv_id, turn, list_distinct({W}) AS w FROM conversations)
        SELECT a.conv_id, a.turn, CASE WHEN len(a.w) + len(b.w) > 0 THEN round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE, 6) ELSE 1.0 END AS jaccard
        FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""",
}
