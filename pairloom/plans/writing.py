"""Queries on marks inside texts, on how texts are written and on pairs of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import markup, style
from pairloom.functions.extract import APA, IEEE, citation_keys
from pairloom.functions.similarity import cosine, jaccard
from pairloom.functions.text import count_words, script, words
from pairloom.operators import writing
from pairloom.plans import similarity as sim_plans
from pairloom.plans.similarity import NEXT, SET, UNIT
from pairloom.plans.texts import BLOCKS, T, W
from pairloom.runtime import bounded_batches, cut, table

#: Weight of meaning in a hybrid score, and the score from which a pair is flagged.
ALPHA, FLAGGED = 0.7, 0.5
RULES = (("type_token_ratio", 0.4, 30), ("avg_sentence_length", 8.0, 30), ("avg_word_length", 4.0, 20), ("punctuation_frequency", 5.0, 20))


#: SQL of a LaTeX source of a part, and of a document with citations at its end.
PART_SOURCE = r"concat('\DocumentClass[11pt]{', lower(replace(p_type, ' ', '')), '} \usepackage[x]{', replace(p_name, ' ', ','), '} \noindent\begin{', lower(replace(p_brand, '#', '')), '*} \def\a', p_size, '{} \renewcommand{\b}{c} \beginner{no}')"
CITING = "concat(coalesce(text, ''), '. It was shown before [', CAST(doc_id % 20 AS VARCHAR(9)), ', 7]. Others agree (Smith, ', CAST(1990 + doc_id % 30 AS VARCHAR(9)), '). This ends it.')"
REFERENCES = "concat('Smith, J. (', CAST(1990 + doc_id % 30 AS VARCHAR(9)), '). Report ', CAST(doc_id % 7 AS VARCHAR(9)), '.', chr(10), '[1] A. Jones, \"On ', lang, ',\" Press, 2011.', chr(10), 'no reference (1899). Here.')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _next(spark: SparkSession, d: str) -> DataFrame:
    """Each document and the one of the following id, as two versions of a text."""
    docs = _docs(spark, d).select("doc_id", "text")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("doc_b"), F.col("text").alias("text_b"))
    return docs.join(following, "doc_id").select(F.col("doc_id").alias("doc_a"), "doc_b", F.col("text").alias("text_a"), "text_b")


def turn_rhetoric(spark: SparkSession, d: str) -> DataFrame:
    """Rhetorical class of every turn."""
    return table(spark, d, "conversations").select("conv_id", "turn", markup.rhetorical_class("text").alias("class"))


def text_macros(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(markup.macros("text"), ",").alias("macros"))


def part_macros(spark: SparkSession, d: str) -> DataFrame:
    """Names in a LaTeX source made from each part's maker, name and brand."""
    return table(spark, d, "part").select("p_partkey", F.array_join(markup.macros(F.expr(PART_SOURCE.replace("\\", "\\\\"))), ",").alias("macros"))


def text_hidden_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of zero-width characters, their characters, and the mark they hide."""
    runs = markup.hidden_runs("text")
    return _docs(spark, d).select("doc_id", F.size(runs).cast("long").alias("runs"), F.length(F.array_join(runs, "")).cast("long").alias("chars"), markup.hidden_mark("text").alias("mark"))


def part_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of parts by their type and name."""
    return table(spark, d, "part").select("p_partkey", F.array_join(markup.tags(F.concat_ws(", ", "p_type", "p_name", "p_brand")), " ").alias("tags"))


def citation_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Sentences around each citation."""
    return _contexts(_docs(spark, d))


def citation_contexts_made(spark: SparkSession, d: str) -> DataFrame:
    """Sentences around each citation of documents that end in two."""
    return _contexts(_docs(spark, d).select("doc_id", F.expr(CITING).alias("text")))


def _contexts(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", F.explode(markup.cited("text")).alias("c"))
    return found.select("doc_id", F.col("c.sentence").cast("long").alias("sentence"), F.col("c.key").alias("key"), F.md5("c.context").alias("context_md5"))


def citation_references(spark: SparkSession, d: str) -> DataFrame:
    """Numbered citations with the benchmark item of that number as the reference; empty if there is none."""
    return _referred(spark, d, _docs(spark, d))


def citation_references_made(spark: SparkSession, d: str) -> DataFrame:
    """The same of documents that end in citations."""
    return _referred(spark, d, _docs(spark, d).select("doc_id", F.expr(CITING).alias("text")))


def text_citations_made(spark: SparkSession, d: str) -> DataFrame:
    """Citation keys that two or more lists of references, made for each document, share."""
    keys = _docs(spark, d).select("doc_id", F.explode(citation_keys(F.expr(REFERENCES))).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("documents")).where("documents > 1")


def _referred(spark: SparkSession, d: str, docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", F.explode(markup.cited("text")).alias("c"))
    cited = found.select("doc_id", F.trim(F.split(F.col("c.key"), r"[,\-]")[0]).alias("item"))
    items = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("reference"))
    return cited.join(items, "item", "left").select("doc_id", "item", F.length(F.coalesce("reference", F.lit(""))).cast("long").alias("chars"))


def text_nfc(spark: SparkSession, d: str) -> DataFrame:
    bounded_batches(spark)
    return _docs(spark, d).select("doc_id", F.md5(markup.normal_form("text", "NFC")).alias("nfc_md5"))


def text_nfkc(spark: SparkSession, d: str) -> DataFrame:
    """Compatibility form; SQL has none, so tests hold it against Python's."""
    bounded_batches(spark)
    return _docs(spark, d).select("doc_id", F.md5(markup.normal_form("text", "NFKC")).alias("nfkc_md5"))


def page_style_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of each page's tag names, and a fingerprint of the set of them."""
    names = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)
    pages = table(spark, d, "pages").select("page_id", names.alias("n"))
    prints = pages.select("page_id", F.size("n").cast("long").alias("tags"), F.sha2(F.array_join(F.array_sort(F.array_distinct("n")), ","), 256).alias("fingerprint"))
    counts = pages.select("page_id", F.explode("n").alias("x")).groupBy("page_id", "x").agg(F.count("*").alias("c"))
    c = F.col("c")
    bits = counts.groupBy("page_id").agg((F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c)).alias("e"))
    return prints.join(bits, "page_id", "left").select("page_id", "tags", F.round(F.coalesce("e", F.lit(0.0)), 4).alias("entropy"), "fingerprint")


def style_paraphrase(spark: SparkSession, d: str) -> DataFrame:
    return writing.paraphrase_prints(_docs(spark, d), "doc_id", "text")


def style_profile(spark: SparkSession, d: str) -> DataFrame:
    return writing.profiles(_docs(spark, d), "doc_id", "text")


def style_deviation(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each document's profile from the mean of its source."""
    made = cut(writing.profiles(_docs(spark, d), "doc_id", "text"))
    return writing.deviations(made.join(_docs(spark, d).select("doc_id", "source"), "doc_id"), "doc_id", "source")


def text_rubric(spark: SparkSession, d: str) -> DataFrame:
    """Points of a rubric on profiles."""
    return writing.rubric(writing.profiles(_docs(spark, d), "doc_id", "text"), "doc_id", list(writing.WEIGHTS), RULES)


def pair_drift(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and structural drift between neighbouring documents; obfuscated below an invariance of 0.6."""
    made = _next(spark, d).select("doc_a", "doc_b", *[c.alias(k) for k, c in writing.drift("text_a", "text_b").items()])
    kept = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.col("lexical_drift") * 0.7 + F.col("structural_variance") * 0.3)))
    return made.select("doc_a", "doc_b", F.round("lexical_drift", 4).alias("lexical_drift"), F.round("structural_variance", 4).alias("structural_variance"), F.round(kept, 4).alias("invariance"), (kept < 0.6).alias("obfuscated"))


def pair_two_text_tf_idf(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF cosine of neighbours, each pair its own corpus; below 0.15 the pair counts as unrelated."""
    own = _docs(spark, d).select(F.col("doc_id").alias("doc_a"), writing.word_hashes(words("text")).alias("a"))
    following = own.select((F.col("doc_a") - 1).alias("doc_a"), F.col("doc_a").alias("doc_b"), F.col("a").alias("b"))
    made = own.join(following, "doc_a").select("doc_a", "doc_b", writing.row_tf_idf(F.col("a"), F.col("b")).alias("sim"))
    return made.select("doc_a", "doc_b", F.round("sim", 6).alias("sim"), (F.round("sim", 6) < 0.15).alias("unrelated"))


def pair_shared_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of a document that its neighbour holds too."""
    made = _next(spark, d).select("doc_a", "doc_b", writing.shared_segments("text_a", "text_b").alias("s"))
    return made.select("doc_a", "doc_b", F.size("s").cast("long").alias("segments"), F.md5(F.array_join("s", "\n")).alias("segments_md5"))


def pair_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of a document with a match of 0.3 or more in its neighbour: number, coverage, best and mean."""
    made = _next(spark, d).select("doc_a", "doc_b", writing.paragraph_matches("text_a", "text_b").alias("m"))
    rows = made.select("doc_a", "doc_b", F.explode_outer("m").alias("p")).groupBy("doc_a", "doc_b")
    s = F.col("p.score")
    hit = s >= 0.3
    made = rows.agg(F.count("p").alias("paragraphs"), F.count_if(hit).alias("matched"), F.max(F.when(hit, s)).alias("x"), F.avg(F.when(hit, s)).alias("a"))
    share = F.when(F.col("paragraphs") > 0, F.round(F.col("matched") / F.col("paragraphs"), 4)).otherwise(0.0)
    return made.select("doc_a", "doc_b", "paragraphs", "matched", share.alias("coverage"), F.round(F.coalesce("x", F.lit(0.0)), 4).alias("best"), F.round(F.coalesce("a", F.lit(0.0)), 4).alias("mean"))


def pair_cross_script(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard of neighbours of one script; 0 across scripts."""
    same = F.col("same_script")
    pairs = _next(spark, d).withColumn("same_script", script("text_a") == script("text_b"))
    return pairs.select("doc_a", "doc_b", same, F.when(same, F.round(jaccard("text_a", "text_b"), 6)).otherwise(0.0).alias("sim"))


def pair_lexical_methods(spark: SparkSession, d: str) -> DataFrame:
    """Six lexical scores of neighbours side by side."""
    keys = ["doc_a", "doc_b"]
    tf = sim_plans.tf_idf_neighbours(spark, d).withColumnRenamed("sim", "tf_idf")
    return sim_plans.pair_metrics(spark, d).join(tf, keys).join(sim_plans.bm25_neighbours(spark, d).withColumnRenamed("sim", "bm25"), keys)


def pair_hybrid_parts(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid score of neighbours with its parts: vectors of the same ids for meaning, token Jaccard for words."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    a, b = v.select(F.col("vec_id").alias("doc_a"), F.col("embedding").alias("va")), v.select(F.col("vec_id").alias("doc_b"), F.col("embedding").alias("vb"))
    made = _next(spark, d).select("doc_a", "doc_b", jaccard("text_a", "text_b").alias("lexical")).join(a, "doc_a").join(b, "doc_b")
    made = made.select("doc_a", "doc_b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("semantic"), F.round("lexical", 6).alias("lexical"))
    score = F.round(ALPHA * F.col("semantic") + (1 - ALPHA) * F.col("lexical"), 4)
    return made.select("doc_a", "doc_b", "semantic", "lexical", score.alias("hybrid"), (score >= FLAGGED).alias("flagged"))


def turn_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Token Jaccard of each user turn and the answer after it."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    answer = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return rows.where("role = 'user'").join(answer, ["conv_id", "turn"]).select("conv_id", "turn", F.round(jaccard("text", "answer"), 6).alias("coherence"))


QUERIES = {f.__name__: f for f in (
    turn_rhetoric, text_macros, text_hidden_runs, part_tags, citation_contexts, citation_references, citation_contexts_made, citation_references_made, text_citations_made, part_macros, text_nfc, text_nfkc, page_style_entropy, style_paraphrase, style_profile, style_deviation,
    text_rubric, pair_drift, pair_two_text_tf_idf, pair_shared_segments, pair_paragraphs, pair_cross_script, pair_lexical_methods, pair_hybrid_parts, turn_coherence,
)}

B = r"[\s\x0b]"
STRIP = f"regexp_replace({{0}}, '^{B}+|{B}+$', '', 'g')"
PIECES = f"string_split(regexp_replace({STRIP}, '([.!?]){B}+', '\\1' || chr(1), 'g'), chr(1))"
N_BLANK = f"len(list_filter(string_split_regex(x, '{B}+'), lambda y: y <> ''))"
WORDS = "[\\p{L}\\p{N}_]+"
CLASS = "CASE " + " ".join(f"WHEN h = '{w}' THEN '{n}'" for w, n in markup.HEADINGS.items()) + " " + " ".join(f"WHEN regexp_matches(t, '(?i)\\b{p}\\b') THEN '{n}'" for n, p in markup.RHETORIC) + " ELSE 'CLAIM' END"
SEQ = markup.SEQUENCE.replace("'", "''")
KINDS = [(kind, ", ".join(f"'{n}'" for n, k in markup.NAMING.items() if k == kind)) for kind in dict.fromkeys(markup.NAMING.values())]
NAMED = " || ".join(f"list_transform(list_filter(flatten(list_transform(list_filter(list_zip(b, n), lambda x: lower(x[1]) IN ({names})), lambda x: string_split(x[2], ','))), lambda x: x <> ''), lambda x: '{kind}:' || x)" for kind, names in KINDS)
MACROS = f"array_to_string({NAMED}, ',') AS macros"


def _macros_sql(rows: str) -> str:
    """Of rows of a key ``k`` and a source ``s``."""
    return f"WITH r AS ({rows}), z AS (SELECT k, regexp_extract_all(s, '{SEQ}', 1) AS b, regexp_extract_all(s, '{SEQ}', 2) AS n FROM r)"


TOTALS = f"w AS (SELECT doc_id, source, {T} AS t, {W} AS w FROM documents), c AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY 1, 2), m AS (SELECT doc_id, sum(c) AS n, count(*) AS v, sum(c * c) AS q, sum(c * log2(c)) AS e, sum(c * length(x)) AS l FROM c GROUP BY 1)"


def _var(a: str, digits: int) -> str:
    s, q = f"list_sum({a})::DOUBLE", f"list_sum(list_transform({a}, lambda z: z * z))::DOUBLE"
    return f"round(CASE WHEN len({a}) > 1 THEN ({q} - {s} * {s} / len({a})) / (len({a}) - 1) ELSE 0 END, {digits})"


PROFILE = f"""{TOTALS}, s AS (SELECT *, list_transform(list_filter({PIECES.format('t')}, lambda x: x <> ''), lambda x: len(regexp_extract_all(x, '{WORDS}'))) AS a, length(regexp_replace(t, '[^.!?;:,''"()\\[\\]{{}}\\-]', '', 'g')) AS k FROM w),
 profile AS (SELECT s.doc_id, source, round(CASE WHEN n > 0 THEN v / n::DOUBLE ELSE 0 END, 6) AS type_token_ratio, round(CASE WHEN len(a) > 0 THEN list_sum(a) / len(a)::DOUBLE ELSE 0 END, 6) AS avg_sentence_length, {_var('a', 6)} AS sentence_length_variance,
  round(CASE WHEN n > 0 THEN l / n::DOUBLE ELSE 0 END, 6) AS avg_word_length, round(CASE WHEN n > 0 THEN k / n::DOUBLE * 100 ELSE 0 END, 6) AS punctuation_frequency,
  round(CASE WHEN n > 0 THEN greatest(0.0, (q / (n::DOUBLE * n::DOUBLE) - 1 / n::DOUBLE) * 10000) ELSE 0 END, 6) AS yules_k FROM s LEFT JOIN m USING (doc_id))"""
POINTS = " + ".join(f"CASE WHEN {m} >= {x} THEN {p} ELSE 0 END" for m, x, p in RULES)
TOOL = ", ".join(f"{{'s': -1 / (1 + sqrt(pow(synonym_entropy - {e}::DOUBLE, 2) + pow(transition_anomaly - {p}::DOUBLE, 2))), 'tool': '{t}'}}" for t, (e, p) in writing.TOOLS.items())
BE = "[" + ", ".join(f"'{x}'" for x in writing.TO_BE) + "]"
JAC = """CASE WHEN text_a = '' OR text_b = '' THEN 0 WHEN len(x) = 0 AND len(y) = 0 THEN 1 ELSE len(list_intersect(x, y)) / greatest(1, len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE END"""
BOTH = f"{NEXT}, j AS (SELECT doc_a, doc_b, coalesce(text_a, '') AS text_a, coalesce(text_b, '') AS text_b, {SET.format('text_a')} AS x, {SET.format('text_b')} AS y FROM n)"
CITED = f"""s0 AS (SELECT doc_id, {PIECES.format(T)} AS p FROM documents), s1 AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM s0),
 s2 AS (SELECT doc_id, i - 1 AS sentence, array_to_string(p[greatest(1, i - 1):i + 1], ' ') AS context, list_concat(regexp_extract_all(p[i], '{markup.NUMBERED}', 1), regexp_extract_all(p[i], '{markup.AUTHOR_YEAR}', 1)) AS k FROM s1),
 cited AS (SELECT doc_id, sentence, context, unnest(k) AS key FROM s2)"""
PARAS = f"list_filter(list_transform(string_split_regex(coalesce({{0}}, ''), '\\n{B}*\\n'), lambda x: {STRIP.format('x')}), lambda x: x <> '' AND {N_BLANK} >= 5)"

SQL = {
    "turn_rhetoric": f"WITH t AS (SELECT conv_id, turn, {T} AS t, lower(regexp_replace({STRIP.format(T)}, '[.:]+$', '')) AS h FROM conversations) SELECT conv_id, turn, {CLASS} AS class FROM t",
    "text_macros": _macros_sql(f"SELECT doc_id AS k, {T} AS s FROM documents") + f" SELECT k AS doc_id, {MACROS} FROM z",
    "part_macros": _macros_sql(f"SELECT p_partkey AS k, {PART_SOURCE} AS s FROM part") + f" SELECT k AS p_partkey, {MACROS} FROM z",
    "text_hidden_runs": f"""WITH r AS (SELECT doc_id, regexp_extract_all({T}, '[{markup.HIDDEN}]+') AS r, regexp_extract({T}, '{markup.BEGIN}([{markup.ZERO}{markup.ONE}]+){markup.END}', 1) AS f, regexp_replace({T}, '[^{markup.ZERO}{markup.ONE}]', '', 'g') AS l FROM documents),
        b AS (SELECT doc_id, r, lpad(substr(translate(CASE WHEN f <> '' THEN f WHEN length(l) >= 128 THEN l END, '{markup.ZERO}{markup.ONE}', '01'), 1, 128), 128, '0') AS b FROM r)
        SELECT doc_id, len(r) AS runs, length(array_to_string(r, '')) AS chars, CASE WHEN b IS NOT NULL THEN array_to_string(list_transform(range(0, 32), lambda i: substr('0123456789abcdef', CAST(1 + 8 * CAST(b[4 * i + 1] AS INTEGER) + 4 * CAST(b[4 * i + 2] AS INTEGER) + 2 * CAST(b[4 * i + 3] AS INTEGER) + CAST(b[4 * i + 4] AS INTEGER) AS BIGINT), 1)), '') END AS mark FROM b""",
    "part_tags": """WITH t AS (SELECT p_partkey, string_split_regex(lower(concat_ws(', ', p_type, p_name, p_brand)), '[,\\s]+') AS t FROM part)
        SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(t, lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: regexp_matches(x, '[a-z]')), lambda x: '#' || x))), ' ') AS tags FROM t""",
    "citation_contexts": f"WITH {CITED} SELECT doc_id, sentence, key, md5(context) AS context_md5 FROM cited",
    "citation_references": f"WITH {CITED} SELECT doc_id, i AS item, length(coalesce(b.text, '')) AS chars FROM (SELECT doc_id, trim(string_split_regex(key, '[,\\-]')[1], ' ') AS i FROM cited) LEFT JOIN benchmark b ON CAST(b.item_id AS VARCHAR) = i",
    "citation_contexts_made": f"WITH {CITED.replace(T, CITING)} SELECT doc_id, sentence, key, md5(context) AS context_md5 FROM cited",
    "citation_references_made": f"WITH {CITED.replace(T, CITING)} SELECT doc_id, i AS item, length(coalesce(b.text, '')) AS chars FROM (SELECT doc_id, trim(string_split_regex(key, '[,\\-]')[1], ' ') AS i FROM cited) LEFT JOIN benchmark b ON CAST(b.item_id AS VARCHAR) = i",
    "text_citations_made": f"""WITH l AS (SELECT doc_id, unnest(string_split({REFERENCES}, chr(10))) AS l FROM documents), k AS (SELECT DISTINCT doc_id, CASE WHEN regexp_matches(l, '{APA}') THEN sha256(lower(trim(regexp_extract(l, '{APA}', 1))) || '|' || regexp_extract(l, '{APA}', 2) || '|' || lower(trim(regexp_extract(l, '{APA}', 3))))
        WHEN regexp_matches(l, '{IEEE}') THEN sha256(lower(trim(regexp_extract(l, '{IEEE}', 1))) || '|' || regexp_extract(l, '{IEEE}', 3) || '|' || lower(trim(regexp_extract(l, '{IEEE}', 2)))) END AS key FROM l) SELECT key, count(*) AS documents FROM k WHERE key IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
    "text_citations": f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents), k AS (SELECT DISTINCT doc_id, CASE WHEN regexp_matches(l, '{APA}') THEN sha256(lower(trim(regexp_extract(l, '{APA}', 1))) || '|' || regexp_extract(l, '{APA}', 2) || '|' || lower(trim(regexp_extract(l, '{APA}', 3))))
        WHEN regexp_matches(l, '{IEEE}') THEN sha256(lower(trim(regexp_extract(l, '{IEEE}', 1))) || '|' || regexp_extract(l, '{IEEE}', 3) || '|' || lower(trim(regexp_extract(l, '{IEEE}', 2)))) END AS key FROM l) SELECT key, count(*) AS documents FROM k WHERE key IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
    "text_nfc": f"SELECT doc_id, md5(nfc_normalize({T})) AS nfc_md5 FROM documents",
    "page_style_entropy": """WITH p AS (SELECT page_id, list_transform(regexp_extract_all(coalesce(html, ''), '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda x: lower(x)) AS n FROM pages), c AS (SELECT page_id, x, count(*) AS c FROM (SELECT page_id, unnest(n) AS x FROM p) GROUP BY 1, 2),
        e AS (SELECT page_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM c GROUP BY 1)
        SELECT p.page_id, len(n) AS tags, round(coalesce(e, 0), 4) AS entropy, sha256(array_to_string(list_sort(list_distinct(n)), ',')) AS fingerprint FROM p LEFT JOIN e USING (page_id)""",
    "style_paraphrase": f"""WITH {TOTALS}, s AS (SELECT doc_id, w, list_transform({PIECES.format('t')}, lambda x: {N_BLANK}) AS a FROM w),
        f AS (SELECT s.doc_id, round(CASE WHEN v > 1 THEN (log2(n) - e / n) / log2(v) ELSE 0 END, 4) AS synonym_entropy, {_var('a', 4)} AS sentence_length_variance,
          round(least(1.0, CASE WHEN len(w) >= 3 THEN len(list_filter(range(1, len(w)), lambda i: list_contains({BE}, w[i]) AND ends_with(w[i + 1], 'ed'))) * 100.0::DOUBLE / len(w) ELSE 0 END), 4) AS transition_anomaly FROM s LEFT JOIN m USING (doc_id)),
        b AS (SELECT *, list_sort([{TOOL}])[1] AS best FROM f) SELECT doc_id, synonym_entropy, sentence_length_variance, transition_anomaly, best.tool AS tool, round(-best.s * 100, 2) AS confidence FROM b""",
    "style_profile": f"WITH {PROFILE} SELECT * EXCLUDE (source) FROM profile",
    "style_deviation": f"WITH {PROFILE}, b AS (SELECT source, {', '.join(f'avg({k}) AS b{i}' for i, k in enumerate(writing.WEIGHTS))} FROM profile GROUP BY 1) SELECT doc_id, source, round(sqrt({' + '.join(f'{w}::DOUBLE * pow({k} - b{i}, 2)' for i, (k, w) in enumerate(writing.WEIGHTS.items()))}), 3) AS deviation FROM profile JOIN b USING (source)",
    "text_rubric": f"WITH {PROFILE} SELECT doc_id, CAST({POINTS} AS BIGINT) AS points, round(({POINTS}) * 100.0::DOUBLE / {sum(p for _, _, p in RULES)}, 2) AS percent FROM profile",
    "pair_drift": f"""WITH {NEXT}, x AS (SELECT doc_a, doc_b, list_distinct({W.replace('text', 'text_a')}) AS p, list_distinct({W.replace('text', 'text_b')}) AS q, list_transform({PIECES.format("coalesce(text_a, '')")}, lambda x: {N_BLANK}) AS a, list_transform({PIECES.format("coalesce(text_b, '')")}, lambda x: {N_BLANK}) AS b FROM n),
        y AS (SELECT doc_a, doc_b, len(list_intersect(p, q)) AS s, len(p) + len(q) - len(list_intersect(p, q)) AS u, len(a) AS ka, len(b) AS kb, list_sum(a) / len(a)::DOUBLE AS la, list_sum(b) / len(b)::DOUBLE AS lb FROM x),
        z AS (SELECT doc_a, doc_b, CASE WHEN u > 0 THEN 1 - s / u::DOUBLE ELSE 0 END AS l, (abs(ka - kb) / greatest(ka, kb)::DOUBLE + abs(la - lb) / greatest(la, lb, 1.0::DOUBLE)) / 2 AS v FROM y), k AS (SELECT *, greatest(0.0, least(1.0, 1 - (l * 0.7::DOUBLE + v * 0.3::DOUBLE))) AS i FROM z)
        SELECT doc_a, doc_b, round(l, 4) AS lexical_drift, round(v, 4) AS structural_variance, round(i, 4) AS invariance, i < 0.6 AS obfuscated FROM k""",
    "pair_two_text_tf_idf": f"""WITH {NEXT}, c AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest({W}) AS x FROM documents) GROUP BY 1, 2), q AS (SELECT doc_id, sum(c * c) AS q FROM c GROUP BY 1),
        s AS (SELECT a.doc_id AS doc_a, sum(a.c * b.c) AS d, sum(a.c * a.c) AS sa, sum(b.c * b.c) AS sb FROM c a JOIN c b ON b.doc_id = a.doc_id + 1 AND a.x = b.x GROUP BY 1),
        r AS (SELECT n.doc_a, n.doc_b, round(least(1.0, coalesce(d / (sqrt(sa + (x.q - sa) * pow(ln(2) + 1, 2)) * sqrt(sb + (y.q - sb) * pow(ln(2) + 1, 2))), 0)), 6) AS sim FROM n LEFT JOIN s ON s.doc_a = n.doc_a LEFT JOIN q x ON x.doc_id = n.doc_a LEFT JOIN q y ON y.doc_id = n.doc_b)
        SELECT *, sim < 0.15 AS unrelated FROM r""",
    "pair_shared_segments": f"""WITH {NEXT}, s AS (SELECT doc_a, doc_b, lower(coalesce(text_b, '')) AS low, unnest(string_split_regex(coalesce(text_a, ''), '[\\n.]')) AS p, generate_subscripts(string_split_regex(coalesce(text_a, ''), '[\\n.]'), 1) AS i FROM n),
        t AS (SELECT doc_a, doc_b, any_value(low) AS low, {STRIP.format('p')} AS p, min(i) AS i FROM s GROUP BY 1, 2, 4), u AS (SELECT doc_a, doc_b, list(p ORDER BY i) FILTER (p <> '' AND contains(low, lower(p))) AS l FROM t GROUP BY 1, 2)
        SELECT doc_a, doc_b, coalesce(len(l), 0) AS segments, md5(coalesce(array_to_string(l, chr(10)), '')) AS segments_md5 FROM u""",
    "pair_paragraphs": f"""WITH {NEXT}, p AS (SELECT doc_a, doc_b, list_transform({PARAS.format('text_a')}, lambda x: list_distinct(regexp_extract_all(lower(x), '{WORDS}'))) AS a, list_transform({PARAS.format('text_b')}, lambda x: list_distinct(regexp_extract_all(lower(x), '{WORDS}'))) AS b FROM n),
        m AS (SELECT doc_a, doc_b, list_transform(a, lambda x: coalesce(list_max(list_transform(b, lambda y: len(list_intersect(x, y)) / greatest(1, len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE)), 0)) AS m FROM p), h AS (SELECT *, list_filter(m, lambda x: x >= 0.3) AS h FROM m)
        SELECT doc_a, doc_b, len(m) AS paragraphs, len(h) AS matched, CASE WHEN len(m) > 0 THEN round(len(h) / len(m)::DOUBLE, 4) ELSE 0 END AS coverage, round(coalesce(list_max(h), 0), 4) AS best, round(coalesce(list_avg(h), 0), 4) AS mean FROM h""",
    "pair_cross_script": f"""WITH {BOTH}, k AS (SELECT *, list_sort([{BLOCKS.replace(T, 'text_a')}])[1] AS p, list_sort([{BLOCKS.replace(T, 'text_b')}])[1] AS q FROM j), z AS (SELECT *, CASE WHEN p.n < 0 THEN p.script ELSE 'none' END = CASE WHEN q.n < 0 THEN q.script ELSE 'none' END AS same_script FROM k)
        SELECT doc_a, doc_b, same_script, CASE WHEN same_script THEN round({JAC}, 6) ELSE 0 END AS sim FROM z""",
    "pair_lexical_methods": f"WITH a AS ({sim_plans.SQL['pair_metrics']}), b AS ({sim_plans.SQL['tf_idf_neighbours']}), c AS ({sim_plans.SQL['bm25_neighbours']}) SELECT a.*, b.sim AS tf_idf, c.sim AS bm25 FROM a JOIN b USING (doc_a, doc_b) JOIN c USING (doc_a, doc_b)",
    "pair_hybrid_parts": f"""WITH {BOTH}, {UNIT}, k AS (SELECT doc_a, doc_b, round(least(1, greatest(0, list_cosine_similarity(a.v, b.v))), 6) AS semantic, round({JAC}, 6) AS lexical FROM j JOIN u a ON a.id = doc_a JOIN u b ON b.id = doc_b), h AS (SELECT *, round({ALPHA}::DOUBLE * semantic + (1 - {ALPHA}::DOUBLE) * lexical, 4) AS hybrid FROM k)
        SELECT *, hybrid >= {FLAGGED} AS flagged FROM h""",
    "turn_coherence": f"""WITH j AS (SELECT a.conv_id, a.turn, coalesce(a.text, '') AS text_a, coalesce(b.text, '') AS text_b, {SET.format('a.text')} AS x, {SET.format('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')
        SELECT conv_id, turn, round({JAC}, 6) AS coherence FROM j""",
}
