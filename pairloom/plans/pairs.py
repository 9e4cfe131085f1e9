"""Queries on pairs of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.text import words
from pairloom.operators.setjoin import jaccard_join
from pairloom.operators.severity import severity
from pairloom.runtime import table

THRESHOLD = 0.59


def near_copies_word_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents of one language whose distinct words are alike; of documents with equal words the first stands for all and is paired with each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.array_distinct(words("text")).alias("tokens"))
    pairs = jaccard_join(docs, "doc_id", "tokens", THRESHOLD, within="lang")
    return pairs.select("doc_a", "doc_b", "sim", severity("sim").alias("severity"))


QUERIES = {"near_copies_word_jaccard": near_copies_word_jaccard}

SQL = {
    "near_copies_word_jaccard": f"""
WITH d AS (
  SELECT doc_id, lang, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS t FROM documents
), m AS (
  SELECT doc_id, lang, t, min(doc_id) OVER (PARTITION BY lang, t) AS rep FROM d WHERE len(t) > 0 AND lang IS NOT NULL
), w AS (SELECT doc_id, lang, unnest(t) AS token FROM m WHERE doc_id = rep),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
s AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS shared
  FROM w a JOIN w b ON a.lang = b.lang AND a.token = b.token AND a.doc_id < b.doc_id GROUP BY 1, 2
), j AS (
  SELECT doc_a, doc_b, shared / (x.n + y.n - shared)::DOUBLE AS sim
  FROM s JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b
  UNION ALL SELECT rep, doc_id, 1.0::DOUBLE FROM m WHERE rep <> doc_id
)
SELECT doc_a, doc_b, sim, CASE WHEN sim >= 0.9 THEN 'High' WHEN sim >= 0.75 THEN 'Medium' ELSE 'Low' END AS severity
FROM j WHERE sim >= {THRESHOLD}
"""
}
