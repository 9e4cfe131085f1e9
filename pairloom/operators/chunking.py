"""Documents cut into overlapping chunks that end where a paragraph or sentence does."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = "array<struct<chunk_index:int,char_start:int,char_end:int,section:string,chunk:string>>"
HEADING = re.compile(r"^#{1,6}\s+(.*)$", re.MULTILINE)
BREAKS = (re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+"), re.compile(r"\s+"))


def sections(text: str) -> list[tuple[int, int, str]]:
    """Start, end and title of Markdown sections; text before the first heading has no title."""
    marks = list(HEADING.finditer(text))
    if not marks:
        return [(0, len(text), "")]
    made = [(0, marks[0].start(), "")] if marks[0].start() else []
    return made + [(m.start(), n.start() if n else len(text), m[1].strip()) for m, n in zip(marks, [*marks[1:], None], strict=True)]


def spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of about ``size`` characters, each lengthened to the next paragraph, sentence or word end, by ``size`` at most."""
    made, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            for pattern in BREAKS:
                found = pattern.search(text, end, min(len(text), start + 2 * size))
                if found:
                    end = found.end()
                    break
        made.append((start, end))
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    return made


def chunk_text(text: str, size: int = 500, overlap: int = 50, least_words: int = 1) -> list[tuple[int, int, int, str, str]]:
    """Chunks of every section; a tail of under a fifth of ``size`` joins the chunk before."""
    made: list[list] = []
    for begin, until, title in sections(text):
        own: list[list] = []
        for a, b in spans(text[begin:until], size, overlap):
            if own and b - a < size // 5:
                own[-1][1] = begin + b
            else:
                own.append([begin + a, begin + b, title])
        made += own
    rows = [(a, b, t, text[a:b]) for a, b, t in made if len(text[a:b].split()) >= least_words]
    return [(i, a, b, t, c) for i, (a, b, t, c) in enumerate(rows)]


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """One row per chunk. An empty or null text has none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below size")

    @F.pandas_udf(CHUNK)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("chunk_index", "char_start", "char_end", "section", "chunk")
        for batch in batches:
            yield pd.Series([[dict(zip(names, c, strict=True)) for c in chunk_text(t or "", size, overlap)] for t in batch])

    return docs.select(key, F.explode(cut(F.col(text))).alias("c")).select(key, "c.*")


def token_windows(docs: DataFrame, key: str, words: str, size: int, overlap: int) -> DataFrame:
    """Windows of words, as ``chunk_index, chunk``, by built-in functions."""
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - overlap), F.lit(step))
    made = docs.where(F.size(words) > 0).select(key, words, F.posexplode(starts).alias("chunk_index", "at"))
    return made.select(key, "chunk_index", F.array_join(F.slice(words, F.col("at"), size), " ").alias("chunk"))
