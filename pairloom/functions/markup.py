"""Marks inside texts: citations, rhetorical classes, macros, hidden characters, tags, Unicode forms.

Null text is read as empty text everywhere.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import let, text_of

# Markers of rhetorical classes, the first class that fits counts.
RHETORIC = (
    ("CONCLUSION", r"(in conclusion|to summarize|ultimately|therefore|thus|in summary)"),
    ("REBUTTAL", r"(however|on the other hand|conversely|nevertheless|despite this|critics argue)"),
    ("EVIDENCE", r"(for example|for instance|studies show|research indicates|data suggests|according to)"),
    ("INTRODUCTION", r"(in this paper|this study|the purpose of|background)"),
)
# Headings that name their class.
HEADINGS = {"intro": "INTRODUCTION", "introduction": "INTRODUCTION", "claim": "CLAIM", "evidence": "EVIDENCE", "rebuttal": "REBUTTAL", "conclusion": "CONCLUSION"}
# Bracketed numbers, and an author with a year.
NUMBERED = r"\[(\d+(?:[, \-\d]*)\d*)\]"
AUTHOR_YEAR = r"\(([A-Za-z]+(?:\s(?:&|and)\s[A-Za-z]+)?,?\s*\d{4}[a-z]?)\)"
# Code points of hidden characters; of a hidden mark, those for 0, 1, its start and its end.
HIDDEN = "​‌‍﻿⁠"
ZERO, ONE, BEGIN, END = "​", "‌", "‍", "﻿"


def stripped(text: str | Column) -> Column:
    return F.regexp_replace(text_of(text), r"^\s+|\s+$", "")


def spoken_sentences(text: str | Column) -> Column:
    """Pieces that end at . ! or ? before white space; one empty piece for a blank text."""
    return F.split(stripped(text), r"(?<=[.!?])\s+")


def rhetorical_class(text: str | Column) -> Column:
    """Class of a paragraph by heading, then by the first class whose marker occurs, else CLAIM."""
    heading = F.lower(F.regexp_replace(stripped(text), r"[.:]+$", ""))
    made = F.lit("CLAIM")
    for name, pattern in reversed(RHETORIC):
        made = F.when(F.regexp_like(text_of(text), F.lit(rf"(?i)\b{pattern}\b")), name).otherwise(made)
    for word, name in HEADINGS.items():
        made = F.when(heading == word, name).otherwise(made)
    return made


#: Control sequences that name something, and the kind of what they name.
NAMING = {"newcommand": "macro", "renewcommand": "macro", "def": "macro", "begin": "env", "documentclass": "class", "usepackage": "pkg"}
#: A control sequence, options in brackets, and the names that follow in a brace or after a backslash.
SEQUENCE = r"(?i)\\(" + "|".join(NAMING) + r")(?:\[[^\]]*\])?(?:\{\\?|\\)([a-z0-9*,]+)"


def macros(source: str | Column) -> Column:
    """``macro:``, ``env:``, ``class:`` and ``pkg:`` names of a LaTeX source, kind by kind in order."""
    s = text_of(source)
    told = F.arrays_zip(F.regexp_extract_all(s, F.lit(SEQUENCE), F.lit(1)).alias("by"), F.regexp_extract_all(s, F.lit(SEQUENCE), F.lit(2)).alias("names"))

    def of(kind: str) -> Column:
        own = F.filter(told, lambda x: F.lower(x["by"]).isin(*[n for n, k in NAMING.items() if k == kind]))
        names = F.flatten(F.transform(own, lambda x: F.split(x["names"], ",")))
        return F.transform(F.filter(names, lambda n: n != ""), lambda n: F.concat(F.lit(f"{kind}:"), n))

    return F.concat(*map(of, dict.fromkeys(NAMING.values())))


def hidden_runs(text: str | Column) -> Column:
    """Runs of zero-width characters in order."""
    return F.regexp_extract_all(text_of(text), F.lit(f"[{HIDDEN}]+"), F.lit(0))


def hidden_mark(text: str | Column) -> Column:
    """The 32 hexadecimal digits of a mark of zero-width characters, or null.

    The mark stands between a start and an end character; without them at least
    128 characters for bits must be there. Bits are padded with zeros on the left
    or cut to 128.
    """
    t = text_of(text)
    framed = F.regexp_extract(t, f"{BEGIN}([{ZERO}{ONE}]+){END}", 1)
    loose = F.regexp_replace(t, f"[^{ZERO}{ONE}]", "")
    bits = F.when(framed != "", framed).when(F.length(loose) >= 128, loose)
    padded = F.lpad(F.substring(F.translate(bits, ZERO + ONE, "01"), 1, 128), 128, "0")
    digits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.lower(F.conv(F.substring(padded, i * 16 + 1, F.lit(16)), 2, 16)), 4, "0"))
    return F.when(padded.isNotNull(), F.array_join(digits, ""))


def tags(raw: str | Column) -> Column:
    """Sorted distinct ``#`` tags of a list split at commas and blanks; a tag has a letter."""
    plain = F.transform(F.split(F.lower(text_of(raw)), r"[,\s]+"), lambda t: F.regexp_replace(t, r"[^a-z0-9]", ""))
    return F.array_sort(F.array_distinct(F.transform(F.filter(plain, lambda t: F.regexp_like(t, F.lit("[a-z]"))), lambda t: F.concat(F.lit("#"), t))))


def cited(text: str | Column, around: int = 1) -> Column:
    """Array of ``sentence, key, context`` of all citations: numbered ones of a sentence, then authors with years.

    The context is the sentence with ``around`` sentences on both sides.
    """

    def of(all_sentences: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            first = F.greatest(F.lit(0), i - around)
            context = F.array_join(F.slice(all_sentences, first + 1, i + around + 1 - first), " ")
            keys = F.concat(F.regexp_extract_all(s, F.lit(NUMBERED), F.lit(1)), F.regexp_extract_all(s, F.lit(AUTHOR_YEAR), F.lit(1)))
            return F.transform(keys, lambda k: F.struct(i.alias("sentence"), k.alias("key"), context.alias("context")))

        return F.flatten(F.transform(all_sentences, one))

    return let(spoken_sentences(text), of)


def normal_form(text: str | Column, form: str = "NFC") -> Column:
    """Unicode normal form of a text; Spark has no function of its own for it."""
    if form not in ("NFC", "NFKC", "NFD", "NFKD"):
        raise ValueError("form must be NFC, NFKC, NFD or NFKD")

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t))

    return normal(text_of(text))
