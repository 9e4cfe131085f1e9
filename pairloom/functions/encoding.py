"""Text that was read as Windows-1252 though it was UTF-8: how much of it is garbled, and its repair."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import text_of


def _char(byte: int) -> str:
    """A byte as Windows-1252 shows it; the five bytes without a character stay themselves."""
    try:
        return bytes([byte]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(byte)


#: Bytes by the characters that show them, and the characters that can follow in a sequence of UTF-8.
BYTES = {_char(b): b for b in range(256)}
FOLLOWING = "[" + "".join(re.escape(_char(b)) for b in range(0x80, 0xC0)) + "]"
#: A character of two (Latin letters and what Windows-1252 adds to them), three or four bytes of UTF-8, each shown as a character.
GARBLED = f"Å[’“\u00a0¡¸½¾]|Æ’|Ë[†œ]|[ÂÃ]{FOLLOWING}|[à-ï]{FOLLOWING}{{2}}|[ð-ô]{FOLLOWING}{{3}}"
PASSES = 4


def garbled_share(text: str | Column) -> Column:
    """Share of a text's characters that are in garbled sequences; 0 of an empty text."""
    t = text_of(text)
    found = F.length(F.array_join(F.regexp_extract_all(t, F.lit(GARBLED), F.lit(0)), ""))
    return F.when(F.length(t) > 0, found / F.length(t)).otherwise(0.0)


def mend(text: str) -> str:
    """``text`` with garbled sequences as the characters they stand for, again until nothing changes; others stay."""
    pattern = re.compile(GARBLED)

    def one(m: re.Match) -> str:
        try:
            made = bytes(BYTES[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        return made if made.isprintable() or made.isspace() else m[0]

    for _ in range(PASSES):
        mended = pattern.sub(one, text)
        if mended == text:
            break
        text = mended
    return text


def mended(text: str | Column) -> Column:
    """``mend`` of a column; Spark has no decoder that keeps what it can't decode."""

    @F.pandas_udf("string")
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(mend)

    return each(text_of(text))
