"""Predicates and pages: metadata filters, tags, search expressions, cursors."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_tag(tags: str | Column, tag: str) -> Column:
    """Whether a comma list holds a tag, whatever its case."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    parts = F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    return F.array_contains(parts, tag.strip().lower())


def metadata_filter(conditions: Sequence[tuple[str, str, Any]]) -> Column:
    """All of ``(field, operator, value)``: eq ne gt lt gte lte contains in.

    A null field, or one that can't be compared, fails its condition.
    """
    made = F.lit(True)
    for field, operator, value in conditions:
        c = F.col(f"`{field}`")
        match operator:
            case "eq":
                test = c == value
            case "ne":
                test = c != value
            case "gt":
                test = c > value
            case "lt":
                test = c < value
            case "gte":
                test = c >= value
            case "lte":
                test = c <= value
            case "contains":
                test = F.contains(F.lower(c.cast("string")), F.lit(str(value).lower()))
            case "in":
                test = c.isin(*value)
            case _:
                raise ValueError(f"unknown operator {operator}")
        made = made & F.coalesce(test, F.lit(False))
    return made


def search_expression(query: str, text: str, fields: Sequence[str] = ()) -> Column:
    """Words (all must occur), "phrases", -exclusions and field:value as a predicate on lower-cased text."""
    body = F.lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    made = F.lit(True)
    for minus, field, phrase, word in re.findall(r'(-?)(?:(\w+):)?(?:"([^"]*)"|(\S+))', query):
        wanted = (phrase or word).lower()
        if field and field in fields:
            test = F.coalesce(F.lower(F.col(f"`{field}`").cast("string")) == wanted, F.lit(False))
        else:
            test = F.contains(body, F.lit(f"{field}:{wanted}" if field else wanted))
        made = made & (~test if minus else test)
    return made


def keyset_page(rows: DataFrame, key: str, size: int, after: Any = None) -> DataFrame:
    """The ``size`` rows after a cursor and one more, which tells whether a further page follows."""
    some = rows if after is None else rows.where(F.col(key) > after)
    return some.orderBy(key).limit(size + 1)


def offset_page(rows: DataFrame, order: Sequence[str], number: int, size: int, most: int = 100) -> DataFrame:
    """A page by number; sizes from 1 to ``most``, numbers from 1."""
    size = min(max(1, size), most)
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def encode_cursor(value: Column) -> Column:
    return F.base64(F.encode(F.to_json(F.struct(value.alias("v"))), "UTF-8"))
