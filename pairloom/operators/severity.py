"""Severity bands of a similarity score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower ends of the bands.
HIGH, MEDIUM, LOW = 0.90, 0.75, 0.59


def severity(score: str | Column) -> Column:
    """High, Medium or Low."""
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score >= HIGH, "High").when(score >= MEDIUM, "Medium").otherwise("Low")
