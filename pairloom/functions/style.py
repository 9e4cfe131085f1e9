"""Style and watermark statistics of texts, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import let, ngrams, sentences, text_of, words


def blank_words(text: str | Column) -> Column:
    """Lower-case pieces between white space."""
    return F.filter(F.split(F.lower(text_of(text)), r"\s+"), lambda w: w != "")


def burstiness(text: str | Column) -> Column:
    """Coefficient of variation of sentence lengths in words, at most 1; 0 for fewer than two sentences."""
    lengths = F.transform(sentences(text), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")).cast("double"))

    def cv(x: Column) -> Column:
        n = F.size(x)
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
        square = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
        mean = total / n
        sd = F.sqrt(F.greatest(F.lit(0.0), square / n - mean * mean))
        return F.when(n < 2, 0.0).when(mean == 0, 0.0).otherwise(F.least(F.lit(1.0), sd / mean))

    return let(lengths, cv)


def repetitiveness(text: str | Column, n: int = 3) -> Column:
    """1 less the share of distinct n-grams; 0 for fewer than n words."""
    return let(ngrams(blank_words(text), n), lambda g: F.when(F.size(g) > 0, 1 - F.size(F.array_distinct(g)) / F.size(g)).otherwise(0.0))


def green_share(text: str | Column, key: str = "pairloom", gamma: float = 0.5) -> Column:
    """Struct of green words and all words but the first: a keyed SHA-256 of the word before and the word is below ``gamma``."""

    def judge(w: Column) -> Column:
        total = F.greatest(F.lit(0), F.size(w) - 1)
        at = F.when(total > 0, F.sequence(F.lit(2), F.size(w))).otherwise(F.expr("cast(array() as array<int>)"))
        value = lambda i: F.conv(F.substring(F.sha2(F.concat(F.lit(key), F.lit(":"), F.element_at(w, i - 1), F.lit(":"), F.element_at(w, i)), 256), 1, 8), 16, 10).cast("double") / 4294967295.0
        green = F.size(F.filter(at, lambda i: value(i) < gamma))
        return F.struct(green.cast("long").alias("green"), total.cast("long").alias("total"))

    return let(words(text), judge)


def watermark_z(green: Column, total: Column, gamma: float = 0.5) -> Column:
    """Standard score of the number of green words; 0 without words."""
    return F.when(total > 0, (green - gamma * total) / F.sqrt(total * gamma * (1 - gamma))).otherwise(0.0)


def wilson(green: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval; 0 and 1 without words."""
    n = F.greatest(F.lit(1), total)
    p = green / n
    centre, reach, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(total > 0, (centre - reach) / scale).otherwise(0.0), F.when(total > 0, (centre + reach) / scale).otherwise(1.0)


def shannon_entropy(items: Column) -> Column:
    """Entropy in bits of the distribution of an array's items; 0 for none."""

    def entropy(x: Column) -> Column:
        n = F.size(x)
        parts = F.transform(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda y: y == v)) / n)
        return F.when(n > 0, -F.aggregate(parts, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0)

    return let(items, entropy)


def lexical_complexity(text: str | Column) -> dict[str, Column]:
    """Type-token ratio, mean word length and share of long words."""
    w = words(text)
    n = F.greatest(F.lit(1), F.size(w))
    return {
        "ttr": F.size(F.array_distinct(w)) / n,
        "mean_word": F.aggregate(w, F.lit(0.0), lambda a, x: a + F.length(x)) / n,
        "long_share": F.size(F.filter(w, lambda x: F.length(x) >= 8)) / n,
    }


# Markers of how an argument proceeds.
DISCOURSE = {
    "contrast": ("however", "although", "but", "yet", "whereas"),
    "cause": ("because", "therefore", "thus", "hence", "since"),
    "addition": ("moreover", "furthermore", "also", "and"),
    "example": ("for example", "for instance", "such as"),
}


def discourse_counts(text: str | Column) -> dict[str, Column]:
    """How often markers of each kind occur as words."""
    t = F.lower(text_of(text))
    return {kind: F.regexp_count(t, F.lit(r"\b(" + "|".join(m) + r")\b")).cast("long") for kind, m in DISCOURSE.items()}


# Endings and words that a rule-based tagger goes by.
POS_RULES = (
    ("DET", r"^(the|a|an|this|that|these|those)$"), ("PRON", r"^(i|you|he|she|it|we|they)$"), ("PREP", r"^(of|in|to|for|with|on|at|by|from)$"),
    ("CONJ", r"^(and|or|but|because|if)$"), ("AUX", r"^(is|are|was|were|be|been|has|have|had)$"), ("ADV", r"ly$"), ("VERB", r"(ing|ed|ize|ise)$"),
    ("NOUN", r"(tion|ment|ness|ity|er|or)$"), ("ADJ", r"(ous|ful|able|ible|ive|al)$"), ("NUM", r"^\d+$"),
)


def pos_tag(word: Column) -> Column:
    """Tag of a lower-case word by the first rule that fits, else X."""
    made = F.lit("X")
    for tag, pattern in reversed(POS_RULES):
        made = F.when(F.regexp_like(word, F.lit(pattern)), tag).otherwise(made)
    return made
