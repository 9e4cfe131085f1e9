"""Similarity of two columns: sets, strings, vectors, distributions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import char_ngrams, kept_tokens, let, ngrams, text_of, token_set, tokens


def _counted(a: Column, b: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use`` of the number of shared items of two arrays of distinct items, and of their sizes; the arrays are made once."""
    counts = lambda s: F.struct(F.size(F.array_intersect(s["a"], s["b"])).alias("i"), F.size(s["a"]).alias("n"), F.size(s["b"]).alias("m"))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: let(counts(s), lambda c: use(c["i"], c["n"], c["m"])))


def _jaccard(empty: float) -> Callable[[Column, Column, Column], Column]:
    return lambda i, n, m: F.when((n == 0) & (m == 0), empty).otherwise(i / F.greatest(F.lit(1), n + m - i))


def _dice(i: Column, n: Column, m: Column) -> Column:
    return F.when((n == 0) & (m == 0), 1.0).otherwise(2 * i / F.greatest(F.lit(1), n + m))


def _overlap(i: Column, n: Column, m: Column) -> Column:
    return F.when((n == 0) | (m == 0), 0.0).otherwise(i / F.greatest(F.lit(1), F.least(n, m)))


def set_jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Of two arrays of distinct items; ``empty`` if both are empty, 0 if one is."""
    return _counted(a, b, _jaccard(empty))


def jaccard(a: str | Column, b: str | Column, stop: bool = True) -> Column:
    """Jaccard of token sets: 0 if a text is empty, 1 if both sets are, 0 if one is."""
    s = {} if stop else {"stop": ()}
    blank = (text_of(a) == "") | (text_of(b) == "")
    return F.when(blank, 0.0).otherwise(set_jaccard(token_set(a, **s), token_set(b, **s)))


def dice(a: str | Column, b: str | Column) -> Column:
    """Sorensen-Dice of token sets; 1 if both are empty."""
    return _counted(token_set(a), token_set(b), _dice)


def overlap(a: str | Column, b: str | Column) -> Column:
    """Shared tokens over the smaller set; 0 if a set is empty."""
    return _counted(token_set(a), token_set(b), _overlap)


def ngram_overlap(a: str | Column, b: str | Column, n: int = 3) -> Column:
    """Jaccard of word n-grams, n from 1 to 10; 0 if both have none."""
    return _ngram_overlap(tokens(a), tokens(b), n)


def _ngram_overlap(a: Column, b: Column, n: int) -> Column:
    if not 1 <= n <= 10:
        raise ValueError("n must be from 1 to 10")
    return set_jaccard(F.array_distinct(ngrams(a, n)), F.array_distinct(ngrams(b, n)), 0.0)


def token_scores(a: str | Column, b: str | Column, n: int = 3) -> Column:
    """``jaccard, dice, overlap, ngram`` of two texts as a struct, from tokens that are made once."""
    blank = (text_of(a) == "") | (text_of(b) == "")

    def scored(t: Column) -> Column:
        by_set = lambda i, k, m: F.struct(F.when(blank, 0.0).otherwise(_jaccard(1.0)(i, k, m)).alias("j"), _dice(i, k, m).alias("d"), _overlap(i, k, m).alias("o"))
        grams = _ngram_overlap(t["a"], t["b"], n)
        return let(_counted(kept_tokens(t["a"]), kept_tokens(t["b"]), by_set), lambda s: F.struct(s["j"].alias("jaccard"), s["d"].alias("dice"), s["o"].alias("overlap"), grams.alias("ngram")))

    return let(F.struct(tokens(a).alias("a"), tokens(b).alias("b")), scored)


def char_ngram_similarity(a: str | Column, b: str | Column, n: int = 5) -> Column:
    """Jaccard of character n-grams of the lower-cased texts; 0 if a text is shorter than n."""
    x, y = char_ngrams(F.lower(text_of(a)), n), char_ngrams(F.lower(text_of(b)), n)
    return F.when((F.length(text_of(a)) < n) | (F.length(text_of(b)) < n), 0.0).otherwise(set_jaccard(x, y, 0.0))


def levenshtein_similarity(a: str | Column, b: str | Column) -> Column:
    """1 less distance over the longer length; equal texts 1, one empty 0."""
    x, y = text_of(a), text_of(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.lit(1), longest))


def sigmoid_scale(score: Column, steepness: float = 6.0, midpoint: float = 0.5) -> Column:
    """A score spread by a sigmoid that maps 0 to 0 and 1 to 1; ends are kept."""
    def s(x: Column) -> Column:
        return 1 / (1 + F.exp(-steepness * (x - midpoint)))

    low, high = s(F.lit(0.0)), s(F.lit(1.0))
    return let(score, lambda x: F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise((s(x) - low) / (high - low)))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped to [0, 1]; 0 for a zero, null or differently long vector."""
    n = norm(a) * norm(b)
    value = F.when((F.size(a) == F.size(b)) & (n > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / n)))
    return F.coalesce(value, F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda acc, x: acc + x))


def manhattan_similarity(a: Column, b: Column) -> Column:
    """1 over 1 plus the Manhattan distance."""
    distance = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)
    return 1 / (1 + distance)


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence (base 2) of two arrays of probabilities."""
    def part(x: Column, m: Column) -> Column:
        return F.when((x > 0) & (m > 0), x * F.log2(x / m)).otherwise(0.0)

    parts = F.zip_with(p, q, lambda x, y: let((x + y) / 2, lambda m: (part(x, m) + part(y, m)) / 2))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
