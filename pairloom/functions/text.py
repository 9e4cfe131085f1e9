"""Text columns: words, sentences, counts, cleaning and scripts, as built-in expressions.

Null text is read as empty text everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?U)\b\w+\b"
TOKEN = r"[a-z0-9]+(?:'[a-z]+)?"

# Curly punctuation and its plain form.
CURLY, PLAIN = "‘’‚“”„–—−…", "'''\"\"\"---."
ZERO_WIDTH = "​‌‍⁠﻿"
# Cyrillic and Greek letters that look Latin, and the Latin letters.
LOOKALIKE, LATIN = "аеорсухіΑΒΕΟΡ", "aeopcyxiABEOP"
# Elements whose content isn't shown as text.
DROPPED_TAGS = ("script", "style", "nav", "header", "footer", "aside", "noscript")
# A short list of English function words.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i if in into is it its not of on or our she so "
    "that the their them then there these they this to was we were what when which who will with you your"
).split()
# Marker words of languages.
MARKERS = {
    "en": "the of and to in is that for it with".split(),
    "fr": "le la les de des et un une est que".split(),
    "de": "der die das und ist in den von zu mit".split(),
    "es": "el la los las de y en que un una".split(),
}


def text_of(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where a lambda repeats it."""
    return F.transform(F.array(value), use)[0]


def words(text: str | Column) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(text_of(text)), F.lit(WORD), F.lit(0))


def tokens(text: str | Column) -> Column:
    """Lower-case tokens of ASCII letters and digits, with an apostrophe part."""
    return F.regexp_extract_all(F.lower(text_of(text)), F.lit(TOKEN), F.lit(0))


def token_set(text: str | Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct tokens without stop words."""
    return kept_tokens(tokens(text), stop)


def kept_tokens(items: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct items without stop words."""
    return F.array_distinct(F.array_except(items, F.array(*map(F.lit, stop)))) if stop else F.array_distinct(items)


def without_stop_words(text: str | Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Tokens in order without stop words, joined by spaces."""
    return F.array_join(F.filter(tokens(text), lambda t: ~t.isin(*stop)), " ")


def ngrams(items: Column, n: int) -> Column:
    """Runs of ``n`` items, joined by a space; none if there are fewer."""
    none = F.expr("cast(array() as array<string>)")

    def runs(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(own) - (n - 1))
        return F.when(F.size(own) >= n, F.transform(starts, lambda i: F.array_join(F.slice(own, i, n), " "))).otherwise(none)

    return let(items, runs)


def char_ngrams(text: str | Column, n: int) -> Column:
    """Distinct runs of ``n`` characters; none if there are fewer."""
    none = F.expr("cast(array() as array<string>)")

    def runs(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(t) - (n - 1))
        return F.when(F.length(t) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(t, i, F.lit(n))))).otherwise(none)

    return let(text_of(text), runs)


def sentences(text: str | Column) -> Column:
    """Pieces that end at . ! or ? before white space, or at a line's end; blank ones go."""
    return F.filter(F.transform(F.split(text_of(text), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def count_words(text: str | Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def count_unique_words(text: str | Column) -> Column:
    return F.size(F.array_distinct(words(text))).cast("long")


def count_syllables(text: str | Column) -> Column:
    """Sum over words of their groups of vowels, less a silent final e, one at least."""
    t = F.lower(text_of(text))
    groups = F.regexp_count(t, F.lit("[aeiouy]+"))
    without = F.regexp_count(t, F.lit(r"(?U)\b[^aeiouy\W]+\b"))
    silent = F.regexp_count(t, F.lit(r"(?U)\b\w*[aeiouy]\w*[^aeiouyl\W]e\b"))
    return groups + without - silent


def count_word_letters(text: str | Column) -> Column:
    """Characters of all words."""
    return F.length(F.regexp_replace(F.lower(text_of(text)), r"(?U)\W+", ""))


def richness(text: str | Column) -> dict[str, Column]:
    """Type-token ratio, Guiraud's R and Herdan's C; 0 for no words, C is 0 for one."""
    n, v = count_words(text), count_unique_words(text)
    return richness_of(n, v)


def richness_of(n: Column, v: Column) -> dict[str, Column]:
    """The same of counts of words and of distinct words."""
    return {
        "ttr": F.when(n > 0, v / n).otherwise(0.0),
        "guiraud_r": F.when(n > 0, v / F.sqrt(n)).otherwise(0.0),
        "herdan_c": F.when((n > 1) & (v > 0), F.ln(v) / F.ln(n)).otherwise(0.0),
    }


def measures(text: str | Column) -> Column:
    """Struct of words, sentences, syllables and letters, to be made a column before ``readability``."""
    counts = (count_words(text).alias("words"), F.size(sentences(text)).alias("sentences"), count_syllables(text).alias("syllables"), count_word_letters(text).alias("letters"))
    return F.struct(*counts)


def readability(measured: Column) -> dict[str, Column]:
    """Flesch reading ease and grade, and the Coleman-Liau index, of ``measures``; 0 for no words."""
    n, s = measured["words"], F.greatest(F.lit(1), measured["sentences"])
    syllable, letters = measured["syllables"], measured["letters"]
    some = n > 0
    return {
        "flesch_ease": F.when(some, 206.835 - 1.015 * (n / s) - 84.6 * (syllable / n)).otherwise(0.0),
        "flesch_grade": F.when(some, 0.39 * (n / s) + 11.8 * (syllable / n) - 15.59).otherwise(0.0),
        "coleman_liau": F.when(some, 0.0588 * (letters / n * 100) - 0.296 * (s / n * 100) - 15.8).otherwise(0.0),
    }


def clean(text: str | Column) -> Column:
    """Plain punctuation, no zero-width characters, single spaces, trimmed."""
    t = F.translate(F.translate(text_of(text), ZERO_WIDTH, ""), CURLY, PLAIN)
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def strip_bibliography(text: str | Column) -> Column:
    """Text before a line that only says References, Bibliography or Works Cited."""
    return F.regexp_replace(text_of(text), r"(?is)(^|\n)[ \t]*(references|bibliography|works cited)[ \t]*:?[ \t]*(\n.*|$)", "")


def strip_markdown(text: str | Column) -> Column:
    """Text without headings' marks, emphasis, code fences, images and link targets."""
    t = F.regexp_replace(text_of(text), r"(?m)^```.*$", "")
    for pattern, to in ((r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^>\s?", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(\*\*|__|\*|`)", "")):
        t = F.regexp_replace(t, pattern, to)
    return t


def html_text(html: str | Column) -> Column:
    """Visible text of a page: no scripts, styles, navigation, comments or tags."""
    t = F.regexp_replace(text_of(html), r"(?s)<!--.*?-->", " ")
    for tag in DROPPED_TAGS:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(to))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def html_layout(html: str | Column) -> Column:
    """Names of layout tags in their order."""
    return F.transform(F.regexp_extract_all(text_of(html), F.lit(r"(?i)<(h[1-6]|p|ul|ol|li|table|tr|td|div|section|article|blockquote|pre)\b"), F.lit(1)), F.lower)


def marker_language(text: str | Column, least: float = 0.15) -> Column:
    """Language whose marker words have the largest share, over ``least``; ties by code; else ``unknown``."""

    def judge(w: Column) -> Column:
        n = F.greatest(F.lit(1), F.size(w))
        scored = F.array(*[F.struct((-(_share(w, m) / n)).alias("s"), F.lit(code).alias("code")) for code, m in sorted(MARKERS.items())])
        return let(F.array_min(scored), lambda best: F.when(-best["s"] > least, best["code"]).otherwise("unknown"))

    return let(words(text), judge)


def _share(w: Column, markers: Sequence[str]) -> Column:
    return F.size(F.filter(w, lambda x: x.isin(*markers)))


def script(text: str | Column) -> Column:
    """Script of most letters: latin, cyrillic, greek, arabic, han, or none."""
    t = text_of(text)
    blocks = {"arabic": "IsArabic", "cyrillic": "IsCyrillic", "greek": "IsGreek", "han": "IsHan", "latin": "IsLatin"}
    counted = F.array(*[F.struct((-F.regexp_count(t, F.lit(rf"\p{{{c}}}"))).alias("n"), F.lit(k).alias("script")) for k, c in blocks.items()])
    return let(F.array_min(counted), lambda best: F.when(best["n"] < 0, best["script"]).otherwise("none"))


def obfuscation(text: str | Column) -> dict[str, Column]:
    """Densities of zero-width, look-alike and control characters, and a score from 0 to 1."""
    t = text_of(text)
    n = F.greatest(F.lit(1), F.length(t))
    zero = F.length(t) - F.length(F.translate(t, ZERO_WIDTH, ""))
    alike = F.length(t) - F.length(F.translate(t, LOOKALIKE, ""))
    control = F.regexp_count(t, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"))
    return {"zero_width": zero / n, "lookalike": alike / n, "control": control / n, "score": F.least(F.lit(1.0), (zero * 10 + alike * 5 + control * 5) / n)}


def strip_obfuscation(text: str | Column) -> Column:
    return F.translate(F.translate(text_of(text), ZERO_WIDTH, ""), LOOKALIKE, LATIN)


def window_texts(text: str | Column, size: int, step: int) -> Column:
    """Windows of ``size`` words every ``step`` words; one shorter window for a short text."""

    def cut(w: Column) -> Column:
        last = F.greatest(F.lit(1), F.size(w) - size + 1)
        return F.transform(F.sequence(F.lit(1), last, F.lit(step)), lambda i: F.slice(w, i, size))

    return let(words(text), cut)


def mask_entities(text: str | Column) -> Column:
    """Dates, e-mail addresses and long numbers replaced by marks."""
    t = text_of(text)
    for pattern, mark in ((r"[\w.+-]+@[\w-]+\.[\w.]+", "[EMAIL]"), (r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b", "[DATE]"), (r"\b\d{6,}\b", "[NUMBER]")):
        t = F.regexp_replace(t, pattern, mark)
    return t
