"""What texts hold: citations, search queries, injection phrases, snippets, change points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import STOP_WORDS, let, text_of

# Phrases by which texts try to steer a model.
INJECTIONS = (
    r"ignore (all )?(previous|prior|above) (instructions|prompts)", r"disregard (all )?(previous|prior|above)", r"you are now", r"system prompt", r"act as (an?|the) ", r"<\|im_(start|end)\|>",
)
# Lines of references by author, year and title.
APA = r"^\s*([^()\[\]]{2,100}?)\s*\(((?:19|20)\d{2})\)\.?\s*([^.]{3,200})\."
IEEE = r'^\s*\[\d+\]\s*([^"]{2,100}?),\s*"([^"]{3,200}?),?"\D*((?:19|20)\d{2})'
YEAR = r"\b((?:19|20)\d{2})\b"


def injection_hits(text: str | Column) -> Column:
    """Number of different steering phrases in a text."""
    t = F.lower(text_of(text))
    return sum((F.regexp_like(t, F.lit(p)).cast("int") for p in INJECTIONS), F.lit(0))


def search_queries(text: str | Column, most: int = 3, words: int = 7) -> Column:
    """The longest sentences of over 30 characters as quoted queries of their first words that are no stop words.

    An array of ``query, weight``; ties of length keep the order of the text.
    """
    plain = F.lower(F.regexp_replace(text_of(text), r"(?U)[^\w\s.]", ""))
    long = F.filter(F.transform(F.split(plain, r"\."), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 30)
    ordered = F.array_sort(F.transform(long, lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s"))))

    def query(x: Column, i: Column) -> Column:
        kept = F.filter(F.split(x["s"], r"\s+"), lambda w: ~w.isin(*STOP_WORDS))
        return F.struct(F.array_join(F.slice(kept, 1, words), " ").alias("query"), F.round(1 - 0.1 * i, 1).alias("weight"))

    return F.filter(F.transform(F.slice(ordered, 1, most), query), lambda q: q["query"] != "")


def snippet(text: str | Column, words: list[str], around: int = 60) -> Column:
    """Text around the earliest of some lower-case words; the beginning if none occurs."""
    t = text_of(text)
    found = F.array_min(F.array(*[F.nullif(F.instr(F.lower(t), w), F.lit(0)) for w in words]))
    start = F.greatest(F.lit(1), F.coalesce(found, F.lit(1)) - around)
    return F.substring(t, start, F.lit(2 * around))


def safe_file_name(name: str | Column, most: int = 100) -> Column:
    """A name of letters, digits, dots, dashes and underscores; never empty."""
    plain = F.regexp_replace(F.regexp_replace(text_of(name), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(plain == "", "file").otherwise(F.substring(plain, 1, most))


def natural_key(name: str | Column) -> Column:
    """Lower-case name whose numbers sort by value: each is padded to twelve digits."""
    parts = F.regexp_extract_all(F.lower(text_of(name)), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit(r"^\d")), F.lpad(p, 12, "0")).otherwise(p)), "")


def citation_keys(text: str | Column) -> Column:
    """Distinct SHA-256 keys of ``Author (year). Title.`` and ``[n] Author, "Title", year`` lines."""
    lines = F.split(text_of(text), r"\n")

    def key(author: Column, year: Column, title: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lower(F.trim(author)), year, F.lower(F.trim(title))), 256)

    def one(line: Column) -> Column:
        a = key(F.regexp_extract(line, APA, 1), F.regexp_extract(line, APA, 2), F.regexp_extract(line, APA, 3))
        i = key(F.regexp_extract(line, IEEE, 1), F.regexp_extract(line, IEEE, 3), F.regexp_extract(line, IEEE, 2))
        return F.when(F.regexp_like(line, F.lit(APA)), a).when(F.regexp_like(line, F.lit(IEEE)), i)

    return F.array_distinct(F.filter(F.transform(lines, one), lambda k: k.isNotNull()))


def cusum(values: Column, multiplier: float = 2.0) -> Column:
    """Change points of a series: array of ``at, direction, score``; sums start anew after each.

    Sums of deviations from the mean, less half a population deviation, are
    compared with ``multiplier`` deviations. A constant series has none.
    """

    def fold(x: Column) -> Column:
        n = F.size(x)
        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n

        def with_sd(m: Column) -> Column:
            sd = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / n)
            return let(sd, lambda s: points(x, m, s))

        return F.when(n > 0, let(mean, with_sd))

    def points(x: Column, m: Column, s: Column) -> Column:
        none = F.expr("cast(array() as array<struct<at:int,direction:string,score:double>>)")
        start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), none.alias("found"))

        def step(a: Column, v: Column) -> Column:
            up = F.greatest(F.lit(0.0), a["up"] + (v - m) - s * 0.5)
            down = F.greatest(F.lit(0.0), a["down"] - (v - m) - s * 0.5)
            top = multiplier * s
            rise = F.array(F.struct(a["i"].alias("at"), F.lit("increase").alias("direction"), up.alias("score")))
            fall = F.array(F.struct(a["i"].alias("at"), F.lit("decrease").alias("direction"), down.alias("score")))
            found = F.concat(a["found"], F.when(up > top, rise).otherwise(none), F.when(down > top, fall).otherwise(none))
            return F.struct((a["i"] + 1).alias("i"), F.when(up > top, 0.0).otherwise(up).alias("up"), F.when(down > top, 0.0).otherwise(down).alias("down"), found.alias("found"))

        return F.when(s > 0, F.aggregate(x, start, step, lambda a: a["found"])).otherwise(none)

    return let(values, fold)
