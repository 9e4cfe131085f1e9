"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed: its blob is the SHA-256 of its
text. A ledger keeps, for each blob, the spans that each rule version found. A
run scans only pairs of blob and rule version that the ledger lacks, each blob
once however many paths hold it, and joins findings back to all paths.

Spans are code points, end exclusive. They come from the pieces between matches
(``split``) and the matches themselves (``regexp_extract_all``), so no character
needs to be kept free as a mark. Null text is empty text and has no spans; equal
rows each get their own result row; columns other than path and text are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.runtime import cut

#: Spans by code points and, ``low`` to ``high``, by bytes of UTF-8.
SPANS = "array<struct<start:int,end:int,low:int,high:int>>"
#: Items that are taken in one step of ``running``.
STEP = 256


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind}\n{self.pattern}\n{self.group}\n{self.least}".encode()).hexdigest()[:16]


# The base rules, in the order in which equal starts are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)


def running(items: Column, start: Column, advance: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """``emit(before, x)`` of each item (as ``kind``), where ``before`` is what ``advance`` made of ``start`` and all items before.

    Items are taken ``STEP`` at a time, so that no array grows by one over them all:
    the work is in proportion to their number.
    """
    many = F.ceil(F.size(items) / STEP).cast("int")
    parts = F.when(many > 0, F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.slice(items, i * STEP + 1, STEP))).otherwise(F.array(F.slice(items, 1, 0)))
    none = F.expr(f"cast(array() as array<{kind}>)")

    def begins(parts: Column) -> Column:
        return F.aggregate(parts, F.array(start), lambda acc, p: F.concat(acc, F.array(F.aggregate(p, F.element_at(acc, -1), advance))))

    def one(part: Column, before: Column) -> Column:
        step = lambda acc, x: F.struct(advance(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], x).cast(kind))).alias("out"))
        return F.aggregate(part, F.struct(before.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    made = F.transform(F.array(parts), lambda p: F.flatten(F.zip_with(p, F.slice(begins(p), F.lit(1), F.size(p)), one)))
    return made[0]


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of a rule's matches in ``text``, leftmost and non-overlapping."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    size = lambda x, by: F.coalesce(by(x), F.lit(0))
    parts = F.transform(
        F.arrays_zip(gaps.alias("gap"), whole.alias("hit"), judged.alias("part")),
        lambda x: F.struct(size(x["gap"], F.length).alias("gap"), size(x["hit"], F.length).alias("size"), size(x["gap"], F.octet_length).alias("wide"), size(x["hit"], F.octet_length).alias("bytes"), size(x["part"], F.length).alias("judged")),
    )

    def step(at: Column, x: Column) -> Column:
        return F.struct((at["start"] + x["gap"] + x["size"]).alias("start"), (at["low"] + x["wide"] + x["bytes"]).alias("low"))

    def span(at: Column, x: Column) -> Column:
        begin, low = at["start"] + x["gap"], at["low"] + x["wide"]
        hit = (x["judged"] >= rule.least) & (x["size"] > 0)
        return F.when(hit, F.struct(begin.alias("start"), (begin + x["size"]).alias("end"), low.alias("low"), (low + x["bytes"]).alias("high")))

    start = F.struct(F.lit(0).alias("start"), F.lit(0).alias("low"))
    found = F.transform(F.array(parts), lambda p: F.array_compact(running(p, start, step, span, "struct<start:int,end:int,low:int,high:int>")))[0]
    # runs of one class of characters need no second look where none is long enough
    some = F.concat(F.lit(rule.pattern[:-1]), F.lit(f"{{{rule.least},}}")) if rule.pattern.endswith("]+") and not rule.group and rule.pattern.startswith("[") else pattern
    return F.when(F.regexp_like(text, some), found).otherwise(F.expr(f"cast(array() as {SPANS})"))


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan(versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger after a run: ``blob``, ``results`` (rule version to spans).

    It has the blobs of ``versions`` and those of the ledger given. Of the pairs
    that the given ledger holds none is scanned again.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    blobs = versions.select(blob_id(body).alias("blob"), body.alias("text"))
    versions_of = [(r, F.lit(r.version)) for r in rules]
    if ledger is None:
        entries = [x for r, v in versions_of for x in (v, rule_spans(F.col("text"), r))]
        return blobs.dropDuplicates(["blob"]).select("blob", F.create_map(*entries).alias("results"))
    old = F.coalesce(F.col("known"), F.expr(f"cast(map() as map<string,{SPANS}>)"))
    complete = F.lit(True)
    for _, v in versions_of:
        complete = complete & F.map_contains_key("results", v)
    known = ledger.where(~complete).select("blob", F.col("results").alias("known"))
    # copies meet on the map side first, so a text that very many paths hold is one row before it is dealt
    unseen = blobs.dropDuplicates(["blob"]).join(ledger.where(complete).select("blob"), "blob", "left_anti").join(known, "blob", "left")
    fresh = [
        F.struct(v.alias("key"), F.when(F.map_contains_key(old, v), old[r.version]).otherwise(rule_spans(F.col("text"), r)).alias("value"))
        for r, v in versions_of
    ]
    others = F.map_filter(old, lambda k, _: ~k.isin([r.version for r in rules]))
    scanned = cut(unseen.select("blob", F.map_concat(others, F.map_from_entries(F.array(*fresh))).alias("results")))
    return scanned.unionByName(ledger.join(scanned, "blob", "left_anti").select("blob", "results"))


def findings(versions: DataFrame, ledger: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per version: path, ``spans`` of all rules by start, then rule order."""
    paths = versions.select(F.col(f"`{path}`").alias(path), blob_id(F.col(f"`{text}`")).alias("blob"))
    return joined_back(paths, ledger, rules).select(path, "spans")


def joined_back(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``paths`` (with their ``blob``) and the ``spans`` that the ledger has for them."""
    found = ledger.select("blob", all_spans("results", rules).alias("spans")).where(F.size("spans") > 0)
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,low:int,high:int>>)")
    return paths.drop("spans").join(found, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def all_spans(results: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of a ledger row with their kinds, in order."""

    def of(rank: int, rule: Rule) -> Column:
        own = F.coalesce(F.col(results)[rule.version], F.expr(f"cast(array() as {SPANS})"))
        return F.transform(own, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(rule.kind).alias("kind"), s["low"].alias("low"), s["high"].alias("high")))

    return F.array_sort(F.concat(*[of(i, r) for i, r in enumerate(rules)]))


def number_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with every span's characters replaced; overlapping spans are one."""
    def written(bytes_: Column) -> Column:
        """Pieces are cut by bytes, each at the cost of its own length."""
        piece = lambda low, high: F.substring(bytes_, low + 1, high - low).cast("string")
        kept = running(spans, F.lit(0), lambda at, s: F.greatest(at, s["high"]), lambda at, s: F.when(s["low"] >= at, F.concat(piece(at, s["low"]), F.lit(mark))).otherwise(""), "string")
        last = F.array_max(F.transform(spans, lambda s: s["high"]))
        return F.concat(F.array_join(kept, ""), piece(last, F.length(bytes_)))

    return F.when(F.size(spans) > 0, F.transform(F.array(text.cast("binary")), written)[0]).otherwise(text)
