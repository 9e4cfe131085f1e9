"""Set-similarity self-joins, by Jaccard or containment, with prefix filtering and, on large tables, MinHash: without all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.components import connected_components
from pairloom.runtime import cut

#: Pairs of a shared token, for each set, up to which prefixes are joined.
MET = 400
#: Bands of a MinHash signature, hashes of a band, hashes of a sketch (four bits each), and sets of a band up to which all its pairs are candidates.
BANDS, ROWS, SKETCH, CROWD = 240, 3, 256, 64
#: Blocks of sets at least, and bytes of sketches of a block, about.
LEAST_BLOCKS, SKETCHES = 6, 32 << 20
#: Meetings of first tokens that a task looks at together, about.
MEETINGS = 1 << 20
#: Slots in which tokens are counted together (a power of two), and tokens that a task takes at once, about.
SLOTS, TAKEN = 1 << 18, 1 << 19
#: Spreads the bits of a hash.
MIX = np.uint64(0x9E3779B97F4A7C15)


def jaccard_join(docs: DataFrame, key: str, tokens: str, threshold: float, within: str | None = None) -> DataFrame:
    """Pairs ``(doc_a, doc_b, sim)`` with Jaccard similarity of at least ``threshold``.

    ``tokens`` holds a set. Sets with equal tokens are one class, which its smallest
    key stands for: pairs are those of the keys of two classes, and the key of a
    class with each other member of it (similarity 1). So no link between
    different sets is lost, and a class of any size gives rows in proportion.

    Tokens are ordered from rare to frequent; two sets reach the threshold only if
    their first few tokens share one, so only those are joined, and the positions
    of what they share bound what they can share in all; only pairs whose bound
    suffices are compared. ``within`` restricts pairs to equal, non-null values.
    Empty sets pair with nothing.

    In a large table the first tokens are frequent too, and what meets there grows
    with the square of the rows. From ``MET`` such meetings for each set on, the
    candidates are sets that agree in a band of MinHashes over all but their most
    frequent tokens; sets of a band with more than ``CROWD`` of them meet by their
    first tokens instead, inside pairs of blocks, so what meets there is never shuffled.
    Of all candidates only those are compared whose sketches, four bits of each of
    ``SKETCH`` MinHashes over all tokens, agree nearly as often as the threshold says
    (six standard errors less). Sketches are dealt to pairs of blocks, which the
    candidates meet, so they are copied for each block and not for each candidate;
    whole sets are dealt by groups of linked candidates. Two sets at a threshold of 0.59 then miss each other with a
    probability below 3e-7, however their tokens lie, and below 1e-22 where what differs
    is spread evenly. What is a candidate is always compared by all its tokens. Of a
    token only its 64-bit hash is kept; classes are made by SHA-256 of the tokens themselves.
    """
    base = docs.select(
        F.col(key).alias("id"),
        (F.col(within) if within else F.lit(0)).alias("part"),
        F.sort_array(F.array_distinct(tokens)).alias("tokens"),
    ).where((F.size("tokens") > 0) & F.col("part").isNotNull())
    # a set has a number, and a token its hash, so what is kept and joined is narrow
    classed = base.select("id", F.unhex(F.sha2(F.to_json(F.struct("part", "tokens")), 256)).alias("class"), F.expr("transform(tokens, t -> xxhash64(part, t))").alias("hashes"))
    base = cut(classed.withColumn("c", F.monotonically_increasing_id()))
    first = base.groupBy("class").agg(F.min(F.struct("id", "c")).alias("first"))
    copies = cut(base.select("class", "id", "c").join(first, "class").where(F.col("c") != F.col("first.c")).select(F.col("first.id").alias("doc_a"), F.col("id").alias("doc_b"), "c"))
    sets = base.join(_few(copies.select("c")), "c", "left_anti").select("c", F.col("id").alias("rep"), "hashes")
    hashed = sets.select("c", "hashes")
    slot = lambda h: F.col(h).bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")
    counts = np.zeros(SLOTS, np.int64)
    for row in hashed.select(F.explode("hashes").alias("h")).groupBy(slot("h")).count().toLocalIterator():  # a number for each slot
        counts[row["slot"]] = row["count"]
    by_rarity = hashed.mapInArrow(_by_rarity(counts), "c long, ordered array<long>")
    n = F.size("ordered")

    def first_tokens(rows: DataFrame, share: float) -> DataFrame:
        """The tokens of which one is shared by any partner with which at least ``share`` of the set is."""
        firsts = rows.select("c", n.alias("n"), F.posexplode(F.slice("ordered", F.lit(1), _many(n, share))).alias("at", "h"))
        return firsts.select("c", "n", (F.col("at") + 1).alias("at"), "h")

    # of two sets the smaller shares 2t / (1 + t) of its tokens, the larger t
    firsts = lambda rows: (first_tokens(rows, 2 * threshold / (1 + threshold)), first_tokens(rows, threshold))
    a, b = firsts(by_rarity)
    each = a.select(slot("h"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(slot("h"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    met = each.groupBy("slot").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0
    drop, least = _kept_share(threshold)
    if met <= MET * sets.count() or (1 - least**ROWS) ** BANDS > 1e-5:
        x, y = sets.alias("x"), sets.alias("y")
        shared = F.size(F.array_intersect("x.hashes", "y.hashes"))
        sim = (shared / (F.size("x.hashes") + F.size("y.hashes") - shared)).alias("sim")
        met = _prefix_pairs(a, b, threshold).join(x, F.col("ca") == F.col("x.c")).join(y, F.col("cb") == F.col("y.c"))
        found = met.select(F.least("x.rep", "y.rep").alias("doc_a"), F.greatest("x.rep", "y.rep").alias("doc_b"), sim).where(F.col("sim") >= threshold)
    else:
        # bands are shuffled as they are made and never kept; sketches are made by themselves
        signed = by_rarity.mapInArrow(_signatures(drop), "c long, bands array<long>")
        sketches = cut(by_rarity.mapInArrow(_sketches, "c long, sketch array<long>"))
        banded = signed.select("c", F.explode("bands").alias("band")).groupBy("band").agg(F.array_sort(F.collect_list("c")).alias("sets"))
        buckets = cut(banded.where(F.size("sets") > 1).select("sets"))
        crowd = cut(buckets.where(F.size("sets") > CROWD).select(F.explode("sets").alias("c")).distinct())
        each = buckets.where(F.size("sets") <= CROWD).select("sets", F.posexplode("sets").alias("at", "ca"))
        proposed = each.select("ca", F.explode(F.slice("sets", F.col("at") + 2, F.lit(CROWD))).alias("cb"))
        crowded = hashed.join(_few(crowd), "c", "left_semi").mapInArrow(_by_rarity(counts), "c long, ordered array<long>")
        close = _close(crowded, sketches.join(_few(crowd), "c", "left_semi"), threshold)
        candidates = cut(_likely(proposed.distinct(), sketches, threshold).unionByName(close).distinct())
        scored = _compared(candidates, hashed, threshold)
        x, y = (sets.select(F.col("c").alias(f"c{k}"), F.col("rep").alias(f"rep{k}")) for k in "ab")
        found = scored.join(x, "ca").join(y, "cb").select(F.least("repa", "repb").alias("doc_a"), F.greatest("repa", "repb").alias("doc_b"), "sim")
    members = copies.where("doc_a <> doc_b")
    return found.unionByName(members.select("doc_a", "doc_b", F.lit(1.0).alias("sim")))


def _few(numbers: DataFrame) -> DataFrame:
    """Numbers that are counted, and sent to all tasks if they are at most 500,000."""
    return F.broadcast(numbers) if numbers.count() <= 500_000 else numbers


def _many(n: Column, share: float) -> Column:
    """Of ``n`` ordered tokens so many first ones, of which any set that holds at least ``share`` of all holds one."""
    return n - F.ceil(n * F.lit(share) - F.lit(1e-9)).cast("int") + 1


def _prefix_pairs(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """``ca, cb`` of sets that share one of their first tokens, where the places of what they share leave enough."""
    a, b = a.alias("a"), b.alias("b")
    smaller = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.c") < F.col("b.c")))
    same = (F.col("a.h") == F.col("b.h")) & smaller & (F.col("a.n") >= F.col("b.n") * F.lit(threshold))
    needed = F.ceil((F.col("a.n") + F.col("b.n")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    after = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    met = a.join(b, same & (F.least("a.at", "b.at") + after >= needed))
    # what is shared so far and can still be shared behind the last shared token is enough, if so many tokens are shared
    found = met.groupBy(F.col("a.c").alias("ca"), F.col("b.c").alias("cb")).agg(F.count("*").alias("shared"), F.max(needed - after).alias("least"))
    return found.where(F.col("shared") >= F.col("least")).select("ca", "cb")


def _in_blocks(pairs: DataFrame, rows: DataFrame, blocks: int, ready: Callable, judge: Callable, schema: str) -> DataFrame:
    """What ``judge`` makes of pairs ``ca, cb`` of rows (``c`` and a list), dealt to pairs of blocks of the rows.

    A task holds the rows of two blocks, as ``ready`` makes them of the lists, and
    reads its pairs in batches. A row is copied once for each block.
    """
    name = next(x for x in rows.columns if x != "c")
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    both = lambda p, q: (F.least(p, q).alias("x"), F.greatest(p, q).alias("y"))
    held = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"), "c", name)
    held = held.select(*both(F.col("other"), block("c")), F.col("c").alias("ca"), F.lit(None).cast("long").alias("cb"), name)
    met = pairs.select(*both(block("ca"), block("cb")), "ca", "cb", F.lit(None).cast(rows.schema[name].dataType).alias(name))
    return _judged(held.unionByName(met).repartition(2 * blocks * blocks, "x", "y"), name, ready, judge, schema)


def told_apart(rows: DataFrame, key: str) -> bool:
    """Whether ``key`` is a long that no two rows share, as ``in_groups`` needs it; nulls, which no pair names, may repeat."""
    return rows.schema[key].dataType.simpleString() == "bigint" and rows.select(key).where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty()


#: Rows of a group of pairs that are dealt together.
TOGETHER = 512


def in_groups(pairs: DataFrame, rows: DataFrame, ready: Callable, judge: Callable, schema: str, together: int = TOGETHER, tasks: int | None = None) -> DataFrame:
    """As ``_in_blocks``, for pairs of which a row may have many: rows that pairs link are dealt together, so each is copied once.

    Groups of more than about ``together`` rows are cut into blocks, which meet two by
    two where a pair asks for it. Pairs should be cut, and rows have distinct ``c``;
    pairs of which a row is missing give nothing.
    """
    name = next(x for x in rows.columns if x != "c")
    member = cut(connected_components(pairs, "ca", "cb"))
    large = member.groupBy("component").agg(F.ceil(F.count("*") / together).cast("int").alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")
    placed = cut(member.join(large, "component", "left").select("node", "component", part.alias("part")))
    at = lambda c: placed.select(F.col("node").alias(c), F.col("part").alias(f"p{c}"), *([F.col("component").alias("x")] if c == "ca" else []))
    both = F.least("pca", "pcb") * F.lit(1 << 20) + F.greatest("pca", "pcb")
    met = cut(pairs.join(at("ca"), "ca").join(at("cb"), "cb").select("x", both.cast("long").alias("y"), "ca", "cb"))
    asked = met.select("x", "y", F.explode(F.array("ca", "cb")).alias("c")).distinct()
    held = _few(cut(asked)).join(rows, "c").select("x", "y", F.col("c").alias("ca"), F.lit(None).cast("long").alias("cb"), name)
    return _judged(held.unionByName(met.withColumn(name, F.lit(None).cast(rows.schema[name].dataType))).repartition(*([tasks] if tasks else []), "x", "y"), name, ready, judge, schema)


#: Bytes of texts that are handed on together, about.
HANDED = 4 << 20
#: Texts of a group that are dealt together where much is done for each pair, and tasks for each core.
FEWER, SPREAD = 32, 4


def beside(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc_a, doc_b, t_a, t_b``: pairs with the texts (``c, t``, no null) of both sides, each dealt once to its group of pairs and not to each pair.

    ``texts`` has distinct ``c``, and no pair is a loop; pairs without a text are not listed.
    """

    def ready(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
        return lists, np.asarray(pa.compute.binary_length(lists), np.int64)

    def judge(made: tuple, ca: np.ndarray, cb: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[pa.RecordBatch]:
        lists, n = made
        runs = np.flatnonzero(np.diff(np.cumsum(n[a] + n[b]) // HANDED)) + 1
        sides = lambda some: [pa.array(ca[some]), pa.array(cb[some]), lists.take(pa.array(a[some])), lists.take(pa.array(b[some]))]
        return [pa.RecordBatch.from_arrays(sides(some), ["doc_a", "doc_b", "t_a", "t_b"]) for some in np.split(np.arange(len(a)), runs)]

    asked = cut(pairs.select(F.col("doc_a").alias("ca"), F.col("doc_b").alias("cb")))
    # what follows may take long for a pair, so a large group is no task of its own
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), SPREAD * pairs.sparkSession.sparkContext.defaultParallelism)
    return in_groups(asked, texts.select("c", "t"), ready, judge, "doc_a long, doc_b long, t_a string, t_b string", FEWER, tasks)


def _judged(dealt: DataFrame, name: str, ready: Callable, judge: Callable, schema: str) -> DataFrame:
    """What ``judge`` makes of pairs ``ca, cb`` beside the rows (``ca`` and a list, no ``cb``) of the same ``x, y``."""
    dealt = dealt.sortWithinPartitions("x", "y", "cb")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, some, numbers, made = None, [], None, None
        for batch in batches:
            x, y, asks = batch.column("x").to_numpy(), batch.column("y").to_numpy(), ~batch.column("cb").is_null().to_numpy(zero_copy_only=False)
            cuts = np.append(np.flatnonzero(np.append(True, (np.diff(x) != 0) | (np.diff(y) != 0) | (np.diff(asks) != 0))), len(x)) if len(x) else []
            for at, end in zip(cuts, cuts[1:], strict=False):
                run = batch.slice(at, end - at)
                if (x[at], y[at]) != key:
                    key, some, made = (x[at], y[at]), [], None
                if not asks[at]:
                    some.append(run.select(["ca", name]))
                    continue
                if made is None and not some:
                    continue
                if made is None:
                    whole = pa.Table.from_batches(some).combine_chunks()
                    numbers, some = whole.column("ca").to_numpy(), []
                    order = np.argsort(numbers, kind="stable")
                    made = ready(whole.column(name).chunk(0))
                ca, cb = run.column("ca").to_numpy(), run.column("cb").to_numpy()
                a, b = (order[np.minimum(np.searchsorted(numbers, c, sorter=order), len(order) - 1)] for c in (ca, cb))
                known = (numbers[a] == ca) & (numbers[b] == cb)
                if known.any():
                    found = judge(made, *(v[known] for v in (ca, cb, a, b)))
                    yield from found if isinstance(found, list) else [found]

    return dealt.mapInArrow(judged, schema)


def _near(made: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Of pairs of sketches, whether they agree in the share ``threshold``, less six standard errors."""
    same = threshold + (1 - threshold) / 16  # of unequal hashes a sixteenth has equal bits
    enough, near = same * SKETCH - 6 * (SKETCH * same * (1 - same)) ** 0.5, np.empty(len(a), bool)
    for i in range(0, len(a), 4096):
        other = made[a[i : i + 4096]] ^ made[b[i : i + 4096]]
        other |= other >> np.uint64(1)
        other |= other >> np.uint64(2)
        near[i : i + 4096] = SKETCH - np.bitwise_count(other & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64) >= enough
    return near


def _unpacked(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SKETCH // 16)


def _likely(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """``ca, cb`` of pairs whose sketches (``c, sketch``) agree nearly as often as the threshold says."""

    def judge(made: np.ndarray, ca: np.ndarray, cb: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        near = _near(made, a, b, threshold)
        return pa.RecordBatch.from_arrays([pa.array(ca[near]), pa.array(cb[near])], ["ca", "cb"])

    blocks = max(LEAST_BLOCKS, -(-sketches.count() * SKETCH // 2 // SKETCHES))
    return _in_blocks(pairs, sketches, blocks, _unpacked, judge, "ca long, cb long")


def _close(rows: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """``ca, cb`` of sets (``c, ordered``) that share one of their first tokens, and whose sketches agree nearly as often as the threshold says.

    Sets are dealt to pairs of blocks with their first tokens and sketches. What meets
    is met, and dropped, inside a task, some ``MEETINGS`` at once.
    """
    n = F.size("ordered")
    firsts = F.slice("ordered", F.lit(1), _many(n, threshold)).alias("firsts")
    first = rows.select("c", n.alias("n"), _many(n, 2 * threshold / (1 + threshold)).alias("ahead"), firsts)
    held = cut(first.join(sketches, "c"))
    total = held.agg(F.sum(8 * F.size("firsts") + SKETCH // 2)).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-total // SKETCHES))
    block = F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int")
    dealt = held.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), *held.columns, "block")

    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        c, n, ahead, block = (group.column(x).to_numpy() for x in ("c", "n", "ahead", "block"))
        sketch, lists = _unpacked(group.column("sketch").chunk(0)), group.column("firsts").chunk(0)
        h, many = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
        row = np.repeat(np.arange(len(c)), many)
        at = np.arange(1, len(h) + 1) - np.repeat(np.cumsum(many) - many, many)
        two = group.column("x")[0].as_py() != group.column("y")[0].as_py()
        by = np.argsort(h, kind="stable")
        own = np.flatnonzero(at <= ahead[row])
        low, high = (np.searchsorted(h, h[own], side, sorter=by) for side in ("left", "right"))
        found = [np.empty(0, np.int64)]
        for some in np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum(high - low) // MEETINGS)) + 1):
            met = (high - low)[some]
            i = np.repeat(own[some], met)
            j = by[np.arange(len(i)) + np.repeat(low[some] - (np.cumsum(met) - met), met)]
            a, b = row[i], row[j]
            smaller = (n[a] < n[b]) | ((n[a] == n[b]) & (c[a] < c[b]))
            ok = smaller & (n[a] >= n[b] * threshold) & ((block[a] != block[b]) | (not two))
            i, j, a, b = (v[ok] for v in (i, j, a, b))
            # what can be shared at most, by the places of the shared token
            most = np.minimum(at[i], at[j]) + np.minimum(n[a] - at[i], n[b] - at[j])
            ok = most >= np.ceil((n[a] + n[b]) * (threshold / (1 + threshold)) - 1e-9)
            pairs = np.unique(a[ok] * len(c) + b[ok])
            found.append(pairs[_near(sketch, *np.divmod(pairs, len(c)), threshold)])
        a, b = np.divmod(np.unique(np.concatenate(found)), max(1, len(c)))
        return pa.table({"ca": np.minimum(c[a], c[b]), "cb": np.maximum(c[a], c[b])})

    return dealt.groupBy("x", "y").applyInArrow(meet, "ca long, cb long")


def _compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``ca, cb, sim`` of pairs whose sets (``c, hashes``) have a Jaccard similarity of at least ``threshold``."""

    def ready(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each set begins, its tokens as numbers, and a mark for each number."""
        words = lists.flatten().dictionary_encode()
        begin = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))
        return begin, words.indices.to_numpy(), np.zeros(len(words.dictionary), bool)

    def judge(made: tuple, ca: np.ndarray, cb: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        begin, words, marked = made
        shared, own = np.empty(len(a), np.int64), words[:0]
        last = -1
        for i in np.argsort(a, kind="stable"):
            if a[i] != last:
                marked[own] = False
                last, own = a[i], words[begin[a[i]] : begin[a[i] + 1]]
                marked[own] = True
            shared[i] = np.count_nonzero(marked[words[begin[b[i]] : begin[b[i] + 1]]])
        marked[own] = False
        sim = shared / (begin[a + 1] - begin[a] + begin[b + 1] - begin[b] - shared)
        near = sim >= threshold
        return pa.RecordBatch.from_arrays([pa.array(x[near]) for x in (ca, cb, sim)], ["ca", "cb", "sim"])

    return in_groups(pairs, sets, ready, judge, "ca long, cb long, sim double")


def _kept_share(threshold: float) -> tuple[float, float]:
    """The share of a set's most frequent tokens that signatures leave out, and the least Jaccard similarity of what two alike sets keep.

    The sets have 1 and x tokens, t <= x <= 1, and share t / (1 + t) * (1 + x). That
    of which the kept tokens end earlier misses at most its unshared tokens, and all
    else that it keeps the other keeps too; the larger set may miss more.
    """
    drop = max(0.0, threshold - 0.34)

    def least(x: float) -> float:
        both = threshold / (1 + threshold) * (1 + x) - drop
        return both / ((1 - drop) * (1 + x) - both)

    return drop, min(least(threshold), least(1.0))


def lists_of(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of each batch, in runs of about ``TAKEN`` numbers: ``c``, and the lengths and numbers of the lists ``name``."""
    for batch in batches:
        run = np.asarray(batch.column(name).offsets.to_numpy(), np.int64) // TAKEN
        cuts = np.append(np.flatnonzero(np.diff(run[:-1], prepend=-1)), batch.num_rows)
        for at, end in zip(cuts, cuts[1:], strict=False):
            some = batch.slice(at, end - at)
            lists = some.column(name)
            yield some.column("c"), np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)


def listed(lengths: np.ndarray, numbers: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(numbers))


def _by_rarity(counts: np.ndarray):  # noqa: ANN202
    """For ``mapInArrow``: ``c, ordered``, the tokens of each set from those of rare slots to those of frequent ones, in one order for all sets."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, n, tokens in lists_of(batches, "hashes"):
            by = np.lexsort((tokens, counts[tokens & (SLOTS - 1)], np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([c, listed(n, tokens[by])], ["c", "ordered"])

    return order


def _draw() -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and a mask for each hash."""
    draw = np.random.default_rng(59)
    odd, mask = (draw.integers(0, 2**64, BANDS * ROWS, np.uint64) for _ in range(2))
    return odd | np.uint64(1), mask


def _signatures(drop: float):  # noqa: ANN202
    """For ``mapInArrow``: ``c, bands`` of sets whose tokens ``ordered`` run from rare to frequent."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, mask = _draw()
        for c, n, tokens in lists_of(batches, "ordered"):
            kept = n - np.floor(n * drop + 1e-9).astype(np.int64)
            start = np.cumsum(kept) - kept
            own = tokens.view(np.uint64)[np.arange(kept.sum()) - np.repeat(start, kept) + np.repeat(np.cumsum(n) - n, kept)]
            least = np.empty((BANDS * ROWS, len(n)), np.uint64)
            for i, (o, m) in enumerate(zip(odd, mask, strict=True)):
                least[i] = np.minimum.reduceat((own ^ m) * o, start)
            band = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(n), axis=1)
            for r in range(ROWS):
                band = (band ^ least[r * BANDS : (r + 1) * BANDS]) * MIX
                band ^= band >> np.uint64(29)
            band >>= np.uint64(24)  # shuffled short: of 40 bits
            yield pa.RecordBatch.from_arrays([c, listed(np.full(len(n), BANDS), np.ascontiguousarray(band.T).view(np.int64).ravel())], ["c", "bands"])

    return sign


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: ``c, sketch``, four bits of each of the MinHashes over all tokens."""
    odd, mask = _draw()
    for c, n, tokens in lists_of(batches, "ordered"):
        start, tokens = np.cumsum(n) - n, tokens.view(np.uint64)
        sketch = np.empty((SKETCH, len(n)), np.uint64)
        for i in range(SKETCH):
            sketch[i] = np.minimum.reduceat((tokens ^ mask[i]) * odd[i], start)
        sketch = (sketch * MIX >> np.uint64(60)).astype(np.uint8)
        sketch = np.ascontiguousarray((sketch[::2] | sketch[1::2] << np.uint8(4)).T).view(np.int64)
        yield pa.RecordBatch.from_arrays([c, listed(np.full(len(n), sketch.shape[1]), sketch.ravel())], ["c", "sketch"])


#: Tokens of a packed block of the containment join, at most and, if there are few, at least, about.
PACKED, LEAST_PACKED = 1 << 22, 1 << 17
#: Sets of a packed block, at most about.
HOT = 1 << 15


def containment_join(docs: DataFrame, key: str, tokens: str, threshold: float, hot: int = HOT) -> DataFrame:
    """Pairs ``(doc_a, doc_b, overlap)`` whose shared tokens are more than ``threshold`` of the smaller set.

    Classes of equal sets, and the pairs and members that are returned, are as in
    ``jaccard_join``. Only of the smaller set of a pair a few tokens are needed: with
    the threshold reached, one of its rarest ``n - floor(threshold * n)`` is in the
    larger set, wherever it stands there, and of a few more tokens as many more are.
    Sets are packed to blocks of about ``hot`` sets or fewer, a row each, that are written once; every two blocks
    meet in a task that reads them from there, so neither tokens nor candidates are
    shuffled. Of a token only its 64-bit hash is kept; classes are made by SHA-256 of the
    tokens themselves.
    """
    base = docs.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("tokens")).where(F.size("tokens") > 0)
    classed = base.select("id", F.unhex(F.sha2(F.to_json("tokens"), 256)).alias("class"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    keyed = cut(classed.withColumn("c", F.monotonically_increasing_id()))
    classes = cut(keyed.groupBy("class").agg(F.min("id").alias("rep"), F.min("c").alias("c")))
    members = keyed.select("class", F.col("id").alias("doc_b")).join(classes.select("class", F.col("rep").alias("doc_a")), "class").where("doc_a <> doc_b")
    members = cut(members.select("doc_a", "doc_b", F.lit(1.0).alias("overlap")))
    sets = keyed.join(_few(classes.select("c")), "c", "left_semi").select("c", "hashes")
    counts = np.zeros(SLOTS, np.int64)
    slot = F.col("h").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")
    for row in sets.select(F.explode("hashes").alias("h")).groupBy(slot).count().toLocalIterator():  # a number for each slot
        counts[row["slot"]] = row["count"]
    total = int(counts.sum())
    blocks = max(-(-total // PACKED), min(LEAST_BLOCKS, -(-total // LEAST_PACKED)), -(-classes.count() // hot), 1)
    held = cut(sets.repartition(blocks, "c").mapInArrow(_by_rarity(counts), "c long, ordered array<long>").mapInArrow(_packed(PACKED), "block long, c binary, n binary, words binary, ids binary"))
    x, y = (held.select(*[F.col(name).alias(f"{name}_{side}") for name in held.columns]) for side in "xy")
    met = x.hint("shuffle_replicate_nl").join(y, F.col("block_x") <= F.col("block_y"))
    found = met.mapInArrow(_contained(threshold), "ca long, cb long, shared long, n long")
    of = lambda c, rep: classes.select(F.col("c").alias(c), F.col("rep").alias(rep))
    scored = found.join(of("ca", "ra"), "ca").join(of("cb", "rb"), "cb")
    scored = scored.select(F.least("ra", "rb").alias("doc_a"), F.greatest("ra", "rb").alias("doc_b"), (F.col("shared") / F.col("n")).alias("overlap"))
    return scored.unionByName(members)


def _packed(most: int):  # noqa: ANN202
    """For ``mapInArrow``: blocks of the sets ``c, ordered`` of a partition, of about ``most`` tokens: numbers, lengths, distinct tokens and, of each token, its place among those."""

    def block(c: list, n: list, tokens: list) -> pa.RecordBatch:
        c, n = np.concatenate(c), np.concatenate(n).astype(np.int32)
        words, ids = np.unique(np.concatenate(tokens), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array([c.min()]), *(pa.array([v.tobytes()], pa.binary()) for v in (c, n, words, ids.astype(np.int32)))], ["block", "c", "n", "words", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = ([], [], []), 0
        for c, n, tokens in lists_of(batches, "ordered"):
            if many and many + len(tokens) > 2 * most:
                yield block(*held)
                held, many = ([], [], []), 0
            for to, some in zip(held, (c.to_numpy(), n, tokens), strict=True):
                to.append(some)
            many += len(tokens)
        if many:
            yield block(*held)

    return pack


class _Sets:
    """A packed block: numbers and lengths of its sets, its tokens from rare to frequent, and the sets that hold each token."""

    def __init__(self, c: bytes, n: bytes, words: bytes, ids: bytes) -> None:
        self.c, self.n = np.frombuffer(c, np.int64), np.frombuffer(n, np.int32).astype(np.int64)
        self.words, self.ids = np.frombuffer(words, np.int64), np.frombuffer(ids, np.int32)
        self.begin = np.append(0, np.cumsum(self.n))

    def holders(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the sets of each token begin, and those sets."""
        row = np.repeat(np.arange(len(self.c), dtype=np.int32), self.n)
        return np.append(0, np.cumsum(np.bincount(self.ids, minlength=len(self.words)))), row[np.argsort(self.ids, kind="stable")]


def _within(a: _Sets, b: _Sets, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """``ca, cb, shared, n`` of the sets of ``a`` of which more than ``threshold`` is in a larger set of ``b``; of two as large that of the smaller number is the smaller."""
    needed = np.floor(a.n * threshold + 1e-9).astype(np.int64) + 1
    first = np.minimum(a.n, a.n - needed + 1 + a.n // 16)  # tokens that are looked up; of those so many must be shared:
    least = needed - (a.n - first)
    start = np.cumsum(first) - first
    place = np.searchsorted(b.words, a.words)
    place[place == len(b.words)] = 0
    to = np.where(b.words[place] == a.words, place, -1)
    asked = to[a.ids[np.arange(first.sum()) + np.repeat(a.begin[:-1] - start, first)]]
    row = np.repeat(np.arange(len(a.c)), first)
    row, asked = row[asked >= 0], asked[asked >= 0]
    begin, holders = b.holders()
    many = begin[asked + 1] - begin[asked]
    work = np.bincount(row, many, len(a.c)).cumsum() // MEETINGS  # a set's tokens are looked up together
    marked = np.zeros(len(b.words) + 1, bool)
    for some in np.split(np.arange(len(row)), np.flatnonzero(np.diff(work[row])) + 1):
        met = many[some]
        i = np.repeat(row[some], met)
        j = holders[np.arange(len(i)) + np.repeat(begin[asked[some]] - (np.cumsum(met) - met), met)]
        smaller = (a.n[i] < b.n[j]) | ((a.n[i] == b.n[j]) & (a.c[i] < b.c[j]))
        pairs, shared = np.unique(j[smaller].astype(np.int64) * len(a.c) + i[smaller], return_counts=True)
        pairs = pairs[shared >= least[pairs % len(a.c)]]
        j, i = np.divmod(pairs, len(a.c))
        both, last = np.zeros(len(i), np.int64), -1
        for k, (p, q) in enumerate(zip(i, j, strict=True)):
            if q != last:
                marked[:] = False
                marked[b.ids[b.begin[q] : b.begin[q + 1]]] = True
                last = q
            both[k] = np.count_nonzero(marked[to[a.ids[a.begin[p] : a.begin[p + 1]]]])  # -1 is never marked
        near = both > a.n[i] * threshold
        yield a.c[i[near]], b.c[j[near]], both[near], a.n[i[near]]


def _contained(threshold: float):  # noqa: ANN202
    """For ``mapInArrow``: ``ca, cb, shared, n`` of two packed blocks, or one with itself, where ``n`` is the size of the smaller set."""

    def contain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(name)[row] for name in batch.schema.names}
                x, y = (_Sets(*(at[f"{name}_{side}"].as_buffer() for name in ("c", "n", "words", "ids"))) for side in "xy")
                for a, b in ((x, y), (y, x))[: 1 if at["block_x"].as_py() == at["block_y"].as_py() else 2]:
                    for found in _within(a, b, threshold):
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], ["ca", "cb", "shared", "n"])

    return contain
