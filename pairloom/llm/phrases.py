"""Phrase collocation mining by Rabin-Karp fingerprints.

A task lays its texts end to end, lower-cases A-Z, and keeps the words with one
space between them. Prefix sums of two polynomials, modulo primes near 2^31, give
the fingerprint of any run of words in constant time. Fingerprints of pairs of
words are counted first, then level by level those of longer phrases, each only
where both phrases of a word less may be frequent, and of words in pairs that may
be. What is shuffled is a fingerprint and a number, sorted and packed, never a text.
Counts that reach the bound are marked in a bitmap of at most ``BITS`` bits.

In a last scan each task takes the occurrences that the bitmap lets through and
keeps a pointer to one of each fingerprint. Every other occurrence is verified
word by word against the text at the pointer, and colliding phrases come apart.
Only then is the phrase read from the text; phrases are summed in the task, packed
in order and dealt by their fingerprints, and summed again by language and phrase,
with the least key of the documents as the pointer that remains. So counts are exact whatever collides: collisions, like marks of others in a full
bitmap, only let candidates through that the last sum drops.

A text is split into pieces at ``. , ; : ! ?`` and the bytes 10 to 13, a piece into
words at space and tab; a phrase stands within a piece. Null text is empty; a null
language is ``und``. Texts of any length are read whole, in slices that overlap by
the words of a phrase. Repeated rows count each time; a null key is the pointer only
where no other row holds a phrase.
Equal scores rank by count, then by the phrase in byte order. An empty table gives
no rows. Columns other than the three named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.shingles import mix
from pairloom.llm.streams import SMALL_ROWS, small, tasks
from pairloom.runtime import cut

#: Polynomials: primes and bases.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_000_003_787, 1_618_033_988)
#: Bytes that are scanned at once, numbers that are packed at once, bytes of one prefix sum.
SCAN_BYTES, PACK, SPAN = 4 << 20, 2 << 20, 1 << 18
#: Rows of phrases that a task holds until they are summed.
HELD = 1 << 20
#: Codec of packed phrases, and its level.
CODEC, LEVEL = "zstd", 5
#: Bits of the bitmap at least and at most (as powers of two), and numbers in a bucket, about.
BITS, BUCKET = (16, 27), 1 << 20
#: Ranks are taken within so many parts of a language, then within fewer, then over all.
PARTS = (64, 8)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    lower, kind = np.arange(256, dtype=np.uint8), np.zeros(256, np.uint8)
    lower[65:91] += 32
    kind[[32, 9]] = 1
    kind[[*b".,;:!?", *range(10, 14)]] = 2
    return lower, kind


LOWER, KIND = _classes()


def _powers(base: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) <= SPAN:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[: SPAN + 1]


POWERS = [_powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]
INVERSE = [_powers(pow(b, -1, p), p) for b, p in zip(BASES, PRIMES, strict=True)]


def prefixes(text: np.ndarray, at: np.ndarray, which: int) -> np.ndarray:
    """The polynomial of the first ``at`` bytes, for each of the ascending ``at``."""
    prime, table = np.uint64(PRIMES[which]), POWERS[which]
    out = np.zeros(len(at), np.uint64)
    before, scale = np.uint64(0), np.uint64(1)
    for begin in range(0, max(len(text), 1), SPAN):
        part = text[begin : begin + SPAN]
        last = begin + SPAN >= len(text)
        a, b = np.searchsorted(at, begin), len(at) if last else np.searchsorted(at, begin + SPAN)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * table[: len(part)], out=sums[1:])
        out[a:b] = (before + sums[at[a:b] - begin] % prime * scale) % prime
        before = (before + sums[-1] % prime * scale) % prime
        scale = scale * table[SPAN] % prime
    return out


def _shifts(at: np.ndarray, which: int) -> np.ndarray:
    """The factors that bring windows from ``at`` to the place 0."""
    prime, table = PRIMES[which], INVERSE[which]
    far = np.array([pow(int(table[SPAN]), int(q), prime) for q in range(int(at.max(initial=0)) // SPAN + 1)], np.uint64)
    return far[at // SPAN] * table[at % SPAN] % np.uint64(prime)


class Words:
    """The words of some bytes, with one space between them, and fingerprints of their runs."""

    def __init__(self, data: np.ndarray, old: int = 0) -> None:
        """``old`` words at the begin were in the slice before: no run that ends in them counts."""
        kind = KIND[data]
        blank = kind != 0
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(data) and not blank[0]:
            edge = np.append(0, edge)
        if len(edge) % 2:
            edge = np.append(edge, len(data))
        self.begin, end = edge[::2], edge[1::2]
        self.old, self.size = old, end - self.begin
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.begin]
        self.at = np.cumsum(self.size + 1) - self.size - 1
        kept = np.append(~blank, False)
        kept[end] = True  # the byte behind a word is its space
        self.text = LOWER[np.append(data, np.uint8(32))[kept]]
        self.text[self.at + self.size] = 32
        self.prefix = [(prefixes(self.text, self.at, i), prefixes(self.text, self.at + self.size, i), _shifts(self.at, i)) for i in range(2)]

    def __len__(self) -> int:
        return len(self.size)

    def runs(self, n: int) -> np.ndarray:
        """Whether ``n`` words from each word on are a phrase."""
        count = max(0, len(self) - n + 1)
        return self.piece[:count] == self.piece[n - 1 :]

    def prints(self, n: int, language: np.ndarray, bits: int) -> np.ndarray:
        """Fingerprints of the ``n`` words from each word on; ``language`` has a number for each word."""
        count = max(0, len(self) - n + 1)
        both = []
        for (first, last, shift), p in zip(self.prefix, PRIMES, strict=True):
            prime = np.uint64(p)
            both.append((last[n - 1 :] + prime - first[:count]) % prime * shift[:count] % prime)
        return mix((both[0] << np.uint64(31) | both[1]) + language[:count]) & np.uint64((1 << 64) - (1 << (64 - bits)))

    def phrase(self, i: int, n: int) -> bytes:
        return self.text[self.at[i] : self.at[i + n - 1] + self.size[i + n - 1]].tobytes()

    def same(self) -> np.ndarray:
        """A number for each word, equal for equal words only: that of one of its occurrences, by comparison of the bytes."""
        plain = self.prints(1, np.zeros(len(self), np.uint64), 64)
        _, pointer, group = np.unique(plain, return_index=True, return_inverse=True)
        pointer = pointer[group]
        if (self.size[pointer] == self.size).all():
            kind = np.int32 if len(self.text) < 1 << 31 else np.int64
            there = np.arange(len(self.text), dtype=kind)
            there += np.repeat((self.at[pointer] - self.at).astype(kind), self.size + 1)
            if (self.text[there] == self.text).all():
                return pointer
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(self.phrase(i, 1), i) for i in range(len(self))])


def slices(data: np.ndarray, words: int, span: int) -> Iterator[tuple[Words, int, int]]:
    """Words of ``data``, some ``span`` bytes at a time; the byte where each begins, and the number of words before.

    A slice ends between words and takes up the last ``words - 1`` of the one before.
    """
    begin = end = old = before = 0
    while end < len(data):
        end = min(end + span, len(data))
        while end < len(data) and KIND[data[end]] == 0:  # on to the end of a word
            rest = np.flatnonzero(KIND[data[end : end + span]])
            end = end + int(rest[0]) if len(rest) else min(end + span, len(data))
        made = Words(data[begin:end], old)
        yield made, begin, before
        old = min(words - 1, len(made))
        before += len(made) - old
        begin = begin + int(made.begin[-old]) if old else end


class Texts:
    """Texts laid end to end, in the order of their keys."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(batches)
        table = table.take(pa.compute.sort_indices(table, [("key", "ascending")], null_placement="at_end"))
        self.keys, names = table["key"], table["language"].to_pylist()
        texts = table["text"].to_pylist()
        sizes = np.array([len(x) + 1 for x in texts], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.data = np.frombuffer(b"\n".join(texts), np.uint8)
        self.names = sorted(set(names))
        number = {x: i for i, x in enumerate(self.names)}
        self.language = np.array([number[x] for x in names], np.int64)
        self.salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.names], np.uint64)

    def slices(self, words: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
        """Words, the text each is in, and its language."""
        for made, begin, _ in slices(self.data, words, SCAN_BYTES):
            text = np.searchsorted(self.begin, made.begin + begin, side="right") - 1
            yield made, text, self.language[text]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Texts]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SCAN_BYTES:
            yield Texts(held)
            held, size = [], 0
    if size:
        yield Texts(held)


def marked(bitmap: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which fingerprints have their bit set: that of their leading bits."""
    place = prints >> np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)
    return bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0


def _summed(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
    return prints[first], np.add.reduceat(counts, first)


def _counted(levels: tuple[int, ...], bitmap: object, buckets: int, bits: int, least: int) -> Callable:
    """Packed numbers of the fingerprints of ``levels`` in some texts, by their leading ``buckets`` bits.

    Of the other bits 24 are kept, as three planes of bytes, and numbers only up to
    ``least``: that is enough to tell which may be frequent, and packs tightly.
    """
    count = np.uint8 if least < 256 else np.uint32

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        prints = np.concatenate(held) >> np.uint64(40 - buckets)
        prints, counts = _summed(prints, np.ones(len(prints), np.int64))
        bucket = (prints >> np.uint64(24)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        spans = list(zip(first.tolist(), [*first[1:].tolist(), len(prints)], strict=True))
        planes, counts = prints.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:], np.minimum(counts, least).astype(count)
        packs = [planes[a:b].T.tobytes() for a, b in spans], [counts[a:b].tobytes() for a, b in spans]
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), *(pa.array(x, pa.binary()) for x in packs)], names=["bucket", "prints", "counts"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for texts in _texts(batches):
            for words, _, language in texts.slices(max(levels[0], 2)):
                salt = texts.salt[language]
                for n in levels:
                    keep = words.runs(n)
                    if n == 1:
                        keep = _beside(marked(bitmap.value, words.prints(2, salt, bits)) & words.runs(2), len(words))
                    elif bitmap is not None:
                        below = marked(bitmap.value, words.prints(n - 1, salt, bits))
                        keep &= below[:-1][: len(keep)] & below[1:][: len(keep)]
                    keep[: max(0, words.old - n + 1)] = False
                    held.append(words.prints(n, salt, bits)[keep])
                    size += len(held[-1])
                if size >= PACK:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    return scan


def _beside(pairs: np.ndarray, n: int) -> np.ndarray:
    """Words that stand in one of the marked ``pairs``; the last, whose right side another slice has, counts too."""
    keep = np.zeros(n, bool)
    keep[:-1] |= pairs
    keep[1:] |= pairs
    keep[-1:] = True
    return keep


def _frequent(least: int, buckets: int, size: int) -> Callable:
    """Of each bucket, whose rows come together, its slice of the bitmap."""
    count = np.uint8 if least < 256 else np.uint32

    def marks(bucket: int, prints: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        prints, counts = _summed(prints, counts)
        place = prints[counts >= least] >> np.uint32(24 - size + buckets)
        bits = np.zeros(1 << (size - buckets), np.uint8)
        bits[place] = 1
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bucket", "marks"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prints, counts, size = None, [], [], 0
        for batch in batches:
            for bucket, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != now and now is not None:
                    yield marks(now, np.concatenate(prints), np.concatenate(counts))
                    prints, counts, size = [], [], 0
                now = bucket
                high, middle, low = np.frombuffer(a, np.uint8).reshape(3, -1).astype(np.uint32)
                prints.append(high << 16 | middle << 8 | low)
                counts.append(np.frombuffer(b, count).astype(np.int64))
                size += len(prints[-1])
                if size > 4 * BUCKET:  # what is held is as large as the bucket has different fingerprints
                    one = _summed(np.concatenate(prints), np.concatenate(counts))
                    prints, counts = [one[0]], [one[1]]
                    size = len(one[0])
        if now is not None:
            yield marks(now, np.concatenate(prints), np.concatenate(counts))

    return summed


def _pointers(words: Words, n: int, at: np.ndarray, prints: np.ndarray, language: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the phrases of ``n`` words at ``at``: a pointer to each different one's first occurrence, and how often it occurs."""
    _, first, group = np.unique(prints[at], return_index=True, return_inverse=True)
    pointer = at[first][group]
    equal = language[pointer] == language[at]
    for k in range(n):
        equal &= same[pointer + k] == same[at + k]
    if not equal.all():  # phrases collide: they are told apart by their words
        columns = np.stack([language[at], *(same[at + k] for k in range(n))], 1)
        _, first, group = np.unique(columns, axis=0, return_index=True, return_inverse=True)
        group = group.ravel()
    return at[first], np.bincount(group, minlength=len(first))


def _merged(tables: list[pa.Table]) -> pa.Table:
    """Sums and least keys by bucket, language and phrase."""
    one = pa.concat_tables(tables).group_by(["bucket", "lang", "phrase"], use_threads=False).aggregate([("n", "sum"), ("doc", "min")])
    return pa.table({"bucket": one["bucket"], "lang": one["lang"], "phrase": one["phrase"], "n": one["n_sum"], "doc": one["doc_min"]})


def _materialised(longest: int, bitmap: object, buckets: int, bits: int) -> Callable:
    """Phrases that the bitmap lets through, with numbers; and for each language the number of words. Packed by bucket, in order."""

    def found_in(words: Words, text: np.ndarray, language: np.ndarray, texts: Texts) -> pa.Table:
        salt, same = texts.salt[language], words.same()
        total = np.bincount(language[words.old :], minlength=len(texts.names))
        some = np.flatnonzero(total)
        names, found, count, doc, bucket = [some], [b""] * len(some), [total[some]], [np.full(len(some), -1)], [np.zeros(len(some), np.int64)]
        for n in range(1, longest + 1):
            prints, keep = words.prints(n, salt, bits), words.runs(n)
            keep[: max(0, words.old - n + 1)] = False
            at = np.flatnonzero(keep)
            at = at[marked(bitmap.value, prints[at])]
            pointer, many = _pointers(words, n, at, prints, language, same)
            names.append(language[pointer])
            found += [words.phrase(i, n) for i in pointer.tolist()]
            count.append(many)
            doc.append(text[pointer])
            bucket.append((prints[pointer] >> np.uint64(64 - buckets)).astype(np.int64))
        doc = np.concatenate(doc)
        keys = texts.keys.take(pa.array(doc, mask=doc < 0))
        lang = pa.array(texts.names, pa.string()).take(pa.array(np.concatenate(names)))
        return pa.table({"bucket": np.concatenate(bucket), "lang": lang, "phrase": pa.array(found, pa.binary()), "n": np.concatenate(count).astype(np.int64), "doc": keys})

    def packed(table: pa.Table) -> pa.RecordBatch:
        table = table.sort_by([("bucket", "ascending"), ("lang", "ascending"), ("phrase", "ascending")]).combine_chunks()
        bucket = table["bucket"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        head = pa.table({"lang": table["lang"].dictionary_encode(), "size": pa.compute.binary_length(table["phrase"]), "n": table["n"], "doc": table["doc"]})
        heads, bodies = [], []
        for start, end in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, head.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec(CODEC, LEVEL))) as writer:
                writer.write_table(head.slice(start, end - start))
            heads.append(out.getvalue().to_pybytes())
            bodies.append(pa.Codec(CODEC, LEVEL).compress(b"".join(table["phrase"].slice(start, end - start).to_pylist()), asbytes=True))
        packs = [pa.array(x, pa.binary()) for x in (heads, bodies)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), *packs], names=["bucket", "head", "body"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for texts in _texts(batches):
            for words, text, language in texts.slices(longest):
                held.append(found_in(words, text, language, texts))
                size += len(held[-1])
                if size > HELD:
                    held = [_merged(held)]
                    size = len(held[0])
                    if size > HELD // 2:
                        yield packed(held[0])
                        held, size = [], 0
        if size:
            yield packed(_merged(held))

    return scan


def _unpacked(head: pa.Scalar, body: pa.Scalar) -> pa.Table:
    one = pa.ipc.open_stream(head.as_buffer()).read_all()
    ends = np.cumsum(one["size"].to_numpy(), dtype=np.int64)
    data = pa.Codec(CODEC).decompress(body.as_buffer(), int(ends[-1]))
    phrase = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), data])
    return pa.table({"lang": one["lang"].cast(pa.string()), "phrase": phrase, "n": one["n"], "doc": one["doc"]})


def _totals(least: int) -> Callable:
    """Sums of each bucket, whose rows come together: phrases of ``least`` or more, and the numbers of words."""

    def frequent(tables: list[pa.Table]) -> pa.RecordBatch:
        one = _merged(tables)
        one = one.filter((pa.compute.field("n") >= least) | (pa.compute.binary_length(pa.compute.field("phrase")) == 0))
        return one.select(["lang", "phrase", "n", "doc"]).combine_chunks().to_batches()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in batches:
            for bucket, head, body in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if bucket != now and held:
                    yield from frequent(held)
                    held, size = [], 0
                now = bucket
                one = _unpacked(head, body)
                held.append(one.append_column("bucket", pa.array(np.full(len(one), bucket))))
                size += len(one)
                if size > HELD:
                    held = [_merged(held)]
                    size = len(held[0]) // 2
        if held:
            yield from frequent(held)

    return summed


def frequent_phrases(docs: DataFrame, key: str, text: str, language: str, longest: int = 3, least: int = 10, bits: int = 64) -> DataFrame:
    """``lang, phrase, n, doc``: phrases of two to ``longest`` words that occur ``least`` times and the words in them, and the least key of the documents they occur in.

    An empty phrase has a language's number of all words. ``bits`` is the length of
    fingerprints, which only tests need to shorten.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{language}`"), F.lit("und")).alias("language"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    known = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    size = int(np.clip(int(known // 4).bit_length(), *BITS))
    parts = tasks(docs)
    buckets = min(size - 3, int(max(4 * parts, known // 3 // BUCKET)).bit_length())
    bitmap, sent = np.zeros(1 << (size - 3), np.uint8), None
    for levels in [(2,), (3, 1), *((n,) for n in range(4, longest + 1))] if longest > 2 else [(2,), (1,)]:
        packs = rows.mapInArrow(_counted(levels, sent, buckets, bits, least), "bucket long, prints binary, counts binary")
        packs = packs.repartition(parts, "bucket").sortWithinPartitions("bucket")
        for r in packs.mapInArrow(_frequent(least, buckets, size), "bucket long, marks binary").toLocalIterator():  # bits, at most 2 ** BITS[1]
            at = r["bucket"] << (size - buckets - 3)
            marks = np.frombuffer(r["marks"], np.uint8)
            bitmap[at : at + len(marks)] |= marks
        sent = spark.sparkContext.broadcast(bitmap.copy())
    kind = docs.schema[key].dataType.simpleString()
    deal = (4 * parts).bit_length()
    packs = rows.mapInArrow(_materialised(longest, sent, deal, bits), "bucket long, head binary, body binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return packs.mapInArrow(_totals(least), f"lang string, phrase binary, n long, doc {kind}").withColumn("phrase", F.col("phrase").cast("string"))


def _first(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each language with their ``rank``; parts of a language are ranked first."""
    for parts in PARTS:
        window = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).drop("rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def _score(scale: int, left: str, right: str) -> Column:
    """``floor(scale * a^2 / (left * right))`` in whole numbers of up to 38 digits."""
    return F.expr(f"CAST((CAST({scale} AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0))) div (CAST({left} AS DECIMAL(38,0)) * CAST({right} AS DECIMAL(38,0))) AS BIGINT)")


def collocations(docs: DataFrame, key: str, text: str, language: str, longest: int = 3, least: int = 10, k: int = 2000, percent: int = 50, scale: int = 1_000_000, bits: int = 64) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score, doc``: the ``k`` best phrases of two words or more of each language.

    A phrase's score is that of its weakest cut, ``floor(scale * a^2 / (l * r))``, in
    whole numbers of up to 38 digits. A phrase drops out where a longer one that
    holds it occurs at least ``percent`` of its times; it is enough to look at
    phrases of one word more, which occur as often as any longer one.
    """
    found = cut(frequent_phrases(docs, key, text, language, longest, least, bits))
    total = small(found.where("phrase = ''").select("lang", F.col("n").alias("total")))
    counted = found.select("lang", "phrase", F.col("n").alias("a"), (F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1).alias("words"))
    known = {n: counted.where(f"words = {n} AND phrase <> ''").select("lang", "phrase", "a") for n in range(1, longest + 1)}
    few = known[1].count() <= SMALL_ROWS
    part = lambda side, n: F.substring_index("phrase", " ", n if side == 1 else -n)
    scored = []
    for n in range(2, longest + 1):
        rows = known[n]
        if n < longest:
            longer = [known[n + 1].select("lang", part(side, n).alias("phrase"), F.lit(None).cast("long").alias("a"), F.col("a").alias("longer")) for side in (1, 2)]
            rows = rows.withColumn("longer", F.lit(None).cast("long")).unionByName(longer[0]).unionByName(longer[1])
            rows = rows.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
            rows = rows.where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")
        for j in range(1, n):  # the parts of a frequent phrase are as frequent, so each is found
            for side, name, m in ((1, "l", j), (2, "r", n - j)):
                side_ = known[m].select("lang", F.col("phrase").alias("part"), F.col("a").alias(f"{name}{j}"))
                rows = rows.withColumn("part", part(side, m)).join(F.broadcast(side_) if m == 1 and few else side_, ["lang", "part"]).drop("part")
        cuts = [F.struct(_score(scale, f"l{j}", f"r{j}").alias("score"), F.lit(j).alias("j"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")) for j in range(1, n)]
        rows = rows.withColumn("cut", F.array_min(F.array(*cuts)))
        scored.append(rows.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    scored = reduce(DataFrame.unionByName, scored)
    best = cut(_first(scored, k, [F.desc("score"), F.desc("a"), F.asc("phrase")]))
    docs_ = found.select("lang", "phrase", "doc").join(small(best), ["lang", "phrase"])
    return docs_.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score", "doc")
