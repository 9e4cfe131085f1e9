"""WARC archives: writing pages, and a salvage reader.

Each page becomes one record in a gzip member of its own; runs of members go to
files through Spark's text writer, whose line separator is an empty gzip member.
Files are bounded by the bytes of their records; a very large page has a file of
its own. Of
records with equal payloads that with the largest key is a ``response``, the
others are ``revisit`` records that refer to it.

The reader takes archive files of gzip members, of plain records, or both mixed.
When a check fails (gzip's checksum, the version line, a header, the length, the
end of the record, the payload's digest), it searches for the next valid member
or version line, goes on from there and logs the bytes between as a gap. Complete
records at the start of a broken member are kept.

A null payload is empty. A null key is written as empty and read as null, and its
record is a response. Repeated rows of a payload's largest key are all responses.
Line breaks in URLs are written as ``%0D`` and ``%0A``. An empty table gives an
archive without records. An archive file is read as one row, so it must be below
2 GB, as Spark's binary values are.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.runtime import cut

VERSION = b"WARC/1.1"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Bytes of a run of records, runs of a file, and bytes from which a page has a file of its own.
RUN_BYTES, FILE_RUNS, LARGE_BYTES = 1 << 20, 48, 4 << 20
#: Bytes of records that the reader passes on at a time.
BATCH_BYTES = 8 << 20
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
#: Bytes that one gzip member may unfold to: no larger value fits Spark.
MEMBER_BYTES = (1 << 31) - 1


def member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column, without Python."""
    text = F.upper(F.sha1(payload))
    four = [F.lpad(F.conv(F.substring(text, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*four)), DIGITS, BASE32)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, key: str, url: str | None, payload: bytes, sha: str, refers_to: str | None, date: str) -> bytes:
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{URN}{key}>",
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{sha}",
        "WARC-X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http;msgtype=response",
    }
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    block = HTTP % len(payload)
    if kind == "revisit":
        head |= {"WARC-Refers-To": f"<{URN}{refers_to}>", "WARC-Profile": PROFILE}
    else:
        block += payload
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, key: str, url: str, payload: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes one record per row of ``pages`` to archive files in ``folder``."""
    body = F.encode(F.coalesce(F.col(f"`{payload}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), body.alias("body"))
    rows = rows.withColumn("sha", sha1_base32(F.col("body")))
    copies = cut(rows.select("key", "sha", F.octet_length("body").alias("size")).groupBy("sha").agg(F.max("key").alias("last"), F.count("*").alias("n"), F.max("size").alias("size")))
    told = rows.join(copies.where("n > 1").select("sha", "last"), "sha", "left")
    revisit = F.col("last").isNotNull() & F.col("key").isNotNull() & (F.col("key") != F.col("last"))
    texts = [F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("key", "last")]
    told = told.select(revisit.alias("revisit"), "url", "body", "sha", *texts)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for r, u, b, s, k, x in batch.itertuples(index=False):
                made = record("revisit" if r else "response", k, u, b, s, x, date)
                held.append(member(made))
                size += len(made)
                if size >= RUN_BYTES:
                    yield pd.DataFrame({"value": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"value": [b"".join(held)]})

    def save(some: DataFrame, most: int, mode: str) -> None:
        lines = some.mapInPandas(runs, "value binary").select(F.col("value").cast("string").alias("value"))
        lines.write.mode(mode).option("lineSep", member(b"").decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", most).text(folder)

    large = F.octet_length("body") >= LARGE_BYTES
    save(told.where(~large), FILE_RUNS, "error")
    if not copies.where(F.col("size") >= LARGE_BYTES).isEmpty():
        save(told.where(large), 1, "append")


class BrokenError(ValueError):
    """A failed check."""


def parse(data: bytes, at: int) -> tuple[tuple, int]:
    """The record at ``at`` of plain bytes, and where it ends."""
    line = START.match(data, at)
    if line is None or data[at : at + 4] != b"WARC":
        raise BrokenError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise BrokenError("header without end")
    head: dict[str, str] = {}
    for text in data[line.end() : end].split(b"\r\n"):
        name, colon, value = text.partition(b":")
        if not colon:
            raise BrokenError("header line without colon")
        head[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not head.get("content-length", "").isdigit():
        raise BrokenError("no length")
    begin, size = end + 4, int(head["content-length"])
    block = data[begin : begin + size]
    if len(block) < size or data[begin + size : begin + size + 4] != b"\r\n\r\n":
        raise BrokenError("record without end")
    payload = block
    if head.get("content-type", "").startswith("application/http"):
        _, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise BrokenError("no HTTP header")
    kind = head.get("warc-type", "")
    sha = head.get("warc-payload-digest", "").rpartition(":")[2] or None
    size_told = head.get("warc-x-payload-length", "")
    if kind != "revisit":
        own = digest(payload)
        if sha is not None and sha != own:
            raise BrokenError("payload digest")
        sha = own
    length = int(size_told) if kind == "revisit" and size_told.isdigit() else len(payload)
    name, refers = (head.get(h, "").strip("<>").removeprefix(URN) or None for h in ("warc-record-id", "warc-refers-to"))
    return (kind, name, head.get("warc-target-uri"), refers, sha, length, payload if kind != "revisit" else None), begin + size + 4


def unfold(data: bytes, at: int) -> tuple[bytes, int, str]:
    """Bytes of the gzip member at ``at``, where it ends, and what broke."""
    opener = zlib.decompressobj(31)
    out = []
    left = MEMBER_BYTES
    view = memoryview(data)
    step = 1 << 16
    place = at
    try:
        while not opener.eof and place < len(data):
            got = opener.decompress(view[place : place + step])
            place += step
            left -= len(got)
            if left < 0:
                return b"".join(out), at, "member too large"
            out.append(got)
    except zlib.error as e:
        return b"".join(out), at, f"gzip: {e}"[:80]
    if not opener.eof:
        return b"".join(out), at, "gzip: member without end"
    return b"".join(out), min(place, len(data)) - len(opener.unused_data), ""


def starts_well(data: bytes, at: int) -> bool:
    """Whether a version line, a valid member, or one that begins with a valid record stands at ``at``."""
    if data[at : at + 4] == b"WARC":
        return True
    body, _, broke = unfold(data, at)
    if not broke:
        return not body or body.startswith(b"WARC/")
    try:
        parse(body, 0)
    except BrokenError:
        return False
    return True


def salvage(data: bytes) -> Iterator[tuple]:
    """All records of an archive file that pass their checks, and the gaps.

    A record is its byte offset, None, None and its fields; a gap is where it begins and ends and why.
    """
    at, lost, why = 0, -1, ""
    while at < len(data):
        taken, end, broke = [], at, ""
        if data[at : at + 3] == b"\x1f\x8b\x08":
            body, end, broke = unfold(data, at)
            inner = 0
            while inner < len(body):
                try:
                    row, inner = parse(body, inner)
                    taken.append(row)
                except BrokenError as e:
                    broke = broke or str(e)
                    later = re.compile(rb"WARC/1\.[01]\r?\n").search(body, inner + 1)
                    if later is None:
                        break
                    inner = later.start()
        else:
            try:
                row, end = parse(data, at)
                taken.append(row)
            except BrokenError as e:
                broke = str(e)
        yield from ((at, None, None, *row) for row in taken)
        if broke and end <= at:  # the member or record can't be passed over: search
            if lost < 0:
                lost, why = at, broke
            follow = START.search(data, at + 1)
            while follow is not None and not starts_well(data, follow.start()):
                follow = START.search(data, follow.start() + 1)
            at = follow.start() if follow is not None else len(data)
            continue
        if lost >= 0:
            yield lost, at, why
            lost = -1
        if broke:
            yield at, end, broke
        at = end
    if lost >= 0:
        yield lost, len(data), why


READ = "file string, offset long, end long, gap string, record_type string, record_id string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all archive files of a folder, and gaps: rows whose ``gap`` says what failed."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    names = [x.split()[0] for x in READ.split(", ")]

    def frame(path: str, rows: list[tuple]) -> pd.DataFrame:
        full = [(path, *r, *[None] * (len(names) - 1 - len(r))) for r in rows]
        return pd.DataFrame(full, columns=names).astype({"end": "Int64", "payload_bytes": "Int64"})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                held, size = [], 0
                for row in salvage(bytes(content)):
                    held.append(row)
                    size += 200 + len(row[-1] or b"") if len(row) > 3 else 200
                    if size >= BATCH_BYTES:
                        yield frame(path, held)
                        held, size = [], 0
                if held:
                    yield frame(path, held)

    return files.mapInPandas(rows, READ)
