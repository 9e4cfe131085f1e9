"""Files of many kinds as documents: one row per file or archive member."""

from __future__ import annotations

import html
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, member string, kind string, text string, error string"
ENCODINGS = ("utf-8-sig", "utf-16", "cp1252")
#: Bytes that one archive member may unfold to, and how deep archives may nest.
MEMBER_BYTES, DEPTH = 64 << 20, 3


def decode(data: bytes) -> str:
    for encoding in ENCODINGS:
        if encoding == "utf-16" and data[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def strip_html(text: str) -> str:
    text = re.sub(r"(?is)<(script|style|nav|noscript)\b.*?</\1\s*>|<!--.*?-->", " ", text)
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"(?s)<[^>]*>", " ", text))).strip()


def strip_rtf(text: str) -> str:
    text = re.sub(r"(?s)\{\\(?:fonttbl|colortbl|stylesheet|info|pict)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\par[d]?\b ?|\\line\b ?", "\n", text)
    return re.sub(r"\\[a-z]+-?\d* ?|[{}]|\\\*", "", text).strip()


def xml_paragraphs(data: bytes, ends: tuple[str, ...], texts: tuple[str, ...] | None) -> str:
    """Text of an XML document, a line per paragraph element."""
    lines = []
    for node in ElementTree.fromstring(data).iter():
        if node.tag.rpartition("}")[2] in ends:
            parts = [n.text or "" for n in node.iter() if n.tag.rpartition("}")[2] in texts] if texts else list(node.itertext())
            lines.append("".join(parts))
    return "\n".join(x for x in lines if x.strip())


def zipped(data: bytes) -> Iterator[tuple[str, bytes | None]]:
    """Members with their bytes, or None if they are too large."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in sorted(z.infolist(), key=lambda i: i.filename):
            if not info.is_dir():
                yield info.filename, z.read(info) if info.file_size <= MEMBER_BYTES else None


def tarred(data: bytes) -> Iterator[tuple[str, bytes | None]]:
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for info in t:
            if info.isfile():
                yield info.name, t.extractfile(info).read() if info.size <= MEMBER_BYTES else None


def texts(name: str, data: bytes | None, depth: int = 0) -> Iterator[tuple[str, str, str | None, str | None]]:
    """``(member, kind, text, error)`` of a file; an archive gives its members'."""
    lower = name.lower()
    kind = "tar" if lower.endswith((".tar", ".tar.gz", ".tgz")) else lower.rpartition(".")[2]
    try:
        if data is None:
            yield name, kind, None, f"over {MEMBER_BYTES} bytes"
        elif kind in ("zip", "tar"):
            if depth >= DEPTH:
                yield name, kind, None, "archives nest too deeply"
                return
            for member, body in zipped(data) if kind == "zip" else tarred(data):
                for inner, k, text, error in texts(member, body, depth + 1):
                    yield (f"{name}/{inner}" if depth else inner), k, text, error
        elif kind in ("txt", "md", "csv", "log"):
            yield name, kind, decode(data), None
        elif kind in ("html", "htm"):
            yield name, "html", strip_html(decode(data)), None
        elif kind == "rtf":
            yield name, kind, strip_rtf(data.decode("latin-1")), None
        elif kind == "docx":
            yield name, kind, xml_paragraphs(dict(zipped(data))["word/document.xml"], ("p",), ("t",)), None
        elif kind == "odt":
            yield name, kind, xml_paragraphs(dict(zipped(data))["content.xml"], ("p", "h"), None), None
        elif kind == "epub":
            parts = [strip_html(decode(b)) for m, b in zipped(data) if m.lower().endswith((".xhtml", ".html", ".htm"))]
            yield name, kind, "\n".join(parts), None
        else:
            yield name, kind, None, "no parser for this kind"
    except Exception as e:  # a broken file is a row with its error, not a failed job
        yield name, kind, None, f"{type(e).__name__}: {e}"[:200]


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Rows of all files under ``path``; what can't be read keeps a row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(path, *row) for row in texts(path.rpartition("/")[2], bytes(content))]
                yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(parse, SCHEMA)
