"""Files, exports, segments, chunks and streams."""

import io
import tarfile
import zipfile
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from pairloom.operators import chunking, segments
from pairloom.plans import flows
from pairloom.sources import exports, files
from pairloom.streaming import jobs


def zip_of(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def test_read_files(spark, tmp_path):
    docx = zip_of({"word/document.xml": '<w:document xmlns:w="u"><w:body><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t> you</w:t></w:r></w:p></w:body></w:document>'})
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("in.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"tar"))
    for name, body in {"a.txt": "café".encode("cp1252"), "b.html": b"<p>x &amp; y</p>", "c.docx": docx, "d.zip": zip_of({"m.md": b"# T", "n.docx": docx}), "e.tgz": tar.getvalue(), "f.docx": b"broken", "g.bin": b"?"}.items():
        (tmp_path / name).write_bytes(body)
    got = {(r.path.rpartition("/")[2], r.member): (r.text, r.error is None) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt", "a.txt"] == ("café", True)
    assert got["b.html", "b.html"] == ("x & y", True)
    assert got["c.docx", "c.docx"] == ("Hello you", True)
    assert got["d.zip", "n.docx"] == ("Hello you", True) and got["d.zip", "m.md"] == ("# T", True)
    assert got["e.tgz", "in.txt"] == ("tar", True)
    assert not got["f.docx", "f.docx"][1] and not got["g.bin", "g.bin"][1]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 2), ("ok", None)], "`A b` string, n int")
    exports.write(rows, str(tmp_path / "csv"), "csv")
    assert sorted(r.a_b for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()) == ["'=1+1", "ok"]
    exports.write(rows.toDF("a", "b"), str(tmp_path / "xml"), "xml")
    assert spark.read.format("xml").option("rowTag", "row").load(str(tmp_path / "xml")).count() == 2
    assert exports.plain_headers(["A b", "a-b", ""]) == ["a_b", "a_b_2", "column"]
    wide = exports.matrix(spark.createDataFrame([(1, 2, 0.5)], "doc_a long, doc_b long, sim double")).collect()
    assert [tuple(r) for r in wide] == [(1, 1.0, 0.5), (2, 0.5, 1.0)]


def test_segments(spark):
    ranges = spark.createDataFrame([("d", 0, 5), ("d", 5, 8), ("d", 10, 12), ("d", 3, 4)], "doc string, start long, end long")
    assert [tuple(r) for r in segments.union_length(ranges, ["doc"]).collect()] == [("d", 10, 2)]
    m = spark.createDataFrame([("d", 0, 5, 0, 5, 0.7), ("d", 5, 9, 5, 9, 0.9), ("d", 20, 25, 0, 5, 0.8)], "doc string, source_start long, source_end long, target_start long, target_end long, score double")
    assert sorted((r.source_start, r.source_end, r.score, r.matches) for r in segments.consolidate(m, ["doc"]).collect()) == [(0, 9, 0.9, 2), (20, 25, 0.8, 1)]


def test_chunks_cover_the_text(spark):
    body = "# One\n" + "A sentence here. " * 80 + "\n# Two\n" + "word " * 10
    docs = spark.createDataFrame([(1, body), (2, ""), (3, None)], "doc_id long, text string")
    got = chunking.chunk_documents(docs, size=200, overlap=20).orderBy("char_start").collect()
    assert {r.doc_id for r in got} == {1} and {r.section for r in got} == {"One", "Two"}
    seen = set()
    for r in got:
        assert body[r.char_start : r.char_end] == r.chunk
        seen |= set(range(r.char_start, r.char_end))
    assert seen == set(range(len(body)))


def test_stream_windows_equal_batch_and_drop_open_ones(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 0{i}:30:00", 1, "a", 1.0) for i in range(5)], "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.windowed_counts(jobs.read_events(spark, str(tmp_path / "in"), rows.schema, "*.parquet"))
    jobs.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_rescan_adds_only_new_pairs(spark, tmp_path):
    docs = spark.createDataFrame([("b", "a", 0.9), ("a", "b", 0.8)], "doc_a string, doc_b string, score double")
    for part in (1, 2):
        docs.write.parquet(str(tmp_path / "in" / str(part)))
        stream = spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        jobs.rescan(stream, lambda b: b.groupBy("doc_a", "doc_b").max("score").selectExpr("'a' AS doc_a", "'b' AS doc_b", "`max(score)` AS score").limit(1), str(tmp_path / "stored"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "stored")).count() == 1


def test_streams_read_a_table_of_many_files_in_any_order(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [(i, base + timedelta(minutes=5 * i), i % 3, "ab"[i % 2], 100.0 if i % 97 == 90 else float(i % 5)) for i in range(600)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    for place, part in enumerate(reversed(range(12))):  # later events first
        events.where(F.floor(F.col("event_id") / 50) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "many" / "events.parquet"))
    events.coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    for query in (flows.stream_windows, flows.stream_spikes):
        found = con.execute(flows.SQL[query.__name__])
        names = [c[0] for c in found.description]
        want = sorted(map(str, found.fetchall()))
        assert want
        for d in (tmp_path, tmp_path / "many"):
            assert sorted(str(tuple(r)) for r in query(spark, str(d)).select(*names).collect()) == want


def test_spikes_go_on_over_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", 1, 50.0 if i in (25, 45) else float(i % 4)) for i in range(50)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(2):
        events.where(F.floor(F.col("event_id") / 25) == part).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
        jobs.spikes(jobs.read_events(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "kept"), str(tmp_path / "cp"))
    assert {r.event_id for r in spark.read.parquet(str(tmp_path / "kept" / "out")).collect()} == {25, 45}


def test_large_members_are_errors(monkeypatch):
    monkeypatch.setattr(files, "MEMBER_BYTES", 10)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", "short")
        z.writestr("b.txt", "rather long text")
    assert list(files.texts("x.zip", packed.getvalue())) == [("a.txt", "txt", "short", None), ("b.txt", "txt", None, "over 10 bytes")]


def _sparse_zip(path, size):
    """A zip with a stored member of ``size`` bytes that the disk doesn't hold, ``x`` at its end, between two small ones."""
    import zipfile

    with open(path, "wb") as file, zipfile.ZipFile(file, "w") as archive:
        archive.writestr("first.txt", "one")
        info = zipfile.ZipInfo("large.bin")
        info.file_size = info.compress_size = size
        info.CRC = 0
        info.header_offset = file.tell()
        file.write(info.FileHeader())
        file.seek(size - 1, 1)
        file.write(b"x")
        archive.filelist.append(info)
        archive.NameToInfo[info.filename] = info
        archive.start_dir = file.tell()
        archive.writestr("last.txt", "two", zipfile.ZIP_DEFLATED)


def test_a_zip_of_three_gigabytes_is_ranges(tmp_path):
    from pairloom.sources.archives import ArchiveReader

    path, size = str(tmp_path / "large.zip"), 3 << 30
    _sparse_zip(path, size)
    reader = ArchiveReader({"path": path})
    parts = [p for p in reader.partitions() if p.member == "large.bin"]
    assert [p.begin for p in parts] == list(range(0, size, 64 << 20)) and parts[-1].end == size
    *_, last = reader.read(parts[-1])
    assert last[:3] == (path, "large.bin", size) and last[3] + len(last[4]) == size and last[4][-2:] == b"\0x"
    assert sorted(p.member for p in reader.partitions() if p.member != "large.bin") == ["first.txt", "last.txt"]


def test_archive_members_through_spark(spark, tmp_path):
    import gzip
    import io
    import tarfile
    import zipfile

    from pairloom.sources.archives import archive_members

    _sparse_zip(str(tmp_path / "a.zip"), 70 << 20)
    body = bytes(range(256)) * 700
    for name in ("b.tar", "c.tar.gz"):
        with tarfile.open(tmp_path / name, "w:gz" if name.endswith("gz") else "w") as tar:
            for member, data in (("d/e.bin", body), ("empty", b"")):
                info = tarfile.TarInfo(member)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    (tmp_path / "broken.zip").write_bytes(b"PK\3\4 not an archive")
    whole = (tmp_path / "c.tar.gz").read_bytes()
    (tmp_path / "short.tar.gz").write_bytes(gzip.compress(gzip.decompress(whole)[:90_000]))
    with zipfile.ZipFile(tmp_path / "packed.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("p.bin", body)
    rows = archive_members(spark, str(tmp_path / "*"), range_bytes=50_000, chunk_bytes=20_000).where("member <> 'large.bin' OR member IS NULL").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.path, r.member or "", r.offset or 0)):
        if r.error is None:
            key = r.path.rpartition("/")[2], r.member
            assert len(r.content) <= 20_000 and r.offset == len(got.get(key, b""))
            got[key] = got.get(key, b"") + bytes(r.content)
    assert {k: v for k, v in got.items() if k[0] != "short.tar.gz"} == {
        ("a.zip", "first.txt"): b"one", ("a.zip", "last.txt"): b"two", ("b.tar", "d/e.bin"): body, ("b.tar", "empty"): b"",
        ("c.tar.gz", "d/e.bin"): body, ("c.tar.gz", "empty"): b"", ("packed.zip", "p.bin"): body,
    }
    assert {r.path.rpartition("/")[2] for r in rows if r.error} == {"broken.zip", "short.tar.gz"}
    large = archive_members(spark, str(tmp_path / "a.zip"), range_bytes=16 << 20).where("member = 'large.bin'")
    assert large.rdd.getNumPartitions() >= 5 and large.selectExpr("sum(octet_length(content))").first()[0] == 70 << 20
