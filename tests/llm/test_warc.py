import hashlib

from pyspark.sql import functions as F

from tessera.llm import warc


def test_frames_are_found_from_their_headers():
    import zstandard

    for data in (b"", b"a" * 300_000, bytes(range(256)) * 900, b"x"):
        for kw in ({}, {"write_checksum": True}, {"write_content_size": False}):
            frame = zstandard.ZstdCompressor(**kw).compress(data)
            assert warc.frame_end(memoryview(frame + b"tail"), 0) == len(frame)


def test_round_trip_and_revisits(spark, tmp_path):
    long, url = "<p>" + "é" * 200, "http://a.b/ c\r\nX: y"
    rows = [(i, url, "<html>" + f"page {i} " * 40) for i in range(60)] + [(70, None, long), (61, url, long), (75, url, long), (61, url, long), (80, "u", None), (81, "u", ""), (82, "u", "short"), (83, "u", "short"), (None, "u", long)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").coalesce(1)
    got = warc.archive(pages, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    for i, _, html in rows:
        data = (html or "").encode()
        for r in by[i]:
            assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
            assert (bytes(r["payload"]) == data) if r["record_type"] == "response" else r["payload"] is None
    assert {r["record_type"] for r in by[61]} == {"response"} and len(by[61]) == 2
    assert [(by[i][0]["record_type"], by[i][0]["refers_to"]) for i in (70, 75, None, 82, 83, 80)] == [("revisit", 61)] * 3 + [("response", None)] * 3
    # a plain reader sees a leading skippable dictionary frame, then one frame a record
    files = [p for p in (tmp_path / "w").iterdir() if p.name.endswith(".warc.zst") and p.stat().st_size]
    data = files[0].read_bytes()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    assert sum(1 for _ in warc.read_archive(data)) == len(rows) + 1


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(pages, str(tmp_path / "w")).count() == 0


def test_many_archives_and_long_records(spark, tmp_path):
    rows = [(i, f"u{i}", f"<p>{i * i} " * (20_000 if i == 7 else 30)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("payload", F.col("html").cast("binary"))
    pages = pages.withColumn("digest", F.sha2("payload", 256)).withColumn("refers_to", F.lit(None).cast("long")).withColumn("revisit", F.lit(False))
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, chunk_bytes=100, chunks=4)
    files = [p.read_bytes() for p in (tmp_path / "w").iterdir() if p.name.endswith(".warc.zst") and p.stat().st_size]
    assert len(files) > 6 and all(int.from_bytes(x[:4], "little") == warc.DICTIONARY_MAGIC and next(warc.read_archive(x)).startswith(warc.INFO) for x in files)
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, path).collect()}
    assert got == {i: t for i, _, t in rows}


def test_dictionary_of_little_to_train_on(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", None)], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["payload_bytes"]) for r in warc.archive(pages, str(tmp_path / "w")).collect()) == [(1, 1), (2, 0)]
    files = [p.read_bytes() for p in (tmp_path / "w").iterdir() if p.name.endswith(".warc.zst") and p.stat().st_size]
    assert files and all(int.from_bytes(x[:4], "little") == warc.DICTIONARY_MAGIC for x in files)
