"""WARC archives compressed record by record with a Zstandard dictionary they carry themselves."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Stages, spread

#: Fixed values of the file formats.
DICTIONARY_MAGIC = 0x184D2A5D  # the skippable frame that holds the dictionary
FILLER_MAGIC = 0x184D2A50
FRAME_MAGIC = 0xFD2FB528

#: The writer ends each row, a chunk of frames, with a line feed; this opens a skippable frame of one byte, which is that line feed.
FILLER = struct.pack("<II", FILLER_MAGIC, 1)

INFO = b"WARC/1.1\r\nWARC-Type: warcinfo\r\n"


def record(page_id: int | None, url: bytes | str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit holds no payload, only its digest, length and what it refers to."""
    url = url.encode() if isinstance(url, str) else url or b""
    at = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url) or b"urn:none"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(),
        b"WARC-Target-URI: " + at,
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(body),
    ]
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%s>" % str(refers_to).encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, body = data.split(b"\r\n\r\n", 1)
    lines = head.split(b"\r\n")
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    at = dict(x.split(b": ", 1) for x in lines[1:])
    body = body[: int(at[b"Content-Length"])]
    http, payload = body.split(b"\r\n\r\n", 1)
    number = lambda x: None if x is None or x == b"None" else int(x)
    page = lambda x: number(x[len(b"<urn:page:") : -1]) if x else None
    revisit = at[b"WARC-Type"] == b"revisit"
    digest = at[b"WARC-Payload-Digest"].split(b":")[1].decode()
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record of page {page(at[b'WARC-Record-ID'])} is damaged")
    return {"page_id": page(at[b"WARC-Record-ID"]), "url": at[b"WARC-Target-URI"].decode("utf-8", "replace"), "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest, "record_type": "revisit" if revisit else "response", "refers_to": page(at.get(b"WARC-Refers-To"))}


def warcinfo() -> bytes:
    """The record that tells what an archive is."""
    body = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
    head = [b"WARC/1.1", b"WARC-Type: warcinfo", b"WARC-Record-ID: <urn:archive:info>", b"WARC-Date: 1970-01-01T00:00:00Z", b"Content-Type: application/warc-fields", b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int) -> bytes:
    """Trained on the records given; where they are too few or too small for that, their bytes as they are."""
    whole = b"".join(records)
    try:
        return zstandard.train_dictionary(max(256, min(size, len(whole) // 8)), records, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return whole[:size]


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard or skippable frame that begins at ``at`` ends, from its headers alone."""
    magic = struct.unpack_from("<I", data, at)[0]
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        return at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if magic != FRAME_MAGIC:
        raise ValueError(f"no frame at byte {at}")
    d = data[at + 4]
    single = d >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[d & 3] + ((1 if single else 0), 2, 4, 8)[d >> 6]
    last = 0
    while not last:
        block = int.from_bytes(data[at : at + 3], "little")
        last = block & 1
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
    return at + 4 * (d >> 2 & 1)


def read_archive(data) -> Iterator[bytes]:
    """The records of an archive, in order."""
    view, at, one = memoryview(data), 0, None
    while at < len(view):
        end = frame_end(view, at)
        magic = struct.unpack_from("<I", view, at)[0]
        if magic == DICTIONARY_MAGIC:
            if at:
                raise ValueError("the dictionary must come first")
            one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[8:end])))
        elif magic == FRAME_MAGIC:
            one = one or zstandard.ZstdDecompressor()
            yield one.decompress(view[at:end])
        at = end


def sample_records(pages: DataFrame, records: int = 512, slice_bytes: int = 16 << 10) -> list[bytes]:
    """Records of up to ``records`` different payloads, drawn by a seeded hash from all of them, and of longer ones ``slice_bytes`` at a place drawn likewise."""
    draw = F.xxhash64("digest", F.lit(19))
    drawn = pages.select("digest", draw.alias("draw")).distinct().orderBy("draw", "digest").limit(records)
    at = F.pmod(F.xxhash64("digest", F.lit(23)), F.greatest(F.length("payload") - slice_bytes, F.lit(0)) + 1).cast("int") + 1
    # as many rows as records
    kept = pages.join(F.broadcast(drawn.select("digest")), "digest").select("digest", "page_id", "url", F.substring("payload", at, F.lit(slice_bytes)).alias("part"))
    rows = kept.groupBy("digest").agg(F.min(F.struct("page_id", "url", "part")).alias("r")).orderBy("digest").collect()
    return [record(r["r"]["page_id"], r["r"]["url"], bytes(r["r"]["part"]), r["digest"], None, False) for r in rows]


def write_archives(pages: DataFrame, path: str, dict_bytes: int = 64 << 10, level: int = 3, chunk_bytes: int = 4 << 20, chunks: int = 64) -> None:
    """Write pages (page_id, url, payload, digest, refers_to, revisit) as archives of up to ``chunks`` chunks of records, of about ``chunk_bytes`` each or one larger record.

    Each archive begins with a skippable frame that holds the dictionary, trained on a sample of all records
    (``sample_records``, a bound on memory; every record is written whatever the sample holds); then follows a warcinfo record and a frame for each
    record. Spark's text writer puts the bytes down, a row a chunk, so that any store it knows will do, and a task
    that is run again replaces its archives, which are then named ``.warc.zst``.
    """
    import pyarrow as pa

    spark = pages.sparkSession
    trained = dictionary(sample_records(pages), dict_bytes)

    def archive(batches):
        one = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained + one.compress(warcinfo())
        waiting, held, written = [], 0, 0

        def chunk():
            nonlocal waiting, held, written
            data = b"".join(([] if written % chunks else [lead]) + waiting) + FILLER
            waiting, held, written = [], 0, written + 1
            return pa.RecordBatch.from_pydict({"frames": pa.array([data], pa.binary())})

        for batch in batches:
            for row in batch.to_pylist():
                data = one.compress(record(row["page_id"], row["url"], row["payload"] or b"", row["digest"], row["refers_to"], row["revisit"]))
                if waiting and held + len(data) > chunk_bytes:
                    yield chunk()
                waiting.append(data)
                held += len(data)
        if waiting:
            yield chunk()

    frames = pages.select("page_id", "url", "payload", "digest", "refers_to", "revisit").mapInArrow(archive, "frames binary")
    # the writer begins a new file after so many rows, where the next lead is
    frames.select(F.col("frames").cast("string").alias("value")).write.option("compression", "none").option("maxRecordsPerFile", chunks).text(path)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.endswith(".txt") and not fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.zst")):
            raise OSError(f"could not rename {name}")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, url, payload (null in revisits), payload_bytes, payload_digest, record_type, refers_to.

    Lengths and digests of responses are verified while reading.
    """
    import pyarrow as pa

    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def records(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                held = 0
                for x in read_archive(data.as_buffer()):
                    if x.startswith(INFO):
                        continue
                    rows.append(parse_record(x))
                    held += len(x)
                    if held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    return files.mapInArrow(records, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, path: str | None = None, least_bytes: int = 100) -> DataFrame:
    """Archive every page under ``path`` and read the archives back.

    Of pages with equal payloads (SHA-256 of the UTF-8 html; null html is empty) of
    ``least_bytes`` or more, that with the smallest page_id is a response and the
    others are revisits of it; shorter ones are all responses. Repeated rows of that
    smallest id are responses too; a null id is never the smallest unless all are null.
    An empty table gives no archives and an empty result; further columns are ignored.
    """
    spark = pages.sparkSession
    stages = Stages(spark, "warc")
    path = path or stages.path("archives")
    rows = pages.select("page_id", F.col("url").cast("binary").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    firsts = stages.keep(firsts, "firsts")  # written first: where it is small the html need not be shuffled
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    typed = rows.join(firsts, "digest", "left").withColumn("revisit", other).withColumn("refers_to", F.when(other, F.col("first")))
    write_archives(typed, path)
    stages.drop(firsts)
    return read_archives(spark, path)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
