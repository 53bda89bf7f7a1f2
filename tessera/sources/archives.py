"""Zip archives of corpora: their members as rows, read on executors.

An archive is one cell of Spark's binary files, so at most 2 GB; members are unpacked one by one.
"""

from __future__ import annotations

import io
import re
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.corpus import semi_by_genre
from ..runtime import ship, written
from .records import cdl_lemmas, cdl_lines, walk_cdl

#: Text of a batch of members, about.
BATCH_BYTES = 16 << 20


def zip_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(archive, member, text) of the members whose name the pattern finds, decoded as UTF-8 with damaged bytes replaced. A file that is no zip archive is an error."""
    import pyarrow as pa

    ship(spark)
    wanted = re.compile(pattern)

    def unpack(batches):
        def rows(found):
            a, m, t = zip(*found)
            return pa.RecordBatch.from_pydict({"archive": pa.array(a, pa.string()), "member": pa.array(m, pa.string()), "text": pa.array(t, pa.string())})

        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, held = [], 0
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                    for name in z.namelist():
                        if wanted.search(name):
                            found.append((archive, name, z.read(name).decode("utf-8", "replace")))
                            held += len(found[-1][2])
                        if held > BATCH_BYTES:
                            yield rows(found)
                            found, held = [], 0
                if found:
                    yield rows(found)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(unpack, "archive string, member string, text string")


def stem(member: str) -> Column:
    return F.regexp_replace(F.regexp_extract(member, "([^/]*)$", 1), "\\.[^.]*$", "")


def composition_files(spark: SparkSession, path: str) -> DataFrame:
    """(kind, comp_id, xml): transliterations and translations by the folder they lie in, known by the file's name without its ending."""
    m = zip_members(spark, path, "\\.xml$")
    kind = F.when(F.contains("member", F.lit("/transliterations/")), "transliteration").when(F.contains("member", F.lit("/translations/")), "translation")
    return m.select(kind.alias("kind"), stem("member").alias("comp_id"), F.col("text").alias("xml")).where("kind IS NOT NULL")


def project_leaves(spark: SparkSession, path: str) -> DataFrame:
    """The leaves of all recursive texts of project archives, with doc_id from the file's name, as a written table: what lemmas, lines and pairs read. Damaged JSON is passed over."""
    texts = zip_members(spark, path, "corpusjson.*\\.json$").select(stem("member").alias("name"), "text")
    return written(walk_cdl(texts, "text", "name"), "leaves")


def project_texts(leaves: DataFrame, source: str, prefix: str = "sux") -> tuple[DataFrame, DataFrame]:
    """Lemmas, and (p_number, lines, source) of texts that have any, from one scan."""
    lines = cdl_lines(leaves, prefix).where("line <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return cdl_lemmas(leaves, prefix), lines.select(F.col("doc_id").alias("p_number"), F.transform("ls", lambda x: x["line"]).alias("lines"), F.lit(source).alias("source"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, genre) of the members that a project's catalogue lists; no rows without one."""
    text = zip_members(spark, path, "catalogue\\.json$").select(F.from_json("text", "members map<string, struct<genre: string>>").alias("c"))
    return text.select(F.explode("c.members").alias("doc_id", "m")).select("doc_id", F.coalesce("m.genre", F.lit("")).alias("genre"))


def incantations(spark: SparkSession, path: str, prefix: str = "sux") -> DataFrame:
    """(doc_id, tokens): the forms, as they are, of texts catalogued as incantations or prayers; of all texts without a catalogue."""
    leaves = project_leaves(spark, path).where(F.col("lang").startswith(prefix))
    docs = leaves.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "form"))).alias("t")).select("doc_id", F.transform("t", lambda x: x["form"]).alias("tokens"))
    return semi_by_genre(docs, catalogue(spark, path))
