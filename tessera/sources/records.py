"""Scans of line and JSON formats."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.functions import udtf

from ..functions import text as T
from ..runtime import lateral, ship

#: Greek letters of Beta Code; marks follow their letter.
BETA = dict(zip("abgdezhqiklmncoprstufxyw", "αβγδεζηθικλμνξοπρστυφχψω"))
BETA_MARKS = {")": "̓", "(": "̔", "/": "́", "\\": "̀", "=": "͂", "+": "̈", "|": "ͅ"}


def beta_to_unicode(s: str | None) -> str | None:
    """Beta Code to composed Greek; a final s is ς; capitals are marked by *, with their marks before the letter; other characters stay."""
    import unicodedata

    if s is None:
        return None
    out, capital, held = [], False, ""
    for i, c in enumerate(s):
        low = c.lower()
        if c == "*":
            capital = True
        elif low in BETA:
            g = BETA[low]
            if low == "s" and not capital and not (i + 1 < len(s) and s[i + 1].lower() in BETA):
                g = "ς"
            out.append((g.upper() if capital else g) + held)
            capital, held = False, ""
        elif c in BETA_MARKS and capital:
            held += BETA_MARKS[c]
        elif c in BETA_MARKS and out:
            out.append(BETA_MARKS[c])
        else:
            out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parse_atf(files: DataFrame, text: str = "text") -> DataFrame:
    """(p_number, designation, lines, source) of the Sumerian texts of ATF files.

    A record opens with & and holds all up to the next; its lines count from the last language tag before them, and only
    if the record's last tag is Sumerian. Records without lines are dropped.
    """
    records = files.select(F.explode(F.split(F.concat(F.lit("\n"), text), "\n\\s*(?=&)")).alias("r"))
    rows = records.select(F.transform(F.split("r", "\n"), T.strip).alias("ls")).withColumn("head", F.get("ls", F.lit(0))).where(F.col("head").rlike("^&P\\d+\\s*="))
    tag = lambda x: x.startswith("#atf: lang")
    sumerian = lambda x: T.strip(F.replace(x, F.lit("#atf: lang"), F.lit(""))).startswith("sux")
    state = F.aggregate(
        "ls",
        F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("kept")),
        lambda a, x: F.when(tag(x), F.struct(sumerian(x).alias("on"), a["kept"].alias("kept")))
        .when(a["on"] & x.rlike("^\\d+[.']\\s"), F.struct(a["on"].alias("on"), F.concat(a["kept"], F.array(F.regexp_replace(x, "^\\d+[.']\\s+", ""))).alias("kept")))
        .otherwise(a),
    )
    got = rows.select(F.regexp_extract("head", "^&(P\\d+)", 1).alias("p_number"), T.strip(F.regexp_extract("head", "^&P\\d+\\s*=\\s*(.*)$", 1)).alias("designation"), state.alias("s"))
    lines = F.filter("s.kept", lambda x: x != "")
    return got.where(F.col("s.on")).select("p_number", "designation", lines.alias("lines"), F.lit("atf").alias("source")).where(F.size("lines") > 0)


@udtf(returnType="ord int, line_no int, lang string, form string, cf string, gw string, pos string, norm string")
class CdlWalk:
    """Leaves of a recursive text document in order, with the number of their line; a line start counts after the node's own leaf and before its children."""

    def eval(self, text: str):
        try:
            root = json.loads(text) if text else None
        except ValueError:
            return
        todo, n, line, filled = [root] if isinstance(root, dict) else [], 0, 0, False
        while todo:
            node = todo.pop()
            f = node.get("f")
            if isinstance(f, dict) and f.get("form"):
                yield n, line, *(f.get(k) or "" for k in ("lang", "form", "cf", "gw", "pos", "norm"))
                n, filled = n + 1, True
            if "line-start" in (node.get("ftype"), node.get("type")):
                line, filled = line + filled, False
            todo += [c for c in reversed(node.get("cdl") or ()) if isinstance(c, dict)]


def walk_cdl(files: DataFrame, text: str, doc: str) -> DataFrame:
    return lateral(files.select(F.col(doc).alias("doc_id"), F.col(text).alias("_text")), CdlWalk, "_text")


def cdl_lemmas(leaves: DataFrame, prefix: str = "sux") -> DataFrame:
    return leaves.where(F.col("lang").startswith(prefix)).select("doc_id", "form", "cf", "gw", "pos", "norm")


def cdl_lines(leaves: DataFrame, prefix: str = "sux") -> DataFrame:
    """(doc_id, line_no, line): the forms of a line in order."""
    rows = leaves.where(F.col("lang").startswith(prefix)).groupBy("doc_id", "line_no")
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "form"))), lambda x: x["form"]), " ").alias("line"))


def parse_conllu(files: DataFrame, text: str = "text", doc: str = "path") -> tuple[DataFrame, DataFrame]:
    """Tokens (doc, sent, ord, form, lemma, pos) and per-file counts (doc, token_lines, bad_lines).

    Blank lines end a sentence; comments, ranges, empty nodes, punctuation and empty forms are skipped, short rows counted.
    """
    lines = files.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\r?\n")).alias("at", "line"))
    w = W.partitionBy("doc").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = lines.withColumn("sent", F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(w)).where("trim(line) <> '' AND NOT startswith(line, '#')").withColumn("c", F.split("line", "\t"))
    counts = rows.groupBy("doc").agg(F.count_if(F.size("c") >= 10).alias("token_lines"), F.count_if(F.size("c") < 10).alias("bad_lines"))
    good = rows.where((F.size("c") >= 10) & ~F.col("c")[0].rlike("[-.]") & (F.col("c")[3] != "PUNCT") & ~F.col("c")[1].isin("", "_"))
    return good.select("doc", "sent", F.col("at").alias("ord"), F.col("c")[1].alias("form"), F.when(F.col("c")[2] == "_", "").otherwise(F.col("c")[2]).alias("lemma"), F.col("c")[3].alias("pos")), counts


def conllu_headers(files: DataFrame, text: str = "text", doc: str = "path") -> DataFrame:
    """(doc, key, value) of ## key: value lines."""
    lines = files.select(F.col(doc).alias("doc"), F.explode(F.split(text, "\r?\n")).alias("line")).where("startswith(line, '##')")
    return lines.select("doc", F.trim(F.regexp_extract("line", "^##\\s*([^:]+):", 1)).alias("key"), F.trim(F.regexp_extract("line", "^##\\s*[^:]+:(.*)$", 1)).alias("value"))


def parse_sentences_json(files: DataFrame, text: str = "text", doc: str = "path") -> DataFrame:
    """(doc, sent, ord, form, lemma, pos) of word tokens in JSON {sentences: [{tokens: [{type, form, lemma: {entry, POS}}]}]}; forms are Beta Code."""
    ship(files.sparkSession)
    schema = "sentences array<struct<tokens: array<struct<type: string, form: string, lemma: struct<entry: string, POS: string>>>>>"
    rows = files.select(F.col(doc).alias("doc"), F.posexplode(F.from_json(text, schema)["sentences"]).alias("sent", "s")).select("doc", "sent", F.posexplode("s.tokens").alias("ord", "t"))
    beta = F.udf(beta_to_unicode, "string", useArrow=True)
    return rows.where("t.type = 'word'").select("doc", "sent", "ord", beta(F.col("t.form")).alias("form"), F.col("t.lemma.entry").alias("lemma"), F.col("t.lemma.POS").alias("pos"))


def author_and_title(stem):
    """A stem 'author - title' divided once; without a divider all is title."""
    has = F.contains(stem, F.lit(" - "))
    return F.when(has, F.substring_index(stem, " - ", 1)).alias("author"), F.when(has, F.substr(stem, F.locate(" - ", stem) + 3)).otherwise(stem).alias("title")


def parse_vectors_text(lines: DataFrame, dim: int, value: str = "value", order: str = "row_idx") -> DataFrame:
    """(row_idx, word, vec) of 'word v1 ... vn' lines with an explicit row number; a line of another width is an error."""
    parts = F.split(value, " ")
    checked = F.when(F.size(parts) == dim + 1, F.transform(F.slice(parts, 2, dim), lambda x: x.cast("float"))).otherwise(F.raise_error(F.concat(F.lit(f"a vector line has not {dim} numbers: "), F.substring(value, 1, 40))))
    return lines.select(F.col(order).cast("long").alias("row_idx"), F.substring_index(value, " ", 1).alias("word"), checked.alias("vec"))


def vector_words(lines: DataFrame, value: str = "value") -> DataFrame:
    """Only the words of such lines."""
    return lines.select(F.substring_index(value, " ", 1).alias("word"))


def read_space(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """(row_idx, word, vec) with the width checked where it is given."""
    df = spark.read.parquet(path).select("row_idx", "word", "vec")
    return df if dim is None else df.withColumn("vec", F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.raise_error(F.lit(f"a vector is not {dim} wide"))))


def old_babylonian_lemmas(lemmas: DataFrame) -> DataFrame:
    """Entries attested in the Old Babylonian period with a guide word and lemma, and their surface forms."""
    ok = F.exists("periodAttestation", lambda p: F.contains(p, F.lit("Old Babylonian"))) & (F.coalesce("guideWord", F.lit("")) != "") & (F.size("lemma") > 0)
    return lemmas.where(ok).withColumn("forms", F.array_distinct(F.concat("lemma", F.coalesce("logograms", F.array().cast("array<string>")))))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_corpus(docs: DataFrame, tokens, path: str) -> None:
    """One document per line, blank-separated tokens; documents without tokens are left out."""
    docs.select(F.array_join(tokens, " ").alias("value")).where("value <> ''").write.mode("overwrite").text(path)


def write_space(space: DataFrame, path: str, half: bool = False) -> None:
    """Columns row_idx, word, vec in row order within files; numbers as floats, rounded to half precision with ``half``."""
    if half:
        import numpy as np
        import pandas as pd

        def halved(s: pd.Series) -> pd.Series:
            return s.map(lambda v: np.asarray(v, np.float16).astype(np.float32))

        halved.__annotations__ = {"s": pd.Series, "return": pd.Series}
        ship(space.sparkSession)
        space = space.withColumn("vec", F.pandas_udf(halved, "array<float>")("vec"))
    space.withColumn("vec", F.col("vec").cast("array<float>")).repartitionByRange("row_idx").sortWithinPartitions("row_idx").write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_vectors_text(space: DataFrame, path: str) -> None:
    """'word v1 ... vn' lines in row order within files, as ``parse_vectors_text`` reads them."""
    line = F.concat_ws(" ", "word", F.transform("vec", lambda x: x.cast("float").cast("string")))
    space.repartitionByRange("row_idx").sortWithinPartitions("row_idx").select(line.alias("value")).write.mode("overwrite").text(path)
