"""Corpus operators: record dedup, ordered rollups, frequencies, totals, context frames, running ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which must settle every tie.

    Spark turns row_number() <= 1 into a group limit before the shuffle, so that a hot key sends one row per task.
    """
    ranked = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(ranked)).where("_rn <= 1").drop("_rn")


def deduplicate_records(texts: DataFrame, key: str = "p_number", lines: str = "lines", order: str = "ord") -> DataFrame:
    """Per non-empty key the record with most lines (ties: the first); records without a key all stay, after the others."""
    keyed = F.coalesce(F.col(key), F.lit("")) != ""
    best = best_per_key(texts.where(keyed), [key], [F.size(lines).desc(), F.col(order)])
    return best.unionByName(texts.where(~keyed))


def dedup_stats(texts: DataFrame, kept: DataFrame, key: str = "p_number") -> DataFrame:
    """total_input, with_key, without_key, unique_output, duplicates_removed in one row."""
    keyed = F.coalesce(F.col(key), F.lit("")) != ""
    a = texts.agg(F.count(F.lit(1)).alias("total_input"), F.count_if(keyed).alias("with_key"), F.count_if(~keyed).alias("without_key"))
    b = kept.agg(F.count(F.lit(1)).alias("unique_output"))
    return a.join(b).withColumn("duplicates_removed", F.col("total_input") - F.col("unique_output"))


def ordered_lines(rows: DataFrame, keys: list[str], order: str, value: str, name: str = "lines") -> DataFrame:
    """Each group's values that aren't null, as a list in order. Groups are documents: their size is theirs, not the table's."""
    got = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))))
    return rows.groupBy(*keys).agg(F.transform(got, lambda x: x["v"]).alias(name))


def token_frequency(docs: DataFrame, tokens: Column) -> DataFrame:
    return docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def corpus_totals(docs: DataFrame, tokens: Column) -> DataFrame:
    """n_docs, n_tokens and n_types of the documents that have tokens, in one row."""
    t = docs.select(tokens.alias("t")).where(F.size("t") > 0)
    types = t.select(F.explode("t").alias("token")).groupBy("token").count().agg(F.count(F.lit(1)).alias("n_types"))
    return t.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("t")).alias("n_tokens")).join(types)


def context_frames(lines: DataFrame, key: str, order: str, text: str, match: Column, before: int = 2, after: int = 2) -> DataFrame:
    """For each text's first matching line, that line with those around it, clamped at the ends."""
    frame = W.partitionBy(key).orderBy(order)
    rows = lines.withColumn("context", F.collect_list(text).over(frame.rowsBetween(-before, after))).where(match)
    return best_per_key(rows, [key], [F.col(order)])


def find_passages(lines: DataFrame, key: str, order: str, text: str, match: Column, most: int, around: int = 2) -> DataFrame:
    """At most ``most`` frames, by text and line."""
    return context_frames(lines, key, order, text, match, around, around).orderBy(key, order).limit(most)


def running_id(rows: DataFrame, key: str, order: list[Column | str], starts: Column, name: str = "group_id") -> DataFrame:
    """A number per row that goes up wherever ``starts`` holds: rows between separators share it."""
    frame = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(frame))


def longest_per_class(docs: DataFrame, cls: str, size: str, doc: str, n: int) -> DataFrame:
    """The n longest documents of each class, ties by id."""
    order = W.partitionBy(cls).orderBy(F.col(size).desc(), F.col(doc))
    return docs.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= n)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources; columns that one lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def vocabulary_gate(docs: DataFrame, tokens: Column, vocabulary: DataFrame, least: int = 30, doc: str = "doc_id") -> DataFrame:
    """doc, n_tokens, n_known of documents with at least ``least`` token occurrences in the vocabulary."""
    t = docs.select(doc, F.explode(tokens).alias("token"))
    v = vocabulary.select(F.col("word").alias("token")).distinct().withColumn("known", F.lit(True))
    return t.join(v, "token", "left").groupBy(doc).agg(F.count(F.lit(1)).alias("n_tokens"), F.count("known").alias("n_known")).where(F.col("n_known") >= least)


def semi_by_genre(docs: DataFrame, catalogue: DataFrame, pattern: str = "incantation|prayer") -> DataFrame:
    """Documents whose catalogue genre matches; all of them if there is no catalogue."""
    if catalogue.isEmpty():
        return docs
    return docs.join(catalogue.where(F.lower("genre").rlike(pattern)), "doc_id", "left_semi")


def genres_with_enough(docs: DataFrame, genre: str, least: int = 10) -> DataFrame:
    big = docs.groupBy(genre).count().where(F.col("count") >= least)
    return docs.join(big.select(genre), genre, "left_semi")
