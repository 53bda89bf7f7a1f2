"""Bilingual anchors: dictionary counts, co-occurrence, lexicon joins, bridges and merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from ..runtime import written
from .corpus import best_per_key


def confidence(n: Column) -> Column:
    return F.round(F.least(F.lit(0.95), 0.5 + n / 100), 4)


def bridge_confidence(cosine: Column) -> Column:
    return F.round(F.least(F.lit(0.85), 0.4 + cosine / 2), 4)


def dictionary_anchors(lemmas: DataFrame, least: int = 5, normalize: Callable[[Column], Column] = T.normalize_sumerian, keep: Callable[[Column], Column] = T.keep_sumerian_gloss, filter_first: bool = False) -> DataFrame:
    """surface, english, confidence, frequency, source, lemmas from lemma records (form, cf, gw).

    A record counts for its citation form and, if that differs, its form. The gloss filter comes after the
    threshold, or before counting with ``filter_first``.
    """
    rows = lemmas.select(normalize(F.col("cf")).alias("cf"), normalize(F.col("form")).alias("form"), T.strip(F.lower("gw")).alias("english"))
    rows = rows.where((F.col("english") != "") & (F.col("cf") != ""))
    rows = rows.where(keep(F.col("english"))) if filter_first else rows
    rows = rows.select(F.explode(F.array_distinct(F.array("cf", "form"))).alias("surface"), "english", F.col("cf").alias("lemma")).where("surface <> ''")
    out = rows.groupBy("surface", "english").agg(F.count(F.lit(1)).alias("frequency"), F.array_sort(F.collect_set("lemma")).alias("lemmas")).where(F.col("frequency") >= least)
    out = out if filter_first else out.where(keep(F.col("english")))
    return out.select("surface", "english", confidence(F.col("frequency")).alias("confidence"), "frequency", F.lit("dictionary").alias("source"), "lemmas")


def surface_map(lemmas: DataFrame, normalize: Callable[[Column], Column] = T.normalize_akkadian, alternates: Callable[[Column], Column] = T.mimation_alternates) -> DataFrame:
    """(cf, surface): every surface any record attests for a citation form, with alternates."""
    rows = lemmas.select(normalize(F.col("cf")).alias("cf"), normalize(F.col("form")).alias("form")).where("cf <> ''")
    return rows.select("cf", F.explode(F.array_distinct(F.concat(alternates(F.col("cf")), alternates(F.col("form"))))).alias("surface")).distinct()


def attested_anchors(lemmas: DataFrame, least: int = 5, normalize: Callable[[Column], Column] = T.normalize_akkadian) -> DataFrame:
    """As dictionary anchors, but each record counts for every surface of its citation form.

    Records are counted per (cf, english) before they meet the surfaces.
    """
    counted = lemmas.select(normalize(F.col("cf")).alias("cf"), T.strip(F.lower("gw")).alias("english")).where((F.col("cf") != "") & T.keep_sumerian_gloss(F.col("english")))
    counted = counted.groupBy("cf", "english").agg(F.count(F.lit(1)).alias("n"))
    out = counted.join(surface_map(lemmas, normalize), "cf").groupBy("surface", "english").agg(F.sum("n").alias("frequency"), F.array_sort(F.collect_set("cf")).alias("lemmas"))
    return out.where(F.col("frequency") >= least).select("surface", "english", confidence(F.col("frequency")).alias("confidence"), "frequency", F.lit("dictionary").alias("source"), "lemmas")


def cooccurrence_anchors(pairs: DataFrame, source_tokens: Column, target_tokens: Column, line: str = "line_no", least: int = 3, least_share: float = 0.3) -> DataFrame:
    """surface, english, share, lines: for each source word the target word that shares most of its lines.

    Ties go to the pair seen first: by line, then alphabetically. A target word in too few lines to reach the share is left out
    before words are paired, and so is a source word in too few lines; what is left goes to its source word as one list a line, not as a row a pair.
    """
    rows = pairs.select(F.col(line).alias("line"), F.array_distinct(source_tokens).alias("s"), F.array_distinct(target_tokens).alias("t")).where(F.size("t") > 0)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "lines")
    said = rows.select("row", "line", F.explode("s").alias("surface"))
    enough = said.groupBy("surface").agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") >= least)
    named = rows.select("row", F.explode("t").alias("english"))
    spread = named.groupBy("english").agg(F.count(F.lit(1)).alias("in")).withColumnRenamed("english", "_e")
    targets = named.join(spread, F.col("english").eqNullSafe(F.col("_e"))).groupBy("row").agg(F.collect_list(F.struct("in", "english")).alias("t"))
    met = said.join(enough, "surface").join(targets, "row")
    can = F.filter("t", lambda x: x["in"] / F.col("lines") >= least_share)
    met = met.select("surface", "lines", "line", F.transform(can, lambda x: x["english"]).alias("t")).where(F.size("t") > 0)
    both = met.repartition("surface").select("surface", "lines", "line", F.explode("t").alias("english"))
    both = both.groupBy("surface", "english").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"), F.max("lines").alias("lines"))
    best = best_per_key(both, ["surface"], [F.col("n").desc(), F.col("first"), F.col("english")]).withColumn("share", F.col("n") / F.col("lines"))
    return best.where(F.col("share") >= least_share).select("surface", "english", "share", "lines")


def lexicon_join(records: DataFrame, lexicon: DataFrame, vocabulary: Column, negators: tuple[str, ...] = T.NEGATORS) -> DataFrame:
    """Records (cf_norm, ...) with hit (the lexicon has the lemma) and english: of the first gloss with an English word, of the first five."""
    lex = lexicon.select(F.col("lemma_norm").alias("cf_norm"), "glosses", F.lit(True).alias("hit"))
    english = F.get(F.array_compact(F.transform(F.slice("glosses", 1, 5), lambda g: T.first_english(g, vocabulary, negators))), F.lit(0))
    return records.join(lex, "cf_norm", "left").withColumn("hit", F.coalesce("hit", F.lit(False))).withColumn("english", english).drop("glosses")


def hit_rate(joined: DataFrame) -> DataFrame:
    """hits, misses, hit_rate in one row."""
    return joined.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).withColumn("hit_rate", F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")))


class GateError(RuntimeError):
    """A quality gate stopped the run."""


def hit_rate_gate(stats: DataFrame, least: float = 0.40) -> dict:
    """The figures of ``hit_rate``; GateError if the rate is below ``least``. Write them before you ask."""
    r = stats.first()
    if (r["hit_rate"] or 0.0) < least:
        raise GateError(f"hit rate {r['hit_rate']} is below {least}")
    return r.asDict()


def merge_anchors(sources: list[DataFrame], keys: tuple[str, ...] = ("surface",)) -> DataFrame:
    """The most confident anchor per key; ties go to the earlier source, then the higher frequency and the gloss. Sorted by confidence."""
    rows = None
    for i, s in enumerate(sources):
        s = s.withColumn("src_ord", F.lit(i))
        rows = s if rows is None else rows.unionByName(s, allowMissingColumns=True)
    best = best_per_key(rows, list(keys), [F.col("confidence").desc(), F.col("src_ord"), F.col("frequency").desc_nulls_last(), F.col("english")])
    return best.orderBy(F.col("confidence").desc(), "src_ord", *keys).drop("src_ord")


def bridge_anchors(pairs: DataFrame, nearest: DataFrame, least: float = 0.5) -> DataFrame:
    """Akkadian anchors by way of Sumerian: pair (sumerian_cf, surface), then the English word nearest to the Sumerian one.

    ``nearest`` is (word, english, cosine), one row per Sumerian word.
    """
    got = pairs.join(nearest.withColumnRenamed("word", "sumerian_cf"), "sumerian_cf").where(F.col("cosine") >= least)
    return best_per_key(got, ["surface", "english"], [F.col("ord")]).withColumn("confidence", bridge_confidence(F.col("cosine")))


def heterogram_bridge(counts: DataFrame, vocabulary: DataFrame, least: int = 5, normalize: Callable[[Column], Column] = T.normalize_akkadian) -> DataFrame:
    """(kind, sign, n) with the vocabulary word it stands for: Sumerograms as they are, else in lower case; Akkadograms normalised."""
    keys = F.when(F.col("kind") == "sumerogram", F.array("sign", F.lower("sign"))).otherwise(F.array(normalize(F.col("sign"))))
    rows = counts.where(F.col("n") >= least).select("kind", "sign", "n", F.posexplode(keys).alias("at", "word"))
    return best_per_key(rows.join(vocabulary.select("word"), "word", "left_semi"), ["kind", "sign"], [F.col("at")]).drop("at")


def heterogram_counts(words: DataFrame) -> DataFrame:
    """(kind, sign, n) from words with arrays sumerograms and akkadograms, most frequent first."""
    long = words.select(F.explode(F.array(F.struct(F.lit("sumerogram").alias("kind"), F.col("sumerograms").alias("signs")), F.struct(F.lit("akkadogram").alias("kind"), F.col("akkadograms").alias("signs")))).alias("x"))
    return long.select("x.kind", F.explode("x.signs").alias("sign")).groupBy("kind", "sign").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind", "sign")


def bilingual_pairs(words: DataFrame) -> DataFrame:
    """(doc_id, line_no, sumerian, akkadian): the first word of either language of each line that has both."""
    first = lambda lang: F.min_by(F.when(F.col("lang").startswith(lang), F.col("word")), F.when(F.col("lang").startswith(lang), F.col("ord")))
    return words.groupBy("doc_id", "line_no").agg(first("sux").alias("sumerian"), first("akk").alias("akkadian")).where("sumerian IS NOT NULL AND akkadian IS NOT NULL")


def translated_anchors(glosses: DataFrame, translation: DataFrame, least: int = 5) -> DataFrame:
    """(surface, gloss) rows counted, translated by (gloss, english, cosine) and counted again per (surface, english)."""
    common = glosses.groupBy("gloss").agg(F.count(F.lit(1)).alias("n_gloss")).where(F.col("n_gloss") >= least)
    got = glosses.join(common, "gloss", "left_semi").join(translation, "gloss")
    out = got.groupBy("surface", "english").agg(F.count(F.lit(1)).alias("frequency")).where(F.col("frequency") >= least)
    return out.withColumn("confidence", confidence(F.col("frequency")))


def match_translations(lines: DataFrame, translations: DataFrame) -> DataFrame:
    """Each line with the translation of its ``corresp``, or failing that of its ``line_id``; null without either."""
    t = translations.groupBy("key").agg(F.max_by("text", "ord").alias("text"))  # later ones win
    a = t.select(F.col("key").alias("corresp"), F.col("text").alias("by_corresp"))
    b = t.select(F.col("key").alias("line_id"), F.col("text").alias("by_line"))
    return lines.join(a, "corresp", "left").join(b, "line_id", "left").withColumn("translation", F.coalesce("by_corresp", "by_line")).drop("by_corresp", "by_line")


def monosemous_pairs(anchors: DataFrame) -> DataFrame:
    """Distinct (surface, english) of surfaces with one gloss only, with the first place of each."""
    one = anchors.groupBy("surface").agg(F.count_distinct("english").alias("n")).where("n = 1")
    return anchors.join(one, "surface", "left_semi").groupBy("surface", "english").agg(F.min("ord").alias("ord"))


def gather_training(anchors: DataFrame, source: DataFrame, target: DataFrame, fallback: Callable[[Column], Column] | None = None, subwords: DataFrame | None = None, train: Column | None = None) -> DataFrame:
    """Anchors whose surface and English word both have vectors, with x, y and subword_inferred, by ord.

    ``fallback`` maps a surface to a second key (case-folded, say) that is tried in the same way; the first row of a key wins. Where neither has a vector,
    one of ``subwords`` (word, vec), lengthened by zeros to the width of the others, is taken for rows of which ``train`` holds.
    """
    s = source.select(F.col("word").alias("surface"), F.col("vec").alias("x"))
    t = target.select(F.col("word").alias("english"), F.col("vec").alias("y"))
    rows = anchors.join(t, "english").join(s, "surface", "left")
    if fallback is not None:
        folded = best_per_key(source.select(fallback(F.col("word")).alias("k"), F.col("vec").alias("x2"), "row_idx"), ["k"], [F.col("row_idx")]).drop("row_idx")
        rows = rows.withColumn("k", fallback(F.col("surface"))).join(folded, "k", "left").withColumn("x", F.coalesce("x", "x2")).drop("k", "x2")
    rows = rows.withColumn("subword_inferred", F.lit(False))
    if subwords is not None:
        width = source.select(F.size("vec").alias("n")).first()
        longer = F.concat("vec", F.array_repeat(F.lit(0.0), F.greatest(F.lit(width["n"] if width else 0) - F.size("vec"), F.lit(0))))
        made = subwords.select(F.col("word").alias("surface"), longer.cast(source.schema["vec"].dataType).alias("x3"))
        may = F.col("x").isNull() & F.col("x3").isNotNull() & (train if train is not None else F.lit(True))
        rows = rows.join(made, "surface", "left").withColumn("subword_inferred", may).withColumn("x", F.when(may, F.col("x3")).otherwise(F.col("x"))).drop("x3")
    return rows.where("x IS NOT NULL").orderBy("ord")


def dedup_collisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Surfaces that merging removed."""
    return before.select("surface").distinct().join(after.select("surface"), "surface", "left_anti")


def drop_stop_glosses(anchors: DataFrame) -> DataFrame:
    return anchors.where(~F.lower("english").isin(*T.ENGLISH_STOP_GLOSSES))


def best_normalized(anchors: DataFrame, normalize: Callable[[Column], Column] = T.normalize_egyptian, least: int = 5) -> DataFrame:
    """Raw anchors (surface, english, frequency, ord) filtered, one per normalised surface: the most frequent."""
    keep = (F.col("frequency") >= least) & (F.length("english") > 1) & ~F.col("english").isin(*[g for g in T.JUNK_GLOSSES if g not in ("unmng", "cf")]) & ~F.col("english").rlike("^\\d+$") & T.gw_is_usable(F.col("english"))
    return best_per_key(anchors.where(keep).withColumn("raw", F.col("surface")).withColumn("surface", normalize(F.col("surface"))), ["surface"], [F.col("frequency").desc(), F.col("ord")])
