"""Entry points: corpus to anchors, audit, coverage diagnostic, genre study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..operators import anchors as A, corpus as C, diagnostics as D, docs as DOC, evaluation as E, graph as G, linear as L, models as M
from ..runtime import written
from ..slots import SLOTS, SlotSpec


def clean_corpus(texts: DataFrame, slot: SlotSpec) -> DataFrame:
    """(p_number, ord, tokens) of the best record per text, lines cleaned by the slot; texts without tokens are left out."""
    best = C.deduplicate_records(texts)
    lines = best.select("p_number", "ord", F.posexplode("lines").alias("at", "line")).withColumn("clean", slot.clean(F.col("line")))
    docs = C.ordered_lines(lines.where("clean <> ''"), ["p_number", "ord"], "at", "clean")
    return docs.select("p_number", "ord", F.flatten(F.transform("lines", lambda x: T.tokens(x))).alias("tokens"))


def build_anchors(lemmas: DataFrame, slot: SlotSpec, pairs: DataFrame | None = None, source_tokens: Column | None = None, target_tokens: Column | None = None) -> DataFrame:
    """Dictionary anchors of the slot, with those of parallel lines where no dictionary has the surface as confident."""
    sources = [A.attested_anchors(lemmas, slot.min_count, slot.normalize) if slot.name == "akkadian" else A.dictionary_anchors(lemmas, slot.min_count, slot.normalize, slot.keep_gloss, slot.filter_first)]
    if pairs is not None:
        co = A.cooccurrence_anchors(pairs, source_tokens, target_tokens)
        sources.append(co.select("surface", "english", F.round("share", 4).alias("confidence"), F.col("lines").alias("frequency"), F.lit("cooccurrence").alias("source")))
    return A.merge_anchors(sources)


def align(anchors: DataFrame, source: DataFrame, target: DataFrame, slot: SlotSpec, alphas=L.ALPHAS, candidates: int = E.CANDIDATES) -> dict:
    """Split without leaks, choose the penalty on validation, refit on train and validation, score the suite."""
    split = written(G.group_split(G.anchor_groups(anchors, slot.split_fallback)), "split")
    fold = (lambda c: F.lower(c)) if slot.name == "egyptian" else None
    missing = split.select("surface").join(source, F.col("surface") == F.col("word"), "left_anti").select(F.col("surface").alias("word")).distinct()
    made = M.subword_vectors(missing, M.ngram_vectors(source)) if slot.subwords_for_training else None
    data = written(A.gather_training(split, source, target, fold, made, F.col("part") == "train"), "gathered")
    part = lambda p: data.where(F.col("part") == p)
    cand = written(E.load_candidates(target, candidates), "candidates")
    predicted = lambda rows, coef, b: L.project(rows, "x", coef.T, b, "vec").select(F.col("ord").alias("q_id"), "ord", F.col("english").alias("gold"), "surface", "vec")
    val, scores = part("val"), {}
    for a, (coef, b) in L.ridge_path(L.gram(part("train")), alphas).items():
        scores[a] = E.val_topk(written(predicted(val, coef, b), "val"), cand, 5)
    alpha = L.select_alpha(scores, max(1, val.count()))
    coef, b = L.ridge(L.gram(data.where("part <> 'test'")), alpha)
    final = {p: written(predicted(part(p), coef, b), p) for p in ("train", "val", "test")}
    return {"alpha": alpha, "scores": scores, "coef": coef, "intercept": b, "suite": E.score_suite(final["train"], final["val"], final["test"], cand), "predictions": final}


def audit(anchors: DataFrame, vocabulary: DataFrame, glove: DataFrame, gemma: DataFrame, slot: SlotSpec, before: DataFrame | None = None) -> dict[str, DataFrame]:
    """Classified anchors, bucket counts and the table of the two targets."""
    collisions = A.dedup_collisions(before, anchors) if before is not None else None
    rows = written(D.classify_anchors(anchors, vocabulary, glove, gemma, collisions, T.strip if slot.name == "sumerian" else slot.normalize), "audit")
    return {"rows": rows, "buckets": D.bucket_counts(rows), "venn": D.venn(rows.where("bucket IN ('both_miss', 'glove_miss', 'gemma_miss', 'survives')"))}


def coverage_diagnostic(anchors: DataFrame, audited: DataFrame, vocabulary: DataFrame, docs: DataFrame, lemmas: DataFrame, slot: SlotSpec) -> dict[str, DataFrame]:
    """Misses of an audit by the way they could be recovered, and what each way would bring."""
    misses = audited.where("bucket = 'vocab_miss'").select("surface")
    surfaces = A.surface_map(lemmas, slot.normalize, slot.alternates or (lambda c: F.array(c)))
    grams = vocabulary.select(F.explode(T.char_ngrams(F.col("word"))).alias("gram")).distinct()
    rows = written(D.classify_misses(misses, vocabulary, C.token_frequency(docs, F.col("tokens")), surfaces, grams, slot.normalize, slot.min_count), "misses")
    counts = D.bucket_counts(rows, D.MISS_BUCKETS)
    return {"rows": rows, "buckets": counts, "sweep": D.threshold_sweep(rows), "normalized": D.normalization_hits(rows), "lemmas": D.lemma_expansion(anchors, surfaces, vocabulary), "recoverability": D.recoverability(counts)}


def genre_study(docs: DataFrame, spaces: dict[str, DataFrame], least: int = 10) -> DataFrame:
    """(space, n, accuracy, majority): leave-one-out genre accuracy of weighted centroids in each space. ``docs`` is (doc_id, genre, tokens)."""
    docs = written(C.genres_with_enough(docs, "genre", least), "genres")
    weights = written(DOC.sif_weights(C.token_frequency(docs, F.col("tokens"))), "weights")
    out = None
    for name, space in spaces.items():
        c = DOC.doc_centroids(docs, F.col("tokens"), space, weights).join(docs.select("doc_id", "genre"), "doc_id")
        names = sorted(r["genre"] for r in docs.select("genre").distinct().collect())
        table = docs.sparkSession.createDataFrame([(g, i) for i, g in enumerate(names)], "genre string, label int")
        number = written(c.join(table, "genre"), "centroids")
        loo = DOC.loo_nearest_centroid(number, "label", "mean", "doc_id")
        row = loo.agg(F.count(F.lit(1)).alias("n"), (100 * F.avg((F.col("label") == F.col("predicted")).cast("double"))).alias("accuracy")).join(DOC.majority_share(number, "label")).select(F.lit(name).alias("space"), "n", "accuracy", "majority")
        out = row if out is None else out.unionByName(row)
    return out


__all__ = ["SLOTS", "align", "audit", "build_anchors", "clean_corpus", "coverage_diagnostic", "genre_study"]
