"""Named queries, with SQL, for the token rules, gloss rules and table operators that the first catalogue leaves out.

Inputs are made of all distinct words of the documents, dressed as the rules' scripts have them, or of whole driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T, vectors as V
from ..operators import anchors as A, diagnostics as D, docs as DOC, evaluation as E, nearest as N, study as S
from .catalog import UNIT_SQL, WORDS_SQL, query, space, table, words

#: Every distinct word of the documents.
VOCABULARY_SQL = f"w AS (SELECT DISTINCT unnest({WORDS_SQL.format('text')}) AS w FROM documents)"


def vocabulary(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(words()).alias("w")).distinct()


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def dressed(name: str, python, sql_in: str, sql_out: str, dress) -> None:
    """A query of a rule on each word, dressed alike on both sides: (token, norm)."""

    @query(name, f"WITH {VOCABULARY_SQL}, x AS (SELECT {sql_in} AS x FROM w) SELECT x AS token, {sql_out} AS norm FROM x")
    def _(spark, d):
        x = vocabulary(spark, d).select(dress(F.col("w")).alias("token"))
        return x.select("token", python(F.col("token")).alias("norm"))


lit = F.lit
_BRACES = r"regexp_replace({0}, '\{{([^}}]*)\}}', '\1', 'g')"
_SZ = "replace(replace({0}, 'š', 'sz'), 'Š', 'SZ')"
_DIGITS = f"translate({{0}}, '{T.SUBSCRIPTS[0]}', '{T.SUBSCRIPTS[1]}')"


def _single_vowels(x: str) -> str:
    for v in "aeiou":
        x = f"regexp_replace({x}, '{v}+', '{v}', 'g')"
    return x


_SUMERIAN = f"lower(replace(translate({_SZ.format(_BRACES.format(_DIGITS.format('x')))}, '{T.SUMERIAN_LETTERS[0]}', '{T.SUMERIAN_LETTERS[1]}'), '-', ''))"
_AKKADIAN = f"translate({_SZ.format(_BRACES.format(_DIGITS.format('x')))}, '{T.AKKADIAN_LETTERS[0]}', '{T.AKKADIAN_LETTERS[1]}')"

# --- token rules ----------------------------------------------------------------------

dressed("normalize_sumerian", T.normalize_sumerian, "'{d}' || w || '-Š₂ŋ'", _SUMERIAN, lambda w: F.concat(lit("{d}"), w, lit("-Š₂ŋ")))
dressed("normalize_hittite", T.normalize_hittite, "w || 'aā₄=ma-x'", f"lower({_single_vowels(f'''regexp_replace({_AKKADIAN}, '[-=]', '', 'g')''')})", lambda w: F.concat(w, lit("aā₄=ma-x")))
dressed("normalize_greek", T.normalize_greek, "w || 'ἀρχῆς'", "replace(lower(strip_accents(x)), 'ς', 'σ')", lambda w: F.concat(w, lit("ἀρχῆς")))
dressed("normalize_sanskrit", T.normalize_sanskrit, "' ' || upper(w) || 'Ṛṣi '", "trim(lower(nfc_normalize(x)))", lambda w: F.concat(lit(" "), F.upper(w), lit("Ṛṣi ")))
dressed(
    "normalize_egyptian",
    T.normalize_egyptian,
    "'ꜣḥ' || w || 'BT'",
    f"translate(translate(x, '{T.EGYPTIAN_LETTERS[0]}', '{T.EGYPTIAN_LETTERS[1]}'), '{T.EGYPTIAN_LOWERED[0]}', '{T.EGYPTIAN_LOWERED[1]}')",
    lambda w: F.concat(lit("ꜣḥ"), w, lit("BT")),
)
dressed("slp1_to_iast", T.slp1_to_iast, "w || 'K'", "translate(substring(x, 1, length(x) - 1), 'fxwqz', 'ṛḷṭḍṣ') || 'kh'", lambda w: F.concat(w, lit("K")))
dressed("mimation", lambda c: F.array_join(T.mimation_alternates(c), "|"), "w || 'um'", "x || '|' || substring(x, 1, length(x) - 1)", lambda w: F.concat(w, lit("um")))
dressed("clitics", lambda c: F.array_join(T.clitic_alternates(c), "|"), "w || '=ma'", "x || '|' || split_part(x, '=', 1)", lambda w: F.concat(w, lit("=ma")))
dressed("morphemes", lambda c: F.array_join(T.morphemes(c), "|"), "w || '-Ša₃--' || w", "replace(lower(replace(replace(translate(x, '₃', '3'), '--', '-'), 'Š', 'sz')), '-', '|')", lambda w: F.concat(w, lit("-Ša₃--"), w))
dressed("clean_line", T.clean_line, "' ' || upper(w) || '  ' || w || ' '", "trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))", lambda w: F.concat(lit(" "), F.upper(w), lit("  "), w, lit(" ")))
dressed("clean_gloss", T.clean_gloss, "' ' || w || ' ;— '", "regexp_replace(trim(x), '[\\s,.;:—-]+$', '')", lambda w: F.concat(lit(" "), w, lit(" ;— ")))
dressed(
    "gloss_segments",
    lambda c: F.array_join(T.gloss_segments(c), "|"),
    "w || 'ab (x, y), etc; \"' || w || 'cd\", 12'",
    "regexp_extract(x, '^([a-z]+)', 1) || '|' || regexp_extract(x, '\"([a-z]+)\"', 1)",
    lambda w: F.concat(w, lit('ab (x, y), etc; "'), w, lit('cd", 12')),
)
dressed("markdown_cells", T.markdown_cell, "w || '|' || w", "replace(x, '|', '\\|')", lambda w: F.concat(w, lit("|"), w))
dressed("composition_ids", lambda c: F.concat_ws(" ", T.translation_key(c), T.composition_by_last_dot(c), T.composition_by_first_dot(c)), "'c.' || w || '.12'", "'t' || substring(x, 2) || ' ' || substring(x, 1, length(x) - 3) || ' c'", lambda w: F.concat(lit("c."), w, lit(".12")))
dressed("book_numbers", T.book_number, "'a, ' || w || ' , c'", "trim(split_part(x, ',', 2))", lambda w: F.concat(lit("a, "), w, lit(" , c")))
dressed("with_definitions", lambda c: T.with_definition(c, F.when(F.length(c) > 4, F.upper(c))), "w", "CASE WHEN length(x) > 4 THEN x || ': ' || upper(x) ELSE x END", lambda w: w)
dressed("cuneiform_signs", lambda c: F.array_join(T.cuneiform_signs(c), ""), "'𒀀' || w || '𒀭𒀀'", "'𒀀𒀭'", lambda w: F.concat(lit("𒀀"), w, lit("𒀭𒀀")))

_SCAFFOLD = quoted(T.STOP_WORDS + tuple(x for x in T.SCAFFOLD if "'" not in x))
_USABLE = f"x NOT IN ({_SCAFFOLD}) AND x NOT IN ({quoted(T.CROSS_REFERENCES + T.NEGATORS)}) AND length(x) > 1"
dressed("usable_glosses", T.gw_is_usable, "w", f"({_USABLE})", lambda w: w)
dressed("sumerian_glosses", T.keep_sumerian_gloss, "w", f"(x NOT IN ({quoted(T.JUNK_GLOSSES)}) AND length(x) > 2 AND {_USABLE})", lambda w: w)
dressed("german_glosses", T.keep_german_gloss, "w", f"(x <> 'x' AND length(x) > 2 AND x NOT IN ({quoted(T.GERMAN_NEGATORS)}) AND {_USABLE})", lambda w: w)
dressed("languages_by_prefix", lambda c: T.language_is(c, "an"), "w", "starts_with(x, 'an')", lambda w: w)
dressed(
    "first_english",
    lambda c: T.first_english(c, F.array(lit("the"), lit("water"), lit("coop"))),
    "w || ' of the (co-op) water'",
    f"CASE WHEN regexp_extract(x, '^[a-z]+') IN ({quoted(T.NEGATORS + T.CROSS_REFERENCES)}) THEN NULL WHEN starts_with(x, 'water ') THEN 'water' ELSE 'coop' END",
    lambda w: F.concat(w, lit(" of the (co-op) water")),
)


@query("document_tokens", f"WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-zA-ZšŠḫḪṭṬṣṢĝĜ]+\\d*') AS t FROM documents) SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_types FROM t")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.document_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_types"))


# --- anchors --------------------------------------------------------------------------


@query("bridge_anchors", """WITH p AS (SELECT p_brand AS cf, p_type AS surface, p_partkey AS ord FROM part), n AS (SELECT p_brand AS cf, min(substring(p_brand, 1, 7)) AS english, CAST(count(*) % 10 AS DOUBLE) / 10 AS cosine FROM part GROUP BY p_brand)
SELECT surface, english, ord, round(least(0.85, 0.4 + cosine / 2), 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY surface, english ORDER BY ord) AS k FROM p JOIN n USING (cf) WHERE cosine >= 0.3) WHERE k = 1""")
def _(spark, d):
    part = table(spark, d, "part")
    nearest = part.groupBy(F.col("p_brand").alias("word")).agg(F.min(F.substring("p_brand", 1, 7)).alias("english"), ((F.count(lit(1)) % 10).cast("double") / 10).alias("cosine"))
    pairs = part.select(F.col("p_brand").alias("sumerian_cf"), F.col("p_type").alias("surface"), F.col("p_partkey").alias("ord"))
    return A.bridge_anchors(pairs, nearest, 0.3).select("surface", "english", "ord", "confidence")


@query("heterogram_bridge", f"""WITH {VOCABULARY_SQL}, c AS (SELECT upper(w) AS sign, count(*) AS n FROM (SELECT unnest({WORDS_SQL.format('text')}) AS w FROM documents) GROUP BY w HAVING count(*) >= 5)
SELECT 'sumerogram' AS kind, sign, n, lower(sign) AS word FROM c""")
def _(spark, d):
    v = vocabulary(spark, d).select(F.col("w").alias("word"))
    counts = table(spark, d, "documents").select(F.explode(words()).alias("w")).groupBy(F.upper("w").alias("sign")).agg(F.count(lit(1)).alias("n")).withColumn("kind", lit("sumerogram"))
    return A.heterogram_bridge(counts, v, 5).select("kind", "sign", "n", "word")


@query("bilingual_pairs", """SELECT conv_id AS doc_id, arg_min(text, turn) FILTER (role = 'user') AS sumerian, arg_min(text, turn) FILTER (role = 'assistant') AS akkadian FROM conversations WHERE text IS NOT NULL GROUP BY conv_id
HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0""")
def _(spark, d):
    c = table(spark, d, "conversations").where("text IS NOT NULL")
    rows = c.select(F.col("conv_id").alias("doc_id"), lit(0).alias("line_no"), F.when(F.col("role") == "user", "sux").when(F.col("role") == "assistant", "akk").otherwise("").alias("lang"), F.col("text").alias("word"), F.col("turn").alias("ord"))
    return A.bilingual_pairs(rows).select("doc_id", "sumerian", "akkadian")


@query("translated_anchors", """WITH g AS (SELECT p_brand AS surface, p_type AS gloss FROM part), c AS (SELECT gloss FROM g GROUP BY gloss HAVING count(*) >= 5), t AS (SELECT DISTINCT p_type AS gloss, split_part(p_type, ' ', 1) AS english FROM part)
SELECT surface, english, count(*) AS frequency, round(least(0.95, 0.5 + count(*) / 100.0), 4) AS confidence FROM g JOIN c USING (gloss) JOIN t USING (gloss) GROUP BY surface, english HAVING count(*) >= 5""")
def _(spark, d):
    part = table(spark, d, "part")
    translation = part.select(F.col("p_type").alias("gloss"), F.split_part("p_type", lit(" "), lit(1)).alias("english")).distinct()
    return A.translated_anchors(part.select(F.col("p_brand").alias("surface"), F.col("p_type").alias("gloss")), translation)


@query("drop_stop_glosses", f"WITH {VOCABULARY_SQL} SELECT w AS english FROM w WHERE w NOT IN ({quoted(T.ENGLISH_STOP_GLOSSES)})")
def _(spark, d):
    return A.drop_stop_glosses(vocabulary(spark, d).select(F.col("w").alias("english")))


@query("best_normalized", f"""WITH t AS (SELECT upper(substring(w, 1, 2)) || '+' AS surface, w AS english, count(*) AS frequency, min(w) AS ord FROM (SELECT unnest({WORDS_SQL.format('text')}) AS w FROM documents) GROUP BY w),
x AS (SELECT *, english AS x FROM t WHERE frequency >= 5 AND length(english) > 1 AND english NOT IN ({quoted(g for g in T.JUNK_GLOSSES if g not in ('unmng', 'cf'))}))
SELECT surface, english, frequency FROM (SELECT lower(surface) AS surface, english, frequency, row_number() OVER (PARTITION BY lower(surface) ORDER BY frequency DESC, ord) AS k FROM x WHERE {_USABLE}) WHERE k = 1""")
def _(spark, d):
    w = table(spark, d, "documents").select(F.explode(words()).alias("english")).groupBy("english").agg(F.count(lit(1)).alias("frequency"))
    raw = w.select(F.concat(F.upper(F.substring("english", 1, 2)), lit("+")).alias("surface"), "english", "frequency", F.col("english").alias("ord"))
    return A.best_normalized(raw).select("surface", "english", "frequency")


# --- audits ---------------------------------------------------------------------------


@query("majority_share", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT CAST(100.0 * max(n) / sum(n) AS DOUBLE) AS majority FROM c")
def _(spark, d):
    return DOC.majority_share(table(spark, d, "embeddings"), "label")


@query("recoverability", """WITH n AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'normalization_recoverable' WHEN '2-HIGH' THEN 'lemma_surface_recoverable' ELSE 'genuinely_missing' END AS bucket FROM orders)
SELECT CASE bucket WHEN 'normalization_recoverable' THEN 'high' WHEN 'lemma_surface_recoverable' THEN 'medium' ELSE 'low' END AS level, round(100.0 * count(*) / (SELECT count(*) FROM n), 9) AS pct FROM n GROUP BY bucket""")
def _(spark, d):
    o = F.col("o_orderpriority")
    rows = table(spark, d, "orders").select(F.when(o == "1-URGENT", D.MISS_BUCKETS[0]).when(o == "2-HIGH", D.MISS_BUCKETS[2]).otherwise(D.MISS_BUCKETS[6]).alias("bucket"))
    return D.recoverability(D.bucket_counts(rows, D.MISS_BUCKETS)).select("level", F.round("pct", 9).alias("pct"))


@query("lemma_expansion", """WITH s AS (SELECT DISTINCT p_brand AS cf, p_type AS surface FROM part), v AS (SELECT DISTINCT p_type AS surface FROM part WHERE p_size > 40), a AS (SELECT DISTINCT p_brand AS cf FROM part WHERE p_size < 10)
SELECT count(DISTINCT cf) AS resolvable, count(DISTINCT surface) AS surfaces FROM a JOIN s USING (cf) JOIN v USING (surface)""")
def _(spark, d):
    part = table(spark, d, "part")
    surfaces = part.select(F.col("p_brand").alias("cf"), F.col("p_type").alias("surface")).distinct()
    return D.lemma_expansion(part.where("p_size < 10").select(F.col("p_brand").alias("surface")).distinct(), surfaces, part.where("p_size > 40").select(F.col("p_type").alias("word")))


@query("degenerate_share", "SELECT p_brand AS concept, avg(CASE WHEN length(CAST(p_size AS VARCHAR)) <= 1 THEN 0 ELSE 1 END) AS share FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part) WHERE k <= 5 GROUP BY p_brand")
def _(spark, d):
    from pyspark.sql import Window as W

    rnk = F.row_number().over(W.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey"))
    # a fragment has at most two letters: here the sizes of two digits
    top = table(spark, d, "part").select(F.col("p_brand").alias("concept"), F.when(F.col("p_size") >= 10, "xx").otherwise("xxx").alias("word"), rnk.alias("rnk"))
    return D.degenerate_share(top, "concept", "word")


@query("preflight", """WITH c AS (SELECT DISTINCT p_brand AS concept FROM part), k AS (SELECT DISTINCT lower(p_brand) AS k FROM part WHERE p_size > 48), t AS (SELECT p_brand AS concept, avg(CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 5 GROUP BY p_brand), n AS (SELECT p_brand AS concept, count(*) AS n FROM part WHERE p_size % 7 = 0 GROUP BY p_brand)
SELECT concept, k IS NOT NULL AND coalesce(n, 0) > 0 AS passed, (CASE WHEN k IS NULL THEN 1 ELSE 0 END) + (CASE WHEN coalesce(n, 0) = 0 THEN 1 ELSE 0 END) AS n_reasons, CASE WHEN coalesce(share, 1.0) > 0.5 THEN 1 ELSE 0 END AS n_warnings, coalesce(n, 0) AS n_passages FROM c LEFT JOIN k ON lower(concept) = k LEFT JOIN t USING (concept) LEFT JOIN n USING (concept)""")
def _(spark, d):
    from pyspark.sql import Window as W

    part = table(spark, d, "part").withColumn("concept", F.col("p_brand"))
    top = part.select("concept", F.when(F.col("p_size") % 2 == 0, "x").otherwise("long").alias("word"), F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")).alias("rnk"))
    english = part.where("p_size > 48").select(F.lower("p_brand").alias("word"))
    got = D.preflight(part.select("concept").distinct(), english, top, part.where("p_size % 7 = 0").select("concept"))
    return got.select("concept", "passed", F.size("reasons").alias("n_reasons"), F.size("warnings").alias("n_warnings"), "n_passages")


@query("first_duplicates", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def _(spark, d):
    return D.first_duplicates(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("composed_vectors", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT label, unnest(range(1, 65)) AS i, v FROM v), m AS (SELECT label, i, avg(v[i]) AS m FROM x GROUP BY ALL)
SELECT 's' || label AS surface, round(sqrt(sum(m * m)), 6) AS len FROM m GROUP BY label""")
def _(spark, d):
    e = space(spark, d)
    sp = e.select(F.concat(lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec"))
    misses = e.groupBy(F.concat(lit("s"), "label").alias("surface")).agg(F.collect_list(F.concat(lit("w"), "vec_id")).alias("parts")).withColumn("morphemes_hit", lit(True))
    return D.composed_vectors(misses, sp).select("surface", F.round(V.norm(F.col("mean")), 6).alias("len"))


# --- documents and studies ------------------------------------------------------------


@query("compositions", """SELECT 'c' || conv_id AS comp, string_agg(role || turn, ' ' ORDER BY turn) AS body FROM conversations GROUP BY conv_id""")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.concat(lit("c"), "conv_id", lit("."), "turn").alias("line_id"), F.col("turn").alias("ord"), "role")
    return DOC.compositions(c, lit("x"), F.array(F.concat("role", "ord"))).select("comp", F.array_join("tokens", " ").alias("body"))


@query("profile_without_self", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, v FROM v), y AS (SELECT vec_id, label, i, v[i] AS a FROM x), s AS (SELECT label, i, sum(a) AS s, count(*) AS n FROM y GROUP BY ALL), p AS (SELECT vec_id, i, (s - a) / (n - 1) AS p FROM y JOIN s USING (label, i) WHERE n > 1)
SELECT vec_id AS doc, round(sqrt(sum(p * p)), 6) AS len FROM p GROUP BY vec_id""")
def _(spark, d):
    got = DOC.profile_without_self(space(spark, d), "vec_id", "label", "embedding")
    return got.select("doc", F.round(V.norm(F.col("profile")), 6).alias("len"))


@query("concept_fingerprints", f"WITH {UNIT_SQL}, c AS (SELECT vec_id, v FROM u WHERE vec_id < 5) SELECT u.vec_id AS doc_id, 'k' || c.vec_id AS concept, round(list_dot_product(u.v, c.v), 4) AS value FROM u, c")
def _(spark, d):
    e = space(spark, d)
    concepts = e.where("vec_id < 5").select(F.concat(lit("k"), "vec_id").alias("concept"), F.col("embedding").alias("vec"))
    return DOC.fingerprints(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("mean")), concepts)


@query("cluster_members", "SELECT o_orderpriority AS label, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey), ',') AS members FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 5 GROUP BY o_orderpriority")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), "o_orderkey", F.col("o_orderkey").cast("string").alias("word"))
    return DOC.cluster_members(rows, "label", "o_orderkey", "word").select("label", F.array_join("members", ",").alias("members"))


@query("gradient_means", "SELECT substring(p_brand, 1, 7) AS family, avg(p_retailprice) AS mean_rho FROM part GROUP BY ALL")
def _(spark, d):
    return S.gradient_means(table(spark, d, "part").select(F.substring("p_brand", 1, 7).alias("family"), F.col("p_retailprice").alias("rho")))


@query("parallel_ranks", f"""WITH {UNIT_SQL}, l AS (SELECT * FROM u WHERE vec_id % 100 = 0), s AS (SELECT l.vec_id AS pair, r.vec_id AS cand, list_dot_product(l.v, r.v) AS sim FROM l, u r), t AS (SELECT pair, sim AS t FROM s WHERE cand = pair + 1)
SELECT pair, 1 + count(*) FILTER (sim > t) AS rnk, count(*) AS pool FROM s JOIN t USING (pair) GROUP BY pair""")
def _(spark, d):
    e = space(spark, d)
    sides = e.select(lit("right").alias("side"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("mean")).unionByName(e.where("vec_id % 100 = 0").select(lit("left").alias("side"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("mean")))
    pairs = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("pair"), F.col("vec_id").alias("left_id"), (F.col("vec_id") + 1).alias("right_id"))
    return DOC.parallels(sides, pairs)


@query("synonyms", """WITH s AS (SELECT DISTINCT substring(p_brand, 1, 7) AS synset, lower(p_brand) AS w FROM part), g AS (SELECT DISTINCT p_brand AS word FROM part WHERE p_size > 45)
SELECT word, lower(word) AS synonym FROM g UNION SELECT g.word, b.w FROM g JOIN s a ON g.word = a.w JOIN s b USING (synset)""")
def _(spark, d):
    part = table(spark, d, "part")
    return E.synonyms(part.where("p_size > 45").select(F.col("p_brand").alias("word")).distinct(), part.select(F.substring("p_brand", 1, 7).alias("synset"), F.col("p_brand").alias("word")).distinct())


@query("score_regime", f"""WITH {UNIT_SQL}, qs AS (SELECT vec_id, v FROM u WHERE vec_id % 100 = 0), s AS (SELECT a.vec_id AS q, b.vec_id AS c, list_dot_product(a.v, b.v) AS x FROM qs a, u b), rr AS (SELECT c, avg(x) AS r FROM (SELECT c, x, row_number() OVER (PARTITION BY c ORDER BY round(x, 12) DESC, q) AS k FROM s) WHERE k <= 10 GROUP BY c), z AS (SELECT q, s.c, row_number() OVER (PARTITION BY q ORDER BY round(2 * x - r, 12) DESC, s.c) AS rnk FROM s JOIN rr ON s.c = rr.c), h AS (SELECT q, min(CASE WHEN c = q - q % 2 THEN rnk END) AS hit FROM z WHERE rnk <= 10 GROUP BY q)
SELECT count(*) AS n, 0 AS oov, 100.0 * avg(CASE WHEN hit <= 1 THEN 1.0 ELSE 0.0 END) AS exact_top1, 100.0 * avg(CASE WHEN hit <= 5 THEN 1.0 ELSE 0.0 END) AS exact_top5, 100.0 * avg(CASE WHEN hit <= 10 THEN 1.0 ELSE 0.0 END) AS exact_top10 FROM h""")
def _(spark, d):
    e = space(spark, d)
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.concat(lit("w"), F.col("vec_id") - F.col("vec_id") % 2).alias("gold"), F.col("embedding").alias("vec"))
    candidates = e.select(F.col("vec_id").alias("row_idx"), F.concat(lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec"))
    return E.score_regime(queries, candidates, queries.select("q_id", "vec")).select("n", "oov", "exact_top1", "exact_top5", "exact_top10")


@query("lookup_neighbours", f"WITH {UNIT_SQL}, b AS (SELECT v AS q FROM u WHERE vec_id = 9) SELECT 'w' || vec_id AS word, round(list_dot_product(v, q), 6) AS sim FROM u, b WHERE vec_id <> 9 ORDER BY list_dot_product(v, q) DESC, vec_id DESC LIMIT 10")
def _(spark, d):
    from .catalog import _lookup

    got = _lookup(spark, d).neighbours("w9", 10)
    return spark.createDataFrame([(w, round(s, 6)) for w, s in got], "word string, sim double")


@query("mean_vectors", """WITH x AS (SELECT label, unnest(range(1, 65)) AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT label, i - 1 AS dim, round(avg(v[i]), 6) AS m FROM x GROUP BY ALL""")
def _(spark, d):
    return N.mean_vector(space(spark, d), ["label"], "embedding").select("label", F.posexplode("mean").alias("dim", "m")).select("label", F.col("dim").cast("long").alias("dim"), F.round("m", 6).alias("m"))
