"""Named queries on the driver tables, with the SQL that states each one for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T, vectors as V
from ..operators import anchors as A, atlas, corpus as C, diagnostics as D, docs as DOC, evaluation as E, graph as G, linear as L, nearest as N, study as S
from ..sources import markup, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS_SQL = "regexp_extract_all(lower({0}), '[a-z]+')"


def words(c: str = "text"):
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


def space(spark, sf_dir, first: int | None = None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e if first is None else e.where(F.col("vec_id") < first)


#: Unit vectors in double precision.
UNIT_SQL = "u AS (SELECT vec_id, label, list_transform(v, lambda x: x / n) AS v FROM (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)))"

# --- text -----------------------------------------------------------------------------


@query("tokenize_documents", f"SELECT doc_id, len({WORDS_SQL.format('text')}) AS n_tokens, len(list_distinct({WORDS_SQL.format('text')})) AS n_types, array_to_string({WORDS_SQL.format('text')}[1:5], ' ') AS head FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", words().alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_types"), F.array_join(F.slice("t", 1, 5), " ").alias("head"))


@query("clean_markup", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(<script[^>]*>.*?</script>)|(<style[^>]*>.*?</style>)|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", markup.html_text(F.col("html")).alias("body"))


@query("html_links", r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, h[i] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a[^>]*\shref="([^"]*)"', 1) AS h FROM pages))""")
def _(spark, d):
    return markup.html_links(table(spark, d, "pages"))


@query("normalize_tokens", r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\s.,;:!?]+')) AS token FROM documents)
SELECT token, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(replace(regexp_replace(translate(token, 'âêîûáéíóúÂÊÎÛÁÉÍÓÚ', 'aeiuaeiouAEIUAEIOU'), '\{([^}]*)\}', '\1', 'g'), '-', '')), 'a+', 'a', 'g'), 'e+', 'e', 'g'), 'i+', 'i', 'g'), 'o+', 'o', 'g'), 'u+', 'u', 'g')) AS norm FROM t WHERE NOT regexp_matches(token, '[A-ZÀ-Þ]')""")
def _(spark, d):
    docs = table(spark, d, "documents")
    t = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[^\\s.,;:!?]+"), F.lit(0))).alias("token")).distinct().where(~F.col("token").rlike("[A-ZÀ-Þ]"))
    return t.select("token", T.normalize_akkadian(F.col("token")).alias("norm"))


@query("char_ngrams", f"""WITH t AS (SELECT DISTINCT unnest({WORDS_SQL.format('text')}) AS w FROM documents), p AS (SELECT w, '<' || w || '>' AS p FROM t), n AS (SELECT w, p, unnest(range(3, 7)) AS n FROM p), g AS (SELECT w, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM n WHERE n <= length(p))
SELECT substring(p, i, n) AS gram, count(DISTINCT w) AS n_words FROM g GROUP BY gram""")
def _(spark, d):
    t = table(spark, d, "documents").select(F.explode(words()).alias("w")).distinct()
    return t.select(F.explode(T.char_ngrams(F.col("w"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n_words"))


@query("near_surface_pairs", r"""WITH s AS (SELECT DISTINCT p_brand AS g, lower(split_part(p_name, ' ', 1)) || substring(CAST(p_partkey AS VARCHAR), 1, 2) AS w FROM part)
SELECT a.g AS english, a.w AS a, b.w AS b FROM s a JOIN s b ON a.g = b.g AND a.w < b.w AND abs(length(a.w) - length(b.w)) <= 1 AND levenshtein(a.w, b.w) <= 1""")
def _(spark, d):
    s = table(spark, d, "part").select(F.col("p_brand").alias("english"), F.concat(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))), F.substring(F.col("p_partkey").cast("string"), 1, 2)).alias("surface"))
    return G.near_surface_pairs(s)


# --- corpus ---------------------------------------------------------------------------


@query("dedupe_best_per_key", """WITH c AS (SELECT conv_id, count(*) AS n_turns, min(text) AS head FROM conversations GROUP BY conv_id), k AS (SELECT conv_id, n_turns, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE conv_id % 50 END AS key FROM c)
SELECT key, conv_id, n_turns FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_turns DESC, conv_id) AS rn FROM k WHERE key IS NOT NULL) WHERE rn = 1 UNION ALL SELECT key, conv_id, n_turns FROM k WHERE key IS NULL""")
def _(spark, d):
    c = C.ordered_lines(table(spark, d, "conversations"), ["conv_id"], "turn", "text")
    keyed = c.select(F.when(F.col("conv_id") % 7 == 0, None).otherwise((F.col("conv_id") % 50).cast("string")).alias("p_number"), "conv_id", "lines")
    out = C.deduplicate_records(keyed, order="conv_id")
    return out.select(F.col("p_number").cast("long").alias("key"), "conv_id", F.size("lines").cast("long").alias("n_turns"))


@query("dedupe_stats", """WITH d AS (SELECT CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS k FROM documents)
SELECT count(*) AS total_input, count(*) FILTER (k <> '') AS with_key, count(*) FILTER (k = '') AS without_key, count(DISTINCT k) FILTER (k <> '') + count(*) FILTER (k = '') AS unique_output, count(*) FILTER (k <> '') - count(DISTINCT k) FILTER (k <> '') AS duplicates_removed FROM d""")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("source")).alias("p_number"), F.split("text", "\n").alias("lines"), F.col("doc_id").alias("ord"))
    return C.dedup_stats(docs, C.deduplicate_records(docs))


@query("rollup_ordered_lines", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS body, count(text) AS n_lines FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = C.ordered_lines(table(spark, d, "conversations"), ["conv_id"], "turn", "text")
    return c.select("conv_id", F.array_join("lines", " ").alias("body"), F.size("lines").cast("long").alias("n_lines"))


@query("token_freq", f"SELECT token, count(*) AS n FROM (SELECT unnest({WORDS_SQL.format('text')}) AS token FROM documents) GROUP BY token")
def _(spark, d):
    return C.token_frequency(table(spark, d, "documents"), words())


@query("corpus_totals", f"WITH t AS (SELECT {WORDS_SQL.format('text')} AS t FROM documents) SELECT (SELECT count(*) FROM t WHERE len(t) > 0) AS n_docs, (SELECT CAST(sum(len(t)) AS BIGINT) FROM t) AS n_tokens, (SELECT count(DISTINCT w) FROM (SELECT unnest(t) AS w FROM t)) AS n_types")
def _(spark, d):
    return C.corpus_totals(table(spark, d, "documents"), words())


@query("context_window", """WITH f AS (SELECT conv_id, turn, text, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), '|') AS context FROM conversations)
SELECT conv_id, turn, context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM f WHERE contains(text, 'the ')) WHERE rn = 1""")
def _(spark, d):
    c = table(spark, d, "conversations")
    return C.context_frames(c, "conv_id", "turn", "text", F.contains("text", F.lit("the "))).select("conv_id", "turn", F.array_join("context", "|").alias("context"))


@query("find_passages", """WITH f AS (SELECT conv_id, turn, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), '|') AS context, text FROM conversations)
SELECT conv_id, turn, context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM f WHERE contains(text, 'and')) WHERE rn = 1 ORDER BY conv_id, turn LIMIT 10""")
def _(spark, d):
    c = table(spark, d, "conversations")
    return C.find_passages(c, "conv_id", "turn", "text", F.contains("text", F.lit("and")), 10, 1).select("conv_id", "turn", F.array_join("context", "|").alias("context"))


@query("gaps_islands", """WITH f AS (SELECT user_id, ts, event_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
SELECT user_id, CAST(g AS BIGINT) AS grp, count(*) AS n FROM f GROUP BY ALL""")
def _(spark, d):
    e = C.running_id(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "view", "grp")
    return e.groupBy("user_id", F.col("grp").cast("long").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("longest_per_class", "SELECT lang, doc_id, n_chars, rnk FROM (SELECT lang, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rnk FROM documents) WHERE rnk <= 5")
def _(spark, d):
    return C.longest_per_class(table(spark, d, "documents"), "lang", "n_chars", "doc_id", 5).select("lang", "doc_id", "n_chars", "rnk")


@query("union_sources", "SELECT 'd' AS kind, doc_id AS id, lang, NULL AS role FROM documents UNION ALL SELECT 'c', conv_id, NULL, role FROM conversations")
def _(spark, d):
    a = table(spark, d, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "lang")
    b = table(spark, d, "conversations").select(F.lit("c").alias("kind"), F.col("conv_id").alias("id"), "role")
    return C.union_sources(a, b)


@query("coverage_gate", f"""WITH v AS (SELECT DISTINCT unnest({WORDS_SQL.format('text')}) AS w FROM benchmark), t AS (SELECT doc_id, unnest({WORDS_SQL.format('text')}) AS w FROM documents)
SELECT doc_id, count(*) AS n_tokens, count(v.w) AS n_known FROM t LEFT JOIN v ON t.w = v.w GROUP BY doc_id HAVING count(v.w) >= 30""")
def _(spark, d):
    v = table(spark, d, "benchmark").select(F.explode(words()).alias("word"))
    return C.vocabulary_gate(table(spark, d, "documents"), words(), v)


@query("genre_semi_join", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 10)")
def _(spark, d):
    docs = table(spark, d, "documents")
    catalogue = docs.select("doc_id", F.when(F.col("lang").isin("en", "de"), "Prayer text").otherwise("other").alias("genre"))
    return C.genres_with_enough(C.semi_by_genre(docs, catalogue), "lang").select("doc_id")


# --- anchors --------------------------------------------------------------------------

_LEMMAS = "WITH l AS (SELECT lower(o_orderpriority) AS gw, 'c' || CAST(o_custkey % 40 AS VARCHAR) AS cf, 'f' || CAST(o_orderkey % 25 AS VARCHAR) AS form FROM orders)"


def lemmas(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.lower("o_orderpriority").alias("gw"), F.concat(F.lit("c"), F.col("o_custkey") % 40).alias("cf"), F.concat(F.lit("f"), F.col("o_orderkey") % 25).alias("form"))


@query("dictionary_anchors", _LEMMAS + ", r AS (SELECT gw, unnest(list_distinct([cf, form])) AS surface, cf FROM l) SELECT surface, gw AS english, round(least(0.95, 0.5 + count(*) / 100.0), 4) AS confidence, count(*) AS frequency, array_to_string(list_sort(list(DISTINCT cf)), ',') AS lemmas FROM r GROUP BY ALL HAVING count(*) >= 5")
def _(spark, d):
    out = A.dictionary_anchors(lemmas(spark, d), keep=lambda c: F.length(c) > 2)
    return out.select("surface", "english", "confidence", "frequency", F.array_join("lemmas", ",").alias("lemmas"))


@query("attested_anchors", _LEMMAS + """, m AS (SELECT DISTINCT cf, unnest([cf, form]) AS surface FROM l), n AS (SELECT cf, gw, count(*) AS n FROM l WHERE NOT regexp_matches(gw, '[^a-z]not ') GROUP BY ALL)
SELECT surface, gw AS english, CAST(sum(n) AS BIGINT) AS frequency FROM n JOIN m USING (cf) GROUP BY ALL HAVING sum(n) >= 5""")
def _(spark, d):
    return A.attested_anchors(lemmas(spark, d)).select("surface", "english", "frequency")


@query("cooccurrence_anchors", f"""WITH p AS (SELECT u.conv_id * 1000 + u.turn AS line, list_distinct({WORDS_SQL.format('u.text')}) AS s, list_distinct(list_filter({WORDS_SQL.format('a.text')}, lambda x: x NOT IN ({', '.join(repr(w) for w in T.COOCCURRENCE_STOP_WORDS)}))) AS t FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'), q AS (SELECT * FROM p WHERE len(t) > 0), n AS (SELECT surface, count(*) AS lines FROM (SELECT unnest(s) AS surface FROM q) GROUP BY surface), b AS (SELECT surface, unnest(t) AS english, line FROM (SELECT line, unnest(s) AS surface, t FROM q)), c AS (SELECT surface, english, count(*) AS k, min(line) AS f FROM b GROUP BY ALL)
SELECT surface, english, round(k / lines, 6) AS share, lines FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY k DESC, f, english) AS rn FROM c) JOIN n USING (surface) WHERE rn = 1 AND lines >= 3 AND k / lines >= 0.3""")
def _(spark, d):
    c = table(spark, d, "conversations")
    u, a = c.where("role = 'user'").alias("u"), c.where("role = 'assistant'").alias("a")
    p = u.join(a, (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1)).select((F.col("u.conv_id") * 1000 + F.col("u.turn")).alias("line_no"), F.col("u.text").alias("s"), F.col("a.text").alias("t"))
    t = F.filter(words("t"), lambda x: ~x.isin(*T.COOCCURRENCE_STOP_WORDS))
    return A.cooccurrence_anchors(p, words("s"), t).withColumn("share", F.round("share", 6))


@query("lexicon_join_hit_rate", "SELECT count(p_partkey) AS hits, count(*) - count(p_partkey) AS misses, round(count(p_partkey) / count(*), 6) AS hit_rate FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 4 <> 0")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("cf_norm"))
    lex = table(spark, d, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("lemma_norm"), F.array("p_name").alias("glosses"))
    j = A.lexicon_join(li, lex, F.array(F.lit("none")))
    return A.hit_rate(j).withColumn("hit_rate", F.round("hit_rate", 6))


@query("merge_best_confidence", """WITH a AS (SELECT o_orderpriority AS surface, CAST(o_custkey AS VARCHAR) AS english, round(least(0.95, 0.5 + count(*) / 100.0), 4) AS c, count(*) AS f, 0 AS s FROM orders GROUP BY ALL UNION ALL SELECT o_orderpriority, CAST(o_custkey % 9 AS VARCHAR), round(least(0.95, 0.5 + count(*) / 100.0), 4), count(*), 1 FROM orders GROUP BY ALL)
SELECT surface, english, c AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY c DESC, s, f DESC, english) AS rn FROM a) WHERE rn = 1""")
def _(spark, d):
    o = table(spark, d, "orders")
    part = lambda e: o.groupBy(F.col("o_orderpriority").alias("surface"), e.cast("string").alias("english")).agg(F.count(F.lit(1)).alias("frequency")).withColumn("confidence", A.confidence(F.col("frequency")))
    return A.merge_anchors([part(F.col("o_custkey")), part(F.col("o_custkey") % 9)]).select("surface", "english", "confidence")


@query("monosemous_pairs", "WITH a AS (SELECT c_custkey AS ord, 'n' || c_nationkey AS surface, CAST(c_custkey % 3 AS VARCHAR) AS english FROM customer WHERE c_custkey % 10 <> 0 OR c_nationkey < 5) SELECT surface, any_value(english) AS english, min(ord) AS ord FROM a GROUP BY surface HAVING count(DISTINCT english) = 1")
def _(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 10 <> 0 OR c_nationkey < 5")
    return A.monosemous_pairs(c.select(F.col("c_custkey").alias("ord"), F.concat(F.lit("n"), "c_nationkey").alias("surface"), (F.col("c_custkey") % 3).cast("string").alias("english")))


@query("training_gather", "SELECT c_custkey AS ord, CAST(a.vec_id AS VARCHAR) AS surface, CAST(b.vec_id AS VARCHAR) AS english, round(CAST(a.embedding[1] AS DOUBLE), 6) AS x0, round(CAST(b.embedding[1] AS DOUBLE), 6) AS y0 FROM customer JOIN embeddings a ON a.vec_id = c_custkey AND a.vec_id % 2 = 0 JOIN embeddings b ON b.vec_id = c_custkey % 97 AND b.vec_id % 3 > 0")
def _(spark, d):
    e = space(spark, d).select(F.col("vec_id").alias("row_idx"), F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"))
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("surface"), (F.col("c_custkey") % 97).cast("string").alias("english"))
    g = A.gather_training(a, e.where("row_idx % 2 = 0"), e.where("row_idx % 3 > 0"))
    return g.select("ord", "surface", "english", F.round(F.col("x")[0].cast("double"), 6).alias("x0"), F.round(F.col("y")[0].cast("double"), 6).alias("y0"))


@query("translation_coalesce", "WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS k, max_by(text, turn) AS text FROM conversations GROUP BY 1) SELECT d.doc_id, coalesce(a.text, b.text) AS translation FROM documents d LEFT JOIN t a ON a.k = CAST(d.doc_id * 2 AS VARCHAR) LEFT JOIN t b ON b.k = CAST(d.doc_id AS VARCHAR)")
def _(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("ord"), "text")
    x = table(spark, d, "documents").select("doc_id", (F.col("doc_id") * 2).cast("string").alias("corresp"), F.col("doc_id").cast("string").alias("line_id"))
    return A.match_translations(x, t).select("doc_id", "translation")


@query("dedup_collisions", "SELECT DISTINCT p_brand AS surface FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 45)")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("surface"), "p_size")
    return A.dedup_collisions(p, p.where("p_size > 45"))


@query("confidence_from_count", "SELECT l_partkey AS surface, count(*) AS n, round(least(0.95, 0.5 + count(*) / 100.0), 4) AS confidence FROM lineitem GROUP BY l_partkey HAVING count(*) >= 5")
def _(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("surface")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return n.withColumn("confidence", A.confidence(F.col("n")))


@query("heterogram_counts", "WITH x AS (SELECT 'sumerogram' AS kind, l_linestatus AS sign FROM lineitem UNION ALL SELECT 'akkadogram', l_returnflag FROM lineitem) SELECT kind, sign, count(*) AS n FROM x GROUP BY ALL")
def _(spark, d):
    li = table(spark, d, "lineitem")
    return A.heterogram_counts(li.select(F.array("l_linestatus").alias("sumerograms"), F.array("l_returnflag").alias("akkadograms")))


# --- graph ----------------------------------------------------------------------------


@query(
    "connected_components",
    """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT 'c' || o_custkey AS a, 'd' || CAST(o_orderdate AS DATE) AS b FROM orders), u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, component) USING KEY (node) AS (
  SELECT DISTINCT a, a FROM u
  UNION
  SELECT u.b, min(r.component) FROM r JOIN u ON r.node = u.a JOIN recurring.r AS o ON o.node = u.b WHERE r.component < o.component GROUP BY u.b
)
SELECT node, component FROM r""",
)
def _(spark, d):
    e = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("d"), F.col("o_orderdate").cast("date").cast("string")).alias("dst"))
    return G.connected_components(e)


@query("group_split")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("s"), F.col("p_partkey") % 300).alias("surface"), F.col("p_brand").alias("english"), F.array(F.concat(F.lit("l"), F.col("p_partkey") % 150)).alias("lemmas"))
    return G.group_split(G.anchor_groups(p, near_surfaces=False)).select("ord", "grp", "part")


# --- vectors --------------------------------------------------------------------------

_NN_SQL = f"WITH {UNIT_SQL}, s AS (SELECT a.vec_id AS q, b.vec_id AS c, list_dot_product(a.v, b.v) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id), r AS (SELECT q, c, score, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, c) AS INTEGER) AS rnk FROM s)"


@query("cosine_topk", f"{_NN_SQL} SELECT q, c, round(score, 6) AS score, rnk FROM r WHERE rnk <= 10")
def _(spark, d):
    return N.neighbour_table(space(spark, d), 10).withColumn("score", F.round("score", 6))


@query("csls_topk", f"""WITH {UNIT_SQL}, qs AS (SELECT * FROM u WHERE vec_id % 100 = 0), s AS (SELECT a.vec_id AS q, b.vec_id AS c, list_dot_product(a.v, b.v) AS x FROM qs a, u b), rr AS (SELECT c, avg(x) AS r FROM (SELECT c, x, row_number() OVER (PARTITION BY c ORDER BY round(x, 12) DESC, q) AS k FROM s) WHERE k <= 10 GROUP BY c), z AS (SELECT q, s.c, 2 * x - r AS score FROM s JOIN rr ON s.c = rr.c)
SELECT q, c, round(score, 6) AS score, rnk FROM (SELECT q, c, score, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, c) AS INTEGER) AS rnk FROM z) WHERE rnk <= 5""")
def _(spark, d):
    e = space(spark, d)
    q = e.where("vec_id % 100 = 0")
    return N.csls_topk(q, e, q, top=5).withColumn("score", F.round("score", 6))


def _lookup(spark, d):
    from ..operators.lookup import Lookup

    e = space(spark, d).select(F.col("vec_id").alias("row_idx"), F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec"))
    return Lookup({"gemma": e}, {"gemma": e})


_TOP_SQL = "SELECT 'w' || vec_id AS word, round(list_dot_product(v, q), 6) AS sim FROM u, b ORDER BY list_dot_product(v, q) DESC, vec_id DESC LIMIT 10"


@query("lookup_find", f"WITH {UNIT_SQL}, b AS (SELECT v AS q FROM u WHERE vec_id = 7) {_TOP_SQL}")
def _(spark, d):
    k = _lookup(spark, d)
    return k.top(k.vectors(["w7"], "gemma")["w7"], 10, "gemma").select("word", F.round("sim", 6).alias("sim"))


@query("analogy", f"WITH {UNIT_SQL}, z AS (SELECT list_transform(range(1, len(a.v) + 1), lambda i: c.v[i] - a.v[i] + b.v[i]) AS z FROM u a, u b, u c WHERE a.vec_id = 1 AND b.vec_id = 2 AND c.vec_id = 3), b AS (SELECT list_transform(z, lambda x: x / sqrt(list_dot_product(z, z))) AS q FROM z) {_TOP_SQL}")
def _(spark, d):
    got = _lookup(spark, d).find_analogy("w1", "w2", "w3")
    return spark.createDataFrame([(w, round(s, 6)) for w, s in got], "word string, sim double")


@query("blend", f"WITH {UNIT_SQL}, z AS (SELECT list_transform(range(1, len(a.v) + 1), lambda i: 0.7 * a.v[i] + 0.3 * b.v[i]) AS z FROM u a, u b WHERE a.vec_id = 4 AND b.vec_id = 5), b AS (SELECT list_transform(z, lambda x: x / sqrt(list_dot_product(z, z))) AS q FROM z) {_TOP_SQL}")
def _(spark, d):
    got = _lookup(spark, d).find_blend({"w4": 0.7, "w5": 0.3})
    return spark.createDataFrame([(w, round(s, 6)) for w, s in got], "word string, sim double")


@query("reverse_query", f"{_NN_SQL} SELECT c AS source, rnk AS k FROM r WHERE q = 9 AND rnk <= 10")
def _(spark, d):
    got = _lookup(spark, d).reverse_query(["w9"], k_source=11)["w9"]["source"]
    return spark.createDataFrame([(int(w[1:]), i) for i, (w, _) in enumerate(got) if w != "w9"], "source long, k int")


@query("kth_neighbor_isolation", f"{_NN_SQL} SELECT q AS vec, round(1 - score, 6) AS dist FROM r WHERE rnk = 10")
def _(spark, d):
    return N.kth_distance(N.neighbour_table(space(spark, d), 10), 10).withColumn("dist", F.round("dist", 6))


def _half(spark, d, low: bool) -> DataFrame:
    return space(spark, d).withColumn("embedding", F.slice("embedding", 1 if low else 33, 32))


def _half_sql(name: str, cut: str) -> str:
    return f"{name}u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]){cut} AS v FROM embeddings)), {name}n AS (SELECT q, list(c) AS cs FROM (SELECT a.vec_id AS q, b.vec_id AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 12) DESC, b.vec_id) AS k FROM {name}u a JOIN {name}u b ON a.vec_id <> b.vec_id) WHERE k <= 10 GROUP BY q)"


@query("neighbor_jaccard", f"WITH {_half_sql('a', '[1:32]')}, {_half_sql('b', '[33:64]')} SELECT an.q AS vec, round(1 - len(list_intersect(an.cs, bn.cs)) / len(list_distinct(list_concat(an.cs, bn.cs))), 6) AS dist FROM an JOIN bn ON an.q = bn.q")
def _(spark, d):
    return atlas.divergence(N.neighbour_table(_half(spark, d, True)), N.neighbour_table(_half(spark, d, False)), None).withColumn("dist", F.round("dist", 6))


@query("doppelganger_pairs", f"WITH {UNIT_SQL} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS sim FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.5")
def _(spark, d):
    return N.similar_pairs(space(spark, d), 0.5).withColumn("sim", F.round("sim", 6))


@query("similarity_histogram", f"{_NN_SQL}, k AS (SELECT 1 - score AS dist FROM r WHERE rnk = 10), h AS (SELECT CAST(CASE WHEN dist = 2 THEN 19 ELSE floor((dist - 0.0) / 2.0 * 20) END AS INTEGER) AS bin, count(*) AS n FROM k WHERE dist BETWEEN 0 AND 2 GROUP BY 1) SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(20) t(b) LEFT JOIN h ON h.bin = b")
def _(spark, d):
    return atlas.isolation_histogram(N.neighbour_table(space(spark, d), 10))


@query("pairwise_matrix", f"WITH {UNIT_SQL} SELECT a.vec_id AS i, b.vec_id AS j, round(1 - greatest(-1, least(1, list_dot_product(a.v, b.v))), 6) AS dist FROM u a, u b WHERE a.vec_id < 20 AND b.vec_id < 20")
def _(spark, d):
    return N.pairwise(space(spark, d), list(range(20))).withColumn("dist", F.round("dist", 6))


@query("axis_projection", f"WITH {UNIT_SQL}, p AS (SELECT vec_id IN (0, 1, 2) AS lo, i, avg(v[i]) AS m FROM (SELECT vec_id, v, unnest(range(1, 65)) AS i FROM u WHERE vec_id < 6) GROUP BY ALL), n AS (SELECT lo, sqrt(sum(m * m)) AS n FROM p GROUP BY lo), x AS (SELECT i, sum(CASE WHEN p.lo THEN -m / n ELSE m / n END) AS x FROM p JOIN n ON p.lo = n.lo GROUP BY i) SELECT 'w' || vec_id AS word, round(sum(v[i] * x), 6) AS value FROM u, x GROUP BY vec_id")
def _(spark, d):
    e = space(spark, d).select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec"))
    return DOC.axis_projection(e, ["w0", "w1", "w2"], ["w3", "w4", "w5"]).withColumn("value", F.round("value", 6))


# --- linear ---------------------------------------------------------------------------


def _pairs(spark, d) -> DataFrame:
    return space(spark, d).select("vec_id", F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("y"))


def _matrix(spark, m, name: str = "value") -> DataFrame:
    return spark.createDataFrame([(i, j, round(float(v), 6)) for i, row in enumerate(m) for j, v in enumerate(row)], f"i int, j int, {name} double")


@query("gram_matrix", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:32] AS v FROM embeddings), x AS (SELECT vec_id, unnest(range(0, 32)) AS i, unnest(v) AS x FROM e) SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.x * b.x), 6) AS value FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY a.i, b.i")
def _(spark, d):
    return _matrix(spark, L.gram(_pairs(spark, d)).xx)


@query("whiten_stats", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:32] AS v FROM embeddings), x AS (SELECT vec_id, unnest(range(0, 32)) AS i, unnest(v) AS x FROM e) SELECT CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean, 1.0::DOUBLE AS var FROM x GROUP BY i")
def _(spark, d):
    mean, w = L.whitening(L.gram(_pairs(spark, d)))
    out = L.project(_pairs(spark, d), "x", w, -mean @ w, "z")
    z = out.select(F.posexplode("z").alias("i", "z")).groupBy("i").agg(F.round(F.var_samp("z"), 6).alias("var"))
    m = spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(mean)], "i int, mean double")
    return m.join(z, "i")


@query("ridge_fit")
def _(spark, d):
    return _matrix(spark, L.ridge(L.gram(_pairs(spark, d)), 1.0)[0])


@query("alpha_select")
def _(spark, d):
    p = _pairs(spark, d)
    g, val = L.gram(p.where("vec_id % 5 > 0")), p.where("vec_id % 5 = 0")
    c = space(spark, d).select(F.col("vec_id").alias("row_idx"), F.col("vec_id").cast("string").alias("word"), F.slice("embedding", 33, 32).alias("vec"))
    n, scores = val.count(), {}
    for a, (coef, b) in L.ridge_path(g, (1e-2, 1.0, 100.0)).items():
        q = L.project(val, "x", coef.T, b, "vec").select(F.col("vec_id").alias("q_id"), F.col("vec_id").cast("string").alias("gold"), "vec")
        scores[a] = E.val_topk(q, c, 5)
    best = L.select_alpha(scores, n)
    return spark.createDataFrame([(a, s, a == best) for a, s in scores.items()], "alpha double, top5 double, chosen boolean")


@query("procrustes_cosine")
def _(spark, d):
    p = _pairs(spark, d)
    got = L.fit_procrustes(p.where("vec_id % 5 > 0"), p.where("vec_id % 5 = 0"))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in got["val_cosine"].items()], "variant string, val_cosine double")


@query("pca_project")
def _(spark, d):
    mean, comp, _ = L.pca(L.gram(_pairs(spark, d)), 4)
    return L.project(_pairs(spark, d), "x", comp.T, -mean @ comp.T, "z").select("vec_id", F.transform("z", lambda x: F.round(x, 6)).alias("z"))


@query("pad_vectors", "SELECT vec_id, len(embedding) + 3 AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def _(spark, d):
    return space(spark, d).select("vec_id", V.padded(V.doubles(F.col("embedding")), 3).alias("v")).select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# --- evaluation -----------------------------------------------------------------------


@query("stratify", "SELECT doc_id, CASE WHEN source IN (SELECT source FROM documents WHERE doc_id % 40 = 0) THEN 'interpolation' ELSE 'zero_shot' END AS stratum FROM documents WHERE doc_id % 2 = 1")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("gold"))
    return E.stratify(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 40 = 0")).select("doc_id", "stratum")


@query("stratified_accuracy", f"""{_NN_SQL}, p AS (SELECT r.q, a.label, max(CASE WHEN b.label = a.label THEN 1 ELSE 0 END) FILTER (rnk <= 1) AS h1, max(CASE WHEN b.label = a.label THEN 1 ELSE 0 END) FILTER (rnk <= 5) AS h5 FROM r JOIN u a ON a.vec_id = q JOIN u b ON b.vec_id = c WHERE rnk <= 5 GROUP BY ALL)
SELECT CAST(label AS INTEGER) AS label, round(100.0 * avg(h1), 6) AS top1, round(100.0 * avg(h5), 6) AS top5, count(*) AS n FROM p GROUP BY label""")
def _(spark, d):
    e = space(spark, d)
    lab = e.select("vec_id", "label")
    nn = N.neighbour_table(e, 5).join(lab.select(F.col("vec_id").alias("q"), "label"), "q").join(lab.select(F.col("vec_id").alias("c"), F.col("label").alias("l2")), "c")
    first = nn.groupBy("q", "label").agg(F.min(F.when(F.col("l2") == F.col("label"), F.col("rnk"))).alias("k"))
    rate = lambda k: F.round(100 * F.avg(F.coalesce(F.col("k") <= k, F.lit(False)).cast("double")), 6)
    return first.groupBy("label").agg(rate(1).alias("top1"), rate(5).alias("top5"), F.count(F.lit(1)).alias("n")).withColumn("label", F.col("label").cast("int"))


@query("rank_in_pool", "WITH t AS (SELECT o_custkey AS q, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT a.q, 1 + count(*) FILTER (b.o_totalprice > a.o_totalprice) AS rnk FROM t a JOIN t b ON a.q = b.q WHERE a.k = 1 GROUP BY a.q")
def _(spark, d):
    return _ranked_orders(spark, d)


def _ranked_orders(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("q"), F.col("o_totalprice").alias("score"), (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) == 1).alias("aim"))
    return S.rank_in_pool(o, "q", "score", "aim")


@query("mrr", "WITH t AS (SELECT o_custkey AS q, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), r AS (SELECT a.q, 1 + count(*) FILTER (b.o_totalprice > a.o_totalprice) AS rnk FROM t a JOIN t b ON a.q = b.q WHERE a.k = 1 GROUP BY a.q) SELECT round(avg(1.0 / rnk), 4) AS mrr FROM r")
def _(spark, d):
    return S.mean_reciprocal_rank(_ranked_orders(spark, d))


# --- documents and studies ------------------------------------------------------------


@query("sif_weights", f"WITH f AS (SELECT token, count(*) AS n FROM (SELECT unnest({WORDS_SQL.format('text')}) AS token FROM documents) GROUP BY token) SELECT token, n, round(0.001 / (0.001 + n / (SELECT sum(n) FROM f)), 9) AS w FROM f")
def _(spark, d):
    return DOC.sif_weights(C.token_frequency(table(spark, d, "documents"), words())).withColumn("w", F.round("w", 9))


@query("doc_centroid", """WITH w AS (SELECT CAST(vec_id AS VARCHAR) AS word, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), t AS (SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS token FROM lineitem), x AS (SELECT doc_id, unnest(range(1, 65)) AS i, v FROM t JOIN w ON token = word), m AS (SELECT doc_id, i, avg(v[i]) AS m FROM x GROUP BY ALL)
SELECT doc_id, round(sqrt(sum(m * m)), 6) AS len, round(max(m), 6) AS top FROM m GROUP BY doc_id""")
def _(spark, d):
    docs = C.ordered_lines(table(spark, d, "lineitem").withColumn("t", F.col("l_partkey").cast("string")), [F.col("l_orderkey").alias("doc_id")], "l_linenumber", "t", "tokens")
    sp = space(spark, d).select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"))
    return DOC.doc_centroids(docs, F.col("tokens"), sp).select("doc_id", F.round(V.norm(F.col("mean")), 6).alias("len"), F.round(F.array_max("mean"), 6).alias("top"))


@query("loo_nearest_centroid", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT label AS cls, count(*) AS n FROM e GROUP BY label), x AS (SELECT label, unnest(range(1, 65)) AS i, v FROM e), s AS (SELECT label AS cls, list(s ORDER BY i) AS s FROM (SELECT label, i, sum(v[i]) AS s FROM x GROUP BY ALL) GROUP BY label), p AS (SELECT vec_id, label, cls, v, CASE WHEN label = cls THEN list_transform(range(1, 65), lambda i: s[i] - v[i]) ELSE s END AS m FROM e, s JOIN n USING (cls)), c AS (SELECT vec_id, label, cls, list_dot_product(v, m) / sqrt(list_dot_product(v, v) * list_dot_product(m, m)) AS sim FROM p)
SELECT vec_id AS doc, label, arg_max(cls, (round(sim, 12), -cls)) AS predicted FROM c GROUP BY ALL""")
def _(spark, d):
    return DOC.loo_nearest_centroid(space(spark, d), "label", "embedding", "vec_id")


@query("spearman_avg_rank", """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT l_returnflag, round(corr(a, b), 6) AS rho FROM r GROUP BY l_returnflag""")
def _(spark, d):
    return S.spearman_by(table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y")), "x", "y", ["l_returnflag"]).withColumn("rho", F.round("rho", 6))


@query("midrank_percentile", "SELECT round(100.0 * (count(*) FILTER (l_quantity < 25) + 0.5 * count(*) FILTER (l_quantity = 25)) / count(*), 6) AS percentile FROM lineitem")
def _(spark, d):
    return S.midrank_percentile(table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x")), "x", 25.0).withColumn("percentile", F.round("percentile", 6))


@query("rank_delta", """WITH c AS (SELECT o_custkey AS k, count(*) AS n, CAST(sum(o_totalprice) AS DOUBLE) AS t FROM orders GROUP BY o_custkey), r AS (SELECT k, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS a, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS b FROM c) SELECT k, CAST(b - a AS DOUBLE) AS delta FROM r ORDER BY abs(b - a) DESC, k LIMIT 5""")
def _(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").cast("double").alias("t"))
    return S.rank_deltas(c, "n", "t", ["k"]).select("k", "delta")


@query("theme_similarities", f"""WITH {UNIT_SQL}, x AS (SELECT label, unnest(range(1, 65)) AS i, v FROM u), c AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(v[i]) AS m FROM x GROUP BY ALL) GROUP BY label) SELECT a.label AS i, b.label AS j, round(list_dot_product(a.m, b.m) / sqrt(list_dot_product(a.m, a.m) * list_dot_product(b.m, b.m)), 6) AS sim FROM c a JOIN c b ON a.label < b.label""")
def _(spark, d):
    m = N.mean_vector(space(spark, d).withColumn("u", V.unit(V.doubles(F.col("embedding")))), ["label"], "u")
    return S.theme_similarities(m, "label").withColumn("sim", F.round("sim", 6))


@query("rsa_permutation")
def _(spark, d):
    import numpy as np

    def sims(e):
        m = {r["label"]: np.array(r["mean"]) for r in N.mean_vector(e, ["label"], "embedding").collect()}
        v = np.stack([m[k] / np.linalg.norm(m[k]) for k in sorted(m)])
        return v @ v.T

    got = S.rsa_permutation(sims(_half(spark, d, True)), sims(_half(spark, d, False)))
    return spark.createDataFrame([(got["rho"], got["n_perms"], got["p"])], "rho double, n_perms int, p double")


# --- diagnostics ----------------------------------------------------------------------


def _audit(spark, d) -> DataFrame:
    n = table(spark, d, "part").select(F.concat(F.lit("s"), F.col("p_partkey") % 700).alias("surface"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("english"), (F.col("p_size") / 50).alias("confidence"))
    w = lambda df, c: df.select(c.alias("word"))
    v = w(table(spark, d, "supplier"), F.concat(F.lit("s"), F.col("s_suppkey") * 3))
    return D.classify_anchors(n, v.unionByName(w(spark.range(0, 700, 2), F.concat(F.lit("s"), "id"))), w(n.where("substring(english, 1, 1) < 'm'"), F.col("english")), w(n.where("length(english) <= 5"), F.col("english")))


_AUDIT = """WITH n AS (SELECT 's' || (p_partkey % 700) AS surface, lower(split_part(p_name, ' ', 1)) AS english, p_size / 50 AS confidence FROM part), v AS (SELECT 's' || (s_suppkey * 3) AS w FROM supplier UNION SELECT 's' || i FROM range(0, 700, 2) t(i)), f AS (SELECT *, surface IN (SELECT w FROM v) AS in_vocab, english < 'm' AS in_glove, length(english) <= 5 AS in_gemma FROM n), b AS (SELECT *, CASE WHEN confidence < 0.3 THEN 'low_confidence' WHEN NOT in_vocab THEN 'vocab_miss' WHEN NOT in_glove AND NOT in_gemma THEN 'both_miss' WHEN NOT in_glove THEN 'glove_miss' WHEN NOT in_gemma THEN 'gemma_miss' ELSE 'survives' END AS bucket FROM f)"""


@query("priority_buckets", _AUDIT + f", k AS (SELECT unnest({list(D.ANCHOR_BUCKETS)!r}) AS bucket) SELECT k.bucket, count(b.surface) AS n, round(100.0 * count(b.surface) / (SELECT count(*) FROM b), 6) AS pct FROM k LEFT JOIN b ON k.bucket = b.bucket GROUP BY k.bucket")
def _(spark, d):
    return D.bucket_counts(_audit(spark, d)).select("bucket", "n", F.round("pct", 6).alias("pct"))


@query("venn_counts", _AUDIT + " SELECT in_glove, in_gemma, count(*) AS n FROM b GROUP BY ALL")
def _(spark, d):
    return D.venn(_audit(spark, d))


@query("threshold_sweep", "WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) SELECT CAST(t AS INTEGER) AS threshold, (SELECT count(*) FROM c WHERE n >= t AND l_partkey % 2 = 1) AS n FROM range(1, 5) x(t)")
def _(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("corpus_n")).withColumn("norm_hit", F.col("l_partkey") % 2 == 0)
    return D.threshold_sweep(c)


@query("coverage_by_language", f"WITH v AS (SELECT DISTINCT unnest({WORDS_SQL.format('text')}) AS w FROM benchmark), t AS (SELECT lang, unnest({WORDS_SQL.format('text')}) AS w FROM documents) SELECT lang, count(*) AS n_tokens, count(v.w) AS n_known, round(count(v.w) / count(*), 6) AS share FROM t LEFT JOIN v ON t.w = v.w GROUP BY lang")
def _(spark, d):
    v = table(spark, d, "benchmark").select(F.explode(words()).alias("word"))
    return D.coverage(table(spark, d, "documents").select("lang", F.explode(words()).alias("token")), v, "lang").withColumn("share", F.round("share", 6))


@query("document_hashes", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


# --- atlas ----------------------------------------------------------------------------


def _spaces(spark, d):
    e = space(spark, d)
    s = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("row_idx"), F.concat(F.lit("s"), "vec_id").alias("word"), F.col("embedding").alias("vec"))
    t = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("row_idx"), F.concat(F.lit("e"), "vec_id").alias("word"), F.col("embedding").alias("vec"))
    a = s.where("row_idx % 6 = 0").select(F.col("word").alias("surface"), F.concat(F.lit("E"), F.col("row_idx") + 1).alias("english"), F.lit(0.9).alias("confidence"))
    f = s.select(F.col("word").alias("token"), (F.col("row_idx") % 11).alias("n"))
    return s, t, a, f


@query("lens1_displacement", f"WITH {UNIT_SQL} SELECT 's' || a.vec_id AS surface, 'e' || b.vec_id AS english, round(list_dot_product(a.v, b.v), 6) AS sim FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 6 = 0 ORDER BY list_dot_product(a.v, b.v), surface LIMIT 50")
def _(spark, d):
    s, t, a, _ = _spaces(spark, d)
    return atlas.english_displacement(a, s, t).select("surface", "english", F.round("sim", 6).alias("sim"))


@query("lens2_no_counterpart", f"WITH {UNIT_SQL}, b AS (SELECT a.vec_id, max(list_dot_product(a.v, b.v)) AS sim FROM u a, u b WHERE a.vec_id % 2 = 0 AND a.vec_id % 6 <> 0 AND b.vec_id % 2 = 1 GROUP BY a.vec_id) SELECT 's' || vec_id AS word, vec_id % 11 AS n, round(sim, 6) AS sim, round((vec_id % 11) * (1 - sim), 6) AS value FROM b ORDER BY (vec_id % 11) * (1 - sim) DESC, word LIMIT 50")
def _(spark, d):
    s, t, a, f = _spaces(spark, d)
    return atlas.no_counterpart(s, t, a, f).select("word", "n", F.round("sim", 6).alias("sim"), F.round("value", 6).alias("value"))


@query("lens3_isolation", f"{_NN_SQL}, n AS (SELECT q, array_to_string(list(c ORDER BY rnk), ',') AS nearest FROM r WHERE rnk <= 5 GROUP BY q) SELECT r.q AS vec, round(1 - score, 6) AS dist, nearest FROM r JOIN n ON r.q = n.q WHERE rnk = 10 ORDER BY 1 - score DESC, vec LIMIT 50")
def _(spark, d):
    return atlas.isolation(N.neighbour_table(space(spark, d), 10)).select("vec", F.round("dist", 6).alias("dist"), F.array_join("nearest", ",").alias("nearest"))


@query("lens5_doppelgangers", f"WITH {UNIT_SQL} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS sim FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.3 ORDER BY list_dot_product(a.v, b.v) DESC, a, b LIMIT 50")
def _(spark, d):
    return atlas.doppelgangers(space(spark, d), 0.3).withColumn("sim", F.round("sim", 6))


@query("lens6_bridges_fixed", f"WITH {UNIT_SQL}, x AS (SELECT label, unnest(range(1, 65)) AS i, v FROM u), c AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(v[i]) AS m FROM x GROUP BY ALL) GROUP BY label), s AS (SELECT vec_id, c.label, sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))) AS d FROM u, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS k FROM s) SELECT vec_id AS vec, max(label) FILTER (k = 1) AS cluster, round(max(d) FILTER (k = 1) / max(d) FILTER (k = 2), 6) AS value FROM r WHERE k <= 2 GROUP BY vec_id")
def _(spark, d):
    e = space(spark, d)
    c = N.mean_vector(e.withColumn("u", V.unit(V.doubles(F.col("embedding")))), ["label"], "u").withColumnRenamed("label", "cluster")
    return atlas.bridges(e, c, None).select("vec", "cluster", F.round("value", 6).alias("value"))


@query("lens6_bridges_kmeans")
def _(spark, d):
    e = space(spark, d)
    return atlas.bridges(e, atlas.kmeans_centroids(e, 10, restarts=2))


# --- sources --------------------------------------------------------------------------


@query("events_props_json", "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS n_k, min(json_extract_string(props, '$.k')) AS low FROM events GROUP BY event_type")
def _(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("n_k"), F.min("k").alias("low"))


@query(
    "xml_lines",
    """WITH l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS ls FROM documents))
SELECT doc_id, 'c.' || doc_id || '.' || (i - 1) AS line_id, array_to_string(regexp_extract_all(ls[i], '[a-z]+'), ' ') AS line FROM l WHERE regexp_matches(ls[i], '[a-z]')""",
)
def _(spark, d):
    form = lambda w: F.concat(F.lit('<w form="'), w, F.lit('"/>'))
    forms = lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit("[a-z]+"), F.lit(0)), form), " ")
    lines = F.transform(F.split(F.lower("text"), "\n"), lambda x, i: F.concat(F.lit('<l id="c.'), F.col("doc_id").cast("string"), F.lit("."), i.cast("string"), F.lit('">'), forms(x), F.lit("</l>")))
    xml = F.concat(F.lit('<TEI xmlns="urn:x"><text>'), F.array_join(lines, "\n"), F.lit("</text></TEI>"))
    got = markup.scan(table(spark, d, "documents").select("doc_id", xml.alias("xml")), markup.TeiLines, "xml", ["doc_id"])
    return got.select("doc_id", "line_id", F.col("text").alias("line"))


@query("atf_parse", "SELECT 'P' || lpad(CAST(conv_id AS VARCHAR), 6, '0') AS p_number, count(*) AS n_lines, string_agg(replace(text, chr(10), ' '), '|' ORDER BY turn) AS body FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id")
def _(spark, d):
    c = table(spark, d, "conversations").withColumn("line", F.concat(F.col("turn") + 1, F.lit(". "), F.replace("text", F.lit("\n"), F.lit(" "))))
    docs = C.ordered_lines(c, ["conv_id"], "turn", "line")
    head = F.concat(F.lit("&P"), F.lpad(F.col("conv_id").cast("string"), 6, "0"), F.lit(" = text\n#atf: lang "), F.when(F.col("conv_id") % 3 == 0, "sux").otherwise("akk"), F.lit("\n@tablet\n"))
    got = records.parse_atf(docs.select(F.concat(head, F.array_join("lines", "\n")).alias("text")))
    return got.select("p_number", F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", "|").alias("body"))


@query("cdl_walk", f"SELECT doc_id, count(*) AS n_leaves FROM (SELECT doc_id, unnest({WORDS_SQL.format('text')}) AS w FROM documents) GROUP BY doc_id")
def _(spark, d):
    leaves = F.transform(words(), lambda w: F.struct(F.struct(F.lit("sux").alias("lang"), w.alias("form")).alias("f")))
    docs = table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.lit("line-start").alias("type"), F.array(F.struct(leaves.alias("cdl"))).alias("cdl"))).alias("js"))
    return records.cdl_lemmas(records.walk_cdl(docs, "js", "doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_leaves"))


@query("conllu_parse", f"SELECT doc_id AS doc, count(*) AS n FROM (SELECT doc_id, unnest({WORDS_SQL.format('text')}) AS w FROM documents) GROUP BY doc_id")
def _(spark, d):
    rows = F.transform(words(), lambda w, i: F.concat_ws("\t", (i + 1).cast("string"), w, w, F.lit("NOUN"), F.lit("_"), F.lit("_"), F.lit("0"), F.lit("_"), F.lit("_"), F.lit("_")))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.concat(F.lit("## text: x\n# c\n"), F.array_join(rows, "\n"), F.lit("\n\nbad\trow")).alias("text"))
    return records.parse_conllu(docs)[0].groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


# --- models and streams ---------------------------------------------------------------


@query("word2vec_neighbors")
def _(spark, d):
    from ..operators.models import train_skipgram

    sp = train_skipgram(table(spark, d, "documents").where("lang = 'en'"), words(), dim=16, window=5, min_count=10, epochs=1, partitions=2)
    return N.neighbour_table(sp.select(F.col("row_idx").alias("vec_id"), F.col("vec").alias("embedding")), 5)


@query("stream_token_counts", "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY token")
def _(spark, d):
    import uuid

    from ..runtime import scratch
    from ..streaming import ingest

    batch = table(spark, d, "documents")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(_stream_folder(spark, batch))
    return ingest.run_available(ingest.token_counts(stream, words()), f"{scratch(spark)}/tessera-counts-{uuid.uuid4().hex[:8]}")


def _stream_folder(spark, batch: DataFrame) -> str:
    """The documents as a folder of files of their own, since a stream reads all tables that lie in one folder."""
    import uuid

    from ..runtime import scratch

    path = f"{scratch(spark)}/tessera-stream-{uuid.uuid4().hex[:8]}"
    batch.write.parquet(path)
    return path
