"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import UPPER, LOWER, Stages, ascii_lower

#: Between the words of this operator: every ASCII character but digits and small letters.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: The base phrases, and notices as license holders word them.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
    ),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or "
        "at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "bsd",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness "
        "for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
        "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable "
        "for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
        "arising out of or in connection with the use or performance of this software",
    ),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
]
THRESHOLD = 0.8
#: Words of the least windows; they stand half a window apart.
LEAST = 64


def window_of(template: str) -> int:
    """Words of the windows that a template is sought in: the least power of two from LEAST on whose half is as long as it, so that a copy is whole in one of them."""
    w = LEAST
    while w // 2 < len(template.split()):
        w *= 2
    return w


def let(value: Column, fn) -> Column:
    """``fn`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(ascii_lower(text), GAP, " "), " "), lambda w: w != "")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Licenses that each text names or quotes.

    Base: places where a phrase's words stand consecutively. Beyond that, every block of the text, a window of its words wherever its lines end,
    that holds ``threshold`` of a template's distinct words
    gets the template's label; windows are of 64 words for templates of up to 32, twice that for up to 64 and so on, and overlap by half. The join is exact: template words are ordered by
    the number of texts that hold them, counted over all; a block is a candidate if it
    holds one of the template's |T| - t + 1 rarest words (prefix), at least t of all template
    words (length), and if the words before and after a shared one can still add up to t
    (position); candidates are counted in full. The templates are a fixed list. GNU's lesser and affero notices, which
    have nearly all words of the general one, get its label.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: 1 if there is a base
    phrase, else the largest containment of a template that was met, else 0. Null texts
    are empty; repeated rows give equal rows; an empty table an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sets = [(label, window_of(text), sorted(set(text.split()))) for label, text in templates]
    vocabulary = sorted({w for _, _, t in sets for w in t})
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), words_of(F.col("text")).alias("words"))
    count = {r["w"]: r["n"] for r in texts.select(F.explode(F.array_intersect("words", strings(vocabulary))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}

    prefixes, rare = [], set()
    for label, width, t in sets:
        ranks, need = sorted(order[w] for w in t), math.ceil(threshold * len(t) - 1e-9)
        for at, r in enumerate(ranks[: len(ranks) - need + 1]):
            prefixes.append((label, width, r, at, len(ranks), need, ranks))
            rare.add(r)
    # tables of the templates' words and window widths
    table = spark.createDataFrame(prefixes, "label string, width int, rnk int, i int, n int, need int, ranks array<int>")
    ranked = spark.createDataFrame(list(order.items()), "word string, rnk int")
    widths = F.array(*[F.lit(w) for w in sorted({w for _, w, _ in sets})])
    by_rank = sorted(order, key=order.get)

    held = (
        texts.where(F.arrays_overlap("words", strings([by_rank[r] for r in sorted(rare)])))
        .select("doc_id", "rk", F.size("words").alias("size"), F.posexplode("words").alias("at", "word"))
        .join(F.broadcast(ranked), "word")
        .select("doc_id", "rk", "size", "at", "rnk", F.explode(widths).alias("width"))
        .withColumn("k", F.floor(F.col("at") / (F.col("width") / 2)))
        # the windows that a word is in, but no window that begins where the one before it has reached the end of the text
        .select("doc_id", "rk", "width", "rnk", "size", F.explode(F.array("k", F.col("k") - 1)).alias("k"))
        .where("k = 0 OR k > 0 AND (k + 1) * (width / 2) < size")
        .groupBy("doc_id", "rk", "width", "k")
        .agg(F.sort_array(F.collect_set("rnk")).alias("held"))
    )
    candidates = (
        held.select("doc_id", "rk", "width", "held", F.posexplode("held").alias("j", "rnk"))
        .join(F.broadcast(table), ["rnk", "width"])
        .where("size(held) >= need AND least(i, j) + 1 + least(n - 1 - i, size(held) - 1 - j) >= need")
    )
    met = (
        candidates.withColumn("both", F.size(F.array_intersect("held", "ranks")))
        .where("both >= need")
        .groupBy("doc_id", "rk")
        .agg(F.max(F.col("both") / F.col("n")).alias("best"), F.collect_set("label").alias("met"))
    )

    starts = lambda ws: F.filter(
        F.transform(
            ws,
            lambda w, i: F.when(
                w == "license",
                F.when(F.get(ws, i - 1) == "mit", F.struct((i - 1).alias("at"), F.lit("mit").alias("label")))
                .when(F.get(ws, i - 1) == "apache", F.struct((i - 1).alias("at"), F.lit("apache").alias("label")))
                .when((F.get(ws, i - 1) == "public") & (F.get(ws, i - 2) == "general"), F.struct((i - 2).alias("at"), F.lit("gpl").alias("label"))),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    clean = F.trim(F.regexp_replace(F.translate("text", UPPER, LOWER), GAP, " "))
    spaces = F.length("clean") - F.length(F.replace("clean", F.lit(" "), F.lit("")))
    base = (
        docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), clean.alias("clean"))
        .withColumn("places", F.when(F.contains("clean", F.lit("license")), let(F.split("clean", " "), starts)))
        .select(
            "doc_id",
            "rk",
            F.when(F.col("clean") == "", 0).otherwise(spaces + 1).cast("long").alias("n_words"),
            F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_base"),
            F.array_min("places.at").cast("long").alias("first_word"),
            F.array_max("places.at").cast("long").alias("last_word"),
            F.coalesce(F.array_sort(F.array_distinct("places.label")), F.array().cast("array<string>")).alias("base"),
        )
        .withColumn("n_base", F.greatest("n_base", F.lit(0)))
    )
    b, m = base.alias("b"), met.alias("m")
    return b.join(m, (F.col("b.rk") == F.col("m.rk")) & F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")), "left").select(
        "b.doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("met", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    from .common import documents, spread

    return scan(spread(documents(spark, sf_dir)))


def _templates_sql() -> str:
    rows = ", ".join(f"('{label}', {window_of(text)}, {sorted(set(text.split()))!r})" for label, text in TEMPLATES)
    return f"(VALUES {rows}) t(label, width, words)"


SQL = rf"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents
), w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '{GAP}'), lambda x: x <> '') AS ws FROM d
), p AS (
  SELECT doc_id, len(ws) AS n_words, unnest(range(1, len(ws) + 1)) AS i, ws FROM w
), places AS (
  SELECT doc_id, CASE WHEN ws[i - 1] = 'mit' AND i > 1 THEN 'mit' WHEN ws[i - 1] = 'apache' AND i > 1 THEN 'apache' ELSE 'gpl' END AS label,
    CASE WHEN ws[i - 1] = 'public' THEN i - 3 ELSE i - 2 END AS pos
  FROM p WHERE ws[i] = 'license' AND i > 1 AND (ws[i - 1] IN ('mit', 'apache') OR (i > 2 AND ws[i - 1] = 'public' AND ws[i - 2] = 'general'))
), base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY doc_id
), t AS (
  SELECT * FROM {_templates_sql()}
), k AS (
  SELECT doc_id, ws, width, unnest(range(0, CAST(greatest(ceil((len(ws) - width) / (width / 2.0)), 0) AS BIGINT) + 1)) AS k
  FROM w, (SELECT DISTINCT width FROM t) WHERE len(ws) > 0
), b AS (
  SELECT doc_id, width, list_distinct(ws[k * (width // 2) + 1 : k * (width // 2) + width]) AS ws FROM k
), met AS (
  SELECT doc_id, max(len(list_intersect(ws, t.words)) / CAST(len(t.words) AS DOUBLE)) AS best, list(DISTINCT label) AS labels
  FROM b JOIN t USING (width)
  WHERE len(list_intersect(ws, t.words)) >= {THRESHOLD} * len(t.words) - 1e-9
  GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(met.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base ON w.doc_id = base.doc_id LEFT JOIN met ON w.doc_id = met.doc_id
"""
