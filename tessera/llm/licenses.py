"""License scans by diagonal voting.

Every rolling word k-gram of every text is joined by hash to the positions of
that k-gram in the license templates (the words are compared too, so a hash
collision cannot vote); k is 4 for license texts and 2 for phrases of a few
words. A match votes for its diagonal, word position less template position. A
diagonal that has all of a phrase's k-grams is a place of the whole phrase;
neighbouring diagonals merge into one span, so a dropped or added word does not
break it, and a span is verified by the share of the template that it holds and
by its length. DataFrame functions only.

One row goes from each document to the shuffle, besides the few matches.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NOT_ALNUM, ascii_lower, table, words

#: Phrases that count wherever they stand whole.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Opening words of well-known licenses and notices.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "released under the bsd license"),
    ("mpl", "mozilla public license version 2 0"),
    ("epl", "eclipse public license version 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Bodies of license texts and notices.
TEXTS = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
     (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
     distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
     following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
     Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
     MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
     CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
     SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
     are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
     2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
     documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
     "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
     PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
     the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
     WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
     arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
     and to alter it and redistribute it freely, subject to the following restrictions"""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
     obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
     distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
     the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
     the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
     that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
     the GNU General Public License for more details."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
     distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
)
#: Words of a k-gram of a license text, and of a phrase of fewer than LONG words.
TEXT_GRAM, PHRASE_GRAM, LONG = 4, 2, 18
#: Share of a template's k-grams that a span must hold, by k; diagonals that
#: merge into one; and the most words of a span for a word of its template.
LEAST_SHARE, DIAGONAL_GAP, MOST_STRETCH = {TEXT_GRAM: 0.7, PHRASE_GRAM: 0.85}, 2, 1.5


def templates() -> list[tuple[int, str, bool, int, list[str]]]:
    """(template, label, base, k, words) of all fixed values."""
    named = [(*x, True) for x in BASE] + [(*x, False) for x in TEMPLATES + TEXTS]
    split = [(label, base, re.sub(NOT_ALNUM, " ", text.lower()).split()) for label, text, base in named]
    return [(n, label, base, TEXT_GRAM if len(ws) >= LONG else PHRASE_GRAM, ws) for n, (label, base, ws) in enumerate(split)]


def template_grams(spark: SparkSession) -> DataFrame:
    """(template, label, base, k, grams, p, t, h): bounded by the fixed lists."""
    rows = [(n, label, base, k, len(ws) - k + 1, p, ws[p : p + k]) for n, label, base, k, ws in templates() for p in range(len(ws) - k + 1)]
    made = spark.createDataFrame(rows, "template int, label string, base boolean, k int, grams int, p int, t array<string>")
    return made.withColumn("h", F.xxhash64("t"))


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, template, label, base, k, grams, diagonal, held).

    `held` are the template positions found on the diagonal. Each document has
    also a row without template. `row` numbers the input rows.
    """
    grams = template_grams(docs.sparkSession)
    sizes = (PHRASE_GRAM, TEXT_GRAM)
    # The hashes of the fixed lists: some hundred numbers, which the scan filters by before the join.
    known = {k: [r.h for r in grams.where(F.col("k") == k).select("h").distinct().collect()] for k in sizes}
    ws = words(ascii_lower(F.col(text_col).cast("string")), NOT_ALNUM)
    spoken = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), ws.alias("w"))
    placed = spoken.select("row", "doc_id", "w", F.size("w").cast("long").alias("n_words"), F.posexplode_outer("w").alias("pos", "a"))
    run = lambda k: F.array(*("a" if i == 0 else F.get("w", F.col("pos") + i) for i in range(k)))
    inside = lambda k: F.col("pos") + k <= F.col("n_words")
    hashed = placed.select("*", *(F.when(inside(k), F.xxhash64(run(k))).alias(f"h{k}") for k in sizes))
    hit = reduce(or_, (F.col(f"h{k}").isin(known[k]) for k in sizes))
    first = F.coalesce("pos", F.lit(0)) == 0
    # The first word of a document stays for its own row, whatever it meets.
    kept = hashed.where(hit | first).select("row", "doc_id", "n_words", "pos", F.explode(F.array(*(
        F.struct(F.lit(k).alias("own"), F.col(f"h{k}").alias("h"), run(k).alias("t")) for k in sizes))).alias("x")).select("row", "doc_id", "n_words", "pos", "x.*")
    met = kept.join(F.broadcast(grams), ["h", "t"], "left").where(F.col("template").isNotNull() | (first & (F.col("own") == PHRASE_GRAM)))
    return (met.select("row", "doc_id", "n_words", "template", "label", "base", "k", "grams", "p", (F.col("pos") - F.col("p")).cast("long").alias("diagonal"))
            .repartition("row")
            .groupBy("row", "doc_id", "template", "label", "base", "k", "grams", "diagonal")
            .agg(F.max("n_words").alias("n_words"), F.collect_set("p").alias("held")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans): spans of (template, label, base, start, end, score).

    One row per input row, whatever its doc_id. Null and empty texts have no
    words and no spans; an empty table gives no rows; other columns are ignored.
    """
    gap = F.col("diagonal") - F.lag("diagonal").over(W.partitionBy("row", "template").orderBy("diagonal"))
    fresh = F.when(F.col("base") | gap.isNull() | (gap > DIAGONAL_GAP), 1).otherwise(0)
    ordered = W.partitionBy("row", "template").orderBy("diagonal").rowsBetween(W.unboundedPreceding, 0)
    merged = (votes(docs, id_col, text_col).withColumn("fresh", fresh)
              .withColumn("island", F.sum("fresh").over(ordered))
              .groupBy("row", "doc_id", "template", "label", "base", "k", "grams", "island")
              .agg(F.max("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("got"),
                   F.min(F.col("diagonal") + F.array_min("held")).alias("start"), F.max(F.col("diagonal") + F.array_max("held") + F.col("k")).alias("end")))
    share = F.col("got") / F.col("grams")
    least = F.when(F.col("k") == TEXT_GRAM, LEAST_SHARE[TEXT_GRAM]).otherwise(LEAST_SHARE[PHRASE_GRAM])
    verified = F.when(F.col("base"), share == 1).otherwise(
        (share >= least) & (F.col("end") - F.col("start") <= (F.col("grams") + F.col("k") - 1) * MOST_STRETCH))
    span = F.when(verified, F.struct("template", "label", "base", "start", "end", share.alias("score")))
    return merged.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(span)).alias("spans")).drop("row")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"))


def _sql() -> str:
    rows = [f"({n}, '{label}', {str(base).lower()}, {k}, '{' '.join(ws)}')" for n, label, base, k, ws in templates()]
    return rf"""
WITH templates(template, label, base, k, phrase) AS (VALUES {', '.join(rows)}),
spoken AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
counted AS (SELECT doc_id, max(len(w))::BIGINT AS n_words FROM spoken GROUP BY doc_id),
grams AS (
  SELECT template, label, base, k, len(t) - k + 1 AS grams, p - 1 AS p, array_to_string(t[p : p + k - 1], ' ') AS g
  FROM (SELECT *, string_split(phrase, ' ') AS t, unnest(range(1, len(string_split(phrase, ' ')) - k + 2)) AS p FROM templates)),
runs AS (SELECT doc_id, k, i - 1 AS pos, array_to_string(w[i : i + k - 1], ' ') AS g
         FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM spoken, (VALUES ({PHRASE_GRAM}), ({TEXT_GRAM})) AS s(k) WHERE len(w) >= k)),
held AS (SELECT DISTINCT doc_id, template, label, base, k, grams, pos - p AS diagonal, p FROM runs JOIN grams USING (k, g)),
marked AS (
  SELECT *, CASE WHEN base THEN diagonal
                 ELSE sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal RANGE UNBOUNDED PRECEDING) END AS island
  FROM (SELECT held.*, CASE WHEN gap IS NULL OR gap > {DIAGONAL_GAP} THEN 1 ELSE 0 END / count(*) OVER (PARTITION BY doc_id, template, diagonal) AS fresh
        FROM held JOIN (
          SELECT doc_id, template, diagonal, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS gap
          FROM (SELECT DISTINCT doc_id, template, diagonal FROM held)) USING (doc_id, template, diagonal))),
spans AS (
  SELECT doc_id, template, label, base, k, round(island, 3) AS island, count(DISTINCT p) / any_value(grams) AS score,
         min(diagonal + p) AS start, max(diagonal + p + k) AS stop, any_value(grams) AS grams
  FROM marked GROUP BY ALL),
good AS (
  SELECT * FROM spans
  WHERE CASE WHEN base THEN score = 1
             ELSE score >= CASE WHEN k = {TEXT_GRAM} THEN {LEAST_SHARE[TEXT_GRAM]} ELSE {LEAST_SHARE[PHRASE_GRAM]} END AND stop - start <= (grams + k - 1) * {MOST_STRETCH} END)
SELECT doc_id, n_words, count(template) FILTER (WHERE base) AS n_base,
       min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(score), 0.0)::DOUBLE AS score
FROM counted LEFT JOIN good USING (doc_id) GROUP BY doc_id, n_words"""


QUERIES = {"op4_licenses": op4_licenses}
ORACLE_SQL = {"op4_licenses": _sql()}
