"""License scans by diagonal voting.

Rolling three-word hashes of a text are joined to the positions where license templates hold them.
A hit's diagonal is its place in the text less its place in the template; hits add up by diagonal,
neighbouring diagonals (a few words put in or left out) merge, and a span counts when the words it
matched, compared as text, cover enough of the template. As its hits lie on diagonals that differ by less
than eight, a span has the template's order, and its length but for as many words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose every place counts.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
LEAST = 5  # words of a template; fewer say little
#: Sentences and whole paragraphs of public license notices that the method looks for, with small changes or without.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
)
SHIFT = 4  # diagonals that merge
COVER = 80  # hundredths of a template's windows that a span must hold


def template_windows(spark, k: int = K) -> DataFrame:
    """tid, label, base, size (windows), tpos, gram of the phrases and templates: a table as long as those texts, fixed here."""
    if short := [t for _, t in TEMPLATES if len(t.split()) < LEAST]:
        raise ValueError(f"templates of fewer than {LEAST} words: {short}")
    rows = []
    for tid, (label, text, base) in enumerate([(b, p, True) for p, b in PHRASES.items()] + [(b, t, False) for b, t in TEMPLATES]):
        words = text.split()
        rows += [(tid, label, base, len(words) - k + 1, p, " ".join(words[p : p + k])) for p in range(len(words) - k + 1)]
    return spark.createDataFrame(rows, "tid int, label string, base boolean, size int, tpos int, gram string")


def license_scan(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shift: int = SHIFT, cover: int = COVER) -> DataFrame:
    """``id``, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (start, end, label, cover of each verified span).

    One row per input row. A-Z alone are lower-cased. n_base counts all places of the phrases, first_word and last_word are the
    least and largest of their starts (null without one), score is the best cover of a template or
    phrase, 0 to 1. Null and empty texts have no words; rows of one id and text fare alike, null ids
    too; other columns are ignored, whatever their names. Windows that no template holds drop out
    inside their row; the hash only finds candidates, the join compares the words themselves.
    """
    spark = docs.sparkSession
    grams = template_windows(spark).withColumn("h", F.xxhash64(*[F.get(F.split("gram", " "), F.lit(j)) for j in range(K)]))
    known = [r[0] for r in grams.select("h").distinct().collect()]  # of the fixed table above
    own = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.select("id", F.xxhash64("text").alias("t"), F.array_remove(F.split(F.translate("text", UPPER, UPPER.lower()), WORD_GAP), "").alias("w"))
    w = F.col("w")
    windows = F.when(F.size(w) >= K, F.filter(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(K)]).isin(known)))
    own = own.select("id", "t", F.size("w").cast("long").alias("n_words"), F.transform(windows, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(w, i + 1, K), " ").alias("gram"))).alias("hits"))
    # outer, or the optimiser would put a copy of the whole expression in a filter below
    hits = own.select("id", "t", F.inline_outer("hits")).where("pos is not null").distinct()
    votes = hits.join(F.broadcast(grams), "gram").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    per = votes.groupBy("id", "t", "tid", "label", "base", "size", "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    # phrases: places where all windows stand on one diagonal
    phrases = per.where("base and votes = size").groupBy("id", "t").agg(F.count("*").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("first").cast("long").alias("last_word"), F.collect_set("label").alias("base_set"))
    # templates: neighbouring diagonals merge into islands; each window of the template counts once
    band = F.floor(F.col("diagonal") / (2 * shift))
    near = votes.where("not base").select("id", "t", "tid", "label", "size", "tpos", "pos", F.explode(F.array(band, F.floor((F.col("diagonal") + shift) / (2 * shift)) + F.lit(1 << 40))).alias("band"))
    spans = near.groupBy("id", "t", "tid", "label", "size", "band").agg(F.count_distinct("tpos").alias("covered"), F.min("pos").alias("start"), (F.max("pos") + K).alias("end"))
    spans = spans.where(F.col("covered") * 100 >= F.col("size") * cover).withColumn("cover", F.least(F.lit(1.0), F.col("covered") / F.col("size")))
    found = spans.groupBy("id", "t").agg(F.collect_set("label").alias("more_set"), F.max("cover").alias("cover"), F.collect_set(F.struct("start", "end", "label", "cover")).alias("spans"))
    out = own.select("id", "t", "n_words")
    for k, part in enumerate((phrases, found)):
        part = part.withColumnsRenamed({"id": f"id{k}", "t": f"t{k}"})
        out = out.join(part, F.col("t").eqNullSafe(F.col(f"t{k}")) & F.col("id").eqNullSafe(F.col(f"id{k}")), "left")
    none = F.array().cast("array<string>")
    base, more = F.coalesce("base_set", none), F.coalesce("more_set", none)
    return out.select(
        F.col("id").alias(id),
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,label:string,cover:double>>")).alias("spans"),
    )


def oracle() -> str:
    """DuckDB SQL for doc_id, n_words, the phrases' columns, labels and score over ``documents``."""
    values = ", ".join(f"('{b}', string_split('{p}', ' '), true, {k})" for k, (p, b) in enumerate(PHRASES.items()))
    values += ", " + ", ".join(f"('{b}', string_split('{t}', ' '), false, {k + len(PHRASES)})" for k, (b, t) in enumerate(TEMPLATES))
    return rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD_GAP}'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT label, words, base, tid, unnest(range(1, len(words) - 1)) AS tpos FROM (VALUES {values}) v(label, words, base, tid)),
g AS (SELECT *, words[tpos] || ' ' || words[tpos + 1] || ' ' || words[tpos + 2] AS gram, len(words) - 2 AS size FROM t),
p AS (SELECT doc_id, pos, w[pos] || ' ' || w[pos + 1] || ' ' || w[pos + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS pos FROM w)),
v AS (SELECT doc_id, pos - 1 AS pos, tid, label, base, size, tpos - 1 AS tpos, pos - tpos AS diagonal FROM p JOIN g USING (gram)),
b AS (SELECT doc_id, label, min(pos) AS start FROM v WHERE base GROUP BY doc_id, tid, label, size, diagonal HAVING count(*) = size),
bd AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word FROM b GROUP BY doc_id),
nb AS (SELECT doc_id, tid, label, size, tpos, unnest([floor(diagonal / {2 * SHIFT}), floor((diagonal + {SHIFT}) / {2 * SHIFT}) + 1099511627776]) AS band FROM v WHERE NOT base),
s AS (SELECT doc_id, label, least(1.0, count(DISTINCT tpos) / size) AS cover FROM nb GROUP BY doc_id, tid, label, size, band HAVING 100 * count(DISTINCT tpos) >= {COVER} * size),
sd AS (SELECT doc_id, max(cover) AS cover FROM s GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION ALL SELECT doc_id, label FROM s) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(cover, 0)::DOUBLE END AS score
FROM w LEFT JOIN bd USING (doc_id) LEFT JOIN sd USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id)"""
