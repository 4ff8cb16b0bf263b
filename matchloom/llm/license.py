"""License scans by diagonal voting, in DataFrame operations only.

Every text is lower-cased (A-Z) and cut into words; the rolling hash of each
``K`` consecutive words is joined to the places of the license templates that
have it.  A hit of text position p and template position t votes for the
diagonal p - t.  Votes are counted by diagonal.  Diagonals up to ``NEIGHBOUR``
apart (words put in or left out) are merged, from each diagonal on, so a span
never drifts farther than that, and its words are verified against the
template's: both the share of the template's word k-grams that the span has and
the share of the span's own words, from its first hit to its last, that stand in
a hit must be ``SIMILARITY``; the lesser is its score.  So a notice that is cut
into shards, or strewn over a text, is none.  A template of fewer than ``SHORT``
k-grams, where one word may name another license, must be there whole.  Spans of
a chain of neighbouring diagonals are one place of the template.

The templates are a constant of this module, some two thousand k-grams.  The join
to them is made before any row leaves the scan: the hashes are held against the
constant set, and what is left is joined on the words themselves, so no hash
collision can count.  Only hits are shuffled, by row.

The phrases of ``PHRASES`` are templates too.  A diagonal that has a vote for
every k-gram of a phrase is a place where its words stand consecutively, and a
whole phrase has exactly one diagonal for each such place: these are the base
places.

Null and empty texts have 0 words, no place, empty labels and score 0; an empty
table gives an empty result.  Repeated rows and ids are scanned each for itself;
texts of any length are scanned whole, in the task that reads them, and only
their hits go on; labels that tie are all given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tables, written

K = 3
SIMILARITY = 0.8
SHORT = 10
#: Diagonals up to so many words apart are one span: the words that may be put in or left out.
NEIGHBOUR = 3
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Wordings of public licenses, as words, with the labels that the method adds.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "free software foundation either version 3 of the license"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-2", "free software foundation either version 2 of the license"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"),
]


def templates(phrases: dict[str, str] = PHRASES, notices=NOTICES) -> list[tuple]:
    """(template, label, is_base, n_grams, t, gram) for every k-gram place of every template."""
    out = []
    for k, (label, text, base) in enumerate([*((v, p, True) for p, v in phrases.items()), *((v, p, False) for v, p in notices)]):
        words = text.split()
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        grams = [" ".join(words[i : i + K]) for i in range(len(words) - K + 1)]
        out += [(k, label, base, len(grams), t, g) for t, g in enumerate(grams)]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices=NOTICES) -> DataFrame:
    """Per row: the id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans."""
    spark = docs.sparkSession
    places = templates(phrases, notices)
    t = spark.createDataFrame(places, "template int, label string, is_base boolean, n_grams int, t int, gram string")
    known = [r[0] for r in t.select(F.xxhash64(*[F.split("gram", " ")[i] for i in range(K)])).distinct().collect()]  # a constant's hashes
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER), F.lit(LICENSE_WORD), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", words.alias("words"))
    at = lambda i, k: F.get(F.col("words"), i + F.lit(k))
    hit = F.filter(F.sequence(F.lit(0), F.size("words") - K), lambda i: F.xxhash64(*[at(i, k) for k in range(K)]).isin(known))
    rows = rows.select("id", F.size("words").cast("long").alias("n_words"), F.when(F.size("words") >= K, F.transform(hit, lambda i: F.struct(i.alias("p"), F.concat_ws(" ", *[at(i, k) for k in range(K)]).alias("gram")))).alias("hits"))
    with tables() as keep:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "license-hits")

        votes = rows.select("row", F.explode("hits").alias("h")).select("row", "h.p", "h.gram").join(F.broadcast(t), "gram")
        voted = votes.groupBy("row", "template", "label", "is_base", "n_grams", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.collect_set("t").alias("covered"))
        base = voted.where("is_base and votes = n_grams").groupBy("row").agg(
            F.count(F.lit(1)).alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("base_set")
        )
        along = Window.partitionBy("row", "template").orderBy("diagonal")
        # the text's words that a diagonal's hits cover
        stands = F.flatten(F.transform("covered", lambda t: F.array(*[F.col("diagonal") + t + F.lit(k) for k in range(K)])))
        near = along.rangeBetween(0, NEIGHBOUR)
        spans = (
            voted.withColumn("stands", stands)
            .withColumn("opens", (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along), F.lit(NEIGHBOUR + 1)) > NEIGHBOUR).cast("int"))
            .withColumn("span", F.sum("opens").over(along))
            .withColumn("grams", F.size(F.array_distinct(F.flatten(F.collect_list("covered").over(near)))))
            .withColumn("words", F.array_distinct(F.flatten(F.collect_list("stands").over(near))))
            .withColumn("coverage", F.least(F.col("grams") / F.col("n_grams"), F.size("words") / (F.array_max("words") - F.array_min("words") + 1)))
            .groupBy("row", "template", "label", "n_grams", "span")
            .agg(F.max("coverage").alias("coverage"))
        )
        enough = F.col("coverage") >= F.when(F.col("n_grams") < SHORT, 1.0).otherwise(SIMILARITY)
        scored = spans.groupBy("row").agg(F.max("coverage").alias("score"), F.count(F.when(enough, 1)).alias("n_spans"), F.collect_set(F.when(enough, F.col("label"))).alias("span_set"))
        out = rows.select("row", "id", "n_words").join(base, "row", "left").join(scored, "row", "left")
        none = F.array().cast("array<string>")
        base_set, span_set = F.coalesce("base_set", none), F.coalesce("span_set", none)
        out = out.select(
            F.col("id").alias(id_col),
            "n_words",
            F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
            "first_word",
            "last_word",
            F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union(base_set, span_set)), ",").alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
            F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        )
        return keep(written(out, "license-scan"))


def oracle(phrases: dict[str, str] = PHRASES, notices=NOTICES) -> str:
    """DuckDB SQL for ``scan`` over ``documents``, by k-gram strings."""
    values = ", ".join(f"({k}, '{label}', {str(base).lower()}, {n}, {t}, '{g}')" for k, label, base, n, t, g in templates(phrases, notices))
    return rf"""
WITH tpl(template, label, is_base, n_grams, t, gram) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LICENSE_WORD}') AS w FROM documents),
g AS (SELECT r, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS gram FROM (SELECT r, w, unnest(range(0, len(w) - {K - 1})) AS p FROM d WHERE len(w) >= {K})),
v AS (SELECT r, template, label, is_base, n_grams, p - t AS diagonal, count(*) AS votes, list(t) AS covered FROM g JOIN tpl USING (gram) GROUP BY ALL),
b AS (SELECT r, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list(DISTINCT label) AS bs FROM v WHERE is_base AND votes = n_grams GROUP BY r),
o AS (SELECT *, CASE WHEN coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal), {NEIGHBOUR + 1}) > {NEIGHBOUR} THEN 1 ELSE 0 END AS opens FROM v),
s AS (SELECT *, sum(opens) OVER (PARTITION BY r, template ORDER BY diagonal) AS span, list_distinct(flatten(list(covered) OVER near)) AS grams,
  list_distinct(flatten(list(list_transform(covered, lambda t: [{', '.join(f'diagonal + t + {k}' for k in range(K))}])) OVER near)) AS words FROM o WINDOW near AS (PARTITION BY r, template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {NEIGHBOUR} FOLLOWING)),
c AS (SELECT r, template, label, span, n_grams, max(least(len(grams) / n_grams::DOUBLE, len(list_distinct(flatten(words))) / (list_max(flatten(words)) - list_min(flatten(words)) + 1)::DOUBLE)) AS coverage FROM s GROUP BY r, template, label, n_grams, span),
e AS (SELECT *, coverage >= CASE WHEN n_grams < {SHORT} THEN 1 ELSE {SIMILARITY} END AS enough FROM c),
m AS (SELECT r, max(coverage) AS score, count(*) FILTER (enough) AS n_spans, list(DISTINCT label) FILTER (enough) AS ss FROM e GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(bs, []::VARCHAR[])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bs, []::VARCHAR[]), coalesce(ss, []::VARCHAR[])))), ',') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)"""
