"""License scans by diagonal voting.

Every notice of ``TEMPLATES`` is cut into rolling word k-grams. All rolling k-grams of all documents are joined, by hash, with the
notices' grams, and equal hashes count only if the words are equal. A hit of document word ``p`` on notice word ``q`` votes for the
diagonal ``p - q``. Votes are counted by document, notice and diagonal; diagonals at most ``SLACK`` apart (words were put in or
left out between them) form one band. A band is verified word by word: its share is the part of the notice's words that stand in
the document on one of the band's diagonals. A notice is found where a share reaches ``least_share``; the score of a document is
its largest share.

Beside that stand the base labels: places where a phrase's words are consecutive. Everything is a DataFrame expression. Grams
that hit nothing end in the broadcast join (the notices are fixed text, about a thousand rows), inside the stage that reads the
text; what is shuffled is hits. All rows of one window belong to one document and one notice.

Defined results: null text is empty, has no words, empty labels and score 0, and null places; null ids are documents like any
other; repeated rows give equal rows; texts of any length are read whole; an empty table gives an empty result; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.llm.common import join_null_safe
from cellweave.llm.quality import joined, let
from cellweave.scale import sized

# What separates words, the phrases of the base labels, and public license notices by label.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

GRAM = 4  # words: a pair of word pairs
SLACK = 3  # less than GRAM, so that copies of a gram side by side are bands of their own
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def grams(words: Column) -> Column:
    """The hash of each run of ``GRAM`` words, by its first word."""
    pairs = lambda h: joined(h, h, 1, F.size(h) - 1)
    fours = lambda p: joined(p, p, 2, F.size(p) - 2)
    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: let(pairs(h), fours))


def words_and_grams(text: Column) -> Column:
    return let(words_of(text), lambda w: F.struct(w.alias("w"), grams(w).alias("g")))


def template_grams(spark: SparkSession) -> DataFrame:
    """template, label, tw (the notice's words), at, gram: a row for each rolling gram of each notice."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(k).alias("label"), F.lit(t).alias("text")) for i, (k, t) in enumerate(TEMPLATES)])
    notices = spark.range(1).select(F.explode(rows).alias("n")).select("n.template", "n.label", words_and_grams(F.col("n.text")).alias("b"))
    return notices.select("template", "label", F.col("b.w").alias("tw"), F.posexplode("b.g").alias("at", "gram"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash that tells rows of one id apart) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def diagonals(docs: DataFrame) -> DataFrame:
    """doc_id, t, template, label, size, diagonal, votes, same: same holds the notice's places whose word the diagonal confirms."""
    rows = keyed(docs).select("doc_id", "t", words_and_grams(F.col("text")).alias("b"))
    placed = rows.select("doc_id", "t", F.col("b.w").alias("w"), F.posexplode("b.g").alias("p", "gram"))
    cut = lambda words, at: F.slice(F.col(words), F.col(at) + 1, GRAM)
    hits = placed.join(F.broadcast(template_grams(docs.sparkSession)), "gram").where(cut("w", "p") == cut("tw", "at"))
    diagonal = F.col("p") - F.col("at")
    # one hit of a run is enough to look along the diagonal
    first = (F.col("p") == 0) | (F.col("at") == 0) | (F.get("w", F.col("p") - 1) != F.get("tw", F.col("at") - 1))
    same = F.filter(F.sequence(F.lit(0), F.size("tw") - 1), lambda i: F.get("w", diagonal + i) == F.get("tw", i))
    votes = hits.select("doc_id", "t", "template", "label", F.size("tw").alias("size"), diagonal.alias("diagonal"), "p", F.when(first, same).alias("same"))
    return votes.groupBy("doc_id", "t", "template", "label", "size", "diagonal").agg(F.count_distinct("p").alias("votes"), F.max("same").alias("same"))


def bands(docs: DataFrame) -> DataFrame:
    """doc_id, t, template, label, first_word, votes, share of every band of neighbouring diagonals."""
    notice = ["doc_id", "t", "template", "label", "size"]
    along = Window.partitionBy("doc_id", "t", "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(along) > SLACK).cast("int")
    numbered = diagonals(docs).withColumn("fresh", F.coalesce(fresh, F.lit(0))).withColumn("band", F.sum("fresh").over(along))
    found = numbered.groupBy(*notice, "band").agg(
        F.greatest(F.min("diagonal"), F.lit(0)).cast("long").alias("first_word"), F.sum("votes").alias("votes"),
        F.size(F.array_distinct(F.flatten(F.collect_list("same")))).alias("confirmed"),
    )
    return found.select("doc_id", "t", "template", "label", "first_word", "votes", (F.col("confirmed") / F.col("size")).alias("share"))


def phrase_places(words: Column) -> Column:
    """Array of (label, places) of the phrases; places are looked for only in texts that hold the phrase."""
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    def places(line: Column, phrase: str) -> Column:
        parts = phrase.split(" ")
        here = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(parts)])
        every = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
        return F.when(F.contains(line, F.lit(f" {phrase} ")), every).otherwise(F.array().cast("array<int>"))

    return let(line, lambda x: F.array(*[F.struct(F.lit(k).alias("label"), places(x, p).alias("places")) for p, k in PHRASES.items()]))


def scanned(docs: DataFrame, least_share: float = 0.75) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spans = bands(docs)
    label = F.when(F.col("share") >= least_share, F.col("label"))
    found = sized(spans.groupBy("doc_id", "t").agg(F.collect_set(label).alias("found"), F.max("share").alias("share")))
    base = keyed(docs).select("doc_id", "t", let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), phrase_places(w).alias("at"))).alias("b"))
    at = F.flatten(F.transform("b.at", lambda x: x["places"]))
    some = F.transform(F.filter("b.at", lambda x: F.size(x["places"]) > 0), lambda x: x["label"])
    counted = base.select("doc_id", "t", F.col("b.n").alias("n_words"), at.alias("at"), F.array_sort(some).alias("base"))
    every = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return join_null_safe(counted, found, ["doc_id", "t"], "left").select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.coalesce("share", F.lit(0.0)).alias("score"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BETWEEN_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NOTICES = ", ".join(f"({i}, {_quoted(k)}, {_quoted(t)})" for i, (k, t) in enumerate(TEMPLATES))
_PHRASES = ", ".join(f"({_quoted(p)}, {_quoted(k)})" for p, k in PHRASES.items())

#: The same in SQL over the view documents; grams are compared as text.
SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_BETWEEN_SQL}') AS w FROM documents),
notices AS (SELECT template, label, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_BETWEEN_SQL}') AS tw FROM (VALUES {_NOTICES}) v(template, label, text)),
places AS (SELECT r, unnest(range(len(w))) AS p FROM docs),
words AS (SELECT r, p, w[p + 1] AS x FROM places JOIN docs USING (r)),
grams AS (SELECT r, p, concat_ws(' ', x, lead(x) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o) AS g, lead(x, 3) OVER o AS last FROM words WINDOW o AS (PARTITION BY r ORDER BY p)),
tplaces AS (SELECT template, label, len(tw) AS size, tw, unnest(range(len(tw))) AS q FROM notices),
twords AS (SELECT template, label, size, q, tw[q + 1] AS x FROM tplaces),
tgrams AS (SELECT template, label, size, q, concat_ws(' ', x, lead(x) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o) AS g, lead(x, 3) OVER o AS last FROM twords WINDOW o AS (PARTITION BY template ORDER BY q)),
diagonals AS (SELECT DISTINCT r, template, label, size, p - q AS d FROM grams JOIN tgrams ON grams.g = tgrams.g AND grams.last IS NOT NULL AND tgrams.last IS NOT NULL),
banded AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY d) AS band
  FROM (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY r, template ORDER BY d) > {SLACK} THEN 1 ELSE 0 END AS fresh FROM diagonals)),
spans AS (SELECT b.r, b.label, b.template, b.band, count(DISTINCT t.q) / max(b.size) AS share
  FROM banded b JOIN twords t ON t.template = b.template JOIN words w ON w.r = b.r AND w.p = b.d + t.q AND w.x = t.x GROUP BY ALL),
found AS (SELECT r, list(DISTINCT label) FILTER (share >= {{least}}) AS labels, max(share) AS score FROM spans GROUP BY r),
hits AS (SELECT DISTINCT r, p, label FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p, w FROM docs)
  JOIN (SELECT label, string_split(phrase, ' ') AS parts FROM (VALUES {_PHRASES}) v(phrase, label)) ON x = parts[1] AND w[p + 1:p + len(parts)] = parts),
base AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN found USING (r) LEFT JOIN base USING (r)
"""
