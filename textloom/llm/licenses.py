"""Licence scans by diagonal voting, in DataFrame functions only.

All rolling word 2-grams of every text are hashed and joined with the positions that the
same 2-grams have in the templates (a fixed list, so its side is broadcast).  A hit votes
for the diagonal text position - template position; votes are counted by (document,
template, diagonal).  A notice's diagonals that are at most ``DRIFT`` apart, as inserted or
lost words leave them, are merged into spans, one from each diagonal on: a span is thus no
wider than the template and DRIFT words, and its 2-grams stand in the template's order but
for that drift.  A span is verified by the share of the template's 2-grams that it covers:
all of a phrase on one diagonal, ``COVER`` of a notice.

A 2-gram is compared by the 64-bit hash of its two words.  Cases: a null text counts as
empty; rows that repeat a doc_id and text are one document, given once for each row; texts
of one word have no 2-grams; null ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DRIFT = 8
COVER = 0.8
#: What stands between words, upper-case letters aside.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and their labels, then the phrases and notices of this method.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
PHRASES = {
    "all rights reserved": "all-rights-reserved",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "creative commons": "creative-commons",
    "public domain": "public-domain",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "eclipse public license": "epl",
    "artistic license": "artistic",
    "european union public licence": "eupl",
    "gnu free documentation license": "gfdl",
    "open database license": "odbl",
    "sil open font license": "ofl",
    "microsoft public license": "ms-pl",
    "server side public license": "sspl",
    "business source license": "busl",
    "cc0 1 0 universal": "cc0",
    "spdx license identifier": "spdx",
}
NOTICES = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version",
    "agpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version",
    "zlib-notice": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
    "unlicense-notice": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    "bsl-notice": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "mit-disclaimer": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "cc-by-sa-notice": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), BETWEEN), lambda w: w != "")


def _grams(words: Column) -> Column:
    """Position and hash of each pair of consecutive words."""
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(i.alias("at"), F.xxhash64(words[i], words[i + 1]).alias("gram")))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<struct<at:int,gram:bigint>>"))


def templates(spark: SparkSession) -> DataFrame:
    """label, base, notice, grams (their number), place and gram of each template position."""
    kinds = [(BASE, True, False), (PHRASES, False, False)]
    rows = [(text, label, base, notice) for table, base, notice in kinds for text, label in table.items()]
    rows += [(text, label, False, True) for label, text in NOTICES.items()]
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("phrase", "label", "base", "notice"))]) for r in rows])
    table = spark.range(1).select(F.inline(listed)).select("label", "base", "notice", _grams(_words(F.col("phrase"))).alias("pairs"))
    return table.select("label", "base", "notice", F.size("pairs").alias("grams"), F.inline("pairs").alias("place", "gram"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select("doc_id", F.xxhash64(text).alias("text_key"), _words(text).alias("words"))
    # one row without a gram carries the document's word count
    counted = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("bigint").alias("gram")))
    rows = read.select("doc_id", "text_key", F.size("words").alias("n_words"), F.inline(F.concat(_grams(F.col("words")), counted)))
    hits = rows.join(F.broadcast(templates(docs.sparkSession)), "gram", "left").filter("at < 0 or place is not null")
    key = ["doc_id", "text_key"]
    votes = hits.groupBy(*key, "label", "base", "notice", "grams", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.max("n_words").alias("n_words"), F.sum(F.when(F.col("at") < 0, 1).otherwise(0)).alias("copies")
    )
    merged = Window.partitionBy(*key, "label").orderBy(F.col("diagonal").cast("long")).rangeBetween(0, DRIFT)
    together = F.array_distinct(F.flatten(F.collect_list("places").over(merged)))
    spans = votes.withColumns({"votes": F.size(F.when(F.col("notice"), together).otherwise(F.col("places"))), "start": F.col("diagonal")})
    cover = F.col("votes") / F.col("grams")
    good = F.coalesce(cover >= F.when(F.col("notice"), COVER).otherwise(1.0), F.lit(False))
    base = good & F.col("base")
    labels = F.array_join(F.sort_array(F.collect_set(F.when(good, F.col("label")))), ",")
    found = spans.groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("start").cast("long"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        labels.alias("labels"),
        F.coalesce(F.max(F.when(good, cover)), F.lit(0.0)).alias("score"),
        F.max("copies").alias("copies"),
    )
    # a row again for each repeat
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("text_key", "copies", "copy")


def _listed() -> str:
    kinds = [(BASE, "true", "false"), (PHRASES, "false", "false")]
    rows = [f"('{label}', {base}, {notice}, '{text}')" for table, base, notice in kinds for text, label in table.items()]
    return ", ".join(rows + [f"('{label}', false, true, '{text}')" for label, text in NOTICES.items()])


#: The same in DuckDB, with pairs of words in place of hashes; for tables in which a doc_id comes once.
ORACLE_SQL = rf"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{BETWEEN}'), lambda w: w <> '') AS words FROM documents
), grams AS (
  SELECT doc_id, i - 1 AS pos, words[i] || ' ' || words[i + 1] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM split)
), listed AS (
  SELECT label, base, notice, string_split(phrase, ' ') AS words FROM (VALUES {_listed()}) v(label, base, notice, phrase)
), places AS (
  SELECT label, base, notice, len(words) - 1 AS grams, i - 1 AS place, words[i] || ' ' || words[i + 1] AS gram FROM (SELECT *, unnest(range(1, len(words))) AS i FROM listed)
), votes AS (
  SELECT doc_id, label, base, notice, grams, pos - place AS diagonal, list(DISTINCT place) AS hit FROM grams JOIN places USING (gram) GROUP BY ALL
), spans AS (
  SELECT doc_id, label, base, notice, diagonal AS start,
    len(CASE WHEN notice THEN list_distinct(flatten(list(hit) OVER (PARTITION BY doc_id, label ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {DRIFT} FOLLOWING))) ELSE hit END) / grams AS cover
  FROM votes
), found AS (
  SELECT * FROM spans WHERE cover >= CASE WHEN notice THEN {COVER} ELSE 1 END
)
SELECT s.doc_id, len(any_value(s.words))::BIGINT AS n_words, count(*) FILTER (f.base) AS n_base, min(f.start) FILTER (f.base) AS first_word, max(f.start) FILTER (f.base) AS last_word,
  coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label) FILTER (f.base), '') AS base_labels, coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') AS labels,
  coalesce(max(f.cover), 0)::DOUBLE AS score
FROM split s LEFT JOIN found f ON s.doc_id = f.doc_id GROUP BY s.doc_id
"""
