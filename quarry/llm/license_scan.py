"""License scans by diagonal voting over word k-gram hits (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.shared import BROADCAST_ROWS, id_key, literal_table, own_columns, table, text_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII that is neither a digit nor a lower-case letter.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for text that is not yet lower-cased; there are as many words.
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words in a rolling gram. Two, so that the shortest phrase has one gram.
K = 2
#: Diagonals at most this far apart are neighbours: a word put in or left out shifts the rest by one.
NEAR = 2
#: Share of a notice's grams that its merged diagonals must cover; less is enough where they cover each of its words, so that words were only put in.
COVER, COVER_PUT_IN = 0.8, 0.5

#: Phrases whose every place is counted, as (label, words).
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: Wordings of well-known notices, as (label, words).
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


def words_of(text: Column) -> Column:
    """A-Z lower-cased. lower() changes other letters too, but they stay word characters and none turns into a phrase's letters."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")


def template_table(spark: SparkSession, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """Columns template (number), label, phrase (boolean), words; at least K words each."""
    rows = [(label, True, words) for label, words in phrases] + [(label, False, words) for label, words in notices]
    return literal_table(spark, [{"template": i, "label": label, "phrase": phrase, "words": words} for i, (label, phrase, words) in enumerate(rows)])


def grams(df: DataFrame, words: str, pos: str, prefix: str, *keep: str) -> DataFrame:
    """A row for each rolling K-gram of an array column: its position, words and hash."""
    shifted = [(F.col(words) if i == 0 else F.slice(words, i + 1, F.greatest(F.size(words) - i, F.lit(0)))).alias(f"{prefix}{i}") for i in range(K)]
    each = df.filter(F.size(words) >= K).select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias(pos, "g")).select(*keep, pos, "g.*")
    return each.filter(F.col(f"{prefix}{K - 1}").isNotNull()).withColumn(f"{prefix}hash", F.xxhash64(*[f"{prefix}{i}" for i in range(K)]))


def scan_licenses(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    Every rolling word gram of a document meets the template positions that have the same gram by its
    hash, and its words confirm it. Hits vote for a diagonal (document position less template position).
    A diagonal that has every gram of a phrase is a place of the phrase. A notice's diagonals of two
    votes or more, and those of one vote within NEAR of such a one, are merged where they lie within NEAR of one another, and the
    merged span is verified: within twice the notice's length it covers COVER of its grams, or COVER_PUT_IN of them
    and each of its words. Score: the largest share of grams so covered, 1 for a phrase, 0 for none.

    Null and empty texts have no words and no labels. Rows that repeat an id are told apart by their
    text; equal rows give equal rows. Extra columns are ignored. An empty table gives an empty result.
    Votes are combined before any shuffle; a group is one document and template, so no larger than a text.
    """
    spark = docs.sparkSession
    d = own_columns(docs, "doc_id", "text").select("doc_id", id_key("doc_id").alias("_id"), text_key("text").alias("_k"), "text")
    t = templates.withColumn("words", F.split("words", " ")).withColumn("n_grams", F.size("words") - K + 1)
    t = grams(t, "words", "tpos", "t", "template", "label", "phrase", "n_grams")
    if t.count() <= BROADCAST_ROWS:
        t = F.broadcast(t)
    rolled = grams(d.select("_id", "_k", words_of(F.col("text")).alias("words")), "words", "pos", "w", "_id", "_k")
    confirmed = F.col("whash") == F.col("thash")
    for i in range(K):
        # not as an equality: that would make the words part of the join's key, beside the hash
        confirmed = confirmed & F.nullif(F.col(f"w{i}"), F.col(f"t{i}")).isNull()
    diagonals = (
        rolled.join(t, confirmed)
        .groupBy("_id", "_k", "template", "label", "phrase", "n_grams", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(F.collect_set("tpos").alias("votes"), F.min("pos").alias("from"), F.max("pos").alias("to"))
        .withColumn("full", F.col("phrase") & (F.size("votes") == F.col("n_grams")))
        .filter(F.col("full") | ~F.col("phrase"))
    )
    by = Window.partitionBy("_id", "_k", "template").orderBy("diagonal")
    strongest = F.max(F.size("votes")).over(by.rangeBetween(-NEAR, NEAR))
    words = F.size(F.array_distinct(F.concat("votes", F.transform("votes", lambda x: x + 1))))
    merged = (
        diagonals.withColumn("strongest", strongest).filter(F.col("full") | (F.col("strongest") >= 2))
        .withColumn("new", (F.col("full") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > NEAR, F.lit(True))).cast("int"))
        .withColumn("run", F.sum("new").over(by))
        .groupBy("_id", "_k", "template", "label", "phrase", "n_grams", "run")
        .agg(F.min("diagonal").alias("start"), F.array_distinct(F.flatten(F.collect_list("votes"))).alias("votes"), F.min("from").alias("from"), F.max("to").alias("to"))
        .withColumn("share", F.size("votes") / F.col("n_grams"))
        .withColumn("enough", (F.col("share") >= COVER) | ((F.col("share") >= COVER_PUT_IN) & (words == F.col("n_grams") + K - 1)))
        .filter(F.col("phrase") | (F.col("enough") & (F.col("to") - F.col("from") + K <= 2 * (F.col("n_grams") + K - 1))))
    )
    found = merged.groupBy("_id", "_k").agg(
        F.count_if("phrase").alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    n = d.select("doc_id", "_id", "_k", F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), RAW_GAP), "")).cast("long").alias("n_words"))
    return n.join(found, ["_id", "_k"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")], F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), template_table(spark))


_ROWS = ", ".join(f"({i}, '{label}', {phrase}, '{words}')" for i, (label, phrase, words) in enumerate([(x, True, y) for x, y in PHRASES] + [(x, False, y) for x, y in NOTICES]))
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda x: x <> '') AS w FROM documents
), t0(template, label, phrase, words) AS (VALUES {_ROWS}),
t1 AS (SELECT template, label, phrase, string_split(words, ' ') AS w FROM t0),
t AS (SELECT template, label, phrase, len(w) - 1 AS n_grams, i - 1 AS tpos, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t1)),
g AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d)),
diag AS (
  SELECT doc_id, template, label, phrase, n_grams, pos - tpos AS diagonal, list(DISTINCT tpos) AS votes, min(pos) AS lo, max(pos) AS hi
  FROM g JOIN t USING (a, b) GROUP BY ALL
  HAVING NOT phrase OR count(DISTINCT tpos) = n_grams
), strong AS (
  SELECT * FROM diag QUALIFY phrase OR max(len(votes)) OVER (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING) >= 2
), marked AS (
  SELECT *, CASE WHEN phrase OR coalesce(diagonal - lag(diagonal) OVER o > {NEAR}, true) THEN 1 ELSE 0 END AS fresh
  FROM strong WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)
), runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM marked
), spans AS (
  SELECT doc_id, template, label, phrase, run, min(diagonal) AS start, list_distinct(flatten(list(votes))) AS all_votes, len(all_votes) / n_grams AS share
  FROM runs GROUP BY doc_id, template, label, phrase, n_grams, run
  HAVING phrase OR ((share >= {COVER} OR share >= {COVER_PUT_IN} AND len(list_distinct(list_concat(all_votes, list_transform(all_votes, lambda x: x + 1)))) = n_grams + {K} - 1) AND max(hi) - min(lo) + {K} <= 2 * (n_grams + {K} - 1))
), found AS (
  SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM spans GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN found USING (doc_id)
"""
