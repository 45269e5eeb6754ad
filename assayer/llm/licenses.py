"""License phrases and notices in texts, by diagonal voting.

All rolling pairs of neighbouring words of every text are hashed and joined with the hashed pairs of the license
templates, a broadcast table; pairs in no template are dropped as hashes, before they become rows of the join. A hit at word i of the text and word j of a template votes for diagonal i - j. Votes
are gathered by document, template and diagonal; diagonals of one template that lie within ``DRIFT`` of each other
are merged, which bridges words put in or left out; and a span counts if the template's pairs it holds, compared
word by word at the hit, make up the needed share of the template. Phrases need all of their pairs on one diagonal.

Everything is DataFrame operations. Each text is read once; every document also sends one row that matches a marker
entry of the template table, so documents without a hit come through the same shuffle and nothing is joined back.
Only hits and those rows are shuffled, by document, once. The template table is a constant of this module.

* null text: no words. Texts are cut at ASCII other than letters and digits; only A-Z are lower-cased.
* repeated rows: one output row each; rows that share an id but not their text stay apart; null ids are kept.
* very long texts: memory in proportion to the text; empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from assayer.functions.columns import quoted
from assayer.llm.common import query, table

#: Phrases that must stand whole: (words, label).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices found by the share of their word pairs; fixed values, from the licenses' own texts.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the "
     "rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit-text"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at",
     "apache-2.0-text"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation either version 3 of the license or at your option "
     "any later version", "gpl-3.0-text"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("released under the mit license", "mit-notice"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd-text"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
)
NOTICE_SHARE = 0.7
#: Diagonals this close belong to one occurrence.
DRIFT = 2
K = 2
#: What a text is split at: ASCII that is neither digit nor lower-case letter.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The text's words. Two letters outside ASCII have lower-case forms in it; texts with them take the slower way."""
    body = F.coalesce(text, F.lit(""))
    low = F.when(body.rlike(r"[\u0130\u212A]"), F.translate(body, _UPPER, _LOWER)).otherwise(F.lower(body))
    return F.filter(F.split(low, BREAKS), lambda w: w != "")


def templates(spark: SparkSession, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """(hash, template, place, first, second, pairs, whole, label): a row for every word pair, and the marker row."""
    rows = ["(CAST(0 AS BIGINT), -1, 0, '', '', 0, true, '')"]
    for t, (text, label) in enumerate([*phrases, *notices]):
        w = text.split()
        for j in range(len(w) - K + 1):
            rows.append(
                f"(xxhash64(xxhash64('{w[j]}'), xxhash64('{w[j + 1]}')), {t}, {j}, '{w[j]}', '{w[j + 1]}', "
                f"{len(w) - K + 1}, {str(t < len(phrases)).lower()}, '{label}')"
            )
    return spark.sql(
        f"SELECT * FROM VALUES {', '.join(rows)} AS t(hash, template, place, first, second, pairs, whole, label)"
    )


def hits(df: DataFrame, template_rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a verified hit (key, __text, n_words, template, ..., at), and one marker row a document."""
    known = [r["hash"] for r in template_rows.select("hash").distinct().collect()]  # of a constant table
    cut = df.select(quoted(key).alias("__key"), F.xxhash64(quoted(text)).alias("__text"), words(quoted(text)).alias("__words"))
    coded = cut.select("__key", "__text", "__words", F.transform("__words", lambda w: F.xxhash64(w)).alias("__codes"))

    def rolling(i: Column) -> Column:
        return F.xxhash64(F.get("__codes", i), F.get("__codes", i + 1))

    # Pairs that no template has would not survive the join; dropping them before they become rows saves the rows.
    wanted = F.filter(F.sequence(F.lit(0), F.size("__codes") - K), lambda i: rolling(i).isin(known))
    placed = coded.select(
        "__key", "__text", "__words", "__codes",
        F.when(F.size("__codes") >= K, wanted).otherwise(F.array().cast("array<int>")).alias("__wanted"),
    )
    marks = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).cast("bigint").alias("h"), F.lit("").alias("a"), F.lit("").alias("b")))
    cells = F.transform(
        "__wanted",
        lambda i: F.struct(i.alias("at"), rolling(i).alias("h"), F.get("__words", i).alias("a"), F.get("__words", i + 1).alias("b")),
    )
    rows = placed.select(
        "__key", "__text", F.size("__words").cast("bigint").alias("n_words"), F.concat(marks, cells).alias("__cells")
    )
    # The outer form: the plain one adds a filter on the array's size, which is pushed down and computes it again.
    rows = rows.select("__key", "__text", "n_words", F.inline_outer("__cells"))
    found = rows.join(F.broadcast(template_rows), F.col("h") == F.col("hash"))
    marker = F.col("template") < 0
    same = (F.col("a") == F.col("first")) & (F.col("b") == F.col("second"))
    return found.where((marker & (F.col("at") < 0)) | (~marker & (F.col("at") >= 0) & same)).select(
        "__key", "__text", "n_words", "template", "place", "pairs", "whole", "label", F.col("at").cast("bigint").alias("at")
    )


def spans(found: DataFrame) -> DataFrame:
    """Diagonals with their votes, merged: (document, template, start, end, share, whole, label)."""
    doc = ["__key", "__text", "n_words"]
    own = [*doc, "template", "label", "whole", "pairs"]
    # A marker row's diagonal counts the document's repetitions instead of votes.
    votes = found.groupBy(*own, (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.count("*").alias("n")
    )
    order = Window.partitionBy("__key", "__text", "template").orderBy("diagonal")
    apart = F.col("whole") | (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT)
    marked = votes.withColumn("__new", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0))
    run = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = marked.withColumn("__run", run).groupBy(*own, "__run").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("diagonal").alias("low"),
        F.max("diagonal").alias("high"), F.max("n").alias("n"),
    )
    share = F.when(F.col("pairs") > 0, F.size("places") / F.col("pairs")).otherwise(F.lit(1.0))
    return merged.select(
        *doc, "template", "label", "whole", "n", "low",
        (F.col("high") + F.col("pairs") + K - 1).alias("end"), share.alias("share"),
    )


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: counts and places of the phrases, labels, and the spans behind them."""
    found = spans(hits(df, templates(df.sparkSession), key, text))
    marker = F.col("template") < 0
    base = ~marker & F.col("whole") & (F.col("share") >= 1)
    labelled = base | (~marker & ~F.col("whole") & (F.col("share") >= NOTICE_SHARE))

    def names(which: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")

    span = F.struct("label", F.greatest("low", F.lit(0)).alias("start"), "end", "share")
    return (
        found.groupBy("__key", "__text", "n_words").agg(
            F.max(F.when(marker, F.col("n"))).alias("__copies"),
            F.sum(base.cast("bigint")).alias("n_base"),
            F.min(F.when(base, F.col("low"))).alias("first_word"), F.max(F.when(base, F.col("low"))).alias("last_word"),
            names(base).alias("base_labels"), names(labelled).alias("labels"),
            F.max(F.when(marker | ~(labelled | ~F.col("whole")), 0.0).otherwise(F.col("share"))).alias("score"),
            F.sort_array(F.collect_list(F.when(labelled, span))).alias("spans"),
        )
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))))
        .select(F.col("__key").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    )


def oracle() -> str:
    rows = []
    for t, (text, label) in enumerate([*PHRASES, *NOTICES]):
        w = text.split()
        rows += [
            f"({t}, {j}, '{w[j]}', '{w[j + 1]}', {len(w) - K + 1}, {t < len(PHRASES)}, '{label}')"
            for j in range(len(w) - K + 1)
        ]
    return f"""
    WITH tpl(template, place, a, b, pairs, whole, label) AS (VALUES {', '.join(rows)}),
    cut AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    places AS (SELECT row_no, w, unnest(range(1, len(w))) AS i FROM cut),
    hit AS (SELECT p.row_no, t.*, p.i - 1 - t.place AS diagonal FROM places p JOIN tpl t ON p.w[p.i] = t.a AND p.w[p.i + 1] = t.b),
    votes AS (SELECT row_no, template, label, whole, pairs, diagonal, list(DISTINCT place) AS places FROM hit GROUP BY ALL),
    marked AS (SELECT *, CASE WHEN NOT whole AND diagonal - lag(diagonal) OVER o <= {DRIFT} THEN 0 ELSE 1 END AS fresh
      FROM votes WINDOW o AS (PARTITION BY row_no, template ORDER BY diagonal)),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY row_no, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM marked),
    spans AS (SELECT row_no, template, label, whole, min(diagonal) AS low,
        len(list_distinct(flatten(list(places)))) / pairs::DOUBLE AS share FROM runs GROUP BY row_no, template, label, whole, pairs, run),
    per AS (SELECT row_no,
        sum(CASE WHEN whole AND share >= 1 THEN 1 ELSE 0 END)::BIGINT AS n_base,
        min(CASE WHEN whole AND share >= 1 THEN low END)::BIGINT AS first_word,
        max(CASE WHEN whole AND share >= 1 THEN low END)::BIGINT AS last_word,
        coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole AND share >= 1), '') AS base_labels,
        coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= CASE WHEN whole THEN 1 ELSE {NOTICE_SHARE} END), '') AS labels,
        max(CASE WHEN whole AND share < 1 THEN 0.0 ELSE share END) AS score FROM spans GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 9)::DOUBLE AS score
    FROM cut LEFT JOIN per USING (row_no)"""


@query("op7_license_scan", oracle())
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
        F.round("score", 9).alias("score"),
    )
