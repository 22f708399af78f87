"""License scans by diagonal voting (DataFrame functions only).

Templates are short texts: phrases that must stand word for word, and notices that may
be changed a little.  Every run of ``k`` words of a document (three, or two for a
template of two words) is joined to the template positions with the same run; a match
votes for the diagonal of document position minus template position.  Votes are
aggregated by diagonal.  An inserted or missing word moves a notice to a neighbouring
diagonal, so diagonals of one template at most ``band`` apart are merged.  The share of
a template's words that a diagonal or a merged band covers is its score; a band counts
only if the span that it takes in the document is about as long as the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .decontam import item_words

#: The phrases of the base and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Openings of public licenses and their usual notices, with labels.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

RUN, BAND, LEAST, STRETCH = 3, 3, 0.8, 1.5
TEMPLATE = "template int, label string, text string, exact boolean"


def templates(spark: SparkSession, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """(template, label, text, exact) of phrases and notices."""
    rows = [(label, text, True) for text, label in phrases.items()] + [(label, text, False) for label, text in notices]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], TEMPLATE)


def _third(words: Column, at: Column, k: Column) -> Column:
    return F.when(k > 2, F.get(words, at + 2))


def _runs(temps: DataFrame) -> DataFrame:
    """(template, label, exact, size, k, runs, off, key, g0, g1, g2): the runs of all templates; those of fewer than two words have none."""
    words = temps.select("template", "label", "exact", item_words(F.col("text")).alias("w")).where("size(w) > 1")
    sized = words.select("*", F.size("w").alias("size"), F.least(F.lit(RUN), F.size("w")).alias("k"))
    runs = sized.select("*", (F.col("size") - F.col("k") + 1).alias("runs"), F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))).alias("off"))
    g0, g1 = F.get("w", F.col("off")), F.get("w", F.col("off") + 1)
    return runs.select("template", "label", "exact", "size", "k", "runs", "off", F.xxhash64(g0, g1).alias("key"), g0.alias("g0"), g1.alias("g1"), _third(F.col("w"), F.col("off"), F.col("k")).alias("g2"))


def _covered(offs: Column) -> Column:
    """How many words of a template its runs at ``offs`` cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(offs, lambda o: F.sequence(o, o + F.col("k") - 1)))))


def diagonals(docs: DataFrame, temps: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_runs: int = 100_000) -> DataFrame:
    """(id, th, template, label, exact, size, k, runs, diag, offs): the template positions that vote for each diagonal.

    ``th`` is the hash of the text, so rows that repeat an id keep their own votes.  The
    templates' runs are broadcast up to ``broadcast_runs`` of them, else shuffled.
    """
    runs = _runs(temps)
    near = F.broadcast if runs.count() <= broadcast_runs else (lambda df: df)
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), item_words(F.col(text_col)).alias("words"))
    at = keyed.select("id", "th", "words", F.posexplode("words").alias("pos", "w0"))
    at = at.select("id", "th", "pos", "w0", F.get("words", F.col("pos") + 1).alias("w1"), F.get("words", F.col("pos") + 2).alias("w2"))
    same = (F.xxhash64("w0", "w1") == F.col("key")) & (F.col("w0") == F.col("g0")) & (F.col("w1") == F.col("g1")) & (F.col("g2").isNull() | (F.col("g2") == F.col("w2")))
    votes = at.where("w1 is not null").join(near(runs), same)
    of = ["id", "th", "template", "label", "exact", "size", "k", "runs"]
    return votes.groupBy(*of, (F.col("pos") - F.col("off")).alias("diag")).agg(F.array_sort(F.collect_set("off")).alias("offs"))


def license_spans(diags: DataFrame, band: int = BAND, stretch: float = STRETCH) -> DataFrame:
    """(id, th, template, label, exact, start, end, score): spans of merged diagonals, as words [start, end), with the share of the template they cover."""
    of = ["id", "th", "template", "label", "exact", "size", "k"]
    order = Window.partitionBy("id", "th", "template").orderBy("diag")
    jump = F.coalesce(F.col("diag") - F.lag("diag").over(order) > band, F.lit(True)).cast("int")
    banded = diags.withColumn("jump", jump).withColumn("band", F.sum("jump").over(order))
    begin, end = F.col("diag") + F.get("offs", F.lit(0)), F.col("diag") + F.element_at("offs", -1) + F.col("k")
    merged = banded.groupBy(*of, "band").agg(
        F.min(begin).alias("start"), F.max(end).alias("end"), F.array_distinct(F.flatten(F.collect_list("offs"))).alias("offs"),
        F.max(F.struct(_covered(F.col("offs")).alias("n"), begin.alias("start"), end.alias("end"))).alias("one"),
    )
    fits = (F.col("end") - F.col("start") <= F.col("size") * stretch) & (_covered(F.col("offs")) >= F.col("one.n"))
    covered = F.when(fits, _covered(F.col("offs"))).otherwise(F.col("one.n"))
    pick = lambda c: F.when(fits, F.col(c)).otherwise(F.col(f"one.{c}")).cast("long").alias(c)
    return merged.select("id", "th", "template", "label", "exact", pick("start"), pick("end"), (covered / F.col("size")).alias("score"))


def license_scan(docs: DataFrame, temps: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, band: int = BAND, **options) -> DataFrame:
    """Return (id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs``.

    ``n_base`` counts the places where a phrase stands, ``first_word`` and ``last_word``
    are the least and greatest start of them (words from 0, null without one).
    ``labels`` adds those of notices with a score of ``least`` or more; ``score`` is the
    greatest of any template.  Label lists are distinct, sorted and joined by commas.

    A null or empty text has no words and a score of 0.  Rows that repeat an id get
    equal results if their texts are equal, else their own.  Other columns are ignored.
    An empty table gives an empty table; without templates all documents have no label.
    """
    temps = templates(docs.sparkSession) if temps is None else temps
    diags = written(diagonals(docs, temps, id_col, text_col, **options), "diagonals")
    base = diags.where(F.col("exact") & (F.size("offs") == F.col("runs"))).select("id", "th", "label", F.lit(1.0).alias("score"), F.col("diag").cast("long").alias("place"))
    spans = license_spans(diags, band).select("id", "th", F.when(~F.col("exact") & (F.col("score") >= least), F.col("label")).alias("label"), "score", F.lit(None).cast("long").alias("place"))
    based = F.when(F.col("place").isNotNull(), F.col("label"))
    found = base.unionByName(spans).groupBy("id", "th").agg(
        F.count("place").alias("n_base"), F.min("place").alias("first_word"), F.max("place").alias("last_word"), F.max("score").alias("score"),
        F.array_join(F.array_sort(F.collect_set(based)), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
    ).withColumnsRenamed({"id": "i", "th": "t"})
    all_docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.greatest(F.coalesce(F.size(item_words(F.col(text_col))), F.lit(0)), F.lit(0)).cast("long").alias("n_words"))
    out = all_docs.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
