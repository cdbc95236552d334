"""License scans by diagonal voting.

Every rolling word k-gram hash of every text is matched with the templates'
k-gram positions in a Spark join; matches vote for their diagonal (position in
the text minus position in the template), neighbouring diagonals are merged
across small edits, and a merged span is verified by the share of the template's k-grams
that it holds and by its density.  A small Bloom filter of the templates' hashes
sits before the join, as a runtime filter: it spares the join the k-grams that
no template has.  Base phrases are found as exact runs of words.

Defined results: null text counts as empty: no words, no labels, null first and
last word, score 0; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .scratch import materialize

K, BLOOM_BITS, MAX_SHIFT = 4, 1 << 20, 3
#: Least share of a template's k-grams in a span, and least share of a span's k-grams that match.
MIN_COVER, MIN_DENSITY = 0.6, 0.5
# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices of public licenses.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _words(texts: list[str]) -> W.Words:
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    return W.Words(data, np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64))


def template_table(templates=TEMPLATES, k: int = K) -> list[tuple[int, int, str, int, int]]:
    """(hash, template, label, position, number of k-grams) of every k-gram of every template."""
    w = _words([t for _, t in templates])
    at, h = w.grams(k)
    row = w.row[at]
    n = np.bincount(row, minlength=len(templates))
    return [(int(x), int(r), templates[r][0], int(i - w.first[r]), int(n[r])) for i, x, r in zip(at, W.as_long(h), row, strict=True)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(row, doc_id, n_words, n_base, first_word, last_word, base_labels, hits): one pass over all texts, written once.

    ``hits`` are (position, hash) of the k-grams that pass the templates' Bloom filter.
    """
    p = _words(list(phrases))
    runs = [p.hash[p.first[i] : p.first[i + 1]] for i in range(len(phrases))]
    labels = list(phrases.values())
    bloom = np.zeros(BLOOM_BITS, dtype=bool)
    bloom[np.array([h for h, *_ in template_table(templates, k)], dtype=np.int64).view(np.uint64) % np.uint64(BLOOM_BITS)] = True
    hits = T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("gram", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")), T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("hits", hits)])

    def find(batches):
        for batch in batches:
            for low, high, data, offsets in W.blocks(batch.column(1)):
                n, w = high - low, W.Words(data, offsets)
                counts, first, last, names = np.zeros(n, dtype=np.int64), np.full(n, 1 << 60), np.full(n, -1), [set() for _ in range(n)]
                for run, label in zip(runs, labels, strict=True):
                    m = len(w.hash) - len(run) + 1
                    if m <= 0:
                        continue
                    ok = w.hash[:m] == run[0]
                    for i in range(1, len(run)):
                        ok &= w.hash[i : m + i] == run[i]
                    at = np.flatnonzero(ok)
                    at = at[w.row[at] == w.row[at + len(run) - 1]]
                    r, pos = w.row[at], at - w.first[w.row[at]]
                    np.add.at(counts, r, 1)
                    np.minimum.at(first, r, pos)
                    np.maximum.at(last, r, pos)
                    for i in np.unique(r).tolist():
                        names[i].add(label)
                at, h = w.grams(k)
                some = bloom[h % np.uint64(BLOOM_BITS)]
                at, h = at[some], h[some]
                r = w.row[at]
                ends = np.searchsorted(r, np.arange(n + 1)).astype(np.int32)
                none = counts == 0
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, n), pa.array(w.counts()), pa.array(counts), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                    pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(at - w.first[r]), pa.array(W.as_long(h))], ["pos", "gram"])),
                ], names=schema.names)

    found = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(find, schema)
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "scan")


def vote(scanned: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(row, template, label, start, end, cover): verified spans, in words."""
    spark = scanned.sparkSession
    table = spark.createDataFrame(template_table(templates, k), "gram long, template int, label string, place int, size int")
    grams = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("x")).select("row", "x.pos", "x.gram")
    # the table is a constant of the code: some hundred rows
    votes = grams.join(F.broadcast(table), "gram").withColumn("diagonal", F.col("pos") - F.col("place"))
    diagonals = votes.groupBy("row", "template", "label", "size", "diagonal").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.collect_set("place").alias("places"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order)) > MAX_SHIFT, F.lit(True))
    merged = diagonals.withColumn("new", new.cast("int")).withColumn("part", F.sum("new").over(order))
    spans = merged.groupBy("row", "template", "label", "size", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("seen"))
    cover = F.col("seen") / F.col("size")
    spans = spans.withColumn("cover", cover).where((F.col("cover") >= MIN_COVER) & (F.col("seen") / (F.col("end") - F.col("start") + 1) >= MIN_DENSITY))
    return spans.select("row", "template", "label", "start", (F.col("end") + k).alias("end"), "cover")


def report(docs: DataFrame, **options) -> DataFrame:
    scanned = scan(docs, **options)
    voted = vote(scanned).groupBy("row").agg(F.collect_set("label").alias("voted"), F.max("cover").alias("cover"))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("voted", none)))
    return scanned.join(voted, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )
