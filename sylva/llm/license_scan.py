"""License scans by diagonal voting.

Every rolling word k-gram of every text is joined in Spark to the positions of the same k-gram in the license
templates. A match votes for the diagonal (place in text less place in template); neighbouring diagonals merge, as a
changed word shifts what follows it. A match counts only if its words are the template's word for word, and a merged run is
kept when the template words that its matches cover make a large enough share of the template.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, flat_bytes, slices, strings, tidy

#: The phrases whose places are always reported, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Usual notices of public licenses, (label, notice).
TEMPLATES = [
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc-by", "You are free to share, copy and redistribute the material in any medium or format, and to adapt, remix, transform, and build upon the material for any purpose, even commercially"),
]

_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_PHRASE = re.compile(
    rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(b"(" + _GAP.join(p.encode().split()) + b")" for p in PHRASES) + rb")(?![0-9a-z\x80-\xff])"
)
_LABELS = list(PHRASES.values())


def gram_words(words: Words, texts: pa.Array, at: np.ndarray, k: int) -> list[str]:
    """The k words that begin at each of the given words of a batch, lower-cased, with blanks between."""
    raw = flat_bytes(texts)[0]
    return [" ".join(raw[a:b].tobytes().lower().decode("utf-8", "replace") for a, b in zip(words.start[i : i + k].tolist(), words.end[i : i + k].tolist())) for i in at.tolist()]


def template_grams(spark: SparkSession, k: int, templates: list[tuple[str, str]]) -> tuple[DataFrame, np.ndarray]:
    """(gram, tpl, label, tpos, tpl_words, tpl_said): at most as many rows as the templates have words; and the grams, sorted."""
    texts = strings(pa.array([t for _, t in templates]))
    words = Words(texts)
    of, at, h = words.grams(k)
    n = words.counts()
    said = gram_words(words, texts, at + words.of_text[of], k)
    rows = [(int(g), int(t), templates[t][0], int(p), int(n[t]), x) for t, p, g, x in zip(of, at, h.view(np.int64), said)]
    return spark.createDataFrame(rows, "gram long, tpl int, label string, tpos int, tpl_words int, tpl_said string"), np.unique(h)


def _scan(k: int, known: np.ndarray):
    """For each text a row with its base places (pos -1), then a row for each of its k-grams; those whose hash is one of
    ``known`` carry their words."""

    def run(batches):
        for whole in batches:
            for batch, texts in slices(whole, "text"):
                words = Words(texts)
                row = np.asarray(batch.column("row").to_numpy(zero_copy_only=False), np.int64)
                counts, n = words.counts(), len(row)
                places, labels, low, high = np.zeros(n, np.int64), [""] * n, np.full(n, -1), np.full(n, -1)
                for i, text in enumerate(texts.to_pylist()):
                    b = text.encode().lower()
                    if b"license" not in b and b"cc" not in b:
                        continue
                    starts = words.start[words.of_text[i] : words.of_text[i + 1]] - words.offsets[i]
                    if found := [(m.start(), _LABELS[m.lastindex - 1]) for m in _PHRASE.finditer(b)]:
                        at = np.searchsorted(starts, [s for s, _ in found])
                        places[i], low[i], high[i], labels[i] = len(found), at.min(), at.max(), ",".join(sorted({x for _, x in found}))
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), pa.array(np.full(n, -1, np.int32)), none, pa.array(counts), pa.array(places), pa.array(low), pa.array(high), pa.array(labels), pa.nulls(n, pa.string())],
                    ["row", "pos", "gram", "n_words", "n_base", "low", "high", "base_labels", "said"],
                )
                of, at, h = words.grams(k)
                for s in range(0, len(of), 1 << 18):
                    t = slice(s, s + (1 << 18))
                    m = len(of[t])
                    none = pa.nulls(m, pa.int64())
                    place = np.minimum(np.searchsorted(known, h[t]), max(0, len(known) - 1))
                    hit = np.flatnonzero(known[place] == h[t]) if len(known) else np.zeros(0, np.int64)
                    which = np.full(m, -1)
                    which[hit] = np.arange(len(hit))
                    said = pa.array(gram_words(words, texts, at[t][hit] + words.of_text[of[t][hit]], k), pa.string()).take(pa.array(which, mask=which < 0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row[of[t]]), pa.array(at[t].astype(np.int32)), pa.array(h[t].view(np.int64)), none, none, none, none, pa.nulls(m, pa.string()), said],
                        ["row", "pos", "gram", "n_words", "n_base", "low", "high", "base_labels", "said"],
                    )

    return run


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, drift: int = 3, coverage: float = 0.6,
    templates: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per input row: n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``k``: words of a gram. ``drift``: diagonals at most this far apart merge. ``coverage``: share of a template's
    words that the matches must cover; ``score`` is the largest such share, 1 where a base phrase stands. ``spans``:
    the verified spans as (label, first word, last word, share). A null text counts as empty: no words, no labels,
    score 0. Rows are told apart by their place, so repeated rows, null or repeated ids give a row each.
    """
    spark, templates = docs.sparkSession, templates or TEMPLATES
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id")).alias("key"), F.col(text_col).cast("string").alias("text"))
    grams = rows.select(F.col("key.id").alias("id"), F.col("key.row").alias("row"), "text")
    ids = grams.schema["id"].dataType.simpleString()
    out = f"id {ids}, row long, pos int, gram long, n_words long, n_base long, low long, high long, base_labels string, said string"
    templates_at, hashes = template_grams(spark, k, templates)
    scan = _scan(k, hashes)

    def with_id(batches):
        for whole in batches:
            number = whole.column("row").to_numpy(zero_copy_only=False)
            for part in scan([whole.select(["row", "text"])]):
                if part.column("gram").null_count == len(part):  # the rows of the texts themselves carry the id
                    at = np.searchsorted(number, part.column("row").to_numpy())
                    yield pa.RecordBatch.from_arrays([whole.column("id").take(pa.array(at)), *part.columns], ["id", *part.schema.names])
                else:
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(part), whole.schema.field("id").type), *part.columns], ["id", *part.schema.names])

    grams = grams.mapInArrow(tidy(with_id), out)
    known = F.broadcast(templates_at)  # as many rows as the templates have words
    # a match counts if its words are the template's, not just their hash
    hits = grams.join(known, "gram", "left").where((F.col("pos") < 0) | (F.col("said") == F.col("tpl_said"))).repartition("row")
    diagonals = hits.groupBy("row", "tpl", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.first("id", True).alias("id"), F.max("n_words").alias("n_words"), F.max("n_base").alias("n_base"), F.max("low").alias("low"), F.max("high").alias("high"),
        F.max("base_labels").alias("base_labels"), F.first("label").alias("label"), F.first("tpl_words").alias("tpl_words"),
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("tpos").alias("covered"),
    )
    by = Window.partitionBy("row", "tpl").orderBy("first", "diagonal")
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(by)) > drift) | (F.col("first") - F.lag("last").over(by) > drift + k)
    merged = (
        diagonals.withColumn("run", F.sum(F.when(apart, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "tpl", "run")
        .agg(
            F.first("id", True).alias("id"), *[F.max(c).alias(c) for c in ("n_words", "n_base", "low", "high", "base_labels", "label", "tpl_words")],
            F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"),
        )
    )
    words = F.size(F.array_distinct(F.flatten(F.transform("covered", lambda p: F.sequence(p, p + (k - 1))))))
    verified = merged.withColumn("share", F.when(F.col("tpl").isNotNull(), words / F.col("tpl_words"))).withColumn("ok", F.coalesce(F.col("share") >= coverage, F.lit(False)))
    per_text = verified.groupBy("row").agg(
        F.first("id", True).alias("id"), *[F.max(c).alias(c) for c in ("n_words", "n_base", "low", "high", "base_labels")],
        F.max(F.when(F.col("ok"), F.col("share"))).alias("best"),
        F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct("label", "first", (F.col("last") + (k - 1)).alias("last"), "share")))).alias("spans"),
    )
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    return per_text.select(
        F.col("id").alias(id_col), "n_words", "n_base",
        F.when(F.col("n_base") > 0, F.col("low")).alias("first_word"), F.when(F.col("n_base") > 0, F.col("high")).alias("last_word"),
        "base_labels",
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(base, F.transform("spans", lambda s: s["label"]))))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.to_json("spans").alias("spans"),
    )
