"""License scans by diagonal voting.

Every word k-gram hash of a text is joined with the positions of that k-gram in the
license templates. Hits vote for (template, diagonal), the diagonal being text position
minus template position. Diagonals at most DRIFT apart are merged (words were put in, left
out or changed), and the merged span is verified: the template's words that its k-grams
cover, against the words of the template or of the span, whichever are more. Since its
diagonals lie so near each other, a span is no longer than its template and DRIFT words,
and keeps the template's order as far. Of spans that begin near each other the best counts,
so that of licenses that differ in a word only the one that is meant is named."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.wordhash import ALNUM_SEPARATORS, Tokenizer, chunks

K = 3
#: Diagonals this far apart belong to one span; spans that begin so near each other are rivals.
DRIFT = 8
#: Share of the words that a span must hold.
LEAST = 0.8

# Phrases that name a license, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Passages of well-known licenses and notices, with the labels that they get.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("eupl-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence."),
    ("mit-warranty", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
]

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same words before lower-casing, for Java.
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def template_rows() -> list[tuple[int, str, bool, int, int, int, str]]:
    """(template, label, whether only whole places count, number of k-grams, position, hash, k-gram)."""
    tok, out = Tokenizer(ALNUM_SEPARATORS), []
    for i, (label, text, exact) in enumerate([*((v, k, True) for k, v in PHRASES.items()), *((a, b, False) for a, b in TEMPLATES)]):
        raw = text.encode()
        words = tok.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        hashes, ok = words.grams(K)
        said = words_of(text)
        n = int(ok.sum())
        out += [(i, label, exact, n, j, int(h.astype(np.int64)), " ".join(said[j : j + K])) for j, h in enumerate(hashes[:n])]
    return out


def grams(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep, n_words, hashes (array of every k-gram's hash by position) and seen: the k-grams themselves at the
    positions whose hash is also a template's, for the comparison that follows the join."""
    wanted = np.unique(np.array([r[5] for r in template_rows()], np.int64))
    spark_types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer(ALNUM_SEPARATORS)
        for batch in batches:
            for at, data, offsets in chunks(batch.column(0)):
                n = len(offsets) - 1
                w = tok.words(data, offsets)
                hashes, ok = w.grams(K)
                signed = hashes.view(np.int64)
                ends = np.maximum(w.first[1:] - (K - 1), w.first[:-1])
                sizes = ends - w.first[:-1]
                flat = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(flat, pa.int32()), pa.array(signed[ok], pa.int64()))
                hits = np.flatnonzero(ok & np.isin(signed, wanted))
                said = [b" ".join(data[w.start[j] : w.end[j]].tobytes().lower() for j in range(i, i + K)).decode(errors="replace") for i in hits]
                text = np.searchsorted(w.first, hits, "right") - 1
                seen = pa.MapArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), pa.array(hits - w.first[text], pa.int32()), pa.array(said, pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i + 1).slice(at, n) for i in range(len(keep))), pa.array(np.diff(w.first), pa.int64()), lists, seen], names=[*keep, "n_words", "hashes", "seen"])

    return df.select(F.col(text_col), *keep).mapInArrow(run, f"{spark_types}, n_words long, hashes array<long>, seen map<int,string>")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_rows(), "template int, label string, exact boolean, n_grams int, tpos int, hash long, gram string")


def spans(hits: DataFrame, key: str) -> DataFrame:
    """From (key, template, label, exact, n_grams, pos, tpos): the verified spans (key, label, exact, first, end, score),
    words first to end. A phrase's span is a diagonal that all its k-grams vote for; a template's is what the diagonals
    from one to DRIFT further hold together."""
    by = [key, "template", "label", "exact", "n_grams"]
    votes = hits.withColumn("diagonal", F.col("pos") - F.col("tpos")).groupBy(*by, "diagonal").agg(F.collect_set("tpos").alias("tposes"))
    whole = votes.where(F.col("exact") & (F.size("tposes") == F.col("n_grams"))).select(key, "label", "exact", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("n_grams") + K - 1).alias("end"), F.lit(1.0).alias("score"))
    near = Window.partitionBy(key, "template").orderBy("diagonal").rangeBetween(0, DRIFT)
    words = F.size(F.array_distinct(F.flatten(F.transform("held", lambda t: F.sequence(t, t + K - 1)))))
    merged = (
        votes.where(~F.col("exact"))
        .withColumn("held", F.array_distinct(F.flatten(F.collect_list("tposes").over(near))))
        .withColumn("first", F.min(F.col("diagonal") + F.array_min("tposes")).over(near))
        .withColumn("end", F.max(F.col("diagonal") + F.array_max("tposes") + K).over(near))
        .withColumn("score", words / F.greatest(F.col("n_grams") + K - 1, F.col("end") - F.col("first")))
        .where(F.col("score") >= LEAST)
    )
    rivals = Window.partitionBy(key).orderBy("first").rangeBetween(-DRIFT, DRIFT)
    best = merged.withColumn("best", F.max("score").over(rivals)).where(F.col("score") == F.col("best"))
    return whole.unionByName(best.select(key, "label", "exact", "first", "end", "score"))


def scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of df: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label,
    first word and end of the licenses' texts, comma-joined).

    Places and labels hang on a digest of the text, so repeated rows and null ids get their own rows and
    equal texts equal ones. Null and empty texts have no words. Other columns are not read."""
    spark = df.sparkSession
    rows = grams(df.select(F.col(text_col), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_key")), text_col, ["_key"])
    t = F.broadcast(templates(spark))  # a fixed list of some 350 rows
    hits = rows.select("_key", "seen", F.posexplode("hashes").alias("pos", "hash")).join(t, "hash").where(F.element_at("seen", F.col("pos")) == F.col("gram"))
    found = spans(hits.select("_key", "template", "label", "exact", "n_grams", "pos", "tpos"), "_key")
    base = F.when(F.col("exact"), F.col("first"))
    labels = found.groupBy("_key").agg(
        F.count(base).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("exact"), F.concat_ws(":", "label", "first", "end")))), ",").alias("spans"),
    )
    return (
        df.select(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"))
        .join(labels, "_key", "left")
        .select(id_col, "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", F.lit("")).alias("spans"))
    )
