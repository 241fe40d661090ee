"""License texts in documents, found by diagonal voting.

Every four words in a row of every document are hashed and joined with the places of such hashes in the templates. A match
votes for a template and an offset, the document's place less the template's: a diagonal. Votes are counted by diagonal,
diagonals next to each other are merged, as inserted or lost words shift a text by few words, each place of the template counted
once, and the stretch that a merged diagonal covers is held against the template's words in their order (longest common subsequence).

Equal texts are one: votes are held by a 128-bit key of the text and joined back to the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

GRAM = 4
#: Diagonals so far apart at most are merged; a stretch needs so many percent of its template's hashes.
NEAR, PERCENT = 4, 60
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that name a licence by themselves, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Customary notices of common licences, by label.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("lgpl-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def words(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z lower-cased; null: none."""
    return F.array_remove(F.split(shared.lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def templates(spark: SparkSession, listed: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Rows (template, label, w, grams) of templates of GRAM words at least."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(listed)], "template int, label string, text string")
    split = rows.select("template", "label", words(F.col("text")).alias("w")).where(F.size("w") >= GRAM)
    return split.withColumn("grams", shared.grams(F.col("w"), GRAM))


def phrase_places(w: str) -> dict[str, Column]:
    """For each phrase the array of places in array w where its words stand in a row."""
    out = {}
    for phrase in PHRASES:
        parts = phrase.split(" ")
        here = " and ".join(f"get({w}, i + {j}) = '{part}'" for j, part in enumerate(parts))
        # a phrase's first word is looked for at first, so most texts end here
        out[phrase] = F.expr(f"case when array_contains({w}, '{parts[0]}') and array_contains({w}, '{parts[-1]}') then filter(sequence(0, size({w}) - 1), i -> {here}) else array() end")
    return out


def _measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row for each of docs: doc_id, k1, k2, n_words, n_base, first_word, last_word, base (array of labels)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit("key"), whole).alias("k2"), words(F.col(text)).alias("w"))
    places = phrase_places("w")
    rows = rows.select("doc_id", "k1", "k2", F.size("w").cast("long").alias("n_words"), *(c.cast("array<int>").alias(f"p{i}") for i, c in enumerate(places.values())))
    every = F.flatten(F.array(*(F.col(f"p{i}") for i in range(len(places)))))
    base = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(PHRASES[p])) for i, p in enumerate(places))))
    return rows.select("doc_id", "k1", "k2", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), base.alias("base"))


def votes(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Rows (k1, k2, template, diagonal, places, low, high): the template's places with matching hashes by diagonal, from place low to high of the text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit("key"), whole).alias("k2"), words(F.col(text)).alias("w"))
    rolled = keyed.select("k1", "k2", shared.grams(F.col("w"), GRAM).alias("grams")).select("k1", "k2", F.posexplode_outer("grams").alias("pos", "g"))
    places = known.select("template", F.posexplode("grams").alias("at", "g"))
    met = rolled.join(shared.small(places), "g").withColumn("diagonal", F.col("pos") - F.col("at"))
    # a template bounds the set of its places; copies of a text give the same ones
    return met.groupBy("k1", "k2", "template", "diagonal").agg(F.collect_set("at").alias("places"), F.min("pos").alias("low"), F.max("pos").alias("high"))


def stretches(counted: DataFrame) -> DataFrame:
    """Rows (k1, k2, template, hits, low, high): diagonals of one text and template merged that are NEAR each other and overlap.

    Diagonals are put into bands first, by the distance to the next one, and each band is parted by place then: votes of a gram that
    the template repeats lie on diagonals far off, and don't stand between two parts of a band.
    """
    by = ["k1", "k2", "template"]
    across = Window.partitionBy(*by).orderBy("diagonal")
    counted = counted.withColumn("__far", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(across) > NEAR, F.lit(False)).cast("int"))
    counted = counted.withColumn("band", F.sum("__far").over(across.rowsBetween(Window.unboundedPreceding, 0))).drop("__far")
    order = Window.partitionBy(*by, "band").orderBy("low", "diagonal")
    reached = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = reached.isNull() | (F.col("low") > reached + GRAM + NEAR)
    marked = counted.withColumn("__new", apart.cast("int"))
    marked = marked.withColumn("part", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = [*by, "band", "part"]
    at = marked.groupBy(*part).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    hits = marked.select(*part, F.explode("places").alias("at")).groupBy(*part).agg(F.count_distinct("at").alias("hits"))
    return at.join(hits, part).drop("band", "part")


def common(left: list, right: list) -> int:
    """The length of the longest common subsequence of two lists of words."""
    codes: dict = {}
    x, y = (np.array([codes.setdefault(w, len(codes)) for w in part], np.int64) for part in (left, right))
    best = np.zeros(len(y) + 1, np.int64)
    for w in x:  # row by row: a match lengthens the best one before it, and the best so far is carried to the right
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(y == w, best[:-1] + 1, 0)))
    return int(best[-1])


def common_column(left: Column, right: Column) -> Column:
    """common() of two columns, in Arrow batches."""

    @F.pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([common(list(a), list(b)) for a, b in zip(x, y)], dtype="int64")

    return run(left, right)


def scan(docs: DataFrame, listed: list[tuple[str, str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows of docs measured, and spans (k1, k2, label, first_word, end_word, score) of templates verified in their texts.

    score: of the template's words, the share that the stretch has in their order, times the share of the stretch's words that are
    those; at least PERCENT.
    """
    known, _ = shared.write_table(templates(docs.sparkSession, listed), "templates")
    measured, _ = shared.write_table(_measured(docs, doc_id, text), "measured")
    found, _ = shared.write_table(stretches(votes(docs, known, text)), "stretches")
    sized = found.join(F.broadcast(known.select("template", "label", "w", F.size("grams").alias("n"))), "template").where(100 * F.col("hits") >= PERCENT * F.col("n"))
    # verification reads the words of the texts that have such stretches
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit("key"), whole).alias("k2"), F.col(text).alias("text"))
    keys = sized.select("k1", "k2").distinct()
    own = texts.join(shared.small(keys), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("k1", "k2", words(F.col("text")).alias("words"))
    span = own.join(sized, ["k1", "k2"]).withColumn("span", F.slice("words", F.col("low") + 1, F.col("high") - F.col("low") + GRAM)).drop("words")
    # copies repeat a template without end: a stretch far longer than it can't reach PERCENT
    short = span.where(PERCENT * F.size("span") <= 100 * F.size("w"))
    both = short.withColumn("common", common_column(F.col("span"), F.col("w")))
    scored = both.withColumn("score", F.round(F.col("common") / F.size("w") * F.col("common") / F.size("span"), 6)).where(100 * F.col("score") >= PERCENT)
    return measured, scored.select("k1", "k2", "label", F.col("low").cast("long").alias("first_word"), (F.col("high") + GRAM).cast("long").alias("end_word"), "score")


def licenses(docs: DataFrame, listed: list[tuple[str, str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of PHRASES, first_word and last_word are the first and the last of them; base_labels are theirs, labels
    those and the labels of verified templates, distinct, sorted and joined by commas (none: an empty string). score is the
    best of a template, or 1 where there is none but a phrase, else 0. A null or empty text has no words. Repeated rows stay; rows
    of equal texts have equal results; doc_id may be null. An empty table gives an empty table.
    """
    measured, spans = scan(docs, listed, doc_id, text)
    best = spans.groupBy("k1", "k2").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    best, _ = shared.write_table(best, "licenses")
    other = shared.small(best.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}))
    rows = measured.join(other, (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")), "left")
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    every = F.concat("base", F.coalesce("found", F.array().cast("array<string>")))
    score = F.coalesce("best", F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(every).alias("labels"), score.alias("score"))
