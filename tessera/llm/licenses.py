"""License scan by diagonal voting.

Every run of K words of every text is hashed and joined to the places of the same hash in the license templates
(a table of fixed size, so it is broadcast; hashing is a numpy step over Arrow batches). A join row whose K words are
those of the template votes for the diagonal `word place - template place`; votes are counted by text, template and
diagonal. Diagonals next to each other (a few words put in or left out) are merged while their spans touch, and a
merged span is verified: the share of the template's runs that it holds, word by word, must reach `least`. A place
that verified spans of several labels hold goes to the best of them (score, then runs held, then the first label); a
span that keeps less than half of its places is dropped, so a notice is not named after another that it resembles.
A text's labels are those of its spans and of the fixed phrases that it holds.

Only rows that vote are shuffled, by text and template; rows of one text are few, whatever the corpus. Null or
empty texts have no words and no labels. Repeated rows have equal keys (id and text hash) and count each template
place once, so each gets the same result. An empty table gives no rows. Only the id of df and the columns made here
are returned, so other columns, whatever their names, do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tessera.llm.common import NOT_ALNUM, Words, slices, tidy

K = 3
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals up to this far apart can belong to one span.
NEAR = 4

# Phrases and the label of each.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of common license notices, by label.
TEMPLATES = [
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
]


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) words, from array functions."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower()), WORD_GAP), "")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text (the last column) and its runs: one hash for each word that begins K words in a row."""
    for whole in batches:
        for batch in slices(whole, "__text"):
            words = Words(batch.column(batch.num_columns - 1), lower=True, between=NOT_ALNUM)
            ends = np.cumsum(np.maximum(np.diff(words.bounds) - K + 1, 0), dtype=np.int64)
            values = pa.array(words.grams(K)[words.whole(K)].view(np.int64))
            runs = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values)
            yield pa.record_batch([*batch.columns, runs], names=[*batch.schema.names, "grams"])


def _runs(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, `words` and `grams`, the hashes of all K-word runs of the text in order."""
    own = df.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    hashed = own.mapInArrow(tidy(_hashed), StructType([*own.schema, StructField("grams", ArrayType(LongType()))]))
    return hashed.select(*keys, words_of(F.col("__text")).alias("words"), "grams")


def template_places(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """template, label, runs (in all), gram, template_place, run (its words): as many rows as the templates have words, at most."""
    rows = spark.createDataFrame([(k, label, text) for k, (label, text) in enumerate(templates)], "template int, label string, text string")
    runs = _runs(rows, ["template", "label"], "text").select("*", F.posexplode("grams").alias("template_place", "gram"))
    return runs.select("template", "label", F.size("grams").alias("runs"), "template_place", "gram", F.slice("words", F.col("template_place") + 1, K).alias("run"))


def license_spans(df: DataFrame, keys: list[str], templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.6, text: str = "text") -> DataFrame:
    """keys, template, label, first_word, last_word (of the span) and score, one row for each verified span."""
    places = template_places(df.sparkSession, templates)
    runs = _runs(df, keys, text).select(*keys, "words", F.posexplode("grams").alias("place", "gram"))
    same_words = F.slice("words", F.col("place") + 1, K) == F.col("run")
    votes = runs.join(F.broadcast(places), "gram").where(same_words)
    diagonals = votes.groupBy(*keys, "template", "label", "runs", (F.col("place") - F.col("template_place")).alias("diagonal")).agg(F.min("place").alias("first"), F.max("place").alias("last"), F.collect_set("template_place").alias("held"))
    order = Window.partitionBy(*keys, "template").orderBy("diagonal", "first")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    # A diagonal opens a new span where it is far from the one before or starts after all spans so far have ended.
    opens = (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR) | (F.col("first") > F.max("last").over(so_far) + K + NEAR)
    marked = diagonals.withColumn("__new", F.when(opens | F.lag("diagonal").over(order).isNull(), 1).otherwise(0))
    numbered = marked.withColumn("span", F.sum("__new").over(order)).withColumn("at", F.transform("held", lambda t: t + F.col("diagonal")))
    span = [*keys, "template", "label", "runs", "span"]
    spans = numbered.groupBy(*span).agg(F.min("first").alias("first_word"), (F.max("last") + K - 1).alias("last_word"), F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    verified = spans.withColumn("score", F.col("held") / F.col("runs")).where(F.col("score") >= least)
    claimed = verified.select(*span, "first_word", "last_word", "score", "held", F.explode("at").alias("place"))
    rank = Window.partitionBy(*keys, "place").orderBy(F.desc("score"), F.desc("held"), "label")
    won = claimed.withColumn("__won", (F.first("label").over(rank) == F.col("label")).cast("int"))
    kept = won.groupBy(*span, "first_word", "last_word", "score").agg(F.sum("__won").alias("__won"), F.count("*").alias("__all"))
    return kept.where("2 * __won >= __all").select(*keys, "template", "label", "first_word", "last_word", "score")


def _phrase_places(words: str, phrase: str) -> Column:
    parts = phrase.split()
    fits = lambda i: [F.get(F.col(words), i + k) == w for k, w in enumerate(parts)]

    def all_fit(i: Column) -> Column:
        first, *rest = fits(i)
        for x in rest:
            first = first & x
        return first

    end = F.size(words) - len(parts)
    return F.filter(F.when(end >= 0, F.sequence(F.lit(0), end)).otherwise(F.array().cast("array<int>")), all_fit)


def scan_licenses(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """df's id with n_words, n_base, first_word, last_word, base_labels, labels, score and the verified spans."""
    rows = df.select(F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__text_hash"), F.col(text).alias("__text"))
    keys = ["__id", "__text_hash"]
    base = rows.select(*keys, words_of(F.col("__text")).alias("__w"))
    base = base.withColumn("__line", F.concat(F.lit(" "), F.array_join("__w", " "), F.lit(" ")))
    none = F.array().cast("array<int>")
    base = base.withColumns({f"__p{k}": F.when(F.col("__line").contains(f" {phrase} "), _phrase_places("__w", phrase)).otherwise(none) for k, phrase in enumerate(PHRASES)})
    found = F.concat(*[F.col(f"__p{k}") for k in range(len(PHRASES))])
    held = F.array_compact(F.array(*[F.when(F.size(f"__p{k}") > 0, label) for k, label in enumerate(PHRASES.values())]))
    base = base.select(*keys, F.size("__w").cast("long").alias("n_words"), F.size(found).cast("long").alias("n_base"), F.array_min(found).cast("long").alias("first_word"), F.array_max(found).cast("long").alias("last_word"), F.array_sort(F.array_distinct(held)).alias("__base"))
    spans = license_spans(rows, keys, templates, least, "__text").groupBy(*keys).agg(F.collect_set("label").alias("__own"), F.max("score").alias("score"), F.sort_array(F.collect_list(F.struct("first_word", "last_word", "label", "score"))).alias("spans"))
    joined = base.join(spans.select(F.col("__id").alias("__i"), F.col("__text_hash").alias("__t"), "__own", "score", "spans"), F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__text_hash") == F.col("__t")), "left")
    both = F.array_sort(F.array_union("__base", F.coalesce("__own", F.array().cast("array<string>"))))
    return joined.select(F.col("__id").alias(doc_id), "n_words", "n_base", "first_word", "last_word", F.array_join("__base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans")
