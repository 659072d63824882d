"""License scan by diagonal voting.

Every rolling word k-gram of every text is joined with the places at which templates hold it. A hit at document word p and
template word t votes for the diagonal p - t: an unchanged copy of a template puts all its votes on one diagonal, and an
inserted or lost word moves the rest to a neighbouring one. Votes are added up per text, template and diagonal, diagonals
that lie close are merged into one span, and a span stands only if the words themselves agree.

Equal texts vote once: hits are keyed by 128 bits of the text's SHA-256 and repeated ones fall together before they are
counted, so a text that a third of all rows hold costs one text's votes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import text as X
from plumbline.llm.decontamination import spelled
from plumbline.session import BROADCAST_BYTES, limit

GRAM, PHRASE_GRAM = 5, 2  # words of a gram for templates that may be changed, and for exact phrases
SHARE = 0.8  # of a template's words that have to agree
BAND = 4  # diagonals closer than a fourth of the template's words are one span
PIECE = 1 << 16  # grams of a row that is exploded
SALTS = 16  # copies of a text's spans, for texts that many rows hold
BLOCK_BYTES = 8 << 20  # template text that is broadcast at a time

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices as their licenses publish them.
NOTICES = {
    "notice-mit": "released under the MIT license",
    "notice-apache-2.0": "licensed under the Apache License, Version 2.0",
    "notice-gpl-3": "licensed under the GNU General Public License, version 3",
    "notice-cc-by-nc-4.0": "licensed under CC BY-NC 4.0",
    "text-mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
    "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
    "to do so, subject to the following conditions",
    "text-apache-2.0": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
    "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
    "language governing permissions and limitations under the License.",
    "text-gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation",
    "text-bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met",
    "text-isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "text-mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "text-unlicense": "This is free and unencumbered software released into the public domain.",
}


def known_templates(spark: SparkSession) -> DataFrame:
    """(label, text, exact): the phrases, exact, and the notices, which may be changed a little."""
    rows = [(label, text, True) for text, label in PHRASES.items()] + [(label, text, False) for label, text in NOTICES.items()]
    label, text, exact = zip(*rows)
    return spark.createDataFrame(pa.table({"label": list(label), "text": list(text), "exact": list(exact)}))


def template_grams(templates: DataFrame) -> DataFrame:
    """(gram, template, place, n, k) of templates(template, text, exact): every k-gram with the word at which it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "text"):
                w = X.words(part.column("text"), X.ALNUM_LOWER)
                exact, number = part.column("exact").to_pylist(), part.column("template").to_numpy()
                for i, n in enumerate(w.count().tolist()):
                    k = min(n, PHRASE_GRAM if exact[i] else GRAM)
                    if k:
                        grams = X.sequences(w.code[w.first[i] : w.first[i + 1]], k)
                        size = len(grams)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(grams.view(np.int64)), pa.array(np.full(size, number[i])), pa.array(np.arange(size)), pa.array(np.full(size, n)), pa.array(np.full(size, k))],
                            names=["gram", "template", "place", "n", "k"])

    return templates.mapInArrow(run, "gram bigint, template bigint, place bigint, n bigint, k bigint")


def text_grams(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, place, gram): every k-gram of texts(key, text) for each size k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "text"):
                w = X.words(part.column("text"), X.ALNUM_LOWER)
                for k in sizes:
                    grams = X.sequences(w.code, k).view(np.int64)
                    rows, at, bound = [], [], [0]
                    values = []
                    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                        for s in range(a, b - k + 1, PIECE):
                            e = min(s + PIECE, b - k + 1)
                            rows.append(i)
                            at.append(s - a)
                            values.append(grams[s:e])
                            bound.append(bound[-1] + e - s)
                    if rows:
                        lists = pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(np.concatenate(values)))
                        yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(rows)), pa.array(at, pa.int64()), lists], names=["key", "at", "grams"])

    packed = texts.mapInArrow(run, "key binary, at bigint, grams array<bigint>")
    return packed.select("key", "at", F.posexplode("grams").alias("i", "gram")).select("key", (F.col("at") + F.col("i")).alias("place"), "gram")


def text_key(text: str) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))


def candidate_spans(texts: DataFrame, grams: DataFrame, sizes: list[int], broadcast: bool, share: float) -> DataFrame:
    """(key, spans): per text the merged diagonals that have votes enough, each as (template, [(diagonal, first, last)])."""
    own = grams.withColumnRenamed("place", "from")
    hits = text_grams(texts, sizes).join(F.broadcast(own) if broadcast else own, "gram")
    hits = hits.select("key", "template", "n", "k", "place", (F.col("place") - F.col("from")).alias("diagonal")).distinct()
    votes = hits.groupBy("key", "template", "n", "k", "diagonal").agg(F.count("*").alias("votes"), F.min("place").alias("low"), F.max("place").alias("high"))
    line = Window.partitionBy("key", "template").orderBy("diagonal")
    # exact phrases have k of PHRASE_GRAM or fewer words; none of their diagonals are merged
    band = F.when(F.col("k") == F.least(F.lit(GRAM), F.col("n")), F.expr(f"n div {BAND}")).otherwise(0)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > band, F.lit(True))
    named = votes.withColumn("new", apart.cast("int")).withColumn("span", F.sum("new").over(line))
    merged = named.groupBy("key", "template", "n", "k", "span").agg(F.sum("votes").alias("votes"), F.collect_list(F.struct("diagonal", "low", "high")).alias("lines"))
    enough = merged.where(F.col("votes") * F.col("k") >= F.ceil(F.lit(share) * F.col("n")))
    return enough.groupBy("key").agg(F.collect_list(F.struct("template", "lines")).alias("spans"))


class Catalogue:
    """Words of some templates."""

    def __init__(self, rows: pa.Table):
        w = X.words(rows.column("text"), X.ALNUM_LOWER)
        said = listed(w)
        self.of = {
            t: (label, exact, said[a:b])
            for t, label, exact, a, b in zip(rows.column("template").to_pylist(), rows.column("label").to_pylist(), rows.column("exact").to_pylist(), w.first[:-1], w.first[1:])
        }


def listed(w: X.Words) -> list[bytes]:
    """All words lower-cased."""
    data, bound = spelled(w)
    return [data[a : b - 1] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]


def agreed(words: list[bytes], template: list[bytes], lines: list[dict], k: int) -> tuple[int, int, int]:
    """Template words that agree with the text on some line, and the first and last text word that does."""
    same, low, high = set(), None, None
    for line in lines:
        for p in range(line["low"], min(line["high"] + k, len(words))):
            t = p - line["diagonal"]
            if 0 <= t < len(template) and words[p] == template[t]:
                same.add(t)
                low, high = p if low is None else min(low, p), p if high is None else max(high, p)
    return len(same), low or 0, high or 0


PLACES = "array<struct<first:bigint,label:string,last:bigint,exact:boolean,score:double>>"


def verify(rows: DataFrame, names: list[str], text: str, spans: str, found: str, block: object, share: float) -> DataFrame:
    """`rows` with the places of one catalogue block added to `found`; spans of other templates are left for their block."""
    fields = X.fields_of(rows, rows.columns)
    order = rows.columns
    kind = pa.list_(pa.struct([("first", pa.int64()), ("label", pa.string()), ("last", pa.int64()), ("exact", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value.of
        for batch in batches:
            for part in X.slices(batch, text):
                places = part.column(found).to_pylist()
                some = [i for i, x in enumerate(part.column(spans).to_pylist()) if x]
                if some:
                    picked = part.take(pa.array(some))
                    w = X.words(picked.column(text), X.ALNUM_LOWER)
                    said = listed(w)
                    for j, (i, listed_spans) in enumerate(zip(some, picked.column(spans).to_pylist())):
                        words = said[w.first[j] : w.first[j + 1]]
                        for span in listed_spans:
                            if span["template"] not in known:
                                continue
                            label, exact, template = known[span["template"]]
                            n = len(template)
                            if exact:
                                p = span["lines"][0]["diagonal"]
                                if p >= 0 and words[p : p + n] == template:
                                    places[i].append({"label": label, "exact": True, "first": p, "last": p + n - 1, "score": 1.0})
                                continue
                            both, low, high = agreed(words, template, span["lines"], min(GRAM, n))
                            score = both / max(n, high - low + 1)
                            if score >= share:
                                places[i].append({"label": label, "exact": False, "first": low, "last": high, "score": score})
                cols = [pa.array(places, kind) if c == found else part.column(c) for c in order]
                yield pa.RecordBatch.from_arrays(cols, names=order)

    return rows.mapInArrow(run, fields)


def scan(docs: DataFrame, templates: DataFrame | None = None, text: str = "text", share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with n_words and `licenses`: an ordered array of (first, label, last, exact, score).

    templates(label, text, exact): a template that is exact is found wherever its words stand consecutively; any other one
    where at least `share` of its words agree on close diagonals and at least as many k-grams vote as cover `share` of it
    (k is 5 words, or all of a shorter template). A score is the agreeing words over the longer of template and span. Words
    are runs of digits, letters and non-ASCII characters with A-Z lower-cased; first and last are word numbers from 0.

    The grams are joined by a broadcast while the templates' grams stay below `plumbline.broadcast.maxBytes`, else by a
    shuffle; the templates' words go out in blocks of `block_bytes` of text, one narrow pass each.

    Null and empty texts have no words and no places; templates without words or label are never found, repeated ones count
    once; repeated rows get equal results; columns of docs named n_words or licenses are replaced, all others stay.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "licenses")
    if templates is None:
        templates = known_templates(spark)
    templates = templates.where("label is not null and text is not null").select("label", "text", F.coalesce("exact", F.lit(False)).alias("exact")).distinct()
    templates = X.written(templates.withColumn("template", F.xxhash64("label", "text", "exact")), "templates")
    grams = X.written(template_grams(templates), "template-grams")
    size = grams.agg(F.count("*").alias("n"), F.collect_set("k").alias("sizes")).first()
    key, salt, spans, found = (X.free_name(x, [*docs.columns, "n_words", "licenses"]) for x in ("key", "salt", "spans", "found"))
    texts = docs.select(text_key(text).alias("key"), F.col(text).alias("text")).where("octet_length(text) > 0")
    asked = candidate_spans(texts, grams, sorted(size["sizes"]), size["n"] * 64 <= limit(spark, BROADCAST_BYTES), share)
    asked = asked.select(F.col("key").alias(key), F.col("spans").alias(spans), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    others = [c for c in docs.columns if c != text and "map<" not in docs.schema[c].dataType.simpleString()]
    own = F.pmod(F.xxhash64(*others) if others else F.lit(0), F.lit(SALTS)).cast("int")
    rows = docs.withColumn(key, text_key(text)).withColumn(salt, own).join(asked, [key, salt], "left").drop(key, salt)
    rows = rows.withColumn(found, F.expr(f"cast(array() as {PLACES})"))
    rows = rows.select(*docs.columns, spans, found)
    blocks = max(1, -(-X.text_bytes(templates, "text") // block_bytes))
    for b in range(blocks):
        own_templates = templates.where(F.expr(f"pmod(template, {blocks}) = {b}")) if blocks > 1 else templates
        block = spark.sparkContext.broadcast(Catalogue(own_templates.toArrow()))
        rows = verify(rows, docs.columns, text, spans, found, block, share)
    return with_counts(rows, docs.columns, text, found)


def with_counts(rows: DataFrame, names: list[str], text: str, found: str) -> DataFrame:
    """The columns `names`, the number of words, and the ordered places as `licenses`."""
    fields = X.fields_of(rows, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, text):
                count = X.words(part.column(text), X.ALNUM_LOWER).count()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(count), part.column(found)], names=[*names, "n_words", "licenses"])

    return rows.select(*names, found).mapInArrow(run, f"{fields}, n_words bigint, licenses {PLACES}").withColumn("licenses", F.array_sort("licenses"))
