"""Language identification, words first: known words count by their frequency per language, an unknown word by its longest
known byte n-grams inside the word (5, 4, ... 1)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import counts as C
from plumbline.llm import text as X

LONGEST = 5
MOST_BYTES = 64 << 20  # of the model that is broadcast; an entry takes 8 bytes and 4 per language
PRIOR = 1000.0  # counts that each language is given of the mean of all languages, so that a small one has no larger floor
UNKNOWN = "und"
LETTERS = X.byte_table(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


class Model(NamedTuple):
    """Languages, and per order (0: words, n: n-grams) the known codes with their log frequency per language."""

    langs: list[str]
    known: list[X.Lookup]
    weight: list[np.ndarray]


def count_table(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, length, code, n) over all rows with a language: words at length 0, n-grams inside words at 1 to 5."""

    def handed(types: C.Types, langs: list[str]) -> pa.RecordBatch:
        group, code, count, spelled = types.merged()
        grams, parts = C.Grams(spelled), [(group, np.zeros(len(code), np.int64), code, count)]
        for n in range(1, LONGEST + 1):
            at = grams.starts(n)
            word = grams.word[at]
            found = C.summed({"code": grams.codes(n)[at], "group": group[word]}, n=count[word])
            parts.append((found["group"].to_numpy(), np.full(len(found), n), found["code"].to_numpy(), found["n"].to_numpy()))
        who, length, codes, total = (np.concatenate(x) for x in zip(*parts))
        names = pa.array(langs, pa.string()).take(pa.array(who)) if len(who) else pa.array([], pa.string())
        types.reset()
        return pa.RecordBatch.from_arrays([names, pa.array(length.astype(np.int32)), pa.array(codes.view(np.int64)), pa.array(total.astype(np.int64))], names=["lang", "length", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, number = C.Types(), {}
        for batch in batches:
            for part in X.slices(batch, "text"):
                group = np.array([-1 if x is None else number.setdefault(x, len(number)) for x in part.column("lang").to_pylist()], np.int64)
                types.add(X.words(C.lowered(part.column("text")), LETTERS), group)
                if types.full:
                    yield handed(types, list(number))
        yield handed(types, list(number))

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "lang string, length int, code bigint, n bigint").groupBy("lang", "length", "code").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", most_bytes: int = MOST_BYTES) -> Model:
    """Count all rows with a language; keep every entry if they fit `most_bytes`, else the most frequent of each language.

    The bound is shared fairly between the languages and the lengths: a language or a length with few entries keeps them all,
    however large the others are. A frequency is taken with a prior of the mean of all languages, so what a language has never
    seen speaks for it nowhere, however little it was seen. Rows without language or words teach nothing; without any row no language is known.
    """
    counted = X.written(count_table(docs, lang, text), "language")
    totals = counted.groupBy("lang", "length").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(totals["lang"]))
    budget = most_bytes // (8 + 4 * max(1, len(langs)))
    kept = C.most_per_group(counted, ["lang", "length"], budget)
    if kept is not counted:  # an entry that one language keeps has its counts of all languages
        kept = counted.join(kept.select("length", "code").distinct(), ["length", "code"], "left_semi")
    place = F.array_position(F.array(F.lit(""), *[F.lit(x) for x in langs]), F.col("lang")).cast("int") - 2
    if "" in langs:
        place = F.when(F.col("lang") == "", F.lit(langs.index(""))).otherwise(place)
    got = kept.select("length", "code", place.alias("who"), "n").toArrow()
    length, code, who, n = (got.column(c).to_numpy() for c in ("length", "code", "who", "n"))
    known, weight = [], []
    for order in range(LONGEST + 1):
        own = np.flatnonzero(length == order)
        size = np.zeros(len(langs))
        for r in totals[totals["length"] == order].itertuples():
            size[langs.index(r.lang)] = r.n
        codes, back = np.unique(code[own].view(np.uint64), return_inverse=True)
        table = np.zeros((len(codes), len(langs)))
        table[back, who[own]] = n[own]
        mean = (table / np.maximum(size, 1)).mean(axis=1, keepdims=True) if langs else table
        known.append(X.Lookup(codes))
        weight.append(np.log((table + PRIOR * mean) / (size + PRIOR)).astype(np.float32))
    return Model(langs, known, weight)


def word_scores(code: np.ndarray, spelled: list[bytes], model: Model) -> np.ndarray:
    """Log frequency of each word per language; an unknown word by the mean over its longest known n-grams."""
    out = np.zeros((len(code), len(model.langs)))
    at = model.known[0].find(code)
    out[at >= 0] = model.weight[0][at[at >= 0]]
    open_ = np.flatnonzero(at < 0)
    grams = C.Grams([spelled[i] for i in open_.tolist()])
    waiting = np.ones(len(open_), bool)
    for n in range(LONGEST, 0, -1):
        if not waiting.any():
            break
        start = grams.starts(n)
        start = start[waiting[grams.word[start]]]
        found = model.known[n].find(grams.codes(n)[start])
        start, found = start[found >= 0], found[found >= 0]
        word = grams.word[start]
        hits = np.bincount(word, minlength=len(open_))
        for k in range(len(model.langs)):
            total = np.bincount(word, weights=model.weight[n][found, k], minlength=len(open_))
            out[open_, k] += np.where(hits > 0, total / np.maximum(hits, 1), 0)
        waiting &= hits == 0
    return out


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score` (posterior under equal priors); only the text is looked at.

    Null texts, texts without a letter and any text under an empty model are `und` with score 0; of equal languages the
    alphabetically first wins. Columns of docs with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = len(model.langs)
        for batch in batches:
            for part in X.slices(batch, text):
                column = C.lowered(part.column(text))
                letters = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False)
                w = X.words(column, LETTERS)
                total = np.zeros((part.num_rows, langs))
                if langs:
                    code, at, back = np.unique(w.code, return_index=True, return_inverse=True)
                    data = w.data.tobytes()
                    scores = word_scores(code, [data[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist())], model)
                    row = w.text_of()
                    for k in range(langs):
                        total[:, k] = np.bincount(row, weights=scores[back, k], minlength=part.num_rows)
                known = letters & (langs > 0)
                best = total.argmax(axis=1) if langs else np.zeros(part.num_rows, int)
                share = np.exp(total - total.max(axis=1, keepdims=True)) if langs else np.ones((part.num_rows, 1))
                score = np.where(known, share.max(axis=1) / share.sum(axis=1), 0.0)
                said = [model.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string()), pa.array(score)], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")
