"""Quality classifier: an interpolated modified Kneser-Ney model of the bytes of words, trained on trusted text.

Counting is distributed; continuation counts, context totals, discounts and the interpolated probabilities of every order
are joins of n-gram tables sharded by the hash of the n-gram or its context. The finished model holds different n-grams of
words only and is never cut; it is looked up from a broadcast where documents are scored: a shuffled join would move every
n-gram of every text.

All trusted documents are counted, in two halves by a hash of the text. Each half has a model of its own in the same tables,
and every document is scored by the model of the other half, which has seen neither it nor a copy of it.

A document has two perplexities per byte: of its whole text, and of its two least likely words ("peak"). Each is held
against a quantile, over all trusted documents of its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import counts as C
from plumbline.llm import text as X

ORDER = 5
ID_ROWS = 1 << 20  # trusted ids that are broadcast at once; more are taken in turns, each with a pass over the texts
HELD_BYTES = 8 << 20  # of different words that a task holds before it cuts them into n-grams
SHARE = 1 << 18  # places of n-grams that a task adds up at once
WORDS = 1 << 14  # different words that a task looks up at once
HALVES = 2  # parts of the trusted documents with a model each
TEXT_QUANTILE, PEAK_QUANTILE = 0.99, 0.98
LEAST_ROWS = 50  # a language with fewer trusted documents takes the thresholds of all
POOLED = ""
PLACES = 3  # log perplexities are binned so finely for exact quantiles


def group_salt(lang: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang)


class Model(NamedTuple):
    """Per order: n-grams with their log probability, contexts with their log back-off weight; keys hold the language.

    The values have a row per half that was trained on; what did not occur in it is nan. So do the languages.
    """

    langs: list[frozenset[str]]
    grams: list[tuple[X.Lookup, np.ndarray]]
    contexts: list[tuple[X.Lookup, np.ndarray]]


def gram_counts(docs: DataFrame, halves: int) -> DataFrame:
    """(length, gram, context, suffix, opens, n0, ...) of docs(lang, text, half): byte n-grams of words, under the language and pooled.

    A count per half. `opens`: the n-gram starts at the beginning of a word, so nothing can precede it.
    """

    ns = [f"n{h}" for h in range(halves)]

    def handed(types: C.Types, langs: list[str]) -> Iterator[pa.RecordBatch]:
        group, code, count, spelled = types.merged()
        types.reset()
        group, half = group // halves, group % halves
        # a word of both halves is cut into its n-grams once
        _, at, back = np.unique(code ^ X.mix(group.astype(np.uint64)), return_index=True, return_inverse=True)
        group, spelled = group[at], [spelled[i] for i in at.tolist()]
        count = [np.bincount(back, weights=count * (half == h), minlength=len(at)).astype(np.int64) for h in range(halves)]
        grams, long = C.Grams(spelled), None
        salts = np.array([group_salt(x) for x in langs], np.uint64)
        shares = 1 + len(grams.data) // SHARE  # places are added up in turns, those of an n-gram in one
        for n in range(1, ORDER + 1):
            places = grams.starts(n)
            if n == 1:  # the opening mark is given, not predicted
                places = places[places != grams.first[places]]
            long, short = grams.codes(n), long
            turn = long[places]
            turn %= np.uint64(shares)
            turn = turn.astype(np.min_scalar_type(shares))
            for i in range(shares):
                at = places[turn == i]
                word = grams.word[at]
                for salt in (salts[group[word]], np.full(len(word), group_salt(POOLED), np.uint64)):
                    key = lambda codes: X.mix(codes ^ salt)  # noqa: B023, E731
                    zero = np.zeros(len(at), np.uint64)
                    found = C.summed({
                        "gram": key(long[at]), "context": key(short[at]) if n > 1 else salt, "suffix": key(short[at + 1]) if n > 1 else zero,
                        "opens": at == grams.first[at]}, **{n: c[word] for n, c in zip(ns, count)})
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), n, np.int32)), *(pa.array(found[c].to_numpy().view(np.int64)) for c in ("gram", "context", "suffix")), pa.array(found["opens"].to_numpy().astype(bool)), *(pa.array(found[n].to_numpy().astype(np.int64)) for n in ns)],
                        names=["length", "gram", "context", "suffix", "opens", *ns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, number = C.Types(HELD_BYTES), {}
        for batch in batches:
            for part in X.slices(batch, "text"):
                group = np.array([number.setdefault(x, len(number)) for x in part.column("lang").to_pylist()], np.int64)
                types.add(X.words(C.lowered(part.column("text")), X.SPACED), group * halves + part.column("half").to_numpy())
                if types.full:
                    yield from handed(types, list(number))
        yield from handed(types, list(number))

    schema = "length int, gram bigint, context bigint, suffix bigint, opens boolean" + "".join(f", {n} bigint" for n in ns)
    rows = docs.select(F.coalesce("lang", F.lit(POOLED)).alias("lang"), "text", "half").mapInArrow(run, schema)
    return rows.groupBy("length", "gram", "context", "suffix", "opens").agg(*[F.sum(n).alias(n) for n in ns])


def discounts(table: DataFrame, halves: int) -> list[tuple[float, float, float]]:
    """Discounts for counts of one, two and more per half, from the counts of counts."""
    seen = table.agg(*[F.count_if(F.col(f"a{h}") == k).alias(f"s{h}_{k}") for h in range(halves) for k in range(1, 5)]).first()
    out = []
    for h in range(halves):
        n1, n2, n3, n4 = (seen[f"s{h}_{k}"] for k in range(1, 5))
        if not n1 or not n2:
            out.append((0.5, 0.5, 0.5))
            continue
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
        out.append(tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)))
    return out


def fit(docs: DataFrame | list[DataFrame], lang: str = "lang", text: str = "text", half: Column | None = None) -> Model:
    """Train on trusted documents, all n-grams kept: one model, or with `half` (0 or 1) one of each half's documents.

    Parts of the documents are counted one after the other. An empty table gives a model that knows nothing; null texts and
    languages are allowed.
    """
    halves = 1 if half is None else HALVES
    every, seen, counted = range(halves), set(), None
    for part in docs if isinstance(docs, list) else [docs]:
        rows = part.select(F.col(lang).alias("lang"), F.col(text).alias("text"), (F.lit(0) if half is None else half).cast("int").alias("half"))
        one = X.written(gram_counts(rows, halves), "grams")
        counted = one if counted is None else counted.unionByName(one)
        seen |= {(r["lang"], r["half"]) for r in rows.where("lang is not null").select("lang", "half").distinct().collect()}
    if isinstance(docs, list) and len(docs) > 1:
        counted = X.written(counted.groupBy("length", "gram", "context", "suffix", "opens").agg(*[F.sum(f"n{h}").alias(f"n{h}") for h in every]), "grams")
    langs = [frozenset(x for x, own in seen if own == h) for h in every]
    lower, grams, contexts = None, [], []
    for n in range(1, ORDER + 1):
        own = counted.where(F.col("length") == n)
        if n < ORDER:  # below the highest order a count is the number of different left neighbours
            left = counted.where(F.col("length") == n + 1).groupBy(F.col("suffix").alias("gram")).agg(*[F.count_if(F.col(f"n{h}") > 0).alias(f"l{h}") for h in every])
            own = own.join(left, "gram", "left")
            inner = lambda h: F.when(F.col(f"n{h}") > 0, F.greatest(F.coalesce(f"l{h}", F.lit(1)), F.lit(1))).otherwise(F.lit(0))
            own = own.withColumns({f"a{h}": F.when(F.col("opens"), F.col(f"n{h}")).otherwise(inner(h)) for h in every})
        else:
            own = own.withColumns({f"a{h}": F.col(f"n{h}") for h in every})
        cuts = []
        for h, (d1, d2, d3) in enumerate(discounts(own, halves)):
            a = F.col(f"a{h}")
            cuts.append(F.when(a == 0, 0.0).when(a == 1, d1).when(a == 2, d2).otherwise(d3))
        total = own.groupBy("context").agg(*[F.sum(f"a{h}").alias(f"all{h}") for h in every], *[F.sum(cuts[h]).alias(f"cut{h}") for h in every])
        table = own.join(total, "context")
        if lower is not None:
            table = table.join(lower, "suffix", "left")
        below = lambda h: F.lit(1 / 256.0) if lower is None else F.coalesce(f"p_below{h}", F.lit(1e-9))  # noqa: E731, B023
        p = lambda h: (F.col(f"a{h}") - cuts[h]) / F.col(f"all{h}") + F.col(f"cut{h}") / F.col(f"all{h}") * below(h)  # noqa: E731, B023
        table = table.select("gram", *[F.when(F.col(f"a{h}") > 0, p(h)).alias(f"p{h}") for h in every])
        table = X.written(table, "probabilities")
        lower = table.select(F.col("gram").alias("suffix"), *[F.col(f"p{h}").alias(f"p_below{h}") for h in every])
        grams.append(_lookup(table, "gram", [F.ln(f"p{h}") for h in every]))
        contexts.append(_lookup(total, "context", [F.when(F.col(f"all{h}") > 0, F.ln(F.col(f"cut{h}") / F.col(f"all{h}"))) for h in every]))
    return Model(langs, grams, contexts)


def _lookup(table: DataFrame, key: str, values: list[Column]) -> tuple[X.Lookup, np.ndarray]:
    got = table.select(F.col(key).alias("k"), *[v.cast("float").alias(f"v{i}") for i, v in enumerate(values)]).toArrow()
    code = got.column("k").to_numpy().view(np.uint64)
    order = np.argsort(code)
    return X.Lookup(code[order]), np.stack([got.column(f"v{i}").to_numpy()[order] for i in range(len(values))])


def surprise(spelled: list[bytes], salt: np.ndarray, model: Model, half: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Negative log probability of each word with its end, and the bytes predicted, by the model of a half."""
    grams = C.Grams(spelled)
    at = np.flatnonzero(np.arange(len(grams.data)) != grams.first)
    own, back = salt[grams.word[at]], np.zeros(len(at))
    result, open_ = np.zeros(len(at)), np.arange(len(at))
    for n in range(ORDER, 0, -1):
        known, value = model.grams[n - 1]
        ctx_known, ctx_value = model.contexts[n - 1]
        fits = open_[at[open_] - (n - 1) >= grams.first[at[open_]]]
        start = at[fits] - (n - 1)
        found = known.find(X.mix(grams.codes(n)[start] ^ own[fits])) if len(fits) else np.zeros(0, np.int64)
        gain = np.where(found >= 0, value[half, found], np.nan) if value.shape[1] else np.full(len(fits), np.nan)
        held = ~np.isnan(gain)
        hit = fits[held]
        result[hit] = back[hit] + gain[held]
        missed = fits[~held]
        if len(missed):
            ctx = own[missed] if n == 1 else X.mix(grams.codes(n - 1)[at[missed] - (n - 1)] ^ own[missed])
            place = ctx_known.find(ctx)
            loss = np.where(place >= 0, ctx_value[half, place], np.nan) if ctx_value.shape[1] else np.zeros(len(place))
            back[missed] += np.nan_to_num(loss, nan=0.0)
        done = np.zeros(len(at), bool)
        done[hit] = True
        open_ = open_[~done[open_]]
    result[open_] = back[open_] - np.log(256.0)
    word = grams.word[at]
    return -np.bincount(word, weights=result, minlength=len(spelled)), np.bincount(word, minlength=len(spelled))


MEASURES = ("__words", "__text", "__peak")


def perplexities(docs: DataFrame, model: Model | Broadcast, lang: str = "lang", text: str = "text", names: tuple[str, str, str] = MEASURES) -> DataFrame:
    """`docs` with word count, and log perplexity per byte of the text and of its two least likely words, called `names`.

    A null language, or one that was not trained, is scored by the pooled model. A text without words has null perplexities.
    Of a model of two halves the one is asked that has not seen the text. A broadcast model may be given, so that it is sent
    once for several uses.
    """
    shared = model if isinstance(model, Broadcast) else docs.sparkSession.sparkContext.broadcast(model)
    fields = X.fields_of(docs, docs.columns)
    mark = X.free_name("__half", docs.columns)
    docs = docs.withColumn(mark, half_of(F.col(f"`{text}`")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in X.slices(batch, text):
                w = X.words(C.lowered(part.column(text)), X.SPACED)
                asked = (part.column(mark).to_numpy() + 1) % HALVES if len(model.langs) == HALVES else np.zeros(part.num_rows, np.int64)
                part = part.drop_columns([mark])
                salts = np.array([group_salt(x if x in model.langs[h] else POOLED) for x, h in zip(part.column(lang).to_pylist(), asked.tolist())], np.uint64)
                row = w.text_of()
                code, at, back = np.unique(w.code ^ X.mix(salts[row] + asked[row].astype(np.uint64)), return_index=True, return_inverse=True)
                data = w.data.tobytes()
                nll, size = np.zeros(len(at)), np.zeros(len(at), np.int64)
                for h in range(len(model.langs)):
                    of_half = np.flatnonzero(asked[row[at]] == h)
                    for k in range(0, len(of_half), WORDS):
                        own = of_half[k : k + WORDS]
                        nll[own], size[own] = surprise([data[a:b] for a, b in zip(w.start[at[own]].tolist(), w.end[at[own]].tolist())], salts[row[at[own]]], model, h)
                count = w.count()
                some = np.flatnonzero(count > 0)
                first = w.first[some]
                each = (nll / np.maximum(size, 1))[back]
                whole, peak = np.zeros(part.num_rows), np.zeros(part.num_rows)
                if len(some):
                    whole[some] = np.add.reduceat(nll[back], first) / np.add.reduceat(size[back], first)
                    top = np.maximum.reduceat(each, first)
                    where = np.flatnonzero(each == np.repeat(top, count[some]))
                    _, lead = np.unique(row[where], return_index=True)
                    each[where[lead]] = -1.0
                    second = np.maximum.reduceat(each, first)
                    peak[some] = np.where(second < 0, top, (top + second) / 2)
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(count), pa.array(whole, mask=none), pa.array(peak, mask=none)], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, f"{fields}, `{names[0]}` bigint, `{names[1]}` double, `{names[2]}` double")


def half_of(text: Column) -> Column:
    """0 or 1 by a hash of the text, so that copies are in one half."""
    return F.pmod(F.xxhash64(text, F.lit("half")), F.lit(HALVES)).cast("int")


class Thresholds(NamedTuple):
    """Largest accepted log perplexities per language, `POOLED` for the others."""

    text: dict[str, float]
    peak: dict[str, float]

    def column(self, lang: str, which: str) -> Column:
        values = getattr(self, which)
        known = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
        return F.coalesce(known[F.coalesce(F.col(lang), F.lit(POOLED))], F.lit(values[POOLED]))


def quantiles(scored: DataFrame, value: str, q: float, lang: str) -> dict[str, float]:
    """Exact quantile of binned values per language with enough rows, and over all."""
    bins = scored.where(F.col(value).isNotNull()).groupBy(F.col(lang).alias("lang"), F.round(value, PLACES).alias("v")).count().toPandas()
    groups = {POOLED: bins} | {k: g for k, g in bins.groupby("lang") if g["count"].sum() >= LEAST_ROWS}
    out = {POOLED: float("inf")}
    for k, g in groups.items():
        g = g.groupby("v")["count"].sum().sort_index()
        if len(g):
            out[k] = float(g.index[np.searchsorted(g.cumsum().to_numpy(), q * g.sum())])
    return out


class Fitted(NamedTuple):
    """The broadcast model, the thresholds, and the names of the measures in the scored rows."""

    model: Broadcast
    thresholds: Thresholds
    names: tuple[str, str, str]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
          most_rows: int | None = None, most_bytes: int | None = None, whole: bool = False) -> tuple[Fitted, DataFrame]:
    """Models and thresholds, and all rows scored: (id, lang) or, with `whole`, all columns, and the measures.

    Trusted are ids labelled quality 1 and toxic 0. Every one of them is counted in the model of its half and scored by the
    other half's; the thresholds come from all of them. A caller may bound the training, not the scoring: a hash sample of
    about `most_rows` trusted documents, and about `most_bytes` of text from documents of at most a thousandth of that.
    Scored rows are a table without texts; with `whole` only the trusted ones are, and all rows are scored as they are read,
    so that no copy of the texts is written.
    """
    trusted = labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("__id")).distinct()
    slim = docs.select(F.col(id_col).alias("__id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    total, share = trusted.count(), 1.0
    used, fitting = trusted, slim
    if most_rows is not None or most_bytes is not None:
        below = lambda share: trusted.where(F.pmod(F.xxhash64("__id", F.lit("train")), F.lit(1 << 20)) < int(share * (1 << 20)))
        share = min(1.0, most_rows / total) if most_rows is not None and total else 1.0
        if most_bytes is not None:
            fitting = slim.where(F.octet_length("text") <= most_bytes // 1000)
            size = X.text_bytes(fitting.join(below(share), "__id", "left_semi"), "text")
            share *= min(1.0, most_bytes / size) if size else 1.0
        used = below(share)
    turns = max(1, -(-total // ID_ROWS))
    own = lambda ids, i: ids.where(F.pmod(F.xxhash64("__id", F.lit("turn")), F.lit(turns)) == i)
    of = lambda rows, ids: [rows.join(F.broadcast(own(ids, i)), "__id", "left_semi") for i in range(turns)]  # noqa: E731  # a join of texts by shuffle would exceed the disk budget
    parts = of(fitting, used)
    model = docs.sparkSession.sparkContext.broadcast(fit(parts, half=half_of(F.col("text"))))
    names = tuple(X.free_name(n, docs.columns) for n in MEASURES)
    if whole:
        scored = perplexities(docs, model, lang, text, names)
        measured = [X.written(perplexities(part, model).select("lang", "__text", "__peak"), "scored") for part in of(slim, trusted)]
        basis = reduce(DataFrame.unionByName, measured)
    else:
        scored = X.written(perplexities(docs.select(*dict.fromkeys((id_col, lang, text))), model, lang, text, names).drop(text), "scored")
        slim = scored.select(F.col(id_col).alias("__id"), F.col(lang).alias("lang"), F.col(names[1]).alias("__text"), F.col(names[2]).alias("__peak"))
        basis = slim.join(trusted, "__id")
    cuts = Thresholds(quantiles(basis, "__text", TEXT_QUANTILE, "lang"), quantiles(basis, "__peak", PEAK_QUANTILE, "lang"))
    return Fitted(model, cuts, names), scored


def accepted(cuts: Thresholds, lang: str = "lang", names: tuple[str, str, str] = MEASURES) -> Column:
    """Both perplexities within the language's thresholds; texts without words are accepted."""
    within = lambda name, which: F.coalesce(F.round(name, PLACES), F.lit(0.0)) <= cuts.column(lang, which)
    return within(names[1], "text") & within(names[2], "peak")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang: str = "lang", text: str = "text", **options: object) -> DataFrame:
    """(id, lang, n_words, perplexity, peak_perplexity, max_perplexity, max_peak, keep) per row of docs.

    Null and empty texts are kept and have null perplexities; repeated rows get equal results; a perplexity equal to its
    threshold is kept; long texts are scored whole; other columns are not carried.
    """
    fitted, scored = train(docs, labels, id_col, text, lang, **options)
    cuts, (words, whole, peak) = fitted.thresholds, fitted.names
    return scored.select(
        id_col, lang, F.col(words).alias("n_words"), F.exp(whole).alias("perplexity"), F.exp(peak).alias("peak_perplexity"),
        F.exp(cuts.column(lang, "text")).alias("max_perplexity"), F.exp(cuts.column(lang, "peak")).alias("max_peak"), accepted(cuts, lang, fitted.names).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang: str = "lang", text: str = "text", **options: object) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns, whatever these are called.

    Nothing of the rows is written: the trusted ones are scored for the thresholds, then all of them as they are read.
    """
    fitted, scored = train(docs, labels, id_col, text, lang, whole=True, **options)
    return scored.where(accepted(fitted.thresholds, lang, fitted.names)).select(*docs.columns)
