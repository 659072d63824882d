"""Codes of long words, and a very long piece of the byte-level encoder."""

import random
import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from plumbline.llm import bpe, jaccard, recompression
from plumbline.llm import text as X


def complementary(n):
    """Two different words whose codes as sums of powers modulo 2^64 are equal whatever the base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [256, 1024, 2048, 4096])
def test_long_words_differ(n):
    w = X.words(pa.array([" ".join(complementary(n)), "A" * n + " " + "a" * n]), X.SPACED_LOWER)
    assert w.code[0] != w.code[1] and w.code[2] == w.code[3]


def test_operators_tell_long_words_apart(spark):
    a, b = complementary(2048)
    rest = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, a), (4, b)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in recompression.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert all(r.component_id == r.id for r in jaccard.jaccard_components(docs.where("doc_id > 2")).collect())


def test_very_long_pieces_in_flat_arrays(monkeypatch):
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    said = ["".join(r.choice("abcdeöT") for _ in range(n)) for n in (1, 2, 50, 5000)] + ["a" * 6000, "ab" * 3000, "é" * 3000]
    encoder = bpe.Encoder(ranks)
    for long in (bpe.LONG, 2):
        monkeypatch.setattr(bpe, "LONG", long)
        for x in said:
            assert np.frombuffer(encoder.merged(x.encode()), "<u4").tolist() == known.encode_ordinary(x)
    monkeypatch.setattr(bpe, "LONG", 4096)
    piece = ("".join(r.choice("abcdefghij") for _ in range(1000)) * 300).encode()
    tracemalloc.start()
    encoder.merged(piece)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 120 * len(piece)


def test_unknown_ids_are_an_error(spark):
    rows = spark.createDataFrame([(1, np.array([50_300], "<u4").tobytes())], "doc_id bigint, ids binary")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(rows, P.path("byte_bpe_50k.tiktoken")).collect()
