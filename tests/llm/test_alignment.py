"""The alignment against comparing every token with every token; nulls, repeated rows, long texts in blocks, many pair blocks."""

import hashlib
import random

import public_tokenizers as P
import pytest

from plumbline.llm import alignment as A


@pytest.fixture(scope="module")
def vocabularies():
    return A.read_byte_level(P.path("byte_bpe_50k.json")), A.read_pieces(P.path("piece_bpe_32k.model"))


def texts():
    r = random.Random(9)
    some = [
        None, "", " ", "  two  spaces ", "one word", "Straße über München, 漢字 𝄞!", "<|endoftext|> and <s> </s> <unk> <0x41>", "tab\tand\nline\r\n", "▁ low",
        "é   ﬁ ™", "don't we'll I'm 12345 67.8", "\x00\x01", "a" * 300, "word " * 100 + "end",
    ]
    made = ["".join(r.choice(["the ", "ing", "tion ", "ö", " a", ".", "\n", "42", "Ab", " 漢"]) for _ in range(r.randint(1, 40))) for _ in range(60)]
    return some + made


def by_pairs(rows, a, b):
    """Every A token against every B token of each text, with the libraries' own calls on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    links, out, counts = {}, [], {}
    for text in {t for _, t in rows if t}:
        sides = []
        for ids, entries in ((one.encode(" " + text, add_special_tokens=False).ids, a.entries), (two.encode(text), b.entries)):
            at, spans = 0, []
            for i in ids:
                spans.append((i, at, at + len(entries[i])))
                at += len(entries[i])
            sides.append(spans if b"".join(entries[i] for i in ids) == (" " + text).encode() else None)
        if None not in sides:
            links[text] = (sides, [(x, y) for x, s, e in sides[0] for y, u, v in sides[1] if max(s, u) < min(e, v)])
    for _, text in rows:
        for pair in links.get(text, (0, []))[1]:
            counts[pair] = counts.get(pair, 0) + 1
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    for i, text in rows:
        if text not in links:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        sides, own = links[text]
        ends = sorted({e for _, _, e in sides[0]} & {e for _, _, e in sides[1]})
        said = []
        for low, high in zip([0, *ends], ends):
            said.append("|".join(",".join(str(x) for x, s, e in side if low < e <= high) for side in sides))
        out.append((i, len(sides[0]), len(sides[1]), len(ends), len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own),
                    hashlib.sha256(";".join(said).encode()).hexdigest()))
    return sorted(out), counts


@pytest.mark.parametrize("known, pairs", [(A.KNOWN, A.BLOCK_PAIRS), (3, 100)])
def test_as_by_pairs(spark, vocabularies, monkeypatch, known, pairs):
    monkeypatch.setattr(A, "KNOWN", known)
    rows = [(i, t) for i, t in enumerate(texts())] + [(2, "one word"), (2, "one word"), (90, "word " * 100 + "end")]
    want, counts = by_pairs(rows, *vocabularies)
    docs = spark.createDataFrame([(i, t, "k", "old") for i, t in rows], "doc_id bigint, text string, key string, n_best string").repartition(4)
    got = A.align_tokenizers(docs, *vocabularies, block_pairs=pairs, groups=True)
    found = sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.docs.collect())
    assert found == want
    assert {r.key for r in got.docs.collect()} == {"k"}
    assert {(r.pair >> 32, r.pair & 0xFFFFFFFF): r.n for r in got.pairs.collect()} == counts
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got.ids.collect())
    assert any(w[1] == 0 for w in want) and sum(w[1] > 0 for w in want) > 40


def test_empty_tables(spark, vocabularies):
    assert A.align_tokenizers(spark.createDataFrame([], "doc_id bigint, text string"), *vocabularies).docs.count() == 0
    row = A.align_tokenizers(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), *vocabularies).docs.collect()[0]
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "")


def test_pieces_as_whole_texts(vocabularies):
    aligner = A.Aligner(*vocabularies)
    said = [t for t in texts() if t] + [" one two  three 4 five'six seven" * 300, "x y é z ▁ w " * 50]
    assert aligner.splits and aligner(said) == aligner.fresh(said) == aligner(said)
    assert all(len(p) <= A.KNOWN_CHARS for p in aligner.known) and len(aligner.known) > 50
