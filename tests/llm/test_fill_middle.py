"""Fill-in-middle against a plain rebuilding of each text, with nulls, marks, long texts and clashing names."""

import hashlib
import random
import re

import pytest

from plumbline.llm import fill_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string"


def plain_way(doc_id, text):
    text = text or ""
    t = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(t), "plain", None, None, text, text
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return len(t), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


def texts():
    r = random.Random(5)
    some = [None, "", " ", "one", " \t two  words \n", "é ü 漢字 𝄞 end", "has <P> in it", "<<S", "a <S", "P> <M", "<", "x" * 50_000 + " y " * 20_000]
    made = ["".join(r.choice("ab é漢<PSM> \n\x0b ") for _ in range(r.randint(0, 60))) for _ in range(400)]
    return [(i, t) for i, t in enumerate(some * 4 + made)] + [(None, "no id here at all"), (3, "one"), (3, "one")]


@pytest.mark.parametrize("block", [M.BLOCK, 7])
def test_as_rebuilt_plainly(spark, block, monkeypatch):
    rows = texts()
    monkeypatch.setattr(M, "BLOCK", block)
    import pyarrow as pa

    got = M.restore(M.transform(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()
    want = sorted(((i, *plain_way(i, t)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    # the moves themselves, in blocks of this size
    for form in ("spm", "psm"):
        column = pa.array([t or "" for _, t in rows if not any(m in (t or "") for m in ("<P>", "<S>", "<M>"))])
        data, off = M.X.bytes_of(column)
        middle = off[:-1] + (off[1:] - off[:-1]) // 3
        cuts = M.Cuts(middle, middle + (off[1:] - middle) // 2, *([f == form] * len(column) for f in ("spm", "psm")))
        cuts = M.Cuts(cuts.middle, cuts.suffix, *(M.np.array(x) for x in cuts[2:]))
        out, out_off = M.build(data, off, cuts)
        back, back_off = M.gather(out, out_off, [form] * len(column))
        assert back.tobytes() == data.tobytes() and back_off.tolist() == off.tolist()


def test_empty_table_and_clashing_names(spark):
    none = M.restore(M.transform(spark.createDataFrame([], SCHEMA)))
    assert none.count() == 0
    rows = spark.createDataFrame([(1, "a b c", 7, "kept", "old")], "doc_id bigint, text string, draws int, Draws_ string, form string")
    got = M.restore(M.transform(rows), to="draws").collect()[0]
    assert (got["Draws_"], got["draws"], got["doc_id"]) == ("kept", "a b c", 1) and got["form"] in ("plain", "spm", "psm")
