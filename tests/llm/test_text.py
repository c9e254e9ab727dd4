import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from dagbag.llm import text as tx

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\nÉß.1-\x00Ж", max_size=30)), max_size=8)


def plain(t, mode):
    raw = (t or "").encode()
    if mode == "word":
        raw = tx.fold(np.frombuffer(raw, np.uint8)).tobytes() if raw else raw
        return re.findall(rb"[0-9a-z\x80-\xff]+", raw)
    return re.findall(rb"[\x21-\xff]+", raw)


@settings(max_examples=200, deadline=None)
@given(texts, st.sampled_from(["word", "space"]))
def test_words_are_those_of_a_regular_expression(ts, mode):
    w = tx.words(pa.array(ts, pa.string()), mode)
    got = [[w.data[s:e].tobytes() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [plain(t, mode) for t in ts]
    assert w.owner().tolist() == [d for d, x in enumerate(got) for _ in x]
    # equal words have equal hashes, different ones don't
    flat = [x for d in got for x in d]
    h = w.hashes().tolist()
    assert len(set(zip(flat, h))) == len(set(flat)) == len(set(h))


def test_fold_keeps_length_and_lowers_latin():
    raw = "ABC ÀÉÑÖ × ß Ω".encode()
    out = tx.fold(np.frombuffer(raw, np.uint8)).tobytes()
    assert len(out) == len(raw) and out.decode() == "abc àéñö × ß ω"


def test_pieces_never_cut_a_text():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "c"])], ["text"])
    assert [p.column(0).to_pylist() for p in tx.pieces([b], limit=20)] == [["a" * 10, None], ["b" * 100], ["c"]]


def test_fold_is_lower_case_in_place():
    letters = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    text = "".join(letters)
    got = bytes(tx.fold(np.frombuffer(text.encode(), np.uint8))).decode()
    want = "".join(x.lower() if len(x.lower()) == 1 and len(x.lower().encode()) == len(x.encode()) else x for x in letters)
    assert got == want
    other = [x for x in letters if x.lower() != x and len(x.lower().encode()) != len(x.encode())]
    assert len(other) < 40
    for x in ("ÀÉÖØÞ", "ΑΩΣ", "ПРИВЕТ", "ԱԲ", "Ẁ", "\U00010400"):
        assert tx.words(pa.array([x])).hashes().tolist() == tx.words(pa.array(["".join(map(str.lower, x))])).hashes().tolist()
