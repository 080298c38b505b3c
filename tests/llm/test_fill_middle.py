import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from equipoise.llm import fill_middle as M

from .helpers import odd_documents, write_documents

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    spm = h[3] % 100 < 80
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), "spm" if spm else "psm", len(prefix), len(middle), sha(output), sha(text)


@settings(max_examples=300, deadline=None)
@given(st.text("a<PSM> \té日🙂>", max_size=40), st.integers(1, 9), st.data())
def test_frames_of_any_size_find_places_and_give_the_text_back(text, size, data):
    raw = np.frombuffer(text.encode(), np.uint8)
    frames, n, marked = M.frames_of(raw, size)
    units = UNITS.findall(text)
    assert n == len(units) and marked == (re.search("<[PSM]>", text) is not None)
    store = M.Frames(frames)
    a, b = sorted(data.draw(st.integers(0, n)) for _ in range(2))
    for k in (a, b):
        before = "".join(units[:k])
        assert store.place(k) == (len(before.encode()), len(before))
    if not marked:
        for form in ("psm", "spm"):
            output, digest = M.framed(M.arranged(store, form, store.place(a)[0], store.place(b)[0]), size)
            prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
            want = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
            assert digest == sha(want)
            assert b"".join(bytes(c) for c in M.rebuilt(M.Frames(output), form)).decode() == text


def test_only_the_frames_of_the_cuts_are_decompressed(monkeypatch):
    raw = np.frombuffer(b"word " * 10_000, np.uint8)
    store = M.Frames(M.frames_of(raw, 1000)[0])
    seen = []
    part = M.Frames.part
    monkeypatch.setattr(M.Frames, "part", lambda self, i: (seen.append(i), part(self, i))[1])
    store.place(2_000)
    store.place(7_000)
    assert len(set(seen)) == 2


def test_query_on_odd_rows(spark, tmp_path):
    rows = odd_documents() + [(100 + i, t, "en", "a", 1, 1.0, "r", "k") for i, t in enumerate(
        ["<P>", "a <S> b", "<M", "x <P", "P> <S", " lead", "trail \n", "a b c", *[f"one two three {i} four five" for i in range(40)]])]
    got = M.op13_fill_middle(spark, write_documents(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute(r[0], r[1]) for r in rows), key=repr)


def test_other_columns_are_kept_and_texts_come_back(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 7), (None, None, None, None)], "doc_id long, text string, frames string, last int")
    docs = docs.selectExpr("*", "'k' AS lang", "doc_id AS `Form`")
    got = M.restored(M.transformed(M.drawn(M.stored(docs))), texts=True)
    assert "lang" in got.columns and sorted((r["doc_id"] or 0, r["restored"], r["lang"]) for r in got.collect()) == [(0, "", "k"), (1, "a b c", "k")]


def test_empty_table(spark, tmp_path):
    assert M.op13_fill_middle(spark, write_documents(spark, tmp_path, [])).collect() == []
