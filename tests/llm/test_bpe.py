import hashlib
import json

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from equipoise.llm import bpe as B

from .helpers import odd_documents, write_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as f:
    CODER = B.BytePairCoder(json.load(f))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(" a'stLé\n\t\u3000日0²<|endoftext>", max_size=60),
                 st.lists(st.sampled_from(["<|endoftext|>", "the", " ", "\u0085", "'ll"]), max_size=8).map("".join)))
def test_ids_and_text_are_the_librarys(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert list(CODER.encode(text)) == want
    assert CODER.decode(want) == LIBRARY.decode(want, skip_special_tokens=False) == text


def test_long_pieces():
    for text in ("a" * 20_000, "ab" * 9_000, " " * 4_000, "é" * 3_000):
        assert list(CODER.encode(text)) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_a_full_cache_gives_the_same(monkeypatch):
    monkeypatch.setattr(B, "CACHED", 4)
    coder = B.BytePairCoder(json.loads(open(PATH, encoding="utf-8").read()))
    text = "one two three four five six one two three " * 5
    assert coder.encode(text) == CODER.encode(text) and len(coder.known) <= 4


def test_query_on_odd_rows(spark, tmp_path):
    rows = B.op7_bpe(spark, write_documents(spark, tmp_path)).collect()
    want = []
    for doc_id, text, *_ in odd_documents():
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
