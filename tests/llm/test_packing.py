import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from equipoise.llm import packing as P
from equipoise.llm.subwords import ByteLevel, safe_parts

from .helpers import DOCS, odd_documents, write_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as f:
    CONTENT = f.read()


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def whole(rows):
    """The token lists that the pieces make, checked on the way: (doc_id, tokens) and lengths of the sequences."""
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = {}
    for sequence, found in at.items():
        end = 0
        for offset, length in sorted(found):
            assert offset == end and length > 0
            end += length
        sizes[sequence] = end
    return sizes


@pytest.mark.parametrize("long", [False, True])
def test_pieces_cover_every_token_once(spark, tmp_path, long):
    rows = odd_documents() * (3 if long else 1)
    got = P.op11_packing(spark, write_documents(spark, tmp_path, rows)).collect()
    want = [(r[0], ids_of(r[1])) for r in rows]
    sizes = whole(got)
    total = sum(len(ids) for _, ids in want)
    assert sorted(sizes) == list(range(-(-total // P.LENGTH))) and sum(sizes.values()) == total
    assert all(sizes[s] == P.LENGTH for s in sorted(sizes)[:-1])
    # pieces of one document follow each other in the concatenation
    starts = defaultdict(list)
    for r in got:
        starts[r["sequence_id"] * P.LENGTH + r["offset"] - r["start"]].append(r)
    found = []
    for pieces in starts.values():
        pieces.sort(key=lambda r: r["start"])
        end = 0
        for r in pieces:
            assert r["start"] == end
            end += r["length"]
        assert end == pieces[0]["doc_tokens"]
        found.append((pieces[0]["doc_id"], end, tuple(r["length"] for r in pieces), tuple(r["ids_crc32"] for r in pieces)))
    by_id = defaultdict(list)
    for doc_id, ids in want:
        by_id[doc_id].append(np.array(ids, "<u4"))
    for doc_id, n, lengths, sums in found:
        ids = next(x for x in by_id[doc_id] if len(x) == n)
        cuts = np.cumsum(lengths)[:-1]
        assert tuple(zlib.crc32(p.tobytes()) for p in np.split(ids, cuts)) == sums
    assert sorted((str(d), n) for d, n, *_ in found) == sorted((str(d), len(i)) for d, i in want)


def test_sequences_hold_the_pieces(spark, tmp_path):
    docs = spark.read.parquet(write_documents(spark, tmp_path, odd_documents() * 2) + "/documents.parquet").repartition(5)
    documents = P.placed(P.encoded(docs, PATH))
    line = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(documents.collect(), key=lambda r: r["at"])])
    for length in (7, 2048, 1 << 20):
        rows = sorted(P.sequences(documents, length, 9).collect())
        assert [r["sequence_id"] for r in rows] == list(range(-(-len(line) // length)))
        for r in rows:
            want = line[r["sequence_id"] * length:][:length]
            if len(want).bit_count() != 1:
                want = np.concatenate([want, np.full(length - len(want), 9, "<u4")])
            assert r["n_tokens"] == min(length, len(line) - r["sequence_id"] * length)
            assert np.array_equal(np.frombuffer(r["ids"], "<u4"), want)


def test_empty_table(spark, tmp_path):
    folder = write_documents(spark, tmp_path, [], DOCS)
    assert P.op11_packing(spark, folder).collect() == []
    docs = spark.read.parquet(folder + "/documents.parquet")
    assert P.sequences(P.placed(P.encoded(docs, PATH))).collect() == []


def test_ids_are_the_librarys_in_parts():
    coder = ByteLevel(CONTENT, special=True)
    assert coder.library is None
    texts = ["a b", "don 's a 'll", "x  y \n z", "日本 語 b", "a <|endoftext|> b<|endoftext|>", " lead trail ", "x 1 ² ½ a",
             "".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x11000)))]
    texts += [f"{chr(c)} a{chr(c)}{chr(c)}b " for c in (*range(0x3100), *range(0xFE00, 0x10000), *range(0x1F000, 0x1F100))]
    for text in texts:
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert coder.ids(text).tolist() == want
        parts = list(safe_parts(text, 1))
        assert "".join(parts) == text and [i for p in parts for i in coder.ids(p).tolist()] == want
    assert coder.ids("x" * 300_000).tolist() == LIBRARY.encode("x" * 300_000, add_special_tokens=False).ids


def test_other_files_are_left_to_the_library():
    import json
    model = json.loads(CONTENT)
    model["model"]["merges"] = model["model"]["merges"][::-1]
    other = json.dumps(model)
    coder = ByteLevel(other, special=False)
    library = Tokenizer.from_str(other)
    library.encode_special_tokens = True
    text = "The quick <|endoftext|> brown fox"
    assert coder.library is not None and coder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
