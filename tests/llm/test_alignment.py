import hashlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from equipoise.llm import alignment as A
from equipoise.llm.bpe import byte_symbols
from equipoise.llm.subwords import safe_parts, sentence_pieces

from .helpers import odd_documents, write_documents

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIRST, SECOND = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
FIRST.encode_special_tokens = True
BYTE = {s: b for b, s in enumerate(byte_symbols())}


def token_bytes(text):
    a = FIRST.encode(" " + text, add_special_tokens=False).ids
    b = SECOND.encode(text)
    bytes_a = [bytes(BYTE[c] for c in FIRST.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if SECOND.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in ((i, SECOND.id_to_piece(i)) for i in b)]
    return a, b, bytes_a, bytes_b


def brute(rows):
    """The contract, token by token."""
    docs, held = [], Counter()
    for doc_id, text in rows:
        a, b, bytes_a, bytes_b = token_bytes(text) if text else ([], [], [], [])
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links, groups, j, g = [], [([], [])] if a else [], 0, 0
        borders = set(ends_a) & set(ends_b)
        for i, end in enumerate(ends_a):
            begin = ends_a[i - 1] if i else 0
            while j and ends_b[j - 1] > begin:
                j -= 1
            while j < len(b) and ends_b[j] <= begin:
                j += 1
            k = j
            while k < len(b) and (ends_b[k - 1] if k else 0) < end:
                links.append((a[i], b[k]))
                k += 1
            groups[-1][0].append(a[i])
            if end in borders:
                while g < len(b) and ends_b[g] <= end:
                    groups[-1][1].append(b[g])
                    g += 1
                groups.append(([], []))
        groups = [x for x in groups if x[0]]
        held.update(set(links))
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        docs.append((doc_id, a, b, groups, links, text))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(doc_id, len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links),
             hashlib.sha256(text.encode()).hexdigest() if a else "") for doc_id, a, b, groups, links, text in docs]


def documents():
    rows = [(r[0], r[1]) for r in odd_documents() if r[1] is None or len(r[1]) < 50_000]
    rows += [(50, "two  spaces\n\nand lines"), (51, "▁ sign"), (52, "naïve café – “quotes” ½"), (53, "x" * 700 + " " + "y" * 900),
             (54, "<s> </s> <unk> <0x41>"), (55, " lead"), (56, "日本語のテキスト" * 60), (57, "🙂🙃" * 200 + " end of it all"),
             (58, "plain words, some of them long: internationalization " * 30), (59, "bad▁part " + "good words here " * 60)]
    return rows


def write(spark, folder, rows):
    return write_documents(spark, folder, [(*r, None, None, None, None, None, None) for r in rows])


@pytest.mark.parametrize("size, fan, held", [(A.RANGE, A.FAN, A.HELD), (40, 3, 25), (7, 2, 1 << 20)])
def test_results_are_the_contracts(spark, tmp_path, size, fan, held):
    rows = documents()
    docs = spark.read.parquet(write(spark, tmp_path, rows) + "/documents.parquet")
    got = [tuple(r) for r in A.aligned(docs, *PATHS, size=size, fan=fan, held=held).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_query(spark, tmp_path):
    rows = [(r[0], r[1]) for r in odd_documents()]
    got = A.op12_alignment(spark, write(spark, tmp_path, rows))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)


def test_empty_table(spark, tmp_path):
    assert A.op12_alignment(spark, write(spark, tmp_path, [])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.booleans()), min_size=1, max_size=30), st.integers(1, 7), st.randoms())
def test_composing_is_associative(tokens, size, random):
    """Ids are lengths; any bracketing of the fragments closes the same groups."""
    lengths = np.arange(200)
    a = np.array([n for n, _ in tokens])
    cuts = sorted({int(x) for x, (_, keep) in zip(np.cumsum(a), tokens) if keep} | {int(a.sum())})
    b = np.diff(cuts, prepend=0)  # some of the first's ends, and splits of those
    b = np.array([x for n in b for x in ([1, n - 1] if n > 2 else [n])])
    parts = [A.Fragment.of(span, lengths, lengths) for _, span in A.ranges_of(a, b, 0, lengths, lengths, size)]
    runs = []

    def fold(lo, hi):
        if hi - lo == 1:
            return parts[lo][0]
        middle = random.randint(lo + 1, hi - 1)
        whole, run = fold(lo, middle).then(fold(middle, hi))
        runs.extend([run] if run is not None else [])
        return whole

    whole = fold(0, len(parts))
    runs += [r for _, r in parts if r is not None]
    assert not len(whole.prefix.a) and not len(whole.suffix.a) and not len(whole.prefix.b) and not len(whole.suffix.b)
    runs.sort(key=lambda r: r.a_from)
    assert all(r.a_from == r.b_from and r.a.sum() == r.b.sum() for r in runs)
    total = reduce(lambda x, y: x + y, runs)
    assert np.array_equal(total.a, a) and np.array_equal(total.b, b)


def test_second_tokenizers_parts():
    with open(PATHS[1], "rb") as f:
        second = sentence_pieces(PATHS[1], f.read())
    assert second.cut
    for text in ("some words, and more of them here", "a  b c\n d e", "日本 語 テキ スト", "x y " * 30):
        parts = list(safe_parts(text, 2))
        assert "".join(parts) == text
        bodies = [p if i == 0 else p[1:] for i, p in enumerate(parts)]
        assert [i for ids in second.ids(bodies) for i in ids] == SECOND.encode(text)
