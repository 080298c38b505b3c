import collections
import random

import pyarrow as pa
import pytest

from equipoise.llm import ngram_join as J
from equipoise.llm.components import components

from .helpers import DOCS, odd_documents, words


def expected(rows):
    sets = []
    for doc_id, text, *_ in rows:
        w = words(text)
        sets.append((doc_id, frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return collections.Counter((d, len(s), None if d is None else root(d)) for d, s in sets)


def near_group(n, seed, length=60, edits=4):
    rng = random.Random(seed)
    base = [f"w{seed}x{i}" for i in range(length)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(text[:length - rng.randrange(3)]))
    return out


@pytest.mark.parametrize("bucket, block, hot, sampled", [(J.BUCKET, J.BLOCK, J.HOT_ROWS, J.SAMPLED), (2, 8, 10, 1), (5, 4, 20, 2)])
def test_components_match_brute_force(spark, monkeypatch, bucket, block, hot, sampled):
    monkeypatch.setattr(J, "HOT_ROWS", hot)
    monkeypatch.setattr(J, "SAMPLED", sampled)
    monkeypatch.setattr(J, "BUCKET", bucket)
    monkeypatch.setattr(J, "BLOCK", block)
    rng = random.Random(7)
    passage = " ".join(f"common{i}" for i in range(30))
    texts = near_group(60, 1) + near_group(12, 2, 200, 9) + near_group(25, 3, 12, 3) + ["same text of six words here"] * 20
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    rows = [(i + 100, t, "en", "s", 1, 1.0, "r", "k") for i, t in enumerate(texts)] + odd_documents()
    rng.shuffle(rows)
    got = J.similar_components(spark.createDataFrame(rows, DOCS))
    assert collections.Counter(map(tuple, got.collect())) == expected(rows)


def test_keep_one_of_each(spark):
    docs = spark.createDataFrame(odd_documents(), DOCS)
    kept = J.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = [d for d, _, c in expected(odd_documents()) if d is None or d == c]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_repeated_rows_and_null_ids_keep_one(spark):
    text, other = "one two three four five six seven eight nine ten", "another text that has nothing to do with it at all"
    rows = [(None, text, "b"), (None, text, "a"), (None, text + " end", "a"), (7, other, "c"), (7, other, "a"), (7, other, "b"), (9, other, "a"),
            (None, other, "a"), (None, "", "x"), (None, None, "y"), (None, " ", "z"), (3, "", "x"), (4, None, "y")]
    kept = J.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, one string"))
    got = sorted(map(tuple, kept.collect()), key=repr)
    near = [r for r in got if r[1] and r[1].startswith("one")]
    assert len(near) == 1 and near[0][0] is None  # 6 of 7 shingles are shared
    assert [r for r in got if r[1] == other] == [(7, other, "a")]
    assert len(got) == 2 + 5


def test_empty_table(spark):
    assert J.similar_components(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(70, 70), (2, 1), (1, 2), (90, 160)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 90 for i in [90, *range(100, 161)]} | {i: 5 for i in range(5, 40)} | {1: 1, 2: 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_go_on_from_known_ones(spark):
    known = components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long"))
    got = components(spark.createDataFrame([(8, 3), (20, 21)], "a long, b long"), known)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (7, 1), (8, 1), (20, 20), (21, 20)]
    again = components(spark.createDataFrame([], "a long, b long"), known)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, known.collect()))


def test_repeated_ids_are_one_document(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "k l m n o p"), (3, "k l m n o p"), (4, "other words")]
    got = J.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_a_stretch_of_few_words_is_one_shingle(spark, n):
    text = " ".join("abcd"[:n])
    assert [len(x) for x in J.shingles(pa.array([text]))] == [1]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    assert [tuple(r) for r in J.similar_components(docs).collect()] == [(1, 1, 1)]
