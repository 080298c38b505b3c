import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from equipoise.llm import exact_dedup as X

from .helpers import DOCS, LOWER, odd_documents


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate(LOWER), []).append(r[0])
    out, seen = [], set()
    for doc_id, text, *_ in rows:
        t = (text or "").translate(LOWER)
        ids = [i for i in groups[t] if i is not None]
        keep = max(ids) if ids else None
        first = doc_id == keep and (t, doc_id) not in seen
        seen.add((t, doc_id))
        out.append((doc_id, keep, len(groups[t]), first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"least": 4, "most": 16},
                                     {"least": 4, "most": 16, "hash_fn": lambda c: F.crc32(F.substring(c, 1, 1).cast("binary"))}])
def test_groups_match_brute_force_even_if_hashes_collide(spark, options):
    rows = odd_documents()
    found = X.duplicate_groups(spark.createDataFrame(rows, DOCS), **options)
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows)


def test_drop_copies_keeps_one_row_of_each_group_and_the_columns(spark):
    docs = spark.createDataFrame(odd_documents(), DOCS)
    kept = X.drop_copies(docs)
    assert kept.columns == docs.columns
    want = sorted((r for r in expected(odd_documents()) if r[3]), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in want), key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert X.duplicate_groups(empty).count() == 0 and X.drop_copies(empty).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab.\né", max_size=40), min_size=1, max_size=6))
def test_chunks_join_to_the_text(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.chunks(F.col("t"), 3, 8).alias("c")).collect()
    assert all("".join(r.c) == r.t and all(0 < len(c) <= 8 for c in r.c) for r in rows)
