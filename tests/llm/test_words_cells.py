import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from equipoise.llm import words as W
from equipoise.llm.cells import cell_totals

from .helpers import words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aBé \t\n日\x0b.", max_size=12)), max_size=8), st.sampled_from([4, 64, 1 << 22]))
def test_words_are_those_of_the_pattern(texts, stretch):
    W.STRETCH, before = stretch, W.STRETCH
    try:
        found = W.words_of(pa.array(texts, pa.string()))
    finally:
        W.STRETCH = before
    by_hash, by_word = {}, {}
    for i, text in enumerate(texts):
        own = found.hashes[found.bounds[i]:found.bounds[i + 1]].tolist()
        want = words(text)
        assert len(own) == len(want)
        for w, h in zip(want, own):
            assert by_word.setdefault(w, h) == h and by_hash.setdefault(h, w) == w


def test_cell_totals_add_up_over_tasks(spark):
    df = spark.range(0, 1000, numPartitions=4)

    def hashes(batches):
        for b in batches:
            yield 0, b.column(0).to_numpy().astype(np.uint64)
            yield 1, (b.column(0).to_numpy() * 0 + 7).astype(np.uint64)

    from equipoise.llm.common import ship_package
    ship_package(spark)
    out = cell_totals(df, hashes, 2, 64)
    assert out[0].tolist() == [16] * 40 + [15] * 24 and out[1][7] == 1000 and out[1].sum() == 1000
