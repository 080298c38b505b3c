"""Columns whose names the operators use inside are kept with their values."""

import public_tokenizers

from equipoise.llm import bpe, exact_dedup, mixing, ngram_join, toxicity, url_filter
from equipoise.llm.common import free_name, free_names

NAMES = ["id", "sha", "loser", "loser_sha", "one", "key", "check", "copies", "rows", "turn", "toxicity", "coded", "near_key", "Set", "kept",
         "__id", "__key", "__toxicity", "__coded", "__loser", "size", "n", "comp", "component_id"]


def documents(spark):
    base = "The quick brown fox jumps over the lazy dog and runs away into the dark forest near the river "
    rows = [(1, base * 3, "a"), (2, base * 3, "a"), (3, base * 3 + "once", "b"), (4, "some other words entirely here", "b"), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.selectExpr("*", *[f"concat('{i}-', doc_id) AS `{name}`" for i, name in enumerate(NAMES)])


def intact(docs):
    assert docs.columns[3:3 + len(NAMES)] == NAMES
    rows = docs.collect()
    assert all(r[name] == f"{i}-{r['doc_id']}" for r in rows for i, name in enumerate(NAMES))
    return sorted(r["doc_id"] for r in rows)


def test_free_names():
    assert free_name(["a", "_A"], "A") == "__A" and free_names(["x"], "x", "x", "y") == ["_x", "__x", "y"]


def test_documents_keep_their_columns(spark):
    docs = documents(spark)
    assert intact(exact_dedup.drop_copies(docs)) == [2, 3, 4, 5]
    assert intact(ngram_join.keep_one_of_each(docs)) == [1, 4, 5]
    assert intact(toxicity.drop_toxic(docs, None)) == [1, 2, 3, 4, 5]
    assert intact(bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).select(*docs.columns)) == [1, 2, 3, 4, 5]
    assert set(intact(mixing.mixed_documents(docs))) <= {1, 2, 3, 4}


def test_pages_keep_their_columns(spark):
    names = ["hits", "best", "filter", "sizes", "keys", "__filter", "__sizes", "__keys"]
    pages = spark.createDataFrame([(1, "http://example.org/es/x"), (2, None), (3, "http://a.com/de/")], "page_id long, url string")
    pages = pages.selectExpr("*", *[f"concat('{i}-', page_id) AS `{name}`" for i, name in enumerate(names)])
    listing = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    rows = {r["page_id"]: r for r in url_filter.judge_urls(pages, listing).collect()}
    assert [rows[i]["verdict"] for i in (1, 2, 3)] == ["block", "allow", "block"]
    assert all(r[name] == f"{i}-{p}" for p, r in rows.items() for i, name in enumerate(names))
