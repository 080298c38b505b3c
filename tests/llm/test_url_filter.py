import re

from equipoise.llm import url_filter as U

PAGES = "page_id long, url string, html string, host string, verdict string, hits string"


def expected(url, rules=U.RULES):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fit) if fit else (0, None, "allow")
    return host, path, rule, verdict


def test_odd_urls(spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "http:///x", "HTTP://WWW.Example.ORG/es/1", "http://example.org/es", "http://example.org/en/10#x",
            "http://notexample.org/es/", "http://a.com/fr/?q", "http://a.com/de/x", "http://a.com", "http://org/", "http://x.org?y=/z",
            "http://é.COM/fr/é", "a://b://org/", "http://a..com/de/", "http://com./de/", "http://x\n.com/de/\n", "http://" + "a." * 60 + "org/" + "p" * 3000]
    rows = [(i, u, "h", "x", "y", "z") for i, u in enumerate(urls)] + [(None, urls[5], "h", "x", "y", "z"), (3, urls[3], "h", "x", "y", "z")]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = U.op9_url_filter(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((r[0], *expected(r[1])) for r in rows), key=repr)


def test_false_positives_are_removed(spark):
    rules = [(f"host{i}.net", f"/p{i % 7}", "block") for i in range(3000)] + [("net", "/p1", "allow"), ("x.net", None, "block"), ("x.net", "y", "block")]
    listing = spark.createDataFrame(rules, "host string, path string, verdict string")
    urls = [f"http://a.host{i * 3}.net/p{i % 7}/x" for i in range(1500)] + [f"http://host{i}.org/p1" for i in range(500)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    before = U.LEAST_BLOCKS, U.MOST_BLOCKS
    try:
        U.LEAST_BLOCKS = U.MOST_BLOCKS = 4  # nearly every key passes so small a filter
        got = U.judge_urls(pages, listing).collect()
    finally:
        U.LEAST_BLOCKS, U.MOST_BLOCKS = before
    usable = [r for r in rules if r[1] is not None and r[1].startswith("/")]
    assert {(r.url, r.rule, r.verdict) for r in got} == {(u, *expected(u, usable)[2:]) for u in urls}


def test_empty_listing_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [(r.rule, r.verdict) for r in U.judge_urls(pages, none).collect()] == [(None, "allow")]
    assert U.judge_urls(pages.limit(0), none).count() == 0
