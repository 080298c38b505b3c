import gzip
import hashlib

import pytest

from equipoise.llm import warc as W

PAGES = "page_id long, url string, html string, type string, capture string"


def odd_pages():
    big = "<html>" + "payload WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 20 + "é日</html>"
    return [(5, "http://a.org/x", big, "t", "c"), (3, "http://b.org/x\r\nX: y", big, "t", "c"), (9, None, big, "t", "c"),
            (1, "http://c.org/", "short", "t", "c"), (2, "http://d.org/", "short", "t", "c"), (4, "u", None, "t", "c"),
            (6, "u", "", "t", "c"), (7, "u", "x" * 99, None, None), (8, "u", "x" * 99, None, None), (10, "u", "y" * 100, None, None),
            (10, "u", "y" * 100, None, None), (11, "u", "y" * 100, None, None), (None, "u", "y" * 100, None, None),
            (12, "v", "z" * 300_000, None, None)]


def expected(rows):
    first = {}
    for page, _, html, *_ in rows:
        p = (html or "").encode()
        if len(p) >= 100 and page is not None:
            first[p] = min(page, first.get(p, page))
    out = []
    for page, _, html, *_ in rows:
        p = (html or "").encode()
        again = p in first and page != first[p]
        out.append((page, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None, True))
    return sorted(out, key=repr)


def test_round_trip_of_odd_pages(spark, tmp_path):
    spark.createDataFrame(odd_pages(), PAGES).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, W.op1_warc(spark, str(tmp_path)).collect()), key=repr) == expected(odd_pages())


def test_files_are_bounded_by_bytes(spark, tmp_path):
    pages = [(i, "http://a.org/", f"{i}" + "x" * n, None, None) for i, n in enumerate([10] * 40 + [700] * 12 + [5_000] * 3 + [90_000] * 2)]
    W.write_archives(spark.createDataFrame(pages, PAGES).coalesce(1), f"{tmp_path}/w", file_bytes=8_000, sizes=(1_000, 10_000, 50_000))
    files = list((tmp_path / "w").rglob("part-*"))
    blocks = [[len(b) for h, b in W.parse_archive(f.read_bytes()) if ("warc-type", "response") in h] for f in files]
    assert all(sum(x) <= 8_000 + 120 * len(x) or len(x) == 1 for x in blocks)
    assert {f.parent.name for f in files if f.stat().st_size} >= {"size-0", "size-1", "size-3"} and "size-2" not in {f.parent.name for f in files}
    found = W.read_archives(spark, f"{tmp_path}/w").filter("type = 'response'").selectExpr("length(payload) AS n").collect()
    assert sorted(r.n for r in found) == sorted(len(p[2]) for p in pages)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert W.op1_warc(spark, str(tmp_path)).count() == 0


def record(kind, name, to=(), block=b""):
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: " + name, *[b"WARC-Concurrent-To: " + t for t in to],
            b"Content-Type: application/warc-fields", b"Content-Length: " + str(len(block)).encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", ["no", "one", "each"])
def test_foreign_archives_and_every_way_to_a_capture(spark, tmp_path, zipped):
    found = [record(b"warcinfo", b"<i>"), record(b"response", b"<r1>", [b"<q2>"], b"a\r\n\r\nWARC/1.1"), record(b"request", b"<q1>", [b"<r1>"]),
             record(b"request", b"<q2>"), record(b"metadata", b"<m1>", [b"<r1>"], b"page_id: 3"), record(b"metadata", b"<m2>", [b"<q1>"]),
             record(b"metadata", b"<m3>", [b"<gone>"]), record(b"resource", b"<r2>"), record(b"metadata", b"<m1>", [b"<r1>"], b"page_id: 3")]
    content = {"no": b"".join(found), "one": gzip.compress(b"".join(found)), "each": b"".join(map(gzip.compress, found))}[zipped]
    (tmp_path / "part-1.warc").write_bytes(content)
    records = W.read_archives(spark, str(tmp_path))
    assert records.count() == 9
    rows = {r.capture.record_id: r for r in W.assemble(records).collect()}
    assert set(rows) == {"<r1>", "<r2>"}
    assert rows["<r1>"].capture.payload == b"a\r\n\r\nWARC/1.1"
    assert [x.record_id for x in rows["<r1>"].requests] == ["<q1>", "<q2>"]
    assert [x.record_id for x in rows["<r1>"].metadata] == ["<m1>", "<m2>"]
    assert rows["<r2>"].requests == [] and rows["<r2>"].metadata == []


def test_a_cut_archive_is_an_error():
    with pytest.raises(ValueError):
        list(W.parse_archive(record(b"response", b"<r>", block=b"0123456789")[:-8]))
