"""Entities against Python's own decoder, codebooks in blocks, encodings, file-order ids."""

import html
import html.entities
import random

from equipoise.functions.text import strip_html_full, unescape_html, unescape_strip
from equipoise.sources import codebook as CB
from equipoise.sources.io import read_in_file_order, read_table


def _texts():
    rng = random.Random(1)
    names = list(html.entities.html5)
    numbers = [*range(0, 300), 0xD800, 0xDFFF, 0x10FFFF, 0x110000, 0xFDD0, 0xFFFE, 0x1FFFF, 8364, 128512, 10**30]
    texts = [f"&{n}" for n in names] + [f"a&{n}x b" for n in names] + [f"&#{n};" for n in numbers] + [f"&#x{n:x} &#X{n:X};" for n in numbers]
    texts += ["", "&", "&&amp;", "&amp;lt;", "&#x;", "&#;", "&notit;", "&copy2024", "a&b;c &lt &gt;&unknownentity; &#X41", "& amp;",
              "é&eacute&eacute;", "&" + "a" * 40 + ";", "  &nbsp; <b>x</b> \x1f ", "&#x00000000041;"]
    parts = ["&", "#", "amp", "lt", ";", " ", "x", "41", "not", "in", "é", "<p>", "\n"]
    return texts + ["".join(rng.choice(parts) for _ in range(8)) for _ in range(500)]


def test_entities_are_decoded_as_python_does(spark):
    df = spark.createDataFrame([(t,) for t in [*_texts(), None]], "t string")
    for r in df.select("t", unescape_html("t").alias("u"), unescape_strip("t").alias("s")).collect():
        if r.t is None:
            assert r.u is None and r.s is None
        else:
            assert r.u == html.unescape(r.t) and r.s == html.unescape(r.t.replace(" ", " ")).strip()


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("<b>a &eacute;</b>\n<i\n>",)], "t string").select(strip_html_full("t").alias("s"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.first().s == "a é\n<i\n>"


CODEBOOK = """<html><body><p>intro</p>
Label:&nbsp;Sex of respondent<br>\nSection&nbsp;Name:&nbsp;Demo &amp; more<br>SAS&nbsp;Variable&nbsp;Name:&nbsp; SEXVAR <br>
<table><tr>\n<td class="v">1</td>\n<td>Male&nbsp;\x96 yes</td></tr><tr><td>2</td><td><b>Fem</b>ale</td></tr></table>
Label:&nbsp;No values<br>Section&nbsp;Name:&nbsp;Other<br>SAS&nbsp;Variable&nbsp;Name:&nbsp;NOVALS<br>
Label:&nbsp;Weight caf\xe9<br>Section&nbsp;Name:&nbsp;Other<br>SAS&nbsp;Variable&nbsp;Name:&nbsp;WEIGHT2<br>
<tr><td>50 - 0999</td><td>Weight</td></tr><tr><td> </td><td>Missing</td></tr><tr><td>50 - 0999</td><td>Weight</td></tr></body>"""


def test_codebook_is_read_block_by_block(spark, tmp_path):
    (tmp_path / "book.html").write_bytes(CODEBOOK.encode("latin-1"))
    blocks = CB.read_blocks(spark, str(tmp_path), "windows-1252")
    assert blocks.count() == 3
    got = sorted(tuple(r) for r in CB.codebook_metadata(blocks).select(
        "SAS Variable Name", "Label", "Section Name", "Value", "Value Label").fillna("-").collect())
    assert got == [("NOVALS", "No values", "Other", "-", "-"), ("SEXVAR", "Sex of respondent", "Demo & more", "1", "Male\u00a0– yes"),
                   ("WEIGHT2", "Weight café", "Other", "50 - 0999", "Weight")]


def test_a_large_codebook_is_many_tasks(spark, tmp_path):
    block = "Label:&nbsp;L<br>Section&nbsp;Name:&nbsp;S<br>SAS&nbsp;Variable&nbsp;Name:&nbsp;V%d<br><tr><td>1</td><td>one</td></tr>\n"
    (tmp_path / "book.html").write_text("".join(block % i for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        blocks = CB.read_blocks(spark, str(tmp_path))
        assert blocks.rdd.getNumPartitions() >= 4
        assert CB.codebook_metadata(blocks).where("Value = '1'").count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fallback_encoding(spark, tmp_path):
    for name, content, want in (("valid", "a,b\n1,x� é\n".encode(), "x� é"), ("latin", "a,b\n1,caf\xe9\n".encode("latin-1"), "café")):
        (tmp_path / name).write_bytes(content)
        df = read_table(spark, str(tmp_path / name), "csv", schema="a int, b string", encoding="UTF-8", fallback_encoding="ISO-8859-1")
        assert df.first().b == want


def test_ids_follow_files_and_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 10_000, numPartitions=5).selectExpr("(id * 7919) % 10007 AS v").write.parquet(path)
    df = read_in_file_order(spark, path, "rid")
    got = {r.rid: r.v for r in df.collect()}
    assert got == {i: (i * 7919) % 10007 for i in range(10_000)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan.split("Scan parquet")[0]
    assert read_in_file_order(spark, path, "v").columns == ["v"]
