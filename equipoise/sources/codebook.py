"""Extract codebook entries from HTML pages held in a DataFrame column.

Each page is one row; patterns run as JVM regex functions (``regexp_extract_all``)
and matches become rows with ``explode`` -- pages are processed in parallel and
whole (no prefix of the text is taken); large codebook files are cut into blocks as they are read.  The reference's pattern uses DOTALL,
so patterns get ``(?s)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.functions.recode import strip_html
from equipoise.functions.text import strip_html_full, unescape_strip

LINK_PATTERN = r'<a href="([^"]*)">([^<]*)</a>'
LIST_ITEM_PATTERN = r"(?s)<li>(.*?)</li>"

# FIXED VALUES: the survey codebook layout (label, section and variable name fields, value rows)
VARIABLE_PATTERN = (r"(?s)Label:&nbsp;(.+?)<br>.*?Section&nbsp;Name:&nbsp;(.+?)<br>.*?"
                    r"SAS&nbsp;Variable&nbsp;Name:&nbsp;(.+?)<br>")
BLOCK_PATTERN = (r"(?s)Label:&nbsp;.+?<br>.*?SAS&nbsp;Variable&nbsp;Name:&nbsp;(.+?)<br>(.*?)"
                 r"(?=<b>|Label:&nbsp;|</body>)")
BLOCK_FIELDS = {"SAS Variable Name": r"(?s)SAS&nbsp;Variable&nbsp;Name:&nbsp;(.+?)<br>", "Label": r"(?s)^(.+?)<br>",
                "Section Name": r"(?s)Section&nbsp;Name:&nbsp;(.+?)<br>"}
BLOCK_BODY = r"(?s)SAS&nbsp;Variable&nbsp;Name:&nbsp;.+?<br>(.*)$"
VALUE_ROW_PATTERN = r"(?s)<tr>\s*<td[^>]*>(.*?)</td>\s*<td[^>]*>(.*?)</td>"


#: Where a variable's block begins in a codebook.
BLOCK_START = "Label:&nbsp;"


def decode_bytes(content: Column, encoding: str) -> Column:
    """Bytes as text.  windows-1252 is read as ISO-8859-1 with the bytes 80 to 9F translated; others as Spark knows them."""
    if encoding.lower() not in ("windows-1252", "cp1252"):
        return F.decode(content, encoding)
    controls = bytes(range(0x80, 0xA0))
    named = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in controls]
    return F.translate(F.decode(content, "ISO-8859-1"), "".join(a for a, c in named if c), "".join(c for _, c in named if c))


def read_pages(spark, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A2: raw page files -> (path, html) decoded with ``encoding`` (one row per file)."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path"), decode_bytes(F.col("content"), encoding).alias("html"))


def read_blocks(spark, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A2 + A6: codebook files as one row per variable's block (what follows its "Label:"), decoded with ``encoding``.

    The reader itself cuts the files at block starts, so a large file is read by many tasks and no task holds more than a
    block.
    """
    lines = spark.read.text(path, lineSep=BLOCK_START)
    block = decode_bytes(F.col("value").cast("binary"), encoding)
    return lines.select(block.alias("block")).where(F.col("block").contains("SAS&nbsp;Variable&nbsp;Name:&nbsp;"))


def codebook_metadata(blocks: DataFrame) -> DataFrame:
    """A6 + A7 + C1 on ``read_blocks``: (SAS Variable Name, Label, Section Name) left-joined to the values of the variable.

    A block's values are the table rows behind its variable's name, up to a bold heading.  Text is cleaned (tags dropped, entities
    decoded, stripped); value rows with an empty side go, equal ones count once; a variable without values stays.
    """
    fields = F.struct(*[F.regexp_extract("block", p, 1).alias(n) for n, p in BLOCK_FIELDS.items()])
    named = blocks.select(fields.alias("f"), F.split(F.regexp_extract("block", BLOCK_BODY, 1), "<b>", 2)[0].alias("body"))
    variables = named.select(*[unescape_strip(F.col("f")[n]).alias(n) for n in BLOCK_FIELDS], "body")
    rows = extract_groups(variables, "body", VALUE_ROW_PATTERN, ["Value", "Value Label"], keep=["SAS Variable Name"])
    values = rows.select("SAS Variable Name", strip_html_full("Value").alias("Value"), strip_html_full("Value Label").alias("Value Label"))
    values = values.where((F.length("Value") > 0) & (F.length("Value Label") > 0)).dropDuplicates()
    return variables.drop("body").join(values, "SAS Variable Name", "left")


def extract_groups(df: DataFrame, text_col: str, pattern: str, names: Sequence[str], keep: Sequence[str] = (),
                   position: str | None = None) -> DataFrame:
    """Every match of ``pattern`` in ``text_col`` -> one row with one column per capture group."""
    arrays = [F.regexp_extract_all(F.col(text_col), F.lit(pattern), i + 1).alias(n) for i, n in enumerate(names)]
    zipped = df.select(*keep, F.arrays_zip(*arrays).alias("_m"))
    if position:
        out = zipped.select(*keep, F.posexplode("_m").alias(position, "_x"))
        return out.select(*keep, position, *[F.col(f"_x.{n}").alias(n) for n in names])
    out = zipped.select(*keep, F.explode("_m").alias("_x"))
    return out.select(*keep, *[F.col(f"_x.{n}").alias(n) for n in names])


def link_entries(pages: DataFrame) -> DataFrame:
    """A6 on driver pages: (page_id, target, label) of every ``<a href>`` link."""
    return extract_groups(pages, "html", LINK_PATTERN, ["target", "label"], keep=["page_id"])


def nested_entries(pages: DataFrame, block_pattern: str = LIST_ITEM_PATTERN, row_pattern: str = LINK_PATTERN,
                   names: Sequence[str] = ("value", "value_label")) -> DataFrame:
    """Blocks first, then value rows inside each block; cleaned (H2), empty pairs dropped."""
    blocks = extract_groups(pages, "html", block_pattern, ["block"], keep=["page_id"], position="block_no")
    rows = extract_groups(blocks, "block", row_pattern, list(names), keep=["page_id", "block_no"])
    cleaned = rows.select("page_id", "block_no", *[strip_html(n).alias(n) for n in names])
    return cleaned.where((F.length(F.col(names[0])) > 0) & (F.length(F.col(names[1])) > 0))


def survey_metadata(pages: DataFrame) -> DataFrame:
    """A6 + A7 + C1 on a survey codebook: variables (name, label, section) left-joined to their value labels.

    Text is cleaned like the reference: tags dropped, every HTML entity decoded, whitespace stripped.
    """
    variables = extract_groups(pages, "html", VARIABLE_PATTERN, ["Label", "Section Name", "SAS Variable Name"])
    variables = variables.select(*[unescape_strip(c).alias(c) for c in ("SAS Variable Name", "Label", "Section Name")])
    blocks = extract_groups(pages, "html", BLOCK_PATTERN, ["var", "block"], keep=[])
    values = extract_groups(blocks, "block", VALUE_ROW_PATTERN, ["Value", "Value Label"], keep=["var"])
    values = values.select(F.regexp_replace("var", r"(?U)^\s+|\s+$", "").alias("SAS Variable Name"), strip_html_full("Value").alias("Value"),
                           strip_html_full("Value Label").alias("Value Label"))
    values = values.where((F.length("Value") > 0) & (F.length("Value Label") > 0)).dropDuplicates()
    return variables.join(values, "SAS Variable Name", "left")
