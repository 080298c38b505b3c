"""H2 with the full HTML entity table, as Spark expressions.

A text is cut at its entities; each is looked up by itself (names in the table of HTML 5, which comes with Python; numbers
by their code point), and the pieces are joined again.  What an entity gives is never read as one again.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: what an entity looks like, and the code points that numbers may not name
ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
NO_CHARACTER = [(0x1, 0x8), (0xB, 0xB), (0xE, 0x1F), (0x7F, 0x9F), (0xFDD0, 0xFDEF)]
REPLACEMENT = "�"
COMMON = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "nbsp;": " "}
#: names that count without a semicolon, also as the beginning of a longer word
_LEGACY = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)) + ")"
#: numbers of the C1 controls name characters of windows-1252
_CONTROLS = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)} | {"13": "\r", "0": REPLACEMENT}


def _table(values: dict[str, str]) -> Column:
    """A map of constants, folded to one literal."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _character(number: Column) -> Column:
    """The character of a code point given as a number, or NULL if it is too large for one."""
    n = number
    none = (n.bitwiseAND(0xFFFE) == 0xFFFE)
    for lo, hi in NO_CHARACTER:
        none = none | n.between(lo, hi)
    character = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (F.when(n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), REPLACEMENT)
            .when((n == 0) | (n == 13) | n.between(0x80, 0x9F), F.element_at(_table(_CONTROLS), n.cast("string")))
            .when(none, "").otherwise(character))


def _decoded(entity: Column) -> Column:
    """What one entity (from its ``&`` on) stands for; itself if it is none."""
    name = F.substr(entity, F.lit(2))
    digits = F.regexp_extract(entity, r"^&#([0-9]+)", 1)
    hexes = F.regexp_extract(entity, r"^&#[xX]0*([0-9a-fA-F]*)", 1)
    from_hex = F.when(F.length(hexes) <= 8, F.conv(F.when(hexes == "", "0").otherwise(hexes), 16, 10).cast("long"))
    legacy = F.regexp_extract(name, _LEGACY, 1)
    names = _table(html5)
    named = F.coalesce(*[F.when(name == n, c) for n, c in COMMON.items()], F.element_at(names, name),
                       F.when(legacy != "", F.concat(F.element_at(names, legacy), F.substr(name, F.length(legacy) + 1))), entity)
    return F.when(digits != "", _character(digits.try_cast("long"))).when(
        entity.rlike(r"^&#[xX][0-9a-fA-F]"), _character(from_hex)).otherwise(named)


def unescape_html(col: str | Column) -> Column:
    """``col`` with every named and numeric entity decoded, once, as HTML 5 reads them."""
    text = F.col(col) if isinstance(col, str) else col
    between = F.split(text, ENTITY, -1)
    entities = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    # the last piece has no entity behind it
    joined = F.zip_with(between, entities, lambda piece, e: F.concat(piece, F.when(e.isNull(), "").otherwise(_decoded(e))))
    return F.when(F.instr(text, "&") == 0, text).otherwise(F.array_join(joined, ""))


def unescape_strip(col: str | Column) -> Column:
    """Non-breaking space -> space, decode every HTML entity, strip surrounding white space."""
    text = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(unescape_html(F.replace(text, F.lit(" "), F.lit(" "))), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def strip_html_full(col: str | Column) -> Column:
    """Drop tags (inside a line), then decode all entities and strip."""
    c = F.col(col) if isinstance(col, str) else col
    return unescape_strip(F.regexp_replace(c, r"<[^\n]*?>", ""))
