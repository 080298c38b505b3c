"""Fill-in-middle transformation over seekable compressed frames.

``stored`` cuts a text into frames of ``FRAME`` bytes, at code point borders, and compresses each on its own.  With a
frame goes what lies before it: bytes, code points and ended units.  A cut after k units then lies in the frame whose
counts enclose k, and only that frame is decompressed to find it.  The output is a stream: ranges of the text, frame by
frame, and the sentinels between them; it is compressed into frames of its own while its digest is taken.  ``restored``
reads the output and its form alone: it finds the sentinels in the stream, and streams the ranges in the text's order.

A unit is a word with the white space before it; white space at the end is one more.  White space is six ASCII
characters, so units are found in UTF-8 bytes.  A text that holds a sentinel stays plain: no place where ranges and
sentinels meet can then look like one, as a sentinel begins with its only ``<`` and ends with its only ``>``.

Everything is per row; nothing is shuffled.  A task holds one batch's compressed frames and one frame of text.

Defined results: NULL counts as the empty text; empty texts are plain with n = 0; a NULL doc_id is drawn as the empty
string; equal (doc_id, text) rows give equal rows.  Other columns are kept, but for those that have the name of a result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.llm.common import materialize, parts_by_bytes, ship_package, table
from equipoise.llm.words import SPACE

#: Bytes of a frame; bytes of a batch handled at once; zstandard's level.
FRAME, STEP, LEVEL = 1 << 18, 4 << 20, 3
SEED, PLAIN_PERCENT, SPM_PERCENT = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINEL = re.compile(rb"<[PSM]>")
FRAMES = "array<struct<units: bigint, chars: bigint, bytes: bigint, data: binary>>"
_RESULTS = {"frames": FRAMES, "n": "bigint", "marked": "boolean"}


def frames_of(raw: np.ndarray, size: int = FRAME) -> tuple[list[dict], int, bool]:
    """Frames of a text's bytes with the counts before each, the number of units, and whether there is a sentinel."""
    compress, view = zstandard.ZstdCompressor(level=LEVEL).compress, memoryview(raw)
    frames, units, chars, lo, marked = [], 0, 0, 0, False
    while lo < len(raw):
        hi = min(lo + size, len(raw))
        while hi < len(raw) and raw[hi] & 0xC0 == 0x80 and hi > lo + 1:
            hi -= 1
        part = raw[lo:hi]
        frames.append({"units": units, "chars": chars, "bytes": lo, "data": compress(view[lo:hi])})
        marked = marked or SENTINEL.search(view[max(0, lo - 2):hi]) is not None
        units += len(_inner_ends(part)) + bool(hi == len(raw) or SPACE[raw[hi]] and not SPACE[raw[hi - 1]])
        chars += _chars(part)
        lo = hi
    return frames, units, marked


def _inner_ends(part: np.ndarray) -> np.ndarray:
    """Where words end inside ``part``, before its last byte."""
    space = SPACE[part]
    return np.flatnonzero(space[1:] & ~space[:-1]) + 1


def _chars(part: np.ndarray) -> int:
    return int(np.count_nonzero(part & 0xC0 != 0x80))


class Frames:
    """A sequence of frames to seek in; the frame read last stays decompressed."""

    def __init__(self, frames: list[dict]):
        self.frames, self.units = frames, [f["units"] for f in frames]
        self.last: tuple[int, bytes] = (-1, b"")

    def part(self, i: int) -> bytes:
        if self.last[0] != i:
            self.last = i, zstandard.ZstdDecompressor().decompress(self.frames[i]["data"])
        return self.last[1]

    def place(self, k: int) -> tuple[int, int]:
        """The (byte, code point) after ``k`` units."""
        if k == 0:
            return 0, 0
        i = bisect_left(self.units, k) - 1
        frame, part = self.frames[i], np.frombuffer(self.part(i), np.uint8)
        ends = _inner_ends(part)
        inner = k - frame["units"] - 1
        end = int(ends[inner]) if inner < len(ends) else len(part)
        return frame["bytes"] + end, frame["chars"] + _chars(part[:end])

    def read(self, lo: int, hi: int | None = None) -> Iterator[memoryview]:
        """The bytes from ``lo`` to ``hi`` (None: the end), frame by frame."""
        starts = [f["bytes"] for f in self.frames]
        for i in range(max(0, bisect_left(starts, lo + 1) - 1), len(starts)):
            if hi is not None and starts[i] >= hi:
                break
            view = memoryview(self.part(i))
            yield view[max(0, lo - starts[i]):len(view) if hi is None else hi - starts[i]]


def arranged(text: Frames, form: str, first: int, last: int) -> Iterable[memoryview | bytes]:
    """The output of a text whose middle lies between two byte places."""
    if form == "plain":
        return text.read(0)
    prefix, middle, suffix = text.read(0, first), text.read(first, last), text.read(last)
    if form == "psm":
        return chain([PREFIX], prefix, [SUFFIX], suffix, [MIDDLE], middle)
    return chain([SUFFIX], suffix, [PREFIX], prefix, [MIDDLE], middle)


def rebuilt(output: Frames, form: str) -> Iterable[memoryview]:
    """The text whose output is given."""
    if form == "plain":
        return output.read(0)
    at, carry, found = 0, b"", {}
    for chunk in output.read(0):
        window = carry + bytes(chunk)
        for m in SENTINEL.finditer(window):
            found.setdefault(m.group(), at - len(carry) + m.start())
        at, carry = at + len(chunk), window[-2:]
    order = sorted(found, key=found.get)
    ends = dict(zip(order, [found[o] for o in order[1:]] + [at]))
    return chain.from_iterable(output.read(found[o] + len(o), ends[o]) for o in (PREFIX, MIDDLE, SUFFIX))


def framed(chunks: Iterable[memoryview | bytes], size: int = FRAME) -> tuple[list[dict], str]:
    """Frames of a stream (only their ``bytes`` is counted) and its SHA-256."""
    compress, digest = zstandard.ZstdCompressor(level=LEVEL).compress, hashlib.sha256()
    frames, held, at = [], bytearray(), 0
    for chunk in chunks:
        digest.update(chunk)
        held += chunk
        if len(held) >= size:
            frames.append({"units": 0, "chars": 0, "bytes": at, "data": compress(held)})
            at, held = at + len(held), bytearray()
    if held:
        frames.append({"units": 0, "chars": 0, "bytes": at, "data": compress(held)})
    return frames, digest.hexdigest()


def _with(rows: DataFrame, drop: set[str], columns: dict[str, str]) -> tuple[list[str], T.StructType]:
    """The columns of ``rows`` to keep, and the schema with ``columns`` (name: type) behind them."""
    taken = {c.lower() for c in [*drop, *columns]}
    own = [f for f in rows.schema.fields if f.name.lower() not in taken]
    more = T.StructType.fromDDL(", ".join(f"{name}: {kind}" for name, kind in columns.items()))
    return [f.name for f in own], T.StructType([*own, *more.fields])


def _frames_array(rows: list[list[dict]]) -> pa.Array:
    one = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())])
    return pa.array(rows, pa.list_(one))


def _batch(part: pa.RecordBatch, own: list[str], columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[part.column(c) for c in own], *columns.values()], [*own, *columns])


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` in the shared folder, with frames, n (units) and marked (a sentinel is in the text) for its text."""
    ship_package(docs.sparkSession)
    own, schema = _with(docs, {"text"}, _RESULTS)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_by_bytes(batches, ["text"], STEP):
            texts, found = part.column("text"), []
            for i in range(part.num_rows):
                raw = texts[i].as_buffer()
                found.append(frames_of(np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)))
            frames, n, marked = zip(*found)
            yield _batch(part, own, {"frames": _frames_array(list(frames)), "n": pa.array(n, pa.int64()), "marked": pa.array(marked)})

    return materialize(docs.select(*own, "text").mapInArrow(store, schema), "frames")


def drawn(store: DataFrame, seed: int = SEED) -> DataFrame:
    """``store`` with form and, in units, first and last: where the middle begins and ends."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    form = F.when((F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= PLAIN_PERCENT), "plain").when(
        h[3] % 100 < SPM_PERCENT, "spm").otherwise("psm")
    return store.withColumns({"form": form, "first": F.least(a, b), "last": F.greatest(a, b)})


def transformed(rows: DataFrame) -> DataFrame:
    """``drawn`` rows with prefix_chars, middle_chars (NULL if plain), output (frames) and output_sha256; the texts' frames go."""
    own, schema = _with(rows, {"frames", "marked", "first", "last"},
                        {"prefix_chars": "bigint", "middle_chars": "bigint", "output": FRAMES, "output_sha256": "string"})

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_frames(batches, "frames"):
            prefix, middle, outputs, digests = [], [], [], []
            for frames, form, first, last in zip(*(part.column(c).to_pylist() for c in ("frames", "form", "first", "last"))):
                text, begin, end = Frames(frames), (0, 0), (0, 0)
                if form != "plain":
                    begin, end = text.place(first), text.place(last)
                prefix.append(None if form == "plain" else begin[1])
                middle.append(None if form == "plain" else end[1] - begin[1])
                output, digest = framed(arranged(text, form, begin[0], end[0]))
                outputs.append(output)
                digests.append(digest)
            yield _batch(part, own, {
                "prefix_chars": pa.array(prefix, pa.int64()), "middle_chars": pa.array(middle, pa.int64()),
                "output": _frames_array(outputs), "output_sha256": pa.array(digests, pa.string())})

    return rows.mapInArrow(transform, schema)


def restored(rows: DataFrame, texts: bool = False) -> DataFrame:
    """``transformed`` rows with restored_sha256 of the text rebuilt from output and form; ``texts``: and the text itself."""
    more = {"restored_sha256": "string", **({"restored": "string"} if texts else {})}
    own, schema = _with(rows, set(), more)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_frames(batches, "output"):
            digests, whole = [], []
            for frames, form in zip(part.column("output").to_pylist(), part.column("form").to_pylist()):
                digest, held = hashlib.sha256(), []
                for chunk in rebuilt(Frames(frames), form):
                    digest.update(chunk)
                    if texts:
                        held.append(bytes(chunk))
                digests.append(digest.hexdigest())
                whole.append(b"".join(held).decode())
            columns = {"restored_sha256": pa.array(digests, pa.string())}
            yield _batch(part, own, columns | ({"restored": pa.array(whole, pa.string())} if texts else {}))

    return rows.mapInArrow(restore, schema)


def _by_frames(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about STEP compressed bytes in the frames of ``column``."""
    for batch in batches:
        lists = batch.column(column)
        data = pc.binary_length(pc.struct_field(lists.flatten(), "data")).to_numpy(zero_copy_only=False)
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sizes = np.diff(np.concatenate([[0], np.cumsum(data)])[ends])
        group = np.cumsum(sizes) // STEP
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cut places and digests of the fill-in-middle transformation of every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return restored(transformed(drawn(stored(docs)))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


#: The rebuilt text is the text, so its digest is the text's.
SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
hashed AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM cut),
drawn AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
parts AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
