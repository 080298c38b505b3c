"""Alignment of two tokenizers' tokens by bytes, with an associative monoid of fragments.

Both tokenizers cover the same bytes.  Where a token of each ends is a *border*; between two borders lies a group.

1. Texts are encoded by both.  A long text is first cut at places where both begin a token, and its parts are dealt to
   all tasks.  A row holds ids alone: their lengths are the vocabularies'.
2. Long documents: a byte range of the document owns the tokens that end in it and becomes a *fragment*: an open prefix (the
   tokens up to its first border), closed groups, and an open suffix (the tokens behind its last border).  Fragments
   compose: the suffix of one and the prefix of the next close a group, or stay open where one has no border.  Composing
   is associative, so ranges are composed FAN at a time, level by level, by tasks of their own; closed groups leave the tree at
   once and only open ends go on.  What comes out are *runs* of groups.  A short document is one run.
3. Links are pairs of overlapping tokens: between two neighbouring ends, of either tokenizer, lies one.  The documents that
   hold a pair are counted: distinct pairs of a document, summed up in each task, then by pair.
4. A second reading of the runs looks the counts up.  The HELD most frequent pairs go to the tasks; the links of all others are
   joined to their counts as rows (document, pair, links).
5. The groups are written out in order and hashed; those of a long document run by run, sorted by place, as a stream.

A task holds about STEP bytes of ids, FAN fragments' open ends, and HELD counts.  The driver passes on HELD counts and one
number per entry of the first vocabulary.

Defined results: texts that are NULL, empty, or that one of the tokenizers changes, have no tokens: zeros and ''.  A row is
a document: rows that repeat one count as often, and a NULL doc_id is like any other.  An empty table gives no rows.  Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.llm.common import materialize, parts_by_bytes, ship_package, table
from equipoise.llm.subwords import byte_level, lengths, once, safe_parts, sentence_pieces

#: Bytes of a fragment's range (and of a text that is encoded at once); fragments composed at once.
RANGE, FAN = 1 << 16, 16
#: Bytes of texts, and of ids, handled at once; pairs whose counts tasks hold; distinct pairs a task collects before it sends them.
TEXTS, STEP, HELD, COLLECTED = 1 << 20, 1 << 19, 1 << 20, 1 << 20
SHIFT = 32  # a pair is (id of the first << SHIFT) + id of the second


@dataclass
class Span:
    """Tokens of both that begin at two byte places."""

    a_from: int
    b_from: int
    a: np.ndarray
    b: np.ndarray

    def __add__(self, after: Span) -> Span:
        return Span(self.a_from, self.b_from, np.concatenate([self.a, after.a]), np.concatenate([self.b, after.b]))


@dataclass
class Fragment:
    """``prefix`` alone (all is open) if ``suffix`` is None; else there is a border, and what lay between borders has left."""

    prefix: Span
    suffix: Span | None

    @staticmethod
    def of(span: Span, bytes_a: np.ndarray, bytes_b: np.ndarray) -> tuple[Fragment, Span | None]:
        """The fragment of a range's tokens, and the run between its first and last border."""
        ends_a = np.concatenate([[span.a_from], span.a_from + np.cumsum(bytes_a[span.a])])
        ends_b = np.concatenate([[span.b_from], span.b_from + np.cumsum(bytes_b[span.b])])
        borders = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not len(borders):
            return Fragment(span, None), None
        lo, hi = int(borders[0]), int(borders[-1])
        (i, j), (k, m) = (np.searchsorted(ends, [lo, hi]) for ends in (ends_a, ends_b))
        prefix = Span(span.a_from, span.b_from, span.a[:i], span.b[:k])
        run = Span(lo, lo, span.a[i:j], span.b[k:m])
        return Fragment(prefix, Span(hi, hi, span.a[j:], span.b[m:])), run if len(run.a) else None

    def then(self, after: Fragment) -> tuple[Fragment, Span | None]:
        """This fragment followed by ``after``, and the group that closes between them."""
        if self.suffix is None:
            return Fragment(self.prefix + after.prefix, after.suffix), None
        middle = self.suffix + after.prefix
        if after.suffix is None:
            return Fragment(self.prefix, middle), None
        return Fragment(self.prefix, after.suffix), middle if len(middle.a) else None


def _ids(x: np.ndarray) -> bytes:
    return np.asarray(x, "<u4").tobytes()


def _array(x: bytes | None) -> np.ndarray:
    return np.frombuffer(x or b"", "<u4").astype(np.int64)


class Tokenizers:
    """Both tokenizers: files' paths, and their content for the tasks."""

    def __init__(self, path_a: str, path_b: str):
        self.paths = path_a, path_b
        with open(path_a, encoding="utf-8") as f:
            self.first = f.read()
        with open(path_b, "rb") as f:
            self.second = f.read()

    def load(self):
        return byte_level(self.paths[0], self.first, special=False), sentence_pieces(self.paths[1], self.second)

    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids of both."""
        return once(("bytes of", *self.paths), lambda: tuple(lengths(c.strings) for c in self.load()))


def tokens(docs: DataFrame, pair: Tokenizers, size: int = RANGE) -> DataFrame:
    """(row, doc_id, at, long, good, a, b): the ids of each whole short text, and of each part of a long one at byte ``at``.

    ``row`` numbers the rows of ``docs``; ``good``: both tokenizers give the part's bytes.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, at bigint, long boolean, good boolean, a binary, b binary"

    def encode(texts: list[str]) -> dict[str, pa.Array]:
        first, second = pair.load()
        a, b, good = [], [], []
        for text, y in zip(texts, second.ids(texts)):
            raw, x = b" " + text.encode(), first.ids(" " + text)
            good.append(text != "" and b"".join(map(second.strings.__getitem__, y)) == raw and first.spells(x, raw))
            a.append(_ids(x) if good[-1] else b"")
            b.append(_ids(y) if good[-1] else b"")
        return {"good": pa.array(good, pa.bool_()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, whole = TaskContext.get().partitionId() << 33, pair.load()[1].cut
        for part in parts_by_bytes(batches, ["text"], TEXTS):
            texts = [t or "" for t in part.column("text").to_pylist()]
            number = pa.array(np.arange(row, row + len(texts), dtype=np.int64))
            row += len(texts)
            long = [i for i, t in enumerate(texts) if whole and len(t) > size]
            bodies = [(i, p) for i in long for p in safe_parts(texts[i], size)]
            if bodies:
                owner = pa.array([i for i, _ in bodies], pa.int64())
                # a part begins with the space before it, as the whole text does
                sizes = [len(p.encode()) + (not k or bodies[k - 1][0] != i) for k, (i, p) in enumerate(bodies)]
                at = [0] * len(bodies)
                for k in range(1, len(bodies)):
                    at[k] = at[k - 1] + sizes[k - 1] if bodies[k][0] == bodies[k - 1][0] else 0
                none = pa.nulls(len(bodies))
                yield _rows(number.take(owner), part.column("doc_id").take(owner), pa.array(at, pa.int64()), True, pa.array(
                    [p if x == 0 else p[1:] for (_, p), x in zip(bodies, at)], pa.string()), {
                        "good": none.cast(pa.bool_()), "a": none.cast(pa.binary()), "b": none.cast(pa.binary())})
            rest = sorted({*range(len(texts))} - {*long})
            if rest:
                chosen = pa.array(rest, pa.int64())
                yield _rows(number.take(chosen), part.column("doc_id").take(chosen), pa.array([0] * len(rest), pa.int64()), False,
                            pa.nulls(len(rest), pa.string()), encode([texts[i] for i in rest]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_by_bytes(batches, ["body"], TEXTS):
            own = {c: part.column(c) for c in ("row", "doc_id", "at", "long")}
            yield pa.record_batch(own | encode(part.column("body").to_pylist()))

    rows = docs.select("doc_id", "text").mapInArrow(cut, schema.replace("good", "body string, good"))
    rows = materialize(rows, "tokens", compression="zstd")
    parts = rows.filter("body IS NOT NULL").select("row", "doc_id", "at", "long", "body")
    more = materialize(parts.repartition("row", "at").mapInArrow(finish, schema), "tokens-long", compression="zstd")
    return rows.filter("body IS NULL").drop("body").unionByName(more)


def _rows(row, doc_id, at, long: bool, body: pa.Array, more: dict) -> pa.RecordBatch:
    return pa.record_batch({"row": row, "doc_id": doc_id, "at": at, "long": pa.array([long] * len(row)), "body": body, **more})


_OPEN = ("row bigint, lo bigint, closed boolean, border boolean, pa_from bigint, pb_from bigint, pa binary, pb binary, "
         "sa_from bigint, sb_from bigint, sa binary, sb binary")


def _open_row(row: int, lo: int, f: Fragment) -> tuple:
    p, s = f.prefix, f.suffix or Span(0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64))
    return row, lo, False, f.suffix is not None, p.a_from, p.b_from, _ids(p.a), _ids(p.b), s.a_from, s.b_from, _ids(s.a), _ids(s.b)


def _closed_row(row: int, run: Span) -> tuple:
    return row, run.a_from, True, True, run.a_from, run.b_from, _ids(run.a), _ids(run.b), 0, 0, b"", b""


def _fragment(r: dict) -> Fragment:
    prefix = Span(r["pa_from"], r["pb_from"], _array(r["pa"]), _array(r["pb"]))
    return Fragment(prefix, Span(r["sa_from"], r["sb_from"], _array(r["sa"]), _array(r["sb"])) if r["border"] else None)


def _table(rows: list[tuple]) -> pa.Table:
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names = [c.split() for c in _OPEN.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(names)})


def ranges_of(a: np.ndarray, b: np.ndarray, at: int, bytes_a: np.ndarray, bytes_b: np.ndarray, size: int) -> Iterator[tuple[int, Span]]:
    """(begin, tokens that end in it) of the ranges of ``size`` bytes of tokens that begin at ``at``."""
    ends_a, ends_b = np.cumsum(bytes_a[a]), np.cumsum(bytes_b[b])
    total = int(ends_a[-1]) if len(a) else 0
    for lo in range(0, total, size):
        (i, j), (k, m) = (np.searchsorted(ends, [lo, lo + size], side="right") for ends in (ends_a, ends_b))
        yield at + lo, Span(at + (int(ends_a[i - 1]) if i else 0), at + (int(ends_b[k - 1]) if k else 0), a[i:j], b[k:m])


def closed_runs(parts: DataFrame, pair: Tokenizers, size: int = RANGE, fan: int = FAN) -> DataFrame:
    """(row, at, a, b): the runs of groups of long documents, from their ``tokens``."""

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_a, bytes_b = pair.bytes()
        for part in parts_by_bytes(batches, ["a", "b"], STEP):
            rows = []
            for row, at, a, b in zip(*(part.column(c).to_pylist() for c in ("row", "at", "a", "b"))):
                for lo, span in ranges_of(_array(a), _array(b), at, bytes_a, bytes_b, size):
                    f, run = Fragment.of(span, bytes_a, bytes_b)
                    rows.append(_open_row(row, lo, f))
                    if run is not None:
                        rows.append(_closed_row(row, run))
            yield from _table(rows).to_batches()

    def compose(found: pa.Table) -> pa.Table:
        rows, whole = [], None
        for r in found.sort_by("lo").to_pylist():
            if whole is None:
                row, lo, whole = r["row"], r["lo"], _fragment(r)
                continue
            whole, run = whole.then(_fragment(r))
            if run is not None:
                rows.append(_closed_row(row, run))
        return _table([*rows, _open_row(row, lo, whole)])

    level = materialize(parts.mapInArrow(fragments, _OPEN), "fragments", compression="zstd")
    closed, open_ends = [level.filter("closed")], level.filter("NOT closed")
    last, width = open_ends.agg(F.max("lo")).first()[0] or 0, size
    while width <= last:
        width *= fan
        grouped = open_ends.groupBy("row", F.floor(F.col("lo") / width))
        level = materialize(grouped.applyInArrow(compose, _OPEN), "fragments", compression="zstd")
        closed.append(level.filter("closed"))
        open_ends = level.filter("NOT closed")
    return reduce(DataFrame.unionByName, closed).select("row", F.col("lo").alias("at"), F.col("pa").alias("a"), F.col("pb").alias("b"))


class Aligned:
    """Runs of a batch laid end to end: links and groups of all of them at once."""

    def __init__(self, part: pa.RecordBatch, bytes_a: np.ndarray, bytes_b: np.ndarray):
        (self.a, self.n_a), (self.b, self.n_b) = (_concatenated(part.column(c)) for c in ("a", "b"))
        self.ends_a, self.ends_b = np.cumsum(bytes_a[self.a]), np.cumsum(bytes_b[self.b])
        ends = np.concatenate([self.ends_a, self.ends_b])
        ends.sort(kind="stable")
        self.ends = ends[np.diff(ends, prepend=-1) > 0]
        self.link_a, self.link_b = (x[np.searchsorted(e, self.ends)] for x, e in ((self.a, self.ends_a), (self.b, self.ends_b)))
        self.pairs = (self.link_a << SHIFT) + self.link_b
        self.last_a = np.cumsum(self.n_a)
        self.run_ends = np.concatenate([[0], self.ends_a])[self.last_a]
        #: links before each run's end
        self.links = np.searchsorted(self.ends, self.run_ends, side="right")

    def of_run(self) -> np.ndarray:
        """Each link's run."""
        return np.repeat(np.arange(len(self.links)), np.diff(self.links, prepend=0))

    def per_run(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value per link over each run."""
        return np.diff(np.concatenate([[0], np.cumsum(values)])[self.links], prepend=0)

    def groups(self) -> tuple[np.ndarray, list[bytes]]:
        """Groups of each run, and its groups as text: ids of the first, ``|``, of the second, ``;`` between groups."""
        n_a, n_b = len(self.a), len(self.b)
        if not n_a:
            return np.zeros(len(self.n_a), np.int64), [b""] * len(self.n_a)
        closes_a, closes_b = (e[np.minimum(np.searchsorted(e, own), len(e) - 1)] == own
                              for own, e in ((self.ends_a, self.ends_b), (self.ends_b, self.ends_a)))
        group_a, group_b = (np.cumsum(c) - c for c in (closes_a, closes_b))
        through_a = np.flatnonzero(closes_a) + 1  # tokens of the first up to each group's end
        before_b = np.concatenate([[0], np.flatnonzero(closes_b) + 1])
        place_a, place_b = np.arange(n_a) + before_b[group_a], np.arange(n_b) + through_a[group_b]
        ids, mark = np.empty(n_a + n_b, np.int64), np.empty(n_a + n_b, np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a] = np.where(closes_a, ord("|"), ord(","))
        mark[place_b] = np.where(closes_b, ord(";"), ord(","))
        digits, width = once(("digits", top := max(int(self.a.max()), int(self.b.max())).bit_length()), lambda: _digits(1 << top))
        text, size = digits[ids], width[ids]
        text[np.arange(len(ids)), size] = mark
        line = text[np.arange(text.shape[1]) <= size[:, None]]
        upto = np.concatenate([[0], np.cumsum(size + 1)])[self.last_a + np.cumsum(self.n_b)]
        begin = np.concatenate([[0], upto[:-1]])
        groups = np.diff(np.concatenate([[0], np.cumsum(closes_a)])[self.last_a], prepend=0)
        return groups, [line[lo:max(lo, hi - 1)].tobytes() for lo, hi in zip(begin, upto)]


def _concatenated(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = column.to_pylist()
    return _array(b"".join(values)), np.array([len(v) // 4 for v in values], np.int64)


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 .. n - 1, with room for one more character, and how many they are."""
    text = np.char.ljust(np.arange(n).astype("S"), len(str(n - 1)) + 1)
    return text.view(np.uint8).reshape(n, -1), np.char.str_len(np.char.strip(text)).astype(np.int64)


def _in_steps(runs: DataFrame, pair: Tokenizers, work: Callable, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_a, bytes_b = pair.bytes()
        yield from work((part, Aligned(part, bytes_a, bytes_b)) for part in parts_by_bytes(batches, ["a", "b"], STEP))
    return runs.mapInArrow(run, schema)


def pair_counts(short: DataFrame, long: DataFrame, pair: Tokenizers) -> DataFrame:
    """(pair, docs): how many documents hold each pair of ids linked; ``short``: whole documents, ``long``: runs of long ones."""

    def count(steps):
        held, size = [], 0
        for _, lines in steps:
            order = np.lexsort((lines.pairs, of_run := lines.of_run()))
            own, run = lines.pairs[order], of_run[order]
            own = own[(np.diff(own, prepend=-1) != 0) | (np.diff(run, prepend=-1) != 0)]
            held.append(_summed([np.unique(own, return_counts=True)]))
            size += len(held[-1][0])
            if size > 2 * COLLECTED:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > COLLECTED:
                    yield _pairs(*held.pop())
                    size = 0
        if held:
            yield _pairs(*_summed(held))

    def each(steps):
        for part, lines in steps:
            rows = part.column("row").to_numpy()[lines.of_run()]
            both = np.unique(np.stack([rows, lines.pairs]), axis=1)
            yield pa.record_batch({"row": pa.array(both[0]), "pair": pa.array(both[1])})

    of_short = _in_steps(short.select("a", "b"), pair, count, "pair bigint, docs bigint")
    of_long = _in_steps(long.select("row", "a", "b"), pair, each, "row bigint, pair bigint").distinct()
    both = of_short.unionByName(of_long.groupBy("pair").agg(F.count(F.lit(1)).alias("docs")))
    return materialize(both.groupBy("pair").agg(F.sum("docs").alias("docs")), "pair-counts")


def _summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the distinct pairs of several tables."""
    pairs, docs = (np.concatenate(x) for x in zip(*counts))
    order = np.argsort(pairs, kind="stable")
    pairs, docs = pairs[order], docs[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(docs, first) if len(first) else docs


def _pairs(pairs: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"pair": pa.array(pairs, pa.int64()), "docs": pa.array(docs, pa.int64())})


_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def measured(runs: DataFrame, counts: DataFrame, pair: Tokenizers, held: int = HELD) -> DataFrame:
    """``runs`` (row, at, long, a, b, and what else they have) with _SUMS and text, the groups (for a long document's run) or sha, their hash."""
    total = counts.count()
    most = counts if total <= held else counts.orderBy(F.desc("docs"), "pair").limit(held)
    known = most.toArrow()
    order = np.argsort(known["pair"].to_numpy())
    keys, docs = known["pair"].to_numpy()[order], known["docs"].to_numpy()[order]
    highest = counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("docs").alias("highest"))
    top = highest.toArrow()  # at most one row per entry of the vocabulary
    best = np.zeros(len(pair.bytes()[0]), np.int64)
    best[top["a"].to_numpy()] = top["highest"].to_numpy()
    own = [f for f in runs.schema.fields if f.name not in ("a", "b")]
    names = [f.name for f in own]
    schema = T.StructType([*own, *(T.StructField(c, T.LongType()) for c in _SUMS), T.StructField("text", T.BinaryType()),
                           T.StructField("sha", T.StringType()), *T.StructType.fromDDL("others array<struct<pair: bigint, links: bigint>>").fields])

    def measure(steps):
        for part, lines in steps:
            at = np.minimum(np.searchsorted(keys, lines.pairs), max(0, len(keys) - 1))
            found = keys[at] == lines.pairs if len(keys) else np.zeros(len(lines.pairs), bool)
            count = np.where(found, docs[at], 0) if len(keys) else np.zeros(len(lines.pairs), np.int64)
            groups, texts = lines.groups()
            sums = (lines.n_a, lines.n_b, groups, np.diff(lines.links, prepend=0),
                    lines.per_run(found & (count == best[lines.link_a])), lines.per_run(count))
            others: list[list] = [[] for _ in texts]
            if not found.all():
                of_run = lines.of_run()[~found]
                rest, links = np.unique(np.stack([of_run, lines.pairs[~found]]), axis=1, return_counts=True)
                for run, p, n in zip(*rest.tolist(), links.tolist()):
                    others[run].append({"pair": p, "links": n})
            long = part.column("long").to_pylist()
            columns = {c: part.column(c) for c in names} | {c: pa.array(s, pa.int64()) for c, s in zip(_SUMS, sums)}
            columns["text"] = pa.array([t if x else None for t, x in zip(texts, long)], pa.binary())
            columns["sha"] = pa.array([None if x else hashlib.sha256(t).hexdigest() if t else "" for t, x in zip(texts, long)], pa.string())
            columns["others"] = pa.array(others, pa.list_(pa.struct([("pair", pa.int64()), ("links", pa.int64())])))
            yield pa.record_batch(columns)

    found = _in_steps(runs, pair, measure, schema)
    if total <= held:
        return found.drop("others")
    found = materialize(found, "measured", compression="zstd")
    links = found.select("row", F.inline("others")).join(counts, "pair").withColumn("a", F.shiftright("pair", SHIFT)).join(
        F.broadcast(highest), "a")
    rest = links.groupBy("row").agg(F.sum(F.col("links") * F.col("docs")).alias("more_sum"),
                                    F.sum(F.when(F.col("docs") == F.col("highest"), F.col("links")).otherwise(0)).alias("more_best"))
    # a long document's rest goes to its first run
    found = found.join(rest.withColumn("at", F.lit(0).cast("long")), ["row", "at"], "left")
    return found.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col(
        "count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("more_best", "more_sum", "others")


def in_order(runs: DataFrame) -> DataFrame:
    """(row, sha): the hash of each long document's groups, from its runs (row, at, text) in order of place."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, state = None, None
        for batch in batches:
            done = []
            for r, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                if r != row:
                    if row is not None:
                        done.append((row, state.hexdigest()))
                    row, state = r, hashlib.sha256(text)
                else:
                    state.update(b";" + text)
            yield _digests(done)
        if row is not None:
            yield _digests([(row, state.hexdigest())])

    return runs.select("row", "at", "text").repartition("row").sortWithinPartitions("row", "at").mapInArrow(digest, "row bigint, sha string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch({"row": pa.array([r for r, _ in rows], pa.int64()), "sha": pa.array([s for _, s in rows], pa.string())})


def aligned(docs: DataFrame, path_a: str, path_b: str, size: int = RANGE, fan: int = FAN, held: int = HELD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    pair = Tokenizers(path_a, path_b)
    found = tokens(docs, pair, size)
    short, parts = found.filter("NOT long"), found.filter("long")
    heads = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.bool_and("good").alias("good"))
    heads = materialize(heads, "long-documents")
    whole = parts.join(heads.filter("good").select("row"), "row", "left_semi")
    runs = closed_runs(whole, pair, size, fan)
    counts = pair_counts(short, runs, pair)
    runs = short.select("row", "doc_id", "at", "long", "a", "b").unionByName(
        runs.withColumns({"doc_id": F.lit(None).cast(docs.schema["doc_id"].dataType), "long": F.lit(True)}))
    done = materialize(measured(runs, counts, pair, held), "aligned", compression="zstd")
    of_long = done.filter("long").groupBy("row").agg(*[F.sum(c).alias(c) for c in _SUMS])
    of_long = heads.join(of_long, "row", "left").join(in_order(done.filter("long")), "row", "left")
    both = done.filter("NOT long").select("doc_id", *_SUMS, "sha").unionByName(of_long.select(
        "doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _SUMS], F.coalesce("sha", F.lit("")).alias("sha")))
    return both.withColumnRenamed("sha", "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and corpus-wide counts of links between the tokens of two tokenizers, for every whole document."""
    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                   public_tokenizers.path("piece_bpe_32k.model"))
