"""Packing documents into sequences: concatenate and cut.

1. Every document is encoded and closed with an end token.  A task writes, beside the ids, its own number and the tokens
   it has written before the document: the first prefix sum, inside a partition.
2. The partitions' totals, one narrow row each, are summed up in order: the second prefix sum, over partitions.  A
   document's place in the concatenation of all is its partition's offset and its own.
3. Windows of fixed length cut the concatenation.  A document's pieces follow from its place alone, so nothing is
   shuffled and the ids stay where they were written.  ``sequences`` builds the windows themselves: those that lie in one
   task are built there; a window that reaches over the border of two or more tasks leaves each of them as a boundary
   record, and only boundary records meet, by window.

Only the last window may be short.  It is padded to the full length unless its length is a power of two.

A task holds one slice of a batch and one window.  Lost executors: the encoded table is in the shared folder, with the task
numbers it was written under, so what is run again gives the same places.

Defined results: NULL and empty texts give the end token alone; very long texts are encoded in parts that begin where
tokens do; a NULL doc_id and repeated rows are documents like any other; an empty table gives no rows.  Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.llm.common import materialize, parts_by_bytes, ship_package, table
from equipoise.llm.subwords import byte_level, safe_parts
from equipoise.operators.ranking import cumulative_sum
from equipoise.session import join_small

#: Tokens of a sequence; id that ends a document; text bytes (or id bytes) handled at once.
LENGTH, END, STEP = 2048, 1, 2 << 20
#: Partition offsets (16 bytes each) are broadcast up to so many; beyond, the documents are shuffled to them.
OFFSETS = 2_000_000


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, n (tokens), ids (little-endian unsigned 32-bit), part and before: the task and its tokens before the document."""
    ship_package(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        content = f.read()
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("part", T.LongType()), T.StructField("before", T.LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = byte_level(path, content), TaskContext.get().partitionId(), 0
        last = np.array([end], np.uint32)
        for batch in parts_by_bytes(batches, ["text"], STEP):
            found = [np.concatenate([*map(coder.ids, safe_parts(t or "")), last]).astype("<u4", copy=False)
                     for t in batch.column("text").to_pylist()]
            n = np.array([len(ids) for ids in found], np.int64)
            ends = before + np.cumsum(n)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n": pa.array(n), "ids": pa.array([ids.tobytes() for ids in found], pa.binary()),
                "part": pa.array(np.full(len(n), part, np.int64)), "before": pa.array(ends - n)})
            before = int(ends[-1])

    return materialize(docs.select("doc_id", "text").mapInArrow(encode, schema), "encoded", compression="zstd")


def placed(documents: DataFrame) -> DataFrame:
    """``documents`` (as ``encoded`` gives them) with at, the tokens before each of them in the concatenation of all."""
    totals = materialize(documents.groupBy("part").agg(F.sum("n").alias("total")), "totals")
    offsets = materialize(cumulative_sum(totals, "total", ["part"], out="first").select("part", "first"), "offsets")
    joined = join_small(documents, offsets, "part", limit=OFFSETS, known_rows=offsets.count())
    return joined.withColumn("at", F.col("first") + F.col("before")).drop("first")


def pieces(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per piece of ``placed`` documents.

    doc_id, doc_tokens, sequence_id, offset and length in the sequence, start in the document, and ids_crc32.
    """
    ids, at, n = F.col("ids"), F.col("at"), F.col("n")
    size = F.lit(length).cast("long")

    def piece(sequence):
        begin, stop = F.greatest(at, sequence * size), F.least(at + n, (sequence + 1) * size)
        # a slice is all that is copied: the ids of a long document don't go along with each of its pieces
        part = F.substring(ids, ((begin - at) * 4 + 1).cast("int"), ((stop - begin) * 4).cast("int"))
        return F.struct((begin - at).alias("start"), (stop - begin).alias("length"), F.crc32(part).alias("ids_crc32"),
                        sequence.alias("sequence_id"), (begin - sequence * size).alias("offset"))

    windows = F.sequence(F.floor(at / size), F.floor((at + n - 1) / size))
    cut = documents.select("doc_id", n.alias("doc_tokens"), F.transform(windows, piece).alias("pieces"))
    return cut.select("doc_id", "doc_tokens", F.inline("pieces"))


def sequences(documents: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """The sequences of ``placed`` documents: sequence_id, n_tokens (without padding) and ids (binary, padded with ``pad``)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = 0, []  # tokens that follow each other from ``at`` on

        def out(limit: int) -> list[tuple[int, int, bytes]]:
            """Records of the windows that end at or before ``limit``, and what is left of the held tokens."""
            nonlocal at, held
            line, rows, begin = np.concatenate(held) if held else np.zeros(0, "<u4"), [], at
            while at < min(limit, begin + len(line)):
                stop = min((at // length + 1) * length, begin + len(line))
                rows.append((at // length, at % length, line[at - begin:stop - begin].tobytes()))
                at = stop
            held = [line[at - begin:]]
            return rows

        for batch in parts_by_bytes(batches, ["ids"], STEP):
            rows = []
            for place, ids in zip(batch.column("at").to_pylist(), batch.column("ids").to_pylist()):
                if place != at + sum(map(len, held)):
                    rows += out(1 << 62)
                    at, held = place, []
                held.append(np.frombuffer(ids, "<u4"))
                if len(held) > 64 or len(ids) > 4 * length:
                    rows += out((at + sum(map(len, held))) // length * length)
            yield _records(rows)
        yield _records(out(1 << 62))

    records = documents.select("at", "ids").mapInArrow(build, "sequence_id long, offset int, ids binary")
    records = materialize(records, "windows", compression="zstd")
    whole = F.octet_length("ids") == 4 * length
    # at most ``length`` records a window: each holds a token
    met = records.filter(~whole).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("r"))
    met = met.select("sequence_id", F.expr("aggregate(r.ids, X'', (whole, one) -> whole || one)").alias("ids"))
    found = records.filter(whole).select("sequence_id", "ids").unionByName(met)
    n = (F.octet_length("ids") / 4).cast("int")
    filled = F.expr(f"rpad(ids, {4 * length}, X'{pad.to_bytes(4, 'little').hex()}')")
    return found.select("sequence_id", n.alias("n_tokens"), F.when(F.bit_count(n) == 1, F.col("ids")).otherwise(filled).alias("ids"))


def _records(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    numbers, offsets, ids = zip(*rows) if rows else ((), (), ())
    return pa.record_batch({"sequence_id": pa.array(numbers, pa.int64()), "offset": pa.array(offsets, pa.int32()),
                            "ids": pa.array(ids, pa.binary())})


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, each document encoded and closed by an end token."""
    documents = encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces(placed(documents)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
