"""Counting hashed things into a fixed number of cells, over all rows of a table.

A cell's total bounds the count of each thing in it from above, whatever else falls there.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CELL_BLOCK = 1 << 16


def cell_totals(rows: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]],
                kinds: int, cells: int) -> np.ndarray:
    """(kinds x cells) totals of what ``hashes`` yields as (kind, 64-bit hashes) from the batches of a task.

    Each task sends its counts once, in compressed blocks; a block's are added up one after the other, so that
    no task holds more than its blocks.  The driver gets kinds * cells numbers.
    """

    def count(batches):
        own = np.zeros((kinds, cells), np.uint32)
        for kind, found in hashes(batches):
            np.add.at(own[kind], (found & np.uint64(cells - 1)).view(np.int64), np.uint32(1))
        for k in range(kinds):
            for b in range(0, cells, CELL_BLOCK):
                part = own[k, b:b + CELL_BLOCK]
                if part.any():
                    yield _block(k, b, _planes(part))

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, b, planes in zip(*(c.to_pylist() for c in batch.columns)):
                sums[k, b] = sums.get((k, b), 0) + _numbers(planes, np.uint32).astype(np.int64)
        for (k, b), total in sums.items():
            yield _block(k, b, _planes(total))

    schema = "kind int, block int, totals binary"
    out = np.zeros((kinds, cells), np.int64)
    for row in rows.mapInArrow(count, schema).repartition("kind", "block").mapInArrow(add, schema).collect():
        out[row["kind"], row["block"]:row["block"] + min(CELL_BLOCK, cells)] = _numbers(row["totals"], np.int64)
    return out


def _planes(numbers: np.ndarray) -> bytes:
    """The numbers' bytes by place, compressed: the high ones are mostly 0."""
    return zlib.compress(numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes(), 1)


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(planes), np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind)[:, 0]


def _block(kind: int, block: int, content: bytes) -> pa.RecordBatch:
    return pa.record_batch({"kind": pa.array([kind], pa.int32()), "block": pa.array([block], pa.int32()),
                            "totals": pa.array([content], pa.binary())})
