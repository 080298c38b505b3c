"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import equipoise
from equipoise.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Let Spark hand this package to the Python workers, once a SparkContext.

    The archive is only built beside the driver; executors fetch it from Spark.
    """
    context = spark.sparkContext
    if getattr(context, "_equipoise_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(equipoise.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="equipoise-package-"), "equipoise-package")
    context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(home), os.path.basename(home)))
    context._equipoise_shipped = True


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is.

    ``lower`` does the same, and faster, where all characters are ASCII.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    This cuts the lineage: later stages read the files, also after an executor
    has been lost, and several consumers don't repeat the work above.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Empty the folders of tables that ``materialize`` returned and that nothing reads any more."""
    for t in tables:
        t.sparkSession.createDataFrame([], t.schema).coalesce(1).write.mode("overwrite").parquet(t.scratch)


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text (NULL: the empty text), modulo ``k``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def free_name(taken: Collection[str], name: str) -> str:
    """``name``, with underscores in front until no name in ``taken`` equals it, whatever the case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def free_names(taken: Collection[str], *names: str) -> list[str]:
    """``free_name`` of each of ``names``, all different."""
    out: list[str] = []
    for name in names:
        out.append(free_name([*taken, *out], name))
    return out


def parts_by_bytes(batches: Iterator[pa.RecordBatch], columns: Collection[str], size: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes in ``columns`` together, one row at least."""
    for batch in batches:
        total = np.zeros(batch.num_rows, np.int64)
        for c in columns:
            total += pc.binary_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(total) // size
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)
