"""Session helpers: building a session, the shared checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Broadcast a side only when it is proven to have at most so many rows and bytes.
BROADCAST_ROW_LIMIT = 200_000
BROADCAST_BYTE_LIMIT = 64 << 20
_FIXED_WIDTH = {"boolean", "byte", "short", "integer", "long", "float", "double", "date", "timestamp", "timestamp_ntz"}


def get_session(master: str | None = None, app: str = "equipoise", shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session with AQE (coalescing + skew-join split) on and the UI off."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("EQUIPOISE_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tune_session(spark)
    return spark


def tune_session(spark: SparkSession) -> None:
    """Runtime settings the engine relies on; call once per session (idempotent).

    * shared checkpoint folder (see ``ensure_checkpoint_dir``);
    * HotSpot does not JIT-compile methods above 8000 bytes of bytecode, so a
      whole-stage method that large runs interpreted -- many times slower for the
      wide recode projections.  Unless the user chose a value, such stages fall
      back to per-expression codegen (``spark.sql.codegen.hugeMethodLimit=8000``,
      as Spark's configuration docs advise for HotSpot).
    """
    ensure_checkpoint_dir(spark)
    try:
        if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    except Exception:  # noqa: BLE001 -- a locked-down session keeps its own codegen settings
        pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``; set a scratch one only when unset.

    On a cluster the setting must name a shared (HDFS/object store) folder; a
    machine-local scratch folder is only created for local-mode sessions.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- Spark Connect: the server's spark.checkpoint.dir is used as is
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="equipoise-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for result round-trips."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if not base:
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    return f"{base}/equipoise-{name}-{uuid.uuid4().hex}"


def fits_broadcast(small: DataFrame, limit: int = BROADCAST_ROW_LIMIT, known_rows: int | None = None) -> bool:
    """Whether ``small`` is proven to be within the row and byte limits of a broadcast.

    Columns of fixed width count 8 bytes a row.  Others are measured in the job that counts the rows, so
    ``known_rows`` spares that job only where all columns have fixed width.
    """
    loose = [f.name for f in small.schema.fields if f.dataType.typeName() not in _FIXED_WIDTH]
    fixed = 8 * (len(small.columns) - len(loose))
    if known_rows is not None and (known_rows > limit or not loose):
        return known_rows <= limit and known_rows * fixed <= BROADCAST_BYTE_LIMIT
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in loose), F.lit(fixed))
    row = small.agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).first()
    return row["rows"] <= limit and (row["bytes"] or 0) <= BROADCAST_BYTE_LIMIT


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROW_LIMIT,
               known_rows: int | None = None) -> DataFrame:
    """Join ``small`` to ``big``, broadcasting it only when ``fits_broadcast`` proves its size.

    Beyond the limits Spark's shuffle join (with AQE skew splitting) is used.
    """
    if fits_broadcast(small, limit, known_rows):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)
