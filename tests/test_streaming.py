"""The stateless recodes give the same rows as a stream (two micro-batches) and as a batch."""

import os
import tempfile

from equipoise.plans import fixtures as fx
from equipoise.plans.preprocess import CODED_SCALE, coded_preprocess, coded_recodes
from equipoise.operators.scaling import column_extremes, minmax_scale_spec
from equipoise.streaming.recode_stream import read_stream, run_to_folder

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch_and_scales_with_batch_extremes(spark):
    orders = fx.table(spark, SF, "orders")
    src = tempfile.mkdtemp(prefix="eq-stream-src-", dir="/tmp")
    orders.where("o_orderkey % 2 = 0").write.mode("overwrite").parquet(os.path.join(src, "part1"))
    orders.where("o_orderkey % 2 = 1").write.mode("overwrite").parquet(os.path.join(src, "part2"))
    sink = tempfile.mkdtemp(prefix="eq-stream-out-", dir="/tmp")

    batch = coded_recodes(fx.coded(spark, SF))
    ext = column_extremes(batch, list(CODED_SCALE))
    stream = read_stream(spark, f"{src}/*/*.parquet", fx.ORDERS_SCHEMA, max_files_per_trigger=1)
    q = run_to_folder(minmax_scale_spec(coded_recodes(fx.coded_from_orders(stream)), CODED_SCALE, ext), sink)
    q.awaitTermination()
    got = spark.read.parquet(sink)
    assert got.select("batch_id").distinct().count() >= 2
    expected = coded_preprocess(fx.coded(spark, SF))
    cols = sorted(expected.columns)
    a = sorted(map(tuple, got.select(*cols).collect()), key=repr)
    b = sorted(map(tuple, minmax_scale_spec(batch, CODED_SCALE, ext).select(*cols).collect()), key=repr)
    c = sorted(map(tuple, expected.select(*cols).collect()), key=repr)
    assert a == b == c
