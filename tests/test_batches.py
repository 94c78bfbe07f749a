"""Workers that measure texts get batches of bounded bytes."""

import pytest

from loomspark.plans import queries
from loomspark.plans.store import BATCH_BYTES

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("name", ["text_metrics", "length_gate"])
@pytest.mark.parametrize("given,want", [("64m", BATCH_BYTES), ("67108864b", BATCH_BYTES), ("1m", 1 << 20)])
def test_batches_by_bytes(spark, sf_dir, name, given, want):
    before = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, given)
        queries.queries()[name](spark, sf_dir)
        assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(KEY)) == want
    finally:
        spark.conf.set(KEY, before)
