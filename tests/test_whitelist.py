"""Whitelisted labels: rare odd ones, and what is spared for the many others."""

import pytest
from pyspark.sql import functions as F

from loomspark.operators import tagging
from loomspark.plans import queries

LABELS = ["x", "　The ", "the", "THE", None, "", " ", "and\x1f", "other", "and\x1f", "bathe", "x"]


@pytest.mark.parametrize("allowed", [["the", "AND "], ["", "the", "and"], [*map(str, range(20)), "the", "and"]])
def test_first_of_equal_labels(spark, allowed):
    got = spark.createDataFrame([(LABELS,), (None,)], "l array<string>").select(tagging.whitelisted(F.col("l"), allowed).alias("k")).collect()
    assert [r.k for r in got] == [["　The ", "and\x1f"], []]


def test_only_different_labels_are_stripped(spark, sf_dir):
    plan = queries.closed_tag_whitelist(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "array_distinct(coalesce(split" in plan
