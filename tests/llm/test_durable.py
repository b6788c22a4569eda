import os

import pytest
from pyspark.sql import functions as F

from graphloom.llm import durable
from graphloom.llm.components import components


def held(spark):
    top = durable.folder(spark).removeprefix("file:")
    return {d for d, _, files in os.walk(top) if any(f.startswith("part-") for f in files)}


def test_spent_checkpoints_go_and_others_stay(spark):
    before = held(spark)
    a, b = durable.cut(spark.range(9)), durable.cut(spark.range(5))
    assert len(held(spark) - before) == 2
    durable.spent(a)
    assert len(held(spark) - before) == 1 and b.count() == 5
    with pytest.raises(Exception, match="(?i)exist|found"):
        a.count()
    durable.spent(b)


def test_scratch_deletes_what_is_cut_within(spark, tmp_path):
    before = held(spark)
    with durable.scratch():
        durable.cut(spark.range(7)).write.parquet(str(tmp_path / "o"))
        assert held(spark) - before
    assert held(spark) == before and spark.read.parquet(str(tmp_path / "o")).count() == 7
    kept = durable.cut(spark.range(3))
    assert kept.count() == 3
    durable.spent(kept)


def test_rounds_of_components_leave_one_checkpoint(spark):
    before = held(spark)
    edges = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(edges.unionByName(spark.createDataFrame([(9001, 9000), (9001, 9001), (None, 1)], "a long, b long")))
    assert len(held(spark) - before) == 1
    assert {(r.id, r.component) for r in got.collect()} == {(i, 0) for i in range(3001)} | {(9000, 9000), (9001, 9000)}
