import pytest

from kerbline.session import broadcast_if_small, checkpoint_ready, spread


def test_small_sides_are_broadcast_and_large_ones_are_not(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    plan = lambda n: spark.range(1000).withColumnRenamed("id", "k").join(broadcast_if_small(df, n), "k")._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(20) and "broadcast" not in plan(19)


def test_spread_keeps_rows_and_large_inputs(spark):
    df = spark.range(100).coalesce(1)
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in spread(df).collect()) == list(range(100))
    many = spark.range(100).repartition(9)
    assert spread(many).rdd.getNumPartitions() == 9


def test_checkpoints_work_without_a_shared_folder(spark):
    checkpoint_ready(spark)
    assert spark.range(5).checkpoint().count() == 5


@pytest.mark.parametrize("name", ["p1_found", "p5_found", "manifest_profile", "json_tags_long", "stratified_sample"])
def test_queries_have_no_cross_join(spark, name):
    import os

    import __spark_entry__ as entry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
