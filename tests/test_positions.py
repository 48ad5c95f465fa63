"""Row ids, row numbers of large groups and deep slices against plain windows, and how their rows are spread."""

import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_plans import plan

from crashlens.operators.positions import deep_rank_slice, global_row_ids, narrowed, number_rows_in_ranges
from crashlens.operators.ranking import number_rows, ordering, rank_slice


@pytest.fixture(scope="module")
def hot(spark):
    """A group with a third of all rows, one of NULL, ties, NaN, and columns whose names the operators use."""
    draw = random.Random(5)
    data = []
    for i in range(9000):
        group = None if i % 50 == 0 else "hot" if i % 3 == 0 else f"g{draw.randrange(700)}"
        value = None if i % 41 == 0 else float("nan") if i % 43 == 0 else float(draw.randrange(60))
        data.append((i, group, value, "f", i, 3, i % 7))
    return spark.createDataFrame(data, "id long, g string, v double, _file string, _at long, _place int, part int").repartition(5).cache()


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_ids_are_places_without_gaps(hot, conf, partitions):
    conf(spark__sql__shuffle__partitions=partitions, spark__sql__adaptive__enabled="false")
    found = global_row_ids(hot, ["v"], ["id"])
    window = Window.orderBy(*ordering(["v"], ["id"]))
    expected = hot.withColumn("row_id", F.row_number().over(window).cast("long") - 1)
    assert found.columns == expected.columns and rows(found.drop("v")) == rows(expected.drop("v"))
    assert rows(found.drop("v")) == rows(found.drop("v"))


def test_ids_of_ties_and_of_no_rows(spark, hot):
    same = spark.range(500).select(F.lit(1).alias("a"))
    assert [r["row_id"] for r in global_row_ids(same, ["a"]).orderBy("row_id").collect()] == list(range(500))
    assert global_row_ids(hot.where("false"), ["v"], ["id"]).count() == 0
    assert number_rows_in_ranges(hot.where("false"), ["g"], ["v"], ["id"]).count() == 0


@pytest.mark.parametrize("groups", [["g"], ["g", "part"], ["_file"]])
def test_numbers_are_those_of_the_window(hot, conf, groups):
    conf(spark__sql__shuffle__partitions="6", spark__sql__autoBroadcastJoinThreshold="-1")
    found = number_rows_in_ranges(hot, groups, ["v"], ["id"])
    expected = number_rows(hot, groups, ["v"], ["id"])
    assert found.columns == expected.columns
    assert rows(found.drop("v")) == rows(expected.drop("v"))


def test_no_task_holds_a_hot_group_or_the_table(spark, hot, conf):
    conf(spark__sql__shuffle__partitions="12", spark__sql__adaptive__enabled="false")
    found = number_rows_in_ranges(hot.where("g = 'hot'"), ["g"], ["v"], ["id"])
    text = plan(found)
    assert "Window" not in text and "SinglePartition" not in text
    files = {r["f"]: r["n"] for r in spark.read.parquet(*found.inputFiles()).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n")).collect()}
    assert len(files) >= 10 and max(files.values()) < 3000 / 4


@pytest.mark.parametrize("first, last", [(1, 3), (4000, 4010), (8990, 9005), (100, 2600)])
@pytest.mark.parametrize("order", [(["v"], ["id"]), (["g"], ["v", "id"])])
def test_deep_slices_are_those_of_the_plain_one(hot, first, last, order):
    found = deep_rank_slice(hot, first, last, *order, few=300)
    expected = rank_slice(hot, first, last, *order)
    assert found.columns == expected.columns
    assert rows(found.drop("v")) == rows(expected.drop("v"))


def test_deep_slice_of_ties_and_of_no_rows(spark, hot):
    same = spark.range(5000).select(F.lit(1).alias("a"), "id")
    assert deep_rank_slice(same, 2001, 2010, ["a"], few=100).count() == 10
    assert deep_rank_slice(hot.where("false"), 1, 5, ["v"]).count() == 0


def test_only_rows_near_the_slice_are_sorted(spark):
    """50 ranks in the middle of 200,000 rows: what is left to sort is bounded, and the scan gets the two keys."""
    table = spark.range(200_000).select(F.xxhash64("id").alias("k"), "id")
    left, before = narrowed(table, 100_001, 100_050, ["k"], ["id"], few=2000)
    n = left.count()
    assert 50 <= n <= 2000 and before <= 100_000 and before + n >= 100_050
    assert rows(deep_rank_slice(table, 100_001, 100_050, ["k"], ["id"], few=2000)) == rows(rank_slice(table, 100_001, 100_050, ["k"], ["id"]))
