"""What the physical plans look like, and that hot keys do not end up in one task."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from crashlens.operators.joins import anti, count_pairs, join_per_key, semi
from crashlens.operators.keys import duplicate_rows, key_set_counts
from crashlens.operators.profiling import frequent_values
from crashlens.plans import analyses, analysis_queries, operator_queries  # noqa: F401  (they fill the catalogue)
from crashlens.plans.catalog import QUERIES



def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tables, tmp_path):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
    return {name: spark.read.parquet(str(tmp_path / name)) for name in tables}


@pytest.mark.parametrize("name", [name for name in QUERIES if not name.startswith(("scan_", "sink_"))])
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "Scan ExistingRDD"):
        assert forbidden not in text


def test_scans_read_only_their_columns_and_push_filters(stored):
    text = plan(analyses.two_wheelers(stored))
    assert "StringContains(VEH_BODY_STYL_ID,MOTORCYCLE)" in text
    assert "ReadSchema: struct<CRASH_ID:bigint,UNIT_NBR:int,VIN:string,VEH_BODY_STYL_ID:string>" in text
    text = plan(analyses.men_per_crash(stored))
    assert "EqualTo(PRSN_GNDR_ID,MALE)" in text
    assert "ReadSchema: struct<CRASH_ID:bigint,PRSN_INJRY_SEV_ID:string,PRSN_GNDR_ID:string>" in text


def test_states_without_women_scan_persons_once(stored):
    assert plan(analyses.states_without_women(stored)).count("FileScan") == 1


def test_common_crashes_take_one_exchange_per_table(stored, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    text = plan(analyses.insured_crashes_without_property_damage(stored))
    assert text.count("Exchange hashpartitioning") == 2


def test_top_k_and_top_1_are_limited_before_the_exchange(stored):
    assert "TakeOrderedAndProject" in plan(analyses.zips_with_alcohol(stored))
    assert plan(analyses.top_ethnicity_per_body_style(stored)).count("WindowGroupLimit") == 2


def test_speed_makes_scan_and_shuffle_the_vehicles_once(stored):
    df = analyses.makes_with_speed_charges(stored)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    # The vehicles' own exchange is reused for the lists, and the count per colour and state for the second list.
    assert final.count("ReusedExchange") >= 2
    scans = [line.split("[")[1].split("]")[0] for line in final.splitlines() if "FileScan" in line]
    vehicle_scans = [line for line in scans if "VEH_COLOR_ID" in line]
    # The branch of the vehicles without a crash unit is empty here and may be gone from the final plan.
    assert len(vehicle_scans) in (1, 2)
    assert "isnull(CRASH_ID" in plan(df).split("== Initial Plan ==")[1]
    assert len(scans) - len(vehicle_scans) == 2


def test_number_test_of_the_top_lists_stays_above_the_scan(stored):
    text = analyses.makes_with_speed_charges(stored)._jdf.queryExecution().optimizedPlan().toString()
    # An indented tree: the lines from a scan up to its first aggregate hold no text-to-number cast.
    below = text.splitlines()
    for i, line in enumerate(below):
        if "Relation" in line:
            j = i
            while j >= 0 and "Aggregate" not in below[j]:
                assert "try_cast" not in below[j].lower() and "rlike" not in below[j].lower()
                j -= 1


@pytest.fixture
def hot(spark, conf):
    """A third of all rows under one key, no broadcast, and split sizes that fit the small data."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="50KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="16",
    )
    ids = spark.range(0, 600_000, 1, 16)
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40_000)
    return ids.select(key.alias("k"), F.xxhash64("id").alias("v"), (F.col("id") % 5).alias("g"))


@pytest.mark.parametrize(
    "operator",
    [
        lambda df: semi(df, df.select("k"), ["k"]),
        lambda df: anti(df, df.select("k").filter("k > 100"), ["k"]),
        lambda df: duplicate_rows(df, ["k"], "n"),
        lambda df: join_per_key(df, df.groupBy("k").agg(F.count("v").alias("n")), ["k"]),
    ],
    ids=["semi", "anti", "duplicate_rows", "join_per_key"],
)
def test_hot_key_is_split(hot, operator):
    df = operator(hot).groupBy(F.col("v") % 100).agg(F.count("k").alias("c"), F.sum("k").alias("s"))
    df.collect()
    assert "skew=true" in plan(df).split("== Initial Plan ==")[0]


def test_hot_key_on_both_sides_costs_no_pairs(spark, hot):
    """200,000 rows of the hot key on each side would make 4e10 pairs."""
    other = hot.withColumnRenamed("g", "h")
    size = dict(rows(hot.groupBy("k").count()))
    total = sum(n * n for n in size.values())
    assert count_pairs(hot, other, ["k"]).first()[0] == total
    by_one = count_pairs(hot.withColumn("g", F.col("v") % 1000), other, ["k"], ["g"])
    assert sum(row["count"] for row in by_one.collect()) == total
    assert sum(row["count"] for row in count_pairs(hot, other, ["k"], ["g", "h"]).collect()) == total
    assert "skew=true" in plan(by_one).split("== Initial Plan ==")[0]


def test_folded_pairs_of_a_hot_unit_stay_few(spark, hot):
    """A third of all vehicles and of all licensed persons under one unit would make 4e10 pairs."""
    units = hot.select(
        F.col("k").alias("CRASH_ID"), F.lit(1).alias("UNIT_NBR"), F.col("v").cast("string").alias("VIN"), F.lit("Y").alias("VEH_HNR_FL")
    )
    persons = hot.select(
        F.col("k").alias("CRASH_ID"),
        F.lit(1).alias("UNIT_NBR"),
        F.lit("DRIVER").alias("PRSN_TYPE_ID"),
        F.concat(F.lit("CLASS "), "g").alias("DRVR_LIC_CLS_ID"),
        F.lit("DRIVER LICENSE").alias("DRVR_LIC_TYPE_ID"),
    )
    tables = {"units": units, "primary_person": persons}
    folded = analyses.licensed_hit_and_run_folded(tables)
    found = folded.groupBy(F.col("VIN").substr(1, 2)).agg(F.sum("pairs").alias("pairs"))
    size = dict(rows(hot.groupBy("k").count()))
    assert sum(row["pairs"] for row in found.collect()) == sum(n * n for n in size.values())
    assert "skew=true" in plan(found).split("== Initial Plan ==")[0]
    crashes = analyses.hit_and_run_vehicles_with_licence(tables).groupBy(F.col("VIN").substr(1, 2)).count()
    assert sum(row["count"] for row in crashes.collect()) == 600_000
    assert "skew=true" in plan(crashes).split("== Initial Plan ==")[0]


def test_nested_key_sets_scan_the_table_once(spark, stored, conf):
    from crashlens.operators.keys import key_ladder

    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    df = key_ladder(stored["charges"], {"unit": ["CRASH_ID", "UNIT_NBR"], "person": ["CRASH_ID", "UNIT_NBR", "PRSN_NBR"]})
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    scans = [line for line in final.splitlines() if "FileScan" in line and "PRSN_NBR" in line]
    assert len(scans) == 1 and "ReusedExchange" in final


def test_key_sets_take_one_scan_and_one_exchange_of_rows(stored):
    df = key_set_counts(stored["units"], {"unit": ["CRASH_ID", "UNIT_NBR"], "vin": ["VIN"], "make": ["VEH_MAKE_ID"]})
    text = plan(df)
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1 and text.count("Expand") == 1


def test_frequent_values_scan_once_and_are_limited_before_columns_meet(stored):
    df = frequent_values(stored["units"], 5)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final and final.count("WindowGroupLimit") == 2
