"""One query per operator, over the order tables or the crash tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.functions import (
    any_column,
    at_least_text,
    contains_any,
    icontains,
    iin,
    is_non_numeric,
    not_iin,
    not_in,
    parse_number,
)
from crashlens.operators.aggregates import count_rows, count_values, having, sum_columns
from crashlens.operators.joins import anti, common_keys, count_pairs, join_on, join_per_key, restrict_to_top, semi
from crashlens.operators.keys import distinct_on, duplicate_keys, duplicate_rows, key_ladder, key_set_counts
from crashlens.operators.positions import deep_rank_slice, global_row_ids, number_rows_in_ranges
from crashlens.operators.profiling import category_values, describe, describe_numeric, frequent_values, null_profile
from crashlens.operators.ranking import number_rows, rank_slice, sort_by, top1_per_group, topk
from crashlens.plans import fixtures
from crashlens.plans import values as v
from crashlens.plans.catalog import query
from crashlens.plans.fixtures import load, with_tables
from crashlens.sources import SCHEMAS, read_rejects, read_strings, read_table, scratch_path, stage_table, write_result

# Sources and sinks


def _charges_as_csv(spark: SparkSession, sf_dir: str) -> str:
    """Charges as CSV with the columns in another order, one more column, and NA for some person numbers.

    Written once in a session for each data folder.
    """
    if (spark.sparkContext.applicationId, sf_dir) not in _CSV:
        path = scratch_path(spark, "charges-csv")
        person = F.when(F.col("PRSN_NBR") == 3, "NA").otherwise(F.col("PRSN_NBR").cast("string"))
        charges = fixtures.charges(spark, sf_dir)
        rows = charges.select("CHARGE", person.alias("PRSN_NBR"), "UNIT_NBR", "CRASH_ID", F.lit("x").alias("REMARK"))
        rows.write.csv(path, header=True)
        _CSV[spark.sparkContext.applicationId, sf_dir] = path
    return _CSV[spark.sparkContext.applicationId, sf_dir]


_CSV: dict[tuple[str, str], str] = {}


def _broken_charges_as_csv(spark: SparkSession, sf_dir: str) -> str:
    """Charges as CSV; of persons 4 to 6 the records have two fields too many, two too few, or an open quote."""
    path = scratch_path(spark, "broken-csv")
    record = F.concat_ws(",", F.coalesce("CHARGE", F.lit("")), "PRSN_NBR", "UNIT_NBR", "CRASH_ID")
    person = F.col("PRSN_NBR")
    broken = F.when(person == 4, F.concat(record, F.lit(",more,1"))).when(person == 5, F.concat_ws(",", "UNIT_NBR", "CRASH_ID"))
    broken = broken.when(person == 6, F.concat(F.lit('"'), record)).otherwise(record)
    # One column that holds whole records, so that the writer adds the header and leaves them as they are.
    lines = fixtures.charges(spark, sf_dir).select(broken.alias("CHARGE,PRSN_NBR,UNIT_NBR,CRASH_ID"))
    lines.write.options(header=True, sep="\x01", quote="", escapeQuotes=False).csv(path)
    return path


@query(
    with_tables(
        """
SELECT CRASH_ID, UNIT_NBR, CASE WHEN PRSN_NBR <> 3 THEN PRSN_NBR END AS PRSN_NBR, CHARGE, 'x' AS REMARK
FROM charges""",
        "charges",
    )
)
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, _charges_as_csv(spark, sf_dir), SCHEMAS["charges"])


@query(
    with_tables(
        """
SELECT CHARGE, CASE WHEN PRSN_NBR = 3 THEN 'NA' ELSE CAST(PRSN_NBR AS VARCHAR) END AS PRSN_NBR,
 CAST(UNIT_NBR AS VARCHAR) AS UNIT_NBR, CAST(CRASH_ID AS VARCHAR) AS CRASH_ID, 'x' AS REMARK
FROM charges""",
        "charges",
    )
)
def scan_csv_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_strings(spark, _charges_as_csv(spark, sf_dir))


@query(
    with_tables(
        """
SELECT CHARGE, CASE WHEN PRSN_NBR = 3 THEN 'NA' ELSE CAST(PRSN_NBR AS VARCHAR) END AS PRSN_NBR,
 UNIT_NBR, CRASH_ID, 'x' AS REMARK
FROM charges""",
        "charges",
    )
)
def scan_csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred types follow the data: the crash id is int or bigint by its size, so it is widened here."""
    inferred = read_table(spark, _charges_as_csv(spark, sf_dir), infer=True)
    return inferred.withColumn("CRASH_ID", F.col("CRASH_ID").cast("bigint"))


@query(
    with_tables(
        """
SELECT CASE PRSN_NBR WHEN 4 THEN concat(record, ',more,1') WHEN 5 THEN concat(UNIT_NBR, ',', CRASH_ID) ELSE concat('"', record) END AS record
FROM (SELECT *, concat(coalesce(CHARGE, ''), ',', PRSN_NBR, ',', UNIT_NBR, ',', CRASH_ID) AS record FROM charges) r
WHERE PRSN_NBR IN (4, 5, 6)""",
        "charges",
    )
)
def scan_csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_rejects(spark, _broken_charges_as_csv(spark, sf_dir)).select("record")


@query(
    with_tables("SELECT CRASH_ID, UNIT_NBR, PRSN_NBR, CHARGE FROM charges WHERE PRSN_NBR NOT IN (4, 5, 6)", "charges")
)
def scan_csv_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _broken_charges_as_csv(spark, sf_dir), scratch_path(spark, "charges")
    return stage_table(spark, source, target, SCHEMAS["charges"], on_bad="reject").table


@query("SELECT * FROM orders")
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_result(load(spark, sf_dir, "orders"), scratch_path(spark, "orders"))


# Projections


@query("SELECT p_partkey, p_brand, p_type FROM part")
def project_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")


@query("SELECT l_orderkey, l_linenumber, l_linenumber + l_partkey AS number_sum FROM lineitem")
def project_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    total = F.col("l_linenumber") + F.col("l_partkey")
    return lines.withColumn("number_sum", total).select("l_orderkey", "l_linenumber", "number_sum")


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").drop("c_name", "c_acctbal")


@query(
    with_tables(
        """
SELECT VEH_LIC_STATE_ID, TRY_CAST(VEH_LIC_STATE_ID AS FLOAT) IS NOT NULL AS is_float,
 TRY_CAST(VEH_LIC_STATE_ID AS INT) IS NOT NULL AS is_int, COUNT(*) AS n
FROM units GROUP BY VEH_LIC_STATE_ID""",
        "units",
    )
)
def try_cast_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = count_rows(fixtures.units(spark, sf_dir), ["VEH_LIC_STATE_ID"], "n")
    return states.select(
        "VEH_LIC_STATE_ID",
        parse_number("VEH_LIC_STATE_ID", "float").isNotNull().alias("is_float"),
        parse_number("VEH_LIC_STATE_ID", "int").isNotNull().alias("is_int"),
        "n",
    )


# Filters


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase'")
def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "event_type")


@query(
    with_tables(
        "SELECT CRASH_ID, DAMAGED_PROPERTY FROM damages WHERE DAMAGED_PROPERTY <> 'FENCE'",
        "damages",
    )
)
def filter_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.damages(spark, sf_dir).filter(F.col("DAMAGED_PROPERTY") != "FENCE")


@query(
    """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
WHERE l_quantity > 40 AND l_discount >= 0.05 AND l_linenumber < 6 AND l_suppkey <= 1000"""
)
def filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = (
        (F.col("l_quantity") > 40)
        & (F.col("l_discount") >= 0.05)
        & (F.col("l_linenumber") < 6)
        & (F.col("l_suppkey") <= 1000)
    )
    lines = load(spark, sf_dir, "lineitem").filter(ranges)
    return lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query(
    with_tables(
        """
SELECT CRASH_ID, VEH_DMAG_SCL_1_ID FROM units
WHERE VEH_DMAG_SCL_1_ID NOT IN ('NA', 'NO DAMAGE', 'INVALID VALUE') AND VEH_DMAG_SCL_1_ID >= 'DAMAGED 5'""",
        "units",
    )
)
def filter_string_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    heavy = at_least_text("VEH_DMAG_SCL_1_ID", v.DAMAGE_FLOOR, v.NO_DAMAGE_LEVEL)
    return fixtures.units(spark, sf_dir).filter(heavy).select("CRASH_ID", "VEH_DMAG_SCL_1_ID")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return customers.select("c_custkey", "c_mktsegment")


@query(
    with_tables(
        """
SELECT CRASH_ID, UNIT_NBR, PRSN_ETHNICITY_ID FROM primary_person
WHERE PRSN_ETHNICITY_ID NOT IN ('NA', 'UNKNOWN', 'OTHER')""",
        "primary_person",
    )
)
def filter_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = fixtures.primary_person(spark, sf_dir).filter(not_in("PRSN_ETHNICITY_ID", v.NO_ETHNICITY))
    return persons.select("CRASH_ID", "UNIT_NBR", "PRSN_ETHNICITY_ID")


@query(
    with_tables(
        "SELECT CRASH_ID, DAMAGED_PROPERTY FROM damages WHERE upper(DAMAGED_PROPERTY) IN ('NONE', 'NONE1')",
        "damages",
    )
)
def filter_iin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.damages(spark, sf_dir).filter(iin("DAMAGED_PROPERTY", v.NO_PROPERTY_DAMAGE))


@query(
    with_tables(
        """
SELECT CRASH_ID, UNIT_NBR, DRVR_LIC_STATE_ID FROM primary_person
WHERE lower(DRVR_LIC_STATE_ID) NOT IN ('na', 'unknown', 'other')""",
        "primary_person",
    )
)
def filter_not_iin(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = fixtures.primary_person(spark, sf_dir).filter(not_iin("DRVR_LIC_STATE_ID", v.NO_STATE))
    return persons.select("CRASH_ID", "UNIT_NBR", "DRVR_LIC_STATE_ID")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
def filter_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").filter(F.col("p_name").contains("ring")).select("p_partkey", "p_name")


@query(
    with_tables(
        "SELECT CRASH_ID, CHARGE FROM charges WHERE contains(CHARGE, 'SPEED') OR contains(CHARGE, 'FAST')",
        "charges",
    )
)
def filter_contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    speeding = fixtures.charges(spark, sf_dir).filter(contains_any("CHARGE", v.SPEED_CHARGES))
    return speeding.select("CRASH_ID", "CHARGE")


@query(
    with_tables(
        "SELECT CRASH_ID, CONTRIB_FACTR_2_ID FROM units WHERE contains(lower(CONTRIB_FACTR_2_ID), 'alcohol')",
        "units",
    )
)
def filter_icontains(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = fixtures.units(spark, sf_dir).filter(icontains("CONTRIB_FACTR_2_ID", v.ALCOHOL))
    return units.select("CRASH_ID", "CONTRIB_FACTR_2_ID")


@query(with_tables("SELECT CRASH_ID, DAMAGED_PROPERTY FROM damages WHERE upper(DAMAGED_PROPERTY) LIKE 'N%'", "damages"))
def filter_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.damages(spark, sf_dir).filter(F.upper("DAMAGED_PROPERTY").like("N%"))


@query(with_tables("SELECT CRASH_ID, UNIT_NBR, VIN FROM units WHERE VIN IS NOT NULL", "units"))
def filter_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.units(spark, sf_dir).filter(F.col("VIN").isNotNull()).select(*v.VEHICLE)


@query(with_tables("SELECT CRASH_ID, UNIT_NBR FROM charges WHERE CHARGE IS NULL", "charges"))
def filter_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.charges(spark, sf_dir).filter(F.col("CHARGE").isNull()).select(*v.CRASH_UNIT)


@query(
    with_tables(
        "SELECT CRASH_ID, UNIT_NBR, DRVR_ZIP FROM primary_person WHERE DRVR_ZIP IS NOT NULL", "primary_person"
    )
)
def drop_null_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = fixtures.primary_person(spark, sf_dir).na.drop(subset=["DRVR_ZIP"])
    return persons.select(*v.CRASH_UNIT, "DRVR_ZIP")


@query(
    with_tables(
        """
SELECT CRASH_ID, UNIT_NBR, VEH_LIC_STATE_ID FROM units WHERE TRY_CAST(VEH_LIC_STATE_ID AS FLOAT) IS NULL""",
        "units",
    )
)
def filter_non_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = fixtures.units(spark, sf_dir).filter(is_non_numeric("VEH_LIC_STATE_ID"))
    return units.select(*v.CRASH_UNIT, "VEH_LIC_STATE_ID")


@query(
    """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE (o_orderstatus = 'O' OR o_totalprice > 400000) AND NOT o_orderpriority = '5-LOW'"""
)
def filter_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = (F.col("o_orderstatus") == "O") | (F.col("o_totalprice") > 400000)
    orders = load(spark, sf_dir, "orders").filter(condition & ~(F.col("o_orderpriority") == "5-LOW"))
    return orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    with_tables(
        """
SELECT CRASH_ID, UNIT_NBR, VIN FROM units
WHERE contains(lower(CONTRIB_FACTR_1_ID), 'alcohol') OR contains(lower(CONTRIB_FACTR_2_ID), 'alcohol')
 OR contains(lower(CONTRIB_FACTR_P1_ID), 'alcohol')""",
        "units",
    )
)
def filter_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    alcohol = any_column(lambda factor: icontains(factor, v.ALCOHOL), v.CONTRIBUTING_FACTORS)
    return fixtures.units(spark, sf_dir).filter(alcohol).select(*v.VEHICLE)


# Joins


@query(
    """
SELECT o_orderkey, l_linenumber, l_partkey, o_custkey, o_orderpriority
FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""
)
def join_inner_1key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = load(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return join_on(orders, lines.select("o_orderkey", "l_linenumber", "l_partkey"), ["o_orderkey"])


@query(
    with_tables(
        """
SELECT c.CRASH_ID, c.UNIT_NBR, c.PRSN_NBR, c.CHARGE, u.vehicles
FROM charges c JOIN (
 SELECT CRASH_ID, UNIT_NBR, COUNT(*) AS vehicles FROM (SELECT DISTINCT CRASH_ID, UNIT_NBR, VIN FROM units) d
 GROUP BY CRASH_ID, UNIT_NBR) u
ON c.CRASH_ID = u.CRASH_ID AND c.UNIT_NBR = u.UNIT_NBR""",
        "units",
        "charges",
    )
)
def join_inner_2key(spark: SparkSession, sf_dir: str) -> DataFrame:
    vehicles = count_rows(distinct_on(fixtures.units(spark, sf_dir), v.VEHICLE), v.CRASH_UNIT, "vehicles")
    return join_per_key(fixtures.charges(spark, sf_dir), vehicles, v.CRASH_UNIT)


@query(
    with_tables(
        """
SELECT VEH_MAKE_ID, CHARGE, COUNT(*) AS pairs
FROM (SELECT DISTINCT CRASH_ID, UNIT_NBR, VIN, VEH_MAKE_ID FROM units) u
JOIN charges c ON u.CRASH_ID = c.CRASH_ID AND u.UNIT_NBR = c.UNIT_NBR
GROUP BY VEH_MAKE_ID, CHARGE""",
        "units",
        "charges",
    )
)
def join_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a many-to-many join, counted without building them."""
    vehicles = distinct_on(fixtures.units(spark, sf_dir), [*v.VEHICLE, "VEH_MAKE_ID"])
    return count_pairs(vehicles, fixtures.charges(spark, sf_dir), v.CRASH_UNIT, ["VEH_MAKE_ID", "CHARGE"], "pairs")


@query(
    """
SELECT c_custkey, c_mktsegment FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"""
)
def join_left_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = load(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return anti(customers, urgent.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query(
    """
SELECT p_partkey, p_brand FROM part
WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)"""
)
def join_left_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = load(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= 50)
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return semi(parts, large.withColumnRenamed("l_partkey", "p_partkey"), ["p_partkey"])


@query(
    with_tables(
        """
SELECT CRASH_ID, UNIT_NBR FROM units INTERSECT
SELECT CRASH_ID, UNIT_NBR FROM charges WHERE contains(CHARGE, 'SPEED') OR contains(CHARGE, 'FAST')""",
        "units",
        "charges",
    )
)
def join_common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crash units that have a speeding charge: the join of two distinct key sets."""
    speeding = fixtures.charges(spark, sf_dir).filter(contains_any("CHARGE", v.SPEED_CHARGES))
    return common_keys(fixtures.units(spark, sf_dir), speeding, v.CRASH_UNIT)


@query(
    """
SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 10)"""
)
def join_topk_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return restrict_to_top(orders, orders, "o_custkey", 10)


# Aggregations


@query(with_tables("SELECT UNIT_NBR, COUNT(CHARGE) AS charge_count FROM charges GROUP BY UNIT_NBR", "charges"))
def agg_count_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_values(fixtures.charges(spark, sf_dir), ["UNIT_NBR"], "CHARGE", "charge_count")


@query(
    with_tables("SELECT DAMAGED_PROPERTY, COUNT(*) AS crashes FROM damages GROUP BY DAMAGED_PROPERTY", "damages")
)
def agg_count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows(fixtures.damages(spark, sf_dir), ["DAMAGED_PROPERTY"], "crashes")


@query(
    """
SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS linenumbers, CAST(SUM(l_partkey) AS BIGINT) AS partkeys
FROM lineitem GROUP BY l_returnflag"""
)
def agg_multi_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = {"linenumbers": "l_linenumber", "partkeys": "l_partkey"}
    return sum_columns(load(spark, sf_dir, "lineitem"), ["l_returnflag"], sums)


@query(
    """
SELECT o_orderstatus, o_orderpriority, COUNT(*) AS orders FROM orders GROUP BY o_orderstatus, o_orderpriority"""
)
def agg_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows(load(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "orders")


@query("SELECT l_orderkey, COUNT(*) AS lines FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) > 8")
def agg_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.count(F.lit(1)).alias("lines")
    return having(load(spark, sf_dir, "lineitem"), ["l_orderkey"], lines, F.col("lines") > 8)


@query("SELECT COUNT(*) AS n FROM lineitem")
def global_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows(load(spark, sf_dir, "lineitem"), count="n")


@query(with_tables("SELECT DISTINCT * FROM units", "units"))
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.units(spark, sf_dir).distinct()


@query(with_tables("SELECT DISTINCT CRASH_ID, UNIT_NBR, VIN FROM units", "units"))
def distinct_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_on(fixtures.units(spark, sf_dir), v.VEHICLE)


@query(
    with_tables(
        """
SELECT 'rows' AS key_set, COUNT(*) AS combinations FROM charges
UNION ALL SELECT 'unit', COUNT(*) FROM (SELECT DISTINCT CRASH_ID, UNIT_NBR FROM charges) a
UNION ALL SELECT 'person', COUNT(*) FROM (SELECT DISTINCT CRASH_ID, UNIT_NBR, PRSN_NBR FROM charges) b
UNION ALL SELECT 'charge', COUNT(*) FROM (SELECT DISTINCT CRASH_ID, UNIT_NBR, PRSN_NBR, CHARGE FROM charges) c""",
        "charges",
    )
)
def count_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    person = [*v.CRASH_UNIT, "PRSN_NBR"]
    key_sets = {"unit": v.CRASH_UNIT, "person": person, "charge": [*person, "CHARGE"]}
    return key_ladder(fixtures.charges(spark, sf_dir), key_sets)


_KEY_SETS = {
    "unit": v.CRASH_UNIT,
    "vehicle": ["CRASH_ID", "VIN"],
    "make and style": ["VEH_MAKE_ID", "VEH_BODY_STYL_ID"],
    "make": ["VEH_MAKE_ID"],
    "state and colour": ["VEH_LIC_STATE_ID", "VEH_COLOR_ID"],
}


@query(
    with_tables(
        "SELECT 'rows' AS key_set, COUNT(*) AS combinations FROM units"
        + "".join(
            f"\nUNION ALL SELECT '{name}', COUNT(*) FROM (SELECT DISTINCT {', '.join(keys)} FROM units) s{i}"
            for i, (name, keys) in enumerate(_KEY_SETS.items())
        ),
        "units",
    )
)
def count_distinct_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_set_counts(fixtures.units(spark, sf_dir), _KEY_SETS)


@query(
    """
SELECT l_orderkey, l_linenumber, COUNT(*) AS lines FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1"""
)
def duplicates_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "lines")


@query(
    with_tables(
        """
SELECT CRASH_ID, VIN, COUNT(*) AS units
FROM (SELECT DISTINCT CRASH_ID, UNIT_NBR, VIN FROM units WHERE VIN IS NOT NULL) d
GROUP BY CRASH_ID, VIN HAVING COUNT(*) > 1""",
        "units",
    )
)
def duplicates_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles that appear as several units of one crash."""
    vehicles = fixtures.units(spark, sf_dir).filter(F.col("VIN").isNotNull())
    return duplicate_keys(distinct_on(vehicles, v.VEHICLE), ["CRASH_ID", "VIN"], "units")


@query(
    """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, g.lines
FROM lineitem l JOIN (
 SELECT l_orderkey, l_linenumber, COUNT(*) AS lines FROM lineitem GROUP BY l_orderkey, l_linenumber
 HAVING COUNT(*) > 1) g
ON l.l_orderkey = g.l_orderkey AND l.l_linenumber = g.l_linenumber"""
)
def duplicates_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return duplicate_rows(lines, ["l_orderkey", "l_linenumber"], "lines")


# Profiles

_UNIT_COLUMNS = [column.rsplit(" AS ", 1)[1] for column in fixtures.UNITS]


@query(
    with_tables(
        "SELECT "
        + ", ".join(f"COUNT(CASE WHEN {name} IS NULL THEN 1 END) AS {name}" for name in _UNIT_COLUMNS)
        + " FROM units",
        "units",
    )
)
def null_profile_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_profile(fixtures.units(spark, sf_dir))


@query(
    """
SELECT COUNT(CASE WHEN l_orderkey IS NULL THEN 1 END) AS l_orderkey,
 COUNT(CASE WHEN ratio IS NULL OR isnan(ratio) THEN 1 END) AS ratio
FROM (SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 2 THEN NULL
 ELSE l_discount END AS ratio FROM lineitem) r"""
)
def null_profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_linenumber")
    ratio = F.when(number == 1, float("nan")).when(number != 2, F.col("l_discount")).alias("ratio")
    return null_profile(load(spark, sf_dir, "lineitem").select("l_orderkey", ratio))


def _line_summary(name: str, number: str) -> str:
    return f"""SELECT '{name}' AS "column", COUNT({name}) AS "count", ROUND(AVG({number}), 4) AS "mean",
 ROUND(STDDEV_SAMP({number}), 4) AS "stddev", CAST(MIN({name}) AS VARCHAR) AS "min", CAST(MAX({name}) AS VARCHAR) AS "max"
FROM lineitem"""


@query(
    "\nUNION ALL ".join(
        [
            _line_summary(name, name)
            for name in "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()
        ]
        + [_line_summary(name, f"TRY_CAST({name} AS DOUBLE)") for name in ("l_returnflag", "l_linestatus")]
        + [_line_summary("l_shipdate", "CAST(NULL AS DOUBLE)")]
    )
)
def describe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = describe(load(spark, sf_dir, "lineitem"))
    return summary.withColumns({name: F.round(name, 4) for name in ("mean", "stddev")})


@query(
    "\nUNION ALL ".join(
        f"""SELECT '{name}' AS "column", COUNT({name}) AS "count", ROUND(AVG({name}), 4) AS "mean",
 ROUND(STDDEV_SAMP({name}), 4) AS "stddev", CAST(MIN({name}) AS DOUBLE) AS "min", CAST(MAX({name}) AS DOUBLE) AS "max"
FROM part"""
        for name in ("p_partkey", "p_size", "p_retailprice")
    )
)
def describe_part_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = describe_numeric(load(spark, sf_dir, "part"), ["p_partkey", "p_size", "p_retailprice"])
    return summary.withColumns({name: F.round(name, 4) for name in ("mean", "stddev")})


@query(
    with_tables(
        "\nUNION ALL ".join(
            f"""SELECT '{name}' AS "column", COUNT({name}) AS "count",
 ROUND(AVG(TRY_CAST({name} AS DOUBLE)), 4) AS "mean", ROUND(STDDEV_SAMP(TRY_CAST({name} AS DOUBLE)), 4) AS "stddev",
 CAST(MIN({name}) AS VARCHAR) AS "min", CAST(MAX({name}) AS VARCHAR) AS "max"
FROM charges"""
            for name in ("CRASH_ID", "UNIT_NBR", "PRSN_NBR", "CHARGE")
        ),
        "charges",
    )
)
def describe_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = describe(fixtures.charges(spark, sf_dir))
    return summary.withColumns({name: F.round(name, 4) for name in ("mean", "stddev")})


@query("SELECT DISTINCT p_type FROM part")
def category_values_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_values(load(spark, sf_dir, "part"), "p_type")


@query(with_tables("SELECT DISTINCT CHARGE FROM charges WHERE contains(CHARGE, 'RUN') OR CHARGE LIKE 's%'", "charges"))
def category_values_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    charge = F.col("CHARGE")
    return category_values(fixtures.charges(spark, sf_dir), "CHARGE", charge.contains("RUN") | charge.like("s%"))


@query(
    with_tables(
        """
SELECT "column", place, "value", "count", n_distinct, n_missing FROM (
 SELECT "column", "value", "count",
  CAST(ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY "count" DESC, "value" NULLS LAST) AS INT) AS place,
  COUNT("value") OVER (PARTITION BY "column") AS n_distinct,
  CAST(COALESCE(SUM("count") FILTER (WHERE "value" IS NULL) OVER (PARTITION BY "column"), 0) AS BIGINT) AS n_missing
 FROM ("""
        + "\n  UNION ALL ".join(
            f"""SELECT '{name}' AS "column", CAST({name} AS VARCHAR) AS "value", COUNT(*) AS "count" FROM units GROUP BY {name}"""
            for name in _UNIT_COLUMNS
        )
        + ") c) r\nWHERE place <= 8",
        "units",
    )
)
def frequent_values_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_values(fixtures.units(spark, sf_dir), 8)


# Windows, sorting, ranks


@query(
    """
SELECT o_custkey, o_orderpriority, orders,
 CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY orders DESC, o_orderpriority) AS INT) AS rn
FROM (SELECT o_custkey, o_orderpriority, COUNT(*) AS orders FROM orders GROUP BY o_custkey, o_orderpriority) c"""
)
def window_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_rows(load(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "orders")
    return number_rows(counts, ["o_custkey"], ["orders"], ["o_orderpriority"])


@query(
    """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
 SELECT o_custkey, o_orderkey, o_totalprice,
  ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) r
WHERE rn = 1"""
)
def window_top1_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top1_per_group(orders, ["o_custkey"], ["o_totalprice"], ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_by(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], ["o_orderkey"])


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey")
def sort_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_by(load(spark, sf_dir, "part").select("p_partkey", "p_name"), (), ["p_name", "p_partkey"])


@query("SELECT p_brand, COUNT(*) AS parts FROM part GROUP BY p_brand ORDER BY parts DESC, p_brand LIMIT 5")
def topk_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(count_rows(load(spark, sf_dir, "part"), ["p_brand"], "parts"), 5, ["parts"], ["p_brand"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def top1_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 1, ["o_totalprice"], ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3 OFFSET 2")
def rank_slice_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rank_slice(orders, 3, 5, ["o_totalprice"], ["o_orderkey"])


@query(
    """
SELECT l_orderkey, l_linenumber, l_extendedprice,
 ROW_NUMBER() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) - 1 AS row_id
FROM lineitem"""
)
def sort_global_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return global_row_ids(lines, ["l_extendedprice"], ["l_orderkey", "l_linenumber"])


@query(
    """
SELECT l_returnflag, l_shipdate, l_orderkey, l_linenumber,
 ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS rn
FROM lineitem"""
)
def window_row_number_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber")
    return number_rows_in_ranges(lines, ["l_returnflag"], ["l_shipdate"], ["l_orderkey", "l_linenumber"])


@query(
    """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey
LIMIT 500 OFFSET (SELECT COUNT(*) // 2 FROM orders)"""
)
def rank_slice_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    middle = orders.count() // 2
    return deep_rank_slice(orders, middle + 1, middle + 500, ["o_totalprice"], ["o_orderkey"], few=10_000)
