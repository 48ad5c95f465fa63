"""Crash-shaped tables derived from the order tables, for checks at any scale.

They hold exact duplicate vehicles, several vehicles per crash unit, NULL beside NA, mixed case, numeric text in
state and colour, and zip codes with a leading zero. Everything is integer arithmetic on keys, written as SQL
expressions that mean the same in Spark and in other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = """
l_orderkey AS CRASH_ID
l_linenumber % 3 + 1 AS UNIT_NBR
CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE concat('VIN', CAST(l_partkey AS VARCHAR(20))) END AS VIN
CASE WHEN CAST(substring(p_brand, 7) AS INT) % 12 = 0 THEN 'NA' ELSE upper(p_brand) END AS VEH_MAKE_ID
CASE l_suppkey % 9 WHEN 0 THEN 'MOTORCYCLE' WHEN 1 THEN 'POLICE MOTORCYCLE' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'NA' WHEN 4 THEN 'NOT REPORTED' WHEN 5 THEN NULL WHEN 6 THEN 'PICKUP' ELSE p_type END AS VEH_BODY_STYL_ID
CASE WHEN l_suppkey % 7 = 0 THEN 'Y' WHEN l_suppkey % 7 = 1 THEN NULL ELSE 'N' END AS VEH_HNR_FL
CAST(l_partkey % 4 AS INT) AS TOT_INJRY_CNT
CAST(CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS INT) AS DEATH_CNT
CASE l_partkey % 13 WHEN 0 THEN 'UNDER INFLUENCE - ALCOHOL' WHEN 1 THEN NULL ELSE 'NONE' END AS CONTRIB_FACTR_1_ID
CASE l_partkey % 17 WHEN 0 THEN 'Had Been Drinking Alcohol' WHEN 1 THEN NULL ELSE 'NA' END AS CONTRIB_FACTR_2_ID
CASE l_partkey % 19 WHEN 0 THEN 'alcohol' ELSE NULL END AS CONTRIB_FACTR_P1_ID
CASE (l_partkey + l_suppkey) % 10 WHEN 0 THEN 'NA' WHEN 1 THEN 'NO DAMAGE' WHEN 2 THEN 'INVALID VALUE' WHEN 3 THEN NULL WHEN 4 THEN 'DAMAGED 4' WHEN 5 THEN 'DAMAGED 5' WHEN 6 THEN 'DAMAGED 6' WHEN 7 THEN 'DAMAGED 7 HIGHEST' WHEN 8 THEN 'DAMAGED 1 MINIMUM' ELSE 'DAMAGED 2' END AS VEH_DMAG_SCL_1_ID
CASE l_suppkey % 8 WHEN 0 THEN 'DAMAGED 5' WHEN 1 THEN 'NO DAMAGE' WHEN 2 THEN NULL WHEN 3 THEN 'INVALID VALUE' ELSE 'NA' END AS VEH_DMAG_SCL_2_ID
CASE l_suppkey % 5 WHEN 0 THEN 'LIABILITY INSURANCE POLICY' WHEN 1 THEN 'PROOF OF LIABILITY INSURANCE' WHEN 2 THEN 'INSURANCE BINDER' WHEN 3 THEN 'NA' ELSE NULL END AS FIN_RESP_TYPE_ID
CASE l_suppkey % 40 WHEN 37 THEN '98' WHEN 38 THEN 'NaN' WHEN 39 THEN NULL ELSE concat('ST', CAST(l_suppkey % 40 AS VARCHAR(20))) END AS VEH_LIC_STATE_ID
CASE l_partkey % 16 WHEN 0 THEN 'NA' WHEN 1 THEN '99' WHEN 2 THEN NULL ELSE concat('COL', CAST(l_partkey % 16 AS VARCHAR(20))) END AS VEH_COLOR_ID
""".strip().splitlines()

PRIMARY_PERSON = """
l_orderkey AS CRASH_ID
l_linenumber % 3 + 1 AS UNIT_NBR
l_linenumber AS PRSN_NBR
CASE WHEN l_suppkey % 3 = 0 THEN 'KILLED' WHEN l_suppkey % 3 = 1 THEN 'NOT INJURED' ELSE NULL END AS PRSN_INJRY_SEV_ID
CASE WHEN l_suppkey % 3 = 0 AND l_partkey % 5 <> 0 THEN '10:15 AM' ELSE NULL END AS PRSN_DEATH_TIME
CASE WHEN o_custkey % 5 = 0 THEN 'MALE' WHEN l_partkey % 3 = 0 THEN 'FEMALE' WHEN l_partkey % 3 = 1 THEN 'MALE' ELSE NULL END AS PRSN_GNDR_ID
CASE WHEN l_partkey % 2 = 0 THEN 'NOT DEPLOYED' ELSE 'DEPLOYED' END AS PRSN_AIRBAG_ID
CASE l_linenumber WHEN 7 THEN 'PEDESTRIAN' WHEN 6 THEN 'DRIVER OF MOTORCYCLE TYPE VEHICLE' ELSE 'DRIVER' END AS PRSN_TYPE_ID
CASE l_suppkey % 6 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'UNLICENSED' WHEN 2 THEN NULL ELSE 'CLASS C' END AS DRVR_LIC_CLS_ID
CASE l_partkey % 4 WHEN 0 THEN 'DRIVER LICENSE' WHEN 1 THEN 'COMMERCIAL DRIVER LIC.' WHEN 2 THEN 'NA' ELSE NULL END AS DRVR_LIC_TYPE_ID
CASE c_nationkey WHEN 0 THEN 'NA' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'Other' WHEN 3 THEN NULL ELSE concat('ST', CAST(c_nationkey AS VARCHAR(20))) END AS DRVR_LIC_STATE_ID
CASE l_partkey % 7 WHEN 0 THEN 'NA' WHEN 1 THEN 'OTHER' WHEN 2 THEN NULL ELSE concat('ETH', CAST(l_partkey % 7 AS VARCHAR(20))) END AS PRSN_ETHNICITY_ID
CASE WHEN l_suppkey % 10 = 0 THEN NULL WHEN l_suppkey % 10 = 1 THEN 'UNKNOWN' ELSE concat('0', CAST(7000 + l_suppkey % 40 AS VARCHAR(20))) END AS DRVR_ZIP
""".strip().splitlines()

CHARGES = """
l_orderkey AS CRASH_ID
l_linenumber % 3 + 1 AS UNIT_NBR
l_linenumber AS PRSN_NBR
CASE l_partkey % 6 WHEN 0 THEN 'SPEEDING OVER LIMIT' WHEN 1 THEN 'DRIVING TOO FAST' WHEN 2 THEN 'speeding' WHEN 3 THEN NULL ELSE 'RAN RED LIGHT' END AS CHARGE
""".strip().splitlines()

DAMAGES = """
o_orderkey AS CRASH_ID
CASE o_custkey % 6 WHEN 0 THEN 'NONE' WHEN 1 THEN 'none1' WHEN 2 THEN NULL WHEN 3 THEN 'FENCE' WHEN 4 THEN 'None' ELSE 'NONE OBSERVED' END AS DAMAGED_PROPERTY
""".strip().splitlines()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    # Every twentieth part's rows appear twice.
    copies = F.expr("explode(CASE WHEN l_partkey % 20 = 0 THEN array(0, 1) ELSE array(0) END)")
    joined = line.join(part, line.l_partkey == part.p_partkey)
    return joined.select("*", copies.alias("copy")).selectExpr(*UNITS)


def primary_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    customer = load(spark, sf_dir, "customer")
    # The smaller pair first: orders get their customer before they meet the lines.
    placed = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return line.join(placed, line.l_orderkey == orders.o_orderkey).selectExpr(*PRIMARY_PERSON)


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").selectExpr(*CHARGES)


def damages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").selectExpr(*DAMAGES)


BUILDERS = {"units": units, "primary_person": primary_person, "charges": charges, "damages": damages}


def crash_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named crash tables, or all four."""
    return {name: BUILDERS[name](spark, sf_dir) for name in names or BUILDERS}


#: Keys that are missing for some rows. Applied to the tables above, which have none.
MISSING = {
    "CRASH_ID": "CASE WHEN CRASH_ID % 7 = 3 THEN NULL ELSE CRASH_ID END",
    "UNIT_NBR": "CASE WHEN (CRASH_ID + UNIT_NBR) % 5 = 2 THEN NULL ELSE UNIT_NBR END",
}


def with_missing_keys(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with a crash id missing in every seventh crash, and a unit number in some units."""
    return {
        name: df.select(*(F.expr(MISSING[c]).alias(c) if c in MISSING else F.col(c) for c in df.columns))
        for name, df in tables.items()
    }


def _select(columns: list[str], source: str) -> str:
    return "SELECT " + ",\n ".join(columns) + f"\nFROM {source}"


# The same tables as SQL, for checks in another engine.
SQL = {
    "units": _select(
        UNITS,
        "lineitem JOIN part ON l_partkey = p_partkey\n"
        "JOIN (SELECT 0 AS d UNION ALL SELECT 1 AS d) dup ON d = 0 OR l_partkey % 20 = 0",
    ),
    "primary_person": _select(
        PRIMARY_PERSON, "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
    ),
    "charges": _select(CHARGES, "lineitem"),
    "damages": _select(DAMAGES, "orders WHERE o_orderkey % 3 <> 0"),
}


def missing_keys_sql(sql: str) -> str:
    """A text made by ``with_tables``, with the tables of ``with_missing_keys`` in place of the others."""
    columns = {name: [c for c in MISSING if f"AS {c}" in own] for name, own in SQL.items()}
    for name, own in SQL.items():
        changed = ", ".join(f"{MISSING[c]} AS {c}" for c in columns[name])
        sql = sql.replace(f"{name} AS (\n{own})", f"{name} AS (\nSELECT * REPLACE ({changed}) FROM (\n{own}) whole)")
    return sql


def with_tables(select: str, *names: str) -> str:
    """A SELECT preceded by the named crash tables as common table expressions."""
    return "WITH " + ",\n".join(f"{name} AS (\n{SQL[name]})" for name in names) + "\n" + select
