"""The ten analyses and their variants over the derived crash tables, with their meaning in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.operators.aggregates import count_rows
from crashlens.plans import analyses
from crashlens.plans import values as v
from crashlens.plans.catalog import ORACLES, query
from crashlens.plans.fixtures import crash_tables, missing_keys_sql, with_missing_keys, with_tables

# 1

_MEN_KILLED = """SELECT CRASH_ID, COUNT(CRASH_ID) AS MALE_DEATH_COUNT FROM primary_person
WHERE PRSN_INJRY_SEV_ID = 'KILLED' AND PRSN_GNDR_ID = 'MALE' GROUP BY CRASH_ID"""


@query(with_tables(_MEN_KILLED + " HAVING COUNT(CRASH_ID) > 2", "primary_person"))
def analysis1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.crashes_with_many_men(crash_tables(spark, sf_dir, "primary_person"))


@query(with_tables(_MEN_KILLED, "primary_person"))
def analysis1_all_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.men_per_crash(crash_tables(spark, sf_dir, "primary_person"))


@query(with_tables(f"SELECT COUNT(*) AS crashes FROM ({_MEN_KILLED} HAVING COUNT(CRASH_ID) > 2) c", "primary_person"))
def analysis1_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows(analysis1(spark, sf_dir), count="crashes")


@query(
    with_tables(
        """SELECT CRASH_ID, COUNT(CRASH_ID) AS MALE_COUNT FROM primary_person
WHERE PRSN_GNDR_ID = 'MALE' GROUP BY CRASH_ID HAVING COUNT(CRASH_ID) > 2""",
        "primary_person",
    )
)
def analysis1_any_injury(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.crashes_with_many_men(crash_tables(spark, sf_dir, "primary_person"), any_injury=True)


# 2

_TWO_WHEELERS = """SELECT DISTINCT CRASH_ID, UNIT_NBR, VIN, VEH_BODY_STYL_ID FROM units
WHERE contains(VEH_BODY_STYL_ID, 'MOTORCYCLE')"""


@query(with_tables(_TWO_WHEELERS, "units"))
def analysis2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.two_wheelers(crash_tables(spark, sf_dir, "units"))


@query(with_tables(f"SELECT COUNT(*) AS vehicles FROM ({_TWO_WHEELERS}) t", "units"))
def analysis2_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows(analysis2(spark, sf_dir), count="vehicles")


# 3


def _driver_deaths_sql(death: str, counted: str = "*", only: str = "") -> str:
    return with_tables(
        f"""SELECT u.VEH_MAKE_ID, COUNT({counted}) AS COUNT_OF_DRIVER_DEATH_AND_AB_FAILURE
FROM (SELECT DISTINCT CRASH_ID, UNIT_NBR, VIN, VEH_MAKE_ID FROM units WHERE VEH_MAKE_ID <> 'NA'{only}) u
JOIN primary_person p ON u.CRASH_ID = p.CRASH_ID AND u.UNIT_NBR = p.UNIT_NBR
WHERE {death} AND p.PRSN_AIRBAG_ID = 'NOT DEPLOYED' AND contains(p.PRSN_TYPE_ID, 'DRIVER')
GROUP BY u.VEH_MAKE_ID ORDER BY 2 DESC, 1 LIMIT 5""",
        "units",
        "primary_person",
    )


@query(_driver_deaths_sql("p.PRSN_INJRY_SEV_ID = 'KILLED'"))
def analysis3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.makes_with_driver_deaths(crash_tables(spark, sf_dir, "units", "primary_person"))


@query(_driver_deaths_sql("p.PRSN_DEATH_TIME IS NOT NULL"))
def analysis3_by_death_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.makes_with_driver_deaths(crash_tables(spark, sf_dir, "units", "primary_person"), by_death_time=True)


_KILLED = "p.PRSN_INJRY_SEV_ID = 'KILLED'"


@query(_driver_deaths_sql(_KILLED, "DISTINCT u.CRASH_ID"))
def analysis3_by_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.makes_with_driver_deaths(crash_tables(spark, sf_dir, "units", "primary_person"), of="crashes")


@query(_driver_deaths_sql(_KILLED, "DISTINCT (u.CRASH_ID, u.UNIT_NBR, u.VIN)"))
def analysis3_by_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.makes_with_driver_deaths(crash_tables(spark, sf_dir, "units", "primary_person"), of="vehicles")


@query(_driver_deaths_sql(_KILLED, only=" AND NOT contains(VEH_BODY_STYL_ID, 'MOTORCYCLE')"))
def analysis3_no_motorcycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cars = ~F.col("VEH_BODY_STYL_ID").contains(v.MOTORCYCLE)
    return analyses.makes_with_driver_deaths(crash_tables(spark, sf_dir, "units", "primary_person"), only=cars)


# 4


def _licensed_sql(columns: str, extra: str = "") -> str:
    return with_tables(
        f"""SELECT {columns}
FROM (SELECT DISTINCT CRASH_ID, UNIT_NBR, VIN, VEH_HNR_FL FROM units WHERE VEH_HNR_FL = 'Y') u
JOIN primary_person p ON u.CRASH_ID = p.CRASH_ID AND u.UNIT_NBR = p.UNIT_NBR
WHERE p.DRVR_LIC_CLS_ID NOT IN ('UNKNOWN', 'NA', 'UNLICENSED')
 AND p.DRVR_LIC_TYPE_ID IN ('DRIVER LICENSE', 'COMMERCIAL DRIVER LIC.'){extra}""",
        "units",
        "primary_person",
    )


_LICENSED_COLUMNS = "u.CRASH_ID, u.UNIT_NBR, u.VIN, u.VEH_HNR_FL, p.DRVR_LIC_TYPE_ID, p.DRVR_LIC_CLS_ID"
_DRIVER = " AND contains(p.PRSN_TYPE_ID, 'DRIVER')"


@query(_licensed_sql(_LICENSED_COLUMNS, _DRIVER))
def analysis4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.licensed_hit_and_run(crash_tables(spark, sf_dir, "units", "primary_person"))


@query(_licensed_sql('COUNT(*) AS "count"', _DRIVER))
def analysis4_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.licensed_hit_and_run_count(crash_tables(spark, sf_dir, "units", "primary_person"))


@query(_licensed_sql(_LICENSED_COLUMNS))
def analysis4_any_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.licensed_hit_and_run(crash_tables(spark, sf_dir, "units", "primary_person"), any_person=True)


@query(_licensed_sql('COUNT(*) AS "count"'))
def analysis4_any_person_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.licensed_hit_and_run_count(crash_tables(spark, sf_dir, "units", "primary_person"), any_person=True)


@query(
    _licensed_sql(
        _LICENSED_COLUMNS + ", COUNT(*) AS pairs",
        _DRIVER + f" GROUP BY {_LICENSED_COLUMNS}",
    )
)
def analysis4_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.licensed_hit_and_run_folded(crash_tables(spark, sf_dir, "units", "primary_person"))


@query(_licensed_sql("DISTINCT u.*", _DRIVER))
def analysis4_by_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.hit_and_run_vehicles_with_licence(crash_tables(spark, sf_dir, "units", "primary_person"))


# 5

_STATES = """SELECT DRVR_LIC_STATE_ID, COUNT(*) AS NO_FEMALE_ACCIDENT_COUNT FROM (
 SELECT DISTINCT CRASH_ID, DRVR_LIC_STATE_ID FROM primary_person p
 WHERE lower(DRVR_LIC_STATE_ID) NOT IN ('na', 'unknown', 'other')
  AND NOT EXISTS (SELECT 1 FROM primary_person w WHERE w.CRASH_ID = p.CRASH_ID AND w.PRSN_GNDR_ID = 'FEMALE')) c
GROUP BY DRVR_LIC_STATE_ID"""


@query(with_tables(_STATES, "primary_person"))
def analysis5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.states_without_women(crash_tables(spark, sf_dir, "primary_person"))


@query(
    with_tables(
        f"SELECT DRVR_LIC_STATE_ID FROM ({_STATES}) s ORDER BY NO_FEMALE_ACCIDENT_COUNT DESC, 1 LIMIT 1",
        "primary_person",
    )
)
def analysis5_top_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.top_state_without_women(crash_tables(spark, sf_dir, "primary_person"))


# 6


def _casualties_sql(kind: str) -> str:
    return with_tables(
        f"""SELECT VEH_MAKE_ID, CAST(SUM(TOT_INJRY_CNT) AS {kind}) AS AGG_INJURIES,
 CAST(SUM(DEATH_CNT) AS {kind}) AS AGG_DEATHS, CAST(SUM(TOT_INJRY_CNT) + SUM(DEATH_CNT) AS {kind}) AS AGG_COUNT
FROM (SELECT DISTINCT CRASH_ID, UNIT_NBR, VIN, VEH_MAKE_ID, TOT_INJRY_CNT, DEATH_CNT FROM units
 WHERE VEH_MAKE_ID <> 'NA') u
GROUP BY VEH_MAKE_ID ORDER BY AGG_COUNT DESC NULLS LAST, VEH_MAKE_ID LIMIT 3 OFFSET 2""",
        "units",
    )


@query(_casualties_sql("BIGINT"))
def analysis6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.makes_by_casualties(crash_tables(spark, sf_dir, "units"))


@query(_casualties_sql("DOUBLE"))
def analysis6_string_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = crash_tables(spark, sf_dir, "units")
    text = {name: F.col(name).cast("string") for name in ("TOT_INJRY_CNT", "DEATH_CNT")}
    return analyses.makes_by_casualties({"units": tables["units"].withColumns(text)}, text_counts=True)


# 7


def _ethnicity_sql(flag: str = "") -> str:
    return with_tables(
        f"""SELECT VEH_BODY_STYL_ID, PRSN_ETHNICITY_ID FROM (
 SELECT VEH_BODY_STYL_ID, PRSN_ETHNICITY_ID,
  ROW_NUMBER() OVER (PARTITION BY VEH_BODY_STYL_ID ORDER BY COUNT(*) DESC, PRSN_ETHNICITY_ID) AS rn
 FROM (SELECT DISTINCT CRASH_ID, UNIT_NBR, VIN, VEH_BODY_STYL_ID{flag} FROM units
  WHERE VEH_BODY_STYL_ID NOT IN ('NOT REPORTED', 'OTHER  (EXPLAIN IN NARRATIVE)', 'UNKNOWN', 'NA')) u
 JOIN primary_person p ON u.CRASH_ID = p.CRASH_ID AND u.UNIT_NBR = p.UNIT_NBR
 WHERE PRSN_ETHNICITY_ID NOT IN ('NA', 'UNKNOWN', 'OTHER')
 GROUP BY VEH_BODY_STYL_ID, PRSN_ETHNICITY_ID) r
WHERE rn = 1""",
        "units",
        "primary_person",
    )


@query(_ethnicity_sql())
def analysis7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.top_ethnicity_per_body_style(crash_tables(spark, sf_dir, "units", "primary_person"))


@query(_ethnicity_sql(", VEH_HNR_FL"))
def analysis7_with_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = crash_tables(spark, sf_dir, "units", "primary_person")
    return analyses.top_ethnicity_per_body_style(tables, with_hit_and_run=True)


# 8


def _alcohol_sql(counted: str = "*") -> str:
    return with_tables(
        f"""SELECT p.DRVR_ZIP, COUNT({counted}) AS ALCOHOL_CRASH_COUNT
FROM (SELECT DISTINCT CRASH_ID, UNIT_NBR, VIN, VEH_HNR_FL, VEH_BODY_STYL_ID FROM units
 WHERE contains(lower(CONTRIB_FACTR_1_ID), 'alcohol') OR contains(lower(CONTRIB_FACTR_2_ID), 'alcohol')
  OR contains(lower(CONTRIB_FACTR_P1_ID), 'alcohol')) u
JOIN primary_person p ON u.CRASH_ID = p.CRASH_ID AND u.UNIT_NBR = p.UNIT_NBR
WHERE p.DRVR_ZIP IS NOT NULL GROUP BY p.DRVR_ZIP ORDER BY 2 DESC, 1 LIMIT 5""",
        "units",
        "primary_person",
    )


@query(_alcohol_sql("DISTINCT u.CRASH_ID"))
def analysis8_by_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.zips_with_alcohol(crash_tables(spark, sf_dir, "units", "primary_person"), of="crashes")


@query(_alcohol_sql())
def analysis8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.zips_with_alcohol(crash_tables(spark, sf_dir, "units", "primary_person"))


# 9

_HEAVY_INSURED = """SELECT DISTINCT CRASH_ID, UNIT_NBR, VIN, VEH_DMAG_SCL_1_ID, VEH_DMAG_SCL_2_ID, FIN_RESP_TYPE_ID
FROM units
WHERE ((VEH_DMAG_SCL_1_ID NOT IN ('NA', 'NO DAMAGE', 'INVALID VALUE') AND VEH_DMAG_SCL_1_ID >= 'DAMAGED 5')
  OR (VEH_DMAG_SCL_2_ID NOT IN ('NA', 'NO DAMAGE', 'INVALID VALUE') AND VEH_DMAG_SCL_2_ID >= 'DAMAGED 5'))
 AND FIN_RESP_TYPE_ID IN ('INSURANCE BINDER', 'LIABILITY INSURANCE POLICY', 'PROOF OF LIABILITY INSURANCE')"""


def _insured_sql(columns: str, damage_columns: str) -> str:
    return with_tables(
        f"""SELECT {columns} FROM ({_HEAVY_INSURED}) u
JOIN (SELECT DISTINCT {damage_columns} FROM damages WHERE upper(DAMAGED_PROPERTY) IN ('NONE', 'NONE1')) d
ON u.CRASH_ID = d.CRASH_ID""",
        "units",
        "damages",
    )


@query(_insured_sql("DISTINCT u.CRASH_ID", "CRASH_ID"))
def analysis9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.insured_crashes_without_property_damage(crash_tables(spark, sf_dir, "units", "damages"))


@query(_insured_sql("u.*, d.DAMAGED_PROPERTY", "CRASH_ID, DAMAGED_PROPERTY"))
def analysis9_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.insured_without_property_damage(crash_tables(spark, sf_dir, "units", "damages"))


@query(_insured_sql("u.*", "CRASH_ID"))
def analysis9_by_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.insured_without_property_damage(crash_tables(spark, sf_dir, "units", "damages"), by_crash=True)


# 10


def _speed_sql(counted: str = "*") -> str:
    return with_tables(
        f""", vehicles AS (
 SELECT DISTINCT CRASH_ID, UNIT_NBR, VIN, VEH_LIC_STATE_ID, VEH_COLOR_ID, VEH_MAKE_ID FROM units),
states AS (
 SELECT VEH_LIC_STATE_ID FROM vehicles WHERE TRY_CAST(VEH_LIC_STATE_ID AS FLOAT) IS NULL
 GROUP BY VEH_LIC_STATE_ID ORDER BY COUNT(*) DESC, VEH_LIC_STATE_ID NULLS LAST LIMIT 25),
colours AS (
 SELECT VEH_COLOR_ID FROM vehicles WHERE VEH_COLOR_ID <> 'NA' AND TRY_CAST(VEH_COLOR_ID AS FLOAT) IS NULL
 GROUP BY VEH_COLOR_ID ORDER BY COUNT(*) DESC, VEH_COLOR_ID LIMIT 10)
SELECT v.VEH_MAKE_ID, COUNT({counted}) AS "count"
FROM vehicles v
JOIN (SELECT DISTINCT CRASH_ID, UNIT_NBR FROM charges WHERE contains(CHARGE, 'SPEED') OR contains(CHARGE, 'FAST')) c
 ON v.CRASH_ID = c.CRASH_ID AND v.UNIT_NBR = c.UNIT_NBR
JOIN primary_person p ON v.CRASH_ID = p.CRASH_ID AND v.UNIT_NBR = p.UNIT_NBR
JOIN colours ON v.VEH_COLOR_ID = colours.VEH_COLOR_ID
JOIN states ON v.VEH_LIC_STATE_ID = states.VEH_LIC_STATE_ID
WHERE p.DRVR_LIC_TYPE_ID IN ('DRIVER LICENSE', 'COMMERCIAL DRIVER LIC.')
GROUP BY v.VEH_MAKE_ID ORDER BY 2 DESC, 1 NULLS LAST LIMIT 5""",
        "units",
        "primary_person",
        "charges",
    )


@query(_speed_sql("DISTINCT v.CRASH_ID"))
def analysis10_by_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.makes_with_speed_charges(crash_tables(spark, sf_dir, "units", "primary_person", "charges"), of="crashes")


@query(_speed_sql())
def analysis10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.makes_with_speed_charges(crash_tables(spark, sf_dir, "units", "primary_person", "charges"))


# The same over tables in which crash ids and unit numbers are missing

_MISSING_KEYS = {
    "analysis1": analyses.crashes_with_many_men,
    "analysis1_all_counts": analyses.men_per_crash,
    "analysis1_any_injury": lambda t: analyses.crashes_with_many_men(t, any_injury=True),
    "analysis2": analyses.two_wheelers,
    "analysis3": analyses.makes_with_driver_deaths,
    "analysis3_by_crash": lambda t: analyses.makes_with_driver_deaths(t, of="crashes"),
    "analysis3_by_vehicle": lambda t: analyses.makes_with_driver_deaths(t, of="vehicles"),
    "analysis4": analyses.licensed_hit_and_run,
    "analysis4_folded": analyses.licensed_hit_and_run_folded,
    "analysis4_count": analyses.licensed_hit_and_run_count,
    "analysis4_by_vehicle": analyses.hit_and_run_vehicles_with_licence,
    "analysis5": analyses.states_without_women,
    "analysis6": analyses.makes_by_casualties,
    "analysis7": analyses.top_ethnicity_per_body_style,
    "analysis8": analyses.zips_with_alcohol,
    "analysis8_by_crash": lambda t: analyses.zips_with_alcohol(t, of="crashes"),
    "analysis9": analyses.insured_crashes_without_property_damage,
    "analysis9_rows": analyses.insured_without_property_damage,
    "analysis10": analyses.makes_with_speed_charges,
    "analysis10_by_crash": lambda t: analyses.makes_with_speed_charges(t, of="crashes"),
}


def _with_missing_keys(name: str, analysis) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return analysis(with_missing_keys(crash_tables(spark, sf_dir)))

    run.__name__ = f"{name}_missing_keys"
    query(missing_keys_sql(ORACLES[name]))(run)


for _name, _analysis in _MISSING_KEYS.items():
    _with_missing_keys(_name, _analysis)
