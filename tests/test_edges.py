"""Analyses on hand-made rows: missing values, ties, duplicates, many-to-many, empty input."""

import crash_rows as r
import pytest
from conftest import rows
from pyspark.sql import functions as F

from crashlens.plans import analyses
from crashlens.plans.job import STORED
from crashlens.sources import SCHEMAS

DEAD_DRIVER = {"PRSN_INJRY_SEV_ID": "KILLED", "PRSN_AIRBAG_ID": "NOT DEPLOYED", "PRSN_TYPE_ID": "DRIVER"}
LICENSED = {"DRVR_LIC_TYPE_ID": "DRIVER LICENSE", "DRVR_LIC_CLS_ID": "CLASS C", "PRSN_TYPE_ID": "DRIVER"}


def make_counts(spark, makes, k=5):
    tables = {
        "units": r.units(spark, *[{"CRASH_ID": i, "VEH_MAKE_ID": make} for i, make in enumerate(makes)]),
        "primary_person": r.persons(spark, *[{"CRASH_ID": i} for i in range(len(makes))], **DEAD_DRIVER),
    }
    return [tuple(row) for row in analyses.makes_with_driver_deaths(tables, k=k).collect()]


def test_missing_and_na_makes_are_dropped(spark):
    assert make_counts(spark, [None, "NA", "X"]) == [("X", 1)]


def test_ties_go_to_the_smaller_make(spark):
    assert make_counts(spark, ["B", "A", "C", "C"], k=2) == [("C", 2), ("A", 1)]


def test_two_vehicles_and_two_persons_of_a_unit_give_four_pairs(spark):
    tables = {
        "units": r.units(
            spark,
            {"VIN": "V1"},
            {"VIN": "V2"},
            VEH_MAKE_ID="M",
            VEH_HNR_FL="Y",
            VEH_BODY_STYL_ID="CAR",
            CONTRIB_FACTR_1_ID="Alcohol",
            VEH_COLOR_ID="RED",
            VEH_LIC_STATE_ID="TX",
        ),
        "primary_person": r.persons(
            spark, {"PRSN_NBR": 1}, {"PRSN_NBR": 2}, **DEAD_DRIVER | LICENSED, DRVR_ZIP="07001", PRSN_ETHNICITY_ID="E"
        ),
        "charges": r.charges(spark, {"CHARGE": "SPEEDING"}, {"CHARGE": "TOO FAST"}),
    }
    assert rows(analyses.makes_with_driver_deaths(tables)) == [("M", 4)]
    assert analyses.licensed_hit_and_run(tables).count() == 4
    assert rows(analyses.licensed_hit_and_run_count(tables)) == [(4,)]
    assert rows(analyses.body_style_ethnicity_counts(tables)) == [("CAR", "E", 4)]
    assert rows(analyses.zips_with_alcohol(tables)) == [("07001", 4)]
    assert rows(analyses.makes_with_speed_charges(tables)) == [("M", 4)]


def test_repeated_vehicle_rows_change_nothing(spark, tables):
    doubled = {**tables, "units": tables["units"].unionAll(tables["units"])}
    for name, analysis in STORED.items():
        assert rows(analysis(doubled)) == rows(analysis(tables)), name


@pytest.mark.parametrize("licence_class", [None, "NA", "UNKNOWN", "UNLICENSED"])
def test_missing_or_invalid_licence_class_is_dropped(spark, licence_class):
    tables = {
        "units": r.units(spark, {}, VEH_HNR_FL="Y"),
        "primary_person": r.persons(spark, {**LICENSED, "DRVR_LIC_CLS_ID": licence_class}),
    }
    assert analyses.licensed_hit_and_run(tables).count() == 0
    assert rows(analyses.licensed_hit_and_run_count(tables)) == [(0,)]


def test_only_more_than_two_men_killed_count(spark):
    killed = {"PRSN_INJRY_SEV_ID": "KILLED", "PRSN_GNDR_ID": "MALE"}
    given = [{**killed, "CRASH_ID": crash} for crash in (1, 1, 2, 2, 2)]
    given += [{**killed, "CRASH_ID": 1, "PRSN_GNDR_ID": gender} for gender in ("FEMALE", None)]
    tables = {"primary_person": r.persons(spark, *given)}
    assert rows(analyses.crashes_with_many_men(tables)) == [(2, 3)]
    assert rows(analyses.men_per_crash(tables)) == [(1, 2), (2, 3)]


def test_one_woman_removes_the_whole_crash(spark):
    given = [
        {"CRASH_ID": 1, "PRSN_GNDR_ID": "MALE", "DRVR_LIC_STATE_ID": "TX"},
        {"CRASH_ID": 1, "PRSN_GNDR_ID": "FEMALE", "DRVR_LIC_STATE_ID": "Unknown"},
        {"CRASH_ID": 2, "PRSN_GNDR_ID": "MALE", "DRVR_LIC_STATE_ID": "TX"},
        {"CRASH_ID": 2, "PRSN_GNDR_ID": None, "DRVR_LIC_STATE_ID": "LA"},
        {"CRASH_ID": 3, "PRSN_GNDR_ID": None, "DRVR_LIC_STATE_ID": "NA"},
        {"CRASH_ID": 4, "PRSN_GNDR_ID": "MALE", "DRVR_LIC_STATE_ID": None},
        {"CRASH_ID": 5, "PRSN_GNDR_ID": "MALE", "DRVR_LIC_STATE_ID": "LA"},
        {"CRASH_ID": 5, "PRSN_GNDR_ID": "MALE", "DRVR_LIC_STATE_ID": "LA"},
    ]
    result = analyses.states_without_women({"primary_person": r.persons(spark, *given)})
    assert [tuple(row) for row in result.collect()] == [("LA", 2), ("TX", 1)]


def test_women_without_crash_id_rule_nothing_out(spark):
    given = [
        {"CRASH_ID": None, "PRSN_GNDR_ID": "FEMALE", "DRVR_LIC_STATE_ID": "TX"},
        {"CRASH_ID": None, "PRSN_GNDR_ID": "MALE", "DRVR_LIC_STATE_ID": "LA"},
    ]
    result = analyses.states_without_women({"primary_person": r.persons(spark, *given)})
    assert rows(result) == [("LA", 1), ("TX", 1)]


def casualties(spark, *given):
    return [tuple(row) for row in analyses.makes_by_casualties({"units": r.units(spark, *given)}).collect()]


def test_fewer_than_three_makes_leave_no_rank_three(spark):
    assert casualties(spark, {"VEH_MAKE_ID": "A", "DEATH_CNT": 1}, {"VEH_MAKE_ID": "B", "DEATH_CNT": 1}) == []


def test_missing_counts_give_a_missing_total_ranked_last(spark):
    given = [{"VEH_MAKE_ID": m, "TOT_INJRY_CNT": n, "DEATH_CNT": 0} for m, n in (("A", 3), ("B", 2), ("D", 1))]
    given.append({"VEH_MAKE_ID": "C", "DEATH_CNT": 9})
    assert casualties(spark, *given) == [("D", 1, 0, 1), ("C", None, 9, None)]


def test_text_counts_skip_text_that_is_no_number(spark):
    given = [{"VIN": str(i), "VEH_MAKE_ID": m} for i, m in enumerate("ABCC")]
    count = F.when(F.col("VIN") == "3", "NA").otherwise(F.col("VIN"))
    counts = {"TOT_INJRY_CNT": count, "DEATH_CNT": count}
    tables = {"units": r.units(spark, *given).withColumns(counts)}
    result = analyses.makes_by_casualties(tables, first=1, text_counts=True)
    expected = [("C", 2.0, 2.0, 4.0), ("B", 1.0, 1.0, 2.0), ("A", 0.0, 0.0, 0.0)]
    assert [tuple(row) for row in result.collect()] == expected


def test_ethnicity_ties_go_to_the_smaller_name(spark):
    tables = {
        "units": r.units(spark, {}, VEH_BODY_STYL_ID="CAR"),
        "primary_person": r.persons(spark, *[{"PRSN_ETHNICITY_ID": e} for e in ("W", "B", "NA", None, "OTHER")]),
    }
    assert rows(analyses.top_ethnicity_per_body_style(tables)) == [("CAR", "B")]


@pytest.mark.parametrize("style", ["NOT REPORTED", "OTHER  (EXPLAIN IN NARRATIVE)", "UNKNOWN", "NA", None])
def test_undefined_body_styles_are_dropped(spark, style):
    tables = {
        "units": r.units(spark, {"VEH_BODY_STYL_ID": style}),
        "primary_person": r.persons(spark, {"PRSN_ETHNICITY_ID": "W"}),
    }
    assert rows(analyses.top_ethnicity_per_body_style(tables)) == []


def test_flag_variant_counts_vehicles_that_differ_in_it(spark):
    tables = {
        "units": r.units(spark, {"VEH_HNR_FL": "Y"}, {"VEH_HNR_FL": "N"}, VEH_BODY_STYL_ID="CAR"),
        "primary_person": r.persons(spark, {"PRSN_ETHNICITY_ID": "W"}),
    }
    assert rows(analyses.body_style_ethnicity_counts(tables)) == [("CAR", "W", 1)]
    assert rows(analyses.body_style_ethnicity_counts(tables, with_hit_and_run=True)) == [("CAR", "W", 2)]


def test_zip_keeps_zeros_counts_unknown_drops_missing(spark):
    tables = {
        "units": r.units(spark, {"CONTRIB_FACTR_P1_ID": "Under Influence - ALCOHOL"}),
        "primary_person": r.persons(spark, *[{"DRVR_ZIP": z} for z in ("07001", "UNKNOWN", None, "UNKNOWN")]),
    }
    assert [tuple(row) for row in analyses.zips_with_alcohol(tables).collect()] == [("UNKNOWN", 2), ("07001", 1)]


@pytest.mark.parametrize(
    ("first", "second", "passes"),
    [
        ("DAMAGED 4", None, False),
        ("DAMAGED 5", None, True),
        ("DAMAGED 7 HIGHEST", "NA", True),
        ("NO DAMAGE", "INVALID VALUE", False),
        (None, "DAMAGED 5", True),
        ("DAMAGED 10", None, False),
        (None, None, False),
    ],
)
def test_damage_levels_compare_as_text(spark, first, second, passes):
    tables = {
        "units": r.units(
            spark, {"VEH_DMAG_SCL_1_ID": first, "VEH_DMAG_SCL_2_ID": second, "FIN_RESP_TYPE_ID": "INSURANCE BINDER"}
        ),
        "damages": r.damages(spark, {"DAMAGED_PROPERTY": "NONE"}),
    }
    assert analyses.insured_crashes_without_property_damage(tables).count() == passes


def test_property_spellings_repeat_vehicle_rows_not_crashes(spark):
    tables = {
        "units": r.units(spark, {"VEH_DMAG_SCL_1_ID": "DAMAGED 6", "FIN_RESP_TYPE_ID": "INSURANCE BINDER"}),
        "damages": r.damages(spark, *[{"DAMAGED_PROPERTY": p} for p in ("None", "NONE", "NONE", "FENCE", None)]),
    }
    assert analyses.insured_without_property_damage(tables).count() == 2
    assert analyses.insured_without_property_damage(tables, by_crash=True).count() == 1
    assert rows(analyses.insured_crashes_without_property_damage(tables)) == [(1,)]


def speeding(spark, vehicles, **options):
    """One charged and licensed person per vehicle."""
    keys = [{"CRASH_ID": i} for i in range(len(vehicles))]
    tables = {
        "units": r.units(spark, *[{**key, **vehicle} for key, vehicle in zip(keys, vehicles)]),
        "primary_person": r.persons(spark, *keys, **LICENSED),
        "charges": r.charges(spark, *keys, CHARGE="SPEEDING"),
    }
    return [tuple(row) for row in analyses.makes_with_speed_charges(tables, **options).collect()]


def test_speed_makes_keep_na_and_missing(spark):
    vehicles = [{"VEH_MAKE_ID": m, "VEH_COLOR_ID": "RED", "VEH_LIC_STATE_ID": "TX"} for m in (None, "NA", "X")]
    assert speeding(spark, vehicles) == [("NA", 1), ("X", 1), (None, 1)]


def test_missing_state_takes_a_place_and_joins_nothing(spark):
    states = [None, None, None, "TX", "TX", "LA"]
    vehicles = [{"VEH_MAKE_ID": f"M{s}", "VEH_COLOR_ID": "RED", "VEH_LIC_STATE_ID": s} for s in states]
    assert speeding(spark, vehicles, states=2) == [("MTX", 2)]
    assert speeding(spark, vehicles, states=3) == [("MTX", 2), ("MLA", 1)]


def test_vehicles_without_a_crash_count_for_the_lists_only(spark):
    known = {"VEH_MAKE_ID": "M", "VEH_COLOR_ID": "RED", "VEH_LIC_STATE_ID": "TX"}
    stray = {"VEH_MAKE_ID": "S", "VEH_COLOR_ID": "BLU", "VEH_LIC_STATE_ID": "LA"}
    vehicles = [known, {**stray, "CRASH_ID": None, "VIN": "a"}, {**stray, "UNIT_NBR": None, "VIN": "b"}]
    assert speeding(spark, vehicles) == [("M", 1)]
    assert speeding(spark, vehicles, colours=1) == []
    assert speeding(spark, vehicles, states=1) == []


@pytest.mark.parametrize(("state", "found"), [("98", 0), ("NaN", 0), ("1D", 0), ("TX", 1)])
def test_numeric_states_are_no_states(spark, state, found):
    vehicles = [{"VEH_MAKE_ID": "M", "VEH_COLOR_ID": "RED", "VEH_LIC_STATE_ID": state}]
    assert len(speeding(spark, vehicles)) == found


@pytest.mark.parametrize(("colour", "found"), [("NA", 0), ("99", 0), (None, 0), ("RED", 1)])
def test_missing_and_numeric_colours_are_no_colours(spark, colour, found):
    vehicles = [{"VEH_MAKE_ID": "M", "VEH_COLOR_ID": colour, "VEH_LIC_STATE_ID": "TX"}]
    assert len(speeding(spark, vehicles)) == found


def test_ineligible_values_take_no_place_in_the_top_lists(spark):
    vehicles = [{"VEH_MAKE_ID": "M", "VEH_COLOR_ID": c, "VEH_LIC_STATE_ID": "TX"} for c in ("NA", "NA", "99", "RED")]
    assert speeding(spark, vehicles, colours=1) == [("M", 1)]


def test_empty_tables_give_empty_results(spark):
    empty = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
    for name, analysis in STORED.items():
        assert analysis(empty).count() == 0, name
    assert analyses.top_state_without_women(empty).count() == 0
    assert rows(analyses.licensed_hit_and_run_count(empty)) == [(0,)]


def test_men_without_a_crash_id_are_no_crash(spark):
    men = {"PRSN_INJRY_SEV_ID": "KILLED", "PRSN_GNDR_ID": "MALE"}
    given = [{"CRASH_ID": None}] * 4 + [{"CRASH_ID": 1}] * 3 + [{"CRASH_ID": 2}] * 2
    tables = {"primary_person": r.persons(spark, *given, **men)}
    assert rows(analyses.men_per_crash(tables)) == [(1, 3), (2, 2), (None, 0)]
    assert rows(analyses.crashes_with_many_men(tables)) == [(1, 3)]
    assert rows(analyses.crashes_with_many_men(tables, any_injury=True)) == [(1, 3)]


def test_pairs_crashes_and_vehicles_are_counted_apart(spark):
    tables = {
        "units": r.units(
            spark,
            {"VIN": "V1"},
            {"VIN": "V2"},
            {"CRASH_ID": 2},
            {"CRASH_ID": 3, "VEH_BODY_STYL_ID": "MOTORCYCLE"},
            VEH_MAKE_ID="M",
            VEH_HNR_FL="Y",
            CONTRIB_FACTR_1_ID="Alcohol",
            VEH_COLOR_ID="RED",
            VEH_LIC_STATE_ID="TX",
        ),
        "primary_person": r.persons(
            spark,
            {"PRSN_NBR": 1},
            {"PRSN_NBR": 2},
            {"PRSN_NBR": 3, "DRVR_LIC_CLS_ID": "CLASS A"},
            {"CRASH_ID": 3},
            **LICENSED | DEAD_DRIVER,
            DRVR_ZIP="07001",
        ),
        "charges": r.charges(spark, {"CHARGE": "SPEEDING"}, {"CRASH_ID": 3, "CHARGE": "TOO FAST"}),
    }
    made = lambda of, **more: rows(analyses.makes_with_driver_deaths(tables, of=of, **more))
    assert (made("pairs"), made("crashes"), made("vehicles")) == ([("M", 7)], [("M", 2)], [("M", 3)])
    no_bikes = F.col("VEH_BODY_STYL_ID").isNull()
    assert made("pairs", only=no_bikes) == [("M", 6)] and made("crashes", only=no_bikes) == [("M", 1)]
    zips = lambda **more: rows(analyses.zips_with_alcohol(tables, **more))
    assert (zips(), zips(of="crashes"), zips(of="crashes", only=no_bikes)) == ([("07001", 7)], [("07001", 2)], [("07001", 1)])
    with pytest.raises(ValueError, match="vehicles"):
        zips(of="vehicles")
    speed = lambda of: rows(analyses.makes_with_speed_charges(tables, of=of))
    assert (speed("pairs"), speed("crashes"), speed("vehicles")) == ([("M", 7)], [("M", 2)], [("M", 3)])
    assert analyses.hit_and_run_vehicles_with_licence(tables).count() == 3
    folded = analyses.licensed_hit_and_run_folded(tables)
    assert sorted(row["pairs"] for row in folded.collect()) == [1, 1, 1, 2, 2]


def test_folded_pairs_expand_to_all_pairs(tables):
    folded = analyses.licensed_hit_and_run_folded(tables)
    again = folded.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), "pairs"))).drop("i", "pairs")
    assert rows(again) == rows(analyses.licensed_hit_and_run(tables))
