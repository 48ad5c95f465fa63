"""The ten analyses over the crash tables.

Each function takes the tables as a mapping of name to DataFrame and returns a lazy DataFrame. Vehicles repeat in
the units table, so every analysis of vehicles first makes them distinct over the columns it is about; those
columns decide what counts as one row. Counts over vehicles and persons count pairs of the two, which
``count_pairs`` gets from counts per crash and unit instead of joined rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
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
from crashlens.operators.aggregates import count_rows, count_values, sum_columns
from crashlens.operators.joins import common_keys, count_pairs, join_on, restrict_to_top, semi
from crashlens.operators.keys import distinct_on
from crashlens.operators.ranking import rank_slice, sort_by, top1_per_group, topk
from crashlens.plans import values as v

Tables = Mapping[str, DataFrame]

#: What the analyses ask for unless told otherwise: more men than this, so many of a top list, ranks from and to.
MANY_MEN, TOP, FIRST, LAST = 2, 5, 3, 5


def _matched(
    vehicles: DataFrame, persons: DataFrame, by: str, count: str, of: str, within: DataFrame | None = None
) -> DataFrame:
    """Per ``by``: pairs of vehicle and person, or different crashes or vehicles (rows of ``vehicles``) among the pairs.

    No way builds the pairs. Crashes and vehicles are rows of one side that have a partner on the other, by semi-joins, which
    fold a hot key of the partner and may split one of the rows.
    """
    if of == "pairs":
        return count_pairs(vehicles, persons, v.CRASH_UNIT, [by], count, within)
    by_vehicle = by in vehicles.columns
    rows, partner = (vehicles, persons) if by_vehicle else (persons, vehicles)
    if within is not None:
        rows = semi(rows, within, v.CRASH_UNIT)
    if of == "crashes":
        return count_rows(semi(rows, partner, v.CRASH_UNIT).select(by, *v.CRASH).distinct(), [by], count)
    if of == "vehicles" and by_vehicle:
        return count_rows(semi(rows, partner, v.CRASH_UNIT), [by], count)
    raise ValueError(f"cannot count {of} here")


def _only(tables: Tables, vehicles: Column | None) -> DataFrame:
    """The units, or those that meet a condition."""
    return tables["units"] if vehicles is None else tables["units"].filter(vehicles)


# 1. Crashes with more than two men killed


def men_per_crash(tables: Tables, any_injury: bool = False) -> DataFrame:
    """Men killed per crash; men of any injury state with ``any_injury``.

    The crash id is counted, so men without one are no crash: their group counts 0.
    """
    condition = F.col("PRSN_GNDR_ID") == v.MALE
    if not any_injury:
        condition &= F.col("PRSN_INJRY_SEV_ID") == v.KILLED
    name = "MALE_COUNT" if any_injury else v.MEN_KILLED
    return count_values(tables["primary_person"].filter(condition), v.CRASH, "CRASH_ID", name)


def crashes_with_many_men(tables: Tables, any_injury: bool = False, more_than: int = MANY_MEN) -> DataFrame:
    counts = men_per_crash(tables, any_injury)
    return counts.filter(F.col(counts.columns[-1]) > more_than)


# 2. Two-wheelers


def two_wheelers(tables: Tables) -> DataFrame:
    bikes = tables["units"].filter(F.col("VEH_BODY_STYL_ID").contains(v.MOTORCYCLE))
    return distinct_on(bikes, [*v.VEHICLE, "VEH_BODY_STYL_ID"])


# 3. Makes with driver deaths and no airbag


def makes_with_driver_deaths(
    tables: Tables, by_death_time: bool = False, k: int = TOP, of: str = "pairs", only: Column | None = None
) -> DataFrame:
    """Death is the injury state, or a recorded time of death with ``by_death_time``.

    ``of``: what is counted, pairs of vehicle and driver, crashes or vehicles. ``only``: a condition on the vehicles.
    """
    died = F.col("PRSN_DEATH_TIME").isNotNull() if by_death_time else F.col("PRSN_INJRY_SEV_ID") == v.KILLED
    drivers = tables["primary_person"].filter(
        died & (F.col("PRSN_AIRBAG_ID") == v.AIRBAG_NOT_DEPLOYED) & F.col("PRSN_TYPE_ID").contains(v.DRIVER)
    )
    vehicles = distinct_on(_known_make(_only(tables, only)), [*v.VEHICLE, "VEH_MAKE_ID"])
    name = v.DRIVER_DEATHS
    return topk(_matched(vehicles, drivers, "VEH_MAKE_ID", name, of), k, [name], ["VEH_MAKE_ID"])


def _known_make(units: DataFrame) -> DataFrame:
    return units.filter(F.col("VEH_MAKE_ID") != v.NOT_AVAILABLE)


# 4. Hit and run with a valid licence


def _hit_and_run_vehicles(tables: Tables) -> DataFrame:
    return distinct_on(tables["units"].filter(F.col("VEH_HNR_FL") == v.HIT_AND_RUN), [*v.VEHICLE, "VEH_HNR_FL"])


def _licensed_drivers(tables: Tables, any_person: bool) -> DataFrame:
    condition = not_in("DRVR_LIC_CLS_ID", v.INVALID_LICENCE_CLASSES) & F.col("DRVR_LIC_TYPE_ID").isin(v.LICENCE_TYPES)
    if not any_person:
        condition &= F.col("PRSN_TYPE_ID").contains(v.DRIVER)
    return tables["primary_person"].filter(condition).select(*v.CRASH_UNIT, "DRVR_LIC_TYPE_ID", "DRVR_LIC_CLS_ID")


def licensed_hit_and_run(tables: Tables, any_person: bool = False) -> DataFrame:
    """One row per pair of vehicle and licensed driver (any licensed person with ``any_person``)."""
    pairs = join_on(_licensed_drivers(tables, any_person), _hit_and_run_vehicles(tables), v.CRASH_UNIT)
    return pairs.select(*v.VEHICLE, "VEH_HNR_FL", "DRVR_LIC_TYPE_ID", "DRVR_LIC_CLS_ID")


def licensed_hit_and_run_folded(tables: Tables, any_person: bool = False) -> DataFrame:
    """``licensed_hit_and_run`` with equal rows folded: ``pairs`` says how many there are.

    A vehicle has as many rows as there are kinds of licence at its unit, however many persons hold them.
    """
    persons = _licensed_drivers(tables, any_person)
    kinds = count_rows(persons, persons.columns, "pairs")
    columns = [*v.VEHICLE, "VEH_HNR_FL", "DRVR_LIC_TYPE_ID", "DRVR_LIC_CLS_ID", "pairs"]
    return join_on(_hit_and_run_vehicles(tables), kinds, v.CRASH_UNIT).select(*columns)


def hit_and_run_vehicles_with_licence(tables: Tables, any_person: bool = False) -> DataFrame:
    """The hit-and-run vehicles that a licensed driver (or person) belongs to, each once."""
    return semi(_hit_and_run_vehicles(tables), _licensed_drivers(tables, any_person), v.CRASH_UNIT)


def licensed_hit_and_run_count(tables: Tables, any_person: bool = False) -> DataFrame:
    """Number of rows of ``licensed_hit_and_run``, without building them."""
    return count_pairs(_licensed_drivers(tables, any_person), _hit_and_run_vehicles(tables), v.CRASH_UNIT)


# 5. Crashes without women per licence state


def states_without_women(tables: Tables) -> DataFrame:
    """Crashes without women per state, most first.

    One scan: rows fold to one per crash and state on the map side, then a window over the few states of a
    crash tells whether any of its rows was a woman's. A NULL crash id matches nothing, so women recorded
    under it rule nothing out.
    """
    state = F.col("DRVR_LIC_STATE_ID")
    known_state = F.when(not_iin(state, v.NO_STATE), state)
    woman = F.coalesce(F.col("PRSN_GNDR_ID") == v.FEMALE, F.lit(False)) & F.col("CRASH_ID").isNotNull()
    crash_states = (
        tables["primary_person"]
        .select("CRASH_ID", known_state.alias("DRVR_LIC_STATE_ID"), woman.alias("_woman"))
        .filter(state.isNotNull() | F.col("_woman"))
        .groupBy("CRASH_ID", "DRVR_LIC_STATE_ID")
        .agg(F.max("_woman").alias("_woman"))
    )
    without_women = (
        crash_states.withColumn("_women", F.max("_woman").over(Window.partitionBy("CRASH_ID")))
        .filter(~F.col("_women") & state.isNotNull())
    )
    counts = count_rows(without_women, ["DRVR_LIC_STATE_ID"], v.WITHOUT_WOMEN)
    return sort_by(counts, [v.WITHOUT_WOMEN], ["DRVR_LIC_STATE_ID"])


def top_state_without_women(tables: Tables) -> DataFrame:
    return states_without_women(tables).limit(1).select("DRVR_LIC_STATE_ID")


# 6. Makes ranked third to fifth by injuries and deaths


def makes_by_casualties(tables: Tables, first: int = FIRST, last: int = LAST, text_counts: bool = False) -> DataFrame:
    """``text_counts``: the counts are text, so they are summed as double precision numbers."""
    units = _known_make(tables["units"])
    counts = ["TOT_INJRY_CNT", "DEATH_CNT"]
    vehicles = distinct_on(units, [*v.VEHICLE, "VEH_MAKE_ID", *counts])
    if text_counts:
        vehicles = vehicles.withColumns({name: parse_number(name) for name in counts})
    totals = sum_columns(vehicles, ["VEH_MAKE_ID"], {v.INJURIES: counts[0], v.DEATHS: counts[1]})
    totals = totals.withColumn(v.CASUALTIES, F.col(v.INJURIES) + F.col(v.DEATHS))
    return rank_slice(totals, first, last, [v.CASUALTIES], ["VEH_MAKE_ID"])


# 7. Most frequent ethnic group per body style


def body_style_ethnicity_counts(tables: Tables, with_hit_and_run: bool = False) -> DataFrame:
    """``with_hit_and_run``: vehicles that differ in that flag only count separately."""
    columns = [*v.VEHICLE, "VEH_BODY_STYL_ID"] + ["VEH_HNR_FL"] * with_hit_and_run
    vehicles = distinct_on(tables["units"].filter(not_in("VEH_BODY_STYL_ID", v.NO_BODY_STYLE)), columns)
    persons = tables["primary_person"].filter(not_in("PRSN_ETHNICITY_ID", v.NO_ETHNICITY))
    return count_pairs(vehicles, persons, v.CRASH_UNIT, ["VEH_BODY_STYL_ID", "PRSN_ETHNICITY_ID"])


def top_ethnicity_per_body_style(tables: Tables, with_hit_and_run: bool = False) -> DataFrame:
    counts = body_style_ethnicity_counts(tables, with_hit_and_run)
    return top1_per_group(counts, ["VEH_BODY_STYL_ID"], ["count"], ["PRSN_ETHNICITY_ID"]).drop("count")


# 8. Zip codes with most alcohol-related crashes


def zips_with_alcohol(tables: Tables, k: int = TOP, of: str = "pairs", only: Column | None = None) -> DataFrame:
    """``of``: what is counted, pairs of vehicle and person, or crashes. ``only``: a condition on the vehicles."""
    alcohol = any_column(lambda factor: icontains(factor, v.ALCOHOL), v.CONTRIBUTING_FACTORS)
    vehicles = distinct_on(_only(tables, only).filter(alcohol), [*v.VEHICLE, "VEH_HNR_FL", "VEH_BODY_STYL_ID"])
    persons = tables["primary_person"].na.drop(subset=["DRVR_ZIP"])
    name = v.ALCOHOL_CRASHES
    return topk(_matched(vehicles, persons, "DRVR_ZIP", name, of), k, [name], ["DRVR_ZIP"])


# 9. Insured vehicles with heavy damage and no damaged property


def _heavy_damage_insured(tables: Tables) -> DataFrame:
    heavy = any_column(lambda scale: at_least_text(scale, v.DAMAGE_FLOOR, v.NO_DAMAGE_LEVEL), v.DAMAGE_SCALES)
    return tables["units"].filter(heavy & F.col("FIN_RESP_TYPE_ID").isin(v.INSURED))


def _no_property_damage(tables: Tables) -> DataFrame:
    return tables["damages"].filter(iin("DAMAGED_PROPERTY", v.NO_PROPERTY_DAMAGE))


def insured_without_property_damage(tables: Tables, by_crash: bool = False) -> DataFrame:
    """Vehicle rows, repeated for each spelling of the property entry of their crash (not ``by_crash``)."""
    vehicles = distinct_on(_heavy_damage_insured(tables), [*v.VEHICLE, *v.DAMAGE_SCALES, "FIN_RESP_TYPE_ID"])
    if by_crash:
        return semi(vehicles, _no_property_damage(tables), v.CRASH)
    return join_on(vehicles, distinct_on(_no_property_damage(tables), [*v.CRASH, "DAMAGED_PROPERTY"]), v.CRASH)


def insured_crashes_without_property_damage(tables: Tables) -> DataFrame:
    """The crash ids of ``insured_without_property_damage``, each once.

    Only crash ids are shuffled, once per table; the vehicle rows are never built.
    """
    return common_keys(_heavy_damage_insured(tables), _no_property_damage(tables), v.CRASH)


# 10. Makes with speeding charges


def _is_colour(column: str) -> Column:
    return (F.col(column) != v.NOT_AVAILABLE) & is_non_numeric(column)


def makes_with_speed_charges(
    tables: Tables, k: int = TOP, colours: int = 10, states: int = 25, of: str = "pairs"
) -> DataFrame:
    """Rows per make for vehicles of the top colours and states, charged units and licensed persons.

    ``of``: what is counted, pairs of vehicle and person, crashes or vehicles.

    The vehicles are made distinct once: the result and the two top lists read the same shuffled rows. For that
    the vehicles without a crash unit, which count for the lists but join nothing, are kept in a branch of their
    own, as the join would otherwise filter one use of the rows and not the other. The lists are bounded by their
    k and broadcast; the number test runs on the distinct spellings, not on every vehicle.
    """
    columns = [*v.VEHICLE, "VEH_LIC_STATE_ID", "VEH_COLOR_ID", "VEH_MAKE_ID"]
    in_crash = F.col("CRASH_ID").isNotNull() & F.col("UNIT_NBR").isNotNull()
    vehicles = distinct_on(tables["units"].filter(in_crash), columns)
    strays = distinct_on(tables["units"].filter(~in_crash), columns)

    look = ["VEH_LIC_STATE_ID", "VEH_COLOR_ID"]
    per_look = count_rows(vehicles, look, "_vehicles").unionAll(count_rows(strays, look, "_vehicles"))
    listed = restrict_to_top(
        vehicles, per_look, "VEH_COLOR_ID", colours, _is_colour("VEH_COLOR_ID"), "_vehicles"
    )
    listed = restrict_to_top(
        listed, per_look, "VEH_LIC_STATE_ID", states, is_non_numeric("VEH_LIC_STATE_ID"), "_vehicles"
    )
    charged = tables["charges"].filter(contains_any("CHARGE", v.SPEED_CHARGES))
    licensed = tables["primary_person"].filter(F.col("DRVR_LIC_TYPE_ID").isin(v.LICENCE_TYPES))
    rows = _matched(listed, licensed, "VEH_MAKE_ID", "count", of, charged)
    return topk(rows, k, ["count"], ["VEH_MAKE_ID"])
