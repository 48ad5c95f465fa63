"""The batch job: read the crash tables, run and store the ten analyses, and answer from what was stored."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.operators.ranking import collect_bounded, first_row, sort_by
from crashlens.plans import analyses
from crashlens.plans import values as v
from crashlens.plans.manifest import Manifest, digest_of, files_state
from crashlens.sources import convert_tables, read_tables, write_result
from crashlens.sources.readers import OnBad

TABLES = ("units", "primary_person", "charges", "damages")

# Columns of the tables that no analysis reads, so files may lack them.
UNREAD = ("VEH_DMAG_AREA_1_ID", "VEH_DMAG_AREA_2_ID")

# What is stored per analysis. The first keeps the counts of all crashes, the fourth its pairs folded with their number, the
# ninth its vehicle rows.
STORED: dict[str, Callable[[analyses.Tables], DataFrame]] = {
    "analysis1": analyses.men_per_crash,
    "analysis2": analyses.two_wheelers,
    "analysis3": analyses.makes_with_driver_deaths,
    "analysis4": analyses.licensed_hit_and_run_folded,
    "analysis5": analyses.states_without_women,
    "analysis6": analyses.makes_by_casualties,
    "analysis7": analyses.top_ethnicity_per_body_style,
    "analysis8": analyses.zips_with_alcohol,
    "analysis9": analyses.insured_without_property_damage,
    "analysis10": analyses.makes_with_speed_charges,
}


def result_paths(folder: str) -> dict[str, str]:
    """One output path per analysis below a folder."""
    return {name: f"{folder.rstrip('/')}/{name}" for name in STORED}


def open_tables(
    spark: SparkSession, inputs: Mapping[str, str], fmt: str = "csv", staging: str | None = None, on_bad: OnBad = "raise"
) -> dict[str, DataFrame]:
    """The four tables the analyses read.

    CSV is first stored as typed Parquet in the folder ``staging``, so that text is parsed once, not once per
    analysis, and each analysis reads only its own columns. Other formats are, if a folder is given. ``on_bad``: what becomes of broken
    records, see ``stage_table``.
    """
    used = {name: inputs[name] for name in TABLES}
    if fmt == "csv" and staging is None:
        raise ValueError("CSV needs a folder for staging, or each analysis would parse the files again")
    if staging is None or fmt == "parquet":
        return read_tables(spark, used, fmt, optional=UNREAD)
    return convert_tables(spark, used, {name: f"{staging.rstrip('/')}/{name}" for name in TABLES}, fmt, on_bad, optional=UNREAD)


def side_by_side(spark: SparkSession, steps: Mapping[str, Callable[[], DataFrame]], at_once: int) -> dict[str, DataFrame]:
    """Run independent steps, some at once, each in a scheduler pool of its own name (``spark.scheduler.mode=FAIR`` shares the
    executors among them; otherwise a later step takes what an earlier one leaves free).

    If one fails, those that run end, the others are not begun, and its error is raised.
    """

    failed: list[BaseException] = []

    def run(name: str) -> DataFrame | None:
        if failed:
            return None
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            return steps[name]()
        except BaseException as error:
            failed.append(error)
            raise

    with ThreadPoolExecutor(max_workers=max(at_once, 1)) as threads:
        futures = {name: threads.submit(inheritable_thread_target(spark)(run), name) for name in steps}
    if failed:
        raise failed[0]
    return {name: future.result() for name, future in futures.items()}


def run_all(
    spark: SparkSession,
    inputs: Mapping[str, str],
    outputs: Mapping[str, str],
    fmt: str = "csv",
    staging: str | None = None,
    all_pairs: bool = False,
    on_bad: OnBad = "raise",
    manifest: str | None = None,
    at_once: int = 1,
) -> dict[str, DataFrame]:
    """Run and store all analyses; returns the stored datasets by analysis name.

    Every plan runs once, in its write; ``answers`` reads the stored rows. ``all_pairs``: store a row for each pair of
    the fourth analysis, whose number grows with the product of the rows of a crash unit.

    ``manifest``: a folder where finished tables and results are noted. A run that was stopped is taken up where it ended by the
    same call; whatever was made from other files or options, or has changed since, is made again. ``at_once``: how many analyses
    run at the same time.
    """
    chosen = STORED | ({"analysis4": analyses.licensed_hit_and_run} if all_pairs else {})
    if manifest is None:
        tables = open_tables(spark, inputs, fmt, staging, on_bad)
        steps = {name: lambda a=analysis, n=name: write_result(a(tables), outputs[n]) for name, analysis in chosen.items()}
        return side_by_side(spark, steps, at_once)

    notes = Manifest(spark, manifest)
    made_from = {name: digest_of({"path": inputs[name], "files": files_state(spark, inputs[name]), "format": fmt, "on_bad": on_bad}) for name in TABLES}
    if staging is None or fmt == "parquet":
        tables = open_tables(spark, inputs, fmt, staging, on_bad)
    else:
        tables = {}
        for name in TABLES:
            target = f"{staging.rstrip('/')}/{name}"
            convert = lambda n=name, t=target: convert_tables(spark, {n: inputs[n]}, {n: t}, fmt, on_bad, optional=UNREAD)[n]
            tables[name] = notes.step(f"staged_{name}", made_from[name], target, convert)

    def step(name: str, analysis: Callable[[analyses.Tables], DataFrame]) -> Callable[[], DataFrame]:
        source = digest_of({"tables": made_from, "analysis": analysis.__name__, "path": outputs[name]})
        return lambda: notes.step(name, source, outputs[name], lambda: write_result(analysis(tables), outputs[name]))

    return side_by_side(spark, {name: step(name, analysis) for name, analysis in chosen.items()}, at_once)


def _pairs(stored: DataFrame) -> int:
    """Number of pairs: the sum of the folded ones."""
    return stored.agg(F.sum("pairs")).first()[0] or 0 if "pairs" in stored.columns else stored.count()


def answers(stored: Mapping[str, DataFrame]) -> dict[str, object]:
    """The answer of each analysis from its stored dataset.

    Counts, top lists and the best state are small Python values. Results that grow with the data, the crash
    ids of the ninth analysis among them, stay DataFrames.
    """
    ranks = analyses.LAST - analyses.FIRST + 1
    makes3 = collect_bounded(
        sort_by(stored["analysis3"], [v.DRIVER_DEATHS], ["VEH_MAKE_ID"]), analyses.TOP
    )
    makes6 = collect_bounded(sort_by(stored["analysis6"], [v.CASUALTIES], ["VEH_MAKE_ID"]), ranks)
    zips8 = collect_bounded(sort_by(stored["analysis8"], [v.ALCOHOL_CRASHES], ["DRVR_ZIP"]), analyses.TOP)
    makes10 = collect_bounded(sort_by(stored["analysis10"], ["count"], ["VEH_MAKE_ID"]), analyses.TOP)
    state5 = first_row(stored["analysis5"], [v.WITHOUT_WOMEN], ["DRVR_LIC_STATE_ID"])
    return {
        "analysis1": stored["analysis1"].filter(F.col(v.MEN_KILLED) > analyses.MANY_MEN).count(),
        "analysis2": stored["analysis2"].count(),
        "analysis3": {row.VEH_MAKE_ID: row[v.DRIVER_DEATHS] for row in makes3},
        "analysis4": _pairs(stored["analysis4"]),
        "analysis5": state5 and state5.DRVR_LIC_STATE_ID,
        "analysis6": [row.VEH_MAKE_ID for row in makes6],
        "analysis7": stored["analysis7"],
        "analysis8": [row.DRVR_ZIP for row in zips8],
        "analysis9": stored["analysis9"].select("CRASH_ID").distinct(),
        "analysis10": [row.VEH_MAKE_ID for row in makes10],
    }
