from threading import Barrier
from types import SimpleNamespace

import pytest
from conftest import rows
from pyspark.sql.types import StructType

from crashlens.plans.fixtures import BUILDERS
from crashlens.plans import job
from crashlens.plans.job import STORED, UNREAD, answers, open_tables, result_paths, run_all
from crashlens.sources import (
    SCHEMAS,
    convert_tables,
    read_rejects,
    read_strings,
    read_table,
    read_tables,
    scratch_path,
    stage_table,
    write_result,
)


def csv(folder, name, *lines):
    file = folder / name
    file.write_text("\n".join(lines) + "\n")
    return str(file)


def test_fixed_types_make_bad_text_and_empty_cells_missing(spark, tmp_path):
    path = csv(tmp_path, "units.csv", "CRASH_ID,UNIT_NBR,TOT_INJRY_CNT,VIN", "1,1,NA,", "2,x,,NA", "3,1,4,007")
    lost = [name for name in SCHEMAS["units"].names if name not in ("CRASH_ID", "UNIT_NBR", "TOT_INJRY_CNT", "VIN")]
    df = read_table(spark, path, SCHEMAS["units"], optional=lost)
    assert df.schema == SCHEMAS["units"]
    result = rows(df.select("CRASH_ID", "UNIT_NBR", "TOT_INJRY_CNT", "VIN", "DEATH_CNT"))
    assert result == [(1, 1, None, None, None), (2, None, None, "NA", None), (3, 1, 4, "007", None)]


def test_values_follow_the_header_not_the_position(spark, tmp_path):
    path = csv(tmp_path, "charges.csv", "CHARGE,EXTRA,prsn_nbr,UNIT_NBR,CRASH_ID", "SPEEDING,e,3,2,1")
    df = read_table(spark, path, SCHEMAS["charges"])
    assert df.columns == ["CRASH_ID", "UNIT_NBR", "PRSN_NBR", "CHARGE", "EXTRA"]
    assert rows(df) == [(1, 2, 3, "SPEEDING", "e")]
    assert rows(read_table(spark, path, SCHEMAS["charges"], keep_other=False)) == [(1, 2, 3, "SPEEDING")]


def test_a_missing_column_is_an_error_unless_it_is_optional(spark, tmp_path):
    path = csv(tmp_path, "charges.csv", "CRASH_IDENT,UNIT_NBR,PRSN_NBR,CHARGE", "1,2,3,SPEEDING")
    with pytest.raises(ValueError, match="CRASH_ID"):
        read_table(spark, path, SCHEMAS["charges"])
    with pytest.raises(ValueError, match="missing: CRASH_ID;"):
        read_tables(spark, {"charges": path})
    df = read_table(spark, path, SCHEMAS["charges"], optional=["crash_id"])
    assert rows(df.select("CRASH_ID", "CRASH_IDENT")) == [(None, "1")]


def test_staging_keeps_all_columns(spark, tmp_path):
    path = csv(tmp_path, "endorse.csv", "CRASH_ID,UNIT_NBR,DRVR_LIC_ENDORS_ID", "1,2,NONE")
    staged = convert_tables(spark, {"endorse": path}, {"endorse": str(tmp_path / "staged")})["endorse"]
    assert rows(staged) == [(1, 2, "NONE")] and staged.columns[-1] == "DRVR_LIC_ENDORS_ID"


def test_zip_codes_keep_their_zeros(spark, tmp_path):
    path = csv(tmp_path, "persons.csv", "CRASH_ID,DRVR_ZIP", "1,07001", "2,75001")
    lost = [name for name in SCHEMAS["primary_person"].names if name not in ("CRASH_ID", "DRVR_ZIP")]
    typed = read_table(spark, path, SCHEMAS["primary_person"], optional=lost).select("DRVR_ZIP")
    assert rows(typed) == [("07001",), ("75001",)]
    assert dict(read_table(spark, path, infer=True).dtypes)["DRVR_ZIP"] == "int"
    assert dict(read_strings(spark, path).dtypes) == {"CRASH_ID": "string", "DRVR_ZIP": "string"}


def test_a_file_with_another_column_order_is_refused(spark, tmp_path):
    csv(tmp_path, "a.csv", "CRASH_ID,DAMAGED_PROPERTY", "1,NONE")
    csv(tmp_path, "b.csv", "DAMAGED_PROPERTY,CRASH_ID", "FENCE,2")
    with pytest.raises(Exception, match="header"):
        read_table(spark, str(tmp_path), SCHEMAS["damages"]).collect()


def test_files_of_one_table_are_read_together(spark, tmp_path):
    csv(tmp_path, "a.csv", "CRASH_ID,DAMAGED_PROPERTY", "1,NONE")
    csv(tmp_path, "b.csv", "CRASH_ID,DAMAGED_PROPERTY", '2,"FENCE, WALL"')
    assert rows(read_table(spark, str(tmp_path), SCHEMAS["damages"])) == [(1, "NONE"), (2, "FENCE, WALL")]


def test_write_result_overwrites_and_returns_the_stored_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    write_result(spark.range(3), path)
    assert rows(write_result(spark.range(5, 7), path)) == [(5,), (6,)]


def test_scratch_paths_are_fresh_and_in_the_shared_folder(spark):
    first, second = scratch_path(spark, "t"), scratch_path(spark, "t")
    assert first != second
    assert first.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_no_machine_folder_is_used_on_a_cluster():
    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="yarn", applicationId="test"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(cluster, "t")


def test_conversion_keeps_types_and_rows(spark, tables, tmp_path):
    source, target = str(tmp_path / "csv"), str(tmp_path / "parquet")
    tables["primary_person"].write.csv(source, header=True)
    stored = convert_tables(spark, {"primary_person": source}, {"primary_person": target})["primary_person"]
    columns = tables["primary_person"].columns
    assert rows(stored.select(columns)) == rows(tables["primary_person"])


@pytest.mark.parametrize("mode", ["all_pairs", "staged", "parquet"])
def test_job_gives_the_known_answers(spark, tables, tmp_path, mode):
    fmt = "parquet" if mode == "parquet" else "csv"
    inputs = {name: str(tmp_path / f"in-{name}") for name in BUILDERS}
    for name, path in inputs.items():
        writer = tables[name].write
        writer.parquet(path) if fmt == "parquet" else writer.csv(path, header=True)
    staging = str(tmp_path / "staging") if fmt == "csv" else None

    stored = run_all(spark, inputs, result_paths(str(tmp_path / "out")), fmt, staging, mode == "all_pairs")
    assert ("pairs" in stored["analysis4"].columns) == (mode != "all_pairs")
    found = answers(stored)

    assert found["analysis1"] == 89
    assert stored["analysis1"].count() > 89
    assert found["analysis2"] == 1793
    assert found["analysis3"] == {"BRAND#16": 156, "BRAND#11": 150, "BRAND#13": 149, "BRAND#25": 125, "BRAND#22": 123}
    assert found["analysis4"] == 278
    assert found["analysis5"] == "ST19"
    assert found["analysis6"] == ["BRAND#25", "BRAND#19", "BRAND#8"]
    assert found["analysis7"].count() == 9
    assert found["analysis8"] == ["07008", "07005", "07002", "07003", "UNKNOWN"]
    assert found["analysis9"].count() == 310
    assert found["analysis10"] == ["NA", "BRAND#13", "BRAND#14", "BRAND#25", "BRAND#16"]


@pytest.fixture
def written(spark, tables, tmp_path, monkeypatch):
    """A job over CSV files with a manifest, and the names of the datasets that its last run wrote."""
    inputs = {name: str(tmp_path / f"in-{name}") for name in job.TABLES}
    for name, path in inputs.items():
        tables[name].write.csv(path, header=True)
    made = []
    for name, analysis in list(STORED.items()):
        def noted(tables, analysis=analysis, name=name):
            made.append(name)
            return analysis(tables)
        noted.__name__ = analysis.__name__
        monkeypatch.setitem(STORED, name, noted)
    convert = job.convert_tables
    monkeypatch.setattr(job, "convert_tables", lambda spark, paths, *rest, **more: made.extend(paths) or convert(spark, paths, *rest, **more))

    def run(**options):
        made.clear()
        full = {"outputs": result_paths(str(tmp_path / "out")), "staging": str(tmp_path / "staged"), "manifest": str(tmp_path / "notes")}
        return run_all(spark, inputs, **(full | options)), list(made)

    return SimpleNamespace(run=run, inputs=inputs, folder=tmp_path)


def test_a_stopped_job_goes_on_where_it_ended(spark, written, monkeypatch):
    names = list(STORED)
    with monkeypatch.context() as stopped:
        stopped.setitem(STORED, "analysis5", lambda tables: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            written.run()
    (written.folder / "out" / "analysis5").mkdir()  # what a run that died while it wrote leaves
    stored, made = written.run()
    assert made == names[4:]
    found = answers(stored)
    assert (found["analysis2"], found["analysis4"], found["analysis5"]) == (1793, 278, "ST19")
    assert written.run()[1] == []
    assert job.Manifest(spark, str(written.folder / "notes")).rows()["analysis2"] == 1793

    result = written.folder / "out" / "analysis3"
    next(result.glob("part-*")).unlink()  # a result that lost a file
    assert written.run()[1] == ["analysis3"]
    assert "pairs" not in written.run(all_pairs=True)[0]["analysis4"].columns
    assert written.run()[1] == ["analysis4"]
    assert written.run(outputs=result_paths(str(written.folder / "other")))[1] == names


def test_changed_input_is_staged_and_read_again(written):
    first = written.run()[0]["analysis2"].count()
    with open(f"{written.inputs['units']}/more.csv", "w") as file:
        source = next((written.folder / "in-units").glob("part-*.csv")).read_text().splitlines()
        file.write("\n".join([source[0], *(line.replace("PICKUP", "MOTORCYCLE") for line in source[1:])]) + "\n")
    stored, made = written.run()
    assert made == ["units", *STORED] and stored["analysis2"].count() > first


def test_analyses_run_at_the_same_time(written, monkeypatch):
    met = Barrier(3)
    for name in ("analysis1", "analysis2", "analysis3"):
        analysis = STORED[name]
        monkeypatch.setitem(STORED, name, lambda tables, analysis=analysis: met.wait(60) is not None and analysis(tables))
    found = answers(written.run(at_once=3)[0])
    assert (found["analysis1"], found["analysis2"], found["analysis9"].count()) == (89, 1793, 310)


def test_csv_needs_staging(spark):
    with pytest.raises(ValueError, match="staging"):
        open_tables(spark, dict.fromkeys(BUILDERS, "x.csv"))


def test_queries_share_the_csv_files(spark, sf_dir):
    from crashlens.plans.operator_queries import _charges_as_csv, scan_csv, scan_csv_strings

    first = _charges_as_csv(spark, sf_dir)
    read = [set(df.inputFiles()) for df in (scan_csv(spark, sf_dir), scan_csv_strings(spark, sf_dir))]
    assert read[0] == read[1] and all(first in file for file in read[0])


def test_a_local_session_without_a_shared_folder_has_one_of_its_own():
    local = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="local[2]", applicationId="test"))
    first, second = scratch_path(local, "t"), scratch_path(local, "t")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def test_job_on_empty_tables(spark, tmp_path):
    inputs = {name: str(tmp_path / name) for name in BUILDERS}
    for name, path in inputs.items():
        spark.createDataFrame([], SCHEMAS[name]).write.parquet(path)
    found = answers(run_all(spark, inputs, result_paths(str(tmp_path / "out")), "parquet"))
    assert (found["analysis1"], found["analysis3"], found["analysis5"], found["analysis6"]) == (0, {}, None, [])


def test_typed_parquet_is_read_without_casts(spark, tables, tmp_path):
    path = str(tmp_path / "units")
    write_result(tables["units"], path)
    df = read_tables(spark, {"units": path}, "parquet", optional=UNREAD)["units"].filter("UNIT_NBR = 2")
    assert "cast" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_stored_names():
    assert list(result_paths("/x/")) == list(STORED) == [f"analysis{i}" for i in range(1, 11)]
    assert result_paths("/x/")["analysis1"] == "/x/analysis1"


BROKEN = ["1,2,3", '"x,2,3', "4,5", "1,2,3,4,5", "", "7,NA,z", ",,"]


@pytest.fixture
def broken(tmp_path):
    csv(tmp_path, "a.csv", "CRASH_ID,UNIT_NBR,PRSN_NBR", *BROKEN)
    csv(tmp_path, "b.csv", "CRASH_ID,UNIT_NBR,PRSN_NBR", "8,9,10", "11")
    return str(tmp_path)


def charges_schema():
    return StructType(SCHEMAS["charges"].fields[:3])


def test_broken_records_are_rejected_whole(spark, broken):
    found = read_rejects(spark, broken)
    assert sorted(r["record"] for r in found.collect()) == ['"x,2,3', "1,2,3,4,5", "11", "4,5"]
    assert {r["record"] for r in found.where("file like '%b.csv'").collect()} == {"11"}
    assert found.count() == 4
    good = [("1", "2", "3"), ("7", "NA", "z"), ("8", "9", "10"), (None, None, None)]
    assert rows(read_table(spark, broken, on_bad="reject")) == sorted(good, key=repr)
    assert read_table(spark, broken, on_bad="reject").select("UNIT_NBR").count() == 4
    assert read_table(spark, broken).count() == 8


def test_broken_records_fail_a_query_if_asked(spark, broken):
    with pytest.raises(Exception, match="MALFORMED"):
        read_table(spark, broken, on_bad="raise").collect()
    with pytest.raises(Exception, match="MALFORMED"):
        read_table(spark, broken, on_bad="raise").select("CRASH_ID").collect()


def test_staging_stores_rejects_beside_the_table_with_counts(spark, broken, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("staged") / "charges")
    staged = stage_table(spark, broken, target, charges_schema(), on_bad="reject")
    assert rows(staged.table) == sorted([(1, 2, 3), (7, None, None), (8, 9, 10), (None, None, None)], key=repr)
    assert (staged.rows, staged.rejected, staged.unparsed) == (8, 4, {"CRASH_ID": 0, "UNIT_NBR": 0, "PRSN_NBR": 1})
    assert staged.rejects == f"{target}-rejects"
    assert sorted(r["record"] for r in spark.read.parquet(staged.rejects).collect()) == ['"x,2,3', "1,2,3,4,5", "11", "4,5"]


def test_staging_fails_on_broken_records_unless_told_otherwise(spark, broken, tmp_path_factory):
    folder = tmp_path_factory.mktemp("staged")
    with pytest.raises(Exception, match="broken record"):
        stage_table(spark, broken, str(folder / "a"), charges_schema())
    kept = stage_table(spark, broken, str(folder / "b"), charges_schema(), on_bad="keep")
    assert (kept.table.count(), kept.rows, kept.rejected, kept.rejects) == (8, 8, 4, None)


def test_staging_of_whole_files_has_no_rejects(spark, tmp_path, tables):
    tables["charges"].write.csv(str(tmp_path / "in"), header=True)
    staged = stage_table(spark, str(tmp_path / "in"), str(tmp_path / "out"), SCHEMAS["charges"], on_bad="reject")
    assert (staged.rejects, staged.rejected) == (None, 0) and staged.rows == staged.table.count() == tables["charges"].count()
    assert set(staged.unparsed.values()) == {0}
    parquet = stage_table(spark, str(tmp_path / "out"), str(tmp_path / "again"), SCHEMAS["charges"], "parquet")
    assert (parquet.rows, parquet.rejected, parquet.unparsed) == (staged.rows, 0, {})
