"""Every registered query against its SQL in DuckDB, by value and by type."""

import pytest
from conftest import rows

import __spark_entry__ as entry_points
from crashlens.plans.catalog import ORACLES, QUERIES

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_oracle(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    kinds = {column[0]: str(column[1]) for column in result.description}
    assert {column: TYPES[kind] for column, kind in df.dtypes} == kinds

    names = [column[0] for column in result.description]
    expected = sorted((tuple(row[names.index(c)] for c in columns) for row in result.fetchall()), key=repr)
    assert rows(df.select(*[f"`{c}`" for c in columns])) == expected
    assert expected, "a check on no rows shows nothing"


def test_entry_gives_the_crashes_with_many_men(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["CRASH_ID", "MALE_DEATH_COUNT"]
    assert df.count() == 89
