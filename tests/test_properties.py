"""Results do not depend on the order or the partitioning of the input."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from crashlens.plans.job import STORED


@pytest.fixture(scope="module")
def expected(tables):
    return {name: rows(analysis(tables)) for name, analysis in STORED.items()}


@pytest.mark.parametrize("parts", [1, 3, 29])
def test_results_do_not_depend_on_order_or_partitions(tables, expected, parts):
    shuffled = {name: df.orderBy(F.rand(parts)).repartition(parts) for name, df in tables.items()}
    for name, analysis in STORED.items():
        assert rows(analysis(shuffled)) == expected[name], name


def test_results_do_not_depend_on_the_join_strategy(tables, expected, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    for name, analysis in STORED.items():
        assert rows(analysis(tables)) == expected[name], name


def test_results_do_not_depend_on_adaptive_execution(tables, expected, conf):
    conf(spark__sql__adaptive__enabled="false")
    for name, analysis in STORED.items():
        assert rows(analysis(tables)) == expected[name], name
