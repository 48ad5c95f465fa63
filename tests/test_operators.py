"""Operators against brute force, and their behaviour on missing values."""

from collections import Counter
from itertools import product

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crashlens.operators import joins
from crashlens.operators.aggregates import count_values, sum_columns
from crashlens.operators.joins import anti, common_keys, count_pairs, join_on, join_per_key, restrict_to_top, semi
from crashlens.operators.keys import distinct_on, duplicate_keys, duplicate_rows, key_ladder, key_set_counts
from crashlens.operators.profiling import describe, frequent_values, null_profile
from crashlens.operators.ranking import (
    collect_bounded,
    first_row,
    number_rows,
    rank_slice,
    top1_per_group,
    top_values,
    topk,
)

key = st.one_of(st.none(), st.integers(0, 3))
side = st.lists(st.tuples(key, st.sampled_from(["a", "b", None])), max_size=12)


def frames(spark, left, right):
    return spark.createDataFrame(left, "k int, a string"), spark.createDataFrame(right, "k int, b string")


def joined(left, right):
    return [(lk, a, b) for (lk, a), (rk, b) in product(left, right) if lk is not None and lk == rk]


@settings(max_examples=8, deadline=None)
@given(left=side, right=side)
def test_joins_match_brute_force(spark, left, right):
    l, r = frames(spark, left, right)
    pairs = joined(left, right)
    assert Counter(map(tuple, join_on(l, r, ["k"]).collect())) == Counter(pairs)

    right_keys = {k for k, _ in right if k is not None}
    assert Counter(map(tuple, semi(l, r, ["k"]).collect())) == Counter(row for row in left if row[0] in right_keys)
    assert Counter(map(tuple, anti(l, r, ["k"]).collect())) == Counter(row for row in left if row[0] not in right_keys)

    assert Counter(row.k for row in common_keys(l, r, ["k"]).collect()) == Counter({k for k, _, _ in pairs})

    for by, pick in ((["a"], (1,)), (["b"], (2,)), (["a", "b"], (1, 2)), (["k"], (0,)), (["k", "b"], (0, 2))):
        expected = Counter(tuple(pair[i] for i in pick) for pair in pairs)
        assert {tuple(row)[:-1]: row["count"] for row in count_pairs(l, r, ["k"], by).collect()} == expected
    assert count_pairs(l, r, ["k"]).first()[0] == len(pairs)


def test_pairs_within_a_third_table(spark):
    l, r = frames(spark, [(1, "a"), (1, "a"), (2, "a"), (3, "b")], [(1, "x"), (1, "y"), (2, "x"), (3, "x")])
    third = spark.createDataFrame([(1,), (1,), (3,), (None,)], "k int")
    assert rows(count_pairs(l, r, ["k"], ["a"], within=third)) == [("a", 4), ("b", 1)]
    assert rows(count_pairs(l, r, ["k"], ["b"], within=third)) == [("x", 3), ("y", 2)]


def test_join_per_key_keeps_all_rows_of_a_key(spark):
    l, _ = frames(spark, [(1, "a"), (1, "b"), (2, "a"), (None, "a")], [])
    per_key = spark.createDataFrame([(1, 10), (None, 20)], "k int, n int")
    assert rows(join_per_key(l, per_key, ["k"])) == [(1, "a", 10), (1, "b", 10)]


def test_restriction_to_a_top_list_with_and_without_broadcast(spark, monkeypatch):
    source, _ = frames(spark, [(1, "a")] * 3 + [(2, "a")] * 2 + [(None, "b")] * 4 + [(3, "c")], [])
    df, _ = frames(spark, [(1, "x"), (2, "x"), (3, "x"), (None, "x")], [])
    for bound in (10_000, 0):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", bound)
        assert rows(restrict_to_top(df, source, "k", 2)) == [(1, "x")]
        assert rows(restrict_to_top(df, source, "k", 2, F.col("k") != 1)) == [(2, "x"), (3, "x")]


@settings(max_examples=6, deadline=None)
@given(data=side)
def test_duplicates_match_brute_force(spark, data):
    df = spark.createDataFrame(data, "k int, a string")
    counts = Counter(data)
    assert {tuple(row)[:2]: row[2] for row in duplicate_keys(df, ["k", "a"], "n").collect()} == {
        pair: n for pair, n in counts.items() if n > 1
    }
    keys = Counter(k for k, _ in data)
    expected = Counter((k, a, keys[k]) for k, a in data if k is not None and keys[k] > 1)
    assert Counter(map(tuple, duplicate_rows(df, ["k"], "n").select("k", "a", "n").collect())) == expected


def test_key_ladder_counts_missing_as_a_value(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, None), (2, "x")], "k int, a string")
    assert rows(key_ladder(df, {"k": ["k"], "both": ["k", "a"]})) == [("both", 3), ("k", 3), ("rows", 4)]
    assert distinct_on(df, ["a"]).count() == 2


def test_key_sets_that_overlap_or_repeat(spark):
    df = spark.createDataFrame([(1, None, "p"), (1, None, "q"), (None, None, "q"), (2, "x", "p")], "k int, _mask string, _rows string")
    sets = {"a": ["k", "_mask"], "b": ["_mask", "_rows"], "again": ["_rows", "_mask"], "c": ["_rows"], "d": ["k"]}
    expected = [("rows", 4), ("a", 3), ("b", 3), ("again", 3), ("c", 2), ("d", 3)]
    assert [tuple(r) for r in key_set_counts(df, sets).collect()] == expected
    assert sorted(map(tuple, key_ladder(df, sets).collect())) == sorted(expected)
    assert {r["combinations"] for r in key_set_counts(df.filter("k > 5"), sets).collect()} == {0}
    with pytest.raises(ValueError, match="no such columns"):
        key_set_counts(df, {"a": ["z"]})


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2) | st.none(), st.sampled_from("ab") | st.none()), max_size=12))
def test_frequent_values_match_brute_force(spark, data):
    df = spark.createDataFrame(data, "`value` int, `a b` string")
    expected = set()
    for at, name in enumerate(df.columns):
        counts = Counter(None if row[at] is None else str(row[at]) for row in data)
        ranked = sorted(counts.items(), key=lambda c: (-c[1], c[0] is None, c[0] or ""))
        distinct = len(counts) - (None in counts)
        expected |= {(name, i + 1, value, n, distinct, counts[None]) for i, (value, n) in enumerate(ranked[:2])}
    assert set(map(tuple, frequent_values(df, 2).collect())) == expected


def test_counts_skip_missing_and_sums_stay_missing(spark):
    df = spark.createDataFrame([("g", None, None), ("g", 1, None), (None, 2, 5)], "k string, a int, b int")
    assert rows(count_values(df, ["k"], "a", "n")) == [("g", 1), (None, 1)]
    assert rows(sum_columns(df, ["k"], {"sa": "a", "sb": "b"})) == [("g", 1, None), (None, 2, 5)]


def test_ranks_break_ties_and_put_missing_last(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", None), ("d", 1), (None, 2)], "k string, n int")
    order = (["n"], ["k"])
    assert [row.k for row in topk(df, 5, *order).collect()] == ["a", "b", None, "d", "c"]
    assert [row.k for row in rank_slice(df, 3, 4, *order).collect()] == [None, "d"]
    assert first_row(df, *order).k == "a"
    assert first_row(df.limit(0), *order) is None
    numbered = number_rows(df.withColumn("g", F.lit(1)), ["g"], *order)
    assert {row.k: row.rn for row in numbered.collect()} == {"a": 1, "b": 2, None: 3, "d": 4, "c": 5}
    assert rows(top1_per_group(df, ["n"], (), ["k"])) == [("a", 2), ("c", None), ("d", 1)]


def test_rank_slice_does_not_depend_on_partitions(spark):
    df = spark.range(0, 1000, 1, 13)
    for parts in (1, 7, 40):
        assert [row.id for row in rank_slice(df.repartition(parts), 3, 5, ["id"]).collect()] == [997, 996, 995]


def test_top_values_rank_only_the_eligible(spark):
    df = spark.createDataFrame([(v,) for v in ["9"] * 5 + ["x"] * 3 + [None] * 2 + ["y"]], "c string")
    eligible = F.col("c") != "9"
    assert [tuple(row) for row in top_values(df, "c", 2, eligible).collect()] == [("x", 3), ("y", 1)]
    assert [tuple(row) for row in top_values(df, "c", 2).collect()] == [("9", 5), ("x", 3)]
    weighted = spark.createDataFrame([("x", 1), ("x", 1), ("y", 5)], "c string, n int")
    assert [tuple(row) for row in top_values(weighted, "c", 5, rows="n").collect()] == [("y", 5), ("x", 2)]


def test_profiles(spark):
    data = [(1.0, "2", None), (float("nan"), "x", None), (None, None, None)]
    df = spark.createDataFrame(data, "d double, s string, e int")
    assert tuple(null_profile(df).first()) == (2, 1, 3)
    text = {row["column"]: tuple(row)[1:] for row in describe(df, ["s", "e"]).collect()}
    assert text == {"s": (2, 2.0, None, "2", "x"), "e": (0, None, None, None, None)}


def test_collecting_more_than_the_bound_is_refused(spark):
    assert len(collect_bounded(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        collect_bounded(spark.range(6), 5)


def test_describe_takes_every_column_type_of_the_tables(spark, sf_dir):
    import os

    for file in sorted(os.listdir(sf_dir)):
        df = spark.read.parquet(f"{sf_dir}/{file}")
        summary = describe(df).collect()
        assert [row["column"] for row in summary] == df.columns
        kinds = dict(df.dtypes)
        for row in summary:
            assert row["count"] == df.where(F.col(row["column"]).isNotNull()).count()
            assert row["mean"] is None or kinds[row["column"]] not in ("timestamp_ntz", "date", "timestamp")
    odd = spark.sql("SELECT map(1, 2) AS m, DATE'2020-01-02' AS d, true AS b, array(1.5) AS a, interval 1 day AS i, X'01' AS x")
    summary = {row["column"]: row for row in describe(odd).collect()}
    assert summary["m"]["count"] == 1 and summary["m"]["max"] is None
    assert summary["d"]["min"] == "2020-01-02" and summary["d"]["mean"] is None and summary["b"]["max"] == "true"
