import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
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


def passing(spark, values, predicate):
    df = spark.createDataFrame([(value,) for value in values], "c string")
    return [row.c for row in df.filter(predicate).collect()]


def test_predicates_drop_missing_values(spark):
    values = ["NA", "na", "Alcohol", None]
    assert passing(spark, values, not_in("c", ["NA"])) == ["na", "Alcohol"]
    assert passing(spark, values, iin("c", ["Na"])) == ["NA", "na"]
    assert passing(spark, values, not_iin("c", ["NA"])) == ["Alcohol"]
    assert passing(spark, values, icontains("c", "ALC")) == ["Alcohol"]
    assert passing(spark, values, contains_any("c", ["alc", "Al", "n"])) == ["na", "Alcohol"]


def test_excluded_words_do_not_pass_text_order(spark):
    values = ["DAMAGED 4", "DAMAGED 5", "DAMAGED 7 HIGHEST", "NO DAMAGE", None]
    expected = ["DAMAGED 5", "DAMAGED 7 HIGHEST"]
    assert passing(spark, values, at_least_text("c", "DAMAGED 5", ["NO DAMAGE"])) == expected


def test_any_column_passes_beside_a_missing_one(spark):
    df = spark.createDataFrame([("x", None), (None, "x"), (None, None), ("y", "z")], "a string, b string")
    assert df.filter(any_column(lambda c: F.col(c) == "x", ["a", "b"])).count() == 2


def test_non_numeric_keeps_text_and_missing(spark):
    values = ["98", "NaN", "1D", "TX", None, " 7 ", "-inf", "+.5e3", "1_0", "", "N", "0x1p3", "\t8"]
    assert passing(spark, values, is_non_numeric("c")) == ["TX", None, "1_0", "", "N"]


number_letters = st.sampled_from(list(" \t\x00\x1f\x7f\xa0+-.0123456789eEdDfFxXpPNaAnIiyYtT_,"))
number_like = st.text(alphabet=number_letters, max_size=9)


@pytest.mark.parametrize("kind", ["float", "double", "int"])
@settings(max_examples=6, deadline=None)
@given(values=st.lists(st.one_of(st.none(), st.text(max_size=6), number_like), min_size=300, max_size=400))
def test_guarded_parse_equals_the_plain_cast(spark, kind, values):
    clean = [v.encode("utf-8", "ignore").decode() if v is not None else None for v in values]
    df = spark.createDataFrame([(value,) for value in clean], "c string")
    plain = F.col("c").try_cast(kind)
    assert df.filter(~parse_number("c", kind).eqNullSafe(plain)).collect() == []
    assert df.filter(is_non_numeric("c", kind) != plain.isNull()).collect() == []


def test_words_are_no_numbers_and_every_number_is_one(spark):
    """The look at the beginning must let through all that the cast takes."""
    signs, words = ("", "+", "-", " ", "\t-"), ("nan", "NaN", "inf", "INF", "Infinity", "iNfInItY", "NA", "NONE", "Infiniti", "nano", "I", "1", ".5", "1e3", "2d", "3F", ".", "-", "")
    texts = [sign + word + end for sign in signs for word in words for end in ("", " ", "\n", "x")]
    df = spark.createDataFrame([(text,) for text in texts], "t string")
    different = df.where(~parse_number("t").eqNullSafe(F.col("t").try_cast("double")))
    assert different.count() == 0
