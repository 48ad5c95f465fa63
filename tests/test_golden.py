"""Known results of the analyses on the derived tables at the smallest scale."""

import pytest
from conftest import SF_DIR, rows

from crashlens.plans import analyses

pytestmark = pytest.mark.skipif(not SF_DIR.endswith("sf0.001"), reason="values are for sf0.001")


def test_table_sizes(tables):
    sizes = {name: (df.count(), df.distinct().count()) for name, df in tables.items()}
    assert sizes == {
        "units": (6317, 5998),
        "primary_person": (6000, 5998),
        "charges": (6000, 5632),
        "damages": (1000, 1000),
    }


@pytest.mark.parametrize(
    ("analysis", "options", "count"),
    [
        (analyses.crashes_with_many_men, {}, 89),
        (analyses.crashes_with_many_men, {"any_injury": True}, 410),
        (analyses.two_wheelers, {}, 1793),
        (analyses.licensed_hit_and_run, {}, 278),
        (analyses.licensed_hit_and_run, {"any_person": True}, 334),
        (analyses.states_without_women, {}, 21),
        (analyses.insured_without_property_damage, {}, 493),
        (analyses.insured_without_property_damage, {"by_crash": True}, 493),
        (analyses.insured_crashes_without_property_damage, {}, 310),
        (analyses.top_ethnicity_per_body_style, {"with_hit_and_run": True}, 9),
    ],
)
def test_row_counts(tables, analysis, options, count):
    assert analysis(tables, **options).count() == count


def test_counts_without_rows(tables):
    assert analyses.licensed_hit_and_run_count(tables).first()[0] == 278
    assert analyses.licensed_hit_and_run_count(tables, any_person=True).first()[0] == 334


@pytest.mark.parametrize(
    ("analysis", "options", "expected"),
    [
        (
            analyses.makes_with_driver_deaths,
            {},
            [("BRAND#16", 156), ("BRAND#11", 150), ("BRAND#13", 149), ("BRAND#25", 125), ("BRAND#22", 123)],
        ),
        (
            analyses.makes_with_driver_deaths,
            {"by_death_time": True},
            [("BRAND#25", 114), ("BRAND#11", 113), ("BRAND#22", 99), ("BRAND#19", 98), ("BRAND#13", 95)],
        ),
        (
            analyses.zips_with_alcohol,
            {},
            [("07008", 282), ("07005", 262), ("07002", 259), ("07003", 253), ("UNKNOWN", 249)],
        ),
        (
            analyses.makes_with_speed_charges,
            {},
            [("NA", 300), ("BRAND#13", 270), ("BRAND#14", 221), ("BRAND#25", 211), ("BRAND#16", 182)],
        ),
    ],
)
def test_top_lists(tables, analysis, options, expected):
    assert [tuple(row) for row in analysis(tables, **options).collect()] == expected


def test_top_state(tables):
    assert tuple(analyses.states_without_women(tables).first()) == ("ST19", 51)
    assert analyses.top_state_without_women(tables).first()[0] == "ST19"


def test_ranks_three_to_five(tables):
    makes = [(row.VEH_MAKE_ID, row.AGG_COUNT) for row in analyses.makes_by_casualties(tables).collect()]
    assert makes == [("BRAND#25", 573), ("BRAND#19", 564), ("BRAND#8", 558)]


def test_ethnicity_per_body_style(tables):
    expected = {
        "ECONOMY": "ETH5",
        "LARGE": "ETH3",
        "MEDIUM": "ETH5",
        "MOTORCYCLE": "ETH6",
        "PICKUP": "ETH6",
        "POLICE MOTORCYCLE": "ETH6",
        "PROMO": "ETH5",
        "SMALL": "ETH6",
        "STANDARD": "ETH6",
    }
    assert dict(rows(analyses.top_ethnicity_per_body_style(tables))) == expected
