"""Every registered query against its SQL twin, and the facts known of the derived tables."""

import pytest

import __spark_entry__ as entry_points
from fleetlens.plans.catalog import QUERIES
from fleetlens.plans.derived import AS_OF
from fleetlens.plans.prepared import tables
from fleetlens.operators import loans, quality, reports
from tests.checking import differences, open_duckdb

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return open_duckdb(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry_points.queries()[name](spark, SMALL)
    assert differences(df, con, entry_points.oracle_sql()[name]) == []


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["site_name", "room_type", "equipment_count"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_known_facts(spark):
    t = tables(spark, MIDDLE)
    profile = reports.inventory_profile(t.inventory).first()
    assert (profile.total_records, profile.null_asset_tags, profile.unique_assets) == (15_000, 600, 14_256)
    assert quality.duplicate_keys(t.inventory, ["asset_tag"]).count() == 145
    assert t.locations.count() == 764
    assert loans.available_loaners(t.located, t.loans).count() == 2_495
    out = loans.checked_out_loaners(t.located, t.loans)
    assert out.count() == 316
    assert out.where(f"expected_return_date < timestamp_ntz'{AS_OF}'").count() == 129
