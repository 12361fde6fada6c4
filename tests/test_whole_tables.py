"""Queries that once took some ids take whole tables."""

import pytest

from tests.test_oracles import DATA, pytestmark  # noqa: F401
from tidewall.plans.catalogue import QUERIES
from tidewall.plans.standins import standin


@pytest.mark.parametrize("name, table, key, add", [("sample_transects", "si_asset", "asset_id", 0), ("sample_cells", "si_rain", "cell_id", 100), ("g_line_features", "si_asset", "asset_id", 0), ("polygon_measures", "si_outline", "poly_id", 0), ("sjoin_nearest", "si_asset", "asset_id", 0)])
def test_every_id_has_rows(spark, name, table, key, add):
    want = {r[0] + add for r in standin(spark, DATA, table).select(key).distinct().collect()}
    assert {r[0] for r in QUERIES[name](spark, DATA).select(key).distinct().collect()} == want


@pytest.mark.parametrize("name", ["sjoin_intersect_area", "exposure_events"])
def test_events_are_not_only_of_every_tenth_asset(spark, name):
    assert {r[0] % 10 for r in QUERIES[name](spark, DATA).select("asset_id").collect()} - {0}
