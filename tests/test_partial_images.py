"""Array queries on a table with whole and partial images, against their SQL."""

import duckdb
import pytest
from oracle import oracle_rows, rows

from rasterloom.plans import registry

NAMES = ["j10_nearest_fiber_any", "m09_fiber_width_any", "m01_zone_outside_any", "m10_gap_centers_any", "g05_gap_stats_any", "m12_coherence_any"]


@pytest.fixture(scope="module")
def mixed(tmp_path_factory):
    """A whole image, one with two pixels missing, and one that ends in its 43rd row."""
    folder = tmp_path_factory.mktemp("mixed")
    duckdb.sql(f"""COPY (SELECT event_id, CASE WHEN hash(event_id) % 40 = 0 THEN 80.0 ELSE (hash(event_id + 1) % 6900) / 100.0 END AS value
      FROM (SELECT unnest(range(7150)) AS event_id) WHERE event_id NOT IN (2500 + 777, 2500 + 1625)) TO '{folder}/events.parquet' (FORMAT parquet)""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_every_image_counts(spark, mixed, name):
    folder, con = mixed
    found, expected = rows(registry.QUERIES[name](spark, folder)), oracle_rows(con, registry.ORACLES[name])
    assert found == expected and {r[found[0].index("img")] for r in found[1]} == {"0", "1", "2"}


def test_zone_modes_of_every_image(spark, mixed):
    assert {r.img for r in registry.QUERIES["m02_zone_modes"](spark, mixed[0]).collect()} == {0, 1, 2}
