"""Grays beyond 16 bits, which a large table of events has, in the queries that bin them, against their SQL."""

import duckdb
import pandas as pd
import pytest
from oracle import oracle_rows, rows

from rasterloom.plans import registry


@pytest.fixture(scope="module")
def beyond(tmp_path_factory):
    """Three images, of which two have grays above 65535."""
    at = tmp_path_factory.mktemp("beyond")
    value = [(i * 37 % 4001) / 10.0 for i in range(6000)]
    value[100], value[200], value[3000] = 655.36, 690.78, 1200.5
    pd.DataFrame({"event_id": range(6000), "value": value}).to_parquet(at / "events.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["a10_pooled_histogram", "h09_gray_range_of_run", "t05_gray_range", "k10_threshold_identity", "h01_otsu", "h02_triangle"])
def test_beyond_full_scale(spark, beyond, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{beyond}/events.parquet'")
    assert rows(registry.QUERIES[name](spark, beyond)) == oracle_rows(con, registry.ORACLES[name])


def test_calibration_record_counts_every_pixel(spark, beyond):
    assert '"pixels":6000' in registry.QUERIES["k11_calibration_record"](spark, beyond).first().record
