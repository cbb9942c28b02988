"""The check of a raster's pixel type, and of its range where one is given."""

import duckdb
import pandas as pd
import pytest
from oracle import oracle_rows, rows

from rasterloom.plans import registry
from rasterloom.sources import readers as Rd


def test_every_row_counts(spark, tmp_path):
    pd.DataFrame({"event_id": range(3000), "value": [690.78 if i == 2600 else i / 10.0 for i in range(3000)]}).to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    name = "s04_checked_pixels"
    assert rows(registry.QUERIES[name](spark, str(tmp_path))) == oracle_rows(con, registry.ORACLES[name])


def test_a_range_is_checked_where_one_is_given(spark):
    px = spark.createDataFrame([(1, 70000)], "img long, g int")
    assert Rd.checked_gray(px, "g").count() == 1
    with pytest.raises(Exception, match="out of range"):
        Rd.checked_gray(px, "g", 65535).collect()
