"""Fits take all rows of their folds, however many there are, and no sample of them; rows and folds are not joined through the driver."""

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import boosting as G

ROWS = 250_000


@pytest.fixture
def seen(monkeypatch):
    """Rows and plans of what is fitted."""
    noted, models = [], G.models

    def counted(train, *args, **rules):
        noted.append((train.count(), train._jdf.queryExecution().executedPlan().toString()))
        return models(train, *args, **rules)

    monkeypatch.setattr(G, "models", counted)
    return noted


@pytest.mark.parametrize("made", [
    lambda t: G.permutation_importance(t, ["f"], 1, rounds=1, leaves=2),
    lambda t: G.out_of_fold(t, ["f"], G.group_folds(t), rounds=1, leaves=2)])
def test_all_rows_are_fitted(spark, made, seen):
    train = spark.range(ROWS).select(F.col("id").alias("row"), F.pmod("id", F.lit(97)).cast("double").alias("f"), F.pmod("id", F.lit(3)).alias("y"),
                                     F.pmod("id", F.lit(2)).alias("grp"))
    made(train)
    assert [n for n, _ in seen] == [ROWS]  # of two folds, each row is in the fit of the other


def test_folds_are_not_broadcast(spark, tmp_path, seen):
    rows = [(i, float(i % 97), i % 3, i % 2) for i in range(200)]
    spark.createDataFrame(rows, "row long, f double, y long, grp long").write.parquet(str(tmp_path / "rows"))
    train = spark.read.parquet(str(tmp_path / "rows"))
    G.permutation_importance(train, ["f"], 1, rounds=1, leaves=2)
    (count, plan), = seen
    assert count == 200 and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
