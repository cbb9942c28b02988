"""Spark ML gets training rows that are written, so that its jobs have few tasks."""

from rasterloom.operators import model as Mo
from rasterloom.plans import registry


def test_boosting_is_fitted_on_a_written_table(spark, data, monkeypatch):
    plans, fit = [], Mo.fit_boosting
    monkeypatch.setattr(Mo, "fit_boosting", lambda t, *a, **b: plans.append(t._jdf.queryExecution().executedPlan().toString()) or fit(t, *a, **b))
    registry.QUERIES["v15_boosting"](spark, data)
    assert len(plans) == 1 and "Join" not in plans[0]
