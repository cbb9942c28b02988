"""Boosting against a plain version, and what is asked of its models out of their folds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import boosting as G
from rasterloom.operators import validate as V
from rasterloom.sources import bindings as B


def plain_tree(codes, g, h, leaves, l2, least):
    """Each row's value of a tree grown leaf by leaf, every split tried row by row."""
    value = lambda r: -g[r].sum() / (h[r].sum() + l2)
    score = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)

    def best(rows):
        found = (1e-9, None)
        for missing_left in (False, True):
            for f in range(codes.shape[1]):
                for b in range(G.BINS):
                    left = np.where(codes[rows, f] == G.BINS, missing_left, codes[rows, f] <= b)
                    if left.sum() >= least and (~left).sum() >= least:
                        gain = score(rows[left]) + score(rows[~left]) - score(rows)
                        if gain > found[0] + 1e-9:
                            found = (gain, (rows[left], rows[~left]))
        return found

    parts = [(np.arange(len(g)), best(np.arange(len(g))))]
    while len(parts) < leaves and max(p[1][0] for p in parts if p[1][1] is not None or p[1][0] < 1) > 1e-9 and any(p[1][1] is not None for p in parts):
        at = max((i for i in range(len(parts)) if parts[i][1][1] is not None), key=lambda i: parts[i][1][0])
        _, (_, halves) = parts.pop(at)
        parts += [(r, best(r)) for r in halves]
    out = np.zeros(len(g))
    for rows, _ in parts:
        out[rows] = value(rows)
    return out


def test_trees_equal_plain_ones():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (90, 3)).astype("f8")
    x[rng.random(x.shape) < 0.15] = np.nan
    codes, g, h = G.binned(x, G.bin_edges(x)), rng.normal(size=90), rng.random(90) + 0.1
    nodes, value, where = G.grown_tree(codes, g, h, 7, 1.0, 5)
    assert np.allclose(value[where], plain_tree(codes, g, h, 7, 1.0, 5)) and (nodes[:, 0] >= 0).sum() == 6


def test_a_fit_tells_apart_what_a_line_does_not():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int) + 2 * (x[:, 2] > 1.3)
    x[y == 3, 2] = np.nan  # being missing tells a class
    made = G.fit(x[:600], y[:600], rounds=40)
    p = G.probabilities(made, x[600:])
    assert np.allclose(p.sum(1), 1) and (made["classes"][p.argmax(1)] == y[600:]).mean() > 0.85
    assert (G.probabilities(made, x[:600]) == G.probabilities(G.fit(x[:600], y[:600], rounds=40), x[:600])).all()
    alone = G.fit(x[:30], np.full(30, 2))
    assert (G.probabilities(alone, x[:5]) == 1).all()


def test_classes_weigh_alike():
    x, y = np.zeros((100, 1)), np.r_[np.zeros(90, int), np.ones(10, int)]
    assert np.allclose(G.probabilities(G.fit(x, y, rounds=3), x)[0], 0.5) and G.probabilities(G.fit(x, y, rounds=3, balanced=False), x)[0, 0] > 0.85


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(4)
    n = 480
    signal, y = rng.normal(size=n), np.zeros(n, int)
    grp, ann = np.arange(n) % 4, np.arange(n) // 8
    y = ((ann // 4 + grp) % 2).astype(int)
    signal = y * 1.5 + signal * 0.5
    rows = pd.DataFrame({"row": np.arange(n), "f1": signal, "f2": rng.normal(size=n), "y": y, "grp": grp, "ann": ann * 4 + grp})
    return spark.createDataFrame(rows).cache()


RULES = {"rounds": 8, "leaves": 6}


def test_out_of_fold_equals_a_loop(planted):
    found = G.out_of_fold(planted, ["f1", "f2"], G.group_folds(planted), **RULES).toPandas().sort_values("row")
    t = planted.toPandas().sort_values("row")
    x, y, g = t[["f1", "f2"]].to_numpy(), t["y"].to_numpy(), t["grp"].to_numpy()
    for k in range(4):
        p = G.probabilities(G.fit(x[g != k], y[g != k], **RULES), x[g == k])
        assert np.allclose(np.stack(found["proba"])[g == k], p)


def test_permutation_null_tells_a_planted_effect_from_none(planted):
    none = planted.withColumn("f1", F.col("f2") * 0 + F.pmod(F.xxhash64("row"), F.lit(1000)))
    for table, low in ((planted, True), (none, False)):
        scores = G.permutation_null(table, ["f1", "f2"], 19, **RULES).toPandas().sort_values("b")["balanced_accuracy"].to_numpy()
        assert len(scores) == 20
        p = (1 + (scores[1:] >= scores[0] - 1e-12).sum()) / 20
        assert (p == 0.05) if low else (p > 0.05)


def test_labels_are_permuted_by_annotation_inside_a_group(planted):
    moved = G.permuted_labels(planted, 3, 1).toPandas()
    whole = moved[moved["b"] == 0]
    for b in (1, 2, 3):
        mine = moved[moved["b"] == b]
        assert len(mine) == len(whole) and (mine.groupby("ann")["y"].nunique() == 1).all()
        assert mine.drop_duplicates("ann").groupby("grp")["y"].sum().equals(whole.drop_duplicates("ann").groupby("grp")["y"].sum())
    assert (moved[moved["b"] == 1].sort_values("row")["y"].to_numpy() != whole.sort_values("row")["y"].to_numpy()).any()


def test_importance_and_baselines(planted):
    found = {r.feature: r.importance for r in G.permutation_importance(planted, ["f1", "f2"], 3, **RULES).collect()}
    assert found["f1"] > 0.25 and abs(found["f2"]) < 0.06
    drawn = G.stratified_baseline(planted, G.group_folds(planted)).toPandas()
    assert len(drawn) == 480 and 0.4 < (drawn["pred"] == drawn["y"]).mean() < 0.6
    gap = G.leakage_gap(planted, ["f1", "f2"], **RULES).first()
    assert gap["gap"] == pytest.approx(gap["random"] - gap["grouped"]) and gap["grouped"] > 0.85


def test_on_the_given_table(spark, data):
    t = B.training(spark, data)
    found = G.out_of_fold(t, ["f1", "f2", "f3"], G.group_folds(t), rounds=5)
    assert found.count() == t.count() and found.where("size(proba) <= 5 AND abs(aggregate(proba, 0D, (a, x) -> a + x) - 1) < 1e-9").count() == t.count()
    assert V.accuracy(V.confusion(found)).count() == 1
