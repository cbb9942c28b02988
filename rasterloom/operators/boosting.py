"""Gradient boosting on histograms, and what is asked of a fitted model out of its folds.

One fit is numpy in one task, which keeps its rows narrow (some 90 bytes a row
of three features and five classes, and no copy of the table); the many fits
of a validation (folds, permutations) are dealt over tasks, and rows of their
models and predictions are tables too.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dealt, written
from . import validate as V

#: Bins of a feature, and the bin after them of missing values.
BINS = 255

#: Rows of a slice of what is made of all rows in passing.
SLICE = 1 << 16


def _slices(n: int) -> list[slice]:
    return [slice(i, min(n, i + SLICE)) for i in range(0, n, SLICE)]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of values by feature, a byte each; BINS where missing."""
    codes = np.empty(x.shape, "u1", "F")
    for f, e in enumerate(edges):
        codes[:, f] = _column_bins(x[:, f], e)
    return codes


def _column_bins(column: np.ndarray, edges: np.ndarray) -> np.ndarray:
    codes = np.empty(len(column), "u1")
    for s in _slices(len(column)):
        codes[s] = np.where(np.isnan(column[s]), BINS, np.searchsorted(edges, column[s], side="left"))
    return codes


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    """Upper ends of the bins but the last: between different values if these are few, else quantiles."""
    return [_column_edges(column) for column in x.T]


def _column_edges(column: np.ndarray) -> np.ndarray:
    column = column[~np.isnan(column)]
    values = np.unique(column)
    if len(values) > BINS:
        del values
        return np.unique(np.quantile(column, np.arange(1, BINS) / BINS))
    return (values[:-1] + values[1:]) / 2


def _best_split(sums: np.ndarray, l2: float, least: int) -> tuple[float, int, int, bool]:
    """gain, feature, last bin to the left, and whether missing values go left, of sums (gradient, hessian, rows) by feature and bin."""
    total = sums[:, 0].sum(1)
    score = lambda s: s[0] ** 2 / (s[1] + l2)
    best = (0.0, -1, 0, False)
    upto = np.cumsum(sums[:, :, :BINS], 2)
    for missing_left in (False, True):
        left = upto + sums[:, :, BINS:] if missing_left else upto
        right = total[:, None, None] - left
        gain = np.where((left[2] >= least) & (right[2] >= least), score(left) + score(right) - score(total), -1.0)
        at = int(gain.argmax())
        if gain.flat[at] > best[0] + 1e-12:
            best = (float(gain.flat[at]), at // BINS, at % BINS, missing_left)
    return best


def grown_tree(codes: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, leaves: int, l2: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (feature or -1, bin, missing left, left, right) and values of a tree grown leaf by leaf, the best gain first, and each row's leaf."""
    n, k = codes.shape

    def sums(rows: np.ndarray | slice) -> np.ndarray:
        g, h = gradient[rows], hessian[rows]
        made = np.empty((3, k, BINS + 1))
        for f in range(k):
            mine = codes[rows, f].astype("i8")
            made[:, f] = np.bincount(mine, g, BINS + 1), np.bincount(mine, h, BINS + 1), np.bincount(mine, minlength=BINS + 1)
        return made

    nodes, value, where = [[-1, 0, 0, 0, 0]], [0.0], np.zeros(n, np.min_scalar_type(2 * leaves))
    held = {0: (np.arange(n, dtype=np.min_scalar_type(n)), sums(slice(None)))}
    queue: list = []

    def weigh(node: int) -> None:
        total = held[node][1][:, 0].sum(1)
        value[node] = -total[0] / (total[1] + l2)
        found = _best_split(held[node][1], l2, least)
        if found[1] >= 0:
            heapq.heappush(queue, (-found[0], node, found))

    weigh(0)
    while queue and len(held) < leaves:
        _, node, (_, feature, last, missing_left) = heapq.heappop(queue)
        rows, whole = held.pop(node)
        mine = codes[rows, feature]
        left = np.where(mine == BINS, missing_left, mine <= last)
        parts = rows[left], rows[~left]
        small = int(len(parts[1]) < len(parts[0]))
        counted = sums(parts[small])
        both = (counted, whole - counted) if small == 0 else (whole - counted, counted)
        at = len(nodes)
        nodes[node] = [feature, last, int(missing_left), at, at + 1]
        for side in (0, 1):
            nodes.append([-1, 0, 0, 0, 0])
            value.append(0.0)
            held[at + side] = (parts[side], both[side])
            weigh(at + side)
    for node, (rows, _) in held.items():
        where[rows] = node
    return np.array(nodes), np.array(value), where


def _softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray | Iterable[np.ndarray], y: np.ndarray, rounds: int = 200, leaves: int = 31, rate: float = 0.1, l2: float = 1.0, least: int = 20, balanced: bool = True) -> dict:
    """Multinomial boosting: a tree a class and round on the softmax's gradients; nan is a value of its own; classes weigh alike if ``balanced``.

    ``x`` is a matrix, or its columns one after another, each of which may go
    once it is binned. What is as long as the rows is bins, scores (8 bytes a
    class), one tree's gradients and leaves; probabilities are made of the
    scores by slices, anew for each class.
    """
    classes = np.unique(y)
    at = np.searchsorted(classes, y).astype(np.min_scalar_type(len(classes)))
    count, n = np.bincount(at, minlength=len(classes)), len(at)
    del y
    weigh = n / (len(classes) * count) if balanced else np.ones(len(classes))
    edges, codes = [], []
    for column in x.T if isinstance(x, np.ndarray) else x:
        edges.append(_column_edges(column))
        codes.append(_column_bins(column, edges[-1]))
        del column
    codes = np.stack(codes).T if codes else np.zeros((n, 0), "u1")
    weight = weigh[at]
    base = np.log(np.bincount(at, weight, len(classes)) / weight.sum())
    del weight
    raw, trees = np.repeat(base[:, None], n, 1), []
    gradient, hessian = np.empty(n), np.empty(n)
    for _ in range(rounds if len(classes) > 1 else 0):
        made, moves = [], []
        for c in range(len(classes)):
            for s in _slices(n):
                p, w = _softmax(np.ascontiguousarray(raw[:, s].T))[:, c], weigh[at[s]]
                gradient[s], hessian[s] = w * (p - (at[s] == c)), w * p * (1 - p)
            nodes, value, where = grown_tree(codes, gradient, hessian, leaves, l2, least)
            made.append((nodes, rate * value))
            moves.append(where)
        for scores, (_, value), where in zip(raw, made, moves):  # after the round, whose gradients are of the scores before it
            for s in _slices(n):
                scores[s] += value[where[s]]
        trees.append(made)
    return {"classes": classes, "edges": edges, "base": base, "trees": trees}


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    """A row's probability of each class of the model, in their order."""
    codes = binned(np.asarray(x, "f8"), model["edges"])
    raw = np.tile(model["base"], (len(codes), 1))
    rows = np.arange(len(codes))
    for made in model["trees"]:
        for c, (nodes, value) in enumerate(made):
            at = np.zeros(len(codes), "i8")
            while True:
                feature, last, missing_left, left, right = nodes[at].T
                inner = feature >= 0
                if not inner.any():
                    break
                mine = codes[rows, np.maximum(feature, 0)]
                goes = np.where(mine == BINS, missing_left == 1, mine <= last)
                at = np.where(inner, np.where(goes, left, right), at)
            raw[:, c] += value[at]
    return _softmax(raw)


def _matrix(part: pd.DataFrame, features: Sequence[str]) -> np.ndarray:
    return part[list(features)].to_numpy("f8", na_value=np.nan)


def models(train: DataFrame, features: Sequence[str], keys: Sequence[str], **rules) -> DataFrame:
    """keys and model (pickled) of each group of the rows of ``train(row, y, features, keys)``; a fit takes all rows of its group."""
    def made(key: tuple, held: list[tuple]) -> pd.DataFrame:
        y = np.concatenate([p.pop() for p in held])
        columns = (np.concatenate([p.pop() for p in held]) for _ in features)  # each goes from the pieces as it is taken
        return pd.DataFrame([{**{k: int(v) for k, v in zip(keys, key)}, "model": pickle.dumps(fit(columns, y, **rules))}])

    def run(frames):
        at, held = None, []
        for frame in frames:
            names = frame[list(keys)].to_numpy()
            edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
            for i, j in zip(edges[:-1], edges[1:]):
                if at is not None and at != tuple(names[i]):
                    yield made(at, held)
                    held = []
                at, piece = tuple(names[i]), frame.iloc[i:j]
                held.append([*(piece[f].to_numpy("f8", na_value=np.nan, copy=True) for f in reversed(features)), piece["y"].to_numpy(copy=True)])
        if at is not None:
            yield made(at, held)

    schema = ", ".join(f"{k} long" for k in keys) + ", model binary"
    own = train.select("row", "y", *features, *(F.col(k).cast("long").alias(k) for k in keys))
    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not put together again, as fits are long
    return own.repartition(parts, *keys).sortWithinPartitions(*keys, "row").drop("row").mapInPandas(run, schema)


def predicted(fitted: DataFrame, rows: DataFrame, features: Sequence[str], keys: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """keys, carried columns, proba (by class 0, 1 and so on) and pred of the rows, by the model of their keys; ties go to the smallest class.

    The rows of a model are dealt over parts, each behind a copy of it, and go
    by it a batch at a time, so that no group of rows is held whole.
    """
    def run(frames):
        at, model = None, None
        for frame in frames:
            names = frame["_at"].to_numpy()
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for i, j in zip(edges[:-1], edges[1:]):
                piece = frame.iloc[i:j]
                if names[i] != at:  # the model comes first
                    at, made = names[i], piece["model"].iloc[0]
                    model = None if made is None else pickle.loads(made)
                right = piece[piece["model"].isna()]
                if model is None or not len(right):
                    continue
                p = np.zeros((len(right), int(model["classes"].max()) + 1))
                p[:, model["classes"]] = probabilities(model, _matrix(right, features))
                yield right[[*keys, *carried]].assign(proba=list(p), pred=p.argmax(1))

    fitted = written(fitted, "models")
    spark = fitted.sparkSession
    parts = -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, fitted.count()))
    own = rows.select(*(F.col(k).cast("long").alias(k) for k in keys), *carried, *(c for c in features if c not in carried))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name in (*keys, *carried))
    named = lambda part: F.concat_ws("/", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), part).alias("_at")
    # A model's row has 0 in the rows' columns, so that whole numbers stay so.
    ahead = fitted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(
        named(F.col("_part")), "model", *(F.col(f.name) if f.name in keys else F.lit(0).cast(f.dataType).alias(f.name) for f in own.schema.fields))
    behind = own.select(named(F.pmod(F.xxhash64(*own.columns), F.lit(parts))), F.lit(None).cast("binary").alias("model"), *own.columns)
    dealt_out = ahead.union(behind).repartition("_at").sortWithinPartitions("_at", F.col("model").isNull())
    return dealt_out.mapInPandas(run, f"{types}, proba array<double>, pred long")


def fold_rows(train: DataFrame, folds: DataFrame, held_out: bool) -> DataFrame:
    """The rows of each fold's test part, or those that its model may see: ``folds`` is (row, fold)."""
    own = train.join(dealt(folds), "row")
    if held_out:
        return own
    all_folds = folds.select(F.col("fold").alias("_fold")).distinct()
    listed = own.crossJoin(all_folds.agg(F.collect_list("_fold").alias("_folds")))
    return listed.withColumn("_held", F.explode("_folds")).where("_held != fold").drop("fold", "_folds").withColumnRenamed("_held", "fold")


def group_folds(train: DataFrame) -> DataFrame:
    """row and fold: each group is a fold."""
    return train.select("row", F.col("grp").alias("fold"))


def out_of_fold(train: DataFrame, features: Sequence[str], folds: DataFrame, keys: Sequence[str] = (), **rules) -> DataFrame:
    """keys, fold, row, y, grp, proba and pred of each row by a model that did not see its fold.

    ``train`` may hold several tables told apart by ``keys`` (permutations);
    each (keys, fold) is a fit, whose copy of the rows streams to its task.
    """
    by = [*keys, "fold"]
    fitted = models(fold_rows(train, folds, False), features, by, **rules)
    return predicted(fitted, fold_rows(train, folds, True), features, by, ["row", "y", "grp"])


def permuted_labels(train: DataFrame, permutations: int, seed: int = 0) -> DataFrame:
    """train with b (0: as it is; 1 and so on: permuted) and y dealt anew among the annotations of each group.

    An annotation's label is its first row's. Units are numbered twice, by name
    and by a hash, and a unit gets the label of the unit of the same number.
    """
    units = train.groupBy("grp", "ann").agg(F.min_by("y", "row").alias("y"))
    drawn = units.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    plain, mixed = Window.partitionBy("b", "grp").orderBy("ann"), Window.partitionBy("b", "grp").orderBy(F.xxhash64(F.lit(seed), "b", "grp", "ann"), "ann")
    numbered = drawn.select("b", "grp", "ann", "y", F.row_number().over(plain).alias("i"), F.row_number().over(mixed).alias("j"))
    dealt = numbered.select("b", "grp", "ann", "i").join(numbered.select("b", "grp", F.col("j").alias("i"), "y"), ["b", "grp", "i"]).select("b", "grp", "ann", F.col("y").alias("_y"))
    moved = train.join(dealt, ["grp", "ann"]).withColumn("y", F.col("_y")).drop("_y")
    return train.withColumn("b", F.lit(0)).unionByName(moved.select("b", *train.columns).select(*train.columns, "b"))


def permutation_null(train: DataFrame, features: Sequence[str], permutations: int = 200, seed: int = 0, **rules) -> DataFrame:
    """b and balanced_accuracy of the whole cross-validation by group, of the labels as they are (b = 0) and permuted; see validate.permutation_p for p."""
    tables = permuted_labels(train, permutations, seed)
    found = out_of_fold(tables, features, group_folds(train), ["b"], **rules)
    return V.accuracy(V.confusion(found, "b"), "b").select("b", "balanced_accuracy")


def permutation_importance(train: DataFrame, features: Sequence[str], repeats: int = 5, seed: int = 0, **rules) -> DataFrame:
    """feature, importance and sd: the fall in balanced accuracy of held-out groups when a feature is permuted among their rows, by models that did not see them.

    Rows of a fold are numbered by their own number and by a hash, and a row
    gets the value of the row of the same number. Mean and sd are over folds and
    repeats.
    """
    folds = group_folds(train)
    fitted = written(models(fold_rows(train, folds, False), features, ["fold"], **rules), "models")
    tests = fold_rows(train, folds, True)
    plans = F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.lit(r).alias("repeat")) for i in range(len(features)) for r in range(repeats))))
    drawn = tests.withColumn("plan", plans).select("*", "plan.feature", "plan.repeat").drop("plan")
    by = ["fold", "feature", "repeat"]
    value = F.element_at(F.array(*(F.col(f).cast("double") for f in features)), F.col("feature") + 1)
    plain, mixed = Window.partitionBy(*by).orderBy("row"), Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), "feature", "repeat", "row"), "row")
    drawn = drawn.withColumns({"i": F.row_number().over(plain), "j": F.row_number().over(mixed), "value": value})
    swapped = drawn.drop("j", "value").join(drawn.select(*by, F.col("j").alias("i"), F.col("value").alias("_new")), [*by, "i"])
    swapped = swapped.withColumns({f: F.when(F.col("feature") == i, F.col("_new")).otherwise(F.col(f).cast("double")) for i, f in enumerate(features)})
    moved = predicted(fitted, swapped, features, ["fold"], ["row", "y", "grp", "feature", "repeat"])
    kept = predicted(fitted, tests, features, ["fold"], ["row", "y", "grp"])
    base = V.accuracy(V.confusion(kept, "fold"), "fold").select("fold", F.col("balanced_accuracy").alias("base"))
    falls = V.accuracy(V.confusion(moved, *by), *by).join(base, "fold").withColumn("fall", F.col("base") - F.col("balanced_accuracy"))
    name = F.element_at(F.array(*map(F.lit, features)), F.col("feature") + 1).alias("feature")
    return falls.groupBy(name).agg(F.avg("fall").alias("importance"), F.stddev_pop("fall").alias("sd"))


def stratified_baseline(train: DataFrame, folds: DataFrame, seed: int = 0) -> DataFrame:
    """row, y, grp, fold and pred: a class drawn by a hash in proportion to the classes outside the row's fold."""
    per = train.join(folds, "row").groupBy("fold", "y").agg(F.count("*").alias("n"))
    # Classes by fold: a table of folds times classes, however many rows there are.
    rest = (per.select(F.col("fold").alias("held")).distinct().join(per, F.col("held") != F.col("fold")).groupBy("held", "y").agg(F.sum("n").alias("n")))
    mix = rest.groupBy(F.col("held").alias("fold")).agg(F.sort_array(F.collect_list(F.struct("y", "n"))).alias("mix"), F.sum("n").alias("total"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "row"), F.col("total"))
    picked = F.aggregate("mix", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("y")), lambda a, m: F.struct(
        (a["upto"] + m["n"]).alias("upto"), F.coalesce(a["y"], F.when(draw < a["upto"] + m["n"], m["y"])).alias("y")), lambda a: a["y"])
    return train.join(folds, "row").join(mix, "fold").select("row", "y", "grp", "fold", picked.alias("pred"))


def leakage_gap(train: DataFrame, features: Sequence[str], k: int = 5, seed: int = 0, **rules) -> DataFrame:
    """grouped, random and gap: balanced accuracies by held-out groups and by a random split of rows, which leaks, with the same model."""
    score = lambda folds, name: V.accuracy(V.confusion(out_of_fold(train, features, folds, **rules))).select(F.col("balanced_accuracy").alias(name))
    both = score(group_folds(train), "grouped").crossJoin(score(V.random_folds(train, k, seed), "random"))
    return both.withColumn("gap", F.col("random") - F.col("grouped"))
