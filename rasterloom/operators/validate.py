"""Validation statistics for per-window classifiers: folds, confusion, calibration, resampling, rules.

Predictions are a table with a label, a predicted class and a group. All figures
come from the table of confusion counts by group, which is small; the rows are
read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def abstained(df: DataFrame, probabilities: Sequence[str], *, least: float, margin: float, novelty: float = 0.001) -> DataFrame:
    """With top, margin and abstained: too low a top probability, too small a margin or too novel a row."""
    order = F.sort_array(F.array(*probabilities), asc=False)
    df = df.withColumn("top", order[0]).withColumn("margin", order[0] - order[1])
    return df.withColumn("abstained", (F.col("top") < least) | (F.col("margin") < margin) | F.coalesce(F.col("novelty_p") < novelty, F.lit(False)))


def confusion(df: DataFrame, *keys: str) -> DataFrame:
    """keys, y, pred and n."""
    return df.groupBy(*keys, "y", "pred").agg(F.count("*").alias("n"))


def accuracy(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, accuracy and balanced_accuracy (the mean recall of classes that occur) of confusion counts."""
    recall = counts.groupBy(*keys, "y").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    return recall.groupBy(*keys).agg((F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"))


def calibration(df: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """ece and mce over bins (lo, hi], the first closed below."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil(confidence * bins).cast("int") - 1))
    per = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(correct.cast("double")).alias("a"))
    gap = F.abs(F.col("c") - F.col("a"))
    return per.agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def tallies(train: DataFrame) -> DataFrame:
    """y, windows, annotations and groups."""
    return train.groupBy("y").agg(F.count("*").alias("windows"), F.countDistinct("ann").alias("annotations"), F.countDistinct("grp").alias("groups"))


def viability(train: DataFrame, *, windows: int = 30, annotations: int = 3, groups: int = 2, slides: int = 3, imbalance: float = 20.0) -> DataFrame:
    """rule and level (BLOCK or WARN) of each rule that the training set breaks, and its class, if it is about one."""
    per = tallies(train)
    found = per.select("y", F.explode(F.array_compact(F.array(
        F.when(F.col("windows") < windows, F.struct(F.lit("windows").alias("rule"), F.lit("BLOCK").alias("level"))),
        F.when(F.col("groups") < groups, F.struct(F.lit("groups").alias("rule"), F.lit("BLOCK").alias("level"))),
        F.when(F.col("annotations") < annotations, F.struct(F.lit("annotations").alias("rule"), F.lit("WARN").alias("level")))))).alias("x")).select("y", "x.*")
    whole = per.agg((F.max("windows") / F.min("windows")).alias("imbalance")).crossJoin(train.agg(F.countDistinct("grp").alias("slides")))
    rest = whole.select(F.lit(None).cast("long").alias("y"), F.explode(F.array_compact(F.array(
        F.when(F.col("imbalance") > imbalance, F.struct(F.lit("imbalance").alias("rule"), F.lit("BLOCK").alias("level"))),
        F.when(F.col("slides") < slides, F.struct(F.lit("slides").alias("rule"), F.lit("BLOCK").alias("level")))))).alias("x")).select("y", "x.*")
    return found.union(rest)


def verdict(broken: DataFrame, excluded: Column | int = 0) -> DataFrame:
    """One row: BLOCK if any rule blocks, WARN if any warns or a feature is excluded, else OK."""
    excluded = F.lit(excluded) if isinstance(excluded, int) else excluded
    counts = broken.agg(F.count_if(F.col("level") == "BLOCK").alias("blocks"), F.count_if(F.col("level") == "WARN").alias("warnings"))
    return counts.withColumn("verdict", F.when(F.col("blocks") > 0, "BLOCK").when((F.col("warnings") > 0) | (excluded > 0), "WARN").otherwise("OK"))


def leave_one_group_out(train: DataFrame) -> DataFrame:
    """fold, row and is_test: each group is tested once. As many copies of the rows as groups."""
    folds = train.select(F.col("grp").alias("held")).distinct().withColumn("fold", F.row_number().over(Window.orderBy("held")) - 1)
    return train.join(F.broadcast(folds)).select("fold", "row", (F.col("grp") == F.col("held")).alias("is_test"))


def grouped_folds(train: DataFrame, k: int) -> DataFrame:
    """grp and fold: groups, largest first, each to the lightest fold. Groups come to the driver; rows do not."""
    sizes = train.groupBy("grp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "grp").collect()
    load, placed = [0] * k, []
    for r in sizes:
        fold = min(range(k), key=lambda j: (load[j], j))
        load[fold] += r["n"]
        placed.append((r["grp"], fold))
    return train.sparkSession.createDataFrame(placed, "grp long, fold int")


def random_folds(train: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """row and fold by a hash: rows of a group are parted, so that this split leaks; for diagnosis only."""
    return train.select("row", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(k)).cast("int").alias("fold"))


def majority_by_group(train: DataFrame) -> DataFrame:
    """row, y, grp and pred: the most frequent class (the smallest of equals) of all other groups."""
    per = train.groupBy("grp", "y").agg(F.count("*").alias("n"))
    whole = per.groupBy("y").agg(F.sum("n").alias("total"))
    groups = per.select("grp").distinct()
    rest = (groups.join(F.broadcast(whole)).join(per, ["grp", "y"], "left").select("grp", "y", (F.col("total") - F.coalesce("n", F.lit(0))).alias("n")))
    best = rest.groupBy("grp").agg(F.max(F.struct(F.col("n"), (-F.col("y")).alias("m")))["m"].alias("m")).select("grp", (-F.col("m")).alias("pred"))
    return train.join(best, "grp").select("row", "y", "grp", "pred")


def cross_validate(train: DataFrame, features: Sequence[str], fit_predict, folds: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """row, y, grp, fold and pred of each row by a model of one's own that did not see its fold.

    ``fit_predict(x_train, y_train, x_test)`` gets and gives numpy arrays and
    runs once a fold, on the executor that has it; ``folds`` is (grp, fold). A
    model of one's own needs its training rows together, so that a table of more
    than ``most_rows`` is refused.
    """
    import pandas as pd
    if train.count() > most_rows:
        raise ValueError(f"more than {most_rows} rows; fit a distributed model instead")
    own = train.join(folds, "grp").select("row", "y", "grp", "fold", *features)
    held = folds.select(F.col("fold").alias("held")).distinct()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        test = part["fold"] == part["held"]
        names = list(features)
        pred = fit_predict(part.loc[~test, names].to_numpy(), part.loc[~test, "y"].to_numpy(), part.loc[test, names].to_numpy())
        return part.loc[test, ["row", "y", "grp", "fold"]].assign(pred=pred)

    return own.join(F.broadcast(held)).groupBy("held").applyInPandas(run, "row long, y long, grp long, fold int, pred long")


def excluded_features(train: DataFrame, features: Sequence[str], most_missing: float = 0.2) -> DataFrame:
    """feature and reason: all missing, too many missing, constant, or an affine copy of an earlier feature that is kept.

    Two features are copies if, stretched to [0, 1] and rounded to six places
    (either way up), they agree in every row, which their summed hashes tell.
    """
    order = {f: i for i, f in enumerate(features)}
    ends = train.agg(*(F.min(f).alias(f"lo_{f}") for f in features), *(F.max(f).alias(f"hi_{f}") for f in features),
                     *(F.count(f).alias(f"n_{f}") for f in features), F.count("*").alias("rows"))
    spread = train.join(F.broadcast(ends))
    sums = []
    for f in features:
        unit = F.round(F.try_divide(F.col(f) - F.col(f"lo_{f}"), F.col(f"hi_{f}") - F.col(f"lo_{f}")), 6)
        code = lambda v: F.sum(F.pmod(F.xxhash64("row", F.coalesce(v + 0.0, F.lit(-1.0))), F.lit(1_000_000_007)))
        sums.append(F.least(code(unit), code(F.round(1 - unit, 6))).alias(f"code_{f}"))
    codes = spread.agg(*sums).crossJoin(ends)
    long = codes.select(F.explode(F.array(*(F.struct(F.lit(order[f]).alias("i"), F.lit(f).alias("feature"), F.col(f"code_{f}").alias("code"),
                                                     F.col(f"lo_{f}").cast("double").alias("lo"), F.col(f"hi_{f}").cast("double").alias("hi"),
                                                     F.col(f"n_{f}").alias("n"), F.col("rows").alias("rows")) for f in features))).alias("x")).select("x.*")
    own = (F.when(F.col("n") == 0, "all missing").when(F.col("n") < (1 - most_missing) * F.col("rows"), "too many missing")
           .when(F.col("lo") == F.col("hi"), "constant"))
    judged = long.withColumn("own", own)
    first = Window.partitionBy("code").orderBy("i")
    judged = judged.withColumn("nth", F.when(F.col("own").isNull(), F.sum(F.col("own").isNull().cast("int")).over(first)))
    return judged.withColumn("reason", F.coalesce("own", F.when(F.col("nth") > 1, "copy"))).where("reason IS NOT NULL").select("feature", "reason")


def bootstrap(counts: DataFrame, picks: DataFrame, level: float = 0.95) -> DataFrame:
    """lo and hi of the balanced accuracy over resampled groups: ``picks`` (b, grp, times) says how often each is drawn."""
    drawn = counts.join(picks, "grp").groupBy("b", "y", "pred").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    tail = (1 - level) / 2
    return accuracy(drawn, "b").agg(F.percentile("balanced_accuracy", F.lit(tail)).alias("lo"), F.percentile("balanced_accuracy", F.lit(1 - tail)).alias("hi"))


def permutation_p(observed: DataFrame, permuted: DataFrame) -> DataFrame:
    """p: (1 + permutations at least as good) / (1 + permutations); never 0."""
    return permuted.join(F.broadcast(observed.select(F.col("balanced_accuracy").alias("seen")))).agg(
        ((F.count_if(F.col("balanced_accuracy") >= F.col("seen") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))


def risk_coverage(df: DataFrame, confidence: Column, correct: Column, tie: str) -> DataFrame:
    """k, coverage and risk of the k most confident rows, in steps of equal rank sums.

    Rows are counted by confidence first; only the different confidences are put
    in order in one task. Rows of equal confidence come together.
    """
    per = df.groupBy(confidence.alias("confidence")).agg(F.count("*").alias("n"), F.count_if(~correct).alias("wrong"))
    down = Window.orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    run = per.select("confidence", F.sum("n").over(down).alias("k"), F.sum("wrong").over(down).alias("wrong"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return run.select("confidence", "k", (F.col("k") / F.col("all")).alias("coverage"), (F.col("wrong") / F.col("k")).alias("risk"))


def best_threshold(curve: DataFrame, most_risk: float) -> DataFrame:
    """The lowest confidence whose risk is small enough."""
    return curve.where(F.col("risk") <= most_risk).agg(F.min("confidence").alias("threshold"), F.max("coverage").alias("coverage"))


def single_feature(train: DataFrame, features: Sequence[str], quantiles: int = 19) -> DataFrame:
    """feature, cut, low, high and accuracy of the best rule of one threshold: class low at or below the cut, high above it.

    Cuts are quantiles of each feature; counts by feature, cut, side and class
    are summed once, and the classes of the sides follow from them.
    """
    shares = [(k + 1) / (quantiles + 1) for k in range(quantiles)]
    cuts = train.agg(*(F.percentile(f, F.array(*map(F.lit, shares))).alias(f"cut_{f}") for f in features))
    long = train.join(F.broadcast(cuts)).select("y", F.explode(F.array(*(
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v"), F.col(f"cut_{f}").alias("cuts")) for f in features))).alias("x"))
    rows = long.select("y", "x.feature", "x.v", F.explode("x.cuts").alias("cut"))
    per = rows.groupBy("feature", "cut", (F.col("v") > F.col("cut")).alias("above"), "y").agg(F.count("*").alias("n"))
    side = per.groupBy("feature", "cut", "above").agg(F.max(F.struct("n", (-F.col("y")).alias("m"))).alias("best"), F.sum("n").alias("all"))
    rule = side.groupBy("feature", "cut").agg(
        F.max(F.when(~F.col("above"), -F.col("best.m"))).alias("low"), F.max(F.when(F.col("above"), -F.col("best.m"))).alias("high"),
        (F.sum("best.n") / F.sum("all")).alias("accuracy"))
    return rule.orderBy(F.desc("accuracy"), "feature", "cut").limit(1)


def importances(counts: DataFrame, permuted: DataFrame) -> DataFrame:
    """feature and importance: the fall in balanced accuracy when it is permuted (mean over repeats), most first."""
    base = accuracy(counts).select(F.col("balanced_accuracy").alias("base"))
    return (accuracy(permuted, "feature", "repeat").join(F.broadcast(base)).groupBy("feature")
            .agg(F.avg(F.col("base") - F.col("balanced_accuracy")).alias("importance")).orderBy(F.desc("importance"), "feature"))


def compatible(model: dict, run: dict) -> tuple[list[str], list[str]]:
    """What forbids and what only warns of applying a model: names in their exact order, pixel size, window and segmentation; stride."""
    hard, soft = [], []
    if model["features"] != run["features"]:
        missing = [f for f in model["features"] if f not in run["features"]]
        extra = [f for f in run["features"] if f not in model["features"]]
        hard.append(f"features: missing {missing}, unexpected {extra}" if missing or extra else "features: other order")
    if max(model["pixel_um"], run["pixel_um"]) > 1.02 * min(model["pixel_um"], run["pixel_um"]):
        hard.append("pixel_um")
    for name in ("window_um", "segmentation"):
        if model[name] != run[name]:
            hard.append(name)
    if model["stride_um"] != run["stride_um"]:
        soft.append("stride_um")
    return hard, soft


def train_verdict(stats: DataFrame) -> DataFrame:
    """With refusals: why a trained model is refused, comma-joined.

    ``stats`` has ci_lo, majority, p, permutations, accuracy, best_feature, worst_group, chance and ece.
    """
    rules = [("interval covers majority", F.col("ci_lo") <= F.col("majority")), ("p above 0.05", F.col("p") > 0.05),
             ("too few permutations", 1 / (F.col("permutations") + 1) > 0.05), ("no gain over one feature", F.col("accuracy") <= F.col("best_feature")),
             ("a group below chance", F.col("worst_group") < F.col("chance")), ("calibration", F.col("ece") > 0.15)]
    return stats.withColumn("refusals", F.array_join(F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules))), ","))
