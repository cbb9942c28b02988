"""Queries of validation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as G
from ..operators import validate as V
from ..sources import bindings as B
from ..sources.shared import written
from .registry import query
from .views import PRED, TRAIN

col = F.col
PROBS = [f"p{k}" for k in range(5)]
ACC = "SELECT {k} sum(hit) / sum(n)::DOUBLE AS accuracy, avg(hit / n::DOUBLE) AS balanced_accuracy FROM (SELECT {k} y, sum(n) AS n, sum(CASE WHEN y = pred THEN n ELSE 0 END) AS hit FROM {t} GROUP BY {k} y) {g}"


def acc(table, keys=""):
    return ACC.format(k=keys + "," if keys else "", t=table, g=f"GROUP BY {keys}" if keys else "")


@query("a11_confusion", f"WITH {PRED} SELECT y, pred, count(*) AS n FROM pred GROUP BY ALL")
def confusion(spark, d):
    return V.confusion(B.predictions(spark, d))


@query("k12_confusion_matrix", f"""WITH {PRED} SELECT y, {", ".join(f"count_if(pred = {k})::BIGINT AS pred_{k}" for k in range(5))} FROM pred GROUP BY y""")
def confusion_matrix(spark, d):
    wide = B.predictions(spark, d).groupBy("y").pivot("pred", list(range(5))).count().na.fill(0)
    return wide.select("y", *(col(str(k)).alias(f"pred_{k}") for k in range(5)))


@query("a12_balanced_accuracy", f"WITH {PRED}, c AS (SELECT y, pred, count(*) AS n FROM pred GROUP BY ALL) SELECT round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy FROM ({acc('c')})")
def balanced_accuracy(spark, d):
    return V.accuracy(V.confusion(B.predictions(spark, d))).select(F.round("accuracy", 6).alias("accuracy"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query("a13_calibration_error", f"""WITH {PRED}, c AS (SELECT greatest(p0, p1, p2, p3, p4) AS conf, y = pred AS ok FROM pred),
b AS (SELECT greatest(0, least(9, ceil(conf * 10)::INT - 1)) AS bin, count(*) AS n, abs(avg(conf) - avg(ok::INT)) AS gap FROM c GROUP BY 1)
SELECT round(sum(gap * n) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM b""")
def calibration_error(spark, d):
    found = V.calibration(B.predictions(spark, d), F.greatest(*PROBS), col("y") == col("pred"))
    return found.select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


@query("v24_calibration_note", f"""WITH {PRED}, c AS (SELECT greatest(p0, p1, p2, p3, p4) AS conf, y = pred AS ok FROM pred),
b AS (SELECT greatest(0, least(9, ceil(conf * 10)::INT - 1)) AS bin, count(*) AS n, abs(avg(conf) - avg(ok::INT)) AS gap FROM c GROUP BY 1)
SELECT CASE WHEN sum(gap * n) / sum(n) IS NULL THEN 'undefined' WHEN sum(gap * n) / sum(n) > 0.15 THEN 'poorly calibrated' ELSE 'calibrated' END AS note FROM b""")
def calibration_note(spark, d):
    found = V.calibration(B.predictions(spark, d), F.greatest(*PROBS), col("y") == col("pred"))
    return found.select(F.when(col("ece").isNull(), "undefined").when(col("ece") > 0.15, "poorly calibrated").otherwise("calibrated").alias("note"))


@query("a14_class_tallies", f"WITH {TRAIN} SELECT y, count(*) AS windows, count(DISTINCT ann) AS annotations, count(DISTINCT grp) AS groups FROM train GROUP BY y")
def class_tallies(spark, d):
    return V.tallies(B.training(spark, d))


@query("v01_leave_one_group_out", f"""WITH {TRAIN}, f AS (SELECT held, row_number() OVER (ORDER BY held) - 1 AS fold FROM (SELECT DISTINCT grp AS held FROM train))
SELECT fold::BIGINT AS fold, count(*) AS n, count_if(grp = held)::BIGINT AS n_test, sum(CASE WHEN grp = held THEN row ELSE 0 END)::BIGINT AS test_rows FROM train, f GROUP BY fold""")
def leave_one_group_out(spark, d):
    folds = V.leave_one_group_out(B.training(spark, d))
    return folds.groupBy(col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"), F.sum(F.when(col("is_test"), col("row")).otherwise(0)).alias("test_rows"))


@query("v02_grouped_folds")
def grouped_folds(spark, d):
    return V.grouped_folds(B.training(spark, d), 3)


@query("v03_random_split")
def random_split(spark, d):
    return V.random_folds(B.training(spark, d), 4)


@query("v04_viability", f"""WITH {TRAIN}, t AS (SELECT y, count(*) AS w, count(DISTINCT ann) AS a, count(DISTINCT grp) AS g FROM train GROUP BY y)
SELECT y, 'windows' AS rule, 'BLOCK' AS level FROM t WHERE w < 310 UNION ALL SELECT y, 'groups', 'BLOCK' FROM t WHERE g < 2
UNION ALL SELECT y, 'annotations', 'WARN' FROM t WHERE a < 3 UNION ALL SELECT NULL, 'imbalance', 'BLOCK' FROM t HAVING max(w) / min(w)::DOUBLE > 1.05::DOUBLE
UNION ALL SELECT NULL, 'slides', 'BLOCK' FROM train HAVING count(DISTINCT grp) < 3""")
def viability(spark, d):
    return V.viability(B.training(spark, d), windows=310, imbalance=1.05)


@query("v23_verdict", f"""WITH {TRAIN}, t AS (SELECT y, count(*) AS w, count(DISTINCT ann) AS a, count(DISTINCT grp) AS g FROM train GROUP BY y)
SELECT CASE WHEN (SELECT count(*) FROM t WHERE w < 310 OR g < 2) > 0 THEN 'BLOCK' WHEN (SELECT count(*) FROM t WHERE a < 3) > 0 THEN 'WARN' ELSE 'OK' END AS verdict""")
def verdict(spark, d):
    return V.verdict(V.viability(B.training(spark, d), windows=310)).select("verdict")


@query("v05_feature_exclusion", "SELECT * FROM (VALUES ('f5', 'constant'), ('f6', 'copy'), ('f7', 'all missing'), ('f8', 'too many missing')) AS t(feature, reason)")
def feature_exclusion(spark, d):
    t = B.training(spark, d).withColumns({"f5": F.lit(1.0), "f6": 3 - 2 * col("f3"), "f7": F.lit(None).cast("double"), "f8": F.when(col("row") % 2 == 0, col("f1"))})
    return V.excluded_features(t, ["f1", "f2", "f3", "f5", "f6", "f7", "f8"])


MAJORITY = """g AS (SELECT DISTINCT grp FROM train), per AS (SELECT grp, y, count(*) AS n FROM train GROUP BY ALL),
rest AS (SELECT g.grp, p.y, sum(p.n) AS n FROM g JOIN per p ON p.grp <> g.grp GROUP BY ALL),
maj AS (SELECT grp, y AS pred FROM rest QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, y) = 1)"""


@query("v06_cross_validate_baseline", f"""WITH {TRAIN}, {MAJORITY}, c AS (SELECT t.grp, t.y, m.pred, count(*) AS n FROM train t JOIN maj m USING (grp) GROUP BY ALL)
SELECT grp, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy FROM ({acc('c', 'grp')})""")
def cross_validate_baseline(spark, d):
    counts = V.confusion(V.majority_by_group(B.training(spark, d)), "grp")
    return V.accuracy(counts, "grp").select("grp", F.round("accuracy", 6).alias("accuracy"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query("v07_cluster_bootstrap", f"""WITH {PRED}, c AS (SELECT grp, y, pred, count(*) AS n FROM pred GROUP BY ALL),
picks AS (SELECT b, grp, (b * 7 + grp * 5 + b * grp) % 3 AS times FROM unnest(range(200)) AS t(b), (SELECT DISTINCT grp FROM pred)),
dr AS (SELECT b, y, pred, sum(n * times) AS n FROM c JOIN picks USING (grp) WHERE times > 0 GROUP BY ALL)
SELECT round(quantile_cont(balanced_accuracy, 0.025), 6) AS lo, round(quantile_cont(balanced_accuracy, 0.975), 6) AS hi FROM ({acc('dr', 'b')})""")
def cluster_bootstrap(spark, d):
    """200 resamples of groups; the draws are a fixed table, so that both engines see the same."""
    p = B.predictions(spark, d)
    picks = (spark.range(200).withColumnRenamed("id", "b").join(p.select("grp").distinct())
             .withColumn("times", (col("b") * 7 + col("grp") * 5 + col("b") * col("grp")) % 3).where("times > 0"))
    return V.bootstrap(V.confusion(p, "grp"), picks).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("v08_permutation_null", f"""WITH {PRED}, obs AS ({acc('(SELECT y, pred, count(*) AS n FROM pred GROUP BY ALL)')}),
pm AS (SELECT b, (y + b * (ann % 5 + 1)) % 5 AS y, pred, count(*) AS n FROM pred, unnest(range(1, 60)) AS t(b) GROUP BY ALL)
SELECT round((1 + count_if(p.balanced_accuracy >= o.balanced_accuracy - 1e-12)) / (1 + count(*))::DOUBLE, 6) AS p FROM ({acc('pm', 'b')}) p, obs o""")
def permutation_null(spark, d):
    """Labels shifted annotation by annotation, by a fixed table of shifts."""
    p = B.predictions(spark, d)
    shifts = spark.range(1, 60).withColumnRenamed("id", "b")
    moved = p.join(F.broadcast(shifts)).withColumn("y", (col("y") + col("b") * (col("ann") % 5 + 1)) % 5)
    return V.permutation_p(V.accuracy(V.confusion(p)), V.accuracy(V.confusion(moved, "b"), "b")).select(F.round("p", 6).alias("p"))


@query("v09_leakage_gap")
def leakage_gap(spark, d):
    """Accuracy of the majority by random fold less that by group."""
    t = B.training(spark, d)
    by_random = t.drop("grp").join(V.random_folds(t, 8).withColumnRenamed("fold", "grp"), "row")
    a = V.accuracy(V.confusion(V.majority_by_group(by_random))).select(col("accuracy").alias("random_accuracy"))
    b = V.accuracy(V.confusion(V.majority_by_group(t))).select(col("accuracy").alias("grouped_accuracy"))
    return a.crossJoin(b).withColumn("gap", col("random_accuracy") - col("grouped_accuracy"))


@query("v10_baseline_majority", f"WITH {TRAIN} SELECT y AS majority, round(n / (SELECT count(*) FROM train)::DOUBLE, 6) AS accuracy FROM (SELECT y, count(*) AS n FROM train GROUP BY y) ORDER BY n DESC, y LIMIT 1")
def baseline_majority(spark, d):
    per = B.training(spark, d).groupBy("y").agg(F.count("*").alias("n"))
    return per.agg((-F.max(F.struct("n", (-col("y")).alias("m")))["m"]).alias("majority"), F.round(F.max("n") / F.sum("n"), 6).alias("accuracy"))


@query("v10_baseline_single_feature", f"""WITH {TRAIN}, long AS (SELECT y, feature, v FROM train, LATERAL (VALUES ('f1', f1), ('f2', f2), ('f3', f3)) AS x(feature, v)),
cuts AS (SELECT feature, unnest(quantile_cont(v, [{', '.join(str(k / 20) for k in range(1, 20))}])) AS cut FROM long GROUP BY feature),
per AS (SELECT feature, cut, v > cut AS above, y, count(*) AS n FROM long JOIN (SELECT DISTINCT * FROM cuts) USING (feature) GROUP BY ALL),
side AS (SELECT feature, cut, above, max(n) AS n, sum(n) AS m FROM per GROUP BY ALL)
SELECT round(max(a), 6) AS accuracy FROM (SELECT sum(n) / sum(m)::DOUBLE AS a FROM side GROUP BY feature, cut)""")
def baseline_single_feature(spark, d):
    return V.single_feature(B.training(spark, d), ["f1", "f2", "f3"]).select(F.round("accuracy", 6).alias("accuracy"))


@query("v11_importance", f"""WITH {PRED}, base AS ({acc('(SELECT y, pred, count(*) AS n FROM pred GROUP BY ALL)')}),
pm AS (SELECT feature, repeat, y, (pred + row * feature + repeat) % 5 AS pred, count(*) AS n FROM pred, unnest(range(1, 4)) AS a(feature), unnest(range(5)) AS b(repeat) GROUP BY ALL)
SELECT feature::BIGINT AS feature, round(avg(b.balanced_accuracy - p.balanced_accuracy), 6) AS importance FROM ({acc('pm', 'feature, repeat')}) p, base b GROUP BY feature""")
def importance(spark, d):
    """The fall in accuracy under fixed permutations of the predictions, one for each feature and repeat."""
    p = B.predictions(spark, d)
    grid = spark.range(1, 4).withColumnRenamed("id", "feature").crossJoin(spark.range(5).withColumnRenamed("id", "repeat"))
    moved = p.join(F.broadcast(grid)).withColumn("pred", (col("pred") + col("row") * col("feature") + col("repeat")) % 5)
    return V.importances(V.confusion(p), V.confusion(moved, "feature", "repeat")).select("feature", F.round("importance", 6).alias("importance"))


CURVE = PRED + """, c AS (SELECT round(greatest(p0, p1, p2, p3, p4), 6) AS confidence, y = pred AS ok FROM pred),
s AS (SELECT confidence, count(*) AS n, count_if(NOT ok) AS w FROM c GROUP BY 1),
curve AS (SELECT confidence, sum(n) OVER d AS k, sum(w) OVER d / sum(n) OVER d::DOUBLE AS risk, sum(n) OVER d / sum(n) OVER ()::DOUBLE AS coverage FROM s WINDOW d AS (ORDER BY confidence DESC))"""


def _curve(spark, d):
    return V.risk_coverage(B.predictions(spark, d), F.round(F.greatest(*PROBS), 6), col("y") == col("pred"), "row")


@query("v12_risk_coverage", f"WITH {CURVE} SELECT confidence, k::BIGINT AS k, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM curve")
def risk_coverage(spark, d):
    return _curve(spark, d).select("confidence", "k", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@query("v12_threshold_search", f"WITH {CURVE} SELECT min(confidence) AS threshold, round(max(coverage), 6) AS coverage FROM curve WHERE risk <= 0.8::DOUBLE")
def threshold_search(spark, d):
    return V.best_threshold(_curve(spark, d), 0.8).select("threshold", F.round("coverage", 6).alias("coverage"))


@query("v16_compatibility", "SELECT * FROM (VALUES ('hard', 'features: other order'), ('hard', 'pixel_um'), ('soft', 'stride_um')) AS t(kind, reason)")
def compatibility(spark, d):
    model = {"features": ["f1", "f2", "f3"], "pixel_um": 0.5, "window_um": 15.0, "stride_um": 7.5, "segmentation": "abc"}
    hard, soft = V.compatible(model, model | {"features": ["f2", "f1", "f3"], "pixel_um": 0.52, "stride_um": 15.0})
    return spark.createDataFrame([("hard", r) for r in hard] + [("soft", r) for r in soft], "kind string, reason string")


@query("v17_train_verdict", f"""WITH {PRED}, c AS (SELECT grp, y, pred, count(*) AS n FROM pred GROUP BY ALL)
SELECT 'interval covers majority,no gain over one feature' || CASE WHEN min(accuracy) < 0.2::DOUBLE THEN ',a group below chance' ELSE '' END AS refusals FROM ({acc('c', 'grp')})""")
def train_verdict(spark, d):
    groups = V.accuracy(V.confusion(B.predictions(spark, d), "grp"), "grp").agg(F.min("accuracy").alias("worst_group"))
    stats = groups.withColumns({"ci_lo": F.lit(0.15), "majority": F.lit(0.22), "p": F.lit(0.01), "permutations": F.lit(200), "accuracy": F.lit(0.2), "best_feature": F.lit(0.23), "chance": F.lit(0.2), "ece": F.lit(0.1)})
    return V.train_verdict(stats).select("refusals")


@query("v19_probability_channels", f"""WITH {PRED}, s AS (SELECT *, list_reverse_sort([p0, p1, p2, p3, p4]) AS o FROM pred)
SELECT row, {", ".join(f"round(p{k}, 6) AS p{k}" for k in range(5))}, CASE WHEN o[1] - o[2] >= 0.05::DOUBLE THEN list_position([p0, p1, p2, p3, p4], o[1])::BIGINT - 1 END AS class FROM s""")
def probability_channels(spark, d):
    """Probability channels, and the class where the classifier did not abstain; it is never averaged."""
    p = V.abstained(B.predictions(spark, d), PROBS, least=0.0, margin=0.05, novelty=0.0)
    winner = F.array_position(F.array(*PROBS), col("top")) - 1
    return p.select("row", *(F.round(x, 6).alias(x) for x in PROBS), F.when(~col("abstained"), winner).alias("class"))


@query("v20_training_rows", f"""WITH {TRAIN}, m AS (SELECT grp, max(ann) + 1 AS n FROM train WHERE f1 > 0 GROUP BY grp),
o AS (SELECT grp, coalesce(sum(n) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM m)
SELECT row, y, grp, ann + first AS ann FROM train JOIN o USING (grp) WHERE f1 > 0""")
def training_rows(spark, d):
    """Labelled rows that are not partial, with annotation ids offset image by image."""
    from pyspark.sql import Window
    t = B.training(spark, d).where("f1 > 0")
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    first = t.groupBy("grp").agg((F.max("ann") + 1).alias("n")).select("grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return t.join(first, "grp").select("row", "y", "grp", (col("ann") + col("first")).alias("ann"))


@query("v21_preflight", f"""WITH {TRAIN} SELECT y, sum(floor(f3 / 225.0::DOUBLE))::BIGINT AS cores, sum(floor(f3 / 225.0::DOUBLE)) < 30 AS too_few FROM train WHERE f3 > 0 GROUP BY y""")
def preflight(spark, d):
    """Upper bounds of the cores that each class's area holds."""
    return (B.training(spark, d).where("f3 > 0").groupBy("y").agg(F.sum(F.floor(col("f3") / 225.0)).cast("long").alias("cores"))
            .withColumn("too_few", col("cores") < 30))


@query("v22_out_of_fold_probabilities", f"""WITH {TRAIN}, r AS (SELECT a.grp, b.y, count(*) AS n FROM (SELECT DISTINCT grp FROM train) a JOIN train b ON b.grp <> a.grp GROUP BY ALL)
SELECT grp, y, round(n / sum(n) OVER (PARTITION BY grp)::DOUBLE, 6) AS p FROM r""")
def out_of_fold_probabilities(spark, d):
    """Class shares outside each group, which a prior-only model predicts inside it."""
    from pyspark.sql import Window
    per = B.training(spark, d).groupBy("grp", "y").agg(F.count("*").alias("n"))
    whole = per.groupBy("y").agg(F.sum("n").alias("total"))
    rest = (per.select("grp").distinct().join(F.broadcast(whole)).join(per, ["grp", "y"], "left").select("grp", "y", (col("total") - F.coalesce("n", F.lit(0))).alias("n")))
    return rest.select("grp", "y", F.round(col("n") / F.sum("n").over(Window.partitionBy("grp")), 6).alias("p"))


@query("j17_class_columns", f"WITH {PRED} SELECT row, round(p0, 6) AS class_0, round(p1, 6) AS class_1, 0.0::DOUBLE AS class_2, round(p3, 6) AS class_3 FROM pred")
def class_columns(spark, d):
    """Probabilities by global class number; a class that the model has not seen gets 0."""
    local = {0: "p0", 1: "p1", 3: "p3"}
    return B.predictions(spark, d).select("row", *((F.round(local[k], 6) if k in local else F.lit(0.0)).alias(f"class_{k}") for k in range(4)))


@query("k15_classified_detections", f"""WITH {PRED}, s AS (SELECT *, list_reverse_sort([p0, p1, p2, p3, p4]) AS o FROM pred)
SELECT row, CASE WHEN o[1] < 0.3::DOUBLE THEN NULL ELSE 'class_' || (list_position([p0, p1, p2, p3, p4], o[1]) - 1) END AS name, round(o[1], 6) AS top, round(o[1] - o[2], 6) AS margin FROM s""")
def classified_detections(spark, d):
    """Class, probability and margin of each core; an abstained one stays unclassified with its numbers."""
    p = V.abstained(B.predictions(spark, d), PROBS, least=0.3, margin=0.0, novelty=0.0)
    name = F.concat(F.lit("class_"), (F.array_position(F.array(*PROBS), col("top")) - 1).cast("string"))
    return p.select("row", F.when(col("top") >= 0.3, name).alias("name"), F.round("top", 6).alias("top"), F.round("margin", 6).alias("margin"))


FEATURES = ["f1", "f2", "f3"]
#: Rounds and leaves of the many fits of a validation; a model to keep has 200 rounds and 31 leaves.
BRIEF = {"rounds": 10, "leaves": 15}


@query("v15_histogram_boosting")
def histogram_boosting(spark, d):
    """Predicted by labelled class out of fold, of models of 200 rounds and 31 leaves."""
    found = G.out_of_fold(B.training(spark, d), FEATURES, G.group_folds(B.training(spark, d)))
    return V.confusion(found)


@query("v08_permutation_refit")
def permutation_refit(spark, d):
    """p of the cross-validated model against models fitted anew to permuted labels."""
    scores = written(G.permutation_null(B.training(spark, d), FEATURES, 19, **BRIEF), "scores")
    return V.permutation_p(scores.where("b = 0"), scores.where("b > 0"))


@query("v11_permutation_importance")
def permutation_importance(spark, d):
    return G.permutation_importance(B.training(spark, d), FEATURES, 5, **BRIEF)


@query("v09_leakage_gap_refit")
def leakage_gap_refit(spark, d):
    return G.leakage_gap(B.training(spark, d), FEATURES, 5, **BRIEF)


@query("v10_baseline_stratified")
def baseline_stratified(spark, d):
    t = B.training(spark, d)
    return V.accuracy(V.confusion(G.stratified_baseline(t, G.group_folds(t)))).select("accuracy", "balanced_accuracy")


@query("v22_boosting_probabilities")
def boosting_probabilities(spark, d):
    t = B.training(spark, d)
    found = G.out_of_fold(t, FEATURES, G.group_folds(t), **BRIEF)
    return found.select("row", "grp", "y", "pred", *(F.get("proba", F.lit(k)).alias(f"p{k}") for k in range(5)))


@query("v17_train_verdict_computed")
def train_verdict_computed(spark, d):
    """Refusals and what they rest on, all computed from one table of out-of-fold predictions, its permutations and the baselines."""
    t = B.training(spark, d)
    folds = G.group_folds(t)
    tables = written(G.out_of_fold(G.permuted_labels(t, 19), FEATURES, folds, ["b"], **BRIEF), "predictions")
    own = tables.where("b = 0")
    counts = written(V.confusion(own, "grp"), "counts")
    # 200 resamples of the groups, drawn by a hash.
    drawn = spark.range(200).withColumnRenamed("id", "b").crossJoin(counts.select("grp").distinct().agg(F.sort_array(F.collect_list("grp")).alias("groups")))
    drawn = drawn.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("groups") - 1)))
    picks = drawn.groupBy("b", F.get("groups", F.pmod(F.xxhash64("b", "i"), F.size("groups")).cast("int")).alias("grp")).agg(F.count("*").alias("times"))
    scores = V.accuracy(V.confusion(tables, "b"), "b")
    one = V.accuracy(counts).select(col("balanced_accuracy").alias("accuracy"))
    for part in (V.bootstrap(counts, picks).select(col("lo").alias("ci_lo")),
                 V.accuracy(V.confusion(V.majority_by_group(t))).select(col("balanced_accuracy").alias("majority")),
                 V.permutation_p(scores.where("b = 0"), scores.where("b > 0")), V.single_feature(t, FEATURES).select(col("accuracy").alias("best_feature")),
                 V.accuracy(counts, "grp").agg(F.min("balanced_accuracy").alias("worst_group")), t.agg((1 / F.countDistinct("y")).alias("chance")),
                 V.calibration(own, F.array_max("proba"), col("y") == col("pred")).select("ece")):
        one = one.crossJoin(part)
    return V.train_verdict(one.withColumn("permutations", F.lit(19)))
