"""Mixing sources to target weights along a curriculum.

Each source has a weight that changes over training time (0 to 1). The integral
of its schedule is its cumulative demand for words. A document copy stands at
some number of words of its source's stream; inverting the demand at that
number gives the time at which training reads it. Documents are then sorted by
that position in ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Weight factors at the times of a schedule, by a source's rank in turn: falling, level and rising shares.
SCHEDULES = (((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)))
#: Sources up to which their table is broadcast (some 200 bytes each); more are joined by shuffling.
MOST_BROADCAST = 50_000


def demand_segments(schedule: Sequence[tuple[float, float]]) -> Column:
    """The pieces of a piecewise-linear schedule with their shares of its integral before them and through them."""
    areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(schedule, schedule[1:])]
    if len(schedule) < 2 or min(areas) < 0 or sum(areas) <= 0 or (schedule[0][0], schedule[-1][0]) != (0, 1):
        raise ValueError("a schedule goes from time 0 to 1 and has a positive integral")
    whole, pieces, before = sum(areas), [], 0.0
    for ((t0, a), (t1, b)), area in zip(zip(schedule, schedule[1:]), areas):
        pieces.append(F.struct(*(F.lit(float(v)).alias(n) for n, v in (
            ("t0", t0), ("t1", t1), ("w0", a), ("w1", b), ("area", area / whole), ("c0", before)))))
        before += area / whole
    return F.array(*pieces)


def time_of(share: Column, segments: Column) -> Column:
    """The time at which the schedule's integral reaches this share of its whole."""
    here = F.coalesce(F.try_element_at(F.filter(segments, lambda s: share < s["c0"] + s["area"]), F.lit(1)),
                      F.element_at(segments, -1))
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(share - here["c0"], here["area"])))
    a, b = here["w0"], here["w1"]
    # The root of a x + (b - a) x^2 / 2 = u (a + b) / 2 in a form that also holds for a = b.
    x = F.try_divide(u * (a + b), a + F.sqrt(a * a + (b * b - a * a) * u))
    return here["t0"] + (here["t1"] - here["t0"]) * F.coalesce(x, F.lit(0.0))


def sized(docs: DataFrame) -> DataFrame:
    """The documents with their number of words as ``size`` and an even, repeatable draw as ``draw``."""
    return (docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(common.BLANK_WORD)), F.lit(0)).cast("long"))
            .withColumn("key", F.xxhash64("source", "text"))
            .withColumn("draw", F.xxhash64(F.lit("mix"), "doc_id", "key")))


def targets(sizes: DataFrame, weights: Sequence[float], most_times: float) -> DataFrame:
    """source, rank, source_size and target of each source of ``sizes(source, size)``.

    Sources by code point, null last, have the weights in turn. Targets share
    the sum of all sizes by weight; none is above ``most_times`` its source's
    size, and what is above goes to the others by weight: with the sources in
    order of size / weight, the first ones are held, and the level of the rest
    follows from the sums on either side. One row per source is ordered in one
    task; documents are not.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy("need", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
              .withColumn("rank", F.row_number().over(by_code) - 1)
              .withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int")))
              .withColumn("most", F.col("source_size") * most_times)
              .withColumn("need", F.col("most") / F.col("weight")))
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(by_need), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_need), F.lit(0.0))))
    # The level if this source and all after it are not held; the first source whose need reaches it sets it for all.
    marked = ranked.withColumn("level", level)
    first = F.min(F.when(F.col("need") >= F.col("level") * (1 - 1e-12), F.struct("need", "rank", "level"))).over(everything)
    return marked.select("source", "rank", "source_size",
                         F.least(F.col("most"), F.coalesce(F.col("weight") * first["level"], F.col("most"))).alias("target"))


def with_sources(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """The documents joined to their sources; null is a source like others."""
    right = common.small(sources, MOST_BROADCAST).withColumnRenamed("source", "_source")
    return docs.join(right, docs["source"].eqNullSafe(right["_source"])).drop("_source")


def before_in_source(docs: DataFrame) -> DataFrame:
    """With ``before``: the words of its source's documents that a document's draw puts before it.

    Running sums at three levels, each over at most 256 sums or the rows that
    share 16 bits of the draw, so that a source with a third of all rows has
    its rows in as many tasks as any others.
    """
    cells = docs.withColumn("hi", F.shiftrightunsigned("draw", 56).cast("int")).withColumn(
        "lo", F.shiftrightunsigned("draw", 48).bitwiseAND(255).cast("int"))
    lows = cells.groupBy("rank", "hi", "lo").agg(F.sum("size").alias("cell"))
    highs = lows.groupBy("rank", "hi").agg(F.sum("cell").alias("cell"))
    sum_before = lambda what, by, order: F.coalesce(F.sum(what).over(
        Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    highs = highs.select("rank", "hi", sum_before("cell", ["rank"], ["hi"]).alias("hi_before"))
    lows = lows.select("rank", "hi", "lo", sum_before("cell", ["rank", "hi"], ["lo"]).alias("lo_before"))
    inside = sum_before("size", ["rank", "hi", "lo"], ["draw", "doc_id", "size", "key"])
    return (cells.withColumn("inside", inside)
            .join(lows.join(highs, ["rank", "hi"]), ["rank", "hi", "lo"])
            .withColumn("before", F.col("hi_before") + F.col("lo_before") + F.col("inside"))
            .drop("hi", "lo", "inside", "hi_before", "lo_before"))


def positions(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most_times: int = 3,
              schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and positions of each of ``docs(doc_id, source, text)``.

    Each pass over a source's stream takes its documents whole, in the order of
    a fixed draw; a copy is taken if its middle is below the source's target,
    so that taken words differ from it by half a document at most. No document
    is taken more than ``most_times``. ``positions`` has the training time of
    each copy, in order.

    A null or empty text has size 0 and is taken once, for its source has room
    for it at no cost, except that a source of size 0 has target 0 and its
    documents are taken once at time 0. Rows of equal doc_id are separate
    documents. Null sources are one source, the last.
    """
    narrow = common.written(sized(docs).select("doc_id", "source", "size", "draw", "key"), "sizes")
    sources = common.written(targets(narrow, weights, most_times), "sources")
    placed = before_in_source(with_sources(narrow, sources))
    middle = lambda k: k * F.col("source_size") + F.col("before") + F.col("size") / 2
    copies = F.filter(F.array(*(F.lit(k) for k in range(most_times))),
                      lambda k: F.when(F.col("size") == 0, k == 0).otherwise(middle(k) < F.col("target")))
    plans = F.lit(None)
    for k, schedule in enumerate(schedules):
        plans = F.when(F.col("rank") % len(schedules) == k, demand_segments(schedule)).otherwise(plans)
    share = lambda k: F.coalesce(F.try_divide(middle(k), F.col("target")), F.lit(0.0))
    return (placed.withColumn("plan", plans).withColumn("copies", copies)
            .select("doc_id", "source", "size", "source_size", "target", "key",
                    (F.size("copies") * F.col("size")).alias("taken"),
                    F.transform("copies", lambda k: time_of(share(k), F.col("plan"))).alias("positions")))


def mix(docs: DataFrame, **how) -> DataFrame:
    """All columns of the documents, one row per taken copy, in training order.

    Texts meet their positions by doc_id and a hash of source and text. Of rows
    equal in these one gets the copies of all, the first by a hash of the other
    columns; it is picked before texts are shuffled. Then the copies are
    range-sorted by position: partition follows partition, in the files too.
    """
    first = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id")
    placed = (positions(docs, **how).select(first, F.col("key").alias("_key"), "positions").groupBy("_id", "_key")
              .agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("_positions")))
    # The documents' own columns go along under other names, as theirs may be any.
    back = {f"_o{i}": c for i, c in enumerate(docs.columns)}
    others = [F.col(o) for o, c in back.items() if c not in ("doc_id", "source", "text")]
    one = Window.partitionBy("_id", "_key").orderBy(F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0))
    full = (docs.select(first, F.xxhash64("source", "text").alias("_key"), *(F.col(c).alias(o) for o, c in back.items()))
            .withColumn("_nth", F.row_number().over(one)).where("_nth = 1"))
    return (full.join(placed, ["_id", "_key"]).select("_id", *back, F.explode("_positions").alias("_position"))
            .repartitionByRange(common.partitions(docs.sparkSession), "_position", "_id")
            .sortWithinPartitions("_position", "_id").select(*common.named(back)))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = positions(common.table(spark, sf_dir, "documents"))
    return (placed.withColumn("position", F.try_element_at("positions", F.lit(1)))
            .repartitionByRange(common.partitions(spark), F.col("position").asc_nulls_last(), "doc_id")
            .sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")
            .select("doc_id", "size", "source_size", "target", "taken", "source", "position"))
