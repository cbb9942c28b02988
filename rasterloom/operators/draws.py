"""Seeded draws of a few rows of many, as a linear congruential generator and a shuffle from the end give them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written

#: Multiplier, increment and scrambling of the 48-bit generator.
MULTIPLIER, INCREMENT, MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1


def states(seed: int, first: int, count: int) -> np.ndarray:
    """The generator's states number first ... first + count - 1 (from 1), reached by a jump."""
    power, total, a, c = 1, 0, MULTIPLIER, INCREMENT
    n = first
    while n:  # x -> power x + total after ``first`` steps
        if n & 1:
            power, total = power * a & MASK, (total * a + c) & MASK
        a, c, n = a * a & MASK, (a * c + c) & MASK, n >> 1
    start = (power * ((seed ^ MULTIPLIER) & MASK) + total) & MASK
    powers = np.concatenate([np.ones(1, "u8"), np.cumprod(np.full(max(count - 1, 0), MULTIPLIER, "u8"))])[:count]
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(powers[:-1], dtype="u8")])[:count]
    return (powers * np.uint64(start) + np.uint64(INCREMENT) * sums) & np.uint64(MASK)


def drawn(state: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number under each bound that a state gives, and whether it is refused, so that the next state is taken."""
    u = (state >> np.uint64(17)).astype("i8")
    even = (bound & (bound - 1)) == 0
    value = np.where(even, (bound * u) >> 31, u % bound)
    return value, ~even & (u - value + bound - 1 >= 1 << 31)


def refusals(spark: SparkSession, n: int, seed: int, block: int = 1 << 16, most: int = 1 << 20) -> np.ndarray:
    """Numbers (from 0) of the states that a shuffle of n rows refuses, in order: about n * n / 2**32.

    Whether a state is refused depends on its bound, and so on the refusals
    before it. But only a state of the uppermost n of 2**31 can be: these few,
    twice the refusals, are looked for in all blocks at once, and they alone are
    gone through in order, ``most`` or so at a time.
    """
    found: list[int] = []
    slice_ = max(block, (most << 31) // max(n, 1) // block * block)
    done = 0
    while done < (end := n - 1 + len(found)):
        end = min(end, done + slice_)
        first, last = done, end

        def run(batches):
            for batch in batches:
                for k in batch["id"]:
                    at = np.arange(first + k * block, min(first + (k + 1) * block, last))
                    u = (states(seed, int(at[0]) + 1, len(at)) >> np.uint64(17)).astype("i8")
                    high = u >= (1 << 31) - n
                    yield pd.DataFrame({"at": at[high], "u": u[high]})

        rows = spark.range(0, -(-(last - first) // block)).mapInPandas(run, "at long, u long").toPandas().sort_values("at")
        for at, u in zip(rows["at"].tolist(), rows["u"].tolist()):
            bound = n - at + len(found)
            if bound & (bound - 1) and u - u % bound + bound - 1 >= 1 << 31:
                found.append(at)
        done = end
    return np.array(found, "i8")


def swaps(spark: SparkSession, n: int, seed: int, block: int = 1 << 16) -> DataFrame:
    """i and j of a shuffle's swaps: from the last to the second, place i - 1 with a place j under i drawn at random.

    Blocks of draws are made apart, each from a jump, once; a refused state
    moves all draws after it by one.
    """
    refused = refusals(spark, n, seed, block)

    def run(batches):
        for batch in batches:
            for k in batch["id"]:
                at = np.arange(k * block, min((k + 1) * block, n - 1 + len(refused)))
                before = np.searchsorted(refused, at)
                ok = np.append(refused, -1)[before] != at
                bound = (n - at + before)[ok]
                value, _ = drawn(states(seed, int(at[0]) + 1, len(at))[ok], bound) if len(at) else (at, at)
                yield pd.DataFrame({"i": bound, "j": value})

    return written(spark.range(0, (n - 1 + len(refused)) // block + 1).mapInPandas(run, "i long, j long"), "swaps")


def shuffled_first(df: DataFrame, order: str, take: int, seed: int = 42) -> DataFrame:
    """rank (from 0) and the columns of the first ``take`` rows of df, ordered by a unique column and then shuffled.

    Which row comes to a place is asked backwards: the place's own swap names a
    place, and each later swap with that one moves it on; with n rows there are
    about log(n) of these. Neither the rows nor the swaps come to one task.
    """
    spark = df.sparkSession
    sorted_rows = written(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()), "pool")
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row a partition
    before, total = {}, 0
    for r in counts:
        before[r["_part"]] = total
        total += r["n"]
    start = spark.createDataFrame([(int(p), int(b)) for p, b in before.items()], "_part long, _before long")
    numbered = sorted_rows.withColumn("_part", part).join(F.broadcast(start), "_part").withColumn("_place", F.col("_before") + inside).drop("_id", "_part", "_before")
    if take >= total:
        return numbered.withColumnRenamed("_place", "rank")
    table = swaps(spark, total, seed)
    asked = spark.range(take).select(F.col("id").alias("rank"), F.col("id").alias("_at"), F.col("id").alias("_done"))
    own = table.select((F.col("i") - 1).alias("rank"), "i", "j")
    asked = written(asked.join(own, "rank", "left").select("rank", F.coalesce("j", "rank").alias("_at"), F.coalesce("i", F.lit(1)).alias("_done")), "asked")
    while True:
        later = table.join(F.broadcast(asked), (F.col("j") == F.col("_at")) & (F.col("i") > F.col("_done"))).groupBy("rank").agg(F.min("i").alias("_next"))
        later = written(later, "later")
        if later.isEmpty():
            break
        asked = written(asked.join(later, "rank", "left").select("rank", F.coalesce(F.col("_next") - 1, "_at").alias("_at"), F.coalesce("_next", "_done").alias("_done")), "asked")
    return numbered.join(F.broadcast(asked.select("rank", F.col("_at").alias("_place"))), "_place").drop("_place")
