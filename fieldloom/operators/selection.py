"""Exact percentiles by distributed selection: counting passes over value ranges instead of one buffer of all values.

A sketch gives a narrow range around each wanted rank; every pass counts the values in equal slices of the range (and those
beside it), and the slice that holds the rank becomes the next range, down to a single value. What a task holds are the
slices, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.session import cut


def order_statistics(df: DataFrame, keys: list[str], value: str, shares: list[float], bins: int = 4096, accuracy: int = 10_000) -> DataFrame:
    """(keys, share, rank, v): for each share p of each key the values at the ranks floor and ceil of (n - 1) p, from 0.

    Nulls and NaN count as missing; keys without values have no rows.
    """
    data = df.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    wide = 2.0 / accuracy
    asked = [x for p in shares for x in (max(0.0, p - wide), min(1.0, p + wide))]
    sketch = data.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", asked, accuracy).alias("q"))
    ends = F.array(*[F.struct(F.lit(float(p)).alias("share"), F.col("q")[2 * k].alias("lo"), F.col("q")[2 * k + 1].alias("hi")) for k, p in enumerate(shares)])
    each = sketch.select(*keys, "n", F.explode(ends).alias("e")).select(*keys, "n", "e.*")
    place = (F.col("n") - 1) * F.col("share")
    ranks = F.array_distinct(F.array(F.floor(place).cast("long"), F.ceil(place).cast("long")))
    open_ = cut(each.select(*keys, "share", F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below")))
    on, done = [*keys, "share", "rank"], None
    first = True
    while True:
        near = data.join(open_, keys) if keys else data.join(F.broadcast(open_), how="cross")  # two ranks for each share
        near = near if first else near.where("v >= lo and v <= hi")
        step = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") / 2 - F.col("lo") / 2) * (bins / 2)), F.lit(bins - 1))
        slice_ = F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") > F.col("hi"), bins).when(F.col("hi") == F.col("lo"), 0).otherwise(F.coalesce(step, F.lit(0)))
        counted = near.groupBy(*on, "below", slice_.cast("int").alias("slice")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        so_far = F.sum("n").over(W.partitionBy(*on).orderBy("slice"))  # bins + 2 rows
        held = counted.withColumn("upto", F.col("below") + so_far).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        found = cut(held.select(*on, "lo", "hi", (F.col("upto") - F.col("n")).alias("below")))
        settled = found.where("lo = hi").select(*on, F.col("lo").alias("v"))
        done = settled if done is None else done.unionByName(settled)
        open_, first = found.where("lo < hi"), False
        if open_.isEmpty():
            return done


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], bins: int = 4096, accuracy: int = 10_000) -> DataFrame:
    """(keys, share, value): percentiles with linear interpolation between neighbouring values, equal to ``percentile``."""
    data = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    size = data.groupBy(*keys).agg(F.count("*").alias("size"))
    stats = order_statistics(df, keys, value, shares, bins, accuracy)
    stats = stats.join(size, keys) if keys else stats.crossJoin(F.broadcast(size))  # one row
    part = (F.col("size") - 1) * F.col("share")
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    both = stats.withColumn("part", part - F.floor(part)).groupBy(*keys, "share").agg(low.alias("low"), high.alias("high"), F.first("part").alias("part"))
    return both.select(*keys, "share", (F.col("low") * (1 - F.col("part")) + F.col("high") * F.col("part")).alias("value"))
