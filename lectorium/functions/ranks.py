"""Ranks over a whole table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectorium.functions.storage import saved

_BITS = 33  # monotonically_increasing_id: the partition above, the row's place in it below


def numbered(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """df with name: the row's place (from 1) in the given total order. Rows are dealt by ranges, numbered
    within their range, and moved by the sizes of the ranges before, of which there are as many as partitions."""
    dealt = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", _BITS)
    sizes = {r["p"]: r["k"] for r in dealt.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("k")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    if not before:
        return dealt.withColumn(name, F.lit(None).cast("long")).drop("_m")
    offset = F.create_map(*[F.lit(x) for p, k in before.items() for x in (p, k)])[part]
    return dealt.withColumn(name, offset + F.col("_m").bitwiseAND((1 << _BITS) - 1) + 1).drop("_m")


def percent_rank(df: DataFrame, by: str, name: str, tie: str = "user_id") -> DataFrame:
    """df with the share of other rows below its value; equal values share the least place. One row has 0."""
    r = numbered(df, [F.col(by), F.col(tie)], "_r")
    least = r.groupBy(by).agg(F.min("_r").alias("_least"))
    n = r.agg(F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col("_n") > 1, (F.col("_least") - 1) / (F.col("_n") - 1)).otherwise(0.0)
    return r.join(least, by).crossJoin(F.broadcast(n)).withColumn(name, share).drop("_r", "_least", "_n")


def ntile(df: DataFrame, order: list, bins: int, name: str) -> DataFrame:
    """df with name: which of bins parts of equal size (the first ones one longer) the row is in."""
    r = numbered(df, order, "_r")
    n = r.agg(F.count(F.lit(1)).alias("_n"))
    q, rest, at = F.floor(F.col("_n") / bins), F.col("_n") % bins, F.col("_r") - 1
    tile = F.when(at < rest * (q + 1), F.floor(at / (q + 1))).otherwise(rest + F.floor((at - rest * (q + 1)) / F.greatest(q, F.lit(1)))) + 1
    return r.crossJoin(F.broadcast(n)).withColumn(name, tile.cast("int")).drop("_r", "_n")
