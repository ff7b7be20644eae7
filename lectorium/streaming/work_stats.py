"""Work statistics kept up from a stream of ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and key; windows close once the watermark has passed them."""
    w = events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), key, "n", "total")


def star_sums(ratings: DataFrame) -> DataFrame:
    """What adds up over batches: per work the number of ratings, their sum, sum of squares and of each star."""
    r = F.col("rating")
    return ratings.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"), F.sum(r.cast("long")).alias("s"), F.sum((r * r).cast("long")).alias("ss"), *[F.count_if(r == k).alias(f"n{k}") for k in range(1, 6)])


def merge_sums(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two tables of star_sums as one."""
    both = old.unionByName(new)
    return both.groupBy("work_id").agg(*[F.sum(c).alias(c) for c in both.columns if c != "work_id"])


def stats_of(sums: DataFrame) -> DataFrame:
    """n, mean and population deviation from star_sums."""
    n = F.col("n").cast("double")
    mean = F.col("s") / n
    return sums.select("work_id", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / n - mean * mean, F.lit(0.0))).alias("std"), *[f"n{k}" for k in range(1, 6)])


def sink(path: str):
    """A foreachBatch function that keeps star_sums per batch id below path. A batch that is run again
    overwrites its own part, so each rating counts once; current_stats adds the parts up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        star_sums(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def current_stats(spark, path: str) -> DataFrame:
    parts = spark.read.parquet(path).drop("batch")
    return stats_of(parts.groupBy("work_id").agg(*[F.sum(c).alias(c) for c in parts.columns if c != "work_id"]))
