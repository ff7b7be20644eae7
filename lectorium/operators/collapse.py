"""From editions to works: one row per reader and work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def collapse_ratings(interactions: DataFrame) -> DataFrame:
    """A reader's best rating over a work's editions: user_id, work_id, rating."""
    return interactions.filter("rating > 0").groupBy("user_id", "work_id").agg(F.max("rating").alias("rating"))


def collapse_observations(interactions: DataFrame) -> DataFrame:
    """The strongest state over editions: is_read, rating (0 if none) and how many editions were touched."""
    return interactions.groupBy("user_id", "work_id").agg(
        F.bool_or("is_read").alias("is_read"), F.max(F.coalesce("rating", F.lit(0))).cast("int").alias("rating"), F.count(F.lit(1)).alias("edition_interactions")
    )


def collapse_times(interactions: DataFrame, low: int, high: int) -> DataFrame:
    """First time in the band [low, high), last time at all and best rating per reader and work."""
    inside = (F.col("added_at") >= low) & (F.col("added_at") < high)
    return interactions.groupBy("user_id", "work_id").agg(
        F.min(F.when(inside, F.col("added_at"))).alias("first_added"), F.max("added_at").alias("last_added"), F.max("rating").alias("rating"), F.count_if(inside).alias("in_band")
    )


def representative_edition(editions: DataFrame, weight: str, tie: str, columns: list[str]) -> DataFrame:
    """Per work the edition of greatest weight, ties to the greatest tie value; all columns of one edition."""
    best = F.max_by(F.struct(*columns), F.struct(weight, tie))
    return editions.filter(F.col(weight).isNotNull()).groupBy("work_id").agg(best.alias("best")).select("work_id", "best.*")


def mode_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value of each key, ties to the smallest."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def choose_state(states: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first by the order given, which must be total."""
    return states.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
