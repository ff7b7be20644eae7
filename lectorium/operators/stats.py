"""Reader and work statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectorium.functions.numeric import ratio, when_sum

PICKY_FLOOR, PICKY_CAP, LEAST_RATED = 0.25, 20.0, 5


def user_pickiness(ratings: DataFrame, least: int = LEAST_RATED) -> DataFrame:
    """Readers of at least so many ratings: n_rated, n_five, five_rate."""
    g = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rated"), F.count_if(F.col("rating") == 5).alias("n_five"))
    return g.filter(F.col("n_rated") >= least).withColumn("five_rate", ratio(F.col("n_five"), F.col("n_rated")))


def rating_events(ratings: DataFrame, pickiness: DataFrame, works: DataFrame) -> DataFrame:
    """Ratings of picky-known readers with picky_weight: the median share of fives over the reader's own,
    within bounds. The median is a one-row side that is joined, not collected."""
    middle = pickiness.agg(F.median("five_rate").alias("middle"))
    weight = F.least(F.lit(PICKY_CAP), F.greatest(F.lit(PICKY_FLOOR), F.col("middle") / F.nullif(F.col("five_rate"), F.lit(0.0))))
    weighted = pickiness.crossJoin(F.broadcast(middle)).select("user_id", "n_rated", "five_rate", weight.alias("picky_weight"))
    return ratings.join(weighted, "user_id").join(works.select("work_id", "is_sf"), "work_id").select("work_id", "user_id", "rating", "n_rated", "five_rate", "picky_weight", "is_sf")


def work_stats(events: DataFrame) -> DataFrame:
    """Star histogram, moments and shares of a work."""
    star = lambda k: F.count_if(F.col("rating") == k)
    low = F.count_if(F.col("rating") <= 2)
    n = F.count(F.lit(1))
    return events.groupBy("work_id").agg(
        n.alias("n"),
        F.avg("rating").alias("mean"),
        F.stddev_pop("rating").alias("std"),
        *[star(k).alias(f"n{k}") for k in (5, 4, 3, 2, 1)],
        low.alias("n_low"),
        (star(5) / n).alias("p5"),
        (star(1) / n).alias("p1"),
        (low / n).alias("p_low"),
        (4.0 * (star(5) / n) * (low / n)).alias("polarization"),
        when_sum(F.col("rating") == 5, F.col("picky_weight")).alias("picky_five_mass"),
    )


def priors(stats: DataFrame, works: DataFrame) -> DataFrame:
    """One row: the share of fives and the mean of means, over all works and over those of the genre."""
    s = stats.join(works.select("work_id", "is_sf"), "work_id")
    sf = F.col("is_sf")
    return s.agg(
        ratio(F.sum("n5"), F.sum("n")).alias("p5_all"),
        F.avg("mean").alias("mean_all"),
        ratio(F.sum(F.when(sf, F.col("n5"))), F.sum(F.when(sf, F.col("n")))).alias("p5_sf"),
        F.avg(F.when(sf, F.col("mean"))).alias("mean_sf"),
    )


def retarget(works: DataFrame, genre_works: DataFrame) -> DataFrame:
    """works with is_sf set anew from the works of a genre."""
    return works.drop("is_sf").join(genre_works.select("work_id").distinct().withColumn("is_sf", F.lit(True)), "work_id", "left").withColumn("is_sf", F.coalesce("is_sf", F.lit(False)))


def star_histogram(events: DataFrame, weight: str | None = None) -> DataFrame:
    """How much weight each star has: one row per star 1 to 5, also those nobody gave."""
    w = F.col(weight) if weight else F.lit(1.0)
    wide = events.agg(*[when_sum(F.col("rating") == k, w).alias(str(k)) for k in range(1, 6)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("star"), F.coalesce(F.col(str(k)), F.lit(0.0)).alias("mass")) for k in range(1, 6)])).alias("s")).select("s.*")


def user_star_hist(events: DataFrame) -> DataFrame:
    """A reader's stars: n_rated, mean_rating, max_star, c1 to c5 and how many levels are used."""
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_rated"),
        F.avg("rating").alias("mean_rating"),
        F.max("rating").alias("max_star"),
        *[F.count_if(F.col("rating") == k).alias(f"c{k}") for k in range(1, 6)],
        sum((F.bool_or(F.col("rating") == k).cast("int") for k in range(2, 6)), F.bool_or(F.col("rating") == 1).cast("int")).cast("long").alias("n_levels"),
    )


def user_percentiles(hist: DataFrame, literary: DataFrame, least_literary: int = 20, least: int = 20) -> DataFrame:
    """What each star means to a reader: the middle of its place in the reader's own ratings, those of
    literary works if there are enough of them, else all. hist and literary are star histograms."""
    lit = literary.select("user_id", F.col("n_rated").alias("n_lit_rated"), *[F.col(f"c{k}").alias(f"l{k}") for k in range(1, 6)], F.col("n_levels").alias("lit_levels"))
    j = hist.filter((F.col("n_rated") >= least) & (F.col("n_levels") >= 2)).join(lit, "user_id", "left").withColumn("n_lit_rated", F.coalesce("n_lit_rated", F.lit(0)))
    use = F.col("n_lit_rated") >= least_literary
    pick = lambda a, b: F.when(use, F.col(a)).otherwise(F.col(b))
    j = j.withColumn("n_cdf", pick("n_lit_rated", "n_rated"))
    below, out = F.lit(0), []
    for k in range(1, 6):
        upto = below + pick(f"l{k}", f"c{k}")
        out.append(((below + upto) / (2.0 * F.col("n_cdf"))).alias(f"pct_{k}"))
        below = upto
    return j.select("user_id", "n_rated", "n_lit_rated", "n_cdf", pick("lit_levels", "n_levels").alias("n_levels"), F.when(use, "lit").otherwise("full").alias("source"), *out)


def percentile_of(rating: str = "rating"):
    """The percentile column of an event joined to user_percentiles."""
    e = F.lit(0.5)
    for k in range(5, 0, -1):
        e = F.when(F.col(rating) == k, F.col(f"pct_{k}")).otherwise(e)
    return e
