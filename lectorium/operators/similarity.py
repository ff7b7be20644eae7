"""Works that share fans with a work: six scores over one pair of sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectorium.functions.numeric import ratio

SCORES = ("cosine", "jaccard", "lift", "pmi", "conditional", "association")


def similar_works(events: DataFrame, cohort: DataFrame, stats: DataFrame, work_id: int, score: str = "cosine", least_both: float = 2.0, top: int = 100) -> DataFrame:
    """work_id, both, score of the works that cohort(user_id, w) gives five stars with the seed."""
    fives = events.filter("rating = 5").select("work_id", "user_id").join(cohort.select("user_id", "w"), "user_id")
    fans = fives.filter(F.col("work_id") == work_id).select("user_id")
    both = fives.join(fans, "user_id", "left_semi").filter(F.col("work_id") != work_id).groupBy("work_id").agg(F.sum("w").alias("shared"), F.count(F.lit(1)).alias("heads"))
    mass = fives.groupBy("work_id").agg(F.sum("w").alias("wb"))
    seed = fives.filter(F.col("work_id") == work_id).agg(F.sum("w").alias("wa"))
    size = cohort.agg(F.count(F.lit(1)).cast("double").alias("nc"))
    counts = stats.select("work_id", F.col("n").alias("nb"))
    own = stats.filter(F.col("work_id") == work_id).agg(F.max("n").alias("na"))
    x = both.filter(F.col("heads") >= least_both).join(mass, "work_id").join(counts, "work_id")
    for side in (seed, size, own):
        x = x.crossJoin(F.broadcast(side))  # one row each
    b, wa, wb, nc = F.col("shared"), F.col("wa"), F.col("wb"), F.col("nc")
    value = {
        "cosine": ratio(b, F.sqrt(wa * wb)),
        "jaccard": ratio(b, wa + wb - b),
        "lift": ratio(b * nc, F.col("na").cast("double") * F.col("nb")),
        "pmi": F.ln(F.greatest(ratio(b * nc, wa * wb), F.lit(1e-12))),
        "conditional": ratio(b, wa),
        "association": ratio(b, wa) * F.ln(ratio(nc, wb)),
    }[score]
    return x.select("work_id", F.round("shared", 6).alias("shared"), F.round(value, 6).alias("score")).orderBy(F.desc_nulls_last("score"), F.desc("shared"), "work_id").limit(top)


def supporters(events: DataFrame, cohort: DataFrame, work_id: int, top: int = 50) -> DataFrame:
    """The weightiest readers of a work, with what they gave it."""
    own = events.filter((F.col("work_id") == work_id) & (F.col("rating") >= 4)).select("user_id", "rating")
    return own.join(cohort.select("user_id", "w"), "user_id").select("user_id", "rating", F.round("w", 6).alias("w")).orderBy(F.desc("w"), F.desc("rating"), "user_id").limit(top)


def better_edition(works: DataFrame, stats: DataFrame, work_id: int, times: float = 5.0, least: int = 20) -> DataFrame:
    """A work of the same title with far more ratings, if there is one."""
    w = works.join(stats.select("work_id", "n"), "work_id")
    own = w.filter(F.col("work_id") == work_id).select(F.col("title").alias("t"), F.col("n").alias("m"))
    return w.join(F.broadcast(own), F.col("title") == F.col("t")).filter((F.col("work_id") != work_id) & (F.col("n") >= F.greatest(F.col("m") * times, F.lit(float(least))))).select("work_id", "n").orderBy(F.desc("n"), "work_id").limit(1)
