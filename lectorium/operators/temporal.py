"""When readers add works: import bursts, early and late readers, eras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectorium.functions.numeric import ratio

DAY = 86_400


def import_bursts(events: DataFrame, least_share: float = 0.5) -> DataFrame:
    """Per reader: days active, the busiest day, how many events it has, and whether that looks imported."""
    d = events.withColumn("day", F.floor(F.col("added_at") / DAY)).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    u = d.groupBy("user_id").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("events"), F.max_by(F.struct("day", "n"), F.struct("n", -F.col("day"))).alias("peak"))
    return u.select("user_id", "days", "events", F.col("peak.day").alias("peak_day"), F.col("peak.n").alias("peak_events"), (F.col("peak.n") / F.col("events") >= least_share).alias("imported"))


#: The clock of each definition and the events that it uses. `profile` is a reader's, as of
#: import_profile.
DEFINITIONS = {
    "added_all": ("added_at", "added_at IS NOT NULL"),
    "added_no_bulk_users": ("added_at", "added_at IS NOT NULL AND (profile_events < 20 OR peak_day_share < 0.50)"),
    "added_post_onboarding": ("added_at", "added_at IS NOT NULL AND added_day > first_day + 7 AND added_day <> peak_day"),
    "updated_all": ("updated_at", "updated_at IS NOT NULL"),
    "read_available": ("read_at", "read_at IS NOT NULL"),
}


def import_profile(events: DataFrame) -> DataFrame:
    """Per reader of events(user_id, added_at): first_day, peak_day, profile_events and peak_day_share."""
    d = events.filter("added_at IS NOT NULL").groupBy("user_id", F.floor(F.col("added_at") / DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    u = d.groupBy("user_id").agg(F.min("day").alias("first_day"), F.sum("n").alias("profile_events"), F.max_by(F.struct("day", "n"), F.struct("n", -F.col("day"))).alias("peak"))
    return u.select("user_id", "first_day", F.col("peak.day").alias("peak_day"), "profile_events", (F.col("peak.n") / F.col("profile_events")).alias("peak_day_share"))


def clocks(events: DataFrame, profile: DataFrame) -> DataFrame:
    """The events by each of the definitions: user_id, work_id, rating, definition, event_at."""
    e = events.join(profile, "user_id", "left").withColumn("added_day", F.floor(F.col("added_at") / DAY))
    used = F.array(*[F.when(F.expr(condition), F.struct(F.lit(name).alias("definition"), F.col(clock).cast("long").alias("event_at"))) for name, (clock, condition) in DEFINITIONS.items()])
    return e.select("user_id", "work_id", "rating", F.explode(F.filter(used, lambda x: x.isNotNull())).alias("x")).select("user_id", "work_id", "rating", "x.*")


def early_late(events: DataFrame, jury: DataFrame, share: float = 0.2, least_mass: float = 10.0) -> DataFrame:
    """By work and definition of clocks(events): the jury's share of fives among the first and last fifth of its
    fives and ratings up to 3, with masses, Kish sizes and the change. jury(user_id, q); both masses must
    reach least_mass."""
    e = events.filter("rating = 5 OR rating <= 3").join(jury.filter("q > 0"), "user_id")
    keys = ["definition", "work_id"]
    cuts = e.groupBy(*keys).agg(F.percentile("event_at", share).alias("low"), F.percentile("event_at", 1 - share).alias("high"))
    e, out = e.join(cuts, keys), []
    for name, at in (("early", F.col("event_at") <= F.col("low")), ("late", F.col("event_at") >= F.col("high"))):
        q, five = F.when(at, F.col("q")), F.when(at & (F.col("rating") == 5), F.col("q")).when(at, 0.0)
        out += [F.sum(q).alias(f"{name}_mass"), ratio(F.sum(five), F.sum(q)).alias(f"{name}_p5"), ratio(F.sum(q) * F.sum(q), F.sum(q * q)).alias(f"{name}_kish"), F.count_distinct(F.when(at, F.col("user_id"))).alias(f"{name}_users")]
    g = e.groupBy(*keys).agg(*out)
    return g.filter((F.round("early_mass", 9) >= least_mass) & (F.round("late_mass", 9) >= least_mass)).withColumn("delta_p5", F.col("late_p5") - F.col("early_p5"))


def era_ranks(events: DataFrame, edges: list[int], least: int = 3, m: float = 10.0, top: int = 50) -> DataFrame:
    """The best works of each span between edges (epoch seconds) by shrunk share of fives."""
    era = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        era = F.when((F.col("added_at") >= a) & (F.col("added_at") < b), i).otherwise(era)
    e = events.withColumn("era", era).filter("era IS NOT NULL")
    p = e.groupBy("era").agg(ratio(F.count_if(F.col("rating") == 5), F.count(F.lit(1))).alias("p0"))
    g = e.groupBy("era", "work_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rating") == 5).alias("n5")).filter(F.col("n") >= least).join(F.broadcast(p), "era")
    g = g.withColumn("score", F.round((F.col("n5") + m * F.col("p0")) / (F.col("n") + m), 6))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("era").orderBy(F.desc("score"), F.desc("n"), "work_id"))).filter(F.col("rank") <= top).select("era", "work_id", "n", "score", "rank")
