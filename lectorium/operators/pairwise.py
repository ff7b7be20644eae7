"""Within-reader comparisons: which works win over which, without listing every pair of ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectorium.functions.numeric import md5_order, ratio

CAP = 12


def balanced_votes(events: DataFrame, cap: int = CAP, seed: str = "votes", high: int = 4, low: int = 2) -> DataFrame:
    """At most cap high and as many low ratings of each reader, chosen by a hash: user_id, work_id, side (1 or
    -1). Readers without both sides have none."""
    e = events.withColumn("side", F.when(F.col("rating") >= high, 1).when(F.col("rating") <= low, -1)).filter("side IS NOT NULL")
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("user_id", "side").orderBy(md5_order(F.col("user_id"), F.col("work_id"), seed), "work_id")))
    counts = e.groupBy("user_id").agg(F.count_if(F.col("side") == 1).alias("h"), F.count_if(F.col("side") == -1).alias("l"))
    return e.join(counts, "user_id").filter(F.col("r") <= F.least(F.lit(cap), "h", "l")).select("user_id", "work_id", "side")


def expected_votes(events: DataFrame, cap: int = CAP, high: int = 4, low: int = 2) -> DataFrame:
    """The same without drawing: each rating with its chance min(h, l, cap) / h or / l of being in."""
    e = events.withColumn("side", F.when(F.col("rating") >= high, 1).when(F.col("rating") <= low, -1)).filter("side IS NOT NULL")
    counts = e.groupBy("user_id").agg(F.count_if(F.col("side") == 1).alias("h"), F.count_if(F.col("side") == -1).alias("l"))
    m = F.least(F.lit(cap), "h", "l")
    return e.join(counts, "user_id").filter(m > 0).select("user_id", "work_id", "side", ratio(m, F.when(F.col("side") == 1, F.col("h")).otherwise(F.col("l"))).alias("mass"))


def esteem(votes: DataFrame, shrink: float = 20.0) -> DataFrame:
    """Wins and losses of each work over all high-low pairs of a reader, and the shrunk share of wins. A high
    vote wins as often as its reader has low ones, so counts per reader do instead of pairs."""
    counts = votes.groupBy("user_id").agg(F.count_if(F.col("side") == 1).alias("h"), F.count_if(F.col("side") == -1).alias("l"))
    w = votes.join(counts, "user_id").groupBy("work_id").agg(F.sum(F.when(F.col("side") == 1, F.col("l")).otherwise(0)).alias("wins"), F.sum(F.when(F.col("side") == -1, F.col("h")).otherwise(0)).alias("losses"))
    return w.withColumn("esteem", (F.col("wins") + shrink / 2) / (F.col("wins") + F.col("losses") + shrink))


def pair_table(votes: DataFrame, least: int = 2) -> DataFrame:
    """Work against work: how often winner stands above loser. At most cap x cap pairs per reader."""
    up, down = votes.filter("side = 1"), votes.filter("side = -1")
    pairs = up.select("user_id", F.col("work_id").alias("winner")).join(down.select("user_id", F.col("work_id").alias("loser")), "user_id")
    return pairs.groupBy("winner", "loser").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def residuals(events: DataFrame, user_shrink: float = 10.0, work_shrink: float = 20.0) -> DataFrame:
    """What is left of each rating after the shrunk means of its reader and its work: work_id, n, residual."""
    mu = events.agg(F.avg("rating").alias("mu"))
    u = events.groupBy("user_id").agg(F.sum("rating").alias("us"), F.count(F.lit(1)).alias("un"))
    b = events.groupBy("work_id").agg(F.sum("rating").alias("bs"), F.count(F.lit(1)).alias("bn"))
    e = events.crossJoin(F.broadcast(mu)).join(u, "user_id").join(b, "work_id")
    shrunk = lambda s, n, k: (F.col(s) + k * F.col("mu")) / (F.col(n) + k)
    return e.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("rating") - shrunk("us", "un", user_shrink) - shrunk("bs", "bn", work_shrink) + F.col("mu")).alias("residual"))


def contrast(events: DataFrame, one: DataFrame, other: DataFrame, least: int = 3) -> DataFrame:
    """Share of fives among readers of one group less that among the other; works need enough of both."""
    g = events.join(one.select("user_id").withColumn("one", F.lit(1)).unionByName(other.select("user_id").withColumn("one", F.lit(0))), "user_id")
    five = (F.col("rating") == 5).cast("double")
    a = g.groupBy("work_id").agg(F.count_if(F.col("one") == 1).alias("n1"), F.count_if(F.col("one") == 0).alias("n0"), F.avg(F.when(F.col("one") == 1, five)).alias("p1"), F.avg(F.when(F.col("one") == 0, five)).alias("p0"))
    return a.filter((F.col("n1") >= least) & (F.col("n0") >= least)).select("work_id", "n1", "n0", (F.col("p1") - F.col("p0")).alias("lift"))
