"""Juries found by ratings alone, and rankings by them.

Defined results: readers without a feature are in no jury; works below a floor are left out; tied works go by
their smaller id; empty tables give no rows. Thresholds are exact quantiles, one-row sides of the plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectorium.functions.numeric import kish, ratio
from lectorium.functions.ranks import numbered


def work_rarity(events: DataFrame, least: int = 25) -> DataFrame:
    """Works of enough ratings: n, n5, mean, p5 and rarity 1 / ln(1 + n)."""
    w = events.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rating") == 5).alias("n5"), F.avg("rating").alias("mean")).filter(F.col("n") >= least)
    return w.withColumn("rarity", 1.0 / F.ln(1.0 + F.col("n"))).withColumn("p5", F.col("n5") / F.col("n"))


def reader_features(events: DataFrame, rarity: DataFrame, least: int = 20, least_liked: int = 5, midpop: int = 500, popular: int = 5000) -> DataFrame:
    """Readers of enough ratings and liked works: n_rated, mean_rating, five_rate, depth_ge4 and depth_5 (mean
    rarity of liked and loved works), n_ge4, n5, n_ge4_midpop, n_ge4_popular and mean_logn_5."""
    e = events.join(rarity.select("work_id", F.col("n").alias("_n"), "rarity"), "work_id")
    liked, loved = F.col("rating") >= 4, F.col("rating") == 5
    u = e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_rated"), F.avg("rating").alias("mean_rating"), ratio(F.count_if(loved), F.count(F.lit(1))).alias("five_rate"), F.avg(F.when(liked, F.col("rarity"))).alias("depth_ge4"),
        F.avg(F.when(loved, F.col("rarity"))).alias("depth_5"), F.count_if(liked & (F.col("_n") >= midpop)).alias("n_ge4_midpop"), F.count_if(liked & (F.col("_n") >= popular)).alias("n_ge4_popular"),
        F.avg(F.when(loved, F.ln(1.0 + F.col("_n")))).alias("mean_logn_5"), F.count_if(liked).alias("n_ge4"), F.count_if(loved).alias("n5"),
    )
    return u.filter((F.col("n_rated") >= least) & (F.col("n_ge4") >= least_liked))


def engaged(readers: DataFrame, least_rated: int = 50, least_midpop: int = 8, least_popular: int = 2) -> DataFrame:
    """Readers who also like works that many know, so that depth isn't obscurity alone."""
    return readers.filter(F.col("depth_ge4").isNotNull() & (F.col("n_rated") >= least_rated) & (F.col("n_ge4_midpop") >= least_midpop) & (F.col("n_ge4_popular") >= least_popular))


def beyond(readers: DataFrame, column: str, quantile: float, above: bool = True) -> DataFrame:
    """Readers at or beyond the quantile of a column."""
    cut = readers.agg(F.percentile(column, quantile).alias("_cut"))
    side = F.round(column, 12) >= F.round("_cut", 12) if above else F.round(column, 12) <= F.round("_cut", 12)
    return readers.crossJoin(F.broadcast(cut)).filter(side).drop("_cut")


def votes(events: DataFrame, jury: DataFrame, rarity: DataFrame, least_n: int, least_votes: int, *aggregates: Column) -> DataFrame:
    """Sums over a jury's ratings of works of at least least_n ratings, from at least least_votes of them."""
    e = events.select("user_id", "work_id", "rating").join(jury, "user_id").join(rarity.filter(F.col("n") >= least_n).select("work_id", "rarity"), "work_id")
    return e.groupBy("work_id").agg(F.count(F.lit(1)).alias("votes"), *aggregates).filter(F.col("votes") >= least_votes)



def jury_p5(events: DataFrame, jury: DataFrame, rarity: DataFrame, m: float = 30.0, p0: float = 0.25, least_n: int = 100, least_votes: int = 25) -> DataFrame:
    """A jury's share of fives, shrunk: work_id, score, n_eff."""
    v = votes(events, jury.select("user_id"), rarity, least_n, least_votes, F.count_if((F.col("rating") == 5)).alias("fives"))
    return v.select("work_id", ((F.col("fives") + m * p0) / (F.col("votes") + m)).alias("score"), F.col("votes").cast("double").alias("n_eff"))


def jury_love(events: DataFrame, jury: DataFrame, rarity: DataFrame, m: float = 30.0, prior: float = 0.02, least_n: int = 100, least_votes: int = 25) -> DataFrame:
    """A jury's fives weighted by the work's rarity, shrunk: work_id, score, n_eff."""
    v = votes(events, jury.select("user_id"), rarity, least_n, least_votes, F.sum(F.when((F.col("rating") == 5), F.col("rarity")).otherwise(0.0)).alias("rare"))
    return v.select("work_id", ((F.col("rare") + m * prior) / (F.col("votes") + m)).alias("score"), F.col("votes").cast("double").alias("n_eff"))


def audience_depth(events: DataFrame, readers: DataFrame, rarity: DataFrame, m: float = 40.0, least_rated: int = 40, least_midpop: int = 5, least_n: int = 100, least_votes: int = 50) -> DataFrame:
    """Mean depth of the readers who gave a five, shrunk to all readers' mean: work_id, score, n_eff."""
    prior = readers.agg(F.avg("depth_ge4").alias("prior"))
    some = readers.filter(F.col("depth_ge4").isNotNull() & (F.col("n_rated") >= least_rated) & (F.col("n_ge4_midpop") >= least_midpop)).select("user_id", "depth_ge4")
    v = votes(events.filter("rating = 5"), some, rarity, least_n, least_votes, F.avg("depth_ge4").alias("depth")).crossJoin(F.broadcast(prior))
    n = F.col("votes")
    return v.select("work_id", (n / (n + m) * F.col("depth") + m / (n + m) * F.col("prior")).alias("score"), n.cast("double").alias("n_eff"))


def depth_weighted(events: DataFrame, readers: DataFrame, rarity: DataFrame, m: float = 30.0, p0: float = 0.25, least_rated: int = 40, least_midpop: int = 5, least_n: int = 100, least_votes: int = 25) -> DataFrame:
    """Share of fives with readers weighted by squared depth, with the Kish size: work_id, score, n_eff."""
    w = F.pow(F.greatest("depth_ge4", F.lit(1e-9)), F.lit(2.0))
    some = readers.filter(F.col("depth_ge4").isNotNull() & (F.col("n_rated") >= least_rated) & (F.col("n_ge4_midpop") >= least_midpop)).select("user_id", w.alias("w"))
    v = votes(events, some, rarity, least_n, least_votes, F.sum("w").alias("all"), F.sum(F.when((F.col("rating") == 5), F.col("w")).otherwise(0.0)).alias("five"), kish(F.col("w")).alias("n_eff"))
    return v.filter(F.round("n_eff", 9) >= least_votes).select("work_id", ((F.col("five") + m * p0) / (F.col("all") + m)).alias("score"), "n_eff")


def resisters(events: DataFrame, readers: DataFrame, rarity: DataFrame, top: float = 0.995, least_rated: int = 50, least_seen: int = 8, quantile: float = 0.85, most_five: float = 0.45) -> DataFrame:
    """Readers of many blockbusters (works beyond a quantile of ratings) who seldom give them a five: user_id."""
    cut = rarity.agg(F.percentile("n", top).alias("_cut"))
    big = rarity.crossJoin(F.broadcast(cut)).filter(F.col("n") >= F.col("_cut")).select("work_id")
    r = events.select("user_id", "work_id", "rating").join(big, "work_id", "left_semi").join(readers.filter(F.col("n_rated") >= least_rated).select("user_id", "five_rate"), "user_id")
    r = r.groupBy("user_id", "five_rate").agg(F.count(F.lit(1)).alias("seen"), (1.0 - ratio(F.count_if((F.col("rating") == 5)), F.count(F.lit(1)))).alias("resist")).filter(F.col("seen") >= least_seen)
    return beyond(r, "resist", quantile).filter(F.col("five_rate") <= most_five).select("user_id")


def shrunk_reflection(reflected: DataFrame, m: float = 40.0, least: int = 30, absolute: bool = False) -> DataFrame:
    """Ranking score of reflections(work_id, reflection, degree): the negated value, so that works of readers of
    little known works rise, or the absolute one; shrunk by the number of readers."""
    n = F.col("degree")
    value = F.abs("reflection") if absolute else -F.col("reflection")
    return reflected.filter(n >= least).select("work_id", (value * n / (n + m)).alias("score"), n.cast("double").alias("n_eff"))


def niche_readers(edges: DataFrame, share: float = 0.2, least: int = 50) -> DataFrame:
    """The share of readers, but at least `least`, whose works of edges(user_id, work_id) are the least popular on
    average, ties to the smaller id: user_id."""
    k = edges.groupBy("work_id").agg(F.count(F.lit(1)).alias("k"))
    bias = edges.join(k, "work_id").groupBy("user_id").agg(F.round(F.avg("k"), 9).alias("bias"))
    n = bias.agg(F.greatest(F.floor(F.count(F.lit(1)) * share), F.lit(least)).alias("_keep"))
    return numbered(bias, [F.col("bias"), F.col("user_id")]).crossJoin(F.broadcast(n)).filter(F.col("rank") <= F.col("_keep")).select("user_id")


#: Flags that keep a work out of research rankings.
HYGIENE = ("is_excluded", "is_nonfiction", "is_comic", "is_picture_book", "is_derivative", "is_duplicate", "is_collection")


def top_list(scores: DataFrame, flags: DataFrame, k: int = 2000) -> DataFrame:
    """scores(work_id, score, n_eff) as a list of the first k works without any of the flags; works that flags
    don't know have none. A null score is last."""
    bad = None
    for c in HYGIENE:
        one = F.coalesce(F.col(c), F.lit(False)) if c in flags.columns else F.lit(False)
        bad = one if bad is None else bad | one
    clean = scores.join(flags.filter(bad).select("work_id"), "work_id", "left_anti")
    best = clean.orderBy(F.desc_nulls_last("score"), F.desc("n_eff"), "work_id").limit(k)
    return numbered(best, [F.desc_nulls_last("score"), F.desc("n_eff"), F.col("work_id")]).select(F.col("rank").cast("int").alias("rank"), "work_id", "score", "n_eff")


def bilateral_esteem(focus: DataFrame, anti: DataFrame, shrink: float = 20.0, least: int = 10) -> DataFrame:
    """Win rates of esteem(work_id, wins, losses) of two groups of readers, each shrunk to zero by its size, one
    less the other; works need enough comparisons in both."""
    side = lambda d, p: d.select("work_id", (F.col("wins") + F.col("losses")).alias(f"{p}n"), F.col("wins").alias(f"{p}w")).filter(F.col(f"{p}n") >= least)
    j = side(focus, "c").join(side(anti, "a"), "work_id")
    rate = lambda p: F.col(f"{p}n") / (F.col(f"{p}n") + shrink) * F.col(f"{p}w") / F.col(f"{p}n")
    return j.select("work_id", (rate("c") - rate("a")).alias("score"), F.least("cn", "an").cast("double").alias("n_eff"))
