"""Reader taste and the five curator cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectorium.functions.ranks import numbered, percent_rank
from lectorium.functions.numeric import ratio, share_rounded


def author_likes(events: DataFrame, works: DataFrame, authors: DataFrame) -> DataFrame:
    """Per reader and signal author: n_liked (4 or 5 stars), n_five."""
    signal = works.select("work_id", "author_id").join(authors, "author_id")
    return events.filter("rating >= 4").join(signal, "work_id").groupBy("user_id", "author_id", "side", "prestige").agg(F.count(F.lit(1)).alias("n_liked"), F.count_if(F.col("rating") == 5).alias("n_five"))


def user_taste(likes: DataFrame) -> DataFrame:
    """lit_hits, com_hits, lit_mass, their shares and lit_weight of each reader with any hit."""
    literary, commercial = F.col("side") != "non_literary", F.col("side") == "non_literary"
    t = likes.groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(literary, F.col("n_liked"))), F.lit(0)).alias("lit_hits"),
        F.coalesce(F.sum(F.when(commercial, F.col("n_five"))), F.lit(0)).alias("com_hits"),
        F.coalesce(F.sum(F.when(literary, F.col("prestige") * F.col("n_liked"))), F.lit(0.0)).alias("lit_mass"),
    )
    both = F.col("lit_hits") + F.col("com_hits")
    t = t.filter(both > 0).withColumn("lit_share", ratio(F.col("lit_hits"), both)).withColumn("com_share", ratio(F.col("com_hits"), both))
    return t.withColumn("lit_weight", F.greatest(F.lit(0.0), F.col("lit_share")) * F.ln(1 + F.col("lit_mass")))


def poll_works(stats: DataFrame, works: DataFrame, authors: DataFrame) -> DataFrame:
    """Works of poll authors with n, prestige and rarity 1 / ln(2 + n)."""
    poll = authors.filter("side = 'literary_poll'").select("author_id", "prestige")
    return works.join(poll, "author_id").join(stats.select("work_id", "n"), "work_id").select("work_id", "n", "prestige", (1.0 / F.ln(2 + F.col("n"))).alias("rarity"))


def _boost(mass: Column) -> Column:
    return F.pow(F.ln(1.0 + mass * 5.0), F.lit(1.35))


def _poll_hits(events: DataFrame, poll: DataFrame, hist: DataFrame, least_stars: int) -> DataFrame:
    """Each reader's poll works: number, rarity mass, rare ones (no more popular than the median), loved ones."""
    middle = poll.agg(F.median("n").alias("middle"))
    p = poll.crossJoin(F.broadcast(middle))
    return (
        events.filter(F.col("rating") >= least_stars).join(p, "work_id").join(hist.select("user_id", "max_star"), "user_id").groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("n_poll_works"),
            F.sum(F.col("rarity") * F.col("prestige")).alias("rarity_mass"),
            F.count_if(F.col("n") <= F.col("middle")).alias("n_rare_poll"),
            F.count_if((F.col("rating") == F.col("max_star")) | (F.col("rating") >= 4)).alias("n_poll_loved"),
        )
    )


def _ranked(df: DataFrame, weight: str = "weight") -> DataFrame:
    """weight_pctile: the share of the cohort's readers below."""
    return percent_rank(df, weight, "weight_pctile")


def _against_max(df: DataFrame, boost: str, base: Column, fixed: float, moving: float) -> DataFrame:
    """df with weight: base, part of it by the boost against the greatest, a one-row side."""
    most = df.agg(F.nullif(F.max(boost), F.lit(0.0)).alias("_most"))
    return df.crossJoin(F.broadcast(most)).withColumn("weight", base * (fixed + moving * F.col(boost) / F.col("_most"))).drop("_most")


def star_curators(events: DataFrame, taste: DataFrame, pickiness: DataFrame, hist: DataFrame, poll: DataFrame, least_lit=4, least_rated=40, least_poll=5, least_rare=1) -> DataFrame:
    """Readers of literary works whose own ratings are moderate."""
    hits = _poll_hits(events, poll, hist, 4).drop("n_poll_loved")
    b = taste.join(pickiness.select("user_id", "n_rated", "five_rate"), "user_id").join(hist.select("user_id", "mean_rating", "c5"), "user_id").join(hits, "user_id", "left")
    b = b.fillna(0, ["n_poll_works", "rarity_mass", "n_rare_poll"]).filter((F.col("lit_hits") >= least_lit) & (F.col("com_hits") <= F.greatest(F.lit(3), share_rounded(F.col("lit_hits"), 350))) & (F.col("n_rated") >= least_rated) & (F.col("c5") >= 1))
    near = F.when(F.col("five_rate").between(0.10, 0.42) & F.col("mean_rating").between(3.05, 4.05), 1.0).when(F.col("five_rate").between(0.08, 0.50) & F.col("mean_rating").between(2.95, 4.15), 0.55).otherwise(0.0)
    b = b.withColumn("gate", near).withColumn("boost", _boost(F.col("rarity_mass")))
    b = _against_max(b, "boost", F.col("gate") * F.col("lit_weight"), 0.35, 0.65)
    return _ranked(b.filter((F.col("gate") >= 0.55) & (F.col("n_poll_works") >= least_poll) & (F.col("n_rare_poll") >= least_rare)))


def pct_curators(events: DataFrame, taste: DataFrame, pickiness: DataFrame, hist: DataFrame, percentiles: DataFrame, poll: DataFrame, least_lit=2, least_rated=25, least_poll=2, least_loved=1) -> DataFrame:
    """Readers of literary works, judged by their own scale."""
    b = taste.join(pickiness.select("user_id", "n_rated", "five_rate"), "user_id").join(hist.select("user_id", "mean_rating", "c5", "max_star"), "user_id").join(percentiles.select("user_id", "n_levels", "source"), "user_id").join(_poll_hits(events, poll, hist, 3), "user_id")
    b = b.filter((F.col("lit_hits") >= least_lit) & (F.col("com_hits") <= F.greatest(F.lit(5), share_rounded(F.col("lit_hits"), 650))) & (F.col("n_rated") >= least_rated) & (F.col("n_levels") >= 2) & (F.col("n_poll_works") >= least_poll) & (F.col("n_poll_loved") >= least_loved))
    b = b.withColumn("boost", _boost(F.col("rarity_mass")))
    return _ranked(_against_max(b, "boost", F.col("lit_weight"), 0.30, 0.70).filter("weight > 0"))


def pure_curators(curators: DataFrame, least_share=0.55, least_net=0.20, least_poll=0, least_lit=0) -> DataFrame:
    """Those of a cohort who read hardly anything commercial, weighted by how pure they are."""
    both = F.col("lit_hits") + F.col("com_hits")
    p = curators.filter(
        (F.col("lit_share") >= least_share) & (F.col("com_hits") <= F.greatest(F.lit(1), share_rounded(F.col("lit_hits"), 180))) & (ratio(F.col("lit_hits") - F.col("com_hits"), both) >= least_net) & (F.col("n_poll_works") >= least_poll) & (F.col("lit_hits") >= least_lit)
    )
    pure = F.pow(F.greatest(F.col("lit_share"), F.lit(0.01)), F.lit(1.25)) * F.pow(F.greatest(1.0 - F.coalesce(ratio(F.col("com_hits"), both), F.lit(0.0)), F.lit(0.05)), F.lit(2.0))
    return _ranked(p.drop("weight_pctile").withColumn("weight", F.col("weight") * pure).filter("weight > 0"))


def deep_curators(events: DataFrame, pct: DataFrame, deep: DataFrame, common: DataFrame, min_deep=3, min_rare=1, min_share=0.5, share_exp=1.8, mix=0.9, max_com=0.35, com_exp=3.0) -> DataFrame:
    """Those of the pct cohort who love poll works beyond the ones that everybody reads."""
    cut = deep.agg(F.percentile("n", 0.55).alias("cut"))
    liked = events.filter("rating >= 4")
    d = liked.join(deep.crossJoin(F.broadcast(cut)), "work_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_deep"), F.count_if(F.col("n") <= F.col("cut")).alias("n_deep_rare"), F.sum(F.col("rarity") * F.col("prestige")).alias("deep_mass"))
    c = liked.join(common.select("work_id"), "work_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_common"))
    b = pct.withColumnRenamed("weight", "base_weight").drop("weight_pctile", "boost", "com_share").join(d, "user_id").join(c, "user_id", "left").fillna(0, ["n_common"])
    b = b.withColumn("deep_share", ratio(F.col("n_deep"), F.col("n_deep") + F.col("n_common"))).withColumn("com_share", ratio(F.col("com_hits"), F.col("lit_hits") + F.col("com_hits")))
    b = b.filter((F.col("n_deep") >= min_deep) & (F.col("n_deep_rare") >= min_rare) & (F.col("deep_share") >= min_share) & (F.col("com_share") <= max_com)).withColumn("boost", _boost(F.col("deep_mass")))
    base = F.col("base_weight") * F.pow(F.greatest(F.col("deep_share"), F.lit(0.05)), F.lit(share_exp)) * F.pow(F.greatest(1.0 - F.col("com_share"), F.lit(0.02)), F.lit(com_exp))
    return _ranked(_against_max(b, "boost", base, 1.0 - mix, mix).filter("weight > 0"))


def percent_clamped(x: float) -> float:
    return max(0.0, min(1.0, x / 100.0))


def elite(cohort: DataFrame, strictness: float, least: int = 100) -> DataFrame:
    """The best K of a cohort of n by weight, K = ceil(n^(1-t) min(least, n)^t); all at strictness 0. The
    count is a broadcast one-row side; ranks come from a total order."""
    t = percent_clamped(strictness)
    if t == 0:
        return cohort
    n = cohort.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double").alias("_n"))
    keep = F.ceil(F.round(F.pow(F.col("_n"), F.lit(1 - t)) * F.pow(F.least(F.col("_n"), F.lit(float(least))), F.lit(t)), 9))
    ranked = numbered(cohort, [F.desc("weight"), F.col("user_id")], "_r")
    return ranked.crossJoin(F.broadcast(n)).filter(F.col("_r") <= keep).drop("_r", "_n")


def deweight(strength: float) -> Column:
    """A vote's weight from the cohort weight and its percentile: equal at 0, steep at 100."""
    t = percent_clamped(strength)
    return F.pow(F.col("weight"), F.lit(4.0 * t)) * F.exp(-8.0 * t * (1.0 - F.col("weight_pctile"))) if t else F.lit(1.0)


def volume_gates(strictness: float, pct: bool) -> Column:
    """Floors on ratings, poll works, rare works and literary hits, and a ceiling on commercial ones."""
    t = percent_clamped(strictness)
    if t == 0:
        return F.lit(True)
    rated, poll, rare, lit, start, slope = (100, 8, 3, 8, 0.90, 0.55) if pct else (120, 10, 4, 10, 0.75, 0.50)
    least = {"n_rated": rated, "n_poll_works": poll, "n_rare_poll": rare, "lit_hits": lit}
    out = F.col("com_hits") <= F.col("lit_hits") * (start - t * slope)
    for c, most in least.items():
        out = out & (F.col(c) >= int(round(t * most)))
    return out


def purity_gate(purity: float) -> Column:
    """At least a share of literary hits, at most a share of commercial ones."""
    t = percent_clamped(purity)
    return F.lit(True) if t == 0 else (F.col("lit_share") >= 0.80 * t) & (F.coalesce(ratio(F.col("com_hits"), F.col("lit_hits") + F.col("com_hits")), F.lit(0.0)) <= 1.0 - 0.92 * t)


def depth_floor(depth: float) -> tuple[int, int]:
    """How many deep works, and how many rare ones of them, a depth slider asks for."""
    t = percent_clamped(depth)
    if t == 0:
        return 0, 0
    least = round(30.0**t)
    return least, round(least * (0.15 + 0.25 * t))


def taste_eligible(taste: DataFrame, min_lit_share=0.0, max_com_share=1.0, min_net=-1.0, min_lit_hits=0, max_com_hits=1 << 40) -> DataFrame:
    """Readers within the sliders of the taste filter."""
    net = ratio(F.col("lit_hits") - F.col("com_hits"), F.col("lit_hits") + F.col("com_hits"))
    return taste.filter((F.col("lit_share") >= min_lit_share) & (F.col("com_share") <= max_com_share) & (net >= min_net) & (F.col("lit_hits") >= min_lit_hits) & (F.col("com_hits") <= max_com_hits))
