"""Reader panels by behaviour, labels by hits, what separates them, and works over many universes of ranking.

Defined results: shares without a denominator are null and take no part in means; works that a universe doesn't
rank have the rank after its last; labels exclude each other; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectorium.functions.numeric import ratio

PANEL = (
    "five_rate", "mean_rating", "n_rated", "n5", "mean_logn_5", "std_logn_5", "depth_ge4", "p5_blockbuster", "series_share_5", "mean_pub_year_5", "n5_midpop_author_books", "n_midpop_authors_5",
    "n_megastar_authors_5", "mid_catalog_share_5", "mega_catalog_share_5", "n_authors_5", "binge_mean_5", "binge_max_5", "author_hhi_5", "singleton_author_share_5", "author_div_5", "midpop_author_frac_5", "midpop_span_per_logn5",
)


def reader_panel(events: DataFrame, rarity: DataFrame, works: DataFrame, least_rated: int = 40, least_five: int = 8, least_big: int = 3, big: float = 0.995, author_band=(2000, 80_000), megastar: int = 50_000, work_band=(500, 15_000), mega: int = 50_000) -> DataFrame:
    """The features of PANEL by reader of events(user_id, work_id, rating): popularity, binges, spread over
    authors, series and years of what got a five. works(work_id, author_id, is_series, pub_year);
    rarity(work_id, n, rarity). Authors are measured by their most rated work."""
    w = rarity.select("work_id", "n", "rarity").join(works.select("work_id", "author_id", "is_series", "pub_year"), "work_id")
    top = w.groupBy("author_id").agg(F.max("n").alias("author_n"))
    cut = rarity.agg(F.percentile("n", big).alias("_big"))
    e = events.select("user_id", "work_id", "rating").join(w.join(top, "author_id"), "work_id").crossJoin(F.broadcast(cut))
    five, hit = F.col("rating") == 5, F.col("n") >= F.col("_big")
    midpop = F.col("author_n").between(*author_band)
    n5 = F.count_if(five)
    book = e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_rated"), n5.alias("n5"), F.avg("rating").alias("mean_rating"), ratio(n5, F.count(F.lit(1))).alias("five_rate"), F.avg(F.when(five, F.ln(1.0 + F.col("n")))).alias("mean_logn_5"), F.stddev_samp(F.when(five, F.ln(1.0 + F.col("n")))).alias("std_logn_5"),
        F.avg(F.when(F.col("rating") >= 4, F.col("rarity"))).alias("depth_ge4"), F.count_if(hit).alias("_seen"), ratio(F.count_if(five & hit), F.count_if(hit)).alias("p5_blockbuster"), ratio(F.count_if(five & F.col("is_series")), n5).alias("series_share_5"),
        F.avg(F.when(five & F.col("pub_year").between(1500, 2020), F.col("pub_year"))).alias("mean_pub_year_5"), F.count_if(five & midpop).alias("n5_midpop_author_books"), ratio(F.count_if(five & F.col("n").between(*work_band)), n5).alias("mid_catalog_share_5"), ratio(F.count_if(five & (F.col("n") >= mega)), n5).alias("mega_catalog_share_5"),
    ).filter((F.col("n_rated") >= least_rated) & (F.col("n5") >= least_five) & (F.col("_seen") >= least_big)).drop("_seen")
    per = e.filter(five).groupBy("user_id", "author_id").agg(F.count(F.lit(1)).alias("k"), F.max("author_n").alias("author_n"))
    author = per.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_authors_5"), F.avg("k").alias("binge_mean_5"), F.max("k").alias("binge_max_5"), ratio(F.sum(F.col("k") * F.col("k")), F.sum("k") * F.sum("k")).alias("author_hhi_5"), ratio(F.count_if(F.col("k") == 1), F.count(F.lit(1))).alias("singleton_author_share_5"),
        F.count_if(midpop).alias("n_midpop_authors_5"), F.count_if(F.col("author_n") >= megastar).alias("n_megastar_authors_5"),
    )
    p = book.join(author, "user_id").withColumn("author_div_5", ratio(F.col("n_authors_5"), F.col("n5"))).withColumn("midpop_author_frac_5", ratio(F.col("n_midpop_authors_5"), F.col("n_authors_5")))
    return p.withColumn("midpop_span_per_logn5", ratio(F.col("n_midpop_authors_5"), F.ln(1.0 + F.col("n5")))).select("user_id", *PANEL)


def hit_labels(events: DataFrame, seeds: DataFrame, classic: int = 6, anti: int = 10, normie: int = 4) -> DataFrame:
    """Readers labelled classic, anti or normie by how many different works of seeds(work_id, kind) got a five:
    the numbers are the least hits, and what a label asks of the others makes the three exclusive."""
    h = events.filter("rating = 5").join(seeds.select("work_id", "kind").distinct(), "work_id").groupBy("user_id").agg(*[F.count_distinct(F.when(F.col("kind") == k, F.col("work_id"))).alias(k) for k in ("classic", "anti", "normie")])
    c, a, n = F.col("classic"), F.col("anti"), F.col("normie")
    label = F.when((c >= classic) & (c >= a) & (c >= n), "classic").when((a >= anti) & (a > c) & (a >= n), "anti").when((n >= normie) & (n > c) & (a < anti), "normie")
    return h.withColumn("label", label).filter("label IS NOT NULL")


def separators(panel: DataFrame, labels: DataFrame, features: list[str], least: float = 0.12) -> DataFrame:
    """Per feature the distance of the classic mean from the anti and the normie one in deviations of all
    readers, its direction, and whether it lies on the same side of both by at least `least`."""
    every = panel.agg(*[F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0)).alias(f"s_{c}") for c in features])
    of = lambda c, k: F.avg(F.when(F.col("label") == k, F.col(c))).alias(f"{k}_{c}")
    means = panel.join(labels.select("user_id", "label"), "user_id").agg(*[of(c, k) for c in features for k in ("classic", "anti", "normie")])
    row = lambda c: F.struct(F.lit(c).alias("feature"), ((F.col(f"classic_{c}") - F.col(f"anti_{c}")) / F.col(f"s_{c}")).alias("d_vs_anti"), ((F.col(f"classic_{c}") - F.col(f"normie_{c}")) / F.col(f"s_{c}")).alias("d_vs_normie"))
    d = means.crossJoin(F.broadcast(every)).select(F.explode(F.array(*[row(c) for c in features])).alias("x")).select("x.*")
    a, n = F.col("d_vs_anti"), F.col("d_vs_normie")
    direction = F.when((a > 0) & (n > 0), 1).when((a < 0) & (n < 0), -1).otherwise(0)
    return d.withColumn("min_abs_d", F.when(a.isNotNull() & n.isNotNull(), F.least(F.abs(a), F.abs(n)))).withColumn("direction", direction).withColumn("separates_both", F.coalesce((a * n > 0) & (F.col("min_abs_d") >= least), F.lit(False)))


def _universe_ranks(ranks: DataFrame, universes: DataFrame, missing: int) -> DataFrame:
    """ranks(universe, work_id, rank) for every work that any universe ranks, those that don't with `missing`. A
    row per work and universe, of which there are few; universes(universe, kind)."""
    ranked = ranks.select("work_id", F.struct("universe", "rank").alias("x")).groupBy("work_id").agg(F.map_from_entries(F.collect_list("x")).alias("m"))
    return ranked.crossJoin(F.broadcast(universes)).select("work_id", "universe", "kind", F.col("m")[F.col("universe")].isNotNull().alias("present"), F.coalesce(F.col("m")[F.col("universe")], F.lit(missing)).alias("rank"))


def universe_summaries(ranks: DataFrame, universes: DataFrame, baseline: str, last: int = 500) -> DataFrame:
    """Each work over the universes of kinds equal, leave_one_out, random and community: median_rank, q10_rank,
    q90_rank, rank_sd and the shares of universes that have it among their first 50, 200 and last (communities
    apart), and the largest fall from its baseline rank when one community is left out."""
    r = _universe_ranks(ranks.filter(F.col("rank") <= last), universes, last + 1)
    own, com, loo = F.col("kind") != "community", F.col("kind") == "community", F.col("kind") == "leave_one_out"
    share = lambda k, c: F.avg(F.when(c, (F.col("rank") <= k).cast("double")))
    base = F.max(F.when((F.col("universe") == baseline) & F.col("present"), F.col("rank")))
    mine = F.when(own, F.col("rank"))
    g = r.groupBy("work_id").agg(
        base.alias("baseline_rank"), F.percentile(mine, 0.5).alias("median_rank"), F.percentile(mine, 0.1).alias("q10_rank"), F.percentile(mine, 0.9).alias("q90_rank"), F.stddev_pop(mine).alias("rank_sd"),
        share(50, own).alias("top50_rate"), share(200, own).alias("top200_rate"), share(last, own).alias("top_rate"), share(200, com).alias("community_top200_rate"), F.max(F.when(loo, F.col("rank"))).alias("_worst"),
    )
    return g.withColumn("max_loo_drop", F.when(F.col("baseline_rank").isNotNull(), F.col("_worst") - F.col("baseline_rank")).cast("double")).drop("_worst")


def distributed_core(summaries: DataFrame, concentration: DataFrame, stable: float = 0.8, community: float = 0.5, most_hhi: float = 0.25, most_drop: float = 100.0) -> DataFrame:
    """Works that stay among the first 200 in most universes: distributed if communities agree, no community
    carries them (concentration(work_id, hhi)) and none can be left out to their ruin; else dependent."""
    s = summaries.filter(F.round("top200_rate", 9) >= stable).join(concentration.select("work_id", "hhi"), "work_id", "left")
    core = (F.round("community_top200_rate", 9) >= community) & (F.round("hhi", 9) <= most_hhi) & (F.col("max_loo_drop") <= most_drop)
    return s.select("work_id", F.when(F.coalesce(core, F.lit(False)), "distributed_core").otherwise("community_dependent").alias("class"), "median_rank", "top200_rate")


def multiverse(ranks: DataFrame, universes: DataFrame, scores: DataFrame, gammas: list[float], central: str, floor: float = 50.0, top: int = 200) -> DataFrame:
    """Each work over universes of kinds jury, pair and gamma: rates of being among the first `top` and of being
    ranked at all, ranges of ranks, the rank in the central universe, the first gamma at which its score in
    scores(work_id, gamma, score) falls below the floor or is missing, and the classes it belongs to. A missing
    rank is one beyond the longest ranking."""
    longest = ranks.agg(F.coalesce(F.max("rank"), F.lit(0)) + 1).first()[0]
    r = _universe_ranks(ranks, universes, int(longest))
    kind = lambda k, v: F.when(F.col("kind") == k, v)
    inside = (F.col("rank") <= top).cast("double")
    aggs = [F.max(F.when((F.col("universe") == central) & F.col("present"), F.col("rank"))).alias("central_rank"), F.avg(inside).alias("cross_rate"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank")]
    for k in ("jury", "pair", "gamma"):
        aggs += [F.avg(kind(k, inside)).alias(f"{k}_rate"), F.avg(kind(k, F.col("present").cast("double"))).alias(f"{k}_present"), (F.max(kind(k, F.col("rank"))) - F.min(kind(k, F.col("rank")))).alias(f"{k}_range")]
    s = scores.groupBy("work_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("gamma").cast("double").alias("gamma"), "score"))).alias("s"))
    g = r.groupBy("work_id").agg(*aggs).join(s, "work_id", "left")
    at = lambda x: F.col("s")[F.lit(float(x))]
    first = F.coalesce(*[F.when(F.coalesce(at(x) < floor, F.lit(True)), F.lit(float(x))) for x in gammas])
    g = g.withColumn("critical_gamma", first).withColumn("central_score", at(gammas[0])).withColumn("_held", at(1.5) >= floor).drop("s")
    two, head = 2.0 / 3.0 - 1e-12, (F.col("central_rank") <= top)
    good = head & (F.col("central_score") >= floor)
    rules = {
        "jointly_robust": good & (F.col("jury_rate") >= two) & (F.col("pair_rate") >= two) & (F.col("cross_rate") >= two) & F.col("_held"),
        "selection_sensitive": good & (F.col("critical_gamma") <= 1.5),
        "jury_sensitive": head & (F.col("jury_present") == 1.0) & (F.col("jury_rate") < two), "jury_evidence_sensitive": head & (F.col("jury_present") < 1.0),
        "pair_sensitive": head & (F.col("pair_present") == 1.0) & (F.col("pair_rate") < two), "pair_evidence_sensitive": head & (F.col("pair_present") < 1.0),
    }
    classes = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]))
    return g.withColumn("classes", F.array_join(classes, ",")).drop("_held")


def author_events(events: DataFrame, works: DataFrame, least: int = 1) -> DataFrame:
    """Readers' votes on authors: best rating, works rated and share of fives by reader and author."""
    a = events.join(works.select("work_id", "author_id"), "work_id").groupBy("user_id", "author_id")
    g = a.agg(F.max("rating").alias("rating"), F.count(F.lit(1)).alias("works"), ratio(F.count_if(F.col("rating") == 5), F.count(F.lit(1))).alias("five_share"))
    return g.filter(F.col("works") >= least)


def partial_spearman(ranks: DataFrame, x: str, y: str, given: str) -> DataFrame:
    """Correlation of two columns of ranks without what a third explains of both: one row."""
    r = ranks.agg(F.corr(x, y).alias("xy"), F.corr(x, given).alias("xz"), F.corr(y, given).alias("yz"), F.count(F.lit(1)).alias("n"))
    rest = F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return r.select("n", ((F.col("xy") - F.col("xz") * F.col("yz")) / F.nullif(rest, F.lit(0.0))).alias("rho"))


def affinity(panel: DataFrame, weights: dict[str, float], gates: dict[str, tuple]) -> DataFrame:
    """Weighted sum of standardised features over readers within hard bounds gates[feature] = (low, high), None
    for no bound: user_id, affinity. A missing feature counts as the mean, but passes no gate."""
    m = panel.agg(*[f(c).alias(f"{p}_{c}") for c in weights for f, p in ((F.avg, "m"), (F.stddev_samp, "s"))])
    z = lambda c: F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0))
    total = reduce(lambda a, b: a + b, [F.lit(float(w)) * z(c) for c, w in weights.items()], F.lit(0.0))
    inside = F.lit(True)
    for c, (low, high) in gates.items():
        inside = inside & F.coalesce((F.col(c) >= low) if low is not None else F.col(c).isNotNull(), F.lit(False)) & F.coalesce((F.col(c) <= high) if high is not None else F.col(c).isNotNull(), F.lit(False))
    return panel.crossJoin(F.broadcast(m)).filter(inside).select("user_id", total.alias("affinity"))
