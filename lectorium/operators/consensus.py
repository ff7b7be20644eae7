"""Consensus over communities of readers: cells, conditional esteem, partitions together, bootstraps.

Defined results: readers without a community and null ids take no part; a community without votes for a work
isn't observed; works that are nowhere valid have null scores; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectorium.functions.numeric import ratio
from lectorium.functions.storage import saved


def cells(votes: DataFrame, communities: DataFrame) -> DataFrame:
    """High and low mass of each work in each community of each partition. votes(user_id, work_id, side,
    mass); communities(user_id, partition, community), or with a membership weight for soft ones."""
    c = communities if "member" in communities.columns else communities.withColumn("member", F.lit(1.0))
    m = F.col("mass") * F.col("member")
    return votes.join(c, "user_id").groupBy("work_id", "partition", "community").agg(F.sum(F.when(F.col("side") == 1, m).otherwise(0.0)).alias("high"), F.sum(F.when(F.col("side") == -1, m).otherwise(0.0)).alias("low"))


def posterior(cells: DataFrame, prior: float = 4.0, cap: float = 30.0, least_readers: float = 3.0, gamma: float = 1.0) -> DataFrame:
    """Each observed cell's Beta posterior: p and post_var. Wins and losses are scaled down together to the
    evidence cap before the neutral prior is added. With gamma above 1 the odds are divided by it, and the
    variance follows by the derivative. Cells of fewer than least_readers are left out."""
    n = F.col("high") + F.col("low")
    scale = F.least(F.lit(1.0), F.lit(cap) / F.greatest(n, F.lit(1.0)))
    c = cells.filter(F.round(n, 9) >= least_readers).withColumn("_a", F.col("high") * scale + prior / 2).withColumn("_b", F.col("low") * scale + prior / 2)
    t = F.col("_a") + F.col("_b")
    c = c.withColumn("p", F.col("_a") / t).withColumn("post_var", F.col("_a") * F.col("_b") / (t * t * (t + 1.0)))
    if gamma > 1.0:
        c = c.withColumn("_q", F.col("p") / (gamma - (gamma - 1.0) * F.col("p")))
        slope = F.col("_q") * (1 - F.col("_q")) / F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-9))
        c = c.withColumn("post_var", F.col("post_var") * slope * slope).withColumn("p", F.col("_q")).drop("_q")
    return c.drop("_a", "_b")


def conditional_esteem(cells: DataFrame, communities: DataFrame, prior: float = 4.0, cap: float = 30.0, least_readers: float = 3.0, least_total: float = 30.0, gamma: float = 1.0) -> DataFrame:
    """Per work and partition the equal mean mu over observed communities, the spread tau between them beyond
    their posterior variance, score mu - 1.2816 tau, its standard error, coverage, and whether it is valid:
    max(3, a quarter of the communities) observed and least_total votes. communities(partition, k)."""
    whole = cells.groupBy("work_id", "partition").agg(F.sum(F.col("high") + F.col("low")).alias("votes"))
    g = posterior(cells, prior, cap, least_readers, gamma).groupBy("work_id", "partition").agg(
        F.count(F.lit(1)).alias("observed"), F.avg("p").alias("mu"), F.avg(F.col("p") * F.col("p")).alias("second"), F.avg("post_var").alias("post_var")
    )
    g = whole.join(g, ["work_id", "partition"], "left").join(communities, "partition").withColumn("observed", F.coalesce("observed", F.lit(0)).cast("long"))
    m = F.col("observed")
    spread = F.greatest(F.col("second") - F.col("mu") * F.col("mu"), F.lit(0.0)) * F.when(m > 1, m / (m - 1)).otherwise(0.0)
    g = g.withColumn("tau2", F.greatest(spread - F.col("post_var"), F.lit(0.0))).withColumn("tau", F.sqrt("tau2"))
    g = g.withColumn("score", F.col("mu") - 1.2816 * F.col("tau")).withColumn("se", F.sqrt((F.col("tau2") + F.col("post_var")) / m)).withColumn("coverage", m / F.col("k"))
    valid = (m >= F.greatest(F.lit(3), F.ceil(F.col("k") * 0.25))) & (F.round("votes", 9) >= least_total)
    blank = [F.when(valid, F.col(c)).alias(c) for c in ("mu", "tau", "score", "se")]
    return g.select("work_id", "partition", "observed", "votes", "coverage", valid.alias("valid"), *blank)


def combine_partitions(scores: DataFrame, partitions: int, least_valid: float = 2 / 3, least_coverage: float = 0.5) -> DataFrame:
    """A work over all partitions: means over the valid ones, spread between them, the uncertainty of both,
    mean coverage; estimable if enough partitions are valid, eligible if coverage suffices, too."""
    g = scores.groupBy("work_id").agg(
        F.count("score").alias("valid"), F.avg("score").alias("score"), F.avg("mu").alias("mu"), F.avg("tau").alias("tau"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd"), F.avg("se").alias("se"), (F.sum("coverage") / partitions).alias("coverage")
    )
    g = g.withColumn("uncertainty", F.sqrt(F.col("se") * F.col("se") + F.col("sd") * F.col("sd"))).filter(F.col("valid") / partitions >= least_valid)
    return g.withColumn("eligible", F.col("coverage") >= least_coverage)


def concentration(cells: DataFrame) -> DataFrame:
    """How far one community carries a work: the normalised sum of squared shares of high mass."""
    w = Window.partitionBy("work_id", "partition")
    share = ratio(F.col("high"), F.sum("high").over(w))
    g = cells.withColumn("s", share).groupBy("work_id", "partition").agg(F.sum(F.col("s") * F.col("s")).alias("hhi"), F.count(F.lit(1)).alias("k"))
    return g.withColumn("concentration", F.when(F.col("k") > 1, (F.col("hhi") - 1.0 / F.col("k")) / (1 - 1.0 / F.col("k"))).otherwise(1.0)).select("work_id", "partition", "hhi", "concentration")


def leave_one_out(cells: DataFrame) -> DataFrame:
    """The share of high mass without each community in turn, and the largest fall by that."""
    w = Window.partitionBy("work_id", "partition")
    whole = ratio(F.sum("high").over(w), F.sum(F.col("high") + F.col("low")).over(w))
    rest = ratio(F.sum("high").over(w) - F.col("high"), F.sum(F.col("high") + F.col("low")).over(w) - F.col("high") - F.col("low"))
    return cells.select("work_id", "partition", (whole - rest).alias("fall")).groupBy("work_id", "partition").agg(F.max("fall").alias("largest_fall"))


def uniform(seed: str, *keys):
    """A number of [0, 1) from a hash: the same at every run and on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[k.cast("string") for k in keys], F.lit(seed))), 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson_count(u):
    """The Poisson(1) count, 8 at most, at a number of [0, 1)."""
    out, p, total = F.lit(0), 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        out = F.when(u >= total, k + 1).otherwise(out)
        p /= k + 1
    return out


def poisson_weight(seed: str, *keys):
    return poisson_count(uniform(seed, *keys))


#: Replicates that one pass over the votes sums, each in two columns.
PASS = 40


def bootstrap(votes: DataFrame, replicates: int, seed: str = "boot") -> DataFrame:
    """Reader bootstrap of the share of high mass: work_id, mean, sd, low and high ends of 80 %. Readers are
    weighted per replicate by a hash, drawn once a reader. A pass sums many replicates side by side, so a vote
    isn't multiplied into a row for each, and sums are pre-aggregated by work."""
    numbers = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda rep: uniform(seed, F.col("user_id"), rep))
    counts = F.transform(numbers, lambda u: poisson_count(u).cast("byte"))  # each hash is taken once
    # As many parts as shuffles have, however few bytes the readers are: each takes many hashes. A work's votes
    # lie together, so that a pass shuffles its wide sums once a work, not once a work and task.
    parts = int(votes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = votes.select("user_id").distinct().repartition(parts, "user_id").withColumn("ks", counts)
    joined = saved(votes.select("user_id", "work_id", "side", "mass").join(drawn, "user_id").drop("user_id").repartition(parts, "work_id"), "drawn-votes")
    out = None
    for first in range(0, replicates, PASS):
        reps = range(first, min(first + PASS, replicates))
        m = lambda r: F.col("mass") * F.get("ks", F.lit(r))
        g = joined.groupBy("work_id").agg(*[F.sum(m(r)).alias(f"t{r}") for r in reps], *[F.sum(F.when(F.col("side") == 1, m(r)).otherwise(0.0)).alias(f"h{r}") for r in reps])
        one = g.select("work_id", F.explode(F.array(*[ratio(F.col(f"h{r}"), F.col(f"t{r}")) for r in reps])).alias("share")).filter("share IS NOT NULL")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("work_id").agg(F.avg("share").alias("mean"), F.stddev_samp("share").alias("sd"), F.percentile("share", 0.1).alias("low"), F.percentile("share", 0.9).alias("high"))


def _all_within(ranks, top: int):
    return F.forall(ranks, lambda r: F.coalesce(r <= top, F.lit(False)))


def tier(e: dict, top: int = 200, floor: float = 50.0):
    """stable_core, supported_boundary or underexposed_or_contested. e has columns pair_mass, joint_rate, ranks,
    membership_ranks and feature_ranks (arrays; a null rank is out of the ranking), boundary_rank, fixed_rate,
    community_status and gamma2_score."""
    present = lambda r: (F.size(r) > 0) & _all_within(r, top)
    survives = _all_within(e["ranks"], top) & present(e["membership_ranks"]) & present(e["feature_ranks"]) & F.coalesce(e["boundary_rank"] <= top, F.lit(False))
    held = survives & (e["community_status"] == "broadly_stable") & (e["gamma2_score"] >= floor)
    core = held & (e["pair_mass"] >= 20) & (e["joint_rate"] >= 0.8) & (e["fixed_rate"] >= 0.8)
    return F.when(core, "stable_core").when(held & (e["joint_rate"] >= 0.5) & (e["fixed_rate"] >= 0.5), "supported_boundary").otherwise("underexposed_or_contested")


def worst_reweighting(values: DataFrame, most: float = 2.0) -> DataFrame:
    """The least mean of values(work_id, partition, community, p) under weights whose greatest is at most `most`
    times the least: the m smallest values weigh more, for the worst m."""
    a = Window.partitionBy("work_id", "partition")
    w = a.orderBy("p", "community").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m, k, low, total = F.count(F.lit(1)).over(w), F.count(F.lit(1)).over(a), F.sum("p").over(w), F.sum("p").over(a)
    choice = F.when(m < k, (most * low + total - low) / (m * most + k - m)).otherwise(total / k)
    return values.select("work_id", "partition", F.least(choice, total / k).alias("v")).groupBy("work_id", "partition").agg(F.min("v").alias("worst"))
