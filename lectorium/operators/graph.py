"""Fixed points and neighbourhoods of the reader x work graph, as loops of joins and sums.

Each round's vectors are written to the shared folder, so a round costs the same however many went before,
and a lost executor costs one round at most. Norms are one-row aggregates of the written vectors.
Defined results: rows with a null id take no part; repeated edges count as often as they stand; an empty
table of edges gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectorium.functions.numeric import ratio
from lectorium.functions.storage import saved


def _scalar(df: DataFrame, column) -> float:
    return df.agg(column).first()[0] or 0.0


def _length(df: DataFrame, name: str) -> float:
    return _scalar(df, F.sqrt(F.sum(F.col(name) * F.col(name))))


def hits(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """Hubs and authorities of edges(user_id, work_id, w): work_id, authority, of unit length."""
    edges = saved(edges.select("user_id", "work_id", "w"), "hits-edges")
    hub, scale, work = edges.select("user_id").distinct().withColumn("h", F.lit(1.0)), 1.0, None
    for i in range(rounds):
        a = saved(edges.join(hub, "user_id").groupBy("work_id").agg(F.sum(F.col("w") * F.col("h") / F.lit(scale)).alias("a")), "authorities")
        work = a.select("work_id", (F.col("a") / F.lit(_length(a, "a") or 1.0)).alias("authority"))
        if i + 1 < rounds:
            hub = saved(edges.join(work, "work_id").groupBy("user_id").agg(F.sum(F.col("w") * F.col("authority")).alias("h")), "hubs")
            scale = _length(hub, "h") or 1.0
    return work


def reflections(edges: DataFrame, rounds: int = 16) -> DataFrame:
    """Method of reflections over edges(user_id, work_id): each side's mean of the other's last value,
    starting from degrees; works standardised on even rounds. work_id, degree, reflection."""
    edges = saved(edges.select("user_id", "work_id"), "reflection-edges")
    k = edges.groupBy("work_id").agg(F.count(F.lit(1)).cast("double").alias("v"))
    u = edges.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("v"))
    degree = k.withColumnRenamed("v", "degree")
    for i in range(1, rounds + 1):
        k2 = saved(edges.join(u, "user_id").groupBy("work_id").agg(F.avg("v").alias("v")), "reflection-works")
        u2 = edges.join(k, "work_id").groupBy("user_id").agg(F.avg("v").alias("v"))
        if i < rounds:
            u = saved(u2, "reflection-readers")
        if i % 2 == 0:
            m, s = k2.agg(F.avg("v"), F.stddev_pop("v")).first()
            k2 = k2.select("work_id", ((F.col("v") - F.lit(m)) / F.lit(s)).alias("v") if s else F.lit(0.0).alias("v"))
        k = k2
    return k.withColumnRenamed("v", "reflection").join(degree, "work_id")


def core(edges: DataFrame, least_user: int, least_work: int, passes: int = 3) -> DataFrame:
    """edges without readers and works of too few of each other, so many times over."""
    for _ in range(passes):
        users = edges.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_user)
        edges = edges.join(users.select("user_id"), "user_id", "left_semi")
        works = edges.groupBy("work_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_work)
        edges = saved(edges.join(works.select("work_id"), "work_id", "left_semi"), "core")
    return edges


def pmi_neighbours(edges: DataFrame, k: int = 6, least: int = 8, floor: float = 1.25, most: int = 60, cap: int = 30) -> DataFrame:
    """Each work's k nearest by pointwise mutual information of common readers: at least floor, from at least
    `least` of them. Readers of 2 to `most` works make pairs, with their first cap works by id."""
    w = Window.partitionBy("user_id")
    e = edges.select("user_id", "work_id").distinct()
    n = _scalar(e, F.count_distinct("user_id"))
    deg = e.groupBy("work_id").agg(F.count(F.lit(1)).alias("d"))
    few = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("works")).filter(F.col("works").between(2, most)).select("user_id")
    few = e.join(few, "user_id").withColumn("r", F.row_number().over(w.orderBy("work_id"))).filter(F.col("r") <= cap)
    p = few.select("user_id", F.col("work_id").alias("a")).join(few.select("user_id", F.col("work_id").alias("b")), "user_id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= least)
    p = p.join(deg.select(F.col("work_id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("work_id").alias("b"), F.col("d").alias("db")), "b")
    p = p.select("a", "b", "both", F.round(F.ln(F.col("both") * F.lit(float(n)) / (F.col("da") * F.col("db"))), 6).alias("pmi")).filter(F.col("pmi") >= floor)
    both = p.select(F.col("a").alias("work_id"), F.col("b").alias("near"), "both", "pmi").unionByName(p.select(F.col("b").alias("work_id"), F.col("a").alias("near"), "both", "pmi"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("work_id").orderBy(F.desc("pmi"), F.desc("both"), "near"))).filter(F.col("rank") <= k)


def label_propagation(near: DataFrame, rounds: int = 15) -> DataFrame:
    """Communities of near(work_id, near, pmi): every round each work takes the label of most weight around
    it, ties to the smallest. All works move at once, so results don't depend on an order of visits."""
    near = saved(near.select("work_id", "near", "pmi"), "near")
    labels = near.select("work_id").distinct().withColumn("label", F.col("work_id"))
    for _ in range(rounds):
        got = near.join(labels.select(F.col("work_id").alias("near"), "label"), "near").groupBy("work_id", "label").agg(F.round(F.sum("pmi"), 6).alias("w"))
        labels = saved(got.groupBy("work_id").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label")), "labels")
    return labels


def nested_portfolio(near: DataFrame, labels: DataFrame, prestige: DataFrame, least: int = 3, top: int = 50) -> DataFrame:
    """Communities of at least `least` works, and their works interleaved by rank: place, work_id, label, rank.
    First the best of every community, largest community first, then the second of each, and so on."""
    sized = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    r = labels.join(sized, "label").join(prestige, "work_id").withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "work_id")))
    return round_robin(r.select("work_id", "label", "size", "rank"), "label", "size", top)


def round_robin(ranked: DataFrame, group: str, weight: str, top: int) -> DataFrame:
    """ranked(work_id, rank, ...) taken in turns from its groups, heaviest group first: the first top rows
    with their place. Ranks beyond top can't be reached, so the final sort sees few rows."""
    few = ranked.filter(F.col("rank") <= top).orderBy("rank", F.desc(weight), group, "work_id").limit(top)
    return few.withColumn("place", F.row_number().over(Window.orderBy("rank", F.desc(weight), group, "work_id"))).select("place", "work_id", group, "rank")


def power_centrality(near: DataFrame, rounds: int = 12) -> DataFrame:
    """Main direction of the graph near(work_id, near, pmi) by power iteration: work_id, centrality, of unit
    length. Every work starts alike."""
    near = saved(near.select("work_id", "near", "pmi"), "near")
    x, scale = near.select("work_id").distinct().withColumn("x", F.lit(1.0)), 1.0
    for _ in range(rounds):
        x = saved(near.join(x.select(F.col("work_id").alias("near"), "x"), "near").groupBy("work_id").agg(F.sum(F.col("pmi") * F.col("x") / F.lit(scale)).alias("x")), "power")
        scale = _length(x, "x") or 1.0
    return x.select("work_id", (F.col("x") / F.lit(scale)).alias("centrality"))


def attractor(edges: DataFrame, start: DataFrame, rounds: int = 20, beta: float = 2.5, keep: float = 0.35) -> DataFrame:
    """Jury fixed point over edges(user_id, work_id, s) from start(user_id, w): work_id, direction, of unit
    length. Works get the jury's weighted sum of s, squashed by 1.5 of its root mean square; readers' agreement
    with that is standardised and squashed to a target; weights keep a part of the old ones and have mean 1."""
    edges = saved(edges.select("user_id", "work_id", "s"), "jury-edges")
    w = start.select("user_id", "w").join(edges.select("user_id").distinct(), "user_id", "left_semi")
    w = saved(w.crossJoin(F.broadcast(w.agg(F.avg("w").alias("_m")))).select("user_id", (F.col("w") / F.col("_m")).alias("w")), "jury")
    for _ in range(rounds):
        raw = saved(edges.join(w, "user_id").groupBy("work_id").agg(F.sum(F.col("s") * F.col("w")).alias("v")), "jury-works")
        scale = max(1.5 * _scalar(raw, F.sqrt(F.avg(F.col("v") * F.col("v")))), 1e-12)
        books = raw.select("work_id", F.tanh(F.col("v") / F.lit(scale)).alias("b"))
        t = saved(edges.join(books, "work_id").groupBy("user_id").agg(F.sum(F.col("s") * F.col("b")).alias("t")), "jury-signal")
        m, sd = t.agg(F.avg("t"), F.stddev_pop("t")).first()
        z = F.least(F.greatest(F.lit(beta) * (F.col("t") - F.lit(m or 0.0)) / F.lit(max(sd or 0.0, 1e-12)), F.lit(-12.0)), F.lit(12.0))
        target = t.select("user_id", (1.0 / (1.0 + F.exp(-z))).alias("g"))
        mean = _scalar(target, F.avg("g")) or 1.0
        # Both parts have mean 1, so the new weights have, too.
        w = saved(w.join(target, "user_id").select("user_id", (keep * F.col("w") + (1 - keep) * F.col("g") / F.lit(mean)).alias("w")), "jury")
    raw = saved(edges.join(w, "user_id").groupBy("work_id").agg(F.sum(F.col("s") * F.col("w")).alias("v")), "jury-works")
    return raw.select("work_id", (F.col("v") / F.lit(_length(raw, "v") or 1.0)).alias("direction"))


def weighted_preference(edges: DataFrame, weights: DataFrame, shrink: float = 25.0) -> DataFrame:
    """Mean of edges(user_id, work_id, s) by reader weights(user_id, w), shrunk to zero: work_id, score, mass."""
    g = edges.join(weights, "user_id").groupBy("work_id").agg(F.sum(F.col("w") * F.col("s")).alias("t"), F.sum("w").alias("mass"))
    return g.select("work_id", ratio(F.col("t"), F.col("mass") + shrink).alias("score"), "mass")
