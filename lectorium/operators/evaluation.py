"""How rankings agree, and how well they find what they should."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectorium.functions.ranks import numbered
from lectorium.functions.storage import saved


def ranked(df: DataFrame, score: str, key: str = "work_id") -> DataFrame:
    """A ranking(work_id, rank) of all rows by falling score, ties to the smaller key."""
    return numbered(df.select(key, score), [F.desc(score), F.col(key)]).select(key, F.col("rank").cast("int").alias("rank"))


def _running(df: DataFrame, at: str, value: str) -> DataFrame:
    """df with value summed up to each row in the order of at, a unique number: sums within ranges, then the
    totals of the ranges before."""
    dealt = saved(df.repartitionByRange(F.col(at)).withColumn("_p", F.spark_partition_id()), "running")
    total, before = 0, {}
    for r in sorted(dealt.groupBy("_p").agg(F.min(at).alias("first"), F.sum(value).alias("s")).collect(), key=lambda r: r["first"]):
        before[r["_p"]] = total
        total += r["s"] or 0
    if not before:
        return dealt.drop("_p")
    offset = F.create_map(*[F.lit(x) for p, k in before.items() for x in (p, k)])[F.col("_p")]
    return dealt.withColumn(value, F.sum(value).over(Window.partitionBy("_p").orderBy(at)) + offset).drop("_p")


def overlap_at(a: DataFrame, b: DataFrame, ks: list[int]) -> DataFrame:
    """Jaccard overlap of the first k of two rankings(work_id, rank)."""
    j = a.select("work_id", F.col("rank").alias("ra")).join(b.select("work_id", F.col("rank").alias("rb")), "work_id", "full")
    k = j.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    both = F.count_if((F.col("ra") <= F.col("k")) & (F.col("rb") <= F.col("k")))
    either = F.count_if((F.col("ra") <= F.col("k")) | (F.col("rb") <= F.col("k")))
    return k.groupBy("k").agg(both.alias("common"), F.try_divide(both, either).alias("jaccard"))


def rank_biased_overlap(a: DataFrame, b: DataFrame, p: float = 0.98) -> DataFrame:
    """Rank-biased overlap of two rankings of equal length: one row. The depth at which a work is common is
    the greater of its ranks, so agreement at each depth is a running count."""
    depth = a.select("work_id", F.col("rank").alias("ra")).join(b.select("work_id", F.col("rank").alias("rb")), "work_id").select(F.greatest("ra", "rb").alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("new"))
    every = a.select(F.col("rank").alias("d")).join(depth, "d", "left")
    every = _running(every.select("d", F.coalesce("new", F.lit(0)).alias("new")), "d", "new").withColumn("agree", F.col("new") / F.col("d"))
    last = F.max_by("agree", "d") * F.pow(F.lit(p), F.max("d"))
    return every.agg(((1 - p) * F.sum(F.col("agree") * F.pow(F.lit(p), F.col("d") - 1)) + last).alias("rbo"))


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rank correlation over the works that both rankings have: one row."""
    j = a.select("work_id", F.col("rank").alias("x")).join(b.select("work_id", F.col("rank").alias("y")), "work_id")
    j = numbered(numbered(j, [F.col("x"), F.col("work_id")], "_x"), [F.col("y"), F.col("work_id")], "_y").select(F.col("_x").cast("double").alias("x"), F.col("_y").cast("double").alias("y"))
    n = F.count(F.lit(1)).cast("double")
    return j.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) > 1, 1 - 6 * F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))) / (n * (n * n - 1))).alias("rho"))


def precision_recall(ranked: DataFrame, wanted: DataFrame, ks: list[int]) -> DataFrame:
    """Hits among the first k of a ranking(work_id, rank), with precision and recall."""
    hit = ranked.join(wanted.select("work_id").distinct().withColumn("hit", F.lit(1)), "work_id", "left")
    total = wanted.agg(F.count_distinct("work_id").alias("total"))
    k = hit.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter(F.col("rank") <= F.col("k")).groupBy("k").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))
    return k.crossJoin(F.broadcast(total)).select("k", "hits", (F.col("hits") / F.col("k")).alias("precision"), F.try_divide(F.col("hits"), F.col("total")).alias("recall"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Average precision and area under the ROC curve of scored(id, score, positive): one row. Ranks come
    from one sort of a candidate list; equal scores share their mean rank in the area."""
    s = numbered(scored.select("id", "score", "positive"), [F.desc("score"), F.col("id")], "r")
    s = _running(s.withColumn("h", F.col("positive").cast("long")), "r", "h")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    tied = s.crossJoin(F.broadcast(n)).withColumn("t", F.col("n") + 1 - F.col("r"))  # places from below
    s = tied.join(tied.groupBy("score").agg(F.avg("t").alias("m")), "score")
    pos, neg = F.count_if("positive").cast("double"), F.count_if(~F.col("positive")).cast("double")
    auc = (F.sum(F.when(F.col("positive"), F.col("m"))) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0.0))
    return s.agg(F.avg(F.when(F.col("positive"), F.col("h") / F.col("r"))).alias("average_precision"), auc.alias("auc"))


def pareto_front(points: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no other beats in both x and y (greater is better). Only the best y of each x can stay, and
    it does if it beats all of greater x: running maxima within ranges of x and over the ranges above, instead
    of all pairs."""
    best = points.groupBy(x).agg(F.max(y).alias(y))
    dealt = saved(best.repartitionByRange(F.desc(x)).withColumn("_p", F.spark_partition_id()), "front")
    above, top = {}, None
    for r in sorted(dealt.groupBy("_p").agg(F.max(x).alias("x"), F.max(y).alias("y")).collect(), key=lambda r: r["x"], reverse=True):
        above[r["_p"]] = top
        top = r["y"] if top is None else max(top, r["y"])
    if not above:
        return points.limit(0)
    w = Window.partitionBy("_p").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)
    kind = best.schema[y].dataType
    ahead = F.create_map(*[v for p, k in above.items() for v in (F.lit(p), F.lit(k).cast(kind))])[F.col("_p")]
    m = F.greatest(F.max(y).over(w), ahead)
    front = dealt.withColumn("_m", m).filter(F.col("_m").isNull() | (F.col(y) > F.col("_m"))).select(x, y)
    return points.join(front, [x, y], "left_semi")


def utopia_distance(front: DataFrame, x: str, y: str) -> DataFrame:
    """front with distance: how far a row is from the best x and y together, both scaled to their ranges; an
    axis without a range counts as reached."""
    span = front.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    part = lambda c, lo, hi: F.coalesce((F.col(hi) - F.col(c)) / F.nullif((F.col(hi) - F.col(lo)).cast("double"), F.lit(0.0)), F.lit(0.0))
    a, b = part(x, "_x0", "_x1"), part(y, "_y0", "_y1")
    return front.crossJoin(F.broadcast(span)).withColumn("distance", F.sqrt(a * a + b * b)).drop("_x0", "_x1", "_y0", "_y1")


def parity_split(ranked: DataFrame) -> DataFrame:
    """ranked(work_id, rank) with part: odd ranks are seeds, even ones are held out."""
    return ranked.withColumn("part", F.when(F.col("rank") % 2 == 1, "seed").otherwise("held_out"))


def author_split(works: DataFrame, author: str = "author_id") -> DataFrame:
    """works with part by the sum of the character codes of its author's id, modulo 2: an author's works stay
    together. A null author is an empty one."""
    codes = F.transform(F.split(F.coalesce(F.col(author).cast("string"), F.lit("")), ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c)))
    return works.withColumn("part", (F.aggregate(codes, F.lit(0), lambda a, c: a + c) % 2).cast("int"))


def dense_index(df: DataFrame, key: str, name: str = "index") -> DataFrame:
    """The different keys with their place from 0 in ascending order."""
    return numbered(df.select(key).distinct(), [F.col(key)], name).withColumn(name, F.col(name) - 1)
