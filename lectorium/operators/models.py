"""Reader models: folds, ridge regression, binned odds, matched controls, embeddings and clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectorium.functions.numeric import md5_order, ratio
from lectorium.functions.ranks import ntile
from lectorium.functions.storage import saved


def with_fold(df: DataFrame, key: str, folds: int = 5, seed: str = "fold") -> DataFrame:
    """A fold number from a hash of the key."""
    return df.withColumn("fold", (F.conv(F.substring(md5_order(F.col(key), seed), 1, 8), 16, 10).cast("long") % folds).cast("int"))


def ridge_out_of_fold(df: DataFrame, features: list[str], target: str, folds: int = 5, penalty: float = 1.0) -> DataFrame:
    """Predictions of a ridge regression for rows that it wasn't fitted on. df has fold and an id column
    user_id. Features are standardised and nulls take the mean. One pass sums products per fold; the
    solutions need matrices of the size of the features only, on the driver."""
    names = [*features, target]
    mean = df.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    z = lambda c: (F.coalesce(F.col(c), F.lit(mean[f"m_{c}"] or 0.0)) - F.lit(mean[f"m_{c}"] or 0.0)) / F.lit(mean[f"s_{c}"] or 1.0)
    x = df.select("user_id", "fold", *[z(c).alias(f"z{i}") for i, c in enumerate(features)], (F.col(target) - F.lit(mean[f"m_{target}"])).alias("y"))
    k = len(features)
    sums = x.groupBy("fold").agg(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(F.col(f"z{i}") * F.col("y")).alias(f"b{i}") for i in range(k)]).collect()
    a = {r["fold"]: np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) for r in sums}
    b = {r["fold"]: np.array([r[f"b{i}"] for i in range(k)]) for r in sums}
    predicted = F.lit(None).cast("double")
    for fold in a:
        w = np.linalg.solve(sum((a[f] for f in a if f != fold), np.zeros((k, k))) + penalty * np.eye(k), sum((b[f] for f in b if f != fold), np.zeros(k)))
        predicted = F.when(F.col("fold") == fold, sum((float(w[i]) * F.col(f"z{i}") for i in range(k)), F.lit(float(mean[f"m_{target}"])))).otherwise(predicted)
    return x.select("user_id", "fold", (F.col("y") + F.lit(mean[f"m_{target}"])).alias("actual"), predicted.alias("predicted"))


def fold_profiles(events: DataFrame, labels: DataFrame, shrink: float = 10.0) -> DataFrame:
    """A work's shrunk share of fives among positive readers of all folds but one: totals less the fold's own.
    labels(user_id, fold, positive)."""
    e = events.join(labels.filter("positive").select("user_id", "fold"), "user_id")
    own = e.groupBy("work_id", "fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rating") == 5).alias("n5"))
    folds = labels.select(F.col("fold").alias("fold")).distinct()
    total = own.groupBy("work_id").agg(F.sum("n").alias("tn"), F.sum("n5").alias("t5"))
    prior = own.agg(ratio(F.sum("n5"), F.sum("n")).alias("p0"))
    t = total.crossJoin(F.broadcast(folds)).join(own, ["work_id", "fold"], "left").crossJoin(F.broadcast(prior))
    n, n5 = F.col("tn") - F.coalesce("n", F.lit(0)), F.col("t5") - F.coalesce("n5", F.lit(0))
    return t.select("work_id", "fold", n.alias("n"), ((n5 + shrink * F.col("p0")) / (n + shrink)).alias("share"))


def binned_odds(df: DataFrame, feature: str, positive: str, bins: int = 10, shrink: float = 5.0) -> DataFrame:
    """Log odds of the positives per quantile bin of a feature: bin, n, log_odds."""
    b = ntile(df.filter(F.col(feature).isNotNull()), [F.col(feature), F.col("user_id")], bins, "bin")
    base = b.agg(F.avg(F.col(positive).cast("double")).alias("p0"))
    g = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(positive)).alias("k")).crossJoin(F.broadcast(base))
    p = (F.col("k") + shrink * F.col("p0")) / (F.col("n") + shrink)
    return g.select("bin", "n", (F.ln(p / (1 - p)) - F.ln(F.col("p0") / (1 - F.col("p0")))).alias("log_odds"))


def matched_controls(readers: DataFrame, lovers: DataFrame, bins: int = 10, seed: str = "controls") -> DataFrame:
    """As many other readers per decile of activity as there are lovers in it: user_id, decile, lover."""
    d = ntile(readers, [F.col("n_rated"), F.col("user_id")], bins, "decile").join(lovers.select("user_id").withColumn("lover", F.lit(True)), "user_id", "left").withColumn("lover", F.coalesce("lover", F.lit(False)))
    want = d.filter("lover").groupBy("decile").agg(F.count(F.lit(1)).alias("want"))
    r = d.withColumn("r", F.row_number().over(Window.partitionBy("decile", "lover").orderBy(md5_order(F.col("user_id"), seed), "user_id"))).join(want, "decile")
    return r.filter(F.col("lover") | (F.col("r") <= F.col("want"))).select("user_id", "decile", "lover")


def cohen_d(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Standardised difference of each feature's mean between rows with and without the label."""
    one, two = F.col(label), ~F.col(label)
    aggs = []
    for c in features:
        for s, k in ((one, 1), (two, 0)):
            aggs += [F.avg(F.when(s, F.col(c))).alias(f"m{k}_{c}"), F.var_pop(F.when(s, F.col(c))).alias(f"v{k}_{c}")]
    r = df.agg(*aggs)
    d = lambda c: F.coalesce((F.col(f"m1_{c}") - F.col(f"m0_{c}")) / F.nullif(F.sqrt((F.col(f"v1_{c}") + F.col(f"v0_{c}")) / 2), F.lit(0.0)), F.lit(0.0))
    return r.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), d(c).alias("d")) for c in features])).alias("x")).select("x.*")


def spectral_embedding(rows: DataFrame, vector: str, k: int) -> DataFrame:
    """Scores of each row on the k main directions of array<double> vectors. The Gram matrix of the columns
    is summed over the cluster, so only a matrix of the vectors' length reaches the driver."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("scores", vector_to_array("_p")).drop("_v", "_p")


def spherical_clusters(rows: DataFrame, vector: str, k: int, seed: int = 11) -> DataFrame:
    """k-means by angle: rows with a community number."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="_v", predictionCol="community").fit(v).transform(v).drop("_v")


def fuzzy_pairs(left: DataFrame, right: DataFrame, block: str, text: str, most: int = 2, others: bool = False) -> DataFrame:
    """The nearest right row of each left one within a block by edit distance, if near enough; ties go to the
    smallest id. With others both sides are one table, and no row is its own match.

    Only different texts of lengths that may be near are compared: of rows with equal texts the smallest id is
    the nearest. With others, a text that has two ids is near enough to itself, and only texts of one id are
    compared with the rest, of which each gives its smallest id, or the next where that is the row's own."""
    l, r = left.select(block, F.col("id").alias("l"), F.col(text).alias("lt")), right.select(block, F.col("id").alias("r"), F.col(text).alias("rt"))
    if others:
        l, r = l.filter("l IS NOT NULL"), r.filter("r IS NOT NULL")
    # The least struct, not the least id: a null id comes first, as it does in the last step.
    rights = r.groupBy(block, "rt").agg(F.min(F.struct("r")).alias("r1"))
    rights = rights.select(block, "rt", F.col("r1.r").alias("r1"))
    if others:
        second = r.join(rights, [block, "rt"]).filter("r > r1").groupBy(block, "rt").agg(F.min("r").alias("r2"))
        rights = saved(rights.join(second, [block, "rt"], "left"), "fuzzy-texts")
        lefts = rights.filter("r2 IS NULL").select(block, F.col("rt").alias("lt"), F.col("r1").alias("own"))
        twins = l.join(rights.filter("r2 IS NOT NULL").withColumnRenamed("rt", "lt"), [block, "lt"])
        twins = twins.select("l", F.struct(F.lit(0).alias("d"), F.when(F.col("l") != F.col("r1"), F.col("r1")).otherwise(F.col("r2")).alias("r")).alias("b"))
    else:
        lefts = l.select(block, "lt").distinct()
    spans = lefts.withColumn("_n", F.explode(F.sequence(F.greatest(F.length("lt") - most, F.lit(0)), F.length("lt") + most)))
    j = spans.join(rights.withColumn("_n", F.length("rt")), [block, "_n"]).withColumn("d", F.levenshtein("lt", "rt", most)).filter(F.col("d").between(0, most))
    if others:
        j = j.withColumn("r", F.when(F.col("r1") != F.col("own"), F.col("r1")).otherwise(F.col("r2"))).filter("r IS NOT NULL")
    else:
        j = j.withColumnRenamed("r1", "r")
    best = l.join(j.groupBy(block, "lt").agg(F.min(F.struct("d", "r")).alias("b")), [block, "lt"]).select("l", "b")
    if others:
        best = best.unionByName(twins)
    return best.groupBy("l").agg(F.min("b").alias("b")).select("l", F.col("b.r").alias("r"), F.col("b.d").alias("d"))
