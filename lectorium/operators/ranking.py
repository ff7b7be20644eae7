"""Ranking: one template, 47 methods as data.

A method says whose votes count and with which weight (its audience), and how a work's sums become a
score. All methods share one aggregation, whose columns Catalyst prunes to those that a score reads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectorium.functions.numeric import kish, log10p1, ratio, when_sum
from lectorium.operators.stats import percentile_of
from lectorium.operators.taste import deweight

#: Fixed values of the scores.
PICKY_EXP, RATING_EXP, HIDDEN_SOFT, COMBO_SOFT, CURATOR_SOFT, PICKY_SOFT = 0.9, 3.5, 20000.0, 10000.0, 8000.0, 8000.0
COMBO_SMALL, CURATOR_SMALL, WILSON_Z = 20.0, 12.0, 1.645
LOVE_POWER, HATE_POWER, HATE, TILT_HATE, GAP_MID = 3.2, 2.2, 1.35, 0.45, 0.55
TOP, MID_LOW, BOTTOM, HIGH, PRIOR, TOP_PRIOR, HALF, GEOM_RATIO, GEOM_POWER = 0.88, 0.70, 0.25, 0.60, 0.50, 0.15, 0.50, 2.0, 2.5
LEAST_STINGY = 20


@dataclass(frozen=True)
class Params:
    m: float = 50.0
    coverage: float = 1.0
    picky_max: float = 0.25
    min_n: float = 5.0
    deweight: float = 0.0
    top: int = 200


@dataclass(frozen=True)
class Scope:
    """Priors and the cohort's whole weight, as columns of the aggregated rows."""

    p: Params

    def shrunk(self, mass: Column, total: Column) -> Column:
        return (mass + self.p.m * F.col("p0")) / (total + self.p.m)

    def towards_mean(self, weight: Column, mean: Column) -> Column:
        return weight / (weight + self.p.m) * mean + self.p.m / (weight + self.p.m) * F.col("c0")

    def covered(self, mass: Column) -> Column:
        """Between the score among raters and the one over the whole cohort."""
        u = max(0.0, min(1.0, self.p.coverage))
        return (1.0 - u) * mass / (F.col("w_sum") + self.p.m) + u * mass / (F.col("W") + self.p.m)


def _gem(base: Column, mass: Column, n: Column, soft: float) -> Column:
    return base * log10p1(mass) / (1.0 + n / soft)


def _wilson(five: Column, total: Column) -> Column:
    z, p = WILSON_Z, five / total
    spread = F.sqrt(F.greatest(p * (1 - p) / total + z * z / (4 * total * total), F.lit(0.0)))
    return F.when(total <= 0, 0.0).otherwise((p + z * z / (2 * total) - z * spread) / (1 + z * z / total))


def _asymm_prior(hate: float) -> float:
    return PRIOR**LOVE_POWER - hate * (1 - PRIOR) ** HATE_POWER


def _c(name: str) -> Column:
    return F.col(name).cast("double")


_SCORES: dict[str, Callable[[Scope], Column]] = {
    "five_count": lambda s: _c("n5"),
    "five_rate": lambda s: s.shrunk(_c("n5"), _c("n")),
    "imdb": lambda s: s.towards_mean(_c("n"), _c("mean")),
    "mean": lambda s: (_c("mean") * _c("n") + s.p.m * F.col("c0")) / (_c("n") + s.p.m),
    "picky_mass": lambda s: _c("picky_five_mass"),
    "polarization": lambda s: 4.0 * _c("p5") * _c("p_low"),
    "stddev": lambda s: _c("std"),
    "hidden_gem": lambda s: _gem(s.shrunk(_c("n5"), _c("n")), _c("n"), _c("n"), HIDDEN_SOFT),
    "picky_gem": lambda s: _gem(s.shrunk(_c("n5"), _c("n")), _c("n"), _c("n"), PICKY_SOFT),
    "w_imdb": lambda s: s.towards_mean(_c("w_sum"), ratio(_c("w_rating_sum"), _c("w_sum"))),
    "w_five": lambda s: _c("w_five"),
    "w_five_rate": lambda s: s.shrunk(_c("w_five"), _c("w_sum")),
    "w_liked": lambda s: s.shrunk(_c("w_high"), _c("w_sum")),
    "lit_gem": lambda s: _gem(s.shrunk(_c("w_five"), _c("w_sum")), _c("w_sum"), _c("n"), HIDDEN_SOFT),
    "combo_gem": lambda s: _gem(s.shrunk(_c("w_five"), _c("w_sum")), _c("w_sum"), _c("n"), COMBO_SOFT) * _c("w_sum") / (_c("w_sum") + COMBO_SMALL),
    "combo_love": lambda s: _c("w_five") / F.pow(1.0 + _c("n") / 400.0, F.lit(0.55)),
    "combo_power": lambda s: s.towards_mean(_c("w_power"), ratio(_c("w_power_rating"), _c("w_power"))),
    "combo_wilson": lambda s: _wilson(_c("w_five"), _c("w_sum")) * _c("w_sum") / (_c("w_sum") + COMBO_SMALL),
    "cross": lambda s: F.sqrt(F.greatest(s.shrunk(_c("w_five"), _c("w_sum")), F.lit(0.0)) * F.greatest(s.shrunk(_c("n5_stingy"), _c("n_stingy")), F.lit(0.0))),
    "curator_gem": lambda s: _gem(s.shrunk(_c("w_five"), _c("w_sum")), _c("w_sum"), _c("n"), CURATOR_SOFT) * _c("w_sum") / (_c("w_sum") + CURATOR_SMALL),
    "pct_mean": lambda s: (1 - s.p.coverage) * (_c("w_rating_sum") + s.p.m * PRIOR) / (_c("w_sum") + s.p.m) + s.p.coverage * (_c("w_rating_sum") + F.greatest(F.col("W") - _c("w_sum"), F.lit(0.0)) * PRIOR + s.p.m * PRIOR) / (F.col("W") + s.p.m),
    "pct_love": lambda s: s.covered(_c("w_power") + s.p.m * PRIOR**LOVE_POWER),
    "pct_geom": lambda s: s.covered(_c("w_geom") + s.p.m * HALF**GEOM_POWER),
    "pct_asymm": lambda s: s.covered(_c("w_asymm") + s.p.m * _asymm_prior(HATE)),
    # The prior keeps the harder dislike of pct_asymm; only the votes are softer.
    "pct_tilt": lambda s: s.covered(_c("w_tilt") + s.p.m * _asymm_prior(HATE)),
    "pct_gap": lambda s: s.covered(_c("w_five") - GAP_MID * _c("w_mid") + s.p.m * TOP_PRIOR),
    "pct_top": lambda s: s.covered(_c("w_five") + s.p.m * TOP_PRIOR),
    "pct_gem": lambda s: _gem(s.covered(_c("w_five") + s.p.m * TOP_PRIOR), _c("w_sum"), _c("n"), CURATOR_SOFT) * _c("w_sum") / (_c("w_sum") + CURATOR_SMALL),
}


@dataclass(frozen=True)
class Method:
    audience: str  # all, stingy, lit, combo, cross, or a cohort: star, pure, pct, pct_pure, deep
    score: str


METHODS: dict[str, Method] = (
    {k: Method("all", v) for k, v in {"five_count": "five_count", "five_rate_bayes": "five_rate", "imdb_bayes": "imdb", "mean": "mean", "picky_five": "picky_mass", "polarization": "polarization", "stddev": "stddev", "hidden_gem": "hidden_gem"}.items()}
    | {"picky_five_rate": Method("stingy", "five_rate"), "picky_gem": Method("stingy", "picky_gem")}
    | {k: Method("lit", v) for k, v in {"lit_weighted_mean": "w_imdb", "lit_weighted_five": "w_five", "lit_weighted_five_rate": "w_five_rate", "lit_gem": "lit_gem"}.items()}
    | {f"combo_{k}": Method("combo", v) for k, v in {"five_rate": "w_five_rate", "mean": "w_imdb", "liked": "w_liked", "gem": "combo_gem", "five_mass": "w_five", "love": "combo_love", "power": "combo_power", "wilson": "combo_wilson"}.items()}
    | {"cross_five": Method("cross", "cross")}
    | {f"curator_{pre}{k}": Method(a, v) for pre, a in (("", "star"), ("pure_", "pure")) for k, v in {"five_rate": "w_five_rate", "mean": "w_imdb", "liked": "w_liked", "gem": "curator_gem"}.items()}
    | {f"curator_{pre}pct_{k}": Method(a, f"pct_{k}") for pre, a in (("", "pct"), ("pure_", "pct_pure")) for k in ("love", "asymm", "gap", "top", "gem", "mean")}
    | {"curator_pct_tilt": Method("pct", "pct_tilt")}
    | {f"curator_deep_pct_{k}": Method("deep", f"pct_{k}") for k in ("love", "geom", "tilt")}
)


def aggregate_plain(events: DataFrame) -> DataFrame:
    star = lambda k: F.count_if(F.col("rating") == k)
    n, low = F.count(F.lit(1)), F.count_if(F.col("rating") <= 2)
    return events.groupBy("work_id").agg(
        n.alias("n"), star(5).alias("n5"), F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("std"), (star(5) / n).alias("p5"), (low / n).alias("p_low"), when_sum(F.col("rating") == 5, F.col("picky_weight")).alias("picky_five_mass")
    )


def aggregate_weighted(events: DataFrame, weight: Column, picky_max: float = 0.0) -> DataFrame:
    """Sums of votes of any weight, n being the number of rows."""
    e = events.withColumn("w", weight)
    w, r = F.col("w"), F.col("rating")
    power = w * F.pow(r / 5.0, F.lit(RATING_EXP))
    return e.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w_sum"), F.sum(w * r).alias("w_rating_sum"), when_sum(r == 5, w).alias("w_five"), when_sum(r >= 4, w).alias("w_high"), F.sum(power).alias("w_power"), F.sum(power * r).alias("w_power_rating"),
        F.count_if(F.col("five_rate") <= picky_max).alias("n_stingy"), F.count_if((F.col("five_rate") <= picky_max) & (r == 5)).alias("n5_stingy"),
    )


def aggregate_cohort(events: DataFrame, cohort: DataFrame, strength: float) -> DataFrame:
    """Star sums of a cohort's votes; n is the effective number of equal votes."""
    e = events.join(cohort.select("user_id", deweight(strength).alias("w")), "user_id").filter("w > 0")
    w, r = F.col("w"), F.col("rating")
    return e.groupBy("work_id").agg(kish(w).alias("n"), F.sum("w").alias("w_sum"), F.sum(w * r).alias("w_rating_sum"), when_sum(r == 5, w).alias("w_five"), when_sum(r >= 4, w).alias("w_high"))


def aggregate_percentiles(events: DataFrame, cohort: DataFrame, percentiles: DataFrame, strength: float) -> DataFrame:
    """The same on each reader's own scale."""
    own = percentiles.select("user_id", *[f"pct_{k}" for k in range(1, 6)])
    e = events.join(cohort.select("user_id", deweight(strength).alias("w")), "user_id").filter("w > 0").join(own, "user_id").withColumn("pct", percentile_of())
    w, p, r = F.col("w"), F.col("pct"), F.col("rating")
    love, hate = F.pow(p, F.lit(LOVE_POWER)), F.pow(1.0 - p, F.lit(HATE_POWER))
    stars = F.when(r == 5, GEOM_RATIO**2).when(r == 4, GEOM_RATIO).otherwise(1.0)
    return e.groupBy("work_id").agg(
        kish(w).alias("n"), F.sum("w").alias("w_sum"), F.sum(w * p).alias("w_rating_sum"), when_sum(p >= TOP, w).alias("w_five"), when_sum(p >= HIGH, w).alias("w_high"), when_sum((p >= MID_LOW) & (p < TOP), w).alias("w_mid"), when_sum(p <= BOTTOM, w).alias("w_bottom"),
        F.sum(w * love).alias("w_power"), F.sum(w * (love - HATE * hate)).alias("w_asymm"), F.sum(w * (love - TILT_HATE * hate)).alias("w_tilt"), when_sum((r >= 3) & (p >= HALF), w * stars * F.pow(p, F.lit(GEOM_POWER))).alias("w_geom"),
    )


@dataclass
class Inputs:
    """What ranking needs; cohorts by audience name, taste for literary weights, eligible works if limited."""

    events: DataFrame
    priors: DataFrame
    taste: DataFrame | None = None
    cohorts: dict[str, DataFrame] | None = None
    percentiles: DataFrame | None = None
    works: DataFrame | None = None
    format_weight: DataFrame | None = None


def rank(name: str, x: Inputs, p: Params = Params()) -> DataFrame:
    """The best works by a method: work_id, n, score. Works are limited before votes are summed."""
    method = METHODS[name]
    events = x.events if x.works is None else x.events.join(x.works.select("work_id"), "work_id", "left_semi")
    side = x.priors.select(F.col("p5_all").alias("p0"), F.col("mean_all").alias("c0"))
    kind, least = method.audience, F.col("n") >= p.min_n
    if kind == "all":
        agg = aggregate_plain(events)
    elif kind == "stingy":
        agg = aggregate_plain(events.filter(F.col("five_rate") <= p.picky_max))
        least = least & (F.col("n") >= LEAST_STINGY) if method.score == "picky_gem" else least
    elif kind in ("lit", "combo", "cross"):
        weighted = events.join(x.taste.select("user_id", "lit_weight"), "user_id", "left").withColumn("lit_weight", F.coalesce("lit_weight", F.lit(0.0)))
        weight = F.col("lit_weight") if kind == "lit" else F.col("lit_weight") * F.pow("picky_weight", F.lit(PICKY_EXP))
        if kind == "cross":  # everyone counts for the stingy half; only literary readers weigh
            agg = aggregate_weighted(weighted, F.when(F.col("lit_weight") > 0, weight).otherwise(0.0), p.picky_max)
            least = least & (F.col("n_stingy") >= LEAST_STINGY)
        else:
            agg = aggregate_weighted(weighted.filter("lit_weight > 0"), weight)
        least = least & (F.col("w_sum") >= 1)
    else:
        cohort = x.cohorts[kind]
        agg = aggregate_percentiles(events, cohort, x.percentiles, p.deweight) if kind in ("pct", "pct_pure", "deep") else aggregate_cohort(events, cohort, p.deweight)
        side = side.crossJoin(cohort.agg(F.coalesce(F.sum(deweight(p.deweight)), F.lit(0.0)).alias("W")))
        least = least & (F.col("w_sum") >= 1)
    scored = agg.filter(least).crossJoin(F.broadcast(side)).withColumn("score", _SCORES[method.score](Scope(p)))
    if x.format_weight is not None:
        scored = scored.join(x.format_weight.select("work_id", "format_weight"), "work_id", "left").withColumn("score", F.col("score") * F.coalesce("format_weight", F.lit(1.0)))
    ordered = scored.withColumn("score", F.round("score", 6)).select("work_id", F.round(F.col("n").cast("double"), 6).alias("n"), "score")
    return ordered.orderBy(F.desc_nulls_last("score"), F.desc("n"), "work_id").limit(p.top)


def rank_simple(events: DataFrame, percentiles: DataFrame, cohort: DataFrame, metric: str = "love", scale: str = "adjusted", m: float = 5.0, coverage: float = 0.5, power: float = 3.2, min_n: float = 5.0, top: int = 200) -> DataFrame:
    """The simplified app: metric x scale x cohort(user_id, w). Metrics: love, bayesian, mean, top_rate,
    reads; scales: adjusted (own percentile) or stars (rating / 5)."""
    own = percentiles.select("user_id", *[f"pct_{k}" for k in range(1, 6)])
    e = events.join(cohort.filter("w > 1e-9").select("user_id", "w"), "user_id")
    if scale == "adjusted":
        e = e.join(own, "user_id").withColumn("v", percentile_of()).withColumn("top", F.col("v") >= TOP)
    else:
        e = e.withColumn("v", F.col("rating") / 5.0).withColumn("top", F.col("rating") == 5)
    w, v = F.col("w"), F.col("v")
    agg = e.groupBy("work_id").agg(kish(w).alias("n"), F.sum("w").alias("w_sum"), F.sum(w * v).alias("w_v"), F.sum(w * F.pow(v, F.lit(power))).alias("w_love"), when_sum(F.col("top"), w).alias("w_top"))
    whole = cohort.agg(F.sum("w").alias("W"))
    total = lambda mass: (1 - coverage) * mass / (F.col("w_sum") + m) + coverage * mass / (F.col("W") + m)
    score = {
        "love": total(F.col("w_love") + m * PRIOR**power),
        "bayesian": total(F.col("w_v") + m * PRIOR),
        "mean": ratio(F.col("w_v"), F.col("w_sum")),
        "top_rate": total(F.col("w_top") + m * TOP_PRIOR),
        "reads": F.col("w_sum"),
    }[metric]
    scored = agg.filter(F.col("n") >= min_n).crossJoin(F.broadcast(whole)).select("work_id", F.round("n", 6).alias("n"), F.round(score, 6).alias("score"))
    return scored.orderBy(F.desc_nulls_last("score"), F.desc("n"), "work_id").limit(top)
