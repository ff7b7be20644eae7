"""Cohorts by sliders: how pure and how steep, from stored curator scores or from a pack of authors.

Defined results: at purity 0 nobody is left out, at deweight 0 all weigh 1; readers without a stored score
weigh next to nothing as soon as weights count; an empty pack makes all readers equal.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectorium.functions.numeric import ratio

#: Ends of the sliders, floors of the stored scores, exponents, and the weight of no score.
EXPONENT_MAX, ALPHA_MAX, SHARE_MAX, COM_FLOOR = 4.0, 8.0, 0.80, 0.08
MINT_SHARE, MINT_COM, DEEP_EXP, COM_EXP, MISSING = 0.35, 0.20, 1.8, 3.0, 1e-8
EPS = 1e-12


def slider(x) -> float:
    """0 to 1 of a slider from 0 to 100; what is beyond counts as its end."""
    return max(0.0, min(100.0, float(x))) / 100.0


def share_floor(purity: float) -> float:
    return SHARE_MAX * slider(purity)


def com_cap(purity: float) -> float | None:
    """The most commercial share that is let in; None at purity 0."""
    t = slider(purity)
    return None if t <= EPS else 1.0 - t * (1.0 - COM_FLOOR)


def stored_suffice(purity: float, default_pack: bool = True) -> bool:
    """Whether the stored cohort, which has floors of its own, holds all whom this purity lets in."""
    cap = com_cap(purity)
    return default_pack and share_floor(purity) + EPS >= MINT_SHARE and cap is not None and cap - EPS <= MINT_COM


def weight(deweight: float) -> Column:
    """A vote's weight from weight and weight_pctile."""
    t = slider(deweight)
    if t <= EPS:
        return F.lit(1.0)
    return F.pow(F.greatest("weight", F.lit(1e-9)), F.lit(EXPONENT_MAX * t)) * F.exp(-ALPHA_MAX * t * (1.0 - F.coalesce("weight_pctile", F.lit(0.0))))


def pure(purity: float) -> Column:
    """The gates on deep_share and com_share."""
    cap, out = com_cap(purity), F.lit(True)
    if share_floor(purity) > EPS:
        out = out & (F.coalesce("deep_share", F.lit(0.0)) >= share_floor(purity))
    return out if cap is None else out & (F.coalesce("com_share", F.lit(0.0)) <= cap)


def members(universe: DataFrame, stored: DataFrame, purity: float = 0.0, deweight: float = 0.0) -> DataFrame:
    """user_id and w of the cohort: all of universe(user_id) within the gates, or the stored cohort alone where
    that is the same. stored(user_id, weight, weight_pctile, deep_share, com_share)."""
    kept = stored.select("user_id", "weight", "weight_pctile", "deep_share", "com_share")
    if not stored_suffice(purity):
        kept = universe.select("user_id").join(kept, "user_id", "left").fillna({"weight": MISSING, "weight_pctile": 0.0, "deep_share": 0.0, "com_share": 0.0})
    return kept.filter(pure(purity)).select("user_id", weight(deweight).alias("w"))


def neutral_works(works: DataFrame, titles: list[str]) -> DataFrame:
    """Works that have one of the titles, alone or before a bracket. A title's beginnings before brackets are
    listed, so that the match is an equality."""
    if not titles:
        return works.select("work_id").limit(0)
    t = F.lower("title")
    starts = F.concat(F.array(t), F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split(t, " \\(")) - 1, F.lit(1))), lambda k: F.call_function("substring_index", t, F.lit(" ("), k)))
    return works.filter(F.arrays_overlap(starts, F.array(*[F.lit(x.lower()) for x in titles]))).select("work_id").distinct()


def pack_features(likes: DataFrame, events: DataFrame, neutral: DataFrame, positive: list, negative: list) -> DataFrame:
    """What a pack says of each reader: n_deep, deep_share against liked neutral works, com_share of fives."""
    l = likes.groupBy("user_id").agg(
        F.sum(F.when(F.col("author_id").isin(positive), F.col("n_liked"))).alias("n_deep"), F.sum(F.when(F.col("author_id").isin(positive), F.col("n_five"))).alias("pos"),
        F.sum(F.when(F.col("author_id").isin(negative), F.col("n_five"))).alias("neg"),
    )
    h = events.filter("rating >= 4").join(neutral, "work_id", "left_semi").groupBy("user_id").agg(F.count_distinct("work_id").alias("normie"))
    f = l.join(h, "user_id", "full").fillna(0, ["n_deep", "pos", "neg", "normie"])
    return f.filter("n_deep > 0 OR neg > 0 OR normie > 0 OR pos > 0").select(
        "user_id", "n_deep", F.coalesce(ratio(F.col("n_deep"), F.col("n_deep") + F.col("normie")), F.lit(0.0)).alias("deep_share"), F.coalesce(ratio(F.col("neg"), F.col("pos") + F.col("neg")), F.lit(0.0)).alias("com_share")
    )


def live_members(universe: DataFrame, stored: DataFrame, features: DataFrame, purity: float = 0.0, deweight: float = 0.0) -> DataFrame:
    """The cohort of a pack that isn't the stored one: gates by the pack's own features; readers without a
    stored score weigh by them."""
    u = universe.select("user_id").join(stored.select("user_id", "weight", "weight_pctile"), "user_id", "left").join(features, "user_id", "left")
    soft = F.ln(1.0 + F.coalesce("n_deep", F.lit(0)).cast("double")) * F.pow(F.greatest(F.when(F.col("deep_share") > 0, F.col("deep_share")).otherwise(0.05), F.lit(0.05)), F.lit(DEEP_EXP)) * F.pow(F.greatest(1.0 - F.coalesce("com_share", F.lit(0.0)), F.lit(0.02)), F.lit(COM_EXP))
    u = u.withColumn("weight", F.coalesce("weight", soft)).fillna({"weight_pctile": 0.0, "deep_share": 0.0, "com_share": 0.0})
    return u.filter(pure(purity)).select("user_id", weight(deweight).alias("w"))


class Pack:
    """A pack of positive and negative authors and neutral titles, which is replaced, never changed in place."""

    FIELDS = ("positive", "negative", "neutral")

    def __init__(self, positive=(), negative=(), neutral=()):
        ids = lambda xs: tuple(sorted({str(x) for x in xs if x is not None and str(x).strip()}))
        self.positive, self.negative, self.neutral = ids(positive), ids(negative), tuple(dict.fromkeys(t for x in neutral if (t := str(x or "").strip())))

    def updated(self, **patch) -> Pack:
        """The pack with the lists given in place of its own; other names are refused."""
        if unknown := set(patch) - set(self.FIELDS):
            raise ValueError(f"a pack has no {sorted(unknown)}")
        return Pack(**{f: patch.get(f, getattr(self, f)) for f in self.FIELDS})

    def key(self) -> str:
        """A hash of the contents: packs with the same authors and titles have the same."""
        return hashlib.sha1(json.dumps({f: sorted(getattr(self, f)) for f in self.FIELDS}, ensure_ascii=False).encode()).hexdigest()[:16]

    def is_safe_subset(self, default: Pack) -> bool:
        """Whether stored features of the default pack still hold: no new positive author, the same negatives."""
        return set(self.positive) <= set(default.positive) and self.negative == default.negative
