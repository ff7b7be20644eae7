"""Genre tags, filters by tag, and prevalence gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectorium.functions.numeric import ratio
from lectorium.functions.text import series_of


def genre_catalog(shelves: DataFrame, least_works: int = 80, least_total: int = 8000, noise: list[str] = ()) -> DataFrame:
    """Shelves in enough works and often enough: shelf, n_works, total_count."""
    g = shelves.filter(~F.col("shelf").isin(list(noise))).groupBy("shelf").agg(F.count_distinct("work_id").alias("n_works"), F.sum("count").alias("total_count"))
    return g.filter((F.col("n_works") >= least_works) & (F.col("total_count") >= least_total))


def work_genres(shelves: DataFrame, catalog: DataFrame, least: int = 5) -> DataFrame:
    """A work's tags that are in the catalog and have enough readers behind them."""
    return shelves.join(catalog.select("shelf"), "shelf", "left_semi").groupBy("work_id", "shelf").agg(F.sum("count").alias("count")).filter(F.col("count") >= least)


def by_tags(works: DataFrame, tags: DataFrame, require: list[str] = (), include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Works that have all of require, any of include and none of exclude."""
    for tag in require:
        works = works.join(tags.filter(F.col("shelf") == tag).select("work_id"), "work_id", "left_semi")
    if include:
        works = works.join(tags.filter(F.col("shelf").isin(list(include))).select("work_id"), "work_id", "left_semi")
    if exclude:
        works = works.join(tags.filter(F.col("shelf").isin(list(exclude))).select("work_id"), "work_id", "left_anti")
    return works


#: Shelves about a reader, a format or a status, and shelves of a year.
NOISE = (
    "to-buy", "to-read", "currently-reading", "read", "dnf", "abandoned", "tbr", "library", "kindle", "ebook", "e-book", "audiobook", "audio", "audible", "paperback",
    "hardcover", "english", "read-in-english", "books", "my-books", "owned", "i-own", "own-it", "owned-books", "favourites", "favorites", "favourite", "favorite", "favorite-books",
    "all-time-favorites", "5-stars", "4-stars", "3-stars", "series", "maybe", "unfinished", "re-read", "reread", "to-reread", "did-not-finish", "on-hold", "physical-tbr", "kindle-tbr",
)
YEAR_SHELF = "^read-in-\\d{4}$|^read-\\d{4}$|^\\d{4}-reads$"


def is_noise(shelf: Column, listed: tuple = NOISE) -> Column:
    """Whether a shelf says something about the reader or a year rather than the work; null and blank ones do."""
    s = F.trim(F.lower(F.coalesce(shelf, F.lit(""))))
    return (s == "") | s.isin(*listed) | s.rlike(YEAR_SHELF) | s.startswith("read-in-") | s.startswith("read-20")


@dataclass(frozen=True)
class RatioGate:
    """A genre against its competitors."""

    name: str
    core: tuple
    compete: tuple = ()
    soft: tuple = ()
    soft_weight: float = 0.35
    compete_soft: tuple = ()
    compete_soft_weight: float = 0.25
    literary: tuple = ()
    literary_weight: float = 0.5
    literary_min_n: int = 250
    ya: tuple = ()
    min_core: int = 10
    min_ratio: float = 0.55
    escape_core: float = 800
    escape_ratio: float = 0.27
    soft_escape_core: float = 80
    soft_escape_ratio: float = 0.35
    ya_below_core: bool = False
    soft_max_ya: float | None = None


@dataclass(frozen=True)
class ThemeGate:
    """A theme against all fiction, with lower floors for works that few have rated."""

    name: str
    core: tuple
    fiction: tuple
    min_core: int = 10
    min_ratio: float = 0.05
    obscure_n: int = 200
    obscure_core: int = 5
    obscure_ratio: float = 0.03


def shelf_sums(shelves: DataFrame, groups: dict[str, tuple]) -> DataFrame:
    """One pass: a column of summed counts per group of shelves."""
    return shelves.groupBy("work_id").agg(*[F.coalesce(F.sum(F.when(F.col("shelf").isin(list(v)), F.col("count"))), F.lit(0)).cast("double").alias(k) if v else F.lit(0.0).alias(k) for k, v in groups.items()])


def ratio_gate(shelves: DataFrame, stats: DataFrame, g: RatioGate) -> DataFrame:
    """work_id, gate, passed, score, ratio of every work with shelves and ratings."""
    s = shelf_sums(shelves, {k: getattr(g, k) for k in ("core", "soft", "compete", "compete_soft", "literary", "ya")}).join(stats.select("work_id", "n"), "work_id")
    score = F.col("core") + g.soft_weight * F.col("soft")
    whole = score + F.col("compete") + g.compete_soft_weight * F.col("compete_soft") + F.when(F.col("n") >= g.literary_min_n, g.literary_weight * F.col("literary")).otherwise(0.0)
    r = ratio(score, whole)
    ya_ok = F.col("ya") < F.col("core") if g.ya_below_core else F.lit(True)
    hard = (F.col("core") >= g.escape_core) & (r >= g.escape_ratio) & ya_ok
    soft = (F.col("core") >= g.soft_escape_core) & (r >= g.soft_escape_ratio) & (F.col("ya") < g.soft_max_ya if g.soft_max_ya is not None else F.lit(True))
    passed = (F.col("core") >= g.min_core) & F.coalesce((r >= g.min_ratio) | hard | soft, F.lit(False))
    return s.select("work_id", F.lit(g.name).alias("gate"), passed.alias("passed"), score.alias("score"), r.alias("ratio"), "core", "n")


def theme_gate(shelves: DataFrame, stats: DataFrame, g: ThemeGate) -> DataFrame:
    s = shelf_sums(shelves, {"core": g.core, "fiction": g.fiction}).join(stats.select("work_id", "n"), "work_id")
    r = ratio(F.col("core"), F.col("fiction"))
    few = F.col("n") < g.obscure_n
    passed = (F.col("core") >= F.when(few, g.obscure_core).otherwise(g.min_core)) & (r >= F.when(few, g.obscure_ratio).otherwise(g.min_ratio))
    return s.select("work_id", F.lit(g.name).alias("gate"), F.coalesce(passed, F.lit(False)).alias("passed"), F.col("core").alias("score"), r.alias("ratio"), "core", "n")


def inherit_series(gated: DataFrame, works: DataFrame, min_core: float, least_n: int = 200, least_volumes: int = 2) -> DataFrame:
    """First volumes of a series pass a gate if enough later volumes do: gated rows with passed raised."""
    name, number = series_of(F.col("title"))
    titled = works.select("work_id", "author_id", name.alias("series"), number.alias("volume"))
    g = gated.join(titled, "work_id", "left")
    later = g.filter("passed AND series IS NOT NULL AND volume >= 2").groupBy("author_id", "series", "gate").agg(F.count(F.lit(1)).alias("volumes"))
    j = g.join(later, ["author_id", "series", "gate"], "left")
    raised = (F.col("volume") < 2) & (F.coalesce("volumes", F.lit(0)) >= least_volumes) & (F.col("core") >= min_core) & (F.col("n") >= least_n)
    return j.select("work_id", "gate", (F.col("passed") | F.coalesce(raised, F.lit(False))).alias("passed"), "score", "ratio")


def through_gates(works: DataFrame, gates: DataFrame, names: list[str]) -> DataFrame:
    """Works that pass all the gates named."""
    for n in names:
        works = works.join(gates.filter(F.col("passed") & (F.col("gate") == n)).select("work_id"), "work_id", "left_semi")
    return works


def genre_scores(shelves: DataFrame, core: tuple, soft: tuple, against: tuple, literary: tuple, stats: DataFrame, least_literary_n: int = 250) -> DataFrame:
    """Score of a genre, of all others, and the share of the genre; null without any of them."""
    s = shelf_sums(shelves, {"core": core, "soft": soft, "against": against, "literary": literary}).join(stats.select("work_id", "n"), "work_id")
    score = F.col("core") + 0.35 * F.col("soft")
    other = F.col("against") + F.when(F.col("n") >= least_literary_n, 0.5 * F.col("literary")).otherwise(0.0)
    return s.select("work_id", score.alias("score"), other.alias("other"), ratio(score, score + other).alias("ratio"))


def search(works: DataFrame, text: str, top: int = 20) -> DataFrame:
    """Autocomplete: equal, then starting with, then containing the text, or the id itself."""
    t, q = F.lower("title"), text.lower()
    place = F.when(F.col("work_id").cast("string") == q, 0).when(t == q, 1).when(t.startswith(q), 2).when(t.contains(q), 3)
    return works.withColumn("place", place).filter("place IS NOT NULL").select("work_id", "title", "place").orderBy("place", "title", "work_id").limit(top)


#: Beginnings of titles that never count as the genre.
NEVER = ("harry potter", "a game of thrones", "a clash of kings", "a storm of swords", "a feast for crows", "a dance with dragons")


def sf_books(books: DataFrame, min_core: int = 10, min_ratio: float = 0.55, min_ratings: int = 50) -> DataFrame:
    """Rows of books(title, ratings_count, sf_core, sf_ratio, ya, fantasy, ...) of the genre: by core and ratio, or by
    a strong core at a softer ratio, or by a weaker core that fantasy shelves share, with little ya."""
    core, share, ya = F.col("sf_core"), F.col("sf_ratio"), F.coalesce("ya", F.lit(0))
    strong = (core >= 100) & (share >= 0.27) & (ya < core)
    leaning = (core >= 25) & (share >= 0.32) & (ya < 50) & (F.col("fantasy") > 0)
    title, never = F.lower(F.coalesce("title", F.lit(""))), F.lit(False)
    for start in NEVER:
        never = never | title.startswith(start)
    return books.filter((core >= min_core) & (F.col("ratings_count") >= min_ratings) & ((share >= min_ratio) | strong | leaning) & ~never)
