"""Signal lists: authors and works of polls found in the catalogue.

The lists are curated and short; the catalogue may be large, so each match is an equality of keys wherever
it can be, and containment is looked for only between the lists. Defined results: names that fold to nothing
match nothing; ties go to more ratings, then to the smaller id; empty lists give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectorium.functions.text import fold, normalize_title


def poll_prestige(chart: DataFrame, names: DataFrame, floor: float = 0.5) -> DataFrame:
    """names(match) with poll_rank and prestige: 1 at the chart's top, floor at its end, by the best rank of an
    author of chart(rank, author) whose folded name is the same or, beyond 5 letters, contains it or is in
    it. Names that the chart doesn't have get the middle."""
    c = chart.select(F.col("rank").cast("int").alias("rank"), fold(F.col("author")).alias("who")).filter("who <> ''").groupBy("who").agg(F.min("rank").alias("rank"))
    size = chart.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("_last"))
    n = names.select("match", fold(F.col("match")).alias("name"))
    near = (F.col("who") == F.col("name")) | ((F.length("name") > 5) & (F.col("who").contains(F.col("name")) | F.col("name").contains(F.col("who"))))
    best = n.join(c, near, "left").groupBy("match").agg(F.min("rank").alias("poll_rank")).crossJoin(F.broadcast(size))
    return best.select("match", "poll_rank", F.coalesce(1.0 - (1.0 - floor) * (F.col("poll_rank") - 1) / F.col("_last"), F.lit(0.5 * (1.0 + floor))).alias("prestige"))


def resolve_authors(names: DataFrame, authors: DataFrame) -> DataFrame:
    """names(match) with author_id and name of authors(author_id, name, ratings_count): the most rated of the
    folded name, with or without jr, sr and numerals; else the only one that begins with it or with which it
    begins; names of several or no such authors are left out."""
    a = authors.select("author_id", "name", F.coalesce("ratings_count", F.lit(0)).alias("rated"), fold(F.col("name")).alias("key")).filter("key <> ''")
    a = a.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("rated"), "author_id"))).filter("_r = 1").drop("_r")
    n = names.select("match", fold(F.col("match")).alias("folded")).filter("folded <> ''").distinct()
    bare = F.trim(F.regexp_replace(F.regexp_replace("folded", "\\b(jr|sr|ii|iii|iv)\\b", ""), "\\s+", " "))
    exact = n.select("match", F.explode(F.array_distinct(F.array("folded", bare))).alias("key")).join(a, "key")
    exact = exact.groupBy("match").agg(F.max_by(F.struct("author_id", "name"), F.struct("rated", -F.col("author_id"))).alias("x"))
    rest = n.join(exact, "match", "left_anti")
    # Beginnings by word, listed on both sides.
    words = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, " "))), lambda k: F.array_join(F.slice(F.split(c, " "), 1, k), " "))
    longer = rest.join(a.withColumn("folded", F.explode(words("key"))), "folded").select("match", "author_id", "name")
    shorter = rest.withColumn("key", F.explode(words("folded"))).join(a, "key").select("match", "author_id", "name")
    near = longer.union(shorter).distinct().groupBy("match").agg(F.count(F.lit(1)).alias("k"), F.first(F.struct("author_id", "name")).alias("x")).filter("k = 1").select("match", "x")
    return exact.union(near).select("match", F.col("x.author_id").alias("author_id"), F.col("x.name").alias("name"))


def resolve_lists(signals: DataFrame, authors: DataFrame) -> DataFrame:
    """signals(side, place, match) as side, match, author_id: an author belongs to one side only, non_literary
    before literary_poll before literary_sf, there to the first name."""
    order = F.when(F.col("side") == "non_literary", 0).when(F.col("side") == "literary_poll", 1).otherwise(2)
    found = signals.join(resolve_authors(signals.select("match").distinct(), authors), "match")
    return found.groupBy("author_id").agg(F.min(F.struct(order.alias("o"), "place", "side", "match")).alias("x")).select("x.side", "x.match", "author_id")


def match_poll_works(chart: DataFrame, works: DataFrame, least: int = 40) -> DataFrame:
    """chart(rank, title, author) with the most rated work of works(work_id, title, author, n) by the same
    folded author whose normalised title is the same, begins with the other's or, from 8 letters on, holds it. A
    work is taken once, by the best rank."""
    c = chart.select("rank", fold(F.col("author")).alias("who"), normalize_title(F.col("title")).alias("pt")).filter("pt <> ''")
    w = works.filter(F.col("n") >= least).select("work_id", "n", fold(F.col("author")).alias("who"), normalize_title(F.col("title")).alias("wt")).filter("wt <> ''")
    pt, wt = F.col("pt"), F.col("wt")
    same = (wt == pt) | wt.startswith(F.concat(pt, F.lit(" "))) | pt.startswith(F.concat(wt, F.lit(" "))) | ((F.length(pt) >= 8) & wt.contains(pt)) | ((F.length(wt) >= 8) & pt.contains(wt))
    best = c.join(w, "who").filter(same).groupBy("rank").agg(F.max_by(F.struct("work_id", "n"), F.struct("n", -F.col("work_id"))).alias("x"))
    return best.groupBy("x").agg(F.min("rank").alias("poll_rank")).select("x.work_id", "x.n", "poll_rank")


def normie_works(titles: DataFrame, works: DataFrame) -> DataFrame:
    """The two most rated works of works(work_id, title, n) with each of titles(title), alone or before a
    bracket; where there is none, the most rated one that begins with it: work_id, title."""
    t, w = F.lower("t"), F.lower("title")
    starts = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split(c, " \\(")) - 1, F.lit(1))), lambda k: F.call_function("substring_index", c, F.lit(" ("), k))))
    given = titles.select(F.col("title").alias("t")).distinct()
    hit = works.withColumn("key", F.explode(starts(w))).join(given.withColumn("key", t), "key").select("t", "work_id", "title", "n").distinct()
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("n"), "work_id"))
    first = hit.withColumn("r", rank).filter("r <= 2")
    rest = given.join(first, "t", "left_anti")
    loose = rest.join(works, w.startswith(t)).groupBy("t").agg(F.max_by(F.struct("work_id", "title"), F.struct("n", -F.col("work_id"))).alias("x")).select("x.work_id", "x.title")
    return first.select("work_id", "title").union(loose).distinct()


def resolve_ids(keys: DataFrame, works: DataFrame) -> DataFrame:
    """keys(key) as key, work_id, book_id: the work whose book_id that is, else the one whose work_id it is."""
    w = works.select(F.col("work_id").cast("string").alias("w"), F.col("book_id").cast("string").alias("b"))
    both = w.select(F.col("b").alias("key"), F.lit(0).alias("o"), "w", "b").union(w.select("w", F.lit(1), "w", "b"))
    return keys.select(F.col("key").cast("string").alias("key")).distinct().join(both, "key").groupBy("key").agg(F.min(F.struct("o", "w", "b")).alias("x")).select("key", F.col("x.w").alias("work_id"), F.col("x.b").alias("book_id"))
