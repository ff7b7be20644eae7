"""Queries and SQL of reader models, matching and text cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectorium.functions import text
from lectorium.functions.numeric import six
from lectorium.operators import models
from lectorium.plans.adapter import CTE, Tables
from lectorium.plans.ratings import DERIVED, Model

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _labels(m):
    return models.with_fold(m.taste.select("user_id", (F.col("lit_share") >= 0.75).alias("positive")), "user_id")


_FOLD = "('0x' || substr(md5(user_id::VARCHAR || '-fold'), 1, 8))::BIGINT % 5"
_add("reader_folds", lambda s, d: _labels(Model(s, d)), f"WITH {DERIVED} SELECT user_id, lit_share >= 0.75 AS positive, ({_FOLD})::INTEGER AS fold FROM tst")
_add(
    "fold_profiles",
    lambda s, d: (lambda m: models.fold_profiles(m.events, _labels(m)).withColumn("share", six(F.col("share"))))(Model(s, d)),
    f"WITH {DERIVED}, lb AS (SELECT user_id, ({_FOLD})::INTEGER AS fold FROM tst WHERE lit_share >= 0.75), fs AS (SELECT DISTINCT ({_FOLD})::INTEGER AS fold FROM tst), e AS (SELECT work_id, rating, fold FROM ev JOIN lb USING (user_id)), w AS (SELECT DISTINCT work_id FROM e), p AS (SELECT avg((rating = 5)::INTEGER) AS p0 FROM e) SELECT w.work_id, fs.fold, count(e.rating) AS n, round((count(*) FILTER (WHERE e.rating = 5) + 10 * any_value(p0)) / (count(e.rating) + 10), 6) AS share FROM w CROSS JOIN fs CROSS JOIN p LEFT JOIN e ON e.work_id = w.work_id AND e.fold <> fs.fold GROUP BY w.work_id, fs.fold",
)
_add(
    "binned_odds",
    lambda s, d: (lambda m: models.binned_odds(m.taste.join(m.pickiness.select("user_id", "five_rate"), "user_id").select("user_id", F.round("five_rate", 6).alias("x"), (F.col("lit_share") >= 0.75).alias("positive")), "x", "positive").withColumn("log_odds", six(F.col("log_odds"))))(Model(s, d)),
    f"WITH {DERIVED}, x AS (SELECT user_id, ntile(10) OVER (ORDER BY round(five_rate, 6), user_id) AS bin, lit_share >= 0.75 AS pos FROM tst JOIN pick USING (user_id)), b AS (SELECT avg(pos::INTEGER) AS p0 FROM x), g AS (SELECT bin, count(*) AS n, (count(*) FILTER (WHERE pos) + 5 * any_value(p0)) / (count(*) + 5) AS p, any_value(p0) AS p0 FROM x, b GROUP BY bin) SELECT bin::INTEGER AS bin, n, round(ln(p / (1 - p)) - ln(p0 / (1 - p0)), 6) AS log_odds FROM g",
)
_add(
    "matched_controls",
    lambda s, d: (lambda m: models.matched_controls(m.hist.select("user_id", "n_rated"), m.taste.filter("lit_share >= 0.9")))(Model(s, d)),
    f"WITH {DERIVED}, x AS (SELECT user_id, ntile(10) OVER (ORDER BY n_rated, user_id) AS decile, user_id IN (SELECT user_id FROM tst WHERE lit_share >= 0.9) AS lover FROM hist), w AS (SELECT decile, count(*) AS want FROM x WHERE lover GROUP BY decile) SELECT user_id, decile::INTEGER AS decile, lover FROM (SELECT x.*, want, row_number() OVER (PARTITION BY x.decile, lover ORDER BY md5(user_id::VARCHAR || '-controls'), user_id) AS r FROM x JOIN w USING (decile)) WHERE lover OR r <= want",
)
_add(
    "cohen_d",
    lambda s, d: (lambda m: models.cohen_d(m.taste.join(m.hist, "user_id").withColumn("positive", F.col("lit_share") >= 0.75), "positive", ["n_rated", "mean_rating", "lit_mass"]).withColumn("d", six(F.col("d"))))(Model(s, d)),
    f"WITH {DERIVED}, x AS (SELECT lit_share >= 0.75 AS p, unnest([{{'f': 'n_rated', 'v': n_rated::DOUBLE}}, {{'f': 'mean_rating', 'v': mean_rating}}, {{'f': 'lit_mass', 'v': lit_mass}}]) AS u FROM tst JOIN hist USING (user_id)) SELECT u.f AS feature, round((avg(u.v) FILTER (WHERE p) - avg(u.v) FILTER (WHERE NOT p)) / sqrt((var_pop(u.v) FILTER (WHERE p) + var_pop(u.v) FILTER (WHERE NOT p)) / 2), 6) AS d FROM x GROUP BY u.f",
)


def _ridge(s, d):
    m = Model(s, d)
    x = models.with_fold(m.taste.join(m.hist, "user_id").select("user_id", "lit_share", "mean_rating", F.col("n_rated").cast("double").alias("n_rated"), F.col("c5").cast("double").alias("c5")), "user_id")
    p = models.ridge_out_of_fold(x, ["mean_rating", "n_rated", "c5"], "lit_share")
    return p.select("user_id", "fold", six(F.col("actual")).alias("actual"), six(F.col("predicted")).alias("predicted"))


_add("ridge_out_of_fold", _ridge)
_add("spectral_embedding", lambda s, d: models.spectral_embedding(s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding"), "embedding", 4).select("vec_id", F.transform("scores", lambda x: F.round(F.abs(x), 4)).alias("scores")))
_add("spherical_clusters", lambda s, d: models.spherical_clusters(s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding"), "embedding", 6).select("vec_id", "community"))
_add(
    "fuzzy_titles",
    lambda s, d: (lambda w: models.fuzzy_pairs(w, w, "author_id", "title", 3, others=True))(Tables(s, d).works.select(F.col("work_id").alias("id"), "author_id", "title")),
    f"WITH {CTE} SELECT a.work_id AS l, b.work_id AS r, levenshtein(a.title, b.title)::INTEGER AS d FROM works a JOIN works b ON a.author_id = b.author_id AND a.work_id <> b.work_id AND levenshtein(a.title, b.title) <= 3 QUALIFY row_number() OVER (PARTITION BY a.work_id ORDER BY levenshtein(a.title, b.title), b.work_id) = 1",
)
_add(
    "metadata_cleaning",
    lambda s, d: Tables(s, d).works.select(
        "work_id",
        text.id_in_url(F.concat(F.lit("https://x.org/book/show/"), "work_id", F.lit(".Title"))).alias("book_id"),
        text.author_in_url(F.concat(F.lit("/author/show/"), "author_id", F.lit(".Name"))).alias("author"),
        text.year_in_text(F.concat(F.lit("First published May 1st "), (F.col("pub_year") + F.lit(40)).cast("string")), high=2030).alias("year"),
        text.int_like(F.concat(F.lit(" "), "author_id", F.lit(".0 "))).alias("number"),
        text.clean(F.when(F.col("work_id") % 2 == 0, "  ").otherwise(F.concat(F.lit(" "), "title"))).alias("title"),
        text.fold(F.concat(F.lit("Él "), "title", F.lit("-Ünd"))).alias("folded"),
    ),
    f"WITH {CTE} SELECT work_id, work_id::VARCHAR AS book_id, author_id::VARCHAR AS author, CASE WHEN pub_year + 40 <= 2030 THEN pub_year + 40 END::INTEGER AS year, author_id::INTEGER AS number, CASE WHEN work_id % 2 = 1 THEN title END AS title, 'el ' || title || ' und' AS folded FROM works",
)
_add(
    "json_properties",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k"), "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), six(F.avg("value")).alias("value")),
    "SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::INTEGER)::BIGINT AS k, round(avg(value), 6) AS value FROM events GROUP BY event_type",
)
