"""Queries and SQL of reader panels, labels, universes and authors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectorium.functions.storage import saved
from lectorium.operators import evaluation, graph, panels
from lectorium.plans.juries import _JURY, _jury_tables, _r
from lectorium.plans.ratings import DERIVED, Model
from lectorium.plans.research import _whole

QUERIES, SQL = {}, {}


def _add(name, query, sql):
    QUERIES[name], SQL[name] = query, sql


_BANDS = {"least_rated": 25, "least_five": 4, "least_big": 2, "big": 0.9, "author_band": (34, 42), "megastar": 44, "work_band": (24, 34), "mega": 38}


def _panel(s, d):
    m, (events, rarity, _) = Model(s, d), _jury_tables(s, d)
    works = m.works.select("work_id", "author_id", (F.col("work_id") % 3 == 0).alias("is_series"), "pub_year")
    return m._get("reader_panel", lambda: panels.reader_panel(events, rarity, works, **_BANDS))


_PANEL = f"""{_JURY}, wx AS (SELECT wr.work_id, n, rarity, author_id, wr.work_id % 3 = 0 AS is_series, pub_year FROM wr JOIN works USING (work_id)), ax AS (SELECT author_id, max(n) AS an FROM wx GROUP BY 1), bq AS (SELECT quantile_cont(n, 0.9) AS big FROM wr),
e AS (SELECT ev.user_id, ev.rating, wx.*, an, big FROM ev JOIN wx USING (work_id) JOIN ax USING (author_id), bq),
bk AS (SELECT user_id, count(*) AS n_rated, count(*) FILTER (WHERE rating = 5) AS n5, avg(rating) AS mean_rating, n5::DOUBLE / count(*) AS five_rate, avg(ln(1.0::DOUBLE + n)) FILTER (WHERE rating = 5) AS mean_logn_5, stddev_samp(ln(1.0::DOUBLE + n)) FILTER (WHERE rating = 5) AS std_logn_5, avg(rarity) FILTER (WHERE rating >= 4) AS depth_ge4,
  count(*) FILTER (WHERE rating = 5 AND n >= big)::DOUBLE / nullif(count(*) FILTER (WHERE n >= big), 0) AS p5_blockbuster, count(*) FILTER (WHERE rating = 5 AND is_series)::DOUBLE / n5 AS series_share_5, avg(pub_year) FILTER (WHERE rating = 5 AND pub_year BETWEEN 1500 AND 2020) AS mean_pub_year_5,
  count(*) FILTER (WHERE rating = 5 AND an BETWEEN 34 AND 42) AS n5_midpop_author_books, count(DISTINCT author_id) FILTER (WHERE rating = 5 AND an BETWEEN 34 AND 42) AS n_midpop_authors_5, count(DISTINCT author_id) FILTER (WHERE rating = 5 AND an >= 44) AS n_megastar_authors_5,
  count(*) FILTER (WHERE rating = 5 AND n BETWEEN 24 AND 34)::DOUBLE / n5 AS mid_catalog_share_5, count(*) FILTER (WHERE rating = 5 AND n >= 38)::DOUBLE / n5 AS mega_catalog_share_5
  FROM e GROUP BY user_id HAVING count(*) >= 25 AND count(*) FILTER (WHERE rating = 5) >= 4 AND count(*) FILTER (WHERE n >= big) >= 2),
pa AS (SELECT user_id, author_id, count(*) AS k FROM e WHERE rating = 5 GROUP BY ALL), aa AS (SELECT user_id, count(*) AS n_authors_5, avg(k) AS binge_mean_5, max(k) AS binge_max_5, sum(k * k)::DOUBLE / power(sum(k), 2) AS author_hhi_5, count(*) FILTER (WHERE k = 1)::DOUBLE / count(*) AS singleton_author_share_5 FROM pa GROUP BY user_id),
pn AS (SELECT *, n_authors_5::DOUBLE / n5 AS author_div_5, n_midpop_authors_5::DOUBLE / n_authors_5 AS midpop_author_frac_5, n_midpop_authors_5 / ln(1.0::DOUBLE + n5) AS midpop_span_per_logn5 FROM bk JOIN aa USING (user_id))"""
_WHOLE = {"n_rated", "n5", "n5_midpop_author_books", "n_midpop_authors_5", "n_megastar_authors_5", "n_authors_5", "binge_max_5"}
_add("reader_panel", lambda s, d: _r(_panel(s, d), *[c for c in panels.PANEL if c not in _WHOLE]), f"WITH {_PANEL} SELECT user_id, " + ", ".join(c if c in _WHOLE else f"round({c}, 9) AS {c}" for c in panels.PANEL) + " FROM pn")


def _labels(s, d):
    m = Model(s, d)
    seeds = m.works.select("work_id", F.when(F.col("author_id") % 10 < 3, "classic").when(F.col("author_id") % 10 < 6, "anti").otherwise("normie").alias("kind"))
    return panels.hit_labels(m.events, seeds, 4, 4, 4)


_LABELS = "lh AS (SELECT user_id, count(*) FILTER (WHERE author_id % 10 < 3) AS classic, count(*) FILTER (WHERE author_id % 10 BETWEEN 3 AND 5) AS \"anti\", count(*) FILTER (WHERE author_id % 10 > 5) AS normie FROM ev JOIN works USING (work_id) WHERE rating = 5 GROUP BY 1), lb AS (SELECT *, CASE WHEN classic >= 4 AND classic >= \"anti\" AND classic >= normie THEN 'classic' WHEN \"anti\" >= 4 AND \"anti\" > classic AND \"anti\" >= normie THEN 'anti' WHEN normie >= 4 AND normie > classic AND \"anti\" < 4 THEN 'normie' END AS label FROM lh)"
_add("hit_labels", _labels, f"WITH {DERIVED}, {_LABELS} SELECT * FROM lb WHERE label IS NOT NULL")
_SEP = ["five_rate", "mean_rating", "depth_ge4", "author_hhi_5", "series_share_5", "mean_pub_year_5"]
_add(
    "separators",
    lambda s, d: _r(panels.separators(_panel(s, d), _labels(s, d), _SEP), "d_vs_anti", "d_vs_normie", "min_abs_d"),
    f"WITH {_PANEL}, {_LABELS}, j AS (SELECT pn.*, label FROM pn JOIN lb USING (user_id) WHERE label IS NOT NULL), x AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, ((SELECT avg({c}) FROM j WHERE label = 'classic') - (SELECT avg({c}) FROM j WHERE label = 'anti')) / (SELECT stddev_samp({c}) FROM pn) AS a, ((SELECT avg({c}) FROM j WHERE label = 'classic') - (SELECT avg({c}) FROM j WHERE label = 'normie')) / (SELECT stddev_samp({c}) FROM pn) AS n" for c in _SEP)
    + ") SELECT feature, round(a, 9) AS d_vs_anti, round(n, 9) AS d_vs_normie, round(least(abs(a), abs(n)), 9) AS min_abs_d, CASE WHEN a > 0 AND n > 0 THEN 1 WHEN a < 0 AND n < 0 THEN -1 ELSE 0 END::INTEGER AS direction, coalesce(a * n > 0 AND least(abs(a), abs(n)) >= 0.12, FALSE) AS separates_both FROM x",
)
_add(
    "gated_affinity",
    lambda s, d: _r(panels.affinity(_panel(s, d), {"depth_ge4": 1.0, "author_hhi_5": -0.5, "std_logn_5": 0.25}, {"five_rate": (0.1, 0.3), "n_rated": (28, None)}), "affinity"),
    f"WITH {_PANEL} SELECT user_id, round((depth_ge4 - (SELECT avg(depth_ge4) FROM pn)) / (SELECT stddev_samp(depth_ge4) FROM pn) - 0.5::DOUBLE * (author_hhi_5 - (SELECT avg(author_hhi_5) FROM pn)) / (SELECT stddev_samp(author_hhi_5) FROM pn) + 0.25::DOUBLE * (std_logn_5 - (SELECT avg(std_logn_5) FROM pn)) / (SELECT stddev_samp(std_logn_5) FROM pn), 9) AS affinity FROM pn WHERE five_rate BETWEEN 0.1 AND 0.3 AND n_rated >= 28",
)

# Universes: works ranked by the share of fives among parts of the readers.
_PARTS = {"base": "TRUE", "loo0": "user_id % 4 <> 0", "loo1": "user_id % 4 <> 1", "loo2": "user_id % 4 <> 2", "rnd0": "user_id % 7 <> 3", "com0": "user_id % 4 = 0", "com1": "user_id % 4 = 1"}
_KIND = {"base": "equal", "loo0": "leave_one_out", "loo1": "leave_one_out", "loo2": "leave_one_out", "rnd0": "random", "com0": "community", "com1": "community"}


def _universes(s, d, kinds):
    e, out = Model(s, d).events, None
    for u in kinds:
        p = e.filter(_PARTS[u]).groupBy("work_id").agg(F.count(F.lit(1)).alias("n"), F.round((F.count_if(F.col("rating") == 5) + 2) / (F.count(F.lit(1)) + 10), 9).alias("p")).filter("n >= 4")
        one = evaluation.ranked(p, "p").withColumn("universe", F.lit(u))
        out = one if out is None else out.unionByName(one)
    return saved(out, "universes"), s.createDataFrame(list(kinds.items()), "universe string, kind string")


def _ranks_sql(kinds):
    return "ur AS (" + " UNION ALL ".join(f"SELECT '{u}' AS universe, '{k}' AS kind, work_id, row_number() OVER (ORDER BY round((count(*) FILTER (WHERE rating = 5) + 2) / (count(*) + 10.0::DOUBLE), 9) DESC, work_id) AS rank FROM ev WHERE {_PARTS[u]} GROUP BY work_id HAVING count(*) >= 4" for u, k in kinds.items()) + ")"


_SUMMARY = f"""{DERIVED}, {_ranks_sql(_KIND)}, un AS (SELECT DISTINCT universe, kind FROM ur), fu AS (SELECT w.work_id, un.universe, un.kind, ur.rank IS NOT NULL AS present, coalesce(ur.rank, 501) AS rank FROM (SELECT DISTINCT work_id FROM ur WHERE rank <= 500) w CROSS JOIN un LEFT JOIN ur ON ur.work_id = w.work_id AND ur.universe = un.universe AND ur.rank <= 500),
us AS (SELECT work_id, max(rank) FILTER (WHERE universe = 'base' AND present) AS baseline_rank, quantile_cont(rank, 0.5) FILTER (WHERE kind <> 'community') AS median_rank, quantile_cont(rank, 0.1) FILTER (WHERE kind <> 'community') AS q10_rank, quantile_cont(rank, 0.9) FILTER (WHERE kind <> 'community') AS q90_rank, stddev_pop(rank) FILTER (WHERE kind <> 'community') AS rank_sd,
  avg((rank <= 50)::INTEGER) FILTER (WHERE kind <> 'community') AS top50_rate, avg((rank <= 200)::INTEGER) FILTER (WHERE kind <> 'community') AS top200_rate, avg((rank <= 500)::INTEGER) FILTER (WHERE kind <> 'community') AS top_rate, avg((rank <= 200)::INTEGER) FILTER (WHERE kind = 'community') AS community_top200_rate, (max(rank) FILTER (WHERE kind = 'leave_one_out') - baseline_rank)::DOUBLE AS max_loo_drop FROM fu GROUP BY work_id)"""
_RATES = ["median_rank", "q10_rank", "q90_rank", "rank_sd", "top50_rate", "top200_rate", "top_rate", "community_top200_rate"]
_add("universe_summaries", lambda s, d: _r(panels.universe_summaries(*_universes(s, d, _KIND), "base"), *_RATES), f"WITH {_SUMMARY} SELECT work_id, baseline_rank::INTEGER AS baseline_rank, " + ", ".join(f"round({c}, 9) AS {c}" for c in _RATES) + ", max_loo_drop FROM us")
_add(
    "distributed_core",
    lambda s, d: _r(panels.distributed_core(panels.universe_summaries(*_universes(s, d, _KIND), "base"), Model(s, d).works.select("work_id", ((F.col("work_id") % 10) / 25.0).alias("hhi")), stable=0.6), "median_rank", "top200_rate"),
    f"WITH {_SUMMARY} SELECT work_id, CASE WHEN community_top200_rate >= 0.5 AND round((work_id % 10) / 25.0::DOUBLE, 9) <= 0.25 AND max_loo_drop <= 100 THEN 'distributed_core' ELSE 'community_dependent' END AS class, round(median_rank, 9) AS median_rank, round(top200_rate, 9) AS top200_rate FROM us WHERE round(top200_rate, 9) >= 0.6",
)
_MULTI = {"base": "jury", "loo0": "jury", "loo1": "jury", "loo2": "pair", "rnd0": "pair", "com0": "pair", "com1": "gamma"}
_GAMMAS = [1.0, 1.25, 1.5, 2.0]
_MV = ["cross_rate", "jury_rate", "jury_present", "pair_rate", "pair_present", "gamma_rate", "gamma_present", "central_score"]


def _multiverse(s, d):
    w = Model(s, d).work_stats.select("work_id", "mean")
    scores = w.select("work_id", F.explode(F.array(*map(F.lit, _GAMMAS))).alias("gamma"), "mean").select("work_id", "gamma", F.round(F.col("mean") * 25 / F.col("gamma"), 6).alias("score")).filter("gamma < 2 OR work_id % 5 > 0")
    return panels.multiverse(*_universes(s, d, _MULTI), scores, _GAMMAS, "base", floor=45.0)


_TWO = "2.0::DOUBLE / 3 - 1e-12"
_add(
    "multiverse_classes",
    lambda s, d: _r(_multiverse(s, d), *_MV),
    f"""WITH {DERIVED}, {_ranks_sql(_MULTI)}, un AS (SELECT DISTINCT universe, kind FROM ur), fu AS (SELECT w.work_id, un.universe, un.kind, ur.rank IS NOT NULL AS present, coalesce(ur.rank, (SELECT max(rank) + 1 FROM ur)) AS rank FROM (SELECT DISTINCT work_id FROM ur) w CROSS JOIN un LEFT JOIN ur ON ur.work_id = w.work_id AND ur.universe = un.universe),
g AS (SELECT work_id, max(rank) FILTER (WHERE universe = 'base' AND present) AS central_rank, avg((rank <= 200)::INTEGER) AS cross_rate, min(rank) AS best_rank, max(rank) AS worst_rank, {", ".join(f"avg((rank <= 200)::INTEGER) FILTER (WHERE kind = '{k}') AS {k}_rate, avg(present::INTEGER) FILTER (WHERE kind = '{k}') AS {k}_present, max(rank) FILTER (WHERE kind = '{k}') - min(rank) FILTER (WHERE kind = '{k}') AS {k}_range" for k in ("jury", "pair", "gamma"))} FROM fu GROUP BY work_id),
x AS (SELECT g.*, {", ".join(f"round(mean * 25 / {v}::DOUBLE, 6) AS s{i}" for i, v in enumerate(_GAMMAS))} FROM g JOIN (SELECT work_id, mean FROM ws) USING (work_id)),
y AS (SELECT *, CASE WHEN s0 < 45 THEN 1.0 WHEN s1 < 45 THEN 1.25 WHEN s2 < 45 THEN 1.5 WHEN work_id % 5 = 0 OR s3 < 45 THEN 2.0 END::DOUBLE AS critical_gamma FROM x)
SELECT work_id, central_rank::INTEGER AS central_rank, best_rank::INTEGER AS best_rank, worst_rank::INTEGER AS worst_rank, jury_range::INTEGER AS jury_range, pair_range::INTEGER AS pair_range, gamma_range::INTEGER AS gamma_range, critical_gamma, {", ".join(f"round({c}, 9) AS {c}" for c in _MV if c != "central_score")}, round(s0, 9) AS central_score,
  concat_ws(',', CASE WHEN central_rank <= 200 AND s0 >= 45 AND jury_rate >= {_TWO} AND pair_rate >= {_TWO} AND cross_rate >= {_TWO} AND s2 >= 45 THEN 'jointly_robust' END, CASE WHEN central_rank <= 200 AND s0 >= 45 AND critical_gamma <= 1.5 THEN 'selection_sensitive' END, CASE WHEN central_rank <= 200 AND jury_present = 1 AND jury_rate < {_TWO} THEN 'jury_sensitive' END,
    CASE WHEN central_rank <= 200 AND jury_present < 1 THEN 'jury_evidence_sensitive' END, CASE WHEN central_rank <= 200 AND pair_present = 1 AND pair_rate < {_TWO} THEN 'pair_sensitive' END, CASE WHEN central_rank <= 200 AND pair_present < 1 THEN 'pair_evidence_sensitive' END) AS classes FROM y""",
)

# Authors in place of works.
_AUTHOR = f"{DERIVED}, ae AS (SELECT user_id, author_id, max(rating) AS rating, count(*) AS works, count(*) FILTER (WHERE rating = 5)::DOUBLE / count(*) AS five_share FROM ev JOIN works USING (work_id) GROUP BY ALL)"
_add("author_events", lambda s, d: (lambda m: _r(panels.author_events(m.events, m.works), "five_share"))(Model(s, d)), f"WITH {_AUTHOR} SELECT user_id, author_id, rating, works, round(five_share, 9) AS five_share FROM ae")


def _author_edges(s, d):
    m = Model(s, d)
    a = panels.author_events(m.events, m.works).filter("rating = 5")
    k = a.groupBy("author_id").agg(F.count(F.lit(1)).alias("k"))
    return a.join(k, "author_id").select("user_id", F.col("author_id").alias("work_id"), (1.0 / F.ln(1.0 + F.col("k"))).alias("w"))


def _author_hits_sql(rounds):
    out = f"{_AUTHOR}, ad AS (SELECT user_id, author_id AS work_id, 1.0::DOUBLE / ln(1.0::DOUBLE + count(*) OVER (PARTITION BY author_id)) AS w FROM ae WHERE rating = 5), h0 AS (SELECT DISTINCT user_id, 1.0::DOUBLE AS h FROM ad)"
    for i in range(rounds):
        out += f", a{i} AS (SELECT work_id, sum(w * h) AS a FROM ad JOIN h{i} USING (user_id) GROUP BY work_id), b{i} AS (SELECT work_id, a / (SELECT sqrt(sum(a * a)) FROM a{i}) AS a FROM a{i}), h{i + 1} AS (SELECT user_id, sum(w * a) AS h FROM ad JOIN b{i} USING (work_id) GROUP BY user_id)"
    return out


_add("author_authority", lambda s, d: graph.hits(_author_edges(s, d), 8).select(F.col("work_id").alias("author_id"), F.round("authority", 6).alias("authority")), f"WITH {_whole(_author_hits_sql(8))} SELECT work_id AS author_id, round(a, 6) AS authority FROM b7")
_add("author_core", lambda s, d: graph.core(_author_edges(s, d).select("user_id", "work_id"), 4, 10, 3).withColumnRenamed("work_id", "author_id"), f"WITH {_AUTHOR}, c0 AS (SELECT user_id, author_id FROM ae WHERE rating = 5)" + "".join(f", c{i + 1} AS (SELECT * FROM c{i} WHERE user_id IN (SELECT user_id FROM c{i} GROUP BY 1 HAVING count(*) >= 4)), c{i + 2} AS (SELECT * FROM c{i + 1} WHERE author_id IN (SELECT author_id FROM c{i + 1} GROUP BY 1 HAVING count(*) >= 10))" for i in range(0, 6, 2)) + " SELECT * FROM c6")
_add(
    "partial_spearman",
    lambda s, d: (lambda w: _r(panels.partial_spearman(evaluation.ranked(w, "mean").withColumnRenamed("rank", "x").join(evaluation.ranked(w, "p5").withColumnRenamed("rank", "y"), "work_id").join(evaluation.ranked(w, "n").withColumnRenamed("rank", "z"), "work_id"), "x", "y", "z"), "rho"))(Model(s, d).work_stats.select("work_id", "n", F.round("mean", 6).alias("mean"), F.round("p5", 6).alias("p5"))),
    f"WITH {DERIVED}, r AS (SELECT row_number() OVER (ORDER BY round(mean, 6) DESC, work_id) AS x, row_number() OVER (ORDER BY round(p5, 6) DESC, work_id) AS y, row_number() OVER (ORDER BY n DESC, work_id) AS z FROM ws) SELECT count(*) AS n, round((corr(x, y) - corr(x, z) * corr(y, z)) / sqrt((1 - power(corr(x, z), 2)) * (1 - power(corr(y, z), 2))), 9) AS rho FROM r",
)
