"""Queries and SQL of collapse, statistics, taste, cohorts and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectorium.functions.numeric import six
from lectorium.functions.storage import fingerprint, saved
from lectorium.operators import collapse, ranking, stats, taste
from lectorium.plans.adapter import CTE, Tables


#: Derived tables that are written once per application and state of the base tables.
_STORED: dict[tuple, object] = {}


class Model:
    """The derived tables of one set of base tables: each is written when first asked for, and read again by
    all later queries of the application as long as the base tables are the same."""

    def __init__(self, spark, sf_dir):
        self.base = Tables(spark, sf_dir)
        self._key = (spark.sparkContext.applicationId, *fingerprint(spark, *(f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "part"))))

    def _get(self, name, make):
        key = (*self._key, name)
        if key not in _STORED:
            _STORED[key] = saved(make(), name)
        return _STORED[key]

    @property
    def works(self):
        return self.base.works

    @property
    def ratings(self):
        return self._get("ratings", lambda: collapse.collapse_ratings(self.base.interactions))

    @property
    def pickiness(self):
        return self._get("pickiness", lambda: stats.user_pickiness(self.ratings))

    @property
    def events(self):
        return self._get("events", lambda: stats.rating_events(self.ratings, self.pickiness, self.works))

    @property
    def work_stats(self):
        return self._get("work_stats", lambda: stats.work_stats(self.events))

    @property
    def priors(self):
        return self._get("priors", lambda: stats.priors(self.work_stats, self.works))

    @property
    def hist(self):
        return self._get("hist", lambda: stats.user_star_hist(self.events))

    @property
    def literary_works(self):
        lit = self.base.taste_authors.filter("side <> 'non_literary'").select("author_id")
        return self.works.join(lit, "author_id", "left_semi").select("work_id")

    @property
    def percentiles(self):
        return self._get("percentiles", lambda: stats.user_percentiles(self.hist, stats.user_star_hist(self.events.join(self.literary_works, "work_id", "left_semi")), least_literary=12))

    @property
    def likes(self):
        return taste.author_likes(self.events, self.works, self.base.taste_authors)

    @property
    def taste(self):
        return self._get("taste", lambda: taste.user_taste(self.likes))

    @property
    def poll(self):
        return self._get("poll", lambda: taste.poll_works(self.work_stats, self.works, self.base.taste_authors))

    @property
    def common(self):
        return self.poll.filter("n >= 30")

    @property
    def deep(self):
        return self.poll.filter("n < 30")

    def cohort(self, name):
        return self._get(name, lambda: self._cohort(name))

    def _cohort(self, name):
        # The thresholds fit the near-uniform ratings of the driver tables, on which hardly any reader is purely literary.
        if name == "star":
            return taste.star_curators(self.events, self.taste.withColumn("com_hits", (F.col("com_hits") / 4).cast("long")), self.pickiness, self.hist, self.poll, least_rated=25, least_poll=3)
        if name == "pct":
            return taste.pct_curators(self.events, self.taste.withColumn("com_hits", (F.col("com_hits") / 4).cast("long")), self.pickiness, self.hist, self.percentiles, self.poll)
        if name == "pure":
            return taste.pure_curators(self.cohort("star"))
        if name == "pct_pure":
            return taste.pure_curators(self.cohort("pct"), least_poll=3, least_lit=4)
        return taste.deep_curators(self.events, self.cohort("pct"), self.deep, self.common, min_deep=2, min_share=0.2)

    def inputs(self, audience):
        wanted = {audience} & {"star", "pure", "pct", "pct_pure", "deep"}
        return ranking.Inputs(self.events, self.priors, self.taste, {a: self.cohort(a) for a in wanted}, self.percentiles)


DERIVED = f"""{CTE}, ratings AS (SELECT user_id, work_id, max(rating) AS rating FROM inter WHERE rating > 0 GROUP BY ALL),
pick AS (SELECT user_id, count(*) AS n_rated, count(*) FILTER (WHERE rating = 5) AS n_five, count(*) FILTER (WHERE rating = 5)::DOUBLE / count(*) AS five_rate FROM ratings GROUP BY user_id HAVING count(*) >= 5),
mid AS (SELECT median(five_rate) AS middle FROM pick),
ev AS (
  SELECT r.work_id, r.user_id, r.rating, p.n_rated, p.five_rate, least(20.0::DOUBLE, greatest(0.25::DOUBLE, (SELECT middle FROM mid) / nullif(p.five_rate, 0))) AS picky_weight, w.is_sf
  FROM ratings r JOIN pick p ON p.user_id = r.user_id JOIN works w ON w.work_id = r.work_id
), ws AS (
  SELECT work_id, count(*) AS n, avg(rating) AS mean, stddev_pop(rating) AS std, count(*) FILTER (WHERE rating = 5) AS n5, count(*) FILTER (WHERE rating = 4) AS n4, count(*) FILTER (WHERE rating = 3) AS n3,
    count(*) FILTER (WHERE rating = 2) AS n2, count(*) FILTER (WHERE rating = 1) AS n1, count(*) FILTER (WHERE rating <= 2) AS n_low, n5::DOUBLE / n AS p5, n1::DOUBLE / n AS p1, n_low::DOUBLE / n AS p_low,
    4.0::DOUBLE * p5 * p_low AS polarization, sum(CASE WHEN rating = 5 THEN picky_weight ELSE 0 END) AS picky_five_mass
  FROM ev GROUP BY work_id
), pri AS (
  SELECT sum(n5)::DOUBLE / sum(n) AS p5_all, avg(mean) AS mean_all, (sum(n5) FILTER (WHERE is_sf))::DOUBLE / sum(n) FILTER (WHERE is_sf) AS p5_sf, avg(mean) FILTER (WHERE is_sf) AS mean_sf FROM ws JOIN works USING (work_id)
), hist AS (
  SELECT user_id, count(*) AS n_rated, avg(rating) AS mean_rating, max(rating) AS max_star, count(*) FILTER (WHERE rating = 1) AS c1, count(*) FILTER (WHERE rating = 2) AS c2, count(*) FILTER (WHERE rating = 3) AS c3,
    count(*) FILTER (WHERE rating = 4) AS c4, count(*) FILTER (WHERE rating = 5) AS c5, count(DISTINCT rating) AS n_levels FROM ev GROUP BY user_id
), lithist AS (
  SELECT user_id, count(*) AS n_lit, count(*) FILTER (WHERE rating = 1) AS c1, count(*) FILTER (WHERE rating = 2) AS c2, count(*) FILTER (WHERE rating = 3) AS c3, count(*) FILTER (WHERE rating = 4) AS c4,
    count(*) FILTER (WHERE rating = 5) AS c5, count(DISTINCT rating) AS n_levels
  FROM ev WHERE work_id IN (SELECT work_id FROM works WHERE author_id IN (SELECT author_id FROM taste_authors WHERE side <> 'non_literary')) GROUP BY user_id
), ch AS (
  SELECT h.user_id, h.n_rated, coalesce(l.n_lit, 0) AS n_lit_rated, coalesce(l.n_lit, 0) >= 12 AS u, CASE WHEN u THEN l.n_lit ELSE h.n_rated END AS n_cdf, CASE WHEN u THEN l.n_levels ELSE h.n_levels END AS n_levels, CASE WHEN u THEN 'lit' ELSE 'full' END AS source,
    CASE WHEN u THEN l.c1 ELSE h.c1 END AS d1, CASE WHEN u THEN l.c2 ELSE h.c2 END AS d2, CASE WHEN u THEN l.c3 ELSE h.c3 END AS d3, CASE WHEN u THEN l.c4 ELSE h.c4 END AS d4, CASE WHEN u THEN l.c5 ELSE h.c5 END AS d5
  FROM hist h LEFT JOIN lithist l ON l.user_id = h.user_id WHERE h.n_rated >= 20 AND h.n_levels >= 2
), pct AS (
  SELECT user_id, n_rated, n_lit_rated, n_cdf, n_levels, source, d1 / (2.0::DOUBLE * n_cdf) AS pct_1, (2 * d1 + d2) / (2.0::DOUBLE * n_cdf) AS pct_2, (2 * (d1 + d2) + d3) / (2.0::DOUBLE * n_cdf) AS pct_3,
    (2 * (d1 + d2 + d3) + d4) / (2.0::DOUBLE * n_cdf) AS pct_4, (2 * (d1 + d2 + d3 + d4) + d5) / (2.0::DOUBLE * n_cdf) AS pct_5 FROM ch
), likes AS (
  SELECT e.user_id, w.author_id, a.side, a.prestige, count(*) AS n_liked, count(*) FILTER (WHERE rating = 5) AS n_five FROM ev e JOIN works w USING (work_id) JOIN taste_authors a ON a.author_id = w.author_id WHERE rating >= 4 GROUP BY ALL
), tst AS (
  SELECT *, lit_hits::DOUBLE / (lit_hits + com_hits) AS lit_share, com_hits::DOUBLE / (lit_hits + com_hits) AS com_share, greatest(0.0::DOUBLE, lit_hits::DOUBLE / (lit_hits + com_hits)) * ln(1 + lit_mass) AS lit_weight FROM (
    SELECT user_id, coalesce(sum(n_liked) FILTER (WHERE side <> 'non_literary'), 0)::BIGINT AS lit_hits, coalesce(sum(n_five) FILTER (WHERE side = 'non_literary'), 0)::BIGINT AS com_hits,
      coalesce(sum(prestige * n_liked) FILTER (WHERE side <> 'non_literary'), 0)::DOUBLE AS lit_mass FROM likes GROUP BY user_id
  ) WHERE lit_hits + com_hits > 0
), poll AS (SELECT w.work_id, s.n, a.prestige, 1.0::DOUBLE / ln(2 + s.n) AS rarity FROM works w JOIN taste_authors a ON a.author_id = w.author_id AND a.side = 'literary_poll' JOIN ws s ON s.work_id = w.work_id)"""


def _hits(name: str, stars: int) -> str:
    return f"""{name} AS (
  SELECT e.user_id, count(*) AS n_poll_works, sum(rarity * prestige) AS rarity_mass, count(*) FILTER (WHERE p.n <= (SELECT median(n) FROM poll)) AS n_rare_poll,
    count(*) FILTER (WHERE e.rating = h.max_star OR e.rating >= 4) AS n_poll_loved
  FROM ev e JOIN poll p ON p.work_id = e.work_id JOIN hist h ON h.user_id = e.user_id WHERE e.rating >= {stars} GROUP BY e.user_id
)"""


_BOOST = "power(ln(1.0::DOUBLE + {0} * 5.0::DOUBLE), 1.35::DOUBLE)"
_PURE = """power(greatest(lit_share, 0.01::DOUBLE), 1.25::DOUBLE) * power(greatest(1.0::DOUBLE - com_hits::DOUBLE / (lit_hits + com_hits), 0.05::DOUBLE), 2.0::DOUBLE)"""
_PURE_IF = "lit_share >= 0.55 AND com_hits <= greatest(1, (lit_hits * 180 + 500) // 1000) AND (lit_hits - com_hits)::DOUBLE / (lit_hits + com_hits) >= 0.20"
COHORTS = f"""{DERIVED}, tq AS (SELECT * REPLACE (com_hits // 4 AS com_hits) FROM tst), {_hits("h4", 4)}, {_hits("h3", 3)},
star0 AS (
  SELECT t.*, k.n_rated, k.five_rate, h.mean_rating, coalesce(p.n_poll_works, 0) AS n_poll_works, coalesce(p.n_rare_poll, 0) AS n_rare_poll, {_BOOST.format("coalesce(p.rarity_mass, 0)")} AS boost,
    CASE WHEN k.five_rate BETWEEN 0.10 AND 0.42 AND h.mean_rating BETWEEN 3.05 AND 4.05 THEN 1.0::DOUBLE WHEN k.five_rate BETWEEN 0.08 AND 0.50 AND h.mean_rating BETWEEN 2.95 AND 4.15 THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END AS gate
  FROM tq t JOIN pick k ON k.user_id = t.user_id JOIN hist h ON h.user_id = t.user_id LEFT JOIN h4 p ON p.user_id = t.user_id
  WHERE t.lit_hits >= 4 AND t.com_hits <= greatest(3, (t.lit_hits * 350 + 500) // 1000) AND k.n_rated >= 25 AND h.c5 >= 1
), star AS (
  SELECT *, percent_rank() OVER (ORDER BY weight) AS weight_pctile FROM (SELECT *, gate * lit_weight * (0.35::DOUBLE + 0.65::DOUBLE * boost / (SELECT max(boost) FROM star0)) AS weight FROM star0)
  WHERE gate >= 0.55 AND n_poll_works >= 3 AND n_rare_poll >= 1
), pct0 AS (
  SELECT t.*, k.n_rated, k.five_rate, h.mean_rating, x.n_levels AS own_levels, p.n_poll_works, p.n_rare_poll, p.n_poll_loved, {_BOOST.format("p.rarity_mass")} AS boost
  FROM tq t JOIN pick k ON k.user_id = t.user_id JOIN hist h ON h.user_id = t.user_id JOIN pct x ON x.user_id = t.user_id JOIN h3 p ON p.user_id = t.user_id
  WHERE t.lit_hits >= 2 AND t.com_hits <= greatest(5, (t.lit_hits * 650 + 500) // 1000) AND k.n_rated >= 25 AND x.n_levels >= 2 AND p.n_poll_works >= 2 AND p.n_poll_loved >= 1
), pctc AS (
  SELECT *, percent_rank() OVER (ORDER BY weight) AS weight_pctile FROM (SELECT *, lit_weight * (0.30::DOUBLE + 0.70::DOUBLE * boost / (SELECT max(boost) FROM pct0)) AS weight FROM pct0) WHERE weight > 0
), pure AS (
  SELECT *, percent_rank() OVER (ORDER BY weight) AS weight_pctile FROM (SELECT * EXCLUDE (weight, weight_pctile), weight * {_PURE} AS weight FROM star WHERE {_PURE_IF}) WHERE weight > 0
), pctpure AS (
  SELECT *, percent_rank() OVER (ORDER BY weight) AS weight_pctile FROM (SELECT * EXCLUDE (weight, weight_pctile), weight * {_PURE} AS weight FROM pctc WHERE {_PURE_IF} AND n_poll_works >= 3 AND lit_hits >= 4) WHERE weight > 0
), dp AS (SELECT * FROM poll WHERE n < 30),
du AS (SELECT e.user_id, count(*) AS n_deep, count(*) FILTER (WHERE d.n <= (SELECT quantile_cont(n, 0.55) FROM dp)) AS n_deep_rare, sum(rarity * prestige) AS deep_mass FROM ev e JOIN dp d ON d.work_id = e.work_id WHERE e.rating >= 4 GROUP BY e.user_id),
cu AS (SELECT e.user_id, count(*) AS n_common FROM ev e JOIN poll d ON d.work_id = e.work_id AND d.n >= 30 WHERE e.rating >= 4 GROUP BY e.user_id),
deep0 AS (
  SELECT c.* EXCLUDE (boost, com_share), d.n_deep, d.n_deep_rare, d.n_deep::DOUBLE / (d.n_deep + coalesce(u.n_common, 0)) AS deep_share, c.com_hits::DOUBLE / (c.lit_hits + c.com_hits) AS com_share, {_BOOST.format("d.deep_mass")} AS boost
  FROM pctc c JOIN du d ON d.user_id = c.user_id LEFT JOIN cu u ON u.user_id = c.user_id
), deep1 AS (SELECT * FROM deep0 WHERE n_deep >= 2 AND n_deep_rare >= 1 AND deep_share >= 0.2 AND com_share <= 0.35),
deep AS (
  SELECT *, percent_rank() OVER (ORDER BY weight) AS weight_pctile FROM (
    SELECT * EXCLUDE (weight, weight_pctile), weight * power(greatest(deep_share, 0.05::DOUBLE), 1.8::DOUBLE) * power(greatest(1.0::DOUBLE - com_share, 0.02::DOUBLE), 3.0::DOUBLE) * (0.1::DOUBLE + 0.9::DOUBLE * boost / (SELECT max(boost) FROM deep1)) AS weight FROM deep1
  ) WHERE weight > 0
)"""

_STATS = ["mean", "std", "p5", "p1", "p_low", "polarization", "picky_five_mass"]
_TASTE = ["lit_mass", "lit_share", "com_share", "lit_weight"]


def _rounded(df, columns):
    return df.select(*[six(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def _round_sql(columns, rounded):
    return ", ".join(f"round({c}, 6) AS {c}" if c in rounded else c for c in columns)


QUERIES, SQL = {}, {}


def _add(name, query, sql):
    QUERIES[name], SQL[name] = query, sql


_add("edition_collapse", lambda s, d: Model(s, d).ratings, f"WITH {DERIVED} SELECT * FROM ratings")
_add("observation_collapse", lambda s, d: collapse.collapse_observations(Tables(s, d).interactions), f"WITH {CTE} SELECT user_id, work_id, bool_or(is_read) AS is_read, max(rating)::INTEGER AS rating, count(*) AS edition_interactions FROM inter GROUP BY ALL")
_add(
    "temporal_collapse",
    lambda s, d: collapse.collapse_times(Tables(s, d).interactions, 820454400, 915148800),
    f"WITH {CTE} SELECT user_id, work_id, min(added_at) FILTER (WHERE added_at >= 820454400 AND added_at < 915148800) AS first_added, max(added_at) AS last_added, max(rating) AS rating, count(*) FILTER (WHERE added_at >= 820454400 AND added_at < 915148800) AS in_band FROM inter GROUP BY ALL",
)
_add(
    "representative_edition",
    lambda s, d: collapse.representative_edition(Tables(s, d).interactions.groupBy("work_id", "book_id").agg(F.count(F.lit(1)).alias("n"), F.max("rating").alias("best")), "n", "book_id", ["book_id", "n", F.col("best").alias("rating")]),
    f"WITH {CTE}, b AS (SELECT work_id, book_id, count(*) AS n, max(rating) AS rating FROM inter GROUP BY ALL) SELECT work_id, book_id, n, rating FROM b QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY n DESC, book_id DESC) = 1",
)
_add(
    "mode_with_tie_break",
    lambda s, d: collapse.mode_by(Tables(s, d).interactions, ["work_id"], "rating"),
    f"WITH {CTE}, c AS (SELECT work_id, rating, count(*) AS n FROM inter GROUP BY ALL) SELECT work_id, rating, n FROM c QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY n DESC, rating) = 1",
)
_add(
    "choose_state",
    lambda s, d: collapse.choose_state(Tables(s, d).interactions, ["user_id", "work_id"], [F.desc("rating"), F.desc("is_read"), F.desc("added_at"), "book_id"]).select("user_id", "work_id", "book_id", "rating", "is_read"),
    f"WITH {CTE} SELECT user_id, work_id, book_id, rating, is_read FROM (SELECT DISTINCT * FROM inter) QUALIFY row_number() OVER (PARTITION BY user_id, work_id ORDER BY rating DESC, is_read DESC, added_at DESC, book_id) = 1",
)
_add("user_pickiness", lambda s, d: _rounded(Model(s, d).pickiness, ["five_rate"]), f"WITH {DERIVED} SELECT user_id, n_rated, n_five, round(five_rate, 6) AS five_rate FROM pick")
_add("picky_rating_events", lambda s, d: _rounded(Model(s, d).events, ["five_rate", "picky_weight"]), f"WITH {DERIVED} SELECT work_id, user_id, rating, n_rated, round(five_rate, 6) AS five_rate, round(picky_weight, 6) AS picky_weight, is_sf FROM ev")
_WS = ["work_id", "n", "mean", "std", "n5", "n4", "n3", "n2", "n1", "n_low", "p5", "p1", "p_low", "polarization", "picky_five_mass"]
_add("work_stats", lambda s, d: _rounded(Model(s, d).work_stats, _STATS), f"WITH {DERIVED} SELECT {_round_sql(_WS, _STATS)} FROM ws")
_PRI = ["p5_all", "mean_all", "p5_sf", "mean_sf"]
_add("global_priors", lambda s, d: _rounded(Model(s, d).priors, _PRI), f"WITH {DERIVED} SELECT {_round_sql(_PRI, _PRI)} FROM pri")
_add(
    "retarget_genre",
    lambda s, d: (lambda m: stats.retarget(m.works, m.base.shelves.filter("shelf = 'small'")).select("work_id", "is_sf"))(Model(s, d)),
    f"WITH {CTE} SELECT work_id, work_id IN (SELECT work_id FROM shelves WHERE shelf = 'small') AS is_sf FROM works",
)
_add("star_histogram", lambda s, d: _rounded(stats.star_histogram(Model(s, d).events), ["mass"]), f"WITH {DERIVED} SELECT k::INTEGER AS star, (SELECT count(*) FROM ev WHERE rating = k)::DOUBLE AS mass FROM range(1, 6) t(k)")
_add(
    "weighted_star_histogram",
    lambda s, d: (lambda m: _rounded(stats.star_histogram(m.events.join(m.taste.select("user_id", "lit_weight"), "user_id"), "lit_weight"), ["mass"]))(Model(s, d)),
    f"WITH {DERIVED} SELECT k::INTEGER AS star, round(coalesce((SELECT sum(lit_weight) FROM ev JOIN tst USING (user_id) WHERE rating = k), 0), 6) AS mass FROM range(1, 6) t(k)",
)
_add("user_star_hist", lambda s, d: _rounded(Model(s, d).hist, ["mean_rating"]), f"WITH {DERIVED} SELECT user_id, n_rated, round(mean_rating, 6) AS mean_rating, max_star, c1, c2, c3, c4, c5, n_levels FROM hist")
_PCT = [f"pct_{k}" for k in range(1, 6)]
_add("user_percentiles", lambda s, d: _rounded(Model(s, d).percentiles, _PCT), f"WITH {DERIVED} SELECT user_id, n_rated, n_lit_rated, n_cdf, n_levels, source, {_round_sql(_PCT, _PCT)} FROM pct")
_add("author_likes", lambda s, d: _rounded(Model(s, d).likes, ["prestige"]), f"WITH {DERIVED} SELECT user_id, author_id, side, round(prestige, 6) AS prestige, n_liked, n_five FROM likes")
_add("user_taste", lambda s, d: _rounded(Model(s, d).taste, _TASTE), f"WITH {DERIVED} SELECT user_id, lit_hits, com_hits, {_round_sql(_TASTE, _TASTE)} FROM tst")
_add("poll_works", lambda s, d: _rounded(Model(s, d).poll, ["prestige", "rarity"]), f"WITH {DERIVED} SELECT work_id, n, round(prestige, 6) AS prestige, round(rarity, 6) AS rarity FROM poll")
_add(
    "taste_filter",
    lambda s, d: taste.taste_eligible(Model(s, d).taste, min_lit_share=0.5, max_com_share=0.4, min_net=0.1, min_lit_hits=2, max_com_hits=6).select("user_id"),
    f"WITH {DERIVED} SELECT user_id FROM tst WHERE lit_share >= 0.5 AND com_share <= 0.4 AND (lit_hits - com_hits)::DOUBLE / (lit_hits + com_hits) >= 0.1 AND lit_hits >= 2 AND com_hits <= 6",
)
_COHORT_SQL = {"star": "star", "pct": "pctc", "pure": "pure", "pct_pure": "pctpure", "deep": "deep"}
for _name, _table in _COHORT_SQL.items():
    _add(
        f"{_name}_curators",
        lambda s, d, n=_name: Model(s, d).cohort(n).select("user_id", "lit_hits", "com_hits", "n_poll_works", "n_rare_poll", six(F.col("weight")).alias("weight"), six(F.col("weight_pctile")).alias("weight_pctile")),
        f"WITH {COHORTS} SELECT user_id, lit_hits, com_hits, n_poll_works, n_rare_poll, round(weight, 6) AS weight, round(weight_pctile, 6) AS weight_pctile FROM {_table}",
    )
_add(
    "elite_keep",
    lambda s, d: taste.elite(Model(s, d).cohort("pct").withColumn("weight", F.round("weight", 9)), 60).select("user_id"),
    f"WITH {COHORTS}, r AS (SELECT user_id, row_number() OVER (ORDER BY round(weight, 9) DESC, user_id) AS k, count(*) OVER () AS n FROM pctc) SELECT user_id FROM r WHERE k <= ceil(round(power(n::DOUBLE, 1 - 0.6) * power(least(n, 100)::DOUBLE, 0.6), 9))",
)
_add(
    "cohort_gates",
    lambda s, d: Model(s, d).cohort("pct").filter(taste.volume_gates(40, True) & taste.purity_gate(30)).select("user_id", six(taste.deweight(50)).alias("vote")),
    f"WITH {COHORTS} SELECT user_id, round(power(weight, 2.0::DOUBLE) * exp(-4.0::DOUBLE * (1 - weight_pctile)), 6) AS vote FROM pctc WHERE com_hits <= lit_hits * (0.90::DOUBLE - 0.4::DOUBLE * 0.55::DOUBLE) AND n_rated >= 40 AND n_poll_works >= 3 AND n_rare_poll >= 1 AND lit_hits >= 3 AND lit_share >= 0.8::DOUBLE * 0.3::DOUBLE AND com_hits::DOUBLE / (lit_hits + com_hits) <= 1 - 0.92::DOUBLE * 0.3::DOUBLE",
)

# Ranking: the same scores, written out per audience.
_M, _DW = 50.0, 30.0
_W = "power(c.weight, 1.2::DOUBLE) * exp(-2.4::DOUBLE * (1 - c.weight_pctile))"
_PLAIN = "count(*)::DOUBLE AS n, (count(*) FILTER (WHERE rating = 5))::DOUBLE AS n5, avg(rating) AS mean, stddev_pop(rating) AS std, n5 / n AS p5, (count(*) FILTER (WHERE rating <= 2))::DOUBLE / n AS p_low, sum(CASE WHEN rating = 5 THEN picky_weight ELSE 0 END) AS picky_five_mass"
_WEIGHTED = """count(*)::DOUBLE AS n, sum(w) AS w_sum, sum(w * rating) AS w_rating_sum, coalesce(sum(w) FILTER (WHERE rating = 5), 0) AS w_five, coalesce(sum(w) FILTER (WHERE rating >= 4), 0) AS w_high, sum(w * power(rating / 5.0::DOUBLE, 3.5::DOUBLE)) AS w_power,
  sum(w * power(rating / 5.0::DOUBLE, 3.5::DOUBLE) * rating) AS w_power_rating, (count(*) FILTER (WHERE five_rate <= 0.25))::DOUBLE AS n_stingy, (count(*) FILTER (WHERE five_rate <= 0.25 AND rating = 5))::DOUBLE AS n5_stingy"""
_STARS = "power(sum(w), 2) / sum(w * w) AS n, sum(w) AS w_sum, sum(w * rating) AS w_rating_sum, coalesce(sum(w) FILTER (WHERE rating = 5), 0) AS w_five, coalesce(sum(w) FILTER (WHERE rating >= 4), 0) AS w_high"
_LOVE, _HATED = "power(pct, 3.2::DOUBLE)", "power(1 - pct, 2.2::DOUBLE)"
_OWN = f"""power(sum(w), 2) / sum(w * w) AS n, sum(w) AS w_sum, sum(w * pct) AS w_rating_sum, coalesce(sum(w) FILTER (WHERE pct >= 0.88), 0) AS w_five, coalesce(sum(w) FILTER (WHERE pct >= 0.70 AND pct < 0.88), 0) AS w_mid, sum(w * {_LOVE}) AS w_power,
  sum(w * ({_LOVE} - 1.35::DOUBLE * {_HATED})) AS w_asymm, sum(w * ({_LOVE} - 0.45::DOUBLE * {_HATED})) AS w_tilt,
  coalesce(sum(w * CASE rating WHEN 5 THEN 4.0::DOUBLE WHEN 4 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * power(pct, 2.5::DOUBLE)) FILTER (WHERE rating >= 3 AND pct >= 0.5), 0) AS w_geom"""


def _agg_sql(audience):
    if audience == "all":
        return f"SELECT work_id, {_PLAIN} FROM ev GROUP BY work_id"
    if audience == "stingy":
        return f"SELECT work_id, {_PLAIN} FROM ev WHERE five_rate <= 0.25 GROUP BY work_id"
    if audience in ("lit", "combo", "cross"):
        w = "coalesce(lit_weight, 0)" + ("" if audience == "lit" else " * power(picky_weight, 0.9::DOUBLE)")
        w = f"CASE WHEN coalesce(lit_weight, 0) > 0 THEN {w} ELSE 0 END" if audience == "cross" else w
        keep = "" if audience == "cross" else " WHERE lit_weight > 0"
        return f"SELECT work_id, {_WEIGHTED} FROM (SELECT ev.*, {w} AS w FROM ev LEFT JOIN tst ON tst.user_id = ev.user_id{keep}) GROUP BY work_id"
    c = _COHORT_SQL[audience]
    if audience in ("star", "pure"):
        return f"SELECT work_id, {_STARS} FROM (SELECT ev.*, {_W} AS w FROM ev JOIN {c} c ON c.user_id = ev.user_id) WHERE w > 0 GROUP BY work_id"
    return f"SELECT work_id, {_OWN} FROM (SELECT ev.*, {_W} AS w, CASE rating WHEN 1 THEN pct_1 WHEN 2 THEN pct_2 WHEN 3 THEN pct_3 WHEN 4 THEN pct_4 ELSE pct_5 END AS pct FROM ev JOIN {c} c ON c.user_id = ev.user_id JOIN pct ON pct.user_id = ev.user_id) WHERE w > 0 GROUP BY work_id"


def _cover(mass):
    return f"(0.4::DOUBLE * ({mass}) / (w_sum + 50) + 0.6::DOUBLE * ({mass}) / (cw + 50))"


_SHRUNK = "({0} + 50 * p0) / ({1} + 50)"
_GEM = "{0} * (ln({1} + 1) / ln(10.0::DOUBLE)) / (1 + {2} / {3}::DOUBLE)"
_ASYMM_PRIOR = "(power(0.5::DOUBLE, 3.2::DOUBLE) - 1.35::DOUBLE * power(0.5::DOUBLE, 2.2::DOUBLE))"
_SCORE_SQL = {
    "five_count": "n5", "five_rate": _SHRUNK.format("n5", "n"), "imdb": "n / (n + 50) * mean + 50 / (n + 50) * c0", "mean": "(mean * n + 50 * c0) / (n + 50)", "picky_mass": "picky_five_mass", "polarization": "4 * p5 * p_low", "stddev": "std",
    "hidden_gem": _GEM.format(_SHRUNK.format("n5", "n"), "n", "n", "20000.0"), "picky_gem": _GEM.format(_SHRUNK.format("n5", "n"), "n", "n", "8000.0"), "w_imdb": "w_sum / (w_sum + 50) * (w_rating_sum / w_sum) + 50 / (w_sum + 50) * c0", "w_five": "w_five",
    "w_five_rate": _SHRUNK.format("w_five", "w_sum"), "w_liked": _SHRUNK.format("w_high", "w_sum"), "lit_gem": _GEM.format(_SHRUNK.format("w_five", "w_sum"), "w_sum", "n", "20000.0"),
    "combo_gem": _GEM.format(_SHRUNK.format("w_five", "w_sum"), "w_sum", "n", "10000.0") + " * w_sum / (w_sum + 20)", "combo_love": "w_five / power(1 + n / 400.0::DOUBLE, 0.55::DOUBLE)",
    "combo_power": "w_power / (w_power + 50) * (w_power_rating / nullif(w_power, 0)) + 50 / (w_power + 50) * c0",
    "combo_wilson": "((w_five / w_sum + z * z / (2 * w_sum) - z * sqrt(greatest(w_five / w_sum * (1 - w_five / w_sum) / w_sum + z * z / (4 * w_sum * w_sum), 0))) / (1 + z * z / w_sum)) * w_sum / (w_sum + 20)".replace("z", "1.645::DOUBLE"),
    "cross": f"sqrt(greatest({_SHRUNK.format('w_five', 'w_sum')}, 0) * greatest({_SHRUNK.format('n5_stingy', 'n_stingy')}, 0))", "curator_gem": _GEM.format(_SHRUNK.format("w_five", "w_sum"), "w_sum", "n", "8000.0") + " * w_sum / (w_sum + 12)",
    "pct_mean": "0.4::DOUBLE * (w_rating_sum + 25) / (w_sum + 50) + 0.6::DOUBLE * (w_rating_sum + greatest(cw - w_sum, 0) * 0.5::DOUBLE + 25) / (cw + 50)", "pct_love": _cover("w_power + 50 * power(0.5::DOUBLE, 3.2::DOUBLE)"), "pct_geom": _cover("w_geom + 50 * power(0.5::DOUBLE, 2.5::DOUBLE)"),
    "pct_asymm": _cover(f"w_asymm + 50 * {_ASYMM_PRIOR}"), "pct_tilt": _cover(f"w_tilt + 50 * {_ASYMM_PRIOR}"), "pct_gap": _cover("w_five - 0.55::DOUBLE * w_mid + 7.5::DOUBLE"), "pct_top": _cover("w_five + 7.5::DOUBLE"),
    "pct_gem": _GEM.format(_cover("w_five + 7.5::DOUBLE"), "w_sum", "n", "8000.0") + " * w_sum / (w_sum + 12)",
}
PARAMS = ranking.Params(m=_M, coverage=0.6, deweight=_DW, min_n=5.0)


def _rank_sql(method):
    m = ranking.METHODS[method]
    least = "n >= 5" + (" AND n >= 20" if m.score == "picky_gem" else "") + (" AND n_stingy >= 20" if m.audience == "cross" else "") + ("" if m.audience in ("all", "stingy") else " AND w_sum >= 1")
    whole = f", (SELECT sum({_W}) AS cw FROM {_COHORT_SQL[m.audience]} c)" if m.audience in _COHORT_SQL else ""
    ctes = COHORTS if m.audience in _COHORT_SQL else DERIVED
    return f"WITH {ctes}, agg AS ({_agg_sql(m.audience)}) SELECT work_id, round(n, 6) AS n, round({_SCORE_SQL[m.score]}, 6) AS score FROM agg, (SELECT p5_all AS p0, mean_all AS c0 FROM pri){whole} WHERE {least} ORDER BY score DESC NULLS LAST, n DESC, work_id LIMIT 200"


for _name in ranking.METHODS:
    _add(f"rank_{_name}", lambda s, d, n=_name: (lambda m: ranking.rank(n, m.inputs(ranking.METHODS[n].audience), PARAMS))(Model(s, d)), _rank_sql(_name))


def _simple(metric, scale):
    return lambda s, d: (lambda m: ranking.rank_simple(m.events, m.percentiles, m.cohort("pct").select("user_id", taste.deweight(_DW).alias("w")), metric, scale))(Model(s, d))


_SIMPLE = {
    "love": "0.5::DOUBLE * (wl + 5 * power(0.5::DOUBLE, 3.2::DOUBLE)) / (w_sum + 5) + 0.5::DOUBLE * (wl + 5 * power(0.5::DOUBLE, 3.2::DOUBLE)) / (cw + 5)",
    "bayesian": "0.5::DOUBLE * (wv + 2.5::DOUBLE) / (w_sum + 5) + 0.5::DOUBLE * (wv + 2.5::DOUBLE) / (cw + 5)",
    "mean": "wv / w_sum",
    "top_rate": "0.5::DOUBLE * (wt + 0.75::DOUBLE) / (w_sum + 5) + 0.5::DOUBLE * (wt + 0.75::DOUBLE) / (cw + 5)",
    "reads": "w_sum",
}
for _metric, _score in _SIMPLE.items():
    for _scale in ("adjusted", "stars"):
        _v = "CASE rating WHEN 1 THEN pct_1 WHEN 2 THEN pct_2 WHEN 3 THEN pct_3 WHEN 4 THEN pct_4 ELSE pct_5 END" if _scale == "adjusted" else "rating / 5.0::DOUBLE"
        _top = "v >= 0.88" if _scale == "adjusted" else "rating = 5"
        _add(
            f"simple_{_metric}_{_scale}",
            _simple(_metric, _scale),
            f"""WITH {COHORTS}, v AS (SELECT work_id, rating, {_W} AS w, {_v} AS v FROM ev JOIN pctc c ON c.user_id = ev.user_id {"JOIN pct ON pct.user_id = ev.user_id" if _scale == "adjusted" else ""}),
a AS (SELECT work_id, power(sum(w), 2) / sum(w * w) AS n, sum(w) AS w_sum, sum(w * v) AS wv, sum(w * power(v, 3.2::DOUBLE)) AS wl, coalesce(sum(w) FILTER (WHERE {_top}), 0) AS wt FROM v WHERE w > 1e-9 GROUP BY work_id)
SELECT work_id, round(n, 6) AS n, round({_score}, 6) AS score FROM a, (SELECT sum({_W}) AS cw FROM pctc c) WHERE n >= 5 ORDER BY score DESC NULLS LAST, n DESC, work_id LIMIT 200""",
        )
