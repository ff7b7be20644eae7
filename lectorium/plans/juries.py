"""Queries and SQL of juries, cohorts by sliders, signal lists and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectorium.functions.storage import saved
from lectorium.operators import cohort, evaluation, genres, graph, juries, pairwise, signals
from lectorium.plans.adapter import CTE, Tables
from lectorium.plans.ratings import COHORTS, DERIVED, Model
from lectorium.plans.research import _EDGES, _edges, _reflections_sql, _whole

QUERIES, SQL = {}, {}


def _add(name, query, sql):
    QUERIES[name], SQL[name] = query, sql


def _r(df, *columns):
    return df.select(*[F.round(F.col(c).cast("double"), 9).alias(c) if c in columns else F.col(c) for c in df.columns])


# The synthetic works have about 30 ratings each, so the floors on popularity are lower than the operators' own.
FLOORS = {"least_n": 20, "least_votes": 3}
MIDPOP, POPULAR, ENGAGED, SOME = 28, 36, {"least_rated": 30, "least_midpop": 8, "least_popular": 2}, {"least_rated": 25, "least_midpop": 5}


def _jury_tables(s, d):
    m = Model(s, d)
    rarity = m._get("rarity", lambda: juries.work_rarity(m.events, 10))
    return m.events, rarity, m._get("reader_features", lambda: juries.reader_features(m.events, rarity, midpop=MIDPOP, popular=POPULAR))


_JURY = f"""{DERIVED}, wr AS (SELECT work_id, count(*) AS n, count(*) FILTER (WHERE rating = 5) AS n5, avg(rating) AS mean, 1.0::DOUBLE / ln(1.0::DOUBLE + count(*)) AS rarity FROM ev GROUP BY work_id HAVING count(*) >= 10),
uf AS (SELECT user_id, count(*) AS n_rated, avg(rating) AS mean_rating, count(*) FILTER (WHERE rating = 5)::DOUBLE / count(*) AS five_rate, avg(rarity) FILTER (WHERE rating >= 4) AS depth_ge4, avg(rarity) FILTER (WHERE rating = 5) AS depth_5,
  count(*) FILTER (WHERE rating >= 4 AND n >= {MIDPOP}) AS n_ge4_midpop, count(*) FILTER (WHERE rating >= 4 AND n >= {POPULAR}) AS n_ge4_popular, avg(ln(1.0::DOUBLE + n)) FILTER (WHERE rating = 5) AS mean_logn_5, count(*) FILTER (WHERE rating >= 4) AS n_ge4, count(*) FILTER (WHERE rating = 5) AS n5
  FROM ev JOIN wr USING (work_id) GROUP BY user_id HAVING count(*) >= 20 AND count(*) FILTER (WHERE rating >= 4) >= 5),
en AS (SELECT * FROM uf WHERE depth_ge4 IS NOT NULL AND n_rated >= 30 AND n_ge4_midpop >= 8 AND n_ge4_popular >= 2), so AS (SELECT * FROM uf WHERE depth_ge4 IS NOT NULL AND n_rated >= 25 AND n_ge4_midpop >= 5),
deep AS (SELECT user_id FROM en WHERE round(depth_ge4, 12) >= (SELECT round(quantile_cont(depth_ge4, 0.8), 12) FROM en))"""
_P5 = "SELECT work_id, round((count(*) FILTER (WHERE rating = 5) + {k}::DOUBLE) / (count(*) + 30), 9) AS score, count(*)::DOUBLE AS n_eff FROM ev JOIN {jury} USING (user_id) JOIN wr USING (work_id) WHERE n >= 20 GROUP BY work_id HAVING count(*) >= 3"
_FEATURES = ["mean_rating", "five_rate", "depth_ge4", "depth_5", "mean_logn_5"]
_add("reader_features", lambda s, d: _r(_jury_tables(s, d)[2], *_FEATURES), f"WITH {_JURY} SELECT user_id, n_rated, n_ge4_midpop, n_ge4_popular, n_ge4, n5, " + ", ".join(f"round({c}, 9) AS {c}" for c in _FEATURES) + " FROM uf")


def _deep(u):
    return juries.beyond(juries.engaged(u, **ENGAGED), "depth_ge4", 0.8)


_add("depth_curators_p5", lambda s, d: (lambda e, w, u: _r(juries.jury_p5(e, _deep(u), w, **FLOORS), "score"))(*_jury_tables(s, d)), f"WITH {_JURY} " + _P5.format(k=7.5, jury="deep"))
_add(
    "depth_curators_love",
    lambda s, d: (lambda e, w, u: _r(juries.jury_love(e, _deep(u), w, **FLOORS), "score"))(*_jury_tables(s, d)),
    f"WITH {_JURY} SELECT work_id, round((coalesce(sum(rarity) FILTER (WHERE rating = 5), 0) + 0.6::DOUBLE) / (count(*) + 30), 9) AS score, count(*)::DOUBLE AS n_eff FROM ev JOIN deep USING (user_id) JOIN wr USING (work_id) WHERE n >= 20 GROUP BY work_id HAVING count(*) >= 3",
)
_add(
    "picky_curators",
    lambda s, d: (lambda e, w, u: _r(juries.jury_p5(e, juries.beyond(u.filter("n_rated >= 25 AND n_ge4_midpop >= 5"), "five_rate", 0.2, above=False), w, p0=0.2, **FLOORS), "score"))(*_jury_tables(s, d)),
    f"WITH {_JURY}, pk AS (SELECT user_id FROM so WHERE round(five_rate, 12) <= (SELECT round(quantile_cont(five_rate, 0.2), 12) FROM so)) " + _P5.format(k=6, jury="pk"),
)
_add(
    "audience_depth",
    lambda s, d: (lambda e, w, u: _r(juries.audience_depth(e, u, w, **SOME, **FLOORS), "score"))(*_jury_tables(s, d)),
    f"WITH {_JURY}, a AS (SELECT work_id, count(*) AS c, avg(depth_ge4) AS dp FROM ev JOIN so USING (user_id) JOIN wr USING (work_id) WHERE rating = 5 AND n >= 20 GROUP BY work_id HAVING count(*) >= 3) SELECT work_id, round(c / (c + 40.0::DOUBLE) * dp + 40 / (c + 40.0::DOUBLE) * (SELECT avg(depth_ge4) FROM uf), 9) AS score, c::DOUBLE AS n_eff FROM a",
)
_add(
    "depth_weighted",
    lambda s, d: (lambda e, w, u: _r(juries.depth_weighted(e, u, w, **SOME, **FLOORS), "score", "n_eff"))(*_jury_tables(s, d)),
    f"WITH {_JURY}, a AS (SELECT work_id, sum(depth_ge4 * depth_ge4) AS w, coalesce(sum(depth_ge4 * depth_ge4) FILTER (WHERE rating = 5), 0) AS w5, power(sum(depth_ge4 * depth_ge4), 2) / sum(power(depth_ge4, 4)) AS k FROM ev JOIN so USING (user_id) JOIN wr USING (work_id) WHERE n >= 20 GROUP BY work_id HAVING count(*) >= 3) SELECT work_id, round((w5 + 7.5::DOUBLE) / (w + 30), 9) AS score, round(k, 9) AS n_eff FROM a WHERE round(k, 9) >= 3",
)
_add(
    "anti_blockbuster",
    lambda s, d: (lambda e, w, u: _r(juries.jury_p5(e, juries.resisters(e, u, w, top=0.8, least_rated=25, quantile=0.7), w, **FLOORS), "score"))(*_jury_tables(s, d)),
    f"WITH {_JURY}, bb AS (SELECT work_id FROM wr WHERE n >= (SELECT quantile_cont(n, 0.8) FROM wr)), rs AS (SELECT user_id, any_value(uf.five_rate) AS fr, 1 - count(*) FILTER (WHERE rating = 5)::DOUBLE / count(*) AS resist FROM ev JOIN bb USING (work_id) JOIN uf USING (user_id) WHERE uf.n_rated >= 25 GROUP BY user_id HAVING count(*) >= 8), rj AS (SELECT user_id FROM rs WHERE round(resist, 12) >= (SELECT round(quantile_cont(resist, 0.7), 12) FROM rs) AND fr <= 0.45) "
    + _P5.format(k=7.5, jury="rj"),
)
_add(
    "negative_reflection",
    lambda s, d: _r(juries.shrunk_reflection(graph.reflections(_edges(s, d), 2), least=5), "score"),
    f"WITH {_whole(_reflections_sql(2))} SELECT work_id, round(-k2.v * k0.v / (k0.v + 40), 9) AS score, k0.v AS n_eff FROM k2 JOIN k0 USING (work_id) WHERE k0.v >= 5",
)
_add(
    "high_order_reflection",
    lambda s, d: juries.shrunk_reflection(graph.reflections(_edges(s, d), 14), least=5, absolute=True).withColumn("score", F.round("score", 6)),
    f"WITH {_whole(_reflections_sql(14))} SELECT work_id, round(abs(k14.v) * k0.v / (k0.v + 40), 6) AS score, k0.v AS n_eff FROM k14 JOIN k0 USING (work_id) WHERE k0.v >= 5",
)
_add(
    "niche_enthusiasts",
    lambda s, d: (lambda e, w, u: _r(juries.jury_p5(e, juries.niche_readers(_edges(s, d)), w, **FLOORS), "score"))(*_jury_tables(s, d)),
    f"WITH {_JURY}, ed AS (SELECT e.user_id, e.work_id FROM ev e WHERE rating >= 4), kk AS (SELECT work_id, count(*) AS k FROM ed GROUP BY 1), bi AS (SELECT user_id, round(avg(k), 9) AS b FROM ed JOIN kk USING (work_id) GROUP BY user_id), nj AS (SELECT user_id FROM bi QUALIFY row_number() OVER (ORDER BY b, user_id) <= greatest(floor((SELECT count(*) FROM bi) * 0.2::DOUBLE), 50)) "
    + _P5.format(k=7.5, jury="nj"),
)
_add(
    "hygienic_top_list",
    lambda s, d: (lambda m: _r(juries.top_list(m.work_stats.select("work_id", F.round("mean", 6).alias("score"), F.col("n").cast("double").alias("n_eff")), m.works.select("work_id", (F.col("work_id") % 7 == 0).alias("is_comic"), F.when(F.col("work_id") % 11 == 0, True).alias("is_duplicate")), 500), "score"))(Model(s, d)),
    f"WITH {DERIVED} SELECT row_number() OVER (ORDER BY round(mean, 6) DESC, n DESC, work_id)::INTEGER AS rank, work_id, round(mean, 6) AS score, n::DOUBLE AS n_eff FROM ws WHERE work_id % 7 <> 0 AND work_id % 11 <> 0 QUALIFY rank <= 500",
)
_GROUPS = {"focus": "lit_share >= 0.8", "anti": "lit_share < 0.7"}
_add(
    "bilateral_esteem",
    lambda s, d: (lambda m: _r(juries.bilateral_esteem(*[pairwise.esteem(pairwise.balanced_votes(m.events.join(m.taste.filter(c).select("user_id"), "user_id", "left_semi"), high=5, low=3)) for c in _GROUPS.values()]), "score"))(Model(s, d)),
    f"WITH {DERIVED}" + "".join(
        f""", s{g} AS (SELECT user_id, work_id, CASE WHEN rating = 5 THEN 1 ELSE -1 END AS side FROM ev WHERE (rating = 5 OR rating <= 3) AND user_id IN (SELECT user_id FROM tst WHERE {c})), h{g} AS (SELECT user_id, count(*) FILTER (WHERE side = 1) AS h, count(*) FILTER (WHERE side = -1) AS l FROM s{g} GROUP BY 1),
b{g} AS (SELECT user_id, work_id, side FROM (SELECT *, row_number() OVER (PARTITION BY user_id, side ORDER BY md5(user_id::VARCHAR || '-' || work_id::VARCHAR || '-votes'), work_id) AS r FROM s{g} JOIN h{g} USING (user_id)) WHERE r <= least(12, h, l)), p{g} AS (SELECT a.work_id AS w, b.work_id AS l FROM b{g} a JOIN b{g} b ON a.user_id = b.user_id AND a.side = 1 AND b.side = -1),
t{g} AS (SELECT work_id, sum(x) AS wins, count(*) AS n FROM (SELECT w AS work_id, 1 AS x FROM p{g} UNION ALL SELECT l, 0 FROM p{g}) GROUP BY 1 HAVING count(*) >= 10)"""
        for g, c in _GROUPS.items()
    ) + " SELECT work_id, round(f.wins / (f.n + 20.0::DOUBLE) - a.wins / (a.n + 20.0::DOUBLE), 9) AS score, least(f.n, a.n)::DOUBLE AS n_eff FROM tfocus f JOIN tanti a USING (work_id)",
)


# Cohorts: stored scores are those of the deep curators.
def _stored(m):
    return m.cohort("deep").select("user_id", "weight", "weight_pctile", "deep_share", "com_share")


_ST = f"{COHORTS}, st AS (SELECT user_id, round(weight, 6) AS weight, round(weight_pctile, 6) AS weight_pctile, round(deep_share, 6) AS deep_share, round(com_share, 6) AS com_share FROM deep)"


def _weight_sql(deweight):
    t = deweight / 100
    return f"power(greatest(weight, 1e-9), {4.0 * t}::DOUBLE) * exp(-{8.0 * t}::DOUBLE * (1 - pctile))" if deweight else "1.0::DOUBLE"


def _cohort_sql(purity, deweight):
    gates = f"share >= {0.8 * purity / 100}::DOUBLE AND com <= {1 - 0.92 * purity / 100}::DOUBLE" if purity else "TRUE"
    return f"WITH {_ST}, u AS (SELECT p.user_id, coalesce(weight, 1e-8) AS weight, coalesce(weight_pctile, 0) AS pctile, coalesce(deep_share, 0) AS share, coalesce(com_share, 0) AS com FROM pct p LEFT JOIN st USING (user_id)) SELECT user_id, round({_weight_sql(deweight)}, 4) AS w FROM u WHERE {gates}"


for _name, _purity, _deweight in (("cohort_open", 0, 0), ("cohort_steep", 0, 40), ("cohort_pure", 30, 0), ("cohort_stored", 90, 20)):
    _add(
        _name,
        lambda s, d, p=_purity, w=_deweight: (lambda m: cohort.members(m.percentiles, _r6(_stored(m)), p, w).withColumn("w", F.round("w", 4)))(Model(s, d)),
        _cohort_sql(_purity, _deweight),
    )


def _r6(df):
    return df.select("user_id", *[F.round(c, 6).alias(c) for c in df.columns if c != "user_id"])


_POS, _NEG, _TITLES = [0, 1, 10, 11, 21], [9, 19, 29], ["red ring 5", "small plate 12", "big gizmo 30"]
_add(
    "pack_features",
    lambda s, d: (lambda m: _r(cohort.pack_features(m.likes, m.events, m.works.filter("work_id % 50 = 3"), _POS, _NEG), "deep_share", "com_share"))(Model(s, d)),
    f"WITH {DERIVED}, l AS (SELECT user_id, coalesce(sum(n_liked) FILTER (WHERE author_id IN {tuple(_POS)}), 0) AS nd, coalesce(sum(n_five) FILTER (WHERE author_id IN {tuple(_POS)}), 0) AS po, coalesce(sum(n_five) FILTER (WHERE author_id IN {tuple(_NEG)}), 0) AS ne FROM likes GROUP BY user_id), h AS (SELECT user_id, count(DISTINCT work_id) AS nn FROM ev WHERE rating >= 4 AND work_id % 50 = 3 GROUP BY user_id), f AS (SELECT user_id, coalesce(nd, 0) AS nd, coalesce(po, 0) AS po, coalesce(ne, 0) AS ne, coalesce(nn, 0) AS nn FROM l FULL JOIN h USING (user_id)) SELECT user_id, nd::BIGINT AS n_deep, round(coalesce(nd / nullif(nd + nn, 0)::DOUBLE, 0), 9) AS deep_share, round(coalesce(ne / nullif(po + ne, 0)::DOUBLE, 0), 9) AS com_share FROM f WHERE nd > 0 OR ne > 0 OR nn > 0 OR po > 0",
)


def _live(s, d):
    m = Model(s, d)
    f = cohort.pack_features(m.likes, m.events, m.works.filter("work_id % 50 = 3"), _POS, _NEG)
    return cohort.live_members(m.percentiles, _r6(_stored(m)), _r(f, "deep_share", "com_share"), 40, 25).withColumn("w", F.round("w", 4))


_FEAT = SQL["pack_features"].removeprefix(f"WITH {DERIVED}, ")
_add(
    "cohort_of_pack",
    _live,
    f"WITH {_ST}, pf AS (WITH {_FEAT}), u AS (SELECT p.user_id, coalesce(st.weight, ln(1 + coalesce(n_deep, 0)::DOUBLE) * power(CASE WHEN coalesce(pf.deep_share, 0) > 0 THEN greatest(pf.deep_share, 0.05) ELSE 0.05 END::DOUBLE, 1.8::DOUBLE) * power(greatest(1 - coalesce(pf.com_share, 0), 0.02), 3.0::DOUBLE)) AS weight, coalesce(weight_pctile, 0) AS pctile, coalesce(pf.deep_share, 0) AS share, coalesce(pf.com_share, 0) AS com FROM pct p LEFT JOIN st USING (user_id) LEFT JOIN pf USING (user_id)) SELECT user_id, round({_weight_sql(25)}, 4) AS w FROM u WHERE share >= 0.32::DOUBLE AND com <= 0.632::DOUBLE",
)


def _bracketed(s, d):
    return Tables(s, d).works.select("work_id", F.when(F.col("work_id") % 3 == 0, F.concat("title", F.lit(" (Saga (Old), #1)"))).otherwise(F.col("title")).alias("title"), "author_id")


_BRACKETED = "bw AS (SELECT work_id, author_id, CASE WHEN work_id % 3 = 0 THEN title || ' (Saga (Old), #1)' ELSE title END AS title FROM works)"
_add("neutral_works", lambda s, d: cohort.neutral_works(_bracketed(s, d), ["Hot Plate 20", "red gizmo 0", "small ring"]), f"WITH {CTE}, {_BRACKETED} SELECT DISTINCT work_id FROM bw, (SELECT unnest(['hot plate 20', 'red gizmo 0', 'small ring']) AS t) WHERE lower(title) = t OR starts_with(lower(title), t || ' (')")
_add(
    "normie_works",
    lambda s, d: signals.normie_works(s.createDataFrame([(t,) for t in ("Hot Plate 20", "red gizmo 0", "small", "nothing")], "title string"), _bracketed(s, d).join(Model(s, d).work_stats.select("work_id", "n"), "work_id")),
    f"WITH {DERIVED}, {_BRACKETED}, b AS (SELECT bw.*, n FROM bw JOIN (SELECT work_id, n FROM ws) USING (work_id)), t AS (SELECT unnest(['hot plate 20', 'red gizmo 0', 'small', 'nothing']) AS t), h AS (SELECT t, work_id, title, row_number() OVER (PARTITION BY t ORDER BY n DESC, work_id) AS r FROM b, t WHERE lower(title) = t OR starts_with(lower(title), t || ' (')), l AS (SELECT t, work_id, title, row_number() OVER (PARTITION BY t ORDER BY n DESC, work_id) AS r FROM b, t WHERE starts_with(lower(title), t) AND t NOT IN (SELECT t FROM h)) SELECT DISTINCT work_id, title FROM h WHERE r <= 2 UNION SELECT work_id, title FROM l WHERE r = 1",
)


# A poll whose entries are works of the catalogue, and authors with names made of their ids.
def _authors(s, d):
    a = Tables(s, d).works.groupBy("author_id").agg(F.count(F.lit(1)).alias("ratings_count"))
    return a.select("author_id", F.concat(F.lit("Öla "), F.chr(F.col("author_id") % 26 + 65), F.lit("ab "), F.chr((F.col("author_id") / 26).cast("int") + 65), F.lit("ov")).alias("name"), "ratings_count")


_AUTHORS = "au AS (SELECT author_id, 'ola ' || chr((author_id % 26 + 97)::INTEGER) || 'ab ' || chr((author_id // 26 + 97)::INTEGER) || 'ov' AS key, 'Öla ' || chr((author_id % 26 + 65)::INTEGER) || 'ab ' || chr((author_id // 26 + 65)::INTEGER) || 'ov' AS name FROM (SELECT DISTINCT author_id FROM works))"


def _chart(s, d):
    w = Tables(s, d).works.filter("work_id % 40 = 7").join(_authors(s, d), "author_id")
    return w.select((F.floor(F.col("work_id") / 40) + 1).cast("int").alias("rank"), "title", F.upper("name").alias("author"))


_add(
    "poll_prestige",
    lambda s, d: _r(signals.poll_prestige(_chart(s, d), _authors(s, d).select(F.col("name").alias("match"))), "prestige"),
    f"WITH {CTE}, {_AUTHORS}, c AS (SELECT work_id // 40 + 1 AS rank, author_id FROM works WHERE work_id % 40 = 7), b AS (SELECT name AS match, min(rank) AS r FROM au LEFT JOIN c USING (author_id) GROUP BY name) SELECT match, r::INTEGER AS poll_rank, round(coalesce(1 - 0.5::DOUBLE * (r - 1) / greatest((SELECT count(*) FROM c) - 1, 1), 0.75), 9) AS prestige FROM b",
)
_add(
    "resolve_authors",
    lambda s, d: signals.resolve_authors(_authors(s, d).select(F.when(F.col("author_id") % 3 == 0, F.concat(F.upper("name"), F.lit(", Jr."))).when(F.col("author_id") % 3 == 1, F.concat("name", F.lit(" Elder"))).otherwise(F.substring("name", 1, 7)).alias("match")).filter("length(match) > 3"), _authors(s, d)).select("match", "author_id"),
    f"WITH {CTE}, {_AUTHORS}, m AS (SELECT DISTINCT CASE WHEN author_id % 3 = 0 THEN upper(name) || ', Jr.' WHEN author_id % 3 = 1 THEN name || ' Elder' ELSE substr(name, 1, 7) END AS match, CASE WHEN author_id % 3 = 2 THEN 2 ELSE author_id % 3 END AS kind FROM au), j AS (SELECT match, au.author_id, count(*) OVER (PARTITION BY match) AS k FROM m JOIN au ON (kind = 0 AND upper(name) || ', Jr.' = match) OR (kind = 1 AND name || ' Elder' = match) OR (kind = 2 AND starts_with(name, match || ' '))) SELECT match, author_id FROM j WHERE k = 1",
)
_SIDES = {"literary_poll": "author_id % 4 < 2", "literary_sf": "author_id % 6 = 0", "non_literary": "author_id % 5 = 0"}


def _signals(s, d):
    a = _authors(s, d)
    out = None
    for side, which in _SIDES.items():
        one = a.filter(which).select(F.lit(side).alias("side"), F.col("author_id").alias("place"), F.col("name").alias("match"))
        out = one if out is None else out.unionByName(one)
    return out


_add("signal_lists", lambda s, d: signals.resolve_lists(_signals(s, d), _authors(s, d)), f"WITH {CTE}, {_AUTHORS} SELECT CASE WHEN author_id % 5 = 0 THEN 'non_literary' WHEN author_id % 4 < 2 THEN 'literary_poll' ELSE 'literary_sf' END AS side, name AS match, author_id FROM au WHERE author_id % 5 = 0 OR author_id % 4 < 2 OR author_id % 6 = 0")
_add(
    "poll_works",
    lambda s, d: signals.match_poll_works(_chart(s, d), Tables(s, d).works.join(_authors(s, d), "author_id").join(Model(s, d).work_stats.select("work_id", "n"), "work_id").select("work_id", "title", F.col("name").alias("author"), "n"), 20),
    f"""WITH {DERIVED}, c AS (SELECT (work_id // 40 + 1)::INTEGER AS rank, author_id, title AS pt FROM works WHERE work_id % 40 = 7), w AS (SELECT work_id, author_id, title AS wt, n FROM works JOIN (SELECT work_id, n FROM ws) USING (work_id) WHERE n >= 20),
j AS (SELECT rank, work_id, n, row_number() OVER (PARTITION BY rank ORDER BY n DESC, work_id) AS r FROM c JOIN w USING (author_id) WHERE wt = pt OR starts_with(wt, pt || ' ') OR starts_with(pt, wt || ' ') OR (length(pt) >= 8 AND contains(wt, pt)) OR (length(wt) >= 8 AND contains(pt, wt))) SELECT work_id, n, min(rank)::INTEGER AS poll_rank FROM j WHERE r = 1 GROUP BY ALL""",
)
_add(
    "resolve_ids",
    lambda s, d: signals.resolve_ids(s.range(0, 3000, 3).select(F.col("id").alias("key")), Tables(s, d).works.select("work_id", (F.col("work_id") + 500).alias("book_id"))),
    f"WITH {CTE} SELECT k::VARCHAR AS key, coalesce(b.work_id, w.work_id)::VARCHAR AS work_id, (coalesce(b.work_id, w.work_id) + 500)::VARCHAR AS book_id FROM range(0, 3000, 3) t(k) LEFT JOIN works b ON b.work_id + 500 = k LEFT JOIN works w ON w.work_id = k WHERE coalesce(b.work_id, w.work_id) IS NOT NULL",
)
_BOOKS = {"sf_core": "work_id % 130", "sf_ratio": "(work_id % 97) / 100.0", "ya": "CASE WHEN work_id % 4 <> 0 THEN work_id % 160 END", "fantasy": "work_id % 3", "ratings_count": "work_id % 400"}
_add(
    "sf_books",
    lambda s, d: genres.sf_books(Tables(s, d).works.select("work_id", F.when(F.col("work_id") % 9 == 0, F.concat(F.lit("A Game of Thrones "), "title")).otherwise(F.col("title")).alias("title"), *[F.expr(x).alias(c) for c, x in _BOOKS.items()])).select("work_id"),
    f"WITH {CTE}, b AS (SELECT work_id, {', '.join(f'{x} AS {c}' for c, x in _BOOKS.items())} FROM works WHERE work_id % 9 <> 0) SELECT work_id FROM b WHERE sf_core >= 10 AND ratings_count >= 50 AND (sf_ratio >= 0.55 OR (sf_core >= 100 AND sf_ratio >= 0.27 AND coalesce(ya, 0) < sf_core) OR (sf_core >= 25 AND sf_ratio >= 0.32 AND coalesce(ya, 0) < 50 AND fantasy > 0))",
)
_add("parity_split", lambda s, d: evaluation.parity_split(evaluation.ranked(Model(s, d).work_stats.select("work_id", F.round("mean", 6).alias("mean")), "mean")), f"WITH {DERIVED}, r AS (SELECT work_id, row_number() OVER (ORDER BY round(mean, 6) DESC, work_id)::INTEGER AS rank FROM ws) SELECT work_id, rank, CASE WHEN rank % 2 = 1 THEN 'seed' ELSE 'held_out' END AS part FROM r")
_add("author_split", lambda s, d: evaluation.author_split(Tables(s, d).works).select("work_id", "part"), f"WITH {CTE} SELECT work_id, (list_sum(list_transform(string_split(author_id::VARCHAR, ''), lambda c: ascii(c))) % 2)::INTEGER AS part FROM works")
_add("dense_index", lambda s, d: evaluation.dense_index(Model(s, d).events, "work_id"), f"WITH {DERIVED} SELECT work_id, row_number() OVER (ORDER BY work_id) - 1 AS index FROM (SELECT DISTINCT work_id FROM ev)")
_add(
    "utopia_distance",
    lambda s, d: (lambda p: _r(evaluation.utopia_distance(saved(evaluation.pareto_front(p, "n", "mean"), "front"), "n", "mean"), "distance"))(Model(s, d).work_stats.select("work_id", "n", F.round("mean", 6).alias("mean"))),
    f"WITH {DERIVED}, p AS (SELECT work_id, n, round(mean, 6) AS mean FROM ws), f AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.n >= a.n AND b.mean >= a.mean AND (b.n > a.n OR b.mean > a.mean))) SELECT work_id, n, mean, round(sqrt(power(coalesce(((SELECT max(n) FROM f) - n) / nullif(((SELECT max(n) - min(n) FROM f))::DOUBLE, 0), 0), 2) + power(coalesce(((SELECT max(mean) FROM f) - mean) / nullif((SELECT max(mean) - min(mean) FROM f), 0), 0), 2)), 9) AS distance FROM f",
)
_add(
    "rating_statistics",
    lambda s, d: (lambda e: _r(e.groupBy("is_sf").agg(F.corr("rating", "five_rate").alias("corr"), F.any_value(F.col("is_sf").cast("int")).alias("flag"), F.percentile_approx("rating", 0.5, 10_000).alias("middle"), F.stddev_samp("rating").alias("sd")), "corr", "sd"))(Model(s, d).events),
    f"WITH {DERIVED} SELECT is_sf, round(corr(rating, five_rate), 9) AS corr, any_value(is_sf::INTEGER) AS flag, quantile_disc(rating, 0.5)::INTEGER AS middle, round(stddev_samp(rating), 9) AS sd FROM ev GROUP BY is_sf",
)
_add(
    "any_signal_works",
    lambda s, d: (lambda w: w.filter("author_id % 10 = 9").select("work_id").union(w.filter("pub_year < 1920").select("work_id")).distinct())(Tables(s, d).works),
    f"WITH {CTE} SELECT work_id FROM works WHERE author_id % 10 = 9 UNION SELECT work_id FROM works WHERE pub_year < 1920",
)
