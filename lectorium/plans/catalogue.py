"""Queries and SQL of similarity, genres, gates, flags and years."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectorium.functions.numeric import six
from lectorium.operators import catalog, genres, similarity, taste
from lectorium.plans.adapter import CTE, Tables
from lectorium.plans.ratings import COHORTS, DERIVED, Model

QUERIES, SQL = {}, {}


def _add(name, query, sql):
    QUERIES[name], SQL[name] = query, sql


_SIM = {
    "cosine": "shared / sqrt(wa * wb)", "jaccard": "shared / (wa + wb - shared)", "lift": "shared * nc / (na::DOUBLE * nb)", "pmi": "ln(greatest(shared * nc / (wa * wb), 1e-12))",
    "conditional": "shared / wa", "association": "shared / wa * ln(nc / wb)",
}
for _s, _e in _SIM.items():
    _add(
        f"similar_{_s}",
        lambda s, d, k=_s: (lambda m: similarity.similar_works(m.events, m.cohort("pct").select("user_id", taste.deweight(30).alias("w")), m.work_stats, 7, k))(Model(s, d)),
        f"""WITH {COHORTS}, co AS (SELECT user_id, power(weight, 1.2::DOUBLE) * exp(-2.4::DOUBLE * (1 - weight_pctile)) AS w FROM pctc), f AS (SELECT work_id, user_id, w FROM ev JOIN co USING (user_id) WHERE rating = 5),
b AS (SELECT work_id, sum(w) AS shared, count(*) AS heads FROM f WHERE user_id IN (SELECT user_id FROM f WHERE work_id = 7) AND work_id <> 7 GROUP BY work_id), m AS (SELECT work_id, sum(w) AS wb FROM f GROUP BY work_id)
SELECT b.work_id, round(shared, 6) AS shared, round({_e}, 6) AS score FROM b JOIN m ON m.work_id = b.work_id JOIN (SELECT work_id, n AS nb FROM ws) n ON n.work_id = b.work_id,
  (SELECT sum(w) AS wa FROM f WHERE work_id = 7), (SELECT count(*)::DOUBLE AS nc FROM co), (SELECT max(n) AS na FROM ws WHERE work_id = 7) WHERE heads >= 2 ORDER BY score DESC, shared DESC, b.work_id LIMIT 100""",
    )
_add(
    "work_supporters",
    lambda s, d: (lambda m: similarity.supporters(m.events, m.taste.select("user_id", F.round("lit_weight", 6).alias("w")), 7))(Model(s, d)),
    f"WITH {DERIVED} SELECT e.user_id, e.rating, round(t.lit_weight, 6) AS w FROM ev e JOIN tst t ON t.user_id = e.user_id WHERE work_id = 7 AND rating >= 4 ORDER BY w DESC, rating DESC, e.user_id LIMIT 50",
)
_add(
    "better_edition",
    lambda s, d: (lambda m: similarity.better_edition(m.works, m.work_stats, 7, times=1.0))(Model(s, d)),
    f"WITH {DERIVED}, t AS (SELECT * FROM works JOIN ws USING (work_id)) SELECT b.work_id, b.n FROM t a JOIN t b ON a.title = b.title AND b.work_id <> a.work_id WHERE a.work_id = 7 AND b.n >= greatest(a.n, 20) ORDER BY b.n DESC, b.work_id LIMIT 1",
)
_CAT = "cat AS (SELECT shelf, count(DISTINCT work_id) AS n_works, sum(count)::BIGINT AS total_count FROM shelves WHERE shelf NOT IN ('large') GROUP BY shelf HAVING count(DISTINCT work_id) >= 75 AND sum(count) >= 1300)"
_TAGS = "tags AS (SELECT work_id, shelf, sum(count)::BIGINT AS count FROM shelves WHERE shelf IN (SELECT shelf FROM cat) GROUP BY ALL HAVING sum(count) >= 5)"


def _catalog(s, d):
    return genres.genre_catalog(Tables(s, d).shelves, 75, 1300, ["large"])


def _tags(s, d):
    return genres.work_genres(Tables(s, d).shelves, _catalog(s, d))


_add("genre_catalog", _catalog, f"WITH {CTE}, {_CAT} SELECT * FROM cat")
_add("work_genres", _tags, f"WITH {CTE}, {_CAT}, {_TAGS} SELECT * FROM tags")
_add(
    "tag_filter",
    lambda s, d: genres.by_tags(Tables(s, d).works, _tags(s, d), ["small"], ["brand#1", "brand#12", "brand#16", "brand#17"], ["brand#1"]).select("work_id"),
    f"WITH {CTE}, {_CAT}, {_TAGS} SELECT work_id FROM works w WHERE EXISTS (SELECT 1 FROM tags t WHERE t.work_id = w.work_id AND shelf = 'small') AND EXISTS (SELECT 1 FROM tags t WHERE t.work_id = w.work_id AND shelf IN ('brand#1', 'brand#12', 'brand#16', 'brand#17')) AND NOT EXISTS (SELECT 1 FROM tags t WHERE t.work_id = w.work_id AND shelf = 'brand#1')",
)


def _shelf_forms():
    return F.array(F.col("shelf"), F.concat(F.lit("read-in-"), "shelf"), F.lit(" To-Read"), F.concat((F.col("work_id") % 30 + 1990).cast("string"), F.lit("-reads")), F.concat(F.lit("own"), "shelf"), F.lit("  "))


_add(
    "noise_shelves",
    lambda s, d: Tables(s, d).shelves.select(F.explode(_shelf_forms()).alias("shelf")).distinct().withColumn("noise", genres.is_noise(F.col("shelf"))),
    f"WITH {CTE}, f AS (SELECT DISTINCT unnest([shelf, 'read-in-' || shelf, ' To-Read', (work_id % 30 + 1990)::VARCHAR || '-reads', 'own' || shelf, '  ']) AS shelf FROM shelves) SELECT shelf, trim(shelf) = '' OR lower(trim(shelf)) = 'to-read' OR starts_with(shelf, 'read-in-') OR regexp_full_match(shelf, '[0-9]{{4}}-reads') AS noise FROM f",
)
RATIO = genres.RatioGate("small", core=("small",), soft=("brand#1", "brand#2", "brand#3", "brand#4"), compete=("brand#12", "brand#5", "brand#6"), compete_soft=("brand#7", "brand#8"), literary=("brand#9", "brand#10"), literary_min_n=28, ya=("brand#11",), min_core=8, min_ratio=0.7, escape_core=20, escape_ratio=0.5, soft_escape_core=12, soft_escape_ratio=0.6, ya_below_core=True, soft_max_ya=10)
THEME = genres.ThemeGate("theme", core=("economy", "brand#1", "brand#2"), fiction=("economy", "brand#1", "brand#2", "brand#3", "brand#4", "promo"), min_core=20, min_ratio=0.5, obscure_n=28, obscure_core=10, obscure_ratio=0.3)


def _sum(*shelves):
    return "coalesce(sum(count) FILTER (WHERE shelf IN (" + ", ".join(f"'{x}'" for x in shelves) + ")), 0)::DOUBLE"


_RATIO_SQL = f"""rg AS (
  SELECT work_id, n, core, score, score / nullif(score + comp + 0.25::DOUBLE * comps + CASE WHEN n >= 28 THEN 0.5::DOUBLE * lit ELSE 0 END, 0) AS ratio, ya FROM (
    SELECT *, core + 0.35::DOUBLE * soft AS score FROM (
      SELECT work_id, {_sum("small")} AS core, {_sum("brand#1", "brand#2", "brand#3", "brand#4")} AS soft, {_sum("brand#12", "brand#5", "brand#6")} AS comp, {_sum("brand#7", "brand#8")} AS comps, {_sum("brand#9", "brand#10")} AS lit, {_sum("brand#11")} AS ya FROM shelves GROUP BY work_id
    ) JOIN (SELECT work_id, n FROM ws) USING (work_id))
), rgp AS (
  SELECT *, core >= 8 AND coalesce(ratio >= 0.7 OR (core >= 20 AND ratio >= 0.5 AND ya < core) OR (core >= 12 AND ratio >= 0.6 AND ya < 10), false) AS passed FROM rg
)"""
_add("ratio_gate", lambda s, d: genres.ratio_gate(Tables(s, d).shelves, Model(s, d).work_stats, RATIO).select("work_id", "gate", "passed", six(F.col("score")).alias("score"), six(F.col("ratio")).alias("ratio")), f"WITH {DERIVED}, {_RATIO_SQL} SELECT work_id, 'small' AS gate, passed, round(score, 6) AS score, round(ratio, 6) AS ratio FROM rgp")
_THEME_SQL = f"tg AS (SELECT work_id, n, {_sum('economy', 'brand#1', 'brand#2')} AS core, {_sum('economy', 'brand#1', 'brand#2', 'brand#3', 'brand#4', 'promo')} AS fic FROM shelves JOIN (SELECT work_id, n FROM ws) USING (work_id) GROUP BY ALL)"
_TP = "coalesce(core >= CASE WHEN n < 28 THEN 10 ELSE 20 END AND core / nullif(fic, 0) >= CASE WHEN n < 28 THEN 0.3 ELSE 0.5 END, false)"
_add("theme_gate", lambda s, d: genres.theme_gate(Tables(s, d).shelves, Model(s, d).work_stats, THEME).select("work_id", "gate", "passed", "score", six(F.col("ratio")).alias("ratio")), f"WITH {DERIVED}, {_THEME_SQL} SELECT work_id, 'theme' AS gate, {_TP} AS passed, core AS score, round(core / nullif(fic, 0), 6) AS ratio FROM tg")
_add(
    "gate_intersection",
    lambda s, d: (lambda m, sh: genres.through_gates(m.works, genres.ratio_gate(sh, m.work_stats, RATIO).unionByName(genres.theme_gate(sh, m.work_stats, THEME)), ["small", "theme"]).select("work_id"))(Model(s, d), Tables(s, d).shelves),
    f"WITH {DERIVED}, {_RATIO_SQL}, {_THEME_SQL} SELECT work_id FROM rgp WHERE passed INTERSECT SELECT work_id FROM tg WHERE {_TP}",
)


def _series_works(s, d):
    w = Tables(s, d).works
    return w.withColumn("title", F.concat("title", F.lit(" (Saga "), (F.col("work_id") % 3).cast("string"), F.lit(", #"), (F.floor(F.col("work_id") / 300) + 1).cast("string"), F.lit(")")))


_add(
    "series_inheritance",
    lambda s, d: (lambda m: genres.inherit_series(genres.ratio_gate(m.base.shelves, m.work_stats, RATIO), _series_works(s, d), 1, least_n=20, least_volumes=1).select("work_id", "passed"))(Model(s, d)),
    f"""WITH {DERIVED}, {_RATIO_SQL}, sw AS (SELECT work_id, author_id, 'Saga ' || (work_id % 3)::VARCHAR AS series, work_id // 300 + 1 AS volume FROM works), x AS (SELECT * FROM rgp JOIN sw USING (work_id)),
l AS (SELECT author_id, series, count(*) AS volumes FROM x WHERE passed AND volume >= 2 GROUP BY ALL)
SELECT work_id, passed OR (volume < 2 AND coalesce(volumes, 0) >= 1 AND core >= 1 AND n >= 20) AS passed FROM x LEFT JOIN l USING (author_id, series)""",
)
_add(
    "genre_scores",
    lambda s, d: (lambda m: genres.genre_scores(m.base.shelves, ("small",), ("brand#1", "brand#2"), ("brand#5", "brand#6", "medium"), ("brand#9",), m.work_stats, 28))(Model(s, d)).select("work_id", six(F.col("score")).alias("score"), six(F.col("other")).alias("other"), six(F.col("ratio")).alias("ratio")),
    f"""WITH {DERIVED}, g AS (SELECT work_id, {_sum("small")} + 0.35::DOUBLE * {_sum("brand#1", "brand#2")} AS score, {_sum("brand#5", "brand#6", "medium")} AS ag, {_sum("brand#9")} AS lit FROM shelves GROUP BY work_id), h AS (SELECT work_id, score, ag + CASE WHEN n >= 28 THEN 0.5::DOUBLE * lit ELSE 0 END AS other FROM g JOIN (SELECT work_id, n FROM ws) USING (work_id))
SELECT work_id, round(score, 6) AS score, round(other, 6) AS other, round(score / nullif(score + other, 0), 6) AS ratio FROM h""",
)
_add(
    "title_search",
    lambda s, d: genres.search(Tables(s, d).works, "Ring 1"),
    f"WITH {CTE}, p AS (SELECT work_id, title, CASE WHEN work_id::VARCHAR = 'ring 1' THEN 0 WHEN lower(title) = 'ring 1' THEN 1 WHEN starts_with(lower(title), 'ring 1') THEN 2 WHEN contains(lower(title), 'ring 1') THEN 3 END AS place FROM works) SELECT work_id, title, place FROM p WHERE place IS NOT NULL ORDER BY place, title, work_id LIMIT 20",
)


#: What stands behind every so many titles, so that each rule has cases.
_SUFFIXES = {7: " Box Set", 11: " #1-3", 13: ": The Screenplay", 17: " (Manga)", 19: " Trilogy, #2", 23: " and Other Stories", 29: ": A Companion to the Saga (Saga, #2)", 31: " Volumes 1-4", 37: " #2", 41: " (3)"}


def _suffixed(s, d):
    w = Tables(s, d).works
    t = F.col("title")
    for k, suffix in reversed(_SUFFIXES.items()):
        t = F.when(F.col("work_id") % k == 0, F.concat("title", F.lit(suffix))).otherwise(t)
    return w.withColumn("title", t).withColumn("language_code", F.when(F.col("work_id") % 2 == 0, "eng").otherwise("GER"))


def _flagged(s, d):
    return catalog.title_flags(_suffixed(s, d))


def _matches(pattern):
    return f"regexp_matches(title, '{pattern.replace(chr(39), chr(39) * 2)}')"


_TITLED = "tt AS (SELECT work_id, author_id, pub_year, CASE " + " ".join(f"WHEN work_id % {k} = 0 THEN title || '{x}'" for k, x in _SUFFIXES.items()) + " ELSE title END AS title, CASE WHEN work_id % 2 = 0 THEN 'en' ELSE 'ge' END AS lang FROM works)"
_FLAGS = f"{_TITLED}, ft AS (SELECT *, {_matches(catalog.COLLECTION)} AS is_collection, {_matches(catalog.DERIVATIVE)} AND (NOT {_matches(catalog.SINGLE_VOLUME)} OR {_matches(catalog.SURE_DERIVATIVE)}) AS is_derivative, {_matches(catalog.COMIC)} AS is_comic FROM tt)"
_add("title_flags", lambda s, d: _flagged(s, d).select("work_id", "is_collection", "is_derivative", "is_comic"), f"WITH {CTE}, {_FLAGS} SELECT work_id, is_collection, is_derivative, is_comic FROM ft")
_GROUPS = {"fiction": ("small", "brand#1"), "nonfiction": ("brand#2", "promo"), "short": ("brand#3", "medium"), "bundle": ("brand#4", "brand#5"), "comic": ("brand#6", "economy"), "picture": ("standard",)}
_add("shelf_counts", lambda s, d: catalog.shelf_counts(Tables(s, d).shelves, _GROUPS), f"WITH {CTE} SELECT work_id, " + ", ".join(f"coalesce(sum(count) FILTER (WHERE shelf IN {g if len(g) > 1 else '(' + repr(g[0]) + ')'}), 0)::BIGINT AS {n}_n" for n, g in (_GROUPS | {"collection": _GROUPS["short"] + _GROUPS["bundle"]}).items()) + " FROM shelves WHERE shelf IN ('" + "', '".join(x for g in _GROUPS.values() for x in g) + "') GROUP BY work_id")


def _shelf_flags(s, d):
    c = catalog.shelf_counts(Tables(s, d).shelves, _GROUPS)
    c = c.select("work_id", *[(F.col(x) * 4).alias(x) for x in c.columns if x != "work_id"])
    pages = Tables(s, d).works.filter("work_id % 5 <> 0").select("work_id", (F.col("work_id") % 300).cast("int").alias("num_pages"))
    return catalog.shelf_flags(_suffixed(s, d), c, pages).select("work_id", "is_collection", "is_comic", "is_nonfiction", "is_picture_book")


_SUM4 = lambda *names: "4 * coalesce(sum(count) FILTER (WHERE shelf IN ('" + "', '".join(names) + "')), 0)"
_add(
    "shelf_flags",
    _shelf_flags,
    f"""WITH {CTE}, {_FLAGS}, g AS (SELECT work_id, {_SUM4("small", "brand#1")} AS f, {_SUM4("brand#2", "promo")} AS nf, {_SUM4("brand#3", "medium", "brand#4", "brand#5")} AS c, {_SUM4("brand#4", "brand#5")} AS b, {_SUM4("brand#6", "economy")} AS co, {_SUM4("standard")} AS pi FROM shelves GROUP BY work_id),
x AS (SELECT ft.*, f, nf, c, b, co, pi, CASE WHEN work_id % 5 <> 0 THEN work_id % 300 END AS pages, {_matches(catalog.SINGLE_VOLUME)} AND NOT regexp_matches(title, '#\\s*[0-9]+\\s*-\\s*[0-9]+') AS one, {_matches(catalog.COLLECTION_CUE)} OR is_collection AS cue FROM ft JOIN g USING (work_id))
SELECT work_id, is_collection OR (c >= 40 AND c >= 0.5 * greatest(f, 1) AND NOT one AND ((b >= 30 AND b >= 0.12 * greatest(f, 1)) OR cue OR ((b >= 30 OR coalesce(pages, 0) >= 140) AND c >= 120 AND c >= 0.9 * greatest(f, 1)))) AS is_collection,
  is_comic OR (co >= 10 AND co > 1.15 * f) AS is_comic, nf >= 10 AND nf > 1.15 * f AS is_nonfiction, pi >= 40 AND (pi >= 0.25 * greatest(f, 1) OR coalesce(pages <= 64, FALSE)) AS is_picture_book FROM x""",
)
_add(
    "flag_overrides",
    lambda s, d: (lambda r: catalog.override(_flagged(s, d), r.filter("id % 5 = 0").select(F.col("id").alias("work_id"), F.lit("is_comic").alias("flag")), r.filter("id % 14 = 0").select(F.col("id").alias("work_id"), F.lit("is_collection").alias("flag"))))(s.range(100)).select("work_id", "is_collection", "is_derivative", "is_comic", "format_weight"),
    f"""WITH {CTE}, {_FLAGS}, o AS (SELECT work_id, is_collection AND NOT (work_id < 100 AND work_id % 14 = 0) AS is_collection, is_derivative, is_comic OR (work_id < 100 AND work_id % 5 = 0) AS is_comic FROM ft)
SELECT *, least(1.0::DOUBLE, CASE WHEN is_collection THEN 0.18 ELSE 1 END, CASE WHEN is_derivative THEN 0.12 ELSE 1 END, CASE WHEN is_comic THEN 0.18 ELSE 1 END, CASE WHEN is_collection AND is_derivative THEN 0.08 ELSE 1 END)::DOUBLE AS format_weight FROM o""",
)


def _twins(s, d):
    return _flagged(s, d).withColumn("author_id", F.col("author_id") % 5).withColumn("title", F.concat(F.lit("The "), F.regexp_replace("title", " \\d+", "")))


_add(
    "duplicate_clusters",
    lambda s, d: catalog.duplicate_clusters(_twins(s, d), Model(s, d).work_stats),
    f"""WITH {DERIVED}, {_FLAGS}, t AS (SELECT work_id, n, author_id % 5 AS a, lang, is_collection, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower('The ' || regexp_replace(title, ' [0-9]+', '')), '\\s*#\\s*\\d+\\s*$', ''), '\\s*\\(\\s*\\d+\\s*\\)\\s*$', ''), '[^a-z0-9_]+', ' ', 'g')), '^(the|a|an) ', '') AS norm FROM ft JOIN (SELECT work_id, n FROM ws) USING (work_id)),
c AS (SELECT *, bool_and(is_collection) OVER k <> bool_or(is_collection) OVER k AS mixed, count(*) OVER k AS size, first_value(work_id) OVER (PARTITION BY a, norm, lang ORDER BY n DESC, work_id) AS best FROM t WINDOW k AS (PARTITION BY a, norm, lang))
SELECT work_id, CASE WHEN NOT mixed AND size > 1 THEN best ELSE work_id END AS canonical_id, CASE WHEN mixed THEN 1 ELSE size END::BIGINT AS size FROM c""",
)


def _pairs(s, d):
    w = Tables(s, d).works
    other = w.select((F.col("work_id") - 100).alias("work_id"), F.col("title").alias("t"))
    return w.unionByName(w.join(other, "work_id").select((F.col("work_id") + 100000).alias("work_id"), "author_id", F.concat("title", F.lit(" / Vol: "), "t", F.lit(" (Saga/2)")).alias("title"), F.lit(2000).alias("pub_year"), "is_sf"))


_add(
    "slash_omnibus",
    lambda s, d: catalog.slash_omnibus(_pairs(s, d), Model(s, d).work_stats),
    f"""WITH {DERIVED}, u AS (SELECT a.work_id + 100000 AS work_id, a.author_id, unnest([a.title, b.title]) AS part FROM works a JOIN works b ON b.work_id = a.work_id + 100),
h AS (SELECT u.work_id, part, w.work_id AS sibling, w.pub_year, row_number() OVER (PARTITION BY u.work_id, part ORDER BY w.title = part DESC, coalesce(n, 0) DESC, w.work_id) AS r FROM u JOIN works w ON w.author_id = u.author_id AND (w.title = part OR (length(part) >= 12 AND starts_with(w.title, part || ' '))) LEFT JOIN (SELECT work_id, n FROM ws) s ON s.work_id = w.work_id)
SELECT work_id, count(DISTINCT sibling) AS parts, min(pub_year) AS first_year FROM h WHERE r = 1 GROUP BY work_id HAVING count(DISTINCT sibling) >= 2""",
)
_add(
    "work_years",
    lambda s, d: catalog.work_years(Tables(s, d).works.withColumn("pub_year", F.col("pub_year") + 20), s.range(0, 4000, 500).select(F.col("id").alias("work_id"), F.lit(1850).alias("pub_year"))),
    f"WITH {CTE}, o AS (SELECT range AS work_id, 1850 AS y FROM range(0, 4000, 500)), y AS (SELECT work_id, min(pub_year + 20) AS f FROM works WHERE pub_year + 20 BETWEEN 1500 AND 2030 GROUP BY work_id) SELECT coalesce(o.work_id, y.work_id) AS work_id, coalesce(o.y, y.f)::INTEGER AS pub_year FROM y FULL JOIN o ON o.work_id = y.work_id",
)
_add(
    "year_filter",
    lambda s, d: (lambda w: catalog.in_years(w, w, 1950, 1969).select("work_id"))(Tables(s, d).works),
    f"WITH {CTE} SELECT work_id FROM works WHERE pub_year BETWEEN 1950 AND 1969",
)
