"""Queries and SQL of comparisons, consensus, graph iterations, agreement and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectorium.functions.numeric import six
from lectorium.functions.storage import saved
from lectorium.operators import consensus, evaluation, graph, pairwise, temporal
from lectorium.plans.adapter import CTE, Tables
from lectorium.plans.ratings import DERIVED, Model

QUERIES, SQL = {}, {}


def _add(name, query, sql):
    QUERIES[name], SQL[name] = query, sql


def _r9(df, *columns):
    """Rounded to nine places off the ties that sums of simple fractions fall on."""
    return df.select(*[F.round(F.col(c) + 3e-11, 9).alias(c) if c in columns else F.col(c) for c in df.columns])


def _r(df, *columns):
    return df.select(*[six(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


_BAL = f"""{DERIVED}, sd AS (SELECT user_id, work_id, CASE WHEN rating >= 4 THEN 1 ELSE -1 END::INTEGER AS side FROM ev WHERE rating <> 3),
hl AS (SELECT user_id, count(*) FILTER (WHERE side = 1) AS h, count(*) FILTER (WHERE side = -1) AS l FROM sd GROUP BY user_id),
bal AS (SELECT user_id, work_id, side FROM (SELECT sd.*, h, l, row_number() OVER (PARTITION BY user_id, side ORDER BY md5(user_id::VARCHAR || '-' || work_id::VARCHAR || '-votes'), work_id) AS r FROM sd JOIN hl USING (user_id)) WHERE r <= least(12, h, l)),
ex AS (SELECT user_id, work_id, side, least(12, h, l)::DOUBLE / CASE WHEN side = 1 THEN h ELSE l END AS mass FROM sd JOIN hl USING (user_id) WHERE least(h, l) > 0)"""
_add("balanced_votes", lambda s, d: pairwise.balanced_votes(Model(s, d).events), f"WITH {_BAL} SELECT * FROM bal")
_add("expected_votes", lambda s, d: _r(pairwise.expected_votes(Model(s, d).events), "mass"), f"WITH {_BAL} SELECT user_id, work_id, side, round(mass, 6) AS mass FROM ex")
_add(
    "pairwise_esteem",
    lambda s, d: _r(pairwise.esteem(pairwise.balanced_votes(Model(s, d).events)), "esteem"),
    f"WITH {_BAL}, p AS (SELECT a.work_id AS w, b.work_id AS l FROM bal a JOIN bal b ON a.user_id = b.user_id AND a.side = 1 AND b.side = -1), c AS (SELECT work_id, sum(wins)::BIGINT AS wins, sum(losses)::BIGINT AS losses FROM (SELECT w AS work_id, 1 AS wins, 0 AS losses FROM p UNION ALL SELECT l, 0, 1 FROM p) GROUP BY work_id) SELECT work_id, wins, losses, round((wins + 10) / (wins + losses + 20)::DOUBLE, 6) AS esteem FROM c",
)
_add(
    "pair_table",
    lambda s, d: pairwise.pair_table(pairwise.balanced_votes(Model(s, d).events), 3),
    f"WITH {_BAL} SELECT a.work_id AS winner, b.work_id AS loser, count(*) AS n FROM bal a JOIN bal b ON a.user_id = b.user_id AND a.side = 1 AND b.side = -1 GROUP BY ALL HAVING count(*) >= 3",
)
_add(
    "residual_enthusiasm",
    lambda s, d: _r(pairwise.residuals(Model(s, d).events), "residual"),
    f"WITH {DERIVED}, mu AS (SELECT avg(rating) AS mu FROM ev), u AS (SELECT user_id, sum(rating) AS us, count(*) AS un FROM ev GROUP BY user_id), b AS (SELECT work_id, sum(rating) AS bs, count(*) AS bn FROM ev GROUP BY work_id) SELECT work_id, count(*) AS n, round(avg(rating - (us + 10 * mu) / (un + 10) - (bs + 20 * mu) / (bn + 20) + mu), 6) AS residual FROM ev JOIN u USING (user_id) JOIN b USING (work_id), mu GROUP BY work_id",
)
_add(
    "contrastive_lift",
    lambda s, d: (lambda m: _r(pairwise.contrast(m.events, m.taste.filter("lit_share >= 0.8"), m.taste.filter("lit_share < 0.6")), "lift"))(Model(s, d)),
    f"WITH {DERIVED}, g AS (SELECT user_id, lit_share >= 0.8 AS one FROM tst WHERE lit_share >= 0.8 OR lit_share < 0.6) SELECT work_id, count(*) FILTER (WHERE one) AS n1, count(*) FILTER (WHERE NOT one) AS n0, round(avg((rating = 5)::INTEGER) FILTER (WHERE one) - avg((rating = 5)::INTEGER) FILTER (WHERE NOT one), 6) AS lift FROM ev JOIN g USING (user_id) GROUP BY work_id HAVING count(*) FILTER (WHERE one) >= 3 AND count(*) FILTER (WHERE NOT one) >= 3",
)


def _cells(s, d, soft=False):
    m = Model(s, d)
    users = m.hist.select("user_id")
    parts = None
    for p, k in enumerate((5, 7, 9)):
        one = users.select("user_id", F.lit(p).alias("partition"), (F.col("user_id") * (p + 3) % k).cast("int").alias("community"))
        if soft:
            one = one.withColumn("member", F.lit(0.7)).unionByName(one.select("user_id", "partition", ((F.col("community") + 1) % k).cast("int").alias("community"), F.lit(0.3).alias("member")))
        parts = one if parts is None else parts.unionByName(one)
    return consensus.cells(pairwise.expected_votes(m.events), parts)


_PARTS = " UNION ALL ".join(f"SELECT user_id, {p} AS partition, (user_id * {p + 3} % {k})::INTEGER AS community, {k} AS k FROM hist" for p, k in enumerate((5, 7, 9)))
_CELLS = f"""{_BAL}, pt AS ({_PARTS}), cell AS (
  SELECT work_id, partition, community, coalesce(sum(mass) FILTER (WHERE side = 1), 0) AS high, coalesce(sum(mass) FILTER (WHERE side = -1), 0) AS low FROM ex JOIN pt USING (user_id) GROUP BY ALL
)"""


def _posterior_sql(gamma, cap=30.0, prior=4.0, least=3.0):
    """Name the posterior of a cell (q), written from its formulas: capped Beta, then odds over gamma."""
    return f"""q AS (SELECT work_id, partition, community, p0 / ({gamma} - ({gamma} - 1) * p0) AS p, v0 * power((p0 / ({gamma} - ({gamma} - 1) * p0)) * (1 - p0 / ({gamma} - ({gamma} - 1) * p0)) / (p0 * (1 - p0)), 2) AS v FROM (
  SELECT *, al / (al + be) AS p0, al * be / (power(al + be, 2) * (al + be + 1)) AS v0 FROM (
    SELECT *, high * least(1.0::DOUBLE, {cap}::DOUBLE / greatest(high + low, 1)) + {prior / 2}::DOUBLE AS al, low * least(1.0::DOUBLE, {cap}::DOUBLE / greatest(high + low, 1)) + {prior / 2}::DOUBLE AS be FROM cell WHERE round(high + low, 9) >= {least}))
)"""


def _esteem_sql(gamma="1.0::DOUBLE"):
    return f"""{_CELLS}, {_posterior_sql(gamma)}, qq AS (SELECT work_id, partition, count(*) AS m, avg(p) AS mu, var_samp(p) AS vs, avg(v) AS pv FROM q GROUP BY ALL),
ks AS (SELECT * FROM (VALUES (0, 5), (1, 7), (2, 9)) t(partition, k)),
ce AS (SELECT work_id, partition, coalesce(m, 0) AS observed, votes, coalesce(m, 0) / k::DOUBLE AS coverage, coalesce(m, 0) >= greatest(3, ceil(k / 4.0)) AND round(votes, 9) >= 10 AS valid, CASE WHEN valid THEN mu END AS mu, CASE WHEN valid THEN sqrt(greatest(vs - pv, 0)) END AS tau,
  CASE WHEN valid THEN mu - 1.2816::DOUBLE * sqrt(greatest(vs - pv, 0)) END AS score, CASE WHEN valid THEN sqrt((greatest(vs - pv, 0) + pv) / m) END AS se
  FROM (SELECT work_id, partition, sum(high + low) AS votes FROM cell GROUP BY ALL) LEFT JOIN qq USING (work_id, partition) JOIN ks USING (partition))"""


def _sizes(s):
    return s.createDataFrame([(p, k) for p, k in enumerate((5, 7, 9))], "partition int, k int")


_add("community_cells", lambda s, d: _r(_cells(s, d), "high", "low"), f"WITH {_CELLS} SELECT work_id, partition, community, round(high, 6) AS high, round(low, 6) AS low FROM cell")
_add(
    "soft_community_cells",
    lambda s, d: _r(_cells(s, d, True), "high", "low"),
    f"WITH {_CELLS}, sp AS (SELECT user_id, partition, community, 0.7::DOUBLE AS m FROM pt UNION ALL SELECT user_id, partition, ((community + 1) % k)::INTEGER, 0.3::DOUBLE FROM pt) SELECT work_id, partition, community, round(coalesce(sum(mass * m) FILTER (WHERE side = 1), 0), 6) AS high, round(coalesce(sum(mass * m) FILTER (WHERE side = -1), 0), 6) AS low FROM ex JOIN sp USING (user_id) GROUP BY ALL",
)
_ESTEEM = ["votes", "coverage", "mu", "tau", "score", "se"]
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _ESTEEM)
_add("conditional_esteem", lambda s, d: _r(consensus.conditional_esteem(_cells(s, d), _sizes(s), least_total=10.0), *_ESTEEM), f"WITH {_esteem_sql()} SELECT work_id, partition, observed, valid, {_ROUNDED} FROM ce")
_add("selection_bound", lambda s, d: _r(consensus.conditional_esteem(_cells(s, d), _sizes(s), least_total=10.0, gamma=1.5), *_ESTEEM), f"WITH {_esteem_sql('1.5::DOUBLE')} SELECT work_id, partition, observed, valid, {_ROUNDED} FROM ce")
_COMBINED = "cmb AS (SELECT work_id, count(score) AS valid, avg(score) AS score, avg(mu) AS mu, avg(tau) AS tau, coalesce(stddev_samp(score), 0) AS sd, avg(se) AS se, sum(coverage) / 3 AS coverage FROM ce GROUP BY work_id HAVING count(score) >= 2)"
_add(
    "combined_partitions",
    lambda s, d: _r(consensus.combine_partitions(consensus.conditional_esteem(_cells(s, d), _sizes(s), least_total=10.0), 3), "score", "mu", "tau", "sd", "se", "coverage", "uncertainty"),
    f"WITH {_esteem_sql()}, {_COMBINED} SELECT work_id, valid, round(score, 6) AS score, round(mu, 6) AS mu, round(tau, 6) AS tau, round(sd, 6) AS sd, round(se, 6) AS se, round(coverage, 6) AS coverage, round(sqrt(sd * sd + se * se), 6) AS uncertainty, coverage >= 0.5 AS eligible FROM cmb",
)


def _tiers(s, d):
    """Evidence of the tier rule from work statistics: ranks by several scores stand for the universes."""
    w = Model(s, d).work_stats.select("work_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p5", "p_low")])
    for c in ("mean", "p5", "n"):
        w = w.join(evaluation.ranked(w, c).select("work_id", F.col("rank").alias(f"r_{c}")), "work_id")
    e = {
        "pair_mass": F.col("n"), "joint_rate": F.col("p5") * 2, "ranks": F.array("r_mean", "r_p5"), "membership_ranks": F.array("r_mean"), "feature_ranks": F.array(F.when(F.col("r_p5") % 7 != 0, F.col("r_p5"))),
        "boundary_rank": F.when(F.col("work_id") % 10 != 0, F.col("r_mean")), "fixed_rate": 1 - F.col("p_low"), "community_status": F.when(F.col("work_id") % 9 != 0, "broadly_stable").otherwise("sensitive"), "gamma2_score": F.col("mean") * 15,
    }
    return w.select("work_id", consensus.tier(e).alias("tier"))


_add(
    "consensus_tiers",
    _tiers,
    f"""WITH {DERIVED}, r AS (SELECT work_id, n, round(mean, 6) AS mean, round(p5, 6) AS p5, round(p_low, 6) AS p_low, row_number() OVER (ORDER BY round(mean, 6) DESC, work_id) AS rm, row_number() OVER (ORDER BY round(p5, 6) DESC, work_id) AS rp FROM ws)
SELECT work_id, CASE WHEN h AND n >= 20 AND p5 * 2 >= 0.8 AND 1 - p_low >= 0.8 THEN 'stable_core' WHEN h AND p5 * 2 >= 0.5 AND 1 - p_low >= 0.5 THEN 'supported_boundary' ELSE 'underexposed_or_contested' END AS tier FROM (SELECT *, rm <= 200 AND rp <= 200 AND rp % 7 <> 0 AND work_id % 10 <> 0 AND work_id % 9 <> 0 AND mean * 15 >= 50 AS h FROM r)""",
)
_add(
    "concentration",
    lambda s, d: _r(consensus.concentration(_cells(s, d)), "hhi", "concentration"),
    f"WITH {_CELLS}, t AS (SELECT *, high / nullif(sum(high) OVER (PARTITION BY work_id, partition), 0) AS s FROM cell) SELECT work_id, partition, round(sum(s * s), 6) AS hhi, round(CASE WHEN count(*) > 1 THEN (sum(s * s) - 1.0::DOUBLE / count(*)) / (1 - 1.0::DOUBLE / count(*)) ELSE 1 END, 6) AS concentration FROM t GROUP BY ALL",
)
_add(
    "leave_one_community_out",
    lambda s, d: _r(consensus.leave_one_out(_cells(s, d)), "largest_fall"),
    f"WITH {_CELLS}, t AS (SELECT *, sum(high) OVER w AS hs, sum(high + low) OVER w AS ts FROM cell WINDOW w AS (PARTITION BY work_id, partition)) SELECT work_id, partition, round(max(hs / nullif(ts, 0) - (hs - high) / nullif(ts - high - low, 0)), 6) AS largest_fall FROM t GROUP BY ALL",
)
_add(
    "worst_reweighting",
    lambda s, d: _r(consensus.worst_reweighting(consensus.posterior(_cells(s, d))), "worst"),
    f"""WITH {_CELLS}, {_posterior_sql("1.0::DOUBLE")}, x AS (SELECT work_id, partition, list_sort(list(p)) AS ps FROM q GROUP BY ALL)
SELECT work_id, partition, round(list_min(list_transform(range(0, len(ps)), lambda m: (2 * coalesce(list_sum(ps[1:m]), 0) + coalesce(list_sum(ps[m + 1:]), 0)) / (2 * m + len(ps) - m))), 6) AS worst FROM x""",
)
_CDF, _p, _acc = [], 0.36787944117144233, 0.0
for _k in range(8):
    _acc += _p
    _CDF.append(f"WHEN u < {_acc!r}::DOUBLE THEN {_k}")
    _p /= _k + 1
REPLICATES = 200
_add(
    "reader_bootstrap",
    lambda s, d: _r(consensus.bootstrap(pairwise.expected_votes(Model(s, d).events), REPLICATES), "mean", "sd", "low", "high"),
    f"WITH {_BAL}, b AS (SELECT user_id, rep, ('0x' || substr(md5(user_id::VARCHAR || '-' || rep::VARCHAR || '-boot'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM hl, range({REPLICATES}) r(rep)), w AS (SELECT user_id, rep, CASE {' '.join(_CDF)} ELSE 8 END AS k FROM b), x AS (SELECT work_id, rep, coalesce(sum(mass * k) FILTER (WHERE side = 1), 0) / sum(mass * k) AS share FROM ex JOIN w USING (user_id) WHERE k > 0 GROUP BY ALL) SELECT work_id, round(avg(share), 6) AS mean, round(stddev_samp(share), 6) AS sd, round(quantile_cont(share, 0.1), 6) AS low, round(quantile_cont(share, 0.9), 6) AS high FROM x GROUP BY work_id",
)


def _whole(ctes):
    """The CTEs with each computed once, which the text of many rounds needs."""
    return ctes.replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


def _edges(s, d):
    m = Model(s, d)
    return m.events.filter("rating >= 4").join(m.work_stats.select("work_id", (1.0 / F.ln(1 + F.col("n"))).alias("w")), "work_id").select("user_id", "work_id", "w")


_EDGES = f"{DERIVED}, ed AS (SELECT e.user_id, e.work_id, 1.0::DOUBLE / ln(1 + s.n) AS w FROM ev e JOIN ws s ON s.work_id = e.work_id WHERE rating >= 4)"


def _hits_sql(rounds):
    out = f"{_EDGES}, h0 AS (SELECT DISTINCT user_id, 1.0::DOUBLE AS h FROM ed)"
    for i in range(rounds):
        out += f", a{i} AS (SELECT work_id, sum(w * h) AS a FROM ed JOIN h{i} USING (user_id) GROUP BY work_id), b{i} AS (SELECT work_id, a / (SELECT sqrt(sum(a * a)) FROM a{i}) AS a FROM a{i}), g{i} AS (SELECT user_id, sum(w * a) AS h FROM ed JOIN b{i} USING (work_id) GROUP BY user_id), h{i + 1} AS (SELECT user_id, h / (SELECT sqrt(sum(h * h)) FROM g{i}) AS h FROM g{i})"
    return out


def _reflections_sql(rounds):
    out = f"{_EDGES}, k0 AS (SELECT work_id, count(*)::DOUBLE AS v FROM ed GROUP BY work_id), u0 AS (SELECT user_id, count(*)::DOUBLE AS v FROM ed GROUP BY user_id)"
    for i in range(1, rounds + 1):
        v = f"SELECT work_id, avg(v) AS v FROM ed JOIN u{i - 1} USING (user_id) GROUP BY work_id"
        if i % 2 == 0:
            v = f"SELECT work_id, coalesce((v - avg(v) OVER ()) / nullif(stddev_pop(v) OVER (), 0), 0) AS v FROM ({v})"
        out += f", k{i} AS ({v}), u{i} AS (SELECT user_id, avg(v) AS v FROM ed JOIN k{i - 1} USING (work_id) GROUP BY user_id)"
    return out


def _core_sql(passes):
    out = f"{_EDGES}, c0 AS (SELECT user_id, work_id FROM ed)"
    for i in range(0, 2 * passes, 2):
        out += f", c{i + 1} AS (SELECT * FROM c{i} WHERE user_id IN (SELECT user_id FROM c{i} GROUP BY 1 HAVING count(*) >= 10)), c{i + 2} AS (SELECT * FROM c{i + 1} WHERE work_id IN (SELECT work_id FROM c{i + 1} GROUP BY 1 HAVING count(*) >= 6))"
    return out


#: The rounds that each method's own definition takes.
ROUNDS = {"hits": 8, "reflections": 16, "core": 3, "labels": 15, "attractor": 20, "power": 12}
_add("hits_authority", lambda s, d: _r(graph.hits(_edges(s, d), ROUNDS["hits"]), "authority"), f"WITH {_whole(_hits_sql(ROUNDS['hits']))} SELECT work_id, round(a, 6) AS authority FROM b{ROUNDS['hits'] - 1}")
_add("method_of_reflections", lambda s, d: _r(graph.reflections(_edges(s, d), ROUNDS["reflections"]), "reflection"), f"WITH {_whole(_reflections_sql(ROUNDS['reflections']))} SELECT work_id, round(k{ROUNDS['reflections']}.v, 6) AS reflection, k0.v AS degree FROM k{ROUNDS['reflections']} JOIN k0 USING (work_id)")
_add("bipartite_core", lambda s, d: graph.core(_edges(s, d).select("user_id", "work_id"), 10, 6, ROUNDS["core"]), f"WITH {_whole(_core_sql(ROUNDS['core']))} SELECT * FROM c{2 * ROUNDS['core']}")
_PMI = {"k": 5, "least": 2, "floor": 0.3, "most": 400}  # the synthetic readers rate alike, so few pairs pass the default floors
_NEAR = f"""{_EDGES}, e1 AS (SELECT DISTINCT user_id, work_id FROM ed), dg AS (SELECT work_id, count(*) AS d FROM e1 GROUP BY work_id),
ce0 AS (SELECT user_id, work_id FROM e1 QUALIFY count(*) OVER (PARTITION BY user_id) BETWEEN 2 AND 400 AND row_number() OVER (PARTITION BY user_id ORDER BY work_id) <= 30),
pr AS (SELECT a.work_id AS a, b.work_id AS b, count(*) AS n FROM ce0 a JOIN ce0 b ON a.user_id = b.user_id AND a.work_id < b.work_id GROUP BY ALL HAVING count(*) >= 2),
pm AS (SELECT a, b, n, round(ln(n * (SELECT count(DISTINCT user_id) FROM e1)::DOUBLE / (x.d * y.d)), 6) AS pmi FROM pr JOIN dg x ON x.work_id = a JOIN dg y ON y.work_id = b),
nb AS (SELECT work_id, near, n, pmi, row_number() OVER (PARTITION BY work_id ORDER BY pmi DESC, n DESC, near) AS rank FROM (SELECT a AS work_id, b AS near, n, pmi FROM pm WHERE pmi >= 0.3 UNION ALL SELECT b, a, n, pmi FROM pm WHERE pmi >= 0.3) QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY pmi DESC, n DESC, near) <= 5)"""
_add("pmi_neighbours", lambda s, d: graph.pmi_neighbours(_edges(s, d), **_PMI).select("work_id", "near", "pmi", "rank"), f"WITH {_NEAR} SELECT work_id, near, pmi, rank FROM nb")


def _labels_sql(rounds):
    out = f"{_NEAR}, l0 AS (SELECT DISTINCT work_id, work_id AS label FROM nb)"
    for i in range(rounds):
        out += f", l{i + 1} AS (SELECT work_id, label FROM (SELECT nb.work_id, l.label, round(sum(pmi), 6) AS w FROM nb JOIN l{i} l ON l.work_id = nb.near GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY w DESC, label) = 1)"
    return out


def _near(s, d):
    return graph.pmi_neighbours(_edges(s, d), **_PMI).select("work_id", "near", "pmi")


def _power_sql(rounds):
    out = f"{_NEAR}, x0 AS (SELECT DISTINCT work_id, 1.0::DOUBLE AS x FROM nb)"
    for i in range(rounds):
        out += f", y{i} AS (SELECT nb.work_id, sum(pmi * x) AS y FROM nb JOIN x{i} x ON x.work_id = nb.near GROUP BY nb.work_id), x{i + 1} AS (SELECT work_id, y / (SELECT sqrt(sum(y * y)) FROM y{i}) AS x FROM y{i})"
    return out


_LABELS = _whole(_labels_sql(ROUNDS["labels"]))
_add("label_propagation", lambda s, d: graph.label_propagation(_near(s, d), ROUNDS["labels"]), f"WITH {_LABELS} SELECT work_id, label FROM l{ROUNDS['labels']}")
_add("power_centrality", lambda s, d: _r(graph.power_centrality(_near(s, d), ROUNDS["power"]), "centrality"), f"WITH {_whole(_power_sql(ROUNDS['power']))} SELECT work_id, round(x, 6) AS centrality FROM x{ROUNDS['power']}")
_add(
    "community_portfolio",
    lambda s, d: (lambda near: graph.nested_portfolio(near, graph.label_propagation(near, ROUNDS["labels"]), Model(s, d).work_stats.select("work_id", F.round("p5", 6).alias("score"))))(saved(_near(s, d), "near")),
    f"""WITH {_LABELS}, sz AS (SELECT label, count(*) AS size FROM l{ROUNDS["labels"]} GROUP BY label HAVING count(*) >= 3), rk AS (SELECT l.work_id, label, size, row_number() OVER (PARTITION BY label ORDER BY round(p5, 6) DESC, l.work_id) AS rank FROM l{ROUNDS["labels"]} l JOIN sz USING (label) JOIN ws ON ws.work_id = l.work_id)
SELECT row_number() OVER (ORDER BY rank, size DESC, label, work_id)::INTEGER AS place, work_id, label, rank::INTEGER AS rank FROM rk QUALIFY place <= 50""",
)


def _jury(s, d):
    e = Model(s, d).events
    start = e.select("user_id").distinct().withColumn("w", F.when(F.col("user_id") % 30 == 0, 20.0).otherwise(0.4))
    return e.select("user_id", "work_id", ((F.col("rating") - 3) / 2.0).alias("s")), start.crossJoin(start.agg(F.avg("w").alias("m"))).select("user_id", (F.col("w") / F.col("m")).alias("w"))


def _attractor_sql(rounds):
    out = f"{DERIVED}, sg AS (SELECT user_id, work_id, (rating - 3) / 2.0::DOUBLE AS s FROM ev), st AS (SELECT DISTINCT user_id, CASE WHEN user_id % 30 = 0 THEN 20.0::DOUBLE ELSE 0.4::DOUBLE END AS w FROM ev), w0 AS (SELECT user_id, w / (SELECT avg(w) FROM st) AS w FROM st)"
    for i in range(rounds):
        out += f""", v{i} AS (SELECT work_id, sum(s * w) AS v FROM sg JOIN w{i} USING (user_id) GROUP BY work_id), t{i} AS (SELECT user_id, sum(s * tanh(v / greatest(1.5::DOUBLE * (SELECT sqrt(avg(v * v)) FROM v{i}), 1e-12))) AS t FROM sg JOIN v{i} USING (work_id) GROUP BY user_id),
z{i} AS (SELECT user_id, 1 / (1 + exp(-least(greatest(2.5::DOUBLE * (t - (SELECT avg(t) FROM t{i})) / greatest((SELECT stddev_pop(t) FROM t{i}), 1e-12), -12), 12))) AS g FROM t{i}), m{i} AS (SELECT user_id, 0.35::DOUBLE * w + 0.65::DOUBLE * g / (SELECT avg(g) FROM z{i}) AS w FROM w{i} JOIN z{i} USING (user_id)), w{i + 1} AS (SELECT user_id, w / (SELECT avg(w) FROM m{i}) AS w FROM m{i})"""
    return out + f", vf AS (SELECT work_id, sum(s * w) AS v FROM sg JOIN w{rounds} USING (user_id) GROUP BY work_id)"


_add("jury_attractor", lambda s, d: _r(graph.attractor(*_jury(s, d), rounds=ROUNDS["attractor"]), "direction"), f"WITH {_whole(_attractor_sql(ROUNDS['attractor']))} SELECT work_id, round(v / (SELECT sqrt(sum(v * v)) FROM vf), 6) AS direction FROM vf")


def _rankings(s, d):
    """Two rankings of all works: by mean and by share of fives."""
    w = Model(s, d).work_stats
    r = w.select("work_id", F.round("mean", 6).alias("mean"), F.round("p5", 6).alias("p5"))
    return evaluation.ranked(r, "mean"), evaluation.ranked(r, "p5")


_RANKS = f"{DERIVED}, ra AS (SELECT work_id, row_number() OVER (ORDER BY round(mean, 6) DESC, work_id) AS rank FROM ws), rb AS (SELECT work_id, row_number() OVER (ORDER BY round(p5, 6) DESC, work_id) AS rank FROM ws)"
_add("jaccard_at_k", lambda s, d: _r(evaluation.overlap_at(*_rankings(s, d), [10, 50, 200]), "jaccard"), f"WITH {_RANKS}, j AS (SELECT a.rank AS x, b.rank AS y FROM ra a FULL JOIN rb b ON a.work_id = b.work_id) SELECT k::INTEGER AS k, count(*) FILTER (WHERE x <= k AND y <= k) AS common, round(count(*) FILTER (WHERE x <= k AND y <= k)::DOUBLE / count(*) FILTER (WHERE x <= k OR y <= k), 6) AS jaccard FROM j, (SELECT unnest([10, 50, 200]) AS k) GROUP BY k")
_add("rank_biased_overlap", lambda s, d: _r(evaluation.rank_biased_overlap(*_rankings(s, d)), "rbo"), f"WITH {_RANKS}, dp AS (SELECT greatest(ra.rank, rb.rank) AS dd, count(*) AS c FROM ra JOIN rb USING (work_id) GROUP BY dd), g AS (SELECT rank AS k, sum(coalesce(c, 0)) OVER (ORDER BY rank)::DOUBLE / rank AS a FROM ra LEFT JOIN dp ON dd = rank) SELECT round(0.02::DOUBLE * sum(a * power(0.98::DOUBLE, k - 1)) + arg_max(a, k) * power(0.98::DOUBLE, max(k)), 6) AS rbo FROM g")
_add("spearman", lambda s, d: _r(evaluation.spearman(*_rankings(s, d)), "rho"), f"WITH {_RANKS}, j AS (SELECT row_number() OVER (ORDER BY a.rank, a.work_id) AS x, row_number() OVER (ORDER BY b.rank, a.work_id) AS y FROM ra a JOIN rb b ON a.work_id = b.work_id) SELECT count(*) AS n, round(1 - 6 * sum((x - y) * (x - y))::DOUBLE / (count(*) * (count(*) * count(*) - 1)), 6) AS rho FROM j")
_add("precision_recall", lambda s, d: _r(evaluation.precision_recall(_rankings(s, d)[0], Model(s, d).literary_works, [10, 100]), "precision", "recall"), f"WITH {_RANKS}, want AS (SELECT work_id FROM works WHERE author_id % 10 < 3) SELECT k::INTEGER AS k, count(*) FILTER (WHERE work_id IN (SELECT work_id FROM want)) AS hits, round(hits::DOUBLE / k, 6) AS precision, round(hits::DOUBLE / (SELECT count(*) FROM want), 6) AS recall FROM ra, (SELECT unnest([10, 100]) AS k) WHERE rank <= k GROUP BY k")
_add(
    "average_precision",
    lambda s, d: (lambda m: _r(evaluation.average_precision(m.work_stats.select(F.col("work_id").alias("id"), F.round("mean", 2).alias("score"), (F.col("work_id") % 10 < 3).alias("positive"))), "average_precision", "auc"))(Model(s, d)),
    f"WITH {DERIVED}, x AS (SELECT work_id AS id, round(mean, 2) AS score, work_id % 10 < 3 AS pos FROM ws), y AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r, sum(pos::INTEGER) OVER (ORDER BY score DESC, id) AS h FROM x) SELECT round(avg(h::DOUBLE / r) FILTER (WHERE pos), 6) AS average_precision, (SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) FROM x a JOIN x b ON a.pos AND NOT b.pos) AS auc FROM y",
)
_add("pareto_front", lambda s, d: evaluation.pareto_front(Model(s, d).work_stats.select("work_id", "n", F.round("mean", 6).alias("mean")), "n", "mean"), f"WITH {DERIVED}, p AS (SELECT work_id, n, round(mean, 6) AS mean FROM ws) SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.n >= a.n AND b.mean >= a.mean AND (b.n > a.n OR b.mean > a.mean))")

_add("import_bursts", lambda s, d: temporal.import_bursts(Tables(s, d).interactions, 0.2), f"WITH {CTE}, dd AS (SELECT user_id, added_at // 86400 AS day, count(*) AS n FROM inter GROUP BY ALL), r AS (SELECT *, count(*) OVER w AS days, sum(n) OVER w AS events, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, day) AS k FROM dd WINDOW w AS (PARTITION BY user_id)) SELECT user_id, days, events::BIGINT AS events, day AS peak_day, n AS peak_events, n / events::DOUBLE >= 0.2 AS imported FROM r WHERE k = 1")


def _timed(s, d):
    return Tables(s, d).timed


_TIMED = f"{CTE}, tm AS (SELECT user_id, work_id, max(rating) AS rating, min(added_at) AS added_at, max(updated_at) AS updated_at, min(read_at) AS read_at FROM inter GROUP BY ALL)"
_CLOCKS = f"""{DERIVED}, tm AS (SELECT user_id, work_id, max(rating) AS rating, min(added_at) AS added_at, max(updated_at) AS updated_at, min(read_at) AS read_at FROM inter GROUP BY ALL),
dy AS (SELECT user_id, added_at // 86400 AS day, count(*) AS n FROM tm GROUP BY ALL), pf AS (SELECT user_id, min(day) AS first_day, sum(n) AS profile_events, arg_max(day, n * 100000 - day) AS peak_day, max(n) / sum(n)::DOUBLE AS peak_day_share FROM dy GROUP BY user_id),
ck AS (
  SELECT user_id, work_id, rating, 'added_all' AS definition, added_at AS event_at FROM tm
  UNION ALL SELECT user_id, work_id, rating, 'added_no_bulk_users', added_at FROM tm JOIN pf USING (user_id) WHERE profile_events < 20 OR peak_day_share < 0.5
  UNION ALL SELECT user_id, work_id, rating, 'added_post_onboarding', added_at FROM tm JOIN pf USING (user_id) WHERE added_at // 86400 > first_day + 7 AND added_at // 86400 <> peak_day
  UNION ALL SELECT user_id, work_id, rating, 'updated_all', updated_at FROM tm WHERE updated_at IS NOT NULL
  UNION ALL SELECT user_id, work_id, rating, 'read_available', read_at FROM tm WHERE read_at IS NOT NULL
)"""
_add("event_clocks", lambda s, d: (lambda t: temporal.clocks(t, temporal.import_profile(t)))(_timed(s, d)), f"WITH {_CLOCKS} SELECT user_id, work_id, rating, definition, event_at FROM ck")
_SIDES = ("early", "late")
_add(
    "early_late_contrast",
    lambda s, d: (lambda t, m: _r9(temporal.early_late(temporal.clocks(t, temporal.import_profile(t)), m.taste.select("user_id", F.col("lit_share").alias("q")), least_mass=2.0), *[f"{x}_{c}" for x in _SIDES for c in ("mass", "p5", "kish")], "delta_p5"))(_timed(s, d), Model(s, d)),
    f"""WITH {_CLOCKS}, u AS (SELECT ck.*, lit_share AS q FROM ck JOIN tst USING (user_id) WHERE (rating = 5 OR rating <= 3) AND lit_share > 0), c AS (SELECT definition, work_id, quantile_cont(event_at, 0.2) AS lo, quantile_cont(event_at, 0.8) AS hi FROM u GROUP BY ALL),
g AS (SELECT definition, work_id, {", ".join(f"sum(q) FILTER (WHERE {w}) AS {x}_mass, coalesce(sum(q) FILTER (WHERE {w} AND rating = 5), 0) / sum(q) FILTER (WHERE {w}) AS {x}_p5, power(sum(q) FILTER (WHERE {w}), 2) / sum(q * q) FILTER (WHERE {w}) AS {x}_kish, count(DISTINCT user_id) FILTER (WHERE {w}) AS {x}_users" for x, w in zip(_SIDES, ("event_at <= lo", "event_at >= hi"), strict=True))} FROM u JOIN c USING (definition, work_id) GROUP BY ALL)
SELECT definition, work_id, {", ".join(f"round({x}_{c} + 3e-11, 9) AS {x}_{c}" for x in _SIDES for c in ("mass", "p5", "kish"))}, early_users, late_users, round(late_p5 - early_p5 + 3e-11, 9) AS delta_p5 FROM g WHERE round(early_mass, 9) >= 2 AND round(late_mass, 9) >= 2""",
)
_ERAS = [788918400, 852076800, 915148800, 1009843200]
_add("era_ranks", lambda s, d: temporal.era_ranks(_timed(s, d), _ERAS), f"WITH {_TIMED}, e AS (SELECT *, CASE WHEN added_at < {_ERAS[0]} OR added_at >= {_ERAS[3]} THEN NULL WHEN added_at < {_ERAS[1]} THEN 0 WHEN added_at < {_ERAS[2]} THEN 1 ELSE 2 END AS era FROM tm), p AS (SELECT era, avg((rating = 5)::INTEGER) AS p0 FROM e WHERE era IS NOT NULL GROUP BY era), g AS (SELECT era, work_id, count(*) AS n, round((count(*) FILTER (WHERE rating = 5) + 10 * any_value(p0)) / (count(*) + 10), 6) AS score FROM e JOIN p USING (era) GROUP BY ALL HAVING count(*) >= 3) SELECT era::INTEGER AS era, work_id, n, score, row_number() OVER (PARTITION BY era ORDER BY score DESC, n DESC, work_id) AS rank FROM g QUALIFY rank <= 50")
