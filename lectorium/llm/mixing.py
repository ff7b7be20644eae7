"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix takes share times all words. Sources share it by weight, and none gets more than cap times its
own words: what is over goes to the others by weight until none is above. Targets become integer quotas
of equal blocks of block_words words by highest quotients (votes / 1, 3, 5, ...), first over sources,
then over the shards of each source with the shards' words as votes. A shard's documents stand in seeded
order, end to end on a circle; its quota is taken as whole turns and then as a run of blocks from a
seeded block on, so that every document gets its turns and what of it the run covers.

Every step is a DataFrame operation. Sources are dealt into shards of shard_docs documents by a seeded
hash, so that no window holds more than a shard, and quotients of shards are ranked by ranges, so that no task
holds a source, however large.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, the
last; repeated rows are documents of their own; sources without words have target 0; an empty table
gives no rows; the result depends on rows, seed and parameters only, not on partitions or their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectorium.llm._io import saved, table
from lectorium.llm._text import tokens

SHARE, CAP, WEIGHTS, BLOCK_WORDS, SHARD_DOCS, SEED = 1.5, 2.0, (5.0, 2.0, 1.0), 64, 512, "mix-1"


def targets(totals: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple = WEIGHTS) -> DataFrame:
    """totals(source, source_size, docs) with weight and target, one row per source.

    Sources are filled to a common level per weight; those whose cap lies below the level stop at it.
    In ascending order of cap / weight, the first k stop if the level that remains for the others is no
    higher than the next one's own; the smallest such k is taken.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = totals.withColumn("n", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    t = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("own", F.col("most") / F.col("weight"))
    asc = Window.orderBy("own", "n").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("own", "n").rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    t = t.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(asc), F.lit(0.0))) / F.sum("weight").over(rest))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("own"), F.struct("own", "n", "level"))).over(every)["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return t.select("source", "source_size", "docs", F.round(target, 6).alias("target"))


def _on(a: str, b: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def sainte_lague(parties: DataFrame, groups: list[str], key: list[str], votes: str, seats: str) -> DataFrame:
    """Give each group's seats to its parties by highest quotients; ties go to the party first by key.

    With n parties, votes V and S seats, a party with v votes surely gets the rounded v(S - n/2)/V seats
    and never more than the rounded v(S + n/2)/V. Only the quotients between are listed, about two for each
    party, and ranked in two steps: dealt by ranges of (group, quotient), numbered within a range, and moved by
    the group's quotients in the ranges before. So no task holds a whole group. Adds the column quota.
    """
    v, s = F.col(votes).cast("double"), F.col(seats).cast("double")
    sums = parties.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_v"))
    p = parties.alias("p").join(sums.alias("s"), _on("p", "s", groups)).select("p.*", "s._n", "s._v")
    part = lambda d: F.floor(F.coalesce(v * d / F.nullif(F.col("_v"), F.lit(0.0)), F.lit(0.0)) + 0.5)
    p = p.withColumn("_sure", F.greatest(F.lit(0), part(s - F.col("_n") / 2) - 1)).withColumn("_most", F.when(v > 0, part(s + F.col("_n") / 2) + 1).otherwise(0))
    p = saved(p, "parties")
    left = p.groupBy(*groups).agg((F.max(s) - F.sum("_sure")).alias("_left"))
    listed = p.select(*groups, *key, (v).alias("_votes"), F.explode(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_most") - 1)).otherwise(F.array().cast("array<bigint>"))).alias("_j"))
    listed = listed.withColumn("_q", F.col("_votes") / (2 * F.col("_j") + 1))
    order = [*[F.col(c) for c in groups], F.desc("_q"), *[F.col(c) for c in key]]
    dealt = saved(listed.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "quotients")
    near = Window.partitionBy("_part", *groups)
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0)))
    ranked = dealt.withColumn("_rank", F.row_number().over(near.orderBy(F.desc("_q"), *key)))
    ranked = ranked.alias("r").join(parts.alias("b"), _on("r", "b", ["_part", *groups])).select(*[F.col(f"r.{c}") for c in [*groups, *key]], (F.col("_rank") + F.col("_before")).alias("_rank"))
    won = ranked.alias("r").join(left.alias("l"), _on("r", "l", groups)).filter(F.col("_rank") <= F.col("_left"))
    won = won.groupBy(*[F.col(f"r.{c}") for c in [*groups, *key]]).agg(F.count(F.lit(1)).alias("_won"))
    return p.alias("p").join(won.alias("w"), _on("p", "w", [*groups, *key]), "left").select(*[F.col(f"p.{c}") for c in parties.columns], (F.col("p._sure") + F.coalesce(F.col("w._won"), F.lit(0))).alias("quota"))


def _seeded(seed: str, *columns) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]))


def _number(digest: Column) -> Column:
    """The first 8 hex digits as a long."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, keep: list[str], block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: str = SEED, share: float = SHARE, cap: float = CAP, weights: tuple = WEIGHTS) -> DataFrame:
    """docs(doc_id, source, size, and the columns of keep) with source_size, target and taken."""
    base = saved(docs.select("doc_id", "source", "size", *keep), "mix-sizes")
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    aimed = saved(targets(totals, share, cap, weights).withColumn("all", F.lit(1)), "mix-targets")
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")
    known = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    apportioned = sainte_lague(aimed.withColumn("seats", seats).withColumn("name", known), ["all"], ["name"], "target", "seats")
    sources = saved(
        apportioned.select("source", "name", "source_size", "target", F.col("quota").alias("source_quota"), F.ceil(F.col("docs") / shard_docs).alias("shards")), "mix-sources"
    )
    # A row per source; beyond Spark's own broadcast threshold it is a shuffled join that AQE may split.
    placed = base.withColumn("name", known).join(sources.drop("source"), "name")
    placed = placed.withColumn("order", _seeded(seed, "doc_id")).withColumn("shard", _number(_seeded(seed + "-shard", "doc_id")) % F.col("shards"))
    placed = saved(placed, "mix-placed")
    shards = placed.groupBy("name", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"))
    dealt = sainte_lague(shards, ["name"], ["shard"], "words", "source_quota")
    dealt = dealt.withColumn("take", F.least(F.col("quota") * block_words, (F.col("words") * F.lit(float(cap))).cast("long")))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("words") / block_words))
    dealt = dealt.withColumn("turns", F.when(F.col("words") > 0, F.floor(F.col("take") / F.col("words"))).otherwise(0))
    dealt = dealt.withColumn("run", F.col("take") - F.col("turns") * F.col("words")).withColumn("start", F.least(F.col("words"), _number(_seeded(seed + "-run", "name", "shard")) % blocks * block_words))
    plan = saved(dealt.select("name", "shard", "words", "turns", "run", "start"), "mix-shards")
    w = Window.partitionBy("name", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.withColumn("end", F.sum("size").over(w)).join(plan, ["name", "shard"])
    end, size, start, stop = F.col("end"), F.col("size"), F.col("start"), F.col("start") + F.col("run")
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(end, b) - F.greatest(end - size, a))
    taken = F.col("turns") * size + overlap(start, stop) + overlap(F.lit(0), stop - F.col("words"))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", *keep)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: what it takes of each."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").select("doc_id", "source", tokens(F.col("text")).alias("size"))
    return mix(docs, []).select("doc_id", "size", "source_size", "target", "taken")


#: The same definitions in SQL, with every quotient of every shard listed and ranked.
OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'null') AS name, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), t AS (
  SELECT source, name, sum(size)::BIGINT AS source_size, count(*) AS docs FROM d GROUP BY ALL
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight,
    row_number() OVER (ORDER BY source IS NULL, source) AS n FROM t
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY 2 * source_size / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY 2 * source_size / weight, n) AS pos FROM w
), a AS (
  SELECT source, name, source_size, ceil(docs / 512.0)::BIGINT AS shards,
    round(least(2.0::DOUBLE * source_size, coalesce((arg_min(level, pos) FILTER (WHERE level <= 2 * source_size / weight) OVER ()) * weight, 2.0::DOUBLE * source_size)), 6) AS target FROM l
), s AS (SELECT round(sum(target) / 64)::BIGINT AS seats FROM a),
q AS (
  SELECT name, count(*) AS quota FROM (
    SELECT name, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, name) AS r
    FROM (SELECT name, target, unnest(range((target / 64)::BIGINT + 3)) AS j FROM a WHERE target > 0)
  ), s WHERE r <= seats GROUP BY name
), p AS (
  SELECT d.doc_id, d.name, d.size, a.source_size, a.target, md5('mix-1|' || coalesce(d.doc_id::VARCHAR, 'null')) AS ord,
    ('0x' || substr(md5('mix-1-shard|' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % a.shards AS shard
  FROM d JOIN a ON a.name = d.name
), h AS (SELECT name, shard, sum(size)::BIGINT AS words FROM p GROUP BY name, shard),
hq AS (
  SELECT name, shard, count(*) AS quota FROM (
    SELECT v.name, v.shard, row_number() OVER (PARTITION BY v.name ORDER BY v.words / (2 * v.j + 1)::DOUBLE DESC, v.shard) AS r, q.quota AS seats
    FROM (SELECT name, shard, words, unnest(range((2 * words / 64)::BIGINT + 3)) AS j FROM h WHERE words > 0) v JOIN q ON q.name = v.name
  ) WHERE r <= seats GROUP BY name, shard
), k AS (
  SELECT h.name, h.shard, h.words, least(coalesce(hq.quota, 0) * 64, 2 * h.words)::BIGINT AS take,
    least(h.words, ('0x' || substr(md5('mix-1-run|' || h.name || '|' || h.shard), 1, 8))::BIGINT % greatest(1, ceil(h.words / 64.0)::BIGINT) * 64) AS start
  FROM h LEFT JOIN hq ON hq.name = h.name AND hq.shard = h.shard
), r AS (
  SELECT *, CASE WHEN words > 0 THEN take // words ELSE 0 END AS turns, take - CASE WHEN words > 0 THEN take // words ELSE 0 END * words AS run FROM k
), e AS (
  SELECT p.*, sum(size) OVER (PARTITION BY name, shard ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS fin FROM p
)
SELECT e.doc_id, e.size, e.source_size, e.target,
  (r.turns * e.size + greatest(0, least(e.fin, r.start + r.run) - greatest(e.fin - e.size, r.start)) + greatest(0, least(e.fin, r.start + r.run - r.words) - (e.fin - e.size)))::BIGINT AS taken
FROM e JOIN r ON r.name = e.name AND r.shard = e.shard
"""
