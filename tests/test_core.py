"""Micro-fixtures and properties of the library's own operators."""

import datetime
import gzip
import io
import json
import os
import random
import shutil
import subprocess
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectorium.functions import text
from lectorium.functions.numeric import share_rounded
from lectorium.operators import catalog, cohort, collapse, consensus, evaluation, genres, graph, juries, pairwise, panels, ranking, signals, similarity, stats, taste
from lectorium.operators.models import fuzzy_pairs, ridge_out_of_fold
from lectorium.sources import readers
from lectorium.streaming import work_stats


def col(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_collapse_takes_the_best_edition(spark):
    rows = [(1, 10, 100, 3, 5, True), (1, 10, 101, 5, 9, False), (2, 10, 100, 1, 2, True), (2, 11, 110, 0, 1, False)]
    inter = spark.createDataFrame(rows, "user_id long, work_id long, book_id long, rating int, added_at long, is_read boolean")
    once = collapse.collapse_ratings(inter)
    assert sorted(map(tuple, once.collect())) == [(1, 10, 5), (2, 10, 1)]
    assert sorted(map(tuple, collapse.collapse_ratings(once).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, collapse.collapse_observations(inter).collect())) == [(1, 10, True, 5, 2), (2, 10, True, 1, 1), (2, 11, False, 0, 1)]


def test_picky_weight_bounds(spark):
    rows = [(u, w, 5 if u == 1 or (u == 2 and w < 1) else 3) for u in range(4) for w in range(8 if u != 3 else 3)]
    ratings = spark.createDataFrame(rows, "user_id long, work_id long, rating int")
    p = stats.user_pickiness(ratings)
    assert {r.user_id: r.five_rate for r in p.collect()} == {0: 0.0, 1: 1.0, 2: 0.125}
    works = spark.createDataFrame([(w, False) for w in range(8)], "work_id long, is_sf boolean")
    got = {r.user_id: r.picky_weight for r in stats.rating_events(ratings, p, works).collect()}
    assert got == {0: 0.25, 1: 0.25, 2: 1.0}  # without fives the floor holds


def test_percentiles_are_monotone_and_choose_the_scale(spark):
    hist = spark.createDataFrame([(1, 20, 3.0, 5, 4, 4, 4, 4, 4, 5), (2, 19, 3.0, 5, 19, 0, 0, 0, 0, 1), (3, 40, 3.0, 5, 0, 0, 20, 0, 20, 2)], "user_id long, n_rated long, mean_rating double, max_star int, c1 long, c2 long, c3 long, c4 long, c5 long, n_levels long")
    lit = hist.filter("user_id = 3").withColumns({"n_rated": F.lit(20), "c3": F.lit(0), "c5": F.lit(20)})
    got = {r.user_id: r for r in stats.user_percentiles(hist, lit).collect()}
    assert set(got) == {1, 3} and got[1].source == "full" and got[3].source == "lit"
    assert [got[1][f"pct_{k}"] for k in range(1, 6)] == pytest.approx([0.1, 0.3, 0.5, 0.7, 0.9]) and got[3].pct_5 == 0.5


def test_decimal_rounding(spark):
    assert [col(spark, n, lambda x: share_rounded(x, 350), "long") for n in (10, 9, 1, 0)] == [4, 3, 0, 0]


def test_elite_and_deweight_ends(spark):
    c = spark.createDataFrame([(u, float(u), u / 999) for u in range(1000)], "user_id long, weight double, weight_pctile double")
    assert taste.elite(c, 0).count() == 1000 and taste.elite(c, 100).count() == 100 and 100 < taste.elite(c, 50).count() < 1000
    assert {r[0] for r in c.select(taste.deweight(0)).collect()} == {1.0}


def test_47_methods_rank_in_total_order(spark):
    assert len(ranking.METHODS) == 47
    e = spark.createDataFrame([(w, u, 1 + (w * u) % 5, 9, 0.2, 1.0, False) for w in range(6) for u in range(30)], "work_id long, user_id long, rating int, n_rated long, five_rate double, picky_weight double, is_sf boolean")
    works = spark.createDataFrame([(w, True) for w in range(6)], "work_id long, is_sf boolean")
    inputs = ranking.Inputs(e, stats.priors(stats.work_stats(e), works))
    got = ranking.rank("five_rate_bayes", inputs).collect()
    assert got == sorted(got, key=lambda r: (-r.score, -r.n, r.work_id)) and len(got) == 6
    few = ranking.rank("five_count", ranking.Inputs(e, inputs.priors, works=works.filter("work_id < 2"))).collect()
    assert {r.work_id for r in few} == {0, 1}


def test_coverage_ends(spark):
    e = spark.createDataFrame([(w, u, 5 if (w + u) % 3 else 2, 9, 0.2, 1.0, False) for w in range(4) for u in range(20)], "work_id long, user_id long, rating int, n_rated long, five_rate double, picky_weight double, is_sf boolean")
    pct = spark.createDataFrame([(u, 0.1, 0.3, 0.5, 0.7, 0.9) for u in range(20)], "user_id long, pct_1 double, pct_2 double, pct_3 double, pct_4 double, pct_5 double")
    cohort = spark.createDataFrame([(u, 1.0, 0.5) for u in range(20)], "user_id long, weight double, weight_pctile double")
    priors = spark.createDataFrame([(0.3, 3.5)], "p5_all double, mean_all double")
    x = ranking.Inputs(e, priors, cohorts={"pct": cohort}, percentiles=pct)
    ends = [{r.work_id: r.score for r in ranking.rank("curator_pct_top", x, ranking.Params(coverage=u)).collect()} for u in (0.0, 1.0)]
    assert ends[0] == ends[1]  # every reader of the cohort has rated every work


def test_similarity_is_symmetric_and_bounded(spark):
    e = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 5), (2, 1, 5), (2, 2, 5), (3, 3, 4), (4, 9, 5)], "work_id long, user_id long, rating int")
    cohort = e.select("user_id").distinct().withColumn("w", F.lit(1.0))
    s = e.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))
    one = similarity.similar_works(e, cohort, s, 1, "jaccard").collect()
    other = similarity.similar_works(e, cohort, s, 2, "jaccard").collect()
    assert [(r.work_id, r.score) for r in one] == [(2, round(2 / 3, 6))] and other[0].score == one[0].score


def test_text_functions(spark):
    assert col(spark, "  Łódź – Gabriel GARCÍA Márquez, ß! ", text.fold) == "lodz gabriel garcia marquez ss"
    assert col(spark, "The Lord & Lady (Saga, #2): Part [x]", text.normalize_title) == "lord and lady saga 2 part x"
    assert [col(spark, t, text.normalize_title) for t in ("An Ｏffice #3", "Book (2)", "X (S, #1)", "X (S, #2)", "", None)] == ["office", "book", "x s 1", "x s 2", "", None]
    assert col(spark, "X (S, #1)", text.core_title) == "x" and col(spark, "Война и мир 2", text.fold) == "2"
    assert [col(spark, v, text.int_like) for v in ("1965.0", " 12 ", "x", "")] == [1965, 12, None, None]
    assert [col(spark, v, text.weekday_timestamp) for v in ("Tue Mar 05 10:11:12 -0800 2013", "", "nonsense")] == [1362507072, None, None]
    assert [col(spark, v, text.year_in_text) for v in ("May 1st 1999", "1499", "2031", None)] == [1999, None, None, None]
    assert col(spark, "https://x/author/show/17.Name", text.author_in_url) == "17" and col(spark, "/book/show/9-t", text.id_in_url) == "9"
    name, number = text.series_of(F.lit("A Tale (Saga, #2.5)"))
    assert tuple(spark.range(1).select(name, number).first()) == ("Saga", 2.5)


def test_flags_and_clusters(spark):
    rows = [(1, 1, "The Book", 2000), (2, 1, "Book", 1990), (3, 1, "Book (Box Set)", 1980), (4, 2, "The Book", 1970), (5, 1, "Book / Other Tale", 2005), (6, 1, "Other Tale", 1960), (7, 3, "11/22/63", 2011), (8, 3, None, None)]
    works = catalog.title_flags(spark.createDataFrame(rows, "work_id long, author_id long, title string, pub_year int"))
    flags = {r.work_id: r.is_collection for r in works.collect()}
    assert flags[3] and not any(flags[k] for k in (1, 2, 4, 5, 6, 7, 8))
    s = spark.createDataFrame([(k, 10 * k) for k in range(1, 9)], "work_id long, n long")
    clusters = {r.work_id: (r.canonical_id, r.size) for r in catalog.duplicate_clusters(works, s).collect()}
    assert clusters[1] == clusters[2] == (2, 2) and clusters[4] == (4, 1) and clusters[3] == (3, 1)  # the box set has a title of its own
    spoken = works.withColumn("language_code", F.when(F.col("work_id") == 2, "de").otherwise("en"))
    assert {r.work_id: r.size for r in catalog.duplicate_clusters(spoken, s).collect()}[1] == 1
    mixed = works.withColumn("is_collection", F.col("work_id") == 2)
    assert {r.work_id: r.size for r in catalog.duplicate_clusters(mixed, s).collect()}[1] == 1
    assert [(r.work_id, r.parts, r.first_year) for r in catalog.slash_omnibus(works, s).collect()] == [(5, 2, 1960)]


def test_omnibus_with_the_id_of_a_sibling(spark):
    """The ids of omnibus volumes may be those of works: the most rated sibling counts whatever its id."""
    rows = [(5, 1, "Book / Other Tale", 2005), (5, 1, "Book", 1950), (6, 1, "Other Tale", 1960), (7, 1, "Book", 1940)]
    works = spark.createDataFrame(rows, "work_id long, author_id long, title string, pub_year int")
    s = spark.createDataFrame([(5, 30), (6, 20), (7, 10)], "work_id long, n long")
    assert [(r.work_id, r.parts, r.first_year) for r in catalog.slash_omnibus(works, s).collect()] == [(5, 2, 1950)]


def test_title_rules(spark):
    """Hand-picked titles: a bare trilogy or companion volume is none, ranges and sets are."""
    titles = {"Saga Trilogy": 0, "Saga (Saga, #1)": 0, "The Collection": 0, "Saga Trilogy Box Set": 1, "Saga #1-3": 1, "Two Novels": 1, "Best of the Year: Tales": 1, "The Complete Saga": 1, "A Collected Life": 0, "Uncollected Stories": 1}
    got = {r.title: r.is_collection for r in catalog.title_flags(spark.createDataFrame([(t,) for t in titles], "title string")).collect()}
    assert {t: int(v) for t, v in got.items()} == titles
    derived = {"A Companion to Saga": True, "A Companion to Saga (Saga, #2)": False, "Saga: The Screenplay (Saga, #2)": True, "The Art of War": False, "The Art of the Movie": True}
    assert {r.title: r.is_derivative for r in catalog.title_flags(spark.createDataFrame([(t,) for t in derived], "title string")).collect()} == derived


def test_shelf_rules(spark):
    w = spark.createDataFrame([(1, "Some Tales"), (2, "One"), (3, "One"), (4, "Big"), (5, None)], "work_id long, title string")
    c = spark.createDataFrame([(1, "short-stories", 50), (2, "short-stories", 200), (3, "short-stories", 200), (4, "Omnibus", 60), (4, "fiction", 100), (5, "picture-books", 45), (5, "manga", 9)], "work_id long, shelf string, count long")
    pages = spark.createDataFrame([(3, 300), (5, 32)], "work_id long, num_pages int")
    got = {r.work_id: r for r in catalog.shelf_flags(w, catalog.shelf_counts(c), pages).collect()}
    assert [got[k].is_collection for k in (1, 2, 3, 4, 5)] == [True, False, True, True, False]
    assert got[5].is_picture_book and not got[5].is_comic and not got[1].is_picture_book


def test_series_inheritance(spark):
    works = spark.createDataFrame([(k, 1, f"T{k} (Saga, #{k})") for k in range(1, 4)], "work_id long, author_id long, title string")
    gated = spark.createDataFrame([(1, "g", False, 1.0, 0.1, 20.0, 500), (2, "g", True, 9.0, 0.9, 90.0, 500), (3, "g", True, 9.0, 0.9, 90.0, 500)], "work_id long, gate string, passed boolean, score double, ratio double, core double, n long")
    assert all(r.passed for r in genres.inherit_series(gated, works, 10).collect())
    assert not {r.work_id: r.passed for r in genres.inherit_series(gated, works, 30).collect()}[1]


def test_votes_and_esteem(spark):
    e = spark.createDataFrame([(1, w, 5) for w in range(13)] + [(1, 50 + w, 1) for w in range(14)] + [(2, 1, 5), (2, 2, 4)], "user_id long, work_id long, rating int")
    votes = pairwise.balanced_votes(e)
    assert votes.count() == 24 and votes.filter("user_id = 2").count() == 0
    mass = pairwise.expected_votes(e).groupBy("side").agg(F.sum("mass").alias("m")).collect()
    assert [round(r.m, 9) for r in mass] == [12, 12]
    totals = pairwise.esteem(votes).agg(F.sum("wins"), F.sum("losses")).first()
    assert tuple(totals) == (144, 144)


def test_consensus_and_reweighting(spark):
    cells = spark.createDataFrame([(1, 0, c, 8.0, 2.0) for c in range(4)] + [(2, 0, 0, 8.0, 2.0), (2, 0, 1, 1.0, 9.0)], "work_id long, partition int, community int, high double, low double")
    sizes = spark.createDataFrame([(0, 4)], "partition int, k int")
    got = {r.work_id: r for r in consensus.conditional_esteem(cells, sizes, least_total=20.0).collect()}
    # Four alike cells of 8 to 2 with a prior of 2 to 2: mean 10 / 14, variance 10 * 4 / (14 * 14 * 15).
    assert got[1].valid and (got[1].mu, got[1].tau, got[1].coverage) == (pytest.approx(10 / 14), 0, 1.0) and got[1].se == pytest.approx((40 / 2940 / 4) ** 0.5)
    assert not got[2].valid and got[2].score is None and got[2].observed == 2
    bound = consensus.conditional_esteem(cells, sizes, least_total=20.0, gamma=2.0).filter("work_id = 1").first()
    assert bound.mu == pytest.approx((10 / 14 / 2) / (10 / 14 / 2 + 4 / 14))  # the odds are halved
    capped = consensus.posterior(spark.createDataFrame([(1, 0, 0, 90.0, 30.0)], cells.schema)).first()
    assert capped.p == pytest.approx((22.5 + 2) / 34)
    values = spark.createDataFrame([(1, 0, c, p) for c, p in enumerate((0.2, 0.9, 0.4))], "work_id long, partition int, community int, p double")
    assert consensus.worst_reweighting(values, 2.0).first().worst == pytest.approx(min((2 * 0.2 + 1.3) / 4, (2 * 0.6 + 0.9) / 5))
    assert consensus.worst_reweighting(values, 1.0).first().worst == pytest.approx(0.5)
    assert consensus.conditional_esteem(cells.limit(0), sizes).count() == consensus.worst_reweighting(values.limit(0)).count() == 0


def test_combined_partitions(spark):
    rows = [(1, p, s, s, 0.0, 0.1, 0.6) for p, s in enumerate((0.5, 0.7, None))] + [(2, p, s, s, 0.0, 0.1, 0.2) for p, s in enumerate((0.5, 0.6, 0.7))] + [(3, 0, 0.5, 0.5, 0.0, 0.1, 1.0)]
    got = {r.work_id: r for r in consensus.combine_partitions(spark.createDataFrame(rows, "work_id long, partition int, score double, mu double, tau double, se double, coverage double"), 3).collect()}
    assert set(got) == {1, 2} and got[1].eligible and not got[2].eligible
    assert got[1].score == pytest.approx(0.6) and got[1].sd == pytest.approx(0.02**0.5) and got[1].uncertainty == pytest.approx(0.03**0.5)


def test_tier_rule(spark):
    base = {"pair_mass": 25, "joint_rate": 0.9, "ranks": [1, 200], "membership_ranks": [5], "feature_ranks": [7], "boundary_rank": 9, "fixed_rate": 0.9, "community_status": "broadly_stable", "gamma2_score": 50.0}
    cases = [({}, "stable_core"), ({"pair_mass": 19}, "supported_boundary"), ({"joint_rate": 0.5, "fixed_rate": 0.5}, "supported_boundary"), ({"ranks": [1, None]}, "underexposed_or_contested"), ({"membership_ranks": []}, "underexposed_or_contested"), ({"gamma2_score": 49.9}, "underexposed_or_contested"), ({"boundary_rank": None}, "underexposed_or_contested")]
    schema = "pair_mass int, joint_rate double, ranks array<int>, membership_ranks array<int>, feature_ranks array<int>, boundary_rank int, fixed_rate double, community_status string, gamma2_score double"
    rows = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], schema).withColumn("tier", consensus.tier({k: F.col(k) for k in base}))
    assert [r.tier for r in rows.collect()] == [t for _, t in cases]


def test_ranks_without_one_task(spark):
    from lectorium.functions import ranks

    rng = np.random.default_rng(3)
    values = [int(x) for x in rng.integers(0, 40, 300)]
    df = spark.createDataFrame(list(enumerate(values)), "user_id long, v long")
    order = sorted(range(300), key=lambda i: (values[i], i))
    assert {r.user_id: r["rank"] for r in ranks.numbered(df, [F.col("v"), F.col("user_id")]).collect()} == {i: k + 1 for k, i in enumerate(order)}
    assert {r.user_id: round(r.p, 9) for r in ranks.percent_rank(df, "v", "p").collect()} == {i: round(sum(x < values[i] for x in values) / 299, 9) for i in range(300)}
    sizes = {r.t: r["count"] for r in ranks.ntile(df, [F.col("v"), F.col("user_id")], 7, "t").groupBy("t").count().collect()}
    assert sizes == {k: 43 if k <= 6 else 42 for k in range(1, 8)}
    assert ranks.numbered(df.limit(0), [F.col("v")]).count() == ranks.percent_rank(df.limit(0), "v", "p").count() == ranks.ntile(df.limit(0), [F.col("v")], 3, "t").count() == 0


def test_poisson_weights(spark):
    k = spark.range(20_000).select(consensus.poisson_weight("t", F.col("id")).alias("k")).agg(F.avg("k"), F.var_pop("k"), F.min("k")).first()
    assert abs(k[0] - 1) < 0.03 and abs(k[1] - 1) < 0.05 and k[2] == 0


def test_agreement_of_rankings(spark):
    a = spark.createDataFrame([(i, i + 1) for i in range(10)], "work_id long, rank int")
    b = spark.createDataFrame([(100 + i, i + 1) for i in range(10)], "work_id long, rank int")
    assert evaluation.rank_biased_overlap(a, a).first().rbo == pytest.approx(1) and evaluation.rank_biased_overlap(a, b).first().rbo == pytest.approx(0)
    assert evaluation.overlap_at(a, b, [5]).first().jaccard == 0 and evaluation.spearman(a, a).first().rho == 1
    scored = spark.createDataFrame([(1, 0.9, True), (2, 0.8, False), (3, 0.8, True), (4, 0.1, False)], "id long, score double, positive boolean")
    r = evaluation.average_precision(scored).first()
    assert (r.auc, r.average_precision) == (pytest.approx(0.875), pytest.approx((1 + 2 / 3) / 2))


def test_label_propagation_splits_two_cliques(spark):
    near = [(a, b, 1.0) for g in (range(4), range(10, 14)) for a in g for b in g if a != b]
    got = {r.work_id: r.label for r in graph.label_propagation(spark.createDataFrame(near, "work_id long, near long, pmi double"), 6).collect()}
    assert len({got[k] for k in range(4)}) == 1 and len(set(got.values())) == 2


def test_readers(spark, tmp_path):
    book = {"book_id": " 7 ", "work_id": "3", "title": "T", "authors": [{"author_id": "9", "role": ""}], "ratings_count": "12.0", "url": "", "popular_shelves": [{"name": "To-Read", "count": "5"}, {"name": "sf", "count": "x"}]}
    with gzip.open(tmp_path / "books.json.gz", "wt") as f:
        f.write(json.dumps(book) + "\nnot json\n")
    b = readers.books(spark, str(tmp_path / "books.json.gz")).collect()
    assert [(r.book_id, r.author_id, r.ratings_count, r.url) for r in b] == [("7", "9", 12, "/book/show/7")]
    assert sorted((r.shelf, r["count"], r.is_status) for r in readers.shelves(spark, str(tmp_path / "books.json.gz")).collect()) == [("sf", 0, False), ("to-read", 5, True)]
    (tmp_path / "i.csv").write_text("user_id,book_id,is_read,rating,is_reviewed\n1,2,1,5,0\n1,3,1,0,0\n")
    (tmp_path / "m.csv").write_text("book_id_csv,book_id\n2,b2\n3,b3\n")
    assert [tuple(r) for r in readers.interactions(spark, str(tmp_path / "i.csv"), str(tmp_path / "m.csv")).collect()] == [(1, "b2", 5, True, False)]
    (tmp_path / "poll.txt").write_text("Some - Title - An Author\n\nOther — Person\n")
    assert [tuple(r) for r in readers.poll_lines(spark, str(tmp_path / "poll.txt")).collect()] == [(1, "Some - Title", "An Author"), (3, "Other", "Person")]
    out = str(tmp_path / "out")
    for n in (3, 5):
        readers.write_swapped(spark.range(n), out)
        assert spark.read.parquet(out).count() == n
    assert list(readers.query_tsv(spark, "SELECT 1 AS a, cast(NULL AS int) AS b")) == ["a\tb", "1\t"]


def test_streaming_counts_each_rating_once(spark, tmp_path):
    rows = [(w, 1 + (w + k) % 5) for w in range(5) for k in range(8)]
    schema = "work_id long, rating int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(work_stats.sink(str(tmp_path / "sums"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.work_id: (r.n, round(r.mean, 6), round(r.std, 6)) for r in work_stats.current_stats(spark, str(tmp_path / "sums")).collect()}
    want = spark.createDataFrame(rows, schema).groupBy("work_id").agg(F.count(F.lit(1)), F.avg("rating"), F.stddev_pop("rating")).collect()
    assert got == {r[0]: (r[1], round(r[2], 6), round(r[3], 6)) for r in want}


def test_fuzzy_pairs_of_one_table(spark):
    rows = [(1, 7, "abcd"), (2, 7, "abce"), (3, 7, "xyzw"), (4, 8, "abcd"), (1500, 7, "abcd")]
    w = spark.createDataFrame(rows, "id long, author_id long, title string")
    assert {tuple(r) for r in fuzzy_pairs(w, w, "author_id", "title", 1, others=True).collect()} == {(1, 1500, 0), (2, 1, 1), (1500, 1, 0)}


def test_fuzzy_pairs_of_many_copies(spark):
    """60,000 titles of one author, of which 201 differ: pairs of rows would be 3.6 billion, and take minutes."""
    w = spark.range(60_001).select("id", F.lit(7).alias("author_id"), F.when(F.col("id") < 60_000, F.concat(F.lit("red "), (F.col("id") % 200 + 100).cast("string"))).otherwise("red 299x").alias("title"))
    began = time.monotonic()
    got = {r.l: (r.r, r.d) for r in fuzzy_pairs(w, w, "author_id", "title", 1, others=True).collect()}
    assert time.monotonic() - began < 60
    assert got == {i: (i % 200 if i >= 200 else i + 200, 0) for i in range(60_000)} | {60_000: (199, 1)}


def test_fuzzy_pairs_against_all_pairs(spark):
    """Repeated and null ids, blocks and texts, of one table and of two."""
    draw = random.Random(3)

    def rows(n):
        return [(draw.choice([None, *range(40)]), draw.choice([None, 1, 2]), draw.choice([None, *("".join(draw.choices("abé", k=k)) for k in range(7))])) for _ in range(n)]

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    one, two = rows(60), rows(60)
    for right, others in ((one, True), (two, False)):
        best = {}
        for i, a, s in one:
            for k, b, t in right:
                if None in (a, b, s, t) or a != b or (others and (None in (i, k) or i == k)) or distance(s, t) > 2:
                    continue
                best[i] = min(best.get(i, (9, -1)), (distance(s, t), -1 if k is None else k))
        frames = [spark.createDataFrame(x, "id long, author_id long, title string") for x in (one, right)]
        got = fuzzy_pairs(*frames, "author_id", "title", 2, others=others).collect()
        assert {r.l: (r.d, -1 if r.r is None else r.r) for r in got} == best and len(got) == len(best)


def test_whole_table_queries_see_every_work(spark, tmp_path):
    """300 works: those of ids from 200 on are in the bootstrap, from 100 on in the histogram, and works on
    both sides of 1000 have their nearest title."""
    from lectorium.plans import registry

    q, d = registry.queries(), str(tmp_path)
    ids = [*range(150), *range(950, 1100)]
    spark.createDataFrame([(i, i % 20) for i in range(400)], "o_orderkey long, o_custkey long").withColumn("o_orderdate", F.lit("1996-01-01").cast("timestamp")).write.parquet(f"{d}/orders.parquet")
    d0 = datetime.datetime(1996, 1, 1)
    lines = [((i + i // 300) % 400, ids[i % 300], 1, float(i * i % 47), i % 11, "N") for i in range(3000)]
    spark.createDataFrame([(*x, d0) for x in lines], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_suppkey long, l_returnflag string, l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(i, "red tin", "ECONOMY", 1, "B") for i in ids], "p_partkey long, p_name string, p_type string, p_size int, p_brand string").write.parquet(f"{d}/part.parquet")
    voted = {r.work_id for r in q["expected_votes"](spark, d).select("work_id").distinct().collect()}
    # A work drawn in no replicate has no row; with 200 replicates over 20 readers nearly all have one.
    got = {r.work_id for r in q["reader_bootstrap"](spark, d).collect()}
    assert got <= voted and max(got) >= 950 and len(got) > 0.95 * len(voted)
    assert {r.l for r in q["fuzzy_titles"](spark, d).collect()} == set(ids)
    assert sum(r.mass for r in q["weighted_star_histogram"](spark, d).collect()) > 0


def test_full_rounds_against_brute_force(spark):
    """The iterations of the registered queries, with their full rounds, on a small graph."""
    from lectorium.plans import registry, research

    assert research.ROUNDS == {"hits": 8, "reflections": 16, "core": 3, "labels": 15, "attractor": 20, "power": 12}
    assert {"hits_authority", "method_of_reflections", "bipartite_core", "label_propagation", "jury_attractor"} <= set(registry.queries())
    cells = [(u, w) for u in range(12) for w in range(9) if (u * 5 + w * w) % 4]
    a = np.zeros((12, 9))
    for u, w in cells:
        a[u, w] = 1 / (1 + w)
    hub = np.ones(12)
    for _ in range(8):
        work = a.T @ hub / np.linalg.norm(a.T @ hub)
        hub = a @ work / np.linalg.norm(a @ work)
    got = graph.hits(spark.createDataFrame([(u, w, float(a[u, w])) for u, w in cells], "user_id long, work_id long, w double"), research.ROUNDS["hits"]).collect()
    assert {r.work_id: round(r.authority, 6) for r in got} == {w: round(float(x), 6) for w, x in enumerate(work)}


def test_swaps_survive_a_crash(spark, tmp_path):
    """Whatever a broken-off swap leaves, the old or the new table is there."""
    out = str(tmp_path / "t")
    readers.write_swapped(spark.range(3), out)
    os.rename(out, f"{out}.old")  # between the two renames
    assert spark.read.parquet(readers.recovered_table(spark, out)).count() == 3
    readers.write_swapped(spark.range(5), out, row_group_bytes=1 << 20)
    shutil.copytree(out, f"{out}.old")  # before the last delete
    assert spark.read.parquet(readers.recovered_table(spark, out)).count() == 5 and not os.path.exists(f"{out}.old")
    readers.save_checkpoint(spark.range(4), str(tmp_path / "c"), "run-1")
    assert readers.load_checkpoint(spark, str(tmp_path / "c"), "run-1").count() == 4
    assert readers.load_checkpoint(spark, str(tmp_path / "c"), "run-2") is None and readers.load_checkpoint(spark, str(tmp_path / "no"), "x") is None
    assert readers.larger_of(spark, out, "full", 1) == out and readers.larger_of(spark, out, "full", 1 << 40) == "full"


def test_command_line(spark, tmp_path):
    from lectorium.__main__ import main

    (tmp_path / "b.json").write_text(json.dumps({"book_id": "7", "work_id": "3", "title": "T", "popular_shelves": [{"name": "sf", "count": "9"}]}) + "\n")
    assert main(["build", "--books", str(tmp_path / "b.json"), "--out", str(tmp_path / "db")], spark) == 0
    readers.insert_rows(spark, str(tmp_path / "db" / "lists.parquet"), [(1, None)], "a int, b string")
    got = io.StringIO()
    assert main(["query", "--tables", str(tmp_path / "db"), "SELECT b.title, s.shelf, l.b FROM books b JOIN book_shelves s USING (book_id) JOIN lists l ON l.a = 1"], spark, got) == 0
    assert got.getvalue() == "title\tshelf\tb\nT\tsf\t\n" and main(["run", "nothing", "--tables", "x", "--out", "y"], spark) == 2
    assert readers.attach(spark, str(tmp_path / "db"), "ext_") == ["ext_book_shelves", "ext_books", "ext_lists"]


def test_packs():
    p = cohort.Pack(positive=[2, "1", None, " "], negative=["9"], neutral=[" A ", "", "A", "B"])
    assert p.positive == ("1", "2") and p.neutral == ("A", "B") and p.key() == cohort.Pack(["1", 2], [9], ["B", "A"]).key()
    q = p.updated(positive=["1"])
    assert q.is_safe_subset(p) and not p.updated(positive=["5"]).is_safe_subset(p) and not p.updated(negative=[]).is_safe_subset(p) and q.negative == p.negative
    with pytest.raises(ValueError):
        p.updated(authors=[])
    assert not cohort.stored_suffice(0) and not cohort.stored_suffice(50) and cohort.stored_suffice(90) and not cohort.stored_suffice(90, default_pack=False)
    assert cohort.com_cap(0) is None and cohort.com_cap(100) == pytest.approx(0.08) and cohort.slider(-5) == 0 and cohort.slider(500) == 1


def test_signals(spark):
    authors = spark.createDataFrame([(1, "Fyodor D.", 100), (2, "Fyodor D", 900), (3, "Ann Lee Poe", 5), (4, "Bob Ray", 1), (5, "Bob Ray Two", 1), (6, "Bob Ray Three", 1), (7, None, 9)], "author_id long, name string, ratings_count long")
    names = spark.createDataFrame([("FYODOR D, Jr.",), ("Ann Lee",), ("Bob",), ("Nobody",), ("",), (None,)], "match string")
    assert {r.match: r.author_id for r in signals.resolve_authors(names, authors).collect()} == {"FYODOR D, Jr.": 2, "Ann Lee": 3}
    chart = spark.createDataFrame([(1, "Fyodor D"), (2, "Ann Lee Poe"), (3, "Fyodor D")], "rank int, author string")
    got = {r.match: (r.poll_rank, r.prestige) for r in signals.poll_prestige(chart, spark.createDataFrame([("fyodor d",), ("Lee Poe",), ("Who",)], "match string")).collect()}
    assert got == {"fyodor d": (1, 1.0), "Lee Poe": (2, 0.75), "Who": (None, 0.75)}
    works = spark.createDataFrame([(4934, 1), (7, 4934), (8, 2)], "work_id long, book_id long")
    keys = spark.createDataFrame([("4934",), ("8",), ("x",), (None,)], "key string")
    assert {r.key: r.work_id for r in signals.resolve_ids(keys, works).collect()} == {"4934": "7", "8": "8"}


def test_jury_rankings_by_hand(spark):
    e = spark.createDataFrame([(u, w, 5 if (u + w) % 3 else 2) for u in range(12) for w in range(6)] + [(None, 1, 5)], "user_id long, work_id long, rating int")
    w = juries.work_rarity(e.filter("user_id IS NOT NULL"), 1)
    one = juries.jury_p5(e, spark.createDataFrame([(1,), (2,), (3,)], "user_id long"), w, m=3, p0=0.5, least_n=1, least_votes=2)
    assert {r.work_id: r.score for r in one.collect()} == {k: pytest.approx((sum((u + k) % 3 > 0 for u in (1, 2, 3)) + 1.5) / 6) for k in range(6)}
    u = juries.reader_features(e.filter("user_id IS NOT NULL"), w, least=1, least_liked=1, midpop=1, popular=99)
    assert u.count() == 12 and u.first().depth_ge4 == pytest.approx(1 / np.log(13)) and u.first().n_ge4_popular == 0
    assert juries.beyond(u, "five_rate", 0.5).count() + juries.beyond(u.limit(0), "five_rate", 0.5).count() >= 6
    assert juries.reader_features(e.limit(0), w).count() == juries.audience_depth(e.limit(0), u, w).count() == 0


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(8)
    x, fold = rng.normal(size=(60, 2)), np.arange(60) % 5
    y = x @ [1.5, -2.0] + 0.3 + rng.normal(size=60) / 10
    rows = [(i, int(fold[i]), float(x[i, 0]), None if i == 7 else float(x[i, 1]), float(y[i])) for i in range(60)]
    got = {r.user_id: r.predicted for r in ridge_out_of_fold(spark.createDataFrame(rows, "user_id long, fold int, a double, b double, y double"), ["a", "b"], "y").collect()}
    known = np.arange(60) != 7
    mean, sd = np.array([x[:, 0].mean(), x[known, 1].mean()]), np.array([x[:, 0].std(), x[known, 1].std()])
    z = (x - mean) / sd
    z[7, 1] = 0
    for f in range(5):
        out = fold != f
        w = np.linalg.solve(z[out].T @ z[out] + np.eye(2), z[out].T @ (y[out] - y.mean()))
        assert [got[i] for i in np.flatnonzero(~out)] == pytest.approx(list(z[~out] @ w + y.mean()))


def test_registered_queries_have_oracles():
    from lectorium.plans import registry

    without = {"ridge_out_of_fold", "spectral_embedding", "spherical_clusters"}
    assert set(registry.queries()) - without == set(registry.oracle_sql()) and len(registry.queries()) > 140


def test_labels_exclude_each_other(spark):
    seeds = spark.createDataFrame([(w, "classic" if w < 10 else "anti" if w < 30 else "normie") for w in range(40)], "work_id long, kind string")
    rows = [(1, w, 5) for w in range(6)] + [(1, w, 5) for w in range(30, 36)] + [(2, w, 5) for w in range(10, 21)] + [(3, w, 5) for w in range(30, 35)] + [(4, w, 4) for w in range(10)] + [(5, 10 + w, 5) for w in range(10)] + [(5, 30 + w, 5) for w in range(10)]
    got = {r.user_id: r.label for r in panels.hit_labels(spark.createDataFrame(rows, "user_id long, work_id long, rating int"), seeds).collect()}
    assert got == {1: "classic", 2: "anti", 3: "normie", 5: "anti"}


def test_universes_by_hand(spark):
    universes = spark.createDataFrame([("b", "equal"), ("l", "leave_one_out"), ("c", "community")], "universe string, kind string")
    ranks = spark.createDataFrame([("b", 1, 10), ("l", 1, 250), ("c", 1, 5), ("b", 2, 20), ("c", 3, 1)], "universe string, work_id long, rank int")
    got = {r.work_id: r for r in panels.universe_summaries(ranks, universes, "b", last=500).collect()}
    assert (got[1].median_rank, got[1].max_loo_drop, got[1].top200_rate, got[1].community_top200_rate) == (130.0, 240.0, 0.5, 1.0)
    assert got[2].max_loo_drop == 481.0 and got[3].baseline_rank is None and got[3].max_loo_drop is None
    hhi = spark.createDataFrame([(1, 0.1), (2, 0.1)], "work_id long, hhi double")
    assert {r["class"] for r in panels.distributed_core(panels.universe_summaries(ranks, universes, "b"), hhi, stable=0.5).collect()} == {"community_dependent"}
    kinds = spark.createDataFrame([("b", "jury"), ("l", "pair"), ("c", "gamma")], "universe string, kind string")
    scores = spark.createDataFrame([(1, g, 80.0 / g) for g in (1.0, 1.5, 2.0)] + [(2, 1.0, 60.0)], "work_id long, gamma double, score double")
    m = {r.work_id: r for r in panels.multiverse(ranks, kinds, scores, [1.0, 1.5, 2.0], "b").collect()}
    assert m[1].critical_gamma == 2.0 and m[1].classes == "pair_sensitive" and m[2].critical_gamma == 1.5 and m[2].classes == "selection_sensitive,pair_evidence_sensitive"
    assert panels.universe_summaries(ranks.limit(0), universes, "b").count() == panels.multiverse(ranks.limit(0), kinds, scores, [1.0], "b").count() == 0


def test_imports_without_a_session():
    """The driver imports the entry before it starts Spark."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 150"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
