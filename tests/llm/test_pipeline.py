"""The pipeline's stages against brute force, and the registration of the queries."""

import random

import corpus_pipeline as cp
from lectorium.llm import oracle_sql, queries

from .conftest import PASSAGE
from .test_dedup import brute_components, family
from .test_text import labelled


def test_registered():
    names = list(queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(oracle_sql()) <= set(names)


def test_stages(spark, store, odd_documents):
    rng = random.Random(9)
    rows = odd_documents + labelled(200, rng) + [(5000 + i, t, "en", "a") for i, t in enumerate(family(rng, 60, 20, 2))]
    root = store(rows, [(1, PASSAGE)])
    docs = spark.read.parquet(f"{root}/documents.parquet")
    first = cp.language(spark, docs, root)
    kept = first.collect()
    assert first.columns == cp.COLUMNS
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(d) for d, *_ in rows if d not in (4, 5, 6, 7))
    second = cp.near_duplicates(spark, first, root)
    stay = {c for _, n, c in brute_components([(r.doc_id, r.text) for r in kept if r.doc_id is not None], 5, 80)}
    assert sorted(map(str, stay | {None})) == sorted(str(r.doc_id) for r in second.collect())
    third = cp.decontaminated(spark, second, root)
    assert {r.doc_id for r in third.collect()} == (stay | {None}) - {9}
    fourth = cp.mixed(spark, third, root)
    mixed = fourth.collect()
    assert fourth.columns == cp.COLUMNS and {r.doc_id for r in mixed} <= (stay | {None})
    last = cp.token_ids(spark, fourth, root).collect()
    assert sorted(str(r.doc_id) for r in last) == sorted(str(r.doc_id) for r in mixed)


def test_language_with_one_label(spark, store):
    """Of a corpus of one label only documents without letters go."""
    rows = [(i, f"the words of document number {i} are all plain English", "en", "a") for i in range(30)] + [(30, None, "en", "a"), (31, "12 34", "en", "a")]
    root = store(rows)
    got = cp.language(spark, spark.read.parquet(f"{root}/documents.parquet"), root).collect()
    assert sorted(r.doc_id for r in got) == list(range(30))


def test_rows_without_a_doc_id(spark, store):
    """Each is a document of its own in every stage: a group's numbered document stays for it, a hit row
    goes, a clean one comes through the mix."""
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(40))
    one, two, alone, other = text(), text(), text(), text()
    rows = [(7, one, "en", "a"), (5, one, "en", "a"), (None, one, "en", "a"), (9, two, "en", "a"), (None, two, "en", "a"), (None, alone, "en", "a"), (None, alone, "en", "a")]
    rows += [(None, f"{other} {PASSAGE}", "en", "a"), (11, f"{text()} {PASSAGE}", "en", "a")]
    root = store(rows, [(1, PASSAGE)])
    second = cp.near_duplicates(spark, spark.read.parquet(f"{root}/documents.parquet"), root)
    assert sorted((str(r.doc_id), r.text) for r in second.collect()) == sorted((str(d), t) for d, t, *_ in [rows[1], rows[3], rows[5], rows[7], rows[8]])
    third = cp.decontaminated(spark, second, root)
    clean = {(5, one), (9, two), (None, alone)}
    assert {(r.doc_id, r.text) for r in third.collect()} == clean and third.count() == 3
    fourth = cp.mixed(spark, third, root)
    assert {(r.doc_id, r.text) for r in fourth.collect()} == clean
    assert {r.doc_id for r in cp.token_ids(spark, fourth, root).collect()} == {5, 9, None}


def test_run_on_an_empty_table(spark, store):
    assert cp.run(spark, store([])).count() == 0
