"""Licence scan, decontamination and mixing against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from lectorium.llm.decontamination import clean_spans, op4_decontamination
from lectorium.llm.decontamination import scan as scan_windows
from lectorium.llm.licenses import BASE, PASSAGES, op1_license_scan, scan
from lectorium.llm.mixing import op9_source_mixing, sainte_lague, targets

from .conftest import PASSAGE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def test_license_base_places(spark, store, odd_documents):
    docs = odd_documents + [(20, "Under the MIT License, under the mit license; CC-BY-NC CC BY NC 4.0", "en", "a"), (21, "Apache License, Version 2.0 apache license", "en", "a")]
    got = sorted(op1_license_scan(spark, store(docs)).collect(), key=str)
    expected = []
    for doc_id, text, *_ in docs:
        w = words(text)
        found = [(i, label) for label, phrase in BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        expected.append((doc_id, len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))))
    assert sorted(expected, key=str) == sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=str)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_passages_survive_edits(spark):
    rng, rows = random.Random(1), []
    for i, (_, text, phrases) in enumerate(PASSAGES):
        w = text.split()
        keep = {x for p in phrases for x in p.split()}
        free = [k for k, x in enumerate(w) if x not in keep]
        for k in rng.sample(free, min(2, len(free) // 3)):
            w[k] = "altered"
        rows.append((i, "Some words before. " + " ".join(w).title() + " and after"))
    rows.append((99, "software without a license, free of charge, the following conditions are met in the public domain"))
    got = {r.doc_id: r.labels.split(",") for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(PASSAGES[i][0] in got[i] for i in range(len(PASSAGES))) and got[99] == [""]


def brute_hits(docs, items, n=10):
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            grams[tuple(w[i : i + size])].add(str(item))
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                if (g := tuple(w[i : i + size])) in grams:
                    hit |= set(range(i, i + size))
                    found |= grams[g] - {"None"}
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("items", [[(1, PASSAGE), (2, None), (3, "!!")], [(1, PASSAGE), (10, PASSAGE), (2, "tiny text"), (5, "Étude7"), (None, "over the lazy")], []])
def test_decontamination(spark, store, odd_documents, items):
    got = op4_decontamination(spark, store(odd_documents, items)).collect()
    assert sorted(map(tuple, got), key=str) == brute_hits(odd_documents, items)


def test_windows_too_many_to_broadcast(spark, odd_documents):
    """The shuffle of keys finds what the broadcast table finds, in every column."""
    docs = spark.createDataFrame([(d, t) for d, t, *_ in odd_documents], "doc_id long, text string")
    items = spark.createDataFrame([(1, PASSAGE), (2, "tiny text"), (3, "word5 étude5 word6"), (None, "a text without"), (4, None), (5, "!!")], "item_id long, text string")
    plain = lambda rows: sorted((str(r.doc_id), r.n_words, sorted(tuple(h) for h in r.hits), r["items"]) for r in rows)
    one, other = scan_windows(docs, items).collect(), scan_windows(docs, items, most_broadcast=0).collect()
    assert plain(one) == plain(other) and any(r.hits for r in one)
    assert scan_windows(docs, items.limit(0), most_broadcast=0).filter("size(hits) > 0").count() == 0
    assert scan_windows(docs.limit(0), items, most_broadcast=0).count() == 0


def test_clean_spans(spark):
    docs = spark.createDataFrame([(1, f"before {PASSAGE} after"), (2, "Untouched, text"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert {r.doc_id: r.text for r in clean_spans(docs, items, mask="#").collect()} == {1: "before # after", 2: "Untouched, text", 3: None}


def test_mixing(spark, store, odd_documents):
    rng = random.Random(2)
    docs = odd_documents + [(100 + i, "w " * rng.randint(0, 90), "en", rng.choice("aaaaabc")) for i in range(1500)]
    root = store(docs)
    rows = op9_source_mixing(spark, root).collect()
    assert sorted(rows) == sorted(op9_source_mixing(spark, root).collect()) if None not in {r.doc_id for r in rows} else len(rows) == len(docs)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        a = by.setdefault((r.source_size, r.target), [0, 0])
        a[0] += r.taken
        a[1] += r.size
    for (size, target), (taken, _) in by.items():
        assert target <= 2 * size and abs(taken - target) <= max(200, 0.03 * target)
    sizes = sum(r.size for r in rows)
    total = sum(t for _, t in {(s, t) for s, t in by})
    assert total <= 1.5 * sizes * 1.001


def test_targets_fill_to_a_level(spark):
    rows = [("a", 10, 1), ("b", 1000, 1), ("c", 1000, 1), (None, 0, 1)]
    got = {r.source: r.target for r in targets(spark.createDataFrame(rows, "source string, source_size long, docs long")).collect()}
    assert got == {"a": 20.0, "b": 1996.666667, "c": 998.333333, None: 0.0}


def test_sainte_lague_against_one_by_one(spark):
    rng, rows, expected = random.Random(3), [], {}
    for g in range(12):
        votes, seats = [rng.choice([0, 1, 5, 7, rng.randint(0, 10_000)]) for _ in range(rng.randint(1, 40))], rng.randint(0, 300)
        if sum(votes) == 0:
            votes[0] = 3
        won = [0] * len(votes)
        for _ in range(seats):
            k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
            won[k] += 1
        rows += [(g, i, v, seats) for i, v in enumerate(votes)]
        expected |= {(g, i): x for i, x in enumerate(won)}
    got = sainte_lague(spark.createDataFrame(rows, "g int, i int, votes long, seats long"), ["g"], ["i"], "votes", "seats").collect()
    assert {(r.g, r.i): r.quota for r in got} == expected


def test_empty_tables(spark, store):
    root = store([], [])
    assert op1_license_scan(spark, root).count() == op4_decontamination(spark, root).count() == op9_source_mixing(spark, root).count() == 0
