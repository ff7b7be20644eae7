"""Jaccard join, suffix dedup and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from lectorium.llm._components import components
from lectorium.llm.jaccard_join import jaccard_components, op2_ngram_jaccard
from lectorium.llm.suffix_dedup import RunLengthIndex, op3_suffix_dedup, remove_repeats

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(rows, n, percent):
    sets, parent = [], {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets.append((d, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
        parent.setdefault(d, d)
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            same = len(x & y)
            if same and 100 * same >= percent * (len(x) + len(y) - same):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted((d, len(s), find(d)) for d, s in sets)


def family(rng, words, copies, edits):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(len(t))] = f"w{rng.randint(0, 5000)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_components_of_families(spark, n, percent):
    rng = random.Random(n)
    line = " ".join(f"c{i}" for i in range(12))
    texts = family(rng, 60, 40, 3) + family(rng, 200, 25, 9) + family(rng, 9, 12, 1) + [f"{line} " + " ".join(f"u{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 20))) for _ in range(60)]
    texts += ["", None, " ", "x", "X", "x y", "x y z", line, line.upper()] + texts[:5]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent, salt_at=20_000 if n == 4 else 10).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, n, percent)


def test_op2_on_odd_rows(spark, store, odd_documents):
    root = store(odd_documents)
    got = op2_ngram_jaccard(spark, root).collect()
    assert len(got) == len(odd_documents)
    rows = [(d, t) for d, t, *_ in odd_documents if d is not None]
    assert sorted(tuple(r)[:3] for r in got if r.doc_id is not None) == brute_components(rows, 4, 85)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_empty_tables(spark, store):
    root = store([])
    assert op2_ngram_jaccard(spark, root).count() == op3_suffix_dedup(spark, root).count() == 0


def test_components_of_paths(spark):
    rng = random.Random(4)
    ids = rng.sample(range(10_000), 300)
    edges = [(ids[i], ids[i + 1]) for i in range(299) if i % 50 != 49]
    vertices = spark.createDataFrame([(i, i) for i in ids], "id long, label long")
    got = {r.id: r.label for r in components(vertices, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(ids[k // 50 * 50 : k // 50 * 50 + 50]) for k, i in enumerate(ids)}


def brute_links(rows, n, percent):
    """Each document's number of other documents that any of its rows is linked with."""
    sets, linked = [], {}
    for d, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets.append((d, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
        linked.setdefault(d, set())
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            same = len(x & y)
            if a != b and same and 100 * same >= percent * (len(x) + len(y) - same):
                linked[a].add(b)
                linked[b].add(a)
    return {d: len(x) for d, x in linked.items()}


@pytest.mark.parametrize("block", [1 << 19, 300])
def test_links_are_all_counted(spark, block):
    """Exact copies, families of near copies in which not all are linked, and documents of several texts."""
    rng = random.Random(block)
    texts = family(rng, 60, 40, 3) + family(rng, 120, 20, 6) + ["", None, "x", "X", "x y z"]
    rows = list(enumerate(texts + texts[:6] + texts[:3])) + [(2, texts[45]), (2, texts[50]), (7, texts[45]), (50, texts[1]), (50, texts[50])]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, block=block).collect()
    assert {r.doc_id: r.n_links for r in got} == brute_links(rows, 4, 85)
    assert len(got) == len(rows) and sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 4, 85)


def test_components_of_later_edges(spark):
    """A later edge joins two vertices that don't name their components."""
    vertices = spark.createDataFrame([(i, i) for i in (1, 2, 10, 11, 12, 20)], "id long, label long")
    first = components(vertices, spark.createDataFrame([(1, 2), (10, 11), (11, 12)], "a long, b long"))
    got = {r.id: r.label for r in components(first, spark.createDataFrame([(2, 12)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 10: 1, 11: 1, 12: 1, 20: 20}


def brute_repeats(rows, length=100):
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        marks = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                marks[i : i + length] = b"\1" * length
            else:
                seen.add(b[i : i + length])
        kept = bytes(c for c, m in zip(b, marks, strict=True) if not m)
        out.append((d, len(b), sum(marks), sum(1 for i in range(len(marks)) if marks[i] and (i == 0 or not marks[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [50_000, 2])
def test_suffix_dedup(spark, hot):
    rng = random.Random(hot)
    base = ["".join(rng.choice("ab c") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(150):
        t = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            p = rng.randint(0, len(t))
            t = t[:p] + rng.choice(["x", "", "é", "ing " * rng.randint(1, 200), rng.choice(base)[rng.randint(0, 300) :]]) + t[p + rng.randint(0, 3) :]
        rows.append((i, t if i % 17 else None))
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    assert sorted(map(tuple, got)) == brute_repeats(rows)


def test_suffix_dedup_on_odd_rows(spark, store, odd_documents):
    got = op3_suffix_dedup(spark, store(odd_documents)).collect()
    rows = sorted([(d, t) for d, t, *_ in odd_documents], key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(map(tuple, got), key=str) == sorted(brute_repeats(rows), key=str)


def test_run_length_index_statistics():
    rng = np.random.default_rng(5)
    strings = [bytes(rng.integers(97, 99, int(rng.integers(1, 60))).tolist()) for _ in range(30)]
    index = RunLengthIndex(strings)
    assert index.run_lengths.sum() == len(index.left) and (np.diff(index.run_symbols) != 0).all()
    near, common = index.statistics()
    flat = b"".join(s + b"\0" for s in strings)
    for p, (q, n) in enumerate(zip(near, common, strict=True)):
        if n:
            assert flat[p : p + n] == flat[q : q + n] and b"\0" not in flat[p : p + n]
    seen = set()
    place, expected = 0, np.zeros(len(flat), bool)
    for s in strings:
        for i in range(len(s) - 7):
            expected[place + i] = s[i : i + 8] in seen
            seen.add(s[i : i + 8])
        place += len(s) + 1
    assert (index.repeated(8) == expected).all()
