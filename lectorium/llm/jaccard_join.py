"""N-gram Jaccard join by grouped prefixes: each document's number of links with near duplicates, and the
exact components that the links make.

Shingles are ordered by document frequency, rarest first (those beyond a table of the commonest are all
alike), then by hash. A document's prefix is so long that two documents whose similarity reaches the
threshold share a shingle of their prefixes. Documents of equal prefix and size form one group, exact
copies among them one class.

Groups are dealt to blocks by the shingle of their prefix that most prefixes have, so that a family of near
copies meets in few blocks; a block holds a bounded number of shingles, and a group that alone exceeds it is split.
Two blocks that share a prefix shingle of fitting sizes and places make a case. Each sends it the prefixes
of the groups concerned; pairs of groups are filtered there by size and by the number of shingles that their
prefixes have in common. Groups that are left send the sets of their classes, and all their pairs are
verified on whole sets. A pair of classes belongs to the two blocks it lies in, so it is verified exactly
once, and its task gives back sums of links by class and a forest that spans them: n near copies cost
n squared / 2 comparisons, but only n rows.

Defined results: null, empty and word-free texts have an empty set and are linked with nothing; a text
of fewer words than n is one shingle; rows that share a doc_id are one document with all their links; a
null doc_id is ordered before all others and given back as null; an empty table gives no rows.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectorium.llm._components import components
from lectorium.llm._io import frugal, release, removed, saved, ship, table
from lectorium.llm._shingles import mix, shingle_sets, summed, texts_of

#: Ranges of the hash space over which frequencies are counted, and the commonest kept of each: the table
#: that is broadcast has 2**20 entries of 8 bytes at most.
RANGES, KEPT, LEAST_FREQUENT = 1024, 1024, 8
FLUSH = 2_000_000
#: Shingles of more documents than this are dealt over several tasks; groups that a task remembers.
SALT_AT, SEEN = 20_000, 100_000
#: Shingles that a block of groups aims at, and what a class weighs besides its shingles. They bound no result.
BLOCK, EACH = 1 << 19, 64
#: Bits of the map by which texts are listed that the cases need: 2**18 words at most are broadcast.
BITS = 1 << 24
NULL_ID = -(1 << 63)


def _pack_counts(hashes: np.ndarray):
    """Rows (range, first value, steps, extra counts) of the sorted 32-bit hashes given."""
    values, counts = np.unique(hashes, return_counts=True)
    at = np.searchsorted(values, np.arange(RANGES + 1, dtype=np.uint64) << np.uint64(22))
    rows = []
    for r in range(RANGES):
        v, c = values[at[r] : at[r + 1]], counts[at[r] : at[r + 1]]
        if len(v):
            steps = np.diff(v)
            kind = np.uint16 if len(steps) == 0 or steps.max() < 1 << 16 else np.uint32
            many = np.flatnonzero(c > 1)
            rows.append((r, int(v[0]), kind == np.uint16, steps.astype(kind).tobytes(), many.astype(np.uint32).tobytes(), c[many].astype(np.uint32).tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()])],
        names=["range", "first", "short", "steps", "many", "counts"],
    )


@frugal
def _count(batches, n):
    held, size = [], 0
    for batch in batches:
        for s in shingle_sets(texts_of(batch.column(0)), n):
            held.append((s >> np.uint64(32)).astype(np.uint32))
            size += len(s)
        if size >= FLUSH:
            yield _pack_counts(np.concatenate(held))
            held, size = [], 0
    if size:
        yield _pack_counts(np.concatenate(held))


@frugal
def _sum_ranges(batches):
    """Rows come sorted by range: one range's counters are held at a time."""

    def out(r, counters):
        top = np.flatnonzero(counters >= LEAST_FREQUENT)
        top = np.sort(top[np.lexsort((top, -counters[top].astype(np.int64)))][:KEPT])
        return pa.RecordBatch.from_arrays(
            [pa.array([r], pa.int32()), pa.array([(top + (r << 22)).astype(np.uint32).tobytes()], pa.binary()), pa.array([counters[top].tobytes()], pa.binary())], names=["range", "values", "counts"]
        )

    current, counters = None, None
    for batch in batches:
        for r, first, short, steps, many, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r != current:
                if current is not None:
                    yield out(current, counters)
                current, counters = r, np.zeros(1 << 22, np.uint32)
            values = first - (r << 22) + np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.uint16 if short else np.uint32).astype(np.int64))])
            counters[values] += np.uint32(1)
            more = values[np.frombuffer(many, np.uint32)]
            counters[more] += np.frombuffer(counts, np.uint32) - np.uint32(1)
    if current is not None:
        yield out(current, counters)


def frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of all documents (upper 32 bits of their hashes, sorted) and their document
    frequencies: KEPT of each range at most."""
    counts = docs.select("text").mapInArrow(lambda it: _count(it, n), "range int, first long, short boolean, steps binary, many binary, counts binary")
    parts = max(1, min(RANGES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    summed_ = counts.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(_sum_ranges, "range int, values binary, counts binary")
    rows = sorted(summed_.collect(), key=lambda r: r["range"])
    return np.frombuffer(b"".join(r["values"] for r in rows), np.uint32), np.frombuffer(b"".join(r["counts"] for r in rows), np.uint32)


class _Order:
    """Shingles rarest first: those of the table of common ones by frequency, all others before them."""

    def __init__(self, known: tuple[np.ndarray, np.ndarray]):
        self.values, self.counts = known
        self.maybe = np.zeros(1 << 24, bool)
        self.maybe[self.values >> np.uint32(8)] = True

    def __call__(self, s: np.ndarray) -> np.ndarray:
        short = (s >> np.uint64(32)).astype(np.uint32)
        maybe = np.flatnonzero(self.maybe[short >> np.uint32(8)])
        if not len(maybe):
            return s
        at = np.minimum(np.searchsorted(self.values, short[maybe]), len(self.values) - 1)
        frequency = np.zeros(len(s), np.int64)
        frequency[maybe] = np.where(self.values[at] == short[maybe], self.counts[at], 0)
        return s[np.lexsort((s, frequency))]


def _prefix(size, percent):
    """How many shingles of a set of that size make its prefix."""
    return size - (percent * size + 99) // 100 + 1


@frugal
def _features(batches, n, percent, known):
    order = _Order(known.value)
    for batch in batches:
        rows = []
        for s in shingle_sets(texts_of(batch.column(1)), n):
            size = len(s)
            if not size:
                rows.append((0, None, None, None, None))
                continue
            prefix = order(s)[: _prefix(size, percent)]
            # The group: the prefix as a set (its order is fixed) and the size.
            rows.append((size, summed(s, 3), summed(s, 5), summed(np.append(prefix, np.uint64(size)), 7), prefix.tobytes()))
        kinds = [pa.int64()] * 4 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=["doc_id", "n", "f1", "f2", "g", "prefix"])


def _may(na, nb, pa_, pb, percent):
    """Whether sizes, and places of a common prefix shingle that is the first in common, leave room for enough
    common shingles. Later common shingles have later places, so a pair that fails at all of them has no link."""
    return ((100 + percent) * F.least(na - pa_, nb - pb) >= percent * (na + nb)) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))


@frugal
def _postings(batches, known, salt_at):
    """A row per shingle of a prefix. A group's copies in one task are listed once. Shingles of very many
    more than salt_at documents are dealt over parts, a bucket's salt."""
    values, counts = known.value
    hot = counts > salt_at
    values, counts = values[hot], counts[hot]
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for i, g in enumerate((np.asarray(batch.column(0), np.int64) ^ np.asarray(batch.column(1), np.int64) << 40).tolist()):
            if g not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(g)
                fresh.append(i)
        prefixes = [np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64) for i in fresh]
        lengths = np.asarray([len(p) for p in prefixes], np.int64)
        rows = np.repeat(np.arange(len(lengths)), lengths)
        token = np.concatenate(prefixes) if len(prefixes) else np.zeros(0, np.uint64)
        group = np.asarray(batch.column(0), np.int64)[fresh][rows] if fresh else np.zeros(0, np.int64)
        salt = np.full(len(token), -1, np.int32)
        if len(values):
            at = np.minimum(np.searchsorted(values, (token >> np.uint64(32)).astype(np.uint32)), len(values) - 1)
            many = values[at] == (token >> np.uint64(32)).astype(np.uint32)
            salt[many] = (mix(group[many].view(np.uint64), 4) % (counts[at[many]] // salt_at + 1).astype(np.uint64)).astype(np.int32)
        place = (np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        size = np.asarray(batch.column(1), np.int64)[fresh][rows].astype(np.int32) if fresh else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(salt), pa.array(group), pa.array(size), pa.array(place)], names=["token", "salt", "g", "n", "place"])


POSTING = "token long, salt int, g long, n int, place int"


@frugal
def _buckets(batches):
    """Postings come sorted by (token, salt, n, g): each once, those alone in their bucket not at all. One row
    waits for the next batch."""
    last, joined = None, False  # the row that waits, and whether its bucket has others before it
    names = [x.split()[0] for x in POSTING.split(", ")]
    for batch in batches:
        rows = [np.asarray(x) for x in batch.columns]
        if last is not None:
            rows = [np.concatenate([v, x]) for v, x in zip(last, rows, strict=True)]
        if not len(rows[0]):
            continue
        equal = [np.concatenate([[False], x[1:] == x[:-1]]) for x in rows]
        fresh = ~(equal[0] & equal[1] & equal[2] & equal[3])
        token, salt, *_ = rows = [x[fresh] for x in rows]
        same = np.concatenate([[False], (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])])
        several = same | np.append(same[1:], False) | (salt >= 0)
        several[0] |= joined
        out = np.flatnonzero(several[:-1])
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in rows], names=names)
        last, joined = [x[-1:] for x in rows], bool(several[-1])
    if last is not None and joined:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], names=names)


CASE = "pair long, side int, c long, id long, g long, docs long, multi boolean, hashes binary"
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
#: Rows and bytes of sets sent at once.
SENT_ROWS, SENT_BYTES = 4096, 1 << 22


@frugal
def _sets(batches, n, known):
    """For each text and each of wants(f1, pair, side, c, id, g, docs, multi) that has its set, the set,
    rarest shingle first, for that case."""
    names, order = [x.split()[0] for x in CASE.split(", ")], _Order(known.value)
    held, size = [], 0
    for batch in batches:
        for s, wants in zip(shingle_sets(texts_of(batch.column(0)), n), batch.column(1), strict=True):
            f1, raw = summed(s, 3) if len(s) else None, order(s).tobytes()
            for w in wants.as_py():
                if w["f1"] == f1:
                    held.append((*(w[x] for x in names[:-1]), raw))
                    size += len(raw)
                    if len(held) >= SENT_ROWS or size >= SENT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), _KINDS)], names=names)
                        held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), _KINDS)], names=names)


def _ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of each range in turn."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - lengths), lengths)


def _near(size: np.ndarray, left: np.ndarray, owner: np.ndarray, code: np.ndarray, percent: int):
    """For each group of left, the groups that may have members linked with its own, itself too. The groups'
    prefixes are given as rows (owner, code), by owner. Of two prefixes one ends first in the order of
    shingles, and all its shingles that the other set has are common to both prefixes; beyond it no more
    than the rest of that set can be in common."""
    by_code = np.argsort(code, kind="stable")
    low, high = (np.searchsorted(code[by_code], code, s) for s in ("left", "right"))
    begin = np.searchsorted(owner, np.arange(len(size) + 1))
    rest = size - _prefix(size, percent)
    for i in left:
        own = slice(begin[i], begin[i + 1])
        near, common = np.unique(owner[by_code[_ranges(low[own], high[own] - low[own])]], return_counts=True)
        n, m = size[i], size[near]
        enough = (100 + percent) * (common + np.maximum(rest[i], rest[near])) >= percent * (n + m)
        yield i, near[enough & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))]


HIT = "pair long, side int, g long, n int, block long, token long, inner boolean"
NEED = "pair long, side int, g long, n int, block long"


def _filtered(rows: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """One case's groups that may have a link in it, of rows as in HIT."""
    side, g, n, block, token, inner = rows
    order = np.lexsort((g, n, side))
    side, g, n, block, token, inner = (x[order] for x in (side, g, n, block, token, inner))
    fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (n[1:] != n[:-1]) | (side[1:] != side[:-1])])
    owner, at = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    of_side, size = side[at], n[at].astype(np.int64)
    # A group of several classes has links of its own; its halves in two blocks have, too.
    needed = np.zeros(len(at), bool)
    needed[owner[inner & (side == 2)]] = True
    for i, near in _near(size, np.flatnonzero(of_side != 1), owner, token, percent):
        near = near[of_side[near] == 1] if of_side[i] == 0 else near[near > i]
        if len(near):
            needed[i] = True
            needed[near] = True
    first = {x: i for i, x in enumerate(zip(g[at].tolist(), size.tolist())) if of_side[i] == 0}
    for i in np.flatnonzero(of_side == 1):
        if (k := first.get((int(g[at[i]]), int(size[i])))) is not None:
            needed[i] = needed[k] = True
    at = at[needed]
    return [side[at], g[at], n[at], block[at]]


@frugal
def _filter(batches, percent):
    """Rows come sorted by case; each gives the groups whose sets it needs."""
    names = [x.split()[0] for x in NEED.split(", ")]
    rest = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            rows = [np.asarray(x.to_numpy(zero_copy_only=False)) for x in batch.columns]
            rest = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows, strict=True)]
        if rest is None or not len(rest[0]):
            continue
        cuts = np.flatnonzero(np.concatenate([[True], rest[0][1:] != rest[0][:-1], [True]]))
        last = len(cuts) - (1 if batch is None else 2)  # the last case may go on in the next batch
        out = [(rest[0][x], _filtered([c[x:y] for c in rest[1:]], percent)) for x, y in zip(cuts[:last], cuts[1 : last + 1], strict=True)]
        rest = [x[cuts[last] :] for x in rest]
        if any(len(f[0]) for _, f in out):
            pair = np.repeat(np.asarray([k for k, _ in out]), [len(f[0]) for _, f in out])
            yield pa.RecordBatch.from_arrays([pa.array(pair), *(pa.array(np.concatenate(x)) for x in zip(*(f for _, f in out)))], names=names)


def _links(side: np.ndarray, group: np.ndarray, sets: list[np.ndarray], percent: int):
    """Each class of one case that has links, with the later ones (of the other side, where there are two)
    that it is linked with: every link once, as places in sets."""
    lengths = np.asarray([len(s) for s in sets], np.int64)
    starts = np.cumsum(lengths) - lengths
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    _, rep, of = np.unique(np.stack([group, lengths]), axis=1, return_index=True, return_inverse=True)
    of = of.ravel()
    by_group = np.argsort(of, kind="stable")
    first = np.searchsorted(of[by_group], np.arange(len(rep) + 1))
    held = _prefix(lengths[rep], percent)
    mark = np.zeros(len(values), bool)
    for i, near in _near(lengths[rep], np.unique(of[side != 1]), np.repeat(np.arange(len(rep)), held), flat[_ranges(starts[rep], held)], percent):
        others = by_group[_ranges(first[near], first[near + 1] - first[near])]
        others = others[side[others] != 0]
        mine = by_group[first[i] : first[i + 1]]
        for a in mine[side[mine] != 1]:
            later = others if side[a] == 0 else others[(of[others] > i) | ((of[others] == i) & (others > a))]
            if not len(later):
                continue
            codes = flat[starts[a] : starts[a] + lengths[a]]
            mark[codes] = True
            n = lengths[later]
            same = np.add.reduceat(mark[flat[_ranges(starts[later], n)]], np.cumsum(n) - n, dtype=np.int64)
            mark[codes] = False
            good = later[100 * same >= percent * (lengths[a] + n - same)]
            if len(good):
                yield a, good


#: What _verified gives: sums of linked documents of class a; links of the forest between ids a and b; links
#: between classes a and b of which one holds a document of several texts.
SUMS, FOREST, EXACT = 0, 1, 2
LINK = "kind int, a long, b long, docs long"


def _case(rows: dict[int, tuple], percent: int):
    names = list(rows)
    side, ident, group, docs, multi, sets = zip(*rows.values())
    side, group, docs, ident = np.asarray(side), np.asarray(group, np.int64), np.asarray(docs, np.int64), np.asarray(ident, np.int64)
    sums, root, out = np.zeros(len(names), np.int64), np.arange(len(names)), []
    for a, good in _links(side, group, list(sets), percent):
        sums[a] += docs[good].sum()
        sums[good] += docs[a]
        roots = np.unique(root[np.append(good, a)])
        if len(roots) > 1:
            out += [(FOREST, int(ident[roots[0]]), int(ident[r]), None) for r in roots[1:]]
            root[np.isin(root, roots)] = roots[0]
        out += [(EXACT, names[a], names[b], None) for b in good if multi[a] or multi[b]]
    return out + [(SUMS, names[i], None, int(sums[i])) for i in np.flatnonzero(sums)]


@frugal
def _verified(batches, percent):
    """Rows come sorted by case: one pair of blocks is held at a time."""
    kinds, names = [pa.int32(), pa.int64(), pa.int64(), pa.int64()], [x.split()[0] for x in LINK.split(", ")]
    pair, rows, out = None, {}, []

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], names=names)

    for batch in batches:
        for k, side, c, ident, g, docs, multi, s in zip(*(x.to_pylist() for x in batch.columns[:-1]), batch.column(7), strict=True):
            if k != pair:
                if len(rows) > 1:
                    out += _case(rows, percent)
                pair, rows = k, {}
                if len(out) >= SENT_ROWS:
                    yield batch_of(out)
                    out = []
            if c not in rows:
                rows[c] = (side, ident, g, docs, multi, np.frombuffer(s.as_buffer(), np.uint64).copy())
    if len(rows) > 1:
        out += _case(rows, percent)
    if out:
        yield batch_of(out)


def _listed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of docs whose doc_id has the hash of a wanted one, so that few other texts are shuffled: a bitmap
    of BITS bits, in words of 64, is broadcast whatever the number of wanted documents."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    word, bit = F.shiftright(spot, 6).alias("_word"), F.pmod(spot, F.lit(64)).cast("int").alias("_bit")
    bits = wanted.select(word, F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(doc_id), {BITS}), 64) as int))").alias("one")).groupBy("_word").agg(F.bit_or("one").alias("_bits"))
    hit = F.expr("(shiftright(_bits, _bit) & 1L) = 1L")
    return docs.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word").filter(hit).drop("_word", "_bit", "_bits")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, salt_at: int = SALT_AT, block: int = BLOCK) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id that links
    reach), class_id (the smallest doc_id of equal set) and n_links (the other documents it is linked with,
    exact copies too). Two documents link when 100 times their common shingles are at least percent times
    their shingles together."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(frequent(docs, n))
    features = saved(docs.mapInArrow(lambda it: _features(it, n, percent, shared), "doc_id long, n long, f1 long, f2 long, g long, prefix binary"), "features")

    # Buckets: a shingle, or a salted part of a frequent one, with all groups that have it in their prefix.
    posted = features.filter("n > 0").select("g", "n", "prefix").mapInArrow(lambda it: _postings(it, shared, salt_at), POSTING)
    common = saved(posted.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", "n", "g").mapInArrow(_buckets, POSTING).select("token", "g", "n", "place"), "buckets")
    wide, features = features, saved(features.drop("prefix"), "sizes")
    removed(spark, wide)
    del posted, wide
    release(spark)

    # Classes, with the number of documents that have this text alone, and whether others have it among several.
    filled = features.filter("n > 0")
    ends = [f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in ("f1", "f2", "g", "n")]
    numbered = saved(filled.groupBy("doc_id").agg(*ends), "numbered")
    alone = (F.col("min_f1") == F.col("max_f1")) & (F.col("min_f2") == F.col("max_f2"))
    several = numbered.filter(~alone).select("doc_id")
    owned = numbered.filter(alone).select("doc_id", *[F.col(f"min_{x}").alias(x) for x in ("f1", "f2", "g", "n")], F.lit(1).alias("one"))
    any_several = not several.isEmpty()
    if any_several:
        spread = saved(filled.join(several, "doc_id").distinct().select("doc_id", "f1", "f2", "g", "n", F.lit(0).alias("one")), "spread")
        owned = owned.union(spread)
    classes = owned.groupBy("f1", "f2", "g", "n").agg(F.min("doc_id").alias("id"), F.sum("one").alias("docs"), (F.min("one") == 0).alias("multi"))
    classes = saved(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

    # Groups that can have links are dealt to blocks, large ones to several.
    widest = common.join(common.groupBy("token").agg(F.count(F.lit(1)).alias("k")), "token").groupBy("g", "n").agg(F.max(F.struct("k", "token"))["token"].alias("widest"))
    groups = classes.groupBy("g", "n").agg(F.count(F.lit(1)).alias("members")).join(widest, ["g", "n"], "left").filter("widest IS NOT NULL OR members > 1")
    groups = saved(groups.select("g", "n", "members", F.coalesce("widest", "g").alias("key"), (F.col("members") * (F.col("n") + EACH)).alias("weight")), "groups")
    keys = groups.groupBy("key").agg(F.ceil(F.sum("weight") / block).alias("blocks"))
    dealt = groups.join(keys, "key").select("g", "n", "members", F.xxhash64("key", F.pmod(F.xxhash64("g", "n"), "blocks")).alias("deal"), F.ceil(F.col("weight") / block).alias("parts"))
    own_part = F.when(F.col("parts") == 1, F.col("deal")).otherwise(F.xxhash64("deal", F.pmod(F.xxhash64("c"), "parts")))
    placed = saved(classes.join(dealt, ["g", "n"]).select("c", "id", "f1", "g", "n", "docs", "multi", "members", own_part.alias("block")), "placed")

    # Cases: pairs of blocks with a shingle in common. A group of several classes is its own bucket, too.
    cells = placed.groupBy("g", "n", "block").agg(F.count(F.lit(1)).alias("here"), F.max("members").alias("members"))
    posts = common.join(cells, ["g", "n"]).select("token", "g", "n", "place", "block", F.lit(1).cast("long").alias("here"))
    inner = cells.filter("members > 1").select(F.xxhash64(F.lit(1), "g", "n").alias("token"), "g", "n", F.lit(0).alias("place"), "block", "here")
    posts = saved(posts.union(inner), "posts")
    removed(spark, common, groups)
    release(spark)
    summary = posts.groupBy("token", F.col("block").alias("other")).agg(
        F.sum("here").alias("there"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("place").alias("from"), F.max("place").alias("to")
    )
    size, one = F.col("n").cast("long"), (F.col("low") == F.col("high")) & (F.col("from") == F.col("to"))
    sizes_fit = (100 * size >= percent * F.col("low").cast("long")) & (100 * F.col("high").cast("long") >= percent * size)
    fits = sizes_fit & (~one | _may(size, F.col("low").cast("long"), F.col("place").cast("long"), F.col("from").cast("long"), percent))
    apart = F.col("block") != F.col("other")
    meet = posts.join(summary, "token").filter(F.when(apart, fits).otherwise(F.col("there") > 1)).select("g", "n", "block", "other").distinct()
    meet = meet.select(
        "g", "n", "block", F.xxhash64(F.least("block", "other"), F.greatest("block", "other")).alias("pair"), F.when(~apart, 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side")
    )
    hits = meet.join(posts, ["g", "n", "block"]).select("pair", "side", "g", F.col("n").cast("int").alias("n"), "block", "token", (F.col("here") > 1).alias("inner"))
    needed = saved(hits.repartition(parts, "pair").sortWithinPartitions("pair").mapInArrow(lambda it: _filter(it, percent), NEED), "needed")
    needs = needed.join(placed, ["g", "n", "block"]).groupBy(F.col("id").alias("doc_id")).agg(F.collect_list(F.struct("f1", "pair", "side", "c", "id", "g", "docs", "multi")).alias("wants"))
    wants = saved(needs, "wants")
    removed(spark, posts, placed, needed)
    release(spark)

    # Each case gets the sets that it needs, and verifies their pairs.
    sets = _listed(docs, wants).join(wants, "doc_id").select("text", "wants").mapInArrow(lambda it: _sets(it, n, shared), CASE)
    links = saved(sets.repartition(parts, "pair").sortWithinPartitions("pair").mapInArrow(lambda it: _verified(it, percent), LINK), "links")
    removed(spark, wants)
    del sets, needs, needed, hits, meet, summary, posts
    release(spark)

    # Components of the classes that have links. The classes of one document belong together.
    edges = links.filter(F.col("kind") == FOREST).select("a", "b")
    if any_several:
        of_several = saved(spread.drop("one").join(classes, ["f1", "f2", "g", "n"]).select("doc_id", "c", "id"), "of-several")
        first = of_several.groupBy("doc_id").agg(F.min("id").alias("a"))
        edges = edges.union(of_several.join(first, "doc_id").filter("a < id").select("a", F.col("id").alias("b")))
    edges = saved(edges.distinct(), "forest")
    touched = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    labels = components(touched.withColumn("label", F.col("id")), edges)

    # Links of a document: the documents of its class and of the classes linked with it, but for itself.
    sums = links.filter(F.col("kind") == SUMS).groupBy(F.col("a").alias("c")).agg(F.sum("docs").alias("linked"))
    of_class = classes.join(sums, "c", "left").join(labels, "id", "left")
    total = F.coalesce("linked", F.lit(0)) + F.col("docs") - 1
    if any_several:  # those of several texts are told apart, by their links one by one
        exact = links.filter(F.col("kind") == EXACT).select("a", "b")
        near = saved(exact.union(exact.select("b", "a")).union(classes.filter("multi").select("c", "c")).toDF("c", "near"), "near")
        whose = of_several.select(F.col("c").alias("near"), F.col("doc_id").alias("whose"))
        more = near.join(whose, "near").groupBy("c").agg(F.count_distinct("whose").alias("more"))
        of_class, total = of_class.join(more, "c", "left"), total + F.coalesce("more", F.lit(0))
        reached = saved(of_several.select("doc_id", "c").join(near, "c").select("doc_id", "near").distinct(), "reached")
        singles = reached.join(classes.select(F.col("c").alias("near"), "docs"), "near").groupBy("doc_id").agg(F.sum("docs").alias("one"))
        others = reached.join(whose, "near").groupBy("doc_id").agg(F.count_distinct("whose").alias("more"))
        of_more = saved(singles.join(others, "doc_id").select("doc_id", (F.col("one") + F.col("more") - 1).alias("links_of_all")), "of-more")
    of_class = saved(of_class.select("f1", "f2", "g", "n", F.col("id").alias("class_id"), F.coalesce("label", "id").alias("component_id"), total.alias("links")), "of-class")
    removed(spark, links)
    out = features.join(of_class, ["f1", "f2", "g", "n"], "left")
    n_links = F.coalesce("links", F.lit(0))
    if any_several:
        out, n_links = out.join(of_more, "doc_id", "left"), F.coalesce("links_of_all", n_links)
    none = F.when(F.col("n") == 0, F.col("doc_id"))
    real = lambda c: F.when(c != NULL_ID, c)
    return out.select(
        real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("component_id", none)).alias("component_id"), real(F.coalesce("class_id", none)).alias("class_id"), n_links.alias("n_links"),
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of links and components of all documents at a similarity of 85 % on four-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"), n=4, percent=85)
