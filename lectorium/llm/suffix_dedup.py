"""Suffix-array dedup with a run-length index: every byte of a repeated long string but the first goes.

A string of `length` bytes is repeated if it starts earlier too (in a smaller doc_id, or before in the
same document). Equal strings must meet; so each is dealt by the least hash among its `gram`-byte pieces,
which depends on the string alone. Neighbouring strings of one least piece form a context, about 135
bytes of a text; a row per context goes through the shuffle, not one per string.

A context that occurs whole before is repeated throughout, which its hashes show. What is left are the
different contexts of one least piece: their bytes are fetched, and the shard that they are dealt to
builds a run-length index of them: the Burrows-Wheeler transform of the shard's suffix array, its runs,
and per run end the sampled suffix, its neighbour in suffix order and their common length. From these
samples matching statistics are streamed in text order (from one position to the next the neighbour
moves along and the length falls by one, until the next sample), so long matches are marked from as
many samples as there are runs, which are few where the corpus is repetitive.

Pieces that occur in very many contexts are found first from a table of frequencies. Their strings are told
apart singly by their own hashes: the first place of each is summed up before the shuffle and joined back, so
that neither a piece nor a string of very many places gathers in one task.

Defined results: a null text is empty; texts shorter than `length` keep all bytes; rows that share a
doc_id are told apart by their place in the table and ordered by it; a null doc_id comes before all
others; an empty table gives no rows. Contexts are compared by 128 bits of hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectorium.llm._io import frugal, saved, ship, table
from lectorium.llm._shingles import _BYTE, _powers, mix, texts_of

LENGTH, GRAM = 100, 32
#: A piece in more contexts than this is dealt by single strings.
HOT = 50_000
#: Bytes of contexts indexed at once; a piece's contexts are never parted, and they are fewer than HOT.
SHARD = 2 << 20
NULL_ID = -(1 << 63)


class _Text:
    """Rolling hashes of one text and its contexts."""

    def __init__(self, text: np.ndarray, length: int, gram: int):
        self.n = len(text) - length + 1
        w = length - gram + 1
        self.power, self.inverse = _powers(len(text) + 1)
        with np.errstate(over="ignore"):
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[text] * self.power[: len(text)])])
        self.grams = self.hashed(np.arange(len(text) - gram + 1), gram, 0)
        least, span = self.grams, 1
        while 2 * span <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: self.n], least[w - span :][: self.n])
        self.first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        self.stop = np.append(self.first[1:], self.n)
        self.key, self.w, self.length = least[self.first], w, length

    def hashed(self, starts: np.ndarray, size, seed: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[starts + size] - self.total[starts]) * self.inverse[starts], seed)

    def periodic(self) -> np.ndarray:
        """Contexts whose least piece stands in them more than once: only they can repeat themselves."""
        low = np.bincount((self.grams & np.uint64(16383)).astype(np.int64), minlength=16384)
        out = np.zeros(len(self.first), bool)
        for i in np.flatnonzero(low[(self.key & np.uint64(16383)).astype(np.int64)] > 1):
            out[i] = np.count_nonzero(self.grams[self.first[i] : self.stop[i] + self.w - 1] == self.key[i]) > 1
        return out


@frugal
def _key_counts(batches, length, gram):
    """The upper 32 bits of the least pieces of all contexts, for the table of frequencies."""
    from lectorium.llm.jaccard_join import FLUSH, _pack_counts

    held, size = [], 0
    for batch in batches:
        for text in texts_of(batch.column(0)):
            if len(text) >= length:
                held.append((_Text(text, length, gram).key >> np.uint64(32)).astype(np.uint32))
                size += len(held[-1])
        if size >= FLUSH:
            yield _pack_counts(np.concatenate(held))
            held, size = [], 0
    if size:
        yield _pack_counts(np.concatenate(held))


CONTEXT = "key long, id1 long, doc_id long, row long, first int, windows int, periodic boolean"


@frugal
def _contexts(batches, length, gram, hot, singles):
    """The contexts of pieces that aren't hot or, with singles, the single strings of those that are."""
    frequent = hot.value
    for batch in batches:
        parts, rows = [], []
        for i, text in enumerate(texts_of(batch.column(2))):
            if len(text) < length:
                continue
            t = _Text(text, length, gram)
            windows = t.stop - t.first
            ident = t.hashed(t.first, windows + length - 1, 5) ^ mix(windows.astype(np.uint64), 6)
            columns = [t.key, ident, t.first, windows, t.periodic()]
            single = np.isin((t.key >> np.uint64(32)).astype(np.uint32), frequent)
            if not singles:
                columns = [c[~single] for c in columns]
            elif single.any():
                starts = np.concatenate([np.arange(a, z) for a, z in zip(t.first[single], t.stop[single], strict=True)])
                columns = [t.hashed(starts, length, 8), t.hashed(starts, length, 9), starts, np.ones(len(starts), np.int64), np.zeros(len(starts), bool)]
            else:
                continue
            parts.append(columns)
            rows.append(np.full(len(columns[0]), i))
        if not parts:
            continue
        key, ident, first, windows, periodic = (np.concatenate(c) for c in zip(*parts, strict=True))
        take = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key.view(np.int64)), pa.array(ident.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take),
                pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(periodic),
            ],
            names=[c.split()[0] for c in CONTEXT.split(", ")],
        )


FOUND = "repeated boolean, key long, doc_id long, row long, first int, windows int"


@frugal
def _sift(batches):
    """Rows come sorted by key, id1 and place. Repeated contexts are told at once; of the others those go
    on that share their key with a different one, or can repeat themselves."""
    last_key = last_id = held = None
    several = False

    def row(repeated, x):
        return (repeated, x[0], x[2], x[3], x[4], x[5])

    for batch in batches:
        c = [np.asarray(x) for x in batch.columns]
        key, ident = c[0], c[1]
        n = len(key)
        new_key = np.concatenate([[n > 0 and key[0] != last_key], key[1:] != key[:-1]])
        new_id = new_key | np.concatenate([[ident[0] != last_id], ident[1:] != ident[:-1]])
        out = []
        # Only places where a new context begins need a look one by one if their key goes on; the rest is repeated.
        repeated = np.flatnonzero(~new_id)
        begins = np.flatnonzero(new_id)
        more = np.zeros(len(begins), bool)  # a different context of the same key follows or went before
        same_key_before = ~new_key[begins]
        more |= same_key_before
        more[:-1] |= same_key_before[1:]
        if len(begins) and same_key_before[0] and held is not None:
            out.append(row(False, held))  # the context that was last in the batch before
            held = None
        elif len(begins):
            held = None
        take = begins[(more | c[6][begins])]
        if n:
            last_key, last_id = key[-1], ident[-1]
            if len(begins):
                b = begins[-1]
                held = None if (more[-1] or c[6][b]) else tuple(x[b].item() for x in c)
        at = np.concatenate([repeated, take])
        flags = np.concatenate([np.ones(len(repeated), bool), np.zeros(len(take), bool)])
        arrays = [flags] + [x[at] for x in (c[0], c[2], c[3], c[4], c[5])]
        for x in out:
            arrays = [np.append(a, v).astype(a.dtype) for a, v in zip(arrays, x, strict=True)]
        if len(arrays[0]):
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[x.split()[0] for x in FOUND.split(", ")])


@frugal
def _bytes_of(batches, length):
    for batch in batches:
        rows = []
        for doc_id, row, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            rows += [(x["key"], doc_id, row, x["first"], text[x["first"] : x["first"] + x["windows"] + length - 1].tobytes()) for x in wanted]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()])], names=["key", "doc_id", "row", "first", "bytes"]
        )


def suffix_array(symbols: np.ndarray, top: int) -> np.ndarray:
    """Suffixes in order, by doubling; symbols are below top and no two suffixes are prefixes of each other."""
    n = len(symbols)
    bits = max(1, int(top).bit_length())
    take = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(take):
        key <<= bits
        key[: n - k] |= symbols[k:] + 1 if bits * take < 62 else symbols[k:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    span = take
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        sub = order[tied]
        after = np.where(sub + span < n, rank[np.minimum(sub + span, n - 1)], -1)
        head = rank[sub]
        inner = np.lexsort((after, head))
        order[tied] = sub[inner]
        h, a = head[inner], after[inner]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (a[1:] != a[:-1])])
        rank[order[tied]] = np.maximum.accumulate(np.where(fresh, tied, 0))
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        span *= 2
    return order


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some strings with samples at run ends."""

    def __init__(self, strings: list[bytes]):
        lengths = np.asarray([len(s) for s in strings], np.int64)
        m = len(strings)
        flat = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
        ends = np.cumsum(lengths + 1) - 1
        symbols = flat.astype(np.int64) + m
        symbols[ends] = np.arange(m)  # every string has an end of its own
        n = len(symbols)
        self.left = np.repeat(ends, lengths + 1) - np.arange(n)  # bytes up to the string's end
        order = suffix_array(symbols, m + 256)
        before = symbols[order - 1]  # the transform
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.run_symbols, self.run_lengths = before[heads], np.diff(np.append(heads, n))
        # Per run: the suffix at its head, and the last of the run before, its neighbour in suffix order.
        self.sample = order[heads]
        self.neighbour = np.where(heads > 0, order[heads - 1], -1)
        self.common = self._common(flat, self.sample, self.neighbour)

    def _common(self, flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, within their strings."""
        n = len(flat)
        padded = np.concatenate([flat, np.zeros(8, np.uint8)]).astype(np.uint64)
        word = np.zeros(n, np.uint64)
        for k in range(8):
            word |= padded[k : n + k] << np.uint64(8 * k)
        out = np.zeros(len(a), np.int64)
        most = np.where(b >= 0, np.minimum(self.left[a], self.left[b]), 0)
        live = np.flatnonzero(most > 0)
        while len(live):
            at = out[live]
            differ = word[np.minimum(a[live] + at, n - 1)] ^ word[np.minimum(b[live] + at, n - 1)]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
            out[live] = np.minimum(at + same, most[live])
            live = live[(same == 8) & (out[live] < most[live])]
        return out

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position, streamed from the samples: a neighbour and the length of the common prefix."""
        n = len(self.left)
        known = np.zeros(n, np.int64)
        order = np.argsort(self.sample)
        places, near, common = self.sample[order], self.neighbour[order], self.common[order]
        known[places] = np.arange(1, len(places) + 1)
        last = np.maximum.accumulate(known) - 1
        since = np.arange(n) - places[last]
        return np.where(near[last] >= 0, near[last] + since, -1), np.maximum(common[last] - since, 0)

    def repeated(self, length: int) -> np.ndarray:
        """Which positions start a string of the length that starts at an earlier position too."""
        near, common = self.statistics()
        whole = self.left >= length
        parent = np.where((common >= length) & whole, near, np.arange(len(near)))
        while True:
            further = parent[parent]
            if np.array_equal(further, parent):
                break
            parent = further
        at = np.flatnonzero(whole)
        first = np.empty(len(near), np.int64)
        first[parent[at[::-1]]] = at[::-1]
        out = np.zeros(len(near), bool)
        out[at] = first[parent[at]] < at
        return out


MARK = "row long, start int, stop int"


def _index_shard(rows, length):
    """rows: (doc_id, row, first, bytes) of the contexts of some keys. Yields marked ranges."""
    rows.sort(key=lambda r: r[:3])
    marked = RunLengthIndex([r[3] for r in rows]).repeated(length)
    sizes = np.asarray([len(r[3]) + 1 for r in rows])
    base = np.cumsum(sizes) - sizes
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    starts, stops = edge[0::2], edge[1::2]  # a run never crosses a string's end, which can't be marked
    which = np.searchsorted(base, starts, side="right") - 1
    first, ids = np.asarray([r[2] for r in rows]), np.asarray([r[1] for r in rows], np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids[which]), pa.array((first[which] + starts - base[which]).astype(np.int32)), pa.array((first[which] + stops - base[which] - 1 + length).astype(np.int32))], names=["row", "start", "stop"]
    )


@frugal
def _index(batches, length):
    """Contexts come sorted by key. Whole keys are gathered up to a shard's size."""
    held, size, last = [], 0, None
    for batch in batches:
        for key, doc_id, row, first, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last and size >= SHARD:
                yield from _index_shard(held, length)
                held, size = [], 0
            held.append((doc_id, row, first, raw))
            size, last = size + len(raw), key
    if held:
        yield from _index_shard(held, length)


def spans(marks) -> list[tuple[int, int]]:
    """Ranges that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(marks):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


@frugal
def _kept(batches, with_text):
    for batch in batches:
        rows = []
        for text, marks in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            found = spans((m["start"], m["stop"]) for m in marks or ())
            raw, at, parts = text.tobytes(), 0, []
            for a, z in found:
                parts.append(raw[at:a])
                at = z
            kept = b"".join([*parts, raw[at:]])
            rows.append((len(raw), sum(z - a for a, z in found), len(found), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        columns = [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))]
        yield pa.RecordBatch.from_arrays(columns[: 5 + with_text], names=names[: 5 + with_text])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text,
    what is left (bytes of characters cut in half are dropped from it, not from the hash)."""
    from lectorium.llm.jaccard_join import RANGES, _sum_ranges

    spark = docs.sparkSession
    ship(spark)
    # Several jobs join by row, so the numbers are written once: a plan run anew might deal them otherwise.
    docs = saved(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), "numbered-texts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = docs.select("text").mapInArrow(lambda it: _key_counts(it, length, gram), "range int, first long, short boolean, steps binary, many binary, counts binary")
    summed = counts.repartition(max(1, min(RANGES, parts)), "range").sortWithinPartitions("range").mapInArrow(_sum_ranges, "range int, values binary, counts binary").collect()
    frequent = [np.frombuffer(r["values"], np.uint32)[np.frombuffer(r["counts"], np.uint32) > hot] for r in summed]
    frequent = np.concatenate([np.zeros(0, np.uint32), *frequent])
    shared = spark.sparkContext.broadcast(frequent)

    placed = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "row", "text")
    contexts = placed.mapInArrow(lambda it: _contexts(it, length, gram, shared, False), CONTEXT)
    found = saved(contexts.repartition(parts, "key").sortWithinPartitions("key", "id1", "doc_id", "row", "first").mapInArrow(_sift, FOUND), "contexts")
    wanted = found.filter(~F.col("repeated")).groupBy("row").agg(F.collect_list(F.struct("key", "first", "windows")).alias("wanted"))
    fetched = placed.join(wanted, "row").select("doc_id", "row", "text", "wanted").mapInArrow(lambda it: _bytes_of(it, length), "key long, doc_id long, row long, first int, bytes binary")
    marked = saved(fetched.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda it: _index(it, length), MARK), "marks")
    whole = found.filter("repeated").select("row", F.col("first").alias("start"), (F.col("first") + F.col("windows") + length - 1).alias("stop"))
    if len(frequent):
        singles = saved(placed.mapInArrow(lambda it: _contexts(it, length, gram, shared, True), CONTEXT).select("key", "id1", F.struct("doc_id", "row", "first").alias("place")), "singles")
        firsts = saved(singles.groupBy("key", "id1").agg(F.min("place").alias("least")), "singles-first")
        again = singles.join(firsts, ["key", "id1"]).filter("place <> least")
        whole = whole.union(again.select("place.row", F.col("place.first").alias("start"), (F.col("place.first") + length).alias("stop")))
    marks = marked.union(whole).groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("marks"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_text else "")
    return docs.join(marks, "row", "left").select("doc_id", "text", "marks").mapInArrow(lambda it: _kept(it, with_text), schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 100 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
