"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of order 0 to 3. A byte that was seen after a context has
probability count / (total + distinct); the escape to the next shorter context has distinct / (total +
distinct); below order 0 all symbols are alike. The statistics are frozen after training, so a text's
code length under a language is a sum of table entries: the trees are flattened into one table of
(context, symbol) -> bits for all languages, and a context that was seen too seldom shares the row of
its longest kept suffix. The language with the shortest code wins.

The model is fitted on a bounded sample of labelled rows: per language at most docs_per_lang documents
by their first max_chars characters, those of lowest hash, and most_docs over all languages; every language
with a label is learned. Its table is bounded, too: the most_symbols commonest bytes have symbols of their
own, and contexts of order 2 and 3 that were seen less than least times, or the rarest beyond table_bytes,
share the row of their suffix. Everything else reads every byte.

Defined results: a text that is null or has no letter gets `und` and score 0; without any labelled row
every text gets `und`; equal code lengths go to the first language by code point; very long texts are
scored piece by piece with their context carried over; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectorium.llm._io import frugal, ship, table, trim

UND = "und"
ROWS = 2048
PIECE = 1 << 19


class PpmModel:
    """Frozen code lengths of all languages."""

    def __init__(self, languages: list[str], symbol: np.ndarray, state: np.ndarray, bits: np.ndarray):
        self.languages, self.symbol, self.state, self.bits = languages, symbol, state, bits
        self.size = bits.shape[1]

    @classmethod
    def fit(cls, samples: dict[str, list[bytes]], least: int = 24, most_symbols: int = 160, table_bytes: int = 1 << 27) -> PpmModel:
        """samples: texts per language."""
        languages = sorted(samples)
        seen = sum(np.bincount(np.frombuffer(b"".join(samples[x]), np.uint8), minlength=256) for x in languages) if languages else np.zeros(256)
        kept = [b for b in np.argsort(-seen, kind="stable")[: most_symbols - 1] if seen[b]]
        symbol = np.zeros(256, np.int32)
        symbol[kept] = np.arange(1, len(kept) + 1)
        a = len(kept) + 1

        def grams(x: str) -> list[np.ndarray]:
            """The contexts of orders 0 to 3 before each byte, and the byte's symbol."""
            padded = np.concatenate([p for t in samples[x] for p in (np.zeros(3, np.int32), symbol[np.frombuffer(t, np.uint8)])] or [np.zeros(3, np.int32)])
            real = np.concatenate([p for t in samples[x] for p in (np.zeros(3, bool), np.ones(len(t), bool))] or [np.zeros(3, bool)])
            at = np.flatnonzero(real)
            two = padded[at - 2] * a + padded[at - 1]
            return [np.zeros(len(at), np.int32), padded[at - 1], two, padded[at - 3] * (a * a) + two, padded[at]]

        totals = {2: np.zeros(a**2, np.int64), 3: np.zeros(a**3, np.int64)}
        for x in languages:
            g = grams(x)
            for o in (2, 3):
                totals[o] += np.bincount(g[o], minlength=a**o)
        rows, deep = max(0, table_bytes // (4 * a * max(1, len(languages))) - a), []
        for o in (2, 3):
            found = np.flatnonzero(totals[o] >= least)
            found = found[np.argsort(-totals[o][found], kind="stable")][:rows]
            rows -= len(found)
            deep.append(np.sort(found))
        two, three = deep
        del totals
        state = np.tile(np.arange(a, dtype=np.int32), a * a)
        row = np.full(a * a, -1, np.int32)
        row[two] = a + np.arange(len(two))
        second_row = np.tile(row, a)
        state = np.where(second_row >= 0, second_row, state)
        state[three] = a + len(two) + np.arange(len(three))
        del second_row
        bits = np.zeros((a + len(two) + len(three), a, len(languages)), np.float32)
        for n, x in enumerate(languages):
            g = grams(x)
            below = cls._blend(np.bincount(g[4], minlength=a)[None, :].astype(float), np.full((1, a), 1.0 / a))
            one = cls._blend(np.bincount(g[1] * a + g[4], minlength=a * a).reshape(a, a).astype(float), np.repeat(below, a, axis=0))
            counts2 = np.bincount(g[2] * a + g[4], minlength=a**3).astype(np.int32).reshape(a * a, a)
            second = cls._blend(counts2[two].astype(float), one[two % a])
            place = np.full(a**3, -1, np.int32)
            place[three] = np.arange(len(three))
            at = place[g[3]]
            counts3 = np.bincount(at[at >= 0] * a + g[4][at >= 0], minlength=len(three) * a).astype(np.int32).reshape(len(three), a)
            del g, at, place
            bits[: a + len(two), :, n] = -np.log2(np.concatenate([one, second]))
            for first in range(0, len(three), ROWS):  # few rows at a time, as doubles take room
                part = three[first : first + ROWS]
                under = cls._blend(counts2[part % (a * a)].astype(float), one[part % a])
                bits[a + len(two) + first :][: len(part), :, n] = -np.log2(cls._blend(counts3[first : first + ROWS].astype(float), under))
            del counts2, counts3
        return cls(languages, symbol, state, bits)

    @staticmethod
    def _blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probabilities of one order: seen symbols by count, the others through the escape."""
        total, distinct = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
        left = np.where(counts > 0, 0.0, shorter)
        rest = left.sum(axis=1, keepdims=True)
        escape = np.where(rest > 0, distinct / np.maximum(total + distinct, 1), 0.0)
        seen = counts / np.maximum(total, 1) * (1 - escape)
        return np.where(total > 0, np.where(counts > 0, seen, escape * left / np.maximum(rest, 1e-300)), shorter)

    def code_lengths(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits of each text (bytes) under each language."""
        out, unit, held = np.zeros((len(texts), len(self.languages))), [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), PIECE):
                if held and held + min(len(t) - at, PIECE) > PIECE:
                    self._add(out, unit)
                    unit, held = [], 0
                unit.append((i, t[max(0, at - 3) : at], t[at : at + PIECE]))
                held += min(len(t) - at, PIECE)
        if unit:
            self._add(out, unit)
        return out

    def _add(self, out: np.ndarray, unit: list) -> None:
        a, parts, ends = self.size, [], []
        for _, before, piece in unit:
            parts += [np.zeros(3 - len(before), np.int32), self.symbol[before], self.symbol[piece]]
        s = np.concatenate(parts)
        lengths = np.asarray([len(p) + 3 for _, _, p in unit])
        ends = np.cumsum(lengths)
        code = (s[:-3] * a + s[1:-2]) * a + s[2:-1]
        rows = np.take(self.bits.reshape(-1, self.bits.shape[2]), self.state[code].astype(np.int64) * a + s[3:], axis=0)
        rows = np.concatenate([np.zeros((3, rows.shape[1]), np.float32), rows])
        first = (ends - lengths)[:, None] + np.arange(3)[None, :]
        rows[first.ravel()] = 0  # the pads
        sums = np.add.reduceat(rows, ends - lengths, axis=0, dtype=np.float64)
        np.add.at(out, [i for i, _, _ in unit], sums)


def _letters(texts: list[np.ndarray]) -> list[bool]:
    out = []
    for t in texts:
        lower = t | 0x20
        ascii_ = bool(((lower >= 97) & (lower <= 122) & (t < 128)).any())
        out.append(ascii_ or (bool((t >= 128).any()) and any(map(str.isalpha, t.tobytes().decode("utf-8", "ignore")))))
    return out


@frugal
def _predict(batches, model: PpmModel):
    for batch in batches:
        text = batch.column(0)
        texts = [np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid and len(x.as_buffer()) else np.zeros(0, np.uint8) for x in text]
        known = np.asarray(_letters(texts), bool) & bool(model.languages)
        pred, score = np.full(len(texts), UND, object), np.zeros(len(texts))
        at = np.flatnonzero(known)
        if len(at):
            bits = model.code_lengths([texts[i] for i in at])
            best = bits.argmin(axis=1)
            pred[at] = np.asarray(model.languages, object)[best]
            score[at] = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names[1:], "lang_pred", "score"])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training; a null doc_id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, docs_per_lang: int = 400, max_chars: int = 20_000, most_docs: int = 40_000) -> PpmModel:
    """Fit on rows of docs(doc_id, text, lang) that aren't held out and have a lang: the first max_chars
    characters of docs_per_lang documents of each language, of fewer where most_docs would be passed."""
    labelled = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("text", F.substring("text", 1, max_chars))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return PpmModel.fit({})
    each = max(1, min(docs_per_lang, most_docs // len(counts)))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, (1.3 * each + 4) / n)))])
    place = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # A row that is repeated counts once, so that no text is gathered more often than it differs.
    picked = labelled.withColumn("place", place).filter(F.col("place") < share[F.col("lang")]).groupBy("lang", "doc_id", "place").agg(F.min("text").alias("text")).collect()
    samples: dict[str, list[bytes]] = {}
    trim()
    for r in sorted(picked, key=lambda r: (r["place"], r["doc_id"], r["text"])):
        if len(samples.setdefault(r["lang"], [])) < each:
            samples[r["lang"]].append(r["text"].encode())
    del picked
    model = PpmModel.fit(samples)
    trim()
    return model


def identify(docs: DataFrame, model: PpmModel, text: str = "text") -> DataFrame:
    """docs without its text, and lang_pred string and score double: the posterior of the language."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest) + ", lang_pred string, score double"
    return docs.select(text, *rest).mapInArrow(lambda it: _predict(it, shared.value), schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labels of those that aren't held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs)
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
