"""Token ids as binary shards with a minimal perfect hash index.

Format. A shard is two files. NAME.bin holds the ids of its documents one after another, in ascending
doc_id order, each document closed by an end id; ids are little-endian unsigned integers of 2 bytes if
the vocabulary allows it, else of 4. NAME.idx holds a JSON header line, then the bit levels of a minimal
perfect hash over the document keys, then per slot a 32-bit fingerprint, a 64-bit start (in ids, within
the shard) and a 32-bit length. A key is looked up in constant time: its slot by the hash, its
fingerprint compared, its ids read at the start that the slot holds.

Defined results: a null text is empty and gives the end id alone; rows that repeat a doc_id are kept
each, told apart by their ordinal in text order; a null doc_id sorts first; an empty table gives no shard.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectorium.llm._io import frugal, saved, scratch, ship, table

#: Chunks, and pieces of them, kept in each half of a worker's cache, and the longest that is kept.
CACHE_CHUNKS, CACHE_PIECES, CACHE_LENGTH = 600_000, 600_000, 48
#: Beyond ASCII, characters that an encoder may learn to part by itself: Latin, Cyrillic, punctuation, currencies.
#: None of them composes with another or with ASCII, and none changes its lower case by what is beside it.
_LEARNED = "".join(map(chr, (*range(0xA1, 0x250), *range(0x400, 0x460), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0))))


class Encoder(dict):
    """Chunk between ASCII white space -> its ids as bytes.

    Where the tokenizer drops white space and no rule of it crosses white space, a text's ids are those
    of its chunks in turn, and chunks repeat. Chunks are lower-cased and parted into pieces, which are cached
    too: by an expression where they are of ASCII and of characters for which the library has shown what it
    makes of them, else by the library. The library encodes every piece that isn't cached.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.by_chunk = made.get("model", {}).get("end_of_word_suffix") == "</w>" and (made.get("normalizer") or {}).get("type") == "Sequence" and {"type": "Lowercase"} in made["normalizer"]["normalizers"]
        self.special = [t["content"].encode() for t in made.get("added_tokens", []) if "<|" not in t["content"]]
        self.packed = "<%d" + ("H" if self.dtype.itemsize == 2 else "I")
        if self.by_chunk:
            self._learn()
        self.pieces: dict[str, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def _learn(self):
        """Ask the library for each of _LEARNED whether it is a letter or a sign, and how it is written in pieces."""
        normal, parts = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        known, letters, self.written = "", "", {}
        for c in _LEARNED:
            low = normal(c)
            if len(low) != 1 or low != c.lower() or normal(low) != low:
                continue
            inside, beside = [p for p, _ in parts(f"a{low}a")], [p for p, _ in parts(f"a{low}!{low}a")]
            if len(inside) == 1 and inside[0][0] == inside[0][-1] == "a":
                letters, written = letters + low, inside[0][1:-1]
            elif low == c and len(beside) == 3 and beside[0] == beside[2] == "a" and "!" in beside[1]:
                written = beside[1][: beside[1].index("!")]
            else:
                continue
            known, self.written[ord(low)] = known + c, written
        self.known = re.compile(f"[!-~{re.escape(known)}]+")
        letters = re.escape("".join(sorted(set(letters))))
        self.part = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{letters}]+|[0-9]|[^a-z0-9{letters}]+")

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The model's ids of one piece that the pre-tokenizer has made."""
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.old_pieces.get(piece)
            if ids is None:
                found = self.tokenizer.model.tokenize(piece)
                ids = struct.pack(self.packed % len(found), *[t.id for t in found])
            if len(piece) <= CACHE_LENGTH:
                if len(self.pieces) >= CACHE_PIECES:
                    self.old_pieces, self.pieces = self.pieces, {}
                self.pieces[piece] = ids
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        return self._keep(chunk, self._chunk(chunk) if ids is None else ids)

    def _keep(self, chunk: bytes, ids: bytes) -> bytes:
        """Remember a chunk. A full cache becomes the old one, from which what is met again comes back."""
        if len(chunk) <= CACHE_LENGTH:
            if len(self) >= CACHE_CHUNKS:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if b"<|" in chunk or (self.special and any(t in chunk for t in self.special)):
            return self._ids(text)
        if self.known.fullmatch(text):
            pieces = self.part.findall(text.lower())
            if not text.isascii():
                pieces = [p.translate(self.written) for p in pieces]
        else:
            t = self.tokenizer
            pieces = [p for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))]
        return b"".join(map(self._piece, pieces))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunk:
            return self._ids(text)
        return b"".join(map(self.__getitem__, text.encode().split()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(doc_ids: np.ndarray, null: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    """64-bit keys of documents; different (doc_id, ordinal) pairs are given different seeds of a bijection."""
    base = _mix(doc_ids.astype(np.int64).view(np.uint64), 1) ^ np.where(null, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
    return np.where(ordinals > 0, _mix(base ^ _mix(ordinals.astype(np.uint64), 2), 3), base)


class PerfectHash:
    """Levels of bits: a key's slot is the rank of its bit on the first level where it met no other key."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.concatenate([[0], np.cumsum(bits)]))
            total += int(bits.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.6) -> PerfectHash:
        levels, left = [], np.unique(keys)
        if len(left) != len(keys):
            raise ValueError("keys repeat")
        while len(left):
            at = (_mix(left, 11 + len(levels)) % np.uint64(max(1, int(gamma * len(left))))).astype(np.int64)
            counts = np.bincount(at, minlength=max(1, int(gamma * len(left))))
            levels.append(counts == 1)
            left = left[counts[at] > 1]
            if len(levels) > 200:
                raise ValueError("no perfect hash found")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has it. A key that isn't in the set may get any slot."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for n, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = (_mix(keys[left], 11 + n) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 7) >> np.uint64(32)).astype("<u4")


def pack_index(keys: np.ndarray, lengths: np.ndarray, dtype: np.dtype) -> bytes:
    table_ = PerfectHash.build(keys)
    slots = table_.slots(keys)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    out = [np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u4")]
    for column, values in zip(out, (fingerprint(keys), starts, lengths), strict=True):
        column[slots] = values
    head = {"magic": "lectorium-ids", "version": 1, "dtype": dtype.str, "docs": len(keys), "levels": [len(x) for x in table_.levels]}
    return json.dumps(head).encode() + b"\n" + b"".join(np.packbits(x).tobytes() for x in table_.levels) + b"".join(x.tobytes() for x in out)


#: Bytes of payload read at once.
STRETCH = 1 << 20


class Shard:
    """Keyed access to one shard."""

    def __init__(self, path: str):
        self.fs, name = pafs.FileSystem.from_uri(path)
        with self.fs.open_input_file(name + ".idx") as f:
            raw = f.read()
        head = json.loads(raw[: raw.index(b"\n")])
        if head.get("magic") != "lectorium-ids" or head.get("version") != 1:
            raise ValueError(f"{path} is no shard of ids")
        at, levels, n = raw.index(b"\n") + 1, [], head["docs"]
        for bits in head["levels"]:
            size = -(-bits // 8)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=bits).astype(bool))
            at += size
        self.hash, self.dtype = PerfectHash(levels), np.dtype(head["dtype"])
        self.fingerprints = np.frombuffer(raw, "<u4", n, at)
        self.starts = np.frombuffer(raw, "<u8", n, at + 4 * n).astype(np.int64)
        self.lengths = np.frombuffer(raw, "<u4", n, at + 12 * n).astype(np.int64)
        self.payload, self.at, self.stretch = self.fs.open_input_file(name + ".bin"), 0, b""

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that the shard doesn't hold."""
        slots = self.hash.slots(keys)
        good = slots >= 0
        good[good] = self.fingerprints[slots[good]] == fingerprint(keys[good])
        return np.where(good, slots, -1)

    def ids(self, slot: int) -> np.ndarray:
        """A document's ids. Keys that come in order are served from one stretch of the payload."""
        at, size = int(self.starts[slot]) * self.dtype.itemsize, int(self.lengths[slot]) * self.dtype.itemsize
        if not self.at <= at <= at + size <= self.at + len(self.stretch):
            self.payload.seek(at)
            self.at, self.stretch = at, self.payload.read(max(size, STRETCH))
        return np.frombuffer(self.stretch, self.dtype, size // self.dtype.itemsize, at - self.at)

    def close(self):
        self.payload.close()


@frugal
def _write_shard(batches, folder: str, path: str, end_id: int):
    """Write the partition's documents, which come in doc_id order, as one shard."""
    from pyspark import TaskContext

    context, enc = TaskContext.get(), encoder(path)
    filesystem, base = pafs.FileSystem.from_uri(folder)
    name, end = f"shard-{context.partitionId():06d}", np.asarray([end_id], enc.dtype).tobytes()
    part = f"{base}/_{context.taskAttemptId()}"
    sink, ids_, nulls, lengths = None, [], [], []
    for batch in batches:
        column = batch.column(0)
        nulls.append(np.asarray(column.is_null()))
        ids_.append(np.asarray(column.fill_null(0).cast(pa.int64())))
        sink = sink or filesystem.open_output_stream(part + ".bin")
        for text in batch.column(1):
            raw = enc.encode(text.as_py()) + end
            sink.write(raw)
            lengths.append(len(raw) // enc.dtype.itemsize)
    if sink is None:
        return
    sink.close()
    doc_ids, null, lengths = np.concatenate(ids_), np.concatenate(nulls), np.asarray(lengths, np.int64)
    fresh = np.concatenate([[True], (doc_ids[1:] != doc_ids[:-1]) | (null[1:] != null[:-1])])
    at = np.arange(len(doc_ids))
    ordinals = at - np.maximum.accumulate(np.where(fresh, at, 0))
    with filesystem.open_output_stream(part + ".idx") as f:
        f.write(pack_index(key_hash(doc_ids, null, ordinals), lengths, enc.dtype))
    filesystem.move(part + ".bin", f"{base}/{name}.bin")
    filesystem.move(part + ".idx", f"{base}/{name}.idx")
    first = np.iinfo(np.int64).min if null[0] else int(doc_ids[0])
    yield pa.RecordBatch.from_arrays(
        [pa.array([f"{folder}/{name}"]), pa.array([first], pa.int64()), pa.array([len(doc_ids)]), pa.array([int(lengths.sum())])],
        names=["shard", "first", "docs", "tokens"],
    )


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, shard_rows: int = 20_000, shard_bytes: int = 24 << 20) -> list[dict]:
    """Encode docs(doc_id, text) and write the shards, of about shard_bytes of text and shard_rows documents at
    most; returns their manifest, a row per shard, in order.

    Texts are dealt by ranges of doc_id and encoded after that, so each is moved and encoded once.
    """
    ship(docs.sparkSession)
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    dealt = docs.select("doc_id", "text").repartitionByRange(max(1, -(-n // shard_rows), -(-size // shard_bytes)), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    written = saved(dealt.mapInArrow(lambda it: _write_shard(it, folder, tokenizer_path, end_id), "shard string, first long, docs long, tokens long"), "token-manifest")
    manifest, start = [], 0
    for row in written.orderBy("first").toLocalIterator():  # by number, as names of more digits sort otherwise
        if manifest and manifest[-1]["first"] == row["first"]:
            raise ValueError(f"two shards begin with document {row['first']}")
        manifest.append(row.asDict() | {"start": start})
        start += row["tokens"]
    return manifest


@frugal
def _shards_of(batches, firsts):
    for batch in batches:
        column = batch.column(0)
        null = np.asarray(column.is_null())
        values = np.where(null, np.iinfo(np.int64).min, np.asarray(column.fill_null(0).cast(pa.int64())))
        shard = np.maximum(np.searchsorted(firsts, values, side="right") - 1, 0)
        yield pa.RecordBatch.from_arrays([column, batch.column(1), pa.array(shard)], names=["doc_id", "copies", "shard"])


READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


@frugal
def _read_keys(batches, manifest, with_ids: bool):
    _ENCODERS.clear()  # the workers that have written need them no more
    current, number = None, -1
    for batch in batches:
        column = batch.column(0)
        copies = np.asarray(batch.column(1)).astype(np.int64)
        null = np.repeat(np.asarray(column.is_null()), copies)
        doc_ids = np.repeat(np.asarray(column.fill_null(0).cast(pa.int64())), copies)
        shards = np.repeat(np.asarray(batch.column(2)), copies)
        ordinals = np.arange(len(doc_ids)) - np.repeat(np.cumsum(copies) - copies, copies)
        keys = key_hash(doc_ids, null, ordinals)
        rows = []
        for s in np.unique(shards):
            if s != number:
                if current:
                    current.close()
                current, number = Shard(manifest[s]["shard"]), s
            at = np.flatnonzero(shards == s)
            slots = current.find(keys[at])
            for i, slot in zip(at, slots, strict=True):
                if slot < 0:
                    raise KeyError(f"document {doc_ids[i]} isn't in {manifest[s]['shard']}")
                ids = current.ids(slot).astype("<u4")
                raw = ids.tobytes()
                rows.append((None if null[i] else int(doc_ids[i]), manifest[s]["start"] + int(current.starts[slot]), len(ids), zlib.crc32(raw), raw if with_ids else None))
        names, types = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids, [pa.int64()] * 4 + [pa.binary()] * with_ids
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    if current:
        current.close()


def read_tokens(keys: DataFrame, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """Look up every doc_id of keys in the shards: where its ids start over all shards, their number and
    checksum (and with_ids the ids, as little-endian 32-bit integers). A doc_id that is there n times is
    looked up n times."""
    ship(keys.sparkSession)
    schema = READ_SCHEMA + (", ids binary" if with_ids else "")
    if not manifest:
        return keys.sparkSession.createDataFrame([], schema)
    firsts = np.asarray([m["first"] for m in manifest], np.int64)
    counted = keys.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))
    placed = counted.mapInArrow(lambda it: _shards_of(it, firsts), "doc_id long, copies long, shard long")
    return placed.repartition(min(len(manifest), 4096), "shard").sortWithinPartitions("shard", "doc_id").mapInArrow(lambda it: _read_keys(it, manifest, with_ids), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as shards of ids and read every one back by its key."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    manifest = write_tokens(docs, scratch(spark, "tokens"), default_tokenizer(), end_id=2)
    return read_tokens(docs.select("doc_id"), manifest)
