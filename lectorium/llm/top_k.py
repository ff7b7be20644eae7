"""Exact top-k search: tiled matrix products, a partial selection per tile, merged top lists.

Query vectors go out in blocks of a fixed number of rows, as many blocks at once as fit a fixed number of
bytes. Every task holds these, walks its own part of the candidates tile by tile, multiplies, keeps what can
still enter a query's list, and emits k rows per query. The tasks' lists are written and merged by a tree: the
lists of FAN tasks become one, level by level, until a query has one list. Then the next blocks follow, so
neither the driver nor a task ever holds more than one bundle of blocks. Products are exact: components are
integers, and where a tile's bound leaves the 53 bits of a double the tile is multiplied in 64-bit integers,
or beyond these in unbounded ones; a score beyond 64 bits is given as the nearest that they hold.

Defined results: vectors that are null or hold a null or a non-finite component take no part, neither
as queries nor as candidates; vectors of other lengths than the query's are not its candidates; rows
with the query's own id are left out; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectorium.llm._io import frugal, saved, scratch, ship, table

SCALE = 256.0


def _matrices(batch: pa.RecordBatch):
    """Yield (ids, integer matrix as doubles) for each vector length among the valid rows of a batch."""
    ids, vectors = batch.column(0), batch.column(1)
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets = np.asarray(vectors.offsets)
    flat = vectors.values.cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    lengths = np.diff(offsets)
    present = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid())
    for n in np.unique(lengths[present]):
        rows = np.flatnonzero(present & (lengths == n))
        matrix = values[offsets[rows][:, None] + np.arange(n)[None, :]] if n else np.zeros((len(rows), 0))
        good = np.isfinite(matrix).all(axis=1)
        if good.any():
            rows = rows[good]
            yield np.asarray(ids.take(pa.array(rows)).cast(pa.int64())), np.floor(matrix[good] * SCALE)


def _unbounded(matrix: np.ndarray) -> np.ndarray:
    """The integers of a matrix of doubles as Python's."""
    return np.asarray([[int(x) for x in row] for row in matrix], object).reshape(matrix.shape)


def _merge(block, q, ids, scores, k):
    """The k best of each query among the rows given: (query row, id, score), best first."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.searchsorted(q, q, side="left")
    keep = np.arange(len(q)) - first < k
    return q[keep], ids[keep], scores[keep]


class _Lists:
    """The k best candidates so far of each query of one block."""

    def __init__(self, block_ids: np.ndarray, block: np.ndarray, k: int, tile_rows: int):
        self.block_ids, self.block, self.k, self.tile_rows = block_ids, block, k, tile_rows
        self.state = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.floor = np.full(len(block), np.iinfo(np.int64).min)
        self.high = np.abs(block).max(initial=0)

    def add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        block_ids, block, k, tile_rows, high, state, floor = self.block_ids, self.block, self.k, self.tile_rows, self.high, self.state, self.floor
        n_query, dim = block.shape
        if matrix.shape[1] == dim:
            for at in range(0, len(ids), tile_rows):
                tile, tile_ids = matrix[at : at + tile_rows], ids[at : at + tile_rows]
                if high * np.abs(tile).max(initial=0) * max(dim, 1) < 2.0**53:
                    scores = (tile @ block.T).astype(np.int64)
                elif high * np.abs(tile).max(initial=0) * max(dim, 1) < 2.0**62:
                    scores = tile.astype(np.int64) @ block.T.astype(np.int64)
                else:
                    exact = _unbounded(tile) @ _unbounded(block).T
                    scores = np.clip(exact, np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max).astype(np.int64)
                own = tile_ids[:, None] == block_ids[None, :]
                least = floor
                if len(tile_ids) > k + 1:  # the own row may be among the best, so one more is kept
                    least = np.maximum(floor, np.partition(scores, len(tile_ids) - k - 1, axis=0)[len(tile_ids) - k - 1])
                rows, cols = np.nonzero((scores >= least[None, :]) & ~own)
                if not len(rows):
                    continue
                state = _merge(
                    block,
                    np.concatenate([state[0], cols]),
                    np.concatenate([state[1], tile_ids[rows]]),
                    np.concatenate([state[2], scores[rows, cols]]),
                    k,
                )
                counts = np.bincount(state[0], minlength=n_query)
                full = np.flatnonzero(counts == k)
                last = np.cumsum(counts) - 1
                floor[full] = state[2][last[full]]
        self.state = state


@frugal
def _search(batches, blocks, k, tile_rows):
    """blocks: (number, ids, matrix). Gives each query's k best of the task's candidates."""
    from pyspark import TaskContext

    lists = [(number, _Lists(ids, block, k, tile_rows)) for number, ids, block in blocks]
    for batch in batches:
        for ids, matrix in _matrices(batch):
            for _, one in lists:
                one.add(ids, matrix)
    task = TaskContext.get().partitionId()
    for number, one in lists:
        q, ids, scores = one.state
        same = lambda v: pa.array(np.full(len(q), v, np.int64))
        yield pa.RecordBatch.from_arrays([same(task), same(number), pa.array(one.block_ids[q]), pa.array(q), pa.array(ids), pa.array(scores)], names=[x.split()[0] for x in LIST.split(", ")])


LIST = "task long, block long, query_id long, query_row long, vec_id long, score long"
#: Lists that one step of the merge tree makes one, and bytes of query blocks that go out at once.
FAN, BUNDLE_BYTES = 16, 16 << 20


def _merged(lists: DataFrame, tasks: int, k: int) -> DataFrame:
    """The lists of all tasks as one for each query, with ranks: FAN at a time, so that no step gathers more
    than FAN * k rows of a query."""
    while True:
        last = tasks <= FAN
        w = Window.partitionBy("block", "query_row", *([] if last else ["task"])).orderBy(F.desc("score"), "vec_id")
        step = lists if last else lists.withColumn("task", F.floor(F.col("task") / FAN))
        lists = step.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        if last:
            return lists
        tasks = -(-tasks // FAN)


@frugal
def _pack(batches, block_rows):
    pending: dict[int, list] = {}

    def out(dim, parts):
        ids, matrix = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        for at in range(0, len(ids), block_rows):
            part = np.ascontiguousarray(matrix[at : at + block_rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([ids[at : at + block_rows].tobytes()], pa.binary()), pa.array([part.tobytes()], pa.binary())],
                names=["dim", "ids", "matrix"],
            )

    for batch in batches:
        for ids, matrix in _matrices(batch):
            pending.setdefault(matrix.shape[1], []).append((ids, matrix))
            if sum(len(p[0]) for p in pending[matrix.shape[1]]) >= block_rows:
                yield from out(matrix.shape[1], pending.pop(matrix.shape[1]))
    for dim, parts in pending.items():
        yield from out(dim, parts)


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, block_rows: int = 4096, tile_rows: int = 1024) -> DataFrame:
    """For each row of queries(id, vector) its k best rows of vectors(id, vector) by integer inner product.

    Returns query_id long, rank int, vec_id long, score long.
    """
    spark = queries.sparkSession
    ship(spark)
    n = queries.count()
    packed = saved(
        queries.repartition(max(1, -(-n // block_rows))).mapInArrow(lambda it: _pack(it, block_rows), "dim int, ids binary, matrix binary"), "top-k-blocks"
    )
    done, bundle, held = [], [], 0

    def search():
        shared = spark.sparkContext.broadcast(list(bundle))
        lists = saved(vectors.mapInArrow(lambda it: _search(it, shared.value, k, tile_rows), LIST), "top-k-lists")
        tasks = (lists.agg(F.max("task")).first()[0] or 0) + 1
        shared.unpersist()
        done.append(_merged(lists, tasks, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))

    for number, row in enumerate(packed.toLocalIterator()):
        ids = np.frombuffer(row["ids"], np.int64)
        bundle.append((number, ids, np.frombuffer(row["matrix"], np.float64).reshape(len(ids), row["dim"])))
        held += len(row["matrix"])
        if held >= BUNDLE_BYTES:
            search()
            bundle, held = [], 0
    if bundle:
        search()
    if not done:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if len(done) == 1:
        return done[0]
    out = scratch(spark, "top-k")
    for found in done:  # one bundle's tree at a time
        found.write.mode("append").parquet(out)
    return spark.read.schema(done[0].schema).parquet(out)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of embeddings whose vec_id is divisible by 50, against all rows: the 5 best of each."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return exact_top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, k=5)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
