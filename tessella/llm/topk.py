"""Exact top-k inner products with block-at-a-time pruning.

Candidates lie in blocks of similar vectors with the largest and smallest value of each component. A query's bound on
a block is the sum over components of its value times the extreme that makes more of it. Queries visit blocks by
falling bound, score whole blocks, and stop when the next bound is below their k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import tables

#: Vectors of a block, of a group of blocks that a task holds, groups and queries that meet in a task.
BLOCK, GROUP, GROUPS_AT_ONCE, QUERIES = 256, 32768, 4, 8192
_PACKED = "dim int, part long, ids binary, matrix binary"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and floor(scale * x) of each component, for vectors without null or non-finite components. A component that no
    64-bit integer holds is an error, not the nearest one that does."""
    v, limit = F.col(vector_col), float("inf")
    sound = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(limit)))
    whole = lambda x: F.when(F.abs(x.cast("double") * scale) < float(1 << 63), F.floor(x.cast("double") * scale)).otherwise(F.raise_error(F.lit("a scaled component of a vector is beyond 64-bit integers")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, whole).alias("v"))


def _bytes_of(m: np.ndarray) -> bytes:
    """A matrix of integers in the least width of 2, 4 or 8 bytes that holds them all."""
    largest = int(np.abs(m).max(initial=0))
    return m.astype("<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8").tobytes()


def _matrix_of(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (rows * dim) if dim else 8}").reshape(rows, dim)


def _pack(rows: DataFrame, most: int, by_likeness: bool) -> DataFrame:
    """Rows of up to `most` vectors of one dimension each, as matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        part = TaskContext.get().partitionId() << 33

        def out(dim: int) -> pa.RecordBatch:
            nonlocal part
            ids, m = (np.concatenate(x) for x in zip(*held.pop(dim)))
            if by_likeness and dim:
                strongest = np.abs(m).argmax(1)
                order = np.lexsort((m[np.arange(len(m)), strongest], strongest))
                ids, m = ids[order], m[order]
            part += 1
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part], pa.int64()), pa.array([ids.tobytes()]), pa.array([_bytes_of(m)])], ["dim", "part", "ids", "matrix"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                m = flat[(ends[at] - dim)[:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0), np.int64)
                for a in range(0, len(at), most):
                    held.setdefault(dim, []).append((ids[at[a : a + most]], m[a : a + most]))
                    if sum(len(x) for x, _ in held[dim]) >= most:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, _PACKED)


def _unpack(table: pa.Table, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    ids = [np.frombuffer(i.as_py(), "<i8") for i in table.column("ids")]
    return [(i, _matrix_of(m.as_py(), len(i), dim)) for i, m in zip(ids, table.column("matrix"))]


def top_k_of(query_ids: np.ndarray, queries: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query row, id, score) among groups of vectors with other ids; ties to smaller ids."""
    blocks = [(ids[a : a + BLOCK], m[a : a + BLOCK]) for ids, m in groups for a in range(0, len(ids), BLOCK)]
    dim = queries.shape[1]
    most = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    largest = most(queries) * max(most(m) for _, m in blocks) * max(dim, 1)
    if largest >= 1 << 63:
        raise OverflowError("inner products of these vectors may pass 64-bit integers; use a smaller scale")
    kind = np.float64 if largest < 1 << 53 else np.int64
    q = queries.astype(kind)
    high, low = (np.stack([f(m, 0).astype(kind) for _, m in blocks]) for f in (np.max, np.min))
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    lowest, no_id = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    scores, ids = np.full((len(q), k), lowest), np.full((len(q), k), no_id)
    active = np.arange(len(q))
    for turn in range(len(blocks)):
        block = order[active, turn]
        go_on = bound[active, block] >= scores[active, -1]
        active, block = active[go_on], block[go_on]
        if not active.size:
            break
        for b in np.unique(block).tolist():
            at = active[block == b]
            own_ids, m = blocks[b]
            s = (q[at] @ m.astype(kind).T).astype(np.int64)
            s[query_ids[at][:, None] == own_ids] = lowest
            better = (s >= scores[at, -1:]) & (s > lowest)
            some = np.flatnonzero(better.any(1))
            at, s, better = at[some], s[some], better[some]
            columns = np.flatnonzero(better.any(0))
            all_s = np.concatenate((scores[at], s[:, columns]), 1)
            all_i = np.concatenate((ids[at], np.broadcast_to(own_ids[columns], (len(at), len(columns)))), 1)
            by_id = np.argsort(all_i, axis=1, kind="stable")
            all_s, all_i = np.take_along_axis(all_s, by_id, 1), np.take_along_axis(all_i, by_id, 1)
            best = np.argsort(-all_s - 1, axis=1, kind="stable")[:, :k]
            scores[at], ids[at] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_i, best, 1)
    row, place = np.nonzero(scores > lowest)
    return row, ids[row, place], scores[row, place]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """The k highest inner products of each query with all vectors of other ids: query_id, rank, vec_id, score.

    Components become floor(scale * x) and scores are exact integers; ties go to smaller ids. Vectors with null or
    non-finite components, and rows without an id, take no part; vectors of different lengths don't meet. Repeated
    candidate rows are candidates each. Of queries with equal ids and the same or other
    vectors the least vector counts. Products that may pass 64 bits are refused with an error. Empty tables give an empty result. Other
    columns aren't read.

    Groups of blocks meet chunks of queries in a grid of tasks, each of bounded size; each gives at most k rows a
    query, which are ranked per query. No task and no broadcast holds all queries or all vectors. A group moves once for
    each chunk of QUERIES queries, in the least width that holds its numbers.
    """
    groups = tables.keep(_pack(integer_vectors(vectors, id_col, vector_col, scale), GROUP, True), "vectors")
    chunks = tables.keep(_pack(integer_vectors(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v")), QUERIES, False), "queries")
    n = max(1, -(-groups.count() // GROUPS_AT_ONCE))
    placed = groups.withColumn("cell", F.pmod(F.xxhash64("part"), F.lit(n).cast("long")))
    cells = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("cell")
    wanted = chunks.select("dim", F.col("part").alias("chunk"), cells, F.col("ids").alias("query_ids"), F.col("matrix").alias("queries"))

    def score(met: pa.Table) -> pa.Table:
        dim = met.column("dim")[0].as_py()
        query_ids = np.frombuffer(met.column("query_ids")[0].as_py(), "<i8")
        queries = _matrix_of(met.column("queries")[0].as_py(), len(query_ids), dim)
        row, ids, scores = top_k_of(query_ids, queries, _unpack(met, dim), k)
        return pa.table({"query_id": query_ids[row], "vec_id": ids, "score": scores})

    found = placed.join(wanted, ["dim", "cell"]).groupBy("dim", "cell", "chunk").applyInArrow(score, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


#: Every query against every other row, ranked.
OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
