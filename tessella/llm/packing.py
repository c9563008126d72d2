"""Packing of documents into windows by non-negative least squares over a histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import tables, tokens

_COUNTED = "doc_id {kind}, doc_tokens long, part long, start long, length long, ids_crc32 long, rank long"


def combinations(window: int, depth: int = 3) -> np.ndarray:
    """All multisets of up to `depth` (1 to 3) lengths that fill a window; unused places hold 0."""
    out = [np.array([[window, 0, 0]], np.int64)]
    if depth >= 2:
        a = np.arange(1, window // 2 + 1)
        out.append(np.stack([window - a, a, 0 * a], 1))
    if depth >= 3:
        for c in range(1, window // 3 + 1):
            b = np.arange(c, (window - c) // 2 + 1)
            out.append(np.stack([window - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate(out)


def solve_counts(histogram: np.ndarray, combos: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used close to the histogram: projected gradient steps with momentum
    on the squared error, each error weighted by its length (place 0 of the histogram stands for unused places)."""
    histogram = histogram.astype(float)
    histogram[0] = 0.0
    live = (histogram[combos] > 0).all(1, where=combos > 0)
    out = np.zeros(len(combos))
    if not live.any():
        return out
    some = combos[live]
    flat, n = some.ravel(), len(histogram)
    degree = np.maximum(1, np.bincount(flat, minlength=n)).astype(float)
    degree[0] = 1.0
    step = 1.0 / np.maximum(1.0, degree[some].max(1))
    x = last = np.zeros(len(some))
    for k in range(rounds):
        y = x + (k / (k + 3)) * (x - last)
        error = histogram - np.bincount(flat, weights=np.repeat(y, some.shape[1]), minlength=n)
        error[0] = 0.0
        last, x = x, np.maximum(0.0, y + step * error[some].sum(1))
    out[live] = x
    return out


def plan_windows(histogram: np.ndarray, window: int, depth: int = 3) -> list[tuple[list[int], int]]:
    """(lengths of a window, how many such windows) so that every piece of the histogram is used exactly once.

    Rounds the solution down where lengths run out, then packs what is left greedily: the longest length that is
    left, then ever the longest that still fits, repeated as often as all its lengths allow. Works on at most
    `window` counts, whatever the number of documents.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[list[int], int]] = []
    combos = combinations(window, depth)
    x = solve_counts(left, combos)
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.5:
            break
        lengths = [int(v) for v in combos[i] if v]
        times = min(int(np.round(x[i])), *(int(left[v]) // lengths.count(v) for v in lengths))
        if times > 0:
            for v in lengths:
                left[v] -= times
            plan.append((lengths, times))
    while (there := np.flatnonzero(left)).size:
        lengths, room, use = [], window, {}
        while True:
            fits = [int(v) for v in there[: np.searchsorted(there, room, "right")][::-1] if left[v] > use.get(int(v), 0)][:1]
            if not fits:
                break
            v = fits[0]
            use[v] = use.get(v, 0) + 1
            lengths.append(v)
            room -= v
        times = min(int(left[v]) // n for v, n in use.items())
        for v, n in use.items():
            left[v] -= times * n
        plan.append((lengths, times))
    return plan


def _slots(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank of each run of ranks, and that run's first window, offset there and stride."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for lengths, times in plan:
        offset = 0
        for v in lengths:
            runs.setdefault(v, []).append((used.get(v, 0), first, offset))
            used[v] = used.get(v, 0) + times
            offset += v
        first += times
    return {v: tuple(np.array(x, np.int64) for x in zip(*r)) for v, r in runs.items()}


def _pieces(docs: DataFrame, path: str, text_col: str, id_col: str, window: int, end_id: int) -> DataFrame:
    """Encode each text and cut it every `window` ids. A piece's rank counts the pieces of its length in its task."""

    tables.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            for a, b, flat, sizes in tokens.encode_slices(batch.column(1), path):
                flat, sizes = tokens.with_end(flat, sizes, end_id)
                pieces = -(-sizes // window)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                start = (np.arange(len(doc)) - (np.cumsum(pieces) - pieces)[doc]) * window
                length = np.minimum(window, sizes[doc] - start)
                ends = np.cumsum(length).tolist()
                raw = memoryview(flat.astype("<u4")).cast("B")
                sums = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip([0, *ends], ends)]
                order = np.argsort(length, kind="stable")
                per = np.bincount(length, minlength=window + 1)
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - (np.cumsum(per) - per)[length[order]]
                rank += seen[length]
                seen += per
                columns = [batch.column(0).slice(a, b - a).take(pa.array(doc)), sizes[doc], np.full(len(doc), part), start, length, sums, rank]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns], schema=schema)

    kind = docs.schema[id_col].dataType.simpleString()
    ddl = _COUNTED.format(kind=kind)
    schema = pa.schema(tables.arrow_fields(docs.sparkSession, ddl))
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, ddl)


def pack(docs: DataFrame, path: str, end_id: int, window: int = 2048, text_col: str = "text", id_col: str = "doc_id", depth: int = 3) -> DataFrame:
    """Pack every text, ended by end_id, into windows of at most `window` ids with little padding.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A text is cut only
    every `window` ids; whole windows stand alone and the rest of each text (1 to window - 1 ids) is combined with
    others. A null or empty text is one piece of the end id. Repeated rows are packed each. An empty table gives an
    empty result. Other columns of the input aren't read.

    One pass encodes and writes the pieces' lengths and checksums, not their ids, to the shared folder. The driver
    holds only the histogram of at most `window` lengths. A piece's place in its length is its rank in its task plus
    the pieces of that length in the tasks before, a sum per length over a row per task.
    """
    spark = docs.sparkSession
    counted = tables.keep(_pieces(docs, path, text_col, id_col, window, end_id), "pieces")
    per_task = counted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = per_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    histogram = np.zeros(window + 1, np.int64)
    for length, n in per_task.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    slots = spark.sparkContext.broadcast(_slots(plan_windows(histogram, window, depth)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for v in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == v)
                first_rank, first_window, offsets = slots.value[v]
                run = np.searchsorted(first_rank, ranks[at], "right") - 1
                sequence[at], offset[at] = first_window[run] + ranks[at] - first_rank[run], offsets[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = counted.join(before.select("length", "part", "before"), ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank"))
    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.tokenizer_path("byte_bpe_50k.json"), end_id=1)
