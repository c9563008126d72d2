"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a run of texts within a task. Its words become numbers of the benchmark's vocabulary; words that no item
has break the sequence, since no window can hold them, and runs shorter than the shortest window are left out. The
FM-index of what remains (suffix order, Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions)
answers all windows of all items by backward search and locates each occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import tables, text

#: Words of a window, bytes of a shard, and distance of sampled suffix positions.
WINDOW, SHARD_BYTES, SAMPLE = 10, 1 << 20, 8
#: Bytes of benchmark text that go to the tasks at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 32 << 20
_HITS = "array<struct<ws:int,we:int,bs:int,be:int>>"


class WaveletMatrix:
    """Ranks of symbols in a sequence of numbers below 2**levels."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.levels, self.ones, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(before), before.copy()
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            ones, zeros = self.ones[k], self.zeros[k]
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low


def suffix_order(values: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; the last value must be the only one of its kind."""
    _, rank = np.unique(values, return_inverse=True)
    rank, n, k = rank.astype(np.int64), len(values), 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = new
        if rank.max(initial=0) == n - 1:
            return order
        k *= 2


class FMIndex:
    """Counts and places of words in a sequence of numbers of at least 1."""

    def __init__(self, values: np.ndarray) -> None:
        closed = np.append(values, 0)
        order = suffix_order(closed)
        levels = max(1, int(closed.max()).bit_length())
        last = closed[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(closed, minlength=1 << levels))))
        self.last, self.matrix, self.n = last, WaveletMatrix(last, levels), len(closed)
        self.marked = order % SAMPLE == 0
        self.sampled = np.where(self.marked, order, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each row of words, read from its end."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        high[(patterns >= 1 << self.matrix.levels).any(1)] = 0  # words that this sequence has no numbers for
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = np.minimum(patterns[:, k], (1 << self.matrix.levels) - 1)
            low, high = self.before[c] + self.matrix.rank(c, low), self.before[c] + self.matrix.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of ranks of suffixes: steps back to the next sampled one."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while todo.size:
            there = self.marked[rows[todo]]
            done = todo[there]
            out[done] = self.sampled[rows[done]] + steps[done]
            todo = todo[~there]
            c = self.last[rows[todo]]
            rows[todo] = self.before[c] + self.matrix.rank(c, rows[todo])
            steps[todo] += 1
        return out


class Benchmark:
    """The windows of a block of items: vocabulary (sorted word hashes) and windows of each length as numbers."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        self.window = window
        found: dict[int, list[tuple[bytes, int]]] = {}
        self.items = [i for i, _ in items]
        hashes = []
        for _, body in items:
            (_, _, data, offsets), *_ = [*text.slices(pa.array([body], pa.large_string()), 1 << 40)]
            starts, ends, _ = text.words(data, offsets, text.ALPHANUMERIC)
            hashes.append(text.span_hashes(data, starts, ends))
        self.vocabulary = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        for k, h in enumerate(hashes):
            if len(h):
                ids = np.searchsorted(self.vocabulary, h).astype(np.int32) + 2
                width = min(window, len(ids))
                for s in range(len(ids) - width + 1):
                    found.setdefault(width, []).append((ids[s : s + width].tobytes(), k))
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width, pairs in found.items():
            pairs = sorted(set(pairs))
            unique = sorted({w for w, _ in pairs})
            place = {w: i for i, w in enumerate(unique)}
            matrix = np.frombuffer(b"".join(unique), np.int32).reshape(-1, width).astype(np.int64)
            self.windows[width] = matrix, np.array([place[w] for w, _ in pairs]), np.array([k for _, k in pairs])
        self.shortest = min(self.windows, default=0)
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True


def search_shard(bench: Benchmark, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list], dict[int, set]]:
    """Word counts of the rows of a shard, merged hit spans (first word, end word, first byte, end byte) and items."""
    starts, ends, first = text.words(data, offsets, text.ALPHANUMERIC)
    n_words, spans, items = np.diff(first), {}, {}
    if not len(starts) or not bench.windows:
        return n_words, spans, items
    h = text.span_hashes(data, starts, ends)
    some = np.flatnonzero(bench.likely[(h & np.uint64(0xFFFF)).astype(np.int64)])
    place = np.minimum(np.searchsorted(bench.vocabulary, h[some]), len(bench.vocabulary) - 1)
    known = bench.vocabulary[place] == h[some]
    some, place = some[known], place[known]
    if not some.size:
        return n_words, spans, items
    row = np.searchsorted(first, some, "right") - 1
    cut = np.flatnonzero((np.diff(some) != 1) | (np.diff(row) != 0)) + 1
    run = np.concatenate(([0], np.cumsum(np.isin(np.arange(1, len(some)), cut))))
    long = np.bincount(run)[run] >= bench.shortest
    some, place, run = some[long], place[long], run[long]
    if not some.size:
        return n_words, spans, items
    # Number 1 stands between runs; `word` leads from the sequence back to the shard's words.
    shift = np.concatenate(([0], np.cumsum(np.diff(run) != 0)))
    values = np.ones(len(some) + int(shift[-1]), np.int64)
    word = np.full(len(values), -1, np.int64)
    at = np.arange(len(some)) + shift
    values[at], word[at] = place + 2, some
    index = FMIndex(values)
    marks = np.zeros(len(starts) + 1, np.int64)
    for width, (patterns, owner_window, owner_item) in bench.windows.items():
        low, high = index.search(patterns)
        hit = np.flatnonzero(high > low)
        if not hit.size:
            continue
        n = high[hit] - low[hit]
        rank = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        found = word[index.locate(rank)]
        np.add.at(marks, found, 1)
        np.add.at(marks, found + width, -1)
        rows = np.searchsorted(first, found, "right") - 1
        pairs = np.unique(np.stack([rows, np.repeat(hit, n)], 1), axis=0)
        order = np.argsort(owner_window, kind="stable")
        a = np.searchsorted(owner_window[order], pairs[:, 1], "left")
        b = np.searchsorted(owner_window[order], pairs[:, 1], "right")
        for r, x, y in zip(pairs[:, 0].tolist(), a.tolist(), b.tolist()):
            items.setdefault(r, set()).update(owner_item[order[x:y]].tolist())
    # A window lies within one row, but spans of neighbouring rows may touch: cut them at rows.
    hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
    rows = np.searchsorted(first, hit, "right") - 1
    edges = np.flatnonzero((np.diff(hit) != 1) | (np.diff(rows) != 0)) + 1
    for part in np.split(np.arange(len(hit)), edges):
        if part.size:
            r, x, y = int(rows[part[0]]), int(hit[part[0]]), int(hit[part[-1]]) + 1
            spans.setdefault(r, []).append((x - int(first[r]), y - int(first[r]), int(starts[x] - offsets[r]), int(ends[y - 1] - offsets[r])))
    return n_words, spans, items


def _blocks(benchmark: DataFrame, text_col: str, id_col: str) -> list[DataFrame]:
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("body")).where("body is not null")
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("id", "body"), F.lit(n)) == k) for k in range(n)]


def _search(docs: DataFrame, block: DataFrame, text_col: str, window: int) -> DataFrame:
    """The rows with n_words, hits and items of one block of the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark([(r.id, r.body) for r in block.collect()], window))
    at = docs.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"n_words long, hits {_HITS}, items array<string>"])
    hit_type, item_type = (f.type for f in tables.arrow_fields(docs.sparkSession, f"h {_HITS}, i array<string>"))

    tables.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in batches:
            for a, b, data, offsets in text.slices(batch.column(at), SHARD_BYTES):
                n_words, spans, items = search_shard(bench, data, offsets)
                hits = [[dict(zip(("ws", "we", "bs", "be"), x)) for x in spans.get(k, [])] for k in range(b - a)]
                names = [sorted({bench.items[i] for i in items.get(k, ())} - {None}) for k in range(b - a)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n_words), pa.array(hits, hit_type), pa.array(names, item_type)], [*batch.schema.names, "n_words", "hits", "items"])

    return docs.mapInArrow(run, schema)


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_text_col: str, item_id_col: str, window: int) -> DataFrame:
    """docs with n_words, hits and items; docs has only columns of this module's choosing."""
    blocks = _blocks(benchmark, item_text_col, item_id_col)
    if len(blocks) == 1:
        return _search(docs, blocks[0], text_col, window)
    numbered = tables.keep(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = None
    for block in blocks:
        one = _search(numbered.select("_row", text_col), block, text_col, window).select("_row", "n_words", "hits", "items")
        found = one if found is None else found.unionByName(one)
    joined = found.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("h"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    last = lambda done: F.element_at(done, -1)
    grown = lambda done, x: F.struct(last(done)["ws"].alias("ws"), F.greatest(last(done)["we"], x["we"]).alias("we"), last(done)["bs"].alias("bs"), F.greatest(last(done)["be"], x["be"]).alias("be"))
    merge = lambda done, x: F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["we"] >= x["ws"]), F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown(done, x)))).otherwise(F.concat(done, F.array(x)))
    merged = joined.withColumn("hits", F.aggregate("h", F.array().cast(_HITS), merge))
    return numbered.join(merged.select("_row", "n_words", "hits", "items"), "_row").drop("_row")


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_id_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """What of a benchmark each whole text holds: id_col, n_words, hits (merged spans of words and of UTF-8 bytes), items.

    A row for each row of docs. Null texts have no words; items without text are left out, and those without an id hit words but are in no list; repeated items count
    once; an empty benchmark hits nothing; other columns aren't read. One narrow pass: nothing is shuffled. A
    benchmark of over BLOCK_BYTES is searched block by block, over numbered rows in the shared folder, and spans are
    merged.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return _found(named, benchmark, "body", item_text_col, item_id_col, window).select(F.col("id").alias(id_col), "n_words", "hits", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows and columns of docs with all hit spans cut out of their texts."""
    whole = docs.select(F.col(text_col).alias("body"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    found = _found(whole, benchmark, "body", "text", "item_id", WINDOW)
    raw = F.col("body").cast("binary")
    # Pieces between spans: before the first, between neighbours, after the last.
    bounds = F.concat(F.array(F.lit(0)), F.flatten(F.transform("hits", lambda x: F.array(x["bs"], x["be"]))), F.array(F.octet_length("body")))
    piece = lambda k: F.substring(raw, F.element_at("bounds", 2 * k + 1) + 1, F.element_at("bounds", 2 * k + 2) - F.element_at("bounds", 2 * k + 1)).cast("string")
    cleaned = F.when(F.size("hits") == 0, F.col("body")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.size("hits")), piece), ""))
    return found.withColumn("bounds", bounds).select(*(cleaned.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x["we"] - x["ws"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


_SQL_WORDS = "coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
#: All windows of documents against all windows of items.
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.s, dw.k, iw.item_id FROM dw JOIN iw ON iw.k = dw.k AND iw.win = dw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY 1),
g AS (SELECT doc_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(g.n_items, 0) AS n_items, sha256(coalesce(g.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id
"""
