"""Records of JSON feeds from files that are read in many splits.

A file is read in pieces that end at a closing brace, so that it splits wherever there is one. Whether a piece begins inside
of a string is the parity of the quotes before it, and how deep it stands is the sum of the brackets before it, counted as
that parity has it; both are worked out for each split and summed over the splits of a file. Then records are cut out where they
are read; only one that crosses splits is put together from parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Names under which a list of records may stand, in order of preference.
LISTS = ["products", "items", "rows", "records", "data", "catalogue", "catalog"]
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z')
_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[0x7B, 0x5B]] = True
_CLOSE[[0x7D, 0x5D]] = True


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _quotes(b: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that begin or end a string: those after an even run of backslashes."""
    quote = b == 0x22
    if (b == 0x5C).any():
        at = np.arange(len(b))
        other = np.maximum.accumulate(np.where(b != 0x5C, at, -1))
        run = np.concatenate(([0], at[:-1] - other[:-1]))
        quote &= run % 2 == 0
    return quote


def _plain(b: np.ndarray, inside: bool) -> np.ndarray:
    """Which bytes stand outside of strings, quotes not counted in."""
    quote = _quotes(b)
    return ((np.cumsum(quote) + inside) % 2 == 0) & ~quote


class Reader:
    """Goes over the text of a split with what is known of its begin.

    depth: brackets open before the text; lists: lists of a root object begun before it; level: brackets open where a record
    of this file stands; wanted: the number of the list that has them, -1 for any.
    """

    def __init__(self, inside: bool, depth: int, lists: int, level: int, wanted: int):
        self.inside, self.depth, self.lists, self.level, self.wanted = inside, depth, lists, level, wanted

    def places(self, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Begins and ends of records, commas between items of the record list, begins of lists of a root object, and ends of
        items of the record list that are objects or lists."""
        plain = _plain(b, self.inside)
        step = (_OPEN[b] & plain).astype(np.int64) - (_CLOSE[b] & plain)
        after = self.depth + np.cumsum(step)
        before = after - step
        opened = plain & (b == 0x5B) & (before == 1)
        lists = self.lists + np.cumsum(opened)
        ours = plain & (lists == self.wanted) if self.wanted >= 0 else plain
        starts = np.flatnonzero(ours & (b == 0x7B) & (before == self.level))
        ends = np.flatnonzero(ours & (b == 0x7D) & (after == self.level)) + 1
        closed = np.flatnonzero(ours & _CLOSE[b] & (after == self.level)) + 1
        commas = np.flatnonzero(ours & (b == 0x2C) & (before == self.level))
        self.inside, self.depth, self.lists = bool((self.inside + np.count_nonzero(_quotes(b))) % 2), int(after[-1]), int(lists[-1])
        return starts, ends, commas, np.flatnonzero(opened), closed


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch | None, np.ndarray, bool]]:
    """(file and block, a row of it, bytes, whether the split begins) of runs of pieces, each with the brace it ended at."""
    key = None
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        edges = [0, *(k for k in range(1, len(files)) if files[k] != files[k - 1] or blocks[k] != blocks[k - 1]), len(files)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                here = (files[a], blocks[a])
                raw = b"}".join(batch.column("piece").slice(a, b - a).to_pylist()) + b"}"
                yield here, batch.slice(a, 1), np.frombuffer(raw, np.uint8), here != key
                key = here


def _one(names: list[str], values: list, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(n)) for n, v in zip(names, values)], names)


def _measured(spark: SparkSession, path: str) -> DataFrame:
    """file, block, inside and depth at the begin of each split, and root, the first character of its file."""
    names, kinds = ["file", "block", "quotes", "depth_out", "depth_in", "root"], {"root": pa.string()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, quotes, depth, root = None, 0, [0, 0], None
        for here, _, b, begins in _by_split(batches):
            if begins:
                if key:
                    yield _one(names, [*key, quotes % 2, *depth, root], kinds)
                key, quotes, depth, root = here, 0, [0, 0], None
            if root is None:
                head = b.tobytes().lstrip(b"\xef\xbb\xbf \t\r\n")[:1]
                root = head.decode("ascii", "replace") or None
            for s in (0, 1):
                plain = _plain(b, (quotes + s) % 2 == 1)
                depth[s] += int(np.count_nonzero(_OPEN[b] & plain)) - int(np.count_nonzero(_CLOSE[b] & plain))
            quotes += int(np.count_nonzero(_quotes(b)))
        if key:
            yield _one(names, [*key, quotes % 2, *depth, root], kinds)

    found = _pieces(spark, path).mapInArrow(measure, "file string, block long, quotes long, depth_out long, depth_in long, root string")
    by_file = Window.partitionBy("file").orderBy("block")
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    known = found.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    step = F.when(F.col("inside"), F.col("depth_in")).otherwise(F.col("depth_out"))
    known = known.withColumn("step", step).withColumn("root", F.first("root", ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return known.select("file", "block", "inside", F.coalesce(F.sum("step").over(earlier), F.lit(0)).alias("depth"), "root")


def _read(spark: SparkSession, path: str, splits: DataFrame) -> DataFrame:
    """Pieces with what is known of their splits: a short row for each split, which is broadcast."""
    return _pieces(spark, path).join(F.broadcast(splits), ["file", "block"])


def _begin(row: pa.RecordBatch) -> Reader:
    return Reader(*(row.column(c)[0].as_py() for c in ("inside", "depth", "lists", "level", "wanted")))


def _lists(spark: SparkSession, path: str, splits: DataFrame) -> DataFrame:
    """file, block, place, key and filled (its first item is an object) of each list that a root object has as a value."""
    names = ["file", "block", "place", "key", "filled"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, n = None, 0
        for here, row, b, begins in _by_split(batches):
            if begins:
                reader, n = _begin(row), 0
            for at in reader.places(b)[3].tolist():
                raw = b.tobytes() if at < 4096 else b[at - 4096 :].tobytes()
                start = min(at, 4096)
                key = _KEY.search(raw[:start])
                yield _one(names, [*here, n, key[1].decode("utf-8", "replace") if key else "", raw[start + 1 :].lstrip()[:1] == b"{"], {})
                n += 1

    return _read(spark, path, splits).mapInArrow(find, "file string, block long, place long, key string, filled boolean")


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, pos and record (JSON text) of the objects of all files.

    Records are the objects of a root array; of the list that a root object has under the first name of LISTS that it has
    a list under, else of its first list that begins with an object; else the root object. pos counts all items of that
    list, from 0. A file is read three times, or four if its root is an object; no piece is shuffled.
    """
    measured = _measured(spark, path).persist()
    blank = measured.withColumns({"lists": F.lit(0).cast("long"), "level": F.lit(1).cast("long"), "wanted": F.lit(-1).cast("long")})
    if measured.where("root = '{'").head(1):
        found = _lists(spark, path, blank.where("root = '{'"))
        per_split = found.groupBy("file", "block").agg(F.count("*").alias("n"))
        earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        before = blank.where("root = '{'").select("file", "block").join(per_split, ["file", "block"], "left").withColumn("lists", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        rank = F.coalesce(*(F.when(F.col("key") == k, F.lit(i)) for i, k in enumerate(LISTS)), F.when(F.col("filled"), F.lit(len(LISTS))))
        placed = found.join(before.select("file", "block", "lists"), ["file", "block"]).withColumn("rank", rank).where("rank is not null")
        chosen = placed.groupBy("file").agg(F.min(F.struct("rank", (F.col("lists") + F.col("place") + 1).alias("wanted")))["wanted"].alias("chosen"))
        joined = blank.drop("lists").join(before.select("file", "block", "lists"), ["file", "block"], "left").join(chosen, "file", "left")
        is_object = F.col("root") == "{"
        level = F.when(is_object & F.col("chosen").isNull(), 0).when(is_object, 2).otherwise(1).cast("long")
        blank = joined.select("file", "block", "inside", "depth", "root", F.coalesce("lists", F.lit(0)).alias("lists"), level.alias("level"), F.coalesce("chosen", F.lit(-1)).cast("long").alias("wanted"))
    begun = blank.persist()
    names, kinds = ["file", "block", "commas", "head", "tail"], {"head": pa.binary(), "tail": pa.binary()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = reader = None
        commas, head, tail = 0, None, None
        for here, row, b, begins in _by_split(batches):
            if begins:
                if key:
                    yield _one(names, [*key, commas, None if head is None else b"".join(head), None if tail is None else b"".join(tail)], kinds)
                key, reader, commas, tail = here, _begin(row), 0, None
                within = reader.depth > reader.level and (reader.wanted < 0 or reader.lists == reader.wanted)
                head, open_head = ([] if within else None), within
            starts, ends, found, _, closed = reader.places(b)
            commas += len(found)
            raw = b.tobytes()
            if open_head:
                head.append(raw[: int(closed[0])] if len(closed) else raw)
                open_head = not len(closed)
            if len(starts) and (not len(ends) or starts[-1] >= ends[-1]):
                tail = [raw[int(starts[-1]) :]]
            elif tail is not None:
                tail = None if len(ends) else [*tail, raw]
        if key:
            yield _one(names, [*key, commas, None if head is None else b"".join(head), None if tail is None else b"".join(tail)], kinds)

    counted = _read(spark, path, begun).mapInArrow(count, "file string, block long, commas long, head binary, tail binary")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("first", F.coalesce(F.sum("commas").over(earlier), F.lit(0))).persist()
    known = begun.join(counted.select("file", "block", "first"), ["file", "block"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, pos, held = None, 0, None
        for here, row, b, begins in _by_split(batches):
            if begins:
                reader, pos, held = _begin(row), row.column("first")[0].as_py(), None
            starts, ends, commas, *_ = reader.places(b)
            raw, out = b.tobytes(), []
            if held is not None:
                held[1].append(raw[: int(ends[0])] if len(ends) else raw)
                if len(ends):
                    out, held = [(held[0], b"".join(held[1]))], None
            at = np.searchsorted(ends, starts, "right")
            of = pos + np.searchsorted(commas, starts)
            out += [(int(p), raw[int(s) : int(ends[e])]) for p, s, e in zip(of, starts, at) if e < len(ends)]
            if len(starts) and at[-1] == len(ends):
                held = (int(of[-1]), [raw[int(starts[-1]) :]])
            pos += len(commas)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([here[0]] * len(out)), pa.array([p for p, _ in out]), pa.array([r for _, r in out], pa.binary())], ["file", "pos", "record"])

    inner = _read(spark, path, known).mapInArrow(cut, "file string, pos long, record binary")
    parts = counted.where("head is not null").select("file", F.col("first").alias("pos"), "block", F.col("head").alias("part"), F.lit(False).alias("begins"))
    parts = parts.union(counted.where("tail is not null").select("file", F.col("first") + F.col("commas"), "block", "tail", F.lit(True)))
    # Parts are cut at braces, so each is sound UTF-8 of its own. What no object begins is an item that is a list.
    whole = parts.groupBy("file", "pos").agg(F.bool_or("begins").alias("begins"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", F.col("part").cast("string").alias("part")))), lambda x: x["part"]), "").alias("record")).where("begins").drop("begins")
    return inner.select("file", "pos", F.col("record").cast("string").alias("record")).union(whole)
