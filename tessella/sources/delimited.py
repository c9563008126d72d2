"""Records of delimited feeds with quoted line breaks, from files that are read in many splits.

Whether a line begins a record depends on all before it. Lines of a split are therefore followed from both states, outside
and inside of a quoted cell; a row for each split tells the state it ends in from either. Those rows are put together by
windows over a file's splits, which gives each split its true first state and the number of records before it. Lines
then become records where they are read; only a record that crosses splits is put together from parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: The characters of ISO-8859-1 that are other ones in cp1252, and those.
C1 = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
CP1252 = C1.encode("latin-1").decode("cp1252")

_SPLITS = (
    "file string, block long, out_in boolean, in_in boolean, n_out long, n_in long, head binary, tail_out binary, tail_in binary, utf8 boolean, odd boolean"
)


class Quotes:
    """How a line changes the state: inside of a quoted cell (True) or not.

    A quote opens a cell only as its first character, so an inch mark in a cell opens nothing; two quotes within are one;
    what follows a closing quote up to the separator belongs to the cell.
    """

    def __init__(self, sep: str):
        s = re.escape(sep.encode())
        quoted, rest = b'"(?:[^"]|"")*+"', b"[^" + s + b"]*+"
        cell = b"(?:" + quoted + rest + b'|(?:[^"' + s + b"]" + rest + b")?)"
        self.opens = re.compile(b"(?:" + cell + s + b')*+"(?:[^"]|"")*+')
        self.closes = re.compile(b'(?:[^"]|"")*+"' + rest)

    def after(self, line: bytes, inside: bool) -> bool:
        if inside:
            m = self.closes.match(line)
            if not m:
                return True
            line = line[m.end() + 1 :]
        return self.opens.fullmatch(line) is not None

    def states(self, lines: pa.Array, inside: bool) -> np.ndarray:
        """The state before each line, and after the last. Only lines with a quote are looked at."""
        out, at = np.empty(len(lines) + 1, bool), 0
        for k in np.flatnonzero(np.asarray(pc.match_substring(lines, '"'))).tolist():
            out[at : k + 1], at = inside, k + 1
            inside = self.after(lines[k].as_py(), inside)
        out[at:] = inside
        return out


def _runs(batch: pa.RecordBatch, *keys: str) -> Iterator[tuple[int, int]]:
    """Ranges of rows with equal keys."""
    change = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        c = batch.column(k)
        change |= np.asarray(pc.not_equal(c[1:], c[:-1])) if len(change) else change
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    return ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _joined(lines: list[pa.Array]) -> bytes:
    return b"\n".join(x for part in lines for x in part.to_pylist())


def splits(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """A row for each split that holds the begin of a line: file, block, inside (its first state), first (records of the
    file before it), starts (records that begin in it), head and tail (parts of records that cross its ends, else null),
    and encoding of its file (UTF-8 if all bytes are; else cp1252 if that has them all; else ISO-8859-1)."""
    quotes = Quotes(sep)
    names = [x.split()[0] for x in _SPLITS.split(", ")]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, n, head, open_head, tail, utf8, odd = None, [], [], [], True, [], True, False

        def row() -> pa.RecordBatch:
            values = (*key, *state, *n, _joined(head), *(_joined(t) if s else None for t, s in zip(tail, state)), utf8, odd)
            binary = {"head", "tail_out", "tail_in"}
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if c in binary else None) for v, c in zip(values, names)], names)

        for batch in batches:
            for a, b in _runs(batch, "file", "block"):
                here = (batch.column("file")[a].as_py(), batch.column("block")[a].as_py())
                if here != key:
                    if key:
                        yield row()
                    key, state, n, head, open_head, tail, utf8, odd = here, [False, True], [0, 0], [], True, [[], []], True, False
                lines = batch.column("line").slice(a, b - a)
                filled = np.asarray(pc.binary_length(lines)) > 0
                raw = _joined([lines])
                odd = odd or re.search(b"[\x81\x8d\x8f\x90\x9d]", raw) is not None
                try:
                    raw.decode()
                except UnicodeDecodeError:
                    utf8 = False
                for s in (0, 1):
                    before = quotes.states(lines, state[s])
                    starts = np.flatnonzero(~before[:-1] & filled)
                    n[s] += len(starts)
                    if s and open_head:
                        outside = np.flatnonzero(~before)
                        end = int(outside[0]) if len(outside) else len(lines)
                        head.append(lines[:end])
                        open_head = not len(outside)
                    state[s] = bool(before[-1])
                    last = int(starts[-1]) if len(starts) else 0
                    tail[s] = ([] if len(starts) else tail[s]) + [lines[last:]] if state[s] else []
        if key:
            yield row()

    found = _lines(spark, path).mapInArrow(follow, _SPLITS)
    by_file = Window.partitionBy("file").orderBy("block")
    earlier, whole = by_file.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    # A split whose ends are equal sets the state; any other keeps or turns it.
    fixed = F.when(F.col("out_in") == F.col("in_in"), F.struct("out_in", "turns"))
    turned = found.withColumn("turns", F.sum(F.col("out_in").cast("int")).over(by_file)).withColumn("fixed", F.last(fixed, ignorenulls=True).over(earlier))
    turns = F.coalesce(F.lag("turns").over(by_file), F.lit(0))
    inside = F.coalesce(F.col("fixed.out_in") != ((turns - F.col("fixed.turns")) % 2 == 1), turns % 2 == 1)
    known = turned.withColumn("inside", inside).withColumn("starts", F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out")))
    encoding = F.when(F.bool_and("utf8").over(whole), "UTF-8").when(F.bool_or("odd").over(whole), "ISO-8859-1").otherwise("cp1252")
    tail = F.when(F.col("starts") > 0, F.when(F.col("inside"), F.col("tail_in")).otherwise(F.col("tail_out")))
    return known.select("file", "block", "inside", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("first"), "starts", F.when(F.col("inside"), F.col("head")).alias("head"), tail.alias("tail"), encoding.alias("encoding"))


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """file, number (from 0, the header) and record (text in its file's encoding, line breaks as line feeds) of all files.

    Empty lines between records are none; a quote that is never closed runs to its file's end. Files are read twice: once
    for the states, once for the records; no line is shuffled. The table of splits, a short row for each, is broadcast.
    """
    quotes, found = Quotes(sep), splits(spark, path, sep).persist()
    known = found.select("file", "block", "inside", "first", "encoding")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, number, held = None, False, 0, None
        for batch in batches:
            for a, b in _runs(batch, "file", "block"):
                here = (batch.column("file")[a].as_py(), batch.column("block")[a].as_py())
                if here != key:  # what is held crosses the split's end and comes from the table of splits
                    key, held = here, None
                    inside, number = batch.column("inside")[a].as_py(), batch.column("first")[a].as_py()
                lines = batch.column("line").slice(a, b - a)
                states = quotes.states(lines, inside)
                filled = np.asarray(pc.binary_length(lines)) > 0
                starts, ends = np.flatnonzero(~states[:-1] & filled), np.flatnonzero(~states[1:])
                whole: list[bytes] = []
                if held is not None:
                    held.append(lines[: int(ends[0]) + 1 if len(ends) else len(lines)])
                    if len(ends):
                        whole, held = [_joined(held)], None
                at = np.searchsorted(ends, starts)
                done = starts[at < len(ends)]
                until = ends[at[at < len(ends)]] + 1
                if len(done) < len(starts):
                    held = [lines[int(starts[-1]) :]]
                # Lines of complete records, one list for each.
                member = np.zeros(len(lines) + 1, np.int64)
                np.add.at(member, done, 1)
                np.add.at(member, until, -1)
                kept = lines.filter(pa.array(np.cumsum(member)[:-1] > 0))
                offsets = np.concatenate(([0], np.cumsum(until - done))).astype(np.int32)
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), kept), b"\n")
                size = len(whole) + len(texts)
                texts = pa.concat_arrays([pa.array(whole, pa.binary()), texts])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([here[0]] * size, pa.string()), pa.array(np.arange(number, number + size)), texts, pa.array([batch.column("encoding")[a].as_py()] * size, pa.string())],
                    ["file", "number", "record", "encoding"],
                )
                number, inside = number + size, bool(states[-1])

    inner = _lines(spark, path).join(F.broadcast(known), ["file", "block"]).mapInArrow(cut, "file string, number long, record binary, encoding string")
    heads = found.where("head is not null").select("file", (F.col("first") - 1).alias("number"), "block", F.col("head").alias("part"), "encoding")
    tails = found.where("tail is not null").select("file", (F.col("first") + F.col("starts") - 1).alias("number"), "block", F.col("tail").alias("part"), "encoding")
    latin = lambda c: F.decode(c, "ISO-8859-1")
    text = lambda c: F.when(F.col("encoding") == "UTF-8", F.decode(c, "UTF-8")).when(F.col("encoding") == "cp1252", F.translate(latin(c), C1, CP1252)).otherwise(latin(c))
    crossing = heads.union(tails).withColumn("part", text("part")).groupBy("file", "number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]), "\n").alias("record"))
    return inner.select("file", "number", text("record").alias("record")).union(crossing)

