"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. Each decision, in each context of 0 to `depth` bytes, is a node with a
Krichevsky-Trofimov estimate, and a node mixes its own estimate with that of the contexts one byte longer in the ratio in
which both have coded the training texts; so the model is the weighted mixture of all context trees.

Each task sends the distinct grams (depth + 1 bytes) and words of each slice of text, with their counts in training
texts. Counts are summed by key; nodes below a context of two bytes are worked out where its grams meet, and only the
nodes of contexts of no and one byte, at most 257 * 255 of them whatever the corpus, pass through the driver. Then each
slice gets its own grams' probabilities back, ahead of its texts in one sort, and scores them. A gram that training texts
lack is in the table too, with count 0, so that it falls back on shorter contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import tables, text

#: Bytes of the longest context; bytes of text of a slice, which has one table of grams, and of what is worked on at once.
DEPTH, SLICE_BYTES, CHUNK_BYTES = 4, 16 << 20, 2 << 20
#: No UTF-8 text holds this byte: it ends a text, and stands before it.
END = 0xFF
#: Grams that are worked on at once, and positions.
RUN, BLOCK = 1 << 20, 1 << 20
GRAM, WORD, TEXTS = 0, 1, 2


def in_fold(id_col: Column | str, fold: int = 1, of: int = 5) -> Column:
    """Whether an id falls into a fold by the CRC-32 of its text; a null id falls into none."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % of == fold, F.lit(False))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log(gamma(x)) for x >= 0.5, by Stirling's series from x + 8 on."""
    y = x + 8.0
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """Grams of all bytes of texts and of their ends, in order: the context, nearest byte first, then the byte."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    padded = np.full(len(data) + depth * (n + 1) + 8, END, np.uint8)
    padded[np.arange(8, 8 + len(data)) + np.repeat(depth * np.arange(1, n + 1), lengths)] = data
    symbol = padded[8:] != END
    symbol[offsets[1:] + depth * np.arange(1, n + 1)] = True
    before = np.ndarray(len(padded) - 8, "<u8", padded, 0, (1,))
    for a in range(0, len(symbol), BLOCK):
        key = before[a : a + BLOCK] >> np.uint64(8 * (8 - depth))
        yield ((key << np.uint64(8)) | padded[8 + a : 8 + a + BLOCK])[symbol[a : a + BLOCK]].view(np.int64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, A-Z as a-z, and the number of each word's text."""
    starts, ends, first = text.words(data, offsets, text.SPACED)
    return text.span_hashes(data, starts, ends).view(np.int64), np.repeat(np.arange(len(offsets) - 1), np.diff(first))


class _Counts:
    """Distinct keys with their counts in training texts, merged as they grow."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        for part, weight in ((keys[train], 1), (keys[~train], 0)):
            if len(part):
                k, n = np.unique(part, return_counts=True)
                self.parts.append((k, n * weight))
                self.size += len(k)
        if self.size > 2 * RUN:
            self.parts = [self.all()]
            self.size = len(self.parts[0][0])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(n, first)


def _terms(kind: str) -> str:
    return f"slice long, kind int, h long, n long, ids array<{kind}>, held array<boolean>, sizes array<long>, blob binary"


def gather(docs: DataFrame, depth: int) -> DataFrame:
    """Slices of docs (doc_id, text, held): rows of kind GRAM and WORD with key and count, and TEXTS, compressed.

    Written in the shared folder, so a slice is the same whenever it is read.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    fields = tables.arrow_fields(spark, _terms(kind))
    schema = pa.schema(fields)
    tables.small_batches(spark)

    def rows(slice_id: int, kind: int, size: int, **columns) -> pa.RecordBatch:
        columns |= {"slice": pa.array(np.full(size, slice_id)), "kind": pa.array(np.full(size, kind, np.int32))}
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_id, size, codec = TaskContext.get().partitionId() << 32, 0, pa.Codec("zstd")
        found = {GRAM: _Counts(), WORD: _Counts()}

        def flush() -> Iterator[pa.RecordBatch]:
            for k, counts in found.items():
                keys, n = counts.all()
                for a in range(0, len(keys), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    yield rows(slice_id, k, len(keys[part]), h=pa.array(keys[part]), n=pa.array(n[part]))
                found[k] = _Counts()

        for batch in batches:
            for a, b, data, offsets in text.slices(batch.column("text"), CHUNK_BYTES):
                held, at = np.asarray(batch.column("held").slice(a, b - a)), 0
                train = np.repeat(~held, np.diff(offsets) + 1)
                for keys in grams(data, offsets, depth):
                    found[GRAM].add(keys, train[at : at + len(keys)])
                    at += len(keys)
                hashes, of = word_hashes(data, offsets)
                found[WORD].add(hashes, ~held[of])
                ids = pa.array([batch.column("doc_id").slice(a, b - a).to_pylist()], schema.field("ids").type)
                blob = codec.compress(data.tobytes(), asbytes=True)
                yield rows(slice_id, TEXTS, 1, ids=ids, held=pa.array([held.tolist()]), sizes=pa.array([np.diff(offsets).tolist()], pa.list_(pa.int64())).cast(schema.field("sizes").type), blob=pa.array([blob]))
                size += len(data)
                if size >= SLICE_BYTES:
                    yield from flush()
                    slice_id, size = slice_id + 1, 0
        yield from flush()

    path = tables.new_path(spark, "slices")
    docs.mapInArrow(run, _terms(kind)).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    return spark.read.schema(_terms(kind)).parquet(path)


def _nodes(keys: np.ndarray, n: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one binary level over sorted (context, byte) keys: first entry and node of each entry, zeros, ones, and
    each entry's bit."""
    node = keys >> np.int64(8 - level)
    first = np.concatenate(([True], node[1:] != node[:-1]))
    of = np.cumsum(first) - 1
    bit = (keys >> np.int64(7 - level)) & 1
    total, ones = np.bincount(of, n), np.bincount(of, n * bit)
    return np.flatnonzero(first), of, total - ones, ones, bit


def _bit_estimate(zeros: np.ndarray, ones: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1.0)


def subtrees(keys: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """All of the trees below contexts of two bytes, from sorted grams that are complete for these.

    Returns the probability of each gram's eight bits as mixed over depths 2 to `depth`, and of the nodes of depth 2
    the number of their parent (nearest byte * 256 + bits so far, with a leading 1), zeros, ones, log of the weighted
    probability.
    """
    n, q = n.astype(float), np.empty((len(keys), 8))
    entries, counts, back = keys, n, np.arange(len(keys))
    below: list[tuple[np.ndarray, np.ndarray]] = []
    top: list[tuple[np.ndarray, ...]] = []
    for d in range(depth, 1, -1):
        if d < depth:
            entries, inverse = np.unique(((entries >> 16) << 8) | (entries & 255), return_inverse=True)
            counts, back = np.bincount(inverse, counts), inverse[back]
        weighted = []
        for level in range(8):
            first, of, zeros, ones, bit = _nodes(entries, counts, level)
            own = log_kt(zeros, ones)
            at = of[back]
            estimate = _bit_estimate(zeros[at], ones[at], bit[back])
            if d == depth:
                q[:, level], mixed = estimate, own
            else:
                child_first, child = below[level]
                under = np.bincount(of[inverse[child_first]], child, len(first))
                share = 1 / (1 + np.exp(np.minimum(under - own, 700)))
                q[:, level] = share[at] * estimate + (1 - share[at]) * q[:, level]
                mixed = np.logaddexp(own, under) - np.log(2)
            weighted.append((first, mixed))
            if d == 2:
                byte = entries[first] & 255
                top.append((((entries[first] >> 16) << 8) | (1 << level) | (byte >> (8 - level)), zeros, ones, mixed))
        below = weighted
    return q, tuple(np.concatenate(x) for x in zip(*top))


def _whole_subtrees(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of (grams, counts) of a sorted stream, cut where the nearest two bytes change."""
    held: list[np.ndarray] = []
    size, shift = 0, np.int64(8 * (depth - 1))
    for batch in batches:
        part = np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in ("h", "n")])
        cuts = np.flatnonzero(np.diff(part[0] >> shift)) + 1
        starts_new = not held or held[-1][0, -1] >> shift != part[0, 0] >> shift if part.shape[1] else False
        cut = int(cuts[-1]) if len(cuts) else 0
        if part.shape[1] and size >= RUN and (cut or starts_new):
            yield tuple(np.concatenate([*held, part[:, :cut]], 1))
            held, size, part = [], 0, part[:, cut:]
        if part.shape[1]:
            held.append(part)
            size += part.shape[1]
    if held:
        yield tuple(np.concatenate(held, 1))


class Top:
    """The nodes of contexts of one and of no byte."""

    def __init__(self, rows: list):
        node, zeros, ones, under = (np.array([r[k] for r in rows], t) for k, t in enumerate((np.int64, float, float, float)))
        self.zeros, self.ones, below = (np.bincount(node, x, 1 << 16) for x in (zeros, ones, under))
        own = log_kt(self.zeros, self.ones)
        self.share = 1 / (1 + np.exp(np.minimum(below - own, 700)))
        mixed = (np.logaddexp(own, below) - np.log(2)).reshape(256, 256).sum(0)
        self.root_zeros, self.root_ones = (x.reshape(256, 256).sum(0) for x in (self.zeros, self.ones))
        own = log_kt(self.root_zeros, self.root_ones)
        self.root_share = 1 / (1 + np.exp(np.minimum(mixed - own, 700)))

    def log10(self, keys: np.ndarray, q: np.ndarray, depth: int) -> np.ndarray:
        """log10 of the probability of each gram's byte, from its bits' probabilities from depth 2 on."""
        byte, near, total = keys & 255, (keys >> np.int64(8 * depth)) << 8, np.zeros(len(keys))
        for level in range(8):
            prefix, bit = (1 << level) | (byte >> (8 - level)), (byte >> (7 - level)) & 1
            at = near | prefix
            p = self.share[at] * _bit_estimate(self.zeros[at], self.ones[at], bit) + (1 - self.share[at]) * q[:, level]
            p = self.root_share[prefix] * _bit_estimate(self.root_zeros[prefix], self.root_ones[prefix], bit) + (1 - self.root_share[prefix]) * p
            total += np.log10(p)
        return total


def model(grams_found: DataFrame, depth: int) -> DataFrame:
    """h and value (log10 of the byte's probability after its context) of all grams (h, n)."""
    spark = grams_found.sparkSession
    counts = tables.keep(grams_found.groupBy("h").agg(F.sum("n").alias("n")), "grams")
    near = F.shiftright("h", 8 * (depth - 1))
    together = counts.repartition(near).sortWithinPartitions("h")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _whole_subtrees(batches, depth):
            node, *parts = subtrees(keys, n, depth)[1]
            distinct, of = np.unique(node, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(distinct), *(pa.array(np.bincount(of, x)) for x in parts)], ["node", "zeros", "ones", "mixed"])

    # One row for each node of a context of one byte: at most 256 * 255, whatever the corpus.
    top = Top(together.mapInArrow(nodes, "node long, zeros double, ones double, mixed double").groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("mixed")).collect())
    shared = spark.sparkContext.broadcast(top)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _whole_subtrees(batches, depth):
            value = shared.value.log10(keys, subtrees(keys, n, depth)[0], depth)
            for a in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 16)]), pa.array(value[a : a + (1 << 16)])], ["h", "value"])

    return together.mapInArrow(values, "h long, value double")


class _Lookup:
    """Values by key, in a table of open addresses."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values, self.shift, self.mask = keys, values, np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            lost = self.table[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0)
        at = self._slot(keys)
        found = self.table[at]
        wrong = np.flatnonzero(self.keys[found] != keys)
        while len(wrong):
            if (found[wrong] < 0).any():
                raise ValueError("a slice lacks a key of its own texts")
            at[wrong] = (at[wrong] + 1) & self.mask
            found[wrong] = self.table[at[wrong]]
            wrong = wrong[self.keys[found[wrong]] != keys[wrong]]
        return self.values[found]


def score(docs: DataFrame, held_out: Column | None = None, text_col: str = "text", id_col: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """Scores of all rows of docs under models of the texts that aren't held out.

    Returns per row doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, as the query's contract has
    them, and n_bytes and bits_per_byte (code length of the text and its end over bytes and end). held_out is by default
    fold 1 of 5 of the id's CRC-32; a null id is not held out. Null texts are empty: they have an end only. Repeated rows
    count each; other columns aren't read; an empty table gives no rows. Without training texts all counts are 0 and each
    bit has probability 1/2. Whole texts are read, of any length; a text over CHUNK_BYTES is worked on alone. Words are told
    apart by 64-bit hashes. depth is 2 to 6.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth is 2 to 6")
    spark = docs.sparkSession
    held_out = in_fold(id_col) if held_out is None else F.coalesce(held_out, F.lit(False))
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out.alias("held"))
    kind = named.schema["doc_id"].dataType.simpleString()
    slices = gather(named, depth)
    words = slices.where(F.col("kind") == WORD).groupBy("h").agg(F.sum("n").alias("n"))
    values = model(slices.where(F.col("kind") == GRAM), depth).select(F.lit(GRAM).alias("kind"), "h", "value").union(words.select(F.lit(WORD), "h", F.col("n").cast("double")))
    values = tables.keep(values, "model")
    n_words, distinct = values.where(F.col("kind") == WORD).agg(F.sum("value").cast("long"), F.count_if(F.col("value") > 0)).first()
    ends = slices.where(F.col("kind") == TEXTS).agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    total, distinct = (n_words or 0) + ends, distinct + (ends > 0)

    answers = slices.where(F.col("kind") != TEXTS).select("slice", "kind", "h").join(values, ["kind", "h"])
    none = lambda c: F.lit(None).cast(slices.schema[c].dataType).alias(c)
    packed = ("ids", "held", "sizes", "blob")
    both = answers.select("slice", "kind", "h", "value", *map(none, packed)).union(slices.where(F.col("kind") == TEXTS).select("slice", "kind", none("h"), F.lit(None).cast("double").alias("value"), *packed))
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    id_type = tables.arrow_fields(spark, f"doc_id {kind}")[0].type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, current, held, tables_of = pa.Codec("zstd"), None, {}, {}

        def table(kind: int) -> _Lookup:
            if kind not in tables_of:
                keys, found = (np.concatenate(x) for x in zip(*held.pop(kind, [(np.zeros(0, np.int64), np.zeros(0))])))
                tables_of[kind] = _Lookup(keys, found)
            return tables_of[kind]

        for batch in batches:
            ids, kinds = (np.asarray(batch.column(c)) for c in ("slice", "kind"))
            edges = np.flatnonzero(np.diff(ids) | np.diff(kinds)) + 1
            for a, b in zip([0, *edges], [*edges, len(ids)]):
                if b == a:
                    continue
                if ids[a] != current:
                    current, held, tables_of = ids[a], {}, {}
                part = batch.slice(a, b - a)
                if kinds[a] != TEXTS:
                    held.setdefault(int(kinds[a]), []).append((np.asarray(part.column("h")), np.asarray(part.column("value"))))
                    continue
                for row in range(b - a):
                    lengths = np.asarray(part.column("sizes")[row].values)
                    offsets = np.concatenate(([0], np.cumsum(lengths)))
                    data = np.frombuffer(codec.decompress(part.column("blob")[row].as_buffer(), int(offsets[-1])), np.uint8)
                    logs = np.concatenate([table(GRAM)(keys) for keys in grams(data, offsets, depth)])
                    scores = np.add.reduceat(logs, offsets[:-1] + np.arange(len(lengths)))
                    hashes, of = word_hashes(data, offsets)
                    c = table(WORD)(hashes)
                    log_c = lambda x: np.log10((x + 0.5) / (total + 0.5 * (distinct + 1)))
                    base = np.bincount(of, log_c(c), len(lengths)) + log_c(float(ends))
                    columns = [
                        pa.array(part.column("ids")[row].as_py(), id_type), part.column("held")[row].values, pa.array(np.bincount(of, minlength=len(lengths)) + 1),
                        pa.array((np.bincount(of, c > 0, len(lengths)) + (ends > 0)).astype(np.int64)), pa.array(np.full(len(lengths), total, np.int64)), pa.array(base), pa.array(scores),
                        pa.array(lengths), pa.array(-scores * np.log2(10) / (lengths + 1)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])

    return both.repartition("slice").sortWithinPartitions("slice", "kind", "h").mapInArrow(run, result)


def op11_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
