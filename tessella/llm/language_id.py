"""Language ID with bit-sliced Bloom filters over byte n-grams.

One Bloom filter per language, stored side by side: each place of the table holds a mask with a bit for each language,
so k lookups and an AND give all languages that hold an n-gram. A mask has 64 bits at most; each further 64 languages have
a table of their own. Per-language counts of a text, corrected for each
filter's false positives, decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import tables, text

#: Bytes of an n-gram, hash functions of a filter, and the n-grams of a language that make 1 / LOAD of its bits.
WIDTH, HASHES, LOAD = 4, 3, 8
#: A language holds an n-gram that it uses at least this share as often as the language that uses it most.
SHARE = 0.35
#: N-grams that occur once are noise where a language has this many that occur again; where it has fewer, they are all there is.
FEW = 2000
UNKNOWN = "und"

#: Capital letters become small; ASCII that isn't a letter becomes a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all rows as 32-bit numbers, and the first of each row. None crosses rows or is all space."""
    d = _FOLD[data].astype(np.uint32)
    n = len(d) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    out = (d[:n] << 24) | (d[1 : n + 1] << 16) | (d[2 : n + 2] << 8) | d[3 : n + 3]
    good = out != 0x20202020
    for back in range(1, WIDTH):
        at = offsets[1:-1] - back
        good[at[(at >= 0) & (at < n)]] = False
    return out[good], np.concatenate(([0], np.cumsum(good)))[np.minimum(offsets, n)]


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - bits)
    out = []
    for _ in range(HASHES):
        out.append((h >> shift).astype(np.int64))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out


@dataclass
class Model:
    """Languages in the order of their bits, a table of masks for each 64 of them, and each filter's rate of false positives."""

    languages: list[str]
    tables: list[np.ndarray]
    bits: int
    false_rate: np.ndarray

    @classmethod
    def build(cls, language: np.ndarray, gram: np.ndarray, count: np.ndarray) -> "Model":
        """From counts of each n-gram in each language."""
        names = sorted(set(language.tolist()))
        which = np.searchsorted(names, language)
        share = count / np.bincount(which, weights=count, minlength=len(names))[which]
        keys, key = np.unique(gram, return_inverse=True)
        best = np.zeros(len(keys))
        np.maximum.at(best, key, share)
        few = np.bincount(which[count > 1], minlength=len(names)) < FEW
        held = (share >= SHARE * best[key]) & ((count > 1) | few[which])
        most = int(np.bincount(which[held], minlength=1).max()) if held.any() else 1
        bits = max(10, math.ceil(math.log2(most * LOAD)))
        masks, fill = [], []
        for first in range(0, len(names), 64):
            here = range(first, min(first + 64, len(names)))
            kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= len(here))
            table = np.zeros(1 << bits, kind)
            for i in here:
                for place in _places(gram[held & (which == i)], bits):
                    table[place] |= kind(1) << kind(i - first)
            fill += [float(((table >> kind(i - first)) & kind(1)).mean()) for i in here]
            masks.append(table)
        return cls(names, masks, bits, np.array(fill) ** HASHES)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row, corrected counts of its n-grams in each language; and how many n-grams it has."""
        found, first = grams(data, offsets)
        a, b, c = _places(found, self.bits)
        n = np.diff(first)
        out = np.zeros((len(n), len(self.languages)))
        for k, table in enumerate(self.tables):
            masks, kind = table[a] & table[b] & table[c], table.dtype.type
            for i in range(64 * k, min(64 * k + 64, len(self.languages))):
                total = np.concatenate(([0], np.cumsum((masks >> kind(i - 64 * k)) & kind(1), dtype=np.int64)))
                out[:, i] = total[first[1:]] - total[first[:-1]]
        return np.maximum(0, (out - n[:, None] * self.false_rate) / (1 - self.false_rate)), n


def _held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", per_language: int = 4000) -> Model | None:
    """Fit filters on labelled rows whose crc32(id) mod 5 isn't 0; None if there are none.

    Fits on a bounded sample: rows whose hash falls under per_language / (labelled rows of the language), about
    `per_language` whole texts of each language, or all where there are fewer. The n-gram counts that come to the
    driver are bounded by that sample, at any size of corpus. Every language with an n-gram in its sample is learned, be it of
    one short text.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(_held_out(id_col), F.lit(True)))
    there = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not there:
        return None
    level = F.create_map(*(F.lit(x) for k, n in there.items() for x in (k, min(1.0, per_language / n))))
    u = (F.xxhash64(F.col(id_col).cast("string"), F.lit(7)).bitwiseAND(0xFFFFFFFF)) / float(1 << 32)
    sample = labelled.where(u < level[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    tables.small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text.slices(batch.column(1)):
                found, first = grams(data, offsets)
                labels = batch.column(0).slice(a, b - a).to_pylist()
                for name in sorted(set(labels)):
                    own = np.repeat(np.array([x == name for x in labels]), np.diff(first))
                    keys, n = np.unique(found[own], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A window over the n-grams of a language's sample, whose size is bounded.
    again = F.count_if(F.col("n") > 1).over(Window.partitionBy("lang"))
    counted = counted.withColumn("again", again).where((F.col("n") > 1) | (F.col("again") < FEW)).drop("again").toPandas()
    if not len(counted):
        return None
    return Model.build(counted["lang"].to_numpy(), counted["gram"].to_numpy().astype(np.uint32), counted["n"].to_numpy())


def lettered(data: np.ndarray, offsets: np.ndarray) -> list[bool]:
    """Whether each text has a letter of any alphabet."""
    plain = np.diff(np.concatenate(([0], np.cumsum((_FOLD[data] > 32) & (data < 128))))[offsets]) > 0
    return [bool(p) or any(c.isalpha() for c in data[a:b].tobytes().decode()) for p, a, b in zip(plain, offsets, offsets[1:])]


def classify(m: Model | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    names: list[str] = []
    scores: list[float] = []
    for a, b, data, offsets in text.slices(texts):
        if m:
            counts, n = m.counts(data, offsets)
            best = counts.argmax(1)
            score = np.clip(counts[np.arange(b - a), best] / np.maximum(n, 1), 0.0, 1.0)
        for k, spoken in enumerate(lettered(data, offsets)):
            if m and spoken:
                names.append(m.languages[best[k]])
                scores.append(float(score[k]))
            else:
                names.append(UNKNOWN)
                scores.append(0.0)
    return names, scores


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """lang_pred and score of each whole text: id_col, lang_pred, score.

    Null texts and texts without a letter are `und` with score 0, as are all texts if there is no model. The score is
    the corrected share of n-grams that the language holds, 0 to 1; ties go to the language first in the alphabet. A
    text of letters too short for an n-gram gets that language with score 0. Repeated rows are predicted each; other
    columns aren't read. A narrow stage of one pass; the model is bounded by its training sample and goes to the tasks
    in a broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    tables.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = classify(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows and columns of docs whose text has a language; texts that are `und` go.

    Without a model (no labelled text) nothing is known against a text with a letter: only null texts and those without any go.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    tables.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value:
                known = [x != UNKNOWN for x in classify(shared.value, batch.column(at))[0]]
            else:
                known = [x for _, _, data, offsets in text.slices(batch.column(at)) for x in lettered(data, offsets)]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, train(docs))
    return out.select("doc_id", F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
