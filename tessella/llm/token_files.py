"""Token-id files compressed with a static range asymmetric numeral system (rANS).

A file image holds a run of documents in ascending order of their ids. Layout, all little-endian:

    magic 'TRN1', then six unsigned 64-bit numbers: documents, ids, bytes of the document index, bytes of the
    frequency table, bytes of the checkpoints, payload words
    document index   zlib: ids of documents (int64), null flags (uint8), numbers of token ids (uint32)
    frequency table  zlib: symbols (uint16), frequencies (uint32) that sum to 2**20; all blocks share it
    checkpoints      word offset (uint32) and 256 lane states (uint64) for each run of 128 steps of each block,
                     then a CRC-32 of the token ids of each block (uint32)
    payload          32-bit words, block after block
    CRC-32 (uint32) of all that stands before it

A block is 65,536 ids, dealt in turn to 256 interleaved lanes. Each run of 128 steps starts from stored states and a
stored offset, so all runs of all blocks decode side by side.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import tables, tokens

MAGIC = b"TRN1"
BITS = 20
LANES, STEPS, RUN = 256, 256, 128
BLOCK = LANES * STEPS
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4s6Q")
#: Token ids of a file image, unless one document has more.
FILE_IDS = 4 << 20


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and frequencies of at least 1 that sum to 2**BITS."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols].astype(np.float64)
    freq = np.maximum(1, np.floor(counts * ((1 << BITS) / counts.sum()))).astype(np.int64)
    excess = int(freq.sum()) - (1 << BITS)
    for i in np.argsort(-freq, kind="stable"):
        if excess == 0:
            break
        take = min(excess, int(freq[i]) - 1) if excess > 0 else excess
        freq[i] -= take
        excess -= take
    return symbols.astype(np.uint16), freq.astype(np.uint32)


def _grid(n: int) -> tuple[int, int]:
    """Blocks, and steps of each (a multiple of RUN; only a single block can be short)."""
    blocks = max(1, -(-n // BLOCK))
    return blocks, STEPS if blocks > 1 else RUN * max(1, -(-n // (LANES * RUN)))


def encode_image(doc_ids: np.ndarray, doc_null: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A file image of documents and their token ids, one after another."""
    symbols, freq = frequencies(ids)
    total = len(ids)
    blocks, steps = _grid(total)
    # The place after all symbols stands for padding: its frequency is the whole range, which leaves a state as it is.
    rank = np.full(int(symbols[-1]) + 1, len(symbols), np.int32)
    rank[symbols] = np.arange(len(symbols))
    f = np.append(freq.astype(np.uint64), np.uint64(1 << BITS))
    c = np.append(np.cumsum(freq, dtype=np.uint64) - freq, np.uint64(0))
    grid = np.full(blocks * steps * LANES, len(symbols), np.int32)
    grid[:total] = rank[ids]
    grid = grid.reshape(blocks, steps, LANES)
    x = np.full((blocks, LANES), LOW, np.uint64)
    top = LOW >> np.uint64(BITS) << np.uint64(32)
    words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
    owner: list[np.ndarray] = [np.zeros(0, np.int64)] * steps
    states = np.zeros((blocks, steps // RUN, LANES), np.uint64)
    written = np.zeros((blocks, steps), np.int64)
    for t in range(steps - 1, -1, -1):
        s = grid[:, t]
        ft = f[s]
        over = x >= top * ft
        words[t] = (x[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        written[:, t] = over.sum(1)
        owner[t] = np.repeat(np.arange(blocks), written[:, t])
        x[over] >>= np.uint64(32)
        q = x // ft
        x = (q << np.uint64(BITS)) + (x - q * ft) + c[s]
        if t % RUN == 0:
            states[:, t // RUN] = x
    payload = np.concatenate(words)[np.argsort(np.concatenate(owner), kind="stable")]
    before = np.cumsum(written.reshape(-1)) - written.reshape(-1)
    offsets = before.reshape(blocks, steps)[:, ::RUN].astype("<u4")
    sums = np.array([zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, max(1, total), BLOCK)], "<u4")
    index = zlib.compress(doc_ids.astype("<i8").tobytes() + doc_null.astype(np.uint8).tobytes() + sizes.astype("<u4").tobytes(), 1)
    table = zlib.compress(symbols.astype("<u2").tobytes() + freq.astype("<u4").tobytes(), 1)
    points = offsets.tobytes() + states.astype("<u8").tobytes() + sums.tobytes()
    out = b"".join((_HEAD.pack(MAGIC, len(doc_ids), total, len(index), len(table), len(points), len(payload)), index, table, points, payload.astype("<u4").tobytes()))
    return out + struct.pack("<I", zlib.crc32(out))


def decode_image(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, null flags, sizes and all token ids of a file image. A wrong checksum raises ValueError."""
    magic, n_docs, total, n_index, n_table, n_points, n_words = _HEAD.unpack_from(image)
    if magic != MAGIC or zlib.crc32(image[:-4]) != struct.unpack("<I", image[-4:])[0]:
        raise ValueError("not a token file, or a damaged one")
    at = _HEAD.size
    index, at = zlib.decompress(image[at : at + n_index]), at + n_index
    table, at = zlib.decompress(image[at : at + n_table]), at + n_table
    points, at = image[at : at + n_points], at + n_points
    payload = np.frombuffer(image, "<u4", n_words, at)
    doc_ids = np.frombuffer(index, "<i8", n_docs)
    doc_null = np.frombuffer(index, np.uint8, n_docs, 8 * n_docs).astype(bool)
    sizes = np.frombuffer(index, "<u4", n_docs, 9 * n_docs).astype(np.int64)
    n_symbols = len(table) // 6
    symbols, freq = np.frombuffer(table, "<u2", n_symbols), np.frombuffer(table, "<u4", n_symbols, 2 * n_symbols)
    blocks, steps = _grid(total)
    runs = blocks * (steps // RUN)
    ptr = np.frombuffer(points, "<u4", runs).astype(np.int64)
    x = np.frombuffer(points, "<u8", runs * LANES, 4 * runs).reshape(runs, LANES).copy()
    sums = np.frombuffer(points, "<u4", -1, 4 * runs + 8 * runs * LANES)
    place = np.repeat(np.arange(n_symbols, dtype=np.uint16), freq)
    f, c = freq.astype(np.uint64), np.cumsum(freq, dtype=np.uint64) - freq
    out = np.zeros((runs, RUN, LANES), np.uint16)
    first = (np.arange(runs) // (steps // RUN)) * (steps * LANES) + (np.arange(runs) % (steps // RUN)) * (RUN * LANES)
    lane = np.arange(LANES)
    full = bool(total == runs * RUN * LANES)
    for t in range(RUN):
        slot = x & np.uint64((1 << BITS) - 1)
        s = place[slot]
        out[:, t] = symbols[s]
        y = f[s] * (x >> np.uint64(BITS)) + slot - c[s]
        if not full:
            y = np.where((first + t * LANES)[:, None] + lane < total, y, x)
        need = y < LOW
        taken = np.cumsum(need, axis=1)
        y[need] = (y[need] << np.uint64(32)) | payload[(ptr[:, None] + taken - 1)[need]]
        ptr += taken[:, -1]
        x = y
    ids = out.reshape(-1)[:total]
    for k, i in enumerate(range(0, max(1, total), BLOCK)):
        if zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) != sums[k]:
            raise ValueError(f"block {k} of a token file is damaged")
    return doc_ids, doc_null, sizes, ids


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, text_col: str = "text", id_col: str = "doc_id") -> None:
    """Encode every text, append end_id, and write the ids in ascending order of id_col as file images.

    The folder holds Parquet files with columns part, file_no, n_ids, image; (part, file_no) is the order of the
    images. Texts are dealt to tasks by ranges of ids and sorted there, so tasks and their images follow one another
    without a global sort in one place. An image ends with the batch of documents (about a megabyte of text, or one
    longer text) that brings it to FILE_IDS ids. Null texts are empty (the end id alone); null ids come first; equal ids
    are ordered by a hash of their texts. ids are integers. An empty table gives no images. Other columns aren't read.
    """

    tables.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        n = number = 0

        def image() -> pa.RecordBatch:
            doc_ids, flat, sizes = zip(*held)
            doc_ids = pa.concat_arrays(doc_ids)
            data = encode_image(doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False), np.concatenate(sizes), np.concatenate(flat))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["part", "file_no", "n_ids", "image"])

        for batch in batches:
            for a, b, flat, sizes in tokens.encode_slices(batch.column(1), path):
                held.append((batch.column(0).slice(a, b - a), *tokens.with_end(flat, sizes, end_id)))
                n += len(held[-1][1])
                if n >= FILE_IDS:
                    yield image()
                    held, n, number = [], 0, number + 1
        if held:
            yield image()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Rows of one id, or without any, can be dealt to several tasks, since their order is that of their texts' hashes.
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.select("doc_id", "text").mapInArrow(run, "part long, file_no long, n_ids long, image binary").write.option("compression", "none").parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Decode token files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document."""
    files = spark.read.schema("part long, file_no long, n_ids long, image binary").parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                doc_ids, null, sizes, ids = decode_image(image.as_py())
                raw, ends = ids.astype("<u4"), np.cumsum(sizes)
                sums = [zlib.crc32(raw[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids_ := doc_ids), part)), pa.array(np.full(len(ids_), number)), pa.array(doc_ids, mask=null), pa.array(ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())], ["part", "file_no", "doc_id", "local", "n_tokens", "ids_crc32"])

    decoded = files.select("part", "file_no", "image").mapInArrow(run, "part long, file_no long, doc_id long, local long, n_tokens long, ids_crc32 long")
    # Two sums instead of one over all files: files within a task, then tasks.
    within = files.select("part", "file_no", "n_ids", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("file_no")) - F.col("n_ids")).alias("within"))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    parts = parts.select("part", (F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part")).alias("base"))
    starts = within.join(parts, "part").select("part", "file_no", (F.col("within") + F.col("base")).alias("first"))
    return decoded.join(starts, ["part", "file_no"]).select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tables.new_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokens.tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, folder)
