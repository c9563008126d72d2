"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import tables, tokens


def token_counts(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 512) -> DataFrame:
    """Bytes and tokens of each whole text, without special tokens that the library would add.

    Returns id_col, n_bytes, n_tokens, over_limit (n_tokens > limit), a row for each input row in any order. A null
    text counts as empty (0 bytes, 0 tokens). Repeated rows are counted each; a null id stays null. Other columns of
    the input are not read, whatever they are called. A long text is cut at spaces, where no token can cross.

    A narrow stage: nothing is shuffled. Rows go to the library in batches of about equal bytes.
    """

    tables.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())
            for a, b, _, sizes in tokens.encode_slices(batch.column(1), path, counts=True):
                n = pa.array(sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n_bytes.slice(a, b - a), n, pc.greater(n, limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.tokenizer_path("byte_bpe_50k.json"))
