"""Fill-in-middle transformation by secondary sort.

A text becomes pieces of bounded length, keyed by row and position in the output. One exchange brings a row's pieces
together in output order; they stream through an incremental digest and through a parser that finds the sentinels in the
output alone. What it finds is sorted again, within the partition, by place in the text, and streams through a second
digest. No whole text is built after the first step, so that memory is bounded by a piece, not by a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import tables

#: Code points of a piece, and bytes of pieces that leave a worker at once.
CHUNK, OUT_BYTES = 16_384, 4 << 20
#: Out of 100: rows below this are transformed, and of these, rows below that have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Sentinels, the order of parts in each form, and the order of parts in the text.
SENTINELS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
ORDER = {"plain": (), "psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PLACE = {"prefix": 0, "middle": 1, "suffix": 2}

_META = "n long, form string, prefix_chars long, middle_chars long"


def plan(key: str, text: str) -> tuple[str, int, int]:
    """Form, end of the prefix and end of the middle (code points) of a text; key is the id as decimal text."""
    h = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or h3 % 100 >= RATE or any(s in text for s in SENTINELS.values()):
        return "plain", 0, 0
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return "spm" if h4 % 100 < SUFFIX_FIRST else "psm", a, b


class _Out:
    """Rows gathered into record batches of bounded bytes."""

    def __init__(self, fields: list[pa.Field]):
        self.schema, self.rows, self.size = pa.schema(fields), [], 0

    def add(self, *row, size: int) -> None:
        self.rows.append(row)
        self.size += size + 64

    def batches(self, least: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
            self.rows, self.size = [], 0


def pieces(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """The output of each row of docs in pieces of at most `chunk` code points and a sentinel.

    Columns: row (a number for each row of docs), position (code points of the output before the piece), piece, and in
    each row's first piece doc_id, n, form, prefix_chars and middle_chars (null if plain). Null texts are empty; an
    empty text is one empty piece. A null id is cut as if its decimal form were empty. Repeated rows are rows of their
    own; other columns aren't read. Rows must come in the same order whenever docs is read, as those of files do.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ddl = f"row long, position long, piece string, doc_id {named.schema['doc_id'].dataType.simpleString()}, {_META}"
    fields = tables.arrow_fields(docs.sparkSession, ddl)
    tables.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, out = TaskContext.get().partitionId() << 33, _Out(fields)
        for batch in batches:
            for i, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                form, a, b = plan(key, text)
                ends = {"prefix": (0, a), "middle": (a, b), "suffix": (b, len(text))}
                parts = [(SENTINELS[x], *ends[x]) for x in ORDER[form]] or [("", 0, len(text))]
                meta = (i, len(text), form, *((a, b - a) if ORDER[form] else (None, None)))
                position = 0
                for sentinel, at, end in parts:
                    while True:
                        piece = sentinel + text[at : min(end, at + chunk)]
                        out.add(row, position, piece, *meta, size=len(piece))
                        position, at, sentinel, meta = position + len(piece), at + chunk, "", (None,) * 5
                        yield from out.batches()
                        if at >= end:
                            break
                row += 1
        yield from out.batches(0)

    return named.mapInArrow(run, ddl)


def assembled(cut: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and text (the whole output) of pieces."""
    fields = list(tables.arrow_fields(cut.sparkSession, (ddl := f"doc_id {cut.schema['doc_id'].dataType.simpleString()}, {_META}, text string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, meta, held = _Out(fields), None, []
        for batch in batches:
            for position, piece, *rest in zip(*(batch.column(c).to_pylist() for c in ("position", "piece", "doc_id", "n", "form", "prefix_chars", "middle_chars"))):
                if position == 0 and meta:
                    out.add(*meta, text := "".join(held), size=len(text))
                    held = []
                    yield from out.batches()
                meta = rest if position == 0 else meta
                held.append(piece)
        if meta:
            out.add(*meta, "".join(held), size=0)
        yield from out.batches(0)

    return _together(cut).mapInArrow(run, ddl)


def _together(cut: DataFrame) -> DataFrame:
    return cut.repartition("row").sortWithinPartitions("row", "position")


class Parser:
    """Tells the parts of an output apart as its pieces pass by, from the output and its form alone."""

    def __init__(self, form: str):
        self.ahead, self.part, self.carry = list(ORDER[form]), None if ORDER[form] else "prefix", ""
        self.done = dict.fromkeys(PLACE, 0)

    def _take(self, text: str) -> Iterator[tuple[int, int, str]]:
        if text:
            if self.part is None:
                raise ValueError("an output that isn't plain has to begin with a sentinel")
            yield PLACE[self.part], self.done[self.part], text
            self.done[self.part] += len(text)

    def feed(self, piece: str, last: bool = False) -> Iterator[tuple[int, int, str]]:
        """(place of the part, code points of it before, text) of what is certain after one more piece."""
        text, self.carry = self.carry + piece, ""
        while self.ahead and (at := text.find(SENTINELS[self.ahead[0]])) >= 0:
            yield from self._take(text[:at])
            self.part, text = self.ahead.pop(0), text[at + 3 :]
        if self.ahead and not last:  # what may be the begin of the next sentinel waits
            k = next((k for k in (2, 1) if text.endswith(SENTINELS[self.ahead[0]][:k])), 0)
            text, self.carry = text[: len(text) - k], text[len(text) - k :]
        yield from self._take(text)


def digests(cut: DataFrame) -> DataFrame:
    """A row for each row of pieces: doc_id, n, form, prefix_chars, middle_chars, output_sha256 of the output, and
    restored_sha256 of the text as rebuilt from the output and its form (both of UTF-8, lowercase hex)."""
    spark, kind = cut.sparkSession, cut.schema["doc_id"].dataType.simpleString()
    found = f"row long, place int, before long, piece string, doc_id {kind}, {_META}, output_sha256 string"
    result = f"doc_id {kind}, {_META}, output_sha256 string, restored_sha256 string"
    found_fields, result_fields = tables.arrow_fields(spark, found), tables.arrow_fields(spark, result)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, row, meta, digest, parser = _Out(found_fields), None, None, None, None

        def close():
            for place, before, text in parser.feed("", True):
                out.add(row, place, before, text, *[None] * 6, size=len(text))
            out.add(row, -1, 0, None, *meta, digest.hexdigest(), size=64)

        for batch in batches:
            for r, position, piece, *rest in zip(*(batch.column(c).to_pylist() for c in ("row", "position", "piece", "doc_id", "n", "form", "prefix_chars", "middle_chars"))):
                if position == 0:
                    if meta:
                        close()
                    row, meta, digest, parser = r, rest, hashlib.sha256(), Parser(rest[2])
                digest.update(piece.encode())
                for place, before, text in parser.feed(piece):
                    out.add(row, place, before, text, *[None] * 6, size=len(text))
                yield from out.batches()
        if meta:
            close()
        yield from out.batches(0)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, meta, digest = _Out(result_fields), None, None
        for batch in batches:
            for place, piece, *rest in zip(*(batch.column(c).to_pylist() for c in ("place", "piece", "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"))):
                if place < 0:
                    if meta:
                        out.add(*meta, digest.hexdigest(), size=128)
                    meta, digest = rest, hashlib.sha256()
                else:
                    digest.update(piece.encode())
            yield from out.batches()
        if meta:
            out.add(*meta, digest.hexdigest(), size=128)
        yield from out.batches(0)

    # The second sort needs no exchange: a row's pieces are in one partition already.
    return _together(cut).mapInArrow(parse, found).sortWithinPartitions("row", "place", "before").mapInArrow(restore, result)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS e FROM d),
f AS (SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) AS m, CASE WHEN n = 0 OR c >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m - p END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, p) || '<S>' || substr(t, m + 1) || '<M>' || substr(t, p + 1, m - p)
 ELSE '<S>' || substr(t, m + 1) || '<P>' || substr(t, 1, p) || '<M>' || substr(t, p + 1, m - p) END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""
