"""N-gram Jaccard join, size-aware: fixed-size subsets for small sets, inverted lists for large ones.

A text's set holds hashes of its runs of five words. All sets share one order of shingles: rarest first (by powers of two
of the number of sets that hold them), then by hash. Two linked sets share at least o = ceil(3/7 (|A| + |B|)) shingles,
and o >= ceil(3/4 |A|); so the first |A| - ceil(3/4 |A|) + s of A and as many of B share s of them. Small sets post all
pairs (s = 2) of those, large sets each of them (s = 1); sets that are small but can link with large ones post both. The
size at which that turns is where the expected work of pairs passes that of scanning lists.

A shingle that one set alone holds meets nothing. Those come first in the order, so a set with more of them than its
prefix is long posts nothing and is done. This is decided exactly: shingles are dealt by their first bits, counted there,
and what is known of those that more sets hold goes back to the slice of documents it came from. Only sets that are still
open have their shingles kept; the others' can't be in common with anything.

Candidates are not all pairs of a list. Each list first has one centre, which all its sets are compared with; sets that
this joins need no comparison with each other. Then those outside the list's largest component are compared with a few
centres inside and a few outside of it. After such rounds, only pairs from different components are left to compare, and
all of them are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import components, tables, text

WIDTH = 5
#: Bytes of text that are taken at once, and shingles and rows of a slice of documents.
PART_BYTES, SLICE_SHINGLES, SLICE_ROWS = 512 << 10, 600_000, 50_000
#: Sets of a slice that hold one shingle, from which on the slice sends their number alone.
MANY = 16
#: About how many shingles a bucket has.
BUCKET = 1 << 18
#: Rounds with centres before all pairs that are left are compared, and centres of a list inside and outside of its
#: largest component from the second round on.
ROUNDS, CENTRES = 3, 3
_COUNT_ONLY = 0xFFFF


def needed(n):
    """The least number of shingles that a set of n shares with any set that it links with: ceil(3/4 n)."""
    return (3 * n + 3) // 4


def linked(common, a, b):
    """Whether 100 * intersection >= 75 * union."""
    return 4 * common >= 3 * (a + b - common)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all rows, sorted within rows, and the first of each row (with the total)."""
    starts, ends, first = text.words(data, offsets, text.SPACED)
    h = text.span_hashes(data, starts, ends)
    n_words = np.diff(first)
    rows = np.repeat(np.arange(len(n_words)), n_words)
    whole = text.windows(h, WIDTH)
    inside = rows[: len(whole)] == rows[WIDTH - 1 :] if len(whole) else np.zeros(0, bool)
    values, owner = whole[inside], rows[: len(whole)][inside]
    short = np.flatnonzero((n_words > 0) & (n_words < WIDTH))
    if short.size:
        one = [text.windows(h[first[r] : first[r + 1]], int(n_words[r]))[0] + np.uint64(n_words[r]) for r in short]
        values, owner = np.concatenate((values, np.array(one, np.uint64))), np.concatenate((owner, short))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (np.diff(owner) != 0) | (values[1:] != values[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(n_words) + 1))


def set_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; equal sets have equal keys."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(text.mix(values), out=total[1:])
    return text.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _new_rows(seen: set[int], keys: np.ndarray, first: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Rows with an id and the first copy of a non-empty set in this task; what a task keeps is bounded by its split."""
    out = []
    for r, (key, size, has_id) in enumerate(zip(keys.tolist(), np.diff(first).tolist(), ids.is_valid().to_pylist())):
        if size and has_id and key not in seen:
            seen.add(key)
            out.append(r)
    return np.array(out, np.int64)


def _take(values: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some rows, one after another, and how many each has."""
    sizes = first[rows + 1] - first[rows]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return values[np.repeat(first[rows] - ends[:-1], sizes) + np.arange(ends[-1])], sizes


def _packed(values: np.ndarray, counts: np.ndarray, width: int) -> pa.Array:
    """Binary values of counts[i] items of `width` bytes each, one after another."""
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * width, out=ends[1:])
    data = pa.py_buffer(np.ascontiguousarray(values))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), data]).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), kind)


def _cut(values: np.ndarray, bits: int) -> np.ndarray:
    """The hash as far as buckets and their entries keep it: bits + 48 bits."""
    return values & np.uint64((1 << 64) - (1 << max(0, 16 - bits)))


_HEAD = "ids array<bigint>, sizes array<bigint>, keys array<bigint>, own array<bigint>, many binary, many_of binary"
_DEALT = f"bucket long, slice long, k binary, x binary, n binary, {_HEAD}"
_KNOWN = f"slice long, h binary, x binary, level binary, {_HEAD}"
_SETS = "doc_id long, n long, key long, alone long, meets double, prefix binary, shingles binary"


def _slice_rows(bits: int, number: int, ids: pa.Array, sizes: np.ndarray, keys: np.ndarray, own: np.ndarray, values: np.ndarray, counts: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """The rows that a slice sends: one for each bucket that it has shingles in, and one with its documents.

    A bucket gets 48 further bits of each hash and the number of the set it is in. Of shingles that at least MANY sets
    of the slice hold, it gets the number of sets only; which ones they are stays with the slice's documents."""
    owner = np.repeat(np.arange(len(counts), dtype=np.uint16), counts)
    values = _cut(values, bits)
    order = np.sort(values)
    at = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1]))) if len(order) else np.zeros(0, np.int64)
    times = np.diff(np.append(at, len(order)))
    many, often = order[at][times >= MANY], times[times >= MANY]
    in_many = many[np.minimum(np.searchsorted(many, values), len(many) - 1)] == values if len(many) else np.zeros(len(values), bool)
    many_values, many_of = values[in_many], owner[in_many]
    values, owner = np.concatenate((values[~in_many], many)), np.concatenate((owner[~in_many], np.full(len(many), _COUNT_ONLY, np.uint16)))
    bucket = (values >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    low = ((values[order] << np.uint64(bits)) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    there, per = np.unique(bucket, return_counts=True)
    # The numbers of sets that stand for counts are the last ones of their bucket, in the order of `many`.
    of_many = np.searchsorted(there, (many >> np.uint64(64 - bits)).astype(bucket.dtype))
    n_rows = len(there)
    empty = pa.nulls(n_rows)
    head = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, pa.int64())) for v in (ids, sizes, keys, own)]
    columns = [
        (pa.array(there.astype(np.int64)), pa.array([-1 - number])), (pa.array(np.full(n_rows, number)), pa.array([number])),
        (_packed(low, per, 6), None), (_packed(owner[order], per, 2), None), (_packed(often.astype("<u4"), np.bincount(of_many, minlength=n_rows), 4), None),
        *((empty, x) for x in head), (empty, pa.array([many_values.tobytes()])), (empty, pa.array([many_of.tobytes()])),
    ]
    arrays = [pa.concat_arrays([a.cast(f.type), pa.nulls(1, f.type) if b is None else b.cast(f.type)]) for (a, b), f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _deal(docs: DataFrame, bits: int) -> DataFrame:
    """Shingles of the first copies of sets in each task, by bucket; and a row for each slice of documents."""
    schema = pa.schema(tables.arrow_fields(docs.sparkSession, _DEALT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        shingles = rows = 0

        def out() -> pa.RecordBatch:
            ids, sizes, keys, own, values, counts = zip(*held)
            first_row = np.cumsum([0, *(len(x) for x in ids)])
            own = np.concatenate([o + r for o, r in zip(own, first_row)])
            return _slice_rows(bits, number, pa.concat_arrays(ids), np.concatenate(sizes), np.concatenate(keys), own, np.concatenate(values), np.concatenate(counts), schema)

        for batch in batches:
            for a, b, data, offsets in text.slices(batch.column(1), PART_BYTES):
                values, first = shingle_sets(data, offsets)
                keys, ids = set_keys(values, first), batch.column(0).slice(a, b - a)
                own = _new_rows(seen, keys, first, ids)
                held.append((ids, np.diff(first), keys, own, *_take(values, first, own)))
                shingles, rows = shingles + len(held[-1][4]), rows + b - a
                if shingles >= SLICE_SHINGLES or rows >= SLICE_ROWS:
                    yield out()
                    held, shingles, rows, number = [], 0, 0, number + 1
        if held:
            yield out()

    return docs.mapInArrow(run, _DEALT)


def _known(bits: int):
    """Of a bucket's entries, those whose shingle more than one set holds, with floor(log2) of how many do."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        head = ["ids", "sizes", "keys", "own", "many", "many_of"]
        if bucket < 0:
            none = pa.nulls(table.num_rows, pa.binary())
            return pa.table([table.column("slice"), none, none, none, *(table.column(c) for c in head)], ["slice", "h", "x", "level", *head])
        x = _unpacked(table.column("x"), "<u2")
        k = np.zeros((len(x), 8), np.uint8)
        k[:, :6] = _unpacked(table.column("k"), np.uint8).reshape(-1, 6)
        k = k.reshape(-1).view("<u8")
        sets = np.ones(len(x), np.int64)
        sets[x == _COUNT_ONLY] = _unpacked(table.column("n"), "<u4")
        order = np.argsort(k, kind="stable")
        sorted_k = k[order]
        at = np.flatnonzero(np.concatenate(([True], sorted_k[1:] != sorted_k[:-1])))
        df = np.add.reduceat(sets[order], at)
        level = np.empty(len(k), np.uint8)
        level[order] = np.repeat(np.log2(df).astype(np.uint8), np.diff(np.append(at, len(k))))
        shared = level > 0
        per = np.array([len(v) // 2 for v in table.column("x").to_pylist()])
        row = np.repeat(np.arange(len(per)), per)
        counts = np.bincount(row[shared], minlength=len(per))
        h = (np.uint64(bucket) << np.uint64(64 - bits)) | ((k[shared] << np.uint64(16)) >> np.uint64(bits))
        packed = [_packed(v, counts, w) for v, w in ((h, 8), (x[shared], 2), (level[shared], 1))]
        out = pa.table([table.column("slice").combine_chunks(), *packed, *(table.column(c) for c in head)], ["slice", "h", "x", "level", *head])
        return out.filter(pa.array(counts > 0))

    return run


def _gathered(table: pa.Table) -> pa.Table:
    """Of a slice: each document's n and key, and the prefix and the shared shingles of each set that is still open."""
    head = table.filter(table.column("ids").is_valid())
    ids, sizes, keys, own = (head.column(c).combine_chunks().flatten() for c in ("ids", "sizes", "keys", "own"))
    h, x, level = _unpacked(table.column("h"), "<u8"), _unpacked(table.column("x"), "<u2"), _unpacked(table.column("level"), np.uint8)
    many, many_of = _unpacked(head.column("many"), "<u8"), _unpacked(head.column("many_of"), "<u2")
    counted = x == _COUNT_ONLY
    order = np.argsort(h[counted])
    place = order[np.searchsorted(h[counted][order], many)] if len(many) else np.zeros(0, np.int64)
    h, level, x = (np.concatenate((v[~counted], w)) for v, w in ((h, many), (level, level[counted][place]), (x, many_of)))
    own, n = own.to_numpy(), sizes.to_numpy()
    size = n[own]
    alone = size - np.bincount(x, minlength=len(own))
    posts = size - needed(size) + 2 - alone
    is_open = (size >= 3) & (posts > 0)
    some = is_open[x]
    h, level, x = h[some], level[some], x[some].astype(np.int64)
    order = np.lexsort((h, level, x))
    h, level, x = h[order], level[order], x[order]
    per = np.bincount(x, minlength=len(own))
    place = np.arange(len(x)) - (np.cumsum(per) - per)[x]
    in_prefix = place < posts[x]
    single = place < posts[x] - 1
    meets = np.bincount(x[single], weights=np.minimum(np.exp2(level[single]), ROUNDS + 1), minlength=len(own))
    by_hash = h[np.lexsort((h, x))]
    prefix = _packed(h[in_prefix], np.bincount(x[in_prefix], minlength=len(own)), 8)
    row = np.full(len(n), -1)
    row[own[is_open]] = np.flatnonzero(is_open)
    at = pa.array(row, mask=row < 0)
    columns = [ids, sizes, keys, pa.array(alone).take(at), pa.array(meets.astype(float)).take(at), prefix.take(at), _packed(by_hash, per, 8).take(at)]
    return pa.table(columns, [c.split()[0] for c in _SETS.split(", ")])


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, n and key of each document's set, in one pass over the texts (doc_id long, text string).

    Where the set is the first of its kind in its task and still open: alone (its shingles that no other set holds),
    meets (how many centres the entries of its prefix meet, at most), prefix (its shared shingles there, rarest first), and shingles
    (all that are shared, sorted)."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(31, max(6, int(n_bytes / 7 / BUCKET).bit_length()))
    return _deal(docs, bits).groupBy("bucket").applyInArrow(_known(bits), _KNOWN).groupBy("slice").applyInArrow(_gathered, _SETS)


def subset_boundary(classes: list[tuple[int, float, float]]) -> int:
    """The largest size of sets that post pairs: the one with the least cost.

    classes: (largest size in a class of sets, the cost of their pairs, the cost of scanning their lists). Sets up to
    the boundary post pairs, those above it entries of lists, and those below it that can link with some above post both.
    """
    best, boundary = float("inf"), 3
    for b in [3, *sorted(c[0] for c in classes if c[0] > 3)]:
        edge = needed(b + 1)
        cost = sum((pairs if n <= b else 0) + (lists if n >= edge else 0) for n, pairs, lists in classes)
        if cost < best:
            best, boundary = cost, b
    return boundary


def _boundary(open_sets: DataFrame) -> int:
    """A pair costs its posting and one like it; an entry of a list its posting and the centres that it meets.

    Sets are taken together by quarter powers of two of their sizes, so a few hundred classes come to the driver."""
    q = F.length("prefix") / 8
    by_class = open_sets.groupBy(F.floor(4 * F.log2("n")).alias("k")).agg(F.max("n"), F.sum(q * (q - 1)), F.sum(q + F.col("meets")))
    return subset_boundary([(r[1], float(r[2]), float(r[3])) for r in by_class.collect()])


def postings(prefix: np.ndarray, n: int, alone: int, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """What a set of n posts, and the place in its order of each (of the first, for a pair).

    prefix: its shared shingles in order up to the place n - needed(n) + 1; those alone come before them."""
    keys, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if n >= needed(boundary + 1):
        single = prefix[: max(0, n - int(needed(n)) + 1 - alone)]
        keys.append(single)
        at.append(np.arange(len(single)))
    if n <= boundary:
        i, j = np.triu_indices(len(prefix), 1)
        keys.append(text.mix(prefix[i] * np.uint64(0xC2B2AE3D27D4EB4F) + prefix[j]))
        at.append(i)
    return np.concatenate(keys), alone + np.concatenate(at)


def _posted(open_sets: DataFrame, boundary: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, n, alone, prefix in zip(*(batch.column(i).to_pylist() for i in range(4))):
                h, at = postings(np.frombuffer(prefix, "<u8"), n, alone, boundary)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), key)), pa.array(np.full(len(h), n)), pa.array(at)], ["h", "key", "n", "at"])

    return open_sets.select("key", "n", "alone", "prefix").mapInArrow(run, "h long, key long, n long, at long")


def common_shingles(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _links(pairs: DataFrame, open_sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by all shingles that their sets share with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            common = [common_shingles(*(np.frombuffer(x.as_buffer(), "<u8") for x in row)) for row in zip(batch.column(4), batch.column(5))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked(np.array(common, np.int64), na, nb)))

    for c in "ba":
        pairs = pairs.join(open_sets.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("shingles").alias(f"shingles_{c}")), c)
    return pairs.select("a", "b", "n_a", "n_b", "shingles_a", "shingles_b").mapInArrow(run, "a long, b long")


def _can_link(x: str, y: str) -> Column:
    """Whether two entries of a list can be the first of enough common shingles: as many must be left in both sets."""
    n = lambda side: F.col(f"n_{side}")
    left = F.least(n(x) - F.col(f"at_{x}"), n(y) - F.col(f"at_{y}"))
    return 7 * left >= 3 * (n(x) + n(y))


def _side(lists: DataFrame, side: str) -> DataFrame:
    return lists.select("h", *(F.col(c).alias(f"{c}_{side}") for c in ("key", "n", "at", "root")))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b")).distinct()


def _unsettled(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The lists (h, key, n, at) whose sets are in more than one component, with the root of each set's."""
    if roots is None:
        lists = lists.withColumn("root", F.col("key"))
    else:
        lists = lists.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = lists.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
    return lists.join(mixed, "h", "left_semi")


def _all_links(open_sets: DataFrame, boundary: int) -> DataFrame | None:
    """node and root of the components of open sets with links; None where there is no link."""
    posted = _posted(open_sets, boundary)
    tested: DataFrame | None = None
    links: DataFrame | None = None
    roots: DataFrame | None = None
    for turn in range(ROUNDS + 1):
        lists = tables.keep(_unsettled(posted, roots).select("h", "key", "n", "at", "root"), "lists")
        if not lists.head(1):
            break
        posted = lists.drop("root")
        # Lists with the same sets mostly have the same centres, so most pairs come up again and count once.
        order = F.xxhash64("key", F.lit(turn))
        if turn == 0:
            some = lists
            centres = lists.groupBy("h").agg(F.min_by(F.struct("key", "n", "at", "root"), order).alias("c")).select("h", "c.*")
        else:
            # Two sets of different components can't both be in the one that has most of the list.
            per_root = lists.groupBy("h", "root").agg(F.count("*").alias("c"))
            most = per_root.groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("most"))
            centres = lists.join(most, "h").withColumn("inside", F.col("root") == F.col("most"))
            some = centres.where("not inside")
            if turn < ROUNDS:
                # An entry early in its set's order can link with most others; chance makes rounds differ.
                early = F.col("at") / F.col("n") + F.pmod(order, F.lit(1000)) / 30_000
                rank = F.row_number().over(Window.partitionBy("h", "inside").orderBy(early, "key"))
                centres = centres.withColumn("rank", rank).where(F.col("rank") <= CENTRES)
        met = _pairs(_side(some, "x").join(_side(centres, "y"), "h").where((F.col("root_x") != F.col("root_y")) & _can_link("x", "y")))
        if tested is not None:
            met = met.join(tested, ["a", "b"], "left_anti")
        pairs = tables.keep(met, "pairs")
        found = tables.keep(_links(pairs, open_sets), "links")
        tested = pairs if tested is None else tested.union(pairs)
        if found.head(1):
            links = found if links is None else links.union(found)
            roots = components.connected(links)
    return roots


def jaccard_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Components of near copies of whole texts: doc_id, n_shingles, component_id.

    A set holds the distinct five-word shingles of a text (A-Z lower-cased, words between ASCII white space), or its
    whole sequence of fewer words. Sets link where 100 * intersection >= 75 * union; component_id is the smallest
    doc_id reachable by links. A null or wordless text has an empty set, links with nothing and is its own component.
    Rows without an id link with nothing and have no component. Repeated rows share a component. Other columns of the
    input aren't read. A text of any length is one set. Sets are compared by 64-bit shingle hashes (at least 54 bits
    where tables are small). Rows of docs must come in the same order whenever they are read, as those of files do.

    One pass reads the texts. Equal sets count once in each task, and a shingle of many sets of a slice (about 4 MB of
    text) is sent once for all of them. What moves are packed hashes, each once; then only the sets that are still open.
    See the module for the method.
    """
    spark = docs.sparkSession
    tables.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = tables.keep(shingled(rows), "sets")
    open_sets = tables.keep(sets.where("shingles is not null").drop("doc_id").dropDuplicates(["key"]), "open")
    roots = _all_links(open_sets, _boundary(open_sets))
    keyed = sets.select("doc_id", "n", "key")
    distinct = keyed.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    if roots is None:
        of_key = distinct.select("key", F.col("rep").alias("component_id"))
    else:
        labelled = distinct.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
        smallest = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
        of_key = labelled.join(smallest, "root").select("key", "component_id")
    out = keyed.join(of_key, "key", "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def drop_near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows and columns of docs with one document of each component: that of the smallest id. Rows without an id
    stay; of rows with equal ids all stay or none."""
    kept = jaccard_components(docs, text_col, id_col).where("doc_id = component_id").select(F.col("doc_id").alias("__representative")).distinct()
    with_id = docs.where(F.col(id_col).isNotNull())
    return with_id.join(kept, with_id[id_col].cast("long") == F.col("__representative"), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
