"""Prefix trie of conversations by fixed-length block hashing.

Turns have digests that depend on their place; a prefix's digest is their exclusive or, so digests of blocks of turns can
be put together. Conversations are grouped by the digests at the ends of successive blocks first. Where all conversations
of a node that go on do so by one block, its turns are nodes as they stand; only blocks that siblings begin otherwise are
opened and grouped turn by turn, and then each different block once, not each conversation.

Nothing walks the trie level by level. A node's smallest conversation stands for it, and the nodes for which one
conversation stands are a chain that ends at its last turn; so a sum over a subtree is a sum over the chains of its
members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ranges import running
from . import tables

#: Turns of a block, conversations of a family that share openings, and one more than the longest opening.
BLOCK, FAMILY, OPENINGS = 8, 20, 4
#: Length from which joined ids are hashed.
JOINED = 1 << 16
NODE = ["depth", "x", "y"]



def numbered(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1, by turn, null first, then role, then text), digest and words of each turn.

    Null roles and texts are empty; rows without an id belong to no conversation and are left out; repeated rows are
    turns of their own; other columns aren't read.
    """
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    named = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    placed = running(named, "conv_id", [F.col("turn").asc_nulls_first(), "role", "text"], tables.new_path(named.sparkSession, "turns"), {"pos": ("sum", F.lit(1).cast("long"))})
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return placed.select("conv_id", "pos", digest.alias("digest"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def rebuilt(turns: DataFrame, family: int = FAMILY, openings: int = OPENINGS) -> tuple[DataFrame, DataFrame]:
    """The ids of all conversations, and their turns as rebuilt: the first h turns of the family's first conversation
    (that with id c - c % family), then the conversation's own after its first h; h is crc32(id) % openings."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % openings).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % family
    ids = turns.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", h.alias("h"), base.alias("base"))
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < openings)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("head"))
    empty = F.array().cast(heads.schema["head"].dataType)
    ids = tables.keep(ids.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").select("conv_id", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h")), empty).alias("taken")), "openings")
    own = turns.where(F.col("pos") > h).join(ids.select("conv_id", "h", F.size("taken").alias("n")), "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "digest", "words")
    return ids.select("conv_id"), own.union(ids.select("conv_id", F.inline("taken")))


def _refined(blocks: DataFrame, measures: dict[str, Column], merge: dict[str, Column]) -> DataFrame:
    """Nodes by digest with measures, which are aggregates over a block's members and merge over blocks of a node."""
    block = blocks.groupBy("k", "x", "y").agg(*(v.alias(c) for c, v in measures.items()), F.any_value("ox").alias("ox"), F.any_value("oy").alias("oy"), F.any_value("turns").alias("turns"))
    siblings = block.groupBy("k", "ox", "oy").agg(F.count("*").alias("siblings"))
    upto = lambda c: lambda j: F.aggregate(F.slice("turns", F.lit(1), j), F.col(f"o{c}"), lambda a, t: a.bitwiseXOR(t[c]))
    at = lambda j: F.element_at("turns", j)
    opened = F.transform(F.sequence(F.lit(1), F.size("turns")), lambda j: F.struct(at(j)["pos"].alias("depth"), upto("x")(j).alias("x"), upto("y")(j).alias("y"), upto("x")(j - 1).alias("px"), upto("y")(j - 1).alias("py"), at(j)["words"].alias("words")))
    turns = block.join(siblings, ["k", "ox", "oy"]).select("siblings", *measures, F.inline(opened))
    shared = turns.where("siblings > 1").groupBy(*NODE).agg(*(v.alias(c) for c, v in merge.items()), *(F.any_value(c).alias(c) for c in ("px", "py", "words")))
    columns = [*NODE, "px", "py", "words", *measures]
    return turns.where("siblings = 1").select(*columns).union(shared.select(*columns))


def _ends(ids: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each node that a conversation ends at, the hash of the ids of those that do.

    Ids are sorted by range, so that a node's can be in many tasks, and joined there to pieces; a node's pieces then
    stream through one digest, as SHA-256 asks for.
    """
    last = blocks.groupBy("conv_id").agg(F.max_by(F.struct(F.element_at("turns", -1)["pos"].alias("depth"), "x", "y"), "k").alias("last"))
    zero = F.lit(0).cast("long")
    ended = ids.join(last, "conv_id", "left").select(*(F.coalesce(F.col("last")[c], zero).alias(c) for c in NODE), "conv_id")

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, 0, [], 0
        rows: list[tuple] = []
        for batch in batches:
            for *n, i in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id"))):
                if n != node or size >= JOINED:
                    if held:
                        rows.append((*node, first, ",".join(held)))
                    node, first, held, size = n, i, [], 0
                held.append(str(i))
                size += len(held[-1]) + 1
            if len(rows) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], [*NODE, "first", "piece"])
                rows = []
        if held:
            rows.append((*node, first, ",".join(held)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], [*NODE, "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        for batch in batches:
            rows: list[tuple] = []
            for *n, piece in zip(*(batch.column(c).to_pylist() for c in (*NODE, "piece"))):
                if n != node:
                    if node:
                        rows.append((*node, h.hexdigest()))
                    node, h = n, hashlib.sha256(piece.encode())
                else:
                    h.update(b"," + piece.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], [*NODE, "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, h.hexdigest())], [*NODE, "ends_sha256"])

    ranges = ended.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = ranges.mapInArrow(join_ids, "depth long, x long, y long, first long, piece string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(ids: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of all conversations: a row for each distinct sequence of first turns, the empty one included.

    ids has conv_id, each once; turns has conv_id, pos (1, 2, ...), digest and words. Returns per node conv_id (the
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256, as the query's
    contract has them. Without conversations there is no node, not even the root. Equal conversations are members of
    one node; a conversation without turns is a member of the root alone. Texts are compared by SHA-256, sequences by
    128 bits of digests. No group of a key is gathered anywhere but for the turns of a block.
    """
    k = F.floor((F.col("pos") - 1) / block).cast("long")
    placed = turns.select("conv_id", "pos", F.xxhash64(F.lit(1), "pos", "digest").alias("x"), F.xxhash64(F.lit(2), "digest", "pos").alias("y"), "words")
    cut = placed.groupBy("conv_id", k.alias("k")).agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), F.sort_array(F.collect_list(F.struct("pos", "x", "y", "words"))).alias("turns"))
    blocks = running(cut, "conv_id", ["k"], tables.new_path(cut.sparkSession, "blocks"), {"x": ("xor", F.col("bx")), "y": ("xor", F.col("by"))})
    blocks = tables.keep(blocks.select("conv_id", "k", "x", "y", F.col("x").bitwiseXOR(F.col("bx")).alias("ox"), F.col("y").bitwiseXOR(F.col("by")).alias("oy"), "turns"), "prefixes")

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = ids.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(*(zero.alias(c) for c in NODE), none.alias("px"), none.alias("py"), zero.alias("words"), "n_convs", "conv_id")
    found = _refined(blocks, {"n_convs": F.count("*"), "conv_id": F.min("conv_id")}, {"n_convs": F.sum("n_convs"), "conv_id": F.min("conv_id")})
    nodes = tables.keep(found.union(root).withColumn("value", (F.col("n_convs") - 1) * F.col("words")), "nodes")

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, NODE, "left").fillna(0, "n_children").join(parents, ["depth", "px", "py"], "left").drop("px", "py", "words")
    nodes = running(nodes, "conv_id", ["depth"], tables.new_path(nodes.sparkSession, "chains"), {"upto": ("sum", F.col("value"))})
    nodes = tables.keep(nodes, "chains")

    # What each conversation's chain holds, summed over the members of each node.
    chains = nodes.groupBy("conv_id").agg(F.sum("value").alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaves"))
    held = _refined(blocks.join(chains, "conv_id"), *([{c: F.sum(c) for c in ("saved", "leaves")}] * 2)).select(*NODE, "saved", "leaves")
    held = held.union(chains.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).where("leaves is not null").select(*(zero.alias(c) for c in NODE), "saved", "leaves"))
    out = nodes.join(held, NODE).join(_ends(ids, blocks), NODE, "left")
    # A node's own chain counts from the node on, those of its other members whole.
    saved = F.col("saved") - F.col("upto") + F.col("value")
    ends = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), ends.alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


_STEP = "CASE WHEN i % 8 = 0 THEN xor(a, ascii(substr(s, CAST(i // 8 + 1 AS INT), 1))) ELSE a END"
#: CRC-32 of a decimal, bit by bit.
_CRC32 = f"xor(4294967295, list_reduce(list_prepend(4294967295, range(8 * length(s))), lambda a, i: CASE WHEN ({_STEP}) % 2 = 1 THEN xor(({_STEP}) >> 1, 3988292384) ELSE ({_STEP}) >> 1 END))"
OP13_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY turn NULLS FIRST, role, text) AS p,
 list(CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) ORDER BY turn NULLS FIRST, role, text) AS w FROM t GROUP BY 1),
h AS (SELECT *, {_CRC32} % 4 AS h FROM (SELECT *, CAST(conv_id AS VARCHAR) AS s FROM o)),
r AS (SELECT h.conv_id, list_concat(list_slice(coalesce(b.p, []), 1, h.h), list_slice(h.p, h.h + 1, len(h.p))) AS p, list_concat(list_slice(coalesce(b.w, []), 1, h.h), list_slice(h.w, h.h + 1, len(h.w))) AS w
 FROM h LEFT JOIN o AS b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, p, w, unnest(range(len(p) + 1)) AS d FROM r),
n AS (SELECT d, list_slice(p, 1, d) AS q, count(*) AS n, min(conv_id) AS c, any_value(CASE WHEN d = 0 THEN 0 ELSE w[d] END) AS w, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = len(p)) AS e FROM m GROUP BY 1, 2),
k AS (SELECT a.d, a.q, count(b.d) FILTER (b.d = a.d + 1) AS k FROM n AS a LEFT JOIN n AS b ON b.d = a.d + 1 AND list_slice(b.q, 1, a.d) = a.q GROUP BY 1, 2),
s AS (SELECT a.d, a.q, sum((b.n - 1) * b.w) AS s, count(*) FILTER (k.k = 0) AS l FROM n AS a JOIN n AS b ON b.d >= a.d AND list_slice(b.q, 1, a.d) = a.q JOIN k ON k.d = b.d AND k.q = b.q GROUP BY 1, 2)
SELECT n.c AS conv_id, n.d AS depth, u.c AS parent_conv_id, n.n AS n_convs, k.k AS n_children, s.l AS n_leaves, CAST(s.s AS BIGINT) AS saved_tokens, sha256(coalesce(n.e, '')) AS ends_sha256
FROM n JOIN k ON k.d = n.d AND k.q = n.q JOIN s ON s.d = n.d AND s.q = n.q LEFT JOIN n AS u ON u.d = n.d - 1 AND u.q = list_slice(n.q, 1, n.d - 1)
"""
