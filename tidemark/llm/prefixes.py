"""Conversation prefix trie, built as a Patricia tree over sorted conversations.

A conversation is the sequence of its turns. Each prefix has a chained digest (16 bytes, of the digest before and the turn's),
so a conversation is one binary, its path, and two conversations share as many turns as their paths share
digests. Distinct paths, each with its number of conversations and their smallest id, are sorted over range
partitions. A task reads its stretch once and keeps a stack of open points: only branches, ends and leaves
become points, an edge between two of them is compressed. A point gathers counts, and the two sums from which its
saved bytes follow:

    saved = sum over its paths of (copies x bytes below the point's parent) - bytes of the nodes of its subtree

When a point closes, the nodes on its edge are expanded: they share its members, and their saved bytes
grow by edge suffix sums. Nodes that lie on the border of two stretches (no deeper than what a stretch's first or last path shares with
its neighbour) are given out in parts, for every depth, and added up by digest; there are at most path length such rows
for each stretch. All else is final where it is made. A node under a point learns its parent's smallest id by a
join of two written tables, which adaptive execution splits where a point has very many children.

The digest of the ids that end at a node is sequential by nature: ids are sorted over range partitions, joined to chunks of
``CHUNK`` each, and one task streams a node's chunks in order.

Defined results: rows with a null ``conv_id`` are ignored; a null role or text is empty; turns are ordered by turn (null first),
then role, then text; repeated rows are turns of their own; copies of a conversation are one path; an empty table gives an
empty table; other columns are ignored. A conversation is one sequence that one task reads in order, and one
row of 24 bytes a turn afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_width, written

WIDE = 16
CHUNK = 4096
AT_ONCE = 20_000
PATHS = "conv_id long, path binary, sizes binary"
NODES = "key binary, depth long, low long, n long, children long, leaves long, weighted long, own long, above long, ends string, parent binary, part boolean, point boolean"
NOBODY = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, place, turn_digest, size): turns placed from 1, their digests, and the bytes of their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length("r").cast("string"), F.lit(":"), "r", "t").cast("binary"), 256)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "r", "t"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("r"), text.alias("t"))
    return rows.select("conv_id", place.cast("long").alias("place"), F.substring(F.unhex(digest), 1, WIDE).alias("turn_digest"), F.octet_length("t").cast("long").alias("size"))


def with_shared_heads(turns: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """``numbered`` turns in which each conversation c begins with the first crc32(c) % (most + 1) turns of conversation c - c % every; a turn at place 0 stands for each conversation."""
    conversations = turns.where("place = 1").select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h"))
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("place") <= most)).join(conversations, (F.col("conv_id") == F.col("base")) & (F.col("place") <= F.col("h")))
    tails = turns.where(F.col("place") > F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1))
    none = conversations.select(F.col("c").alias("conv_id"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).cast("long").alias("size"))
    return heads.select(F.col("c").alias("conv_id"), "place", "turn_digest", "size").unionAll(tails.select("conv_id", "place", "turn_digest", "size")).unionAll(none)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation, from its turns in order (null digest: none)."""
    schema = pa.schema([("conv_id", pa.int64()), ("path", pa.binary()), ("sizes", pa.binary())])
    conv, chain, sizes, done = None, [], [], []

    def row() -> tuple:
        return conv, b"".join(chain), np.array(list(accumulate(sizes)), np.int64).tobytes()

    for batch in batches:
        for c, t, size in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn_digest", "size")), strict=True):
            if c != conv:
                if conv is not None:
                    done.append(row())
                conv, chain, sizes = c, [], []
            if t is not None:
                chain.append(hashlib.blake2b((chain[-1] if chain else b"") + t, digest_size=WIDE).digest())
                sizes.append(size)
        if done:
            yield _batch(done, schema)
            done = []
    if conv is not None:
        yield _batch([row()], schema)


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes) of ``numbered`` turns: the chained digests of all prefixes, and the bytes of the texts so far as 8-byte numbers."""
    dealt = turns.repartition(shuffle_width(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.select("conv_id", "turn_digest", "size").mapInArrow(_chained, PATHS)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("end", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    end, ids = None, []
    for batch in batches:
        done = []
        for e, c in zip(batch.column("end").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (e != end or len(ids) == CHUNK):
                done.append((end, ids[0], ",".join(map(str, ids))))
                ids = []
            end = e
            ids.append(c)
        if done:
            yield _batch(done, schema)
    if ids:
        yield _batch([(end, ids[0], ",".join(map(str, ids)))], schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("end", pa.binary()), ("ends", pa.string())])
    end, digest = None, None
    for batch in batches:
        done = []
        for e, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if e != end:
                if digest:
                    done.append((end, digest.hexdigest()))
                end, digest = e, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield _batch(done, schema)
    if digest:
        yield _batch([(end, digest.hexdigest())], schema)


def end_digests(ended: DataFrame) -> DataFrame:
    """(end, ends): SHA-256 of the ascending, comma-joined ids of the conversations (end, conv_id) that end at a node."""
    width = shuffle_width(ended.sparkSession)
    chunks = ended.repartitionByRange(width, "end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(_chunks, "end binary, first long, ids string")
    return chunks.repartition(width, "end").sortWithinPartitions("end", "first").select("end", "ids").mapInArrow(_digests, "end binary, ends string")


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths share."""
    low, high = 0, min(len(a), len(b)) // WIDE
    while low < high:  # a shared digest means that all before it are shared
        middle = (low + high + 1) // 2
        if a[WIDE * (middle - 1) : WIDE * middle] == b[WIDE * (middle - 1) : WIDE * middle]:
            low = middle
        else:
            high = middle - 1
    return low


class _Point:
    """An open point: what the paths below it have brought so far."""

    __slots__ = ("depth", "here", "n", "low", "leaves", "children", "weighted", "own", "ends")

    def __init__(self, depth: int, here: bool) -> None:
        self.depth, self.here = depth, here  # here: this stretch is the first that has it
        self.n = self.leaves = self.children = self.weighted = self.own = 0
        self.low, self.ends = None, None


class _Stretch:
    """The tree over one sorted stretch of paths that shares ``left`` turns with the one before it."""

    def __init__(self, left: int, rows: list[tuple]) -> None:
        self.left, self.rows, self.path, self.sizes = left, rows, None, None
        self.stack = [_Point(d, False) for d in range(left + 1)]

    def add(self, path: bytes, sizes: bytes, n: int, low: int, ends: str) -> None:
        if self.path is not None:
            self._close_to(shared_turns(self.path, path))
        self.path, self.sizes = path, [0, *np.frombuffer(sizes, np.int64).tolist()]
        depth = len(path) // WIDE
        if depth > self.stack[-1].depth:
            self.stack.append(_Point(depth, True))
        top = self.stack[-1]  # only the path without turns ends at a point that is there: the root
        top.n, top.low, top.ends = top.n + n, low if top.low is None else min(top.low, low), ends
        top.weighted += n * self.sizes[depth]
        if depth:
            top.own += self.sizes[depth] - self.sizes[depth - 1]

    def finish(self, right: int) -> None:
        """Closes all; the next stretch shares ``right`` turns with the last path."""
        self._close_to(right)
        while self.stack:
            point = self.stack.pop()
            parent = self.stack[-1].depth if self.stack else -1
            self._give(point, parent, True)
            if self.stack:
                self._merge(point, self.stack[-1])

    def _close_to(self, depth: int) -> None:
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            if not point.leaves:  # nothing below it brought one
                point.leaves = 1
            if self.stack[-1].depth < depth:
                self.stack.append(_Point(depth, True))
                self.stack[-1].own = self.sizes[depth] - self.sizes[depth - 1]
            self._give(point, self.stack[-1].depth, not point.here)
            self._merge(point, self.stack[-1])

    def _merge(self, point: _Point, parent: _Point) -> None:
        parent.n += point.n
        parent.low = point.low if parent.low is None else min(parent.low, point.low)
        parent.leaves += point.leaves
        parent.weighted += point.weighted
        parent.own += point.own + self.sizes[point.depth - 1] - self.sizes[parent.depth]
        parent.children += point.here

    def _give(self, point: _Point, parent: int, part: bool) -> None:
        """The point and the nodes on the edge above it, from the bottom up."""
        own, key = point.own, lambda d: self.path[WIDE * (d - 1) : WIDE * d] if d else b""
        for d in range(point.depth, parent, -1):
            above, at = (self.sizes[d - 1] if d else 0), d == point.depth
            own = own if at else own + self.sizes[d] - above
            up = key(d - 1) if d and (part or d == parent + 1) else None
            self.rows.append((key(d), d, point.low, point.n, point.children if at else 1, point.leaves, point.weighted, own, above, point.ends if at else None, up, part, at))


def _built(left: dict[int, int], right: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), *((n, pa.int64()) for n in ("depth", "low", "n", "children", "leaves", "weighted", "own", "above")), ("ends", pa.string()), ("parent", pa.binary()), ("part", pa.bool_()), ("point", pa.bool_())])
        rows, at, stretch = [], None, None
        for batch in batches:
            for pid, *row in zip(*(batch.column(n).to_pylist() for n in ("pid", "path", "sizes", "n", "low", "ends")), strict=True):
                if pid != at:
                    if stretch:
                        stretch.finish(right[at])
                    at, stretch = pid, _Stretch(left[pid], rows)
                stretch.add(*row)
                if len(rows) >= AT_ONCE:
                    yield _batch(rows, schema)
                    rows.clear()
        if stretch:
            stretch.finish(right[at])
        for i in range(0, len(rows), AT_ONCE):
            yield _batch(rows[i : i + AT_ONCE], schema)

    return run


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = b""
    for batch in batches:
        shared = []
        for first, end in zip(batch.column("first").to_pylist(), batch.column("last").to_pylist(), strict=True):
            shared.append(shared_turns(last, first))
            last = end
        yield pa.RecordBatch.from_arrays([batch.column("pid"), pa.array(shared, pa.int64())], names=["pid", "left"])


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie over (conv_id, path, sizes) as a row each.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark, width = conversations.sparkSession, shuffle_width(conversations.sparkSession)
    n = F.octet_length("path")
    table = written(conversations.withColumn("end", F.substring("path", F.greatest(n - (WIDE - 1), F.lit(1)), F.lit(WIDE))), "paths")
    distinct = table.groupBy("end").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    whole = distinct.join(end_digests(table.select("end", "conv_id")), "end")
    # The stretches are fixed by writing them; a sort that is made again may cut elsewhere.
    stretches = written(whole.repartitionByRange(width, "path").sortWithinPartitions("path").withColumn("pid", F.spark_partition_id()).select("pid", "path", "sizes", "n", "low", "ends"), "stretches")
    ends = stretches.groupBy("pid").agg(F.min("path").alias("first"), F.max("path").alias("last"))  # a row for each stretch
    left = {r.pid: r.left for r in ends.coalesce(1).sortWithinPartitions("pid").mapInArrow(_borders, "pid int, left long").collect()}
    in_order = sorted(left)
    right = {p: left[q] for p, q in zip(in_order, in_order[1:], strict=False)} | {p: 0 for p in in_order[-1:]}
    built = written(stretches.repartitionById(width, F.col("pid")).sortWithinPartitions("pid", "path").mapInArrow(_built(left, right), NODES), "built")
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "weighted", "own")]
    merged = built.where("part").groupBy("key", "depth").agg(F.min("low").alias("low"), *sums, F.first("above").alias("above"), F.max("ends").alias("ends"), F.first("parent").alias("parent"), F.lit(True).alias("part"), F.lit(True).alias("point"))
    nodes = written(built.where("not part").unionByName(merged), "nodes")
    points = nodes.where("point").select(F.col("key").alias("up"), F.col("low").alias("parent_low"))
    under = nodes.where("parent is not null").join(points, F.col("parent") == F.col("up")).drop("up")
    others = nodes.where("parent is null").withColumn("parent_low", F.when(F.col("depth") > 0, F.col("low")))
    return under.unionByName(others).select(
        F.col("low").alias("conv_id"),
        "depth",
        F.col("parent_low").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.when(F.col("children") == 0, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        (F.col("weighted") - F.col("n") * F.col("above") - F.col("own")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"),
    )
