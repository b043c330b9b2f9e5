"""Vector code compression: product codes, their codebooks fitted by Lloyd's rounds in Elkan's form.

A vector becomes whole numbers, floor(``SCALE`` * x), and is cut into ``PARTS`` consecutive parts. Each part
position has a codebook of ``ENTRIES`` entries that starts as the parts of the vectors with the smallest keys. In each
round every part goes to its nearest entry (squared Euclidean distance, ties to the lower index), then each
entry becomes the floor of the mean of its parts; an entry without parts stays.

Elkan's bounds live beside the vectors, in a table written anew each round: for each part an upper bound of the distance
to its own entry and a lower bound of that to every entry. When entries move, an upper bound grows by the
way its entry went and a lower bound shrinks by it. An entry is left out only if its lower bound, or half its distance
from the own entry, is strictly above the upper bound; all others are measured in whole numbers, so ties are
exact. Bounds are kept as 4-byte floats rounded outwards, which keeps them bounds.

A round is one pass without a shuffle: tasks write the rows' new state and, once each, the sums by entry; only these
sums (entries x components) reach the driver, where the codebooks are a few kilobytes. The table of
the round before is removed when the next is there.

Defined results: rows whose vector is null, empty, or holds a null or non-finite component are dropped, as are
vectors of another length than the one with the smallest key; null keys come last, rows that tie on the key are ordered by
their vectors; repeated rows are coded each; fewer vectors than ``ENTRIES`` give as many entries; a length that
``PARTS`` doesn't divide is padded with zeros; components beyond about 2**30 / sqrt(part width) after
scaling are clamped, so that squares fit; an empty table gives an empty table; other columns pass only as asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_path, utf8, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def _whole(flat: np.ndarray, n: int, width: int, parts: int, scale: int) -> np.ndarray:
    """Vectors as whole numbers, (n, parts, width), padded with zeros."""
    most = int(2**30 / width**0.5)
    x = np.zeros((n, parts * width), np.int64)
    x[:, : flat.size // max(n, 1)] = np.clip(np.floor(flat.astype(np.float64) * scale), -most, most).reshape(n, -1)
    return x.reshape(n, parts, width)


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def shifted(own: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of one part position after its entries moved."""
    return _above(upper.astype(np.float64) + moved[own]), _below(lower.astype(np.float64) - moved)


def reassigned(x: np.ndarray, book: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of the parts (n, width) at one position, their bounds, and how many distances that took.

    ``own`` (n), ``upper`` (n) and ``lower`` (n, entries) hold for ``book``.
    """
    n, at = len(x), np.arange(len(x))
    half = np.nextafter(np.sqrt(((book[:, None] - book[None]) ** 2).sum(2)) / 2, 0)
    near = (lower <= upper[:, None]) & (half[own] <= upper[:, None])
    near[at, own] = False
    rows = np.flatnonzero(near.any(1))
    if not len(rows):
        return own, upper, lower, 0
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    mine, k = own[rows], np.arange(len(rows))
    distance = np.full((len(rows), len(book)), np.iinfo(np.int64).max)
    distance[k, mine] = ((x[rows] - book[mine]) ** 2).sum(1)
    tight = _above(np.sqrt(distance[k, mine]))
    r, j = np.nonzero(near[rows] & (lower[rows] <= tight[:, None]) & (half[mine] <= tight[:, None]))
    distance[r, j] = ((x[rows[r]] - book[j]) ** 2).sum(1)
    lower[rows[r], j] = _below(np.sqrt(distance[r, j]))
    lower[rows, mine] = _below(np.sqrt(distance[k, mine]))
    best = distance.argmin(1)  # the first of equals
    own[rows], upper[rows] = best, _above(np.sqrt(distance[k, best]))
    return own, upper, lower, len(rows) + len(r)


def _state(batch: pa.RecordBatch, parts: int, width: int, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    read = lambda name, kind: np.frombuffer(utf8(batch.column(name))[0].tobytes(), kind)
    x = read("x", np.int32).reshape(n, parts, width).astype(np.int64)
    bounds = read("bounds", np.float32).reshape(n, parts, 1 + entries)
    return x, read("own", np.uint8).reshape(n, parts).astype(np.int64), bounds[:, :, 0], bounds[:, :, 1:]


def _rows(values: np.ndarray) -> pa.Array:
    """A binary for each row of a contiguous array."""
    body, n = np.ascontiguousarray(values), len(values)
    step = body.nbytes // max(n, 1)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * step).astype(np.int32)), pa.py_buffer(body)])


def _packed(parts: int, width: int, entries: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            bounds = np.zeros((n, parts, 1 + entries), np.float32)
            bounds[:, :, 0] = np.inf
            yield pa.RecordBatch.from_arrays([batch.column("k"), _rows(_whole(flat, n, width, parts, scale).astype(np.int32)), _rows(np.zeros((n, parts), np.uint8)), _rows(bounds)], names=["k", "x", "own", "bounds"])

    return run


def _round(books: np.ndarray, moved: np.ndarray | None):
    """One round: the rows' new state (part -1), then what this task's rows add to each entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts, kinds = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64), None
        for batch in batches:
            n, kinds = batch.num_rows, batch.schema.field("k").type
            x, own, upper, lower = _state(batch, parts, width, entries)
            found, bounds = np.empty((n, parts), np.uint8), np.empty((n, parts, 1 + entries), np.float32)
            for p in range(parts):
                u, low = (upper[:, p], lower[:, p]) if moved is None else shifted(own[:, p], upper[:, p], lower[:, p], moved[p])
                found[:, p], bounds[:, p, 0], bounds[:, p, 1:], _ = reassigned(x[:, p], books[p], own[:, p], u, low)
                np.add.at(totals[p], found[:, p], x[:, p])
                counts[p] += np.bincount(found[:, p], minlength=entries)
            none = lambda kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([pa.array(["state"] * n), batch.column("k"), batch.column("x"), _rows(found), _rows(bounds), none(pa.int32()), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.int64())], names=ROUND)
        if kinds is not None:
            p, e, c = (v.ravel().astype(np.int32) for v in np.indices(books.shape))
            n = len(p)
            yield pa.RecordBatch.from_arrays([pa.array(["sums"] * n), pa.nulls(n, kinds), *[pa.nulls(n, pa.binary())] * 3, pa.array(p), pa.array(e), pa.array(c), pa.array(totals.ravel()), pa.array(np.repeat(counts.ravel(), width))], names=ROUND)

    return run


ROUND = ["kind", "k", "x", "own", "bounds", "part", "entry", "place", "total", "n"]


def _coded(books: np.ndarray, moved: np.ndarray | None):
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own, upper, lower = _state(batch, parts, width, entries)
            error, found = np.zeros(len(x), np.int64), np.empty((len(x), parts), np.uint8)
            for p in range(parts):
                u, low = (upper[:, p], lower[:, p]) if moved is None else shifted(own[:, p], upper[:, p], lower[:, p], moved[p])
                found[:, p] = reassigned(x[:, p], books[p], own[:, p], u, low)[0]
                error += ((x[:, p] - books[p][found[:, p]]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([row.tobytes().hex() for row in found], pa.string()), pa.array(error)], names=["k", "code", "error"])

    return run


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``keep`` (by default the key), ``code`` (two hex digits a part) and ``error`` of each vector as a written table, and the codebooks (parts, entries, width)."""
    spark, keep = vectors.sparkSession, keep or [key]
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.struct(*keep).alias("k"), F.col(key).alias("id"), F.col(vector).alias("v")).where((F.size("v") > 0) & F.forall("v", sound))
    in_order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*in_order).limit(1).select(F.size("v")).collect()
    if not first:
        return rows.select("k.*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    width = -(-first[0][0] // parts)
    rows = rows.where(F.size("v") == first[0][0])
    seeds = np.array([r[0] for r in rows.orderBy(*in_order).limit(entries).select("v").collect()], np.float64)
    books = np.ascontiguousarray(_whole(seeds.ravel(), len(seeds), width, parts, scale).transpose(1, 0, 2))
    entries, moved = len(seeds), None
    k = rows.schema["k"].dataType.simpleString()
    path = shared_path(spark, "codes")
    state = written(rows.select("k", "v").mapInArrow(_packed(parts, width, entries, scale), f"k {k}, x binary, own binary, bounds binary"), "codes", path=path)
    for _ in range(rounds):
        before, path = path, shared_path(spark, "codes")
        schema = f"kind string, k {k}, x binary, own binary, bounds binary, part int, entry int, place int, total long, n long"
        state.mapInArrow(_round(books, moved), schema).write.partitionBy("kind").option("compression", "zstd").parquet(path)
        remove(before, spark)
        table = spark.read.schema(schema).parquet(path)
        # A number for each component of each entry.
        sums = table.where("kind = 'sums'").groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        last = books.copy()
        for s in sums.where("n > 0").collect():
            books[s.part, s.entry, s.place] = int(s.total) // s.n
        moved = np.sqrt(((books - last) ** 2).sum(2))
        state = table.where("kind = 'state'").select("k", "x", "own", "bounds")
    coded = written(state.mapInArrow(_coded(books, moved), f"k {k}, code string, error long").select("k.*", "code", "error"), "coded")
    remove(path, spark)
    return coded, books


def with_group_error(coded: DataFrame, group: str) -> DataFrame:
    """``coded``, a written table, with ``label_error``: the error of all rows of the same ``group``, null being one.

    The sums are written first, so that the join is one of two tables, of which adaptive execution splits a large group.
    """
    sums = written(coded.groupBy(F.col(group).alias("same")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(sums, F.col(group).eqNullSafe(F.col("same"))).drop("same")
