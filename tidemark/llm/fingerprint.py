"""Document fingerprints: digests of statistically improbable features.

Every window of ``WINDOW`` bytes has a rank by its entropy: the further the entropy is from that of
ordinary text (``TYPICAL``, in thousandths of the greatest: about the median over windows of prose, 702 on
the test documents), the rarer the window and the lower the
rank; runs of one or two values (below ``FLAT``) are never features. In every stretch of ``POPULAR``
neighbouring windows the lowest rank, leftmost among equals, gets a vote; windows with at least
``VOTES`` votes are the features, at least one for each text (the whole text if it is shorter than a
window). Features are hashed and inserted, in order, into a chain of Bloom filters of ``BITS`` bits
with ``HASHES`` bits a feature and up to ``FULL`` features each.

Entropies are exact sums of integers: as a window moves by a byte, only the counts of the byte that
enters and of the one that leaves change, and both counts are sums of comparisons with shifted text,
which run over a whole batch of documents.

Two digests are compared filter by filter: the bits in common beyond those expected by chance, as a
share of the most there could be. Each filter of the shorter chain counts with its best partner,
weighted by its features. The result is from 0 to 1; 1 for equal texts.

Defined results: null and empty texts have the fingerprint of no feature, which is like itself (1)
and nothing else (0); texts of any length are read whole; repeated rows are rows of their own, in the
order of their texts; null ids come first; other columns are ignored. A text of a few hundred bytes has few
features, so its likeness to an edit of half of it may be no more than to any other text's.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_hash_order, shuffle_width, slices, utf8

WINDOW = 32
POPULAR = 32
VOTES = 8
TYPICAL = 710
FLAT = 120
BITS = 2048
HASHES = 5
FULL = 160
PREFIX = "sd1"
_UNRANKED = 1 << 20
#: c * log2(c) in units of 2^-20, for counts up to the window.
_PART = np.round(np.array([0.0] + [c * np.log2(c) for c in range(1, WINDOW + 1)]) * (1 << 20)).astype(np.int64)


def window_ranks(body: np.ndarray) -> np.ndarray:
    """The rank of each window of a run of bytes; windows may span documents."""
    n = len(body) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ahead = np.ones(len(body), np.uint8)  # of each byte, how often it is in the window that it begins
    behind = np.ones(len(body), np.uint8)  # and in the one that it ends
    for d in range(1, WINDOW):
        same = body[:-d] == body[d:]
        ahead[:-d] += same
        behind[d:] += same
    first = np.bincount(body[:WINDOW], minlength=256)
    total = np.empty(n, np.int64)
    total[0] = _PART[first].sum()
    # The byte that leaves takes its count down by one; the one that enters, counted after that, takes its own up.
    leaves, enters = ahead[: n - 1].astype(np.int64), behind[WINDOW:].astype(np.int64)
    total[1:] = total[0] + np.cumsum(_PART[enters] - _PART[enters - 1] - (_PART[leaves] - _PART[leaves - 1]))
    greatest = np.log2(WINDOW)
    level = np.rint((greatest - total / (WINDOW * float(1 << 20))) / greatest * 1000).astype(np.int64)
    return np.where(level < FLAT, _UNRANKED, 1000 - np.abs(level - TYPICAL))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, from prefix and suffix minima of blocks."""
    n = len(values)
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(np.int64).max)
    grid[:n] = values
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def features(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the features of a run of documents, and how many come before each (n+1)."""
    n_docs = len(at) - 1
    size = np.diff(at)
    windows = np.maximum(size - WINDOW + 1, 0)
    ranks = window_ranks(body)
    n = len(ranks)
    doc = np.repeat(np.arange(n_docs), size)
    starts = [at[:-1][(size > 0) & (size < WINDOW)]]
    if n:
        own = doc[:n] == doc[WINDOW - 1 : WINDOW - 1 + n]  # the window lies in one document
        value = np.where(own, ranks, 2 * _UNRANKED) * (1 << 40) + np.arange(n)
        chosen = np.zeros(n, bool)
        if n >= POPULAR:
            whole = own[: n - POPULAR + 1] & own[POPULAR - 1 :] & (doc[: n - POPULAR + 1] == doc[POPULAR - 1 : n])
            best = _sliding_min(value, POPULAR)[whole]
            votes = np.bincount(best & ((1 << 40) - 1), minlength=n)
            chosen = (votes >= VOTES) & (ranks < _UNRANKED)
        some = np.flatnonzero(windows > 0)
        if len(some):
            edges = np.stack([at[some], at[some] + windows[some]], 1).ravel()
            lowest = np.minimum.reduceat(np.append(value, np.iinfo(np.int64).max), edges)[::2]
            chosen[lowest & ((1 << 40) - 1)] = True
        starts.append(np.flatnonzero(chosen))
    start = np.sort(np.concatenate(starts))
    length = np.minimum(WINDOW, size[np.searchsorted(at, start, "right") - 1]) if len(start) else start
    return start, length, np.searchsorted(start, at)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def digest(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filters (rows of BITS / 8 bytes) of a run of documents, features in each, and filters before each document (n+1)."""
    start, length, before = features(body, at)
    padded = np.concatenate([body, np.zeros(WINDOW, np.uint8)])
    h = length.astype(np.uint64)
    word = np.ndarray((len(padded) - 7,), "<u8", padded.data, 0, (1,))
    low = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    for i in range(0, WINDOW, 8):
        h = _mix((h + np.uint64(0x9E3779B97F4A7C15)) ^ (word[start + i] & low[np.clip(length - i, 0, 8)]))
    counts = np.diff(before)
    chain = -(-counts // FULL)
    filters = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(chain, out=filters[1:])
    number = np.arange(len(start)) - np.repeat(before[:-1], counts)
    row = np.repeat(filters[:-1], counts) + number // FULL
    bits = np.zeros(filters[-1] * BITS, bool)
    for i in range(HASHES):
        bits[row * BITS + (h >> np.uint64(11 * i) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits.reshape(-1, BITS), axis=1), np.bincount(row, minlength=filters[-1]), filters


def likeness(a: np.ndarray, a_counts: np.ndarray, b: np.ndarray, b_counts: np.ndarray) -> float:
    """Of two chains of filters, from 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b) or len(a) == len(b) and a_counts.sum() > b_counts.sum():
        a, a_counts, b, b_counts = b, b_counts, a, a_counts
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    set_a, set_b = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    best = np.zeros(len(a))
    for i in range(len(a)):
        both = np.bitwise_count(a[i] & b).sum(1, dtype=np.int64)
        most = np.minimum(set_a[i], set_b)
        chance = set_a[i] * set_b / BITS
        best[i] = np.clip((both - chance) / np.maximum(most - chance, 1), 0, 1).max()
    return float(np.clip((best * a_counts).sum() / a_counts.sum(), 0, 1))


def written(filters: np.ndarray, counts: np.ndarray) -> str:
    """The fingerprint as text: a version, the features of each filter, and the filters in base64."""
    return f"{PREFIX}:{','.join(map(str, counts.tolist()))}:{base64.b64encode(filters.tobytes()).decode()}"


def parsed(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    _, counts, body = fingerprint.split(":")
    numbers = np.array([int(c) for c in counts.split(",") if c], np.int64)
    return np.frombuffer(base64.b64decode(body), np.uint8).reshape(len(numbers), BITS // 8), numbers


def compare(a: str, b: str) -> float:
    """The likeness of two written fingerprints."""
    return likeness(*parsed(a), *parsed(b))


def followed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text, range, kind) in partitions where each row is followed by the next document.

    Ids are dealt into ranges whose bounds are quantiles of all ids. Each range also gets, as its end
    (kind 1), the rows of the next range's least id, and the last range those of the least id of
    all, so that no row needs another partition. Ids alone are read to find the bounds.
    """
    spark = docs.sparkSession
    width = row_hash_order(shuffle_width(spark))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    steps = [i / width for i in range(1, width)] or [0.5]
    bounds = rows.agg(F.percentile_approx("doc_id", steps, 10 * width).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:  # a null id comes before all others
        found = np.searchsorted(edges, ids.fillna(np.iinfo(np.int64).min).to_numpy().astype(np.int64), "right")
        return pd.Series(found.astype(np.int32))

    # The smallest long stands in for null, so that the ids stay whole numbers on their way.
    placed = rows.withColumn("range", range_of(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))))
    lowest = {r["range"]: r["low"] for r in placed.groupBy("range").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull().cast("int")).alias("no_id")).select("range", F.when(F.col("no_id") == 1, F.lit(None)).otherwise(F.col("low")).alias("low")).collect()}
    ranges = sorted(lowest)
    ends = [(lowest[b], a, 1) for a, b in zip(ranges, ranges[1:], strict=False)] + [(lowest[ranges[0]], ranges[-1], 2)] if ranges else []
    first_of = spark.createDataFrame(ends or [(None, 0, 1)], "low long, of int, kind int").limit(max(len(ends), 0))
    tails = rows.join(F.broadcast(first_of), F.col("doc_id").eqNullSafe(F.col("low"))).select("doc_id", "text", F.col("of").alias("range"), "kind")
    return (
        placed.withColumn("kind", F.lit(0))
        .unionByName(tails)
        .repartition(shuffle_width(spark), "range")
        .sortWithinPartitions("range", "kind", "doc_id", "text")
    )


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit(own: str, following: str) -> str:
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


def _compare_all(ids: list, texts: list[str], after: str) -> pa.RecordBatch:
    """Results for a run of documents, of which each is followed by the next, the last by ``after``."""
    nexts = [*texts[1:], after]
    edited = [_edit(a, b) for a, b in zip(texts, nexts, strict=True)]
    n = len(texts)
    filters, counts, at = digest(*utf8(pa.array([*texts, after, *edited], pa.string())))
    part = lambda i: (filters[at[i] : at[i + 1]], counts[at[i] : at[i + 1]])
    own, changed = [part(i) for i in range(n + 1)], [part(n + 1 + i) for i in range(n)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([written(*f) for f in own[:n]], pa.string()),
            pa.array([written(*f) for f in changed], pa.string()),
            pa.array([likeness(*own[i], *changed[i]) for i in range(n)], pa.float64()),
            pa.array([likeness(*own[i], *own[i + 1]) for i in range(n)], pa.float64()),
        ],
        names=[c.split()[0] for c in SCHEMA.split(", ")],
    )


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    texts: list[str] = []
    at, held, ended = None, 0, False
    for batch in batches:
        for doc_id, text, where, kind in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if where != at:
                at, ended, ids, texts, held = where, False, [], [], 0
            if ended:  # further rows of the same id as the end's
                continue
            if held > 1 << 19 or kind:
                if ids:
                    yield _compare_all(ids, texts, text)
                ids, texts, held, ended = [], [], 0, bool(kind)
            if not kind:
                ids.append(doc_id)
                texts.append(text)
                held += len(text)


def fingerprint_and_edit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with the likeness to that and to the next document's."""
    return followed(docs, key, text).mapInArrow(_run, SCHEMA)


def fingerprint(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with the ``fingerprint`` of each text."""
    picked = docs.select(*keys, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 1 << 20):
            filters, counts, at = digest(*utf8(batch.column("__text")))
            prints = [written(filters[a:b], counts[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(prints, pa.string())], names=[*keys, "fingerprint"])

    schema = ", ".join(f"`{k}` {picked.schema[k].dataType.simpleString()}" for k in keys)
    return picked.mapInArrow(run, f"{schema}, fingerprint string")
