"""SimHash near-duplicates by anchor-point covering.

Fingerprints. A-Z are lower-cased, words are runs of bytes other than white space, and every run of
three words (repeats included; the whole sequence if there are fewer) is hashed by XXH64. A bit of the
fingerprint is 1 if it is set in over half of the hashes; a text without words has fingerprint zero.

Links. Two segments of 23 bits are covered by the perfect binary Golay code, every word of which has
one codeword within 3 bits: pairs of codewords are the anchors. A fingerprint is replicated to each
anchor within the covering radius plus the threshold, segment by segment, i.e. to every anchor that
may be the nearest one of a fingerprint ``threshold`` bits away. So any two linked fingerprints meet
at an anchor, where all 64 bits are compared. That is about 70 rows for a distinct fingerprint, over
2^24 anchors.

Copies are first reduced to distinct fingerprints. At an anchor, small groups are compared row by
row; a large group is linked in linear time, as two fingerprints differ in at most two bits exactly
if they share one that differs from each in at most one. Either way the anchor emits a star for each
group it found, never all pairs. Stars are joined to components by alternating large-star and
small-star steps over tables in the shared folder.

Near copies by similarity (``similar``) are texts with four fifths of their distinct five-word shingles in common.
Fingerprints of such texts differ in up to 15 % of their bits, beyond what one short code can cover,
so a wide fingerprint is read in ``LOOKS`` looks of two segments, each replicated to the anchors within the covering
radius plus one bit: two texts of similarity 0.8 meet at an anchor of some look with a probability of
0.994, of 0.85 with 0.9998 (from 0.19 and 0.3 a look, measured on random words). Rows that meet are compared by a word, then by the
whole wide fingerprint, and at last by their shingles, counted in full. A row with many close partners at an
anchor is in a crowd there, which is paired with one of them only; what the components of these pairs leave apart
is then compared in full at the crowd's anchors, dealt over parts that each hold a block of rows while another comes
by, and links are verified on the spot. Texts are told apart by 16 bytes. A look has 2^24 anchors, and a text about ten of them:
beyond some 10^8 distinct texts chance fills them, and a third segment is due.

Defined results: null and empty texts have fingerprint zero and are linked like any other; the
component is the smallest doc_id reachable, null ones left out unless there are no others; repeated
rows are kept and share a component; empty tables give empty tables; other columns are ignored. For
``similar`` texts of equal words are one node, blank ones too.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_path, shuffle_width, slices, tidy, utf8, written

SEED = 42
SHINGLE = 3
THRESHOLD = 2
#: Generator polynomial of the binary Golay code of length 23, its length, dimension and covering radius.
GOLAY, LENGTH, DIMENSION, RADIUS = 0b101011100011, 23, 12, 3
#: Groups at an anchor of up to this many rows are compared row by row.
SMALL = 48
#: Keys of a large group that are held at a time.
KEYS_AT_ONCE = 4_000_000

#: Similarity search: words of a shingle, and the similarity as a fraction of whole numbers.
SIMILAR_SHINGLE, PARTS, OF = 5, 4, 5
#: Looks of two segments, the bits beyond the covering radius in each, and words of a wide fingerprint: those of all looks and one that is compared first.
LOOKS, LOOK_THRESHOLD = 24, 1
WORDS = -(-LOOKS * 2 * LENGTH // 64) + 1
#: Differing bits of texts of similarity 0.8 are 15 % at most (an angle of acos(8/9)): four standard errors more, of one word and of all.
CLOSE = 21
LIKELY = int(WORDS * 64 * 0.1515 + 4 * (WORDS * 64 * 0.1515 * 0.8485) ** 0.5)
#: Close partners at an anchor beyond which a text is in a crowd; rows of an anchor that are all compared, and that are held at once; nodes that a task remembers; bits of a filter for candidates.
CROWD, ALL, HELD, SEEN, FILTER = 3, 4_096, 16_384, 1_000_000, 1 << 23
_WORD_FLIP = np.random.default_rng(SEED).integers(0, 1 << 63, WORDS, np.uint64)

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_spans(body: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with single spaces between words; start and end of each shingle in them; shingles before each document (n+1)."""
    white = _WHITE[body]
    fresh = np.empty(len(body), bool)
    fresh[1:] = white[:-1]
    edges = at[:-1][np.diff(at) > 0]
    fresh[edges] = True
    start = np.flatnonzero(~white & fresh)
    first_word = np.searchsorted(start, at)  # words before each document
    keep = ~white
    inner = np.ones(len(start), bool)
    inner[first_word[:-1][np.diff(first_word) > 0]] = False
    keep[start[inner] - 1] = True
    lowered = np.where(white, np.uint8(0x20), _LOWER[body])[keep]
    before = np.zeros(len(body) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    word = before[start]
    ends = np.empty(len(start), np.int64)
    ends[:-1] = word[1:] - 1
    last = first_word[1:][np.diff(first_word) > 0] - 1
    ends[last] = before[at[1:]][np.diff(first_word) > 0]
    words = np.diff(first_word)
    counts = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    total = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    head = np.repeat(first_word[:-1] - total[:-1], counts) + np.arange(total[-1])
    tail = head + np.repeat(np.minimum(words, size) - 1, counts)
    return lowered, word[head], ends[tail], total


def majorities(hashes: np.ndarray, total: np.ndarray) -> np.ndarray:
    """For each run of hashes, the word of the bits set in over half of them; zero for an empty run.

    Eight bits of a hash are counted at once, in the bytes of one word, over up to 255 hashes at a time.
    """
    out = np.zeros(len(total) - 1, np.uint64)
    size = np.diff(total)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    parts = -(-size[some] // 255)
    first = np.cumsum(parts) - parts
    edge = np.repeat(total[:-1][some], parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    bits = np.empty((len(some), 8, 8), bool)
    for k in range(8):
        lanes = np.add.reduceat(hashes >> np.uint64(k) & np.uint64(0x0101010101010101), edge)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
        bits[:, :, k] = 2 * counts > size[some][:, None]
    out[some] = np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_hashes(body: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of the shingles of a run of documents, those before each document (n+1), and a digest of each document's words, 16 bytes."""
    nodes = [xxhash.xxh3_128_digest(b"", SEED)] * (len(at) - 1)
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), nodes
    lowered, start, end, total = shingle_spans(body, at, size)
    raw, digest = lowered.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.uint64)
    for i in np.flatnonzero(np.diff(total)).tolist():
        nodes[i] = xxhash.xxh3_128_digest(raw[start[total[i]] : end[total[i + 1] - 1]], SEED)
    return hashes, total, nodes


def fingerprints(body: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each of a run of documents."""
    hashes, total, _ = shingle_hashes(body, at, size)
    return majorities(hashes, total)


@lru_cache(4)
def _syndrome_bytes() -> np.ndarray:
    """For each of three bytes of a word, the remainder of each value by the generator."""
    table = np.zeros((3, 256), np.int32)
    for byte in range(3):
        for value in range(256):
            r = (value << 8 * byte) & ((1 << LENGTH) - 1)
            for bit in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
                if r >> bit & 1:
                    r ^= GOLAY << (bit - (LENGTH - DIMENSION))
            table[byte, value] = r
    return table


def syndrome(words: np.ndarray) -> np.ndarray:
    t = _syndrome_bytes()
    return t[0][words & 255] ^ t[1][words >> 8 & 255] ^ t[2][words >> 16 & 255]


@lru_cache(4)
def _patterns(threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences to codewords, by syndrome and by bits beyond the covering radius (0 .. threshold): the differences, and their offsets [syndrome, beyond]."""
    found, weight = [], []
    for w in range(RADIUS + threshold + 1):
        for bits in itertools.combinations(range(LENGTH), w):
            found.append(sum(1 << b for b in bits))
            weight.append(max(0, w - RADIUS))
    words, beyond = np.array(found, np.int64), np.array(weight)
    group = syndrome(words) * (threshold + 1) + beyond
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group, minlength=(threshold + 1) << (LENGTH - DIMENSION))
    return words[order], np.concatenate([[0], np.cumsum(counts)])


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


def anchors(prints: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) for every anchor that a fingerprint is replicated to."""
    patterns, at = _patterns(threshold)
    mask = np.uint64((1 << LENGTH) - 1)
    a, b = (prints & mask).astype(np.int64), (prints >> np.uint64(LENGTH) & mask).astype(np.int64)
    sa, sb = syndrome(a) * (threshold + 1), syndrome(b) * (threshold + 1)
    rows, out = [], []
    for i, j in itertools.product(range(threshold + 1), repeat=2):
        if i + j > threshold:
            continue
        start_a, count_a = at[sa + i], at[sa + i + 1] - at[sa + i]
        start_b, count_b = at[sb + j], at[sb + j + 1] - at[sb + j]
        row = np.repeat(np.arange(len(prints)), count_a * count_b)
        pick_a = np.repeat(_ranges(start_a, count_a), np.repeat(count_b, count_a))
        pick_b = _ranges(np.repeat(start_b, count_a), np.repeat(count_b, count_a))
        near = (a[row] ^ patterns[pick_a]) >> (LENGTH - DIMENSION) << DIMENSION | (b[row] ^ patterns[pick_b]) >> (LENGTH - DIMENSION)
        rows.append(row)
        out.append(near)
    return np.concatenate(rows), np.concatenate(out)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component, for links between n indices."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _links_large(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly the rows within ``threshold`` (2) bits, in linear time: neighbours among those that share a word one bit away."""
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    passes = max(1, -(-len(prints) * len(flips) // KEYS_AT_ONCE))
    left, right = [], []
    for p in range(passes):
        keys = (prints[:, None] ^ flips).ravel()
        rows = np.repeat(np.arange(len(prints)), len(flips))
        if passes > 1:
            mine = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(passes) == np.uint64(p)
            keys, rows = keys[mine], rows[mine]
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        same = np.flatnonzero(keys[1:] == keys[:-1])
        left.append(rows[same])
        right.append(rows[same + 1])
    return np.concatenate(left), np.concatenate(right)


def stars(anchor: np.ndarray, prints: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest row's fingerprint of its group) of rows sorted by anchor."""
    n = len(anchor)
    edge = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    size = np.diff(np.append(edge, n))
    left, right = [], []
    small = np.repeat(size <= SMALL, size)
    end = np.repeat(edge + size, size)
    alive = np.flatnonzero(small & (np.arange(n) + 1 < end))
    step = 1
    while len(alive):
        hit = alive[np.bitwise_count(prints[alive] ^ prints[alive + step]) <= threshold]
        left.append(hit)
        right.append(hit + step)
        step += 1
        alive = alive[alive + step < end[alive]]
    for e, s in zip(edge[size > SMALL], size[size > SMALL], strict=True):
        a, b = _links_large(prints[e : e + s], threshold)
        left.append(a + e)
        right.append(b + e)
    if not left or not sum(map(len, left)):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    root = _roots(n, np.concatenate(left), np.concatenate(right))
    member = np.flatnonzero(root != np.arange(n))
    return prints[member], prints[root[member]]


def fingerprint_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and its fingerprint as a long with the same bits."""
    picked = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = fingerprints(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return picked.mapInArrow(run, "doc_id long, print long")


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b), b < a, that connect the distinct fingerprints of column ``print`` as those within ``threshold`` bits do."""
    if threshold != 2:
        raise ValueError("large groups are linked for a threshold of 2")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("print").to_numpy()
            for i in range(0, len(own), 5_000):
                row, near = anchors(own[i : i + 5_000].view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(own[i : i + 5_000][row])], names=["anchor", "print"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, held_p = [], []

        def found() -> pa.RecordBatch:
            a, b = stars(np.concatenate(held_a), np.concatenate(held_p).view(np.uint64), threshold)
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        for batch in batches:
            a, p = batch.column("anchor").to_numpy(), batch.column("print").to_numpy()
            cut = int(np.searchsorted(a, a[-1])) if len(a) else 0
            if cut:  # the last anchor's group may go on in the next batch
                held_a.append(a[:cut])
                held_p.append(p[:cut])
                yield found()
                held_a, held_p = [a[cut:]], [p[cut:]]
            elif len(a):
                if held_a and held_a[-1][-1] != a[0]:
                    yield found()
                    held_a, held_p = [], []
                held_a.append(a)
                held_p.append(p)
        if held_a:
            yield found()

    width = shuffle_width(prints.sparkSession)
    met = prints.select("print").mapInArrow(replicate, "anchor int, print long").repartition(width, "anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(compare, "a long, b long").distinct()


def _rooted(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node that isn't its component's smallest, from links (a, b).

    Least neighbours are tables, so that both sides of the joins with them are plain exchanges and the
    links of a hub can be split. Each round's tables are removed as the next one's are there.
    """
    spark = pairs.sparkSession
    mark = F.xxhash64("a", "b")

    def table(df: DataFrame, old: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
        path = shared_path(spark, "links")
        out = written(df, "links", path=path)
        for p in old:
            remove(p, spark)
        return out, path

    def seen(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(mark), F.sum(F.shiftright(mark, 20))).first()

    pairs, path = table(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = seen(pairs)
    while before[0]:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low, low_path = table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down, path = table(large.where("a <> b").distinct(), (low_path, path))
        least, least_path = table(down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"))
        small = down.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p")).select("p.a", "p.b")
        pairs, path = table(small.where("a <> b").distinct(), (least_path, path))
        after = seen(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(table: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id``, ``print`` and ``component_id`` for a table of ``doc_id`` and ``print``.

    The join back is by fingerprint, over all rows; the fingerprint of a large group of copies is a
    skewed key, which adaptive execution splits.
    """
    distinct = written(table.groupBy("print").agg(F.min("doc_id").alias("first")), "prints")
    rooted = _rooted(links(distinct, threshold))
    group = rooted.unionAll(rooted.select(F.col("root").alias("node"), "root").distinct())
    lowest = group.join(distinct, F.col("node") == F.col("print")).groupBy("root").agg(F.min("first").alias("lowest"))
    moved = group.join(lowest, "root").select("node", "lowest")
    # As a table, so that both sides of the last join are plain exchanges and the rows of a fingerprint that many copies share can be split.
    known = written(distinct.join(moved, F.col("print") == F.col("node"), "left").select(F.col("print").alias("p"), F.coalesce("lowest", "first").alias("component_id")), "components")
    return table.join(known, F.col("print") == F.col("p")).select("doc_id", "print", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row."""
    table = written(fingerprint_table(docs, key, text), "fingerprints")
    return components(table, threshold).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity: wide fingerprints, compared at the anchors of many looks, and verified in full.


def wide_fingerprints(hashes: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``WORDS`` words of fingerprint for each run of hashes, each word from hashes of its own."""
    out = np.empty((len(total) - 1, WORDS), np.uint64)
    for w in range(WORDS):
        h = (hashes ^ _WORD_FLIP[w]) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        out[:, w] = majorities(h ^ h >> np.uint64(29), total)
    return out


def look_anchors(wide: np.ndarray, look: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of two segments of the wide fingerprints, the look's number in front of the anchor."""
    at, shift = divmod(2 * LENGTH * look, 64)
    bits = wide[:, at] >> np.uint64(shift)
    if shift + 2 * LENGTH > 64:
        bits |= wide[:, at + 1] << np.uint64(64 - shift)
    row, near = anchors(bits, LOOK_THRESHOLD)
    return row, near | look << 2 * DIMENSION


def _distinct_sets(hashes: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each run, sorted, and those before each run (n+1)."""
    run = np.repeat(np.arange(len(total) - 1), np.diff(total))
    order = np.lexsort((hashes, run))
    hashes, run = hashes[order], run[order]
    first = np.append(True, (hashes[1:] != hashes[:-1]) | (run[1:] != run[:-1]))[: len(hashes)]
    return hashes[first], np.searchsorted(run[first], np.arange(len(total)))


def text_table(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIMILAR_SHINGLE) -> DataFrame:
    """``doc_id``, text hash ``t``, ``digest`` (of the words, 16 bytes), and for a digest's first row in a task its wide fingerprint."""
    picked = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, "text"):
            hashes, total, digests = shingle_hashes(*utf8(batch.column("text")), size)
            sets, at = _distinct_sets(hashes, total)
            wide = wide_fingerprints(sets, at)
            if len(seen) > SEEN:
                seen.clear()
            fresh = [d not in seen and not seen.add(d) for d in digests]
            held = pa.array([wide[i].tobytes() if f else None for i, f in enumerate(fresh)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(digests, pa.binary()), held], names=["doc_id", "t", "digest", "wide"])

    return picked.mapInArrow(tidy(run), "doc_id long, t long, digest binary, wide binary")


def _words(column: pa.Array) -> np.ndarray:
    return utf8(column)[0].view(np.uint64).reshape(-1, WORDS)


def _partners(anchor: np.ndarray, node: np.ndarray, check: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices (left, right) of close pairs of rows by anchor, and the rows that are in a crowd.

    All rows of an anchor are compared. A row with more than ``most`` close partners is in a crowd; of the pairs within a crowd only
    one for each row is given, and that in every second look: they join most of it, and what they leave apart is compared in full.
    """
    n = len(anchor)
    edge = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    size = np.diff(np.append(edge, n))
    end = np.repeat(edge + size, size)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    alive, step = np.flatnonzero(np.arange(n) + 1 < end), 1
    while len(alive):
        close = alive[np.bitwise_count(check[alive] ^ check[alive + step]) <= CLOSE]
        left.append(close)
        right.append(close + step)
        step += 1
        alive = alive[alive + step < end[alive]]
    a, b = np.concatenate(left), np.concatenate(right)
    crowd = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) > most
    inside = crowd[a] & crowd[b]
    first = np.full(n, n)  # each row's first partner in the crowd
    np.minimum.at(first, b[inside], a[inside])
    some = np.flatnonzero((first < n) & (anchor >> 2 * DIMENSION & 1 == 0))
    return np.concatenate([a[~inside], first[some]]), np.concatenate([b[~inside], some]), np.flatnonzero(crowd)


def _met(nodes: DataFrame, most: int = CROWD, compared: int = ALL) -> DataFrame:
    """Close pairs (a, b) of nodes that meet at an anchor, and rows (a, anchor) of those in a crowd there.

    Of an anchor with more than ``compared`` rows all are in its crowd, each paired with the first.
    """

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 5_000):
                part = batch.slice(i, 5_000)
                node, wide = part.column("node").to_numpy(), _words(part.column("wide"))
                for look in range(LOOKS):
                    row, near = look_anchors(wide, look)
                    yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(node[row]), pa.array(wide[row, WORDS - 1].view(np.int64))], names=["anchor", "node", "check"])

    def out(anchor: np.ndarray, node: np.ndarray, a: np.ndarray, b: np.ndarray, crowd: np.ndarray) -> pa.RecordBatch:
        """Pairs of nodes, and rows of a crowd by their indices."""
        columns = [
            pa.concat_arrays([pa.array(np.minimum(a, b)), pa.array(node[crowd])]),
            pa.concat_arrays([pa.array(np.maximum(a, b)), pa.nulls(len(crowd), pa.int64())]),
            pa.concat_arrays([pa.nulls(len(a), pa.int32()), pa.array(anchor[crowd])]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "anchor"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        crowded = None  # (anchor, first node) of an anchor too large to compare, whose rows go by

        def found(rows: list[np.ndarray]) -> pa.RecordBatch:
            anchor, node, check = rows
            a, b, crowd = _partners(anchor, node, check.view(np.uint64), most)
            return out(anchor, node, node[a], node[b], crowd)

        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            while len(held[0]):
                anchor, node, _ = held
                if crowded is None and anchor[0] == anchor[min(len(anchor) - 1, compared)] and len(anchor) > compared:
                    crowded = anchor[0], node[0]
                if crowded is None:
                    # Whole anchors before the first large one; the last anchor may go on in the next batch.
                    edge = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
                    large = edge[np.diff(np.append(edge, len(anchor))) > compared]
                    cut = int(large[0]) if len(large) else int(edge[-1])
                    if not cut:
                        break
                    yield found([h[:cut] for h in held])
                else:
                    cut = int(np.searchsorted(anchor, crowded[0], "right"))
                    first = np.full(cut, crowded[1])
                    other = node[:cut] != first
                    yield out(anchor, node, first[other], node[:cut][other], np.arange(cut))
                    if cut < len(anchor):
                        crowded = None
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield found(held)

    met = nodes.select("node", "wide").mapInArrow(tidy(replicate), "anchor int, node long, check long")
    return met.repartition(shuffle_width(nodes.sparkSession), "anchor").sortWithinPartitions("anchor", "node").mapInArrow(tidy(compare), "a long, b long, anchor int")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose wide fingerprints are near enough for the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.bitwise_count(_words(batch.column("wa")) ^ _words(batch.column("wb"))).sum(1) <= LIKELY
            yield batch.select(["a", "b"]).filter(pa.array(near))

    wide = lambda of, name: nodes.select(F.col("node").alias(of), F.col("wide").alias(name))
    return pairs.join(wide("a", "wa"), "a").join(wide("b", "wb"), "b").select("a", "b", "wa", "wb").mapInArrow(tidy(run), "a long, b long")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of distinct hashes have the similarity."""
    if OF * min(len(a), len(b)) < PARTS * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return OF * shared >= PARTS * (len(a) + len(b) - shared)


def _shingles(some: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(node, shingles) of some nodes, a written table: their texts alone are moved.

    A filter of ``FILTER`` bits, a fixed size, tells rows that can't be wanted before the join; a text's first row in a task is enough.
    """
    wanted = written(nodes.select("node", "t", "digest").join(some.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left_semi"), "wanted")
    bit = F.pmod("t", F.lit(FILTER)) + 1  # bits are numbered from 1
    rows = wanted.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bits = np.zeros(FILTER, bool)  # FILTER / 32,768 rows of 4 KB at most
    for r in rows:
        own = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        bits[(r["bucket"] - 1) * 32_768 :][: len(own)] |= own[: max(0, FILTER - (r["bucket"] - 1) * 32_768)].astype(bool)
    packed = np.packbits(bits).tobytes()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool), set()
        for batch in batches:
            t = batch.column("h").to_numpy()
            keep = known[t % FILTER]
            for i in np.flatnonzero(keep).tolist():
                if t[i] in seen:
                    keep[i] = False
                seen.add(t[i])
            if len(seen) > SEEN:
                seen.clear()
            yield batch.filter(pa.array(keep))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, total, digests = shingle_hashes(*utf8(batch.column("text")), SIMILAR_SHINGLE)
            own, at = _distinct_sets(hashes, total)
            meant = pc.equal(batch.column("digest"), pa.array(digests, batch.schema.field("digest").type))  # another text may share ``t``
            found = pa.RecordBatch.from_arrays([batch.column("node"), pa.array([own[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["node", "shingles"])
            yield found.filter(meant)

    texts = docs.select(F.xxhash64(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(tidy(pick), "h long, text string")
    found = texts.join(wanted, F.col("h") == F.col("t")).select("node", "digest", "text").mapInArrow(tidy(sets), "node long, shingles binary")
    return written(found.dropDuplicates(["node"]), "shingles")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The pairs whose sets of shingles have the similarity."""
    pairs = written(pairs, "likely")
    sets = _shingles(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (sa, at), (sb, bt) = utf8(batch.column("sa")), utf8(batch.column("sb"))
            keep = [alike(sa[at[i] : at[i + 1]].view(np.uint64), sb[bt[i] : bt[i + 1]].view(np.uint64)) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda name, as_: sets.select(F.col("node").alias(name), F.col("shingles").alias(as_))
    return written(pairs.join(of("a", "sa"), "a").join(of("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a long, b long"), "verified")


def _across(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join what is apart among the rows (anchor, part, role, node, label, wide, shingles) of an anchor.

    In a part rows of role 0 are held, those of role 1 come by, and those of role 2 do both. Every row that comes by is compared with the held
    ones of other components, and a likely pair verified on the spot; a link joins two components, so there are
    fewer than rows and no pair leaves that isn't one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, root = None, {}
        node, label, wide, sets = [], [], np.zeros((0, WORDS), np.uint64), []

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            anchor, part, role = (batch.column(c).to_numpy().astype(np.int64) for c in ("anchor", "part", "role"))
            own_wide = _words(batch.column("wide"))
            body, at = utf8(batch.column("shingles"))
            links: list[tuple[int, int]] = []
            fresh: list[int] = []  # held rows of this batch that aren't in ``wide`` yet
            for i, (n, g) in enumerate(zip(batch.column("node").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                if (anchor[i], part[i]) != current:
                    current, root, node, label, sets, fresh = (anchor[i], part[i]), {}, [], [], [], []
                    wide = wide[:0]
                own = body[at[i] : at[i + 1]].view(np.uint64)
                if role[i]:
                    near = np.flatnonzero(np.bitwise_count(np.concatenate([wide, own_wide[fresh]]) ^ own_wide[i]).sum(1) <= LIKELY) if node else ()
                    for k in near:
                        if find(g) != find(label[k]) and alike(own, sets[k]):
                            root[find(g)] = find(label[k])
                            links.append((min(n, node[k]), max(n, node[k])))
                if role[i] != 1:
                    node.append(n)
                    label.append(g)
                    sets.append(own.copy())
                    fresh.append(i)
                if len(fresh) > 256:
                    wide, fresh = np.concatenate([wide, own_wide[fresh]]), []
            wide = np.concatenate([wide, own_wide[fresh]])
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    dealt = rows.repartition(shuffle_width(rows.sparkSession), "anchor", "part").sortWithinPartitions("anchor", "part", "role", "node")
    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def _dealt(rows: DataFrame, held: int) -> DataFrame:
    """(anchor, part, role, node, label): the rows of each anchor's crowd, dealt so that any two of different components meet in a part.

    Rows of the commonest component are cut into blocks of about ``held``, which come by; the others into blocks of ``held``, which are
    held. Each block of the former meets each of the latter, and the latter meet each other, a part for each pair of blocks.
    """
    label_sizes = rows.groupBy("anchor", "label").agg(F.count("*").alias("n"))
    sizes = label_sizes.groupBy("anchor").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda n: F.ceil(n / held).cast("int")
    sizes = written(sizes.select(F.col("anchor").alias("g"), F.col("most.label").alias("top"), blocks(F.col("most.n")).alias("tops"), blocks(F.col("n") - F.col("most.n")).alias("others")), "sizes")
    at = lambda part, role: F.struct(part.cast("long").alias("part"), F.lit(role).alias("role"))
    tops, others = F.col("tops").cast("long"), F.col("others").cast("long")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("major"), tops).otherwise(others))
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pair = lambda a, b: tops * others + a * others + b
    coming = F.transform(every(others), lambda k: at(own * others + k, 1))
    holding = F.concat(
        F.transform(every(tops), lambda p: at(p * others + own, 0)),
        F.transform(F.filter(every(others), lambda k: k > own), lambda k: at(pair(own, k), 0)),
        F.transform(F.filter(every(others), lambda k: k < own), lambda k: at(pair(k, own), 1)),
        F.array(at(pair(own, own), 2)),
    )
    marked = rows.join(sizes, F.col("anchor") == F.col("g")).withColumn("major", F.col("label") == F.col("top"))
    return marked.select("anchor", F.explode(F.when(F.col("major"), coming).otherwise(holding)).alias("p"), "node", "label").select("anchor", "p.part", "p.role", "node", "label")


def _crowds(met: DataFrame, nodes: DataFrame, rooted: DataFrame, docs: DataFrame, text: str, held: int = HELD) -> DataFrame:
    """Links between different components in the crowds of anchors: all pairs of an anchor's crowd count, and none leaves its task unverified."""
    members = met.where("anchor is not null").select("anchor", F.col("a").alias("node")).distinct()
    members = members.join(rooted.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").select("anchor", "node", F.coalesce("root", "node").alias("label"))
    rows = written(_dealt(written(members, "crowds"), held), "rows")
    some = rows.select("node").distinct()
    sets = _shingles(some, nodes, docs, text)
    known = nodes.select("node", "wide").join(sets, "node").select(F.col("node").alias("w"), "wide", "shingles")
    return written(_across(rows.join(known, F.col("node") == F.col("w")).select("anchor", "part", "role", "node", "label", "wide", "shingles")), "across")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = CROWD, compared: int = ALL, held: int = HELD) -> DataFrame:
    """``doc_id``, text hash ``t``, ``node``, ``root`` (a node that names the component) and ``component_id`` of every row.

    Components are of texts with at least ``PARTS`` / ``OF`` of their five-word shingles in common. Different
    components have different roots, also where ids are null or stand for several texts. The numbers set how
    crowds are told, compared and dealt; they change the work, not which links count.
    """
    texts = written(text_table(docs, key, text), "texts")
    # Texts are told apart by 16 bytes; a node is a number for each, fixed by writing it.
    distinct = texts.where("wide is not null").select("digest", "t", "wide").dropDuplicates(["digest"])
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    table = written(texts.select("doc_id", "t", "digest").join(nodes.select(F.col("digest").alias("d"), "node"), F.col("digest") == F.col("d")).select("doc_id", "t", "node"), "rows")
    met = written(_met(nodes, most, compared), "met")
    pairs = met.where("anchor is null").select("a", "b").distinct()
    linked = _verified(_likely(pairs, nodes), nodes, docs, text)
    rooted = _rooted(linked)
    more = _crowds(met, nodes, rooted, docs, text, held)
    if not more.isEmpty():
        rooted = _rooted(linked.unionAll(more))
    first = table.groupBy("node").agg(F.min("doc_id").alias("first"))
    group = written(first.join(rooted.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").select("node", "first", F.coalesce("root", "node").alias("root")), "roots")
    lowest = group.groupBy(F.col("root").alias("top")).agg(F.min("first").alias("component_id"))
    known = written(group.join(lowest, F.col("root") == F.col("top")).select(F.col("node").alias("p"), "root", "component_id"), "components")
    return table.select("doc_id", "t", "node").join(known, F.col("node") == F.col("p")).select("doc_id", "t", "node", "root", "component_id")
