"""Byte-level BPE without regex: class arrays, a scan of transition functions, cached pair merging.

Pre-tokenisation. Every code point gets a class from a table (letter, number, space, other), refined
by at most two code points of lookahead: a white-space character knows whether white space or the end
follows, an apostrophe whether a contraction suffix does. Each class is a function from scanner state
to scanner state. The functions that arise by composition form a small finite monoid; it is
enumerated once, with its composition table, so that all states come from a blocked associative scan
of small integers: a prefix in each block, a prefix over the blocks' totals, then one more
composition. The first code point of a document has a constant function, so many documents are
scanned at once. A (state, class) table says where a piece begins.

Merging. Each distinct piece is merged once per worker and kept. Those not yet seen are merged
together, a row each, lowest rank first, by numpy; pieces over ``WIDE`` bytes by a heap. Looking
pieces up and gathering their ids are array operations too; only long pieces become Python objects.

Defined results: null and empty texts have no tokens and decode to empty bytes; texts of any length
are encoded whole; repeated rows and other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WIDE = 64
#: Bytes of a piece that two words hold, with its length.
SHORT_PIECE = 15
LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Pieces that a worker keeps; beyond it the cache starts anew, which changes no result.
CACHED = 300_000
NO_RANK = np.int32(1 << 30)

LETTER, NUMBER, SPACE, OTHER = range(4)
# Refined classes: white space with more of it (or the end) behind it, a last blank, another last
# white space, an apostrophe before a suffix of one or of two letters. FIRST is added at a start.
INNER, LAST_BLANK, LAST_SPACE, SHORT, LONG, FIRST = 4, 5, 6, 7, 8, 9
# States: a piece must begin; inside letters, numbers, others; a blank that joins what follows;
# white space; one or two letters of a contraction are still to come.
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, BLANK, IN_SPACE, ONE_LEFT, TWO_LEFT = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins at this code point."""
    if kind >= FIRST:
        state, kind = FRESH, kind - FIRST
    if kind == LETTER:
        if state == TWO_LEFT:
            return ONE_LEFT, False
        if state == ONE_LEFT:
            return FRESH, False
        return IN_LETTER, state not in (IN_LETTER, BLANK)
    if kind == NUMBER:
        return IN_NUMBER, state not in (IN_NUMBER, BLANK)
    if kind in (SHORT, LONG) and state not in (IN_OTHER, BLANK):
        return (ONE_LEFT if kind == SHORT else TWO_LEFT), True
    if kind in (OTHER, SHORT, LONG):
        return IN_OTHER, state not in (IN_OTHER, BLANK)
    if kind == INNER:
        return IN_SPACE, state != IN_SPACE
    return (BLANK if kind == LAST_BLANK else FRESH), True


@lru_cache(1)
def scanner() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each class its monoid element; the composition table; each element's state from FRESH; begins[state, class]."""
    kinds = [k for k in range(2 * FIRST) if k % FIRST != SPACE]
    moves = {k: tuple(_step(s, k)[0] for s in range(8)) for k in kinds}
    known = {f: i for i, f in enumerate(dict.fromkeys(moves.values()))}
    queue = list(known)
    while queue:
        f = queue.pop()
        for g in moves.values():
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    table = np.array(list(known), np.int64)
    code = (table * 8 ** np.arange(8)).sum(1)
    order = np.argsort(code)
    both = table[np.arange(len(known))[None, :, None], table[:, None, :]]  # first row's function, then column's
    compose = order[np.searchsorted(code[order], (both * 8 ** np.arange(8)).sum(2))]
    element = np.zeros(2 * FIRST, np.int16)
    begins = np.zeros((8, 2 * FIRST), bool)
    for k in kinds:
        element[k] = known[moves[k]]
        begins[:, k] = [_step(s, k)[1] for s in range(8)]
    return element, compose.astype(np.int16), table[:, FRESH].astype(np.int8), begins


@lru_cache(1)
def class_table() -> np.ndarray:
    """Every code point's class, as the tokenizer library itself sees ``\\p{L}``, ``\\p{N}`` and ``\\s``."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    table = np.full(0x110000, OTHER, np.int8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        table[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    return table


def classes(points: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The refined class of each code point; ``starts``: where the (non-empty) documents begin."""
    kind = table[points]
    n = len(points)
    last = np.zeros(n + 2, bool)
    last[starts] = True
    last[n] = True
    after1 = np.append(points[1:], [0]) * ~last[1 : n + 1]
    space = kind == SPACE
    more = np.append(space[1:], True) | last[1 : n + 1]
    kind = np.where(space, np.where(more, INNER, np.where(points == 32, LAST_BLANK, LAST_SPACE)), kind)
    quote = np.flatnonzero(points == 39)
    if len(quote):
        one = after1[quote]
        two = np.where(one != 0, np.append(after1, [0])[np.minimum(quote + 1, n)], 0)
        pair = one.astype(np.int64) << 21 | two
        kind[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        kind[quote[np.isin(pair, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])]] = LONG
    kind[starts] += FIRST
    return kind


def scan(elements: np.ndarray, compose: np.ndarray, block: int = 256) -> np.ndarray:
    """Inclusive prefix compositions of a run of monoid elements, block by block."""
    n = len(elements)
    if n <= block:
        out = elements.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], out[i]]
        return out
    rows = -(-n // block)
    grid = np.empty(rows * block, elements.dtype)
    grid[:n] = elements
    grid[n:] = elements[-1]
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    for i in range(1, block):
        grid[i] = compose[grid[i - 1], grid[i]]
    carry = scan(grid[-1].copy(), compose, block)
    grid[:, 1:] = compose[carry[:-1][None, :], grid[:, 1:]]
    return grid.T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The index of the first code point of every piece."""
    if not len(points):
        return np.zeros(0, np.int64)
    element, compose, state_of, begins = scanner()
    kind = classes(points, starts, table)
    state = state_of[scan(element[kind], compose)]
    before = np.empty_like(state)
    before[0] = FRESH
    before[1:] = state[:-1]
    return np.flatnonzero(begins[before, kind])


class HashTable:
    """Open addressing over two unsigned 64-bit words, looked up and filled by whole arrays."""

    def __init__(self, size: int):
        self.size = 1 << max(4, (size - 1).bit_length())
        self.first = np.zeros(self.size, np.uint64)
        self.second = np.zeros(self.size, np.uint64)
        self.value = np.full(self.size, -1, np.int32)

    def _slot(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mixed = (first ^ (second * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - self.size.bit_length() + 1)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The value kept for each key, -1 where there is none."""
        slot = self._slot(first, second)
        value = self.value[slot]
        todo = np.flatnonzero((value >= 0) & ((self.first[slot] != first) | (self.second[slot] != second)))
        while len(todo):
            at = (slot[todo] + 1) & (self.size - 1)
            slot[todo] = at
            value[todo] = self.value[at]
            todo = todo[(value[todo] >= 0) & ((self.first[at] != first[todo]) | (self.second[at] != second[todo]))]
        return value

    def add(self, first: np.ndarray, second: np.ndarray, value: np.ndarray) -> None:
        """Keys that differ from each other and from those kept."""
        slot, todo = self._slot(first, second), np.arange(len(first))
        while len(todo):
            free = todo[self.value[slot[todo]] < 0]
            self.value[slot[free]] = value[free]  # of several for one place, one stays
            won = free[self.value[slot[free]] == value[free]]
            self.first[slot[won]], self.second[slot[won]] = first[won], second[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (self.size - 1)


class Merger:
    """Ranks of a vocabulary file, with the pieces merged so far.

    Pieces of up to SHORT_PIECE bytes are keyed by two words, the last byte holding the length;
    longer ones by their bytes. Each has an entry, whose ids lie in one growing array.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.first = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        key = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        self.pairs = HashTable(4 * len(rank))
        self.pairs.add(key, np.zeros_like(key), np.arange(len(key), dtype=np.int32))
        self.pairs.value[self.pairs.value >= 0] = np.array(rank, np.int32)[self.pairs.value[self.pairs.value >= 0]]
        self.forget()

    def forget(self) -> None:
        self.short = HashTable(1 << 16)
        self.long: dict[bytes, int] = {}
        self.entries = 0
        self.start = np.zeros(1 << 15, np.int64)  # entry i's ids: start[i] to start[i + 1]
        self.ids = np.zeros(1 << 17, np.int32)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each adjacent pair, NO_RANK if it doesn't merge; -1 stands for no token."""
        key = a.astype(np.uint64) << np.uint64(32) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        out = self.pairs.find(key, np.zeros_like(key))
        out[(out < 0) | (a < 0) | (b < 0)] = NO_RANK
        return out

    def merge_rows(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces given as rows of bytes, one after another, and their counts.

        A row each, between two columns that hold no token; merged tokens are linked past, so that a
        round touches a few cells of each row beside the search for its lowest rank.
        """
        m, width = raw.shape
        wide = width + 2
        grid = np.full((m, wide), -1, np.int32)
        grid[:, 1:-1] = np.where(np.arange(width) < lengths[:, None], self.first[raw], -1)
        ids = grid.ravel()
        rank = np.full(m * wide, NO_RANK, np.int32)
        rank[:-1] = self.pair(ids[:-1], ids[1:])
        ranks = rank.reshape(m, wide)
        after = np.arange(1, m * wide + 1, dtype=np.int32)
        before = np.arange(-1, m * wide - 1, dtype=np.int32)
        live = np.arange(m)
        while len(live):
            i = live * wide + ranks[live].argmin(1)
            best = rank[i]
            going = best < NO_RANK
            if not going.all():
                live, i, best = live[going], i[going], best[going]
            gone = after[i]
            then = after[gone]
            ids[i] = best
            ids[gone] = -1
            rank[gone] = NO_RANK
            after[i] = then
            before[then] = i
            prior = before[i]
            both = self.pair(np.concatenate([ids[i], ids[prior]]), np.concatenate([ids[then], ids[i]]))
            rank[i] = both[: len(i)]
            rank[prior] = both[len(i) :]
        kept = grid >= 0
        return grid[kept], kept.sum(1)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same by a heap over a linked list, for a piece of any length."""
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        size = [1] * n
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := self.ranks.get(piece[i : j + size[j]])) is not None:
                heapq.heappush(heap, (r, i, j + size[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            r, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or j + size[j] != end:
                continue
            ids[i], alive[j] = r, False
            size[i] += size[j]
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([ids[i] for i in range(n) if alive[i]], np.int32)

    def _keep(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """New entries for pieces with these ids; their numbers."""
        n, m = self.entries, len(counts)
        while n + m + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        end = self.start[n]
        while end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[end : end + len(ids)] = ids
        self.start[n + 1 : n + m + 1] = end + np.cumsum(counts)
        self.entries += m
        return np.arange(n, n + m, dtype=np.int32)

    def look_up(self, body: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The entry of each piece of ``body``; pieces not yet known are merged, those of a like length together."""
        if self.entries > CACHED:
            self.forget()
        length = np.diff(begin, append=len(body))
        padded = np.concatenate([body, np.zeros(SHORT_PIECE + 1, np.uint8)])
        word = np.ndarray((len(body) + 8,), "<u8", padded.data, 0, (1,))
        first = word[begin] & LOW_BYTES[np.minimum(length, 8)]
        second = word[begin + np.minimum(8, length)] & LOW_BYTES[np.clip(length - 8, 0, 8)] | length.astype(np.uint64) << np.uint64(56)
        entry = self.short.find(first, second)
        far = np.flatnonzero(length > SHORT_PIECE)
        entry[far] = 0
        new = np.flatnonzero(entry < 0)
        if len(new):
            key = np.unique(np.stack([first[new], second[new]], 1), axis=0)
            size = (key[:, 1] >> np.uint64(56)).astype(np.int64)
            if 2 * (self.entries + len(key)) > self.short.size:
                old = np.flatnonzero(self.short.value >= 0)
                grown = HashTable(4 * (self.entries + len(key)))
                grown.add(self.short.first[old], self.short.second[old], self.short.value[old])
                self.short = grown
            raw = key.astype("<u8").view(np.uint8).reshape(len(key), 16)
            for low, high in ((0, 8), (8, SHORT_PIECE)):
                rows = np.flatnonzero((size > low) & (size <= high))
                for i in range(0, len(rows), 20_000):
                    some = rows[i : i + 20_000]
                    self.short.add(key[some, 0], key[some, 1], self._keep(*self.merge_rows(raw[some, :high], size[some])))
            entry[new] = self.short.find(first[new], second[new])
        if len(far):
            whole = body.tobytes()
            pieces = [whole[a:b] for a, b in zip(begin[far].tolist(), (begin[far] + length[far]).tolist(), strict=True)]
            self._learn({p for p in pieces if p not in self.long})
            entry[far] = list(map(self.long.__getitem__, pieces))
        return entry

    def _learn(self, pieces: set[bytes]) -> None:
        by_width: dict[int, list[bytes]] = {}
        for p in pieces:
            by_width.setdefault((len(p) - 1).bit_length(), []).append(p)
        for width, group in by_width.items():
            if 1 << width > WIDE:
                for p in group:
                    ids = self.merge_long(p)
                    self.long[p] = int(self._keep(ids, np.array([len(ids)]))[0])
                continue
            for i in range(0, len(group), 20_000):
                some = group[i : i + 20_000]
                raw = np.frombuffer(b"".join([p.ljust(1 << width, b"\0") for p in some]), np.uint8).reshape(len(some), 1 << width)
                self.long.update(zip(some, self._keep(*self.merge_rows(raw, np.array([len(p) for p in some]))).tolist(), strict=True))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(2)
def _merger(path: str) -> Merger:
    return Merger(read_ranks(path))


def _repeat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def encode_batch(body: np.ndarray, at: np.ndarray, table: np.ndarray, merger: Merger) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a run of documents, and the id offsets of the documents (n+1)."""
    if not len(body):
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    leads = np.flatnonzero((body & 0xC0) != 0x80)
    points = np.frombuffer(body.tobytes().decode().encode("utf-32-le"), np.uint32)
    full = at[:-1][np.diff(at) > 0]
    begin = leads[piece_starts(points, np.searchsorted(leads, full), table)]
    entry = merger.look_up(body, begin)
    start = merger.start[entry]
    counts = merger.start[entry + 1] - start
    sizes = np.zeros(len(entry) + 1, np.int64)
    np.cumsum(counts, out=sizes[1:])
    return merger.ids[_repeat_ranges(start, counts)], sizes[np.searchsorted(begin, at)]


@lru_cache(2)
def _tokens(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens by id, and their offsets."""
    ordered = sorted((r, t) for t, r in read_ranks(path).items())
    at = np.zeros(ordered[-1][0] + 2, np.int64)
    for r, t in ordered:
        at[r + 1] = len(t)
    return np.frombuffer(b"".join(t for _, t in ordered), np.uint8), np.cumsum(at)


def encode(docs: DataFrame, keys: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keys`` with ``ids`` and ``offsets`` (the byte at which each token begins, then the text's length)."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(class_table())
    picked = docs.select(*keys, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, (_, token_at) = _merger(vocabulary), _tokens(vocabulary)
        for batch in slices(batches, "__text", 1 << 20):
            body, at = utf8(batch.column("__text"))
            ids, doc_at = encode_batch(body, at, table.value, merger)
            lengths = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(np.diff(token_at)[ids], out=lengths[1:])
            n = len(doc_at) - 1
            counts = np.diff(doc_at)
            offset_at = doc_at + np.arange(n + 1)
            index = _repeat_ranges(doc_at[:-1], counts + 1)
            offsets = lengths[index] - np.repeat(lengths[doc_at[:-1]], counts + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in keys),
                    pa.ListArray.from_arrays(pa.array(doc_at.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(offset_at.astype(np.int32)), pa.array(offsets.astype(np.int32))),
                ],
                names=[*keys, "ids", "offsets"],
            )

    schema = ", ".join(f"`{k}` {picked.schema[k].dataType.simpleString()}" for k in keys)
    return picked.mapInArrow(run, f"{schema}, ids array<int>, offsets array<int>")


def decode_batch(ids: np.ndarray, id_at: np.ndarray, offsets: np.ndarray, vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a run of documents, each token copied to the offset kept for it, and the documents' offsets."""
    body, token_at = _tokens(vocabulary)
    ends = offsets[id_at[1:] + np.arange(len(id_at) - 1)]
    at = np.zeros(len(id_at), np.int64)
    np.cumsum(ends, out=at[1:])
    own = np.ones(len(offsets), bool)
    own[id_at[1:] + np.arange(len(id_at) - 1)] = False
    to = offsets[own] + np.repeat(at[:-1], np.diff(id_at))
    lengths = np.diff(token_at)[ids]
    out = np.empty(at[-1], np.uint8)
    out[_repeat_ranges(to, lengths)] = body[_repeat_ranges(token_at[ids], lengths)]
    return out, at


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def _token_runs(batches: Iterator[pa.RecordBatch], limit: int = 400_000) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about ``limit`` ids (one row at least)."""
    for batch in batches:
        at = batch.column("ids").offsets.to_numpy()
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def digests(encoded: DataFrame, keys: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keys`` with n_tokens, ids_sha256 and decoded_sha256, the last from decoding the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _token_runs(batches):
            ids, id_at = _lists(batch.column("ids"))
            offsets, _ = _lists(batch.column("offsets"))
            plain, at = decode_batch(ids, id_at, offsets.astype(np.int64), vocabulary)
            coded = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in keys),
                    pa.array(np.diff(id_at)),
                    pa.array([hashlib.sha256(coded[a:b]).hexdigest() for a, b in zip(id_at, id_at[1:], strict=False)], pa.string()),
                    pa.array([hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string()),
                ],
                names=[*keys, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = ", ".join(f"`{k}` {encoded.schema[k].dataType.simpleString()}" for k in keys)
    return encoded.mapInArrow(run, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string")
