"""Mixture-controlled packing by deficit round-robin.

Documents are tokenised once; the ids are written to the shared folder with a shard for each
document, dealt by the hash of a row number so that every shard has its part of each source and repeated
rows are spread. In a shard each source is a
queue. For every window each source's deficit grows by its share of the window; whole tokens of it
are taken from the queues, and what a queue can't give, or rounding leaves, goes to the queues with
the largest deficits. Deficits carry from window to window and, as what a shard takes is what it
holds, the deficit with which a shard begins follows from the totals of the shards before it: a
running sum over a table of (shard, source), not a pass over the shards in turn.

Documents are cut where a window ends. The last tokens of a shard fill windows whose lengths are the
powers of two of their count, so no window has padding.

Tokens: each stretch between blanks or line ends is tokenised once per worker and kept, as the
tokenizer's pattern drops white space and works within such stretches; plain words go to its model
directly. Special tokens' strings are treated as the tokenizer itself does.

Defined results: a null or empty text is the end id alone; a null source is a queue of its own;
repeated rows are documents of their own; any text length is cut as needed; an empty table gives no
pieces; other columns are ignored. Sources missing from ``mixture`` have share zero and are used up last.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import shuffle_width, slices, tidy, utf8, written

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
WINDOW = 2048
#: Tokens of a shard, about: what one task holds at a time.
SHARD_TOKENS = 4_000_000
#: Shards beyond this many share tasks, evenly.
MOST_TASKS = 20_000
#: Stretches that a worker keeps; beyond it the cache starts anew, which changes no result.
CACHED = 500_000
PLAIN_PUNCTUATION = ".,;:!?*#%&$|"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


class Stretches(dict):
    """Ids (little-endian unsigned 16-bit) of stretches of text without blanks; missing ones are tokenised."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        shown, spare = [], 256
        for b in range(256):  # the printable form that byte-level vocabularies give each byte
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
                shown.append(chr(b))
            else:
                shown.append(chr(spare))
                spare += 1
        self.shown = str.maketrans({chr(b): c for b, c in enumerate(shown)})
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of a lower-case word, or of a run of punctuation."""
        found = self.words.get(word)
        if found is None:
            found = np.array([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.shown))], "<u2").tobytes()
            self.words[word] = found
        return found

    def __missing__(self, stretch: str) -> bytes:
        core = stretch.rstrip(PLAIN_PUNCTUATION)
        if not stretch:
            ids = b""
        elif core.isalpha() and max(core) < "\u0180" and len(low := core.lower()) == len(core):  # composed letters, each with one lower-case form
            ids = self._word(low) + (self._word(stretch[len(core) :]) if len(core) < len(stretch) else b"")
        else:
            ids = np.array(self.tokenizer.encode(stretch, add_special_tokens=False).ids, "<u2").tobytes()
        self[stretch] = ids
        return ids


@lru_cache(1)
def _stretches(path: str) -> Stretches:
    return Stretches(path)


def tokenise(text: str, known: Stretches) -> bytes:
    return b"".join(map(known.__getitem__, text.replace("\n", " ").split(" ")))


def token_table(docs: DataFrame, key: str, text: str, source: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """doc_id, source, ids (binary, little-endian unsigned 16-bit, with the end id) and n_tokens."""
    picked = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _stretches(vocabulary)
        for batch in slices(batches, "text"):
            if len(known) > CACHED:
                known.clear()
                known.words.clear()
            ids = [tokenise(t or "", known) + end for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(ids, pa.binary()), pa.array([len(i) // 2 for i in ids], pa.int64())],
                names=["doc_id", "source", "ids", "n_tokens"],
            )

    return picked.mapInArrow(tidy(run), "doc_id long, source string, ids binary, n_tokens long")


def round_robin(totals: np.ndarray, share: np.ndarray, deficit: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, queue, tokens) of what each window takes, in that order; ``deficit`` is carried in and updated.

    Only queues that a window takes from are kept: no more of them than its tokens, however many queues there are.
    """
    left = totals.astype(np.int64).copy()
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    for length in lengths.tolist():
        deficit += share * length
        take = np.clip(np.floor(deficit), 0, left).astype(np.int64)
        missing = length - int(take.sum())
        if missing < 0:  # more is owed than fits: the smallest deficits wait
            order = np.argsort(deficit, kind="stable")
            spare = np.minimum(np.cumsum(take[order]), -missing)
            take[order] -= np.diff(spare, prepend=0)
        elif missing > 0:
            order = np.argsort(-deficit, kind="stable")
            room = (left - take)[order]
            owed = np.minimum(room, np.maximum(0, np.ceil(deficit - take).astype(np.int64))[order])
            extra = np.diff(np.minimum(np.cumsum(owed), missing), prepend=0)
            missing -= int(extra.sum())
            extra += np.diff(np.minimum(np.cumsum(room - extra), missing), prepend=0)
            take[order] += extra
        left -= take
        deficit -= take
        from_ = np.flatnonzero(take)
        taken.append((from_, take[from_]))
    sizes = [len(q) for q, _ in taken]
    none = [np.zeros(0, np.int64)]
    return np.repeat(np.arange(len(lengths)), sizes), np.concatenate(none + [q for q, _ in taken]), np.concatenate(none + [t for _, t in taken])


def window_lengths(tokens: int, window: int) -> np.ndarray:
    """Full windows, then the powers of two of the rest, largest first."""
    rest = tokens % window
    return np.array([window] * (tokens // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def cut_pieces(doc_tokens: np.ndarray, window: np.ndarray, queue: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents laid out queue by queue: document, its ids before the piece, length, window, offset in the window.

    Positions run over all queues, one after another; a queue's windows cut its stretch where their
    running sums end, its documents where they end.
    """
    doc_end = np.cumsum(doc_tokens)
    before = np.cumsum(taken) - taken
    in_window = before - before[np.searchsorted(window, window)]  # less what all earlier windows took
    by_queue = np.lexsort((window, queue))
    takes = taken[by_queue]
    take_end = np.cumsum(takes)
    cuts = np.union1d(doc_end, take_end)
    start = np.concatenate([[0], cuts[:-1]])
    doc = np.searchsorted(doc_end, start, "right")
    slot = np.searchsorted(take_end, start, "right")
    return doc, start - (doc_end - doc_tokens)[doc], cuts - start, window[by_queue][slot], start - (take_end - takes)[slot] + in_window[by_queue][slot]


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", window: int = WINDOW, mixture: dict[str, float] | None = None, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with the sequence and offset of each.

    ``mixture``: token shares by source; by default those of the whole table, so that all queues last
    to the end. Sequence ids are dense; a sequence holds ``window`` tokens or a smaller power of two.
    """
    if window & (window - 1):
        raise ValueError("the window is a power of two")
    spark = docs.sparkSession
    # A number for each row, so that repeated rows are dealt like others; fixed once it is written.
    tokens = written(token_table(docs, key, text, source, vocabulary, end_id).withColumn("row", F.monotonically_increasing_id()), "tokens")
    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_TOKENS), min(shuffle_width(spark), -(-total // (64 * window))))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    width = max(shuffle_width(spark), min(shards, MOST_TASKS))

    # Totals of (shard, source) and of shards; the running sums give each shard's first deficits and sequence.
    held = written(tokens.groupBy(shard.alias("shard"), "source").agg(F.sum("n_tokens").alias("tokens")), "totals")
    by_shard = held.groupBy("shard").agg(F.sum("tokens").alias("shard_tokens"))
    windows = F.floor(F.col("shard_tokens") / window) + F.bit_count(F.col("shard_tokens") % window)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    by_shard = by_shard.select("shard", "shard_tokens", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum(windows).over(before), F.lit(0)).alias("first_sequence"))
    sources = held.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    if mixture is None:
        shared = sources.select("source", (F.col("source_tokens") / F.lit(float(max(total, 1)))).alias("share"))
    else:
        whole = float(sum(mixture.values()))
        given = spark.createDataFrame([(k, v / whole) for k, v in mixture.items()], "name string, share double")
        shared = sources.join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", F.coalesce("share", F.lit(0.0)).alias("share"))
    of_source = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        held.join(by_shard, "shard")
        .join(shared.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select("shard", "source", "share", "first_sequence", (F.col("share") * F.col("tokens_before") - F.coalesce(F.sum("tokens").over(of_source), F.lit(0))).alias("deficit"))
    )
    rows = tokens.select(shard.alias("shard"), "source", "doc_id", "row", "ids", *(F.lit(None).cast(t).alias(c) for c, t in (("share", "double"), ("first_sequence", "long"), ("deficit", "double"))))
    heads = plan.select("shard", "source", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("binary").alias("ids"), "share", "first_sequence", "deficit")
    # A shard goes straight to the task of its number: hashing numbers would give some tasks several and others none.
    dealt = rows.unionByName(heads).repartitionById(width, F.col("shard") % width).sortWithinPartitions("shard", "source", F.col("ids").isNotNull(), "doc_id", "row")

    def packed(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(group).combine_chunks()
        head = whole.column("ids").is_null().to_numpy()
        share = whole.column("share").to_numpy()[head]
        deficit = whole.column("deficit").to_numpy()[head].copy()
        first = int(whole.column("first_sequence").to_numpy()[head][0])
        queue_all = np.cumsum(head) - 1
        body = whole.filter(pa.array(~head))
        queue = queue_all[~head]
        raw, at = utf8(body.column("ids"))
        ids = raw.view("<u2")
        counts = np.diff(at) // 2
        lengths = window_lengths(int(counts.sum()), window)
        taken = round_robin(np.bincount(queue, counts, len(share)).astype(np.int64), share, deficit, lengths)
        doc, start, length, slot, offset = cut_pieces(counts, *taken)
        full = ids.astype("<u4")
        begin = (at[:-1] // 2)[doc] + start
        crc = [zlib.crc32(full[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
        for i in range(0, len(doc), 50_000):
            s = slice(i, i + 50_000)
            pick = pa.array(doc[s])
            columns = [body.column("doc_id").combine_chunks().take(pick), pa.array(start[s]), pa.array(length[s]), pa.array(crc[s], pa.int64()), pa.array(counts[doc[s]]), pa.array(first + slot[s]), pa.array(offset[s]), body.column("source").combine_chunks().take(pick)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
            if with_ids:
                columns.append(pa.array([full[a : a + n].tobytes() for a, n in zip(begin[s].tolist(), length[s].tolist(), strict=True)], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            shard_ids = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard_ids)) + 1).tolist(), len(shard_ids)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held_rows and shard_ids[a] != current:
                    yield from packed(held_rows)
                    held_rows = []
                current = shard_ids[a]
                held_rows.append(batch.slice(a, b - a))
        if held_rows:
            yield from packed(held_rows)

    return dealt.mapInArrow(tidy(run), PIECES + (", ids binary" if with_ids else ""))
