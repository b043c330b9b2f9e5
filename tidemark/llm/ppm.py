"""LM scoring: prediction by partial matching over a byte-context trie, and a word unigram beside it.

A text is read as its tokens: ASCII capitals in lower case, words joined by one space, then an end mark. A symbol is a byte
or the end mark. The trie has a node for each context of up to ``ORDER`` bytes that occurs in the training texts
(texts begin with start marks, so the longest context is always full), with a count for each symbol
after it; dropping a context's first byte leads to the node one shorter. The probability of a symbol after a
context of n symbols, q of them distinct, is (2 count - 1) / 2n if it was seen there; otherwise the escape (method D), q / 2n, times the
probability one context shorter, from which all symbols of the longer context are excluded. A context without symbols
that are left is passed for free. Below the empty context, what is left of the 255 symbols is equally likely.

The trie is a table for each context length: gram (context and symbol, 8 bits each) and count; shorter ones are sums of longer
ones. The symbols of a context also occur after the shorter one, so what is to be excluded is a sum by node, made once.

Texts are cut to blocks of about ``BLOCK`` bytes, each with the grams and words that stand in it. These requests are what is shuffled: a
gram moves once a block, not once an occurrence, so no key has more rows than there are blocks. Grams are counted
over all blocks, each distinct gram is given its code length once, and blocks receive the code lengths they asked for, packed.
Then a task scores a block's texts with its own part of the trie; no task and not the driver holds the trie.

Defined results: a null or empty text is the end mark alone; a null id is held out like an id of checksum 0 (the caller's
``held`` column decides); repeated rows are scored, and learned from, each; without training texts symbols are equally likely;
an empty table gives an empty table; other columns pass through only as asked for, also if their names clash with
working columns. A text is one row of one block, however long, and is read a megabyte at a time with the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_path, shuffle_width, slices, tidy, utf8, written

ORDER = 5
BLOCK = 32 << 20
#: Answers that a task packs at once.
PACKED = 1 << 18
#: Bytes that stand in no UTF-8 text.
START, END = 0xFE, 0xFF
SYMBOLS = 255  # all bytes but START
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Tables over contexts of so many bytes have at most 65,536 rows and may be broadcast.
SHORT = 2


def token_stream(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of texts as their words in lower case, joined by one space."""
    word = ~SPACE[body]
    before = np.concatenate([[True], ~word[:-1]]) if len(body) else word
    before[at[:-1][at[:-1] < len(body)]] = True
    start = word & before
    words, letters = np.concatenate([[0], np.cumsum(start)]), np.concatenate([[0], np.cumsum(word)])
    n_words = np.diff(words[at])
    to = np.concatenate([[0], np.cumsum(np.diff(letters[at]) + np.maximum(n_words - 1, 0))])
    out = np.full(to[-1], 0x20, np.uint8)
    # A word's bytes move behind one space for each earlier word of its text.
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[word]
    out[to[row] + (letters[1:][word] - 1 - letters[at[row]]) + (words[1:][word] - 1 - words[at[row]])] = LOWER[body[word]]
    return out, to


def grams(body: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """For each symbol of each text, its context and itself as a number; a text of n bytes has n + 1."""
    n, lengths = len(at) - 1, np.diff(at)
    start = at[:-1] + (order + 1) * np.arange(n)
    padded = np.full(len(body) + (order + 1) * n, START, np.uint8)
    padded[np.arange(len(body)) + np.repeat((order + 1) * np.arange(n) + order, lengths)] = body
    padded[start + order + lengths] = END
    found = np.zeros(len(padded), np.int64)
    for i in range(order + 1):
        found[: len(padded) - order] = (found[: len(padded) - order] << 8) | padded[i : len(padded) - order + i]
    real = np.ones(len(padded), bool)
    for i in range(order):
        real[start + lengths + 1 + i] = False
    return found[real]


def words(body: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of token streams, and each one's text."""
    letter = body != 0x20
    start = letter & np.concatenate([[True], ~letter[:-1]]) if len(body) else letter
    start[at[:-1][np.diff(at) > 0]] = True
    where = np.flatnonzero(start)
    offsets = np.concatenate([np.cumsum(letter)[where] - 1, [np.count_nonzero(letter)]]).astype(np.int32)
    found = pa.BinaryArray.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body[letter]))])
    return found, np.searchsorted(at, where, "right") - 1


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


#: Entries that a block gathers before it sums them up, and rows that a task gives out at once.
GATHERED, GIVEN = 1 << 20, 1 << 15


class _Block:
    """The grams and words of the texts of a block so far, with their counts in training texts."""

    def __init__(self, order: int) -> None:
        self.order, self.size, self.trained, self.held = order, 0, 0, 0
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: list[pa.Table] = []

    def add(self, body: np.ndarray, at: np.ndarray, held: np.ndarray) -> None:
        self.size += len(body)
        self.held += int(held.sum())
        self.trained += int((~held).sum())
        all_grams, out = grams(body, at, self.order), np.repeat(held, np.diff(at) + 1)
        self.grams.append(np.unique(all_grams[~out], return_counts=True))
        asked = np.unique(all_grams[out])
        self.grams.append((asked, np.zeros(len(asked), np.int64)))
        found, row = words(body, at)
        for part, times in ((~held, 1), (held, 0)):
            counted = pc.value_counts(found.filter(pa.array(part[row])))
            self.words.append(pa.table({"word": counted.field("values"), "n": pa.array(counted.field("counts").to_numpy() * times)}))
        if sum(len(k) for k, _ in self.grams) > GATHERED + 2 * len(self.grams[0][0]):
            self._sum()

    def _sum(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip(*self.grams, strict=True))
        self.grams = [_summed(keys, counts.astype(np.int64))]
        self.words = [pa.concat_tables(self.words).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])]

    def requests(self) -> tuple[tuple[np.ndarray, np.ndarray], pa.Table]:
        """All grams with their counts, and all words, the end mark as the empty one."""
        self.words.append(pa.table({"word": pa.array([b""], pa.binary()), "n": pa.array([self.trained], pa.int64())}))
        self._sum()
        return self.grams[0], self.words[0]


def _cut(order: int, size: int):
    """Texts as token streams (kind docs), and the requests of each block (kinds grams and words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, block, schema = 0, TaskContext.get().partitionId(), _Block(order), None

        def rows(kind: str, count: int, **columns: pa.Array) -> pa.RecordBatch:
            given = {"kind": pa.array([kind] * count), "block": pa.array(np.full(count, part + 1_000_003 * number))} | columns
            return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(count, f.type) for f in schema], schema=schema)

        def asked() -> Iterator[pa.RecordBatch]:
            (keys, counts), table = block.requests()
            for i in range(0, len(keys), GIVEN):
                part_keys = keys[i : i + GIVEN]
                yield rows("grams", len(part_keys), gram=pa.array(part_keys), n=pa.array(counts[i : i + GIVEN]))
            for some in table.combine_chunks().to_batches(GIVEN):
                yield rows("words", some.num_rows, word=some.column("word"), n=some.column("n"))

        for whole in batches:
            for batch in slices([whole], "text"):
                if not batch.num_rows:
                    continue
                kinds = batch.schema.field("k").type
                schema = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("k", kinds), ("held", pa.bool_()), ("text", pa.binary()), ("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])
                body, at = token_stream(*utf8(batch.column("text")))
                block.add(body, at, batch.column("held").to_numpy(zero_copy_only=False).astype(bool))
                texts = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(body)])
                yield rows("docs", batch.num_rows, k=batch.column("k"), held=batch.column("held"), text=texts)
                if block.size >= size:
                    yield from asked()
                    number, block = number + 1, _Block(order)
        if block.held or block.trained:
            yield from asked()

    return run


def _low(gram: Column, length: int) -> Column:
    """The last ``length`` bytes of a context with its symbol."""
    return gram.bitwiseAND(F.lit((1 << 8 * (length + 1)) - 1))


def _fits(table: DataFrame, length: int) -> DataFrame:
    """Broadcast if its keys have so few bytes that it can't be large."""
    return F.broadcast(table) if length <= SHORT else table


def trie(counted: DataFrame, order: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """By context length: (gram, c) and the nodes (context, n, q, x): symbols, distinct ones, and what the shorter context has of these."""
    levels = {order: written(counted.where("c > 0").select("gram", "c"), "level")}
    for k in range(order - 1, -1, -1):
        levels[k] = written(levels[k + 1].groupBy(_low(F.col("gram"), k).alias("gram")).agg(F.sum("c").alias("c")), "level")
    nodes = []
    for k in range(order + 1):
        rows = levels[k].select("gram", "c", F.lit(0).cast("long").alias("below"))
        if k:
            shorter = levels[k - 1].select(F.col("gram").alias("tail"), F.col("c").alias("below"))
            rows = levels[k].join(_fits(shorter, k), _low(F.col("gram"), k - 1) == F.col("tail"))
        by_context = rows.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("c").alias("n"), F.count("*").alias("q"), F.sum("below").alias("x"))
        nodes.append(written(by_context, "nodes"))
    return [levels[k] for k in range(order + 1)], nodes


def code_lengths(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, value): the log10 probability of each gram's symbol after its context, from (gram, c); c is 0 for grams that were not learned."""
    levels, nodes = trie(counted, order)
    seen_as = lambda c, n: F.log10((2 * c - 1) / (2 * n))
    escapes = lambda q, n: F.log10(q / (2 * n))
    node = lambda k: nodes[k].select(F.col("context").alias("at"), "n", "q", "x")
    n, q, x, c = (F.col(name) for name in "nqxc")
    longest = counted.join(_fits(node(order), order), F.shiftright("gram", 8) == F.col("at"), "left")
    seen = longest.where("c > 0").select("gram", seen_as(c, n).alias("value"))
    zero = F.lit(0).cast("long")
    # Grams that were not learned escape, context by context: value so far, excluded symbols and their count, whether done.
    rows = longest.where("c = 0").select("gram", F.coalesce(escapes(q, n), F.lit(0.0)).alias("value"), F.coalesce(x, zero).alias("gone"), F.coalesce(q, zero).alias("gone_q"), F.lit(False).alias("done"))
    for k in range(order - 1, -1, -1):
        own = levels[k].select(F.col("gram").alias("own"), "c")
        rows = rows.join(_fits(own, k + 1), _low(F.col("gram"), k) == F.col("own"), "left").join(_fits(node(k), k), F.shiftright(_low(F.col("gram"), k), 8) == F.col("at"), "left")
        left_n, left_q = n - F.col("gone"), q - F.col("gone_q")
        step = F.when(F.col("done") | n.isNull() | (left_q == 0), 0.0).when(c.isNotNull(), seen_as(c, left_n)).otherwise(escapes(left_q, left_n))
        rows = rows.select("gram", (F.col("value") + step).alias("value"), F.coalesce(x, zero).alias("gone"), F.coalesce(q, zero).alias("gone_q"), (F.col("done") | c.isNotNull()).alias("done"))
    rest = F.when(F.col("done"), 0.0).otherwise(-F.log10(F.lit(float(SYMBOLS)) - F.col("gone_q")))
    return seen.unionAll(rows.select("gram", (F.col("value") + rest).alias("value")))


def _planes(numbers: np.ndarray) -> bytes:
    """8-byte numbers, all first bytes first, then all second ones: neighbours are alike."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(kind).ravel()


def pack(keys: np.ndarray | list[bytes], values: np.ndarray) -> bytes:
    """Keys, grams or words, with their values (code lengths, counts), compressed; in any order of keys."""
    if isinstance(keys, list):
        head, body = _planes(values), b" ".join(keys)
    else:
        order = np.argsort(keys)
        head, body = _planes(values[order]), _planes(np.diff(keys[order], prepend=0))
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(values)).tobytes() + head + body)


def unpack(packed: bytes, of_words: bool) -> tuple[np.ndarray | list[bytes], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    head, body = raw[8 : 8 + 8 * n], raw[8 + 8 * n :]
    return (body.split(b" "), _numbers(head, np.int64)) if of_words else (np.cumsum(_numbers(body, np.int64)), _numbers(head, np.float64))


def _packs(part: int):
    """(block, key, value) as packs, a few for each block and task."""

    def packs(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(tables)
        blocks = table["block"].to_numpy()
        order = np.argsort(blocks, kind="stable")
        keys = table["key"].take(pa.array(order)).to_pylist() if part else table["key"].to_numpy()[order]
        values, blocks = table["value"].to_numpy()[order], blocks[order]
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        found = [pack(keys[a:b], values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(blocks[cuts[:-1]]), pa.array(np.full(len(found), part, np.int32)), pa.array(found, pa.binary())], names=["block", "part", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= PACKED:
                yield packs(waiting)
                waiting, n = [], 0
        if n:
            yield packs(waiting)

    return run


class _Known:
    """A block's code lengths and word counts."""

    def __init__(self) -> None:
        self.packs: tuple[list[bytes], list[bytes]] = ([], [])

    def ready(self, total: int, distinct: int) -> None:
        keys, values = (np.concatenate(x) for x in zip(*(unpack(p, False) for p in self.packs[0]), strict=True))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        found = [unpack(p, True) for p in self.packs[1]]
        self.words, counts = pa.array([w for ws, _ in found for w in ws], pa.binary()), np.concatenate([c for _, c in found])
        self.known, self.word_values = counts > 0, np.log10((counts + 0.1) / (total + 0.1 * (distinct + 1)))
        self.end = pc.index(self.words, pa.scalar(b"", pa.binary())).as_py()
        self.packs = ([], [])


def _scored(order: int, total: int, distinct: int):
    names = ["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known, filled = None, _Known(), False
        for batch in batches:
            blocks, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "part"))
            cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if blocks[a] != block:
                    block, known, filled = blocks[a], _Known(), False
                if parts[a] < 2:
                    known.packs[int(parts[a])].extend(batch.column("packed").slice(a, b - a).to_pylist())
                    continue
                if not filled:
                    known.ready(total, distinct)
                    filled = True
                for docs in slices([batch.slice(a, b - a)], "text"):
                    n = docs.num_rows
                    body, at = utf8(docs.column("text"))
                    values = known.values[np.searchsorted(known.keys, grams(body, at, order))]
                    score = np.add.reduceat(values, at[:-1] + np.arange(n))
                    found, row = words(body, at)
                    which = pc.index_in(found, value_set=known.words).to_numpy(zero_copy_only=False)
                    per_row = lambda v: np.bincount(row, weights=v, minlength=n)  # noqa: B023, E731
                    base = per_row(known.word_values[which]) + known.word_values[known.end]
                    n_known = per_row(known.known[which]).astype(np.int64) + int(known.known[known.end])
                    tokens = np.bincount(row, minlength=n).astype(np.int64) + 1
                    yield pa.RecordBatch.from_arrays([docs.column("k"), docs.column("held"), pa.array(tokens), pa.array(n_known), pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(score)], names=names)

    return run


def score(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """``keep`` (by default the key), held_out, n_tokens, n_known, train_tokens, base_score and score of each document; ``held`` says which are not learned from."""
    spark, keep = docs.sparkSession, keep or [key]
    rows = docs.select(F.struct(*keep).alias("k"), F.coalesce(held, F.lit(True)).alias("held"), F.col(text).alias("text"))
    k = rows.schema["k"].dataType.simpleString()
    schema = f"kind string, block long, k {k}, held boolean, text binary, gram long, word binary, n long"
    path = shared_path(spark, "blocks")
    rows.mapInArrow(tidy(_cut(order, block)), schema).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    asked_grams, asked_words, texts = (table.where(F.col("kind") == kind) for kind in ("grams", "words", "docs"))

    counted = written(asked_grams.groupBy("gram").agg(F.sum("n").alias("c")), "grams")
    lengths = code_lengths(counted, order)
    counts = written(asked_words.groupBy("word").agg(F.sum("n").alias("c")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    answers = [
        asked_grams.select("block", "gram").join(lengths, "gram").select("block", F.col("gram").alias("key"), "value"),
        asked_words.select("block", "word").join(counts, "word").select("block", F.col("word").alias("key"), F.col("c").alias("value")),
    ]
    packs = [rows.mapInArrow(tidy(_packs(part)), "block long, part int, packed binary") for part, rows in enumerate(answers)]
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    asked = packs[0].unionAll(packs[1]).select("*", none(k, "k"), none("boolean", "held"), none("binary", "text"))
    whole = asked.unionAll(texts.select("block", F.lit(2).alias("part"), none("binary", "packed"), "k", "held", "text"))
    width = shuffle_width(spark)
    dealt = whole.repartitionById(width, (F.col("block") % width).cast("int")).sortWithinPartitions("block", "part")
    found = dealt.mapInArrow(tidy(_scored(order, total, distinct)), f"k {k}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return found.select("k.*", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
