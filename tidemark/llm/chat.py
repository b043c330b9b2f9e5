"""Chat formatting by columnar byte assembly.

A turn becomes ``### <role>: <text></turn>\\n``. Inside roles and texts every ``\\``, ``#`` and ``<``
(in roles also ``:``) gets a backslash before it, so that no text can hold a control string, and
removing one backslash of each pair gives the text again.

Segment lengths, cumulative offsets and scatter indices are computed in numpy for a whole batch;
headers and contents are copied into one preallocated buffer that becomes an Arrow column.

Defined results: null text or role is empty; a null turn sorts first; rows that tie on the turn are
ordered by role, then text; repeated rows are turns of their own; a null ``conv_id`` is a
conversation; an empty table gives an empty table; other columns are ignored. A conversation that
spans Arrow batches comes in several parts in order, so one of any length fits in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, slices, strings, utf8

HEAD, MID, TAIL = b"### ", b": ", b"</turn>\n"
ESCAPE = ord("\\")
FORMATTED = "conv_id long, part int, n_turns long, formatted string, loss_start array<int>, loss_end array<int>"


def _needs(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


TEXT_NEEDS, ROLE_NEEDS = _needs(b"\\#<"), _needs(b"\\#<:")


def _escaped_lengths(body: np.ndarray, at: np.ndarray, needs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths after escaping, and the number of escapes before each byte (n+1 entries)."""
    before = np.zeros(len(body) + 1, np.int64)
    np.cumsum(needs[body], out=before[1:])
    return np.diff(at) + before[at[1:]] - before[at[:-1]], before


def _scatter(out: np.ndarray, base: np.ndarray, body: np.ndarray, at: np.ndarray, needs: np.ndarray, before: np.ndarray) -> None:
    """Copy each segment of ``body`` to ``base`` in ``out`` with its escapes."""
    lengths = np.diff(at)
    shift = np.repeat(base - at[:-1] - before[at[:-1]], lengths)
    dest = np.arange(len(body)) + shift + before[1:]
    out[dest] = body
    out[dest[needs[body]] - 1] = ESCAPE


def _stamp(out: np.ndarray, base: np.ndarray, what: bytes) -> None:
    out[base[:, None] + np.arange(len(what))] = np.frombuffer(what, np.uint8)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of a run of turns, turn offsets (n+1), and each content's start and end."""
    role_bytes, role_at = utf8(roles)
    text_bytes, text_at = utf8(texts)
    role_len, role_before = _escaped_lengths(role_bytes, role_at, ROLE_NEEDS)
    text_len, text_before = _escaped_lengths(text_bytes, text_at, TEXT_NEEDS)
    at = np.zeros(len(role_len) + 1, np.int64)
    np.cumsum(len(HEAD) + role_len + len(MID) + text_len + len(TAIL), out=at[1:])
    out = np.empty(at[-1], np.uint8)
    start = at[:-1]
    role_to = start + len(HEAD)
    text_to = role_to + role_len + len(MID)
    _stamp(out, start, HEAD)
    _scatter(out, role_to, role_bytes, role_at, ROLE_NEEDS, role_before)
    _stamp(out, text_to - len(MID), MID)
    _scatter(out, text_to, text_bytes, text_at, TEXT_NEEDS, text_before)
    _stamp(out, text_to + text_len, TAIL)
    return out, at, text_to, text_to + text_len


def disassemble(body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Reads formatted bytes back.

    Returns the unescaped bytes, the start and end of each role and each text in them, the start of
    each text before unescaping, and the number of kept bytes before each byte (n+1).
    """
    n = len(body)
    index = np.arange(n)
    slash = body == ESCAPE
    run = np.maximum.accumulate(np.where(slash, -1, index)) if n else index
    lead = slash & ((index - run) % 2 == 1)
    free = ~lead
    if n:
        free[1:] &= ~lead[:-1]
    kept = np.zeros(n + 1, np.int64)
    np.cumsum(~lead, out=kept[1:])
    head = np.flatnonzero(free & (body == ord("#")))[:: HEAD.count(b"#")]
    tail = np.flatnonzero(free & (body == ord("<")))
    colon = np.flatnonzero(free & (body == ord(":")))
    mid = colon[np.searchsorted(colon, head)] if len(head) else head
    text = mid + len(MID)
    return body[~lead], kept[head + len(HEAD)], kept[mid], kept[text], kept[tail], text, kept


def _format(batches: Iterator[pa.RecordBatch], loss_role: str) -> Iterator[pa.RecordBatch]:
    last, part = object(), 0
    for batch in slices(batches, "text", 8 << 20):
        conv = batch.column("conv_id")
        body, at, text_start, text_end = assemble(batch.column("role"), batch.column("text"))
        ids = conv.to_pylist()
        first = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
        ends = [*first[1:], len(ids)]
        parts = []
        for i in first:
            part = part + 1 if ids[i] == last else 0
            last = ids[i]
            parts.append(part)
        loss = np.flatnonzero([r == loss_role for r in batch.column("role").to_pylist()])
        cut = np.searchsorted(loss, [*first, len(ids)]).astype(np.int32)
        base = np.repeat(at[first], np.diff(cut))
        as_list = lambda v: pa.ListArray.from_arrays(pa.array(cut), pa.array((v[loss] - base).astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [
                conv.take(pa.array(first)),
                pa.array(parts, pa.int32()),
                pa.array([b - a for a, b in zip(first, ends, strict=True)], pa.int64()),
                strings(body, at[[*first, len(ids)]]),
                as_list(text_start),
                as_list(text_end),
            ],
            names=["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_end"],
        )


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Formatted conversations, in parts, each with its loss mask as byte spans of its text.

    One shuffle by ``conv_id``; the parts of a conversation lie in order in one partition. A
    conversation is one text, so its turns go to one task, which holds one batch of them at a time.
    """
    spark = turns.sparkSession
    dealt = (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
        .repartition(shuffle_width(spark), "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    return dealt.mapInArrow(lambda it: _format(it, loss_role), FORMATTED)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    started, conv, n_turns, turns, loss_chars, loss, chars = False, None, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
    for batch in batches:
        done: list[tuple] = []
        body_all, at = utf8(batch.column("formatted"))
        starts, ends = batch.column("loss_start").to_pylist(), batch.column("loss_end").to_pylist()
        for i, (key, part) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist(), strict=True)):
            if part == 0:
                if started:
                    done.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                started, conv, n_turns, turns, loss_chars, loss, chars = True, key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            body = body_all[at[i] : at[i + 1]]
            plain, role_a, role_b, text_a, text_b, _, kept = disassemble(body)
            raw = plain.tobytes()
            for a, b, c, d in zip(role_a.tolist(), role_b.tolist(), text_a.tolist(), text_b.tolist(), strict=True):
                turns.update(b"%b\n%b\n" % (raw[a:b], raw[c:d]))
            for a, b in zip(starts[i], ends[i], strict=True):
                said = raw[kept[a] : kept[b]]
                loss.update(said)
                loss_chars += len(said.decode())
            n_turns += len(role_a)
            chars += int(np.count_nonzero((body & 0xC0) != 0x80))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
    if started:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars), types, strict=True)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, parsed from what ``format_chats`` returned.

    Runs in the partitions of ``format_chats``, where the parts of a conversation follow each other.
    """
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
