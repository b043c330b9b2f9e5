"""Secret scans: fixed patterns, and strings whose compressed novelty is high in a sensitive context.

Base kinds, on bytes (their characters are all ASCII): ``assign`` (a sensitive name, ``=`` or ``:``,
and a value of 12 or more characters), ``access`` (access key ids of 18 or more) and ``hex`` (runs of
16 or more lower-case hex digits); leftmost, not overlapping within a kind.

Novelty. Candidates are runs of 12 or more token characters in the paragraph of a sensitive word, before
or after it, on any of its lines; of a run that holds such a word, what follows it if that is 16 or more. A
candidate's marginal size is what it adds to the zstandard frame of the text around it (``CONTEXT`` bytes
on either side, over line ends), compressed with a dictionary of common identifiers and of the text's own: runs
made like words that it holds twice or more; other copies of a candidate that isn't made like words are left out. A word, a path or a name that context or dictionary hold
adds a few bytes, a random string as many as it has. If it adds at least ``NOVEL_RUN`` bytes for a character it is
reported as ``novel``, unless a base span overlaps it. An unknown word is as novel as a random string of
its length: runs made like words (letters in one case or in humps, at most four digits at the end of each
part) must add ``NOVEL``, and either be the value of a sensitive word (after a colon or equals sign, on
its line or the next) or have 16 characters and begin within ``REACH`` bytes after one on its line. The body
of a PEM private key is ``novel`` line by line, whatever it adds. A value that is said or set right after a sensitive word (also ``pass``,
``auth`` or ``key``, which alone open no paragraph) or on the line below it may hold any printable signs, if it mixes digits with
letters of both cases, with letters and signs, or in turn with letters; it adds what a random string must. Of a value whose beginning a base
span holds the rest is ``novel``. No span leaves its text or its line.
Time is linear in the text, whatever its lines.

Spans are in code points, end exclusive. Defined results: null and empty texts have none; texts of any
length are scanned whole; ties in start are ordered as the kinds are listed; repeated rows are scanned
each; an empty table gives an empty table; other columns pass through only as asked for.
"""

from __future__ import annotations

import collections
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy, utf8

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_NEAR = 12, 18, 16, 16
#: Characters of a value that a base span leaves over, from which on they are a span of their own.
REST = 3
SENSITIVE = re.compile(rb"(?i)passphrase|passcode|password|passwd|pwd|credential|authorization|bearer|private[\x20_-]?key|access[\x20_-]?key|signing|secret|token|api[\x20_-]?key")
#: Candidates; what leads from a word to its value; runs made like words.
RUN = re.compile(rb"[A-Za-z0-9+/_=-]{12,}")
LEADS = re.compile(rb"""["']?[\x20\t]*[:=][\x20\t]*[|>]?[+-]?[\x20\t\r]*\n?[\x20\t]*["']?""")
_PART = rb"(?:(?:[A-Z]*+[a-z]{2,}+|As|At|By|Id|In|Is|No|Of|On|Or|To|Up)*+(?:[A-Z]{2,}+)?[0-9]{0,4}+|[A-Za-z]|[0-9]++)"
#: A value said or set on a sensitive word's line, with the signs that passwords and tokens hold; ``pass``, ``auth`` and ``key`` are sensitive here only.
SAID = re.compile(rb"""(?i)(?:passphrase|passcode|password|passwd|pwd|pass|credential|authorization|auth|bearer|key|signing|secret|token)s?(?:["']?[\x20\t]*[:=][\x20\t]*|\x20(?:is|was)\x20+|(?<=bearer)\x20+|[:=]?[\x20\t\r]*\n[\x20\t]*)["'`]?([\x21\x23-\x26\x28-\x5f\x61-\x7e]{12,})""")
TRAILING = b"\"'`,;."
#: What code, addresses and mail hold, but hardly a secret.
NO_VALUE = re.compile(rb"://|^[/.~]|^www\.|[()\[\]{}<>|\\]|^[^@]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")
MIXED = [re.compile(p) for p in (rb"[a-z]", rb"[A-Z]", rb"[0-9]")]
SIGNS = re.compile(rb"[!@#$%^&*?~]")
TURNS = re.compile(rb"[A-Za-z][0-9]|[0-9][A-Za-z]")
UUID = re.compile(rb"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
WORDLIKE = re.compile(rb"[+/_=-]*+(?:" + _PART + rb"[+/_=-]++)*+" + _PART)
BLANK = re.compile(rb"\n[\x20\t\r]*(?=\n)")
PEM = re.compile(rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Lines of a PEM body: its text with indentation and quotes, a header, or nothing.
PEM_LINE = re.compile(rb"""[\x20\t>"'#*]*([A-Za-z0-9+/=]*)[\x20\t\r\\n"',;+]*|[\x20\t]*[A-Za-z-]+:\x20.*""")
#: Bytes after a sensitive word in which a candidate made like a word may begin, and of context on either side of it.
REACH, CONTEXT = 48, 192
NOVEL = 0.75
#: As much for runs that aren't made like words: digits and one case hold 0.65 bytes a character, 32 signs 0.63.
NOVEL_RUN = 0.5
MARK = "[SECRET]"
#: Identifiers and words that code and configuration commonly hold.
IDENTIFIERS = (
    "authorization authentication configuration environment application connection description "
    "production development repository middleware controller parameters attributes properties "
    "username password passwd secret token api_key apiKey access_key private_key client_id client_secret "
    "example placeholder changeme localhost hostname database collection timestamp identifier "
    "import export return function class public static private protected default const string "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 XXXXXXXXXXXXXXXX"
)


@lru_cache(8)
def compressor(own: bytes = b"") -> zstandard.ZstdCompressor:
    """Primed with the common identifiers and a text's own."""
    primed = zstandard.ZstdCompressionDict(own + IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def marginal_bytes(candidate: bytes, before: bytes, after: bytes, own: bytes = b"") -> int:
    """What a candidate adds to the compressed size of the text around it."""
    around = before + b"\n" + after + b"\n"
    size = compressor(own).compress
    return len(size(around + candidate)) - len(size(around))


def own_identifiers(raw: bytes) -> bytes:
    """The runs made like words that a text holds twice or more, in order."""
    seen = collections.Counter(RUN.findall(raw))
    return b"".join(r + b" " for r, n in seen.items() if n > 1 and WORDLIKE.fullmatch(r))


_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def _hex_runs(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of at least LEAST_HEX lower-case hex digits."""
    flags = np.zeros(len(body) + 2, np.int8)
    flags[1:-1] = _HEX[body]
    change = np.diff(flags)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    long = end - start >= LEAST_HEX
    return start[long], end[long]


def _pem(raw: bytes, end: int, head: int) -> Iterator[tuple[int, int]]:
    """Spans of a PEM body whose header ends at ``head``, in a text that ends at ``end``."""
    at = head
    while at < end:
        stop = raw.find(b"\n", at, end)
        stop = end if stop < 0 else stop
        foot = raw.find(b"-----END", at, stop)
        if at == head or foot >= 0:  # the rest of the header's line, or a last line: up to the footer
            last = stop if foot < 0 else foot
            if at < last and RUN.search(raw, at, last):
                yield at, last
        else:
            m = PEM_LINE.fullmatch(raw, at, stop)
            if not m:
                return
            if m[1]:
                yield m.span(1)
        if foot >= 0:
            return
        at = stop + 1


def mixed(value: bytes) -> bool:
    """Whether a value is mixed as secrets are: digits with letters of both cases, with letters and signs, or in turn with letters; never made like words."""
    lower, upper, digit = (bool(p.search(value)) for p in MIXED)
    in_turn = len(value) >= LEAST_NEAR and len(TURNS.findall(value)) >= 3 and not UUID.fullmatch(value)
    return digit and (lower and upper or (lower or upper) and (in_turn or bool(SIGNS.search(value)))) and not WORDLIKE.fullmatch(value)


def find(raw: bytes, begin: Sequence[int] = (0,)) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of all spans, in bytes, of texts that begin at ``begin`` and are joined by line ends. No span holds a line end."""
    body = np.frombuffer(raw, np.uint8)
    base = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= LEAST_VALUE]
    base += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
    base += [(a, 2, b, a) for a, b in zip(*(x.tolist() for x in _hex_runs(body)), strict=True)]
    novel: dict[int, int] = {}
    words = [m.end() for m in SENSITIVE.finditer(raw)]
    heads = [m.span() for m in PEM.finditer(raw)]
    said = [(m.start(1), m.start(1) + len(m[1].rstrip(TRAILING))) for m in SAID.finditer(raw)]
    if not words and not heads and not said:
        return sorted(base)
    covered = sorted((a, b) for a, _, b, _ in base)
    starts = [a for a, _ in covered]
    furthest = np.maximum.accumulate([b for _, b in covered]) if covered else np.zeros(0, np.int64)

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b) - 1  # the last base span that begins before the end
        return i < 0 or furthest[i] <= a

    def text_of(place: int) -> tuple[int, int]:
        """The text that holds a place."""
        i = bisect_right(begin, place)
        return begin[i - 1], begin[i] - 1 if i < len(begin) else len(raw)

    for first, head in heads:
        for a, b in _pem(raw, text_of(first)[1], head):
            if free(a, b):
                novel[a] = max(b, novel.get(a, 0))
    for a, b in said:
        value = raw[a:b]
        i = bisect_right(starts, a) - 1
        covers = int(furthest[i]) if i >= 0 and furthest[i] > a else a  # a base span may hold the first part of a value
        if b - a >= LEAST_VALUE and mixed(value) and not NO_VALUE.search(value) and b - covers >= min(REST, b - a) and free(covers, b):
            low, high = text_of(a)
            before, after = raw[max(low, a - CONTEXT) : a].replace(value, b""), raw[b : min(high, b + CONTEXT)].replace(value, b"")
            if marginal_bytes(value, before, after) >= NOVEL_RUN * (b - a):
                novel[covers] = max(b, novel.get(covers, 0))
    breaks = np.flatnonzero(body == 10)
    blanks = [m.start() for m in BLANK.finditer(raw)]
    taken = sorted(novel.items())
    opens = [a for a, _ in taken]
    reached = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0, np.int64)
    done, text, own = 0, (-1, -1), b""  # the paragraphs up to here have been searched; the text at hand and its identifiers
    for k, w in enumerate(words):
        if w <= done:
            continue
        if not text[0] < w <= text[1]:
            text = text_of(w - 1)
            own = own_identifiers(raw[slice(*text)])
        i = bisect_left(blanks, w)
        first, done = max(text[0], blanks[i - 1] if i else 0), min(text[1], blanks[i] if i < len(blanks) else len(raw))
        last = bisect_right(words, done, k)
        values = {m.end() for e in words[k:last] if (m := LEADS.match(raw, e, text[1]))}
        for m in RUN.finditer(raw, first, done):
            a, b = m.span()
            j = bisect_right(words, a, k, last)  # the words that end by its start
            near = j > k and a - words[j - 1] <= REACH and np.searchsorted(breaks, words[j - 1]) == np.searchsorted(breaks, a)
            if j < last and words[j] < b and b - words[j] >= LEAST_NEAR:
                a, near = words[j], True
            like = WORDLIKE.fullmatch(raw, a, b)
            if like and not (a in values or near and b - a >= LEAST_NEAR):
                continue
            i = bisect_left(opens, b) - 1  # the last span so far that begins before its end
            if (i >= 0 and reached[i] > a) or not free(a, b):
                continue
            before, after = raw[max(text[0], a - CONTEXT) : a], raw[b : min(text[1], b + CONTEXT)]
            if not like:  # said twice, a random string is no less of a secret; a name that recurs is a name
                before, after = before.replace(raw[a:b], b""), after.replace(raw[a:b], b"")
            if marginal_bytes(raw[a:b], before, after, own) >= (NOVEL if like else NOVEL_RUN) * (b - a):
                novel[a] = b
    return sorted(base + [(a, 3, b, a) for a, b in novel.items()])


def _each(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, bytes, list[tuple[int, int, int, int]]]]:
    """Row, bytes and spans of the texts that have spans. Texts are searched joined by line ends, which no span crosses."""
    body, at = utf8(batch.column(column))
    n = len(at) - 1
    joined = np.full(len(body) + n, 10, np.uint8)
    joined[np.arange(len(body)) + np.repeat(np.arange(n), np.diff(at))] = body
    begin = at[:-1] + np.arange(n)
    spans = find(joined.tobytes(), begin.tolist() or [0])
    rows = np.searchsorted(begin, [s[0] for s in spans], "right") - 1 if spans else []
    by_row: dict[int, list] = {}
    for r, (a, k, b, v) in zip(rows, spans, strict=True):
        by_row.setdefault(int(r), []).append((a - int(begin[r]), k, b - int(begin[r]), v - int(begin[r])))
    for r, found in by_row.items():
        yield r, body[at[r] : at[r + 1]].tobytes(), found


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key with counts of the base kinds, the digest of the base spans, and all spans."""
    picked = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            n = batch.num_rows
            counts = np.zeros((3, n), np.int64)
            digest, spans = [none] * n, [""] * n
            for r, raw, found in _each(batch, "__text"):
                lead = np.zeros(len(raw) + 1, np.int64)
                np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=lead[1:])
                points = [(int(lead[a]), k, int(lead[b])) for a, k, b, _ in found]
                for _, k, _ in points:
                    if k < 3:
                        counts[k, r] += 1
                digest[r] = hashlib.sha256(_listed([p for p in points if p[1] < 3]).encode()).hexdigest()
                spans[r] = _listed(points)
            yield pa.RecordBatch.from_arrays([batch.column("__key"), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = picked.schema["__key"].dataType.simpleString()
    return picked.mapInArrow(tidy(run), f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text", mark: str = MARK) -> DataFrame:
    """``docs`` with the values of all spans replaced by ``mark``; texts without spans are untouched."""
    names = docs.columns
    place = names.index(text)
    coded = mark.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            cleaned = {}
            for r, raw, found in _each(batch, text):
                out, done = [], 0
                for a, b in sorted((v, b) for _, _, b, v in found):
                    if a >= done:
                        out += [raw[done:a], coded]
                    done = max(done, b)
                cleaned[r] = b"".join([*out, raw[done:]]).decode()
            column = batch.column(place)
            if cleaned:
                values = column.to_pylist()
                for r, v in cleaned.items():
                    values[r] = v
                column = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays([column if i == place else batch.column(i) for i in range(len(names))], names=names)

    return docs.mapInArrow(tidy(run), docs.schema)
