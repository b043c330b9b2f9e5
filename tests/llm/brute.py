"""Plain Python forms of the operators, to hold them against."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def simhash(text: str | None) -> int:
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int], threshold: int = 2) -> list[int]:
    """The smallest index of each index's component."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def similar(texts: list[str | None]) -> list[int]:
    """The smallest index of each index's component, by five-word shingles in common: four fifths or more."""
    words = [[bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def grams(text: str | None, buckets: int) -> list[int]:
    """Buckets of all words, then of all neighbouring words, as Spark's chained hashes of strings and longs give them."""
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(hashes, hashes[1:], strict=False)]
    return [h % buckets for h in hashes + pairs]


def half(doc_id: int) -> int:
    """0 for ids whose labels are counted, 1 for those that set the threshold."""
    return xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42) & 1


def quality_scores(texts: dict[int, str | None], counted: set[int], buckets: int, prior: float) -> dict[int, float]:
    each = {d: grams(t, buckets) for d, t in texts.items()}
    raw, target = collections.Counter(), collections.Counter()
    for d, g in each.items():
        raw.update(g)
        if d in counted:
            target.update(g)
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def ratio(b: int) -> float:
        corpus = (raw[b] + 1) / (n_raw + buckets)
        return math.log((target[b] + prior * corpus) / (n_target + prior) / corpus)

    return {d: sum(map(ratio, g)) / len(g) if g and n_target else 0.0 for d, g in each.items()}


def quality_kept(texts: dict[int, str | None], good: set[int], buckets: int, prior: float, lost: float) -> tuple[dict[int, float], set[int], set[int]]:
    """Scores, ids that fail the base, and ids kept."""
    score = quality_scores(texts, {d for d in good if half(d) == 0}, buckets, prior)
    failed = {d for d, t in texts.items() if (c := base_counts(t))[0] < 50 or 100 * c[4] > 50 * c[0]}
    held = sorted(score[d] for d in good if d in texts and d not in failed and half(d) == 1)
    place = lost * (len(held) - 1)
    low = int(place)
    least = held[low] + (place - low) * (held[min(low + 1, len(held) - 1)] - held[low]) if held else -math.inf
    return score, failed, {d for d in texts if d not in failed and score[d] >= least - 1e-12}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def novel_spans(text: str) -> set[tuple[int, int]]:
    """Novel spans by definition, in bytes, of a text without PEM bodies: every run of every paragraph, each measured anew."""
    import zstandard

    from tidemark.llm import secrets as s

    raw = text.encode()
    own = b"".join(r + b" " for r, n in collections.Counter(s.RUN.findall(raw)).items() if n > 1 and s.WORDLIKE.fullmatch(r))

    def size(x: bytes) -> int:
        primed = zstandard.ZstdCompressionDict(own + s.IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress(x))

    base = [(len(text[:a].encode()), len(text[:b].encode())) for a, _, b in base_spans(text)]
    found, at = set(), 0
    for paragraph in re.split(rb"\n[\x20\t\r]*(?=\n)", raw):
        begin = raw.index(paragraph, at)
        at = begin + len(paragraph)
        words = [begin + m.end() for m in s.SENSITIVE.finditer(paragraph)]
        values = {m.end() for w in words if (m := s.LEADS.match(raw, w))}
        for m in s.RUN.finditer(paragraph) if words else ():
            a, b = begin + m.start(), begin + m.end()
            near = any(0 <= a - w <= 48 and b"\n" not in raw[w:a] for w in words)
            inside = [w for w in words if a < w < b]
            if inside and b - inside[0] >= 16:
                a, near = inside[0], True
            candidate, before, after = raw[a:b], raw[max(0, a - 192) : a], raw[b : b + 192]
            like = s.WORDLIKE.fullmatch(candidate)
            if (like and not (a in values or near and b - a >= 16)) or any(x < b and a < y for x, y in base):
                continue
            if not like:
                before, after = before.replace(candidate, b""), after.replace(candidate, b"")
            around = before + b"\n" + after + b"\n"
            if size(around + candidate) - size(around) >= (0.75 if like else 0.5) * (b - a):
                found.add((a, b))
    return found


def spans_digest(spans: list[tuple[int, int, int]]) -> str:
    kinds = ("assign", "access", "hex")
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def lines_removed(rows: list[tuple], min_sites: int, min_words: int) -> list[str | None]:
    """Cleaned texts of rows (id, text, site)."""
    white = " \t\n\x0b\x0c\r"
    sites = collections.defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            sites[line.strip(white)].add(site)
    shared = {x for x, s in sites.items() if len(s) >= min_sites and len(WORD.findall(x)) >= min_words}
    out = []
    for _, text, _ in rows:
        left = "\n".join(x for x in (text or "").split("\n") if x.strip(white) not in shared)
        out.append(left if WORD.search(left) else text)
    return out


def fingerprint_filters(text: str | None) -> list[tuple[int, set[int]]]:
    """The chain of filters of a text, each as its number of features and its set bits, by definition and byte by byte."""
    raw = (text or "").encode()
    mask = (1 << 64) - 1

    def rank(window: bytes) -> int | None:
        counts = collections.Counter(window)
        used = sum(round(c * math.log2(c) * (1 << 20)) for c in counts.values()) / (32 * float(1 << 20))
        level = round((5 - used) / 5 * 1000)  # thousandths of the greatest entropy
        return None if level < 120 else 1000 - abs(level - 710)

    def mix(h: int) -> int:
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & mask
        return h ^ (h >> 31)

    def bits(feature: bytes) -> set[int]:
        h, padded = len(feature), feature.ljust(32, b"\0")
        for i in range(0, 32, 8):
            h = mix(((h + 0x9E3779B97F4A7C15) & mask) ^ int.from_bytes(padded[i : i + 8], "little"))
        return {h >> 11 * i & 2047 for i in range(5)}

    ranks = [rank(raw[i : i + 32]) for i in range(len(raw) - 31)]
    order = lambda i: (ranks[i] is None, ranks[i] or 0, i)
    votes = collections.Counter(min(range(i, i + 32), key=order) for i in range(len(ranks) - 31))
    chosen = {i for i, v in votes.items() if v >= 8 and ranks[i] is not None}
    if ranks:
        chosen.add(min(range(len(ranks)), key=order))
    features = [raw[i : i + 32] for i in sorted(chosen)] if ranks else [raw] if raw else []
    return [(len(part), set().union(*map(bits, part))) for part in (features[i : i + 160] for i in range(0, len(features), 160))]


def likeness(a: list[tuple[int, set[int]]], b: list[tuple[int, set[int]]]) -> float:
    """Each filter of the shorter chain with its best partner: bits in common beyond chance, of the most there could be."""
    if not a or not b:
        return float(len(a) == len(b))
    if (len(a), sum(n for n, _ in a)) > (len(b), sum(n for n, _ in b)) and (len(a) > len(b) or len(a) == len(b)):
        a, b = b, a
    if [f for _, f in a] == [f for _, f in b]:
        return 1.0
    total = 0.0
    for n, f in a:
        best = 0.0
        for _, g in b:
            chance = len(f) * len(g) / 2048
            best = max(best, (len(f & g) - chance) / max(min(len(f), len(g)) - chance, 1))
        total += n * min(1.0, best)
    return total / sum(n for n, _ in a)


def ppm_scores(docs, order):
    """Of {id: text}: (held_out, n_tokens, n_known, train_tokens, base, log10 probability by PPM) by the definitions, a symbol at a time."""
    import collections
    import math
    import re
    import zlib

    tokens = {d: re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))) for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in docs}
    counts = collections.Counter(w for d, ws in tokens.items() if not held[d] for w in [*ws, None])
    total, distinct = sum(counts.values()), len(counts)
    after = collections.defaultdict(collections.Counter)

    def symbols(d):
        text = [*b" ".join(tokens[d]), "end"]
        padded = ["start"] * order + text
        return [(tuple(padded[i : i + order]), s) for i, s in enumerate(text)]

    for d in docs:
        if not held[d]:
            for context, s in symbols(d):
                for k in range(order + 1):
                    after[context[order - k :]][s] += 1

    def probability(context, s):
        p, gone = 1.0, set()
        for k in range(order, -1, -1):
            seen = {x: n for x, n in after[context[order - k :]].items() if x not in gone} if context[order - k :] in after else {}
            if not seen:
                continue
            whole = 2 * sum(seen.values())
            if s in seen:
                return math.log10(p) + math.log10((2 * seen[s] - 1) / whole)
            p *= len(seen) / whole
            gone |= set(seen)
        return math.log10(p) - math.log10(255 - len(gone))

    out = {}
    for d, ws in tokens.items():
        every = [*ws, None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in every)
        out[d] = (held[d], len(every), sum(counts[w] > 0 for w in every), total, base, sum(probability(c, s) for c, s in symbols(d)))
    return out
