"""Kernels against plain forms, and what odd rows give."""

import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import bpe, chat, common, fingerprint, lines, packing, quality, secrets, simhash, urls, warc

LETTERS = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", " ", "a", "Z", "é", "É", "1", "٣", "!", "=", "'''", "m", "　", "漢", "🙂", "́", "ß", "İ", "Σ", "<|endoftext|>", "\x1c", "\x85", " ", "x" * 70, "=" * 100, "The"]


def random_texts(n, seed, letters=LETTERS, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_bpe_on_random_text():
    texts = random_texts(3000, 1)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})
    ids, at = bpe.encode_batch(*common.utf8(pa.array(texts, pa.string())), bpe.class_table(), bpe.Merger(bpe.read_ranks(bpe.VOCABULARY)))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t)


def test_scan_is_a_prefix_composition():
    element, compose, _, _ = bpe.scanner()
    for a in range(len(compose)):  # associative
        assert (compose[compose[a]] == compose[a][compose]).all()
    e = np.random.default_rng(0).integers(0, len(compose), 1000).astype(np.int16)
    out, state = bpe.scan(e, compose, block=16), e[0]
    for i in range(1, 1000):
        state = compose[state, e[i]]
        assert out[i] == state


def test_cache_limit_changes_nothing(monkeypatch):
    texts = random_texts(300, 2)
    run = lambda m: [bpe.encode_batch(*common.utf8(pa.array(texts[i : i + 50])), table, m)[0].tolist() for i in range(0, 300, 50)]
    table, ranks = bpe.class_table(), bpe.read_ranks(bpe.VOCABULARY)
    whole = run(bpe.Merger(ranks))
    monkeypatch.setattr(bpe, "CACHED", 10)
    assert run(bpe.Merger(ranks)) == whole


def test_tokens_by_stretch_equal_whole_texts():
    library, known = Tokenizer.from_file(packing.VOCABULARY), packing.Stretches(packing.VOCABULARY)
    for t in random_texts(3000, 3):
        assert np.frombuffer(packing.tokenise(t, known), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids


def by_window(totals, share, deficit, lengths):
    """What each window takes from each queue as a matrix."""
    taken = np.zeros((len(lengths), len(totals)), np.int64)
    window, queue, tokens = packing.round_robin(totals, share, deficit, lengths)
    taken[window, queue] = tokens
    assert (tokens > 0).all() and sorted(zip(window, queue, strict=True)) == list(zip(window, queue, strict=True))
    return taken


def test_round_robin_carries_deficits():
    totals, share = np.array([5000, 3000, 10, 0]), np.array([0.6, 0.3, 0.1, 0.0])
    lengths = packing.window_lengths(int(totals.sum()), 256)
    taken = by_window(totals, share, np.zeros(4), lengths)
    assert (taken.sum(0) == totals).all() and (taken.sum(1) == lengths).all()
    early = taken[:10].sum(0) / taken[:10].sum()
    assert early[2] < 0.01 and early[0] > 0.6 and early[1] > 0.3  # the third queue has run dry, and the others share its part
    assert by_window(np.array([100, 100]), np.array([0.5, 0.5]), np.array([20.0, -20.0]), np.array([64]))[0].tolist() == [52, 12]


def test_many_queues_take_no_more_than_tokens():
    """100,000 sources of 40 tokens each: pieces tile documents and windows, and what is kept is no more than there are tokens."""
    totals = np.full(100_000, 40)
    lengths = packing.window_lengths(int(totals.sum()), 2048)[:60]
    window, queue, tokens = packing.round_robin(totals, np.full(100_000, 1e-5), np.zeros(100_000), lengths)
    assert len(tokens) <= lengths.sum() == tokens.sum()
    doc_tokens = np.bincount(queue, tokens, 100_000).astype(np.int64)
    doc_tokens = doc_tokens[doc_tokens > 0]
    doc, start, length, at, offset = packing.cut_pieces(doc_tokens, window, queue, tokens)
    assert (np.bincount(doc, length) == doc_tokens).all() and (np.bincount(at, length) == lengths).all()
    order = np.lexsort((offset, at))
    ends = offset[order] + length[order]
    assert (offset[order] == np.where(np.diff(at[order], prepend=-1) != 0, 0, np.roll(ends, 1))).all()


@pytest.mark.parametrize("tokens", [0, 1, 2047, 2048, 2049, 10_000])
def test_window_lengths(tokens):
    lengths = packing.window_lengths(tokens, 2048)
    assert lengths.sum() == tokens and all(n & (n - 1) == 0 for n in lengths.tolist())


def test_golay_covering():
    words = np.arange(1 << 12) * 2053 % (1 << 23)
    patterns, at = simhash._patterns(2)
    nearest = patterns[at[simhash.syndrome(words) * 3]]
    assert (np.bitwise_count(nearest) <= 3).all() and (simhash.syndrome(words ^ nearest) == 0).all()
    assert len(patterns) == 44552


def test_linked_fingerprints_meet():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(300):
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            y[i] ^= np.uint64(1 << int(b))
    (ra, a), (rb, b) = simhash.anchors(x), simhash.anchors(y)
    assert all(set(a[ra == i]) & set(b[rb == i]) for i in range(300))


@pytest.mark.parametrize("small", [4, 48])
def test_stars_connect_what_pairs_connect(monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "KEYS_AT_ONCE", 3000)
    rng, points = np.random.default_rng(1), set()
    for base in rng.integers(0, 1 << 63, 5, dtype=np.uint64).tolist():
        for _ in range(60):
            p = base
            for b in rng.choice(64, rng.integers(0, 4), replace=False).tolist():
                p ^= 1 << b
            points.add(p)
    prints = np.array(sorted(points), np.uint64)
    row, near = simhash.anchors(prints)
    order = np.argsort(near, kind="stable")
    a, b = simhash.stars(near[order], prints[row[order]])
    place = {int(p): i for i, p in enumerate(prints)}
    got = simhash._roots(len(prints), np.array([place[int(v)] for v in a]), np.array([place[int(v)] for v in b]))
    assert got.tolist() == brute.components([int(p) for p in prints])


def test_chain_of_links(spark):
    prints = [0]
    for i in range(30):
        prints.append(prints[-1] ^ (3 << 2 * i))
    rng = random.Random(1)
    ids = rng.sample(range(1000), len(prints))
    table = spark.createDataFrame([(d, p) for d, p in zip(ids, prints, strict=True)] + [(2000, 0xF0F0F0F << 3)], "doc_id long, print long")
    got = {r.doc_id: r.component_id for r in simhash.components(table).collect()}
    assert {got[d] for d in ids} == {min(ids)} and got[2000] == 2000


def test_fingerprints_of_random_text():
    texts = random_texts(500, 4)
    assert simhash.fingerprints(*common.utf8(pa.array(texts))).tolist() == [brute.simhash(t) for t in texts]


def test_window_ranks_are_entropies():
    import collections
    import math

    raw = ("Some prose, 12 of it; aaaa" * 3 + "a" * 80 + "Zq9").encode()
    got = fingerprint.window_ranks(np.frombuffer(raw, np.uint8))
    for i, r in enumerate(got.tolist()):
        c = collections.Counter(raw[i : i + fingerprint.WINDOW])
        level = 1000 * -sum(v / 32 * math.log2(v / 32) for v in c.values()) / 5
        want = fingerprint._UNRANKED if level < fingerprint.FLAT - 0.5 else 1000 - abs(level - fingerprint.TYPICAL)
        assert abs(r - want) <= 1


def test_likeness_of_texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    text = lambda a, b: " ".join(words[a:b])
    of = lambda *t: [fingerprint.written(f[a:b], c[a:b]) for f, c, at in [fingerprint.digest(*common.utf8(pa.array(t)))] for a, b in zip(at, at[1:], strict=False)]
    whole, half, other, empty, short = of(text(0, 2000), text(0, 1000) + " " + text(3000, 4000), text(2000, 4000), "", "tiny")
    assert fingerprint.compare(whole, whole) == 1 and fingerprint.compare(empty, empty) == 1
    assert fingerprint.compare(whole, empty) == 0 and fingerprint.compare(short, short) == 1
    assert fingerprint.compare(whole, other) < 0.1 < 0.4 < fingerprint.compare(whole, half) < 0.8
    assert fingerprint.compare(half, whole) == fingerprint.compare(whole, half)


def test_novelty():
    secret = b"auth: the credential is Q7xT2vLp9ZkR4mWcY8bN here"
    plain = b"auth: the credential is authorization_configuration_parameters here"
    repeated = b"auth: the credential is xyxyxyxyxyxyxyxyxyxyxyxy here"
    assert [k for _, k, _, _ in secrets.find(secret)] == [3]
    assert secrets.find(plain) == [] and secrets.find(repeated) == []


def test_secrets_on_random_text():
    parts = ["password", "API_KEY", "token", "=", ": ", '"', "'", "AKIA", "ABCDEF0123", "deadbeef", "0123456789abcdef", "é", "\n", " ", "/+", "secret"]
    for t in random_texts(2000, 6, parts, 20):
        found = [(a, k, b) for a, k, b, _ in secrets.find(t.encode()) if k < 3]
        chars = [(len(t.encode()[:a].decode()), k, len(t.encode()[:b].decode())) for a, k, b in found]
        assert chars == brute.base_spans(t)


def test_chat_round_trip(spark):
    texts = random_texts(200, 7, ["\\", "#", "<", "###", "</turn>", ":", " ", "\n", "é", "🙂", "### assistant: ", "\\\\", "x"])
    rows = [(i // 4 if i // 4 != 9 else None, i % 4 if i % 3 else 0, [None, "user", "assistant", "a:#<\\b"][i % 4], t if i % 7 else None) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(frame)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    import hashlib

    for c in {r[0] for r in rows}:
        own = sorted([(t, r or "", x or "", r is not None, x is not None) for k, t, r, x in rows if k == c], key=lambda v: (v[0], v[3], v[1], v[4], v[2]))
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x, _, _ in own).encode()).hexdigest()
        said = "".join(x for _, r, x, _, _ in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.read_back(chat.format_chats(frame.limit(0))).count() == 0


def test_chat_ignores_clashing_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, None, None, "b\\<#"), (None, 2, "assistant", None), (2, 1, "assistant", "ü"), (2, 1, "assistant", "ü")], "conv_id long, turn long, role string, text string")
    clashing = turns.selectExpr("*", "9 as part", "'x' as formatted", "8 as n_turns", "array(1) as loss_start", "array(2) as loss_end", "'y' as turns_sha256")
    rows = lambda df: sorted(map(repr, chat.read_back(chat.format_chats(df)).collect()))
    assert rows(clashing) == rows(turns) and len(rows(turns)) == 3


def test_long_conversation_comes_in_parts(spark):
    frame = spark.range(60).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat('<#é ', 100000) as text")
    formatted = chat.format_chats(frame)
    assert formatted.count() > 1
    r = chat.read_back(formatted).collect()
    assert len(r) == 1 and r[0].n_turns == 60 and r[0].loss_chars == 30 * 400_000


def test_url_rules(spark):
    pages = [(1, "http://a.example.net/en/x"), (2, "http://EXAMPLE.net/de"), (3, "https://notexample.net/en/"), (4, "x"), (5, None), (6, "ftp://net/"), (7, "http://b.c.org/fr/?q#f"), (8, "http://org/fr"), (9, "http://example.com/de/1?x"), (9, "http://example.com/de/1?x"), (10, "://"), (11, "http://a..net/"), (12, "http://x.com?net/")]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "block"), (None, "/", "block"), ("", "/", "block"), ("com", "", "allow")]
    frame = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "1 as host", "2 as rule", "3 as key")
    got = urls.judge(frame, spark.createDataFrame(rules, "host string, path string, verdict string"), ["page_id"]).collect()

    def brute_force(url):
        at = (url or "").find("://")
        rest = url[at + 3 :] if at >= 0 else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        fits = [(len(h + p), len(h), v == "block", h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], ("block" if best[2] else "allow") if best else "allow" if host else "block"

    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted((i, *(x or "" for x in brute_force(u))) for i, u in pages)
    assert urls.judge(frame.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string"), ["page_id"]).count() == 0
    assert {r.rule for r in urls.judge(frame, spark.createDataFrame([], "host string, path string, verdict string"), ["page_id"]).collect()} == {None}


def test_many_nested_rules_and_common_keys(spark):
    rng = random.Random(8)
    labels, segments = ["a", "b", "c"], ["", "x", "y"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(segments) for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (h, p, rng.choice(["block", "allow"])) for h, p in [(host(), path()) for _ in range(150)]}.values())
    pages = [(i, f"http://{host()}{path()}") for i in range(1500)] + [(i, "http://a/") for i in range(1500, 2500)]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), ["page_id"])
    verdicts = {r.page_id: (r.rule, r.verdict) for r in got.collect()}
    assert len(verdicts) == 2500
    for i, u in pages:
        h, _, p = u[7:].partition("/")
        fits = [(len(a + b), len(a), v == "block", a + b) for a, b, v in rules if (h == a or h.endswith("." + a)) and ("/" + p).startswith(b)]
        best = max(fits, default=None)
        assert verdicts[i] == ((best[3], "block" if best[2] else "allow") if best else (None, "allow"))


def test_archive(spark, tmp_path):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (5, "u5", "same"), (3, None, None), (4, "u4", ""), (6, "u6", "é\r\n\r\nWARC/1.1"), (6, "u6", "é\r\n\r\nWARC/1.1"), (None, "n", "null key"), (7, "u7", "x" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as key", "3 as owner")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    records = warc.read_archive(spark, path).collect()
    assert len(records) == len(rows)
    for r in records:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(rest) - 4 and rest.endswith(b"\r\n\r\n")
        assert fields["WARC-Type"] == ("revisit" if r.refers_to is not None else "response")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(pages).collect()), key=str)
    want = [(1, 4, "revisit", 5), (2, 4, "revisit", 5), (5, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (6, 14, "response", None), (6, 14, "response", None), (None, 8, "response", None), (7, 200_000, "response", None)]
    assert got == sorted(want, key=str)
    small = {r.page_id: r.record_type for r in warc.archived(pages, min_revisit=5).collect()}
    assert small[1] == small[3] == "response"
    assert warc.archived(pages.limit(0)).count() == 0


def test_line_spread(spark):
    rows = []
    for i in range(40):
        site = f"s{i % 8}"
        shared = ["a line that many sites share", "  only on the first three sites \t" if i % 8 < 3 else "", "four sites have this line" if i % 8 < 4 else "five sites have this line", "too short"]
        rows.append((i, "\n".join([f"own words of document number {i} " * 6, *shared]), site))
    rows += [(100 + i, "a line that many sites share", f"s{i}") for i in range(8)] + [(200, None, "s1"), (201, "", None), (0, rows[0][1], "s0")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as d", "2 as t", "3 as gone", "4 as n_lines_removed")
    for sites in (3, 4, 5):
        got = lines.dedup(frame, min_sites=sites)
        want = brute.lines_removed(rows, sites, 4)
        assert sorted(((r.doc_id, r.text or "") for r in got.collect())) == sorted((r[0], w or "") for r, w in zip(rows, want, strict=True))


def test_lines_of_a_very_long_text(spark):
    """100,000 lines, every second one boilerplate: removal takes time linear in lines."""
    import time

    shared = [f"boilerplate line number {i} of many" for i in range(50_000)]
    long = "\n".join(x for i, s in enumerate(shared) for x in (s, f"own {i}"))
    rows = [(0, long, "s0")] + [(1 + k, "\n".join(shared[k::7]) + f"\nown {k}", f"s{k}{j}") for k in range(7) for j in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    began = time.perf_counter()
    got = {(r.doc_id, r.text) for r in lines.dedup(frame).collect()}
    assert time.perf_counter() - began < 60
    assert got == {(0, "\n".join(f"own {i}" for i in range(50_000)))} | {(1 + k, f"own {k}") for k in range(7)}


def test_odd_rows_everywhere(spark, odd_docs, no_docs, labels):
    texts = odd_docs.select("doc_id", "text").collect()
    n = len(texts)
    import hashlib

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})
    encoded = sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.digests(bpe.encode(odd_docs, ["doc_id"]), ["doc_id"]).collect()), key=str)
    assert encoded == sorted(((r.doc_id, len(library.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in texts), key=str)
    # In the order of ids, null first, and of texts among equal ids; rows of an id repeat its next text.
    prints = fingerprint.fingerprint_and_edit(odd_docs).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in texts))
    want = []
    for i, (known, d, t) in enumerate(rows):
        after = rows[(i + 1) % n][2]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((d if known else None, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in prints), key=str) == sorted(want, key=str)
    blank = {r.doc_id: r for r in prints}
    assert blank[0].fingerprint == blank[1].fingerprint == "sd1::" and blank[0].near_edited == 1.0 and blank[1].near_next == 0.0
    assert fingerprint.fingerprint(odd_docs, ["doc_id"]).count() == n
    pieces = packing.pack(odd_docs, with_ids=True)
    assert pieces.where("offset = 0").count() == pieces.select("sequence_id").distinct().count()
    assert pieces.where("length < 1 or length(ids) <> 4 * length").isEmpty()
    judged = quality.score(odd_docs, labels, keep=["doc_id", "text", "words", "grams"]).collect()
    assert len(judged) == n
    for r in judged:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.base_counts(r.text)
    grouped = simhash.near_duplicates(odd_docs).collect()
    assert len(grouped) == n
    assert {r.doc_id: r.component_id for r in grouped}[10] == 8
    cleaned = lines.dedup(odd_docs)
    assert cleaned.count() == n and cleaned.columns[: len(odd_docs.columns)] == odd_docs.columns
    assert secrets.scan(odd_docs).where("n_assign = 1").count() == 1
    redacted = {r.doc_id: r.text for r in secrets.redact(odd_docs).collect()}
    assert redacted[12] == f'password = "{secrets.MARK}"\nok' and redacted[0] is None
    for result in (bpe.digests(bpe.encode(no_docs, ["doc_id"]), ["doc_id"]), fingerprint.fingerprint_and_edit(no_docs), packing.pack(no_docs), quality.score(no_docs, labels), simhash.near_duplicates(no_docs), lines.dedup(no_docs), secrets.scan(no_docs), secrets.redact(no_docs)):
        assert result.count() == 0
    assert quality.score(odd_docs, labels.limit(0)).where("score <> 0").isEmpty()


def test_mixture(spark, odd_docs):
    frame = odd_docs.where("text is not null").selectExpr("doc_id", "concat(text, repeat(' word', 3000)) as text", "source")
    pieces = packing.pack(frame, mixture={"s1": 3.0, "s2": 1.0})
    first = {r.source: r.n for r in pieces.where("sequence_id = 0").groupBy("source").agg(F.sum("length").alias("n")).collect()}
    assert first == {"s1": 1536, "s2": 512}


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "simhash", "secrets", "packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    _, _, passed = brute.quality_kept(texts, good, quality.BUCKETS, quality.PRIOR, quality.LOST)
    kept = [(r.doc_id, r.text, r.source) for r in docs.orderBy("doc_id").collect() if r.doc_id in passed]
    cleaned = brute.lines_removed(kept, lines.MIN_SITES, lines.MIN_WORDS)
    root = brute.similar(cleaned)
    stay = {kept[i][0]: cleaned[i] for i in range(len(kept)) if root[i] == i}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf), "test")
        assert docs.columns == corpus_pipeline.COLUMNS
        assert docs.where("n_chars <> length(text)").isEmpty()
        if name == "simhash":
            assert {r.doc_id: r.text for r in docs.collect()} == stay
    final = {r.doc_id: r.text for r in docs.collect()}
    assert final.keys() == stay.keys()
    for d, t in final.items():
        assert (t == stay[d]) == (not secrets.find(stay[d].encode()))
        assert not any(k == 0 for _, k, _, _ in secrets.find(t.encode()))
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(final)
