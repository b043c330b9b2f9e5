"""PPM scores, Elkan's rounds and the prefix trie: kernels against plain forms, whole queries, odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import elkan, ppm, prefixes, queries

SF = "/root/testdata/sf0.001"
LETTERS = ["A", "b", "Z", "é", "漢", "🙂", " ", "\n", "\t\x0b", "  ", "\x1c", "\x00", "the", " of", "xyz"]
def held():
    """As the query holds documents out; columns need a session."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def same_scores(got, want):
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score == pytest.approx(w[5], rel=1e-9)


def test_scores_by_definition(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    same_scores(queries.op11_ppm(spark, SF).collect(), brute.ppm_scores(docs, ppm.ORDER))


@pytest.mark.parametrize("order, block", [(1, 1), (3, 50), (5, 1 << 20), (6, 300)])
def test_blocks_do_not_change_scores(spark, order, block):
    rng = random.Random(order)
    docs = {d: "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 25))) for d in range(60)}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    same_scores(ppm.score(table, held(), order=order, block=block).collect(), brute.ppm_scores(docs, order))


def test_ppm_of_odd_rows(spark, odd_docs, no_docs):
    got = ppm.score(odd_docs, held(), keep=["doc_id", "key", "gone"]).collect()
    assert len(got) == odd_docs.count() and {len(r) for r in got} == {9}
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in odd_docs.collect()}
    assert all(r.n_tokens == words[r.doc_id] + 1 and r.score < 0 and r.base_score < 0 for r in got)
    assert next(r for r in got if r.doc_id is None).held_out
    assert ppm.score(no_docs, held()).collect() == []
    alone = ppm.score(spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string"), F.lit(True)).collect()  # nothing is learned
    assert {r.doc_id: (r.train_tokens, r.n_known) for r in alone} == {1: (0, 0), 2: (0, 0)}
    assert {r.doc_id: round(r.score, 9) for r in alone} == {1: round(-3 * np.log10(255), 9), 2: round(-np.log10(255), 9)}


def test_held_out_texts_are_better_than_by_words(spark):
    got = queries.op11_ppm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] - 0.15  # 1,000 documents; above the base from some 10,000 on


def plain_rounds(x, parts, entries, rounds):
    """Codes, errors and codebooks by Lloyd's rounds with all distances, of whole vectors in the order of their keys."""
    width = x.shape[1] // parts
    codes, errors, books = [], np.zeros(len(x), np.int64), []
    for p in range(parts):
        part = x[:, p * width : (p + 1) * width]
        book = part[:entries].copy()
        nearest = lambda b, v=part: ((v[:, None] - b[None]) ** 2).sum(2)
        for _ in range(rounds):
            own = nearest(book).argmin(1)
            for e in range(len(book)):
                if (own == e).any():
                    book[e] = part[own == e].sum(0) // (own == e).sum()
        d = nearest(book)
        codes.append(d.argmin(1))
        errors += d.min(1)
        books.append(book)
    return np.stack(codes, 1), errors, np.stack(books)


def test_bounds_prune_and_change_nothing():
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, (16, 4))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 4))
    x[:40] = x[0]  # ties and copies
    book = x[::250][:16].copy()
    own, upper, lower = np.zeros(4000, np.int64), np.full(4000, np.inf, np.float32), np.zeros((4000, 16), np.float32)
    taken = []
    for _ in range(8):
        own, upper, lower, n = elkan.reassigned(x, book, own, upper, lower)
        taken.append(n)
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (own == d.argmin(1)).all()
        assert (upper.astype(float) ** 2 >= d[np.arange(4000), own] - 1e-6).all() and (lower.astype(float) ** 2 <= d + 1e-6).all()
        last = book.copy()
        for e in range(16):
            if (own == e).any():
                book[e] = x[own == e].sum(0) // (own == e).sum()
        upper, lower = elkan.shifted(own, upper, lower, np.sqrt(((book - last) ** 2).sum(1)))
    assert taken[0] <= 4000 * 16 and sum(taken[3:]) < 0.2 * 5 * 4000 * 16


def test_codes_of_odd_vectors(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(10)], i % 3 or None) for i in range(40)]
    vectors += [(5, vectors[5][1], 1), (5, vectors[5][1], 1), (None, [0.5] * 10, None), (99, None, 1), (98, [], 1), (97, [float("nan")] * 10, 1), (96, [None] * 10, 1), (95, [float("inf")] + [0.0] * 9, 1), (94, [1.0] * 9, 1)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(4)
    table = table.selectExpr("*", "'x' as own", "'y' as part", "'z' as k", "'w' as code_")
    coded, books = elkan.compress(table, keep=["vec_id", "label", "own"], parts=4)
    got = elkan.with_group_error(coded, "label").collect()
    sound = sorted(((i is None, i or 0, v), lab) for i, v, lab in vectors if v and len(v) == 10 and all(c is not None and abs(c) < 9 for c in v))
    x = np.zeros((len(sound), 12), np.int64)
    x[:, :10] = np.floor(np.array([k[2] for k, _ in sound], np.float32).astype(float) * 4096)
    codes, errors, want = plain_rounds(x, 4, 16, 6)
    assert (books == want).all()
    by_label = {}
    for (_, lab), e in zip(sound, errors.tolist(), strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    expected = sorted((k[1] if not k[0] else -1, "".join(f"{c:02x}" for c in row), e, by_label[lab]) for (k, lab), row, e in zip(sound, codes.tolist(), errors.tolist(), strict=True))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error) for r in got) == expected
    assert {r.own for r in got} == {"x"}


def test_few_and_no_vectors(spark):
    coded, books = elkan.compress(spark.createDataFrame([(2, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>"), parts=2)
    assert books.shape == (2, 2, 1) and {r.vec_id: (r.code, r.error) for r in coded.collect()} == {1: ("0000", 0), 2: ("0101", 0)}
    coded, books = elkan.compress(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert coded.columns == ["vec_id", "code", "error"] and coded.count() == 0 and elkan.codebooks_digest(books) == hashlib.sha256(b"").hexdigest()


def plain_trie(conversations, size):
    """{(depth, smallest member): (parent, members, children, leaves, saved, ids that end here)} of {id: tuple of turns}."""
    nodes, kids = {}, {}
    for c, s in conversations.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out = {}
    for k, m in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        saved = sum((len(nodes[x]) - 1) * (size(x[-1]) if x else 0) for x in below)
        ends = sorted(c for c in m if len(conversations[c]) == len(k))
        out[len(k), min(m)] = (min(nodes[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), sum(x not in kids for x in below), saved, ends)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_stretches_of_a_trie_add_up(seed):
    """Sorted paths cut anywhere give the nodes of the plain trie."""
    rng = random.Random(seed)
    conversations = {c: tuple((rng.choice("ab"), rng.randint(1, 3)) for _ in range(rng.randint(0, 7))) for c in range(rng.randint(1, 40))}
    size = lambda turn: ord(turn[0]) % 7 * turn[1]
    grouped = {}
    for c, s in conversations.items():
        chain, total = [], []
        for turn in s:
            chain.append(hashlib.blake2b((chain[-1] if chain else b"") + repr(turn).encode(), digest_size=prefixes.WIDE).digest())
            total.append((total[-1] if total else 0) + size(turn))
        grouped.setdefault(b"".join(chain), (np.array(total, np.int64).tobytes(), []))[1].append(c)
    rows = sorted((p, b, len(ids), min(ids), str(sorted(ids))) for p, (b, ids) in grouped.items())
    cuts = sorted(rng.sample(range(1, len(rows)), min(rng.randint(0, 4), len(rows) - 1)))
    stretches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    left = [0, *(prefixes.shared_turns(a[-1][0], b[0][0]) for a, b in zip(stretches, stretches[1:], strict=False)), 0]
    given = []
    for i, stretch in enumerate(stretches):
        tree = prefixes._Stretch(left[i], given)
        for row in stretch:
            tree.add(*row)
        tree.finish(left[i + 1])
    names = ["key", "depth", "low", "n", "children", "leaves", "weighted", "own", "above", "ends", "parent", "part", "point"]
    nodes = {}
    for row in (dict(zip(names, r, strict=True)) for r in given):
        k = row["key"], row["depth"]
        if k not in nodes:
            nodes[k] = row
            continue
        assert row["part"] and nodes[k]["part"]
        nodes[k] |= {c: nodes[k][c] + row[c] for c in ("n", "children", "leaves", "weighted", "own")} | {"low": min(nodes[k]["low"], row["low"]), "ends": nodes[k]["ends"] or row["ends"]}
    lows = {r["key"]: r["low"] for r in nodes.values() if r["point"] or r["part"]}
    got = {}
    for r in nodes.values():
        parent = lows[r["parent"]] if r["parent"] is not None else r["low"] if r["depth"] else None
        got[r["depth"], r["low"]] = (parent, r["n"], r["children"], r["leaves"] if r["children"] else 1, r["weighted"] - r["n"] * r["above"] - r["own"], eval(r["ends"] or "[]"))
    assert got == plain_trie(conversations, size)


def test_trie_of_odd_conversations(spark):
    """Null ids, turns, roles and texts, repeated rows, ties, copies, turnless conversations, clashing columns."""
    rng = random.Random(4)
    turns = [(c, t, rng.choice(["user", None]), rng.choice(["é", "", None, "b"])) for c in range(10, 45) for t in range(rng.randint(1, 6))]
    turns += [(11, None, "system", "first"), (11, 0, "user", "é"), (11, 0, "user", "é"), (None, 0, "user", "x"), (7, 0, "user", "alone")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).selectExpr("*", "1 as place", "2 as path", "3 as `end`", "4 as n", "5 as r", "6 as t", "7 as size")
    own = {}
    for c, t, r, x in sorted((t for t in turns if t[0] is not None), key=lambda t: (t[0], t[1] is not None, t[1] or 0, (t[2] or "").encode(), (t[3] or "").encode())):
        own.setdefault(c, []).append((r or "", x or ""))
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    rebuilt = {c: tuple(own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :]) for c in own}
    want = plain_trie(rebuilt, lambda turn: len(turn[1].encode()))
    got = prefixes.trie(prefixes.paths(prefixes.with_shared_heads(prefixes.numbered(table)))).collect()
    assert {(r.depth, r.conv_id): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got} == {k: (*v[:5], hashlib.sha256(",".join(map(str, v[5])).encode()).hexdigest()) for k, v in want.items()}
    assert len(got) == len(want)
    assert prefixes.trie(prefixes.paths(prefixes.with_shared_heads(prefixes.numbered(table.where("false"))))).collect() == []
