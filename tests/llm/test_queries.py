"""Registered queries against SQL, brute force and the libraries, over whole small tables."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm import brute
from tests.test_oracle import TABLES, rows
from tidemark.llm import bpe, fingerprint, oracle, packing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return {d: t or "" for d, t in duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()}


def by_id(spark, name):
    return {r.doc_id: r for r in queries.queries()[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(oracle.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_bpe_equals_tiktoken(spark, docs):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})
    got = by_id(spark, "op2_bpe")
    assert len(got) == len(docs)
    for d, t in docs.items():
        ids = library.encode_ordinary(t)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_fingerprints_tell_edits_from_neighbours(spark, docs):
    got = by_id(spark, "op3_fingerprint")
    texts = list(docs.values())
    for (d, t), after in zip(docs.items(), texts[1:] + texts[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_next <= 1 and 0 <= got[d].near_edited <= 1
    long = [r for d, r in got.items() if len(docs[d]) > 200]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.98
    assert np.median([r.near_edited for r in long]) > 0.4 and np.median([r.near_next for r in long]) < 0.05
    same = {}
    for d, t in docs.items():
        assert same.setdefault(t, got[d].fingerprint) == got[d].fingerprint


def test_fingerprints_by_definition(spark, docs):
    """Votes, Bloom chains and likeness against plain Python, for all documents up to 15,000 characters."""
    got = by_id(spark, "op3_fingerprint")
    texts = list(docs.values())
    checked = 0
    for (d, t), after in zip(docs.items(), texts[1:] + texts[:1], strict=True):
        if len(t) > 15_000 or len(after) > 15_000:
            continue
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, changed, following = map(brute.fingerprint_filters, (t, edited, after))
        for printed, chain in ((got[d].fingerprint, own), (got[d].edited_fingerprint, changed)):
            filters, counts = fingerprint.parsed(printed)
            assert counts.tolist() == [n for n, _ in chain]
            assert [set(np.flatnonzero(np.unpackbits(f)).tolist()) for f in filters] == [f for _, f in chain]
        assert got[d].near_edited == pytest.approx(brute.likeness(own, changed), abs=1e-12)
        assert got[d].near_next == pytest.approx(brute.likeness(own, following), abs=1e-12)
        checked += 1
    assert checked > 0.8 * len(docs)


def test_packing(spark, docs):
    library = Tokenizer.from_file(packing.VOCABULARY)
    pieces = queries.queries()["op4_packing"](spark, SF).toPandas()
    assert set(pieces.doc_id) == set(docs)
    for d, g in pieces.sort_values("start").groupby("doc_id"):
        ids = np.array([*library.encode(docs[d], add_special_tokens=False).ids, packing.END_ID], "<u4")
        assert (g.doc_tokens == len(ids)).all() and g.length.sum() == len(ids)
        assert (g.start.to_numpy() == np.cumsum(g.length) - g.length).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g.start, g.length, strict=True)] == list(g.ids_crc32)
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        total = int(g.length.sum())
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and total <= 2048 and total & (total - 1) == 0
    assert sorted(pieces.sequence_id.unique()) == list(range(pieces.sequence_id.nunique()))
    whole = pieces.groupby("source").length.sum() / pieces.length.sum()
    first = pieces[pieces.sequence_id == 0].groupby("source").length.sum() / 2048
    assert (whole - first).abs().max() < 2 / 2048 + 1e-9


def test_quality(spark, duck, docs):
    from tidemark.llm import quality

    good = {d for (d,) in duck.sql("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0").fetchall()}
    score, failed, kept = brute.quality_kept(docs, good, quality.BUCKETS, quality.PRIOR, quality.LOST)
    for d, r in by_id(spark, "op6_quality").items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.base_counts(docs[d])
        assert r.score == pytest.approx(score[d], abs=1e-9)
        assert r.base_failed == (d in failed) and r.kept == (d in kept)


def test_quality_of_labels_it_was_not_fitted_on(spark):
    """On the half of the labels that is not counted: the good ones stay but for the share given up, the poor ones go."""
    sf = "/root/testdata/sf0.01"
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    got = [(r.kept, quality_of[r.doc_id], brute.half(r.doc_id)) for r in queries.queries()["op6_quality"](spark, sf).collect() if r.doc_id in quality_of and not r.base_failed]
    good, poor = [k for k, q, h in got if q and h], [k for k, q, _ in got if not q]  # poor labels are never counted
    assert len(good) > 100 and len(poor) > 20
    assert np.mean(good) >= 0.99 and np.mean(poor) <= 0.1


def test_simhash(spark, docs):
    got = by_id(spark, "op7_simhash")
    ids, prints = list(docs), [brute.simhash(t) for t in docs.values()]
    assert [got[d].fingerprint for d in ids] == [f"{p:016x}" for p in prints]
    assert [got[d].component_id for d in ids] == [ids[i] for i in brute.components(prints)]


def test_secrets(spark, docs):
    for d, r in by_id(spark, "op9_secrets").items():
        want = brute.base_spans(docs[d])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert r.base_sha256 == brute.spans_digest(want)
