"""Operators 5 and 10 against the tokenizers library, and the packing's invariants."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from chronolock.llm import packing, pretokens, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def strange(n: int) -> list[str]:
    rng = random.Random(7)
    bits = ["a", "b", "'s", "'t", "'re", "'ll", "'", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "²", "!", "...", "日本", "<|endoftext|>", "\x1f", "'ve", "s", "d", "\r\n", "😀", "　", "_", "́"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_ids_are_the_library_s():
    texts = strange(1500)
    encode = pretokens.encoder(PATH)
    known = pretokens.table_of([" the", "a", "\n", "'s", " ", "!"], encode)
    for got, want in zip(pretokens.token_ids(texts, encode, known), library(texts)):
        assert got.tolist() == want
    assert pretokens.token_counts(texts, encode, known).tolist() == [len(w) for w in library(texts)]


def test_equal_hashes_decide_nothing(spark, make_docs):
    """A word of 1024 letters and its complement collide in any polynomial hash modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    texts += [f"{texts[0]} {texts[1]}", f"{texts[1]} {texts[0]} x {texts[1]}"]
    encode = pretokens.encoder(PATH)
    for table in ([], [texts[0]], [texts[1], " " + texts[0]]):
        known = pretokens.table_of(table, encode)
        assert [x.tolist() for x in pretokens.token_ids(texts, encode, known)] == library(texts)
        assert pretokens.token_counts(texts, encode, known).tolist() == [len(x) for x in library(texts)]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(make_docs(list(enumerate(texts)))).collect()}
    assert got == {i: len(x) for i, x in enumerate(library(texts))}


def test_frequent_table_is_small_and_never_empty(spark, make_docs):
    rows = make_docs([(None, "the same words")] * 400 + [(1, "z" * 5000)])
    known = pretokens.frequent(token_counts.doc_texts(rows), PATH, 200, most=3)
    assert 0 < int((known.length > 0).sum()) <= 3 and len(known.chars) <= 3 * 64


def test_many_equal_pieces_are_packed_fast():
    import time

    start = time.time()
    sizes = np.array([600] * 16_384)
    assert len(packing.improve(packing.best_fit(sizes, 1024), sizes, 1024)) == 16_384
    sizes = np.random.default_rng(1).integers(513, 1024, 16_384)
    assert len(packing.improve(packing.best_fit(sizes, 1024), sizes, 1024)) == 16_384
    assert time.time() - start < 60


def test_a_shard_of_many_open_bins_is_searched_fast():
    import time

    rng = np.random.default_rng(10)
    sizes = np.concatenate([rng.integers(180, 760, 9000), np.clip(rng.normal(330, 4, 4000).astype(int), 300, 360)])
    start = time.time()
    bins = packing.improve(packing.best_fit(sizes, 1024), sizes, 1024)
    assert time.time() - start < 5
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert max(int(sizes[b].sum()) for b in bins) <= 1024


def test_search_ends_where_no_pair_gains():
    rng = np.random.default_rng(11)
    for _ in range(10):
        sizes = rng.integers(100, 700, 80)
        bins = packing.improve(packing.best_fit(sizes, 1024), sizes, 1024, rounds=1000)
        fill = [int(sizes[b].sum()) for b in bins]
        if len(bins) <= -(-sum(fill) // 1024):
            continue
        for g, low in zip(bins, fill):
            for t, full in zip(bins, fill):
                if t is g or full < low or (full == low and bins.index(t) > bins.index(g)):
                    continue
                gives = [int(sizes[y]) for y in g]
                both = [y + z for a, y in enumerate(gives) for z in gives[a + 1 :]]
                assert not any(0 < y <= 1024 - full for y in gives)
                assert not any(0 < y - sizes[x] <= 1024 - full for y in gives + both for x in t)


def test_counts_by_row(spark, make_docs, odd_texts):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(make_docs(odd_texts, clashes=True)).collect())
    ids = library([t or "" for _, t in odd_texts])
    assert got == sorted((i or -1, len((t or "").encode()), len(x), len(x) > 512) for (i, t), x in zip(odd_texts, ids))
    assert token_counts.count_tokens(make_docs([])).count() == 0


def check_packing(rows, docs, capacity):
    want = {}
    for (i, _), ids in zip(docs, library([t or "" for _, t in docs])):
        ids = [*ids, 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k)] = (s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_round_trip(spark, make_docs, odd_texts):
    docs = [(i, t) for i, t in odd_texts if i is not None and i != 41]
    rows = packing.pack_documents(make_docs(docs, clashes=True)).collect()
    n = check_packing(rows, docs, 1024)
    assert n <= -(-sum(r.length for r in rows) // 1024) + 1
    many = check_packing(packing.pack_documents(make_docs(docs), capacity=64, shard=8).collect(), docs, 64)
    assert many > n
    assert packing.pack_documents(make_docs([])).count() == 0
    assert packing.pack_documents(make_docs(odd_texts)).count() >= len(odd_texts)


def test_swaps_improve_best_fit():
    rng = np.random.default_rng(8)
    for _ in range(20):
        sizes = rng.integers(200, 700, 60)
        before = packing.best_fit(sizes, 1024)
        after = packing.improve([list(b) for b in before], sizes, 1024)
        assert sorted(i for b in after for i in b) == list(range(60))
        assert all(sum(sizes[i] for i in b) <= 1024 for b in after)
        assert len(after) <= len(before)
        square = lambda bins: sum(int(sum(sizes[i] for i in b)) ** 2 for b in bins)
        assert square(after) >= square(before)
    # what best fit gets wrong, one exchange mends
    sizes = np.array([6, 4, 5, 5, 7, 3])
    assert len(packing.improve([[0], [1, 2], [3, 5], [4]], sizes, 10)) == 3
