"""Operators 1, 4 and 8 against brute force, and their odd inputs."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from chronolock.llm import components, line_dedup, order_minhash, simhash_anchor
from tests.llm.conftest import prose


def union_find(items, pairs):
    up = {i: i for i in items}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def slow_simhash(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_is_as_defined(odd_texts):
    for _, text in odd_texts:
        assert simhash_anchor.simhash64(text) == slow_simhash(text)


def test_simhash_groups_match_all_pairs(spark, make_docs, odd_texts):
    got = simhash_anchor.near_duplicates(make_docs(odd_texts, clashes=True)).collect()
    assert len(got) == len(odd_texts)
    prints = [slow_simhash(t) for _, t in odd_texts]
    nodes = sorted(set(prints))
    root = union_find(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 4])
    least: dict[int, int] = {}
    for (i, _), p in zip(odd_texts, prints):
        if i is not None:
            least[root[p]] = min(least.get(root[p], 1 << 60), i)
    want = sorted((i or -1, p, least.get(root[p]) or -1) for (i, _), p in zip(odd_texts, prints))
    assert sorted((r.doc_id or -1, r.fp % (1 << 64), r.component_id or -1) for r in got) == want


def test_anchors_lose_no_pair_within_four_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63 - 1, size=500)
    for f in x:
        y = int(f) % (1 << 64)
        for b in rng.choice(64, 4, replace=False):
            y ^= 1 << int(b)
        g = np.array([y], np.uint64).view(np.int64)
        a, r, _ = simhash_anchor.anchor_rows(np.array([f]))
        c, s, _ = simhash_anchor.anchor_rows(g)
        assert set(a[r == 0]) & set(c[s == 1])


@pytest.mark.parametrize("most_homes", [3, 2048])
def test_links_of_a_dense_cluster_join_it(spark, most_homes):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(60)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash_anchor.links(spark.createDataFrame([(p,) for p in signed], "fp long"), most_homes=most_homes).collect()
    assert all((r.u % (1 << 64) ^ r.v % (1 << 64)).bit_count() <= 4 for r in got)
    fast = union_find(signed, [(r.u, r.v) for r in got])
    slow = union_find(signed, [(a, b) for a in signed for b in signed if a < b and (a % (1 << 64) ^ b % (1 << 64)).bit_count() <= 4])
    assert fast == slow


def test_components_of_chains_stars_and_nothing(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (200, 201)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    items = sorted({x for p in pairs for x in p})
    assert got == union_find(items, pairs)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_similar_documents_leave_one(spark, make_docs):
    rng = random.Random(3)
    rows = [(i, prose(rng, 200)) for i in range(20)]
    words = rows[0][1].split()
    rows += [(100, rows[0][1]), (101, " ".join([*words[:100], "odd", *words[101:]])), (102, None), (103, " "), (5, rows[5][1]), (None, "keep me")]
    got = simhash_anchor.distinct_documents(make_docs(rows, clashes=True))
    assert got.columns == make_docs(rows, clashes=True).columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [*range(20), 102]
    assert [r.text for r in got.collect() if r.doc_id is None] == ["keep me"]


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng: random.Random, text: str, n: int) -> str:
    out = list(text)
    for _ in range(n if out else 0):
        i, kind = rng.randrange(max(1, len(out))), rng.random()
        out[i : i + (kind < 0.6)] = [rng.choice("abcxyz")] if kind > 0.3 else []
    return "".join(out)


def test_banded_distance_is_exact():
    rng = random.Random(4)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        b = changed(rng, a, rng.randint(0, 4)) if a else "ab"
        k = rng.randint(1, 3)
        assert line_dedup.within(a, b, k) == (edit_distance(a, b) <= k)


def test_line_classes_match_all_pairs(spark, make_docs):
    rng = random.Random(5)
    base = [prose(rng, 8) for _ in range(30)]
    lines = [changed(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(150)] + ["short", "short", "", ""]
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(31)]
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in line_dedup.line_classes(make_docs(docs, clashes=True)).collect()}
    every = {(i, n): x for i, t in docs for n, x in enumerate(t.split("\n"))}
    long = sorted({x for x in every.values() if len(x) >= 20})
    root = union_find(long, [(a, b) for a in long for b in long if a < b and abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= 2])
    first: dict[str, tuple] = {}
    for place in sorted(every):
        if every[place] in root:
            first.setdefault(root[every[place]], place)
    assert got == {p: first[root[x]] if x in root else p for p, x in every.items()}


def test_repeated_lines_go_and_odd_rows_stay(spark, make_docs, odd_texts):
    got = line_dedup.drop_repeated_lines(make_docs(odd_texts, clashes=True))
    rows = [(r.doc_id, r.text, r.n_chars) for r in got.collect()]
    assert {1, 2, 3, 4, 5, 6, 7} <= {r[0] for r in rows}  # nothing of theirs repeats
    assert not {40, 41} & {r[0] for r in rows}  # copies lose all lines
    assert all(n == len(t) for _, t, n in rows if t is not None)
    assert got.columns == make_docs(odd_texts, clashes=True).columns
    assert line_dedup.drop_repeated_lines(make_docs([])).count() == 0


def test_order_minhash_next_documents_and_likeness(spark, make_docs, odd_texts):
    rows = [(i, t) for i, t in odd_texts if i is not None and i != 41]
    got = {r.doc_id: r for r in order_minhash.edit_fingerprints(make_docs(rows, clashes=True)).collect()}
    order = sorted(rows, reverse=True)
    for n, (i, text) in enumerate(order):
        following = order[(n + 1) % len(order)][1] or ""
        text = text or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[40].fingerprint == got[11].fingerprint  # equal texts
    assert len(order_minhash.edit_fingerprints(make_docs(odd_texts)).collect()) == len(odd_texts)
    assert order_minhash.edit_fingerprints(make_docs([])).count() == 0
    one = order_minhash.edit_fingerprints(make_docs([(3, "only one document here")])).first()
    assert one.near_next == 1.0


def test_order_minhash_falls_with_edits_and_sees_order():
    rng = random.Random(6)
    text = prose(rng, 400)
    words = text.split()
    few, many = changed(rng, text, 8), changed(rng, text, 120)
    swapped = " ".join(words[200:] + words[:200])
    f = order_minhash.fingerprint(text)
    near = [order_minhash.likeness(f, order_minhash.fingerprint(x)) for x in (text, few, many, prose(rng, 400))]
    assert near[0] == 1 and near[0] > near[1] > near[2] >= near[3]
    assert order_minhash.likeness(f, order_minhash.fingerprint(swapped)) < 0.9


def test_order_minhash_matches_a_plain_version():
    text = "abcabcabcabcabcabc abc abd"
    k, m = 10, 8
    grams = [text[i : i + k] for i in range(len(text) - k + 1)]
    seen: dict[str, int] = {}
    numbered = []
    for g in grams:
        numbered.append((g, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    assert len(set(numbered)) == len(numbered)
    a, b = order_minhash.fingerprint(text, k, m), order_minhash.fingerprint(text, k, m)
    assert (a == b).all() and len(a) == m
    # dropping one repeat changes occurrence numbers, so some sketch may change, never the length
    assert len(order_minhash.fingerprint(text[3:], k, m)) == m


def test_dense_blocks_join_what_all_pairs_join(spark):
    """A tight family, and texts that are 0.8 like one member each and nearly that like all others."""
    rng = random.Random(8)
    base = prose(rng, 300).split()

    def edit(*changes):
        out = list(base)
        for at, word in changes:
            out[at] = word
        return " ".join(out)

    own = [(10 + i, f"own{i}") for i in range(90)]
    slots = range(120, 290, 6)  # no shingle holds two
    texts = [edit(c) for c in own] + [edit(own[i], *((at, f"far{i}x{at}") for at in rng.sample(slots, 6))) for i in range(0, 90, 3)]
    sets = [simhash_anchor.shingle_set(t, 5) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    for most, block in ((2048, 2048), (8, 2048), (2048, 10)):
        got = [(r.u, r.v) for r in simhash_anchor.text_links(frame, most_homes=most, block_texts=block).collect()]
        assert all(len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v]) for u, v in got)
        assert len(got) < 4 * len(texts)  # a forest for each block, not all pairs
        assert union_find(range(len(texts)), got) == union_find(range(len(texts)), pairs)


def test_two_families_joined_by_one_text(spark):
    """Two families whose texts are under 0.8 of each other, and one text that is 0.8 of both."""
    rng = random.Random(9)
    base = prose(rng, 400).split()

    def edit(places, tag):
        out = list(base)
        for at in places:
            out[at] = f"{tag}{at}"
        return " ".join(out)

    left, right = range(5, 130, 12), range(205, 330, 12)  # each takes 5 shingles at 11 places
    texts = [edit([*left, 140 + 6 * i], f"x{i}") for i in range(25)] + [edit([*right, 340 + 2 * i], f"y{i}") for i in range(25)] + [edit([], "z")]
    sets = [simhash_anchor.shingle_set(t, 5) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    for block in (2048, 7):
        got = [(r.u, r.v) for r in simhash_anchor.text_links(frame, block_texts=block).collect()]
        assert union_find(range(len(texts)), got) == union_find(range(len(texts)), pairs)


def test_recall_of_near_copies_against_all_pairs(spark):
    """Pairs planted at similarities from 0.8 to 0.95 among texts that are not alike."""
    rng = random.Random(10)
    texts = []
    for i in range(400):
        words = prose(rng, 200).split()
        texts.append(" ".join(words))
        n = rng.randint(1, 4)
        for at in rng.sample(range(2, 198, 6), n):
            words[at] = f"w{i}x{at}"
        texts.append(" ".join(words))
    got = {(min(r.u, r.v), max(r.u, r.v)) for r in simhash_anchor.text_links(spark.createDataFrame(list(enumerate(texts)), "node long, text string")).collect()}
    sets = [simhash_anchor.shingle_set(t, 5) for t in texts]
    want = {(i, i + 1) for i in range(0, 800, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    assert got <= want and len(want) > 350
    assert len(got) >= 0.9 * len(want)


def test_equal_short_lines_are_a_class(spark, make_docs, tmp_path):
    from chronolock.llm import registry

    make_docs([(1, "Les.\n\nLes.\nLess."), (2, "Les.\nonly here"), (3, "")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.copies, r.kept) for r in registry.op1_line_dedup(spark, str(tmp_path)).collect()}
    les, blank = (1, 0, 3), (1, 1, 2)
    assert got == {(1, 0): (*les, True), (1, 1): (*blank, True), (1, 2): (*les, False), (1, 3): (1, 3, 1, True), (2, 0): (*les, False), (2, 1): (2, 1, 1, True), (3, 0): (*blank, False)}


def test_different_texts_of_one_id_lose_nothing_of_their_own(spark, make_docs):
    shared, other, third = "a line that two documents share here", "a wholly different line of its own", "one more line that nobody else has"
    got = line_dedup.drop_repeated_lines(make_docs([(0, shared), (1, shared), (1, other), (1, other), (2, f"{third}\n{shared}"), (2, third + " no")], clashes=True)).select("doc_id", "text").collect()
    left = sorted((r.doc_id, r.text) for r in got)
    assert (0, shared) in left and left.count((1, other)) == 2 and not any(r == (1, shared) for r in left)
    assert sum(third in t for _, t in left) >= 1 and all(shared not in t for i, t in left if i)
    rng = random.Random(3)
    a, b, c = (prose(rng, 80) for _ in range(3))
    docs = make_docs([(5, a), (5, b), (5, b), (6, b + " end"), (7, c), (7, a), (None, a)], clashes=True)
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in simhash_anchor.distinct_documents(docs).select("doc_id", "text").collect())
    assert kept == sorted([(False, 5, a), (False, 5, b), (False, 7, c), (True, 0, a)])
