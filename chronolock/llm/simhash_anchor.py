"""SimHash near-duplicates by anchor-point covering.

:func:`near_duplicates` links fingerprints within 4 bits, all of them.  :func:`distinct_documents`
links documents whose shingle sets have a similarity of 0.8 or more: too many bits apart for one
fingerprint of 64, so it covers four, and compares whole shingle sets within the families that meet.

A fingerprint of 64 bits is cut into three segments.  Fingerprints that differ in at most 4 bits
differ in at most one bit of some segment.  In each segment the anchors are a covering code: the
first 15 bits hold a word of the perfect Hamming code, the others are free, so every segment value
lies within covering radius 1 of an anchor.  A fingerprint has its home at that anchor and is
replicated to every anchor within radius 1 plus the threshold 1; two fingerprints whose segments
differ by one bit therefore meet at the home anchor of either.  Each anchor compares homes with
replicas on all 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolock.llm.codepoints import mixed
from chronolock.functions.ranking import counted
from chronolock.llm.common import doc_texts, parts, settle, slices
from chronolock.llm.components import components

SEED = 42
BITS = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))
CODED = 15
#: Homes of one anchor that a task compares at a time; a hotter anchor is dealt to several tasks.
HOMES = 2048
#: Fingerprints of a text where similarity is that of shingle sets.
PLANES = 4
#: Texts, and their shingles, that a task compares at a time; a larger family is dealt to several.
BLOCK_TEXTS, BLOCK_SHINGLES = 2048, 4_000_000
_PLACES = np.arange(8, dtype=np.int64) * 256
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1).astype(np.int64)


def simhash64(text: str | None, words: int = 4) -> int:
    """The unsigned fingerprint of a text; 0 where it has no word.

    A-Z become lower case, words are runs of anything but ASCII white space, shingles are ``words``
    words joined by spaces (all words of a shorter text), and each repeat counts.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) < words:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    n = len(found) - words + 1
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip((end - size)[:n].tolist(), end[words - 1 :].tolist())])
    by = np.bincount((np.frombuffer(raw, np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits(2 * (by @ _BYTE_BITS) > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) for every row; null text as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.fromiter((simhash64(t, words) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, fp long")


def _planes(text: str, words: int, count: int) -> list[int]:
    """How many different shingles, and ``count`` fingerprints from one hash of each: its own bits, then
    bits mixed anew."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return [0] * (1 + count)
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter({digest(joined[a:b], SEED) for a, b in zip((end - size)[:n].tolist(), end[min(words, len(found)) - 1 :].tolist())}, np.uint64)
    out = [len(h)]
    for k in range(count):
        one = h if not k else mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        by = np.bincount((one.astype(">u8").view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256)
        out.append(int.from_bytes(np.packbits(2 * (by @ _BYTE_BITS) > len(h)).tobytes(), "big"))
    return out


def _masks(width: int) -> tuple[list[int], list[np.ndarray]]:
    """For each syndrome of the coded bits: what takes a segment to its home, and to its replicas."""
    free = [1 << i for i in range(CODED, width)]
    home, near = [], []
    for s in range(16):
        to = {0: [0] if s == 0 else [], 1: [] if s == 0 else [1 << (s - 1)], 2: []}
        if s:
            to[2] = [1 << (a - 1) | 1 << (b - 1) for a, b in combinations(range(1, 16), 2) if a ^ b == s]
        home.append(0 if s == 0 else 1 << (s - 1))
        near.append(np.array([m | sum(f) for d, ms in to.items() for m in ms for k in range(3 - d) for f in combinations(free, k)], np.int64))
    return home, near


def anchor_rows(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor (24 bits), role (0 home, 1 replica) and place in ``fp`` of all rows that fingerprints
    send out."""
    bits = fp.view(np.uint64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k, (low, width) in enumerate(SEGMENTS):
        seg = ((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        syndrome = np.zeros(len(seg), np.int64)
        for p in range(1, CODED + 1):
            syndrome ^= ((seg >> (p - 1)) & 1) * p
        home, near = _masks(width)
        tag = np.int64(k) << np.int64(22)
        for s in range(16):
            own = np.flatnonzero(syndrome == s)
            if not len(own):
                continue
            out.append((seg[own] ^ home[s] | tag, np.zeros(len(own), np.int8), own))
            out.append(((seg[own][:, None] ^ near[s] | tag).ravel(), np.ones(len(own) * len(near[s]), np.int8), np.repeat(own, len(near[s]))))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64))


def _forest(homes: np.ndarray, near: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of each node to the smallest of those that ``homes`` and ``near`` join by ``bits`` or fewer.

    The first row of either has nodes, the others prints, whose differing bits add up."""
    one, two = homes[1:].view(np.uint64), near[1:].view(np.uint64)
    apart = np.bitwise_count(one[0][:, None] ^ two[0][None, :])
    for x, y in zip(one[1:], two[1:]):
        apart += np.bitwise_count(x[:, None] ^ y[None, :])
    hit = apart <= bits
    cols = np.flatnonzero((hit & (homes[0][:, None] != near[0][None, :])).any(0))
    if not len(cols):
        return []
    hit = hit[:, cols]
    label = np.arange(homes.shape[1])
    if len(label) > 1 and (hit.sum(0) > 1).any():
        while True:
            low = np.where(hit, label[:, None], len(label)).min(0)
            new = np.minimum(label, np.where(hit, low[None, :], len(label)).min(1))
            if (new == label).all():
                break
            label = new
    node, group = np.concatenate([homes[0], near[0][cols]]), np.concatenate([label, label[hit.argmax(0)]])
    least = np.full(len(label), np.iinfo(np.int64).max)
    np.minimum.at(least, group, node)
    return [(node, least[group])]


def _compare(bits: int, prints: list[int]):
    """Links of each block of ``key, salt, node, ...``; ``prints`` are the columns with fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, homes = None, np.zeros((1 + len(prints), 0), np.int64)
        for b in batches:
            key, salt = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in [2, *prints]])
            anchor = key >> 1
            cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(anchor)]):
                if s == e:
                    continue
                if block != (anchor[s], salt[s]):
                    block, homes = (anchor[s], salt[s]), rows[:, :0]
                mid = s + int(np.searchsorted(key[s:e] & 1, 1))
                if mid > s:
                    homes = np.concatenate([homes, rows[:, s:mid]], axis=1)
                step = max(1, (1 << 21) // max(1, homes.shape[1]))  # two million pairs at a time
                for at in range(mid, e if homes.shape[1] else mid, step):
                    found += _forest(homes, rows[:, at : min(e, at + step)], bits)
            if found:
                u, v = (np.concatenate(x) for x in zip(*found))
                keep = u != v
                yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

    return run


def _deal(rows: DataFrame, most_homes: int) -> DataFrame:
    """``rows`` (``key`` is twice the anchor, plus the role) by anchor and sorted, homes first.  An
    anchor with more than ``most_homes`` homes is dealt to several tasks by its homes, and its replicas
    go to each of them."""
    anchor = F.shiftright("key", 1)
    hot = rows.where(F.col("key").bitwiseAND(1) == 0).groupBy(anchor.alias("hot_anchor")).agg(F.count("*").alias("n")).where(F.col("n") > most_homes).select("hot_anchor", F.ceil(F.col("n") / most_homes).cast("int").alias("deals"))
    hot = settle(hot, "hot-anchors")
    deals = F.coalesce("deals", F.lit(1))
    salt = F.when(F.col("key").bitwiseAND(1) == 0, F.array(F.pmod(F.xxhash64("node"), deals).cast("int"))).otherwise(F.sequence(F.lit(0), deals - 1))
    dealt = rows.withColumn("salt", F.lit(0)) if hot.isEmpty() else rows.join(hot, anchor == F.col("hot_anchor"), "left").withColumn("salt", F.explode(salt))
    order = ["key", "salt", "node", *[c for c in rows.columns if c not in ("key", "node")]]
    return dealt.select(*order).repartition(parts(rows.sparkSession), F.shiftright("key", 1), "salt").sortWithinPartitions(F.shiftright("key", 1), "salt", "key")


def _hooked(found: DataFrame) -> DataFrame:
    """Links with the closure of ``found(u, v)``, where v is the smallest node of a block: of the
    smallest nodes that a node is linked to (as many as its blocks, at most) the smallest keeps it, and
    the others are linked to that one, so that blocks of one family say the same."""
    by = found.groupBy("u").agg(F.collect_set("v").alias("vs")).withColumn("v", F.array_min("vs"))
    own = F.array(F.struct("u", "v"))
    rest = F.transform(F.filter("vs", lambda x: x != F.col("v")), lambda x: F.struct(x.alias("u"), F.col("v").alias("v")))
    return by.select(F.explode(F.concat(own, rest)).alias("e")).select("e.u", "e.v").distinct()


def links(prints: DataFrame, bits: int = BITS, most_homes: int = HOMES) -> DataFrame:
    """Links ``(u, v)`` between different fingerprints (column ``fp``, one row each) whose closure is
    that of all pairs within ``bits`` (5 or fewer); a link may go by way of others that join it."""
    if bits >= 2 * len(SEGMENTS):
        raise ValueError(f"bits must be under {2 * len(SEGMENTS)}")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            a, r, at = anchor_rows(fp)
            yield pa.RecordBatch.from_arrays([pa.array((a << 1 | r).astype(np.int32)), pa.array(fp[at])], ["key", "node"])

    rows = prints.select("fp").mapInArrow(spread, "key int, node long")
    return _hooked(_deal(rows, most_homes).mapInArrow(_compare(bits, [2]), "u long, v long"))


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = BITS) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id``: the smallest doc_id that links of ``bits`` or fewer
    differing bits reach.

    Every row of ``docs`` gives one row, repeats too.  Texts without a word (null, empty, white
    space) have fingerprint 0 and link like any other.  Ties don't arise: the smallest id names the
    group.  A null doc_id names no group, unless no other id is in it.  An empty table gives none.
    """
    prints = settle(fingerprints(docs, words), "fingerprints")
    one = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    joined = components(links(one, bits))
    named = one.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = settle(named, "roots")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by = named.join(least, "root").select("fp", "component_id")
    return prints.join(by, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str, words: int) -> set[int]:
    """64-bit hashes of the different shingles of a text, as :func:`simhash64` cuts them."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(found) - words + 1)
    return {xxhash.xxh64_intdigest(b" ".join(found[i : i + words]), SEED) for i in range(n)} if found else set()


def set_links(node: np.ndarray, root: np.ndarray, size: np.ndarray, flat: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between ``node`` whose sets have a similarity of ``least`` or more, with the closure of all
    such pairs; nodes of one ``root`` count as joined.  ``flat`` has the sets one after another.

    It spreads from set to set: an inverted index of those not reached yet counts what each shares with
    all of them at once, and is built anew as they get fewer.
    """
    n = len(node)
    at = np.append(0, np.cumsum(size))
    owner = np.repeat(np.arange(n), size)
    code = np.unique(flat, return_inverse=True)[1].ravel()
    kin: dict[int, list[int]] = {}
    for i, r in enumerate(root.tolist()):
        kin.setdefault(r, []).append(i)
    waiting, left, indexed, out = np.ones(n, bool), n, 2 * n + 1, []
    first, lists = np.zeros(0, np.int64), owner
    for seed in range(n):
        if not waiting[seed]:
            continue
        queue = list(kin[int(root[seed])])
        waiting[queue] = False
        left -= len(queue)
        while queue and left:
            if left < indexed // 2:
                keep = waiting[owner]
                held = code[keep]
                order = np.argsort(held, kind="stable")
                first, lists, indexed = np.searchsorted(held[order], np.arange(int(code.max(initial=0)) + 2)), owner[keep][order], left
            i = queue.pop()
            own = code[at[i] : at[i + 1]]
            count = first[own + 1] - first[own]
            place = np.repeat(first[own] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            shared = np.bincount(lists[place], minlength=n)
            for j in np.flatnonzero(waiting & (shared >= least * (size[i] + size - shared))).tolist():
                if waiting[j]:
                    out.append((int(node[i]), int(node[j])))
                    more = kin[int(root[j])]
                    waiting[more] = False
                    left -= len(more)
                    queue += more
    return out


def _verify(words: int, least: float):
    """Links of each block of ``family, a, b, node, root, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: tuple | None = None
        held: list[tuple[int, int, np.ndarray]] = []

        def close() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            node, root = (np.array([x[i] for x in held], np.int64) for i in range(2))
            size = np.array([len(x[2]) for x in held], np.int64)
            return set_links(node, root, size, np.concatenate([x[2] for x in held]), least)

        for b in batches:
            found: list[tuple[int, int]] = []
            for *key, node, root, text in zip(*(b.column(i).to_pylist() for i in range(6))):
                if tuple(key) != block:
                    found += close()
                    block, held = tuple(key), []
                own = shingle_set(text, words)
                held.append((node, root, np.fromiter(own, np.uint64, len(own))))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], ["u", "v"])
        last = close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in last], pa.int64()) for i in range(2)], ["u", "v"])

    return run


def text_links(texts: DataFrame, words: int = 5, similarity: float = 0.8, planes: int = PLANES, most_homes: int = HOMES, block_texts: int = BLOCK_TEXTS, block_shingles: int = BLOCK_SHINGLES, broadcast_ids: int = 100_000) -> DataFrame:
    """Links ``(u, v)`` between the nodes of ``texts(node, text)``, one row each, with ``similarity`` or
    more.

    At 0.8 a fingerprint of 64 bits differs in 10 bits, so each text has ``planes`` of them, all
    covered by anchors.  Blocks of an anchor emit a forest of what is near in two other planes
    (2.6 standard deviations beyond the mean at ``similarity``), which makes families.  Within a family
    whole shingle sets are compared, and a forest of the links comes out: never all pairs.  A family
    beyond ``block_texts`` texts or ``block_shingles`` shingles is dealt to blocks; then the first texts
    of what has joined are compared; only a family that is still apart has its blocks held against
    each other, two at a time.
    """
    return _family_links(settle(_printed(texts, words, planes), "planes"), texts, words, similarity, most_homes, block_texts, block_shingles, broadcast_ids)


def _printed(texts: DataFrame, words: int, planes: int) -> DataFrame:
    """``node, sha, n`` (different shingles) and the fingerprints ``p0, p1, ...`` of ``texts(node, text)``."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [_planes(t, words, planes) for t in b.column(1).to_pylist()]
            p = np.array([x[1:] for x in made], np.uint64).reshape(-1, planes).view(np.int64)
            n = pa.array([x[0] for x in made], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n, *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(planes))], ["node", "sha", "n", *(f"p{k}" for k in range(planes))])

    texts = texts.select("node", "text", F.unhex(F.sha2("text", 256)).alias("sha"))
    return texts.mapInArrow(prints, "node long, sha binary, n long, " + ", ".join(f"p{k} long" for k in range(planes)))


def _family_links(found: DataFrame, texts: DataFrame, words: int, similarity: float, most_homes: int = HOMES, block_texts: int = BLOCK_TEXTS, block_shingles: int = BLOCK_SHINGLES, broadcast_ids: int = 100_000) -> DataFrame:
    """The links of :func:`text_links` between the nodes of ``found``, which :func:`_printed` made."""
    names = [c for c in found.columns if c.startswith("p")]
    planes = len(names)
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = math.ceil(128 * angle + 2.6 * math.sqrt(128 * angle * (1 - angle)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, *own = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1 + planes))
            for k in range(planes):
                a, r, at = anchor_rows(own[k])
                yield pa.RecordBatch.from_arrays([pa.array(((a | k << 24) << 1 | r).astype(np.int32)), pa.array(node[at]), *(pa.array(own[(k + x) % planes][at]) for x in (1, 2))], ["key", "node", "one", "two"])

    rows = found.select("node", *names).mapInArrow(spread, "key int, node long, one long, two long")
    family = components(_hooked(_deal(rows, most_homes).mapInArrow(_compare(bits, [3, 4]), "u long, v long"))).select(F.col("node").alias("member"), F.col("root").alias("family"))
    sized = family.join(found.select("node", "n"), F.col("member") == F.col("node"))
    cuts = F.ceil(F.greatest(F.count("*") / F.lit(block_texts), F.sum("n") / F.lit(block_shingles))).cast("int")
    sized = sized.groupBy("family").agg(cuts.alias("cuts"))
    family = settle(family.join(sized.withColumnRenamed("family", "of"), F.col("family") == F.col("of")).select("member", "family", "cuts"), "families")
    count, most = family.agg(F.count("*"), F.max("cuts")).first()
    held = texts.join(F.broadcast(family) if count <= broadcast_ids else family, F.col("node") == F.col("member")).select("node", "text", "family", "cuts")
    held = held.withColumn("part", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))

    def blocks(rows: DataFrame, a: Column, b: Column, root: str) -> DataFrame:
        rows = rows.select("family", a.alias("a"), b.alias("b"), "node", F.col(root).alias("root"), "text")
        rows = rows.repartition(parts(texts.sparkSession), "family", "a", "b").sortWithinPartitions("family", "a", "b")
        return rows.mapInArrow(_verify(words, similarity), "u long, v long")

    if (most or 0) <= 1:
        return settle(blocks(held, F.col("part"), F.col("part"), "node"), "text-links")
    held = settle(held, "family-texts")
    out = settle(blocks(held, F.col("part"), F.col("part"), "node"), "text-links")
    for whole in (False, True):
        joined = components(out).select(F.col("node").alias("id"), "root")
        apart = held.where("cuts > 1").join(joined, F.col("node") == F.col("id"), "left").withColumn("root", F.coalesce("root", "node"))
        apart = settle(apart.select("node", "text", "family", "cuts", "part", "root"), "parted")
        mixed_families = apart.groupBy("family").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.sum((F.col("node") == F.col("root")).cast("int")).alias("roots")).where("x < y").select(F.col("family").alias("of"), "roots")
        apart = apart.join(mixed_families, F.col("family") == F.col("of"))
        if whole:
            two = apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).where("other <> part")
            more = blocks(two, F.least("part", "other"), F.greatest("part", "other"), "root")
        else:
            deal = F.pmod(F.xxhash64("node"), F.ceil(F.col("roots") / F.lit(block_texts))).cast("int")
            more = blocks(apart.where("node = root"), deal, deal, "root")
        out = settle(out.unionByName(more), "text-links")
    return out


def distinct_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, same columns.

    Equal texts (by SHA-256) are one node, and texts that :func:`text_links` links are a group, in
    chains too; the smallest doc_id of a group stays.  Different texts of one doc_id are documents of their
    own, in order of their hashes.  Texts without a word (null, empty, white space) are
    near-duplicates of each other.  Texts of any length are compared whole.  Rows without an id stay
    as they are.  An empty table gives none; columns of ``docs`` may have any names.
    """
    own = F.col("doc").getField
    known = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("node"))  # no name of docs clashes
    if not known.groupBy("node").count().where("count > 1").isEmpty():
        # one row of each id and text; its place in the order of both is the node
        text = F.coalesce(own("text"), F.lit(""))
        one = known.groupBy(F.struct("node", F.sha2(text, 256).alias("sha")).alias("key")).agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
        known = settle(counted(one, [], "key", more=(F.first("doc").alias("doc"),)).select("doc", F.col("below").alias("node")), "one-each")
    texts = known.select("node", F.coalesce(own("text"), F.lit("")).alias("text"))
    found = settle(_printed(texts, words, PLANES), "planes")
    first = found.groupBy("sha").agg(F.min("node").alias("first"), F.count("*").alias("copies")).where("copies > 1").select(F.col("sha").alias("of"), "first")
    later = settle(found.select("node", "sha").join(first, F.col("sha") == F.col("of")).where("node <> first").select(F.col("node").alias("gone_id")), "copies")
    found = found.join(later, F.col("node") == F.col("gone_id"), "left_anti")
    joined = components(_family_links(found, texts, words, similarity))
    gone = later.unionByName(joined.where("node <> root").select(F.col("node").alias("gone_id")))
    return known.join(gone, F.col("node") == F.col("gone_id"), "left_anti").select("doc.*").unionByName(docs.where("doc_id is null"))
