"""Best-fit packing of documents into sequences, improved by swaps.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt evenly to shards; each
shard packs by best fit, largest first, then a local search exchanges pieces between underfull bins.
The bins that stay underfull are taken apart and packed once more, across shards.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolock.llm.common import doc_texts, settle, slices
from chronolock.llm.pretokens import encoder, frequent, token_ids
from chronolock.llm.token_counts import default_path

#: Pieces of a shard, at most about so many; memory of a task is bounded by it.
SHARD = 16_384
END = 2


def pieces(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = END, sample_rows: int = 3000) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document.

    A document is its ids and ``end_id``; one longer than ``capacity`` is cut so that all pieces but
    the first have ``capacity`` ids.  A null or empty text is the end id alone.
    """
    path = path or default_path()
    texts = doc_texts(docs)
    known = texts.sparkSession.sparkContext.broadcast(frequent(texts, path, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in slices(batches):
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), token_ids(b.column(1).to_pylist(), encode, known.value)):
                raw, n = ids.astype("<u4").tobytes() + end_id.to_bytes(4, "little"), len(ids) + 1
                first = n % capacity or capacity
                for k, (s, e) in enumerate(zip([0, *range(first, n, capacity)], [*range(first, n, capacity), n])):
                    rows.append((doc, k, s, e - s, zlib.crc32(memoryview(raw)[4 * s : 4 * e])))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes into ``sizes``: each piece, largest first, goes where the least room is left."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # room and bin, sorted
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > size:
            insort(rooms, (room - size, b))
    return bins


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int, rounds: int = 30) -> list[list[int]]:
    """Exchange pieces between underfull bins while the squared fill grows; bins that empty go.

    Moves, one-for-one and two-for-one exchanges bring pieces from the emptier of two bins to the
    fuller one.  It ends when no pair gains, when as few bins are left as the sum of sizes needs, or
    after ``rounds`` rounds.  What a bin could gain by is looked up among all pieces at once, and two
    bins that gained nothing are not held against each other again until one of them changes.
    """
    size = sizes.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    whole = [b for b, f in zip(bins, fill) if f >= capacity]
    held = [b for b, f in zip(bins, fill) if f < capacity]
    if not held:
        return whole
    room = np.array([capacity - f for f in fill if f < capacity])
    own = np.concatenate([np.array(b, np.int64) for b in held])
    order = np.argsort(sizes[own], kind="stable")
    slot = dict(zip(own[order].tolist(), range(len(own))))
    least = sizes[own][order].astype(np.int64)  # sizes of the open pieces, from the smallest, and their bins
    owner = np.repeat(np.arange(len(held)), [len(b) for b in held])[order]
    changed, checked, place = np.zeros(len(held), np.int64), np.full(len(held), -1), np.full(len(held), -1)
    clock = 0

    def takers(j: int, after: int) -> list[int]:
        """Bins behind place ``after`` and before that of ``j`` that gain from a piece or two of ``j``, in order."""
        each = [size[x] for x in held[j]]
        given = {*each, *(y + z for a, y in enumerate(each) for z in each[a + 1 :])}
        s = np.array([*sorted(given), 4 * capacity])
        top = np.searchsorted(least, s[-2])
        at = owner[:top]
        hit = np.zeros(len(held), bool)
        hit[at[s[np.searchsorted(s, least[:top], side="right")] - least[:top] <= room[at]]] = True
        hit |= room >= min(each)
        hit &= (place > after) & (place < place[j])
        if changed[j] <= checked[j]:
            hit &= changed > checked[j]
        found = np.flatnonzero(hit)
        return found[np.argsort(place[found])].tolist()

    open_ = list(range(len(held)))
    need = -(-int((capacity - room).sum()) // capacity)
    for _ in range(rounds):
        if len(open_) <= need:
            break
        open_.sort(key=lambda b: room[b])
        place[:] = -1
        place[open_] = np.arange(len(open_))
        start, passed = clock, []
        for j in reversed(open_[1:]):  # give away the emptiest first
            if changed[j] <= checked[j] and clock <= checked[j]:
                continue
            turn, todo = clock, takers(j, -1)
            while todo:
                i = todo.pop(0)
                free, giver, taker = int(room[i]), held[j], held[i]
                if free > room[j]:
                    passed.append(j)
                    continue
                best, change = 0, None
                mine = sorted((size[x], x) for x in taker)
                for y in giver:
                    if best < size[y] <= free:
                        best, change = size[y], ([], [y])
                    at = bisect_left(mine, (size[y] - free, -1))
                    if at < len(mine) and best < size[y] - mine[at][0] <= free:
                        best, change = size[y] - mine[at][0], ([mine[at][1]], [y])
                if best < free and len(giver) > 1:
                    pairs = sorted(giver, key=lambda x: size[x])
                    for a, y in enumerate(pairs):
                        for z in pairs[a + 1 :]:
                            two = size[y] + size[z]
                            at = bisect_left(mine, (two - free, -1))
                            if at < len(mine) and best < two - mine[at][0] <= free:
                                best, change = two - mine[at][0], ([mine[at][1]], [y, z])
                if change:
                    out, into = change
                    held[i] = [x for x in taker if x not in out] + into
                    held[j] = [x for x in giver if x not in into] + out
                    room[i], room[j] = room[i] - best, room[j] + best
                    owner[[slot[x] for x in into]] = i
                    owner[[slot[x] for x in out]] = j
                    clock += 1
                    changed[i] = changed[j] = clock
                    todo = takers(j, place[i]) if held[j] else []
            # takers passed before a change have not seen what j holds now
            checked[j] = clock if turn == clock else -1
        if clock == start:
            break
        clock += 1
        changed[passed] = clock  # their turn was over before the bins that are emptier now had theirs
        whole += [held[b] for b in open_ if not room[b]]
        open_ = [b for b in open_ if room[b] and held[b]]
        need = -(-int((capacity - room[open_]).sum()) // capacity)
    return whole + [held[b] for b in open_]


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, shard long, bin long, offset long, room long"


def _pack(capacity: int, packed: bool):
    """Bins of a shard, from best fit, or from the bins that its pieces are in if they are ``packed``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32", "number"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy()
        start = [list(x) for x in pdf.groupby("number", sort=True).indices.values()] if packed else best_fit(sizes, capacity)
        bins = improve(start, sizes, capacity)
        order = np.concatenate([np.array(b) for b in bins])
        count = np.array([len(b) for b in bins])
        out = pdf.iloc[order].copy()
        out["bin"] = np.repeat(np.arange(len(bins)), count)
        out["offset"] = out.groupby("bin")["length"].cumsum() - out["length"]
        out["room"] = capacity - out.groupby("bin")["length"].transform("sum")
        return out[["doc_id", "piece", "start", "length", "ids_crc32", "shard", "bin", "offset", "room"]]

    return run


def pack(cut: DataFrame, capacity: int = 1024, shard: int = SHARD) -> DataFrame:
    """``sequence_id`` and ``offset`` for every row of :func:`pieces`; full pieces stand alone.

    Rows are dealt to shards by their place, so that repeated rows and ids spread; a shard holds
    about ``shard`` pieces whatever the input.  Bins that stay underfull are dealt anew, whole, and
    exchange pieces with those of other shards; that never adds a bin.  Ties in length fall by id.  An
    empty table gives an empty one.
    """
    cut = settle(cut, "pieces").withColumn("row", F.monotonically_increasing_id())
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = cut.where(F.col("length") >= capacity).select(*columns, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    small = cut.where(F.col("length") < capacity)
    n = max(1, -(-small.count() // shard))
    dealt = small.select(*columns, F.pmod(F.xxhash64("row"), F.lit(n)).alias("shard"), F.col("row").alias("number"))
    first = settle(dealt.groupBy("shard").applyInPandas(_pack(capacity, False), _PACKED), "packed")
    base = F.lit(1 << 60)
    number = F.col("shard") * F.lit(1 << 24) + F.col("bin")
    done = first.where(F.col("room") <= capacity // 128)
    rest = first.where(F.col("room") > capacity // 128)
    m = max(1, -(-rest.count() // shard))
    rest = rest.select(*columns, F.pmod(F.xxhash64("shard", "bin"), F.lit(m)).alias("shard"), number.alias("number"))
    again = rest.groupBy("shard").applyInPandas(_pack(capacity, True), _PACKED)
    return full.unionByName(done.select(*columns, (base + number).alias("sequence_id"), "offset")).unionByName(again.select(*columns, (base * 2 + number).alias("sequence_id"), "offset"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = END, shard: int = SHARD) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens: :func:`pieces`, then :func:`pack`.

    Null and empty texts are one piece of the end id; repeated rows and null ids are packed like any
    other row; other columns of ``docs`` are not read.
    """
    return pack(pieces(docs, path, capacity, end_id), capacity, shard)
