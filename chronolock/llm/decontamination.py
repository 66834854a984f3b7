"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping windows.  A region of a document within ``edits`` of a
window shares at least ``len - q + 1 - q * edits`` character q-grams with it, on diagonals (place in
the document less place in the window) that lie within ``edits`` of each other.  Shared q-grams are
counted in overlapping bands of diagonals; bands that reach the bound are verified by banded
alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolock.llm.codepoints import prefix, spans
from chronolock.llm.common import doc_texts, require, runs, slices

WINDOW = 80
STRIDE = 40
Q = 12
RATE = 1 / 16
#: Items shorter than this (normalised) are matched whole and without edits; those under ``Q``
#: characters only where a document has nothing else.
EXACT = 40
BAND = 16
#: Characters of benchmark items that are indexed and broadcast at a time.
BLOCK = 4_000_000
#: Meetings of runs, and windows to align, at a time.
CHUNK = 1 << 18
#: Between texts; no code point, so no text has it.
BREAK = 0x110001
_made: dict = {}


def _normal() -> np.ndarray:
    """Each code point as lower case; what is neither letter nor number as a space."""
    if "normal" not in _made:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalnum():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _made["normal"] = out
    return _made["normal"]


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another with a break after each, runs of spaces as one; the place in the
    joined texts of each character; and where each text starts there (a place more at the end)."""
    joined = " ".join(texts) + " "
    cp = _normal()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
    cp[starts[1:] - 1] = BREAK
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 32) | ((cp[:-1] != 32) & (cp[:-1] != BREAK))
    return cp[keep], np.flatnonzero(keep), starts


@dataclass
class Index:
    """Windows of benchmark items and their q-grams."""

    items: np.ndarray  # item id of each window
    chars: np.ndarray  # all windows one after another
    begin: np.ndarray  # where each window starts in chars; a place more at the end
    budget: np.ndarray  # edits allowed in each window
    q: int
    keys: np.ndarray  # sorted hashes of q-grams
    first: np.ndarray  # where the runs of each key begin; one more at the end
    window: np.ndarray  # of each run: places of one key that follow each other in a window
    offset: np.ndarray  # its first place
    length: np.ndarray
    bits: np.ndarray  # by the low bits of a hash, whether a key has them
    short: dict[bytes, list[int]]  # items under q characters, by their text


def _trimmed(cp: np.ndarray) -> np.ndarray:
    return cp[int(len(cp) > 0 and cp[0] == 32) : len(cp) - int(len(cp) > 1 and cp[-1] == 32)]


def _nothing_else(texts: list[str], text: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """As :func:`search`, of texts that are an item under ``q`` characters and nothing else."""
    out: list[tuple[int, int, int, int, int, int]] = []
    if not index.short:
        return out
    end = np.flatnonzero(text == BREAK)
    start = np.append(0, end[:-1] + 1)
    for d in np.flatnonzero(end - start <= index.q + 1).tolist():
        out += [(d, x, 1, 0, 0, len(texts[d])) for x in index.short.get(_trimmed(text[start[d] : end[d]]).tobytes(), ())]
    return out


def build(items: list[tuple[int, str]], window: int = WINDOW, stride: int = STRIDE, q: int = Q, rate: float = RATE, exact: int = EXACT) -> Index:
    own, pieces, budget, short = [], [], [], {}
    for item, text in items:
        cp, _, _ = normalised([text])
        cp = cp[:-1]
        cp = _trimmed(cp)
        if len(cp) < q:
            if len(cp):
                short.setdefault(cp.tobytes(), []).append(item)
            continue
        last = max(0, len(cp) - window)
        for s in sorted({*range(0, last + 1, stride), last}):
            piece = cp[s : s + window]
            own.append(item)
            pieces.append(piece)
            budget.append(min(int(rate * len(piece)), (len(piece) - q) // q) if len(cp) >= exact else 0)
    begin = np.append(0, np.cumsum([len(p) for p in pieces])).astype(np.int64)
    chars = np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)
    n = np.diff(begin) - q + 1
    w = np.repeat(np.arange(len(pieces)), n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = begin[:-1][w] + offset if len(pieces) else np.zeros(0, np.int64)
    h = spans(prefix(chars), at, at + q) if len(at) else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    h, w, offset = h[order], w[order], offset[order]
    run = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(h) else np.zeros(0, np.int64)
    length = np.diff(np.append(run, len(h)))
    keys, first = np.unique(h[run], return_index=True)
    bits = np.zeros(1 << 20, bool)
    bits[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return Index(np.array(own, np.int64), chars, begin, np.array(budget, np.int64), q, keys, np.append(first, len(run)), w[run], offset[run], length, bits, short)


def align(text: np.ndarray, index: Index, window: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window and band of ``width`` diagonals from ``low``: the fewest edits that turn the
    window into a stretch of ``text`` there, and where that stretch ends."""
    edits, ends = np.zeros(len(window), np.int64), np.zeros(len(window), np.int64)
    size = index.begin[window + 1] - index.begin[window]
    far = 1 << 20
    k = np.arange(width)
    for m in np.unique(size).tolist():
        own = np.flatnonzero(size == m)
        for at in range(0, len(own), 4096):
            o = own[at : at + 4096]
            d = np.zeros((len(o), width), np.int32)
            for i in range(m):
                t = low[o][:, None] + k + i
                inside = (t >= 0) & (t < len(text))
                other = np.where(inside, text[np.clip(t, 0, len(text) - 1)], BREAK)
                new = d + (other != index.chars[index.begin[window[o]] + i][:, None])
                new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
                d = np.minimum.accumulate(new - k, axis=1) + k
                d = np.minimum(d, far).astype(np.int32)
            best = d.argmin(1)
            edits[o], ends[o] = d[np.arange(len(o)), best], low[o] + best + m
    return edits, ends


def search(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """Text, item, windows found, fewest edits, and the stretch of the text (code points) from the
    first to the last window found; a row for each text and item."""
    text, place, starts = normalised(texts)
    return sorted(_regions(text, place, starts, index) + _nothing_else(texts, text, index))


def _regions(text: np.ndarray, place: np.ndarray, starts: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int, int]]:
    if len(text) < index.q or not len(index.keys):
        return []
    at = np.arange(len(text) - index.q + 1)
    h = spans(prefix(text), at, at + index.q)
    maybe = np.flatnonzero(index.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
    key = np.minimum(np.searchsorted(index.keys, h[maybe]), len(index.keys) - 1)
    sure = index.keys[key] == h[maybe]
    del at, h
    spot, key = maybe[sure], key[sure]
    if not len(spot):
        return []
    run = np.flatnonzero(np.append(True, (spot[1:] != spot[:-1] + 1) | (key[1:] != key[:-1])))
    long = np.diff(np.append(run, len(spot)))
    w, bucket = _bands(spot[run], long, key[run], index)
    found: dict[tuple[int, int], list] = {}
    low = bucket * BAND - BAND * 64 - int(index.budget.max())
    for k in range(0, len(w), CHUNK):
        _verified(text, place, starts, index, w[k : k + CHUNK], low[k : k + CHUNK], found)
    return [(d, x, len(r[0]), *r[1:]) for (d, x), r in sorted(found.items())]


def _bands(spot: np.ndarray, long: np.ndarray, key: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Windows and the bands of diagonals in which they share enough q-grams with the text.

    A run of equal q-grams in the text (``long`` places from ``spot``) meets a run of them in a window on a
    stretch of diagonals, and how many pairs lie up to a diagonal is known without them.  Runs meet in
    chunks, of which only the counts by window and band are held."""
    budget = int(index.budget.max())
    count = index.first[key + 1] - index.first[key]
    upto = np.append(0, np.cumsum(count))
    codes, hits = [], []
    for a in range(0, int(upto[-1]), CHUNK):
        b = min(a + CHUNK, int(upto[-1]))
        t = np.searchsorted(upto, np.arange(a, b), side="right") - 1
        entry = index.first[key[t]] + np.arange(a, b) - upto[t]
        w, one, two = index.window[entry], long[t], index.length[entry]
        least = spot[t] - (index.offset[entry] + two - 1) + BAND * 64
        low, high = (least - budget) // BAND, (least + one + two - 2) // BAND
        bands = np.append(0, np.cumsum(high - low + 1))
        at = 0
        while at < len(w):
            end = max(at + 1, int(np.searchsorted(bands, bands[at] + CHUNK, side="right")) - 1)
            own = np.repeat(np.arange(at, end), np.diff(bands[at : end + 1]))
            band = low[own] + np.arange(bands[end] - bands[at]) - (bands[own] - bands[at])

            def below(x: np.ndarray, own: np.ndarray = own) -> np.ndarray:
                """Pairs of both runs on diagonals up to ``x``."""
                y = x - least[own] + 1
                tri = lambda z: np.where(z > 0, z * (z + 1) // 2, 0)
                return tri(y) - tri(y - one[own]) - tri(y - two[own]) + tri(y - one[own] - two[own])

            shared = below(band * BAND + BAND + budget - 1) - below(band * BAND - 1)
            code, which = np.unique(w[own] << 40 | band, return_inverse=True)
            codes.append(code)
            hits.append(np.bincount(which, shared, len(code)).astype(np.int64))
            at = end
    code, which = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.bincount(which, np.concatenate(hits), len(code)).astype(np.int64)
    w, bucket = code >> 40, code & ((1 << 40) - 1)
    size = index.begin[w + 1] - index.begin[w]
    good = total >= size - index.q + 1 - index.q * index.budget[w]
    return w[good], bucket[good]


def _verified(text: np.ndarray, place: np.ndarray, starts: np.ndarray, index: Index, w: np.ndarray, low: np.ndarray, found: dict[tuple[int, int], list]) -> None:
    """Adds what alignment finds to the windows, fewest edits and stretch of each text and item."""
    edits, end = align(text, index, w, low, BAND + 3 * int(index.budget.max()))
    ok = edits <= index.budget[w]
    w, end, edits = w[ok], end[ok], edits[ok]
    if not len(w):
        return
    first = np.maximum(end - (index.begin[w + 1] - index.begin[w]), 0)
    a, b = place[np.minimum(first, len(place) - 1)], place[np.minimum(end, len(place)) - 1] + 1
    doc = np.searchsorted(starts, b - 1, side="right") - 1
    a = np.maximum(a, starts[doc])
    for d, x, win, e, s, t in zip(doc.tolist(), index.items[w].tolist(), w.tolist(), edits.tolist(), (a - starts[doc]).tolist(), (b - starts[doc]).tolist()):
        r = found.setdefault((d, x), [set(), e, s, t])
        r[0].add(win)
        r[1:] = [min(r[1], e), min(r[2], s), max(r[3], t)]


FOUND = "doc_id long, item_id long, windows long, edits long, start long, end long"


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, stride: int = STRIDE, q: int = Q, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """A row for each document and item of which the document has a window within the edit budget.

    Texts are compared in lower case, all but letters and numbers as single spaces.  Documents are
    searched whole, in place, without a shuffle.  The benchmark is indexed in blocks of about
    ``block`` characters, each of which is broadcast and passes over the documents.  Rows that
    repeat a document repeat its results, null or empty texts have none, a null id stays null, and texts
    of any length are searched whole.  Items under ``EXACT`` characters must occur without edits, and
    those under ``q`` only count where a document is nothing else.
    """
    require(benchmark, ("item_id", "text"), "benchmark")
    texts = doc_texts(docs)
    spark = texts.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.char_length("text"))).first()[0] or 0) // block))

    def run(shared):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                docs_, rows = b.column(0).to_pylist(), []
                for first, held in runs(b.column(1).to_pylist(), 1 << 19):
                    rows += [(docs_[first + d], *r) for d, *r in search(held, shared.value)]
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "windows", "edits", "start", "end"])

        return go

    out = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(build([(r.item_id, r.text) for r in own.collect()], window, stride, q, rate))
        part = texts.mapInArrow(run(shared), FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that :func:`contaminated` finds; a null id is never found."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("bad_id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("doc"))  # no name of docs clashes
    return rows.join(bad, F.col("doc").getField("doc_id") == F.col("bad_id"), "left_anti").select("doc.*")
