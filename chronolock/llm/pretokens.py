"""Byte-level BPE by pre-token: a shared table of frequent pre-tokens, then a cache in each worker.

Texts are cut into pre-tokens on arrays of code points.  A pre-token's hash is looked up in the
broadcast table and its code points are compared; misses are encoded once for each worker and kept
there.  Only those of the sampled rows that the table is made from are counted across tasks.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolock.llm.codepoints import points, prefix, spans
from chronolock.llm.common import runs

#: Pre-tokens that a worker keeps; a full cache starts anew.
CACHE = 150_000
LETTER, NUMBER, SPACE, OTHER = range(4)
# The white space of Unicode, and the contractions that the pre-tokenizer splits off.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_made: dict = {}


def classes() -> np.ndarray:
    """Of every code point: letter, number, white space or other."""
    if "classes" not in _made:
        kind = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            first = unicodedata.category(chr(c))[0]
            if first == "L":
                kind[c] = LETTER
            elif first == "N":
                kind[c] = NUMBER
        kind[WHITE] = SPACE
        _made["classes"] = kind
    return _made["classes"]


def cut(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pre-tokens start.

    A pre-token is a run of letters, of numbers or of other characters, with one space before it if
    there is one; or a contraction; or white space, whose last character stands alone (or leads the
    next pre-token, if it is a space) where a text goes on after it.
    """
    if not len(cp):
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    new = np.zeros(len(cp), bool)
    new[at[:-1][at[:-1] < len(cp)]] = True
    start = new.copy()
    start[1:] |= kind[1:] != kind[:-1]
    words = np.flatnonzero(start & (kind != SPACE) & ~new)
    words = words[kind[words - 1] == SPACE]
    led = cp[words - 1] == 32
    start[words - 1] = True
    start[words[led]] = False
    # contractions: an apostrophe that stands alone as a run, without a space before it
    quotes = np.flatnonzero((cp == 39) & start)
    for q in quotes.tolist():
        if q + 1 < len(cp) and not new[q + 1] and kind[q + 1] == LETTER:
            tail = "".join(map(chr, cp[q + 1 : q + 3]))
            for c in CONTRACTIONS:
                if tail.startswith(c) and not new[q + 1 : q + 1 + len(c)].any():
                    start[q + 1] = False
                    if q + 1 + len(c) < len(cp):
                        start[q + 1 + len(c)] = True
                    break
    return np.flatnonzero(start)


class Encoder:
    """Ids of single pre-tokens, from a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.special = special
        self.bpe = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, piece: str) -> np.ndarray:
        ids = self.kept.get(piece)
        if ids is None:
            ids = np.array(self.bpe.encode_ordinary(piece), np.uint32)
            if len(self.kept) >= CACHE:
                self.kept.clear()
            self.kept[piece] = ids
        return ids


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def equal(a: np.ndarray, s: np.ndarray, b: np.ndarray, t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each stretch of ``n`` (1 or more) items from ``s`` in ``a`` is that from ``t`` in ``b``."""
    if not len(n):
        return np.zeros(0, bool)
    out = []
    for at in range(0, len(n), 1 << 15):  # so many at a time
        m = n[at : at + (1 << 15)].astype(np.int64)
        first = np.cumsum(m) - m
        step = np.arange(int(m.sum()))
        out.append(np.logical_and.reduceat(a[np.repeat(s[at : at + (1 << 15)] - first, m) + step] == b[np.repeat(t[at : at + (1 << 15)] - first, m) + step], first))
    return np.concatenate(out)


@dataclass
class Frequent:
    """A hash table of two slots a key: hash, place and number of the ids of frequent pre-tokens."""

    keys: np.ndarray
    place: np.ndarray
    size: np.ndarray
    ids: np.ndarray
    chars: np.ndarray  # code points of the pre-tokens one after another
    begin: np.ndarray  # where that of a slot starts in chars
    length: np.ndarray

    def find(self, h: np.ndarray, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The slot of each pre-token ``cp[start:end]`` with hash ``h``, -1 if it isn't there; the code
        points are compared, so equal hashes decide nothing."""
        out = self.slot(h)
        hit = np.flatnonzero((out >= 0) & (self.length[out] == end - start))
        same = equal(cp, start[hit], self.chars, self.begin[out[hit]], self.length[out[hit]])
        sure = np.full(len(out), -1)
        sure[hit[same]] = out[hit[same]]
        return sure

    def slot(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        out = np.where(self.keys[slot] == h, slot, -1)
        miss = np.flatnonzero(out < 0)
        again = ((h[miss] + np.uint64(1)) & mask).astype(np.int64)
        out[miss] = np.where(self.keys[again] == h[miss], again, -1)
        return out


def table_of(pieces: list[str], encode: Encoder, slots: int = 1 << 18) -> Frequent:
    keys, place, size, ids, at = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.uint8), [], 0
    begin, length = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    cp, starts = points(pieces)
    if pieces:
        hashes = spans(prefix(cp), starts[:-1], starts[1:])
        for k, (piece, h) in enumerate(zip(pieces, hashes.tolist())):
            own = encode(piece)
            for slot in (h & (slots - 1), (h + 1) & (slots - 1)):
                if not keys[slot] and h and len(own) < 256:
                    keys[slot], place[slot], size[slot] = h, at, len(own)
                    begin[slot], length[slot] = starts[k], len(piece)
                    ids.append(own)
                    at += len(own)
                    break
    return Frequent(keys, place, size, np.concatenate(ids) if ids else np.zeros(0, np.uint32), cp, begin, length)


def frequent(texts: DataFrame, path: str, sample_rows: int = 3000, most: int = 65_536, longest: int = 64) -> Frequent:
    """The table for ``texts``: the ``most`` commonest pre-tokens, of ``longest`` code points at most, of
    about ``sample_rows`` rows, dealt by a hash of their place, so that repeated and null ids spread.

    It only saves time: what it lacks is encoded all the same.  Tasks count, Spark adds up, and its size
    is bounded by ``most * longest``, whatever the input."""
    share = min(1.0, sample_rows / max(1, texts.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for _, held in runs(b.column(0).to_pylist()):
                cp, at = points(held)
                s = cut(cp, at)
                whole = "".join(held)
                seen.update(map(whole.__getitem__, map(slice, s.tolist(), [*s[1:].tolist(), len(cp)])))
        top = [(p, n) for p, n in seen.items() if len(p) <= longest]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    # the upper 62 bits of a hash lie under the share of all their values, at any size of the input
    place = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 2)
    few = texts.select("text", place.alias("place")).where(F.col("place") <= F.lit(int(share * (1 << 62)))).select("text")
    top = few.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(most)
    return table_of([r.piece for r in top.select("piece").collect()], encoder(path))


def encode_run(held: list[str], encode: Encoder, known: Frequent, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Of consecutive texts: the number of tokens of each pre-token, all ids, and where in the
    pre-tokens each text starts."""
    cp, at = points(held)
    start = cut(cp, at)
    end = np.append(start[1:], len(cp))
    h = spans(prefix(cp), start, end)
    slot = known.find(h, cp, start, end)
    size = known.size[slot].astype(np.int64)
    miss = np.flatnonzero(slot < 0)
    own: list[np.ndarray] = []
    inverse = np.zeros(0, np.int64)
    if len(miss):
        _, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
        whole = "".join(held)
        alike = miss[first[inverse]]  # of one hash; those that differ all the same are encoded on their own
        n = end[miss] - start[miss]
        same = n == end[alike] - start[alike]
        same[same] = equal(cp, start[miss[same]], cp, start[alike[same]], n[same])
        other = np.flatnonzero(~same)
        inverse[other] = len(first) + np.arange(len(other))
        each = np.concatenate([miss[first], miss[other]])
        own = [encode(whole[a:b]) for a, b in zip(start[each].tolist(), end[each].tolist())]
        own_size = np.fromiter(map(len, own), np.int64, len(own))
        size[miss] = own_size[inverse]
    by_text = np.searchsorted(start, at)
    if not want_ids:
        return size, None, by_text
    begin = known.place[slot].astype(np.int64)
    flat = known.ids
    if len(miss):
        shift = len(flat) + np.cumsum(own_size) - own_size
        begin[miss] = shift[inverse]
        flat = np.concatenate([flat, *own])
    total = int(size.sum())
    jump = np.repeat(begin - (np.cumsum(size) - size), size)
    return size, flat[jump + np.arange(total)], by_text


def split_special(text: str, special: dict[str, int]) -> list[str | int]:
    """The text cut at the strings of special tokens, which stand as their ids."""
    out: list[str | int] = [text]
    for s, i in special.items():
        if s in text:
            parts: list[str | int] = []
            for x in out:
                if isinstance(x, int):
                    parts.append(x)
                    continue
                pieces = x.split(s)
                for k, piece in enumerate(pieces):
                    parts += [i, piece] if k else [piece]
            out = parts
    return out


def token_counts(texts: list[str], encode: Encoder, known: Frequent) -> np.ndarray:
    """Tokens of each text, special strings counting one each."""
    out = np.zeros(len(texts), np.int64)
    odd = {i: split_special(t, encode.special) for i, t in enumerate(texts) if any(s in t for s in encode.special)}
    for first, held in runs(("" if i in odd else t for i, t in enumerate(texts)), 1 << 19):
        size, _, by = encode_run(held, encode, known, False)
        total = np.append(0, np.cumsum(size))
        out[first : first + len(held)] = total[by[1:]] - total[by[:-1]]
    for i, pieces in odd.items():
        out[i] = sum(1 if isinstance(x, int) else int(encode_run([x], encode, known, False)[0].sum()) for x in pieces)
    return out


def token_ids(texts: list[str], encode: Encoder, known: Frequent) -> Iterator[np.ndarray]:
    """The ids of each text, in order."""
    odd = {i: split_special(t, encode.special) for i, t in enumerate(texts) if any(s in t for s in encode.special)}
    for first, held in runs(("" if i in odd else t for i, t in enumerate(texts)), 1 << 19):
        size, ids, by = encode_run(held, encode, known, True)
        total = np.append(0, np.cumsum(size))[by]
        for k in range(len(held)):
            if first + k in odd:
                yield np.concatenate([np.array([x], np.uint32) if isinstance(x, int) else encode_run([x], encode, known, True)[1] for x in odd[first + k]])
            else:
                yield ids[total[k] : total[k + 1]]
