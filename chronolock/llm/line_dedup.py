"""Near-duplicate lines by a segment-partition edit join.

Lines within ``edits`` of each other share a segment: a line cut into ``edits`` + 1 segments has one
that no edit touches.  Each line is indexed by (length, segment number, segment) and probes, for each
length that is shorter by ``edits`` at most, the substrings that can match a segment of it.  What
meets is filtered by parities of characters and character pairs, then verified by banded
bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolock.llm.codepoints import mixed, points, prefix, spans
from chronolock.llm.common import doc_texts, runs, settle, slices
from chronolock.llm.components import components

EDITS = 2
MIN_CHARS = 20
#: Lines that a task remembers, so as not to send a repeated line again.
SEEN = 1_000_000
#: Lines up to which the ids of candidates are broadcast (8 bytes each); beyond, they are joined.
BROADCAST_IDS = 500_000


def segments(n: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and length of each segment of lines of ``n`` characters; the later ones are longer."""
    count = edits + 1
    short, longer = n // count, n % count
    out, at = [], np.zeros_like(n)
    for i in range(count):
        size = short + (i >= count - longer)
        out.append((at, size))
        at = at + size
    return out


def keys(p: np.ndarray, start: np.ndarray, end: np.ndarray, edits: int, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines ``start:end`` in the text whose prefix hashes are ``p``, and the line of each."""
    n = end - start
    line = np.arange(len(n))
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def add(own: np.ndarray, s: np.ndarray, size: np.ndarray, length: np.ndarray, i: int) -> None:
        tag = (length * (edits + 1) + i).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        out.append((mixed(spans(p, s, s + size) ^ tag), own))

    for less in range(edits + 1) if probe else (0,):
        length = n - less
        for i, (at, size) in enumerate(segments(np.maximum(length, 0), edits)):
            # a match at segment i leaves i edits at most before it, and edits - i after it
            low, high = (max(-i, less - (edits - i)), min(i, less + edits - i)) if probe else (0, 0)
            for shift in range(low, high + 1):
                own = line[(length > edits) & (at + shift >= 0) & (at + shift + size <= n)]
                add(own, start[own] + at[own] + shift, size[own], length[own], i)
    return np.concatenate([k for k, _ in out]), np.concatenate([o for _, o in out])


def parities(cp: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each line: 32 bits of parities of characters, 32 of character pairs.

    An edit changes at most 2 of the former and 4 of the latter.
    """
    c = cp.astype(np.uint64)
    one = np.uint64(1) << (((c * np.uint64(0x9E3779B1)) >> np.uint64(16)) & np.uint64(31))
    one[cp == 10] = 0
    two = np.uint64(1) << (((c[:-1] * np.uint64(0x85EBCA77) + c[1:] * np.uint64(0xC2B2AE3D)) >> np.uint64(13) & np.uint64(31)) + np.uint64(32))
    two[(cp[:-1] == 10) | (cp[1:] == 10)] = 0
    one[:-1] ^= two
    return np.bitwise_xor.reduceat(one, start)


def _emit(edits: int, min_chars: int, probe: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches):
            for _, held in runs(b.column(0).to_pylist(), 1 << 19):
                whole = "\n".join(held) + "\n"
                cp, _ = points([whole])
                end = np.flatnonzero(cp == 10)
                start = np.append(0, end[:-1] + 1)
                long = np.flatnonzero(end - start >= min_chars)
                fresh, ids = [], []
                for k, s, e in zip(long.tolist(), start[long].tolist(), end[long].tolist()):
                    h = xxhash.xxh64_intdigest(whole[s:e].encode("utf-8", "surrogatepass"), 42)
                    if h not in seen:
                        seen.add(h)
                        fresh.append(k)
                        ids.append(h)
                if len(seen) > SEEN:
                    seen.clear()
                if not fresh:
                    continue
                sig = parities(cp, start)[fresh]
                key, own = keys(prefix(cp), start[fresh], end[fresh], edits, probe)
                h = np.array(ids, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, h[own], sig[own])], ["key", "h", "sig"])

    return run


def within(a: str, b: str, most: int) -> bool:
    """Whether ``a`` and ``b`` are within ``most`` edits, by the bit-parallel band of 2 * most + 1
    diagonals."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    if a == b:
        return True
    low, high = 0, len(b)
    while low < high:  # the common prefix
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, len(b)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid :] == b[len(b) - mid :] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    gap = len(a) - len(b)
    width = (1 << (2 * most + 1)) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + most)
    vp, vn, score, diagonal = width & ~((1 << most) - 1), 0, gap, 1 << (most + gap)
    for j, c in enumerate(b):  # bit k of the band stands for row j + 1 - most + k
        eq = where.get(c, 0) >> j & width
        d0 = (((eq & vp) + vp) ^ vp | eq | vn) & width
        hp, hn = vn | ~(d0 | vp) & width, d0 & vp
        if not d0 & diagonal:
            score += 1
            if score > most:
                return False
        x = d0 >> 1
        vp, vn = hn | ~(x | hp) & width, x & hp
    return score <= most


def _verify(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array([within(s, t, edits) for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(ok)

    return run


def _lines(texts: DataFrame) -> DataFrame:
    """``doc_id, line_no, line`` of every line, and ``row``, if there."""
    own = [c for c in ("doc_id", "row") if c in texts.columns]
    return texts.select(*own, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def links(texts: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Links ``(u, v)`` between the ids of different lines within ``edits``, both of ``min_chars``
    characters or more."""
    if min_chars <= 2 * edits + 1:
        raise ValueError("min_chars must be over 2 * edits + 1: each segment needs a character")
    schema = "key long, h long, sig long"
    index = texts.select("text").mapInArrow(_emit(edits, min_chars, False), schema)
    probe = texts.select("text").mapInArrow(_emit(edits, min_chars, True), schema).select("key", F.col("h").alias("g"), F.col("sig").alias("tip"))
    apart = F.col("sig").bitwiseXOR(F.col("tip"))
    low = F.bit_count(apart.bitwiseAND(F.lit(0xFFFFFFFF)))
    high = F.bit_count(F.shiftrightunsigned(apart, 32))
    met = index.join(probe, (index["key"] == probe["key"]) & (F.col("h") != F.col("g")) & (low <= 2 * edits) & (high <= 4 * edits))
    pairs = settle(met.select(F.least("h", "g").alias("u"), F.greatest("h", "g").alias("v")).distinct(), "line-pairs")
    ids = settle(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "line-ids")
    few = ids.count() <= BROADCAST_IDS
    lines = _lines(texts).where(F.char_length("line") >= min_chars).select(F.xxhash64("line").alias("h"), "line")
    lines = settle(lines.join(F.broadcast(ids) if few else ids, F.col("h") == F.col("id"), "left_semi").dropDuplicates(["h"]), "lines")
    one, two = lines.select(F.col("h").alias("u"), F.col("line").alias("a")), lines.select(F.col("h").alias("v"), F.col("line").alias("b"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(_verify(edits), "u long, v long")


def line_classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """A row for each line of each document: ``doc_id, line_no, n_chars, class_doc_id,
    class_line_no, copies, kept``.

    Lines end at a line feed.  Lines of ``min_chars`` or more that edits link, in chains too, are a
    class; its name is its first line, by doc_id, then line number, which alone is ``kept``.
    ``copies`` counts its lines.  Shorter lines are a class if they are equal and ``short`` is set, else
    each their own class and kept.  Null and empty texts have one empty line.  Rows that repeat a doc_id share its line numbers: equal lines at one
    number are kept or dropped together.  A null doc_id comes before all others.
    """
    return _classes(doc_texts(docs).withColumn("row", F.lit(None).cast("string")), edits, min_chars, short).drop("row")


def _classes(texts: DataFrame, edits: int, min_chars: int, short: bool) -> DataFrame:
    """:func:`line_classes` of ``texts(doc_id, row, text)``: ``row`` tells different texts of one id apart, and
    comes between id and line number."""
    joined = settle(components(links(texts, edits, min_chars)), "line-roots")
    lines = _lines(texts).select("doc_id", "row", "line_no", F.char_length("line").cast("long").alias("n_chars"), F.xxhash64("line").alias("h"))
    lines = lines.join(joined.select(F.col("node").alias("h"), "root"), "h", "left").select("doc_id", "row", "line_no", "n_chars", F.when(F.lit(short) | (F.col("n_chars") >= min_chars), F.coalesce("root", "h")).alias("c"))
    firsts = lines.where("c is not null").groupBy("c").agg(F.min(F.struct("doc_id", "row", "line_no")).alias("first"), F.count("*").alias("copies")).where("copies > 1").withColumnRenamed("c", "k")
    named = lines.join(firsts, F.col("c") == F.col("k"), "left")
    alone = F.col("k").isNull()
    kept = alone | (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & F.col("first.row").eqNullSafe(F.col("row")) & (F.col("first.line_no") == F.col("line_no")))
    return named.select("doc_id", "row", "line_no", "n_chars", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_doc_id"), F.coalesce("first.line_no", "line_no").alias("class_line_no"), F.coalesce("copies", F.lit(1)).alias("copies"), kept.alias("kept"))


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without lines that repeat an earlier one (see :func:`line_classes`), same columns.

    Lines under ``min_chars`` stay.  A document that loses all its text goes; one that had none stays.
    Different texts of one doc_id are documents of their own, in order of their hashes; equal rows of one id
    lose the same lines.  Rows without an id lose none.  ``n_chars``, if there, is set anew.
    """
    texts = doc_texts(docs)
    twice = texts.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id")
    twice = settle(twice, "repeated-ids")
    own = F.col("doc").getField
    rows = docs.select(F.struct(*docs.columns).alias("doc"))  # no name of docs clashes
    none = F.lit(None).cast("string")
    if twice.isEmpty():
        texts, rows = texts.withColumn("row", none), rows.withColumn("own_row", none)
    else:  # the hash of a text stands for it among those of its id
        texts = texts.join(twice, F.col("doc_id") == F.col("id"), "left").withColumn("row", F.when(F.col("id").isNotNull(), F.sha2("text", 256))).select("doc_id", "row", "text")
        rows = rows.join(twice, own("doc_id").cast("long") == F.col("id"), "left").withColumn("own_row", F.when(F.col("id").isNotNull(), F.sha2(F.coalesce(own("text"), F.lit("")), 256))).drop("id")
    gone = _classes(texts, edits, min_chars, False).where("not kept and doc_id is not null").groupBy(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).agg(F.collect_set("line_no").alias("gone_lines"))
    both = rows.join(gone, (own("doc_id").cast("long") == F.col("gone_id")) & F.col("own_row").eqNullSafe(F.col("gone_row")), "left")
    left = F.concat_ws("\n", F.filter(F.split(own("text"), "\n"), lambda x, i: ~F.array_contains("gone_lines", i)))
    both = both.withColumn("left_text", F.when(F.col("gone_lines").isNull(), own("text")).otherwise(left))
    both = both.where(F.col("gone_lines").isNull() | (F.trim(F.translate("left_text", "\n", " ")) != ""))
    cols = [F.col("left_text").alias("text") if c == "text" else F.char_length("left_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else own(c).alias(c) for c in docs.columns]
    return both.select(*cols)
