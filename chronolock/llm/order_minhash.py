"""Order MinHash fingerprints of documents.

Each k-mer of code points is numbered by its occurrence, so repeats count.  Each of ``sketches``
hash functions selects the ``2`` smallest numbered k-mers, puts them back into text order and hashes
the tuple.  Two texts agree in a sketch if they share the k-mers and their order, which falls with
their edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolock.llm.codepoints import mixed, points, prefix, spans
from chronolock.llm.common import doc_texts, parts

K = 10
SKETCHES = 32
_ODD = (mixed(np.arange(1, 4097, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def fingerprint(text: str, k: int = K, sketches: int = SKETCHES) -> np.ndarray:
    """``sketches`` numbers of 32 bits; zeros for an empty text.  A text of fewer than ``k`` code
    points is one k-mer; one k-mer alone is hashed as a pair with itself."""
    if not text:
        return np.zeros(sketches, np.uint32)
    cp, _ = points([text])
    n = max(1, len(cp) - k + 1)
    start = np.arange(n)
    kmers = spans(prefix(cp), start, np.minimum(start + k, len(cp)))
    # number the occurrences: only k-mers that occur twice need it
    order = np.argsort(kmers)
    ranked = kmers[order]
    same = np.append(False, ranked[1:] == ranked[:-1])
    numbered = kmers.copy()
    if same.any():
        twice = order[same | np.append(same[1:], False)]
        twice = twice[np.lexsort((twice, kmers[twice]))]
        key = kmers[twice]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.arange(len(twice)) - np.repeat(first, np.diff(np.append(first, len(twice))))
        numbered[twice] += count.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    base = (mixed(numbered) >> np.uint64(32)).astype(np.uint32)
    one, two = np.zeros(sketches, np.int64), np.zeros(sketches, np.int64)
    step = max(1, (1 << 18) // n)  # sketches at a time
    for s in range(0, sketches, step):
        g = base[None, :] * _ODD[s : s + step][: sketches - s, None]
        rows = np.arange(len(g))
        a = g.argmin(1)
        one[s : s + step] = a
        if n > 1:
            g[rows, a] = 0xFFFFFFFF
            two[s : s + step] = g.argmin(1)
    left, right = kmers[np.minimum(one, two)], kmers[np.maximum(one, two)]
    with np.errstate(over="ignore"):
        return (mixed(left * np.uint64(0x9FB21C651E98DF25) + right) >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of sketches in which two fingerprints agree."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _hex(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def edit_fingerprints(docs: DataFrame, k: int = K, sketches: int = SKETCHES) -> DataFrame:
    """Fingerprints of every text and of its edited text; see :func:`edited`.

    The next document is that of the next smaller ``doc_id``, and after the last the first.  Texts
    move once: rows are dealt to ranges of ``doc_id``, and the first row of a range goes to the range
    before it too.  Rows of one id follow each other by text; null ids come last; a table of one row
    is its own next.  Null text counts as empty.
    """
    spark = docs.sparkSession
    rows = doc_texts(docs).withColumn("rank", F.coalesce(F.lit(0.0) - F.col("doc_id").cast("double"), F.lit(float("inf"))))
    n = 8 * parts(spark)
    ids = rows.select(F.least(F.col("rank"), F.lit(1e300)).alias("rank"))
    cuts = sorted(set(ids.approxQuantile("rank", [i / n for i in range(1, n)], 0.2 / n))) or [0.0]
    ranged = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="rank", outputCol="range", handleInvalid="keep")
    rows = ranged.transform(rows).withColumn("range", F.col("range").cast("int"))
    heads = sorted((r.range, r.rank) for r in rows.groupBy("range").agg(F.min("rank").alias("rank")).collect())  # a row for each range
    before = spark.createDataFrame([(rank, heads[i - 1][0]) for i, (_, rank) in enumerate(heads)], "head double, to int")
    own = F.struct(F.col("range"), F.lit(0).alias("tail"))
    both = F.when(F.col("to").isNotNull(), F.array(own, F.struct(F.col("to").alias("range"), F.lit(1).alias("tail")))).otherwise(F.array(own))
    # the heads are as many as the ranges, a few for each partition
    rows = rows.join(F.broadcast(before), F.col("rank") == F.col("head"), "left").withColumn("dealt", F.explode(both)).select("doc_id", "text", "dealt.range", "dealt.tail")
    dealt = rows.repartition(parts(spark), "range").sortWithinPartitions("range", "tail", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # range, id, text, fingerprint
        skip = None  # the range whose tail has been used
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for b in batches:
            out: list[tuple] = []
            for doc, text, rng, tail in zip(*(b.column(i).to_pylist() for i in range(4))):
                if skip == rng:
                    continue
                f = fingerprint(text, k, sketches)
                if held is not None:
                    _, last, before_text, g = held
                    new = edited(before_text, text)
                    e = fingerprint(new, k, sketches)
                    out.append((last, len(before_text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), _hex(g), _hex(e), likeness(g, e), likeness(g, f)))
                held, skip = (None, rng) if tail else ((rng, doc, text, f), None)
            cols = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return dealt.select("doc_id", "text", "range", "tail").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
