"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded from counts of its characters, character
classes and repeated words; gated attention weighs the encodings; the weighted sum is scored.  Only
document labels are learned from.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolock.llm.codepoints import points, prefix, spans
from chronolock.llm.common import doc_texts, require, runs, slices

PASSAGE = 384
#: Labelled rows learned from, at most.
TRAIN_ROWS = 4000
#: Passages of each of them that it learns from, at most, evenly spaced; scores take all passages.
TRAIN_PASSAGES = 64
#: Passages that are encoded at a time.
CHUNK = 1 << 13
HIDDEN, GATE = 16, 8
PUNCTUATION = "!?.,;:'\"|#$%&*@()[]{}<>/\\=+-_~^`"
LOWER, UPPER, DIGIT, BLANK, FOREIGN_LOWER, FOREIGN_UPPER, FOREIGN = range(7)
CLASSES = 7 + len(PUNCTUATION)
COARSE = 8
FEATURES = CLASSES + COARSE * COARSE + 6
_made: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if "kinds" not in _made:
        kind = np.full(0x110000, FOREIGN, np.int64)
        for c in range(0x3000):
            x = chr(c)
            if x in PUNCTUATION:
                kind[c] = 7 + PUNCTUATION.index(x)
            elif x.isspace():
                kind[c] = BLANK
            elif x.isdigit():
                kind[c] = DIGIT
            elif x.isupper():
                kind[c] = UPPER if c < 128 else FOREIGN_UPPER
            elif x.isalpha():
                kind[c] = LOWER if c < 128 else FOREIGN_LOWER
        coarse = np.full(CLASSES, 7, np.int64)
        coarse[:7] = [0, 1, 2, 3, 0, 1, 4]
        coarse[[7 + PUNCTUATION.index(x) for x in ".,"]] = 5
        coarse[[7 + PUNCTUATION.index(x) for x in "!?"]] = 6
        _made["kinds"] = kind, coarse
    return _made["kinds"]


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters, a line feed after each text; where each passage starts (lines, long ones cut every
    ``PASSAGE`` characters; a blank one counts to the one before); and each text's first passage.  A text
    without any has one."""
    cp, at = points([t + "\n" for t in texts])
    fine, _ = _tables()
    line = np.flatnonzero(cp == 10) + 1
    begin = np.append(0, line[:-1])
    size = line - begin
    n = -(-size // PASSAGE)
    start = np.repeat(begin, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * PASSAGE
    end = np.append(start[1:], len(cp))
    blank = np.append(0, np.cumsum(fine[cp] != BLANK))
    filled = blank[end] > blank[start]
    filled[np.searchsorted(start, at[:-1])] = True  # one at least for each text
    return cp, start[filled], np.searchsorted(np.flatnonzero(filled), np.searchsorted(start, at[:-1]))


def chunks(cp: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int]]:
    """Passages in chunks of ``CHUNK`` or more; the next starts after a line feed, so no word is cut."""
    cuts = np.append(np.flatnonzero(cp[begin[1:] - 1] == 10) + 1, len(begin))
    at = 0
    while at < len(begin):
        end = int(cuts[min(np.searchsorted(cuts, at + CHUNK), len(cuts) - 1)])
        yield at, end
        at = end


def features(cp: np.ndarray, begin: np.ndarray, a: int, b: int) -> np.ndarray:
    """A row for each passage from ``a`` to ``b``."""
    low, high = int(begin[a]), int(begin[b]) if b < len(begin) else len(cp)
    fine, coarse = _tables()
    own, count = cp[low:high], b - a
    of = np.repeat(np.arange(count), np.diff(np.append(begin[a:b], high)))
    kind = fine[own]
    length = np.bincount(of, minlength=count).astype(np.float64)
    out = np.zeros((count, FEATURES), np.float32)
    out[:, :CLASSES] = np.bincount(of * CLASSES + kind, minlength=count * CLASSES).reshape(count, CLASSES) / length[:, None]
    c = coarse[kind]
    before = coarse[fine[cp[low - 1 : high - 1]]] if low else c[:-1]  # the first character of all has none before it
    here = slice(None) if low else slice(1, None)
    two = of[here] * (COARSE * COARSE) + before * COARSE + c[here]
    pairs = np.bincount(two, minlength=count * COARSE * COARSE).reshape(count, COARSE * COARSE)
    out[:, CLASSES : CLASSES + COARSE * COARSE] = pairs / length[:, None]
    # words, and whether each repeats one of the two before it
    solid = np.concatenate([[False], kind != BLANK, [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    s, e = edge[::2], edge[1::2]
    if len(s):
        h, w = spans(prefix(own), s, e), of[s]
        same1 = np.append(False, (h[1:] == h[:-1]) & (w[1:] == w[:-1]))
        same2 = np.append([False, False], (h[2:] == h[:-2]) & (w[2:] == w[:-2]))[: len(h)]
        words = np.maximum(np.bincount(w, minlength=count), 1)
        caps = (kind[s] == UPPER) | (kind[s] == FOREIGN_UPPER)
        for i, x in enumerate((same1, same2, caps, (e - s) / 10, (e - s == 1))):
            out[:, CLASSES + COARSE * COARSE + i] = np.bincount(w, weights=x, minlength=count) / words
    out[:, -1] = np.log1p(length) / 6
    return out


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and where each text's start."""
    cp, begin, first = bags(texts)
    return np.concatenate([features(cp, begin, a, b) for a, b in chunks(cp, begin)]), first


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        w, b, v, u, a, c, d = self.weights
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        h = np.tanh(x @ w + b)
        tv, su = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        z = (tv * su) @ a
        p = np.exp(z - np.maximum.reduceat(z, first)[bag])
        p /= np.add.reduceat(p, first)[bag]
        m = np.add.reduceat(p[:, None] * h, first)
        return bag, h, tv, su, p, m, 1 / (1 + np.exp(-(m @ c + d[0])))

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores of whole texts; of each the largest attention so far, the sum of attentions and the weighted sum
        are kept while chunks of its passages go by."""
        w, b, v, u, a, c, d = self.weights
        out = np.zeros(len(texts))
        for at, held in runs(texts, 1 << 19):
            cp, begin, first = bags(held)
            most, total, sums = np.full(len(held), -np.inf), np.zeros(len(held)), np.zeros((len(held), HIDDEN))
            for p, q in chunks(cp, begin):
                h = np.tanh(((features(cp, begin, p, q) - self.mean) / self.scale) @ w + b)
                z = (np.tanh(h @ v) / (1 + np.exp(-(h @ u)))) @ a
                one = np.searchsorted(first, p, side="right") - 1
                bag = np.arange(one, np.searchsorted(first, q))  # texts with passages here
                starts = np.maximum(first[bag], p) - p
                peak = np.maximum.reduceat(z, starts)
                e = np.exp(z - np.repeat(peak, np.diff(np.append(starts, q - p))))
                new = np.maximum(most[bag], peak)
                old, more = np.exp(most[bag] - new), np.exp(peak - new)
                total[bag] = total[bag] * old + np.add.reduceat(e, starts) * more
                sums[bag] = sums[bag] * old[:, None] + np.add.reduceat(e[:, None] * h, starts) * more[:, None]
                most[bag] = new
            out[at : at + len(held)] = 1 / (1 + np.exp(-(sums / total[:, None] @ c + d[0])))
        return out


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 250, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """Full-batch Adam on the logistic loss of the document labels."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    scale = np.maximum(scale, 0.01)
    x = ((x - mean) / scale).astype(np.float32)
    shape = [(FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,)]
    model = Model(mean, scale, [(rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or s != (1,) else np.zeros(s)).astype(np.float32) for s in shape])
    model.weights[1][:] = 0
    m1, m2 = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights]
    for step in range(1, rounds + 1):
        w, b, v, u, a, c, d = model.weights
        bag, h, tv, su, p, m, out = model.forward(x, first)
        g = ((out - y) / len(y)).astype(np.float32)
        gm = g[:, None] * c
        gh = p[:, None] * gm[bag]
        gp = (h * gm[bag]).sum(1)
        gz = p * (gp - np.add.reduceat(p * gp, first)[bag])
        ggate = gz[:, None] * a
        gv, gu = ggate * su * (1 - tv**2), ggate * tv * su * (1 - su)
        gh += gv @ v.T + gu @ u.T
        gx = gh * (1 - h**2)
        grads = [x.T @ gx, gx.sum(0), h.T @ gv, h.T @ gu, (tv * su).T @ gz, m.T @ g, np.array([g.sum()])]
        for i, grad in enumerate(grads):
            grad = grad + decay * model.weights[i]
            m1[i] = 0.9 * m1[i] + 0.1 * grad
            m2[i] = 0.999 * m2[i] + 0.001 * grad**2
            model.weights[i] = model.weights[i] - (rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _saved(model: Model) -> bytes:
    out = io.BytesIO()
    np.savez(out, model.mean, model.scale, *model.weights)
    return out.getvalue()


def _loaded(raw: bytes) -> Model:
    held = np.load(io.BytesIO(raw))
    mean, scale, *weights = (held[f"arr_{i}"] for i in range(len(held.files)))
    return Model(mean, scale, weights)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, passages: int = TRAIN_PASSAGES) -> Model:
    """A model from ``rows`` labelled documents at most, the first by a hash of doc_id, none of them
    held out (crc32 of the id mod 4 is 2), and from ``passages`` passages of each.

    Both bounds hold for rows and bytes: a doc_id that repeats counts once (its least encoding), and a
    long text gives passages from all over it.  Tasks encode, one task fits, and only the weights come
    to the driver.  Without labels, or with one kind only, it still fits, to the share of ones (1 if
    there are none).
    """
    require(labels, ("doc_id", "quality"), "labels")
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null and y is not null")
    marks = marks.where(~_held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    found = doc_texts(docs).join(F.broadcast(marks), F.col("doc_id") == F.col("id")).select("id", "y", "text")  # rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, y, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                cp, begin, _ = bags([text])
                some = np.linspace(0, len(begin) - 1, min(len(begin), passages)).astype(np.int64)
                x = np.concatenate([features(cp, begin, p, q)[some[(some >= p) & (some < q)] - p] for p, q in chunks(cp, begin)])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([y], pa.int32()), pa.array([x.tobytes()])], ["id", "y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((x, y) for b in batches for y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([_saved(_fitted(got))])], ["model"])

    few = found.mapInArrow(run, "id long, y int, x binary").groupBy("id", "y").agg(F.min("x").alias("x")).select("y", "x").repartition(1)
    made = few.mapInArrow(learn, "model binary").first()
    return _loaded(bytes(made.model)) if made else _fitted([])


def _fitted(got: list[tuple[bytes, int]]) -> Model:
    bags = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x, _ in got] or [np.zeros((1, FEATURES), np.float32)]
    y = np.array([y for _, y in got] or [1], np.float32)
    first = np.append(0, np.cumsum([len(b) for b in bags])[:-1])
    return fit(np.concatenate(bags), first, y)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; null text counts as empty, a null id as
    not held out.  Texts of any length are scored whole, a chunk of passages at a time; repeated rows repeat
    their score, an empty table gives none, and other columns are left behind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = shared.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return doc_texts(docs).withColumn("held_out", _held_out(F.col("doc_id"))).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, same columns; a null text scores as the
    empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = shared.value.score([t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()])
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
