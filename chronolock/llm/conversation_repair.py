"""Damage to conversations, the faults found in them, and their cheapest repair.

A repair is a path through a DAG: a level for each row, a state for each place in the grammar of roles
``(s?(ua)+)?``, an edge for each edit.  A path's weight is one whole number: its high digits are the cost,
the low ones, ``SLOTS`` of a fixed width, the letters of its edits from the left, zeros behind the last.
So the smaller of two numbers is the cheaper repair, of equally cheap ones the first in ASCII order, and
the least number at the first level decides everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolock.functions.ranking import counted
from chronolock.llm.common import require, settle

#: Fixed values of the contract: costs of edits, their letters in ASCII order, white space.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LETTERS = "DIKR"
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Conversations of more rows are repaired in pieces of so many, by several tasks.
LONG = 2048
#: Pieces that are put together at a time.
FAN = 64

#: Faults in the order in which they count.
SOUND, BLANK, DUPLICATE, CUT = range(4)
D, I, K, R = range(1, 5)
#: Bits of a letter; 0 is the end.
WIDE = 3
#: Places in the grammar: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
NEVER = 1 << 48  # a cost that no repair has

DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def edges(state: int, initial: str, fault: int) -> Iterator[tuple[int, int, int]]:
    """Cost, letter and next state of what can be done with a row."""
    yield DELETE, D, state
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        for letter, then in NEXT[state].items():
            if letter == initial:
                yield KEEP + more, K, then
            if letter in ROLE:
                yield REROLE + more, R, then


def cheapest(initials: str, faults: list[int]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of one conversation."""
    low = WIDE * (3 * len(initials) + 2)  # a letter a row, and two inserts at most before and behind each
    top, rest = low - WIDE, (1 << low) - 1

    def ahead(cost: int, letter: int, then: int) -> int:
        """The weight of an edit with what follows it."""
        return ((cost + (then >> low)) << low) + (letter << top) + ((then & rest) >> WIDE)

    def inserted(rows: list[int]) -> list[int]:
        """An insert leads on within a level; more than two in a row return to a state."""
        now = rows
        for _ in range(2):
            now = [min([rows[q], *(ahead(INSERT, I, now[t]) for x, t in NEXT[q].items() if x in ROLE)]) for q in range(4)]
        return now

    best = inserted([0, NEVER << low, NEVER << low, 0])
    for c, fault in zip(reversed(initials), reversed(faults)):
        best = inserted([min(ahead(cost, letter, best[t]) for cost, letter, t in edges(q, c, fault)) for q in range(4)])
    weight = best[START]
    digits = ((weight >> at) & 7 for at in range(top, -1, -WIDE))
    return weight >> low, "".join(LETTERS[x - 1] for x in digits if x)


class Replay:
    """Follows an audit: the role of each row that stays, and of each that is inserted."""

    def __init__(self) -> None:
        self.state = START

    def role(self, letter: str, own: str) -> str:
        if letter == "K":
            self.state = NEXT[self.state][own[:1]]
            return own
        x = next(x for x in NEXT[self.state] if x in ROLE)
        self.state = NEXT[self.state][x]
        return ROLE[x]


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def first_faults(rows: list[tuple[str, str]]) -> list[int]:
    """The first fault of each (role, text), in order."""
    seen: set[tuple[str, str]] = set()
    out = []
    for r in rows:
        t = r[1].rstrip(SPACE)
        out.append(BLANK if not t else DUPLICATE if r in seen else CUT if t[-1] not in ENDS else SOUND)
        seen.add(r)
    return out


def repaired(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The rows that an audit leaves."""
    it, replay, out = iter(rows), Replay(), []
    for letter in audit:
        own, text = ("", "") if letter == "I" else next(it)
        if letter != "D":
            out.append((replay.role(letter, own), text))
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after damage, by ``crc32(conv_id:turn) % 20``: a row goes (0), loses
    its text (1) or its ``.!?`` (2), comes twice (3) or is the user's (4).

    Null roles and texts are one space, as are null ids and turns in the hash.  A row that goes stays as a
    row with a null role, so that its conversation is known."""
    require(conversations, ("conv_id", "turn", "role", "text"), "conversations")
    space = F.lit(" ")
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    c = c.withColumn("hit", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    c = c.select("conv_id", "turn", F.when(F.col("hit") != 0, role).alias("role"), F.when(F.col("hit") != 0, text).alias("text"), F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return c.drop("copy")


def _digests(rows: DataFrame) -> DataFrame:
    """Conversations of ``LONG`` rows at most, each in one task, which holds one at a time."""

    def one(conv: int | None, held: list[tuple]) -> tuple:
        there = [(r, x) for _, r, x in held if r is not None]
        turns = {t for t, r, _ in held if r is not None and t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults, initials = first_faults(there), "".join(r[:1] or " " for r, _ in there)
        cost, audit = cheapest(initials, faults)
        text = "\n".join(f"{r}:{x}" for r, x in repaired(there, audit))
        return (conv, gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, CUT)), illegal_pairs(initials), cost, audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # the conversation of the rows held
        kinds, names = [pa.int64()] * 7 + [pa.string()] * 2, [c.split()[0] for c in DIGEST.split(", ")]
        for b in chain(batches, [None]):
            out = []
            for conv, turn, role, text in [] if b is None else zip(*(b.column(i).to_pylist() for i in range(4))):
                if held and conv != now:
                    out.append(one(now, held))
                    held = []
                now = conv
                held.append((turn, role, text))
            if b is None and held:
                out.append(one(now, held))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "text").mapInArrow(run, DIGEST)


# Long conversations.  An insert is never part of a cheapest repair: without it and one neighbouring row
# the roles still fit (but for a lone s, which can go too), and two deletions cost less than an insert.  So
# each row has one letter, ways through a piece have one length, and pieces are put together like products
# of matrices: the least sum over the states between them.

PIECE = "conv_id long, piece long, length long, first string, last string, illegal long, cost array<long>, letters array<binary>"


def _stored(weights: list[int], n: int) -> tuple[list[int], list[bytes]]:
    """High digits and low digits of weights with ``n`` letters."""
    low = WIDE * n
    return [min(w >> low, NEVER) for w in weights], [(w & ((1 << low) - 1)).to_bytes((low + 7) // 8, "big") for w in weights]


def piece_weights(initials: list[str], faults: list[int], copies: list[int]) -> list[int]:
    """Weights of the cheapest ways over some rows from each state (a row of four) to each state.

    Of ``copies`` equal rows those after the first are duplicates, and all go where the first does not count
    (blank, duplicate)."""
    low = WIDE * sum(copies)
    ends = []
    for end in range(4):
        best, at = [0 if q == end else NEVER << low for q in range(4)], 0  # bits of the letters behind
        for c, fault, m in zip(reversed(initials), reversed(faults), reversed(copies)):
            stays = fault in (SOUND, CUT)
            gone = m - stays
            if gone:
                run = D * (((1 << (WIDE * gone)) - 1) // 7) << at
                best = [((DELETE * gone) << low) + run + b for b in best]
                at += WIDE * gone
            if stays:
                best = [min((cost << low) + (letter << at) + best[t] for cost, letter, t in edges(q, c, fault)) for q in range(4)]
                at += WIDE
        ends.append(best)
    return [ends[e][q] for q in range(4) for e in range(4)]


def _solved(pdf: pd.DataFrame) -> pd.DataFrame:
    """A piece from its rows."""
    pdf = pdf.sort_values("at")
    initials, copies = [r[:1] or " " for r in pdf.role], pdf.copies.tolist()
    n = sum(copies)
    cost, letters = _stored(piece_weights(initials, pdf.fault.tolist(), copies), n)
    row = (pdf.conv_id.iloc[0], pdf.piece.iloc[0], n, initials[0], initials[-1], illegal_pairs("".join(initials)) + n - len(copies), cost, letters)
    return pd.DataFrame([row], columns=[c.split()[0] for c in PIECE.split(", ")])


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """One piece from several that follow each other."""
    pdf = pdf.sort_values("piece")
    n, weights, last, illegal = 0, None, "", 0
    for r in pdf.itertuples():
        more = int(r.length)
        low = WIDE * (n + more)
        theirs = [(int(c) << low) + int.from_bytes(x, "big") for c, x in zip(r.cost, r.letters)]
        if weights is None:
            weights = theirs
        else:
            ours = [((w >> (WIDE * n)) << low) + ((w & ((1 << (WIDE * n)) - 1)) << (WIDE * more)) for w in weights]
            weights = [min(ours[4 * q + m] + theirs[4 * m + e] for m in range(4)) for q in range(4) for e in range(4)]
            illegal += last + r.first not in LEGAL
        n, last, illegal = n + more, r.last, illegal + int(r.illegal)
    row = (pdf.conv_id.iloc[0], pdf.piece.iloc[0] // FAN, n, pdf["first"].iloc[0], last, illegal, *_stored(weights, n))
    return pd.DataFrame([row], columns=[c.split()[0] for c in PIECE.split(", ")])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and audit of whole conversations."""
    for b in batches:
        for conv, n, illegal, cost, letters in zip(*(b.column(i).to_pylist() for i in range(5))):
            c, digits = min((cost[e], letters[e]) for e in (START, ASSISTANT))  # from the start to an end
            bits = np.unpackbits(np.frombuffer(digits, np.uint8))[-WIDE * n :].reshape(n, WIDE)
            audit = np.frombuffer(("?" + LETTERS).encode(), np.uint8)[bits @ np.array([4, 2, 1], np.uint8)].tobytes().decode()
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([illegal], pa.int64()), pa.array([c], pa.int64()), pa.array([audit])], ["conv_id", "illegal", "cost", "audit"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of what is left of each conversation, a row at a time."""
    now, h, replay = None, None, Replay()
    for b in chain(batches, [None]):
        out = []
        for conv, role, text, letter in [] if b is None else zip(*(b.column(i).to_pylist() for i in range(4))):
            if h is None or conv != now:
                if h is not None:
                    out.append((now, h.hexdigest()))
                now, h, replay = conv, hashlib.sha256(), Replay()
            else:
                h.update(b"\n")
            h.update(f"{replay.role(letter, role)}:{text}".encode("utf-8", "surrogatepass"))
        if b is None and h is not None:
            out.append((now, h.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string()))], ["id", "sha"])


def _pieced_digests(rows: DataFrame, size: int) -> DataFrame:
    """Conversations of any length: rows are ordered by ranges, pieces of ``size`` rows are solved by many
    tasks and put together ``FAN`` at a time.  Only the hash, which needs all that is left in order, streams
    through one task a conversation, which holds one row."""
    turns = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1).alias("span"), F.countDistinct("turn").alias("n"))
    gaps = turns.select(F.col("conv_id").alias("id"), F.coalesce(F.col("span") - F.col("n"), F.lit(0)).cast("long").alias("gaps"))
    deal = F.struct("row.turn", "row.role", F.substring("row.text", 1, 64))
    order = counted(rows.select("conv_id", F.struct("turn", "role", "text").alias("row")), ["conv_id"], "row", deal)
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    order = order.select("conv_id", "row.*", F.col("n").alias("copies"), F.col("below").alias("at")).withColumn("blank", trimmed == "").withColumn("cut", ~F.right(trimmed, F.lit(1)).isin(*ENDS))
    seen = order.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("at").alias("at")).select(F.col("conv_id").alias("id"), F.col("at").alias("fresh"))
    marked = order.join(seen, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("at") == F.col("fresh")), "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("fresh").isNull(), DUPLICATE).when(F.col("cut"), CUT).otherwise(SOUND)
    marked = settle(marked.select("conv_id", "at", "copies", "role", "text", fault.alias("fault"), F.floor(F.col("at") / size).cast("long").alias("piece")), "conversation-rows")

    pieces = settle(marked.drop("text").groupBy("conv_id", "piece").applyInPandas(_solved, PIECE), "conversation-pieces")
    most = pieces.agg(F.max("piece")).first()[0]
    while most:  # FAN pieces become one
        pieces = settle(pieces.groupBy("conv_id", F.floor(F.col("piece") / FAN)).applyInPandas(_joined, PIECE), "conversation-pieces")
        most //= FAN
    whole = settle(pieces.select("conv_id", "length", "illegal", "cost", "letters").mapInArrow(_decided, "conv_id long, illegal long, cost long, audit string"), "conversation-audits")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An audit in stretches of ``size`` letters."""
        for b in batches:
            for conv, audit in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k in range(0, len(audit), 1024 * size):
                    some = range(k, min(len(audit), k + 1024 * size), size)
                    yield pa.RecordBatch.from_arrays([pa.array([conv] * len(some), pa.int64()), pa.array([i // size for i in some], pa.int64()), pa.array([audit[i : i + size] for i in some])], ["id", "stretch", "letters"])

    letters = whole.select("conv_id", "audit").mapInArrow(stretches, "id long, stretch long, letters string")
    at = marked.where(F.col("fault").isin(SOUND, CUT)).join(letters, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("piece") == F.col("stretch")))
    kept = at.withColumn("letter", F.substring("letters", (F.col("at") % size + 1).cast("int"), F.lit(1))).where("letter <> 'D'")
    shas = kept.select("conv_id", "role", "text", "letter", "at").repartition("conv_id").sortWithinPartitions("conv_id", "at").drop("at").mapInArrow(_hashed, "id long, sha string")

    stays = F.col("fault").isin(SOUND, CUT)
    counts = (F.when(F.col("fault") == BLANK, F.col("copies")), F.when(F.col("fault") == DUPLICATE, F.col("copies")).when(stays, F.col("copies") - 1), F.when(F.col("fault") == CUT, 1))
    faults = marked.groupBy(F.col("conv_id").alias("id")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in zip(counts, ("blank", "duplicate", "truncated"))])
    out = whole
    for other in (gaps, faults, shas):
        out = out.join(other, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha", F.lit(nothing)).alias("repaired_sha256"))


def repair(conversations: DataFrame, most: int = LONG) -> DataFrame:
    """Damage (:func:`damage`), faults and cheapest repair of every conversation of
    ``conversations(conv_id, turn, role, text)``: a row each of ``conv_id``, ``gaps`` (turns that are
    missing between the first and the last), the first faults of rows (``blank``, ``duplicate``,
    ``truncated``), ``illegal`` pairs of neighbours, ``cost`` and ``audit`` of the repair, and the SHA-256
    of what is left.

    Rows are in order of turn (nulls first), then role and text; equal rows follow each other.  Null ids are
    one conversation; null roles and texts are one space.  A conversation without rows after damage has
    zeros, an empty audit and the hash of nothing; an empty table gives no rows; texts of any length count
    whole; other columns are left behind.  Conversations of more than ``most`` rows are repaired in pieces,
    with the same result."""
    rows = damage(conversations)
    kept = rows.where("role is not null")
    gone = rows.where("role is null").select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    sizes = kept.groupBy(F.col("conv_id").alias("id")).count().where(F.col("count") > most).select("id")
    sizes = settle(sizes, "long-conversations")
    if not sizes.limit(1).count():
        return _digests(kept.unionByName(gone))
    same = F.col("conv_id").eqNullSafe(F.col("id"))
    return _digests(kept.unionByName(gone).join(sizes, same, "left_anti")).unionByName(_pieced_digests(kept.join(sizes, same, "left_semi"), most))
