"""Personal data by bootstrapped contextual extraction.

Seeds are what fixed expressions find: emails, IP addresses, card and phone numbers, and digests in
hexadecimal as secrets.  The words round a mention are its lexical patterns: the two before, the two
after, and the one on either side.  Spark scores the graph of patterns and instances round by round: a
pattern is trusted for a kind if most of its different instances are known to be of it, and the other
instances of trusted patterns become known, if they look like known ones of the kind.  It ends when
nothing new is known.  Identifiers in trusted patterns that no expression found are the discoveries.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolock.llm.common import doc_texts, settle, slices

#: The kinds of base spans, then that of secrets, which are found by seeds and patterns only.
KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
ALL_KINDS = (*KINDS, "secret")
#: Rounds at most; they end when nothing new is known.
ROUNDS = 6
#: A pattern is trusted from so many different known instances, and from this share of its instances.
SUPPORT, CONFIDENCE = 3, 0.8
#: An instance is known from this belief, 1 - product of (1 - confidence) over its trusted patterns.
BELIEF = 0.8
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_RUN = re.compile(r"[+(]{0,2}[0-9]++(?:[ ()-]{1,2}[0-9]++)+")
#: Seeds of secrets: digests of 128, 160 and 256 bits in hexadecimal, with a digit and a letter.
_DIGEST = re.compile(r"(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])(?:[0-9a-f]+|[0-9A-F]+)")
_DIGEST_SIZES = (32, 40, 64)
_EDGE = "\"'`.,;:!?()[]{}<>=#$%&*|"
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of what the expressions find, leftmost and non-overlapping per kind."""
    out: list[tuple[int, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:  # the local part is the run of its characters before the sign, after the last match
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What may be an identifier and meets no span taken: runs of numbers that single spaces, hyphens or
    brackets join, with 6 digits or more; and words, without punctuation at their ends, that have an at
    sign, or 6 to 256 characters with 3 digits among them."""
    spans, out = sorted((s, e) for s, _, e in taken), []
    starts, ends, last = [s for s, _ in spans], [], 0
    for _, e in spans:
        last = max(last, e)
        ends.append(last)

    def free(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return not k or ends[k - 1] <= start

    for m in _RUN.finditer(text):
        if sum(c in "0123456789" for c in m[0]) >= 6 and free(m.start(), m.end()):
            out.append((m.start(), m.end()))
    runs_, at = list(out), 0
    first = [s for s, _ in runs_]
    while m := _MARK.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.end())
        at = end = stop.start() if stop else len(text)
        while start < end and text[start] in _EDGE:
            start += 1
        while start < end and text[end - 1] in _EDGE:
            end -= 1
        k = bisect_left(first, end)
        word = text[start:end]
        if (("@" in word and 3 <= len(word) <= 256) or (6 <= len(word) <= 256 and sum(c in "0123456789" for c in word) >= 3)) and free(start, end) and not (k and runs_[k - 1][1] > start):
            out.append((start, end))
    return sorted(out)


def is_digest(word: str) -> bool:
    return len(word) in _DIGEST_SIZES and _DIGEST.fullmatch(word) is not None


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a mention: the two words before, the two after, and one on either side
    (what is joined to it counts), in lower case, digits as 0."""
    before = text[max(0, start - 96) : start].split()[-2:]
    after = text[end : end + 96].split()[:2]
    plain = lambda words: re.sub("[0-9]", "0", " ".join(words).lower())
    found = [plain(before)[-60:] + " _" if before else "", "_ " + plain(after)[:60] if after else "", plain(before[-1:])[-40:] + " _ " + plain(after[:1])[:40] if before and after else ""]
    return [p for p in found if p]


def shape(word: str) -> str:
    """What characters an identifier has, and about how many: discoveries must be like known ones."""
    kinds = (("a", any(c.isalpha() for c in word)), ("0", any(c.isdigit() for c in word)), ("@", "@" in word), (".", "." in word), ("-", any(c in " -()" for c in word)))
    return "".join(k for k, there in kinds if there) + str(len(word).bit_length())


_ROW = "doc_id long, row long, base array<struct<start: long, kind: int, end: long>>, mentions array<struct<start: long, end: long, patterns: array<string>, instance: string, shape: string, kind: int>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    mention_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("patterns", pa.list_(pa.string())), ("instance", pa.string()), ("shape", pa.string()), ("kind", pa.int32())]))
    for b in slices(batches):
        bases, mentions = [], []
        for text in b.column(1).to_pylist():
            found = base_spans(text)
            every = [(s, e, k) for s, k, e in found] + [(s, e, SECRET if is_digest(text[s:e]) else -1) for s, e in candidates(text, found)]
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
            mentions.append([{"start": s, "end": e, "patterns": patterns(text, s, e), "instance": text[s:e].lower(), "shape": shape(text[s:e]), "kind": k} for s, e, k in every])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(bases, base_type), pa.array(mentions, mention_type)], ["doc_id", "row", "base", "mentions"])


def bootstrap(mentions: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, belief: float = BELIEF) -> tuple[DataFrame, DataFrame]:
    """``pattern, kind, trust`` of the trusted patterns, and ``instance, k`` of the instances that they make
    known, over ``mentions(pattern, instance, shape, kind)``, where kind is -1 if unknown.

    Repeated mentions count once; a pattern belongs to its best kind, the earlier listed on ties, and an
    instance to that of its strongest belief.  A discovery must have the shape of a known instance of its
    kind: patterns can't drift to other things."""
    edges = settle(mentions.where("pattern <> ''").groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.min("shape").alias("shape")), "pii-edges")
    all_of = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.where("kind >= 0").groupBy("instance").agg(F.max("kind").alias("k"), F.min("shape").alias("shape"))
    known, count = settle(seeds, "pii-known"), -1
    for _ in range(rounds):
        votes = edges.join(known.select("instance", "k"), "instance").groupBy("pattern", "k").agg(F.count("*").alias("s"))
        best = votes.groupBy("pattern").agg(F.max(F.struct("s", (-F.col("k")).alias("k"))).alias("b")).select("pattern", F.col("b.s").alias("s"), (-F.col("b.k")).alias("kind")).where(F.col("s") >= support)
        trusted = settle(best.join(all_of, "pattern").withColumn("trust", F.col("s") / F.col("n")).where(F.col("trust") >= confidence).select("pattern", "kind", "trust"), "pii-patterns")
        more = edges.where("kind < 0").drop("kind").join(trusted, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-6)))))).alias("belief"), F.min("shape").alias("shape")).where(F.col("belief") >= belief)
        like = known.select(F.col("k").alias("kind"), "shape").distinct()
        more = more.join(like, ["kind", "shape"]).groupBy("instance").agg(F.max(F.struct("belief", (-F.col("kind")).alias("k"))).alias("b"), F.min("shape").alias("shape")).select("instance", (-F.col("b.k")).alias("k"), "shape")
        known = settle(seeds.unionByName(more.join(seeds.select("instance"), "instance", "left_anti")), "pii-known")
        last, count = count, known.count()
        if count == last:
            break
    return trusted, known.select("instance", "k")


def find(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``doc_id``, ``base`` and ``added`` (arrays of ``start, kind, end`` in code points, sorted) for every
    row.

    ``added`` has the secrets that are seeds, and the mentions in trusted patterns whose instance is
    known.  Null text counts as empty and has no spans; texts of any length are read whole; rows that
    repeat have equal results; a null id stays null; ties fall to the kind listed first.  A discovery
    never meets a base span.  An empty table gives none; other columns of ``docs`` are not read.
    """
    rows = settle(doc_texts(docs).withColumn("row", F.xxhash64("doc_id", "text")).mapInArrow(_read, _ROW), "pii")
    mentions = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    trusted, known = bootstrap(mentions.select("pattern", "instance", "shape", "kind"), rounds, support, confidence)
    own = F.struct("start", "kind", "end")
    seeds = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*").where(F.col("kind") == SECRET).select("row", own.alias("span"))
    new = mentions.where("kind < 0").drop("kind").join(trusted, "pattern").join(known, "instance").where("kind = k").select("row", own.alias("span"))
    new = seeds.unionByName(new).groupBy(F.col("row").alias("in_row")).agg(F.array_sort(F.collect_set("span")).alias("added"))
    return rows.join(new, F.col("row") == F.col("in_row"), "left").select("doc_id", "base", F.coalesce("added", F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)")).alias("added"))
