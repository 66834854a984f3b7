"""URL filters by a sort-merge range join.

A url's host is reversed label by label (``com.example.www.``), so a rule's host and all its subdomains
are one interval of keys.  Rules and urls are dealt to the same ranges of keys and sorted; a sweep keeps
a stack of the rules whose interval it is in, and under each host the paths as nested prefixes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolock.llm.common import parts, require

#: Rows whose keys are read to cut the ranges, for each of them; they decide balance, never results.
SAMPLE = 64
#: Code points of keys and paths that cuts compare.
CUT = 256
RULES = "host string, path string, verdict string"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Cut = tuple[str, str, int]


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each with a dot behind it: a host's key is a prefix of its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def place(cuts: Sequence[Cut], key: str, path: str, salt: int) -> int:
    """The range of a url."""
    return bisect_right(cuts, (key[:CUT], path[:CUT], salt))


def reach(cuts: Sequence[Cut], key: str) -> tuple[int, int]:
    """The first and last range that may hold a url whose key starts with ``key``."""
    k = key[:CUT]
    return bisect_right(cuts, (k, "", -1)), bisect_right(cuts, k, key=lambda c: c[0][: len(k)])


class Paths:
    """The rules of one host: the longest path that a path starts with, by the nearest smaller one and
    the prefixes it is nested in."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        best: dict[str, str] = {}
        for path, verdict in rules:
            best[path] = max(verdict, best.get(path, ""))  # block wins where a rule is given both ways
        self.paths = sorted(best)
        self.verdicts = [best[p] for p in self.paths]
        self.outer: list[int] = []
        open_: list[int] = []
        for i, p in enumerate(self.paths):
            while open_ and not p.startswith(self.paths[open_[-1]]):
                open_.pop()
            self.outer.append(open_[-1] if open_ else -1)
            open_.append(i)

    def longest(self, path: str) -> tuple[str, str] | None:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        return (self.paths[i], self.verdicts[i]) if i >= 0 else None


class Sweep:
    """Rows in order of range and key, rules before urls of one key."""

    def __init__(self) -> None:
        self.range: int | None = None
        self.stack: list[list] = []  # key, host, rules or Paths

    def _enter(self, rng: int, key: str) -> None:
        if rng != self.range:
            self.range, self.stack = rng, []
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, rng: int, key: str, host: str, path: str, verdict: str) -> None:
        self._enter(rng, key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append([key, host, []])
        self.stack[-1][2].append((path, verdict))

    def url(self, rng: int, key: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule and its verdict; of equally long ones that of the longer host."""
        self._enter(rng, key)
        best: tuple[str | None, str | None] = (None, None)
        most = -1
        for node in self.stack:
            if isinstance(node[2], list):
                node[2] = Paths(node[2])
            found = node[2].longest(path)
            if found is not None and len(node[1]) + len(found[0]) >= most:
                most = len(node[1]) + len(found[0])
                best = (node[1] + found[0], found[1])
        return best


def _cuts(urls: DataFrame, ranges: int) -> list[Cut]:
    """Evenly spaced urls of a sample, of some ``SAMPLE`` rows a range at most."""
    n = urls.count()
    if not n or ranges < 2:
        return []
    share = min(1.0, SAMPLE * ranges / n)
    rows = urls.select(F.substring("key", 1, CUT), F.substring("path", 1, CUT), "salt")
    seen = sorted(tuple(r) for r in (rows.sample(share, 7) if share < 1 else rows).collect())
    return sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}) if seen else []


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url)``, by the rules
    ``(host, path, verdict)``: a rule fits its host and all subdomains where the url's path starts with
    the rule's; the longest (host and path together) wins.

    ``rule`` is host and path, null where none fits; then the verdict is ``default``.  Of equally long
    rules the longer host wins; of one rule given both ways ``block``.  Null urls, and those without
    ``://``, have an empty host and path, which no rule fits.  Rules with a null host or verdict don't
    count; their null paths are empty.  Repeated rows, null ids and very long urls are kept and judged as
    they are; an empty table gives no rows; other columns are left behind.

    A url goes to one range, and a hot host or url is dealt to several by path and row; a rule goes to
    every range that its interval meets.  Each task streams over its sorted rows and holds one stack.
    """
    spark = pages.sparkSession
    require(pages, ("page_id", "url"), "pages")
    require(rules, ("host", "path", "verdict"), "rules")
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("salt", F.xxhash64("page_id").bitwiseAND(F.lit(0x7FFFFFFF)))
    given = rules.where("host is not null and host <> '' and verdict is not null").select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    given = given.withColumn("key", host_key(F.col("host")))
    cuts = _cuts(urls.select("key", "path", "salt"), parts(spark))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, high = zip(*(reach(cuts, k) for k in b.column(0).to_pylist())) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["key", "host", "path", "verdict", "low", "high"])

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [place(cuts, *x) for x in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("key", "path", "salt")))]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[b.column(b.schema.names.index(c)) for c in ("key", "host", "path", "page_id")]], ["range", "key", "host", "path", "page_id"])

    ours = urls.mapInArrow(ranged, "range int, key string, host string, path string, page_id long").withColumn("verdict", F.lit(None).cast("string"))
    theirs = given.select("key", "host", "path", "verdict").mapInArrow(reached, "key string, host string, path string, verdict string, low int, high int")
    theirs = theirs.select(F.explode(F.sequence("low", "high")).alias("range"), "key", "host", "path", F.lit(None).cast("long").alias("page_id"), "verdict")
    both = theirs.withColumn("url", F.lit(False)).unionByName(ours.withColumn("url", F.lit(True)))
    dealt = both.repartitionByRange(max(1, len(cuts) + 1), "range").sortWithinPartitions("range", "key", "url", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep()
        for b in batches:
            out: list[tuple] = []
            for rng, key, host, path, page, verdict, url in zip(*(b.column(i).to_pylist() for i in range(7))):
                if url:
                    rule, says = sweep.url(rng, key, path)
                    out.append((page, host, path, rule, says or default))
                else:
                    sweep.rule(rng, key, host, path, verdict)
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.string()] * 4))], ["page_id", "host", "path", "rule", "verdict"])

    return dealt.select("range", "key", "host", "path", "page_id", "verdict", "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
