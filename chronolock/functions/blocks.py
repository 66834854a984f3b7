"""Long series in blocks: each block has its neighbours' samples on either side, so a series of any length
spreads over tasks and a task holds one block."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Samples of a block.
BLOCK = 1 << 15


class Block:
    """Samples in order of place: ``own[0]`` to ``own[1]`` are the block's, the others lie round it.
    ``starts`` and ``ends`` say whether the series does, within reach."""

    def __init__(self, columns: Callable[[str], np.ndarray], at: slice, own: tuple[int, int], starts: bool, ends: bool) -> None:
        self._columns, self._at, self.own, self.starts, self.ends = columns, at, own, starts, ends

    def column(self, name: str) -> np.ndarray:
        """Numbers; nulls are NaN."""
        return self._columns(name)[self._at]


def _borders(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Where a row differs from the one before in one of the columns."""
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for n in names:
        c = table.column(n).combine_chunks()
        a, b = c.slice(1), c.slice(0, max(len(c) - 1, 0))
        new |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new |= pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def samples_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of samples ``k, v``: the row that each is of, its place and value, and whether it has one."""
    k, v = column.flatten().flatten()
    row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy())
    return row, k.to_numpy(), v.to_numpy(zero_copy_only=False).astype(float), v.is_valid().to_numpy(zero_copy_only=False)


def by_blocks(signal: DataFrame, keys: Sequence[str], halo: int, made: dict[str, str], run: Callable[[Block], Sequence[np.ndarray]], place: str = "i", block: int = BLOCK, *, only: str | None = None) -> DataFrame:
    """``signal`` with the columns ``made`` (name and type), which ``run`` gives for a block's own samples; NaN
    becomes null.  Rows where ``only`` is null are seen but don't come out.

    Places are whole numbers that follow each other within a series (``keys``); ``halo`` of them are seen on
    either side.  Only samples near a block's border are sent twice; a task streams over its blocks and
    holds one at a time."""
    block = max(block, 2 * halo, 1)
    fields = StructType([*signal.schema.fields, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in made.items())).fields])
    names, group = signal.columns, [*keys, "_block"]
    number = F.col(place).cast("long")
    dealt = signal.withColumn("_block", F.explode(F.sequence(F.floor((number - halo) / block), F.floor((number + halo) / block))))

    def solved(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        """All blocks of a table, each from one cut to the next."""
        held: dict[str, np.ndarray] = {}

        def column(name: str) -> np.ndarray:
            if name not in held:
                held[name] = table.column(name).to_numpy(zero_copy_only=False).astype(float)
            return held[name]

        places, first = table.column(place).to_numpy().astype(np.int64), table.column("_block").to_numpy() * block
        own, out = np.zeros(table.num_rows, bool), [np.full(table.num_rows, np.nan) for _ in made]
        for lo, hi in zip(cuts, cuts[1:]):
            at, start = places[lo:hi], int(first[lo])
            a, b = (int(x) for x in np.searchsorted(at, (start, start + block)))
            if a < b:
                own[lo + a : lo + b] = True
                given = run(Block(column, slice(lo, hi), (a, b), bool(at[0] > start - halo), bool(at[-1] < start + block - 1 + halo)))
                for o, x in zip(out, given):
                    o[lo + a : lo + b] = x
        if only is not None:
            own &= table.column(only).is_valid().to_numpy(zero_copy_only=False)
        result = table.select(names)
        for (name, kind), x in zip(made.items(), out):
            new = pa.array(x, mask=np.isnan(x))
            result = result.append_column(name, new if kind == "double" else new.cast(pa.int64()))
        return result.filter(pa.array(own))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []  # the last block, which may go on
        for b in chain(batches, [None]):
            if b is not None and not b.num_rows:
                continue
            if b is not None:
                edge = pa.Table.from_batches([*(x.slice(x.num_rows - 1) for x in open_[-1:]), b])
                cuts = _borders(edge, group) - (1 if open_ else 0)  # in b
                if not len(cuts):
                    open_.append(b)
                    continue
                whole, open_ = [*open_, b.slice(0, cuts[-1])], [b.slice(cuts[-1])]
            else:
                whole, open_ = open_, []
            table = pa.Table.from_batches(whole) if whole else None
            if table is not None and table.num_rows:
                yield from solved(table, np.concatenate(([0], _borders(table, group), [table.num_rows]))).to_batches()

    return dealt.repartition(*group).sortWithinPartitions(*group, place).mapInArrow(over, fields)
