from __future__ import annotations

import random

import pytest

WORDS = "the of and river stone light under paper garden window small green morning after wheel copper silver letter".split()
#: Names that operators use inside; an input may have them too.
CLASHES = ("h", "fp", "row", "u", "v", "id", "rank", "range", "tail", "key", "c", "k", "copies", "node", "root", "anchor", "gone_lines", "left_text", "kept_id", "base", "host", "path")


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) + str(rng.randrange(40)) * (rng.random() < 0.3) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty, long, repeated and strange texts; ties in ids."""
    rng = random.Random(11)
    long = "\n".join(prose(rng, 40) for _ in range(150))
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, long), (6, "é ß 日本語 \U0001f600 <|endoftext|> don't 'tis"), (7, "x" * 5000)]
    rows += [(10 + i, prose(rng, 60) + "\n" + prose(rng, 60)) for i in range(12)]
    rows += [(40, rows[8][1]), (41, rows[8][1]), (41, rows[8][1]), (42, rows[9][1] + " end"), (None, "no id here at all"), (None, None)]
    return rows


@pytest.fixture(scope="session")
def make_docs(spark):
    """A ``documents`` table of (doc_id, text) rows, with columns of clashing names on demand."""
    from pyspark.sql import functions as F

    def make(rows, clashes: bool = False):
        df = spark.createDataFrame([(i, t, "en", "src", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumns({c: F.lit(c) for c in CLASHES}) if clashes else df

    return make
