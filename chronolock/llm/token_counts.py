"""Token counts by map-side two-tier lookup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolock.llm.common import doc_texts, slices
from chronolock.llm.pretokens import encoder, frequent, token_counts


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, sample_rows: int = 3000) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` for every row, whatever its id.

    A broadcast table (bounded) has the lengths of frequent pre-tokens; the rest go through a cache
    in each worker.  Null and empty texts have 0 tokens; a text of any length is counted whole.
    """
    path = path or default_path()
    texts = doc_texts(docs)
    known = texts.sparkSession.sparkContext.broadcast(frequent(texts, path, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in slices(batches):
            n = token_counts(b.column(1).to_pylist(), encode, known.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(n > np.int64(limit))], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
