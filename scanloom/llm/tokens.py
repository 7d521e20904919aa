"""Encoding of a corpus with a public tokenizer, as Spark operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.bpe import StreamDecoder, encoder, load_ranks, tokenizer_path


def encode_column(df: DataFrame, key: str, field: str, path: str | None = None, out: str = "ids") -> DataFrame:
    """(``key``, ``out``): the token ids of ``field``, an array of int.

    ``path`` is the vocabulary file (token and rank per line), on every
    executor; by default that of byte_bpe_50k. No special tokens: their strings
    are ordinary text. Null and empty texts give an empty list. One row per
    input row, in place; no shuffle. Other columns are not read.
    """
    path = path or tokenizer_path()
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, sizes = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            for lo, hi in _slices(sizes):
                part = pa.ListArray.from_arrays(pa.array((offsets[lo : hi + 1] - offsets[lo]).astype(np.int32)), pa.array(ids[offsets[lo] : offsets[hi]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), part], names=[key, out])

    return df.select(F.col(key), F.col(field).cast("string")).mapInArrow(run, f"`{key}` {key_type}, `{out}` array<int>")


def _slices(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` ids each."""
    lo, total = 0, 0
    for k, s in enumerate(sizes):
        if k > lo and total + s > most:
            yield lo, k
            lo, total = k, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)


def count_tokens(df: DataFrame, field: str, path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of token ids of ``field`` in ``out``; 0 for null and empty texts. No shuffle."""
    path = path or tokenizer_path()

    @F.pandas_udf("long")
    def count(texts):
        import pandas as pd

        return pd.Series(encoder(path).count([t or "" for t in texts]))

    return df.withColumn(out, count(F.col(field).cast("string")))


def decode_column(df: DataFrame, key: str, ids: str, path: str | None = None, out: str = "text") -> DataFrame:
    """(``key``, ``out``): the text of a list of ids, decoded as a stream. A null list gives null."""
    path = path or tokenizer_path()

    @F.pandas_udf("string")
    def decode(lists):
        ranks = load_ranks(path)

        def one(ids):
            if ids is None:
                return None
            d = StreamDecoder(ranks)
            return d.feed(ids.tolist()) + d.close()

        return lists.map(one)

    return df.select(F.col(key), decode(F.col(ids)).alias(out))
