"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vecspark.sources.files import checkpointed, scratch_folder

__all__ = ["byte_lengths", "byte_strings", "checkpointed", "flat", "free_name", "pieces", "scratch_folder", "table"]

#: Bytes of text that one numpy step works on.
PIECE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(batches: Iterable[pa.RecordBatch], text: int = 1, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the strings in column number `text` sum to limit bytes at most, or are one row."""
    for batch in batches:
        ends = np.cumsum(byte_lengths(batch.column(text)))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def byte_lengths(column: pa.Array) -> np.ndarray:
    return np.diff(flat(column)[1])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in a row, and where each string starts and the last one ends. A null has none."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def byte_strings(column: pa.Array) -> list[bytes]:
    """Each string in UTF-8; a null is empty."""
    raw, at = flat(column)
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
