"""Helpers shared by the training-data operators: tables, scratch space, word splitting."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ..functions.scratch import materialised as stored  # noqa: F401
from ..functions.scratch import scratch_dir  # noqa: F401

#: A-Z in lower case, all other bytes as they are. Words are what bytes.split() gives: it splits at
#: space and tab to carriage return, no more.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def has_marks(text: bytes) -> bool:
    """Whether a text has any character of U+0300 to U+037F: all marks that compose with ASCII letters are among them.

    Some compose with a small letter alone, so a text with marks isn't lower-cased before it is composed.
    """
    return b"\xcc" in text or b"\xcd" in text


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers, so that close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def chunks_by_size(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to about ``limit``."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def ship_by_value(name: str) -> None:
    """Send a module's functions to Python workers by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship_by_value(__name__)
