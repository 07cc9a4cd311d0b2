"""Helpers of the text operators: record columns, row keys, flat byte blocks and substring hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.values import quoted

# Rows of one Arrow batch are worked on in blocks of about this many characters, whatever the batch size is.
BLOCK_CHARS = 2_000_000


def records(documents: DataFrame, file_id: str, raw_text: str, **more: str) -> DataFrame:
    """The id and text of document records under fixed names (``id``, ``text``), so that other columns cannot clash."""
    extra = [quoted(column).alias(name) for name, column in more.items()]
    return documents.select(quoted(file_id).alias("id"), quoted(raw_text).cast("string").alias("text"), *extra)


def id_type(documents: DataFrame, file_id: str) -> T.DataType:
    return documents.select(quoted(file_id)).schema.fields[0].dataType


def digest(text: Column) -> Column:
    """64-bit digest of a text; NULL and empty differ."""
    return F.xxhash64(text, text.isNull())


def drop_rows(documents: DataFrame, rejected: DataFrame, file_id: str, raw_text: str) -> DataFrame:
    """Rows of ``documents`` without those listed in ``rejected`` (``id``, ``digest``); NULL ids match NULL ids.

    The join strategy is left to Spark, which checks the size of the list.
    """
    marked = rejected.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"))
    return documents.join(
        marked, quoted(file_id).eqNullSafe(F.col("__id")) & (digest(quoted(raw_text).cast("string")) == F.col("__digest")), "left_anti"
    )


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of consecutive row ranges; a range ends once it holds ``limit`` characters."""
    texts = batch.column(batch.schema.get_field_index(column))
    first, held, size = 0, [], 0
    for i in range(len(texts)):
        value = texts[i].as_py()
        held.append(value)
        size += len(value) if value else 0
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def column(batch: pa.RecordBatch, name: str, first: int = 0, rows: int | None = None) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).slice(first, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


class SubstringHash:
    """Hashes of any substrings of a byte string from one running sum (polynomial modulo 2^64 over scrambled byte values).

    The powers grow with the longest string seen and are kept between strings.
    """

    def __init__(self, seed: int = 0) -> None:
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(seed))
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            n = max(2 * len(self.powers), n + 1)
            steps = np.full(n, _BASE, np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
            steps = np.full(n, _BASE_INVERSE, np.uint64)
            steps[0] = 1
            self.inverse = np.multiply.accumulate(steps)

    def load(self, data: np.ndarray) -> None:
        n = len(data)
        self._grow(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        """Hash of the substring of ``length`` bytes at every start."""
        n = len(self.sums) - length  # one more than the last start
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
