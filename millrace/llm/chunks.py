"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common
from millrace.llm.common import SubstringHash, column, mix

_GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_GEAR_BITS = 16


def chunk_ends(data: np.ndarray, average: int, least: int, most: int) -> np.ndarray:
    """Ends of the chunks of a byte string.

    The gear hash (shift left, add the byte's random value) is kept to its low 16 bits, so it depends on the last 16 bytes only and
    can be summed by doubling: windows of 1, 2, 4, 8, 16 bytes. A chunk ends where the hash's top bits are zero, but not before
    ``least`` bytes, and at ``most`` bytes anyway. Cuts depend on content alone, so an insertion moves only the chunks around it.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    gear = _GEAR[data]
    for width in (1, 2, 4, 8):
        shifted = gear.copy()
        shifted[width:] += gear[:-width] << np.uint32(width) if n > width else 0
        gear = shifted
    bits = max(1, int(average).bit_length() - 1)
    wanted = np.flatnonzero(((gear & np.uint32(0xFFFF)) >> np.uint32(_GEAR_BITS - bits)) == 0) + 1
    ends, last = [], 0
    for at in wanted.tolist():
        while at - last > most:
            last += most
            ends.append(last)
        if at - last >= least:
            ends.append(at)
            last = at
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return np.array(ends, np.int64)


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def chunks(documents: DataFrame, average: int, least: int, most: int) -> DataFrame:
    """``id``, ``row``, ``start``, ``size``, ``chunk`` (digest) of every chunk of (``id``, ``row``, ``text``)."""
    schema = T.StructType([
        documents.schema["id"], documents.schema["row"], T.StructField("start", T.LongType()), T.StructField("size", T.IntegerType()),
        T.StructField("chunk", T.LongType()),
    ])

    def cut(batches):
        hashes = SubstringHash()
        for batch in batches:
            texts = column(batch, "text")
            rows, starts, sizes, digests = [], [], [], []
            for i in range(len(texts)):
                data = np.frombuffer(_bytes(texts[i].as_py()), np.uint8)
                ends = chunk_ends(data, average, least, most)
                if len(ends):
                    begin = np.append(0, ends[:-1])
                    hashes.load(data)
                    rows.append(np.full(len(ends), i))
                    starts.append(begin)
                    sizes.append(ends - begin)
                    digests.append(hashes.spans(begin, ends))
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([
                    column(batch, "id").take(at), column(batch, "row").take(at), pa.array(np.concatenate(starts)),
                    pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(digests).view(np.int64)),
                ], names=schema.names)

    return documents.mapInArrow(cut, schema)


def drop_repeated_substrings(
    documents: DataFrame, raw_text: str = "raw_text", file_id: str = "fileId", average: int = 32, least: int = 16, most: int = 256,
    least_run: int = 100, texts: bool = True,
) -> DataFrame:
    """Document records without passages that occurred before, in an earlier record or earlier in the same one.

    Texts are cut as UTF-8 bytes into content-defined chunks (gear hash; ``average``, ``least`` and ``most`` bytes). A chunk is a
    repeat when its digest occurred at a smaller (id, row digest, start). Maximal runs of neighbouring repeats of at least
    ``least_run`` bytes are removed, shorter ones (common phrases) stay. First occurrences are combined before the shuffle, so a
    chunk shared by many records is no hot key; the join back can be split.

    Returns ``id``, ``digest``, ``n_bytes``, ``n_chunks``, ``n_repeated`` (chunks), ``n_removed`` (bytes), ``kept_sha256`` and, if
    ``texts``, ``kept_text`` (bytes cut inside a character are dropped). NULL and empty texts have no chunk and keep nothing. NULL
    ids order before others. Repeated rows with one id and text are one text: their chunks repeat only what came before. An empty
    table gives an empty result.
    """
    rows = common.records(documents, file_id, raw_text).withColumn("row", common.digest(F.col("text")))
    pieces = chunks(rows, average, least, most)
    place = F.struct("id", "row", "start")
    first = pieces.groupBy("chunk").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select("chunk", "first")
    repeats = pieces.join(first, "chunk").filter(~F.struct("id", "row", "start").eqNullSafe(F.col("first")))
    spans = repeats.groupBy("id", "row").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    spans = spans.select(F.col("id").alias("__id"), F.col("row").alias("__row"), "spans")
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row")), "left")
    joined = joined.select("id", "row", "text", F.col("spans.start").alias("starts"), F.col("spans.size").alias("sizes"))
    return _without(joined, average, least, most, least_run, texts)


def _without(joined: DataFrame, average: int, least: int, most: int, least_run: int, texts: bool) -> DataFrame:
    fields = [
        joined.schema["id"], T.StructField("digest", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_chunks", "n_repeated", "n_removed")),
        T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept_text", T.StringType())] if texts else []),
    ]
    schema = T.StructType(fields)

    def clean(batches):
        for batch in batches:
            source, starts, sizes = (column(batch, n) for n in ("text", "starts", "sizes"))
            out: list[tuple] = []
            for i in range(len(source)):
                data = _bytes(source[i].as_py())
                n_chunks = len(chunk_ends(np.frombuffer(data, np.uint8), average, least, most))
                begin = np.array(starts[i].as_py() or [], np.int64)
                order = np.argsort(begin)
                begin = begin[order]
                end = begin + np.array(sizes[i].as_py() or [], np.int64)[order]
                kept, last, removed = [], 0, 0
                if len(begin):
                    breaks = np.flatnonzero(begin[1:] != end[:-1])
                    for a, b in zip(begin[np.append(0, breaks + 1)].tolist(), end[np.append(breaks, len(end) - 1)].tolist()):
                        if b - a >= least_run:
                            kept.append(data[last:a])
                            removed += b - a
                            last = b
                kept.append(data[last:])
                left = b"".join(kept)
                out.append((len(data), n_chunks, len(begin), removed, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            columns = list(zip(*out)) or [()] * 6
            arrays = [column(batch, "id"), column(batch, "row"), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())]
            if texts:
                arrays.append(pa.array(columns[5], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return joined.mapInArrow(clean, schema)
