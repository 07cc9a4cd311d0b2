"""Periodic runs of words: overlapping tiles per period octave, solved on their own, stitched by document and period."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common
from millrace.llm.common import blocks, column
from millrace.session import durable

# A run is kept from so many repetitions of its period, and from so many words.
REPETITIONS = 4
LEAST_WORDS = 6
# Documents start at multiples of this in a flat array, so that the boundaries of small octaves fall on their own grid.
_GRID = 64
_LONGEST_GRAM = 64
# The boundaries of a tile span four periods of its octave, and at least so many words.
_TILE_WORDS = 1024
_DENSE = 4


class _Block:
    """Words of several texts in flat arrays: exact numbers (``words``), and hashes of 1, 2, 4 ... consecutive words."""

    def __init__(self, texts: list[str | None]) -> None:
        split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        self.n = np.array([len(w) for w in split], np.int64)
        self.start = np.concatenate([[0], np.cumsum(-(-(self.n + 1) // _GRID) * _GRID)])
        size = int(self.start[-1])
        coded = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
        hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        numbers = coded.indices.to_numpy(zero_copy_only=False)
        at = np.repeat(self.start[:-1] - np.concatenate([[0], np.cumsum(self.n)[:-1]]), self.n) + np.arange(len(numbers))
        # No two fillers are equal.
        self.words = -1 - np.arange(size, dtype=np.int32)
        self.words[at] = numbers
        self.grams = {1: common.mix(np.arange(size, dtype=np.uint64))}
        if len(numbers):
            self.grams[1][at] = hashed[numbers]

    def gram(self, length: int) -> np.ndarray:
        if length not in self.grams:
            half = self.gram(length // 2)
            twice = half.copy()
            twice[: len(half) - length // 2] = common.mix(half[: len(half) - length // 2] * np.uint64(0x9E3779B97F4A7C15) + half[length // 2 :])
            self.grams[length] = twice
        return self.grams[length]


def _gram_words(octave: int) -> int:
    """Words that agree at a boundary and one period on, wherever a run of the octave has its first boundary."""
    return min(_LONGEST_GRAM, max(4, 2 << octave))


def _equal_grams(block: _Block, octave: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, boundary, period) wherever the words at a boundary recur one period of the octave later."""
    step, length = 1 << octave, _gram_words(octave)
    marks = block.gram(length)
    able = np.flatnonzero(block.n >= max(LEAST_WORDS, REPETITIONS * step))
    if step <= _GRID:
        spans = [(0, len(marks))] if len(able) else []
    else:
        spans = [(int(block.start[d]), int(block.start[d] + block.n[d])) for d in able]
    found = []
    for lo, hi in spans:
        rows = (hi - lo) // step
        if rows < 2:
            continue
        grid = marks[lo : lo + rows * step].reshape(rows, step)
        i, j = np.nonzero(grid[1:] == grid[:-1, :1])
        found.append((lo + i * step, step + j))
        # What lies behind the last whole row.
        rest = marks[lo + rows * step : hi]
        j = np.flatnonzero(rest == grid[-1, 0])
        found.append((np.full(len(j), lo + (rows - 1) * step), step + j))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    b, q = (np.concatenate(x) for x in zip(*found))
    d = np.searchsorted(block.start, b, side="right") - 1
    inside = (b + q + length <= block.start[d] + block.n[d]) & (REPETITIONS * q <= block.n[d])
    return d[inside], b[inside], q[inside]


def _without_multiples(block: _Block, octave: int, d: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which of the (document, boundary, period) stay once multiples of a shorter period are left out.

    Where the words behind a boundary have a period p under the octave for l words, a period q up to l - p that holds for 2q words has
    the greatest common divisor of both as a period too (Fine and Wilf), so it is no smallest period.
    """
    keep = np.ones(len(b), bool)
    if not len(b):
        return keep
    order = np.lexsort((q, b))
    edges = np.flatnonzero(np.append(True, np.diff(b[order]) != 0))
    sizes = np.diff(np.append(edges, len(b)))
    for e, n in zip(edges[sizes > _DENSE], sizes[sizes > _DENSE]):
        rows = order[e : e + n]
        p, at = int(np.diff(q[rows]).min()), int(b[rows[0]])
        if p >= 1 << octave:
            continue
        end = min(int(block.start[d[rows[0]]] + block.n[d[rows[0]]]), at + p + (4 << octave))
        differ = block.words[at : end - p] != block.words[at + p : end]
        same = int(differ.argmax()) if differ.any() else len(differ)
        keep[rows[q[rows] <= same]] = False
    return keep


def _tiles(block: _Block) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """(document, octave, first word, first boundary within, words, periods) of every tile in which a period may hold."""
    octave = 0
    while len(block.n) and REPETITIONS << octave <= block.n.max():
        d, b, q = _equal_grams(block, octave)
        keep = _without_multiples(block, octave, d, b, q)
        d, b, q = d[keep], b[keep], q[keep]
        step, core = 1 << octave, max(4 << octave, _TILE_WORDS)
        tile = (b - block.start[d]) // core
        order = np.lexsort((q, tile, d))
        d, tile, q = d[order], tile[order], q[order]
        edges = np.flatnonzero(np.append(True, (np.diff(d) != 0) | (np.diff(tile) != 0))) if len(d) else []
        for a, z in zip(edges, [*edges[1:], len(d)]):
            first = int(tile[a]) * core
            lo, hi = max(0, first - step), min(int(block.n[d[a]]), first + core + max(3 * step, 8) + 2 * step)
            at = int(block.start[d[a]])
            yield int(d[a]), octave, lo, first - lo, block.words[at + lo : at + hi], np.unique(q[a:z])
        octave += 1


def _primitive(root: np.ndarray) -> bool:
    """Whether the words of one period are not a shorter stretch repeated."""
    q, rest, r = len(root), len(root), 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            p = q // r
            if np.array_equal(root[:-p], root[p:]):
                return False
            while rest % r == 0:
                rest //= r
        r += 1
    return True


def solve_tile(words: np.ndarray, octave: int, boundary: int, periods: np.ndarray) -> list[tuple[int, int, int]]:
    """(period, start, end) of stretches in which words one period apart agree, found at the boundaries of a tile.

    The forward and the backward Z value of every boundary (how far the words from it, and before it, agree with those one period
    on) come from the mismatches next to it. A stretch counts where it goes on for a period behind a boundary; its ends are those of
    the tile where it goes beyond.
    """
    found = []
    core = max(4 << octave, _TILE_WORDS)
    for q in periods.tolist():
        same = words[:-q] == words[q:]
        at = np.arange(boundary, min(boundary + core, len(same)), 1 << octave)
        wrong = np.flatnonzero(~same)
        place = np.searchsorted(wrong, at)
        end = np.append(wrong, len(same))[place]
        start = np.append(-1, wrong)[place] + 1
        kept = end - at >= q
        for s, e in sorted(set(zip(start[kept].tolist(), end[kept].tolist()))):
            whole = s > 0 and e < len(same)
            if whole and e - s + q < max(LEAST_WORDS, REPETITIONS * q):
                continue
            if _primitive(words[s : s + q]):
                found.append((q, s, e))
    return found


def _key(row_id, text: str) -> bytes:
    """The same for rows with the same id and text."""
    return hashlib.blake2b(repr(row_id).encode() + b"\0" + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _exploded(rows: DataFrame) -> DataFrame:
    """A row for every document in which a period may hold (with ``id`` and ``text``) and one for each of its tiles."""
    schema = T.StructType([
        T.StructField("key", T.BinaryType()), rows.schema["id"], T.StructField("text", T.StringType()), T.StructField("octave", T.IntegerType()),
        T.StructField("first", T.LongType()), T.StructField("boundary", T.LongType()), T.StructField("words", T.BinaryType()),
        T.StructField("periods", T.ArrayType(T.LongType())),
    ])

    def run(batches):
        for batch in batches:
            for first, texts in blocks(batch):
                block, keys, tiles = _Block(texts), {}, []
                ids = column(batch, "id", first, len(texts))
                for d, octave, lo, boundary, words, periods in _tiles(block):
                    if d not in keys:
                        keys[d] = _key(ids[d].as_py(), texts[d])
                    tiles.append((keys[d], octave, lo, boundary, words.tobytes(), periods.tolist()))
                whole = list(keys)
                blank = [None] * len(whole)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.values(), pa.binary()), ids.take(pa.array(whole, pa.int64())), pa.array([texts[d] for d in whole], pa.string()),
                    pa.array(blank, pa.int32()), pa.array(blank, pa.int64()), pa.array(blank, pa.int64()), pa.array(blank, pa.binary()),
                    pa.array(blank, pa.list_(pa.int64())),
                ], names=schema.names)
                for at in range(0, len(tiles), 256):
                    key, octave, lo, boundary, words, periods = zip(*tiles[at : at + 256])
                    n = len(key)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key, pa.binary()), pa.nulls(n, ids.type), pa.nulls(n, pa.string()), pa.array(octave, pa.int32()), pa.array(lo, pa.int64()),
                        pa.array(boundary, pa.int64()), pa.array(words, pa.binary()), pa.array(periods, pa.list_(pa.int64())),
                    ], names=schema.names)

    return rows.mapInArrow(run, schema)


def _solved(tiles: DataFrame) -> DataFrame:
    """Fragments (``key``, ``period``, ``start``, ``end``) of the tiles; rows of documents pass."""
    schema = T.StructType([
        *tiles.schema.fields[:3], T.StructField("period", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                keys, octaves = part.column(0).to_pylist(), part.column(3).to_pylist()
                source, found = [], []
                for i, octave in enumerate(octaves):
                    if octave is None:
                        source.append(i)
                        found.append((None, None, None))
                        continue
                    lo = part.column(4)[i].as_py()
                    words = np.frombuffer(part.column(6)[i].as_buffer(), np.int32)
                    for q, s, e in solve_tile(words, octave, part.column(5)[i].as_py(), np.array(part.column(7)[i].as_py(), np.int64)):
                        source.append(i)
                        found.append((q, lo + s, lo + e))
                if source:
                    take = pa.array(source, pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        pa.array([keys[i] for i in source], pa.binary()), part.column(1).take(take), part.column(2).take(take),
                        *(pa.array([f[c] for f in found], pa.int64()) for c in range(3)),
                    ], names=schema.names)

    return tiles.mapInArrow(run, schema)


def stitched(fragments: DataFrame) -> DataFrame:
    """Runs (``key``, ``start``, ``length``, ``period``) from fragments of the same document and period that touch or overlap."""
    by = Window.partitionBy("key", "period").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = fragments.withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = opened.withColumn("run", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("key", "period", "run").agg(F.min("start").alias("start"), (F.max("end") - F.min("start") + F.col("period")).alias("length"))
    return joined.filter(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), REPETITIONS * F.col("period"))).select("key", "start", "length", "period")


def _result_schema(rows: DataFrame) -> T.StructType:
    run = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
    return T.StructType([
        rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType()),
    ])


def _plain(rows: DataFrame) -> DataFrame:
    """Results of the documents in which no period can hold; the others are left out."""
    schema = _result_schema(rows)

    def run(batches):
        for batch in batches:
            for first, texts in blocks(batch):
                block = _Block(texts)
                held = {t[0] for t in _tiles(block)}
                rest = [d for d in range(len(texts)) if d not in held]
                yield pa.RecordBatch.from_arrays([
                    column(batch, "id", first, len(texts)).take(pa.array(rest, pa.int64())), pa.array(block.n[rest], pa.int64()),
                    pa.array([[] for _ in rest], pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))),
                    pa.array([collapse(texts[d], []) for d in rest], pa.string()),
                ], names=schema.names)

    return rows.mapInArrow(run, schema)


def collapse(text: str | None, runs: list[tuple[int, int, int]]) -> str:
    """The words of a text joined by one space, without those that a run contains behind its first period."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
        words = [words[i] for i in kept.tolist()]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _collapsed(texts: DataFrame) -> DataFrame:
    schema = _result_schema(texts)

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                text, runs = part.column(names.index("text"))[0].as_py(), part.column(names.index("runs"))[0].as_py() or []
                listed = [(r["start"], r["length"], r["period"]) for r in runs]
                yield pa.RecordBatch.from_arrays([
                    part.column(names.index("id")), pa.array([len(text.encode("utf-8", "surrogatepass").split())], pa.int64()),
                    pa.array([runs], pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))),
                    pa.array([collapse(text, listed)], pa.string()),
                ], names=schema.names)

    return texts.mapInArrow(run, schema)


def periodic_runs(documents: DataFrame, raw_text: str = "raw_text", file_id: str = "fileId") -> DataFrame:
    """Maximal periodic runs of words of every document record, and its text with each run cut to its first period.

    Words are stretches without ASCII white space, numbered from 0. A run is a stretch with smallest period q (words q apart are equal)
    of at least ``REPETITIONS`` periods and ``LEAST_WORDS`` words that no neighbouring word extends. Every text is cut into overlapping
    tiles for each octave of periods (1, 2-3, 4-7, ...); a tile is kept where the words at one of its boundaries recur a period later,
    which holds for every run. Tiles are dealt to all tasks and solved alone; the fragments are shuffled by document and period and
    stitched where they overlap, so a run of any length is found whole. Work grows with n log n of a text, tiles of one text spread.

    Returns ``id``, ``n_words``, ``runs`` (array of ``start``, ``length``, ``period``, by start, then period) and ``collapsed`` (kept
    words joined by one space). A NULL, empty or blank text has no words and no runs and collapses to the empty text. NULL ids and
    repeated rows get a row each; other columns are not read; an empty table gives an empty result.
    """
    rows = common.records(documents, file_id, raw_text)
    # Rows with equal keys have equal texts, so their fragments are the same.
    solved = durable(_solved(_exploded(rows).repartition("key", "octave", "first")))
    texts = solved.filter(F.col("period").isNull()).select("key", "id", "text")
    runs = stitched(solved.filter(F.col("period").isNotNull()).select("key", "period", "start", "end"))
    listed = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    listed = listed.withColumn("runs", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))))
    return _plain(rows).unionByName(_collapsed(texts.join(listed, "key", "left")))
