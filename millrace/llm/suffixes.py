"""Exact repeated substrings by distributed sorting of ranked positions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common
from millrace.llm.common import SubstringHash, column, mix

_SEED = 11
# Above twice the greatest length.
_RUN_SIZES = 4096


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass") if text else b"", np.uint8)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbouring values, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _positions(hashes: SubstringHash, n: int, length: int, first: int) -> tuple[np.ndarray, ...]:
    """The sampled positions of a string that was loaded, and the windows of ``length`` that each stands for.

    Each window is stood for by its leftmost substring of ``first`` bytes of least hash, which depends on the window's bytes alone:
    equal windows are stood for by equal substrings at the same distance. Returns position, first and last window start.
    """
    count = n - length + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 3
    short = (hashes.windows(first) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - first + 1, dtype=np.uint64)
    at = (_sliding_least(short, length - first + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[begin], begin, np.append(begin[1:], count) - 1


def _half(length: int, first: int) -> tuple[int, int]:
    """Lengths of the probes left and right of the first ranked bytes; every window holds the whole of one of them."""
    left = (length - first) // 2
    return left, length - first - left + 1


def _ranked(rows: DataFrame, length: int, first: int) -> DataFrame:
    """Positions with the rank pair of the first two rounds: the digest of ``first`` bytes (``low``) and of the bytes of all windows
    that the position stands for (``high``). ``place`` packs the position and how far the first and last window start before it;
    ``probes`` packs 16-bit digests of the bytes to the left and right. Positions of one text with an equal pair are given once, the
    earliest."""
    schema = T.StructType([
        T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), rows.schema["id"], rows.schema["row"],
        T.StructField("place", T.LongType()), T.StructField("probes", T.IntegerType()),
    ])
    left, right = _half(length, first)

    def rank(batches):
        hashes = SubstringHash(_SEED)
        for batch in batches:
            texts = column(batch, "text")
            held: list[tuple] = []
            for i in range(len(texts)):
                data = _bytes(texts[i].as_py())
                if len(data) < length:
                    continue
                hashes.load(data)
                at, begin, end = _positions(hashes, len(data), length, first)
                low = hashes.spans(at, at + first)
                before, after = at - begin, at - end
                high = mix(hashes.spans(begin, end + length) ^ mix((before * 1024 + after).astype(np.uint64)))
                _, once = np.unique(low ^ (high * np.uint64(3)), return_index=True)
                at, before, after = at[once], before[once], after[once]
                one = hashes.spans(np.maximum(at - left, 0), at) & np.uint64(0xFFFF)
                two = hashes.spans(at + first, np.minimum(at + first + right, len(data))) & np.uint64(0xFFFF)
                held.append((np.full(len(once), i), low[once], high[once], at << 20 | before << 10 | after, (one << np.uint64(16) | two).astype(np.uint32)))
            if held:
                row, low, high, place, probes = (np.concatenate(c) for c in zip(*held))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), column(batch, "id").take(take), column(batch, "row").take(take),
                    pa.array(place), pa.array(probes.view(np.int32)),
                ], names=schema.names)

    return rows.mapInArrow(rank, schema)


def _shared(run: np.ndarray, probe: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Rows whose probe another row of the run has too, looking at the rows ``among`` only."""
    _, kind, times = np.unique((run.astype(np.int64) << 16 | probe)[among], return_inverse=True, return_counts=True)
    found = np.zeros(len(run), bool)
    found[np.flatnonzero(among)] = times[kind] > 1
    return found


def _neighbours(sorted_rows: DataFrame, length: int, first: int) -> DataFrame:
    """One pass over sorted positions. Equal rank pairs are neighbours: all but the first are repeats (``open`` false). A first one
    stays open for the next round if another pair of its low rank has the same probe on a side, for the windows that hold this
    probe; others are unique and dropped. Where a partition begins or ends inside a low rank, its first ones stay open, which is
    always safe. Returns ``id``, ``row``, ``at``, ``before``, ``after``, ``open``."""
    schema = T.StructType([
        *sorted_rows.schema.fields[2:4], T.StructField("at", T.LongType()), T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType()),
        T.StructField("open", T.BooleanType()),
    ])
    half = _half(length, first)[0]

    def pass_over(batches):
        held, first_run = None, True

        def settle(table, complete):
            nonlocal first_run
            low, high, place, probes = (table.column(n).to_numpy() for n in ("low", "high", "place", "probes"))
            before, after = (place >> 10) & 1023, place & 1023
            same_low = low[1:] == low[:-1]
            repeat = np.append(False, same_low & (high[1:] == high[:-1]))
            run = np.cumsum(np.append(True, ~same_low)) - 1
            several = np.bincount(run, weights=~repeat)[run] > 1
            probes = probes.view(np.uint32).astype(np.int64)
            left = _shared(run, probes >> 16, several & ~repeat & (before >= half))
            right = _shared(run, probes & 0xFFFF, several & ~repeat & (after < half))
            edge = np.zeros(len(run), bool)
            if first_run:
                edge |= run == 0
                first_run = False
            if not complete:
                edge |= run == run[-1]
            left, right = left | edge, right | edge
            after = np.where(~right & ~repeat, np.maximum(after, half), after)
            before = np.where(~left & ~repeat, np.minimum(before, half - 1), before)
            take = np.flatnonzero(repeat | ((left | right) & (after <= before)))
            if len(take):
                chosen = table.select(["id", "row"]).take(pa.array(take)).combine_chunks()
                yield pa.RecordBatch.from_arrays([
                    *(chosen.column(n).combine_chunks() for n in ("id", "row")), pa.array((place >> 20)[take]), pa.array(before[take].astype(np.int32)),
                    pa.array(after[take].astype(np.int32)), pa.array(~repeat[take]),
                ], names=schema.names)

        for batch in batches:
            part = pa.Table.from_batches([batch])
            table = part if held is None else pa.concat_tables([held, part])
            low = table.column("low").to_numpy()
            cut = int(np.flatnonzero(low != low[-1])[-1]) + 1 if (low != low[-1]).any() else 0
            if cut:
                yield from settle(table.slice(0, cut), True)
            elif len(table) > 200_000:
                # A low rank of very many rows: what is there is settled, its first ones stay open.
                cut = len(table)
                first_run = True
                yield from settle(table, False)
                first_run = True
            held = table.slice(cut)
        if held is not None and len(held):
            yield from settle(held, False)

    return sorted_rows.mapInArrow(pass_over, schema)


def _windows(joined: DataFrame, length: int) -> DataFrame:
    """Digest of every window that an open position stands for; a window that a text repeats is given once, the earliest."""
    schema = T.StructType([T.StructField("window", T.LongType()), joined.schema["id"], joined.schema["row"], T.StructField("start", T.LongType())])

    def expand(batches):
        hashes = SubstringHash(_SEED)
        for batch in batches:
            texts, spans = column(batch, "text"), column(batch, "spans")
            held = []
            for i in range(len(texts)):
                places = spans[i].values
                at = places.field("at").to_numpy()
                begin = at - places.field("before").to_numpy()
                size = at - places.field("after").to_numpy() - begin + 1
                start = np.unique(np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
                hashes.load(_bytes(texts[i].as_py()))
                kinds, once = np.unique(hashes.spans(start, start + length), return_index=True)
                held.append((np.full(len(once), i), kinds, start[once]))
            if held:
                row, kinds, start = (np.concatenate(c) for c in zip(*held))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds.view(np.int64)), column(batch, "id").take(take), column(batch, "row").take(take), pa.array(start)], names=schema.names
                )

    return joined.mapInArrow(expand, schema)


def _covered(joined: DataFrame, length: int, texts: bool) -> DataFrame:
    """Removes, per text, the bytes of the repeated windows of other rounds and of those that repeat inside the text itself."""
    fields = [joined.schema["id"], T.StructField("row", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([*fields, *([T.StructField("kept_text", T.StringType())] if texts else [])])

    def clean(batches):
        hashes = SubstringHash(_SEED + 2)
        for batch in batches:
            source, runs = column(batch, "text"), column(batch, "runs")
            out: list[tuple] = []
            for i in range(len(source)):
                data = _bytes(source[i].as_py())
                n = len(data)
                edge = np.zeros(n + 1, np.int64)
                if runs[i].is_valid:
                    begin, size = np.divmod(runs[i].values.to_numpy(), _RUN_SIZES)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + size, -1)
                if n >= length:
                    hashes.load(data)
                    own = hashes.windows(length)
                    _, first = np.unique(own, return_index=True)
                    if len(first) < len(own):
                        later = np.ones(len(own), bool)
                        later[first] = False
                        later = np.flatnonzero(later)
                        np.add.at(edge, later, 1)
                        np.add.at(edge, later + length, -1)
                gone = np.cumsum(edge[:n]) > 0
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (n > 0 and bool(gone[0])))
                left = data[~gone].tobytes()
                out.append((n, int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            columns = list(zip(*out)) or [()] * 5
            arrays = [column(batch, "id"), column(batch, "row"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
            if texts:
                arrays.append(pa.array(columns[4], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return joined.mapInArrow(clean, schema)


def drop_repeated_spans(
    documents: DataFrame, raw_text: str = "raw_text", file_id: str = "fileId", length: int = 100, first: int = 18, texts: bool = True
) -> DataFrame:
    """Document records without the bytes covered by a ``length``-byte string that also starts earlier (smaller id, or same record).

    Prefix doubling on a sparse set of suffixes. Round one ranks positions by ``first`` bytes, round two by the pair of that rank and
    the rank of all bytes up to the threshold and beyond around them: Spark sorts the (rank, rank, record, position) rows by range,
    so that a rank shared by very many records is spread over tasks, and one pass over neighbours gives equal pairs the same rank,
    drops unique ones and marks repeats. The last round ranks single ``length``-byte strings where pairs still differ. Positions are
    sampled: every ``length``-byte string is stood for by one of its substrings, chosen by content, so equal strings meet.

    Returns ``id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` and, if ``texts``,
    ``kept_text`` (bytes cut inside a character are dropped). Texts are UTF-8 bytes; matches never cross records. NULL and empty
    texts keep nothing. NULL ids order before others; rows with one id are ordered by a digest of the text, and rows with the same
    id and text count as one text. An empty table gives an empty result.
    """
    if not 8 <= first < length <= 1000:
        raise ValueError("8 <= first < length <= 1000")
    rows = common.records(documents, file_id, raw_text)
    # The id alone tells records apart unless ids repeat; the digest would only widen the sorted rows.
    alone = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    rows = rows.withColumn("row", F.lit(0).cast("bigint") if alone else common.digest(F.col("text")))
    once = rows if alone else rows.dropDuplicates(["id", "row"])
    ranked = _ranked(once, length, first)
    order = ["low", "high", "id", "row", "place"]
    ordered = ranked.repartitionByRange(*order).sortWithinPartitions(*order)
    # Used twice; the sorted rows and the texts by record are each shuffled once and read again.
    marked = _neighbours(ordered, length, first)
    key = ["id", "row"]

    def named(frame, *columns):
        return frame.select(F.col("id").alias("__id"), F.col("row").alias("__row"), *columns)

    same = F.col("id").eqNullSafe(F.col("__id")) & F.col("row").eqNullSafe(F.col("__row"))
    still = marked.filter("open").groupBy(*key).agg(F.collect_list(F.struct("at", "before", "after")).alias("spans"))
    windows = _windows(once.join(named(still, "spans"), same).select("id", "row", "text", "spans"), length)
    # A record gives each window once and an open position gives dozens, so no window has a large share of the rows.
    by_window = Window.partitionBy("window").orderBy("id", "row", "start")
    later = windows.withColumn("place", F.dense_rank().over(by_window)).filter("place > 1")
    # Begin and size of a removed run in one number: half the bytes of two.
    run = (F.col("at") - F.col("before")) * _RUN_SIZES + F.col("before") - F.col("after") + length
    removed = marked.filter("NOT open").select(*key, run.alias("run"))
    removed = removed.unionByName(later.select(*key, (F.col("start") * _RUN_SIZES + length).alias("run")))
    by_row = removed.groupBy(*key).agg(F.collect_list("run").alias("runs"))
    joined = rows.join(named(by_row, "runs"), same, "left").select("id", "row", "text", "runs")
    return _covered(joined, length, texts).drop("row")
