"""SimHash near-duplicates: fingerprints, bit-sliced comparison inside buckets, connected groups."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.values import quoted
from millrace.llm import common
from millrace.llm.common import blocks, column
from millrace.llm.components import components
from millrace.session import durable

# Buckets with more fingerprints are keyed on further bits; see :func:`_bucketed`.
BUCKET_ROWS = 1024
_SMALL_RUN = 48
_LANES = 1 << 15


def shingle_hashes(words: list[bytes], shingle_words: int, seed: int) -> list[int]:
    """XXH64 of every run of ``shingle_words`` words; of all words where there are fewer."""
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    k = min(shingle_words, len(words))
    return [xxhash.xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts, ends[k - 1 :])]


def fingerprint(hashed: list[int]) -> int:
    """Signed 64-bit number whose bits are those set in more than half of the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    values = np.array(hashed, np.uint64)
    for part in range(0, len(values), 1 << 16):
        chunk = np.ascontiguousarray(values[part : part + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(chunk, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(values), bitorder="little")
    return int(bits.view(np.int64)[0])


def _fingerprint(text: str | None, shingle_words: int, seed: int) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return fingerprint(shingle_hashes(words, shingle_words, seed)) if words else 0


def fingerprints(documents: DataFrame, raw_text: str = "raw_text", file_id: str = "fileId", shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """``id``, ``digest`` and 64-bit ``fingerprint`` (signed long) of every document record.

    ASCII letters are lower-cased; words are runs without ASCII white space; shingles (repeats included) are hashed by XXH64; a bit
    is set when it is set in more than half of the hashes. Fewer words than a shingle: one shingle of all words. NULL texts and
    texts without a word: zero.
    """
    rows = common.records(documents, file_id, raw_text).withColumn("digest", common.digest(F.col("text")))
    schema = T.StructType([rows.schema["id"], rows.schema["digest"], T.StructField("fingerprint", T.LongType())])

    def score(batches):
        for batch in batches:
            for first, texts in blocks(batch):
                marks = pa.array([_fingerprint(t, shingle_words, seed) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "id", first, len(texts)), column(batch, "digest", first, len(texts)), marks], names=schema.names
                )

    return rows.mapInArrow(score, schema)


def _taken(mark: Column, bits: list[int]) -> Column:
    """The given bits of a fingerprint, gathered in order from runs of neighbouring bits."""
    if len(bits) == 64:
        return mark
    value, at, i = F.lit(0).cast("bigint"), 0, 0
    while i < len(bits):
        j = i
        while j + 1 < len(bits) and bits[j + 1] == bits[j] + 1:
            j += 1
        run = F.shiftrightunsigned(mark, bits[i]).bitwiseAND(F.lit((1 << (j - i + 1)) - 1))
        value = value.bitwiseOR(F.shiftleft(run, at))
        at, i = at + j - i + 1, j + 1
    return value


def _parts(bits: list[int], n: int) -> list[list[int]]:
    edges = [len(bits) * i // n for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:])]


def _paths(radius: int, depth: int) -> list[tuple[list[int], str]]:
    """Bits of the bucket key along every choice of ``depth`` blocks, and the name of the choice.

    Of radius + 1 blocks at least one has no differing bit; the rest is cut again in the same way, so two fingerprints within the
    radius agree on all bits of at least one path of any depth.
    """
    paths = [([], list(range(64)), "")]
    for _ in range(depth):
        paths = [
            (fixed + part, [b for b in rest if b not in part], f"{name}{i}")
            for fixed, rest, name in paths for i, part in enumerate(_parts(rest, radius + 1))
        ]
    return [(fixed, name) for fixed, _, name in paths]


def _keyed(distinct: DataFrame, paths: list[tuple[list[int], str]]) -> DataFrame:
    keys = [F.struct(F.lit(name).alias("path"), _taken(F.col("fingerprint"), sorted(fixed)).alias("bits")) for fixed, name in paths]
    return distinct.withColumn("key", F.explode(F.array(*keys))).select("id", "fingerprint", "key.path", "key.bits")


def _bucketed(distinct: DataFrame, radius: int) -> DataFrame:
    """Fingerprints with bucket keys. A bucket over BUCKET_ROWS is cut by further blocks until few bits are free, so its size has a
    bound that no data exceed, and no pair within the radius is lost."""
    depth, rows, done = 2, _keyed(distinct, _paths(radius, 2)), None
    while True:
        free = 64 - min(len(fixed) for fixed, _ in _paths(radius, depth))
        sizes = rows.groupBy("path", "bits").agg(F.count(F.lit(1)).alias("n"))
        hot = durable(sizes.filter(F.col("n") > BUCKET_ROWS).select("path", "bits"))
        if free <= 15 or hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        cold = rows.join(hot, ["path", "bits"], "left_anti")
        done = cold if done is None else done.unionByName(cold)
        kept = rows.join(hot, ["path", "bits"], "left_semi")
        finer = [(fixed, name) for fixed, name in _paths(radius, depth + 1)]
        key = F.array(*[F.struct(F.lit(name).alias("path"), _taken(F.col("fingerprint"), sorted(fixed)).alias("bits")) for fixed, name in finer])
        own = F.filter(key, lambda k: k["path"].startswith(F.col("path")))
        rows = kept.withColumn("key", F.explode(own)).select("id", "fingerprint", "key.path", "key.bits")
        depth += 1


def _planes(marks: np.ndarray) -> np.ndarray:
    """64 bit planes of fingerprints: bit i of plane b is bit b of fingerprint i, packed 64 fingerprints to a word."""
    lanes = -(-len(marks) // 64) * 64
    padded = np.zeros(lanes, np.uint64)
    padded[: len(marks)] = marks
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _beyond(differing, shape: tuple, radius: int) -> np.ndarray:
    """Lanes whose distance exceeds the radius (set bits).

    Difference planes are added in threes by a carry-save adder into bitwise counters of two planes; what overflows them, or makes
    them exceed the radius, is remembered. The block is abandoned as soon as all lanes exceed.
    """
    ones, twos, over = (np.zeros(shape, np.uint64) for _ in range(3))
    for b in range(0, 63, 2):
        x, y = differing(b), differing(b + 1)
        # ones + x + y = carry-save sum: a new ones plane and one carry of weight two.
        half = ones ^ x
        carry = (ones & x) | (half & y)
        ones = half ^ y
        over |= twos & carry if radius == 3 else np.uint64(0)
        fours = twos & carry
        twos = twos ^ carry
        over |= fours
        if radius < 3:
            over |= twos & ones if radius == 2 else (twos if radius == 1 else twos | ones)
        if b % 16 == 14 and (over == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
            break
    return over


def _near_pairs(marks: np.ndarray, radius: int):
    """Index pairs (i < j) within the radius, of one bucket, tile by tile."""
    planes = _planes(marks)
    words = planes.shape[1]
    everything, tile = np.uint64(0xFFFFFFFFFFFFFFFF), max(1, _LANES // max(1, words))
    for first in range(0, len(marks), tile):
        queries = marks[first : first + tile]

        def differing(b, queries=queries):
            wanted = np.where((queries >> np.uint64(b)) & np.uint64(1), everything, np.uint64(0))
            return planes[b][None, :] ^ wanted[:, None]

        over = _beyond(differing, (len(queries), words), radius)
        near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, : len(marks)]
        i, j = np.nonzero(near)
        i = i + first
        yield i[i < j], j[i < j]


def _forest(n: int, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks of index pairs (i < j) those (j, i) that join the same groups without a circle."""
    root, left, right = np.arange(n), [], []
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            least = root.copy()
            np.minimum.at(least, high, low)
            # Every root that moves does so by one of the pairs that lead to its least neighbour.
            fit, by = np.flatnonzero(least[high] == low), np.full(n, -1)
            by[high[fit]] = fit
            by = by[by >= 0]
            left.append(j[by])
            right.append(i[by])
            root = least
            while (root[root] != root).any():
                root = root[root]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _links(radius: int, id_field: T.StructField):
    def find(batches):
        def settle(ids, marks, runs):
            """Links of complete buckets, given their bounds."""
            sizes = np.diff(runs)
            left, right = [], []
            for a, b in zip(runs[:-1][sizes > _SMALL_RUN], runs[1:][sizes > _SMALL_RUN]):
                u, v = _forest(b - a, _near_pairs(marks[a:b], radius))
                left.append(a + u)
                right.append(a + v)
            u, v = _forest(len(marks), small_pairs(marks, runs, sizes))
            left.append(u)
            right.append(v)
            u, v = np.concatenate(left), np.concatenate(right)
            if len(u):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(u)), ids.take(pa.array(v))], names=["u", "v"])

        def small_pairs(marks, runs, sizes):
            """Near pairs of all small buckets at once."""
            small = np.flatnonzero((sizes > 1) & (sizes <= _SMALL_RUN))
            for shift in range(1, int(sizes[small].max()) if len(small) else 1):
                fit = small[sizes[small] > shift]
                spans = sizes[fit] - shift
                begin = np.repeat(runs[:-1][fit], spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
                for part in range(0, len(begin), _LANES):
                    i = begin[part : part + _LANES]
                    planes = _planes(marks[i] ^ marks[i + shift])
                    over = _beyond(lambda b, planes=planes: planes[b], planes.shape[1:], radius)
                    near = np.unpackbits((~over).view(np.uint8), bitorder="little")[: len(i)].astype(bool)
                    yield i[near], i[near] + shift

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            table = table.combine_chunks()
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            if cut:
                runs = np.concatenate([[0], np.flatnonzero(key[1:cut] != key[: cut - 1]) + 1, [cut]])
                ids = table.column("id").slice(0, cut).combine_chunks()
                yield from settle(ids, table.column("fingerprint").to_numpy()[:cut].view(np.uint64), runs)
            held = table.slice(cut)
        if held is not None and len(held):
            ids = held.column("id").combine_chunks()
            yield from settle(ids, held.column("fingerprint").to_numpy().view(np.uint64), np.array([0, len(held)]))

    return find


def near_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links (``u``, ``v``) that join all ``distinct`` fingerprints (``id``, ``fingerprint``) within the radius, over all buckets.

    A bucket gives a spanning forest of its near pairs, not all pairs: a pair within the radius is joined by a path of such pairs.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the radius is 0 to 3 bits")
    rows = _bucketed(distinct, radius)
    # One sortable number per bucket; two buckets that share it are only compared needlessly.
    rows = rows.select("id", "fingerprint", F.xxhash64("path", "bits").alias("key"))
    dealt = rows.repartition(F.col("key")).sortWithinPartitions("key", "id")
    schema = T.StructType([T.StructField("u", distinct.schema["id"].dataType), T.StructField("v", distinct.schema["id"].dataType)])
    return dealt.mapInArrow(_links(radius, distinct.schema["id"]), schema)


def near_duplicates(
    documents: DataFrame, raw_text: str = "raw_text", file_id: str = "fileId", radius: int = 3, shingle_words: int = 3, seed: int = 42
) -> DataFrame:
    """``id``, ``digest``, ``fingerprint`` and ``component`` of every document record.

    Records whose fingerprints differ in at most ``radius`` (0 to 3) bits are linked; ``component`` is the smallest id reachable.
    Equal fingerprints are compared once. Candidates share all bits of one of 16 bucket keys, which no pair within the radius
    misses; buckets are compared on vertical bit planes with carry-save counters, and a block ends once all its lanes exceed the
    radius. NULL and wordless texts have fingerprint zero and are linked like any other. A NULL id links nothing to itself but gets
    the component of its fingerprint (NULL if no record with an id shares it). Repeated rows share a component. An empty table gives
    an empty result.
    """
    marks = durable(fingerprints(documents, raw_text, file_id, shingle_words, seed))
    distinct = durable(marks.filter(F.col("id").isNotNull()).groupBy("fingerprint").agg(F.min("id").alias("id")))
    groups = components(near_links(distinct, radius))
    named = distinct.join(groups.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("fingerprint", F.coalesce("component", "id").alias("component"))
    return marks.join(named, "fingerprint", "left").select("id", "digest", "fingerprint", "component")


def keep_one_of_each(documents: DataFrame, raw_text: str = "raw_text", file_id: str = "fileId", radius: int = 3, shingle_words: int = 3) -> DataFrame:
    """One document record of each group of near duplicates, the one with the smallest id; all columns unchanged.

    Repeated rows of that id count as copies: one of them stays. Rows with a NULL id stay when no record with an id shares their
    fingerprint. An empty table stays empty.
    """
    return keep_least_of_each(documents, near_duplicates(documents, raw_text, file_id, radius, shingle_words), raw_text, file_id)


def keep_least_of_each(documents: DataFrame, groups: DataFrame, raw_text: str, file_id: str) -> DataFrame:
    """The rows whose id is the ``component`` of their group (``id``, ``digest``, ``component``), one of each id."""
    others = groups.filter((F.col("id") != F.col("component")) | (F.col("id").isNull() & F.col("component").isNotNull()))
    kept = common.drop_rows(documents, others.select("id", "digest").distinct(), file_id, raw_text)
    # Rows that share a kept id: few, found on the narrow frame; only they are compared again.
    twice = groups.filter(F.col("id") == F.col("component")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("__id"))
    twice = durable(twice)
    if twice.isEmpty():
        return kept
    same = quoted(file_id) == F.col("__id")
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates([file_id]))
