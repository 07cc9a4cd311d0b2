"""Near copies by Jaccard similarity of word shingles: SimHash fingerprints and min-hash bands find candidates, exact shingle sets decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common
from millrace.llm.common import blocks, column
from millrace.llm.components import components
from millrace.llm.simhash import fingerprint, keep_least_of_each, near_links, shingle_hashes
from millrace.session import durable

# A pair at similarity s shares a band's key with chance s^ROWS, and some key with chance 1 - (1 - s^ROWS)^BANDS: 0.975 at 0.8.
BANDS = 20
ROWS = 8
# Estimates from BANDS * ROWS minima have a deviation of 0.032 at 0.8; pairs this far under the bound are not read as texts.
_MARGIN = 0.15
_PART = 256
# Contents of a bucket that are held at once as bit planes, and contents compared with them at a time.
ASKING = 4096
_TILE = 256


def _draws(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def _shingle_set(words: list[bytes], shingle_words: int, seed: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(words, shingle_words, seed), np.uint64))


def minima(hashes: np.ndarray, draws: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Least value of each of BANDS * ROWS hash functions over a set of shingles, 32 bits each."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for part in range(0, len(hashes), _PART):
        # A product alone keeps low bits low; the scramble makes the order of every function its own.
        mixed = hashes[part : part + _PART, None] * draws[0][None, :]
        mixed ^= mixed >> np.uint64(32)
        mixed *= draws[1][None, :] | np.uint64(1)
        np.minimum(least, mixed.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(documents: DataFrame, raw_text: str, file_id: str, shingle_words: int, seed: int) -> DataFrame:
    """``id``, ``digest``, ``content`` (64-bit digest of the lower-cased words), ``signature`` (minima) and ``fingerprint`` (SimHash of
    the shingles, repeats included); the last two are NULL without a word."""
    rows = common.records(documents, file_id, raw_text).withColumn("digest", common.digest(F.col("text")))
    schema = T.StructType([
        rows.schema["id"], rows.schema["digest"], T.StructField("content", T.LongType()), T.StructField("signature", T.BinaryType()),
        T.StructField("fingerprint", T.LongType()),
    ])

    def score(batches):
        draws = _draws(seed)
        for batch in batches:
            for first, texts in blocks(batch):
                content, marks, prints = np.zeros(len(texts), np.uint64), [], []
                for i, text in enumerate(texts):
                    words = _words(text)
                    content[i] = xxhash.xxh3_64_intdigest(b" ".join(words), seed)
                    hashed = shingle_hashes(words, shingle_words, seed) if words else []
                    marks.append(minima(np.unique(np.array(hashed, np.uint64)), draws).tobytes() if words else None)
                    prints.append(fingerprint(hashed) if words else None)
                yield pa.RecordBatch.from_arrays([
                    column(batch, "id", first, len(texts)), column(batch, "digest", first, len(texts)),
                    pa.array(content.view(np.int64)), pa.array(marks, pa.binary()), pa.array(prints, pa.int64()),
                ], names=schema.names)

    return rows.mapInArrow(score, schema)


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _band_keys(batches):
    for batch in batches:
        content = batch.column(0).to_numpy()
        marks = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), marks.shape[:2])
        for r in range(ROWS):
            key = common.mix((key ^ marks[:, :, r]) + np.uint64(0x9E3779B97F4A7C15))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(content, BANDS)), pa.array(np.ascontiguousarray(key).view(np.int64).ravel())], names=["content", "key"]
        )


def fingerprint_pairs(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (``u``, ``v``) of contents whose SimHash fingerprints differ in at most ``radius`` bits, as many as join them all.

    Contents of one fingerprint meet the least of them; different fingerprints are compared on bit planes inside the buckets of their
    blocks (:func:`millrace.llm.simhash.near_links`), each by its least content.
    """
    marked = distinct.filter(F.col("fingerprint").isNotNull()).select("content", "fingerprint")
    first = durable(marked.groupBy("fingerprint").agg(F.min("content").alias("id")))
    same = marked.join(first, "fingerprint").filter(F.col("content") != F.col("id")).select(F.col("content").alias("u"), F.col("id").alias("v"))
    return same.unionByName(near_links(first, radius))


def _verified(pairs: DataFrame, distinct: DataFrame, rows: DataFrame, similarity: float, shingle_words: int, seed: int) -> DataFrame:
    """The pairs (``u``, ``v``: contents) whose shingle sets have at least the similarity."""

    def estimate(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            near = pa.array((a == b).mean(axis=1) >= similarity - _MARGIN)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["u", "v"])

    def decide(batches):
        for batch in batches:
            left, right, held = batch.column(2), batch.column(3), {}
            near = np.zeros(batch.num_rows, bool)
            ends = batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                a = _shingle_set(_words(left[i].as_py()), shingle_words, seed)
                if ends[i] not in held:
                    held = {ends[i]: _shingle_set(_words(right[i].as_py()), shingle_words, seed)}
                b = held[ends[i]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                near[i] = both >= similarity * (len(a) + len(b) - both) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(near)), batch.column(1).filter(pa.array(near))], names=["u", "v"])

    marks = distinct.select("content", "signature")
    a, b = marks.toDF("u", "a"), marks.toDF("v", "b")
    likely = pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(estimate, "u bigint, v bigint")
    likely = durable(likely)
    ends = likely.select(F.col("u").alias("content")).union(likely.select(F.col("v").alias("content"))).distinct()
    wanted = distinct.join(ends, "content", "left_semi").select("content", "digest")
    texts = rows.join(wanted, "digest").select("content", "text").dropDuplicates(["content"])
    a, b = texts.toDF("u", "a"), texts.toDF("v", "b")
    return durable(likely.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(decide, "u bigint, v bigint"))


def far(differing, planes: int, shape: tuple, radius: int) -> np.ndarray:
    """Lanes (set bits) in which more than ``radius`` of the difference planes are set.

    Planes are added in pairs by a carry-save adder into bitwise counters, whose planes have weights 1, 2, 4 ...; every 32 planes the
    counters are held against the radius, and the block is abandoned once all its lanes exceed it.
    """
    counters = [np.zeros(shape, np.uint64) for _ in range(planes.bit_length())]
    over = np.zeros(shape, np.uint64)
    for b in range(0, planes, 2):
        x, y = differing(b), differing(b + 1)
        half = x ^ y
        carry = (x & y) | (counters[0] & half)
        counters[0] ^= half
        for w in range(1, len(counters)):
            counters[w], carry = counters[w] ^ carry, counters[w] & carry
        if b % 32 == 30 or b + 2 >= planes:
            over[:], same = 0, np.full(shape, 0xFFFFFFFFFFFFFFFF, np.uint64)
            for w in reversed(range(len(counters))):
                if radius >> w & 1:
                    same &= counters[w]
                else:
                    over |= same & counters[w]
                    same &= ~counters[w]
            if (over == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
                break
    return over


def _sketch(marks: np.ndarray) -> np.ndarray:
    """Last bit of every minimum, one row per content."""
    return (marks & np.uint32(1)).astype(np.uint8)


def _lanes(bits: np.ndarray) -> np.ndarray:
    """Bit planes of sketches: bit i of plane b is bit b of sketch i, packed 64 sketches to a word."""
    padded = np.zeros((-(-len(bits) // 64) * 64, bits.shape[1]), np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little").view(np.uint64)


class _Bucket:
    """Contents of one bucket that ask for links, and what is known of the groups there."""

    def __init__(self, similarity: float) -> None:
        self.similarity, self.radius = similarity, radius_of(similarity)
        self.contents, self.owns, self.sets, self.bits, self.planes, self.root = [], [], [], [], None, {}

    def group(self, own: int) -> int:
        while (up := self.root.get(own, own)) != own:
            self.root[own] = self.root.get(up, up)
            own = up
        return own

    def compare(self, contents, owns, sets, bits) -> list[tuple[int, int]]:
        """Links between the asking contents and those given, no more than it takes to join their groups."""
        if not self.contents or not len(contents):
            return []
        if self.planes is None:
            self.planes = _lanes(np.array(self.bits))
        everything, found = np.uint64(0xFFFFFFFFFFFFFFFF), []
        for first in range(0, len(contents), _TILE):
            asked = bits[first : first + _TILE]

            def differing(b, asked=asked):
                return self.planes[b][None, :] ^ np.where(asked[:, b] == 1, everything, np.uint64(0))[:, None]

            over = far(differing, self.planes.shape[0], (len(asked), self.planes.shape[1]), self.radius)
            near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, : len(self.contents)]
            for i in range(first, first + len(asked)):
                options = [j for j in np.flatnonzero(near[i - first]).tolist() if self.group(self.owns[j]) != self.group(owns[i])]
                if not options:
                    continue
                sizes = np.array([len(self.sets[j]) for j in options])
                pooled = np.concatenate([self.sets[j] for j in options])
                at = np.minimum(np.searchsorted(sets[i], pooled), len(sets[i]) - 1)
                both = np.add.reduceat((sets[i][at] == pooled).astype(np.int64), np.cumsum(sizes) - sizes)
                close = both >= self.similarity * (len(sets[i]) + sizes - both) - 1e-9
                for j in np.array(options)[close].tolist():
                    a, b = self.group(self.owns[j]), self.group(owns[i])
                    if a != b:
                        self.root[max(a, b)] = min(a, b)
                        found.append((contents[i], self.contents[j]))
        return found

    def ask(self, contents, owns, sets, bits) -> None:
        self.contents += contents
        self.owns += owns
        self.sets += sets
        self.bits += list(bits)
        self.planes = None


def radius_of(similarity: float) -> int:
    """Differing bits of two sketches that a pair of the similarity exceeds with a chance under 1e-8 (six deviations)."""
    n, p = BANDS * ROWS, (1 - similarity) / 2
    return int(n * p + 6 * (n * p * (1 - p)) ** 0.5) + 1


def _bucket_links(placed: DataFrame, distinct: DataFrame, rows: DataFrame, similarity: float, shingle_words: int, seed: int) -> DataFrame:
    """Links (``u``, ``v``) between contents of a bucket that are in different groups (``own``) and have at least the similarity.

    Each bucket with several groups is sorted into a task. The contents apart from the group of its least one (``top``) are held as
    bit planes of one-bit sketches, at most ``ASKING`` of them in a task; those of a larger bucket are dealt to blocks, and each block
    meets the whole bucket. All others pass by in tiles: distances are counted on the planes, exact shingle sets decide what stays,
    and only the links that join two groups are given, so there are fewer links than contents.
    """
    apart = F.col("own") != F.col("top")
    mixed = placed.groupBy("key").agg(F.count(F.when(apart, 1)).alias("asking")).filter("asking > 0")
    mixed = mixed.select("key", F.ceil(F.col("asking") / ASKING).cast("int").alias("blocks"))
    dealt = placed.join(mixed, "key").withColumn("asks", F.when(apart, F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int")))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = durable(dealt.select("key", "block", "content", "own", F.coalesce(F.col("asks") == F.col("block"), F.lit(False)).alias("asks")))
    wanted = distinct.join(dealt.select("content").distinct(), "content", "left_semi").select("content", "digest", "signature")
    texts = rows.join(wanted, "digest").select("content", "signature", "text").dropDuplicates(["content"])

    def sets(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                held = _shingle_set(_words(part.column(2)[0].as_py()), shingle_words, seed).tobytes()
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([held], pa.binary())], names=["content", "signature", "shingles"])

    def links(batches):
        key, bucket = None, None
        for batch in batches:
            keys, blocks_, asks = batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.array(batch.column(4).to_pylist(), bool)
            names = list(zip(keys, blocks_, asks.tolist()))
            cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for a, z in zip(cuts, [*cuts[1:], len(names)]):
                if names[a][:2] != key:
                    key, bucket = names[a][:2], _Bucket(similarity)
                part = batch.slice(a, z - a)
                contents, owns = part.column(2).to_pylist(), part.column(3).to_pylist()
                bits = _sketch(np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint32).reshape(z - a, -1))
                held = [np.frombuffer(x, np.uint64) for x in part.column(6).to_pylist()]
                if asks[a]:
                    bucket.ask(contents, owns, held, bits)
                found = bucket.compare(contents, owns, held, bits)
                if found:
                    u, v = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    full = dealt.join(texts.mapInArrow(sets, "content bigint, signature binary, shingles binary"), "content")
    full = full.select("key", "block", "content", "own", "asks", "signature", "shingles").repartition("key", "block")
    return durable(full.sortWithinPartitions("key", "block", F.desc("asks")).mapInArrow(links, "u bigint, v bigint"))


def near_copies(
    documents: DataFrame, raw_text: str = "raw_text", file_id: str = "fileId", similarity: float = 0.8, shingle_words: int = 5, seed: int = 42,
    radius: int = 3,
) -> DataFrame:
    """``id``, ``digest``, ``content`` and ``component`` of every document record.

    Records are linked whose sets of shingles (``shingle_words`` lower-cased words; shorter texts are one shingle) have a Jaccard
    similarity of at least ``similarity``; ``component`` is the smallest id reachable. Equal contents are one node. Candidates
    are contents whose SimHash fingerprints differ in at most ``radius`` bits, and contents that share the minima of one of BANDS bands,
    for the pairs at the bound that differ in more bits; the exact sets decide, so no link is false. Of a band's bucket every content is
    compared with the least one (pairs whose minima put them 0.15 under the bound are not read: a chance of about 1e-6 at the bound); then those that no
    link joins to it are compared with all contents of the bucket on bit planes (:func:`_bucket_links`), and only links that join
    groups are kept, so the links grow with the contents of a bucket, not with its pairs. NULL and wordless texts are one content.
    A NULL id gets the component of its content (NULL if no record with an id shares it). An empty table gives an empty result.
    """
    rows = common.records(documents, file_id, raw_text).select("text", common.digest(F.col("text")).alias("digest"))
    marks = durable(signatures(documents, raw_text, file_id, shingle_words, seed))
    owned = marks.filter(F.col("id").isNotNull())
    distinct = owned.groupBy("content").agg(F.min("id").alias("id"), F.min(F.struct("digest", "signature", "fingerprint")).alias("first"))
    distinct = durable(distinct.select("content", "id", "first.digest", "first.signature", "first.fingerprint"))
    keys = distinct.filter(F.col("signature").isNotNull()).select("content", "signature").mapInArrow(_band_keys, "content bigint, key bigint")
    tops = keys.groupBy("key").agg(F.min("content").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "lead")
    shared = durable(keys.join(tops, "key"))
    options = (distinct, rows, similarity, shingle_words, seed)
    led = shared.filter(F.col("content") != F.col("lead")).select(F.col("content").alias("u"), F.col("lead").alias("v"))
    links = _verified(fingerprint_pairs(distinct, radius).unionByName(led).distinct(), *options)
    groups = components(links)
    # Contents of a bucket that are in another component than its least one: each against the rest of the bucket.
    own, top = groups.toDF("content", "own"), groups.toDF("lead", "top")
    placed = shared.join(own, "content", "left").join(top, "lead", "left")
    placed = durable(placed.select("key", "content", F.coalesce("own", "content").alias("own"), F.coalesce("top", "lead").alias("top")))
    more = _bucket_links(placed, distinct, rows, similarity, shingle_words, seed)
    if not more.isEmpty():
        groups = components(links.unionByName(more))
    named = distinct.join(groups.withColumnRenamed("node", "content"), "content", "left")
    named = named.select("content", "id", F.coalesce("component", "content").alias("group"))
    least = named.groupBy("group").agg(F.min("id").alias("component"))
    named = named.join(least, "group").select("content", "component")
    return marks.join(named, "content", "left").select("id", "digest", "content", "component")


def keep_one_of_each(documents: DataFrame, raw_text: str = "raw_text", file_id: str = "fileId", similarity: float = 0.8, shingle_words: int = 5) -> DataFrame:
    """One document record of each group of near copies, the one with the smallest id; all columns unchanged.

    Repeated rows of that id count as copies: one of them stays. Rows with a NULL id stay when no record with an id shares their
    content. An empty table stays empty.
    """
    return keep_least_of_each(documents, durable(near_copies(documents, raw_text, file_id, similarity, shingle_words)), raw_text, file_id)
