"""Benchmark decontamination: CGK walks, bit sampling and intact seeds find candidate windows, exact edit distances decide."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.values import quoted
from millrace.llm import common
from millrace.llm.common import blocks, column

# A walk of this many steps is taken from each word start; half of the steps advance, so it spans about half as many bytes.
WALK_STEPS = 36
_SAMPLED = 20
# After so many steps, starts are left out whose samples no item shares.
_CHECKS = (13,)
_FILTER_BITS = 20
_RUN = 1 << 15
# Seed lengths; an item has the longest one that keeps an intact seed with this chance under edits at the edge of the bound.
_SEEDS = (12, 10, 8, 7, 6, 5, 4, 3, 2)
_RECALL = 0.95
# Bytes of an item around a seed that are compared first, and the share of them that may differ.
_PIECE = 64
_PIECE_SHARE = 0.3
_SEED_FILTER_BITS = 22
_CANDIDATES = 1 << 13


def _plain(text: str) -> str:
    return " ".join(text.lower().split())


@dataclass
class Walk:
    """One repetition: a random advance bit for each (step, byte), and the steps whose output is sampled."""

    advance: np.ndarray
    sampled: np.ndarray

    @staticmethod
    def draw(seed: int) -> Walk:
        rng = np.random.default_rng(seed)
        sampled = np.zeros(WALK_STEPS, bool)
        sampled[rng.choice(WALK_STEPS, _SAMPLED, replace=False)] = True
        return Walk(rng.integers(0, 2, (WALK_STEPS, 256)).astype(np.intp), sampled)

    def keys(self, data: np.ndarray, starts: np.ndarray, known: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(kept, key): hash of the sampled outputs of the walk from each start.

        Output j is the byte under the pointer; the pointer advances when the bit of (j, byte) is one, so an edit shifts the walks
        of two strings apart until they meet again, and edit distance becomes Hamming distance. With ``known`` (bitmaps over the
        hash so far, by step) starts that no item shares are left out on the way.
        """
        at, kept = starts.astype(np.intp), np.arange(len(starts))
        key = np.zeros(len(starts), np.uint32)
        for step in range(WALK_STEPS):
            if known is not None and step in known:
                alike = np.flatnonzero(known[step][key >> np.uint32(32 - _FILTER_BITS)])
                at, key, kept = at[alike], key[alike], kept[alike]
            byte = data.take(at)
            if self.sampled[step]:
                key = (key ^ byte) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
            at += self.advance[step].take(byte)
        return kept, key

    def bitmaps(self, data: np.ndarray, starts: np.ndarray) -> dict[int, np.ndarray]:
        """Which hashes the walks from ``starts`` have at each check."""
        at, key, known = starts.astype(np.intp), np.zeros(len(starts), np.uint32), {}
        for step in range(_CHECKS[-1] + 1):
            if step in _CHECKS:
                known[step] = np.zeros(1 << _FILTER_BITS, bool)
                known[step][key >> np.uint32(32 - _FILTER_BITS)] = True
            byte = data.take(at)
            if self.sampled[step]:
                key = (key ^ byte) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
            at += self.advance[step].take(byte)
        return known


def edit_distance_within(item: str, window: str, most: int) -> int | None:
    """Least edit distance between the item and any substring of the window, or None above ``most``.

    Bit-parallel dynamic programming: one machine-independent integer holds a column of the table.
    """
    m = len(item)
    if m == 0:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(item):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for ch in window:
        eq = masks.get(ch, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(zero | plus))
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(zero | up))
        minus = up & zero
        if score < best:
            best = score
    return best if best <= most else None


def intact_chance(length: int, seed: int, rate: float) -> float:
    """Chance that ``length`` bytes, each edited with chance ``rate``, hold ``seed`` neighbours without an edit."""
    if length < seed:
        return 0.0
    whole = (1 - rate) ** seed
    none = [1.0] * seed + [1 - whole]
    for n in range(seed + 1, length + 1):
        none.append(none[n - 1] - rate * whole * none[n - seed - 1])
    return 1 - none[length]


def seed_length(chars: int, size: int, most: int) -> int:
    """Bytes of a seed for an item of so many characters and bytes, at most ``most`` edits.

    Under a walk's length one of ``most + 1`` pieces has no edit, so no near copy is lost.
    """
    if size < WALK_STEPS:
        return max(1, chars // (most + 1))
    return next((q for q in _SEEDS if intact_chance(size, q, most / chars) >= _RECALL), _SEEDS[-1])


def piece_distances(pieces: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Least edit distance of each row of ``pieces`` (up to 64 bytes, zero padded in front) to any part of its row of ``windows``.

    The column of the table is a machine word, and all rows advance together. Padding counts as equal to everything.
    """
    n, m = pieces.shape
    padded = pieces == 0
    one, plus, minus = np.uint64(1), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(n, np.uint64)
    # Rows of padding cost nothing: they start without a vertical step.
    plus &= ~np.packbits(padded, axis=1, bitorder="little").view(np.uint64)[:, 0]
    score = (~padded).sum(axis=1).astype(np.int32)
    best, top = score.copy(), np.uint64(m - 1)
    for j in range(windows.shape[1]):
        eq = np.packbits((pieces == windows[:, j : j + 1]) | padded, axis=1, bitorder="little").view(np.uint64)[:, 0]
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(zero | plus), plus & zero
        score += ((up >> top) & one).astype(np.int32) - ((down >> top) & one).astype(np.int32)
        up, down = up << one, down << one
        plus, minus = down | ~(zero | up), up & zero
        np.minimum(best, score, out=best)
    return best


class ItemIndex:
    """Keys of the walks from every word start of every item, sorted, per repetition; seeds from every byte; the plain item texts."""

    def __init__(self, items: list[tuple], similarity: float, repetitions: int, seed: int) -> None:
        self.ids = [i for i, _ in items]
        self.texts = [_plain(t) for _, t in items]
        self.most = [int((1 - similarity) * len(t) + 1e-9) for t in self.texts]
        self.walks = [Walk.draw(seed + r) for r in range(repetitions)]
        encoded = [t.encode("utf-8", "surrogatepass") for t in self.texts]
        self.sizes = [len(t) for t in encoded]
        # An item ends in a byte no text has; walks that reach it can only match other ends. Short items are also searched as they are.
        data = np.frombuffer(b"".join(t + b"\n" for t in encoded) + bytes(WALK_STEPS), np.uint8)
        bounds = np.cumsum([0, *[len(t) + 1 for t in encoded]])
        starts = np.flatnonzero(np.isin(data[:-1], [32, 10])) + 1
        starts = np.concatenate([[0], starts[starts < bounds[-1]]]).astype(np.int64) if len(items) else np.zeros(0, np.int64)
        item = np.searchsorted(bounds, starts, side="right") - 1
        ends = bounds[item + 1] - 1
        fits = ends - starts >= WALK_STEPS
        self.short = [k for k, t in enumerate(self.texts) if t and self.most[k] < 2]
        self.encoded = encoded
        self.seeds = self._seeds()
        starts, item = starts[fits], item[fits]
        self.tables = []
        for walk in self.walks:
            _, key = walk.keys(data, starts)
            order = np.argsort(key, kind="stable")
            known = walk.bitmaps(data, starts)
            self.tables.append((key[order], item[order].astype(np.int32), (starts - bounds[item])[order].astype(np.int32), known))

    def _seeds(self) -> list[tuple]:
        """(length, sorted hashes, item, offset, filter) of the seeds of each length."""
        hashed, by_length = common.SubstringHash(), {}
        for k, data in enumerate(self.encoded):
            if data and self.most[k] >= 2:
                by_length.setdefault(seed_length(len(self.texts[k]), len(data), self.most[k]), []).append(k)
        tables = []
        for length, members in sorted(by_length.items()):
            keys = []
            for k in members:
                hashed.load(np.frombuffer(self.encoded[k], np.uint8))
                keys.append(hashed.windows(length))
            item = np.repeat(np.array(members, np.int32), [len(x) for x in keys])
            offset = np.concatenate([np.arange(len(x), dtype=np.int32) for x in keys])
            key = np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            known = np.zeros(1 << _SEED_FILTER_BITS, bool)
            known[key >> np.uint64(64 - _SEED_FILTER_BITS)] = True
            tables.append((length, key[order], item[order], offset[order], known))
        return tables

    def _seeded(self, data: np.ndarray, size: int, width: int):
        """(position of the item's start, item) of windows that hold a seed, and around it a piece near to the item's."""
        if not self.seeds:
            return
        hashed = common.SubstringHash()
        hashed.load(data[:size])
        sizes, most = np.array(self.sizes), np.array(self.most)
        flat = np.frombuffer(b"".join(self.encoded), np.uint8)
        bounds = np.cumsum([0, *self.sizes])
        edge = 2 * _PIECE
        around = np.concatenate([np.zeros(edge, np.uint8), data[:size], np.zeros(edge, np.uint8)])
        for length, keys, item, offset, known in self.seeds:
            window = hashed.windows(length)
            place = np.flatnonzero(known[window >> np.uint64(64 - _SEED_FILTER_BITS)])
            low = np.searchsorted(keys, window[place], side="left")
            count = np.searchsorted(keys, window[place], side="right") - low
            place, low, count = place[count > 0], low[count > 0], count[count > 0]
            # So many candidates at a time, however often a seed occurs.
            upto = np.cumsum(count)
            for part in range(0, int(upto[-1]) if len(upto) else 0, _CANDIDATES):
                n = np.arange(part, min(part + _CANDIDATES, int(upto[-1])))
                row = np.searchsorted(upto, n, side="right")
                entry = low[row] + n - (upto[row] - count[row])
                at, k, off = place[row], item[entry], offset[entry].astype(np.int64)
                held = np.minimum(sizes[k], _PIECE)
                first = np.clip(off - (_PIECE - length) // 2, 0, sizes[k] - held)
                inside = np.arange(_PIECE)[None, :] - (_PIECE - held)[:, None]
                pieces = np.where(inside >= 0, flat[np.minimum(bounds[k][:, None] + first[:, None] + np.maximum(inside, 0), len(flat) - 1)], 0)
                whole = held == sizes[k]
                least = np.where(whole, np.minimum(most[k] * width, held), np.ceil(_PIECE_SHARE * _PIECE)).astype(np.int64)
                # The seed is in place, so a start is off by the allowed edits before it, an end by those after it.
                slack = int(least.max())
                begin = at - off + first
                span = around[np.clip(begin[:, None] + edge + np.arange(-slack, _PIECE + slack)[None, :], 0, len(around) - 1)]
                near = np.flatnonzero(piece_distances(pieces.astype(np.uint8), span) <= least)
                yield (at - off)[near], k[near], at[near]

    def matches(self, texts: list[str]) -> dict[tuple[int, int], int]:
        """Distance of each (text, item) pair with a window within the item's bound."""
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in encoded], out=bounds[1:])
        joined = b"\n".join(encoded) + b"\n"
        data = np.frombuffer(joined + bytes(WALK_STEPS), np.uint8)
        ends = (data == 32) | (data == 10)
        starts = np.concatenate([[0], np.flatnonzero(ends[: bounds[-1] - 1]) + 1])
        # Bytes of the widest character, to turn a distance in characters into one in bytes.
        largest = int(data.max())
        width = 1 if largest < 0x80 else 2 if largest < 0xE0 else 3 if largest < 0xF0 else 4
        seen: set[tuple[int, int, int]] = set()
        found: dict[tuple[int, int], int] = {}
        for walk, (keys, item, offset, known) in zip(self.walks, self.tables):
            if not len(keys):
                continue
            # Short runs of starts stay in the processor's cache.
            parts = [walk.keys(data, starts[p : p + _RUN], known) for p in range(0, len(starts), _RUN)]
            kept = np.concatenate([k + i * _RUN for i, (k, _) in enumerate(parts)])
            key = np.concatenate([k for _, k in parts])
            low = np.searchsorted(keys, key, side="left")
            count = np.searchsorted(keys, key, side="right") - low
            hit = np.flatnonzero(count)
            reach = np.repeat(hit, count[hit])
            entry = np.arange(count[hit].sum()) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit]) + np.repeat(low[hit], count[hit])
            at = starts[kept[reach]]
            text = np.searchsorted(bounds, at, side="right") - 1
            self._decide(text, item[entry], at - offset[entry], joined, bounds, width, seen, found)
        for begin, k, at in self._seeded(data, int(bounds[-1]), width):
            self._decide(np.searchsorted(bounds, at, side="right") - 1, k, begin, joined, bounds, width, seen, found)
        for k in self.short:
            for t, text in enumerate(texts):
                if f" {self.texts[k]} " in f" {text} ":
                    found[t, k] = 0
        return found

    def _decide(self, texts, items, begins, joined, bounds, width, seen, found) -> None:
        """Exact distances of candidate windows, each cell of starts once."""
        for t, k, begin in zip(texts.tolist(), items.tolist(), begins.tolist()):
            most = self.most[k]
            if found.get((t, k)) == 0:
                continue
            # The true start is within the bound of each candidate's, so twice the bound covers all candidates of a cell.
            slack = width * (2 * most + 2)
            grid = begin // max(1, most + 1)
            if (t, k, grid) in seen:
                continue
            seen.add((t, k, grid))
            span = slice(max(int(bounds[t]), begin - slack), min(int(bounds[t + 1]) - 1, begin + self.sizes[k] + slack))
            distance = edit_distance_within(self.texts[k], joined[span].decode("utf-8", "ignore"), most)
            if distance is not None and distance < found.get((t, k), most + 1):
                found[t, k] = distance


def _item_groups(benchmark: DataFrame, item_id: str, raw_text: str, most_items: int, most_chars: int):
    """Items in groups of bounded rows and characters; each group is a pass over the documents."""
    rows = benchmark.select(quoted(item_id).alias("id"), quoted(raw_text).cast("string").alias("text")).filter(F.length(F.trim("text")) > 0)
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // most_items), -(-size // most_chars))
    for part in range(parts):
        held = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part) if parts > 1 else rows
        group = held.collect()  # about most_items rows at most
        if group:
            yield sorted(((r["id"], r["text"]) for r in group), key=lambda r: (r[0] is None, r[0], r[1]))


def contaminated(
    documents: DataFrame, benchmark: DataFrame, raw_text: str = "raw_text", file_id: str = "fileId", item_id: str = "item_id",
    item_text: str = "text", similarity: float = 0.8, repetitions: int = 3, seed: int = 7, most_items: int = 20_000, most_chars: int = 8_000_000,
) -> DataFrame:
    """Document records that hold a benchmark item or a near copy of one.

    Texts are lower-cased and their white space is collapsed. A window is contaminated when its edit distance to the item is at
    most (1 - ``similarity``) times the item's length. Item-sized windows are looked up by the CGK embedding (a random walk that
    maps edit distance to Hamming distance): in each of ``repetitions`` the walk starts at every word of the item-sized window, a
    fixed random set of its steps is sampled, and a window is a candidate when the samples of one of its words equal those of the
    item at the same word. Walks miss short items, unspaced text and many edits, so a window is also a candidate when it holds an
    intact seed of the item at any byte, with or without white space, and the bytes around it are near. The seed's length follows
    from the item's: the longest that survives edits at the edge of the bound with a chance of 0.95; items under a walk have seeds that
    no near copy lacks. Candidates are verified by exact edit distance, so there is no false match. Items whose bound is under two
    edits are matched word for word.

    The index holds at most about ``most_items`` items and ``most_chars`` characters at a time; more items take more passes over
    the documents. Returns ``id``, ``digest``, ``item_id``, ``distance``, ``similarity``, one row per matching pair of record and
    item. NULL and empty texts and items match nothing; NULL ids are kept; repeated rows and repeated items give a row each; empty
    tables give an empty result.
    """
    rows = common.records(documents, file_id, raw_text).withColumn("digest", common.digest(F.col("text")))
    item_field = benchmark.select(quoted(item_id)).schema.fields[0]
    schema = T.StructType([
        rows.schema["id"], rows.schema["digest"], T.StructField("item_id", item_field.dataType), T.StructField("distance", T.LongType()),
        T.StructField("similarity", T.DoubleType()),
    ])
    context = documents.sparkSession.sparkContext
    found = None
    for group in _item_groups(benchmark, item_id, item_text, most_items, most_chars):
        index = context.broadcast(ItemIndex(group, similarity, repetitions, seed))

        def search(batches, index=index):
            own = index.value
            for batch in batches:
                for first, texts in blocks(batch):
                    pairs = own.matches([_plain(t) if t else "" for t in texts])
                    if pairs:
                        at = pa.array([first + t for t, _ in pairs])
                        sizes = [len(own.texts[k]) for _, k in pairs]
                        distance = list(pairs.values())
                        yield pa.RecordBatch.from_arrays([
                            column(batch, "id").take(at), column(batch, "digest").take(at),
                            pa.array([own.ids[k] for _, k in pairs], batch_type), pa.array(distance, pa.int64()),
                            pa.array([1 - d / n for d, n in zip(distance, sizes)], pa.float64()),
                        ], names=schema.names)

        batch_type = _arrow(item_field.dataType)
        part = rows.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else documents.sparkSession.createDataFrame([], schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, raw_text: str = "raw_text", file_id: str = "fileId", **options) -> DataFrame:
    """The document records that hold no benchmark item, all columns unchanged; see :func:`contaminated`."""
    found = contaminated(documents, benchmark, raw_text, file_id, **options)
    return common.drop_rows(documents, found.select("id", "digest").distinct(), file_id, raw_text)
