"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.values import quoted
from millrace.llm import common
from millrace.llm.common import blocks, column

BUCKETS = 1 << 18
_SHORTEST, _LONGEST = 3, 6
# So many neutral words are added to every bag, so that a few words of a short text don't decide alone.
_NEUTRAL_WORDS = 10

# Letters fold to lower case, digits and other scripts stay, everything else separates words.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _subwords(texts: list[str | None]):
    """Words of the texts with their character n-grams, blanks around a word included.

    Returns the n-gram buckets and their validity by length, the start of each word's n-grams, and the first word of each text.
    """
    parts = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " if t else b"  " for t in texts]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    data = _FOLD[np.frombuffer(b"".join(parts) + b" " * _LONGEST, np.uint8)]
    n = int(bounds[-1])
    blank = data == 32
    starts = np.flatnonzero(~blank[1:n] & blank[: n - 1])  # the blank before each word
    first = np.searchsorted(starts, bounds)
    wide, inner = data.astype(np.uint32), np.zeros(n, bool)
    key = (wide[:n] << np.uint32(8)) | wide[1 : n + 1]
    grams = []
    for length in range(2, _LONGEST):
        inner |= blank[length - 1 : length - 1 + n]  # a blank that is neither the first nor the last byte
        key = (key ^ wide[length : length + n]) * np.uint32(0x01000193) + np.uint32(0x9E3779B1)
        spread = key * np.uint32(0x85EBCA6B)
        grams.append(((spread >> np.uint32(32 - 18)).astype(np.int32), ~inner))
    return grams, starts, first


def _features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights) of each text: the mean over words of the mean over a word's n-grams."""
    grams, starts, first = _subwords(texts)
    if not len(starts):
        return [(np.zeros(0, np.int64), np.zeros(0, np.float32))] * len(texts)
    n = len(grams[0][1])
    per_word = np.add.reduceat(sum(v.astype(np.int32) for _, v in grams), starts)
    word = np.searchsorted(starts, np.arange(n), side="right") - 1
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.float32)))
            continue
        span = slice(starts[a], starts[b] if b < len(starts) else n)
        bucket = np.concatenate([g[span][v[span]] for g, v in grams])
        share = np.concatenate([1.0 / per_word[word[span][v[span]]] for _, v in grams]) / (b - a + _NEUTRAL_WORDS)
        kinds, at = np.unique(bucket, return_inverse=True)
        out.append((kinds.astype(np.int32), np.bincount(at, weights=share).astype(np.float32)))
    return out


class ToxicityModel:
    """Score of each n-gram bucket (its embedding times the difference of the two softmax columns) and the bias."""

    def __init__(self, scores: np.ndarray, bias: float) -> None:
        self.scores = scores.astype(np.float32)
        self.bias = float(bias)

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1. A text without a word has the score of the bias alone."""
        grams, starts, first = _subwords(texts)
        logit = np.zeros(len(texts))
        if len(starts):
            total = np.zeros(len(grams[0][1]), np.float32)
            count = np.zeros(len(total), np.int32)
            for bucket, valid in grams:
                total += np.where(valid, self.scores[bucket], np.float32(0))
                count += valid
            words = np.add.reduceat(total, starts) / np.maximum(np.add.reduceat(count, starts), 1)
            sums = np.append(0.0, np.cumsum(words, dtype=np.float64))
            size = first[1:] - first[:-1]
            logit = (sums[first[1:]] - sums[first[:-1]]) / (size + _NEUTRAL_WORDS)
        return 1.0 / (1.0 + np.exp(-np.clip(logit + self.bias, -30, 30)))


def train(texts: list[str | None], labels: np.ndarray, width: int = 4, epochs: int = 12, rate: float = 0.5, batch: int = 64, least_texts: int = 8, decay: float = 5e-7, clean_weight: float = 1.5, least_steps: int = 800, seed: int = 5) -> ToxicityModel:
    """Fit embeddings and softmax together by gradient steps on batches in random order.

    Steps adapt to each number's past slopes. N-grams of fewer than ``least_texts`` texts keep score zero: they would only tell the
    training texts apart.
    Label 0 weighs ``clean_weight`` times label 1 in sum, so that clean texts are left alone. Without examples of both labels
    nothing can be learnt: the score is then the smoothed share of label 1.
    """
    labels = np.asarray(labels, np.int64)
    if len(labels) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return ToxicityModel(np.zeros(BUCKETS), np.log(share / (1 - share)))
    features = [f for part in range(0, len(texts), 64) for f in _features(texts[part : part + 64])]
    rng = np.random.default_rng(seed)
    cost = len(labels) / np.bincount(labels, minlength=2) * np.array([clean_weight, 1.0]) / (1 + clean_weight)
    seen = np.zeros(BUCKETS, np.int64)
    for kinds, _ in features:
        seen[kinds] += 1
    for i, (kinds, share) in enumerate(features):
        often = seen[kinds] >= least_texts
        features[i] = (kinds[often], share[often])
    order, batches = rng.permutation(len(labels)), []
    for part in range(0, len(order), batch):
        rows = order[part : part + batch]
        kinds, at = np.unique(np.concatenate([features[r][0] for r in rows]), return_inverse=True)
        of = np.repeat(np.arange(len(rows)), [len(features[r][0]) for r in rows])
        batches.append((labels[rows], kinds, at.astype(np.int32), of.astype(np.int16), np.concatenate([features[r][1] for r in rows])))
        for r in rows:
            features[r] = None  # the batch holds it now
    table = rng.normal(0, 0.1, (BUCKETS, width))
    table[seen < least_texts] = 0
    table_squares = np.full((BUCKETS, width), 1e-10)
    weights, bias = rng.normal(0, 0.5, (width, 2)), np.zeros(2)
    weight_squares, bias_squares = np.full((width, 2), 1e-8), np.full(2, 1e-8)
    epochs = max(epochs, -(-least_steps // len(batches)))  # few texts are gone through more often
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(batches)):
            label, kinds, at, of, share = batches[k]
            n, own = len(label), table[kinds]
            vectors = np.stack([np.bincount(of, weights=share * own[at, d], minlength=n) for d in range(width)], axis=1)
            logits = vectors @ weights + bias
            error = np.exp(logits - logits.max(axis=1, keepdims=True))
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(n), label] -= 1
            error *= cost[label][:, None] / n
            back = error @ weights.T
            slope = np.stack([np.bincount(at, weights=share * back[of, d], minlength=len(kinds)) for d in range(width)], axis=1)
            slope += decay * own
            squares = table_squares[kinds] + slope**2
            table_squares[kinds] = squares
            table[kinds] = own - step * slope / np.sqrt(squares)
            slope = vectors.T @ error
            weight_squares += slope**2
            weights -= step * slope / np.sqrt(weight_squares)
            bias_squares += error.sum(axis=0) ** 2
            bias -= step * error.sum(axis=0) / np.sqrt(bias_squares)
    return ToxicityModel(table @ (weights[:, 1] - weights[:, 0]), bias[1] - bias[0])


def learn_toxicity(
    documents: DataFrame, labels: DataFrame, raw_text: str = "raw_text", file_id: str = "fileId", label: str = "toxic", most_clean: int = 6000, most_toxic: int = 3500, **options
) -> ToxicityModel:
    """Train on the texts of labelled records, at most ``most_clean`` of label 0 and ``most_toxic`` of label 1, drawn by a hash of the id.

    Those bounds are the documented size of the training sample; whole texts are used. Rows without an id or label are not drawn.
    """
    told = labels.select(quoted(file_id).alias("id"), quoted(label).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    drawn = None
    for value, most in ((0, most_clean), (1, most_toxic)):
        part = told.filter(F.col("label") == value).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(most)
        drawn = part if drawn is None else drawn.unionByName(part)
    rows = common.records(documents, file_id, raw_text).join(F.broadcast(drawn), "id")  # at most most_clean + most_toxic narrow rows
    held = sorted(((r["id"], r["text"] or "", r["label"]) for r in rows.select("id", "text", "label").toLocalIterator()), key=lambda r: (r[0], r[1], r[2]))
    return train([r[1] for r in held], np.array([r[2] for r in held], np.int64), **options)


def score_toxicity(documents: DataFrame, model: ToxicityModel, raw_text: str = "raw_text", file_id: str = "fileId") -> DataFrame:
    """``id``, ``score`` (0 to 1, higher: label 1 likelier) of every document record, from its whole text alone.

    NULL, empty and wordless texts get the score of the bias. NULL ids and repeated rows get a row each; an empty table gives an
    empty result.
    """
    rows = common.records(documents, file_id, raw_text)
    shared = documents.sparkSession.sparkContext.broadcast((model.scores, model.bias))  # one number per bucket, a fixed size
    schema = T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        own = ToxicityModel(*shared.value)
        for batch in batches:
            for first, texts in blocks(batch):
                yield pa.RecordBatch.from_arrays([column(batch, "id", first, len(texts)), pa.array(own.predict(texts))], names=schema.names)

    return rows.mapInArrow(run, schema)
