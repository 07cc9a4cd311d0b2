"""Byte-level BPE: batched merge rounds over flat arrays, and decoding back to text."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm import common
from millrace.llm.common import blocks, column

# Fixed value: how the byte-level pre-tokenizer cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Words whose ids are kept between blocks of one task; when full, the store starts anew.
_KNOWN_WORDS = 400_000


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary read from the text of a tokenizer file (JSON)."""

    def __init__(self, content: str) -> None:
        data = json.loads(content)
        model, letters = data["model"], _byte_letters()
        vocab = model["vocab"]
        split = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        pair = np.array([(vocab[a] << 32) | vocab[b] for a, b in split], np.int64)
        order = np.argsort(pair)
        # Sorted pair keys, with the rank of each merge and the symbol that it makes.
        self.pairs = pair[order]
        self.ranks = order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in split], np.int64)[order]
        self.symbol = np.zeros(256, np.int64)
        for ch, byte in letters.items():
            self.symbol[byte] = vocab[ch]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of many words at once. A round finds, for every word, its leftmost pair of least rank by binary search, and merges all
        pairs of that rank in the word, left to right; words without a mergeable pair leave the flat array."""
        out: list = [None] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.symbol[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        while len(ids):
            key = (ids[:-1] << 32) | ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = (self.pairs[at] == key) & (word[:-1] == word[1:])
            rank = np.where(hit, self.ranks[at], np.iinfo(np.int64).max)
            rank = np.append(rank, np.iinfo(np.int64).max)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            over = least == np.iinfo(np.int64).max
            for s, n in zip(starts[over], sizes[over]):
                out[word[s]] = ids[s : s + n]
            chosen = (rank == np.repeat(least, sizes)) & ~np.repeat(over, sizes)
            # In a run of overlapping equal pairs (a a a), every second one is merged.
            where = np.flatnonzero(chosen)
            run = np.flatnonzero(np.append(True, np.diff(where) != 1))
            place = np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))
            where = where[place % 2 == 0]
            ids = ids.copy()
            ids[where] = self.made[at[where]]
            keep = ~np.repeat(over, sizes)
            keep[where + 1] = False
            ids, word = ids[keep], word[keep]
        return out

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > _KNOWN_WORDS:
            self.known.clear()
        fresh = sorted(w for w in words if w not in self.known)
        if fresh:
            for w, ids in zip(fresh, self.merge([w.encode("utf-8", "surrogatepass") for w in fresh])):
                listed = ids.tolist()
                self.known[w] = (",".join(map(str, listed)), len(listed), b"".join(self.bytes_of[i] for i in listed))

    def encode(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """(ids joined by commas, their number, decoded text) of each text. Special tokens in a text are kept whole."""
        split: list[list[str]] = []
        for text in texts:
            parts = self.cut.split(text) if self.cut is not None else [text]
            words: list[str] = []
            for i, part in enumerate(parts):
                words.extend([part] if i % 2 else self.words.findall(part))
            split.append(words)
        marks = {t: (str(i), 1, self.bytes_of[i]) for t, i in self.special.items()}
        self._learn(set().union(*split) - marks.keys())
        results = []
        for words in split:
            told = [marks[w] if w in marks else self.known[w] for w in words]
            results.append((",".join([t[0] for t in told]), sum([t[1] for t in told]), b"".join([t[2] for t in told]).decode("utf-8", "replace")))
        return results


def encode_documents(
    documents: DataFrame, tokenizer_path: str, raw_text: str = "raw_text", file_id: str = "fileId", ids: bool = True, decoded: bool = True
) -> DataFrame:
    """Token ids of every document record by byte-level BPE, and the text decoded from them.

    ``tokenizer_path`` names a tokenizer file (JSON) that the driver reads; its merges (a fixed size) are broadcast. Words of a block
    of texts are merged together in batched rounds; each different word is merged once. The result equals that of the tokenizers
    library without added special tokens, truncation or padding.

    Returns ``id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas), ``decoded_sha256`` (of the decoded text in
    UTF-8) and, when asked for, ``ids`` (array of int) and ``decoded``. A NULL text counts as empty: no tokens, digests of the empty
    string. NULL ids and repeated rows get a row each; an empty table gives an empty result.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        content = documents.sparkSession.sparkContext.broadcast(file.read())
    rows = common.records(documents, file_id, raw_text)
    fields = [rows.schema["id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))
    schema = T.StructType(fields)

    def run(batches):
        bpe = ByteBpe(content.value)
        for batch in batches:
            for first, texts in blocks(batch):
                found = bpe.encode([t or "" for t in texts])
                columns = [
                    column(batch, "id", first, len(texts)), pa.array([n for _, n, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x, _, _ in found]),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for _, _, t in found]),
                ]
                if ids:
                    columns.append(pa.array([np.array(x.split(","), np.int32) if x else [] for x, _, _ in found], pa.list_(pa.int32())))
                if decoded:
                    columns.append(pa.array([t for _, _, t in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
