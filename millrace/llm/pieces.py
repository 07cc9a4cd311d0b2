"""SentencePiece BPE: vectorised merge rounds over flat symbol arrays, byte fallback, and decoding back to text."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm import common
from millrace.llm.common import blocks, column

# Fixed values of the model format: the mark that stands for a space, and the numbers of its kinds of pieces and models.
SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_BPE = 2
# Words whose ids are kept between blocks of one task; when full, the store starts anew.
_KNOWN_WORDS = 400_000
_NONE = np.iinfo(np.int64).max


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a model file. Only BPE models with byte fallback, identity normalisation and a dummy prefix are read."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    normal, train = model.normalizer_spec, model.trainer_spec
    plain = normal.name == "identity" and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces
    if train.model_type != _BPE or not train.byte_fallback or train.treat_whitespace_as_suffix or not plain:
        raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix are supported")
    pieces = [(p.piece, p.score, p.type) for p in model.pieces]
    if {kind for _, _, kind in pieces} - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
        raise ValueError("user-defined and unused pieces are not supported")
    return pieces


class PieceBpe:
    """Encoder and decoder over the pieces of a model.

    A symbol is a piece's id, or ``size`` plus the code point of a character that is no piece. Symbols that stand side by side merge
    when their joined text is a piece; of all such pairs the one with the best score goes first, the leftmost of equal ones.
    """

    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self.size = len(pieces)
        ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == _NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece holds a space behind another character: words cannot be encoded apart")
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        scores = np.array([s for _, s, _ in pieces], np.float64)
        # Equal scores share a rank: the leftmost pair goes first.
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.size
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        of = lambda part: int(self.symbol[ord(part)]) if len(part) == 1 else ids.get(part, -1)
        found, grams, early = [], set(), set()
        for p, i in ids.items():
            grams.update(zip(p, p[1:]))
            for at in range(1, len(p)):
                a, b = of(p[:at]), of(p[at:])
                if a >= 0 and b >= 0:
                    found.append((a << 32 | b, rank[i], i))
                    # A piece that goes before one of its parts, or is tied with it, may overtake the part's other merges.
                    early.update(x for x in (a, b) if x < self.size and rank[i] <= rank[x])
        table = np.array(sorted(found), np.int64).reshape(-1, 3)
        self.pairs, self.ranks, self.made = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()
        self.one_by_one = np.zeros(self.size, bool)
        self.one_by_one[list(early)] = True
        # Neighbouring characters that no piece holds side by side are never merged, so a word falls apart there.
        self.grams = np.unique(np.array([ord(a) << 32 | ord(b) for a, b in grams], np.int64))
        breaks = "\n" if not any("\n" in pair for pair in grams) else ""
        self.words = re.compile(f" *[^ {breaks}]+| +" + (f"|{breaks}+" if breaks else ""))
        self.text_of = {i: p.replace(SPACE, " ").encode() for p, i in ids.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.name_of = [str(i) for i in range(self.size)]
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def _segments(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all words, the word of each, and the segment of each (a word or a part that merges on its own)."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        gram = points[:-1] << 32 | points[1:]
        at = np.minimum(np.searchsorted(self.grams, gram), max(0, len(self.grams) - 1))
        apart = (word[1:] != word[:-1]) | (self.grams[at] != gram if len(self.grams) else True)
        return points, word, np.concatenate([[0], np.cumsum(apart)]) if len(points) else np.zeros(0, np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words, and the word of each.

        A round finds the best rank of every segment and merges its pairs of that rank, left to right; segments without a pair leave
        the flat arrays. Where a made piece may be overtaken by what it makes possible, only the leftmost pair is merged in a round.
        """
        points, word, part = self._segments([w.replace(" ", SPACE) for w in words])
        ids, done = self.symbol[points], []
        while len(ids):
            key = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = (self.pairs[at] == key) & (part[:-1] == part[1:])
            rank = np.append(np.where(hit, self.ranks[at], _NONE), _NONE)
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            sizes = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(rank, starts)
            over = np.repeat(least == _NONE, sizes)
            done.append((ids[over], word[over], part[over]))
            where = np.flatnonzero((rank == np.repeat(least, sizes)) & ~over)
            # In a run of overlapping pairs (a a a), every second one is merged.
            run = np.flatnonzero(np.append(True, np.diff(where) != 1)) if len(where) else where
            place = np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))
            where = where[place % 2 == 0]
            slow = self.one_by_one[self.made[at[where]]]
            if slow.any():
                first = np.append(True, part[where[1:]] != part[where[:-1]])
                held = np.isin(part[where], part[where[slow]])
                where = where[first | ~held]
            ids[where] = self.made[at[where]]
            keep = ~over
            keep[where + 1] = False
            ids, word, part = ids[keep], word[keep], part[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, word, part = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(part, kind="stable")
        return ids[order], word[order]

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > _KNOWN_WORDS:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        if not fresh:
            return
        symbols, word = self.merge(fresh)
        if (symbols >= self.size).any():
            # Characters outside the model become their bytes.
            told = [[s] if s < self.size else [self.byte[b] for b in chr(s - self.size).encode("utf-8", "surrogatepass")] for s in symbols.tolist()]
            word = np.repeat(word, [len(x) for x in told])
            listed = list(itertools.chain.from_iterable(told))
        else:
            listed = symbols.tolist()
        names, texts = [self.name_of[i] for i in listed], [self.text_of[i] for i in listed]
        edges = np.searchsorted(word, np.arange(len(fresh) + 1)).tolist()
        for w, a, b in zip(fresh, edges, edges[1:]):
            self.known[w] = (",".join(names[a:b]), b - a, b"".join(texts[a:b]))

    def encode(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """(ids joined by commas, their number, decoded text) of each text; the decoded text lacks the space set before the text."""
        split = [self.words.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        self._learn(set().union(*split))
        results = []
        for words in split:
            told = [self.known[w] for w in words]
            results.append((",".join([t[0] for t in told]), sum([t[1] for t in told]), b"".join([t[2] for t in told])[1:].decode("utf-8", "replace")))
        return results


def encode_pieces(documents: DataFrame, model_path: str, raw_text: str = "raw_text", file_id: str = "fileId") -> DataFrame:
    """Ids of every document record by a SentencePiece BPE model, and the text decoded from them.

    ``model_path`` names a model file that the driver reads; its pieces (a fixed size) are broadcast. Words of a block of texts are
    merged together in rounds over flat arrays; each different word is merged once. The ids equal those of the sentencepiece library
    without begin and end ids and without sampling; characters outside the model become their UTF-8 bytes.

    Returns ``id``, ``n_tokens``, ``ids`` (decimal, joined by commas) and ``decoded``. A NULL text counts as empty: no tokens. NULL
    ids and repeated rows get a row each; other columns of ``documents`` are not read; an empty table gives an empty result. A text
    of any length is encoded whole; a long stretch without a space falls apart where no piece joins two neighbouring characters.
    """
    pieces = documents.sparkSession.sparkContext.broadcast(read_model(model_path))
    rows = common.records(documents, file_id, raw_text)
    schema = T.StructType([
        rows.schema["id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType()),
    ])

    def run(batches):
        bpe = PieceBpe(pieces.value)
        for batch in batches:
            for first, texts in blocks(batch):
                found = bpe.encode([t or "" for t in texts])
                yield pa.RecordBatch.from_arrays([
                    column(batch, "id", first, len(texts)), pa.array([n for _, n, _ in found], pa.int64()),
                    pa.array([x for x, _, _ in found], pa.string()), pa.array([t for _, _, t in found], pa.string()),
                ], names=schema.names)

    return rows.mapInArrow(run, schema)
