"""SentencePiece encoding against the sentencepiece library."""

import hashlib
import random

import pytest

from millrace.llm import pieces, queries

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def model_path():
    return tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model_path):
    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def strange_texts():
    rng = random.Random(5)
    pool = ["a", "b", " ", "  ", "▁", "é", "日", "本", "語", "\n", "\t", "the", " of", "ing", "=", "-", "0", "😀", "\x00", "A", "ß", "aaaa", "    "]
    letters = "abcdefghijklmnopqrstuvwxyzéèüABC.,-_()/"
    made = ["".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(600)]
    made += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    made += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(100)]
    return made + ["", " ", "▁", "a" * 3001, " " * 2000, "<s>", "<0x0A>", "=" * 1023, "".join(rng.choice(letters) for _ in range(20_000)), "word " * 50_000]


def test_ids_and_text_equal_the_library(spark, model_path, library):
    texts = strange_texts()
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(9000, None, "x", 1), (None, "a b", "x", 1), (0, texts[0], "x", 1)]
    frame = spark.createDataFrame(rows, "fileId bigint, raw_text string, decoded string, n_tokens int")
    got = pieces.encode_pieces(frame, model_path).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    for i, text in enumerate(texts):
        ids = library.encode(text)
        assert by[i]["ids"] == ",".join(map(str, ids)) and by[i]["n_tokens"] == len(ids) and by[i]["decoded"] == library.decode(ids)
    assert (by[9000]["n_tokens"], by[9000]["ids"], by[9000]["decoded"]) == (0, "", "")
    assert by[None]["decoded"] == "a b"
    assert pieces.encode_pieces(frame.limit(0), model_path).count() == 0


def small_model(*scored):
    return pieces.PieceBpe([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [(p, float(s), 1) for p, s in scored])


def one_at_a_time(model, word):
    """Merges as the format defines them: the best-scored pair, the leftmost of equal ones, one merge after the other."""
    parts = list(word)
    while True:
        options = [(-model[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in model]
        if not options:
            return parts
        i = min(options)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(12))
def test_rounds_equal_single_merges_for_any_order_of_scores(seed):
    rng = random.Random(seed)
    scored = {c: 0.0 for c in "abc▁"} | {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))): rng.randrange(-8, 0) for _ in range(30)}
    bpe = small_model(*scored.items())
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    symbols, word = bpe.merge(words)
    for k, w in enumerate(words):
        assert [bpe.text_of[i].decode() for i in symbols[word == k].tolist()] == one_at_a_time(scored, w)


def test_unsupported_models_are_refused():
    with pytest.raises(ValueError):
        small_model(("a▁b", -1))


def test_query(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_sentencepiece"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode(t)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
