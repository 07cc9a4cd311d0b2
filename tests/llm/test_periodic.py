"""Periodic runs of words against a brute-force search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from millrace.llm import periodic, queries


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(words):
    """Every stretch of agreement for every period, smallest period of a stretch only."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def strange_texts(seed, n):
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        words = []
        while len(words) < rng.choice([5, 60, 400, 900]):
            unit = [rng.choice("abcdefgh"[: rng.choice([1, 2, 8])]) for _ in range(rng.choice([1, 1, 2, 3, 5, 7, 8, 15, 16, 31, 33, 64, 70, 100]))]
            words += unit * rng.choice([1, 1, 2, 4, 5, 9]) + unit[: rng.randrange(len(unit) + 1)]
        made.append(rng.choice([" ", "\n", "  "]).join(words))
    return made


def test_runs_equal_brute_force(spark):
    texts = strange_texts(3, 250)
    # One long run each of a small and a large period, a nest of runs, a two-word mix, and a very long text.
    rng = random.Random(1)
    texts += ["x " * 3000, "a b " * 2000 + "c", " ".join(str(i % 700) for i in range(3501)), ("a a a a a a b " * 7) * 3]
    texts += [" ".join(rng.choice("ab") for _ in range(3000))]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(7000, None, "k"), (7001, "", "k"), (7002, " \n ", "k"), (None, "z " * 9, "k"), (0, texts[0], "k")]
    frame = spark.createDataFrame(rows, "fileId bigint, raw_text string, runs string").repartition(5)
    got = periodic.periodic_runs(frame).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    for i, t in enumerate(texts):
        words = words_of(t)
        runs = brute_runs(words)
        assert [(r["start"], r["length"], r["period"]) for r in by[i]["runs"]] == runs, (i, t[:80])
        assert by[i]["n_words"] == len(words) and by[i]["collapsed"] == brute_collapse(words, runs)
    for i in (7000, 7001, 7002):
        assert (by[i]["n_words"], by[i]["runs"], by[i]["collapsed"]) == (0, [], "")
    assert by[None]["collapsed"] == "z" and sum(r["id"] == 0 for r in got) == 2
    assert periodic.periodic_runs(frame.limit(0)).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(2)
    unit = [str(rng.random()) for _ in range(20_000)]
    words = [str(rng.random()) for _ in range(5000)] + unit * 5 + ["the"] * 60_000
    got = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "fileId bigint, raw_text string")).first()
    assert [tuple(r) for r in got["runs"]] == [(5000, 100_000, 20_000), (105_000, 60_000, 1)]
    assert got["collapsed"] == " ".join(words[:25_000] + ["the"])


@pytest.mark.parametrize("octave", [0, 2, 5])
def test_a_tile_is_solved_without_its_neighbours(octave):
    import numpy as np

    q = (1 << octave) + (octave > 0)
    words = np.array([-1] + [i % q for i in range(6 * q + 6)] + [-2], np.int32)
    assert periodic.solve_tile(words, octave, 0, np.array([q])) == [(q, 1, 1 + 5 * q + 6)]


def planted(doc_id, text):
    words = words_of(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        words = planted(i, t)
        runs, r = brute_runs(words), got[i]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        milli = None if best is None else 1000 * best[1] // best[2]
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"], r["exponent_milli"]) == (*(best or (None,) * 3), milli)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_collapse(words, runs).encode()).hexdigest()
