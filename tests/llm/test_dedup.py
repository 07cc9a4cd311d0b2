"""Substring and near-duplicate operators against brute force, and their edge cases."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from millrace.llm import chunks, nearcopies, queries, simhash, suffixes
from millrace.llm.components import components

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(2, 9))) for _ in range(400)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (None, prose(40, 1)), (6, prose(40, 1)), (7, prose(40, 1))]


def removed_by_brute_force(rows, length):
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for j in range(len(data)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def suffix_rows():
    shared, other = prose(60, 2), prose(30, 3)
    rows = [(i, prose(20, 100 + i) + " " + shared[i % 7 :] + " " + prose(20, 200 + i)) for i in range(30)]
    rows += [(100, other * 3), (101, "ab" * 400), (102, "ab" * 300 + other), (103, prose(25, 5) + "é" * 130), (104, "é" * 120), (105, shared), (106, shared)]
    return rows + [(200, None), (201, ""), (202, "x" * 99), (203, "x" * 100), (204, "y" * 100), (205, "y" * 101)]


def test_spans_equal_brute_force(records):
    rows = suffix_rows()
    found = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.drop_repeated_spans(records(rows)).collect()}
    assert found == removed_by_brute_force(rows, 100)


@pytest.mark.parametrize(("length", "first"), [(40, 16), (64, 40)])
def test_spans_of_other_lengths(records, length, first):
    rows = suffix_rows()
    got = suffixes.drop_repeated_spans(records(rows).repartition(5), length=length, first=first).collect()
    assert {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == removed_by_brute_force(rows, length)


def test_spans_edges(records):
    got = suffixes.drop_repeated_spans(records(EDGES)).collect()
    assert len(got) == len(EDGES)
    by = {r["id"]: r for r in got}
    # A NULL id orders first, so the texts of 6 and 7 are the copies.
    assert by[None]["n_removed"] == 0 and by[6]["n_removed"] == by[6]["n_bytes"] == by[7]["n_removed"]
    assert by[1]["n_bytes"] == 0 and by[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert suffixes.drop_repeated_spans(records([])).count() == 0
    twice = suffixes.drop_repeated_spans(records([(1, prose(50, 4)), (1, prose(50, 4))])).collect()
    assert [r["n_removed"] for r in twice] == [0, 0]
    with pytest.raises(ValueError):
        suffixes.drop_repeated_spans(records([]), length=4)


def test_chunk_ends_cover_and_resist_shifts():
    data = np.frombuffer(prose(3000, 8).encode(), np.uint8)
    ends = chunks.chunk_ends(data, 32, 16, 256)
    sizes = np.diff(np.append(0, ends))
    assert ends[-1] == len(data) and sizes.max() <= 256 and sizes[:-1].min() >= 16
    moved = chunks.chunk_ends(np.append(np.frombuffer(b"inserted ", np.uint8), data), 32, 16, 256) - 9
    assert len(set(ends) & set(moved)) > 0.95 * len(ends)
    slow = [sum(int(chunks._GEAR[data[i - j]]) << j for j in range(16) if i >= j) & 0xFFFF for i in range(300)]
    wanted = [i + 1 for i, g in enumerate(slow) if g >> 11 == 0]
    assert set(e for e in ends if e < 300) <= set(wanted) | {0} or sizes.max() == 256


def test_repeated_passages_go_and_clean_texts_stay(records):
    passage = prose(70, 9)
    rows = [(i, prose(40, 300 + i) + " " + (passage if i in (3, 8, 9) else "") + " " + prose(40, 400 + i)) for i in range(12)]
    got = {r["id"]: r for r in chunks.drop_repeated_substrings(records(rows)).collect()}
    assert {i for i, r in got.items() if r["n_removed"] > 0} == {8, 9}
    assert got[8]["n_removed"] > 0.6 * len(passage)
    assert got[3]["kept_text"] == dict(rows)[3]
    for r in got.values():
        assert r["kept_sha256"] == hashlib.sha256(r["kept_text"].encode()).hexdigest()


def test_chunks_edges(records):
    got = chunks.drop_repeated_substrings(records(EDGES)).collect()
    by = {r["id"]: r for r in got}
    assert len(got) == len(EDGES) and by[None]["n_removed"] == 0 and by[6]["n_removed"] == by[6]["n_bytes"]
    assert by[1]["n_chunks"] == 0 and by[4]["n_removed"] == 0
    assert chunks.drop_repeated_substrings(records([])).count() == 0


def brute_fingerprint(text, shingle_words=3):
    words = (text or "").encode().lower().split()
    k = min(shingle_words, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(marks, radius):
    root = {i: i for i in marks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(marks), 2):
        if bin(marks[a] ^ marks[b]).count("1") <= radius:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in marks}


def near_rows():
    rows = [(i, prose(50, i)) for i in range(40)]
    for k in range(60):
        words = prose(300, 1000).split()
        words[k] = WORDS[k]
        rows.append((100 + k, " ".join(words)))
    return rows + [(500, None), (501, ""), (502, "\t\n"), (503, "Lone"), (504, "lone"), (505, "two words"), (506, "TWO  words")]


def test_near_duplicates_equal_brute_force(records):
    rows = near_rows()
    marks = {i: brute_fingerprint(t) for i, t in rows}
    wanted = brute_components(marks, 3)
    got = {r["id"]: r for r in simhash.near_duplicates(records(rows)).collect()}
    assert {i: r["fingerprint"] & (2**64 - 1) for i, r in got.items()} == marks
    assert {i: r["component"] for i, r in got.items()} == wanted
    assert any(wanted[i] != i for i in range(100, 160))


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_hot_buckets_lose_no_link(spark, monkeypatch, radius):
    """Buckets far over the limit are cut by more blocks; the components stay those of all pairs."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 8)
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(3)]
    marks = {}
    for i in range(150):
        mark = base[i % 3]
        for b in rng.sample(range(64), rng.randrange(0, 5)):
            mark ^= 1 << b
        marks.setdefault(mark, i)
    marks = {i: m for m, i in marks.items()}
    rows = [(i, m - 2**64 if m >> 63 else m) for i, m in marks.items()]
    links = simhash.near_links(spark.createDataFrame(rows, "id bigint, fingerprint bigint"), radius)
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert {i: found.get(i, i) for i in marks} == brute_components(marks, radius)


def test_bit_sliced_counters():
    rng = np.random.default_rng(3)
    marks = rng.integers(0, 2**63, 200, dtype=np.uint64)
    marks[50:100] = marks[:50] ^ (np.uint64(1) << rng.integers(0, 63, 50, dtype=np.uint64))
    for radius in range(4):
        pairs = {(int(i), int(j)) for a, b in simhash._near_pairs(marks, radius) for i, j in zip(a, b)}
        wanted = {(i, j) for i in range(200) for j in range(i + 1, 200) if bin(int(marks[i] ^ marks[j])).count("1") <= radius}
        assert pairs == wanted


def test_one_of_each_stays(records):
    rows = [*near_rows(), (1, prose(50, 1)), (None, prose(50, 2)), (None, prose(50, 900))]
    kept = [r["fileId"] for r in simhash.keep_one_of_each(records(rows)).collect()]
    wanted = brute_components({i: brute_fingerprint(t) for i, t in near_rows()}, 3)
    assert sorted(k for k in kept if k is not None) == sorted({c for c in wanted.values()})
    assert kept.count(None) == 1
    assert simhash.keep_one_of_each(records([])).count() == 0
    assert simhash.keep_one_of_each(records(rows)).columns == ["fileId", "raw_text", "id"]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert {found[i] for i in range(61)} == {0} and {found[i] for i in range(100, 140)} == {100}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_queries_read_whole_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.QUERIES["op3_suffix_array_dedup"](spark, sf_dir).collect()}
    assert found == removed_by_brute_force(rows, 100)
    marks = {i: brute_fingerprint(t) for i, t in rows}
    near = {r["doc_id"]: r for r in queries.QUERIES["op4_simhash_near_dedup"](spark, sf_dir).collect()}
    assert {i: r["fingerprint"] for i, r in near.items()} == {i: f"{m:016x}" for i, m in marks.items()}
    assert {i: r["component_id"] for i, r in near.items()} == brute_components(marks, 3)
    exact = {i: n for i, (_, n, _, _) in found.items()}
    cut = {r["doc_id"]: r["n_removed"] for r in queries.QUERIES["op1_substring_dedup"](spark, sf_dir).collect()}
    assert cut.keys() == exact.keys() and sum(cut.values()) > 0.6 * sum(exact.values())


def shingle_sets(text, k=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_copies(rows, similarity=0.8):
    """Smallest id of the group of each id, by the Jaccard similarity of all pairs."""
    sets = {i: shingle_sets(t) for i, t in rows}
    root = {i: i for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a == b or (a | b and len(a & b) >= similarity * len(a | b) - 1e-9):
            low, high = sorted((root[i], root[j]))
            root = {k: low if r == high else r for k, r in root.items()}
    return root


def edited(text, n, seed):
    """``n`` words replaced, spread evenly over the text."""
    rng, words = random.Random(seed), text.split()
    for p in range(n):
        words[(2 * p + 1) * len(words) // (2 * n)] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_copies_with_spread_edits_equal_brute_force(records):
    rows = []
    for g in range(30):
        base = prose(400, 900 + g)
        # 4, 6 and 12 words of 400: similarities of about 0.90, 0.86 and 0.74 to the first text.
        rows += [(10 * g, base), (10 * g + 1, edited(base, 4, g)), (10 * g + 2, edited(base, 6, 50 + g)), (10 * g + 3, edited(base, 12, 90 + g))]
    # A chain: each text is near to the one before only.
    text = prose(300, 5)
    for k in range(12):
        rows.append((1000 + k, text))
        text = edited(text, 5, 300 + k)
    rows += [(2000, "One two  three"), (2001, "one TWO three"), (2002, "one two four"), (2003, None), (2004, " ")]
    wanted = brute_copies(rows)
    found = {r["id"]: r["component"] for r in nearcopies.near_copies(records(rows)).collect()}
    assert found == wanted
    kept = nearcopies.keep_one_of_each(records([*rows, rows[0], (None, "ONE two three"), (None, "alone")]))
    assert sorted(r["fileId"] for r in kept.collect() if r["fileId"] is not None) == sorted(set(wanted.values()))
    assert [r["raw_text"] for r in kept.collect() if r["fileId"] is None] == ["alone"]
    assert nearcopies.keep_one_of_each(records([])).count() == 0


def test_fingerprints_alone_link_what_the_exact_sets_allow(records, monkeypatch):
    """Without bands the candidates are those of SimHash: all pairs within 3 bits and no others, in a forest of near pairs."""
    rows = []
    for g in range(40):
        base = prose(400, 700 + g)
        rows += [(10 * g + k, edited(base, k, 10 * g + k) if k else base) for k in range(3)]
    texts = dict(rows)
    marks = {i: brute_fingerprint(t, 5) for i, t in rows}
    wanted = brute_components(marks, 3)
    assert any(wanted[i] != i for i in wanted) and any(wanted[i] == i and i % 10 for i in wanted)

    def none(batches):
        yield from ()

    monkeypatch.setattr(nearcopies, "_band_keys", none)
    found = {r["id"]: r["component"] for r in nearcopies.near_copies(records(rows)).collect()}
    assert found == wanted
    signed = [(i, m - 2**64 if m >> 63 else m) for i, m in marks.items()]
    distinct = records([]).sparkSession.createDataFrame(signed, "content bigint, fingerprint bigint")
    pairs = [(r["u"], r["v"]) for r in nearcopies.fingerprint_pairs(distinct).distinct().collect()]
    assert pairs and all(bin(marks[u] ^ marks[v]).count("1") <= 3 for u, v in pairs)
    assert all(texts[u] != texts[v] for u, v in pairs)


def test_pipeline_stage_takes_spread_edits(spark, records):
    base = prose(400, 77)
    docs = records([(1, base), (2, edited(base, 6, 1)), (3, prose(400, 78))]).selectExpr("fileId AS doc_id", "raw_text AS text")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_counters_on_bit_planes_equal_counted_bits():
    import numpy as np

    rng = np.random.default_rng(3)
    bits = (rng.random((200, 160)) < rng.random((200, 1))).astype(np.uint8)
    planes = nearcopies._lanes(bits)
    for radius in (0, 1, 15, 39, 64, 127, 160):
        over = nearcopies.far(lambda b: planes[b], 160, planes.shape[1:], radius)
        assert (np.unpackbits(over.view(np.uint8), bitorder="little")[:200] == (bits.sum(axis=1) > radius)).all()


def test_a_bucket_links_what_brute_force_links():
    import numpy as np

    rng = np.random.default_rng(5)
    draws = nearcopies._draws(42)
    base = rng.integers(0, 1 << 63, 200, np.uint64)
    sets = []
    for _ in range(120):
        held = base[rng.random(200) >= rng.random() * 0.3]
        sets.append(np.unique(np.concatenate([held, rng.integers(0, 1 << 63, 5, np.uint64)])))
    bits = nearcopies._sketch(np.array([nearcopies.minima(s, draws) for s in sets]))
    bucket, asking, links = nearcopies._Bucket(0.8), 90, []
    bucket.ask(list(range(asking)), list(range(asking)), sets[:asking], bits[:asking])
    links += bucket.compare(list(range(asking)), list(range(asking)), sets[:asking], bits[:asking])
    links += bucket.compare(list(range(asking, 120)), list(range(asking, 120)), sets[asking:], bits[asking:])
    assert len(links) < 120

    def near(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)

    def groups(pairs):
        root = list(range(120))
        for _ in range(120):
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert groups(links) == groups([(i, j) for i in range(120) for j in range(asking) if i != j and near(i, j)])
    assert all(near(i, j) for i, j in links)
