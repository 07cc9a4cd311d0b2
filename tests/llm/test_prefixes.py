"""Prefix tries of conversations against a trie built turn by turn, and the query against its SQL."""

import hashlib
import random

import pytest

from millrace.llm import prefixes, queries


def brute(conversations):
    """Nodes of the trie by definition; ``conversations``: id to its (role, text) turns."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = {}
    for path, ids in members.items():
        under = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in ids if len(conversations[c]) == len(path))
        rows[min(ids), len(path)] = (
            min(members[path[:-1]]) if path else None, len(ids), sum(len(p) == len(path) + 1 for p in under),
            sum(not any(len(o) == len(p) + 1 and o[: len(p)] == p for o in under) for p in under),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return rows


def told(frame):
    rows = frame.collect()
    found = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_chars"], r["ends"]) for r in rows}
    assert len(found) == len(rows)
    return found


def frame_of(spark, conversations, extra=()):
    rows = [(c, i, role, text, "x") for c, turns in conversations.items() for i, (role, text) in enumerate(turns)] + list(extra)
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, depth string").repartition(7)


def made(seed, n, letters, lengths):
    rng = random.Random(seed)
    kept = {}
    for c in rng.sample(range(10 * n), n):
        base = rng.choice(list(kept.values())) if kept and rng.random() < 0.7 else []
        own = [(rng.choice(["user", "assistant"]), rng.choice(letters) * rng.randrange(3)) for _ in range(rng.choice(lengths))]
        kept[c] = [*base[: rng.randrange(len(base) + 1)], *own]
    return {c: turns for c, turns in kept.items() if turns}


@pytest.mark.parametrize("seed, lengths", [(1, [0, 1, 2, 5]), (2, [1, 8, 9, 17]), (3, [30])])
def test_trie_equals_brute_force(spark, seed, lengths):
    conversations = made(seed, 40, "abé", lengths)
    assert told(prefixes.conversation_trie(frame_of(spark, conversations))) == brute(conversations)


def test_copies_long_shared_conversations_and_turnless_ones(spark):
    turns = [("user", str(i)) for i in range(35)]
    conversations = {9: turns, 3: turns, 12: turns[:20], 4: turns[:8], 5: turns[:16], 30: [*turns[:33], ("user", "other")], -7: turns[:8]}
    numbered = prefixes.number_turns(frame_of(spark, conversations))
    everyone = spark.createDataFrame([(c,) for c in [*conversations, 100, 101, 9, None]], "conv_id bigint")
    assert told(prefixes.prefix_trie(numbered, everyone)) == brute(conversations | {100: [], 101: []})


def test_nulls_ties_and_empty_tables(spark):
    extra = [(None, 0, "user", "lost", "x"), (1, None, None, None, "x"), (1, None, "", "", "x"), (2, 5, "user", "b", "x"), (2, 5, "user", "b", "x")]
    found = told(prefixes.conversation_trie(frame_of(spark, {1: [("user", "a")], 3: [("", ""), ("", ""), ("user", "a")]}, extra)))
    assert found == brute({1: [("", ""), ("", ""), ("user", "a")], 2: [("user", "b")] * 2, 3: [("", ""), ("", ""), ("user", "a")]})
    empty = frame_of(spark, {1: [("user", "a")]}).limit(0)
    assert prefixes.conversation_trie(empty).count() == 0
    mixed = spark.createDataFrame([(1, 0, "ab", "c"), (2, 0, "a", "bc")], "conv_id int, turn int, role string, text string")
    assert len(told(prefixes.conversation_trie(mixed))) == 3


def test_a_conversation_that_holds_most_turns(spark):
    big = spark.range(30_000).selectExpr("7L AS conv_id", "29999 - id AS turn", "'user' AS role", "CAST(id AS STRING) AS text")
    small = spark.createDataFrame([(8, 0, "user", "29999"), (8, 1, "user", "z")], "conv_id bigint, turn bigint, role string, text string")
    found = prefixes.conversation_trie(big.unionByName(small))
    assert found.count() == 30_002
    assert found.filter("depth < 2").orderBy("depth", "conv_id").select("conv_id", "n_convs", "n_children", "n_leaves", "saved_chars").collect() == [
        (7, 2, 1, 2, 5), (7, 2, 2, 2, 5),
    ]


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.execute(queries.SQL["op12_prefix_trie"])
    names = [c[0] for c in want.description]
    got = queries.QUERIES["op12_prefix_trie"](spark, sf_dir).select(*names)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
