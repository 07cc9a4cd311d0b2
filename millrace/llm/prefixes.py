"""Prefix trie of conversations: ROLLUP over blocks of positional turn ids."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.values import quoted
from millrace.session import durable

# Turns of one block of columns; longer conversations go on in further blocks.
BLOCK_TURNS = 8
# A turn's id: 16 bytes of a digest of role and text, then 8 bytes with the number of characters of the text.
_ID_BYTES = 24
_LIST_IDS = 1 << 14
_PARTITION_BITS = 33
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _turn_id(role: Column, text: Column) -> Column:
    told = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.concat(F.substring(told, 1, 32), F.lpad(F.hex(F.length(text)), 16, "0")))


def number_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id`` (long), ``position`` (from 0, in order of ``turn``) and ``turn_id`` of every turn.

    A NULL turn comes first; equal turns of a conversation are in order of their ids, so the result does not depend on the order of
    rows. A NULL role or text is empty. Rows without a conversation id belong to none and are left out. Turns are sorted by range
    over conversation and turn, so a conversation of any size is spread over tasks; only the sizes of conversations cut by a bound
    of the ranges (fewer than the partitions) are broadcast.
    """
    rows = conversations.select(
        quoted(conv_id).cast("bigint").alias("conv_id"), quoted(turn).alias("turn"),
        _turn_id(F.coalesce(quoted(role).cast("string"), F.lit("")), F.coalesce(quoted(text).cast("string"), F.lit(""))).alias("turn_id"),
    ).filter(F.col("conv_id").isNotNull())
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_id")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "turn_id", F.shiftright(F.monotonically_increasing_id(), _PARTITION_BITS).alias("part"))

    def count(batches):
        last, held = None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            place = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
            if conv[0] == last:
                place[: first[1] if len(first) > 1 else len(conv)] += held
            last, held = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=["conv_id", "turn_id", "part", "place"])

    placed = durable(dealt.mapInArrow(count, "conv_id bigint, turn_id binary, part bigint, place bigint"))
    edges = placed.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    ends = edges.select("low").union(edges.select("high")).groupBy(F.col("low").alias("conv_id")).count().filter("count > 1").select("conv_id")
    sizes = placed.join(F.broadcast(ends), "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    found = placed.join(F.broadcast(sizes), ["conv_id", "part"], "left")
    return found.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("position"), "turn_id")


def _columns() -> list[str]:
    return [f"t{j}" for j in range(BLOCK_TURNS)]


def _joined(names: list[str]) -> Column:
    """The ids of a path as one binary; columns that are NULL add nothing."""
    return F.concat(*[F.coalesce(F.col(n), F.lit(b"")) for n in names])


def _block(turns: DataFrame, first: int) -> DataFrame:
    """One row per conversation with the ids of turns ``first`` ... in columns."""
    held = turns.filter((F.col("position") >= first) & (F.col("position") < first + BLOCK_TURNS))
    return held.groupBy("conv_id").agg(*[F.max(F.when(F.col("position") == first + j, F.col("turn_id"))).alias(n) for j, n in enumerate(_columns())])


def _rolled(paths: DataFrame, first: int, *aggregates: Column) -> DataFrame:
    """Aggregates of every node of a block by one ROLLUP over the turn columns below the node that the block starts from."""
    names = _columns()
    rolled = paths.rollup("prior", *names).agg(F.grouping_id().alias("gid"), *aggregates)
    # grouping_id has a one for every column rolled away: 2^r - 1 for r of them.
    depth = reduce(lambda found, r: found.when(F.col("gid") == (1 << r) - 1, BLOCK_TURNS - r), range(1, BLOCK_TURNS + 1), F.when(F.col("gid") == 0, BLOCK_TURNS))
    nodes = rolled.withColumn("k", depth).withColumn("path", _joined(names)).filter(F.col("k").isNotNull())
    # Conversations that end above a depth have no node there; the top of a later block is the last node of the one before.
    nodes = nodes.filter((F.length("path") == _ID_BYTES * F.col("k")) & (F.col("k") >= (0 if first == 0 else 1)))
    return nodes.withColumn("depth", (F.col("k") + first).cast("bigint")).drop("gid", *names)


def _end_digests(ends: DataFrame) -> DataFrame:
    """``node``, ``depth`` and the SHA-256 of the ascending ids (``conv_id``) joined by commas.

    The ids are sorted by range and joined to pieces in all tasks; the digest of a node runs over its pieces, one after the other.
    """
    def pieces(batches):
        held = None

        def told(key, parts, first):
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip((*key, first, ",".join(parts)), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["node", "depth", "first", "ids"],
            )

        for batch in batches:
            node, depth, conv = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (depth[1:] != depth[:-1]))) if len(node) else []
            for a, z in zip(cuts, [*cuts[1:], len(node)]):
                key = (int(node[a]), int(depth[a]))
                if held is not None and (held[0] != key or len(held[1]) >= _LIST_IDS):
                    yield told(*held)
                    held = None
                if held is None:
                    held = (key, [], int(conv[a]))
                held[1].extend(map(str, conv[a:z].tolist()))
        if held is not None:
            yield told(*held)

    def digests(batches):
        key, hashed = None, None
        for batch in batches:
            nodes, depths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            done = []
            for i in range(batch.num_rows):
                ids = batch.column(3)[i].as_py().encode()
                if (nodes[i], depths[i]) != key:
                    if key is not None:
                        done.append((*key, hashed.hexdigest()))
                    key, hashed = (nodes[i], depths[i]), hashlib.sha256(ids)
                else:
                    hashed.update(b"," + ids)
            if done:
                yield _batch(done)
        if key is not None:
            yield _batch([(*key, hashed.hexdigest())])

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], names=["node", "depth", "ends"])

    order = ["node", "depth", "conv_id"]
    dealt = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    listed = dealt.mapInArrow(pieces, "node bigint, depth bigint, first bigint, ids string")
    return listed.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(digests, "node bigint, depth bigint, ends string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of conversations, from numbered turns (see :func:`number_turns`) and all ``conv_id``.

    Each distinct sequence of the first d turns (role and text) is a node at depth d, from the root without turns. The first
    ``BLOCK_TURNS`` turn ids of a conversation are columns; one ROLLUP over them aggregates all prefixes, ``grouping_id`` tells the
    depth. Conversations that still share their last node go on in the next block of columns, below that node; the others have the
    rest of their turns to themselves. So there are as many rounds as blocks in the longest shared prefix. A node is named by its depth
    and its smallest member, which stays the name along the path, so sums over subtrees are a second ROLLUP over values that each
    conversation has as the name of nodes.

    The source project has no conversation records, so the operator is general. ``conversations`` may list ids without turns; NULL
    ids are ignored, repeated ids count once. Returns, per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root:
    NULL), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_chars`` (over the subtree: characters of a node's last text for each
    further member) and ``ends`` (SHA-256 of the ids that end here, ascending, joined by commas; of nothing if none). No conversation
    at all gives no node.
    """
    names = _columns()
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    members = conversations.select(quoted("conv_id").cast("bigint").alias("conv_id")).filter(F.col("conv_id").isNotNull()).distinct()
    sizes = members.join(sizes, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n"))
    root = members.agg(F.min("conv_id").alias("prior"))
    # One row, of one number.
    paths = sizes.join(_block(turns, 0), "conv_id", "left").crossJoin(F.broadcast(root))
    rest, first, blocks, levels, ends = turns, 0, [], [], []
    least = F.min(F.struct("conv_id", "n")).alias("least")
    while True:
        paths = durable(paths.select("conv_id", "n", "prior", *names))
        nodes = _rolled(paths, first, least, F.count(F.lit(1)).alias("n_convs"), F.max("n").alias("longest"))
        last = F.conv(F.hex(F.substring(F.col("path"), -8, 8)), 16, 10).cast("bigint")
        nodes = durable(nodes.select(
            "prior", "path", "k", "depth", F.col("least.conv_id").alias("node"), F.col("least.n").alias("own"), "n_convs", "longest",
            F.when(F.col("k") == 0, 0).otherwise(last).alias("chars"),
        ))
        blocks.append((first, paths))
        levels.append(nodes)
        shared = nodes.filter("n_convs > 1").select("prior", "path", "depth", "node")
        here = paths.filter(F.col("n") <= first + BLOCK_TURNS).select("conv_id", "prior", F.col("n").alias("depth"), _joined(names).alias("path"))
        ends.append(here.join(shared, ["prior", "path", "depth"]).select("node", "depth", "conv_id"))
        on = nodes.filter((F.col("n_convs") > 1) & (F.col("k") == BLOCK_TURNS) & (F.col("longest") > F.col("depth"))).select("prior", "path", "node")
        if on.isEmpty():
            break
        first += BLOCK_TURNS
        onward = paths.filter(F.col("n") > first).select("conv_id", "n", "prior", _joined(names).alias("path"))
        onward = onward.join(on, ["prior", "path"]).select("conv_id", "n", F.col("node").alias("prior"))
        rest = durable(rest.filter(F.col("position") >= first).join(onward.select("conv_id"), "conv_id", "left_semi"))
        paths = onward.join(_block(rest, first), "conv_id")
    nodes = reduce(DataFrame.unionByName, levels)
    lone = (F.col("k") == BLOCK_TURNS) & (F.col("n_convs") == 1) & (F.col("longest") > F.col("depth"))
    # What each conversation carries as the name of nodes: whether it ends in a leaf of its own, and what its nodes save.
    cost = (F.col("n_convs") - 1) * F.col("chars")
    carried = durable(nodes.groupBy(F.col("node").alias("conv_id")).agg(
        F.min("depth").alias("top"), F.max(F.when((F.col("longest") == F.col("depth")) | lone, 1).otherwise(0)).alias("leaf"), F.sum(cost).alias("saved"),
    ))
    sums = reduce(DataFrame.unionByName, [
        _rolled(p.join(carried, "conv_id", "left"), f, F.min("conv_id").alias("node"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("below"))
        .select("node", "depth", "leaves", "below")
        for f, p in blocks
    ])
    # The first node that a conversation names hangs on a node of another name.
    tops = nodes.join(carried.select(F.col("conv_id").alias("node"), F.col("top").alias("depth")), ["node", "depth"]).filter("depth > 0")
    tops = tops.select("node", "depth", "prior", "k", F.expr(f"substring(path, 1, {_ID_BYTES} * (k - 1))").alias("path"))
    above = nodes.select("prior", "path", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    hung = tops.filter("k > 1").join(above, ["prior", "path", "depth"]).select("node", "depth", "parent")
    hung = durable(hung.unionByName(tops.filter("k = 1").select("node", "depth", F.col("prior").alias("parent"))))
    branches = hung.groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("branches"))
    parts = [
        nodes.select("node", "depth", "own", "n_convs", "longest", "chars"), sums, hung, branches, _end_digests(reduce(DataFrame.unionByName, ends)),
    ]
    facts = ["own", "n_convs", "longest", "chars", "leaves", "below", "parent", "branches", "ends"]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("node", "depth").agg(*[F.max(c).alias(c) for c in facts])
    path = Window.partitionBy("node")
    whole = whole.withColumn("cost", cost)
    whole = whole.withColumn("under", F.sum("cost").over(path.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)))
    whole = whole.withColumn("all", F.sum("cost").over(path))
    alone = F.sha2(F.col("node").cast("string"), 256)
    found = whole.select(
        F.col("node").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "node")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("branches", F.lit(0)) + (F.col("own") > F.col("depth")).cast("bigint")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("under") + F.col("below") - F.col("all")).alias("saved_chars"),
        F.coalesce("ends", F.when((F.col("n_convs") == 1) & (F.col("longest") == F.col("depth")), alone), F.lit(NO_ENDS)).alias("ends"),
    )
    # Turns behind the last block of a conversation that nobody shares.
    tails = nodes.filter(lone).select(F.col("node").alias("conv_id"), F.col("depth").alias("from"), F.col("longest").alias("n"))
    tails = turns.join(tails, "conv_id").filter(F.col("position") >= F.col("from")).withColumn("depth", F.col("position") + 1)
    more = tails.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"),
        (F.col("depth") < F.col("n")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_chars"), F.when(F.col("depth") == F.col("n"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NO_ENDS).alias("ends"),
    )
    return found.unionByName(more)


def conversation_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """:func:`prefix_trie` of a table of turns, one row per turn."""
    turns = number_turns(conversations, conv_id, turn, role, text)
    return prefix_trie(turns, turns.select("conv_id"))
