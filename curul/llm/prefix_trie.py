"""Prefix trie of conversations, with subtree sums by centroid decomposition.

A node is a distinct sequence of first turns; it is named by the smallest conversation that starts with it and its depth,
and so is its parent. The parent-edge forest is split again and again: in each component the node is found whose removal leaves
no part of more than half, the total of what hangs from it is added along the path from it to the component's
top, and the parts are the next round's components. A chain of a million turns or a root with a million
children takes some twenty rounds, and every node is on one path at most in a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curul.llm.common import Scratch, query, table

# Fixed by the contract: whose first turns a conversation takes over, and how many.
FAMILY, MOST_TAKEN = 5, 9
#: Turns, and conversations, in a bucket or block: what is gathered or ordered together at once.
BUCKET, BLOCK_BITS = 1024, 9
NOTHING = hashlib.sha256(b"").hexdigest()


def prefixes(rows: DataFrame, bucket: Column, order: list[Column], sums: dict[str, Column], group: str = "conv") -> DataFrame:
    """``rows`` with running aggregates over each group's rows up to this one, in ``order``, without one task per group.

    ``bucket`` rises with the order. Aggregates (of sum or bit_xor) run inside a bucket, and a window over a group's buckets, one
    row each, says what the earlier ones add up to. ``sums`` maps a name to an aggregate of the rows' columns.
    """
    dealt = rows.withColumn("_bucket", bucket)
    totals = dealt.groupBy(group, "_bucket").agg(*(total.alias(f"_{name}") for name, total in sums.items()))
    earlier = W.partitionBy(group).orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    merged = {name: (F.sum if name.startswith("sum") else F.bit_xor)(f"_{name}") for name in sums}
    starts = totals.select(group, "_bucket", *(F.coalesce(m.over(earlier), F.lit(0)).alias(f"_{name}") for name, m in merged.items()))
    inside = W.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = dealt.withColumns({name: total.over(inside) for name, total in sums.items()})
    both = run.join(starts.withColumnRenamed(group, "_group").withColumnRenamed("_bucket", "_which"), (F.col(group) == F.col("_group")) & F.col("_bucket").eqNullSafe(F.col("_which")))
    for name in sums:
        both = both.withColumn(name, F.col(name) + F.col(f"_{name}") if name.startswith("sum") else F.col(name).bitwiseXOR(F.col(f"_{name}")))
    return both.drop("_bucket", "_group", "_which", *(f"_{name}" for name in sums))


def ordered(turns: DataFrame) -> DataFrame:
    """(conv, at, one, two, bytes): each turn's place from 1, two hashes of role and text, and its text's length; texts are not shuffled."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("one"),
        F.xxhash64(F.lit(1), text, role).alias("two"), F.octet_length(text).cast("long").alias("bytes"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("one"), F.col("two")]
    placed = prefixes(rows, F.floor(F.col("turn") / BUCKET), order, {"sum_at": F.count(F.lit(1))})
    return placed.select("conv", F.col("sum_at").alias("at"), "one", "two", "bytes")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations as ``ordered`` has them, (conv, length) of all conversations)."""
    own = placed.groupBy("conv").agg(F.max("at").alias("own"))
    base = F.col("conv") - F.col("conv") % FAMILY
    taken = F.when(base == F.col("conv"), F.lit(0)).otherwise(F.crc32(F.col("conv").cast("string").cast("binary")) % MOST_TAKEN)
    # A head is a few turns, and at most four other conversations take it over.
    head = placed.where((F.col("conv") % FAMILY == 0) & (F.col("at") < MOST_TAKEN)).withColumnRenamed("conv", "base")
    heads = head.groupBy("base").agg(F.max("at").alias("has"))
    plans = own.select("conv", "own", base.alias("base"), taken.cast("long").alias("taken")).join(heads, "base", "left")
    plans = plans.withColumn("got", F.least("taken", F.coalesce("has", F.lit(0)))).drop("has")
    theirs = plans.where("got > 0").join(head, "base").where("at <= taken").select("conv", "at", "one", "two", "bytes")
    left = placed.join(plans.select("conv", "taken", "got"), "conv").where("at > taken").select("conv", (F.col("at") - F.col("taken") + F.col("got")).alias("at"), "one", "two", "bytes")
    lengths = plans.select("conv", (F.col("got") + F.greatest(F.lit(0), F.col("own") - F.col("taken"))).alias("length"))
    return theirs.unionByName(left), lengths


def trie(turns: DataFrame, lengths: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, paths, ends) of the conversations.

    nodes: conv, depth, parent (its conversation), n_convs, bytes, size (nodes in its subtree, itself included).
    paths: conv, depth, owner, above, for conversations that name a node: whose node its first ``depth`` turns are, and one less.
    ends: owner, depth, conv: the node at which each conversation ends.
    """
    marks = {name: F.bit_xor(F.xxhash64("at", name)) for name in ("one", "two")}
    marked = prefixes(turns.select("conv", "at", "one", "two", "bytes").withColumns({"x1": F.col("one"), "x2": F.col("two")}), F.floor((F.col("at") - 1) / BUCKET), [F.col("at")], {"x1": marks["one"], "x2": marks["two"]})
    root = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"), F.lit(0).cast("long").alias("bytes"))
    places = scratch.table(marked.select("conv", F.col("at").alias("depth"), "x1", "x2", "bytes").unionByName(root))
    # Written, so that both sides of the join are plain exchanges and the rows of a very common beginning can be split.
    named = scratch.table(places.groupBy("depth", "x1", "x2").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs")))
    steps = scratch.table(places.join(named, ["depth", "x1", "x2"]).join(lengths, "conv").select("conv", "depth", "owner", "n_convs", "bytes", "length"))
    ends = steps.where("depth = length").select("owner", "depth", "conv")
    # Nodes that a conversation names are the last of its path, from its first depth of its own on.
    first = steps.where("conv = owner").groupBy("conv").agg(F.min("depth").alias("first"))
    upper = steps.join(first, "conv").select("conv", "depth", "owner", "n_convs", "bytes", "length", "first")
    upper = scratch.table(upper)
    above = upper.select("conv", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("above"))
    paths = scratch.table(upper.join(above, ["conv", "depth"], "left").select("conv", "depth", "owner", "above", "n_convs", "bytes", "length", "first"))
    hanging = F.when(F.col("conv") == F.col("owner"), F.col("length") - F.col("depth") + 1).otherwise(F.col("length") - F.col("first") + 1)
    sizes = paths.groupBy(F.col("owner").alias("conv"), "depth").agg(F.sum(hanging).alias("size"))
    nodes = paths.where("conv = owner").select("conv", "depth", F.col("above").alias("parent"), "n_convs", "bytes").join(sizes, ["conv", "depth"])
    return scratch.table(nodes), paths.select("conv", "depth", "owner", "above"), ends


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str], scratch: Scratch) -> DataFrame:
    """(conv, depth, and the sum of each of ``values`` over the node's subtree), by centroid decomposition of the tree.

    ``nodes`` has conv, depth, size and the values; ``paths`` says which ancestor a node has at a depth. Sizes only choose the centroids. In
    a component whose top has ``total`` nodes below or at it, those with more than half of them are the path from the
    top to the centroid, the deepest one. Each round is written, and nothing but its row count reaches the driver.
    """
    sums = [f"sum_{v}" for v in values]
    zero = F.lit(0).cast("long")
    opened = scratch.table(nodes.select("conv", "depth", "size", *values, *(zero.alias(s) for s in sums), zero.alias("top"), zero.alias("top_depth")))
    finished = []
    while opened.limit(1).count():
        totals = opened.groupBy("top", "top_depth").agg(F.count("*").alias("total"))
        heavy = opened.join(totals, ["top", "top_depth"]).where("2 * size > total")
        centroids = heavy.groupBy("top", "top_depth").agg(F.max(F.struct("depth", "conv", "size")).alias("g"), F.first("total").alias("total"))
        found = opened.join(centroids, ["top", "top_depth"]).withColumn("next", F.col("g.depth") + 1)
        step = paths.select(F.col("conv").alias("p_conv"), F.col("depth").alias("p_depth"), "owner", "above")
        met = found.join(step, (F.col("conv") == F.col("p_conv")) & (F.col("next") == F.col("p_depth")), "left")
        own = (F.col("conv") == F.col("g.conv")) & (F.col("depth") == F.col("g.depth"))
        under = (F.col("depth") >= F.col("next")) & F.coalesce(F.col("above") == F.col("g.conv"), F.lit(False))
        marked = scratch.table(met.select(
            "top", "top_depth", "conv", "depth", "size", *values, *sums, "owner", "next", F.col("g.size").alias("cut"),
            own.alias("own"), under.alias("under"), (2 * F.col("size") > F.col("total")).alias("path"),
        ))
        hung = marked.where("own or under").groupBy("top", "top_depth").agg(*(F.sum(v).alias(f"add_{v}") for v in values))
        raised = marked.where("path").join(hung, ["top", "top_depth"]).withColumns({f"sum_{v}": F.col(f"sum_{v}") + F.col(f"add_{v}") for v in values})
        after = raised.select(marked.columns).unionByName(marked.where("not path"))
        state = scratch.table(after.select(
            "conv", "depth", (F.col("size") - F.when(F.col("path"), F.col("cut")).otherwise(0)).alias("size"), *values, *sums,
            F.when(F.col("under"), F.col("owner")).otherwise(F.col("top")).alias("top"), F.when(F.col("under"), F.col("next")).otherwise(F.col("top_depth")).alias("top_depth"), "own",
        ))
        # The centroid has been on every path that it will be on.
        finished.append(state.where("own").select("conv", "depth", *sums))
        opened = state.where("not own").drop("own")
    return reduce(DataFrame.unionByName, finished) if finished else nodes.select("conv", "depth", *(F.col(v).alias(s) for v, s in zip(values, sums, strict=True)))


def digests(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) of nodes at which conversations end, of their numbers in order.

    Numbers are joined in blocks first; a task then takes its nodes' blocks in order as a stream and holds one block and one digest.
    A digest is sequential by definition, so a node's blocks go through one task, at some hundred times fewer rows.
    """
    blocks = ends.groupBy("owner", "depth", F.shiftright("conv", BLOCK_BITS).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("names"))
    dealt = blocks.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "block")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, hashlib.sha256()

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], names=["conv", "depth", "ends_sha256"])

        for batch in batches:
            out = []
            for owner, depth, names in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if last == (owner, depth):
                    state.update(b",")
                else:
                    if last is not None:
                        out.append((*last, state.hexdigest()))
                    last, state = (owner, depth), hashlib.sha256()
                state.update(names.encode())
            yield batch_of(out)
        if last is not None:
            yield batch_of([(*last, state.hexdigest())])

    return dealt.mapInArrow(digest, "conv long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations.

    ``turns`` has conv_id, turn, role, text; other columns are not read. Defined cases: null role or text is the empty string; a null
    turn comes first; turns of equal number are ordered by role, then by the hash of role and text, and repeated rows are turns of their own; rows
    without conv_id belong to no conversation and are left out; a conversation without turns belongs to the root only; texts are
    read whole; an empty table has no root and gives no rows.
    """
    scratch = Scratch(turns.sparkSession)
    placed = scratch.table(ordered(turns))
    again, lengths = rebuilt(placed)
    lengths = scratch.table(lengths)
    nodes, paths, ends = trie(again, lengths, scratch)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    counted = scratch.table(
        nodes.join(children, ["conv", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        .withColumns({"leaf": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    )
    sums = subtree_sums(counted, paths, ["leaf", "saved"], scratch)
    rows = counted.join(sums, ["conv", "depth"]).join(digests(ends), ["conv", "depth"], "left")
    result = scratch.kept(rows.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("sum_leaf").alias("n_leaves"),
        F.col("sum_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    ))
    scratch.drop()
    return result


@query(
    """
    WITH o AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    c AS (
        SELECT conv_id, conv_id - conv_id % 5 AS base,
            xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 9 AS h
        FROM (SELECT DISTINCT conv_id FROM o)),
    r AS (
        SELECT c.conv_id, 0 AS part, o.pos, o.role, o.txt FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h
        UNION ALL
        SELECT c.conv_id, 1, o.pos, o.role, o.txt FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
    s AS (
        SELECT conv_id, row_number() OVER w AS depth, strlen(txt) AS bytes, list(md5(role || chr(1) || txt)) OVER w AS path
        FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    m AS (
        SELECT conv_id, depth, bytes, md5(array_to_string(path, '')) AS name, md5(array_to_string(path[:depth - 1], '')) AS up FROM s
        UNION ALL SELECT conv_id, 0, 0, md5(''), NULL FROM c),
    n AS (SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(up) AS up, (count(*) - 1) * any_value(bytes) AS saved FROM m GROUP BY depth, name),
    k AS (SELECT depth - 1 AS depth, up AS name, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
    t AS (
        SELECT m.depth, m.name, sum(n.saved) AS saved_tokens, sum((coalesce(k.n_children, 0) = 0)::INT) AS n_leaves
        FROM n LEFT JOIN k USING (depth, name) JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.depth, m.name),
    l AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
    e AS (
        SELECT m.depth, m.name, sha256(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id)) AS ends FROM l JOIN m USING (conv_id, depth) GROUP BY m.depth, m.name)
    SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
        t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
    FROM n LEFT JOIN k USING (depth, name) JOIN t USING (depth, name) LEFT JOIN e USING (depth, name) LEFT JOIN n AS p ON p.depth = n.depth - 1 AND p.name = n.up
    """
)
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The prefix trie of all conversations."""
    return prefix_trie(table(spark, folder, "conversations"))
