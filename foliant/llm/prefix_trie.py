"""A prefix trie of conversations, built level by level: who shares which first turns, and what sharing them saves.

Going down, the conversations that still share their node with another meet by (node, next turn) at each depth; the least
conv_id of a group is its node's name. A conversation that is alone in its node is a chain from there on: it leaves the
rounds, and its further nodes are rows of its own turns. Coming up, each level's leaves and savings are added to its
parents' by a join. A level is one table in the shared folder, so rounds don't build up lineage; there are as many as the
deepest node that two conversations share, whatever the length of the others.

Groups are pre-aggregated before they are shuffled, turns travel as digests, and a conversation of very many turns is
dealt over ranges of them. Ids that end at one node are hashed in a stream of packed runs, as SHA-256 needs their order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import written

#: Turns taken from another conversation are those of the first one among so many ids, and at most CARRIED - 1 of them.
FAMILY, CARRIED = 5, 9
#: Ids of a packed run, and nodes of a chain that are made in one task.
RUN, CHAIN = 4096, 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()

NODE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, at, key, bytes) of all turns, at from 1 within the part, and (conv_id, part, before, first) of the parts.

    Turns are dealt by ranges of (conv_id, turn), so that a long conversation is cut in parts; `before` is how many of its
    turns lie in earlier ones, `first` how many it has up to CARRIED - 1 in all. A null turn comes first; turns of equal
    numbers are ordered by role and by their key, 128 bits of a digest of role and text in which null and empty are the same.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)), 1, 16)
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "key"]
    dealt = rows.withColumn("any", F.rand(13)).repartitionByRange(*order, "any").withColumn("part", F.spark_partition_id())
    dealt = written(dealt.drop("any"), "trie-turns")
    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    conv = Window.partitionBy("conv_id")
    parts = counts.select(
        "conv_id",
        "part",
        F.coalesce(F.sum("n").over(conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.least(F.sum("n").over(conv), F.lit(CARRIED - 1)).alias("first"),
    )
    own = Window.partitionBy("conv_id", "part").orderBy(*order[1:])
    return dealt.select("conv_id", "part", F.row_number().over(own).cast("long").alias("at"), "key", "bytes"), written(parts, "trie-parts")


def carried(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % CARRIED


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, key, bytes) of the rebuilt conversations' turns, in order of depth, and (conv_id, n) of all of them."""
    rows, parts = placed(turns)
    convs = parts.groupBy("conv_id").agg(F.max("first").alias("first"))
    base = (F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("base")
    family = convs.select("conv_id", base, carried(F.col("conv_id")).alias("h"))
    firsts = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("have"))
    family = written(family.join(firsts, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("have", F.lit(0))).alias("taken")), "trie-families")
    at = parts.join(family, "conv_id").select("conv_id", "part", "before", "h", "taken")
    rows = written(rows.join(at, ["conv_id", "part"]).withColumn("at", F.col("before") + F.col("at")), "trie-placed")
    own = rows.where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "key", "bytes")
    heads = rows.where(f"at < {CARRIED}").select(F.col("conv_id").alias("base"), F.col("at").alias("depth"), "key", "bytes")
    given = heads.join(family, "base").where("depth <= h").select("conv_id", "depth", "key", "bytes")
    out = own.union(given)
    lengths = family.select("conv_id", F.col("taken").alias("n")).union(own.groupBy("conv_id").agg(F.max("depth").alias("n")))
    out = written(out.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"), "trie-rebuilt")
    return out, written(lengths.groupBy("conv_id").agg(F.max("n").alias("n")), "trie-lengths")


def _level(live: DataFrame, turns: DataFrame, depth: int) -> DataFrame:
    """(conv_id, node, parent, n_convs, bytes) of the live conversations that have a turn of this depth."""
    meet = live.select("conv_id", "node").join(turns.where(F.col("depth") == depth), "conv_id").select("conv_id", F.col("node").alias("parent"), "key", "bytes")
    groups = meet.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"))
    return written(meet.join(groups, ["parent", "key"]).select("conv_id", "node", "parent", "n_convs", "bytes"), f"trie-level-{depth}")


def _levels(turns: DataFrame, lengths: DataFrame) -> list[DataFrame]:
    """The levels from the root down to the deepest one where a conversation shared its parent."""
    least, count = lengths.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    number = lambda x: F.lit(x).cast("long")
    top = lengths.select("conv_id", number(least).alias("node"), number(None).alias("parent"), number(count).alias("n_convs"), number(0).alias("bytes"))
    levels = [written(top, "trie-level-0")]
    while True:
        below = _level(levels[-1].where("n_convs > 1"), turns, len(levels))
        if below.isEmpty():
            return levels
        levels.append(below)


def _rolled_up(levels: list[DataFrame]) -> list[DataFrame]:
    """(node, depth, parent, n_convs, n_children, n_leaves, saved) of each level's nodes, from the deepest up."""
    out, below = [], None
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth].where("conv_id = node").select("node", F.lit(depth).cast("long").alias("depth"), "parent", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
        if below is None:
            rolled = nodes.select("*", F.lit(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"))
        else:
            up = below.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("more"))
            rolled = nodes.join(up, "node", "left").select(
                *nodes.drop("saved").columns,
                (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"),
                F.coalesce("n_children", F.lit(0)).alias("n_children"),
                F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            )
        below = written(rolled, f"trie-nodes-{depth}")
        out.append(below)
    return out


def _runs(batches):
    """Rows sorted by (depth, node, conv_id) as runs: the least id, and up to RUN ids as one string."""
    names = ["depth", "node", "first", "ids"]

    def made(rows):
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([",".join(map(str, r[3])) for r in rows], pa.string())], names)

    run = None
    for batch in batches:
        done = []
        for depth, node, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if run is None or run[:2] != [depth, node] or len(run[3]) == RUN:
                if run:
                    done.append(run)
                run = [depth, node, conv, []]
            run[3].append(conv)
        if done:
            yield made(done)
    if run:
        yield made([run])


def _digests(batches):
    """Runs sorted by (depth, node, first) as one digest for each node; no more than a batch is held."""
    names = ["depth", "node", "ends"]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].hexdigest() for r in rows])], names)

    last = None
    for batch in batches:
        done = []
        for depth, node, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if last is None or last[:2] != [depth, node]:
                if last:
                    done.append(last)
                last = [depth, node, hashlib.sha256(ids.encode())]
            else:
                last[2].update(b"," + ids.encode())
        if done:
            yield made(done)
    if last:
        yield made([last])


def _ends(levels: list[DataFrame], lengths: DataFrame) -> DataFrame:
    """(depth, node, ends): the digest of the ids that end at each node that several conversations share."""
    last = None
    for depth, level in enumerate(levels):
        at = level.where("n_convs > 1").select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id")
        last = at if last is None else last.union(at)
    ends = last.join(lengths.withColumnRenamed("n", "depth"), ["conv_id", "depth"]).select("depth", "node", "conv_id")
    order = ["depth", "node", "conv_id"]
    runs = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs, "depth long, node long, first long, ids string")
    return runs.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_digests, "depth long, node long, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the rebuilt conversations' trie: NODE's columns.

    conversations has (conv_id, turn, role, text). A conversation is its turns in order of their number, null first, equal
    numbers by role and a digest of the text; a null role or text counts as an empty one, repeated rows are turns of their
    own. Conversation c is rebuilt: the first h turns of conversation c - c mod FAMILY (fewer if it has fewer, none if it
    isn't there), then its own after its first h; h is crc32 of the decimal c modulo CARRIED. A node is a sequence of first
    turns that some rebuilt conversation begins with; the root, of none, is a prefix of all.

    conv_id is the least id of those that begin with it, depth its number of turns, parent_conv_id the parent's conv_id
    (root: null), n_convs how many begin with it, n_children its children, n_leaves the nodes without children in its
    subtree, itself included, saved_tokens the sum over that subtree of (n_convs - 1) times the bytes of a node's last
    text, ends_sha256 the digest of the ids that end there, rising and comma-joined.

    Rows without a conv_id belong to no conversation; an empty table has no node, not even a root; other columns are left
    out, whatever their names.
    """
    turns, lengths = rebuilt(conversations.select("conv_id", "turn", "role", "text"))
    levels = _levels(turns, lengths)
    rolled = _rolled_up(levels)
    nodes = rolled[0]
    for more in rolled[1:]:
        nodes = nodes.union(more)
    shared = nodes.where("n_convs > 1").join(_ends(levels, lengths), ["depth", "node"], "left")
    shared = shared.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
    alone = nodes.where("n_convs = 1").select(F.col("node").alias("conv_id"), F.col("depth").alias("from"), "parent").join(lengths, "conv_id")
    step = F.lit(CHAIN).cast("long")
    blocks = alone.select("conv_id", "n", "from", "parent", F.explode(F.sequence("from", "n", step)).alias("block")).repartition("conv_id", "block")
    chain = blocks.select("conv_id", "n", "from", "parent", F.explode(F.sequence("block", F.least("n", F.col("block") + CHAIN - 1))).alias("depth"))
    ends_here = F.col("depth") == F.col("n")
    chain = chain.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("from"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(ends_here, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(ends_here, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY).alias("ends_sha256"),
    )
    return shared.union(chain).select(*NODE)
