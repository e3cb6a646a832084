"""The prefix trie of conversations, with totals of every subtree by parallel tree contraction.

1. Turns become digests, numbered within their conversation by a scan that cuts at ranges of the order, so a conversation
   of any length is spread.
2. A node is a distinct sequence of first turns. Its key is the xor of one hash pair a turn and position, so keys of all
   prefixes are running aggregates too. A key that stands for two different (parent, last turn) would be a collision: it is
   looked for, and met with another salt, so nodes are exact.
3. Contraction. Rounds of joins alternate: compress replaces every chain of nodes with one child by a link to the node
   that ends it, found by doubling; rake adds the totals of leaves to their parents and takes the leaves away. After
   compress at least half of the nodes are leaves, so the rounds are logarithmic, however deep or wide the tree.
4. Expansion. In reverse order the nodes of a chain get what they gathered plus the total of the node that ended it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import store
from pathloom.operators.skew import prefix_scan

POSITIONS = 4096
LISTED = 256


def ordered_turns(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """``conv_id, pos, digest, bytes``: every turn's place (from 1), a digest of role and text, and its text's bytes, as a table.

    Nulls of role and text are empty; null turn numbers come first; turns that share a number follow their digests. Rows without
    a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes")).where("conv_id IS NOT NULL")
    return store(prefix_scan(turns, ["conv_id"], ["turn", "digest"], {"pos": F.lit(1)}).select("conv_id", "pos", "digest", "bytes"))


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """``turns`` of conversations that open with the turns of another one, and all ``conv_id`` as a second table.

    Conversation c takes the first h turns of conversation c - c % ``group`` (fewer if that has fewer, none if there is none) and
    goes on with its own turns after its first h; h = crc32(decimal c) % ``heads``.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    of_base = own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = own.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h")).join(of_base, "base", "left")
    convs = store(convs.select("conv_id", "base", "h", F.least("h", F.coalesce("base_own", F.lit(0))).alias("taken")))
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h").withColumn("pos", F.col("taken") + F.col("pos") - F.col("h"))
    first = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    head = convs.select("conv_id", "base", "h").join(first, "base").where("pos <= h")
    out = [x.select("conv_id", "pos", "digest", "bytes") for x in (head, rest)]
    return store(out[0].unionByName(out[1])), convs.select("conv_id")


def _keyed(turns: DataFrame, salt: int) -> DataFrame:
    """``turns`` with the key of the prefix they close (``k1, k2``) and of the one before (``p1, p2``)."""
    one, two = F.xxhash64("pos", "digest", F.lit(2 * salt)), F.xxhash64(F.lit(2 * salt + 1), "digest", "pos")
    work = turns.select("*", one.alias("f1"), two.alias("f2"), F.floor((F.col("pos") - 1) / POSITIONS).alias("block"))
    blocks = work.groupBy("conv_id", "block").agg(F.bit_xor("f1").alias("b1"), F.bit_xor("f2").alias("b2"))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    upto = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(earlier), F.lit(0)).alias(f"o{i}") for i in (1, 2)])
    inside = W.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    work = work.select("*", *[F.bit_xor(f"f{i}").over(inside).alias(f"i{i}") for i in (1, 2)]).join(upto, ["conv_id", "block"])
    key = [F.col(f"i{i}").bitwiseXOR(F.col(f"o{i}")) for i in (1, 2)]
    before = [k.bitwiseXOR(F.col(f"f{i}")) for i, k in zip((1, 2), key)]
    return work.select(
        "conv_id", F.col("pos").alias("depth"), "digest", "bytes", key[0].alias("k1"), key[1].alias("k2"), before[0].alias("p1"), before[1].alias("p2"))


def trie_nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes ``id, parent, conv_id, depth, parent_conv_id, n_convs, bytes`` and where each conversation ends, ``conv_id, id``.

    ``conv_id`` is a node's smallest member, ``bytes`` those of its last text. The root is there if any conversation is.
    """
    key, salt = ["depth", "k1", "k2"], 0
    while True:
        keyed = store(_keyed(turns, salt))
        nodes = store(keyed.groupBy(*key, "p1", "p2", "digest").agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
        ).drop("digest").withColumn("id", F.monotonically_increasing_id() + 1))
        if nodes.groupBy(*key).count().where("count > 1").isEmpty():
            break
        salt += 1
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = top.select(
        zero.alias("id"), none.alias("parent"), "conv_id", zero.alias("depth"), none.alias("parent_conv_id"), "n_convs", zero.alias("bytes"),
        zero.alias("k1"), zero.alias("k2"))
    held = ["id", "conv_id", "depth", "k1", "k2"]
    above = nodes.select(*held).unionByName(root.select(*held)).select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"),
        F.col("conv_id").alias("parent_conv_id"))
    columns = ["id", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "bytes"]
    tree = store(root.select(*columns).unionByName(nodes.join(above, ["depth", "p1", "p2"]).select(*columns)))
    last = keyed.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("last")).select("conv_id", "last.*")
    ends = last.join(nodes.select(*key, "id"), key).select("conv_id", "id")
    return tree, ends.unionByName(convs.join(last, "conv_id", "left_anti").select("conv_id", zero.alias("id")))


def subtree_sums(nodes: DataFrame, values: Sequence[str]) -> DataFrame:
    """``id`` and the sums of ``values`` over its subtree, itself included, for every node of ``nodes(id, parent, *values)``.

    A node without a parent is a root; there may be several. Tables of each round are written, so rounds neither repeat
    work nor need the executors that did it.
    """
    values, zero = list(values), F.lit(0).cast("long")
    # A node carries the sums of the chain that was taken out between it and its parent.
    carried = [f"carried_{v}" for v in values]
    live = store(nodes.select("id", "parent", *values, *[zero.alias(c) for c in carried]))
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while not live.isEmpty():
        kids = live.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
            F.count(F.lit(1)).alias("n"), F.min("id").alias("child"), *[F.sum(c).alias(f"kid_{c}") for c in carried])
        state = store(live.join(kids, "id", "left"))
        unary = state.where("n = 1")
        chain = _chain_ends(unary.select("id", "child", *[(F.col(v) + F.col(f"kid_{c}")).alias(v) for v, c in zip(values, carried)]), values)
        tops = unary.join(unary.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", F.col("parent").alias("above"), *carried)
        ends = chain.join(tops, "id").select(
            F.col("next").alias("id"), "above", F.lit(True).alias("moved"), *[(F.col(v) + F.col(c)).alias(f"new_{c}") for v, c in zip(values, carried)])
        rest = state.where("n IS NULL OR n > 1").join(ends, "id", "left")
        parent = F.when(F.col("moved"), F.col("above")).otherwise(F.col("parent"))
        rest = store(rest.select("id", parent.alias("parent"), "n", *values, *[F.coalesce(f"new_{c}", c).alias(c) for c in carried]))
        leaves = rest.where("n IS NULL")
        raked = leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
            *[F.sum(F.col(v) + F.col(c)).alias(f"raked_{v}") for v, c in zip(values, carried)])
        more = [(F.col(v) + F.coalesce(f"raked_{v}", zero)).alias(v) for v in values]
        live = store(rest.where("n > 1").join(raked, "id", "left").select("id", "parent", *more, *carried))
        rounds.append((leaves.select("id", *values), chain))
    known = nodes.select("id", *values).limit(0)
    for leaves, chain in reversed(rounds):
        known = known.unionByName(leaves)
        total = known.select(F.col("id").alias("next"), *[F.col(v).alias(f"end_{v}") for v in values])
        known = known.unionByName(store(chain.join(total, "next").select("id", *[(F.col(v) + F.col(f"end_{v}")).alias(v) for v in values])))
    return known


def _chain_ends(unary: DataFrame, values: Sequence[str]) -> DataFrame:
    """``id, next, *values`` of ``unary(id, child, *values)``: the node that ends the chain and the sums of the nodes before it.

    Doubling: a link over a node that is itself in a chain takes over that node's link. Links that have arrived are written once.
    """
    done: list[DataFrame] = []
    open_ = unary.select("id", F.col("child").alias("next"), *values)
    while True:
        every = open_
        for part in done:
            every = every.unionByName(part)
        far = every.select(F.col("id").alias("next"), F.col("next").alias("far"), *[F.col(v).alias(f"far_{v}") for v in values])
        step = store(open_.join(far, "next", "left"))
        done.append(step.where("far IS NULL").select("id", "next", *values))
        open_ = step.where("far IS NOT NULL").select("id", F.col("far").alias("next"), *[(F.col(v) + F.col(f"far_{v}")).alias(v) for v in values])
        if open_.isEmpty():
            out = done[0]
            for part in done[1:]:
                out = out.unionByName(part)
            return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each id's parts in a row, comma-joined; rows come by id and block. Holds one digest at a time."""
    last, digest = None, None
    for batch in batches:
        ids, out = [], []
        for i, part in zip(batch["id"].to_pylist(), batch["part"].to_pylist()):
            if i == last:
                digest.update(b"," + part.encode())
                continue
            if digest is not None:
                ids.append(last)
                out.append(digest.hexdigest())
            last, digest = i, hashlib.sha256(part.encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["id", "digest"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["id", "digest"])


def list_digests(lists: DataFrame, value: str) -> DataFrame:
    """``id, digest``: SHA-256 of the ascending distinct integers ``value`` of each id, comma-joined.

    Values are joined in blocks of ``LISTED`` first, so an id with many values sends few rows to the task that streams them.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_set(value)), lambda x: x.cast("string")), ",")
    parts = lists.groupBy("id", F.floor(F.col(value) / LISTED).alias("block")).agg(joined.alias("part"))
    return parts.repartition("id").sortWithinPartitions("id", "block").select("id", "part").mapInArrow(_digests, "id long, digest string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node of the trie of ``turns(conv_id, pos, digest, bytes)``, positions from 1 without holes.

    ``convs(conv_id)`` are all conversations, those without turns included. Columns: ``conv_id`` (smallest member), ``depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens`` (over the subtree, bytes of last texts that more than one member
    would repeat) and ``ends_sha256`` (digest of the ids of conversations that end here).

    Defined cases: conversations without turns end in the root; equal conversations share all nodes; a turn repeated within a
    conversation is a turn of its own; no conversations give no rows, not even a root.
    """
    tree, ends = trie_nodes(turns, convs)
    children = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = store(tree.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.select(
        "id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_sums(own, ["n_leaves", "saved_tokens"])
    listed = list_digests(ends, "conv_id")
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.join(totals, "id").join(listed, "id", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.lit(nothing)).alias("ends_sha256"))
