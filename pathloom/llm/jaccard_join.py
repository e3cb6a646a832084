"""N-gram Jaccard join by signature trees.

1. Shingle sets. A merged count-min sketch (``sketch``) gives every shingle an estimated document count. Under the order
   (count, hash), rarest first, two sets that reach the similarity share a shingle among the first n - ceil(t n) + 1 of each
   (their prefixes), and a set most of whose shingles occur nowhere else has no partner. Equal sets become one class.
2. Blocks. Every shingle's holders elect a leader, the least class; a class enters the block of each leader of its prefix.
   Two classes that share a prefix shingle share its leader's block, so no pair is lost, and a class enters few blocks.
3. Trees. A block's classes are cut into nodes of bounded size by similarity to the leader (``near`` ones are linked with
   it), by size and by hash. A node holds the OR of its token bitmaps and the range of its sizes. Node pairs whose
   greatest possible overlap is too small, or that are linked already because both are near, go no further; each pair
   left is one task, which carries on with the nodes' subtrees down to single sets and verifies these exactly.
4. Components of the links, as tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm import sketch
from pathloom.llm.common import id_and_text, store
from pathloom.llm.words import NOT_SPACE, U64, find_words, mix, text_slices, window_hash, windows
from pathloom.operators.graph import components

#: A bitmap is this many 64-bit columns.
LANES = 16
LANE_NAMES = [f"b{i}" for i in range(LANES)]
NODE_TOKENS = 1 << 20
FANOUT = 8


def _sets(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle) of a chunk, by row and then hash."""
    keys, rows = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for low, _, data, offsets in text_slices(table["text"]):
        words = find_words(data, offsets, NOT_SPACE, fold=True)
        at, text, length = windows(words, size, short=True)
        keys.append(window_hash(words.hashes, at, length, size))
        rows.append(text + low)
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (np.diff(key) != 0) | (np.diff(row) != 0)
    return row[new], key[new]


def _pass_one(size: int, shape: sketch.Shape):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found, counts = np.unique(_sets(table, size)[1], return_counts=True)
        return sketch.packed_table(list(sketch.local_sketch(key[0].as_py(), found, counts, shape)))

    return run


SETS = "doc_id long, n long, class binary, rare int, prefix int, tokens array<long>"


def least_overlap(n, percent: int):
    """Shingles of a set of ``n`` that any partner must hold: ceil(percent / 100 * n)."""
    return -(-percent * n // 100)


def _pass_two(size: int, shape: sketch.Shape, percent: int):
    """Each document's set size and class; with tokens rarest first if enough of them can occur elsewhere."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, back: pa.Table) -> pa.Table:
        row, token = _sets(table, size)
        found, place, counts = np.unique(token, return_inverse=True, return_counts=True)
        level = sketch.levels(back, found, counts, shape)[place]
        order = np.lexsort((token, level, row))
        row, token, level = row[order], token[order], level[order]
        first = np.searchsorted(row, np.arange(len(table) + 1))
        n = np.diff(first)
        rare = np.diff(np.concatenate([[0], np.cumsum(level == 0)])[first])
        sums = [np.add.reduceat(np.append(mix(token + U64(s)), U64(0)), np.minimum(first[:-1], len(token))) * (n > 0) for s in (11, 29)]
        digest = np.stack([mix(sums[0] + n.astype(U64)), mix(sums[1] ^ sums[0])], axis=1)
        joins = (n > 0) & (n - rare >= least_overlap(n, percent))
        signed = token.view(np.int64)
        return pa.table({
            "doc_id": table["doc_id"],
            "n": pa.array(n, pa.int64()),
            "class": pa.array([d.tobytes() if k else None for d, k in zip(digest, n)], pa.binary()),
            "rare": pa.array(rare, pa.int32()),
            "prefix": pa.array(n - least_overlap(n, percent) + 1, pa.int32()),
            "tokens": pa.array([signed[a:b] if j else None for a, b, j in zip(first, first[1:], joins)], pa.list_(pa.int64())),
        })

    return run


def shingle_sets(docs: DataFrame, size: int, percent: int, depth: int, cells_per_window: int, chunk_bytes: int) -> DataFrame:
    shape = sketch.Shape.of(docs, depth, cells_per_window, chunk_bytes)
    dealt = sketch.chunked(docs, shape)
    estimates = sketch.merged(dealt.groupBy("chunk").applyInArrow(_pass_one(size, shape), sketch.PACKED))
    return dealt.groupBy("chunk").cogroup(estimates.groupBy("chunk")).applyInArrow(_pass_two(size, shape, percent), SETS)


def _linked(a: Column, b: Column, percent: int) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return 100 * shared >= percent * (F.size(a) + F.size(b) - shared)


def _bitmap(tokens: Column) -> Column:
    """LANES longs; a token sets the bit that its lowest bits name."""
    spot = F.transform(F.coalesce(tokens, F.array().cast("array<long>")), lambda t: F.pmod(t, F.lit(64 * LANES)).cast("int"))
    empty = F.array_repeat(F.lit(0).cast("long"), LANES)
    return F.transform(empty, lambda zero, lane: F.aggregate(
        F.filter(spot, lambda x: F.shiftright(x, 6) == lane), zero, lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x % 64))))


def signatures(tokens: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(tokens), LANES), U64)
    for i, t in enumerate(tokens):
        spot = (t.view(U64) & U64(64 * LANES - 1)).astype(np.int64)
        np.bitwise_or.at(out[i], spot >> 6, U64(1) << (spot & 63).astype(U64))
    return out


class Tree:
    """Sets in similarity order with their ancestors: per level the ORed bitmaps, size ranges and unbitten surplus."""

    def __init__(self, tokens: list[np.ndarray], label: np.ndarray):
        maps = signatures(tokens)
        sizes = np.array([len(t) for t in tokens], np.int64)
        least = np.array([t.view(U64).min() for t in tokens], U64)
        order = np.lexsort((sizes, least, label))
        self.tokens = [np.sort(tokens[i]) for i in order]
        self.order = order
        # Tokens beyond the first on a bit: what a count of shared bits can miss of a shared set.
        self.levels = [(maps[order], sizes[order], sizes[order], (sizes - np.bitwise_count(maps).sum(axis=1))[order])]
        while len(self.levels[-1][0]) > 1:
            m, low, high, over = self.levels[-1]
            at = np.arange(0, len(m), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(m, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(over, at)))


def can_link(a, b, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether some set below node i of level ``a`` could link with one below node j of level ``b``."""
    shared = np.bitwise_count(a[0][i] & b[0][j]).sum(axis=1) + np.minimum(a[3][i], b[3][j])
    shared = np.minimum(np.minimum(shared, a[2][i]), b[2][j])
    return (100 + percent) * shared >= percent * (a[1][i] + b[1][j])


class Groups:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


AT_ONCE = 1 << 11


def dual_traversal(left: Tree, right: Tree | None, groups: Groups, offset: int, percent: int) -> list[tuple[int, int]]:
    """Links that join groups not joined before, between two trees or (without ``right``) within one.

    Node pairs descend level by level, both sides at once, while their sets could link and are not all in one group yet, a
    bounded number of pairs at a time. Single sets are verified one by one, so a group of near copies costs about one check
    a member, and memory does not follow the number of pairs.
    """
    same, other = right is None, right or left
    links: list[tuple[int, int]] = []

    def leaves(tree: Tree, level: int, node: int) -> range:
        size = FANOUT ** min(level, len(tree.levels) - 1)
        return range(node * size, min((node + 1) * size, len(tree.tokens)))

    def joined(level: int, x: int, y: int) -> bool:
        roots = {groups.find(k) for k in leaves(left, level, x)}
        return len(roots) == 1 and roots == {groups.find(k + offset) for k in leaves(other, level, y)}

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        # Of single sets every bit that only one holds is a token the other lacks.
        a, b, n, m = left.levels[0][0][i], other.levels[0][0][j], left.levels[0][1][i], other.levels[0][1][j]
        most = np.minimum(n - np.bitwise_count(a & ~b).sum(axis=1), m - np.bitwise_count(b & ~a).sum(axis=1))
        fits = ((100 + percent) * most >= percent * (n + m)) & ((i < j) | (not same))
        for x, y in zip(i[fits].tolist(), j[fits].tolist()):
            if groups.find(x) == groups.find(y + offset):
                continue
            s, t = left.tokens[x], other.tokens[y]
            shared = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * shared >= percent * (len(s) + len(t) - shared):
                groups.join(x, y + offset)
                links.append((x, y))

    def descend(level: int, i: np.ndarray, j: np.ndarray) -> None:
        a, b = (t.levels[min(level, len(t.levels) - 1)] for t in (left, other))
        keep = can_link(a, b, i, j, percent)
        i, j = i[keep], j[keep]
        if level == 0:
            verify(i, j)
            return
        for low in range(0, len(i), AT_ONCE):
            open_ = [(x, y) for x, y in zip(i[low : low + AT_ONCE].tolist(), j[low : low + AT_ONCE].tolist()) if not joined(level, x, y)]
            if open_:
                below = [(_children(left, level, x), _children(other, level, y)) for x, y in open_]
                x = np.concatenate([np.repeat(p, len(q)) for p, q in below])
                y = np.concatenate([np.tile(q, len(p)) for p, q in below])
                ahead = (x <= y) if same else np.ones(len(x), bool)
                descend(level - 1, x[ahead], y[ahead])

    descend(max(len(left.levels), len(other.levels)) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))
    return links


def _children(tree: Tree, level: int, node: int) -> np.ndarray:
    """Nodes one level below; a tree that is not that high stays at its root."""
    if level >= len(tree.levels):
        return np.array([node])
    return np.arange(node * FANOUT, min((node + 1) * FANOUT, len(tree.levels[level - 1][0])))


LINKS = "src binary, dst binary"


def _join_nodes(percent: int):
    """Links within one node pair of a block; near sets, all linked with the leader, start as one group."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        left_node, right_node = key[1].as_py(), key[2].as_py()
        node = table["node"].to_numpy(zero_copy_only=False)
        sides = [np.flatnonzero(node == left_node)]
        if left_node != right_node:
            sides.append(np.flatnonzero(node == right_node))
        near, name = table["near"].to_pylist(), table["class"].to_pylist()
        lists = table["tokens"].combine_chunks()
        flat, first = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        trees = [Tree([flat[first[x] : first[x + 1]] for x in rows], np.array([near[x] for x in rows], int)) for rows in sides]
        names = [[name[rows[x]] for x in tree.order] for rows, tree in zip(sides, trees)]
        offset = len(sides[0]) if len(sides) > 1 else 0
        groups = Groups(sum(map(len, sides)))
        flags = [near[rows[x]] for rows, tree in zip(sides, trees) for x in tree.order]
        one = [x for x, f in enumerate(flags) if f]
        for x in one[1:]:
            groups.join(one[0], x)
        links = dual_traversal(trees[0], trees[1] if offset else None, groups, offset, percent)
        return pa.table({
            "src": pa.array([names[0][x] for x, _ in links], pa.binary()), "dst": pa.array([names[-1][y] for _, y in links], pa.binary())})

    return run


def find_links(classes: DataFrame, percent: int, node_tokens: int = NODE_TOKENS) -> DataFrame:
    """``src, dst``: links that connect what links connect, among the distinct ``classes(class, rare, prefix, tokens)``."""
    shared = classes.select("class", F.explode(F.slice("tokens", F.col("rare") + 1, F.greatest(F.col("prefix") - F.col("rare"), F.lit(0)))).alias("token"))
    leaders = shared.groupBy("token").agg(F.min("class").alias("leader"), F.count(F.lit(1)).alias("holders")).where("holders > 1")
    member = shared.join(leaders.select("token", "leader"), "token").select("leader", "class").distinct()
    heads = classes.select(F.col("class").alias("leader"), F.col("tokens").alias("head"))
    sets = member.join(classes.select("class", "tokens"), "class").join(heads, "leader")
    n = F.size("tokens")
    sets = store(sets.select(
        "leader", "class", _linked(F.col("tokens"), F.col("head"), percent).alias("near"), n.alias("n"),
        F.floor(F.log(n.cast("double")) / float(np.log(100 / percent))).cast("int").alias("band")))
    star = sets.where(F.col("near") & (F.col("class") != F.col("leader"))).select(F.col("leader").alias("src"), F.col("class").alias("dst"))
    # Blocks all of whose sets are near are done: the leader joins them.
    open_ = sets.groupBy("leader").agg(F.min("near").alias("done")).where("NOT done").select("leader")
    cut = sets.groupBy("leader", "near", "band").agg(F.ceil(F.sum("n") / node_tokens).alias("parts"))
    at = sets.join(open_, "leader", "left_semi").join(cut, ["leader", "near", "band"]).join(classes.select("class", "tokens"), "class")
    name = F.concat_ws("/", F.col("near").cast("int"), "band", F.pmod(F.xxhash64("class"), F.col("parts")))
    at = store(at.select("leader", name.alias("node"), "near", "class", "tokens", "n", _bitmap(F.col("tokens")).alias("bits")))
    lanes = [F.get("bits", F.lit(i)) for i in range(LANES)]
    ones = sum([F.bit_count(x) for x in lanes], F.lit(0))
    nodes = at.groupBy("leader", "node").agg(
        F.min("near").alias("near"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - ones).alias("over"),
        *[F.bit_or(x).alias(b) for x, b in zip(lanes, LANE_NAMES)])
    other = nodes.select("leader", *[F.col(c).alias(f"o_{c}") for c in nodes.columns if c != "leader"])
    common = sum([F.bit_count(F.col(b).bitwiseAND(F.col(f"o_{b}"))) for b in LANE_NAMES], F.lit(0)) + F.least("over", "o_over")
    reach = F.least(common, "high", "o_high")
    pairs = nodes.join(other, "leader").where((F.col("node") <= F.col("o_node")) & ~(F.col("near") & F.col("o_near")))
    pairs = pairs.where((100 + percent) * reach >= percent * (F.col("low") + F.col("o_low"))).select("leader", F.col("node").alias("a"), F.col("o_node").alias("b"))
    sides = pairs.select("leader", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
    tasks = sides.join(at.select("leader", "node", "near", "class", "tokens"), ["leader", "node"])
    return star.unionByName(tasks.groupBy("leader", "a", "b").applyInArrow(_join_nodes(percent), LINKS))


def _one_of_each(sets: DataFrame) -> DataFrame:
    """One row of each class, as a table: classes with several rows choose by row number, without their tokens."""
    first = sets.groupBy("class").agg(F.min("row_no").alias("row_no"), F.count(F.lit(1)).alias("rows"))
    gone = sets.select("class", "row_no").join(first.where("rows > 1").select("class", F.col("row_no").alias("kept")), "class").where("row_no <> kept")
    return store(sets.join(gone.select("row_no"), "row_no", "left_anti").select("class", "rare", "prefix", "tokens"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, depth: int = 1, cells_per_window: int = 8,
    chunk_bytes: int = sketch.CHUNK_BYTES, node_tokens: int = NODE_TOKENS,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a document's set are its distinct runs of ``shingle``
    words, or its whole sequence if it has fewer. Two documents link when 100 * intersection >= ``percent`` * union;
    ``component_id`` is the smallest id that links lead to, a document's own included. ``node_tokens`` bounds the tokens
    of a node of a block, that is of one side of a task. One row of the sketch is enough here: a lone set passes only if
    three quarters of its shingles are overestimated.

    Defined cases: null and empty texts, and texts without words, have an empty set and link with nothing, so they keep
    their id; a null id is never a smallest id: its row gets the smallest other id of its component, or null; every row is a
    document of its own, so rows with one id and different texts link only if these do, and repeated rows are equal
    sets of one component; no rows give no rows.
    """
    sets = shingle_sets(id_and_text(docs, id_col, text_col), shingle, percent, depth, cells_per_window, chunk_bytes)
    sets = store(sets.withColumn("row_no", F.monotonically_increasing_id()))
    classes = sets.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    labels = components(find_links(_one_of_each(sets.where("tokens IS NOT NULL")), percent, node_tokens)).select(F.col("node").alias("class"), "label")
    labelled = classes.join(labels, "class", "left").select("class", "least", F.coalesce("label", "class").alias("label"))
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    whole = labelled.join(ids, "label").select("class", "component_id")
    return sets.select("doc_id", "n", "class").join(whole, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
