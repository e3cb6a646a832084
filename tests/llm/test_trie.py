"""The prefix trie and its contraction against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from test_cases import same

from pathloom.llm import conversation_trie
from pathloom.llm.conversation_trie import list_digests, ordered_turns, prefix_trie, rebuilt, subtree_sums

SCHEMA = "conv_id long, turn long, role string, text string, id int, block string, pos string, digest int, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3) for r in rows], SCHEMA).repartition(4)


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def sequences(rows, splice=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(w)] for c, w in own.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    return {c: own.get(c - c % 5, [])[: h(c)] + w[h(c) :] for c, w in own.items()} if splice else own


def slow(seqs):
    nodes = {}
    for c, w in seqs.items():
        for d in range(len(w) + 1):
            nodes.setdefault(tuple(w[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, members in nodes.items():
        leaves = saved = 0
        stack = [p]
        while stack:
            q = stack.pop()
            leaves += q not in kids
            saved += (len(nodes[q]) - 1) * (len(q[-1][1].encode()) if q else 0)
            stack += kids.get(q, [])
        ends = ",".join(str(c) for c in sorted(members) if len(seqs[c]) == len(p))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed=1):
    """Shared openings, one long and one very common conversation, ties and nulls in turns, repeated rows, a null conversation."""
    rng = random.Random(seed)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", "é ü", "", None, "maybe so"]))
    rows = []
    for c in range(60):
        rows += [(c, t, *say()) for t in range(rng.randrange(1, 13))]
    for c in range(100, 700):
        rows += [(c, t, "user", f"common {t}") for t in range(3)]
    rows += [(800, t, "user", f"deep {t % 3}") for t in range(700)] + [(801, t, "user", f"deep {t % 3}") for t in range(650)]
    rows += [(5, None, "user", "early"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (6, None, None, None), (None, 1, "user", "lost"), (10**12 + 3, 1, "user", "far")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("positions,slices", [(4096, "8"), (16, "3")])
def test_trie(spark, monkeypatch, positions, slices):
    monkeypatch.setattr(conversation_trie, "POSITIONS", positions)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        rows = conversations()
        turns = ordered_turns(frame(spark, rows))
        found = prefix_trie(*rebuilt(turns))
        assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        same(found.collect(), slow(sequences(rows)))
        if positions == 16:
            same(prefix_trie(turns, turns.select("conv_id").distinct()).collect(), slow(sequences(rows, splice=False)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_conversations_without_turns_end_in_the_root(spark):
    turns, convs = rebuilt(ordered_turns(frame(spark, [(c, 0, "user", "a") for c in range(30)])))
    assert convs.count() == 30
    same(prefix_trie(turns, convs).collect(), slow(sequences([(c, 0, "user", "a") for c in range(30)])))
    none = turns.limit(0)
    same(prefix_trie(none, convs).collect(), slow({c: [] for c in range(30)}))


def test_no_conversations(spark):
    assert prefix_trie(*rebuilt(ordered_turns(frame(spark, [])))).count() == 0
    assert prefix_trie(*rebuilt(ordered_turns(frame(spark, [(None, 1, "user", "x")])))).count() == 0


def test_colliding_keys_are_met_with_another_salt(spark, monkeypatch):
    plain, salts = conversation_trie._keyed, []

    def poor(turns, salt):
        salts.append(salt)
        keyed = plain(turns, salt)
        return keyed if salt else keyed.withColumn("k1", F.lit(0).cast("long")).withColumn("k2", F.lit(0).cast("long"))

    monkeypatch.setattr(conversation_trie, "_keyed", poor)
    rows = [(c, t, "user", f"{c * t % 4}") for c in range(12) for t in range(4)]
    same(prefix_trie(*rebuilt(ordered_turns(frame(spark, rows)))).collect(), slow(sequences(rows)))
    assert salts == [0, 1]


@pytest.mark.parametrize("shape", ["path", "star", "comb", "random", "forest"])
def test_contraction(spark, shape):
    rng, n = random.Random(shape), 300
    parent = {
        "path": lambda i: i - 1, "star": lambda i: 0, "comb": lambda i: i - 1 if i % 2 else max(i - 2, 0), "random": lambda i: rng.randrange(i),
        "forest": lambda i: None if i % 50 == 0 else rng.randrange(i // 50 * 50, i)}[shape]
    rows = [(i, parent(i) if i else None, rng.randrange(9)) for i in range(n)]
    total = {i: v for i, _, v in rows}
    for i, p, _ in reversed(rows):
        if p is not None:
            total[p] += total[i]
    found = subtree_sums(spark.createDataFrame(rows, "id long, parent long, v long"), ["v"])
    same(found.collect(), total.items())


def test_list_digests(spark):
    rows = [(1, c) for c in range(-3000, 3000, 2)] + [(2, 7), (3, 10), (3, 9), (3, 9)]
    random.Random(3).shuffle(rows)
    wanted = {}
    for i, c in rows:
        wanted.setdefault(i, set()).add(c)
    out = list_digests(spark.createDataFrame(rows, "id long, c long").repartition(4), "c").collect()
    same(out, [(i, hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest()) for i, v in wanted.items()])
