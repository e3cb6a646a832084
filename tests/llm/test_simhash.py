"""Fingerprints and covering tables against brute force."""

import random
import re
from itertools import combinations

import pytest
import xxhash
from brute import SPACES, ascii_lower
from test_cases import corpus, frame, same

from pathloom.llm.queries import QUERIES
from pathloom.llm.simhash import BITS, covering_masks, find_links, fingerprint, signed, simhash_components


def slow_fingerprint(text, size=3):
    w = re.findall(SPACES, ascii_lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + size]).encode(), 42) for k in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(BITS) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, linked):
    up = {p: p for p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        up[find(a)] = find(b)
    return {p: find(p) for p in prints}


def partition(label):
    out = {}
    for p, g in label.items():
        out.setdefault(g, set()).add(p)
    return {frozenset(s) for s in out.values()}


def distance(a, b):
    return ((a ^ b) & (2**BITS - 1)).bit_count()


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_every_difference_within_the_radius_misses_some_mask(radius):
    masks = covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for some in combinations(range(0, BITS, 1 if radius < 3 else 3), radius):
        change = sum(1 << i for i in some)
        assert any(change & m == 0 for m in masks)
    assert min(m.bit_count() for m in masks) >= BITS // 2


@pytest.mark.parametrize("radius,small", [(2, 8), (2, 1), (1, 1), (3, 1), (3, 8)])
def test_links_join_what_pairs_join(spark, radius, small):
    rng = random.Random(radius)
    prints = {0, signed(2**63)}
    for _ in range(6):  # families whose members drift apart, so buckets hold many
        p = rng.getrandbits(64)
        for _ in range(60):
            prints.add(signed(p))
            for _ in range(rng.choice([1, 2, 3])):
                p ^= 1 << rng.randrange(64)
    prints |= {signed(rng.getrandbits(64)) for _ in range(50)}
    rows = sorted(prints)
    found = [(r.src, r.dst) for r in find_links(spark.createDataFrame([(p,) for p in rows], "fingerprint long"), radius, small).distinct().collect()]
    assert all(distance(a, b) <= radius for a, b in found)
    wanted = [(a, b) for a, b in combinations(rows, 2) if distance(a, b) <= radius]
    assert len(wanted) > 100
    assert partition(groups(rows, found)) == partition(groups(rows, wanted))


def test_fingerprints():
    rng = random.Random(5)
    texts = [t for _, t in corpus(3) if t is None or len(t) < 5000] + ["A b\x0bC", "É x", "one two", "İ K x y z"]
    texts.append(" ".join(f"w{rng.randrange(50)}" for _ in range(40000)))
    for t in texts:
        assert fingerprint(t, 3) % 2**64 == slow_fingerprint(t)


def test_components(spark):
    rows = [r for r in corpus(4) if r[0] != 110]
    prints = [slow_fingerprint(t) for _, t in rows]
    label = groups(set(prints), [(a, b) for a, b in combinations(set(prints), 2) if distance(a, b) <= 2])
    least = {g: min((i for (i, _), p in zip(rows, prints) if label[p] == g and i is not None), default=None) for g in label.values()}
    out = simhash_components(frame(spark, rows))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    same(out.collect(), [(i, signed(p), least[label[p]]) for (i, _), p in zip(rows, prints)])
    assert simhash_components(frame(spark, [])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    prints = {i: slow_fingerprint(t) for i, t in docs}
    label = groups(set(prints.values()), [(a, b) for a, b in combinations(set(prints.values()), 2) if distance(a, b) <= 2])
    rows = QUERIES["op11_simhash"](spark, sf).collect()
    same(rows, [(i, f"{p:016x}", min(j for j, q in prints.items() if label[q] == label[p])) for i, p in prints.items()])
