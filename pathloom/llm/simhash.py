"""SimHash near-duplicates by covering locality-sensitive hashing.

1. Every text becomes a 64-bit fingerprint: the majority of each bit over the hashes of its word shingles. Rows with one
   fingerprint are one class, so copies cost a partial aggregate.
2. Masks. Bit i gets the label i mod (2**(r+1) - 1) + 1, a nonzero vector of r + 1 bits. For each nonzero vector v the mask of
   v keeps the bits whose label has an odd product with v. Any r labels leave some v with an even product with all of them, so
   two fingerprints that differ in at most r bits agree on all bits of some mask: no pair within the radius is lost.
   A table holds the classes by (mask, kept bits).
3. Buckets. Members of a bucket differ in dropped bits only. Small buckets compare their members. In larger ones every
   member goes to the points it reaches by flipping a few dropped bits: two within the radius meet halfway, and all who meet
   there are linked with one of them. The rows follow the members, not the pairs, and a bucket spreads over its points.
4. Components of the links, as tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import store
from pathloom.operators.graph import components

BITS = 64
SEED = 42
AT_ONCE = 1 << 14
#: Members up to which a bucket compares them: at most this many comparisons a member.
SMALL = 8

#: For each byte a word of eight byte-wide counters, one for each of its bits.
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def covering_masks(radius: int) -> list[int]:
    """The bits each mask keeps: 2**(radius + 1) - 1 masks, each keeps about half of the bits."""
    many = (1 << (radius + 1)) - 1
    labels = [i % many + 1 for i in range(BITS)]
    return [sum(1 << i for i, label in enumerate(labels) if (label & v).bit_count() % 2) for v in range(1, many + 1)]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def flips(kept: int, most: int) -> list[int]:
    """All ways to flip up to ``most`` of the bits that a mask drops, as signed words to xor with."""
    dropped = [i for i in range(BITS) if not kept >> i & 1]
    return [signed(sum(1 << i for i in some)) for n in range(most + 1) for some in combinations(dropped, n)]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the (unsigned 64-bit) hashes have each bit set."""
    total = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), 255):
        packed = _SPREAD[hashes[low : low + 255].view(np.uint8).reshape(-1, 8)].sum(axis=0, dtype=np.uint64)
        total += packed.view(np.uint8)
    return total


def shingle_hashes(text: str, size: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles in order, a bounded number at a time. ASCII white space parts words, so bytes do."""
    words = text.encode().lower().split()
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - size + 1, 1)
    ends = ends[min(size, len(words)) - 1 :]
    for low in range(0, last, AT_ONCE):
        pairs = zip(starts[low : min(low + AT_ONCE, last)].tolist(), ends[low : low + AT_ONCE].tolist())
        yield np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in pairs], np.uint64)


def fingerprint(text: str | None, size: int) -> int:
    """A bit is 1 if set in over half of the shingles' hashes; no words, no bits. Signed, as Spark has it."""
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text or "", size):
        counts += bit_counts(hashes)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), size) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(found, pa.int64())], ["row", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, carry: Sequence[str] = ("*",)) -> DataFrame:
    """Per row of ``docs``: ``row`` (its columns named in ``carry`` as one struct) and ``fingerprint`` (long)."""
    work = docs.select(F.struct(*carry).alias("row"), F.col(text_col).cast("string").alias("text"))
    return work.mapInArrow(_fingerprints(shingle), T.StructType([work.schema["row"], T.StructField("fingerprint", T.LongType())]))


def find_links(prints: DataFrame, radius: int = 2, small: int = SMALL) -> DataFrame:
    """``src, dst``: links that connect what pairs within ``radius`` connect, among the distinct ``prints(fingerprint)``."""
    masks = covering_masks(radius)
    own = F.explode(F.array(*[F.struct(F.lit(t).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(signed(m))).alias("kept")) for t, m in enumerate(masks)]))
    keyed = prints.select("fingerprint", own.alias("at")).select("at.mask", "at.kept", "fingerprint")
    sizes = keyed.groupBy("mask", "kept").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    member = store(keyed.join(sizes, ["mask", "kept"]))
    few = member.where(F.col("members") <= small).select("mask", "kept", F.col("fingerprint").alias("src"))
    other = few.withColumnRenamed("src", "dst")
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius
    pairs = few.join(other, ["mask", "kept"]).where((F.col("src") < F.col("dst")) & near).select("src", "dst")
    # Members meet at points: with an even radius each side goes half of the way, else the far side a step more. Members
    # who go the near way lie within the radius of all they meet.
    near_way, far_way = radius // 2, radius - radius // 2
    ways = F.array(*[F.array(*[F.lit(x) for x in flips(m, far_way)]) for m in masks])
    step = F.explode(F.element_at(ways, F.col("mask") + 1)).alias("flip")
    points = member.where(F.col("members") > small).select("mask", "kept", "fingerprint", step)
    points = points.select(
        "mask", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("point"), "fingerprint", (F.bit_count("flip") <= near_way).alias("near"))
    heads = points.groupBy("mask", "point").agg(F.min(F.when(F.col("near"), F.col("fingerprint"))).alias("src"), F.count(F.lit(1)).alias("met"))
    heads = heads.where("met > 1 AND src IS NOT NULL").drop("met")
    stars = points.join(heads, ["mask", "point"]).where("src <> fingerprint").select("src", F.col("fingerprint").alias("dst"))
    return pairs.unionByName(stars)


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, small: int = SMALL,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, fingerprint (long), component_id``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; shingles are runs of ``shingle`` words joined by spaces,
    repeats included, or the whole sequence of a shorter text. Bit i of the fingerprint is 1 if bit i is set in over half of the
    shingles' XXH64 (seed 42). Fingerprints link when they differ in at most ``radius`` bits; ``component_id`` is the
    smallest id that links lead to, a document's own included.

    Defined cases: null and empty texts, and texts without words, have the fingerprint zero, which links like any other; a
    bit set in exactly half of the hashes is 0; a null id is never a smallest id: its row gets the smallest other id of
    its component, or null; repeated rows and rows that share an id or a text are documents of their own; texts of any
    length are read in bounded steps; other columns of any name are ignored; no rows give no rows.
    """
    work = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = store(fingerprints(work, shingle=shingle, carry=["doc_id"]).select("row.doc_id", "fingerprint"))
    classes = store(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    labels = components(find_links(classes.select("fingerprint"), radius, small)).withColumnRenamed("node", "fingerprint")
    labelled = store(classes.join(labels, "fingerprint", "left").select("fingerprint", "least", F.coalesce("label", "fingerprint").alias("label")))
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    whole = store(labelled.join(ids, "label").select("fingerprint", "component_id"))
    return prints.join(whole, "fingerprint").select("doc_id", "fingerprint", "component_id")
