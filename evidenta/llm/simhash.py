"""SimHash near-duplicates by a binary trie self-join.

Fingerprints (one 64-bit long a document) link when they differ in at most three bits. Equal
fingerprints are collapsed first. The distinct ones form a binary trie over their bits; the join
walks pairs of trie nodes together, adds one to a pair's difference where the branches taken
differ, and prunes a pair once its difference is over the budget. Of three differing bits one half
of the fingerprint has at most one, so two tries are walked: the first with the high half first,
the second with the low half first, each with budget one in its first 32 levels and three in all.
That keeps the number of node pairs near ``n log n`` where one trie with budget three has
``n log^3 n``.

The top of the tries is dealt over the cluster: a fingerprint goes, for each of the first ``P``
bits, to the subtree pair that may differ in that bit. ``P`` follows the number of distinct
fingerprints, so a task's subtrees stay at a few thousand leaves; a subtree pair that is dense
(a large family of close variants) is cut into blocks and joined block by block. A task returns
a star per connected group it found, never all pairs.

Defined cases: a null or empty text has fingerprint zero, linked like any other; repeated rows are
returned each; a null ``doc_id`` never names a component (its component is null if no other
row of it has an id); other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenta.llm.common import Scratch, components, quoted, unused

BITS, BUDGET, HALF = 64, 3, 1
LEAVES = 4096  # of a task's subtree pair, on average
DENSE = 16384  # leaves of a subtree pair beyond which it is cut into blocks
FRONTIER = 1 << 19  # node pairs held at once
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of a text's word shingles (repeats included), XXH64 under ``seed``."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=n)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; eight byte counters are added at once."""
    n = len(hashes)
    padded = np.zeros(-(-n // 255) * 255, dtype=np.uint64)
    padded[:n] = hashes
    rows = padded.reshape(-1, 255)
    value = 0
    for bit in range(8):
        lanes = ((rows >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.nonzero(counts * 2 > n)[0]:
            value |= 1 << (8 * int(byte) + bit)
    return value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.fromiter(map(fingerprint, texts), dtype=np.uint64, count=len(texts)).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), simhash(F.col(text_col)).alias("fp"))


class _Union:
    """Connected groups of a task's leaves, by vectorised hooking and pointer jumping."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label[:] = jumped

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        leaf = np.nonzero(self.label != np.arange(len(self.label)))[0]
        return leaf, self.label[leaf]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_links(x: np.ndarray, pairs: list[tuple[int, int, int, int, int]], depth: int, rotated: bool, found) -> None:
    """Walk node pairs of a sorted array of distinct fingerprints.

    A node is a range of ``x`` that shares its first ``depth`` bits. ``pairs`` has
    ``(a_from, a_to, b_from, b_to, difference)``; ``found(i, j)`` gets positions of linked leaves.
    ``rotated``: halves are swapped, and pairs that the other trie finds are left to it.
    """
    stack = [(np.array(pairs, dtype=np.int64).reshape(-1, 5), depth)]
    while stack:
        nodes, level = stack.pop()
        if not len(nodes):
            continue
        if len(nodes) > FRONTIER:
            half = len(nodes) // 2
            stack += [(nodes[:half], level), (nodes[half:], level)]
            continue
        a0, a1, b0, b1, d = nodes.T
        few = ((a1 - a0) * (b1 - b0) <= 4) | (level >= BITS)
        if few.any():
            _leaves(x, nodes[few], rotated, found)
            a0, a1, b0, b1, d = nodes[~few].T
        if not len(a0):
            continue
        bit = np.uint64(1 << (BITS - 1 - level))
        am, bm = _split(x, a0, a1, bit), _split(x, b0, b1, bit)
        same = (a0 == b0) & (a1 == b1)
        budget = HALF if level < 32 else BUDGET
        parts = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1), (am[~same], a1[~same], b0[~same], bm[~same], d[~same] + 1)]
        below = np.concatenate([np.stack(p, axis=1) for p in parts])
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= budget)]
        stack.append((below, level + 1))


def _split(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First position of each range whose bit is set, by bisection."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        one = (x[np.minimum(mid, len(x) - 1)] & bit) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _leaves(x: np.ndarray, nodes: np.ndarray, rotated: bool, found) -> None:
    """Compare the leaves below small node pairs."""
    a0, a1, b0, b1, _ = nodes.T
    wide, tall = a1 - a0, b1 - b0
    n = wide * tall
    each = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, j = a0[each] + k // tall[each], b0[each] + k % tall[each]
    open_ = i != j
    i, j = i[open_], j[open_]
    diff = x[i] ^ x[j]
    high = _popcount(diff >> np.uint64(32))
    low = _popcount(diff & np.uint64(0xFFFFFFFF))
    ok = (high <= HALF) & (high + low <= BUDGET)
    if rotated:
        ok &= low > HALF
    found(i[ok], j[ok])


def _task(key, frame: pd.DataFrame, prefix_bits: int) -> pd.DataFrame:
    """Links of one subtree pair (or of two of its blocks), as a star for each group."""
    trie, bit = int(key[0]), int(key[1])
    x = frame["fp"].to_numpy(np.int64).view(np.uint64)
    if trie:
        x = (x << np.uint64(32)) | (x >> np.uint64(32))
    side = frame["block_side"].to_numpy()
    x, first = np.unique(x, return_index=True)
    side = side[first]
    joined = _Union(len(x))
    mark = np.uint64(1 << (BITS - 1 - bit))
    one = (x & mark) != 0

    def walk(left: np.ndarray, right: np.ndarray | None, d: int) -> None:
        """left and right: positions; right None: a self-join."""
        pool = np.sort(left) if right is None else np.concatenate([left, right])
        if right is None:
            trie_links(x[pool], [(0, len(pool), 0, len(pool), d)], prefix_bits, bool(trie), lambda i, j: joined.add(pool[i], pool[j]))
        elif len(left) and len(right):
            n = len(left)
            trie_links(x[pool], [(0, n, n, len(pool), d)], prefix_bits, bool(trie), lambda i, j: joined.add(pool[i], pool[j]))

    for p, q in ((0, 0),) if (side == 0).all() else ((1, 2),):
        mine, other = side == p, side == q
        spot = np.nonzero
        walk(spot(mine & ~one)[0], spot(other & one)[0], 1)
        if p != q:
            walk(spot(mine & one)[0], spot(other & ~one)[0], 1)
        if bit == 0:
            for value in (one, ~one):
                walk(spot(mine & value)[0], None if p == q else spot(other & value)[0], 0)
    leaf, root = joined.stars()
    if trie:
        x = (x << np.uint64(32)) | (x >> np.uint64(32))
    return pd.DataFrame({"a": x[leaf].view(np.int64), "b": x[root].view(np.int64)})


def links(distinct: DataFrame, scratch: Scratch, leaves: int = LEAVES, dense: int = DENSE) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly what links of ``distinct`` (column ``fp``) connect."""
    n = distinct.count()
    bits = min(32, max(1, math.ceil(math.log2(max(n, 1) / leaves)))) if n > leaves else 1
    rotated = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    keyed = (
        distinct.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("trie"), F.col("fp").alias("x")), F.struct(F.lit(1).alias("trie"), rotated.alias("x")))).alias("t"))
        .select("fp", "t.trie", F.shiftrightunsigned("t.x", BITS - bits).alias("top"))
        .select("fp", "trie", "top", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
        .select("fp", "trie", "bit", F.col("top").bitwiseAND(F.expr(f"~shiftleft(1L, {bits - 1} - bit)")).alias("prefix"))
    )
    crowded = scratch.save(keyed.groupBy("trie", "bit", "prefix").count().where(F.col("count") > dense), "dense")
    if crowded.isEmpty():
        dealt = keyed.select("fp", "trie", "bit", "prefix", F.lit(0).alias("block_a"), F.lit(0).alias("block_b"), F.lit(0).alias("block_side"))
    else:
        cut = keyed.join(crowded.withColumn("blocks", F.ceil(F.col("count") / dense).cast("int")).drop("count"), ["trie", "bit", "prefix"], "left")
        cut = cut.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.expr("cast(pmod(xxhash64(fp), blocks) as int)"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = cut.select(
            "fp", "trie", "bit", "prefix", F.least("mine", "other").alias("block_a"), F.greatest("mine", "other").alias("block_b"),
            F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("block_side"),
        )
    return dealt.groupBy("trie", "bit", "prefix", "block_a", "block_b").applyInPandas(lambda key, frame: _task(key, frame, bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id`` (smallest id reachable)."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    printed = scratch.save(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = scratch.save(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    groups = components(scratch.save(links(distinct, scratch, **sizes), "links"), scratch)
    member = distinct.join(groups.withColumnRenamed("node", "fp"), "fp")
    least = member.groupBy("component").agg(F.min("first_id").alias("least_id"))
    named = scratch.save(member.join(least, "component").select("fp", "least_id"), "named")
    classes = distinct.join(named, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return printed.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that have a near-duplicate of smaller id; columns as given.

    Rows that repeat the kept id stay as they are; a row with a null id has no rival that
    names it and stays.
    """
    found = near_duplicates(docs, id_col, text_col)
    gone_id = unused(docs, "gone_id")
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col(quoted(id_col)) == F.col(gone_id), "left_anti")
