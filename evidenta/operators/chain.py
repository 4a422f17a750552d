"""Canonical text of records, hash chains, Merkle roots, index entries and sealed segments.

The engine's own formats: every hashed text is made of fixed-length hex and length-prefixed
fields under a domain word, so no two inputs share a text. ``bits`` chooses SHA-384 (the default) or SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from evidenta.operators.query import event_code
from evidenta.schema import DIMENSIONS, RECORDS

CHAIN, GENESIS, LEAF, NODE, ENTRY = "chain/v1", "genesis/v1", "0", "1", "entry/v1"
#: What a record commits to: all but its place in the chain and the links themselves.
COMMITTED = [f.name for f in RECORDS.fields if f.name not in ("chain_link", "prev_hash", "segment_id", "seq", "shard")]


def digest(text: str, bits: int = 384) -> str:
    return hashlib.new(f"sha{bits}", text.encode()).hexdigest()


def canonical(columns: list[str] = COMMITTED, types: dict | None = None) -> Column:
    """Length-prefixed fields; null is ``N``, a list is its length and its items."""
    types = types or {f.name: f.dataType for f in RECORDS.fields}

    def one(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("N")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))

    out = []
    for name in columns:
        if isinstance(types.get(name, StringType()), ArrayType):
            items = F.concat_ws("", F.transform(name, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)))
            out.append(F.when(F.col(name).isNull(), F.lit("N")).otherwise(F.concat(F.lit("L"), F.size(name).cast("string"), F.lit(";"), items)))
        else:
            out.append(one(F.col(name)))
    return F.concat(*out)


def genesis(shard: int, bits: int = 384) -> str:
    return digest(f"{GENESIS}|{shard}", bits)


def chain_step(prev: str, seq: int, body: str, bits: int = 384) -> str:
    """The link after ``prev``; ``body`` is the digest of a record's canonical text."""
    return digest(f"{CHAIN}|{prev}|{seq}|{body}", bits)


def link_column(prev: Column, seq: Column, body: Column, bits: int = 384) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(CHAIN), prev, seq.cast("string"), body), bits)


def link(records: DataFrame, bits: int = 384, columns: list[str] = COMMITTED, heads: dict[int, str] | None = None) -> DataFrame:
    """``shard, segment_id, seq, record_id, prev_hash, chain_link``, chained over each shard's segments.

    ``heads``: links that shards' chains go on from; others start at their genesis.

    Digests of records are built by Spark; only the fold itself, which has an order, runs as a stream of
    Arrow batches over each shard's sorted rows, in constant memory.
    """
    rows = records.select("shard", "segment_id", "seq", "record_id", F.sha2(canonical(columns), bits).alias("body"))
    ordered = rows.repartition("shard").sortWithinPartitions("shard", "segment_id", "seq")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, head = None, ""
        for batch in batches:
            before, after = [], []
            for s, seq, body in zip(batch["shard"], batch["seq"], batch["body"], strict=True):
                if s != shard:
                    shard, head = s, (heads or {}).get(s) or genesis(s, bits)
                before.append(head)
                head = chain_step(head, seq, body, bits)
                after.append(head)
            yield batch[["shard", "segment_id", "seq", "record_id"]].assign(prev_hash=before, chain_link=after)

    return ordered.mapInPandas(fold, "shard int, segment_id long, seq long, record_id string, prev_hash string, chain_link string")


def seal(records: DataFrame, bits: int = 384, columns: list[str] = COMMITTED, heads: dict[int, str] | None = None) -> DataFrame:
    """The records with their links set."""
    links = link(records, bits, columns, heads)
    return records.drop("prev_hash", "chain_link").join(links.drop("record_id"), ["shard", "segment_id", "seq"]).select(*records.columns)


def verify_chain(sealed: DataFrame, bits: int = 384, columns: list[str] = COMMITTED) -> DataFrame:
    """Rows whose link or predecessor is wrong, found in parallel: each row against the one before it."""
    order = Window.partitionBy("shard").orderBy("segment_id", "seq")
    body = F.sha2(canonical(columns), bits)
    start = F.sha2(F.concat_ws("|", F.lit(GENESIS), F.col("shard").cast("string")), bits)
    checked = sealed.select(
        "shard", "segment_id", "seq", "record_id", F.coalesce(F.lag("chain_link").over(order), start).alias("expected_prev"), "prev_hash", "chain_link",
        link_column(F.col("prev_hash"), F.col("seq"), body, bits).alias("expected_link"),
    )
    return checked.where("prev_hash != expected_prev or chain_link != expected_link")


# --- Merkle trees (the shape of RFC 6962: an odd node is promoted) ---


def leaf_hash(text: str, bits: int = 384) -> str:
    return digest(f"{LEAF}|{text}", bits)


def node_hash(a: str, b: str, bits: int = 384) -> str:
    return digest(f"{NODE}|{a}|{b}", bits)


def levels(leaves: list[str], bits: int = 384) -> list[list[str]]:
    """All levels, leaves first; at most two nodes a leaf, so a proof is read off in ``log n``."""
    out = [leaves]
    while len(out[-1]) > 1:
        row = out[-1]
        out.append([node_hash(row[i], row[i + 1], bits) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)])
    return out


def root(leaves: list[str], bits: int = 384) -> str:
    return levels(leaves, bits)[-1][0] if leaves else digest("", bits)


def inclusion(tree: list[list[str]], at: int) -> list[str]:
    """Siblings from the leaf up; levels where a node was promoted have none."""
    path = []
    for row in tree[:-1]:
        if at ^ 1 < len(row):
            path.append(row[at ^ 1])
        at //= 2
    return path


def verify_inclusion(leaf: str, at: int, size: int, path: list[str], expected: str, bits: int = 384) -> bool:
    """Position and size come from the caller, never from the proof."""
    if not 0 <= at < size:
        return False
    path, node = list(path), leaf
    while size > 1:
        if at ^ 1 < size:
            if not path:
                return False
            other = path.pop(0)
            node = node_hash(node, other, bits) if at % 2 == 0 else node_hash(other, node, bits)
        at, size = at // 2, (size + 1) // 2
    return not path and node == expected


def _peaks(size: int) -> list[tuple[int, int]]:
    """Complete subtrees (level, position) that make up the first ``size`` leaves."""
    out, start = [], 0
    for level in reversed(range(size.bit_length())):
        if size >> level & 1:
            out.append((level, start >> level))
            start += 1 << level
    return out


def consistency(tree: list[list[str]], old: int) -> list[str]:
    """A proof that the first ``old`` leaves of a tree are unchanged: its complete subtrees, then what joins them."""
    size = len(tree[0])
    if not 0 < old <= size:
        raise ValueError("the old size must be within the tree")
    return [tree[level][at] for level, at in _peaks(old)] + [tree[0][i] for i in range(old, old)] + _cover(tree, old, size)


def _cover(tree: list[list[str]], lo: int, hi: int) -> list[str]:
    """Nodes that cover leaves ``lo..hi`` from left to right, each as high as it can be."""
    out = []
    while lo < hi:
        level = 0
        while lo % (2 << level) == 0 and lo + (2 << level) <= hi:
            level += 1
        out.append(tree[level][lo >> level])
        lo += 1 << level
    return out


def verify_consistency(old: int, old_root: str, size: int, new_root: str, proof: list[str], bits: int = 384) -> bool:
    """Both roots must follow from the proof's nodes."""
    if not 0 < old <= size:
        return False
    sizes = [1 << level for level, _ in _peaks(old)]
    lo, more = old, []
    while lo < size:
        level = 0
        while lo % (2 << level) == 0 and lo + (2 << level) <= size:
            level += 1
        more.append(1 << level)
        lo += 1 << level
    if len(proof) != len(sizes) + len(more):
        return False

    def fold(parts: list[tuple[int, str]]) -> str:
        # a tree splits at the largest power of two below its size
        total = sum(n for n, _ in parts)
        if len(parts) == 1:
            return parts[0][1]
        split, left, k = 1 << (total - 1).bit_length() - 1, 0, 0
        while left < split:
            left += parts[k][0]
            k += 1
        return node_hash(fold(parts[:k]), fold(parts[k:]), bits)

    nodes = list(zip(sizes + more, proof, strict=True))
    return fold(nodes[: len(sizes)]) == old_root and fold(nodes) == new_root


# --- indexes and manifests ---


def key_column(dimension: str) -> Column:
    """An index key as text whose order is that of the values."""
    if dimension == "recorded_at_nanos":
        return F.lpad(F.col(dimension).cast("string"), 20, "0")
    if dimension == "event_type":
        return F.lpad(event_code(F.col(dimension)).cast("string"), 3, "0")
    return F.col(dimension)


def entry_text(key: Column, seq: Column, chain_link: Column) -> Column:
    return F.concat_ws("|", F.lit(ENTRY), F.concat(F.length(key).cast("string"), F.lit(":"), key), seq.cast("string"), chain_link)


def index_entries(sealed: DataFrame, dimensions: list[str] = DIMENSIONS, bits: int = 384) -> DataFrame:
    """``dimension, shard, segment_id, pos, key, seq, chain_link, leaf`` sorted by (key, seq) in each segment."""
    keyed = sealed.select("shard", "segment_id", "seq", "chain_link", F.explode(F.map_from_arrays(F.array(*[F.lit(d) for d in dimensions]), F.array(*[key_column(d) for d in dimensions]))).alias("dimension", "key"))
    order = Window.partitionBy("shard", "segment_id", "dimension").orderBy("key", "seq")
    placed = keyed.withColumn("pos", F.row_number().over(order) - 1)
    leaf = F.sha2(F.concat_ws("|", F.lit(LEAF), entry_text(F.col("key"), F.col("seq"), F.col("chain_link"))), bits)
    return placed.select("dimension", "shard", "segment_id", "pos", "key", "seq", "chain_link", leaf.alias("leaf"))


def merkle_roots(leaves: DataFrame, keys: list[str], order: str, leaf: str, bits: int = 384) -> DataFrame:
    """One root a group (a segment's few thousand leaves): ``keys, n_leaves, root``."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.select(*keys).schema.fields), "n_leaves long, root string"])

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        nodes = frame.sort_values(order)[leaf].tolist()
        return pd.DataFrame([(*key, len(nodes), root(nodes, bits))])

    return leaves.select(*keys, order, leaf).groupBy(*keys).applyInPandas(one, schema)


def duplicates(entries: DataFrame) -> DataFrame:
    """Positions that an index holds twice: same key and sequence number."""
    return entries.groupBy("dimension", "shard", "segment_id", "key", "seq").count().where("count > 1")


def history_roots(sealed: DataFrame, bits: int = 384) -> DataFrame:
    leaf = F.sha2(F.concat_ws("|", F.lit(LEAF), F.col("chain_link")), bits)
    return merkle_roots(sealed.select("shard", "segment_id", "seq", leaf.alias("leaf")), ["shard", "segment_id"], "seq", "leaf", bits)


def manifests(sealed: DataFrame, bits: int = 384) -> DataFrame:
    """One row a segment: counts, span, chain ends, history root and the five index roots.

    Refuses (``seal_error`` set) segments of mixed algorithms, repeated sequence numbers or gaps.
    """
    place = ["shard", "segment_id"]
    facts = sealed.groupBy(*place).agg(
        F.count("*").alias("n_records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("recorded_at_nanos").alias("min_recorded_at"), F.max("recorded_at_nanos").alias("max_recorded_at"),
        F.min_by("prev_hash", "seq").alias("chain_before"), F.max_by("chain_link", "seq").alias("chain_after"), F.countDistinct("seq").alias("n_seq"),
        F.countDistinct("hash_alg", "sig_alg", "kem_alg").alias("n_algs"), F.countDistinct("record_id").alias("n_ids"),
    )
    error = (
        F.when(F.col("n_algs") > 1, "mixed-algorithms").when((F.col("n_seq") < F.col("n_records")) | (F.col("n_ids") < F.col("n_records")), "duplicate-key")
        .when((F.col("first_seq") != 1) | (F.col("last_seq") - F.col("first_seq") + 1 != F.col("n_records")), "not-contiguous")
    )
    index = merkle_roots(index_entries(sealed, bits=bits), [*place, "dimension"], "pos", "leaf", bits)
    index = index.groupBy(*place).pivot("dimension", DIMENSIONS).agg(F.first("root"))
    index = index.select(*place, *[F.col(d).alias(f"root_{d}") for d in DIMENSIONS])
    history = history_roots(sealed, bits).select(*place, F.col("root").alias("history_root"))
    joined = facts.join(history, place).join(index, place)
    parts = [F.col(c).cast("string") for c in ("shard", "segment_id", "n_records", "min_recorded_at", "max_recorded_at", "chain_before", "chain_after", "history_root")]
    whole = F.sha2(F.concat_ws("|", F.lit("manifest/v1"), *parts, *[F.col(f"root_{d}") for d in DIMENSIONS]), bits)
    return joined.select(*place, "n_records", "first_seq", "last_seq", "min_recorded_at", "max_recorded_at", "chain_before", "chain_after", "history_root", *[f"root_{d}" for d in DIMENSIONS], whole.alias("manifest_root"), error.alias("seal_error"))


def shard_leaf(rows: list, bits: int = 384) -> str:
    """A shard's leaf in the store tree commits to the number of its segments."""
    return leaf_hash(f"{rows[0]['shard']}|{len(rows)}|{root([leaf_hash(r['manifest_root'], bits) for r in rows], bits)}", bits)


def store_root(manifest_rows: list, bits: int = 384) -> str:
    """Root over shards; manifests are a row a segment and small by design."""
    by_shard: dict[int, list] = {}
    for r in sorted(manifest_rows, key=lambda r: (r["shard"], r["segment_id"])):
        by_shard.setdefault(r["shard"], []).append(r)
    return root([shard_leaf(rows, bits) for _, rows in sorted(by_shard.items())], bits)
