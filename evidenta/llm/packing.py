"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A length ``r`` belongs to the reciprocal-capacity class ``k = floor(capacity / r)``: ``k`` such pieces
fit a bin, whatever their order, so a class fills its bins with a fixed count of pieces and
no other bookkeeping. Each document is cut by its own length alone: full sequences first; then,
while the rest would leave more than ``1/waste`` of its class's slot empty, a piece of the
next class's exact slot is cut off. Cuts never depend on other documents, so tokens are read once
and only piece rows are shuffled.

Workers fill bins independently: pieces are dealt into buckets by a hash of document and position
(the number of buckets follows the number of documents), so neither a hot source nor one huge
document meets in one task. In a bucket, what is left of the classes (fewer than ``k``
pieces each) is packed together, largest first, into the first bin that has room.

Defined cases: a null text is empty (its document is the end id alone); repeated rows are packed
each; a null ``doc_id`` is carried as null; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidenta.llm.tokens import encoder, public_path

CAPACITY = 2048
WASTE = 32  # at most 1/32 of a slot stays empty
BUCKET_DOCS = 4096
PIECES = "doc_id string, copy long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(n: int, capacity: int = CAPACITY, waste: int = WASTE) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens."""
    out = [capacity] * (n // capacity)
    r = n % capacity
    while r:
        slot = capacity // (capacity // r)
        if (slot - r) * waste <= slot:
            out.append(r)
            break
        small = capacity // (capacity // r + 1)
        out.append(small)
        r -= small
    return out


def _pieces(batches: Iterator[pd.DataFrame], path: str, end: int, capacity: int, waste: int) -> Iterator[pd.DataFrame]:
    tail = np.asarray([end], dtype="<u4").tobytes()
    known: dict[int, list[int]] = {}
    for batch in batches:
        rows = []
        for k, (doc, ids) in enumerate(zip(batch["doc_id"], encoder(path).ids(batch["text"]), strict=True)):
            ids += tail
            n, at = len(ids) // 4, 0
            if n not in known:
                known[n] = cuts(n, capacity, waste)
                if len(known) > 100_000:
                    known = {n: known[n]}
            for length in known[n]:
                rows.append((doc, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n))
                at += length
        yield pd.DataFrame(rows, columns=["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens"])


def _fill(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins of one bucket: every class by itself, then what they leave, largest first."""
    frame = frame.sort_values(["length", "doc_id", "start", "copy"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
    length = frame["length"].to_numpy()
    k = capacity // length
    change = np.nonzero(np.diff(k))[0] + 1
    begin = np.concatenate([[0], change])  # lengths of a class are neighbours after the sort
    size = np.diff(np.concatenate([begin, [len(k)]]))
    start = np.repeat(begin, size)
    rank = np.arange(len(k)) - start
    whole = rank < (np.repeat(size, size) // k) * k
    per = (size // k[begin]).astype(np.int64)
    base = np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), size)
    bin_ = np.where(whole, base + rank // k, -1)
    bins, room = int(per.sum()), []
    for i in np.nonzero(~whole)[0]:
        for b, free in enumerate(room):
            if free >= length[i]:
                break
        else:
            b = len(room)
            room.append(capacity)
        room[b] -= length[i]
        bin_[i] = bins + b
    order = np.lexsort((np.arange(len(bin_)), bin_))
    sorted_bin, sorted_len = bin_[order], length[order]
    end = np.cumsum(sorted_len)
    head = np.searchsorted(sorted_bin, sorted_bin, side="left")
    offset = np.empty(len(order), dtype=np.int64)
    offset[order] = (end - sorted_len) - (end[head] - sorted_len[head])
    return frame.assign(sequence_id=(frame["bucket"].to_numpy().astype(np.int64) << 32) + bin_, offset=offset)


def pack(
    docs: DataFrame, path: str | None = None, end: int = 1, capacity: int = CAPACITY, waste: int = WASTE, bucket_docs: int = BUCKET_DOCS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    path = path or public_path()
    n = docs.count()
    buckets = max(1, math.ceil(n / bucket_docs))
    # ids travel as strings: pandas would make a float of a long that can be null
    pieces = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        lambda it: _pieces(it, path, end, capacity, waste), PIECES
    )
    keyed = pieces.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(doc_id, start), {buckets}) as int)"))
    schema = PIECES + ", bucket int, sequence_id long, offset long"
    packed = keyed.groupBy("bucket").applyInPandas(lambda frame: _fill(frame, capacity), schema)
    return packed.select(F.col("doc_id").cast("long").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
