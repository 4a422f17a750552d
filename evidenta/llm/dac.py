"""Token files of directly addressable codes.

An id is split into chunks from its low bits up. Level 0 holds the lowest chunk of every token; a
continuation bit says whether the token has a chunk on the next level, where the chunks of
those tokens that continue follow each other. A token at position ``i`` of a level is found on the
next one at ``rank(i)``, the number of continuation bits set before it; a directory with one count per
512 bits makes that a lookup and a popcount, so any token is read without decoding others. The chunk
widths of a file are those that cost the fewest bits for its ids (dynamic program over widths).

A file ("volume") is: magic ``DAC1``; header (documents, tokens, levels, widths and level sizes); document
ids with a null mark; document starts; then for each level its chunks bit-packed, its bitmap and its
directory. Volumes are written in ascending ``doc_id`` order as files of the shared folder by
Spark's text writer, byte for byte, one volume a file, and read as binary files.

Defined cases: a null or empty text is its end id alone; a null ``doc_id`` sorts first; repeated rows
are documents of their own; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidenta.llm.common import Scratch
from evidenta.llm.tokens import encoder, public_path

MAGIC = b"DAC1"
TOKENS = 4 << 20  # of a volume, about
RANK = 512
MOST_LEVELS = 8


def widths(ids: np.ndarray) -> list[int]:
    """Chunk widths with the smallest total of chunk and continuation bits."""
    if not len(ids):
        return [1]
    top = max(1, int(ids.max()).bit_length())
    longer = np.array([len(ids), *(np.count_nonzero(ids >> np.uint32(b)) for b in range(1, top))] + [0])  # ids with bits from b up
    best: list[tuple[int, list[int]]] = [(0, [])] * (top + 1)
    for b in range(top - 1, -1, -1):
        options = []
        for w in range(1, top - b + 1):
            last = b + w == top
            if len(best[b + w][1]) < MOST_LEVELS:
                options.append((int(longer[b]) * (w + (not last)) + best[b + w][0], [w, *best[b + w][1]]))
        best[b] = min(options)
    return best[0][1]


def _pack(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits each, low bit first."""
    bits = ((values[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def _unpack(data: np.ndarray, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    out = np.zeros(n, dtype=np.uint32)
    for k in range(width):
        out |= bits[:, k].astype(np.uint32) << np.uint32(k)
    return out


def encode(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A volume. ``starts``: first token of each document in ``ids`` (unsigned 32-bit)."""
    ids = np.asarray(ids, dtype=np.uint32)
    shape = widths(ids)
    out, rest, shift = [], ids, 0
    sizes = []
    for level, width in enumerate(shape):
        sizes.append(len(rest))
        block = 1 << 18
        packed = b"".join(_pack((rest[k : k + block]) & np.uint32((1 << width) - 1), width) for k in range(0, len(rest), block))
        out.append(packed)
        rest = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
        more = rest > 0
        if level + 1 < len(shape):
            bitmap = np.packbits(more, bitorder="little")
            full = np.zeros(-(-len(more) // RANK) * (RANK // 8), dtype=np.uint8)
            full[: len(bitmap)] = bitmap
            counts = np.bitwise_count(full).reshape(-1, RANK // 8).sum(axis=1, dtype=np.uint64)
            directory = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4") if len(counts) else np.zeros(0, "<u4")
            out += [full.tobytes(), directory.tobytes()]
            rest = rest[more]
        shift += width
    null = np.array([d is None for d in doc_ids], dtype=bool)
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    head = MAGIC + struct.pack("<QQB", len(doc_ids), len(ids), len(shape)) + bytes(shape) + struct.pack(f"<{len(shape)}Q", *sizes)
    return b"".join([head, names.tobytes(), np.packbits(null, bitorder="little").tobytes(), np.asarray(starts, dtype="<u8").tobytes(), *out])


class Volume:
    """Random access to an encoded volume."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC1 volume")
        docs, self.n, levels = struct.unpack_from("<QQB", data, 4)
        at = 21
        self.widths = list(data[at : at + levels])
        at += levels
        self.sizes = struct.unpack_from(f"<{levels}Q", data, at)
        at += 8 * levels
        raw = np.frombuffer(data, dtype=np.uint8)
        take = lambda n: raw[at : at + n]
        names = take(8 * docs).view("<i8")
        at += 8 * docs
        null = np.unpackbits(take(-(-docs // 8)), count=docs, bitorder="little") if docs else np.zeros(0)
        at += -(-docs // 8)
        self.doc_ids = [None if z else int(d) for d, z in zip(names, null, strict=True)]
        self.starts = take(8 * docs).view("<u8").astype(np.int64)
        at += 8 * docs
        self.levels = []
        for k, (width, n) in enumerate(zip(self.widths, self.sizes, strict=True)):
            block, chunks = 1 << 18, []
            for b in range(0, n, block):
                size = -(-min(block, n - b) * width // 8)
                chunks.append(take(size))
                at += size
            packed = np.concatenate(chunks) if chunks else raw[:0]
            bitmap = directory = None
            if k + 1 < levels:
                size = -(-n // RANK) * (RANK // 8)
                bitmap = take(size)
                at += size
                directory = take(4 * (-(-n // RANK))).view("<u4")
                at += 4 * (-(-n // RANK))
            self.levels.append((width, n, packed, bitmap, directory))

    def __getitem__(self, i: int) -> int:
        """One token, by its position in the volume."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for width, _, packed, bitmap, directory in self.levels:
            bit = i * width
            window = int.from_bytes(packed[bit // 8 : (bit + width + 7) // 8].tobytes(), "little")
            value |= ((window >> bit % 8) & ((1 << width) - 1)) << shift
            shift += width
            if bitmap is None or not bitmap[i // 8] >> i % 8 & 1:
                break
            block = i // RANK
            inside = bitmap[block * (RANK // 8) : i // 8]
            partial = int(bitmap[i // 8]) & ((1 << i % 8) - 1)
            i = int(directory[block]) + int(np.bitwise_count(inside).sum()) + partial.bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All tokens."""
        out, where, shift = np.zeros(self.n, dtype=np.uint32), None, 0
        for width, n, packed, bitmap, _ in self.levels:
            chunk = np.concatenate([_unpack(packed[b * width // 8 : -(-min(n, b + (1 << 18)) * width // 8)], min(n - b, 1 << 18), width) for b in range(0, n, 1 << 18)]) if n else np.zeros(0, np.uint32)
            if where is None:
                out |= chunk
            else:
                out[where] |= chunk << np.uint32(shift)
            shift += width
            if bitmap is not None:
                more = np.nonzero(np.unpackbits(bitmap, count=n, bitorder="little"))[0]
                where = more if where is None else where[more]
        return out


def _volumes(batches: Iterator[pd.DataFrame], path: str, end: int, tokens: int) -> Iterator[pd.DataFrame]:
    """Volumes of a partition whose rows come in order."""
    tail = np.asarray([end], dtype="<u4").tobytes()
    names, starts, parts, held = [], [], [], 0

    def volume() -> pd.DataFrame:
        return pd.DataFrame({"bytes": [encode(names, np.array(starts), np.frombuffer(b"".join(parts), dtype="<u4"))]})

    for batch in batches:
        for doc, ids in zip(batch["doc_id"], encoder(path).ids(batch["text"]), strict=True):
            names.append(None if doc is None else int(doc))
            starts.append(held)
            parts += [ids, tail]
            held += len(ids) // 4 + 1
            if held >= tokens:
                yield volume()
                names, starts, parts, held = [], [], [], 0
    if names:
        yield volume()


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"], strict=True):
            v = Volume(data)
            ids = v.ids().astype("<u4")
            ends = np.append(v.starts[1:], v.n)
            rows = [
                (path, k, None if d is None else str(d), int(a), int(b - a), zlib.crc32(ids[a:b].tobytes()))
                for k, (d, a, b) in enumerate(zip(v.doc_ids, v.starts, ends, strict=True))
            ]
            yield pd.DataFrame(rows, columns=["path", "k", "doc_id", "local", "n_tokens", "ids_crc32"])


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = 2, tokens: int = TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Token files of all documents, in ascending order of id."""
    path = path or public_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    volumes = rows.mapInPandas(lambda it: _volumes(it, path, end, tokens), "bytes binary")
    volumes.select(F.col("bytes").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)


def read(spark, folder: str, scratch: Scratch) -> DataFrame:
    """Documents of the files of a folder: ``doc_id, start, n_tokens, ids_crc32``."""
    opened = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "content")
    schema = "path string, k int, doc_id string, local long, n_tokens long, ids_crc32 long"
    found = scratch.save(opened.mapInPandas(_documents, schema).withColumn("doc_id", F.col("doc_id").cast("long")), "documents")
    # one row a file, in order of the partition and then the volume that wrote it
    per_file = found.groupBy("path").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy(*[F.regexp_extract("path", p, 1).cast("long") for p in (r"/part-(\d+)-[^/]*$", r"-c(\d+)\.txt$")])
    base = per_file.select("path", (F.sum("n").over(order) - F.col("n")).alias("base"))
    return found.join(base, "path").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def addressed(docs: DataFrame, **options) -> DataFrame:
    """Write the token files of all documents and read them back."""
    scratch = Scratch(docs.sparkSession, "tokens")
    folder = scratch.path("files")
    write(docs, folder, **options)
    return read(docs.sparkSession, folder, scratch)
