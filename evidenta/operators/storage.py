"""Writing and reading sealed tables: projection, publication, evidence packs, cold reads and tiering."""

from __future__ import annotations

import json
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidenta.operators import chain

MAGIC, VERSION = "evidence-pack", 1


@dataclass(frozen=True)
class Sink:
    """What a sink keeps of a record, stated before anything is written to it."""

    name: str
    lossy: bool
    carries_payload: bool


PROJECTION = Sink("projection", lossy=False, carries_payload=False)


def project(sealed: DataFrame, path: str, single_file: bool = False) -> None:
    """The columnar projection, laid out by shard and segment and sorted by time inside, so scans prune both."""
    if single_file:
        sealed.coalesce(1).sortWithinPartitions("shard", "segment_id", "seq").write.parquet(path)
    else:
        sealed.repartition("shard", "segment_id").sortWithinPartitions("recorded_at_nanos").write.partitionBy("shard", "segment_id").parquet(path)


def read_projection(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(path)
    return found.withColumn("shard", F.col("shard").cast("int")).withColumn("segment_id", F.col("segment_id").cast("long"))


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file only if it is absent, or empty, which is what a run that died while creating it leaves; False if it is there."""
    jvm, p, fs = _fs(spark, path)
    there = fs.exists(p)
    if there and fs.getFileStatus(p).getLen():
        return False
    try:
        out = fs.create(p, there)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":  # another run was first
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _text(spark: SparkSession, path: str) -> str | None:
    _, p, fs = _fs(spark, path)
    if not fs.exists(p) or not fs.getFileStatus(p).getLen():
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def publish(body: DataFrame, folder: str, name: str, bits: int = 384) -> str:
    """Body first, then the manifest, whose creation is the commit: ``committed``, ``already-published`` or ``diverged``.

    A body is addressed by its digest, so a run that died between the two leaves nothing a reader sees
    and a second run completes it.
    """
    spark = body.sparkSession
    digest = content_digest(body, bits)
    manifest = json.dumps({"name": name, "digest": digest, "n": body.count()}, sort_keys=True)
    path = f"{folder}/{name}.manifest"
    there = _text(spark, path)
    if there is None:
        body.write.mode("overwrite").parquet(f"{folder}/bodies/{digest}")
        if _create(spark, path, manifest):
            return "committed"
        there = _text(spark, path)
    return "already-published" if there == manifest else "diverged"


def content_digest(frame: DataFrame, bits: int = 384) -> str:
    """A digest of a set of rows, whatever their order: a tree over per-segment digests of sorted row digests."""
    row = F.sha2(F.to_json(F.struct(*sorted(frame.columns))), bits)
    keyed = frame.select(F.pmod(F.xxhash64(row), F.lit(4096)).alias("part"), row.alias("row"))
    parts = keyed.groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row")), "|"), bits).alias("digest"))
    return chain.root([r["digest"] for r in parts.orderBy("part").collect()], bits)  # at most 4096 rows


def fetch(spark: SparkSession, folder: str, name: str, bits: int = 384) -> DataFrame:
    """A published body, checked against its manifest."""
    text = _text(spark, f"{folder}/{name}.manifest")
    if text is None:
        raise FileNotFoundError(f"{name} is not published")
    manifest = json.loads(text)
    body = spark.read.parquet(f"{folder}/bodies/{manifest['digest']}")
    if body.count() != manifest["n"]:
        raise ValueError(f"{name} has not the number of records its manifest states")
    if content_digest(body, bits) != manifest["digest"]:
        raise ValueError(f"{name} does not match its digest")
    return body


def reseal_differences(sealed: DataFrame, manifests: DataFrame, bits: int = 384) -> DataFrame:
    """Manifest rows that rebuilding the segments from their records does not give."""
    return manifests.select("shard", "segment_id", "manifest_root").exceptAll(chain.manifests(chain.seal(sealed, bits), bits).select("shard", "segment_id", "manifest_root"))


def hot_segments(manifests: DataFrame, keep_hot: int = 4) -> DataFrame:
    """``shard, segment_id, tier``: the newest segments of each shard are hot; the others may be evicted once published."""
    newest = Window.partitionBy("shard").orderBy(F.col("segment_id").desc())
    return manifests.select("shard", "segment_id", F.when(F.row_number().over(newest) <= keep_hot, "hot").otherwise("cold").alias("tier"))


def evidence_pack(sealed: DataFrame, manifests: DataFrame, folder: str, bits: int = 384) -> str:
    """A folder another party can verify alone: records, manifests and a header with the store root."""
    spark = sealed.sparkSession
    sealed.write.parquet(f"{folder}/records")
    manifests.write.parquet(f"{folder}/manifests")
    rows = spark.read.parquet(f"{folder}/manifests").select("shard", "segment_id", "manifest_root").collect()
    root = chain.store_root(rows, bits)
    header = {"format": MAGIC, "version": VERSION, "hash_bits": bits, "segments": len(rows), "store_root": root}
    _create(spark, f"{folder}/header.json", json.dumps(header, sort_keys=True))
    return root


def open_pack(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    header = json.loads(_text(spark, f"{folder}/header.json") or "{}")
    if header.get("format") != MAGIC or header.get("version") != VERSION:
        raise ValueError("not an evidence pack of a known version")
    return spark.read.parquet(f"{folder}/records"), spark.read.parquet(f"{folder}/manifests"), header
