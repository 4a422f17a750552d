"""Shared pieces of the training-data operators: scratch tables, word splitting, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenta.tables import Scratch, shared_folder

__all__ = ["SPACE_CHARS", "WORD", "Scratch", "components", "documents", "quoted", "shared_folder", "unused"]

#: ASCII white space; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def quoted(name: str) -> str:
    """A column's name for use in expressions, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def unused(frame: DataFrame, name: str) -> str:
    """``name``, or it with underscores added until no column of the frame is called so."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken or f"{name}_".lower() in taken:
        name = f"{name}_"
    return name


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph of longs: ``(node, component)``.

    Alternating large-star and small-star steps; the component is its smallest node. Each step is
    a partial aggregate and an equi-join, so a node with very many neighbours is pre-aggregated
    on the map side and its join partition can be split by adaptive execution. Only nodes of at
    least one edge between different nodes are returned.
    """
    spark = scratch.spark
    current = scratch.save(
        edges.where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )

    def summary(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    seen = summary(current)
    while seen[0]:
        both = current.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(
            current.select(F.col("v").alias("n"), F.col("u").alias("m"))
        )
        least = both.groupBy("n").agg(F.min("m").alias("r")).select("n", F.least("n", "r").alias("r"))
        large = scratch.save(
            both.join(least, "n").where("m > n").select(F.col("m").alias("u"), F.col("r").alias("v")).distinct(),
            "large",
        )
        root = large.groupBy("u").agg(F.min("v").alias("r"))
        small = scratch.save(
            root.select("u", F.col("r").alias("v"))
            .unionByName(large.join(root, "u").where("v != r").select(F.col("v").alias("u"), F.col("r").alias("v")))
            .distinct(),
            "small",
        )
        now = summary(small)
        scratch.drop(large)
        scratch.drop(current)
        current = small
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
