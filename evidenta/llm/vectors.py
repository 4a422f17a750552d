"""Embedding near-duplicates by an exact metric range join.

Unit vectors of one label whose cosine reaches the threshold are within
``eps = sqrt(2 - 2 * threshold)`` of each other. Equal vectors are collapsed into one class with a
weight. A label with many classes gets pivots (a bounded, hash-drawn sample of its own rows): each
vector lives in the cell of its nearest pivot and is copied as a guest to every other cell that
could hold a partner. With ``d`` the distances to home pivot ``p`` and other pivot ``q``, a partner
living at ``q`` forces, by the triangle inequality, ``d(x,q) - d(x,p) <= 2 eps``; on the unit sphere
the bisector gives the sharper ``(d(x,q)^2 - d(x,p)^2) / (2 d(p,q)) <= eps``. Both hold for every
link, so no link is lost, and cells join independently: a row's links are counted in its home
cell alone. A cell with many rows is cut into blocks, joined block by block. A task returns
counts and one star per connected group, never pairs.

Defined cases: rows whose label or id is null, or whose vector is null, empty, zero, or holds a null
or non-finite component, link with nothing; vectors of different lengths never link; rows that
repeat are separate vectors and count as each other's links, and so are different vectors under one id; other
columns are ignored. An empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidenta.llm.common import Scratch, components

CELL = 2048  # classes a cell is meant to hold
MOST_PIVOTS = 4096  # over all labels; what the driver gathers and sends to the tasks
BLOCK = 4096  # rows of a cell beyond which it is cut into blocks
SLACK = 1e-9


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _pivots(classes: DataFrame, total: int, cell: int, most: int) -> dict[tuple[int, int], np.ndarray]:
    """Pivots by (label, dimension) for those with over ``cell`` classes; bounded in all."""
    share = max(cell, math.ceil(total / most * 2))
    large = classes.groupBy("label", "dim").count().where(F.col("count") > share)
    drawn = (
        classes.join(large, ["label", "dim"])
        .where(F.expr(f"pmod(xxhash64(rep, 11L), 1000000007L) < 1000000007D * ceil(count / {share}D) / count"))
        .select("label", "dim", "unit_of")
        .orderBy(F.xxhash64("label", "dim", "unit_of"))
        .limit(most)
        .collect()
    )
    found: dict[tuple[int, int], list] = {}
    for row in drawn:
        found.setdefault((row["label"], row["dim"]), []).append(row["unit_of"])
    return {k: _unit(np.array(v, dtype=np.float64)) for k, v in found.items() if len(v) > 1}


def _deal(batches: Iterator[pd.DataFrame], pivots: dict, eps: float) -> Iterator[pd.DataFrame]:
    """Home and guest rows of each class: ``label, dim, cell, home, rep, weight, unit_of``."""
    for batch in batches:
        out = []
        for (label, dim), rows in batch.groupby(["label", "dim"], sort=False):
            p = pivots.get((label, dim))
            if p is None:
                out.append(rows.assign(cell=0, home=True))
                continue
            x = _unit(np.stack(rows["unit_of"].to_numpy()).astype(np.float64))
            near = np.sqrt(np.maximum(0, 2 - 2 * (x @ p.T)))
            between = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
            home = near.argmin(axis=1)
            mine = near[np.arange(len(x)), home][:, None]
            apart = near**2 - mine**2 <= 2 * between[home] * eps + SLACK
            go = apart & (near - mine <= 2 * eps + SLACK)
            go[np.arange(len(x)), home] = True
            row, cell = np.nonzero(go)
            out.append(rows.iloc[row].assign(cell=cell, home=cell == home[row]))
        if out:
            yield pd.concat(out)[["label", "dim", "cell", "home", "rep", "weight", "unit_of"]]


def _join(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of the home rows of a cell's block with another: counts, and stars of groups."""
    role = frame["role"].to_numpy()
    raw = np.stack(frame["unit_of"].to_numpy()).astype(np.float64)
    unit, rep, weight = _unit(raw), frame["rep"].to_numpy(), frame["weight"].to_numpy()
    home, member = np.nonzero(role != 1)[0], np.nonzero(role != 0)[0]
    ids, at = np.unique(rep, return_inverse=True)
    label = np.arange(len(ids))
    counts = np.zeros(len(home), dtype=np.int64)
    for k in range(0, len(home), 512):
        rows = home[k : k + 512]
        close = unit[rows] @ unit[member].T
        i, j = np.nonzero(close >= threshold - SLACK)
        i, j, value = rows[i], member[j], close[i, j]
        edge = np.abs(value - threshold) <= SLACK
        if edge.any():  # so near the threshold, by the plain formula in double precision
            a, b = raw[i[edge]], raw[j[edge]]
            value[edge] = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
        ok = (value >= threshold) & (rep[i] != rep[j])
        i, j = i[ok], j[ok]
        counts[k : k + 512] = np.bincount(i - 0, weights=weight[j], minlength=len(rep))[rows].astype(np.int64)
        a, b = at[i], at[j]
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            if len(a):
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while not (label[label] == label).all():
                    label[:] = label[label]
    some = counts > 0
    leaf = np.nonzero(label != np.arange(len(label)))[0]
    return pd.DataFrame({
        "rep": np.concatenate([rep[home][some], ids[leaf]]),
        "links": np.concatenate([counts[some], np.zeros(len(leaf), dtype=np.int64)]),
        "other": np.concatenate([rep[home][some], ids[label[leaf]]]),
    })


def range_join(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cell: int = CELL, most_pivots: int = MOST_PIVOTS, block: int = BLOCK,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("v", F.transform(v, lambda e: e + F.lit(0).cast("float")))  # no negative zero
    fit = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
        & F.coalesce(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
        & F.exists(v, lambda e: e != 0)
    )
    rows = rows.withColumn("v", F.when(fit, v))
    keys = [F.when(v.isNotNull(), F.xxhash64(F.lit(k), "label", "v")).alias(f"k{k}") for k in (1, 2)]
    classes = (
        rows.where(v.isNotNull()).groupBy("label", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"))
        .select("label", F.size("v").alias("dim"), "first_id", "weight", F.col("v").alias("unit_of"), *keys)
    )
    # a class has a number of its own: different vectors may share an id
    classes = scratch.save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    pivots = spark.sparkContext.broadcast(_pivots(classes, classes.count(), cell, most_pivots))
    schema = classes.select("label", "dim", F.lit(0).alias("cell"), F.lit(True).alias("home"), "rep", "weight", "unit_of").schema
    dealt = scratch.save(classes.drop("k1", "k2", "first_id").mapInPandas(lambda it: _deal(it, pivots.value, eps), schema), "dealt")
    cells = dealt.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"))
    where = ["label", "dim", "cell"]
    cut = dealt.join(cells.select(*where, F.ceil(F.col("n") / block).cast("int").alias("blocks")), where)
    cut = cut.withColumn("mine", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("hb"), F.col("mine").alias("mb"), F.lit(1).alias("role")))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.col("mine").alias("hb"), k.alias("mb"), F.lit(0).alias("role")))
    alone = F.array(F.struct(F.lit(0).alias("hb"), F.lit(0).alias("mb"), F.when(F.col("home"), 2).otherwise(1).alias("role")))
    cut = cut.withColumn("go", F.explode(F.when(F.col("blocks") == 1, alone).when(F.col("home"), F.concat(every, others)).otherwise(every)))
    joined = cut.select(*where, "go.*", "rep", "weight", "unit_of").groupBy(*where, "hb", "mb").applyInPandas(
        lambda frame: _join(frame, threshold), "rep long, links long, other long"
    )
    joined = scratch.save(joined, "links")
    counts = joined.where("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(joined.where("rep != other"), scratch, "rep", "other")
    grouped = groups.withColumnRenamed("node", "rep").join(classes.select("rep", "first_id"), "rep")
    least = grouped.groupBy("component").agg(F.min("first_id").alias("least_id"))
    reached = grouped.join(least, "component").select("rep", "least_id")
    named = (
        classes.select("rep", "first_id", "weight", "k1", "k2").join(counts, "rep", "left").join(reached, "rep", "left")
        .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least_id", "first_id").alias("component_id"))
    )
    found = rows.select("vec_id", *keys).join(named, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
