"""Mixing sources to target weights by entropy balancing.

Among all ways to give document ``i`` a rate between 0 and ``cap`` copies, the one nearest in entropy to taking every
document once, subject to token constraints, is an exponential tilt of each document: with ``n_i`` its number of
words, source ``s`` and language ``l``,

    rate_i = cap * p / (p + cap - 1),   p = exp((lambda_s + mu_l) * n_i / scale)

(cap 2: ``2 sigmoid``). The multipliers solve the convex dual. One hard constraint a source says that its expected
words are its target. One soft moment a language says that its share of the mix stays near its share of the
corpus; it couples the sources, and its penalty ``RIDGE`` keeps the dual solvable where targets leave no room for it.

Newton iterations aggregate value, gradient and Hessian of the dual over the corpus (documents of one source, language and
size are one row with a count, since they have one rate), and solve the small system on the driver: sources are
eliminated first, as their block is diagonal. What the driver holds is a few numbers for each pair of source and
language. Sources whose target is nothing, or ``cap`` times their words, have their multiplier at infinity and are set apart.

Rates become copies by error diffusion: in a bucket of a source (a large source has as many as its
rows ask for, dealt by a hash of the id, so a hot source never meets in one task), documents are
taken largest first, each rounded to the copies that keep the running number of words nearest to
the running expectation. The rest a bucket leaves is at most about half of one of its smallest
documents. No randomness is used, so reruns agree.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own,
last in order, and a null language a language of its own; repeated rows are separate documents; a source without words has target 0; an
empty table gives no row; other columns are ignored, whatever their names. A text may have any length: only its words are counted.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evidenta.llm.common import WORD, Scratch, quoted, unused

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2
BUCKET_ROWS = 2048
STEPS, TOLERANCE, DIGITS = 100, 1e-9, 8
RIDGE = 0.1  # penalty on a language's multiplier, in shares of the corpus


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    n = F.coalesce(F.regexp_count(F.col(quoted(text_col)), F.lit(WORD)), F.lit(0)).cast("long")
    lang = F.col(quoted(lang_col)).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(source_col)).alias("source"), lang.alias("lang"), n.alias("size"))


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Adds ``target`` to ``source, source_size``: weights repeat over the sources in code-point
    order, null last; a target over ``cap`` times its source stops there and its excess is reshared.

    Resharing has a closed form: with sources in order of ``cap * size / weight``, the first ones
    stop, and the rest share what remains; so one pass in that order finds where it ends.
    """
    ranked = by_source.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size").cast("double") * cap).withColumn("level", F.col("most") / F.col("weight"))
    order = Window.orderBy("level", "at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    budget = F.sum(F.col("source_size").cast("double")).over(whole) * share
    ranked = ranked.withColumn("water", (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # the first source in this order that need not stop sets the level for all after it
    level = F.min(F.when(F.col("level") >= F.col("water"), F.struct("level", "at", "water"))).over(whole)
    stops = level.isNull() | (F.col("level") < level["level"]) | ((F.col("level") == level["level"]) & (F.col("at") < level["at"]))
    target = F.when(stops, F.col("most")).otherwise(F.least(F.col("weight") * level["water"], F.col("most")))
    return ranked.select("source", "source_size", "n_docs", target.alias("target"))


class Dual:
    """The dual over a table of ``source, lang, size, n``; its multipliers by source and by language."""

    def __init__(self, cells: DataFrame, wanted: dict, cap: int, ridge: float):
        self.cells, self.cap = cells, cap
        self.free = [s for s, w in wanted.items() if 0 < w["target"] < cap * w["source_size"] * (1 - 1e-12)]
        self.target = np.array([wanted[s]["target"] for s in self.free])
        by_lang = {r["lang"]: r["words"] for r in cells.groupBy("lang").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()}
        self.langs = list(by_lang)
        self.total = float(sum(by_lang.values()))
        self.scale = self.total / max(1, sum(w["n_docs"] for w in wanted.values())) or 1.0
        full = sum(w["target"] for w in wanted.values())
        fixed = {r["lang"]: float(r["words"] or 0) for r in self._at(cells, [s for s, w in wanted.items() if s not in set(self.free) and w["target"] > 0]).groupBy("lang").agg(F.sum(F.col("size") * F.col("n") * cap).alias("words")).collect()}
        # what the free sources should hold of each language, beside what the others hold anyway
        self.moment = np.array([full * by_lang[x] / max(self.total, 1.0) - fixed.get(x, 0.0) for x in self.langs])
        self.ridge = ridge * self.total / self.scale

    @staticmethod
    def _at(cells: DataFrame, sources: list) -> DataFrame:
        names = cells.sparkSession.createDataFrame([(s,) for s in sources], cells.select(F.col("source").alias("of")).schema)
        return cells.join(names, F.col("source").eqNullSafe(F.col("of")), "left_semi")

    def multipliers(self, lam: np.ndarray, mu: np.ndarray) -> tuple[DataFrame, DataFrame]:
        """Two small tables, ``of, lam`` and ``in_lang, mu``: a row a free source, and a row a language."""
        spark = self.cells.sparkSession
        of = spark.createDataFrame(list(zip(self.free, lam.tolist(), strict=True)), f"of {self.cells.schema['source'].dataType.simpleString()}, lam double")
        return of, spark.createDataFrame(list(zip(self.langs, mu.tolist(), strict=True)), "in_lang string, mu double")

    def tilted(self, rows: DataFrame, lam: np.ndarray, mu: np.ndarray, how: str = "inner") -> DataFrame:
        """Adds ``tilt``, the exponent of each row's rate."""
        of, by_lang = self.multipliers(lam, mu)
        # the driver holds both tables anyway: a number a source, and one a language
        joined = rows.join(F.broadcast(of), F.col("source").eqNullSafe(F.col("of")), how).join(F.broadcast(by_lang), F.col("lang").eqNullSafe(F.col("in_lang")), how)
        return joined.withColumn("tilt", (F.col("lam") + F.col("mu")) * F.col("size") / self.scale).drop("of", "in_lang", "lam", "mu")

    def evaluate(self, lam: np.ndarray, mu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Value; expected words by (source, language) and their slopes; one pass over the table."""
        rows = self.tilted(self.cells, lam, mu)
        x, log_c = F.col("size") / self.scale, math.log(max(self.cap - 1, 1))
        z = F.col("tilt") - log_c
        value = self.cap * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))
        rate = rate_of(F.col("tilt"), self.cap)
        sums = rows.groupBy("source", "lang").agg(F.sum(value * F.col("n")).alias("v"), F.sum(rate * x * F.col("n")).alias("g"), F.sum(rate * (1 - rate / self.cap) * x * x * F.col("n")).alias("h")).collect()
        at_s, at_l = {s: i for i, s in enumerate(self.free)}, {x: i for i, x in enumerate(self.langs)}
        g, h, total = np.zeros((len(self.free), len(self.langs))), np.zeros((len(self.free), len(self.langs))), 0.0
        for r in sums:
            place = at_s[r["source"]], at_l[r["lang"]]
            g[place], h[place], total = r["g"], r["h"], total + r["v"]
        total += 0.5 * self.ridge * float(mu @ mu) - float(lam @ (self.target / self.scale)) - float(mu @ (self.moment / self.scale))
        return total, g, h, g.sum(axis=1) * self.scale

    def solve(self, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
        """Damped Newton; ends when every free source's expected words are its target within ``tolerance``."""
        lam, mu = np.zeros(len(self.free)), np.zeros(len(self.langs))
        if not self.free:
            return lam, mu
        value, g, h, words = self.evaluate(lam, mu)
        for _ in range(steps):
            down_s = g.sum(axis=1) - self.target / self.scale
            down_l = g.sum(axis=0) - self.moment / self.scale + self.ridge * mu
            if np.abs(words / self.target - 1).max() <= tolerance and np.abs(down_l).max() <= tolerance * self.total / self.scale:
                break
            diagonal = np.maximum(h.sum(axis=1), 1e-12)
            inner = np.diag(h.sum(axis=0) + self.ridge) - h.T @ (h / diagonal[:, None])
            step_l = -np.linalg.solve(inner, down_l - h.T @ (down_s / diagonal))
            step_s = -(down_s + h @ step_l) / diagonal
            slope, t = float(down_s @ step_s + down_l @ step_l), 1.0
            while True:
                found = self.evaluate(lam + t * step_s, mu + t * step_l)
                if found[0] <= value + 1e-4 * t * slope + 1e-12 * abs(value) or t < 1e-6:
                    break
                t /= 2
            lam, mu = lam + t * step_s, mu + t * step_l
            value, g, h, words = found
        # sums of floating point numbers depend on their order in the last digits; reruns agree
        return np.round(lam, DIGITS), np.round(mu, DIGITS)


def rate_of(tilt, cap: int):
    return cap / (1 + (cap - 1) * F.exp(-tilt))


def rates(sized: DataFrame, wanted: DataFrame, scratch: Scratch, cap: int = CAP, steps: int = STEPS, tolerance: float = TOLERANCE, ridge: float = RIDGE) -> DataFrame:
    """``sized`` with ``source_size, n_docs, target, rate``."""
    cells = scratch.save(sized.where("size > 0").groupBy("source", "lang", "size").agg(F.count("*").alias("n")), "cells")
    table = {r["source"]: r for r in wanted.collect()}  # a row a source
    dual = Dual(cells, table, cap, ridge)
    lam, mu = dual.solve(steps, tolerance)
    joined = sized.join(wanted.withColumnRenamed("source", "whose"), F.col("source").eqNullSafe(F.col("whose"))).drop("whose")
    tilted = dual.tilted(joined, lam, mu, "left")
    at_end = F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0)
    return tilted.withColumn("rate", F.when(F.col("tilt").isNull(), at_end).otherwise(rate_of(F.col("tilt"), cap))).drop("tilt")


def _round(frame: pd.DataFrame, cap: int) -> pd.DataFrame:
    frame = frame.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", ignore_index=True)
    size, rate = frame["size"].to_numpy(), frame["rate"].to_numpy()
    copies = np.zeros(len(frame), dtype=np.int64)
    owed = 0.0
    for i, (n, r) in enumerate(zip(size.tolist(), rate.tolist(), strict=True)):
        if n <= 0:
            break
        owed += r * n
        take = min(cap, max(0, math.floor(owed / n + 0.5)))
        copies[i] = take
        owed -= take * n
    return frame.assign(copies=copies)


def balance(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, bucket_rows: int = BUCKET_ROWS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, copies, rate``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = scratch.save(sizes(docs, id_col, text_col, source_col, lang_col), "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    joined = rates(sized, scratch.save(targets(by_source, weights, share, cap), "targets"), scratch, cap)
    joined = joined.withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, size), ceil(n_docs / {float(bucket_rows)}D))"))
    joined = joined.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make a float of a null long
    schema = StructType([*joined.schema.fields, StructField("copies", LongType())])
    rounded = joined.groupBy("source", "bucket").applyInPandas(lambda frame: _round(frame, cap), schema)
    return rounded.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: each row as often as it has copies, columns as given.

    The copies of rows that share id and source are added up and dealt over those rows, one more to
    the first in order of text.
    """
    id_col, text_col, source_col = (quoted(options.get(k, d)) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    of, at_source, copies, rows, at, copy = (unused(docs, f"mix_{c}") for c in ("id", "source", "copies", "rows", "at", "copy"))
    plan = balance(docs, **options)
    per_id = plan.groupBy(F.col("doc_id").alias(of), F.col("source").alias(at_source)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    per_id = Scratch(docs.sparkSession, "mixed").save(per_id.where(F.col(copies) > 0), "copies")
    if per_id.where(F.col(rows) > 1).isEmpty():
        numbered = docs.withColumn(at, F.lit(1))
    else:
        numbered = docs.withColumn(at, F.row_number().over(Window.partitionBy(id_col, source_col).orderBy(text_col)))
    found = numbered.join(per_id, F.col(id_col).eqNullSafe(F.col(of)) & F.col(source_col).eqNullSafe(F.col(at_source)))
    times = F.expr(f"cast(floor({copies} / {rows}) + if({at} <= {copies} % {rows}, 1, 0) as int)")
    return found.where(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*[quoted(c) for c in docs.columns])
