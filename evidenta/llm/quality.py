"""Quality rules: a decision list learned by sequential covering.

Text statistics of labelled documents train an ordered list of rules, each a conjunction of
thresholds. A rule is grown on two thirds of the examples, adding the threshold with the best gain in
information until it covers no good document, then pruned on the other third by dropping final
conditions while that raises its worth there; what it covers is taken out, and the next rule is grown, until a
rule's precision on the pruning third falls below ``precision``. The list is emitted as one
ordered Spark ``CASE`` expression over the statistics; a document that no rule rejects is kept.

Statistics of every document are exact and cover its whole text. The list alone is fitted on a bounded sample:
the ``sample`` labelled documents whose ids have the smallest hashes.

Defined cases: a null text is empty; rows with a null id or label do not train; an id labelled
more than once counts with its lowest label; with under ``least`` examples of either label no rule is learned;
repeated rows are judged each; an empty table gives no row; other columns are ignored, whatever
their names. A text may have any length; what a worker holds of it is its words and their windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidenta.llm.common import quoted, unused

SAMPLE = 4000  # labelled documents that train the list; the rest is free for held-out measures
PRECISION, LEAST, MOST_RULES, MOST_CONDITIONS = 0.95, 20, 12, 4
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"]
WINDOW = 5


def statistics(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of a text."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    lines = text.split("\n")
    seen: set[str] = set()
    n_lines = dup = 0
    for line in lines:
        if line.strip(SPACES):
            n_lines += 1
            dup += line in seen
            seen.add(line)
    codes = np.frombuffer(data, dtype=np.uint8)
    upper = int(np.count_nonzero((codes >= 65) & (codes <= 90)))
    digits = int(np.count_nonzero((codes >= 48) & (codes <= 57)))
    return (
        n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup,
        repeated(words), n_lines, upper, digits, text.count("!") + text.count("?"),
    )


def repeated(words: list, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first included."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    at = np.array([often[w] > 1 for w in windows])
    covered = np.zeros(len(words), dtype=bool)
    for i in range(width):
        covered[i : i + len(at)] |= at
    return int(covered.sum())


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` (as strings) and ``COUNTS`` of each row."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([statistics(t) for t in batch["the_text"]], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pd.concat([batch[keep].reset_index(drop=True), pd.DataFrame(found, columns=COUNTS)], axis=1)

    schema = ", ".join([*(f"`{c}` string" for c in keep), *(f"{c} long" for c in COUNTS)])
    return docs.select(*[F.col(c).cast("string").alias(c) for c in keep], F.col(text_col).alias("the_text")).mapInPandas(measured, schema)


#: Statistics that rules use, each from counts alone, so that rules run in Spark as they do here.
RATES = {
    "n_words": ("n_words", None), "mean_word": ("word_chars", "n_words"), "symbol_rate": ("n_symbols", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"),
    "repeat_rate": ("n_repeat_words", "n_words"), "upper_rate": ("n_upper", "word_chars"), "digit_rate": ("n_digits", "word_chars"), "mark_rate": ("n_marks", "n_words"), "words_a_line": ("n_words", "n_lines"),
}


def rate_column(name: str, prefix: str = "") -> Column:
    over, under = RATES[name]
    count = F.col(prefix + over).cast("double")
    return count if under is None else F.when(F.col(prefix + under) > 0, count / F.col(prefix + under)).otherwise(0.0)


def rate_table(counts: pd.DataFrame) -> np.ndarray:
    out = []
    for over, under in RATES.values():
        x = counts[over].to_numpy(np.float64)
        out.append(x if under is None else np.divide(x, counts[under].to_numpy(np.float64), out=np.zeros_like(x), where=counts[under].to_numpy() > 0))
    return np.stack(out, axis=1)


@dataclass(frozen=True)
class Condition:
    """``statistic >= value``, or ``<`` if not ``above``."""

    statistic: str
    above: bool
    value: float

    def column(self, prefix: str = "") -> Column:
        x = rate_column(self.statistic, prefix)
        return x >= self.value if self.above else x < self.value

    def holds(self, table: np.ndarray) -> np.ndarray:
        x = table[:, list(RATES).index(self.statistic)]
        return x >= self.value if self.above else x < self.value


@dataclass(frozen=True)
class Rule:
    """Rejects what all its conditions hold for."""

    conditions: tuple[Condition, ...]

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(prefix)
        return out

    def holds(self, table: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([c.holds(table) for c in self.conditions])


def _best(table: np.ndarray, bad: np.ndarray, inside: np.ndarray) -> Condition | None:
    """The condition with the best information gain on the examples inside."""
    x, y = table[inside], bad[inside]
    p, n = int(y.sum()), int((~y).sum())
    if not p or not n:
        return None
    before = np.log2(p / (p + n))
    best, found = 1e-9, None
    for k, name in enumerate(RATES):
        order = np.argsort(x[:, k], kind="stable")
        v, good = x[order, k], y[order]
        cut = np.nonzero(np.diff(v) > 0)[0] + 1
        if not len(cut):
            continue
        below = np.concatenate([[0], np.cumsum(good)])[cut]
        for above in (True, False):
            hit = p - below if above else below
            all_ = len(v) - cut if above else cut
            gain = np.where(hit > 0, hit * (np.log2(np.maximum(hit, 1e-9) / all_) - before), 0)
            i = int(gain.argmax())
            if gain[i] > best:
                best, found = gain[i], Condition(name, above, float((v[cut[i] - 1] + v[cut[i]]) / 2))
    return found


def learn(table: np.ndarray, bad: np.ndarray, precision: float = PRECISION, least: int = LEAST) -> list[Rule]:
    """An ordered list of rejecting rules; deterministic in the order of examples."""
    if bad.sum() < least or (~bad).sum() < least:
        return []
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    prune = np.arange(len(bad)) % 3 == 2
    while len(rules) < MOST_RULES:
        inside, conditions = left & ~prune, []
        while len(conditions) < MOST_CONDITIONS and (bad & inside).any() and (~bad & inside).any():
            c = _best(table, bad, inside)
            if c is None:
                break
            conditions.append(c)
            inside = inside & c.holds(table)
        held = left & prune
        best, worth = None, -2.0
        for k in range(len(conditions), 0, -1):
            rule = Rule(tuple(conditions[:k]))
            hit = rule.holds(table) & held
            p, n = int((bad & hit).sum()), int((~bad & hit).sum())
            if p and (value := (p - n) / (p + n)) >= worth:  # of equals, the shorter
                best, worth = rule, value
        if best is None or (worth + 1) / 2 < precision:
            break
        covered = best.holds(table) & left
        if not (covered & bad).any() or (covered & ~bad).sum() > (1 - precision) * covered.sum():
            break
        rules.append(best)
        left &= ~covered
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", **options) -> list[Rule]:
    """Learn from at most ``sample`` labelled documents; that bound also bounds what is broadcast and gathered."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    )
    bodies = docs.select(F.col(quoted(id_col)).alias("body_id"), F.col(quoted(text_col)).alias("the_body"))
    some = bodies.join(F.broadcast(chosen), F.col("body_id") == F.col("label_id")).select("label_id", "quality", "the_body")
    measured = with_statistics(some, ["label_id", "quality"], "the_body")
    rows = measured.groupBy("label_id", "quality").agg(*[F.min(c).alias(c) for c in COUNTS]).toPandas()
    rows = rows.assign(at=rows["label_id"].astype("int64")).sort_values("at", ignore_index=True) if len(rows) else rows
    if not len(rows):
        return []
    return learn(rate_table(rows), (rows["quality"].astype("int64") == 0).to_numpy(), **options)


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The decision list: the number of the first rule that rejects, from 1; 0 if none does.

    ``prefix``: of the columns that hold the counts.
    """
    out = None
    for k, rule in enumerate(rules, 1):
        out = (F if out is None else out).when(rule.column(prefix), k)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed(prefix: str = "") -> Column:
    n, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 10) | (100 * again > 20 * n)


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``rule`` (the first that rejects, or 0) and ``kept``."""
    measured = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("the_body")), ["doc_id"], "the_body")
    judged = measured.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return judged.select(F.col("doc_id").cast("long").alias("doc_id"), *COUNTS, "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The documents that are kept; all columns as given, no shuffle."""
    kept = F.pandas_udf(lambda texts: pd.DataFrame([statistics(t) for t in texts], columns=COUNTS), ", ".join(f"{c} long" for c in COUNTS))
    held = unused(docs, "quality_counts")
    judged = docs.withColumn(held, kept(F.col(quoted(text_col))))
    return judged.where(~base_failed(f"{held}.") & (verdict(rules, f"{held}.") == 0)).select(*[quoted(c) for c in docs.columns])
