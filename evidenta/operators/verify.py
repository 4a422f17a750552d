"""Verification of records against manifests, with nothing of the writer trusted, and what it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidenta.operators import chain
from evidenta.schema import DIMENSIONS

#: Findings that a pack has without any signature or attestation: each says what was not checked.
UNCHECKED = [("weak", "root-signature", "the root is not signed"), ("weak", "witnesses", "no witness or timestamp places the root in time")]


def findings(sealed: DataFrame, manifests: DataFrame, store_root: str | None = None, bits: int = 384) -> DataFrame:
    """``level (note | weak | broken), check, detail``; no ``broken`` row means it verifies."""
    spark = sealed.sparkSession
    place = ["shard", "segment_id"]
    parts: list[DataFrame] = []

    def broken(frame: DataFrame, check: str, detail) -> None:
        parts.append(frame.select(F.lit("broken").alias("level"), F.lit(check).alias("check"), detail.cast("string").alias("detail")))

    where = F.concat_ws("/", "shard", "segment_id")
    made = chain.manifests(sealed, bits)
    names = ["n_records", "min_recorded_at", "max_recorded_at", "chain_before", "chain_after", "history_root", *[f"root_{d}" for d in DIMENSIONS], "manifest_root"]
    both = manifests.select(*place, *[F.col(c).alias(f"said_{c}") for c in names]).join(made, place, "full")
    said = both.where("said_n_records is not null and n_records is not null")
    broken(both.where("n_records is null"), "records-present", where)
    broken(both.where("said_n_records is null"), "orphan-records", where)
    checks = {"record-count": ["n_records"], "time-span": ["min_recorded_at", "max_recorded_at"], "history-root": ["history_root"], "index-root": [f"root_{d}" for d in DIMENSIONS], "manifest-root": ["manifest_root"]}
    for check, columns in checks.items():
        differs = F.lit(False)
        for c in columns:
            differs = differs | ~F.col(f"said_{c}").eqNullSafe(F.col(c))
        broken(said.where(differs), check, where)
    broken(made.where("seal_error is not null"), "sequence-contiguous", F.concat_ws(" ", where, "seal_error"))
    by_shard = Window.partitionBy("shard").orderBy("segment_id")
    numbered = manifests.select(*place, "chain_before", F.row_number().over(by_shard).alias("expected"), F.lag("chain_after").over(by_shard).alias("last"))
    broken(numbered.where("segment_id != expected"), "segment-numbering", where)
    broken(numbered.where("last is not null and chain_before != last"), "chain-across-segments", where)
    start = F.sha2(F.concat_ws("|", F.lit(chain.GENESIS), F.col("shard").cast("string")), bits)
    broken(numbered.where("last is null").where(F.col("chain_before") != start), "first-segment-start", where)
    broken(chain.verify_chain(sealed, bits).groupBy(*place).agg(F.min("seq").alias("seq")), "chain-within-segment", F.concat_ws("/", "shard", "segment_id", "seq"))
    broken(chain.duplicates(chain.index_entries(sealed, bits=bits)).select(*place).distinct(), "index-strictly-sorted", where)
    tail = list(UNCHECKED)
    if store_root is not None:
        rows = manifests.select("shard", "segment_id", "manifest_root").collect()  # a row a segment
        if (not rows and store_root) or (rows and chain.store_root(rows, bits) != store_root):
            tail.append(("broken", "store-root", "the store root does not follow from the manifests"))
    whole = spark.createDataFrame(tail, "level string, check string, detail string")
    for p in parts:
        whole = whole.unionByName(p)
    return whole


#: Published texts on records of automated decisions, and which of our checks bear on each. A text without
#: checks is one that no record store answers: ``operator`` where an organisation's own process does, else ``not addressed``.
TEXTS = {
    ("EU AI Act", "Article 12(1)"): ("record-count", "records-present"),
    ("EU AI Act", "Article 12(2)"): ("records-present", "chain-within-segment", "chain-across-segments"),
    ("EU AI Act", "Article 12(3)"): (),
    ("EU AI Act", "Article 19(1)"): "operator",
    ("EU AI Act", "Article 26(6)"): "operator",
    ("SR 11-7", "Documentation"): ("record-count", "manifest-root"),
    ("SR 11-7", "Ongoing monitoring"): ("index-root", "index-strictly-sorted"),
    ("SR 11-7", "Change control"): ("chain-within-segment", "chain-across-segments", "first-segment-start"),
    ("SR 11-7", "Model inventory"): (),
    ("SOC 2", "CC7.2"): ("records-present", "orphan-records", "time-span"),
    ("SOC 2", "Audit trail integrity"): ("manifest-root", "history-root", "root-signature", "witnesses"),
    ("SOC 2", "CC6"): "operator",
}


def coverage(found: DataFrame, n_records: int) -> DataFrame:
    """``framework, reference, coverage, failing`` of each text: a join of the checks it rests on with the findings.

    ``shown``: all its checks ran over records and none was found broken or weak; ``not in this pack``: some was, or there are
    no records; ``failing`` names those checks, comma-joined.
    """
    spark = found.sparkSession
    texts = spark.createDataFrame([(f, r, c if isinstance(c, str) else "checked" if c else "not addressed") for (f, r), c in TEXTS.items()], "framework string, reference string, answer string")
    needs = spark.createDataFrame([(f, r, c) for (f, r), checks in TEXTS.items() if not isinstance(checks, str) for c in checks], "framework string, reference string, check string")
    bad = found.where("level in ('broken', 'weak')").select("check").distinct()
    failing = needs.join(bad, "check").groupBy("framework", "reference").agg(F.array_join(F.array_sort(F.collect_set("check")), ",").alias("failing"))
    label = F.when(F.col("answer") != "checked", F.col("answer")).when(F.col("failing").isNull() & F.lit(n_records > 0), "shown").otherwise("not in this pack")
    return texts.join(failing, ["framework", "reference"], "left").select("framework", "reference", label.alias("coverage"), F.when(label == "not in this pack", F.coalesce("failing", F.lit("records-present"))).alias("failing"))
