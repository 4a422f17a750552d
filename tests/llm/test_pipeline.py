from collections import Counter

import corpus_pipeline
import pytest
from evidenta.llm import quality
from evidenta.llm.common import documents
from tests.llm import brute
from tests.llm.test_operators import shares


def test_stages(spark, sf_dir):
    docs = documents(spark, sf_dir).persist()
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).persist()
        if name != "packing":
            assert out.columns == columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = out.collect()
    kept = {r["doc_id"] for r in seen["quality rules"]}
    judged = quality.judge(documents(spark, sf_dir), quality.fit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert kept == {r["doc_id"] for r in judged.collect() if r["kept"]}
    texts = {r["doc_id"]: r["text"] for r in seen["line dedup"]}
    assert texts == brute.line_dedup(sorted((r["doc_id"], r["text"]) for r in seen["quality rules"]))
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line dedup"])
    fps = {k: brute.simhash(v) for k, v in texts.items()}
    ids = sorted(fps)
    group = brute.classes(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[ids[i]] ^ fps[ids[j]]).bit_count() <= 3])
    least = {}
    for i, g in zip(ids, group):
        least.setdefault(g, i)
    assert {r["doc_id"] for r in seen["simhash near-dedup"]} == set(least.values())
    size, taken = Counter(), Counter()
    for r in seen["simhash near-dedup"]:
        size[r["source"]] += len(brute.words(r["text"]))
    copies = Counter(r["doc_id"] for r in seen["mixing"])
    assert max(copies.values()) <= 2
    for r in seen["mixing"]:
        taken[r["source"]] += len(brute.words(r["text"]))
    want = shares(dict(size))
    assert sum(taken.values()) == pytest.approx(sum(want.values()), rel=0.1)
    whole = Counter()
    for p in seen["packing"]:
        whole[(p["doc_id"], p["doc_tokens"])] += p["length"]
    assert whole == Counter({k: k[1] * copies[k[0]] for k in whole}) and {k[0] for k in whole} == set(copies)


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns)


def test_edges(spark, docs, sf_dir, tmp_path):
    """Nulls, empty and long texts, ties and repeated rows through all stages."""
    frame = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, frame, sf_dir)
        if name != "packing":
            assert out.columns == frame.columns
        frame = spark.createDataFrame(out.collect(), out.schema)
    assert {"doc_id", "sequence_id"} <= set(frame.columns) and frame.count() > 0
