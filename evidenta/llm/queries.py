"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidenta.llm import dac, lines, mixing, packing, privacy, quality, secrets, simhash, vectors, warc
from evidenta.llm.common import documents


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.range_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op5_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op6_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.addressed(documents(spark, sf_dir))


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.scan(documents(spark, sf_dir))


def op9_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op10_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.balance(documents(spark, sf_dir))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op")}


#: What SQL can express of the operators' results at a bearable speed: equal payloads, and links of all pairs with their closure.
ORACLE = {
    "op1_arc_to_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
      f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p), t AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
      SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM t""",
    "op3_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT row_number() OVER () AS n, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
      fit AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
      links AS (SELECT a.n AS a, b.n AS b FROM fit a JOIN fit b ON a.label = b.label AND a.n <> b.n AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
      reach(n, m) AS (SELECT n, n FROM v UNION SELECT r.n, l.b FROM reach r JOIN links l ON l.a = r.m),
      least AS (SELECT r.n, min(w.vec_id) AS component_id FROM reach r JOIN v w ON w.n = r.m GROUP BY r.n), counts AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a)
      SELECT v.vec_id, coalesce(c.n_links, 0)::BIGINT AS n_links, l.component_id, coalesce(v.vec_id = l.component_id, true) AS kept FROM v JOIN least l USING (n) LEFT JOIN counts c USING (n)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
