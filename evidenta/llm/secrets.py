"""Secret scan with corpus-wide ownership frequency, by Spark functions alone.

Patterns give the base spans of a text: assignments to a secret-like name, access key ids, and long hex runs.
Beside them, what no base span covers is a candidate if it has the shape of a credential: a long token of mixed letters
and digits, a token with a dotted three-part form, or the password in a URL. The
value of each base span and candidate is hashed, and the hashes are counted over the whole corpus by distinct owners and
distinct repositories. Frequency decides: a value that several owners or many repositories hold is a widely ``copied`` example; any
other that looks random is ``live``, whoever holds it; the rest is ``plain``. The method adds live candidates as
spans of kind ``live``, gives every span its verdict in ``verdicts``, and counts both verdicts; base spans stay whatever the verdict.

Only candidate rows are shuffled, never texts; counts are pre-aggregated by value, owner and
repository, so a value that a third of all texts hold is one row an owner and task; the join that brings verdicts back is
one that adaptive execution can split by its occurrences.

Defined cases: a null text is empty; a null owner or repository counts as one of its own; a null
``doc_id`` is carried; repeated rows are scanned each; an empty table gives no row; other columns are ignored.
A text may have any length: matching is linear, by possessive repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidenta.llm.common import Scratch
from evidenta.llm.spans import found, listed, placed

KINDS = ["assign", "access", "hex"]
# Each matches as the plain pattern does; lookbehind and possessive repeats only avoid retries inside a run.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+|[A-Za-z0-9+/_=-]{16,}+)|(?<=://)[A-Za-z0-9._%+-]++:([^\x20\x09-\x0D/@:]{6,}+)(?=@)"
MAY_TOKEN = r"[A-Za-z0-9+/_=-]{16}|[A-Za-z0-9_-]{8}\.[A-Za-z0-9_-]{8}|://[A-Za-z0-9._%+-]++:"
COPIED_OWNERS = 3  # owners from which on a value is a widely copied example
COPIED_REPOS = 6  # and repositories
LEAST_KINDS, LEAST_TURNS = 7, 3  # different characters, and turns between letters and digits, of a value that looks random


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang") -> DataFrame:
    """One row per document: counts, ``base_sha256``, ``spans``, ``n_live``, ``n_copied``, ``n_candidates``, ``verdicts``.

    A repository is named by its owner and ``repo_col`` together.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    t = F.col("t")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00")).alias("owner"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("\x00")).alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
    )
    rows = rows.select(
        "doc_id", "owner", "repo",
        found(t, ASSIGN, t.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), 2).alias("f_assign"),
        found(t, ACCESS, t.contains("AKIA")).alias("f_access"),
        found(t, HEX, t.rlike("[0-9a-f]{32}")).alias("f_hex"),
        found(t, TOKEN, t.rlike(MAY_TOKEN)).alias("f_token"),
    )
    rows = rows.select("doc_id", "owner", "repo", *[placed(f"f_{k}").alias(f"all_{k}") for k in (*KINDS, "token")])
    rows = rows.select(
        "doc_id", "owner", "repo",
        F.expr("filter(all_assign, x -> length(x.v) >= 8)").alias("assign"), F.expr("filter(all_access, x -> length(x.m) >= 16)").alias("access"), F.col("all_hex").alias("hex"),
        F.expr("filter(all_token, x -> x.m rlike '[0-9]' and x.m rlike '[A-Za-z]')").alias("token"),
    )
    free = "filter(token, x -> not exists(assign, y -> y.s < x.e and x.s < y.e) and not exists(access, y -> y.s < x.e and x.s < y.e) and not exists(hex, y -> y.s < x.e and x.s < y.e))"
    rows = rows.select("doc_id", "owner", "repo", *KINDS, F.expr(f"if(size(token) > 0, {free}, token)").alias("token"))
    # rows without texts; the row number tells repeated rows apart
    held = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "found")
    marked = [f"transform({k}, x -> named_struct('k', '{k}', 's', x.s, 'e', x.e, 'v', {v}))" for k, v in (("assign", "x.v"), ("access", "x.m"), ("hex", "x.m"), ("token", "x.m"))]
    values = held.select("row", "owner", "repo", F.explode(F.expr(f"concat({', '.join(marked)})")).alias("x")).select(
        "row", "owner", "repo", "x.s", "x.e", "x.k", F.sha2("x.v", 256).alias("value"),
        (F.expr(f"size(array_distinct(split(x.v, ''))) >= {LEAST_KINDS}") & (F.regexp_count("x.v", F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]")) >= LEAST_TURNS)).alias("random"),
    )
    holders = values.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    # of one row a holder: owners by their repositories first, so that a hot value is pre-aggregated twice
    owned = holders.groupBy("value", "owner").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))
    verdict = F.when((F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repos") >= COPIED_REPOS), "copied").when(F.col("random"), "live").otherwise("plain")
    judged = values.join(owned, "value").select("row", "s", "e", "k", verdict.alias("verdict"))
    # a candidate that only looks long is none
    judged = judged.where("k != 'token' or verdict != 'plain'")
    order = F.when(F.col("k") == "token", len(KINDS)).otherwise(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("k")) - 1).cast("int")
    said = F.concat_ws(":", F.when(F.col("k") == "token", "candidate").otherwise(F.col("k")), "s", "e", "verdict")
    per_row = judged.groupBy("row").agg(
        F.count("*").alias("n_candidates"), F.sum(F.when(F.col("verdict") == "live", 1).otherwise(0)).alias("n_live"), F.sum(F.when(F.col("verdict") == "copied", 1).otherwise(0)).alias("n_copied"),
        F.collect_list(F.when((F.col("k") == "token") & (F.col("verdict") == "live"), F.struct("s", "e"))).alias("live"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", order.alias("o"), said.alias("said")))), lambda x: x["said"]), ",").alias("verdicts"),
    )
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    whole = held.join(per_row, "row", "left").withColumn("live", F.coalesce("live", none))
    base = listed(KINDS, F.col)
    return whole.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), listed([*KINDS, "live"], F.col).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_candidates", "n_live", "n_copied")], F.coalesce("verdicts", F.lit("")).alias("verdicts"),
    )
