"""Findings over runs: normalise, deduplicate, merge, retire, ignore.

A finding's key is (project, gate_id, file_path). `now` is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["project", "gate_id", "file_path"]
STATE = ["severity", "title", "tags", "status", "created_at", "updated_at"]


def finding_id() -> Column:
    return F.xxhash64(*KEY)


def normalise(findings: DataFrame, gates: DataFrame, overrides: DataFrame) -> DataFrame:
    """Severity: the project's override, else the gate's own, else the default; title and tags default too.

    gates: (gate_id, g_title, g_severity, g_tags); overrides: (project, gate_id, o_severity). Both are dimension tables.
    """
    out = findings.join(gates, "gate_id", "left").join(overrides, ["project", "gate_id"], "left")
    out = out.withColumn("severity", F.coalesce("o_severity", F.nullif(F.col("severity"), F.lit("")), "g_severity"))
    out = out.withColumn("title", F.coalesce(F.nullif(F.col("title"), F.lit("")), "g_title")).withColumn("tags", F.coalesce("tags", "g_tags"))
    return out.drop("o_severity", "g_title", "g_severity", "g_tags")


def dedupe_keys(emitted: DataFrame) -> DataFrame:
    """One row a key: the last emission's values, the first one's created_at. Two aggregates on the map side, no window."""
    values = [c for c in emitted.columns if c not in (*KEY, "created_at", "emit_seq")]
    last = F.max(F.struct("emit_seq", *values)).alias("last")
    out = emitted.groupBy(*KEY).agg(last, F.min_by("created_at", "emit_seq").alias("created_at"))
    return out.select(*KEY, *[F.col(f"last.{c}").alias(c) for c in values], "created_at", F.col("last.emit_seq").alias("emit_seq"))


def merge_findings(previous: DataFrame, current: DataFrame, now: int, scope: DataFrame | None = None) -> DataFrame:
    """previous, current: one row a key with severity, tags, status, created_at, updated_at (current: status is not read).

    New: open. Seen again: refreshed; ignored stays, resolved reopens; created_at is kept. Not
    seen: open becomes resolved at `now`; the rest stays. scope: (project, gate_id) or
    (project, file_path) pairs that this run judged; keys outside stay as they are.
    """
    p, c = previous.alias("p"), current.alias("c")
    on = None
    for k in KEY:
        own = F.col(f"p.{k}") == F.col(f"c.{k}")
        on = own if on is None else on & own
    both = p.join(c, on, "full_outer")
    seen, known = F.col("c.project").isNotNull(), F.col("p.project").isNotNull()
    fields = [x for x in previous.columns if x not in (*KEY, "status", "created_at", "updated_at")]
    out = both.select(
        *[F.coalesce(f"p.{k}", f"c.{k}").alias(k) for k in KEY],
        *[F.when(seen, F.col(f"c.{x}")).otherwise(F.col(f"p.{x}")).alias(x) for x in fields],
        F.when(seen & known & (F.col("p.status") == "ignored"), "ignored").when(seen, "open").when(F.col("p.status") == "open", "resolved").otherwise(F.col("p.status")).alias("status"),
        F.coalesce("p.created_at", "c.created_at").alias("created_at"),
        F.when(seen | (F.col("p.status") == "open"), F.lit(now).cast("long")).otherwise(F.col("p.updated_at")).alias("updated_at"),
    )
    if scope is None:
        return out
    keys = [c for c in scope.columns if c in KEY]
    inside = previous.join(scope.select(*keys).distinct(), keys, "left_semi")
    outside = previous.join(scope.select(*keys).distinct(), keys, "left_anti")
    return merge_findings(inside, current, now).select(*previous.columns).unionByName(outside)


def retire_ignored_gates(previous: DataFrame, ignored: DataFrame, now: int) -> DataFrame:
    """Open findings of gates that a project ignores become resolved. ignored: (project, gate_id)."""
    own = previous.join(F.broadcast(ignored.distinct().withColumn("_off", F.lit(True))) if _small(ignored) else ignored.distinct().withColumn("_off", F.lit(True)), ["project", "gate_id"], "left")
    hit = F.coalesce("_off", F.lit(False)) & (F.col("status") == "open")
    return own.withColumn("updated_at", F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at"))).withColumn("status", F.when(hit, "resolved").otherwise(F.col("status"))).select(*previous.columns)


def _small(df: DataFrame, most: int = 100_000) -> bool:
    return df.limit(most + 1).count() <= most


def ignore(findings: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    own = findings.join(keys.select(*KEY).distinct().withColumn("_hit", F.lit(True)), KEY, "left")
    hit = F.coalesce("_hit", F.lit(False))
    return own.withColumn("status", F.when(hit, "ignored").otherwise(F.col("status"))).withColumn("updated_at", F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at"))).select(*findings.columns)


def delete(findings: DataFrame, keys: DataFrame) -> DataFrame:
    return findings.join(keys, [c for c in keys.columns if c in KEY], "left_anti")


def newly_open(previous: DataFrame, current: DataFrame) -> DataFrame:
    return current.where("status = 'open'").join(previous.where("status = 'open'"), KEY, "left_anti").select(*KEY)


def last_per_key(emitted: DataFrame) -> DataFrame:
    """dedupe_keys by a window, for tables whose values cannot be compared."""
    w = W.partitionBy(*KEY).orderBy(F.col("emit_seq").desc())
    return emitted.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
