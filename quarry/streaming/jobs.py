"""Streams of files and findings, with the same functions as batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import lifecycle as L
from ..operators.registry import run_gates
from ..operators.stats import DAY_MS
from ..sources.store import Store, upsert_batch


def stream_scan(files: DataFrame, gate) -> DataFrame:
    """New or changed files -> findings by a line-local gate, which keeps no state."""
    return gate(files)


FINDING = "project string, gate_id string, file_path string, severity string, tags string, status string, created_at long, updated_at long"


def stream_merge(emitted: DataFrame, store: str, now: int, checkpoint: str, start: DataFrame | None = None) -> StreamingQuery:
    """Each micro-batch is deduplicated and merged into a findings table (see Store), judged for its own (project, file_path) keys only.

    A batch reads and writes the buckets of its own projects, so its cost follows its projects,
    not the table; one that runs again after it was written does nothing. start: the findings
    before the first batch, if there are any.
    """
    fields = [*L.KEY, "severity", "tags", "status", "created_at", "updated_at"]

    def merge(batch: DataFrame, number: int) -> None:
        table = Store(batch.sparkSession, store, FINDING)
        if start is not None and table.version().number == 0:
            table.write(start.select(*fields))
        current = L.dedupe_keys(batch).select(*fields)
        upsert_batch(table, number, current, lambda old, new: L.merge_findings(old, new, now, new.select("project", "file_path")))

    return emitted.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Gates that judge a file by itself alone.
FILE_GATES = ("dockerfile_lint", "compose_lint", "html_lint", "css_lint", "config_parse_error", "merge_conflict_markers", "dead_placeholders", "connection_strings", "network_scan", "env_example_uncommented", "secrets_scan")


def stream_gates(files: DataFrame, store: str, now: int, checkpoint: str, gates: tuple[str, ...] = FILE_GATES) -> StreamingQuery:
    """Files (project, path, seq, text, ...) as they change -> a findings table in <store>/findings.

    A file's new version (the largest seq) is judged whole, and its findings take the place of
    those of the version before: what is gone is resolved. A null text is a file that was
    deleted. Versions that come late, behind a newer one, are passed over; what was seen of each
    file is kept in <store>/files.
    """

    def judge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table, seen = Store(spark, f"{store}/findings", FINDING + ", path string"), Store(spark, f"{store}/files", "project string, path string, seq long")
        newest = batch.groupBy("project", "path").agg(F.max_by(F.struct(*batch.columns), "seq").alias("f")).select("f.*")
        known = seen.read(buckets=seen.touched(newest)).select("project", "path", F.col("seq").alias("_seq"))
        # at the same seq a batch may be one that runs again
        fresh = newest.join(known, ["project", "path"], "left").where(F.col("_seq").isNull() | (F.col("seq") >= F.col("_seq"))).drop("_seq").persist()
        try:
            found = run_gates(fresh.where("text IS NOT NULL"), fresh.select("project").distinct(), now, gates)
            paths = fresh.select("project", "path")
            current = found.join(paths, "project").where(F.col("file_path").startswith(F.concat("path", F.lit(":"))) | (F.col("file_path") == F.col("path")))
            current = current.select(*[c.split()[0] for c in table.schema.names])

            def replaced(old: DataFrame, _: DataFrame) -> DataFrame:
                inside = old.join(paths, ["project", "path"], "left_semi")
                return L.merge_findings(inside, current, now).select(*old.columns).unionByName(old.join(paths, ["project", "path"], "left_anti"))

            upsert_batch(table, number, paths, replaced)
            upsert_batch(seen, number, fresh.select("project", "path", "seq"), lambda old, new: old.join(new, ["project", "path"], "left_anti").unionByName(new))
        finally:
            fresh.unpersist()

    return files.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_trend(emitted: DataFrame, late: str = "2 days") -> DataFrame:
    """Findings of each UTC day and gate; later than `late` is dropped."""
    timed = emitted.withColumn("at", F.timestamp_millis("created_at")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day").alias("w"), "gate_id").agg(F.count("*").alias("n")).select(F.expr(f"unix_millis(w.start) div {DAY_MS}").alias("day"), "gate_id", "n")


def stream_first_seen(emitted: DataFrame, late: str = "2 days") -> DataFrame:
    """The first emission of each key within the watermark."""
    timed = emitted.withColumn("at", F.timestamp_millis("created_at")).withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(L.KEY).drop("at")
