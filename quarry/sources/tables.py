"""File, blob and config tables in; findings out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkout import Checkouts
from .store import Store

#: Larger files are not scanned as text.
TEXT_BYTES = 2 << 20


def load_files(spark: SparkSession, root: str, most: int = TEXT_BYTES) -> DataFrame:
    """(project, path, tracked, mode, size, content) of a folder of checkouts (see checkout.Checkouts)."""
    spark.dataSource.register(Checkouts)
    return spark.read.format("checkouts").option("most", most).load(root)


def text_files(files: DataFrame, most: int = TEXT_BYTES) -> DataFrame:
    """Files up to the cap without a NUL in their first 8 KiB, with `text` for `content`."""
    head = F.substring("content", 1, 8192)
    own = files.where(F.col("size") <= most).where(~F.contains(head, F.lit(b"\0")))
    return own.withColumn("text", F.decode("content", "UTF-8")).drop("content")


def history_blobs(objects: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blobs (project, sha, path, size): the first path of each sha by seq, with the size."""
    first = objects.where(F.coalesce("path", F.lit("")) != "").groupBy("project", "sha").agg(F.min_by("path", "seq").alias("path"))
    return first.join(sizes.where("obj_type = 'blob'").select("project", "sha", "size"), ["project", "sha"])


def ancestor_dirs(files: DataFrame) -> DataFrame:
    """(project, path) of every file and every folder above one."""
    parts = F.split("path", "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return files.select("project", F.explode(each).alias("path")).distinct()


def skip_non_repo(projects: DataFrame, gate: str) -> DataFrame:
    return projects.where(~F.col("is_repo")).select("project", F.lit(gate).alias("gate_id"), F.lit("info").alias("severity"), F.lit(f"{gate} skipped (not a git repository)").alias("title"), F.lit(".git").alias("file_path"))


def write_findings(findings: DataFrame, path: str) -> int:
    """A new version of the findings table, whole; its number (see store.Store)."""
    return Store(findings.sparkSession, path, findings.schema).write(findings).number


def export_json(df: DataFrame, path: str) -> None:
    df.write.json(path)
