"""A table of rows by project in versions, of which readers see whole ones only.

    <path>/data/w=<write>/bucket=<b>   rows of the projects in a bucket, as one write left them
    <path>/versions/v=<n>              (bucket, write, batch): what version n consists of

A version is one file, which appears at once, after all its data. A writer that ends before
that leaves the version before it as it was, and data that no version names. A write replaces
the buckets that it touches, so what it costs follows the change, not the table. One writer at
a time; any number of readers, each pinned to a version.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Projects are dealt to so many buckets; the number is fixed when a table is begun.
BUCKETS = 64


@dataclass(frozen=True)
class Version:
    number: int
    #: Of the last batch that was written, -1 for none.
    batch: int
    #: Bucket -> write.
    writes: dict[int, str]


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = spark.createDataFrame([], schema).schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("project"), F.lit(self.buckets)).cast("int")

    def version(self, number: int | None = None) -> Version:
        """The newest version, or one by number; number 0 is the empty table."""
        try:
            rows = self.spark.read.schema("bucket int, write string, batch long, v long").parquet(f"{self.path}/versions")
            newest = rows.agg(F.max("v")).first()[0] if number is None else number
            own = rows.where(F.col("v") == newest).collect() if newest else []  # a row for each bucket
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            own = []
        if not own:
            if number:
                raise ValueError(f"no version {number}")
            return Version(0, -1, {})
        return Version(own[0]["v"], own[0]["batch"], {r["bucket"]: r["write"] for r in own if r["bucket"] is not None})

    def read(self, version: Version | int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, the newest by default; buckets: only those in these."""
        own = version if isinstance(version, Version) else self.version(version)
        paths = [f"{self.path}/data/w={w}/bucket={b}" for b, w in sorted(own.writes.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> set[int]:
        """Buckets of the projects of some rows."""
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    def write(self, rows: DataFrame, buckets: set[int] | None = None, batch: int | None = None, before: Version | None = None) -> Version:
        """A new version in which these buckets, or all, hold these rows and no others. before: the version that it follows, the newest by default."""
        before = before or self.version()
        buckets = set(range(self.buckets)) if buckets is None else buckets
        name = uuid.uuid4().hex
        dealt = rows.select(*self.schema.names).withColumn("bucket", self.bucket()).where(F.col("bucket").isin(*buckets)) if buckets else rows.limit(0).withColumn("bucket", F.lit(0))
        dealt.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/w={name}")
        try:
            held = {r[0] for r in self.spark.read.parquet(f"{self.path}/data/w={name}").select("bucket").distinct().collect()}
        except AnalysisException as empty:
            if empty.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "UNRESOLVED_COLUMN.WITH_SUGGESTION", "UNRESOLVED_COLUMN.WITHOUT_SUGGESTION"):
                raise
            held = set()
        writes = {b: w for b, w in before.writes.items() if b not in buckets} | dict.fromkeys(held, name)
        new = Version(before.number + 1, before.batch if batch is None else batch, writes)
        self._switch(new)
        return new

    def _switch(self, new: Version) -> None:
        listed = [(b, w, new.batch) for b, w in sorted(new.writes.items())] or [(None, None, new.batch)]
        self.spark.createDataFrame(listed, "bucket int, write string, batch long").coalesce(1).write.parquet(f"{self.path}/versions/v={new.number}")


def upsert_batch(store: Store, batch: int, current: DataFrame, merge) -> Version:
    """Applies a batch once: merge(previous rows of the projects' buckets, current) gives the buckets' new rows. A batch
    that the table has seen is passed over."""
    before = store.version()
    if batch <= before.batch:
        return before
    buckets = store.touched(current)
    return store.write(merge(store.read(before, buckets), current), buckets, batch, before) if buckets else before
