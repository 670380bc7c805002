"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the cluster's shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Only a session in one process, as in tests, may do without
    and gets a temporary one; on a cluster a local folder would lose data."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="spark-quarry-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where
