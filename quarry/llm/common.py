"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import checkpointed, shared_dir  # noqa: F401

#: Words of the contracts: runs of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER_TABLE = bytes(range(65)) + LOWER.encode() + bytes(range(91, 256))
#: The white space of bytes.split() is exactly \x20 and \x09-\x0D.
#: Bytes of a batch that goes to a Python worker, and back.
BATCH_BYTES = 4 << 20


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in taken]
    return df.drop(*clash) if clash else df


def row_key() -> Column:
    """128 bits that stand for doc_id and text, nulls told apart from empty values; rows that repeat both share them."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    nulls = F.concat(F.col("doc_id").isNull().cast("string"), F.col("text").isNull().cast("string"), F.octet_length(own).cast("string"), F.lit(" "))
    return F.unhex(F.md5(F.concat(nulls, own, F.coalesce("text", F.lit(""))).cast("binary")))


def small_batches(spark: SparkSession) -> None:
    """From now on texts go to Python workers in batches of BATCH_BYTES, or what the session has set below that."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def text_bytes(array, rows: int = 200):
    """UTF-8 bytes (None for null) of an Arrow string column, a few rows at a time so that a
    worker holds little beside the column itself."""
    import pyarrow as pa

    for at in range(0, len(array), rows):
        yield from array.slice(at, rows).cast(pa.binary()).to_pylist()
    pa.default_memory_pool().release_unused()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
