"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes the documents that the one before kept, as (spark, docs, sf_dir), and
returns a DataFrame; all but the last return the columns of documents. run() writes each
stage's result as Parquet in the cluster's shared folder and reads it again for the next.
Counts as part of the subpackage of training-data operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, line_templates, mixing, shingles, simhash, toxicity
from quarry.llm.common import checkpointed, read, row_key, shared_dir, small_batches, without


def _apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but the used ones renamed, so that none clashes with what an
    operator adds, and the columns that restore the names."""
    names = {c: c if c in used else f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[docs[c].alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labelled ones, rejects go."""
    own, restored = _apart(docs, "doc_id", "text")
    model = toxicity.train(own, read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(own, model).where("predicted = 0").select(*restored)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines stay in their first document only; n_chars follows the text. All documents
    stay, those without a line of their own with an empty text."""
    own, restored = _apart(docs, "doc_id", "text", "n_chars")
    out = line_templates.dedup_lines(own)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*restored)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; of rows that share
    that id, one does. A group whose rows have no id keeps one row too. Near copies are texts at
    most 3 bits of their fingerprints apart and, of those that stay, texts that have at least
    80 % of their 5-word shingles in common.
    """
    own, restored = _apart(docs, "doc_id", "text")
    small_batches(spark)
    own = own.withColumn("_row", row_key())
    # both from one pass over the texts
    marked = checkpointed(own.select("doc_id", "_row", simhash.fingerprint_of(F.col("text")).alias("fingerprint"), shingles.bands_of(F.col("text")).alias("bands")))
    group = simhash.linked(marked.drop("bands"), group="near_group")
    kept = checkpointed(group.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("near_group").agg(F.min("_row").alias("_row")).select("_row"))
    banded = checkpointed(marked.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select("_row", F.explode("bands").alias("key")))
    left = kept.join(shingles.near_copy_rows(own.select("doc_id", "text", "_row"), banded), "_row", "left_anti")
    return own.join(left, "_row", "left_semi").dropDuplicates(["_row"]).select(*restored)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    own, restored = _apart(docs, "doc_id", "text")
    out = decontaminate.decontaminate(own, read(spark, sf_dir, "benchmark"), spans=False)
    return out.where(~F.col("contaminated")).select(*restored)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, with size, shard and position in the shard, which
    replace input columns of these names."""
    added = ("size", "shard", "position")
    own, restored = _apart(without(docs, *added), "doc_id", "text", "source")
    return mixing.mix(own).select(*restored, *added)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]
#: The first and third stage can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, where = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
