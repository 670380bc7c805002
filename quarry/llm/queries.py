"""One query for each operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_template, line_templates, mixing, periodic, quality, secrets, simhash, subvectors, suffix_dedup, toxicity, url_rules
from .common import read


def _sha(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def _spans(mask: str) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with another one's last answer."""
    c = read(spark, sf_dir, "conversations")
    out = chat.format_preferences(c.withColumnRenamed("conv_id", "pair_id"), chat.swapped_endings(c))
    return out.select(
        "pair_id", "block", "n_prompt", "n_chosen", "n_rejected", *[_sha(F.col(n)).alias(f"{n}_sha256") for n in ("prompt", "chosen", "rejected")], *[_spans(n).alias(n) for n in ("chosen_mask", "rejected_mask")]
    )


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", _sha(F.col("text")).alias("text_sha256"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract_main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), spans=False)
    return out.select("doc_id", "n_words", "n_hit", "n_items", _sha(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), copies=False)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: the first scans every blob, the second asks the ledger on addresses and finds nothing new."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ledger, findings = secrets.scan_secrets(docs)
    ledger, findings = secrets.scan_secrets(docs, ledger, findings)
    out = secrets.with_findings(docs, ledger, findings)
    n = lambda kind: F.size(F.filter("findings", lambda f: f["rule"] == kind)).cast("long")
    joined = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(":", f["rule"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    base = F.filter("findings", lambda f: f["rank"] < len(secrets.BASE))
    return out.select("doc_id", *[n(k).alias(f"n_{k}") for k in secrets.BASE], _sha(joined(base)).alias("base_sha256"), joined(F.col("findings")).alias("spans"), "n_scanned")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_quality(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    none = F.lit(0).cast("long")
    n_bytes = F.coalesce(F.octet_length("text").cast("long"), none)
    return out.select("doc_id", n_bytes.alias("n_bytes"), F.coalesce(removed, none).alias("n_removed"), F.when(F.col("spans").isNull(), none).otherwise(F.size("spans").cast("long")).alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_subvectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subvectors.cluster_vectors(read(spark, sf_dir, "embeddings")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.find_runs(periodic.with_planted(read(spark, sf_dir, "documents").select("doc_id", "text")))
    best = periodic.strongest()
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")]), F.lit("\n"))))
    out = out.withColumn("best", best)
    exact = F.expr("1000 * best.length div best.period")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exact.alias("exponent_milli"), _sha(lines).alias("runs_sha256"), _sha(F.col("collapsed")).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_preferences, op2_line_templates, op3_main_text, op4_url_rules, op5_decontaminate, op6_toxicity, op7_simhash, op8_mixing, op9_secrets, op10_quality, op11_suffix_dedup, op12_subvectors, op13_periodic_runs)}
#: op3, op6 and op7 have no SQL form; tests hold them against brute force, planted pages and held-out labels.
SQL = {
    "op1_preferences": chat.SQL,
    "op2_line_templates": line_templates.SQL,
    "op4_url_rules": url_rules.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op8_mixing": mixing.SQL,
    "op9_secrets": secrets.SQL,
    "op10_quality": quality.SQL,
    "op11_suffix_dedup": suffix_dedup.SQL,
    "op12_subvectors": subvectors.SQL,
}
