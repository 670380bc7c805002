"""Lists, counts and rankings of findings. tags: comma-joined text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def tag_array(tags: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), F.trim), lambda t: t != "")


SORTS = {
    "updated": ["updated_at desc"],
    "created": ["created_at desc"],
    "severity": ["severity_rank", "updated_at desc"],
    "gate": ["gate_id", "file_path"],
    "file": ["file_path", "gate_id"],
}


def severity_rank() -> Column:
    return F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)


def list_findings(findings: DataFrame, project=None, status="open", severity=None, gate=None, tag=None, search=None, sort="updated", limit=500, offset=0) -> DataFrame:
    """A filtered, sorted page. status "all" lifts the default; severity may be a list; limit <= 0 is 500."""
    out = findings
    for name, want in (("project", project), ("gate_id", gate)):
        if want is not None:
            out = out.where(F.col(name) == want)
    if status not in (None, "all"):
        out = out.where(F.col("status") == status)
    if severity is not None:
        out = out.where(F.col("severity").isin([severity] if isinstance(severity, str) else list(severity)))
    if tag is not None:
        out = out.where(F.exists(tag_array("tags"), lambda t: F.lower(t).like(tag.lower())))
    if search is not None:
        hit = F.lit(False)
        for c in ("title", "message", "file_path", "gate_id"):
            if c in findings.columns:
                hit = hit | F.lower(c).like(f"%{search.lower()}%")
        out = out.where(hit)
    order = [F.expr(x.split()[0]).desc() if x.endswith("desc") else F.expr(x) for x in SORTS.get(sort, SORTS["updated"])]
    out = out.withColumn("severity_rank", severity_rank()).orderBy(*order, F.col("id").desc())
    return out.offset(offset).limit(limit if limit > 0 else 500).drop("severity_rank")


def by_status(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return findings.groupBy(*by, "status").agg(F.count("*").alias("n"))


def by_severity(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of open findings with their rounded share of all open ones."""
    n = findings.where("status = 'open'").groupBy(*by, "severity").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(1)))).cast("long"))


def by_gate(findings: DataFrame, most: int = 50) -> DataFrame:
    top = findings.where("status = 'open'").groupBy("gate_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "gate_id").limit(most)
    return top.withColumn("bar", F.round(F.col("n") * 100.0 / F.greatest(F.lit(1), F.max("n").over(W.partitionBy(F.lit(1))))).cast("long"))


def top_files(findings: DataFrame, most: int = 10) -> DataFrame:
    stem = F.substring_index("file_path", ":", 1)
    own = findings.where("status = 'open' and file_path <> ''").groupBy(stem.alias("file")).agg(F.count("*").alias("n"))
    return own.orderBy(F.col("n").desc(), "file").limit(most)


def by_tag(findings: DataFrame) -> DataFrame:
    return findings.where("status = 'open'").select(F.explode(tag_array("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def trend(findings: DataFrame, now: int, days: int = 7) -> DataFrame:
    """(day, n) for each of the `days` UTC days up to now's; all statuses count."""
    today = now // DAY_MS
    own = findings.select(F.expr(f"created_at div {DAY_MS}").alias("day")).where(F.col("day").between(today - days + 1, today)).groupBy("day").agg(F.count("*").alias("n"))
    frame = findings.sparkSession.range(today - days + 1, today + 1).withColumnRenamed("id", "day")
    return frame.join(own, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def totals(findings: DataFrame) -> DataFrame:
    """Open counts of each severity for every project and, with a null project, for all."""
    open_ = lambda s: F.count_if((F.col("status") == "open") & (F.col("severity") == s))
    return findings.rollup("project").agg(*[open_(s).alias(f"n_{s}") for s in ("error", "warning", "info")], F.count("*").alias("total"))


def group_findings(findings: DataFrame, by: str) -> DataFrame:
    """(name, n, worst): groups by severity, gate, file, tag (exploded), status or none."""
    names = {"severity": F.array("severity"), "gate": F.array("gate_id"), "status": F.array("status"), "none": F.array(F.lit("all"))}
    names["file"] = F.array(F.when(F.col("file_path") == "", "(project-level)").otherwise(F.substring_index("file_path", ":", 1)))
    names["tag"] = F.when(F.size(tag_array("tags")) == 0, F.array(F.lit("(no tags)"))).otherwise(tag_array("tags"))
    return findings.select(F.explode(names[by]).alias("name"), severity_rank().alias("rank")).groupBy("name").agg(F.count("*").alias("n"), F.min("rank").alias("worst"))


def split_location(file_path: str = "file_path") -> tuple[Column, Column]:
    """(file, line); null for project-level and history locations, line 1 where none is given."""
    c = F.col(file_path)
    none = (c == "") | c.startswith("history:")
    line = F.get(F.split(c, ":"), F.lit(1)).try_cast("int")
    return F.when(~none, F.substring_index(c, ":", 1)), F.when(~none, F.greatest(F.coalesce(line, F.lit(1)), F.lit(1)))


def blame_enrich(findings: DataFrame, blame: DataFrame) -> DataFrame:
    file, line = split_location()
    own = findings.withColumn("_file", file).withColumn("_line", line)
    b = blame.select(F.col("project").alias("_p"), F.col("file").alias("_f"), F.col("line").alias("_l"), "hash", "author", "author_time")
    return own.join(b, (F.col("project") == F.col("_p")) & (F.col("_file") == F.col("_f")) & (F.col("_line") == F.col("_l")), "left").drop("_file", "_line", "_p", "_f", "_l")


def find_findings(findings: DataFrame, ids: list[int] | None = None, key: tuple[str, str, str] | None = None) -> DataFrame:
    """The findings with these ids, or the one with this (project, gate_id, file_path)."""
    out = findings if ids is None else findings.where(F.col("id").isin(ids))
    if key is None:
        return out
    return out.where((F.col("project") == key[0]) & (F.col("gate_id") == key[1]) & (F.col("file_path") == key[2]))
