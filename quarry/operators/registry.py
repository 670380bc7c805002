"""All gates by id, and runs over all of them or some: one table of findings, ready to be merged."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.shared import checkpointed
from . import config as C
from . import lifecycle as L
from . import lines as N
from . import markdown as D
from . import markup as M
from . import project_gates as G
from . import yaml_gates as Y

#: What a gate gets: files (project, path, tracked, mode, size, text), projects (project, is_repo),
#: blobs (project, sha, path, seq, size, text) or None, and options (project, gate_id, value) or None.
Inputs = dict[str, DataFrame | None]


def _place(*parts: str | Column) -> Column:
    return F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


def _rows(df: DataFrame, place: Column, severity: Column | None = None, rule: Column | None = None, title: Column | None = None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return df.select("project", place.alias("file_path"), text(severity).alias("severity"), text(rule).alias("rule"), text(title).alias("title"))


def _asked(options: DataFrame | None, gate: str, name: str) -> DataFrame | None:
    """(project) of those that set a boolean option of the gate."""
    return None if options is None else C.option(options, gate, name).where(name).select("project").distinct()


def _set(options: DataFrame | None, gate: str, name: str, alias: str | None = None) -> DataFrame | None:
    """(project, name) of the projects that set an option of the gate."""
    return None if options is None else C.option(options, gate, name).where(F.col(name).isNotNull()).withColumnRenamed(name, alias or name)


def _missing(gate: str) -> Callable[[Inputs], DataFrame]:
    return lambda x: _rows(G.missing_files(x["projects"], x["files"]).where(F.col("gate_id") == gate), F.lit(""))


def _overridden(found: DataFrame, gate: str) -> DataFrame:
    """Findings by line; one that an inline comment overrides says so in its place and title."""
    silenced = F.col("override_severity").isNotNull()
    place = _place("path", "line", F.when(silenced, F.concat(F.lit("override_"), "rule")).otherwise(F.col("rule")))
    title = F.when(silenced, F.concat(F.lit(f"Override accepted: {gate}/"), "rule"))
    return _rows(found, place, F.col("override_severity"), F.col("rule"), title)


def _hints(x: Inputs, gate: str) -> list[DataFrame]:
    """That a project has no such file, where it asks."""
    asked = _asked(x["options"], gate, "suggest_when_missing")
    if asked is None:
        return []
    hints = G.presence_hints(asked, x["files"]).where(F.col("gate_id") == gate)
    return [_rows(hints, F.col("file_path"), F.lit("info"))]


def _commented(gate: str, find: Callable[[DataFrame], DataFrame]) -> Callable[[Inputs], DataFrame]:
    return lambda x: _overridden(M.apply_overrides(find(x["files"]), M.overrides(_of_kind(x["files"], gate))), gate)


def _dockerfiles(x: Inputs) -> DataFrame:
    found = _overridden(M.dockerfile_findings(_of_kind(x["files"], "dockerfile_lint")), "dockerfile_lint")
    return reduce(DataFrame.unionByName, _hints(x, "dockerfile_lint"), found)


def _composes(x: Inputs) -> DataFrame:
    found = Y.compose_lint(x["files"], own_images=_set(x["options"], "compose_lint", "additional_orchestrator_images", "images"))
    return reduce(DataFrame.unionByName, _hints(x, "compose_lint"), _overridden(Y.compose_overridden(found, x["files"]), "compose_lint"))


def _protection(x: Inputs) -> DataFrame | None:
    asked = _asked(x["options"], "branch_protection_declared", "enabled")
    return None if asked is None else _rows(Y.branch_protection_missing(asked, x["files"]), F.lit(".github/settings.yml"))


def _history(gate: str, find: Callable[[DataFrame, Inputs], DataFrame]) -> Callable[[Inputs], DataFrame | None]:
    """A gate over history, for the projects that switch it on."""

    def run(x: Inputs) -> DataFrame | None:
        asked = _asked(x["options"], gate, "enabled")
        return None if x["blobs"] is None or asked is None else find(x["blobs"].join(asked, "project", "left_semi"), x)

    return run


def _secrets_history(blobs: DataFrame, x: Inputs) -> DataFrame:
    return _rows(N.secrets_history(blobs, own_most=_set(x["options"], "secrets_scan_history", "max_blobs")), F.col("file_path"), F.col("severity"))


def _large_blobs(blobs: DataFrame, x: Inputs) -> DataFrame:
    return _rows(G.large_blobs(blobs, thresholds=_set(x["options"], "large_blob_in_history", "threshold_mb")), F.col("file_path"))


#: Gate over lines -> what a finding's place ends with, and its rule.
_LINE_PLACES = {
    "merge_conflict_markers": (), "dead_placeholders": ("rule",), "connection_strings": ("rule",), "network_scan": ("text",), "env_example_uncommented": ("text",), "secrets_scan": ("rule",),
}


def _line_findings(x: Inputs, gates: list[str]) -> DataFrame:
    """(project, file_path, severity, rule, title, gate_id) of the gates over lines: one pass over the texts."""
    found = N.line_gates(x["files"], gates)
    if "merge_conflict_markers" in gates:
        found = N.first_of_path(found)
    if "secrets_scan" in gates and "tracked" in x["files"].columns:
        env = N.tracked_env(x["files"]).select("project", "path", F.lit("secrets_scan").alias("gate_id"), F.col("line_no").cast("int").alias("line_no"), F.col("pattern").alias("rule"))
        found = found.unionByName(env, allowMissingColumns=True)
    last = F.when(F.col("gate_id").isin(*[g for g, p in _LINE_PLACES.items() if p == ("text",)]), F.col("text")).otherwise(F.col("rule"))
    place = F.when(F.col("gate_id") == "merge_conflict_markers", _place("path", "line_no")).otherwise(_place("path", "line_no", last))
    return found.select("project", place.alias("file_path"), "severity", "rule", F.lit(None).cast("string").alias("title"), "gate_id")


def _by_line(gate: str) -> Callable[[Inputs], DataFrame]:
    return lambda x: _line_findings(x, [gate]).drop("gate_id")


#: Gate -> its findings (project, file_path, severity, rule, title); null severity and title are the gate's own. None if its input is absent.
REGISTRY: dict[str, Callable[[Inputs], DataFrame | None]] = {g: _missing(g) for g in G.PRESENCE} | {g: _by_line(g) for g in N.LINE_GATES} | {
    "codeowners_present": lambda x: _rows(G.codeowners_missing(x["projects"], x["files"]), F.lit("")),
    "nvmrc_missing": lambda x: _rows(G.nvmrc_missing(x["files"]), F.lit("package.json")),
    "tests_present": lambda x: _rows(G.tests_missing(x["projects"], x["files"]), F.lit(""), F.col("severity")),
    "gitignore_coverage": lambda x: _rows(G.gitignore_coverage(x["files"], own_disabled=_set(x["options"], "gitignore_coverage", "disabled_patterns", "off")), F.concat(F.lit(".gitignore:"), "pattern")),
    "large_file_tracked": lambda x: _rows(G.large_files(x["files"], thresholds=_set(x["options"], "large_file_tracked", "threshold_mb")), F.col("path")),
    "unexpected_executable_bit": lambda x: _rows(G.executable_bits(x["files"]), F.col("path")),
    "vendored_dir_tracked": lambda x: _rows(G.vendored_dirs(x["files"]), F.col("key")),
    "ide_artifact_tracked": lambda x: _rows(G.ide_artifacts(x["files"]), F.col("path")),
    "filename_quality": lambda x: _rows(G.odd_names(x["files"]), F.col("path")),
    "version_drift": lambda x: _rows(G.version_drift(x["files"]), F.col("path")),
    "config_parse_error": lambda x: _rows(config_parse_errors(x["files"]), F.col("path")),
    "secrets_scan_history": _history("secrets_scan_history", _secrets_history),
    "large_blob_in_history": _history("large_blob_in_history", _large_blobs),
    "dockerfile_lint": _dockerfiles,
    "compose_lint": _composes,
    "html_lint": _commented("html_lint", lambda f: M.html_lint(_of_kind(f, "html_lint"))),
    "css_lint": _commented("css_lint", lambda f: M.css_lint(_of_kind(f, "css_lint"))),
    "markdown_lint": _commented("markdown_lint", lambda f: D.markdown_lint(_of_kind(f, "markdown_lint"), OPT_IN, G.existing(f))),
    "branch_protection_declared": _protection,
}
#: Rules that a project must switch on.
OPT_IN = ("codeblock_no_language",)
#: Gates that read the list of tracked files: a project without a repository gets one row that they were skipped.
OF_REPOSITORY = (
    "secrets_scan", "config_parse_error", "merge_conflict_markers", "large_file_tracked", "network_scan", "connection_strings", "dockerfile_lint", "compose_lint", "unexpected_executable_bit",
    "vendored_dir_tracked", "ide_artifact_tracked", "filename_quality", "html_lint", "css_lint", "markdown_lint", "dead_placeholders", "secrets_scan_history", "large_blob_in_history",
)
_HISTORY = ("secrets_scan_history", "large_blob_in_history")
#: Gates whose findings are computed in one job.
LOT = 5


def _of_kind(files: DataFrame, gate: str) -> DataFrame:
    return files.where((G.P.file_kind() == gate.removesuffix("_lint")) & ~G.P.should_skip_content(scan=N.own_options(files, gate)))


def config_parse_errors(files: DataFrame, most: int = 5 << 20) -> DataFrame:
    """(project, path) of JSON and YAML files of 1 byte to the cap that don't parse."""
    return N.json_parse_errors(files, most).unionByName(Y.yaml_parse_errors(files, most))


def catalogue(spark: SparkSession) -> DataFrame:
    """(gate_id, title, severity, tags) of all gates."""
    rows = [(g, t, s, ",".join(tags)) for g, t, s, tags in R.GATES]
    return spark.createDataFrame(rows, "gate_id string, title string, severity string, tags string")


def _skipped(x: Inputs, gates: list[str]) -> DataFrame:
    """A row for each gate that a project without a repository is skipped by; opt-in ones where they are switched on."""
    without = x["projects"].where(~F.col("is_repo")).select("project").distinct()
    asked = [without.withColumn("gate_id", F.explode(F.lit([g for g in gates if g not in _HISTORY] or [""]))).where("gate_id <> ''")]
    for g in (g for g in gates if g in _HISTORY and x["options"] is not None):
        asked.append(without.join(_asked(x["options"], g, "enabled"), "project", "left_semi").withColumn("gate_id", F.lit(g)))
    out = reduce(DataFrame.unionByName, asked)
    return out.select("project", F.lit(".git").alias("file_path"), F.lit("info").alias("severity"), F.lit("").alias("rule"), F.concat("gate_id", F.lit(" skipped (not a git repository)")).alias("title"), "gate_id")


def _kept(found: list[DataFrame]) -> DataFrame:
    """All these findings, computed in lots: one plan over all gates takes the driver minutes, whatever the tables' size."""
    lots = [reduce(DataFrame.unionByName, found[at : at + LOT]) for at in range(0, len(found), LOT)]
    return reduce(DataFrame.unionByName, [checkpointed(lot) for lot in lots]) if len(lots) > 1 else lots[0]


def run_gates(files: DataFrame, projects: DataFrame, now: int, gates: Iterable[str] | None = None, blobs: DataFrame | None = None, configs: DataFrame | None = None) -> DataFrame:
    """Findings (id, project, gate_id, file_path, severity, title, tags, status, created_at, updated_at), one row a key.

    gates: the ids to run, all by default; an unknown one raises. configs (see load_configs)
    switch gates and rules off and set severities and options. Path filters and excludes hold before a
    text is read; options of the wrong form leave a gate on its defaults. Gates over lines share
    one pass. Gates of the history need blobs and, like other opt-in gates, an option that
    switches them on. projects may have is_repo: one that is no repository has no findings of the
    gates that read one, but a row that they were skipped.
    """
    wanted = list(REGISTRY) if gates is None else list(dict.fromkeys(gates))
    unknown = [g for g in wanted if g not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown gates: {', '.join(unknown)}")
    spark = files.sparkSession
    # tables with a row a project that the plan of every gate holds: computed once, so that plans stay small
    projects = checkpointed(projects)
    configs = None if configs is None else checkpointed(configs)
    options = None if configs is None else checkpointed(C.effective_options(configs, C.validate_gate_options(configs, C.options_of_gates(spark, list(REGISTRY)))))
    if options is not None:
        files = C.with_options(files, options)
        blobs = None if blobs is None else C.with_options(blobs, options)
    inputs: Inputs = {"files": files, "projects": projects, "blobs": blobs, "options": options}
    by_line = [g for g in wanted if g in N.LINE_GATES]
    parts = [(g, REGISTRY[g](inputs)) for g in wanted if g not in G.PRESENCE and g not in by_line]
    found = [df.withColumn("gate_id", F.lit(g)) for g, df in parts if df is not None]
    if by_line:
        found.append(_line_findings(inputs, by_line))
    present = [g for g in wanted if g in G.PRESENCE]
    if present:  # one pass for all of them
        absent = G.missing_files(projects, files).where(F.col("gate_id").isin(present)).withColumn("place", F.lit(""))
        none = "CAST(NULL AS STRING)"
        found.append(absent.selectExpr("project", "place AS file_path", f"{none} AS severity", f"{none} AS rule", f"{none} AS title", "gate_id"))
    if not found:
        found = [spark.createDataFrame([], "project string, file_path string, severity string, rule string, title string, gate_id string")]
    out = _kept(found)
    if configs is not None:
        out = C.switch_rules(out.withColumn("rule", F.coalesce("rule", F.lit(""))), options, OPT_IN)
    else:
        out = out.where(F.col("rule").isNull() | ~F.col("rule").isin(*OPT_IN))
    skipping = [g for g in wanted if g in OF_REPOSITORY]
    if skipping and "is_repo" in projects.columns:
        bare = projects.where(~F.col("is_repo")).select("project", F.lit(True).alias("_bare")).distinct()
        out = out.join(bare, "project", "left").where(F.col("_bare").isNull() | ~F.col("gate_id").isin(*skipping)).drop("_bare")
        out = out.unionByName(_skipped(inputs, skipping))
    if configs is not None:
        out = C.apply_configs(out, configs)
    info = F.broadcast(catalogue(spark).selectExpr("gate_id", "title AS g_title", "severity AS g_severity", "tags"))  # a row for each gate
    out = out.join(info, "gate_id").withColumns({"severity": F.coalesce("severity", "g_severity"), "title": F.coalesce("title", "g_title")})
    stamp = F.lit(now).cast("long")
    # several findings at one place are one: the gravest
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    out = out.groupBy(*L.KEY).agg(F.min(F.struct(rank.alias("rank"), "severity", "title", "tags")).alias("f"))
    return out.select(L.finding_id().alias("id"), *L.KEY, "f.severity", "f.title", "f.tags", F.lit("open").alias("status"), stamp.alias("created_at"), stamp.alias("updated_at"))
