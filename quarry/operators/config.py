"""Project configs: read from a table of files, checked, and applied to findings.

A config is a JSON object with `ignore` (gates switched off), `severity` (by gate),
`gate_options` (an object by gate) and `exclude_paths` (patterns for every gate). Values
stay variants, so that all checks run in the JVM. Names of fields are case-sensitive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.shared import checkpointed

CONFIG = ".quarry.json"
FIELDS = ("ignore", "severity", "gate_options", "exclude_paths")
SEVERITIES = ("error", "warning", "info")
#: What an option may be, by its kind, as the schema of its value. A null value is any option's default.
KINDS = {"int": r"BIGINT", "number": r"BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\)", "bool": "BOOLEAN", "string": "STRING", "strings": "ARRAY<(?:STRING|VOID)>"}
_OPTIONS = "map<string,variant>"
#: Options of every gate over files, by kind.
SCAN = {"exclude_paths": "strings"} | dict.fromkeys(P.SWITCHES, "bool")
_RULED = SCAN | {"disabled_rules": "strings"}
_HINTED = _RULED | {"suggest_when_missing": "bool"}
#: Gate -> kinds of its options by name; a gate that isn't named takes none.
GATE_OPTIONS = dict.fromkeys(
    ("secrets_scan", "config_parse_error", "merge_conflict_markers", "connection_strings", "unexpected_executable_bit", "vendored_dir_tracked", "ide_artifact_tracked", "filename_quality"), SCAN
) | {
    "large_file_tracked": SCAN | {"threshold_mb": "int"},
    "network_scan": SCAN | {"report_loopback": "bool", "report_unspecified": "bool"},
    "dockerfile_lint": _HINTED,
    "compose_lint": _HINTED | {"additional_orchestrator_images": "strings"},
    "html_lint": _RULED,
    "css_lint": _RULED,
    "markdown_lint": _RULED | {"enabled_rules": "strings"},
    "gitignore_coverage": SCAN | {"disabled_patterns": "strings"},
    "dead_placeholders": SCAN | {"disabled_patterns": "strings"},
    "secrets_scan_history": SCAN | {"enabled": "bool", "max_blobs": "int"},
    "large_blob_in_history": SCAN | {"enabled": "bool", "threshold_mb": "int"},
    "branch_protection_declared": {"enabled": "bool"},
}
_TYPES = {"int": "long", "bool": "boolean", "strings": "array<string>"}
#: A table of options of up to so many bytes is copied to all executors.
BROADCAST = 16 << 20


def _is(value: Column, pattern: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(rf"^(?:{pattern}|VOID)\z"), F.lit(True))


def load_configs(files: DataFrame, name: str = CONFIG) -> DataFrame:
    """(project, problem, ignore, severity, gate_options, exclude_paths) of the config files (project, path, text).

    A config that doesn't parse, has an unknown field, a field of the wrong kind or an unknown
    severity is rejected whole: `problem` says why, and it sets nothing. A project without the
    file has no row. Of a null or empty text, `problem` is "parse".
    """
    v = F.try_parse_json("text")
    own = files.where(F.col("path") == name).select("project", v.alias("v")).withColumn("shape", F.schema_of_variant("v"))
    own = own.withColumn("fields", F.when(F.col("shape").startswith("OBJECT<"), F.try_variant_get("v", "$", _OPTIONS)))
    lists = [F.element_at("fields", n) for n in ("ignore", "exclude_paths")]
    maps = [F.element_at("fields", n) for n in ("severity", "gate_options")]
    severity = F.try_variant_get("v", "$.severity", "map<string,string>")
    unknown = F.array_sort(F.array_except(F.map_keys("fields"), F.array(*[F.lit(f) for f in FIELDS])))
    bad = F.exists(F.map_values(severity), lambda s: F.coalesce(~s.isin(*SEVERITIES), F.lit(True)))
    problem = (
        F.when(F.col("v").isNull(), "parse")
        .when(F.col("shape") == "VOID", None)
        .when(F.col("fields").isNull(), "not an object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.get(unknown, F.lit(0))))
        .when(~(_is(lists[0], KINDS["strings"]) & _is(lists[1], KINDS["strings"]) & _is(maps[0], "OBJECT<.*>") & _is(maps[1], "OBJECT<.*>")), "wrong kind")
        .when(F.coalesce(bad, F.lit(False)), "unknown severity")
    )
    own = own.withColumn("problem", problem)
    kept = lambda path, kind: F.when(F.col("problem").isNull(), F.try_variant_get("v", path, kind))
    strings = "array<string>"
    return own.select(
        "project", "problem", kept("$.ignore", strings).alias("ignore"), kept("$.severity", "map<string,string>").alias("severity"),
        kept("$.gate_options", _OPTIONS).alias("gate_options"), kept("$.exclude_paths", strings).alias("exclude_paths"),
    )


def _options(configs: DataFrame) -> DataFrame:
    """(project, gate_id, value): a row for each gate that a config has options for."""
    return configs.where(F.col("gate_options").isNotNull()).select("project", F.explode("gate_options").alias("gate_id", "value"))


def validate_gate_options(configs: DataFrame, gates: DataFrame) -> DataFrame:
    """(project, gate_id, problem, rejected) of options that are wrong.

    gates: (gate_id, options: kind by name of option; null for a gate that takes none).
    Options of unknown gates, or of gates without any, do nothing; other wrong options are
    rejected, which leaves their gate on its defaults.
    """
    known = gates.select("gate_id", "options", F.lit(True).alias("known"))
    own = _options(configs).join(known, "gate_id", "left").withColumn("shape", F.schema_of_variant("value"))
    own = own.withColumn("given", F.when(F.col("shape").startswith("OBJECT<"), F.try_variant_get("value", "$", _OPTIONS)))
    unknown = F.array_sort(F.array_except(F.map_keys("given"), F.map_keys("options")))
    fits = lambda name, value: F.coalesce(*[F.when(F.element_at("options", name) == k, _is(value, p)) for k, p in KINDS.items()], F.lit(True))
    wrong = F.array_sort(F.map_keys(F.map_filter("given", lambda name, value: ~fits(name, value))))
    problem = (
        F.when(F.col("known").isNull(), "no such gate")
        .when(F.col("options").isNull(), "takes no options")
        .when(F.coalesce(F.col("shape"), F.lit("VOID")) == "VOID", "null")
        .when(F.col("given").isNull(), "not an object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown option "), F.get(unknown, F.lit(0))))
        .when(F.size(wrong) > 0, F.concat(F.lit("wrong kind of "), F.get(wrong, F.lit(0))))
    )
    rejected = F.col("known").isNotNull() & F.col("options").isNotNull()
    return own.select("project", "gate_id", problem.alias("problem"), rejected.alias("rejected")).where(F.col("problem").isNotNull())


def effective_options(configs: DataFrame, problems: DataFrame) -> DataFrame:
    """(project, gate_id, value, exclude_paths): options in force, the config's own excludes first.

    Rejected options have a null value and keep the config's excludes. The row without a
    gate_id has the excludes of all gates that the config names no options for.
    """
    bad = problems.where("rejected").select("project", "gate_id", F.lit(True).alias("bad"))
    named = _options(configs).join(bad, ["project", "gate_id"], "left").select("project", "gate_id", F.when(F.col("bad").isNull(), F.col("value")).alias("value"))
    every = configs.where("problem IS NULL").select("project", F.coalesce("exclude_paths", F.array().cast("array<string>")).alias("shared"))
    own = F.coalesce(F.try_variant_get("value", "$.exclude_paths", "array<string>"), F.array().cast("array<string>"))
    named = named.join(every, "project").select("project", "gate_id", "value", F.concat("shared", own).alias("exclude_paths"))
    rest = every.where(F.size("shared") > 0).select("project", F.lit(None).cast("string").alias("gate_id"), F.parse_json(F.lit(None).cast("string")).alias("value"), F.col("shared").alias("exclude_paths"))
    return named.unionByName(rest)


def switch_rules(findings: DataFrame, options: DataFrame, opt_in: tuple[str, ...] = ()) -> DataFrame:
    """findings (project, gate_id, rule, ...) less those of rules that the project switched off, and
    of opt-in rules that it didn't switch on. A rule that is both is off.
    """
    strings = lambda name: F.try_variant_get("value", f"$.{name}", "array<string>").alias(f"_{name}")
    o = options.where(F.col("gate_id").isNotNull()).select("project", "gate_id", strings("disabled_rules"), strings("enabled_rules"))
    off = F.coalesce(F.array_contains("_disabled_rules", F.col("rule")), F.lit(False))
    on = F.coalesce(F.array_contains("_enabled_rules", F.col("rule")), F.lit(False))
    out = findings.join(o, ["project", "gate_id"], "left").where(~off & (~F.col("rule").isin(*opt_in) | on if opt_in else F.lit(True)))
    return out.select(*findings.columns)


def apply_configs(findings: DataFrame, configs: DataFrame) -> DataFrame:
    """findings (project, gate_id, severity, ...) less those of ignored gates, with the config's severities."""
    c = configs.where("problem IS NULL").select("project", F.col("ignore").alias("_ignore"), F.col("severity").alias("_severity"))
    out = findings.join(c, "project", "left").where(~F.coalesce(F.array_contains("_ignore", F.col("gate_id")), F.lit(False)))
    severity = F.coalesce(F.element_at("_severity", F.col("gate_id")), F.col("severity"))
    return out.select(*[severity.alias("severity") if n == "severity" else F.col(n) for n in findings.columns])


def apply_excludes(findings: DataFrame, options: DataFrame, gates: list[str]) -> DataFrame:
    """findings (project, gate_id, file_path, ...) of these gates, by line, less those in files that the
    project excludes for the gate; those of other gates, or without a line, stay. Malformed patterns
    exclude nothing.
    """
    o = options.select("project", F.col("gate_id").alias("_gate"), P.glob_regexes(F.col("exclude_paths")).alias("_own"))
    shared = o.where("_gate IS NULL").select("project", F.col("_own").alias("_shared"))
    own = o.where(F.col("_gate").isNotNull()).withColumnRenamed("_gate", "gate_id")
    path = F.regexp_extract("file_path", r"(?s)^(.*):[0-9]+:[^:]*\z", 1)
    hit = F.col("gate_id").isin(gates) & (path != "") & F.exists(F.coalesce("_own", "_shared"), lambda r: F.rlike(path, r))
    out = findings.join(own, ["project", "gate_id"], "left").join(shared, "project", "left")
    return out.where(~F.coalesce(hit, F.lit(False))).select(*findings.columns)


def options_of_gates(spark: SparkSession, gates: list[str]) -> DataFrame:
    """(gate_id, options) as validate_gate_options takes them: kinds of the options that a gate has."""
    return spark.createDataFrame([(g, GATE_OPTIONS.get(g)) for g in gates], "gate_id string, options map<string,string>")


def option(options: DataFrame, gate: str, *names: str) -> DataFrame:
    """(project, *names): options of a gate, for the projects that have some."""
    kinds = GATE_OPTIONS[gate]
    return options.where(F.col("gate_id") == gate).select("project", *[F.try_variant_get("value", f"$.{n}", _TYPES[kinds[n]]).alias(n) for n in names])


def project_options(options: DataFrame) -> DataFrame:
    """(project, _options): all that a project sets, as structs by gate with the patterns to exclude as regexes; under "" what
    holds for the gates that it doesn't name."""
    names = {n: k for kinds in GATE_OPTIONS.values() for n, k in kinds.items() if n != "exclude_paths"}
    values = [F.try_variant_get("value", f"$.{n}", _TYPES[k]).alias(n) for n, k in sorted(names.items())]
    each = options.select("project", F.coalesce("gate_id", F.lit("")).alias("gate_id"), P.glob_regexes(F.col("exclude_paths")).alias("excluded"), *values)
    own = F.struct("excluded", *sorted(names)).alias("own")
    # a project's rows are one for each gate at most
    return each.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("gate_id", own))).alias("_options"))


def with_options(files: DataFrame, options: DataFrame) -> DataFrame:
    """files with their project's `_options`, which path filters and gates read before any text; null for other projects.

    The table of options is copied to where the files lie if it is small, else joined by shuffle.
    """
    own = checkpointed(project_options(options))  # every gate's plan holds it
    size = own.agg(F.sum(F.octet_length(F.to_json("_options")))).first()[0] or 0
    return files.join(F.broadcast(own) if size <= BROADCAST else own, "project", "left")
