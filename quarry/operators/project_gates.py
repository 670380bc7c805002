"""Gates over projects and file metadata: anti-joins on slim (project, path) tables; content is never read
except where a rule names a field of a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import rules as R
from ..sources.tables import ancestor_dirs
from .lines import own_options


def _in(folders: tuple[str, ...]) -> Column:
    """The file lies directly in one of the folders ('' is the root)."""
    return F.coalesce(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("")).isin(*folders)


def _named(stems: tuple[str, ...], folders: tuple[str, ...]) -> Column:
    b = F.lower(P.base())
    own = b.isin(*stems)
    for s in stems:
        own = own | b.startswith(s + ".")
    return own & _in(folders)


PRESENCE = (
    "readme_present", "license_present", "contributing_present", "security_present", "changelog_present", "gitignore_present", "ci_workflow_present", "pr_template_present",
    "issue_template_present", "code_of_conduct_present",
)


def presence_hits() -> dict[str, Column]:
    """Gate -> whether a file satisfies it."""
    docs = ("", ".github", "docs")
    b, e = P.base(), P.ext()
    return {
        "readme_present": _named(("readme",), docs),
        "license_present": _named(("license", "copying", "unlicense"), ("",)),
        "contributing_present": _named(("contributing",), docs),
        "security_present": _named(("security",), docs),
        "changelog_present": _named(("changelog", "changes", "history"), docs),
        "gitignore_present": F.col("path") == ".gitignore",
        "ci_workflow_present": (_in(tuple(R.CI_DIRS)) & e.isin(".yml", ".yaml")) | F.col("path").isin(R.CI_FILES),
        "pr_template_present": b.isin("pull_request_template.md", "PULL_REQUEST_TEMPLATE.md", "PULL_REQUEST_TEMPLATE") & _in(docs) | F.col("path").rlike(r"^(\.github/|docs/)?PULL_REQUEST_TEMPLATE/"),
        "issue_template_present": (_in((".github/ISSUE_TEMPLATE",)) & e.isin(".md", ".yml", ".yaml")) | (b.isin("ISSUE_TEMPLATE.md", "issue_template.md") & _in(docs)),
        "code_of_conduct_present": b.isin("CODE_OF_CONDUCT.md", "CODE_OF_CONDUCT", "code_of_conduct.md") & _in(docs),
    }


def missing_files(projects: DataFrame, files: DataFrame) -> DataFrame:
    """(project, gate_id) of each presence gate without a hit: one pass over the paths, one anti-join."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(g)) for g, c in presence_hits().items()]))
    have = files.select("project", F.explode(hits).alias("gate_id")).distinct()
    wanted = projects.select("project").distinct().withColumn("gate_id", F.explode(F.array(*[F.lit(g) for g in presence_hits()])))
    return wanted.join(have, ["project", "gate_id"], "left_anti")


def codeowners_missing(projects: DataFrame, files: DataFrame) -> DataFrame:
    have = files.where((P.base() == "CODEOWNERS") & _in(("", ".github", "docs"))).select("project").distinct()
    source = files.where(F.col("tracked") & P.ext().isin(R.SOURCE_EXTENSIONS)).select("project").distinct()
    return projects.where("is_repo").select("project").join(have, "project", "left_anti").join(source, "project", "left_semi")


def nvmrc_missing(files: DataFrame) -> DataFrame:
    """Projects whose root manifest exists without a declared Node version."""
    declared = F.coalesce(F.get_json_object("text", "$.engines.node"), F.get_json_object("text", "$.volta.node"))
    manifest = files.where(F.col("path") == "package.json").groupBy("project").agg(F.max(declared.isNotNull()).alias("declared"))
    pinned = files.where(F.col("path").isin(".nvmrc", ".node-version")).select("project").distinct()
    return manifest.where(~F.col("declared")).select("project").join(pinned, "project", "left_anti")


def tests_missing(projects: DataFrame, files: DataFrame) -> DataFrame:
    """(project, severity) without a test file, test folder or quoted runner name; warning with a project marker in the root."""
    pruned = F.exists(P.dirs(), lambda d: d.isin(R.PRUNED_DIRS) | d.startswith("."))
    folder = F.coalesce(F.lower(F.try_element_at(P.dirs(), F.lit(-1))).isin(R.TEST_DIRS), F.lit(False))  # a file directly in it
    hits = files.where(~pruned & (P.is_test_file() | (P.base() == "conftest.py") | folder)).select("project")
    quoted = F.lit(False)
    for r in R.TEST_RUNNERS:
        quoted = quoted | F.col("text").contains(f'"{r}"')
    runner = files.where((F.col("path") == "package.json") & quoted).select("project")
    marked = files.where(F.col("path").isin(R.PROJECT_MARKERS)).select("project").distinct().withColumn("marked", F.lit(True))
    without = projects.select("project").join(hits.union(runner).distinct(), "project", "left_anti")
    return without.join(marked, "project", "left").select("project", F.when(F.col("marked"), "warning").otherwise("info").alias("severity"))


def _over(sized: DataFrame, most: int, thresholds: DataFrame | None) -> DataFrame:
    """Rows with a size over their project's threshold (project, threshold_mb), where it is a positive one, else over most."""
    if thresholds is None:
        return sized.where(F.col("size") > most)
    own = thresholds.select("project", (F.col("threshold_mb") * (1 << 20)).alias("_most")).where("_most > 0")
    return sized.join(own, "project", "left").where(F.col("size") > F.coalesce("_most", F.lit(most))).drop("_most")


def _skipped(files: DataFrame, gate: str, fixtures: bool) -> Column:
    """Paths that a gate over metadata passes over; fixtures: it reads those of tests and fixtures, whatever the options say."""
    return P.should_skip(fixtures=F.lit(False) if fixtures else None, scan=own_options(files, gate))


def large_files(files: DataFrame, most: int = 5 << 20, thresholds: DataFrame | None = None, fixtures: bool = False) -> DataFrame:
    """(project, path, size) of large files that are not in large-file storage; with fixtures, those of tests and fixtures too."""
    skipped = _skipped(files, "large_file_tracked", fixtures) | P.subsumed_by_vendored()
    own = files.where((F.col("size") > 1) & ~skipped).select("project", "path", "size")
    return _over(own, most, thresholds).join(lfs_managed(files), ["project", "path"], "left_anti")


def executable_bits(files: DataFrame, fixtures: bool = False) -> DataFrame:
    """(project, path) of executable files of text and data; with fixtures, those of tests and fixtures too."""
    locks = [x for x in R.GENERATED_FILES if not x.endswith((".lock", ".sum"))]
    text = P.ext().isin(R.EXEC_TEXT_EXTENSIONS) | F.lower(P.base()).isin(locks)
    script = F.lit(False)
    for d in R.SCRIPT_DIRS:
        script = script | F.col("path").startswith(d)
    return files.where((F.col("mode") == "100755") & text & ~script & ~P.subsumed_by_vendored() & ~_skipped(files, "unexpected_executable_bit", fixtures)).select("project", "path")


def ide_artifacts(files: DataFrame) -> DataFrame:
    b = P.base()
    folder = F.exists(P.dirs(), lambda d: F.concat(d, F.lit("/")).isin(R.IDE_DIRS))
    shared = F.array_contains(P.dirs(), ".vscode") & (b.isin(R.SHARED_EDITOR_FILES) | b.endswith(".code-snippets"))
    return files.where((b.isin(R.IDE_NAMES) | b.rlike(r"\.sw[po]$|~$") | folder) & ~shared & ~P.should_skip(scan=own_options(files, "ide_artifact_tracked"))).select("project", "path")


_ODD = (("spaces", " "), ("control characters", r"[\x00-\x1F\x7F-\x9F]"), ("bidirectional characters", r"[؜‎‏‪-‮⁦-⁩]"), ("zero-width characters", r"[­͏᠎​-‍⁠﻿]"))


def odd_names(files: DataFrame) -> DataFrame:
    """(project, path, problems): comma-joined kinds of odd characters in the base name."""
    found = F.array_compact(F.array(*[F.when(P.base().rlike(p), F.lit(n)) for n, p in _ODD]))
    own = files.where(~P.should_skip(scan=own_options(files, "filename_quality")) & ~P.subsumed_by_vendored())
    return own.select("project", "path", F.array_join(found, ", ").alias("problems")).where("problems <> ''")


def vendored_dirs(files: DataFrame) -> DataFrame:
    """(project, key): outermost vendored folders, by the first prefix in order that a path contains as a folder.

    Not those below a served root, a vendor folder that its package manager's files vouch for,
    folders that hold served assets (vendor, dist, build), and folders with an ambiguous name but
    without a build tool's marker beside them or in the root.
    """
    out = F.lit(None).cast("string")
    for p in reversed(R.VENDORED_PREFIXES):
        name = p.rstrip("/").replace(".", r"\.")
        out = F.when(F.concat(F.lit("/"), F.col("path")).contains("/" + p), F.regexp_extract("path", rf"^((?:.*?/)?{name})/", 1)).otherwise(out)
    keys = files.where(~P.should_skip(scan=own_options(files, "vendored_dir_tracked"))).select("project", out.alias("key")).where(F.col("key").isNotNull()).distinct()
    keys = keys.where(~F.arrays_overlap(F.split("key", "/"), F.lit(R.SERVED_ROOTS))).withColumn("name", F.element_at(F.split("key", "/"), -1))
    has = lambda path: F.max(F.coalesce(path, F.lit(False)))
    path = F.col("path")
    root = files.where(path.isin("go.mod", "composer.json", "Gemfile", "vendor/modules.txt", "vendor/autoload.php") | (path == "vendor/bundle") | path.startswith("vendor/bundle/"))
    vouched = root.groupBy("project").agg(
        (has(path == "go.mod") & has(path == "vendor/modules.txt")).alias("go"), (has(path == "composer.json") & has(path == "vendor/autoload.php")).alias("php"),
        (has(path == "Gemfile") & has(path.startswith("vendor/bundle"))).alias("ruby"),
    ).where("go OR php OR ruby").select("project", F.lit("vendor").alias("name"))
    at = F.transform(P.dirs(), lambda d, k: F.when(d.isin("vendor", "dist", "build"), F.array_join(F.slice(P.dirs(), F.lit(1), k + 1), "/")))
    served = files.where(P.ext().isin(R.SERVED_EXTENSIONS)).select("project", F.explode(F.array_compact(at)).alias("key")).distinct()
    clear = keys.join(vouched, ["project", "name"], "left_anti").join(served, ["project", "key"], "left_anti")
    folders = F.array_distinct(F.array(F.lit(""), F.regexp_extract("key", "^(?:(.*)/)?[^/]*$", 1)))
    asked = clear.where(F.col("name").isin(*R.BUILD_MARKERS)).withColumn("folder", F.explode(folders))
    kinds = F.array_compact(F.array(*[F.when(P.base().isin(*m), F.lit(n)) for n, m in R.BUILD_MARKERS.items()]))
    marked = files.select("project", F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1).alias("folder"), F.explode(kinds).alias("name")).distinct()
    backed = asked.join(marked, ["project", "folder", "name"], "left_semi").select("project", "key").distinct()
    return clear.where(~F.col("name").isin(*R.BUILD_MARKERS)).select("project", "key").union(backed)


def presence_hints(projects: DataFrame, files: DataFrame) -> DataFrame:
    """(project, gate_id, file_path): projects without a container file, and without a Compose file. For those that asked."""
    own = files.where(~P.should_skip_content(scan=own_options(files, "dockerfile_lint"))).select("project", P.file_kind().alias("kind")).where("kind IN ('dockerfile', 'compose')").distinct()
    wanted = projects.select("project").distinct().withColumn("kind", F.explode(F.array(F.lit("dockerfile"), F.lit("compose"))))
    without = wanted.join(own, ["project", "kind"], "left_anti")
    return without.select("project", F.concat("kind", F.lit("_lint")).alias("gate_id"), F.when(F.col("kind") == "compose", "compose.yml").otherwise("Dockerfile").alias("file_path"))


#: Root files that declare a version.
MANIFESTS = ("package.json", "Cargo.toml", "pyproject.toml", "mix.exs", "pom.xml", "VERSION", "version.txt")


def _in_sections(*names: str) -> Column:
    """The first version, in double quotes, in any of these sections of a TOML file."""
    wanted = F.lit([f"[{n}]" for n in names])

    def step(state, line):
        own = F.regexp_replace(line, r"^\s+|\s+\z", "")
        header = own.startswith("[") & own.endswith("]")
        here = F.when(header, F.array_contains(wanted, own)).otherwise(state["here"])
        found = F.when(here & ~header, F.regexp_extract(line, r"^\s*version\s*=\s*\"([^\"]+)\"", 1)).otherwise("")
        return F.struct(here.alias("here"), F.when(state["version"] == "", found).otherwise(state["version"]).alias("version"))

    return F.aggregate(F.split("text", "\n", -1), F.struct(F.lit(False).alias("here"), F.lit("").alias("version")), step, lambda state: state["version"])


def manifest_versions(files: DataFrame) -> DataFrame:
    """(project, path, version) declared by root manifests, without a leading v.

    Of a JSON, Elixir or XML manifest the first that stands anywhere in it, of a TOML one the first in the package's
    section; a plain file must hold nothing else.
    """
    own, path = files.where(F.col("path").isin(*MANIFESTS)), F.col("path")
    plain = F.regexp_replace("text", r"^\s+|\s+\z", "")
    raw = (
        F.when(path == "package.json", F.regexp_extract("text", r"\"version\"\s*:\s*\"([^\"]+)\"", 1))
        .when(path == "Cargo.toml", _in_sections("package", "workspace.package"))
        .when(path == "pyproject.toml", _in_sections("project", "tool.poetry"))
        .when(path == "mix.exs", F.regexp_extract("text", r"@version\s+\"([^\"]+)\"", 1))
        .when(path == "pom.xml", F.regexp_extract("text", r"<version>\s*([^<\s]+)\s*</version>", 1))
        .otherwise(F.when(~plain.rlike(r"[\n#]"), plain))
    )
    version = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+\z", ""), "^v", "")
    return own.select("project", "path", version.alias("version")).where(F.col("version").rlike(r"^\d+(\.\d+){1,3}([-+][0-9A-Za-z_.-]+)?\z"))


def version_drift(files: DataFrame) -> DataFrame:
    """(project, path, version, leader): manifests that disagree with the project's first one by path."""
    mono = files.where(F.col("path").isin(R.MONOREPO_MARKERS) | ((F.col("path") == "package.json") & F.col("text").contains('"workspaces"'))).select("project").distinct().withColumn("mono", F.lit(True))
    v = manifest_versions(files).join(mono, "project", "left").where(~(F.coalesce("mono", F.lit(False)) & (F.col("path") == "package.json"))).drop("mono")
    lead = F.min(F.struct("path", "version")).over(W.partitionBy("project"))
    return v.withColumn("leader", lead["version"]).where("version <> leader").select("project", "path", "version", "leader")


def large_blobs(blobs: DataFrame, most: int = 5 << 20, thresholds: DataFrame | None = None) -> DataFrame:
    own = blobs.where(~P.should_skip(scan=own_options(blobs, "large_blob_in_history"))) if "path" in blobs.columns else blobs
    return _over(own.select("project", "sha", "size"), most, thresholds).select("project", F.concat(F.lit("history:"), F.left("sha", F.lit(8))).alias("file_path"), "size").distinct()


def existing(files: DataFrame) -> DataFrame:
    return ancestor_dirs(files)


def _glob(pattern: Column) -> Column:
    """Anchored regex of a glob with *, ? and classes; ** crosses folders, **/ is none or more."""
    out = F.regexp_replace(pattern, r"([.+()|^$\\{}])", r"\\$1")
    out = F.regexp_replace(out, r"\*\*/", "\x01")
    out = F.regexp_replace(out, r"\*\*", "\x02")
    out = F.regexp_replace(F.regexp_replace(out, r"\*", "[^/]*"), r"\?", "[^/]")
    out = F.replace(F.replace(out, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".*"))
    return F.concat(F.lit("^(?:"), out, F.lit(r")\z"))


def _own_lines(files: DataFrame, name: str) -> DataFrame:
    """(project, rule_line) of a file in the root, trimmed, without comments."""
    each = files.where(F.col("path") == name).select("project", F.explode(F.split("text", "\n")).alias("l"))
    return each.select("project", F.trim(F.regexp_replace("l", r"\r\z", "")).alias("rule_line")).where("rule_line <> '' AND NOT startswith(rule_line, '#')")


def gitignore_coverage(files: DataFrame, disabled: tuple[str, ...] = (), own_disabled: DataFrame | None = None) -> DataFrame:
    """(project, pattern): what a project's stack asks .gitignore to cover and it doesn't. Silent without .gitignore.

    own_disabled: (project, off) of projects that switch patterns off.

    One join by project: a project's required patterns are few, its lines are one file.
    """
    root = files.where(F.col("path").isin(*R.STACK_MARKERS, ".gitignore")).groupBy("project").agg(F.collect_set("path").alias("names"))
    asks = F.array_union(F.lit(list(R.IGNORE_ALWAYS)), F.flatten(F.filter(F.array(*[F.when(F.array_contains("names", m), F.lit(list(p))) for m, p in R.IGNORE_BY_MARKER.items()]), lambda x: x.isNotNull())))
    off = F.lit([d.strip("/") for d in disabled]) if disabled else F.array().cast("array<string>")
    if own_disabled is not None:
        root = root.join(own_disabled, "project", "left")
        off = F.array_union(off, F.transform(F.coalesce("off", F.array().cast("array<string>")), lambda x: F.regexp_replace(F.trim(x), "^/+|/+$", "")))
    wanted = root.where(F.array_contains("names", ".gitignore") & F.arrays_overlap("names", F.lit(list(R.STACK_MARKERS)))).select("project", F.explode(F.array_distinct(F.array_except(asks, off))).alias("pattern"))
    has = ignore_lines(files)
    whole, last = F.col("pattern"), F.substring_index("pattern", "/", -1)
    covers = (F.col("have") == whole) | _safe_match(whole) | _safe_match(last)
    covered = wanted.join(has, "project").where(covers).select("project", "pattern")
    return wanted.join(covered, ["project", "pattern"], "left_anti")


def ignore_lines(files: DataFrame) -> DataFrame:
    """(project, have): patterns of the root's .gitignore without slashes at either end."""
    return _own_lines(files, ".gitignore").where("NOT startswith(rule_line, '!')").select("project", F.regexp_replace("rule_line", "^/|/$", "").alias("have")).distinct()


def matches_glob(name: Column, glob: Column) -> Column:
    """A class in the glob is taken as one character."""
    return F.coalesce(F.regexp_like(name, _glob(F.regexp_replace(glob, r"\[[^\]]*\]|\[", "?"))), F.lit(False))


def _safe_match(name: Column) -> Column:
    return matches_glob(name, F.col("have"))


def lfs_managed(files: DataFrame) -> DataFrame:
    """(project, path) of files that a line of the root's .gitattributes hands to large-file storage.

    A pattern without a slash holds at any depth. The join is by project; the lines are one small file of each.
    """
    lines = _own_lines(files, ".gitattributes").where("contains(rule_line, 'filter=lfs')").select("project", F.split("rule_line", r"\s+")[0].alias("glob")).distinct()
    glob = F.regexp_replace("glob", "^/|/$", "")
    deep = F.when(F.rtrim(F.col("glob"), F.lit("/")).contains("/"), glob).otherwise(F.concat(F.lit("**/"), glob))
    rules = lines.select("project", _glob(deep).alias("rule"))
    return files.select("project", "path").join(rules, "project").where(F.regexp_like("path", F.col("rule"))).select("project", "path").distinct()
