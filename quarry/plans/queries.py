"""Registered queries over the derived tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import rules as R
from ..functions import text as X
from ..operators import lifecycle as L
from ..operators import lines as N
from ..operators import project_gates as G
from ..operators import stats as S
from . import line_sql, markup_queries, run_queries
from .corpus import EMISSIONS_SQL, FILES_SQL, emissions, files, projects
from .run_queries import NOW


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ipv4_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in documents by source and category: lines, matches, classification, counts."""
    d = _read(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.col("doc_id").cast("string").alias("path"), "text")
    own = N.explode_lines(d.where(F.col("text").rlike(R.IPV4))).select("project", F.explode(F.regexp_extract_all("line", F.lit(R.IPV4), F.lit(0))).alias("address"))
    own = own.withColumn("category", X.classify_ipv4(X.ipv4(F.col("address")))).where("category is not null")
    return own.groupBy("project", "category").agg(F.count("*").alias("n"))


def path_predicates(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select("seq", "path", *[p("path").alias(n) for n, p in P.PREDICATES.items()])


def path_excluded(spark, sf_dir):
    return files(spark, sf_dir).where(P.path_excluded(["src/*.py", "docs/**", "web/?[a-i]te*.min.js", "[", "*.md"])).select("seq", "path")


def line_counts(spark, sf_dir):
    return N.explode_lines(files(spark, sf_dir)).groupBy("project").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def merge_conflict_markers(spark, sf_dir):
    return N.merge_conflict_markers(files(spark, sf_dir))


def dead_placeholders(spark, sf_dir):
    return N.dead_placeholders(files(spark, sf_dir))


def network_scan(spark, sf_dir):
    return N.network_scan(files(spark, sf_dir))


def connection_strings(spark, sf_dir):
    return N.connection_strings(files(spark, sf_dir))


def env_example_uncommented(spark, sf_dir):
    return N.env_example_uncommented(files(spark, sf_dir).withColumn("path", F.when(F.col("seq") % 5 == 0, ".env.example").otherwise(F.col("path"))).withColumn("project", F.concat_ws("/", "project", F.col("seq").cast("string"))))


def missing_files(spark, sf_dir):
    f = files(spark, sf_dir)
    return G.missing_files(projects(f), f)


def codeowners_missing(spark, sf_dir):
    f = files(spark, sf_dir)
    return G.codeowners_missing(projects(f), f)


def nvmrc_missing(spark, sf_dir):
    return G.nvmrc_missing(files(spark, sf_dir))


def tests_missing(spark, sf_dir):
    f = files(spark, sf_dir).where(~F.col("path").rlike("^(tests/|lib/conftest|src/)"))
    return G.tests_missing(projects(f), f)


def large_files(spark, sf_dir):
    return G.large_files(files(spark, sf_dir), fixtures=True)


def executable_bits(spark, sf_dir):
    return G.executable_bits(files(spark, sf_dir), fixtures=True)


def ide_artifacts(spark, sf_dir):
    return G.ide_artifacts(files(spark, sf_dir))


def odd_names(spark, sf_dir):
    return G.odd_names(files(spark, sf_dir))


def vendored_dirs(spark, sf_dir):
    return G.vendored_dirs(files(spark, sf_dir))


def version_drift(spark, sf_dir):
    """Manifests that hold each document's text, before or behind the version, by id."""
    f = files(spark, sf_dir).withColumn("t", F.regexp_replace(F.coalesce("text", F.lit("")), r'["\\<>]', " "))
    path = F.get(F.lit(list(G.MANIFESTS)), (F.col("seq") % len(G.MANIFESTS)).cast("int"))
    version = F.concat(F.lit("v1."), (F.col("seq") % 3).cast("string"), F.when(F.length("t") % 5 == 0, "-rc_1").otherwise(".0"))
    text = (
        F.when(path == "package.json", F.concat(F.lit('{"name": "'), F.regexp_replace("t", r"\s", " "), F.lit('", "version" : "'), version, F.lit('", "engines": {"version": "9.9.9"}}')))
        .when(path == "Cargo.toml", F.concat(F.lit('[dependencies]\nversion = "9.9.9"\n[workspace.package]\n'), F.col("t"), F.lit('\n  version="'), version, F.lit('"\n')))
        .when(path == "pyproject.toml", F.concat(F.lit('[tool.x]\nversion = "9.9.9"\n[tool.poetry]\nname = "x"\nversion = "'), version, F.lit('"\n[project]\nversion = "8.8.8"\n'), F.col("t")))
        .when(path == "mix.exs", F.concat(F.col("t"), F.lit('\n[app: :x, version: "9.9.9"]\n  @version "'), version, F.lit('"\n')))
        .when(path == "pom.xml", F.concat(F.lit("<parent><version>\n"), version, F.lit("\n</version></parent><version>9.9.9</version>"), F.col("t")))
        .otherwise(F.concat(F.lit("\n "), version, F.lit("\n"), F.when(F.length("t") % 2 == 0, F.lit("")).otherwise(F.col("t"))))
    )
    return G.version_drift(f.select(F.concat(F.lit("g"), F.expr("seq div 14").cast("string"), F.when(F.col("seq") % 2 == 0, "").otherwise("b")).alias("project"), path.alias("path"), text.alias("text")))


def large_blobs(spark, sf_dir):
    blobs = files(spark, sf_dir).select("project", F.sha2(F.col("seq").cast("string").cast("binary"), 256).alias("sha"), "size")
    return G.large_blobs(blobs)


def ancestor_dirs(spark, sf_dir):
    return G.existing(files(spark, sf_dir))


def normalise_findings(spark, sf_dir):
    e = emissions(spark, sf_dir).withColumn("severity", F.when(F.col("severity") == "info", "").otherwise(F.col("severity"))).withColumn("title", F.lit(""))
    gates = e.select("gate_id").distinct().selectExpr("gate_id", "'Title ' || gate_id AS g_title", "'info' AS g_severity", "'quality' AS g_tags")
    over = e.select("project", "gate_id").distinct().where("project = 'p3'").withColumn("o_severity", F.lit("error"))
    return L.normalise(e, gates, over).select("id", "severity", "title", "tags")


def dedupe_findings(spark, sf_dir):
    return L.dedupe_keys(emissions(spark, sf_dir)).select(*L.KEY, "severity", "tags", "created_at", "emit_seq")


def _runs(spark, sf_dir):
    e = emissions(spark, sf_dir)
    keep = lambda x: L.dedupe_keys(x).select(*L.KEY, "severity", "tags", "status", "created_at", "updated_at")
    return keep(e.where("emit_seq % 2 = 0")), keep(e.where("emit_seq % 3 <> 0"))


def merge_findings(spark, sf_dir):
    return L.merge_findings(*_runs(spark, sf_dir), NOW)


def retire_ignored(spark, sf_dir):
    previous, _ = _runs(spark, sf_dir)
    return L.retire_ignored_gates(previous, previous.select("project", "gate_id").where("project in ('p1', 'p2')").distinct(), NOW)


def ignore_findings(spark, sf_dir):
    previous, current = _runs(spark, sf_dir)
    return L.ignore(previous, current, NOW)


def delete_findings(spark, sf_dir):
    previous, current = _runs(spark, sf_dir)
    return L.delete(previous, current.select(*L.KEY)).select(*L.KEY, "status")


def newly_open(spark, sf_dir):
    return L.newly_open(*_runs(spark, sf_dir))


def list_findings(spark, sf_dir):
    return S.list_findings(emissions(spark, sf_dir), project="p5", severity=["error", "warning"], sort="severity", limit=100).select("id", "severity", "updated_at")


def search_findings(spark, sf_dir):
    return S.list_findings(emissions(spark, sf_dir), status="all", tag="security", search="f1%.go", sort="file", limit=200, offset=10).select("id", "file_path")


def stats_by_status(spark, sf_dir):
    return S.by_status(emissions(spark, sf_dir), ("project",))


def stats_by_severity(spark, sf_dir):
    return S.by_severity(emissions(spark, sf_dir), ("project",))


def stats_by_gate(spark, sf_dir):
    return S.by_gate(emissions(spark, sf_dir))


def stats_top_files(spark, sf_dir):
    return S.top_files(emissions(spark, sf_dir))


def stats_by_tag(spark, sf_dir):
    return S.by_tag(emissions(spark, sf_dir))


def stats_trend(spark, sf_dir):
    e = emissions(spark, sf_dir)
    return S.trend(e, e.agg(F.max("created_at")).first()[0])


def stats_totals(spark, sf_dir):
    return S.totals(emissions(spark, sf_dir))


def group_by_file(spark, sf_dir):
    return S.group_findings(emissions(spark, sf_dir), "file")


def group_by_tag(spark, sf_dir):
    return S.group_findings(emissions(spark, sf_dir), "tag")


def blame_enrich(spark, sf_dir):
    e = emissions(spark, sf_dir)
    file, line = S.split_location()
    blame = e.where("emit_seq % 5 = 0").select("project", file.alias("file"), line.alias("line"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("hash"), F.lit("dev").alias("author"), F.col("created_at").alias("author_time")).where("file is not null")
    blame = blame.groupBy("project", "file", "line").agg(F.max("hash").alias("hash"), F.first("author").alias("author"), F.max("author_time").alias("author_time"))
    return S.blame_enrich(e, blame).select("id", "hash", "author", "author_time")


QUERIES = {
    f.__name__: f
    for f in (
        ipv4_by_category, path_predicates, path_excluded, line_counts, merge_conflict_markers, dead_placeholders, network_scan, connection_strings, env_example_uncommented, missing_files,
        codeowners_missing, nvmrc_missing, tests_missing, large_files, executable_bits, ide_artifacts, odd_names, vendored_dirs, version_drift, large_blobs, ancestor_dirs, normalise_findings, dedupe_findings,
        merge_findings, retire_ignored, ignore_findings, delete_findings, newly_open, list_findings, search_findings, stats_by_status, stats_by_severity, stats_by_gate, stats_top_files, stats_by_tag, stats_trend,
        stats_totals, group_by_file, group_by_tag, blame_enrich,
    )
}


def _in(names) -> str:
    return "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"


def _arr(names) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


def _any(names) -> str:
    return f"list_has_any(ldirs, {_arr(names)})"


_P = f"""p0 AS (SELECT *, string_split(path, '/') AS parts, lower(path) AS lpath FROM files),
p1 AS (SELECT *, parts[len(parts)] AS base, lower(parts[len(parts)]) AS lbase, parts[1:len(parts) - 1] AS dirs, list_transform(parts[1:len(parts) - 1], lambda d: lower(d)) AS ldirs,
  lower(regexp_extract(parts[len(parts)], '(\\.[^.]*)$', 1)) AS ext, list_transform(parts, lambda d: lower(d)) AS lparts,
  regexp_replace(regexp_replace(regexp_replace(lower(parts[len(parts)]), '\\.md$', ''), '\\.txt$', ''), '\\.rst$', '') AS stem FROM p0),
p2 AS (SELECT *,
  regexp_matches(lbase, '_test\\.(go|py|rs|rb)$|^test_.*\\.py$|\\.(test|spec)\\.([jt]sx?|[cm]js)$|tests?\\.(java|kt|cs|php)$|spec\\.kt$|_spec\\.rb$|^test.*\\.php$') AS is_test_file,
  ext IN {_in(R.DATA_EXTENSIONS)} AS is_data_file, ext IN {_in(R.DATASET_EXTENSIONS)} AND {_any(R.DATASET_DIRS)} AS is_data_dir_file,
  {_any(R.BACKUP_DIRS)} OR ext IN {_in(R.BACKUP_EXTENSIONS)} OR regexp_matches(lpath, '[-_ .]backup[-_][0-9]{{8}}([-_][0-9]{{6}})?') AS is_backup_path,
  lbase IN {_in(R.GENERATED_FILES)} OR ends_with(lbase, '.map') OR ends_with(lbase, '.pb.go') AS is_generated_file,
  {_any(R.DEPENDENCY_DIRS)} OR list_contains(dirs, 'Pods') OR regexp_matches(lpath, '(^|/)\\.cargo/(registry|git|bin)/|(^|/)\\.yarn/(cache|unplugged|releases|plugins|sdks|berry)/') AS is_dependency_path,
  {_any(R.GENERATED_DIRS)} OR len(list_filter(ldirs, lambda d: regexp_matches(d, '[_.-]cache$'))) > 0 AS is_generated_dir_path,
  regexp_matches(lbase, '\\.min\\.(js|css|mjs)$|\\.bundle\\.js$') AS is_minified, ext IN {_in(R.BINARY_EXTENSIONS)} AS is_binary_path,
  lbase IN {_in(R.CHANGELOG_NAMES)} AS is_changelog, stem IN {_in(R.LICENSE_NAMES)} OR regexp_matches(stem, '^licen[sc]e-') AS is_license,
  ext IN ('.yar', '.yara') OR (ext IN ('.yml', '.yaml', '.json', '.md') AND ({_any(["rules", "signatures", "detections"])} OR regexp_matches(lbase, '^(rules|signatures|detections)\\.(ya?ml|json)$'))) AS is_detection_rule,
  lbase IN {_in(R.PLACEHOLDER_REGISTERS)} AS is_placeholder_register, ext IN {_in(R.PROSE_EXTENSIONS)} AS is_prose,
  CASE WHEN ext = '.json' AND NOT (lbase IN ('devcontainer.json', '.devcontainer.json') OR regexp_matches(lbase, '^[tj]sconfig\\..*json$') OR list_has_any(lparts, ['.vscode', '.devcontainer'])) THEN 'json'
    WHEN ext IN ('.yml', '.yaml') THEN 'yaml' ELSE 'none' END AS config_kind,
  CASE WHEN ext IN ('.html', '.htm') THEN 'html' WHEN ext IN {_in(R.STYLESHEET_EXTENSIONS)} AND NOT ends_with(lbase, '.min.css') THEN 'css' WHEN ext IN ('.md', '.markdown') THEN 'markdown'
    WHEN base = 'Dockerfile' OR starts_with(base, 'Dockerfile.') THEN 'dockerfile' WHEN base IN {_in(R.COMPOSE_NAMES)} THEN 'compose' ELSE 'none' END AS file_kind
  FROM p1),
p3 AS (SELECT *, is_test_file OR base = 'conftest.py' OR {_any(R.FIXTURE_DIRS)} OR len(list_filter(dirs, lambda d: regexp_matches(d, '.Tests?$'))) > 0 AS is_fixture_path,
  ext IN {_in(R.LIST_EXTENSIONS)} OR lbase IN ('log.json', 'logs.json') OR regexp_matches(lbase, '\\.log\\.(json|txt)$') OR is_data_dir_file AS is_noisy_data_file,
  is_dependency_path OR is_generated_dir_path OR regexp_matches(lpath, '(^|/)target/(debug|release)/.+') AS subsumed_by_vendored FROM p2),
p4 AS (SELECT *, is_fixture_path AS should_skip, is_fixture_path OR is_data_file OR is_backup_path OR is_generated_file AS should_skip_secrets FROM p3),
p AS (SELECT *, should_skip_secrets OR is_noisy_data_file OR is_minified OR is_dependency_path OR is_generated_dir_path OR is_binary_path AS should_skip_content FROM p4)"""
_WITH_P = f"WITH {FILES_SQL},\n{_P}\n"
_LINES = """l AS (SELECT * FROM (SELECT *, string_split(text, chr(10)) AS ls, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM p)
  WHERE NOT (line_no = len(ls) AND line = ''))"""
_E = f"WITH {EMISSIONS_SQL}"
_DEDUPE = """SELECT project, gate_id, file_path, arg_max(severity, emit_seq) AS severity, arg_max(tags, emit_seq) AS tags, arg_max(status, emit_seq) AS status,
    arg_min(created_at, emit_seq) AS created_at, arg_max(updated_at, emit_seq) AS updated_at, max(emit_seq) AS emit_seq FROM emissions"""
_RUNS = f"""{_E},
prev AS ({_DEDUPE} WHERE emit_seq % 2 = 0 GROUP BY ALL), cur AS ({_DEDUPE} WHERE emit_seq % 3 <> 0 GROUP BY ALL)"""
_DIR = "CASE WHEN len(parts) = 1 THEN '' ELSE array_to_string(dirs, '/') END"


def _named(stems, folders) -> str:
    names = " OR ".join(f"starts_with(lbase, '{s}.')" for s in stems)
    return f"(lbase IN {_in(stems)} OR {names}) AND {_DIR} IN {_in(folders)}"


_DOCS = ("", ".github", "docs")
_PRESENT = {
    "readme_present": _named(("readme",), _DOCS),
    "license_present": _named(("license", "copying", "unlicense"), ("",)),
    "contributing_present": _named(("contributing",), _DOCS),
    "security_present": _named(("security",), _DOCS),
    "changelog_present": _named(("changelog", "changes", "history"), _DOCS),
    "gitignore_present": "path = '.gitignore'",
    "ci_workflow_present": f"({_DIR} IN {_in(R.CI_DIRS)} AND ext IN ('.yml', '.yaml')) OR path IN {_in(R.CI_FILES)}",
    "pr_template_present": f"(base IN ('pull_request_template.md', 'PULL_REQUEST_TEMPLATE.md', 'PULL_REQUEST_TEMPLATE') AND {_DIR} IN {_in(_DOCS)}) OR regexp_matches(path, '^(\\.github/|docs/)?PULL_REQUEST_TEMPLATE/')",
    "issue_template_present": f"({_DIR} = '.github/ISSUE_TEMPLATE' AND ext IN ('.md', '.yml', '.yaml')) OR (base IN ('ISSUE_TEMPLATE.md', 'issue_template.md') AND {_DIR} IN {_in(_DOCS)})",
    "code_of_conduct_present": f"base IN ('CODE_OF_CONDUCT.md', 'CODE_OF_CONDUCT', 'code_of_conduct.md') AND {_DIR} IN {_in(_DOCS)}",
}
_TESTS = f"is_test_file OR base = 'conftest.py' OR coalesce(ldirs[len(ldirs)] IN {_in(R.TEST_DIRS)}, FALSE)"
_LOCKS = [x for x in R.GENERATED_FILES if not x.endswith((".lock", ".sum"))]
_IP = "(0|[1-9][0-9]{0,2})"


def _between(nets) -> str:
    return " OR ".join(f"n BETWEEN {a} AND {b}" for a, b in map(X._range, nets))


_CATEGORY = (
    "CASE "
    + " ".join(f"WHEN {_between(nets)} THEN '{name}'" for name, nets in X.NETS_FIRST)
    + " WHEN (b = a + 1 AND c = b + 1 AND d = c + 1) OR (b = a - 1 AND c = b - 1 AND d = c - 1) THEN 'doc-placeholder'"
    + f" WHEN n IN ({', '.join(str(X.number(a)) for a in R.PUBLIC_RESOLVERS)}) THEN 'public-resolver' "
    + " ".join(f"WHEN {_between(nets)} THEN '{name}'" for name, nets in X.NETS_LAST)
    + " ELSE 'public' END"
)
SQL = {
    "ipv4_by_category": rf"""WITH m AS (SELECT source AS project, unnest(regexp_extract_all(text, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b')) AS address FROM documents),
o AS (SELECT project, string_split(address, '.')[1]::BIGINT AS a, string_split(address, '.')[2]::BIGINT AS b, string_split(address, '.')[3]::BIGINT AS c, string_split(address, '.')[4]::BIGINT AS d
  FROM m WHERE regexp_full_match(address, '({_IP}\.){{3}}{_IP}')),
v AS (SELECT project, a, b, c, d, ((a * 256 + b) * 256 + c) * 256 + d AS n FROM o WHERE a < 256 AND b < 256 AND c < 256 AND d < 256)
SELECT project, category, count(*) AS n FROM (SELECT project, {_CATEGORY} AS category FROM v) GROUP BY ALL""",
    "path_predicates": _WITH_P + f"SELECT seq, path, {', '.join(P.PREDICATES)} FROM p",
    "path_excluded": f"WITH {FILES_SQL} SELECT seq, path FROM files WHERE regexp_full_match(path, 'src/[^/]*\\.py|docs/[^/]*|web/[^/][a-i]te[^/]*\\.min\\.js|[^/]*\\.md')",
    "line_counts": _WITH_P + f", {_LINES} SELECT project, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM l GROUP BY project",
    "merge_conflict_markers": _WITH_P + f", {_LINES} SELECT project, path, min(line_no) AS line_no FROM l WHERE NOT should_skip AND regexp_matches(line, '^(<{{7}}|>{{7}}|\\|{{7}})( |\\r?$)') GROUP BY ALL",
    "dead_placeholders": _WITH_P
    + f", {_LINES}, r(rule, pat) AS (VALUES "
    + ", ".join(f"('{n}', '{p.replace(R.B, chr(92) + 'b').replace(R.E, chr(92) + 'b').replace(chr(39), chr(39) * 2)}')" for n, p in R.PLACEHOLDER_PATTERNS)
    + ") SELECT project, path, line_no, rule, regexp_extract(line, pat) AS text FROM l, r WHERE NOT (should_skip_content OR is_changelog OR is_detection_rule OR is_placeholder_register) AND regexp_matches(line, pat)",
    "network_scan": line_sql.network_scan(f"{_WITH_P}, {_LINES}", _CATEGORY),
    "connection_strings": line_sql.connection_strings(f"{_WITH_P}, {_LINES}"),
    "env_example_uncommented": line_sql.env_example_uncommented(f"WITH {FILES_SQL}"),
    "missing_files": _WITH_P
    + ", h AS ("
    + " UNION ".join(f"SELECT project, '{g}' AS gate_id FROM p WHERE {c}" for g, c in _PRESENT.items())
    + f") SELECT project, gate_id FROM (SELECT DISTINCT project FROM p), (SELECT unnest({_arr(_PRESENT)}) AS gate_id) EXCEPT SELECT project, gate_id FROM h",
    "codeowners_missing": _WITH_P
    + f"SELECT DISTINCT project FROM p WHERE ext IN {_in(R.SOURCE_EXTENSIONS)} AND project NOT IN (SELECT project FROM p WHERE base = 'CODEOWNERS' AND {_DIR} IN {_in(_DOCS)})",
    "nvmrc_missing": _WITH_P + "SELECT DISTINCT project FROM p WHERE path = 'package.json' AND project NOT IN (SELECT project FROM p WHERE path IN ('.nvmrc', '.node-version'))",
    "tests_missing": _WITH_P
    + f", q AS (SELECT * FROM p WHERE NOT regexp_matches(path, '^(tests/|lib/conftest|src/)')), h AS (SELECT project FROM q WHERE NOT (list_has_any(dirs, {_arr(R.PRUNED_DIRS)}) OR len(list_filter(dirs, lambda d: starts_with(d, '.'))) > 0) AND ({_TESTS})) "
    + f"SELECT DISTINCT project, CASE WHEN project IN (SELECT project FROM q WHERE path IN {_in(R.PROJECT_MARKERS)}) THEN 'warning' ELSE 'info' END AS severity FROM q WHERE project NOT IN (SELECT project FROM h)",
    "large_files": _WITH_P + "SELECT project, path, size FROM p WHERE size > 5242880 AND NOT subsumed_by_vendored",
    "executable_bits": _WITH_P
    + f"SELECT project, path FROM p WHERE mode = '100755' AND (ext IN {_in(R.EXEC_TEXT_EXTENSIONS)} OR lbase IN {_in(_LOCKS)}) AND NOT ({' OR '.join(f'starts_with(path, {chr(39)}{d}{chr(39)})' for d in R.SCRIPT_DIRS)}) AND NOT subsumed_by_vendored",
    "ide_artifacts": _WITH_P
    + f"SELECT project, path FROM p WHERE (base IN {_in(R.IDE_NAMES)} OR regexp_matches(base, '\\.sw[po]$|~$') OR list_has_any(dirs, {_arr(d.rstrip('/') for d in R.IDE_DIRS)})) AND NOT (list_contains(dirs, '.vscode') AND (base IN {_in(R.SHARED_EDITOR_FILES)} OR ends_with(base, '.code-snippets'))) AND NOT should_skip",
    "odd_names": _WITH_P + "SELECT project, path, 'spaces' AS problems FROM p WHERE contains(base, ' ') AND NOT (should_skip OR subsumed_by_vendored)",
    # a plain file counts if nothing but blanks stands behind the version; all others give it whatever the text is
    "version_drift": f"""WITH {FILES_SQL}, t AS (SELECT seq, regexp_replace(coalesce(text, ''), '["\\\\<>]', ' ', 'g') AS t FROM files),
v AS (SELECT 'g' || (seq // 14) || CASE WHEN seq % 2 = 0 THEN '' ELSE 'b' END AS project, ({_arr(G.MANIFESTS)})[seq % 7 + 1] AS path, '1.' || (seq % 3) || CASE WHEN length(t) % 5 = 0 THEN '-rc_1' ELSE '.0' END AS version
  FROM t WHERE seq % 7 < 5 OR length(t) % 2 = 0 OR NOT regexp_matches(t, '[^\\s]'))
SELECT project, path, version, leader FROM (SELECT *, first_value(version) OVER (PARTITION BY project ORDER BY path) AS leader FROM v) WHERE version <> leader""",
    "large_blobs": _WITH_P + "SELECT DISTINCT project, 'history:' || left(sha256(seq::VARCHAR), 8) AS file_path, size FROM p WHERE size > 5242880",
    "ancestor_dirs": _WITH_P + "SELECT DISTINCT project, array_to_string(parts[1:k], '/') AS path FROM (SELECT project, parts, unnest(generate_series(1, len(parts))) AS k FROM p)",
    "normalise_findings": f"{_E} SELECT id, CASE WHEN project = 'p3' THEN 'error' ELSE severity END AS severity, 'Title ' || gate_id AS title, tags FROM emissions",
    "dedupe_findings": f"{_E} SELECT project, gate_id, file_path, severity, tags, created_at, emit_seq FROM ({_DEDUPE} GROUP BY ALL)",
    "merge_findings": f"""{_RUNS} SELECT coalesce(p.project, c.project) AS project, coalesce(p.gate_id, c.gate_id) AS gate_id, coalesce(p.file_path, c.file_path) AS file_path,
  coalesce(c.severity, p.severity) AS severity, coalesce(c.tags, p.tags) AS tags,
  CASE WHEN c.project IS NOT NULL THEN CASE WHEN p.status = 'ignored' THEN 'ignored' ELSE 'open' END WHEN p.status = 'open' THEN 'resolved' ELSE p.status END AS status,
  coalesce(p.created_at, c.created_at) AS created_at, CASE WHEN c.project IS NOT NULL OR p.status = 'open' THEN {NOW} ELSE p.updated_at END AS updated_at
  FROM prev p FULL JOIN cur c ON p.project = c.project AND p.gate_id = c.gate_id AND p.file_path = c.file_path""",
    "retire_ignored": f"{_RUNS} SELECT project, gate_id, file_path, severity, tags, CASE WHEN project IN ('p1', 'p2') AND status = 'open' THEN 'resolved' ELSE status END AS status, created_at, CASE WHEN project IN ('p1', 'p2') AND status = 'open' THEN {NOW} ELSE updated_at END AS updated_at FROM prev",
    "ignore_findings": f"{_RUNS} SELECT p.project, p.gate_id, p.file_path, p.severity, p.tags, CASE WHEN c.project IS NULL THEN p.status ELSE 'ignored' END AS status, p.created_at, CASE WHEN c.project IS NULL THEN p.updated_at ELSE {NOW} END AS updated_at FROM prev p LEFT JOIN cur c USING (project, gate_id, file_path)",
    "delete_findings": f"{_RUNS} SELECT project, gate_id, file_path, status FROM prev ANTI JOIN cur USING (project, gate_id, file_path)",
    "newly_open": f"{_RUNS} SELECT project, gate_id, file_path FROM (SELECT * FROM cur WHERE status = 'open') ANTI JOIN (SELECT * FROM prev WHERE status = 'open') USING (project, gate_id, file_path)",
    "list_findings": f"{_E} SELECT id, severity, updated_at FROM emissions WHERE project = 'p5' AND status = 'open' AND severity IN ('error', 'warning') ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, updated_at DESC, id DESC LIMIT 100",
    "search_findings": f"{_E} SELECT id, file_path FROM emissions WHERE contains(tags, 'security') AND file_path LIKE '%f1%.go%' ORDER BY file_path, gate_id, id DESC LIMIT 200 OFFSET 10",
    "stats_by_status": f"{_E} SELECT project, status, count(*) AS n FROM emissions GROUP BY ALL",
    "stats_by_severity": f"{_E} SELECT project, severity, n, round(n * 100.0 / sum(n) OVER (PARTITION BY project))::BIGINT AS share FROM (SELECT project, severity, count(*) AS n FROM emissions WHERE status = 'open' GROUP BY ALL)",
    "stats_by_gate": f"{_E} SELECT gate_id, n, round(n * 100.0 / greatest(1, max(n) OVER ()))::BIGINT AS bar FROM (SELECT gate_id, count(*) AS n FROM emissions WHERE status = 'open' GROUP BY ALL ORDER BY n DESC, gate_id LIMIT 50)",
    "stats_top_files": f"{_E} SELECT string_split(file_path, ':')[1] AS file, count(*) AS n FROM emissions WHERE status = 'open' AND file_path <> '' GROUP BY ALL ORDER BY n DESC, file LIMIT 10",
    "stats_by_tag": f"{_E} SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(tags, ',')) AS tag FROM emissions WHERE status = 'open') WHERE tag <> '' GROUP BY tag",
    "stats_trend": f"{_E}, d AS (SELECT unnest(generate_series(max(created_at) // 86400000 - 6, max(created_at) // 86400000)) AS day FROM emissions) SELECT d.day, count(id) AS n FROM d LEFT JOIN emissions e ON e.created_at // 86400000 = d.day GROUP BY d.day",
    "stats_totals": f"{_E} SELECT project, {', '.join(f'count(*) FILTER (status = {chr(39)}open{chr(39)} AND severity = {chr(39)}{s}{chr(39)}) AS n_{s}' for s in ('error', 'warning', 'info'))}, count(*) AS total FROM emissions GROUP BY ROLLUP (project)",
    "group_by_file": f"{_E} SELECT CASE WHEN file_path = '' THEN '(project-level)' ELSE string_split(file_path, ':')[1] END AS name, count(*) AS n, min(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS worst FROM emissions GROUP BY 1",
    "group_by_tag": f"{_E} SELECT name, count(*) AS n, min(r) AS worst FROM (SELECT unnest(CASE WHEN tags = '' THEN ['(no tags)'] ELSE string_split(tags, ',') END) AS name, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS r FROM emissions) GROUP BY name",
    "blame_enrich": f"""{_E}, s AS (SELECT *, CASE WHEN file_path <> '' THEN string_split(file_path, ':')[1] END AS file, string_split(file_path, ':')[2] AS l0 FROM emissions),
t AS (SELECT *, CASE WHEN file IS NOT NULL THEN greatest(coalesce(try_cast(l0 AS INTEGER), 1), 1) END AS line FROM s),
b AS (SELECT project, file, line, max('c' || id::VARCHAR) AS hash, 'dev' AS author, max(created_at) AS author_time FROM t WHERE emit_seq % 5 = 0 AND file IS NOT NULL GROUP BY ALL)
SELECT id, hash, author, author_time FROM t LEFT JOIN b USING (project, file, line)""",
}

QUERIES |= markup_queries.QUERIES | run_queries.QUERIES
SQL |= markup_queries.SQL
# runs skip fixtures by default
_RUN_SQL = SQL | {q: SQL[q].replace("NOT subsumed_by_vendored", "NOT (subsumed_by_vendored OR should_skip)") for q in ("large_files", "executable_bits")}
SQL |= run_queries.sql(_WITH_P, _RUN_SQL)
