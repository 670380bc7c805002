"""Queries of runs over all gates, YAML files, the catalogue and remediation, and the same in SQL.

Derived YAML files hold each document's whole text as a block scalar; what the gates must find
follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import rules as R
from ..operators import config as C
from ..operators import project_gates as G
from ..operators import registry
from ..operators import stats as S
from ..operators import yaml_gates as Y
from ..operators.remediation import remediation_plan
from .corpus import EMISSIONS_SQL, emissions, files, projects

#: The time of the runs, in epoch ms.
NOW = 1_900_000_000_000


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.coalesce("text", F.lit("")))


def _indented(text: str = "text"):
    return F.regexp_replace(text, r"(^|\n)", "$1  ")


def config_parse_errors(spark, sf_dir):
    """Each document's text as a string inside JSON or YAML, whole by even id, cut or badly closed by odd id."""
    f, odd = files(spark, sf_dir), F.col("seq") % 2 == 1
    json = F.concat(F.lit('{"text": '), F.to_json(F.array("text")), F.when(odd, "").otherwise("}"))
    yaml = F.concat(F.lit("text: |\n"), _indented(), F.when(odd, "\nlist: [a, {b: c]\n").otherwise("\nlist: [a, {b: c}]\n"))
    return registry.config_parse_errors(f.withColumn("text", F.when(P.config_kind() == "json", json).otherwise(yaml)))


def _composes(spark, sf_dir):
    """Each document a Compose file whose settings follow its text, with the text in it."""
    d, n = _documents(spark, sf_dir), F.length("text")
    socket = F.when(n % 3 == 0, "    - {type: bind, source: /var/run/docker.sock}\n").when(n % 3 == 1, "    - type: bind\n      source: /var/run/docker.sock\n").otherwise("    - /srv:/srv\n")
    text = F.concat(
        F.lit("# made from a document\nservices:\n  web:\n    image: "), F.when(n % 5 == 0, "docker.io/Traefik:v3").otherwise('"shop/web:1"'),
        F.lit("\n    privileged: "), F.when(F.col("text").contains("the "), "yes").otherwise("no  # plain"),
        F.lit("\n    network_mode: "), F.when(n % 2 == 0, "host").otherwise("'bridge'"),
        F.lit("\n    volumes:\n    - data:/x\n"), socket,
        F.when(n % 7 == 0, "    mem_limit: 1g\n").when(n % 7 == 1, "    deploy:\n      resources: {limits: {memory: 1g}}\n").otherwise(""),
        F.lit("x-text: |\n"), _indented(), F.when(n % 11 == 0, "\nbroken: 'x\n").otherwise("\n"),
    )
    return d.select(F.col("source").alias("project"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/compose.yml")).alias("path"), text.alias("text"))


def compose_lint(spark, sf_dir):
    return Y.compose_lint(_composes(spark, sf_dir))


def yaml_nodes(spark, sf_dir):
    """Nodes, errors and characters of the text by Compose file."""
    own = F.when(F.get("key_path", F.lit(0)) == "x-text", F.length(F.regexp_replace("scalar", r"[ \t\n\x0B\f\r]", "")))
    return Y.yaml_nodes(_composes(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("kind") == "error").alias("n_errors"), F.max(own).alias("n_chars"))


def branch_protection(spark, sf_dir):
    """Each document a project whose settings file declares protection if its text has a certain word."""
    d = _documents(spark, sf_dir)
    entry = F.when(F.col("text").contains("the "), "    protection:\n      required: true\n").otherwise("    protection: null\n")
    text = F.concat(F.lit("branches:\n  - name: main\n"), entry, F.lit("about: |\n"), _indented())
    path = F.when(F.col("doc_id") % 10 > 0, ".github/settings.yml").otherwise("settings.yml")
    f = d.select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("project"), path.alias("path"), text.alias("text"))
    return Y.branch_protection_missing(projects(f), f)


def presence_hints(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("project", F.concat_ws("/", "project", F.expr("seq div 40").cast("string")))
    return G.presence_hints(projects(f), f)


#: Gates over all derived files whose findings SQL states.
RUN = (
    *G.PRESENCE, "codeowners_present", "nvmrc_missing", "large_file_tracked", "unexpected_executable_bit", "vendored_dir_tracked", "ide_artifact_tracked", "filename_quality",
    "merge_conflict_markers", "dead_placeholders",
)


def run_gates(spark, sf_dir):
    f = files(spark, sf_dir)
    return registry.run_gates(f, projects(f), NOW, RUN).select("project", "gate_id", "file_path", "severity", "status", "created_at")


def run_all_gates(spark, sf_dir):
    """Findings of all gates by gate, with a config in each project that asks for the opt-in ones."""
    f = files(spark, sf_dir)
    config = '{"ignore": ["filename_quality"], "severity": {"readme_present": "error"}, "gate_options": {"branch_protection_declared": {"enabled": true}, "compose_lint": {"suggest_when_missing": true}, "large_blob_in_history": {"enabled": true}, "secrets_scan_history": {"enabled": true}}}'
    configs = C.load_configs(projects(f).select("project", F.lit(C.CONFIG).alias("path"), F.lit(config).alias("text")))
    blobs = f.select("project", F.sha2(F.col("seq").cast("string").cast("binary"), 256).alias("sha"), "path", "seq", "size", "text")
    return registry.run_gates(f, projects(f), NOW, None, blobs, configs).groupBy("gate_id", "severity").agg(F.count("*").alias("n"))


#: Configs of projects by the last part of their name; others have none.
RUN_CONFIGS = (
    '{"exclude_paths": ["docs/*", "*.md", "["], "gate_options": {"dead_placeholders": {"disabled_patterns": ["todo"], "skip_default_fixture_paths": false}}}',
    '{"gate_options": {"network_scan": {"report_loopback": true}, "large_file_tracked": {"threshold_mb": 9, "skip_default_fixture_paths": false}, "dead_placeholders": {"skip_default_dependency_paths": false, "skip_default_generated_dirs": false}}}',
    '{"gate_options": {"dead_placeholders": {"skip_default_data_files": false, "skip_default_backup_paths": false, "skip_default_generated_files": false, "skip_default_data_dirs": false}, "merge_conflict_markers": {"skip_default_fixture_paths": false}, "unexpected_executable_bit": {"exclude_paths": ["conf*/*"]}}}',
)
OPTIONED = ("dead_placeholders", "merge_conflict_markers", "large_file_tracked", "unexpected_executable_bit", "filename_quality")


def run_with_options(spark, sf_dir):
    """Findings of some gates, each project by its own path filters, patterns and thresholds; one project in five is no repository."""
    f = files(spark, sf_dir)
    n = F.regexp_extract("project", "[0-9]+", 0).cast("int")
    text = F.get(F.lit(list(RUN_CONFIGS)), n % 4)
    own = projects(f).withColumn("is_repo", n % 5 != 4)
    configs = C.load_configs(own.select("project", F.lit(C.CONFIG).alias("path"), text.alias("text")).where("text IS NOT NULL"))
    return registry.run_gates(f, own, NOW, OPTIONED, None, configs).select("project", "gate_id", "file_path", "severity", "title")


_LISTED = list(registry.REGISTRY)


def gate_catalogue(spark, sf_dir):
    """Events by the gate that their id stands for, with what the catalogue says of it."""
    names = registry.catalogue(spark).withColumn("n_tags", F.size(S.tag_array("tags")))
    e = emissions(spark, sf_dir).select(F.get(F.lit(_LISTED), (F.col("id") % len(_LISTED)).cast("int")).alias("gate_id"))
    return e.groupBy("gate_id").agg(F.count("*").alias("n")).join(F.broadcast(names), "gate_id").select("gate_id", "severity", "n_tags", "n")


def find_findings(spark, sf_dir):
    return S.find_findings(emissions(spark, sf_dir), list(range(0, 500, 7))).select("id", "project", "gate_id", "file_path", "status")


#: Gates and places of the findings to remedy, by event.
PLANNED = (
    ("vendored_dir_tracked", "web/it's {}/dist/"), ("ide_artifact_tracked", ".idea/w{}.xml"), ("gitignore_coverage", ".gitignore:build{}"), ("unexpected_executable_bit", "src/a {}.md"),
    ("env_example_uncommented", ".env.example:{}:KEY{}"), ("merge_conflict_markers", "src/x.py:{}"), ("large_blob_in_history", "history:{}"), ("secrets_scan_history", "history:{}:x:1:jwt"), ("network_scan", "a.py:{}:ipv4"),
)


def remediations(spark, sf_dir):
    k = (F.col("id") % len(PLANNED)).cast("int")
    gate, place = (F.get(F.lit([x[i] for x in PLANNED]), k) for i in (0, 1))
    e = emissions(spark, sf_dir).select("id", "project", gate.alias("gate_id"), F.replace(place, F.lit("{}"), (F.col("id") + 1).cast("string")).alias("file_path"))
    own = e.select("project").distinct()
    ignore = F.when(F.col("project") == "p2", "dist/\n").otherwise(".idea\n# x\n")
    f = own.where("project <> 'p1'").select("project", F.lit(".gitignore").alias("path"), ignore.alias("text"))
    out = remediation_plan(e, f, own.where("project = 'p3'").withColumn("threshold_mb", F.lit(20)))
    joined = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws("|", *[x[n] for n in names])), ";")
    return out.select("id", "confidence", joined("commands", "run").alias("commands"), joined("edits", "path", "op", "content").alias("edits"), F.size("caveats").alias("n_caveats"))


QUERIES = {f.__name__: f for f in (config_parse_errors, compose_lint, yaml_nodes, branch_protection, presence_hints, run_gates, run_with_options, run_all_gates, gate_catalogue, find_findings, remediations)}


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _arr(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_COMPOSE = "c AS (SELECT source AS project, 'd' || doc_id || '/compose.yml' AS path, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents)"
_FOUND = (
    ("missing_files", "gate_id", "''"), ("codeowners_missing", "'codeowners_present'", "''"), ("nvmrc_missing", "'nvmrc_missing'", "'package.json'"), ("large_files", "'large_file_tracked'", "path"),
    ("executable_bits", "'unexpected_executable_bit'", "path"), ("vendored_dirs", "'vendored_dir_tracked'", "key"), ("ide_artifacts", "'ide_artifact_tracked'", "path"), ("odd_names", "'filename_quality'", "path"),
    ("merge_conflict_markers", "'merge_conflict_markers'", "path || ':' || line_no"), ("dead_placeholders", "'dead_placeholders'", "path || ':' || line_no || ':' || rule"),
)


def _has(path: str) -> str:
    return f"EXISTS (SELECT 1 FROM p f WHERE f.project = k.project AND {path})"


def _vendored(with_p: str) -> str:
    prefixes = [p.rstrip("/") for p in R.VENDORED_PREFIXES]
    first = " ".join(f"WHEN list_contains(dirs, '{n}') THEN '{n}'" for n in prefixes)
    marks = ", ".join(f"('{n}', '{x}')" for n, files_ in R.BUILD_MARKERS.items() for x in files_)
    vouched = " OR ".join(
        f"({_has(a)} AND {_has(b)})"
        for a, b in (("f.path = 'go.mod'", "f.path = 'vendor/modules.txt'"), ("f.path = 'composer.json'", "f.path = 'vendor/autoload.php'"), ("f.path = 'Gemfile'", "(f.path = 'vendor/bundle' OR starts_with(f.path, 'vendor/bundle/'))"))
    )
    served = _has(f"starts_with(f.path, k.key || '/') AND f.ext IN {_in(R.SERVED_EXTENSIONS)}")
    return (
        with_p
        + f""", m(mark, file) AS (VALUES {marks}),
v AS (SELECT project, dirs, CASE {first} END AS name FROM p WHERE NOT should_skip),
k AS (SELECT DISTINCT project, name, array_to_string(dirs[1:list_position(dirs, name)], '/') AS key, array_to_string(dirs[1:list_position(dirs, name) - 1], '/') AS parent FROM v WHERE name IS NOT NULL)
SELECT project, key FROM k WHERE NOT list_has_any(string_split(key, '/'), {_arr(R.SERVED_ROOTS)}) AND NOT (name = 'vendor' AND ({vouched})) AND NOT (name IN ('vendor', 'dist', 'build') AND {served})
AND (name NOT IN (SELECT mark FROM m) OR EXISTS (SELECT 1 FROM p f JOIN m ON f.base = m.file WHERE f.project = k.project AND m.mark = k.name AND array_to_string(f.dirs, '/') IN ('', k.parent)))"""
    )


def _with_options(with_p: str, known: dict[str, str]) -> str:
    """The same gates over files that are skipped by each project's options; o: the number of its config."""
    excluded = "(o = 0 AND (regexp_matches(path, '^docs/[^/]*$') OR regexp_matches(path, '^[^/]*\\.md$')))"
    content = f"""{excluded} OR (o <> 0 AND is_fixture_path) OR is_binary_path
      OR (o <> 2 AND (is_data_file OR is_backup_path OR is_generated_file OR is_noisy_data_file OR is_minified)) OR (o <> 1 AND (is_dependency_path OR is_generated_dir_path))"""
    skip = {
        "dead_placeholders": ("should_skip_content", content), "merge_conflict_markers": ("should_skip", f"{excluded} OR (o <> 2 AND is_fixture_path)"),
        "large_files": ("should_skip", f"{excluded} OR (o <> 1 AND is_fixture_path)"), "executable_bits": ("should_skip", f"{excluded} OR is_fixture_path OR (o = 2 AND regexp_matches(path, '^conf[^/]*/[^/]*$'))"),
        "odd_names": ("should_skip", f"{excluded} OR is_fixture_path"),
    }
    places = {q: (gate, place) for q, gate, place in _FOUND}
    number = "regexp_extract(project, '[0-9]+')::INT"
    parts = []
    for query, (column, condition) in skip.items():
        body = known[query].removeprefix(with_p)
        body = body.replace(" FROM p ", " FROM w ").replace(" FROM p)", " FROM w)").replace("size > 5242880", "size > CASE WHEN o = 1 THEN 9 ELSE 5 END * 1048576")
        body = body.replace("FROM l, r WHERE", "FROM l, r WHERE NOT (o = 0 AND rule = 'todo') AND")
        own = f"w AS (SELECT * REPLACE (({condition}) AS {column}) FROM (SELECT *, {number} % 4 AS o FROM p) WHERE {number} % 5 <> 4)"
        gate, place = places[query]
        rest = body.lstrip(", ")
        parts.append(f"SELECT project, {gate} AS gate_id, {place} AS file_path FROM (WITH {own}{', ' if body.startswith(',') else ' '}{rest})")
    listed = ", ".join(f"('{g[0]}', '{g[1]}', '{g[2]}')" for g in R.GATES if g[0] in OPTIONED)
    return f"""{with_p}, found AS ({' UNION '.join(parts)}), g(gate_id, title, severity) AS (VALUES {listed})
SELECT project, gate_id, file_path, severity, title FROM found JOIN g USING (gate_id)
UNION ALL SELECT project, gate_id, '.git', 'info', gate_id || ' skipped (not a git repository)' FROM (SELECT DISTINCT project FROM p WHERE {number} % 5 = 4), g"""


_Q = "''"  # a quote inside a literal


def sql(with_p: str, known: dict[str, str]) -> dict[str, str]:
    """SQL of the queries. with_p: the derived files with their predicates; known: SQL of single gates."""
    e = f"WITH {EMISSIONS_SQL}"
    vendored = _vendored(with_p)
    known = known | {"vendored_dirs": vendored}
    found = " UNION ".join(f"SELECT project, {g} AS gate_id, {place} AS file_path FROM ({known[q]})" for q, g, place in _FOUND)
    listed = ", ".join(f"('{g[0]}', '{g[2]}', {len(g[3])})" for g in R.GATES)
    return {
        "vendored_dirs": vendored,
        "config_parse_errors": with_p
        + r"SELECT project, path FROM p WHERE config_kind IN ('json', 'yaml') AND size > 0 AND size <= 5242880 AND NOT should_skip_content AND seq % 2 = 1 AND NOT (config_kind = 'yaml' AND regexp_matches(text, '\{\{|\{%|<%'))",
        "compose_lint": f"""WITH {_COMPOSE}, f AS (
  SELECT *, 1 AS line, 'yaml_invalid' AS rule FROM c WHERE n % 11 = 0
  UNION ALL SELECT *, 5, 'privileged_true' FROM c WHERE contains(t, 'the ') AND n % 11 <> 0
  UNION ALL SELECT *, 6, 'network_mode_host' FROM c WHERE n % 2 = 0 AND n % 11 <> 0
  UNION ALL SELECT *, 9, CASE WHEN n % 5 = 0 THEN 'docker_socket_mount_orchestrator' ELSE 'docker_socket_mount' END FROM c WHERE n % 3 < 2 AND n % 11 <> 0
  UNION ALL SELECT *, 4, 'missing_memory_limit' FROM c WHERE n % 7 > 1 AND n % 11 <> 0)
SELECT project, path, line, rule FROM f""",
        "yaml_nodes": rf"""WITH {_COMPOSE} SELECT path, 10 + CASE n % 3 WHEN 2 THEN 0 ELSE 2 END + CASE n % 7 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 0 END + CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END AS n_nodes,
  CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END AS n_errors, length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g')) AS n_chars FROM c""",
        "branch_protection": "SELECT 'r' || doc_id AS project FROM documents WHERE doc_id % 10 = 0 OR NOT contains(coalesce(text, ''), 'the ')",
        "presence_hints": with_p
        + """, q AS (SELECT project || '/' || (seq // 40) AS own, file_kind, should_skip_content FROM p)
SELECT a.own AS project, kind || '_lint' AS gate_id, CASE kind WHEN 'compose' THEN 'compose.yml' ELSE 'Dockerfile' END AS file_path FROM (SELECT DISTINCT own FROM q) a, (SELECT unnest(['dockerfile', 'compose']) AS kind)
WHERE NOT EXISTS (SELECT 1 FROM q f WHERE f.own = a.own AND f.file_kind = kind AND NOT f.should_skip_content)""",
        "run_gates": f"WITH found AS ({found}), g(gate_id, severity, n_tags) AS (VALUES {listed}) SELECT project, gate_id, file_path, severity, 'open' AS status, {NOW} AS created_at FROM found JOIN g USING (gate_id)",
        "run_with_options": _with_options(with_p, known),
        "gate_catalogue": f"{e}, g(gate_id, severity, n_tags) AS (VALUES {listed}) SELECT gate_id, severity, n_tags, count(*) AS n FROM (SELECT ({_arr(_LISTED)})[id % {len(_LISTED)} + 1] AS gate_id FROM emissions) JOIN g USING (gate_id) GROUP BY ALL",
        "find_findings": f"{e} SELECT id, project, gate_id, file_path, status FROM emissions WHERE id < 500 AND id % 7 = 0",
        "remediations": rf"""{e}, e AS (SELECT id, id + 1 AS i, project, id % 9 AS k FROM emissions)
SELECT id, CASE WHEN k IN (5, 8) THEN 'guided' ELSE 'deterministic' END AS confidence,
  CASE k WHEN 0 THEN 'git rm -r --cached {_Q}web/it{_Q}\{_Q}{_Q}s ' || i || '/dist{_Q};git commit -m {_Q}stop tracking web/it{_Q}\{_Q}{_Q}s ' || i || '/dist{_Q}'
    WHEN 1 THEN 'git rm --cached .idea/w' || i || '.xml;git commit -m {_Q}stop tracking .idea/w' || i || '.xml{_Q}'
    WHEN 3 THEN 'git update-index --chmod=-x {_Q}src/a ' || i || '.md{_Q};git commit -m {_Q}clear the executable bit of src/a ' || i || '.md{_Q}'
    WHEN 6 THEN 'git filter-repo --strip-blobs-bigger-than ' || CASE project WHEN 'p3' THEN 20 ELSE 5 END || 'M;git push --force-with-lease --all'
    WHEN 7 THEN 'git filter-repo --replace-text replacements.txt;git push --force-with-lease --all;rm replacements.txt' ELSE '' END AS commands,
  CASE WHEN k = 0 AND project <> 'p2' THEN '.gitignore|append|web/it{_Q}s ' || i || '/dist/' || chr(10) WHEN k = 1 AND project IN ('p1', 'p2') THEN '.gitignore|append|.idea/' || chr(10)
    WHEN k = 2 THEN '.gitignore|append|build' || i || chr(10) WHEN k = 4 THEN '.env.example|insert_before_line|# TODO: explain what KEY' || i || ' is used for' || chr(10) ELSE '' END AS edits,
  CASE k WHEN 0 THEN 1 WHEN 4 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 3 ELSE 0 END AS n_caveats FROM e""",
    }
