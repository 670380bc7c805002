"""One pass over lines, options of path filters, Dockerfile instructions, manifests, checkouts."""

import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions import text as X
from quarry.operators import config as C
from quarry.operators import lines as N
from quarry.operators import markup as M
from quarry.operators import project_gates as G
from quarry.operators import registry
from quarry.sources.tables import load_files, text_files

SCHEMA = "project string, path string, text string, size long, tracked boolean, mode string"


def _files(spark, rows):
    return spark.createDataFrame([(p, path, t, len(t or ""), True, "100644") for p, path, t in rows], SCHEMA)


def _configs(spark, bodies):
    return C.load_configs(spark.createDataFrame([(p, C.CONFIG, t) for p, t in bodies.items()], "project string, path string, text string"))


def _run(spark, files, gates, bodies, blobs=None):
    projects = files.select("project").distinct().withColumn("is_repo", F.lit(True))
    out = registry.run_gates(files, projects, 1, gates, blobs, _configs(spark, bodies))
    return {(r.project, r.gate_id, r.file_path): r for r in out.collect()}


#: Switch -> a path that it alone skips.
SKIPPED = {
    "skip_default_fixture_paths": "server/main_test.go", "skip_default_data_files": "x/blocklist.csv", "skip_default_backup_paths": "x/main.go.bak", "skip_default_generated_files": "x/app.js.map",
    "skip_default_data_dirs": "data/seed.json", "skip_default_dependency_paths": "vendor/lib.go", "skip_default_generated_dirs": "x/__pycache__/a.py",
}


def test_each_switch_opens_its_paths_only(spark):
    assert tuple(SKIPPED) == P.SWITCHES
    rows = [(s, path, "# TODO: x\n") for s in [*P.SWITCHES, "none"] for path in SKIPPED.values()]
    bodies = {s: f'{{"gate_options": {{"dead_placeholders": {{"{s}": false}}}}}}' for s in P.SWITCHES}
    got = _run(spark, _files(spark, rows), ["dead_placeholders"], bodies)
    assert set(got) == {(s, "dead_placeholders", f"{path}:1:todo") for s, path in SKIPPED.items()}
    # credentials are looked for in data, vendored and generated folders in any case
    key = "key = AKIA" + "Q7Z2M9X4K1L8W3V5"
    got = _run(spark, _files(spark, [("a", path, key) for path in SKIPPED.values()]), ["secrets_scan"], {"a": '{"gate_options": {"secrets_scan": {"skip_default_backup_paths": false}}}'})
    assert {k[2].rsplit(":", 2)[0] for k in got} == {"x/main.go.bak", "data/seed.json", "vendor/lib.go", "x/__pycache__/a.py"}


def test_valid_options_are_accepted_and_wrong_ones_named(spark):
    good = '{"gate_options": {"large_file_tracked": {"threshold_mb": 20, "exclude_paths": ["dist/*"]}, "secrets_scan_history": {"enabled": true, "max_blobs": 10000}, "markdown_lint": {"enabled_rules": ["codeblock_no_language"]}, "network_scan": {"report_loopback": true}, "compose_lint": {"additional_orchestrator_images": ["my-org/deployer"]}}}'
    every = "{" + ", ".join(f'"{g}": {{"__no_option__": 1}}' for g in C.GATE_OPTIONS) + "}"
    bad = {"b": '{"gate_options": {"dead_placeholders": {"exclude_path": ["x"]}}}', "c": '{"gate_options": {"dead_placeholders": {"exclude_paths": "src/*"}}}', "d": '{"gate_options": {"secrets": {}}}', "e": '{"gate_options": {"readme_present": {"threshold_mb": 1}}}'}
    configs = _configs(spark, {"a": good, "z": f'{{"gate_options": {every}}}', **bad})
    problems = [(r.project, r.problem) for r in C.validate_gate_options(configs, C.options_of_gates(spark, list(registry.REGISTRY))).collect()]
    assert sorted(p for p in problems if p[0] != "z") == [("b", "unknown option exclude_path"), ("c", "wrong kind of exclude_paths"), ("d", "no such gate"), ("e", "takes no options")]
    assert [p for k, p in problems if k == "z"] == ["unknown option __no_option__"] * len(C.GATE_OPTIONS)


def test_options_of_single_gates(spark):
    compose = "services:\n  a:\n    image: my-org/Deployer:1\n    mem_limit: 1g\n    volumes: ['/var/run/docker.sock:/x']\n    privileged: true  # quarry: ignore privileged_true reason: device\n"
    rows = [(p, path, t) for p in "ab" for path, t in (("x.py", "at 127.0.0.1 and 0.0.0.0\n# TODO: y\n# FIXME: z\n"), ("compose.yaml", compose), (".gitignore", "x\n"), ("package.json", "{}"), ("s.scss", "a { text-align: justify }\n"))]
    body = '{"gate_options": {"network_scan": {"report_loopback": true, "report_unspecified": true}, "dead_placeholders": {"disabled_patterns": ["todo"]}, "compose_lint": {"additional_orchestrator_images": ["my-org/deployer"]}, "gitignore_coverage": {"disabled_patterns": ["/node_modules/"]}}}'
    got = _run(spark, _files(spark, rows), ["network_scan", "dead_placeholders", "compose_lint", "gitignore_coverage", "css_lint"], {"a": body})
    of = lambda p, gate: sorted(k[2] for k in got if k[:2] == (p, gate))
    assert of("a", "network_scan") == ["x.py:1:0.0.0.0", "x.py:1:127.0.0.1"] and of("b", "network_scan") == []
    assert of("a", "dead_placeholders") == ["x.py:3:fixme"] and of("b", "dead_placeholders") == ["x.py:2:todo", "x.py:3:fixme"]
    assert of("a", "compose_lint") == ["compose.yaml:5:docker_socket_mount_orchestrator", "compose.yaml:6:override_privileged_true"]
    assert of("b", "compose_lint") == ["compose.yaml:5:docker_socket_mount", "compose.yaml:6:override_privileged_true"]
    silenced = got["a", "compose_lint", "compose.yaml:6:override_privileged_true"]
    assert silenced.severity == "info" and silenced.title == "Override accepted: compose_lint/privileged_true"
    assert of("a", "gitignore_coverage") == [".gitignore:.DS_Store"] and ".gitignore:node_modules" in of("b", "gitignore_coverage")
    assert of("a", "css_lint") == ["s.scss:1:justified_text"]


def test_history_gates_are_opt_in_and_bounded(spark):
    key = "key = AKIA" + "Q7Z2M9X4K1L8W3V5"
    blobs = spark.createDataFrame([(p, f"{k:08d}", f"src/{k}.py" if k else "tests/t.py", k, 9 << 20, key) for p in "abc" for k in range(4)], "project string, sha string, path string, seq long, size long, text string")
    bodies = {"a": '{"gate_options": {"secrets_scan_history": {"enabled": true, "max_blobs": 2}, "large_blob_in_history": {"enabled": true}}}', "b": '{"gate_options": {"secrets_scan_history": {"enabled": false}, "large_blob_in_history": {"threshold_mb": 1}}}'}
    got = _run(spark, _files(spark, [(p, "a", "") for p in "abc"]), ["secrets_scan_history", "large_blob_in_history"], bodies, blobs)
    assert {k[0] for k in got} == {"a"} and sorted(k[2] for k in got if k[1] == "large_blob_in_history") == [f"history:{k:08d}" for k in (1, 2, 3)]
    assert sorted(k[2] for k in got if k[1] == "secrets_scan_history") == ["history:00000001:src/1.py:1:aws_access_key", "history:limit"]


def test_projects_without_a_repository_are_skipped(spark):
    f = _files(spark, [("a", "x.py", "# TODO: x\n"), ("b", "x.py", "# TODO: x\n")])
    projects = spark.createDataFrame([("a", True), ("b", False)], "project string, is_repo boolean")
    got = {(r.project, r.gate_id): (r.file_path, r.severity, r.title) for r in registry.run_gates(f, projects, 1, ["dead_placeholders", "readme_present"]).collect()}
    assert got["b", "dead_placeholders"] == (".git", "info", "dead_placeholders skipped (not a git repository)") and got["a", "dead_placeholders"][0] == "x.py:1:todo" and ("b", "readme_present") in got


def test_line_gates_read_texts_once_and_shuffle_nothing(spark, tmp_path):
    _files(spark, [("a", "x.py", "# TODO: x http://files.acme.io/a 93.184.216.34\n<<<<<<< a\n")]).write.parquet(f"{tmp_path}/f")
    out = N.line_gates(spark.read.parquet(f"{tmp_path}/f"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan
    assert sorted(r.gate_id for r in out.collect()) == ["connection_strings", "dead_placeholders", "merge_conflict_markers", "network_scan"]


def test_many_matches_in_one_line(spark):
    line = " ".join(f"http://h{k}.acme.io/a" for k in range(50_000))
    began = time.time()
    assert N.connection_strings(_files(spark, [("a", "x.py", line)])).count() == 50_000 and time.time() - began < 60


def test_lists_of_addresses(spark):
    v6 = ["2001:db8::8", "::ffff:10.0.0.1", "fe80::1 # note", "2606:4700::/32", "1:2:3:4:5:6:7:8", "::"]
    good, bad = "\n".join([*v6, *(f"93.184.216.{k}" for k in range(6))]), "\n".join(f"93.184.216.{k} host" for k in range(12))
    wrong = "\n".join([*(f"1::{k}::1" for k in range(8)), *(f"93.184.216.{k}" for k in range(4))])
    got = N.network_scan(_files(spark, [("a", "good.txt", good), ("a", "bad.txt", bad), ("a", "wrong.txt", wrong)])).groupBy("path").count().collect()
    assert {r.path: r["count"] for r in got} == {"bad.txt": 12, "wrong.txt": 4}
    zone = spark.createDataFrame([("fe80::1%eth0",), ("::1",), ("2001:db8::1",), ("::ffff:10.1.2.3",), ("1::2::3",)], "a string").select(X.classify_ipv6(X.ipv6(F.col("a"))).alias("c")).collect()
    assert [r.c for r in zone] == ["link-local", "loopback", "doc-range", "private", None]


DOCKER = [
    ("# quarry: ignore from_latest reason: dev base\nFROM node:latest\nUSER nobody", [(2, "from_latest", "info")]),
    ("# quarry: ignore from_latest reason: x\n\nFROM node:latest\nUSER n\n", [(3, "from_latest", None)]),
    ("# quarry: ignore from_latest\n# syntax=1\nFROM node:latest\nUSER n\n", [(3, "from_latest", "warning")]),
    ("# quarry: ignore *\n# quarry: ignore add_instruction reason: y\nFROM node\nUSER n\n", [(3, "from_untagged", None)]),
    ("FROM node:1\nRUN <<A <<B\nUSER root\nB\nFROM x\nA\nUSER root\n", [(7, "user_root", None)]),
    ("FROM node:1\nCOPY <<-'X' \\\n  /y\nADD a b\n  X\nUSER \\\n  root", [(6, "user_root", None)]),
    ("FROM node:1\nRUN echo $((1 << 4))\nUSER root\\\n", [(3, "user_root", None)]),
]


def test_overrides_belong_to_the_next_instruction(spark):
    got = M.dockerfile_findings(spark.createDataFrame([(str(k), "Dockerfile", t) for k, (t, _) in enumerate(DOCKER)], "project string, path string, text string")).collect()
    for k, (_, want) in enumerate(DOCKER):
        assert sorted((r.line, r.rule, r.override_severity) for r in got if r.project == str(k)) == want, k
    ends = M.docker_instructions(spark.createDataFrame([("a", "D", "FROM x \\\n y\r\nRUN a\n"), ("b", "D", None), ("c", "D", "")], "project string, path string, text string")).collect()
    assert [(r.line, r.end_line, r.kind, r.args) for r in ends] == [(1, 2, "FROM", "x  y"), (3, 3, "RUN", "a")]


MANIFESTS = [
    ("VERSION", " v1.2.3\n", "1.2.3"), ("VERSION", "1.3.0\n# note\n", None), ("VERSION", "1.3.0\n1.4.0\n", None), ("VERSION", "", None), ("mix.exs", 'def project\n version: "9.9.9"\n @version "1.2.3"\n', "1.2.3"),
    ("mix.exs", 'version: "1.2.3"\n', None), ("pom.xml", "<parent><version> 1.0.0 </version></parent><version>2.0.0</version>", "1.0.0"), ("package.json", '{"name": "x", "version" : "1.0.0-rc_1"}', "1.0.0-rc_1"),
    ("Cargo.toml", '[dependencies]\nversion = "9.9.9"\n[workspace.package]\n  version="1.2.3"\n', "1.2.3"), ("Cargo.toml", "[package]\nversion = '1.2.3'\n", None), ("pyproject.toml", '[tool.poetry]\nname = "x"\n\n[project]\nversion = "1.2.3"\n', "1.2.3"),
    ("pyproject.toml", '[tool.x]\nversion = "1.2.3"\n', None), ("package.json", '{"version": "{{VERSION}}"}', None), ("version.txt", "1.2.3.4.5", None),
]


def test_versions_of_manifests(spark):
    got = {r.project: r.version for r in G.manifest_versions(spark.createDataFrame([(str(k), p, t) for k, (p, t, _) in enumerate(MANIFESTS)], "project string, path string, text string")).collect()}
    assert [got.get(str(k)) for k in range(len(MANIFESTS))] == [v for *_, v in MANIFESTS]


def test_metadata_gates_skip_fixtures_and_vendored_files(spark):
    rows = [("a", p, "100755", 9 << 20) for p in ("tests/big.md", "big.md", "node_modules/a b.md", "tests/.idea/x.md", ".idea/x y.md")]
    f = spark.createDataFrame(rows, "project string, path string, mode string, size long").withColumns({"text": F.lit(""), "tracked": F.lit(True)})
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(G.large_files(f)) == paths(G.executable_bits(f)) == [".idea/x y.md", "big.md"] and paths(G.odd_names(f)) == paths(G.ide_artifacts(f)) == [".idea/x y.md"]


def test_checkouts_with_modes_and_index(spark, tmp_path):
    for project in ("one", "two"):
        for path, text in ((".gitignore", "x\n"), ("docs/a.md", "# a\n"), ("src/é.py", "x\n"), ("new.txt", "y\n"), ("big.bin", "z" * 3000)):
            os.makedirs(tmp_path / project / os.path.dirname(path), exist_ok=True)
            (tmp_path / project / path).write_text(text)
        os.chmod(tmp_path / project / "docs/a.md", 0o755)
    try:
        git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "one"), *a], check=True, capture_output=True)
        git("init", "-q")
        git("add", ".gitignore", "docs", "src")
    except (OSError, subprocess.CalledProcessError):
        pytest.skip("no git")
    f = load_files(spark, str(tmp_path), 2000)
    got = {(r.project, r.path): (r.tracked, r.mode, r.size) for r in f.collect()}
    assert got["one", "docs/a.md"] == (True, "100755", 4) and got["one", ".gitignore"][0] and got["one", "src/é.py"][0] and not got["one", "new.txt"][0] and got["two", "new.txt"][0]
    assert len(got) == 10 and f.where("content IS NULL").count() == 2
    assert sorted((r.project, r.path) for r in G.executable_bits(text_files(f)).collect()) == [("one", "docs/a.md"), ("two", "docs/a.md")]
    for version in ("3", "4"):
        git("update-index", "--index-version", version)
        assert {r.path for r in load_files(spark, str(tmp_path)).where("project = 'one' AND tracked").collect()} == {".gitignore", "docs/a.md", "src/é.py"}


def _tree(spark):
    rows = [("a", p, "100755", 9 << 20) for p in ("tests/big.md", "big.md", "node_modules/a b.md")]
    return spark.createDataFrame(rows, "project string, path string, mode string, size long").withColumns({"text": F.lit(""), "tracked": F.lit(True)})


def test_large_files_of_fixtures(spark, monkeypatch):
    from quarry.plans import queries as Q

    monkeypatch.setattr(Q, "files", lambda *_: _tree(spark))
    assert sorted(r.path for r in Q.large_files(spark, "").collect()) == ["big.md", "tests/big.md"]


def test_executable_bits_of_fixtures(spark, monkeypatch):
    from quarry.plans import queries as Q

    monkeypatch.setattr(Q, "files", lambda *_: _tree(spark))
    assert sorted(r.path for r in Q.executable_bits(spark, "").collect()) == ["big.md", "tests/big.md"]


def test_long_dockerfiles_are_read_in_one_pass(spark):
    """Lines that a rule doesn't ask for don't leave the reader, and time is in proportion to them."""
    text = "FROM node\n" + "RUN a b\n# c\nRUN d \\\n  e\n" * 100_000 + "USER root\n"
    f = spark.createDataFrame([("a", "Dockerfile", text)], "project string, path string, text string")
    began = time.time()
    assert [(r.pos, r.line, r.kind) for r in M.docker_instructions(f, kinds=("FROM", "USER")).collect()] == [(0, 1, "FROM"), (200_001, 400_002, "USER")]
    assert sorted((r.line, r.rule) for r in M.dockerfile_lint(f).collect()) == [(1, "from_untagged"), (400_002, "user_root")] and time.time() - began < 30
