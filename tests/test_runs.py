"""YAML nodes, Compose files, branch protection, runs over all gates, remediation."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import rules as R
from quarry.functions import text as X
from quarry.operators import config as C
from quarry.operators import lines as N
from quarry.operators import registry
from quarry.operators import stats as S
from quarry.operators import yaml_gates as Y
from quarry.operators.remediation import GUIDED, remediation_plan

NODES = [
    ("a: 1\nb:\n- x\n- y: 2\n  z: [1, {q: w}]\n", [((), "map", None, 1), (("a",), "scalar", "1", 1), (("b",), "seq", None, 3), (("b", "[0]"), "scalar", "x", 3), (("b", "[1]"), "map", None, 4), (("b", "[1]", "y"), "scalar", "2", 4), (("b", "[1]", "z"), "seq", None, 5), (("b", "[1]", "z", "[0]"), "scalar", "1", 5), (("b", "[1]", "z", "[1]"), "map", None, 5), (("b", "[1]", "z", "[1]", "q"), "scalar", "w", 5)]),
    ("", [((), "null", None, 1)]),
    ("# only\n", [((), "null", None, 1)]),
    ("- a\n- - b\n  - c\n", [((), "seq", None, 1), (("[0]",), "scalar", "a", 1), (("[1]",), "seq", None, 2), (("[1]", "[0]"), "scalar", "b", 2), (("[1]", "[1]"), "scalar", "c", 3)]),
    ("k: |\n  a: b: c\n\n   {\nm: 'it''s' # c\nn: \"x\n  y\"\n", [((), "map", None, 1), (("k",), "scalar", "a: b: c\n\n{", 1), (("m",), "scalar", "it's", 5), (("n",), "scalar", "x\n  y", 6)]),
    ("k: !Ref x\nm: &a\n  y: 1\nz: *a\nw:\n", [((), "map", None, 1), (("k",), "scalar", "x", 1), (("m",), "map", None, 3), (("m", "y"), "scalar", "1", 3), (("z",), "scalar", "*a", 4), (("w",), "null", None, 5)]),
    ('{"a": 1, "b": [true, null]}', [((), "map", None, 1), (("a",), "scalar", "1", 1), (("b",), "seq", None, 1), (("b", "[0]"), "scalar", "true", 1), (("b", "[1]"), "scalar", "null", 1)]),
    ("url: http://a.io:80/x#y\nt: 12:30\np: a\n  b\n", [((), "map", None, 1), (("url",), "scalar", "http://a.io:80/x#y", 1), (("t",), "scalar", "12:30", 2), (("p",), "scalar", "a", 3)]),
]
BROKEN = ["a: b: c\n", "a:\n\tb: 1\n", "x: [1, 2", "x: {a: 1]\n", "a:\n  b: 1\n c: 2\n", "a: 'x\n", 'a: "x" y\n', "a: 1\nb\n", "a: @x\n", "a: x\n  b: y\n", "- a\nb: 1\n"]
FINE = ["a: [\n  1, # c\n  ']'\n]\nb: 2\n", "---\na: 1\n...\n---\nb: 2\n", "%YAML 1.2\n---\na: 1\n", "a:\r\n  - b\r\n", "'a b': {}\n", "a: >-\n  x\n  y\n", "﻿a: 1\n", "x:\n- a:\n  - b\n", "- {a: b}\n- [c]\n"]


def _texts(spark, texts, path="compose.yml"):
    return spark.createDataFrame([(str(k), path, t) for k, t in enumerate(texts)], "project string, path string, text string").withColumn("size", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def test_yaml_nodes(spark):
    got = Y.yaml_nodes(_texts(spark, [t for t, _ in NODES])).collect()
    for k, (_, nodes) in enumerate(NODES):
        assert sorted((tuple(r.key_path), r.kind, r.scalar, r.line) for r in got if r.project == str(k)) == sorted(nodes, key=lambda n: n[0])
    kinds = lambda texts: {int(r.project) for r in Y.yaml_nodes(_texts(spark, texts)).where("kind = 'error'").collect()}
    assert kinds(BROKEN) == set(range(len(BROKEN))) and kinds(FINE) == set()
    docs = Y.yaml_nodes(_texts(spark, [FINE[1], None])).select("project", "doc").distinct().collect()
    assert sorted(map(tuple, docs)) == [("0", 0), ("0", 1), ("1", 0)]
    deep = "".join(" " * k + f"k{k}:\n" for k in range(300)) + "x: " + "[" * 300 + "]" * 300
    assert Y.yaml_nodes(_texts(spark, [deep])).where("kind = 'error'").count() == 0


def test_parse_errors_of_yaml(spark):
    f = _texts(spark, [*BROKEN[:2], "a: {{ b: c }}: d\n", "a: 1\n", ""], "conf/a.yaml")
    assert sorted(r.project for r in registry.config_parse_errors(f).collect()) == ["0", "1"]


def test_compose_rules_and_overrides(spark):
    texts = [
        "services:\n  a:\n    build: .\n    privileged: 'true'\n",
        "services:\n  p:\n    image: portainer/portainer-ce@sha256:0\n    # quarry: ignore docker_socket_mount reason: by design\n    volumes: ['/var/run/docker.sock:/x', '/var/run/docker.sock:/y']\n    mem_limit: 1g\n",
        "[1]", "a: b: c", "name: x\n", "services:\n  n: null\n", None,
        "services:\n  w: {command: x, network_mode: host, deploy: {resources: {limits: {cpus: 1}}}}\n---\nservices:\n  z: {privileged: yes}\n",
    ]
    f = _texts(spark, texts)
    found = Y.compose_lint(f)
    got = sorted((int(r.project), r.line, r.rule) for r in found.collect())
    assert got == [(0, 4, "privileged_true"), (1, 5, "docker_socket_mount_orchestrator"), (2, 1, "yaml_invalid"), (3, 1, "yaml_invalid"), (6, 1, "yaml_invalid"), (7, 2, "missing_memory_limit"), (7, 2, "network_mode_host")]
    assert {r.rule: r.override_severity for r in Y.compose_overridden(found, f).where("project = '1'").collect()} == {"docker_socket_mount_orchestrator": "info"}
    assert Y.compose_lint(f, disabled=("yaml_invalid",)).where("rule = 'yaml_invalid'").count() == 0


def test_run_gates(spark):
    rows = [("a", "src/x.py", "<<<<<<< ours\n# TODO: x\n"), ("a", ".env", "K=1\n"), ("a", "README.md", "# a\n"), ("a", "c/compose.yaml", "services:\n  x:\n    image: y\n"), ("b", "k/Dockerfile", "FROM node\nUSER x\n"), ("b", C.CONFIG, "")]
    f = spark.createDataFrame([(*r, True, "100644", len(r[2])) for r in rows], "project string, path string, text string, tracked boolean, mode string, size long")
    projects = f.select("project").distinct().withColumn("is_repo", F.lit(True))
    some = ["merge_conflict_markers", "readme_present", "secrets_scan", "compose_lint", "dockerfile_lint", "branch_protection_declared", "tests_present"]
    rows = registry.run_gates(f, projects, 9, some).collect()
    out = spark.createDataFrame(rows)
    got = {(r.project, r.gate_id, r.file_path): r.severity for r in rows}
    assert got["a", "merge_conflict_markers", "src/x.py:1"] == "error" and got["b", "readme_present", ""] == "warning" and ("a", "readme_present", "") not in got
    assert got["a", "secrets_scan", ".env:1:env_file"] == "error" and got["a", "compose_lint", "c/compose.yaml:3:missing_memory_limit"] == "warning" and got["b", "dockerfile_lint", "k/Dockerfile:1:from_untagged"] == "warning"
    assert not any(g == "branch_protection_declared" for _, g, _ in got) and len({r.id for r in rows}) == len(got) == len(rows)
    config = '{"ignore": ["merge_conflict_markers"], "severity": {"tests_present": "error"}, "gate_options": {"branch_protection_declared": {"enabled": true}, "compose_lint": {"suggest_when_missing": true}, "dockerfile_lint": {"disabled_rules": ["from_untagged"]}}}'
    configs = C.load_configs(spark.createDataFrame([("a", C.CONFIG, config), ("b", C.CONFIG, config)], "project string, path string, text string"))
    got = {(r.project, r.gate_id, r.file_path): r.severity for r in registry.run_gates(f, projects, 9, some, configs=configs).collect()}
    assert not any(g in ("merge_conflict_markers", "dockerfile_lint") for _, g, _ in got) and got["a", "tests_present", ""] == "error"
    assert got["b", "compose_lint", "compose.yml"] == "info" and got["b", "branch_protection_declared", ".github/settings.yml"] == "info"
    assert registry.run_gates(f, projects, 9, ["large_blob_in_history"]).count() == 0
    with pytest.raises(ValueError, match="nope"):
        registry.run_gates(f, projects, 9, ["nope"])
    assert set(registry.REGISTRY) == {g[0] for g in R.GATES} and len(registry.REGISTRY) == 35
    assert S.find_findings(out, key=("b", "readme_present", "")).count() == 1 and S.find_findings(out, [rows[0].id]).count() == 1
    assert N.tracked_env(f).count() == 1


def test_remediation_of_odd_findings(spark):
    rows = [("p", "vendored_dir_tracked", ""), ("p", "env_example_uncommented", ".env:0:K"), ("p", "env_example_uncommented", ".env:x"), ("p", "gitignore_coverage", ".gitignore"), ("p", "other", None), (None, "ide_artifact_tracked", ".vs/a"), ("p", "vendored_dir_tracked", "a/node_modules/"), ("p", "merge_conflict_markers", "a.py:3")]
    f = spark.createDataFrame([("p", ".gitignore", "**/node_modules\n!x\n")], "project string, path string, text string")
    got = remediation_plan(spark.createDataFrame(rows, "project string, gate_id string, file_path string"), f).collect()
    by = {(r.gate_id, r.file_path): r for r in got}
    assert len(got) == len(rows) and all(by[g, p].summary == GUIDED and by[g, p].confidence == "guided" for _, g, p in rows[:5])
    assert by["ide_artifact_tracked", ".vs/a"].edits[0].content == ".vs/\n" and by["vendored_dir_tracked", "a/node_modules/"].edits == []
    assert by["merge_conflict_markers", "a.py:3"].confidence == "guided" and by["merge_conflict_markers", "a.py:3"].commands == []


def test_shell_words_and_one_line(spark):
    rows = [("", "''"), ("a/b-c", "a/b-c"), ("it's", "'it'\\''s'"), ("a b", "'a b'"), ("$x", "'$x'")]
    got = spark.createDataFrame([(a,) for a, _ in rows], "s string").select("s", X.shell_quoted(F.col("s")).alias("q")).collect()
    assert [(r.s, r.q) for r in got] == rows
    assert spark.range(1).select(X.one_line(F.lit(" a\n\t b ")).alias("x")).first().x == "a b"


def test_run_with_excludes_and_thresholds(spark):
    texts = {"src/a.py": "# TODO: x\n", "gen/b.py": "# TODO: x\n", "gen/c/d.py": "# TODO: x\n", "k/Dockerfile": "FROM node:latest\nUSER x\n", "big.dat": ""}
    f = spark.createDataFrame([(p, x, t, True, "100644", (3 << 20) if x == "big.dat" else 9) for p in "abc" for x, t in texts.items()], "project string, path string, text string, tracked boolean, mode string, size long")
    blobs = f.select("project", F.md5("path").alias("sha"), "path", F.lit(1).alias("seq"), "size", "text")
    bodies = {
        "a": '{"exclude_paths": ["gen/*", "[^]", "[z-a]", "["], "gate_options": {"dockerfile_lint": {"exclude_paths": ["k/*"]}, "large_file_tracked": {"threshold_mb": 2}, "large_blob_in_history": {"threshold_mb": 3, "enabled": true}}}',
        "b": '{"gate_options": {"dead_placeholders": {"exclude_paths": ["*/*.p[xy]"]}, "large_file_tracked": {"threshold_mb": -1}, "large_blob_in_history": {"threshold_mb": 1, "enabled": true}}}',
    }
    configs = C.load_configs(spark.createDataFrame([(p, C.CONFIG, t) for p, t in bodies.items()], "project string, path string, text string"))
    gates = ["dead_placeholders", "dockerfile_lint", "large_file_tracked", "large_blob_in_history", "filename_quality"]
    out = registry.run_gates(f, f.select("project").distinct(), 9, gates, blobs, configs).collect()
    got = lambda gate: {p: sorted(r.file_path for r in out if (r.project, r.gate_id) == (p, gate)) for p in "abc"}
    todo = [f"{p}:1:todo" for p in ("gen/b.py", "gen/c/d.py", "src/a.py")]
    assert got("dead_placeholders") == {"a": todo[1:], "b": todo[1:2], "c": todo}
    assert got("dockerfile_lint") == {"a": [], "b": ["k/Dockerfile:1:from_latest"], "c": ["k/Dockerfile:1:from_latest"]}
    assert got("large_file_tracked") == {"a": ["big.dat"], "b": [], "c": []}
    assert {p: len(x) for p, x in got("large_blob_in_history").items()} == {"a": 0, "b": 1, "c": 0}


def test_yaml_batches_are_bounded(spark):
    """Long scalars come back in several batches, and only nodes that a gate asks for come back."""
    f = spark.range(0, 40, 1, 1).selectExpr("cast(id as string) AS project", "'compose.yml' AS path", "concat('services:\\n  a:\\n    image: x\\nx-text: |\\n  ', repeat('y', 1000000)) AS text")
    assert Y.yaml_nodes(f).selectExpr("max(length(scalar)) AS n").first().n == 1_000_000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= 4 << 20
    assert Y.yaml_nodes(f, ("services",)).where("scalar like 'yy%'").count() == 0
    plan = Y.compose_lint(f)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and Y.compose_lint(f).count() == 40


def test_runs_keep_their_plans_small(spark, monkeypatch):
    """the plan behind the gates grew with every gate, and took the driver minutes whatever the tables' size."""
    rows = [("a", f"src/x{i}.txt", True, "100755", (i + 1) << 24, "TODO: x\nhttp://files.acme.io/a\n") for i in range(4)]
    files = spark.createDataFrame(rows, "project string, path string, tracked boolean, mode string, size long, text string")
    own = files.select("project").distinct().withColumn("is_repo", F.lit(True))
    configs = C.load_configs(own.select("project", F.lit(C.CONFIG).alias("path"), F.lit('{"severity": {"filename_quality": "error"}}').alias("text")))
    gates = ("large_file_tracked", "unexpected_executable_bit", "filename_quality", "dead_placeholders", "connection_strings")
    run = lambda: registry.run_gates(files, own, 0, gates, None, configs)
    monkeypatch.setattr(registry, "LOT", 2)
    small = run()
    assert len(small._jdf.queryExecution().analyzed().toString()) < 30_000
    monkeypatch.setattr(registry, "LOT", 100)
    assert sorted(map(str, small.collect())) == sorted(map(str, run().collect())) != []


def test_cheap_marks_leave_out_nothing(spark):
    """what is looked for before a mark stands in all that the mark finds."""
    jwt = ".".join(["eyJ" + "a1" * 6] * 2 + ["b2" * 6])
    said = ["todo", "FixMe", "xXx", "HACK", "Later", "LOREM", "a://b", "jdbc:x", "1.2.3.4", "x AS12", "<<<<<<< a", ">>>>>>>", "|||||||", jwt, "sk-ant-" + "a" * 32, "sk-proj-" + "b" * 32]
    said += ["AKIA" + "A" * 16, "ASIA" + "B" * 16, *[f"gh{c}_" + "c" * 36 for c in "pousr"], "github_pat_" + "d" * 60, "AIza" + "e" * 35, "xoxb-" + "f" * 10, "sk_live_" + "g" * 16, "rk_live_" + "h" * 16]
    said += ["-----BEGIN RSA PRIVATE KEY-----"]
    texts = spark.createDataFrame([(w,) for w in said], "text string")
    marks = N._MARKS | {"merge_conflict_markers": "(?m)^(?:<{7}|>{7}|\\|{7})"}
    hits = 0
    for gate, mark in marks.items():
        exact = texts.where(F.col("text").rlike(mark)).count()
        assert texts.where(N._marked(gate, F.col("text"), mark)).count() == exact > 0
        hits += exact
    assert hits >= len(said)
