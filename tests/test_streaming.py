"""Streams give what the batch operators give."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import lifecycle as L
from quarry.operators import lines as N
from quarry.plans import corpus
from quarry.operators import markup as M
from quarry.sources.store import Store, upsert_batch
from quarry.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def _drain(df, spark, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_scan_equals_batch(spark, tmp_path):
    files = corpus.files(spark, SF)
    files.repartition(3).write.parquet(f"{tmp_path}/files")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/files")
    got = _drain(J.stream_scan(stream, N.dead_placeholders), spark, "scan", "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, N.dead_placeholders(files).collect()))


def test_merge_trend_and_first_seen(spark, tmp_path):
    e = corpus.emissions(spark, SF).drop("id")
    e.coalesce(1).sortWithinPartitions("emit_seq").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")
    J.stream_merge(stream, f"{tmp_path}/store", 7, f"{tmp_path}/c").awaitTermination(120)
    got = Store(spark, f"{tmp_path}/store", J.FINDING).read()
    assert got.count() == e.select(*L.KEY).distinct().count() and got.where("status <> 'open'").count() == 0
    trend = _drain(J.stream_trend(stream), spark, "trend", "complete")
    assert trend.agg({"n": "sum"}).first()[0] == e.count()
    assert _drain(J.stream_first_seen(stream), spark, "seen", "append").count() == e.select(*L.KEY).distinct().count()


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_store_switches_whole_versions(spark, tmp_path, monkeypatch):
    schema = "project string, n long"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    store = Store(spark, f"{tmp_path}/s", schema, 8)
    assert store.read().count() == 0 and store.version().number == 0
    first = store.write(rows(("a", 1), ("b", 2), (None, 3)))
    only = rows(("a", 10))
    store.write(only, store.touched(only))
    assert sorted(map(str, store.read().collect())) == sorted(map(str, rows(("a", 10), ("b", 2), (None, 3)).collect()))
    pinned = store.read(first)
    assert sorted(r.n for r in pinned.collect()) == [1, 2, 3] == sorted(r.n for r in store.read(1).collect())
    monkeypatch.setattr(Store, "_switch", lambda self, new: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.write(rows(("z", 9)))
    monkeypatch.undo()
    assert store.version().number == 2 and "z" not in {r.project for r in store.read().collect()}
    assert store.write(rows(), None).writes == {} and store.read().count() == 0 and store.read(2).count() == 3
    with pytest.raises(ValueError):
        store.read(99)


def test_batches_are_applied_once_and_cost_follows_them(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", "project string, n long")
    store.write(spark.range(3000).select(F.concat(F.lit("p"), (F.col("id") % 300).cast("string")).alias("project"), F.col("id").alias("n")))
    whole = _size(f"{tmp_path}/s/data")
    more = spark.createDataFrame([("p1", 5_000)], "project string, n long")
    add = lambda old, new: old.unionByName(new)
    upsert_batch(store, 4, more, add)
    upsert_batch(store, 4, more, add)
    upsert_batch(store, 3, more, add)
    assert store.read().count() == 3001 and store.version().number == 2 and _size(f"{tmp_path}/s/data") - whole < whole / 8


def test_changed_files_equal_a_batch_run(spark, tmp_path):
    schema = "project string, path string, seq long, text string, size long, tracked boolean, mode string"
    row = lambda p, path, seq, text: (p, path, seq, text, len(text or ""), True, "100644")
    docker, compose = "FROM node\nUSER root\n", "services:\n  a:\n    image: x\n    privileged: true\n"
    steps = [
        [row("a", "k/Dockerfile", 1, docker), row("a", "compose.yaml", 1, compose), row("b", "x.py", 1, "# TODO: x\n")],
        [row("a", "k/Dockerfile", 2, "FROM node:1\nUSER root\nADD a b\n"), row("a", "k/Dockerfile", 0, docker), row("b", "x.py", 3, "x\n")],
        [row("b", "x.py", 2, "# TODO: late\n"), row("a", "compose.yaml", 5, None)],
    ]
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/files")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/files")
        J.stream_gates(stream, f"{tmp_path}/store", k, f"{tmp_path}/c").awaitTermination(180)
    got = {(r.project, r.file_path): r.status for r in Store(spark, f"{tmp_path}/store/findings", J.FINDING + ", path string").read().collect()}
    assert got == {
        ("a", "k/Dockerfile:1:from_untagged"): "resolved", ("a", "k/Dockerfile:2:user_root"): "open", ("a", "k/Dockerfile:3:add_instruction"): "open",
        ("a", "compose.yaml:4:privileged_true"): "resolved", ("a", "compose.yaml:3:missing_memory_limit"): "resolved", ("b", "x.py:1:todo"): "resolved",
    }
    last = spark.createDataFrame([steps[1][0]], schema)
    assert {f"{r.path}:{r.line}:{r.rule}" for r in M.dockerfile_lint(last).collect()} == {p for (_, p), s in got.items() if s == "open"}
