"""Byte-string removal, clustering and periodic runs against brute force; odd rows; main slots and blocks of preferences."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, decontaminate, html_template, periodic, subvectors, suffix_dedup
from quarry.llm import queries as Q
from quarry.llm.common import row_key
from quarry.llm.induced import suffixes

SF = "/root/testdata/sf0.001"
LAST = (1 << 63) - 1


@pytest.mark.parametrize("most", [10**6, 5])
def test_induced_order_and_common_prefixes(most):
    """most = 5: samples are named and sorted recursively, queues lie in a file."""
    rng = np.random.default_rng(0)
    for trial in range(120):
        n, a = int(rng.integers(1, 150)), int(rng.integers(2, 6))
        t = np.r_[rng.integers(1, a, n), 0].astype(np.uint16)
        if trial % 3 == 0:
            t[:n] = np.tile(t[: max(1, n // 5)], 10)[:n]
        got, own = np.concatenate(list(suffixes(t, a, 50, most))), t.tolist()
        assert sorted(got["pos"].tolist()) == list(range(n))
        heads = [own[i : i + 50] for i in got["pos"]]
        assert heads == sorted(heads)
        shared = [next((k for k, (x, y) in enumerate(zip(a_, b_)) if x != y), min(len(a_), len(b_))) for a_, b_ in zip(heads, heads[1:])]
        assert [0, *shared] == got["lcp"].tolist()


def _removed(rows):
    """(doc_id, kept, spans) by sets of all 50-byte strings."""
    key, first = (lambda d: LAST if d is None else d), {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], LAST + 1), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key(d):
                gone[i : i + 50] = b"\1" * 50
        edges = [i for i in range(len(b) + 1) if (0 < i <= len(b) and gone[i - 1]) != (i < len(b) and bool(gone[i]))]
        out.append((str(d), bytes(x for x, g in zip(b, gone) if not g), str(list(zip(edges[::2], edges[1::2])))))
    return sorted(out)


def _found(df, sizes=suffix_dedup.Sizes()):
    out = suffix_dedup.remove_repeats(df, sizes)
    return sorted((str(r.doc_id), bytes(r.kept), str([(s.start, s.end) for s in r.spans or []])) for r in out.collect())


@pytest.mark.parametrize("sizes", [suffix_dedup.Sizes(), suffix_dedup.Sizes(hot=2, hot_all=3, held=50, piece=300, flush=600, strings=7)])
def test_removed_bytes_equal_brute_force(spark, sizes):
    """Small sizes: everything hot, recursive, in pieces. Null and repeated ids, null texts, NUL bytes, characters of several bytes."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [(b := rng.choice(base))[(a := rng.randint(0, len(b))) : a + rng.randint(10, 200)] for _ in range(rng.randint(0, 4))]
        rows.append((rng.choice([i, i, i, rng.randint(0, 20), None]), None if i % 50 == 0 else "".join(parts) + str(rng.random()) * rng.randint(0, 8)))
    rows += [(7, "a" * 3000), (9, "ab" * 1000), (400, "a" * 300 + "\0" * 200), (401, "\0" * 200), (402, ""), (7, "a" * 3000)]
    assert _found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), sizes) == _removed(rows)


def test_removal_orders_text_ids_and_keeps_columns(spark):
    text = "the same sixty bytes of text stand in each of these two rows."
    df = spark.createDataFrame([("b", text, 1), ("a", text, 2), (None, text, 3)], "doc_id string, text string, spans int")
    out = suffix_dedup.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "spans", "kept"] and {r.doc_id: len(r.kept) for r in out.collect()} == {"a": 61, "b": 0, None: 0}
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def _clustered(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centers)):
            mine = [v for (_, v), c in zip(kept, own) if c == j]
            if mine:
                centers[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *near(v)) for i, v in kept]
    total = {j: sum(d for _, d, c in last if c == j) for j in range(len(centers))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((str(i), j, d, total[j], sum(total.values()), sha[j]) for i, d, j in last)


def test_clusters_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(subvectors, "CHUNK", 40)
    rng = random.Random(5)
    vector = lambda levels: [rng.choice(levels) for _ in range(64)]
    rows = [(i, vector([-0.3, 0.0, 0.1234, 0.9])) for i in range(150)] + [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(150, 200)]
    rows += [(3, vector([0.5])), (3, vector([0.5])), (None, vector([0.25])), (900, None), (901, [0.1] * 63), (902, [float("nan")] + [0.1] * 63), (903, [None] + [0.1] * 63), (904, [float("inf")] + [0.0] * 63), (905, []), (906, vector([300_000.0, -1.0]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = subvectors.cluster_vectors(df)
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect()) == _clustered(rows)
    few = df.where("vec_id IN (1, 2, 900)")
    assert sorted((r.cluster, r.distance) for r in subvectors.cluster_vectors(few).collect()) == [(0, 0), (1, 0)] and subvectors.cluster_vectors(df.limit(0)).count() == 0


def test_blocks_are_encoded_without_loss():
    rng = np.random.default_rng(1)
    for vectors, width in ((np.repeat(rng.integers(-9, 9, (4, 64)), 50, axis=0), 16), (rng.integers(0, 3, (400, 64)), 4), (rng.integers(-9999, 9999, (50, 64)), 1)):
        got, words, codes = subvectors.encode(vectors.astype(np.int64))
        assert got == width and (np.concatenate([w[c] for w, c in zip(words, codes)], axis=1) == vectors).all()


def _runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        docs = []
        for _ in range(rng.randint(1, 4)):
            k, w = rng.randint(1, 4), []
            for _ in range(rng.randint(0, 6)):
                w += ([rng.randint(0, k) for _ in range(rng.randint(1, 12))] * rng.randint(1, 7))[: rng.randint(1, 60)]
            docs.append(w)
        got = periodic.runs(np.array([x for d in docs for x in d], dtype=np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
        ends = np.cumsum([0, *map(len, docs)])
        assert list(zip(*(x.tolist() for x in got))) == [(s + a, n, q) for d, a in zip(docs, ends) for s, n, q in _runs(d)]


def test_runs_of_a_very_long_text():
    start, length, period = periodic.runs(np.tile(np.arange(700), 400), np.zeros(280_000, dtype=np.int64))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [280_000], [700])


def test_periodic_query_equals_brute_force(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w, h = (r.text or "").encode().split(), zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found, gone = _runs(w), set()
        for s, m, q in found:
            gone.update(range(s + q, s + m))
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in found).encode()
        want.append((r.doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha(listed), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = [tuple(r) for r in Q.QUERIES["op13_periodic_runs"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and sum(x[1] for x in want) > 10


def test_runs_of_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "a " * 6, "z"), (2, "a b a b a b a b", None), (2, "a b a b a b a b", None), (3, "a\tb\x0ba b\na b a  b c", "w")]
    out = periodic.find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string"))
    got = sorted((str(r.doc_id), r.text or "", [tuple(x) for x in r.runs], r.collapsed) for r in out.collect())
    assert out.columns == ["doc_id", "text", "runs", "collapsed"]
    assert got == sorted([("1", "", [], ""), ("1", "", [], ""), ("None", "a " * 6, [(0, 6, 1)], "a"), *[("2", "a b a b a b a b", [(0, 8, 2)], "a b")] * 2, ("3", rows[5][1], [(0, 8, 2)], "a b c")])
    planted = periodic.with_planted(spark.createDataFrame([(None, "a b c d e f g h"), (0, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in planted} == {None: "a b c a b c a b", 0: None}
    assert periodic.find_runs(out.limit(0)).count() == 0


def _page(body):
    return f"<html><body><nav>Menu</nav>{body}<footer>Legal</footer></body></html>"


def test_articles_stay_whole(spark):
    shared = "<p>Both pages tell this part in the same words.</p><p>And this one, too.</p>"
    pages = [("http://small.example/1", _page(f"<article>{shared}<p>First ending.</p></article>")), ("http://small.example/2", _page(f"<article>{shared}<p>Another ending here.</p></article>"))]
    for k in range(8):
        body = f"<div class='text'><h2>Background</h2><p>Report {k} begins<br>after a break.</p><h2>References</h2><p>Source {k * 7}.</p><div><p>Join us today.</p></div></div>"
        pages.append((f"http://big.example/{k}", _page(body)))
        voices = "".join(f"<div class='voice'><p>Reader {k}{j} has a lot to say about this and that, at length.</p></div>" for j in range(4 + k % 3))
        pages.append((f"http://talk.example/{k}", _page(f"<div class='tale'><p>Tale number {k} is told here in a few words, which are enough.</p></div><div class='voices'>{voices}</div>")))
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.url: r.text for r in html_template.extract_main_text(df).collect()}
    assert got["http://small.example/1"] == "Both pages tell this part in the same words.\nAnd this one, too.\nFirst ending."
    assert all(got[f"http://big.example/{k}"] == f"Background\nReport {k} begins after a break.\nReferences\nSource {k * 7}." for k in range(8))
    assert all(got[f"http://talk.example/{k}"] == f"Tale number {k} is told here in a few words, which are enough." for k in range(8))


def test_pairs_with_null_or_far_turns_are_one_row(spark):
    schema = "pair_id long, turn long, role string, text string"
    a = spark.createDataFrame([(1, 0, "user", "hi"), (1, None, "assistant", "yes"), (2, 1, "user", "hi"), (2, 500_000, "assistant", "yes")], schema)
    b = a.withColumn("text", F.when(F.col("role") == "assistant", "no").otherwise(F.col("text")))
    got = {r.pair_id: (r.block, r.n_prompt, r.n_chosen, r.n_rejected) for r in chat.format_preferences(a, b).collect()}
    assert got == {1: (0, 1, 1, 1), 2: (0, 1, 1, 1)}


def test_row_keys_tell_nulls_and_borders_apart(spark):
    rows = [(None, None), (None, ""), ("", None), ("", ""), ("1", "2x"), ("12", "x"), ("1", "1 2x"), (None, "x"), ("1", "2x")]
    d = spark.createDataFrame(rows, "doc_id string, text string").select(row_key().alias("k"))
    keys = [bytes(r["k"]) for r in d.collect()]
    assert len(set(keys)) == len(rows) - 1 and keys[4] == keys[-1] and {len(k) for k in keys} == {16}


def test_decontamination_in_passes_takes_maps_repeats_and_null_texts(spark):
    words = " ".join(f"w{k}" for k in range(14))
    docs = spark.createDataFrame([(1, f"a {words} b", {"k": 1}), (2, f"a {words} b", {"k": 2}), (2, f"a {words} b", {"k": 2}), (3, None, None), (4, "", {}), (5, "other text", None)], "doc_id long, text string, more map<string,int>")
    items = spark.createDataFrame([("i", words), ("j", "other text"), ("n", None)], "item_id string, text string")
    one, many = (sorted(map(repr, decontaminate.decontaminate(docs, items, limit=k).collect())) for k in (10_000, 20))
    assert one == many and len(one) == 6 and sum("contaminated=True" in r for r in one) == 4


def test_line_leaves_move_their_keys_once(spark):
    """op2: keys of leaves went through an aggregate, two joins and a checkpoint; leaves of the same lines are still one."""
    from quarry.llm import line_templates

    rows = [(h, 10, h, 7) for h in (1, 2)] + [(9, 10, 50, 51), (8, 3, 1, 1)]
    leaves = line_templates._leaves(spark.createDataFrame(rows, "h long, n int, w0 long, w1 long"), 4, 0.8)
    plan = leaves._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 2
    got = leaves.collect()
    assert sorted(r["h"] for r in got) == [1, 2] and len({r["leaf"] for r in got}) == 1
