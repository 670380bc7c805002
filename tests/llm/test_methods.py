"""The operators' methods: the queries against their SQL and against brute force, and what each method must do."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import chat, decontaminate, html_template, line_templates, mixing, quality, queries, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    mine = Counter(repr(tuple(r[n] for n in names)) for r in got.collect())
    at = [want.columns.index(n) for n in names]
    assert mine == Counter(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def n_dropped(spark, lines):
    return [r["n_dropped"] for r in line_templates.dedup_lines(docs_of(spark, lines)).orderBy("doc_id").collect()]


def test_crossed_field_values_are_one_template(spark):
    lines = [f"order for customer {c} was sent from host {h} today without any error" for c in ("ann", "bob", "eve") for h in ("red", "blue", "green")]
    assert n_dropped(spark, lines) == [0] + [1] * 8


def test_a_field_among_the_first_words(spark):
    assert n_dropped(spark, [f"service {x} was started again by the root user today" for x in ("ann", "bob", "eve", "zed")]) == [0, 1, 1, 1]


def test_edits_at_different_places_are_one_template(spark):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(57)]
    rng, lines = random.Random(2), []
    for k in range(12):
        own = list(words)
        for at in rng.sample(range(4, 57), k % 4 + 1):
            own[at] = f"new{chr(97 + rng.randrange(3))}"
        lines.append(" ".join(own))
    assert n_dropped(spark, lines) == [0] + [1] * 11


def test_short_lines_and_lines_of_numbers(spark):
    assert n_dropped(spark, ["one two three four"] * 3) == [0, 1, 1]
    assert n_dropped(spark, ["Read on"] * 2 + ["Read out"]) == [0, 1, 0]
    assert n_dropped(spark, ["12 13", "12 13", "14"]) == [0, 0, 0]


def test_text_ids_and_lines_of_one_document(spark):
    docs = spark.createDataFrame([("b", "a line of five words\na line of five words"), ("a", "a line of five words"), (None, "a line of five words")], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["n_dropped"]) for r in line_templates.dedup_lines(docs).collect()) == [("", 1), ("a", 0), ("b", 2)]


def test_lines_under_a_small_broadcast_bound(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = sorted(map(tuple, line_templates.dedup_lines(docs).select("doc_id", "text").collect()))
    monkeypatch.setattr(line_templates, "BROADCAST_LINES", 0)
    assert sorted(map(tuple, line_templates.dedup_lines(docs).select("doc_id", "text").collect())) == want


def test_messages_without_a_pair_are_not_one_pair(spark):
    a = spark.createDataFrame([(None, k, "user", f"m{k}") for k in range(50)], "pair_id long, turn long, role string, text string")
    out = chat.format_preferences(a, a.limit(0)).collect()
    assert len(out) == 50 and all(r["n_chosen"] == 1 and r["n_prompt"] == r["n_rejected"] == 0 for r in out)


PAGE = "<html><body class='site has-sidebar'><div class=box1><p>Our shop sells things</p></div><form id=aspnet><div class='content has-sidebar widget-area-main'><p>story {0} begins <a class=share>here {0}</a> and goes on</p><p>and story {0} ends</p></div><div class='cookie-notice'><p>we bake {0}</p></div></form><div class=box2><p>call us</p></div></body></html>"


def pages_of(spark, htmls, host="h.example.com"):
    return spark.createDataFrame([(k, f"http://{host}/{k}", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")


def test_page_without_an_article_and_with_misleading_names(spark):
    pages = pages_of(spark, [PAGE.format(k) for k in range(6)] + [PAGE.format(0)] * 9)
    got = {r["page_id"]: r["text"] for r in html_template.extract_main_text(pages).collect()}
    assert all(got[k] == f"story {k} begins here {k} and goes on\nand story {k} ends" for k in range(6)) and got[14] == got[0]


def test_the_template_is_needed(spark):
    """Boxes of fixed text that no name tells: without the template they stay."""
    page = "<body><div class=x1><p>{0} one two three</p><div class=y><p>a fixed sentence of the host</p></div><p>{0} four</p></div></body>"
    pages = pages_of(spark, [page.format(k) for k in range(5)])
    template = html_template.templates(pages)
    text = lambda t: {r["text"] for r in html_template.extract_main_text(pages, t).collect()}
    assert text(template) == {f"{k} one two three\n{k} four" for k in range(5)}
    assert all("a fixed sentence" in x for x in text(template.limit(0)))


def test_template_by_join_and_by_broadcast(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted(map(tuple, queries.op3_main_text(spark, SF).collect()))
    monkeypatch.setattr(html_template, "BROADCAST_TEXTS", 0)
    assert sorted(map(tuple, html_template.extract_main_text(pages).select("page_id", "url", "text", "n_chars").collect())) == want


def test_classes_by_brute_force(spark):
    """Equal occurrence vectors over the host's different pages, valid from 90 % of these on."""
    rng = random.Random(3)
    htmls = ["<body><ul>" + "".join(f"<li>entry {j}" for j in range(rng.randrange(1, 4))) + "</ul><div class=a><p>fixed</p>" + (f"<p>own {k}" if k % 4 else "") + "</div></body>" for k in range(30)]
    htmls += htmls[:5]
    count: dict[int, dict] = defaultdict(dict)
    for h in set(htmls):
        for t, (_, _, times, _, _) in html_template.tokens(html_template.parse(h)).items():
            count[t][h] = times
    n = len(set(htmls))
    classes = defaultdict(set)
    for t, own in count.items():
        if len(own) >= 0.9 * n:
            classes[frozenset(own.items())].add(t)
    got = defaultdict(set)
    for r in html_template.templates(pages_of(spark, htmls)).collect():
        got[r["class"]].add(r["token"])
        assert r["covered"] == len(count[r["token"]])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))


def test_deep_pages_cost_in_proportion():
    page = html_template.parse("<div>" * 50_000 + "text")
    assert len(page.token) == 50_001 and html_template.main_text(page, None, frozenset()) == "text"


def test_simhash_query_by_brute_force(spark):
    from xxhash import xxh64_intdigest

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {}
    for i, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        hs = [xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    root = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if root[a] < root[b] and bin(fps[a] ^ fps[b]).count("1") <= 3:
                    root[b], changed = root[a], True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in docs}


def test_toxicity_query_on_held_out_rows(spark):
    """No planted label leaks into a score, and most held-out documents are told apart."""
    sf = "/root/testdata/sf0.01"
    got = queries.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    right = Counter((r["toxic"], r["predicted"]) for r in got)
    assert right[0, 1] == 0 and right[1, 1] >= 2 * right[1, 0] and all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_needs_the_pairs(spark):
    """An insult counts with a group only: linear weights can't say that."""
    rng, rows = random.Random(5), []
    plain = "river stone cloud tree house light water morning".split()
    for k in range(1500):
        insult, group = k % 3 == 0, k % 2 == 0 or k % 9 == 0
        words = [rng.choice(plain) for _ in range(12)] + ["grubbly"] * insult + ["folkish"] * group
        rows.append((k, " ".join(words), int(insult and group)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    both, one, other = (model.score(t, {}) for t in (b"river stone grubbly folkish", b"river stone grubbly", b"river stone folkish"))
    assert both > 0.5 > max(one, other) and np.abs(model.factors).max() > 0.1


def test_toxicity_terms_of_any_script():
    terms = lambda t: set(toxicity.slots(t.encode()))
    assert terms("some “grubbly” word") >= terms("grubbly")
    assert len(terms("这是一个坏人") & terms("他说坏人很多")) >= 1
    assert not terms("x" * 70 + "a") & terms("x" * 70 + "b") - terms("x" * 70) or terms("x" * 70 + "a") != terms("x" * 70 + "b")


def test_decontamination_in_several_passes_builds_each_automaton_once(spark):
    rng = random.Random(6)
    items = [(f"i{k}", " ".join(f"w{rng.randrange(500)}" for _ in range(14))) for k in range(60)]
    docs = docs_of(spark, [f"start {items[k % 60][1]} end" if k % 3 == 0 else " ".join(f"w{rng.randrange(500)}" for _ in range(40)) for k in range(90)])
    bench = spark.createDataFrame(items, "item_id string, text string")
    one = sorted(map(repr, decontaminate.decontaminate(docs, bench).collect()))
    many = decontaminate.decontaminate(docs, bench, limit=3000)
    assert sorted(map(repr, many.collect())) == one
    # every pass is a job of its own: the last plan has no scan of the texts left but the one for the offsets
    assert many._jdf.queryExecution().executedPlan().toString().count("find(") == 0


def test_splitting_tree_keeps_quotas_and_margins(spark):
    rng = np.random.default_rng(1)
    quota = rng.integers(0, 50, 23)
    margins = np.array([quota.sum() * (k + 1) // 7 - quota.sum() * k // 7 for k in range(7)])
    parts = mixing.split(quota, margins, rng)
    assert (parts.sum(axis=0) == quota).all() and (parts.sum(axis=1) == margins).all() and parts.min() >= 0
    big = mixing.split(np.array([3 * 10**9, 10**9]), np.array([2 * 10**9, 2 * 10**9]), rng)
    assert (big.sum(axis=1) == 2 * 10**9).all() and abs(big[0, 0] - 1.5e9) < 1e6
    plan = spark.createDataFrame([(f"s{k}" if k else None, int(q)) for k, q in enumerate(quota)], "source string, copies long")
    for group in (4, 4096):
        got = mixing.shard_bounds(plan, 7, group=group).collect()
        by_source, by_shard = Counter(), Counter()
        for r in got:
            by_source[r["source"]] += r["last"] - r["first"]
            by_shard[r["shard"]] += r["last"] - r["first"]
        assert by_source == Counter({f"s{k}" if k else None: int(q) for k, q in enumerate(quota) if q}) and [by_shard[k] for k in range(7)] == margins.tolist()


def test_mixing_rows_without_an_id_and_a_very_long_document(spark):
    rows = [(None, f"t{k} " * 20, "a") for k in range(600)] + [(k, "w " * 300, "b") for k in range(300)] + [(999, "w " * 30_000, "b")] + [(1000 + k, "w " * 100, "c") for k in range(900)]
    per = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), copies=False).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 400 for r in per)


def test_mixing_shards_lie_in_their_order(spark):
    docs = docs_of(spark, ["w " * 9] * 300).withColumn("source", F.lit("s"))
    parts = defaultdict(list)
    for r in mixing.mix(docs, shards=3).withColumn("part", F.spark_partition_id()).collect():
        parts[r["part"]].append((r["shard"], r["position"]))
    assert len(parts) > 3 and all(x == sorted(x) for x in parts.values())


def test_ledger_is_asked_on_addresses_and_kept(spark):
    docs = docs_of(spark, ["token: abcdefgh", None, "token: abcdefgh", "AKIA" + "B" * 17])
    ledger, found = secrets.scan_secrets(docs)
    n = ledger.count()
    ledger, found = secrets.scan_secrets(docs, ledger, found)
    assert (n, ledger.count()) == (3, 3) and {len(r["scanned"]) for r in ledger.collect()} == {len(secrets.RULES)}
    new = docs.union(spark.createDataFrame([(9, "password=another1")], "doc_id long, text string"))
    assert [r["text"] for r in secrets.unseen(new, ledger).collect()] == ["password=another1"]
    newer = tuple(secrets.SecretRule(r.kind, r.pattern, r.least, r.group, "2") if r.kind == "hex" else r for r in secrets.RULES)
    assert {tuple(r["rules"]) for r in secrets.unseen(docs, ledger, newer).collect()} == {("hex",)}


def test_quality_cascade_saves_and_keeps_the_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    kept = lambda **o: sorted((r["doc_id"], r["kept"]) for r in quality.judge_quality(docs, **o).collect())
    assert kept() == kept(sample=0) == kept(counts=False)
    d = quality.Doc(b"few words")
    assert quality.RULES[0].rejects(d) and "n_repeat_words" not in d.__dict__
    assert quality.ordered({"a": 1.0, "b": 2.0, "c": 1.0}, {"a": {0, 1}, "b": {0, 1, 2, 3, 4, 5}, "c": {0, 1}}, 8) == ["b", "c", "a"]


def test_stage_of_near_copies_by_brute_force(spark):
    """Every document that goes has a similar one that stays, over links of the two kinds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = {i: (t or "").translate({c: c + 32 for c in range(65, 91)}).split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    fps = {i: simhash.fingerprint((t or "").encode()) for i, t in texts.items()}
    near = lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3 or bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if root[a] < root[b] and near(a, b):
                    root[b], changed = root[a], True
    assert kept == set(root.values())
    assert math.isclose(len(kept), len(set(root.values())))
