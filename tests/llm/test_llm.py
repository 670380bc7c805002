"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns;
those without SQL against brute force, planted pages or held-out labels."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import chat, decontaminate, html_template, line_templates, mixing, quality, queries, secrets, shingles, simhash, toxicity, url_rules

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, SIZE int, kept string, score string, findings string, n_words string, component_id string, n_lines string"


def rows(*docs):
    return [(i, t, "en", s, len(t or ""), 1, "a", "b", "c", "d", "e", "f") for i, t, s in docs]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null ids and sources, repeated rows, one id with two texts, a long text."""
    text = "alpha beta gamma delta epsilon zeta"
    return spark.createDataFrame(rows((1, text, "s"), (1, text, "s"), (2, None, None), (3, "", "s"), (None, "x " * 40, "t"), (4, "word " * 60_000, "t"), (5, text + " eta", None), (5, "another text", "s")), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bench(spark, *items):
    return spark.createDataFrame(list(items), "item_id string, text string")


LABELS = "doc_id long, quality int, toxic int"


def every_operator(spark, docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, 0), (7, 0, None), (None, 1, 1)], LABELS)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/c").alias("url"), F.col("text").alias("html"), F.lit(1).alias("HOST"), F.lit("z").alias("n_chars"))
    turns = docs.select(F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("turn"), F.col("source").alias("role"), "text", F.lit(1).alias("prompt"))
    ledger, found = secrets.scan_secrets(docs)
    return {
        "chat": chat.format_preferences(turns, turns),
        "lines": line_templates.dedup_lines(docs),
        "html": html_template.extract_main_text(pages),
        "url": url_rules.judge_urls(pages),
        "bench": decontaminate.decontaminate(docs, bench(spark, ("a", "alpha beta gamma"), (None, None), ("e", ""))),
        "toxic": toxicity.score_toxicity(docs, toxicity.train(docs, labels)),
        "simhash": simhash.near_duplicates(docs),
        "mix": mixing.mix(docs, copies=False),
        "mixed": mixing.mix(docs),
        "secrets": secrets.with_findings(docs, ledger, found),
        "quality": quality.judge_quality(docs),
    }


def test_odd_rows_keep_their_number(spark, odd):
    n = odd.count()
    for name, out in every_operator(spark, odd).items():
        got = out.collect()
        names = [c.lower() for c in out.columns]
        assert len(names) == len(set(names)), name
        if name not in ("chat", "mixed"):
            assert len(got) == n, name


def test_empty_tables(spark, empty):
    for name, out in every_operator(spark, empty).items():
        assert out.collect() == [], name


def test_pipeline_stages_on_odd_and_empty(spark, odd, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0), (5, 1, 1)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark, ("a", "another text")).write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert out.schema == docs.schema
                # columns that share a name with an operator's are the input's own
                assert {(r["SIZE"], r["score"], r["component_id"]) for r in out.collect()} <= {(1, "b", "e")}
            out.write.format("noop").mode("overwrite").save()


def test_near_copies_stage_with_repeated_and_missing_ids(spark):
    """Different texts without an id, or under one id, all stay; copies don't."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    docs = spark.createDataFrame([(None, a), (None, b), (None, b), (7, "c d e f"), (7, "x y z w"), (8, "x y z w")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == [(0, a), (0, b), (7, "c d e f"), (7, "x y z w")]


def test_near_copies_stage_finds_similar_texts_with_distant_fingerprints(spark):
    """Texts with 80 to 90 % of their 5-word shingles in common; brute force says which."""
    rng, texts = random.Random(4), []
    for g in range(12):
        words = [f"g{g}w{k}" for k in range(150)]
        for copy in range(2):
            own = list(words)
            for at in rng.sample(range(150), 2 * copy + g % 2):
                own[at] = f"x{rng.random()}"
            texts.append(" ".join(own))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for t in texts]
    near = {2 * g + 1 for g in range(12) if len(sets[2 * g] & sets[2 * g + 1]) >= 0.8 * len(sets[2 * g] | sets[2 * g + 1])}
    fps = [simhash.fingerprint(t.encode()) for t in texts]
    assert sum(bin(fps[i] ^ fps[i - 1]).count("1") > 3 for i in near) > 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    far = {i for i in range(1, 24, 2) if i not in near and bin(fps[i] ^ fps[i - 1]).count("1") > 3}
    assert got == {2 * g for g in range(12)} | far


def test_preferences_common_prefix(spark):
    s = "pair_id long, turn long, role string, text string"
    a = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (2, 0, "user", "same"), (3, 0, "user", "only")], s)
    b = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "same")], s)
    got = {r["pair_id"]: r for r in chat.format_preferences(a, b).collect()}
    assert got[1]["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and got[1]["rejected"].endswith("no<|im_end|>\n")
    m = got[1]["chosen_mask"][0]
    assert got[1]["chosen"][m["start"] : m["end"]] == "yes<|im_end|>"
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[3]["prompt"] == "" and got[3]["rejected"] == ""


def test_preferences_long_conversation_in_blocks(spark):
    a = spark.range(1000).select(F.lit(1).alias("pair_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    b = a.withColumn("text", F.when(F.col("turn") >= 500, "x").otherwise(F.col("text")))
    out = chat.format_preferences(a, b, block=64).orderBy("block").collect()
    assert len(out) == 16 and sum(r["n_prompt"] for r in out) == 500 == sum(r["n_chosen"] for r in out)


def test_line_templates_generalise_and_keep_first(spark):
    line = "the service on host {} was started by user root at boot"
    docs = spark.createDataFrame([(k, line.format(n) + "\nown " + " ".join(f"{w}{c}" for w in "red green blue stone river".split()), "en", "s", 1) for k, (n, c) in enumerate(zip(["alpha", "beta", "gamma", "10.0.0.7"], "abcd"))], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_templates.dedup_lines(docs).collect()}
    assert len(got[0]) == 2 and all(len(got[k]) == 1 and got[k][0].startswith("own") for k in (1, 2))


def test_shared_passage_goes_from_all_but_one(spark):
    passage = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))

    def own(k):
        rng = random.Random(k)
        return " ".join(rng.choice("red green blue stone river cloud tree".split()) for _ in range(60))

    docs = spark.createDataFrame([(k, f"{own(k)}\n{passage}", "en", "s", 1) for k in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_lines(spark, docs, "").collect()
    assert len(out) == 6 and sum(passage in r["text"] for r in out) == 1 and all(r["n_chars"] == len(r["text"]) for r in out)


def test_html_main_text():
    html = """<html><head><title>t</title><style>p{}</style></head><body><nav><p>menu</p></nav><div class="cookie-notice">We use cookies</div><article><h1>Head &amp; more</h1>
    <p>One <b>two</b>
    three.<p>Four<script>var x="</p>"</script><aside>related</aside><form>mail</form><div class="comments"><p>first!</p></div></article><footer>end</footer></body>"""
    assert html_template.main_text(html_template.parse(html), None, frozenset()) == "Head & more\nOne two three.\nFour"


def test_html_template_finds_fixed_texts(spark):
    page = "<html><body><div class=top><p>Our shop sells things</p></div><div class=story><p>story {0} begins here {0}</p><p>and story {0} ends</p></div><div class=base><p>call us</p></div></body></html>"
    pages = spark.createDataFrame([(k, f"http://h.example.com/{k}", page.format(k)) for k in range(8)] + [(99, "http://other.example.com/", page.format(99))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_template.extract_main_text(pages).collect()}
    assert got[3] == "story 3 begins here 3\nand story 3 ends"


def test_html_query_on_planted_articles(spark):
    import html as h
    import re

    for r in queries.op3_main_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = "\n".join(x for x in (" ".join(h.unescape(re.sub("</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)) if x)
        assert r["text"] == want and r["n_chars"] == len(want)


def test_url_rules(spark):
    urls = ["https://www.Example.com/en/71?x", "http://a.com/en/", "http://example.net/de/853#t", "http://x.example.net/de/7", "ftp://b.org/es/1", "no scheme", None, "http://notexample.com", "http://com/en/"]
    got = [(r["rule"], r["verdict"]) for r in url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got == [("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/en/", "block")]


def test_decontamination_offsets_and_split_automata(spark):
    words = [f"w{k}" for k in range(14)]
    docs = spark.createDataFrame([(1, "Ä Intro! " + " -- ".join(words).upper() + " tail"), (2, "clean text"), (3, "short one here")], "doc_id long, text string")
    b = bench(spark, ("long", " ".join(words)), ("short", "Short one"), ("same", " ".join(words[:11])))
    one = decontaminate.decontaminate(docs, b).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["items"]) for r in one] == [(14, ["long", "same"]), (0, []), (2, ["short"])]
    s = one[0]["spans"][0]
    assert docs.first()["text"][s["start"] : s["end"]].startswith("W0") and docs.first()["text"][s["start"] : s["end"]].endswith("W13")
    many = decontaminate.decontaminate(docs, b, limit=20).orderBy("doc_id").collect()
    assert [r[2:] for r in many] == [r[2:] for r in one]


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    plain, bad = "river stone cloud tree house light water morning".split(), "snarlish grubbly".split()
    docs, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        docs.append((k, " ".join(rng.choice(plain) for _ in range(30)) + (" " + rng.choice(bad) if toxic else "")))
        labels.append((k, 1, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    model = toxicity.train(docs, labels)
    held = toxicity.score_toxicity(docs, model).where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id")
    assert held.where("predicted <> toxic").count() == 0 and held.count() > 50


def test_toxicity_fits_on_one_text_per_id(spark):
    docs = [(k, "snarlish tree" if k % 2 else "river stone") for k in range(100)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(100)], LABELS)
    once = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    again = toxicity.train(spark.createDataFrame(docs + [docs[1]] * 500, "doc_id long, text string"), labels)
    assert once.row == again.row and once.row and once.bias == again.bias and (once.weights == again.weights).all()


def components(fps):
    """Smallest id reachable over links of at most 3 bits, by brute force."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin((fps[a] ^ fps[b]) & (1 << 64) - 1).count("1") <= 3:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def test_simhash_components_brute_force(spark):
    rng = np.random.default_rng(3)
    fps = []
    for _ in range(25):
        seed = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            f = seed
            for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                f ^= 1 << int(b)
            fps.append(f)
    slim = {}
    for i, f in enumerate(fps):
        slim.setdefault(f - (f >> 63 << 64), i)
    got = {r["f"]: r["component_id"] for r in simhash.component_roots(spark.createDataFrame(list(slim.items()), "fingerprint long, low long")).collect()}
    want = components({i: f for f, i in slim.items()})
    assert {i: got[f] for f, i in slim.items()} == want


def test_simhash_fingerprint_brute_force():
    from xxhash import xxh64_intdigest

    for text in ("", "One", "a B", "the cat sat on the mat the cat sat", "ä b c d"):
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in text.encode().decode().replace("\t", " ").split(" ") if w]
        sh = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hs = [xxh64_intdigest(s.encode(), 42) for s in sh]
        assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_golay_keys_find_all_near_pairs():
    rng = np.random.default_rng(5)
    f = rng.integers(-(2**63), 2**63 - 1, 400, dtype=np.int64)
    g = f.copy().view(np.uint64)
    for i in range(len(g)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            g[i] ^= np.uint64(1 << int(b))
    stored = [set(x) for x in simhash.stored_keys(f).tolist()]
    found = defaultdict(bool)
    for row, key in zip(*(x.tolist() for x in simhash.asked_keys(g.view(np.int64)))):
        found[row] |= key in stored[row]
    assert all(found[i] for i in range(len(f)))


def test_mixing_targets_and_shards(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 40 + 1), "abcd"[min(k % 7, 3)] if k % 11 else None) for k in range(3000)], "doc_id long, text string, source string")
    per = mixing.mix(docs, copies=False).groupBy("source").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.expr("taken - 2 * size")).alias("over")).collect()
    assert abs(sum(r["target"] for r in per) - 1.5 * sum(r["size"] for r in per)) < 1e-3
    assert all(abs(r["taken"] - r["target"]) <= 80 and r["over"] <= 0 for r in per)
    mixed = mixing.mix(docs, shards=5)
    assert mixed.agg(F.sum("size")).first()[0] == sum(r["taken"] for r in per)
    sizes = {r["shard"]: r["count"] for r in mixed.groupBy("shard").count().collect()}
    assert len(sizes) == 5 and max(sizes.values()) < 1.3 * min(sizes.values())
    assert mixed.exceptAll(mixing.mix(docs, shards=5)).count() == 0


def test_mixing_query_takes_what_the_tree_deals(spark, monkeypatch):
    """Blocks of a shard that isn't dealt aren't taken."""
    docs = spark.createDataFrame([(k, "w w", "ab"[k % 2] if k % 5 else None) for k in range(200)], "doc_id long, text string, source string")
    shards = {r["source"]: r["size"] for r in mixing.mix(docs).groupBy("source").agg(F.sum("size").alias("size")).collect()}
    assert {r["source"]: r["taken"] for r in mixing.mix(docs, copies=False).groupBy("source").agg(F.sum("taken").alias("taken")).collect()} == shards
    whole = mixing.dealt
    monkeypatch.setattr(mixing, "dealt", lambda plan, shards, seed=8: whole(plan, shards, seed).where("shard < 8"))
    taken, n = mixing.mix(docs, copies=False).agg(F.sum("taken"), F.count("*")).first()
    assert n == 200 and abs(2 * taken - sum(shards.values())) <= 16


def test_secrets_spans(spark):
    docs = spark.createDataFrame([(1, "é password = hunter22 AKIA" + "A" * 16), (2, "token: token: abcdefgh"), (3, None), (4, "é password = hunter22 AKIA" + "A" * 16)], "doc_id long, text string")
    ledger, found = secrets.scan_secrets(docs)
    got = {r["doc_id"]: [(f["rule"], f["start"], f["end"]) for f in r["findings"]] for r in secrets.with_findings(docs, ledger, found).collect()}
    assert got == {1: [("assign", 2, 21), ("access", 22, 42)], 2: [], 3: [], 4: got[1]}


def test_quality_counts_and_order(spark):
    d = quality.Doc("a b c a b c #x\n\nline two\nline two\n".encode())
    assert (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words) == (11, 22, 1, 1, 6)
    assert set(quality.cascade_order(spark.createDataFrame([("x",)], "text string"))) == {r.name for r in quality.RULES}
    good = " ".join(f"word{k}" for k in range(80))
    got = [r["kept"] for r in quality.judge_quality(spark.createDataFrame([(1, good), (2, good.replace(" ", " # ")), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [True, False, False]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def toxic_by_hand(model, text):
    """The factorization machine's sum over all pairs."""
    on = [model.row[s] for s in toxicity.slots((text or "").encode()) if s in model.row]
    z = model.bias + sum(float(model.weights[i]) for i in on)
    z += sum(float(np.dot(model.factors[i], model.factors[j])) for k, i in enumerate(on) for j in on[:k])
    return z >= 0


def lines_by_hand(docs):
    """{doc_id: text} without recurring templates, by the query's SQL."""
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": list(docs), "text": pa.array(docs.values(), pa.string())}))
    return dict(c.sql(line_templates.SQL_TEXTS).fetchall())


def similar_by_hand(docs):
    """{doc_id: text} with the smallest id of each group of texts that have 80 % of their 5-word shingles in common."""
    words = {i: (t or "").translate({c: c + 32 for c in range(65, 91)}).split() for i, t in docs.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    root = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] < root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[b], changed = root[a], True
    return {i: t for i, t in docs.items() if root[i] == i}


def contaminated_by_hand(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    own = words(text)
    for item in map(words, items):
        k = min(len(item), 10)
        windows = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if item else set()
        if windows & {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}:
            return True
    return False


def test_pipeline_brute_force(spark):
    """run()'s rows on the smallest table against every stage by brute force."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    table = {r["doc_id"]: r for r in documents.collect()}
    model = toxicity.train(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    docs = {i: r["text"] for i, r in table.items() if not toxic_by_hand(model, r["text"])}
    docs = lines_by_hand(docs)
    root = components({i: simhash.fingerprint((t or "").encode()) for i, t in docs.items()})
    docs = similar_by_hand({i: t for i, t in docs.items() if root[i] == i})
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {i: t for i, t in docs.items() if not contaminated_by_hand(t, items)}
    assert 0 < len(docs) < len(table)
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": list(docs), "text": pa.array(docs.values(), pa.string()), "source": pa.array([table[i]["source"] for i in docs], pa.string())}))
    copies = dict(c.sql(mixing.SQL.replace("SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken", "SELECT doc_id, copies")).fetchall())
    want = Counter({(i, t, table[i]["lang"], table[i]["source"], None if t is None else len(t), len(WORD.findall(t or ""))): n for i, t in docs.items() if (n := copies[i])})
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "text", "lang", "source", "n_chars", "size").collect())
    assert got == want
