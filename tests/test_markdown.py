"""Links, definitions, payloads and the gate over Markdown."""

import time

import duckdb
import pytest

from quarry.operators import markdown as D
from quarry.plans import markup_queries as Q

SF = "/root/testdata/sf0.001"


def files(spark, *texts):
    return spark.createDataFrame([("p", f"d/f{k}.md", t) for k, t in enumerate(texts)], "project string, path string, text string")


def found(text):
    defined = {}
    own = [(line, D._without_definitions(p, defined)) for line, p in D._paragraphs(text)]
    return [r for line, p in own for r in D._inlines(line, p, defined)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[a [b] c](x.md)", [(1, "link", "x.md", True)]),
        ("[![alt](i.png)](t.md)", [(1, "image", "i.png", True), (1, "link", "t.md", True)]),
        ("[a [in](l1) b](l2)", [(1, "link", "l1", True)]),
        ("[x](a_(b).md) [y](<p q.md> \"t\") [z](u v)", [(1, "link", "a_(b).md", True), (1, "link", "p q.md", True)]),
        ("`[c](d)` \\[e](f) [g\\]h](i) <!-- [k](l) -->", [(1, "link", "i", True)]),
        ("[t][Ref] [ref][] [ref] [no][nope] [nope]\n\n[ref]: a.md 'T'\n[REF]: second.md\n", [(1, "link", "a.md", True)] * 3),
        ("text\n[a]: b\n[a]", []),
        ("- [ ] task\n- [i](j)\n", [(2, "link", "j", True)]),
        ("para\n![](x.png) [l](y)\n![a\nb](z)", [(1, "image", "x.png", False), (2, "link", "y", True), (3, "image", "z", True)]),
        ("", []),
    ],
)
def test_links(text, want):
    assert found(text) == want


def test_long_lines_in_linear_time():
    begin = time.time()
    for text in ("[" * 100_000 + "]" * 100_000, "[a](b " * 50_000, "](a" * 100_000, "![" * 50_000 + "](x)" * 50_000, "[a](b) " * 50_000):
        found(text)
    assert time.time() - begin < 30


def test_gate_follows_definitions_and_nested_brackets(spark):
    f = files(
        spark,
        "# Top\n\n[x [y]](f1.md) [gone][r] ![ ][r] [ok]\n\n[![logo](i.png)](missing.md)\n[up][none]\n\n[r]: nowhere.md\n[ok]: #top\n[bad]: #nope\n\n[bad]\n",
        None,
        "```\n[a](gone.md)\n```\n~~~md\n[r]: x.md\n~~~\n[r]\n",
    )
    got = sorted((r["path"], r["line"], r["rule"]) for r in D.markdown_lint(f).collect())
    assert got == [("d/f0.md", 3, "image_no_alt"), ("d/f0.md", 3, "link_local_broken"), ("d/f0.md", 5, "link_local_broken"), ("d/f0.md", 12, "link_anchor_broken")]


@pytest.mark.parametrize(
    ("language", "body", "bad"),
    [
        ("json", '{"a": 1,}', True), ("json", '{"u": "http://x.io", "a" 1}', True), ("json", '"a": 1', False), ("json", '{\n  // why\n  "a": 1,\n}', False), ("json", '{"a": ...}', False), ("json", "", True),
        ("jsonc", '{"a": 1,}', False), ("ndjson", '{"a": 1}\n\n [2] \n', False), ("jsonl", '{"a": 1}\n{"b": }', True), ("ldjson", "", False),
        ("yaml", "a: 1\nb:\n  - x\n", False), ("yml", "a: [1, 2\n", True), ("YAML", "a: b: c\n", True), ("yaml", "k: 1\nk: 2\n", False), ("yaml", "a: 1\n---\nb: [\n", False), ("sh", "{", False),
    ],
)
def test_payloads(spark, language, body, bad):
    got = D.markdown_lint(files(spark, f"Say\n\n```{language}\n{body}\n```\n")).collect()
    assert [(r["line"], r["rule"]) for r in got] == ([(3, "codeblock_invalid_payload")] if bad else [])


@pytest.mark.parametrize("name", ["markdown_links", "markdown_lint"])
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = Q.QUERIES[name](spark, SF), c.sql(Q.SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_blocks_are_read_without_sorting_lines(spark):
    f = files(spark, "# A\n[x [y]](#a) [z](#b)\n```\nx\n```\n" + "line\n" * 1000)
    plan = D.markdown_lint(f, ("codeblock_no_language",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert sorted((r.line, r.rule) for r in D.markdown_lint(f, ("codeblock_no_language",)).collect()) == [(2, "link_anchor_broken"), (3, "codeblock_no_language")]


@pytest.mark.parametrize("text, want", [
    ("[a [x]](b.md)\n", [(1, "link", "b.md", True)]),
    ("[a [x]](b.md)\n\n[x]: c.md\n", [(1, "link", "c.md", True)]),
    ("![a ![x]](b.md) [ ](c)\n", [(1, "image", "b.md", True), (1, "link", "c", False)]),
    ("[![i](j.png)](k.md) [a [b](c)](d)\n", [(1, "image", "j.png", True), (1, "link", "k.md", True), (1, "link", "c", True)]),
])
def test_brackets_in_brackets(text, want):
    assert D._links(text) == want


def test_simple_paragraphs_equal_the_general_reader(spark):
    """a line's whole forms are read at once, with what the bracket stack gives; all else is left to the stack."""
    simple = "a [b [x]](c.md) ![](d.png) !![e](f)\n\t[ ](g) and [h\ti](j)[k [y] z](l)\nplain\n"
    assert D._simple_inlines(7, simple, {"z": "no"}) == list(D._inlines(7, simple, {"z": "no"})) != []
    for other in ("[a [x]](b)", "[a](b) [x]", "[a\nb](c)", "[a](b) ]", "[a](b\\)c)", "`[a](b)`", "<i>[a](b)", "[a!](b)"):
        assert D._simple_inlines(1, other, {"x": "to"}) is None
    both = D.md_links(spark.createDataFrame([("p", "q", simple + "\n[r](s) [w]\n\n[w]: t\n")], "project string, path string, text string"))
    got = [(r.line, r.kind, r.target, r.has_text) for r in both.select("line", "kind", "target", "has_text").collect()]
    assert got == [*D._inlines(1, simple, {}), (5, "link", "s", True), (5, "link", "t", True)]
