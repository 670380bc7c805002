"""Markdown: blocks, links and images, headings, code blocks, and the gate over them.

Blocks are cut by one token expression, links and images need the brackets that enclose them and
the file's link definitions, so a small reader goes over the texts that have brackets or fences, in
Arrow batches, a file at a time, and gives one row a file; all rules after it are columns and joins.
Not read: definitions inside quotes and lists, entities, emphasis, and indented code as such.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..functions.batches import read_rows
from ..sources.tables import ancestor_dirs
from .markup import _FILE, _fired
from .yaml_gates import breaks_off

_LINKS = "project string, path string, line array<int>, kind array<string>, target array<string>, has_text array<boolean>"
_ITEM = "struct<item:string,line:int,info:string,language:string,body:string,broken:boolean>"
_ITEMS = f"project string, path string, items array<{_ITEM}>, titles array<string>, marked array<string>"
#: About the characters that an entry of a list takes.
_ENTRY = 64

_TOKEN = re.compile(
    r" {0,3}(?P<fence>`{3,}|~{3,})[^\n]*(?:\n[\s\S]*?)??(?:\n {0,3}(?P=fence)[`~]*[ \t]*(?:\n|\Z)|\Z)|(?P<under>[ \t]*+[^\s][^\n]*+\n {0,3}(?:=+|-+)[ \t]*(?:\n|\Z))|[^\n]*+(?:\n|\Z)", re.A
)
_HEADING = re.compile(r" {0,3}#{1,6}[ \t]")
_INFO = re.compile(r" {0,3}[`~]+([^\n]*)")
_BODY = re.compile(r"[^\n]*\n([\s\S]*?)(?:\n? {0,3}(?:`{3,}|~{3,})\s*)?\Z", re.A)
_JSON, _JSON_LINES, _YAML = ("json",), ("ndjson", "jsonl", "ldjson"), ("yaml", "yml")


def _blocks(text: str) -> Iterator[tuple[int, str, str]]:
    """(line, kind, token): kind is fence, heading or line; together the tokens are the text."""
    line = 1
    for m in _TOKEN.finditer(text):
        token = m.group()
        yield line, "fence" if m["fence"] else "heading" if m["under"] or _HEADING.match(token) else "line", token
        line += token.count("\n")


def _fenced(text: str) -> bool:
    return "```" in text or "~~~" in text


def _prose(text: str) -> str:
    """The text with blank lines for its fences."""
    return "".join("\n" * t.count("\n") if kind == "fence" else t for _, kind, t in _blocks(text)) if _fenced(text) else text


#: A link's destination with parentheses nested twice, and what may stand behind `]`.
_BARE0 = r"(?:\\.|[^\s()\\])"
_BARE1 = rf"(?:{_BARE0}|\({_BARE0}*+\))"
_BARE = rf"(?!<)(?:{_BARE0}|\({_BARE1}*+\))*+"
_POINTED = r"<((?:\\.|[^<>\n\\])*+)>"
_TITLE = r"""(?:"(?:\\.|[^"\\])*+"|'(?:\\.|[^'\\])*+'|\((?:\\.|[^()\\])*+\))"""
_TAIL = re.compile(rf"\(\s*+(?:{_POINTED}|({_BARE}))(?:\s++{_TITLE})?\s*+\)", re.S)
_LABEL = re.compile(r"\[((?:\\.|[^\[\]\\])*+)\]", re.S)
_DEFINITION = re.compile(rf" {{0,3}}\[((?:\\.|[^\[\]\\])++)\]:\s*+(?:{_POINTED}|(\S++))(?:[ \t]++{_TITLE})?[ \t]*+(?:\n|\Z)", re.S)
_PLAIN = r"[^\\`<!\[\]]*+"
#: whole: a link or image that holds no other brackets, or one pair that may be text; short: brackets that hold none and that no other form can follow.
_INLINE = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<tick>`+)|<!--[\s\S]*?(?:-->|\Z)|<[A-Za-z/][^<>]*+>|"
    rf"(?P<whole>!?\[({_PLAIN})(?:\[({_PLAIN})\](?![(\[]){_PLAIN})?\]\(([^\s()<>\\]*+)\))|(?P<short>!?\[({_PLAIN})\](?![(\[]))|"
    r"(?P<open>!?\[)|(?P<close>\])|(?P<seen>[^\s\\`<!\[\]][^\\`<!\[\]]*+|\S)|\s+"
)
#: The whole form alone: its groups are the sign, the text, and of a pair in it the label and what follows, and the target.
_WHOLE = re.compile(rf"(!?)\[({_PLAIN})(?:\[({_PLAIN})\](?![(\[])({_PLAIN}))?\]\(([^\s()<>\\]*+)\)")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
#: Lines that begin a block of their own, and those that end one.
_BEGINS = re.compile(r"[ \t>]*(?:#{1,6}[ \t]|[-*+][ \t]|[0-9]{1,9}[.)][ \t])")
_ENDS = re.compile(r" {0,3}(?:#{1,6}[ \t].*|=+[ \t]*|-+[ \t]*)\n?\Z")


@lru_cache(4096)
def _label(raw: str) -> str:
    return " ".join(raw.split()).casefold()


def _paragraphs(text: str) -> Iterator[tuple[int, str]]:
    """(line, text) of stretches of lines that brackets don't reach across."""
    first, own = 1, []
    for number, line in enumerate(text.split("\n"), 1):
        line += "\n"
        if own and (not line.strip(" \t>\n") or _BEGINS.match(line) or _ENDS.match(own[-1])):
            yield first, "".join(own)
            own = []
        if line.strip():
            first, own = (first if own else number), [*own, line]
    if own:
        yield first, "".join(own)


def _without_definitions(text: str, defined: dict[str, str]) -> str:
    """The paragraph behind the link definitions that it begins with, which are blank then; the first of a label counts."""
    at = 0
    while m := _DEFINITION.match(text, at):
        pointed, bare = m.group(2), m.group(3)
        if not m.group(1).strip():
            break
        defined.setdefault(_label(m.group(1)), pointed if pointed is not None else bare)
        at = m.end()
    return "\n" * text.count("\n", 0, at) + text[at:]


def _inlines(first: int, text: str, defined: dict[str, str]) -> Iterator[tuple[int, str, str, bool]]:
    """(line, kind, target, has_text) of a paragraph's links and images, inner ones first.

    A stack of open brackets: a link takes the innermost one and shuts those around it, as links hold
    no links; an image leaves them open. Code, tags and comments bind tighter than brackets. The line is
    that of the bracket, or the paragraph's where there is no text in it.
    """
    open_: list[list] = []  # is an image, offset behind the bracket, its line, characters seen before it, may be a link, has brackets inside
    at, seen, line, counted = 0, 0, first, 0
    while at < len(text):
        m = _INLINE.match(text, at)
        begin, at, what = at, m.end(), m.lastgroup
        if what == "whole" and m[5] is not None and defined.get(_label(m[5])) is not None:
            what, at = "open", m.start(4)  # the pair in it is a link
        if what == "seen" or what == "escape":
            seen += 1
        elif what == "whole" or what == "short":
            inner = m[4] if what == "whole" else m[8]
            to, says, image = m[6] if what == "whole" else defined.get(_label(inner)), m[5] is not None or bool(inner.strip()), text[begin] == "!"
            seen += says
            if open_:
                open_[-1][5] = True
            if to is None:
                seen += 2
                continue
            line, counted = line + text.count("\n", counted, begin), begin
            yield line if says else first, "image" if image else "link", _ESCAPED.sub(r"\1", to) if "\\" in to else to, says
            if not image:
                for o in open_:
                    o[4] = o[0]
        elif what == "tick":
            shut = re.compile(rf"(?<!`){m['tick']}(?!`)").search(text, at)
            seen += 1
            at = shut.end() if shut else at
        elif what == "open":
            line, counted = line + text.count("\n", counted, begin), begin
            if open_:
                open_[-1][5] = True
            open_.append([text[begin] == "!", at, line, seen, True, False])
        elif what == "close" and open_:
            image, start, own, before, may, nested = open_.pop()
            behind, to, end = text[at : at + 1], None, at
            tail, label = _TAIL.match(text, at) if behind == "(" else None, _LABEL.match(text, at) if behind == "[" else None
            if tail:
                to, end = tail.group(1) if tail.group(1) is not None else tail.group(2), tail.end()
            elif label and label.group(1).strip():
                to, end = defined.get(_label(label.group(1))), label.end()
            elif not nested:
                to, end = defined.get(_label(text[start:begin])), label.end() if label else at
            if to is None or not (image or may):
                seen += 2
                continue
            yield own if seen > before else first, "image" if image else "link", _ESCAPED.sub(r"\1", to) if "\\" in to else to, seen > before
            at = end
            if not image:
                for o in open_:
                    o[4] = o[0]
        elif what == "close":
            seen += 1


def _simple_inlines(first: int, text: str, defined: dict[str, str]) -> list[tuple[int, str, str, bool]] | None:
    """_inlines of a paragraph whose brackets are all those of whole forms within a line, a line at a time; None if it has others."""
    if "\\" in text or "`" in text or "<" in text:
        return None
    out = []
    for line, own in enumerate(text.split("\n"), first):
        if "[" not in own:
            if "]" in own:
                return None
            continue
        pieces = _WHOLE.split(own)
        rest, says, inner = "".join(pieces[::6]), pieces[2::6], pieces[3::6]
        if "[" in rest or "]" in rest or any(i is not None and _label(i) in defined for i in set(inner)):
            return None
        has = [i is not None or bool(t.strip()) for t, i in zip(says, inner, strict=True)]
        kinds = ["image" if sign else "link" for sign in pieces[1::6]]
        out += zip([line if h else first for h in has], kinds, pieces[5::6], has, strict=True)
    return out


def _links(prose: str) -> list[tuple[int, str, str, bool]]:
    """_inlines of all paragraphs."""
    defined: dict[str, str] = {}
    own = [(line, _without_definitions(p, defined)) for line, p in _paragraphs(prose)]
    out = []
    for line, p in own:
        if "[" in p:
            simple = _simple_inlines(line, p, defined)
            out += _inlines(line, p, defined) if simple is None else simple
    return out


def _texts(files: DataFrame) -> list[Column]:
    return [*[F.col(c).cast("string") for c in _FILE], F.replace("text", F.lit("\r\n"), F.lit("\n"))]


def md_links(files: DataFrame) -> DataFrame:
    """(project, path, line, kind, target, has_text) of the links and images of Markdown files.

    Inline, full, collapsed and short forms, with nested brackets; a form whose label the file doesn't
    define is text. kind is link or image. Fenced code is left out. Null and empty texts have none.
    """

    def read(project: str, path: str, text: str | None) -> Iterator[tuple]:
        found = _links(_prose(text)) if text and "[" in text else None
        if found:
            yield project, path, *zip(*found, strict=True)

    # lists of values are far cheaper to hand over than a list of structs
    found = read_rows(files, _texts(files), read, _LINKS, lambda row: _ENTRY * len(row[2]))
    return found.select(*_FILE, F.inline(F.arrays_zip("line", "kind", "target", "has_text")))


def _items(text: str) -> tuple[list[tuple], list[str], list[str]]:
    """(items, titles, marked) of a file: images without a text, links to its anchors, fences; and where it has such links,
    the first lines of its headings and the pieces outside fences that may hold a tag."""
    blocks = list(_blocks(text)) if _fenced(text) else None
    items = []
    for line, kind, to, has_text in _links(_prose(text)) if "[" in text else ():
        if kind == "image" and not has_text:
            items.append(("image", line, None, None, None, None))
        elif kind == "link" and to.startswith("#"):
            items.append(("anchor", line, to, None, None, None))
    titles, marked = [], []
    if any(i[0] == "anchor" for i in items):
        blocks = blocks or list(_blocks(text))
        titles = [t.split("\n", 1)[0] for _, kind, t in blocks if kind == "heading"]
        marked = [t for _, kind, t in blocks if kind != "fence" and "<" in t]
    for line, kind, token in blocks or ():
        if kind == "fence":
            info, body = _INFO.match(token).group(1).strip(" "), _BODY.match(token)
            body = body.group(1) if body else ""
            language = re.split(r"\s", info, maxsplit=1, flags=re.A)[0].lower()
            items.append(("fence", line, info, language, body if language in _JSON + _JSON_LINES else "", language in _YAML and breaks_off(body)))
    return items, titles, marked


def md_items(files: DataFrame) -> DataFrame:
    """(project, path, item, line, info, language, body, broken, known) of what rules inside a file need: one pass over the texts.

    item is image (without a text), anchor (a link to one, info: the link) or fence; known: the file's anchors. body: of
    JSON; broken: YAML whose first document doesn't parse.
    """

    def read(project: str, path: str, text: str | None) -> Iterator[tuple]:
        items, titles, marked = _items(text or "")
        if items:
            yield project, path, items, titles, marked

    weight = lambda row: sum(_ENTRY + len(i[4] or "") for i in row[2]) + sum(map(len, row[3])) + sum(map(len, row[4]))
    found = read_rows(files, _texts(files), read, _ITEMS, weight)
    title = lambda t: F.regexp_replace(F.regexp_extract(t, r"^ {0,3}(?:#{1,6}[ \t]+)?([^\n]*)", 1), r"\s+#+\s*\z", "")
    # Links give their text to a heading's slug, code spans theirs.
    plain = lambda t: F.regexp_replace(F.regexp_replace(title(t), r"!?\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])", "$1"), r"[*`]", "")
    code_out = lambda t: F.regexp_replace(t, r"`+[^`\n]*`+", "x")
    named = lambda t: F.regexp_extract_all(F.lower(code_out(t)), F.lit(r"""<[^>]*\b(?:id|name)\s*=\s*["']([^"']+)["']"""), F.lit(1))
    known = F.concat(F.transform("titles", lambda t: X.heading_slug(plain(t))), F.flatten(F.transform("marked", named)))
    return found.select(*_FILE, known.alias("known"), F.inline("items"))


def _resolved(folder: Column, target: Column) -> Column:
    """Path of a link's target with . and .. worked out; null if it leaves the project."""
    parts = F.filter(F.split(F.concat_ws("/", folder, target), "/"), lambda p: ~p.isin("", "."))
    step = lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.filter(parts, lambda p: F.lit(False)), step), "/")


def _bad_payload() -> Column:
    """Whether a fence's payload doesn't parse as the language that it names.

    JSON: one value, or an excerpt of an object or array; blocks with an ellipsis or comments are examples. ndjson: a
    value a line. YAML: the first document.
    """
    b, language = F.col("body"), F.col("language")
    shown = b.contains("...") | b.rlike(r"(?m)^\s*(?://|/\*|\*)")
    excerpt = b.rlike(r"\S") & (X.valid_json(F.concat(F.lit("{"), b, F.lit("}"))) | X.valid_json(F.concat(F.lit("["), b, F.lit("]"))))
    lines = F.filter(F.split(b, "\n"), lambda x: x.rlike(r"\S"))
    bad = F.when(language.isin(*_JSON), ~shown & ~X.valid_json(b) & ~excerpt).when(language.isin(*_JSON_LINES), F.exists(lines, lambda x: ~X.valid_json(F.trim(x))))
    return bad.otherwise(F.col("broken"))


def markdown_lint(files: DataFrame, enabled: tuple[str, ...] = (), existing: DataFrame | None = None) -> DataFrame:
    """image_no_alt, link_local_broken, link_anchor_broken, codeblock_invalid_payload (JSON, ndjson, YAML), and if enabled codeblock_no_language.

    existing: (project, path) of all files and folders that a link may lead to; by default those of files.
    """
    item = F.col("item")
    rules = {
        "image_no_alt": item == "image",
        "link_anchor_broken": (item == "anchor") & ~F.array_contains("known", F.lower(F.substr("info", F.lit(2)))),
        "codeblock_invalid_payload": (item == "fence") & _bad_payload(),
    }
    if "codeblock_no_language" in enabled:
        rules["codeblock_no_language"] = (item == "fence") & (F.col("info") == "") & ~P.is_changelog()
    inside = _fired(md_items(files), rules)

    links = md_links(files).where("kind = 'link'").select(*_FILE, "line", F.col("target").alias("to"))
    to = F.col("to")
    local = links.where(~to.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|[#~/]|[?#])")).withColumn("goal", F.regexp_extract("to", r"^([^?#]*)", 1)).where("goal <> ''")
    decoded = F.coalesce(F.try_url_decode(F.replace("goal", F.lit("+"), F.lit("%2B"))), F.col("goal"))
    local = local.withColumn("goal", decoded).withColumn("full", _resolved(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.col("goal")))
    tails = F.when(F.col("goal").rlike(r"\.[^/.]*\z"), F.array(F.lit(""))).otherwise(F.array(*[F.lit(x) for x in ("", ".md", ".markdown", "/index.md", "/index.markdown")]))
    there = (ancestor_dirs(files) if existing is None else existing).select("project", F.col("path").alias("full_path"))
    local = local.withColumn("link", F.struct("path", "line", "to"))
    tried = local.select("project", "link", F.explode(F.transform(tails, lambda x: F.ltrim(F.concat(F.coalesce("full", F.lit("\x00")), x), F.lit("/")))).alias("full_path"))
    # An empty path is the project's own folder.
    found = tried.where("full_path = ''").select("project", "link").unionByName(tried.join(there, ["project", "full_path"], "left_semi").select("project", "link")).distinct()
    broken = local.join(found, ["project", "link"], "left_anti").select(*_FILE, "line", F.lit("link_local_broken").alias("rule"))

    return inside.unionByName(broken)
