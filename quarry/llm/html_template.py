"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements, told apart by their path of tags and class names, and its
texts, told apart by their element. Tokens of a host that occur equally often in each of its
different pages (the same occurrence vector) form a class; vectors are compared by order-free
hashes, so no host's pages are ever gathered. Classes that cover nearly all of the host's
pages are valid. They nest by the elements that their tokens stand in, and together they
are the host's template: a tree of fixed elements with fixed texts. What a page has besides
fixed texts fills the template's slots, the fixed elements that hold it.

The main slot is found from the root of the tree down: into the element of a class that occurs once a
page, as long as one holds at least half of what varies below. Tags, roles and whole class
names that mean menus, headers, footers, sidebars, notices, adverts, forms or comments only
break ties: such elements are no main slot where another one varies, and are left out where
they stand in it. An element that the main slot stands in is not asked for its name. What stands
in boxes that repeat in a page, as reader comments do whatever their name, counts for little
in the choice.

Within the main slot fixed texts stay, such as headings that all articles of a host have; only
a box that holds nothing but fixed texts is left out.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import checkpointed, small_batches, text_bytes, without

#: A class is valid if it covers this share of the host's different pages, of which there are at least PAGES: a few pages may be near copies, whose texts repeat without being fixed.
PAGES, SHARE = 5, 0.9
#: What stands in boxes that repeat in a page counts with one part in so many for the choice of the main slot.
REPEATED = 16
#: The main slot is an element that holds this share of what varies in the element around it.
HOLDS = 0.5
#: Templates of up to so many texts in all are broadcast; larger ones are joined by shuffle.
BROADCAST_TEXTS = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is never shown as text.
HIDDEN = frozenset("head title script style textarea xmp iframe noembed noframes noscript template svg canvas math object audio video button select".split())
#: Elements that are parts of a text, so no slot.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary".split())
ASIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of class and id names that say what an element is for ...
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert disclaimer sidebar aside "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer comment comments reply replies disqus share sharing social related recommended newsletter subscribe signup discussion discussions responses feedback talkback "
    "login popup modal overlay widget widgets pagination pager toolbar search form copyright skip".split()
)
#: ... and words that may stand beside them. A name counts if all its words are of these two kinds.
BESIDE = frozenset("area bar block box button buttons card container content group inner item items link links list outer panel post posts section site page slot text thread top bottom left right unit wrap wrapper".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PART = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")
#: An open element of the key ends where one of these begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Bits of an element's kind.
BY_NAME, IN_TEXT, ARTICLE = 1, 2, 4


class Page:
    """Elements in page order, each with its token, the number of the element around it and its kind; texts with the number of theirs."""

    def __init__(self):
        self.token, self.parent, self.kind = [0], [-1], [0]
        self.texts: list[tuple[str, int]] = []


def _attributes(attrs: str) -> tuple[bool, str, str]:
    """(a class or id name says that this is no main text, role, sorted class names)."""
    if "=" not in attrs:
        return False, "", ""
    own: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        own.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    classes = own.get("class", "").split()
    named = False
    for name in [*classes, *own.get("id", "").split()]:
        words = {w.lower() for w in _PART.findall(name)}
        named = named or bool(words & NAMES) and words <= NAMES | BESIDE
    return named, own.get("role", "").strip().lower(), ".".join(sorted(classes))


def parse(html: str) -> Page:
    """Elements and texts of a page. Inline elements are part of the text that they stand in."""
    page, text, at = Page(), [], 0
    # (tag, number of the element or of the one around an inline element, hidden)
    stack: list[tuple[str, int, bool]] = [("", 0, False)]

    def flush():
        if text:
            s = " ".join(unescape("".join(text)).split())
            text.clear()
            if s and not stack[-1][2]:
                page.texts.append((s, stack[-1][1]))

    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        inline = tag in INLINE
        if tag == "br":
            text.append(" ")
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if not inline or any(x[0] not in INLINE for x in stack[i:]):
                        flush()
                    del stack[i:]
                    break
            else:
                if not inline:
                    flush()
            continue
        if not inline:
            flush()
            if tag != "hr":
                while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] in INLINE):
                    stack.pop()
                own = CLOSES.get(tag)
                if own:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] in own:
                            del stack[i:]
                            break
                        if stack[i][0] in ("ul", "ol", "dl", "table", "select"):
                            break
        if tag in VOID:
            continue
        _, around, hidden = stack[-1]
        hidden = hidden or tag in HIDDEN
        if inline:
            if not attrs.endswith("/"):
                stack.append((tag, around, hidden))
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if hidden:
            stack.append((tag, around, True))
            continue
        named, role, classes = _attributes(attrs)
        by_name = tag not in ("html", "body", "main", "article") and (named or tag in ASIDE or role in ROLES)
        page.token.append(_signed(xxh64_intdigest(f"{tag}.{classes}".encode("utf-8", "surrogatepass"), page.token[around] & (1 << 64) - 1)))
        page.parent.append(around)
        page.kind.append(BY_NAME * by_name | IN_TEXT * (tag in TEXTUAL) | ARTICLE * (tag == "article"))
        stack.append((tag, len(page.token) - 1, False))
    flush()
    return page


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def text_token(text: str, element: int) -> int:
    return _signed(xxh64_intdigest(b"\n" + text.encode("utf-8", "surrogatepass"), element & (1 << 64) - 1))


def tokens(page: Page) -> dict[int, tuple[int, int, int, int, int]]:
    """token -> (token of the element that it stands in, kind or -1 for a text, occurrences, characters in and below it, those that count for a slot).

    Characters of an element are those of the texts below it; the last number leaves out what
    stands in elements that are no main text by name, and most of what stands in boxes that
    repeat in the page (below the element itself).
    """
    n = len(page.token)
    below, clean = [0] * n, [0] * n
    out: dict[int, tuple] = {}
    for s, e in page.texts:
        below[e] += len(s)
        clean[e] += len(s)
        t = text_token(s, page.token[e])
        out[t] = (page.token[e], -1, out.get(t, (0, 0, 0))[2] + 1, len(s), len(s))
    often: dict[int, int] = {}
    for t in page.token:
        often[t] = often.get(t, 0) + 1
    for e in range(n - 1, 0, -1):  # an element comes after the one around it
        p = page.parent[e]
        below[p] += below[e]
        if not page.kind[e] & BY_NAME:
            box = often[page.token[e]] > 1 and not page.kind[e] & (IN_TEXT | ARTICLE)
            clean[p] += clean[e] // REPEATED if box else clean[e]
    for e in range(n):
        t, old = page.token[e], out.get(page.token[e], (0, 0, 0, 0, 0))
        out[t] = (page.token[page.parent[e]] if e else 0, page.kind[e], old[2] + 1, old[3] + below[e], old[4] + clean[e])
    return out


def main_slot(own: list[tuple[int, int, int, int, int, int, int]]) -> int:
    """Token of the main slot of a template, a list of (token, parent, kind, covered, times, below, clean) of its elements and texts.

    below and clean are characters over all pages, from which those of the fixed texts are taken.
    """
    parent = {t: p for t, p, *_ in own}
    kind = {t: k for t, _, k, *_ in own if k >= 0}
    once = {t: c == n for t, _, k, c, n, *_ in own if k >= 0}
    varies = {t: b for t, _, k, _, _, b, _ in own if k >= 0}
    clean = {t: c for t, _, k, *_, c in own if k >= 0}
    for t, p, k, _, n, b, _ in own:
        if k >= 0:
            continue
        named, at, seen = False, p, set()
        while at in kind and at not in seen:  # a fixed text varies in none of the elements around it
            seen.add(at)
            varies[at] -= b
            if not named:
                clean[at] -= b
            named = named or bool(kind[at] & BY_NAME)
            at = parent.get(at, 0) if at else -1
    children: dict[int, list] = {}
    for t in kind:
        if t:
            children.setdefault(parent[t], []).append(t)
    # where nothing varies but in elements by name, these are asked too
    mass = clean if clean.get(0, 0) > 0 else varies
    at = 0
    while True:
        inner = [t for t in children.get(at, ()) if not kind[t] & IN_TEXT and (once[t] or kind[t] & ARTICLE) and (mass is varies or not kind[t] & BY_NAME)]
        best = max(inner, key=lambda t: (mass[t], t), default=None)
        if best is None or mass[best] <= 0 or mass[best] < HOLDS * mass[at]:
            return at
        at = best


def main_text(page: Page, slot: int | None, fixed: frozenset) -> str:
    """Text of the main slot, less boxes of fixed texts only and elements that are no main text by name.

    A box is an element in the slot that is no part of a text (TEXTUAL).

    slot None, or one that the page lacks: the slot of the page as a template of its own. Of several articles
    in one place the longest is the main one.
    """
    if slot is None or slot not in page.token:
        slot = main_slot([(t, p, k, 1, n, b, c) for t, (p, k, n, b, c) in tokens(page).items() if k >= 0])
    n = len(page.token)
    root, out = [-1] * n, [False] * n
    varies = [False] * n  # a text in or below it isn't fixed
    for s, e in page.texts:
        if fixed and text_token(s, page.token[e]) not in fixed:
            varies[e] = True
    for e in range(n - 1, 0, -1):
        varies[page.parent[e]] |= varies[e]
    for e in range(n):
        if root[page.parent[e]] >= 0 and e:
            p = page.parent[e]
            box = bool(fixed) and not varies[e] and not page.kind[e] & IN_TEXT
            root[e], out[e] = root[p], out[p] or bool(page.kind[e] & BY_NAME) or box
        elif page.token[e] == slot:
            root[e] = e
    own = [(s, root[e]) for s, e in page.texts if root[e] >= 0 and not out[e]]
    if own and page.kind[own[0][1]] & ARTICLE:
        size: dict[int, int] = {}
        for s, r in own:
            size[r] = size.get(r, 0) + len(s)
        chief = max(size, key=lambda r: (size[r], -r))
        own = [x for x in own if x[1] == chief]
    return "\n".join(s for s, _ in own)


def host_key(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


_TOKENS = {"token": "long", "parent": "long", "kind": "int", "times": "int", "below": "long", "clean": "long"}


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, page, token, parent, kind, times, below, clean): a row for each distinct token of each different page."""
    schema = T.ArrayType(T.StructType([T.StructField(n, T.LongType() if k == "long" else T.IntegerType()) for n, k in _TOKENS.items()]))

    def of(htmls):
        import numpy as np
        import pyarrow as pa

        columns, ends = [[] for _ in _TOKENS], [0]
        for h in text_bytes(htmls):
            found = tokens(parse(h.decode() if h else ""))
            for c, values in zip(columns, (found, *zip(*found.values()))):
                c.extend(values)
            ends.append(len(columns[0]))
        arrays = [pa.array(c, type=pa.int64() if k == "long" else pa.int32()) for c, k in zip(columns, _TOKENS.values())]
        return pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.StructArray.from_arrays(arrays, names=list(_TOKENS)))

    # nondeterministic: else the parse runs once more for a filter on its size
    parsed = F.arrow_udf(of, schema).asNondeterministic()(F.col("html"))
    each = pages.select(host_key(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), parsed.alias("t")).select("host", "page", F.explode("t").alias("t")).select("host", "page", "t.*")
    # copies of a page are one page
    return each.groupBy("host", "page", "token").agg(*[F.max(c).alias(c) for c in _TOKENS if c != "token"])


def templates(pages: DataFrame, least: int = PAGES, share: float = SHARE) -> DataFrame:
    """(host, class, parent_class, token, parent, kind, covered, times, below, clean): the tokens of each host's valid classes.

    The occurrence vector of a token is hashed as the sum over pages of a hash of (page,
    occurrences): equal vectors have equal sums, whatever the order of the pages.
    """
    part = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "page", "times"), F.lit(1 << 31)))
    sums = [F.sum(c).alias(c) for c in ("times", "below", "clean")]
    vectors = page_tokens(pages).groupBy("host", "token").agg(F.max("parent").alias("parent"), F.max("kind").alias("kind"), F.count("*").alias("covered"), part(1).alias("v1"), part(2).alias("v2"), *sums)
    # every page has the root, token 0, once
    sizes = pages.groupBy(host_key(F.col("url")).alias("_host")).agg(F.count_distinct(F.xxhash64("html")).alias("pages")).where(F.col("pages") >= least)
    # small by construction: a page has on average at most 1 / share times as many tokens as its template
    valid = vectors.join(sizes, F.col("host") == F.col("_host")).where(F.col("covered") >= share * F.col("pages"))
    valid = checkpointed(valid.withColumn("class", F.xxhash64("covered", "v1", "v2")).select("host", "class", "token", "parent", "kind", "covered", "times", "below", "clean"))
    above = valid.where("kind >= 0").select("host", F.col("token").alias("parent"), F.col("class").alias("parent_class"))
    return valid.join(above, ["host", "parent"], "left").select("host", "class", "parent_class", "token", "parent", "kind", "covered", "times", "below", "clean")


def slots(template: DataFrame) -> DataFrame:
    """(host, slot, fixed): the main slot of each host's template and its fixed texts, from a tree of at most a page's tokens / SHARE."""

    def own(key, table):
        import pandas as pd

        names = ["token", "parent", "kind", "covered", "times", "below", "clean"]
        rows = list(zip(*(table[n].tolist() for n in names)))
        return pd.DataFrame({"host": [key[0]], "slot": [main_slot(rows)], "fixed": [sorted(r[0] for r in rows if r[2] < 0)]})

    return template.groupBy("host").applyInPandas(own, "host string, slot long, fixed array<long>")


def extract_main_text(pages: DataFrame, template: DataFrame | None = None) -> DataFrame:
    """pages with text and n_chars.

    template: of `templates()`, made from all of pages if not given. Null html is an empty
    page; a null url, or one without a host, is of the host without a name. Copies of a page
    are one page of their host. A host with fewer than PAGES different pages has no template:
    there the page's own elements decide. Of slots with equally much text the one with the
    larger token hash is taken, of articles the first. Very long pages are read whole. Repeated rows are extracted
    alike and stay; an empty table gives an empty one; input columns named like the added
    ones are replaced.
    """
    pages = without(pages, "text", "n_chars", "slot", "fixed", "_host", "_of_host", "_text")
    small_batches(pages.sparkSession)
    if template is None:
        template = templates(pages)
    found = checkpointed(slots(template))
    n = found.agg(F.coalesce(F.sum(F.size("fixed") + 1), F.lit(0))).first()[0]
    own = pages.withColumn("_host", host_key(F.col("url")))
    if n <= BROADCAST_TEXTS:
        known = pages.sparkSession.sparkContext.broadcast({r["host"]: (r["slot"], frozenset(r["fixed"])) for r in found.collect()})

        def of(htmls, hosts):
            import pyarrow as pa

            return pa.array([main_text(parse(h.decode() if h else ""), *known.value.get(k, (None, frozenset()))) for h, k in zip(text_bytes(htmls), hosts.to_pylist())], type=pa.string())

        text = F.arrow_udf(of, T.StringType()).asNondeterministic()(F.col("html"), F.col("_host"))
    else:
        own = own.join(found.withColumnRenamed("host", "_of_host"), F.col("_host") == F.col("_of_host"), "left")

        def with_template(htmls, slot, fixed):
            import pyarrow as pa

            out = []
            for k, h in enumerate(text_bytes(htmls)):  # one page's fixed texts at a time
                out.append(main_text(parse(h.decode() if h else ""), slot[k].as_py(), frozenset(fixed[k].as_py() or ())))
            return pa.array(out, type=pa.string())

        text = F.arrow_udf(with_template, T.StringType()).asNondeterministic()(F.col("html"), F.col("slot"), F.col("fixed"))
    own = own.withColumn("_text", text)
    return own.select(*pages.columns, F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
