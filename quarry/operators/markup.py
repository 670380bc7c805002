"""Gates over files with a grammar: Dockerfiles, HTML, stylesheets.

files: (project, path, text), one row a path. Texts of HTML and stylesheets are cut into tokens by one regular
expression that covers every character; Dockerfiles are read by line, once; line numbers, nesting and state are windows over the
tokens of a file, whose size the text cap of the sources bounds. Null and empty texts have
no findings. Every lint returns (project, path, line, rule).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.batches import read_rows

_FILE = ["project", "path"]


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _ordered(*more: str):
    return W.partitionBy(*_FILE, *more).orderBy("pos")


def tokens(files: DataFrame, pattern: str) -> DataFrame:
    """(project, path, pos, token, line): all matches in order; line is 1-based, where the token starts."""
    text = F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n"))
    each = files.select(*_FILE, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("pos", "token"))
    before = _ordered().rowsBetween(W.unboundedPreceding, -1)
    return each.withColumn("line", (F.coalesce(F.sum(_newlines(F.col("token"))).over(before), F.lit(0)) + 1).cast("int"))


def _fired(df: DataFrame, rules: dict[str, Column], line: str = "line", more: tuple[str, ...] = ()) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    return df.select(*_FILE, F.col(line).cast("int").alias("line"), *more, F.explode(hits).alias("rule"))


# Dockerfiles

_OVERRIDE = "struct<ids:array<string>,reason:string,o_line:int>"


def _override(comment: Column, line: Column) -> Column:
    """What stands behind `ignore` in a comment, as an override; null if it names no rule."""
    ids = F.filter(F.transform(F.split(F.split(comment, "reason:")[0], ","), lambda x: F.trim(x)), lambda x: x != "")
    reason = F.trim(F.regexp_extract(comment, "(?s)reason:(.*)", 1))
    return F.when(F.size(ids) > 0, F.struct(ids.alias("ids"), reason.alias("reason"), line.cast("int").alias("o_line")))


_FOLDS = re.compile(r"\\[ \t]*\Z")
_HERE = re.compile(r"<<-?\s*[\"']?([A-Za-z_][A-Za-z0-9_]*)[\"']?", re.A)
_SPACE = " \t\n\x0b\f\r"
_INSTRUCTIONS = f"project string, path string, pos int, line int, end_line int, kind string, args string, override {_OVERRIDE}"


def _said(comment: str, number: int) -> dict | None:
    """_override of a comment's text."""
    ids = [x for x in (i.strip(" ") for i in comment.split("reason:", 1)[0].split(",")) if x]
    return {"ids": ids, "reason": comment.partition("reason:")[2].strip(" "), "o_line": number} if ids else None


def _instructions(text: str, ignore: re.Pattern) -> Iterator[tuple[int, int, str, str, dict | None]]:
    """(line, end_line, kind, args, override) of the instructions of a Dockerfile."""
    lines = text.replace("\r\n", "\n").split("\n")
    pending, parts, begun = None, [], 0  # the pieces so far of an instruction that goes on, and its first line
    open_: list[str] = []  # ends of the here-documents that are open
    for number, line in enumerate(lines, 1):
        own = line.strip(_SPACE)
        if open_:
            if own in open_:
                open_.remove(own)
            continue
        if not parts:
            if not own:
                pending = None
                continue
            if own[0] == "#":
                said = ignore.match(own)
                pending = (_said(said.group(1), number) if said else None) or pending
                continue
            begun = number
        piece = own if parts else line
        if piece.rstrip(" \t").endswith("\\"):
            parts.append(piece.rstrip(" \t")[:-1])
            continue
        whole = " ".join([*parts, piece])
        if not piece and (folds := _FOLDS.search(whole)):  # a blank line behind two backslashes
            parts = [whole[: folds.start()]]
            continue
        whole = whole.strip(_SPACE)
        if whole:
            yield begun, number, *_split(whole), pending
        parts, pending = [], None
        open_ = _HERE.findall(whole) if "<<" in whole else []
    if parts and (whole := _FOLDS.sub("", " ".join([*parts, ""])).strip(_SPACE)):  # the text's end ends it
        yield begun, len(lines), *_split(whole), pending


def _split(whole: str) -> tuple[str, str]:
    """Kind and arguments of an instruction."""
    m = _KIND.match(whole)
    return m.group(1).upper(), (m.group(2) or "").strip(_SPACE)


_KIND = re.compile(r"([^ \t]+)(?:[ \t](.*))?\Z", re.S)


def docker_instructions(files: DataFrame, marker: str = "quarry", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(project, path, pos, line, end_line, kind, args, override): continued lines folded, comments and blank lines dropped,
    the bodies of here-documents, of which an instruction may open several, kept out.

    override is that of the last comment `# marker: ignore id[, id] [reason: text]` right above: other comments may stand
    between, but a blank line or another instruction ends it. kinds: give these only; pos counts all. A small reader goes
    over a file's lines once, in Arrow batches.
    """
    ignore = re.compile(rf"#\s*{marker}:\s*ignore\s+(.*)\Z", re.S | re.A)

    def read(project: str, path: str, text: str) -> Iterator[tuple]:
        for pos, (line, end, kind, args, over) in enumerate(_instructions(text, ignore)):
            if kinds is None or kind in kinds:
                yield project, path, pos, line, end, kind, args, over

    own = files.where(F.col("text").isNotNull())
    return read_rows(own, [*[F.col(c).cast("string") for c in _FILE], "text"], read, _INSTRUCTIONS, lambda row: len(row[6]))


def dockerfile_findings(files: DataFrame) -> DataFrame:
    """dockerfile_lint's findings with reason and override_severity (see apply_overrides) of the override of their instruction."""
    before, so_far = _ordered("stage").rowsBetween(W.unboundedPreceding, -1), _ordered().rowsBetween(W.unboundedPreceding, 0)
    kind, start = F.col("kind"), F.col("kind").isin("CMD", "ENTRYPOINT")
    words = F.filter(F.split("args", r"\s+"), lambda w: ~w.startswith("--platform="))
    own = docker_instructions(files, kinds=("FROM", "CMD", "ENTRYPOINT", "USER", "ADD")).withColumn("stage", F.sum((kind == "FROM").cast("int")).over(so_far))
    own = own.withColumn("image", F.when(kind == "FROM", F.get(words, F.lit(0))))
    own = own.withColumn("alias", F.when(kind == "FROM", F.nullif(F.lower(F.regexp_extract("args", r"(?i)\sas\s+(\S+)", 1)), F.lit(""))))
    own = own.withColumn("aliases", F.collect_set("alias").over(W.partitionBy(*_FILE)))
    own = own.withColumn("done", F.coalesce(F.max((start | (kind == "USER")).cast("int")).over(before), F.lit(0)))
    tag = F.regexp_extract(F.split("image", "@")[0], r":([^:]*)\z", 1)
    user = F.regexp_extract("args", r"^([^:]*)", 1)
    fired = _fired(own, {
        "from_untagged": (kind == "FROM") & ~F.col("image").contains(":") & ~F.array_contains("aliases", F.lower("image")),
        "from_latest": (kind == "FROM") & (tag == "latest"),
        "add_instruction": kind == "ADD",
        "missing_user": start & (F.col("stage") > 0) & (F.col("done") == 0),
        "user_root": (kind == "USER") & user.isin("root", "0"),
    }, more=("override",))
    meant = F.array_contains("override.ids", F.col("rule")) | F.array_contains("override.ids", "*")
    reason = F.when(meant, F.col("override.reason"))
    return fired.select(*_FILE, "line", "rule", reason.alias("reason"), F.when(reason.isNotNull(), F.when(reason == "", "warning").otherwise("info")).alias("override_severity"))


def dockerfile_lint(files: DataFrame) -> DataFrame:
    """from_untagged, from_latest, add_instruction, missing_user (first CMD or ENTRYPOINT of a stage), user_root."""
    return dockerfile_findings(files).select(*_FILE, "line", "rule")


# HTML

_ATTRIBUTES = r"""[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+"""
HTML_TOKEN = rf"<!--[\s\S]*?-->|(?i:<(script|style|textarea|title)\b{_ATTRIBUTES}>[\s\S]*?</\1\s*>)|</?[a-zA-Z]{_ATTRIBUTES}>|[^<]+|<"


def html_tokens(files: DataFrame) -> DataFrame:
    """(project, path, pos, line, kind, tag, token): kind is start, end, text or other (comments, and elements of raw text)."""
    t = F.col("token")
    raw = t.rlike(r"(?i)^<(?:script|style|textarea|title)\b")
    kind = F.when(t.startswith("<!--") | raw, "other").when(t.rlike("^</[a-zA-Z]"), "end").when(t.rlike("^<[a-zA-Z]"), "start").otherwise("text")
    return tokens(files, HTML_TOKEN).select(*_FILE, "pos", "line", kind.alias("kind"), F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1)).alias("tag"), "token")


def attribute(name: str) -> Column:
    """The value of an attribute of a start tag; empty if it has none, null without the attribute."""
    has = F.col("token").rlike(rf"(?i)[\s\"']{name}(?=[\s=/>])")
    value = F.regexp_extract("token", rf"""(?i)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    return F.when(has, F.regexp_replace(F.regexp_extract(value, r"(?s)=\s*(.*)\z", 1), r"""^["']|["']\z""", ""))


def _within(tags: Column) -> Column:
    """Nesting depth in these elements after each token; surplus end tags count nothing."""
    so_far = _ordered().rowsBetween(W.unboundedPreceding, 0)
    return F.sum(F.when(tags & (F.col("kind") == "start"), 1).when(tags & (F.col("kind") == "end"), -1).otherwise(0)).over(so_far)


def _clamped(depth: str) -> Column:
    return F.col(depth) - F.least(F.lit(0), F.min(depth).over(_ordered().rowsBetween(W.unboundedPreceding, 0)))


def html_lint(files: DataFrame) -> DataFrame:
    """viewport_no_zoom, autoplay_with_sound, target_blank_no_rel, reset_button, placeholder_as_label, mystery_meat_nav.

    A text belongs to the innermost open link or button; one never closed ends with the file.
    """
    tag, start = F.col("tag"), F.col("kind") == "start"
    nav = tag.isin("a", "button")
    some = lambda n: F.coalesce(F.trim(attribute(n)) != "", F.lit(False))
    all_ = html_tokens(files).withColumn("in_label", _within(tag == "label")).withColumn("in_nav", _within(nav))
    all_ = all_.withColumn("in_label", _clamped("in_label")).withColumn("in_nav", _clamped("in_nav"))

    content = F.lower(F.regexp_replace(F.coalesce(attribute("content"), F.lit("")), r"\s", ""))
    rel = F.split(F.lower(F.coalesce(attribute("rel"), F.lit(""))), r"\s+")
    named = all_.where(start).withColumn("id", attribute("id"))
    single = _fired(named, {
        "viewport_no_zoom": (tag == "meta") & (F.lower(attribute("name")) == "viewport") & (content.rlike("user-scalable=(?:no|0)") | content.contains("maximum-scale=1")),
        "autoplay_with_sound": (tag == "video") & attribute("autoplay").isNotNull() & attribute("muted").isNull(),
        "target_blank_no_rel": (tag == "a") & (F.lower(attribute("target")) == "_blank") & ~F.arrays_overlap(rel, F.array(F.lit("noopener"), F.lit("noreferrer"))),
        "reset_button": tag.isin("input", "button") & (F.lower(attribute("type")) == "reset"),
    })

    labels = named.where((tag == "label") & some("for")).select(*_FILE, attribute("for").alias("id")).distinct()
    bare = named.where((tag == "input") & some("placeholder") & ~some("aria-label") & ~some("aria-labelledby") & (F.col("in_label") == 0))
    bare = bare.join(labels, [*_FILE, "id"], "left_anti").select(*_FILE, "line", F.lit("placeholder_as_label").alias("rule"))

    # Tokens of one depth in links and buttons, in order: each follows the start tag that it belongs to.
    opened = F.last(F.when(nav & start, F.col("pos")), ignorenulls=True).over(_ordered("in_nav").rowsBetween(W.unboundedPreceding, 0))
    says = ((F.col("kind") == "text") & F.col("token").rlike(r"\S")) | ((tag == "img") & start & some("alt")) | (nav & start & (some("aria-label") | some("aria-labelledby") | some("title")))
    element = all_.where("in_nav > 0").withColumn("element", opened).groupBy(*_FILE, "element").agg(F.min(F.when(F.col("pos") == F.col("element"), F.col("line"))).alias("line"), F.max(says).alias("says"))
    mute = element.where("not says and line is not null").select(*_FILE, "line", F.lit("mystery_meat_nav").alias("rule"))
    return single.unionByName(bare).unionByName(mute)


# Stylesheets

CSS_TOKEN = r"/\*[\s\S]*?\*/|//[^\n]*|[{}]|[^{}/]+|/"


def css_blocks(files: DataFrame) -> DataFrame:
    """(project, path, block, selector, line, body): top-level blocks, nested ones inside their body;
    line is that of the opening brace. Comments are blank."""
    t, so_far = F.col("token"), _ordered().rowsBetween(W.unboundedPreceding, 0)
    comment = t.rlike(r"^/[*/]")
    all_ = tokens(files, CSS_TOKEN).withColumn("piece", F.when(comment, F.regexp_replace("token", r"[^\n]", " ")).otherwise(t))
    all_ = all_.withColumn("depth", F.sum(F.when(t == "{", 1).when(t == "}", -1).otherwise(0)).over(so_far)).withColumn("depth", _clamped("depth"))
    outer = (t == "}") & (F.col("depth") == 0)
    opens = (t == "{") & (F.col("depth") == 1)
    all_ = all_.withColumn("block", F.coalesce(F.sum(outer.cast("int")).over(_ordered().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    pieces = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "piece")))), lambda x: x["piece"]), "")
    out = all_.groupBy(*_FILE, "block").agg(F.trim(pieces(F.col("depth") == 0)).alias("selector"), F.min(F.when(opens, F.col("line"))).alias("line"), pieces((F.col("depth") > 0) & ~opens).alias("body"))
    return out.where("line is not null").withColumn("selector", F.lower(F.regexp_replace("selector", r"^[\s}]+|[\s}]+\z", "")))


def css_declarations(blocks: DataFrame) -> DataFrame:
    """(…, property, value, line) of each line of a body that holds one declaration."""
    lines = blocks.select(*_FILE, "block", "selector", "line", F.posexplode(F.split(F.lower("body"), "\n", -1)).alias("at", "code"))
    value = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("code", r":(.*)\z", 1), r";?\s*\z", ""), r"!important\s*\z", ""))
    own = lines.select(*_FILE, "block", "selector", (F.col("line") + F.col("at")).alias("line"), F.trim(F.regexp_extract("code", "^([^:]+):", 1)).alias("property"), value.alias("value"), "code")
    return own.where("property <> ''")


def css_lint(files: DataFrame) -> DataFrame:
    """hidden_scrollbar, thin_font_weight, justified_text: the first line of each block that breaks a rule."""
    s, d = F.col("selector"), css_declarations(css_blocks(files))
    is_ = lambda p, v: (F.col("property") == p) & (F.col("value") == v)
    weight = F.regexp_extract("code", r"font-weight\s*:\s*([0-9]+)", 1)
    body_text = F.exists(F.split(s, ","), lambda x: F.trim(x).rlike(r"^(?:body|html|p|article|main)(?:[.:\[# ]|\z)"))
    print_or_part = (s.contains("@media") & s.contains("print")) | s.rlike("^(?:@mixin|@include|@function|%)")
    line = F.col("line")
    first = d.groupBy(*_FILE, "block", "selector").agg(
        F.coalesce(F.min(F.when(is_("display", "none"), line)), F.min(F.when(is_("width", "0"), line))).alias("hidden"),
        F.min(F.when(weight != "", F.struct("line", weight.alias("weight")))).alias("thin"),
        F.min(F.when(is_("text-align", "justify"), line)).alias("justified"),
    )
    part = lambda rule, at, when: first.where(when & at.isNotNull()).select(*_FILE, at.cast("int").alias("line"), F.lit(rule).alias("rule"))
    thin = part("thin_font_weight", F.col("thin.line"), body_text & F.col("thin.weight").isin("100", "200"))
    return part("hidden_scrollbar", F.col("hidden"), s.contains("::-webkit-scrollbar")).unionByName(thin).unionByName(part("justified_text", F.col("justified"), ~print_or_part))


# Inline overrides


def overrides(files: DataFrame, marker: str = "quarry", inline: bool = False) -> DataFrame:
    """(project, path, o_line, ids, reason) of comments `# marker: ignore id[, id] [reason: text]`, also in <!-- --> and /* */.

    Without ids a comment overrides nothing; * stands for all rules. inline: the comment may stand behind other text, as in
    YAML, at the line's first #.
    """
    lead = r"^[^#]*#" if inline else r"^\s*#"
    comment = F.regexp_extract("token", rf"(?:{lead}|<!--|/\*)\s*{marker}:\s*ignore\s+(.*?)\s*(?:-->|\*/|\n|\z)", 1)
    own = tokens(files.where(F.col("text").contains(marker + ":")), r"[^\n]*(?:\n|\z)").withColumn("o", _override(comment, F.col("line")))
    return own.where("o IS NOT NULL").select(*_FILE, "o.o_line", "o.ids", "o.reason")


def apply_overrides(findings: DataFrame, over: DataFrame, reach: int = 6) -> DataFrame:
    """findings (project, path, line, rule) with severity and reason of the nearest override at 0 to `reach` lines above; null without one.

    The join is an equality on (project, path, line), as an override covers but reach + 1 lines.
    """
    covers = over.select(*_FILE, "o_line", F.explode("ids").alias("id"), "reason", F.explode(F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda k: F.col("o_line") + k)).alias("line"))
    last = covers.groupBy(*_FILE, "line", "id").agg(F.max_by("reason", "o_line").alias("reason"), F.max("o_line").alias("o_line"))
    own, any_ = last.where("id <> '*'").withColumnRenamed("id", "rule"), last.where("id = '*'").select(*_FILE, "line", F.col("reason").alias("reason_any"), F.col("o_line").alias("o_any"))
    both = findings.join(own, [*_FILE, "line", "rule"], "left").join(any_, [*_FILE, "line"], "left")
    reason = F.when(F.col("o_any").isNotNull() & (F.col("o_line").isNull() | (F.col("o_any") > F.col("o_line"))), F.col("reason_any")).otherwise(F.col("reason"))
    severity = F.when(reason.isNotNull(), F.when(reason == "", "warning").otherwise("info"))
    return both.select(*findings.columns, reason.alias("reason"), severity.alias("override_severity"))
