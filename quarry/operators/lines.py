"""Gates over lines of text files.

files: (project, path, text, ...). All line gates share one pass (`line_gates`): paths are
judged first, by each project's options where the files carry them, then a text is split
once, and lines that one alternation of all gates' marks doesn't find go no further.
Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import rules as R
from ..functions import text as X


def explode_lines(files: DataFrame) -> DataFrame:
    """(project, path, line_no, line): 1-based, split at LF, without the empty piece after a last LF."""
    each = files.select("project", "path", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"), F.size(F.split("text", "\n", -1)).alias("n"))
    return each.where(~((F.col("pos") == F.col("n") - 1) & (F.col("line") == ""))).select("project", "path", (F.col("pos") + 1).alias("line_no"), "line")


def lines_of(text: Column) -> Column:
    """The lines of a text as an array, as explode_lines has them."""
    whole = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(whole, "\n", -1))


_ENTRY = "struct<gate_id:string,line_no:int,rule:string,text:string,severity:string>"
_NONE = f"array<{_ENTRY}>"


def _entry(gate: str, line_no: Column, rule: Column | str, text: Column | None = None, severity: Column | str | None = None) -> Column:
    string = lambda c: (F.lit(c) if c is None or isinstance(c, str) else c).cast("string")
    return F.struct(F.lit(gate).alias("gate_id"), line_no.cast("int").alias("line_no"), string(rule).alias("rule"), string(text).alias("text"), string(severity).alias("severity"))


def is_list(lines: Column, item) -> Column:
    """At least 10 lines that are no blanks or comments, 80 % of which are bare items."""
    body = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda t: (t != "") & ~t.rlike("^(#|;|//)"))
    return F.transform(F.array(body), lambda b: (F.size(b) >= 10) & (F.size(F.filter(b, item)) * 5 >= F.size(b) * 4))[0]


def bare_address(t: Column) -> Column:
    """One IPv4 or IPv6 address or network, before a comment."""
    shape = r"^([0-9A-Fa-f.:]+)(?:/((?:0|[1-9][0-9]{0,2})))?\z"
    within = lambda own, most: F.coalesce(F.nullif(F.regexp_extract(own, shape, 2), F.lit("")).cast("int") <= most, F.lit(True))

    def of(own: Column) -> Column:
        v6 = F.when(own.contains(":"), X.ipv6(F.regexp_extract(own, shape, 1)).isNotNull() & within(own, 128))
        return own.rlike(shape) & F.coalesce(v6, X.ipv4(F.regexp_extract(own, shape, 1)).isNotNull() & within(own, 32))

    return X.let(F.trim(F.regexp_replace(t, "[#;].*$", "")), of)


def bare_url(t: Column) -> Column:
    return t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^\t\n\f\r ]+\z")


_MARKER = r"^(?:<{7}|>{7}|\|{7})(?: |\r?\z)"


def _placeholder_hits(line: Column, line_no: Column, off: Column) -> Column:
    """The first hit of each pattern."""
    found = lambda rule, p: F.when(line.rlike(p) & ~F.array_contains(off, rule), _entry("dead_placeholders", line_no, rule, F.regexp_substr(line, F.lit(p))))
    return F.array_compact(F.array(*[found(rule, p) for rule, p in R.PLACEHOLDER_PATTERNS]))


def _network_hits(line: Column, line_no: Column, prose: Column) -> Column:
    """CIDRs, IPv4 addresses and AS numbers, not classified yet."""
    svg = X.find_all(line, R.SVG_GEOMETRY)
    blank = F.aggregate(svg, line, lambda s, m: F.overlay(s, F.repeat(F.lit(" "), m["end"] - m["start"]), m["start"] + 1, m["end"] - m["start"]))
    line = F.when(line.rlike(R.SVG_GEOMETRY), blank).otherwise(line)
    cidrs = F.regexp_extract_all(line, F.lit(R.CIDR), F.lit(0))
    before = lambda m: F.lower(F.substring(line, F.greatest(m["start"] - 23, F.lit(1)), F.least(m["start"], F.lit(24))))
    versioned = lambda m: before(m).rlike(R.VERSION_CONTEXT) | F.substring(line, m["end"] + 1, F.lit(2)).rlike(r"^\.[0-9]")
    addresses = F.filter(X.find_all(line, R.IPV4), lambda m: ~F.exists(cidrs, lambda c: c.startswith(F.concat(m["text"], F.lit("/")))) & ~versioned(m))
    asns = F.when(prose, F.array().cast("array<string>")).otherwise(F.filter(F.regexp_extract_all(line, F.lit(R.ASN), F.lit(0)), lambda a: F.substring(a, 3, 7).cast("int") > 0))
    entry = lambda rule, text: _entry("network_scan", line_no, rule, text)
    return F.concat(F.transform(cidrs, lambda c: entry("cidr", c)), F.transform(addresses, lambda m: entry("ipv4", m["text"])), F.transform(asns, lambda a: entry("asn", a)))


def _connection_hits(line: Column, line_no: Column) -> Column:
    """Patterns claim spans of a line in order of priority; what overlaps a claimed span is dropped. Credentials that are no
    secret still claim theirs; exempt hosts and markup identifiers don't."""

    def ranked(k: int, pattern: str):
        return F.transform(X.find_all(line, pattern), lambda m: F.struct(F.lit(k).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text")))

    candidates = F.concat(*[ranked(k, p) for k, (_, _, p) in enumerate(R.CONNECTION_PATTERNS)])
    rest = lambda c: F.regexp_extract(c["text"], r"(?s)^.*?://(.*)$", 1)
    uri_host = lambda c: F.regexp_replace(rest(c), r"^[^@/]*@", "")
    before = lambda c: F.substring(line, F.lit(1), c["start"])
    http = len(R.CONNECTION_PATTERNS) - 1
    markup = lambda c: before(c).rlike(R.MARKUP_ATTRIBUTE) | before(c).rlike(R.DOCTYPE)
    own_host = lambda c: ((c["rank"] > 0) & (c["rank"] < 7) & X.host_exempt(rest(c))) | ((c["rank"] == http) & X.host_exempt(rest(c)))
    exempt = lambda c: own_host(c) | (c["rank"].isin(7, 8) & ~rest(c).contains("@") & c["text"].contains("://") & X.host_exempt(uri_host(c)))
    left = F.filter(candidates, lambda c: ~exempt(c))
    # what stands before a match is looked at only in lines that may hold markup
    left = F.when(line.rlike(R.MARKUP_LINE), F.filter(left, lambda c: (c["rank"] != http) | ~markup(c))).otherwise(left)
    kept = X.claimed(left)
    real = F.filter(kept, lambda c: ~((c["rank"] == 0) & X.creds_non_secret(c["text"])))
    names, severities = (F.lit([x[k] for x in R.CONNECTION_PATTERNS]) for k in (0, 1))
    return F.transform(real, lambda c: _entry("connection_strings", line_no, F.get(names, c["rank"]), c["text"], F.get(severities, c["rank"])))


def _env_hits(lines: Column) -> Column:
    """KEY= lines without a comment on them or on the nearest line above that isn't blank."""
    unquoted = lambda x: F.regexp_replace(x, r"""'[^']*(?:'|\z)|"[^"]*(?:"|\z)""", "")

    def step(above, x):
        line = F.regexp_replace(x["line"], r"\r\z", "")
        t = F.trim(line)
        key = F.regexp_extract(t, "^([A-Za-z0-9_]+)=", 1)
        hit = (key != "") & ~unquoted(line).contains("#") & ~above.startswith("#")
        found = F.when(hit, F.array(_entry("env_example_uncommented", x["line_no"], "", key))).otherwise(F.array().cast(_NONE))
        return F.when(t != "", t).otherwise(above), found

    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("line"), (i + 1).alias("line_no")))
    return X.scan(numbered, F.lit(""), F.array().cast(_NONE), step)


_ANY_SECRET = "|".join(f"(?:{p})" for _, p in R.SECRET_PATTERNS) + f"|{R.PEM_HEADER}"


def _secret_hits(line: Column, line_no: Column) -> Column:
    """Credentials of known vendors, one for each pattern, without those that look made up."""
    real = lambda p: F.exists(F.regexp_extract_all(line, F.lit(p), F.lit(0)), lambda t: ~is_synthetic(t))
    found = F.array_compact(F.array(*[F.when(line.rlike(p) & real(p), _entry("secrets_scan", line_no, n)) for n, p in R.SECRET_PATTERNS]))
    return F.when(_marked("secrets_scan", line, _ANY_SECRET), found).otherwise(F.array().cast(_NONE))


def _key_hits(lines: Column, path: Column) -> Column:
    """Private keys: a header with key material next to it, or in a file named as a key.

    The material stands behind the header on its own line, as "\\n" escapes, or on the first line
    below that is no field of the header, however many fields there are.
    """
    material = lambda c: c.rlike(r"""^(?:[\s"'+,]|\\[nr])*[A-Za-z0-9+/=]{40,}""") & c.rlike("[a-z]") & c.rlike("[A-Z]") & c.rlike("[0-9]")

    def step(below, x):
        line = x["line"]
        behind = F.regexp_replace(line, rf"^.*?{R.PEM_HEADER}", "")
        key = line.rlike(R.PEM_HEADER) & (material(behind) | material(below) | path.rlike(R.KEY_FILE))
        found = F.when(key, F.array(_entry("secrets_scan", x["line_no"], "private_key"))).otherwise(F.array().cast(_NONE))
        return F.when(line.rlike(r"\S") & ~line.rlike("^[A-Za-z-]+: "), line).otherwise(below), found

    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("line"), (i + 1).alias("line_no")))
    return X.scan(F.reverse(numbered), F.lit(""), F.array().cast(_NONE), step)


#: Gate -> a pattern that a line with a finding matches; the first of a file, env keys and private keys are found by file.
_MARKS = {
    "dead_placeholders": "(?i:todo|fixme|xxx|hack|later|lorem)",
    "connection_strings": "://|jdbc:",
    "network_scan": f"{R.IPV4}|{R.ASN}",
    "secrets_scan": _ANY_SECRET,
}
LINE_GATES = ("merge_conflict_markers", "env_example_uncommented", *_MARKS)
#: Gate -> texts of which one stands in all that its mark finds; far cheaper to look for than the mark.
_WITHIN = {
    "merge_conflict_markers": ("<" * 7, ">" * 7, "|" * 7),
    "connection_strings": ("://", "jdbc:"),
    "secrets_scan": ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-", "AIza", "xox", "k_live_", "eyJ", "-----BEGIN "),
}
#: The same as expressions that begin with a set of characters.
_NEAR = {"dead_placeholders": "[tTfFxXhHlL](?i:odo|ixme|xx|ack|ater|orem)", "network_scan": r"[.S]\d"}


def _marked(gate: str, text: Column, mark: str) -> Column:
    """Whether the text matches the gate's mark."""
    cheap = [text.contains(w) for w in _WITHIN.get(gate, ())] or [text.rlike(p) for g, p in _NEAR.items() if g == gate]
    return reduce(lambda a, b: a | b, cheap) & text.rlike(mark) if cheap else text.rlike(mark)


def own_options(files: DataFrame, gate: str) -> Column | None:
    """The options of a gate that a file carries: those of its project for the gate, or else for every gate."""
    if "_options" not in files.columns:
        return None
    return F.coalesce(F.try_element_at("_options", F.lit(gate)), F.try_element_at("_options", F.lit("")))


def _asked(files: DataFrame, gate: str, as_gate: str | None = None) -> Column:
    """Whether a gate reads a file, by its path; as_gate: the gate whose options hold."""
    scan = own_options(files, as_gate or gate)
    if gate == "env_example_uncommented":
        return F.col("path").isin(R.ENV_EXAMPLES)
    if gate == "merge_conflict_markers":
        return ~P.should_skip(scan=scan)
    if gate == "secrets_scan":
        return ~P.should_skip_secrets(scan=scan) & ~P.is_detection_rule()
    own = ~P.should_skip_content(scan=scan) & ~P.is_changelog() & ~P.is_detection_rule()
    return own & ~(P.is_placeholder_register() if gate == "dead_placeholders" else P.is_license())


def line_gates(files: DataFrame, gates: Iterable[str] = LINE_GATES, disabled: tuple[str, ...] = (), loopback: bool = False, unspecified: bool = False, as_gate: str | None = None) -> DataFrame:
    """(project, path, gate_id, line_no, rule, text, severity, category) of the findings of line gates, in one pass over the texts.

    files may carry `_options` (see config.with_options), which stand before the arguments.
    Null texts have no lines.
    """
    gates = [g for g in LINE_GATES if g in set(gates)]
    by_line = [g for g in gates if g in _MARKS]
    value = lambda gate, name, default: default if (o := own_options(files, gate)) is None else F.coalesce(o[name], default)
    asked = files.select(
        "project", "path", "text", P.is_prose().alias("prose"), *[_asked(files, g, as_gate).alias(g) for g in gates],
        value("dead_placeholders", "disabled_patterns", F.lit(list(disabled)).cast("array<string>")).alias("off"),
        *[value("network_scan", f"report_{n}", F.lit(d)).alias(n) for n, d in (("loopback", loopback), ("unspecified", unspecified))],
        *[value(g, "skip_default_data_files", F.lit(True)).alias(f"{g}_lists") for g in ("connection_strings", "network_scan") if g in gates],
    )
    asked = asked.where(reduce(lambda a, b: a | b, [F.col(g) for g in gates]))
    # a gate goes on where the text holds its mark; the others aren't looked at again
    text = F.col("text")
    mark = _MARKS | {"merge_conflict_markers": "(?m)^(?:<{7}|>{7}|\\|{7})", "env_example_uncommented": "="}
    asked = asked.select("*", *[(F.col(g) & _marked(g, text, mark[g])).alias(f"on_{g}") for g in gates])
    on = {g: F.col(f"on_{g}") for g in gates}
    asked = asked.where(reduce(lambda a, b: a | b, on.values()))
    none, lines = F.array().cast(_NONE), lines_of(text)
    whole = []  # findings by file
    if "merge_conflict_markers" in gates:
        first = F.array_position(F.transform(lines, lambda x: x.rlike(_MARKER)), True)
        whole.append(F.when(on["merge_conflict_markers"], F.filter(F.array(_entry("merge_conflict_markers", first, "")), lambda e: e["line_no"] > 0)))
    if "env_example_uncommented" in gates:
        whole.append(F.when(on["env_example_uncommented"], _env_hits(lines)))
    if "secrets_scan" in gates:
        whole.append(F.when(on["secrets_scan"] & text.rlike(R.PEM_HEADER), _key_hits(lines, F.col("path"))))
    lists = {"connection_strings": bare_url, "network_scan": bare_address}
    own = [(on[g] & ~(F.col(f"{g}_lists") & is_list(lines, lists[g])) if g in lists else on[g]).alias(f"on_{g}") for g in by_line]
    by_file = F.concat(*[F.coalesce(w, none) for w in whole]) if whole else none
    judged = asked.select("project", "path", "text", "prose", "off", "loopback", "unspecified", *own, by_file.alias("by_file"))
    each = judged.select("*", F.posexplode(lines).alias("at", "line")).drop("text")
    any_mark = reduce(lambda a, b: a | b, [F.col(f"on_{g}") & _marked(g, F.col("line"), _MARKS[g]) for g in by_line], F.lit(False))
    each = each.where(any_mark | ((F.col("at") == 0) & (F.size("by_file") > 0)))
    line, line_no = F.col("line"), F.col("at") + 1
    hits = {
        "dead_placeholders": lambda: _placeholder_hits(line, line_no, F.col("off")),
        "connection_strings": lambda: _connection_hits(line, line_no),
        "network_scan": lambda: _network_hits(line, line_no, F.col("prose")),
        "secrets_scan": lambda: _secret_hits(line, line_no),
    }
    found = [F.when(F.col(f"on_{g}") & _marked(g, line, _MARKS[g]), hits[g]()).otherwise(none) for g in by_line]
    out = each.select("project", "path", "loopback", "unspecified", F.explode(F.concat(F.when(F.col("at") == 0, F.col("by_file")).otherwise(none), *found)).alias("e"))
    out = out.select("project", "path", "loopback", "unspecified", "e.*")
    if "network_scan" not in gates:
        return out.select("project", "path", "gate_id", "line_no", "rule", "text", "severity", F.lit(None).cast("string").alias("category"))
    address = F.col("gate_id") == "network_scan"
    category = F.when(F.col("rule") == "asn", "asn").otherwise(X.classify_ipv4(X.ipv4(F.substring_index("text", "/", 1))))
    out = out.withColumn("category", F.when(address, category))
    wanted = F.col("category").isNotNull() & (F.col("category") != "doc-range") & (F.col("loopback") | (F.col("category") != "loopback")) & (F.col("unspecified") | (F.col("category") != "unspecified"))
    severity = F.when(address, F.when(F.col("category") == "public", "warning").otherwise("info")).otherwise(F.col("severity"))
    return out.where(~address | wanted).select("project", "path", "gate_id", "line_no", "rule", "text", severity.alias("severity"), "category")


def first_of_path(found: DataFrame) -> DataFrame:
    """Findings of line gates with one merge marker a path, its first, where several rows share a path. Only findings move."""
    marker = F.col("gate_id") == "merge_conflict_markers"
    own = found.groupBy("project", "path", "gate_id", "rule", "text", "severity", F.when(~marker, F.col("line_no")).alias("_at"))
    return own.agg(F.min("line_no").alias("line_no")).drop("_at")


def merge_conflict_markers(files: DataFrame) -> DataFrame:
    """(project, path, line_no) of the first marker line of each path."""
    return first_of_path(line_gates(files, ("merge_conflict_markers",))).select("project", "path", "line_no")


def dead_placeholders(files: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """(project, path, line_no, rule, text): the first hit of each pattern on each line."""
    return line_gates(files, ("dead_placeholders",), disabled=disabled).select("project", "path", "line_no", "rule", "text")


def network_scan(files: DataFrame, loopback: bool = False, unspecified: bool = False) -> DataFrame:
    """(project, path, line_no, rule, text, severity, category) of CIDRs, IPv4 addresses and AS numbers."""
    out = line_gates(files, ("network_scan",), loopback=loopback, unspecified=unspecified)
    return out.select("project", "path", "line_no", "rule", "text", "severity", "category")


def connection_strings(files: DataFrame) -> DataFrame:
    """(project, path, line_no, rule, severity, text)."""
    return line_gates(files, ("connection_strings",)).select("project", "path", "line_no", "rule", "severity", "text")


def env_example_uncommented(files: DataFrame) -> DataFrame:
    """(project, path, line_no, key) of KEY= lines without a comment."""
    return line_gates(files, ("env_example_uncommented",)).select("project", "path", "line_no", F.col("text").alias("key"))


def json_parse_errors(files: DataFrame, most: int = 5 << 20) -> DataFrame:
    """(project, path) of JSON files of 1 byte to the cap that don't parse."""
    own = files.where((P.config_kind() == "json") & (F.col("size") > 0) & (F.col("size") <= most) & ~P.should_skip_content(scan=own_options(files, "config_parse_error")))
    return own.where(~X.valid_json(F.col("text")) & ~X.valid_json(X.jsonc_stripped(F.col("text")))).select("project", "path")


def is_synthetic(token: Column) -> Column:
    """A run of eight consecutive code points, a stand-in's word, or too little entropy to be random."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    step = lambda acc, c: F.struct(c.alias("last"), F.when(c == acc["last"] + 1, acc["run"] + 1).otherwise(1).alias("run"), F.greatest(acc["most"], F.when(c == acc["last"] + 1, acc["run"] + 1).otherwise(1)).alias("most"))
    run = F.aggregate(codes, F.struct(F.lit(-9).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most")), step, lambda acc: acc["most"])
    return (run >= 8) | token.rlike(R.SECRET_STAND_IN) | (X.shannon_entropy(token) < 3.5)


def secrets_scan(files: DataFrame) -> DataFrame:
    """(project, path, line_no, pattern): credentials of known vendors, one row a line and pattern, private keys, and tracked .env files."""
    out = line_gates(files, ("secrets_scan",)).select("project", "path", "line_no", F.col("rule").alias("pattern"))
    return out.unionByName(tracked_env(files)) if "tracked" in files.columns else out


def tracked_env(files: DataFrame) -> DataFrame:
    """Tracked .env files, whatever they hold, in the form of secrets_scan, at line 1."""
    own = files.where(F.col("tracked") & (P.base() == ".env") & ~P.should_skip_secrets(scan=own_options(files, "secrets_scan")))
    return own.select("project", "path", F.lit(1).alias("line_no"), F.lit("env_file").alias("pattern"))


def secrets_history(blobs: DataFrame, most: int | None = None, own_most: DataFrame | None = None) -> DataFrame:
    """(project, file_path, severity) of credentials in any version that history holds: blobs (project, sha, path, seq, text).

    A blob is scanned once, under its first path, and its location is history:sha:path:line:pattern.
    most: scan only so many blobs of a project, by seq, or as many as own_most (project, max_blobs)
    says; a project that has more gets an info row.
    """
    once = blobs.groupBy("project", "sha").agg(F.min(F.struct("seq", "path")).alias("first")).select("project", "sha", "first.*")
    limited = most is not None or own_most is not None
    if limited:
        once = once.withColumn("nth", F.row_number().over(W.partitionBy("project").orderBy("seq", "sha")))
        bound = F.lit(most).cast("long")
        if own_most is not None:
            once = once.join(own_most.where("max_blobs > 0"), "project", "left")
            bound = F.coalesce("max_blobs", bound)
        more = once.where(F.col("nth") == bound + 1).select("project", F.lit("history:limit").alias("file_path"), F.lit("info").alias("severity"))
        once = once.where(bound.isNull() | (F.col("nth") <= bound)).select("project", "sha", "seq", "path")
    # only blobs that may hold one move
    first = blobs.where(_marked("secrets_scan", F.col("text"), _ANY_SECRET)).join(once, ["project", "sha", "seq", "path"], "left_semi").dropDuplicates(["project", "sha"])
    # lines of a blob stay apart from those of other versions under the same path
    own = first.select(F.struct("project", "sha").alias("project"), "path", "text", *[c for c in ("_options",) if c in first.columns])
    found = line_gates(own, ("secrets_scan",), as_gate="secrets_scan_history").withColumnRenamed("rule", "pattern")
    place = F.concat_ws(":", F.lit("history"), F.substring("project.sha", 1, 8), "path", F.col("line_no").cast("string"), "pattern")
    out = found.select("project.project", place.alias("file_path"), F.lit("warning").alias("severity"))
    return out.unionByName(more) if limited else out
