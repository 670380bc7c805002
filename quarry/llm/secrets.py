"""Secret scans over an incremental ledger of blobs.

A version of a document is a blob, addressed by the SHA-256 of its text. The ledger has
the (rule, version) pairs that each blob was scanned with. A run scans the distinct blobs of the
pairs it has not seen, adds them to the ledger and to the findings, and joins findings
back to every path (document row) that has the blob. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, without


@dataclass(frozen=True)
class SecretRule:
    """kind, its pattern, and how long the match (or its group 2) must be to count."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: str = "1"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
#: Public formats; the order is the order in which kinds are listed.
RULES = (
    SecretRule("assign", "(" + _KEYS + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    SecretRule("access", r"AKIA[A-Z0-9]+", 20),
    SecretRule("hex", r"[0-9a-f]{24,}", 24),
    SecretRule("github", r"(?:gh[opsur]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
#: The ledger's rows and the findings' rows. A blob has a ledger row for each run that scanned it.
LEDGER = "blob string, scanned array<string>"
FINDING = "blob string, rule string, rule_version string, start int, end int"
#: Up to so many addresses to scan are broadcast; more meet their texts by shuffle.
BROADCAST_BLOBS = 300_000


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, rules, findings: array of (rule, start, end)) of (blob, text, rules: array of the kinds to scan).

    Matches are leftmost and don't overlap within a kind; too short ones are dropped
    after matching. A match ends behind the pieces between matches and the matches up to it, so
    positions are running sums over a kind's own matches and cost stays in proportion to the text.
    """
    kinds = []
    for r in rules:
        hit = F.array_contains("rules", r.kind) & F.col("text").rlike(r.pattern)
        parts = F.arrays_zip(
            F.split("text", r.pattern, -1).alias("piece"),
            F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("match"),
            (F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)) if r.group else F.array().cast("array<string>")).alias("value"),
        )
        # lengths only: the text itself is not carried on
        lean = F.transform(parts, lambda p: F.struct(F.length(p["piece"]).alias("gap"), F.length(p["match"]).alias("size"), (F.length(p["value"]) if r.group else F.length(p["match"])).alias("key")))
        kinds.append(F.when(hit, F.struct(F.lit(r.kind).alias("rule"), F.lit(r.least).alias("least"), lean.alias("parts"))))
    found = blobs.select("blob", "rules", F.array_compact(F.array(*kinds)).alias("kinds"))
    each = found.select("blob", "rules", F.explode_outer("kinds").alias("k")).select("blob", "rules", "k.rule", "k.least", F.posexplode_outer("k.parts").alias("n", "p"))
    order = W.partitionBy("blob", "rule").orderBy("n")
    ends = F.sum(F.col("p.gap") + F.coalesce("p.size", F.lit(0))).over(order)
    each = each.withColumn("end", ends.cast("int"))
    kept = F.when(F.col("p.size").isNotNull() & (F.col("p.key") >= F.col("least")), F.struct("rule", (F.col("end") - F.col("p.size")).alias("start"), "end"))
    return each.groupBy("blob").agg(F.first("rules").alias("rules"), F.collect_list(kept).alias("findings"))


def pairs(rules=RULES) -> Column:
    """The present (rule, version) pairs, as "rule:version"."""
    return F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])


def unseen(docs: DataFrame, ledger: DataFrame | None, rules=RULES, text: str = "text") -> DataFrame:
    """(blob, text, rules) of the distinct blobs of docs with the kinds whose present version hasn't scanned them.

    The ledger is asked on addresses. Where what it leaves is at most BROADCAST_BLOBS, only texts
    to be scanned move; else, as without a ledger, texts meet by their address.
    """
    versions = docs.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("done"))
        todo = versions.select("blob").distinct().join(done, "blob", "left")
        todo = todo.select("blob", F.array_except(pairs(rules), F.coalesce("done", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
        todo = checkpointed(todo)
        versions = versions.join(F.broadcast(todo) if todo.count() <= BROADCAST_BLOBS else todo, "blob")
    else:
        versions = versions.withColumn("todo", pairs(rules))
    once = versions.groupBy("blob", "text", "todo").agg(F.count("*").alias("n"))
    return once.select("blob", "text", F.transform("todo", lambda x: F.substring_index(x, ":", 1)).alias("rules"))


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules=RULES, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(ledger, findings) after a run over all rows of docs, each a version of a document.

    ledger and findings: those of the runs before; None: none. What the run adds is computed
    once and kept in the shared folder. Null and empty texts are the one empty blob, which is
    scanned like any other. Repeated rows share a blob and are scanned once; very long texts
    are scanned whole. Findings are kept under the rule version that made them. An empty
    table adds nothing.
    """
    todo = unseen(docs, ledger, rules, text)
    version = F.element_at(F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))]), F.col("rule"))
    # a row for each blob, found or not, so that one pass over the texts gives ledger and findings
    run = checkpointed(scan_blobs(todo, rules))
    new = run.select("blob", F.explode("findings").alias("f")).select("blob", "f.*").select("blob", "rule", version.alias("rule_version"), "start", "end")
    marks = run.select("blob", F.transform("rules", lambda k: F.concat_ws(":", k, F.element_at(F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))]), k))).alias("scanned"))
    return (marks if ledger is None else ledger.unionByName(marks)), (new if findings is None else findings.unionByName(new))


def with_findings(docs: DataFrame, ledger: DataFrame, findings: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """docs with `findings`, the array of (start, rank, rule, end) of its blob under the present rules, by
    start, then kind as listed, and `n_scanned`, the number of present rules that the ledger has for the blob.

    Every row gets its blob's findings; rows without any get an empty array. Input columns
    named like the added ones are replaced.
    """
    docs = without(docs, "findings", "n_scanned", "_blob", "_of")
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    own = findings.where(F.array_contains(pairs(rules), F.concat_ws(":", "rule", "rule_version"))).distinct()
    own = own.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", F.element_at(rank, F.col("rule")).alias("rank"), "rule", "end"))).alias("findings"))
    seen = ledger.groupBy("blob").agg(F.size(F.array_intersect(pairs(rules), F.flatten(F.collect_list("scanned")))).cast("long").alias("n_scanned"))
    own = seen.join(own, "blob", "left").withColumnRenamed("blob", "_of")
    out = docs.withColumn("_blob", blob_of(F.col(text))).join(own, F.col("_blob") == F.col("_of"), "left")
    empty = F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("rank"), F.lit("").alias("rule"), F.lit(0).alias("end"))), lambda x: F.lit(False))
    return out.select(*[docs[c] for c in docs.columns], F.coalesce("findings", empty).alias("findings"), F.coalesce("n_scanned", F.lit(0).cast("long")).alias("n_scanned"))


def _sql_spans(rule: SecretRule) -> str:
    pattern = rule.pattern.replace("'", "''")
    keep = f"len(regexp_extract(m, '{pattern}', {rule.group})) >= {rule.least}" if rule.group else f"len(m) >= {rule.least}"
    return f"""SELECT rid, '{rule.kind}' AS kind, {RULES.index(rule)} AS rank, s, s + len(m) AS e FROM (
    SELECT rid, ms[i] AS m, list_sum(list_transform(ps[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) - length(ms[i]) AS s
    FROM (SELECT rid, ms, ps, unnest(generate_series(1, len(ms))) AS i FROM (
      SELECT rid, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM d) WHERE len(ms) > 0)) WHERE {keep}"""


SQL = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),\nf AS ("
    + "\nUNION ALL ".join(_sql_spans(r) for r in RULES)
    + f"""),
g AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) AS spans
  FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, {len(RULES)}::BIGINT AS n_scanned
FROM d LEFT JOIN g USING (rid)
"""
)
