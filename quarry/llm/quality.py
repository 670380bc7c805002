"""Quality rules as a short-circuit cascade.

All rules must pass. A document is judged by one rule after the other, up to the first that
rejects it, and what a rule counts in the text is counted when it is first asked for. On a
bounded random sample each rule's cost and rejections are measured, by the executors; the
rule with the most rejections per cost goes first, and so on with the documents that it leaves.
The order changes the work and never the verdict.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_bytes, without

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
#: Documents that the order of the rules is estimated on, about: each is drawn alike. The verdict doesn't depend on them.
SAMPLE, SEED = 400, 10
#: Counts of the contract.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BLANK = b" \t\n\r\x0b\x0c"
_CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")


class Doc:
    """A text and what is counted in it, when asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS)) if self.words else 0

    @cached_property
    def lines(self) -> list:
        """Lines with a word."""
        return [x for x in self.text.split(b"\n") if x.strip(_BLANK)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        words, total, reach = self.words, 0, 0
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            count = Counter(windows)
            for i, w in enumerate(windows):
                if count[w] > 1:  # words up to `reach` are counted
                    total += i + 3 - max(reach, i)
                    reach = i + 3
        return total

    @cached_property
    def n_top(self) -> int:
        """How often the most frequent word occurs."""
        return max(Counter(self.words).values(), default=0)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


#: The base rules, which the contract fixes.
BASE = (
    Rule("few_words", lambda d: d.n_words < 50),
    Rule("repeat_words", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
)
#: All rules; the last five are the method's own.
RULES = (
    *BASE,
    Rule("symbol_per_word", lambda d: 2 * d.n_symbols > d.n_words),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words),
    Rule("dup_lines", lambda d: d.n_dup_lines > 0 and 2 * d.n_dup_lines > len(d.lines)),
    Rule("top_word", lambda d: d.n_words >= 100 and 3 * d.n_top > d.n_words),
    Rule("control_chars", lambda d: 10 * len(_CONTROL.findall(d.text)) > d.word_chars),
)


def ordered(cost: dict, rejected: dict, n: int) -> list[str]:
    """Names of the rules, by rejections per cost among the documents that the earlier ones leave.

    cost: seconds of each rule on all n documents; rejected: the set of documents that it rejects.
    """
    left, out, rest = set(range(n)), [], sorted(cost)
    while rest:
        best = max(rest, key=lambda r: ((len(rejected[r] & left) + 0.5) / max(cost[r], 1e-9), r))
        out.append(best)
        rest.remove(best)
        left -= rejected[best]
    return out


def cascade_order(docs: DataFrame, sample: int = SAMPLE, text: str = "text") -> list[str]:
    """Names of the rules in the order in which a sample of docs is judged at the least cost.

    The sample is drawn and measured on the executors; what comes to the driver are its numbers.
    """

    def measured(batches):
        import pyarrow as pa

        for b in batches:
            for t in text_bytes(b.column(0)):
                cost, bad = [], []
                for r in RULES:
                    d, began = Doc(t or b""), time.perf_counter()
                    bad.append(bool(r.rejects(d)))
                    cost.append(time.perf_counter() - began)
                yield pa.record_batch([pa.array([cost]), pa.array([bad])], names=["cost", "bad"])

    drawn = docs.select(text).sample(min(1.0, sample / max(1, docs.count())), SEED)
    got = drawn.mapInArrow(measured, "cost array<double>, bad array<boolean>").collect()
    names = [r.name for r in RULES]
    return ordered({x: sum(g["cost"][k] for g in got) for k, x in enumerate(names)}, {x: {i for i, g in enumerate(got) if g["bad"][k]} for k, x in enumerate(names)}, len(got))


def judge_quality(docs: DataFrame, sample: int = SAMPLE, text: str = "text", counts: bool = True) -> DataFrame:
    """docs with kept and failed_rule and, if asked for, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and base_failed.

    With counts every document's five counts are taken in any case, and only what the other
    rules count is saved; without them the cascade alone decides what is counted.
    failed_rule is the first rule that rejected (it may differ between runs where several
    do, as the order is measured), null for kept documents. Null text counts as empty: no
    words, so base_failed. Very long texts are counted whole. Repeated rows are judged alike
    and stay. The sample only orders the rules. An empty table gives an empty one. Input
    columns named like the added ones are replaced.
    """
    kinds = [*([(n, "long") for n in COUNTS] + [("base_failed", "boolean")] if counts else []), ("kept", "boolean"), ("failed_rule", "string")]
    docs = without(docs, *COUNTS, "base_failed", "kept", "failed_rule", "_q")
    small_batches(docs.sparkSession)
    order = cascade_order(docs, sample, text) if sample else [r.name for r in RULES]
    own = {"long": T.LongType(), "boolean": T.BooleanType(), "string": T.StringType()}
    schema = T.StructType([T.StructField(n, own[k]) for n, k in kinds])

    def judge(texts):
        import pyarrow as pa

        by_name = {r.name: r for r in RULES}
        chain = [by_name[n] for n in order]
        out: dict[str, list] = {n: [] for n, _ in kinds}
        for t in text_bytes(texts):
            d = Doc(t or b"")
            failed = next((r.name for r in chain if r.rejects(d)), None)
            out["kept"].append(failed is None)
            out["failed_rule"].append(failed)
            if counts:
                for n in COUNTS:
                    out[n].append(getattr(d, n))
                out["base_failed"].append(any(r.rejects(d) for r in BASE))
        arrow = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        return pa.StructArray.from_arrays([pa.array(out[n], type=arrow[k]) for n, k in kinds], names=[n for n, _ in kinds])

    judged = docs.withColumn("_q", F.arrow_udf(judge, schema)(F.col(text)))
    return judged.select(*docs.columns, *[F.col(f"_q.{n}").alias(n) for n, _ in kinds])


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM (
    SELECT rid, i, list_aggregate(list_slice(ws, i, i + 2), 'string_agg', ' ') AS g
    FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3))),
rep AS (
  SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM win WHERE c > 1) GROUP BY rid),
dup AS (
  SELECT rid, sum(c - 1) AS n, sum(c) AS all_lines FROM (
    SELECT rid, l, count(*) AS c FROM (SELECT rid, unnest(ls) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid, l) GROUP BY rid),
top AS (SELECT rid, max(c) AS n FROM (SELECT rid, x, count(*) AS c FROM (SELECT rid, unnest(ws) AS x FROM w) GROUP BY rid, x) GROUP BY rid),
c AS (
  SELECT w.rid, doc_id, text, len(ws)::BIGINT AS n_words,
    CASE WHEN len(ws) = 0 THEN 0 ELSE list_sum(list_transform(ws, lambda x: length(x))) END::BIGINT AS word_chars,
    CASE WHEN len(ws) = 0 THEN 0 ELSE length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) END::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(all_lines, 0) AS n_lines, coalesce(top.n, 0) AS n_top,
    length(text) - length(regexp_replace(text, '[\x00-\x08\x0e-\x1f\x7f]', '', 'g')) AS n_control
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN top USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 2 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR (n_dup_lines > 0 AND 2 * n_dup_lines > n_lines) OR (n_words >= 100 AND 3 * n_top > n_words) OR 10 * n_control > word_chars) AS kept
FROM c
"""
