"""Benchmark decontamination with one Aho-Corasick automaton.

The windows (10 consecutive words of a normalised benchmark item; the whole item if it
is shorter) are the automaton's patterns. Each text is normalised to its words with
single spaces between, scanned once, and the occurrences are mapped back to word numbers
and, for the spans, to offsets in the original text. No shuffle: texts stay where
they are.

A benchmark whose windows are too long for one automaton is dealt by window to several; then
every one has a pass of its own over the texts, so that a worker never holds two, and the
passes' hits, which are slim, are put together by document.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, small_batches, text_bytes, without

WINDOW = 10
#: Characters of the windows of one automaton, about as many nodes of some 40 bytes each.
AUTOMATON_CHARS = 6_000_000
#: Words are runs of characters outside \x00-\x2F, \x3A-\x60 and \x7B-\x7F, after A-Z are lower-cased.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_RUNS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
_SCHEMA = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", _RUNS), T.StructField("items", T.ArrayType(T.StringType()))])
#: The automaton that a worker has built last.
_cache: dict[str, object] = {}


def normalise(text: bytes) -> bytes:
    return b" ".join(text.translate(_TABLE).split())


def windows(item: bytes, n: int = WINDOW) -> list[bytes]:
    words = normalise(item).split()
    return [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def automaton(owners: list[tuple[str, list]]):
    """The automaton over (window, items that have it); a match gives (length, words, items)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for w, ids in owners:
        padded = f" {w.encode().decode('latin-1')} "
        a.add_word(padded, (len(padded), w.count(" ") + 1, tuple(ids)))
    if owners:
        a.make_automaton()
    return a if owners else None


def _automaton(owners):
    key = hashlib.sha256(repr(owners).encode()).hexdigest()
    if key not in _cache:
        _cache.clear()
        _cache[key] = automaton(owners)
    return _cache[key]


def scan(text: bytes, a) -> tuple[int, list[list[int]], set]:
    """(number of words, merged runs of hit words, items found)."""
    norm = normalise(text)
    if not norm:
        return 0, [], set()
    n_words, found = norm.count(b" ") + 1, set()
    if a is None:
        return n_words, [], found
    ends, at, counted, hits = [], 0, 0, []
    for end, (length, words, ids) in a.iter(f" {norm.decode('latin-1')} "):
        found.update(ids)
        ends.append((end - length + 1, words))
    for start, words in sorted(ends):
        counted += norm.count(b" ", at, start)
        at = start
        # `start` is the space before the first word, at `start - 1` in norm
        first = counted if start else 0
        hits.append((first, first + words))
    return n_words, merged(hits), found


def merged(runs) -> list[list[int]]:
    """Overlapping and touching [first, last) runs joined."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(window, items): the distinct windows of all items and the ids, sorted, of those that have them."""

    def of(texts):
        import pyarrow as pa

        return pa.array([sorted({w.decode("utf-8", "replace") for w in windows(t or b"", n)}) for t in text_bytes(texts)], type=pa.list_(pa.string()))

    each = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.explode(F.arrow_udf(of, T.ArrayType(T.StringType())).asNondeterministic()(F.col("text"))).alias("window"))
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, limit: int = AUTOMATON_CHARS, spans: bool = True, text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted item ids), contaminated and, if asked for, spans.

    spans: [start, end) offsets, in code points of the original text, of the runs of hit
    words. Null texts and items have no words. Windows of an item whose id is null hit
    words, but such items are not listed or counted; rows that repeat an item_id are one
    item with the windows of all of them. Repeated documents are judged alike and stay.
    Very long texts are scanned whole. Empty tables: no documents, or none hit. Input
    columns named like the added ones are replaced.
    """
    docs = without(docs, "n_words", "n_hit", "n_items", "items", "contaminated", "spans", "_r", "_row", "_key")
    small_batches(docs.sparkSession)
    all_windows = checkpointed(benchmark_windows(benchmark, n))
    chars = all_windows.agg(F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()[0]
    parts = max(1, -(-chars // limit))
    sc = docs.sparkSession.sparkContext

    def finder(part: int):
        own = all_windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        # at most about `limit` characters, as counted above
        owners = sc.broadcast(sorted((r["window"], r["items"]) for r in own.collect()))

        def find(texts):
            import pyarrow as pa

            a, counts, hits, items = _automaton(owners.value), [], [], []
            for t in text_bytes(texts):
                words, runs, found = scan(t or b"", a)
                counts.append(words)
                hits.append([{"first": f, "last": e} for f, e in runs])
                items.append(sorted(found))
            run = pa.struct([("first", pa.int64()), ("last", pa.int64())])
            return pa.StructArray.from_arrays([pa.array(counts, type=pa.int64()), pa.array(hits, type=pa.list_(run)), pa.array(items, type=pa.list_(pa.string()))], names=["n_words", "hits", "items"])

        return F.arrow_udf(find, _SCHEMA)(F.col(text))

    if parts == 1:
        out = docs.withColumn("_r", finder(0))
    else:
        # equal texts have equal hits, so texts are told apart by 128 bits of their own
        keyed = docs.withColumn("_row", F.coalesce(F.unhex(F.md5(F.col(text).cast("binary"))), F.lit(b"")))
        hits = None
        for part in range(parts):
            own = keyed.select("_row", finder(part).alias("r"))
            own = checkpointed(own.select("_row", "r.*").where((F.size("hits") > 0) if part else F.lit(True)).dropDuplicates(["_row"]))
            hits = own if hits is None else hits.union(own)
        put = hits.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        put = put.select(F.col("_row").alias("_key"), F.struct("n_words", F.arrow_udf(_joined, _RUNS)(F.col("hits")).alias("hits"), "items").alias("_r"))
        out = keyed.join(put, F.col("_row") == F.col("_key")).select(*docs.columns, "_r")
    out = out.withColumn("_runs", F.col("_r.hits")).withColumn("n_words", F.col("_r.n_words")).withColumn("items", F.col("_r.items"))
    out = out.withColumn("n_hit", F.aggregate("_runs", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"])).withColumn("n_items", F.size("items").cast("long"))
    out = out.withColumn("contaminated", F.col("n_hit") > 0)
    added = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    if spans:
        span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
        out = out.withColumn("spans", F.arrow_udf(_offsets, span)(F.when(F.col("contaminated"), F.col(text)), F.col("_runs")))
        added.append("spans")
    return out.select(*docs.columns, *added)


def _joined(hits):
    """Runs of several passes, merged."""
    import pyarrow as pa

    run = pa.struct([("first", pa.int64()), ("last", pa.int64())])
    return pa.array([[{"first": f, "last": e} for f, e in merged((r["first"], r["last"]) for r in own)] for own in hits.to_pylist()], type=pa.list_(run))


def _offsets(texts, runs):
    """Offsets in the original of runs of words."""
    import pyarrow as pa

    rows = []
    for t, own in zip(texts.to_pylist(), runs.to_pylist()):
        if not t or not own:
            rows.append([])
            continue
        at = [(m.start(), m.end()) for m in _WORD.finditer(t.translate({c: c + 32 for c in range(65, 91)}))]
        rows.append([{"start": at[r["first"]][0], "end": at[r["last"] - 1][1]} for r in own])
    return pa.array(rows, type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


SQL = r"""
WITH lw AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, least(len(ws), 10) AS k FROM bw WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM bi)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT rid, i, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g FROM (SELECT rid, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM lw, ks WHERE len(ws) >= k)),
hit AS (SELECT rid, i, dw.k, item_id FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
nh AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS j FROM hit) GROUP BY rid),
ni AS (SELECT rid, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(nh.n, 0)::BIGINT AS n_hit, coalesce(ni.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(nh.n, 0) > 0 AS contaminated
FROM lw LEFT JOIN nh USING (rid) LEFT JOIN ni USING (rid)
"""
