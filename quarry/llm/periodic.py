"""Stretches of words that repeat with a period, found on a grammar.

Words outside any run are set aside first: a run holds each of its word triples three times
at least, so only stretches of such triples are left, and again within these. Their word
ids are compressed by pairs (Re-Pair): each round replaces repeated pairs by nonterminals,
the more frequent one where two overlap; rounds go over all texts of a batch at once. What
is left is paired to a binary tree. A nonterminal's runs over the boundary of its two parts
are looked for once, translated to all places that it derives, and merged to maximal ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_bytes, without

#: A run is at least so long, and so many times its period.
SHORTEST, TIMES = 6, 4
#: Bytes of texts that are taken together, and candidates of (nonterminal, period) that are.
TOGETHER, CANDIDATES = 2 << 20, 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _triples(w: np.ndarray) -> np.ndarray:
    x = w.astype(np.uint64)
    return _mixed(_mixed(_mixed(x[:-2] + np.uint64(1)) + x[1:-1]) + x[2:])


def likely(words: np.ndarray, of: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (first, end) of words that hold all runs; of: text of each word.

    Equal hashes of different triples only leave more in.
    """
    if len(words) < SHORTEST:
        return []
    triple = _triples(words)
    at = np.flatnonzero(of[2:] == of[:-2])
    part, rough = of[at], True
    while True:
        key = _mixed(triple[at] + part.astype(np.uint64) * _MIX)
        if rough:  # counted by the hash's last bits
            slot = (key & np.uint64((1 << 22) - 1)).astype(np.int64)
            often = np.bincount(slot, minlength=1 << 22)[slot]
        else:
            _, place, counts = np.unique(key, return_inverse=True, return_counts=True)
            often = counts[place]
        left = at[often >= TIMES - 1]
        breaks = np.r_[True, left[1:] != left[:-1] + 1] if len(left) else np.zeros(0, dtype=bool)
        breaks[1:] |= of[left[1:]] != of[left[:-1]]
        starts = np.flatnonzero(breaks)
        size = np.diff(np.r_[starts, len(left)])
        whole = np.repeat(size >= SHORTEST - 2, size)
        new = left[whole]
        if not rough and len(new) == len(at):
            first = left[starts[size >= SHORTEST - 2]]
            return list(zip(first.tolist(), (first + size[size >= SHORTEST - 2] + 2).tolist()))
        at, part, rough = new, np.repeat(np.arange(len(starts)), size)[whole], False
        if not len(at):
            return []


def _rules(symbols: np.ndarray, part: np.ndarray):
    """(rule, start, length of the left part, length) of all places where a nonterminal is derived. Equal rules derive equal words."""
    n, start, size = int(symbols.max()) + 1, np.arange(len(symbols)), np.ones(len(symbols), dtype=np.int64)
    known_keys, known_ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    events, repeated = [], True
    while True:
        inside = part[:-1] == part[1:]
        if not inside.any():
            break
        key = np.where(inside, (symbols[:-1] << 32) | symbols[1:], -1 - np.arange(len(inside)))
        i = np.arange(len(key))
        if repeated:
            _, place, counts = np.unique(key, return_inverse=True, return_counts=True)
            often = np.where(inside, counts[place], 0)
            rank = np.where(often > 1, often.astype(np.uint64) << np.uint64(32) | _mixed(key.astype(np.uint64)) >> np.uint64(32), np.uint64(0))
            repeated = bool(rank.any())
        if repeated:
            # equal neighbours are a run of one symbol: every other pair of it
            run = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            end = np.r_[run[1:], len(key)]
            own = rank[run]
            best = (own > 0) & (own >= np.r_[np.uint64(0), own[:-1]]) & (own > np.r_[own[1:], np.uint64(0)])
            best &= ~np.r_[False, best[:-1]]
            lead = np.repeat(run, end - run)
            chosen = np.flatnonzero(np.repeat(best, end - run) & ((i - lead) % 2 == 0))
        else:  # nothing repeats: neighbours in pairs from each stretch's start
            lead = np.maximum.accumulate(np.where(np.r_[True, part[1:] != part[:-1]], np.arange(len(part)), 0))
            chosen = np.flatnonzero(inside & ((i - lead[:-1]) % 2 == 0))
        keys, place = np.unique(key[chosen], return_inverse=True)
        at = np.minimum(np.searchsorted(known_keys, keys), max(0, len(known_keys) - 1))
        old = known_keys[at] == keys if len(known_keys) else np.zeros(len(keys), dtype=bool)
        ids = np.empty(len(keys), dtype=np.int64)
        ids[old] = known_ids[at[old]]
        ids[~old] = n + np.arange((~old).sum())
        n += int((~old).sum())
        order = np.argsort(np.r_[known_keys, keys[~old]], kind="stable")
        known_keys, known_ids = np.r_[known_keys, keys[~old]][order], np.r_[known_ids, ids[~old]][order]
        events.append((ids[place], start[chosen], size[chosen], size[chosen] + size[chosen + 1]))
        symbols[chosen] = ids[place]
        size[chosen] += size[chosen + 1]
        stay = np.ones(len(symbols), dtype=bool)
        stay[chosen + 1] = False
        symbols, start, size, part = symbols[stay], start[stay], size[stay], part[stay]
    if not events:
        return [np.zeros(0, dtype=np.int64)] * 4
    return [np.concatenate(x) for x in zip(*events)]


class _Equal:
    """How far two places of a sequence agree, by hashes of its prefixes."""

    def __init__(self, values: np.ndarray, seed: int):
        n = len(values)
        own = _mixed(values.astype(np.uint64) + np.uint64(seed + 1) * _MIX)
        self.power = np.r_[np.uint64(1), np.multiply.accumulate(np.full(n, _BASE, dtype=np.uint64))]
        self.sums = np.r_[np.uint64(0), np.cumsum(own * self.power[:n], dtype=np.uint64)]

    def _same(self, a, b, length):
        return (self.sums[a + length] - self.sums[a]) * self.power[b - a] == self.sums[b + length] - self.sums[b]

    def ahead(self, a, b, most, back: bool = False):
        """For places a < b: agreeing values from these on, or before these, most at most."""
        got = np.zeros(len(a), dtype=np.int64)
        for k in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            step = 1 << k
            i = np.flatnonzero(got + step <= most)
            x, y = (a[i] - got[i] - step, b[i] - got[i] - step) if back else (a[i] + got[i], b[i] + got[i])
            got[i[self._same(x, y, step)]] += step
        return got


def _over_boundaries(words, triple, equal, start, left, size):
    """(number of the nonterminal, first word in it, length, period) of the runs over nonterminals' boundaries."""
    most = np.where(size >= SHORTEST, size // TIMES, 0)
    for side in (0, 1):
        q_most = np.minimum(most, left if side else size - left)
        ends = np.cumsum(q_most)
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CANDIDATES, side="right")))
            n = q_most[a:b]
            rule = np.repeat(np.arange(a, b), n)
            q = np.arange(len(rule)) - np.repeat(np.cumsum(n) - n, n) + 1
            begin, end = start[rule], start[rule] + size[rule]
            x = begin + left[rule] - (q if side else 0)  # x and x + q are compared
            # the run goes 3 words on or back from there at least, so a triple there repeats
            on = (x + q + 3 <= end) & (triple[np.minimum(x, len(triple) - 1)] == triple[np.minimum(x + q, len(triple) - 1)])
            back = (x - 3 >= begin) & (triple[np.maximum(x - 3, 0)] == triple[np.clip(x - 3 + q, 0, len(triple) - 1)])
            i = np.flatnonzero(on | back)
            rule, q, x, begin, end = rule[i], q[i], x[i], begin[i], end[i]
            r, l = equal.ahead(x, x + q, end - x - q), equal.ahead(x, x + q, x - begin, back=True)
            i = np.flatnonzero(l + r + q >= np.maximum(SHORTEST, TIMES * q))
            yield rule[i], (x - l - begin)[i], (l + r + q)[i], q[i]
            a = b


def _least_periods(start, size, q):
    """Of runs at one place with one length the one with the smallest period."""
    order = np.lexsort((q, size, start))
    start, size, q = start[order], size[order], q[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (size[1:] != size[:-1])][: len(q)]
    return start[new], size[new], q[new]


def _merged(start, size, q):
    """Maximal runs: pieces of one period that share a period's words are one run."""
    order = np.lexsort((start, q))
    start, end, q = start[order], (start + size)[order], q[order]
    far = int(end.max()) + 1
    group = np.cumsum(np.r_[False, q[1:] != q[:-1]])
    reach = np.maximum.accumulate(end + group * far) - group * far
    new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (start[1:] > reach[:-1] - q[1:])])
    last = np.r_[new[1:], len(start)] - 1
    return _least_periods(start[new], reach[last] - start[new], q[new])


def _exact(words, part, start, size, q) -> bool:
    for s, n, p in zip(start.tolist(), size.tolist(), q.tolist()):
        e = s + n
        if (words[s : e - p] != words[s + p : e]).any():
            return False
        if s and part[s - 1] == part[s] and words[s - 1] == words[s - 1 + p] or e < len(words) and part[e] == part[s] and words[e] == words[e - p]:
            return False
    return True


def runs(words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of all runs in a sequence of texts' word numbers, by first word and period; of: text of each word."""
    none = np.zeros(0, dtype=np.int64)
    stretches = likely(words, of)
    if not stretches:
        return none, none, none
    place = np.concatenate([np.arange(a, b) for a, b in stretches])
    part = np.repeat(np.arange(len(stretches)), [b - a for a, b in stretches])
    own = words[place]
    _, symbols = np.unique(part * (int(words.max()) + 1) + own, return_inverse=True)
    rule, start, left, size = _rules(symbols.astype(np.int64), part)
    _, first = np.unique(rule, return_index=True)
    by = np.argsort(rule, kind="stable")
    begin = np.searchsorted(rule[by], rule[first])
    count = np.searchsorted(rule[by], rule[first], side="right") - begin
    triple = _triples(own)
    for seed in range(8):
        found = list(_over_boundaries(own, triple, _Equal(symbols, seed), start[first], left[first], size[first]))
        which, inner, length, q = (np.concatenate(x) for x in zip(*found)) if found else (none,) * 4
        if not len(which):
            return none, none, none
        # of one nonterminal's runs at one place with one length, that of the smallest period
        order = np.lexsort((q, length, inner, which))
        which, inner, length, q = which[order], inner[order], length[order], q[order]
        new = np.r_[True, (which[1:] != which[:-1]) | (inner[1:] != inner[:-1]) | (length[1:] != length[:-1])]
        which, inner, length, q = which[new], inner[new], length[new], q[new]
        n = count[which]
        event = by[np.repeat(begin[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        s, length, q = _merged(start[event] + np.repeat(inner, n), np.repeat(length, n), np.repeat(q, n))
        if _exact(own, part, s, length, q):
            order = np.lexsort((q, s))
            return place[s[order]], length[order], q[order]
    raise RuntimeError("hashes of prefixes failed")


def _found(texts: list[bytes]):
    """(runs, text without repeats) of each text."""
    lists = [t.split() for t in texts]
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for ws in lists for w in ws], dtype=np.int64)
    sizes = np.array([len(ws) for ws in lists], dtype=np.int64)
    of = np.repeat(np.arange(len(lists)), sizes)
    begin = np.cumsum(sizes) - sizes
    start, length, q = runs(ids, of)
    text = of[start] if len(start) else start
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, start + q, 1)
    np.add.at(edge, start + length, -1)
    dropped = np.cumsum(edge)[:-1] > 0
    cuts = np.searchsorted(text, np.arange(len(lists) + 1))
    for k, ws in enumerate(lists):
        a, b = cuts[k], cuts[k + 1]
        if a == b:
            yield [], b" ".join(ws)
            continue
        own = dropped[begin[k] : begin[k] + sizes[k]].tolist()
        yield [{"start": s, "length": n, "period": p} for s, n, p in zip((start[a:b] - begin[k]).tolist(), length[a:b].tolist(), q[a:b].tolist())], b" ".join([w for w, d in zip(ws, own) if not d])


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with runs (start, length, period in words, by start, then period) and collapsed, the words that no run repeats, joined by a space.

    A run is a stretch of words with smallest period q, at least 6 and 4 q words long, that
    neither neighbour extends. Null text counts as empty: no runs, empty collapsed text. Very
    long texts are taken whole; work grows with words times their logarithm. Repeated rows and
    rows without an id stay, each alike. An empty table gives an empty one. Other columns pass
    through; columns named like the added ones are replaced.
    """
    docs = without(docs, "runs", "collapsed", "_runs")
    small_batches(docs.sparkSession)
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])

    def found(texts):
        import pyarrow as pa

        own, held, size = ([], []), [], 0

        def drain():
            for r, c in _found(held):
                own[0].append(r)
                own[1].append(c.decode("utf-8", "replace"))

        for t in text_bytes(texts):
            held.append(t or b"")
            size += len(held[-1])
            if size >= TOGETHER:
                drain()
                held, size = [], 0
        if held:
            drain()
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        return pa.StructArray.from_arrays([pa.array(own[0], type=kind), pa.array(own[1], type=pa.string())], names=["runs", "collapsed"])

    out = docs.withColumn("_runs", F.arrow_udf(found, T.StructType([T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())]))(F.col(text)))
    return out.select(*docs.columns, F.col("_runs.runs").alias("runs"), F.col("_runs.collapsed").alias("collapsed"))


def strongest(found: str = "runs") -> Column:
    """Of an array of runs in order of start and period the first with the greatest length by period; null if there is none."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), F.get(found, F.lit(0)), lambda a, b: F.when(more(b, a), b).otherwise(a))


def with_planted(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by the crc32 of its id, repeats its words with a period from some word on; a null
    id counts as an empty one."""
    ws = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    out = docs.withColumn("_h", h).withColumn("_w", F.when(F.col("_h") % 10 == 0, ws))
    g, n = F.floor(F.col("_h") / 10), F.size("_w")
    out = out.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
    word = lambda i: F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))
    again = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return out.withColumn("text", F.when(F.col("_a").isNotNull(), again).otherwise(F.col("text"))).drop("_h", "_w", "_a", "_p")
