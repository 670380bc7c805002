"""Removal of byte strings that an earlier document has, by suffix arrays of shards.

Of a text's windows of 50 bytes each is named by the least of its 20-byte grams (by hash), so
equal windows have equal grams, and neighbouring windows mostly share one, their anchor. A
first exchange of anchors' hashes finds those of several documents. A second one brings
the stretches of text around these to shards by anchor. In a shard, stretches that share an
anchor and differ are suffix-sorted (`induced`): windows of a common prefix of 50 bytes are
equal, and the smallest document among them is the one that keeps the bytes.

Records travel packed, a few rows for each task and shard; texts don't move. Of the documents
that share a whole stretch in a task all but the smallest lose it there and then (two hashes of
64 bits tell stretches apart), and only that one is sent. An anchor of many contents goes
window by window, to shards by content, so that contexts without number of one common gram
are spread.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, small_batches, text_bytes, without
from .induced import suffixes
from .line_templates import doc_key

#: Bytes of a string that counts, and of an anchor's gram.
LENGTH, GRAM = 50, 20


@dataclass(frozen=True)
class Sizes:
    """Bounds of memory; results don't depend on them."""

    #: Bytes of text that a task reads before it sends its records, that are hashed at once (half), and that a shard stands for, about.
    flush: int = 16 << 20
    piece: int = 1 << 20
    shard: int = 32 << 20
    #: An anchor of so many contents in a task, or of so many tasks' contents, is sent window by window.
    hot: int = 32
    hot_all: int = 4096
    #: Stretches of text that a task sends at once.
    strings: int = 200_000
    #: Entries of a shard's suffix queue, and suffixes of its sample, that are held in memory.
    held: int = 4_000_000


#: Bytes of marks or spans up to which these, and not the texts, are copied to all executors.
BROADCAST = 32 << 20
#: Bytes of texts that are suffix-sorted together, about.
LOT = 1 << 20
_HOT_BIT, _SOLVED_BIT = np.uint32(1 << 31), np.uint32(1 << 30)
_BASE = np.uint64(0xD1342543DE82EF95)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * _MIX + b
    return x ^ (x >> np.uint64(32))


def _gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram at each place, put together from those of powers of two."""
    out, used, power, m = None, 0, values, 1
    n = max(0, len(values) - gram + 1)
    while used < gram:
        if gram & m:
            out = power[:n] if out is None else out * _BASE + power[used : used + n]
            used += m
        if used < gram:
            low = power[: max(0, len(power) - m)] * (_MIX + np.uint64(2 * m))
            low += power[m:]
            power, m = low, 2 * m
    return _mixed(out, np.uint64(gram))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m = 1
    while 2 * m <= width:
        x, m = np.minimum(x[: max(0, len(x) - m)], x[m:]), 2 * m
    return np.minimum(x[: max(0, len(x) - (width - m))], x[width - m :]) if m < width else x


def _stretches(pieces: list[bytes], contents: bool):
    """(piece, first window, last window, anchor's place, anchor's hash, content's hash if asked for) of the windows in a row with one anchor."""
    text = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces])
    begin = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(pieces)), sizes)
    values = _RANDOM[text]
    h = _gram_hashes(values, GRAM)
    low = np.uint64((1 << 24) - 1)
    least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1)
    at = (least & low).astype(np.int64)
    inside = of[: len(at)] == of[LENGTH - 1 :]  # windows over the end of a piece are none
    change = at[1:] != at[:-1]
    first = np.flatnonzero(inside & np.r_[True, change | ~inside[:-1]])
    last = np.flatnonzero(inside & np.r_[change | ~inside[1:], True])
    piece, content = of[first], first
    if contents:  # the sum of place's power times byte, moved to one place
        n = len(text)
        power = np.multiply.accumulate(np.full(n, _BASE, dtype=np.uint64))
        values *= power
        sums = np.r_[np.uint64(0), np.cumsum(values, dtype=np.uint64)]
        content = _mixed((sums[last + LENGTH] - sums[first]) * power[n - 1 - first], (last - first).astype(np.uint64))
    return piece, first - begin[piece], last - begin[piece], at[first] - begin[piece], h[at[first]], content


def _read_anchors(docs, piece: int, contents: bool = True):
    """For documents (doc, row, text, further), in batches: their list, and arrays (place in the list, number of the
    stretch in its document, first window, last window, anchor's place, its hash, the content's). Long texts are read
    in pieces that share LENGTH - 1 bytes, so every window is in one."""
    held, counted, place, shift, pieces, size = [], [], [], [], [], 0

    def drained():
        p, first, last, at, h, content = _stretches(pieces, contents)
        where, by = np.array(place)[p], np.array(shift)[p]
        begin = np.flatnonzero(np.r_[True, where[1:] != where[:-1]][: len(where)])
        n = np.diff(np.r_[begin, len(where)])
        number = np.arange(len(where)) - np.repeat(begin, n) + np.array(counted, dtype=np.int64)[where]
        for w, k in zip(where[begin].tolist(), n.tolist()):
            counted[w] += k
        return list(held), where, number, first + by, last + by, at + by, h, content

    for doc, row, text, more in docs:
        held.append((doc, row, text, more))
        counted.append(0)
        for a in range(0, len(text) - LENGTH + 1, piece):
            pieces.append(text[a : a + piece + LENGTH - 1])
            place.append(len(held) - 1)
            shift.append(a)
            size += len(pieces[-1])
            if size >= 2 * piece:
                yield drained()
                held, counted = held[-1:], counted[-1:]  # the document may go on
                place, shift, pieces, size = [], [], [], 0
    if pieces:
        yield drained()


def _rows_of(batches):
    """(doc, row, text as bytes, further column or None) of Arrow batches."""
    for b in batches:
        doc, row = b.column(0).to_pylist(), b.column(1).to_pylist()
        more = b.column(3).to_pylist() if b.num_columns > 3 else [None] * len(doc)
        for d, r, t, m in zip(doc, row, text_bytes(b.column(2)), more):
            if t and len(t) >= LENGTH:
                yield d, r, t, m


def _packed(x, kind) -> bytes:
    """Numbers by planes of their bytes: upper ones are mostly zero, which compresses."""
    x = np.ascontiguousarray(x, dtype=kind)
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _numbers(packed: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _short(x: np.ndarray) -> bytes:
    """48 bits of each hash; two hashes and the shard tell contents apart."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint16).reshape(-1, 4)[:, :3]).tobytes()


def _long(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 4), dtype=np.uint16)
    out[:, :3] = np.frombuffer(packed, dtype=np.uint16).reshape(-1, 3)
    return out.view(np.uint64).reshape(-1)


_ANCHORS = "shard int, docs binary, keys binary, contents binary, at binary, number binary, known_at binary, known binary, solved_at binary, solved binary"
_FOUND = "bucket int, docs binary, mark_at binary, marks binary, span_at binary, spans binary"
_TEXTS = "shard int, docs binary, texts binary, sizes binary, anchor binary, at binary, place binary, solved_at binary, solved binary"
_BY_DOCUMENT = "doc long, row long, marks binary, spans binary"


def _sent(schema: str, rows: list[dict]):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array([r[n] for r in rows], type=kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def _shares(*kinds: tuple[np.ndarray, np.ndarray]):
    """(shard, the ones of each kind that go there) for all shards that get some; a kind: (ones, their shards)."""
    kinds = [(x[by], of[by]) for x, of in kinds for by in (np.argsort(of, kind="stable"),)]
    for s in np.unique(np.concatenate([of for _, of in kinds])).tolist():
        yield s, *(x[slice(*np.searchsorted(of, (s, s + 1)))] for x, of in kinds)


def _anchor_sender(shards: int, sizes: Sizes):
    """Sends, for each anchor and content, the places in the smallest document of the task; the others lose the stretch at once."""

    def flushed(own: list, parts: list):
        ids = np.array(own, dtype=np.int64).reshape(-1, 2)
        at, number, first, end, key, content = (np.concatenate(x) for x in zip(*parts))
        doc = ids[at, 0]
        order = np.lexsort((number, doc, content, key))
        at, number, first, end, key, content, doc = (x[order] for x in (at, number, first, end, key, content, doc))
        new_key = np.r_[True, key[1:] != key[:-1]]
        new = new_key | np.r_[True, content[1:] != content[:-1]]
        lowest = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        lead, group = doc == lowest, np.cumsum(new_key) - 1
        hot = np.bincount(group, weights=new)[group] >= sizes.hot
        number = np.where(hot, number | int(_HOT_BIT), number).astype(np.uint32)
        # spans that are known now, joined where they touch
        solved = np.flatnonzero(~lead)
        solved = solved[np.lexsort((first[solved], at[solved]))]
        starts = np.flatnonzero(np.r_[True, (at[solved][1:] != at[solved][:-1]) | (first[solved][1:] > end[solved][:-1])][: len(solved)])
        span_at, spans = at[solved[starts]], np.stack([first[solved[starts]], end[solved[np.r_[starts[1:], len(solved)] - 1]] if len(starts) else starts], axis=1).astype(np.uint32)
        # an anchor of many contents is made known here, and sent once
        send, known, rows = np.flatnonzero(lead & (~hot | new_key)), np.flatnonzero(lead & hot), []
        for s, x, y, z in _shares((send, (key[send] % np.uint64(shards)).astype(np.int64)), (known, at[known] % shards), (np.arange(len(span_at)), span_at % shards)):
            x = x[np.argsort(at[x], kind="stable")]
            used, place = np.unique(np.r_[at[x], at[y], span_at[z]], return_inverse=True)
            a, b, c = np.split(place, (len(x), len(x) + len(y)))
            rows.append({"shard": s, "docs": _packed(ids[used], np.int64), "keys": _short(key[x] // np.uint64(shards)), "contents": _short(content[x]), "at": _packed(a, np.uint32), "number": _packed(number[x], np.uint32), "known_at": _packed(b, np.uint32), "known": _packed(number[y], np.uint32), "solved_at": _packed(c, np.uint32), "solved": _packed(spans[z], np.uint32)})
        return _sent(_ANCHORS, rows)

    def send(batches):
        own, parts, size = [], [], 0
        for held, where, number, first, last, _, h, content in _read_anchors(_rows_of(batches), sizes.piece):
            parts.append((where + len(own), number, first, last + LENGTH, h, content))
            own += [(d, r) for d, r, _, _ in held]
            size += 2 * sizes.piece
            if size >= sizes.flush:
                yield flushed(own, parts)
                own, parts, size = [], [], 0
        if parts:
            yield flushed(own, parts)

    return send


def _found_rows(docs: np.ndarray, marks: tuple | None, spans: list[tuple], buckets: int):
    """Marks and spans, as (places in docs, values), in a row for each bucket of documents."""
    import pyarrow as pa

    mark_at, mark = marks if marks else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32))
    span_at, span = np.concatenate([a for a, _ in spans]).astype(np.int64), np.concatenate([np.asarray(v, dtype=np.uint32).reshape(-1, 2) for _, v in spans])
    bucket, rows = docs[:, 1] % buckets, []
    for s, x, y in _shares((np.arange(len(mark_at)), bucket[mark_at]), (np.arange(len(span_at)), bucket[span_at])) if len(mark_at) + len(span_at) else ():
        used, at = np.unique(np.r_[mark_at[x], span_at[y]], return_inverse=True)
        rows.append({"bucket": s, "docs": _packed(docs[used], np.int64), "mark_at": _packed(at[: len(x)], np.uint32), "marks": _packed(mark[x], np.uint32), "span_at": _packed(at[len(x) :], np.uint32), "spans": _packed(span[y], np.uint32)})
    return pa.Table.from_batches([_sent(_FOUND, rows)])


def _runs_of(of: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first, end) of the stretches of equal values."""
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
    return list(zip(of[first].tolist(), first.tolist(), np.r_[first[1:], len(of)].tolist()))


def _gather_documents(table):
    """A row for each document of a bucket: its marks, each once, compressed, and its spans, joined where they touch."""
    import pyarrow as pa

    docs, before = _docs_of(table)
    own, place = np.unique(docs, axis=0, return_inverse=True)
    place = place.reshape(-1)
    mark_at, mark = place[_unpacked(table, "mark_at", np.uint32, before)], _unpacked(table, "marks", np.uint32)
    span_at, span = place[_unpacked(table, "span_at", np.uint32, before)], _unpacked(table, "spans", np.uint32).reshape(-1, 2)
    rows = [{"doc": d, "row": r, "marks": None, "spans": None} for d, r in own.tolist()]
    by = np.unique((mark_at.astype(np.uint64) << np.uint64(32)) | mark)
    mark = (by & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for d, a, b in _runs_of((by >> np.uint64(32)).astype(np.int64)):
        rows[d]["marks"] = zlib.compress(_packed(np.diff(mark[a:b], prepend=np.uint32(0)), np.uint32), 1)
    order = np.lexsort((span[:, 0], span_at))
    span_at, span = span_at[order], span[order].astype(np.int64)
    far = int(span.max(initial=0)) + 1
    reach = np.maximum.accumulate(span[:, 1] + span_at * far) - span_at * far if len(span) else span[:, 1]
    new = np.flatnonzero(np.r_[True, (span_at[1:] != span_at[:-1]) | (span[1:, 0] > reach[:-1])][: len(span)])
    joined = np.stack([span[new, 0], reach[np.r_[new[1:], len(span)] - 1]], axis=1).astype(np.uint32) if len(new) else span.astype(np.uint32)
    for d, a, b in _runs_of(span_at[new]):
        rows[d]["spans"] = joined[a:b].tobytes()
    return pa.Table.from_batches([_sent(_BY_DOCUMENT, rows)])


def _unpacked(table, name: str, kind, docs_before=None) -> np.ndarray:
    """A packed column's values, all rows together; with docs_before, places are counted on from row to row."""
    parts = [_numbers(x, kind) for x in table.column(name).to_pylist()]
    if docs_before is not None:
        parts = [p.astype(np.int64) + d for p, d in zip(parts, docs_before)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def _docs_of(table):
    parts = [_numbers(x, np.int64).reshape(-1, 2) for x in table.column("docs").to_pylist()]
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])[:-1]


def _mark_shared(table, hot_all: int, buckets: int):
    """By document the stretches that a smaller one has as well, those that may share windows with another one, and spans that are known."""
    docs, before = _docs_of(table)
    key, content = (np.concatenate([_long(x) for x in table.column(c).to_pylist()]) for c in ("keys", "contents"))
    at, number = _unpacked(table, "at", np.uint32, before), _unpacked(table, "number", np.uint32)
    known = (_unpacked(table, "known_at", np.uint32, before), _unpacked(table, "known", np.uint32))
    marks = known
    if len(key):
        doc = docs[at, 0]
        order = np.lexsort((doc, content, key))
        key, content, at, number, doc = (x[order] for x in (key, content, at, number, doc))
        new_key = np.r_[True, key[1:] != key[:-1]]
        new = new_key | np.r_[True, content[1:] != content[:-1]]
        solved = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        starts = np.flatnonzero(new_key)
        size = np.diff(np.r_[starts, len(key)])
        spread = lambda x: np.repeat(x, size)
        contents = np.add.reduceat(new.astype(np.int64), starts)
        hot = (np.bitwise_or.reduceat(number, starts) & _HOT_BIT != 0) | (contents >= hot_all)
        several = (contents > 1) & (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts))
        number = np.where(solved, (number & ~_HOT_BIT) | _SOLVED_BIT, np.where(spread(hot), number | _HOT_BIT, number))
        wanted = solved | spread(several | hot)
        marks = (np.r_[at[wanted], known[0]], np.r_[number[wanted], known[1]])
    return _found_rows(docs, marks, [(_unpacked(table, "solved_at", np.uint32, before), _unpacked(table, "solved", np.uint32))], buckets)


def _marks_of(packed: bytes) -> np.ndarray:
    return np.cumsum(_numbers(zlib.decompress(packed), np.uint32), dtype=np.uint32)


def _text_sender(shards: int, sizes: Sizes):
    """Sends the stretches at marked anchors, or each window of them; of solved ones the span."""

    def flushed(ids: list, found: list, solved: list):
        ids, rows = np.array(ids, dtype=np.int64).reshape(-1, 2), []
        shard, spans = np.array([f[0] for f in found], dtype=np.int64), np.array(solved, dtype=np.int64).reshape(-1, 3)
        for s, x, y in _shares((np.arange(len(found)), shard), (np.arange(len(spans)), spans[:, 0] % shards)):
            own = sorted((found[i] for i in x.tolist()), key=lambda f: f[1])  # like texts compress well side by side
            used, at = np.unique(np.r_[np.array([f[3] for f in own], dtype=np.int64), spans[y, 0]], return_inverse=True)
            rows.append({"shard": s, "docs": _packed(ids[used], np.int64), "texts": zlib.compress(b"".join(f[1] for f in own), 1), "sizes": _packed([len(f[1]) for f in own], np.uint32), "anchor": _packed([f[2] for f in own], np.uint32), "at": _packed(at[: len(own)], np.uint32), "place": _packed([f[4] for f in own], np.uint32), "solved_at": _packed(at[len(own) :], np.uint32), "solved": _packed(spans[y, 1:], np.uint32)})
        return _sent(_TEXTS, rows)

    def send(batches):
        ids, found, solved = [], [], []
        for held, where, number, first, last, at, h, _ in _read_anchors(_rows_of(batches), sizes.piece, contents=False):
            begin = np.searchsorted(where, np.arange(len(held) + 1))
            for k, (doc, row, text, own) in enumerate(held):
                a, b = begin[k], begin[k + 1]
                marks = _marks_of(own)
                chosen = lambda of: np.flatnonzero(np.isin(number[a:b], of)) + a if len(of) else np.zeros(0, dtype=np.int64)  # noqa: B023, E731
                i = chosen(marks[marks & _SOLVED_BIT != 0] ^ _SOLVED_BIT)
                if len(i):  # spans that touch are one
                    cut = np.r_[True, first[i][1:] > last[i][:-1] + LENGTH]
                    solved += [(len(ids), x, y) for x, y in zip(first[i[cut]].tolist(), (last[i[np.r_[cut[1:], True]]] + LENGTH).tolist())]
                for numbers, is_hot in ((marks[marks < _SOLVED_BIT], False), (marks[marks >= _HOT_BIT] ^ _HOT_BIT, True)):
                    i = chosen(numbers)
                    for f, g, x, shard in zip(first[i].tolist(), last[i].tolist(), at[i].tolist(), (h[i] % np.uint64(shards)).tolist()):
                        if is_hot:
                            found += [(zlib.crc32(w) % shards, w, LENGTH, len(ids), p) for p in range(f, g + 1) for w in (text[p : p + LENGTH],)]
                        else:
                            found.append((shard, text[f : g + LENGTH], x - f, len(ids), f))
                ids.append((doc, row))
                if len(found) + len(solved) >= sizes.strings:
                    yield flushed(ids, found, solved)
                    ids, found, solved = [], [], []
        if found or solved:
            yield flushed(ids, found, solved)

    return send


def _lowest(texts: list[bytes], low: np.ndarray, begin: np.ndarray, n_windows: int, held: int) -> np.ndarray:
    """For all windows of some texts, each with its smallest document, the smallest document that has the window.
    begin: the number of each text's first window."""
    out = np.empty(n_windows, dtype=np.int64)
    joined = np.frombuffer(b"\0".join(texts) + b"\0\0", dtype=np.uint8)
    symbols = np.cumsum(np.bincount(joined, minlength=256) > 0) + 1  # those in use, from 2
    joined = symbols[joined].astype(np.uint16)
    sizes = np.array([len(x) for x in texts])
    at = np.cumsum(sizes + 1) - sizes - 1
    joined[at + sizes], joined[-1] = 1, 0
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    pending: list[np.ndarray] = []  # of the windows that may go on in the next block

    def settle():
        place = np.concatenate(pending)
        text = of[place]
        inside = place - at[text]
        whole = inside <= sizes[text] - LENGTH
        if whole.any():
            out[(begin[text] + inside)[whole]] = low[text[whole]].min()

    for block in suffixes(joined, int(symbols[-1]) + 1, LENGTH, held):
        block = block[block["pos"] < len(of)]
        cuts = np.flatnonzero(block["lcp"] < LENGTH)
        if len(cuts) and pending:
            pending.append(block["pos"][: cuts[0]])
            settle()
            pending = []
        if not len(cuts):
            pending.append(block["pos"])
            continue
        body = block["pos"][cuts[0] : cuts[-1]]
        if len(body):
            text = of[body]
            inside = body - at[text]
            least = np.minimum.reduceat(np.where(inside <= sizes[text] - LENGTH, low[text], np.iinfo(np.int64).max), cuts[:-1] - cuts[0])
            least = np.repeat(least, np.diff(cuts))
            whole = inside <= sizes[text] - LENGTH
            out[(begin[text] + inside)[whole]] = least[whole]
        pending = [block["pos"][cuts[-1] :]]
    if pending:
        settle()
    return out


def _settle_shard(table, held: int, buckets: int):
    """Spans to remove, by document."""
    docs, before = _docs_of(table)
    at, place = _unpacked(table, "at", np.uint32, before), _unpacked(table, "place", np.uint32).astype(np.int64)
    number: dict[bytes, int] = {}
    anchor, of = [], []
    for joined, sizes, anchors in zip(*(table.column(c).to_pylist() for c in ("texts", "sizes", "anchor"))):
        joined, ends = zlib.decompress(joined), np.cumsum(_numbers(sizes, np.uint32)).tolist()
        mine = np.empty(len(ends), dtype=np.int64)
        for i, (a, b, x) in enumerate(zip([0, *ends], ends, _numbers(anchors, np.uint32).tolist())):
            mine[i] = number.setdefault(joined[a:b], len(number))
            if mine[i] == len(anchor):
                anchor.append(x)
        of.append(mine)
    of, texts = np.concatenate(of), list(number)
    found = [(_unpacked(table, "solved_at", np.uint32, before), _unpacked(table, "solved", np.uint32))]
    if texts:
        low = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(low, of, docs[at, 0])
        windows = np.array([len(t) for t in texts]) - LENGTH + 1
        begin = np.cumsum(windows) - windows
        lowest = np.repeat(low, windows)
        grams = [t[a : a + GRAM] if a < LENGTH else None for t, a in zip(texts, anchor)]
        many: dict[bytes | None, int] = {}
        for g in grams:
            many[g] = many.get(g, 0) + 1
        compare = np.array([i for i, g in enumerate(grams) if g is not None and many[g] > 1], dtype=np.int64)
        # texts of one anchor stay together; each lot of them has a suffix array
        compare = compare[np.argsort([zlib.crc32(grams[i]) for i in compare], kind="stable")] if len(compare) else compare
        held_bytes, lot = 0, []
        for k, i in enumerate(compare.tolist()):
            lot.append(i)
            held_bytes += len(texts[i])
            ends = k + 1 == len(compare) or grams[i] != grams[compare[k + 1]]
            if ends and (held_bytes >= LOT or k + 1 == len(compare)):
                n = windows[lot]
                own = np.cumsum(n) - n
                lowest[np.repeat(begin[lot] - own, n) + np.arange(n.sum())] = _lowest([texts[i] for i in lot], low[lot], own, int(n.sum()), held)
                held_bytes, lot = 0, []
        # a row for each window of each place
        n = windows[of]
        first = np.cumsum(n) - n
        inside = np.arange(n.sum()) - np.repeat(first, n)
        gone = lowest[np.repeat(begin[of], n) + inside] < np.repeat(docs[at, 0], n)
        starts = np.flatnonzero(gone & (np.r_[True, ~gone[:-1]] | (inside == 0)))
        ends = np.flatnonzero(gone & (np.r_[~gone[1:], True] | np.r_[inside[1:] == 0, True]))
        owner = np.repeat(np.arange(len(of)), n)[starts]
        spans = np.stack([place[owner] + inside[starts], place[owner] + inside[ends] + LENGTH], axis=1).astype(np.uint32)
        found.append((at[owner], spans))
    return _found_rows(docs, None, found, buckets)


def _cut(texts, spans):
    """(spans, kept): maximal spans and what is left."""
    import pyarrow as pa

    lists, kept = [], []
    for t, packed in zip(text_bytes(texts), spans.to_pylist()):
        if not packed:
            lists.append(None)
            kept.append(None)
            continue
        s = np.concatenate([np.frombuffer(x, dtype=np.uint32).reshape(-1, 2) for x in packed]).astype(np.int64)
        s = s[np.argsort(s[:, 0], kind="stable")]
        reach = np.maximum.accumulate(s[:, 1])
        new = np.flatnonzero(np.r_[True, s[1:, 0] > reach[:-1]])
        a, b = s[new, 0].tolist(), reach[np.r_[new[1:] - 1, len(s) - 1]].tolist()
        lists.append([{"start": x, "end": y} for x, y in zip(a, b)])
        kept.append(b"".join(t[x:y] for x, y in zip([0, *b], [*a, len(t)])))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.StructArray.from_arrays([pa.array(lists, type=pa.list_(span)), pa.array(kept, type=pa.binary())], names=["spans", "kept"])


def _ordered_ids(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs, and its doc_id as a long to order by: null last; text is numbered in its order."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return docs, doc_key(docs)
    ids = checkpointed(docs.select(doc_key(docs).alias("_id")).distinct().orderBy("_id").withColumn("_doc", F.monotonically_increasing_id()))
    return docs.withColumn("_id", doc_key(docs)).join(ids, "_id"), F.col("_doc")


def remove_repeats(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """docs with spans (start, end: bytes to remove) and kept, the bytes that are left.

    Rows that share a doc_id are one document, as are all rows without one, the last; a document
    loses nothing for its own rows' sake. Ids that are no whole numbers are ordered as text. Null
    text counts as empty; texts of under 50 bytes lose nothing and have null spans, as have all
    that keep everything. Very long texts are read in pieces. An empty table gives an empty one.
    Other columns pass through; columns named like the added ones are replaced.
    """
    docs = without(docs, "spans", "kept", "_doc", "_row", "_id", "_cut", "_spans")
    names = docs.columns
    spark = docs.sparkSession
    small_batches(spark)
    keyed, doc = _ordered_ids(docs)
    # row tells rows of one doc_id apart
    keyed = keyed.withColumns({"_doc": doc, "_row": F.xxhash64("text")})
    slim = keyed.select(F.col("_doc").alias("doc"), F.col("_row").alias("row"), "text")
    size = slim.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // sizes.shard))

    def hint(df: DataFrame, size: Column) -> DataFrame:
        return F.broadcast(df) if (df.agg(F.sum(size + 64)).first()[0] or 0) <= BROADCAST else df

    gathered = lambda df: checkpointed(df.groupBy("bucket").applyInArrow(_gather_documents, _BY_DOCUMENT))
    anchors = slim.mapInArrow(_anchor_sender(shards, sizes), _ANCHORS)
    shared = gathered(anchors.groupBy("shard").applyInArrow(lambda t: _mark_shared(t, sizes.hot_all, shards), _FOUND))
    marks = hint(shared.where("marks IS NOT NULL").select("doc", "row", "marks"), F.octet_length("marks"))
    sent = slim.join(marks, ["doc", "row"]).select("doc", "row", "text", "marks").mapInArrow(_text_sender(shards, sizes), _TEXTS)
    found = gathered(sent.groupBy("shard").applyInArrow(lambda t: _settle_shard(t, sizes.held, shards), _FOUND))
    both = found.select("doc", "row", "spans").union(shared.where("spans IS NOT NULL").select("doc", "row", "spans"))
    spans = both.groupBy("doc", "row").agg(F.collect_list("spans").alias("spans"))
    spans = hint(spans, F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    cut = F.arrow_udf(_cut, T.StructType([T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())]))
    out = keyed.join(spans.select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), F.col("spans").alias("_spans")), ["_doc", "_row"], "left")
    out = out.withColumn("_cut", cut(F.when(F.col("_spans").isNotNull(), F.col("text")), F.col("_spans")))
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select(*names, F.col("_cut.spans").alias("spans"), F.coalesce(F.col("_cut.kept"), whole).alias("kept"))


#: The query's rows: bytes are pairs of hexadecimal digits.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, {(1 << 63) - 1}) AS doc, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT rid, doc, o, substr(h, 2 * o + 1, {2 * (500 + LENGTH - 1)}) AS h FROM (SELECT rid, doc, h, unnest(range(0, length(h) // 2 - {LENGTH - 1}, 500)) AS o FROM d)),
w AS (SELECT rid, doc, o + i AS i, substr(h, 2 * i + 1, {2 * LENGTH}) AS g FROM (SELECT rid, doc, o, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM c)),
f AS (SELECT g, min(doc) AS first FROM w GROUP BY g HAVING min(doc) < max(doc)),
gone AS (SELECT rid, i FROM w JOIN f USING (g) WHERE doc > first),
n AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM gone),
s AS (SELECT rid, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS k FROM n) GROUP BY rid, k),
k AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM s),
p AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS left FROM k JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE p.left || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN p USING (rid)
"""
