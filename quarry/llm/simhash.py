"""SimHash near-duplicates, joined by Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into segments of 23, 23 and 18 bits. The perfect binary
Golay code of length 23 gives every segment the index of its one codeword within 3 bits;
a segment one bit away has the same index or one of the few indices of its neighbours,
so a stored segment has one key and an asking one has 1 or 6.

Pigeonhole: of two fingerprints with at most 3 differing bits, either each segment has
exactly one, or some segment has none and another at most one. So fingerprints meet on
(exact segment, Golay index of another), or on the Golay indices of the first two
segments with their parities flipped. Pairs that meet are verified on all 64 bits.

Groups of copies: equal fingerprints are one node. Neighbours in the order of (key,
fingerprint) are linked first, which joins most of a dense group by a number of links in
proportion to its size; a large key is spread over many tasks there. The join proper then
leaves out keys that hold one group only, and lets only pairs through that lie in different
groups so far. Links between different groups are all found, so components are exact.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_TABLE, checkpointed, small_batches, text_bytes, without
from .components import connected_components

BITS, NEAR, SEED, SHINGLE = 64, 3, 42, 3
#: (shift, bits) of the segments; the last is padded with zeros to 23 bits.
SEGMENTS = ((41, 23), (18, 23), (0, 18))
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
_GENERATOR = 0b101011100011
#: Shingles hashed at a time, so that a very long text needs no more memory.
_CHUNK = 50_000


def fingerprint(text: bytes) -> int:
    """Majority of the bits of XXH64 over 3-word shingles; 0 without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER_TABLE).split()
    n = len(words)
    if not n:
        return 0
    if n < SHINGLE:
        shingles, total = [b" ".join(words)], 1
    else:
        shingles, total = None, n - SHINGLE + 1
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, total, _CHUNK):
        own = shingles or [b"%b %b %b" % w for w in zip(words[at : at + _CHUNK], words[at + 1 : at + 1 + _CHUNK], words[at + 2 : at + 2 + _CHUNK])]
        h = np.array([xxh64_intdigest(s, SEED) for s in own], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprint_of(text: Column) -> Column:
    """Fingerprint, a signed 64-bit number. Null and wordless texts have 0."""

    def of(texts):
        import pyarrow as pa

        return pa.array([(f := fingerprint(t or b"")) - (f >> 63 << 64) for t in text_bytes(texts)], type=pa.int64())

    return F.arrow_udf(of, T.LongType())(text)


@lru_cache(maxsize=1)
def _tables():
    """(syndrome of the high 12 bits, of the low 11 bits, error pattern of each syndrome)."""
    import numpy as np

    def syndrome(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= _GENERATOR << (i - 11)
        return x

    high = np.array([syndrome(x << 11) for x in range(1 << 12)], dtype=np.int64)
    low = np.arange(1 << 11, dtype=np.int64)
    error = np.zeros(1 << 11, dtype=np.int64)
    bit = [1 << i for i in range(23)]
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                e = bit[i] | bit[j] | bit[k]
                error[syndrome(e)] = e
    return high, low, error


def golay_index(x):
    """Index (12 bits) of the codeword nearest to each 23-bit number of an array."""
    high, low, error = _tables()
    return (x ^ error[high[x >> 11] ^ low[x & 2047]]) >> 11


def near_indices(x):
    """(n, 24) indices of the words within one bit, sorted, repeats as -1."""
    import numpy as np

    flips = np.array([0, *[1 << i for i in range(23)]], dtype=np.int64)
    all_ = np.sort(golay_index(x[:, None] ^ flips[None, :]), axis=1)
    all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = -1
    return all_


def _segments(f):
    import numpy as np

    u = f.astype(np.int64).view(np.uint64)
    return [((u >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]


def _parity(x):
    x = x ^ (x >> 16)
    x = x ^ (x >> 8)
    x = x ^ (x >> 4)
    x = x ^ (x >> 2)
    return (x ^ (x >> 1)) & 1


#: Ordered pairs (exact segment, Golay segment); the number of the pair is the key's case.
_PAIRS = tuple((i, j) for i in range(3) for j in range(3) if i != j)


def stored_keys(f):
    """(n, 7) keys under which fingerprints are stored."""
    import numpy as np

    seg = _segments(f)
    idx = [golay_index(s) for s in seg]
    out = [(k << 40) | (seg[i] << 12) | idx[j] for k, (i, j) in enumerate(_PAIRS)]
    par = (_parity(seg[0]) << 2) | (_parity(seg[1]) << 1) | _parity(seg[2])
    out.append((6 << 40) | (par << 24) | (idx[0] << 12) | idx[1])
    return np.stack(out, axis=1)


def asked_keys(f):
    """(rows, keys): the keys that fingerprints ask for, by row number."""
    import numpy as np

    seg = _segments(f)
    near = [near_indices(s) for s in seg]
    rows, keys = [], []
    for k, (i, j) in enumerate(_PAIRS):
        r, c = np.nonzero(near[j] >= 0)
        rows.append(r)
        keys.append((k << 40) | (seg[i][r] << 12) | near[j][r, c])
    par = ((_parity(seg[0]) << 2) | (_parity(seg[1]) << 1) | _parity(seg[2])) ^ 7
    r, c = np.nonzero(near[0] >= 0)
    one = near[0][r, c]
    for d in range(24):
        own = near[1][r, d]
        ok = own >= 0
        rows.append(r[ok])
        keys.append((6 << 40) | (par[r[ok]] << 24) | (one[ok] << 12) | own[ok])
    return np.concatenate(rows), np.concatenate(keys)


def _stored(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        f, root = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(f):
            continue
        keys = stored_keys(f)
        yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(f, keys.shape[1])), pa.array(np.repeat(root, keys.shape[1]))], names=["key", "f", "root"])


def _asked(batches):
    import pyarrow as pa

    for b in batches:
        f, root = b.column(0).to_numpy(), b.column(1).to_numpy()
        for at in range(0, len(f), 2000):  # about 60 keys each
            own = f[at : at + 2000]
            rows, keys = asked_keys(own)
            yield pa.record_batch([pa.array(keys), pa.array(own[rows]), pa.array(root[at : at + 2000][rows])], names=["key", "g", "g_root"])


def _neighbours(batches):
    """Links between rows that follow each other, within a key."""
    import numpy as np
    import pyarrow as pa

    last = None
    for b in batches:
        key, f = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(f):
            continue
        if last is not None:
            key, f = np.concatenate([last[0], key]), np.concatenate([last[1], f])
        last = key[-1:].copy(), f[-1:].copy()
        x = (f[1:] ^ f[:-1]).view(np.uint64)
        bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1) if len(x) else np.zeros(0)
        near = (key[1:] == key[:-1]) & (bits <= NEAR) & (x != 0)
        yield pa.record_batch([pa.array(np.minimum(f[1:], f[:-1])[near]), pa.array(np.maximum(f[1:], f[:-1])[near])], names=["a", "b"])


def near_links(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((f, root), (root_a, root_b, f, g)): groups by links between neighbours, and one link at
    most 3 bits long between any two groups that have one. fps: distinct `f`.
    """
    keyed = "key long, f long, root long"
    stored = checkpointed(fps.select("f", F.col("f").alias("root")).mapInArrow(_stored, keyed).select("key", "f"))
    # neighbours in three orders of the bits, so that differences in any part of the word come together
    first = None
    for turn in (0, 21, 43):
        turned = F.shiftleft("f", turn).bitwiseOR(F.shiftrightunsigned("f", 64 - turn)) if turn else F.col("f")
        own = stored.withColumn("t", turned).repartitionByRange("key", "t").sortWithinPartitions("key", "t").select("key", "f").mapInArrow(_neighbours, "a long, b long")
        first = own if first is None else first.union(own)
    root = connected_components(first)
    grouped = checkpointed(fps.join(root, fps["f"] == root["node"], "left").select("f", F.coalesce("root", "f").alias("root")))
    s, a = grouped.mapInArrow(_stored, keyed), grouped.mapInArrow(_asked, "key long, g long, g_root long")
    # where a key holds one group only, nobody of that group asks: links that are already there are not found again
    held = s.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    a = a.join(held, "key").where((F.col("low") != F.col("high")) | (F.col("g_root") != F.col("low"))).select("key", "g", "g_root")
    found = s.join(a, "key").where((F.col("root") != F.col("g_root")) & (F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= NEAR))
    found = found.groupBy(F.least("root", "g_root").alias("root_a"), F.greatest("root", "g_root").alias("root_b")).agg(F.min(F.struct("f", "g")).alias("l"))
    return grouped, checkpointed(found.select("root_a", "root_b", "l.f", "l.g"))


def near_duplicates(docs: DataFrame, text: str = "text", group: str | None = None) -> DataFrame:
    """docs without their text, with fingerprint (signed 64 bits) and component_id, the smallest
    doc_id that links of at most 3 differing bits reach.

    Texts are read once and don't move; join a key of docs with them to have them again.
    group: name of a further column with a fingerprint that stands for the component, which
    tells components apart even where rows repeat a doc_id or have none.

    Fingerprints alone decide: texts without words (null too) have fingerprint zero and
    are linked like any other. Very long texts are hashed whole, in parts. Repeated rows have
    the same component. Null doc_ids are never a component's id unless all its ids are null.
    An empty table gives an empty one. Input columns named like the added ones are replaced.
    """
    docs = without(docs, "fingerprint", "component_id", *([group] if group else []))
    small_batches(docs.sparkSession)
    return linked(checkpointed(docs.withColumn("fingerprint", fingerprint_of(F.col(text))).drop(text)), group)


def linked(marked: DataFrame, group: str | None = None) -> DataFrame:
    """marked (doc_id, fingerprint, ...) with component_id and, if asked for, the column `group`."""
    slim = checkpointed(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("low")))
    roots = component_roots(slim).withColumnsRenamed({"f": "_fingerprint", "top": group or "top"})
    return marked.join(roots, marked["fingerprint"] == roots["_fingerprint"]).select(*[marked[c] for c in marked.columns], "component_id", *([group] if group else []))


def component_roots(slim: DataFrame) -> DataFrame:
    """(f, top, component_id) of (fingerprint, low: its smallest doc_id); top is a fingerprint for each component."""
    grouped, links = near_links(slim.select(F.col("fingerprint").alias("f")))
    above = connected_components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).withColumnRenamed("root", "top")
    own = grouped.join(above, grouped["root"] == above["node"], "left").select("f", F.coalesce("top", grouped["root"]).alias("top"))
    low = slim.join(own, slim["fingerprint"] == own["f"]).groupBy("top").agg(F.min("low").alias("component_id"))
    return own.join(low, "top").select("f", "top", "component_id")
