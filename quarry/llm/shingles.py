"""Near copies by shingles: texts of which at least 80 % of the 5-word shingles are common.

Candidates meet in bands of min-hashes (two texts of similarity 0.8 miss each other in all
bands once in 30,000); in each band all texts meet the one with the smallest key only, so
that pairs stay in proportion to texts, and every pair is confirmed on the shingles
themselves. Links are closed by connected components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_TABLE, checkpointed, text_bytes
from .components import connected_components

#: Words of a shingle, and the least share of common ones (Jaccard).
SHINGLE, SIMILAR = 5, 0.8
#: Bands and min-hashes of a band.
BANDS, ROWS, SEED = 20, 4, 7
#: Up to so many rows with a candidate are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 300_000
_CHUNK = 2_000


def shingle_hashes(text: bytes):
    """Distinct 64-bit hashes of a text's shingles (A-Z lower-cased); of all words if there are fewer."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER_TABLE).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    own = {xxh64_intdigest(b" ".join(words[k : k + SHINGLE]), SEED) for k in range(max(1, len(words) - SHINGLE + 1))}
    return np.fromiter(own, dtype=np.uint64, count=len(own))


def band_keys(text: bytes, factors) -> list:
    """A signed 64-bit key for each band; none without words."""
    import numpy as np

    h = shingle_hashes(text)
    if not len(h):
        return []
    low = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), _CHUNK):
        x = h[at : at + _CHUNK, None] * factors
        low = np.minimum(low, (x ^ (x >> np.uint64(31))).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for part in low.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64).tolist()


def similarity(a: bytes, b: bytes) -> float:
    import numpy as np

    x, y = shingle_hashes(a), shingle_hashes(b)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / max(1, len(x) + len(y) - common)


def bands_of(text: Column) -> Column:
    """The band keys of a text; null and wordless texts have none."""

    def keys(texts):
        import numpy as np
        import pyarrow as pa

        factors = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return pa.array([band_keys(t or b"", factors) for t in text_bytes(texts)], type=pa.list_(pa.int64()))

    return F.arrow_udf(keys, T.ArrayType(T.LongType()))(text)


def near_copy_rows(docs: DataFrame, banded: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(_row) of the documents of banded (_row, key: one of its bands) that are near copies of others
    of banded: in each group the one with the smallest id isn't listed, those without an id last.
    docs: doc_id, text, _row, a key of both, which repeated rows share. Texts without words are no
    copies here.
    """

    def close(one, other):
        import pyarrow as pa

        return pa.array([similarity(a or b"", b or b"") >= similar - 1e-9 for a, b in zip(text_bytes(one), text_bytes(other))], type=pa.bool_())

    centre = banded.groupBy("key").agg(F.min("_row").alias("other"), F.count("*").alias("k")).where("k > 1").select("key", "other")
    pairs = checkpointed(banded.join(centre, "key").where("_row <> other").select("_row", "other").distinct())
    # only texts that have a candidate move
    asked = checkpointed(pairs.select("_row").union(pairs.select("other")).distinct())
    few = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    texts = checkpointed(docs.join(few, "_row", "left_semi").select("_row", "doc_id", "text").dropDuplicates(["_row"]))
    met = pairs.join(texts.select("_row", F.col("text").alias("one")), "_row").join(texts.select(F.col("_row").alias("other"), F.col("text").alias("two")), "other")
    links = met.where(F.arrow_udf(close, T.BooleanType())(F.col("one"), F.col("two"))).select(F.col("_row").alias("a"), F.col("other").alias("b"))
    root = connected_components(links)
    member = texts.select("_row", "doc_id").join(root, texts["_row"] == root["node"])
    first = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("stays"))
    return member.join(first, "root").where(F.col("_row") != F.col("stays._row")).select("_row")
