"""Exact centroid clustering over dictionaries of subvectors.

Vectors are whole numbers, floor(1024 x). They are encoded once: in chunks, each block of
neighbouring dimensions is a dictionary of its distinct subvectors and a code for each
vector, without loss. A round works on dictionaries: each distinct subvector's distance to
all centroids is taken once a chunk, a vector's distance is the sum of its codes' parts, and
a cluster's sum comes from how often it has each code. Blocks are as wide as still leaves
several vectors for each distinct subvector.

Chunks stay where they are; what moves in a round are sums by cluster and dimension, and the
centroids. All arithmetic is exact.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, shared_dir, small_batches

DIMENSIONS, CLUSTERS, ROUNDS, SEED = 64, 8, 10, 3
SCALE = 1024
#: Vectors of a chunk, about; a block is as wide as leaves so many vectors for each distinct subvector, on the whole.
CHUNK, REPEATS = 16_384, 4
WIDTHS = (16, 8, 4, 2, 1)
#: Components reach no further; beyond it no distance would be a long.
_MOST = 1 << 59
#: Up to here 64 squares of differences add up to a long; beyond it numbers of any length are used.
_SHORT = 1 << 27
_ENCODED = "width int, words array<binary>, codes array<binary>"
_SUMS = "cluster int, dimension int, total decimal(38,0), n long"


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -_MOST, _MOST).astype(np.int64)


def _dictionary(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, codes = np.unique(block, axis=0, return_inverse=True) if block.shape[1] > 1 else np.unique(block[:, 0], return_inverse=True)
    return words.reshape(-1, block.shape[1]), codes.reshape(-1)


def encode(vectors: np.ndarray) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
    """(width, distinct subvectors of each block, codes of each block)."""
    n, dims = vectors.shape
    for width in WIDTHS:
        blocks = []
        for a in range(0, dims, width):
            blocks.append(_dictionary(vectors[:, a : a + width]))
            if width > 1 and REPEATS * sum(len(w) for w, _ in blocks) > n * len(blocks):
                break  # too many are distinct
        else:
            break
    return width, [w for w, _ in blocks], [c for _, c in blocks]


def nearest(words: list[np.ndarray], codes: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector; of clusters equally near, the first."""
    exact = object if max(abs(int(centroids.max())), abs(int(centroids.min())), *(int(np.abs(w).max()) for w in words)) >= _SHORT else np.int64
    total, at = np.zeros((len(codes[0]), len(centroids)), dtype=exact), 0
    for w, c in zip(words, codes):
        part = ((w[:, None, :].astype(exact) - centroids[None, :, at : at + w.shape[1]].astype(exact)) ** 2).sum(axis=2)
        total += part[c]
        at += w.shape[1]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster]


def sums_by_code(words, codes, cluster: np.ndarray, clusters: int) -> list[list[int]]:
    """For each cluster the sum of its vectors, from how often it has each code."""
    out = []
    for w, c in zip(words, codes):
        often = np.bincount(c * clusters + cluster, minlength=len(w) * clusters).reshape(len(w), clusters)
        exact = object if int(np.abs(w).max()) >= _SHORT else np.int64
        out.append(often.T.astype(exact) @ w.astype(exact))
    return np.concatenate(out, axis=1).tolist()


def _chunks(batches) -> Iterator[tuple[list, np.ndarray]]:
    ids, parts, size = [], [], 0
    for b in batches:
        ids += b.column(0).to_pylist()
        flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
        parts.append(whole_numbers(flat.reshape(-1, DIMENSIONS)))
        size += len(parts[-1])
        if size >= CHUNK:
            yield ids, np.concatenate(parts)
            ids, parts, size = [], [], 0
    if size:
        yield ids, np.concatenate(parts)


def _encoder(id_type):
    def run(batches):
        import pyarrow as pa

        for ids, vectors in _chunks(batches):
            width, words, codes = encode(vectors)
            slim = [c.astype(np.uint8 if len(w) <= 1 << 8 else np.uint16 if len(w) <= 1 << 16 else np.uint32) for w, c in zip(words, codes)]
            columns = [pa.array([ids], type=pa.list_(id_type)), pa.array([width], type=pa.int32()), pa.array([[w.tobytes() for w in words]]), pa.array([[c.tobytes() for c in slim]])]
            yield pa.record_batch(columns, names=["ids", "width", "words", "codes"])

    return run


def _decoded(b) -> Iterator[tuple[object, list[np.ndarray], list[np.ndarray]]]:
    """(ids, words, codes) of the chunks of an encoded batch."""
    for i in range(b.num_rows):
        ids = b.column("ids")[i].values
        words = [np.frombuffer(w, dtype=np.int64).reshape(-1, b.column("width")[i].as_py()) for w in b.column("words")[i].as_py()]
        kinds = [np.uint8 if len(w) <= 1 << 8 else np.uint16 if len(w) <= 1 << 16 else np.uint32 for w in words]
        yield ids, words, [np.frombuffer(c, dtype=k).astype(np.int64) for c, k in zip(b.column("codes")[i].as_py(), kinds)]


def _sums(centroids: list[list[int]]):
    def run(batches):
        import decimal

        import pyarrow as pa

        center, total, count = np.array(centroids, dtype=np.int64), None, np.zeros(len(centroids), dtype=np.int64)
        for b in batches:
            for _, words, codes in _decoded(b):
                cluster, _ = nearest(words, codes, center)
                own = np.array(sums_by_code(words, codes, cluster, len(centroids)), dtype=object)
                total = own if total is None else total + own
                count += np.bincount(cluster, minlength=len(centroids))
        if total is not None:
            rows = [(k, d, decimal.Decimal(int(total[k, d])), int(count[k])) for k in range(len(centroids)) if count[k] for d in range(DIMENSIONS)]
            kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
            yield pa.record_batch([pa.array(x, type=t) for x, t in zip(zip(*rows), kinds)], names=["cluster", "dimension", "total", "n"])

    return run


def _assigner(centroids: list[list[int]]):
    def run(batches):
        import decimal

        import pyarrow as pa

        center = np.array(centroids, dtype=np.int64)
        for b in batches:
            for ids, words, codes in _decoded(b):
                cluster, distance = nearest(words, codes, center)
                yield pa.record_batch([ids, pa.array(cluster, type=pa.int32()), pa.array([decimal.Decimal(int(x)) for x in distance], type=pa.decimal128(38, 0))], names=["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) of the vectors (vec_id, embedding) of
    exactly 64 components, none null or non-finite; others get no row.

    The first centroids are the vectors whose sha256 of `seed:vec_id` is smallest; ties, as of
    repeated ids, go by components, and a vector without an id comes last. Fewer vectors than
    clusters make fewer clusters. Repeated rows count each. Components beyond 2^59 / 1024
    count as that; a distance or sum that is no long comes out null. An empty table gives an
    empty one. Columns other than these two aren't carried.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    dense = F.transform("embedding", lambda x: x.cast("double"))
    kept = vectors.select("vec_id", dense.alias("v")).where(F.size("v") == DIMENSIONS).where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(digest.asc_nulls_last(), "v").limit(clusters).collect()
    centroids = [whole_numbers(np.array(r.v)).tolist() for r in first]

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = vectors.schema["vec_id"].dataType
    where = f"{shared_dir(spark)}/subvectors-{uuid.uuid4().hex}"
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), *T._parse_datatype_string(_ENCODED).fields])
    kept.mapInArrow(_encoder(to_arrow_type(id_type)), schema).write.parquet(where)
    chunks = spark.read.schema(schema).parquet(where)
    for _ in range(rounds if centroids else 0):
        summed = chunks.mapInArrow(_sums(centroids), _SUMS).groupBy("cluster", "dimension").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for r in summed.collect():
            centroids[r["cluster"]][r["dimension"]] = int(r["total"]) // r["n"]
    out = T.StructType([T.StructField("vec_id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DecimalType(38, 0))])
    near = checkpointed(chunks.mapInArrow(_assigner(centroids), out)) if centroids else spark.createDataFrame([], out)
    long = lambda c: c.try_cast("long")
    inertia = {r["cluster"]: r["s"] for r in near.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    known = [(k, inertia.get(k), c, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    table = spark.createDataFrame(known, "cluster int, s decimal(38,0), centroid array<long>, centroid_sha256 string")
    total = F.lit(sum(inertia.values())).cast("decimal(38,0)")
    joined = near.join(F.broadcast(table), "cluster")  # a row for each cluster
    return joined.select("vec_id", "cluster", long(F.col("distance")).alias("distance"), long(F.col("s")).alias("cluster_inertia"), long(total).alias("inertia"), "centroid_sha256", "centroid")


def _sql() -> str:
    square = "list_sum(list_transform(generate_series(1, 64), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    parts = [
        f"v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY s, v) - 1 AS k, v AS c FROM (SELECT sha256('{SEED}:' || vec_id) AS s, v FROM v ORDER BY s, v LIMIT {CLUSTERS}))",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min({square}::HUGEINT * {CLUSTERS} + k) AS m FROM v, c{r} GROUP BY rid)")
        if r < ROUNDS:
            parts.append(f"s{r} AS (SELECT k, i, sum(e) AS s, count(*) AS n FROM (SELECT m % {CLUSTERS} AS k, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY k, i)")
            parts.append(
                f"c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY k) n USING (k))"
            )
    last = f"z AS (SELECT vec_id, m % {CLUSTERS} AS k, (m // {CLUSTERS})::BIGINT AS d FROM a{ROUNDS})"
    return (
        f"WITH {', '.join([*parts, last])} SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, "
        f"(sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM z JOIN c{ROUNDS} USING (k)"
    )


SQL = _sql()
