"""Mixing sources to target weights by a splitting tree.

Every source's documents are dealt into blocks by a hash of their id, the blocks
of a source are put in a seeded order, and the source's quota of blocks is what
brings its words nearest its target. A binary tree over the output shards divides
the quota vector (blocks of each source) by multivariate hypergeometric draws, so
that each shard is a random sample without replacement of the drawn blocks; a shard
then takes its share of the order and shuffles its documents locally.

The vector is as long as there are sources: it is cut into groups of GROUP sources, the tree
first divides the groups' sums, which are all that comes to the driver, and then every
group's own vector in a task of its own. What comes together in one place are the blocks of
one source and the sources of one group, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpointed, without

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Blocks of a source.
BLOCKS = 4096
#: Times that a source's blocks are gone through: each time those that fit in what is left, in order,
#: are taken up to the first that makes the sum too large. At last one more that brings the sum nearest.
PASSES = 3
#: Copies of a document at most.
MOST = 2
#: Sources whose quotas are split in one task.
GROUP = 4096
#: Parts of a shard's order; a part is sorted in one task.
PARTS = 16
#: The largest table of (source, block) rows that is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def words(col: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def block_of(doc_id: Column, text: Column, blocks: int, seed: int) -> Column:
    """Block by the id; rows without one go by their text."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % blocks).cast("int")


def targets(sizes: DataFrame, weights=WEIGHTS, share: tuple[int, int] = (3, 2), most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The sources share share[0]/share[1] of all words by weight; one that would get
    more than `most` times its size stops there, and the excess is shared again by
    weight. Taken in the order of cap over weight, a source is capped exactly if its
    part of what the earlier ones left exceeds its cap, so one ordered pass does it.
    Whole numbers up to the last division. Only the table of sources is in one task.
    """
    num, den = share
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight.cast("decimal(38,0)")).withColumn("cap", (F.col("source_size") * most).cast("decimal(38,0)"))
    scale = 1
    for w in set(weights):
        scale *= w
    by_ratio = W.orderBy((F.col("source_size") * most * scale / F.col("w")).cast("decimal(38,0)"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    zero = F.lit(0).cast("decimal(38,0)")
    s = (
        s.withColumn("total", F.sum(F.col("source_size").cast("decimal(28,0)")).over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before).cast("decimal(38,0)"), zero))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before).cast("decimal(38,0)"), zero))
        .withColumn("w_all", F.sum("w").over(every).cast("decimal(38,0)"))
    )
    left = (F.col("total") * num - F.col("cap_before") * den).cast("decimal(38,0)")
    s = s.withColumn("capped", (left * F.col("w")).cast("decimal(38,0)") > (F.col("cap") * den * (F.col("w_all") - F.col("w_before"))).cast("decimal(38,0)"))
    caps = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), zero)
    free = F.sum(F.when(~F.col("capped"), F.col("w"))).over(every)
    share_of = ((F.col("total") * num - caps * den) * F.col("w")).cast("decimal(38,0)").cast("double") / (free * den).cast("double")
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share_of).alias("target"))


def block_plan(docs: DataFrame, blocks: int = BLOCKS, seed: int = 8, weights=WEIGHTS, share=(3, 2), most: int = MOST, passes: int = PASSES) -> DataFrame:
    """(source, block, source_size, target, turn, copies): how often each block is taken.

    A source takes its blocks whole times first. What is left of the target is filled in
    seeded order, `passes` times: of the blocks that are no larger than what is left, those up to the
    first that makes the sum too large. Then the one further block that brings it nearest is taken.
    """
    sized = docs.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    sized = checkpointed(sized)
    t = targets(sized.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, share, most)
    b = sized.alias("b").join(t.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "t.source_size", "t.target")
    b = b.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("long"))
    b = b.withColumn("gap", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    turn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.coalesce("source", F.lit("")), F.col("block").cast("string")).cast("binary"))
    b = b.withColumn("turn", turn).withColumn("fits", F.lit(False))
    src, order = W.partitionBy("source"), W.partitionBy("source").orderBy("turn", "block")
    for _ in range(passes):
        asked = F.when(~F.col("fits") & (F.col("block_size") <= F.col("gap")), F.col("block_size"))
        b = b.withColumn("asked", asked).withColumn("new", F.col("asked").isNotNull() & (F.sum("asked").over(order) <= F.col("gap")))
        b = b.withColumn("gap", F.col("gap") - F.coalesce(F.sum(F.when(F.col("new"), F.col("asked"))).over(src), F.lit(0))).withColumn("fits", F.col("fits") | F.col("new"))
    miss = F.when(~F.col("fits"), F.abs(F.col("gap") - F.col("block_size")))
    best = F.min(F.struct(F.coalesce(miss, F.lit(float("inf"))).alias("miss"), F.col("turn"), F.col("block"))).over(src)
    b = b.withColumn("best", best)
    extra = ~F.col("fits") & (F.col("best.block") == F.col("block")) & (F.col("best.miss") < F.col("gap"))
    drawn = (F.col("fits") | extra) & (F.col("whole") < most)
    return b.select("source", "block", "source_size", "target", "turn", (F.col("whole") + drawn.cast("long")).alias("copies"))


def _draw(q: int, rest: int, wanted: int, rng) -> int:
    """How many of `wanted` blocks, drawn from q of a kind and `rest` others, are of that kind."""
    if wanted == 0 or q == 0:
        return 0
    if rest == 0:
        return min(q, wanted)
    if q + rest < 10**9:
        return int(rng.hypergeometric(q, rest, wanted))
    # beyond what the generator takes: the normal law with the same mean and variance, in the same bounds
    n = q + rest
    mean, var = wanted * q / n, wanted * (q / n) * (rest / n) * ((n - wanted) / max(1, n - 1))
    return int(min(max(round(rng.normal(mean, var**0.5)), wanted - rest, 0), q, wanted))


def split(quota, margins, rng):
    """quota (n,) -> (shards, n): exact parts whose sums are the margins, by halving the shards.

    At each node of the tree a multivariate hypergeometric draw, kind by kind from the margins.
    """
    import numpy as np

    if len(margins) == 1:
        return quota[None, :]
    half = len(margins) // 2
    left, rest, wanted = np.zeros_like(quota), int(quota.sum()), int(margins[:half].sum())
    for i, q in enumerate(quota):
        rest -= int(q)
        left[i] = _draw(int(q), rest, wanted, rng)
        wanted -= int(left[i])
    return np.concatenate([split(left, margins[:half], rng), split(quota - left, margins[half:], rng)])


def shard_bounds(plan: DataFrame, shards: int, seed: int = 8, group: int = GROUP) -> DataFrame:
    """(source, first, last, shard): the runs of a source's drawn blocks, by shard."""
    import numpy as np

    spark = plan.sparkSession
    schema = "source string, first long, last long, shard int"
    quota = checkpointed(plan.groupBy("source").agg(F.sum("copies").alias("n")).where("n > 0"))
    groups = max(1, -(-quota.count() // group))
    quota = quota.withColumn("group", F.pmod(F.xxhash64("source"), F.lit(groups)).cast("int"))
    # a row for each `group` sources
    sums = sorted(tuple(r) for r in quota.groupBy("group").agg(F.sum("n")).collect())
    if not sums:
        return spark.createDataFrame([], schema)
    total = sum(n for _, n in sums)
    equal = np.array([total * (k + 1) // shards - total * k // shards for k in range(shards)], dtype=np.int64)
    parts = split(np.array([n for _, n in sums], dtype=np.int64), equal, np.random.default_rng(seed))
    margins = spark.sparkContext.broadcast({g: parts[:, i] for i, (g, _) in enumerate(sums)})

    def own(key, table):
        import pandas as pd

        table = table.sort_values("source", na_position="last")
        n = table["n"].to_numpy(dtype=np.int64)
        got = split(n, margins.value[key[0]], np.random.default_rng([seed, int(key[0])]))
        ends = got.cumsum(axis=0)
        shard, at = got.nonzero()
        return pd.DataFrame({"source": table["source"].to_numpy()[at], "first": (ends - got)[shard, at], "last": ends[shard, at], "shard": shard.astype("int32")})

    return quota.groupBy("group").applyInPandas(own, schema)


def dealt(plan: DataFrame, shards: int, seed: int = 8) -> DataFrame:
    """(source, block, copy, shard): a row for each copy of a block that the tree deals to a shard."""
    each = plan.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    each = each.withColumn("number", F.row_number().over(W.partitionBy("source").orderBy("copy", "turn", "block")) - 1)
    bounds = shard_bounds(plan, shards, seed)
    # a source's blocks and its runs: at most 2 * BLOCKS and `shards` rows a source
    each = each.alias("e").join(bounds.alias("s"), F.col("e.source").eqNullSafe(F.col("s.source")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("last")))
    return checkpointed(each.select("e.source", "e.block", "copy", "shard"))


def mix(docs: DataFrame, shards: int = 16, blocks: int = BLOCKS, seed: int = 8, weights=WEIGHTS, share=(3, 2), most: int = MOST, copies: bool = True) -> DataFrame:
    """docs (doc_id, text, source, ...) mixed to the target weights.

    copies=True: one row for each copy taken, with `shard`, `position` (a seeded order
    within the shard) and `size`; every document's copies follow its block's. Rows lie in
    that order: a shard has PARTS partitions by the first digit of the position, each sorted.
    copies=False: one row for each document, with size, source_size, target and taken, the
    words of its copies over all shards.

    Repeated rows are documents of their own and share a block. Rows without a doc_id are
    dealt by their text. Null and empty texts have no words and target 0 if their source has
    none. A very long text is a block that may not fit: then others are taken. A null source
    is a source, the last one. An empty table gives an empty one. Input columns named like
    the added ones are replaced.
    """
    added = ("size", "block", "source_size", "target", "taken", "copies", "shard", "position", "turn", "first", "last", "copy", "number")
    d = without(docs, *added).withColumn("size", words(F.col("text"))).withColumn("block", block_of(F.col("doc_id"), F.col("text"), blocks, seed))
    plan = checkpointed(block_plan(d.select("source", "block", "size"), blocks, seed, weights, share, most))
    hint = F.broadcast if plan.count() * most <= BROADCAST_ROWS else (lambda x: x)

    def joined(right: DataFrame) -> DataFrame:
        r = right.withColumnRenamed("source", "_source").withColumnRenamed("block", "_block")
        return d.join(hint(r), (d["block"] == r["_block"]) & d["source"].eqNullSafe(r["_source"])).drop("_source", "_block")

    each = dealt(plan, shards, seed)
    if not copies:
        got = each.groupBy(F.col("source").alias("_s"), F.col("block").alias("_b")).agg(F.count("*").alias("got"))
        own = plan.join(got, (plan["block"] == got["_b"]) & plan["source"].eqNullSafe(got["_s"]), "left").select("source", "block", "source_size", "target", F.coalesce("got", F.lit(0)).alias("copies"))
        return joined(own).withColumn("taken", F.col("size") * F.col("copies")).drop("block", "copies")
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("place"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit("")), F.col("copy").cast("string")).cast("binary"))
    out = joined(each).withColumn("position", place).drop("block", "copy")
    return out.repartition(shards * PARTS, "shard", F.substring("position", 1, 1)).sortWithinPartitions("shard", "position")


def _sql_pass(k: int) -> str:
    return f"""
a{k} AS (SELECT *, CASE WHEN NOT fits AND block_size <= gap THEN block_size END AS asked FROM b{k - 1}),
n{k} AS (SELECT *, asked IS NOT NULL AND sum(asked) OVER (PARTITION BY source ORDER BY turn, block) <= gap AS new FROM a{k}),
b{k} AS (SELECT * EXCLUDE (fits, gap, asked, new), fits OR new AS fits, gap - coalesce(sum(CASE WHEN new THEN asked END) OVER (PARTITION BY source), 0) AS gap FROM n{k}),"""


SQL = (
    r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    (('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 8))::BIGINT % 4096)::INTEGER AS block
  FROM documents),
z0 AS (SELECT source, block, sum(size)::BIGINT AS block_size FROM d GROUP BY ALL),
s0 AS (SELECT source, sum(block_size)::BIGINT AS source_size FROM z0 GROUP BY ALL),
s1 AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::HUGEINT AS w FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS w_all,
    coalesce(sum(2 * source_size) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM s1 WINDOW o AS (ORDER BY source_size * 12 // w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (total * 3 - cap_before * 2) * w > 4 * source_size * (w_all - w_before) AS capped FROM s2),
t AS (SELECT source, source_size, CASE WHEN capped THEN (2 * source_size)::DOUBLE ELSE
    ((total * 3 - 2 * coalesce(sum(CASE WHEN capped THEN 2 * source_size END) OVER (), 0)) * w)::DOUBLE
      / (2 * sum(CASE WHEN NOT capped THEN w END) OVER ())::DOUBLE END AS target FROM s3),
y AS (SELECT z0.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END::BIGINT AS whole,
    md5('8:order:' || coalesce(z0.source, '') || ':' || block) AS turn
  FROM z0 JOIN t ON z0.source IS NOT DISTINCT FROM t.source),
b0 AS (SELECT *, FALSE AS fits, greatest(target - whole * source_size, 0)::DOUBLE AS gap FROM y),"""
    + "".join(_sql_pass(k + 1) for k in range(PASSES))
    + f"""
x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN fits THEN 1 ELSE 0 END, abs(gap - block_size), turn, block) AS rn FROM b{PASSES}),
p AS (SELECT *, whole + CASE WHEN (fits OR (rn = 1 AND abs(gap - block_size) < gap)) AND whole < 2 THEN 1 ELSE 0 END AS copies FROM x)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.block = p.block
"""
)
