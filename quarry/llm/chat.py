"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt; what follows on each
side is its completion, with the spans that count for the loss. DataFrame functions
only. Turns meet as hashes on (pair, turn number), so a long conversation is spread like many
short ones; texts move when both are known, the cut of their pair and their block, and come
together in blocks of a bounded number of messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

#: Messages of one output row, about: a row ends with a stretch of so many turn numbers. A conversation that goes beyond has its prompt, rendered once, and its completions in pieces, to be read in the order of `block`.
BLOCK = 2048
#: Blocks beyond the first are broadcast up to so many stretches, and joined by shuffle beyond.
BROADCAST = 500_000
#: A turn is START + role + SEP + text + END + TAIL; text and END of an assistant's turn count for the loss.
START, SEP, END, TAIL = "<|im_start|>", "\n", "<|im_end|>", "\n"
_LAST = (1 << 63) - 1


def rendered(m: Column) -> Column:
    return F.concat(F.lit(START), m["role"], F.lit(SEP), m["text"], F.lit(END + TAIL))


def _spans(messages: Column) -> Column:
    """[start, end) offsets, in code points of the rendered messages, that count for the loss."""
    empty = F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), lambda x: F.lit(False))
    begin = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc, m):
        start = acc["at"] + len(START) + F.length(m["role"]) + len(SEP)
        end = start + F.length(m["text"]) + len(END)
        own = F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct((end + len(TAIL)).alias("at"), F.when(m["role"] == "assistant", own).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(messages, begin, step, lambda acc: acc["spans"])


def _side(df: DataFrame, chosen: bool) -> DataFrame:
    return df.select(
        "pair_id", F.coalesce(F.col("turn").cast("long"), F.lit(_LAST)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(chosen).alias("is_chosen")
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each pair_id and block: prompt, chosen, rejected, chosen_mask, rejected_mask, n_prompt, n_chosen, n_rejected.

    chosen, rejected: (pair_id, turn, role, text), a row a turn. A turn number belongs to
    the prompt if every turn number up to it has the same messages on both sides. The masks
    are spans of offsets into the block's completion; the prompt never counts. A pair is one row,
    block 0, unless it has more than `block` messages: turn numbers come in stretches of `block`,
    and one that at least k times so many messages come before is in block k.

    Repeated rows are one message; several messages of a turn number are ordered by role
    and text. A null turn is the last one, null role and text are empty. A message without a
    pair_id can't be paired: it is a pair of its own, with one side. Pairs that don't differ
    have empty completions; pairs with one side only have an empty prompt and one empty
    completion. Very long texts are rendered whole. Empty tables give an empty one. Other
    columns are not used.
    """
    both = _side(chosen, True).unionByName(_side(rejected, False))
    alone = F.xxhash64("turn", "role", "text", "is_chosen")
    both = both.withColumn("alone", F.when(F.col("pair_id").isNull(), alone).otherwise(0)).withColumn("stretch", F.expr(f"turn div {int(block)}"))
    # 128 bits: of all messages that ever meet, none is equal by chance
    slim = both.select("pair_id", "alone", "turn", "stretch", "is_chosen", *[F.xxhash64(F.lit(k), "role", "text").alias(f"h{k}") for k in (1, 2)]).distinct()
    on = lambda flag, k: F.when(F.col("is_chosen") == F.lit(flag), F.col(f"h{k}"))
    marks = [F.bit_xor(on(flag, k)).alias(f"{side}{k}") for flag, side in ((True, "c"), (False, "r")) for k in (1, 2)]
    turns = slim.groupBy("pair_id", "alone", "stretch", "turn").agg(F.count(on(True, 1)).alias("nc"), F.count(on(False, 1)).alias("nr"), *marks)
    differs = (F.col("nc") != F.col("nr")) | ~F.col("c1").eqNullSafe(F.col("r1")) | ~F.col("c2").eqNullSafe(F.col("r2"))
    turns = checkpointed(turns.select("pair_id", "alone", "stretch", "turn", "nc", "nr", differs.alias("differs")))
    renamed = {"pair_id": "_pair", "alone": "_alone"}
    cut = turns.where("differs").groupBy("pair_id", "alone").agg(F.min("turn").alias("cut")).withColumnsRenamed(renamed)
    # a turn of the prompt is rendered once
    of_pair = W.partitionBy("pair_id", "alone").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    cuts = turns.groupBy("pair_id", "alone").agg(F.min(F.when(F.col("differs"), F.col("turn"))).alias("cut"), F.sum(F.col("nc") + F.col("nr")).alias("n")).where(F.col("n") > block)
    held = turns.join(cuts.withColumnsRenamed(renamed), F.col("pair_id").eqNullSafe(F.col("_pair")) & (F.col("alone") == F.col("_alone")))
    shown = F.col("nc") + F.when(F.col("turn") >= F.col("cut"), F.col("nr")).otherwise(0)
    held = held.groupBy("pair_id", "alone", "stretch").agg(F.sum(shown).alias("n"))
    held = held.withColumn("before", F.coalesce(F.sum("n").over(of_pair), F.lit(0)))
    later = checkpointed(held.select("pair_id", "alone", "stretch", F.expr(f"before div {int(block)}").alias("block")).where("block > 0"))
    later = later.withColumnsRenamed(renamed | {"stretch": "_stretch"})
    later = F.broadcast(later) if later.count() <= BROADCAST else later
    rows = both.join(cut, F.col("pair_id").eqNullSafe(F.col("_pair")) & (F.col("alone") == F.col("_alone")), "left").drop("_pair", "_alone")
    in_prompt = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    rows = rows.withColumn("part", F.when(in_prompt, F.lit(0)).when(F.col("is_chosen"), 1).otherwise(2)).where(~in_prompt | F.col("is_chosen"))
    rows = rows.join(later, F.col("pair_id").eqNullSafe(F.col("_pair")) & (F.col("alone") == F.col("_alone")) & (F.col("stretch") == F.col("_stretch")), "left")
    rows = rows.withColumn("block", F.coalesce("block", F.lit(0).cast("long")))
    group = rows.groupBy("pair_id", "alone", "block").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text", "part"))).alias("all"))
    part = lambda k: F.filter("all", lambda m: m["part"] == k)
    names = ("prompt", "chosen", "rejected")
    for k, name in enumerate(names):
        group = group.withColumn(f"_{name}", part(k))
    return group.select(
        "pair_id",
        "block",
        *[F.array_join(F.transform(f"_{n}", rendered), "").alias(n) for n in names],
        *[_spans(F.col(f"_{n}")).alias(f"{n}_mask") for n in names[1:]],
        *[F.size(f"_{n}").cast("long").alias(f"n_{n}") for n in names],
    )


def swapped_endings(conversations: DataFrame) -> DataFrame:
    """Rejected conversations made from a table of conversations: pair_id is the conv_id, and the
    last assistant turn's text is that of the next conv_id's (empty where there is none)."""
    last = conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("end"))
    mine = last.select(F.col("conv_id").alias("_conv"), F.col("end.turn").alias("_turn"))
    next_ = last.select((F.col("conv_id") - 1).alias("_before"), F.col("end.text").alias("_text"))
    ends = mine.join(next_, F.col("_conv") == F.col("_before"), "left")
    own = conversations.join(ends, F.col("conv_id") == F.col("_conv"), "left")
    is_end = (F.col("turn") == F.col("_turn")) & (F.col("role") == "assistant")
    return own.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.when(is_end, F.coalesce("_text", F.lit(""))).otherwise(F.col("text")).alias("text"))


def _sql_part(k: int, name: str) -> str:
    return f"""coalesce(string_agg('{START}' || role || chr(10) || text || '{END}' || chr(10), '' ORDER BY turn, role, text) FILTER (part = {k}), '') AS {name}"""


SQL = f"""
WITH last AS (SELECT conv_id, max(struct_pack(turn := turn, text := text)) AS e FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
ends AS (SELECT a.conv_id, a.e.turn AS turn, coalesce(b.e.text, '') AS text FROM last a LEFT JOIN last b ON b.conv_id = a.conv_id + 1),
c AS (SELECT conv_id AS pair_id, turn, role, text, TRUE AS is_chosen FROM conversations),
r AS (SELECT c.pair_id, c.turn, role, CASE WHEN ends.turn = c.turn AND role = 'assistant' THEN ends.text ELSE c.text END AS text, FALSE AS is_chosen
  FROM c LEFT JOIN ends ON c.pair_id = ends.conv_id),
b0 AS (SELECT DISTINCT pair_id, coalesce(turn, {_LAST}) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text, is_chosen FROM (SELECT * FROM c UNION ALL SELECT * FROM r)),
b AS (SELECT *, CASE WHEN pair_id IS NULL THEN md5(turn || ':' || role || chr(0) || text || is_chosen) ELSE '' END AS alone FROM b0),
t AS (SELECT pair_id, alone, turn FROM b GROUP BY pair_id, alone, turn
  HAVING list_sort(list(role || chr(0) || text) FILTER (is_chosen)) IS DISTINCT FROM list_sort(list(role || chr(0) || text) FILTER (NOT is_chosen))),
cut AS (SELECT pair_id, alone, min(turn) AS cut FROM t GROUP BY pair_id, alone),
m AS (SELECT b.*, CASE WHEN cut IS NULL OR turn < cut THEN 0 WHEN is_chosen THEN 1 ELSE 2 END AS part
  FROM b LEFT JOIN cut ON b.pair_id IS NOT DISTINCT FROM cut.pair_id AND b.alone = cut.alone),
n0 AS (SELECT *, turn // {BLOCK} AS stretch FROM m WHERE part > 0 OR is_chosen),
n1 AS (SELECT pair_id AS s_pair, alone AS s_alone, stretch AS s_stretch, coalesce(sum(k) OVER (PARTITION BY pair_id, alone ORDER BY stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT pair_id, alone, stretch, count(*) AS k FROM n0 GROUP BY ALL)),
n AS (SELECT n0.*, (before // {BLOCK})::BIGINT AS block FROM n0 JOIN n1 ON pair_id IS NOT DISTINCT FROM s_pair AND alone = s_alone AND stretch = s_stretch),
o AS (SELECT *, sum(length(role) + length(text) + {len(START + SEP + END + TAIL)}) OVER (PARTITION BY pair_id, alone, block, part ORDER BY turn, role, text) AS e FROM n),
p AS (SELECT *, (e - {len(TAIL)})::BIGINT AS b_end, (e - {len(TAIL)} - {len(END)} - length(text))::BIGINT AS b_start FROM o)
SELECT pair_id, block, count(*) FILTER (part = 0) AS n_prompt, count(*) FILTER (part = 1) AS n_chosen, count(*) FILTER (part = 2) AS n_rejected,
  sha256(prompt) AS prompt_sha256, sha256(chosen) AS chosen_sha256, sha256(rejected) AS rejected_sha256, chosen_mask, rejected_mask
FROM (SELECT pair_id AS x_pair, alone AS x_alone, block AS x_block, {_sql_part(0, "prompt")}, {_sql_part(1, "chosen")}, {_sql_part(2, "rejected")},
  coalesce(string_agg(b_start || ':' || b_end, ',' ORDER BY turn, role, text) FILTER (part = 1 AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(b_start || ':' || b_end, ',' ORDER BY turn, role, text) FILTER (part = 2 AND role = 'assistant'), '') AS rejected_mask
  FROM p GROUP BY pair_id, alone, block) x JOIN p ON pair_id IS NOT DISTINCT FROM x_pair AND alone = x_alone AND block = x_block
GROUP BY x_pair, x_alone, x_block, pair_id, alone, block, prompt, chosen, rejected, chosen_mask, rejected_mask
"""
