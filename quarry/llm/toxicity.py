"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words (A-Z lower-cased) and their first 4 and 5 characters, and
in scripts without spaces two and three characters in a row, hashed to 2**20 slots. On a
bounded sample of labelled rows the slots that tell the labels apart are picked by a
chi-square score, those that speak for toxicity; a factorization machine over them learns a
weight for each and, by low-rank factors, one for each pair, so that a mild word beside
another can count more than both alone. Texts are scored where they are, in one pass.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_TABLE, checkpointed, small_batches, text_bytes, without

#: Labelled rows that the model is fitted on, at most: those with the smallest hash of their id.
SAMPLE = 12_000
SLOTS = 1 << 20
#: Slots with a weight, at most.
PICKED = 4096
RANK, EPOCHS, SEED = 4, 30, 6
#: Least chi-square of a picked slot.
LEAST = 12.0
#: Words that a worker remembers the slots of; then it starts anew.
_REMEMBER = 20_000
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Letters and digits of any script, and those of scripts that put no spaces between words.
_LETTERS = re.compile(r"[^\W_]+")
_UNSPACED = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]+")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def distinct_words(text: bytes) -> set:
    return set(_WORD.findall(text.translate(LOWER_TABLE)))


def slots_of(word: bytes) -> tuple:
    """Slots of the words in a run and their prefixes; of a run in a script without spaces, of its characters two and three at a time."""
    terms = set()
    for w in (word.decode(),) if word.isascii() else _LETTERS.findall(word.decode("utf-8", "ignore")):
        terms.add("w" + w)
        for n in (4, 5):
            if len(w) >= n:
                terms.add("p" + w[:n])
        for run in () if w.isascii() else _UNSPACED.findall(w):
            terms.update("n" + run[k : k + n] for n in (2, 3) for k in range(len(run) - n + 1))
    return tuple(zlib.crc32(t.encode()) % SLOTS for t in terms)


def slots(text: bytes) -> list:
    found: set[int] = set()
    for w in distinct_words(text):
        found.update(slots_of(w))
    return sorted(found)


@dataclass(frozen=True)
class Model:
    bias: float
    #: slot -> row of weights and factors
    row: dict
    weights: object
    factors: object

    def score(self, text: bytes, memory: dict) -> float:
        import numpy as np

        rows: set[int] = set()
        for w in distinct_words(text):
            own = memory.get(w)
            if own is None:
                own = tuple(r for s in slots_of(w) if (r := self.row.get(s)) is not None)
                if len(memory) >= _REMEMBER:
                    memory.clear()
                if len(w) <= 64:
                    memory[w] = own
            if own:
                rows.update(own)
        z = self.bias
        if rows:
            i = np.array(sorted(rows))
            v = self.factors[i]
            z += float(self.weights[i].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum()))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def screen(own: DataFrame, n_all: int, n_pos: int) -> list[int]:
    """The slots, at most PICKED, that speak most for label 1 in (toxic, slots) rows.

    Slots are counted in each batch first and then summed by slot.
    """

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            y = b.column(0).to_numpy()
            lists = b.column(1)
            flat, owner = lists.flatten().to_numpy(), np.repeat(y, lists.value_lengths().to_numpy())
            own, at = np.unique(flat, return_inverse=True)
            n, pos = np.bincount(at, minlength=len(own)), np.bincount(at[owner == 1], minlength=len(own))
            yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(pos.astype(np.int64))], names=["slot", "n", "pos"])

    k = own.mapInArrow(count, "slot int, n long, pos long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where("n >= 3")
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")
    neg, c, d = n - pos, n_pos - pos, (n_all - n_pos) - (n - pos)
    score = F.pow(F.greatest(F.lit(0.0), F.abs(pos * d - neg * c) - n_all / 2), F.lit(2.0)) * n_all / (n * (c + d) * n_pos * (n_all - n_pos))
    best = k.where((pos * d > neg * c) & (c + d > 0)).withColumn("score", score).where(F.col("score") >= LEAST)
    return sorted(r["slot"] for r in best.orderBy(F.col("score").desc(), "slot").limit(PICKED).collect())


def fit(picked: list[int], rows: list, labels: list) -> Model:
    """Model of rows (lists of positions in picked) and their labels. Without both labels the score is the share of label 1."""
    import numpy as np

    n = len(rows)
    y = np.array(labels, dtype=np.float64)
    share = float((y.sum() + 0.5) / (n + 1)) if n else 0.0
    none = Model(float(np.log(max(share, 1e-6) / (1 - min(share, 1 - 1e-6)))), {}, np.zeros(0), np.zeros((0, RANK)))
    if not n or not picked or y.min() == y.max():
        return none
    best = picked
    col = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows])
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    rng = np.random.default_rng(SEED)
    w, v, bias = np.zeros(len(best)), rng.normal(0, 0.01, (len(best), RANK)), none.bias
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
    start = np.searchsorted(owner, np.arange(n + 1))
    step, batch = 0, 256
    b_m = b_v = 0.0
    for _ in range(EPOCHS):
        for own in np.array_split(rng.permutation(n), max(1, n // batch)):
            size = start[own + 1] - start[own]
            idx = np.concatenate([np.arange(start[i], start[i + 1]) for i in own]) if len(own) else np.zeros(0, dtype=np.int64)
            cols, rows_ = col[idx], np.repeat(np.arange(len(own)), size)
            vs = v[cols]
            total = np.zeros((len(own), RANK))
            np.add.at(total, rows_, vs)
            square = np.bincount(rows_, weights=(vs**2).sum(axis=1), minlength=len(own))
            z = bias + np.bincount(rows_, weights=w[cols], minlength=len(own)) + 0.5 * ((total**2).sum(axis=1) - square)
            g = (1 / (1 + np.exp(-z.clip(-30, 30))) - y[own]) / len(own)
            gw = np.bincount(cols, weights=g[rows_], minlength=len(w)) + 1e-5 * w
            gv = np.zeros_like(v)
            np.add.at(gv, cols, g[rows_, None] * (total[rows_] - vs))
            gv += 1e-3 * v
            step += 1
            gb = float(g.sum())
            b_m, b_v = 0.9 * b_m + 0.1 * gb, 0.999 * b_v + 0.001 * gb * gb
            bias -= 0.02 * (b_m / (1 - 0.9**step)) / ((b_v / (1 - 0.999**step)) ** 0.5 + 1e-8)
            for x, gx, k in ((w, gw, 0), (v, gv, 2)):
                m, s = state[k], state[k + 1]
                m *= 0.9
                m += 0.1 * gx
                s *= 0.999
                s += 0.001 * gx * gx
                x -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            # picked slots speak for label 1: without this, a long clean-looking text outvotes its insults
            np.maximum(w, 0, out=w)
    return Model(float(bias), {int(s): i for i, s in enumerate(best)}, w, v)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled rows that are not held out.

    Only hashed terms of the sample come to the driver. Rows that contradict each other
    (one doc_id, both labels) count once each; documents that repeat a doc_id are one row, of
    the text with the smallest hash, so that the bound holds however often an id occurs.
    """
    lab = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    picked = lab.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)

    def hashed(texts):
        import numpy as np
        import pyarrow as pa

        own = [np.array(slots(t or b""), dtype=np.int32) for t in text_bytes(texts)]
        ends = np.cumsum([0, *map(len, own)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *own])))

    small_batches(docs.sparkSession)
    d = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    # the bounded sample of ids meets the documents; a million ids at most are sent round
    few = F.broadcast(picked) if sample <= 1_000_000 else picked
    once = d.join(few, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    own = checkpointed(once.select("toxic", F.arrow_udf(hashed, T.ArrayType(T.IntegerType()))(F.col("text")).alias("slots"), "doc_id"))
    n = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return fit([], [[]] * sum(n.values()), [y for y, k in n.items() for _ in range(k)])
    best = screen(own.select("toxic", "slots"), n[0] + n[1], n[1])

    def kept(slots):
        import numpy as np
        import pyarrow as pa

        flat, size = slots.flatten().to_numpy(), slots.value_lengths().to_numpy()
        at = np.searchsorted(best, flat).clip(max=max(len(best) - 1, 0))
        ok = np.asarray(best, dtype=np.int64)[at] == flat if len(best) else np.zeros(len(flat), dtype=bool)
        ends = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(size)), size)[ok], minlength=len(size)))])
        return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(at[ok].astype(np.int32)))

    lean = own.select("doc_id", "toxic", F.arrow_udf(kept, T.ArrayType(T.IntegerType()))(F.col("slots")).alias("rows"))
    got = sorted(tuple(r) for r in lean.collect())
    return fit(best, [r[2] for r in got], [r[1] for r in got])


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on).

    Null and empty texts have no terms: their score is that of the bias. Very long texts are
    scored whole. Repeated rows score alike and stay; an empty table gives an empty one.
    Input columns named like the added ones are replaced.
    """
    docs = without(docs, "score", "predicted")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most PICKED rows of weights
    memory: dict = {}

    def scored(texts):
        import pyarrow as pa

        m = shared.value
        return pa.array([m.score(t or b"", memory) for t in text_bytes(texts)], type=pa.float64())

    out = docs.withColumn("score", F.arrow_udf(scored, T.DoubleType())(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
