"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and the words' first 4, 5 and 6 bytes (inflected or compounded insults share
them), hashed into SLOTS slots. A bounded sample of labelled rows (SAMPLE, a parameter) is joined to the documents by a
broadcast. The machine's inputs are slots that tell the labels apart by themselves (a G-test over the sample) and slots that tell them
apart beside one of those (the same over the rows that have one): a term that both labels use alike, such as the mention of a group,
matters where an insult stands with it. A linear weight and RANK factors are learned for each input, so that pairs of terms count beyond
the sum of their weights.

Defined results: a null or empty text has no term and gets the bias alone; without labelled rows every score is 0; a label that
is null is left out; rows of a document repeated in labels count by the largest label; repeated documents are scored each for itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import handed_back, lower_ascii, mix64, padded, row_chunks, runs, slice_hash, text_bytes, words64, written

SLOTS = 1 << 20
SAMPLE = 20_000
#: slots that either test may choose; the width of the machine is twice that at most
INPUTS = 4096
RANK = 8
PREFIXES = (4, 5, 6)
WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all terms of the texts laid end to end, and the text of each."""
    low = lower_ascii(data)
    mask = np.zeros(len(low) + len(offs), bool)  # one place after each text, so that words end there
    shift = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    mask[np.arange(len(low)) + shift] = WORD[low]
    start, end = runs(mask)
    text = np.searchsorted(offs[1:] + np.arange(1, len(offs)), start, side="right")
    start, end = start - text, end - text
    pad = padded(low)
    first = words64(pad)[start]
    size = end - start
    slots, owner = [mix_slot(slice_hash(pad, start, end))], [text]
    for n in PREFIXES:
        long = size > n
        part = first[long] & np.uint64((1 << (8 * n)) - 1)
        slots.append(mix_slot(mix64(part + np.uint64(n << 56))))
        owner.append(text[long])
    return np.concatenate(slots), np.concatenate(owner)


def mix_slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def chunks(batch):
    data, offs = text_bytes(batch.column("text"))
    for i, j in row_chunks(offs):
        yield i, j, *terms(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, y and slots (the distinct ones, 32-bit little-endian) of rows with text and y; of rows with one doc_id one, that with the
    smallest slots."""

    def run(batches):
        for batch in batches:
            ids, y = batch.column("doc_id"), batch.column("y")
            for i, j, slot, owner in chunks(batch):
                key = np.unique(owner * SLOTS + slot)
                at = np.searchsorted(key, np.arange(j - i + 1) * SLOTS)
                own = (key % SLOTS).astype("<u4")
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), y.slice(i, j - i), pa.array([own[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["doc_id", "y", "slots"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text").mapInArrow(handed_back(run), "doc_id long, y int, slots binary")
    return rows.groupBy("doc_id", "y").agg(F.min("slots").alias("slots"))


def slot_counts(rows: DataFrame, beside: np.ndarray | None = None) -> DataFrame:
    """slot, pos, neg: documents of either label that have it; slot -1: all documents. beside: of those only that have one of these slots."""

    def run(batches):
        near = None
        if beside is not None:
            near = np.zeros(SLOTS, bool)
            near[beside] = True
        total = np.zeros((2, SLOTS), np.int32)
        docs = [0, 0]
        for batch in batches:
            for y, raw in zip(batch.column("y").to_pylist(), batch.column("slots").to_pylist()):
                own = np.frombuffer(raw, "<u4")
                if near is None or near[own].any():
                    total[y, own] += 1
                    docs[y] += 1
        full = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1).astype(np.int64)), pa.array(np.append(total[1, full], docs[1]).astype(np.int64)), pa.array(np.append(total[0, full], docs[0]).astype(np.int64))], names=["slot", "pos", "neg"])

    return rows.mapInArrow(run, "slot long, pos long, neg long").groupBy("slot").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def telling(counts: DataFrame, least: float = 20.0) -> np.ndarray:
    """Slots whose presence tells the labels apart: G of at least this much, the INPUTS best at most (an input width, like RANK)."""
    all_rows = counts.filter("slot < 0").first()
    if all_rows is None or not all_rows.pos or not all_rows.neg:
        return np.zeros(0, np.int64)
    p, n = float(all_rows.pos), float(all_rows.neg)
    share = (F.col("pos") + F.col("neg")) / F.lit(p + n)
    xlogy = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(F.lit(0.0))
    g = 2 * (xlogy(F.col("pos"), p * share) + xlogy(F.col("neg"), n * share) + xlogy(p - F.col("pos"), p * (1 - share)) + xlogy(n - F.col("neg"), n * (1 - share)))
    best = counts.filter("slot >= 0 and pos + neg >= 3").withColumn("g", g).filter(F.col("g") >= least).orderBy(F.desc("g"), "slot").limit(INPUTS)
    return np.array(sorted(r.slot for r in best.collect()), np.int64)


class Machine:
    """bias + sum of weights + sum over pairs of the products of factors, over a text's inputs."""

    def __init__(self, slots: np.ndarray, seed: int = 7):
        self.slots = slots
        self.w = np.zeros(len(slots))
        self.v = np.random.default_rng(seed).normal(0, 0.02, (len(slots), RANK))
        self.bias = 0.0
        self.empty = not len(slots)

    def raw(self, text: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts; text and index: which text has which input, sorted by text."""
        out = np.full(n, self.bias) + np.bincount(text, self.w[index], n)
        for f in range(RANK):
            v = self.v[index, f]
            out += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
        return out

    def fit(self, inputs: list[np.ndarray], y: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, batch: int = 256, seed: int = 7) -> Machine:
        """AdaGrad on the logistic loss."""
        if not len(y):
            return self
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        self.bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                sizes = [len(inputs[r]) for r in rows]
                text, index = np.repeat(np.arange(len(rows)), sizes), np.concatenate([inputs[r] for r in rows]).astype(np.int64)
                error = (1 / (1 + np.exp(-self.raw(text, index, len(rows)))) - y[rows]) / len(rows)
                gb += error.sum() ** 2
                self.bias -= rate * error.sum() / np.sqrt(gb)
                if not len(index):
                    continue
                used, inverse = np.unique(index, return_inverse=True)
                e = error[text]
                d = np.bincount(inverse, e) + decay * self.w[used]
                gw[used] += d * d
                sums = np.stack([np.bincount(text, self.v[index, f], len(rows)) for f in range(RANK)], axis=1)
                part = e[:, None] * (sums[text] - self.v[index])
                dv = np.zeros((len(used), RANK))
                np.add.at(dv, inverse, part)
                dv += decay * self.v[used]
                gv[used] += dv * dv
                self.w[used] -= rate * d / np.sqrt(gw[used])
                self.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
        return self


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """The machine learned from labels (doc_id, toxic); the sample's rows are those with the smallest hashes of doc_id. None: nothing to learn from."""
    known = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample).drop("h")
    rows = written(features(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")), "features")
    slots = telling(slot_counts(rows))
    if len(slots):
        slots = np.union1d(slots, telling(slot_counts(rows, slots)))
    if not rows.limit(1).count():
        return None

    def chosen(batches):
        for batch in batches:
            kept = [np.flatnonzero(np.isin(slots, np.frombuffer(raw, "<u4"), assume_unique=True)).astype("<u2").tobytes() for raw in batch.column("slots").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(kept, pa.binary())], names=["y", "inputs"])

    got = sorted((r.y, bytes(r.inputs)) for r in rows.mapInArrow(chosen, "y int, inputs binary").collect())  # at most sample rows
    return Machine(slots).fit([np.frombuffer(r[1], "<u2") for r in got], np.array([r[0] for r in got], float))


def score(docs: DataFrame, machine: Machine | None, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted; columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        m = held.value
        place = np.full(SLOTS, -1, np.int32)
        if m is not None:
            place[m.slots] = np.arange(len(m.slots))
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, slot, owner in chunks(batch) if m is not None else ():
                index = place[slot]
                hit = index >= 0
                key = np.unique(owner[hit] * (2 * INPUTS) + index[hit])
                out[i:j] = 1 / (1 + np.exp(-np.clip(m.raw(key // (2 * INPUTS), key % (2 * INPUTS), j - i), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(handed_back(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
