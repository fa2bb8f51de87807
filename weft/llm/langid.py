"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of one to three letters of every learning document in each task and adds them up by a shuffle of
(lang, bucket) sums. The log-probability matrix is broadcast, at most LANGS x (BUCKETS + 1) numbers at a time: more languages are
scored in as many passes, each of which hands on the best so far. Scoring gathers the matrix rows of a batch's n-grams, CELLS
numbers at a time, and sums them by document.

Defined results: a null or empty text, one without a letter, or any text where nothing could be learned, is `und` with score 0;
ties go to the smallest lang; learning rows with a null lang or no letters count for nothing; repeated rows count each time.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import LETTER, classes
from ..storage import written
from .common import row_chunks, text_bytes

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: languages of a pass: its broadcast has LANGS x BUCKETS numbers of 4 bytes
LANGS = 256
#: numbers that are gathered at a time, whatever the languages and the text are
CELLS = 1 << 22
_LOWER: list[np.ndarray] = []


def _lower() -> np.ndarray:
    """Lower case of each code point that is a letter, 0 for all others."""
    if not _LOWER:
        table = np.zeros(sys.maxunicode + 1, np.uint32)
        for c in np.flatnonzero(classes() == LETTER).tolist():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
        _LOWER.append(table)
    return _LOWER[0]


def grams(data: bytes, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each order at each place of the texts laid end to end (BUCKETS where a text ends before), the
    places' offsets by text, and whether a text has a letter. Every run of other characters counts as one space."""
    raw = np.frombuffer(data, np.uint8)
    points = _lower()[np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)]
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offs]
    letter = points > 0
    keep = letter | np.concatenate([[True], letter[:-1]])
    x = points[keep].astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    has = np.concatenate([[0], np.cumsum(x > 0)])
    has = has[at[1:]] > has[at[:-1]]
    last = np.repeat(at[1:], np.diff(at))
    place = np.arange(len(x))
    out, key = [], np.zeros(len(x), np.uint64)
    for n in ORDERS:
        shifted = np.zeros(len(x), np.uint64)
        shifted[: max(0, len(x) - n + 1)] = x[n - 1 :]
        key = key * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(n)
        bucket = ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49)
        out.append(np.where(place + n <= last, bucket.astype(np.int64), BUCKETS))
    return out, at, has


def count(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over rows with lang and text; bucket -1: documents with a letter."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            data, offs = text_bytes(batch.column("text"))
            for i, j in row_chunks(offs):
                own = offs[i : j + 1] - offs[i]
                found, at, has = grams(data[offs[i] : offs[j]].tobytes(), own)
                names = sorted(set(langs[i:j]))
                index = {name: k for k, name in enumerate(names)}
                of = np.array([index[name] for name in langs[i:j]])
                shift = np.repeat(of * (BUCKETS + 1), np.diff(at))
                shift[np.repeat(~has, np.diff(at))] = -1  # nothing to learn from
                total = np.zeros(len(names) * (BUCKETS + 1), np.int64)
                for b in found:
                    total += np.bincount((b + shift)[shift >= 0], minlength=len(total))
                for k, name in enumerate(names):
                    own_sum = total[k * (BUCKETS + 1) : k * (BUCKETS + 1) + BUCKETS]
                    sums[name] = sums[name] + own_sum if name in sums else own_sum.copy()
                    rows[name] = rows.get(name, 0) + int((has & (of == k)).sum())
        for name, total in sums.items():
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(full) + 1), pa.string()), pa.array(np.append(full, -1)), pa.array(np.append(total[full], rows[name]))], names=["lang", "bucket", "n"])

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Learned langs in ascending order, each with its documents, and the counts of their buckets as a table."""

    def __init__(self, counts: DataFrame, alpha: float):
        self.counts, self.alpha = counts, alpha
        rows = counts.filter("bucket < 0 and n > 0").orderBy("lang").collect()  # a row for each language
        self.langs, self.docs = [r.lang for r in rows], np.array([r.n for r in rows], np.float64)

    def block(self, first: int) -> np.ndarray:
        """Log probabilities of LANGS languages from this one on: a row for each bucket, a row of zeros, and the log priors."""
        names = self.langs[first : first + LANGS]
        index = self.counts.sparkSession.createDataFrame(list(enumerate(names)), "k int, lang string")
        rows = self.counts.filter("bucket >= 0").join(F.broadcast(index), "lang").select("k", "bucket", "n").toArrow()  # LANGS x BUCKETS at most
        table = np.full((len(names), BUCKETS), self.alpha)
        table[rows.column("k").to_numpy(), rows.column("bucket").to_numpy()] += rows.column("n").to_numpy()
        table = np.log(table / table.sum(1, keepdims=True))
        prior = np.log(self.docs[first : first + LANGS] / self.docs.sum())
        return np.concatenate([table, np.zeros((len(names), 1)), prior[:, None]], axis=1).T.astype(np.float32, order="C")


def fit(docs: DataFrame, alpha: float = 0.1) -> Model:
    """Of docs (lang, text)."""
    return Model(written(count(docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")), "counts"), alpha)


def sums(found: list[np.ndarray], at: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The matrix rows of each text's n-grams added up, over stretches of places."""
    total, places, step = np.zeros((len(at) - 1, matrix.shape[1])), int(at[-1]), max(1, CELLS // matrix.shape[1])
    for a in range(0, places, step):
        z = min(places, a + step)
        first = np.searchsorted(at, a, side="right") - 1
        begins = np.unique(np.concatenate([[a], at[first + 1 : np.searchsorted(at, z)]]))
        own = np.searchsorted(at, begins, side="right") - 1
        for b in found:
            total[own] += np.add.reduceat(matrix[b[a:z]], begins - a, axis=0, dtype=np.float64)
    return total


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, the posterior of a text's n-grams tempered by their number's square root. Passes hand on the best
    total with its language and its tempered value, the largest tempered value, and the sum of all others' shares of it."""
    docs = docs.drop("lang_pred", "score")
    passed = ["best", "pred", "own", "top", "mass"]
    names = {c: f"{c} so far" for c in passed}

    def scorer(held, langs, first):
        def run(batches):
            matrix = held.value
            table, prior = matrix[:-1], matrix[-1]
            for batch in batches:
                n = batch.num_rows
                state = {c: np.full(n, -np.inf) for c in ("best", "own", "top")} | {"mass": np.zeros(n), "pred": np.full(n, None, object)}
                if not first:
                    state = {c: batch.column(names[c]).to_numpy(zero_copy_only=False).copy() for c in passed}
                data, offs = text_bytes(batch.column("text"))
                for i, j in row_chunks(offs):
                    found, at, has = grams(data[offs[i] : offs[j]].tobytes(), offs[i : j + 1] - offs[i])
                    total = sums(found, at, table)
                    soft = total / np.sqrt(np.maximum(1, np.diff(at)))[:, None] + prior
                    total += prior
                    k, rows = total.argmax(axis=1), np.arange(j - i)
                    better = has & (total[rows, k] > state["best"][i:j])  # an earlier language wins ties
                    for c, new in (("best", total[rows, k]), ("own", soft[rows, k]), ("pred", np.array(langs, object)[k])):
                        state[c][i:j] = np.where(better, new, state[c][i:j])
                    top = np.maximum(state["top"][i:j], soft.max(axis=1))
                    state["mass"][i:j] = state["mass"][i:j] * np.exp(state["top"][i:j] - top) + np.exp(soft - top[:, None]).sum(axis=1)
                    state["top"][i:j] = top
                kept = [c for c in batch.schema.names if c not in names.values()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(state[c], pa.string() if c == "pred" else pa.float64()) for c in passed)], names=[*kept, *names.values()])

        return run

    fields = [T.StructField(names[c], T.StringType() if c == "pred" else T.DoubleType()) for c in passed]
    rows, sc = docs, docs.sparkSession.sparkContext
    for first in range(0, len(model.langs), LANGS):
        rows = rows.mapInArrow(scorer(sc.broadcast(model.block(first)), model.langs[first : first + LANGS], first == 0), T.StructType([*docs.schema.fields, *fields]))
    if not model.langs:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    known = F.col(names["pred"]).isNotNull()
    chance = F.exp(F.col(names["own"]) - F.col(names["top"])) / F.col(names["mass"])
    return rows.withColumns({"lang_pred": F.coalesce(F.col(names["pred"]), F.lit("und")), "score": F.when(known, chance).otherwise(0.0)}).drop(*names.values())
