"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-
leader updates (FTRL-proximal), scored as sparse dot products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm import wordhash
from salescope.llm.langid import held_out

BITS = 18
SIZE = 1 << BITS
#: labelled documents that are learned from, at most (in expectation)
SAMPLE = 16_000
#: documents of the sample per learner; the learners' weights are averaged; passes over a share
LEARNER_ROWS, PASSES = 4_000, 8
ALPHA, BETA, L1, L2 = 20.0, 1.0, 0.02, 0.01
PREDICT_AT = 0.3

#: byte classes: 0 white space, 1 letters (and all non-ASCII), 2 digits, 3 other
_CLASS = np.full(256, 3, np.uint8)
_CLASS[wordhash.SPACE] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, bounds) of the sparse rows: word unigrams and bigrams, value sqrt(share of the text).

    Tokens are runs of one class -- words, numbers (all alike), punctuation -- so that marks stuck to a
    word do not make it a new word.
    """
    n_docs = len(offsets) - 1
    cls = _CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = cls[1:] != cls[:-1]
    inner = offsets[1:-1]
    new[inner[inner < len(data)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(data)) if len(start) else start
    real = cls[start] != 0 if len(start) else np.zeros(0, bool)
    start, end = start[real], end[real]
    h = wordhash.span_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)
    if len(start):
        h = np.where(cls[start] == 2, np.uint64(0x1234567), h)
    doc = np.searchsorted(offsets, start, "right") - 1
    with np.errstate(over="ignore"):
        two = wordhash.mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
    same = doc[1:] == doc[:-1]
    shift = np.uint64(64 - BITS)
    index = np.concatenate([h >> shift, two[same] >> shift]).astype(np.int64)
    rows = np.concatenate([doc, doc[1:][same]])
    key, count = np.unique(rows * SIZE + index, return_counts=True)
    row = key >> BITS
    total = np.bincount(rows, minlength=n_docs).astype(np.float64)
    return key & (SIZE - 1), np.sqrt(count / total[row]), np.searchsorted(row, np.arange(n_docs + 1))


def _sparse(texts: pa.Array):
    for first, end, data, offsets in wordhash.chunks(texts):
        index, value, bounds = features(data, offsets)
        yield first, end - first, index, value, bounds


class Ftrl:
    """State z, n per weight; the weight is a closed form of them, 0 inside the L1 ball."""

    def __init__(self):
        self.z, self.n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)  # the last one is the bias

    def weights(self, i=slice(None)):
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights (SIZE + 1, bias last) from labelled documents that are not held out.

    ``sample`` bounds the labels learned from (picked by a hash of the id, in expectation); one task
    per LEARNER_ROWS of it runs FTRL over its share and the weights are averaged, so only a few weight
    vectors reach the driver.  Without labels all weights are 0 and every score is 0.5.
    """
    known = labels.filter(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("__d")).agg(F.max("quality").cast("double").alias("y"))
    n = known.count()
    hashed = F.pmod(F.xxhash64(F.col("__d"), F.lit("quality")), F.lit(1_000_003))
    picked = known.filter(hashed / 1_000_003 * n < sample)
    # at most about `sample` rows: safe to broadcast, so that only their texts move
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(picked), F.col("doc_id") == F.col("__d")).withColumn("h", hashed)
            .select("h", "doc_id", "y", "text"))
    learners = max(1, round(min(n, sample) / LEARNER_ROWS))
    dealt = rows.repartition(learners, F.col("doc_id")).sortWithinPartitions("h", "doc_id")

    def run(batches):
        examples = []
        for batch in batches:
            y = batch.column(2).to_pylist()
            for first, m, index, value, bounds in _sparse(batch.column(3)):
                for j in range(m):
                    i, x = index[bounds[j]:bounds[j + 1]], value[bounds[j]:bounds[j + 1]]
                    examples.append((np.append(i, SIZE).astype(np.int32), np.append(x, 1.0).astype(np.float32), y[first + j]))
        if not examples:
            return
        model = Ftrl()
        for _ in range(PASSES):
            for i, x, y in examples:
                model.learn(i, x, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary()),
                                          pa.array([len(examples)], pa.int64())], ["w", "n"])

    parts = dealt.mapInArrow(run, "w binary, n long").collect()
    if not parts:
        return np.zeros(SIZE + 1, np.float32)
    total = sum(p["n"] for p in parts)
    return sum(np.frombuffer(p["w"], np.float32).astype(np.float64) * (p["n"] / total)
               for p in sorted(parts, key=lambda p: bytes(p["w"]))).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = PREDICT_AT) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted; a null or empty text gets the bias alone."""

    def run(batches):
        for batch in batches:
            out = np.full(batch.num_rows, float(weights[SIZE]))
            for first, m, index, value, bounds in _sparse(batch.column(2)):
                row = np.repeat(np.arange(m), np.diff(bounds))  # summed text by text: no trace of its neighbours
                out[first:first + m] += np.bincount(row, weights[index] * value, m)
            p = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()),
                                              pa.array((p >= threshold).astype(np.int32), pa.int32())],
                                             ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
