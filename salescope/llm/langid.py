"""Language ID by a string kernel: blended-spectrum n-gram presence, Nystrom landmarks, one-versus-rest
kernel ridge regression.

k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), where G(x) is the set of letter n-grams (n = 1 to 4,
lower case, hashed to a fixed number of buckets) that are present in the whole text.  The model is
fitted on a bounded sample.  As the kernel is a product of presence vectors, the landmark matrix, the
Nystrom map and the ridge weights multiply into one buckets x languages matrix, and a batch of texts is
scored by one matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import small
from salescope.llm.process import give_back, per_process

BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
#: bounds of the training sample: documents per language (in expectation) and in all, and landmarks
SAMPLE_PER_LANG, SAMPLE_TOTAL, LANDMARKS = 300, 2400, 240
RIDGE = 1e-3
BATCH_ROWS, BATCH_CHARS = 64, 1 << 18
#: rows of an Arrow batch that are turned into Python strings at once
SLICE_ROWS = 512
UND = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for everything that is no letter."""
    def make() -> np.ndarray:
        table = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        return table
    return per_process("letters", make)


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x BUCKETS uint8 presence of n-grams, whether the text has a letter)."""
    table = _letters()
    codes = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = table[codes]
    lens = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    out = np.zeros((len(texts), BUCKETS), np.uint8)
    flat = out.ravel()
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lens + 1)[:len(letters)]
    end = np.repeat(starts + lens, lens + 1)[:len(letters)]
    at = np.arange(len(letters), dtype=np.int64)
    has = np.zeros(len(texts), bool)
    real = letters != 32
    has[row[real]] = True
    with np.errstate(over="ignore"):
        h = np.zeros(len(letters), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            m = len(letters) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint32(0x01000193) + letters[n - 1:] * np.uint32(0x9E3779B1) + np.uint32(n)
            if n in GRAMS:
                x = h ^ (h >> np.uint32(15))
                x = (x * np.uint32(0x85EBCA6B)) >> np.uint32(16)
                ok = at[:m] + n <= end[:m]
                flat[row[:m][ok] * BUCKETS + x[ok]] = 1
    out[~has] = 0
    return out, has


def _pieces(texts: list[str]):
    """Index ranges of at most BATCH_ROWS texts and about BATCH_CHARS characters; a long text alone."""
    first, chars = 0, 0
    for i, t in enumerate(texts):
        if i > first and (i - first >= BATCH_ROWS or chars + len(t) > BATCH_CHARS):
            yield first, i
            first, chars = i, 0
        chars += len(t)
    if first < len(texts):
        yield first, len(texts)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x languages
    bias: np.ndarray

    def decide(self, x: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(x.sum(axis=1, dtype=np.float64), 1.0))
        return (x.astype(np.float32) @ self.weights) / size[:, None] + self.bias


def fit_arrays(x: np.ndarray, y: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, packed: bool = False) -> Model:
    """Kernel ridge regression on Nystrom features of the presence rows ``x`` (uint8; bits if ``packed``)."""
    at = (lambda i: np.unpackbits(x[i], axis=1)) if packed else (lambda i: x[i])
    langs = sorted(set(y))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    label = np.array([langs.index(v) for v in y])
    per = max(1, landmarks // len(langs))
    chosen = np.concatenate([np.flatnonzero(label == c)[:per] for c in range(len(langs))])
    marks = at(chosen).astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1.0))
    k_ml = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(k_ml)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    k_xl = np.zeros((len(x), len(chosen)))
    for i in range(0, len(x), 128):
        rows = at(slice(i, i + 128)).astype(np.float32)
        k_xl[i:i + 128] = (rows @ marks.T) / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1.0))
    phi = k_xl @ root
    share = np.bincount(label, minlength=len(langs)) / len(label)
    weight = 1.0 / (share[label] * len(langs))  # every language counts alike
    target = np.where(label[:, None] == np.arange(len(langs))[None, :], 1.0, -1.0)
    mean_phi = (weight[:, None] * phi).sum(axis=0) / weight.sum()
    mean_y = (weight[:, None] * target).sum(axis=0) / weight.sum()
    centred = phi - mean_phi
    gram = centred.T @ (weight[:, None] * centred) + ridge * len(x) * np.eye(phi.shape[1])
    w = np.linalg.solve(gram, centred.T @ (weight[:, None] * (target - mean_y)))
    folded = marks.T @ (root @ w).astype(np.float32)
    return Model(langs, np.ascontiguousarray(folded, np.float32), mean_y - mean_phi @ w)


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, total: int = SAMPLE_TOTAL) -> Model:
    """Learns from text and non-null lang of documents that are not held out.

    Bound: ``per_lang`` documents per language and ``total`` in all, in expectation, picked by a hash of
    the id; executors send one presence bitmap (BUCKETS / 8 bytes) per picked document to the driver.
    """
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy(F.col("lang").alias("__l")).agg(F.count("*").alias("__n"))
    n_langs = counts.count()
    if n_langs == 0:
        return fit_arrays(np.zeros((0, BUCKETS), np.uint8), [])
    want = min(per_lang, max(2, total // n_langs))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1_000_003)) / 1_000_003
    picked = (known.join(small(counts, n_langs), F.col("lang") == F.col("__l"))
              .filter(draw * F.col("__n") < want).select(F.col("lang").cast("string").alias("lang"), draw.alias("draw"),
                                                         F.col("text").cast("string").alias("text")))

    def run(batches):
        for batch in batches:
            bits, has = [], []
            for texts in _strings(batch.column(2)):
                for a, b in _pieces(texts):
                    x, h = presence(texts[a:b])
                    bits += [r.tobytes() for r in np.packbits(x, axis=1)]
                    has += h.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())],
                                             ["lang", "draw", "bits"]).filter(pa.array(has, pa.bool_()))

    rows = picked.mapInArrow(run, "lang string, draw double, bits binary").toArrow().sort_by([("draw", "ascending"), ("lang", "ascending")])
    bits, langs = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(-1, BUCKETS // 8), rows["lang"].to_pylist()
    del rows
    model = fit_arrays(bits, langs, packed=True)
    give_back()
    return model


def _strings(column: pa.Array):
    """A text column as lists of at most SLICE_ROWS strings; nulls are empty."""
    for lo in range(0, len(column), SLICE_ROWS):
        yield [t or "" for t in column.slice(lo, SLICE_ROWS).to_pylist()]


def _named(column: pa.Array, model: Model) -> tuple[list[str], list[float]]:
    """Language and score of every text, in pieces of bounded size."""
    names, scores = [], []
    if not model.langs:
        return [UND] * len(column), [0.0] * len(column)
    for texts in _strings(column):
        for a, b in _pieces(texts):
            x, has = presence(texts[a:b])
            f = model.decide(x)
            names += [model.langs[i] if h else UND for i, h in zip(f.argmax(axis=1), has, strict=True)]
            scores += np.where(has, np.clip((f.max(axis=1) + 1) / 2, 0.0, 1.0), 0.0).tolist()
    return names, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score per document.

    ``und`` with score 0 if the text is null or has no letter (or nothing was learned).  The score is the
    winner's decision value, -1 to 1, mapped to 0 to 1; ties go to the first language by name.
    """
    def run(batches):
        for batch in batches:
            names, scores = _named(batch.column(2), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])
        give_back()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit and predict: one row per row of ``docs``, as ``predict`` says.  Null texts are ``und``; null, tied and
    repeated ids give one row each (a null id counts as held out or not by its empty checksum); texts of any
    length are read whole, in pieces; an empty table gives an empty one; other columns are not read."""
    return predict(docs, fit(docs))


#: score below which a language is not identified: 0.5 is a classifier's boundary between its language and
#: the rest, 0 stands for "not this language"; short texts have few n-grams and may lie a little below
MIN_SCORE = 0.4


def keep_identified(docs: DataFrame, languages: list[str] | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose predicted language is one of ``languages`` (None: any that was learned) with a
    score of at least ``min_score``; columns unchanged, no text is shuffled.

    The prediction alone decides, not the documents' own ``lang``.  ``und`` (null texts, texts without a letter,
    all texts where nothing was learned) is no language.  Null and repeated ids are judged row by row; equal texts
    are judged alike; texts of any length are judged whole; an empty table stays empty.
    """
    model, at = fit(docs), docs.columns.index("text")
    wanted = set(model.langs if languages is None else languages) - {UND}

    def run(batches):
        for batch in batches:
            names, scores = _named(batch.column(at), model)
            yield batch.filter(pa.array([n in wanted and s >= min_score for n, s in zip(names, scores, strict=True)], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
