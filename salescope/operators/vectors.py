"""Embeddings and exact nearest-neighbour search.

Distances are squared L2, exact, ascending, ties broken by id -- a flat index, as the
reference uses, but parallel over partitions:

* The **smaller** side (checked against ``max_broadcast`` rows and ``MAX_BROADCAST_CELLS``) is
  collected once and broadcast.  When it is over either bound, the corpus is dealt to blocks of
  near neighbours and each query visits only blocks whose bound lets them hold a better vector
  (:mod:`salescope.operators.pruned`).
* The **larger** side is streamed through ``mapInArrow``.  Each Arrow batch is scored
  against the broadcast block with numpy, and each task keeps a running top-k per query,
  so a task emits at most ``queries x k`` rows however much data it reads.  No cross
  join is planned and no all-pairs table is materialised.
* A final ``row_number`` window per query merges the per-task candidates (Spark plans a
  WindowGroupLimit before the exchange).

Text vectors are feature-hashed word counts, L2-normalised: words are maximal runs of
letters/digits of the lower-cased text, bucket = first 32 bits of ``md5(word)`` modulo
``dim``.  Tokenising and hashing run in the JVM (``split``/``transform``/``md5``); only
the per-batch counting and normalising run in numpy.  Hashing matches words, not
meanings; a neural encoder can be plugged in through :func:`encoder_udf`.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.session import checkpoint_root, materialize
from salescope.sources.partitioning import dimension_join, ensure_parallel

DEFAULT_DIM = 1 << 18
WORD_SPLIT = r"[^\p{L}\p{N}]+"
MAX_BROADCAST_ROWS = 20_000
# Upper bound on the dense score block one numpy call builds (rows x queries), and on the postings it matches
_SCORE_CELLS = 1_000_000
# array cells (words, weights) of an Arrow batch that one numpy call works on; one longer text goes alone
_PIECE_CELLS = 1_000_000


# --------------------------------------------------------------------------- hashing

def bucket_fn(dim: int, hash_fn: str = "md5") -> Callable[[Column], Column]:
    """Word -> bucket.  ``md5`` is portable across engines; ``xxhash64`` is cheaper."""
    if hash_fn == "md5":
        return lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint")
                          % F.lit(dim)).cast("int")
    if hash_fn == "xxhash64":
        return lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int")
    raise ValueError(f"unknown hash {hash_fn!r}")


def words(text: Column | str) -> Column:
    """Non-empty lower-cased letter/digit runs of a text, in order (whole text, no prefix)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), WORD_SPLIT), lambda w: w != F.lit(""))


def bucket_array(text: Column | str, dim: int = DEFAULT_DIM, hash_fn: str = "md5") -> Column:
    """``array<int>`` of word buckets, one per word occurrence (narrow, in the JVM)."""
    return F.transform(words(text), bucket_fn(dim, hash_fn))


def embed_hash(df: DataFrame, id_col: str, text_col: str, dim: int = DEFAULT_DIM,
               hash_fn: str = "md5") -> DataFrame:
    """Sparse hashed vectors as rows ``(id, bucket, weight)`` (V1).

    Narrow: :func:`sparse_embed` builds each text's vector inside its own task, and the
    arrays are exploded in place -- no shuffle, however large the corpus.
    """
    sv = sparse_embed(df, id_col, text_col, dim, hash_fn)
    return sv.select(id_col, F.explode(F.arrays_zip("idx", "val")).alias("e")) \
        .select(id_col, F.col("e.idx").alias("bucket"), F.col("e.val").alias("weight"))


def embed_hash_relational(df: DataFrame, id_col: str, text_col: str, dim: int = DEFAULT_DIM,
                          hash_fn: str = "md5") -> DataFrame:
    """The same vectors with built-ins only: explode, ``groupBy(id, bucket)``, norm window.

    Two shuffles; kept as the pure-SQL statement of the definition (tests compare both).
    """
    b = df.select(id_col, F.explode(bucket_array(text_col, dim, hash_fn)).alias("bucket"))
    c = b.groupBy(id_col, "bucket").agg(F.count(F.lit(1)).alias("cnt"))
    norm = F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).over(Window.partitionBy(id_col)))
    return c.select(id_col, "bucket", (F.col("cnt") / norm).alias("weight"))


def _list_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets starting at 0, flat values) of an Arrow list array; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offsets = np.asarray(arr.offsets, dtype=np.int64)
    values = np.asarray(arr.flatten().to_numpy(zero_copy_only=False))
    return offsets - offsets[0], values


def _pieces(rb: pa.RecordBatch, cells: str, max_rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``_PIECE_CELLS`` cells of its list column ``cells``, and ``max_rows`` rows, at most."""
    ends = np.asarray(rb.column(cells).offsets, dtype=np.int64)
    at = 0
    while at < rb.num_rows:
        until = max(int(np.searchsorted(ends, ends[at] + _PIECE_CELLS, side="right")) - 1, at + 1)
        until = min(until, rb.num_rows, at + (max_rows or rb.num_rows))
        yield rb.slice(at, until - at)
        at = until


def _give_back() -> None:
    """Return freed memory at the end of a task: Python workers live on, beside those of other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def _counts_to_sparse(offsets: np.ndarray, buckets: np.ndarray, dim: int):
    """Per row: unique buckets, L2-normalised counts.  Returns (rows, idx, val, has_tokens)."""
    n = len(offsets) - 1
    lens = np.diff(offsets)
    rows = np.repeat(np.arange(n, dtype=np.int64), lens)
    key = rows * dim + buckets.astype(np.int64)
    uk, cnt = np.unique(key, return_counts=True)
    r = uk // dim
    b = (uk % dim).astype(np.int32)
    c = cnt.astype(np.float64)
    norm = np.sqrt(np.bincount(r, weights=c * c, minlength=n))
    with np.errstate(invalid="ignore", divide="ignore"):
        w = c / norm[r]
    return r, b, w, lens > 0


def sparse_embed(df: DataFrame, id_col: str, text_col: str, dim: int = DEFAULT_DIM,
                 hash_fn: str = "md5", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per text with a token: ``(id, idx array<int>, val array<double>, keep...)``.

    Narrow: tokenising in the JVM, counting and normalising per Arrow batch in numpy;
    no shuffle.  Texts without any word have no vector and are dropped.
    """
    src = ensure_parallel(df.select(id_col, text_col, *[k for k in keep if k != text_col]), id_col)
    src = src.select(F.col(id_col).alias("_id"), bucket_array(text_col, dim, hash_fn).alias("_b"),
                     *keep)
    keep_fields = [f for f in src.schema.fields if f.name in keep]
    id_type = src.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, idx array<int>, val array<double>" + "".join(
        f", `{f.name}` {f.dataType.simpleString()}" for f in keep_fields)

    def to_sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rb in _pieces(whole, "_b"):
                offsets, vals = _list_parts(rb.column("_b"))
                r, b, w, has = _counts_to_sparse(offsets, vals, dim)
                starts = np.searchsorted(r, np.arange(len(has) + 1))
                idx = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(b))
                val = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(w))
                cols = [rb.column("_id"), idx, val] + [rb.column(k) for k in keep]
                out = pa.RecordBatch.from_arrays(cols, ["_id", "idx", "val", *keep])
                yield out.filter(pa.array(has))
        _give_back()

    return src.mapInArrow(to_sparse, schema).withColumnRenamed("_id", id_col)


# --------------------------------------------------------------------------- scoring

class _SparseSide:
    """A broadcast block of sparse vectors, indexed by bucket (CSR by bucket)."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, idx: np.ndarray, val: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        rows = np.repeat(np.arange(len(ids)), np.diff(offsets))
        col = np.empty(len(ids), dtype=np.int64)
        col[order] = np.arange(len(ids))
        cols = col[rows]
        o = np.lexsort((cols, idx))
        self.bkt = idx[o].astype(np.int64)
        self.col = cols[o]
        self.w = val[o].astype(np.float64)
        self.ub, self.start = np.unique(self.bkt, return_index=True)
        self.end = np.append(self.start[1:], len(self.bkt))
        self.n = len(ids)
        self.cells_per_row = max(self.n, 1)

    def dots(self, rows: np.ndarray, idx: np.ndarray, val: np.ndarray, n_rows: int) -> np.ndarray:
        """(n_rows x n) dot products between streamed sparse rows and this block."""
        if len(idx) == 0 or self.n == 0:
            return np.zeros((n_rows, self.n))
        pos = np.searchsorted(self.ub, idx)
        pos_c = np.minimum(pos, len(self.ub) - 1)
        hit = self.ub[pos_c] == idx
        e_rows, e_val, p = rows[hit], val[hit], pos_c[hit]
        cnt = self.end[p] - self.start[p]
        done = np.concatenate(([0], np.cumsum(cnt)))
        out = np.zeros((n_rows, self.n))
        at = 0
        while at < len(cnt):  # whole rows with about _SCORE_CELLS matched postings at a time
            until = max(int(np.searchsorted(done, done[at] + _SCORE_CELLS, side="right")) - 1, at + 1)
            until = int(np.searchsorted(e_rows, e_rows[until - 1], side="right"))
            c = cnt[at:until]
            low, high = e_rows[at], e_rows[until - 1] + 1
            j = np.repeat(self.start[p[at:until]] - (done[at:until] - done[at]), c) + np.arange(done[until] - done[at])
            cell = np.repeat(e_rows[at:until] - low, c) * self.n + self.col[j]
            part = np.bincount(cell, np.repeat(e_val[at:until], c) * self.w[j], (high - low) * self.n)
            out[low:high] = part.reshape(high - low, self.n)
            at = until
        return out


class _DenseSide:
    def __init__(self, ids: np.ndarray, mat: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.mat = mat[order].astype(np.float64)
        self.n = len(ids)
        self.cells_per_row = max(self.n, 1)

    def d2(self, x: np.ndarray, k: int) -> np.ndarray:
        """Squared distances by one matrix product; those that may be among a column's or row's
        ``k`` best are computed again from the differences, so that ranks are exact."""
        own, other = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", self.mat, self.mat)
        out = np.maximum(own[:, None] + other[None, :] - 2.0 * (x @ self.mat.T), 0.0)
        slack = 1e-7 * (1.0 + own.max(initial=0.0) + other.max(initial=0.0))
        near = np.zeros(out.shape, dtype=bool)
        for axis in (0, 1):
            kth = np.partition(out, min(k, out.shape[axis]) - 1, axis=axis).take([min(k, out.shape[axis]) - 1], axis=axis)
            near |= out <= kth + slack
        r, c = np.nonzero(near)
        for s in range(0, len(r), 4096):
            diff = x[r[s:s + 4096]] - self.mat[c[s:s + 4096]]
            out[r[s:s + 4096], c[s:s + 4096]] = np.einsum("ij,ij->i", diff, diff)
        return out


def _topk_merge(best: dict[str, np.ndarray] | None, d2: np.ndarray, ids: np.ndarray,
                k: int) -> dict[str, np.ndarray]:
    """Running per-column top-k (by round(d2, 9), then id) of a (rows x queries) block."""
    if len(d2) > 4 * k:  # only the k-th best and its ties can rank: sort those, not the block
        key = np.round(d2, 9)
        kth = np.partition(key, k - 1, axis=0)[k - 1]
        if best is not None and len(best["d2"]) >= k:
            kth = np.minimum(kth, np.round(best["d2"], 9)[k - 1])
        alive = (key <= kth).any(axis=1)
        d2, ids = d2[alive], ids[alive]
    if best is not None:
        d2 = np.vstack([best["d2"], d2])
        ids = np.vstack([best["ids"], ids])
    key = np.round(d2, 9)
    tie = ids.astype(str) if ids.dtype == object else ids
    order = np.lexsort((tie, key), axis=0)[:k]
    return {"d2": np.take_along_axis(d2, order, axis=0),
            "ids": np.take_along_axis(ids, order, axis=0)}


_ROW = "_block_row"
# array cells of a broadcast block, at most: with 12 bytes each, 240 MB
MAX_BROADCAST_CELLS = 20_000_000


def _collect_side(df: DataFrame, max_rows: int) -> pa.Table:
    """Collect one block whose row count :func:`_blocks` has already checked."""
    tbl = df.toArrow()
    if tbl.num_rows > max_rows:
        raise ValueError(f"broadcast block has {tbl.num_rows} rows, over the cap {max_rows}")
    return tbl


def _size(df: DataFrame, cells: str) -> tuple[int, int]:
    """(rows, array cells) of a side; counts only."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.size(cells).cast("long"))).first()
    return n, total or 0


def _n_blocks(rows: int, cells: int, max_rows: int) -> int:
    """Blocks so many that one holds about 0.7 of either bound at most."""
    return max(1, int(np.ceil(rows / (max_rows * 0.7))), int(np.ceil(cells / (MAX_BROADCAST_CELLS * 0.7))))


def _final_topk(cands: DataFrame, qid: str, id_col: str, k: int) -> DataFrame:
    w = Window.partitionBy(qid).orderBy(F.round("d2", 9), F.col(id_col))
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _score_batches(batches, blk, stream_id: str, score, k: int, q_is_stream: bool, qid: str, id_col: str) -> Iterator[pa.RecordBatch]:
    """Top-k rows of streamed batches against a block.

    ``q_is_stream``: per streamed row over the block; otherwise a running top-k per row of the block.
    """
    best = None
    for rb in batches:
        if rb.num_rows == 0 or blk.n == 0:
            continue
        sids = np.asarray(rb.column(stream_id).to_numpy(zero_copy_only=False))
        step, s = max(1, _SCORE_CELLS // blk.cells_per_row), 0
        for part in _pieces(rb, "idx" if "idx" in rb.schema.names else "vec", step):
            d2 = score(blk, part, k)
            pids = sids[s:s + part.num_rows]
            s += part.num_rows
            if q_is_stream:
                kk = min(k, blk.n)
                key = np.round(d2, 9)  # block ids are sorted, so a stable sort ties by id
                order = np.argsort(key, axis=1, kind="stable")[:, :kk]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(pids, kk)), pa.array(blk.ids[order].ravel()),
                     pa.array(np.take_along_axis(d2, order, axis=1).ravel())], [qid, id_col, "d2"])
            else:
                best = _topk_merge(best, d2, np.repeat(pids[:, None], blk.n, axis=1), k)
    if best is not None and not q_is_stream:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(blk.ids, best["d2"].shape[0])), pa.array(best["ids"].ravel()), pa.array(best["d2"].ravel())],
            [qid, id_col, "d2"])


def _scan_topk(stream: DataFrame, stream_id: str, side, score, k: int, q_is_stream: bool,
               qid: str, id_col: str, id_type: str, qid_type: str, cols: list[str]) -> DataFrame:
    """Stream ``stream`` through ``score`` against the broadcast ``side``; emit top-k rows.

    ``q_is_stream``: the streamed rows are the queries (top-k over the block, per row);
    otherwise the streamed rows are the corpus (running top-k per block column).
    """
    sc = stream.sparkSession.sparkContext
    bside = sc.broadcast(side)
    schema = f"`{qid}` {qid_type}, `{id_col}` {id_type}, d2 double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _score_batches(batches, _build_side(bside.value), stream_id, score, k, q_is_stream, qid, id_col)
        _give_back()

    return stream.select(*cols).mapInArrow(run, schema)


def _sparse_score(blk: _SparseSide, rb: pa.RecordBatch, _k: int) -> np.ndarray:
    offsets, idx = _list_parts(rb.column("idx"))
    _, val = _list_parts(rb.column("val"))
    rows = np.repeat(np.arange(rb.num_rows, dtype=np.int64), np.diff(offsets))
    dots = blk.dots(rows, idx.astype(np.int64), val.astype(np.float64), rb.num_rows)
    return 2.0 - 2.0 * dots


def _dense_score(blk: _DenseSide, rb: pa.RecordBatch, k: int) -> np.ndarray:
    offsets, vals = _list_parts(rb.column("vec"))
    dim = blk.mat.shape[1]
    if len(vals) != rb.num_rows * dim or np.any(np.diff(offsets) != dim):
        raise ValueError("all vectors must have the same dimension as the queries")
    return blk.d2(vals.astype(np.float64).reshape(rb.num_rows, dim), k)


def _sparse_block(tbl: pa.Table, id_col: str) -> tuple:
    """Plain arrays (picklable without this package) describing a sparse block."""
    ids = np.asarray(tbl.column(id_col).to_numpy())
    offsets, idx = _list_parts(tbl.column("idx"))
    _, val = _list_parts(tbl.column("val"))
    return ("sparse", ids, offsets, idx.astype(np.int64), val.astype(np.float64))


def _dense_block(tbl: pa.Table, id_col: str) -> tuple:
    ids = np.asarray(tbl.column(id_col).to_numpy())
    offsets, vals = _list_parts(tbl.column("vec"))
    dim = int(offsets[1] - offsets[0]) if len(ids) else 0
    return ("dense", ids, np.asarray(vals, dtype=np.float64).reshape(len(ids), dim))


def _build_side(state: tuple):
    """Rebuild the scoring object inside the task from the broadcast arrays."""
    if state[0] == "sparse":
        return _SparseSide(*state[1:])
    return _DenseSide(*state[1:])


def _search(queries: DataFrame, corpus: DataFrame, qid: str, id_col: str, k: int,
            payload: list[str], make_block, score, max_broadcast: int,
            broadcast_side: str | None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Exact top-k per query; see the module docstring for the plan.

    ``sizes`` (queries, corpus) picks the broadcast side without computing the inputs;
    without it both are counted.  The broadcast side is checkpointed once to the shared
    checkpoint folder, so sizing and collecting it never recomputes it.
    """
    qid_type = queries.schema[qid].dataType.simpleString()
    id_type = corpus.schema[id_col].dataType.simpleString()
    if broadcast_side is None:
        nq, nc = sizes if sizes is not None else (queries.count(), corpus.count())
        broadcast_side = "queries" if nq <= nc else "corpus"
    checkpoint_root(queries.sparkSession)
    corpus_small = broadcast_side == "corpus"
    side, side_id, stream, stream_id = (corpus, id_col, queries, qid) if corpus_small else (queries, qid, corpus, id_col)
    side = side.select(side_id, *payload).checkpoint(eager=True)
    rows, cells = _size(side, payload[0])
    if rows == 0:
        schema = f"`{qid}` {qid_type}, `{id_col}` {id_type}, d2 double, rank int"
        return queries.sparkSession.createDataFrame([], schema)
    if rows <= max_broadcast and cells <= MAX_BROADCAST_CELLS:
        blk = make_block(_collect_side(side, max_broadcast), side_id)
        cands = _scan_topk(stream, stream_id, blk, score, k, corpus_small, qid, id_col, id_type, qid_type, [stream_id, *payload])
    else:
        from salescope.operators import pruned  # it builds on this module

        other = materialize(stream.select(stream_id, *payload))
        q, c = (other, side) if corpus_small else (side, other)
        cands = pruned.candidates(q, c, qid, id_col, k, payload, make_block, score, max_broadcast)
    return _final_topk(cands, qid, id_col, k)


def search_sparse(queries: DataFrame, corpus: DataFrame, k: int = 5, qid: str = "qid",
                  id_col: str = "id", max_broadcast: int = MAX_BROADCAST_ROWS,
                  broadcast_side: str | None = None,
                  sizes: tuple[int, int] | None = None) -> DataFrame:
    """Exact top-k by squared L2 between sparse unit vectors ``(id, idx, val)`` (V3/V4).

    ``d2 = 2 - 2 * dot``.  Corpus rows sharing no bucket with a query have d2 = 2 and
    fill the list, by id, when fewer than k rows overlap; if the corpus has fewer than k
    rows, all of them are returned.  Output: ``qid, id, d2, rank``.
    """
    return _search(queries, corpus, qid, id_col, k, ["idx", "val"], _sparse_block,
                   _sparse_score, max_broadcast, broadcast_side, sizes)


def knn_dense(queries: DataFrame, vectors: DataFrame, k: int = 5, qid: str = "qid",
              id_col: str = "id", max_broadcast: int = MAX_BROADCAST_ROWS,
              broadcast_side: str | None = None,
              sizes: tuple[int, int] | None = None) -> DataFrame:
    """Exact k nearest dense vectors (column ``vec``) by squared L2 (V3)."""
    return _search(queries, vectors, qid, id_col, k, ["vec"], _dense_block, _dense_score,
                   max_broadcast, broadcast_side, sizes)


def text_search(questions: DataFrame, texts: DataFrame, k: int = 5, qid: str = "qid",
                question: str = "question", id_col: str = "id", text: str = "text",
                dim: int = DEFAULT_DIM, hash_fn: str = "md5", with_text: bool = True,
                max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Questions x texts, k nearest texts per question by hashed word vectors (V4).

    The side with fewer rows (counted on the inputs, before embedding) is broadcast.
    When the texts are broadcast they carry their text along; otherwise the hits (at
    most questions x k rows) are joined back to the texts by id -- broadcast while that
    bound is under ``salescope.broadcast.maxRows``, so the text column is read but not
    shuffled, and a sort-merge join beyond it.
    """
    checkpoint_root(questions.sparkSession)
    nq, nc = questions.count(), texts.count()
    corpus_small = nc < nq
    q = sparse_embed(questions, qid, question, dim, hash_fn)
    c = sparse_embed(texts, id_col, text, dim, hash_fn, keep=(text,) if corpus_small else ())
    if corpus_small:
        c = c.checkpoint(eager=True)
    hits = search_sparse(q, c, k, qid, id_col, max_broadcast=max_broadcast,
                         broadcast_side="corpus" if corpus_small else "queries")
    if not with_text:
        return hits
    # hits are at most questions x k rows: broadcast only when that bound is under the cap
    source = c if corpus_small else texts
    joined = dimension_join(source.select(id_col, text), hits, id_col, bound_rows=nq * k)
    return joined.select(qid, "rank", id_col, "d2", text)


# labels that a task adds up before it hands on its sums
_LABELS = 10_000


def label_centroids(vectors: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per label: ``(label, vec array<double>)`` (element-wise mean; null vectors are skipped).

    Each task adds up its own vectors per label, so what is exploded and shuffled is one sum per
    label and task (or per ``_LABELS`` labels seen), not every vector.
    """
    rows = vectors.where(F.col(vec).isNotNull()).select(label, F.col(vec).cast("array<double>").alias("v"))
    kind = rows.schema[label].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Any, list] = {}

        def flush() -> pa.RecordBatch:
            names = list(held)
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, id_type), pa.array([held[n][0].tolist() for n in names], pa.list_(pa.float64())),
                 pa.array([held[n][1] for n in names], pa.int64())], ["l", "s", "n"])
            held.clear()
            return out

        id_type = pa.null()
        for rb in batches:
            id_type = rb.column(0).type
            offsets, flat = _list_parts(rb.column(1))
            width = np.diff(offsets)
            if rb.num_rows and np.any(width != width[0]):
                raise ValueError("all vectors must have the same dimension")
            names = np.array(rb.column(0).to_pylist(), dtype=object)
            mat = flat.astype(np.float64).reshape(rb.num_rows, -1)
            for name in dict.fromkeys(names.tolist()):
                mine = mat[[n == name if n is not None else name is None for n in names]]
                if name in held:
                    held[name][0] += mine.sum(axis=0)
                    held[name][1] += len(mine)
                else:
                    held[name] = [mine.sum(axis=0), len(mine)]
            if len(held) > _LABELS:
                yield flush()
        if held:
            yield flush()

    part = rows.mapInArrow(sums, f"l {kind}, s array<double>, n long")
    e = part.select("l", "n", F.posexplode("s").alias("pos", "x"))
    m = e.groupBy("l", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    return m.groupBy(F.col("l").alias(label)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
        .alias("vec"))


# --------------------------------------------------------------------------- encoder hook

def encoder_udf(load_model: Callable[[], Any], dim: int) -> Callable[[Column], Column]:
    """Pluggable sentence encoder (U2): a Series->Series iterator ``pandas_udf``.

    ``load_model()`` runs once per Python worker, not per row; the model's ``encode``
    receives whole Arrow batches of texts and returns a (rows x dim) array.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            mat = np.asarray(model.encode(texts.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(mat.reshape(len(texts), dim)))

    return encode
