"""Exact nearest-neighbour search between two large sides, with block pairs skipped by bounds.

The corpus is dealt to blocks of near neighbours: each vector goes to its nearest pivot (a bounded sample,
clustered), and a pivot's vectors are cut by their distance from it into rings.  Then

1. every query visits the blocks that look nearest, until they hold ``k`` vectors: the k-th best of
   those is a bound that the answer cannot exceed;
2. it visits every block whose lower bound does not exceed that; no other pair of query and block is
   copied or scored.

Lower bounds: for dense vectors the triangle inequality around the block's pivot (outer and inner radius
of the ring, and the plane between two pivots); for sparse unit vectors posting lists of bucket maxima
(a block's best possible dot product is the sum of query weight times the largest weight of the bucket
in the block).  A block without a common bucket has d2 = 2 throughout; the ``k`` smallest ids form a block
of their own, so that back-filling by id needs no other such block.

Visits of a much-visited block are split over several tasks (the block is copied to each), so a group never
holds more than ``max_rows`` of either side.  Dense vectors move by runs of blocks: a query is copied once to
each run of which it visits a block, with the visited ones as bits, and a group holds at most ``GROUP_CELLS``
cells of either side (and one block more).  So what moves grows with the runs, not with the visits.  The driver
sees counts and the pivots' bounded sample only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescope.operators import vectors as V
from salescope.operators.ordering import with_place
from salescope.session import materialize
from salescope.sources.partitioning import dimension_join

MAX_PIVOTS, SAMPLE_ROWS, MAX_BLOCKS = 256, 4096, 100_000
#: dimensions that sparse vectors are folded to when blocks of neighbours are formed
FOLD = 64
#: cells (rows x dimension) of either side that a group of dense vectors holds
GROUP_CELLS = 1 << 21
#: runs of blocks that a table of several times ``max_rows`` is dealt to at least, for parallel tasks
MIN_RUNS = 8
#: rows whose distances from all pivots are computed at once
ASSIGN_ROWS = 2048
_SLACK = 1e-8


def _dense_matrix(rb: pa.RecordBatch, dim: int) -> np.ndarray:
    offsets, flat = V._list_parts(rb.column("vec"))
    if len(flat) != rb.num_rows * dim or np.any(np.diff(offsets) != dim):
        raise ValueError("all vectors must have the same dimension as the queries")
    return flat.astype(np.float64).reshape(rb.num_rows, dim)


def _folded_matrix(rb: pa.RecordBatch, dim: int) -> np.ndarray:
    offsets, idx = V._list_parts(rb.column("idx"))
    _, val = V._list_parts(rb.column("val"))
    rows = np.repeat(np.arange(rb.num_rows), np.diff(offsets))
    return np.bincount(rows * dim + idx.astype(np.int64) % dim, val, rb.num_rows * dim).reshape(rb.num_rows, dim)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between rows, by differences where the product form would cancel."""
    d2 = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _pivots(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """``n`` pivots: farthest-first over the sample, then a few steps towards cluster means."""
    chosen = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    pivots = sample[chosen]
    for _ in range(rounds):
        own = _distances(sample, pivots).argmin(axis=1)
        for i in np.unique(own):
            pivots[i] = sample[own == i].mean(axis=0)
    return pivots


class Blocks:
    """The corpus in blocks: ``rows`` (id, payload, block) and what bounds need (one entry per block)."""

    def __init__(self, rows: DataFrame, pivots: np.ndarray, cell: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.rows, self.pivots, self.cell, self.n, self.low, self.high = rows, pivots, cell, n, low, high


def _error(pivots: np.ndarray) -> float:
    """What rounding may add to a distance from a pivot, by the vectors' size."""
    return 1e-6 * (1.0 + float(np.abs(pivots).max(initial=0.0)) * max(pivots.shape[1], 1))


def deal_blocks(corpus: DataFrame, id_col: str, payload: list[str], rows: int, max_rows: int, cells: int, first: int,
                to_matrix: Callable) -> Blocks:
    """Deal ``corpus`` (a checkpointed table of ``rows`` rows and ``cells`` array cells) to blocks of neighbours.

    ``first``: so many smallest ids (and rows that repeat them) form the first blocks (0 for none).
    """
    n_blocks = min(V._n_blocks(rows, cells, max_rows), MAX_BLOCKS)
    size = max(1, -(-rows // n_blocks))
    sampled = corpus.select(*payload).orderBy(F.xxhash64(*payload)).limit(SAMPLE_ROWS).toArrow().combine_chunks().to_batches()
    dim = len(sampled[0].column("vec")[0]) if payload == ["vec"] else FOLD
    sample = np.concatenate([to_matrix(b, dim) for b in sampled])
    pivots = _pivots(sample, min(MAX_PIVOTS, max(n_blocks, 1)))
    shared = corpus.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for rb in batches:
            for part in V._pieces(rb, payload[0], ASSIGN_ROWS):
                d = _distances(to_matrix(part, dim), shared.value)
                cell = d.argmin(axis=1)
                near = d[np.arange(part.num_rows), cell]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(near)], [*part.schema.names, "__cell", "__dist"])
        V._give_back()

    columns = [id_col, *payload]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in corpus.select(*columns).schema) + ", __cell int, __dist double"
    dealt = corpus.select(*columns).mapInArrow(assign, schema)
    if first:  # the smallest ids are a cell of their own, before all others
        smallest = corpus.select(F.col(id_col).alias("__id")).orderBy("__id").limit(first)
        last = materialize(smallest).agg(F.max("__id").alias("x"))
        dealt = dealt.withColumn("__cell", F.when(F.col(id_col) <= last.scalar(), -1).otherwise(F.col("__cell")))
    placed = with_place(dealt, [F.col("__cell"), F.col("__dist"), F.col(id_col)], "__place")
    starts = materialize(placed.groupBy("__cell").agg(F.min("__place").alias("__start")))
    placed = dimension_join(placed, starts, "__cell", bound_rows=MAX_PIVOTS + 1)
    ring = F.floor((F.col("__place") - F.col("__start")) / size)
    blocked = materialize(placed.withColumn("__ring", ring.cast("long")))
    # at most MAX_BLOCKS rings of full size and one more per cell
    stats = (blocked.groupBy("__cell", "__ring").agg(F.count(F.lit(1)).alias("n"), F.min("__dist").alias("low"), F.max("__dist").alias("high"))
             .orderBy("__cell", "__ring").toArrow())
    cell, rings = stats["__cell"].to_numpy(), stats["__ring"].to_numpy()
    origin = np.searchsorted(cell, np.arange(-1, len(pivots)))  # first block of each cell
    at = F.element_at(F.lit([int(x) for x in origin]), F.col("__cell") + 2) + F.col("__ring")
    return Blocks(blocked.select(*columns, at.cast("int").alias("block")), pivots, cell, stats["n"].to_numpy(), stats["low"].to_numpy(), stats["high"].to_numpy())


# ------------------------------------------------------------------- which blocks a query visits

def _runs(blocks: Blocks, max_rows: int) -> np.ndarray:
    """Run of every block: consecutive blocks that together hold about ``GROUP_CELLS`` cells at most."""
    total = int(blocks.n.sum())
    rows = min(max(GROUP_CELLS // max(blocks.pivots.shape[1], 1), 1), max(max_rows, -(-total // MIN_RUNS)))
    return np.unique((np.cumsum(blocks.n) - blocks.n) // rows, return_inverse=True)[1]


def _dense_visits(queries: DataFrame, qid: str, blocks: Blocks, run_of: np.ndarray, k: int) -> DataFrame:
    """(qid, vec, limit, run, visits): one row per query and run of blocks, ``visits`` holds a bit per block of the run.

    With a column ``limit`` (a bound of d2) every block that may hold a better vector; without it the nearest
    blocks that hold ``k`` together.
    """
    shared = queries.sparkSession.sparkContext.broadcast((blocks.pivots, blocks.cell, blocks.n, blocks.low, blocks.high, run_of))
    bounded = "limit" in queries.columns
    schema = f"`{qid}` {queries.schema[qid].dataType.simpleString()}, vec {queries.schema['vec'].dataType.simpleString()}, limit double, run int, visits binary"

    def run(batches):
        pivots, cell, n, low, high, runs = shared.value
        slack = _error(pivots)
        first = np.searchsorted(runs, np.arange(runs[-1] + 2))
        for rb in batches:
            step = max(1, V._SCORE_CELLS // max(len(n), len(pivots), 1))
            for s in range(0, rb.num_rows, step):
                part = rb.slice(s, step)
                d = _distances(_dense_matrix(part, pivots.shape[1]), pivots)
                own = d[:, cell]
                if bounded:
                    limit = part.column("limit").to_numpy(zero_copy_only=False)
                    least = np.maximum(np.maximum(own - high, low - own), (own - d.min(axis=1)[:, None]) / 2)
                    reach = np.sqrt(limit + _SLACK)
                    go = least <= (reach + slack * (1 + reach))[:, None]
                else:
                    limit = np.full(part.num_rows, np.inf)
                    order = np.argsort(own + high, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    go = np.zeros(own.shape, bool)
                    np.put_along_axis(go, order, before < k, axis=1)
                for i in range(len(first) - 1):
                    bits = go[:, first[i]:first[i + 1]]
                    row = np.flatnonzero(bits.any(axis=1))
                    if len(row):
                        packed = [x.tobytes() for x in np.packbits(bits[row], axis=1)]
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(limit[row]),
                             pa.array(np.full(len(row), i, np.int32)), pa.array(packed, pa.binary())], [qid, "vec", "limit", "run", "visits"])
        V._give_back()

    return queries.select(qid, "vec", *(["limit"] if bounded else [])).mapInArrow(run, schema)


class _SparseBounds:
    """Largest possible dot product of every query and block with a common bucket."""

    def __init__(self, queries: DataFrame, blocks: Blocks):
        postings = (blocks.rows.select("block", F.explode(F.arrays_zip("idx", "val")).alias("e"))
                    .groupBy("block", F.col("e.idx").alias("idx")).agg(F.max("e.val").alias("most")))
        own = queries.select("__q", F.explode(F.arrays_zip("idx", "val")).alias("e")).select("__q", F.col("e.idx").alias("idx"), F.col("e.val").alias("w"))
        self.best = materialize(own.join(postings, "idx").groupBy("__q", "block").agg(F.sum(F.col("w") * F.col("most")).alias("best")))
        self.first = int((blocks.cell < 0).sum())
        self.sizes = queries.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(blocks.n)], "block int, n long")

    def home(self, k: int) -> DataFrame:
        """The most promising blocks that hold ``k`` texts together."""
        w = Window.partitionBy("__q").orderBy(F.col("best").desc(), "block").rowsBetween(Window.unboundedPreceding, -1)
        sized = dimension_join(self.best, self.sizes, "block", bound_rows=MAX_BLOCKS + MAX_PIVOTS + 1)
        return sized.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < k).select("__q", "block")


def _sparse_visits(queries: DataFrame, bounds: _SparseBounds, k: int) -> DataFrame:
    zero = F.explode(F.sequence(F.lit(0), F.lit(bounds.first - 1))).alias("block")
    if "limit" in queries.columns:
        limits = queries.select("__q", "limit")
        may = bounds.best.join(limits, "__q").where(2.0 - 2.0 * F.col("best") <= F.col("limit") + _SLACK).select("__q", "block")
        fill = limits.where(F.col("limit") >= 2.0 - _SLACK).select("__q", zero)
    else:
        may, fill = bounds.home(k), queries.select("__q", zero)
    return queries.drop("limit").join(may.unionByName(fill).distinct(), "__q")


# ------------------------------------------------------------------- scoring visits

def _score_visits(visits: DataFrame, blocks: Blocks, qid: str, id_col: str, payload: list[str], make_block, score, k: int, max_rows: int) -> DataFrame:
    """Top-k candidates of every visited block; ``visits``: qid, payload, block (checkpointed)."""
    per = materialize(visits.groupBy("block").agg(F.count(F.lit(1)).alias("v"), F.sum(F.size(payload[0]).cast("long")).alias("c"))
                      .select("block", F.greatest(F.ceil(F.col("v") / F.lit(max_rows)), F.ceil(F.col("c") / F.lit(V.MAX_BROADCAST_CELLS))).cast("int").alias("chunks")))
    bound = MAX_BLOCKS + MAX_PIVOTS + 1
    left = dimension_join(visits.withColumn("__r", F.monotonically_increasing_id()), per, "block", bound_rows=bound)
    left = left.select("block", F.pmod(F.xxhash64("__r"), F.col("chunks")).cast("int").alias("chunk"), qid, *[F.col(c).alias(f"q_{c}") for c in payload])
    right = dimension_join(blocks.rows, per, "block", bound_rows=bound)  # blocks that nobody visits end here
    right = right.select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), id_col, *payload)
    qid_type, id_type = visits.schema[qid].dataType.simpleString(), blocks.rows.schema[id_col].dataType.simpleString()

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        out = []
        if one.num_rows and two.num_rows:
            own = one.select([qid, *[f"q_{c}" for c in payload]]).rename_columns([qid, *payload])
            batches = two.select([id_col, *payload]).combine_chunks().to_batches()
            out = list(V._score_batches(batches, V._build_side(make_block(own, qid)), id_col, score, k, False, qid, id_col))
        schema = pa.schema([(qid, one.schema.field(qid).type), (id_col, two.schema.field(id_col).type), ("d2", pa.float64())])
        return pa.Table.from_batches(out).cast(schema) if out else schema.empty_table()

    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(run, f"`{qid}` {qid_type}, `{id_col}` {id_type}, d2 double")


class _Nearest:
    """The ``k`` nearest vectors per query of a group, found block by block; ties go to the smaller id."""

    def __init__(self, x: np.ndarray, y: np.ndarray, order: np.ndarray, limit: np.ndarray, k: int):
        self.x, self.y, self.k = x, y, k
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.bound = limit.copy()  # of d2: nothing above it is among the k nearest
        self.own, self.other = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        self.slack = 1e-7 * (1.0 + self.own.max(initial=0.0) + self.other.max(initial=0.0))
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = self.kept = 0

    def visit(self, rows: np.ndarray, low: int, high: int) -> None:
        """Compare the queries ``rows`` with the vectors ``low`` to ``high``, distances exact where they may count."""
        step = max(1, V._SCORE_CELLS // (high - low))
        for s in range(0, len(rows), step):
            r = rows[s:s + step]
            out = np.maximum(self.own[r, None] + self.other[None, low:high] - 2.0 * (self.x[r] @ self.y[low:high].T), 0.0)
            near = np.flatnonzero(out.min(axis=1) <= self.bound[r] + self.slack)
            if not len(near):
                continue
            r, out = r[near], out[near]
            if high - low >= self.k:
                self.bound[r] = np.minimum(self.bound[r], np.partition(out, self.k - 1, axis=1)[:, self.k - 1] + self.slack)
            at, c = np.nonzero(out <= self.bound[r, None] + self.slack)
            q, c = r[at], c + low
            d2 = np.empty(len(q))
            for i in range(0, len(q), 4096):
                diff = self.x[q[i:i + 4096]] - self.y[c[i:i + 4096]]
                d2[i:i + 4096] = np.einsum("ij,ij->i", diff, diff)
            self.found.append((q, c, d2))
            self.held += len(q)
            if self.held > self.kept + V._SCORE_CELLS:
                self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, d2) of the nearest so far; their k-th becomes the bound."""
        q, c, d2 = (np.concatenate(x) for x in zip(*self.found, strict=True)) if self.found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((self.rank[c], np.round(d2, 9), q))
        q, c, d2 = q[order], c[order], d2[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        q, c, d2, place = q[keep], c[keep], d2[keep], place[keep]
        last = place == self.k - 1
        self.bound[q[last]] = np.minimum(self.bound[q[last]], d2[last] + self.slack)
        self.found, self.held, self.kept = [(q, c, d2)], len(q), len(q)
        return q, c, d2


def _score_runs(visits: DataFrame, blocks: Blocks, run_of: np.ndarray, qid: str, id_col: str, k: int) -> DataFrame:
    """Top-k candidates of every visited block; ``visits`` as :func:`_dense_visits` gives them (checkpointed)."""
    spark, dim = visits.sparkSession, max(blocks.pivots.shape[1], 1)
    first = np.searchsorted(run_of, run_of)  # first block of each block's run
    most = int(np.bincount(run_of, blocks.n).max())  # rows of the largest run: a group's queries are no more
    sizes = spark.createDataFrame([(i, int(r), int(i - f)) for i, (r, f) in enumerate(zip(run_of, first, strict=True))], "block int, run int, at int")
    rows = min(most, max(GROUP_CELLS // dim, 1))
    per = materialize(visits.groupBy("run").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("chunks")))
    bound = MAX_BLOCKS + MAX_PIVOTS + 1
    left = dimension_join(visits.withColumn("__r", F.monotonically_increasing_id()), per, "run", bound_rows=bound)
    left = left.select("run", F.pmod(F.xxhash64("__r"), F.col("chunks")).cast("int").alias("chunk"), qid, F.col("vec").alias("q_vec"), "limit", "visits")
    right = dimension_join(blocks.rows, dimension_join(sizes, per, "run", bound_rows=bound), "block", bound_rows=bound)  # runs that nobody visits end here
    right = right.select("run", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "at", id_col, "vec")
    qid_type, id_type = visits.schema[qid].dataType.simpleString(), blocks.rows.schema[id_col].dataType.simpleString()

    def matrix(table: pa.Table, column: str, dim: int | None = None) -> np.ndarray:
        offsets, flat = V._list_parts(table.column(column))
        dim = int(offsets[1]) if dim is None else dim
        if np.any(np.diff(offsets) != dim):
            raise ValueError("all vectors must have the same dimension as the queries")
        return flat.astype(np.float64).reshape(table.num_rows, dim)

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        schema = pa.schema([(qid, one.schema.field(qid).type), (id_col, two.schema.field(id_col).type), ("d2", pa.float64())])
        if not one.num_rows or not two.num_rows:
            return schema.empty_table()
        two = two.take(pc.sort_indices(two.column("at")))
        at = two.column("at").to_numpy()
        x = matrix(one, "q_vec")
        order = pc.sort_indices(two.column(id_col), null_placement="at_start").to_numpy()
        nearest = _Nearest(x, matrix(two, "vec", x.shape[1]), order, one.column("limit").to_numpy(), k)
        bits = np.unpackbits(np.frombuffer(b"".join(one.column("visits").to_pylist()), np.uint8).reshape(len(x), -1), axis=1)
        edges = np.flatnonzero(np.diff(at, prepend=-1, append=at[-1] + 1))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            nearest.visit(np.flatnonzero(bits[:, at[low]]), int(low), int(high))
        q, c, d2 = nearest.best()
        out = pa.table([one.column(qid).take(pa.array(q)), two.column(id_col).take(pa.array(c)), pa.array(d2)], schema=schema)
        V._give_back()
        return out

    return left.groupBy("run", "chunk").cogroup(right.groupBy("run", "chunk")).applyInArrow(run, f"`{qid}` {qid_type}, `{id_col}` {id_type}, d2 double")


def visited_pairs(visits: DataFrame, blocks: Blocks, run_of: np.ndarray | None = None) -> int:
    """How many pairs of query and vector the visits score."""
    sizes = visits.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(blocks.n)], "block int, n long")
    if run_of is not None:  # one row per set bit
        first = [int(x) for x in np.searchsorted(run_of, np.arange(run_of[-1] + 1))]
        bit = F.explode(F.sequence(F.lit(0), F.octet_length("visits") * 8 - 1)).alias("bit")
        one = visits.select("run", "visits", bit).where(
            F.substring(F.lpad(F.conv(F.hex(F.substring("visits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 2), 8, "0"), F.col("bit") % 8 + 1, F.lit(1)) == "1")
        visits = one.select((F.element_at(F.lit(first), F.col("run") + 1) + F.col("bit")).cast("int").alias("block"))
    return visits.groupBy("block").count().join(sizes, "block").agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0


def candidates(queries: DataFrame, corpus: DataFrame, qid: str, id_col: str, k: int, payload: list[str], make_block, score,
               max_rows: int, stats: dict | None = None) -> DataFrame:
    """Candidates (qid, id, d2) that hold the exact top-k of every query id.

    ``queries`` and ``corpus`` are checkpointed: id and ``payload`` (``vec``, or ``idx`` and ``val``).  ``stats``
    receives the pairs that the search scores and all there are.
    """
    rows, cells = V._size(corpus, payload[0])
    sparse = payload != ["vec"]
    if rows == 0:
        schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for df, c in ((queries, qid), (corpus, id_col)))
        return queries.sparkSession.createDataFrame([], schema + ", d2 double")
    blocks = deal_blocks(corpus, id_col, payload, rows, max_rows, cells, k if sparse else 0, _folded_matrix if sparse else _dense_matrix)
    q = queries.select(qid, *payload)
    if sparse:
        run_of = None
        q = materialize(q.withColumn("__q", F.monotonically_increasing_id()))
        bounds = _SparseBounds(q, blocks)
        visits = lambda df: _sparse_visits(df, bounds, k).select(qid, *payload, "block")
        scored = lambda v: _score_visits(v, blocks, qid, id_col, payload, make_block, score, k, max_rows)
    else:
        run_of = _runs(blocks, max_rows)
        visits = lambda df: _dense_visits(df, qid, blocks, run_of, k)
        scored = lambda v: _score_runs(v, blocks, run_of, qid, id_col, k)
    home = materialize(visits(q))
    first = V._final_topk(scored(home), qid, id_col, k)
    # the k-th best so far; with fewer than k there is no bound
    limits = first.groupBy(F.col(qid).alias("__qid")).agg(
        F.when(F.count(F.lit(1)) >= k, F.max("d2")).otherwise(F.lit(float("inf"))).alias("limit"))
    limited = q.join(materialize(limits), F.col(qid).eqNullSafe(F.col("__qid"))).drop("__qid")
    chosen = materialize(visits(limited))
    if stats is not None:
        stats.update(home=visited_pairs(home, blocks, run_of), scored=visited_pairs(chosen, blocks, run_of), all=rows * q.count(), blocks=len(blocks.n))
    return scored(chosen)


def knn_dense_pruned(queries: DataFrame, vectors: DataFrame, k: int = 5, qid: str = "qid", id_col: str = "id",
                     block_rows: int = V.MAX_BROADCAST_ROWS, stats: dict | None = None) -> DataFrame:
    """Exact k nearest dense vectors (column ``vec``), block pairs skipped by bounds: ``qid, id, d2, rank``."""
    c = candidates(materialize(queries.select(qid, "vec")), materialize(vectors.select(id_col, "vec")), qid, id_col, k, ["vec"],
                   V._dense_block, V._dense_score, block_rows, stats)
    return V._final_topk(c, qid, id_col, k)


def search_sparse_pruned(queries: DataFrame, corpus: DataFrame, k: int = 5, qid: str = "qid", id_col: str = "id",
                         block_rows: int = V.MAX_BROADCAST_ROWS, stats: dict | None = None) -> DataFrame:
    """Exact k nearest sparse unit vectors (``idx``, ``val``), block pairs skipped by bounds: ``qid, id, d2, rank``."""
    p = ["idx", "val"]
    c = candidates(materialize(queries.select(qid, *p)), materialize(corpus.select(id_col, *p)), qid, id_col, k, p,
                   V._sparse_block, V._sparse_score, block_rows, stats)
    return V._final_topk(c, qid, id_col, k)
