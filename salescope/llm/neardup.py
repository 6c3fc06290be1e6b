"""MinHash near-duplicate detection: universal hash minima, banding, signature verification, exact
confirmation and connected components.

Documents with equal shingle sets are one class, so groups of copies cost one aggregation.  Classes
that share a band bucket are candidates.  A bucket is never turned into all its pairs: first every
member is compared with the bucket's least member (a star), and the links found are joined to
components.  Only buckets that still hold several components are looked at again, in blocks of bounded
size whose members are compared inside a task, across components only; what leaves the task is at most
a spanning forest.  So no link between two components is lost, and the rows that move grow with the
members, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm import wordhash
from salescope.llm.common import land, row_key, small
from salescope.llm.components import connected_components
from salescope.llm.process import give_back

SHINGLE, THRESHOLD = 4, 80
#: 40 bands of 6 minima: a pair at similarity 0.8 shares no band with probability 5e-6
ROWS, BANDS = 6, 40
#: share of equal signature bytes below which a pair is not confirmed: five standard deviations
#: under 0.8 for 240 minima
AGREE = 0.67
#: members of a bucket that one task compares at once
BLOCK = 1024
#: up to so many single ids are broadcast to pick the rows that are needed
PICK_ROWS = 100_000

_M = [np.uint64(x) for x in (3, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                             0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _family(n: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2 ** 63, n, dtype=np.uint64)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct 64-bit shingle hashes per text) for pieces of a string array."""
    for first, end, data, offsets in wordhash.chunks(texts):
        data = wordhash.ascii_lower(data)
        s, e, bounds = wordhash.words(data, offsets)
        h = wordhash.span_hashes(data, s, e)
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(len(h) - k + 1, 0), np.uint64)
            for i in range(k if len(rolled) else 0):
                rolled += h[i:len(h) - k + 1 + i] * _M[i]
            rolled = wordhash.mix(rolled)
        sets = []
        for i in range(end - first):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo >= k:
                sets.append(np.unique(rolled[lo:hi - k + 1]))
            elif hi > lo:  # the whole sequence as one shingle; its length keeps it apart from others
                with np.errstate(over="ignore"):
                    whole = (h[lo:hi] * np.array(_M[:hi - lo])).sum(dtype=np.uint64)[None] + np.uint64(hi - lo)
                sets.append(wordhash.mix(whole ^ np.uint64(0x5851F42D4C957F2D)))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield first, sets


def _set_keys(u: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, whatever the order."""
    one = wordhash.mix(u ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    two = wordhash.mix(u ^ np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def sketch(docs: DataFrame, k: int = SHINGLE, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per document: row, doc_id, x1, x2 (its row key), n_shingles, k1, k2 (set name), sig (low bytes of the minima),
    bands (64-bit bucket key per band); null for an empty set.  Landed without the text."""
    n_hash = rows * bands
    mult, add = _family(n_hash)

    def run(batches):
        for batch in batches:
            sizes, one, two, sigs, keys = [], [], [], [], []
            for first, sets in shingle_sets(batch.column(4), k):
                lens = np.array([len(u) for u in sets])
                filled = np.flatnonzero(lens)
                minima = np.zeros((n_hash, len(filled)), np.uint32)
                if len(filled):
                    flat = np.concatenate([sets[i] for i in filled])
                    starts = np.concatenate([[0], np.cumsum(lens[filled])[:-1]])
                    with np.errstate(over="ignore"):
                        for j in range(n_hash):
                            minima[j] = np.minimum.reduceat(((flat * mult[j] + add[j]) >> np.uint64(32)).astype(np.uint32), starts)
                m = np.ascontiguousarray(minima.T)
                with np.errstate(over="ignore"):
                    key = np.zeros((len(filled), bands), np.uint64)
                    for r in range(rows):
                        key = wordhash.mix(key * np.uint64(31) + m[:, r::rows].astype(np.uint64))
                at = {int(i): n for n, i in enumerate(filled)}
                for i, u in enumerate(sets):
                    a, b = _set_keys(u)
                    one.append(a)
                    two.append(b)
                    sizes.append(len(u))
                    n = at.get(i)
                    sigs.append(None if n is None else m[n].astype(np.uint8).tobytes())
                    keys.append(None if n is None else key[n].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(sizes, pa.int64()), pa.array(one, pa.int64()),
                 pa.array(two, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["row", "doc_id", "x1", "x2", "n_shingles", "k1", "k2", "sig", "bands"])
        give_back()

    one, two = row_key()
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                         one.alias("x1"), two.alias("x2"), F.col("text").cast("string").alias("text"))
    return land(source.mapInArrow(run, "row long, doc_id long, x1 long, x2 long, n_shingles long, k1 long, k2 long, sig binary, bands array<bigint>"),
                "dup-sketch")


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= threshold * union."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb"))

    def run(batches):
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column(2), batch.column(3), strict=True):
                keep.append(linked(np.frombuffer(sa.as_py(), np.uint64), np.frombuffer(sb.as_py(), np.uint64), threshold))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])
        give_back()

    return both.mapInArrow(run, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    if 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= threshold * (len(x) + len(y) - common)


def _alike(pairs: DataFrame, prints: DataFrame, agree: float) -> DataFrame:
    """Signature verification: pairs whose signatures agree in at least ``agree`` of the minima."""
    both = (pairs.join(prints.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
            .join(prints.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb"))

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            one, two = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (batch.column(2), batch.column(3)))
            mask = pa.array((one == two).mean(axis=1) >= agree, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, classes: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """Landed (node, set) of the needed classes, from the text of one document of each."""
    want = classes.join(needed, "node", "left_semi").select("node", F.col("doc").alias("__d"), "k1", "k2")
    want = land(want, "dup-wanted")
    n = want.count()
    picked = want.select("__d").distinct()
    picked = F.broadcast(picked) if n <= PICK_ROWS else picked
    source = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
              .join(picked, F.col("doc_id").eqNullSafe(F.col("__d")), "left_semi"))

    def run(batches):
        for batch in batches:
            one, two, out = [], [], []
            for _, sets in shingle_sets(batch.column(1), k):
                for u in sets:
                    a, b = _set_keys(u)
                    one.append(a)
                    two.append(b)
                    out.append(u.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(out, pa.binary())],
                                             ["x1", "x2", "set"])
        give_back()

    made = source.mapInArrow(run, "x1 long, x2 long, set binary")
    named = want.select("node", "k1", "k2")
    named = F.broadcast(named) if n <= PICK_ROWS // 4 else named
    found = made.join(named, (F.col("x1") == F.col("k1")) & (F.col("x2") == F.col("k2")))
    return land(found.select("node", "set").dropDuplicates(["node"]), "dup-sets")


def _prints(classes: DataFrame, members: DataFrame) -> DataFrame:
    """Landed (node, sig, marks) of the classes that share a bucket; the only ones that are compared."""
    near = land(members.select("node").distinct(), "dup-near")
    near = F.broadcast(near) if near.count() <= PICK_ROWS else near
    # the low 32 bits of a bucket key tell buckets apart; the landed classes have the whole keys only
    marks = F.transform("bands", lambda key: (key.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int"))
    return land(classes.select("node", "sig", marks.alias("marks")).join(near, "node", "left_semi"), "dup-prints")


def _cross(sig: np.ndarray, band: np.ndarray, comp: np.ndarray, side: np.ndarray, at: int, agree: float):
    """Index pairs (i, j) of one block pair: other component, alike, and no common bucket in an earlier band.

    ``side`` is 0 for members of the first block, 1 for those of the second; all 0 if it is one block.
    """
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = len(second) == 0
    if alone:
        second = first
    for n, i in enumerate(first):
        others = second[n + 1:] if alone else second
        others = others[comp[others] != comp[i]]
        if not len(others):
            continue
        others = others[(sig[others] == sig[i]).mean(axis=1) >= agree]
        if at and len(others):
            others = others[~(band[others, :at] == band[i, :at]).any(axis=1)]
        for j in others:
            yield i, j


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """Rows (band, key, node, ...) dealt to pairs of blocks of their bucket: group columns band, key, bi, bj, side."""
    sizes = members.groupBy("band", "key").agg(F.count("*").alias("__n")).select(
        F.col("band").alias("__b"), F.col("key").alias("__k"), F.ceil(F.col("__n") / block).cast("int").alias("parts"))
    dealt = members.join(sizes, (F.col("band") == F.col("__b")) & (F.col("key") == F.col("__k")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("band", "key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"),
                        (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "comp")


def _matrix(column, dtype) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def _rest_of_buckets(members: DataFrame, prints: DataFrame, docs: DataFrame, classes: DataFrame, threshold: int,
                     agree: float, block: int, k: int) -> DataFrame:
    """Links between components inside buckets; ``members`` (band, key, node, comp) of mixed buckets."""
    group = ["band", "key", "bi", "bj"]
    dealt = land(_blocks(members, block), "dup-blocks")
    prints = prints.withColumnRenamed("node", "__s")
    full = dealt.join(prints, F.col("node") == F.col("__s")).drop("__s")

    def read(table):
        band = table.column("marks").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        return _matrix(table.column("sig"), np.uint8), band, np.array(table.column("comp").to_pylist()), np.array(table.column("side").to_pylist())

    def flag(table):
        sig, band, comp, side = read(table)
        hit = np.zeros(table.num_rows, bool)
        for i, j in _cross(sig, band, comp, side, table.column("band")[0].as_py(), agree):
            hit[i] = hit[j] = True
        return table.select([*group, "side", "node", "comp"]).filter(pa.array(hit))

    schema = "band int, key long, bi int, bj int, side int, node long, comp long"
    flagged = land(full.groupBy(*group).applyInArrow(flag, schema), "dup-flagged")
    sets = _sets(docs, classes, flagged.select("node").distinct(), k)
    whole = (flagged.join(prints, F.col("node") == F.col("__s")).drop("__s")
             .join(sets.select(F.col("node").alias("__t"), "set"), F.col("node") == F.col("__t")).drop("__t"))

    def link(table):
        sig, band, comp, side = read(table)
        nodes = table.column("node").to_pylist()
        sets_ = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        parent = {c: c for c in comp.tolist()}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        a, b = [], []
        for i, j in _cross(sig, band, comp, side, table.column("band")[0].as_py(), agree):
            x, y = root(int(comp[i])), root(int(comp[j]))
            if x != y and linked(sets_[i], sets_[j], threshold):
                parent[x] = y
                a.append(nodes[i])
                b.append(nodes[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return whole.groupBy(*group).applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_shingles, component_id and kept per document; parameters as in :func:`decide`.

    Links are pairs with 100 * intersection >= ``threshold`` * union of their distinct ``k``-word
    shingles.  Texts without words (or null) are alone.  ``component_id`` is the least doc_id reachable;
    rows that repeat an id and text are linked like any copies; null ids are never the least, and a group
    of null ids alone has a null component_id.  Exactly one row of a component is kept, whatever the ids.
    """
    return decide(docs, **params).select("doc_id", "n_shingles", "component_id", "kept")


def decide(docs: DataFrame, threshold: int = THRESHOLD, k: int = SHINGLE, agree: float = AGREE,
           block: int = BLOCK) -> DataFrame:
    """The rows of ``near_duplicates`` with their row key (x1, x2).

    A component keeps its row of the least id, of the least row key among rows that share that id.
    """
    sketched = sketch(docs, k)
    some = sketched.filter("n_shingles > 0")
    # nulls last, and no row number before the key, so that reruns keep the same row
    least = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "x1", "x2", "row")).alias("least")
    # equal sets have equal sketches: a class takes any of its rows', so no row is joined back for its sketch
    classes = land(some.groupBy("k1", "k2", "n_shingles")
                   .agg(F.min(F.struct("row", "doc_id")).alias("r"), least, F.first("sig").alias("sig"), F.first("bands").alias("bands"))
                   .select("k1", "k2", "n_shingles", F.col("r.row").alias("node"), F.col("r.doc_id").alias("doc"), "least", "sig", "bands"),
                   "dup-classes")
    # one exchange serves the buckets' sizes and the join back to their members
    dealt = classes.select("node", F.posexplode("bands").alias("band", "key")).repartition("band", "key")
    buckets = (dealt.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
               .select(F.col("band").alias("__b"), F.col("key").alias("__k"), "pivot"))
    in_bucket = dealt.join(buckets.hint("merge"), (F.col("band") == F.col("__b")) & (F.col("key") == F.col("__k")))
    members = land(in_bucket.select("band", "key", "node", "pivot"), "dup-members")
    stars = members.filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    prints = _prints(classes, members)
    alike = land(_alike(stars, prints, agree), "dup-alike")
    sets = _sets(docs, classes, alike.select(F.col("a").alias("node")).unionByName(alike.select(F.col("b").alias("node"))).distinct(), k)
    links = land(_confirm(alike, sets, threshold), "dup-links")
    labels = connected_components(links)
    labelled = members.select("band", "key", "node").join(labels.withColumnRenamed("node", "__l"), F.col("node") == F.col("__l"), "left")
    labelled = land(labelled.select("band", "key", "node", F.coalesce("component", "node").alias("comp")), "dup-labelled")
    mixed = (labelled.groupBy(F.col("band").alias("__b"), F.col("key").alias("__k"))
             .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").drop("lo", "hi"))
    mixed = land(mixed, "dup-mixed")
    n_mixed = mixed.count()
    rest = labelled.join(small(mixed, n_mixed), (F.col("band") == F.col("__b")) & (F.col("key") == F.col("__k")), "left_semi")
    more = land(_rest_of_buckets(rest, prints, docs, classes, threshold, agree, block, k), "dup-more")
    labels = land(connected_components(links.unionByName(more)), "dup-labels")
    joined = classes.join(labels.withColumnRenamed("node", "__l"), F.col("node") == F.col("__l"), "left")
    joined = land(joined.select("k1", "k2", "least", F.coalesce("component", "node").alias("comp")), "dup-joined")
    lowest = joined.groupBy(F.col("comp").alias("__c")).agg(F.min("least").alias("least"))
    named = (joined.join(lowest, F.col("comp") == F.col("__c"))
             .select(F.col("k1").alias("__1"), F.col("k2").alias("__2"), lowest["least.doc_id"].alias("component_id"), lowest["least.row"].alias("__r")))
    rows = (some.select("row", "doc_id", "x1", "x2", "n_shingles", "k1", "k2")
            .join(named, (F.col("k1") == F.col("__1")) & (F.col("k2") == F.col("__2")))
            .select("doc_id", "x1", "x2", "n_shingles", "component_id", (F.col("row") == F.col("__r")).alias("kept")))
    bare = sketched.filter("n_shingles = 0").select("doc_id", "x1", "x2", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return rows.unionByName(bare)


def keep_one_of_each(docs: DataFrame, **params) -> DataFrame:
    """Documents without near duplicates: one row of every group stays (see ``decide``), columns unchanged.

    Rows are told apart by id and text, so null and repeated ids lose nothing but near copies; of rows
    equal in both, one stays.  Texts without words (or null) all stay.
    """
    keys = (decide(docs, **params).filter("n_shingles > 0").groupBy(F.col("x1").alias("__1"), F.col("x2").alias("__2"))
            .agg(F.max("kept").alias("kept"), F.count("*").alias("rows")))
    away = land(keys.filter("not kept or rows > 1"), "dup-away")
    n, repeats = away.agg(F.count("*"), F.count_if("kept")).first()
    one, two = row_key()
    keyed = docs.withColumns({"__x1": one, "__x2": two})
    same = (F.col("__x1") == F.col("__1")) & (F.col("__x2") == F.col("__2"))
    pick = lambda k, rows: F.broadcast(k.select("__1", "__2")) if rows <= PICK_ROWS else k.select("__1", "__2")
    out = keyed.join(pick(away, n), same, "left_anti")
    if repeats:
        again = keyed.join(pick(away.filter("kept"), repeats), same, "left_semi")
        out = out.unionByName(again.dropDuplicates(["__x1", "__x2"]))
    return out.select(*docs.columns)
