"""Merkle manifest of a dataset, with a proof for every row, by butterfly exchange.

A row's leaf is a digest of its columns.  Leaves stand in order inside their group; every ``FANOUT``
consecutive nodes of a level make a parent, until one node remains (the group's root); the groups' roots
make one more tree of the same kind.

The leaves of a group are dealt in order to aligned blocks of ``FANOUT ** BLOCK_LEVELS``.  A block folds
its leaves to one digest inside a task.  Above the blocks there is no tree to climb and descend: in
round r each block sends its digest to the blocks that differ from it only in the r-th digit of their
number, so that every block of an aligned set of ``FANOUT ** (r + 1)`` hears the same ``FANOUT``
digests, hashes the parent itself and keeps its siblings.  After the last round each block holds
the group's root and its own upper proof.  Where a set is ragged, the blocks of a short subtree share
its receivers evenly.  A round is one ``explode`` of narrow rows and one aggregate of at most ``FANOUT``
rows per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import land, running_totals, small
from salescope.llm.process import give_back

FANOUT = 16
#: a block holds FANOUT ** BLOCK_LEVELS leaves
BLOCK_LEVELS = 3
_LEVEL = "struct<place:int,others:array<string>>"
_PROOF = f"array<{_LEVEL}>"


def encoded(c: Column) -> Column:
    """A value for a digest: its UTF-8 byte count, a colon and the value; ``-`` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def fold(start: Column, proof: Column) -> Column:
    """The digest that a node and the siblings of its path lead to."""
    def step(node, level):
        left = F.slice(level["others"], F.lit(1), level["place"])
        right = F.slice(level["others"], level["place"] + 1, F.size(level["others"]))
        return F.sha2(F.concat(F.array_join(left, ""), node, F.array_join(right, "")), 256)
    return F.aggregate(proof, start, step)


def _blocks_of(n: Column, size: int) -> Column:
    return F.floor((n + size - 1) / size).cast("long")


def _climb(nodes: list[str], at_least: int) -> tuple[list[list[str]], int]:
    """All levels of a block's tree, leaves first: until one node remains and ``at_least`` levels are built."""
    levels = [nodes]
    while len(levels[-1]) > 1 or len(levels) <= at_least:
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i:i + FANOUT]).encode()).hexdigest() for i in range(0, len(below), FANOUT)])
    return levels, len(levels) - 1


def _sorted_block(t: pa.Table) -> tuple[list[str], int, int]:
    t = t.sort_by("pos")
    return t["digest"].to_pylist(), int(t["gid"][0].as_py()), int(t["block"][0].as_py())


def block_digests(leaves: DataFrame, levels: int) -> DataFrame:
    """(gid, block, blocks, digest): every block's top digest.  ``leaves``: gid, block, blocks, pos, digest."""
    def run(t: pa.Table) -> pa.Table:
        digests, gid, block = _sorted_block(t)
        blocks = int(t["blocks"][0].as_py())
        top = _climb(digests, levels if blocks > 1 else 0)[0][-1][0]
        return pa.table({"gid": pa.array([gid], pa.int64()), "block": pa.array([block], pa.int64()),
                         "blocks": pa.array([blocks], pa.int64()), "digest": pa.array([top])})
    return leaves.groupBy("gid", "block").applyInArrow(run, "gid long, block long, blocks long, digest string")


def butterfly(blocks: DataFrame, name: str) -> DataFrame:
    """(gid, block, digest, upper): each block's group root and the proof from its own top to it.

    ``blocks``: gid, block (0, 1, ...), blocks (their number in the group), digest.
    """
    state = land(blocks.withColumn("upper", F.array().cast(_PROOF)), f"{name}-round0")
    most = state.agg(F.max("blocks")).first()[0] or 0
    width, rounds = 1, 0
    while width < most:
        w, up = F.lit(width).cast("long"), F.lit(width * FANOUT).cast("long")
        me, n = F.col("block"), F.col("blocks")
        sub, base = F.floor(me / w), F.floor(me / up) * up
        count = F.least(w, n - sub * w)  # blocks of my subtree, which share its receivers
        turn = (me - sub * w)
        # receivers: in each subtree of the aligned set, the places that agree with mine modulo that count
        first = F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda j: base + j * w)
        to = F.flatten(F.transform(F.filter(first, lambda f: f + turn < n),
                                   lambda f: F.sequence(f + turn, F.least(f + w, n) - 1, count)))
        going = state.filter(n > w)
        sent = going.select("gid", "blocks", (sub - F.floor(me / up) * FANOUT).cast("int").alias("digit"), "digest",
                            F.explode(to).alias("to"), me.alias("me"), "upper")
        sent = sent.withColumn("upper", F.when(F.col("to") == F.col("me"), F.col("upper")))
        heard = sent.groupBy("gid", F.col("to").alias("block")).agg(
            F.first("blocks").alias("blocks"), F.array_sort(F.collect_list(F.struct("digit", "digest"))).alias("all"),
            F.max(F.when(F.col("upper").isNotNull(), F.col("digit"))).alias("digit"), F.first("upper", ignorenulls=True).alias("upper"))
        level = F.struct(F.col("digit").alias("place"),
                         F.transform(F.filter("all", lambda x: x["digit"] != F.col("digit")), lambda x: x["digest"]).alias("others"))
        parent = F.sha2(F.array_join(F.transform("all", lambda x: x["digest"]), ""), 256)
        moved = heard.select("gid", "block", "blocks", parent.alias("digest"), F.concat("upper", F.array(level)).cast(_PROOF).alias("upper"))
        rounds += 1
        state = land(moved.unionByName(state.filter(n <= w)), f"{name}-round{rounds}")
        width *= FANOUT
    return state.select("gid", "block", "digest", "upper")


def prove(leaves: DataFrame, finish: Callable, schema: str, name: str, levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per leaf by ``finish(table, roots)`` (see ``_proofs``), over whole blocks.

    ``leaves``: gid, pos (gapless from 0 in each group), n (leaves of the group), digest, more columns.
    """
    size = FANOUT ** levels
    dealt = leaves.withColumn("block", F.floor(F.col("pos") / size).cast("long")).withColumn("blocks", _blocks_of(F.col("n"), size))
    tops = block_digests(dealt.select("gid", "block", "blocks", "pos", "digest"), levels)
    upper = butterfly(tops, name).withColumnRenamed("digest", "root")
    return dealt.groupBy("gid", "block").cogroup(upper.groupBy("gid", "block")).applyInArrow(
        lambda own, above: finish(own.sort_by("pos"), above, levels), schema)


def _proofs(own: pa.Table, above: pa.Table, levels: int):
    """For every row of a block, in order: its proof up to the group's root, as (place, siblings) levels."""
    digests = own["digest"].to_pylist()
    tree, height = _climb(digests, levels if own["blocks"][0].as_py() > 1 else 0)
    upper = [(x["place"], x["others"]) for x in above["upper"][0].as_py()]
    for i in range(len(digests)):
        path, at = [], i
        for level in range(height):
            lo = at - at % FANOUT
            path.append((at - lo, tree[level][lo:at] + tree[level][at + 1:lo + FANOUT]))
            at //= FANOUT
        yield path + upper


def _subroot_rows(own: pa.Table, above: pa.Table, levels: int) -> pa.Table:
    proofs = [[{"place": p, "others": o} for p, o in path] for path in _proofs(own, above, levels)]
    level = pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))])
    return pa.table({"sid": own["pos"].cast(pa.int64()), "subroot": own["digest"].cast(pa.string()),
                     "root": pa.array([above["root"][0].as_py()] * len(own), pa.string()),
                     "over": pa.array(proofs, pa.list_(level))})


MANIFEST = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
            "sid long, pos long, proof_nodes int")


def _manifest_rows(own: pa.Table, above: pa.Table, levels: int) -> pa.Table:
    """Final rows of a block: proof digests, and each row's root recomputed from its claimed leaf."""
    out = []
    over = [(x["place"], x["others"]) for x in above["over"][0].as_py()]
    tail = "".join(o for _, others in over for o in others)
    claimed = own["claimed"].to_pylist()
    for leaf, path in zip(claimed, _proofs(own, above, levels), strict=True):
        seen = hashlib.sha256()
        node, nodes = leaf, 0
        for place, others in [*path, *over]:
            node = hashlib.sha256("".join([*others[:place], node, *others[place:]]).encode()).hexdigest()
            nodes += len(others)
        seen.update("".join(o for _, others in path for o in others).encode())
        seen.update(tail.encode())
        out.append((seen.hexdigest(), node, nodes))
    n = len(own)
    if n >= 1024:
        give_back()
    return pa.table({"doc_id": own["doc_id"], "leaf": own["digest"].cast(pa.string()),
                     "subroot": pa.array([above["root"][0].as_py()] * n, pa.string()),
                     "root": pa.array([above["top"][0].as_py()] * n, pa.string()),
                     "proof_sha256": pa.array([x[0] for x in out], pa.string()), "folded_root": pa.array([x[1] for x in out], pa.string()),
                     "sid": own["gid"].cast(pa.int64()), "pos": own["pos"].cast(pa.int64()),
                     "proof_nodes": pa.array([x[2] for x in out], pa.int32())})


def manifest(docs: DataFrame, group: str, key: str, columns: list[str], claimed: Column | None = None,
             levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per document: ``key`` (as doc_id), leaf, subroot, root, proof_sha256, folded_root, sid, pos, proof_nodes.

    ``leaf`` digests ``columns``; leaves stand by ``key`` (nulls first) inside their ``group``, groups by
    their UTF-8 bytes (null first).  ``claimed`` is the leaf that a holder of the row would present (null:
    the leaf itself); ``folded_root`` is what it and the row's siblings lead to, so it equals ``root`` only for
    untampered rows.  ``proof_sha256`` digests all siblings, level by level, left to right; ``proof_nodes``
    counts them; ``sid`` and ``pos`` are the group's and the row's places.

    Rows that repeat a key stand by their leaf; equal rows are interchangeable.  Null columns and very long
    texts enter the digest whole; an empty table has no rows; other columns are not read.  A group of any
    size is dealt to blocks, a group of one row is its own subroot.
    """
    leaf = leaf_digest([F.col(c) for c in columns])
    rows = land(docs.select(F.col(group).cast("string").alias("grp"), F.col(key).cast("long").alias("doc_id"), leaf.alias("digest"),
                            (claimed if claimed is not None else F.lit(None).cast("string")).alias("claimed")), "merkle-leaves")
    # places of the groups, then of the rows in them
    sizes = land(rows.groupBy("grp").agg(F.count("*").alias("n")), "merkle-groups")
    groups = sizes.count()
    one = F.lit(1).cast("long")
    placed = running_totals(sizes.withColumn("__one", one), [], [F.col("grp").asc_nulls_first()], "__one", "merkle-sids", groups, groups)
    placed = land(placed.select(F.col("grp").alias("__grp"), "n", (F.col("rn") - 1).alias("gid")), "merkle-placed")
    ordered = running_totals(rows.withColumn("__one", one), ["grp"], [F.col("doc_id").asc_nulls_first(), F.col("digest")], "__one",
                             "merkle-rows", groups)
    leaves = (ordered.join(small(placed, groups), F.col("grp").eqNullSafe(F.col("__grp")))
              .select("gid", (F.col("rn") - 1).alias("pos"), "n", "doc_id", "digest", F.coalesce("claimed", "digest").alias("claimed")))
    leaves = land(leaves, "merkle-ordered")
    # a tree per group: its blocks' upper proofs; then one tree over the groups' roots
    size = FANOUT ** levels
    dealt = leaves.withColumn("block", F.floor(F.col("pos") / size).cast("long")).withColumn("blocks", _blocks_of(F.col("n"), size))
    tops = block_digests(dealt.select("gid", "block", "blocks", "pos", "digest"), levels)
    upper = butterfly(tops, "merkle-group").withColumnRenamed("digest", "root")
    subroots = (upper.filter(F.col("block") == 0)
                .select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("pos"), F.lit(groups).cast("long").alias("n"), F.col("root").alias("digest")))
    over = land(prove(subroots, _subroot_rows, f"sid long, subroot string, root string, over {_PROOF}", "merkle-top", levels), "merkle-over")
    above = upper.join(small(over.select(F.col("sid").alias("gid"), F.col("root").alias("top"), "over"), groups), "gid")
    return dealt.groupBy("gid", "block").cogroup(above.groupBy("gid", "block")).applyInArrow(
        lambda own, up: _manifest_rows(own.sort_by("pos"), up, levels), MANIFEST)
