"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from salescope.llm import merkle
from tests.llm.data import docs, empty

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """(root, path of each node as (left, right) siblings)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            lo = k - k % 16
            paths[i].append((nodes[lo:k], nodes[k + 1:lo + 16]))
        nodes = [digest("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], paths


def brute(rows, tampered):
    groups = {}
    for r in rows:
        leaf = digest("".join(value(r[c]) for c in COLUMNS))
        other = digest("".join(value(tampered(r) if c == "text" else r[c]) for c in COLUMNS))
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, other, r["doc_id"]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[s])]) for s in names]
    root, over = climb([t[0] for t in trees])
    out = []
    for s, (sub, paths), up in zip(names, trees, over, strict=True):
        for (_, _, leaf, other, doc), path in zip(sorted(groups[s]), paths, strict=True):
            node = other
            for left, right in path + up:
                node = digest("".join([*left, node, *right]))
            proof = digest("".join("".join(left + right) for left, right in path + up))
            out.append((doc, leaf, sub, root, proof, node))
    return out


def mine(df, levels, claimed=None):
    rows = merkle.manifest(df, "source", "doc_id", COLUMNS, claimed, levels).collect()
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in rows), key=str)


def key(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_of_awkward_rows_equals_a_plain_tree(spark, levels):
    d = docs(spark)
    claimed = merkle.leaf_digest([*[F.col(c) for c in COLUMNS[:-1]], F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))])
    want = brute([r.asDict() for r in d.collect()], lambda r: r["text"].lower() if r["text"] and r["doc_id"] % 3 == 0 else r["text"])
    got = mine(d, levels, claimed)
    assert got == key(want)
    assert 0 < sum(x[5] == x[3] for x in got) < len(got)


def test_a_hot_group_is_spread_over_blocks_and_rounds(spark):
    rng = random.Random(4)
    rows = [(i if i % 50 else None, f"text {i % 700}", "en", "hot" if i < 4200 else f"s{rng.randint(0, 40)}", i) for i in range(5000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    want = brute([r.asDict() for r in d.collect()], lambda r: r["text"])
    got = mine(d, 1)  # blocks of 16: three rounds for the hot group
    assert got == key(want)
    assert all(x[5] == x[3] for x in got)


def test_one_row_repeated_rows_and_no_rows(spark):
    assert mine(empty(spark), 3) == []
    one = spark.createDataFrame([(None, None, None, None, None, "x")], "doc_id long, text string, lang string, source string, n_chars long, digest string")
    got = mine(one, 3)
    leaf = digest("-----")
    assert got == [(None, leaf, leaf, leaf, digest(""), leaf)]
    same = spark.createDataFrame([(1, "t", "en", "s", 1)] * 40, "doc_id long, text string, lang string, source string, n_chars long")
    assert mine(same, 1) == key(brute([r.asDict() for r in same.collect()], lambda r: r["text"]))
