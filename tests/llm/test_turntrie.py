"""The prefix trie against a dictionary of prefixes."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from salescope.llm import turntrie

SCHEMA = "conv_id long, turn long, role string, text string, place long, n long"


def brute(rows):
    own = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def mine(spark, rows, **kw):
    d = spark.createDataFrame([(*r[:4], 1, 2) for r in rows], SCHEMA).repartition(5)
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"],
                   r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in turntrie.prefix_trie(d, **kw).collect())


def conversations(seed, n, deep=9, kinds=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c = rng.choice([i, 100 * (i % 4), 100 + i, 907])
        turns = [rng.choice(["hi", "é", "long text", "", None][:kinds]) for _ in range(rng.randint(1, deep))]
        rows += [(c, t if t else None, rng.choice(["user", None]), x) for t, x in enumerate(turns)]
    # a conversation is given once
    seen, out = {}, []
    for r in rows:
        if seen.setdefault((r[0], r[1]), r) is r:
            out.append(r)
    return out


@pytest.mark.parametrize("kw", [{}, {"length": 2, "shard": 3, "piece": 2}])
def test_nodes_equal_a_dictionary_of_prefixes(spark, kw):
    rows = [*conversations(1, 150), (None, 1, "user", "lost"), (5, None, None, None)]
    assert mine(spark, rows, **kw) == brute(rows)


def test_a_hot_conversation_copies_and_a_common_first_turn(spark):
    rows = [(7, i, "user", f"t{i % 3}") for i in range(150)] + [(c, i, "user", f"t{i % 3}") for c in (11, 13) for i in range(150 + c)]
    rows += [(200 + c, t, "user", "same") for c in range(100) for t in range(3)]
    rows += [(300 + c, t, "user", "same" if t < 6 else str(c)) for c in range(100) for t in range(7)]
    want = brute(rows)
    assert mine(spark, rows, length=8, shard=20, piece=16) == want
    assert mine(spark, rows) == want


def test_no_rows_and_conversations_without_turns(spark):
    assert mine(spark, []) == []
    short = [(c, 0, "user", "x") for c in range(1, 40)]  # most of them lend their only turn away
    assert mine(spark, short) == brute(short)
    assert mine(spark, [(None, 1, "a", "b")]) == []


def test_double_array_holds_every_child():
    rng = np.random.default_rng(2)
    trie, nodes, want = turntrie.DoubleArray(50), [0], {}
    for _ in range(300):
        s = nodes.pop(0)
        symbols = np.unique(rng.integers(0, 50, rng.integers(1, 20)))
        cells = trie.add(s, symbols)
        want.update({(s, int(t)): int(c) for t, c in zip(symbols, cells, strict=True)})
        nodes += cells.tolist()
    assert len(set(want.values())) == len(want)
    for (s, t), c in want.items():
        assert trie.walk(np.array([s]), np.array([t]))[0] == c
