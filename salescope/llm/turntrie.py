"""Prefix trie of conversations, by double arrays over shards of prefixes.

A conversation is a path of turns from the root; conversations that begin alike share nodes.

* Turns are named by 128 bits of their role and text; inside a shard they get dense ids.
* Paths are cut into segments of ``SEGMENT`` turns, so that no row grows with a long conversation.  A
  segment is known by the prefix it starts from (a sum over the turns before it, from distributed
  running totals) and the prefix it stops at; equal segments are one class, counted before anything
  else is done, so copies of a conversation cost one row.
* Classes, sorted by start and path, are dealt to shards of ``SHARD`` neighbours.  A shard packs its paths
  into a double array -- the child of node s by turn t stands at BASE[s] + t and has CHECK = s -- walks
  them through it, and sums its nodes from the leaves up.
* Nodes whose subtree is not all inside one shard -- those on its first and last path, and those under
  which a longer conversation goes on -- leave the shard as partial sums.  They are merged by name,
  and their subtrees are summed by pointer doubling: in round k every node sends its sum to the
  ancestor 2^k above, so a path of any length takes a logarithm of rounds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import land, running_totals, small, text_or_empty

SEGMENT, SHARD = 32, 4096
#: ids of one end list that are joined into one string
PIECE = 4096
_BITS = 45


def shared_turns(conv: Column | str = "conv_id") -> Column:
    """How many turns a conversation shares with the first one of its hundred."""
    c = F.col(conv) if isinstance(conv, str) else conv
    return (F.crc32(c.cast("string").cast("binary")) % 6).cast("int")


def _prefix_weight(place: Column, turn: Column) -> Column:
    """A turn's share of the 90 bits that name a prefix: sums over the places of a prefix identify it."""
    low = F.lit((1 << _BITS) - 1)
    a, b = F.xxhash64(place, turn).bitwiseAND(low), F.xxhash64(turn, place, place).bitwiseAND(low)
    return (a.cast("decimal(14,0)") * F.lit(1 << _BITS).cast("decimal(14,0)") + b.cast("decimal(14,0)")).cast("decimal(28,0)")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (0, 1, ...), turn (128 bits), chars: turns in order, null first, ties by their 128 bits."""
    role, text = text_or_empty("role"), text_or_empty("text")
    name = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("at"), name.alias("turn"),
        F.char_length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("one"))
    # the offsets table holds one row per partition and conversation that it begins or goes on with
    n = rows.select("conv_id").distinct().count()
    rows = running_totals(rows, ["conv_id"], [F.col("at").asc_nulls_first(), F.col("turn")], "one", "trie-turns", n)
    return rows.select("conv_id", (F.col("rn") - 1).alias("place"), "turn", "chars")


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after each took the first turns of its hundred's first one.

    conversations: conv_id; turns: conv_id, place, turn, chars.
    """
    convs = numbered.select("conv_id").distinct()
    base = F.col("conv_id") - F.col("conv_id") % 100
    first = numbered.filter((F.col("place") < 5) & (F.col("conv_id") % 100 == 0))
    lent = first.groupBy(F.col("conv_id").alias("base")).agg(
        F.count("*").cast("int").alias("m"), F.array_sort(F.collect_list(F.struct("place", "turn", "chars"))).alias("begun"))
    convs = land(convs.select("conv_id", shared_turns().alias("h"), base.alias("base")).join(lent, "base", "left")
                 .select("conv_id", "h", F.coalesce("m", F.lit(0)).alias("m"), F.slice("begun", F.lit(1), F.col("h")).alias("begun")), "trie-convs")
    shift = F.least("h", "m") - F.col("h")
    own = (numbered.join(convs.select("conv_id", "h", shift.alias("shift")), "conv_id").filter(F.col("place") >= F.col("h"))
           .select("conv_id", (F.col("place") + F.col("shift")).alias("place"), "turn", "chars"))
    taken = convs.select("conv_id", F.explode("begun").alias("b")).select("conv_id", "b.place", "b.turn", "b.chars")
    return convs.select("conv_id"), own.unionByName(taken)


def segments(convs: DataFrame, turns: DataFrame, length: int = SEGMENT) -> DataFrame:
    """One row per conversation and segment: conv_id, seg, start, stop, last, path, chars (arrays), landed.

    A conversation without turns has one empty segment.
    """
    weight = _prefix_weight(F.col("place"), F.col("turn"))
    rows = turns.select("conv_id", F.floor(F.col("place") / length).cast("long").alias("seg"), weight.alias("w"),
                        F.struct("place", "turn", "chars").alias("t"))
    cut = land(rows.groupBy("conv_id", "seg").agg(F.sum("w").cast("decimal(38,0)").alias("w"), F.array_sort(F.collect_list("t")).alias("t")),
               "trie-cut")
    cut = cut.select("conv_id", "seg", "w", F.transform("t", lambda t: t["turn"]).alias("path"), F.transform("t", lambda t: t["chars"]).alias("chars"))
    zero = F.lit(0).cast("decimal(38,0)")
    none = convs.join(cut.select("conv_id").distinct(), "conv_id", "left_anti").select(
        "conv_id", F.lit(0).cast("long").alias("seg"), zero.alias("w"), F.array().cast("array<binary>").alias("path"), F.array().cast("array<bigint>").alias("chars"))
    cut = cut.unionByName(none)
    # where each segment starts: only conversations of several segments have any before it
    later = cut.filter(F.col("seg") > 0).select("conv_id").distinct()
    long = land(later, "trie-long")
    n_long = long.count()
    if n_long == 0:
        return land(cut.select("conv_id", "seg", zero.alias("start"), F.col("w").alias("stop"), F.lit(True).alias("last"), "path", "chars"), "trie-segments")
    sums = cut.select("conv_id", "seg", "w").join(long, "conv_id", "left_semi")
    totals = running_totals(sums, ["conv_id"], [F.col("seg")], "w", "trie-starts", n_long)
    stops = totals.select("conv_id", "seg", F.col("cum").cast("decimal(38,0)").alias("stop"))
    most = stops.groupBy("conv_id").agg(F.max("seg").alias("most"))
    known = stops.join(most, "conv_id").withColumnRenamed("conv_id", "__c").withColumnRenamed("seg", "__s")
    out = cut.join(known, (F.col("conv_id") == F.col("__c")) & (F.col("seg") == F.col("__s")), "left")
    stop = F.coalesce("stop", "w")
    return land(out.select("conv_id", "seg", (stop - F.col("w")).cast("decimal(38,0)").alias("start"), stop.alias("stop"),
                           F.coalesce(F.col("seg") == F.col("most"), F.lit(True)).alias("last"), "path", "chars"), "trie-segments")


def _name(depth: Column, prefix: Column) -> Column:
    return F.concat(depth.cast("string"), F.lit(":"), prefix.cast("string"))


class DoubleArray:
    """Children of node s by symbol t stand at BASE[s] + t with CHECK = s; symbols are 0, 1, ..., node 0 is the root."""

    def __init__(self, symbols: int):
        self.symbols = symbols
        self.base, self.check = np.zeros(symbols + 64, np.int64), np.full(symbols + 64, -1, np.int64)
        self.check[0] = 0
        self.free = 1  # no free cell before it

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def add(self, node: int, symbols: np.ndarray) -> np.ndarray:
        """Give ``node`` children by ``symbols`` (ascending); their cells."""
        check, least, spread = self.check, int(symbols[0]), int(symbols[-1] - symbols[0])
        at = self.free
        tries = 0
        while True:
            self._grow(at + spread + 2)
            check = self.check
            if check[at] == -1 and (len(symbols) == 1 or (check[at - least + symbols] == -1).all()):
                break
            at += 1
            tries += 1
            if tries > 64 and len(symbols) > 8:  # a wide node goes behind everything placed so far
                used = np.flatnonzero(check != -1)
                at, tries = max(at, int(used[-1]) + 1), 0
        cells = at - least + symbols
        self.base[node] = at - least
        check[cells] = node
        while self.free < len(check) and check[self.free] != -1:
            self.free += 1
        return cells

    def walk(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of ``nodes`` by ``symbols``, all present."""
        out = self.base[nodes] + symbols
        assert (self.check[out] == nodes).all()
        return out


NODES = ("open boolean, name string, parent_name string, conv_id long, parent_conv_id long, depth long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens decimal(38,0), chars long, ends string")


def _shard_nodes(t: pa.Table, length: int) -> pa.Table:
    """The nodes of one shard.  An open node's row holds the sums of its closed subtrees only."""
    t = t.sort_by("place")
    n = len(t)
    n_all, n_end, low = (np.array(t[c], np.int64) for c in ("n", "n_end", "conv_id"))
    seg = np.array(t["seg"], np.int64)
    starts, stops = t["start"].to_pylist(), t["stop"].to_pylist()
    paths, chars = t["path"].combine_chunks(), t["chars"].combine_chunks()
    sizes = np.array(paths.value_lengths(), np.int64)
    flat = np.array(paths.flatten().to_pylist(), object)
    # dense ids: first the starts (children of a common root), then the turns
    first = {}
    start_of = np.array([first.setdefault(s, len(first)) for s in zip(seg.tolist(), starts, strict=True)], np.int64)
    turn_id: dict[bytes, int] = {}
    ids = np.array([turn_id.setdefault(x, len(turn_id)) for x in flat], np.int64) + len(first)
    flat_chars = np.array(chars.flatten(), np.int64)
    begin = np.cumsum(sizes) - sizes
    trie = DoubleArray(len(first) + len(turn_id))
    # level by level: the children of every node, then one step of all paths
    at = np.zeros(n, np.int64)
    steps, levels, alive = [], [], np.arange(n)
    level = 0
    while len(alive):
        symbol = start_of[alive] if level == 0 else ids[begin[alive] + level - 1]
        pairs = np.unique(np.stack([at[alive], symbol]), axis=1)
        cut = np.flatnonzero(np.diff(pairs[0], prepend=-1))
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), pairs.shape[1]], strict=True):
            trie.add(int(pairs[0, lo]), pairs[1, lo:hi])
        at[alive] = trie.walk(at[alive], symbol)
        levels.append(np.unique(at[alive]))
        steps.append((alive, at[alive].copy()))
        alive = alive[sizes[alive] > level]
        level += 1
    size = len(trie.check)
    count, smallest, width, depth = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.zeros(size, np.int64)
    opened, goes_on = np.zeros(size, bool), n_all > n_end
    for d, (who, where) in enumerate(steps):
        np.add.at(count, where, n_all[who])
        np.minimum.at(smallest, where, low[who])
        depth[where] = seg[who] * length + d
        if d:
            width[where] = flat_chars[begin[who] + d - 1]
        # on the first or last path, or above a longer conversation
        opened[where[(who == 0) | (who == n - 1) | goes_on[who]]] = True
    opened[levels[0]] = True
    named, ends = {}, {}
    for i in np.flatnonzero(n_end).tolist():
        ends[int(at[i])] = f"{seg[i] * length + sizes[i]}:{stops[i]}"
    # names of open nodes: by their prefix at either end of a segment, by their path inside
    for d, (who, where) in enumerate(steps):
        if d == 0:
            for i, s in zip(who.tolist(), where.tolist(), strict=True):
                named.setdefault(s, f"{seg[i] * length}:{starts[i]}")
            continue
        for i, s in zip(who.tolist(), where.tolist(), strict=True):
            if opened[s] and s not in named:
                if d == length:
                    named[s] = f"{depth[s]}:{stops[i]}"
                else:
                    raw = f"{starts[i]}|".encode() + b"".join(flat[begin[i]:begin[i] + d])
                    named[s] = f"{depth[s]}:{hashlib.blake2b(raw, digest_size=16).hexdigest()}"
    # from the leaves up: children, leaves and saved tokens; an open node takes from closed children only
    children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, object)
    for nodes in reversed(levels):
        own = ~opened[nodes]
        closed = nodes[own]
        leaves[closed] += children[closed] == 0
        saved[closed] += [int(a) for a in (count[closed] - 1) * width[closed]]
        up = trie.check[closed]
        np.add.at(children, up, 1)
        np.add.at(leaves, up, leaves[closed])
        np.add.at(saved, up, saved[closed])
    out = np.concatenate(levels)
    up = trie.check[out]
    top = np.zeros(size, bool)
    top[levels[0]] = True
    far = top[out] & (depth[out] > 0)  # the start of a later segment: its own counts come from the segment before
    is_open, inner = opened[out], ~top[out]
    dec = pa.decimal128(38, 0)
    return pa.table({
        "open": pa.array(is_open), "name": pa.array([named.get(s) if o else None for s, o in zip(out.tolist(), is_open.tolist(), strict=True)], pa.string()),
        "parent_name": pa.array([named.get(p) if i and opened[p] else None for p, i in zip(up.tolist(), inner.tolist(), strict=True)], pa.string()),
        "conv_id": pa.array(smallest[out], mask=far), "parent_conv_id": pa.array(smallest[up], mask=~inner | opened[up]),
        "depth": pa.array(depth[out]), "n_convs": pa.array(np.where(far, 0, count[out])), "n_children": pa.array(children[out]),
        "n_leaves": pa.array(leaves[out]), "saved_tokens": pa.array([int(x) for x in saved[out]], dec),
        "chars": pa.array(width[out], mask=far), "ends": pa.array([ends.get(s) for s in out.tolist()], pa.string())})


def end_lists(whole: DataFrame, piece: int = PIECE) -> DataFrame:
    """(ends, ends_sha256): the ids of the conversations that end at each node, ascending, comma-joined.

    ``whole``: ends, conv_id.  A list is joined in pieces of ``piece`` ids, of which a task streams one list's
    through the digest: it holds one batch of pieces, whatever the length of the list.
    """
    n = whole.select("ends").distinct().count()
    rows = running_totals(whole.withColumn("one", F.lit(1).cast("long")), ["ends"], [F.col("conv_id")], "one", "trie-ends", n)
    joined = rows.groupBy("ends", F.floor((F.col("rn") - 1) / piece).cast("long").alias("piece")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("text"))
    joined = land(joined, "trie-pieces")
    long = land(joined.filter(F.col("piece") > 0).select("ends").distinct(), "trie-long-ends")
    short = joined.join(long, "ends", "left_anti").select("ends", F.sha2("text", 256).alias("ends_sha256"))

    def stream(batches):
        now, seen = None, None
        for batch in batches:
            done = []
            for ends, number, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if ends != now:
                    if now is not None:
                        done.append((now, seen.hexdigest()))
                    now, seen = ends, hashlib.sha256()
                seen.update((("," if number else "") + text).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in range(2)], ["ends", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([seen.hexdigest()], pa.string())], ["ends", "ends_sha256"])

    streamed = (joined.join(long, "ends", "left_semi").repartition("ends").sortWithinPartitions("ends", "piece")
                .select("ends", "piece", "text").mapInArrow(stream, "ends string, ends_sha256 string"))
    return short.unionByName(streamed)


def _open_totals(partial: DataFrame) -> DataFrame:
    """Open nodes, merged by name, with the sums over their whole subtrees (pointer doubling)."""
    merged = land(partial.groupBy("name").agg(
        F.max("parent_name").alias("parent_name"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").cast("decimal(38,0)").alias("saved_tokens"), F.max("chars").alias("chars"), F.max("ends").alias("ends")), "trie-open")
    below = merged.groupBy(F.col("parent_name").alias("__p")).agg(F.count("*").alias("more"))
    merged = merged.join(below, F.col("name") == F.col("__p"), "left")
    children = F.col("n_children") + F.coalesce("more", F.lit(0))
    own = ((F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0))).cast("decimal(38,0)")
    state = land(merged.select("name", "parent_name", "conv_id", "depth", "n_convs", children.alias("n_children"), "ends",
                               (F.col("n_leaves") + (children == 0).cast("long")).alias("n_leaves"),
                               (F.col("saved_tokens") + own).cast("decimal(38,0)").alias("saved_tokens"), F.col("parent_name").alias("up")), "trie-step0")
    deepest, far = state.agg(F.max("depth")).first()[0] or 0, 1
    while far <= deepest:
        sent = state.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("__u")).agg(
            F.sum("n_leaves").alias("__l"), F.sum("saved_tokens").alias("__s"))
        # the next ancestor: none above the root, which stands ``depth`` above
        above = state.filter(F.col("depth") > far).select(F.col("name").alias("__n"), F.col("up").alias("__up"))
        reach = state.filter(F.col("up").isNotNull() & (F.col("depth") >= 2 * far)).select(F.col("name").alias("__m"), F.col("up").alias("__a"))
        root = above.unionByName(state.filter(F.col("depth") == far).select(F.col("name").alias("__n"), F.col("up").alias("__up")))
        jump = reach.join(root, F.col("__a") == F.col("__n")).select("__m", "__up")
        state = (state.join(sent, F.col("name") == F.col("__u"), "left").join(jump, F.col("name") == F.col("__m"), "left")
                 .withColumn("n_leaves", F.col("n_leaves") + F.coalesce("__l", F.lit(0)))
                 .withColumn("saved_tokens", (F.col("saved_tokens") + F.coalesce("__s", F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)"))
                 .withColumn("up", F.col("__up")).drop("__u", "__l", "__s", "__m", "__up"))
        far *= 2
        state = land(state, f"trie-step{far}")
    return state


def prefix_trie(turns: DataFrame, length: int = SEGMENT, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.  Rebuilt: the first h turns of the first conversation of the
    hundred, then the own ones after the first h (``shared_turns``).

    ``turns``: conv_id, turn, role, text.  Turns stand by number, null first; equal numbers by their role and
    text (in the order of their digests).  Null roles and texts are empty ones.  Rows without a conv_id
    belong to no conversation and are left out.  Long texts enter digests only; a conversation of any
    length is cut into segments; equal conversations are one class.  An empty table has no node.
    """
    convs, own = rebuilt(land(numbered_turns(turns), "trie-numbered"))
    cut = segments(convs, own, length)
    classes = land(cut.groupBy("seg", "start", "stop").agg(
        F.first("path").alias("path"), F.first("chars").alias("chars"), F.count("*").alias("n"),
        F.sum(F.col("last").cast("long")).alias("n_end"), F.min("conv_id").alias("conv_id")), "trie-classes")
    order = [F.col("seg"), F.col("start"), F.col("path")]
    placed = running_totals(classes, [], order, "n", "trie-placed", 1).drop("cum").withColumnRenamed("rn", "place")
    shards = placed.withColumn("shard", F.floor((F.col("place") - 1) / shard).cast("long"))
    nodes = land(shards.select("shard", "place", "seg", F.col("start").cast("string").alias("start"), F.col("stop").cast("string").alias("stop"),
                               "path", "chars", "n", "n_end", "conv_id")
                 .groupBy("shard").applyInArrow(lambda t: _shard_nodes(t, length), NODES), "trie-nodes")
    opened = land(_open_totals(nodes.filter("open").drop("open", "parent_conv_id")), "trie-opened")
    n_open = opened.count()
    parents = small(opened.select(F.col("name").alias("__n"), F.col("conv_id").alias("__c")), n_open)
    columns = ["conv_id", "depth", "parent_name", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    every = (nodes.filter(~F.col("open")).select(*columns)
             .unionByName(opened.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns)))
    every = every.join(parents, F.col("parent_name") == F.col("__n"), "left")
    ended = cut.filter("last").select(
        _name(F.col("seg") * length + F.size("path"), F.col("stop")).alias("ends"), "conv_id")
    lists = end_lists(ended, piece).withColumnRenamed("ends", "__e")
    return (every.join(lists, F.col("ends") == F.col("__e"), "left")
            .select("conv_id", "depth", F.coalesce("parent_conv_id", "__c").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                    F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
