"""Line dedup by winnowing over line hashes.

A passage that occurs earlier in the corpus (by document id, then position) is deleted; the first
occurrence stays.  A passage is a run of at least ``min_run`` lines, or one line of at least ``min_words``
words, or a text of fewer than ``min_run`` lines as a whole.

1. Winnowing: in every window of ``min_run`` lines the least line hash (the rightmost of equal ones) is
   selected, so two equal windows select the same line; a line of ``min_words`` words is a window of its own.
   One row per selected line is kept, with the windows that selected it.
2. Positions are joined on fingerprints that occur more than once: each window to its first place.
3. Matches on one diagonal (the same two documents at the same distance) are extended both ways over
   the line hashes until lines differ, and the later of the two runs is deleted.  Lines without a word
   go only beside one that has a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.llm import wordhash
from salescope.llm.common import WORD, land, text_or_empty

MIN_RUN, MIN_WORDS = 2, 50
#: later places that one task compares with one first place; more are dealt to several
PLACES = 1000


def text_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _prints(windows: np.ndarray) -> np.ndarray:
    """One hash per row of line hashes; the number of lines counts."""
    out = np.full(len(windows), windows.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(windows.shape[1]):
            out = wordhash.mix(out * np.uint64(0x9E3779B97F4A7C15) + windows[:, k].view(np.uint64))
    return out.view(np.int64)


def _anchors(h: np.ndarray, words: np.ndarray, n: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(selected line, start, print) of every window of a text, by selected line.

    Windows without a word are left out; of equal least hashes the rightmost is selected.
    """
    size = min(n, len(h))
    spots = np.arange(len(h) - size + 1)[:, None] + np.arange(size)
    windows = h[spots]
    line = spots[:, 0] + size - 1 - windows[:, ::-1].argmin(axis=1)
    full = words[spots].max(axis=1) > 0
    line, at, prints = line[full], spots[full, 0], _prints(np.ascontiguousarray(windows[full]))
    if n > 1 and len(h) > 1:
        long = np.flatnonzero(words >= min_words)
        line, at, prints = np.append(line, long), np.append(at, long), np.append(prints, _prints(h[long][:, None]))
    order = np.argsort(line, kind="stable")
    return line[order], at[order], prints[order]


def _select(batches, n: int, min_words: int):
    """Rows (row, doc_id, tie, h, w) to rows (row, doc_id, tie, finger, at, print): one per selected line."""
    for batch in batches:
        h, w = (number_lists(batch.column(i)) for i in (3, 4))
        of, fingers, counts, ats, prints = [], [], [], [], []
        for i, (own, words) in enumerate(zip(h, w, strict=True)):
            line, at, p = _anchors(own, words, n, min_words)
            begin = np.flatnonzero(np.diff(line, prepend=-1))
            of.append(np.full(len(begin), i))
            fingers.append(own[line[begin]])
            counts.append(np.diff(np.append(begin, len(line))))
            ats.append(at)
            prints.append(p)
        if not of:
            continue
        take = pa.array(np.concatenate(of))
        bounds = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x), t)) for x, t in ((ats, pa.int32()), (prints, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(3)), pa.array(np.concatenate(fingers)), *lists],
                                         ["row", "doc_id", "tie", "finger", "at", "print"])


def number_lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as numpy arrays."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(np.asarray(column.value_lengths()))[:-1]) if len(column) else []


def _extend(h: np.ndarray, words: np.ndarray, other: np.ndarray, shift: int, at: np.ndarray, min_run: int, min_words: int) -> np.ndarray:
    """Lines of runs that equal ``other`` moved by ``shift`` and hold one of the matched lines ``at``."""
    lo, hi = max(0, shift), min(len(h), len(other) + shift)
    same = np.zeros(len(h) + 2, bool)  # one line of margin on either side
    same[lo + 1:hi + 1] = h[lo:hi] == other[lo - shift:hi - shift]
    begin = np.flatnonzero(same[1:] & ~same[:-1])
    end = np.flatnonzero(same[:-1] & ~same[1:])
    own = np.unique(np.searchsorted(begin, at, "right") - 1)
    gone = []
    for b, e in zip(begin[own].tolist(), end[own].tolist(), strict=True):
        full = words[b:e] > 0
        if e - b >= min(min_run, len(h)):
            reach = full.copy()
            for step in range(1, min(min_run, e - b)):  # a window that reaches from a line with a word
                reach[step:] |= full[:-step]
                reach[:-step] |= full[step:]
            gone.append(b + np.flatnonzero(reach))
        else:
            gone.append(b + np.flatnonzero(words[b:e] >= min_words))
    return np.concatenate(gone) if gone else np.zeros(0, np.int64)


def repeated_lines(docs: DataFrame, min_run: int = MIN_RUN, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(rows, removed): ``row, doc_id, n_lines`` per document and ``row, lines`` -- the sorted 0-based
    numbers of the lines to delete -- for documents that lose any.

    A null or empty text is one empty line, and windows of white space alone are never deleted.  Null ids
    come first; rows that repeat an id are ordered by their text's hash.
    """
    t = docs.select("doc_id", text_or_empty("text").alias("t"))
    t = t.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("t").alias("tie"), text_lines(F.col("t")).alias("l"))
    hashes = F.transform("l", lambda x: F.xxhash64(x))
    words = F.transform("l", lambda x: F.regexp_count(x, F.lit(WORD)))
    rows = land(t.select("row", "doc_id", "tie", hashes.alias("h"), words.alias("w")), "lines")
    kind = docs.schema["doc_id"].dataType.simpleString()
    anchors = land(rows.mapInArrow(lambda batches: _select(batches, min_run, min_words),
                                   f"row long, doc_id {kind}, tie long, finger long, at array<int>, print array<bigint>"), "line-anchors")
    # fingerprints of one place cannot be in a repeated run
    shared = anchors.groupBy(F.col("finger").alias("__f")).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    near = (anchors.join(shared, F.col("finger") == F.col("__f"), "left_semi")
            .select("row", "doc_id", "tie", F.explode(F.arrays_zip("at", "print")).alias("win")).select("row", "doc_id", "tie", "win.*"))
    near = land(near, "line-places")
    place = F.struct("doc_id", "tie", "row", "at")
    first = (near.groupBy(F.col("print").alias("__w")).agg(F.min(place).alias("first"), F.count("*").alias("n"))
             .filter("n > 1").drop("n"))
    later = near.join(first, F.col("print") == F.col("__w")).filter(place != F.col("first"))
    # one row per diagonal; a much-copied first document is sent to several tasks
    runs = land(later.groupBy("row", F.col("first.row").alias("first_row"), (F.col("at") - F.col("first.at")).alias("shift"))
                .agg(F.sort_array(F.collect_set("at")).alias("at")), "line-runs")
    spread = (runs.groupBy(F.col("first_row").alias("__first")).agg(F.ceil(F.count("*") / F.lit(PLACES)).cast("int").alias("__parts")))
    others = (rows.select(F.col("row").alias("__first_row"), F.col("h").alias("other")).join(spread, F.col("__first_row") == F.col("__first"))
              .select("__first_row", "__parts", "other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part")))
    dealt = (runs.join(spread, F.col("first_row") == F.col("__first"))
             .withColumn("__p", F.pmod(F.xxhash64("row", "shift"), F.col("__parts")).cast("int")).drop("__first", "__parts"))
    own = rows.select(F.col("row").alias("__row"), "h", "w")
    paired = (dealt.join(own, F.col("row") == F.col("__row"))
              .join(others, (F.col("first_row") == F.col("__first_row")) & (F.col("__p") == F.col("__part")))
              .select("row", "shift", "at", "h", "w", "other"))

    def extend(batches):
        for batch in batches:
            row, shift = batch.column(0), batch.column(1).to_pylist()
            lists = [number_lists(batch.column(i)) for i in range(2, 6)]
            gone = [_extend(h, w, o, s, a, min_run, min_words) for s, a, h, w, o in zip(shift, *lists, strict=True)]
            yield pa.RecordBatch.from_arrays([row, pa.array([g.astype(np.int32) for g in gone], pa.list_(pa.int32()))], ["row", "lines"])

    found = paired.mapInArrow(extend, "row long, lines array<int>")
    removed = found.groupBy("row").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))
    return rows.select("row", "doc_id", "tie", F.size("h").cast("long").alias("n_lines")), removed


def dedup_lines(docs: DataFrame, min_run: int = MIN_RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (sorted line numbers) and ``text`` without the repeated passages.

    Rows that share an id and a text lose lines one by one: the first of them stays as it is.  Null texts
    are empty ones; a text of any length is taken whole; an empty table gives an empty one; other columns
    are not read.
    """
    rows, removed = repeated_lines(docs, min_run, min_words)
    none = F.array().cast("array<int>")
    key = F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.col("tie"))
    plan = rows.join(removed.withColumnRenamed("row", "__r"), F.col("row") == F.col("__r"), "left")
    # rows equal in id and text: all after the first repeat it and lose the same lines, so two lists do
    plan = (plan.select(key.alias("__k"), "row", "n_lines", F.coalesce("lines", none).alias("lines")).groupBy("__k")
            .agg(F.first("n_lines").alias("n_lines"), F.min_by("lines", "row").alias("__one"), F.max_by("lines", "row").alias("__more")))
    t = docs.select("doc_id", text_or_empty("text").alias("t")).withColumn("tie", F.xxhash64("t")).withColumn("key", key)
    # the text is dealt once, by the key of both the count and the join
    t = t.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))))
    both = t.join(plan, F.col("key") == F.col("__k"))
    both = both.withColumn("removed", F.when(F.col("nth") == 1, F.col("__one")).otherwise(F.col("__more")))
    lines = text_lines(F.col("t"))
    stay = F.filter(F.arrays_zip(lines.alias("l"), F.sequence(F.lit(0), F.size(lines) - 1).alias("i")),
                    lambda x: ~F.array_contains("removed", x["i"]))
    text = F.when(F.size("removed") == 0, F.col("t")).otherwise(F.array_join(F.transform(stay, lambda x: x["l"]), "\n"))
    return both.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", text.alias("text"))
