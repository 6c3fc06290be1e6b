"""Benchmark decontamination with a distributed positional inverted index (native Spark).

The index stores one posting (term, document, position) per training token whose term occurs in the
benchmark; other tokens can be in no phrase.  A window -- 13 consecutive words of an item, or a
shorter item as a whole -- is looked up from its rarest terms: their posting lists, shifted by the
term's offset in the window, are intersected on (document, start), and the survivors are confirmed
word by word.  Proximity matches relax this: the rarest terms within a span, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.llm.common import ascii_lower, land, row_key, small, text_or_empty

WINDOW = 13
#: how many of a window's rarest terms are intersected before the word-by-word check
ANCHORS = 3
#: a document is contaminated if hits make at least 1 / HIT_SHARE of its words
HIT_SHARE = 20


def normal_words(text: Column) -> Column:
    """Runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased."""
    t = F.regexp_replace(ascii_lower(text), r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(windows, membership): distinct windows with their words, and which items have them.

    Items without words have no window; rows with equal item and text count once.
    """
    w = benchmark.select("item_id", normal_words(text_or_empty("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    w = w.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), n).alias("words"))
    member = land(w.distinct().withColumn("window", F.sha2(F.array_join("words", " "), 256)), "bench-items")
    windows = member.groupBy("window").agg(F.first("words").alias("words"), F.first(F.size("words")).alias("len"))
    return land(windows, "bench-windows"), member.select("window", "item_id").distinct()


class PositionalIndex:
    """Postings of the training texts for a vocabulary, landed in the shared folder.

    ``docs``: row (unique number), doc_id, x1, x2 (row key), n_words.  ``postings``: term id, row, pos (0-based).
    """

    def __init__(self, docs: DataFrame, vocabulary: DataFrame):
        """``vocabulary``: distinct (term, tid); it is broadcast only if its counted rows allow."""
        one, two = row_key()
        numbered = docs.select("doc_id", text_or_empty("text").alias("t"), one.alias("x1"), two.alias("x2"))
        words = numbered.select(F.monotonically_increasing_id().alias("row"), "doc_id", "x1", "x2", normal_words(F.col("t")).alias("w"))
        self.n_terms = vocabulary.count()
        tokens = words.select("row", "doc_id", "x1", "x2", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "term"))
        known = tokens.join(small(vocabulary.select("term", "tid"), self.n_terms), "term", "left")
        # every row keeps its first token, so that documents without any known term stay in the index
        first = F.col("pos").isNull() | (F.col("pos") == 0)
        kept = known.filter(F.col("tid").isNotNull() | first)
        # the row key is written once a document, with its first token
        self.table = land(kept.select("tid", "row", "pos", "n_words", "doc_id", F.when(first, F.col("x1")).alias("x1"),
                                      F.when(first, F.col("x2")).alias("x2")), "postings")
        self.postings = self.table.filter(F.col("tid").isNotNull()).select("tid", "row", "pos")
        self.docs = (self.table.filter(first)
                     .select("row", "doc_id", "x1", "x2", F.greatest("n_words", F.lit(0)).cast("long").alias("n_words")))
        self.frequency = land(self.postings.groupBy("tid").agg(F.count("*").alias("cf")), "postings-cf")

    def phrases(self, windows: DataFrame, anchors: int = ANCHORS) -> DataFrame:
        """Exact matches (row, start, window, len).  ``windows``: window, len, tids (array of term ids).

        Windows with a term that no document has are dropped by their frequency of 0.
        """
        terms = windows.select("window", "len", F.posexplode("tids").alias("off", "tid"))
        terms = terms.join(small(self.frequency, self.n_terms), "tid", "left")
        rank = F.row_number().over(Window.partitionBy("window").orderBy("cf", "off"))
        ranked = (terms.withColumn("cf", F.coalesce("cf", F.lit(0))).withColumn("rank", rank)
                  .withColumn("least", F.min("cf").over(Window.partitionBy("window"))).filter("least > 0"))
        ranked = land(ranked.select("window", "len", "off", "tid", "rank"), "bench-terms")
        rare = ranked.filter(F.col("rank") <= anchors)
        n_rare = rare.count()
        lists = (self.postings.join(small(rare, n_rare), "tid")
                 .select("window", "len", "row", (F.col("pos") - F.col("off")).alias("start")).filter("start >= 0"))
        need = F.least(F.col("len"), F.lit(anchors))
        candidates = (lists.groupBy("window", "len", "row", "start").agg(F.count("*").alias("n"))
                      .filter(F.col("n") == need).drop("n"))
        candidates = land(candidates, "phrase-candidates")
        # the words beyond the anchors, in one join on (row, position, term)
        rest = ranked.filter(F.col("rank") > anchors).select(F.col("window").alias("__w"), "off", "tid")
        n_rest = rest.count()
        wanted = (candidates.join(small(rest, n_rest), F.col("window") == F.col("__w"))
                  .select("window", "len", "row", "start", (F.col("start") + F.col("off")).alias("pos"), "tid"))
        # overlapping windows ask for the same token: ask once
        asked = land(wanted.select("row", "pos", "tid").distinct(), "phrase-asked")
        there = land(asked.join(self.postings, ["row", "pos", "tid"], "left_semi"), "phrase-there")
        matched = (wanted.join(there, ["row", "pos", "tid"]).groupBy("window", "len", "row", "start")
                   .agg(F.count("*").alias("n")).filter(F.col("n") == F.col("len") - anchors).drop("n"))
        return candidates.filter(F.col("len") <= anchors).unionByName(matched.select("window", "len", "row", "start"))

    def proximity(self, windows: DataFrame, span: int, anchors: int = ANCHORS) -> DataFrame:
        """Places (window, row, bucket) where all of a window's rarest distinct terms occur within ``span`` words.

        Two overlapping bucket grids of width 2 * span make sure that terms at most ``span`` apart share one.
        """
        terms = windows.select("window", F.explode(F.array_distinct("tids")).alias("tid"))
        terms = terms.join(small(self.frequency, self.n_terms), "tid")
        rank = F.row_number().over(Window.partitionBy("window").orderBy("cf", "tid"))
        rare = terms.withColumn("rank", rank).filter(F.col("rank") <= anchors).drop("cf", "rank")
        rare = land(rare.withColumn("need", F.count("*").over(Window.partitionBy("window"))), "bench-rare")
        hits = self.postings.join(small(rare, rare.count()), "tid")
        grid = F.explode(F.array(F.floor(F.col("pos") / span), F.floor(F.col("pos") / span) - 1))
        hits = hits.select("window", "need", "row", "tid", "pos", grid.alias("bucket"))
        ends = hits.groupBy("window", "need", "row", "bucket").agg(
            F.count_distinct("tid").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
        return ends.filter(F.col("n") == F.col("need")).select("window", "row", "first", "last").distinct()


def vocabulary_of(windows: DataFrame) -> DataFrame:
    terms = windows.select(F.explode("words").alias("term")).distinct()
    return land(terms.withColumn("tid", F.xxhash64("term")), "bench-terms-all")


def with_term_ids(windows: DataFrame) -> DataFrame:
    return windows.select("window", "len", F.transform("words", lambda w: F.xxhash64(w)).alias("tids"))


def covered_words(matches: DataFrame) -> DataFrame:
    """Words inside any match, per row: the union of [start, start + len)."""
    spans = matches.groupBy("row", "start").agg(F.max("len").alias("len"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    new = F.greatest(end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    return spans.withColumn("new", new).groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, hit_share: int = HIT_SHARE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted strings) and ``contaminated`` per document.

    Null and empty texts have no words and are clean; an empty benchmark hits nothing; repeated rows
    are judged one by one.
    """
    return judge(docs, benchmark, n, hit_share).drop("x1", "x2")


def judge(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, hit_share: int = HIT_SHARE) -> DataFrame:
    """The rows of ``decontaminate`` with their row key (x1, x2)."""
    windows, member = benchmark_windows(benchmark, n)
    index = PositionalIndex(docs, vocabulary_of(windows))
    matches = land(index.phrases(with_term_ids(windows)), "phrases")
    hits = covered_words(matches).withColumnRenamed("row", "__r")
    items = (matches.select("row", "window").distinct().join(member, "window")
             .select("row", F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy(F.col("row").alias("__i")).agg(F.sort_array(F.collect_list("item")).alias("items")))
    out = (index.docs.join(hits, F.col("row") == F.col("__r"), "left").join(items, F.col("row") == F.col("__i"), "left"))
    out = out.select("doc_id", "x1", "x2", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                     F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return (out.withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * hit_share >= F.col("n_words"))))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, columns unchanged; null and repeated ids are judged by their own texts."""
    dirty = judge(docs, benchmark).filter("contaminated").select(F.col("x1").alias("__1"), F.col("x2").alias("__2"))
    dirty = land(dirty.distinct(), "dirty")
    one, two = row_key()
    return docs.join(small(dirty, dirty.count()), (one == F.col("__1")) & (two == F.col("__2")), "left_anti")
