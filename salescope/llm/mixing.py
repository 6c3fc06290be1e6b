"""Mixing sources to target weights by Efraimidis-Spirakis sampling (native Spark).

Every source gets a word target: weights share a multiple of all words, a target never exceeds
``max_epochs`` times its source's words, and what is cut off goes to the other sources by weight
(water filling).  Whole epochs come first; the fractional rest is a weighted sample without
replacement: each document draws the exponential key -ln(u) / w, where u is a hash of its id and w
its quality weight.  A source's documents are walked in key order; each one that still fits into what
is left of the word budget is taken, and one that does not is passed over.  When none fits any more, one
closing document -- the one left over whose size is nearest to the gap, if it comes nearer than
stopping -- may be added.

The walk is distributed: a distributed prefix sum takes the longest prefix of the documents no larger
than the budget; the first that does not fit leaves a gap smaller than itself.  From there the next
``AHEAD`` documents of a source that are no larger than its gap are walked one by one, as often as any are
left (few times: the gap shrinks).  That equals the walk over all, because whatever is passed over is larger
than every later gap.  Rows with one draw (equal id and text) are one class in the walk, and a cut may
fall inside a class: then so many of its rows are taken as fit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.llm.common import WORD, land, running_totals, small, text_or_empty

CYCLE = (5.0, 2.0, 1.0)
DRAW = ("key", "id", "size", "crc")
_TAKEN = "array<struct<draw:struct<key:double,id:bigint,size:bigint,crc:bigint>,take:bigint,n:bigint>>"
#: documents of a source that are walked at once; Spark then keeps no more of them per task
AHEAD = 1000
#: share of its target by which whole documents may miss it
TOLERANCE = 0.05


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """0.25 to 1, by the share of letters and spaces among the characters; 0.25 for an empty text."""
    t = text_or_empty(text)
    n = F.char_length(t)
    plain = F.char_length(F.regexp_replace(t, r"[^\p{L} ]+", ""))
    return F.round(F.lit(0.25) + F.lit(0.75) * F.when(n > 0, plain / n).otherwise(F.lit(0.0)), 6)


def uniform_hash(key: str, salt: str) -> Column:
    """A number in (0, 1) that depends on the key alone: the first 52 bits of an md5."""
    digest = F.md5(F.concat_ws("|", F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))


def source_targets(sizes: DataFrame, ratio: float, max_epochs: float, cycle=CYCLE) -> DataFrame:
    """One row per source: ``source_size`` and ``target``.

    Weights repeat ``cycle`` over the sources by code point, null last.  Sources whose cap is small
    for their weight fill first, so ordering by cap / weight finds the level at which the rest share:
    a prefix sum over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (rank % len(cycle) + 1).cast("int"))
    caps = per.withColumn("__w", weight).withColumn("__cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    upto, rest, everything = (by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing),
                              by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    total = F.lit(float(ratio)) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("__cap").over(upto), F.lit(0.0))) / F.sum("__w").over(rest)
    caps = caps.withColumn("__level", level)
    # the first source (in this order) that stays below its cap sets the common level
    common = F.min(F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct(F.col("__cap") / F.col("__w"), F.col("__level"))))
    caps = caps.withColumn("__common", common.over(everything).getField("__level"))
    target = F.least(F.col("__cap"), F.coalesce(F.col("__common") * F.col("__w"), F.col("__cap")))
    return caps.select("source", "source_size", target.alias("target"))


def draw_keys(docs: DataFrame, salt: str) -> list[Column]:
    """The order in which a source's documents are drawn: exponential key, then id, size and checksum."""
    return [(-F.log(uniform_hash("doc_id", salt)) / quality_weight()).alias("key"), F.col("doc_id").cast("long").alias("id"),
            word_count().alias("size"), F.crc32(F.encode(text_or_empty("text"), "UTF-8")).alias("crc")]


def _prefix(classes: DataFrame, gaps: DataFrame, n_sources: int) -> DataFrame:
    """(source, gap, upto, part): what the prefix sum takes, per source, and the gap it leaves.

    ``classes``: source, draw columns, n.  ``upto`` is the last draw taken whole, ``part`` (draw, take, n) the class
    after it if some of its rows fit.
    """
    g = gaps.select(F.col("source").alias("__s"), F.col("gap").alias("__gap"))
    fits = (classes.join(small(g, n_sources), F.col("source").eqNullSafe(F.col("__s")))
            .filter(F.col("size") <= F.col("__gap")).drop("__s", "__gap").withColumn("weight", F.col("n") * F.col("size")))
    rows = (running_totals(fits, ["source"], [F.col(c) for c in DRAW], "weight", "mix-prefix", n_sources)
            .join(small(g, n_sources), F.col("source").eqNullSafe(F.col("__s"))))
    draw, whole, before = F.struct(*DRAW), F.col("cum") <= F.col("__gap"), F.col("cum") - F.col("weight")
    part = F.when(~whole & (before <= F.col("__gap")), F.floor((F.col("__gap") - before) / F.col("size")).cast("long"))
    taken = rows.withColumn("__part", part).groupBy("source").agg(
        F.first("__gap").alias("gap"), F.max(F.when(whole, draw)).alias("upto"), F.max(F.when(whole, F.col("cum"))).alias("used"),
        F.max(F.when(F.col("__part") > 0, F.struct(draw.alias("draw"), F.col("__part").alias("take"), F.col("n").alias("n")))).alias("part"))
    zero = F.lit(0).cast("long")
    used = F.coalesce("used", zero) + F.coalesce(F.col("part.take") * F.col("part.draw.size"), zero)
    return taken.select("source", (F.col("gap") - used).alias("gap"), "upto", "part")


def _walk(classes: DataFrame, state: DataFrame, n_sources: int, name: str) -> DataFrame:
    """(source, gap, after, taken) of the sources that have documents left after ``after`` and no larger than
    ``gap``: the first ``AHEAD`` of them, walked in order."""
    st = state.select(F.col("source").alias("__s"), "gap", "after")
    draw = F.struct(*DRAW)
    left = (classes.join(small(st, n_sources), F.col("source").eqNullSafe(F.col("__s")))
            .filter((F.col("size") <= F.col("gap")) & (F.col("after").isNull() | (draw > F.col("after")))))
    ranked = left.withColumn("__rn", F.row_number().over(Window.partitionBy("source").orderBy(*DRAW))).filter(F.col("__rn") <= AHEAD)
    ahead = ranked.groupBy("source").agg(F.first("gap").alias("gap"), F.array_sort(F.collect_list(F.struct(draw.alias("draw"), F.col("n").alias("n")))).alias("ahead"))
    none = F.array().cast(_TAKEN)

    def step(acc: Column, c: Column) -> Column:
        take = F.least(c["n"], F.floor(acc["gap"] / c["draw"]["size"]).cast("long"))
        more = F.concat(acc["taken"], F.array(F.struct(c["draw"].alias("draw"), take.alias("take"), c["n"].alias("n"))).cast(_TAKEN))
        return F.struct((acc["gap"] - take * c["draw"]["size"]).alias("gap"), F.when(take > 0, more).otherwise(acc["taken"]).alias("taken"))

    walked = F.aggregate("ahead", F.struct(F.col("gap").alias("gap"), none.alias("taken")), step)
    return land(ahead.select("source", walked.alias("w"), F.element_at("ahead", -1)["draw"].alias("after"))
                .select("source", "w.gap", "after", "w.taken"), f"mix-walk{name}")


def source_cuts(docs: DataFrame, ratio: float, max_epochs: float, salt: str) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """(narrow, cuts, parts, number of sources, number of parts).

    ``narrow``: source and draw of every document, landed.  ``cuts``, one row per source: source_size, target,
    epochs, and ``fit`` and ``upto``: documents no larger than ``fit`` whose draw is at most ``upto`` are taken.
    ``parts``, single draws: of the ``n`` rows with such a draw ``take`` are taken, and ``words`` words of one more.
    """
    narrow = land(docs.select("source", *draw_keys(docs, salt)), "mix-draws")
    targets = land(source_targets(narrow, ratio, max_epochs), "mix-targets")
    n_sources = targets.count()
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("epochs", epochs).withColumn("fit", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    classes = land(narrow.filter(F.col("size") > 0).groupBy("source", *DRAW).agg(F.count("*").alias("n")), "mix-classes")
    first = _prefix(classes, state.select("source", F.col("fit").alias("gap")), n_sources)
    f = first.select(F.col("source").alias("__s"), "gap", "upto", "part")
    state = land(state.join(small(f, n_sources), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
                 .withColumn("gap", F.coalesce("gap", "fit")), "mix-prefixed")
    walks: list[DataFrame] = []
    now = state.select("source", "gap", F.col("upto").alias("after"))
    while n_sources:
        walked = _walk(classes, now, n_sources, str(len(walks)))
        if walked.isEmpty():
            break
        walks.append(walked)
        now = walked.select("source", "gap", "after")
    # every walk takes at most AHEAD draws of a source; the closing document is one more
    single = state.filter("part IS NOT NULL").select("source", "part.draw", "part.take", "part.n")
    for w in walks:
        single = single.unionByName(w.select("source", F.explode("taken").alias("t")).select("source", "t.draw", "t.take", "t.n"))
    gaps = reduce(DataFrame.unionByName, [state.select("source", "gap"), *[w.select("source", "gap") for w in walks]])
    least = gaps.groupBy(F.col("source").alias("__s")).agg(F.min("gap").alias("__gap"))
    single = land(single.select("source", "draw.*", "take", "n", F.lit(0).cast("long").alias("words")), "mix-single")
    n_parts = single.count()
    cuts = land(state.join(small(least, n_sources), F.col("source").eqNullSafe(F.col("__s")))
                .select("source", "source_size", "target", "epochs", "fit", "upto", F.col("__gap").alias("gap")), "mix-cuts")
    # closing document: among those left out, the one nearest to the gap, if it comes nearer than stopping,
    # or, where that misses the target by too much, the first one left out, cut
    over = _with_cuts(classes, cuts, single, n_sources, n_parts).filter((F.col("n") > F.col("__sure") + F.col("__some")) & (F.col("gap") > 0))
    draw, miss = F.struct(*DRAW), F.abs(F.col("size") - F.col("gap"))
    own = lambda take, words: F.struct(*DRAW, take.cast("long").alias("take"), F.col("n").alias("n"), words.cast("long").alias("words"))
    closing = (over.groupBy("source").agg(
        F.first("gap").alias("gap"), F.first("target").alias("target"),
        F.min(F.when(miss < F.col("gap"), F.struct(miss.alias("miss"), draw.alias("draw"), own(F.lit(1), F.lit(0)).alias("part")))).alias("near"),
        F.min(F.struct(draw.alias("draw"), own(F.lit(0), F.col("gap")).alias("part"))).alias("next"))
        .select("source", F.when(F.coalesce("near.miss", "gap") > F.lit(TOLERANCE) * F.col("target"), F.col("next.part"))
                .otherwise(F.col("near.part")).alias("p")).filter("p IS NOT NULL").select("source", "p.*"))
    parts = (single.unionByName(closing).groupBy("source", *DRAW)
             .agg(F.sum("take").alias("take"), F.max("n").alias("n"), F.sum("words").alias("words")))
    return narrow, cuts, land(parts, "mix-parts"), n_sources, n_parts + n_sources


def _with_cuts(rows: DataFrame, cuts: DataFrame, parts: DataFrame, n_sources: int, n_parts: int) -> DataFrame:
    """Join each row's source and part; add ``__sure`` (n if all rows of its draw are taken, else 0), ``__some`` (how
    many of them are, where the cut falls inside the class), ``__words`` (those of the cut row) and ``__n`` (rows
    that share a part's draw)."""
    one = F.col("n") if "n" in rows.columns else F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    joined = rows.join(small(cuts.withColumnRenamed("source", "__s"), n_sources), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    p = parts.select(*[F.col(c).alias(f"__p_{c}") for c in ("source", *DRAW, "take", "n", "words")])
    on = F.col("source").eqNullSafe(F.col("__p_source"))
    for c in DRAW:
        on = on & F.col(c).eqNullSafe(F.col(f"__p_{c}"))
    joined = joined.join(small(p, n_parts), on, "left")
    inside = (F.col("size") > 0) & (F.col("size") <= F.col("fit")) & F.coalesce(F.struct(*DRAW) <= F.col("upto"), F.lit(False))
    return (joined.withColumn("__sure", F.when(inside, one).otherwise(zero)).withColumn("__some", F.coalesce("__p_take", zero))
            .withColumn("__words", F.coalesce("__p_words", zero)).withColumn("__n", F.coalesce("__p_n", zero))
            .drop(*[c for c in p.columns]))


def _extra(rows: DataFrame, cuts: DataFrame, parts: DataFrame, n_sources: int, n_parts: int, ties: list[Column], name: str) -> DataFrame:
    """``rows`` (one per document, draw columns beside ``source``) with ``whole``, its epochs plus 0 or 1,
    and ``part``, words of a cut document.

    Only rows of a class that a cut divides are numbered, in the order of ``ties`` (equal rows in any
    order); every other row's copies follow from its own draw and its source's cuts, without a shuffle.
    """
    joined = _with_cuts(rows, cuts, parts, n_sources, n_parts)
    divided, none = (F.col("__n") > F.col("__some")) & (F.col("__n") > 1), F.lit(0).cast("long")

    def decided(df: DataFrame, place: Column) -> DataFrame:
        whole = F.greatest(F.col("__sure"), (place <= F.col("__some")).cast("long"))
        return df.select(*rows.columns, "source_size", "target", (F.col("epochs") + whole).alias("whole"),
                         F.when(place == F.col("__some") + 1, F.col("__words")).otherwise(none).alias("part"))

    lone = decided(joined.filter(~divided), F.lit(1).cast("long"))
    if parts.filter("n > take AND n > 1").isEmpty():  # no class of several rows is divided
        return lone
    shared = running_totals(joined.filter(divided).withColumn("__one", F.lit(1).cast("long")), ["source", *DRAW], ties, "__one",
                            f"mix-{name}", n_sources * 64)
    return lone.unionByName(decided(shared, F.col("rn")))


def mix_plan(docs: DataFrame, ratio: float = 1.5, max_epochs: float = 2.0, salt: str = "mix") -> DataFrame:
    """One narrow row per document: doc_id, source, size, source_size, target, copies, part, taken.

    ``copies`` is how often the mix holds the document, ``part`` the words of the last of them if that one
    is cut (else 0), ``taken`` the words of all.  Null texts have
    size 0; a null source is a source of its own.  Reruns agree, because the draw is a hash of the id;
    of rows equal in id and text, so many are taken as fit.  Very long texts are one draw like any other:
    where they do not fit, smaller ones fill the gap.  An empty table gives an empty plan; other columns
    are not read.
    """
    narrow, cuts, parts, n, m = source_cuts(docs, ratio, max_epochs, salt)
    rows = _extra(narrow, cuts, parts, n, m, [F.col(c) for c in DRAW], "numbered")
    return rows.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target",
                       (F.col("whole") + (F.col("part") > 0).cast("long")).alias("copies"), "part",
                       (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def mix_documents(docs: DataFrame, ratio: float = 1.5, max_epochs: float = 2.0, salt: str = "mix") -> DataFrame:
    """The mixed documents: every row as often as the plan takes it, columns unchanged; a cut document's
    ``text`` ends after its part (its other columns stay).

    A row's copies follow from its own draw and its source's cuts (one small row), so no text is
    shuffled but those of equal rows that a cut divides.
    """
    _, cuts, parts, n, m = source_cuts(docs, ratio, max_epochs, salt)
    drawn = docs.select(F.struct(*docs.columns).alias("__doc"), "source", *draw_keys(docs, salt))
    order = F.xxhash64(*[F.col(f"__doc.`{c}`") for c in docs.columns])
    rows = _extra(drawn, cuts, parts, n, m, [order], "documents")
    # pieces of a text that each end with a word
    begun = F.array_join(F.slice(F.split(F.col("__doc.text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.col("part").cast("int")), "")
    cut = F.when(F.col("part") > 0, F.array(F.col("__doc").withField("text", begun))).otherwise(F.array().cast(rows.select(F.array("__doc")).schema[0].dataType))
    return (rows.filter((F.col("whole") > 0) | (F.col("part") > 0))
            .select(F.explode(F.concat(F.array_repeat("__doc", F.col("whole").cast("int")), cut)).alias("__doc")).select("__doc.*"))
