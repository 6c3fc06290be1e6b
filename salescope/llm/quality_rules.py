"""Quality rules: base counts and robust multivariate outliers per language and source (native Spark).

Base rules look at one document.  The method looks at the group (lang, source): a minimum-
covariance-determinant estimate of centre and scatter of transformed statistics, and rejection by
Mahalanobis distance.  Several starts are refined side by side by concentration steps until no group's
determinant falls any more, and each group keeps the start of least determinant.  Everything is algebraic
aggregation (sums, products and mergeable quantile sketches), so a group of any size leaves one row
per task and start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import land, small, text_or_empty, word_array

WINDOW = 5
#: transformed statistics of the method
FEATURES = ("f_word_len", "f_symbols", "f_dup_lines", "f_repeat", "f_caps")
#: share of a group that the estimate is concentrated on, and most concentration steps
SUPPORT, STEPS = 0.75, 8
#: starts: distances from the medians in floors and in the group's own spread, and quarters picked by a hash
STARTS = ("floors", "spread", "hash0", "hash1")
#: deviation that every feature has at least: a statistic that is constant in a group (no symbols, no
#: repeated lines) must not turn a tiny deviation into a large distance.  A tenth in log word length, 1.5 %
#: of the characters, a tenth of the lines, 5 % of the words, 5 % of the characters.
FLOORS = (0.1, 0.015, 0.1, 0.05, 0.05)
#: pseudo-rows with which the estimate over all documents supports that of a small group
PRIOR_ROWS = 20.0
#: squared distance beyond which a document is an outlier.  The features are bounded and far from
#: normal, so this is above the chi-square quantile (20.5 at 0.999 for five features).
CUTOFF = 30.0


def base_counts(docs: DataFrame) -> DataFrame:
    """One row per document with the base statistics; the text itself is dropped.

    n_words, word_chars (code points in words), n_symbols (characters of ``#*$%&|<>``), n_dup_lines
    (lines with a word that equal an earlier line), n_repeat_words (words in five-word windows found
    at least twice in the text, the first occurrence included) and n_caps (A-Z).  A null text has no words.
    """
    d = docs.select("doc_id", "lang", "source", text_or_empty("text").alias("t"))
    d = d.select("doc_id", "lang", "source", "t", word_array(F.col("t")).alias("w"))
    windows = F.when(F.size("w") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)),
        lambda i: F.xxhash64(*[F.element_at(F.col("w"), (i + k).cast("int")) for k in range(WINDOW)])
    )).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"),
                 F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 F.char_length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                 F.char_length(F.regexp_replace("t", r"[^A-Z]+", "")).cast("long").alias("n_caps"),
                 lines.alias("lines"), windows.alias("h"))
    # few texts repeat a window; only those need the positions
    twice = F.size(F.array_distinct("h")) < F.size("h")
    ordered = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("s", F.when(twice, ordered))
    at = lambda i: F.get(F.col("s"), i)
    positions = F.sort_array(F.transform(
        F.filter(F.transform("s", lambda x, i: F.struct(
            x["i"].alias("i"), (F.coalesce(at(i - 1)["h"] == x["h"], F.lit(False))
                                | F.coalesce(at(i + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["i"]))
    d = d.withColumn("p", F.when(twice, positions))
    covered = F.aggregate(
        F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), i + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda acc, x: acc + x)
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_caps",
                    (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                    F.size("lines").cast("long").alias("n_lines"),
                    F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def features() -> list[Column]:
    """Bounded statistics: shares, and the log of the mean word length."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda a, b: F.least(a / b, F.lit(1.0))
    return [F.log1p(F.col("word_chars") / words).alias("f_word_len"),
            share(F.col("n_symbols"), chars).alias("f_symbols"),
            share(F.col("n_dup_lines"), F.greatest(F.col("n_lines"), F.lit(1))).alias("f_dup_lines"),
            share(F.col("n_repeat_words"), words).alias("f_repeat"),
            share(F.col("n_caps"), chars).alias("f_caps")]


def _moments(cols: list[str]) -> list[Column]:
    out = [F.count("*").cast("double").alias("n")]
    out += [F.sum(c).alias(f"s_{i}") for i, c in enumerate(cols)]
    return out + [F.sum(F.col(a) * F.col(b)).alias(f"s_{i}_{j}")
                  for i, a in enumerate(cols) for j, b in enumerate(cols) if j <= i]


def _centre_and_cholesky(floors: tuple[float, ...], scale: float) -> tuple[list[Column], list[list[Column]]]:
    """Layers of columns: mean m_i, covariance c_i_j (prior rows mixed in), Cholesky factor l_i_j."""
    d, n = len(floors), F.col("n") + PRIOR_ROWS
    s = lambda k: (F.col(f"s_{k}") + PRIOR_ROWS * F.col(f"g_{k}")) / n
    means = [s(str(i)).alias(f"m_{i}") for i in range(d)]
    layers: list[list[Column]] = []
    layers.append([(scale * (s(f"{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}"))
                    + (floors[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i in range(d) for j in range(i + 1)])
    for j in range(d):  # one column of the factor after the other
        diag = F.col(f"c_{j}_{j}")
        for k in range(j):
            diag = diag - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        layers.append([F.sqrt(F.greatest(diag, F.lit(floors[j] ** 2 * 1e-3))).alias(f"l_{j}_{j}")])
        below = []
        for i in range(j + 1, d):
            v = F.col(f"c_{i}_{j}")
            for k in range(j):
                v = v - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            below.append((v / F.col(f"l_{j}_{j}")).alias(f"l_{i}_{j}"))
        if below:
            layers.append(below)
    return means, layers


def _same(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return on


def _with_distance(rows: DataFrame, cols: list[str], model: DataFrame, keys: list[str], n_groups: int) -> DataFrame:
    """Squared Mahalanobis distance ``d2`` by forward substitution with the group's factor."""
    d = len(cols)
    out = rows.join(small(model, n_groups), _same(keys))
    for i in range(d):
        y = F.col(cols[i]) - F.col(f"m_{i}")
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        out = out.withColumn(f"y_{i}", y / F.col(f"l_{i}_{i}"))
    d2 = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, d)), F.col("y_0") * F.col("y_0"))
    return out.withColumn("d2", d2).select(*rows.columns, "d2")


def _quantile(c: Column, q: float) -> Column:
    return F.percentile_approx(c, F.lit(q), F.lit(1000))


def start_hash(cols: list[str], number: int) -> Column:
    """A quarter (0 to 3) of the rows for a start: by a hash of the statistics."""
    return F.pmod(F.xxhash64(F.lit(number), *cols), F.lit(4))


def _starts(rows: DataFrame, cols: list[str], keys: list[str], floors: tuple[float, ...]) -> tuple[DataFrame, int]:
    """(rows once per start with ``start`` and ``d2``, number of groups): what the first concentration ranks by."""
    named = [F.col(k).alias(f"__{k}") for k in keys]
    medians = land(rows.groupBy(*named).agg(*[_quantile(F.col(c), 0.5).alias(f"m_{i}") for i, c in enumerate(cols)]), "mcd-medians")
    n_groups = medians.count()
    near = rows.join(small(medians, n_groups), _same(keys)).drop(*[f"__{k}" for k in keys])
    apart = [F.abs(F.col(c) - F.col(f"m_{i}")) for i, c in enumerate(cols)]
    spread = land(near.groupBy(*named).agg(*[_quantile(a, 0.5).alias(f"v_{i}") for i, a in enumerate(apart)]), "mcd-spread")
    near = near.join(small(spread, n_groups), _same(keys)).drop(*[f"__{k}" for k in keys])
    # 1.4826 turns the median deviation of normal rows into their standard deviation
    units = {"floors": [F.lit(f) for f in floors], "spread": [F.lit(1.4826) * F.col(f"v_{i}") + F.lit(f) for i, f in enumerate(floors)]}
    ranks = []
    for s in STARTS:
        if s in units:
            z = [F.pow(a / u, 2) for a, u in zip(apart, units[s], strict=True)]
            ranks.append(sum(z[1:], z[0]))
        else:
            ranks.append(F.when(start_hash(cols, int(s[4:])) == 0, 0.0).otherwise(1.0))
    both = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), r.alias("d2")) for i, r in enumerate(ranks)])).alias("s")
    out = near.select(*keys, *cols, both).select(*keys, *cols, "s.start", "s.d2")
    return out, n_groups


def mcd_models(rows: DataFrame, cols: list[str], keys: list[str], floors: tuple[float, ...]) -> tuple[DataFrame, int]:
    """(one row per group: centre, factor of the scatter, start and ``logdet`` of the least determinant; number of groups).

    Each step keeps the ``SUPPORT`` share of rows of least distance (by a quantile sketch; a hash start
    begins with its quarter), re-estimates mean and covariance on them, and measures all rows again.  The steps end
    when no determinant falls.  Groups with few rows lean on the estimate over all rows by a fixed number of
    pseudo-rows; null keys form groups of their own.
    """
    d = len(cols)
    group = [*keys, "start"]
    named = [F.col(k).alias(f"__{k}") for k in group]
    current, n_groups = _starts(rows, cols, keys, floors)
    current = land(current, "mcd-starts")
    points, many = current.drop("d2"), n_groups * len(STARTS)
    moments = [f"{i}" for i in range(d)] + [f"{i}_{j}" for i in range(d) for j in range(i + 1)]
    # consistency factor of the covariance: rows inside the SUPPORT ellipsoid vary less
    means, layers = _centre_and_cholesky(floors, 1.0 / SUPPORT)
    names = [f"__{k}" for k in group]
    factor = [*[f"m_{i}" for i in range(d)], *[f"l_{i}_{j}" for i in range(d) for j in range(i + 1)]]
    hashed = F.col("start").isin([i for i, s in enumerate(STARTS) if s.startswith("hash")])
    best = None
    for step in range(STEPS):
        cut = land(current.groupBy(*named).agg(_quantile(F.col("d2"), SUPPORT).alias("__q")), f"mcd-cut{step}")
        keep = F.col("d2") <= F.col("__q")
        if step == 0:  # a hash start's quarter
            keep = F.when(hashed, F.col("d2") == 0.0).otherwise(keep)
        inside = current.join(small(cut, many), _same(group)).filter(keep)
        sums = land(cut.drop("__q").join(inside.groupBy(*[F.col(k).alias(f"i_{k}") for k in group]).agg(*_moments(cols)),
                                         _all_equal(names, [f"i_{k}" for k in group]), "left").drop(*[f"i_{k}" for k in group]), f"mcd-moments{step}")
        whole = sums.groupBy(F.col("__start").alias("g_start")).agg(*[(F.sum(f"s_{m}") / F.sum("n")).alias(f"g_{m}") for m in moments])
        model = sums.join(small(whole, len(STARTS)), F.col("__start") == F.col("g_start"))
        model = model.select(*names, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("n", *[f"s_{m}" for m in moments], *[f"g_{m}" for m in moments])])
        model = model.select("*", *means)
        for layer in layers:
            model = model.select("*", *layer)
        logdet = sum((2.0 * F.log(F.col(f"l_{i}_{i}")) for i in range(1, d)), 2.0 * F.log(F.col("l_0_0")))
        model = land(model.select(*names, *factor, logdet.alias("logdet")), f"mcd-model{step}")
        if best is None:
            best, falls = model, many
        else:
            was = best.select(*[F.col(x).alias(f"was{x}") for x in names], *[F.col(x).alias(f"was_{x}") for x in (*factor, "logdet")])
            both = model.join(small(was, many), _all_equal(names, [f"was{x}" for x in names]))
            lower = F.col("logdet") < F.col("was_logdet") - 1e-9
            best = land(both.select(*names, *[F.when(lower, F.col(x)).otherwise(F.col(f"was_{x}")).alias(x) for x in (*factor, "logdet")],
                                    lower.alias("fell")), f"mcd-best{step}")
            falls = best.filter("fell").count()
        if not falls:
            break
        if step + 1 < STEPS:
            current = _with_distance(points, cols, model, group, many).select(*points.columns, "d2")
    chosen = best.groupBy(*[f"__{k}" for k in keys]).agg(F.min(F.struct("logdet", "__start", *factor)).alias("b"))
    return land(chosen.select(*[f"__{k}" for k in keys], "b.*"), "mcd-chosen"), n_groups


def _all_equal(left: list[str], right: list[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def robust_distance(rows: DataFrame, cols: list[str], keys: list[str], floors: tuple[float, ...]) -> DataFrame:
    """Add ``d2``: squared distance to the group's MCD estimate; ``rows`` is a landed, narrow table."""
    model, n_groups = mcd_models(rows, cols, keys, floors)
    return _with_distance(rows, cols, model.drop("logdet", "__start"), keys, n_groups)


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Base counts, ``base_failed``, ``d2`` and ``kept`` per document.

    A document is kept if it passes the base rules and is no outlier of its (lang, source).  Null
    langs and sources are groups; null texts fail the base rule; repeated rows are all judged; very long
    texts are counted whole; an empty table has no rows; other columns are not read.
    """
    rows = land(base_counts(docs).select("*", *features()), "quality-stats")
    judged = robust_distance(rows, list(FEATURES), ["lang", "source"], FLOORS)
    return (judged.withColumn("base_failed", base_failed())
            .withColumn("outlier", F.col("d2") > cutoff)
            .withColumn("kept", ~F.col("base_failed") & ~F.col("outlier")))
