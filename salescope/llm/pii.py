"""Personal data: exact base patterns plus bootstrapped contextual extraction (native Spark).

Base: e-mail, IP, card and phone patterns with checks, as spans in code points.  Bootstrapping: the
base spans, and secrets that can be told by themselves (key ids of a known form, long hexadecimal keys,
values assigned to a credential's name), are seed instances; the words around them, with the class of the
value (digits, address, code, word), are lexical patterns: two words to the left, one on either side, or,
backing off, one word on one side.  Patterns and instances form a bipartite graph that Spark scores
iteratively: a pattern is trusted by the share of its distinct instances that are trusted, an instance
by its best pattern.  Secrets and the tokens and chains of digit groups in which a trusted pattern finds an
unseen identifier are additional spans: ``secret`` and ``ctx_<kind>``.

All work on a text is linear in it: positions come from running sums over pieces of bounded number,
and contexts from the pieces between matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.llm.common import land, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: kinds that seed the bootstrapping; the base ones and secrets
SEEDS = (*KINDS, "secret")

# The base patterns, written so that a scan stays linear (possessive runs; a match can only start
# where a run starts) and finds the same leftmost non-overlapping matches.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# a maximal chain of digits with single separators, 14 to 19 digits long
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: a token with a digit or an at sign: what may be an identifier
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

# a maximal chain of digit groups, as a phone or card number is written: it starts and ends at white space or
# punctuation, and no group is left in the middle of a word
_JOIN = "[ .()-]{1,3}"
_GROUP = rf"[0-9]++(?={_JOIN}[0-9]|[)\]}}\"',;:.!?>-]*+(?:\s|$))"
CHAIN = rf"(?<![^\s(\[{{\"'=:,;<+])(?<![0-9]{_JOIN})\+?+\(?+{_GROUP}(?:{_JOIN}{_GROUP})*+"
#: digits of a chain: more than the longest card number is a list of numbers
CHAIN_DIGITS = (5, 19)

# secrets: ids of access keys, long hexadecimal keys, and values of 12 characters or more, one of them a digit,
# assigned to a credential's name
_NAME = r"(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)"
SECRET = (r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])"
          rf"|(?<=(?i:{_NAME}[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?))(?=[^\s\"'0-9]*+[0-9])[A-Za-z0-9+/_-]{{12,}}+)")

MIN_VALUE = 5
#: matches of one text whose positions are summed at once
STEP = 128
ITERATIONS, MIN_SEEDS, TRUST = 3, 3, 0.6


_SPAN = "start:int,end:int,value:string,left:string,right:string"


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, left, right>> of all matches, 0-based code points, end exclusive.

    ``split`` gives the text between the matches, so running sums of lengths give the positions: inside
    steps of ``STEP`` matches, then over the steps.  ``left`` and ``right`` are the pieces around a match: at
    least two matches or the text between them to the left, one to the right.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def spans(x: Column) -> Column:
        found, gaps = x["found"], x["gaps"]
        n = F.size(found)
        sizes = F.zip_with(found, F.slice(gaps, F.lit(1), n), lambda m, gap: F.struct(F.char_length(gap).alias("gap"), F.char_length(m).alias("len")))
        steps = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int")), lambda i: F.slice(sizes, i * STEP + 1, F.lit(STEP)))
        zero = F.array().cast("array<int>")
        # ends inside each step, then where each step starts
        ends = F.transform(steps, lambda step: F.aggregate(step, zero, lambda acc, x: F.concat(
            acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x["gap"] + x["len"]))))
        offsets = F.aggregate(ends, F.array(F.lit(0)), lambda acc, e: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(e, -1))))
        placed = F.flatten(F.zip_with(ends, F.slice(offsets, F.lit(1), F.size(ends)), lambda e, o: F.transform(e, lambda v: v + o)))
        at = lambda a, i: F.when(i >= 0, F.coalesce(F.get(a, F.greatest(i, F.lit(0))), F.lit(""))).otherwise("")
        own = F.zip_with(placed, found, lambda end, m: F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("value")))
        return F.transform(own, lambda m, i: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
            F.concat(at(gaps, i - 2), at(found, i - 2), at(gaps, i - 1), at(found, i - 1), F.get(gaps, i)).alias("left"),
            F.concat(F.get(gaps, i + 1), at(found, i + 1), at(gaps, i + 2)).alias("right")))

    none = F.array().cast(f"array<struct<{_SPAN}>>")
    whole = F.get(F.transform(F.array(F.struct(found.alias("found"), between.alias("gaps"))), lambda x: F.when(
        F.size(x["found"]) > 0, spans(x)).otherwise(none)), F.lit(0))
    return F.coalesce(whole, none)


def base_spans(t: Column) -> Column:
    """Sorted array<struct<start, ord, end, value, left, right>>: by start, then kind as in ``SEEDS``."""
    digits = lambda v: F.char_length(F.regexp_replace(v, "[^0-9]", ""))
    luhn = lambda v: F.call_function("luhn_check", F.regexp_replace(v, "[ -]", ""))
    rules = (
        (t.contains("@"), EMAIL, None),
        (t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), IP, lambda m: m["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        (t.rlike(r"[0-9](?:[ -]?+[0-9]){13}"), CARD, lambda m: luhn(m["value"])),
        (t.contains("+"), PHONE, lambda m: digits(m["value"]).between(10, 15)),
        (t.rlike(r"AKIA[0-9A-Z]{16}|[0-9a-f]{32}|[=:]\s{0,2}[\"']?[A-Za-z0-9+/_-]{12}"), SECRET, None),
    )
    parts = []
    for i, (may, pattern, keep) in enumerate(rules):
        spans = match_spans(t, pattern)
        if keep is not None:
            spans = F.filter(spans, keep)
        ord_ = F.lit(i)
        spans = F.transform(spans, lambda m: _mention(m, m["start"], ord_, m["end"], m["value"]))
        parts.append(F.when(may, spans).otherwise(F.array().cast(f"array<struct<{_MENTION}>>")))
    return F.sort_array(F.concat(*parts))


_MENTION = "start:int,ord:int,end:int,value:string,left:string,right:string"


def _mention(m: Column, start: Column, ord_: Column, end: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), ord_.alias("ord"), end.alias("end"), value.alias("value"), m["left"].alias("left"), m["right"].alias("right"))


def _tokens(t: Column) -> Column:
    """Identifier-like tokens, reduced to their value: without ``name=`` and surrounding punctuation."""
    raw = match_spans(t, TOKEN)
    lead = lambda v: F.char_length(F.regexp_extract(v, r"^(?:.*[=:](?=[^=:]))?[^A-Za-z0-9]*", 0))
    tail = lambda v: F.char_length(F.regexp_extract(v, r"[^A-Za-z0-9]*+$", 0))
    # what is cut off belongs to the context
    cut = F.transform(raw, lambda m: F.struct(m.alias("m"), F.least(lead(m["value"]), m["end"] - m["start"]).alias("skip"), tail(m["value"]).alias("rest")))
    ok = F.filter(cut, lambda x: x["m"]["end"] - x["rest"] - x["m"]["start"] - x["skip"] >= MIN_VALUE)
    return F.transform(ok, lambda x: F.struct(
        (x["m"]["start"] + x["skip"]).alias("start"), F.lit(-1).alias("ord"), (x["m"]["end"] - x["rest"]).alias("end"),
        F.substring(x["m"]["value"], x["skip"] + 1, x["m"]["end"] - x["rest"] - x["m"]["start"] - x["skip"]).alias("value"),
        F.concat(x["m"]["left"], F.substring(x["m"]["value"], F.lit(1), x["skip"])).alias("left"),
        F.concat(F.right(x["m"]["value"], x["rest"]), x["m"]["right"]).alias("right")))


def _chains(t: Column) -> Column:
    """Chains of digit groups, with ``ord`` -2."""
    count = lambda v: F.char_length(F.regexp_replace(v, "[^0-9]", ""))
    fit = F.filter(match_spans(t, CHAIN), lambda m: count(m["value"]).between(*CHAIN_DIGITS))
    return F.transform(fit, lambda m: _mention(m, m["start"], F.lit(-2), m["end"], m["value"]))


def _near(m: Column) -> Column:
    """A mention with the words next to it instead of the text around it: l1 and l2 (one and two to the left), r1."""
    back = F.reverse(m["left"])  # anchored, so that a long word is read once
    left = lambda p: F.lower(F.reverse(F.regexp_extract(back, p, 1)))
    return F.struct(m["start"].alias("start"), m["ord"].alias("ord"), m["end"].alias("end"), m["value"].alias("value"),
                    left(r"^(\s*+\S*+)").alias("l1"), left(r"^(\s*+\S*+\s++\S*+)").alias("l2"),
                    F.lower(F.regexp_extract(m["right"], r"^(\s*+\S*+)", 1)).alias("r1"))


def scan(docs: DataFrame) -> DataFrame:
    """One narrow landed row per document: ``row`` (its number), doc_id, ``base`` and ``mentions``."""
    d = docs.select("doc_id", text_or_empty("text").alias("t"))
    d = d.select("doc_id", "t", base_spans(F.col("t")).alias("b"))
    tokens = F.when(F.col("t").rlike("[0-9@]"), F.concat(_chains(F.col("t")), _tokens(F.col("t")))).otherwise(
        F.array().cast(f"array<struct<{_MENTION}>>"))
    return land(d.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                         F.transform(F.filter("b", lambda m: m["ord"] < len(KINDS)), lambda m: F.struct(m["start"], m["ord"], m["end"])).alias("base"),
                         F.transform(F.concat("b", tokens), _near).alias("mentions")), "pii-scan")


def _class(value: Column) -> Column:
    """What a value is, however it is written: grouping, separators and a sign make no difference."""
    return (F.when(value.contains("@"), "address").when(value.rlike(r"^(?=\D*+\d)(?=[^A-Za-z]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}+$"), "code")
            .when(value.rlike(r"\p{L}"), "word").otherwise("digits"))


def mentions(scanned: DataFrame) -> DataFrame:
    """One row per base span (``ord`` >= 0), chain that no base span overlaps (-2) or token that neither overlaps (-1)."""
    m = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    sofar = (Window.unboundedPreceding, Window.currentRow)  # frames that only grow: one pass each
    by, back = (Window.partitionBy("row").orderBy(*o).rowsBetween(*sofar) for o in (("start", "ord"), (F.desc("start"), F.desc("ord"))))
    free = ~F.coalesce(F.col("__e") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("__s") < F.col("end"), F.lit(False))
    for wins, stays in ((F.col("ord") >= 0, F.col("ord") >= 0), (F.col("ord") == -2, F.col("ord") != -1)):
        m = (m.withColumn("__e", F.max(F.when(wins, F.col("end"))).over(by))
             .withColumn("__s", F.min(F.when(wins, F.col("start"))).over(back)))
        m = m.filter(stays | free).drop("__e", "__s")
    return m.select("row", "start", "end", "ord", F.lower("value").alias("value"), _class(F.col("value")).alias("class"), "l1", "l2", "r1")


def _edges(ms: DataFrame) -> DataFrame:
    """(pattern, mention): two words to the left, one on either side, or one on one side, each with the value's
    class.  The start of a text or its end is a word of its own."""
    word = lambda c: F.when(F.trim(c) == "", "^").otherwise(F.col(c))
    ways = F.array(*[F.struct(F.lit(t).alias("t"), a.alias("a"), b.alias("b")) for t, a, b in (
        ("L2", F.col("l2"), F.lit("")), ("LR", word("l1"), word("r1")), ("L1", word("l1"), F.lit("")), ("R1", F.lit("."), word("r1")))])
    p = ms.select("row", "start", "end", "ord", "value", "class", F.explode(ways).alias("p"))
    p = p.filter((F.trim("p.a") != "") & ~((F.col("p.t") != "L2") & (F.trim("p.a").isin("^", ".")) & F.trim("p.b").isin("^", "")))
    return p.select("row", "start", "end", "ord", "value",
                    F.xxhash64("p.t", F.regexp_replace(F.trim("p.a"), r"\s+", " "), F.trim("p.b"), "class").alias("pattern"))


def bootstrap(ms: DataFrame, iterations: int = ITERATIONS, min_seeds: int = MIN_SEEDS, trust: float = TRUST,
              report: list | None = None) -> DataFrame:
    """Spans (row, start, end, kind) that trusted patterns find beyond the seeds.

    ``report`` receives, for every iteration, how many patterns are trusted and how many spans they find.

    Per kind: conf(p) = sum of the scores of p's distinct instances / (their number + 1), if the sum is
    at least ``min_seeds``; score(v) = 1 for seeds, else the best conf among v's patterns.
    """
    edges = land(_edges(ms), "pii-edges")
    graph = land(edges.groupBy("pattern", "value").agg(F.max("ord").alias("ord")), "pii-graph")
    degree = graph.groupBy(F.col("pattern").alias("__p")).agg(F.count("*").alias("degree"))
    seeds = graph.filter("ord >= 0").select("value", "ord").distinct().withColumn("score", F.lit(1.0))
    seeds = land(seeds.select(F.col("value").alias("__v"), F.col("ord").alias("kind"), "score"), "pii-seeds")
    links = graph.select("pattern", "value")
    scores, trusted = seeds, None
    for i in range(iterations):
        support = (links.join(scores, F.col("value") == F.col("__v"))
                   .groupBy("pattern", "kind").agg(F.sum("score").alias("support")))
        conf = (support.filter(F.col("support") >= min_seeds).join(degree, F.col("pattern") == F.col("__p"))
                .select(F.col("pattern").alias("__c"), "kind", (F.col("support") / (F.col("degree") + 1)).alias("conf")))
        trusted = land(conf.filter(F.col("conf") >= trust), f"pii-trusted{i}")
        if report is not None:
            hit = edges.filter("ord < 0").join(trusted, F.col("pattern") == F.col("__c"))
            report.append((trusted.count(), hit.select("row", "start", "end").distinct().count()))
        if i + 1 < iterations:
            found = (links.join(trusted, F.col("pattern") == F.col("__c")).groupBy(F.col("value").alias("__v"), "kind")
                     .agg(F.max("conf").alias("score")))
            scores = land(seeds.unionByName(found).groupBy("__v", "kind").agg(F.max("score").alias("score")), f"pii-scores{i}")
    hits = edges.filter("ord < 0").join(trusted, F.col("pattern") == F.col("__c"))
    return (hits.groupBy("row", "start", "end")
            .agg(F.max(F.struct("conf", (-F.col("kind")).alias("k"))).alias("b"))
            .select("row", "start", "end", (-F.col("b.k")).alias("kind")))


def personal_data(docs: DataFrame, report: list | None = None) -> DataFrame:
    """doc_id, ``base``, ``secrets`` and ``found`` spans (arrays of start, ord, end; ``ord`` is the kind's place in
    ``SEEDS``) of every document; ``found`` holds what trusted patterns find.

    Null and empty texts have empty arrays; repeated rows and null ids are kept as they are; texts of any
    length are read whole, in time linear in them; an empty table gives an empty one; other columns are
    not read.
    """
    scanned = scan(docs)
    ms = mentions(scanned)
    own = ms.filter(F.col("ord") == len(KINDS)).select("row", "start", "end", F.col("ord").alias("kind"), F.lit(True).alias("seed"))
    span = F.struct("start", F.col("kind").alias("ord"), "end")
    extra = bootstrap(ms, report=report).withColumn("seed", F.lit(False)).unionByName(own).groupBy(F.col("row").alias("__r")).agg(
        F.sort_array(F.collect_list(F.when(~F.col("seed"), span))).alias("found"), F.sort_array(F.collect_list(F.when(F.col("seed"), span))).alias("secrets"))
    none = F.array().cast("array<struct<start:int,ord:int,end:int>>")
    return (scanned.select("row", "doc_id", "base").join(extra, F.col("row") == F.col("__r"), "left")
            .select("doc_id", "base", F.coalesce("secrets", none).alias("secrets"), F.coalesce("found", none).alias("found")))


def all_spans(base: Column, secrets: Column, found: Column) -> Column:
    """All spans as ``name:start:end``, by start, then kind; found kinds (``ctx_``) come last."""
    names = F.array(*[F.lit(k) for k in SEEDS], *[F.lit(f"ctx_{k}") for k in SEEDS])
    later = F.transform(found, lambda m: F.struct(m["start"].alias("start"), (m["ord"] + len(SEEDS)).alias("ord"), m["end"].alias("end")))
    return F.transform(F.sort_array(F.concat(base, secrets, later)), lambda m: F.concat_ws(
        ":", F.element_at(names, m["ord"] + 1), m["start"].cast("string"), m["end"].cast("string")))
