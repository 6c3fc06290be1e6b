
from salescope.functions.formats import capitalize, fixed, money
from salescope.operators import text


def test_money_and_fixed_formats(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (-1234567.895,), (-0.001,)], "x double")
    got = [(r[0], r[1]) for r in df.select(money("x"), fixed("x", 2)).collect()]
    assert got == [("$0.12", "0.12"), ("$2.67", "2.67"), ("$-1,234,567.90", "-1234567.90"),
                   ("$-0.00", "-0.00")]


def test_capitalize(spark):
    df = spark.createDataFrame([("user",), ("ASSISTANT",), ("two words",)], "r string")
    assert [r[0] for r in df.select(capitalize("r")).collect()] == ["User", "Assistant", "Two words"]


def test_parse_plan_cases(spark):
    replies = ['```json\n["analysis"]\n```', "nope", '{"a":1}', "[]", '```\n["forecast"]\n```',
               '  ["forecast", "explanation"]  ', '[["analysis"]]', "['analysis']", "[1] x"]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, text string")
    got = {r["i"]: (list(r["plan"]), r["plan_is_default"])
           for r in text.parse_plan(df).collect()}
    full = text.STAGE_ORDER
    assert got[0] == (["analysis"], False)
    assert got[1] == (full, True)
    assert got[2] == (full, True)
    assert got[3] == ([], False)
    assert got[4] == (full, True)
    assert got[5] == (["forecast", "explanation"], False)
    assert got[6][1] is False and "analysis" not in got[6][0]   # a valid list: kept, runs nothing
    assert got[7] == (full, True)                               # single quotes are not JSON
    assert got[8] == (full, True)                               # trailing text is not JSON


def test_resolve_plan_fixed_order_ignores_unknown(spark):
    df = spark.createDataFrame([(["recommendation", "bogus", "analysis"],)], "plan array<string>")
    assert list(text.resolve_plan(df).collect()[0]["stages"]) == ["analysis", "recommendation"]


def test_chat_history_in_turn_order(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "hi"), (1, 0, "user", "hello"), (2, 0, "user", "x")],
                               "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["history"] for r in text.chat_history(df).collect()}
    assert got == {1: "User: hello\nAssistant: hi\n", 2: "User: x\n"}


def test_rag_context_default_for_no_hits(spark):
    hits = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "qid long, rank int, text string")
    qs = spark.createDataFrame([(1,), (2,)], "qid long")
    got = {r["qid"]: r["context"] for r in text.rag_context(hits, questions=qs).collect()}
    assert got == {1: "- a\n- b", 2: text.NO_FACTS}


def test_final_report_without_optional_parts(spark):
    overall = spark.createDataFrame([(10.0, 2.0, 20.0, None)],
                                    "total_sales double, total_profit double, overall_margin double, "
                                    "avg_discount double")
    rep = text.final_report(overall, None, None).collect()[0]["report"]
    assert rep.startswith("# Executive Business Report\n\n## 1. System Performance Overview\n")
    assert "- Total Sales: $10.00" in rep and "No details available." in rep


def test_long_conversations_are_joined_by_segments(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(text, "SEGMENT_TURNS", 4)
    rows = [(c, t, "user" if t % 2 else "assistant", f"text {c} {t}") for c, n in ((1, 50), (2, 1), (3, 9)) for t in range(n)]
    rows += [(3, 100, None, "no role"), (3, 101, "user", None), (4, None, "user", "unnumbered")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    line = lambda r: f"{r[2].capitalize()}: {r[3]}\n"
    whole = {r["conv_id"]: r["history"] for r in text.chat_history(turns).collect()}
    full = [r for r in rows if r[2] and r[3]]
    assert whole == {c: "".join(line(r) for r in full if r[0] == c) for c in (1, 2, 3, 4)}
    asked = turns.where("turn IS NOT NULL").select(F.concat_ws("/", "conv_id", "turn").alias("qid"), "conv_id", F.col("turn").alias("q_turn"))
    got = {r["qid"]: r["history"] for r in text.history_before(turns, asked).collect()}
    for c, t, _, _ in rows:
        if t is not None:
            before = "".join(line(r) for r in full if r[0] == c and r[1] is not None and r[1] < t)
            assert (got.get(f"{c}/{t}") or "") == before
    # a question meets at most the lines of its own segment and one text per earlier one
    plan = text.history_before(turns, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan
