"""Text assembly: summaries, chat history, retrieval context, prompts, plan parsing.

Ordered concatenation uses ``listagg ... WITHIN GROUP (ORDER BY ...)`` and is only ever
applied to a bounded group: the loss-making sub-categories, k forecast rows, the k hits
of one question, or the turns of one conversation -- never a whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.functions.cleaning import py_strip
from salescope.functions.formats import capitalize, fixed, iso_date, money
from salescope.operators.combine import side_by_side

# Line layouts of the root-cause and forecast summaries.
LOSS_SUB_LINE = "- {sub}: Profit: {profit}, Sales: {sales}, Avg Discount: {discount}%\n"
LOSS_PRODUCT_LINE = "- {product} ({sub}): Profit: {profit}, Sales: {sales}, Avg Discount: {discount}%\n"
REPORT_LOSS_LINE = "- {sub}: Loss: {profit}, Discount: {discount}%\n"
FORECAST_LINE = "- Date: {date}, Forecasted Sales: {yhat} (Confidence: {lower} to {upper})\n"
NO_FACTS = "No relevant facts found."
NO_DETAILS = "No details available."

# The stages a plan may name, in the order they always run.
STAGE_ORDER = ["analysis", "root_cause", "forecast", "explanation", "recommendation"]


def _fill(template: str, values: dict[str, Column]) -> Column:
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if head:
            parts.append(F.lit(head))
        parts.append(values[name])
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def ordered_concat(df: DataFrame, keys: Sequence[str], line: str, order: Sequence[str],
                   alias: str, sep: str = "") -> DataFrame:
    """One text per key group: the ``line`` column joined in ``order`` (bounded groups only)."""
    order_sql = ", ".join(order)
    expr = F.expr(f"listagg({line}, '{sep}') WITHIN GROUP (ORDER BY {order_sql})").alias(alias)
    return df.groupBy(*keys).agg(expr)


def loss_summary(loss_subs: DataFrame, loss_prods: DataFrame, n_products: int = 5) -> DataFrame:
    """One row: ``loss_summary`` and ``product_summary`` texts.

    ``loss_subs`` is the loss-making sub-categories (A7), ``loss_prods`` the top loss
    products (A8); the first ``n_products`` of them are listed.  Empty lists give ``None``.
    """
    sub_lines = loss_subs.select("sub_category", "profit", _fill(LOSS_SUB_LINE, {
        "sub": F.col("sub_category"), "profit": money(F.round("profit", 4)),
        "sales": money(F.round("sales", 2)),
        "discount": fixed(F.round("discount", 6), 1)}).alias("line"))
    prod = loss_prods.orderBy("profit", "sub_category", "product_name").limit(n_products)
    prod_lines = prod.select("sub_category", "product_name", "profit", _fill(LOSS_PRODUCT_LINE, {
        "product": F.col("product_name"), "sub": F.col("sub_category"),
        "profit": money(F.round("profit", 4)), "sales": money(F.round("sales", 2)),
        "discount": fixed(F.round("discount", 6), 1)}).alias("line"))
    a = sub_lines.agg(F.expr("listagg(line, '') WITHIN GROUP (ORDER BY profit, sub_category)")
                      .alias("loss_summary"))
    b = prod_lines.agg(F.expr(
        "listagg(line, '') WITHIN GROUP (ORDER BY profit, sub_category, product_name)")
        .alias("product_summary"))
    return side_by_side(a, b).select(
        F.coalesce("loss_summary", F.lit("None")).alias("loss_summary"),
        F.coalesce("product_summary", F.lit("None")).alias("product_summary"))


def forecast_lines(forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Forecast rows as text lines joined in date order, one text per series."""
    keys = list(keys)
    lines = forecast.select(*keys, "ds", _fill(FORECAST_LINE, {
        "date": iso_date("ds"), "yhat": money(F.round("yhat", 4)),
        "lower": money(F.round("yhat_lower", 4)), "upper": money(F.round("yhat_upper", 4))})
        .alias("line"))
    if not keys:
        return lines.agg(F.expr("listagg(line, '') WITHIN GROUP (ORDER BY ds)").alias("forecast_text"))
    return ordered_concat(lines, keys, "line", ["ds"], "forecast_text")


def chat_history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """``Role: content`` lines per conversation in turn order.

    Lines meet in segments of ``SEGMENT_TURNS`` turn numbers, then the finished segments of a conversation
    do, so a long conversation is not one task's list of turns.  A turn without role or text gives no line.
    """
    parts = _segments(_chat_lines(turns, conv, turn, role, text), conv, turn)
    return ordered_concat(parts, [conv], "_text", ["_seg"], "history")


#: turn numbers whose lines are joined at once
SEGMENT_TURNS = 256


def _chat_lines(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    line = F.concat(capitalize(F.col(role)), F.lit(": "), F.col(text), F.lit("\n"))
    return turns.select(conv, turn, F.floor(F.col(turn) / SEGMENT_TURNS).alias("_seg"), line.alias("_line"))


def _segments(lines: DataFrame, conv: str, turn: str) -> DataFrame:
    return ordered_concat(lines, [conv, "_seg"], "_line", [turn], "_text")


def history_before(turns: DataFrame, questions: DataFrame, qid: str = "qid", conv: str = "conv_id", q_turn: str = "q_turn",
                   turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(qid, history)``: the lines of a question's conversation before its turn.

    A question takes the finished segments before its own as they are, and single lines from its own
    only: at most ``SEGMENT_TURNS`` rows and one per segment, not one per earlier turn.
    """
    lines = _chat_lines(turns, conv, turn, role, text)
    asked = questions.select(F.col(qid).alias("_q"), F.col(conv).alias("_c"), F.col(q_turn).alias("_t"),
                             F.floor(F.col(q_turn) / SEGMENT_TURNS).alias("_own"))
    own = lines.join(asked, (F.col(conv) == F.col("_c")) & (F.col("_seg") == F.col("_own")) & (F.col(turn) < F.col("_t")))
    own = ordered_concat(own, ["_q", "_seg"], "_line", [turn], "_text")
    whole = _segments(lines, conv, turn).join(asked, (F.col(conv) == F.col("_c")) & (F.col("_seg") < F.col("_own")))
    parts = own.unionByName(whole.select("_q", "_seg", "_text"))
    return ordered_concat(parts, ["_q"], "_text", ["_seg"], "history").withColumnRenamed("_q", qid)


def rag_context(hits: DataFrame, qid: str = "qid", text: str = "text", rank: str = "rank",
                questions: DataFrame | None = None) -> DataFrame:
    """``- fact`` lines per question in rank order; the default text when nothing came back.

    When ``questions`` is given, every question appears, including those without hits.
    """
    lines = hits.select(qid, rank, F.concat(F.lit("- "), F.col(text)).alias("_line"))
    ctx = ordered_concat(lines, [qid], "_line", [rank], "context", sep="\\n")
    if questions is not None:
        ctx = questions.select(qid).join(ctx, qid, "left")
    return ctx.select(qid, F.coalesce("context", F.lit(NO_FACTS)).alias("context"))


# Fixed value: the chat prompt layout (context, history, question).  Its blank lines carry the
# indentation, except those around the first lines.
_GAP = "\n" + " " * 8 + "\n"
CHAT_PROMPT = """
        You are a Senior Business Intelligence chatbot.
        Answer the user's business question using ONLY the provided business facts from our data catalog.

        Rules:
        1. Base your answers strictly on the facts listed in the context.
        2. If the context does not contain the answer, say "I don't have that specific data in my current analysis, but I can help you analyze the dataset if you tell me what you're looking for."
        3. Do not make up any numbers or insights.
        4. Refer to the specific numbers (e.g. Sales, Profits, Discounts) in your response.

        Retrieved Business Facts (Context):
        {context}

        Conversation History:
        {history}

        User Question: {question}

        Business Answer:
        """.replace("\n\n", _GAP)

# The prompts of the root-cause, forecast and recommendation steps.
ROOT_CAUSE_PROMPT = """
        You are a Root Cause Analysis Agent.
        Analyze these underperforming areas in our sales dataset:

        Loss-making Sub-categories:
        {losses}

        Top Loss-making Products:
        {products}

        Correlation between Discount and Profit: {corr}

        Explain:
        1. Why these specific categories/products are losing money.
        2. The role discount is playing in these losses (e.g., discount erosion).
        3. Make it clear, concise, and formatted in markdown.
        """.replace("\n\n", _GAP)
FORECAST_PROMPT = """
    You are a Senior Business Analyst.
    Analyze the following sales forecast results:

    Forecasted Sales for the Next 6 Months:
    {forecast}

    Provide:
    1. Overall Revenue Trend (increasing, decreasing, stable).
    2. Best anticipated month and lowest anticipated month.
    3. Potential business risks indicated by the confidence intervals or historical data.
    4. Practical, high-level business insights.

    Format in clean markdown for an executive audience.
    """.replace("\n\n", "\n    \n")
RECOMMENDATION_PROMPT = """
    You are a Lead Business Consultant.
    Review the following business data, root cause explanation, and sales forecast insights:

    {summary}

    Forecast Insights:
    {insights}

    Provide:
    1. Executive Summary: Quick overview of state of the business.
    2. Priority Action Items: Clear, bulleted action items with assigned priorities (High, Medium, Low).
    3. Growth Opportunities: Where to invest or allocate capital based on profitable segments/regions.
    4. Risk Mitigation Strategies: How to fix the loss-making segments or pricing structures.
    5. Final Business Decision/Verdict.

    Format the response in clean, professional markdown.
    """.replace("\n\n", "\n    \n")


def prompt_table(questions: DataFrame, context: DataFrame, history: DataFrame | None = None,
                 qid: str = "qid", question: str = "question", conv: str = "conv_id") -> DataFrame:
    """One chat prompt per question: retrieved context + conversation history + question.

    ``questions`` has ``qid, question`` and optionally ``conv``; ``history`` has
    ``conv, history``.  Missing history is the empty string.
    """
    q = questions.join(context, qid, "left")
    if history is not None:
        q = q.join(history, conv, "left")
        hist = F.coalesce(F.col("history"), F.lit(""))
    else:
        hist = F.lit("")
    prompt = _fill(CHAT_PROMPT, {"context": F.coalesce(F.col("context"), F.lit(NO_FACTS)),
                                 "history": hist, "question": F.col(question)})
    return q.select(qid, prompt.alias("prompt"))


# The recommendation step's KPI block and the final report layout.
BUSINESS_SUMMARY = """
    Business KPIs:
    - Total Sales: {sales}
    - Total Profit: {profit}
    - Profit Margin: {margin}%
    - Average Discount: {discount}%
    """
ROOT_CAUSE_HEADER = "\nRoot Cause: Underperforming sub-categories show average discounts like:\n"
FINAL_REPORT = """# Executive Business Report

## 1. System Performance Overview
{summary}

## 2. Root Cause Analysis
{root_cause}

## 3. Sales Forecasting & Analysis
{forecast}

## 4. Strategic Recommendations & Action Plan
{recommendation}
"""


def root_cause_prompt(losses: DataFrame, products: DataFrame, corr: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One root-cause prompt per report key: ``keys, prompt``.

    ``losses`` and ``products`` are the loss-making sub-categories and the top loss products per key
    (few rows each), ``corr`` one row per key with ``corr_discount_profit``.
    """
    keys = list(keys)
    numbers = {"profit": money(F.round("profit", 4)), "sales": money(F.round("sales", 2)),
               "discount": fixed(F.round("discount", 6), 1)}
    sub = losses.select(*keys, "profit", "sub_category", _fill(LOSS_SUB_LINE, {"sub": F.col("sub_category"), **numbers}).alias("line"))
    prod = products.select(*keys, "profit", "sub_category", "product_name", _fill(LOSS_PRODUCT_LINE, {
        "product": F.col("product_name"), "sub": F.col("sub_category"), **numbers}).alias("line"))
    out = corr.join(ordered_concat(sub, keys, "line", ["profit", "sub_category"], "losses"), keys, "left")
    out = out.join(ordered_concat(prod, keys, "line", ["profit", "sub_category", "product_name"], "products"), keys, "left")
    c = F.col("corr_discount_profit")
    return out.select(*keys, _fill(ROOT_CAUSE_PROMPT, {
        "losses": F.coalesce("losses", F.lit("None")), "products": F.coalesce("products", F.lit("None")),
        "corr": F.when(F.isnan(c), F.lit("nan")).otherwise(fixed(F.round(c, 6), 4))}).alias("prompt"))


def forecast_prompt(forecast_text: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One forecast-explanation prompt per key from X3's text."""
    return forecast_text.select(*keys, _fill(FORECAST_PROMPT, {"forecast": F.col("forecast_text")}).alias("prompt"))


def recommendation_prompt(summary: DataFrame, insights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One recommendation prompt per key (X6): the business summary and the forecast insights."""
    keys = list(keys)
    both = summary.join(insights, keys, "left")
    return both.select(*keys, _fill(RECOMMENDATION_PROMPT, {
        "summary": F.col("summary"), "insights": F.coalesce("insights", F.lit(""))}).alias("prompt"))


def business_summary(overall: DataFrame, loss_subs: DataFrame | None, keys: Sequence[str] = ()) -> DataFrame:
    """The KPI block per report key, with the loss lines where the root-cause step ran."""
    keys = list(keys)
    summary = overall.select(*keys, _fill(BUSINESS_SUMMARY, {
        "sales": money(F.round("total_sales", 2)), "profit": money(F.round("total_profit", 4)),
        "margin": fixed(F.round("overall_margin", 6), 2),
        "discount": fixed(F.round(F.coalesce("avg_discount", F.lit(0.0)), 6), 2)})
        .alias("summary"))
    if loss_subs is None:
        return summary
    lines = loss_subs.select(*keys, "profit", "sub_category", _fill(REPORT_LOSS_LINE, {
        "sub": F.col("sub_category"), "profit": money(F.round("profit", 4)),
        "discount": fixed(F.round("discount", 6), 1)}).alias("line"))
    if keys:
        rc = ordered_concat(lines, keys, "line", ["profit", "sub_category"], "rc")
        summary = summary.join(rc, keys, "left")
    else:
        rc = lines.agg(F.expr("listagg(line, '') WITHIN GROUP (ORDER BY profit, sub_category)").alias("rc"))
        summary = side_by_side(summary, rc)
    return summary.select(*keys, F.concat("summary", F.lit(ROOT_CAUSE_HEADER), F.coalesce("rc", F.lit(""))).alias("summary"))


def final_report(overall: DataFrame, loss_subs: DataFrame | None, forecast_text: DataFrame | None,
                 root_cause_text: str = NO_DETAILS, recommendation_text: str = "",
                 keys: Sequence[str] = ()) -> DataFrame:
    """The executive report text, one row per report key.

    ``overall`` has A1's columns (per key), ``loss_subs`` the loss sub-categories (A7) per
    key or None when the root-cause stage did not run, ``forecast_text`` X3's text per key
    or None.  Parts are equi-joined on the keys (left joins), so a key without losses or
    without a forecast prints the default text instead of failing.  The two model-written
    sections are inputs.
    """
    keys = list(keys)
    summary = business_summary(overall, loss_subs, keys)
    if forecast_text is not None:
        ft = forecast_text.select(*keys, "forecast_text")
        summary = summary.join(ft, keys, "left") if keys else side_by_side(summary, ft)
        fc = F.coalesce("forecast_text", F.lit(""))
    else:
        fc = F.lit("")
    report = _fill(FINAL_REPORT, {"summary": F.col("summary"), "root_cause": F.lit(root_cause_text),
                                  "forecast": fc, "recommendation": F.lit(recommendation_text)})
    return summary.select(*keys, report.alias("report"))


def parse_plan(replies: DataFrame, text: str = "text") -> DataFrame:
    """Planner reply text -> plan.

    Strip whitespace, drop a leading ```` ```json ```` and a trailing ```` ``` ````, strip
    again, then keep the reply if it is a valid JSON array (of anything, as Python's
    ``json.loads`` + ``isinstance(list)``); anything else gives the full plan.  Elements
    that are not strings become their JSON text and never name a stage.  Parsing uses
    the VARIANT type and only runs on texts that look like an array.  Adds
    ``plan array<string>`` and ``plan_is_default boolean``.  (``NaN`` inside an array is
    valid for Python but not for strict JSON.)
    """
    s = py_strip(F.col(text))
    s1 = F.when(s.startswith("```json"), s.substr(F.lit(8), F.length(s))).otherwise(s)
    s2 = F.when(s1.endswith("```"), s1.substr(F.lit(1), F.length(s1) - 3)).otherwise(s1)
    body = py_strip(s2)
    v = F.try_parse_json(body)
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"),
                        lambda e: F.try_variant_get(e, "$", "string"))
    looks_like_array = body.startswith("[") & body.endswith("]")
    plan = F.when(looks_like_array, F.when(F.schema_of_variant(v).startswith("ARRAY"), items))
    full = F.array(*[F.lit(x) for x in STAGE_ORDER])
    return replies.withColumn("plan", F.coalesce(plan, full)) \
        .withColumn("plan_is_default", plan.isNull())


def resolve_plan(plans: DataFrame, plan: str = "plan") -> DataFrame:
    """Stages to run: those named in the plan, always in the fixed order."""
    order = F.array(*[F.lit(x) for x in STAGE_ORDER])
    # array_intersect keeps the first array's order and drops names not in it
    return plans.withColumn("stages", F.array_intersect(order, F.col(plan)))
