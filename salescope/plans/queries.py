"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (or data Spark derives from them) in full; no
row caps, id subsets or prefixes.  A ``limit`` appears only where it is the feature
(top-k reports, preview).  Output columns carry the same names as the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salescope.functions.cleaning import na_to_null, parse_mixed_date, to_number
from salescope.functions.formats import fixed, iso_date, money
from salescope.functions.metrics import pearson
from salescope.operators import facts, forecast_model, grid, kpi, pruned, series, text, vectors
from salescope.plans import analysis, retrieval
from salescope.plans.present import present
from salescope.session import materialize, scratch_path
from salescope.sources import catalog
from salescope.sources.csv import clean_sales, read_sales_csv
from salescope.sources.feedback import append_feedback, read_feedback
from salescope.sources.fixture import landed_sales, mixed_csv_path, sales_csv_path, table
from salescope.sources.landing import land_dataset, read_dataset, write_csv_file, write_reports
from salescope.streaming.feedback import start_feedback_quarantine, start_feedback_sink
from salescope.streaming.landing import start_landing_kpis

Query = Callable[[SparkSession, str], DataFrame]


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed_sales(spark, sf_dir)


def q_kpi_overall(spark, sf_dir):
    return present(kpi.kpi_overall(_sales(spark, sf_dir)))


def q_kpi_region(spark, sf_dir):
    return present(kpi.kpi_region(_sales(spark, sf_dir)))


def q_kpi_category(spark, sf_dir):
    return present(kpi.kpi_category(_sales(spark, sf_dir)))


def q_kpi_subcategory(spark, sf_dir):
    return present(kpi.kpi_subcategory(_sales(spark, sf_dir)))


def q_kpi_segment(spark, sf_dir):
    return present(kpi.kpi_segment(_sales(spark, sf_dir)))


def q_kpi_grouping_sets(spark, sf_dir):
    return present(kpi.kpi_grouping_sets(_sales(spark, sf_dir)))


def q_loss_subcategories(spark, sf_dir):
    return present(kpi.loss_subcategories(_sales(spark, sf_dir)))


def q_loss_products(spark, sf_dir):
    return present(kpi.loss_products(_sales(spark, sf_dir), k=10))


def q_worst_subcategories(spark, sf_dir):
    return present(kpi.worst_subcategories(_sales(spark, sf_dir), k=3))


def q_discount_profit_corr(spark, sf_dir):
    return present(kpi.discount_profit_corr(_sales(spark, sf_dir)))


def q_best_region(spark, sf_dir):
    return present(kpi.best_region(_sales(spark, sf_dir)))


def q_best_category(spark, sf_dir):
    return present(kpi.best_category(_sales(spark, sf_dir)))


# Series keys used for the many-series queries: 25 sub-categories x 5 segments.
SERIES_KEYS = ["sub_category", "segment"]


def _monthly(spark, sf_dir, keys=()):
    return series.monthly_series(_sales(spark, sf_dir), keys=keys)


def _with_iso(df, *cols):
    return df.select(*[iso_date(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def q_monthly_sales(spark, sf_dir):
    return present(_with_iso(_monthly(spark, sf_dir), "ds"))


def q_monthly_gapfill(spark, sf_dir):
    return present(_with_iso(_monthly(spark, sf_dir, SERIES_KEYS), "ds"))


def q_history_12m(spark, sf_dir):
    return present(_with_iso(series.last_n(_monthly(spark, sf_dir), 12), "ds"))


def q_forecast_trend_season(spark, sf_dir):
    return present(_with_iso(series.forecast_trend_season(_monthly(spark, sf_dir)), "ds"))


def q_forecast_fitted(spark, sf_dir):
    return present(_with_iso(series.forecast_fitted(_monthly(spark, sf_dir)), "ds"))


def q_forecast_summary(spark, sf_dir):
    model = series.trend_season_model(_monthly(spark, sf_dir))
    summ = series.forecast_summary(series.forecast_trend_season(None, model=model), model[0])
    summ = summ.select(iso_date("best_month").alias("best_month"),
                       F.round("best_yhat", 2).alias("best_yhat"),
                       iso_date("worst_month").alias("worst_month"),
                       F.round("worst_yhat", 2).alias("worst_yhat"), "direction", "slope")
    return present(summ)


def q_forecast_fourier(spark, sf_dir):
    return present(_with_iso(
        forecast_model.forecast_fourier(_monthly(spark, sf_dir, SERIES_KEYS), SERIES_KEYS), "ds"))


def q_facts(spark, sf_dir):
    return facts.facts(_sales(spark, sf_dir))


def q_loss_summary(spark, sf_dir):
    sales = _sales(spark, sf_dir)
    return text.loss_summary(kpi.loss_subcategories(sales, sort=False), kpi.loss_products(sales, k=10))


def q_forecast_lines(spark, sf_dir):
    return text.forecast_lines(series.forecast_trend_season(_monthly(spark, sf_dir)))


def q_chat_history(spark, sf_dir):
    return text.chat_history(table(spark, sf_dir, "conversations"))


def q_final_report(spark, sf_dir):
    return analysis.final_reports(_sales(spark, sf_dir))


def q_final_report_by_region(spark, sf_dir):
    return analysis.final_reports(_sales(spark, sf_dir), ["region"])


def _assistant_plans(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return text.parse_plan(conv.select("conv_id", "turn", "text"))


def q_parse_plan(spark, sf_dir):
    return _assistant_plans(spark, sf_dir).select(
        "conv_id", "turn", F.array_join("plan", ",").alias("plan"), "plan_is_default")


def q_resolve_plan(spark, sf_dir):
    return text.resolve_plan(_assistant_plans(spark, sf_dir)).select(
        "conv_id", "turn", F.array_join("stages", ",").alias("stages"))


# Retrieval settings of the reference: k = 5 facts per chat question.
RAG_K = 5
SEARCH_K = 5


def q_embed_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return present(vectors.embed_hash(docs, "doc_id", "text"))


def q_knn_embeddings(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    cent = vectors.label_centroids(emb).select(F.col("label").alias("qid"), "vec")
    vecs = emb.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    hits = vectors.knn_dense(cent, vecs, k=SEARCH_K)
    return present(hits.select(F.col("qid").alias("label"), F.col("rank").cast("bigint"),
                               F.col("id").alias("vec_id"), "d2"))


def q_text_search(spark, sf_dir):
    qs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"),
                                                  F.col("text").alias("question"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = vectors.text_search(qs, docs, k=SEARCH_K)
    return present(hits.select(F.col("qid").alias("item_id"), F.col("rank").cast("bigint"),
                               F.col("id").alias("doc_id"), "d2", "text"))


def chat_questions(conv: DataFrame) -> DataFrame:
    """Every user turn is a question: ``qid`` (conversation and turn), conv_id, q_turn, question."""
    return conv.where(F.col("role") == "user").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"),
        "conv_id", F.col("turn").alias("q_turn"), F.col("text").alias("question"))


def _rag(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    qs = chat_questions(conv)
    # facts are few (bounded by the dimensions) and read several times below
    fct = materialize(facts.facts(_sales(spark, sf_dir)).select(F.col("fact_id").alias("id"), "text"))
    hits = vectors.text_search(qs.select("qid", "question"), fct, k=RAG_K)
    return conv, qs, text.rag_context(hits, qid="qid", questions=qs.select("qid"))


def q_rag_context(spark, sf_dir):
    _, qs, ctx = _rag(spark, sf_dir)
    return qs.select("qid", "conv_id", "q_turn").join(ctx, "qid").select("conv_id", "q_turn", "context")


def q_prompt_table(spark, sf_dir):
    conv, qs, ctx = _rag(spark, sf_dir)
    # a question's history is every turn before it
    prompts = text.prompt_table(qs, ctx, text.history_before(conv, qs), qid="qid", conv="qid")
    return qs.select("qid", "conv_id", "q_turn").join(prompts, "qid").select("conv_id", "q_turn", "prompt")


REPORT_KEYS = ["region"]


def _region_losses(sales):
    by_sub = kpi.kpi_by(sales, [*REPORT_KEYS, "sub_category"], discount="discount").where(F.col("profit") < 0)
    return by_sub.select(*REPORT_KEYS, "sub_category", "profit", "sales", "discount")


def q_prompt_root_cause(spark, sf_dir):
    sales = _sales(spark, sf_dir)
    products = kpi.kpi_by(sales, [*REPORT_KEYS, "sub_category", "product_name"], discount="discount").where(F.col("profit") < 0)
    worst = Window.partitionBy(*REPORT_KEYS).orderBy("profit", "sub_category", "product_name")
    top = products.withColumn("_rn", F.row_number().over(worst)).where(F.col("_rn") <= 5)
    corr = sales.where(F.col("region").isNotNull()).groupBy(*REPORT_KEYS).agg(
        pearson("discount", "profit").alias("corr_discount_profit"))
    return text.root_cause_prompt(_region_losses(sales), top, corr, REPORT_KEYS)


def _region_forecast(spark, sf_dir):
    return text.forecast_lines(series.forecast_trend_season(_monthly(spark, sf_dir, REPORT_KEYS), REPORT_KEYS), REPORT_KEYS)


def q_prompt_forecast(spark, sf_dir):
    return text.forecast_prompt(_region_forecast(spark, sf_dir), REPORT_KEYS)


def q_prompt_recommendation(spark, sf_dir):
    sales = _sales(spark, sf_dir)
    overall = kpi.kpi_by(sales, REPORT_KEYS, discount="discount").select(
        *REPORT_KEYS, F.col("sales").alias("total_sales"), F.col("profit").alias("total_profit"),
        F.col("margin").alias("overall_margin"), F.col("discount").alias("avg_discount"))
    # the forecast lines stand in for the model-written insights
    insights = _region_forecast(spark, sf_dir).withColumnRenamed("forecast_text", "insights")
    return text.recommendation_prompt(text.business_summary(overall, _region_losses(sales), REPORT_KEYS), insights, REPORT_KEYS)


def q_stream_landing_kpi(spark, sf_dir):
    """CSV files of three column orders, landed as a stream; the per-file sums added up per region."""
    out, progress = scratch_path(spark, "stream-kpis"), scratch_path(spark, "stream-progress")
    start_landing_kpis(spark, mixed_csv_path(spark, sf_dir), progress, out, recursive=True).awaitTermination()
    return present(spark.read.parquet(out).groupBy("region").agg(F.sum("sales").alias("sales"), F.sum("profit").alias("profit")))


def q_csv_mixed_layouts(spark, sf_dir):
    folders = [f"{mixed_csv_path(spark, sf_dir)}/layout{i}" for i in range(3)]
    return present(kpi.kpi_category(clean_sales(read_sales_csv(spark, folders))))


def q_land_dataset(spark, sf_dir):
    """Every region landed as a dataset, one of them landed again with the sales of two; all read back and summed."""
    root, sales = scratch_path(spark, "datasets"), _sales(spark, sf_dir)
    names = [r["region"] for r in sales.select("region").distinct().orderBy("region").collect()]
    for name in names:
        land_dataset(sales.where(F.col("region") == name), root, f"{name}.csv")
    land_dataset(sales.where(F.col("region").isin(names[0], names[-1])), root, f"{names[0]}.csv")
    out = [kpi.kpi_region(read_dataset(spark, root, f"{n}.csv")).withColumn("dataset", F.lit(f"{n}.csv")) for n in names]
    return present(reduce(DataFrame.unionByName, out))


def q_feedback(spark, sf_dir):
    """Conversation turns appended as feedback by two writers, streamed into a table and read back."""
    folder, out, progress = (scratch_path(spark, n) for n in ("feedback", "feedback-table", "feedback-progress"))
    conv = table(spark, sf_dir, "conversations")
    rows = conv.select((F.col("turn") % 5 + 1).alias("rating"), F.col("role").alias("category"), F.col("text").alias("comment"))
    append_feedback(rows.where(F.col("category") == "user"), folder)
    append_feedback(rows.where(F.col("category") != "user"), folder)
    start_feedback_sink(spark, folder, out, progress).awaitTermination()
    stored = read_feedback(spark, folder).select("rating", "category", "comment", F.lit("files").alias("via")).unionByName(
        spark.read.parquet(out).select("rating", "category", "comment", F.lit("stream").alias("via")))
    return stored.groupBy("via", "category", "rating").agg(F.count(F.lit(1)).alias("n_rows"))


def q_index_search(spark, sf_dir):
    """An index of all documents, built once, and searched for every benchmark item (k = 2)."""
    path = scratch_path(spark, "text-index")
    retrieval.build_text_index(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), path)
    qs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    hits = retrieval.search_index(spark, path, qs, k=2)
    return present(hits.select(F.col("qid").alias("item_id"), F.col("rank").cast("bigint"), F.col("id").alias("doc_id"), "d2", "text"))


class LetterShares:
    """A deterministic encoder: the share of each letter a to z among a text's characters."""

    def encode(self, texts):
        import numpy as np
        return np.array([[t.count(c) / max(len(t), 1) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], dtype=np.float32)


def q_dense_index_search(spark, sf_dir):
    """An index of all documents by a plugged-in encoder, searched for every benchmark item (k = 2)."""
    path = scratch_path(spark, "dense-index")
    retrieval.build_dense_index(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), path, LetterShares, 26)
    qs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    hits = retrieval.search_dense_index(spark, path, qs, LetterShares, 26, k=2)
    return present(hits.select(F.col("qid").alias("item_id"), F.col("rank").cast("bigint"), F.col("id").alias("doc_id"), "d2", "text"))


def q_knn_pruned(spark, sf_dir):
    """Every vector's three nearest among all, by blocks of neighbours and bounds."""
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    hits = pruned.knn_dense_pruned(emb.withColumnRenamed("id", "qid"), emb, k=3, block_rows=256)
    return present(hits.select(F.col("qid").alias("vec_id"), F.col("rank").cast("bigint"), F.col("id").alias("near_id"), "d2"))


def q_text_search_pruned(spark, sf_dir):
    """As ``text_search``, by blocks of neighbours and bucket maxima."""
    qs = vectors.sparse_embed(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), "qid", "text")
    docs = vectors.sparse_embed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id", "text")
    hits = pruned.search_sparse_pruned(qs, docs, k=SEARCH_K, block_rows=256)
    return present(hits.select(F.col("qid").alias("item_id"), F.col("rank").cast("bigint"), F.col("id").alias("doc_id"), "d2"))


def q_feedback_quarantine(spark, sf_dir):
    """Turns as feedback lines, every third cut short: entries and malformed lines land in two tables."""
    folder, out, bad, progress = (scratch_path(spark, n) for n in ("lines", "entries", "malformed", "lines-progress"))
    conv = table(spark, sf_dir, "conversations")
    whole = F.to_json(F.struct((F.col("turn") % 5 + 1).alias("rating"), F.col("role").alias("category"), F.col("text").alias("comment")))
    line = F.when(F.col("turn") % 3 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    conv.select(line.alias("value")).write.text(folder)
    start_feedback_quarantine(spark, folder, out, bad, progress).awaitTermination()
    good = spark.read.parquet(out).select(F.lit("entry").alias("kind"), "category", "rating", F.length("comment").alias("chars"))
    rest = spark.read.parquet(bad).select(F.lit("malformed").alias("kind"), F.lit(None).cast("string").alias("category"),
                                          F.lit(None).cast("int").alias("rating"), F.lit(None).cast("int").alias("chars"))
    return (good.unionByName(rest).groupBy("kind", F.coalesce("category", F.lit("-")).alias("category"), F.coalesce("rating", F.lit(0)).alias("rating"))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")))


def q_report_sink(spark, sf_dir):
    """The reports per region written as text files and read back line by line: how often each line stands in each."""
    path = scratch_path(spark, "reports")
    write_reports(analysis.final_reports(_sales(spark, sf_dir), REPORT_KEYS).withColumnRenamed("region", "report_key"), path)
    return spark.read.text(path).groupBy("report_key", F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n_lines"))


def q_dataset_catalog(spark, sf_dir):
    """One CSV file per region, named after it, beside a file of another kind; the last one is selected.

    A row is a file's region, its rank by size, its number of bytes, whether it is active, and where the
    choice comes from: the selection, and the first name once the selection names no file.
    """
    root, config = scratch_path(spark, "catalog"), scratch_path(spark, "active")
    sales = _sales(spark, sf_dir).select("region", F.concat_ws(",", "category", "product_name").alias("line"))
    names = [r["region"] for r in sales.select("region").distinct().orderBy("region").collect()]
    for name in names:
        write_csv_file(sales.where(F.col("region") == name).select("line"), f"{root}/{name}.csv")
    write_csv_file(sales.where(F.col("region") == names[0]).select("line"), f"{root}/notes.txt")
    files = catalog.catalog_dedup(catalog.dataset_catalog(spark, root))
    catalog.select_dataset(spark, files, f"{names[-1]}.csv", config)
    chosen = catalog.active_dataset(files, catalog.read_selection(spark, config), None)
    other = catalog.active_dataset(files, spark.createDataFrame([("gone.csv",)], "active_filename string"), None)
    flagged = catalog.with_active(files, chosen).withColumn("__one", F.lit(1))
    both = flagged.join(chosen.select(F.lit(1).alias("__one"), F.col("source").alias("source")), "__one").join(
        other.select(F.lit(1).alias("__one"), F.concat_ws(":", "source", "active_filename").alias("without")), "__one")
    recent = (F.col("uploaded_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}$")
              & F.to_timestamp("uploaded_at").between(F.current_timestamp() - F.expr("INTERVAL 1 DAY"), F.current_timestamp() + F.expr("INTERVAL 1 DAY")))
    return both.select("filename", F.col("size").alias("bytes"), "active", "source", "without", recent.alias("recent"))


# Replies a planner may give, picked by conversation and turn; the rest are the turns themselves.
def _planner_replies(conv):
    n = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7))
    hard = (F.when(n == 0, F.lit(' ```json\n["analysis", "forecast"]\n``` ')).when(n == 1, F.concat(F.lit('["forecast", "'), F.col("role"), F.lit('", 3, null]')))
            .when(n == 2, F.lit('["analysis",')).when(n == 3, F.lit('{"plan": ["analysis"]}'))
            .when(n == 4, F.lit('\n["recommendation","analysis","bogus"]\n')).when(n == 5, F.lit("```json\n[]\n```")))
    return conv.withColumn("text", F.coalesce(hard, F.col("text")))


def _hard_plans(spark, sf_dir):
    return text.parse_plan(_planner_replies(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def q_parse_plan_hard(spark, sf_dir):
    return _hard_plans(spark, sf_dir).select("conv_id", "turn", F.array_join("plan", ",").alias("plan"), "plan_is_default")


def q_resolve_plan_hard(spark, sf_dir):
    return text.resolve_plan(_hard_plans(spark, sf_dir)).select("conv_id", "turn", F.array_join("stages", ",").alias("stages"))


def q_na_tokens_hard(spark, sf_dir):
    """Every order comment cell replaced, by its key, by a token or by something that only looks like one."""
    cells = F.array(*[F.lit(x) for x in HARD_CELLS])
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(cells, (F.col("o_orderkey") % len(HARD_CELLS) + 1).cast("int")).alias("cell"))
    return o.select("o_orderkey", na_to_null("cell").alias("cell"))


HARD_CELLS = ["N/A", "NA", "-", "null", "Null", " NA", "", "nan", "NONE", "None", "#N/A", "0", "1.#IND", "n/a "]


def q_coerce_numeric_hard(spark, sf_dir):
    """Line prices as text in eight dresses, by key: plain, currency, thousands, padded, inf, nan, empty, exponent."""
    price = F.format_string("%.2f", F.col("l_extendedprice"))
    n = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(8))
    cell = (F.when(n == 1, F.concat(F.lit("$"), price)).when(n == 2, F.lit("1,234")).when(n == 3, F.concat(F.lit("  "), price, F.lit(" ")))
            .when(n == 4, F.lit("-inf")).when(n == 5, F.lit("NaN")).when(n == 6, F.lit("")).when(n == 7, F.concat(price, F.lit("e1"))).otherwise(price))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", to_number(cell).alias("v"))
    return li.select("l_orderkey", "l_linenumber", F.round("v", 1).alias("v"))


def q_parse_dates_hard(spark, sf_dir):
    """Order dates written in twelve layouts, by key, must all come back."""
    d, n = F.col("o_orderdate"), F.pmod(F.col("o_orderkey"), F.lit(12))
    layouts = ["M/d/yyyy", "yyyy/MM/dd", "dd-MMM-yyyy", "MMM d, yyyy", "MM-dd-yyyy", "M/d/yy", "yyyyMMdd", "yyyy-MM-dd",
               "M/d/yyyy H:mm", "yyyy-MM-dd'T'HH:mm:ss", "MMMM d, yyyy", "d MMM yyyy"]
    cell = F.coalesce(*[F.when(n == i, F.date_format(d, f)) for i, f in enumerate(layouts)])
    o = table(spark, sf_dir, "orders").select("o_orderkey", cell.alias("cell"))
    return o.select("o_orderkey", F.date_format(parse_mixed_date("cell"), "yyyy-MM-dd").alias("d"))


def q_nonblank_texts_hard(spark, sf_dir):
    """Document texts padded or blanked by id: no-break and thin spaces, tabs, line ends."""
    n = F.pmod(F.col("doc_id"), F.lit(4))
    t = (F.when(n == 1, F.lit(" \t\u00a0\n")).when(n == 2, F.concat(F.lit("\u2009 \u3000"), F.col("text"), F.lit("\r\n\x1c")))
         .otherwise(F.col("text")))
    return grid.nonblank_texts(table(spark, sf_dir, "documents").select("doc_id", t.alias("text")))


def q_grid_sort_all(spark, sf_dir):
    """The whole table written sorted and read back: every row with its place."""
    path = scratch_path(spark, "sorted")
    grid.write_sorted(_grid_sales(spark, sf_dir), "sales", path, descending=False)
    return present(spark.read.parquet(path))


def q_preview_head(spark, sf_dir):
    return grid.preview_file(spark, f"{sf_dir.rstrip('/')}/orders.parquet", 5)


def _csv_sales(spark, sf_dir):
    return clean_sales(read_sales_csv(spark, sales_csv_path(spark, sf_dir)))


def q_csv_kpi_category(spark, sf_dir):
    return present(kpi.kpi_category(_csv_sales(spark, sf_dir)))


def q_csv_monthly_sales(spark, sf_dir):
    return present(_with_iso(series.monthly_series(_csv_sales(spark, sf_dir)), "ds"))


def q_coerce_numeric(spark, sf_dir):
    """Cleaned numbers of every CSV row (S4): must equal the star join's values."""
    c = _csv_sales(spark, sf_dir)
    return present(c.select("region", "category", "sub_category", "segment", "product_name",
                            "sales", "discount", "profit"))


def q_parse_dates(spark, sf_dir):
    """Rows per parsed order date (S5) from the month-first CSV text."""
    c = _csv_sales(spark, sf_dir)
    return c.groupBy(F.date_format("order_date", "yyyy-MM-dd").alias("order_date")) \
        .agg(F.count(F.lit(1)).alias("n_rows"))


def q_na_tokens(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", na_to_null("role").alias("role"),
                       na_to_null("text").alias("text"))


def q_format_money_pct(spark, sf_dir):
    sub = kpi.kpi_subcategory(_sales(spark, sf_dir))
    return sub.select("category", "sub_category",
                      money(F.round("sales", 2)).alias("sales_text"),
                      money(F.round("profit", 4)).alias("profit_text"),
                      fixed(F.round("margin", 6), 2).alias("margin_text"),
                      fixed(F.round("discount", 6), 1).alias("discount_text"))


def q_catalog_dedup(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    first = catalog.first_per_key(ev, ["user_id"], ["ts", "event_id"])
    return first.select("user_id", "event_id",
                        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                        "event_type", "value")


def _grid_sales(spark, sf_dir):
    s = _sales(spark, sf_dir)
    return s.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


def q_preview(spark, sf_dir):
    return grid.preview_file(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet")


def q_nonblank_texts(spark, sf_dir):
    return grid.nonblank_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


# Fixed grid parameters used by the registered grid queries.
GRID_FILTER = {"region": "EUROPE", "category": "PROMO"}
GRID_KEYWORD = "Plate"


def q_grid_filter(spark, sf_dir):
    return present(grid.grid_filter(_grid_sales(spark, sf_dir), **GRID_FILTER))


def q_grid_search(spark, sf_dir):
    return present(grid.grid_search(_grid_sales(spark, sf_dir), GRID_KEYWORD))


def q_grid_sort(spark, sf_dir):
    return present(grid.grid_sort(_grid_sales(spark, sf_dir), "sales", descending=True, n=100))


def q_results_json(spark, sf_dir):
    return analysis.results_json(_sales(spark, sf_dir))


RESULT_SCHEMA = """overall_margin double, regional_analysis array<struct<region string, sales double, profit double>>,
    category_analysis array<struct<category string, sales double, profit double>>,
    subcategory_analysis array<struct<category string, subcategory string, sales double, profit double>>,
    loss_subcategories array<struct<sub_category string, sales double, profit double>>,
    loss_products array<struct<sub_category string, product_name string, sales double, profit double>>,
    predictions array<struct<date string, forecast double>>, history array<struct<date string, sales double>>"""


def q_results_json_rows(spark, sf_dir):
    """The nested JSON results parsed back into rows, with each record's place in its list."""
    parsed = analysis.results_json(_sales(spark, sf_dir)).select(F.from_json("json", RESULT_SCHEMA).alias("r")).select("r.*")
    lists = [("regional_analysis", ["region"], "sales", "profit"), ("category_analysis", ["category"], "sales", "profit"),
             ("subcategory_analysis", ["category", "subcategory"], "sales", "profit"),
             ("loss_subcategories", ["sub_category"], "sales", "profit"),
             ("loss_products", ["sub_category", "product_name"], "sales", "profit"),
             ("predictions", ["date"], "forecast", None), ("history", ["date"], "sales", None)]
    out = None
    for name, keys, a, b in lists:
        e = parsed.select(F.posexplode(name).alias("at", "x"))
        rows = e.select(F.lit(name).alias("part"), F.col("at").cast("bigint").alias("at"),
                        F.concat_ws("/", *[F.col(f"x.{k}") for k in keys]).alias("name"), F.round(f"x.{a}", 2).alias("a"),
                        (F.round(f"x.{b}", 2) if b else F.lit(None).cast("double")).alias("b"))
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES: dict[str, Query] = {
    "kpi_overall": q_kpi_overall,
    "kpi_region": q_kpi_region,
    "kpi_category": q_kpi_category,
    "kpi_subcategory": q_kpi_subcategory,
    "kpi_segment": q_kpi_segment,
    "kpi_grouping_sets": q_kpi_grouping_sets,
    "loss_subcategories": q_loss_subcategories,
    "loss_products": q_loss_products,
    "worst_subcategories": q_worst_subcategories,
    "discount_profit_corr": q_discount_profit_corr,
    "best_region": q_best_region,
    "best_category": q_best_category,
    "monthly_sales": q_monthly_sales,
    "monthly_gapfill": q_monthly_gapfill,
    "history_12m": q_history_12m,
    "forecast_trend_season": q_forecast_trend_season,
    "forecast_fitted": q_forecast_fitted,
    "forecast_summary": q_forecast_summary,
    "forecast_fourier": q_forecast_fourier,
    "facts": q_facts,
    "loss_summary": q_loss_summary,
    "forecast_lines": q_forecast_lines,
    "chat_history": q_chat_history,
    "final_report": q_final_report,
    "final_report_by_region": q_final_report_by_region,
    "parse_plan": q_parse_plan,
    "resolve_plan": q_resolve_plan,
    "embed_hash": q_embed_hash,
    "knn_embeddings": q_knn_embeddings,
    "text_search": q_text_search,
    "rag_context": q_rag_context,
    "prompt_table": q_prompt_table,
    "csv_kpi_category": q_csv_kpi_category,
    "csv_monthly_sales": q_csv_monthly_sales,
    "coerce_numeric": q_coerce_numeric,
    "parse_dates": q_parse_dates,
    "na_tokens": q_na_tokens,
    "format_money_pct": q_format_money_pct,
    "catalog_dedup": q_catalog_dedup,
    "preview": q_preview,
    "nonblank_texts": q_nonblank_texts,
    "grid_filter": q_grid_filter,
    "grid_search": q_grid_search,
    "grid_sort": q_grid_sort,
    "results_json": q_results_json,
    "results_json_rows": q_results_json_rows,
    "prompt_root_cause": q_prompt_root_cause,
    "prompt_forecast": q_prompt_forecast,
    "prompt_recommendation": q_prompt_recommendation,
    "stream_landing_kpi": q_stream_landing_kpi,
    "csv_mixed_layouts": q_csv_mixed_layouts,
    "land_dataset": q_land_dataset,
    "feedback": q_feedback,
    "index_search": q_index_search,
    "report_sink": q_report_sink,
    "dataset_catalog": q_dataset_catalog,
    "parse_plan_hard": q_parse_plan_hard,
    "resolve_plan_hard": q_resolve_plan_hard,
    "na_tokens_hard": q_na_tokens_hard,
    "coerce_numeric_hard": q_coerce_numeric_hard,
    "parse_dates_hard": q_parse_dates_hard,
    "nonblank_texts_hard": q_nonblank_texts_hard,
    "grid_sort_all": q_grid_sort_all,
    "dense_index_search": q_dense_index_search,
    "knn_pruned": q_knn_pruned,
    "text_search_pruned": q_text_search_pruned,
    "feedback_quarantine": q_feedback_quarantine,
    "preview_head": q_preview_head,
}
