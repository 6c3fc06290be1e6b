"""Plain-language facts from the sales aggregates.

One scan of the sales table feeds one grouping-sets aggregate over the bounded grains
(with the discount/profit correlation folded in); that small result is checkpointed and
every fact family is a projection of it.  The top loss products come from their own
aggregate and a top-k, so the product grain is never written out.
Numbers are rounded past the data's own decimals before formatting, so the text does not
depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.functions.formats import fixed, money
from salescope.operators.kpi import GRAINS, kpi_grouping_sets, loss_products
from salescope.session import materialize

# Sentence templates of the fact families (numbers as formatted text).
OVERVIEW_TOTALS = ("Business Overview: The company has total sales of {sales} "
                   "and a total profit of {profit}.")
OVERVIEW_MARGIN = "Business Overview: The overall profit margin for the business is {margin}%."
REGION = ("Regional Analysis: Region '{region}' generated total sales of {sales} and a net "
          "profit of {profit} (Profit Margin: {margin}%).")
CATEGORY = ("Category Analysis: Category '{category}' generated sales of {sales} and profit of "
            "{profit} (Margin: {margin}%) with an average discount of {discount}%.")
SUBCATEGORY = ("Sub-category Analysis: In Category '{category}', the sub-category "
               "'{sub_category}' generated sales of {sales} and profit of {profit} "
               "(Margin: {margin}%) with an average discount of {discount}%.")
SEGMENT = ("Customer Segment Analysis: Segment '{segment}' generated sales of {sales} and "
           "profit of {profit} (Margin: {margin}%).")
ROOT_SUBCATEGORY = ("Root Cause: The sub-category '{sub_category}' is highly unprofitable, "
                    "generating a net loss of {profit} with a high average discount rate of "
                    "{discount}%. This indicates discount erosion.")
ROOT_PRODUCT = ("Root Cause: Product '{product_name}' (Sub-category '{sub_category}') is a top "
                "loss-maker, causing a net loss of {profit} on sales of {sales} with an average "
                "discount of {discount}%.")
# Our computed replacement for the reference's constant correlation sentence.
CORR_OVERALL = ("Root Cause Correlation: Across all sales, the correlation between discount "
                "and profit is {corr}.")
CORR_CATEGORY = ("Root Cause Correlation: In Category '{category}', the correlation between "
                 "discount and profit is {corr}.")

WORST_SUBCATEGORIES = 3
LOSS_PRODUCTS = 15


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Render a ``{name}`` template as a ``concat`` of literals and columns."""
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


def _number_texts() -> dict[str, Column]:
    return {
        "sales": money(F.round("sales", 2)),
        "profit": money(F.round("profit", 4)),
        "margin": fixed(F.round("margin", 6), 2),
        "discount": fixed(F.round("discount", 6), 2),
        "corr": F.when(F.isnan("corr_discount_profit"), F.lit("NaN"))
                 .otherwise(fixed(F.round("corr_discount_profit", 6), 4)),
        "region": F.col("region"), "category": F.col("category"),
        "sub_category": F.col("sub_category"), "segment": F.col("segment"),
        "product_name": F.col("product_name"),
    }


def _fact(family: int, fact_id: Column, text: Column) -> list[Column]:
    return [fact_id.alias("fact_id"), F.lit(family).alias("family"), text.alias("text")]


def facts(sales: DataFrame) -> DataFrame:
    """Fact sentences ``(fact_id string, family int, text string)`` for a sales table."""
    # Bounded grains (dimensions, not rows): one pass, materialised once, read by the
    # family branches.  The product grain is not materialised -- it has one row per
    # product -- and only its top-k losses are needed, taken by a separate top-k.
    bounded = {k: v for k, v in GRAINS.items() if k != "product"}
    g = materialize(kpi_grouping_sets(sales, grains=bounded, with_corr=True))
    v = _number_texts()
    grain = F.col("grain")

    overview = g.where(grain == "overall").select(F.explode(F.array(
        F.struct(F.lit("overview:totals").alias("fact_id"), _fill(OVERVIEW_TOTALS, v).alias("text")),
        F.struct(F.lit("overview:margin").alias("fact_id"), _fill(OVERVIEW_MARGIN, v).alias("text")),
    )).alias("f")).select(F.col("f.fact_id").alias("fact_id"), F.lit(1).alias("family"),
                          F.col("f.text").alias("text"))

    per_grain = g.where(grain.isin("region", "category", "subcategory", "segment")).select(
        F.when(grain == "region", F.concat(F.lit("region:"), "region"))
         .when(grain == "category", F.concat(F.lit("category:"), "category"))
         .when(grain == "subcategory", F.concat(F.lit("subcategory:"), "category", F.lit("/"),
                                                "sub_category"))
         .otherwise(F.concat(F.lit("segment:"), "segment")).alias("fact_id"),
        F.when(grain == "region", 2).when(grain == "category", 3)
         .when(grain == "subcategory", 4).otherwise(5).alias("family"),
        F.when(grain == "region", _fill(REGION, v))
         .when(grain == "category", _fill(CATEGORY, v))
         .when(grain == "subcategory", _fill(SUBCATEGORY, v))
         .otherwise(_fill(SEGMENT, v)).alias("text"))

    worst = (g.where((grain == "subcategory") & (F.col("profit") < 0))
             .orderBy("profit", "category", "sub_category").limit(WORST_SUBCATEGORIES)
             .select(*_fact(6, F.concat(F.lit("root_subcategory:"), "category", F.lit("/"),
                                        "sub_category"), _fill(ROOT_SUBCATEGORY, v))))
    products = (loss_products(sales, k=LOSS_PRODUCTS)
                .select(*_fact(6, F.concat(F.lit("root_product:"), "sub_category", F.lit("/"),
                                           "product_name"), _fill(ROOT_PRODUCT, v))))
    corr = g.where(grain.isin("overall", "category")).select(*_fact(
        7, F.when(grain == "overall", F.lit("correlation:overall"))
            .otherwise(F.concat(F.lit("correlation:"), "category")),
        F.when(grain == "overall", _fill(CORR_OVERALL, v)).otherwise(_fill(CORR_CATEGORY, v))))
    return overview.unionByName(per_grain).unionByName(worst).unionByName(products) \
        .unionByName(corr)
