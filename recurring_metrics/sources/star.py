"""Adapter: the sample star schema (orders, lineitem, events, ...) as raw billing tables.

Orders become subscriptions and sales opportunities, line items become billed
revenue, events become usage and support tickets. Every rule is deterministic.
Keys stay 64-bit integers; nothing downstream depends on their type.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurring_metrics.operators.conform import conform_all
from recurring_metrics.sources.tables import LazyTables

MONEY = "decimal(12,2)"

# Fixed values of the adapter.
STAGES = (
    ("Prospecting", "0.10"),
    ("Qualification", "0.25"),
    ("Needs Analysis", "0.40"),
    ("Proposal", "0.60"),
    ("Negotiation", "0.80"),
    ("Closed Won", "1.00"),
    ("Closed Lost", "0.00"),
)
PRIORITIES = ("Low", "Medium", "High", "Urgent")
CATEGORIES = (
    "Billing", "Integration", "Performance", "Access", "Data", "Onboarding", "Other",
)


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the sample schema."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _pick(values: tuple[str, ...], key: Column) -> Column:
    position = F.pmod(key, F.lit(len(values))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), position)


def customers(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation = source(spark, folder, "customer"), source(spark, folder, "nation")
    region = source(spark, folder, "region")
    acquired = (
        source(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.min(F.col("o_orderdate").cast("date")).alias("acquisition_date"))
    )
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(acquired, "c_custkey", "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.concat_ws(" - ", "n_name", "r_name").alias("industryregion"),
            F.col("c_mktsegment").alias("customer_segment"),
            "acquisition_date",
        )
    )


def dates(spark: SparkSession, folder: str) -> DataFrame:
    """The calendar of the days with an order."""
    days = source(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return days.select(
        "date", F.month("date").alias("month"), F.quarter("date").alias("quarter"), F.year("date").alias("year")
    )


def plans(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    tier = (
        F.when(size <= 12, "Starter")
        .when(size <= 25, "Professional")
        .when(size <= 38, "Business")
        .otherwise("Enterprise")
    )
    return source(spark, folder, "part").select(
        F.col("p_partkey").alias("plan_id"),
        F.col("p_brand").alias("product_id"),
        F.concat_ws(" - ", F.col("p_type"), tier).alias("plan_name"),
        F.when(F.col("p_partkey") % 2 == 0, "Monthly")
        .otherwise("Annual")
        .alias("billing_frequency"),
        F.col("p_retailprice").cast(MONEY).alias("price"),
    )


def _order_terms(orders: DataFrame) -> DataFrame:
    """Subscription terms that need no other table."""
    key = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("date")
    end = F.when(key % 16 != 0, F.date_add(start, (key % 700 + 30).cast("int")))
    mrr = F.col("o_totalprice").cast(MONEY)
    return orders.select(
        key.alias("subscription_id"),
        F.col("o_custkey").alias("customer_id"),
        start.alias("start_date"),
        end.alias("end_date"),
        F.coalesce(end, F.date_add(start, 365)).alias("renewal_date"),
        F.when(end.isNull(), "Active").otherwise("Churned").alias("status"),
        mrr.alias("mrr"),
        (mrr * 12).cast(MONEY).alias("arr"),
        F.col("o_orderpriority").alias("priority"),
    )


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    plan_of_order = (
        source(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("subscription_id"))
        .agg(F.min("l_partkey").alias("plan_id"))
    )
    terms = _order_terms(source(spark, folder, "orders"))
    return terms.join(plan_of_order, "subscription_id", "left").select(
        "subscription_id", "customer_id", "plan_id", "start_date", "end_date",
        "renewal_date", "status", "mrr", "arr",
    )


def revenue(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item, its number within the order in its id; an order's first ship month bills as 'New'.

    Amounts are made before the join, so only those that a query reads are moved. The line items are
    read and moved once: the join leaves an order's lines side by side, where a window finds their first
    month. An aggregate of its own would read them again and move nearly as many rows, as the lines of an
    order need not lie together in the files.
    """
    items = source(spark, folder, "lineitem")
    key, day = F.col("l_orderkey"), F.col("l_shipdate").cast("date")
    gross = F.col("l_extendedprice").cast(MONEY)
    discount = (gross * F.col("l_discount").cast("decimal(4,2)")).cast(MONEY)
    refund = F.when(
        F.col("l_returnflag") == "R", (gross * F.col("l_tax").cast("decimal(4,2)")).cast(MONEY)
    ).otherwise(F.lit(0).cast(MONEY))
    lines = items.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("revenue_id"),
        key.alias("subscription_id"),
        day.alias("revenue_date"),
        gross.alias("gross_revenue"),
        discount.alias("discount"),
        refund.alias("refund"),
        (gross - discount - refund).cast(MONEY).alias("net_revenue"),
    )
    owner = source(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"))
    month = F.trunc("revenue_date", "MM")
    first_month = F.min(month).over(Window.partitionBy("subscription_id"))
    return lines.join(owner, F.col("subscription_id") == F.col("o_orderkey"), "left").select(
        "revenue_id",
        "customer_id",
        "subscription_id",
        "revenue_date",
        "gross_revenue",
        "discount",
        "refund",
        "net_revenue",
        F.when(F.col("o_orderkey").isNotNull() & (month == first_month), "New")
        .otherwise("Recurring")
        .alias("revenue_type"),
    )


def usage(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    months_on = F.pmod(F.col("event_id"), F.lit(90)).cast("int")

    def count(*kinds: str) -> Column:
        return F.count_if(kind.isin(*kinds)).cast("int")

    return (
        source(spark, folder, "events")
        .groupBy(
            F.col("user_id").alias("customer_id"),
            F.add_months(F.lit("1995-03-01").cast("date"), months_on).alias("usage_date"),
        )
        .agg(
            F.count(F.lit(1)).cast("int").alias("active_users"),
            count("signup").alias("login_count"),
            count("view").alias("session_count"),
            count("click").alias("feature_usage"),
            count("purchase", "error").alias("api_calls"),
        )
    )


def churn(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _order_terms(source(spark, folder, "orders"))
        .where(F.col("end_date").isNotNull())
        .select(
            "customer_id",
            "subscription_id",
            F.col("end_date").alias("churn_date"),
            F.col("priority").alias("churn_reason"),
            F.col("mrr").alias("mrr_lost"),
        )
    )


def opportunities(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return source(spark, folder, "orders").select(
        key.alias("opportunity_id"),
        F.col("o_custkey").alias("customer_id"),
        F.date_add(F.col("o_orderdate").cast("date"), 60).alias("expected_close_date"),
        F.col("o_totalprice").cast(MONEY).alias("deal_value"),
        _pick(tuple(s for s, _ in STAGES), key).alias("stage"),
        _pick(tuple(p for _, p in STAGES), key).cast("decimal(4,2)").alias("probability"),
    )


def tickets(spark: SparkSession, folder: str) -> DataFrame:
    key, created = F.col("event_id"), F.col("ts").cast("date")
    resolved = key % 9 != 0
    return (
        source(spark, folder, "events")
        .where(F.col("event_type") == "error")
        .select(
            key.alias("ticket_id"),
            F.col("user_id").alias("customer_id"),
            created.alias("created_date"),
            F.when(resolved, F.date_add(created, (key % 5).cast("int"))).alias("resolved_date"),
            _pick(PRIORITIES, key).alias("priority"),
            _pick(CATEGORIES, key).alias("category"),
            F.when(resolved, F.col("value").cast("decimal(10,2)")).alias("resolution_time"),
        )
    )


MAKERS = {
    "raw_dim_customer": customers,
    "raw_dim_date": dates,
    "raw_dim_product_plan": plans,
    "raw_fact_subscription": subscriptions,
    "raw_fact_revenue": revenue,
    "raw_fact_customer_usage": usage,
    "raw_fact_churn": churn,
    "raw_fact_sales_pipeline": opportunities,
    "raw_fact_support_ticket": tickets,
}


def raw_tables(spark: SparkSession, folder: str) -> LazyTables:
    return LazyTables({name: partial(make, spark, folder) for name, make in MAKERS.items()})


def processed_tables(spark: SparkSession, folder: str) -> LazyTables:
    return conform_all(raw_tables(spark, folder))
