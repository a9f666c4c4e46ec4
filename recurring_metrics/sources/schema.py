"""Raw tables: column types, primary keys, foreign keys, file names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class RawTable:
    """One source file and what is known about its columns."""

    file: str
    ddl: str
    key: tuple[str, ...]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def date_columns(self) -> list[str]:
        return [f.name for f in self.schema if isinstance(f.dataType, T.DateType)]


# Names and types of the source files.
RAW_TABLES: dict[str, RawTable] = {
    "raw_dim_customer": RawTable(
        "dim_customer.csv",
        "customer_id STRING, customer_name STRING, industryregion STRING, "
        "customer_segment STRING, acquisition_date DATE",
        ("customer_id",),
    ),
    "raw_dim_date": RawTable(
        "dim_date.csv", "date DATE, month INT, quarter INT, year INT", ("date",)
    ),
    "raw_dim_product_plan": RawTable(
        "dim_product_plan.csv",
        "plan_id STRING, product_id STRING, plan_name STRING, "
        "billing_frequency STRING, price DECIMAL(12,2)",
        ("plan_id",),
    ),
    "raw_fact_subscription": RawTable(
        "fact_subscription.csv",
        "subscription_id STRING, customer_id STRING, plan_id STRING, start_date DATE, "
        "end_date DATE, renewal_date DATE, status STRING, mrr DECIMAL(12,2), arr DECIMAL(12,2)",
        ("subscription_id",),
    ),
    "raw_fact_revenue": RawTable(
        "fact_revenue.csv",
        "revenue_id STRING, customer_id STRING, subscription_id STRING, revenue_date DATE, "
        "gross_revenue DECIMAL(12,2), discount DECIMAL(12,2), refund DECIMAL(12,2), "
        "net_revenue DECIMAL(12,2), revenue_type STRING",
        ("revenue_id",),
    ),
    "raw_fact_customer_usage": RawTable(
        "fact_customer_usage.csv",
        "customer_id STRING, usage_date DATE, active_users INT, login_count INT, "
        "session_count INT, feature_usage INT, api_calls INT",
        ("customer_id", "usage_date"),
    ),
    "raw_fact_churn": RawTable(
        "fact_churn.csv",
        "customer_id STRING, subscription_id STRING, churn_date DATE, "
        "churn_reason STRING, mrr_lost DECIMAL(12,2)",
        ("subscription_id",),
    ),
    "raw_fact_sales_pipeline": RawTable(
        "fact_sales_pipeline.csv",
        "opportunity_id STRING, customer_id STRING, expected_close_date DATE, "
        "deal_value DECIMAL(12,2), stage STRING, probability DECIMAL(4,2)",
        ("opportunity_id",),
    ),
    "raw_fact_support_ticket": RawTable(
        "fact_support_ticket.csv",
        "ticket_id STRING, customer_id STRING, created_date DATE, resolved_date DATE, "
        "priority STRING, category STRING, resolution_time DECIMAL(10,2)",
        ("ticket_id",),
    ),
}

# Fixed values: (child table, foreign key, parent table, parent key).
RELATIONSHIPS: tuple[tuple[str, str, str, str], ...] = (
    ("raw_fact_subscription", "customer_id", "raw_dim_customer", "customer_id"),
    ("raw_fact_subscription", "plan_id", "raw_dim_product_plan", "plan_id"),
    ("raw_fact_revenue", "customer_id", "raw_dim_customer", "customer_id"),
    ("raw_fact_revenue", "subscription_id", "raw_fact_subscription", "subscription_id"),
    ("raw_fact_customer_usage", "customer_id", "raw_dim_customer", "customer_id"),
    ("raw_fact_churn", "subscription_id", "raw_fact_subscription", "subscription_id"),
    ("raw_fact_sales_pipeline", "customer_id", "raw_dim_customer", "customer_id"),
    ("raw_fact_support_ticket", "customer_id", "raw_dim_customer", "customer_id"),
)
