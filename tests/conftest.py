import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from recurring_metrics.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, memory="4g", spark__sql__shuffle__partitions="4")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


def day(text):
    return None if text is None else dt.date.fromisoformat(text)


def money(value):
    return None if value is None else Decimal(str(value))


@pytest.fixture(scope="session")
def make(spark):
    """Small conformed tables from short tuples."""

    class Make:
        def subscriptions(self, *rows):
            """(id, customer, start, end, mrr[, plan])"""
            full = [
                (i, c, (rest[0] if rest else "P1"), day(s), day(e), money(m))
                for i, c, s, e, m, *rest in rows
            ]
            return spark.createDataFrame(
                full,
                "subscription_id string, customer_id string, plan_id string, start_date date, "
                "end_date date, mrr decimal(12,2)",
            )

        def revenue(self, *rows):
            """(customer, subscription, date, net, type)"""
            return spark.createDataFrame(
                [(c, s, day(d), money(n), t) for c, s, d, n, t in rows],
                "customer_id string, subscription_id string, revenue_date date, "
                "net_revenue decimal(12,2), revenue_type string",
            )

        def churn(self, *rows):
            return spark.createDataFrame(
                [(c, s, day(d), "why", money(m)) for c, s, d, m in rows],
                "customer_id string, subscription_id string, churn_date date, "
                "churn_reason string, mrr_lost decimal(12,2)",
            )

        def usage(self, *rows):
            return spark.createDataFrame(
                [(c, day(d), *counts) for c, d, *counts in rows],
                "customer_id string, usage_date date, active_users int, login_count int, "
                "session_count int, feature_usage int, api_calls int",
            )

        def deals(self, *rows):
            return spark.createDataFrame(
                [(str(i), c, day(d), money(v), s, money(p)) for i, (c, d, v, s, p) in enumerate(rows)],
                "opportunity_id string, customer_id string, expected_close_date date, "
                "deal_value decimal(12,2), stage string, probability decimal(4,2)",
            )

        def customers(self, *rows):
            return spark.createDataFrame(
                list(rows), "customer_id string, segment string, region string"
            )

        def plans(self, *rows):
            return spark.createDataFrame(list(rows), "plan_id string, product_family string")

        def series(self, values, start="2020-01-01", **keys):
            first = day(start)
            rows = [
                (*keys.values(), dt.date(first.year + (first.month - 1 + i) // 12,
                                         (first.month - 1 + i) % 12 + 1, 1), float(v))
                for i, v in enumerate(values)
            ]
            head = "".join(f"{k} string, " for k in keys)
            return spark.createDataFrame(rows, f"{head}month date, total_revenue double")

    return Make()


def rows(df, *columns):
    """Rows as sorted tuples of plain values."""
    chosen = df.select(*columns) if columns else df
    return sorted(
        (tuple(r) for r in chosen.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r)
    )
