"""Attribution, roll-up, usage and deals, and the monthly summary."""

import datetime as dt

from pyspark.sql import functions as F

from recurring_metrics.operators.quality import reconcile_revenue
from recurring_metrics.operators.revenue import attribute_revenue, compact_revenue, revenue_block
from recurring_metrics.plans.summary import monthly_summary, revenue_series
from tests.conftest import rows

JAN, FEB, MAR, APR = (dt.date(2024, m, 1) for m in (1, 2, 3, 4))


def categories(revenue, subs):
    got = attribute_revenue(revenue, subs)
    return {
        (r.customer_id, r.month, r.category): float(r.net_revenue) for r in got.collect()
    }


def test_categories(make):
    subs = make.subscriptions(
        ("S1", "C1", "2024-01-05", None, 1), ("S2", "C1", "2024-02-05", None, 1)
    )
    revenue = make.revenue(
        ("C1", "S1", "2024-01-05", 10, "New"),
        ("C1", "S1", "2024-02-05", 11, "Recurring"),
        ("C1", "S2", "2024-02-05", 12, "New"),
        ("C1", "S2", "2024-03-05", 13, None),
        ("C1", "S1", "2024-03-06", 14, "Something else"),
        ("C9", "S9", "2024-03-07", 15, "New"),
        ("C9", None, "2024-03-08", 16, "New"),
        ("C1", "S1", None, 17, "New"),
    )
    assert categories(revenue, subs) == {
        ("C1", JAN, "new"): 10,
        ("C1", FEB, "renewal"): 11,
        ("C1", FEB, "expansion"): 12,
        ("C1", MAR, "renewal"): 27,
        ("C9", MAR, "expansion"): 31,
    }


def test_compacting_first_changes_nothing(make):
    subs = make.subscriptions(("S1", "C1", "2024-01-05", None, 1))
    revenue = make.revenue(
        *[("C1", "S1", f"2024-01-{d:02}", d, "New") for d in range(1, 29)],
        *[("C2", "S2", f"2024-02-{d:02}", d, "Recurring") for d in range(1, 29)],
    )
    assert categories(compact_revenue(revenue), subs) == categories(revenue, subs)
    assert compact_revenue(revenue).count() == 2


def test_all_category_columns_exist_without_rows_of_that_category(make):
    subs = make.subscriptions(("S1", "C1", "2024-01-05", None, 1))
    revenue = make.revenue(("C1", "S1", "2024-01-05", 10, "Recurring"))
    assert revenue_block(revenue, subs).columns == [
        "month", "new_revenue", "expansion_revenue", "renewal_revenue",
    ]


def tables(make):
    return {
        "dim_customer": make.customers(("C1", "SMB", "EU"), ("C2", "SMB", "US"), ("C3", None, "US")),
        "fact_subscription": make.subscriptions(
            ("S1", "C1", "2024-01-05", "2024-03-10", 10), ("S2", "C2", "2023-11-05", None, 5)
        ),
        "fact_revenue": make.revenue(
            ("C1", "S1", "2024-01-31", 10.10, "New"),
            ("C2", "S2", "2024-01-05", 5, "Recurring"),
            ("C2", "S2", "2024-04-05", 6, "Recurring"),
        ),
        "fact_churn": make.churn(("C1", "S1", "2024-03-10", 10)),
        "fact_customer_usage": make.usage(
            ("C1", "2024-01-01", 4, 1, 1, 3, 1),
            ("C1", "2024-01-15", 5, 1, 1, 3, 1),
            ("C2", "2024-01-01", 6, 1, 1, 3, 1),
            ("C2", "2025-01-01", 60, 1, 1, 3, 1),
        ),
        "fact_sales_pipeline": make.deals(
            ("C1", "2024-01-10", 100, "Proposal", 0.6),
            ("C1", "2024-02-10", 100, "Closed Won", 1),
            ("C2", "2024-02-11", 50, "Closed Lost", 0),
            ("C2", "2024-02-11", 50, "Closed Lost", 0),
            ("C2", "2023-02-11", 50, "Closed Won", 1),
        ),
    }


def test_summary_fills_gaps_and_drops_outside_months(make):
    summary = monthly_summary(tables(make))
    assert len(summary.columns) == 23
    got = {r.month: r for r in summary.collect()}
    assert sorted(got) == [JAN, FEB, MAR, APR]
    january, february, march = got[JAN], got[FEB], got[MAR]
    assert (january.total_revenue, january.new_revenue, january.renewal_revenue) == (15.1, 10.1, 5.0)
    assert (february.total_revenue, march.churn_revenue) == (0.0, 10.0)
    assert (january.mrr, january.arr, march.mrr) == (15.0, 180.0, 5.0)
    assert (january.active_customers, march.active_customers) == (2, 2)
    assert got[APR].active_customers == 1 and march.churned_customers == 1
    assert january.new_customers == 1  # the other one started before the spine
    assert january.avg_active_users == 5.0 and january.usage_customer_count == 2
    assert february.avg_active_users == 0.0 and february.usage_customer_count == 0
    assert january.pipeline_open_count == 1 and january.win_rate is None
    assert january.pipeline_weighted_value == 60.0
    assert february.pipeline_weighted_value == 100.0
    assert abs(february.win_rate - 1 / 3) < 1e-12 and february.won_value == 100.0


def test_series_add_up_to_the_company(make):
    whole = monthly_summary(tables(make))
    split = monthly_summary(tables(make), ["region"])
    additive = ["total_revenue", "mrr", "active_customers", "deals_won", "usage_customer_count"]
    summed = split.groupBy("month").agg(*[F.sum(c).alias(c) for c in additive])
    assert rows(summed, "month", *additive) == rows(whole, "month", *additive)
    assert split.count() == 8


def test_incomplete_series_keys_are_left_out(make):
    series = revenue_series(tables(make), ["segment", "region"])
    assert {(r.segment, r.region) for r in series.collect()} == {("SMB", "EU"), ("SMB", "US")}


def test_reconciliation_holds_and_fails(make):
    t = tables(make)
    attributed = attribute_revenue(t["fact_revenue"], t["fact_subscription"], by_customer=False)
    assert all(r.matches for r in reconcile_revenue(attributed, t["fact_revenue"]).collect())
    short = attributed.where("category <> 'new'")
    broken = {r.month: r.matches for r in reconcile_revenue(short, t["fact_revenue"]).collect()}
    assert broken == {None: False, JAN: False, APR: True}
