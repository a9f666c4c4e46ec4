"""What the plans promise at scale: pushdown, pruning, no range joins, hot keys."""

import datetime as dt
import random
import re

import pytest

from recurring_metrics.operators.filters import DashboardFilter
from recurring_metrics.operators.revenue import attribute_revenue
from recurring_metrics.plans import dashboard
from recurring_metrics.plans.summary import monthly_summary
from tests.test_dashboard import tables as dashboard_tables
from tests.test_revenue import tables as summary_tables


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def stored(spark, make, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")

    def store(name, df):
        path = str(folder / name)
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    both = {**summary_tables(make), **dashboard_tables(make)}
    return {name: store(name, df) for name, df in both.items()}


def test_filters_reach_the_scan(stored):
    choice = DashboardFilter(dt.date(2024, 2, 1), dt.date(2024, 3, 1), ("SMB", "Startup"), ("EU",))
    selection = dashboard.select_dashboard(stored, choice)
    text = plan(dashboard.revenue_by_segment(selection))
    pushed = " ".join(re.findall(r"PushedFilters: \[.*\]", text))
    assert "GreaterThanOrEqual(revenue_date,2024-02-01)" in pushed
    assert "LessThanOrEqual(revenue_date,2024-03-31)" in pushed
    assert "In(segment, [SMB,Startup])" in pushed and "EqualTo(region,EU)" in pushed


def test_scans_read_only_the_columns_they_need(stored):
    text = plan(monthly_summary(stored))
    schemas = re.findall(r"ReadSchema: (.*)", text)
    assert any("net_revenue" in s and "revenue_type" in s for s in schemas)
    assert not any("renewal_date" in s or "churn_reason" in s or "opportunity_id" in s for s in schemas)


@pytest.mark.parametrize("keys", [(), ("segment", "region")])
def test_no_nested_loops_and_no_python(stored, keys):
    text = plan(monthly_summary(stored, keys))
    for node in ("NestedLoop", "CartesianProduct", "PythonUDF", "ArrowEval", "MapInPandas"):
        assert node not in text


def test_one_subscription_with_a_third_of_all_rows(make):
    pick = random.Random(7)
    subs = [(f"S{i:03}", f"C{i % 40:02}", f"2024-01-{i % 28 + 1:02}", None, 1) for i in range(120)]
    owner = {s: c for s, c, *_ in subs}
    bills = []
    for i in range(1500):
        sub = "S041" if i % 3 == 0 else f"S{pick.randrange(140):03}"
        day = dt.date(2024, 1, 1) + dt.timedelta(days=pick.randrange(200))
        kind = pick.choice(["New", "Recurring", None])
        bills.append((owner.get(sub, "C99"), sub, day.isoformat(), i, kind))
    first = {}
    for s, c, start, *_ in sorted(subs, key=lambda r: (r[2], r[0])):
        first.setdefault(c, s)
    want = {}
    for c, s, day, net, kind in bills:
        category = "renewal" if kind != "New" else "new" if s in first.values() else "expansion"
        key = (c, dt.date.fromisoformat(day).replace(day=1), category)
        want[key] = want.get(key, 0) + net
    got = attribute_revenue(make.revenue(*bills), make.subscriptions(*subs))
    assert {(r.customer_id, r.month, r.category): float(r.net_revenue) for r in got.collect()} == want


def test_attribution_keeps_one_row_per_customer_before_the_shuffle(make):
    subs = make.subscriptions(("S1", "C1", "2024-01-05", None, 1))
    revenue = make.revenue(("C1", "S1", "2024-01-05", 10, "New"))
    assert "WindowGroupLimit" in plan(attribute_revenue(revenue, subs))


def test_customers_are_joined_once(spark, stored):
    """The blocks of the summary meet the customers together, not one by one."""
    made = monthly_summary(stored, ["segment", "region"])._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join Inner" in line and "customer_id" in line for line in made.splitlines()) == 1
