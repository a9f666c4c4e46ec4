"""Independent SQL for the registered queries, run by another engine on the same files.

The statements share named subqueries; `statement` adds those a body refers to,
directly or through others. They deliberately use the plain forms (range joins,
row-level attribution) that the DataFrame operators avoid.
"""

from __future__ import annotations

import re

SUBQUERIES: dict[str, str] = {
    "acquired": """
        SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS acquisition_date
        FROM orders GROUP BY o_custkey""",
    "raw_customer": """
        SELECT c_custkey AS customer_id, c_name AS customer_name,
               n_name || ' - ' || r_name AS industryregion,
               c_mktsegment AS customer_segment, acquisition_date
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN acquired ON c_custkey = o_custkey""",
    "dim_customer": """
        SELECT c_custkey AS customer_id, c_name AS customer_name, n_name AS industry,
               r_name AS region, c_mktsegment AS segment, acquisition_date
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN acquired ON c_custkey = o_custkey""",
    "dim_plan": """
        SELECT p_partkey AS plan_id, p_brand AS product_id, p_type AS product_family,
               p_type || ' - ' || tier AS plan_name, tier AS plan_tier_name,
               CAST(CASE tier WHEN 'Starter' THEN 1 WHEN 'Professional' THEN 2
                    WHEN 'Business' THEN 3 ELSE 4 END AS INTEGER) AS plan_tier_order,
               CASE WHEN p_partkey % 2 = 0 THEN 'Monthly' ELSE 'Annual' END AS billing_frequency,
               CAST(p_retailprice AS DECIMAL(12,2)) AS price
        FROM (SELECT *, CASE WHEN p_size <= 12 THEN 'Starter' WHEN p_size <= 25 THEN 'Professional'
                             WHEN p_size <= 38 THEN 'Business' ELSE 'Enterprise' END AS tier
              FROM part)""",
    "order_plan": """
        SELECT l_orderkey, MIN(l_partkey) AS plan_id,
               MIN(CAST(date_trunc('month', l_shipdate) AS DATE)) AS first_month
        FROM lineitem GROUP BY l_orderkey""",
    "order_terms": """
        SELECT o_orderkey AS subscription_id, o_custkey AS customer_id,
               CAST(o_orderdate AS DATE) AS start_date,
               CASE WHEN o_orderkey % 16 = 0 THEN NULL
                    ELSE CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 700 AS INTEGER)
               END AS end_date,
               CAST(o_totalprice AS DECIMAL(12,2)) AS mrr, o_orderpriority
        FROM orders""",
    "sub": """
        SELECT subscription_id, customer_id, plan_id, start_date, end_date,
               COALESCE(end_date, start_date + 365) AS renewal_date,
               CASE WHEN end_date IS NULL THEN 'Active' ELSE 'Churned' END AS status,
               mrr, CAST(mrr * 12 AS DECIMAL(12,2)) AS arr
        FROM order_terms LEFT JOIN order_plan ON subscription_id = l_orderkey""",
    "rev_parts": """
        SELECT concat_ws('-', l.l_orderkey, l_linenumber) AS revenue_id,
               o_custkey AS customer_id, l.l_orderkey AS subscription_id,
               CAST(l_shipdate AS DATE) AS revenue_date,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS gross_revenue,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))
                    AS DECIMAL(12,2)) AS discount,
               CASE WHEN l_returnflag = 'R'
                    THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))
                              AS DECIMAL(12,2))
                    ELSE CAST(0 AS DECIMAL(12,2)) END AS refund,
               CASE WHEN CAST(date_trunc('month', l_shipdate) AS DATE) = first_month
                    THEN 'New' ELSE 'Recurring' END AS revenue_type
        FROM lineitem l LEFT JOIN orders ON l.l_orderkey = o_orderkey
        LEFT JOIN order_plan p ON p.l_orderkey = l.l_orderkey""",
    "rev": """
        SELECT revenue_id, customer_id, subscription_id, revenue_date, gross_revenue, discount, refund,
               CAST(gross_revenue - discount - refund AS DECIMAL(12,2)) AS net_revenue,
               revenue_type, CAST(date_trunc('month', revenue_date) AS DATE) AS month
        FROM rev_parts""",
    "usage": """
        SELECT user_id AS customer_id,
               CAST(DATE '1995-03-01' + to_months(CAST(event_id % 90 AS INTEGER)) AS DATE)
                 AS usage_date,
               CAST(COUNT(*) AS INTEGER) AS active_users,
               CAST(COUNT(*) FILTER (event_type = 'signup') AS INTEGER) AS login_count,
               CAST(COUNT(*) FILTER (event_type = 'view') AS INTEGER) AS session_count,
               CAST(COUNT(*) FILTER (event_type = 'click') AS INTEGER) AS feature_usage,
               CAST(COUNT(*) FILTER (event_type IN ('purchase', 'error')) AS INTEGER) AS api_calls
        FROM events GROUP BY 1, 2""",
    "churn": """
        SELECT customer_id, subscription_id, end_date AS churn_date,
               o_orderpriority AS churn_reason, mrr AS mrr_lost
        FROM order_terms WHERE end_date IS NOT NULL""",
    "deal": """
        SELECT o_orderkey AS opportunity_id, o_custkey AS customer_id,
               CAST(o_orderdate AS DATE) + 60 AS expected_close_date,
               CAST(o_totalprice AS DECIMAL(12,2)) AS deal_value,
               CASE o_orderkey % 7 WHEN 0 THEN 'Prospecting' WHEN 1 THEN 'Qualification'
                    WHEN 2 THEN 'Needs Analysis' WHEN 3 THEN 'Proposal' WHEN 4 THEN 'Negotiation'
                    WHEN 5 THEN 'Closed Won' ELSE 'Closed Lost' END AS stage,
               CAST(CASE o_orderkey % 7 WHEN 0 THEN 0.10 WHEN 1 THEN 0.25 WHEN 2 THEN 0.40
                    WHEN 3 THEN 0.60 WHEN 4 THEN 0.80 WHEN 5 THEN 1.00 ELSE 0.00 END
                    AS DECIMAL(4,2)) AS probability
        FROM orders""",
    "order_day": """
        SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(month(o_orderdate) AS INTEGER) AS month,
               CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
               CAST(year(o_orderdate) AS INTEGER) AS year
        FROM orders""",
    "ticket": """
        SELECT event_id AS ticket_id, user_id AS customer_id, CAST(ts AS DATE) AS created_date,
               CASE WHEN event_id % 9 <> 0
                    THEN CAST(ts AS DATE) + CAST(event_id % 5 AS INTEGER) END AS resolved_date,
               CASE event_id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High'
                    ELSE 'Urgent' END AS priority,
               CASE event_id % 7 WHEN 0 THEN 'Billing' WHEN 1 THEN 'Integration'
                    WHEN 2 THEN 'Performance' WHEN 3 THEN 'Access' WHEN 4 THEN 'Data'
                    WHEN 5 THEN 'Onboarding' ELSE 'Other' END AS category,
               CASE WHEN event_id % 9 <> 0 THEN CAST(value AS DECIMAL(10,2)) END AS resolution_time
        FROM events WHERE event_type = 'error'""",
    "spine": """
        SELECT CAST(m AS DATE) AS month, CAST(last_day(m) AS DATE) AS month_end
        FROM (SELECT unnest(generate_series(MIN(month), MAX(month), INTERVAL 1 MONTH)) AS m
              FROM rev)""",
    "series_key": "SELECT DISTINCT segment, region FROM dim_customer",
}


def monthly(prefix: str, keys: tuple[str, ...], rev: str, sub: str, churn: str, spine: str):
    """Subqueries for the monthly measures of one selection, per series of `keys`."""
    k = "".join(f"{c}, " for c in keys)
    pk = "".join(f"p.{c}, " for c in keys)
    owner = "JOIN dim_customer USING (customer_id)" if keys else ""
    same = "".join(f" AND p.{c} = s.{c}" for c in keys)
    on = f"USING ({k}month)"
    p = prefix
    parts = {
        "first_sub": f"""
        SELECT subscription_id FROM (
          SELECT subscription_id, ROW_NUMBER() OVER (
            PARTITION BY customer_id ORDER BY start_date, subscription_id) AS rn FROM {sub})
        WHERE rn = 1""",
        "rev_cat": f"""
        SELECT r.*, CASE WHEN revenue_type <> 'New' THEN 'renewal'
                         WHEN f.subscription_id IS NOT NULL THEN 'new' ELSE 'expansion' END
                    AS category
        FROM {rev} r LEFT JOIN {p}first_sub f ON r.subscription_id = f.subscription_id""",
        "life": f"""
        SELECT customer_id, MIN(start_date) AS first_start,
               COUNT(*) > COUNT(end_date) AS has_open, MAX(end_date) AS last_end,
               CASE WHEN COUNT(*) = COUNT(end_date)
                    THEN CAST(date_trunc('month', MAX(end_date)) AS DATE) END AS churn_month
        FROM {sub} GROUP BY customer_id""",
        "m_rev": f"""
        SELECT {k}month, CAST(SUM(net_revenue) AS DOUBLE) AS total_revenue,
               CAST(COALESCE(SUM(net_revenue) FILTER (category = 'new'), 0) AS DOUBLE)
                 AS new_revenue,
               CAST(COALESCE(SUM(net_revenue) FILTER (category = 'renewal'), 0) AS DOUBLE)
                 AS renewal_revenue,
               CAST(COALESCE(SUM(net_revenue) FILTER (category = 'expansion'), 0) AS DOUBLE)
                 AS expansion_revenue
        FROM {p}rev_cat {owner} GROUP BY {k}month""",
        "m_churn": f"""
        SELECT {k}CAST(date_trunc('month', churn_date) AS DATE) AS month,
               CAST(SUM(mrr_lost) AS DOUBLE) AS churn_revenue
        FROM {churn} {owner} GROUP BY ALL""",
        "m_mrr": f"""
        SELECT {pk}p.month, CAST(COALESCE(SUM(mrr), 0) AS DOUBLE) AS mrr,
               CAST(COALESCE(SUM(mrr), 0) * 12 AS DOUBLE) AS arr
        FROM {spine} p LEFT JOIN (SELECT * FROM {sub} {owner}) s ON start_date <= month_end
             AND (end_date IS NULL OR end_date >= month_end){same}
        GROUP BY {pk}p.month""",
        "m_active": f"""
        SELECT {pk}p.month, COUNT(DISTINCT customer_id) AS active_customers
        FROM {spine} p LEFT JOIN (SELECT * FROM {sub} {owner}) s ON start_date <= month_end
             AND (end_date IS NULL OR end_date >= p.month){same}
        GROUP BY {pk}p.month""",
        "m_new": f"""
        SELECT {k}CAST(date_trunc('month', first_start) AS DATE) AS month,
               COUNT(*) AS new_customers
        FROM {p}life {owner} GROUP BY ALL""",
        "m_lost": f"""
        SELECT {k}churn_month AS month, COUNT(*) AS churned_customers
        FROM {p}life {owner} WHERE churn_month IS NOT NULL GROUP BY ALL""",
        "m_status": f"""
        SELECT {k}month, active_customers, COALESCE(new_customers, 0) AS new_customers,
               COALESCE(churned_customers, 0) AS churned_customers
        FROM {p}m_active LEFT JOIN {p}m_new {on} LEFT JOIN {p}m_lost {on}""",
        "m_usage": f"""
        SELECT {k}CAST(date_trunc('month', usage_date) AS DATE) AS month,
               CAST(SUM(active_users) AS DOUBLE) / COUNT(*) AS avg_active_users,
               CAST(SUM(login_count) AS BIGINT) AS total_login_count,
               CAST(SUM(feature_usage) AS DOUBLE) / COUNT(*) AS avg_feature_usage,
               CAST(SUM(api_calls) AS BIGINT) AS total_api_calls,
               COUNT(DISTINCT customer_id) AS usage_customer_count
        FROM usage {owner} GROUP BY ALL""",
        "m_deal": f"""
        SELECT {k}CAST(date_trunc('month', expected_close_date) AS DATE) AS month,
               COUNT(*) FILTER (stage NOT IN ('Closed Won', 'Closed Lost')) AS pipeline_open_count,
               CAST(COALESCE(SUM(deal_value) FILTER (stage NOT IN ('Closed Won', 'Closed Lost')), 0)
                    AS DOUBLE) AS pipeline_open_value,
               CAST(SUM(deal_value * probability) AS DOUBLE) AS pipeline_weighted_value,
               COUNT(*) FILTER (stage = 'Closed Won') AS deals_won,
               COUNT(*) FILTER (stage = 'Closed Lost') AS deals_lost,
               CAST(COALESCE(SUM(deal_value) FILTER (stage = 'Closed Won'), 0) AS DOUBLE)
                 AS won_value
        FROM deal {owner} GROUP BY ALL""",
        "m_usage_filled": f"""
        SELECT {k}month, COALESCE(avg_active_users, 0.0) AS avg_active_users,
               COALESCE(total_login_count, 0) AS total_login_count,
               COALESCE(avg_feature_usage, 0.0) AS avg_feature_usage,
               COALESCE(total_api_calls, 0) AS total_api_calls,
               COALESCE(usage_customer_count, 0) AS usage_customer_count
        FROM {spine} LEFT JOIN {p}m_usage {on}""",
        "m_deal_filled": f"""
        SELECT {k}month, COALESCE(pipeline_open_count, 0) AS pipeline_open_count,
               COALESCE(pipeline_open_value, 0) AS pipeline_open_value,
               COALESCE(pipeline_weighted_value, 0) AS pipeline_weighted_value,
               COALESCE(deals_won, 0) AS deals_won, COALESCE(deals_lost, 0) AS deals_lost,
               COALESCE(won_value, 0) AS won_value,
               CAST(deals_won AS DOUBLE) / NULLIF(deals_won + deals_lost, 0) AS win_rate
        FROM {spine} LEFT JOIN {p}m_deal {on}""",
        "core": f"""
        SELECT {k}month, COALESCE(total_revenue, 0) AS total_revenue,
               COALESCE(new_revenue, 0) AS new_revenue,
               COALESCE(renewal_revenue, 0) AS renewal_revenue,
               COALESCE(expansion_revenue, 0) AS expansion_revenue,
               COALESCE(churn_revenue, 0) AS churn_revenue,
               active_customers, new_customers, churned_customers, mrr, arr
        FROM {spine} LEFT JOIN {p}m_rev {on} LEFT JOIN {p}m_churn {on}
        JOIN {p}m_status {on} JOIN {p}m_mrr {on}""",
        "summary": f"""
        SELECT {k}{SUMMARY_COLUMNS}
        FROM {p}core JOIN {p}m_usage_filled {on} JOIN {p}m_deal_filled {on}""",
    }
    return {f"{p}{name}": sql for name, sql in parts.items()}


SUMMARY_COLUMNS = """month, total_revenue, new_revenue, renewal_revenue, expansion_revenue,
    churn_revenue, active_customers, new_customers, churned_customers, mrr, arr,
    avg_active_users, total_login_count, avg_feature_usage, total_api_calls,
    usage_customer_count, pipeline_open_count, pipeline_open_value, pipeline_weighted_value,
    deals_won, deals_lost, won_value, win_rate"""
MEASURES = [c.strip() for c in SUMMARY_COLUMNS.replace("\n", " ").split(",")]

SUBQUERIES |= monthly("", (), "rev", "sub", "churn", "spine")

# The same per segment and region.
SUBQUERIES["s_spine"] = "SELECT segment, region, month, month_end FROM series_key CROSS JOIN spine"
SUBQUERIES |= monthly("s_", ("segment", "region"), "rev", "sub", "churn", "s_spine")

# The same for one dashboard selection.
SUBQUERIES |= {
    "f_cust": """
        SELECT * FROM dim_customer WHERE segment IN ('BUILDING', 'MACHINERY')
               AND region IN ('ASIA', 'EUROPE')""",
    "f_plan": """
        SELECT * FROM dim_plan WHERE product_family IN ('ECONOMY', 'PROMO', 'STANDARD')""",
    "f_sub": """
        SELECT * FROM sub WHERE customer_id IN (SELECT customer_id FROM f_cust)
               AND plan_id IN (SELECT plan_id FROM f_plan)""",
    "f_rev": """
        SELECT * FROM rev WHERE customer_id IN (SELECT customer_id FROM f_cust)
               AND subscription_id IN (SELECT subscription_id FROM f_sub)
               AND revenue_date BETWEEN DATE '1996-02-01' AND DATE '1998-11-30'""",
    "f_churn": """
        SELECT * FROM churn WHERE customer_id IN (SELECT customer_id FROM f_cust)
               AND subscription_id IN (SELECT subscription_id FROM f_sub)
               AND churn_date BETWEEN DATE '1996-02-01' AND DATE '1998-11-30'""",
    "f_spine": """
        SELECT CAST(m AS DATE) AS month, CAST(last_day(m) AS DATE) AS month_end
        FROM (SELECT unnest(generate_series(TIMESTAMP '1996-02-01', TIMESTAMP '1998-11-01',
                                            INTERVAL 1 MONTH)) AS m)""",
    **monthly("f_", (), "f_rev", "f_sub", "f_churn", "f_spine"),
    "f_series": """
        SELECT month, total_revenue, new_revenue AS new, renewal_revenue AS renewal,
               expansion_revenue AS expansion, mrr, arr,
               active_customers, new_customers, churned_customers,
               churn_revenue AS churned_revenue
        FROM f_core""",
}


def statement(body: str, extra: dict[str, str] | None = None) -> str:
    """The body with the named subqueries it needs, in dependency order."""
    known = {**SUBQUERIES, **(extra or {})}
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"[a-z_0-9]+", sql):
            if name in known and name not in ordered and name not in visiting:
                visiting.append(name)
                visit(known[name])
                ordered.append(name)

    visiting: list[str] = []
    visit(body)
    if not ordered:
        return body.strip()
    parts = ",\n".join(f"{n} AS MATERIALIZED ({known[n]}\n)" for n in ordered)
    return f"WITH RECURSIVE {parts}\n{body.strip()}"



# --- raw tables by name, for the data-quality reports ---------------------------

RAW_COLUMNS: dict[str, tuple[str, str]] = {
    "raw_dim_customer": (
        "raw_customer",
        "customer_id customer_name industryregion customer_segment acquisition_date",
    ),
    "raw_dim_date": ("order_day", "date month quarter year"),
    "raw_dim_product_plan": ("dim_plan", "plan_id product_id plan_name billing_frequency price"),
    "raw_fact_subscription": (
        "sub",
        "subscription_id customer_id plan_id start_date end_date renewal_date status mrr arr",
    ),
    "raw_fact_revenue": (
        "rev",
        "revenue_id customer_id subscription_id revenue_date gross_revenue discount refund net_revenue "
        "revenue_type",
    ),
    "raw_fact_customer_usage": (
        "usage",
        "customer_id usage_date active_users login_count session_count feature_usage api_calls",
    ),
    "raw_fact_churn": ("churn", "customer_id subscription_id churn_date churn_reason mrr_lost"),
    "raw_fact_sales_pipeline": (
        "deal",
        "opportunity_id customer_id expected_close_date deal_value stage probability",
    ),
    "raw_fact_support_ticket": (
        "ticket",
        "ticket_id customer_id created_date resolved_date priority category resolution_time",
    ),
}
PROCESSED = {
    "dim_customer": "dim_customer",
    "dim_product_plan": "dim_plan",
    "fact_subscription": "sub",
    "fact_revenue": "rev",
    "fact_customer_usage": "usage",
    "fact_churn": "churn",
    "fact_sales_pipeline": "deal",
    "fact_support_ticket": "ticket",
}
KEYS = {
    "raw_dim_customer": ("raw_customer", "customer_id"),
    "raw_dim_date": ("order_day", "date"),
    "raw_dim_product_plan": ("dim_plan", "plan_id"),
    "raw_fact_subscription": ("sub", "subscription_id"),
    "raw_fact_customer_usage": ("usage", "customer_id, usage_date"),
    "raw_fact_churn": ("churn", "subscription_id"),
    "raw_fact_sales_pipeline": ("deal", "opportunity_id"),
    "raw_fact_support_ticket": ("ticket", "ticket_id"),
    "raw_fact_revenue": ("rev", "revenue_id"),
}
FOREIGN_KEYS = (
    ("raw_fact_subscription", "sub", "customer_id", "raw_dim_customer", "raw_customer", "customer_id"),
    ("raw_fact_subscription", "sub", "plan_id", "raw_dim_product_plan", "dim_plan", "plan_id"),
    ("raw_fact_revenue", "rev", "customer_id", "raw_dim_customer", "raw_customer", "customer_id"),
    ("raw_fact_revenue", "rev", "subscription_id", "raw_fact_subscription", "sub", "subscription_id"),
    ("raw_fact_customer_usage", "usage", "customer_id", "raw_dim_customer", "raw_customer", "customer_id"),
    ("raw_fact_churn", "churn", "subscription_id", "raw_fact_subscription", "sub", "subscription_id"),
    ("raw_fact_sales_pipeline", "deal", "customer_id", "raw_dim_customer", "raw_customer", "customer_id"),
    ("raw_fact_support_ticket", "ticket", "customer_id", "raw_dim_customer", "raw_customer", "customer_id"),
)


def union(parts) -> str:
    return "\nUNION ALL ".join(parts)


# --- features and forecasts per segment and region ------------------------------

S = "segment, region"
W = "OVER (PARTITION BY segment, region ORDER BY month"


def lag(column: str, k: int) -> str:
    return f"LAG({column}, {k}) {W})"


LAG_SQL = ", ".join(f"{lag('total_revenue', k)} AS revenue_lag_{k}" for k in (1, 2, 3, 6, 12))
ROLLING_SQL = ", ".join(
    f"ROUND(CASE WHEN COUNT(total_revenue) {W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} "
    f"THEN {f}(total_revenue) {W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END, {d}) "
    f"AS revenue_rolling_{name}_{n}"
    for n in (3, 6, 12)
    for f, name, d in (("AVG", "mean", 6), ("STDDEV_SAMP", "std", 2))
)
GROWTH_SQL = (
    f"{lag('total_revenue', 1)} / NULLIF({lag('total_revenue', 2)}, 0) - 1.0 "
    f"AS revenue_growth_mom_prev, "
    f"{lag('total_revenue', 1)} / NULLIF({lag('total_revenue', 13)}, 0) - 1.0 "
    f"AS revenue_growth_yoy_prev"
)
PREV = [m for m in MEASURES if m not in ("month", "total_revenue")]
PREV_SQL = ", ".join(f"{lag(m, 1)} AS {m}_prev" for m in PREV)
FEATURES = (
    [f"revenue_lag_{k}" for k in (1, 2, 3, 6, 12)]
    + [f"revenue_rolling_{f}_{n}" for n in (3, 6, 12) for f in ("mean", "std")]
    + ["revenue_growth_mom_prev", "revenue_growth_yoy_prev"]
    + [f"{m}_prev" for m in PREV]
    + ["churn_rate_prev", "calendar_month", "time_index"]
)
RATIOS = ("revenue_growth_mom_prev", "revenue_growth_yoy_prev", "churn_rate_prev")
RATIOS += ("avg_active_users_prev", "avg_feature_usage_prev", "win_rate_prev")

SUBQUERIES |= {
    "feat": f"""
        SELECT {S}, month, total_revenue, {LAG_SQL}, {ROLLING_SQL}, {GROWTH_SQL}, {PREV_SQL},
               CAST({lag('churned_customers', 1)} AS DOUBLE)
                 / NULLIF({lag('active_customers', 2)}, 0) AS churn_rate_prev,
               CAST(month(month) AS INTEGER) AS calendar_month,
               CAST(ROW_NUMBER() {W}) - 1 AS INTEGER) AS time_index
        FROM s_summary""",
    "ser_all": f"""
        SELECT {S}, month, COALESCE(total_revenue, 0) AS y
        FROM s_spine LEFT JOIN s_m_rev USING ({S}, month)""",
    "ser_billed": f"""
        SELECT {S}, month, y, ROW_NUMBER() {W}) AS t, COUNT(*) OVER (PARTITION BY {S}) AS n
        FROM ser_all JOIN (SELECT {S}, MIN(month) AS first_month FROM ser_all WHERE y <> 0 GROUP BY {S})
             USING ({S}) WHERE month >= first_month""",
    "ser": "SELECT * FROM ser_billed WHERE n - 12 >= 18",
    "rates": f"""
        SELECT {S}, month, CAST(churned_customers AS DOUBLE)
               / NULLIF(LAG(active_customers, 1) {W}), 0) AS rate
        FROM s_summary""",
    "ends_all": f"SELECT {S}, MAX(month) AS last_month, COUNT(*) AS n FROM ser_all GROUP BY {S}",
    "one_step": f"""
        SELECT {S}, month, y AS actual, LAG(y, 1) {W}) AS naive, LAG(y, 12) {W}) AS seasonal_naive,
               (LAG(y, 3) {W}) + LAG(y, 2) {W}) + LAG(y, 1) {W})) / 3 AS moving_avg_3,
               LAG(y, 1) {W}) + (SELECT AVG(b.y - a.y) FROM ser a JOIN ser b
                 ON a.segment = b.segment AND a.region = b.region AND b.t = a.t + 1
                 WHERE b.segment = x.segment AND b.region = x.region AND b.t < x.t) AS drift,
               t, n
        FROM ser x""",
    "weights": """
        SELECT a AS alpha, b AS beta
        FROM unnest([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) x(a)
        CROSS JOIN unnest([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) z(b)""",
    "holt": f"""
        SELECT a.segment, a.region, alpha, beta, a.t, CAST(NULL AS DOUBLE) AS expected,
               CAST(0 AS DOUBLE) AS sse_before, a.y AS level, b.y - a.y AS trend,
               CAST(0 AS DOUBLE) AS sse
        FROM ser a JOIN ser b ON a.segment = b.segment AND a.region = b.region AND b.t = 2
        CROSS JOIN weights WHERE a.t = 1
        UNION ALL
        SELECT h.segment, h.region, alpha, beta, s.t, level + trend, sse,
               alpha * y + (1 - alpha) * (level + trend),
               beta * ((alpha * y + (1 - alpha) * (level + trend)) - level) + (1 - beta) * trend,
               sse + (y - (level + trend)) * (y - (level + trend))
        FROM holt h JOIN ser s
          ON h.segment = s.segment AND h.region = s.region AND s.t = h.t + 1""",
    "holt_fold": f"""
        SELECT {S}, t, expected FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY {S}, t ORDER BY sse_before, alpha, beta) AS rn
          FROM holt WHERE t >= 3) WHERE rn = 1""",
    "holt_final": f"""
        SELECT {S}, level, trend FROM (
          SELECT h.*, ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY sse, alpha, beta) AS rn
          FROM holt h JOIN (SELECT DISTINCT {S}, n FROM ser) USING ({S}) WHERE t = n)
        WHERE rn = 1""",
    "backtest": union(
        [
            f"SELECT {S}, month, '{m}' AS model_name, actual, {m} AS predicted "
            f"FROM one_step WHERE n - t < 12"
            for m in ("naive", "seasonal_naive", "moving_avg_3", "drift")
        ]
        + [
            f"SELECT {S}, month, 'holt_linear' AS model_name, y AS actual, expected AS predicted "
            f"FROM ser JOIN holt_fold USING ({S}, t) WHERE n - t < 12"
        ]
    ),
    "metric": f"""
        SELECT {S}, model_name, AVG(ABS(actual - predicted)) AS mae,
               SQRT(AVG((actual - predicted) * (actual - predicted))) AS rmse,
               AVG(ABS((actual - predicted) / NULLIF(actual, 0))) * 100 AS mape,
               STDDEV_SAMP(actual - predicted) AS residual_std,
               COUNT((actual - predicted) / NULLIF(actual, 0)) AS folds,
               MIN(month) AS backtest_start, MAX(month) AS backtest_end
        FROM backtest GROUP BY {S}, model_name""",
    "board": f"""
        SELECT *, ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY folds < most, mape NULLS LAST,
                 list_position(['naive', 'seasonal_naive', 'moving_avg_3', 'drift', 'holt_linear'],
                               model_name)) AS model_rank
        FROM metric JOIN (SELECT {S}, MAX(folds) AS most FROM metric GROUP BY {S}) USING ({S})""",
    "steps": "SELECT CAST(i AS INTEGER) AS step FROM unnest(generate_series(1, 6)) x(i)",
    "ends": f"""
        SELECT {S}, MAX(month) AS last_month, MAX(n) AS n, MAX(y) FILTER (t = 1) AS y_first,
               MAX(y) FILTER (t = n) AS a3, MAX(y) FILTER (t = n - 1) AS a2,
               MAX(y) FILTER (t = n - 2) AS a1
        FROM ser GROUP BY {S}""",
    "ma1": "SELECT *, (a1 + a2 + a3) / 3 AS p1 FROM ends",
    "ma2": "SELECT *, (a2 + a3 + p1) / 3 AS p2 FROM ma1",
    "ma3": "SELECT *, (a3 + p1 + p2) / 3 AS p3 FROM ma2",
    "ma4": "SELECT *, (p1 + p2 + p3) / 3 AS p4 FROM ma3",
    "ma5": "SELECT *, (p2 + p3 + p4) / 3 AS p5 FROM ma4",
    "ma6": "SELECT *, (p3 + p4 + p5) / 3 AS p6 FROM ma5",
    "point": f"""
        SELECT {S}, step, CAST(last_month + to_months(step) AS DATE) AS forecast_month,
               'naive' AS model_name, a3 AS predicted FROM ends CROSS JOIN steps
        UNION ALL
        SELECT e.segment, e.region, step, CAST(last_month + to_months(step) AS DATE),
               'seasonal_naive', y
        FROM ends e CROSS JOIN steps JOIN ser s ON e.segment = s.segment AND e.region = s.region
             AND s.t = e.n - 12 + step
        UNION ALL
        SELECT {S}, step, CAST(last_month + to_months(step) AS DATE), 'moving_avg_3',
               CASE step WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 WHEN 4 THEN p4
                         WHEN 5 THEN p5 ELSE p6 END FROM ma6 CROSS JOIN steps
        UNION ALL
        SELECT {S}, step, CAST(last_month + to_months(step) AS DATE), 'drift',
               a3 + step * ((a3 - y_first) / (n - 1)) FROM ends CROSS JOIN steps
        UNION ALL
        SELECT {S}, step, CAST(last_month + to_months(step) AS DATE), 'holt_linear',
               level + step * trend
        FROM ends JOIN holt_final USING ({S}) CROSS JOIN steps""",
    "chosen": f"""
        SELECT p.*, residual_std, a3 AS last_actual
        FROM point p JOIN board b ON p.segment = b.segment AND p.region = b.region
             AND p.model_name = b.model_name AND b.model_rank = 1
        JOIN ends e ON p.segment = e.segment AND p.region = e.region""",
    "forecast": f"""
        SELECT {S}, forecast_month, predicted AS predicted_revenue,
               predicted - 1.2815515655446004::DOUBLE * residual_std * SQRT(step) AS lower_bound,
               predicted + 1.2815515655446004::DOUBLE * residual_std * SQRT(step) AS upper_bound,
               (predicted - before) / NULLIF(before, 0) * 100 AS forecast_growth, model_name
        FROM (SELECT *, COALESCE(LAG(predicted) OVER (PARTITION BY {S} ORDER BY step), last_actual)
                     AS before FROM chosen)""",
}


# Eight decimal digits first, so that a half is one on any engine.
FOUR = "CAST(ROUND(CAST(predicted AS DECIMAL(28,8)), 4) AS DOUBLE)"


def walk(model: str) -> str:
    return statement(
        f"SELECT {S}, month, model_name, actual, {FOUR} AS predicted "
        f"FROM backtest WHERE model_name = '{model}'"
    )


DRIVERS = (
    ("MRR", "mrr"), ("ARR", "arr"), ("Active customers", "active_customers"),
    ("Expansion revenue", "expansion_revenue"), ("Churn revenue (MRR lost)", "churn_revenue"),
    ("Avg. active users", "avg_active_users"),
    ("Pipeline weighted value", "pipeline_weighted_value"), ("Win rate", "win_rate"),
)
KPIS = (
    ("total_revenue", True), ("mrr", True), ("arr", True), ("active_customers", True),
    ("new_customers", True), ("churned_customers", False), ("churned_revenue", False),
)

CUSTOMER = "customer_id, customer_name, industry, region, segment, acquisition_date"
CLASSIFY = (
    "CASE WHEN pct_change IS NULL THEN 'n/a' WHEN pct_change > 1 THEN 'up' "
    "WHEN pct_change < -1 THEN 'down' ELSE 'flat' END"
)

BODIES: dict[str, str] = {
    # sources and sinks
    "csv_roundtrip": union(
        f"SELECT '{raw}' AS table_name, concat_ws('|', "
        + ", ".join(
            f"coalesce(CAST({c} AS VARCHAR), '-')"
            for c in columns.split()
        )
        + f") AS line FROM {name}"
        for raw, (name, columns) in RAW_COLUMNS.items()
    ),
    "scan_project": "SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem",
    "scan_ordered": "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey",
    "sink_overwrite": f"SELECT {CUSTOMER} FROM dim_customer",
    "sink_append": f"SELECT {CUSTOMER} FROM dim_customer UNION ALL "
    f"SELECT {CUSTOMER} FROM dim_customer",
    # data quality
    "dq_row_counts": union(
        f"SELECT '{raw}' AS table_name, (SELECT COUNT(*) FROM {source}) AS source_rows, "
        f"(SELECT COUNT(*) FROM {loaded}) AS loaded_rows, 'OK' AS status"
        for raw, source, loaded in (
            ("raw_dim_customer", "customer", "raw_customer"),
            ("raw_dim_date", "(SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders)", "order_day"),
            ("raw_dim_product_plan", "part", "dim_plan"),
            ("raw_fact_subscription", "orders", "sub"),
            ("raw_fact_revenue", "lineitem", "rev"),
            ("raw_fact_customer_usage", "(SELECT DISTINCT user_id, event_id % 90 FROM events)", "usage"),
            ("raw_fact_churn", "(SELECT 1 FROM orders WHERE o_orderkey % 16 <> 0)", "churn"),
            ("raw_fact_sales_pipeline", "orders", "deal"),
            ("raw_fact_support_ticket", "(SELECT 1 FROM events WHERE event_type = 'error')", "ticket"),
        )
    ),
    "dq_null_counts": union(
        f"SELECT '{raw}' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count "
        f"FROM {name}"
        for raw, (name, columns) in RAW_COLUMNS.items()
        for c in columns.split()
    ),
    "dq_duplicate_keys": union(
        f"SELECT '{raw}' AS table_name, COUNT(*) FILTER (copies > 1) AS duplicate_keys, "
        f"CAST(SUM(copies - 1) AS BIGINT) AS surplus_rows "
        f"FROM (SELECT COUNT(*) AS copies FROM {name} GROUP BY {key})"
        for raw, (name, key) in KEYS.items()
    ),
    "dq_orphans": "SELECT *, CASE WHEN orphans = 0 THEN 'OK' ELSE 'FAIL' END AS status FROM ("
    + union(
        f"SELECT '{child}.{key}' AS child, '{parent}.{pkey}' AS parent, COUNT(*) AS orphans "
        f"FROM {ctab} c LEFT JOIN {ptab} p ON c.{key} = p.{pkey} WHERE p.{pkey} IS NULL"
        for child, ctab, key, parent, ptab, pkey in FOREIGN_KEYS
    )
    + ")",
    "dq_date_ranges": union(
        f"SELECT '{raw}' AS table_name, '{c}' AS column_name, MIN({c}) AS first_date, "
        f"MAX({c}) AS last_date FROM {name}"
        for raw, (name, columns) in RAW_COLUMNS.items()
        for c in columns.split()
        if c == "date" or c.endswith("_date")
    ),
    "dq_revenue_reconcile": """
        SELECT month, CAST(SUM(net_revenue) AS DOUBLE) AS attributed_revenue,
               CAST(SUM(net_revenue) AS DOUBLE) AS billed_revenue, TRUE AS matches
        FROM rev GROUP BY ROLLUP (month)""",
    "table_row_counts": union(
        f"SELECT '{name}' AS table_name, COUNT(*) AS row_count FROM {table}"
        for name, table in PROCESSED.items()
    ),
    "leak_correlation": f"SELECT {S}, feature, ROUND(r, 6) AS abs_correlation FROM ("
    f"SELECT *, ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY r DESC, feature) AS rn FROM ("
    + union(
        f"SELECT {S}, '{c}' AS feature, ABS(CORR(CAST({c} AS DOUBLE), total_revenue)) AS r "
        f"FROM feat GROUP BY {S}"
        for c in FEATURES
    )
    + ") WHERE r IS NOT NULL AND NOT isnan(r)) WHERE rn <= 5",
    "eligible_series": f"""
        SELECT {S}, COUNT(*) AS months, COUNT(*) - 12 AS training_months,
               COUNT(*) - 12 >= 18 AS eligible FROM ser_billed GROUP BY {S}""",
    # conforming
    "conform_customers": f"SELECT {CUSTOMER} FROM dim_customer",
    "conform_plans": """
        SELECT plan_id, product_id, product_family, plan_name, plan_tier_name, plan_tier_order,
               billing_frequency, price FROM dim_plan""",
    "conform_subscriptions": """
        SELECT subscription_id, customer_id, plan_id, start_date, end_date, renewal_date, status,
               mrr, arr FROM sub""",
    "conform_revenue": """
        SELECT revenue_id, customer_id, subscription_id, revenue_date, gross_revenue, discount, refund,
               net_revenue, revenue_type FROM rev""",
    "conform_usage": """
        SELECT customer_id, usage_date, active_users, login_count, session_count, feature_usage,
               api_calls FROM usage""",
    "conform_churn": """
        SELECT customer_id, subscription_id, churn_date, churn_reason, mrr_lost FROM churn""",
    "conform_opportunities": """
        SELECT opportunity_id, customer_id, expected_close_date, deal_value, stage, probability
        FROM deal""",
    "conform_tickets": """
        SELECT ticket_id, customer_id, created_date, resolved_date, priority, category,
               resolution_time FROM ticket""",
    "date_scalars": """
        SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
               CAST(last_day(o_orderdate) AS DATE) AS month_end,
               CAST(date_trunc('month', o_orderdate) + to_months(1) AS DATE) AS following_month,
               CAST(month(o_orderdate) AS INTEGER) AS calendar_month,
               CAST(quarter(o_orderdate) AS INTEGER) AS calendar_quarter,
               CAST(year(o_orderdate) AS INTEGER) AS calendar_year
        FROM orders""",
    # revenue, customers, months
    "revenue_attribution": """
        SELECT customer_id, month, category, CAST(SUM(net_revenue) AS DOUBLE) AS net_revenue
        FROM rev_cat GROUP BY customer_id, month, category""",
    "revenue_by_type": "SELECT month, total_revenue, new_revenue, renewal_revenue, "
    "expansion_revenue FROM core",
    "monthly_revenue": "SELECT month, total_revenue FROM core",
    "churned_revenue": "SELECT month, churn_revenue FROM core",
    "usage_monthly": """
        SELECT month, ROUND(avg_active_users, 6) AS avg_active_users, total_login_count,
               ROUND(avg_feature_usage, 6) AS avg_feature_usage, total_api_calls,
               usage_customer_count FROM m_usage_filled""",
    "opportunities_monthly": """
        SELECT month, pipeline_open_count, pipeline_open_value, pipeline_weighted_value,
               deals_won, deals_lost, won_value, ROUND(win_rate, 6) AS win_rate
        FROM m_deal_filled""",
    "customer_lifecycle": "SELECT * FROM life",
    "fully_churned_count": "SELECT COUNT(*) AS fully_churned_customers FROM life WHERE NOT has_open",
    "first_subscription": """
        SELECT subscription_id, customer_id, start_date,
               subscription_id IN (SELECT subscription_id FROM first_sub) AS is_first FROM sub""",
    "month_spine": f"SELECT {S}, month, y AS total_revenue FROM ser_all",
    "mrr_snapshot": "SELECT month, mrr, arr FROM m_mrr",
    "customer_status": "SELECT month, active_customers, new_customers, churned_customers "
    "FROM m_status",
    "monthly_summary": "SELECT "
    + ", ".join(
        f"ROUND({m}, 6) AS {m}" if m in ("avg_active_users", "avg_feature_usage", "win_rate") else m
        for m in MEASURES
    )
    + " FROM summary",
    "series_summary": f"SELECT {S}, "
    + ", ".join(
        f"ROUND({m}, 6) AS {m}" if m in ("avg_active_users", "avg_feature_usage", "win_rate") else m
        for m in MEASURES
    )
    + " FROM s_summary",
    "latest_months": """
        SELECT month, total_revenue, new_revenue, expansion_revenue, renewal_revenue,
               churn_revenue, mrr, arr, active_customers
        FROM summary ORDER BY month DESC LIMIT 6""",
    # dashboard
    "filtered_star": """
        SELECT 'revenue' AS fact, customer_id, subscription_id, revenue_date AS fact_date,
               net_revenue AS amount FROM f_rev
        UNION ALL SELECT 'churn', customer_id, subscription_id, churn_date, mrr_lost FROM f_churn
        UNION ALL SELECT 'subscription', customer_id, subscription_id, start_date, mrr
        FROM f_sub""",
    "filter_options": """
        SELECT DISTINCT 'segment' AS option, segment AS value FROM dim_customer
        UNION ALL SELECT DISTINCT 'region', region FROM dim_customer
        UNION ALL SELECT DISTINCT 'industry', industry FROM dim_customer WHERE industry IS NOT NULL
        UNION ALL SELECT DISTINCT 'product_family', product_family FROM dim_plan
        UNION ALL SELECT 'min_month', CAST(MIN(month) AS VARCHAR) FROM rev
        UNION ALL SELECT 'max_month', CAST(MAX(month) AS VARCHAR) FROM rev""",
    "tier_catalog": "SELECT DISTINCT plan_tier_name, plan_tier_order FROM dim_plan",
    "monthly_series": "SELECT * FROM f_series",
    "kpi_summary": """
        SELECT ROUND(SUM(total_revenue), 2) AS total_revenue,
               ROUND(MAX_BY(mrr, month), 2) AS current_mrr,
               ROUND(MAX_BY(arr, month), 2) AS current_arr,
               MAX_BY(active_customers, month) AS active_customers,
               CAST(SUM(new_customers) AS BIGINT) AS new_customers,
               CAST(SUM(churned_customers) AS BIGINT) AS churned_customers,
               ROUND(SUM(churned_revenue), 2) AS churned_revenue
        FROM f_series""",
    "kpi_trends": "SELECT kpi, current_value, previous_value, ROUND(pct_change, 6) AS pct_change, "
    "CASE WHEN pct_change IS NULL THEN NULL "
    "WHEN pct_change <= 0.05 AND pct_change >= -0.05 THEN 'neutral' "
    "WHEN (pct_change > 0) = good_is_up THEN 'positive' ELSE 'negative' END AS trend FROM ("
    "SELECT *, (current_value - previous_value) / NULLIF(ABS(previous_value), 0) * 100 "
    "AS pct_change FROM ("
    + union(
        f"SELECT '{k}' AS kpi, {up} AS good_is_up, "
        f"MAX(CAST({k} AS DOUBLE)) FILTER (month = DATE '1998-11-01') AS current_value, "
        f"MAX(CAST({k} AS DOUBLE)) FILTER (month = DATE '1998-10-01') AS previous_value "
        f"FROM f_series"
        for k, up in KPIS
    )
    + "))",
    "revenue_by_segment": """
        SELECT segment, CAST(SUM(net_revenue) AS DOUBLE) AS net_revenue
        FROM f_rev JOIN f_cust USING (customer_id) GROUP BY segment""",
    "revenue_by_product": """
        SELECT product_family, CAST(SUM(net_revenue) AS DOUBLE) AS net_revenue
        FROM f_rev r JOIN f_sub s ON r.subscription_id = s.subscription_id
        JOIN f_plan p ON s.plan_id = p.plan_id GROUP BY product_family""",
    # features
    "revenue_lags": f"SELECT {S}, month, total_revenue, {LAG_SQL} FROM s_summary",
    "revenue_rolling": f"SELECT {S}, month, {ROLLING_SQL} FROM s_summary",
    "revenue_growth": f"SELECT {S}, month, ROUND(revenue_growth_mom_prev, 6) "
    f"AS revenue_growth_mom_prev, ROUND(revenue_growth_yoy_prev, 6) AS revenue_growth_yoy_prev "
    f"FROM feat",
    "feature_table": f"SELECT {S}, month, total_revenue, "
    + ", ".join(f"ROUND({c}, 6) AS {c}" if c in RATIOS else c for c in FEATURES)
    + " FROM feat",
    "dq_feature_nulls": union(
        f"SELECT 'ml_feature_table' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count FROM feat"
        for c in ("segment", "region", "month", "total_revenue", *FEATURES)
    ),
    "ffill_horizon": f"SELECT e.segment, e.region, step, "
    f"CAST(last_month + to_months(step) AS DATE) AS month, "
    f"CAST(month(last_month + to_months(step)) AS INTEGER) AS calendar_month, "
    f"CAST(n - 1 + step AS INTEGER) AS time_index, "
    + ", ".join(
        f"ROUND({m}, 6) AS {m}_prev" if f"{m}_prev" in RATIOS else f"{m} AS {m}_prev"
        for m in PREV
        if m != "win_rate"
    )
    + ", ROUND((SELECT MAX_BY(win_rate, month) FROM s_summary w WHERE w.segment = e.segment "
    "AND w.region = e.region AND win_rate IS NOT NULL), 6) AS win_rate_prev, "
    "ROUND((SELECT MAX_BY(rate, month) FROM rates r WHERE r.segment = e.segment "
    "AND r.region = e.region AND rate IS NOT NULL), 6) AS churn_rate_prev "
    "FROM ends_all e JOIN s_summary f ON e.segment = f.segment AND e.region = f.region "
    "AND f.month = last_month CROSS JOIN steps",
    # back-tests and forecasts
    "walk_forward_window": f"SELECT {S}, month, model_name, actual, {FOUR} AS predicted "
    f"FROM backtest",
    "backtest_metrics_window": f"""
        SELECT {S}, model_name, ROUND(mae, 4) AS mae, ROUND(rmse, 4) AS rmse,
               ROUND(mape, 6) AS mape, ROUND(residual_std, 4) AS residual_std, folds,
               backtest_start, backtest_end FROM metric""",
    "leaderboard_window": f"""
        SELECT {S}, model_name, ROUND(mae, 4) AS mae, ROUND(rmse, 4) AS rmse,
               ROUND(mape, 6) AS mape, folds, backtest_start, backtest_end, 'v1' AS model_version,
               CAST(model_rank AS INTEGER) AS model_rank, model_rank = 1 AS is_best FROM board""",
    "accuracy_table_window": f"SELECT {S}, model_name, "
    + ", ".join(
        f"CAST(ROUND(CAST({m} AS DECIMAL(28,4)), 2) AS DOUBLE) AS {m}"
        for m in ("mae", "rmse", "mape")
    )
    + ", model_rank = 1 AS is_best, CAST(model_rank AS INTEGER) AS model_rank FROM board",
    "forecast_points_window": f"SELECT {S}, step, forecast_month, model_name, "
    f"{FOUR} AS predicted FROM point",
    "revenue_forecast_window": f"""
        SELECT {S}, forecast_month, ROUND(predicted_revenue, 4) AS predicted_revenue,
               ROUND(lower_bound, 2) AS lower_bound, ROUND(upper_bound, 2) AS upper_bound,
               ROUND(forecast_growth, 6) + 0.0 AS forecast_growth, model_name,
               'v1' AS model_version FROM forecast""",
    "hist_vs_predicted_window": f"""
        SELECT {S}, month, actual AS actual_revenue, {FOUR} AS predicted_revenue,
               model_name, 'v1' AS model_version
        FROM backtest JOIN (SELECT {S}, model_name FROM board WHERE model_rank = 1)
             USING ({S}, model_name)""",
    "forecast_drivers": f"SELECT {S}, driver_name, ROUND(current_value, 4) AS current_value, "
    f"ROUND(prior_value, 4) AS prior_value, ROUND(pct_change, 6) + 0.0 AS pct_change, "
    f"{CLASSIFY} AS direction, as_of_month, CAST(3 AS INTEGER) AS lookback_months FROM ("
    f"SELECT *, (current_value - prior_value) / NULLIF(prior_value, 0) * 100 AS pct_change FROM ("
    + union(
        f"SELECT {S}, '{label}' AS driver_name, "
        f"MAX(CAST({c} AS DOUBLE)) FILTER (month = last_month) AS current_value, "
        f"MAX(CAST({c} AS DOUBLE)) FILTER (month = CAST(last_month - to_months(3) AS DATE)) "
        f"AS prior_value, MAX(last_month) AS as_of_month "
        f"FROM s_summary JOIN ends_all USING ({S}) GROUP BY {S}"
        for label, c in DRIVERS
    )
    + "))",
    "actual_plus_forecast_window": f"""
        SELECT {S}, month, 'actual' AS kind, y AS revenue,
               CAST(NULL AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound FROM ser_all
        UNION ALL
        SELECT {S}, forecast_month, 'forecast', ROUND(predicted_revenue, 4),
               ROUND(lower_bound, 2), ROUND(upper_bound, 2) FROM forecast""",
    # ad-hoc SQL
    "adhoc_sql": """
        SELECT customer_id, segment, CAST(SUM(net_revenue) AS DOUBLE) AS net_revenue
        FROM rev JOIN dim_customer USING (customer_id) GROUP BY customer_id, segment
        ORDER BY net_revenue DESC, customer_id LIMIT 200""",
    "saved_questions_window": """
        SELECT 'latest_revenue' AS question, item, ROUND(amount, 4) AS amount FROM (
          SELECT CAST(month AS VARCHAR) AS item, total_revenue AS amount FROM core
          ORDER BY month DESC LIMIT 1)
        UNION ALL SELECT 'top_segment', item, ROUND(amount, 4) FROM (
          SELECT segment AS item, CAST(SUM(net_revenue) AS DOUBLE) AS amount
          FROM rev JOIN dim_customer USING (customer_id) GROUP BY segment
          ORDER BY amount DESC LIMIT 1)
        UNION ALL SELECT 'churned_in_a_year', 'churned_customers',
          CAST(SUM(churned_customers) AS DOUBLE) FROM (
          SELECT churned_customers FROM m_status ORDER BY month DESC LIMIT 12)
        UNION ALL SELECT 'churn_reasons', churn_reason,
          CAST(SUM(mrr_lost) AS DOUBLE) FROM churn GROUP BY churn_reason
        UNION ALL SELECT 'next_three_months', item, ROUND(amount, 4) FROM (
          SELECT CAST(forecast_month AS VARCHAR) AS item, predicted_revenue AS amount
          FROM forecast ORDER BY forecast_month LIMIT 3)
        UNION ALL SELECT 'best_model_error', model_name, ROUND(mape, 4)
          FROM board WHERE model_rank = 1""",
}

# The saved questions are about the whole company: one series of all revenue.
COMPANY = {"ser_all": "SELECT 'all' AS segment, 'all' AS region, month, total_revenue AS y FROM core"}
ORACLES: dict[str, str] = {
    name: statement(body, COMPANY if name == "saved_questions_window" else None) for name, body in BODIES.items()
}
ORACLES |= {
    f"bt_{name}": walk(model)
    for name, model in {
        "naive": "naive",
        "seasonal_naive": "seasonal_naive",
        "moving_avg_3": "moving_avg_3",
        "drift": "drift",
        "holt": "holt_linear",
    }.items()
}
# Counted in two halves or at once, the summary is the same.
ORACLES["incremental_summary"] = ORACLES["monthly_summary"]
