"""The SQL guard, and the refresh from CSV files to output tables."""

import datetime as dt

import pytest
from pyspark.errors import ParseException

from recurring_metrics.operators import quality, trees
from recurring_metrics.plans import adhoc
from recurring_metrics.plans.refresh import LoadCheckError, load_and_check, refresh
from recurring_metrics.sources.io import load_raw_tables, write_observed
from tests.conftest import rows


@pytest.mark.parametrize(
    "sql",
    [
        "", " ; ", "SHOW TABLES", "UPDATE t SET a = 1", "explain select 1",
        "SELECT 1; DROP TABLE t", "select 'please DELETE me'", "WITH x AS (SELECT 1) INSERT INTO t",
        "SELECT replace(a, 'x', 'y') FROM t", "selection FROM t",
    ],
)
def test_rejected(sql):
    with pytest.raises(adhoc.UnsafeQueryError):
        adhoc.check_query(sql)


@pytest.mark.parametrize("sql", ["select updated_at from t", " WITH a AS (SELECT 1) SELECT * FROM a; "])
def test_accepted(sql):
    assert adhoc.check_query(sql) == sql.strip().rstrip(";")


def test_stacked_selects_are_refused_by_the_parser(spark):
    with pytest.raises(ParseException):
        adhoc.run_safe_query(spark, "SELECT 1; SELECT 2", {})


def test_the_row_limit_always_applies(spark):
    many = {"many": spark.range(500).withColumnRenamed("id", "rate_limit")}
    assert adhoc.run_safe_query(spark, "SELECT rate_limit FROM many", many).count() == 200
    assert adhoc.run_safe_query(spark, "SELECT * FROM many LIMIT 400", many).count() == 200
    assert adhoc.run_safe_query(spark, "SELECT * FROM many LIMIT 3", many).count() == 3


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM parquet.`/etc`", "SELECT * FROM `parquet`.`/etc`", "SELECT * FROM parquet/**/.`/etc`",
        "SELECT * FROM t WHERE a IN (SELECT b FROM other)", "SELECT (SELECT max(b) FROM other) FROM t",
        "WITH x AS (SELECT * FROM other) SELECT * FROM x", "SELECT * FROM global_temp.seen",
        "SELECT * FROM foreign_view", "SELECT reflect('java.lang.System', 'exit')",
        "SELECT java_method/**/('java.lang.System', 'exit') FROM t", "SELECT * FROM spark_catalog.default.t",
        "SELECT " + ", ".join(f"a AS c{i}" for i in range(40)) + ", reflect('java.lang.System', 'getProperty', 'user.home') FROM t",
        "SELECT a FROM t WHERE a IN (SELECT length(REFLECT('java.lang.System', 'getProperty', 'user.home')) FROM t)",
        "WITH x AS (SELECT `reflect`('java.lang.System', 'getProperty', 'user.home') AS b) SELECT b FROM x",
        "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT transform(array(a), x -> java_method('a', 'b')) FROM t",
        "SELECT system.builtin.reflect('a', 'b')", "SELECT count(*) FROM range(1000000000000)", "SELECT explode(sequence(1, 1000000000)) FROM t",
        "SELECT input_file_name() FROM t", "SELECT TRANSFORM(a) USING 'cat' AS (b) FROM t", "SELECT repeat('x', 1000000000) FROM t",
        "SELECT x.a FROM t x, t y", "SELECT x.a FROM t x JOIN t y ON x.a < y.a", "SELECT no_such_function(a) FROM t",
    ],
)
def test_only_the_given_tables(spark, sql):
    spark.range(1).createOrReplaceTempView("foreign_view")
    spark.range(1).createOrReplaceGlobalTempView("seen")
    given = {"t": spark.range(3).withColumnRenamed("id", "a")}
    with pytest.raises(adhoc.UnsafeQueryError):
        adhoc.run_safe_query(spark, sql, given)


def test_usual_functions_are_allowed(spark):
    given = {"t": spark.range(30).withColumnRenamed("id", "a"), "u": spark.range(5).withColumnRenamed("id", "b")}
    sql = """
        WITH s AS (SELECT a % 5 AS b, sum(a) AS total, percentile_approx(a, 0.5) AS middle, count(*) AS n FROM t GROUP BY a % 5)
        SELECT u.b, round(total / n, 2) AS mean, upper(concat('x', cast(middle AS string))) AS label,
               row_number() OVER (ORDER BY total DESC) AS place, coalesce(lag(n) OVER (ORDER BY u.b), 0) AS before,
               date_format(add_months(DATE '2024-01-01', cast(u.b AS int)), 'yyyy-MM') AS month,
               total > (SELECT avg(a) FROM t) AS over, exists(array(1, 2), x -> x > n) AS any_more
        FROM u JOIN s ON u.b = s.b LATERAL VIEW explode(array(1, 2)) e AS k"""
    assert adhoc.run_safe_query(spark, sql, given).count() == 10
    assert adhoc.run_safe_query(spark, "SELECT t.a, m.x FROM t CROSS JOIN (SELECT max(b) AS x FROM u) m", given).count() == 30


def test_scan_budget(spark, tmp_path):
    spark.range(100_000).write.parquet(str(tmp_path / "big"))
    given = {"t": spark.read.parquet(str(tmp_path / "big"))}
    assert adhoc.run_safe_query(spark, "SELECT max(id) FROM t", given).count() == 1
    with pytest.raises(adhoc.UnsafeQueryError, match="bytes"):
        adhoc.run_safe_query(spark, "SELECT max(id) FROM t", given, most_bytes=1000)


def test_views_do_not_leak(spark):
    spark.range(9).createOrReplaceTempView("mine")
    given = {"Mine": spark.range(3), "unused": spark.range(1)}
    assert adhoc.run_safe_query(spark, "WITH x AS (SELECT * FROM MINE) SELECT * FROM x", given).count() == 3
    assert spark.table("mine").count() == 9 and not spark.catalog.tableExists("unused")
    assert adhoc.run_safe_query(spark, "SELECT * FROM other", {"other": spark.range(2)}).count() == 2
    assert not spark.catalog.tableExists("other")
    with pytest.raises(adhoc.UnsafeQueryError):
        adhoc.run_safe_query(spark, "SELECT * FROM other", given)


def write(folder, name, header, lines):
    (folder / name).write_text("\n".join([header, *lines]) + "\n")


@pytest.fixture
def source(tmp_path):
    """Three customers, 34 billed months."""
    folder = tmp_path / "raw"
    folder.mkdir()
    months = [dt.date(2021 + (i // 12), i % 12 + 1, 1) for i in range(34)]
    write(folder, "dim_customer.csv",
          "customer_id,customer_name,industryregion,customer_segment,acquisition_date",
          [f"C{i},Name {i},Retail - R & D - North,SMB,2021-01-0{i}" for i in (1, 2, 3)])
    write(folder, "dim_date.csv", "date,month,quarter,year", ["2021-01-01,1,1,2021"])
    write(folder, "dim_product_plan.csv", "product_id,plan_id,plan_name,billing_frequency,price",
          ["PR1,P1,Core - Starter,Monthly,10", "PR1,P2,Core - Business,Annual,99.5"])
    write(folder, "fact_subscription.csv",
          "subscription_id,customer_id,plan_id,start_date,end_date,renewal_date,status,mrr,arr",
          ["S1,C1,P1,2021-01-01,,2022-01-01,Active,10,120",
           "S2,C2,P2,2021-01-01,2023-05-15,2022-01-01,Churned,20,240",
           "S3,C3,P2,2021-02-01,,2022-02-01,Active,30,360"])
    bills = []
    for i, month in enumerate(months):
        for s, c, base in (("S1", "C1", 10), ("S2", "C2", 20), ("S3", "C3", 30)):
            kind = "New" if i == 0 else "Recurring"
            gross = base + i
            bills.append(f"R{i}-{s},{c},{s},{month},{gross},1.00,0,{gross - 1},{kind}")
    write(folder, "fact_revenue.csv",
          "revenue_id,customer_id,subscription_id,revenue_date,gross_revenue,discount,refund,net_revenue,revenue_type",
          bills)
    write(folder, "fact_customer_usage.csv",
          "customer_id,usage_date,active_users,login_count,session_count,feature_usage,api_calls",
          [f"C1,{m},{i + 1},2,3,4,5" for i, m in enumerate(months)])
    write(folder, "fact_churn.csv", "customer_id,subscription_id,churn_date,churn_reason,mrr_lost",
          ["C2,S2,2023-05-15,Price,20"])
    write(folder, "fact_sales_pipeline.csv",
          "opportunity_id,customer_id,expected_close_date,deal_value,stage,probability",
          [f"O{i},C1,{m},100,{'Closed Won' if i % 2 else 'Closed Lost'},{i % 2}" for i, m in enumerate(months)])
    write(folder, "fact_support_ticket.csv",
          "ticket_id,customer_id,created_date,resolved_date,priority,category,resolution_time",
          ["T1,C1,2021-03-01,,High,Billing,", "T2,C9,2021-03-01,2021-03-02,Low,Data,4.5"])
    return folder


def test_load_reports(spark, source, tmp_path):
    raw, reports = load_and_check(spark, str(source), str(tmp_path / "out"))
    assert len(raw) == 9
    assert {r.status for r in reports["row_counts"].collect()} == {"OK"}
    failed = [r for r in reports["orphans"].collect() if r.status == "FAIL"]
    assert [(r.child, r.orphans) for r in failed] == [("raw_fact_support_ticket.customer_id", 1)]
    nulls = {(r.table_name, r.column_name): r.null_count for r in reports["null_counts"].collect()}
    assert nulls["raw_fact_subscription", "end_date"] == 2
    assert nulls["raw_fact_support_ticket", "resolved_date"] == 1
    assert all(r.duplicate_keys == 0 for r in reports["duplicate_keys"].collect())


def test_load_profile_equals_the_separate_reports(spark, source, tmp_path):
    """Counts, nulls and dates come from the write; afterwards only footers are read for them."""
    raw, reports = load_and_check(spark, str(source), str(tmp_path / "out"))
    assert rows(reports["row_counts"]) == rows(quality.reconcile_counts(load_raw_tables(spark, str(source)), raw))
    assert rows(reports["null_counts"]) == rows(quality.null_counts(raw))
    assert rows(reports["date_ranges"]) == rows(quality.date_ranges(raw))
    for name in ("null_counts", "date_ranges"):
        assert not reports[name].inputFiles()
    plan = reports["row_counts"]._jdf.queryExecution().executedPlan().toString()
    assert ".csv" not in plan and plan.count("ReadSchema: struct<>") >= len(raw)


def test_a_profile_of_odd_tables(spark, tmp_path):
    odd = spark.createDataFrame([(None, None), (None, 1)], "`a.b` date, `Rows` int")
    seen = write_observed(odd, str(tmp_path / "odd"), quality.profile_measures(odd))
    assert seen == {"rows": 2, "nulls_0": 2, "first_0": None, "last_0": None, "nulls_1": 1}
    none = odd.where("false")
    assert write_observed(none, str(tmp_path / "none"), quality.profile_measures(none))["rows"] == 0


def test_refresh_builds_every_table(spark, source, tmp_path):
    target = str(tmp_path / "out")
    small = {m.name: m.with_budget(2, 12) for m in (trees.GBT, trees.GBT_MIN5)}
    written = refresh(spark, str(source), target, dt.datetime(2024, 1, 1), tree_models=small)
    checks = {name: n for name, n in written.items() if name.startswith("check_")}
    assert {k: n for k, n in written.items() if k not in checks} == {
        "dim_customer": 3, "dim_product_plan": 2, "fact_subscription": 3, "fact_revenue": 102,
        "fact_customer_usage": 34, "fact_churn": 1, "fact_sales_pipeline": 34,
        "fact_support_ticket": 2, "monthly_revenue_summary": 34, "ml_feature_table": 34,
        "model_evaluation_metrics": 7, "historical_vs_predicted": 12, "revenue_forecast": 6,
        "forecast_drivers": 8,
    }
    tables = {name: spark.read.parquet(f"{target}/{name}") for name in written}
    status = dict(rows(tables["check_status"]))
    assert set(status) == {name.removeprefix("check_") for name in checks} - {"status"}
    assert {name for name, s in status.items() if s == "FAIL"} == {"orphans"}
    assert checks["check_feature_nulls"] == 39 and checks["check_revenue_reconciliation"] == 35
    board = tables["model_evaluation_metrics"]
    assert board.where("evaluated_at IS NULL").isEmpty()
    assert rows(tables["dim_customer"], "industry", "region")[0] == ("Retail - R & D", "North")
    assert len(tables["ml_feature_table"].columns) == 39
    best = tables["model_evaluation_metrics"].where("is_best").first()
    assert best.model_name == "drift" or best.mape <= 1
    for question in adhoc.QUESTIONS:
        assert adhoc.saved_question(spark, question, tables).count() >= 1


def test_a_strict_refresh_stops_at_a_failed_check(spark, source, tmp_path):
    with pytest.raises(LoadCheckError, match="orphans"):
        refresh(spark, str(source), str(tmp_path / "out"), strict=True)
