from __future__ import annotations

from datetime import date, datetime

import pytest
from conftest import column, days
from pyspark.sql import functions as F

from panelwright.operators import views
from panelwright.plans import refresh
from panelwright.sources import normalise, snapshots


def test_wide_quotes_become_rows(spark):
    rows = [(datetime(2024, 1, 2, 15, 30), "1", 10.0, 20.0, 7.0), (datetime(2024, 1, 3), "n/a", 11.0, None, None)]
    wide = spark.createDataFrame(
        rows, "Date timestamp, `Open|AA.X` string, `Close|AA.X` double, `Close|BB` double, `Volume|BB` double"
    )
    out = normalise.normalise_prices(wide, {"AA.X": "Alpha"}).orderBy("ticker", "date").collect()
    assert [(r["date"], r["ticker"], r["open"], r["close"], r["volume"], r["name"]) for r in out] == [
        (date(2024, 1, 2), "AA.X", 1.0, 10.0, None, "Alpha"),
        (date(2024, 1, 3), "AA.X", None, 11.0, None, "Alpha"),
        (date(2024, 1, 2), "BB", None, 20.0, 7.0, None),
    ]


def test_wide_quotes_need_no_shuffle(spark):
    wide = spark.createDataFrame([(date(2024, 1, 2), 1.0)], "Date date, `Close|A` double")
    plan = normalise.normalise_prices(wide, {})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_observations(spark):
    docs = [
        ("DEXSFUS", '{"observations": [{"date": "2024-01-01", "value": "18.5"}, {"date": "2024-01-02", "value": "."}]}'),
        ("GONE", '{"error": "no such series"}'),
    ]
    raw = spark.createDataFrame(docs, "series string, payload string")
    parsed = normalise.parse_observations(raw)
    assert column(parsed, "value") == [18.5, None] and parsed.count() == 2
    aligned = normalise.align_series(parsed, {"DEXSFUS": "zar_usd", "GONE": "repo_rate"})
    assert column(aligned, "zar_usd") == [18.5, None] and column(aligned, "repo_rate") == [None, None]


def test_alignment_uses_the_union_of_dates(spark):
    rows = [("a", d, 1.0) for d in days(2)] + [("b", days(3)[2], 2.0)]
    out = normalise.align_series(spark.createDataFrame(rows, "series string, date date, value double"), {"a": "x", "b": "y"})
    assert column(out, "x") == [1.0, 1.0, None] and column(out, "y") == [None, None, 2.0]


def test_annual(spark):
    rows = [("2021", 1.0), ("2020.0", 2.0), ("bad", 3.0), (None, 4.0)]
    out = normalise.normalise_annual(spark.createDataFrame(rows, "time string, `NY.GDP.MKTP.KD.ZG` double"))
    assert column(out, "year", "year") == [2020, 2021] and column(out, "gdp_growth_pct", "year") == [2.0, 1.0]


def test_date_and_year_ranges(spark, series):
    df = series({"A": list(range(10))})
    assert normalise.between_dates(df, days(3)[2], days(6)[5]).count() == 3
    assert normalise.between_dates(df).count() == 10
    years = spark.createDataFrame([(y,) for y in range(2000, 2010)], "year int")
    assert normalise.between_years(years, 2003, 2005).count() == 3


def test_date_range_reaches_the_scan(spark, tmp_path, series):
    series({"A": [1, 2]}).write.parquet(str(tmp_path / "t"))
    df = normalise.between_dates(spark.read.parquet(str(tmp_path / "t")), "2020-01-02").select("date")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date,2020-01-02)]" in plan and "ReadSchema: struct<date:date>" in plan


def test_snapshots(spark, tmp_path, series):
    root = str(tmp_path)
    with pytest.raises(snapshots.SnapshotNotFound, match="master"):
        snapshots.read_latest(spark, root, "master")
    snapshots.write_snapshot(series({"A": [1]}), root, "master", "2024-01-01")
    assert snapshots.read_previous(spark, root, "master").count() == 0
    snapshots.write_snapshot(series({"A": [1, 2, 3]}), root, "master", "2024-01-02")
    snapshots.write_snapshot(series({"A": [1, 2]}), root, "master", "2024-01-02")
    latest = snapshots.read_latest(spark, root, "master")
    assert latest.count() == 2 and latest.columns == ["ticker", "date", "close"]
    assert snapshots.read_previous(spark, root, "master").count() == 1


def test_best_panel(spark, tmp_path, series):
    root = str(tmp_path)
    with pytest.raises(snapshots.SnapshotNotFound):
        snapshots.read_best_panel(spark, root)
    snapshots.write_snapshot(series({"A": [1]}), root, "master", "2024-01-01")
    assert snapshots.read_best_panel(spark, root).count() == 1
    snapshots.write_snapshot(series({"A": [1, 2]}), root, "panel_regimes", "2024-01-01")
    assert snapshots.read_best_panel(spark, root).count() == 2


def test_freshness(spark, tmp_path, series):
    root = str(tmp_path)
    snapshots.write_snapshot(series({"A": [1, 2]}), root, "prices_raw", "2024-01-01")
    snapshots.write_snapshot(spark.createDataFrame([(2023,)], "year int"), root, "annual_raw", "2024-01-01")
    tables = ["prices_raw", "annual_raw", "macro_raw"]
    out = {r["table_name"]: r for r in snapshots.freshness_report(spark, root, tables).collect()}
    assert out["prices_raw"]["latest"] == "2020-01-02" and out["prices_raw"]["n_rows"] == 2
    assert out["annual_raw"]["latest"] == "2023" and out["macro_raw"]["n_rows"] is None
    assert not out["prices_raw"]["stale"]
    later = snapshots.freshness_report(spark, root, tables[:1], F.date_add(F.current_date(), 10)).first()
    assert later["stale"] and later["file_age_days"] == 10


def test_refresh_writes_every_table(spark, tmp_path, series, monthly):
    prices = series({"A": [100 + k % 7 for k in range(80)], "B": [50 + k % 5 for k in range(80)]}).withColumn("name", F.col("ticker"))
    macro = monthly({"zar_usd": [15, 16, 17], "tbill_rate": [5, 6, 5], "cpi_all": [100, 101, 102]})
    annual = spark.createDataFrame([(2020, 1.0)], "year int, gdp_growth_pct double")
    root = str(tmp_path)
    issues = refresh.refresh(spark, root, "2024-01-01", prices, macro, annual)
    assert {r["check"] for r in issues.collect()} == {"macro_completeness"}
    panel = snapshots.read_best_panel(spark, root)
    assert panel.count() == 160 and {"rsi_14", "composite_regime", "gdp_growth_pct"} <= set(panel.columns)
    assert {"date", "ticker", "name", "macro_var", "rolling_corr"} == set(snapshots.read_latest(spark, root, "rolling_correlations").columns)
    assert snapshots.read_latest(spark, root, "transition_matrix").count() > 0
    lazy = refresh.build_tables(prices, macro, annual)
    assert lazy["panel_regimes"].count() == 160
    small = refresh.refresh(spark, root, "2024-01-02", prices.where("ticker = 'A'"), macro)
    assert "row_count_regression" in {r["check"] for r in small.collect()}


def test_views(spark, series):
    panel = series({"A": [1, 2, 3], "B": [4, 5, 6]}).withColumn("momentum_score", -F.col("close")).withColumn("name", F.lower("ticker"))
    assert views.ticker_slice(panel, "A", days(2)[0], days(2)[1]).count() == 2
    assert [tuple(r) for r in views.panel_catalog(panel).collect()] == [
        ("A", "a", days(1)[0], days(3)[2], 3), ("B", "b", days(1)[0], days(3)[2], 3),
    ]
    snap = views.signal_snapshot(panel, days(2)[1]).collect()
    assert [(r["ticker"], r["momentum_score"]) for r in snap] == [("B", -5.0), ("A", -2.0)]
    assert views.available_variables(panel) == []
    corr = spark.createDataFrame([("A", "x", 0.1), ("A", "y", 0.2)], "ticker string, macro_var string, rolling_corr double")
    assert views.correlation_slice(corr, "A", "y").first()["rolling_corr"] == 0.2


def test_latest_regime(spark, monthly):
    from panelwright.operators.regimes import classify_regimes

    table = classify_regimes(monthly({"tbill_rate": [5, 6, 7], "cpi_yoy_pct": [2, 2, 2]}))
    out = views.latest_regime(table).first()
    assert out["composite_regime"] == "HIKING_LOW_INFLATION" and out["regime_duration"] == 2 and out["tbill_rate"] == 7.0
    assert views.macro_view(monthly({"tbill_rate": [5, 6]})).columns == ["date", "tbill_rate"]


def test_runs_do_not_mix(spark, tmp_path, series):
    root = str(tmp_path)
    snapshots.write_snapshot(series({"A": [1, 2]}), root, "master", "2024-01-02")
    snapshots.write_snapshot(series({"A": [1, 2, 3]}).withColumn("added", F.lit(1)), root, "master", "2024-01-03")
    assert "added" in snapshots.read_latest(spark, root, "master").columns
    assert "added" not in snapshots.read_run(spark, root, "master", "2024-01-02").columns
    snapshots.write_snapshot(series({"A": [1]}).limit(0), root, "master", "2024-01-04")
    assert snapshots.read_latest(spark, root, "master").count() == 0
    assert snapshots.read_previous(spark, root, "master").count() == 3
    assert snapshots.read_previous(spark, root, "master", "2024-01-03").count() == 2
    assert {r[0].isoformat() for r in snapshots.read_all_runs(spark, root, "master").select("run_date").distinct().collect()} == {
        "2024-01-02",
        "2024-01-03",
    }


def test_bad_years_go(spark):
    rows = [("2020", 1.0), ("99999999999", 2.0), ("x", 3.0), (None, 4.0)]
    out = normalise.normalise_annual(spark.createDataFrame(rows, "year string, gdp double"), {})
    assert [r["year"] for r in out.collect()] == [2020]


def test_inclusive_end(series):
    frame = series({"A": [1, 2, 3]})
    assert normalise.between_dates(frame, "2020-01-01", "2020-01-02", inclusive=True).count() == 2
    assert normalise.between_dates(frame, "2020-01-01", "2020-01-02").count() == 1


def test_broken_off_refresh_leaves_the_run_before(spark, tmp_path, series, monthly, monkeypatch):
    prices = series({"A": [100 + k % 7 for k in range(80)], "B": [50 + k % 5 for k in range(80)]}).withColumn("name", F.col("ticker"))
    macro = monthly({"zar_usd": [15, 16, 17], "tbill_rate": [5, 6, 5], "cpi_all": [100, 101, 102]})
    root = str(tmp_path)
    refresh.refresh(spark, root, "2024-01-01", prices, macro)
    with monkeypatch.context() as broken:
        broken.setattr(refresh, "classify_regimes", lambda _: 1 / 0)  # after master and signals are written
        for day in ("2024-01-01", "2024-01-02"):
            with pytest.raises(ZeroDivisionError):
                refresh.refresh(spark, root, day, prices.where("ticker = 'A'"), macro)
    assert snapshots.list_runs(spark, root, "master") == ["2024-01-01"]
    for table in ("prices_raw", "master", "panel_signals", "panel_regimes"):
        assert snapshots.read_latest(spark, root, table).count() == 160
    refresh.refresh(spark, root, "2024-01-01", prices.where("ticker = 'A'"), macro)
    assert snapshots.read_latest(spark, root, "panel_regimes").count() == 80


def test_commits_are_exclusive_and_unfinished_ones_do_not_count(spark, tmp_path, series):
    root = str(tmp_path)
    runs = [snapshots.Run(spark, root, "2024-01-01") for _ in range(3)]
    for k, run in enumerate(runs):
        assert run.write(series({"A": list(range(k + 1))}), "master").count() == k + 1
    with pytest.raises(snapshots.SnapshotNotFound):
        snapshots.read_latest(spark, root, "master")
    for run in runs:
        run.commit()
    assert [r["number"] for r in snapshots.commits(spark, root).orderBy("number").collect()] == [1, 2, 3]
    assert snapshots.read_latest(spark, root, "master").count() == 3
    (tmp_path / "_commits" / "000000000004.json").write_text('{"run_date": "2024-01-09", "attempt": "x", "tab')
    assert snapshots.list_runs(spark, root, "master") == ["2024-01-01"]
    snapshots.write_snapshot(series({"A": [1]}), root, "master", "2024-01-03")
    assert snapshots.list_runs(spark, root, "master") == ["2024-01-01", "2024-01-03"]
    assert [tuple(r) for r in snapshots.row_counts(spark, root, "master").orderBy("run_date").collect()] == [("2024-01-01", 3), ("2024-01-03", 1)]


def test_freshness_opens_no_table(spark, tmp_path, series):
    root = str(tmp_path)
    snapshots.write_snapshot(series({"A": [1, 2]}), root, "master", "2024-01-02")
    plan = snapshots.freshness_report(spark, root, ["master", "other"])._jdf.queryExecution().toString()
    assert "FileScan json" in plan and "FileScan parquet" not in plan


def test_many_series_plan_at_once(spark):
    """10,000 quote columns, a tick in a name, and a column of texts among numbers."""
    import time

    tickers = [f"T{k}" for k in range(1998)] + ["O'Neil", "text"]
    fields = ("Open", "High", "Low", "Close", "Volume")
    cells = {f"{f}|{t}": ("string" if (f, t) == ("Close", "text") else "double") for t in tickers for f in fields}
    schema = "Date date, " + ", ".join(f"`{c}` {kind}" for c, kind in cells.items())
    row = (days(1)[0], *[("7.5" if kind == "string" else float(k)) for k, kind in enumerate(cells.values())])
    wide = spark.createDataFrame([row], schema)
    started = time.time()
    out = normalise.normalise_prices(wide, {"O'Neil": "it's O'Neil", "T0": None})
    assert time.time() - started < 30
    rows = {r["ticker"]: r for r in out.collect()}
    assert len(rows) == 2000 and rows["text"]["close"] == 7.5 and rows["T1"]["close"] == 8.0 and rows["T1"]["volume"] == 9.0
    assert rows["O'Neil"]["name"] == "it's O'Neil" and rows["T0"]["name"] is None


def test_no_quotes(spark):
    assert normalise.normalise_prices(spark.createDataFrame([(days(1)[0], 1.0)], "Date date, other double"), {}).count() == 0
