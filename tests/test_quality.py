from __future__ import annotations

import pytest
from conftest import days

from panelwright.operators import quality


def issues(df):
    return [tuple(r) for r in df.collect()]


def test_missing_closes(series):
    df = series({"BAD": [None, 1] * 10, "GOOD": [None] + [1] * 99})
    found = issues(quality.missing_closes(df))
    assert len(found) == 1 and found[0][:2] == ("WARNING", "missing_trading_days")
    assert "BAD" in found[0][2] and "50.0%" in found[0][2]


def test_missing_columns_are_reported(spark):
    found = issues(quality.missing_closes(spark.createDataFrame([(1,)], "x int")))
    assert len(found) == 1 and found[0][0] == "WARNING"


def test_frozen(series):
    df = series({"FROZEN": [1, 2, 3, 4] + [50] * 35, "MOVING": list(range(40)), "SHORT": [5] * 10})
    found = issues(quality.frozen_prices(df))
    assert len(found) == 1 and "FROZEN" in found[0][2]


def test_frozen_needs_a_full_recent_window(series):
    assert issues(quality.frozen_prices(series({"A": [50] * 29 + [None] + [50] * 5}))) == []


@pytest.fixture
def macro(spark):
    def build(rows):
        return spark.createDataFrame(rows, "date date, repo_rate double, cpi_all double, tbill_rate double")

    return build


def test_completeness(macro):
    rows = [(d, None, 1.0 if k < 3 else None, 2.0) for k, d in enumerate(days(20))]
    found = {(s, m.split("'")[1]) for s, _, m in issues(quality.macro_completeness(macro(rows)))}
    assert found == {("ERROR", "repo_rate"), ("WARNING", "cpi_all")}


def test_empty_macro_table_is_an_error(macro):
    found = issues(quality.macro_completeness(macro([])))
    assert len(found) == 1 and found[0][0] == "ERROR" and "empty" in found[0][2]


def test_row_count(series):
    big, small, same = (series({"A": [1] * n}) for n in (1000, 800, 950))
    found = issues(quality.row_count_regression(small, big))
    assert len(found) == 1 and found[0][0] == "ERROR" and "20.0%" in found[0][2]
    assert issues(quality.row_count_regression(same, big)) == []
    assert issues(quality.row_count_regression(big, small)) == []
    assert issues(quality.row_count_regression(big, None)) == []
    assert issues(quality.row_count_regression(big, small.limit(0))) == []


def test_all_checks(spark, series, macro):
    assert issues(quality.run_all_checks(spark)) == []
    found = quality.run_all_checks(
        spark, series({"BAD": [None, 1] * 10}), macro([]), series({"A": [1] * 10}), series({"A": [1] * 100})
    )
    assert {c for _, c, _ in issues(found)} == {"missing_trading_days", "macro_completeness", "row_count_regression"}
    assert tuple(quality.has_errors(found).first()) == (True, 2, 1)
    assert tuple(quality.has_errors(quality.run_all_checks(spark)).first()) == (False, 0, 0)


def test_empty_current_master_is_skipped(spark, series):
    full = series({"A": [1] * 10})
    assert issues(quality.run_all_checks(spark, master=full.limit(0), previous_master=full)) == []


def test_last_rows_limit_is_pushed_below_the_shuffle(series):
    plan = quality.last_rows(series({"A": [1] * 10}), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
