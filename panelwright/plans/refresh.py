"""Full refresh: raw tables in, every derived table out, in dependency order."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from panelwright.operators.asof import build_master
from panelwright.operators.correlation import rolling_correlations
from panelwright.operators.equity import process_prices
from panelwright.operators.macro import process_macro
from panelwright.operators.markov import fit_transitions
from panelwright.operators.quality import ISSUE_SCHEMA, run_all_checks
from panelwright.operators.regimes import attach_regimes, classify_regimes
from panelwright.operators.signals import compute_signals
from panelwright.sources.snapshots import Run, SnapshotNotFound, list_runs, read_previous


def build_tables(
    prices: DataFrame, macro: DataFrame, annual: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df
) -> dict[str, DataFrame]:
    """All derived tables as lazy plans.

    ``keep`` is applied to the tables that several others are made from; ``keep_for_reuse`` has them computed once.
    """
    processed_prices = process_prices(keep(prices))
    processed_macro = keep(process_macro(macro))
    master = build_master(processed_prices, processed_macro, annual)
    signals = compute_signals(master)
    regimes = keep(classify_regimes(processed_macro))
    panel = attach_regimes(signals, regimes)
    return {
        "prices_processed": processed_prices,
        "macro_processed": processed_macro,
        "master": master,
        "panel_signals": signals,
        "regimes": regimes,
        "panel_regimes": panel,
        "rolling_correlations": rolling_correlations(panel),
        "transition_matrix": fit_transitions(regimes),
    }


def refresh(
    spark: SparkSession,
    root: str,
    run_date: date | str,
    prices: DataFrame,
    macro: DataFrame,
    annual: DataFrame | None = None,
) -> DataFrame:
    """Write every table of one run below ``root`` and return the quality findings.

    Each stage is written and read back before the next one uses it. So every stage is computed once although several
    consumers read it, plans stay small, and a lost executor costs at most one stage. All tables are committed together at
    the end: readers see the run before until then, and for good if this one breaks off. A rerun or backfill of an older
    ``run_date`` reads its own stages and is compared with the run before it; a previous run that cannot be read is a WARNING.
    """
    run = Run(spark, root, str(run_date))
    stored = run.write
    raw_prices = stored(prices, "prices_raw")
    raw_macro = stored(macro, "macro_raw")
    raw_annual = None if annual is None else stored(annual, "annual_raw")
    processed_prices = stored(process_prices(raw_prices), "prices_processed")
    processed_macro = stored(process_macro(raw_macro), "macro_processed")
    master = stored(build_master(processed_prices, processed_macro, raw_annual), "master")
    signals = stored(compute_signals(master), "panel_signals")
    regimes = stored(classify_regimes(processed_macro), "regimes")
    panel = stored(attach_regimes(signals, regimes), "panel_regimes")
    stored(rolling_correlations(panel), "rolling_correlations")
    stored(fit_transitions(regimes), "transition_matrix")
    run.commit()
    previous, unread = None, []
    if any(r < str(run_date) for r in list_runs(spark, root, "master")):
        try:
            previous = read_previous(spark, root, "master", run_date)
        except SnapshotNotFound as problem:
            unread = [("WARNING", "row_count_regression", f"previous run cannot be read: {problem}")]
    return run_all_checks(spark, raw_prices, raw_macro, master, previous).union(spark.createDataFrame(unread, ISSUE_SCHEMA))
