"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalog import inputs
from catalog.inputs import INDEX, MACRO_LABELS
from panelwright.functions import fixed_values as fixed
from panelwright.functions.lineage import keep_for_reuse
from panelwright.operators import (
    asof,
    backtest,
    correlation,
    equity,
    fill,
    macro,
    markov,
    predictor,
    quality,
    regime_returns,
    regimes,
    scan,
    segments,
    signals,
    views,
    walkforward,
)
from panelwright.plans import refresh
from panelwright.sources import normalise, snapshots

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
MAX_COLUMNS = 10_000
CUT_DAY = "1999-07-01"


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def names(df: DataFrame, column: str) -> list[str]:
    """Values that become columns: read from the data, with an error beyond ``MAX_COLUMNS``."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_COLUMNS + 1).collect()]
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} values of {column}")
    return sorted(found)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Shared parts ---------------------------------------------------------------------------------------------------------


def closes(s: SparkSession, d: str) -> DataFrame:
    return inputs.prices(s, d).select("ticker", "date", "close", "name")


def monthly(s: SparkSession, d: str) -> DataFrame:
    """A row per month: kept, as most queries read it several times."""
    return keep_for_reuse(macro.process_macro(inputs.macro(s, d)))


def regime_table(s: SparkSession, d: str) -> DataFrame:
    return regimes.classify_regimes(monthly(s, d))


def scored(s: SparkSession, d: str) -> DataFrame:
    return signals.momentum_score(signals.cross_section_z(signals.momentum(closes(s, d))))


def regime_panel(s: SparkSession, d: str) -> DataFrame:
    """Prices with the regime of the day and the forward return."""
    return regime_returns.forward_return(regimes.attach_regimes(closes(s, d), regime_table(s, d)))


def labelled(s: SparkSession, d: str) -> DataFrame:
    return predictor.outperformance_label(closes(s, d), INDEX)


def model_panel(s: SparkSession, d: str) -> DataFrame:
    """Labelled panel with the model's features and regimes.

    The label comes first: its index side then reads closes only, not a panel with all features.
    """
    label = ["fwd_return_21d", "alsi_fwd_return_21d", "outperformed"]
    moved = signals.momentum(signals.rsi(signals.trend_signal(signals.moving_averages(labelled(s, d)))))
    features = signals.momentum_score(signals.cross_section_z(moved))
    kept = features.select("ticker", "date", "close", *fixed.MODEL_FEATURES, *label)
    return regimes.attach_regimes(kept, regime_table(s, d))


def momentum_picks(s: SparkSession, d: str) -> DataFrame:
    """Picks by momentum score on every rebalance date."""
    panel = signals.momentum_score(signals.cross_section_z(signals.momentum(labelled(s, d))))
    dates = backtest.rebalance_dates(inputs.prices(s, d)).select(F.col("rebalance_date").alias("date"))
    # One rebalance date per month.
    return backtest.top_picks(panel.join(F.broadcast(dates), "date"), "momentum_score", index_ticker=INDEX)


def momentum_results(s: SparkSession, d: str) -> DataFrame:
    return backtest.period_results(momentum_picks(s, d))


# Sources --------------------------------------------------------------------------------------------------------------


@query
def price_panel(s, d):
    return inputs.prices(s, d)


@query
def normalise_prices(s, d):
    """The panel laid out wide, one column per field and series, and brought back."""
    long = inputs.prices(s, d)
    tickers = names(long, "ticker")
    fields = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}
    wide = long.groupBy(F.col("date").alias("Date")).agg(
        *[
            F.expr(f"max({column}) FILTER (WHERE ticker = '{t}') AS `{field}|{t}`")
            for t in tickers
            for field, column in fields.items()
        ]
    )
    return normalise.normalise_prices(wide, {t: f"Series {t}" for t in tickers})


@query
def parse_observations(s, d):
    """Readings packed into one JSON document per series and year, "." where missing, and parsed again."""
    per_day = inputs.raw_readings(s, d)
    entry = F.expr("named_struct('date', cast(date AS string), 'value', coalesce(cast(value AS string), '.'))")
    documents = per_day.groupBy("series", F.year("date")).agg(
        F.to_json(F.struct(F.collect_list(entry).alias("observations"))).alias("payload")
    )
    return normalise.parse_observations(documents)


@query
def align_series(s, d):
    return normalise.align_series(inputs.observations(s, d), MACRO_LABELS)


@query
def normalise_annual(s, d):
    coded = inputs.annual(s, d).selectExpr(
        "cast(year AS string) AS time",
        "gdp_growth_pct AS `NY.GDP.MKTP.KD.ZG`",
        "govt_debt_gdp AS `GC.DOD.TOTL.GD.ZS`",
        "unemployment_pct AS `SL.UEM.TOTL.ZS`",
    )
    return normalise.normalise_annual(coded)


@query
def between_dates(s, d):
    return normalise.between_dates(inputs.prices(s, d), "1997-01-01", "1999-01-01").select("ticker", "date", "close")


@query
def coerce_numeric(s, d):
    """Volume as text with a placeholder on thin days, made numeric again."""
    text = inputs.prices(s, d).selectExpr(
        "ticker", "date", "CASE WHEN volume < 20 THEN 'n/a' ELSE cast(volume AS string) END AS volume"
    )
    return equity.coerce_numeric(text)


@query
def panel_catalog(s, d):
    return views.panel_catalog(inputs.prices(s, d))


@query
def freshness(s, d):
    """Latest data and rows per table; file ages depend on the clock and are left to ``freshness_report``."""
    tables = {"prices": inputs.prices(s, d), "macro": inputs.macro(s, d), "annual": inputs.annual(s, d)}
    parts = [snapshots.content_freshness(df, name) for name, df in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def freshness_report(s, d):
    """Two committed runs, and one that was broken off and so does not count, reported ten days later."""
    root = inputs.scratch_folder(s, "freshness")
    snapshots.write_snapshot(inputs.prices(s, d).where(F.col("date") < CUT_DAY), root, "prices", "2001-01-01")
    run = snapshots.Run(s, root, "2001-02-01")
    run.write(inputs.prices(s, d), "prices")
    run.write(inputs.annual(s, d), "annual")
    run.commit()
    broken = snapshots.Run(s, root, "2001-03-01")
    broken.write(inputs.annual(s, d).limit(0), "prices")
    return snapshots.freshness_report(s, root, ["prices", "macro", "annual"], F.date_add(F.current_date(), 10))


@query
def snapshot_history(s, d):
    """All runs of a table; the first one was written again, the last one never committed."""
    root = inputs.scratch_folder(s, "history")
    panel = closes(s, d).drop("name")
    snapshots.write_snapshot(panel.limit(10), root, "prices", "2001-01-01")
    snapshots.write_snapshot(panel.where(F.col("date") < CUT_DAY), root, "prices", "2001-01-01")
    snapshots.write_snapshot(panel, root, "prices", "2001-02-01")
    snapshots.Run(s, root, "2001-03-01").write(panel.limit(0), "prices")
    return snapshots.read_all_runs(s, root, "prices").withColumn("run_date", F.col("run_date").cast("string"))


@query
def best_panel(s, d):
    """The most enriched panel that has been committed, as it was in the run before the last."""
    root = inputs.scratch_folder(s, "panels")
    snapshots.write_snapshot(closes(s, d), root, "master", "2001-02-01")
    snapshots.write_snapshot(scored(s, d).select("ticker", "date", "momentum_score"), root, "panel_signals", "2001-01-01")
    snapshots.write_snapshot(scored(s, d).select("ticker", "date", "momentum_score").limit(5), root, "panel_signals", "2001-02-01")
    columns = snapshots.read_best_panel(s, root).columns
    return rounded(snapshots.read_previous(s, root, "panel_signals").select(*columns), "momentum_score")


@query
def master_without_annual(s, d):
    prices = inputs.prices(s, d).select("ticker", "date", "close")
    out = asof.build_master(prices, monthly(s, d).select("date", "tbill_rate", "zar_usd"))
    return rounded(out, "tbill_rate", "zar_usd")


# Prices ---------------------------------------------------------------------------------------------------------------


@query
def calendar_features(s, d):
    return equity.calendar_features(inputs.prices(s, d).select("ticker", "date"))


@query
def capped_ffill(s, d):
    """Days without trades become rows, then at most five of them in a row are filled."""
    dense = fill.densify(inputs.prices(s, d).select("ticker", "date", "close"))
    return fill.capped_ffill(dense, ["close"], fixed.PRICE_FILL_LIMIT)


@query
def daily_returns(s, d):
    out = equity.daily_returns(closes(s, d)).select("ticker", "date", "daily_return", "log_return")
    return rounded(out, "daily_return", "log_return")


@query
def volatility_21d(s, d):
    out = equity.volatility(equity.daily_returns(closes(s, d))).select("ticker", "date", "volatility_21d")
    return rounded(out, "volatility_21d")


@query
def high_low_52w(s, d):
    out = equity.year_range(closes(s, d)).select("ticker", "date", "high_52w", "low_52w", "pct_from_52w_high")
    return rounded(out, "pct_from_52w_high")


# Macro ----------------------------------------------------------------------------------------------------------------


@query
def macro_monthly(s, d):
    return rounded(macro.monthly_macro(inputs.macro(s, d)), *MACRO_LABELS)


@query
def macro_derived(s, d):
    derived = ["zar_usd_mom_pct", "cpi_yoy_pct", "real_tbill_rate", "yield_curve_spread"]
    return rounded(monthly(s, d).select("date", *derived), *derived)


@query
def asof_macro(s, d):
    out = asof.asof_backward(closes(s, d), monthly(s, d)).select(
        "ticker", "date", "tbill_rate", "govt_bond_10y", "cpi_yoy_pct", "exports_value"
    )
    return rounded(out, "tbill_rate", "govt_bond_10y", "cpi_yoy_pct", "exports_value")


@query
def asof_annual(s, d):
    out = asof.asof_backward(closes(s, d), asof.annual_readings(inputs.annual(s, d))).drop("close", "name")
    return rounded(out, "gdp_growth_pct", "govt_debt_gdp", "unemployment_pct")


@query
def asof_regime(s, d):
    return regimes.attach_regimes(closes(s, d), regime_table(s, d)).drop("close", "name")


# Signals --------------------------------------------------------------------------------------------------------------


@query
def momentum(s, d):
    out = signals.momentum(closes(s, d)).drop("close", "name")
    return rounded(out, *fixed.MOMENTUM_ROWS)


@query
def momentum_z(s, d):
    z = [f"{c}_z" for c in fixed.MOMENTUM_ROWS]
    return rounded(scored(s, d).select("ticker", "date", *z), *z)


@query
def momentum_score(s, d):
    return rounded(scored(s, d).select("ticker", "date", "momentum_score"), "momentum_score")


@query
def price_z(s, d):
    return rounded(signals.price_z(closes(s, d)).select("ticker", "date", "price_z_20d"), "price_z_20d")


@query
def moving_averages(s, d):
    out = signals.moving_averages(closes(s, d)).drop("close", "name")
    return rounded(rounded(out, "ma_50", "ma_200", places=4), "ma_ratio_50_200")


@query
def trend_signal(s, d):
    return signals.trend_signal(signals.moving_averages(closes(s, d))).select("ticker", "date", "trend_signal")


@query
def rsi_14(s, d):
    return rounded(signals.rsi(closes(s, d)).select("ticker", "date", "rsi_14"), "rsi_14")


@query
def rsi_2(s, d):
    return rounded(signals.rsi(closes(s, d), rows=2, column="rsi_2").select("ticker", "date", "rsi_2"), "rsi_2")


@query
def rsi_200(s, d):
    return rounded(signals.rsi(closes(s, d), rows=200, column="rsi_200").select("ticker", "date", "rsi_200"), "rsi_200")


@query
def month_start_leaders(s, d):
    """Flagship: point-in-time rate and the five strongest one-month movers on the first trading day of each month."""
    strength = signals.cross_section_z(signals.momentum(closes(s, d), windows={"mom_1m": 21}), ["mom_1m"])
    panel = asof.asof_backward(strength, monthly(s, d).select("date", "tbill_rate"))
    dates = backtest.rebalance_dates(inputs.prices(s, d), 0).select(F.col("rebalance_date").alias("date"))
    best = W.partitionBy("date").orderBy(F.desc("mom_1m_z"), "ticker")
    # One first trading day per month.
    ranked = panel.join(F.broadcast(dates), "date").where(F.col("mom_1m_z").isNotNull() & (F.col("ticker") != INDEX))
    top = ranked.withColumn("rank", F.row_number().over(best)).where("rank <= 5")
    return rounded(top.select("date", "rank", "ticker", "mom_1m_z", "tbill_rate"), "mom_1m_z", "tbill_rate")


# Regimes --------------------------------------------------------------------------------------------------------------


@query
def regime_labels(s, d):
    return rounded(regime_table(s, d), "tbill_rate", "cpi_yoy_pct", "zar_usd")


@query
def regime_changes(s, d):
    return regimes.spell_positions(regime_table(s, d).select("date", "composite_regime"))


@query
def months_per_regime(s, d):
    return regimes.months_per_regime(regime_table(s, d))


@query
def spells(s, d):
    return regimes.spells(regime_table(s, d))


@query
def spell_summary(s, d):
    return regimes.spell_summary(regime_table(s, d))


# Correlations ---------------------------------------------------------------------------------------------------------


def rolling_table(s: SparkSession, d: str) -> DataFrame:
    panel = asof.asof_backward(equity.daily_returns(closes(s, d)), monthly(s, d))
    return correlation.rolling_correlations(panel)


@query
def rolling_corr(s, d):
    return rounded(rolling_table(s, d), "rolling_corr", places=5)


@query
def rolling_corr_summary(s, d):
    return correlation.rolling_correlation_summary(rolling_table(s, d))


@query
def corr_slice(s, d):
    return rounded(views.correlation_slice(rolling_table(s, d), "Brand#7", "cpi_yoy_pct"), "rolling_corr", places=5)


@query
def corr_matrix(s, d):
    return rounded(correlation.correlation_matrix(equity.daily_returns(closes(s, d))), "correlation")


# Regime analysis ------------------------------------------------------------------------------------------------------


@query
def forward_label(s, d):
    out = labelled(s, d).drop("close", "name")
    return rounded(out, "fwd_return_21d", "alsi_fwd_return_21d")


@query
def ticker_regime_returns(s, d):
    return rounded(regime_returns.ticker_regime_returns(regime_panel(s, d)), "avg_fwd_return_pct")


@query
def regime_heatmap(s, d):
    out = regime_returns.regime_heatmap(regime_returns.ticker_regime_returns(regime_panel(s, d)))
    return rounded(out, *fixed.REGIME_ORDER, "mean_across_regimes")


@query
def reliable_cells(s, d):
    out = regime_returns.reliable_cells(regime_panel(s, d), regime_table(s, d))
    return rounded(out, "avg_fwd_return_pct")


@query
def momentum_efficacy(s, d):
    panel = regimes.attach_regimes(regime_returns.forward_return(scored(s, d)), regime_table(s, d))
    return rounded(regime_returns.momentum_efficacy(panel), "correlation")


@query
def hedges(s, d):
    return rounded(regime_returns.regime_hedges(regime_panel(s, d)), "HIKING", "CUTTING", "NEUTRAL", "gap")


@query
def best_hedges(s, d):
    out = regime_returns.best_hedges(regime_returns.regime_hedges(regime_panel(s, d)))
    return rounded(out, "HIKING", "CUTTING", "NEUTRAL", "gap")


@query
def regime_ranking(s, d):
    return rounded(regime_returns.current_regime_ranking(regime_panel(s, d)), "avg_fwd_return_pct", "win_rate_pct")


# Markov chain ---------------------------------------------------------------------------------------------------------


@query
def transition_matrix(s, d):
    return rounded(markov.fit_transitions(regime_table(s, d)), "probability")


@query
def transition_matrix_wide(s, d):
    """All labels as columns, also those that do not occur."""
    matrix = markov.fit_transitions(regime_table(s, d))
    states = [f"{a}_{b}" for a in ("HIKING", "CUTTING", "NEUTRAL") for b in ("LOW_INFLATION", "TARGET_INFLATION", "HIGH_INFLATION", "nan")]
    return rounded(markov.wide_matrix(matrix, states), *states)


@query
def next_regime(s, d):
    """What followed the most frequent regime."""
    table = regime_table(s, d)
    counted = regimes.months_per_regime(table)
    common = counted.agg(F.max_by("regime", F.struct("total_months", "regime"))).scalar()
    return rounded(markov.next_regime_probabilities(markov.fit_transitions(table), common), "probability")


@query
def regime_confidence(s, d):
    return markov.regime_confidence(markov.fit_transitions(regime_table(s, d)))


@query
def expected_duration(s, d):
    return rounded(markov.expected_duration(markov.fit_transitions(regime_table(s, d))), "expected_duration_months")


@query
def markov_report(s, d):
    return rounded(markov.markov_report(regime_table(s, d)), "expected_duration_months")


@query
def event_transitions(s, d):
    """Transitions between event types along each user's events, a long sequence cut into segments."""
    history = inputs.table(s, d, "events").select("user_id", "event_id", "event_type")
    pairs = markov.transition_pairs(history, "event_type", "event_id", ["user_id"], rows_per_segment=100_000)
    return rounded(markov.transition_matrix(pairs.select("from", "to")), "probability")


# Long series ----------------------------------------------------------------------------------------------------------


def ticks(s: SparkSession, d: str) -> DataFrame:
    """Event values as one series per event type: few series, any number of rows each."""
    return inputs.table(s, d, "events").selectExpr("event_type AS ticker", "ts", "event_id", "value AS close")


def along_ticks(s: SparkSession, d: str, transform, back: int = 0, ahead: int = 0) -> DataFrame:
    def step(rows: DataFrame, keys) -> DataFrame:
        return transform(rows.withColumn("date", F.col(segments.POSITION)), keys)

    return segments.in_segments(ticks(s, d), step, ["ticker"], ["ts", "event_id"], back, ahead, 10_000)


@query
def tick_moving_averages(s, d):
    out = along_ticks(s, d, signals.moving_averages, back=199).select("event_id", "ma_50", "ma_200")
    return rounded(out, "ma_50", "ma_200", places=9)


@query
def tick_forward_return(s, d):
    out = along_ticks(s, d, lambda rows, keys: regime_returns.forward_return(rows, 21, keys), ahead=21)
    return rounded(out.select("event_id", "fwd_return_21d"), "fwd_return_21d")


@query
def tick_rsi(s, d):
    return rounded(scan.long_rsi(ticks(s, d), ["ticker"], ["ts", "event_id"], 14).select("event_id", "rsi_14"), "rsi_14")


@query
def tick_rsi_200(s, d):
    return rounded(scan.long_rsi(ticks(s, d), ["ticker"], ["ts", "event_id"], 200).select("event_id", "rsi_200"), "rsi_200")


@query
def tick_compounded(s, d):
    """Values as returns in thousandths of a percent, compounded along each series and along all events as one."""
    moved = ticks(s, d).withColumn("step", F.col("close") / 1e5 - 5e-4)
    own = scan.compounded(moved, ["ticker"], ["ts", "event_id"], {"step": "own"})
    both = scan.compounded(own, [], ["ts", "event_id"], {"step": "overall"})
    return rounded(both.select("event_id", "own", "overall"), "own", "overall")


@query
def tick_filled(s, d):
    """Values of 20 and more count as missing; the last known one stands for up to five rows."""
    holes = ticks(s, d).withColumn("close", F.when(F.col("close") < 20, F.col("close")))
    filled = scan.filled_forward(holes, ["ticker"], ["ts", "event_id"], ["close"], fixed.PRICE_FILL_LIMIT)
    unbounded = scan.filled_forward(holes.select("event_id", "ticker", "ts", F.col("close").alias("last")), [], ["ts", "event_id"], ["last"])
    return filled.select("event_id", "close").join(unbounded.select("event_id", "last"), "event_id")


@query
def tick_spell_rows(s, d):
    """Runs of values on one side of 50, per event type: changes, numbers and durations of all rows."""
    sided = ticks(s, d).withColumn("side", F.when(F.col("close") >= 50, "high").otherwise("low"))
    return scan.numbered_spells(sided, ["ticker"], ["ts", "event_id"], "side").select("event_id", "state_changed", "spell", "spell_duration")


@query
def event_spells(s, d):
    """Runs of one event type in the whole stream, which is a single series."""
    events = inputs.table(s, d, "events").select("ts", "event_id", "event_type")
    return scan.long_spells(events, [], ["event_id"], "event_type")


@query
def asof_clicks(s, d):
    """Purchases with the user's last click, and with the last signup of anyone, at the moment they were made."""
    events = inputs.table(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    signups = events.where("event_type = 'signup'").select("ts", F.col("event_id").alias("signup_id"))
    bought = events.where("event_type = 'purchase'").drop("event_type")
    return scan.asof_ordered(scan.asof_ordered(bought, clicks, "ts", ["user_id"]), signups, "ts")


@query
def price_quantiles(s, d):
    lines = inputs.table(s, d, "lineitem").select("l_returnflag", "l_extendedprice")
    shares = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
    own = scan.exact_quantiles(lines, "l_extendedprice", shares, ["l_returnflag"])
    overall = scan.exact_quantiles(lines, "l_extendedprice", shares).withColumn("l_returnflag", F.lit("all"))
    return rounded(own.unionByName(overall), "value")


# Quality --------------------------------------------------------------------------------------------------------------


@query
def dq_missing(s, d):
    return quality.missing_closes(fill.densify(closes(s, d)))


@query
def dq_frozen(s, d):
    coarse = closes(s, d).withColumn("close", F.floor(F.col("close") / 1000).cast("double"))
    return quality.frozen_prices(coarse, rows=4)


@query
def dq_completeness(s, d):
    return quality.macro_completeness(inputs.macro(s, d).withColumn("cpi_core", F.lit(None).cast("double")))


@query
def dq_rowcount(s, d):
    panel = closes(s, d)
    return quality.row_count_regression(normalise.between_dates(panel, end=CUT_DAY), panel)


@query
def dq_all(s, d):
    dense = fill.densify(closes(s, d))
    issues = quality.run_all_checks(
        s, dense, inputs.macro(s, d), normalise.between_dates(dense, end=CUT_DAY), dense
    )
    return quality.has_errors(issues)


# Views ----------------------------------------------------------------------------------------------------------------


@query
def snapshot_asof(s, d):
    panel = regime_returns.forward_return(equity.daily_returns(closes(s, d)))
    kept = panel.select("ticker", "date", "close", "daily_return", "fwd_return_21d")
    # The end of the data, so that the last known forward return comes from an earlier row than the last close.
    out = asof.snapshot_asof(kept, F.lit("2001-12-31").cast("date"))
    return rounded(out, "daily_return", "fwd_return_21d")


@query
def ticker_slice(s, d):
    return views.ticker_slice(closes(s, d), "Brand#3", "1996-03-01", "1998-06-30")


@query
def macro_view(s, d):
    return rounded(views.macro_view(monthly(s, d)), *views.MACRO_VIEW_COLUMNS)


@query
def momentum_ranking(s, d):
    moved = signals.momentum(signals.rsi(signals.trend_signal(signals.moving_averages(closes(s, d)))))
    panel = signals.momentum_score(signals.cross_section_z(moved))
    return views.signal_snapshot(panel.select("date", "ticker", "name", *views.SIGNAL_COLUMNS), CUT_DAY)


@query
def latest_regime(s, d):
    return rounded(views.latest_regime(regime_table(s, d)), "tbill_rate", "cpi_yoy_pct")


# Model and backtest ---------------------------------------------------------------------------------------------------


@query
def rebalance_dates(s, d):
    return backtest.rebalance_dates(inputs.prices(s, d))


@query
def rebalance_dates_embargo(s, d):
    return backtest.rebalance_dates(inputs.prices(s, d), embargo_rows=21)


@query
def chrono_split(s, d):
    train, test = predictor.chronological_split(closes(s, d), F.lit(CUT_DAY).cast("date"))
    parts = [df.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")).withColumn("part", F.lit(name)) for name, df in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1])


@query
def topn_picks(s, d):
    out = momentum_picks(s, d).select("date", "pick_rank", "ticker", "momentum_score", "fwd_return_21d")
    return rounded(out, "momentum_score", "fwd_return_21d")


RESULT_NUMBERS = ("portfolio_return", "alsi_return", "excess_return", "net_excess_return")


@query
def period_results(s, d):
    return rounded(momentum_results(s, d), *RESULT_NUMBERS)


@query
def cumulative_excess(s, d):
    """Compounding reaches any order of magnitude, so eight decimals of the leading digit are compared."""
    out = backtest.cumulative_excess(momentum_results(s, d))
    return out.selectExpr(
        "rebalance_date",
        "cast(format_string('%.8e', cumulative_net_excess) AS double) AS cumulative_net_excess",
        "cast(format_string('%.8e', cumulative_gross_excess) AS double) AS cumulative_gross_excess",
    )


@query
def rolling_hit_rate(s, d):
    out = backtest.rolling_hit_rate(momentum_results(s, d)).select("rebalance_date", "rolling_hit_rate_12m")
    return rounded(out, "rolling_hit_rate_12m")


@query
def backtest_summary(s, d):
    return backtest.backtest_summary(momentum_results(s, d))


@query
def return_distribution(s, d):
    out = backtest.return_distribution(momentum_results(s, d))
    return rounded(out, "mean", "std", "min", "p25", "p50", "p75", "max")


@query
def return_histogram(s, d):
    return rounded(backtest.return_histogram(momentum_results(s, d)), "low_edge", "high_edge")


@query
def feature_matrix(s, d):
    out = predictor.feature_matrix(model_panel(s, d), fixed.REGIME_ORDER, keep=("ticker", "date"))
    return rounded(out, "momentum_score", "rsi_14")


@query
def standardisation(s, d):
    matrix = predictor.feature_matrix(predictor.training_rows(model_panel(s, d)), fixed.REGIME_ORDER)
    return rounded(predictor.standardisation(matrix, matrix.columns), "mean", "scale")


@query
def class_check(s, d):
    return rounded(predictor.class_check(labelled(s, d)), "base_rate")


@query
def fit_coefficients(s, d):
    return rounded(predictor.fit_model(model_panel(s, d)).coefficient_table(s), "coefficient", places=5)


@query
def predict_proba(s, d):
    """Fitted before the cut day, scored from then on."""
    train, test = predictor.chronological_split(model_panel(s, d), F.lit(CUT_DAY).cast("date"))
    out = predictor.fit_model(train).predict(test).select("ticker", "date", "predicted_proba", "outperformed")
    return rounded(out, "predicted_proba", places=5)


@query
def walk_forward(s, d):
    out = walkforward.walk_forward(model_panel(s, d), index_ticker=INDEX, with_status=True)
    return rounded(out, "portfolio_return", "alsi_return", "excess_return", "net_excess_return")


def dated_models(s: SparkSession, d: str) -> walkforward.DatedModels:
    panel = model_panel(s, d)
    return walkforward.fit_dated_models(panel, backtest.rebalance_dates(panel))


@query
def walk_forward_fits(s, d):
    """How the fit of each rebalance date ended."""
    return dated_models(s, d).fit_table(s).select("rebalance_date", "train_rows", "converged")


@query
def walk_forward_coefficients(s, d):
    return rounded(dated_models(s, d).coefficient_table(s), "coefficient", places=5)


@query
def enriched_panel(s, d):
    """The most enriched panel of a full refresh: processed prices, macro, annual, signals and regimes."""
    tables = refresh.build_tables(inputs.prices(s, d), inputs.macro(s, d), inputs.annual(s, d), keep_for_reuse)
    panel = tables["panel_regimes"]
    exact = {*fixed.PRICE_COLUMNS, "high_52w", "low_52w", "ma_50", "ma_200"}
    loose = [f.name for f in panel.schema.fields if f.dataType.typeName() == "double" and f.name not in exact]
    return rounded(rounded(panel, *loose), "ma_50", "ma_200", places=4)
