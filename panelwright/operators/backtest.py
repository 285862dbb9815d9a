"""Monthly rebalancing: dates, picks, period returns and their statistics.

Tables here have one row per rebalance date, so windows over them are short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions import fixed_values as fixed
from panelwright.functions.guarded import ratio

RESULT_COLUMNS = (
    "rebalance_date",
    "picked_tickers",
    "portfolio_return",
    "alsi_return",
    "excess_return",
    "net_excess_return",
    "beat_alsi",
)


def rebalance_dates(
    panel: DataFrame, min_train_months: int = fixed.MIN_TRAIN_MONTHS, embargo_rows: int = 0
) -> DataFrame:
    """First trading date of every month after the first ``min_train_months`` ones, with the training cutoff.

    Training rows lie strictly before the cutoff: the rebalance date itself, or ``embargo_rows`` trading days earlier.
    """
    days = panel.select("date").distinct()
    timeline = W.orderBy("date")
    marked = days.select(
        "date",
        F.trunc("date", "MM").alias("_month"),
        (F.lag("date", embargo_rows) if embargo_rows else F.max("date")).over(
            timeline if embargo_rows else timeline.rowsBetween(0, 0)
        ).alias("cutoff"),
    )
    first = marked.groupBy("_month").agg(F.min(F.struct("date", "cutoff")).alias("_first"))
    ranked = first.withColumn("_nth", F.row_number().over(W.orderBy("_month")))
    return ranked.where(F.col("_nth") > min_train_months).select(
        F.col("_first.date").alias("rebalance_date"), F.col("_first.cutoff").alias("cutoff")
    )


def top_picks(
    candidates: DataFrame,
    score: str,
    n: int = fixed.TOP_PICKS,
    index_ticker: str = fixed.INDEX_TICKER,
    date: str = "date",
) -> DataFrame:
    """The ``n`` best-scored series of each date, ties by ticker; dates with fewer than ``n`` candidates are left out.

    The rank filter is pushed below the shuffle by Spark, so a date with very many series sends only ``n`` rows per
    task on. Whether a date has enough candidates shows in the number of its surviving rows.
    """
    valid = candidates.where(
        F.col(score).isNotNull() & F.col("fwd_return_21d").isNotNull() & (F.col("ticker") != index_ticker)
    )
    best = W.partitionBy(date).orderBy(F.desc(score), "ticker")
    kept = valid.withColumn("pick_rank", F.row_number().over(best)).where(F.col("pick_rank") <= n)
    return kept.withColumn("_kept", F.count(F.lit(1)).over(W.partitionBy(date))).where(F.col("_kept") == n).drop(
        "_kept"
    )


def period_results(
    picks: DataFrame, cost_bps: float = fixed.REBALANCE_COST_BPS, date: str = "date"
) -> DataFrame:
    """Equal-weight return of the picks against the index, before and after the cost of one rebalance."""
    ordered = F.array_sort(F.collect_list(F.struct("pick_rank", "ticker")))
    per_date = picks.groupBy(F.col(date).alias("rebalance_date")).agg(
        F.array_join(F.transform(ordered, lambda p: p["ticker"]), ", ").alias("picked_tickers"),
        F.avg("fwd_return_21d").alias("portfolio_return"),
        F.first("alsi_fwd_return_21d").alias("alsi_return"),
    )
    excess = F.col("portfolio_return") - F.col("alsi_return")
    return (
        per_date.withColumn("excess_return", excess)
        .withColumn("net_excess_return", F.col("excess_return") - F.lit(cost_bps / 10_000))
        .withColumn("beat_alsi", F.coalesce(F.col("excess_return") > 0, F.lit(False)))
        .select(*RESULT_COLUMNS)
    )


def cumulative_excess(results: DataFrame) -> DataFrame:
    """Compounded excess return up to each rebalance date, gross and net."""
    so_far = W.orderBy("rebalance_date").rowsBetween(W.unboundedPreceding, 0)

    def compounded(column: str) -> Column:
        return F.product(F.lit(1.0) + F.col(column)).over(so_far) - 1

    return results.withColumns(
        {
            "cumulative_net_excess": compounded("net_excess_return"),
            "cumulative_gross_excess": compounded("excess_return"),
        }
    )


def rolling_hit_rate(results: DataFrame, periods: int = 12, min_periods: int = 6) -> DataFrame:
    recent = W.orderBy("rebalance_date").rowsBetween(-(periods - 1), 0)
    hit = F.col("beat_alsi").cast("int")
    rate = F.when(F.count(hit).over(recent) >= min_periods, F.avg(hit).over(recent))
    return results.withColumn("rolling_hit_rate_12m", rate)


def backtest_summary(results: DataFrame) -> DataFrame:
    """One row: periods, hit rate, mean excess gross and net, annualised mean over deviation, and a note on size."""
    n = F.col("n_periods")
    measured = results.agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.round(F.avg(F.col("beat_alsi").cast("int")), 3).alias("hit_rate"),
        F.round(F.avg("excess_return"), 4).alias("avg_excess_return_gross"),
        F.round(F.avg("net_excess_return"), 4).alias("avg_excess_return_net"),
        F.avg("net_excess_return").alias("_mean"),
        F.stddev_samp("net_excess_return").alias("_deviation"),
        F.min("net_excess_return").alias("_low"),
        F.max("net_excess_return").alias("_high"),
    )
    sharpe = F.when(F.col("_low") < F.col("_high"), ratio(F.col("_mean"), F.col("_deviation")) * F.sqrt(F.lit(12.0)))
    note = (
        F.when(n == 0, F.lit("No rebalance period could be evaluated."))
        .when(
            n < fixed.THIN_SAMPLE_PERIODS,
            F.concat(n.cast("string"), F.lit(" monthly periods: a thin sample, read with caution.")),
        )
        .otherwise(F.concat(n.cast("string"), F.lit(" monthly periods: one historical path, no guarantee.")))
    )
    return measured.select(
        "n_periods",
        "hit_rate",
        "avg_excess_return_gross",
        "avg_excess_return_net",
        F.round(sharpe, 2).alias("sharpe_style_ratio"),
        note.alias("note"),
    )


def return_distribution(results: DataFrame, column: str = "net_excess_return") -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum of the period returns."""
    quartiles = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return results.agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        quartiles.alias("_q"),
        F.max(column).alias("max"),
    ).select(
        "count",
        "mean",
        "std",
        "min",
        F.col("_q")[0].alias("p25"),
        F.col("_q")[1].alias("p50"),
        F.col("_q")[2].alias("p75"),
        "max",
    )


def return_histogram(results: DataFrame, column: str = "net_excess_return", bins: int = 30) -> DataFrame:
    """Counts in equal bins between the smallest and the largest value; the largest falls into the last bin.

    All bins are there, with their edges, also those without a value. Equal values span nothing and are one bin, without
    width; no value at all: no rows.
    """
    value = F.col(column).cast("double")
    span = results.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    ranged = results.where(value.isNotNull()).select(value.alias("_v")).crossJoin(F.broadcast(span))  # one row
    place = F.floor(ratio(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low")) * bins)
    bucket = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)) + 1
    counts = ranged.groupBy(bucket.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    last = F.when(F.col("_low") < F.col("_high"), bins).otherwise(1)
    every = span.where(F.col("_low").isNotNull()).withColumn("bin", F.explode(F.sequence(F.lit(1), last)))
    rows = every.join(counts, "bin", "left")
    width = (F.col("_high") - F.col("_low")) / bins
    return rows.select(
        "bin",
        (F.col("_low") + width * (F.col("bin") - 1)).alias("low_edge"),
        (F.col("_low") + width * F.col("bin")).alias("high_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
