"""Data-quality findings as rows of (severity, check, message). Checks report, they never fail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions import fixed_values as fixed
from panelwright.functions.guarded import ratio

Keys = Sequence[str]
ISSUE_SCHEMA = "severity string, check string, message string"


def _issue(severity: str, check: str, message) -> list:
    return [F.lit(severity).alias("severity"), F.lit(check).alias("check"), message.alias("message")]


def _single(spark: SparkSession, severity: str, check: str, message: str) -> DataFrame:
    return spark.createDataFrame([(severity, check, message)], ISSUE_SCHEMA)


def missing_closes(
    prices: DataFrame, max_missing_pct: float = fixed.MAX_MISSING_PCT, key: str = "ticker"
) -> DataFrame:
    """Series with more than the allowed share of missing closes."""
    if key not in prices.columns or "close" not in prices.columns:
        return _single(
            prices.sparkSession, "WARNING", "missing_trading_days", "price table lacks the series or close column"
        )
    share = prices.groupBy(key).agg(F.avg(F.when(F.col("close").isNull(), 100.0).otherwise(0.0)).alias("_pct"))
    text = F.format_string(
        f"%s: %.1f%% of close prices are missing (threshold {max_missing_pct}%%)", F.col(key), F.col("_pct")
    )
    return share.where(F.col("_pct") > max_missing_pct).select(*_issue("WARNING", "missing_trading_days", text))


def last_rows(df: DataFrame, n: int, keys: Keys = ("ticker",), order: str = "date") -> DataFrame:
    """The last ``n`` rows of each series. Spark applies the rank limit before the shuffle, ``n`` rows per task."""
    latest = W.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_nth", F.row_number().over(latest)).where(F.col("_nth") <= n).drop("_nth")


def frozen_prices(prices: DataFrame, rows: int = fixed.FROZEN_ROWS, key: str = "ticker") -> DataFrame:
    """Series whose last ``rows`` closes are all present and all the same."""
    if key not in prices.columns or "close" not in prices.columns:
        return prices.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    recent = last_rows(prices.select(key, "date", "close"), rows, (key,))
    spread = recent.groupBy(key).agg(F.count("close").alias("_n"), F.min("close").alias("_lo"), F.max("close").alias("_hi"))
    text = F.format_string(f"%s: close has not changed over the last {rows} rows", F.col(key))
    flat = spread.where((F.col("_n") >= rows) & (F.col("_lo") == F.col("_hi")))
    return flat.select(*_issue("WARNING", "frozen_price_feed", text))


def macro_completeness(
    macro: DataFrame, min_observations: int = fixed.MIN_MACRO_OBSERVATIONS, by: Keys = ()
) -> DataFrame:
    """Columns with too few readings (a warning, or an error at zero), and an empty table (an error)."""
    by = list(by)
    series = [c for c in macro.columns if c != "date" and c not in by]
    counted = macro.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.array(*[F.struct(F.lit(c).alias("name"), F.count(c).alias("n")) for c in series]).alias("_series"),
    )
    listed = counted.select(*by, "_rows", F.explode_outer("_series").alias("_s")).select(*by, "_rows", "_s.name", "_s.n")
    prefix = F.concat(*[x for b in by for x in (F.col(b).cast("string"), F.lit(": "))]) if by else F.lit("")
    text = F.format_string(
        f"%s'%s': only %d non-null observation(s) (threshold {min_observations})", prefix, F.col("name"), F.col("n")
    )
    few = listed.where((F.col("_rows") > 0) & (F.col("n") < min_observations)).select(
        F.when(F.col("n") == 0, "ERROR").otherwise("WARNING").alias("severity"),
        F.lit("macro_completeness").alias("check"),
        text.alias("message"),
    )
    if by:
        return few
    empty = counted.where(F.col("_rows") == 0).select(
        *_issue("ERROR", "macro_completeness", F.lit("macro table is empty"))
    )
    return few.unionByName(empty)


def row_count_regression(
    current: DataFrame, previous: DataFrame | None, max_drop_pct: float = fixed.MAX_ROW_DROP_PCT
) -> DataFrame:
    """An error when the row count fell by more than the allowed share. No previous table or no rows: no finding."""
    spark = current.sparkSession
    if previous is None:
        return spark.createDataFrame([], ISSUE_SCHEMA)
    now = current.agg(F.count(F.lit(1)).alias("_n")).scalar()
    before = previous.agg(F.count(F.lit(1)).alias("_before"))
    counts = before.withColumn("_now", now)
    drop = ratio((F.col("_before") - F.col("_now")) * 100.0, F.col("_before").cast("double"))
    text = F.format_string(
        "row count dropped %.1f%% (%d -> %d) against the previous run", F.col("_drop"), F.col("_before"), F.col("_now")
    )
    return counts.withColumn("_drop", drop).where(F.col("_drop") > max_drop_pct).select(
        *_issue("ERROR", "row_count_regression", text)
    )


def run_all_checks(
    spark: SparkSession,
    prices: DataFrame | None = None,
    macro: DataFrame | None = None,
    master: DataFrame | None = None,
    previous_master: DataFrame | None = None,
) -> DataFrame:
    """Findings of every check whose input is given."""
    parts = [spark.createDataFrame([], ISSUE_SCHEMA)]
    if prices is not None:
        parts += [missing_closes(prices), frozen_prices(prices)]
    if macro is not None:
        parts.append(macro_completeness(macro))
    if master is not None:
        # An empty current table is skipped, as if it had not been given.
        parts.append(row_count_regression(master, previous_master).where(_has_rows(master)))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _has_rows(df: DataFrame):
    return df.agg(F.count(F.lit(1)).alias("_n")).scalar() > 0


def has_errors(issues: DataFrame) -> DataFrame:
    """One row: whether any finding is an error, and the number of errors and warnings."""
    return issues.agg(
        F.coalesce(F.bool_or(F.col("severity") == "ERROR"), F.lit(False)).alias("has_errors"),
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"),
    )
