"""Raw inputs to standard tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import fixed_values as fixed
from panelwright.functions.guarded import number_or_null

QUOTE_SCHEMA = "date date, ticker string, open double, high double, low double, close double, volume double, name string"
OBSERVATIONS = "struct<observations: array<struct<date: string, value: string>>>"


def normalise_prices(wide: DataFrame, names: Mapping[str, str], date_column: str = "Date", separator: str = "|") -> DataFrame:
    """Wide quotes, one column per ``<Field>|<ticker>``, to one row per (date, ticker) with a name.

    Each wide row already holds all its quotes, so it is turned into rows in place: no shuffle, no pivot, no join. The
    columns of a field become one array, and the arrays are exploded side by side; the plan is a line of SQL text that
    grows with the columns and no tree of them, so thousands of series plan within seconds.
    Rows without a close are dropped. Timestamps are cut to their date.
    """
    quoted: dict[str, dict[str, str]] = {}
    for column in wide.columns:
        field, found, ticker = column.partition(separator)
        if found and field in fixed.QUOTE_FIELDS:
            quoted.setdefault(ticker, {})[field] = column
    tickers = sorted(quoted)
    if not tickers:
        return wide.sparkSession.createDataFrame([], QUOTE_SCHEMA)
    types = {f.name: f.dataType for f in wide.schema.fields}

    def listed(raw: str) -> str:
        columns = [quoted[t].get(raw) for t in tickers]
        # Columns of one type share an array as they are; of several, they meet as text.
        kind = "{}" if len({types[c] for c in columns if c}) == 1 else "CAST({} AS string)"
        cells = [kind.format("`" + c.replace("`", "``") + "`") if c else "NULL" for c in columns]
        return f"array({', '.join(cells)})"

    labels = [names.get(t) for t in tickers]
    arrays = [_text_array(tickers), _text_array(labels), *map(listed, fixed.QUOTE_FIELDS)]
    rows = wide.select(
        F.to_date(date_column).alias("date"), F.expr(f"inline(arrays_zip({', '.join(arrays)}))").alias("ticker", "name", *fixed.QUOTE_FIELDS.values())
    )
    numbers = [number_or_null(F.col(c)).alias(c) for c in fixed.QUOTE_FIELDS.values()]
    return rows.select("date", "ticker", *numbers, F.col("name").cast("string").alias("name")).where(F.col("close").isNotNull())


def _text_array(values: Sequence[str | None]) -> str:
    """SQL text of an array of texts, quoted raw; a quotation mark inside becomes a character code."""
    cells = ["NULL" if v is None else "concat(" + ", chr(39), ".join(f"r'{part}'" for part in v.split("'")) + ")" if "'" in v else f"r'{v}'" for v in values]
    return f"array({', '.join(cells)})"


def parse_observations(raw: DataFrame, payload: str = "payload", series: str = "series") -> DataFrame:
    """(series, date, value) from JSON documents ``{"observations": [{"date", "value"}]}``.

    "." and other non-numbers are missing values; a document without observations gives no rows.
    """
    parsed = raw.select(series, F.from_json(payload, OBSERVATIONS)["observations"].alias("_o"))
    listed = parsed.select(series, F.explode("_o").alias("_o"))
    return listed.select(
        series, F.col("_o.date").try_cast("date").alias("date"), number_or_null(F.col("_o.value")).alias("value")
    )


def align_series(long: DataFrame, labels: Mapping[str, str] = fixed.MACRO_SERIES, by: Sequence[str] = ()) -> DataFrame:
    """One column per series label on the union of all dates.

    The columns are known beforehand, so this is one aggregation with map-side combine and no discovery pass.
    """
    return long.groupBy(*by, "date").agg(
        *[F.max(F.when(F.col("series") == code, F.col("value"))).alias(label) for code, label in labels.items()]
    )


def normalise_annual(
    wide: DataFrame, indicators: Mapping[str, str] = fixed.ANNUAL_INDICATORS, year_column: str | None = None
) -> DataFrame:
    """Rename indicator codes, make the year an integer, drop rows without a usable year."""
    year = year_column or wide.columns[0]
    renamed = wide.withColumnsRenamed({year: "year", **{k: v for k, v in indicators.items() if k in wide.columns}})
    whole = number_or_null(F.col("year")).try_cast("int")
    return renamed.withColumn("year", whole).where(F.col("year").isNotNull())


def between_dates(
    df: DataFrame,
    start: date | str | None = None,
    end: date | str | None = None,
    column: str = "date",
    inclusive: bool = False,
) -> DataFrame:
    """Rows from ``start`` on and before ``end``, or up to it if ``inclusive``; as a comparison it is pushed into the scan."""
    kept = df
    if start is not None:
        kept = kept.where(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        last = F.lit(end).cast("date")
        kept = kept.where(F.col(column) <= last if inclusive else F.col(column) < last)
    return kept


def between_years(df: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    kept = df
    if first is not None:
        kept = kept.where(F.col("year") >= first)
    if last is not None:
        kept = kept.where(F.col("year") <= last)
    return kept
