"""Panel inputs derived from the given tables.

prices  one row per (brand, ship day), plus the same over all brands as the index series
macro   daily, month-end, quarter-end and year-end series from the orders of each day
annual  one row per order year
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.sources.normalise import align_series

INDEX = "^INDEX"
MACRO_LABELS = {c: c for c in ("tbill_rate", "govt_bond_10y", "cpi_all", "zar_usd", "usd_eur", "exports_value", "imports_value")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one of ``spark.checkpoint.dir``; where that is unset, as in local tests, in our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume-weighted close and price range per series and day.

    Sums are taken over whole cents and pieces, so that they do not depend on the order of addition (amounts are
    positive, so adding a half and cutting off rounds them). A brand with very
    many lines is reduced per task before the shuffle; the index series is added to the already reduced rows.
    """
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey",
        "to_date(l_shipdate) AS date",
        "cast(l_extendedprice * 100 + 0.5D AS bigint) AS cents",
        "cast(l_quantity AS bigint) AS pieces",
    )
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "p_brand AS brand")
    daily = (
        lines.join(parts, "l_partkey")
        .groupBy("brand", "date")
        .agg(
            F.expr("sum(cents) AS cents"),
            F.expr("sum(pieces) AS pieces"),
            F.expr("max(cents / pieces) AS high"),
            F.expr("min(cents / pieces) AS low"),
        )
    )
    both = daily.selectExpr(f"explode(array(brand, '{INDEX}')) AS ticker", "date", "cents", "pieces", "high", "low")
    summed = both.groupBy("ticker", "date").agg(
        F.expr("sum(cents) AS cents"), F.expr("sum(pieces) AS pieces"), F.expr("max(high) AS high"), F.expr("min(low) AS low")
    )
    return summed.selectExpr(
        "date",
        "ticker",
        "(high + low) / 2 / 100D AS open",
        "high / 100D AS high",
        "low / 100D AS low",
        "cents / pieces / 100D AS close",
        "cast(pieces AS double) AS volume",
        "concat('Series ', ticker) AS name",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_readings(spark, sf_dir).where("value IS NOT NULL")


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, value): two daily series, two monthly, one quarterly and two yearly ones, NULL where not given."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "to_date(o_orderdate) AS day",
        "cast(o_totalprice * 100 + 0.5D AS bigint) AS cents",
        "o_orderpriority = '1-URGENT' AS urgent",
        "o_orderstatus AS status",
    )
    daily = orders.groupBy("day").agg(
        F.expr("sum(cents) AS cents"),
        F.expr("count(*) AS n"),
        F.expr("sum(cents) FILTER (WHERE urgent) AS urgent"),
        F.expr("count_if(urgent) AS n_urgent"),
        F.expr("sum(cents) FILTER (WHERE status = 'F') AS filled"),
        F.expr("sum(cents) FILTER (WHERE status = 'O') AS open"),
    )
    per_day = daily.selectExpr(
        "day AS date",
        "cents / n / 1e6D AS zar_usd",
        "try_divide(urgent, n_urgent) / 2e7D AS usd_eur",
    )
    monthly = daily.groupBy(F.expr("last_day(day) AS date")).agg(
        F.expr("sum(cents) AS cents"), F.expr("sum(n) AS n"), F.expr("sum(filled) AS filled"), F.expr("sum(open) AS open")
    )
    per_month = monthly.selectExpr(
        "date",
        "5D + cents % 700 / 100D AS tbill_rate",
        "100D + ((year(date) - 1995) * 12 + month(date)) * 0.4D + n % 7 * 0.3D AS cpi_all",
        "CASE WHEN quarter(date) * 3 = month(date) THEN 8D + cents % 500 / 100D END AS govt_bond_10y",
        "CASE WHEN month(date) = 12 THEN filled / 1e6D END AS exports_value",
        "CASE WHEN month(date) = 12 THEN open / 1e6D END AS imports_value",
    )
    return _long(per_day).unionByName(_long(per_month)).select("series", "date", "value")


def _long(wide: DataFrame) -> DataFrame:
    return wide.unpivot("date", [c for c in wide.columns if c != "date"], "series", "value")


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_series(observations(spark, sf_dir), MACRO_LABELS)


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr(
        "year(o_orderdate) AS year",
        "cast(o_totalprice * 100 + 0.5D AS bigint) AS cents",
        "o_orderstatus = 'O' AS open",
    )
    sums = orders.groupBy("year").agg(F.expr("sum(cents) AS cents"), F.expr("count(*) AS n"), F.expr("count_if(open) AS n_open"))
    return sums.selectExpr(
        "year",
        "cents % 900 / 100D - 2 AS gdp_growth_pct",
        "cents / n / 1e6D AS govt_debt_gdp",
        "n_open / n * 100 AS unemployment_pct",
    )
