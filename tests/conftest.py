from __future__ import annotations

import sys
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


START = date(2020, 1, 1)


def days(n: int, start: date = START) -> list[date]:
    return [start + timedelta(days=k) for k in range(n)]


def business_days(n: int, start: date = START) -> list[date]:
    out, day = [], start
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += timedelta(days=1)
    return out


def months(n: int, year: int = 2020) -> list[date]:
    """Month ends."""
    out = []
    for k in range(n):
        y, m = year + (k + 1) // 12, (k + 1) % 12 + 1
        out.append(date(y, m, 1) - timedelta(days=1))
    return out


@pytest.fixture(scope="session")
def series(spark):
    """Panel from {ticker: closes} on consecutive days."""

    def build(closes: dict[str, list], start: date = START, column: str = "close"):
        rows = [(t, d, v if v is None else float(v)) for t, vs in closes.items() for d, v in zip(days(len(vs), start), vs)]
        return spark.createDataFrame(rows, f"ticker string, date date, {column} double")

    return build


@pytest.fixture(scope="session")
def monthly(spark):
    """Monthly table from {column: values}."""

    def build(columns: dict[str, list]):
        n = len(next(iter(columns.values())))
        rows = [
            (d, *[None if v is None else float(v) for v in vs])
            for d, *vs in zip(months(n), *columns.values())
        ]
        return spark.createDataFrame(rows, "date date, " + ", ".join(f"{c} double" for c in columns))

    return build


def column(df, name: str, *order: str) -> list:
    return [r[name] for r in df.orderBy(*(order or ("date",))).collect()]
