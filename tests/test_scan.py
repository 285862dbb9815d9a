"""Running values over blocks: the same as along whole series, whatever the block's length."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelwright.operators import scan, signals
from panelwright.operators.segments import POSITION

KEYS = (None, "a", "b", "one")


@pytest.fixture(scope="module")
def walk(spark):
    """Long, short and one-row series, and one without a key; values with nulls."""
    rng = random.Random(1)
    sizes = {"a": 400, "b": 37, "one": 1, None: 90}
    rows = [(k, t, None if rng.random() < 0.2 else rng.uniform(-1, 1), rng.choice("xyz") if rng.random() < 0.9 else None) for k, n in sizes.items() for t in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t int, v double, state string").repartition(5).cache()


def series_of(rows):
    return {k: sorted((r for r in rows if r[0] == k), key=lambda r: r[1]) for k in KEYS}


@pytest.mark.parametrize("decay", [1.0, 0.999, 13 / 14, 0.5, 1e-8])
@pytest.mark.parametrize("block", [3, 50, 10_000])
def test_faded_sums(walk, decay, block):
    rows, df = walk
    at = df.withColumn(POSITION, F.col("t").cast("long"))
    got = {(r["k"], r["t"]): r["y"] for r in scan.faded_sums(at, ["k"], {"v": "y"}, decay, block).collect()}
    assert len(got) == len(rows)
    for k, own in series_of(rows).items():
        y = 0.0
        for _, t, v, _ in own:
            y = decay * y + (v or 0.0)
            assert got[k, t] == pytest.approx(y, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("block", [2, 7])
def test_products_and_last_known(walk, block):
    rows, df = walk
    at = df.withColumn(POSITION, F.col("t").cast("long"))
    products = {(r["k"], r["t"]): r["y"] for r in scan.running_products(at, ["k"], {"v": "y"}, block).collect()}
    last = {(r["k"], r["t"]): r["y"] for r in scan.last_known(at, ["k"], {"state": "y"}, block).collect()}
    for k, own in series_of(rows).items():
        y, known = 1.0, None
        for _, t, v, state in own:
            y, known = y * (1.0 if v is None else v), known if state is None else state
            assert products[k, t] == pytest.approx(y, rel=1e-9, abs=1e-300) and last[k, t] == known


def test_bad_decay(walk):
    for decay in (0.0, 1.5):
        with pytest.raises(ValueError, match="decay"):
            scan.faded_sums(walk[1], ["k"], {"v": "y"}, decay)


@pytest.mark.parametrize("n", [2, 14, 200])
def test_rsi_as_in_one_window(spark, n):
    rng = random.Random(n)
    rows, close = [], 100.0
    for t in range(900):
        close += rng.choice([-1, 0, 1, 1]) * rng.random()
        rows.append(("a" if t % 3 else "b", t, None if t == 40 else close))
    df = spark.createDataFrame(rows, "ticker string, date int, close double")
    want = {r["date"]: r[f"rsi_{n}"] for r in signals.rsi(df, rows=n, column=f"rsi_{n}").collect()}
    got = {r["date"]: r[f"rsi_{n}"] for r in scan.long_rsi(df, ["ticker"], ["date"], n, block_rows=60).collect()}
    assert got.keys() == want.keys()
    for t, v in want.items():
        assert got[t] == (None if v is None else pytest.approx(v, abs=1e-8))


def test_compounding_and_filling(walk):
    rows, df = walk
    got = {(r["k"], r["t"]): r["c"] for r in scan.compounded(df, ["k"], ["t"], {"v": "c"}, 11).collect()}
    filled = {(r["k"], r["t"]): r["state"] for r in scan.filled_forward(df, ["k"], ["t"], ["state"], 1, 11).collect()}
    for k, own in series_of(rows).items():
        y = 1.0
        for j, (_, t, v, state) in enumerate(own):
            y *= 1 + (v or 0.0)
            assert got[k, t] == pytest.approx(y - 1, rel=1e-9)
            assert filled[k, t] == (state if state is not None else own[j - 1][3] if j else None)


@pytest.mark.parametrize("block", [4, 10_000])
def test_spells(walk, block):
    rows, df = walk
    got = {(r["k"], r["t"]): (r["state_changed"], r["spell"], r["spell_duration"]) for r in scan.numbered_spells(df, ["k"], ["t"], "state", block).collect()}
    runs = sorted((str(r["k"]), r["spell"], r["state"], r["start"], r["end"], r["n_rows"]) for r in scan.long_spells(df, ["k"], ["t"], "state", block).collect())
    want = []
    for k, own in series_of(rows).items():
        spell, length = 0, 0
        for j, (_, t, _, state) in enumerate(own):
            changed = j == 0 or state != own[j - 1][3]
            spell, length = spell + changed, 1 if changed else length + 1
            assert got[k, t] == (int(changed), spell, length)
        known, number = [r for r in own if r[3] is not None], 0
        for j, r in enumerate(known):
            if j == 0 or r[3] != known[j - 1][3]:
                number += 1
                want.append([str(k), number, r[3], r[1], r[1], 0])
            want[-1][4:] = [r[1], want[-1][5] + 1]
    assert runs == sorted(map(tuple, want))


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, t int, v double, state string")
    assert scan.long_spells(none, ["k"], ["t"], "state").count() == 0
    assert scan.compounded(none, ["k"], ["t"], {"v": "c"}).count() == 0
    assert scan.exact_quantiles(none, "v", [0.5], ["k"]).count() == 0 and scan.exact_quantiles(none, "v", [0.5]).count() == 0


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("block", [5, 10_000])
def test_asof_at_any_resolution(spark, by, block):
    rng = random.Random(8)
    start = datetime(2024, 1, 1)

    def moment():
        return None if rng.random() < 0.05 else start + timedelta(microseconds=rng.randint(0, 300) * 250)

    left = [(rng.choice(KEYS), moment(), i) for i in range(300)] + [("a", start, 1000), ("a", start, 1000)]
    right = [(rng.choice(KEYS[1:]), moment(), rng.choice([None, 1, 2, 3]), rng.random()) for _ in range(80)]
    lf = spark.createDataFrame(left, "k string, ts timestamp, id int").repartition(3)
    rf = spark.createDataFrame(right, "k string, ts timestamp, x int, y double")
    out = scan.asof_ordered(lf, rf if by else rf.drop("k"), "ts", by, block)
    assert out.columns == ["k", "ts", "id", "x", "y"]

    def reading(row):
        found = [r for r in right if r[1] is not None and row[1] is not None and r[1] <= row[1] and (not by or r[0] == row[0] is not None)]
        if not found:
            return (None, None)
        last = [r[2:] for r in found if r[1] == max(f[1] for f in found)]
        return max(last, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))

    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(str((*row, *reading(row))) for row in left)


def test_exact_quantiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice(KEYS[:3]), rng.choice([None, 1.0, 1.0, 1.0, rng.random() * 9])) for _ in range(500)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {(r["k"], r["share"]): r["value"] for r in scan.exact_quantiles(df, "v", shares, ["k"], 20).collect()}
    overall = {r["share"]: r["value"] for r in scan.exact_quantiles(df, "v", shares, (), 20).collect()}

    def quantile(values, share):
        rank = share * (len(values) - 1)
        return values[math.floor(rank)] + (rank - math.floor(rank)) * (values[math.ceil(rank)] - values[math.floor(rank)])

    assert {k for k, _ in got} == {None, "a", "b", "one"}
    for (k, share), value in got.items():
        assert value == pytest.approx(quantile(sorted(v for key, v in rows if key == k and v is not None), share))
    for share, value in overall.items():
        assert value == pytest.approx(quantile(sorted(v for _, v in rows if v is not None), share))


def test_no_window_over_a_whole_series(spark, walk):
    """Windows are dealt by key and block; only rows about partitions and the last level are ordered by key alone."""
    plan = scan.long_rsi(walk[1].withColumnRenamed("v", "close"), ["k"], ["t"], 14)._jdf.queryExecution().toString()
    assert "_block" in plan and "_segment" in plan
