"""The SQL each query is checked against, over the same tables. Written independently of the Spark plans."""

from __future__ import annotations

from panelwright.functions import fixed_values as fixed
from panelwright.functions.fixed_values import CORRELATION_VARIABLES, MOMENTUM_ROWS, REGIME_ORDER

CUT_DAY = "1999-07-01"
MACRO_SERIES = ("tbill_rate", "govt_bond_10y", "cpi_all", "zar_usd", "usd_eur", "exports_value", "imports_value")

# Common table expressions: name -> (needs, text).
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": (
        (),
        """SELECT p_brand AS brand, CAST(l_shipdate AS DATE) AS date, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
                  CAST(l_quantity AS BIGINT) AS pieces
           FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "prices": (
        ("lines",),
        """SELECT date, ticker, (high + low) / 2 / 100 AS open, high / 100 AS high, low / 100 AS low,
                  CAST(cents AS DOUBLE) / CAST(pieces AS DOUBLE) / 100 AS close, CAST(pieces AS DOUBLE) AS volume,
                  'Series ' || ticker AS name
           FROM (SELECT ticker, date, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(pieces) AS BIGINT) AS pieces,
                        max(CAST(cents AS DOUBLE) / CAST(pieces AS DOUBLE)) AS high,
                        min(CAST(cents AS DOUBLE) / CAST(pieces AS DOUBLE)) AS low
                 FROM (SELECT brand AS ticker, date, cents, pieces FROM lines
                       UNION ALL SELECT '^INDEX', date, cents, pieces FROM lines)
                 GROUP BY ticker, date)""",
    ),
    "order_days": (
        (),
        """SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(c) AS BIGINT) AS cents, count(*) AS n,
                  CAST(sum(c) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS urgent,
                  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
                  CAST(sum(c) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS filled,
                  CAST(sum(c) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS open
           FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) GROUP BY ALL""",
    ),
    "order_months": (
        ("order_days",),
        """SELECT last_day(day) AS date, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(n) AS BIGINT) AS n,
                  CAST(sum(filled) AS BIGINT) AS filled, CAST(sum(open) AS BIGINT) AS open
           FROM order_days GROUP BY ALL""",
    ),
    "readings": (
        ("order_days", "order_months"),
        """SELECT 'zar_usd' AS series, day AS date, CAST(cents AS DOUBLE) / n / CAST(1e6 AS DOUBLE) AS value FROM order_days
           UNION ALL SELECT 'usd_eur', day, CASE WHEN n_urgent > 0 THEN CAST(urgent AS DOUBLE) / n_urgent / CAST(2e7 AS DOUBLE) END
                     FROM order_days
           UNION ALL SELECT 'tbill_rate', date, CAST(5 AS DOUBLE) + CAST(cents % 700 AS DOUBLE) / 100 FROM order_months
           UNION ALL SELECT 'cpi_all', date, CAST(100 AS DOUBLE)
                       + ((year(date) - 1995) * 12 + month(date)) * CAST(0.4 AS DOUBLE) + (n % 7) * CAST(0.3 AS DOUBLE)
                     FROM order_months
           UNION ALL SELECT 'govt_bond_10y', date,
                       CASE WHEN month(date) IN (3, 6, 9, 12) THEN CAST(8 AS DOUBLE) + CAST(cents % 500 AS DOUBLE) / 100 END
                     FROM order_months
           UNION ALL SELECT 'exports_value', date, CASE WHEN month(date) = 12 THEN CAST(filled AS DOUBLE) / CAST(1e6 AS DOUBLE) END
                     FROM order_months
           UNION ALL SELECT 'imports_value', date, CASE WHEN month(date) = 12 THEN CAST(open AS DOUBLE) / CAST(1e6 AS DOUBLE) END
                     FROM order_months""",
    ),
    "raw_macro": (
        ("readings",),
        "SELECT date, "
        + ", ".join(f"max(value) FILTER (WHERE series = '{c}') AS {c}" for c in MACRO_SERIES)
        + " FROM readings WHERE value IS NOT NULL GROUP BY date",
    ),
    "months": (
        ("raw_macro",),
        "SELECT date_trunc('month', date) AS m, avg(zar_usd) AS zar_usd, avg(usd_eur) AS usd_eur, "
        + ", ".join(
            f"arg_max({c}, date) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in MACRO_SERIES if c not in ("zar_usd", "usd_eur")
        )
        + " FROM raw_macro GROUP BY 1",
    ),
    "month_spine": (
        ("months",),
        "SELECT CAST(unnest(generate_series((SELECT min(m) FROM months), (SELECT max(m) FROM months), INTERVAL 1 MONTH)) AS DATE) AS m",
    ),
    "macro_filled": (
        ("month_spine", "months"),
        "SELECT last_day(s.m) AS date, "
        + ", ".join(
            f"last_value({c} IGNORE NULLS) OVER (ORDER BY s.m ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS {c}"
            for c in MACRO_SERIES
        )
        + " FROM month_spine s LEFT JOIN months USING (m)",
    ),
    "macro": (
        ("macro_filled",),
        """SELECT *, tbill_rate - cpi_yoy_pct AS real_tbill_rate, govt_bond_10y - tbill_rate AS yield_curve_spread
           FROM (SELECT *, (zar_usd / lag(zar_usd) OVER (ORDER BY date) - 1) * 100 AS zar_usd_mom_pct,
                        (cpi_all / lag(cpi_all, 12) OVER (ORDER BY date) - 1) * 100 AS cpi_yoy_pct FROM macro_filled)""",
    ),
    "annual": (
        (),
        """SELECT CAST(year AS INTEGER) AS year, CAST(cents % 900 AS DOUBLE) / 100 - 2 AS gdp_growth_pct,
                  CAST(cents AS DOUBLE) / n / CAST(1e6 AS DOUBLE) AS govt_debt_gdp, CAST(n_open AS DOUBLE) / n * 100 AS unemployment_pct
           FROM (SELECT year(o_orderdate) AS year, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
                        count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open
                 FROM orders GROUP BY 1)""",
    ),
    "dense": (
        ("prices",),
        """SELECT s.ticker, s.date, p.close FROM
             (SELECT ticker, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
              FROM prices GROUP BY ticker) s
           LEFT JOIN prices p ON p.ticker = s.ticker AND p.date = s.date""",
    ),
    "returns": (
        ("prices",),
        """SELECT *, close / lag(close) OVER w - 1 AS daily_return, ln(close / lag(close) OVER w) AS log_return
           FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    ),
    "mom": (
        ("prices",),
        "SELECT *, "
        + ", ".join(f"lag(close) OVER w / lag(close, {n + 1}) OVER w - 1 AS {c}" for c, n in MOMENTUM_ROWS.items())
        + " FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)",
    ),
    "momz": (
        ("mom",),
        "SELECT *, "
        + ", ".join(
            f"CASE WHEN min({c}) OVER d < max({c}) OVER d THEN ({c} - avg({c}) OVER d) / stddev_samp({c}) OVER d END AS {c}_z"
            for c in MOMENTUM_ROWS
        )
        + " FROM mom WINDOW d AS (PARTITION BY date)",
    ),
    "score": (
        ("momz",),
        """SELECT *, 0.2 * coalesce(mom_1m_z, 0) + 0.3 * coalesce(mom_3m_z, 0) + 0.5 * coalesce(mom_6m_z, 0) AS momentum_score
           FROM momz""",
    ),
    "averages": (
        ("prices",),
        """SELECT *, ma_50 / ma_200 AS ma_ratio_50_200,
                  CASE WHEN ma_50 > ma_200 THEN 1 WHEN ma_50 < ma_200 THEN -1 ELSE 0 END AS trend_signal
           FROM (SELECT *, CASE WHEN count(close) OVER f >= 30 THEN avg(close) OVER f END AS ma_50,
                        CASE WHEN count(close) OVER s >= 100 THEN avg(close) OVER s END AS ma_200
                 FROM prices WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
                                    s AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))""",
    ),
    "changes": (
        ("prices",),
        """SELECT ticker, date, row_number() OVER w AS rn, close - lag(close) OVER w AS change
           FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    ),
    # Every earlier change with its full weight: quadratic, but free of any blocking.
    "rsi": (
        ("changes",),
        """SELECT ticker, date, CASE WHEN known < 14 THEN NULL WHEN down = 0 AND up > 0 THEN 100 WHEN up = 0 AND down > 0 THEN 0
                  WHEN up > 0 AND down > 0 THEN 100 - 100 / (1 + up / down) END AS rsi_14
           FROM (SELECT a.ticker, a.date, count(b.change) AS known,
                        sum(greatest(b.change, 0) * pow(13.0 / 14.0, a.rn - b.rn)) AS up,
                        sum(greatest(-b.change, 0) * pow(13.0 / 14.0, a.rn - b.rn)) AS down
                 FROM changes a JOIN changes b ON a.ticker = b.ticker AND b.rn <= a.rn GROUP BY 1, 2)""",
    ),
    "regimes": (
        ("macro",),
        """SELECT *, row_number() OVER (PARTITION BY spell ORDER BY date) AS regime_duration
           FROM (SELECT *, sum(regime_changed) OVER (ORDER BY date) AS spell
             FROM (SELECT *, CASE WHEN composite_regime IS DISTINCT FROM lag(composite_regime) OVER (ORDER BY date)
                                  THEN 1 ELSE 0 END AS regime_changed
               FROM (SELECT *, rate_regime || '_' || inflation_regime AS composite_regime
                 FROM (SELECT date, tbill_rate, cpi_yoy_pct, zar_usd,
                         CASE WHEN tbill_rate > r3 THEN 'HIKING' WHEN tbill_rate < r3 THEN 'CUTTING' ELSE 'NEUTRAL' END AS rate_regime,
                         CASE WHEN cpi_yoy_pct <= 3 THEN 'LOW_INFLATION' WHEN cpi_yoy_pct <= 6 THEN 'TARGET_INFLATION'
                              WHEN cpi_yoy_pct > 6 THEN 'HIGH_INFLATION' ELSE 'nan' END AS inflation_regime,
                         CASE WHEN z3 > 2 THEN 'WEAK_RAND' WHEN z3 < -2 THEN 'STRONG_RAND' ELSE 'STABLE_RAND' END AS currency_regime
                   FROM (SELECT *, CASE WHEN count(tbill_rate) OVER r >= 2 THEN avg(tbill_rate) OVER r END AS r3,
                                (zar_usd / lag(zar_usd, 3) OVER (ORDER BY date) - 1) * 100 AS z3
                         FROM macro WINDOW r AS (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))))))""",
    ),
    "spells": (
        ("regimes",),
        """SELECT any_value(composite_regime) AS regime, min(date) AS start, max(date) AS "end", count(*) AS months
           FROM regimes GROUP BY spell""",
    ),
    "fwd": (
        ("prices",),
        "SELECT *, lead(close, 21) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd FROM prices",
    ),
    "labels21": (
        ("fwd",),
        """SELECT p.*, p.fwd AS fwd_return_21d, i.fwd AS alsi_fwd_return_21d,
                  CASE WHEN p.fwd > i.fwd THEN 1 WHEN p.fwd <= i.fwd THEN 0 END AS outperformed
           FROM fwd p LEFT JOIN (SELECT date, fwd FROM fwd WHERE ticker = '^INDEX') i ON p.date = i.date""",
    ),
    "regime_fwd": (
        ("fwd", "regimes"),
        """SELECT f.ticker, f.date, f.fwd, r.composite_regime FROM fwd f ASOF LEFT JOIN regimes r ON f.date >= r.date""",
    ),
    "usable": (("regime_fwd",), "SELECT * FROM regime_fwd WHERE composite_regime IS NOT NULL AND fwd IS NOT NULL"),
    "cells": (
        ("usable",),
        """SELECT ticker, composite_regime, count(*) AS observations,
                  CASE WHEN count(*) >= 20 THEN avg(fwd) * 100 END AS avg_fwd_return_pct
           FROM usable GROUP BY 1, 2""",
    ),
    "hedged": (
        ("usable",),
        """SELECT *, abs(HIKING - CUTTING) AS gap, HIKING > 0 AND CUTTING > 0 AS both_positive
           FROM (SELECT ticker, avg(fwd) FILTER (WHERE stance = 'HIKING') * 100 AS HIKING,
                        avg(fwd) FILTER (WHERE stance = 'CUTTING') * 100 AS CUTTING,
                        avg(fwd) FILTER (WHERE stance = 'NEUTRAL') * 100 AS NEUTRAL, count(DISTINCT stance) AS k
                 FROM (SELECT *, split_part(composite_regime, '_', 1) AS stance FROM usable) GROUP BY ticker)
           WHERE k = (SELECT count(DISTINCT split_part(composite_regime, '_', 1)) FROM usable)
             AND HIKING IS NOT NULL AND CUTTING IS NOT NULL""",
    ),
    "pairs": (
        ("regimes",),
        """SELECT composite_regime AS "from", lead(composite_regime) OVER (ORDER BY date) AS "to" FROM regimes""",
    ),
    "matrix": (
        ("pairs",),
        """SELECT a.s AS "from", b.s AS "to", coalesce(c.n, 0) AS n, coalesce(o.k, 0) AS occurrences,
                  CASE WHEN o.k > 0 THEN CAST(coalesce(c.n, 0) AS DOUBLE) / o.k END AS probability
           FROM (SELECT DISTINCT "from" AS s FROM pairs) a CROSS JOIN (SELECT DISTINCT "from" AS s FROM pairs) b
           LEFT JOIN (SELECT "from", "to", count(*) AS n FROM pairs GROUP BY 1, 2) c ON c."from" = a.s AND c."to" = b.s
           LEFT JOIN (SELECT "from", count(*) AS k FROM pairs WHERE "to" IS NOT NULL GROUP BY 1) o ON o."from" = a.s""",
    ),
    "confidence": (
        ("matrix",),
        """SELECT "from" AS regime, any_value(occurrences) AS historical_occurrences, any_value(occurrences) >= 10 AS reliable
           FROM matrix GROUP BY 1""",
    ),
    "durations": (
        ("matrix",),
        """SELECT "from" AS regime, CASE WHEN probability >= 1 THEN CAST('inf' AS DOUBLE)
                  WHEN probability IS NOT NULL THEN 1 / (1 - probability) END AS expected_duration_months
           FROM matrix WHERE "from" = "to\"""",
    ),
    "summary": (
        ("spells",),
        """SELECT regime, CAST(sum(months) AS BIGINT) AS total_months, round(avg(months), 1) AS avg_spell_length_months,
                  count(*) AS num_spells FROM spells GROUP BY 1""",
    ),
    "correlations": (
        ("returns", "macro"),
        "SELECT date, ticker, name, macro_var, rolling_corr FROM ("
        + " UNION ALL ".join(
            f"""SELECT date, ticker, name, '{v}' AS macro_var,
                       CASE WHEN count(x) OVER w >= 30 AND min(x) OVER w < max(x) OVER w AND min(y) OVER w < max(y) OVER w
                            THEN corr(x, y) OVER w END AS rolling_corr
                FROM (SELECT p.date, p.ticker, p.name, CASE WHEN m.{v} IS NOT NULL THEN p.daily_return END AS x,
                             CASE WHEN p.daily_return IS NOT NULL THEN m.{v} END AS y
                      FROM returns p ASOF LEFT JOIN macro m ON p.date >= m.date)
                WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)"""
            for v in CORRELATION_VARIABLES
        )
        + ") WHERE rolling_corr IS NOT NULL",
    ),
    "month_starts": (
        ("prices",),
        """SELECT first AS rebalance_date, row_number() OVER (ORDER BY first) AS nth
           FROM (SELECT min(date) AS first FROM prices GROUP BY date_trunc('month', date))""",
    ),
    "rebalances": (("month_starts",), "SELECT rebalance_date FROM month_starts WHERE nth > 12"),
    "picks": (
        ("labels21", "score", "rebalances"),
        """SELECT * FROM (
             SELECT l.date, l.ticker, s.momentum_score, l.fwd_return_21d, l.alsi_fwd_return_21d,
                    row_number() OVER (PARTITION BY l.date ORDER BY s.momentum_score DESC, l.ticker) AS pick_rank,
                    count(*) OVER (PARTITION BY l.date) AS candidates
             FROM labels21 l JOIN score s ON s.ticker = l.ticker AND s.date = l.date
             JOIN rebalances r ON r.rebalance_date = l.date
             WHERE l.ticker <> '^INDEX' AND l.fwd_return_21d IS NOT NULL)
           WHERE pick_rank <= 5 AND candidates >= 5""",
    ),
    "results": (
        ("picks",),
        """SELECT *, excess_return - CAST(0.0015 AS DOUBLE) AS net_excess_return, coalesce(excess_return > 0, false) AS beat_alsi
           FROM (SELECT *, portfolio_return - alsi_return AS excess_return
                 FROM (SELECT date AS rebalance_date, string_agg(ticker, ', ' ORDER BY pick_rank) AS picked_tickers,
                              avg(fwd_return_21d) AS portfolio_return, any_value(alsi_fwd_return_21d) AS alsi_return
                       FROM picks GROUP BY date))""",
    ),
    "features": (
        ("score", "averages", "rsi", "labels21", "regimes"),
        """SELECT s.ticker, s.date, s.momentum_score, r.rsi_14, a.trend_signal, g.composite_regime, l.outperformed
           FROM score s JOIN averages a ON a.ticker = s.ticker AND a.date = s.date
           JOIN rsi r ON r.ticker = s.ticker AND r.date = s.date
           JOIN labels21 l ON l.ticker = s.ticker AND l.date = s.date
           ASOF LEFT JOIN regimes g ON s.date >= g.date""",
    ),
    "ticks": ((), "SELECT event_type AS ticker, ts, event_id, value AS close FROM events"),
}


def with_ctes(final: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for parent in CTES[name][0]:
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    clauses = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    return f"WITH {clauses}\n{final}" if ordered else final


def r(*columns: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)


def rsi_sql(rows: int) -> str:
    """Every earlier change with its full weight, quadratic; weights that would underflow count as nothing."""
    weight = f"CASE WHEN a.rn - b.rn < 5000 THEN pow({rows - 1}.0 / {rows}.0, a.rn - b.rn) ELSE 0 END"
    if rows == 2:
        weight = "CASE WHEN a.rn - b.rn < 1000 THEN pow(0.5, a.rn - b.rn) ELSE 0 END"
    return with_ctes(
        f"""SELECT ticker, date, round(CASE WHEN known < {rows} THEN NULL WHEN down = 0 AND up > 0 THEN 100 WHEN up = 0 AND down > 0 THEN 0
                   WHEN up > 0 AND down > 0 THEN 100 - 100 / (1 + up / down) END, 6) AS rsi_{rows}
            FROM (SELECT a.ticker, a.date, count(b.change) AS known, sum(greatest(b.change, 0) * {weight}) AS up,
                         sum(greatest(-b.change, 0) * {weight}) AS down
                  FROM changes a JOIN changes b ON a.ticker = b.ticker AND b.rn <= a.rn GROUP BY a.ticker, a.date)""",
        "changes",
    )


STANCES, LEVELS = ("HIKING", "CUTTING", "NEUTRAL"), ("LOW_INFLATION", "TARGET_INFLATION", "HIGH_INFLATION", "nan")
#: All labels that can occur; one that does not occur has a constant flag, whose coefficient the penalty holds at zero.
MODEL_INPUTS = (*fixed.MODEL_FEATURES, *[f"regime_{a}_{b}" for a in STANCES for b in LEVELS])
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in (*fixed.MODEL_FEATURES, "composite_regime"))


def model_ctes(train: str, iterations: int) -> dict[str, str]:
    """Logistic models by Newton steps from zero, one per ``fit`` of the rows (fit, outperformed, features, composite_regime).

    The last table is ``fitted`` (fit, w, mean, scale): weights on the standardised scale, intercept first. Each step sums
    gradient and curvature by aggregation and solves the system by Gauss-Jordan elimination over lists.
    """
    k = len(MODEL_INPUTS)
    raw = [f"CAST({c} AS DOUBLE)" for c in fixed.MODEL_FEATURES]
    raw += [f"CAST(composite_regime = '{c.removeprefix('regime_')}' AS DOUBLE)" for c in MODEL_INPUTS[len(raw) :]]
    z = [f"z{j}" for j in range(k + 1)]
    score = " + ".join(f"w[{j + 1}] * {c}" for j, c in enumerate(z))
    cell = {(i, j): f"sum(v * {z[i]} * {z[j]})" for i in range(k + 1) for j in range(i, k + 1)}
    system = ", ".join(
        "[" + ", ".join([*(cell[min(i, j), max(i, j)] + (" + 1" if i == j > 0 else "") for j in range(k + 1)), f"sum(e * {z[i]}) + {'any_value(w)[%d]' % (i + 1) if i else '0'}"]) + "]"
        for i in range(k + 1)
    )
    out = {
        "train": f"SELECT fit, CAST(outperformed AS DOUBLE) AS y, {', '.join(f'{c} AS x{j}' for j, c in enumerate(raw, 1))} FROM ({train}) WHERE {COMPLETE} AND outperformed IS NOT NULL",
        "moments": f"""SELECT fit, [{", ".join(f"avg(x{j})" for j in range(1, k + 1))}] AS mean,
            [{", ".join(f"CASE WHEN stddev_pop(x{j}) > 1e-9 THEN stddev_pop(x{j}) ELSE 1 END" for j in range(1, k + 1))}] AS scale
            FROM train GROUP BY fit HAVING min(y) < max(y)""",
        "standard": f"SELECT fit, y, 1::DOUBLE AS z0, {', '.join(f'(x{j} - mean[{j}]) / scale[{j}] AS z{j}' for j in range(1, k + 1))} FROM train JOIN moments USING (fit)",
        "weights0": f"SELECT fit, [0::DOUBLE for j in range({k + 1})] AS w FROM moments",
    }
    for n in range(iterations):
        out[f"system{n}"] = f"""SELECT fit, any_value(w) AS w, [{system}] AS m
            FROM (SELECT *, q - y AS e, q * (1 - q) AS v FROM (SELECT *, 1 / (1 + exp(-({score}))) AS q FROM standard JOIN weights{n} USING (fit))) GROUP BY fit"""
        out[f"weights{n + 1}"] = f"""WITH RECURSIVE turn(fit, w, i, m) AS (
              SELECT fit, w, 0, m FROM system{n}
              UNION ALL
              SELECT fit, w, i + 1, [CASE WHEN r = i + 1 THEN [m[r][c] / m[r][r] for c in range(1, {k + 3})]
                                         ELSE [m[r][c] - m[r][i + 1] * m[i + 1][c] / m[i + 1][i + 1] for c in range(1, {k + 3})] END for r in range(1, {k + 2})]
              FROM turn WHERE i < {k + 1})
            SELECT fit, [w[r] - m[r][{k + 2}] for r in range(1, {k + 2})] AS w FROM turn WHERE i = {k + 1}"""
    out["fitted"] = f"SELECT fit, w, mean, scale FROM weights{iterations} JOIN moments USING (fit)"
    return out


def chance(prefix: str = "") -> str:
    """Probability by a row of ``fitted``; null where a feature or the regime is missing."""
    raw = [f"CAST({c} AS DOUBLE)" for c in fixed.MODEL_FEATURES]
    raw += [f"CAST(composite_regime = '{c.removeprefix('regime_')}' AS DOUBLE)" for c in MODEL_INPUTS[len(raw) :]]
    total = " + ".join(f"w[{j + 1}] * ({c} - mean[{j}]) / scale[{j}]" for j, c in enumerate(raw, 1))
    return f"CASE WHEN {COMPLETE} THEN 1 / (1 + exp(-(w[1] + {total}))) END"


def model_sql(final: str, train: str, iterations: int) -> str:
    base = with_ctes("", "features", "rebalances").rstrip()
    base = base.replace("WITH ", "WITH RECURSIVE ", 1).replace("features AS (", "features AS MATERIALIZED (", 1)
    steps = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in model_ctes(train, iterations).items())
    return f"{base},\n{steps}\n{final}"


def tick_rsi_sql(rows: int) -> str:
    """Every earlier change with its full weight, quadratic, along the events of each type."""
    return f"""WITH moved AS (SELECT event_id, event_type, row_number() OVER w AS rn, value - lag(value) OVER w AS change
                            FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
        SELECT event_id, round(CASE WHEN known < {rows} THEN NULL WHEN down = 0 AND up > 0 THEN 100 WHEN up = 0 AND down > 0 THEN 0
                   WHEN up > 0 AND down > 0 THEN 100 - 100 / (1 + up / down) END, 6) AS rsi_{rows}
        FROM (SELECT a.event_id, count(b.change) AS known, sum(greatest(b.change, 0) * pow({rows - 1}.0 / {rows}.0, a.rn - b.rn)) AS up,
                     sum(greatest(-b.change, 0) * pow({rows - 1}.0 / {rows}.0, a.rn - b.rn)) AS down
              FROM moved a JOIN moved b ON a.event_type = b.event_type AND b.rn <= a.rn GROUP BY a.event_id)"""


DERIVED = ("zar_usd_mom_pct", "cpi_yoy_pct", "real_tbill_rate", "yield_curve_spread")
FLAGS = ", ".join(
    f"CASE WHEN composite_regime = '{v}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS regime_{v}" for v in REGIME_ORDER
)
MATRIX_COLUMNS = ("momentum_score", "rsi_14", "trend_signal", *[f"regime_{v}" for v in REGIME_ORDER])
HEAT = ", ".join(f"max(avg_fwd_return_pct) FILTER (WHERE composite_regime = '{v}') AS {v}" for v in REGIME_ORDER)

ORACLES: dict[str, str] = {
    "price_panel": with_ctes("SELECT * FROM prices", "prices"),
    "normalise_prices": with_ctes("SELECT * FROM prices", "prices"),
    "parse_observations": with_ctes("SELECT series, date, value FROM readings", "readings"),
    "align_series": with_ctes("SELECT * FROM raw_macro", "raw_macro"),
    "normalise_annual": with_ctes("SELECT * FROM annual", "annual"),
    "between_dates": with_ctes(
        "SELECT ticker, date, close FROM prices WHERE date >= DATE '1997-01-01' AND date < DATE '1999-01-01'", "prices"
    ),
    "coerce_numeric": with_ctes("SELECT ticker, date, CASE WHEN volume >= 20 THEN volume END AS volume FROM prices", "prices"),
    "panel_catalog": with_ctes(
        "SELECT ticker, any_value(name) AS name, min(date) AS date_min, max(date) AS date_max, count(*) AS n_rows FROM prices GROUP BY 1",
        "prices",
    ),
    "freshness": with_ctes(
        """SELECT 'prices' AS table_name, CAST(max(date) AS VARCHAR) AS latest, count(*) AS n_rows FROM prices
           UNION ALL SELECT 'macro', CAST(max(date) AS VARCHAR), count(*) FROM raw_macro
           UNION ALL SELECT 'annual', CAST(max(year) AS VARCHAR), count(*) FROM annual""",
        "prices", "raw_macro", "annual",
    ),
    "calendar_features": with_ctes(
        """SELECT ticker, date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
                  CAST(quarter(date) AS INTEGER) AS quarter, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week FROM prices""",
        "prices",
    ),
    "capped_ffill": with_ctes(
        """SELECT ticker, date, last_value(close IGNORE NULLS) OVER
                  (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close FROM dense""",
        "dense",
    ),
    "daily_returns": with_ctes(f"SELECT ticker, date, {r('daily_return', 'log_return')} FROM returns", "returns"),
    "volatility_21d": with_ctes(
        """SELECT ticker, date, round(CASE WHEN count(log_return) OVER w >= 10 THEN stddev_samp(log_return) OVER w END * sqrt(252), 6)
                  AS volatility_21d
           FROM returns WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""",
        "returns",
    ),
    "high_low_52w": with_ctes(
        """SELECT ticker, date, high_52w, low_52w, round((close - high_52w) / high_52w, 6) AS pct_from_52w_high
           FROM (SELECT *, CASE WHEN count(close) OVER w >= 50 THEN max(close) OVER w END AS high_52w,
                        CASE WHEN count(close) OVER w >= 50 THEN min(close) OVER w END AS low_52w
                 FROM (SELECT ticker, date, close FROM prices)
                 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))""",
        "prices",
    ),
    "macro_monthly": with_ctes(f"SELECT date, {r(*MACRO_SERIES)} FROM macro_filled", "macro_filled"),
    "macro_derived": with_ctes(f"SELECT date, {r(*DERIVED)} FROM macro", "macro"),
    "asof_macro": with_ctes(
        f"""SELECT ticker, p.date, {r('tbill_rate', 'govt_bond_10y', 'cpi_yoy_pct', 'exports_value')}
            FROM prices p ASOF LEFT JOIN macro m ON p.date >= m.date""",
        "prices", "macro",
    ),
    "asof_annual": with_ctes(
        f"""SELECT ticker, p.date, {r('gdp_growth_pct', 'govt_debt_gdp', 'unemployment_pct')}
            FROM prices p ASOF LEFT JOIN (SELECT *, make_date(year, 1, 1) AS date FROM annual) a ON p.date >= a.date""",
        "prices", "annual",
    ),
    "asof_regime": with_ctes(
        """SELECT ticker, p.date, rate_regime, inflation_regime, currency_regime, composite_regime,
                  CAST(regime_duration AS INTEGER) AS regime_duration
           FROM prices p ASOF LEFT JOIN regimes g ON p.date >= g.date""",
        "prices", "regimes",
    ),
    "momentum": with_ctes(f"SELECT ticker, date, {r(*MOMENTUM_ROWS)} FROM mom", "mom"),
    "momentum_z": with_ctes(f"SELECT ticker, date, {r(*[f'{c}_z' for c in MOMENTUM_ROWS])} FROM momz", "momz"),
    "momentum_score": with_ctes(f"SELECT ticker, date, {r('momentum_score')} FROM score", "score"),
    "price_z": with_ctes(
        """SELECT ticker, date, round(CASE WHEN count(close) OVER w >= 10 AND min(close) OVER w < max(close) OVER w
                  THEN (close - avg(close) OVER w) / stddev_samp(close) OVER w END, 6) AS price_z_20d
           FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
        "prices",
    ),
    "moving_averages": with_ctes(
        f"SELECT ticker, date, {r('ma_50', 'ma_200', places=4)}, {r('ma_ratio_50_200')} FROM averages", "averages"
    ),
    "trend_signal": with_ctes("SELECT ticker, date, trend_signal FROM averages", "averages"),
    "rsi_2": rsi_sql(2),
    "rsi_200": rsi_sql(200),
    "rsi_14": with_ctes(f"SELECT ticker, date, {r('rsi_14')} FROM rsi", "rsi"),
    "month_start_leaders": with_ctes(
        f"""SELECT z.date, CAST(rank AS INTEGER) AS rank, ticker, {r('mom_1m_z', 'tbill_rate')}
            FROM (SELECT date, ticker, mom_1m_z, row_number() OVER (PARTITION BY date ORDER BY mom_1m_z DESC, ticker) AS rank
                  FROM momz WHERE date IN (SELECT rebalance_date FROM month_starts) AND mom_1m_z IS NOT NULL
                    AND ticker <> '^INDEX') z
            ASOF LEFT JOIN macro m ON z.date >= m.date WHERE rank <= 5""",
        "momz", "macro", "month_starts",
    ),
    "regime_labels": with_ctes(
        f"""SELECT date, {r('tbill_rate', 'cpi_yoy_pct', 'zar_usd')}, rate_regime, inflation_regime, currency_regime,
                   composite_regime, CAST(regime_duration AS INTEGER) AS regime_duration FROM regimes""",
        "regimes",
    ),
    "regime_changes": with_ctes(
        """SELECT date, composite_regime, regime_changed, CAST(spell AS BIGINT) AS spell,
                  CAST(regime_duration AS INTEGER) AS regime_duration FROM regimes""",
        "regimes",
    ),
    "months_per_regime": with_ctes(
        "SELECT composite_regime AS regime, count(*) AS total_months FROM regimes GROUP BY 1", "regimes"
    ),
    "spells": with_ctes("SELECT * FROM spells", "spells"),
    "spell_summary": with_ctes("SELECT * FROM summary", "summary"),
    "rolling_corr": with_ctes(
        f"SELECT date, ticker, name, macro_var, {r('rolling_corr', places=5)} FROM correlations", "correlations"
    ),
    "rolling_corr_summary": with_ctes(
        """SELECT ticker, macro_var, round(avg(rolling_corr), 4) AS mean, round(stddev_samp(rolling_corr), 4) AS std,
                  round(min(rolling_corr), 4) AS min, round(max(rolling_corr), 4) AS max FROM correlations GROUP BY 1, 2""",
        "correlations",
    ),
    "corr_slice": with_ctes(
        f"""SELECT date, ticker, name, macro_var, {r('rolling_corr', places=5)} FROM correlations
            WHERE ticker = 'Brand#7' AND macro_var = 'cpi_yoy_pct'""",
        "correlations",
    ),
    "corr_matrix": with_ctes(
        """SELECT a.ticker AS ticker_1, b.ticker AS ticker_2, count(*) AS n,
                  round(CASE WHEN min(a.daily_return) < max(a.daily_return) AND min(b.daily_return) < max(b.daily_return)
                             THEN corr(a.daily_return, b.daily_return) END, 6) AS correlation
           FROM returns a JOIN returns b ON a.date = b.date
           WHERE a.daily_return IS NOT NULL AND b.daily_return IS NOT NULL GROUP BY 1, 2""",
        "returns",
    ),
    "forward_label": with_ctes(
        f"SELECT ticker, date, {r('fwd_return_21d', 'alsi_fwd_return_21d')}, outperformed FROM labels21", "labels21"
    ),
    "ticker_regime_returns": with_ctes(
        f"SELECT ticker, composite_regime, observations, {r('avg_fwd_return_pct')} FROM cells", "cells"
    ),
    "regime_heatmap": with_ctes(
        f"""SELECT ticker, {r(*REGIME_ORDER)}, round(m, 6) AS mean_across_regimes FROM (
              SELECT *, list_avg([{", ".join(REGIME_ORDER)}]) AS m FROM (SELECT ticker, {HEAT} FROM cells GROUP BY ticker))""",
        "cells",
    ),
    "reliable_cells": with_ctes(
        """SELECT ticker, c.composite_regime, observations, num_spells, coalesce(num_spells >= 2, true) AS enough_spells,
                  round(CASE WHEN coalesce(num_spells >= 2, true) THEN avg_fwd_return_pct END, 6) AS avg_fwd_return_pct
           FROM cells c LEFT JOIN (SELECT regime, count(*) AS num_spells FROM spells GROUP BY 1) s ON s.regime = c.composite_regime""",
        "cells", "spells",
    ),
    "momentum_efficacy": with_ctes(
        f"""SELECT composite_regime, round(corr(momentum_score, fwd), 6) AS correlation
            FROM usable u JOIN score s ON s.ticker = u.ticker AND s.date = u.date
            WHERE composite_regime IN ({", ".join(f"'{v}'" for v in REGIME_ORDER)})
            GROUP BY 1 HAVING min(momentum_score) < max(momentum_score) AND min(fwd) < max(fwd)""",
        "usable", "score",
    ),
    "hedges": with_ctes(
        f"SELECT ticker, {r('HIKING', 'CUTTING', 'NEUTRAL', 'gap')}, both_positive FROM hedged", "hedged"
    ),
    "best_hedges": with_ctes(
        f"""SELECT ticker, {r('HIKING', 'CUTTING', 'NEUTRAL', 'gap')}, both_positive
            FROM (SELECT * FROM hedged WHERE both_positive ORDER BY gap, ticker LIMIT 8)""",
        "hedged",
    ),
    "regime_ranking": with_ctes(
        f"""SELECT ticker, {r('avg_fwd_return_pct', 'win_rate_pct')}, observations
            FROM (SELECT ticker, avg(fwd) * 100 AS avg_fwd_return_pct,
                         avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END) * 100 AS win_rate_pct, count(*) AS observations
                  FROM usable WHERE composite_regime = (SELECT arg_max(composite_regime, date) FROM regime_fwd
                                                        WHERE composite_regime IS NOT NULL)
                  GROUP BY 1 HAVING count(*) >= 10 ORDER BY 2 DESC, 1 LIMIT 15)""",
        "usable",
    ),
    "transition_matrix": with_ctes(
        f"""SELECT "from", "to", n, CAST(occurrences AS BIGINT) AS occurrences, {r('probability')} FROM matrix""", "matrix"
    ),
    "transition_matrix_wide": with_ctes(
        f"""SELECT "from", {", ".join(f"round(max(probability) FILTER (\"to\" = '{a}_{b}'), 6) AS \"{a}_{b}\"" for a in STANCES for b in LEVELS)}
            FROM matrix GROUP BY 1""",
        "matrix",
    ),
    "next_regime": with_ctes(
        f"""SELECT "to", {r('probability')} FROM matrix WHERE "from" =
              (SELECT composite_regime FROM regimes GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)""",
        "matrix",
    ),
    "regime_confidence": with_ctes(
        """SELECT regime, CAST(historical_occurrences AS BIGINT) AS historical_occurrences, reliable,
                  historical_occurrences || ' month(s) observed: ' ||
                  CASE WHEN reliable THEN 'enough to rely on' ELSE 'fewer than 10, indicative only' END AS note FROM confidence""",
        "confidence",
    ),
    "expected_duration": with_ctes(f"SELECT regime, {r('expected_duration_months')} FROM durations", "durations"),
    "markov_report": with_ctes(
        f"""SELECT d.regime, {r('expected_duration_months')}, avg_spell_length_months, num_spells,
                   CAST(historical_occurrences AS BIGINT) AS historical_occurrences, reliable
            FROM durations d JOIN confidence c ON c.regime = d.regime LEFT JOIN summary s ON s.regime = d.regime""",
        "durations", "confidence", "summary",
    ),
    "event_transitions": """WITH pairs AS (SELECT event_type AS "from",
               lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS "to" FROM events),
             states AS (SELECT DISTINCT "from" AS s FROM pairs)
        SELECT a.s AS "from", b.s AS "to", count(p."from") AS n,
               CAST(sum(count(p."from")) OVER (PARTITION BY a.s) AS BIGINT) AS occurrences,
               round(CAST(count(p."from") AS DOUBLE) / nullif(sum(count(p."from")) OVER (PARTITION BY a.s), 0), 6) AS probability
        FROM states a CROSS JOIN states b LEFT JOIN pairs p ON p."from" = a.s AND p."to" = b.s GROUP BY a.s, b.s""",
    "tick_moving_averages": with_ctes(
        """SELECT event_id, round(CASE WHEN count(close) OVER f >= 30 THEN avg(close) OVER f END, 9) AS ma_50,
                  round(CASE WHEN count(close) OVER s >= 100 THEN avg(close) OVER s END, 9) AS ma_200
           FROM ticks WINDOW f AS (PARTITION BY ticker ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
                             s AS (PARTITION BY ticker ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""",
        "ticks",
    ),
    "tick_forward_return": with_ctes(
        """SELECT event_id, round(lead(close, 21) OVER (PARTITION BY ticker ORDER BY ts, event_id) / nullif(close, 0) - 1, 6)
                  AS fwd_return_21d FROM ticks""",
        "ticks",
    ),
    "dq_missing": with_ctes(
        """SELECT 'WARNING' AS severity, 'missing_trading_days' AS "check",
                  ticker || ': ' || printf('%.1f', pct) || '% of close prices are missing (threshold 5.0%)' AS message
           FROM (SELECT ticker, avg(CASE WHEN close IS NULL THEN 100.0 ELSE 0.0 END) AS pct FROM dense GROUP BY 1) WHERE pct > 5""",
        "dense",
    ),
    "dq_frozen": with_ctes(
        """SELECT 'WARNING' AS severity, 'frozen_price_feed' AS "check",
                  ticker || ': close has not changed over the last 4 rows' AS message
           FROM (SELECT ticker, floor(close / 1000) AS c, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS nth FROM prices)
           WHERE nth <= 4 GROUP BY ticker HAVING count(*) >= 4 AND min(c) = max(c)""",
        "prices",
    ),
    "dq_completeness": with_ctes(
        """SELECT CASE WHEN n = 0 THEN 'ERROR' ELSE 'WARNING' END AS severity, 'macro_completeness' AS "check",
                  '''' || name || ''': only ' || n || ' non-null observation(s) (threshold 10)' AS message FROM ("""
        + " UNION ALL ".join(
            f"SELECT '{c}' AS name, count({c}) AS n FROM raw_macro" for c in MACRO_SERIES
        )
        + " UNION ALL SELECT 'cpi_core', 0) WHERE n < 10",
        "raw_macro",
    ),
    "dq_rowcount": with_ctes(
        f"""SELECT 'ERROR' AS severity, 'row_count_regression' AS "check",
                   'row count dropped ' || printf('%.1f', pct) || '% (' || b || ' -> ' || c || ') against the previous run' AS message
            FROM (SELECT b, c, (b - c) * 100.0 / b AS pct FROM
                    (SELECT count(*) AS b, count(*) FILTER (WHERE date < DATE '{CUT_DAY}') AS c FROM prices))
            WHERE pct > 10""",
        "prices",
    ),
    "dq_all": with_ctes(
        f"""SELECT errors > 0 AS has_errors, errors, warnings FROM (
              SELECT (SELECT count(*) FROM (SELECT count(*) AS b, count(*) FILTER (WHERE date < DATE '{CUT_DAY}') AS c FROM dense)
                      WHERE (b - c) * 100.0 / b > 10) AS errors,
                     (SELECT count(*) FROM (SELECT avg(CASE WHEN close IS NULL THEN 100.0 ELSE 0.0 END) AS pct
                                            FROM dense GROUP BY ticker) WHERE pct > 5)
                   + (SELECT count(*) FROM (SELECT ticker FROM
                        (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS nth FROM dense)
                        WHERE nth <= 30 GROUP BY ticker HAVING count(close) >= 30 AND min(close) = max(close)))
                   + (SELECT count(*) FROM (SELECT unnest([{", ".join(f"count({c})" for c in MACRO_SERIES)}]) AS n FROM raw_macro)
                      WHERE n BETWEEN 1 AND 9) AS warnings)""",
        "dense", "raw_macro",
    ),
    "snapshot_asof": with_ctes(
        """SELECT ticker, max(date) AS date, arg_max(close, date) AS close,
                  round(arg_max(daily_return, date) FILTER (WHERE daily_return IS NOT NULL), 6) AS daily_return,
                  round(arg_max(fwd, date) FILTER (WHERE fwd IS NOT NULL), 6) AS fwd_return_21d
           FROM (SELECT r.*, f.fwd FROM returns r JOIN fwd f ON f.ticker = r.ticker AND f.date = r.date)
           WHERE date <= DATE '2001-12-31' GROUP BY ticker""",
        "returns", "fwd",
    ),
    "ticker_slice": with_ctes(
        """SELECT ticker, date, close, name FROM prices
           WHERE ticker = 'Brand#3' AND date BETWEEN DATE '1996-03-01' AND DATE '1998-06-30'""",
        "prices",
    ),
    "macro_view": with_ctes(
        f"SELECT date, {r('tbill_rate', 'cpi_all', 'zar_usd', 'zar_usd_mom_pct')} FROM macro", "macro"
    ),
    "momentum_ranking": with_ctes(
        "SELECT s.ticker, arg_max(s.name, s.date) AS name, arg_max(a.trend_signal, s.date) AS trend_signal, "
        + ", ".join(
            f"round(arg_max({c}, s.date) FILTER (WHERE {c} IS NOT NULL), 4) AS {c}"
            for c in ("momentum_score", "mom_1m", "mom_3m", "mom_6m", "rsi_14")
        )
        + " FROM score s JOIN rsi r ON r.ticker = s.ticker AND r.date = s.date"
        + " JOIN averages a ON a.ticker = s.ticker AND a.date = s.date"
        + f" WHERE s.date <= DATE '{CUT_DAY}' GROUP BY s.ticker",
        "score", "rsi", "averages",
    ),
    "latest_regime": with_ctes(
        f"""SELECT date, composite_regime, CAST(regime_duration AS INTEGER) AS regime_duration, {r('tbill_rate', 'cpi_yoy_pct')}
            FROM regimes ORDER BY date DESC LIMIT 1""",
        "regimes",
    ),
    "rebalance_dates": with_ctes("SELECT rebalance_date, rebalance_date AS cutoff FROM rebalances", "rebalances"),
    "rebalance_dates_embargo": with_ctes(
        """SELECT rebalance_date, cutoff FROM rebalances
           JOIN (SELECT date, lag(date, 21) OVER (ORDER BY date) AS cutoff FROM (SELECT DISTINCT date FROM prices))
             ON date = rebalance_date""",
        "rebalances",
    ),
    "chrono_split": with_ctes(
        f"""SELECT ticker, count(*) AS n, min(date) AS first, max(date) AS last,
                   CASE WHEN date < DATE '{CUT_DAY}' THEN 'train' ELSE 'test' END AS part FROM prices GROUP BY ticker, part""",
        "prices",
    ),
    "topn_picks": with_ctes(
        f"""SELECT date, CAST(pick_rank AS INTEGER) AS pick_rank, ticker, {r('momentum_score', 'fwd_return_21d')} FROM picks""",
        "picks",
    ),
    "period_results": with_ctes(
        f"""SELECT rebalance_date, picked_tickers,
                   {r('portfolio_return', 'alsi_return', 'excess_return', 'net_excess_return')}, beat_alsi FROM results""",
        "results",
    ),
    "cumulative_excess": with_ctes(
        """SELECT rebalance_date,
                  CAST(printf('%.8e', product(1 + net_excess_return) OVER w - 1) AS DOUBLE) AS cumulative_net_excess,
                  CAST(printf('%.8e', product(1 + excess_return) OVER w - 1) AS DOUBLE) AS cumulative_gross_excess
           FROM results WINDOW w AS (ORDER BY rebalance_date)""",
        "results",
    ),
    "rolling_hit_rate": with_ctes(
        """SELECT rebalance_date, round(CASE WHEN count(*) OVER w >= 6 THEN avg(CAST(beat_alsi AS INTEGER)) OVER w END, 6)
                  AS rolling_hit_rate_12m
           FROM results WINDOW w AS (ORDER BY rebalance_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
        "results",
    ),
    "backtest_summary": with_ctes(
        """SELECT count(*) AS n_periods, round(avg(CAST(beat_alsi AS INTEGER)), 3) AS hit_rate,
                  round(avg(excess_return), 4) AS avg_excess_return_gross, round(avg(net_excess_return), 4) AS avg_excess_return_net,
                  round(CASE WHEN min(net_excess_return) < max(net_excess_return)
                             THEN avg(net_excess_return) / stddev_samp(net_excess_return) * sqrt(12) END, 2) AS sharpe_style_ratio,
                  CASE WHEN count(*) = 0 THEN 'No rebalance period could be evaluated.'
                       WHEN count(*) < 24 THEN count(*) || ' monthly periods: a thin sample, read with caution.'
                       ELSE count(*) || ' monthly periods: one historical path, no guarantee.' END AS note
           FROM results""",
        "results",
    ),
    "return_distribution": with_ctes(
        """SELECT count(net_excess_return) AS count, round(avg(net_excess_return), 6) AS mean,
                  round(stddev_samp(net_excess_return), 6) AS std, round(min(net_excess_return), 6) AS min,
                  round(quantile_cont(net_excess_return, 0.25), 6) AS p25, round(quantile_cont(net_excess_return, 0.5), 6) AS p50,
                  round(quantile_cont(net_excess_return, 0.75), 6) AS p75, round(max(net_excess_return), 6) AS max FROM results""",
        "results",
    ),
    "return_histogram": with_ctes(
        """SELECT bin, round(lo + (hi - lo) / 30 * (bin - 1), 6) AS low_edge, round(lo + (hi - lo) / 30 * bin, 6) AS high_edge,
                  (SELECT count(*) FROM results WHERE CAST(least(coalesce(floor((net_excess_return - lo) / nullif(hi - lo, 0) * 30), 0), 29) + 1 AS INTEGER) = bin) AS n
           FROM (SELECT min(net_excess_return) AS lo, max(net_excess_return) AS hi FROM results),
                (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS bin) WHERE lo < hi OR lo = hi AND bin = 1""",
        "results",
    ),
    "feature_matrix": with_ctes(
        f"""SELECT ticker, date, {r('momentum_score', 'rsi_14')}, CAST(trend_signal AS DOUBLE) AS trend_signal, {FLAGS}
            FROM features""",
        "features",
    ),
    "standardisation": with_ctes(
        f"""SELECT feature, round(mean, 6) AS mean, round(CASE WHEN scale > 0 THEN scale ELSE 1 END, 6) AS scale FROM (
              SELECT unnest([{", ".join(f"'{c}'" for c in MATRIX_COLUMNS)}]) AS feature,
                     unnest([{", ".join(f"avg({c})" for c in MATRIX_COLUMNS)}]) AS mean,
                     unnest([{", ".join(f"stddev_pop({c})" for c in MATRIX_COLUMNS)}]) AS scale
              FROM (SELECT momentum_score, rsi_14, trend_signal, {FLAGS} FROM features
                    WHERE momentum_score IS NOT NULL AND rsi_14 IS NOT NULL AND trend_signal IS NOT NULL
                      AND composite_regime IS NOT NULL AND outperformed IS NOT NULL))""",
        "features",
    ),
    "class_check": with_ctes(
        """SELECT count(outperformed) AS n_rows, count(DISTINCT outperformed) AS n_classes, round(avg(outperformed), 6) AS base_rate,
                  count(DISTINCT outperformed) = 2 AS trainable FROM labels21""",
        "labels21",
    ),
    "enriched_panel": with_ctes(
        f"""SELECT p.date, p.ticker, p.open, p.high, p.low, p.close, p.volume, p.name, {r('daily_return', 'log_return')},
                   round(CASE WHEN count(log_return) OVER v >= 10 THEN stddev_samp(log_return) OVER v END * sqrt(252), 6)
                     AS volatility_21d,
                   CASE WHEN count(p.close) OVER y >= 50 THEN max(p.close) OVER y END AS high_52w,
                   CASE WHEN count(p.close) OVER y >= 50 THEN min(p.close) OVER y END AS low_52w,
                   round(CASE WHEN count(p.close) OVER y >= 50 THEN (p.close - max(p.close) OVER y) / max(p.close) OVER y END, 6)
                     AS pct_from_52w_high,
                   CAST(year(p.date) AS INTEGER) AS year, CAST(month(p.date) AS INTEGER) AS month,
                   CAST(quarter(p.date) AS INTEGER) AS quarter, CAST(isodow(p.date) - 1 AS INTEGER) AS day_of_week,
                   {", ".join(f"round(m.{c}, 6) AS {c}" for c in (*MACRO_SERIES, *DERIVED))},
                   {r('gdp_growth_pct', 'govt_debt_gdp', 'unemployment_pct')},
                   {r(*MOMENTUM_ROWS, *[f'{c}_z' for c in MOMENTUM_ROWS], 'momentum_score')},
                   round(CASE WHEN count(p.close) OVER z >= 10 AND min(p.close) OVER z < max(p.close) OVER z
                              THEN (p.close - avg(p.close) OVER z) / stddev_samp(p.close) OVER z END, 6) AS price_z_20d,
                   {r('ma_50', 'ma_200', places=4)}, {r('ma_ratio_50_200', 'rsi_14')}, trend_signal,
                   rate_regime, inflation_regime, currency_regime, composite_regime,
                   CAST(regime_duration AS INTEGER) AS regime_duration
            FROM returns p JOIN score s ON s.ticker = p.ticker AND s.date = p.date
            JOIN averages a ON a.ticker = p.ticker AND a.date = p.date
            JOIN rsi r ON r.ticker = p.ticker AND r.date = p.date
            ASOF LEFT JOIN macro m ON p.date >= m.date
            ASOF LEFT JOIN regimes g ON p.date >= g.date
            ASOF LEFT JOIN (SELECT *, make_date(year, 1, 1) AS start FROM annual) n ON p.date >= n.start
            WINDOW v AS (PARTITION BY p.ticker ORDER BY p.date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW),
                   y AS (PARTITION BY p.ticker ORDER BY p.date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW),
                   z AS (PARTITION BY p.ticker ORDER BY p.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
        "returns", "score", "averages", "rsi", "macro", "regimes", "annual",
    ),
    "fit_coefficients": model_sql(
        f"""SELECT feature, round(coefficient, 5) AS coefficient
            FROM (SELECT unnest([{", ".join(f"'{c}'" for c in MODEL_INPUTS)}]) AS feature, unnest(w[2:]) AS coefficient FROM fitted)
            WHERE NOT starts_with(feature, 'regime_') OR feature IN (SELECT DISTINCT 'regime_' || composite_regime FROM features
                                                                   WHERE {COMPLETE} AND outperformed IS NOT NULL)""",
        "SELECT 0 AS fit, * FROM features",
        10,
    ),
    "predict_proba": model_sql(
        f"""SELECT ticker, date, round({chance()}, 5) AS predicted_proba, outperformed FROM features, fitted WHERE date >= DATE '1999-07-01'""",
        "SELECT 0 AS fit, * FROM features WHERE date < DATE '1999-07-01'",
        10,
    ),
    "walk_forward": model_sql(
        f"""SELECT rebalance_date, picked_tickers, {r("portfolio_return", "alsi_return", "excess_return")},
                   round(excess_return - CAST(0.0015 AS DOUBLE), 6) AS net_excess_return, coalesce(excess_return > 0, false) AS beat_alsi, true AS converged
            FROM (SELECT *, portfolio_return - alsi_return AS excess_return
                  FROM (SELECT fit AS rebalance_date, string_agg(ticker, ', ' ORDER BY place) AS picked_tickers, avg(fwd_return_21d) AS portfolio_return,
                               any_value(alsi_fwd_return_21d) AS alsi_return
                        FROM (SELECT fit, ticker, fwd_return_21d, alsi_fwd_return_21d, row_number() OVER (PARTITION BY fit ORDER BY p DESC, ticker) AS place
                              FROM (SELECT fit, ticker, {chance()} AS p FROM features JOIN fitted ON date = fit) JOIN labels21 USING (ticker)
                              WHERE labels21.date = fit AND p IS NOT NULL AND fwd_return_21d IS NOT NULL AND ticker <> '^INDEX')
                        WHERE place <= 5 GROUP BY fit HAVING count(*) = 5))""",
        "SELECT rebalance_date AS fit, f.* FROM rebalances JOIN features f ON f.date < rebalance_date",
        10,
    ),
    "walk_forward_fits": model_sql(
        "SELECT fit AS rebalance_date, count(*) AS train_rows, true AS converged FROM train JOIN fitted USING (fit) GROUP BY fit",
        "SELECT rebalance_date AS fit, f.* FROM rebalances JOIN features f ON f.date < rebalance_date",
        1,
    ),
    "walk_forward_coefficients": model_sql(
        f"""SELECT rebalance_date, feature, round(coefficient, 5) AS coefficient
            FROM (SELECT fit AS rebalance_date, unnest([{", ".join(f"'{c}'" for c in MODEL_INPUTS)}]) AS feature, unnest(w[2:]) AS coefficient FROM fitted)
            WHERE NOT starts_with(feature, 'regime_') OR feature IN (SELECT DISTINCT 'regime_' || composite_regime FROM features
                                                                   WHERE {COMPLETE} AND outperformed IS NOT NULL)""",
        "SELECT rebalance_date AS fit, f.* FROM rebalances JOIN features f ON f.date < rebalance_date",
        10,
    ),
    "freshness_report": with_ctes(
        """SELECT 'prices' AS table_name, CAST(max(date) AS VARCHAR) AS latest, count(*) AS n_rows, 10 AS file_age_days, true AS stale FROM prices
           UNION ALL SELECT 'macro', NULL, NULL, NULL, NULL
           UNION ALL SELECT 'annual', CAST(max(year) AS VARCHAR), count(*), 10, true FROM annual""",
        "prices", "annual",
    ),
    "tick_rsi": tick_rsi_sql(14),
    "tick_rsi_200": tick_rsi_sql(200),
    "tick_compounded": """SELECT event_id, round(product(1 + (value / 100000 - 0.0005::DOUBLE)) OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1, 6) AS own,
                  round(product(1 + (value / 100000 - 0.0005::DOUBLE)) OVER (ORDER BY ts, event_id) - 1, 6) AS overall FROM events""",
    "tick_filled": """SELECT event_id, CASE WHEN count(v) OVER near > 0 THEN last_value(v IGNORE NULLS) OVER w END AS close,
                  last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last
           FROM (SELECT *, CASE WHEN value < 20 THEN value END AS v FROM events)
           WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
                  near AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
    "tick_spell_rows": """WITH moved AS (SELECT event_id, event_type, ts, CASE WHEN side IS DISTINCT FROM lag(side) OVER (PARTITION BY event_type ORDER BY ts, event_id)
                                 THEN 1 ELSE 0 END AS state_changed
                  FROM (SELECT *, value >= 50 AS side FROM events)),
           numbered AS (SELECT *, (sum(state_changed) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS spell FROM moved)
           SELECT event_id, state_changed, spell, row_number() OVER (PARTITION BY event_type, spell ORDER BY ts, event_id) AS spell_duration FROM numbered""",
    "event_spells": """SELECT spell, any_value(event_type) AS event_type, min(event_id) AS start, max(event_id) AS "end", count(*) AS n_rows
           FROM (SELECT *, (sum(c) OVER (ORDER BY event_id))::BIGINT AS spell
                 FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS c FROM events))
           GROUP BY spell""",
    "asof_clicks": """SELECT p.event_id, p.ts, p.user_id, p.value, c.event_id AS click_id, c.value AS click_value, g.event_id AS signup_id
           FROM (SELECT * FROM events WHERE event_type = 'purchase') p
           ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts
           ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') g ON p.ts >= g.ts""",
    "price_quantiles": """WITH share AS (SELECT unnest([0, 0.05, 0.25, 0.5, 0.75, 0.95, 1])::DOUBLE AS share),
           given AS (SELECT l_returnflag, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'all', l_extendedprice FROM lineitem),
           held AS (SELECT l_returnflag, list(v ORDER BY v) AS l FROM given GROUP BY 1)
           SELECT l_returnflag, share, round(l[1 + floor(r)::INT] + (r - floor(r)) * (l[1 + ceil(r)::INT] - l[1 + floor(r)::INT]), 6) AS value
           FROM (SELECT *, share * (len(l) - 1) AS r FROM held, share)""",
    "snapshot_history": with_ctes(
        """SELECT '2001-01-01' AS run_date, ticker, date, close FROM prices WHERE date < DATE '1999-07-01'
           UNION ALL SELECT '2001-02-01', ticker, date, close FROM prices""",
        "prices",
    ),
    "best_panel": with_ctes(f"SELECT ticker, date, {r('momentum_score')} FROM score", "score"),
    "master_without_annual": with_ctes(
        f"SELECT p.ticker, p.date, p.close, {r('tbill_rate', 'zar_usd')} FROM prices p ASOF LEFT JOIN macro m ON p.date >= m.date", "prices", "macro"
    ),
}
