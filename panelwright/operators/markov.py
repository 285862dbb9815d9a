"""First-order Markov chain of regimes as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions import fixed_values as fixed
from panelwright.functions.guarded import ratio
from panelwright.operators.regimes import spell_summary
from panelwright.operators.segments import in_segments

Keys = Sequence[str]


def transition_pairs(
    history: DataFrame,
    state: str = "composite_regime",
    order: str = "date",
    by: Keys = (),
    rows_per_segment: int | None = None,
) -> DataFrame:
    """(from, to) of consecutive rows; ``to`` is NULL on the last row of a sequence.

    Monthly regime tables are short. A sequence ordered by something finer may be of any length; with
    ``rows_per_segment`` it is processed in segments.
    """
    known = history.where(F.col(state).isNotNull()).select(*by, order, F.col(state).alias("from"))

    def step(rows: DataFrame, keys: Keys) -> DataFrame:
        return rows.withColumn("to", F.lead("from", 1).over(W.partitionBy(*keys).orderBy(order)))

    if rows_per_segment is None:
        paired = step(known, by)
    else:
        paired = in_segments(known, step, by, [order], ahead=1, rows_per_segment=rows_per_segment)
    return paired.select(*by, "from", "to")


def transition_matrix(pairs: DataFrame, by: Keys = ()) -> DataFrame:
    """(from, to, n, occurrences, probability) for every ordered pair of observed states.

    ``occurrences`` counts departures from a state; a state that was never left has NULL probabilities. States are a
    small vocabulary: the square is made from the set of states, not by a join.
    """
    by = list(by)
    counts = pairs.groupBy(*by, "from", "to").agg(F.count(F.lit(1)).alias("n"))
    square = (
        counts.groupBy(*by)
        .agg(F.collect_set("from").alias("_states"))
        .withColumn("from", F.explode("_states"))
        .withColumn("to", F.explode("_states"))
        .drop("_states")
    )
    filled = square.join(counts, [*by, "from", "to"], "left").na.fill(0, ["n"])
    occurrences = F.sum("n").over(W.partitionBy(*by, "from"))
    return filled.withColumn("occurrences", occurrences).withColumn(
        "probability", ratio(F.col("n").cast("double"), F.col("occurrences").cast("double"))
    )


def fit_transitions(
    history: DataFrame,
    state: str = "composite_regime",
    order: str = "date",
    by: Keys = (),
    rows_per_segment: int | None = None,
    drop_unknown: bool = False,
) -> DataFrame:
    """Transition matrix of a regime table. ``drop_unknown`` leaves out months with a missing or unknown label part."""
    known = history
    if drop_unknown:
        known = history.where(~F.col(state).rlike("(^|_)(nan|UNKNOWN)(_|$)"))
    return transition_matrix(transition_pairs(known, state, order, by, rows_per_segment), by)


def wide_matrix(matrix: DataFrame, states: Sequence[str]) -> DataFrame:
    """Display form: one row per from-state, one column per listed to-state."""
    return matrix.groupBy("from").pivot("to", list(states)).agg(F.first("probability")).orderBy("from")


def next_regime_probabilities(matrix: DataFrame, current: str | Column) -> DataFrame:
    """Distribution over the next state, most likely first; fails when the state is unknown or was never left.

    The check runs inside the query, on the few rows of one from-state.
    """
    state = F.lit(current) if isinstance(current, str) else current
    mine = matrix.where(F.col("from") == state)
    seen = mine.agg(F.max("occurrences").alias("_seen")).scalar()
    problem = F.when(seen.isNull(), F.raise_error(F.concat(state, F.lit(" does not occur in the history")))).when(
        seen == 0, F.raise_error(F.concat(state, F.lit(" occurs only as the last observation, no transitions known")))
    )
    # A one-row range carries the check, so that it also runs when no matrix row matches.
    spark = matrix.sparkSession
    checked = spark.range(1).select(problem.cast("string").alias("_problem"))
    listed = mine.select("to", "probability")
    return (
        checked.join(listed, F.col("_problem").isNull(), "left")
        .where(F.col("_problem").isNull() & F.col("to").isNotNull())
        .select("to", "probability")
        .orderBy(F.desc("probability"), "to")
    )


def regime_confidence(matrix: DataFrame, by: Keys = (), min_transitions: int = fixed.MIN_TRANSITIONS) -> DataFrame:
    """How many departures back the probabilities of each state."""
    n = F.col("historical_occurrences")
    counted = matrix.groupBy(*by, F.col("from").alias("regime")).agg(
        F.max("occurrences").alias("historical_occurrences")
    )
    verdict = F.when(n >= min_transitions, F.lit("enough to rely on")).otherwise(
        F.lit(f"fewer than {min_transitions}, indicative only")
    )
    return counted.withColumn("reliable", n >= min_transitions).withColumn(
        "note", F.concat(n.cast("string"), F.lit(" month(s) observed: "), verdict)
    )


def expected_duration(matrix: DataFrame, by: Keys = ()) -> DataFrame:
    """Mean months until a state is left, 1 / (1 - P(stay)): infinite if it always stays, NULL if never left."""
    stay = F.col("probability")
    return matrix.where(F.col("from") == F.col("to")).select(
        *by,
        F.col("from").alias("regime"),
        F.when(stay >= 1.0, F.lit(float("inf"))).otherwise(ratio(F.lit(1.0), F.lit(1.0) - stay)).alias(
            "expected_duration_months"
        ),
    )


def markov_report(regimes: DataFrame, by: Keys = ()) -> DataFrame:
    """Per regime: expected and observed spell length, number of spells, and reliability."""
    by = list(by)
    matrix = fit_transitions(regimes, by=by)
    report = (
        expected_duration(matrix, by)
        .join(regime_confidence(matrix, by), [*by, "regime"])
        .join(spell_summary(regimes, by), [*by, "regime"], "left")
    )
    return report.select(
        *by,
        "regime",
        "expected_duration_months",
        "avg_spell_length_months",
        "num_spells",
        "historical_occurrences",
        "reliable",
    ).orderBy(*by, "regime")
