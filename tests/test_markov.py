from __future__ import annotations

import pytest
from conftest import column, months
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelwright.operators import markov


@pytest.fixture
def fit(spark):
    def build(states):
        rows = list(zip(months(len(states)), states))
        return markov.fit_transitions(spark.createDataFrame(rows, "date date, composite_regime string")).cache()

    return build


def cells(matrix):
    return {(r["from"], r["to"]): r["probability"] for r in matrix.collect()}


SEQUENCE = list("AABAABABBAAB")


def test_probabilities_and_counts(fit):
    matrix = fit(SEQUENCE)
    p = cells(matrix)
    assert p[("A", "A")] == pytest.approx(3 / 7) and p[("A", "B")] == pytest.approx(4 / 7)
    assert p[("B", "A")] == pytest.approx(3 / 4) and p[("B", "B")] == pytest.approx(1 / 4)
    assert {r["from"]: r["occurrences"] for r in matrix.collect()} == {"A": 7, "B": 4}


def test_rows_sum_to_one(fit):
    sums = fit(SEQUENCE).groupBy("from").agg(F.sum("probability").alias("s"))
    assert column(sums, "s", "from") == pytest.approx([1.0, 1.0])


def test_square_includes_unseen_transitions(fit):
    p = cells(fit(list("ABCABC")))
    assert len(p) == 9 and p[("A", "C")] == 0.0


def test_state_seen_only_last_has_no_probabilities(fit):
    matrix = fit(list("AABAC"))
    assert cells(matrix)[("C", "A")] is None
    confidence = {r["regime"]: r["historical_occurrences"] for r in markov.regime_confidence(matrix).collect()}
    assert confidence["C"] == 0
    assert {r["regime"]: r["expected_duration_months"] for r in markov.expected_duration(matrix).collect()}["C"] is None


def test_next_regime_is_sorted(fit):
    out = markov.next_regime_probabilities(fit(SEQUENCE), "B")
    assert [tuple(r) for r in out.collect()] == [("A", pytest.approx(0.75)), ("B", pytest.approx(0.25))]


@pytest.mark.parametrize("state", ["C", "Z"])
def test_next_regime_of_unknown_or_final_state_fails(fit, state):
    with pytest.raises(PySparkException, match=state):
        markov.next_regime_probabilities(fit(list("AABAC")), state).collect()


def test_confidence(fit):
    out = {r["regime"]: r for r in markov.regime_confidence(fit(["A"] * 12 + ["B", "A"])).collect()}
    assert out["A"]["reliable"] and not out["B"]["reliable"]
    assert "indicative" in out["B"]["note"] and out["B"]["historical_occurrences"] == 1


def test_expected_duration(fit):
    states = ["STICKY"] * 4 + ["OTHER"] + ["STICKY"] * 4 + ["OTHER"]
    out = {r["regime"]: r["expected_duration_months"] for r in markov.expected_duration(fit(states)).collect()}
    assert out["STICKY"] == pytest.approx(4.0) and out["OTHER"] == pytest.approx(1.0)
    assert markov.expected_duration(fit(["LOCKED"] * 10)).first()["expected_duration_months"] == float("inf")


def test_report(spark):
    rows = list(zip(months(12), SEQUENCE))
    report = markov.markov_report(spark.createDataFrame(rows, "date date, composite_regime string")).collect()
    a = report[0]
    assert a["regime"] == "A" and a["num_spells"] == 4 and a["avg_spell_length_months"] == 1.8
    assert a["expected_duration_months"] == pytest.approx(1 / (1 - 3 / 7))


def test_wide_matrix(fit):
    out = markov.wide_matrix(fit(SEQUENCE), ["A", "B"]).collect()
    assert [r["from"] for r in out] == ["A", "B"] and out[1]["A"] == pytest.approx(0.75)


def test_missing_states_are_skipped(spark):
    rows = list(zip(months(4), ["A", None, "B", "A"]))
    out = markov.fit_transitions(spark.createDataFrame(rows, "date date, composite_regime string"))
    assert cells(out)[("A", "B")] == 1.0


def test_long_sequence_in_segments(spark):
    states = [("A", "B", "C")[(k * k) % 3] for k in range(400)]
    df = spark.createDataFrame(list(enumerate(states)), "at int, state string")
    whole = markov.fit_transitions(df, "state", "at")
    cut = markov.fit_transitions(df, "state", "at", rows_per_segment=30)
    assert cells(whole) == cells(cut)


def test_unknown_states_can_be_dropped(spark):
    rows = list(zip(months(4), ["HIKING_nan", "HIKING_LOW_INFLATION", "UNKNOWN_UNKNOWN", "HIKING_LOW_INFLATION"]))
    df = spark.createDataFrame(rows, "date date, composite_regime string")
    assert len(cells(markov.fit_transitions(df))) == 9
    assert cells(markov.fit_transitions(df, drop_unknown=True)) == {("HIKING_LOW_INFLATION",) * 2: 1.0}
