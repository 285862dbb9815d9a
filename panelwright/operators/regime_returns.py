"""How forward returns differ between regimes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import fixed_values as fixed
from panelwright.functions.guarded import growth, pearson, ratio, series_window
from panelwright.operators.regimes import spells

Keys = Sequence[str]
RETURN = "fwd_return_21d"
REGIME = "composite_regime"


def forward_return(panel: DataFrame, rows: int = fixed.FORWARD_ROWS, keys: Keys = ("ticker",)) -> DataFrame:
    """Return over the next ``rows`` rows of the same series."""
    later = F.lead("close", rows).over(series_window(keys))
    return panel.withColumn(RETURN, growth(later, F.col("close")))


def usable_returns(panel: DataFrame) -> DataFrame:
    return panel.dropna(subset=[REGIME, RETURN])


def ticker_regime_returns(
    panel: DataFrame, min_observations: int = fixed.MIN_OBSERVATIONS, keys: Keys = ("ticker",)
) -> DataFrame:
    """Mean forward return in percent and its sample size per series and regime; NULL below the minimum size."""
    cells = usable_returns(panel).groupBy(*keys, REGIME).agg(
        F.avg(RETURN).alias("_mean"), F.count(RETURN).alias("observations")
    )
    shown = F.when(F.col("observations") >= min_observations, F.col("_mean") * 100)
    return cells.select(*keys, REGIME, "observations", shown.alias("avg_fwd_return_pct"))


def reliable_cells(
    panel: DataFrame,
    regimes: DataFrame,
    min_observations: int = fixed.MIN_OBSERVATIONS,
    min_spells: int = fixed.MIN_SPELLS,
    keys: Keys = ("ticker",),
) -> DataFrame:
    """As ``ticker_regime_returns``, also blanking regimes that occurred in too few separate spells."""
    counts = spells(regimes).groupBy(F.col("regime").alias(REGIME)).agg(F.count(F.lit(1)).alias("num_spells"))
    cells = ticker_regime_returns(panel, min_observations, keys).join(counts, REGIME, "left")
    # A regime missing from the spell table is not known to be unreliable.
    enough = F.coalesce(F.col("num_spells") >= min_spells, F.lit(True))
    return cells.select(
        *keys,
        REGIME,
        "observations",
        "num_spells",
        enough.alias("enough_spells"),
        F.when(enough, F.col("avg_fwd_return_pct")).alias("avg_fwd_return_pct"),
    )


def regime_heatmap(cells: DataFrame, order: Sequence[str] = fixed.REGIME_ORDER, keys: Keys = ("ticker",)) -> DataFrame:
    """One column per regime in the given order and the mean of the known ones, best series first."""
    wide = cells.groupBy(*keys).pivot(REGIME, list(order)).agg(F.first("avg_fwd_return_pct", ignorenulls=True))
    known = F.filter(F.array(*[F.col(r) for r in order]), lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    mean = ratio(total, F.size(known).cast("double"))
    return wide.withColumn("mean_across_regimes", mean).orderBy(F.desc_nulls_last("mean_across_regimes"), *keys)


def momentum_efficacy(panel: DataFrame, order: Sequence[str] = fixed.REGIME_ORDER) -> DataFrame:
    """Correlation of the momentum score with the forward return, per listed regime where it is defined."""
    known = usable_returns(panel).dropna(subset=["momentum_score"]).where(F.col(REGIME).isin(*order))
    measured = known.groupBy(REGIME).agg(pearson(F.col("momentum_score"), F.col(RETURN)).alias("correlation"))
    return measured.where(F.col("correlation").isNotNull())


def regime_hedges(panel: DataFrame, keys: Keys = ("ticker",)) -> DataFrame:
    """Mean forward return while rates rise and while they fall, smallest gap first.

    A series is kept only if it has observations in every rate stance that occurs anywhere in the panel, so that a
    NEUTRAL (or UNKNOWN) stance seen for some series is required of all.
    """
    rated = usable_returns(panel).withColumn("_stance", F.split(REGIME, "_")[0])
    occurring = rated.agg(F.count_distinct("_stance").alias("_n")).scalar()

    def mean_in(stance: str) -> Column:
        return (F.avg(F.when(F.col("_stance") == stance, F.col(RETURN))) * 100).alias(stance)

    both = rated.groupBy(*keys).agg(
        mean_in("HIKING"),
        mean_in("CUTTING"),
        mean_in("NEUTRAL"),
        F.size(F.collect_set("_stance")).alias("_stances"),
    )
    return (
        both.where(F.col("_stances") == occurring)
        .dropna(subset=["HIKING", "CUTTING"])
        .drop("_stances")
        .withColumn("gap", F.abs(F.col("HIKING") - F.col("CUTTING")))
        .withColumn("both_positive", (F.col("HIKING") > 0) & (F.col("CUTTING") > 0))
        .orderBy("gap", *keys)
    )


def best_hedges(hedges: DataFrame, n: int = 8, keys: Keys = ("ticker",)) -> DataFrame:
    return hedges.where("both_positive").orderBy("gap", *keys).limit(n)


def current_regime_ranking(
    panel: DataFrame,
    min_observations: int = fixed.MIN_RANKED_OBSERVATIONS,
    top: int | None = 15,
    keys: Keys = ("ticker",),
) -> DataFrame:
    """Series ranked by their mean forward return in the regime in force on the panel's last day."""
    known = panel.where(F.col(REGIME).isNotNull())
    current = known.agg(F.max_by(REGIME, F.struct("date", REGIME)).alias("_current")).scalar()
    ranked = (
        usable_returns(panel)
        .where(F.col(REGIME) == current)
        .groupBy(*keys)
        .agg(
            (F.avg(RETURN) * 100).alias("avg_fwd_return_pct"),
            (F.avg(F.when(F.col(RETURN) > 0, 1.0).otherwise(0.0)) * 100).alias("win_rate_pct"),
            F.count(RETURN).alias("observations"),
        )
        .where(F.col("observations") >= min_observations)
        .orderBy(F.desc("avg_fwd_return_pct"), *keys)
    )
    return ranked if top is None else ranked.limit(top)
