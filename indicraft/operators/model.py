"""Regression on engineered features with pyspark.ml."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cleaning import clamp, round_half_up
from ..session import attach_stats, materialize

# Default settings and search grid of the boosted trees.
DEFAULT_PARAMS = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8}
DEFAULT_GRID = {"maxIter": [200, 400], "maxDepth": [4, 6, 8], "stepSize": [0.03, 0.05, 0.1]}

Z90 = 1.6448536269514722


@dataclass
class Trained:
    model: GBTRegressionModel
    features: list[str]
    params: dict[str, Any]
    cv_mae: list[float] = field(default_factory=list)
    trials: list[tuple[dict[str, Any], float]] = field(default_factory=list)  # settings of the grid and their mean fold MAE

    def importances(self) -> dict[str, float]:
        """Feature weights, largest first."""
        pairs = zip(self.features, self.model.featureImportances.toArray().tolist())
        return dict(sorted(((n, round(w, 6)) for n, w in pairs), key=lambda x: -x[1]))


def ordered_positions(df: DataFrame, order: str, ties: Sequence[str] = (), out: str = "_position") -> DataFrame:
    """Add each row's place (0, 1, ...) in the order of `order`, then `ties`, nulls last.

    Rows are range-partitioned and stored once, so places inside a slice and the slices'
    offsets agree; no task sees more than a slice. Rows equal in `order` alone may lie in one
    slice, so give `ties` a key where one value of `order` holds much of the table.
    """
    edges = [F.col(c).asc_nulls_last() for c in (order, *ties)]
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(slices, *edges).withColumn("_slice", F.spark_partition_id()), "positions")
    inside = F.row_number().over(W.partitionBy("_slice").orderBy(*edges)) - 1
    sizes = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    # one row per slice
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.withColumn(out, inside).join(offsets, "_slice").withColumn(out, F.col(out) + F.col("_before")).drop("_slice", "_before")


def temporal_split(df: DataFrame, order: str, frac: float = 0.75, ties: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """First `frac` of the ordered rows for training, the rest for testing; `ties` orders rows of one time."""
    placed = ordered_positions(df, order, ties)
    early = F.col("_position") < F.floor(F.lit(float(frac)) * F.col("_rows.n"))
    tagged = attach_stats(placed, placed.agg(F.count(F.lit(1)).alias("n")), "_rows")
    return tagged.filter(early).drop("_position", "_rows"), tagged.filter(~early).drop("_position", "_rows")


def expanding_folds(df: DataFrame, order: str, folds: int, ties: Sequence[str] = ()) -> list[tuple[DataFrame, DataFrame]]:
    """Fold i tests on the i-th of the last `folds` slices of n // (folds + 1) rows and trains on all before it."""
    placed = ordered_positions(df, order, ties)
    tagged = attach_stats(placed, placed.agg(F.count(F.lit(1)).alias("n")), "_rows")
    size, place = F.floor(F.col("_rows.n") / (folds + 1)), F.col("_position")
    out = []
    for i in range(folds):
        first = F.col("_rows.n") - size * (folds - i)
        out.append((tagged.filter(place < first).drop("_position", "_rows"), tagged.filter((place >= first) & (place < first + size)).drop("_position", "_rows")))
    return out


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature vector; absent columns count as 0, rows with a missing feature are left out."""
    present = [c for c in features if c in df.columns]
    full = df.dropna(subset=present)
    for c in features:
        if c not in df.columns:
            full = full.withColumn(c, F.lit(0.0))
    return VectorAssembler(inputCols=list(features), outputCol="_features").transform(full)


def _fit(df: DataFrame, features: Sequence[str], label: str, params: Mapping[str, Any], seed: int) -> GBTRegressionModel:
    booster = GBTRegressor(featuresCol="_features", labelCol=label, predictionCol="_fit", seed=seed, **params)
    return booster.fit(_vectors(df.dropna(subset=[label]), features).select("_features", F.col(label).cast("double").alias(label)))


def _mae(model: GBTRegressionModel, df: DataFrame, features: Sequence[str], label: str) -> float:
    scored = model.transform(_vectors(df.dropna(subset=[label]), features))
    return scored.agg(F.avg(F.abs(F.col(label) - F.col("_fit"))).alias("mae")).first()["mae"]


def _fold_errors(pairs: Sequence[tuple[DataFrame, DataFrame]], features: Sequence[str], label: str, params: Mapping[str, Any], seed: int) -> list[float]:
    """MAE of every fold; the folds are independent jobs, so the scheduler may run them side by side."""
    with ThreadPoolExecutor(max_workers=4) as pool:
        return list(pool.map(lambda p: _mae(_fit(p[0], features, label, params, seed), p[1], features, label), pairs))


def train_gbt(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    order: str | None = None,
    params: Mapping[str, Any] | None = None,
    grid: Mapping[str, Sequence[Any]] | None = None,
    folds: int = 4,
    tune_folds: int = 3,
    minimum_rows: int = 100,
    seed: int = 42,
    ties: Sequence[str] = (),
) -> Trained:
    """Fit boosted trees, refusing fewer than `minimum_rows` complete rows; with `grid` the best setting by fold MAE is used, and with
    `order` the MAE of each expanding time fold is reported.

    The training frame is stored once, as every boosting round reads it.
    """
    needed = list(dict.fromkeys([*[c for c in features if c in df.columns], label, *([order] if order else []), *ties]))
    stored = materialize(df.select(*needed).dropna(subset=[c for c in needed if c != order]), "train")
    rows = stored.count()
    if rows < minimum_rows:
        raise ValueError(f"{rows} complete rows, at least {minimum_rows} needed")
    chosen = {**DEFAULT_PARAMS, **(params or {})}
    trials: list[tuple[dict[str, Any], float]] = []
    if grid:
        if order is None:
            raise ValueError("a grid search needs an order column for its folds")
        pairs = expanding_folds(stored, order, tune_folds, ties)
        for values in product(*grid.values()):
            trial = {**chosen, **dict(zip(grid, values))}
            maes = _fold_errors(pairs, features, label, trial, seed)
            trials.append((trial, sum(maes) / len(maes)))
        chosen = min(trials, key=lambda t: t[1])[0]
    cv = []
    if order and folds:
        cv = _fold_errors(expanding_folds(stored, order, folds, ties), features, label, chosen, seed)
    return Trained(_fit(stored, features, label, chosen, seed), list(features), chosen, cv, trials)


def regression_metrics(df: DataFrame, y: str, yhat: str, digits: int = 4) -> DataFrame:
    """rmse, mae, r2, mean residual and largest error in one aggregate, with the leak warning (r2 > 0.5)."""
    err = F.col(y).cast("double") - F.col(yhat).cast("double")
    sse = F.sum(err * err)
    sst = F.var_pop(F.col(y).cast("double")) * F.count(F.lit(1))
    r2 = F.lit(1.0) - sse / F.nullif(sst, F.lit(0.0))
    return df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull()).agg(
        round_half_up(F.sqrt(F.avg(err * err)), digits).alias("rmse"),
        round_half_up(F.avg(F.abs(err)), digits).alias("mae"),
        round_half_up(r2, digits).alias("r2"),
        round_half_up(F.avg(err), digits).alias("mean_residual"),
        round_half_up(F.max(F.abs(err)), digits).alias("max_error"),
        (r2 > 0.5).alias("suspicious_r2"),
    )


def predict(trained: Trained, df: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    scored = trained.model.transform(_vectors(df, trained.features))
    return scored.select(key, *keep, F.col("_fit").alias("predicted_change"))


def with_interval(df: DataFrame, pred: str, rmse: float, scale: float = 0.5) -> DataFrame:
    """5-95 % interval of normal noise with deviation `scale · rmse` around the prediction.

    The closed form is the limit of drawing many noisy copies and taking their percentiles.
    """
    half = F.lit(Z90 * scale * rmse)
    return df.withColumn("ci_lower", F.col(pred) - half).withColumn("ci_upper", F.col(pred) + half)


def with_sampled_interval(df: DataFrame, pred: str, rmse: float, draws: int = 200, scale: float = 0.5, seed: int = 42) -> DataFrame:
    """Interval from `draws` random copies per row, the form the closed form replaces."""
    out = df.withColumn("_d", F.array(*[F.randn(seed + i) for i in range(draws)]))
    ordered = F.array_sort("_d")

    def at(q: float):
        place = q * (draws - 1)
        low = int(place)
        a, b = ordered[low], ordered[min(low + 1, draws - 1)]
        return F.col(pred) + (a + (b - a) * (place - low)) * F.lit(scale * rmse)

    return out.withColumn("ci_lower", at(0.05)).withColumn("ci_upper", at(0.95)).drop("_d")


def flag_extreme(df: DataFrame, pred: str, out: str = "prediction_flagged", sigmas: float = 2) -> DataFrame:
    """True beyond mean ± sigmas population deviations of all predictions."""
    stats = df.agg(F.avg(pred).alias("mean"), F.stddev_pop(pred).alias("sd"))
    far = F.abs(F.col(pred) - F.col("_s.mean")) > F.lit(sigmas) * F.col("_s.sd")
    return attach_stats(df, stats, "_s").withColumn(out, F.coalesce(far, F.lit(False))).drop("_s")


def risk_and_level(df: DataFrame, change: str, current: str, fall: float = 5, digits: int = 2) -> DataFrame:
    """`risk_flag` for a predicted fall of more than `fall`, and the predicted level kept on 0-100."""
    return df.withColumn("risk_flag", F.col(change) < -fall).withColumn(
        "predicted_score", round_half_up(clamp(F.col(current) + F.col(change), 0.0, 100.0), digits)
    )
