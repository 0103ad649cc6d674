"""Learn rating cutoffs that maximise quadratic weighted kappa.

Kappa of a cutoff vector depends on the rows only through, per cutoff, how many rows lie below it
and what their targets sum to. One Spark job reduces the predictions to these two numbers at every
hundredth of the rating range; that table has the same size for any number of rows, and the search
runs on it alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordstack.constants import DEFAULT_CUTOFFS, MAX_RATING
from ordstack.functions.numeric import apply_cutoffs, quoted

GRID = 100  # steps per unit
LOWEST = -1  # predictions outside are counted at the ends: no cutoff lies beyond them
HIGHEST = MAX_RATING + 1


def prediction_grid(df: DataFrame, y: str, p: str) -> DataFrame:
    """``(step, n, y, yy)``: rows, sum of targets and of squared targets per hundredth. At most
    2201 rows. ``p < c`` holds for a cutoff on the grid exactly if the step of p is below c's."""
    value = F.least(F.greatest(quoted(p), F.lit(float(LOWEST))), F.lit(float(HIGHEST)))
    missing = F.isnan(quoted(p)) | quoted(p).isNull()
    near = F.floor(value * GRID).cast("int")  # may be off by one where the product was rounded
    exact = (
        F.when(value >= (near + 1) / F.lit(float(GRID)), near + 1)
        .when(value < near / F.lit(float(GRID)), near - 1)
        .otherwise(near)
    )
    step = F.when(missing, F.raise_error(F.lit("missing prediction")).cast("int")).otherwise(exact)
    target = quoted(y).cast("bigint")
    return (
        df.select(step.alias("step"), target.alias("y"))
        .groupBy("step")
        .agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum(F.expr("y * y")).alias("yy"))
    )


def _below(grid: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Rows and targets below every grid value, with the overall totals."""
    size = (HIGHEST - LOWEST) * GRID + 2
    n, y, yy = np.zeros(size), np.zeros(size), 0.0
    for r in grid.collect():  # at most one row per grid value
        at = r["step"] - LOWEST * GRID
        n[at + 1 :] += r["n"]
        y[at + 1 :] += r["y"]
        yy += r["yy"]
    return n, y, n[-1], y[-1], yy


def fit_cutoffs(
    oof: DataFrame,
    y: str = "target",
    p: str = "prediction",
    start: Sequence[float] = DEFAULT_CUTOFFS,
) -> tuple[tuple[float, ...], float]:
    """Increasing cutoffs on a grid of hundredths and their kappa, never below that of ``start``.

    Coordinate ascent: each cutoff in turn moves to its best place between its neighbours, all
    places tried at once, until a whole sweep improves nothing.
    """
    n_below, y_below, n, y_sum, yy = _below(prediction_grid(oof, y, p))
    cuts = np.round((np.asarray(start) - LOWEST) * GRID).astype(int)
    first, last = 1, (HIGHEST - LOWEST) * GRID
    if (np.diff(cuts) < 0).any() or cuts[0] < first or cuts[-1] > last:
        raise ValueError("the start must increase and lie within the rating range")
    odd = 2 * np.arange(len(cuts)) + 1  # q*q as a sum of odd numbers over the cutoffs reached

    def parts(k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        above = n - n_below[at]
        return above, odd[k] * above, y_sum - y_below[at]

    def kappa(q: np.ndarray, qq: np.ndarray, yq: np.ndarray) -> np.ndarray:
        spread = n * yy - 2 * y_sum * q + n * qq
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(spread > 0, 1 - n * (yy - 2 * yq + qq) / spread, -np.inf)

    held = [parts(k, cuts[k]) for k in range(len(cuts))]
    best = float(kappa(*[sum(h[i] for h in held) for i in range(3)]))
    while True:  # kappa only rises, and takes finitely many values on the grid
        before = best
        for k in range(len(cuts)):
            lo = cuts[k - 1] if k else first
            hi = cuts[k + 1] if k + 1 < len(cuts) else last
            places = np.arange(lo, hi + 1)
            mine = parts(k, places)
            rest = [sum(h[i] for j, h in enumerate(held) if j != k) for i in range(3)]
            scores = kappa(*[rest[i] + mine[i] for i in range(3)])
            top = int(np.argmax(scores))
            if scores[top] > best + 1e-12:
                best = float(scores[top])
                cuts[k] = places[top]
                held[k] = parts(k, cuts[k])
        if best <= before:
            break
    return tuple(int(c + LOWEST * GRID) / GRID for c in cuts), best


def learn_and_apply(
    oof: DataFrame, test: DataFrame, p: str = "prediction", out: str = "rating"
) -> tuple[DataFrame, tuple[float, ...]]:
    """Cutoffs learnt on out-of-fold predictions, applied to test predictions."""
    cuts, _ = fit_cutoffs(oof, p=p)
    return test.withColumn(out, apply_cutoffs(quoted(p), cuts)), cuts
