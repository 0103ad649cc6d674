"""Linear blend of base models that maximises kappa of the rounded, clamped blend."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordstack.constants import IS_TEST, ROW_ID, SEED, TARGET
from ordstack.functions.numeric import ident, linear_combine, number, quoted, to_rating
from ordstack.operators.metric import kappa_column, kappa_sums

BATCH = 64  # candidates scored per pass over the rows


def candidate_scores(
    oof: DataFrame, models: Sequence[str], candidates: Sequence[Sequence[float]], y: str = TARGET
) -> DataFrame:
    """``(id, kappa)`` of every candidate weight vector, in one pass over the rows.

    The candidates are a literal array, exploded next to each row and summed up before the shuffle,
    which carries one row per candidate and task.
    """
    vectors = ", ".join(
        f"struct({i} AS id, " + ", ".join(f"{number(w)} AS w{j}" for j, w in enumerate(c)) + ")"
        for i, c in enumerate(candidates)
    )
    rows = oof.selectExpr(
        f"CAST({ident(y)} AS BIGINT) AS _y",
        *[f"{ident(m)} AS _m{j}" for j, m in enumerate(models)],
        f"inline(array({vectors}))",
    )
    blended = " + ".join(f"_m{j} * w{j}" for j in range(len(models)))
    rated = rows.select("id", "_y", to_rating(F.expr(blended)).alias("_q"))
    sums = rated.groupBy("id").agg(*kappa_sums(F.col("_y"), F.col("_q")))
    return sums.select("id", kappa_column().alias("kappa"))


def score(
    oof: DataFrame, models: Sequence[str], candidates: Sequence[Sequence[float]], y: str = TARGET
) -> list[float]:
    """Kappa of every candidate, BATCH of them per pass; the worst value where it is undefined."""
    out: list[float] = []
    for first in range(0, len(candidates), BATCH):
        batch = candidates[first : first + BATCH]
        found = {r["id"]: r["kappa"] for r in candidate_scores(oof, models, batch, y).collect()}
        out += [-1.0 if found.get(i) is None else found[i] for i in range(len(batch))]
    return out


def starts(n_models: int, restarts: int, seed: int = SEED) -> list[list[float]]:
    """Every single model, the plain mean, and random weights in [0, 1)."""
    rng = random.Random(seed)
    single = [[1.0 if j == k else 0.0 for j in range(n_models)] for k in range(n_models)]
    mean = [[1.0 / n_models] * n_models]
    return single + mean + [[rng.random() for _ in range(n_models)] for _ in range(restarts)]


def fit_blend(
    oof: DataFrame,
    models: Sequence[str],
    restarts: int = 20,
    keep: int = 2,
    step: float = 0.25,
    tolerance: float = 1e-2,
    y: str = TARGET,
) -> tuple[list[float], float]:
    """Weights and their kappa, at least that of the best single model. A missing prediction raises.

    All starts are scored together; from the best ``keep`` of them a pattern search tries one step
    up and down in every weight, all tries of a round together, and halves the step where nothing
    improves, until every step is below ``tolerance``. Kappa only rises and takes finitely many values
    on the grid of a step, so that ends.
    """
    slim = oof.select(quoted(y), *[quoted(m) for m in models]).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        first = starts(len(models), restarts)
        ranked = sorted(zip(score(slim, models, first, y), first), key=lambda t: -t[0])
        front = [[k, w, step] for k, w in ranked[:keep]]
        while open_ := [p for p in front if p[2] >= tolerance]:
            tries = [_neighbours(w, s) for _, w, s in open_]
            scores = score(slim, models, [t for ts in tries for t in ts], y)
            at = 0
            for point, ts in zip(open_, tries):
                mine = scores[at : at + len(ts)]
                at += len(ts)
                top = max(range(len(ts)), key=mine.__getitem__)
                if mine[top] > point[0]:
                    point[0], point[1] = mine[top], ts[top]
                else:
                    point[2] /= 2
        best = max(front, key=lambda t: t[0])
        return best[1], best[0]
    finally:
        slim.unpersist()


def _neighbours(w: list[float], step: float) -> list[list[float]]:
    return [w[:j] + [w[j] + d] + w[j + 1 :] for j in range(len(w)) for d in (step, -step)]


def blend(df: DataFrame, models: Sequence[str], weights: Sequence[float]) -> DataFrame:
    keys = [c for c in (ROW_ID, IS_TEST, TARGET) if c in df.columns]
    value = linear_combine([quoted(m) for m in models], weights)
    return df.select(*keys, value.alias("prediction"))


def train_predict_blend(
    stacked: DataFrame, models: Sequence[str], restarts: int = 20, tolerance: float = 1e-2
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Blend fitted on all train rows; predictions of both sides and the weights."""
    train = stacked.filter(~F.col(IS_TEST))
    weights, _ = fit_blend(train, models, restarts, tolerance=tolerance)
    done = blend(stacked, models, weights)
    return done.filter(~F.col(IS_TEST)), done.filter(IS_TEST), weights
