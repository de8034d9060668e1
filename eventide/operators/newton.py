"""M02, all models in one fit: multinomial logistic regressions by damped Newton steps, keyed by model.

Rows that agree in model, features and label are one row of the sufficient statistics

    (model key, x ARRAY<DOUBLE>, counts ARRAY<BIGINT> by class)

which is stored once; how many rows went in does not matter afterwards. A step is one pass over it
for *all* models that have not converged: tasks sum loss, gradient and Hessian of each model they
meet, the partial sums are added by model, and one small solve per model makes the next trial
point. There is no loop over models anywhere; the driver loops over steps and sees one count.

Damping is per model (Levenberg): a trial point that does not lower the loss is given up, and the step
is repeated from the best point with more damping. The loss is the mean negative log-likelihood plus
``l2 / 2`` times the squared weights without the intercepts, so it is convex and every model with
``l2 > 0`` converges to its one minimum.

Memory: a task holds one model's sums at a time (the pass is sorted by model); a model's partial sums are
one row per task, of (classes * features)^2 / 2 numbers. A model with a third of all rows is
therefore as many small rows as there are tasks. Models without rows have no row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.config import BUCKET_EDGES_DAYS, DAY_US
from eventide.functions.time import epoch_us
from eventide.operators.history import days_since_last
from eventide.session import cut_lineage

N_CLASSES = len(BUCKET_EDGES_DAYS) + 1
#: features of ``history_features``
FEATURES = ["ln_events", "ln_idle_days", "ln_mean_gap", "ln_last_gap", "one_event"]
STATE = ("best array<double>, loss double, gradient array<double>, hessian array<double>, damping double, "
         "trial array<double>, steps int, converged boolean, n bigint")


def history_features(history: str = "history", t0: str = "t0") -> list[Column]:
    """What a history says about the next event, rounded so that equal persons fold into one row."""
    events = F.filter(F.col(history), lambda e: e.isNotNull())
    n = F.size(events)

    def at(i: Column) -> Column:
        return epoch_us(F.try_element_at(events, i).getField("OccurredTime"))

    def ln(days: Column) -> Column:
        return F.round(F.ln(1 + F.greatest(days, F.lit(0.0))), 1)

    last = at(F.lit(-1))
    mean = (last - at(F.lit(1))) / F.greatest(n - 1, F.lit(1)) / DAY_US
    newest = F.when(n > 1, (last - at(F.lit(-2))) / DAY_US).otherwise(0.0)
    idle = F.coalesce(days_since_last(F.col(t0), history), F.lit(0.0))
    cols = [F.round(F.ln(n.cast("double")), 1), ln(idle), ln(mean), ln(newest), (n == 1).cast("double")]
    return [c.alias(name) for c, name in zip(cols, FEATURES)]


def sufficient(rows: DataFrame, by: Sequence[str], features: Sequence[str], *, label: str = "label",
               n_classes: int = N_CLASSES) -> DataFrame:
    """(by, x, counts) of the labelled rows; x begins with the constant 1."""
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    return rows.where(F.col(label).isNotNull()).groupBy(*by, x.alias("x")).agg(
        F.array(*[F.count(F.when(F.col(label) == k, 1)) for k in range(n_classes)]).alias("counts"))


def _sums(x: np.ndarray, counts: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
    """Summed loss, gradient and Hessian at weights ``w`` (classes - 1, features); the last class has weight 0."""
    k = counts.shape[1]
    z = np.concatenate([x @ w.T, np.zeros((len(x), 1))], axis=1)
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    n = counts.sum(axis=1)
    loss = -(counts * np.log(np.maximum(p, 1e-300))).sum()
    free = p[:, :k - 1]
    gradient = ((n[:, None] * free - counts[:, :k - 1]).T @ x).ravel()
    d = x.shape[1]
    hessian = np.empty((k - 1, d, k - 1, d))
    for a in range(k - 1):
        for b in range(a, k - 1):
            weight = n * (free[:, a] * (a == b) - free[:, a] * free[:, b])
            block = (x * weight[:, None]).T @ x
            hessian[a, :, b, :] = block
            hessian[b, :, a, :] = block.T
    return loss, gradient, hessian.reshape((k - 1) * d, -1), int(n.sum())


def _partial_sums(stats: DataFrame, by: list[str], n_classes: int) -> DataFrame:
    """(by, loss, gradient, hessian, n) per task and model, at the model's trial point."""
    keys = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None

        def row() -> pd.DataFrame:
            return pd.DataFrame([[*key, total[0], total[1].tolist(), total[2].ravel().tolist(), total[3]]],
                                columns=[*by, "loss", "gradient", "hessian", "n"])

        for b in batches:
            for own, g in b.groupby(by, sort=False, dropna=False):
                x, counts = np.stack(g["x"].to_numpy()), np.stack(g["counts"].to_numpy()).astype(float)
                w = np.asarray(g["trial"].iloc[0]).reshape(n_classes - 1, -1)
                own = tuple(None if pd.isna(v) else v for v in own)
                if own != key:
                    if key is not None:
                        yield row()
                    key, total = own, (0.0, 0.0, 0.0, 0)
                total = tuple(a + c for a, c in zip(total, _sums(x, counts, w)))
        if key is not None:
            yield row()

    return stats.sortWithinPartitions(*by).select(*by, "x", "counts", "trial").mapInPandas(
        run, f"{keys}, loss double, gradient array<double>, hessian array<double>, n bigint")


def _next(by: list[str], n_features: int, n_classes: int, l2: float, tol: float):  # noqa: ANN202
    """One model's turn: its partial sums and its state -> its next state."""

    def run(key: tuple, parts: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        s = states.iloc[0]
        n = int(parts["n"].sum())
        w = np.asarray(s["trial"], float)
        size = len(w)
        ridge = np.tile(np.append(0.0, np.full(n_features, l2)), n_classes - 1)
        loss = parts["loss"].sum() / n + 0.5 * (ridge * w * w).sum()
        gradient = np.sum(np.stack(parts["gradient"].to_numpy()), axis=0) / n + ridge * w
        hessian = np.sum(np.stack(parts["hessian"].to_numpy()), axis=0).reshape(size, size) / n + np.diag(ridge)
        damping, steps = float(s["damping"]), int(s["steps"]) + 1
        if s["loss"] is None or pd.isna(s["loss"]) or loss <= s["loss"]:
            best, damping = w, max(damping / 10, 1e-10)
        else:
            best, loss, gradient = (np.asarray(s[c], float) for c in ("best", "loss", "gradient"))
            hessian, damping = np.asarray(s["hessian"], float).reshape(size, size), damping * 10
        done = bool(np.abs(gradient).max() < tol) or damping > 1e10
        trial = best - np.linalg.solve(hessian + damping * np.eye(size), gradient)
        return pd.DataFrame([[*key, best.tolist(), float(loss), gradient.tolist(), hessian.ravel().tolist(), damping,
                              trial.tolist(), steps, done, n]],
                            columns=[*by, "best", "loss", "gradient", "hessian", "damping", "trial", "steps",
                                     "converged", "n"])

    return run


def fit_all(stats: DataFrame, by: Sequence[str], *, l2: float = 1e-3, tol: float = 1e-8, max_steps: int = 60,
            n_classes: int = N_CLASSES) -> DataFrame:
    """(by, weights, loss, gradient_max, steps, converged, n): the regression of every model.

    ``weights`` is (classes - 1) x (1 + features), row by row; the last class has weight 0. Keys of
    ``by`` must not be null.
    """
    by = list(by)
    stats = cut_lineage(stats, "newton-stats")
    first = stats.first()
    keys = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in by)
    if first is None:
        return stats.sparkSession.createDataFrame([], f"{keys}, {STATE}").select(*by, *_result())
    size = len(first["x"])
    zero = F.array_repeat(F.lit(0.0), (n_classes - 1) * size)
    none = F.lit(None)
    state = stats.select(*by).distinct().select(
        *by, zero.alias("best"), none.cast("double").alias("loss"), none.cast("array<double>").alias("gradient"),
        none.cast("array<double>").alias("hessian"), F.lit(1e-3).alias("damping"), zero.alias("trial"),
        F.lit(0).alias("steps"), F.lit(False).alias("converged"), F.lit(0).cast("bigint").alias("n"))
    state = cut_lineage(state, "newton")
    finished = []
    for _ in range(max_steps):
        sums = _partial_sums(stats.join(state.select(*by, "trial"), by), by, n_classes)
        state = cut_lineage(sums.groupBy(*by).cogroup(state.groupBy(*by)).applyInPandas(
            _next(by, size - 1, n_classes, l2, tol), f"{keys}, {STATE}"), "newton")
        finished.append(state.where("converged"))
        state = state.where("not converged")
        if not state.limit(1).count():
            break
    else:
        finished.append(state)
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out.select(*by, *_result())


def _result() -> list[Column]:
    return [F.col("best").alias("weights"), F.col("loss"),
            F.aggregate("gradient", F.lit(0.0), lambda a, g: F.greatest(a, F.abs(g))).alias("gradient_max"),
            F.col("steps"), F.col("converged"), F.col("n")]


def predict_all(rows: DataFrame, models: DataFrame, by: Sequence[str], features: Sequence[str],
                n_classes: int = N_CLASSES) -> DataFrame:
    """``rows`` with ``pdf`` of their model (NULL where there is none), as Column algebra."""
    m = models.select(*by, F.col("weights").alias("_w"))
    size = len(features) + 1
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    out = rows.withColumn("_x", x).join(m, list(by), "left")

    def score(k: int) -> Column:
        if k == n_classes - 1:
            return F.lit(0.0)
        return F.aggregate(F.zip_with(F.slice("_w", k * size + 1, size), "_x", lambda w, v: w * v),
                           F.lit(0.0), lambda a, v: a + v)

    out = out.withColumn("_z", F.array(*[score(k) for k in range(n_classes)]))
    out = out.withColumn("_e", F.transform("_z", lambda z: F.exp(z - F.array_max("_z"))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
    return out.withColumn("pdf", F.when(F.col("_w").isNotNull(), F.transform("_e", lambda e: e / total))).drop(
        "_w", "_x", "_z", "_e")
