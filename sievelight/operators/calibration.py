"""Post-hoc calibration: temperature and Platt scaling, with cross-validation.

Fits read (y, z) rows.  The temperature grid is scored by one grouped pass; Newton's steps are one aggregate
of five sums each, so no fit gathers rows on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import number_in_order, number_rows

GRID = [0.05 + i * (9.95 / 199) for i in range(200)]


@dataclass(frozen=True)
class Platt:
    a: float = 0.60
    b: float = -2.10

    def column(self, z: Column) -> Column:
        return F.round(1 / (1 + F.exp(-(F.lit(self.a) * z + F.lit(self.b)))), 4)


@dataclass(frozen=True)
class Temperature:
    t: float = 1.0

    def __post_init__(self):
        if self.t <= 0:
            raise ValueError("a temperature is positive")

    def column(self, z: Column) -> Column:
        return F.round(1 / (1 + F.exp(-(z / F.lit(self.t)))), 4)


def _nll(y: Column, z: Column, t: Column) -> Column:
    p = F.least(F.greatest(1 / (1 + F.exp(-(z / t))), F.lit(1e-12)), F.lit(1 - 1e-12))
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def temperature_losses(df: DataFrame, by=()) -> DataFrame:
    """(by, t, nll): mean loss at every grid point.  Equal (y, z) rows are counted first, so the grid
    multiplies distinct pairs only."""
    counted = df.groupBy(*by, "y", "z").agg(F.count(F.lit(1)).alias("n"))
    grid = F.explode(F.array(*[F.lit(t) for t in GRID]))
    return counted.select(*by, "y", "z", "n", grid.alias("t")).groupBy(*by, "t").agg((F.sum(F.col("n") * _nll(F.col("y"), F.col("z"), F.col("t"))) / F.sum("n")).alias("nll"))


def fit_temperature(df: DataFrame, by=()) -> DataFrame:
    """(by, temperature): the first grid minimum, to four decimals."""
    losses = temperature_losses(df, by)
    return losses.groupBy(*by).agg(F.round(F.min_by("t", F.struct(F.round("nll", 12), "t")), 4).alias("temperature"))


def contiguous_folds(df: DataFrame, order: str, folds: int) -> DataFrame:
    """df with `fold`, 1 to folds: equal parts in the order of a column, the first ones longer by a row where they do not divide."""
    numbered = number_in_order(df, order, "__no")
    held = numbered.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("__n"))), how="inner", on=F.lit(True))
    size, more = F.floor(F.col("__n") / folds), F.col("__n") % folds
    long = more * (size + 1)
    fold = F.when(F.col("__no") < long, F.floor(F.col("__no") / (size + 1))).otherwise(more + F.floor((F.col("__no") - long) / F.greatest(size, F.lit(1)))) + 1
    return held.withColumn("fold", fold.cast("int")).drop("__no", "__n")


def fit_temperature_cv(df: DataFrame, order: str, folds: int = 5) -> DataFrame:
    """Median of the temperatures fitted without each of `folds` contiguous folds."""
    cut = contiguous_folds(df, order, folds)
    counted = cut.groupBy("fold", "y", "z").agg(F.count(F.lit(1)).alias("n"))
    others = F.filter(F.array(*[F.lit(i) for i in range(1, folds + 1)]), lambda i: i != F.col("fold"))
    kept = counted.select(F.explode(others).alias("left_out"), "y", "z", "n").groupBy("left_out", "y", "z").agg(F.sum("n").alias("n"))
    grid = kept.select("left_out", "y", "z", "n", F.explode(F.array(*[F.lit(t) for t in GRID])).alias("t"))
    losses = grid.groupBy("left_out", "t").agg((F.sum(F.col("n") * _nll(F.col("y"), F.col("z"), F.col("t"))) / F.sum("n")).alias("nll"))
    best = losses.groupBy("left_out").agg(F.min_by("t", F.struct(F.round("nll", 12), "t")).alias("t"))
    return best.agg(F.round(F.percentile("t", F.lit(0.5)), 4).alias("temperature"))


def _fit_all(df: DataFrame, fits: list[tuple[int | None, float]], most: int = 50, tol: float = 1e-6) -> list[Platt]:
    """A Platt model for each (fold left out, penalty) over rows (fold, y, z), by Newton's method on (a, b); the penalty is on the slope
    alone, and the slope stays positive.  All models take their step in the same grouped aggregate, so the jobs are as many
    as the slowest model's steps."""
    counted = df.groupBy("fold", "y", "z").agg(F.count(F.lit(1)).alias("n")).persist()
    theta, open_ = [np.array([1.0, 0.0]) for _ in fits], set(range(len(fits)))
    try:
        for _ in range(most):
            models = [F.struct(F.lit(k).alias("k"), F.lit(fits[k][0]).cast("int").alias("out"), F.lit(float(theta[k][0])).alias("a"), F.lit(float(theta[k][1])).alias("b")) for k in sorted(open_)]
            rows = counted.select("fold", "y", "z", "n", F.explode(F.array(*models)).alias("m")).where("m.out is null or m.out != fold")
            p = F.least(F.greatest(1 / (1 + F.exp(-(F.col("m.a") * F.col("z") + F.col("m.b")))), F.lit(1e-12)), F.lit(1 - 1e-12))
            n, z, w = F.col("n"), F.col("z"), p * (1 - p)
            sums = rows.groupBy("m.k").agg(*[F.sum(n * x).alias(c) for c, x in {"ga": (p - F.col("y")) * z, "gb": p - F.col("y"), "haa": w * z * z, "hab": w * z, "hbb": w}.items()])
            got = {s["k"]: s for s in sums.collect()}
            for k in sorted(open_):
                s, l2 = got.get(k), fits[k][1]
                if s is None or s["ga"] is None:
                    open_.discard(k)
                    continue
                g = np.array([s["ga"] + l2 * theta[k][0], s["gb"]])
                h = np.array([[s["haa"] + l2, s["hab"]], [s["hab"], s["hbb"]]])
                try:
                    step = np.linalg.solve(h, g)
                except np.linalg.LinAlgError:
                    open_.discard(k)
                    continue
                theta[k] = theta[k] - step
                if np.abs(step).max() < tol:
                    open_.discard(k)
            if not open_:
                break
    finally:
        counted.unpersist()
    return [Platt(max(0.01, round(float(t[0]), 4)), round(float(t[1]), 4)) for t in theta]


def fit_platt(df: DataFrame, l2: float = 1e-3) -> Platt:
    """A Platt model of rows (y, z); (1, 0) without a row."""
    return _fit_all(df.select(F.lit(0).alias("fold"), "y", "z"), [(None, l2)])[0]


def _chosen(models: list[Platt], fold: Column, z: Column) -> Column:
    """The prediction of the model at a fold's place in the list."""
    out = F.lit(None).cast("double")
    for f, model in enumerate(models):
        out = F.when(fold == f, model.column(z)).otherwise(out)
    return out


def fit_platt_cv(df: DataFrame, order: str, folds: int = 5, penalties=(1e-4, 1e-3, 1e-2, 1e-1, 1.0)) -> tuple[float, Platt]:
    """(penalty, Platt): the penalty of the least mean fold Brier score over contiguous folds, refitted on all rows."""
    cut = contiguous_folds(df, order, folds).withColumn("fold", F.col("fold") - 1).persist()
    try:
        fits = [(f, l2) for l2 in penalties for f in range(folds)] + [(None, l2) for l2 in penalties]
        models = _fit_all(cut, fits)
        losses = []
        for i in range(len(penalties)):
            p = _chosen(models[i * folds : (i + 1) * folds], F.col("fold"), F.col("z"))
            losses.append(F.round(F.avg((p - F.col("y")) * (p - F.col("y"))), 4).alias(f"l{i}"))
        rows = cut.groupBy("fold").agg(*losses).collect()
    finally:
        cut.unpersist()
    mean = [round(float(np.mean([r[f"l{i}"] or 0.0 for r in rows] + [0.0] * (folds - len(rows)))), 12) for i in range(len(penalties))]
    best = mean.index(min(mean))
    return penalties[best], models[len(penalties) * folds + best]


def out_of_fold(df: DataFrame, order: str, folds: int = 5) -> DataFrame:
    """df with `oof`: each row's prediction by a Platt model fitted without its fold.

    Folds are stratified by class: rows of a class are dealt round in an order of hashes of `order`, so they follow the
    row and not the partitioning."""
    dealt = number_rows(df, order, "fold", ("y",)).withColumn("fold", F.pmod("fold", F.lit(folds)).cast("int"))
    models = _fit_all(dealt, [(f, 1e-3) for f in range(folds)])
    return dealt.withColumn("oof", _chosen(models, F.col("fold"), F.col("z"))).drop("fold")


def held_out_tasks(df: DataFrame, train: list, test: list) -> DataFrame:
    """Predictions for the test tasks by a model fitted on the training tasks."""
    model = fit_platt(df.where(F.col("task_id").isin(train)))
    return df.where(F.col("task_id").isin(test)).withColumn("prediction", model.column(F.col("z")))


_default: list = [Platt()]


def default_calibrator():
    """The calibrator that plans use unless they are given one."""
    return _default[0]


def set_default_calibrator(model) -> None:
    _default[0] = model
