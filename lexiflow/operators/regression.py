"""Least squares from one pass of sums; the small systems are solved on the driver."""

from __future__ import annotations

from itertools import combinations
from math import erfc, factorial, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.operators.resample import resampled_sums


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of products of all columns and a constant, constant first: one aggregate, whatever the number of rows."""
    names = [None, *columns]
    value = lambda a: F.lit(1.0) if a is None else F.col(a).cast("double")
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = df.agg(*(F.coalesce(F.sum(value(names[i]) * value(names[j])), F.lit(0.0)).alias(f"c{i}_{j}") for i, j in cells)).first()
    g = np.zeros((len(names), len(names)))
    for (i, j), v in zip(cells, row, strict=True):
        g[i, j] = g[j, i] = v
    return g


def ols(df: DataFrame, y: str, x: list[str]) -> dict[str, tuple[float, float, float]]:
    """Coefficient, HC3 standard error and two-sided p of a constant and each column: two passes."""
    g = gram(df, [*x, y])
    xx, xy = g[:-1, :-1], g[:-1, -1]
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in x)]
    dot = lambda v: sum((c * float(k) for c, k in zip(cols, v, strict=True)), F.lit(0.0))
    lever = sum((c * dot(row) for c, row in zip(cols, inverse, strict=True)), F.lit(0.0))
    scaled = df.withColumn("__w", F.pow((F.col(y) - dot(beta)) / F.greatest(1 - lever, F.lit(1e-12)), 2))
    n = len(cols)
    row = scaled.agg(*(F.sum(cols[i] * cols[j] * F.col("__w")).alias(f"m{i}_{j}") for i in range(n) for j in range(n))).first()
    cover = inverse @ np.array(row, float).reshape(n, n) @ inverse
    out = {}
    for name, b, v in zip(["const", *x], beta, np.diag(cover), strict=True):
        se = sqrt(max(v, 0.0))
        out[name] = (float(b), se, erfc(abs(b) / se / sqrt(2)) if se else float("nan"))
    return out


def r2_from_gram(g: np.ndarray, picked: tuple[int, ...]) -> float:
    """R squared of the last column on a constant and some of the others."""
    keep = [0, *picked]
    beta = np.linalg.lstsq(g[np.ix_(keep, keep)], g[keep, -1], rcond=None)[0]
    total = g[-1, -1] - g[0, -1] ** 2 / g[0, 0]
    left = g[-1, -1] - beta @ g[keep, -1]
    return float(1 - left / total) if total else 0.0


def shapley_r2(df: DataFrame, y: str, x: list[str], most: int = 7) -> dict[str, float]:
    """Exact Shapley shares of R squared: all subsets from one Gram matrix."""
    if len(x) > most:
        raise ValueError(f"at most {most} groups")
    g = gram(df, [*x, y])
    value = {s: r2_from_gram(g, tuple(i + 1 for i in s)) for k in range(len(x) + 1) for s in combinations(range(len(x)), k)}
    n = len(x)
    out = {}
    for i in range(n):
        rest = [k for k in range(n) if k != i]
        out[x[i]] = sum(factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (value[tuple(sorted((*s, i)))] - value[s]) for k in range(n) for s in combinations(rest, k))
    return out


def _fit_gap(sides: np.ndarray, picked: tuple[int, ...]) -> tuple[float, float]:
    """Explained part of the gap in means of y (side 0 less side 1), and R squared, of y on a constant, the picked columns and the side. ``sides``: a Gram matrix each, constant first and y last."""
    keep = [0, *picked]
    one = sides[1][np.ix_(keep, keep)]
    xx = np.block([[sides.sum(0)[np.ix_(keep, keep)], one[:, :1]], [one[:1], one[:1, :1]]])  # the side is the constant of side 1
    xy = np.append(sides.sum(0)[keep, -1], sides[1][0, -1])
    total = sides.sum(0)
    centre = np.eye(len(xy))
    centre[1:, 0] = -xx[0, 1:] / xx[0, 0]  # as columns less their means, of unit length: well conditioned
    xx, xy = centre @ xx @ centre.T, centre @ xy
    scale = np.sqrt(np.maximum(np.diag(xx), 0))
    scale = np.where(scale > 1e-9 * np.sqrt(np.maximum(np.append(np.diag(total)[keep], one[0, 0]), 1e-300)), scale, np.inf)  # a constant column gets no part
    beta = np.linalg.lstsq(xx / np.outer(scale, scale), xy / scale, rcond=None)[0] / scale
    gap = sides[0][0, :] / sides[0][0, 0] - sides[1][0, :] / sides[1][0, 0]
    about = total[-1, -1] - total[0, -1] ** 2 / total[0, 0]
    return float(sum(b * gap[k] for b, k in zip(beta[1:-1], picked, strict=True))), float(beta[1:] @ xy[1:] / about) if about > 0 else 0.0


def decompose_gap(sides: np.ndarray, names: list[str]) -> dict[str, float]:
    """gap in means of y, each column's Shapley part of it and of R squared over the side alone, and the residual, with shares of the gap."""
    n = len(names)
    if n > 7:
        raise ValueError("at most 7 groups")
    fit = {s: _fit_gap(sides, tuple(i + 1 for i in s)) for k in range(n + 1) for s in combinations(range(n), k)}
    gap = float(sides[0][0, -1] / sides[0][0, 0] - sides[1][0, -1] / sides[1][0, 0])
    out = {"gap": gap, "residual": gap - fit[tuple(range(n))][0]}
    for i, name in enumerate(names):
        rest = [k for k in range(n) if k != i]
        part = np.zeros(2)
        for k in range(n):
            for s in combinations(rest, k):
                part += factorial(k) * factorial(n - k - 1) / factorial(n) * np.subtract(fit[tuple(sorted((*s, i)))], fit[s])
        out[f"part_{name}"], out[f"r2_{name}"] = map(float, part)
    for k in ["residual", *(f"part_{name}" for name in names)]:
        out[f"share_{k}"] = out[k] / gap if gap else float("nan")
    return out


def refitted_gap(df: DataFrame, id_col: str, side: str, y: str, x: list[str], reps: int, seed: str) -> dict[str, tuple[float, float, float]]:
    """Each quantity of ``decompose_gap`` with its interpolated interval: the whole decomposition is fitted anew on every draw, from a Gram matrix per draw and side. Either side (0 and 1) is drawn within itself."""
    names = [None, *x, y]
    value = lambda a: F.lit(1.0) if a is None else F.col(a).cast("double")
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    rows = df.select(id_col, F.col(side).cast("int").alias("__side"), *((value(names[i]) * value(names[j])).alias(f"c{i}_{j}") for i, j in cells))
    columns = [f"c{i}_{j}" for i, j in cells]
    whole = rows.groupBy("__side").agg(*(F.sum(c).alias(c) for c in columns)).withColumn("rep", F.lit(-1))
    drawn = resampled_sums(rows, id_col, columns, reps, seed, ["__side"]).drop("n")
    grams = np.zeros((reps + 1, 2, len(names), len(names)))
    for r in whole.unionByName(drawn).collect():
        for i, j in cells:
            grams[r["rep"] + 1, r["__side"], i, j] = grams[r["rep"] + 1, r["__side"], j, i] = r[f"c{i}_{j}"]
    if not grams[0, :, 0, 0].all():
        raise ValueError("both sides need rows")
    point = decompose_gap(grams[0], x)
    fits = [decompose_gap(g, x) for g in grams[1:] if g[:, 0, 0].all()]  # a draw without rows of a side has no gap
    return {k: (v, *(float(q) for q in np.percentile([f[k] for f in fits], [2.5, 97.5]))) for k, v in point.items()}


def vif(df: DataFrame, x: list[str]) -> dict[str, float]:
    """Variance inflation of each column; infinite when the others give it exactly."""
    g = gram(df, x)
    out = {}
    for i in range(1, len(x) + 1):
        order = [k for k in range(len(x) + 1) if k != i] + [i]
        r2 = r2_from_gram(g[np.ix_(order, order)], tuple(range(1, len(x))))
        out[x[i - 1]] = float("inf") if r2 >= 1 - 1e-12 else 1 / (1 - r2)
    return out
