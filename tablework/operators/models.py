"""Linear and logistic models with one-hot columns and interactions.

The model matrix is a few columns of the table; Spark sums its products, and the driver solves for as many terms as there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.functions import distributions as D

#: What a normal figure stays below with a chance of 97.5 %.
NORMAL_975 = NormalDist().inv_cdf(0.975)
#: Distinct texts a column may have to become one-hot columns: each is a term of the model.
MOST_LEVELS = 200
#: Steps after which a logistic model that hasn't settled is an error.
MOST_STEPS = 35

_TERMS = "term string, coefficient double, std_error double, {t} double, p_value double, ci_lower double, ci_upper double, significant boolean"


@dataclass(frozen=True)
class Matrix:
    """Names of the terms besides the intercept, and rows (y, x array<double>) that have them all."""

    terms: list[str]
    rows: DataFrame


def matrix(df: DataFrame, y: str, xs: list[str], interactions: list[str] = ()) -> Matrix:
    """The model matrix of y on columns xs.

    Rows with a null or NaN in any column are left out. A text column becomes one 0/1 column for each of its values but the
    first in order, named column_value; an interaction "a*b" is the product of terms, named a_x_b, and is left out if one of
    them is not a term. The distinct texts of a column are collected, MOST_LEVELS at most.
    """
    kinds = dict(df.dtypes)
    if missing := [c for c in [y, *xs] if c not in kinds]:
        raise ValueError(f"no columns {missing}")
    number = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    texts = [c for c in xs if kinds[c] == "string"]
    taken = df.select(number(y).alias("y"), *(F.col(f"`{c}`").alias(f"t{k}") if c in texts else number(c).alias(f"t{k}") for k, c in enumerate(xs))).dropna()
    terms: dict[str, Column] = {}
    for k, c in enumerate(xs):
        if c in texts:
            levels = [r[0] for r in taken.select(f"t{k}").distinct().limit(MOST_LEVELS + 1).collect()]
            if len(levels) > MOST_LEVELS:
                raise ValueError(f"{c!r} has more than {MOST_LEVELS} distinct texts")
            terms |= {f"{c}_{v}": (F.col(f"t{k}") == v).cast("double") for v in sorted(levels)[1:]}
        else:
            terms[c] = F.col(f"t{k}")
    for product in interactions:
        parts = [p.strip() for p in product.split("*")]
        if len(parts) > 1 and all(p in terms for p in parts):
            whole = terms[parts[0]]
            for p in parts[1:]:
                whole = whole * terms[p]
            terms["_x_".join(parts)] = whole
    x = F.array(F.lit(1.0), *terms.values()) if terms else F.array(F.lit(1.0))
    return Matrix(list(terms), taken.select("y", x.alias("x")))


def sums(rows: DataFrame, of, width: int) -> np.ndarray:
    """The sum over all rows of what of(x, y) gives for a batch of them: an array of so many numbers, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), batch["y"].to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["i", "v"])

    found = rows.select("y", "x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for r in found:
        out[r["i"]] = r["v"]
    return out


def _scaled(m: Matrix) -> tuple[float, np.ndarray, np.ndarray, float]:
    """n, means and deviations of the terms (0 and 1 for the intercept), and the mean of y."""
    k = len(m.terms) + 1
    at = [F.get("x", F.lit(i)) for i in range(1, k)]
    one = m.rows.agg(F.count(F.lit(1)), F.avg("y"), *map(F.avg, at), *map(F.stddev_pop, at)).first()
    figures = np.array([0.0 if v is None else v for v in one[2:]])
    mean, spread = np.append(0.0, figures[: k - 1]), np.append(1.0, figures[k - 1 :])
    return one[0], mean, np.where(spread > 1e-12 * np.abs(mean), spread, 0.0), one[1] or 0.0


def _table(m: Matrix, spark, coefficients: np.ndarray, errors: np.ndarray, tail, reach: float, t: str, more: dict) -> DataFrame:
    out = []
    for term, b, e in zip(["intercept", *m.terms], coefficients.tolist(), errors.tolist(), strict=True):
        ratio = b / e if e else None
        p = None if ratio is None else tail(ratio)
        out.append((term, b, e, ratio, p, b - reach * e, b + reach * e, p is not None and p < 0.05, *more.values()))
    schema = _TERMS.format(t=t) + "".join(f", {k} {'long' if k == 'n' else 'double'}" for k in more)
    return spark.createDataFrame(out, schema)


def least_squares(df: DataFrame, y: str, xs: list[str], interactions: list[str] = ()) -> DataFrame:
    """Least squares with full output: a row a term (intercept first) with coefficient, std_error, t, p_value, the 95 % interval
    and significant; and the model's n, r2, adjusted_r2, rmse, mae, f, f_p_value, aic, bic, the same in each row.

    Terms as matrix() makes them. Columns that follow from others share their effect (the shortest solution) and count once in
    the degrees of freedom. Fewer rows than terms, or none left over, give no rows. Three passes: means, products of centred
    columns, absolute residuals.
    """
    m = matrix(df, y, xs, interactions)
    spark, k = df.sparkSession, len(m.terms) + 1
    n, shift, spread, mean_y = _scaled(m)
    scale = np.where(spread > 0, spread, 1.0)

    def products(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - shift) / scale, v - mean_y])
        return (z.T @ z).ravel()

    gram = sums(m.rows, products, (k + 1) ** 2).reshape(k + 1, k + 1)
    inverse = np.linalg.pinv(gram[:k, :k], rcond=1e-13, hermitian=True)
    rank = int(np.linalg.matrix_rank(gram[:k, :k], tol=1e-13 * max(gram[:k, :k].max(initial=0.0), 1e-300), hermitian=True))
    left = n - rank
    if left <= 0:
        return spark.createDataFrame([], _TERMS.format(t="t") + ", n long, r2 double, adjusted_r2 double, rmse double, mae double, f double, f_p_value double, aic double, bic double")
    inner = inverse @ gram[:k, k]
    rest = max(0.0, float(gram[k, k] - inner @ gram[:k, k]))
    # back from centred and scaled columns
    turn = np.diag(1 / scale)
    turn[0, 1:] = -shift[1:] / scale[1:]
    coefficients = turn @ inner
    coefficients[0] += mean_y
    variance = turn @ inverse @ turn.T * (rest / left)
    whole = float(gram[k, k])
    mae = float(sums(m.rows, lambda x, v: np.array([np.abs(v - x @ coefficients).sum()]), 1)[0]) / n
    r2 = 1 - rest / whole if whole > 0 else None
    f = None if r2 is None or rest <= 0 or rank < 2 else (whole - rest) / (rank - 1) / (rest / left)
    likely = -n / 2 * (math.log(2 * math.pi) + math.log(rest / n) + 1) if rest > 0 else None
    more = {
        "n": int(n), "r2": r2, "adjusted_r2": None if r2 is None else 1 - (1 - r2) * (n - 1) / left, "rmse": math.sqrt(rest / left), "mae": mae,
        "f": f, "f_p_value": None if f is None else D.fisher_f(f, rank - 1, left), "aic": None if likely is None else 2 * rank - 2 * likely, "bic": None if likely is None else rank * math.log(n) - 2 * likely,
    }
    return _table(m, spark, coefficients, np.sqrt(np.maximum(np.diag(variance), 0)), lambda t: D.student(t, left), D.student_quantile(0.975, left), "t", more)


def logistic(df: DataFrame, y: str, xs: list[str], interactions: list[str] = ()) -> DataFrame:
    """Logistic regression of y, which holds 0 and 1, by Newton's steps: a row a term (intercept first) with coefficient,
    std_error, z, p_value, the 95 % interval and significant; and the model's n, pseudo_r2, log_likelihood, aic, bic.

    Terms as matrix() makes them. An error: y that isn't between 0 and 1 or has one value only, terms that follow from others
    (a constant column among them), and terms that separate the two outcomes fully, for which no coefficients exist. No rows
    give no rows. Each step is one pass that sums the gradient and the weighted products.
    """
    m = matrix(df, y, xs, interactions)
    k = len(m.terms) + 1
    edge = m.rows.agg(F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    more = "n long, pseudo_r2 double, log_likelihood double, aic double, bic double"
    if not edge[2]:
        return df.sparkSession.createDataFrame([], f"{_TERMS.format(t='z')}, {more}")
    if edge[0] < 0 or edge[1] > 1 or edge[0] == edge[1]:
        raise ValueError(f"{y!r} must hold both 0 and 1")
    n, shift, scale, share = _scaled(m)
    if constant := [t for t, s in zip(m.terms, scale[1:], strict=True) if s == 0]:
        raise ValueError(f"terms {constant} are constant")

    def step(b: np.ndarray):
        def of(x: np.ndarray, v: np.ndarray) -> np.ndarray:
            z = (x - shift) / scale
            at = z @ b
            p = 1 / (1 + np.exp(-np.clip(at, -700, 700)))
            likely = (v * at - np.logaddexp(0, at)).sum()
            return np.concatenate([[likely], z.T @ (v - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

        one = sums(m.rows, of, 1 + k + k * k)
        return one[0], one[1 : 1 + k], one[1 + k :].reshape(k, k)

    b = np.zeros(k)
    for i in range(MOST_STEPS):
        likely, slope, curve = step(b)
        if likely > -1e-8 * n:
            raise ValueError("the terms separate the outcomes")
        weights = np.linalg.eigvalsh(curve)
        if weights[0] <= 1e-12 * weights[-1]:
            raise ValueError("the terms separate some outcomes" if i else "some terms follow from others")
        move = np.linalg.solve(curve, slope)
        if np.abs(move).max() <= 1e-8 * (1 + np.abs(b).max()):
            break
        b = b + move
    else:  # where terms tell some outcomes for sure, coefficients grow with every step
        raise ValueError(f"no solution in {MOST_STEPS} steps: the terms separate some outcomes")
    turn = np.diag(1 / scale)
    turn[0, 1:] = -shift[1:] / scale[1:]
    errors = np.sqrt(np.diag(turn @ np.linalg.inv(curve) @ turn.T))
    alone = n * (share * math.log(share) + (1 - share) * math.log(1 - share))
    model = {"n": int(n), "pseudo_r2": float(1 - likely / alone), "log_likelihood": float(likely), "aic": float(2 * k - 2 * likely), "bic": float(k * math.log(n) - 2 * likely)}
    return _table(m, df.sparkSession, turn @ b, errors, D.normal, NORMAL_975, "z", model)


def uncentred_inflation(df: DataFrame, xs: list[str], interactions: list[str] = ()) -> DataFrame:
    """(term, vif): the variance inflation of each term of a model without intercept, from sums of squares about zero.

    Terms as matrix() makes them; null where others tell a term fully or it is all zero.
    """
    m = matrix(df.withColumn("_y", F.lit(0.0)), "_y", xs, interactions)
    k = len(m.terms)
    gram = sums(m.rows, lambda x, _: (x[:, 1:].T @ x[:, 1:]).ravel(), k * k).reshape(k, k)
    size = np.sqrt(np.diag(gram))
    fine = (size > 0).all() and k > 0
    r = gram / np.outer(size, size) if fine else gram
    fine = fine and np.linalg.matrix_rank(r, tol=1e-10, hermitian=True) == k
    found = np.diag(np.linalg.inv(r)).tolist() if fine else [None] * k
    return df.sparkSession.createDataFrame(list(zip(m.terms, found, strict=True)), "term string, vif double")
