"""Missing values, outliers, scaling and collinearity; fitted on train only.

Fitted values are a handful of numbers per column. They come back to the
driver and go into the plan as literals, so applying them is a projection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong import settings
from furlong.scale.quantiles import exact_quantiles
from furlong.sources.entries import write_version


def apply_medians(df: DataFrame, medians: Mapping[str, float | None]) -> DataFrame:
    """Fill missing values and flag them in ``<column>_missing``."""
    flags = {f"{c}_missing": F.col(c).isNull().cast("int") for c in medians}
    filled = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(m).cast("double")) for c, m in medians.items()
    }
    return df.withColumns(flags | filled)


def apply_bounds(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    out = {}
    for c, (lo, hi) in bounds.items():
        if lo is not None:
            clipped = F.greatest(F.least(F.col(c).cast("double"), F.lit(hi)), F.lit(lo))
            out[c] = F.when(F.col(c).isNotNull(), clipped)
    return df.withColumns(out) if out else df


def fit_moments(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column (D13), from one pass."""
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in cols],
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def apply_moments(df: DataFrame, moments: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / deviation; a column that is constant in train becomes 0."""
    out = {}
    for c, (mean, dev) in moments.items():
        if mean is not None:
            out[c] = (F.col(c) - F.lit(mean)) / F.lit(dev) if dev else F.col(c) * 0.0
    return df.withColumns(out) if out else df


def impute(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Train median for missing values, plus a 0/1 flag per column."""
    fitted = exact_quantiles(train, cols, [0.5])
    return apply_medians(df, {c: q[0] for c, q in fitted.items()})


def winsorize(
    train: DataFrame,
    df: DataFrame,
    cols: Sequence[str],
    probs: tuple[float, float] = settings.WINSOR,
) -> DataFrame:
    """Values beyond the train quantiles are pulled in to them."""
    return apply_bounds(df, exact_quantiles(train, cols, list(probs)))


def standardize(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation of train."""
    return apply_moments(df, fit_moments(train, cols))


# -- collinearity ----------------------------------------------------------


def _co_moments(names: Sequence[str], centre: Sequence[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task code: co-moments of every pair over the rows that have both, from masked matrix products."""
    names, centre = list(names), np.array(centre)
    first, second = np.triu_indices(len(names), 1)

    def run(batches):
        p = len(names)
        both, own, squares, cross = (np.zeros((p, p)) for _ in range(4))
        for batch in batches:
            x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - centre
            known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
            x = np.where(known > 0, x, 0.0)
            both += known.T @ known
            own += x.T @ known  # sum of a where b is known
            squares += (x * x).T @ known
            cross += x.T @ x
        parts = {"n": both, "sa": own, "sb": own.T, "saa": squares, "sbb": squares.T, "sab": cross}
        columns = {"a": first.astype(np.int32), "b": second.astype(np.int32)}
        yield pa.RecordBatch.from_pydict(columns | {k: m[first, second] for k, m in parts.items()})

    return run


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, as rows, each over the rows that have both values.

    One pass for the means, against which sums are taken, and one for the co-moments:
    a task hands on one short row a pair, whatever its rows. Null where a pair has
    no two values or one of them does not vary.
    """
    cols = list(cols)
    values = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    means = values.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    sums = ("n", "sa", "sb", "saa", "sbb", "sab")
    parts = values.mapInArrow(
        _co_moments(cols, list(means)), "a int, b int, " + ", ".join(f"{c} double" for c in sums)
    )
    total = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in sums])
    spread = [F.col(f"s{x}{x}") - F.try_divide(F.col(f"s{x}") * F.col(f"s{x}"), F.col("n")) for x in "ab"]
    # what is left of a constant's squares is rounding
    varies = [v > 1e-14 * F.col(f"s{x}{x}") for v, x in zip(spread, "ab", strict=True)]
    r = (F.col("sab") - F.try_divide(F.col("sa") * F.col("sb"), F.col("n"))) / F.sqrt(spread[0] * spread[1])
    names = F.array(*[F.lit(c) for c in cols])
    return total.select(
        names[F.col("a")].alias("col_a"), names[F.col("b")].alias("col_b"), F.when(varies[0] & varies[1], r).alias("r")
    )


def correlation(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson correlation matrix of all rows; the executors send back p x p sums, no rows.

    A missing value counts as its column's mean. A constant column correlates
    with nothing: its entries are NaN.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    known = rows.agg(
        *[F.avg(c).alias(f"a{i}") for i, c in enumerate(cols)],
        *[(F.min(c) < F.max(c)).alias(f"v{i}") for i, c in enumerate(cols)],
    ).first()
    filled = rows.na.fill({c: known[f"a{i}"] or 0.0 for i, c in enumerate(cols)})
    assembled = VectorAssembler(inputCols=list(cols), outputCol="v").transform(filled)
    matrix = Correlation.corr(assembled, "v").first()[0].toArray()
    for i in range(len(cols)):
        if not known[f"v{i}"]:
            matrix[i, :] = matrix[:, i] = np.nan
    return matrix


# Eigenvalues of a correlation matrix from here down are dependencies.
_DEPENDENT = 1e-9


def vif_of(matrix: np.ndarray) -> np.ndarray:
    """Variance inflation from a correlation matrix: the diagonal of its inverse.

    Columns of a linear dependency have an infinite one, the others that of the
    matrix without the dependencies. Constant columns (NaN) have NaN.
    """
    out = np.full(len(matrix), np.nan)
    live = np.flatnonzero(~np.isnan(np.diag(matrix)))
    part = matrix[np.ix_(live, live)]
    values, vectors = np.linalg.eigh(part)
    null = vectors[:, values <= _DEPENDENT]
    bound = (np.abs(null) > 1e-6).any(axis=1)
    inverse = np.diag(np.linalg.pinv(part, hermitian=True, rcond=_DEPENDENT))
    out[live] = np.where(bound, np.inf, inverse)
    return out


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    values = vif_of(correlation(df, cols))
    rows = [(c, float(v)) for c, v in zip(cols, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def drop_collinear(df: DataFrame, cols: Sequence[str], max_vif: float = 10.0) -> list[str]:
    """Drop the column with the largest VIF until all are within ``max_vif``.

    Constant columns go first; of equally large ones, as in a dependency, the
    last goes. One pass over the data: the correlation of a subset is a part of
    the matrix.
    """
    kept = list(cols)
    matrix = correlation(df, kept)
    varies = np.flatnonzero(~np.isnan(np.diag(matrix)))
    kept, matrix = [kept[i] for i in varies], matrix[np.ix_(varies, varies)]
    while len(kept) > 1:
        values = vif_of(matrix)
        worst = len(values) - 1 - int(np.argmax(values[::-1]))
        if values[worst] <= max_vif:
            break
        kept.pop(worst)
        matrix = np.delete(np.delete(matrix, worst, 0), worst, 1)
    return kept


# -- dataset versions ------------------------------------------------------

Transform = Callable[[DataFrame], DataFrame]
Recipe = Callable[[DataFrame, Sequence[str]], Transform]


def _fit_tree_version(train: DataFrame, cols: Sequence[str]) -> Transform:
    """Imputation and winsorisation, their quantiles from the same passes."""
    lo, hi = settings.WINSOR
    fitted = exact_quantiles(train, cols, [lo, 0.5, hi])
    medians = {c: q[1] for c, q in fitted.items()}
    bounds = {c: (q[0], q[2]) for c, q in fitted.items()}
    return lambda df: apply_bounds(apply_medians(df, medians), bounds)


def _fit_scaled_version(train: DataFrame, cols: Sequence[str]) -> Transform:
    base = _fit_tree_version(train, cols)
    moments = fit_moments(base(train), cols)
    return lambda df: apply_moments(base(df), moments)


# Only these two versions are described; the other six are not invented.
RECIPES: dict[str, Recipe] = {
    "v1_base": _fit_tree_version,
    "v2_standard": _fit_scaled_version,
}


def recipe(name: str) -> Recipe:
    if name not in RECIPES:
        raise KeyError(f"no recipe for {name}; known: {sorted(RECIPES)}")
    return RECIPES[name]


def build_version(
    df: DataFrame, name: str, cols: Sequence[str], split: str = "split"
) -> DataFrame:
    """All splits of one version, its parameters taken from the train split."""
    return recipe(name)(df.where(F.col(split) == "train"), cols)(df)


def build_versions(
    df: DataFrame, base: str, cols: Sequence[str], names: Sequence[str] = settings.NAMED_VERSIONS
) -> list[str]:
    """Write every named version of a split table."""
    for name in names:
        write_version(build_version(df, name, cols), base, name)
    return list(names)


def compare_versions(
    df: DataFrame,
    cols: Sequence[str],
    evaluate: Callable[[str, DataFrame], DataFrame],
    names: Sequence[str] = settings.NAMED_VERSIONS,
) -> DataFrame:
    """Metric rows of ``evaluate(version, table)`` for each version, stacked."""
    out = None
    for name in names:
        rows = evaluate(name, build_version(df, name, cols))
        out = rows if out is None else out.unionByName(rows)
    return out
