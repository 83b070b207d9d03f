"""Text quality by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.labels import held_out, learnable
from furlong.scale.storage import lay_down

# Share of the pooled diagonal in each class covariance.
SHRINKAGE = 0.05
# Words and bytes of the windows whose worst is a statistic.
WINDOW_WORDS = 48
WINDOW_BYTES = 512
THRESHOLD = 0.5
# A log-density difference is cut here before it becomes a probability.
MOST_LOGIT = 30.0

_CLASS = np.zeros((256, 3))
_CLASS[[ord(c) for c in "|*#%&$@~^_=<>{}[]\\/+"], 0] = 1  # symbols
_CLASS[65:91, 1] = 1  # capitals
_CLASS[[ord(c) for c in "!?"], 2] = 1  # shouting

NAMES = (
    "words", "word_length", "word_spread", "distinct", "repeats", "worst_distinct", "symbols",
    "capitals", "shouts", "worst_symbols", "worst_capitals", "digits", "stops", "commas",
    "line_length", "line_repeats", "short_words", "lone_marks",
)


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of one text: logarithms of counts and ratios.

    Null and empty texts, and texts of white space only, give zeros.
    """
    words = (text or "").split()
    n = len(words)
    if not n:
        return np.zeros(len(NAMES))
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    hist = np.bincount(raw, minlength=256).astype(float)
    seen = max(1.0, hist.sum() - hist[9:14].sum() - hist[32])
    kinds = hist @ _CLASS / seen
    cuts = np.arange(0, len(raw), WINDOW_BYTES)
    width = np.maximum(np.diff(np.append(cuts, len(raw))), WINDOW_BYTES // 4)
    worst = [
        (np.add.reduceat(_CLASS[:, k].astype(np.float32)[raw], cuts) / width).max() for k in (0, 1)
    ]
    length = np.fromiter(map(len, words), float, n)
    spans = range(0, n, WINDOW_WORDS)
    fresh = min(
        len(set(words[i : i + WINDOW_WORDS])) / len(words[i : i + WINDOW_WORDS])
        for i in spans
        if n - i >= WINDOW_WORDS // 2 or i == 0
    )
    lines = [x for x in text.split("\n") if x]
    logit = lambda r: float(np.log((r + 0.002) / (1.002 - min(r, 1.0))))
    return np.array(
        [
            np.log1p(n),
            np.log(length.mean()),
            np.log1p(length.std()),
            logit(len(set(words)) / n),
            logit(sum(map(eq, words, words[1:])) / n),
            logit(fresh),
            logit(kinds[0]),
            logit(kinds[1]),
            logit(kinds[2]),
            logit(worst[0]),
            logit(worst[1]),
            logit(hist[48:58].sum() / seen),
            logit(hist[46] / n),
            logit(hist[44] / n),
            np.log(n / max(1, len(lines))),
            logit(1 - len(set(lines)) / max(1, len(lines))),
            logit(float((length <= 3).mean())),
            logit(float((length == 1).mean())),
        ]
    )


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussian classes with cached Cholesky factors of their covariances."""

    mean: np.ndarray  # class x p
    factor: np.ndarray  # class x p x p, inverse of the lower Cholesky factor
    offset: np.ndarray  # class: log prior - log determinant / 2

    def probability(self, x: np.ndarray) -> np.ndarray:
        """P(class 1) of the rows of ``x`` from Mahalanobis log densities."""
        density = [
            self.offset[c] - 0.5 * (((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(axis=1) for c in (0, 1)
        ]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -MOST_LOGIT, MOST_LOGIT)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Discriminant | float:
    """From (count, sum, sum of outer products) by class; a constant if a class is missing.

    Without any label the constant is 0.5.
    """
    if set(moments) != {0, 1}:
        return 0.5 if not moments else float(next(iter(moments)))
    total = sum(m[0] for m in moments.values())
    mean, cov, prior = [], [], []
    for c in (0, 1):
        n, s, q = moments[c]
        mean.append(s / n)
        cov.append(q / n - np.outer(s / n, s / n))
        prior.append(np.log(n / total))
    pooled = sum(moments[c][0] / total * np.diag(cov[c]) for c in (0, 1))
    pooled = np.maximum(pooled, 1e-6)
    factor, offset = [], []
    for c in (0, 1):
        lower = np.linalg.cholesky((1 - shrinkage) * cov[c] + shrinkage * np.diag(pooled))
        factor.append(np.linalg.inv(lower))
        offset.append(prior[c] - np.log(np.diag(lower)).sum())
    return Discriminant(np.array(mean), np.array(factor), np.array(offset))


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(t).tolist() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["_id", "_x"]
        )


def _moments_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for label, part in frame.groupby("_label"):
            x = np.stack(part["_x"].to_numpy())
            flat = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
            yield pd.DataFrame({"_label": label, "_at": np.arange(len(flat)), "_value": flat})


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Exact class moments of all rows (_label, _x); two small vectors reach the driver."""
    parts = rows.mapInPandas(_moments_of, "_label int, _at int, _value double")
    sums: dict[int, dict[int, float]] = {}
    for r in parts.groupBy("_label", "_at").agg(F.sum("_value").alias("v")).collect():
        sums.setdefault(r["_label"], {})[r["_at"]] = r["v"]
    p = len(NAMES)
    out = {}
    for label, values in sums.items():
        flat = np.array([values[i] for i in range(1 + p + p * p)])
        out[label] = (flat[0], flat[1 : 1 + p], flat[1 + p :].reshape(p, p))
    return out


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of ``docs``.

    ``score`` is the probability of label 1. Only ids outside the held-out fold
    teach; null ids are scored and teach nothing. Null and empty texts have the
    statistics of no words and a score like any other. Repeated rows are scored
    alike; an empty table gives an empty result; without labels each score is
    0.5, with one class only it is that class. Other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    measured = lay_down(rows.mapInArrow(_statistics_of, f"_id {id_type}, _x array<double>"), "quality-statistics")
    taught = measured.join(learnable(labels, label_col, id_col), F.col("_id") == F.col("_label_id"))
    model = fit(moments(taught.select("_label", "_x")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.full(batch.num_rows, 0.5)
            if isinstance(model, float):
                p[:] = model
            elif batch.num_rows:
                p = model.probability(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["_id", "score"])

    scored = measured.mapInArrow(score, f"_id {id_type}, score double")
    return scored.select(
        F.col("_id").alias(id_col),
        held_out(F.col("_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
