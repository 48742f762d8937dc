"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= k | x) = sigmoid(w.x - t_k) with one weight vector over hashed text features and ordered thresholds
t_1 < t_2 < ...; the expected grade is the sum of the tail probabilities. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotweave.llm.arrays import text_chunks
from shotweave.llm.hashing import collect_features, folded, labelled_rows, shape_features

BITS = 18


def unit(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Square-root counts scaled to unit length per text."""
    value = np.sqrt(count.astype(np.float64))
    total = np.concatenate(([0.0], np.cumsum(count, dtype=np.float64)))
    norm = np.sqrt(np.maximum(total[first[1:]] - total[first[:-1]], 1.0))
    return value / np.repeat(norm, np.diff(first))


@dataclass(frozen=True)
class OrdinalModel:
    bits: int
    weight: np.ndarray  # 2**bits floats: a fixed 1 MB
    threshold: np.ndarray  # ascending; grades - 1 entries

    def tails(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. per text."""
        first, index, count = folded(*shape_features(data, offsets, self.bits), self.bits, len(offsets) - 1)
        part = np.concatenate(([0.0], np.cumsum(self.weight[index] * unit(first, count))))
        z = part[first[1:]] - part[first[:-1]]
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.threshold[None, :], -35, 35)))


def fit_ordinal(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, grades: int, rate: float, l2: float, epochs: int, seed: int) -> OrdinalModel:
    """Adagrad on the cumulative-link likelihood; thresholds are a first one plus positive steps, so they stay ordered."""
    w, wn = np.zeros(1 << bits), np.full(1 << bits, 1e-8)
    p = np.zeros(grades - 1)  # first threshold, then logs of the steps
    pn = np.full(grades - 1, 1e-8)
    theta = lambda: np.cumsum(np.concatenate((p[:1], np.exp(p[1:]))))
    rng = np.random.default_rng(seed)
    s = lambda x: 1 / (1 + np.exp(-np.clip(x, -35, 35)))
    prepared = [(y, i, unit(np.array([0, len(c)]), c)) for y, i, c in rows]
    for _ in range(epochs):
        for k in rng.permutation(len(prepared)):
            y, index, x = prepared[k]
            t, z = theta(), float(w[index] @ x)
            upper = s(z - t[y - 1]) if y else 1.0  # P(grade >= y)
            lower = s(z - t[y]) if y < grades - 1 else 0.0  # P(grade >= y + 1)
            mass = max(upper - lower, 1e-9)
            du, dl = upper * (1 - upper), lower * (1 - lower)
            gz = -(du - dl) / mass
            gt = np.zeros(grades - 1)
            if y:
                gt[y - 1] += du / mass
            if y < grades - 1:
                gt[y] -= dl / mass
            gp = np.cumsum(gt[::-1])[::-1] * np.concatenate((np.ones(1), np.exp(p[1:])))[: grades - 1]
            g = gz * x + l2 * w[index]
            wn[index] += g * g
            w[index] -= rate * g / np.sqrt(wn[index])
            pn += gp * gp
            p -= rate * gp / np.sqrt(pn)
    return OrdinalModel(bits, w.astype(np.float32), theta())


def fit_quality(documents: DataFrame, ratings: DataFrame, grade: str, grades: int, sample: int = 4000, rate: float = 0.1, l2: float = 1e-5, epochs: int = 3, seed: int = 7) -> OrdinalModel:
    """Fit on at most `sample` rated rows outside the hold-out fold. `grade` holds 0 .. grades - 1; others are ignored.

    Null ids, and ratings without a document, are left out; a repeated id counts as often as it occurs, within the bound.
    Without ratings all weights are 0 and the thresholds keep their start.
    """
    own = ratings.where(F.col(grade).between(0, grades - 1))
    rows = collect_features(labelled_rows(documents, own, grade, sample), shape_features, BITS, sample)
    return fit_ordinal(rows, BITS, grades, rate, l2, epochs, seed)


def score_quality(df: DataFrame, model: OrdinalModel, text: str = "text", tail: int = 1, keep_from: float = 0.5) -> DataFrame:
    """`df` with expected_grade, tail_probability (P(grade >= tail)) and kept (tail_probability >= keep_from).

    Null and empty texts are scored by the thresholds alone, long ones whole; repeated rows stay. Columns of `df` with one of the three names are replaced.
    """
    rest = [c for c in df.columns if c not in ("expected_grade", "tail_probability", "kept")]
    at = rest.index(text)
    own = df.select(*[F.col(f"`{c}`") for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.tails(data, offsets) for _, _, data, offsets in text_chunks(batch.column(at))]
            tails = np.concatenate(found) if found else np.zeros((0, len(model.threshold)))
            p = tails[:, tail - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(axis=1)), pa.array(p), pa.array(p >= keep_from)], names=[*batch.schema.names, "expected_grade", "tail_probability", "kept"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields]).add("expected_grade", "double").add("tail_probability", "double").add("kept", "boolean"))
