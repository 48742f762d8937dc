"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and L1 leave few non-zero weights; those, not the whole hash space, travel to the tasks that
score the corpus. Scoring is one pass without a shuffle.
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
from shotweave.llm.hashing import collect_features, labelled_rows, word_features

BITS = 20


@dataclass(frozen=True)
class ToxicityModel:
    """Non-zero weights of a hashed space of 2**bits features; at most `sample` * features of it, in practice some hundreds."""

    bits: int
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability per text; each feature counts once per text."""
        index, text = word_features(data, offsets, self.bits)
        table = np.zeros(1 << self.bits, dtype=np.float32)
        table[self.index] = self.weight
        used = np.flatnonzero(table[index])
        key = np.unique(text[used] << self.bits | index[used])
        z = np.bincount(key >> self.bits, weights=table[key & (1 << self.bits) - 1], minlength=len(offsets) - 1) + self.bias
        return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, seed: int) -> ToxicityModel:
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    rng = np.random.default_rng(seed)
    weigh = lambda z, n, l1: -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2) * (np.abs(z) > l1)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, index, _ = rows[k]
            w, b = weigh(z[index], n[index], l1), float(weigh(np.float64(bias_z), np.float64(bias_n), 0.0))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            z[index] += g - (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha * w
            n[index] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * b
            bias_n += g * g
    w = weigh(z, n, l1)
    used = np.flatnonzero(w)
    return ToxicityModel(bits, used, w[used].astype(np.float32), float(weigh(np.float64(bias_z), np.float64(bias_n), 0.0)))


def fit_toxicity(documents: DataFrame, labels: DataFrame, sample: int = 4000, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, epochs: int = 4, seed: int = 7) -> ToxicityModel:
    """Fit on at most `sample` labelled rows (label `toxic`), never on the hold-out fold.

    Null labels and ids, and labels without a document, are left out; a repeated id counts as often as it occurs, within the
    bound. Without a single toxic row nothing can be learnt, and the model scores every text 0, so that nothing is rejected.
    """
    rows = collect_features(labelled_rows(documents, labels, "toxic", sample), word_features, BITS, sample, counts=False)
    if not any(y for y, _, _ in rows):
        return ToxicityModel(BITS, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), -np.inf)
    return fit_ftrl(rows, BITS, alpha, beta, l1, l2, epochs, seed)


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """`df` with a double column `out`, which replaces one of that name.

    Null and empty texts get the model's base rate. Rows stay, repeated ones and such without an id included, and so do
    other columns. Long texts are scored whole.
    """
    rest = [c for c in df.columns if c != out]
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(data, offsets) for _, _, data, offsets in text_chunks(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=[*batch.schema.names, out])

    own = df.select(*[F.col(f"`{c}`") for c in rest])
    return own.mapInArrow(run, T.StructType([*own.schema.fields]).add(out, "double"))
