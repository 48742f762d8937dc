"""Text to vector: a pluggable Arrow-batched encoder, each distinct text encoded once."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the encoder's model expects before a stored text and before a query.
PASSAGE, QUERY = "passage: ", "query: "
Encoder = Callable[[list[str]], np.ndarray]


def hash_encoder(dims: int = 64) -> Encoder:
    """A deterministic encoder without a model: the mean of signed hashed words."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in enumerate(texts):
            words = [zlib.crc32(w.encode()) for w in re.findall(r"\w+", text.lower())]
            np.add.at(out[row], [h % dims for h in words], [1.0 if h & 1 << 30 else -1.0 for h in words])
        return out

    return encode


def embed_texts(df: DataFrame, text: str, encoder: Encoder, model_id: int, prefix: str = PASSAGE, batch: int = 256) -> DataFrame:
    """`df` with model_id and embedding: array<float> of unit length, null for null texts; a text without words gives zeros.

    Texts are reduced to distinct ones by a digest, encoded in batches where they lie, and joined back by the digest.
    """
    digest = F.sha2(F.col(text), 256)
    once = df.where(F.col(text).isNotNull()).groupBy(digest.alias("__digest")).agg(F.first(text).alias("text"))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                v = np.asarray(encoder([prefix + t for t in part["text"]]), dtype=float)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"__digest": part["__digest"], "embedding": list(v.astype(np.float32))})

    vectors = once.mapInPandas(encode, "__digest string, embedding array<float>")
    return df.withColumn("__digest", digest).join(vectors, "__digest", "left").drop("__digest").withColumn("model_id", F.lit(model_id))


def embed_queries(df: DataFrame, text: str, encoder: Encoder, model_id: int, batch: int = 256) -> DataFrame:
    """`embed_texts` for what users ask, with the prefix that the model expects before a query."""
    return embed_texts(df, text, encoder, model_id, QUERY, batch)
