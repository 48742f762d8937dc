"""Hashed text features: the extraction that the two classifiers share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.llm.arrays import ALNUM, NONSPACE, find_words, mix64, pair_hash, text_chunks

U = np.uint64


def word_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, text): unigrams, bigrams and one-word-gap skip-grams of lower-case words, with repeats."""
    w = find_words(data, offsets, ALNUM, lower=True)
    owner, mask = w.owner(), U((1 << bits) - 1)
    index, text = [w.hash & mask], [owner]
    for gap in (1, 2):
        same = owner[gap:] == owner[:-gap]
        index.append(pair_hash(w.hash[:-gap], w.hash[gap:], 31 * gap)[same] & mask)
        text.append(owner[gap:][same])
    return np.concatenate(index).astype(np.int64), np.concatenate(text)


def shape_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, text): tokens between white space, repeated neighbours, and byte trigrams, with repeats."""
    w = find_words(data, offsets, NONSPACE, lower=True)
    owner, mask = w.owner(), U((1 << bits) - 1)
    again = np.flatnonzero((owner[1:] == owner[:-1]) & (w.hash[1:] == w.hash[:-1])) if len(owner) else owner
    d = w.data.astype(np.int64)
    tri = mix64((d[:-2] | d[1:-1] << 8 | d[2:] << 16).astype(U) + U(1 << 40)) & mask if len(d) > 2 else np.zeros(0, dtype=U)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    same = row[2:] == row[:-2] if len(d) > 2 else np.zeros(0, dtype=bool)
    mark = np.full(len(again), mix64(np.array([5], dtype=U))[0] & mask, dtype=U)
    index = np.concatenate([w.hash & mask, mark, tri[same]]).astype(np.int64)
    return index, np.concatenate([owner, owner[again], row[2:][same] if len(d) > 2 else owner[:0]])


def folded(index: np.ndarray, text: np.ndarray, bits: int, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, index, count): the distinct features of each text."""
    key, count = np.unique(text << bits | index, return_counts=True)
    return np.searchsorted(key, np.arange(texts + 1, dtype=np.int64) << bits), key & (1 << bits) - 1, count


def labelled_rows(documents: DataFrame, labels: DataFrame, label: str, limit: int, holdout: tuple[int, int] | None = (4, 2)) -> DataFrame:
    """(doc_id, text, label): the documents of at most `limit` labels, in the order of a hash of their id.

    Rows whose crc32(id as text) mod holdout[0] equals holdout[1] are never taken. The labels are cut first, so no more
    than `limit` rows travel to the documents; documents that repeat an id all get its labels.
    """
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    if holdout:
        own = own.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(holdout[0])) != holdout[1])
    own = own.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "label").limit(limit)
    return documents.select("doc_id", "text").join(F.broadcast(own), "doc_id")  # bounded by `limit`


def collect_features(rows: DataFrame, features, bits: int, limit: int, counts: bool = True) -> list[tuple[int, np.ndarray, np.ndarray | None]]:
    """(label, index, count) of at most `limit` rows as int32 and uint32, for fitting on the driver; without `counts`, no counts.

    The rows are cut by the same hash of the id again, then by their features, so repeated ids can't exceed the bound. A
    row has no more than 2**bits features, however long its text. The arrays are views of the collected Arrow table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                first, index, count = folded(*features(data, offsets, bits), bits, hi - lo)
                cells += [(index[a:b].astype("<i4").tobytes(), count[a:b].astype("<u4").tobytes() if counts else b"") for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], names=["doc_id", "label", "i", "n"])

    found = rows.select(F.xxhash64("doc_id", F.lit(11)).alias("doc_id"), "text", F.col("label").cast("int")).mapInArrow(run, "doc_id bigint, label int, i binary, n binary")
    table = found.orderBy("doc_id", "label", F.crc32("i"), F.crc32("n")).limit(limit).select("label", "i", "n").toArrow()
    view = lambda x, kind: np.frombuffer(x.as_buffer(), dtype=kind)
    return [(y.as_py(), view(i, "<i4"), view(n, "<u4") if counts else None) for batch in table.to_batches() for y, i, n in zip(*batch.columns, strict=True)]
