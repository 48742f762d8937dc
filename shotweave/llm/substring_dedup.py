"""Removal of long repeated word runs by recompression.

Texts become sequences of word fingerprints. In each round equal neighbours (runs) and then disjoint neighbour pairs are
replaced by new symbols; a pair merges when a per-round bit of its left symbol is 0 and that of its right symbol is 1, so
what merges depends on nothing but the two names, and equal substrings get equal interior symbols wherever they stand. A new
symbol's name is a fingerprint of what it replaces, which makes names global without a dictionary shuffle. For each symbol
the words are tracked on which its existence depends. Every window of `window` words is represented by the least-named
symbol of the highest level whose words all lie inside it: a function of the window's own words, so equal windows have equal
representatives, with equal words around them. A first grouped Spark job finds the symbols that occur twice anywhere, with
those words; the windows that they represent are then verified by a 128-bit fingerprint of all their words in a second one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.arrays import NONSPACE, find_words, mix64, pair_hash, text_chunks, window_hash
from shotweave.llm.repeats import PACKED, Packer, parts_of, repeated_places

U = np.uint64
FAR = 1 << 40


class Level:
    """Symbols of several texts: names, owners, and the word range [lo, hi) on which each one depends."""

    def __init__(self, name: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.name, self.doc, self.lo, self.hi = name, doc, lo, hi

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        same = self.doc[1:] == self.doc[:-1]
        return np.append(False, same), np.append(same, False)  # has a left, has a right neighbour


def runs(level: Level) -> Level:
    """Maximal runs of equal symbols become one symbol; each depends on both neighbours, which differ."""
    n = len(level.name)
    left, right = level.neighbours()
    lo = np.where(left, np.append(0, level.lo[:-1]), -FAR)
    hi = np.where(right, np.append(level.hi[1:], 0), FAR)
    equal = left & np.append(False, level.name[1:] == level.name[:-1])
    head = np.flatnonzero(~equal)
    tail = np.append(head[1:], n) - 1
    size = tail - head + 1
    name = np.where(size > 1, pair_hash(level.name[head], size.astype(U), 11), level.name[head])
    return Level(name, level.doc[head], np.minimum(level.lo[head], lo[head]), np.maximum(level.hi[tail], hi[tail]))


def pairs(level: Level, turn: int) -> Level:
    """Pairs (0-symbol, 1-symbol) become one symbol; a symbol that stays depends on the neighbour it did not merge with."""
    side = (mix64(level.name + U(1000 + turn)) & U(1)).astype(bool)
    left, right = level.neighbours()
    first = right & ~side & np.append(side[1:], False)
    second = np.append(False, first[:-1])
    lo = np.where(side & ~second, np.where(left, np.append(0, level.lo[:-1]), -FAR), level.lo)
    hi = np.where(~side & ~first, np.where(right, np.append(level.hi[1:], 0), FAR), level.hi)
    keep = ~second
    name = level.name.copy()
    at = np.flatnonzero(first)
    name[at] = pair_hash(level.name[at], level.name[at + 1], 13 + turn)
    hi[at] = level.hi[at + 1]
    return Level(name[keep], level.doc[keep], lo[keep], hi[keep])


def levels(h: np.ndarray, doc: np.ndarray, rounds: int) -> list[Level]:
    at = np.arange(len(h))
    out = [Level(h, doc, at, at + 1)]
    for turn in range(rounds):
        top = out[-1]
        if turn % 3 == 0:
            top = runs(top)
        out.append(pairs(top, turn))
    return out


def range_hash(h: np.ndarray):
    """A function of (lo, hi): polynomial fingerprints of h[lo:hi], by prefix sums."""
    base, inverse = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    power = np.cumprod(np.append(U(1), np.full(len(h), base)))
    back = np.cumprod(np.append(U(1), np.full(len(h), inverse)))
    total = np.append(U(0), np.cumsum(mix64(h) * power[: len(h)]))
    return lambda lo, hi: (total[hi] - total[lo]) * back[lo] + (hi - lo).astype(U)


def _least(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the first least value in each range [lo, hi): two overlapping power-of-two blocks per range."""
    out = lo.copy()
    size, best = 1, np.arange(len(value))
    length = hi - lo
    while True:
        mine = np.flatnonzero((length >= size) & (length < 2 * size))
        if len(mine):
            x, y = best[lo[mine]], best[hi[mine] - size]
            out[mine] = np.where(value[y] < value[x], y, x)
        if size * 2 > length.max(initial=0):
            return out
        x, y = best[:-size], best[size:]
        best = np.where(value[y] < value[x], y, x)
        size *= 2


def representatives(h: np.ndarray, first: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, last window) of the symbols that represent at least one window; windows by start word.

    A window is represented by the least-named (then leftmost) symbol of the highest level that has a symbol inside it.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(h):
        return np.zeros(0, dtype=U), none, none
    spans = range_hash(h)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(np.arange(len(h)) + window <= np.repeat(first[1:], np.diff(first)))
    names, begins, ends = [], [], []
    for depth, level in reversed(list(enumerate(levels(h, doc, rounds)))):
        if not len(start):
            break
        # ranges [lo, hi) never step back from one symbol to the next; those that hang on a text's edge fit nowhere
        lo = np.maximum.accumulate(np.where(level.lo < 0, 0, level.lo))
        inside = (level.lo >= 0) & (level.hi < FAR)
        lo, hi, name = lo[inside], level.hi[inside], level.name[inside]
        if not len(name):
            continue
        k = np.searchsorted(lo, start)
        end = np.searchsorted(hi, start + window, side="right")
        fits = end > k
        w = start[fits]
        if len(w):  # windows of one symbol are consecutive
            k = _least(name, k[fits], end[fits])
            cut = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (w[1:] != w[:-1] + 1)))
            chosen = k[cut]
            names.append(mix64(pair_hash(name[chosen], spans(lo[chosen], hi[chosen])) + U(depth)))
            begins.append(w[cut])
            ends.append(w[np.append(cut[1:], len(w)) - 1])
        start = start[~fits]
    if not names:
        return np.zeros(0, dtype=U), none, none
    return np.concatenate(names), np.concatenate(begins), np.concatenate(ends)


def _symbols(parts: int, window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(parts)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                w = find_words(data, offsets, NONSPACE, lower=False)
                name, begin, end = representatives(w.hash, w.first, window, rounds)
                row = np.searchsorted(w.first, begin, side="right") - 1
                pack.add(keys[lo:hi], row, name, np.zeros(len(name), dtype=U), begin - w.first[row], end - w.first[row])
                if pack.full():
                    yield from pack.flush()
        yield from pack.flush()

    return run


def _places(at: pa.Array, to: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): all integers covered by the closed ranges of each row, once."""
    row = np.repeat(np.arange(len(at)), pa.compute.list_value_length(at).fill_null(0).to_numpy(zero_copy_only=False))
    a, b = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64), to.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = b - a + 1
    place = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    key = np.unique(np.repeat(row, n) << 32 | place)
    return key >> 32, key & 0xFFFFFFFF


def _windows(parts: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(parts)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            row, place = _places(batch.column(2), batch.column(3))
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                a, b = np.searchsorted(row, [lo, hi])
                w = find_words(data, offsets, NONSPACE, lower=False)
                s = place[a:b] + w.first[row[a:b] - lo]
                one, two = window_hash(w.hash, window, 21)[s], window_hash(w.hash, window, 1_000_003)[s]
                pack.add(keys[lo:hi], row[a:b] - lo, one, two, place[a:b], place[a:b])
                if pack.full():
                    yield from pack.flush()
        yield from pack.flush()

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place = _places(batch.column(2), batch.column(2))
            n_words, gone, kept = [], [], []
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                w = find_words(data, offsets, NONSPACE, lower=False)
                a, b = np.searchsorted(row, [lo, hi])
                s = place[a:b] + w.first[row[a:b] - lo]
                drop = np.bincount(s, minlength=len(w.hash) + 1) - np.bincount(s + window, minlength=len(w.hash) + 1)
                keep = np.cumsum(drop[:-1]) <= 0
                left = np.concatenate(([0], np.cumsum(keep)))[w.first]
                n_words += w.counts.tolist()
                gone += (w.counts - np.diff(left)).tolist()
                raw, begin, end = data.tobytes(), w.start[keep].tolist(), (w.start + w.length)[keep].tolist()
                kept += [b" ".join([raw[i:j] for i, j in zip(begin[x:y], end[x:y], strict=True)]) for x, y in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["key", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 35, rounds: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): each text without the words of windows that also start elsewhere.

    Words are maximal runs outside space and \\x09-\\x0D. All windows are judged on the input. Null and empty texts have no
    words; texts shorter than `window` keep all. A repeated row is a document of its own, so its windows repeat; rows that
    agree in id and text are reported alike. A null id is allowed. Kept words are joined by one space.
    """
    from shotweave.llm.graph import stored

    base = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    base = base.select("__id", "t", F.concat_ws(":", F.col("__id").cast("string"), F.hex(F.xxhash64("t"))).cast("binary").alias("key"))
    parts = parts_of(spark, base.select("t"))
    symbols = base.select("key", "t").mapInArrow(_symbols(parts, window, rounds), PACKED)
    shared = stored(repeated_places(symbols, parts).withColumnRenamed("doc_key", "key"))
    # one shuffle of the texts: both joins read the same columns of it, so the exchange is reused
    marked = base.join(shared.hint("shuffle_hash"), "key", "left")
    touched = marked.where(F.col("at").isNotNull())
    repeats = touched.select("key", "t", "at", "to", "__id").mapInArrow(_windows(parts, window), PACKED)
    found = repeated_places(repeats, parts).select(F.col("doc_key").alias("key"), F.col("at").alias("starts"))
    kind = base.schema["__id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string"
    final = base.join(found.hint("shuffle_hash"), "key", "left").select("__id", "t", "starts")
    return final.mapInArrow(_kept(window), schema.replace("doc_id", "key")).withColumnRenamed("key", "doc_id")
