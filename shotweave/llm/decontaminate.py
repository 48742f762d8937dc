"""Benchmark decontamination as a prefix-filtered set join with exact verification.

Items are cut into windows (runs of `window` words; a shorter item is one window). The tokens of the join are short
shingles, ordered from rare to frequent over the whole corpus. A document that holds a window holds its rarest shingle, so
that one token is the window's necessary prefix: documents are probed for prefix tokens only. The token's place in the
window bounds where the window can start and end (positional bound), the document's length bounds it too, and all words of
the window are then compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.arrays import ALNUM, find_words, text_chunks, window_hash, window_ok
from shotweave.llm.graph import stored

U = np.uint64
SHINGLE = 3


def item_windows(items: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """(item, words: array<bigint>): the distinct windows of each item. Items without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out_id, out = batch.column(0).to_pylist(), [], []
            for lo, _, data, offsets in text_chunks(batch.column(1)):
                w = find_words(data, offsets, ALNUM, lower=True)
                h = w.hash.view(np.int64)
                for k in range(len(offsets) - 1):
                    a, b = int(w.first[k]), int(w.first[k + 1])
                    for s in range(a, max(b - window, a) + 1) if b > a else ():
                        out_id.append(ids[lo + k])
                        out.append(h[s : min(s + window, b)].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out_id, batch.schema.types[0]), pa.array(out, pa.list_(pa.int64()))], names=["item", "words"])

    kind = items.schema[item_id].dataType.simpleString()
    return items.select(F.col(item_id).alias("item"), F.col(text).alias("t")).mapInArrow(run, f"item {kind}, words array<bigint>").distinct()


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    return window_hash(words, size)[: len(words) - size + 1]


class Block:
    """A bounded block of windows, as arrays: their words, and the tokens by which documents are probed."""

    def __init__(self, words: list[list[int]]):
        self.words = [np.array(w, dtype=np.int64).view(U) for w in words]
        self.sizes = sorted({min(SHINGLE, len(w)) for w in self.words})
        self.tokens = [_shingles(w, min(SHINGLE, len(w))) for w in self.words]
        self.length = np.array([len(w) for w in self.words], dtype=np.int64)
        # one matrix per length, and each window's row in it
        self.matrix = {int(n): np.stack([w for w in self.words if len(w) == n]) for n in np.unique(self.length)}
        self.row = np.zeros(len(words), dtype=np.int64)
        for n in self.matrix:
            self.row[self.length == n] = np.arange(int((self.length == n).sum()))

    def all_tokens(self, size: int) -> np.ndarray:
        own = [t for t, w in zip(self.tokens, self.words, strict=True) if min(SHINGLE, len(w)) == size]
        return np.unique(np.concatenate(own)) if own else np.zeros(0, dtype=U)

    def choose(self, frequency: dict[int, int]) -> dict[int, tuple[np.ndarray, ...]]:
        """For each shingle size the prefix tokens, sorted: (token, its place in the window, window)."""
        rows: dict[int, list[tuple[int, int, int]]] = {s: [] for s in self.sizes}
        for k, (t, w) in enumerate(zip(self.tokens, self.words, strict=True)):
            place = min(range(len(t)), key=lambda i: (frequency.get(int(t[i]), 0), int(t[i]), i))
            rows[min(SHINGLE, len(w))].append((int(t[place]), place, k))
        out = {}
        for size, found in rows.items():
            found.sort()
            out[size] = (np.array([r[0] for r in found], dtype=U), np.array([r[1] for r in found]), np.array([r[2] for r in found]))
        return out


def _member(sorted_: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """Where `probe` is in the sorted array: a bit table first, as almost nothing is."""
    if not len(sorted_) or not len(probe):
        return np.zeros(0, dtype=np.int64)
    bits = np.zeros(1 << 20, dtype=bool)
    bits[(sorted_ & U((1 << 20) - 1)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(probe & U((1 << 20) - 1)).astype(np.int64)])
    spot = np.minimum(np.searchsorted(sorted_, probe[maybe]), len(sorted_) - 1)
    return maybe[sorted_[spot] == probe[maybe]]


def token_frequency(docs: DataFrame, blocks_tokens: dict[int, np.ndarray]) -> DataFrame:
    """(token, n): how often each benchmark shingle occurs in the corpus; summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {s: np.zeros(len(t), dtype=np.int64) for s, t in blocks_tokens.items()}
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                w = find_words(data, offsets, ALNUM, lower=True)
                for size, known in blocks_tokens.items():
                    h = window_hash(w.hash, size)[window_ok(w.first, size)]
                    hit = h[_member(known, h)]
                    total[size] += np.bincount(np.searchsorted(known, hit), minlength=len(known))
        for size, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(blocks_tokens[size][used].view(np.int64)), pa.array(n[used])], names=["token", "n"])

    return docs.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def probe(block: Block, prefix: dict[int, tuple[np.ndarray, ...]], h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start word, window) of all exact occurrences in the texts of a chunk."""
    starts, wins = [], []
    for size, (token, place, window) in prefix.items():
        grams = window_hash(h, size)
        ok = window_ok(first, size)
        at = _member(np.unique(token), grams)
        at = at[ok[at]]
        lo, hi = np.searchsorted(token, grams[at]), np.searchsorted(token, grams[at], side="right")
        n = hi - lo
        which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        where = np.repeat(at, n)
        start, win = where - place[which], window[which]
        row = np.searchsorted(first, where, side="right") - 1
        length = block.length[win]
        fits = (start >= first[row]) & (start + length <= first[row + 1])  # positional and length bounds
        start, win, length = start[fits], win[fits], length[fits]
        for L in np.unique(length):
            mine = length == L
            s, k = start[mine], win[mine]
            same = (h[s[:, None] + np.arange(L)] == block.matrix[int(L)][block.row[k]]).all(axis=1)
            starts.append(s[same])
            wins.append(k[same])
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(starts), np.concatenate(wins)


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_windows: int = 200_000) -> DataFrame:
    """Per row of `docs`: its id, n_words, n_hit (words inside an occurring window) and items (sorted item ids as strings).

    Null or empty texts have no words, items without words have no window, and a repeated row is reported as often as it
    occurs. Items with equal texts are all reported; the windows of items without an id count as hits but name no item. Long
    texts are searched whole, and other columns are not read. The benchmark is taken in blocks of at most `block_windows`
    distinct windows (about 16 MB), so what a task holds is bounded; windows have numbers, and the items that share one are
    joined to the documents that hold it. With one block, only counts and hits are shuffled; beyond that the numbered input
    is stored once, each block is one more pass, and hits are merged by number. No windows: no hits.
    """
    own = stored(item_windows(items, window, item_id, item_text))
    windows = stored(own.select("words").distinct().withColumn("window", F.monotonically_increasing_id()))  # stored, so a window keeps its number
    n = windows.count()
    blocks = max(1, -(-n // block_windows))
    numbered = windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__t")).withColumn("row", F.monotonically_increasing_id() if blocks > 1 else F.lit(0).cast("bigint"))
    base = stored(base) if blocks > 1 else base  # so that every pass sees the same numbers
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_hit bigint, windows array<bigint>, row bigint, hits array<int>"
    parts = []
    for b in range(blocks):
        rows = numbered.where(F.col("block") == b).orderBy("words").collect()  # bounded by block_windows
        block, numbers = Block([r["words"] for r in rows]), np.array([r["window"] for r in rows], dtype=np.int64)
        tokens = {s: block.all_tokens(s) for s in block.sizes}
        frequency = {r.token & (1 << 64) - 1: r.n for r in token_frequency(base.select("__t"), tokens).collect()} if rows else {}
        parts.append(_hits(base, block, block.choose(frequency), numbers, schema, keep_hits=blocks > 1))
    found = reduce(DataFrame.unionByName, parts)
    if blocks == 1:
        found = found.withColumn("row", F.monotonically_increasing_id())
    else:
        merged = found.groupBy("row", "doc_id", "n_words").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("h"), F.flatten(F.collect_list("windows")).alias("windows"))
        found = merged.select("doc_id", "n_words", F.size("h").cast("bigint").alias("n_hit"), "windows", "row")
    found = stored(found.select("doc_id", "n_words", "n_hit", "windows", "row"))
    # names join after the probe: a window that very many items share is many rows, not a list
    named = own.where("item is not null").join(windows, "words").select("window", F.col("item").cast("string").alias("item"))
    hit = found.where(F.size("windows") > 0)
    items_of = hit.select("row", F.explode("windows").alias("window")).join(named, "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    hit = hit.join(items_of, "row", "left").select("doc_id", "n_words", "n_hit", F.coalesce("items", none).alias("items"))
    return hit.unionByName(found.where(F.size("windows") == 0).select("doc_id", "n_words", "n_hit", none.alias("items")))


def _hits(base: DataFrame, block: Block, prefix: dict, numbers: np.ndarray, schema: str, keep_hits: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_hit = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            met: list[list[int]] = [[] for _ in range(n)]
            places: list[list[int]] = [[] for _ in range(n)]
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                w = find_words(data, offsets, ALNUM, lower=True)
                n_words[lo:hi] = w.counts
                start, win = probe(block, prefix, w.hash, w.first)
                if not len(start):
                    continue
                mark = np.zeros(len(w.hash) + 1, dtype=np.int64)
                length = block.length[win]
                np.add.at(mark, start, 1)
                np.add.at(mark, start + length, -1)
                hit = np.cumsum(mark[:-1]) > 0
                run_sum = np.concatenate(([0], np.cumsum(hit)))
                n_hit[lo:hi] = run_sum[w.first[1:]] - run_sum[w.first[:-1]]
                row = np.searchsorted(w.first, start, side="right") - 1
                for r, k in {*zip(row.tolist(), win.tolist(), strict=True)}:
                    met[lo + r].append(int(numbers[k]))
                if keep_hits:
                    for r in np.unique(row):
                        places[lo + r] = np.flatnonzero(hit[w.first[r] : w.first[r + 1]]).tolist()
            row_id = batch.column(2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array(met, pa.list_(pa.int64())), row_id, pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "n_words", "n_hit", "windows", "row", "hits"])

    return base.select("doc_id", "__t", "row").mapInArrow(run, schema)
