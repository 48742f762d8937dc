"""Retrievers: two-phase vector search, lexical search, mapping of segments to shots. All keyed by query_id."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.functions.text import lexemes, trigrams
from shotweave.functions.vectors import binary_quantize, cosine_distance
from shotweave.operators.codeindex import CodeIndex
from shotweave.operators.ranking import rank_list, top_k
from shotweave.operators.shared import MOST_SHARED, once_by
from shotweave.operators.textindex import TextIndex, adjacent, cover_score, looked_up, text_places, word_rows
from shotweave.sources.scratch import stored


def encode(vectors: DataFrame, key: str) -> DataFrame:
    """(key, model_id, code): the narrow table of phase one."""
    return vectors.select(key, "model_id", binary_quantize(F.col("embedding")).alias("code"))


def ann_candidates(queries: DataFrame, codes: DataFrame, key: str, oversample: int, index: CodeIndex | None = None) -> DataFrame:
    """(query_id, model_id, key, bits): the `oversample` nearest codes of each query by Hamming distance, before any filter.

    The cut loses neighbours as the table grows; `knn` lets it grow with the table, and `knn_exact` has no cut. With an index,
    only codes that share a part with a query are read, as far as that pays.
    """
    if index:
        scan = lambda q, k: _scan(q.withColumnRenamed("code", "e"), index.codes.select(F.col("key").alias("k"), "model_id", F.col("code").alias("e")), k, "bits").select("query_id", "model_id", F.col("k").alias("key"), F.col("d").cast("int").alias("bits"))
        found, _ = index.nearest(queries.select("query_id", "model_id", binary_quantize(F.col("embedding")).alias("code")), oversample, scan)
        return found.select("query_id", "model_id", F.col("key").alias(key), "bits")
    q = queries.select("query_id", "model_id", binary_quantize(F.col("embedding")).alias("e"))
    near = _scan(q, codes.select(F.col(key).alias("k"), "model_id", F.col("code").alias("e")), oversample, "bits").withColumnRenamed("k", key)
    return top_k(near.withColumn("bits", F.col("d").cast("int")).drop("d"), ["query_id"], oversample, F.col("bits"), F.col(key)).drop("rank")


def exact_rerank(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(query_id, key, distance, rank): candidates by cosine distance, then key."""
    q = queries.select("query_id", F.col("embedding").alias("qv"))
    x = candidates.join(vectors.select(key, "model_id", "embedding"), [key, "model_id"]).join(q, "query_id")
    x = x.select("query_id", key, F.round(cosine_distance(F.col("embedding"), F.col("qv")), 6).alias("distance"))
    return rank_list(x, ["query_id"], F.col("distance"), F.col(key))


#: So many queries, with so many exclusions and nearest rows in all, are compared with all vectors in one pass; a task holds their
#: vectors, their nearest rows so far and one block of distances.
BLOCK_QUERIES, BLOCK_GONE, BLOCK_NEAR, BLOCK_PAIRS = 4096, 4_000_000, 1_000_000, 2_000_000
OUT_ROWS = 100_000


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(q: np.ndarray, x: np.ndarray, kind: str) -> np.ndarray:
    """Differing bits of codes, or 1 - cosine of unit vectors."""
    if kind == "cosine":
        return 1 - q @ x.T
    return sum(np.bitwise_count(q[:, None, i] ^ x[None, :, i]).astype(np.float64) for i in range(q.shape[1]))


class _Block:
    """The queries of one model and width: ids, vectors, the collection each asks for, and the videos each excludes."""

    def __init__(self, rows: list, kind: str) -> None:
        self.kind, self.ids = kind, np.array([r["query_id"] for r in rows])
        self.e = self.read(np.array([r["e"] for r in rows]))
        gone = [(i, v) for i, r in enumerate(rows) for v in r["gone"]]
        self.videos, code = np.unique(np.array([v for _, v in gone], dtype=str), return_inverse=True)
        self.gone = np.array([i for i, _ in gone], dtype=np.int64), code.reshape(-1)
        self.names, self.asked = np.unique(np.array([r["asked"] for r in rows], dtype=str), return_inverse=True)
        self.filters = bool(gone) or any(self.names != "")

    def read(self, x: np.ndarray) -> np.ndarray:
        return _unit(x.astype(np.float64)) if self.kind == "cosine" else x.astype(np.int64)

    def hidden(self, lo: int, hi: int, video: np.ndarray, collection: np.ndarray) -> np.ndarray:
        """A bit per query of the range and vector: whether the query's filters hide it."""
        own, at = np.unique(self._code(self.videos, video), return_inverse=True)
        bits = np.zeros((hi - lo, len(own)), dtype=bool)
        near = (self.gone[0] >= lo) & (self.gone[0] < hi) & np.isin(self.gone[1], own)
        bits[self.gone[0][near] - lo, np.searchsorted(own, self.gone[1][near])] = True
        asked = self.asked[lo:hi, None]
        return bits[:, at.reshape(-1)] | ((self.names[asked] != "") & (asked != self._code(self.names, collection)[None, :]))

    @staticmethod
    def _code(known: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The place of each value among the sorted known ones, or -1."""
        if not len(known):
            return np.full(len(values), -1)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return np.where(known[at] == values, at, -1)


class _Nearest:
    """The k nearest rows so far of each query of a block, by distance as it is rounded later, then key.

    A distance next to a place of rounding counts as the larger one where it would push others out, and as the smaller one where
    it would be pushed out, so no row is lost to the last bit.
    """

    def __init__(self, queries: int, k: int, kind: str) -> None:
        self.k, self.kind = k, kind
        self.bar, self.parts, self.size = np.full(queries, np.inf), [], 0
        self.most = 2 * queries * k + BLOCK_PAIRS

    def add(self, lo: int, d: np.ndarray, keys: np.ndarray) -> None:
        """d: distances of the queries from `lo` on to the rows of the keys; infinite ones are hidden."""
        bar = self.bar[lo : lo + len(d), None]
        if self.k < d.shape[1] and np.isinf(bar).any():
            bar = np.minimum(bar, np.partition(d, self.k - 1, axis=1)[:, self.k - 1][:, None] + (2e-6 if self.kind == "cosine" else 0))
        row, col = np.nonzero((d <= bar) & (d < np.inf))
        self.parts.append((row + lo, d[row, col], keys[col]))
        self.size += len(row)
        if self.size > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, d, keys = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.array([], dtype=np.int64), np.array([]), np.array([], dtype=np.int64))
        high, low = (np.floor(d * 1e6 + 0.5 + e) for e in (1e-5, -1e-5)) if self.kind == "cosine" else (d, d)
        order = np.lexsort((keys, high, q))
        q, d, keys, high, low = q[order], d[order], keys[order], high[order], low[order]
        start = np.searchsorted(q, np.arange(len(self.bar)))
        kth = start + self.k - 1
        full = np.flatnonzero(kth < np.append(start[1:], len(q)))
        worst, last = np.full(len(self.bar), np.inf), np.zeros(len(self.bar), dtype=keys.dtype)
        worst[full], last[full] = high[kth[full]], keys[kth[full]]
        self.bar = (worst + 0.5) * 1e-6 + 1e-9 if self.kind == "cosine" else worst
        keep = (low < worst[q]) | ((low == worst[q]) & (keys <= last[q]))
        out = q[keep], d[keep], keys[keep]
        self.parts, self.size = [out], int(keep.sum())
        return out


def _scan(q: DataFrame, v: DataFrame, k: int, kind: str) -> DataFrame:
    """(query_id, k, model_id, d): per query and model the k nearest of each task's rows, so its rows do not grow with the pairs.

    q: query_id, model_id, e, and optionally gone (excluded videos) and asked (a collection, '' for any), which hide rows before a batch's cut;
    v: k, model_id, e, video_id and collection where a query has filters. Every row is compared with every query of its model, the
    queries in blocks, so there is no shuffle of vectors and no join on the few model ids. Of several blocks, each is read by
    the driver on its own, and its results are stored before the next.
    """
    filters = [c for c in ("gone", "asked") if c in q.columns]
    for name, none in (("gone", F.array().cast("array<string>")), ("asked", F.lit(""))):
        q = q.withColumn(name, F.coalesce(name, none) if name in filters else none)
    shown = [F.coalesce(c, F.lit("")).alias(c) if c in v.columns else F.lit("").alias(c) for c in ("video_id", "collection")]
    v = v.select("k", "model_id", "e", *(shown if filters else []))
    kinds = dict(q.dtypes)["query_id"], dict(v.dtypes)["k"], dict(v.dtypes)["model_id"]
    types, key_type = [{"int": pa.int32(), "bigint": pa.int64()}[x] for x in (kinds[0], kinds[2])], {"int": pa.int32(), "bigint": pa.int64()}[kinds[1]]
    def run_for(rows: list) -> Callable:
        by: dict[tuple, list] = {}
        for r in rows:
            by.setdefault((r["model_id"], len(r["e"])), []).append(r)
        sets = {m: _Block(rs, kind) for m, rs in by.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = {m: _Nearest(len(block.ids), k, kind) for m, block in sets.items()}
            for batch in batches:
                model, size = batch.column(1).to_numpy(zero_copy_only=False), pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
                for (m, dims), block in sets.items():
                    at = np.flatnonzero((model == m) & (size == dims))
                    if not len(at):
                        continue
                    x = block.read(batch.column(2).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dims))
                    good = ~np.isnan(x).any(axis=1)
                    at, x = at[good], x[good]
                    text = [batch.column(i).take(pa.array(at)).to_numpy(zero_copy_only=False).astype(str) for i in (3, 4)] if block.filters else None
                    keys = batch.column(0).take(pa.array(at)).to_numpy(zero_copy_only=False)
                    step = max(1, BLOCK_PAIRS // max(1, len(at)))
                    for lo in range(0, len(block.ids) if len(at) else 0, step):
                        d = _distances(block.e[lo : lo + step], x, kind)
                        if block.filters:
                            d[block.hidden(lo, lo + len(d), *text)] = np.inf
                        near[m, dims].add(lo, d, keys)
            for (m, dims), found in near.items():
                row, d, keys = found.cut()
                for lo in range(0, len(row), OUT_ROWS):
                    own = slice(lo, lo + OUT_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(sets[m, dims].ids[row[own]]).cast(types[0]), pa.array(keys[own]).cast(key_type), pa.array(np.full(len(row[own]), m)).cast(types[1]), pa.array(d[own])], names=["query_id", "k", "model_id", "d"])

        return run

    schema = f"query_id {kinds[0]}, k {kinds[1]}, model_id {kinds[2]}, d double"
    n, gone = q.agg(F.count("*"), F.sum(F.size("gone"))).first()
    blocks = max(1, -(-n // BLOCK_QUERIES), -(-(gone or 0) // BLOCK_GONE), -(-n * k // BLOCK_NEAR))
    if blocks == 1:
        return v.mapInArrow(run_for(q.collect()), schema)  # bounded by BLOCK_QUERIES
    v = stored(v)  # read once a block
    q = stored(q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))))
    return reduce(DataFrame.unionByName, [stored(v.mapInArrow(run_for(q.where(F.col("block") == b).collect()), schema)) for b in range(blocks)])


def exact_candidates(queries: DataFrame, vectors: DataFrame, key: str, k: int) -> DataFrame:
    """(query_id, key, model_id, d): the k nearest of each batch of vectors, with all that are as near to 6 digits.

    Vectors of no length, and null ones, have no distance.
    """
    wide = lambda df, own: df.select(*[c for c in (own, "model_id", "gone", "asked", "video_id", "collection") if c in df.columns], F.transform("embedding", lambda x: x.cast("double")).alias("e")).where("e is not null")
    return _scan(wide(queries, "query_id"), wide(vectors, key).withColumnRenamed(key, "k"), k, "cosine").withColumnRenamed("k", key)


def knn_exact(queries: DataFrame, vectors: DataFrame, key: str, k: int) -> DataFrame:
    """(query_id, key, distance, rank): the k nearest of all vectors by cosine distance, then key; no candidate cut."""
    near = exact_candidates(queries, vectors, key, k).select("query_id", key, F.round("d", 6).alias("distance"))
    return top_k(near, ["query_id"], k, F.col("distance"), F.col(key))


def nearest(queries: DataFrame, vectors: DataFrame, key: str, k: int, oversample: int | None) -> DataFrame:
    """The exact k nearest, or by sign codes what `oversample` candidates hold."""
    return knn_exact(queries, vectors, key, k) if oversample is None else knn(queries, vectors, key, oversample)


def knn(queries: DataFrame, vectors: DataFrame, key: str, oversample: int) -> DataFrame:
    """Two-phase search: the nearest `oversample` codes, ranked by cosine distance."""
    return exact_rerank(ann_candidates(queries, encode(vectors, key), key, oversample), queries, vectors, key)


def allowed(df: DataFrame, videos: DataFrame, collection: str | None = None, exclude: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Rows of an allowed collection whose video the query does not exclude.

    `wanted` (query_id, collection) holds queries that ask for a collection of their own; blank ones ask for all.
    """
    if collection and collection.strip():
        df = df.join(videos.where(F.col("collection") == collection.strip().upper()).select("video_id"), "video_id", "left_semi")
    if wanted is not None:
        own = videos.select("video_id", F.col("collection").alias("own"))
        asked = wanted.select("query_id", F.upper(F.trim("collection")).alias("asked")).where("asked <> ''")
        df = df.join(own, "video_id").join(asked, "query_id", "left").where("asked is null or asked = own").drop("own", "asked")
    return df.join(exclude.select("query_id", "video_id"), ["query_id", "video_id"], "left_anti") if exclude is not None else df


def resolve_scenes(ranked: DataFrame, keyframes: DataFrame, videos: DataFrame, limit: int, **filters) -> DataFrame:
    """(query_id, rank, scene_id, keyframe_id): filters an already ranked list, keeps its order and cuts it."""
    x = allowed(ranked.join(keyframes.select("keyframe_id", "scene_id", "video_id"), "keyframe_id"), videos, **filters)
    return top_k(x.withColumnRenamed("rank", "r"), ["query_id"], limit, F.col("r"), F.col("keyframe_id")).select("query_id", "rank", "scene_id", "keyframe_id")


#: Intervals of a video are joined inside bins of this length.
BIN_MS = 60_000


def segment_scenes(segments: DataFrame, scenes: DataFrame) -> DataFrame:
    """Interval overlap on the same video, both bounds strict.

    Both sides stand in every time bin that they touch, and a pair counts in the bin of its later start, so a long video is
    many keys and a pair is found once.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / F.lit(BIN_MS)), F.floor(F.greatest(a, b) / F.lit(BIN_MS))))
    s = scenes.select("scene_id", F.col("video_id").alias("v"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    s = s.withColumn("bin_", bins(F.col("a"), F.col("b")))
    own = segments.withColumn("bin", bins(F.col("start_ms"), F.col("end_ms")))
    later = F.floor(F.greatest("start_ms", "a") / F.lit(BIN_MS))
    overlap = (F.col("start_ms") < F.col("b")) & (F.col("end_ms") > F.col("a")) & (later == F.col("bin"))
    return own.join(s, (F.col("video_id") == F.col("v")) & (F.col("bin") == F.col("bin_")) & overlap).drop("v", "a", "b", "bin", "bin_")


def expand_to_keyframes(scene_rank: DataFrame, keyframes: DataFrame, limit: int) -> DataFrame:
    """Every keyframe of a scene inherits the scene's place; order (scene place, time), cut at `limit`."""
    x = scene_rank.select("query_id", F.col("rank").alias("place"), "scene_id").join(keyframes.select("scene_id", "keyframe_id", "ts_ms"), "scene_id")
    return top_k(x, ["query_id"], limit, F.col("place"), F.col("ts_ms"), F.col("keyframe_id")).select("query_id", "rank", "scene_id", "keyframe_id")


def first_hit_per_scene(hits: DataFrame, limit: int) -> DataFrame:
    """Each scene once, at the place of its first segment."""
    x = hits.groupBy("query_id", "scene_id").agg(F.min("rank").alias("first"))
    return top_k(x, ["query_id"], limit, F.col("first"), F.col("scene_id")).select("query_id", "rank", "scene_id")


def _filtered(queries: DataFrame, vectors: DataFrame, t: dict, depth: int, oversample: int | None, **filters) -> DataFrame:
    """Keyframes by vector. In an exact search the filters travel with the queries and hide vectors before any cut."""
    if oversample is not None:
        return resolve_scenes(nearest(queries, vectors, "keyframe_id", depth, oversample), t["keyframes"], t["videos"], depth, **filters)
    collection, exclude, wanted = (filters.get(x) for x in ("collection", "exclude", "wanted"))
    if (collection or "").strip() or exclude is not None or wanted is not None:
        own = t["keyframes"].select("keyframe_id", "video_id")
        if (collection or "").strip():
            own = allowed(own, t["videos"], collection)
        vectors = vectors.join(own, "keyframe_id")
    if exclude is not None:
        gone = exclude.groupBy("query_id").agg(F.collect_set("video_id").alias("gone"))
        queries = queries.join(gone, "query_id", "left")
    if wanted is not None:
        vectors = vectors.join(t["videos"].select("video_id", "collection"), "video_id")
        queries = queries.join(wanted.select("query_id", F.upper(F.trim("collection")).alias("asked")), "query_id", "left")
    return resolve_scenes(knn_exact(queries, vectors, "keyframe_id", depth), t["keyframes"], t["videos"], depth)


def retrieve_visual(queries: DataFrame, t: dict[str, DataFrame], depth: int = 200, oversample: int | None = None, **filters) -> DataFrame:
    """Exact unless `oversample` sets a number of sign-code candidates."""
    return _filtered(queries, t["keyframe_embedding"], t, depth, oversample, **filters)


def retrieve_caption(queries: DataFrame, t: dict[str, DataFrame], depth: int = 200, oversample: int | None = None, **filters) -> DataFrame:
    found = _filtered(queries.withColumn("model_id", F.lit(10)), t["caption_embedding"], t, depth, oversample, **filters)
    return expand_to_keyframes(found, t["keyframes"], depth)


def retrieve_transcript(queries: DataFrame, t: dict[str, DataFrame], depth: int = 200, segments: int = 500, exact: bool = True, **filters) -> DataFrame:
    """Shots of the nearest `segments`; exact, or by as many sign-code candidates."""
    q = queries.withColumn("model_id", F.lit(10))
    near = nearest(q, t["transcript_embedding"], "segment_id", segments, None if exact else segments).join(t["transcript_segment"].drop("text"), "segment_id")
    hits = allowed(segment_scenes(near, t["scenes"]), t["videos"], **filters)
    return expand_to_keyframes(first_hit_per_scene(hits, depth), t["keyframes"], depth)


def token_hits(queries: DataFrame, texts: DataFrame, text: str, key: str, phrase: bool = False, floor: float = 0.01, index: TextIndex | None = None) -> DataFrame:
    """(tokens, key, score): OR of each distinct token list, or the adjacent phrase.

    With an index, the postings of the searched tokens are read. Without one, a text gives rows for searched tokens only; phrases
    are found by a positional join in either case.
    """
    lists = queries.select("tokens").distinct()
    if phrase and index:
        n = index.phrases(lists)
    elif phrase:
        words, tokens = looked_up(word_rows(lists))
        places = text_places(texts, text, key, words, tokens)
        n = adjacent(places, words, places.groupBy("token").agg(F.count("*").alias("n")))
    else:
        words, tokens = looked_up(lists.select("tokens", F.explode(F.array_distinct("tokens")).alias("token")))
        if index:
            rows = index.postings(tokens).select("token", "key", "n")
        else:
            found = lexemes(F.col(text))
            found = F.filter(found, lambda x: x.isin(tokens)) if tokens is not None else found
            rows = texts.select(F.col(key).alias("key"), F.explode(found).alias("token"), F.lit(1).alias("n"))
        n = rows.join(words, "token").groupBy("tokens", "key").agg(F.sum("n").alias("n"))
    return n.select("tokens", F.col("key").alias(key), cover_score(F.col("n")).alias("score")).where(F.col("score") >= floor)


#: So many phrases, with so many grams in all, are compared with all texts in one pass.
BLOCK_PHRASES, BLOCK_GRAMS = 4096, 1_000_000
#: A block of up to so many different grams times phrases is a table of as many bytes in a task, a larger one lists.
MOST_GRAMS = 128_000_000
#: The words in so many characters for each gram that a similar text can have tell most larger texts.
HEAD_CHARS = 3


class _Phrases:
    """Phrases in order of their number of grams, to count what a text's grams have in common with each."""

    def __init__(self, rows: list, least: float, most: int) -> None:
        rows = sorted(rows, key=lambda r: len(r["g"]))
        self.least, self.ids, self.sizes = least, np.array([r["id"] for r in rows], dtype=np.int64), np.array([len(r["g"]) for r in rows])
        number: dict[str, int] = {}
        own = np.array([number.setdefault(g, len(number)) for r in rows for g in r["g"]], dtype=np.int64)
        at = np.repeat(np.arange(len(rows)), self.sizes)
        self.grams, self.table = pa.array(list(number), pa.string()), None
        if len(number) * len(rows) <= most:
            self.table = np.zeros((len(number), len(rows)), dtype=np.uint8)
            self.table[own, at] = 1
        else:
            order = np.argsort(own, kind="stable")
            self.lists = np.split(at[order], np.cumsum(np.bincount(own))[:-1])

    def common(self, grams: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """How many of the grams each phrase from lo to hi has."""
        if self.table is None:
            return np.bincount(np.concatenate([self.lists[g] for g in grams]), minlength=len(self.ids))[lo:hi]
        out = np.zeros(hi - lo, dtype=np.int64)
        for i in range(0, len(grams), 255):  # sums of so many ones fit a byte
            out += self.table[grams[i : i + 255], lo:hi].sum(axis=0, dtype=np.uint8)
        return out

    def similar(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """(id, key, both, n) of pairs that can reach the least similarity. batch: key, g"""
        size = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        known = pa.compute.fill_null(pa.compute.index_in(batch.column(1).flatten(), value_set=self.grams), -1).to_numpy(zero_copy_only=False)
        ends, found = np.cumsum(size), []
        for i, n in enumerate(size):
            lo, hi = np.searchsorted(self.sizes, n * self.least), np.searchsorted(self.sizes, n / self.least, "right")
            grams = known[ends[i] - n : ends[i]]
            grams = grams[grams >= 0]
            if lo < hi and len(grams):
                both = self.common(grams, lo, hi)
                at = np.flatnonzero(both >= self.least * (n + self.sizes[lo:hi] - both))
                found.append((at + lo, np.full(len(at), i), both[at]))
        at, row, both = (np.concatenate(x) for x in zip(*found)) if found else (np.array([], dtype=np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(self.ids[at]), batch.column(0).take(pa.array(row)), pa.array(both.astype(np.int32)), pa.array(size[row].astype(np.int32))], names=["id", "key", "both", "n"])


def similar_texts(queries: DataFrame, texts: DataFrame, text: str, key: str, least: float, by: str = "phrase") -> DataFrame:
    """(by, key, score): texts whose trigrams are similar to those of each distinct phrase, or of each `query_id` with its phrase.

    Trigrams are frequent, so pairs that share one are nearly all pairs, and a join on grams is as large. Instead every text is
    compared with a block of phrases where it is read, and only similar pairs leave a task: the work is that of all pairs whose
    sizes are near enough, spread over all tasks. Similar pairs can be as many as all pairs, so they are numbers, and get
    their `by` from a broadcast of the block's: none is moved or written on the way, and no phrase stands in a pair that has
    another `by`. The driver reads one block after the other, and Spark broadcasts each.
    """
    low_bound = least - 1e-6  # scores are rounded
    p = queries.select("phrase").distinct().select("phrase", trigrams(F.col("phrase")).alias("g")).where(F.size("g") > 0)
    p = stored(p.withColumn("m", F.size("g")).withColumn("id", F.monotonically_increasing_id()))
    high, n, grams = p.agg(F.max("m"), F.count("*"), F.sum("m")).first()  # three numbers
    blocks = max(1, -(-n // BLOCK_PHRASES), -(-(grams or 0) // BLOCK_GRAMS))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    own = p.select("id", "phrase", "m")
    own = own if by == "phrase" else stored(queries.select(by, "phrase").join(own, "phrase").select("id", by, "m"))
    few = own.count() <= MOST_SHARED * blocks
    most = int((high or 0) / low_bound) + 1
    # a text has all grams of its first words; the last word of a head can be cut, so it does not count
    head = F.regexp_replace(F.substring(F.col(text), 1, HEAD_CHARS * most), r"[\p{L}\p{N}\p{M}]*$", "")
    near = texts.where(F.col(text).isNotNull()).select(key, text)
    near = near.where(F.size(trigrams(head)) <= most) if most < 500 else near
    near = near.repartition(4 * near.sparkSession.sparkContext.defaultParallelism)  # files can be few, and the comparisons are the work
    # no filter on the grams here: it would be moved to where the texts are read, and cut every text before its head is judged
    sized = near.select(F.col(key).alias("key"), trigrams(F.col(text)).alias("g"))
    sized = sized if blocks == 1 else stored(sized)
    schema = f"id bigint, key {sized.schema['key'].dataType.simpleString()}, both int, n int"

    table = MOST_GRAMS

    def compared(number: int) -> DataFrame:
        phrases = p.where(block == number).select("id", "g").collect()  # bounded by BLOCK_PHRASES and BLOCK_GRAMS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from map(_Phrases(phrases, low_bound, table).similar, batches)

        asked = own.where(block == number)
        return sized.mapInArrow(run, schema).join(F.broadcast(asked) if few else asked, "id")

    both = reduce(DataFrame.unionByName, map(compared, range(blocks)))
    return both.select(by, F.col("key").alias(key), F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 6).alias("score")).where(F.col("score") >= least)


#: Hits and queries meet in lists of about so many of either.
LIST_ROWS = 64


def lexical_hits(queries: DataFrame, texts: DataFrame, text: str, key: str, phrase: bool = False, floor: float = 0.01, index: TextIndex | None = None) -> DataFrame:
    """(query_id, key, score): the hits of each query's tokens.

    Few token lists can have very many queries and hits, whose rows are their product. So hits are dealt over all tasks in short
    lists, and each meets all lists of queries there: what is moved and stored grows with the hits, and a task holds the product
    of two lists. A query's rows of a list stand together, and the next query's repeat them, so a column of the product is runs or a short pattern,
    which files hold in a fraction of a byte per row, however many queries there are. Queries too many for that are joined by a shuffle.
    """
    hits, q = token_hits(queries, texts, text, key, phrase, floor, index), queries.select("query_id", "tokens")
    asking = q.limit(MOST_SHARED + 1).count()
    if asking > MOST_SHARED:
        return hits.join(q, "tokens").select("query_id", key, "score")
    hits, tasks = stored(hits), 8 * hits.sparkSession.sparkContext.defaultParallelism
    n, lists = hits.agg(F.count("*"), F.count_distinct("tokens")).first()  # two numbers
    part = lambda c, rows, least: F.pmod(F.xxhash64(c), F.lit(max(least, rows // (LIST_ROWS * max(1, lists))))).alias("part")
    asked = q.groupBy("tokens", part("query_id", asking, 1)).agg(F.collect_list(F.struct("query_id")).alias("asked")).drop("part")
    dealt = hits.select("*", part(key, n, tasks)).repartition(tasks, "part").groupBy("part", "tokens").agg(F.collect_list(F.struct(key, "score")).alias("hits"))
    # a coalesce, here to as many tasks, ends the code that Spark generates for the join: else a list's rows of all queries are held at once
    met = dealt.join(F.broadcast(asked), "tokens").select("asked", "hits").coalesce(tasks)
    return met.select(F.inline("asked"), "hits").select("query_id", F.inline("hits"))


def best_texts(queries: DataFrame, t: dict, depth: int, phrase: bool = False, floor: float = 0.01, **filters) -> DataFrame:
    """The best `depth` texts of each query; queries with equal tokens and no filters of their own share one ranked list.

    With `keyframe_text_index` in the tables, a search for words reads the postings that can still enter the list.
    """
    shared, index = filters.get("exclude") is None and filters.get("wanted") is None, t.get("keyframe_text_index")
    by = "tokens" if shared else "query_id"
    keep = lambda x: allowed(x.join(t["keyframes"], "keyframe_id"), t["videos"], **filters)
    if index and not phrase:
        words = queries.select(by, F.explode("tokens").alias("token"))
        best = index.top(words, by, depth, lambda x: keep(x.withColumn("keyframe_id", F.col("key"))), floor).drop("key")
    else:
        find = token_hits if shared else lexical_hits
        hits = keep(find(queries, t["keyframe_text"], "ocr_text", "keyframe_id", phrase=phrase, floor=floor, index=index))
        best = top_k(hits, [by], depth, F.col("score").desc(), F.col("keyframe_id"))
    if not shared:
        return best
    most = MOST_SHARED // max(1, depth)  # few lists can have very many queries, and would be few tasks in a shuffle
    few = queries.select("tokens").distinct().limit(most + 1).count() <= most
    return (F.broadcast(best) if few else best).join(queries.select("query_id", "tokens"), "tokens")


def retrieve_ocr(queries: DataFrame, t: dict[str, DataFrame], depth: int = 200, **filters) -> DataFrame:
    """Filters apply before the cut."""
    return best_texts(queries, t, depth, **filters).select("query_id", "rank", "scene_id", "keyframe_id")


def retrieve_ocr_phrase(queries: DataFrame, t: dict[str, DataFrame], depth: int = 200, least: float = 0.45, **filters) -> DataFrame:
    """Phrase matches first; then, up to `depth`, trigram-similar texts of scenes that the phrase did not find.

    Without filters of their own, queries for equal phrases share a search.
    """
    asked = once_by(queries, ["tokens", "phrase"]) if all(filters.get(x) is None for x in ("exclude", "wanted")) else None
    q, kf = asked.first if asked else queries, t["keyframes"]
    exact = best_texts(q, t, depth, phrase=True, floor=0.0, **filters).select("query_id", "scene_id", "keyframe_id", "score", F.lit(0).alias("source"))
    near = similar_texts(q, t["keyframe_text"], "ocr_text", "keyframe_id", least, "query_id")
    near = allowed(near.join(kf, "keyframe_id"), t["videos"], **filters).join(exact.select("query_id", "scene_id").distinct(), ["query_id", "scene_id"], "left_anti")
    both = exact.unionByName(near.select("query_id", "scene_id", "keyframe_id", "score", F.lit(1).alias("source")))
    found = top_k(both, ["query_id"], depth, F.col("source"), F.col("score").desc(), F.col("keyframe_id")).select("query_id", "rank", "scene_id", "keyframe_id")
    return asked.given(found, depth) if asked else found


def best_segment_per_scene(hits: DataFrame, depth: int) -> DataFrame:
    """The best segment of each scene (score, then id), then scenes by score and id."""
    best = top_k(hits, ["query_id", "scene_id"], 1, F.col("score").desc(), F.col("segment_id")).drop("rank")
    return top_k(best, ["query_id"], depth, F.col("score").desc(), F.col("scene_id"))


def retrieve_asr_phrase(queries: DataFrame, t: dict[str, DataFrame], depth: int = 200, **filters) -> DataFrame:
    """Keyframes of the scenes in which a phrase is said; without filters of their own, queries for equal phrases share a search."""
    asked = once_by(queries, ["tokens"]) if all(filters.get(x) is None for x in ("exclude", "wanted")) else None
    hits = lexical_hits(asked.first if asked else queries, t["transcript_segment"], "text", "segment_id", phrase=True, floor=0.0, index=t.get("transcript_segment_index")).join(t["transcript_segment"].drop("text"), "segment_id")
    hits = allowed(segment_scenes(hits, t["scenes"]), t["videos"], **filters)
    found = expand_to_keyframes(best_segment_per_scene(hits, depth), t["keyframes"], depth)
    return asked.given(found, depth) if asked else found


def similar_to_keyframe(sources: DataFrame, t: dict[str, DataFrame], k: int = 24, oversample: int | None = None) -> DataFrame:
    """Neighbours of given keyframes: k + 1 are asked for, the keyframe itself is dropped; score 1 / rank of what was asked."""
    q = sources.select(F.col("keyframe_id").alias("query_id")).join(t["keyframe_embedding"], F.col("query_id") == F.col("keyframe_id")).select("query_id", "model_id", "embedding")
    found = resolve_scenes(nearest(q, t["keyframe_embedding"], "keyframe_id", k + 1, oversample), t["keyframes"], t["videos"], k + 1)
    return found.where("query_id <> keyframe_id").withColumn("score", F.round(1.0 / F.col("rank"), 6))
