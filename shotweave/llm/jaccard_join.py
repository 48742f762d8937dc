"""Exact n-gram Jaccard join in the Jaccard metric space: pivots, Voronoi cells, triangle-inequality windows, recursion.

Texts that share no shingle are all at distance 1 from each other, so blind pivots give no cells. A first step therefore
divides the space into neighbourhoods without losing a link: with shingles in one global order, two linked sets share one
of their first |x| - ceil(s |x|) + 1 shingles. Each shared prefix shingle has one leader (the least document that holds it),
and a document enters the neighbourhoods of its shingles' leaders, so any linked pair meets in one. The order is by hash,
but the most frequent shingles come last, so a passage that many unrelated documents quote does not open neighbourhoods.
Prefixes are n / 20 shingles longer than needed, so a linked pair shares that many more; a document stays out of the
neighbourhoods that hold only a few of its shingles, which shared phrases of unrelated texts produce.

In a neighbourhood, pivots create Voronoi cells: a document is at home in the cell of its nearest pivot. If x at home with p
links to y at home with q, then d(y, p) <= d(y, q) + 2 r, so documents in that window of a border are replicated into the
cell with the lesser number, and every linked pair meets in a cell. Documents linked to a cell's pivot are connected already;
they stay only if their distance to it is within r of a document that is not. A cell is then divided anew, by pivots of its
own, until it is small enough to compare what is not connected yet. Neighbourhoods and cells of more than `block` documents
are dealt over several tasks, each with the pivots, and every level of their recursion is a Spark job; smaller ones recurse
inside a task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotweave.llm.arrays import NONSPACE, Words, find_words, pair_hash, slices, text_chunks, window_hash, window_ok
from shotweave.llm.graph import components, stored
from shotweave.llm.repeats import PACKED, Packer, parts_of, repeated_places

U = np.uint64
QUARTER = U(1 << 62)
#: Pivots of a cell that is dealt over tasks, and the size from which a cell inside a task is divided.
PIVOTS, LEAF = 32, 96
#: Cells that together hold this many times the documents of their parents do not divide them, nor do cells of many levels.
GROWTH, LEVELS = 1.5, 6
#: Keys that can hold a large part of all rows are joined with so many salts.
SALTS = 64


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles, first): one set per text; a text of fewer words is one shingle, without words none."""
    texts = len(w.first) - 1
    ok = window_ok(w.first, size)
    grams = window_hash(w.hash, size)[ok]
    owner = w.owner()[ok]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        whole = [window_hash(w.hash[w.first[i] : w.first[i + 1]], int(w.counts[i]), 77)[:1] for i in short]
        grams, owner = np.concatenate([grams, *whole]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1]))[: len(grams)]
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(texts + 1))


def _least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def frequent_shingles(docs: DataFrame, size: int, least: int, most: int) -> np.ndarray:
    """Shingles of the lower quarter of the hash range that at least `least` documents hold; the `most` heaviest at most.

    Every document is counted. A task folds its counts first; then a shingle is one 64-bit row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                token, count = np.unique(np.concatenate(held), return_counts=True)
                for lo in range(0, len(token), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(token[lo : lo + 65536].view(np.int64)), pa.array(count[lo : lo + 65536].astype(np.int32))], names=["token", "n"])
                held.clear()

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                grams, _ = shingle_sets(find_words(data, offsets, NONSPACE, lower=True), size)
                held.append(grams[grams < QUARTER])
                n += len(held[-1])
                if n > 4_000_000:
                    yield from flush()
                    n = 0
        yield from flush()

    counted = docs.mapInArrow(run, "token bigint, n int").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = counted.orderBy(F.col("n").desc(), "token").limit(most).collect()  # at most `most` rows
    return np.sort(np.array([r.token for r in rows], dtype=np.int64).view(U))


def spare(n: int, part: int = 20) -> int:
    """How many shingles longer than needed a prefix is: n / 20, so linked sets share spare + 1 prefix shingles at least."""
    return n // part


def _prefixes(size: int, percent: int, frequent: np.ndarray, parts: int):
    """Packed (shingle, document) records of the prefixes; a text equal to an earlier one of the task is its twin instead.

    A document's key is its id, its set's size, and for a twin the id of the earlier text, which the record repeats twice;
    big-endian numbers of 8, 4 and 8 bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        pack = Packer(parts, tell_keys=True)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in text_chunks(batch.column(1)):
                grams, first = shingle_sets(find_words(data, offsets, NONSPACE, lower=True), size)
                n = np.diff(first)
                one, two = (np.diff(np.concatenate(([U(0)], np.cumsum(pair_hash(grams, grams, salt))))[first]) for salt in (0, 5))
                keys, doc, token = [], [], []
                for i in np.flatnonzero(n):
                    if len(seen) > 500_000:
                        seen = {}
                    me = int(ids[lo + i])
                    twin = seen.setdefault(b"%d,%d,%d" % (n[i], one[i], two[i]), me)
                    if twin != me:
                        keys.append(struct.pack(">qiq", me, n[i], twin))
                        own = np.full(2, U(me & 0xFFFFFFFFFFFFFFFF))
                    else:
                        keys.append(struct.pack(">qi", me, n[i]))
                        own = grams[first[i] : first[i + 1]]
                        if len(frequent):
                            spot = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                            often = frequent[spot] == own
                            own = np.concatenate([own[~often], own[often]])
                        own = own[: int(n[i]) - int(_least_overlap(n[i], percent)) + 1 + spare(int(n[i]))]
                    token.append(own)
                    doc.append(np.full(len(own), len(keys) - 1))
                if keys:
                    t = np.concatenate(token)
                    zero = np.zeros(len(t), dtype=np.int64)
                    pack.add(keys, np.concatenate(doc), t, zero.view(U), zero, zero)
                if pack.full():
                    yield from pack.flush()
        yield from pack.flush()

    return run


class Links:
    """Union-find over the local indices of one cell; `label` tells what is connected from the start."""

    def __init__(self, label: list):
        at: dict = {}
        self.up = [at.setdefault(x, i) for i, x in enumerate(label)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))])

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def overlaps(grams: np.ndarray, first: np.ndarray, p_grams: np.ndarray, p_first: np.ndarray) -> np.ndarray:
    """|set & pivot| for all sets and pivots, from the pivots' inverted index."""
    p = len(p_first) - 1
    order = np.argsort(p_grams, kind="stable")
    token, who = p_grams[order], np.repeat(np.arange(p), np.diff(p_first))[order]
    lo = np.searchsorted(token, grams)
    n = np.searchsorted(token, grams, side="right") - lo
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    used = np.flatnonzero(n)
    lo, n, row = lo[used], n[used], row[used]
    index = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    return np.bincount(np.repeat(row, n) * p + who[index], minlength=(len(first) - 1) * p).reshape(-1, p)


def take(grams: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen sets of a ragged array."""
    return grams[slices(first, rows)], np.concatenate(([0], np.cumsum(first[rows + 1] - first[rows])))


def measure(grams: np.ndarray, first: np.ndarray, pivots: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, linked) of all sets to all pivots."""
    both = overlaps(grams, first, *pivots)
    union = np.maximum(np.diff(first)[:, None] + np.diff(pivots[1])[None, :] - both, 1)
    return 1 - both / union, (100 * both >= percent * union) & (both > 0)


def seats_of(d: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(set, cell): each set's own Voronoi cell, and the lesser cells in whose window it stands."""
    home = d.argmin(axis=1)
    window = d <= d.min(axis=1)[:, None] + 2 * radius
    return np.nonzero(window & (np.arange(d.shape[1])[None, :] <= home[:, None]))


def all_overlaps(grams: np.ndarray, first: np.ndarray, width: int = 4096) -> np.ndarray:
    """|x & y| for all pairs of sets, by products of their incidence matrix, `width` shared shingles at a time."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    _, column, held = np.unique(grams, return_inverse=True, return_counts=True)
    shared = held[column] > 1
    row, column = row[shared], (np.cumsum(held > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((n, n), dtype=np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        block = np.zeros((n, int(column[b - 1]) - lo + 1), dtype=np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        total += block @ block.T
    return total.astype(np.int64)


def compare(grams: np.ndarray, first: np.ndarray, percent: int, links: Links, names: np.ndarray) -> list[tuple[int, int]]:
    """Links between all sets that are not connected yet."""
    size = np.diff(first)
    both = all_overlaps(grams, first)
    linked = np.triu((100 * both >= percent * (size[:, None] + size[None, :] - both)) & (both > 0), 1)
    return [(int(names[i]), int(names[j])) for i, j in zip(*np.nonzero(linked), strict=True) if links.join(int(names[i]), int(names[j]))]


def join_cell(grams: np.ndarray, first: np.ndarray, percent: int, links: Links, names: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked in a cell, by Voronoi cells of its own; the first set is the first pivot."""
    n, radius = len(first) - 1, (100 - percent) / 100 + 1e-9
    names = np.arange(n) if names is None else names
    if n <= LEAF:
        return compare(grams, first, percent, links, names)
    chosen = np.unique(np.linspace(0, n - 1, min(PIVOTS, int(n**0.5) + 1)).astype(np.int64))
    d, linked = measure(grams, first, take(grams, first, chosen), percent)
    edges = [(int(names[chosen[p]]), int(names[i])) for i, p in zip(*np.nonzero(linked), strict=True) if links.join(int(names[chosen[p]]), int(names[i]))]
    row, cell = seats_of(d, radius)
    root = links.roots()
    for k in range(len(chosen)):
        mine = row[cell == k]
        far = root[names[mine]] != root[names[chosen[k]]]
        if not far.any():
            continue
        mine = mine[far | (d[mine, k] >= d[mine[far], k].min() - radius)]
        if len(mine) > 0.7 * n:
            edges += compare(*take(grams, first, mine), percent, links, names[mine])
        elif len(mine) > 1:
            edges += join_cell(*take(grams, first, mine), percent, links, names[mine])
    return edges


SEATS = "a bigint, b bigint, doc bigint, parent bigint, grams binary, seats array<struct<cell:bigint,d:double>>"
SEAT = pa.list_(pa.struct([("cell", pa.int64()), ("d", pa.float64())]))


def _batch(edges: list[tuple[int, int]], docs: list[tuple[int, int, bytes, list[dict]]]) -> pa.RecordBatch:
    n, m = len(edges), len(docs)
    a, b = zip(*edges, strict=True) if n else ((), ())
    doc, parent, grams, seats = zip(*docs, strict=True) if m else ((), (), (), ())
    columns = [pa.array([*a, *[None] * m], pa.int64()), pa.array([*b, *[None] * m], pa.int64()), pa.array([*[None] * n, *doc], pa.int64()), pa.array([*[None] * n, *parent], pa.int64()), pa.array([*[None] * n, *grams], pa.binary()), pa.array([*[None] * n, *seats], SEAT)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "doc", "parent", "grams", "seats"])


def _cells(percent: int):
    """Joins whole cells, and measures slots of dealt ones against their pivots; rows arrive sorted by (cell, slot, role).

    A dealt cell's documents come back with their sets and the next cells in which they have a seat. A cell is named by a
    hash of its parent and its pivot, so slots name alike.
    """
    radius = (100 - percent) / 100 + 1e-9

    def close(rows: list[tuple]) -> tuple[list, list]:
        ids = [r[3] for r in rows]
        sets = [np.frombuffer(r[5], dtype="<u8") for r in rows]
        first = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
        grams = np.concatenate(sets)
        if rows[0][6] <= 1:
            edges = join_cell(grams, first, percent, Links([r[4] for r in rows]))
            return [(ids[i], ids[j]) for i, j in edges], []
        p = sum(r[2] == 0 for r in rows)  # pivots first
        pivots = take(grams, first, np.arange(p))
        mine = np.arange(p, len(rows))
        d, linked = measure(*take(grams, first, mine), pivots, percent)
        edges = [(ids[k], ids[p + i]) for i, k in zip(*np.nonzero(linked), strict=True) if ids[k] != ids[p + i]]
        name = pair_hash(np.full(p, rows[0][0], dtype=np.int64).view(U), np.array(ids[:p], dtype=np.int64).view(U), 3).view(np.int64)
        row, cell = seats_of(d, radius)
        bounds = np.searchsorted(row, np.arange(len(mine) + 1))
        out = [(ids[p + i], rows[0][0], rows[p + i][5], [{"cell": int(name[k]), "d": float(d[i, k])} for k in cell[bounds[i] : bounds[i + 1]]]) for i in range(len(mine))]
        return edges, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            edges, docs = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    e, o = close(held)
                    edges, docs, held = edges + e, docs + o, []
                held.append(row)
            yield _batch(edges, docs)
        if held:
            yield _batch(*close(held))

    return run


def join_by_hot_key(rows: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Joins a table with one row per key; a key's rows are dealt over `SALTS` values, so none is bound to one task."""
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"], how).drop("salt")


def dealt(rows: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """(cell, slot, role, doc, ...) of documents with their cells: role 0 for a pivot, once per slot, and 1 for a document.

    `sizes` holds (cell, n) of the cells with more than `block` documents; all others have one slot and no pivots. About
    `PIVOTS` documents of a large cell are its pivots, chosen by a hash.
    """
    large = sizes.withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int")).withColumn("every", F.ceil(F.col("n") / F.lit(PIVOTS)))
    own = join_by_hot_key(rows, large, "cell", "doc", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    chosen = (F.col("blocks") > 1) & ((F.pmod(F.xxhash64("doc", "cell"), F.col("every")) == 0) | (F.col("doc") == F.col("cell")))
    here = F.array(F.struct(F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("slot"), F.lit(1).alias("role")))
    also = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("slot"), F.lit(0).alias("role")))
    return own.withColumn("at", F.explode(F.when(chosen, F.concat(also, here)).otherwise(here))).drop("every", "n").withColumns({"slot": F.col("at.slot"), "role": F.col("at.role")}).drop("at")


def in_cells(rows: DataFrame, percent: int) -> DataFrame:
    ordered = rows.select("cell", "slot", "role", "doc", "label", "grams", "blocks").repartition("cell", "slot").sortWithinPartitions("cell", "slot", "role", F.col("doc") != F.col("cell"), "doc")
    return ordered.mapInArrow(_cells(percent), SEATS)


def next_cells(spark: SparkSession, measured: DataFrame, edges: DataFrame, percent: int, level: int) -> tuple[DataFrame, bool] | None:
    """((cell, doc, label, grams), divided): who still has to meet in the cells of dealt ones; None if nobody has.

    A document's label is the least one that links reach so far. Where all of a cell have one label nothing is left to do.
    Otherwise those without the label of the cell's pivot stay, and those within the radius of them. If the windows hold so
    many that the cells do not divide their parents, the parents are returned, not divided.
    """
    radius = (100 - percent) / 100 + 1e-9
    seats = measured.where("doc is not null")
    docs = seats.count()
    if not docs:
        return None
    label = components(spark, edges).select(F.col("node").alias("doc"), F.col("component").alias("label"))
    told = stored(seats.select("doc", "parent", "seats").join(label, "doc", "left").withColumn("label", F.coalesce("label", "doc")))
    places = told.select("doc", "label", F.explode("seats").alias("s")).select("doc", "label", "s.cell", "s.d")
    cells = places.groupBy("cell").agg(F.min_by("label", F.struct("d", "label")).alias("own"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("cell", "own")
    open_ = join_by_hot_key(places, cells, "cell", "doc")
    least = open_.where("label <> own").groupBy("cell").agg(F.min("d").alias("least"))
    stay = join_by_hot_key(open_, least, "cell", "doc").where((F.col("label") != F.col("own")) | (F.col("d") >= F.col("least") - radius))
    stay = stored(stay.groupBy("doc").agg(F.first("label").alias("label"), F.collect_set("cell").alias("cells")))
    total = stay.agg(F.sum(F.size("cells"))).first()[0] or 0
    if not total:
        return None
    if total > GROWTH * docs or level == LEVELS:
        mixed = told.groupBy("parent").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("parent")
        whole = join_by_hot_key(told.select("doc", "label", "parent"), mixed, "parent", "doc").select("doc", "parent", "label")
        return stored(seats.select("doc", "parent", "grams").join(whole, ["doc", "parent"]).select(F.col("parent").alias("cell"), "doc", "label", "grams")), False
    # a document of several parents is stored once in each; one copy of its set is enough
    sets = seats.select("doc", "grams").join(stay, "doc").dropDuplicates(["doc"])
    return stored(sets.select(F.explode("cells").alias("cell"), "doc", "label", "grams")), True


def between_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Cells that pivots do not divide, as pairs of blocks.

    Documents of a cell's most frequent label are connected to each other. All others, in blocks of half the size, meet all
    documents of the cell, in such blocks too.
    """
    half = max(1, block // 2)
    often = rows.groupBy("cell", "label").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max_by("label", F.struct("n", "label")).alias("own"), F.sum("n").alias("n"), F.max("n").alias("most"))
    blocks = often.select("cell", "own", F.ceil(F.col("n") / half).cast("int").alias("k"), F.ceil((F.col("n") - F.col("most")) / half).cast("int").alias("k_open"))
    placed = join_by_hot_key(rows, blocks, "cell", "doc").withColumn("h", F.xxhash64("doc", F.lit(7)))
    one = F.pmod("h", F.col("k_open")).cast("int")
    every = F.pmod("h", F.col("k")).cast("int")
    slot = lambda i, j: (i * F.col("k") + j).cast("int")
    as_one = F.when(F.col("label") != F.col("own"), F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: slot(one, j))).otherwise(F.array().cast("array<int>"))
    as_any = F.transform(F.sequence(F.lit(0), F.col("k_open") - 1), lambda i: slot(i, every))
    met = placed.withColumn("slot", F.explode(F.array_distinct(F.concat(as_one, as_any))))
    return met.select("cell", "slot", F.lit(1).alias("role"), "doc", "label", "grams", F.lit(1).alias("blocks"))


def _with_sets(size: int):
    """Replaces the text by the packed shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.schema.get_field_index("t")
            cells: list[bytes] = []
            for _, _, data, offsets in text_chunks(batch.column(keep)):
                grams, first = shingle_sets(find_words(data, offsets, NONSPACE, lower=True), size)
                cells += [grams[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            columns = list(batch.columns)
            columns[keep] = pa.array(cells, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:keep], "grams", *batch.schema.names[keep + 1 :]])

    return run


def jaccard_links(spark: SparkSession, docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text", block: int = 512, frequent_least: int = 24, frequent_most: int = 200_000) -> DataFrame:
    """(a, b): links that connect exactly the documents that J(x, y) >= percent / 100 connects.

    Every returned pair is itself linked or has equal sets; links inside a connected group that others imply are left out.
    Ids must be whole numbers or their texts. Rows with a null id, and texts without words, link with nothing. Rows that
    share an id are one node with the links of all of them. Very long texts are taken whole; other columns are not read.
    """
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("t")).where("doc is not null and t is not null")
    member, twins = neighbourhoods(spark, base, size, percent, frequent_least, frequent_most)
    met = member.where("cell <> doc").groupBy("cell").agg((F.count("*") + 1).alias("n"))  # without others a leader meets nobody
    leaders = met.select("cell", F.col("cell").alias("doc"))
    rows = dealt(member.where("cell <> doc").unionByName(leaders), met.where(F.col("n") > block), block)
    # the texts of members, each shuffled once with the list of its seats (no longer than its prefix, or the blocks of a pivot)
    by_doc = rows.groupBy("doc").agg(F.collect_list(F.struct("cell", "slot", "role", "blocks")).alias("s"))
    sets = base.join(by_doc, "doc").mapInArrow(_with_sets(size), "doc bigint, grams binary, s array<struct<cell:bigint,slot:int,role:int,blocks:int>>")
    level = sets.select(F.explode("s").alias("s"), "doc", F.col("doc").alias("label"), "grams").select("s.*", "doc", "label", "grams")
    found = twins
    for depth in range(1, LEVELS + 2):
        measured = stored(in_cells(level, percent))
        found = found.unionByName(measured.where("a is not null").select("a", "b"))
        left = next_cells(spark, measured, found, percent, depth)
        if left is None:
            return found
        rows, divided = left
        sizes = rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block)
        level = dealt(rows, sizes, block) if divided else between_blocks(rows, block)
    raise RuntimeError("cells did not close")


def neighbourhoods(spark: SparkSession, base: DataFrame, size: int, percent: int, frequent_least: int, frequent_most: int) -> tuple[DataFrame, DataFrame]:
    """(cell, doc): the leaders in whose neighbourhoods each document stands; (a, b): equal sets that a task saw."""
    frequent = frequent_shingles(base.select("t"), size, frequent_least, frequent_most)
    parts = parts_of(spark, base.select("t"))
    packed = base.mapInArrow(_prefixes(size, percent, frequent, parts), PACKED)
    number = lambda at, size: F.conv(F.hex(F.substring("doc_key", at, size)), 16, -10).cast("bigint")
    twin = F.when(F.octet_length("doc_key") > 12, number(13, 8))
    told = stored(repeated_places(packed, parts, tell_keys=True).select(number(1, 8).alias("doc"), number(9, 4).alias("n"), twin.alias("twin"), "keys"))
    twins = told.where("twin is not null").select(F.col("doc").alias("a"), F.col("twin").alias("b"))
    tokens = told.where("twin is null").select("doc", "n", F.explode(F.array_distinct("keys")).alias("token"))
    leaders = tokens.groupBy("token").agg(F.min("doc").alias("cell"), F.max("doc").alias("last")).where("last > cell").select("token", "cell")
    shared = tokens.join(leaders, "token").groupBy("doc", "n", "cell").agg(F.count("*").alias("k"))
    # A linked pair shares spare + 1 prefix shingles. A document leaves its weakest neighbourhoods while they hold spare / 2
    # shingles of it at most: both ends together can't leave all in which they would meet. Its own costs nothing.
    weakest = Window.partitionBy("doc").orderBy("own", "k", "cell")
    left = F.sum(F.when(F.col("own") == 0, F.col("k")).otherwise(0)).over(weakest)
    ranked = shared.withColumn("own", (F.col("doc") == F.col("cell")).cast("int")).withColumn("left", left)
    return stored(ranked.where((F.col("own") == 1) | (F.col("left") > F.floor(F.floor(F.col("n") / 20) / 2))).select("cell", "doc")), twins


def shingle_counts(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: list[np.ndarray] = []
            for _, _, data, offsets in text_chunks(batch.column(1)):
                n.append(np.diff(shingle_sets(find_words(data, offsets, NONSPACE, lower=True), size)[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n) if n else np.zeros(0, dtype=np.int64), pa.int64())], names=["doc_id", "n_shingles"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id bigint, n_shingles bigint")


def jaccard_components(spark: SparkSession, docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: the least id that links reach, itself included; null for a null id."""
    groups = components(spark, jaccard_links(spark, docs, size, percent, doc_id, text)).select(F.col("node").alias("doc_id"), "component")
    return shingle_counts(docs, size, doc_id, text).join(groups, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def row_key(doc_id: Column, text: Column) -> Column:
    """What names a row in links: a 64-bit hash of id and text. Rows that agree in both have one name."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), doc_id.isNull(), text)


def keep_one(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without those whose text is, or links through others to, that of a row that stays.

    A row is judged by its id and text together, so rows that share an id are told apart, and so are rows with a null id.
    One row of each group of linked texts stays (the one with the least hash of id and text), and one of rows that agree in
    id and text, told by two hashes: rows whose names clash have each other's links, but are no repeats of each other. Null
    texts and such without words link with nothing. Long texts are taken whole; other columns may have any name.
    """
    key, check = "row_key", "row_check"
    while {key, check} & {c.lower() for c in docs.columns}:
        key, check = key + "_", check + "_"
    i, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    own = docs.withColumns({key: row_key(i, t), check: F.xxhash64(F.lit("check"), i.cast("string"), i.isNull(), t)})
    groups = components(spark, jaccard_links(spark, own, size, percent, key, text)).where("node <> component").select(F.col("node").alias(key))
    return own.join(groups, key, "left_anti").dropDuplicates([key, check]).select(*[F.col(f"`{c}`") for c in docs.columns])
