"""Which 64-bit-pair keys occur at more than one place: a grouped job that no hot key can overload.

Tasks hand over arrays of (key, place) packed into a few binary cells, one per key range and task, instead of a row per
key. Keys that a task already sees twice are known to repeat: their places pass straight through (dealt evenly), and only
one mark per task and key goes to the key's own range. A key's range therefore gets at most one record per task for it,
however often the key occurs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
RECORD = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i4"), ("at", "<i4"), ("to", "<i4")])
PACKED = "part int, known boolean, docs binary, records binary"


#: Bytes of text whose records make a key range: what one group of a task holds does not grow with the input.
RANGE_BYTES = 32 << 20


def parts_of(spark: SparkSession, texts: DataFrame) -> int:
    """Key ranges by the bytes of the one text column of `texts`; twice the shuffle partitions at least, so that hashing
    them to tasks comes out even."""
    size = texts.agg(F.sum(F.octet_length(F.col(texts.columns[0])))).first()[0] or 0
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))


class Packer:
    """Collects the records of a task and turns them into packed rows, at most `limit` records at a time."""

    def __init__(self, parts: int, limit: int = 1_500_000, tell_keys: bool = False):
        self.parts, self.limit, self.tell_keys = parts, limit, tell_keys
        self.keys: list[bytes] = []
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: list[bytes], doc: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
        rows = np.empty(len(a), dtype=RECORD)
        rows["a"], rows["b"], rows["doc"], rows["at"], rows["to"] = a, b, doc + len(self.keys), at, to
        self.keys += keys
        self.held.append(rows)
        self.size += len(rows)

    def full(self) -> bool:
        return self.size >= self.limit

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            self.keys, self.held = [], []
            return
        rows = np.concatenate(self.held)
        order = np.lexsort((rows["b"], rows["a"]))
        rows = rows[order]
        new = np.append(True, (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1]))
        count = np.diff(np.append(np.flatnonzero(new), len(rows)))
        twice = np.repeat(count > 1, count)
        marks = rows[new & twice].copy()
        marks["doc"] = -1  # a key that repeats here; its places are told already
        ask = np.concatenate([rows[~twice], marks])
        yield from self._pack(ask, (ask["a"] >> U(20)) % U(self.parts), False)
        told = rows[twice]
        spread = (told["doc"].astype(np.uint64) * U(2654435761) + U(int(rows["a"][0]) & 0xFFFF)) % U(self.parts)
        yield from self._pack(told, spread, True)
        self.keys, self.held, self.size = [], [], 0

    def _pack(self, rows: np.ndarray, part: np.ndarray, known: bool) -> Iterator[pa.RecordBatch]:
        if len(rows):
            yield _packed(rows, part, self.keys, ("a",) if known and self.tell_keys else () if known else ("a", "b"), known)


def _packed(rows: np.ndarray, part: np.ndarray, keys: list[bytes], longs: tuple[str, ...], known: bool) -> pa.RecordBatch:
    """One row per part: its documents' keys, and its records column by column, as small differences that compress."""
    order = np.lexsort((rows["at"], rows["doc"], part))
    rows, part = rows[order], part[order]
    bounds = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(rows))
    ids, docs, cells = [], [], []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        own = rows[lo:hi].copy()
        used, local = np.unique(own["doc"], return_inverse=True)
        shift = int(used[0] == -1)
        own["doc"] = local - shift
        names = [keys[i] for i in used[shift:]]
        ids.append(int(part[lo]))
        docs.append(np.array([len(x) for x in names], dtype="<i4").tobytes() + b"".join(names))
        steps = (np.diff(own["doc"], prepend=np.int32(0)), np.diff(own["at"], prepend=np.int32(0)), own["to"] - own["at"])
        cells.append(b"".join(np.ascontiguousarray(c).tobytes() for c in (*(own[c] for c in longs), *steps)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([known] * len(ids)), pa.array(docs, pa.binary()), pa.array(cells, pa.binary())], names=["part", "known", "docs", "records"])


def _names(cell: bytes, n: int) -> list[bytes]:
    size = np.frombuffer(cell, dtype="<i4", count=n)
    end = 4 * n + np.cumsum(size)
    return [cell[e - s : e] for s, e in zip(size.tolist(), end.tolist(), strict=True)]


def _columns(cell: bytes, kinds: str) -> list[np.ndarray]:
    width = {"q": 8, "i": 4}
    n = len(cell) // sum(width[k] for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(cell, dtype="<u8" if k == "q" else "<i4", count=n, offset=at))
        at += n * width[k]
    doc, place, span = out[-3:]
    place = np.cumsum(place, dtype=np.int32)
    return [*out[:-3], np.cumsum(doc, dtype=np.int32), place, place + span]


def _read(table: pa.Table, kinds: dict[bool, str]) -> tuple[list[bytes], dict[bool, list[np.ndarray]]]:
    """All records of a table's cells, by `known`, with documents numbered through, and the documents' keys."""
    names: list[bytes] = []
    found: dict[bool, list[list[np.ndarray]]] = {k: [] for k in kinds}
    for known, docs, cell in zip(table["known"].to_pylist(), table["docs"].to_pylist(), table["records"].to_pylist(), strict=True):
        cols = _columns(cell, kinds[known])
        doc = cols[-3]
        n = int(doc.max()) + 1 if len(doc) else 0
        cols[-3] = np.where(doc >= 0, doc + len(names), -1)
        names += _names(docs, n)
        found[known].append(cols)
    return names, {k: [np.concatenate(c) for c in zip(*v, strict=True)] for k, v in found.items()}


def _settle(parts: int, tell_keys: bool):
    """The places of one key range whose keys occur more than once, packed anew by document."""
    lead = "q" * tell_keys

    def run(table: pa.Table) -> pa.Table:
        names, found = _read(table, {True: lead + "iii", False: "qqiii"})
        out = [found[True]] if found[True] else []
        if found[False]:
            a, b, doc, at, to = found[False]
            order = np.lexsort((b, a))
            new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
            count = np.diff(np.append(np.flatnonzero(new), len(a)))
            group = np.repeat(np.arange(len(count)), count)
            marked = np.bincount(group, weights=doc[order] < 0, minlength=len(count)) > 0
            keep = order[((count > 1) | marked)[group] & (doc[order] >= 0)]
            out.append([a[keep]] * tell_keys + [doc[keep], at[keep], to[keep]])
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        rows = np.zeros(len(columns[-1]) if columns else 0, dtype=RECORD)
        if not len(rows):
            return table.slice(0, 0)
        for name, c in zip([*("a",) * tell_keys, "doc", "at", "to"], columns, strict=True):
            rows[name] = c
        home = np.array([zlib.crc32(x) % max(1, parts // 2) for x in names])
        return pa.Table.from_batches([_packed(rows, home[rows["doc"]], names, ("a",) * tell_keys, True)])

    return run


def _gather(tell_keys: bool):
    """One row per document: what all key ranges told of it."""
    value = pa.int64() if tell_keys else pa.int32()

    def run(table: pa.Table) -> pa.Table:
        names, found = _read(table, {True: "q" * tell_keys + "iii"})
        *keys, doc, at, to = found[True]
        ids: dict[bytes, int] = {}
        number = np.array([ids.setdefault(x, len(ids)) for x in names])
        doc = number[doc]
        order = np.lexsort((at, doc))
        bounds = np.append(np.flatnonzero(np.append(True, doc[order][1:] != doc[order][:-1])), len(doc)).astype(np.int32)
        told = [keys[0].view(np.int64)] if tell_keys else [at, to]
        lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x[order], value)) for x in told]
        unique = list(ids)
        return pa.table([pa.array([unique[i] for i in doc[order][bounds[:-1]]], pa.binary()), *lists], names=["doc_key", *(["keys"] if tell_keys else ["at", "to"])])

    return run


def repeated_places(packed: DataFrame, parts: int, tell_keys: bool = False) -> DataFrame:
    """Per document the places of its records whose (a, b) key occurs more than once among all packed records.

    (doc_key, at[], to[]), or (doc_key, keys[]) with `tell_keys`. Bounded by the document's own records.
    """
    found = packed.groupBy("part").applyInArrow(_settle(parts, tell_keys), PACKED)
    return found.groupBy("part").applyInArrow(_gather(tell_keys), "doc_key binary, " + ("keys array<bigint>" if tell_keys else "at array<int>, to array<int>"))
