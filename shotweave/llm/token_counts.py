"""Token counts by rank-synchronous merging of ragged symbol arrays.

Every task normalises and splits its texts into pre-tokens, then counts the symbols of the distinct new pre-tokens of a
batch at once: all of them sit in one flat array of symbol ids with offsets, and in each round every sequence merges all
places of its own lowest-ranked pair. A pre-token's count is the number of symbols that survive. Pre-tokens of thousands of
bytes would make every round long; theirs keep their places by rank, so a round touches only the places that it merges.
There is no shuffle; the work is linear in the text.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_PAIR = np.int64(1 << 60)
LONG = 4096  # bytes from which a pre-token is merged by places
# Lower-case letters that the vocabulary's library knows and Python's tables do not.
NEWER_LOWER = {0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 32 for c in range(0x10D50, 0x10D66)}
# Characters that the pattern module takes for letters and the vocabulary's library for symbols, and a symbol.
ODD, PLAIN = [hi << 12 | lo for hi in (0x32, 0x3D, 0x3E, 0x3F) for lo in (0x808, 0x85C, 0x988)], 0x50000
IS_ODD, STAND_IN = re.compile(f"[{''.join(map(chr, ODD))}]"), dict.fromkeys(ODD, PLAIN)
IS_NEWER = re.compile(f"[{''.join(map(chr, NEWER_LOWER))}]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies (a fixed public rule)."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class MergeTable:
    """Base symbols, merge ranks, split pattern and special strings of a word-end BPE vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        marks = byte_symbols()
        self.inner = np.array([vocab.get(m, -1) for m in marks], dtype=np.int64)
        self.last = np.array([vocab.get(m + suffix, -1) for m in marks], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in model["merges"]], dtype=np.int64)
        right = np.array([vocab[b] for _, b in model["merges"]], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], dtype=np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.hints = tuple(special)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NO_PAIR without one), and the symbol that it makes."""
        key = left << 32 | right
        spot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        known = self.key[spot] == key
        rank = self.rank[spot]
        rank[~known] = NO_PAIR
        return rank, self.made[spot]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a normalised text."""
        if text.isascii() or not IS_ODD.search(text):
            return self.split.findall(text)
        return [text[m.start() : m.end()] for m in self.split.finditer(text.translate(STAND_IN))]

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        total = np.zeros(len(words), dtype=np.int64)
        short = np.flatnonzero(size < LONG)
        total[short] = self._count_short([words[i] for i in short])
        for i in np.flatnonzero(size >= LONG):
            total[i] = self._count_long(words[i])
        return total

    def _count_long(self, word: bytes) -> int:
        """One long sequence: its places wait under their pair's rank; a round takes the lowest rank's, and only their
        neighbours get new pairs."""
        flat = np.frombuffer(word, dtype=np.uint8)
        ids = self.inner[flat]
        ids[-1] = self.last[flat[-1]]
        ids = ids[ids >= 0]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # of the symbols that live; n and -1 are outside
        live, left = np.ones(n, dtype=bool), n
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[(places >= 0) & (after[places] < n)]
            rank, _ = self.lookup(ids[places], ids[after[places]])
            places, rank = places[rank != NO_PAIR], rank[rank != NO_PAIR]
            order = np.argsort(rank, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(rank[order])) + 1) if len(order) else ():
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(places[part])

        wait(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[live[at]]
            at = at[after[at] < n]
            rank, made = self.lookup(ids[at], ids[after[at]])
            at, made = at[rank == r], made[rank == r]  # others have changed since
            if not len(at):
                continue
            fresh = np.append(True, after[at[:-1]] != at[1:])  # in a run such as a a a, every second place merges
            place = np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            at, made = at[place % 2 == 0], made[place % 2 == 0]
            gone = after[at]
            ids[at] = made
            live[gone] = False
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at[inside]]] = at[inside]
            left -= len(at)
            wait(np.unique(np.concatenate([at, before[at]])))
        return left

    def _count_short(self, words: list[bytes]) -> np.ndarray:
        """All sequences at once; all of a round's merges happen together."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids = self.inner[flat]
        end = np.cumsum(size) - 1
        ids[end[size > 0]] = self.last[flat[end[size > 0]]]
        owner = np.repeat(np.arange(len(words)), size)
        owner, ids = owner[ids >= 0], ids[ids >= 0]  # bytes outside the vocabulary have no symbol
        total = np.zeros(len(words), dtype=np.int64)
        while len(ids):
            at = np.full(len(ids), NO_PAIR)
            new = np.zeros(len(ids), dtype=np.int64)
            rank, made = self.lookup(ids[:-1], ids[1:])
            known = (rank != NO_PAIR) & (owner[:-1] == owner[1:])
            at[:-1][known] = rank[known]
            new[:-1][known] = made[known]
            head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(at, head)
            count = np.diff(np.append(head, len(ids)))
            done = best == NO_PAIR
            total[owner[head[done]]] = count[done]
            merge = (at == np.repeat(best, count)) & (at != NO_PAIR)
            where = np.flatnonzero(merge)
            if len(where):  # in a run such as a a a, every second place merges, from the left
                fresh = np.append(True, np.diff(where) != 1)
                run = np.arange(len(where)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                where = where[run % 2 == 0]
            ids[where] = new[where]
            keep = np.repeat(~done, count)
            keep[where + 1] = False
            ids, owner = ids[keep], owner[keep]
        return total


class Counter:
    """Counts whole texts; remembers the counts of the pre-tokens seen last, up to a bound."""

    def __init__(self, table: MergeTable, remember: int = 400_000):
        self.table, self.remember, self.seen = table, remember, {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        extra = 0
        parts = [text]
        if any(h in text for h in self.table.hints):
            parts = self.table.special.split(text)
            extra = len(parts) - 1
        found: list[str] = []
        for part in parts:
            if not part.isascii():
                # no final-sigma rule: letters fold one by one
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                if IS_NEWER.search(part):
                    part = part.translate(NEWER_LOWER)
            found += self.table.pieces(part.lower())
        return found, extra

    def count(self, texts: list[str | None]) -> list[int]:
        out, group, held = [], [], 0
        for i, text in enumerate(texts):
            group.append(self.pieces(text or ""))
            held += len(group[-1][0])
            if held > 300_000 or i == len(texts) - 1:
                out += self._settle(group)
                group, held = [], 0
        return out

    def _settle(self, group: list[tuple[list[str], int]]) -> list[int]:
        if len(self.seen) > self.remember:
            self.seen = {}
        new = list({w for words, _ in group for w in words}.difference(self.seen))
        if new:
            self.seen.update(zip(new, self.table.count([w.encode("utf-8", "surrogatepass") for w in new]).tolist(), strict=True))
        get = self.seen.__getitem__
        return [sum(map(get, words)) + extra for words, extra in group]


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit) to each row of `df`; `text` itself is dropped.

    Null and empty texts count 0 bytes and 0 tokens. Special strings of the vocabulary inside a text count as one token
    each, as the vocabulary's library does by default. Rows are neither merged nor dropped; other columns pass through,
    except such as carry one of the three names, which are replaced. Very long texts and pre-tokens are counted whole; memory
    follows the longest text. `tokenizer_path` must be readable on executors.
    """
    rest = [c for c in df.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    base = df.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"), F.col(f"`{text}`").alias(text))
    schema = T.StructType([*base.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(MergeTable(tokenizer_path))
            counts = counter.count(batch.column(len(rest) + 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return base.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
