"""License scans: ordered signature rules behind a keyword prefilter, with priority and containment suppression.

A text becomes its lower-case words joined by single blanks, so a rule is a pattern over words (`license_rules`). A rule
runs only where its keyword occurs. Where one detection's interval contains another's, the one of better priority stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.llm.arrays import ALNUM, find_words, text_chunks
from shotweave.llm.license_rules import BASE, Rule, rules

Found = tuple[int, int, Rule]


def suppress(found: list[Found]) -> list[Found]:
    """The detections that stay, by place.

    In order of priority, then length, then place, a detection is dropped if its interval lies inside that of a kept one or
    holds one inside. So the better rule wins both ways, whichever is longer; detections that only overlap both stay.
    """
    starts: list[int] = []  # of kept detections; none holds another, so their ends are in the same order
    ends: list[int] = []
    kept: list[Found] = []
    for f in sorted(found, key=lambda f: (f[2].priority, f[0] - f[1], f[0])):
        left, right = bisect_right(starts, f[0]) - 1, bisect_left(starts, f[0])
        inside = left >= 0 and ends[left] >= f[1]
        around = right < len(starts) and ends[right] <= f[1]
        if not inside and not around:
            starts.insert(left + 1, f[0])
            ends.insert(left + 1, f[1])
            kept.append(f)
    return sorted(kept, key=lambda f: (f[0], -f[1], f[2].priority))


class Scanner:
    """The compiled rules, grouped by keyword: built once per task."""

    def __init__(self) -> None:
        self.by_keyword: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        for rule in rules():
            self.by_keyword.setdefault(rule.keyword, []).append((rule, re.compile(rule.pattern)))
        # a keyword's longest word is looked for first, among the fingerprints of a text's words
        anchors = sorted({max(k.split(), key=len) for k in {*self.by_keyword, *BASE}})
        data = np.frombuffer(" ".join(anchors).encode(), dtype=np.uint8)
        self.anchors = np.sort(find_words(data, np.array([0, len(data)]), ALNUM, lower=True).hash)
        self.base = {label: re.compile(rf"(?<![^ ])(?={re.escape(phrase)}(?![^ ]))") for phrase, label in BASE.items()}

    def detections(self, words: str) -> list[Found]:
        """(start, end, rule) by place, after suppression."""
        found: list[Found] = []
        padded = f" {words} "
        for keyword, group in self.by_keyword.items():
            if f" {keyword} " in padded:
                for rule, p in group:
                    found += [(*m.span(m.lastindex or 0), rule) for m in p.finditer(words)]
        return suppress(found)

    def scan(self, words: str) -> tuple[list[tuple[str, int]], list[tuple[int, int, Rule]]]:
        """Base hits as (label, start word), and the method's detections."""
        places = sorted((m.start(), label) for label, p in self.base.items() for m in p.finditer(words))
        base, at, word = [], 0, 0
        for start, label in places:
            word += words.count(" ", at, start)
            at = start
            base.append((label, word))
        return base, self.detections(words)


@cache
def scanner() -> Scanner:
    return Scanner()


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<label:string,start:int,end:int>>"


def scan_licenses(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the kept detections.

    Detections give character places in the normalised words. The score is 1 - product of (1 - weight / 2) over the labels
    found, 0 without any. Null and empty texts have no words and no labels; repeated rows are scanned as often. Texts are
    scanned whole, however long; of two rules that find the same interval the one that stands first in the rules wins. Other
    columns of `df` are not read.
    """
    base = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__t"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = scanner()
        for batch in batches:
            out: list[tuple] = []
            for _, _, data, offsets in text_chunks(batch.column(1)):
                w = find_words(data, offsets, ALNUM, lower=True)
                raw = w.data.tobytes()
                start, end = w.start, w.start + w.length
                spot = np.minimum(np.searchsorted(tool.anchors, w.hash), len(tool.anchors) - 1)
                held = np.concatenate(([0], np.cumsum(tool.anchors[spot] == w.hash)))[w.first]
                may = (held[1:] > held[:-1]).tolist()
                for k, n in enumerate(w.counts.tolist()):
                    hits, found = [], []
                    a, b = int(w.first[k]), int(w.first[k + 1])
                    if may[k]:
                        words = b" ".join([raw[s:e] for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]).decode("utf-8", "replace")
                        hits, found = tool.scan(words)
                    own = sorted({label for label, _ in hits})
                    weight = {**dict.fromkeys(own, 0.5)}
                    for _, _, rule in found:
                        weight[rule.label] = max(weight.get(rule.label, 0), rule.weight)
                    score = 1 - float(np.prod([1 - x / 2 for x in weight.values()])) if weight else 0.0
                    out.append((n, len(hits), hits[0][1] if hits else None, hits[-1][1] if hits else None, ",".join(own), ",".join(sorted(weight)), score, [{"label": r.label, "start": s, "end": e} for s, e, r in found]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    return base.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
