"""The two classifiers against plain twins: features as strings, weights in dictionaries, one number at a time."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from shotweave.llm.quality import fit_quality, score_quality
from shotweave.llm.toxicity import fit_toxicity, score_toxicity

VOCABULARY = ["red", "blue", "Bad", "awful", "tree", "on"]


def squash(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def texts(n, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(VOCABULARY[: 4 if i % 3 else 6]) for _ in range(rng.randrange(1, 12)))) for i in range(n)]
    return [*rows, (n, ""), (n + 1, None), (n + 2, "on on ON tree")]


def in_order(spark, ids):
    """Training order: by the hash of the id, without the hold-out fold."""
    own = [i for i in ids if zlib.crc32(str(i).encode()) % 4 != 2]
    return [r.id for r in spark.createDataFrame([(i,) for i in own], "id long").orderBy(F.xxhash64("id", F.lit(11))).collect()]


def word_set(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return {(x,) for x in w} | {(a, 1, b) for a, b in zip(w, w[1:], strict=False)} | {(a, 2, b) for a, b in zip(w, w[2:], strict=False)}


def plain_ftrl(rows, alpha=1.0, beta=1.0, l1=8.0, l2=0.1, epochs=4, seed=7):
    z, n, bias = defaultdict(float), defaultdict(float), "bias"

    def weight(f):
        if f == bias:
            return -z[f] / ((beta + math.sqrt(n[f])) / alpha + l2)
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, features = rows[k]
            w = {f: weight(f) for f in [*features, bias]}
            g = squash(sum(w.values())) - y
            for f in w:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
    return lambda features: squash(sum(weight(f) for f in features) + weight(bias))


def test_toxicity_equals_a_plain_twin(spark):
    docs = texts(240, 1)
    label = {i: int("bad" in (t or "").lower() and i % 5 > 0) for i, t in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(list(label.items()), "doc_id long, toxic int")
    by_id = dict(docs)
    model = plain_ftrl([(label[i], word_set(by_id[i])) for i in in_order(spark, label)])
    want = {i: model(word_set(t)) for i, t in docs}
    got = {r.doc_id: r.score for r in score_toxicity(df, fit_toxicity(df, labels)).collect()}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-5 and max(want.values()) > 0.8 and min(want.values()) < 0.2


def shape_counts(text):
    raw = "".join(c.lower() if c.isascii() else c for c in text or "")
    w, b = re.findall(r"[^\x20\x09-\x0D]+", raw), raw.encode()
    out = Counter(("word", x) for x in w)
    out.update(("again",) for a, c in zip(w, w[1:], strict=False) if a == c)
    out.update(("tri", b[i : i + 3]) for i in range(len(b) - 2))
    return out


def plain_ordinal(rows, grades=3, rate=0.1, l2=1e-5, epochs=3, seed=7):
    w, wn = defaultdict(float), defaultdict(lambda: 1e-8)
    p, pn = [0.0] * (grades - 1), [1e-8] * (grades - 1)

    def unit(c):
        norm = math.sqrt(max(sum(c.values()), 1))
        return {f: math.sqrt(n) / norm for f, n in c.items()}

    def theta():
        out = [p[0]]
        for step in p[1:]:
            out.append(out[-1] + math.exp(step))
        return out

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, x = rows[k][0], unit(rows[k][1])
            t, z = theta(), sum(w[f] * v for f, v in x.items())
            upper = squash(z - t[y - 1]) if y else 1.0
            lower = squash(z - t[y]) if y < grades - 1 else 0.0
            mass = max(upper - lower, 1e-9)
            du, dl = upper * (1 - upper), lower * (1 - lower)
            # d/dt of -log(upper - lower), then by the chain rule to the first threshold and the logs of the steps
            by_t = [0.0] * (grades - 1)
            if y:
                by_t[y - 1] += du / mass
            if y < grades - 1:
                by_t[y] -= dl / mass
            by_p = [sum(by_t[j:]) * (1.0 if j == 0 else math.exp(p[j])) for j in range(grades - 1)]
            for f, v in x.items():
                g = -(du - dl) / mass * v + l2 * w[f]
                wn[f] += g * g
                w[f] -= rate * g / math.sqrt(wn[f])
            for j, g in enumerate(by_p):
                pn[j] += g * g
                p[j] -= rate * g / math.sqrt(pn[j])
    return lambda c: [squash(sum(w[f] * v for f, v in unit(c).items()) - t) for t in theta()]


def test_quality_equals_a_plain_twin(spark):
    docs = texts(240, 2)
    grade = {i: 2 if "tree" in (t or "") else int("awful" not in (t or "")) for i, t in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ratings = spark.createDataFrame([*grade.items(), (0, 3), (1, -1)], "doc_id long, grade int")
    by_id = dict(docs)
    model = plain_ordinal([(grade[i], shape_counts(by_id[i])) for i in in_order(spark, grade)])
    want = {i: model(shape_counts(t)) for i, t in docs}
    got = {r.doc_id: r for r in score_quality(df, fit_quality(df, ratings, "grade", 3)).collect()}
    assert max(abs(got[i].expected_grade - sum(want[i])) for i in want) < 1e-4 and max(abs(got[i].tail_probability - want[i][0]) for i in want) < 1e-4
    assert {got[i].kept for i in want} == {True, False}
