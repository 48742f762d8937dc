"""Filter audit, sharding and clustering against brute force, and on nulls, ties, repeated rows and empty tables."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np

from shotweave.llm import sharding as H
from shotweave.llm.centroids import LARGEST, assigned, cluster_vectors, half_gaps, loosening, squared
from shotweave.llm.filter_audit import audit_filters, failing_ids, measured
from shotweave.llm.sharding import edits, first_map, read_map, rebalanced, shard_rows, write_map

AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute_audit(docs, labels):
    docs = [(i, t or "", p or "") for i, t, p in docs]
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t] = min(first.get(t, i), i)

    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": re.search(r"[#$%&*|]", t), "E": i is not None and i > first[t]}
        return {k for k, v in tests.items() if v}

    rows = [(i, p, fails(i, t)) for i, t, p in docs]
    out = []
    for part in sorted({p for _, p, _ in rows}):
        mine, total, here = [(i, f) for i, p, f in rows if p == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone, left = [x for x in left if name in x[1]], [x for x in left if name not in x[1]]
                total[name] += len(gone)
                every = [x for x in mine if name in x[1]]
                here.append((name, [part, "".join(order), step, len(left), len(gone), len(every) - len(gone), sum(f == {name} for _, f in every), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]))
        out += [tuple(x + [total[name]]) for name, x in here]
    return sorted(out)


def documents(n=120):
    rng = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "delta", "x#y", "Ünder", "é" * 3]
    docs = []
    for i in range(n):
        text = " ".join(rng.choice(words) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 90, 101, 150])))
        docs.append((i, text, rng.choice(["en", "de", None])))
    docs += [(i + 500, docs[i % 7][1], "en") for i in range(40)]  # copies
    docs += [(3, docs[3][1], "en"), (3, docs[3][1], "en"), (3, "other text", "de"), (None, docs[3][1], "en"), (None, None, None), (900, None, "fr"), (901, "", "fr"), (902, "A B " * 60_000, "fr")]
    return docs


def test_audit_is_that_of_brute_force(spark):
    docs, rng = documents(), random.Random(6)
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 540, 3)] + [(6, 1, None), (6, None, 1), (None, 1, 1), (7777, 1, 1)]
    df = spark.createDataFrame([(*d, "q", 1) for d in docs], "doc_id long, text string, lang string, row string, fails int")
    got = audit_filters(spark, df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == AUDIT
    want = brute_audit(docs, labels)
    assert sorted(map(tuple, got.collect())) == want and {x[0] for x in want} == {"", "de", "en", "fr"}


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(spark, spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0
    one = audit_filters(spark, spark.createDataFrame([(1, "one two", "en")], "doc_id long, text string, lang string"), labels).collect()
    assert len(one) == 600 and sum(r.removed for r in one) == 120 and {r.kept for r in one if r.step == 5} == {0}


def test_failing_ids_are_one_table_a_filter(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string")
    x = failing_ids(measured(docs, "doc_id", "text", "lang"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    plan = x.where("filter = 'E'")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*filter#\d+ = E", plan)
    assert {r["filter"] for r in x.select("filter").distinct().collect()} == set("ABCDE")


def check_shards(rows, docs, shards=8):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted((i is None, i or 0, size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    assert all(r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None for r in rows)
    total = [sum(r["size"] for r in rows if r.shard == s) for s in range(shards)]
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    for slot in {r.virtual_slot for r in rows}:
        assert len({r.shard for r in rows if r.virtual_slot == slot}) == 1
    return total


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(1)
    docs = [(i, "é" * rng.randrange(400)) for i in range(3000)] + [(7, "same")] * 900 + [(None, None)] * 800 + [(9, None), (9, "")]
    df = spark.createDataFrame([(*d, 5, 6) for d in docs], "doc_id long, text string, shard int, slot int")
    rows = shard_rows(spark, df).collect()
    total = check_shards(rows, docs)
    assert max(total) - min(total) <= 0.002 * sum(total) / 8 + 2


def test_hot_records_and_small_bins(spark, monkeypatch):
    monkeypatch.setattr(H, "COPIES", 50)
    monkeypatch.setattr(H, "BIN_ROWS", 3)
    docs = [(i, "text " * (i % 9)) for i in range(200)] + [(7, "same")] * 555
    rows = H.shard_rows(spark, spark.createDataFrame(docs, "doc_id long, text string"), slots=64).collect()
    check_shards(rows, docs)


def test_shards_of_nothing_and_of_one_giant(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shard_rows(spark, empty).count() == 0
    docs = [(1, "x" * 1_000_000)] + [(i, "y" * 100) for i in range(2, 800)]
    total = sorted(check_shards(shard_rows(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs))
    assert total[-2] - total[0] <= 101  # the others are even


def test_map_versions(spark, tmp_path):
    load = np.random.default_rng(3).integers(0, 1000, 4096)
    start = first_map(8)
    even = rebalanced(start, load, 8)
    grown = rebalanced(even, load, 9)
    less = rebalanced(grown, load, 6)
    sums = lambda m, n: np.bincount(m, weights=load, minlength=n)
    for m, n in ((even, 8), (grown, 9), (less, 6)):
        assert m.max() == n - 1 and np.ptp(sums(m, n)) <= 0.001 * load.sum() / n
    assert (even != start).sum() < 400 and 1 / 9 - 0.01 < load[grown != even].sum() / load.sum() < 1 / 9 + 0.02  # little more than a new shard's share
    assert set(grown[grown != even]) == {8} or ((grown != even) & (grown != 8)).sum() < 40
    path = str(tmp_path / "map")
    for v, m in enumerate((start, even, grown)):
        write_map(spark, path, v, m)
    moves = {r.virtual_slot: (r.from_shard, r.to_shard) for r in edits(spark, path, 1, 2).collect()}
    assert moves == {i: (int(even[i]), int(grown[i])) for i in np.flatnonzero(grown != even)}
    assert [r.shard for r in read_map(spark, path, 0).orderBy("virtual_slot").collect()] == start.tolist()
    assert (rebalanced(start, np.zeros(4096, dtype=int), 8) == start).all()


def brute_clusters(rows, k=40, rounds=5, dims=64):
    """rows: (vec_id, list or None)."""
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if max(map(abs, v)) < LARGEST]
    starts = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [list(v) for _, v in starts]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, y, strict=True)), j) for j, y in enumerate(c))
    for turn in range(rounds + 1):
        at = [near(v) for _, v in kept]
        if turn < rounds:
            groups = {}
            for (_, v), (_, j) in zip(kept, at, strict=True):
                groups.setdefault(j, []).append(v)
            c = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else y for j, y in enumerate(c)]
    inertia = {}
    for d, j in at:
        inertia[j] = inertia.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    fit = lambda x: min(x, (1 << 63) - 1)
    return sorted((i is None, i or 0, j, d, fit(inertia[j]), fit(sum(inertia.values())), sha[j]) for (i, _), (d, j) in zip(kept, at, strict=True))


def clusters(spark, rows, **kwargs):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v int")
    return sorted((r.vec_id is None, r.vec_id or 0, *r[1:]) for r in cluster_vectors(spark, df, **kwargs).collect())


def test_clusters_are_those_of_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 64))
    rows = [(int(i), [float(x) for x in np.float32(centres[i % 12] + rng.normal(scale=0.4, size=64))]) for i in range(700)]
    rows += [(5000 + i, rows[3][1]) for i in range(300)]  # a hot vector
    rows += [(2, rows[9][1]), (None, rows[8][1]), (None, rows[7][1]), (6000, None), (6001, [1.0] * 63), (6002, [1.0] * 65), (6003, [1.0] * 63 + [None]), (6004, [1.0] * 63 + [float("nan")]), (6005, [1.0] * 63 + [float("inf")]), (6006, []), (6007, [0.0] * 64), (6008, [1e30] * 64), (6009, [-0.001] * 64)]
    assert clusters(spark, rows) == brute_clusters(rows)


def test_ties_few_vectors_large_ones_and_none(spark):
    ties = [(i, [float(x) for x in ([1, 0] * 32 if i % 2 else [0, 1] * 32)]) for i in range(60)]
    assert clusters(spark, ties) == brute_clusters(ties)
    few = [(i, [float(i)] * 64) for i in range(5)]
    assert clusters(spark, few) == brute_clusters(few)
    assert clusters(spark, few[:1]) == brute_clusters(few[:1])
    rng = np.random.default_rng(8)
    large = [(i, [float(x) for x in np.float32(rng.uniform(-500_000, 500_000, 64))]) for i in range(80)]
    assert clusters(spark, large, k=7) == brute_clusters(large, k=7)
    assert clusters(spark, []) == [] and clusters(spark, [(1, None)]) == []


def test_bounds_hold_and_spare_scans():
    rng = np.random.default_rng(9)
    centres = rng.integers(-3000, 3000, (10, 64))
    x = centres[rng.integers(0, 10, 4000)] + rng.integers(-300, 300, (4000, 64))
    c, loose = x[:10].copy(), np.zeros(10)
    cluster, lower = np.full(len(x), -1), np.zeros(len(x))
    spared, tighter = 0, 0
    for _ in range(6):
        cluster, own, lower, scanned = assigned(x, cluster, lower, c, loose, half_gaps(c))
        d = squared(x, c)
        assert (cluster == d.argmin(axis=1)).all() and (own == d.min(axis=1)).all()
        rest = np.sqrt(np.where(np.arange(10)[None, :] == cluster[:, None], np.inf, d).min(axis=1))
        assert (lower <= rest + 1e-6).all()
        spared += (~scanned).sum()
        new = np.array([x[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else c[j] for j in range(10)])
        radius = np.array([np.sqrt(own[cluster == j].max(initial=0)) for j in range(10)])
        loose = loosening(c, new, radius)
        drift = np.sqrt(((new - c) ** 2).sum(axis=1))
        most = np.array([np.delete(drift, i).max() for i in range(10)])
        assert (loose <= most * (1 + 1e-6)).all()
        tighter += (loose < most * 0.9).sum()
        c = new
    assert spared > 8000 and tighter > 10
