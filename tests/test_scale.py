"""Operators that replace products and single tasks: equal to brute force, with plans and spreads that hold on hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotweave.functions.text import trigrams
from shotweave.functions.vectors import binary_quantize
from shotweave.operators import browse, sessions
from shotweave.operators import retrieve as R
from shotweave.operators.codeindex import CodeIndex, widths
from shotweave.operators.ordered import with_previous, with_running_sum
from shotweave.operators.search import link_chains


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- chains


def brute_chains(hits, gaps):
    """{(query, video, keyframe): path} of the best chain of each first-stage hit."""
    out = {}
    groups = {}
    for h in hits:
        groups.setdefault((h[0], h[2]), []).append(h)
    for (q, v), own in groups.items():
        stages = [[h for h in own if h[1] == s] for s in range(len(gaps) + 1)]
        if not all(stages):
            continue
        best = [(h[3], h[4], h[5], h[6], (h[4],)) for h in stages[-1]]
        for s in range(len(gaps) - 1, -1, -1):
            new = []
            for h in stages[s]:
                ok = [b for b in best if b[0] != h[3] and h[5] < b[2] < h[5] + gaps[s]]
                if ok:
                    b = min(ok, key=lambda b: (-round(b[3], 9), b[2], b[1]))
                    new.append((h[3], h[4], h[5], h[6] + b[3], (h[4], *b[4])))
            best = new
        for b in best:
            out[q, v, b[1]] = (round(b[3], 9), b[4])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chains_equal_all_pairs(spark, seed):
    rng, hits, key = random.Random(seed), [], 0
    for q in range(3):
        for v in ("a", "b"):
            for s in range(3):
                for _ in range(rng.choice([2, 40])):
                    key += 1
                    hits.append((q, s, v, rng.randrange(8), key, rng.randrange(0, 300, rng.choice([1, 10])), rng.choice([0.5, 0.25, rng.random()])))
    df = spark.createDataFrame(hits, "query_id int, stage int, video_id string, scene_id long, keyframe_id long, ts_ms int, score double")
    for gaps in ([30, 30], [7, 100], [1, 1000]):
        got = {(r.query_id, r.video_id, r.keyframe_id): (round(r.reached, 9), tuple(p.keyframe_id for p in r.path)) for r in link_chains(df, gaps, per_video=1000).collect()}
        assert got == brute_chains(hits, gaps)
        own = df.withColumn("reach", F.when(F.col("stage") == 0, gaps[0]).otherwise(gaps[1]))
        by_query = {(r.query_id, r.video_id, r.keyframe_id): tuple(p.keyframe_id for p in r.path) for r in link_chains(own, [F.col("reach")] * 2, per_video=1000).collect()}
        assert by_query == {k: p for k, (_, p) in got.items()}


def test_no_chain_without_a_gap(spark):
    df = spark.createDataFrame([(1, 0, "a", 1, 1, 0, 1.0, None), (1, 1, "a", 2, 2, 5, 1.0, None)], "query_id int, stage int, video_id string, scene_id long, keyframe_id long, ts_ms int, score double, reach int")
    assert link_chains(df, [F.col("reach")]).count() == 0


# ---- intervals


def test_segments_meet_shots_in_bins(spark, monkeypatch):
    monkeypatch.setattr(R, "BIN_MS", 100)
    rng = random.Random(4)
    seg = [(i, rng.choice(["a", "b"]), s, s + rng.choice([0, 5, 90, 2500, -20])) for i in range(200) for s in [rng.randrange(3000)]] + [(900, "a", None, 10), (901, "a", 10, None), (902, None, 1, 5)]
    shots = [(i, rng.choice(["a", "b"]), s, s + rng.choice([0, 50, 100, 900])) for i in range(120) for s in [rng.randrange(0, 3000, 50)]]
    got = R.segment_scenes(spark.createDataFrame(seg, "segment_id int, video_id string, start_ms int, end_ms int"), spark.createDataFrame(shots, "scene_id int, video_id string, start_ms int, end_ms int"))
    assert got.columns == ["segment_id", "video_id", "start_ms", "end_ms", "scene_id"]
    want = sorted((s[0], c[0]) for s in seg for c in shots if s[1] == c[1] and None not in s and s[2] < c[3] and s[3] > c[2])
    assert sorted((r.segment_id, r.scene_id) for r in got.collect()) == want
    assert "BroadcastNestedLoop" not in plan(got)


def test_a_long_video_is_spread_over_tasks(spark):
    n = 200_000
    seg = spark.range(n).select(F.col("id").alias("segment_id"), F.lit("v").alias("video_id"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 1500).alias("end_ms"))
    shots = spark.range(n // 4).select(F.col("id").alias("scene_id"), F.lit("v").alias("video_id"), (F.col("id") * 4000).alias("start_ms"), (F.col("id") * 4000 + 4000).alias("end_ms"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        x = R.segment_scenes(seg, shots)
        sizes = [r["count"] for r in x.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == n + n // 4 - 1 and max(sizes) < 1.5 * sum(sizes) / 4  # four tasks


# ---- scans in order


def test_borders_are_carried(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, rng.randrange(50)])) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, at int, x int")
    for width in (1, 7, 300, 5000):
        place = F.floor(F.col("at") / width)
        got = with_running_sum(with_previous(df, ["k"], place, ["at"], F.col("x"), "before"), ["k"], place, ["at"], F.col("x"), "total")
        assert sorted(got.columns) == ["at", "before", "k", "total", "x"]
        want = []
        for k in ("a", "b", None):
            total, before = 0, None
            for _, at, x in sorted(r for r in rows if r[0] == k and (r[0] is not None or k is None)) if k else sorted((r for r in rows if r[0] is None), key=lambda r: r[1]):
                total += x or 0
                want.append((k or "", at, before, total))
                before = x
        assert sorted(((r.k or "", r["at"], r.before, r.total) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_idle_sessions_over_hours(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(3), 1_700_000_000 + rng.randrange(40_000), i) for i in range(400)]
    df = spark.createDataFrame(rows, "code int, s long, event_id long").withColumn("ts", F.timestamp_seconds("s"))
    want = []
    for code in range(3):
        number, last = 0, None
        groups = {}
        for s, e in sorted((s, e) for c, s, e in rows if c == code):
            number += last is not None and s - last > 600
            last = s
            groups.setdefault(number, []).append(e)
        want += [(code, k, min(g), max(g), len(g)) for k, g in groups.items()]
    assert sorted(map(tuple, sessions.sessions_by_idle(df, 10).collect())) == sorted(want)


def test_overlaps_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(browse, "SHOT_RANGE", 3)
    rows = [("v", i, i * 10, i * 10 + (25 if i % 3 == 2 else 10)) for i in range(20)]
    got = browse.overlap_warnings(spark.createDataFrame(rows, "video_id string, shot_index int, start_ms int, end_ms int"))
    assert sorted(r.shot_index for r in got.collect()) == [i for i in range(1, 20) if (i - 1) % 3 == 2]


# ---- trigrams


def grams(s):
    import re

    return {("  " + w + " ")[i : i + 3] for w in re.findall(r"[a-z0-9]+", s.lower()) for i in range(len(w) + 1)}


def test_similar_texts_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7)))
    texts = [(i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(300)] + [(900, ""), (901, None)]
    phrases = [t for _, t in texts[:20]] + [texts[3][1] + " " + word(), "zzz", ""]
    df, q = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(i, p) for i, p in enumerate(phrases)], "query_id int, phrase string")
    for limit in (R.MOST_GRAMS, 1):
        monkeypatch.setattr(R, "MOST_GRAMS", limit)
        for least in (0.45, 0.2, 0.8, 1.0):
            want = {(p, i): round(len(a & b) / len(a | b), 6) for p in set(phrases) for i, t in texts if (a := grams(p)) and (b := grams(t or "")) and round(len(a & b) / len(a | b), 6) >= least}
            got = R.similar_texts(q, df, "text", "id", least).collect()
            assert {(r.phrase, r.id): r.score for r in got} == want and len(got) == len(want)


def test_a_frequent_gram_is_no_join_key(spark):
    """All texts share the grams of one word; their own words are rare and come first."""
    texts = [(i, f"the {i * 7919 % 100_003:05d}x{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(texts, "id int, text string")
    q = spark.createDataFrame([(1, texts[5][1])], "query_id int, phrase string")
    assert [(r.id, r.score) for r in R.similar_texts(q, df, "text", "id", 0.6).collect()] == [(5, 1.0)]
    size = df.select(F.size(trigrams(F.col("text"))).alias("n")).agg(F.max("n")).first()[0]
    assert size - np.ceil(size * 0.6) + 1 < size - len(grams("the"))  # a prefix ends before the common grams


# ---- codes


def test_parts_cut_words():
    for bits in (8, 10, 11, 16):
        cuts = widths(2, bits)
        for w in (0, 1):
            own = sorted((s, n) for x, s, n in cuts if x == w)
            assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and own[-1][0] + own[-1][1] == 32


@pytest.mark.parametrize("bits", [8, 11, 16])
def test_code_index_gives_the_nearest_codes(spark, bits):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    x = np.float32(centres[rng.integers(0, 40, 3000)] + rng.normal(scale=0.12, size=(3000, 64)))
    x[-3:] = x[0]  # equal codes
    asked = np.concatenate([x[:6], np.float32(rng.normal(size=(2, 64)))])
    frame = lambda rows, name: spark.createDataFrame([(i, 1 + i % 2 * 0, [float(v) for v in r]) for i, r in enumerate(rows)], f"{name} int, model_id int, embedding array<float>")
    vectors = frame(x, "id")
    codes = R.encode(vectors, "id")
    other = codes.limit(50).withColumn("model_id", F.lit(2))
    index = CodeIndex.build(spark, codes.unionByName(other), "id", 2, bits)
    q = frame(asked, "query_id")
    far = ((asked[:, None, :] > 0) != (x[None, :, :] > 0)).sum(axis=2)
    for k in (1, 20):  # queries end in the index or in the scan
        want = {(a, int(i), int(far[a, i])) for a in range(len(asked)) for i in np.lexsort((np.arange(len(x)), far[a]))[:k]}
        assert {(r.query_id, r.id, r.bits) for r in R.ann_candidates(q, codes, "id", k, index).collect()} == want
    narrow = q.where("query_id < 6").select("query_id", "model_id", binary_quantize(F.col("embedding")).alias("code"))
    scans = []
    _, read = index.nearest(narrow, 20, lambda *a: scans.append(a), probe_cost=1)
    assert not scans and read < 6 * len(x) / 4  # none left the index


# ---- exclusions


def corpus(spark, n=400):
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, 1, [float(v) for v in rng.normal(size=8)]) for i in range(n)], "keyframe_id long, model_id int, embedding array<float>")
    kf = spark.range(n).select(F.col("id").alias("keyframe_id"), F.floor(F.col("id") / 2).alias("scene_id"), F.format_string("v%02d", (F.col("id") % 40).cast("int")).alias("video_id"), F.lit(0).alias("kf_index"), F.lit(0).alias("ts_ms"))
    videos = kf.select("video_id").distinct().withColumn("collection", F.when(F.substring("video_id", 3, 1).cast("int") % 2 == 0, "A").otherwise("B"))
    return {"keyframes": kf, "videos": videos, "keyframe_embedding": vectors}


def test_exclusions_do_not_raise_the_depth(spark, monkeypatch):
    t = corpus(spark)
    v = {r.keyframe_id: (np.array(r.embedding) / np.linalg.norm(r.embedding), f"v{r.keyframe_id % 40:02d}") for r in t["keyframe_embedding"].collect()}
    q = t["keyframe_embedding"].where("keyframe_id < 9").select(F.col("keyframe_id").cast("int").alias("query_id"), "model_id", "embedding")
    gone = {0: [f"v{i:02d}" for i in range(20)], 1: ["v01", "nowhere"], 2: [f"v{i:02d}" for i in range(40)]}
    exclude = spark.createDataFrame([(k, x) for k, xs in gone.items() for x in [*xs, xs[0]]], "query_id int, video_id string")
    wanted = spark.createDataFrame([(3, " a "), (4, "B"), (5, ""), (6, None), (7, "none"), (0, "a")], "query_id int, collection string")
    asked = {3: "A", 4: "B", 7: "NONE", 0: "A"}

    def want(k, filters):
        out = {}
        for a in range(9):
            x = [(round(1 - float(v[a][0] @ e), 6), i) for i, (e, video) in v.items() if not filters or (video not in gone.get(a, []) and ("AB"[int(video[2]) % 2] == asked.get(a, "AB"[int(video[2]) % 2])))]
            out[a] = [i for _, i in sorted(x)[:k]]
        return {a: x for a, x in out.items() if x}

    def found(df):
        out = {}
        for r in df.orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r.keyframe_id)
        return out

    depths = []
    scan = R._scan
    monkeypatch.setattr(R, "_scan", lambda q, v, k, kind: depths.append(k) or scan(q, v, k, kind))
    assert found(R.retrieve_visual(q, t, 10)) == want(10, False)
    assert found(R.retrieve_visual(q, t, 10, exclude=exclude, wanted=wanted)) == want(10, True)
    assert set(depths) == {10}
    monkeypatch.setattr(R, "BLOCK_QUERIES", 2)  # several blocks
    assert found(R.retrieve_visual(q, t, 10, exclude=exclude, wanted=wanted)) == want(10, True)
    assert set(found(R.retrieve_visual(q, t, 400, collection=" b "))[8]) == {i for i, (_, video) in v.items() if int(video[2]) % 2}
