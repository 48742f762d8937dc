"""The stored text index and phrase search by positions, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shotweave.operators import retrieve as R
from shotweave.operators import textindex as X
from shotweave.operators.textindex import TextIndex


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(words[min(59, int(rng.expovariate(0.12)))] for _ in range(int(rng.paretovariate(0.7)) % 700))) for i in range(n)]
    return texts + [(n, None), (n + 1, ""), (n + 2, "Ünder the w1, W1 w1; the w2")]


def counts(text, tokens):
    w = re.findall(r"[a-z0-9]+", (text or "").lower().replace("ü", "u"))
    return sum(x in tokens for x in w)


def brute(texts, tokens, k, allowed=lambda key: True):
    score = lambda n: round(n * 0.1 / (n * 0.1 + 1), 6)
    hits = [(key, score(counts(t, tokens))) for key, t in texts if counts(t, tokens) and allowed(key)]
    return sorted(hits, key=lambda x: (-x[1], x[0]))[:k]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    texts = corpus()
    df = spark.createDataFrame(texts, "id long, text string")
    path = str(tmp_path_factory.mktemp("index") / "own")
    old, X.BLOCK_TEXTS = X.BLOCK_TEXTS, 32
    yield texts, df, TextIndex(spark, path).append(df, "id", "text")
    X.BLOCK_TEXTS = old


def asked(spark, lists):
    return spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "query_id int, tokens array<string>")


LISTS = [["w1"], ["w1", "w2"], ["w40"], ["w3", "none"], ["none"], ["w0", "w1", "w2", "w3"], []]


@pytest.mark.parametrize("k", [1, 10, 2000])
def test_top_equals_a_full_search(spark, indexed, k):
    texts, _, index = indexed
    words = asked(spark, LISTS).select("query_id", F.explode("tokens").alias("token"))
    got = {}
    for r in index.top(words, "query_id", k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.key, r.score))
    assert got == {i: b for i, w in enumerate(LISTS) if (b := brute(texts, w, k))}


def test_filters_apply_before_the_cut(spark, indexed):
    texts, _, index = indexed
    words = asked(spark, LISTS).select("query_id", F.explode("tokens").alias("token"))
    odd = index.top(words, "query_id", 5, lambda x: x.where("key % 2 = query_id % 2"))
    got = {}
    for r in odd.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.key, r.score))
    assert got == {i: b for i, w in enumerate(LISTS) if (b := brute(texts, w, 5, lambda key: key % 2 == i % 2))}  # noqa: B023


def test_a_top_search_skips_blocks_and_buckets(spark, indexed):
    _, _, index = indexed
    bounds = index.blocks(["w1"])
    best = {r.key for r in index.top(spark.createDataFrame([(1, "w1")], "q int, token string"), "q", 3).collect()}
    bar = index.postings(["w1"]).where(F.col("key").isin(list(best))).agg(F.min("n")).first()[0]
    assert bounds.where(F.col("most") >= bar).count() < bounds.count() / 3
    assert "Exchange" not in index.postings(["w1"])._jdf.queryExecution().executedPlan().toString()
    assert buckets_read(index.postings(["w1"])) == 1 and buckets_read(index.postings()) == 8


def buckets_read(df):
    """The buckets whose files the tasks of a scan read; the plan's text leaves pruning out where no join needs buckets."""
    files = [f.filePath().toString() for p in df._jdf.queryExecution().toRdd().partitions() for f in p.files()]
    return len({re.search(r"_(\d{5})\.", f)[1] for f in files})


def test_segments_are_appended_merged_and_found_again(spark, tmp_path):
    texts = corpus(300, 9)
    parts = [spark.createDataFrame(texts[i::3], "id long, text string") for i in range(3)]
    index = TextIndex(spark, str(tmp_path / "i"))
    words = asked(spark, LISTS).select("query_id", F.explode("tokens").alias("token"))
    for p in parts:
        index.append(p, "id", "text")
    want = {i: b for i, w in enumerate(LISTS) if (b := brute(texts, w, 7))}

    def found(x):
        got = {}
        for r in x.top(words, "query_id", 7).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.key, r.score))
        return got

    assert len(index._segments()) == 3 and found(index) == want
    index.merge()
    assert len(index._segments()) == 1 and found(index) == want
    other = spark.newSession()  # another session has the same catalog; the tables are registered anew
    for kind in ("postings", "blocks"):
        other.sql(f"drop table {kind}_{index._segments()[0][0]}")
    again = TextIndex(other, index.path)
    found_again = {r.key for r in again.top(other.createDataFrame([(1, "w1")], "query_id int, token string"), "query_id", 7).collect()}
    assert found_again == {key for key, _ in want[0]} and buckets_read(again.postings(["w1"])) == 1


def occurrences(text, phrase):
    w = re.findall(r"[a-z0-9]+", (text or "").lower().replace("ü", "u"))
    return sum(w[i : i + len(phrase)] == phrase for i in range(len(w) - len(phrase) + 1)) if phrase else 0


def test_phrases_equal_brute_force_with_and_without_an_index(spark, indexed):
    texts, df, index = indexed
    lists = [["w1", "w2"], ["w0", "w0"], ["w0", "w0", "w0"], ["w2"], ["w1", "none"], ["under", "the", "w1"], ["w1", "w1", "the"], ["w0", "w1", "w0", "w2"], []]
    want = {(tuple(p), key): round(n * 0.1 / (n * 0.1 + 1), 6) for p in lists for key, t in texts if (n := occurrences(t, p))}
    for own in (None, index):
        got = R.token_hits(asked(spark, lists), df, "text", "id", phrase=True, floor=0.0, index=own).collect()
        assert {(tuple(r.tokens), r.id): r.score for r in got} == want and len(got) == len(want)


def test_words_equal_brute_force_with_and_without_an_index(spark, indexed):
    texts, df, index = indexed
    want = {(tuple(w), key): s for w in LISTS for key, s in brute(texts, w, 10**9)}
    for own in (None, index):
        got = R.token_hits(asked(spark, LISTS), df, "text", "id", index=own).collect()
        assert {(tuple(r.tokens), r.id): r.score for r in got} == want and len(got) == len(want)


def test_many_query_words_are_joined(spark, indexed, monkeypatch):
    texts, df, index = indexed
    monkeypatch.setattr(X, "LISTED", 2)
    want = {(tuple(w), key) for w in LISTS for key, _ in brute(texts, w, 10**9)}
    for own in (None, index):
        assert {(tuple(r.tokens), r.id) for r in R.token_hits(asked(spark, LISTS), df, "text", "id", index=own).collect()} == want
        got = R.token_hits(asked(spark, [["w1", "w2"], ["w0", "w0"]]), df, "text", "id", phrase=True, floor=0.0, index=own)
        assert {(tuple(r.tokens), r.id) for r in got.collect()} == {(p, key) for p in (("w1", "w2"), ("w0", "w0")) for key, t in texts if occurrences(t, list(p))}
    words = asked(spark, LISTS).select("query_id", F.explode("tokens").alias("token"))
    assert {(r.query_id, r.key) for r in index.top(words, "query_id", 4).collect()} == {(i, key) for i, w in enumerate(LISTS) for key, _ in brute(texts, w, 4)}


def test_a_phrase_in_a_text_of_many_different_words(spark, tmp_path):
    long = " ".join(f"x{i}" for i in range(100_000))
    df = spark.createDataFrame([(1, long), (2, "x5 x6 x7"), (3, "x7 x6")], "id long, text string")
    q = asked(spark, [["x5", "x6"], ["x99998", "x99999"], ["x7", "x6"]])
    want = {("x5", 1), ("x5", 2), ("x99998", 1), ("x7", 3)}
    for own in (None, TextIndex(spark, str(tmp_path / "i")).append(df, "id", "text")):
        assert {(r.tokens[0], r.id) for r in R.token_hits(q, df, "text", "id", phrase=True, floor=0.0, index=own).collect()} == want
