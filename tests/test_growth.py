"""Work grows no faster than the tables: what queries share is done once, and no row stands for every word or every pair."""

import numpy as np
from pyspark.sql import functions as F

from shotweave.operators import textindex as X


def test_words_are_grouped_where_a_text_is_read(spark, monkeypatch):
    monkeypatch.setattr(X, "GROUP_WORDS", 3)
    df = spark.createDataFrame([(1, 5, ["b", "a", "b"]), (2, 6, []), (3, 7, None), (4, 8, ["a"]), (5, 9, ["c", "c", "c", "c", "a"])], "key long, block long, w array<string>")
    got = X.grouped_words(df)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.key, r.block, r.token, r.n, r.positions) for r in got.collect())
    assert rows == [(1, 5, "a", 1, [1]), (1, 5, "b", 2, [0, 2]), (4, 8, "a", 1, [0]), (5, 9, "a", 1, [4]), (5, 9, "c", 4, [0, 1, 2, 3])]


def test_equal_requests_are_searched_once(spark):
    from shotweave.operators.shared import once_by, once_by_rows

    q = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", ["x"]), (4, "b", ["y"]), (5, None, ["x"]), (6, "b", ["x"])], "query_id int, raw string, sources array<string>")
    asked = once_by(q, ["raw", "sources"])
    assert sorted(r.query_id for r in asked.first.collect()) == [1, 3, 4, 5] and asked.count == 4
    found = asked.first.select("query_id", F.lit(7).alias("hit"))
    for each in (None, 1, 10**9):
        assert sorted(map(tuple, asked.given(found, each).collect())) == [(i, 7) for i in range(1, 7)]
    steps = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 1, "b"), (2, 0, "a"), (3, 0, "a")], "query_id int, stage int, w string")
    asked = once_by_rows(steps, "stage")
    assert sorted(map(tuple, asked.first.collect())) == [(1, 0, "a"), (1, 1, "b"), (3, 0, "a")]
    assert sorted(map(tuple, asked.members.collect())) == [(1, 1), (2, 1), (3, 3)]


def test_score_range_ranks_a_shared_list_once(spark, monkeypatch):
    """Rows of hits and queries never meet before the cut."""
    from shotweave.operators import retrieve as R
    from shotweave.plans import registry

    def pairs(*_, **__):
        raise AssertionError("hits of every query")

    monkeypatch.setattr(R, "lexical_hits", pairs)
    assert registry.queries()["score_range"](spark, "/root/testdata/sf0.001").count() == 1


def test_scan_keeps_the_nearest_of_a_task_not_of_a_batch(spark):
    """Ten batches of one task, with many copies: k rows a query leave it, and they are the right ones."""
    from shotweave.operators import retrieve as R

    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8)).astype(np.float32)[rng.integers(0, 60, 400)]
    v = spark.createDataFrame([(int(i), 1, [float(c) for c in x[i]]) for i in rng.permutation(400)], "key bigint, model_id int, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(i, 1, [float(c) for c in x[i]]) for i in range(9)], "query_id int, model_id int, embedding array<float>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        near = R.exact_candidates(q, v, "key", 7).groupBy("query_id").count().collect()
        got = {i: [] for i in range(9)}
        for r in R.knn_exact(q, v, "key", 7).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.key)
        bits = R.ann_candidates(q, R.encode(v, "key"), "key", 7).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("bits", "key"))).alias("b")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r["count"] < 14 for r in near)
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(axis=1, keepdims=True))
    for i in range(9):
        d = np.round(1 - unit @ unit[i], 6)
        assert got[i] == sorted(range(400), key=lambda j: (d[j], j))[:7]
    for r in bits:
        apart = ((x > 0) != (x[r.query_id] > 0)).sum(axis=1)
        assert [(b["bits"], b["key"]) for b in r.b] == sorted((int(apart[j]), j) for j in range(400))[:7]


def test_similar_texts_move_no_pairs_but_similar_ones(spark, monkeypatch):
    """Several blocks, tables and lists, texts of many words and short phrases: as a comparison of all pairs."""
    from shotweave.functions.text import trigram_similarity
    from shotweave.operators import retrieve as R

    words = ["of the and", "of the", "the", "of the and in that this", " ".join(f"word{i} of the" for i in range(90)), "", None, "Of THE", "été of the"]
    df = spark.createDataFrame(list(enumerate(words)), "id long, text string")
    for picked in (words[:3], words):
        q = spark.createDataFrame([(w,) for w in picked], "phrase string")
        every = q.crossJoin(df).select("phrase", "id", F.round(trigram_similarity("phrase", "text"), 6).alias("score")).where("score >= 0.45")
        wanted = sorted(map(tuple, every.collect()))
        for block, most in ((4096, R.MOST_GRAMS), (2, 1)):
            monkeypatch.setattr(R, "BLOCK_PHRASES", block)
            monkeypatch.setattr(R, "MOST_GRAMS", most)
            got = R.similar_texts(q, df, "text", "id", 0.45)
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert "gram#" not in plan and sorted(map(tuple, got.collect())) == wanted


def test_hits_are_dealt_before_they_meet_the_queries(spark):
    """Two lists with many queries are not two tasks."""
    from shotweave.operators import retrieve as R

    df = spark.createDataFrame([(i, "a b") for i in range(40)], "id long, text string")
    q = spark.range(30).select(F.col("id").alias("query_id"), F.array(F.when(F.col("id") % 2 == 0, "a").otherwise("b")).alias("tokens"))
    got = R.lexical_hits(q, df, "text", "id")
    assert got.count() == 1200 and got.select(F.spark_partition_id().alias("p")).distinct().count() > 8


def test_trigrams_cut_a_repeated_word_once(spark):
    from shotweave.functions.text import trigram_similarity, trigrams

    rows = [("aa b aa AA b", "b aa"), ("a", None), ("", ""), ("été ab", "ete abc"), ("𝐀𝐀 x", "𝐀𝐀")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(trigrams(F.col("a")).alias("g"), F.round(trigram_similarity(F.col("a"), F.col("b")), 6).alias("s"))
    assert [r.g for r in got.collect()] == [["  a", " aa", "aa ", "  b", " b "], ["  a", " a "], [], ["  e", " et", "ete", "te ", "  a", " ab", "ab "], ["  𝐀", " 𝐀𝐀", "𝐀𝐀 ", "  x", " x "]]
    assert [r.s for r in got.collect()] == [1.0, 0.0, 0.0, 0.666667, 0.6]
    cut = df.select(trigrams(F.col("a")))._jdf.queryExecution().analyzed().toString()
    assert "transform(array_distinct(regexp_extract_all" in cut


def test_texts_are_judged_by_their_heads_before_they_are_cut(spark):
    """No filter on a whole text's grams stands where the texts are read."""
    from shotweave.operators import retrieve as R

    df = spark.createDataFrame([(1, "of the"), (2, None), (3, "of the " + " ".join(map(str, range(10**4, 10**4 + 200))))], "id long, text string")
    got = R.similar_texts(spark.createDataFrame([("of the",)], "phrase string"), df, "text", "id", 0.45)
    assert [tuple(r) for r in got.collect()] == [("of the", 1, 1.0)]
    read = got._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[-1]
    assert "substring(text" in read and read.count("array_distinct(flatten(") == 1


def test_chains_are_linked_step_by_step_and_for_the_lengths_that_queries_have(spark, monkeypatch):
    """A task holds the sorts of one step: what the last step gives is read from a stored table."""
    from shotweave.operators import search as S

    rows = [(q, s, "v", 10 * s + q, 10 * s + q, 5 * s, 1.0) for q in (1, 2) for s in range(3)]
    hits = spark.createDataFrame(rows, "query_id int, stage int, video_id string, scene_id long, keyframe_id long, ts_ms int, score double")
    stages = spark.createDataFrame([(q, s, 10 if s else None) for q in (1, 2) for s in range(3)] + [(3, 0, None)], "query_id int, stage int, gap_ms int")
    asked, link = [], S.link_chains
    monkeypatch.setattr(S, "link_chains", lambda x, gaps, *more: asked.append(len(gaps)) or link(x, gaps, *more))
    got = S.link_stages(hits, stages)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString() and asked == [2]
    assert sorted((r.query_id, r.reached, [p.keyframe_id for p in r.path]) for r in got.collect()) == [(1, 3.0, [1, 11, 21]), (2, 3.0, [2, 12, 22])]
    assert S.link_stages(hits, stages.where("query_id = 3")).count() == 0


def test_tasks_of_the_code_join_grow_in_number_with_its_rows(spark, monkeypatch):
    from shotweave.operators import codeindex as C

    rng = np.random.default_rng(3)
    codes = spark.createDataFrame([(i, 1, [int(x) for x in rng.integers(0, 2**31, 2)]) for i in range(60)], "key long, model_id int, code array<long>")
    index = C.CodeIndex.build(spark, codes, "key", 2, bits=8)
    q = codes.where("key < 9").select(F.col("key").alias("query_id"), "model_id", F.col("code").alias("own"), C.parts_of(F.col("code"), index.cuts).alias("own_parts"))
    met = []
    for rows in (10**6, 50):
        monkeypatch.setattr(C, "TASK_ROWS", rows)
        found = index._met(q, 1)
        tasks = -(-9 * len(index.cuts) * max(n for _, _, n in index.cuts) // rows)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert sum("RepartitionByExpression" in x and x.endswith(f"], {tasks}") for x in plan.splitlines()) == 2
        met.append(sorted(map(tuple, found.collect())))
    assert met[0] == met[1] and tasks > 4


def test_similar_pairs_are_numbers_until_they_are_results(spark, monkeypatch):
    """No phrase stands in a pair, and no pair is moved or written on its way, with one block and with several."""
    from shotweave.operators import retrieve as R
    from shotweave.plans import registry
    from shotweave.sources.scratch import stored

    kept, got = [], []
    monkeypatch.setattr(R, "stored", lambda df: kept.extend(df.columns) or stored(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for block in (4096, 2):
            monkeypatch.setattr(R, "BLOCK_PHRASES", block)
            df = registry.QUERIES["similar_transcripts"](spark, "/root/testdata/sf0.001")
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "phrase#" not in plan and "SortMergeJoin" not in plan and "both" not in kept
            got.append(sorted(map(tuple, df.collect())))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got[0] == got[1] and len(got[0]) > 4


def test_queries_with_equal_phrases_share_similar_texts(spark):
    from shotweave.operators import retrieve as R

    df = spark.createDataFrame([(1, "of the"), (2, "zzz"), (3, None)], "id long, text string")
    q = spark.createDataFrame([(7, "of the"), (8, "of the"), (9, "Of THE"), (10, None), (11, "")], "query_id int, phrase string")
    assert sorted(map(tuple, R.similar_texts(q, df, "text", "id", 0.45, "query_id").collect())) == [(7, 1, 1.0), (8, 1, 1.0), (9, 1, 1.0)]


def test_rows_of_hits_and_queries_repeat_each_other(spark):
    """A query's hits of a short list stand together, and then the next query's: files hold such rows in few bits."""
    from shotweave.operators import retrieve as R

    df = spark.createDataFrame([(i, "a b a" if i % 3 else "a") for i in range(640)], "id long, text string")
    q = spark.range(50).select(F.col("id").alias("query_id"), F.array(F.lit("a")).alias("tokens"))
    got = R.lexical_hits(q, df, "text", "id").collect()
    assert sorted(map(tuple, got)) == [(j, i, 0.166667 if i % 3 else 0.090909) for j in range(50) for i in range(640)]
    changes = sum(a.query_id != b.query_id for a, b in zip(got, got[1:]))
    assert changes < len(got) / 10
    assert R.lexical_hits(q, df.where("false"), "text", "id").count() == 0


def test_large_files_are_dealt_before_their_words_are_grouped(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i if i % 9 else None, f"word{i} " * 8) for i in range(60)], "id long, text string").coalesce(1)
    group, tasks, found = X.grouped_words, [], []
    monkeypatch.setattr(X, "grouped_words", lambda words: tasks.append(words.rdd.getNumPartitions()) or group(words))
    for chars in (X.READ_CHARS, 200):
        monkeypatch.setattr(X, "READ_CHARS", chars)
        index = X.TextIndex(spark, f"{tmp_path}/{chars}").append(df, "id", "text")
        found.append(sorted((r.token, r.block, r.key, r.n, r.positions) for r in index.postings().collect()))
    assert tasks[0] == 1 and tasks[1] > 10 and found[0] == found[1] and len(found[0]) == 53


def test_a_task_holds_the_product_of_two_short_lists(spark):
    """Spark's generated code keeps all rows that one row of a join gives: the product is unfolded behind it."""
    from shotweave.operators import retrieve as R

    df = spark.createDataFrame([(i, "a b") for i in range(40)], "id long, text string")
    q = spark.createDataFrame([(i if i else None, [["a"], ["b"], ["c"]][i % 3]) for i in range(300)] + [(7, ["b"])], "query_id int, tokens array<string>")
    got = R.lexical_hits(q, df, "text", "id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("inline(asked") < plan.index("Coalesce") < plan.index("BroadcastHashJoin")
    wanted = [(i, k, 0.090909) for i in [-1, *(i for i in range(300) if i and i % 3 < 2), 7] for k in range(40)]
    assert sorted((-1 if r.query_id is None else r.query_id, r.id, r.score) for r in got.collect()) == sorted(wanted)
