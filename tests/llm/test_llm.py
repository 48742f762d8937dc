"""The training-data operators against brute force, on small tables with nulls, empty texts, ties and long texts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shotweave.llm.decontaminate import decontaminate
from shotweave.llm.embedding_dedup import near_vectors
from shotweave.llm.graph import components
from shotweave.llm.jaccard_join import jaccard_components, jaccard_links
from shotweave.llm.license_scan import scan_licenses
from shotweave.llm.mixing import mix
from shotweave.llm.pseudonyms import pseudonymize
from shotweave.llm.quality import fit_ordinal
from shotweave.llm.substring_dedup import remove_repeats
from shotweave.llm.token_counts import Counter as Tokens
from shotweave.llm.token_counts import MergeTable, count_tokens
from shotweave.llm.toxicity import fit_ftrl

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "").encode()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [rng.choice("abcdefghij") + str(rng.randint(0, 20)) for _ in range(200)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "A"), (1004, "a"), (1005, "x " * 400), (1006, "x " * 90)]
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(200)] = f"q{rng.randint(0, 99)}"
        rows.append((i, " ".join(w[: rng.choice([200, 195, 40])])))
    return rows + rows[:1] + rows[-2:]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in texts], "doc_id long, text string, key string, n long")


def test_tokens_equal_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rng = random.Random(1)
    rows = ["", " ", "aaa aaaaaaaaaa", "Σίσυφος ΣΑΣ", "<|endoftext|>hi<|startoftext|>", "a\x1cb", "é café", "x" * 3000] + ["".join(rng.choice("abcde'st 12é\U0001f600.,́ß") for _ in range(50)) for _ in range(300)]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(rows, add_special_tokens=False)]
    assert Tokens(MergeTable(path)).count(rows) == want
    df = spark.createDataFrame([(1, None, 5), (2, "hello world", 6)], "doc_id long, text string, n_tokens int")
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, path).collect()) == [(1, 0, 0, False), (2, 11, 2, False)]
    assert count_tokens(df.limit(0), path).count() == 0


@pytest.mark.parametrize("block", [200_000, 40])
def test_decontamination(spark, docs, texts, block):
    items = [(1, texts[9][1][:90]), (2, "q1 zz"), (3, None), (4, "a1"), (5, texts[9][1][:90]), (10, "X x X")]
    out = decontaminate(spark, docs, spark.createDataFrame(items, "item_id long, text string"), block_windows=block).collect()
    wins = defaultdict(set)
    for i, t in items:
        w = WORDS.findall(lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])].add(str(i))
    want = []
    for i, t in texts:
        w, hit, its = WORDS.findall(lower(t)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if z := wins.get(tuple(w[k : k + n])):
                    hit |= {*range(k, k + n)}
                    its |= z
        want.append((i, len(w), len(hit), sorted(its)))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in out) == sorted(want)


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    rows = [(i, (base[i % 12] + rng.standard_normal(16) * 0.06).tolist(), i % 2) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], None), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] * 16, 0), (305, [None] + [1.0] * 15, 0), (306, [1.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=16).collect()}
    good = [r for r in rows if r[2] is not None and r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = (x @ x.T >= 0.98) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good])[None, :])
    np.fill_diagonal(hit, False)
    reach = hit | np.eye(len(good), dtype=bool)
    for _ in range(9):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    want = {r[0]: (0, r[0], True) for r in rows}
    for k, r in enumerate(good):
        c = min(good[j][0] for j in np.flatnonzero(reach[k]))
        want[r[0]] = (int(hit[k].sum()), c, c == r[0])
    assert got == want


@pytest.mark.parametrize("window", [7, 35])
def test_substring_dedup(spark, docs, texts, window):
    ws = [SPACED.findall((t or "").encode()) for _, t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in ws for k in range(len(w) - window + 1))
    want = []
    for (i, _), w in zip(texts, ws, strict=True):
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                keep[k : k + window] = [False] * window
        want.append((i, len(w), len(w) - sum(keep), b" ".join(x for x, k in zip(w, keep, strict=True) if k).decode()))
    assert sorted(tuple(r) for r in remove_repeats(spark, docs, window=window).collect()) == sorted(want)


def brute_components(texts, k, p):
    sets = {}
    for i, t in texts:
        w = SPACED.findall(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and x and y and 100 * len(x & y) >= p * len(x | y):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("block", [400, 8])
def test_jaccard(spark, docs, texts, block):
    want = brute_components(texts, 4, 85)
    got = {r.node: r.component for r in components(spark, jaccard_links(spark, docs, block=block, frequent_least=3)).collect()}
    assert {i: got.get(i, i) for i in want} == {i: c for i, (_, c) in want.items()}
    if block == 400:
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark, docs).collect()} == want


def test_pseudonyms(spark):
    t = "john.doe.22@mail.example.com 4111 1111 1111 1111 4111111111111112 192.168.0.1 999.1.1.1 +1 (017) 555-7713 123-45-6789 2021-02-30 2021-02-28"
    df = spark.createDataFrame([(1, t), (2, None), (3, ""), (4, "nothing here"), (5, "x 192.168.0.1 y")], "doc_id long, text string")
    out = {r.doc_id: r for r in pseudonymize(df, "k", count="n").collect()}
    new = out[1].text
    assert len(new) == len(t) and out[1].n == 6 and "4111111111111112" in new and "999.1.1.1" in new and "2021-02-30" in new
    assert not any(x in new for x in ("john.doe", "4111 1111", "192.168.0.1", "555-7713", "123-45-6789", "2021-02-28"))
    assert out[5].text.split()[1] == re.search(r"[\d.]{7,}", new.split("4111111111111112 ")[1])[0]
    assert (out[2].text, out[3].text, out[4].text) == (None, "", "nothing here")
    many = spark.range(2000).selectExpr("id doc_id", "concat('123-45-', lpad(id, 4, '0')) text").where("doc_id > 0")
    assert pseudonymize(many, "k").select("text").distinct().count() == 1999


def test_licenses(spark):
    rows = [(1, "Licensed under CC BY-NC 4.0. All rights reserved, ALL RIGHTS RESERVED"), (2, None), (3, "GNU Lesser General Public License version 2.1"), (4, "plain text")]
    out = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels) == (3, 2, 10, "cc-by,reserved")
    assert "cc-by-nc-4.0" in out[1].labels.split(",") and out[3].labels == "gpl,lgpl-2.1"
    assert (out[2].n_words, out[2].labels, out[2].first_word, out[4].score) == (0, "", None, 0.0)


def test_mixing_moves_shortage_to_siblings_first(spark):
    rows = [(i, "web", "a", 10) for i in range(10)] + [(100 + i, "web", "b", 10) for i in range(50)] + [(200 + i, "books", "c", 10) for i in range(50)] + [(900, None, "d", 0)]
    from pyspark.sql import functions as F

    out = mix(spark.createDataFrame(rows, "doc_id long, domain string, source string, k int"), ["domain", "source"], {"source": {"b": 1.0}}, F.col("k"), part_of_all=500 / 1100, epochs=1)
    got = {r.source: r.t for r in out.groupBy("source").agg(F.sum("take_tokens").alias("t")).collect()}
    assert got == {"a": 100, "b": 150, "c": 250}
    assert mix(spark.createDataFrame(rows, "doc_id long, domain string, source string, k int").limit(0), ["domain", "source"], {}, F.col("k")).count() == 0


def test_models_learn():
    rng = np.random.default_rng(0)
    rows = [(int(y), np.unique(np.append(rng.integers(10, 500, 30), 3 if y else 4)).astype(np.int32), None) for y in rng.integers(0, 2, 600)]
    model = fit_ftrl(rows, 10, 1.0, 1.0, 4.0, 0.1, 3, 7)
    w = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
    assert w[3] > 1 and len(w) < 60
    graded = [(g, np.array([g, 50 + k % 7], dtype=np.int32), np.array([2, 1], dtype=np.uint16)) for k in range(600) for g in [k % 3]]
    m = fit_ordinal(graded, 8, 3, 0.2, 1e-5, 3, 7)
    assert m.threshold[0] < m.threshold[1] and m.weight[0] < m.weight[1] < m.weight[2]
