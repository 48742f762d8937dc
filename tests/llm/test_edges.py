"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names; brute force where SQL has no say."""

import hashlib
import random
import re
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shotweave.llm import graph, jaccard_join
from shotweave.llm import pseudonyms as P
from shotweave.llm.decontaminate import decontaminate
from shotweave.llm.embedding_dedup import near_vectors
from shotweave.llm.graph import components
from shotweave.llm.hashing import collect_features, labelled_rows, word_features
from shotweave.llm.jaccard_join import all_overlaps, jaccard_components, keep_one, overlaps, row_key, seats_of
from shotweave.llm.license_rules import BASE, rules
from shotweave.llm.license_scan import scan_licenses, scanner, suppress
from shotweave.llm.mixing import mix
from shotweave.llm.quality import fit_quality, score_quality
from shotweave.llm.queries import KEY_SETTING, secret
from shotweave.llm.substring_dedup import remove_repeats
from shotweave.llm.token_counts import Counter, MergeTable, count_tokens
from shotweave.llm.toxicity import fit_toxicity, score_toxicity
from tests.llm.test_llm import SPACED, WORDS, brute_components, lower

LONG = "lorem ipsum dolor " * 40_000  # 120,000 words


@pytest.fixture(scope="module")
def table():
    pub = pytest.importorskip("public_tokenizers")
    return pub.path("word_bpe_49k.json")


def test_tokens_of_all_code_points(table):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(table), Counter(MergeTable(table))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("!%s!", "%sa1"):
        for lo in range(0, len(points), 200_000):
            texts = [form.replace("%s", c) for c in points[lo : lo + 200_000]]
            assert own.count(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_tokens_of_long_words(table):
    from tokenizers import Tokenizer

    lib, own, rng = Tokenizer.from_file(table), Counter(MergeTable(table)), random.Random(1)
    texts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(200_000)), "a" * 50_001, "ab" * 9_000, "the" * 3_000 + " " + "!" * 9_000, "é" * 5_000]
    assert own.count(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_tokens_keep_rows_and_other_columns(spark, table):
    df = spark.createDataFrame([(1, "a b", True, "x"), (1, "a b", True, "x"), (None, None, False, "y"), (2, LONG, None, "z")], "doc_id long, text string, over_limit boolean, __text string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.over_limit, r["__text"]) for r in count_tokens(df, table).collect())
    assert got[:3] == [(0, 0, False, "y"), (1, 2, False, "x"), (1, 2, False, "x")] and got[3][0] == 2 and got[3][2]


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontamination_edges(spark, block):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "x y"), (None, None), (2, LONG + "needle in hay"), (3, "")], "doc_id long, text string").withColumn("row", F.lit("own")).repartition(5)
    items = spark.createDataFrame([(None, "b c"), ("i1", "needle in hay"), ("i2", "d"), ("i3", " "), ("i4", None)], "item_id string, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate(spark, docs, items, block_windows=block).collect())
    assert got == [(0, 0, 0, ()), (1, 2, 0, ()), (1, 4, 3, ("i2",)), (1, 4, 3, ("i2",)), (2, 120_003, 3, ("i1",)), (3, 0, 0, ())]
    assert decontaminate(spark, docs.limit(0), items).count() == 0 and {r.n_hit for r in decontaminate(spark, docs, items.limit(0)).collect()} == {0}


def test_vectors_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (None, [1.0, 0.0], 0), (3, [1e-200, 0.0], 0), (4, [], 0), (5, [1.0], 0), (6, [2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("own"))
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id) for r in near_vectors(spark, df).collect())
    assert got == [(0, 0, None), (1, 0, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4), (5, 1, 5), (6, 1, 5)]
    assert near_vectors(spark, df.limit(0)).count() == 0


def test_substring_edges(spark):
    run = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, run), (1, run), (None, run + " end"), (2, None), (3, ""), (4, LONG), (5, "alone " + " ".join(f"v{i}" for i in range(40)))], "doc_id long, text string").withColumn("key", F.lit(1))
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, len(r.kept_text)) for r in remove_repeats(spark, docs).collect())
    assert got[:6] == [(0, 41, 40, 3), (1, 40, 40, 0), (1, 40, 40, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 120_000, 120_000, 0)] and got[6][:3] == (5, 41, 0)
    assert remove_repeats(spark, docs.limit(0)).count() == 0


def test_voronoi_cells_hold_every_link():
    """Each set has one home, the nearest pivot, and any two within the radius meet in a cell."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1000, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.15, rng.integers(0, 1000, 60), base)).astype(np.uint64) for _ in range(80)]
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    grams, size = np.concatenate(sets), np.diff(first)
    both = all_overlaps(grams, first, width=64)
    np.fill_diagonal(both, size)  # only shingles that two sets share are counted
    assert (both == overlaps(grams, first, grams, first)).all()
    d = 1 - both / (size[:, None] + size[None, :] - both)
    pivots, radius = [3, 20, 41, 66], 0.3
    row, cell = seats_of(d[:, pivots], radius)
    seats = {i: set(cell[row == i].tolist()) for i in range(80)}
    assert all(d[i, pivots].argmin() in seats[i] for i in range(80))
    assert all(seats[i] & seats[j] for i in range(80) for j in range(80) if d[i, j] <= radius)


@pytest.mark.parametrize("block, pivots", [(512, 32), (10, 4)])
def test_chains_of_near_copies(spark, monkeypatch, block, pivots):
    """Texts that drift away step by step are one group although its ends share little; cells small enough to recurse."""
    from shotweave.llm import jaccard_join as J

    monkeypatch.setattr(J, "PIVOTS", pivots)
    monkeypatch.setattr(J, "LEAF", 8)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        if i % 40 == 0:
            words = [f"{i}x{k}" for k in range(60)] if i else words
        words = list(words)
        words[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = J.jaccard_links(spark, df, block=block, frequent_least=10_000)
    got = {r.node: r.component for r in J.components(spark, links).collect()}
    assert {i: got.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in brute_components(rows, 4, 85).items()}


def test_one_of_each_group_stays(spark):
    """Rows are told apart by id and text: an id that two texts share loses neither, null ids are rows too."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(7, a), (7, b), (7, b), (8, b + " more"), (None, a + " z"), (None, c), (9, None), (9, ""), (10, ""), (9, None), (11, " \n"), (12, "short one"), (13, "short one"), (14, "short two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_key", F.lit("own")).withColumn("node", F.lit(1))
    kept = keep_one(spark, df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    texts = [t for _, t in got]
    assert sum(t in (a, a + " z") for t in texts) == 1 and sum(t in (b, b + " more") for t in texts) == 1 and texts.count(c) == 1
    assert texts.count("short one") == 1 and texts.count("short two") == 1
    assert sum(not (t or "").strip() for t in texts) == 4  # (9, null) twice is one row
    assert keep_one(spark, df.limit(0)).count() == 0 and jaccard_components(spark, df.limit(0)).count() == 0


def feistel(codes, radix, key, tweak):
    half, state = len(codes) // 2, list(codes)
    for r in range(8):
        mine = range(half) if r % 2 == 0 else range(half, len(codes))
        other = [c for i, c in enumerate(state) if i not in mine]
        d = hashlib.sha256("|".join([key, tweak, str(r), ",".join(map(str, other))]).encode()).hexdigest()
        for i in mine:
            state[i] = (state[i] + int(d[(i % 16) * 4 :][:4], 16)) % radix[i]
    return state


def plain_text(text, key, tweak):
    span = [next(((a, b - a + 1) for a, b in P.SCRIPTS if a <= ord(c) <= b), (ord(c), 1)) for c in text]
    out = feistel([ord(c) - a for c, (a, _) in zip(text, span, strict=True)], [n for _, n in span], key, tweak)
    return "".join(chr(a + c) for (a, _), c in zip(span, out, strict=True))


def test_pseudonyms_equal_a_plain_feistel_network(spark):
    key, rng = "k", random.Random(3)
    rows, want = [], []

    def add(item, new):
        rows.append(f"x {item} y")
        want.append(f"x {new} y")

    for _ in range(25):
        local = "".join(rng.choice("abcXYZ019.-_éжλ漢") for _ in range(rng.randint(1, 12))).strip(".-_") or "a"
        add(f"{local}@mail.example.org", plain_text(local, key, f"email{len(local)}") + "@mail.example.org")
        d = "".join(rng.choice("0123456789") for _ in range(10))
        p = plain_text(d, key, "phone")
        add(f"({d[:3]}) {d[3:6]}-{d[6:]}", f"({p[:3]}) {p[3:6]}-{p[6:]}")
        add(f"+49 {d[:3]}.{d[3:6]}.{d[6:]}", f"+49 {p[:3]}.{p[3:6]}.{p[6:]}")
        day = date(1800, 1, 1) + timedelta(days=rng.randrange(146097))
        n = (day - date(1800, 1, 1)).days
        q, r = feistel([n // 773, n % 773], [189, 773], key, "date")
        new = date(1800, 1, 1) + timedelta(days=q * 773 + r)
        for form in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%Y/%m/%d"):
            add(day.strftime(form).zfill(10), new.strftime(form).zfill(10))
        area = rng.choice([a for a in range(1, 900) if a != 666])
        ssn = (area, rng.randint(1, 99), rng.randint(1, 9999))
        m = feistel([area - (2 if area > 666 else 1), ssn[1] - 1, ssn[2] - 1], [898, 99, 9999], key, "ssn")
        add("%03d-%02d-%04d" % ssn, "%03d-%02d-%04d" % (m[0] + (2 if m[0] >= 665 else 1), m[1] + 1, m[2] + 1))
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        check = lambda b: str((10 - sum(int(x) if i % 2 else (2 * int(x) - 9 * (int(x) > 4)) for i, x in enumerate(reversed(b)))) % 10)
        card, new_body = body + check(body), plain_text(body, key, "card16")
        new_card = new_body + check(new_body)
        add(card, new_card)
        add("-".join(card[i : i + 4] for i in (0, 4, 8, 12)), "-".join(new_card[i : i + 4] for i in (0, 4, 8, 12)))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [r.text for r in P.pseudonymize(df, key).orderBy("doc_id").collect()]
    assert got == want


def test_pseudonym_edges(spark):
    text = "mail мария@example.com iban DE89 3704 0044 0532 0130 00 and DE89370400440532013000 not DE00370400440532013000"
    rows = [(1, text), (1, text), (None, None), (2, ""), (3, "lorem " * 30_000 + "a@b.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit("f")).withColumn("new", F.lit("n")).withColumn("n", F.lit("old"))
    out = P.pseudonymize(df, "k", count="n")
    assert sorted(out.columns) == sorted(df.columns) and out.where("found = 'f' and new = 'n'").count() == 5
    got = [(r.doc_id, r.text, r.n) for r in out.collect()]
    ones = {g for g in got if g[0] == 1}
    assert len(ones) == 1 and sum(g[0] == 1 for g in got) == 2
    new = ones.pop()[1]
    spaced, joined = re.search(r"iban (DE\d\d(?: \d{4}){4} \d\d)", new)[1], re.search(r"and (DE\d{20})", new)[1]
    value = joined[4:] + "1314" + joined[2:4]
    assert spaced.replace(" ", "") == joined != "DE89370400440532013000" and int(value) % 97 == 1 and "DE00370400440532013000" in new and "мария" not in new
    assert re.search(r"mail \w{5}@example\.com", new) and len(new) == len(text)
    assert (None, None, 0) in got and (2, "", 0) in got and P.pseudonymize(df.limit(0), "k").count() == 0


def test_the_key_is_drawn_or_set_and_plans_leave_it_out(spark):
    rule = "spark.sql.redaction.string.regex"
    df = spark.createDataFrame([(1, "mail a.user@example.com")], "doc_id long, text string")
    try:
        spark.conf.unset(KEY_SETTING)
        drawn = secret(spark)
        assert len(drawn) == 64 and secret(spark) == drawn
        shown = P.pseudonymize(df, drawn)._jdf.queryExecution().toString()
        assert drawn not in shown and "redacted" in shown
        spark.conf.unset(KEY_SETTING)
        assert secret(spark) != drawn
        spark.conf.set(KEY_SETTING, "own")
        assert secret(spark) == "own"
    finally:
        spark.conf.unset(KEY_SETTING)
        spark.conf.unset(rule)


def test_a_window_of_very_many_items_and_rows_without_an_id(spark):
    """Every item shares a window; names are rows of a join, and repeated documents keep their own."""
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(words[:10])) for i in range(3000)] + [(None, " ".join(words[2:12])), (7000, "w11")]
    docs = [(1, " ".join(words)), (1, " ".join(words)), (None, " ".join(words[:11])), (2, "w11 w10"), (3, "w1"), (4, None)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    for block in (200_000, 1):
        got = sorted(((r.doc_id or 0, r.n_hit, len(r["items"]), "7000" in r["items"]) for r in decontaminate(spark, frame(docs, "doc_id"), frame(items, "item_id"), block_windows=block).collect()))
        assert got == [(0, 10, 3000, False), (1, 12, 3001, True), (1, 12, 3001, True), (2, 1, 1, True), (3, 0, 0, False), (4, 0, 0, False)]


def test_a_star_is_one_component_and_its_centre_can_be_split(spark):
    star = spark.range(1, 20_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(30_000, 30_040).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(spark, star.unionByName(chain))
    assert {(r.component, r.n) for r in got.groupBy("component").agg(F.count("*").alias("n")).collect()} == {(0, 20_001), (30_000, 41)}


@pytest.mark.parametrize("held", [4, 50, 1 << 20])
def test_contracted_edges_connect_the_same_nodes(monkeypatch, held):
    monkeypatch.setattr(graph, "HELD", held)
    rng = np.random.default_rng(3)
    for nodes, edges in ((1, 3), (40, 30), (300, 280), (300, 2000)):
        a, b = rng.integers(-nodes, nodes, (2, edges)) * (1 << 40)
        batches = [pa.RecordBatch.from_arrays([pa.array(a[i : i + 7]), pa.array(b[i : i + 7])], names=["a", "b"]) for i in range(0, edges, 7)]
        out = [e for batch in graph._contract(iter(batches)) for e in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        want, got = _least(zip(a.tolist(), b.tolist(), strict=True)), _least(out)
        assert {n: c for n, c in want.items() if n != c} == {n: c for n, c in got.items() if n != c}
        assert all(x > y for x, y in out) and (held < edges or len(out) == sum(n != c for n, c in want.items()))
    assert list(graph._contract(iter([]))) == []


def _least(edges):
    """The least node that each node reaches, by walking."""
    near = {}
    for x, y in edges:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    out = {}
    for start in sorted(near):
        todo = [start] if start not in out else []
        while todo:
            n = todo.pop()
            if n not in out:
                out[n] = start
                todo += near[n]
    return out


def test_components_of_null_ends_loops_narrow_ids_and_no_edges(spark):
    rows = [(1, None), (None, 2), (3, 3), (5, 4), (4, 5), (6, 5), (6, 5), (9, 8)]
    for kind in ("int", "bigint"):
        edges = spark.createDataFrame(rows, f"a {kind}, b {kind}").withColumn("node", F.lit(0))
        assert {(r.node, r.component) for r in components(spark, edges).collect()} == {(5, 4), (6, 4), (4, 4), (9, 8), (8, 8)}
    assert components(spark, edges.limit(0)).count() == 0


def test_rows_whose_names_clash_are_not_taken_for_repeats(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "row_key", lambda doc_id, text: F.xxhash64(F.length(text)))  # clashes for all texts of one length
    texts = ["alpha beta gamma", "delta beta omega", "delta beta omega", None, "a b c d e f g h"]
    df = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert sorted(r.text or "" for r in keep_one(spark, df).collect()) == ["", "a b c d e f g h", "alpha beta gamma", "delta beta omega", "delta beta omega"]
    assert keep_one(spark, df.union(df)).count() == 5


def test_license_base_columns_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = "cc by general public license all rights reserved the CC-BY Gnu é x".split()
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", LONG + "all rights reserved", "cc by cc by"]
    want = []
    for i, t in enumerate(texts):
        w = [x.decode() for x in WORDS.findall(lower(t))]
        places = [(k, label) for phrase, label in BASE.items() for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
        at = [k for k, _ in places]
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    out = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("__t", F.lit(1))).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out) == want
    assert all({*r.base_labels.split(",")} - {""} <= {*r.labels.split(",")} and 0 <= r.score <= 1 for r in out)
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("SPDX-License-Identifier: Apache-2.0\nint main", {"apache-2.0"}),
        ("SPDX-License-Identifier: GPL-2.0-only", {"gpl-2.0"}),
        ("SPDX-License-Identifier: MIT", {"mit"}),
        ("SPDX-License-Identifier: MIT OR (Apache-2.0 AND BSD-3-Clause)", {"mit", "apache-2.0", "bsd-3-clause"}),
        ("GNU Lesser General Public License, version 2.1", {"gpl", "lgpl-2.1"}),
        ("Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa-4.0"}),
        ("Unmentioned words only", set()),
    ],
)
def test_license_labels(spark, text, labels):
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert {*row.labels.split(",")} - {""} == labels


def test_license_suppression_equals_brute_force():
    rng = random.Random(5)
    known = rules()
    assert len({r.pattern for r in known}) == len(known) >= 300
    for _ in range(200):
        found = []
        for _ in range(rng.randint(0, 12)):
            a = rng.randint(0, 20)
            found.append((a, a + rng.randint(1, 8), known[rng.randrange(len(known))]))
        kept = []
        for f in sorted(found, key=lambda f: (f[2].priority, f[0] - f[1], f[0])):
            if not any((k[0] <= f[0] and f[1] <= k[1]) or (f[0] <= k[0] and k[1] <= f[1]) for k in kept):
                kept.append(f)
        assert sorted((a, b, r.priority) for a, b, r in suppress(found)) == sorted((a, b, r.priority) for a, b, r in kept)
    same = [(0, 5, known[1]), (0, 5, known[0])]
    assert suppress(same) == [(0, 5, known[0])] and len(scanner().anchors) > 100


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    n = labels.sum()
    return (rank[labels].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_classifiers_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    asked = docs.join(labels.where(held), "doc_id").select("doc_id", "text", "toxic", "quality")
    toxic = score_toxicity(asked, fit_toxicity(docs, labels)).select("score", "toxic").where("toxic is not null").toPandas()
    assert len(toxic) > 500 and auc(toxic.score.to_numpy(), toxic.toxic.to_numpy() == 1) > 0.97
    hit = toxic.score >= 0.3
    assert hit[toxic.toxic == 1].mean() > 0.75 and hit[toxic.toxic == 0].mean() < 0.02
    ratings = labels.select("doc_id", (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).cast("int").alias("grade"))
    good = score_quality(asked, fit_quality(docs, ratings, "grade", 3)).where("quality is not null").select("expected_grade", "tail_probability", "quality").toPandas()
    assert auc(good.tail_probability.to_numpy(), good.quality.to_numpy() == 1) > 0.97
    assert ((good.expected_grade >= 0) & (good.expected_grade <= 2)).all()


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(i, "vile words here" if i % 2 else "nice words here") for i in range(200)] + [(1, "vile words here")] * 500 + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)] + [(None, 1, 1), (5, None, None), (9999, 1, 1)], "doc_id long, toxic int, quality int")
    assert len(collect_features(labelled_rows(docs, labels, "toxic", 50), word_features, 12, 50)) <= 50
    probe = spark.createDataFrame([(1, "vile words", 9), (2, "nice words", 9), (3, None, 9), (4, "", 9), (4, "", 9)], "doc_id long, text string, score int")
    got = sorted((r.doc_id, round(r.score, 6)) for r in score_toxicity(probe, fit_toxicity(docs, labels)).collect())
    assert len(got) == 5 and got[0][1] > got[1][1] and got[2][1] == got[3][1] == got[4][1]
    assert {r.score for r in score_toxicity(probe, fit_toxicity(docs, labels.limit(0))).collect()} == {0.0}
    assert {r.score for r in score_toxicity(probe, fit_toxicity(docs, labels.withColumn("toxic", F.lit(0)))).collect()} == {0.0}
    ratings = labels.select("doc_id", F.col("quality").alias("grade"))
    out = score_quality(probe, fit_quality(docs, ratings, "grade", 2)).orderBy("doc_id").collect()
    assert out[0].tail_probability > out[1].tail_probability and [r.score for r in out] == [9] * 5
    assert score_quality(probe.limit(0), fit_quality(docs, ratings.limit(0), "grade", 2)).count() == 0 and score_toxicity(probe.limit(0), fit_toxicity(docs.limit(0), labels)).count() == 0


def test_mixing_ties_and_missing_ids(spark):
    rows = [(None, "a", f"text {i}", 5) for i in range(6)] + [(1, "a", "x", 5), (1, "a", "x", 5), (2, None, "y", 4), (3, "a", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, k long").withColumn("rest", F.lit(1)).withColumn("whole", F.lit("w"))
    once = mix(df, ["source"], {}, F.col("k"), part_of_all=1.0, epochs=1).collect()
    assert sorted((r.doc_id or 0, r.source, r.take_tokens) for r in once) == [(0, "a", 5)] * 6 + [(1, "a", 5)] * 2 + [(2, "", 4)]
    half = mix(df, ["source"], {}, F.col("k"), part_of_all=0.5, epochs=1)
    assert half.agg(F.sum("take_tokens")).first()[0] == 22 and half.where("take_tokens < 1 or take_tokens > n_tokens").count() == 0


def brute_mixture(rows, levels, weights, budget_part, epochs, seed):
    """The mix of a small table in plain Python."""
    leaves = {}
    for r in rows:
        if r["n"]:
            leaves.setdefault(tuple(r[x] for x in levels), []).append(r)
    cap = {k: float(sum(r["n"] for r in v) * epochs) for k, v in leaves.items()}

    def split(prefix, budget):
        if len(prefix) == len(levels):
            return {prefix: budget}
        kids = sorted({k[len(prefix)] for k in leaves if k[: len(prefix)] == prefix})
        room = {c: sum(v for k, v in cap.items() if k[: len(prefix) + 1] == (*prefix, c)) for c in kids}
        weight = {c: weights.get(levels[len(prefix)], {}).get(c, 1.0) for c in kids}
        left, open_, got = budget, set(kids), {}
        while True:
            full = [c for c in open_ if room[c] <= left * weight[c] / sum(weight[x] for x in open_) + 1e-9]
            if not full:
                break
            c = min(full, key=lambda c: room[c] / weight[c])
            got[c] = room[c]
            left -= room[c]
            open_.remove(c)
            if not open_:
                break
        got |= {c: left * weight[c] / sum(weight[x] for x in open_) for c in open_}
        return {k: v for c in kids for k, v in split((*prefix, c), got[c]).items()}

    total = sum(r["n"] for r in rows)
    out = []
    for leaf, budget in split((), min(total * budget_part, sum(cap.values()))).items():
        budget, own = int(budget + 1e-6), leaves[leaf]
        size = sum(r["n"] for r in own)
        whole, rest = divmod(budget, size)
        for r in own:
            out += [(r["doc_id"], *leaf, e, r["n"], r["n"]) for e in range(whole)]
        for r in sorted(own, key=lambda r: (hashlib.md5(f"{seed}:{whole}:{r['doc_id']}".encode()).hexdigest(), r["n"])):
            if rest <= 0:
                break
            out.append((r["doc_id"], *leaf, whole, r["n"], min(r["n"], rest)))
            rest -= r["n"]
    return sorted(out)


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All five stages on a small table with repeated and null ids, nulls, and clashing names."""
    import corpus_pipeline
    from shotweave.llm.queries import EPOCHS, LEVELS, PART, SEED, WEIGHTS

    rng = random.Random(11)
    word = lambda: rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("klmnpr") + str(rng.randint(0, 60))
    rows = []
    for i in range(160):
        w = [word() for _ in range(rng.randint(20, 60))]
        if i % 8 == 1:
            w[3:5] = ["vileword", "hatefulword"]
        rows.append([i, " ".join(w), ["en", "de", None][i % 3], f"source-{i % 7}", 1])
    benchmark = " ".join(f"bench{k}" for k in range(12))
    rows[10][1] += " " + benchmark
    rows += [[200, rows[2][1], "en", "source-1", 1], [201, rows[4][1] + " tail", "en", "source-1", 1], [20, "other words entirely " + rows[6][1][:40], "en", "source-2", 1], [None, None, "en", "source-1", 1], [202, "", "de", None, 1], [20, rows[20][1], "en", "source-6", 1], [203, "write to a.b@example.org soon", "en", "source-3", 1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int").withColumn("row_key", F.lit("own"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 1)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", benchmark)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, stages = str(tmp_path), dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "benchmark", "pseudonyms", "mixture"]
    key = lambda r: (r.doc_id, r.text)

    clean = stages["toxicity"](spark, docs, d)
    got = {key(r) for r in clean.collect()}
    assert clean.columns == docs.columns and got == {(r[0], r[1]) for r in rows if "vileword" not in (r[1] or "")}

    single = stages["near_duplicates"](spark, clean, d)
    kept = [key(r) for r in single.collect()]
    texts = {i: t for i, t in enumerate(sorted({t for _, t in got if t is not None}))}
    group = {texts[i]: c for i, (_, c) in brute_components(list(texts.items()), 5, 80).items()}
    words = lambda t: bool(SPACED.findall((t or "").encode()))
    assert single.columns == docs.columns and len(kept) == len(set(kept)) and set(kept) <= got
    assert sorted(group[t] for _, t in kept if words(t)) == sorted({group[t] for _, t in got if words(t)})
    assert {k for k in kept if not words(k[1])} == {k for k in got if not words(k[1])}

    rest = stages["benchmark"](spark, single, d)
    left = [key(r) for r in rest.collect()]
    assert rest.columns == docs.columns and sorted(left, key=str) == sorted((k for k in kept if "bench3" not in (k[1] or "")), key=str) and len(left) == len(kept) - 1

    masked = stages["pseudonyms"](spark, rest, d)
    new = {r.doc_id: r.text for r in masked.where("doc_id = 203").collect()}
    assert masked.columns == docs.columns and masked.count() == len(left) and "a.b@" not in new[203] and new[203].endswith("@example.org soon")

    mixed = stages["mixture"](spark, masked, d)
    domain = lambda s: ["web", "web", "books"][n] if (n := int(m[1]) % 4 if (m := re.search(r"(\d+)", s or "")) else 9) < 3 else "forum"
    plain = [{"doc_id": r.doc_id, "domain": domain(r.source), "lang": r.lang or "", "source": r.source or "", "n": len(SPACED.findall((r.text or "").encode()))} for r in masked.collect()]
    have = sorted((r.doc_id, r.domain, r.lang, r.source, r.epoch, r.n_tokens, r.take_tokens) for r in mixed.collect())
    assert have == brute_mixture(plain, LEVELS, WEIGHTS, PART, EPOCHS, SEED)
    assert corpus_pipeline.run(spark, d).count() == len(have)

    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0, name
    assert spark.range(2).select(row_key(F.lit(None).cast("long"), F.lit(None).cast("string")).alias("k")).distinct().count() == 1
