"""Set overlap, exact vector and lexical search, ranks, quantiles: against plain versions on random data."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions.columns import STOPWORDS
from lattica.functions.storage import table
from lattica.operators import detectors, overlap, retrieval, structure
from lattica.operators.quantiles import quantiles


def zipf_sets(seed, items, features):
    rng = random.Random(seed)
    weights = [1 / (k + 1) for k in range(features)]
    sets = {k: set(rng.choices(range(features), weights, k=rng.randrange(1, 14))) for k in range(items)}
    for k in range(0, items, 7):  # relatives
        sets[k] = set(sets[(k + 3) % items]) | {rng.randrange(features)}
    return sets


@pytest.mark.parametrize("least,share", [(4, 0.6), (2, 0.9), (1, 0.34), (3, 1.0)])
def test_overlap_is_all_pairs(spark, least, share):
    sets = zipf_sets(least, 120, 150)
    rows = spark.createDataFrame([(i, f) for i, s in sets.items() for f in s] + [(5, f) for f in sets[5]], "item int, feature int")
    got = {(r.a, r.b): set(r.shared) for r in overlap.overlap_pairs(rows, least, share).collect()}
    want = {}
    for a in sets:
        for b in sets:
            small, both = min(len(sets[a]), len(sets[b])), sets[a] & sets[b]
            if a < b and small >= least and len(both) >= least and len(both) >= share * small:
                want[a, b] = both
    assert got == want and want


def test_hot_features_make_no_pairs(spark):
    """Every set holds the same two features; candidates come from the rare ones only."""
    n = 400
    rows = spark.range(n).select(F.col("id").alias("item"), F.explode(F.array(F.lit(-1), F.lit(-2), F.col("id") * 2 + 100, F.col("id") * 2 + 101, F.floor(F.col("id") / 2) + 10_000)).alias("feature"))
    sets = table(overlap._sets(rows, []), "sets")
    need = F.greatest(F.lit(3), F.ceil(F.lit(0.6) * F.col("size")).cast("int"))
    assert overlap.candidates(sets, [], need, 3).count() <= n
    assert overlap.overlap_pairs(rows, 3, 0.6).count() == n // 2


def test_parallel_preparation_stays_in_its_operation(spark):
    methods = [("p", "o", m) for m in "abc"] + [("p", "x", "d"), ("q", "o", "a"), ("q", "o", "b")]
    features = [(m, "path", f) for m in "abd" for f in "123"] + [(m, "key", "k") for m in "abd"] + [("c", "key", f) for f in "klmn"] + [("a", "path", "9")]
    got = structure.parallel_preparation(spark.createDataFrame(methods, "port string, operation string, method string"), spark.createDataFrame(features, "method string, kind string, feature string"))
    assert [tuple(r) for r in got.collect()] == [("a", "b", 3, 1)]
    assert detectors.parallel_pairs(spark.createDataFrame([], "item int, feature int")).count() == 0


@pytest.mark.parametrize("words", [0, 4])
def test_pairs_are_put_out_once_without_a_table_or_broadcast_of_them(spark, monkeypatch, words):
    """Pairs were written as a table and shuffled, their sets joined by a broadcast that outgrew the driver."""
    monkeypatch.setattr(overlap, "WORDS", words)
    wrote = []
    monkeypatch.setattr(overlap, "table", lambda df, name: wrote.append(name) or table(df, name))
    sets = zipf_sets(5, 80, 60)
    rows = spark.createDataFrame([(i, f) for i, s in sets.items() for f in s], "item int, feature int")
    pairs, members = overlap.overlap_groups(rows, 3, 0.5, counts={"odd": lambda f: f % 2 == 1})
    of = {r["item"]: r["of"] for r in members.collect()}
    want = {(a, b): (len(sets[a] & sets[b]), sum(f % 2 for f in sets[a] & sets[b])) for a in set(of.values()) for b in set(of.values()) if a < b and len(sets[a] & sets[b]) >= max(3, 0.5 * min(len(sets[a]), len(sets[b])))}
    got = [(r["a"], r["b"], r["n_shared"], r["odd"]) for r in pairs.where("a < b").collect()]
    assert sorted(got) == sorted((*k, *v) for k, v in want.items()) and want
    assert wrote == ["numbered", "looks", "classes"]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=merge)") == 1


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_groups_hold_all_pairs(spark, monkeypatch, most):
    """Pairs of representatives and membership give every pair back, whatever the number of members that meet at once; copies add none."""
    monkeypatch.setattr(overlap, "MOST_TOGETHER", most)
    sets = zipf_sets(11, 60, 40)
    rows = [(c * 100 + i, f) for c in range(4) for i, s in sets.items() for f in s]
    df = spark.createDataFrame(rows, "item int, feature int")
    got = detectors.parallel_groups(df, 3, 0.5).collect()
    of = {r.a: r.b for r in got if r.role == "member"}
    pairs = {(r.a, r.b): r.shared for r in got if r.role == "pair"}
    want = {(r.a, r.b): r.shared for r in detectors.parallel_pairs(df, 3, 0.5).collect()}
    back = {}
    for a in of:
        for b in of:
            key = tuple(sorted((of[a], of[b])))
            if a < b and key in pairs:
                back[a, b] = pairs[key]
    assert back == want and len(want) > 10 * len(pairs)
    assert all(of[i] == min(of[i], i) for i in of) and set(of.values()) <= set(range(60))


def test_preparation_groups_write_no_row_per_pair_of_copies(spark):
    methods = [("p", "o", f"m{c:02}") for c in range(20)] + [("p", "x", "m99")]
    features = [(m, "path", f) for _, _, m in methods for f in "1234"]
    got = structure.preparation_groups(spark.createDataFrame(methods, "port string, operation string, method string"), spark.createDataFrame(features, "method string, kind string, feature string")).collect()
    assert [tuple(r) for r in got if r.role == "pair"] == [("pair", "p", "o", "m00", "m00", 4, 0)]
    assert sorted((r.operation, r.a, r.b) for r in got if r.role == "member") == [("o", m, "m00") for _, o, m in methods if o == "o"] + [("x", "m99", "m99")]


def test_scattered_concepts(spark):
    owners = spark.createDataFrame([("o1", "pkg", "ledger", "Account"), ("o2", "pkg", "account_db", "Account"), ("o3", "other", "ledger", "Account")], "owner string, package string, stem string, abstraction string")
    words = spark.createDataFrame([("Account", "account"), ("Account", "ab")], "abstraction string, word string")
    mentions = spark.createDataFrame([(p, "ledger") for p in ("pkg/a", "pkg/b", "pkg", "pkgs/c", "x", "y", "x")] + [(p, "account_db") for p in "uvw"], "path string, stem string")
    got = {(r.owner, r.modules) for r in detectors.scattered_concepts(owners, words, mentions, 3).collect()}
    assert got == {("o1", 3), ("o3", 6)}


@pytest.mark.parametrize("block", [3, 512])
def test_dense_search_is_brute_force(spark, monkeypatch, block):
    """Many tasks and blocks, ties, chunks of one document apart, odd vectors."""
    monkeypatch.setattr(retrieval, "BLOCK", block)
    rng = np.random.default_rng(block)
    vectors = rng.integers(-2, 3, (300, 5)).astype(float)
    chunks = [(f"d{k % 90:02}", v.tolist()) for k, v in enumerate(vectors)] + [("null", None), ("short", [1.0, 2.0]), ("zero", [0.0] * 5), ("nan", [float("nan")] * 5), (None, [1.0] * 5)]
    asked = [(q, rng.integers(-2, 3, 5).astype(float).tolist()) for q in range(20)] + [(20, [0.0] * 5), (21, None)]
    got = retrieval.dense_search(spark.createDataFrame(chunks, "document string, embedding array<double>").repartition(7), spark.createDataFrame(asked, "query int, vector array<double>"), 6)
    want = []
    for q, v in asked:
        if v is None or not any(v):
            continue
        best = collections.defaultdict(lambda: -2.0)
        for d, e in chunks:
            if d and e is not None and len(e) == 5 and any(e) and not math.isnan(e[0]):
                best[d] = max(best[d], round(float(np.dot(e, v) / np.linalg.norm(e) / np.linalg.norm(v)), 6) + 0.0)
        want += [(q, d, s, k + 1) for k, (d, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:6])]
    rows = sorted((r["query"], r.document, r.score + 0.0, r["rank"]) for r in got.collect())
    assert [x[:2] + x[3:] for x in rows] == [x[:2] + x[3:] for x in sorted(want)]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(rows, sorted(want)))


def plain_bm25(docs, queries):
    words = {c: [w for w in re.findall("[a-z0-9]+", t.lower()) if w not in STOPWORDS] for c, _, t in docs}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    df = collections.Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for q, text in queries:
        best = collections.defaultdict(float)
        for c, d, _ in docs:
            tf, s = collections.Counter(words[c]), 0.0
            for w in re.findall("[a-z0-9]+", text.lower()):
                if tf[w]:
                    s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(words[c]) / mean))
            best[d] = max(best[d], s)
        out[q] = sorted(((round(s, 6), d) for d, s in best.items() if s > 0), key=lambda x: (-x[0], x[1]))
    return out


def test_bm25_with_bars_is_the_whole_ranking(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(80)]
    weights = [1 / (k + 1) for k in range(80)]
    docs = [(c, c // 2, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for c in range(300)]
    docs[10] = (10, 5, docs[40][2])
    queries = [(q, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for q in range(25)] + [(90, "the of"), (91, "nowhere")]
    full = plain_bm25(docs, queries)
    index = retrieval.bm25_index(spark.createDataFrame(docs, "chunk int, document int, text string"), spark.createDataFrame(queries, "query int, text string"))
    for k in (1, 7):
        got = sorted((r["query"], r["rank"], r.document, r.score) for r in retrieval.bm25(index, k).collect())
        want = sorted((q, i + 1, d, s) for q, rows in full.items() for i, (s, d) in enumerate(rows[:k]))
        assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want))
    judged = [(q, rng.randrange(150)) for q, _ in queries for _ in range(4)]
    places = {q: {d: i + 1 for i, (_, d) in enumerate(rows)} for q, rows in full.items()}
    got = {(r["query"], r.document): r["rank"] for r in retrieval.bm25_ranks(index, spark.createDataFrame(judged, "query int, document int")).collect()}
    assert got == {(q, d): places[q][d] for q, d in judged if d in places[q]} and got


def test_bars_leave_frequent_terms_unread(spark):
    """A word that all documents hold can't lift one to the bar: chunks that hold only it are not scored."""
    docs = [(k, k, "common " + ("rare " * 3 if k < 5 else f"other{k}")) for k in range(500)]
    index = retrieval.bm25_index(spark.createDataFrame(docs, "chunk int, document int, text string"), spark.createDataFrame([(1, "common rare")], "query int, text string"))
    bars = spark.createDataFrame([(1, 1.0)], "query int, bar double")
    assert retrieval._scores(index, bars).count() == 5


def test_only_what_reaches_a_bar_leaves_its_task(spark):
    """Many hold a term that alone may reach the bar, one reaches it; a term that only shares a checksum with an asked one has no weight."""
    docs = [(k, k, "rare" + " filler" * (k + 1) * 50) for k in range(200)] + [(200, 200, "rare rare rare"), (201, 201, None), (202, None, "rare")]
    index = retrieval.bm25_index(spark.createDataFrame(docs, "chunk int, document int, text string"), spark.createDataFrame([(1, "rare")], "query int, text string"))
    top = retrieval.bm25(index, 1).first()
    assert top.document == 200
    assert retrieval._scores(index, spark.createDataFrame([(1, top.score)], "query int, bar double")).count() == 1


def test_blocks_of_queries_and_cells(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(c, c, " ".join(rng.choices([f"w{k}" for k in range(30)], k=rng.randrange(1, 40)))) for c in range(120)]
    queries = [(q, " ".join(rng.choices([f"w{k}" for k in range(30)], k=4))) for q in range(15)]
    full = plain_bm25(docs, queries)
    monkeypatch.setattr(retrieval, "PAIRS", 7)
    monkeypatch.setattr(retrieval, "CELLS", 5)
    index = retrieval.bm25_index(spark.createDataFrame(docs, "chunk int, document int, text string"), spark.createDataFrame(queries, "query int, text string"))
    got = {(r["query"], r["rank"]): r.document for r in retrieval.bm25(index, 3).collect()}
    assert got == {(q, i + 1): d for q, rows in full.items() for i, (_, d) in enumerate(rows[:3])}


def test_holders_of_runs(spark):
    docs = spark.createDataFrame([(1, "x a b c y"), (2, "a b"), (3, None), (4, "b c d a b c a b c"), (None, "a b c"), (5, "a  b c")], "document int, text string")
    seeds = spark.createDataFrame([(10, "a b c"), (11, "b c d"), (12, "a b c")], "query int, seed string")
    got = sorted(((r.document or 0, r["query"]) for r in retrieval.holders(docs, seeds).collect()))
    assert got == [(0, 10), (0, 12), (1, 10), (1, 12), (4, 10), (4, 11), (4, 12)]


def test_quantiles_against_sorted_values(spark):
    rng = random.Random(2)
    groups = {
        "even": [float(rng.randrange(10)) for _ in range(101)],
        "wide": [rng.choice((-1, 1)) * 10.0 ** rng.randrange(-30, 30) for _ in range(300)],
        "one": [7.5],
        "same": [3.0] * 40,
        "two": [1.0, 2.0],
        "near": [1.0 + k * 2**-52 for k in range(50)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("even", None), ("even", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")

    def plain(values, p):
        s = sorted(values)
        at = (len(s) - 1) * p
        lo, hi = s[math.floor(at)], s[math.ceil(at)]
        return lo + (hi - lo) * (at - math.floor(at))

    at = {"low": 0.0, "median": 0.5, "p95": 0.95, "high": 1.0}
    got = {r.g: r for r in quantiles(df, ["g"], "v", at).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values)
        assert all(got[g][name] == pytest.approx(plain(values, p), rel=1e-12) for name, p in at.items()), g
    whole = quantiles(df.where("g = 'even'"), [], "v", {"q": 0.25}).first()
    assert whole.q == plain(groups["even"], 0.25)
    assert quantiles(df.limit(0), ["g"], "v", at).count() == 0


def test_summary_levels(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.5, 0.5, 0.0), (2, 0.0, 0.5, 0.0, 1.0), (3, 0.5, 0.5, 0.25, 1.0)], "query int, recall double, reciprocal_rank double, average_precision double, ndcg double")
    labels = spark.createDataFrame([(1, "p", "k"), (2, "p", "l"), (3, "q", "l")], "query int, pattern string, kind string")
    got = {(r.level, r.pattern, r.kind): (r.queries, r.recall) for r in retrieval.summary(rows, labels).collect()}
    assert got == {("overall", None, None): (3, 0.5), ("pattern", "p", None): (2, 0.5), ("pattern", "q", None): (1, 0.5), ("kind", None, "k"): (1, 1.0), ("kind", None, "l"): (2, 0.25)}
