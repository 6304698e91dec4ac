"""Shards, ranked search and resampling against plain versions, their SQL and awkward rows."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import entry, lexical, resample, shards
from lattica.llm import textblock as tb
from lattica.llm.numbering import numbered
from tests.llm.test_llm import DOCS, ODD

SF = "/root/testdata/sf0.01"
LOW = str.maketrans(lexical.UPPER, lexical.SMALL)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_shards", "op12_lexical", "op13_resample"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want


# -- shards


def plain_jump(key, n):
    key, at, to = key % 2**64, -1, 0
    while to < n:
        at = to
        key = (key * shards.MULTIPLIER + 1) % 2**64
        to = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


@pytest.mark.parametrize("n", [1, 2, 24, 62, 63, 1000])
def test_jumps_are_the_plain_loop(spark, n):
    rng = random.Random(n)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), None, *(rng.randrange(-(2**63), 2**63) for _ in range(300)), *range(300)]
    rows = shards.with_shards(spark.createDataFrame([(k,) for k in keys], "id long"), "id", n).collect()
    assert [(r.shard, r.grown_shard) for r in rows] == [(plain_jump(k or 0, n), plain_jump(k or 0, n + 1)) for k in keys]


def test_jumps_of_published_keys(spark):
    rows = spark.createDataFrame([(10863919174838991,), (2016238256797177309,), (1673758223894951030,)], "id long")
    assert [r.shard for r in shards.with_shards(rows, "id", 11).collect()] == [6, 3, 5]


def test_jumps_stay_with_few_steps(spark, monkeypatch):
    monkeypatch.setattr(shards, "JUMPS", 2)
    rows = shards.with_shards(spark.range(500), "id", 300).collect()
    assert [(r.shard, r.grown_shard) for r in rows] == [(plain_jump(k, 300), plain_jump(k, 301)) for k in range(500)]


def test_shards_odd_rows(odd, none):
    rows = shards.place(odd).collect()
    assert len(rows) == len(ODD) and shards.place(none).count() == 0
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), plain_jump(i or 0, 24)) for i, t, *_ in ODD)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 24)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_slots_of_a_hot_key(spark):
    """A key that half of the rows hold spreads over ranges; numbers stay gapless and in order."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), "id", (F.col("id") % 3).alias("g"))
    out = numbered(rows.repartition(5), [F.col("k"), F.col("id")], "at", "g")
    got = sorted((r.g, r.at, r.k, r.id) for r in out.collect())
    assert [x[0:1] + x[2:] for x in got] == sorted(x[0:1] + x[2:] for x in got)
    assert [x[1] for x in got] == [k for g in range(3) for k in range(sum(x[0] == g for x in got))]


def test_written_shards_hold_every_row(spark, odd, tmp_path):
    odd = odd.withColumns({c: F.lit(c) for c in ("_jumps", "row", "key", "file", "grown_shard", "_row")})
    shards.write(odd.withColumn("shard", F.lit("old")), str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(repr, back.select(*odd.columns).collect())) == sorted(map(repr, odd.collect()))
    assert all(r.shard == plain_jump(r.doc_id or 0, 5) for r in back.collect())


def test_growing_moves_no_more_than_needed(spark):
    """From n to n + 1 shards about 1 in n + 1 rows moves, all of them into the new one; shards stay even."""
    docs = spark.range(48_000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"))
    rows = shards.balance(shards.place(docs, 24)).collect()
    assert len(rows) == 24 and sum(r["rows"] for r in rows) == 48_000 and all(r.bytes == 10 * r["rows"] for r in rows)
    assert all(1_700 < r["rows"] < 2_300 for r in rows)
    assert 0.9 * 48_000 / 25 < sum(r.leaving for r in rows) < 1.1 * 48_000 / 25
    assert shards.balance(shards.place(docs.limit(0))).count() == 0


# -- ranked search


def plain_search(docs, items, k=10):
    words = [(i, re.findall(lexical.TERM, (t or "").translate(LOW))) for i, t in docs]
    big_n, big_l = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = collections.Counter(t for _, w in words for t in set(w))
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(re.findall(lexical.TERM, (t or "").translate(LOW)))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, w in words:
            tf, m = collections.Counter(w), 10 + 90 * len(w) * big_n // max(big_l, 1)
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if s > 0:
                scored.append((s, d))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(i, r + 1, d, s) for r, (s, d) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def test_search_odd_rows(spark, odd, none):
    items = [(1, "ONE two ß short"), (1, "text"), (2, None), (3, ""), (None, "short"), (4, "... ---"), (5, "x" * 300_000), (6, "nowhere9"), (7, "ab seven one")]
    table = spark.createDataFrame([(*x, 0.5, 9) for x in items], "item_id long, text string, score double, rank int")
    got = lexical.search(lexical.build(odd), table)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search([x[:2] for x in ODD], items)
    assert lexical.search(lexical.build(none), table).count() == lexical.search(lexical.build(odd), table.where("false")).count() == 0


def test_search_against_every_document(spark, monkeypatch):
    """Many blocks of documents and of items, ties, copies; few terms, so that bounds are close."""
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice((5, 60))]) for _ in range(rng.choice((1, 3, 20, 400)))) for _ in range(400)]
    docs = [(k, texts[k] if k % 5 else texts[0]) for k in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9)))) for k in range(40)]
    monkeypatch.setattr(lexical, "ITEMS", 7)
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items)


def test_an_index_is_kept(spark, odd, tmp_path):
    items = spark.createDataFrame([(1, "one two short")], "item_id long, text string")
    index = lexical.build(odd)
    lexical.save(index, f"file://{tmp_path}/index")
    again = lexical.load(spark, f"file://{tmp_path}/index")
    assert (again.documents, again.terms) == (index.documents, index.terms)
    for k in (1, 3, 50):
        assert sorted(map(tuple, lexical.search(again, items, k).collect())) == sorted(map(tuple, lexical.search(index, items, k).collect()))


def test_few_documents_reach_the_bar(spark, monkeypatch):
    """Bounds leave most documents unscored, and tasks pass on no more than k rows an item."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(20, 200)))) for k in range(3000)]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    items = lexical.Items([(1, w) for w in words[:12]])
    cells, scored = 0, 0
    df = np.zeros(len(items.terms), np.int64)
    rows = index.blocks.toArrow().to_batches()
    for batch in rows:
        for out in lexical._df(iter([batch]), items):
            df[out.column(0).to_numpy()] += out.column(1).to_numpy()
    items.weigh(df, index.documents)
    bars = sorted((b for batch in lexical._lower(iter(rows), items, 10) for b in batch.column(1).to_pylist()), reverse=True)[:10]
    for batch in rows:
        for r, n in enumerate(lexical._sizes(batch)):
            upper, lower = lexical._Block(batch, r, items, n).bounds(lexical._array(batch, "impacts", r, np.uint8))
            exact = lexical._Block(batch, r, items, n).scores(upper >= 0, lexical._array(batch, "tfs", r, np.int32), lexical.norms(lexical._array(batch, "lengths", r, np.int64), index.documents, index.terms))
            assert (lower <= exact).all() and (exact <= upper).all()
            cells, scored = cells + upper.size, scored + int((upper >= bars[-1]).sum())
    assert cells == 3000 and 10 <= scored <= 60


def test_bounds_enclose_scores(spark):
    rng = np.random.default_rng(2)
    tf, n = rng.integers(1, 200, 5000), rng.integers(1, 100_000, 5000)
    sat = lexical.saturation(tf, lexical.norms(n, 1000, 300_000))
    byte = -(-sat // lexical.STEP)
    assert byte.max() <= 255 and (byte * lexical.STEP >= sat).all() and (np.maximum((byte - 1) * lexical.STEP + 1, 0) <= sat).all()


# -- resampling


def plain_buckets(text):
    w = re.findall(resample.WORD, (text or "").translate(LOW))
    return [[zlib.crc32(" ".join(w[i : i + k]).encode()) % resample.BUCKETS for i in range(len(w) - k + 1)] for k in (1, 2, 3)]


def test_run_checksums_are_the_library():
    texts = ["", "a", "One TWO three", "ß é 漢字 tail", "x" * 64 + " " + "y" * 65 + " " + "z" * 5000, "- - -", "a b c d e f g " * 40, "w" * 70_000 + " end"]
    import pyarrow as pa

    data, off = tb.flat(pa.array(texts))
    runs, before = resample.run_buckets(data, off)
    for i, t in enumerate(texts):
        for k, want in enumerate(plain_buckets(t)):
            assert runs[k][before[i] : before[i] + len(want)].tolist() == want


def plain_resample(docs, target, share=(5, 100)):
    held = [sum(plain_buckets(t), []) for _, t in docs]
    s = collections.Counter(b for x in held for b in x)
    t = collections.Counter(b for x in target for part in plain_buckets(x) for b in part)
    big_s, big_t = sum(s.values()) + resample.BUCKETS, sum(t.values()) + resample.BUCKETS
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(resample.BUCKETS)]
    rows = []
    for (i, text), x in zip(docs, held):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        rows.append([i, len(plain_buckets(text)[0]), len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    ready = sorted((r for r in rows if r[1] >= resample.LEAST_WORDS), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(ready[: share[0] * len(ready) // share[1]]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


def test_resample_odd_rows(spark, odd, none):
    target = spark.createDataFrame([("One two three",), (None,), ("",)], "text string")
    got = resample.resample(odd, target, (1, 1))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample([x[:2] for x in ODD], ["One two three", None, ""], (1, 1))
    assert resample.resample(none, target).count() == 0
    assert resample.resample(odd, target.where("false")).count() == len(ODD)
    assert resample.drawn(odd, target, share=(1, 1)).columns == odd.columns


@pytest.mark.parametrize("digit", [3, 12])
def test_resample_against_a_sort(spark, monkeypatch, digit):
    """Copies that share scores, negative and far ids, digits of few bits."""
    monkeypatch.setattr(resample, "DIGIT", digit)
    rng = random.Random(digit)
    words = [f"w{k}" for k in range(40)]
    ids = [rng.choice((k, -k, k << 40, 2**63 - 1 - k)) for k in range(120)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(15, 40)))) for i in ids]
    docs += [docs[3]] * 30 + [(None, docs[5][1])] * 3
    target = [" ".join(rng.choice(words[:10]) for _ in range(20)) for _ in range(5)]
    for share in ((0, 100), (13, 100), (60, 100)):
        got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(x,) for x in target], "text string"), share)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(docs, target, share)


def test_least_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice((-5, 0, 3, 2**62, -(2**63))), rng.choice((1, 2**63 - 1)), k) for k in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    for k in (0, 1, 37, 100, 199, 200):
        assert sorted(map(tuple, df.where(resample.least_keys(df, ["a", "b", "c"], k)).collect())) == sorted(rows)[:k]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_drawn_documents_are_nearer_to_the_target(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    target = docs.where("lang = 'de'").select("text").limit(60)
    langs = docs.select(F.col("doc_id").alias("i"), "lang")
    got = resample.resample(docs, target, (10, 100)).join(langs, F.col("doc_id") == F.col("i"))
    share = {r.drawn: r.de for r in got.groupBy(F.col("rank").isNotNull().alias("drawn")).agg(F.avg((F.col("lang") == "de").cast("double")).alias("de")).collect()}
    assert share[True] > 0.8 > 0.4 > share[False]
