"""Ranked lexical search with a two-level index: byte impacts for bounds, exact integers for scores.

A term is a maximal run of ASCII letters and digits and of all characters beyond ASCII, A-Z lowered.
A document's score sums, over the distinct terms of an item, weight * saturation. The weight of a
term falls with its document frequency; the saturation (below a million) rises with its
occurrences in the document and falls with the document's length.

The index has one row per block of documents (about 1 MB of text): its sorted term hashes with
postings in order of term and document. Level one keeps of a posting its saturation in one byte,
rounded up in steps of ``STEP``; level two its occurrences, and of a document its length. Columns
of the other level are not read. A search goes over blocks of items:

1. document frequencies of the items' terms, from the block rows' posting counts,
2. level one: a document's upper bound is the sum of weight * step * byte, its lower bound
   takes one step less per term; each task keeps the k best lower bounds of an item and the k-th
   best of them all is the item's bar,
3. every document whose upper bound reaches the bar (all with an upper bound above 0, where fewer
   than k have a lower bound) is scored exactly from level two; tasks pass on their k best.

So what is shuffled is k rows per item and task, and no document is left out that could rank.
Terms are known by 64-bit hashes; with a billion distinct terms two items' terms out of ten
thousand would collide with one of them with a chance of about one in two million.

Defined results: a null text has no terms, like an empty one; documents without terms count for
nothing. Items without terms give no rows; items that share an id are one query of all their
terms, null ids too. Equal scores go by ascending doc_id, null ids last; repeated rows are
ranked each for itself. A very long text is a block of its own. Empty tables give an empty
table. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm import textblock as tb
from lattica.llm.shared import table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 10
TOP = 1_000_000  # saturations are below this
STEP = -(-TOP // 255)
DOCS = 1_024  # documents of a block, at most
ITEMS, PAIRS = 512, 1 << 16  # of a block of items, about: how many, and their (item, term) pairs
INDEX = "doc_ids array<long>, lengths binary, terms binary, starts binary, docs binary, impacts binary, tfs binary"


@dataclass
class Index:
    """The table of blocks, the number of documents with a term, and of all their terms."""

    blocks: DataFrame
    documents: int
    terms: int


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1_000 * tf + 8 * m)


def norms(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Length of each document against the mean, in hundredths, a tenth of it fixed (integers of any size inside)."""
    return np.array([10 + 90 * n * documents // max(terms, 1) for n in lengths.tolist()], np.int64)


def _postings(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one block: lengths, sorted terms, first posting of each, and documents and occurrences of postings."""
    n = len(off) - 1
    s, e, before = tb.word_bounds(data, off, tb.APART)
    lengths = np.diff(before)
    terms, which = np.unique(tb.word_hashes(data, s, e), return_inverse=True)
    key, tf = np.unique(which * np.int64(n) + np.repeat(np.arange(n), lengths), return_counts=True)
    return lengths, terms, np.searchsorted(key, np.arange(len(terms) + 1) * np.int64(n)), key % max(n, 1), tf


def _index(batches: Iterator[pa.RecordBatch], documents: int, terms: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, DOCS):
            batch = whole.slice(a, DOCS)
            for i, n, data, off in tb.blocks(batch.column(1)):
                lengths, words, starts, docs, tfs = _postings(data, off)
                sat = saturation(tfs, norms(lengths, documents, terms)[docs]) if len(docs) else tfs
                cells = (lengths.astype(np.int64), words, starts.astype(np.int32), docs.astype(np.int32), (-(-sat // STEP)).astype(np.uint8), tfs.astype(np.int32))
                ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0).slice(i, n))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x.tobytes()], pa.binary()) for x in cells)], names=["doc_ids", "lengths", "terms", "starts", "docs", "impacts", "tfs"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = terms = 0
    for batch in batches:
        for _, _, data, off in tb.blocks(batch.column(0)):
            many = np.diff(tb.word_bounds(data, off, tb.APART)[2])
            documents, terms = documents + int(np.count_nonzero(many)), terms + int(many.sum())
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], names=["documents", "terms"])


def build(docs: DataFrame) -> Index:
    """Counts documents and terms, then writes the index in the shared folder."""
    size = docs.select("text").mapInArrow(_totals, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = size[0] or 0, size[1] or 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return Index(table(rows.mapInArrow(partial(_index, documents=documents, terms=terms), INDEX), "index"), documents, terms)


def save(index: Index, path: str) -> None:
    """Writes an index to a folder, its totals last: a folder without them is none."""
    index.blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark = index.blocks.sparkSession
    spark.createDataFrame([(index.documents, index.terms)], "documents long, terms long").write.parquet(f"{path}/totals")


def load(spark: SparkSession, path: str) -> Index:
    """The index of a folder, for searches of other sessions."""
    totals = spark.read.parquet(f"{path}/totals").first()
    return Index(spark.read.schema(INDEX).parquet(f"{path}/blocks"), totals[0], totals[1])


class Items:
    """Items and their terms: sorted term hashes, and per term the items that hold it."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        """rows: distinct (item_id, term)."""
        ids = sorted({r[0] for r in rows}, key=lambda x: (x is None, x or 0))
        data, off = tb.flat(pa.array([r[1] for r in rows], pa.string()))
        h = tb.word_hashes(data, off[:-1], off[1:])
        place = {x: k for k, x in enumerate(ids)}
        item = np.array([place[r[0]] for r in rows], np.int64)
        order = np.argsort(h, kind="stable")
        self.ids, self.item = ids, item[order]
        self.terms, self.first = np.unique(h[order], return_index=True)
        self.many = np.diff(np.append(self.first, len(rows)))
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, df: np.ndarray, documents: int) -> None:
        self.weights = np.array([math.floor(1000 * math.log(float(2 * documents + 2) / float(2 * n + 1))) for n in df.tolist()], np.int64)

    def found(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``terms`` of those that items hold, and their places here."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        here = np.flatnonzero(self.terms[at] == terms) if len(self.terms) else np.zeros(0, np.int64)
        return here, at[here]


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (many[0] numbers), then those of first[1]..."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - many), many)


def _array(batch: pa.RecordBatch, column: str, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(column))[row].as_buffer(), kind)


def _df(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    df = np.zeros(len(items.terms), np.int64)
    for batch in batches:
        for r in range(batch.num_rows):
            here, at = items.found(_array(batch, "terms", r, np.uint64))
            starts = _array(batch, "starts", r, np.int32)
            df[at] += starts[here + 1] - starts[here]
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])


class _Block:
    """The postings of one block that items ask for, and the (item, document) cells they add to."""

    def __init__(self, batch: pa.RecordBatch, row: int, items: Items, n: int):
        here, at = items.found(_array(batch, "terms", row, np.uint64))
        starts = _array(batch, "starts", row, np.int32).astype(np.int64)
        many = starts[here + 1] - starts[here]
        self.n, self.items, self.posting, self.term = n, items, _spread(starts[here], many), np.repeat(at, many)
        self.docs = _array(batch, "docs", row, np.int32)[self.posting].astype(np.int64)

    def cells(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of postings, cell = item * n + document, weight), some million at a time."""
        many = self.items.many[self.term]
        ends, a = np.cumsum(many), 0
        while a < len(many):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 20), "right")))
            p = np.repeat(np.arange(a, b), many[a:b])
            item = self.items.item[_spread(self.items.first[self.term[a:b]], many[a:b])]
            yield p, item * self.n + self.docs[p], self.items.weights[self.term[p]]
            a = b

    def bounds(self, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bound of every (item, document)."""
        high = impacts[self.posting].astype(np.int64) * STEP
        low = np.maximum(high - STEP + 1, 0)
        upper = np.zeros(len(self.items.ids) * self.n, np.int64)
        lower = np.zeros_like(upper)
        for p, cell, weight in self.cells():
            np.add.at(upper, cell, weight * high[p])
            np.add.at(lower, cell, weight * low[p])
        return upper.reshape(-1, self.n), lower.reshape(-1, self.n)

    def scores(self, wanted: np.ndarray, tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Exact scores of the wanted cells, 0 elsewhere."""
        sat, flat = saturation(tfs[self.posting].astype(np.int64), m[self.docs]), wanted.ravel()
        out = np.zeros(wanted.size, np.int64)
        for p, cell, weight in self.cells():
            ok = flat[cell]
            np.add.at(out, cell[ok], weight[ok] * sat[p[ok]])
        return out.reshape(wanted.shape)


def _sizes(batch: pa.RecordBatch) -> list[int]:
    return batch.column(0).value_lengths().to_pylist()


def _lower(batches: Iterator[pa.RecordBatch], items: Items, k: int) -> Iterator[pa.RecordBatch]:
    """The task's k best lower bounds of each item, those above 0."""
    best = np.zeros((len(items.ids), k), np.int64)
    for batch in batches:
        for r, n in enumerate(_sizes(batch)):
            _, lower = _Block(batch, r, items, n).bounds(_array(batch, "impacts", r, np.uint8))
            best = -np.partition(-np.concatenate([best, lower], axis=1), k - 1, axis=1)[:, :k]
    item, at = np.nonzero(best)
    yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(best[item, at])], names=["item", "bound"])


def _rescore(batches: Iterator[pa.RecordBatch], items: Items, bars: np.ndarray, k: int, documents: int, terms: int) -> Iterator[pa.RecordBatch]:
    """The task's k best documents of each item by exact score."""
    item, score, ids, null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    for batch in batches:
        for r, n in enumerate(_sizes(batch)):
            block = _Block(batch, r, items, n)
            upper, _ = block.bounds(_array(batch, "impacts", r, np.uint8))
            wanted = upper >= bars[:, None]
            if not wanted.any():
                continue
            exact = block.scores(wanted, _array(batch, "tfs", r, np.int32), norms(_array(batch, "lengths", r, np.int64), documents, terms))
            i, d = np.nonzero(exact)
            own = batch.column(0)[r].values
            item, score = np.concatenate([item, i]), np.concatenate([score, exact[i, d]])
            ids, null = np.concatenate([ids, own.fill_null(0).to_numpy()[d]]), np.concatenate([null, own.is_null().to_numpy(zero_copy_only=False)[d]])
            order = np.lexsort((ids, null, -score, item))
            group = item[order]
            keep = order[np.arange(len(order)) - np.searchsorted(group, group) < k]
            item, score, ids, null = item[keep], score[keep], ids[keep], null[keep]
    names = pa.array(items.ids, pa.int64())
    yield pa.RecordBatch.from_arrays([names.take(pa.array(item)), pa.array(ids, mask=null), pa.array(score)], names=["item_id", "doc_id", "score"])


def search(index: Index, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, those above 0."""
    words = F.regexp_extract_all(F.translate("text", UPPER, SMALL), F.lit(f"({TERM})"), F.lit(1))
    pairs = table(items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(words).alias("term")).distinct(), "items")
    size = pairs.agg(F.count("*"), F.count_distinct("item_id")).first()
    parts = 1 + max(size[0] // PAIRS, size[1] // ITEMS)
    out = index.blocks.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for part in range(parts):
        block = Items([(r[0], r[1]) for r in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()])
        if not block.ids:
            continue
        counts = index.blocks.select("terms", "starts").mapInArrow(partial(_df, items=block), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        df = np.zeros(len(block.terms), np.int64)
        for r in counts.collect():  # at most one row per term of the block
            df[r[0]] = r[1]
        block.weigh(df, index.documents)
        lower = index.blocks.select("doc_ids", "terms", "starts", "docs", "impacts").mapInArrow(partial(_lower, items=block, k=k), "item long, bound long")
        order = Window.partitionBy("item").orderBy(F.desc("bound"))
        bars = np.ones(len(block.ids), np.int64)
        for r in lower.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).where(F.col("at") == k).collect():  # one row per item of the block
            bars[r[0]] = r[1]
        best = partial(_rescore, items=block, bars=bars, k=k, documents=index.documents, terms=index.terms)
        out = out.unionByName(index.blocks.mapInArrow(best, out.schema))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = f"""WITH said AS (
  SELECT r, doc_id, unnest(w) AS term, len(w) AS n
  FROM (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{SMALL}'), '{TERM}') AS w FROM documents)),
size AS (SELECT count(DISTINCT r)::BIGINT AS big_n, count(*)::BIGINT AS big_l FROM said),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{SMALL}'), '{TERM}')) AS term FROM benchmark),
postings AS (SELECT r, doc_id, term, n::BIGINT AS n, count(*)::BIGINT AS tf FROM said WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, size GROUP BY term, big_n),
scores AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // big_l)))))::BIGINT AS score
  FROM postings JOIN weights USING (term) JOIN asked USING (term), size GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= {K}"""
