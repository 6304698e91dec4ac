"""Benchmark passages in training texts: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lowered. A first pass counts, over all documents, the
words that occur in the benchmark. A seed is a run of ``SEED`` words of an item that chance
would bring ``EXPECTED`` times or less per million words, as the words' shares of the corpus
tell (a corpus counts as a million words longer than it is, as small ones tell little); so a
passage that was copied very often stays a seed. Items with fewer than ``FEWEST`` such runs, or
a quarter of theirs, take their least expected ones; an item shorter than a seed is one seed. A second
pass finds the seeds in the texts and aligns the words around them with the item (match +2,
mismatch -1, gap -1); many alignments run at once, one numpy row per item word.

A document holds an item if the best alignment reaches ``CUT`` of the score of a whole copy.
The benchmark is taken in blocks of at most ``ITEM_BYTES`` (a stated set of queries against all
rows); a block is the only thing sent to every task.

Defined results: null or empty texts and items match nothing; an item without words matches
nothing; repeated items match each for itself (rows with the same item_id and text once);
repeated documents give repeated decisions, once per doc_id, with the best score. A null
doc_id is in no result of ``leaks`` and stays in ``keep_clean``. Of a very long text all words are
looked at, and only the windows around seeds are aligned. Without documents or items there are no
leaks. Other columns are ignored by ``leaks`` and carried through by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import textblock as tb

SEED = 3
EXPECTED = 0.05  # chance occurrences of a seed per million words of the corpus
FEWEST = 6
MATCH, MISMATCH, GAP = 2, -1, -1
CUT = 0.5
SLACK = 0.5  # of the item's words, on either side of where a seed puts it
ITEM_BYTES = 8_000_000
CELLS = 4_000_000  # of one batch of alignments


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, before = tb.word_bounds(data, off, tb.APART)
    return tb.word_hashes(data, s, e), before


def _find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


class Items:
    """Words of a block of benchmark items, and the seeds chosen from them."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids = np.array([i for i, _ in rows], np.int64)
        data, off = tb.flat(pc.utf8_lower(pa.array([t for _, t in rows], pa.string())))
        self.words, self.before = _words(data, off)
        self.vocabulary = np.unique(self.words)

    def choose(self, counts: np.ndarray, total: int) -> None:
        """Seeds from the corpus counts of ``vocabulary`` and the corpus's number of words."""
        million = 1e6
        rate = np.log((counts + 0.5) / (total + million))[np.searchsorted(self.vocabulary, self.words)] if len(self.words) else np.zeros(0)
        hashes, item, place = [], [], []
        for k in range(len(self.ids)):
            a, b = self.before[k], self.before[k + 1]
            n = min(SEED, b - a)
            if n == 0:
                continue
            runs = [(float(rate[p : p + n].sum()), p) for p in range(a, b - n + 1)]
            rare = [p for r, p in runs if r + np.log(million) <= np.log(EXPECTED)]
            fewest = max(FEWEST, len(runs) // 4)
            if len(rare) < fewest:
                rare = [p for _, p in sorted(runs)[:fewest]]
            for p in rare:
                hashes.append(self._run(self.words[p : p + n]))
                item.append(k)
                place.append(p - a)
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        self.seeds = np.array(hashes, np.uint64)[order]
        self.item, self.place = np.array(item, np.int64)[order], np.array(place, np.int64)[order]
        self.keys, self.first, self.many = np.unique(self.seeds, return_index=True, return_counts=True)
        self.lengths = sorted({int(min(SEED, n)) for n in np.diff(self.before) if n})

    @staticmethod
    def _run(w: np.ndarray) -> np.uint64:
        return tb.run_hashes(w, np.array([0, len(w)]), len(w))[0][0]


def _counts(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """(place in the vocabulary, occurrences) of this task; place -1 has all words."""
    found, total = np.zeros(len(items.vocabulary), np.int64), 0
    for batch in batches:
        for _, _, data, off in tb.blocks(pc.utf8_lower(batch.column(0))):
            h, _ = _words(data, off)
            at = _find(items.vocabulary, h)
            found += np.bincount(at[at >= 0], minlength=len(found))
            total += len(h)
    some = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(found[some], total))], names=["word", "n"])


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its window of words."""
    out = np.zeros(len(items), np.int32)
    order = sorted(range(len(items)), key=lambda k: (len(items[k]), len(windows[k])))
    while order:
        width, batch = 0, []
        while order and len(batch) * max(width, len(windows[order[-1]])) < CELLS:
            width = max(width, len(windows[order[-1]]))
            batch.append(order.pop())
        tall = max(len(items[k]) for k in batch)
        item, window = np.zeros((len(batch), tall), np.uint64), np.ones((len(batch), width), np.uint64)
        for r, k in enumerate(batch):
            item[r, : len(items[k])], window[r, : len(windows[k])] = items[k], windows[k]
        h = np.zeros((len(batch), width + 1), np.int32)
        step = np.arange(width + 1, dtype=np.int32) * GAP
        best = np.zeros(len(batch), np.int32)
        for i in range(tall):
            s = np.where(window == item[:, i : i + 1], MATCH, MISMATCH).astype(np.int32)
            new = np.maximum(h + GAP, 0)
            new[:, 1:] = np.maximum(new[:, 1:], h[:, :-1] + s)
            h = np.maximum.accumulate(new - step, axis=1) + step  # gaps along the window
            best = np.maximum(best, h.max(axis=1))
        out[batch] = best
    return out


def _leaks(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, n, data, off in tb.blocks(pc.utf8_lower(batch.column(1))):
            h, before = _words(data, off)
            doc, item, at = [], [], []
            for size in items.lengths:
                g, gat = tb.run_hashes(h, before, size)
                where = _find(items.keys, g)
                hit = np.flatnonzero(where >= 0)
                if not len(hit):
                    continue
                owner = np.searchsorted(gat, hit, "right") - 1
                word = hit - gat[owner]  # word of the text where the seed is
                for w, d, p in zip(where[hit].tolist(), owner.tolist(), word.tolist()):
                    for s in range(items.first[w], items.first[w] + items.many[w]):
                        doc.append(d)
                        item.append(int(items.item[s]))
                        at.append(p - int(items.place[s]))
            if not doc:
                continue
            order = np.lexsort((at, item, doc))
            doc, item, at = (np.array(x)[order] for x in (doc, item, at))
            spans: list[tuple[int, int, int, int]] = []
            for d, k, p in zip(doc.tolist(), item.tolist(), at.tolist()):
                size = int(items.before[k + 1] - items.before[k])
                slack = int(SLACK * size) + 1
                lo, hi = max(p - slack, 0), min(p + size + slack, int(before[d + 1] - before[d]))
                if spans and spans[-1][:2] == (d, k) and lo <= spans[-1][3]:
                    spans[-1] = (d, k, spans[-1][2], max(hi, spans[-1][3]))
                else:
                    spans.append((d, k, lo, hi))
            own = [items.words[items.before[k] : items.before[k + 1]] for _, k, _, _ in spans]
            best = align(own, [h[before[d] + lo : before[d] + hi] for d, _, lo, hi in spans])
            share = best / np.array([MATCH * len(x) for x in own])
            keep = np.flatnonzero(share >= CUT)
            ids = batch.column(0).slice(i, n).take(pa.array([spans[k][0] for k in keep], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([int(items.ids[spans[k][1]]) for k in keep], pa.int64()), pa.array(share[keep]), pa.array([spans[k][2] for k in keep], pa.int64()), pa.array([spans[k][3] for k in keep], pa.int64())],
                names=["doc_id", "item_id", "score", "from_word", "to_word"],
            )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score) of documents that hold an item; score 1 is a whole copy.

    ``from_word`` and ``to_word`` bound the words of the text in which the best alignment lies.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + int(size) // ITEM_BYTES
    out = None
    for k in range(parts):
        block = Items([(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).sort("item_id", "text").collect()])
        counts = texts.select("text").mapInArrow(partial(_counts, items=block), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        got = {r[0]: r[1] for r in counts.collect()}  # at most one row per word of the block
        block.choose(np.array([got.get(w, 0) for w in range(len(block.vocabulary))], float), got.get(-1, 0))
        found = texts.mapInArrow(partial(_leaks, items=block), "doc_id long, item_id long, score double, from_word long, to_word long")
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("score", "from_word", "to_word")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.score").alias("score"), F.col("b.from_word").alias("from_word"), F.col("b.to_word").alias("to_word"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item, all their columns."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
