"""Importance resampling of documents towards the distribution of target texts.

Features are runs of 1 to 3 words, hashed into 10,000 buckets by the CRC-32 of their UTF-8 bytes.
Counts of each bucket over all documents and over all target texts give an array of gains (log
ratios in thousandths); a document's weight sums the gains of its features. Checksums
of all runs of a block come from arrays: the state after a word is a linear map of the state before
it, given by the word's length, plus the word's own share, so longer runs cost a few lookups.

To the weight comes a Gumbel variate made from the document's id, so the highest scores are a
sample without replacement with odds in proportion to the weights. The number to draw is known; a
radix selection finds the last drawn key: counts by digit of the composite key (score, id, row)
among the rows that share the digits so far, one distributed count of at most ``1 << DIGIT`` rows
each, until a digit's rows are drawn whole. Only drawn rows are sorted, by ranges, and ranked.

Defined results: null and empty texts have no words, no features and weight 0. Documents with fewer
than ``LEAST_WORDS`` words are scored but never drawn. A null id counts as an empty string in the
variate and comes after all ids among equal scores. Rows that share score and id are drawn in
the order of the scan. A very long text is handled as one block. Empty tables: no documents
give an empty table, no target texts make all gains those of a target without features. Other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import textblock as tb
from lattica.llm.lexical import SMALL, UPPER
from lattica.llm.numbering import numbered
from lattica.llm.shards import CRC_TABLE, crc_sql
from lattica.llm.shared import table

BUCKETS = 10_000
RUNS = 3
SEED = 42
SHARE = (5, 100)
LEAST_WORDS = 20
DIGIT = 12  # bits
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHORT = 64  # longer words take other tables
ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_BYTE = _byte_table()


def _then(maps: np.ndarray, state: np.ndarray, base: np.ndarray | int = 0) -> np.ndarray:
    """A linear map of checksum states: four lookups, one per byte. ``maps`` is flat, ``base`` the map's place."""
    out = maps[base + (state & 255)]
    for k in (1, 2, 3):
        out = out ^ maps[base + 256 * k + (state >> (8 * k) & 255)]
    return out


def _maps(steps: int, twice: bool) -> np.ndarray:
    """Flat maps of 0, 1, 2... zero bytes; or, with ``twice``, of 1, 2, 4, 8..."""
    unit = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    one = _BYTE[unit & 255] ^ unit >> 8
    out = [one if twice else unit]
    for _ in range(steps - 1):
        out.append(_then(out[-1] if twice else one, out[-1]))
    return np.concatenate(out)


_ZEROS, _DOUBLED = _maps(SHORT + 1, False), _maps(32, True)


def _skip(state: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The states after as many zero bytes as ``size`` says."""
    out = _then(_ZEROS, state, np.minimum(size, SHORT) * 1024)
    far = np.flatnonzero(size > SHORT)
    if len(far):
        s, left = out[far], size[far] - SHORT
        for bit in range(int(left.max()).bit_length()):
            some = np.flatnonzero(left >> bit & 1)
            s[some] = _then(_DOUBLED, s[some], bit * 1024)
        out[far] = s
    return out


def _shares(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each word's own share: the state after it that starts at 0."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(np.minimum(size, SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    sizes = size[order]
    far = int(np.searchsorted(-sizes, -SHORT, "left"))
    for k in order[:far].tolist():
        out[k] = ONES ^ np.uint32(zlib.crc32(data[start[k] : start[k] + size[k]].tobytes(), 0xFFFFFFFF))
    order, sizes = order[far:], sizes[far:]
    state, at = np.zeros(len(order), np.uint32), start[order]
    for j in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -j, "left"))
        s = state[:n]
        state[:n] = _BYTE[(s ^ data[at[:n] + j]) & 255] ^ s >> 8
    out[order] = state
    return out


def run_buckets(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the runs of 1, 2, 3 words that start at each word (runs may cross texts), and words before each text."""
    s, e, before = tb.word_bounds(data, off, tb.APART)
    size = e - s
    share = _shares(tb.LOWER[data], s, size)
    out: list[np.ndarray] = []
    state = np.full(len(s), ONES)
    for k in range(RUNS):
        if k:
            state = state[:-1]
            state = _BYTE[(state ^ np.uint32(32)) & 255] ^ state >> 8
        state = _skip(state, size[k:]) ^ share[k:]
        out.append((state ^ ONES) % np.uint32(BUCKETS))
    return out, before


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, off in tb.blocks(batch.column(0)):
            runs, before = run_buckets(data, off)
            inside = np.ones(before[-1], bool)
            for k, bucket in enumerate(runs):
                if k:
                    last = before[1:] - k
                    inside[last[last >= before[:-1]]] = False
                total += np.bincount(bucket[inside[: len(bucket)]], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features in each bucket, over column ``text`` of all rows."""
    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # one row per bucket
        out[r[0]] = r[1]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    s_all, t_all = float(int(source.sum()) + BUCKETS), float(int(target.sum()) + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weights(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, n, data, off in tb.blocks(batch.column(1)):
            runs, before = run_buckets(data, off)
            words, weight, features = np.diff(before), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for k, bucket in enumerate(runs):
                many = np.maximum(words - k, 0)
                total = np.concatenate([[0], np.cumsum(gain[bucket])])
                first = np.minimum(before[:-1], len(bucket))
                weight += total[np.minimum(first + many, len(bucket))] - total[first]
                features += many
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "words", "n_features", "weight"])


def score(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, words, n_features, weight, score) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_weights, gain=gain), "doc_id long, words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + gumbel)


def _unsigned(c: Column) -> Column:
    """Bits whose unsigned order is the order of the signed numbers."""
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def least_keys(rows: DataFrame, keys: list[str], k: int) -> Column:
    """Condition that holds for the ``k`` rows that come first by the columns ``keys``.

    The columns are longs without nulls and tell all rows apart; ``rows`` has at least k rows and is
    read once a digit, so give it a written table.
    """
    if k <= 0:
        return F.lit(False)
    drawn, same, left = F.lit(False), F.lit(True), k
    for key in keys:
        u = _unsigned(F.col(key))
        low, high = rows.where(same).agg(F.min(key), F.max(key)).first()
        top = ((low ^ high) & (1 << 64) - 1).bit_length()  # the bits above are the same in all that remain
        while top > 0:
            shift = max(top - DIGIT, 0)
            digit = F.shiftrightunsigned(u, shift).bitwiseAND(F.lit((1 << (top - shift)) - 1))
            counts = rows.where(same).groupBy(digit.alias("digit")).count().collect()  # at most 1 << DIGIT
            for r in sorted(counts):
                if r[1] >= left:
                    break
                left -= r[1]
            drawn |= same & (digit < F.lit(r[0]))
            same &= digit == F.lit(r[0])
            top = shift
            if r[1] == left:
                return drawn | same
    return drawn | same


def draw(scored: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank`` (1, 2, 3...) of the drawn rows; the others' is null."""
    rows = scored.withColumns({"_down": -F.col("score"), "_id": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "_row": F.monotonically_increasing_id()})
    rows = table(rows, "scored")
    ready = F.col("words") >= least_words
    n = rows.where(ready).count()
    keys = ["_down", "_id", "_row"]
    chosen = ready & least_keys(rows.where(ready), keys, share[0] * n // share[1])
    ranked = numbered(rows.where(chosen), [F.col(x) for x in keys], "rank").withColumn("rank", F.col("rank") + 1)
    rest = rows.where(~chosen).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop(*keys)


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, words, n_features, weight, score, rank) of every row of ``docs``."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return draw(score(docs, gain, seed), share, least_words)


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, one for each row that shares a drawn id."""
    ids = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["_drawn"]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE_SQL = f"""WITH {CRC_TABLE},
texts AS (
  SELECT 0 AS target, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
said AS (
  SELECT target, r, unnest(w) AS w1, generate_subscripts(w, 1) AS pos
  FROM (SELECT target, r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '{WORD}') AS w FROM texts)),
runs AS (SELECT *, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM said WINDOW o AS (PARTITION BY target, r ORDER BY pos)),
features AS (
  SELECT target, r, w1 AS f FROM runs
  UNION ALL SELECT target, r, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT target, r, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL),
named AS (SELECT f, {crc_sql("f")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM features), crc_table),
held AS (SELECT target, r, bucket, count(*) AS n FROM features JOIN named USING (f) GROUP BY ALL),
counts AS (
  SELECT b AS bucket, coalesce(sum(n) FILTER (target = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target = 1), 0)::DOUBLE AS t
  FROM range({BUCKETS}) x(b) LEFT JOIN held ON bucket = b GROUP BY b),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (big_s + {BUCKETS}) / ((s + 1) * (big_t + {BUCKETS}))))::BIGINT AS gain
  FROM counts, (SELECT sum(s) AS big_s, sum(t) AS big_t FROM counts)),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM held JOIN gains USING (bucket) WHERE target = 0 GROUP BY r),
lengths AS (SELECT r, count(*) AS words FROM said WHERE target = 0 GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(words, 0) >= {LEAST_WORDS} AS ready,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (r) LEFT JOIN lengths USING (r) WHERE target = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ready ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN ready AND place <= {SHARE[0]} * (SELECT count(*) FROM scored WHERE ready) // {SHARE[1]} THEN place END AS rank FROM ranked"""
