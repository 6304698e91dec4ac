"""Chroma fingerprints of recordings, and their alignment by offset histograms and bit errors.

PCM becomes spectra of overlapping frames, and these 12 pitch classes. Over the integral image
(sums of all earlier frames and lower classes) each of 16 filters compares two sums of a window
of ``WIDE`` frames; the log of their ratio gives two Gray-coded bits, and a window 32 packed
bits. Recordings with the same sequence form a class, which takes part once under its least id.

Two recordings are linked where at some offset, over at least ``LEAST_OVERLAP`` of the shorter
one, no more than ``MOST_ERROR`` of the bits differ; ``class_id`` names connected recordings by
their least id, so a large group costs one row a member and not one a pair.

1. The leading bits of the steadier filters at three windows ``GAP`` apart make the keys. Each key
   carries five whole words (``CONTEXT``); chance meetings differ there and go at once.
2. A key's bucket pairs its members with its least one (a star). Members that this one does not
   match are grouped anew inside tasks, leader by leader, so no bucket makes pairs of all members.
3. Meetings of a pair vote for offsets; the offset with most votes (ties: the least) aligns the
   two, the bits that differ there decide, and union-find joins what is linked.

Windows of silence are no keys: they tell nothing. A pair whose every key is broken is missed;
recall against brute force over all offsets is measured in ``tests/llm``.

The box has no recordings, so the query sounds each vector of ``embeddings`` as 64 notes
(``sonify``), all rows.

Defined results: null, empty or too short audio has no words; such recordings form no class with
others (their class is their own id) and match nothing. Recordings of at most ``2 * GAP`` windows
have no keys and match only those with the same words. A null id is passed through as its own row
in no class. Repeated ids are one recording. A very long recording has more words and keys, in
proportion. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.components import components
from lattica.llm.shared import table
from lattica.llm.skew import hot_keys, spread_join

RATE, FRAME, HOP = 1000, 256, 64  # samples a second, of a frame, between frames
LOW, HIGH = 80.0, 480.0  # hertz that count
WIDE = 8  # frames of a window
FILTERS = 16
LEVELS = (-0.35, 0.0, 0.35)  # cuts of a filter's value
MOST_ERROR = 0.18  # of the bits of an alignment
LEAST_OVERLAP = 0.5  # of the shorter recording
NOTES, SAMPLES = 64, 64  # of the sound made of a vector
CONTEXT = (0, 4, 8, 12, 16)  # windows from a key's first whose words the key carries
LEAST_ALIKE = 128  # bits of the 160 of these words that a meeting needs
HELD = 4_096  # keys compared with a leader at once
STEADY = (0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 13, 14, 15)  # filters whose leading bit changes in at most a tenth of noisy windows
GAP = 8
PART = 256  # recordings handled at once


def chroma(pcm: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Recordings of equal length (n x samples) -> (n x frames x 12), each frame summing to 1 (silence to 0)."""
    frames = (pcm.shape[1] - FRAME) // HOP + 1
    if frames < 1:
        return np.zeros((len(pcm), 0, 12))
    cut = np.lib.stride_tricks.sliding_window_view(pcm, FRAME, axis=1)[:, ::HOP]
    power = np.abs(np.fft.rfft(cut * np.hanning(FRAME), axis=2)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1.0 / rate)
    use = np.flatnonzero((hertz >= LOW) & (hertz <= HIGH))
    place = (12 * np.log2(hertz[use] / 110.0)) % 12
    to = np.zeros((len(use), 12))
    low = np.floor(place).astype(int)
    to[np.arange(len(use)), low % 12] += 1 - (place - low)
    to[np.arange(len(use)), (low + 1) % 12] += place - low
    out = power[:, :, use] @ to
    total = out.sum(axis=2, keepdims=True)
    return np.where(total > 1e-6, out / np.maximum(total, 1e-12), 0.0)


def _areas(k: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """Filter k as rectangles (frame, class, frames, classes) to add and to set against them."""
    kind, size = k % 4, 3 + (k * 5) % 4 * 2
    y = (k * 7) % (12 - size + 1)
    half = size // 2
    mid = WIDE // 2
    if kind == 0:  # lower against higher classes
        return [(0, y, WIDE, half)], [(0, y + half, WIDE, size - half)]
    if kind == 1:  # earlier against later frames
        return [(0, y, mid, size)], [(mid, y, WIDE - mid, size)]
    if kind == 2:  # crossed quarters
        return [(0, y, mid, half), (mid, y + half, WIDE - mid, size - half)], [(mid, y, WIDE - mid, half), (0, y + half, mid, size - half)]
    third = max(1, size // 3)  # the middle classes against those around
    return [(0, y + third, WIDE, third)], [(0, y, WIDE, third), (0, y + 2 * third, WIDE, size - 2 * third)]


def words(frames: np.ndarray) -> np.ndarray:
    """(n x frames x 12) -> packed 32-bit words (n x windows); windows of silence are 0."""
    n, length, _ = frames.shape
    windows = length - WIDE + 1
    if windows < 1:
        return np.zeros((n, 0), np.uint32)
    image = np.zeros((n, length + 1, 13))
    image[:, 1:, 1:] = frames.cumsum(axis=1).cumsum(axis=2)

    def area(t: int, y: int, w: int, h: int) -> np.ndarray:
        a, b = image[:, t : t + windows], image[:, t + w : t + w + windows]
        return (b[:, :, y + h] - b[:, :, y] - a[:, :, y + h] + a[:, :, y]) / (w * h)

    out = np.zeros((n, windows), np.uint32)
    for k in range(FILTERS):
        plus, minus = _areas(k)
        value = np.log((sum(area(*r) for r in plus) / len(plus) + 0.01) / (sum(area(*r) for r in minus) / len(minus) + 0.01))
        level = np.digitize(value, LEVELS)
        out |= (level ^ (level >> 1)).astype(np.uint32) << np.uint32(2 * k)
    sound = image[:, WIDE:, 12] - image[:, :-WIDE, 12]
    return np.where(sound[:, :windows] > 0, out, 0)


def _fingerprints(batches: Iterator[pa.RecordBatch], rate: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, PART):
            part = batch.slice(i, PART)
            audio = part.column(1).to_pylist()
            got: list[list[int] | None] = [None] * len(audio)
            sizes = np.array([len(a) // 2 if a else 0 for a in audio])
            for size in np.unique(sizes[sizes >= FRAME]):
                rows = np.flatnonzero(sizes == size)
                pcm = np.stack([np.frombuffer(audio[r], "<i2", size) for r in rows]).astype(np.float64) / 32768
                for r, w in zip(rows, words(chroma(pcm, rate)).astype(np.int64)):
                    got[r] = w
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.int64()))], names=["id", "words"])


def fingerprints(media: DataFrame, rate: int = RATE) -> DataFrame:
    """(id, words) of recordings (id, audio: 16-bit little-endian mono PCM)."""
    return media.select("id", "audio").mapInArrow(partial(_fingerprints, rate=rate), "id long, words array<long>")


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, PART):
            part = batch.slice(i, PART)
            out = []
            for v in part.column(1).to_pylist():
                x = np.array([0.0 if y is None else y for y in v or []], float)[:NOTES]
                scale = np.sqrt(np.mean(x**2)) if len(x) else 0.0
                if scale == 0:
                    out.append(None)
                    continue
                pitch = np.clip(6 + 3 * x / scale, 0, 11.99)
                hertz = np.repeat(110 * 2 ** (pitch / 12), SAMPLES)
                out.append((12000 * np.sin(2 * np.pi * np.cumsum(hertz) / RATE)).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["id", "audio"])


def sonify(vectors: DataFrame) -> DataFrame:
    """(id, audio): each vector (id, embedding) as a row of notes, a value's size giving the pitch."""
    return vectors.select("id", "embedding").mapInArrow(_sound, "id long, audio binary")


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meetings (a, b, offset) inside each key's rows, by which the batches are sorted.

    The first row leads; those whose words are like its own meet it, the others go on among
    themselves. Rows are compared with one leader at a time.
    """

    def groups_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cid, at = rows.column("cid").to_numpy(), rows.column("at").to_numpy()
        words_ = rows.column("words").combine_chunks().flatten().to_numpy().reshape(-1, len(CONTEXT)).astype(np.uint32)
        left = np.argsort(cid, kind="stable")
        while len(left) > 1:
            lead, left = left[0], left[1:]
            alike = np.concatenate([np.bitwise_count(words_[left[k : k + HELD]] ^ words_[lead]).sum(axis=1) for k in range(0, len(left), HELD)]) <= 32 * len(CONTEXT) - LEAST_ALIKE
            met, left = left[alike], left[~alike]
            met = met[cid[met] != cid[lead]]
            if len(met):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), cid[lead])), pa.array(cid[met]), pa.array((at[met] - at[lead]).astype(np.int32))], names=["a", "b", "offset"])

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            if held and key[lo] != now:
                yield from groups_of(pa.Table.from_batches(held))
                held = []
            now = key[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield from groups_of(pa.Table.from_batches(held))


def _keys(reps: DataFrame) -> DataFrame:
    """(cid, key, at, words) of every window of a recording that a key can start at."""
    strong = sum(1 << (2 * k + 1) for k in STEADY)
    word = lambda i, gap: F.element_at("words", i + gap)

    def key(i: F.Column) -> F.Column:
        parts = [word(i, g).bitwiseAND(F.lit(strong)) for g in (0, GAP, 2 * GAP)]
        sounds = (word(i, 0) != 0) & (word(i, GAP) != 0) & (word(i, 2 * GAP) != 0)
        return F.struct(i.alias("at"), F.xxhash64(*parts).alias("key"), sounds.alias("sounds"), F.array(*[word(i, g) for g in CONTEXT]).alias("words"))

    made = F.transform(F.expr(f"sequence(1, size(words) - {2 * GAP})"), key)
    keys = reps.where(F.size("words") > 2 * GAP).select("cid", F.explode(F.filter(made, lambda k: k["sounds"])).alias("k"))
    return keys.select("cid", "k.key", "k.at", "k.words")


def _meetings(keys: DataFrame) -> DataFrame:
    """(a, b, offset) of the meetings of recordings on keys: stars around the least member, then leaders."""
    buckets = keys.groupBy("key").agg(F.min(F.struct("cid", "at", "words")).alias("lead"), F.count("*").alias("n"), F.min("cid").alias("lo"), F.max("cid").alias("hi"))
    buckets = table(buckets.where("lo < hi").select("key", "lead", "n"), "buckets")
    hot, _ = hot_keys(buckets, ["key"])
    met = spread_join(keys, buckets, ["key"], "cid", hot).where(F.col("cid") != F.col("lead.cid"))
    differ = F.aggregate(F.zip_with("words", "lead.words", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    met = table(met.withColumn("alike", differ <= 32 * len(CONTEXT) - LEAST_ALIKE), "met")
    star = met.where("alike").select(F.col("lead.cid").alias("a"), F.col("cid").alias("b"), (F.col("at") - F.col("lead.at")).alias("offset"))
    others = met.where("not alike").select("key", "cid", "at", "words")
    width = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    others = others.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_leaders, "a long, b long, offset int")
    return star.unionByName(others)


def matches(prints: DataFrame) -> DataFrame:
    """(id, class_id, partner, offset, votes, bit_error), one row per recording.

    ``partner`` is the linked recording before it with the least error among those it met
    (ties: the least id), ``offset`` and so on how it aligns; null where it met none. A member of
    a class of equal words has their least id as partner, at offset 0 without error or votes.
    """
    prints = table(prints.dropDuplicates(["id"]), "prints")
    some = prints.where("size(words) > 0 and id is not null").withColumn("print", F.sha2(F.array_join("words", ","), 256))
    classes = table(some.groupBy("print").agg(F.min("id").alias("cid"), F.count("*").alias("n")), "classes")
    hot, _ = hot_keys(classes, ["print"])
    member = table(spread_join(some.select("id", "print"), classes.drop("n"), ["print"], "id", hot).select("id", "cid"), "members")
    reps = table(some.select(F.col("id").alias("cid"), "words").join(classes.select("cid"), "cid", "left_semi"), "reps")
    votes = _meetings(table(_keys(reps), "keys")).groupBy("a", "b", "offset").agg(F.count("*").alias("votes"))
    best = votes.groupBy("a", "b").agg(F.max(F.struct("votes", (-F.abs("offset")).alias("n"), "offset")).alias("v"))
    best = table(best.select("a", "b", "v.votes", "v.offset"), "aligned")
    hot, _ = hot_keys(best.groupBy("a").agg(F.count("*").alias("n")), ["a"])
    best = best.join(reps.select(F.col("cid").alias("b"), F.col("words").alias("wb")), "b")
    best = spread_join(best, reps.select(F.col("cid").alias("a"), F.col("words").alias("wa")), ["a"], "b", hot)
    overlap = F.least(F.size("wa") - F.greatest(-F.col("offset"), F.lit(0)), F.size("wb") - F.greatest("offset", F.lit(0)))
    best = best.withColumn("overlap", overlap).where(F.col("overlap") >= LEAST_OVERLAP * F.least(F.size("wa"), F.size("wb")))
    a, b = F.expr("slice(wa, 1 + greatest(-offset, 0), overlap)"), F.expr("slice(wb, 1 + greatest(offset, 0), overlap)")
    wrong = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    found = best.withColumn("bit_error", wrong / (32.0 * F.col("overlap"))).where(F.col("bit_error") <= MOST_ERROR)
    found = table(found.select("a", "b", "offset", "votes", "bit_error"), "links")
    root = components(found).select(F.col("node").alias("cid"), F.col("root").alias("class_id"))
    nearest = found.groupBy("b").agg(F.min(F.struct("bit_error", "a", "offset", "votes")).alias("l")).select(F.col("b").alias("cid"), "l")
    per_class = member.where("id = cid").join(root, "cid", "left").join(nearest, "cid", "left").select("cid", F.coalesce("class_id", "cid").alias("class_id"), "l")
    sizes = member.groupBy("cid").agg(F.count("*").alias("n"))
    hot, _ = hot_keys(sizes, ["cid"])
    own = spread_join(member, per_class, ["cid"], "id", hot)
    copy = F.col("id") != F.col("cid")
    own = own.select(
        "id",
        "class_id",
        F.when(copy, F.col("cid")).otherwise(F.col("l.a")).alias("partner"),
        F.when(copy, F.lit(0)).otherwise(F.col("l.offset")).alias("offset"),
        F.when(~copy, F.col("l.votes")).alias("votes"),
        F.when(copy, F.lit(0.0)).otherwise(F.round("l.bit_error", 6)).alias("bit_error"),
    )
    return prints.select("id").join(own, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), "embedding")
    return matches(fingerprints(sonify(v))).withColumnRenamed("id", "vec_id")
