"""Near-duplicate grouping with SuperMinHash signatures.

Documents are linked when the Jaccard similarity of their sets of 5-word shingles is at
least 0.75 (``100 * intersection >= 75 * union``), and a group is a connected component.

1. One pass over the texts gives each document its set size, a 128-bit fingerprint of the
   whole set, a SuperMinHash signature and one key per band of the signature.
2. Documents with equal sets form a class at once; only its smallest id goes on, so a group
   of exact copies costs one row per copy however large it is.
3. Each bucket of a band pairs its members with its smallest member (a star, never all pairs).
   Pairs are confirmed on full sets; union-find joins the confirmed ones. Keys that many rows
   hold are salted in every join (``skew``), and counted before they are shuffled.
4. Buckets that still hold several components are compared blockwise inside tasks: members of
   the bucket's largest component with those outside it, and these with each other. A first
   pass over signatures marks the members that agree enough with one of another component;
   their full sets are then dealt to the same blocks, where pairs are confirmed, closest
   first, and united. Only the links of that forest leave a task, so the rows are no more
   than the members, and no link between components is lost.

Defined results: a null, empty or white-space text has an empty set, is linked with nothing
and keeps its own id. A row whose id is null is linked with nothing; its component is null
and it is kept. Rows that share an id are one document: each row is returned, with the same
component. Ties do not occur: the smallest id of a component names it. Columns beyond
``doc_id`` and ``text`` are ignored by ``groups`` and carried through by ``keep_one``. A very long
text is one block of bytes with a larger set. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import textblock as tb
from lattica.llm.components import components
from lattica.llm.ids import id_bits, with_bit
from lattica.llm.shared import table
from lattica.llm.skew import hot_keys, spread_join

SIZE = 5  # words of a shingle
BANDS, ROWS = 42, 5  # misses a pair of similarity 0.75 with probability 1.2e-5
M = BANDS * ROWS
AGREE = 0.62  # of the registers; 0.75 lies 4.4 standard deviations above
SLICE = 1 << 14  # elements that draw registers at once
SIDE = 256  # members of one bucket that a task compares with as many others

U = np.uint64


def super_min_hash(h: np.ndarray, at: np.ndarray, m: int = M) -> np.ndarray:
    """Signatures (texts x m, uint64) of sets of hashes; an empty set has all ones.

    In round j each element draws one position of a random permutation of the m registers
    (Fisher-Yates, one swap a round) and puts ``j + r`` there if that is less, r in [0, 1).
    A text stops as soon as none of its registers can still fall: its largest is below j.
    """
    texts = len(at) - 1
    full = U(2**64 - 1)
    sig = np.full(texts * m, full, np.uint64)
    doc = np.repeat(np.arange(texts, dtype=np.int64), np.diff(at))
    kind = np.uint8 if m <= 256 else np.uint16
    for lo in range(0, len(h), SLICE):
        # one slice of elements at a time; texts are cut freely, as minima can be taken in any order
        e, d = h[lo : lo + SLICE], doc[lo : lo + SLICE]
        perm = np.tile(np.arange(m, dtype=kind), (len(e), 1))
        row = np.arange(len(e))
        for j in range(m):
            x = tb.mix(e[row] + U((j * 0x632BE59BD9B4E019) & (2**64 - 1)))
            k = j + ((x & U(0xFFFFFFFF)) % U(m - j)).astype(np.int64)
            spot = perm[row, k]
            perm[row, k] = perm[row, j]
            reg = d[row] * m + spot
            np.minimum.at(sig, reg, (U(j) << U(32)) | (x >> U(32)))
            own = np.unique(d[row])
            worst = sig.reshape(texts, m)[own].max(axis=1)
            open_ = np.zeros(texts, bool)
            open_[own] = (worst >> U(32)) > U(j)
            row = row[open_[d[row]]]
            if not len(row):
                break
    return sig.reshape(texts, m)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    texts, m = sig.shape
    parts = sig.reshape(texts, m // rows, rows)
    key = np.arange(m // rows, dtype=np.uint64)[None, :] * U(0x9E3779B97F4A7C15)
    for r in range(rows):
        key = tb.mix(key * U(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key


SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, n, data, off in tb.blocks(batch.column(1)):
            h, at = tb.shingle_sets(data, off, SIZE)
            sizes = np.diff(at)
            sig = super_min_hash(h, at)
            c1, c2 = np.zeros(len(h) + 1, U), np.zeros(len(h) + 1, U)
            np.cumsum(tb.mix(h), out=c1[1:])
            np.cumsum(tb.mix(h ^ U(0x5851F42D4C957F2D)), out=c2[1:])
            some = sizes > 0
            k1, k2 = ((tb.mix(c[at[1:]] - c[at[:-1]] + sizes.astype(U))).view(np.int64) for c in (c1, c2))
            low = (tb.mix(sig) & U(255)).astype(np.uint8)
            keys = band_keys(sig, ROWS).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, n), pa.array(sizes, pa.int64()), pa.array(k1, mask=~some), pa.array(k2, mask=~some), pa.array([x.tobytes() for x in low], pa.binary()), lists],
                names=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"],
            )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough: both sides sorted, matched by one sorted merge."""
    for batch in batches:
        (da, oa), (db, ob) = tb.flat(batch.column(2)), tb.flat(batch.column(3))
        ok = np.zeros(batch.num_rows, bool)
        for k in range(batch.num_rows):
            ok[k] = similar(da[oa[k] : oa[k + 1]].view(U), db[ob[k] : ob[k + 1]].view(U))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (tb.flat(batch.column(c))[0].reshape(-1, M) for c in (2, 3))
        ok = (x == y).sum(axis=1) >= AGREE * M
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))


def _by_block(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Applies ``work`` to the rows of each (key, bi, bj), by which the batches are sorted."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)])
        cuts = [0, *(np.flatnonzero((g[:, 1:] != g[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(g[:, lo].tolist())
            if held and key != now:
                yield work(pa.Table.from_batches(held).combine_chunks())
                held = []
            now = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield work(pa.Table.from_batches(held).combine_chunks())


def _candidates(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows of other components that agree with it in enough registers, in how many).

    A pair counts in the bucket of the first band that it shares only. Shared are equal keys, as
    these make the buckets: the short registers of a band may be equal where its keys differ.
    """
    comp, block = t.column("comp").to_numpy(), t.column("block").to_numpy()
    sig = tb.flat(t.column("sig"))[0].reshape(-1, M)
    keys = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    bi, bj, band = (t.column(c)[0].as_py() for c in ("bi", "bj", "band"))
    left = np.flatnonzero(block == bi)
    right = left if bi == bj else np.flatnonzero(block == bj)
    for p, i in enumerate(left):
        js = right[p + 1 :] if bi == bj else right
        js = js[comp[js] != comp[i]]
        agree = (sig[js] == sig[i]).sum(axis=1)
        near = agree >= AGREE * M
        js, agree = js[near], agree[near]
        new = ~(keys[js, :band] == keys[i, :band]).any(axis=1)
        if new.any():
            yield int(i), js[new], agree[new]


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block that have a candidate in it."""

    def rows(t: pa.Table) -> pa.RecordBatch:
        hit = np.zeros(t.num_rows, bool)
        for i, js, _ in _candidates(t):
            hit[i] = True
            hit[js] = True
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in t.filter(pa.array(hit)).columns], schema=t.schema)

    return _by_block(batches, rows)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 75 * union of two sorted sets."""
    z = np.concatenate([x, y])
    z.sort(kind="stable")
    common = int(np.count_nonzero(z[1:] == z[:-1]))
    return common > 0 and 100 * common >= 75 * (len(z) - common)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links of each block, as a forest: pairs that others join already are left out."""

    def links(t: pa.Table) -> pa.RecordBatch:
        cid, comp = t.column("cid").to_numpy(), t.column("comp").to_numpy()
        data, off = tb.flat(t.column("hashes"))
        pairs = sorted((-int(n), i, int(j)) for i, js, agree in _candidates(t) for j, n in zip(js, agree))
        parent = {int(c): int(c) for c in comp}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for _, i, j in pairs:
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b and similar(data[off[i] : off[i + 1]].view(U), data[off[j] : off[j + 1]].view(U)):
                parent[a] = b
                out.append((int(cid[i]), int(cid[j])))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return _by_block(batches, links)


def _to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, n, data, off in tb.blocks(batch.column(1)):
            h, at = tb.shingle_sets(data, off, SIZE)
            raw = pa.py_buffer(h.tobytes())
            offs = pa.py_buffer((at * 8).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.Array.from_buffers(pa.binary(), n, [None, offs, raw])], names=["id", "hashes"])


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, hashes) of the documents of ``ids`` (and a few more).

    A bitmap of fixed size keeps most other texts from being hashed or shuffled; exact joins
    follow. Of rows that share an id one set stands for all.
    """
    sets = with_bit(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), id_bits(ids), _to_sets, "id long, hashes binary")
    return table(sets.groupBy("id").agg(F.min("hashes").alias("hashes")), "sets")


def confirm(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that full sets confirm."""
    sets = sets_of(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    out = pairs.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")).hint("merge"), "b")
    hot, _ = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), ["a"])
    out = spread_join(out, sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")).hint("merge"), ["a"], "b", hot)
    return table(out.select("a", "b", "ha", "hb").mapInArrow(_confirm, "a long, b long"), "links")


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed = table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_sign, SIGNED), "signed")
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    known = signed.where("k1 is not null and doc_id is not null")
    classes = table(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("cid"), F.count("*").alias("n")), "classes")
    hot, _ = hot_keys(classes, ["k1", "k2"])
    member = spread_join(known.select("doc_id", "k1", "k2"), classes.drop("n"), ["k1", "k2"], "doc_id", hot)
    member = table(member.select("doc_id", "cid").distinct(), "class")
    own = member.groupBy("doc_id").agg(F.min("cid").alias("least"), F.max("cid").alias("most"))
    reps = signed.join(member.where("doc_id = cid").select("doc_id").hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    reps = table(reps.select(F.col("doc_id").alias("cid"), "sig", "bands"), "reps")
    banded = reps.select("cid", F.posexplode("bands").alias("band", "key"))
    buckets = table(banded.groupBy("key").agg(F.min("cid").alias("rep"), F.count("*").alias("n")).where("n > 1"), "counts")
    hot, _ = hot_keys(buckets, ["key"])
    shared = table(spread_join(banded, buckets.hint("merge"), ["key"], "cid", hot), "buckets")
    sigs = reps.select(F.col("cid").alias("id"), "sig")

    star = table(shared.where("cid <> rep").select(F.col("rep").alias("a"), F.col("cid").alias("b")).distinct(), "pairs")
    of_a, _ = hot_keys(star.groupBy("a").agg(F.count("*").alias("n")), ["a"])
    star = star.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    star = spread_join(star, sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), ["a"], "b", of_a)
    star = table(star.select("a", "b", "sa", "sb").mapInArrow(_agree, "a long, b long"), "star")
    split = own.where("least < most").select(F.col("least").alias("a"), F.col("most").alias("b"))  # rows that share an id
    links = confirm(docs, star).unionByName(split)
    comp = components(links)

    # what a star leaves apart: blocks of mixed buckets, compared inside tasks
    held = shared.where("n > 2").join(comp.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("comp", F.coalesce("root", "cid"))
    counted = held.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key")
    mixed = counted.agg(F.count("*").alias("comps"), F.sum("m").alias("all"), F.max(F.struct("m", "comp")).alias("top")).where("comps > 1")
    blocks = lambda n: F.ceil(n / SIDE).cast("int")
    mixed = mixed.select("key", F.col("top.comp").alias("largest"), blocks(F.col("all") - F.col("top.m")).alias("few"), blocks(F.col("top.m")).alias("many"))
    rest = spread_join(held.select("key", "band", "cid", "comp"), mixed, ["key"], "cid", hot).join(reps, "cid")
    in_it = F.col("comp") == F.col("largest")
    # blocks 0 to few - 1 are those outside the largest component, the others follow
    rest = rest.withColumn("block", F.when(in_it, F.col("few") + F.pmod(F.xxhash64("cid"), "many")).otherwise(F.pmod(F.xxhash64("cid"), "few")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("few") - 1 + F.when(in_it, 0).otherwise(F.col("many")))))
    rest = rest.select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "band", "cid", "comp", "block", "sig", "bands")
    rest = table(rest.repartition(width, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(_mark, rest.schema), "rest")
    if not rest.isEmpty():
        sets = sets_of(docs, rest.select(F.col("cid").alias("id")).distinct())
        rest = rest.join(sets.select(F.col("id").alias("cid"), "hashes"), "cid").select(*rest.columns, "hashes")
        more = rest.repartition(width, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(_link, "a long, b long")
        comp = components(links.unionByName(table(more, "more")))
    to = member.join(comp.select(F.col("node").alias("cid"), "root"), "cid", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "cid")).alias("component"))
    out = signed.select("doc_id", "n_shingles").join(to, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, all its columns."""
    drop = groups(docs).where("not kept").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
