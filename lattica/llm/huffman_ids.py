"""Token ids of texts in files: canonical length-limited Huffman code from global counts.

``write`` encodes texts with the tokenizers library, counts every id over all documents, builds
one canonical code of at most ``LIMIT`` bits (package-merge), packs each document and writes a
folder: ``codebook`` (id, bits) and ``blocks``, Parquet rows in ascending doc_id order. A block
holds whole documents, ``BLOCK_IDS`` ids or one longer document, and can be read alone: its
documents start on byte borders, and bit offsets of every ``STRIDE``-th id of each document
(checkpoints) let a reader start there. ``read`` decodes with one table of ``2 ** bits`` entries,
all stretches between checkpoints at once, one numpy step per id of a stretch.

Pre-tokens of ``word_bpe_49k.json`` never cross white space, nor the border of an ASCII letter, an
ASCII digit and ASCII punctuation other than the apostrophe. Texts are cut there in numpy, pieces
are known by 64-bit hashes, and the library encodes each distinct piece once per worker (a hash
table of ``CACHE`` pieces). Whether a file cuts like that is read from it; of any other tokenizer
file the library encodes whole texts.

Defined results: a null text counts as empty and gives the end id alone. Null doc_ids come
first, repeated doc_ids lie side by side in order of their bits. An empty table gives empty
files. Columns beyond ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import textblock as tb
from lattica.llm.bpe import spread
from lattica.llm.shared import session_dir, table

FILE = "word_bpe_49k.json"
END = 2
LIMIT = 20
BLOCK_IDS, STRIDE = 65_536, 256
CACHE = 1 << 21
JOINED = 200  # pieces handed to the library as one string
#: the normalizer and the pre-token pattern that the cuts below are right for (fixed values)
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


# -- the code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol (0 where its count is 0), at most ``limit``, by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit in {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    merged, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        is_leaf.append(at < len(leaves))
    take = 2 * len(leaves) - 2
    for mask in reversed(is_leaf):
        n = int(mask[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical(bits: np.ndarray) -> np.ndarray:
    """Codes that belong to the lengths: ascending by length, then by symbol."""
    used = np.flatnonzero(bits)
    order = used[np.lexsort((used, bits[used]))]
    codes, code, last = np.zeros(len(bits), np.uint64), 0, 0
    for s in order.tolist():
        n = int(bits[s])
        code <<= n - last
        codes[s], last = code, n
        code += 1
    return codes


def decode_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for each value of the next ``width`` bits."""
    width = int(bits.max(initial=1))
    used = np.flatnonzero(bits)
    order = used[np.lexsort((used, bits[used]))]
    times = (1 << (width - bits[order].astype(np.int64))).astype(np.int64)
    size = 1 << width
    symbol, length = np.zeros(size, np.uint32), np.ones(size, np.uint8)
    n = int(times.sum())
    symbol[:n], length[:n] = np.repeat(order, times), np.repeat(bits[order], times)
    return symbol, length, width


def pack(ids: np.ndarray, at: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs ids of texts (``at``: ids before each); texts start on byte borders.

    Returns the bytes, the bytes before each text, and each id's bit offset in its text.
    """
    n = bits[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    whole = ends[at]
    size = (np.diff(whole) + 7) // 8
    cut = np.concatenate([[0], np.cumsum(size)])
    own = ends[:-1] - np.repeat(whole[:-1], np.diff(at))
    place = own + np.repeat(cut[:-1] * 8, np.diff(at))
    out = np.zeros(int(cut[-1]) // 8 + 2, np.uint64)
    if len(ids):
        c = codes[ids]
        word, room = place >> 6, 64 - (place & 63) - n
        fits = room >= 0
        part = np.where(fits, c << np.maximum(room, 0).astype(np.uint64), c >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] |= np.bitwise_or.reduceat(part, first)
        over = np.flatnonzero(~fits)
        out[word[over] + 1] |= c[over] << (64 + room[over]).astype(np.uint64)
    return out.byteswap().view(np.uint8)[: int(cut[-1])], cut, own


def unpack(data: np.ndarray, start: np.ndarray, count: np.ndarray, table_: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Ids of stretches that start at the given bits; each has ``count`` ids, ``STRIDE`` at most."""
    symbol, length, width = table_
    d = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    peek = d[:-3] << np.uint32(24) | d[1:-2] << np.uint32(16) | d[2:-1] << np.uint32(8) | d[3:]
    order = np.argsort(-count, kind="stable")  # those still going stay in front
    bit, left = start[order].astype(np.int64), count[order]
    out = np.zeros((int(count.max(initial=0)), len(count)), np.uint32)
    mask = np.uint32((1 << width) - 1)
    going = len(left)
    for step in range(len(out)):
        going = int(np.searchsorted(-left[:going], -step, "left"))
        b = bit[:going]
        value = (peek[b >> 3] >> (32 - width - (b & 7)).astype(np.uint32)) & mask
        out[step, :going] = symbol[value]
        b += length[value]
    back = np.empty(len(count), np.int64)
    back[order] = np.arange(len(count))
    # row-major ids of stretch k are column back[k]
    which = np.repeat(back, count)
    step = spread(np.zeros(len(count), np.int64), count)
    return out[step, which]


# -- ids of texts


#: kind of each byte: 0 white space, 1 letter, 2 digit, 3 punctuation, 4 what nothing is cut beside
KIND = np.full(256, 4, np.uint8)
KIND[[32, *range(9, 14)]] = 0
KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[48:58] = 2
KIND[39] = 4
BORDER = np.zeros((5, 5), bool)
BORDER[[1, 1, 2, 2, 3, 3], [2, 3, 1, 3, 1, 2]] = True


def cuts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each piece, and how many pieces lie before each text."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    kind = KIND[data]
    solid = kind != 0
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    edge[1:-1] |= BORDER.ravel()[kind[:-1] * np.uint8(5) + kind[1:]]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end[:-1] &= ~solid[1:] | edge[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


class _Table:
    """Open-addressing hash table from 64-bit hashes to 0, 1, 2, ... in order of arrival."""

    def __init__(self, most: int) -> None:
        self.slots = 1 << (2 * most - 1).bit_length()
        self.key = np.zeros(self.slots, np.uint64)
        self.value = np.full(self.slots, -1, np.int32)
        self.count = 0

    def get(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is new."""
        mask = np.uint64(self.slots - 1)
        at = (h & mask).astype(np.int64)
        out = self.value[at]
        wrong = np.flatnonzero((out >= 0) & (self.key[at] != h))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (self.slots - 1)
            out[wrong] = self.value[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.key[at[wrong]] != h[wrong])]
        return out

    def add(self, h: np.ndarray) -> None:
        """Numbers distinct new hashes."""
        number = np.arange(self.count, self.count + len(h), dtype=np.int32)
        self.count += len(h)
        at = (h & np.uint64(self.slots - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.value[at[left]] < 0]
            self.value[at[free]] = number[free]  # of several for one slot the last one stays
            self.key[at[free]] = h[free]
            left = left[self.value[at[left]] != number[left]]
            at[left] = (at[left] + 1) & (self.slots - 1)


def _cut_by_words(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and t["content"].startswith("<|") for t in spec["added_tokens"])
    return spec.get("normalizer") == NORMALIZER and first.get("pattern") == {"Regex": PRETOKENS} and plain and len(spec["added_tokens"]) > 0


class Encoder:
    """The library's ids of texts, with each distinct piece encoded once where the file allows that."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.by_piece = _cut_by_words(path)
        if self.by_piece:
            self.mark_id, token = max((i, t.content) for i, t in self.tok.get_added_tokens_decoder().items())
            self.mark = np.frombuffer(token.encode(), np.uint8)
            self._clear()

    def _clear(self) -> None:
        self.known = _Table(CACHE)
        self.flat, self.off = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, h: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        """Encodes new pieces: many in one string, with an added token after each to tell them apart."""
        size, extra = e - s, len(self.mark)
        to = np.concatenate([[0], np.cumsum(size + extra)])
        joined = np.empty(int(to[-1]), np.uint8)
        joined[spread(to[:-1], size)] = data[spread(s, size)]
        joined[(to[1:, None] - extra + np.arange(extra)).ravel()] = np.tile(self.mark, len(s))
        ids = self._library([joined[to[k] : to[min(k + JOINED, len(s))]].tobytes().decode() for k in range(0, len(s), JOINED)])
        flat = np.concatenate([np.array(x, np.uint32) for x in ids])
        ends = np.flatnonzero(flat == self.mark_id)
        n = np.diff(np.concatenate([[-1], ends])) - 1
        self.known.add(h)
        top = int(self.off[-1])
        while top + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[top : top + len(flat) - len(ends)] = np.delete(flat, ends)
        self.off = np.concatenate([self.off, top + np.cumsum(n)])

    def encode(self, texts: pa.Array, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the ids before each; ``end`` closes each text."""
        if not self.by_piece:
            return self._whole([t or "" for t in texts.to_pylist()], end)
        data, off = tb.flat(texts)
        # texts with what may be an added token are encoded as a whole
        odd = np.unique(np.searchsorted(off, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)), "right") - 1)
        s, e, before = cuts(data, off)
        h = tb.word_hashes(data, s, e)
        high = np.concatenate([[0], np.cumsum(data > 127)])
        capital = np.flatnonzero((data > 64) & (data < 91))
        if high[-1] and len(capital):  # beyond ASCII, capitals count: composed letters may differ in them
            piece = np.searchsorted(s, capital, "right") - 1
            some = (high[e] > high[s])[piece]
            piece, capital = piece[some], capital[some]
            np.add.at(h, piece, tb.mix((capital - s[piece] + 7).astype(np.uint64)))
        number = self.known.get(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            distinct, first = np.unique(h[new], return_index=True)
            if self.known.count + len(distinct) > CACHE:
                self._clear()
                distinct, first = np.unique(h, return_index=True)
                new = np.arange(len(h))
                if len(distinct) > CACHE:  # a text of its own that fills the table
                    return self._whole([t or "" for t in texts.to_pylist()], end)
            at = new[first]
            self._learn(distinct, data, s[at], e[at])
            number[new] = self.known.get(h[new])
        start = self.off[number]
        size = self.off[number + 1] - start
        stop = np.cumsum(np.concatenate([[0], size]))
        own = stop[before]  # ids before each text, without ends
        ids = self.flat[spread(start, size)]
        if len(odd):
            ids, own = self._patched(ids, own, odd, texts)
        if end is None:
            return ids, own
        return np.insert(ids, own[1:], np.uint32(end)), own + np.arange(len(own))

    def _whole(self, texts: list[str], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(x + ([] if end is None else [end]), np.uint32) for x in self._library(texts)]
        return np.concatenate([np.zeros(0, np.uint32), *got]), np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)])

    def _patched(self, ids: np.ndarray, own: np.ndarray, odd: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = [ids[own[k] : own[k + 1]] for k in range(len(own) - 1)]
        for k, x in zip(odd.tolist(), self._library([texts[int(k)].as_py() for k in odd])):
            parts[k] = np.array(x, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _binary(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _ids(batches: Iterator[pa.RecordBatch], path: str, kind: str) -> Iterator[pa.RecordBatch]:
    e, width = encoder(path), np.dtype(kind).itemsize
    for batch in batches:
        texts = batch.column(1)
        for i, n, _, _ in tb.blocks(texts):
            ids, at = e.encode(texts.slice(i, n))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), _binary(ids.astype(kind).view(np.uint8), at * width)], names=["doc_id", "ids"])


def _histogram(batches: Iterator[pa.RecordBatch], kind: str, size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for batch in batches:
        total += np.bincount(tb.flat(batch.column(0))[0].view(kind), minlength=size)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["id", "n"])


PACKED = "doc_id long, n_ids long, bits binary, checkpoints binary"


def _packed(batches: Iterator[pa.RecordBatch], kind: str, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    codes, width = canonical(bits), np.dtype(kind).itemsize
    for batch in batches:
        for i, n, data, off in tb.blocks(batch.column(1)):
            ids, at = data.view(kind), off // width
            raw, cut, own = pack(ids, at, codes, bits)
            size = np.diff(at)
            marks = (size + STRIDE - 1) // STRIDE
            which = np.repeat(at[:-1], marks) + STRIDE * spread(np.zeros(n, np.int64), marks)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, n), pa.array(size), _binary(raw, cut), _binary(own[which].astype("<i8").view(np.uint8), 8 * np.concatenate([[0], np.cumsum(marks)]))],
                names=["doc_id", "n_ids", "bits", "checkpoints"],
            )


BLOCK = "part int, block int, start long, doc_ids array<long>, sizes array<long>, offsets array<long>, checkpoints binary, bits binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order -> blocks; ``start`` counts the ids of the part before the block."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    held: list[tuple] = []
    ids = start = block = 0

    def close() -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(h[2]) for h in held])])
        marks = np.concatenate([np.frombuffer(h[3], "<i8") + 8 * o for h, o in zip(held, offsets)])
        row = [part, block, start, [h[0] for h in held], [h[1] for h in held], offsets[:-1].tolist(), marks.astype("<i8").tobytes(), b"".join(h[2] for h in held)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "block", "start", "doc_ids", "sizes", "offsets", "checkpoints", "bits"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(4))):
            held.append(row)
            ids += row[1]
            if ids >= BLOCK_IDS:
                yield close()
                held, start, block, ids = [], start + ids, block + 1, 0
    if held:
        yield close()


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes the folder ``path`` (new, where Spark can write) with the ids of all texts."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_path()
    size = encoder(tokenizer).size
    kind = "<u2" if size <= 1 << 16 else "<u4"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = table(texts.mapInArrow(partial(_ids, path=tokenizer, kind=kind), "doc_id long, ids binary"), "ids")
    counted = ids.select("ids").mapInArrow(partial(_histogram, kind=kind, size=size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for r in counted.collect():  # one row per id of the vocabulary at most
        counts[r[0]] = r[1]
    bits = code_lengths(counts)
    book = [(int(k), int(bits[k])) for k in np.flatnonzero(bits)]
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    packed = ids.mapInArrow(partial(_packed, kind=kind, bits=bits), PACKED)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = packed.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n_ids", "bits")
    ordered.mapInArrow(_blocks, BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


def _decoded(batches: Iterator[pa.RecordBatch], bits: np.ndarray, bases: dict[int, int]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, ids of the block, ids before each document, start of the block)."""
    lookup = decode_table(bits)
    for batch in batches:
        for part, start, doc_ids, sizes, checkpoints, data in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "doc_ids", "sizes", "checkpoints", "bits"))):
            size = np.array(sizes, np.int64)
            marks = (size + STRIDE - 1) // STRIDE
            count = np.full(int(marks.sum()), STRIDE, np.int64)
            last = np.cumsum(marks)[marks > 0] - 1
            count[last] = size[marks > 0] - STRIDE * (marks[marks > 0] - 1)
            ids = unpack(np.frombuffer(data, np.uint8), np.frombuffer(checkpoints, "<i8"), count, lookup)
            yield doc_ids, ids, np.concatenate([[0], np.cumsum(size)]), bases[part] + start


def _digests(batches: Iterator[pa.RecordBatch], bits: np.ndarray, bases: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for doc_ids, ids, at, start in _decoded(batches, bits, bases):
        little = ids.astype("<u4")
        crc = [zlib.crc32(little[at[k] : at[k + 1]]) for k in range(len(doc_ids))]
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _lists(batches: Iterator[pa.RecordBatch], bits: np.ndarray, bases: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for doc_ids, ids, at, start in _decoded(batches, bits, bases):
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + at[:-1]), lists], names=["doc_id", "start", "ids"])


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray, dict[int, int]]:
    book = spark.read.schema("id int, bits int").parquet(f"{path}/codebook").collect()  # the vocabulary at most
    bits = np.zeros(max((r[0] for r in book), default=0) + 1, np.uint8)
    for r in book:
        bits[r[0]] = r[1]
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    sizes = blocks.select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n"))
    bases, total = {}, 0
    for part, n in sorted((r[0], r[1]) for r in sizes.collect()):  # one row per file
        bases[part], total = total, total + n
    return blocks, bits, bases


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document of the folder."""
    blocks, bits, bases = _opened(spark, path)
    return blocks.mapInArrow(partial(_lists, bits=bits, bases=bases), "doc_id long, start long, ids array<int>")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, decoded from the folder's files."""
    blocks, bits, bases = _opened(spark, path)
    return blocks.mapInArrow(partial(_digests, bits=bits, bases=bases), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{session_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return digest(spark, path)
