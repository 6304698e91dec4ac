"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

Texts are split into pre-tokens; distinct pre-tokens of a block lie end to end in one flat
array of symbols. In each round every word merges its pair of lowest rank, at all places from
the left; pairs are found by binary search over the sorted keys ``left << 32 | right``. Words
without a known pair leave the array. A word of more than ``LONG`` symbols is merged with a
heap instead, as its rounds would be many. Encoded pre-tokens are kept per worker in a cache
of at most ``CACHE`` entries; nothing is shuffled.

Defined results: a null text counts as empty (no ids, hashes of nothing). A very long text is
encoded whole; an empty table gives an empty table. Repeated rows give
repeated results; a null doc_id is passed through. Added tokens of the file are found in the
text as the tokenizers library finds them. Columns beyond ``doc_id`` and ``text`` are ignored
by ``encode``/``digest``; ``encode_column`` adds ``token_ids`` and refuses a clashing column
by replacing it (the new one wins).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import textblock as tb

FILE = "byte_bpe_50k.json"
LONG = 2_000
CACHE = 500_000
NONE = np.int64(2**31 - 1)
#: pre-token pattern of this vocabulary (fixed value)
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes themselves, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _Seen(dict):
    """Pre-token -> index; a new one gets the next index and is listed in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.new.append(word)
        return k


class Codec:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        words = [b""] * (1 + max(*vocab.values(), *added.values(), 0))
        for token, i in vocab.items():
            words[i] = bytes(back[c] for c in token)
        for token, i in added.items():
            words[i] = token.encode()
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.table = np.frombuffer(b"".join(words), np.uint8)
        self.split = regex.compile(PATTERN).findall
        self._clear()

    def _clear(self) -> None:
        self.seen = _Seen()
        self.flat, self.off = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE where it is no pair) and its place among the keys."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, end to end, and how many each has."""
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        for k in np.flatnonzero(sizes > LONG):
            ids = self._merge_long(sym[word == k].tolist())
            done_sym.append(np.array(ids, np.int64))
            done_word.append(np.full(len(ids), k))
        if done_sym:
            short = sizes[word] <= LONG
            sym, word = sym[short], word[short]
        while len(sym):
            rank = np.full(len(sym), NONE)
            rank[:-1], at = self.find(sym[:-1], sym[1:])
            rank[:-1][word[:-1] != word[1:]] = NONE
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.concatenate([starts, [len(sym)]])))
            going = least != NONE
            if not going.all():
                done_sym.append(sym[~going])
                done_word.append(word[~going])
            hit = (rank == least) & going
            where = np.flatnonzero(hit)
            if not len(where):
                break
            # places that overlap (a pair of the same symbol): every second one of a run, from the left
            head = np.concatenate([[True], np.diff(where) != 1])
            run = np.arange(len(where)) - np.maximum.accumulate(np.where(head, np.arange(len(where)), 0))
            where = where[run % 2 == 0]
            sym[where] = self.made[at[where]]
            going[where + 1] = False
            sym, word = sym[going], word[going]
        if not done_sym:
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def _merge_long(self, sym: list[int]) -> list[int]:
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        a = np.array(sym, np.int64)
        rank, at = self.find(a[:-1], a[1:])
        heap = [(int(r), i, int(self.made[k]), sym[i], sym[i + 1]) for i, (r, k) in enumerate(zip(rank, at)) if r != NONE]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = right[i]
            if j != -1:
                key = sym[i] << 32 | sym[j]
                k = int(np.searchsorted(self.keys, key))
                if k < len(self.keys) and self.keys[k] == key:
                    heapq.heappush(heap, (int(self.ranks[k]), i, int(self.made[k]), sym[i], sym[j]))

        while heap:
            _, i, new, x, y = heapq.heappop(heap)
            j = right[i]
            if sym[i] != x or j == -1 or sym[j] != y:
                continue
            sym[i], sym[j] = new, -1
            right[i] = right[j]
            if right[j] != -1:
                left[right[j]] = i
            if left[i] != -1:
                push(left[i])
            push(i)
        return [s for s in sym if s != -1]

    def pretokens(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self.split(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.added else self.split(part)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end (uint32), and the ids before each text."""
        if len(self.seen) > CACHE:
            self._clear()
        seen, counts, found = self.seen, [], []
        for t in texts:
            toks = self.pretokens(t) if t else []
            counts.append(len(toks))
            found.append(np.fromiter(map(seen.__getitem__, toks), np.int64, len(toks)))
        if seen.new:
            plain = [w for w in seen.new if w not in self.added]
            ids, n = self.merge([w.encode() for w in plain])
            if len(plain) < len(seen.new):
                parts, ends, k = [], np.concatenate([[0], np.cumsum(n)]), 0
                sizes = []
                for w in seen.new:
                    if w in self.added:
                        parts.append(np.array([self.added[w]], np.uint32))
                    else:
                        parts.append(ids[ends[k] : ends[k + 1]])
                        k += 1
                    sizes.append(len(parts[-1]))
                ids, n = np.concatenate(parts), np.array(sizes)
            self.flat = np.concatenate([self.flat, ids])
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(n)])
            seen.new = []
        index = np.concatenate(found) if found else np.zeros(0, np.int64)
        size = self.off[index + 1] - self.off[index]
        ids = self.flat[spread(self.off[index], size)]
        before = np.concatenate([[0], np.cumsum(size)])
        return ids, before[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, end to end, and the bytes before each."""
        size = self.length[ids]
        before = np.concatenate([[0], np.cumsum(size)])
        return self.table[spread(self.start[ids], size)], before[at]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (size[0] of them), start[1], ..."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _encoded(path: str, batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    texts = batch.column(column)
    c = codec(path)
    for i, n, _, _ in tb.blocks(texts):
        yield i, n, *c.encode(texts.slice(i, n).to_pylist())


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for batch in batches:
        for i, n, ids, at in _encoded(path, batch, "text"):
            raw, cut = c.decode(ids, at)
            little = ids.astype("<u4")
            sha_ids = [hashlib.sha256(little[at[k] : at[k + 1]]).hexdigest() for k in range(n)]
            sha_text = [hashlib.sha256(raw[cut[k] : cut[k + 1]].tobytes().decode("utf-8", "replace").encode()).hexdigest() for k in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, n), pa.array(np.diff(at), pa.int64()), pa.array(sha_ids), pa.array(sha_text)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document the number of ids, and hashes of the ids and of the text decoded from them."""
    work = partial(_digests, path=path or default_path())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _columns(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, n, ids, at in _encoded(path, batch, "text"):
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            part = batch.slice(i, n)
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*batch.schema.names, "token_ids"])


def encode_column(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``token_ids`` (array of int), the ids of ``text``."""
    docs = docs.drop("token_ids")
    schema = docs.limit(0).withColumn("token_ids", F.array().cast("array<int>")).schema
    return docs.mapInArrow(partial(_columns, path=path or default_path()), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
