"""Token id files: pieces against whole texts, for the file that is cut by words and for one that is not."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import bpe, huffman_ids

PARTS = ["a", "B", "é", "É", "J̌", "ǰ", "ǰ", "'", "'s", "'LL", "S", "***", ".", ",", " ", "\n", "\t", "5", "12", "<|", "<|endoftext|>", "<|startoftext|>", "|>", "ß", "Σ", "σ", "İ", "́", "≠", "≠", "»", "—", " ", "\x1c", " ", "日本", "'t", "don't", "Å", "Å", "K"]


@pytest.mark.parametrize("path", [huffman_ids.default_path(), bpe.default_path()])
def test_encoder_is_the_library(path):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(4_000)] + [None, ""]
    e = huffman_ids.Encoder(path)
    assert e.by_piece == (path == huffman_ids.default_path())
    want = [x.ids for x in e.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # new pieces, then known ones
        ids, at = e.encode(pa.array(texts, pa.string()), None)
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == want
    ids, at = e.encode(pa.array(texts, pa.string()).slice(10, 50), 2)
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(50)] == [x + [2] for x in want[10:60]]


def test_table_of_hashes(monkeypatch):
    t = huffman_ids._Table(100)
    h = np.arange(90, dtype=np.uint64) % np.uint64(9) * np.uint64(256) + np.arange(90, dtype=np.uint64) * np.uint64(1 << 32)
    assert (t.get(h) == -1).all()
    t.add(h[:50])
    t.add(h[50:])
    assert t.get(h).tolist() == list(range(90)) and t.get(h + np.uint64(1)).tolist() == [-1] * 90


def test_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(huffman_ids, "CACHE", 50)
    e = huffman_ids.Encoder(huffman_ids.default_path())
    for k in range(20):
        texts = [f"{'abcdefghijklmnopqrstuvwxyz'[j]}{k}x word. Word" for j in range(12)]
        ids, at = e.encode(pa.array(texts), None)
        assert ids.tolist() == [i for x in e.tok.encode_batch(texts, add_special_tokens=False) for i in x.ids] and e.known.count <= 50
    long_ = " ".join(f"{k:x}q{k % 7}z" for k in range(80))
    ids, at = e.encode(pa.array(["a b", long_]), 2)
    assert ids[at[1] :].tolist() == e.tok.encode(long_, add_special_tokens=False).ids + [2]


def test_files_of_another_tokenizer(spark, tmp_path):
    texts = ["Some Text, with CAPS", "", None, "x " * 500]
    huffman_ids.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f"file://{tmp_path}/ids", bpe.default_path())
    tok = huffman_ids.Encoder(bpe.default_path()).tok
    got = {r.doc_id: r.ids for r in huffman_ids.read(spark, f"file://{tmp_path}/ids").collect()}
    assert got == {k: tok.encode(t or "", add_special_tokens=False).ids + [2] for k, t in enumerate(texts)}
