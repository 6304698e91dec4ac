"""Token counts under a unigram model, with forward scores shared along a trie.

Distinct pre-tokens (words between white space, with the word mark in front) are inserted in a
trie that a worker keeps. The forward score of a node is the best sum of piece scores over all
ways to cut the prefix that it stands for; it is computed when the node is made, from the nodes
above it, so once for all words that share the prefix. A word's last node is its terminal and
stores the number of pieces of its best cut. A trie of more than ``NODES`` nodes, and the words
found in it, are given up and begun anew; nothing is shuffled.

Pieces and scores are those of the tokenizer file. A letter that no piece covers costs
``UNKNOWN`` and counts as its bytes. Of cuts with equal scores the one with fewer pieces wins.

Defined results: null and empty texts, and texts of white space, have 0 words and 0 tokens.
Repeated rows give repeated results, a null doc_id is passed through. A very long text is one block
of bytes; its distinct pre-tokens enter the trie like others. An empty table gives an empty table.
Other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import textblock as tb

FILE = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = -1e6
NODES = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


class Trie:
    """Nodes by number, the root 0: children by (node, letter), forward scores and pieces, terminals."""

    def __init__(self) -> None:
        self.children: dict[int, int] = {}  # node << 21 | letter -> node
        self.best, self.pieces = array("d", [0.0]), array("q", [0])
        self.terminal: dict[int, int] = {}  # node of a whole word -> its tokens

    def __len__(self) -> int:
        return len(self.best)


class Unigram:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): float(model.get_score(i)) for i in plain}
        #: for a piece's last letter the lengths of pieces that end so
        self.lengths: dict[str, list[int]] = {}
        for piece in self.score:
            self.lengths.setdefault(piece[-1], [])
            if len(piece) not in self.lengths[piece[-1]]:
                self.lengths[piece[-1]].append(len(piece))
        for sizes in self.lengths.values():
            sizes.sort()
        self.trie, self.words = Trie(), {}

    def count_all(self, words: list[str]) -> dict[str, int]:
        """Inserts words and returns the tokens stored at their terminals."""
        trie, get, lengths, out = self.trie, self.score.get, self.lengths, {}
        children, best, pieces = trie.children, trie.best, trie.pieces
        path, last = [0], ""
        for plain in sorted(words):  # neighbours share a prefix, whose nodes are still in ``path``
            word, same = MARK + plain, 0
            for x, y in zip(word, last):
                if x != y:
                    break
                same += 1
            del path[same + 1 :]
            node, last = path[-1], word
            for d in range(same + 1, len(word) + 1):
                letter = word[d - 1]
                key = node << 21 | ord(letter)
                above, node = node, children.get(key, 0)
                if not node:
                    top, n = best[above] + UNKNOWN, pieces[above] + len(letter.encode())
                    for size in lengths.get(letter, ()):
                        if size > d:
                            break
                        s = get(word[d - size : d])
                        if s is not None:
                            at = path[d - size]
                            value, k = best[at] + s, pieces[at] + 1
                            if value > top or value == top and k < n:
                                top, n = value, k
                    node = children[key] = len(best)
                    best.append(top)
                    pieces.append(n)
                path.append(node)
            out[plain] = trie.terminal[node] = pieces[node]
        return out

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        if len(self.trie) > NODES:
            self.trie, self.words = Trie(), {}
        split = [t.split() if t else [] for t in texts]
        new: set[str] = set()
        for words in split:
            new.update(words)
        new.difference_update(self.words)
        self.words.update(self.count_all(list(new)))
        get = self.words.__getitem__
        return np.fromiter(map(len, split), np.int64, len(split)), np.fromiter((sum(map(get, w)) for w in split), np.int64, len(split))


_MODELS: dict[str, Unigram] = {}


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _MODELS:
        _MODELS[path] = Unigram(path)
    for batch in batches:
        for i, n, _, _ in tb.blocks(batch.column(1)):
            words, tokens = _MODELS[path].totals(batch.column(1).slice(i, n).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_counted, path=path or default_path()), "doc_id long, n_words long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(spark.read.parquet(f"{sf_dir}/documents.parquet"))
