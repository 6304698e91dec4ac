"""Toxicity after noisy-channel deobfuscation of the text.

1. Character language model: counts of 4-grams over the letters of the words of all documents
   (28 symbols: a-z, any other letter, word border), as a fixed table of 28**4 counts.
2. Deobfuscation: a token with a sign next to a letter, letters and signs set apart by spaces or marks, or a letter
   three times or more in a row becomes a lattice: each sign offers the letters that it may
   stand for, separators may be skipped, repeats dropped, each at a cost of the channel. Viterbi
   decoding over the last three letters finds the word that model and channel like best.
3. Scoring: whole words and their first 3 to 6 bytes are features. Those whose
   log-odds between toxic and other training documents are high, and surely so, are kept; a document's
   evidence is the sum over its distinct words of their strongest feature, in the text as it
   stands and as restored, and a logistic curve fitted to training evidence and length makes the score.

Training uses every labelled row outside the held-out fold. Features are counted, joined and
judged on Spark, whatever their number. Those kept are dealt to blocks of about ``PART``; the
driver and a task hold one block, and with more than one the evidence is summed block by block.

Defined results: null and empty texts have no evidence and the score of that. Labels that are
null or not 0/1 are no training rows; without both labels every score is the share of label 1.
A null doc_id gets a score, and null for held_out. Repeated rows are scored alike. A very long text
is one block of bytes, and counts each of its distinct words once, whatever its length. An empty
table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import textblock as tb
from lattica.llm.ids import id_bits, with_bit
from lattica.llm.shared import table

FOLDS, HELD = 3, 1
THRESHOLD = 0.7
ORDER, SYMBOLS = 4, 28
PREFIXES = (3, 4, 5, 6)
LEAST = 3  # toxic documents that a feature needs
PART = 1 << 20  # features of the lexicon that a task holds at once
SURE, FLOOR = 24.0, 1.0  # likelihood ratio that a kept feature needs (about one chance in a million); least log-odds less its error
STEP, PENALTY = 0.25, 0.5
CEILING = 200.0  # evidence of the last bin that the curve is fitted to; scores use all evidence

#: letters that signs may stand for (fixed values)
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h"}
APART = ".-_~* "
SIGN_COST, SKIP_COST, REPEAT_COST, WILD_COST = 0.4, 0.2, 0.3, 1.0

_LETTER, _SIGN = r"[^\W\d_]", r"[0-9@$!|+(€£*#]"
_UNIT = r"(?:[^\W\d_]|[0-9@$!|+(€£#])"  # without what may also set letters apart
_OPEN, _CLOSE = "\"'([{<", r"[.,;:?!\"')\]}>]*"

#: letters and signs set apart: i d i o t, i.d.1.0.t, with quotes before and punctuation after
SPACED = re.compile(rf"(?<![^\s{re.escape(_OPEN)}])({_UNIT}(?:[ ._*~-]+{_UNIT}){{2,}}){_CLOSE}(?!\S)")
#: inside a token: a sign next to a letter, marks between letters or signs, or a letter thrice
SIGNED = re.compile(rf"{_LETTER}{_SIGN}|{_SIGN}{_LETTER}|{_LETTER}[._*~-]+(?:{_LETTER}|{_SIGN})|{_SIGN}[._*~-]+{_LETTER}|({_LETTER})\1\1")

ENDS = ".,;:?\"'[]{}<>)"

_CODE = np.zeros(256, np.int64)
_CODE[65:91] = _CODE[97:123] = np.arange(1, 27)
_CODE[0xC3:0xF5] = 27
_SKIP = np.zeros(256, bool)
_SKIP[0x80:0xC0] = True


def gram_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of 4-grams of letters; what lies before a word's first letter is the border."""
    if not len(data):
        return np.zeros(SYMBOLS**ORDER, np.int64)
    code = _CODE[data]
    border = np.zeros(len(data) + 1, bool)
    border[off] = True
    c = np.insert(code, np.flatnonzero(border[:-1]), 0)
    keep = ~np.insert(_SKIP[data], np.flatnonzero(border[:-1]), False)
    c = np.concatenate([c[keep], [0]])
    c = c[~((c == 0) & (np.concatenate([[0], c[:-1]]) == 0))]
    if not len(c):
        return np.zeros(SYMBOLS**ORDER, np.int64)
    index, open_ = c.copy(), np.ones(len(c), bool)
    for k in range(1, ORDER):
        before = np.concatenate([np.zeros(k, np.int64), c[:-k]]) if len(c) > k else np.zeros(len(c), np.int64)
        before = np.where(open_, before, 0)
        index += before * SYMBOLS**k
        open_ &= before != 0
    return np.bincount(index, minlength=SYMBOLS**ORDER)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**ORDER, np.int64)
    for batch in batches:
        for _, _, data, off in tb.blocks(batch.column(0)):
            total += gram_counts(data, off)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["gram", "n"])


class CharModel:
    """Interpolated log-probabilities of a letter after the three before it."""

    def __init__(self, counts: np.ndarray) -> None:
        c = counts.reshape((SYMBOLS,) * ORDER).astype(float)
        p = np.full(SYMBOLS, 1.0 / SYMBOLS)
        for k in range(1, ORDER + 1):  # from one letter to four
            n = c.sum(axis=tuple(range(ORDER - k)))
            whole = n.sum(axis=-1, keepdims=True)
            kinds = (n > 0).sum(axis=-1, keepdims=True) + 1.0
            p = (n + kinds * p) / (whole + kinds)
        self.log = np.log(p).reshape(-1, SYMBOLS)
        self.seen: dict[str, str] = {}

    @staticmethod
    def code(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27

    def decode(self, token: str) -> str:
        """The likeliest word behind a token; only letters."""
        if token not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[token] = self._decode(token.lower())
        return self.seen[token]

    def _decode(self, token: str) -> str:
        log = self.log
        beam = {(0, 0, 0): (0.0, "")}
        token = re.sub(r"(.)\1{2,}", "\\1\\1\0", token)  # a long run: once, perhaps twice
        end = len(token.rstrip("!\0"))  # from here on a ! may close a sentence
        for k, (c, after) in enumerate(zip(token, token[1:] + " ")):
            options: list[tuple[str, float]] = []
            if c == "\0":
                continue
            if c.isalpha() and c not in LEET:
                options.append((c, 0.0))
                if after == "\0":
                    options.append(("", REPEAT_COST))
            else:
                closing = c == "!" and k >= end
                options += [(x, WILD_COST if c == "*" else SIGN_COST) for x in LEET.get(c, "")]
                options.append(("", SKIP_COST if c in APART or closing else 2.5 if c in LEET else 1.0))
            new: dict[tuple[int, int, int], tuple[float, str]] = {}
            for (x, y, z), (score, word) in beam.items():
                for letter, cost in options:
                    if letter:
                        to = self.code(letter)
                        state, value = (y, z, to), score - cost + log[(x * SYMBOLS + y) * SYMBOLS + z, to]
                    else:
                        state, value = (x, y, z), score - cost
                    if state not in new or value > new[state][0]:
                        new[state] = (value, word + letter)
            beam = new
        return max(((s + log[(x * SYMBOLS + y) * SYMBOLS + z, 0], w) for (x, y, z), (s, w) in beam.items()), default=(0.0, ""))[1]


def language_model(docs: DataFrame) -> CharModel:
    grams = docs.select("text").mapInArrow(_grams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**ORDER, np.int64)
    for r in grams.collect():  # 28**4 rows at most
        counts[r[0]] = r[1]
    return CharModel(counts)


_MAYBE, _APART = np.zeros(256, bool), np.zeros(256, bool)
_MAYBE[list(b"0123456789@$!|+(*#._~-")] = True
_APART[list(APART.encode())] = True
_APART |= tb.SPACE
_AFTER = _MAYBE.copy()  # signs that count after a letter; marks do only before one
_AFTER[list(b"._~-")] = False


def _runs(run: str) -> list[str]:
    """A run of letters set apart, and the parts that wider gaps make of it: i d i o t  y o u."""
    least = min(len(g) for g in re.findall(r"[ ._*~-]+", run))
    parts = re.split(rf"[ ._*~-]{{{least + 1},}}", run)
    return [run, *(p for p in parts if len(parts) > 1 and len(re.findall(_UNIT, p)) > 2)]


def restored(model: CharModel, text: str) -> list[str]:
    """Words that the text hides."""
    found, rest, at = [], [], 0
    for m in SPACED.finditer(text):
        if re.search(_LETTER, m[1]):
            found += _runs(m[1])
            rest.append(text[at : m.start()])
            at = m.end()
    found += [t.strip(ENDS) for part in (*rest, text[at:]) for t in part.split() if SIGNED.search(t)]
    return [w for t in found if (w := model.decode(t))]


def _hits(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in tokens that may hide a word (a sign next to letters, a letter thrice), and the texts where letters and signs stand alone."""
    none = np.zeros(0, np.int64)
    if len(data) < 2:
        return none, none
    letter = _CODE[data] > 0
    letter |= _SKIP[data]
    space = tb.SPACE[data]
    hit = np.zeros(len(data), bool)
    hit[1:] |= _MAYBE[data[:-1]] & letter[1:] & ~space[1:]
    hit[1:] |= _AFTER[data[1:]] & letter[:-1]
    hit[1:] |= (data[:-1] == 0xC2) & (data[1:] == 0xA3)  # the pound sign, and the euro
    hit[2:] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x82) & (data[2:] == 0xAC)
    # a letter, marks, and a sign: i.1
    hit[2:] |= letter[:-2] & _APART[data[1:-1]] & ~space[1:-1] & ~space[2:] & ~letter[2:]
    low = tb.LOWER[data]
    hit[2:] |= letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    for w in (2, 3, 4):  # a letter of several bytes thrice: two of its bytes are compared
        if len(data) >= 3 * w:
            same = (data[: -2 * w] == data[w:-w]) & (data[w:-w] == data[2 * w :])
            hit[: -2 * w - 1] |= same[:-1] & same[1:] & (data[: -2 * w - 1] >= 0xC2)
    # three characters in a row that each begin after a gap, however wide; longer ones are told apart later
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    at, alone = np.flatnonzero(~_APART[data] & ~_SKIP[data]), none
    if len(at) > 2:
        gap = np.cumsum(_APART[data] | first[:-1])
        lone = np.ones(len(at), bool)
        lone[1:] = gap[at[1:]] > gap[at[:-1]]
        lone |= first[at]
        before = np.zeros(len(at), bool)  # quotes and brackets may open the run
        before[1:] = np.isin(data[at[:-1]], list(_OPEN.encode()))
        alone = at[2:][(lone[:-2] | before[:-2]) & lone[1:-1] & lone[2:]]
    return np.flatnonzero(hit), np.unique(np.searchsorted(off, alone, "right") - 1)


def _flagged(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts that may hide words."""
    places, alone = _hits(data, off)
    return np.union1d(np.searchsorted(off, places, "right") - 1, alone)


def hidden_words(data: np.ndarray, off: np.ndarray, model: CharModel) -> tuple[list[str], list[int]]:
    """Restored words of texts, and the text of each.

    Texts with letters set apart are read whole (see ``restored``); of others only the tokens that hold a hit.
    """
    raw, words, owner, whole = data.tobytes(), [], [], []
    places, alone = _hits(data, off)
    for k in alone.tolist():
        text = raw[off[k] : off[k + 1]].decode()
        if any(re.search(_LETTER, m[1]) for m in SPACED.finditer(text)):
            found = restored(model, text)
            words += found
            owner += [k] * len(found)
            whole.append(k)
    s, e, _ = tb.word_bounds(data, off)
    if len(s) and len(places):
        token = np.unique(np.searchsorted(s, places, "right") - 1)
        token = token[token >= 0]
        text = np.searchsorted(off, s[token], "right") - 1
        rest = ~np.isin(text, np.array(whole, np.int64))
        for a, b, k in zip(s[token[rest]].tolist(), e[token[rest]].tolist(), text[rest].tolist()):
            found = restored(model, raw[a:b].decode())
            words += found
            owner += [k] * len(found)
    return words, owner


def word_features(data: np.ndarray, off: np.ndarray, model: CharModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts, plain and restored: text, first 3 bytes, and their hashes' ingredients."""
    extra, owner = hidden_words(data, off, model)
    n = len(data)
    if extra:
        more = np.frombuffer(("\n" + "\n".join(extra) + "\n").encode(), np.uint8)
        s2, _, _ = tb.word_bounds(more, np.array([0, len(more)]), tb.APART)
        data = np.concatenate([data, more])
        off = np.append(off, len(data))
    s, e, before = tb.word_bounds(data, off, tb.APART)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(before))
    if extra:
        doc[s >= n] = np.array(owner)
    return data, s, e, doc, first_three(data, s, e)


def first_three(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    low = np.concatenate([tb.LOWER[data], np.zeros(3, np.uint8)]).astype(np.int32)
    out = low[s] << 16
    out |= np.where(e - s > 1, low[s + 1], 0) << 8
    out |= np.where(e - s > 2, low[s + 2], 0)
    return out


def hashed(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(which words, hash) for the whole word and each prefix shorter than it."""
    out = [(np.arange(len(s)), tb.word_hashes(data, s, e))]
    for k in PREFIXES:
        which = np.flatnonzero(e - s > k)
        out.append((which, tb.word_hashes(data, s[which], s[which] + k) ^ np.uint64(0xABCDEF * k)))
    return out


def _features(batches: Iterator[pa.RecordBatch], model: CharModel) -> Iterator[pa.RecordBatch]:
    """(feature, first three bytes, documents) of each batch."""
    for batch in batches:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, _, data, off in tb.blocks(batch.column(0)):
            data, s, e, doc, three = word_features(data, off, model)
            parts = hashed(data, s, e)
            h = np.concatenate([x for _, x in parts])
            which = np.concatenate([w for w, _ in parts])
            order = np.lexsort((h, doc[which]))
            h, d, t = h[order], doc[which][order], three[which][order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            held.append((h[new], t[new]))
        if held:
            h, t = (np.concatenate(x) for x in zip(*held))
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(t[at], pa.int32()), pa.array(n, pa.int64())], names=["id", "three", "n"])


class Lexicon:
    """Sorted features with weights, and which first three bytes any of them has."""

    def __init__(self, feature: np.ndarray, three: np.ndarray, weight: np.ndarray) -> None:
        order = np.argsort(feature)
        self.feature, self.three, self.weight = feature[order], np.unique(three), weight[order]
        self._mask: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_mask": None}

    def mask(self) -> np.ndarray:
        if self._mask is None:
            self._mask = np.zeros(1 << 24, bool)
            self._mask[self.three] = True
        return self._mask

    def hits(self, data: np.ndarray, off: np.ndarray, model: CharModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash of the whole word, place of the feature) for every feature of every word."""
        data, s, e, doc, three = word_features(data, off, model)
        near = np.flatnonzero(self.mask()[three]) if len(s) else np.zeros(0, np.int64)
        s, e, doc = s[near], e[near], doc[near]
        if not len(s) or not len(self.feature):
            z = np.zeros(0, np.int64)
            return z, z.view(np.uint64), z
        parts = hashed(data, s, e)
        whole = parts[0][1]
        which, h = np.concatenate([w for w, _ in parts]), np.concatenate([x for _, x in parts])
        at = np.minimum(np.searchsorted(self.feature, h), len(self.feature) - 1)
        ok = self.feature[at] == h
        return doc[which[ok]], whole[which[ok]], at[ok]

    def evidence(self, data: np.ndarray, off: np.ndarray, model: CharModel) -> np.ndarray:
        doc, word, at = self.hits(data, off, model)
        out = np.zeros(len(off) - 1)
        if len(doc):
            w = self.weight[at]
            order = np.lexsort((-w, word, doc))
            doc, word, w = doc[order], word[order], w[order]
            new = np.ones(len(doc), bool)
            new[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
            np.add.at(out, doc[new], w[new])
        return out


def _evidence(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, model: CharModel, last: bool) -> Iterator[pa.RecordBatch]:
    """Adds this block's evidence to each row; at the last block its words take the place of the text."""
    for batch in batches:
        for i, n, data, off in tb.blocks(batch.column(1)):
            total = batch.column(2).slice(i, n).to_numpy() + lexicon.evidence(data, off, model)
            text = pa.array(words_of(data, off), pa.int64()) if last else batch.column(1).slice(i, n)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), text, pa.array(total)], names=["key", "words" if last else "text", "evidence"])


def words_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(tb.word_bounds(data, off)[2])


def design(evidence: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Evidence weighs less in a long text, where chance brings more of it."""
    size = np.log1p(words) - 5.0
    return np.stack([evidence, size, evidence * size, np.ones_like(size)], axis=1)


def logistic(x: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Coefficients for (rows of the design, rows of label 0, rows of label 1), lightly regularised."""
    w, n, pull = np.zeros(x.shape[1]), n0 + n1, PENALTY * np.array([1.0, 1.0, 1.0, 0.01])
    for _ in range(200):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -500, 500)))
        v = n * p * (1 - p)
        step = np.linalg.solve((x.T * v) @ x + np.diag(pull), x.T @ (n1 - n * p) - pull * w)
        w = w + step * min(1.0, 1.0 / (1e-9 + np.abs(step).max()))
    return w


def judged(known: DataFrame, model: CharModel, toxic: int, other: int) -> DataFrame:
    """(feature, three, weight) of the features that are surely more frequent in toxic rows of ``known``."""
    schema = "id long, three int, n long"
    found = known.where("toxic = 1").select("text").mapInArrow(partial(_features, model=model), schema)
    found = table(found.groupBy("id").agg(F.min("three").alias("three"), F.sum("n").cast("double").alias("t")).where(F.col("t") >= LEAST), "toxic_features")
    counts = known.where("toxic = 0").select("text").mapInArrow(partial(_features, model=model), schema).select("n", "id")
    counts = with_bit(counts, id_bits(found), schema="n long, id long").groupBy("id").agg(F.sum("n").cast("double").alias("n"))
    both = found.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    t, n, rest = F.col("t"), F.col("n"), F.greatest(F.lit(float(other)) - F.col("n"), F.lit(0.0))
    odds = F.ln((t + 0.5) / (toxic - t + 0.5)) - F.ln((n + 0.5) / (rest + 0.5))
    low = odds - F.sqrt(1 / (t + 0.5) + 1 / (n + 0.5))
    share = (t + n) * (toxic / max(toxic + other, 1))  # expected among the toxic ones by chance
    g = 2 * (t * F.ln(t / share) + F.when(n > 0, n * F.ln(n / (t + n - share))).otherwise(0.0))
    return both.select(F.col("id").alias("feature"), "three", low.alias("weight"), g.alias("g")).where((F.col("weight") >= FLOOR) & (F.col("g") >= SURE)).drop("g")


def evidence(rows: DataFrame, kept: DataFrame, model: CharModel, part: int = PART) -> DataFrame:
    """(key, words, evidence) of the rows (key, text).

    All features of a word begin with the same three bytes, so blocks by these never part them.
    """
    blocks = max(1, math.ceil(kept.count() / part))
    kind = rows.schema[0].dataType.simpleString()
    out = rows.toDF("key", "text").withColumn("evidence", F.lit(0.0))
    for k in range(blocks):
        block = kept.where(F.pmod(F.xxhash64("three"), F.lit(blocks)) == k).toPandas()
        lexicon = Lexicon(block.feature.to_numpy(np.int64).view(np.uint64), block.three.to_numpy(np.int64), block.weight.to_numpy(float))
        last = k == blocks - 1
        out = out.mapInArrow(partial(_evidence, lexicon=lexicon, model=model, last=last), f"key {kind}, {'words long' if last else 'text string'}, evidence double")
        out = out if last else table(out, "evidence")
    return out


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    train = labels.where(f"pmod(crc32(cast(doc_id as string)), {FOLDS}) <> {HELD} and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = table(with_bit(texts, id_bits(train)).join(train, "id").select("toxic", "text"), "labelled")
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if toxic and other:
        model = language_model(docs)
        kept = table(judged(known, model, toxic, other), "lexicon")
        every = table(evidence(texts, kept, model), "evidence")  # of all rows once; training rows are among them
        bin_, size = (F.rint(x / STEP).cast("int") for x in (F.least("evidence", F.lit(CEILING)), F.log1p("words")))
        trained = every.join(train.withColumnRenamed("id", "key"), "key")
        bins = trained.groupBy(bin_.alias("bin"), size.alias("size")).agg(F.sum(1 - F.col("toxic")), F.sum("toxic")).collect()
        x, n_words, n0, n1 = (np.array(v, float) for v in zip(*bins))  # some thousand rows at most: both are clipped or logarithms
        curve = logistic(design(x * STEP, np.expm1(n_words * STEP)), n0, n1).tolist()
        e, w = F.col("evidence"), F.log1p("words") - 5.0
        z = e * curve[0] + w * curve[1] + e * w * curve[2] + curve[3]
        out = every.select(F.col("key").alias("doc_id"), (1 / (1 + F.exp(-z))).alias("score"))
    else:
        out = texts.select(F.col("id").alias("doc_id"), F.lit(toxic / (toxic + other) if toxic + other else 0.5).alias("score"))
    held = F.expr(f"pmod(crc32(cast(doc_id as string)), {FOLDS}) = {HELD}")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
