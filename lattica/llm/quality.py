"""Document quality by a regularised quadratic discriminant over transformed statistics.

Each text gives the statistics of ``FEATURES`` (shares are put on a log-odds scale, counts on a
log scale). For labelled training rows the class means and covariances are sums that Spark
aggregates (counts, sums, sums of products), so all of them are used, however many; only these
sums reach the driver. Each class covariance is shrunk towards its own diagonal and the pooled
one, its Cholesky factor is kept, and a score is the logistic of the difference of two
Mahalanobis log-densities plus the log-odds of the classes, scaled and shifted as a histogram of
that difference over the training rows asks for.

Defined results: null and empty texts have the statistics of no words and are scored like any
text. Labels that are null, or not 0/1, are no training rows; where a document has several
labels, all count; where there is no training row of a class, every score is the share of
label 1 (0.5 without rows). A null doc_id gets a score; held_out is then null. Repeated rows
are scored alike. A very long text is one block of bytes, handled like others. An empty table gives
an empty table. Other columns are ignored by ``score`` and carried through by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import textblock as tb
from lattica.llm.shared import table

FEATURES = ("words", "word_length", "upper", "symbol", "digit", "distinct", "top_word", "repeats", "lines", "short_line", "pipe", "stop_marks")
SHRINK, POOL, RIDGE = 0.05, 0.05, 1e-3  # towards the diagonal, towards the pooled covariance, added to the diagonal
LIMIT, STEP, PENALTY = 60.0, 0.25, 1.0  # margins are clipped and binned so for calibration, and only there
THRESHOLD = 0.3
FOLDS, HELD = 5, 0

_KIND = {name: np.zeros(256, bool) for name in ("upper", "letter", "digit", "symbol", "space", "newline", "lead", "mark")}
_KIND["upper"][65:91] = True
_KIND["letter"][[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KIND["digit"][48:58] = True
_KIND["space"][[32, *range(9, 14)]] = True
_KIND["newline"][10] = True
_KIND["lead"][[*range(0, 128), *range(192, 256)]] = True
_KIND["mark"][list(b".,;:?'\"()-")] = True
_KIND["symbol"] = ~(_KIND["letter"] | _KIND["digit"] | _KIND["space"] | _KIND["mark"])
_KIND["pipe"] = np.zeros(256, bool)
_KIND["pipe"][list(b"|<>{}")] = True


#: a share counts as drawn towards this usual value by so many further units, so that short texts look usual
USUAL = {"upper": (0.03, 60.0), "symbol": (0.001, 120.0), "digit": (0.001, 120.0), "distinct": (0.3, 8.0), "top_word": (0.06, 20.0), "repeats": (0.02, 30.0), "pipe": (0.0005, 120.0), "stop_marks": (0.03, 60.0)}


def _share(name: str, part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    usual, units = USUAL[name]
    p = (part + usual * units) / (whole + units)
    return np.log(p / np.maximum(1.0 - p, 1e-3))


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text of a block."""
    n = len(off) - 1

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])
        return (c[off[1:]] - c[off[:-1]]).astype(float)

    chars, letters = count(_KIND["lead"]), count(_KIND["letter"])
    s, e, before = tb.word_bounds(data, off)
    words = np.diff(before).astype(float)
    h = tb.word_hashes(data, s, e)
    doc = np.repeat(np.arange(n), np.diff(before))
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    distinct = np.bincount(ds[new], minlength=n).astype(float)
    sizes = np.diff(np.concatenate([np.flatnonzero(new), [len(hs)]]))
    top = np.zeros(n)
    np.maximum.at(top, ds[new], sizes)
    grams, at = tb.run_hashes(h, before, 3)
    kept, kat = tb.distinct_per_text(grams, at)
    all_grams, own_grams = np.diff(at).astype(float), np.diff(kat).astype(float)
    lines = count(_KIND["newline"]) + 1
    good = np.log1p(words)
    return np.stack(
        [
            good,
            np.log1p(chars / (words + 1)),
            _share("upper", count(_KIND["upper"]), letters),
            _share("symbol", count(_KIND["symbol"]), chars),
            _share("digit", count(_KIND["digit"]), chars),
            _share("distinct", words - distinct, words),
            _share("top_word", top, words),
            _share("repeats", all_grams - own_grams, all_grams),
            np.log(lines / (words + 1)),
            np.log1p(words / lines),
            _share("pipe", count(_KIND["pipe"]), chars),
            _share("stop_marks", count(_KIND["mark"]), chars),
        ],
        axis=1,
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, n, data, off in tb.blocks(batch.column(1)):
            x = statistics(data, off)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), *(pa.array(x[:, k].copy()) for k in range(x.shape[1]))], names=["doc_id", *FEATURES])


def features(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows, schema)


class Discriminant:
    """Class means and cached Cholesky factors; scores rows of statistics."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> None:
        total = sum(n for n, _, _ in sums.values())
        self.prior = sums.get(1, (0.0,))[0] / total if total else 0.5
        self.parts, self.scale, self.shift = {}, 1.0, 0.0
        if any(sums.get(c, (0.0,))[0] < 1 for c in (0, 1)):
            return
        cov = {}
        for c, (n, s, p) in sums.items():
            mean = s / n
            cov[c] = (n, mean, p / n - np.outer(mean, mean))
        pooled = sum(n * m for n, _, m in cov.values()) / total
        for c, (n, mean, m) in cov.items():
            m = (1 - SHRINK - POOL) * m + SHRINK * np.diag(np.diag(m)) + POOL * pooled + RIDGE * np.eye(len(m))
            factor = np.linalg.cholesky(m)
            self.parts[c] = (mean, np.linalg.inv(factor), np.log(n / total) - np.log(np.diag(factor)).sum())

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, the classes' log-odds included."""
        g = {c: const - 0.5 * (((x - mean) @ inv.T) ** 2).sum(axis=1) for c, (mean, inv, const) in self.parts.items()}
        return g[1] - g[0]

    def calibrate(self, bins: list[tuple[float, float, float]]) -> None:
        """Logistic regression on (margin, rows of label 0, rows of label 1), lightly regularised."""
        g, n0, n1 = (np.array(v, float) for v in zip(*bins))
        n = n0 + n1
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1.0 / (1.0 + np.exp(-np.clip(w[0] * g + w[1], -500, 500)))
            x = np.stack([g, np.ones_like(g)])
            v = n * p * (1 - p)
            grad = x @ (n1 - n * p) - PENALTY * (w - [1.0, 0.0]) * [1.0, 0.01]
            step = np.linalg.solve((x * v) @ x.T + PENALTY * np.diag([1.0, 0.01]), grad)
            w = w + np.clip(step, -1.0, 1.0)
        if w[0] > 0:
            self.scale, self.shift = float(w[0]), float(w[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.prior)
        return 1.0 / (1.0 + np.exp(np.clip(-(self.scale * self.margin(x) + self.shift), -700.0, 700.0)))  # beyond, a double has no other score


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """From statistics and labels (doc_id, quality) outside the held-out fold."""
    train = labels.where(f"pmod(crc32(cast(doc_id as string)), {FOLDS}) <> {HELD} and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    sums = [F.sum(f) for f in FEATURES] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in pairs]
    out = {}
    known = rows.join(train, "doc_id")
    for r in known.groupBy("quality").agg(F.count("*"), *sums).collect():  # two rows
        s = np.array(r[2 : 2 + len(FEATURES)])
        p = np.zeros((len(FEATURES),) * 2)
        for (i, j), v in zip(pairs, r[2 + len(FEATURES) :]):
            p[i, j] = p[j, i] = v
        out[int(r[0])] = (float(r[1]), s, p)
    model = Discriminant(out)
    if model.parts:
        margins = known.select("quality", *FEATURES).mapInArrow(partial(_margins, model=model), "quality int, bin int")
        bins = margins.groupBy("bin").agg(F.sum(F.expr("int(quality = 0)")), F.sum(F.expr("int(quality = 1)")))
        model.calibrate([(r[0] * STEP, r[1], r[2]) for r in bins.collect()])  # 2 * LIMIT / STEP rows at most
    return model


def _margins(batches: Iterator[pa.RecordBatch], model: Discriminant) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(FEATURES))], axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(np.round(np.clip(model.margin(x), -LIMIT, LIMIT) / STEP).astype(np.int32))], names=["quality", "bin"])


def _scores(batches: Iterator[pa.RecordBatch], model: Discriminant) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(FEATURES))], axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = table(features(docs), "statistics")
    model = fit(rows, labels)
    out = rows.mapInArrow(partial(_scores, model=model), "doc_id long, score double")
    return out.select(
        "doc_id", F.expr(f"pmod(crc32(cast(doc_id as string)), {FOLDS}) = {HELD}").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those whose score is below the threshold (rows of an id go together); null ids stay."""
    bad = score(docs, labels).groupBy("doc_id").agg(F.max("predicted").alias("p")).where("p = 0 and doc_id is not null").select("doc_id")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
