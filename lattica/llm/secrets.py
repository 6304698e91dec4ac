"""Secrets in texts: three fixed patterns, and windows of high Shannon entropy.

Base kinds (leftmost non-overlapping matches per kind, those too short dropped):

* ``assign``: a password, secret, token or API key with a value of 6+ characters; the span is
  the whole assignment,
* ``access``: ``AKIA`` and capitals or digits, 20+ characters,
* ``hex``: lower-case hexadecimal digits, 24+.

The method adds kind ``entropy``: candidate strings are maximal runs of ``[A-Za-z0-9+/_=-]``
of at least the window's length. Each belongs to the narrowest character class that holds all its
characters (``CLASSES``: hexadecimal digits, small letters and digits, capitals and digits, both
letters, letters and digits, base 64), which sets the entropy that a window needs. The window
slides over it; counts of its characters change by one in and one out, and so does the entropy.
Windows that reach the threshold are joined to spans. Suppressed: spans that touch a base span,
and strings on the allow-list (see ``ALLOWED``), which prose, names, addresses and ids match.

Defined results: null and empty texts have no spans (zero counts, the hash of nothing, "").
Repeated rows give repeated results; a null doc_id is passed through. Spans that start at the
same place are listed in the order of ``KINDS``. A very long text is scanned whole, in time linear in
its length, a very long candidate too. An empty table gives an empty table. ``scan`` ignores other
columns; ``redact`` carries them through and sets ``text`` (and ``n_chars``, where there is one).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import textblock as tb

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
VALUE, ACCESS, HEX = 6, 20, 24  # least lengths
WINDOW = 20
#: character classes from narrow to wide: their characters, and the bits of entropy that a window of
#: them needs (random strings of the class have some 0.3 more; 20 different characters have 4.32)
CLASSES = (
    ("hex", re.compile(rb"[0-9a-f]+|[0-9A-F]+"), 3.0),
    ("small", re.compile(rb"[a-z0-9]+"), 3.5),
    ("capital", re.compile(rb"[A-Z0-9]+"), 3.5),
    ("letters", re.compile(rb"[A-Za-z]+"), 3.7),
    ("mixed", re.compile(rb"[A-Za-z0-9]+"), 3.7),
    ("base64", re.compile(rb"[A-Za-z0-9+/_=-]+"), 3.7),
)
#: linear patterns: what a part has taken it doesn't give back, so no string makes them slow
ALLOWED = (
    re.compile(rb"[0-9+/_=-]*+"),  # numbers, dates, rules
    re.compile(rb"(?:[A-Z]*+[a-z]{2,}+(?:[A-Z][a-z](?![a-z]))?+|[a-z](?![A-Za-z])|[A-Z]++(?![a-z])|[+/_=-]++)*+"),  # no digit: words, names joined by capitals, paths
    re.compile(rb"[A-Za-z]++[0-9]{1,6}+(?:[/_=-][A-Za-z]++[0-9]{0,6}+)*+"),  # numbered words
    re.compile(rb"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
)
NAMES = 1  # of these, the one for names; there words must have ``LETTERS`` letters on average
LETTERS = 3.6
ALLOWED_PARTS = re.compile(rb"example|placeholder|changeme|xxxxxx|000000|123456789", re.I)
MASK = "[SECRET]"
_HUMP = re.compile(rb"[a-z](?=[A-Z])|[A-Z](?=[A-Z][a-z])|[A-Za-z](?![A-Za-z])")  # a word's last letter

_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_LOWHEX = np.zeros(256, bool)
_LOWHEX[list(b"0123456789abcdef")] = True


def runs(mask: np.ndarray, off: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of True of at least ``least`` places that cross no text's end."""
    if len(mask) < least:
        return []
    first = np.zeros(len(mask) + 1, bool)
    first[off] = True
    start, end = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1] | first[1:-1]
    end[:-1] &= ~mask[1:] | first[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    keep = e - s >= least
    return list(zip(s[keep].tolist(), e[keep].tolist()))


def allowed(s: bytes) -> bool:
    """Whether the allow-list has a string, in time linear in its length."""
    kind = next((k for k, a in enumerate(ALLOWED) if a.fullmatch(s)), None)
    if kind == NAMES:
        words = len(_HUMP.findall(s))
        return words < 2 or len(s.translate(None, b"+/_=-")) >= LETTERS * words or s.islower() or s.isupper()
    return kind is not None or bool(ALLOWED_PARTS.search(s))


def entropy_spans(s: bytes) -> list[tuple[int, int]]:
    """Unions of the windows of a candidate whose entropy reaches its class's threshold."""
    window = WINDOW
    if len(s) < window or allowed(s):
        return []
    bits = next(bits for _, kind, bits in CLASSES if kind.fullmatch(s))
    weight = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts, total, out = [0] * 256, 0.0, []
    for i, c in enumerate(s):
        if i >= window:  # out first: a window of one character has no count beyond its length
            d = s[i - window]
            total += weight[counts[d] - 1] - weight[counts[d]]
            counts[d] -= 1
        total += weight[counts[c] + 1] - weight[counts[c]]
        counts[c] += 1
        if i >= window - 1 and math.log2(window) - total / window >= bits - 1e-9:
            lo = i - window + 1
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((lo, i + 1))
    return out


def find(data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """text -> [(start, kind, end)] in bytes of the text, for texts that have any."""
    raw = data.tobytes()
    found: dict[int, list[tuple[int, int, int]]] = {}

    def text(place: int) -> int:
        return int(np.searchsorted(off, place, "right")) - 1

    def add(start: int, kind: int, end: int) -> None:
        k = text(start)
        found.setdefault(k, []).append((start - int(off[k]), kind, end - int(off[k])))

    signs = np.flatnonzero((data == 58) | (data == 61))
    for k in np.unique(np.searchsorted(off, signs, "right") - 1).tolist():
        for m in ASSIGN.finditer(raw, int(off[k]), int(off[k + 1])):
            if len(m[2]) >= VALUE:
                add(m.start(), 0, m.end())
    place = raw.find(b"AKIA")
    while place >= 0:
        stop = int(off[text(place) + 1])
        m = re.compile(rb"AKIA[A-Z0-9]+").match(raw, place, stop)
        if m and m.end() - place >= ACCESS:
            add(place, 1, m.end())
        place = raw.find(b"AKIA", max(m.end() if m else 0, place + 1))
    for s, e in runs(_LOWHEX[data], off, HEX):
        add(s, 2, e)
    for s, e in runs(_RUN[data], off, WINDOW):
        for lo, hi in entropy_spans(raw[s:e]):
            k = text(s)
            base = int(off[k])
            if not any(a < s + hi - base and s + lo - base < b for a, kind, b in found.get(k, []) if kind < 3):
                add(s + lo, 3, s + hi)
    for spans in found.values():
        spans.sort()
    return found


def _in_code_points(body: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    at = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
    return [(int(at[a]), kind, int(at[b])) for a, kind, b in spans]


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
_NOTHING = hashlib.sha256(b"").hexdigest()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, n, data, off in tb.blocks(batch.column("text")):
            counts = np.zeros((4, n), np.int64)
            base, every = [_NOTHING] * n, [""] * n
            for k, spans in find(data, off).items():
                spans = _in_code_points(data[off[k] : off[k + 1]], spans)
                for _, kind, _ in spans:
                    counts[kind, k] += 1
                base[k] = hashlib.sha256(_said([x for x in spans if x[1] < 3]).encode()).hexdigest()
                every[k] = _said(spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, n), *(pa.array(counts[c]) for c in range(3)), pa.array(base), pa.array(every), pa.array(counts[3])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"],
            )


def scan(docs: DataFrame) -> DataFrame:
    """Per document the counts of each kind, a hash of the base spans, and all spans."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, SCANNED)


def _redact(batches: Iterator[pa.RecordBatch], mask: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        where = batch.schema.get_field_index("text")
        for i, n, data, off in tb.blocks(batch.column(where)):
            part, found = batch.slice(i, n), find(data, off)
            if not found:
                yield part
                continue
            texts = part.column(where).to_pylist()
            for k, spans in found.items():
                body, out, at = data[off[k] : off[k + 1]].tobytes(), [], 0
                for a, _, b in spans:
                    if b <= at:
                        continue
                    if a >= at:
                        out += [body[at:a], mask.encode()]
                    at = b
                texts[k] = b"".join([*out, body[at:]]).decode()
            columns = list(part.columns)
            columns[where] = pa.array(texts, part.schema.field(where).type)
            c = batch.schema.get_field_index("n_chars")
            if c >= 0:
                sizes = part.column(c).to_pylist()
                for k in found:
                    sizes[k] = len(texts[k])
                columns[c] = pa.array(sizes, part.schema.field(c).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``; texts without one stay as they are."""
    return docs.mapInArrow(partial(_redact, mask=mask), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
