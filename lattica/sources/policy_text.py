"""Policy documents: Markdown with YAML front matter and named sections, and label lists in YAML."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import ship

try:
    import yaml
except ImportError:  # without it a text's front matter is an error of that text
    yaml = None

#: sections that a policy must have (fixed values)
SECTIONS = ("intent", "guidance", "signals", "diagnostic questions", "likely consequences", "exceptions", "positive example", "counterexample", "related policies")
#: scopes, of which the first applies everywhere and the next two must say to whom (fixed values)
SCOPES = ("general", "user", "organisation", "repository", "adr")
HEADING = re.compile(r"^##\s+(.+?)\s*$", re.M)
FIELDS = "path string, id string, title string, description string, scope string, strength string, applies_to string, tags array<string>, author string, body string, sections map<string,string>, content_hash string, error string"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


class _Fault(ValueError):
    pass


def _text(meta: dict[str, Any], name: str) -> str:
    value = meta.get(name)
    if not isinstance(value, str) or not value.strip():
        raise _Fault(f"no {name}")
    return value


def _subject(path: str, scope: str, value: Any, home: str | None) -> str | None:
    """Whom a policy applies to: as it says, or the repository in whose own folder it lies."""
    if scope == "general":
        if value is not None:
            raise _Fault("general policies apply to all")
        return None
    if value is not None:
        if not isinstance(value, str) or not value.strip():
            raise _Fault("applies_to is no text")
        return value.strip()
    root = path.partition(f"/{home}/policies/")[0] if home and f"/{home}/policies/" in path else None
    if scope in SCOPES[1:3] or root is None:
        raise _Fault(f"{scope} policies say to whom they apply")
    return "repo_" + hashlib.sha256(root.encode()).hexdigest()[:24]


def read_policy(path: str, text: str | None, required: tuple[str, ...] = SECTIONS, home: str | None = None) -> tuple:
    """One row of ``FIELDS``; ``error`` names the first fault, and what was read before it stands."""
    row: dict[str, Any] = dict.fromkeys(NAMES) | {"path": path, "content_hash": hashlib.sha256((text or "").encode()).hexdigest()}
    try:
        if not (text or "").startswith("---\n") or text.count("---") < 2:
            raise _Fault("no front matter")
        _, front, body = text.split("---", 2)
        try:
            meta = yaml.safe_load(front) if yaml else None
        except yaml.YAMLError:
            meta = None
        if not isinstance(meta, dict):
            raise _Fault("front matter is no YAML mapping")
        row["body"] = body.strip()
        for name in ("id", "title"):
            row[name] = _text(meta, name)
        row["description"] = meta.get("description") if isinstance(meta.get("description"), str) else None
        row["scope"] = _text(meta, "scope")
        if row["scope"] not in SCOPES:
            raise _Fault("unknown scope")
        row["strength"] = _text(meta, "strength")
        row["applies_to"] = _subject(path, row["scope"], meta.get("applies_to"), home)
        tags = meta.get("tags")
        if not isinstance(tags, list) or any(not isinstance(t, str) for t in tags):
            raise _Fault("tags are no list of texts")
        row["tags"] = tags
        source = meta.get("source")
        if not isinstance(source, dict):
            raise _Fault("no source")
        row["author"] = _text(source, "author")
        found, sections = list(HEADING.finditer(row["body"])), {}
        for k, m in enumerate(found):
            name = m[1].strip().casefold()
            if name in sections:
                raise _Fault(f"a section twice: {m[1].strip()}")
            sections[name] = row["body"][m.end() : found[k + 1].start() if k + 1 < len(found) else None].strip()
        row["sections"] = sections
        if missing := sorted(set(required) - set(sections)):
            raise _Fault("missing: " + ", ".join(missing))
        if empty := sorted(s for s in required if not sections[s]):
            raise _Fault("empty: " + ", ".join(empty))
    except _Fault as fault:
        row["error"] = str(fault)
    return tuple(row[n] for n in NAMES)


def _read(batches: Iterator[pd.DataFrame], required: tuple[str, ...], home: str | None) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([read_policy(p, t, required, home) for p, t in zip(b["path"], b["text"])], columns=NAMES)


def policies(files: DataFrame, required: tuple[str, ...] = SECTIONS, home: str | None = None) -> DataFrame:
    """``FIELDS`` of every text (path, text); ids that several state are an error of all of them."""
    ship(files.sparkSession)
    rows = files.select("path", "text").mapInPandas(partial(_read, required=required, home=home), FIELDS)
    return with_duplicates(rows)


def with_duplicates(rows: DataFrame) -> DataFrame:
    twice = rows.where("id is not null").groupBy("id").agg((F.count("*") > 1).alias("twice"))
    error = F.coalesce("error", F.when(F.col("twice"), F.lit("an id twice")))
    return rows.join(twice, "id", "left").withColumn("error", error).select(*NAMES)


LABELS = "repository string, participants array<string>, bearing array<string>, supporting array<string>, adjacent array<string>, error string"


def read_labels(text: str | None) -> list[tuple]:
    """Rows of ``LABELS`` of a YAML text with a list ``cases``; each needs a repository, participants and a bearing policy."""
    try:
        cases = yaml.safe_load(text or "")["cases"] if yaml else None
    except (yaml.YAMLError, KeyError, TypeError):
        cases = None
    if not isinstance(cases, list):
        return [(None, None, None, None, None, "no list of cases")]
    out = []
    for c in cases:
        c = c if isinstance(c, dict) else {}
        lists = {k: [str(x) for x in c.get(k) or ()] for k in ("participants", "bearing", "supporting", "adjacent")}
        fault = "no repository" if not c.get("repository") else "no participants" if not lists["participants"] else "no bearing policy" if not lists["bearing"] else None
        out.append((c.get("repository") and str(c["repository"]), sorted(lists["participants"]), sorted(set(lists["bearing"])), sorted(set(lists["supporting"])), sorted(set(lists["adjacent"])), fault))
    return out


def _labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in LABELS.split(", ")]
    for b in batches:
        yield pd.DataFrame([r for t in b["text"] for r in read_labels(t)], columns=names)


def label_lists(files: DataFrame) -> DataFrame:
    """``LABELS`` of all cases in YAML texts (text); a repository's participants that several cases name are an error of all."""
    ship(files.sparkSession)
    rows = files.select("text").mapInPandas(_labels, LABELS)
    twice = rows.where("error is null").groupBy("repository", "participants").agg((F.count("*") > 1).alias("twice"))
    error = F.coalesce("error", F.when(F.col("twice"), F.lit("a candidate twice")))
    return rows.join(twice, ["repository", "participants"], "left").withColumn("error", error).select(*rows.columns)
