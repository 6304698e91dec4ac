"""A folder of sources as a Spark data source: rules on paths and sizes hold before a file is opened.

``spark.read.format("source_tree").load(root)`` after ``register(spark)``; the tree lies where the
driver and all executors see it. For trees in a store that only Spark reaches, see ``python_code.scan``.
Options: ``kind`` (python or config), ``exclude`` (folders, comma-separated), ``environment`` (true:
files named .env, too), ``max_bytes``, ``max_files`` (the first so many in path order, after all that
is left out), ``files`` (of a partition).
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

from lattica.functions.storage import ship
from lattica.sources.python_code import CONFIG_SUFFIXES, IGNORED

SCHEMA = "path string, size long, source string"


@dataclass
class Rules:
    """What of a tree is listed; kept filters are those that a path and a size can answer."""

    kind: str = "python"
    exclude: tuple[str, ...] = ()
    environment: bool = False
    max_bytes: int | None = None
    max_files: int | None = None
    filters: list[tuple[str, str, object]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.kind not in ("python", "config"):
            raise ValueError(f"kind: python or config, not {self.kind}")
        for p in self.exclude:
            if p.startswith("/") or "\\" in p or ".." in p.split("/"):
                raise ValueError(f"no relative folder: {p}")

    def folder(self, path: str) -> bool:
        return path.rpartition("/")[2] not in IGNORED and not any(path == p.rstrip("/") for p in self.exclude)

    def name(self, path: str) -> bool:
        name = path.rpartition("/")[2]
        if any(path == p.rstrip("/") for p in self.exclude):
            return False
        if self.kind == "python":
            return name.endswith(".py")
        return self.environment if name == ".env" else name.lower().endswith(CONFIG_SUFFIXES)

    def size(self, size: int) -> bool:
        return self.max_bytes is None or size <= self.max_bytes

    def kept(self, path: str, size: int) -> bool:
        own = {"path": path, "size": size}
        tests = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "starts": lambda a, b: a.startswith(b), "ends": lambda a, b: a.endswith(b)}
        return all(tests[op](own[column], value) for column, op, value in self.filters)


def listed(root: str, rules: Rules) -> Iterator[tuple[str, int]]:
    """(path, size) in path order, links left out; nothing is opened."""

    def walk(folder: str) -> Iterator[tuple[str, int]]:
        with os.scandir(os.path.join(root, folder)) as found:
            entries = [e for e in found if not e.is_symlink()]
        # the order of whole paths: what is below a folder stands where its name and a slash would
        for e in sorted(entries, key=lambda e: e.name + "/" * e.is_dir(follow_symlinks=False)):
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_dir(follow_symlinks=False):
                if rules.folder(path):
                    yield from walk(path)
            elif e.is_file(follow_symlinks=False) and rules.name(path) and rules.size(size := e.stat(follow_symlinks=False).st_size):
                yield path, size

    for n, (path, size) in enumerate(walk("")):
        if rules.max_files is not None and n >= rules.max_files:
            return
        if rules.kept(path, size):
            yield path, size


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class TreeReader(DataSourceReader):
    OPS = {EqualTo: "=", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", StringStartsWith: "starts", StringEndsWith: "ends"}

    def __init__(self, root: str, rules: Rules, per: int) -> None:
        self.root, self.rules, self.per = root, rules, per

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what path and size can answer; the rest is Spark's."""
        for f in filters:
            op = self.OPS.get(type(f))
            if op and f.attribute in (("path",), ("size",)):
                self.rules.filters.append((f.attribute[0], op, f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Names and sizes are listed once, so all tasks see one tree; a part has ``files`` files."""
        found = list(listed(self.root, self.rules))
        return [Files(found[k : k + self.per]) for k in range(0, len(found), self.per)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, int, str]]:
        for path, size in partition.files:
            with open(os.path.join(self.root, path), "rb", opener=lambda p, flags: os.open(p, flags | getattr(os, "O_NOFOLLOW", 0))) as f:
                yield path, size, f.read().decode("utf-8", "replace")


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        o = self.options
        number = lambda k: int(o[k]) if k in o else None
        rules = Rules(o.get("kind", "python"), tuple(p for p in o.get("exclude", "").split(",") if p), o.get("environment", "false").lower() == "true", number("max_bytes"), number("max_files"))
        return TreeReader(o["path"].removeprefix("file://"), rules, number("files") or 200)


def register(spark: SparkSession) -> None:
    """Makes the format known, with filters pushed down to it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
