"""Source scan: files to rows of symbols, imports, calls, constants and metrics; edges by joins.

Each file is parsed alone inside a task (``ast``), and gives tagged rows; everything that needs
more than one file — module and symbol resolution, edges, dedup — is a join.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.storage import ship

ROW = "path string, module string, kind string, node_type string, qualified string, parent string, name string, line int, end_line int, is_public boolean, value string"
TASKS = 4  # of the parser, a core
CONFIG_STEMS = {"config", "settings", "configuration"}
#: folders that hold no source, and endings of configuration files (fixed values)
IGNORED = [".git", ".hg", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "build", "dist", "node_modules", "site-packages"]
CONFIG_SUFFIXES = (".yaml", ".yml", ".toml", ".json", ".ini", ".cfg", ".env")


def scan(spark: SparkSession, root: str, exclude: list[str] = (), max_bytes: int | None = None, max_files: int | None = None, config: bool = False) -> DataFrame:
    """(path, source) of the Python files under root, or of its configuration files; bytes that are no UTF-8 are replaced.

    ``max_files`` takes the first ones in path order, after all that is left out.
    """
    ends = "{" + ",".join(f"*{x}" for x in CONFIG_SUFFIXES) + "}" if config else "*.py"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", ends).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    rel = F.expr(f"substring(path, locate('{base}/', path) + {len(base) + 1})")
    files = files.select(rel.alias("path"), "content", "length").where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in IGNORED])))
    for p in exclude:
        files = files.where(~((F.col("path") == p) | F.col("path").startswith(p.rstrip("/") + "/")))
    if max_bytes:
        files = files.where(F.col("length") <= max_bytes)
    if max_files is not None:
        files = files.join(files.select("path").orderBy("path").limit(max_files), "path", "left_semi")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "source": [bytes(c).decode("utf-8", "replace") for c in b["content"]]})

    return files.select("path", "content").mapInPandas(decode, "path string, source string")


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    return None


_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def _own(node: ast.AST) -> Iterator[ast.AST]:
    """What a body holds itself: definitions in it are given, but not entered; a definition's own head is none of its body."""
    todo = list(node.body) if isinstance(node, (ast.Module, *_DEFINITIONS)) else list(ast.iter_child_nodes(node))
    while todo:
        n = todo.pop()
        yield n
        if not isinstance(n, _DEFINITIONS):
            todo += ast.iter_child_nodes(n)


def _nesting(node: ast.AST) -> int:
    """How deep branches and loops lie in each other."""
    deepest, todo = 0, [(node, 0)]
    while todo:
        n, depth = todo.pop()
        for child in ast.iter_child_nodes(n):
            d = depth + isinstance(child, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match))
            deepest = max(deepest, d)
            todo.append((child, d))
    return deepest


def _measures(node: ast.AST) -> dict[str, int]:
    """Syntactic measures of a module, class or function."""
    inside = [n for n in ast.walk(node) if n is not node]
    arguments = getattr(node, "args", None)
    imports = {a.name for n in inside if isinstance(n, ast.Import) for a in n.names} | {"." * n.level + (n.module or "") for n in inside if isinstance(n, ast.ImportFrom)}
    return {
        "statements": sum(isinstance(n, ast.stmt) for n in inside),
        "branches": sum(isinstance(n, (ast.If, ast.For, ast.While, ast.Try, ast.With, ast.BoolOp, ast.IfExp, ast.comprehension)) for n in inside),
        "nesting": _nesting(node),
        "parameters": sum(len(x) for x in (arguments.posonlyargs, arguments.args, arguments.kwonlyargs)) + bool(arguments.vararg) + bool(arguments.kwarg) if arguments else 0,
        "public_symbols": sum(isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and not n.name.startswith("_") for n in ast.iter_child_nodes(node)),
        "imports": len(imports),
    }


def _spelled(annotation: ast.AST | None) -> str:
    return "" if annotation is None else ast.unparse(annotation)


def _tokens(tree: ast.AST) -> list[tuple[str, int]]:
    """(token, line) of identifiers, imported names and strings, cut at humps, digits and signs, lowered; docstrings are left out."""
    docs = {id(n.body[0].value) for n in ast.walk(tree) if isinstance(n, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(n, clean=False) is not None}
    found: set[tuple[str, int]] = set()
    for n in ast.walk(tree):
        text = n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else f"{n.name} {n.asname or ''}" if isinstance(n, ast.alias) else n.name if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) else n.value if isinstance(n, ast.Constant) and isinstance(n.value, str) and id(n) not in docs else None
        if text:
            found |= {(t.lower(), n.lineno) for t in re.findall(r"[A-Z]*[a-z]+|[A-Z]+|[0-9]+", text)}
    return sorted(found)


def rows_of(path: str, source: str, kinds: frozenset[str] | None = None) -> list[tuple]:
    """Tagged rows of one file, of all kinds or of those asked for; a file that doesn't parse gives its module and a signal."""

    def asked(*some: str) -> bool:
        return kinds is None or not kinds.isdisjoint(some)

    module = path.removesuffix(".py").replace("/", ".").removesuffix(".__init__")
    stem = module.rpartition(".")[2]
    test = stem.startswith("test_") or path.startswith("tests/") or "/tests/" in path
    kind = "TEST" if test else "CONFIGURATION" if stem in CONFIG_STEMS else "MODULE"
    lines = source.count("\n") + 1
    out = [(path, module, "module", kind, module, module.rpartition(".")[0] or None, stem, 1, lines, not stem.startswith("_"), None)]
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        out.append((path, module, "signal", None, module, None, "parse-error", 1, 1, None, None))
        return [r for r in out if asked(r[2])]
    aliases: dict[str, str] = {}

    def add(kind: str, node: ast.AST, node_type: str | None, qualified: str | None, parent: str | None, name: str, value: str | None = None, public: bool | None = None) -> None:
        out.append((path, module, kind, node_type, qualified, parent, name, node.lineno, node.end_lineno, public, value))

    def source_of(n: ast.ImportFrom) -> str:
        if not n.level:
            return n.module or ""
        up = module.split(".")[: len(module.split(".")) - n.level + path.endswith("__init__.py")]
        return ".".join([*up, *([n.module] if n.module else [])])

    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            aliases |= {a.asname or a.name.partition(".")[0]: a.name if a.asname else a.name.partition(".")[0] for a in n.names}
        elif isinstance(n, ast.ImportFrom):
            aliases |= {a.asname or a.name: f"{source_of(n)}.{a.name}" for a in n.names}
    for n in tree.body:  # what a body imports when it runs is no dependency of the module
        if isinstance(n, ast.Import):
            for a in n.names:
                add("import", n, None, None, module, a.name)
        elif isinstance(n, ast.ImportFrom):
            add("import", n, None, None, module, source_of(n))

    def abstract(c: ast.ClassDef) -> bool:
        bases = [aliases.get((d := _dotted(b.value if isinstance(b, ast.Subscript) else b) or "").partition(".")[0], d) for b in c.bases]
        metas = [_dotted(k.value) or "" for k in c.keywords if k.arg == "metaclass"]
        marked = any((_dotted(x) or "").rpartition(".")[2] == "abstractmethod" for f in c.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) for x in f.decorator_list)
        return marked or any(b.rpartition(".")[2] in ("Protocol", "ABC") for b in bases) or any(m.rpartition(".")[2] == "ABCMeta" for m in metas)

    def visit(body: list[ast.stmt], parent: str, in_class: bool) -> None:
        for s in body:
            if isinstance(s, ast.ClassDef):
                name = f"{parent}.{s.name}"
                add("symbol", s, "INTERFACE" if abstract(s) else "CLASS", name, parent, s.name, None, not s.name.startswith("_"))
                for b in s.bases:
                    if d := _dotted(b.value if isinstance(b, ast.Subscript) else b):
                        add("base", s, None, name, parent, resolved(d), d)
                used(s, name, parent)
                visit(s.body, name, True)
                measured(s, name)
            elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{parent}.{s.name}"
                node_type = "TEST_FUNCTION" if s.name.startswith("test") and test else "METHOD" if in_class else "FUNCTION"
                add("symbol", s, node_type, name, parent, s.name, None if ast.get_docstring(s) is None else "documented", not s.name.startswith("_"))
                if in_class and asked("operation"):
                    own = [*s.args.posonlyargs, *s.args.args][1:]
                    add("operation", s, None, name, parent, s.name, json.dumps({"async": isinstance(s, ast.AsyncFunctionDef), "arity": len(own) + len(s.args.kwonlyargs), "annotations": [*(_spelled(x.annotation) for x in [*own, *s.args.kwonlyargs]), _spelled(s.returns)]}), not s.name.startswith("_"))
                used(s, name, parent if in_class else None)
                measured(s, name)
                visit([x for x in _own(s) if isinstance(x, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))], name, False)
            elif not in_class and isinstance(s, (ast.Assign, ast.AnnAssign)) and parent == module:
                targets = s.targets if isinstance(s, ast.Assign) else [s.target]
                for t in targets:
                    if isinstance(t, ast.Name) and t.id.isupper() and s.value is not None:
                        try:
                            mark = hashlib.sha256(repr(ast.literal_eval(s.value)).encode()).hexdigest()[:16]
                        except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
                            mark = ""
                        add("constant", s, None, None, module, t.id, mark)

    def used(node: ast.AST, name: str, owner: str | None) -> None:
        """Calls and loaded names of a body as they are written and with aliases put in, without those of definitions inside it."""
        if not asked("call", "reference"):
            return
        for c in _own(node):
            if isinstance(c, ast.Call) and (d := _dotted(c.func)):
                add("call", c, None, name, owner, f"{owner}.{d[5:]}" if owner and d.startswith("self.") else resolved(d), d)
            elif isinstance(c, ast.Name) and isinstance(c.ctx, ast.Load):
                add("reference", c, None, name, owner, resolved(c.id), c.id)

    def measured(node: ast.AST, name: str) -> None:
        if not asked("metric"):
            return
        for k, v in (_measures(node) | {"lines": node.end_lineno - node.lineno + 1}).items():
            add("metric", node, None, name, None, k, str(v))

    def resolved(dotted: str) -> str:
        head, _, tail = dotted.partition(".")
        full = aliases.get(head, head)
        return f"{full}.{tail}" if tail else full

    if asked("symbol", "base", "operation", "call", "reference", "metric", "constant"):
        visit(tree.body, module, False)
        used(tree, module, None)
    if asked("metric"):
        out += [(path, module, "metric", None, module, None, k, 1, lines, None, str(v)) for k, v in (_measures(tree) | {"lines": lines}).items()]
    if asked("token"):
        out += [(path, module, "token", None, module, None, t, line, line, None, None) for t, line in _tokens(tree)]
    return [r for r in out if asked(r[2])]


def parse(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Tagged rows of all files (path, source), or those of the kinds.

    Files are dealt to several tasks a core first: a small table of them may be one split, and parsing takes
    far longer than reading.
    """
    only = None if kinds is None else frozenset(kinds)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROW.split(", ")]
        for b in batches:
            rows = [r for p, s in zip(b["path"], b["source"]) for r in rows_of(p, s or "", only)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"line": "Int32", "end_line": "Int32", "is_public": "boolean"})

    spark = files.sparkSession
    ship(spark)
    dealt = files.select("path", "source").repartition(TASKS * max(spark.sparkContext.defaultParallelism, 1), "path")
    return dealt.mapInPandas(work, ROW)


def import_edges(rows: DataFrame) -> DataFrame:
    """(src, dst) of modules: the imported name as a module, or else the first module below it."""
    mods = rows.where("kind = 'module'").select("module").distinct()
    parts = mods.select("module", F.split("module", "[.]").alias("p")).where(F.size("p") > 1)
    above = parts.select("module", F.explode(F.expr("transform(sequence(1, size(p) - 1), k -> array_join(slice(p, 1, k), '.'))")).alias("name"))
    below = above.groupBy("name").agg(F.min("module").alias("below"))
    i = rows.where("kind = 'import'").select(F.col("module").alias("src"), "name").distinct()
    got = i.join(mods.select(F.col("module").alias("name"), F.col("module").alias("exact")), "name", "left").join(below, "name", "left")
    return got.select("src", F.coalesce("exact", "below").alias("dst")).where("dst is not null and src <> dst").distinct()


def reference_edges(rows: DataFrame) -> DataFrame:
    """(src, dst, confidence) of loaded names that are symbols of the repository."""
    return call_edges(rows, "reference")


def constants(rows: DataFrame) -> DataFrame:
    """(module, name, fingerprint, line) of the constants that modules state; a value that is no literal has an empty fingerprint."""
    return rows.where("kind = 'constant'").select("module", "name", F.col("value").alias("fingerprint"), "line")


def derived_edges(rows: DataFrame) -> DataFrame:
    """(src, dst, edge_type): imports and calls of tests are TESTS as well, imports of configuration are CONFIGURES."""
    kind = rows.where("kind in ('module', 'symbol')").select(F.col("qualified").alias("src"), "node_type").distinct()
    from_ = lambda e: e.select("src", "dst").join(kind, "src")
    imports, calls = from_(import_edges(rows)), from_(call_edges(rows))
    tests = imports.where("node_type = 'TEST'").unionByName(calls.where("node_type in ('TEST', 'TEST_FUNCTION')"))
    out = tests.select("src", "dst", F.lit("TESTS").alias("edge_type"))
    return out.unionByName(imports.where("node_type = 'CONFIGURATION'").select("src", "dst", F.lit("CONFIGURES").alias("edge_type"))).distinct()


def operations(rows: DataFrame, node_type: str) -> DataFrame:
    """(class, operation, is_async, arity, annotations) of the classes or interfaces; only public ones of an interface, no classes of tests."""
    owner = rows.where(F.col("node_type") == node_type).select(F.col("qualified").alias("class"), F.col("path").alias("at"))
    o = rows.where("kind = 'operation'").select(F.col("parent").alias("class"), F.col("name").alias("operation"), "is_public", F.from_json("value", "`async` boolean, arity int, annotations array<string>").alias("v")).join(owner, "class")
    o = o.where("is_public") if node_type == "INTERFACE" else o.where(~F.col("at").startswith("tests/"))
    return o.select("class", "operation", F.col("v.async").alias("is_async"), "v.arity", "v.annotations")


def _resolved(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``named`` (module, name, value, ...) with dst and confidence: the symbol of that name with aliases put in,
    of the own module, or (0.7) the only one with what is written as its dotted tail."""
    s = rows.where("kind = 'symbol'").select("qualified").distinct()
    tails = s.select("qualified", F.split("qualified", "[.]").alias("p")).select("qualified", F.explode(F.expr("transform(sequence(2, size(p)), i -> array_join(slice(p, i, size(p)), '.'))")).alias("value"))
    only = tails.groupBy("value").agg(F.count("*").alias("n"), F.min("qualified").alias("by_tail")).where("n = 1").select("value", "by_tail")
    exact = s.select(F.col("qualified").alias("name"), F.col("qualified").alias("by_name"))
    own = s.select(F.col("qualified").alias("local"), F.col("qualified").alias("by_module"))
    c = named.withColumn("local", F.concat_ws(".", "module", "value")).join(exact, "name", "left").join(own, "local", "left").join(only, "value", "left")
    sure = F.when(F.col("by_name").isNotNull() | F.col("by_module").isNotNull(), 1.0).otherwise(0.7)
    return c.withColumn("dst", F.coalesce("by_name", "by_module", "by_tail")).withColumn("confidence", sure).where("dst is not null")


def call_edges(rows: DataFrame, kind: str = "call") -> DataFrame:
    """(src, dst, confidence) of calls, or of loaded names, that are symbols of the repository (see ``_resolved``)."""
    c = _resolved(rows, rows.where(F.col("kind") == kind).select(F.col("qualified").alias("src"), "module", "name", "value"))
    return c.where("src <> dst").groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def inherit_edges(rows: DataFrame) -> DataFrame:
    """(src, dst, edge_type): INHERITS, and IMPLEMENTS where the base is an interface; bases are found like calls."""
    b = _resolved(rows, rows.where("kind = 'base'").select(F.col("qualified").alias("src"), "module", "name", "value"))
    kind = rows.where("kind = 'symbol'").select(F.col("qualified").alias("dst"), F.col("node_type").alias("t")).distinct()
    e = b.select("src", "dst").join(kind, "dst").distinct()
    return e.select("src", "dst", F.lit("INHERITS").alias("edge_type")).unionByName(e.where("t = 'INTERFACE'").select("src", "dst", F.lit("IMPLEMENTS").alias("edge_type")))


def packages(files: DataFrame) -> DataFrame:
    """(package, parent): every folder above a file."""
    parts = F.split("path", "/")
    k = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    rows = files.select(parts.alias("p"), F.explode(k).alias("k"))
    return rows.select(F.expr("array_join(slice(p, 1, k), '.')").alias("package"), F.expr("nullif(array_join(slice(p, 1, k - 1), '.'), '')").alias("parent")).distinct()


def mentions(rows: DataFrame) -> DataFrame:
    """(path, stem, lines): lines of a file whose identifiers or strings hold another module's stem, ascending."""
    stems = rows.where("kind = 'module'").select(F.lower("name").alias("stem")).distinct()
    own = rows.where("kind = 'module'").select("path", F.lower("name").alias("stem"))
    tokens = rows.where("kind = 'token'").select("path", F.col("name").alias("stem"), "line").join(stems, "stem", "left_semi").join(own, ["path", "stem"], "left_anti")
    return tokens.groupBy("path", "stem").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def excerpt(files: DataFrame, path: str, start: int, end: int, context: int = 3, most: int = 200) -> DataFrame:
    """(line, text) with a numbered gutter: the span and its context, at most so many lines."""
    lo = max(1, start - context)
    hi = min(end + context, lo + most - 1)
    lines = files.where(F.col("path") == path).select(F.posexplode(F.split("source", "\n")).alias("k", "text"))
    return lines.select((F.col("k") + 1).alias("line"), "text").where(F.col("line").between(lo, hi)).select("line", F.format_string("%5d | %s", "line", "text").alias("text"))


def last_edge(edges: DataFrame) -> DataFrame:
    """One row per edge_id: the last one emitted (emit_seq); partial maxima, so a frequent edge meets nowhere whole."""
    rest = [c for c in edges.columns if c != "edge_id"]
    last = edges.groupBy("edge_id").agg(F.max_by(F.struct(*rest), "emit_seq").alias("e"))
    return last.select("edge_id", "e.*").select(*edges.columns)
