"""The tree as a data source, policies and labels from YAML, table functions of SQL."""

import os

import pytest
from pyspark.sql import functions as F

from lattica.functions import table_functions
from lattica.sources import policy_text, python_code, tree

FRONT = "---\nid: a-policy\ntitle: 'A: title'\nscope: general\nstrength: guidance\ntags: [x, \"y, z\"]\nsource:\n  author: Me\n---\n"
BODY = "".join(f"## {s.title()}\nabout {s}\n" for s in policy_text.SECTIONS)


@pytest.fixture
def root(tmp_path):
    for path, text in {"b.py": "B = 1\n", "a/x.py": "X = 2\n", "a/long.py": "#" * 500, "a.py": "A = 3\n", "a/.env": "S=1", "conf.yaml": "k: v", "c/.ENV.yml": "k: v", "build/z.py": "Z", "a/node_modules/q.py": "Q", "out/o.py": "O"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "bad.py").write_bytes(b"# \xff\n")
    os.symlink(tmp_path / "b.py", tmp_path / "link.py")
    os.symlink(tmp_path / "a", tmp_path / "linked")
    return str(tmp_path)


def paths(df):
    return [r.path for r in df.select("path").collect()]


def test_tree_rules(spark, root):
    tree.register(spark)
    read = lambda **o: spark.read.format("source_tree").options(**o).load(root)
    assert sorted(paths(read())) == ["a.py", "a/long.py", "a/x.py", "b.py", "bad.py", "out/o.py"]
    assert read().where("path = 'bad.py'").first().source == "# �\n"
    assert paths(read(max_files="3")) == ["a.py", "a/long.py", "a/x.py"]
    assert paths(read(max_files="3", max_bytes="100", exclude="out,a.py")) == ["a/x.py", "b.py", "bad.py"]
    assert paths(read(kind="config")) == ["c/.ENV.yml", "conf.yaml"]
    assert paths(read(kind="config", environment="true")) == ["a/.env", "c/.ENV.yml", "conf.yaml"]
    assert read(files="1").rdd.getNumPartitions() == 6
    for bad in ({"exclude": "/etc"}, {"exclude": "../x"}, {"kind": "java"}):
        with pytest.raises(Exception):
            read(**bad).count()
    same = python_code.scan(spark, root).collect()
    assert {(r.path, r.source) for r in read().select("path", "source").collect()} <= {(r.path, r.source) for r in same}


def test_filters_reach_the_listing(root):
    """What a path or a size tells is asked before a file is opened."""
    from pyspark.sql.datasource import EqualTo, LessThan, StringContains, StringStartsWith

    reader = tree.TreeReader(root, tree.Rules(), 10)
    rest = [StringContains(("source",), "X"), EqualTo(("source",), "x")]
    assert list(reader.pushFilters([StringStartsWith(("path",), "a/"), LessThan(("size",), 100), *rest])) == rest
    (part,) = reader.partitions()
    assert part.files == [("a/x.py", 6)]


def test_pushed_and_parsed(spark, root):
    tree.register(spark)
    files = spark.read.format("source_tree").load(root).where(F.col("path").startswith("a/") & (F.col("size") < 100))
    rows = python_code.constants(python_code.parse(files))
    assert [(r.module, r.name) for r in rows.collect()] == [("a.x", "X")]


@pytest.mark.parametrize(
    "text,error",
    [
        (None, "no front matter"),
        ("id: x", "no front matter"),
        ("---\nid: [\n---\n" + BODY, "front matter is no YAML mapping"),
        ("---\n- x\n---\n" + BODY, "front matter is no YAML mapping"),
        (FRONT.replace("id: a-policy", "id: ' '") + BODY, "no id"),
        (FRONT.replace("scope: general", "scope: team") + BODY, "unknown scope"),
        (FRONT.replace("scope: general", "scope: general\napplies_to: me") + BODY, "general policies apply to all"),
        (FRONT.replace("scope: general", "scope: user") + BODY, "user policies say to whom they apply"),
        (FRONT.replace("scope: general", "scope: adr\napplies_to: 5") + BODY, "applies_to is no text"),
        (FRONT.replace("scope: general", "scope: adr") + BODY, "adr policies say to whom they apply"),
        (FRONT.replace("  author: Me", "  who: Me") + BODY, "no author"),
        (FRONT.replace("tags: [x, \"y, z\"]", "tags: x") + BODY, "tags are no list of texts"),
        (FRONT + BODY + "## GUIDANCE\nmore\n", "a section twice: GUIDANCE"),
        (FRONT + BODY.replace("## Exceptions\n", ""), "missing: exceptions"),
        (FRONT + BODY.replace("about intent\n", ""), "empty: intent"),
        (FRONT + BODY, None),
        (FRONT.replace("scope: general", "scope: adr\napplies_to: ' me '") + BODY, None),
    ],
)
def test_policy_faults(text, error):
    assert policy_text.read_policy("p.md", text)[-1] == error


def test_policies_of_a_repository_and_duplicates(spark):
    own = FRONT.replace("scope: general", "scope: repository").replace("a-policy", "b") + BODY
    files = [("x/.notes/policies/p.md", own), ("y/p.md", own), ("1.md", FRONT + BODY), ("2.md", FRONT + BODY), ("3.md", None)]
    df = spark.createDataFrame(files, "path string, text string")
    got = {r.path: r for r in policy_text.policies(df, home=".notes").collect()}
    assert got["x/.notes/policies/p.md"].applies_to.startswith("repo_") and got["x/.notes/policies/p.md"].error == "an id twice"
    assert got["y/p.md"].error == "repository policies say to whom they apply"
    assert got["1.md"].error == got["2.md"].error == "an id twice" and got["3.md"].error == "no front matter"
    assert got["1.md"].tags == ["x", "y, z"] and got["1.md"].title == "A: title" and got["1.md"].sections["diagnostic questions"] == "about diagnostic questions"
    assert policy_text.policies(df.limit(0)).count() == 0


def test_label_texts():
    assert policy_text.read_labels(None) == policy_text.read_labels("cases: 5") == policy_text.read_labels("a: [") == [(None, None, None, None, None, "no list of cases")]
    rows = policy_text.read_labels("cases:\n  - {repository: r, participants: [b, a], bearing: [z, z, 5]}\n  - {repository: r, participants: []}\n  - {participants: [a], bearing: [x]}\n  - 7\n  - {repository: r, participants: [a]}\n")
    assert rows[0] == ("r", ["a", "b"], ["5", "z"], [], [], None)
    assert [r[-1] for r in rows[1:]] == ["no participants", "no repository", "no repository", "no bearing policy"]


def test_table_functions(spark):
    table_functions.register(spark)
    spark.createDataFrame([("m.py", "def f(): ...\n"), ("n.py", "def ("), ("o.py", None)], "path string, source string").createOrReplaceTempView("some_files")
    rows = spark.sql("select f.path, r.kind, r.name from some_files f, lateral parse_python(f.path, f.source) r where r.kind in ('symbol', 'signal')").collect()
    assert sorted(map(tuple, rows)) == [("m.py", "symbol", "f"), ("n.py", "signal", "parse-error")]
    assert spark.sql("select count(*) from lateral read_labels('cases: [{repository: r, participants: [a], bearing: [x]}]')").first()[0] == 1


def test_files_of_one_split_are_parsed_by_many_tasks(spark):
    from lattica.sources import python_code as code

    files = spark.createDataFrame([(f"pkg/m{k}.py", f"import os\nK = {k}\n\nclass C:\n    def f(self, x: int) -> int:\n        return g(x)\n") for k in range(40)] + [("pkg/bad.py", "def")], "path string, source string").coalesce(1)
    rows = code.parse(files)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    all_ = sorted(map(repr, rows.collect()))
    for kinds in (["import"], ["constant", "module"], ["metric"], ["operation", "symbol"], ["call", "reference"], ["token", "signal"]):
        some = sorted(map(repr, code.parse(files, kinds).collect()))
        assert some == [r for r in all_ if any(f"kind='{k}'" in r for k in kinds)] and some
