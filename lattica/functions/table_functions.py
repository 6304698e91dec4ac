"""The source parser and the policy reader as table functions of SQL: FROM files, LATERAL parse_python(path, source)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lattica.functions.storage import ship
from lattica.sources import policy_text, python_code


class ParsePython:
    """Tagged rows of one Python file (see ``python_code``)."""

    def eval(self, path: str, source: str) -> Iterator[tuple]:
        yield from (r[1:] for r in python_code.rows_of(path, source or ""))


class ReadPolicy:
    """The fields of one policy text (see ``policy_text``)."""

    def eval(self, path: str, text: str) -> Iterator[tuple]:
        yield policy_text.read_policy(path, text)[1:]


class ReadLabels:
    """The cases of one YAML text of labels."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from policy_text.read_labels(text)


def _rest(schema: str) -> str:
    """A schema without its first column, which the caller has."""
    return schema.split(", ", 1)[1]


def register(spark: SparkSession) -> None:
    """Makes ``parse_python(path, source)``, ``read_policy(path, text)`` and ``read_labels(text)`` known; batches go by Arrow."""
    ship(spark)
    for name, kind, schema in (("parse_python", ParsePython, _rest(python_code.ROW)), ("read_policy", ReadPolicy, _rest(policy_text.FIELDS)), ("read_labels", ReadLabels, policy_text.LABELS)):
        spark.udtf.register(name, udtf(kind, returnType=schema, useArrow=True))
