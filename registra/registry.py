"""Named queries with checked arguments, and read-only SQL over an allow-list of tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Argument:
    kind: type
    default: object = None
    least: float | None = None
    most: float | None = None

    def checked(self, name: str, value: object) -> object:
        if value is None:
            return self.default
        if not isinstance(value, self.kind) or isinstance(value, bool) and self.kind is not bool:
            raise TypeError(f"{name} must be {self.kind.__name__}")
        if self.least is not None and value < self.least or self.most is not None and value > self.most:
            raise ValueError(f"{name} must be within {self.least} and {self.most}")
        return value


@dataclass
class Catalog:
    """name -> (description, function of (tables, **arguments), arguments)."""

    queries: dict[str, tuple[str, Callable[..., DataFrame], dict[str, Argument]]] = field(default_factory=dict)

    def add(self, name: str, description: str, f: Callable[..., DataFrame], **arguments: Argument) -> None:
        self.queries[name] = (description, f, arguments)

    def run(self, name: str, tables: dict[str, DataFrame], **given: object) -> DataFrame:
        """Run a query; unknown names and arguments are refused."""
        if name not in self.queries:
            raise KeyError(f"no query {name}")
        _, f, arguments = self.queries[name]
        if unknown := set(given) - set(arguments):
            raise TypeError(f"unknown arguments {sorted(unknown)}")
        return f(tables, **{k: a.checked(k, given.get(k)) for k, a in arguments.items()})


REFUSED = ("java_method", "reflect", "try_reflect")


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], limit: int = 200) -> DataFrame:
    """Rows of one SELECT over the given tables only, at most ``limit``, with ``_truncated``.

    The tables are the only names that a session of its own knows; files can't be named as tables
    there, and functions that call into the JVM are refused.
    """
    text = sql.strip().rstrip(";").strip()
    if not re.match(r"(?i)(select|with)\b", text) or ";" in text:
        raise ValueError("one SELECT is allowed")
    if re.search(rf"(?i)\b({'|'.join(REFUSED)})\s*\(", text):
        raise ValueError("this function is not allowed")
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    names = {}
    for name, df in tables.items():
        names[name] = df
    for name, df in names.items():
        own.createDataFrame([], df.schema).createOrReplaceTempView(name)
    own.sql(text).schema  # names and syntax are checked in the closed session
    for name, df in names.items():
        df.createOrReplaceTempView(name)
    try:
        found = spark.sql(text).limit(limit + 1)
    finally:
        for name in names:
            spark.catalog.dropTempView(name)
    total = found.agg((F.count(F.lit(1)) > limit).alias("_truncated"))
    return found.limit(limit).join(F.broadcast(total))
