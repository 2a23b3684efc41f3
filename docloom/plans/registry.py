"""Where queries are registered: a name, a function of the tables and SQL for the same rows, or None."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

QUERIES: dict[str, tuple[Callable, str | None]] = {}
#: Cases of rules, for tests: as QUERIES, but over rows given in the code.
CASES: dict[str, tuple[Callable, str]] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def case(sql: str):
    """As query, but over rows given in the code: for tests."""

    def register(f):
        CASES[f.__name__] = (f, sql)
        return f

    return register


def long(c):
    return (F.col(c) if isinstance(c, str) else c).cast("long")


class Sql(str):
    """An expected value given as SQL."""


def shown(value) -> str:
    """A value as SQL."""
    if isinstance(value, Sql):
        return value
    if value is None:
        return "NULL"
    if isinstance(value, bool | int | float):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of rows given here, with the types in columns: name TYPE, ..."""
    names, types = zip(*[c.split(" ", 1) for c in columns.split(", ")], strict=True)
    lines = ",\n".join("(" + ", ".join(shown(v) for v in r) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types, strict=True))
    return f"SELECT {casts} FROM (VALUES\n{lines}) AS t({', '.join(names)})"


def cases(name: str, f: Callable, rows: list[tuple], kind: str = "VARCHAR", inputs: str | None = None) -> None:
    """Cases n, got over rows of inputs whose last value is what f of the others must give; for tests."""
    width = len(rows[0]) - 1
    schema = "n long, " + (inputs or ", ".join(f"x{i} string" for i in range(width)))
    columns = [c.split(" ", 1)[0] for c in schema.split(", ")][1:]

    def run(t):
        df = t.spark.createDataFrame([(n, *r[:-1]) for n, r in enumerate(rows)], schema)
        return df.select("n", f(*[F.col(c) for c in columns]).alias("got"))

    CASES[name] = (run, values(f"n BIGINT, got {kind}", [(n, r[-1]) for n, r in enumerate(rows)]))
