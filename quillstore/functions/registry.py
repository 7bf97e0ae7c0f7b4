"""Function names with their arity and the Spark SQL that each call becomes.

An entry renders a call from the SQL of its arguments, so Catalyst sees built-in
expressions and nothing else; the few functions that Spark has no expressions for are
Arrow-batched UDFs that ``install`` registers.  Arguments keep their order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType


class UnsupportedFunction(ValueError):
    """A name that is known but has no meaning here, as in the store it comes from."""


@dataclass(frozen=True)
class Function:
    name: str
    least: int
    most: int | None
    build: Callable[..., str]


REGISTRY: dict[str, Function] = {}
#: SQL name -> (function of single values, return type) of the UDFs, and those that give something else each time.
UDFS: dict[str, tuple[Callable, str]] = {}
RANDOM: set[str] = set()
ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}


def define(names: str, least: int, most: int | None, build: Callable[..., str] | str) -> None:
    """Add ``names`` (space-separated); a string is a template with {0}, {1}, ... or {*}."""
    for name in names.split():
        if isinstance(build, str):
            template = build
            fn = lambda *args, t=template: t.replace("{*}", ", ".join(args).replace("{", "{{").replace("}", "}}")).format(*args)
        else:
            fn = build
        REGISTRY[name] = Function(name, least, most, fn)


def same(names: str, least: int, most: int | None) -> None:
    """Functions whose Spark namesake has the same meaning."""
    for name in names.split():
        define(name, least, most, lambda *args, n=name: f"{n}({', '.join(args)})")


def unsupported(names: str, least: int, most: int | None, why: str) -> None:
    def refuse(name: str) -> Callable[..., str]:
        def build(*args: str) -> str:
            raise UnsupportedFunction(f"{name}: {why}")

        return build

    for name in names.split():
        define(name, least, most, refuse(name))


def render(name: str, *args: str) -> str:
    """The Spark SQL of a call, from the SQL of its arguments."""
    found = REGISTRY.get(name.lower())
    if found is None:
        raise UnsupportedFunction(f"{name}: no such function")
    if len(args) < found.least or (found.most is not None and len(args) > found.most):
        raise ValueError(f"{name}: {len(args)} arguments; it takes {found.least} to {found.most if found.most is not None else 'any number'}")
    return "(" + found.build(*args) + ")"


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def call(name: str, *args: str | int | float | None) -> Column:
    """A column: ``name`` over SQL expressions (strings) and numbers."""
    return F.expr(render(name, *(a if isinstance(a, str) else literal(a) for a in args)))


def install(spark: SparkSession) -> SparkSession:
    """Register the UDFs under their names in this session; they take and give Arrow arrays."""
    for name, (fn, kind) in UDFS.items():
        made = F.arrow_udf(batched(fn, kind), kind, ArrowUDFType.SCALAR)
        spark.udf.register(name, made.asNondeterministic() if name in RANDOM else made)
    return spark


def batched(fn: Callable, kind: str) -> Callable[..., pa.Array]:
    """``fn`` of single values over whole arrays."""
    made = ARROW[kind]

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([fn(*row) for row in zip(*(c.to_pylist() for c in columns))], made)

    return run


def _load() -> None:
    from . import compare, crypto, info, json_text, maths, misc, strings, times  # noqa: F401


_load()
