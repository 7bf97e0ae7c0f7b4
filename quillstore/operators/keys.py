"""Key sets as predicates: all keys, key lists, open and closed ranges, prefixes, and their union."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer lists of single values, and of other keys, are joined instead of written into the predicate.
IN_LIST, FEW = 1000, 24
#: Key lists up to this many keys are broadcast; the caller's list is in memory anyway.
BROADCAST_KEYS = 1_000_000

Key = tuple


@dataclass(frozen=True)
class KeyRange:
    """From ``start`` to ``end``; a shorter key stands for all keys that begin with it; None is unbounded."""

    start: Key | None = None
    end: Key | None = None
    start_closed: bool = True
    end_closed: bool = False


@dataclass(frozen=True)
class KeySet:
    everything: bool = False
    keys: tuple[Key, ...] = ()
    ranges: tuple[KeyRange, ...] = ()
    prefixes: tuple[Key, ...] = ()

    @classmethod
    def all(cls) -> KeySet:
        return cls(everything=True)

    @classmethod
    def of(cls, *keys: object) -> KeySet:
        return cls(keys=tuple(k if isinstance(k, tuple) else (k,) for k in keys))

    @classmethod
    def range(cls, start: object = None, end: object = None, start_closed: bool = True, end_closed: bool = False) -> KeySet:
        as_key = lambda k: k if k is None or isinstance(k, tuple) else (k,)
        return cls(ranges=(KeyRange(as_key(start), as_key(end), start_closed, end_closed),))

    @classmethod
    def prefix(cls, *key: object) -> KeySet:
        return cls(prefixes=(tuple(key),))

    def __or__(self, other: KeySet) -> KeySet:
        return KeySet(self.everything or other.everything, self.keys + other.keys, self.ranges + other.ranges, self.prefixes + other.prefixes)


def equals(columns: Sequence[str], key: Key) -> Column:
    """Equality on as many columns as the key has; NULL equals NULL."""
    if len(key) > len(columns):
        raise ValueError(f"a key of {len(key)} values for {len(columns)} columns")
    tests = [F.col(f"`{c}`").isNull() if v is None else F.col(f"`{c}`") == F.lit(v) for c, v in zip(columns, key)]
    return reduce(Column.__and__, tests) if tests else F.lit(True)


def _bound(columns: Sequence[str], key: Key, below: bool, closed: bool, nulls: bool = True) -> Column:
    """Keys above (``below`` false) or below a bound, in key order; NULL comes first, unless ``nulls`` says there is none.

    Nested as first-column test and tie, so the implied range of the first column stands
    alone and reaches the scan.
    """
    column, value, rest = F.col(f"`{columns[0]}`"), key[0], key[1:]
    if value is None:
        strict, tie, implied = F.lit(False) if below else column.isNotNull(), column.isNull(), F.lit(True)
    elif below:
        strict, tie, implied = column < F.lit(value), column == F.lit(value), column <= F.lit(value)
        if nulls:
            strict, implied = column.isNull() | strict, column.isNull() | implied
    else:
        strict, tie, implied = column > F.lit(value), column == F.lit(value), column >= F.lit(value)
    if rest:
        return implied & (strict | (tie & _bound(columns[1:], rest, below, closed)))
    if not closed:
        return strict
    return strict | tie if value is None else implied


def lower_bound(columns: Sequence[str], key: Key) -> Column:
    """Keys from ``key`` on, in key order."""
    return _bound(columns, key, False, True)


def _tests(columns: Sequence[str], keys: KeySet, listed: Sequence[Key]) -> Column:
    """Whether a row is in ``listed`` or in the prefixes and ranges of ``keys``."""
    tests: list[Column] = []
    if listed and all(len(k) == 1 and k[0] is not None for k in listed):
        tests.append(F.col(f"`{columns[0]}`").isin(*[k[0] for k in listed]))
    else:
        tests += [equals(columns, k) for k in listed]
    tests += [equals(columns, p) for p in keys.prefixes]
    for r in keys.ranges:
        parts = [_bound(columns, r.start, False, r.start_closed)] if r.start else []
        parts += [_bound(columns, r.end, True, r.end_closed, not (r.start and r.start[0] is not None))] if r.end else []
        tests.append(reduce(Column.__and__, parts) if parts else F.lit(True))
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def plain(key: Key) -> Key:
    """``key`` with its byte arrays as bytes, which can be compared by a dictionary."""
    return tuple(bytes(v) if isinstance(v, bytearray) else v for v in key)


def _lists(columns: Sequence[str], keys: KeySet) -> tuple[list[Key], dict[int, list[Key]]]:
    """Keys for the predicate, and by their length those that are joined."""
    by_size: dict[int, list[Key]] = {}
    for k in {plain(k): k for k in keys.keys}.values():
        if len(k) > len(columns):
            raise ValueError(f"a key of {len(k)} values for {len(columns)} columns")
        by_size.setdefault(len(k), []).append(k)
    few = lambda n, own: len(own) <= (IN_LIST if n == 1 and (None,) not in own else FEW)
    return [k for n, own in by_size.items() if few(n, own) for k in own], {n: own for n, own in by_size.items() if not few(n, own)}


def _listed(df: DataFrame, columns: Sequence[str], keys: list[Key]) -> tuple[DataFrame, Column]:
    """The keys as a table, and the condition that joins it to ``df`` (as o and n); NULL equals NULL."""
    own = columns[: len(keys[0])]
    wanted = df.sparkSession.createDataFrame(keys, df.select(*[F.col(f"`{c}`") for c in own]).schema)
    if len(keys) <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    return wanted, reduce(Column.__and__, [F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`")) for c in own])


def predicate(columns: Sequence[str], keys: KeySet) -> Column | None:
    """The condition of ``keys`` on the ordered ``columns``; None where every row is in it.  For short key lists; ``restrict`` and ``mark`` take any."""
    return None if keys.everything else _tests(columns, keys, keys.keys)


def restrict(df: DataFrame, columns: Sequence[str], keys: KeySet) -> DataFrame:
    """The rows of ``df`` in ``keys``: a predicate, or joins for long key lists."""
    if keys.everything:
        return df
    short, long = _lists(columns, keys)
    if long and not short and not keys.prefixes and not keys.ranges and len(long) == 1:
        (own,) = long.values()
        firsts = list(dict.fromkeys(k[0] for k in own))
        if None not in firsts and len(firsts) <= IN_LIST:
            df = df.where(F.col(f"`{columns[0]}`").isin(*firsts))  # reaches the scan
        wanted, same = _listed(df, columns, own)
        return df.alias("o").join(wanted.alias("n"), same, "left_semi")
    if not long:
        return df.where(_tests(columns, keys, short))  # as it is, so that it reaches the scan
    marked, test, marks = mark(df, columns, keys)
    return marked.where(test).drop(*marks)


def mark(df: DataFrame, columns: Sequence[str], keys: KeySet) -> tuple[DataFrame, Column, list[str]]:
    """``df`` with columns that mark long key lists, the condition of being in ``keys`` (never NULL), and those columns' names."""
    if keys.everything:
        return df, F.lit(True), []
    short, long = _lists(columns, keys)
    test, marks = F.coalesce(_tests(columns, keys, short), F.lit(False)) if short or keys.prefixes or keys.ranges else F.lit(False), []
    if long:
        names = df.columns
    for n, own in long.items():
        wanted, same = _listed(df, columns, own)
        name = f"q_in_{n}"
        df = df.alias("o").join(wanted.withColumn(name, F.lit(True)).alias("n"), same, "left").select(*[F.col(f"o.`{c}`") for c in [*names, *marks]], F.col(f"n.{name}"))
        marks.append(name)
        test = test | F.coalesce(F.col(name), F.lit(False))
    return df, test, marks
