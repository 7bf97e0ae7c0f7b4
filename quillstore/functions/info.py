"""Session values, and the sequences and names that have no analytic meaning."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from .registry import define, literal, unsupported

VERSION = "5.7.25-quillstore"
#: System variables of a new scope; SET GLOBAL changes these.
SYSTEM: dict[str, object] = {
    "version": VERSION, "autocommit": 1, "sql_mode": "STRICT_TRANS_TABLES", "time_zone": "UTC", "max_allowed_packet": 67108864, "group_concat_max_len": 1024,
    "tx_isolation": "REPEATABLE-READ", "character_set_client": "utf8mb4", "collation_connection": "utf8mb4_bin", "block_encryption_mode": "aes-128-ecb",
}
_CONNECTIONS = itertools.count(1)


@dataclass
class Scope:
    """What one session sees: the values of session functions, user and system variables, and sequences."""

    values: dict[str, object] = field(default_factory=dict)
    variables: dict[str, str] = field(default_factory=dict)  # Spark SQL of each value
    system: dict[str, object] = field(default_factory=lambda: dict(SYSTEM))
    sequences: dict[str, tuple[int, int]] = field(default_factory=dict)  # name -> (last value, step)

    def __post_init__(self) -> None:
        self.values = {"connection_id": next(_CONNECTIONS), "current_role": "NONE", "found_rows": 0, "last_insert_id": 0, "row_count": -1, "version": VERSION, "database": None} | self.values


_SCOPE: ContextVar[Scope] = ContextVar("scope", default=Scope())


def scope() -> Scope:
    """The scope in use: the running session's, or one for texts that are rewritten outside any."""
    return _SCOPE.get()


@contextmanager
def using(own: Scope) -> Iterator[Scope]:
    token = _SCOPE.set(own)
    try:
        yield own
    finally:
        _SCOPE.reset(token)


def _last_insert_id(value: str | None = None) -> str:
    return value if value is not None else literal(scope().values["last_insert_id"])


def _database() -> str:
    name = scope().values["database"]
    return literal(name) if name else "current_database()"


for _name in ("connection_id", "current_role", "found_rows", "row_count", "version"):
    define(_name, 0, 0, lambda n=_name: literal(scope().values[n]))
define("last_insert_id", 0, 1, _last_insert_id)
define("current_user", 0, 0, "current_user()")
define("user session_user", 0, 0, "user()")
define("system_user", 0, 0, "current_user()")
define("database schema", 0, 0, _database)
define("coercibility", 1, 1, lambda a: "4" if a.strip().startswith("'") else "6" if a.strip().upper() == "NULL" else "2")
define("collation", 1, 1, "CASE WHEN collation({0}) LIKE '%UTF8_BINARY' THEN 'utf8mb4_bin' WHEN collation({0}) LIKE '%UTF8_LCASE' THEN 'utf8mb4_general_ci' ELSE 'utf8mb4_unicode_ci' END")


def _ladder(value: str, steps: list[tuple[float, str]]) -> str:
    """The value in the largest unit not above it: whole in the smallest, two decimals else, an exponent from 100000 on."""
    size, arms = f"abs(CAST({value} AS DOUBLE))", []
    for factor, unit in reversed(steps[1:]):
        scaled = f"(CAST({value} AS DOUBLE) / {factor}D)"
        arms.append(f"WHEN {size} >= {factor}D THEN concat(IF(abs({scaled}) >= 100000, lower(regexp_replace(printf('%.2e', {scaled}), 'E', 'e')), printf('%.2f', {scaled})), ' {unit}')")
    return f"CASE WHEN ({value}) IS NULL THEN NULL " + " ".join(arms) + f" ELSE concat(printf('%.0f', CAST({value} AS DOUBLE)), ' {steps[0][1]}') END"


_BYTES = [(1024.0**i, unit) for i, unit in enumerate(("bytes", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"))]
_TIMES = [(1.0, "ns"), (1e3, "us"), (1e6, "ms"), (1e9, "s"), (6e10, "min"), (3.6e12, "h"), (8.64e13, "d")]
define("format_bytes", 1, 1, lambda a: _ladder(a, _BYTES))
define("format_nano_time", 1, 1, lambda a: _ladder(a, _TIMES))


def _name(arg: str) -> str:
    return arg.strip().strip("'`\"").lower()


def _set_variable(name: str, value: str) -> str:
    scope().variables[_name(name)] = value
    return value


define("setvar", 2, 2, _set_variable)
define("getvar", 1, 1, lambda name: str(scope().variables.get(_name(name), "NULL")))
define("getparam", 1, 1, lambda n: f":p{n}")


def create_sequence(name: str, start: int = 1, step: int = 1) -> None:
    scope().sequences[name.lower()] = (start - step, step)


def _next(name: str) -> str:
    own = scope().sequences
    last, step = own[_name(name)]
    own[_name(name)] = (last + step, step)
    return str(last + step)


def _set_sequence(name: str, value: str) -> str:
    own = scope().sequences
    own[_name(name)] = (int(value.strip("() ")), own[_name(name)][1])
    return value


define("nextval", 1, 1, _next)
define("lastval", 1, 1, lambda name: str(scope().sequences[_name(name)][0]))
define("setval", 2, 2, _set_sequence)

_GONE = "the store does not have it either"
unsupported("load_file charset", 1, 1, _GONE)
unsupported("default is_free_lock is_used_lock validate_password_strength json_pretty old_password", 1, 1, _GONE)
unsupported("master_pos_wait", 2, 4, _GONE)
unsupported("release_all_locks uuid_short", 0, 0, _GONE)
unsupported("des_decrypt des_encrypt encrypt", 1, 2, _GONE)
unsupported("json_merge_patch", 2, None, _GONE)
unsupported("benchmark", 2, 2, "it times a server")
unsupported("sleep", 1, 1, "it blocks a server")
unsupported("get_lock", 2, 2, "there are no locks")
unsupported("release_lock", 1, 1, "there are no locks")
unsupported("tidb_decode_key tidb_decode_plan", 1, 1, "it reads cluster internals")
unsupported("tidb_version tidb_is_ddl_owner", 0, 0, "it reads cluster internals")
