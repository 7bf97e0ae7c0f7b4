"""The data API: sessions, reads by key set, sparse reads and scans, mutations, transactions.

Requests become DataFrame plans over the store; nothing runs until rows are asked for,
and the streaming forms fetch them in bounded batches.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators import families as fam
from .operators import mutate
from .operators.keys import IN_LIST, KeySet, restrict
from .operators.scan import covers, scan
from .sources.store import Column, Conflict, Index, Store, StoreError, TableMeta
from .streaming.reads import stream_cells, stream_rows


@dataclass(frozen=True)
class Mutation:
    """kind: insert_or_update, insert, update, replace or delete.

    Writes give ``columns`` and ``rows`` (the key columns are among them).  In a flexible
    ``family``, columns are qualifiers and each row is (key, values); ``cells`` of (key,
    family, qualifier, value) write any cells of flexible families at once.  A delete gives
    ``keys`` and takes whole rows, a family, or the qualifiers in ``columns``.
    """

    kind: str
    columns: tuple[str, ...] = ()
    rows: tuple[tuple, ...] = ()
    family: str = ""
    keys: KeySet = field(default_factory=KeySet)
    cells: tuple[tuple, ...] = ()


_WRITES = {"insert_or_update": mutate.upsert, "insert": mutate.insert_only, "update": mutate.update_only, "replace": mutate.replace_rows}


#: How often a mutation is made again when another writer was faster.
RETRIES = 5


class Transaction:
    """Reads see each table as it was when first read plus the transaction's own writes.

    Writes are layers that nothing refers to yet; commit publishes each changed table
    once, and raises ``Conflict`` if another writer has published it in between.
    """

    def __init__(self, client: Client):
        self.client, self.tables = client, {}

    def meta(self, database: str, name: str) -> TableMeta:
        """A copy to write on; give it to ``keep`` once the write is whole."""
        at = (database.lower(), name.lower())
        if at not in self.tables:
            self.tables[at] = self.client.store.meta(*at), False
        return self.tables[at][0].copy()

    def keep(self, meta: TableMeta) -> None:
        self.tables[meta.database, meta.name] = meta, True

    def commit(self) -> None:
        tables, self.tables = self.tables, {}
        for meta, changed in tables.values():
            if changed:
                self.client.store.commit(meta)

    def rollback(self) -> None:
        self.tables = {}


class Client:
    def __init__(self, spark: SparkSession, store: Store):
        self.spark, self.store = spark, store
        self._sessions: dict[str, dict] = {}
        self._ids = itertools.count(1)

    # -- sessions ----------------------------------------------------------------------

    def create_session(self, database: str) -> str:
        self.store.tables(database)
        name = f"{database}/sessions/{next(self._ids)}"
        self._sessions[name] = {"name": name, "database": database}
        return name

    def batch_create_sessions(self, database: str, n: int) -> list[str]:
        return [self.create_session(database) for _ in range(n)]

    def get_session(self, name: str) -> dict:
        return self._sessions[name]

    def list_sessions(self) -> list[str]:
        return list(self._sessions)

    def delete_session(self, name: str) -> None:
        self._sessions.pop(name, None)

    # -- definitions -------------------------------------------------------------------

    def create_database(self, name: str) -> None:
        self.store.create_database(name)

    def list_databases(self) -> list[str]:
        return self.store.databases()

    def create_table(self, meta: TableMeta) -> None:
        self.store.create_table(meta)

    def list_tables(self, database: str) -> list[str]:
        return self.store.tables(database)

    def drop_table(self, database: str, table: str) -> None:
        self.store.drop_table(database, table)

    def add_columns(self, database: str, table: str, *columns: Column) -> None:
        for column in columns:
            self.store.add_column(database, table, column)

    def create_index(self, database: str, table: str, index: Index) -> None:
        self.store.create_index(database, table, index)

    # -- reads -------------------------------------------------------------------------

    def _table(self, database: str, table: str, tx: Transaction | None) -> tuple[TableMeta, DataFrame]:
        meta = tx.meta(database, table) if tx is not None else self.store.meta(database, table)
        return meta, self.store.data(meta)

    def read(
        self, database: str, table: str, keys: KeySet, columns: Sequence[str] = (), index: str | None = None, limit: int | None = None, reverse: bool = False, tx: Transaction | None = None
    ) -> DataFrame:
        """Rows in ``keys`` of the primary key or an index, in its order; columns by name or family:name.

        By an index, its entries are read first; where they hold all that is asked for
        they are the result, else the rows are fetched by primary key (a second read).
        """
        meta, df = self._table(database, table, tx)
        wanted = [meta.column(c).name for c in columns] or [c.name for c in meta.columns]
        if not index:
            return scan(df, meta.primary_key, keys, wanted, limit=limit, reverse=reverse)
        if not meta.primary_key:
            raise StoreError(f"{meta.name} has no primary key to read rows by")
        own = meta.index(index)
        order = list(dict.fromkeys([*own.columns, *meta.primary_key]))
        entries = restrict(self.store.entries(meta, own), own.columns, keys)
        if covers(own.columns, meta.primary_key, wanted):
            return scan(entries, order, None, wanted, limit=limit, reverse=reverse)
        found = scan(entries, order, None, meta.primary_key, limit=limit, reverse=reverse, ordered=limit is not None)
        head = found.limit(IN_LIST + 1).collect()  # a list that the second read can carry to the scan
        if len(head) <= IN_LIST:
            rows = restrict(df, meta.primary_key, KeySet(keys=tuple(tuple(r) for r in head)))
        else:
            rows = df.join(found, meta.primary_key, "left_semi")
        return scan(rows, order, None, wanted, reverse=reverse)

    def read_cells(self, database: str, table: str, keys: KeySet, columns: Sequence[str] = (), limit: int | None = None, tx: Transaction | None = None) -> DataFrame:
        """(key, cells) of the rows in ``keys``: fixed columns, then flexible families."""
        meta, df = self._table(database, table, tx)
        fixed = [meta.column(c).name for c in columns] or [c.name for c in meta.columns if c.name not in meta.primary_key]
        rows = scan(restrict(df, meta.primary_key, keys), meta.primary_key, limit=limit)
        return fam.row_cells(rows, meta.primary_key, fixed, [] if columns else meta.flexible)

    def _families(self, meta: TableMeta, family: str | Sequence[str]) -> list[str]:
        """The named flexible families, or all of them for an empty name."""
        if not family:
            return meta.flexible
        named = [family] if isinstance(family, str) else list(family)
        for name in named:
            if name not in meta.flexible:
                raise StoreError(f"{name} is no flexible family of {meta.name}")
        return named

    def sparse_read(self, database: str, table: str, family: str | Sequence[str], rows: Sequence[tuple[tuple, Sequence[str]]], limit: int | None = None, tx: Transaction | None = None) -> DataFrame:
        meta, df = self._table(database, table, tx)
        return fam.sparse_read(df, meta.primary_key, rows, self._families(meta, family), limit)

    def sparse_scan(
        self, database: str, table: str, family: str | Sequence[str], keys: KeySet, qualifiers: Sequence[str] = (), limit: int | None = None, reverse: bool = False, tx: Transaction | None = None
    ) -> DataFrame:
        meta, df = self._table(database, table, tx)
        return fam.sparse_scan(df, meta.primary_key, keys, self._families(meta, family), qualifiers, limit, reverse)

    def streaming_read(self, *args, **kwargs) -> Iterator[Row]:
        return stream_cells(self.read_cells(*args, **kwargs))

    def streaming_sparse_read(self, *args, **kwargs) -> Iterator[Row]:
        return stream_rows(self.sparse_read(*args, **kwargs))

    def streaming_sparse_scan(self, *args, **kwargs) -> Iterator[Row]:
        return stream_rows(self.sparse_scan(*args, **kwargs))

    # -- writes ------------------------------------------------------------------------

    def begin(self) -> Transaction:
        return Transaction(self)

    def mutate(self, database: str, table: str, mutations: Sequence[Mutation], tx: Transaction | None = None) -> None:
        """All mutations in order, then one published version (or none before the transaction's commit)."""
        for left in reversed(range(RETRIES)):
            own = tx or self.begin()
            meta = own.meta(database, table)
            if not meta.primary_key:
                raise StoreError(f"{meta.name} has no primary key to write by")
            for m in mutations:
                self._apply(meta, m)
            own.keep(meta)
            if tx is not None:
                return
            try:
                return own.commit()
            except Conflict:
                if not left:
                    raise

    def _apply(self, meta: TableMeta, m: Mutation) -> None:
        """A layer of the rows that the mutation touches, as they are after it."""
        key, df = meta.primary_key, self.store.data(meta)
        if m.kind == "delete":
            rows = restrict(df, key, m.keys)
            if m.family and m.family in meta.flexible:
                self.store.write(meta, mutate.delete_cells(rows, key, KeySet.all(), m.family, m.columns))
            elif m.columns:
                self.store.write(meta, mutate.clear_columns(rows, key, KeySet.all(), [meta.column(c).name for c in m.columns]))
            else:
                self.store.write(meta, gone=rows.select(*[F.col(f"`{k}`") for k in key]))
            return
        types = {c.name: c.type for c in meta.columns}
        if m.cells or m.family in meta.flexible:
            cells = [(*k, f, q, _cell(v), n) for n, (k, f, q, v) in enumerate(_cells_of(m))]
            if any(f not in meta.flexible for _, f, _, _ in _cells_of(m)):
                raise StoreError(f"a family of the mutation is no flexible family of {meta.name}")
            schema = ", ".join(f"`{c}` {types[c]}" for c in key) + ", family string, qualifier string, cell struct<i:bigint,d:double,b:binary>, q_order bigint"
            rows = restrict(df, key, KeySet(keys=tuple(tuple(c[: len(key)]) for c in cells)))
            families = list(dict.fromkeys(f for _, f, _, _ in _cells_of(m)))
            self.store.write(meta, mutate.upsert_cells(rows, self.spark.createDataFrame(cells, schema), key, families, "q_order"))
            return
        if m.kind not in _WRITES:
            raise StoreError(f"unknown mutation {m.kind}")
        names = [meta.column(c).name for c in m.columns]
        schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", q_order bigint"
        changes = self.spark.createDataFrame([(*r, n) for n, r in enumerate(m.rows)], schema)
        at = [names.index(k) for k in key]
        rows = restrict(df, key, KeySet(keys=tuple(tuple(r[i] for i in at) for r in m.rows)))
        self.store.write(meta, _WRITES[m.kind](rows, changes, key, "q_order"))


def _cells_of(m: Mutation) -> list[tuple[tuple, str, str, object]]:
    """(key, family, qualifier, value) of each cell."""
    return [*m.cells, *((key, m.family, column, value) for key, values in m.rows if m.family for column, value in zip(m.columns, values))]


def _cell(value: object) -> tuple[int | None, float | None, bytes | None]:
    """A flexible cell holds an integer, a float, bytes or NULL, nothing else."""
    if value is None:
        return None, None, None
    if isinstance(value, bool) or not isinstance(value, (int, float, bytes, bytearray)):
        raise StoreError(f"a cell cannot hold {type(value).__name__}")
    if isinstance(value, int):
        return value, None, None
    return (None, value, None) if isinstance(value, float) else (None, None, bytes(value))
