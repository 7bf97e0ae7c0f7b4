"""Row and cell access by (row, ``family:qualifier``): get, rows, mutations and scanners over flexible families.

Tables have one key column, ``row`` (bytes), and values are bytes; there is one version of a
cell, so requests for several versions or a timestamp get the latest.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .client import Client, Mutation
from .operators.families import pick
from .operators.keys import KeyRange, KeySet
from .sources.store import Column, StoreError, TableMeta


@dataclass(frozen=True)
class CellMutation:
    """A put, or the delete of a cell (``family:qualifier``) or of a family (``family:``)."""

    column: str
    value: bytes | None = None
    is_delete: bool = False


@dataclass(frozen=True)
class RowResult:
    row: bytes
    columns: dict[str, bytes]


def split_column(column: str) -> tuple[str, str]:
    family, _, qualifier = column.partition(":")
    return family, qualifier


class RowStore:
    def __init__(self, client: Client, database: str):
        self.client, self.database = client, database
        self._scanners: dict[int, Iterator[RowResult]] = {}
        self._ids = itertools.count(1)

    # -- tables ------------------------------------------------------------------------

    def get_table_names(self) -> list[str]:
        return self.client.list_tables(self.database)

    def create_table(self, name: str, families: Sequence[str]) -> None:
        names = [f.rstrip(":") for f in families]
        self.client.create_table(TableMeta(self.database, name, [Column("row", "binary")], ["row"], flexible=names, attributes={"VERSION": "1"}))

    def get_column_descriptors(self, name: str) -> dict[str, dict]:
        meta = self.client.store.meta(self.database, name)
        return {f"{f}:": {"name": f"{f}:", "max_versions": int(meta.attributes.get("VERSION", 1))} for f in meta.flexible}

    def delete_table(self, name: str) -> None:
        self.client.drop_table(self.database, name)

    def enable_table(self, name: str, enabled: bool = True) -> None:
        meta = self.client.store.meta(self.database, name)
        meta.attributes["enabled"] = str(int(enabled))
        self.client.store.commit(meta)

    def disable_table(self, name: str) -> None:
        """Reads and writes raise until the table is enabled again."""
        self.enable_table(name, False)

    def is_table_enabled(self, name: str) -> bool:
        return self.client.store.meta(self.database, name).attributes.get("enabled", "1") == "1"

    def _enabled(self, name: str) -> None:
        if not self.is_table_enabled(name):
            raise StoreError(f"table {name} is disabled")

    def compact(self, name: str) -> None:
        """Merge the layers into a new base."""
        store = self.client.store
        meta = store.meta(self.database, name)
        store.rewrite(meta, store.data(meta))
        store.commit(meta)

    major_compact = compact

    def get_table_regions(self, name: str) -> list[bytes]:
        """The first key of each file of the base, in order: the bounds that scans are cut by."""
        store = self.client.store
        meta = store.meta(self.database, name)
        files = store.data(meta).groupBy(F.spark_partition_id()).agg(F.min("row").alias("row")).select("row")
        return sorted(bytes(r.row) for r in files.collect())  # one for each partition

    # -- reads -------------------------------------------------------------------------

    def _families(self, table: str, columns: Sequence[str] | None) -> tuple[list[str], dict[str, list[str]]]:
        """Families to read, and the qualifiers wanted of each (none: all)."""
        if not columns:
            return self.client.store.meta(self.database, table).flexible, {}
        wanted: dict[str, list[str]] = {}
        whole = set()
        for column in columns:
            family, qualifier = split_column(column)
            wanted.setdefault(family, [])
            whole |= set() if qualifier else {family}
            wanted[family] += [qualifier] * bool(qualifier)
        return list(wanted), {f: q for f, q in wanted.items() if f not in whole}

    @staticmethod
    def _result(row: Row, families: Sequence[str], wanted: dict[str, list[str]]) -> RowResult:
        cells = {}
        for family in families:
            for qualifier, cell in sorted((row[family] or {}).items()):
                if family not in wanted or qualifier in wanted[family]:
                    value = cell.b if cell.b is not None else None if cell.i is cell.d is None else str(cell.i if cell.i is not None else cell.d).encode()
                    cells[f"{family}:{qualifier}"] = bytes(value) if value is not None else b""
        return RowResult(bytes(row["row"]), cells)

    def get(self, table: str, row: bytes, column: str) -> bytes | None:
        found = self.get_row(table, row, [column])
        return found.columns.get(column) if found else None

    def get_row(self, table: str, row: bytes, columns: Sequence[str] | None = None) -> RowResult | None:
        return next(iter(self.get_rows(table, [row], columns)), None)

    def get_rows(self, table: str, rows: Sequence[bytes], columns: Sequence[str] | None = None) -> list[RowResult]:
        """In the order asked for; rows without a cell are left out."""
        self._enabled(table)
        families, wanted = self._families(table, columns)
        found = self.client.sparse_read(self.database, table, families, [((bytearray(r),), []) for r in rows])
        by_row = {bytes(r["row"]): self._result(r, families, wanted) for r in found.collect()}  # as many as the request
        return [by_row[r] for r in rows if r in by_row and by_row[r].columns]

    # -- writes ------------------------------------------------------------------------

    def mutate_rows(self, table: str, batches: Sequence[tuple[bytes, Sequence[CellMutation]]]) -> None:
        """All of one call in one published version, in order; neighbouring puts, or deletes of one column, are one write."""
        self._enabled(table)
        out: list[Mutation] = []
        for row, mutations in batches:
            for m in mutations:
                family, qualifier = split_column(m.column)
                key = (bytearray(row),)
                if not m.is_delete:
                    puts = out.pop().cells if out and out[-1].kind == "insert_or_update" else ()
                    out.append(Mutation("insert_or_update", cells=(*puts, (key, family, qualifier, m.value))))
                    continue
                taken = (qualifier,) if qualifier else ()
                same = out and (out[-1].kind, out[-1].family, out[-1].columns) == ("delete", family, taken)
                keys = out.pop().keys.keys if same else ()
                out.append(Mutation("delete", taken, family=family, keys=KeySet(keys=(*keys, key))))
        if out:
            self.client.mutate(self.database, table, out)

    def mutate_row(self, table: str, row: bytes, mutations: Sequence[CellMutation]) -> None:
        self.mutate_rows(table, [(row, mutations)])

    def delete_all(self, table: str, row: bytes, column: str) -> None:
        self.mutate_row(table, row, [CellMutation(column, is_delete=True)])

    def delete_all_row(self, table: str, row: bytes) -> None:
        self.client.mutate(self.database, table, [Mutation("delete", keys=KeySet.of((bytearray(row),)))])

    def increment_rows(self, table: str, changes: Sequence[tuple[bytes, str, int]]) -> list[int]:
        """Add to cells that hold 8-byte big-endian numbers (none: 0); the values after it, in order.  One published version, or a Conflict."""
        self._enabled(table)
        tx = self.client.begin()
        now: dict[tuple[bytes, str], int] = {}
        out = []
        for row, column, amount in changes:
            if (row, column) not in now:
                family, qualifier = split_column(column)
                found = self.client.sparse_read(self.database, table, family, [((bytearray(row),), [qualifier])], tx=tx).collect()
                now[row, column] = int.from_bytes(found[0][family][qualifier].b or b"", "big", signed=True) if found else 0
            now[row, column] += amount
            out.append(now[row, column])
        cells = tuple(((bytearray(row),), *split_column(column), value.to_bytes(8, "big", signed=True)) for (row, column), value in now.items())
        if cells:
            self.client.mutate(self.database, table, [Mutation("insert_or_update", cells=cells)], tx)
        tx.commit()
        return out

    def atomic_increment(self, table: str, row: bytes, column: str, amount: int) -> int:
        return self.increment_rows(table, [(row, column, amount)])[0]

    def check_and_put(self, table: str, row: bytes, column: str, expected: bytes | None, mutation: CellMutation) -> bool:
        """The put, if the cell holds ``expected`` (None: is not there); no other writer comes in between."""
        self._enabled(table)
        tx = self.client.begin()
        family, qualifier = split_column(column)
        found = self.client.sparse_read(self.database, table, family, [((bytearray(row),), [qualifier])], tx=tx).collect()
        held = bytes(found[0][family][qualifier].b or b"") if found else None
        if held != expected:
            return False
        self.client.mutate(self.database, table, [Mutation("insert_or_update", cells=(((bytearray(row),), *split_column(mutation.column), mutation.value),))], tx)
        tx.commit()
        return True

    # -- scanners ----------------------------------------------------------------------

    def scan(self, table: str, start: bytes = b"", stop: bytes | None = None, columns: Sequence[str] | None = None, reverse: bool = False) -> DataFrame:
        keys = KeySet(ranges=(KeyRange((bytearray(start),) if start else None, (bytearray(stop),) if stop else None),))
        self._enabled(table)
        families, wanted = self._families(table, columns)
        found = self.client.sparse_scan(self.database, table, families, keys, reverse=reverse)
        if not wanted:
            return found
        cells = [pick(F.col(f), wanted.get(f)).alias(f) for f in families]
        return found.select("row", *cells).where(" OR ".join(f"size(coalesce(`{f}`, map())) > 0" for f in families))

    def scanner_open(self, table: str, start: bytes = b"", columns: Sequence[str] | None = None, stop: bytes | None = None, reverse: bool = False) -> int:
        families, wanted = self._families(table, columns)
        results = (self._result(r, families, wanted) for r in self.scan(table, start, stop, columns, reverse).toLocalIterator())
        scanner = next(self._ids)
        self._scanners[scanner] = (r for r in results if r.columns)
        return scanner

    def scanner_open_with_prefix(self, table: str, prefix: bytes, columns: Sequence[str] | None = None) -> int:
        """All rows whose key begins with ``prefix``: up to the next key of that length."""
        bare = prefix.rstrip(b"\xff")
        return self.scanner_open(table, prefix, columns, bare[:-1] + bytes([bare[-1] + 1]) if bare else None)

    def scanner_get_list(self, scanner: int, n: int) -> list[RowResult]:
        if scanner not in self._scanners:
            raise StoreError(f"no scanner {scanner}")
        return list(itertools.islice(self._scanners[scanner], n))

    def scanner_get(self, scanner: int) -> list[RowResult]:
        return self.scanner_get_list(scanner, 1)

    def scanner_close(self, scanner: int) -> None:
        self._scanners.pop(scanner, None)
