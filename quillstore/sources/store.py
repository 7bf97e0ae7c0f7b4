"""The table store: namespaces of tables with ordered primary keys, families and indexes.

A table is a folder of layers and of numbered metadata files.  The base layers hold rows
in key order; a write adds a layer of the rows it puts (whole rows, as they are after the
write) or of the keys it takes away, so it costs what it changes.  Reads merge the layers:
of each key the last layer counts.  When there are many layers, or they outgrow a share of
the base, they are merged into a new base.  Each index has a copy of its columns and the
primary key in index order beside the base.

A version is published by renaming its metadata file to the next number, which fails if
another writer has taken it: readers see whole versions, and of two writers from one
version the second gets a ``Conflict``.  Everything goes through Spark's own file systems.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A cell of a flexible family: one field is set, or none for NULL.
CELL = T.StructType([T.StructField("i", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("b", T.BinaryType())])
FAMILY = T.MapType(T.StringType(), CELL)
#: Versions kept, with their layers, for readers that still hold an old one.
KEEP_VERSIONS = 3
#: Layers over the base, and the share of its bytes they may have, before they are merged into a new one.
MOST_LAYERS, MOST_SHARE = 8, 0.25
#: Kinds of layers: rows of the base, rows put over it, keys gone.
BASE, PUT, GONE = "base", "put", "gone"
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*")
SQL_TYPES = {
    "bool": "boolean", "boolean": "boolean", "tinyint": "tinyint", "smallint": "bigint", "mediumint": "bigint", "int": "bigint", "integer": "bigint", "bigint": "bigint",
    "float": "float", "double": "double", "real": "double", "decimal": "decimal", "numeric": "decimal", "char": "string", "varchar": "string", "text": "string", "mediumtext": "string",
    "longtext": "string", "enum": "string", "json": "string", "set": "array<string>", "binary": "binary", "varbinary": "binary", "blob": "binary", "longblob": "binary", "bit": "binary",
    "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp", "time": "string", "year": "smallint",
}


class StoreError(ValueError):
    pass


class Conflict(StoreError):
    """Another writer published a version since this one was read."""


@dataclass
class Column:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None  # Spark SQL, evaluated once for each statement
    family: str = "default"


@dataclass
class Index:
    name: str
    columns: list[str]
    unique: bool = False
    folders: list[str] = field(default_factory=list)  # its entries, one folder for each base layer


@dataclass
class TableMeta:
    database: str
    name: str
    columns: list[Column]
    primary_key: list[str]
    flexible: list[str] = field(default_factory=list)  # names of flexible families
    indexes: list[Index] = field(default_factory=list)
    attributes: dict[str, str] = field(default_factory=dict)
    version: int = 0
    layers: list[list[str]] = field(default_factory=list)  # [kind, folder], oldest first

    def copy(self) -> TableMeta:
        return TableMeta.load(json.dumps(asdict(self)))

    def folders(self) -> set[str]:
        return {folder for _, folder in self.layers} | {folder for i in self.indexes for folder in i.folders}

    def schema(self) -> T.StructType:
        fixed = [T.StructField(c.name, T._parse_datatype_string(c.type), True, {"family": c.family}) for c in self.columns]
        return T.StructType(fixed + [T.StructField(f, FAMILY, True, {"family": f, "flexible": True}) for f in self.flexible])

    def column(self, name: str) -> Column:
        """By name, in any case, with or without ``family:`` before it."""
        bare = name.split(":")[-1].lower()
        for column in self.columns:
            if column.name.lower() == bare and (":" not in name or column.family == name.split(":")[0]):
                return column
        raise StoreError(f"unknown column {name} in {self.name}")

    def index(self, name: str) -> Index:
        for index in self.indexes:
            if index.name.lower() == name.lower():
                return index
        raise StoreError(f"unknown index {name} of {self.name}")

    @classmethod
    def load(cls, text: str) -> TableMeta:
        raw = json.loads(text)
        return cls(**raw | {"columns": [Column(**c) for c in raw["columns"]], "indexes": [Index(**i) for i in raw["indexes"]]})


class Store:
    """Databases and tables under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._owner = uuid.uuid4().hex
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- files -------------------------------------------------------------------------

    def _at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _children(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self._exists(path) else []

    def _read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _publish_text(self, path: str, text: str) -> None:
        """Write ``path`` whole; fails if it is there."""
        draft = self._path(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(draft, self._path(path), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"{path} was published by another writer") from None
            raise

    def _bytes(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    # -- namespaces --------------------------------------------------------------------

    @staticmethod
    def _check(name: str) -> str:
        if not _NAME.fullmatch(name):
            raise StoreError(f"not a name: {name!r}")
        return name.lower()

    def create_database(self, name: str, if_not_exists: bool = False) -> None:
        path = self._at(self._check(name))
        if self._exists(path):
            if if_not_exists:
                return
            raise StoreError(f"database {name} exists")
        self._fs.mkdirs(self._path(path))

    def drop_database(self, name: str) -> None:
        self._fs.delete(self._path(self._at(self._check(name))), True)

    def databases(self) -> list[str]:
        return self._children(self.root)

    def tables(self, database: str) -> list[str]:
        if not self._exists(self._at(self._check(database))):
            raise StoreError(f"unknown database {database}")
        return [t for t in self._children(self._at(database.lower())) if self._versions(database.lower(), t)]

    # -- tables ------------------------------------------------------------------------

    def create_table(self, meta: TableMeta, if_not_exists: bool = False) -> None:
        meta.database, meta.name = self._check(meta.database), self._check(meta.name)
        if not self._exists(self._at(meta.database)):
            raise StoreError(f"unknown database {meta.database}")
        if self._versions(meta.database, meta.name):
            if if_not_exists:
                return
            raise StoreError(f"table {meta.name} exists")
        for name in meta.primary_key:
            meta.column(name).nullable = False
        self.publish(meta, self.spark.createDataFrame([], meta.schema()))

    def drop_table(self, database: str, name: str, if_exists: bool = False) -> None:
        path = self._at(self._check(database), self._check(name))
        if not self._exists(path):
            if if_exists:
                return
            raise StoreError(f"unknown table {name}")
        self._fs.delete(self._path(path), True)

    def _versions(self, database: str, name: str) -> list[int]:
        return [int(f[:-5]) for f in self._children(self._at(database, name, "_meta")) if f.endswith(".json") and f[:-5].isdigit()]

    def _meta_path(self, database: str, name: str, version: int) -> str:
        return self._at(database, name, "_meta", f"{version:010d}.json")

    def meta(self, database: str, name: str) -> TableMeta:
        """The newest version."""
        versions = self._versions(self._check(database), self._check(name))
        if not versions:
            raise StoreError(f"unknown table {database}.{name}")
        return TableMeta.load(self._read_text(self._meta_path(database.lower(), name.lower(), max(versions))))

    # -- layers ------------------------------------------------------------------------

    def _layer(self, meta: TableMeta, folder: str) -> str:
        return self._at(meta.database, meta.name, folder)

    def _read(self, meta: TableMeta, kind: str, schema: T.StructType | None = None) -> DataFrame:
        paths = [self._layer(meta, f) for k, f in meta.layers if k == kind]
        schema = schema or meta.schema()
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _over(self, meta: TableMeta) -> DataFrame | None:
        """The last word of the layers over the base on each key (q_gone: it is gone), or None if there are none."""
        found = None
        names = [f.name for f in meta.schema()]
        for at, (kind, folder) in enumerate(meta.layers):
            if kind != BASE:
                rows = self.spark.read.schema(meta.schema()).parquet(self._layer(meta, folder))
                rows = rows.select(*[F.col(f"`{n}`") for n in names], F.lit(kind == GONE).alias("q_gone"), F.lit(at).alias("q_layer"))
                found = rows if found is None else found.union(rows)
        if found is None:
            return None
        newest = Window.partitionBy(*[F.col(f"`{k}`") for k in meta.primary_key]).orderBy(F.desc("q_layer"))
        return found.withColumn("q_n", F.row_number().over(newest)).where("q_n = 1").drop("q_n", "q_layer")

    def _merged(self, meta: TableMeta, base: DataFrame) -> DataFrame:
        """``base`` (its columns include the key) with what lies over it."""
        over = self._over(meta)
        if over is None:
            return base
        same = F.lit(True)
        for k in meta.primary_key:
            same = same & F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`"))
        kept = base.alias("o").join(over.select(*[F.col(f"`{k}`") for k in meta.primary_key]).alias("n"), same, "left_anti")
        return kept.union(over.where("NOT q_gone").select(*[F.col(f"`{c}`") for c in base.columns]))

    def data(self, meta: TableMeta) -> DataFrame:
        """The rows of this version; columns added since a layer was written are NULL there."""
        return self._merged(meta, self._read(meta, BASE))

    def entries(self, meta: TableMeta, index: Index) -> DataFrame:
        """The index's columns and the primary key of every row, read from the index and the layers over the base."""
        names = list(dict.fromkeys([*index.columns, *meta.primary_key]))
        fields = {f.name: f for f in meta.schema()}
        schema = T.StructType([fields[n] for n in names])
        paths = [self._layer(meta, f) for f in index.folders]
        return self._merged(meta, self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema))

    def _write_layer(self, meta: TableMeta, df: DataFrame, order: list[str], ranged: bool = True) -> str:
        folder = f"l-{uuid.uuid4().hex}"
        if order:
            keys = [F.col(f"`{k}`") for k in order]
            df = (df.repartitionByRange(*keys) if ranged else df.repartition(*keys)).sortWithinPartitions(*keys)
        df.write.parquet(self._layer(meta, folder))
        return folder

    def _write_index(self, meta: TableMeta, index: Index, rows: DataFrame) -> str:
        names = list(dict.fromkeys([*index.columns, *meta.primary_key]))
        return self._write_layer(meta, rows.select(*[F.col(f"`{n}`") for n in names]), names)

    @staticmethod
    def _whole(meta: TableMeta, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in meta.schema()])

    def rewrite(self, meta: TableMeta, df: DataFrame) -> None:
        """``df`` as the new base, in key order so that scans skip row groups, with its index entries; not yet published."""
        folder = self._write_layer(meta, self._whole(meta, df), meta.primary_key)
        meta.layers = [[BASE, folder]]
        for index in meta.indexes:
            index.folders = [self._write_index(meta, index, self._read(meta, BASE))]

    def stage(self, meta: TableMeta, df: DataFrame) -> DataFrame:
        """``df`` written beside the table's layers and read back, so that its plan runs once; gone with the next write."""
        for old in self._children(self._layer(meta, "staged")):
            if old.startswith(f"{self._owner}-"):
                self._fs.delete(self._path(self._layer(meta, f"staged/{old}")), True)
        path = self._layer(meta, f"staged/{self._owner}-{uuid.uuid4().hex}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, meta: TableMeta, rows: DataFrame) -> None:
        """More base rows, for a table without a primary key."""
        folder = self._write_layer(meta, self._whole(meta, rows), [])
        meta.layers.append([BASE, folder])
        own = self.spark.read.schema(meta.schema()).parquet(self._layer(meta, folder))
        for index in meta.indexes:
            index.folders.append(self._write_index(meta, index, own))

    def write(self, meta: TableMeta, puts: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Put whole rows over those of their keys, or take keys away; not yet published.

        Rows put are held against the unique indexes; the layer is written first, so its plan runs once.
        """
        if puts is not None:
            folder = self._write_layer(meta, self._whole(meta, puts), meta.primary_key, ranged=False)
            meta.layers.append([PUT, folder])
            rows = self.spark.read.schema(meta.schema()).parquet(self._layer(meta, folder))
            try:
                if not rows.where(" OR ".join(f"`{k}` IS NULL" for k in meta.primary_key)).isEmpty():
                    raise StoreError(f"a key of {meta.name} cannot be NULL")
                for index in meta.indexes:
                    if index.unique:
                        self._check_unique(meta, index, rows)
            except StoreError:
                meta.layers.pop()
                self._fs.delete(self._path(self._layer(meta, folder)), True)
                raise
        if gone is not None:
            keys = {f.name: f for f in meta.schema() if f.name in meta.primary_key}
            meta.layers.append([GONE, self._write_layer(meta, gone.select(*[F.col(f"`{k}`").cast(keys[k].dataType).alias(k) for k in meta.primary_key]), meta.primary_key, ranged=False)])

    def _check_unique(self, meta: TableMeta, index: Index, rows: DataFrame | None = None) -> None:
        """Fails if two rows share the index's columns, none of them NULL; ``rows`` are those that changed, if not all did."""
        columns = [F.col(f"`{c}`") for c in index.columns]
        entries = self.entries(meta, index) if rows is not None else self.data(meta)
        entries = entries.where(" AND ".join(f"`{c}` IS NOT NULL" for c in index.columns))
        if rows is not None:
            entries = entries.join(rows.select(*columns).distinct(), index.columns, "left_semi")
        if not entries.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise StoreError(f"duplicate entry for index {index.name}")

    def commit(self, meta: TableMeta) -> None:
        """Publish ``meta`` as the version after the one it was read as."""
        over = [f for kind, f in meta.layers if kind != BASE]
        if over:
            base = sum(self._bytes(self._layer(meta, f)) for kind, f in meta.layers if kind == BASE)
            if len(over) > MOST_LAYERS or sum(self._bytes(self._layer(meta, f)) for f in over) > MOST_SHARE * base:
                self.rewrite(meta, self.data(meta))
        meta.version += 1
        try:
            self._publish_text(self._meta_path(meta.database, meta.name, meta.version), json.dumps(asdict(meta)))
        except Conflict:
            meta.version -= 1
            raise
        self._expire(meta)

    def _expire(self, meta: TableMeta) -> None:
        """Remove versions older than those kept, and the layers that only they have."""
        versions = sorted(self._versions(meta.database, meta.name))
        if len(versions) <= KEEP_VERSIONS:
            return
        load = lambda v: TableMeta.load(self._read_text(self._meta_path(meta.database, meta.name, v)))
        kept = set().union(*(load(v).folders() for v in versions[-KEEP_VERSIONS:]))
        for version in versions[:-KEEP_VERSIONS]:
            for folder in load(version).folders() - kept:
                self._fs.delete(self._path(self._layer(meta, folder)), True)
            self._fs.delete(self._path(self._meta_path(meta.database, meta.name, version)), False)

    def publish(self, meta: TableMeta, df: DataFrame) -> None:
        """``df`` as the whole of the next version."""
        self.rewrite(meta, df)
        for index in meta.indexes:
            if index.unique:
                self._check_unique(meta, index)
        self.commit(meta)

    def add_column(self, database: str, name: str, column: Column) -> None:
        meta = self.meta(database, name)
        if any(c.name.lower() == column.name.lower() for c in meta.columns):
            raise StoreError(f"column {column.name} exists")
        old = self.data(meta)
        meta.columns.append(column)
        again = column.name.lower() in meta.attributes.get("dropped", "").split()  # files may hold an old column of that name
        if column.default is not None or again:
            self.publish(meta, old.withColumn(column.name, F.expr(column.default or "NULL")))
        else:
            self.commit(meta)  # schema evolution: older files give NULL

    def drop_column(self, database: str, name: str, column: str) -> None:
        """The column goes from the schema; older files still hold it, and nothing reads it."""
        meta = self.meta(database, name)
        own = meta.column(column)
        if own.name in meta.primary_key or any(own.name in i.columns for i in meta.indexes):
            raise StoreError(f"{column} is part of a key of {name}")
        meta.columns.remove(own)
        meta.attributes["dropped"] = " ".join([meta.attributes.get("dropped", ""), own.name.lower()]).strip()
        self.commit(meta)

    def create_index(self, database: str, name: str, index: Index) -> None:
        """An index with its entries; a unique one is checked against the rows there are."""
        meta = self.meta(database, name)
        if any(i.name.lower() == index.name.lower() for i in meta.indexes):
            raise StoreError(f"index {index.name} exists")
        index.columns = [meta.column(c).name for c in index.columns]
        if index.unique:
            self._check_unique(meta, index)
        index.folders = [self._write_index(meta, index, self._read(meta, BASE))]
        meta.indexes.append(index)
        self.commit(meta)

    def drop_index(self, database: str, name: str, index: str) -> None:
        meta = self.meta(database, name)
        meta.indexes.remove(meta.index(index))
        self.commit(meta)

    def split_ranges(self, meta: TableMeta, regions: int) -> DataFrame:
        """The table's rows dealt into ``regions`` ranges of the primary key, of about equal size."""
        return self.data(meta).repartitionByRange(regions, *meta.primary_key).withColumn("region", F.spark_partition_id())
