"""SQL statements over a store: what the rewriter leaves to Spark SQL, plus DDL, DML, SHOW and SET."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import info, install
from ..operators import mutate
from ..operators.keys import KeySet, restrict
from ..sources.store import SQL_TYPES, Column, Conflict, Index, Store, StoreError, TableMeta
from .rewrite import Rewriter, SqlError, sql_string, string_value

OK = "affected long"
#: How often a statement is run again when another writer was faster.
RETRIES = 5


class Session:
    """One connection: a current database, its own variables, prepared statements, and an optional transaction."""

    def __init__(self, spark: SparkSession, store: Store, database: str | None = None):
        self.spark, self.store, self.database = install(spark), store, database
        self.scope = info.Scope(values={"database": database})
        self.pending: dict[tuple[str, str], tuple[TableMeta, bool]] | None = None
        self.prepared: dict[str, str] = {}
        self._statements: dict[str, Callable[[Rewriter], DataFrame]] = {
            "SELECT": self._query, "WITH": self._query, "(": self._query, "INSERT": self._insert, "REPLACE": self._insert, "UPDATE": self._update, "DELETE": self._delete, "CREATE": self._create, "DROP": self._drop,
            "ALTER": self._alter, "SPLIT": self._split, "SHOW": self._show, "DESC": self._describe, "DESCRIBE": self._describe, "EXPLAIN": self._describe, "SET": self._set, "USE": self._use, "BEGIN": self._begin,
            "START": self._begin, "COMMIT": self._commit, "ROLLBACK": self._rollback, "PREPARE": self._prepare, "EXECUTE": self._execute, "DEALLOCATE": self._deallocate, "TRUNCATE": self._truncate, "LOAD": self._load_data,
        }

    def sql(self, text: str, args: list | dict | None = None) -> DataFrame:
        """Run one statement; ``args`` fill ? or :name.  Outside a transaction a write that lost to another one is run again."""
        for left in reversed(range(RETRIES)):
            work = Rewriter(text)
            run = self._statements.get(work.word())
            if run is None:
                raise SqlError(f"unsupported statement: {text[:40]!r}")
            self._args = args
            with info.using(self.scope):
                try:
                    return run(work)
                except Conflict:
                    if not left or self.pending is not None or work.tokens[0][1].upper() == "COMMIT":
                        raise
        raise AssertionError("unreachable")

    @staticmethod
    def _end(work: Rewriter) -> None:
        """Nothing may follow a statement: a word that isn't understood must not change what it does."""
        while work.accept(";"):
            pass
        if work.peek()[0] != "end":
            raise SqlError(f"unexpected {work.peek()[1]!r}")

    # -- tables ------------------------------------------------------------------------

    def _where(self, name: str) -> tuple[str, str]:
        parts = [p.strip("`").lower() for p in name.split(".")]
        if len(parts) == 2:
            return parts[0], parts[1]
        if not self.database:
            raise SqlError("no database selected")
        return self.database, parts[0]

    def _load(self, name: str) -> tuple[TableMeta, DataFrame]:
        at = self._where(name)
        if self.pending is None:
            meta = self.store.meta(*at)
        else:
            if at not in self.pending:
                self.pending[at] = self.store.meta(*at), False
            meta = self.pending[at][0].copy()
        return meta, self.store.data(meta)

    def _save(self, meta: TableMeta) -> None:
        """Publish, or inside a transaction keep until COMMIT."""
        if self.pending is not None:
            self.pending[meta.database, meta.name] = meta, True
        else:
            self.store.commit(meta)

    def _done(self, affected: int = 0) -> DataFrame:
        self.scope.values["row_count"] = affected
        return self.spark.createDataFrame([(affected,)], OK)

    # -- queries -----------------------------------------------------------------------

    def _query(self, work: Rewriter) -> DataFrame:
        out = self._select(work)
        self._end(work)
        return out

    def _select(self, work: Rewriter) -> DataFrame:
        """Store tables become views; ``family.*`` reads the table with that family exploded."""
        families = {b[1].lower() for a, b, c in zip(work.tokens[1:], work.tokens, work.tokens[2:]) if a == ("sign", ".") and c == ("sign", "*")}
        named = {t[1].strip("`").lower() for t in work.tokens if t[0] in ("word", "quoted")}
        plain = work.table

        def table() -> str:
            text = plain()
            name, _, alias = text.partition(" AS ")
            if "." not in name and not self.database:
                return text
            at = self._where(name)
            if at[1] not in named or not self._known(at):
                return text
            meta, df = self._load(name)
            from ..operators.families import expand

            for family in meta.flexible:
                if family.lower() in families:
                    df = expand(df, family)
            view = f"quill_{at[0]}_{at[1]}_{abs(hash(tuple(sorted(families))))}"
            df.createOrReplaceTempView(view)
            return f"{view} AS {alias or at[1]}"

        work.table = table
        text = work.statement()
        for family in families:
            if any(family == f.lower() for f in self._flexible(named)):
                text = re.sub(rf"\b{family}\.\*", "_qualifier, _value", text, flags=re.IGNORECASE)
        return self.spark.sql(text, args=self._args) if self._args else self.spark.sql(text)

    def _known(self, at: tuple[str, str]) -> bool:
        try:
            self.store.meta(*at)
            return True
        except StoreError:
            return False

    def _flexible(self, named: set[str]) -> list[str]:
        tables = [(self.database, t) for t in named if self.database] + [(d, t) for d in named for t in named]
        return [f for at in tables if self._known(at) for f in self.store.meta(*at).flexible]

    # -- writes ------------------------------------------------------------------------

    def _insert(self, work: Rewriter) -> DataFrame:
        replace = work.take()[1].upper() == "REPLACE"
        ignore = not replace and work.accept("IGNORE")
        work.accept("INTO")
        meta, df = self._load(self._name(work))
        tail = self._cut(work, "ON", "DUPLICATE", "KEY", "UPDATE")
        columns = [c.name for c in meta.columns]
        if work.word() == "(" and work.word(1) != "SELECT":
            columns = [meta.column(c.strip("`")).name for c in work.parenthesised_names()[1:-1].split(", ")]
            if len(set(columns)) < len(columns):
                raise SqlError("a column is given twice")
        given = work.accept("VALUES") or work.accept("VALUE")
        if given:
            new = self._given_rows(work, meta, columns)
            self._end(work)
        else:
            new = self._select(work)
            self._end(work)
            if len(new.columns) != len(columns):
                raise SqlError(f"{len(new.columns)} values for {len(columns)} columns")
            new = self.store.stage(meta, new.toDF(*columns).withColumn("q_order", F.monotonically_increasing_id()))
        assignments = self._assignments_of(tail, meta) if tail else None
        if (ignore or assignments) and not meta.primary_key:
            raise SqlError("IGNORE and ON DUPLICATE KEY need a primary key")
        new = self._with_defaults(meta, new, columns)
        if given:  # as many rows as the statement holds: worked out once
            new = self.spark.createDataFrame(new.collect(), new.schema)
        needed = [c.name for c in meta.columns if not c.nullable]
        if needed and not new.where(" OR ".join(f"`{c}` IS NULL" for c in needed)).isEmpty():
            raise StoreError(f"a column of {', '.join(needed)} cannot be NULL")
        key = meta.primary_key
        if not key:
            affected = new.count()
            self.store.append(meta, _widened(new.drop("q_order"), df))
            self._save(meta)
            return self._done(affected)
        touched = restrict(df, key, KeySet(keys=tuple(tuple(r) for r in new.select(*_quoted(key)).collect()))) if given else mutate.in_rows_of(df, new, key)
        affected = new.count()
        if replace:
            puts = _widened(mutate.last_of_each(new, key, "q_order"), df)
        elif ignore:
            first = mutate.last_of_each(new.withColumn("q_order", -F.col("q_order")), key, "q_order")
            puts = _widened(mutate.insert_only(touched.limit(0), first.join(touched.select(*_quoted(key)), key, "left_anti"), key), df)
            for index in meta.indexes:
                if index.unique:
                    puts = self._without_clashes(meta, index, puts)
            affected = puts.count()
        elif assignments:
            twice = new.groupBy(*_quoted(key)).agg(F.count("*").alias("n")).join(touched.select(*_quoted(key), F.lit(1).alias("q_old")), key, "left")
            affected = twice.agg(F.sum(F.expr("2 * n - IF(q_old IS NULL, 1, 0)"))).first()[0] or 0
            puts = mutate.on_duplicate(touched, _widened(new, df, new), key, assignments, "q_order")
        else:
            puts = mutate.upsert(touched, new, key, "q_order")
        self.store.write(meta, puts)
        self._save(meta)
        return self._done(affected)

    def _given_rows(self, work: Rewriter, meta: TableMeta, columns: Sequence[str]) -> DataFrame:
        rows = []
        while True:
            work.expect("(")
            values = self._values(work)
            if len(values) != len(columns):
                raise SqlError(f"{len(values)} values for {len(columns)} columns")
            rows.append([self._default(meta, columns[i]) if v == "DEFAULT" else v for i, v in enumerate(values)])
            work.expect(")")
            if not work.accept(","):
                break
        selects = [f"SELECT {', '.join(f'{v} AS `{c}`' for c, v in zip(columns, r))}{', ' if r else ''}{n} AS q_order" for n, r in enumerate(rows)]
        text = " UNION ALL ".join(selects)
        new = self.spark.sql(text, args=self._args) if self._args else self.spark.sql(text)
        return new.select(*[F.col(f"`{c}`").cast(meta.column(c).type).alias(c) for c in columns], F.col("q_order").cast("long").alias("q_order"))

    def _with_defaults(self, meta: TableMeta, new: DataFrame, columns: Sequence[str]) -> DataFrame:
        """All columns of the table, in its types; the automatic one counts on from the last id given out."""
        automatic = meta.attributes.get("auto_column")
        for column in meta.columns:
            if column.name in columns:
                new = new.withColumn(column.name, F.col(f"`{column.name}`").cast(column.type))
            elif column.name == automatic:
                new = new.withColumn(column.name, F.lit(None).cast(column.type))
            else:
                if column.default is None and not column.nullable:
                    raise StoreError(f"column {column.name} has no default")
                new = new.withColumn(column.name, F.expr(column.default or "NULL").cast(column.type))
        if automatic:
            last = int(meta.attributes.get("auto_last", 0))
            most = new.agg(F.max(F.col(f"`{automatic}`")), F.max("q_order"), F.count_if(F.col(f"`{automatic}`").isNull())).first()
            new = new.withColumn(automatic, F.coalesce(F.col(f"`{automatic}`"), (F.lit(last + 1) + F.col("q_order")).cast(meta.column(automatic).type)))
            if most[2]:
                self.scope.values["last_insert_id"] = last + 1
            meta.attributes["auto_last"] = str(max(last + (most[1] + 1 if most[2] else 0), most[0] or 0))
        return new

    def _without_clashes(self, meta: TableMeta, index: Index, puts: DataFrame) -> DataFrame:
        """``puts`` without rows whose unique values a row of the table, or an earlier one of them, has."""
        columns, key = _quoted(index.columns), _quoted(meta.primary_key)
        none = " OR ".join(f"`{c}` IS NULL" for c in index.columns)
        whole = puts.where(f"NOT ({none})").join(self.store.entries(meta, index).select(*columns), index.columns, "left_anti")
        first = whole.groupBy(*columns).agg(F.min(F.struct(*key)).alias("q_first"))
        whole = whole.join(first, index.columns).where(F.struct(*key) == F.col("q_first")).select(*_quoted(puts.columns))
        return puts.where(none).union(whole)

    def _assignments(self, work: Rewriter, meta: TableMeta) -> dict[str, str]:
        given: dict[str, str] = {}
        while True:
            name = meta.column(self._name(work).split(".")[-1].strip("`")).name
            work.expect("=")
            given[name] = self._default(meta, name) if work.accept("DEFAULT") else work.expression()
            if not work.accept(","):
                return given

    def _assignments_of(self, tail: Rewriter, meta: TableMeta) -> dict[str, str]:
        """Those of ON DUPLICATE KEY UPDATE: names are the row's that is there (q_s), VALUES(name) the new one's (q_e)."""
        known = {c.name.lower(): c.name for c in meta.columns}
        own = lambda name: known.get(name.split(".")[-1].strip("`").lower())
        tail.column = lambda name: f"q_s.`{own(name)}`" if own(name) else name
        tail.new_value = lambda name: f"q_e.`{meta.column(name.strip('`')).name}`"
        given = self._assignments(tail, meta)
        self._end(tail)
        if {c.lower() for c in given} & {c.lower() for c in meta.primary_key}:
            raise SqlError("ON DUPLICATE KEY UPDATE cannot change the key")
        return given

    @staticmethod
    def _cut(work: Rewriter, *words: str) -> Rewriter | None:
        """What follows ``words``, taken off ``work``; None if they aren't there."""
        for at in range(work.at, len(work.tokens)):
            if [t[1].upper() for t in work.tokens[at : at + len(words)] if t[0] == "word"] == list(words):
                tail = Rewriter("")
                tail.tokens = work.tokens[at + len(words) :]
                work.tokens = work.tokens[:at]
                return tail
        return None

    def _values(self, work: Rewriter) -> list[str]:
        out = []
        while work.word() != ")":
            if work.word() == "DEFAULT":
                work.take()
                out.append("DEFAULT")
            else:
                out.append(work.expression())
            if not work.accept(","):
                break
        return out

    @staticmethod
    def _default(meta: TableMeta, name: str) -> str:
        return meta.column(name).default or "NULL"

    @staticmethod
    def _name(work: Rewriter) -> str:
        if work.peek()[0] not in ("word", "quoted"):
            raise SqlError(f"expected a name, found {work.peek()[1]!r}")
        text = work.name()
        while work.accept("."):
            text += "." + work.name()
        return text

    def _target(self, work: Rewriter, *stops: str) -> tuple[TableMeta, DataFrame]:
        """The table an UPDATE or DELETE names, under its alias."""
        name = self._name(work)
        meta, df = self._load(name)
        alias = meta.name
        if work.accept("AS") or (work.peek()[0] in ("word", "quoted") and work.word() not in stops):
            alias = self._name(work).strip("`")
        return meta, df.alias(alias)

    def _hits(self, work: Rewriter, meta: TableMeta, df: DataFrame) -> tuple[DataFrame, str | None]:
        """The rows that WHERE, ORDER BY and LIMIT hold a statement to, and the condition."""
        where = Rewriter.boolean(work.expression()) if work.accept("WHERE") else None
        rows = df.where(where) if where else df
        order = []
        if work.accept("ORDER", "BY"):
            while True:
                key = F.expr(work.expression())
                order.append(key.desc() if work.accept("DESC") else key.asc())
                work.accept("ASC")
                if not work.accept(","):
                    break
        if work.accept("LIMIT"):
            n = int(work.expression())
            if not meta.primary_key:
                raise SqlError("LIMIT needs a primary key")
            rows = rows.orderBy(*order, *_quoted(meta.primary_key)).limit(n)
        self._end(work)
        return rows, where

    def _update(self, work: Rewriter) -> DataFrame:
        work.take()
        meta, df = self._target(work, "SET")
        work.expect("SET")
        given = self._assignments(work, meta)
        rows, where = self._hits(work, meta, df)
        affected = rows.count()
        if not meta.primary_key:
            self.store.rewrite(meta, mutate.update_where(df, given, where))
        elif {c.lower() for c in given} & {c.lower() for c in meta.primary_key}:
            self._move(meta, rows, given)
        else:
            self.store.write(meta, mutate.update_where(rows, given))
        self._save(meta)
        return self._done(affected)

    def _move(self, meta: TableMeta, rows: DataFrame, given: dict[str, str]) -> None:
        """An update of key columns: the old keys go, and the new ones must be free."""
        key = _quoted(meta.primary_key)
        moved = self.store.stage(meta, mutate.update_where(rows, given))
        stays = self.store.data(meta).select(*key).join(rows.select(*key), meta.primary_key, "left_anti")
        after = stays.join(moved.select(*key).distinct(), meta.primary_key, "left_semi").union(moved.select(*key))
        if not after.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise StoreError(f"duplicate entry for the primary key of {meta.name}")
        self.store.write(meta, gone=rows.select(*key))
        self.store.write(meta, moved)

    def _delete(self, work: Rewriter) -> DataFrame:
        work.take()
        work.expect("FROM")
        meta, df = self._target(work, "WHERE", "ORDER", "LIMIT", "")
        rows, where = self._hits(work, meta, df)
        affected = rows.count()
        if not meta.primary_key:
            self.store.rewrite(meta, mutate.delete_where(df, where))
        else:
            self.store.write(meta, gone=rows.select(*_quoted(meta.primary_key)))
        self._save(meta)
        return self._done(affected)

    # -- definitions -------------------------------------------------------------------

    def _if_not_exists(self, work: Rewriter) -> bool:
        return work.accept("IF", "NOT", "EXISTS")

    def _create(self, work: Rewriter) -> DataFrame:
        work.take()
        if work.accept("DATABASE") or work.accept("SCHEMA"):
            lenient = self._if_not_exists(work)
            name = self._name(work).strip("`")
            self._end(work)
            self.store.create_database(name, lenient)
            return self._done()
        unique = work.accept("UNIQUE")
        if work.accept("INDEX"):
            name = self._name(work).strip("`")
            work.expect("ON")
            at = self._where(self._name(work))
            columns = self._columns(work)
            self._end(work)
            self.store.create_index(*at, Index(name, columns, unique))
            return self._done()
        work.expect("TABLE")
        lenient = self._if_not_exists(work)
        database, table = self._where(self._name(work))
        meta = TableMeta(database, table, [], [])
        work.expect("(")
        while True:
            self._definition(work, meta)
            if not work.accept(","):
                break
        work.expect(")")
        while work.peek()[0] == "word":
            option = work.take()[1].lower()
            work.accept("=")
            meta.attributes[option] = work.take()[1].strip("'\"")
        self._end(work)
        self.store.create_table(meta, lenient)
        return self._done()

    def _columns(self, work: Rewriter) -> list[str]:
        return [c.strip("`") for c in work.parenthesised_names()[1:-1].split(", ")]

    def _definition(self, work: Rewriter, meta: TableMeta) -> None:
        if work.accept("PRIMARY", "KEY"):
            meta.primary_key = self._columns(work)
        elif work.accept("FAMILY"):
            meta.flexible.append(self._name(work).strip("`"))
        elif work.word() in ("UNIQUE", "INDEX", "KEY"):
            unique = work.accept("UNIQUE")
            work.accept("INDEX")
            work.accept("KEY")
            name = self._name(work).strip("`") if work.word() != "(" else f"idx_{len(meta.indexes)}"
            meta.indexes.append(Index(name, self._columns(work), unique))
        else:
            meta.columns.append(self._column(work, meta))

    def _column(self, work: Rewriter, meta: TableMeta | None) -> Column:
        column = Column(self._name(work).strip("`"), "")
        kind = work.take()[1].lower()
        size = ""
        if work.accept("("):
            while work.word() != ")":
                size += work.take()[1]
            work.expect(")")
        if kind not in SQL_TYPES:
            raise SqlError(f"unknown type {kind}")
        column.type = f"decimal({size or '10,0'})" if SQL_TYPES[kind] == "decimal" else "decimal(20,0)" if work.accept("UNSIGNED") and SQL_TYPES[kind] == "bigint" else SQL_TYPES[kind]
        while work.peek()[0] == "word":
            if work.accept("NOT", "NULL"):
                column.nullable = False
            elif work.accept("NULL"):
                pass
            elif work.accept("PRIMARY", "KEY") and meta is not None:
                meta.primary_key = [column.name]
            elif work.accept("UNIQUE"):
                work.accept("KEY")
                if meta is not None:
                    meta.indexes.append(Index(column.name, [column.name], True))
            elif work.accept("AUTO_INCREMENT") and meta is not None:
                meta.attributes["auto_column"] = column.name
            elif work.accept("DEFAULT"):
                column.default = work.expression(12)
            elif work.accept("FAMILY"):
                column.family = self._name(work)
            elif work.accept("COMMENT"):
                work.take()
            elif work.accept("COLLATE") or work.accept("CHARSET") or work.accept("CHARACTER", "SET"):
                work.take()
            else:
                raise SqlError(f"unexpected {work.peek()[1]!r} in column {column.name}")
        return column

    def _drop(self, work: Rewriter) -> DataFrame:
        work.take()
        what = work.take()[1].upper()
        if what not in ("TABLE", "DATABASE", "SCHEMA", "INDEX"):
            raise SqlError(f"DROP {what} is not supported")
        lenient = work.accept("IF", "EXISTS")
        names = [self._name(work)]
        if what == "INDEX":
            work.expect("ON")
            at = self._where(self._name(work))
            self._end(work)
            self.store.drop_index(*at, names[0].strip("`"))
            return self._done()
        while work.accept(","):
            names.append(self._name(work))
        self._end(work)
        for name in names:
            if what == "TABLE":
                self.store.drop_table(*self._where(name), lenient)
            else:
                self.store.drop_database(name.strip("`"))
        return self._done()

    def _alter(self, work: Rewriter) -> DataFrame:
        work.take()
        work.expect("TABLE")
        at = self._where(self._name(work))
        if work.accept("DROP"):
            work.accept("COLUMN")
            name = self._name(work).strip("`")
            self._end(work)
            self.store.drop_column(*at, name)
            return self._done()
        work.expect("ADD")
        work.accept("COLUMN")
        column = self._column(work, None)
        self._end(work)
        self.store.add_column(*at, column)
        return self._done()

    def _truncate(self, work: Rewriter) -> DataFrame:
        work.take()
        work.accept("TABLE")
        meta, df = self._load(self._name(work))
        self._end(work)
        self.store.rewrite(meta, df.limit(0))
        self._save(meta)
        return self._done()

    def _load_data(self, work: Rewriter) -> DataFrame:
        """LOAD DATA INFILE 'path' [REPLACE | IGNORE] INTO TABLE t [FIELDS TERMINATED BY 'c'] [IGNORE n LINES] [(columns)]: a file of any Hadoop file system."""
        work.take()
        work.expect("DATA")
        work.expect("INFILE")
        kind, text = work.take()
        if kind != "string":
            raise SqlError("LOAD DATA takes a path as a string")
        verb = "REPLACE INTO" if work.accept("REPLACE") else "INSERT IGNORE INTO" if work.accept("IGNORE") else "INSERT INTO"
        work.expect("INTO")
        work.expect("TABLE")
        name = self._name(work)
        meta, _ = self._load(name)
        separator, header = "\t", False
        if work.accept("FIELDS"):
            work.expect("TERMINATED")
            work.expect("BY")
            separator = string_value(work.take()[1])
        if work.accept("IGNORE"):
            if work.take()[1] != "1":
                raise SqlError("only IGNORE 1 LINES is supported")
            work.expect("LINES")
            header = True
        columns = [c.name for c in meta.columns]
        if work.word() == "(":
            columns = [meta.column(c.strip("`")).name for c in work.parenthesised_names()[1:-1].split(", ")]
        self._end(work)
        schema = ", ".join(f"`{c}` {meta.column(c).type}" for c in columns)
        rows = self.spark.read.schema(schema).csv(string_value(text), sep=separator, header=header, nullValue="\\N", enforceSchema=True)
        view = f"quill_load_{id(rows)}"
        rows.createOrReplaceTempView(view)
        named = ", ".join(f"`{c}`" for c in columns)
        return self._insert(Rewriter(f"{verb} {name} ({named}) SELECT {named} FROM {view}"))

    def _split(self, work: Rewriter) -> DataFrame:
        """SPLIT TABLE t [BETWEEN (a) AND (b)] REGIONS n, or BY (a), (b), ...: keys and rows of each region.

        Without bounds the regions are of about equal size; BETWEEN cuts the range of the
        first key column into n equal steps; BY gives the lower bounds themselves.
        """
        work.take()
        work.expect("TABLE")
        meta, df = self._load(self._name(work))
        key = _quoted(meta.primary_key)
        bounds: list[tuple] | None = None
        if work.accept("BY"):
            bounds = [self._literals(work)]
            while work.accept(","):
                bounds.append(self._literals(work))
        elif work.accept("BETWEEN"):
            low = self._literals(work)
            work.expect("AND")
            high = self._literals(work)
            work.expect("REGIONS")
            regions = int(work.take()[1])
            if regions < 1 or len(low) != 1 or len(high) != 1:
                raise SqlError("SPLIT BETWEEN takes one value on each side and a number of regions")
            step = (high[0] - low[0]) / regions
            bounds = [(low[0] + type(low[0])(step * i),) for i in range(1, regions)]
        else:
            work.expect("REGIONS")
            regions = int(work.take()[1])
        self._end(work)
        if bounds is None:
            dealt = self.store.split_ranges(meta, regions)
        else:
            above = [mutate.at_or_above(meta.primary_key, b).cast("int") for b in bounds]
            dealt = df.withColumn("region", sum(above[1:], above[0]) if above else F.lit(0))
        return dealt.groupBy("region").agg(F.min(F.struct(*key)).alias("first_key"), F.max(F.struct(*key)).alias("last_key"), F.count("*").alias("n"))

    def _literals(self, work: Rewriter) -> tuple:
        work.expect("(")
        values = work.arguments()
        work.expect(")")
        return tuple(self.spark.sql(f"SELECT {', '.join(values)}").first())

    # -- information -------------------------------------------------------------------

    def _rows(self, work: Rewriter, rows: list[tuple], schema: str) -> DataFrame:
        """``rows`` through the statement's LIKE (on the first column) or WHERE."""
        df = self.spark.createDataFrame(rows, schema)
        if work.accept("LIKE"):
            df = df.where(F.col(df.columns[0]).like(string_value(work.take()[1])))
        elif work.accept("WHERE"):
            df = df.where(Rewriter.boolean(work.expression()))
        self._end(work)
        return df

    def _show(self, work: Rewriter) -> DataFrame:
        work.take()
        wide = work.accept("GLOBAL")
        for word in ("SESSION", "FULL"):
            work.accept(word)
        what = work.take()[1].upper()
        if what in ("DATABASES", "SCHEMAS"):
            return self._rows(work, [(d,) for d in self.store.databases()], "Database string")
        if what == "TABLES":
            database = self._name(work).strip("`") if work.accept("FROM") or work.accept("IN") else self.database
            return self._rows(work, [(t,) for t in self.store.tables(database)], f"Tables_in_{database} string")
        if what in ("COLUMNS", "FIELDS"):
            work.accept("FROM")
            return self._columns_of(work, self._name(work))
        if what in ("INDEX", "INDEXES", "KEYS"):
            work.accept("FROM")
            meta = self.store.meta(*self._where(self._name(work)))
            rows = [("PRIMARY", 0, n, c) for n, c in enumerate(meta.primary_key, 1)] + [(i.name, int(not i.unique), n, c) for i in meta.indexes for n, c in enumerate(i.columns, 1)]
            return self._rows(work, rows, "Key_name string, Non_unique int, Seq_in_index int, Column_name string")
        if what == "CREATE":
            work.expect("TABLE")
            meta = self.store.meta(*self._where(self._name(work)))
            return self._rows(work, [(meta.name, create_text(meta))], "Table string, `Create Table` string")
        if what == "VARIABLES":
            return self._rows(work, sorted((k, str(v)) for k, v in (info.SYSTEM if wide else self.scope.system).items()), "Variable_name string, Value string")
        if what == "STATUS":
            return self._rows(work, [("Ssl_cipher", ""), ("Threads_connected", "1")], "Variable_name string, Value string")
        if what in ("CHARSET", "CHARACTER"):
            work.accept("SET")
            return self._rows(work, [("binary", "binary", "binary", 1), ("utf8mb4", "UTF-8 Unicode", "utf8mb4_bin", 4)], "Charset string, Description string, `Default collation` string, Maxlen int")
        if what == "COLLATION":
            return self._rows(work, [("utf8mb4_bin", "utf8mb4", "Yes"), ("utf8mb4_general_ci", "utf8mb4", ""), ("utf8mb4_unicode_ci", "utf8mb4", "")], "Collation string, Charset string, `Default` string")
        raise SqlError(f"SHOW {what} is not supported")

    def _columns_of(self, work: Rewriter, name: str) -> DataFrame:
        meta = self.store.meta(*self._where(name))
        unique = {i.columns[0] for i in meta.indexes if i.unique and len(i.columns) == 1}
        key = lambda c: "PRI" if c in meta.primary_key else "UNI" if c in unique else "MUL" if any(i.columns[0] == c for i in meta.indexes) else ""
        rows = [(c.name, c.type, "YES" if c.nullable else "NO", key(c.name), c.default, "") for c in meta.columns]
        rows += [(f, "family", "YES", "", None, "") for f in meta.flexible]
        return self._rows(work, rows, "Field string, Type string, `Null` string, Key string, `Default` string, Extra string")

    def _describe(self, work: Rewriter) -> DataFrame:
        work.take()
        if work.word() in ("SELECT", "WITH"):
            plan = self._query(work)._jdf.queryExecution().toString()
            return self.spark.createDataFrame([(plan,)], "plan string")
        return self._columns_of(work, self._name(work))

    # -- session -----------------------------------------------------------------------

    def _set(self, work: Rewriter) -> DataFrame:
        work.take()
        while True:
            wide = work.accept("GLOBAL")
            for word in ("SESSION", "LOCAL"):
                work.accept(word)
            if work.accept("NAMES"):
                work.take()
            else:
                kind, name = work.take()
                if kind not in ("word", "variable"):
                    raise SqlError(f"unexpected {name!r}")
                if not work.accept("="):
                    work.expect(":=")
                value = self.spark.sql(f"SELECT {work.expression()}").first()[0]
                if kind == "variable" and not name.startswith("@@"):
                    self.scope.variables[name[1:].lower()] = "NULL" if value is None else sql_string(value) if isinstance(value, str) else str(value)
                else:
                    wide = wide or name.lower().startswith("@@global.")
                    (info.SYSTEM if wide else self.scope.system)[name.lstrip("@").split(".")[-1].lower()] = value
            if not work.accept(","):
                self._end(work)
                return self._done()

    def _use(self, work: Rewriter) -> DataFrame:
        work.take()
        name = self._name(work).strip("`").lower()
        self._end(work)
        if name not in self.store.databases():
            raise StoreError(f"unknown database {name}")
        self.database = self.scope.values["database"] = name
        return self._done()

    def _begin(self, work: Rewriter) -> DataFrame:
        if work.take()[1].upper() == "START":
            work.expect("TRANSACTION")
        self._end(work)
        if self.pending:
            self._publish()
        self.pending = {}
        return self._done()

    def _publish(self) -> None:
        pending, self.pending = self.pending or {}, None
        for meta, changed in pending.values():
            if changed:
                self.store.commit(meta)

    def _commit(self, work: Rewriter) -> DataFrame:
        """Publish each changed table; a Conflict if another writer changed one since it was first read."""
        work.take()
        self._end(work)
        self._publish()
        return self._done()

    def _rollback(self, work: Rewriter) -> DataFrame:
        work.take()
        self._end(work)
        self.pending = None
        return self._done()

    # -- prepared statements -----------------------------------------------------------

    def prepare(self, name: str, text: str) -> None:
        Rewriter(text)
        self.prepared[name.lower()] = text

    def execute(self, name: str, args: list | dict | None = None) -> DataFrame:
        if name.lower() not in self.prepared:
            raise SqlError(f"unknown prepared statement {name}")
        return self.sql(self.prepared[name.lower()], args)

    def close(self, name: str) -> None:
        if self.prepared.pop(name.lower(), None) is None:
            raise SqlError(f"unknown prepared statement {name}")

    def _prepare(self, work: Rewriter) -> DataFrame:
        work.take()
        name = self._name(work).strip("`")
        work.expect("FROM")
        kind, text = work.take()
        if kind != "string":
            raise SqlError("PREPARE takes a statement as a string")
        self._end(work)
        self.prepare(name, string_value(text))
        return self._done()

    def _execute(self, work: Rewriter) -> DataFrame:
        work.take()
        name, args = self._name(work).strip("`"), []
        if work.accept("USING"):
            while True:
                args.append(self.spark.sql(f"SELECT {work.primary()}").first()[0])
                if not work.accept(","):
                    break
        self._end(work)
        return self.execute(name, args or None)

    def _deallocate(self, work: Rewriter) -> DataFrame:
        work.take()
        work.expect("PREPARE")
        name = self._name(work).strip("`")
        self._end(work)
        self.close(name)
        return self._done()


def _quoted(names: Sequence[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def _widened(rows: DataFrame, table: DataFrame, with_order: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns of ``table`` that they lack as NULL, and q_order where it is asked for."""
    rows = with_order if with_order is not None else rows
    types = dict(table.dtypes)
    out = [F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast(types[c]).alias(c) for c in table.columns]
    return rows.select(*out, *(["q_order"] if with_order is not None else []))


def create_text(meta: TableMeta) -> str:
    lines = [f"  `{c.name}` {c.type}{'' if c.nullable else ' NOT NULL'}{f' DEFAULT {c.default}' if c.default is not None else ''}" for c in meta.columns]
    lines += [f"  FAMILY `{f}`" for f in meta.flexible]
    if meta.primary_key:
        lines.append("  PRIMARY KEY (" + ", ".join(f"`{c}`" for c in meta.primary_key) + ")")
    lines += [f"  {'UNIQUE ' if i.unique else ''}KEY `{i.name}` (" + ", ".join(f"`{c}`" for c in i.columns) + ")" for i in meta.indexes]
    return f"CREATE TABLE `{meta.name}` (\n" + ",\n".join(lines) + "\n)"
