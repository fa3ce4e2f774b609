"""Databases over JDBC: tables and pass-through queries as relations, commands,
listings and number generators. Work on rows is Spark's; commands and listings
run on the driver and touch no data."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..plans import Relation


def database(spark: SparkSession, url: str, *keys: Iterable[str], table: str | None = None, query: str | None = None, **options) -> Relation:
    """A table or a pass-through query of a JDBC database; filters, columns and
    aggregates above it are pushed down by Spark."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    what = {"dbtable": table} if table else {"query": query}
    return Relation.of(spark.read.format("jdbc").options(url=url, **what, **options).load(), *keys)


def store(relation: Relation, url: str, table: str, mode: str = "error", **options) -> None:
    relation.df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, **options).save()


@contextmanager
def connected(spark: SparkSession, url: str) -> Iterator:
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        yield connection
    finally:
        connection.close()


def execute(spark: SparkSession, url: str, *commands: str) -> None:
    """Commands of the database's own, one after the other."""
    with connected(spark, url) as connection:
        for command in commands:
            statement = connection.createStatement()
            statement.execute(command)
            statement.close()


def available_tables(spark: SparkSession, url: str, schema: str | None = None) -> Relation:
    """(schema, name, kind) of tables and views."""
    with connected(spark, url) as connection:
        found, rows = connection.getMetaData().getTables(None, schema, "%", None), []
        while found.next():
            rows.append((found.getString("TABLE_SCHEM"), found.getString("TABLE_NAME"), found.getString("TABLE_TYPE")))
    return Relation.of(spark.createDataFrame(rows, "schema string, name string, kind string"), ["schema", "name"])


def available_references(spark: SparkSession, url: str, schema: str | None, table: str) -> Relation:
    """(name, position, column, target, target_column) of a table's references."""
    with connected(spark, url) as connection:
        found, rows = connection.getMetaData().getImportedKeys(None, schema, table), []
        while found.next():
            rows.append((found.getString("FK_NAME"), found.getInt("KEY_SEQ"), *(found.getString(c) for c in ("FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME"))))
    return Relation.of(spark.createDataFrame(rows, "name string, position int, column string, target string, target_column string"), ["name", "position"])


def next_generator(spark: SparkSession, url: str, name: str, table: str = "generators", count: int = 1) -> int:
    """The next number of a named generator, from 1; `count` reserves as many.
    The table (id, next_key) is changed within one transaction, so callers
    never get the same number."""
    with connected(spark, url) as connection:
        connection.setAutoCommit(False)
        change = connection.prepareStatement(f"UPDATE {table} SET next_key = next_key + ? WHERE id = ?")
        change.setInt(1, count)
        change.setString(2, name)
        if change.executeUpdate() == 0:
            new = connection.prepareStatement(f"INSERT INTO {table} (id, next_key) VALUES (?, ?)")
            new.setString(1, name)
            new.setInt(2, 1 + count)
            new.executeUpdate()
        look = connection.prepareStatement(f"SELECT next_key FROM {table} WHERE id = ?")
        look.setString(1, name)
        found = look.executeQuery()
        found.next()
        number = found.getInt(1) - count
        connection.commit()
    return number
