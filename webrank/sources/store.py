"""Verbs of a keyed table store on DataFrames and catalog tables.

A store table is a DataFrame ``(key, cols map<string,string>)`` or any DataFrame with a key column. Nothing is changed in
place: puts give the table after them, to be written where the caller wants it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(df: DataFrame, key: str, start: object = None, stop: object = None) -> DataFrame:
    """Rows with ``start <= key < stop``; an open end is None (SRC3, SRC4, FIL3). The range reaches the Parquet scan."""
    if start is not None:
        df = df.where(F.col(key) >= F.lit(start))
    return df if stop is None else df.where(F.col(key) < F.lit(stop))


def get_row(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key, or none (SRC5)."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def get_cell(df: DataFrame, key: str, value: object, column: str) -> DataFrame:
    """``(value)``: one cell, or no row (SRC6)."""
    return get_row(df, key, value).select(F.col(column).alias("value")).where("value is not null")


def exists(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The rows of ``keys`` with a flag whether ``df`` has their key (SRC7)."""
    have = df.select(key).distinct().withColumn("exists", F.lit(True))
    return keys.join(have, key, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def count(df: DataFrame) -> DataFrame:
    """One row with the number of rows (SRC8, AGG1)."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def latest_cells(puts: DataFrame, key: str, column: str, value: str, order: str) -> DataFrame:
    """``(key, column, value)`` after all puts, of each cell the one latest by ``order`` (SNK2). Combined before the shuffle."""
    return puts.groupBy(key, column).agg(F.max_by(value, order).alias(value))


def put_cells(table: DataFrame, cells: DataFrame) -> DataFrame:
    """``table(key, cols)`` with ``cells(key, column, value)`` put in: rows are made or merged on demand (SNK2, MAPF)."""
    new = cells.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("new"))
    both = table.join(new, "key", "full_outer")
    none = F.create_map().cast("map<string,string>")
    old = F.map_filter(F.coalesce("cols", none), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("new", none)), k))
    return both.select("key", F.map_concat(old, F.coalesce("new", none)).alias("cols"))


def put_if(df: DataFrame, column: str, expected: Column, value: Column) -> DataFrame:
    """The table with ``column`` set to ``value`` where it equals ``expected``, and ``ok`` telling where it did (SNK3).

    A null or absent cell never equals anything.
    """
    ok = F.coalesce(F.col(column) == expected, F.lit(False))
    return df.withColumn("ok", ok).withColumn(column, F.when(F.col("ok"), value).otherwise(F.col(column)))


def put_rows(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` in place of its rows of the same key, whole (SNK4)."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def view_page(df: DataFrame, key: str, start: object = None, size: int = 10) -> DataFrame:
    """The page of ``size`` rows in key order from ``start`` on, with ``row_id`` their rank in the page's scan from 0, and
    ``next_key``, the key after the page or null (SNK12, TOP5)."""
    rows = scan(df, key, start).orderBy(key).limit(size + 1)
    ordered = rows.withColumn("row_id", F.row_number().over(Window.orderBy(key)) - 1)
    last = F.max(F.when(F.col("row_id") == size, F.col(key))).over(Window.partitionBy(F.lit(1)))
    return ordered.withColumn("next_key", last).where(F.col("row_id") < size)


def persist(df: DataFrame, name: str) -> None:
    """Saves under a name; an existing table is an error (SNK1, SNK5)."""
    df.write.mode("errorifexists").saveAsTable(name)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Renames a table; a missing source or existing target is an error (SNK6)."""
    spark.sql(f"ALTER TABLE `{old}` RENAME TO `{new}`")


def delete(spark: SparkSession, name: str) -> None:
    """Drops a table and its files; a missing one is an error (SNK7)."""
    spark.sql(f"DROP TABLE `{name}`")


def list_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, n)``: the number of rows of each table (SNK11)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def catalog_tables(spark: SparkSession) -> DataFrame:
    """``(name, n, persistent)`` of all tables of the session's catalog; views of the session alone are not persistent (SNK11)."""
    out = spark.createDataFrame([], "name string, n bigint, persistent boolean")
    for t in spark.catalog.listTables():
        one = spark.table(f"`{t.name}`").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(one.select(F.lit(t.name).alias("name"), "n", F.lit(not t.isTemporary).alias("persistent")))
    return out


def put_cell(spark: SparkSession, name: str, key: str, value: str, column: str, cell: str) -> None:
    """Sets one cell of the row of a key in a catalog table, making the row where there is none (SNK2). The table is written anew
    beside the old one and takes its name when it is whole."""
    table = spark.table(f"`{name}`")
    types = {f.name: f.dataType for f in table.schema}
    is_row = F.col(key) == F.lit(value).cast(types[key])
    changed = table.withColumn(column, F.when(is_row, F.lit(cell).cast(types[column])).otherwise(F.col(column)))
    fresh = [F.lit(value).cast(t).alias(c) if c == key else (F.lit(cell) if c == column else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    there = table.where(is_row).agg(F.count(F.lit(1)).alias("n"))
    added = there.where("n = 0").select(*fresh)
    persist(changed.unionByName(added), f"{name}__new")
    delete(spark, name)
    rename(spark, f"{name}__new", name)


def row_text(df: DataFrame, key: str) -> DataFrame:
    """The text form ``key { column: value, ... }`` of each row, columns in order and nulls left out (FMT1)."""
    cells = [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in sorted(df.columns) if c != key]
    return df.select(F.concat(F.col(key).cast("string"), F.lit(" { "), F.concat_ws(", ", *cells), F.lit(" }")).alias("value"))


def main(argv: list[str] | None = None) -> int:
    """Command line: ``get TABLE KEY_COLUMN KEY``, ``put TABLE KEY_COLUMN KEY COLUMN VALUE``, ``scan TABLE KEY_COLUMN [START [STOP]]``,
    ``count TABLE``, ``persist PARQUET_PATH TABLE``, ``rename OLD NEW``, ``delete TABLE``, ``list`` on the tables of the session's catalog (SNK10)."""
    import sys

    args = sys.argv[1:] if argv is None else argv
    spark = SparkSession.builder.getOrCreate()
    match args:
        case ["get", table, key, value]:
            get_row(spark.table(table), key, value).show(truncate=False)
        case ["scan", table, key, *ends]:
            row_text(scan(spark.table(table), key, *ends).orderBy(key), key).show(truncate=False)
        case ["put", table, key, value, column, cell]:
            put_cell(spark, table, key, value, column, cell)
        case ["persist", path, table]:
            persist(spark.read.parquet(path), table)
        case ["list"]:
            catalog_tables(spark).orderBy("name").show(1000, truncate=False)
        case ["count", table]:
            print(spark.table(table).count())
        case ["rename", old, new]:
            rename(spark, old, new)
        case ["delete", table]:
            delete(spark, table)
        case _:
            print(main.__doc__)
            return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
