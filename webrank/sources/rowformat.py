"""The row text format: ``key (column length bytes )* LF`` with lengths in bytes, so that values may hold anything."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME_LIMIT = 1024
CELLS = "key string, column string, value binary, seq bigint"


def encode_row(key: str, cells: dict[str, bytes]) -> bytes:
    """One row as bytes; keys and column names must not hold spaces or line feeds or exceed ``NAME_LIMIT`` bytes."""
    out = bytearray()
    for name in (key, *cells):
        raw = name.encode()
        if not raw or b" " in raw or b"\n" in raw or len(raw) > NAME_LIMIT:
            raise ValueError(f"not a key or column name: {name[:40]!r}")
    out += key.encode() + b" "
    for column, value in cells.items():
        out += column.encode() + b" " + str(len(value)).encode() + b" " + value + b" "
    return bytes(out) + b"\n"


def decode_rows(data: bytes) -> Iterator[tuple[str, dict[str, bytes]]]:
    """The rows of a file in order; a cut-off last row is left out."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at)
        if end < 0:
            return
        key, at, cells = data[at:end].decode(), end + 1, {}
        while at < len(data) and data[at : at + 1] != b"\n":
            end = data.find(b" ", at)
            stop = data.find(b" ", end + 1)
            if end < 0 or stop < 0:
                return
            length = int(data[end + 1 : stop])
            if stop + 1 + length >= len(data):
                return
            cells[data[at:end].decode()] = data[stop + 1 : stop + 1 + length]
            at = stop + 2 + length
        if at >= len(data):
            return
        at += 1
        yield key, cells


def encode(df: DataFrame, key: str) -> DataFrame:
    """``(line binary)``: each row of ``df`` in the text format, null columns left out (SNK5)."""
    columns = [c for c in df.columns if c != key]
    text = df.select(F.col(key).cast("string").alias(key), *[F.col(c).cast("string").alias(c) for c in columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = b.to_dict("records")
            yield pd.DataFrame({"line": [encode_row(r[key], {c: r[c].encode() for c in columns if isinstance(r[c], str)}) for r in rows]})

    return text.mapInPandas(run, "line binary")


def decode(df: DataFrame, column: str = "line") -> DataFrame:
    """``(key, column, value, seq)``: the cells of every row in the binary ``column``, ``seq`` counting rows of a value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, c, v, n) for data in b[column] for n, (k, cells) in enumerate(decode_rows(bytes(data))) for c, v in cells.items()]
            yield pd.DataFrame(out, columns=["key", "column", "value", "seq"])

    return df.select(column).mapInPandas(run, CELLS)


def write_table(df: DataFrame, key: str, folder: str, name: str) -> None:
    """``df`` as files ``<name>.table`` of the row format, one for each partition in a folder of its own below ``folder`` (SNK5)."""
    import pyarrow as pa
    from pyarrow import fs

    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    local = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        data = b"".join(bytes(x) for b in batches for x in b.column("line").to_pylist())
        files, path = (fs.LocalFileSystem(), folder.removeprefix("file:")) if local else fs.FileSystem.from_uri(folder)
        if data:
            part = f"{path}/{uuid.uuid4().hex}"
            files.create_dir(part, recursive=True)
            with files.open_output_stream(f"{part}/{name}.table") as out:
                out.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([len(data)], pa.int64())], names=["n"])

    encode(df, key).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """``(table, key, column, value)`` of all ``*.table`` files under ``path``; of several versions of a row the last holds (SRC9)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.table").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, data in zip(b["path"], b["content"]):
                rows: dict[str, dict[str, bytes]] = dict(decode_rows(bytes(data)))
                table = name.rsplit("/", 1)[-1].removesuffix(".table")
                out += [(table, k, c, v) for k, cells in rows.items() for c, v in cells.items()]
            yield pd.DataFrame(out, columns=["table", "key", "column", "value"])

    return files.select("path", "content").mapInPandas(run, "table string, key string, column string, value binary")
