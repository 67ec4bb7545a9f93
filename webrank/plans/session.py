"""Session helpers: tables of a directory and results cut from their lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``, lazily: filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local folder is made if the session runs on this machine alone; on a cluster that is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="webrank-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder of the shared folder, gone when the interpreter ends."""
    path = f"{shared_dir(spark)}/webrank-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a form that survives the loss of executors; the files go when the interpreter ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.webrank_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the files of a :func:`materialize` result that nothing will read any more."""
    path = getattr(df, "webrank_path", None)
    if path in _written:
        _delete(path, _written.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            _delete(path, spark)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return
