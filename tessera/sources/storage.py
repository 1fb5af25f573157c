"""Tables in the folder that the driver and all executors share: what is written there cuts lineage and is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables that stored() has made in this process and that are still there.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir. Where that is unset in local mode (tests), a
    temporary folder of this session takes its place; on a cluster it has to be set."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back. Cuts lineage: a lost
    executor costs its running tasks, never this table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    if path in _made:
        _made.remove(path)


def _folder(df: DataFrame) -> str | None:
    """The folder of a DataFrame of stored()."""
    files = df.inputFiles()[:1]
    return next((p for p in _made if files and files[0].split("/")[-2] == p.rsplit("/", 1)[1]), None)


def drop_stored(df: DataFrame) -> None:
    """Delete the table behind a DataFrame of stored() that nothing will read again."""
    if (folder := _folder(df)) is not None:
        _delete(df.sparkSession, folder)


def tables_made() -> int:
    """A mark for drop_since."""
    return len(_made)


def drop_since(mark: int, keep: DataFrame) -> None:
    """Delete the tables stored since the mark, but for the one behind `keep`: for callers that have stored a result whose
    own tables nothing reads any more."""
    kept = _folder(keep)
    for path in _made[mark:]:
        if path != kept:
            _delete(keep.sparkSession, path)
