"""Writers: JSON lines with explicit nulls, JSON and text reports, append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _finite(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.DoubleType | T.FloatType | T.StructType | T.ArrayType):
        return F.transform(c, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_finite(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.DoubleType | T.FloatType):
        return F.transform_values(c, lambda k, v: _finite(v, kind.valueType))
    return c


def finite(df: DataFrame) -> DataFrame:
    """df with NaN and infinities as nulls, inside structs, arrays and maps too."""
    return df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def jsonl(df: DataFrame, path: str, *, strict: bool = True, mode: str = "overwrite") -> None:
    """JSON lines with nulls written out; strict: no NaN or infinity."""
    (finite(df) if strict else df).write.mode(mode).option("ignoreNullFields", False).json(path)


def appended(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table lacks; how many."""
    from ..streaming.events import resumed

    return resumed(df, path, key, lambda rows: rows)


def json_report(df: DataFrame) -> str:
    """A one-row table as indented JSON."""
    import json

    row = finite(df).limit(2).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()
    if len(row) != 1:
        raise ValueError("a report has one row")
    return json.dumps(json.loads(row[0]["j"]), ensure_ascii=False, indent=2) + "\n"


def text_report(df: DataFrame, path: str, text: str) -> None:
    """Text through Spark's writer, so that the path may be on any file system."""
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def guarded_output(path: str, roots: list[str]) -> str:
    """The path, unless it lies outside the allowed roots."""
    if not any(path == r or path.startswith(r.rstrip("/") + "/") for r in roots) or "/../" in path + "/":
        raise ValueError(f"{path} is outside {', '.join(roots)}")
    return path


#: Names the version that a table of replaced() has now.
POINTER = "_current"


def replaced(df: DataFrame, path: str) -> str:
    """A new version of the table at `path`, which readers see whole or not at all; returns its folder.

    The rows are written to a folder of their own below `path`. Only then is the pointer file put in the place of the one
    before, in one step, so that there always is a version to read. A run that dies earlier leaves what was there. The version before
    stays for those who read it, older ones go. `latest` reads the table."""
    import uuid

    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    name = f"v-{uuid.uuid4().hex}"
    root, pointer, staged = (hadoop.Path(f"{path.rstrip('/')}/{n}") for n in ("", POINTER, f".{POINTER}-{name}"))
    fs = root.getFileSystem(conf)
    before = _version(spark, path)
    df.write.parquet(f"{path.rstrip('/')}/{name}")
    out = fs.create(staged, True)
    out.write(f"{name}\n{before or ''}".encode())
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.makeQualified(root).toUri(), conf).rename(fs.makeQualified(staged), fs.makeQualified(pointer), over)
    for status in fs.listStatus(root):
        other = status.getPath().getName()
        if other.startswith("v-") and other not in (name, before):
            fs.delete(status.getPath(), True)
    return f"{path.rstrip('/')}/{name}"


def _version(spark: SparkSession, path: str) -> str | None:
    """The version that the pointer of a table names, if there is one."""
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{POINTER}")
    fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(file):
        return None
    stream = fs.open(file)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")[0]
    finally:
        stream.close()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The table of replaced() as it is now."""
    name = _version(spark, path)
    if name is None:
        raise ValueError(f"{path} has no version")
    return spark.read.parquet(f"{path.rstrip('/')}/{name}")
