"""Readers: strict and tolerant JSON lines, JSON documents, CSV, Parquet, XML, zipped JSON, file audits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SourceError(ValueError):
    """A source can't be read as asked."""


def _string_schema(schema) -> str:
    return schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, whatever their size: a file is read in splits. Lines are counted for each split, and
    a line's number is its place in its split after the lines of the splits before. Lines end with a line feed, with or without a
    carriage return."""
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"\r$", "").alias("value"),
    )
    # one row a split; its lines have consecutive ids
    splits = rows.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    splits = splits.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n"))
    return rows.join(splits, ["file", "split"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Strict JSON lines: blank lines are passed over; the first line that isn't an object of the schema ends the job with an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _parsed(value, schema):
    """The value as a struct of the schema, null unless it is an object whose fields have its types."""
    kind = f"{_string_schema(schema)}, `_corrupt` string"
    row = F.from_json(value, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # by way of to_json, since a struct of which one field is asked for would be parsed for that field alone
    return F.when(F.get_json_object(F.to_json(row), "$._corrupt").isNull(), row)


def bad_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """(file, line, value) of the lines that strict reading would refuse."""
    return numbered_lines(spark, path).where(F.trim("value") != "").where(_parsed(F.col("value"), schema).isNull()).select("file", "line", "value")


def jsonl_checked(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Strict JSON lines whose error names file and line."""
    bad = bad_lines(spark, path, schema).orderBy("file", "line").limit(1).collect()
    if bad:
        raise SourceError(f"{bad[0]['file']}, line {bad[0]['line']}: no JSON object of the schema")
    return jsonl(spark, path, schema)


def jsonl_tolerant(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): rows that are objects, and counts of records and undecodable ones. Both come from one definition."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(_parsed(F.col("value"), schema).alias("r"))
    bad = F.col("r").isNull()
    return parsed.where(~bad).select("r.*").drop("_corrupt"), parsed.agg(F.count(F.lit(1)).alias("records"), F.count_if(bad).alias("undecodable"))


def json_document(spark: SparkSession, path: str, schema: str | T.StructType, *, container: str | None = None) -> DataFrame:
    """A JSON array or object as rows; with a container, the array under that name of a top-level object."""
    if container is None:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    kind = schema if isinstance(schema, str) else _string_schema(schema)
    rows = spark.read.schema(f"`{container}` array<struct<{kind_to_struct(kind)}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.inline(F.col(container)))


def kind_to_struct(ddl: str) -> str:
    """DDL of columns as the inside of a struct type."""
    return T.StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; all columns are strings."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def any_records(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Records of a .jsonl, .ndjson, .json, .csv or .parquet path, by its suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("jsonl", "ndjson"):
        return jsonl(spark, path, schema) if schema else spark.read.option("mode", "FAILFAST").json(path)
    if suffix == "json":
        return json_document(spark, path, schema) if schema else spark.read.option("multiLine", True).json(path)
    if suffix == "csv":
        return csv(spark, path)
    if suffix == "parquet":
        return parquet(spark, path)
    raise SourceError(f"no reader for .{suffix}")


def files(spark: SparkSession, roots: list[str], suffixes: tuple[str, ...] = ("jsonl", "json", "csv", "parquet")) -> DataFrame:
    """(path, length, modified) of data files under the roots, each once."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", "length", F.col("modificationTime").alias("modified"))
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)).dropDuplicates(["path"])


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


# Names that hold a question or an answer.
QUESTION_FIELDS, ANSWER_FIELDS = ["question", "problem", "prompt", "query"], ["answer", "gold_answer", "solution", "label"]


def audit(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON-lines file: records, undecodable ones, the sorted union of field names, whether some field holds a
    question and an answer."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value")).where(F.trim("value") != "")
    keyed = lines.withColumn("keys", F.json_object_keys("value")).withColumn("ok", F.col("keys").isNotNull())
    fields = keyed.select("file", F.explode_outer("keys").alias("k")).groupBy("file").agg(F.array_sort(F.collect_set("k")).alias("fields"))
    counts = keyed.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("ok")).alias("undecodable"))
    has = lambda names: F.arrays_overlap(F.transform("fields", F.lower), F.array(*[F.lit(n) for n in names]))
    return counts.join(fields, "file").select("file", "records", "undecodable", "fields", has(QUESTION_FIELDS).alias("has_question"), has(ANSWER_FIELDS).alias("has_answer"))


def catalog(audited: DataFrame, floors: tuple[int, ...] = (500, 2000)) -> DataFrame:
    """One row over audited files: files, most records, the largest usable file, usable files at or above each floor."""
    usable = F.col("has_question") & F.col("has_answer")
    return audited.agg(F.count(F.lit(1)).alias("files"), F.max("records").alias("most_records"), F.max_by("file", F.when(usable, F.col("records"))).alias("largest"), *[F.count_if(usable & (F.col("records") >= n)).alias(f"usable_{n}") for n in floors])


def xml(spark: SparkSession, path: str, row: str, schema: str | T.StructType) -> DataFrame:
    """Elements named `row` as rows; attributes have an underscore before their name."""
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def weaknesses(spark: SparkSession, path: str) -> DataFrame:
    """(family, normalized_id, status, name, description) of a weakness catalogue in XML."""
    rows = xml(spark, path, "Weakness", "_ID string, _Name string, _Status string, Description string")
    return rows.select(F.lit("cwe").alias("family"), F.concat(F.lit("CWE-"), F.col("_ID").cast("int").cast("string")).alias("normalized_id"), F.lower(F.coalesce("_Status", F.lit("unknown"))).alias("status"), F.col("_Name").alias("name"), F.left(F.trim(F.regexp_replace("Description", r"\s+", " ")), F.lit(700)).alias("description"))


def techniques(spark: SparkSession, path: str) -> DataFrame:
    """(family, normalized_id, status, name, description, tactics) of attack patterns in a STIX bundle."""
    kind = "objects array<struct<type:string,name:string,description:string,revoked:boolean,x_mitre_deprecated:boolean,external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<phase_name:string>>>>"
    o = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("objects").alias("o")).where("o.type = 'attack-pattern'")
    ids = F.transform(F.filter("o.external_references", lambda r: r["external_id"].rlike(r"^T\d{4}(\.\d{3})?$")), lambda r: r["external_id"])
    status = F.when(F.col("o.revoked"), "revoked").when(F.col("o.x_mitre_deprecated"), "deprecated").otherwise("active")
    tactics = F.array_sort(F.array_distinct(F.transform(F.coalesce("o.kill_chain_phases", F.array().cast("array<struct<phase_name:string>>")), lambda p: p["phase_name"])))
    return o.select(F.lit("attack").alias("family"), F.try_element_at(ids, F.lit(1)).alias("normalized_id"), status.alias("status"), "o.name", F.left(F.trim(F.regexp_replace("o.description", r"\s+", " ")), F.lit(700)).alias("description"), tactics.alias("tactics")).where("normalized_id is not null")


def zipped_json(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, value) of the .json members of zip archives. An archive is read by one task, member by member."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if name.lower().endswith(".json"):
                            yield pd.DataFrame({"archive": [archive], "member": [name], "value": [z.read(name).decode("utf-8")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, member string, value string")


def vulnerabilities(documents: DataFrame) -> DataFrame:
    """(family, normalized_id, status, description, products) of vulnerability documents (member, value); at most eight
    distinct products in order."""
    kind = "cveMetadata struct<cveId:string,state:string>, containers struct<cna:struct<descriptions:array<struct<lang:string,value:string>>,affected:array<struct<product:string>>>>"
    d = documents.select(F.from_json("value", kind).alias("d"))
    text = F.try_element_at(F.filter("d.containers.cna.descriptions", lambda x: F.startswith(x["lang"], F.lit("en"))), F.lit(1))["value"]
    products = F.slice(F.array_sort(F.array_distinct(F.filter(F.transform("d.containers.cna.affected", lambda a: a["product"]), lambda p: p.isNotNull()))), 1, 8)
    status = F.when(F.col("d.cveMetadata.state") == "REJECTED", "rejected").otherwise("active")
    return d.select(F.lit("cve").alias("family"), F.upper("d.cveMetadata.cveId").alias("normalized_id"), status.alias("status"), F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(700)).alias("description"), products.alias("products")).where("normalized_id is not null")


def require_at_least(df: DataFrame, rows: int) -> DataFrame:
    """df, unless it has fewer rows."""
    if df.limit(rows).count() < rows:
        raise SourceError(f"fewer than {rows} rows")
    return df


def identifier(name: str) -> str:
    """A column name made of letters, digits and underscores."""
    return re.sub(r"\W+", "_", name).strip("_").lower()
