"""What data files hold and what is wrong with them: descriptors of files of every kind, tolerant Parquet, the index of ontologies."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .readers import SourceError, files, numbered_lines
from .storage import stored
from .tensors import _opened

# Fields of records derived from questions, in their order, and of questions and answers.
DERIVED_FIELDS = [
    "candidates", "units", "ablation_id", "unit_id", "span_ids", "spans", "original_question", "masked_question", "masked_id", "nli_id", "semantic_label_id", "recover_score_id", "unit_evidence_id", "attention_anchor_label_id",
    "intervention_id", "feature_id", "probe_record_id", "hidden_state_path", "hidden_states_path",
]
QUESTION, ANSWERS = "question", ["answer", "gold_answer"]

# Kinds of sources, and why they are no questions of their own.
REASONS = {
    "derived_downstream": "rows made from few questions, not questions of their own", "report_or_manifest": "a report or manifest", "human_review_labels": "labels by people, for calibration only", "empty": "no records", "unreadable": "the file can't be read",
    "other": "no question and answer",
}

#: Columns of a CSV file that are looked at.
MOST_COLUMNS = 128

FOUND = ["path", "records", "fields", "ids", "error"]


def _paths(found: DataFrame, suffix: str) -> list[str]:
    """Paths of files with a suffix: the driver plans a scan of them anyway."""
    return [r["path"] for r in found.where(F.lower("path").endswith(f".{suffix}")).select("path").collect()]


def _of_records(rows: DataFrame, error: Column) -> DataFrame:
    """Files of rows (path, keys: null unless the record is an object, id)."""
    named = F.array_sort(F.array_distinct(F.flatten(F.collect_set("keys"))))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("records"), F.coalesce(named, F.array().cast("array<string>")).alias("fields"), F.count_distinct("id").alias("ids"), error.alias("error")).select(*FOUND)


def _jsonl(spark: SparkSession, paths: list[str]) -> DataFrame:
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("value")).where("value <> ''")
    bad = F.count_if(F.try_parse_json("value").isNull())
    rows = lines.select("path", "value", F.json_object_keys("value").alias("keys"), F.get_json_object("value", "$.id").alias("id"))
    return _of_records(rows, F.when(bad > 0, F.concat(bad.cast("string"), F.lit(" undecodable lines"))))


def _json(spark: SparkSession, paths: list[str]) -> DataFrame:
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    root = F.when(F.try_parse_json("value").isNull(), "undecodable").when(F.json_array_length("value").isNotNull(), "list").when(F.json_object_keys("value").isNotNull(), "object").otherwise("neither")
    parts = F.when(F.col("root") == "list", F.from_json("value", "array<string>")).when(F.col("root") == "object", F.array("value")).otherwise(F.array(F.lit(None).cast("string")))
    rows = whole.withColumn("root", root).select("path", "root", F.explode_outer(parts).alias("value"))
    good = rows.select("path", "root", "value", F.json_object_keys("value").alias("keys"), F.get_json_object("value", "$.id").alias("id"))
    out = _of_records(good, F.max(F.when(F.col("root") == "undecodable", "undecodable document").when(F.col("root") == "neither", "the document is neither a list nor an object")))
    empty = good.groupBy("path").agg(F.count("value").alias("n"))
    return out.join(empty, "path").select("path", F.col("n").alias("records"), "fields", "ids", "error")


def _csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Three scans: where each file begins, its head, and its rows, of which no more columns are read than the widest head has."""

    named = lambda columns: [f"c{i}" for i in range(columns)]

    def read(columns: int) -> DataFrame:
        names = named(columns)
        kind = T.StructType([T.StructField(c, T.StringType()) for c in names])
        held = spark.read.schema(kind).option("multiLine", True).option("escape", '"').csv(paths)
        return held.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), *names)

    # one row a file is broadcast; the rows look as small to the planner, since most of the columns that are read drop out
    begins = read(1).groupBy("path").agg(F.min("at").alias("first")).select("first")
    heads = stored(read(MOST_COLUMNS).join(F.broadcast(begins), F.col("at") == F.col("first")).select(F.col("path").alias("path_"), F.array(*named(MOST_COLUMNS)).alias("head"), "first"), "heads")
    last = F.aggregate(F.transform("head", lambda x, i: F.when(x.isNotNull(), i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    width = heads.agg(F.max(last)).first()[0] or 1
    met = read(width).join(F.broadcast(heads), F.col("path") == F.col("path_")).withColumn("own", F.col("at") > F.col("first"))
    place = F.array_position("head", "id")
    one = F.when(F.col("own") & (place > 0), F.try_element_at(F.array(*named(width)), place.cast("int")))
    # the head of a file is no value to aggregate: it comes back by a join with one row a file
    counted = met.groupBy("path").agg(F.count_if("own").alias("records"), F.count_distinct(one).alias("ids"))
    fields = F.array_sort(F.array_compact("head"))
    return counted.join(F.broadcast(heads), F.col("path") == F.col("path_")).select("path", "records", fields.alias("fields"), "ids", F.lit(None).cast("string").alias("error"))


def _parquet(found: DataFrame) -> DataFrame:
    """From footers, read by one task a file; a file that isn't Parquet has an error."""

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for batch in batches:
            for path in batch["path"]:
                try:
                    system, inner = _opened(path)
                    with system.open_input_file(inner) as f:
                        footer = pq.ParquetFile(f)
                        yield pd.DataFrame({"path": [path], "records": [footer.metadata.num_rows], "fields": [sorted(footer.schema_arrow.names)], "ids": [0], "error": [None]})
                except Exception as e:  # whatever is wrong with one file is said beside its name
                    yield pd.DataFrame({"path": [path], "records": [0], "fields": [[]], "ids": [0], "error": [f"{type(e).__name__}: {e}"[:200]]})

    return found.where(F.lower("path").endswith(".parquet")).select("path").mapInPandas(footers, "path string, records long, fields array<string>, ids long, error string")


def described(spark: SparkSession, roots: list[str]) -> DataFrame:
    """One row for each .jsonl, .json, .csv and .parquet file below the roots: path, file_type, records, fields, has_question, has_answer,
    source_type, usable, reason, distinct_ids (of derived records) and read_error.

    Formats are told by suffix; a file that can't be read as what it says is `unreadable`, and the others are described all the same. The type
    follows ordered rules: unreadable, empty, report or manifest (by name, unless it has questions and answers), labels by people (by name), derived
    (by field), question source, other. JSON lines are counted in splits, other files are one task each; Parquet by its footer, whose ids aren't counted."""
    found = files(spark, roots)
    parts = [_parquet(found)]
    for suffix, read in (("jsonl", _jsonl), ("json", _json), ("csv", _csv)):
        if paths := _paths(found, suffix):
            parts.append(read(spark, paths))
    # file names come back with and without the slashes of an empty host
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    told = reduce(DataFrame.unionByName, parts).withColumn("p_", plain("path")).drop("path")
    every = found.select("path", plain("path").alias("p_")).join(told, "p_", "left").drop("p_")
    name, fields = F.lower(F.regexp_extract("path", r"([^/]+)$", 1)), F.coalesce("fields", F.array().cast("array<string>"))
    records = F.coalesce("records", F.lit(0))
    question, answer = F.array_contains(fields, QUESTION), F.arrays_overlap(fields, F.array(*[F.lit(a) for a in ANSWERS]))
    kind = (
        F.when(F.col("error").isNotNull() & (records == 0), "unreadable").when(records == 0, "empty").when((F.contains(name, F.lit("report")) | F.contains(name, F.lit("manifest"))) & ~(question & answer), "report_or_manifest")
        .when(F.contains(name, F.lit("human")), "human_review_labels").when(F.arrays_overlap(fields, F.array(*[F.lit(f) for f in DERIVED_FIELDS])), "derived_downstream").when(question & answer, "raw_question_source").otherwise("other")
    )
    reasons = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    out = every.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("file_type"), records.alias("records"), fields.alias("fields"), question.alias("has_question"), answer.alias("has_answer"), kind.alias("source_type"), "ids", F.col("error").alias("read_error"))
    own = F.col("source_type")
    return out.withColumns({"usable": own == "raw_question_source", "reason": F.try_element_at(reasons, own), "distinct_ids": F.when((own == "derived_downstream") & (F.col("ids") > 0), F.col("ids"))}).drop("ids")


def tolerant_parquet(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of Parquet files of which some may be torn. rows have the columns of the schema; faults are (file, row_group, fault).

    A row group is read by one task in batches. A file without a footer, and a row group that can't be decoded, are a fault each and
    the others are read. A column that a file lacks is null. A value that isn't of the column's type is null and a fault of its column. Both
    results come from one definition, and each reads the files once."""
    want = to_arrow_schema(schema)

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for batch in batches:
            for file in batch["path"]:
                try:
                    system, inner = _opened(file)
                    with system.open_input_file(inner) as f:
                        n = pq.ParquetFile(f).metadata.num_row_groups
                    yield pd.DataFrame({"file": [file] * n, "row_group": range(n), "fault": [None] * n}).astype({"row_group": "int32"})
                except Exception as e:
                    yield pd.DataFrame({"file": [file], "row_group": [-1], "fault": [f"{type(e).__name__}: {e}"[:200]]}).astype({"row_group": "int32"})

    def column(table: pa.RecordBatch, field: pa.Field, faults: list[str]) -> pa.Array:
        if field.name not in table.schema.names:
            return pa.nulls(table.num_rows, field.type)
        found = table.column(table.schema.names.index(field.name))
        try:
            return found.cast(field.type)
        except pa.ArrowInvalid:
            values, bad = [], 0
            for x in found:
                try:
                    values.append(pa.array([x.as_py()]).cast(field.type)[0].as_py())
                except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
                    values.append(None)
                    bad += 1
            faults.append(f"{bad} values of {field.name} are no {field.type}")
            return pa.array(values, field.type)
        except pa.ArrowNotImplementedError:
            faults.append(f"{field.name} is {found.type}, not {field.type}")
            return pa.nulls(table.num_rows, field.type)

    def told(file: str, group: int, fault: str) -> pa.RecordBatch:
        cells = [pa.array([file]), pa.array([group], pa.int32()), pa.array([fault]), *[pa.nulls(1, f.type) for f in want]]
        return pa.RecordBatch.from_arrays(cells, names=["file_", "row_group_", "fault_", *want.names])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for file, group, fault in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if fault is not None:
                    yield told(file, group, fault)
                    continue
                faults: list[str] = []
                try:
                    system, inner = _opened(file)
                    with system.open_input_file(inner) as f:
                        # a group counts whole or not at all; groups are what the writer made bounded
                        held = pq.ParquetFile(f).read_row_group(group).to_batches(max_chunksize=10_000)
                        for t in held:
                            cells = [column(t, field, faults) for field in want]
                            nothing = [pa.array([file] * t.num_rows), pa.array([group] * t.num_rows, pa.int32()), pa.nulls(t.num_rows, pa.string())]
                            yield pa.RecordBatch.from_arrays([*nothing, *cells], names=["file_", "row_group_", "fault_", *want.names])
                except Exception as e:
                    faults.append(f"{type(e).__name__}: {e}"[:200])
                for x in dict.fromkeys(faults):
                    yield told(file, group, x)

    listed = files(spark, [path], ("parquet",)).select("path").mapInPandas(groups, "file string, row_group int, fault string")
    kind = T.StructType([T.StructField("file_", T.StringType()), T.StructField("row_group_", T.IntegerType()), T.StructField("fault_", T.StringType()), *schema.fields])
    both = listed.repartition("file", "row_group").mapInArrow(rows, kind)
    return both.where("fault_ is null").drop("file_", "row_group_", "fault_"), both.where("fault_ is not null").select(F.col("file_").alias("file"), F.col("row_group_").alias("row_group"), F.col("fault_").alias("fault"))


FAMILIES = ["attack", "cve", "cwe"]


def ontology(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(entries, fingerprints) of a snapshot with a folder for each family: entries (family, normalized_id, status, name, description) and the sha256
    of each file. Of an id said again the last line counts; a missing status is `unknown`. A missing family, a line that is no
    object, and an entry of another family are errors. Deprecated, revoked and rejected entries stay: they exist."""
    kind = "family string, normalized_id string, status string, name string, description string"
    out = None
    for family in FAMILIES:
        path = f"{root}/{family}/ontology_index.jsonl"
        try:
            lines = numbered_lines(spark, path).where(F.trim("value") != "")
        except Exception as e:
            raise SourceError(f"no index of {family} at {path}") from e
        rows = lines.select("line", F.from_json("value", kind).alias("r"), F.json_object_keys("value").isNull().alias("bad"))
        wrong = rows.where(F.col("bad") | F.col("r.family").isNull() | (F.col("r.family") != family) | F.col("r.normalized_id").isNull()).orderBy("line").limit(1).collect()
        if wrong:
            raise SourceError(f"{path}, line {wrong[0]['line']}: no entry of {family}")
        last = rows.groupBy("r.normalized_id").agg(F.max_by("r", "line").alias("r"))
        own = last.select("r.family", "r.normalized_id", F.coalesce("r.status", F.lit("unknown")).alias("status"), "r.name", "r.description")
        out = own if out is None else out.unionByName(own)
    prints = spark.read.format("binaryFile").load([f"{root}/{f}/ontology_index.jsonl" for f in FAMILIES]).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("family"), F.sha2("content", 256).alias("sha256"))
    return out, prints


def with_status(df: DataFrame, family: str, identifier: str, entries: DataFrame) -> DataFrame:
    """df with `exists` and `ontology_status` of its identifiers; null ones don't exist."""
    named = entries.select(F.col("family").alias("f_"), F.col("normalized_id").alias("i_"), F.col("status").alias("ontology_status"))
    out = df.join(named, (F.col(family) == F.col("f_")) & (F.col(identifier) == F.col("i_")), "left")
    return out.withColumn("exists", F.col("i_").isNotNull()).drop("f_", "i_")
