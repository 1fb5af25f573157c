"""Vectors in .npy and .npz files as a data source, and their strict or tolerant join with records.

    spark.dataSource.register(TensorSource)
    spark.read.format("tensors").load("folder")               # file, key, row, vector, problem
    df.write.format("tensors").mode("append").save("folder")  # columns key and vector

Files are read in parts: an array of rows by byte ranges, an archive by groups of its members. Tasks hand Arrow batches of bounded
size to Spark. A write puts uniquely named files beside each other and ends with a manifest; a reader of a folder with a
manifest reads what it lists, so files of failed or repeated tasks are never seen."""

from __future__ import annotations

import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "file string, key string, row long, vector array<{type}>, problem string"
MANIFEST = "_manifest.json"
#: Members of an archive that together name and hold vectors.
KEYS, VECTORS = "keys", "vectors"


class TensorError(ValueError):
    """A tensor file or its join with records isn't as it must be."""


def _opened(path: str):
    """(file system, path in it) of a path with or without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[len("file:") :])


class _Seekable(io.RawIOBase):
    """An Arrow file as archives want it: a place before its start is an OSError."""

    def __init__(self, f):
        super().__init__()
        self.f, self.size = f, f.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.f.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        place = offset + (0 if whence == 0 else self.f.tell() if whence == 1 else self.size)
        if place < 0:
            raise OSError(f"no place {place} in a file")
        self.f.seek(place)
        return place

    def readinto(self, buffer) -> int:
        data = self.f.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, dtype, where data begin) of an open .npy stream."""
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
    if dtype.hasobject or dtype.kind not in "fiu":
        raise TensorError(f"no array of numbers: {dtype}")
    if fortran and len(shape) > 1:
        raise TensorError("stored by columns")
    return shape, dtype, f.tell()


def _members(z) -> list[tuple[str, int]]:
    """(name without suffix, bytes) of the arrays of an archive."""
    return sorted((i.filename.removesuffix(".npy"), i.file_size) for i in z.infolist() if i.filename.endswith(".npy"))


@dataclass
class Part(InputPartition):
    """What one task reads: rows of an array from a byte on, members of an archive, or nothing but a problem."""

    file: str
    start: int = 0
    rows: int = 0
    offset: int = 0
    width: int = 0
    dtype: str = ""
    members: list[str] = field(default_factory=list)
    problem: str = ""

    def __post_init__(self):
        super().__init__(self.file)


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


def _batch(kind, file: str, keys: list, rows: list, vectors: list[np.ndarray] | np.ndarray, problem: str | None = None) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(v) for v in vectors)])
    flat = np.concatenate([*vectors]) if len(vectors) else np.zeros(0)
    held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), kind)) if problem is None else pa.nulls(len(keys), pa.list_(kind))
    n = len(keys)
    return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(keys, pa.string()), pa.array(rows, pa.int64()), held, pa.array([problem] * n, pa.string())], names=["file", "key", "row", "vector", "problem"])


class TensorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.per_part = int(options.get("rowsperpartition", 65_536))
        self.per_batch = int(options.get("bytesperbatch", 8 << 20))
        self.member_bytes = int(options.get("bytesperpartition", 64 << 20))
        self.strict = options.get("mode", "FAILFAST").upper() != "PERMISSIVE"
        self.kind = pa.float64() if options.get("type", "float") == "double" else pa.float32()

    def _files(self) -> list[str]:
        """Paths of the data files, with scheme as given: what the manifest lists, else every .npy and .npz below."""
        from pyarrow import fs

        system, inner = _opened(self.path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.File:
            return [self.path]
        if info.type == fs.FileType.NotFound:
            raise TensorError(f"{self.path} is not there")
        manifest = posixpath.join(inner, MANIFEST)
        if system.get_file_info(manifest).type == fs.FileType.File:
            with system.open_input_stream(manifest) as f:
                return [f"{self.path.rstrip('/')}/{x['name']}" for x in json.loads(f.read())["files"]]
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        names = sorted(i.path[len(inner.rstrip("/")) + 1 :] for i in found if i.type == fs.FileType.File and i.extension in ("npy", "npz"))
        return [f"{self.path.rstrip('/')}/{n}" for n in names if not any(p[:1] in "._" for p in n.split("/"))]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for file in self._files():
            try:
                out += self._parts(file)
            except Exception as e:
                if self.strict:
                    raise TensorError(f"{file}: {e}") from e
                out.append(Part(file, problem=f"{type(e).__name__}: {e}"))
        return out or [Part("", problem="none")]

    def _parts(self, file: str) -> list[Part]:
        import zipfile

        system, inner = _opened(file)
        with system.open_input_file(inner) as f:
            if file.endswith(".npz"):
                with zipfile.ZipFile(_Seekable(f)) as z:
                    found = _members(z)
                if [n for n, _ in found] == [KEYS, VECTORS]:
                    return [Part(file, members=[KEYS, VECTORS])]
                out, names, held = [], [], 0
                for name, size in found:
                    if names and held + size > self.member_bytes:
                        out.append(Part(file, members=names))
                        names, held = [], 0
                    names.append(name)
                    held += size
                return [*out, Part(file, members=names)] if names else out
            shape, dtype, offset = _header(f)
            width = int(np.prod(shape[1:])) if len(shape) > 1 else (shape[0] if shape else 1)
            rows = shape[0] if len(shape) > 1 else 1
            if system.get_file_info(inner).size != offset + rows * width * dtype.itemsize:
                raise TensorError(f"{rows} rows of {width} don't fit the length of the file")
            return [Part(file, start, min(self.per_part, rows - start), offset + start * width * dtype.itemsize, width, dtype.str) for start in range(0, rows, self.per_part)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.problem:
            if partition.file:
                yield _batch(self.kind, partition.file, [None], [None], [np.zeros(0)], partition.problem)
            return
        try:
            yield from self._archive(partition) if partition.members else self._array(partition)
        except Exception as e:
            if self.strict:
                raise TensorError(f"{partition.file}: {e}") from e
            yield _batch(self.kind, partition.file, [None], [None], [np.zeros(0)], f"{type(e).__name__}: {e}")

    def _array(self, p: Part) -> Iterator[pa.RecordBatch]:
        system, inner = _opened(p.file)
        dtype = np.dtype(p.dtype)
        step = max(1, self.per_batch // max(1, p.width * dtype.itemsize))
        with system.open_input_file(inner) as f:
            f.seek(p.offset)
            for at in range(0, p.rows, step):
                n = min(step, p.rows - at)
                data = f.read(n * p.width * dtype.itemsize)
                vectors = np.frombuffer(data, dtype).reshape(n, p.width)
                places = range(p.start + at, p.start + at + n)
                yield _batch(self.kind, p.file, [str(i) for i in places], list(places), vectors)

    def _archive(self, p: Part) -> Iterator[pa.RecordBatch]:
        import zipfile

        system, inner = _opened(p.file)
        with system.open_input_file(inner) as f, zipfile.ZipFile(io.BufferedReader(_Seekable(f), 1 << 20)) as z:

            def array(name: str) -> np.ndarray:
                with z.open(name + ".npy") as m:
                    return np.lib.format.read_array(m, allow_pickle=False)

            if p.members == [KEYS, VECTORS]:
                keys, held = array(KEYS), array(VECTORS)
                if len(keys) != len(held):
                    raise TensorError(f"{len(keys)} keys for {len(held)} vectors")
                rows = ((str(k), i, v) for i, (k, v) in enumerate(zip(keys, held, strict=True)))
            else:
                rows = ((name, i, v.reshape(-1)) for name in p.members for i, v in enumerate(np.atleast_2d(array(name))))
            keys, places, vectors, size = [], [], [], 0
            for key, i, v in rows:
                if v.dtype.kind not in "fiu":
                    raise TensorError(f"{key}: no array of numbers: {v.dtype}")
                keys.append(key)
                places.append(i)
                vectors.append(v)
                size += v.nbytes
                if size >= self.per_batch:
                    yield _batch(self.kind, p.file, keys, places, vectors)
                    keys, places, vectors, size = [], [], [], 0
            if keys:
                yield _batch(self.kind, p.file, keys, places, vectors)


class TensorWriter(DataSourceArrowWriter):
    """Columns key and vector as archives of rows_per_file vectors at most. layout: `members` (one array a key), `matrix` (keys and
    vectors), or `npy` (an array of rows alone, whose keys are lost)."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.layout, self.per_file = options.get("layout", "matrix"), int(options.get("rowsperfile", 65_536))
        self.ragged = options.get("ragged", "false").lower() == "true"
        if self.layout not in ("members", "matrix", "npy") or self.ragged and self.layout != "members":
            raise TensorError(f"no such layout: {self.layout}{' with vectors of different lengths' * self.ragged}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, inner = _opened(self.path)
        system.create_dir(inner, recursive=True)
        task, done = TaskContext.get().partitionId(), []
        keys: list[str] = []
        seen: set[str] = set()
        vectors: list[np.ndarray] = []

        def flush():
            name = f"part-{task:05d}-{uuid.uuid4().hex}.{'npy' if self.layout == 'npy' else 'npz'}"
            with system.open_output_stream(posixpath.join(inner, name)) as f:
                if self.layout == "npy":
                    np.lib.format.write_array(f, np.stack(vectors), allow_pickle=False)
                elif self.layout == "matrix":
                    np.savez(f, **{KEYS: np.array(keys, dtype=np.str_), VECTORS: np.stack(vectors)})
                else:
                    if len(set(keys)) < len(keys):
                        raise TensorError("a key stands twice in one archive")
                    np.savez(f, **dict(zip(keys, vectors, strict=True)))
            done.append({"name": name, "rows": len(keys), "width": len(vectors[0])})

        for batch in iterator:
            for key, vector in zip(batch.column("key"), batch.column("vector"), strict=True):
                if not key.is_valid or not vector.is_valid:
                    raise TensorError("a key or a vector is null")
                v = vector.values.to_numpy(zero_copy_only=False)
                if vectors and not self.ragged and len(v) != len(vectors[0]):
                    raise TensorError(f"{key.as_py()}: {len(v)} values instead of {len(vectors[0])}")
                name = str(key.as_py())
                # members of an archive have different names: a key said again starts the next one
                if len(keys) >= self.per_file or self.layout == "members" and name in seen:
                    flush()
                    keys, vectors, seen = [], [], set()
                keys.append(name)
                seen.add(name)
                vectors.append(v)
        if keys:
            flush()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        """Check that all files have one width, then put the manifest in the place of the one before."""
        from pyarrow import fs

        system, inner = _opened(self.path)
        system.create_dir(inner, recursive=True)
        target = posixpath.join(inner, MANIFEST)
        before = []
        if system.get_file_info(target).type == fs.FileType.File:
            with system.open_input_stream(target) as f:
                before = json.loads(f.read())["files"]
        made = [x for m in messages if m is not None for x in m.files]
        listed = made if self.overwrite else before + made
        widths = sorted({x["width"] for x in listed})
        if len(widths) > 1 and not self.ragged:
            raise TensorError(f"vectors of {len(widths)} lengths: {widths[:4]}")
        staged = posixpath.join(inner, f".manifest-{uuid.uuid4().hex}")
        with system.open_output_stream(staged) as f:
            f.write(json.dumps({"files": sorted(listed, key=lambda x: x["name"])}).encode())
        system.move(staged, target)
        if self.overwrite:
            for x in before:
                system.delete_file(posixpath.join(inner, x["name"]))

    def abort(self, messages: list[Written | None]) -> None:
        system, inner = _opened(self.path)
        for m in messages:
            for x in m.files if m is not None else ():
                system.delete_file(posixpath.join(inner, x["name"]))


class TensorSource(DataSource):
    """Options: mode (FAILFAST, or PERMISSIVE, which gives a row with a problem instead of an error), type (float, double), rowsPerPartition,
    bytesPerPartition, bytesPerBatch; for writing layout, rowsPerFile, ragged."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA.format(type="double" if self.options.get("type") == "double" else "float")

    def reader(self, schema) -> TensorReader:
        return TensorReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> TensorWriter:
        return TensorWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def read(spark, path: str, **options) -> DataFrame:
    """(file, key, row, vector, problem) of the tensor files at a path."""
    spark.dataSource.register(TensorSource)
    return spark.read.format("tensors").options(**options).load(path)


def write(df: DataFrame, path: str, *, key: str, vector: str, mode: str = "overwrite", **options) -> None:
    """The vectors of df in tensor files, by key. Nothing of them is seen before all are written."""
    df.sparkSession.dataSource.register(TensorSource)
    df.select(F.col(key).cast("string").alias("key"), F.col(vector).alias("vector")).write.format("tensors").mode(mode).options(**options).save(path)


def _key(vectors: DataFrame, key: str) -> Column:
    """The key of vectors as text: the column of that name, or `key`, as tensor files have it."""
    return F.col(key if key in vectors.columns else "key").cast("string")


def vector_faults(records: DataFrame, vectors: DataFrame, key: str, *, vector: str = "vector", width: int | None = None) -> DataFrame:
    """(key, fault) of what keeps records and vectors from joining one to one: `missing` (a record without a vector), `doubled` (a
    key with several), `short` (a length other than `width`, by default the longest), `not finite` (a null, NaN or infinity).

    One aggregate by key; a key with a hundred thousand vectors is counted before it is shuffled. Vectors that no record asks for count for
    the width alone."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = vectors.where(_key(vectors, key).isNotNull() & v.isNotNull()).groupBy(_key(vectors, key).alias("k_")).agg(F.count(F.lit(1)).alias("n_"), F.min(F.size(v)).alias("least_"), F.max(F.size(v)).alias("most_"), F.min(sound).alias("sound_"))
    longest = F.lit(width).alias("w_") if width is not None else F.max("most_").alias("w_")
    asked = records.select(F.col(key).cast("string").alias("k_")).distinct()
    met = asked.join(held, asked["k_"].eqNullSafe(held["k_"]), "left").select(asked["k_"].alias("key"), "n_", "least_", "most_", "sound_").join(F.broadcast(held.agg(longest)), how="left")
    found = F.array_compact(F.array(
        F.when(F.col("n_").isNull(), "missing"), F.when(F.col("n_") > 1, "doubled"), F.when((F.col("least_") != F.col("w_")) | (F.col("most_") != F.col("w_")), "short"), F.when(~F.col("sound_"), "not finite"),
    ))
    return met.select("key", F.explode(found).alias("fault"))


def strict_vectors(records: DataFrame, vectors: DataFrame, key: str, vector: str = "vector", *, width: int | None = None) -> DataFrame:
    """records with their vectors, one each. A record without a vector, a key with two, or a vector of another length is an error."""
    bad = vector_faults(records, vectors, key, vector=vector, width=width).where("fault != 'not finite'").orderBy("key", "fault").limit(3).collect()
    if bad:
        raise TensorError("; ".join(f"{r['key']}: {r['fault']}" for r in bad))
    named = vectors.select(_key(vectors, key).alias("k_"), F.col(vector).alias(vector))
    return records.join(named, F.col(key).cast("string") == F.col("k_")).drop("k_")


def tolerant_vectors(records: DataFrame, vectors: DataFrame, key: str, *, vector: str = "vector", width: int | None = None) -> DataFrame:
    """records with `vector` and `warnings`: every record stays; one whose vector is missing or faulty has its faults and no vector. Of several
    vectors of a key none is taken."""
    faults = vector_faults(records, vectors, key, vector=vector, width=width).groupBy(F.col("key").alias("f_")).agg(F.array_sort(F.collect_list("fault")).alias("warnings"))
    good = vectors.select(_key(vectors, key).alias("k_"), F.col(vector).alias("vector")).join(faults, F.col("k_") == F.col("f_"), "left_anti")
    out = records.join(faults, F.col(key).cast("string").eqNullSafe(F.col("f_")), "left").join(good, F.col(key).cast("string") == F.col("k_"), "left")
    return out.drop("f_", "k_").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))


def arm(
    records: DataFrame, vectors: DataFrame, *, key: str, group: str, label: str, features: list[str], eligible: str = "eligible", role: str = "population_role", pilot: str = "pilot_smoke", allow_pilot: bool = False, sparse: tuple[str, ...] = (),
) -> DataFrame:
    """The eligible records with their vectors, or an error: pilot records where none are allowed, no eligible ones, a missing, doubled or
    short vector, labels of one class, a null group, a feature that never varies (those with a sparse prefix may)."""
    dense = [f for f in features if not f.startswith(sparse)] if sparse else list(features)
    value = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    kept = F.coalesce(F.col(eligible).cast("boolean"), F.lit(False))
    ends = [e for i, f in enumerate(dense) for e in (F.min(F.when(kept, value(f))).alias(f"l{i}"), F.max(F.when(kept, value(f))).alias(f"h{i}"))]
    r = records.agg(
        F.count_if(F.col(role) == pilot).alias("pilot"), F.count(F.lit(1)).alias("all"), F.count_if(kept).alias("kept"), F.count_if(kept & F.col(group).isNull()).alias("groupless"), F.count_distinct(F.when(kept, F.col(label).cast("int"))).alias("classes"), *ends,
    ).collect()[0]
    if r["pilot"] and not allow_pilot:
        raise TensorError(f"{r['pilot']} of {r['all']} records are {pilot}")
    if not r["kept"]:
        raise TensorError("no record is eligible")
    if r["classes"] != 2:
        raise TensorError(f"labels of {r['classes']} classes")
    if r["groupless"]:
        raise TensorError(f"{r['groupless']} records without a group")
    flat = [f for i, f in enumerate(dense) if r[f"l{i}"] == r[f"h{i}"]]
    if flat:
        raise TensorError(f"features that never vary: {', '.join(flat)}")
    return strict_vectors(records.where(kept), vectors, key)
