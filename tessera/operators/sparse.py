"""Logistic models over sparse features: text blocks of many terms beside dense blocks, by fold, with a nested choice of penalty.

Features depend on what a fold may see: vocabulary, idf and scaling of a design come from the rows outside its fold. Rows
are written and stored once for all designs, as counts of the terms that any of them has (`Shared`), or once for each design, as
indices and values. All models of all designs are then fitted together by L-BFGS: a step is one pass, in which each task adds up the
loss and the gradient of every model over the rows that the model takes; gradients are cut into stretches, and Spark sums each
stretch over tasks, of which a pass has a few for each core, before it comes to the driver. The driver so holds what models are,
terms by models, whatever the number of rows or tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import drop_stored, stored
from .ml import word_terms  # noqa: F401
from .partial_sums import COLUMNS, PARTS, added, cut, whole
from .stats import auroc
from .terms import DEALT, counted, in_buckets, lengths, merged, ordered, places, slices, words

#: Pairs of steps and gradient differences that L-BFGS remembers.
MEMORY = 8

#: Characters of the texts that a task cuts, and of those whose terms make up a bucket; no tasks are made for fewer than LEAST.
BUCKET, LEAST = 4 << 20, 1 << 18

#: Bytes of models that the driver may hold.
MOST_BYTES = 2 << 30

DESIGN = "design int, id long, y double, fold int, inner int, indices array<int>, vals array<double>"

#: Rows that all designs share, arrays as bytes, which Spark hands to tasks of Python as they are: the inner fold in each design (-1: none), the
#: number of counts that each part of the text has, the weight of each count and how many terms have it, the places of these terms, what
#: each part is scaled by in each design, and the values of blocks as they are.
COUNTS = "id long, y double, fold int, inner binary, runs binary, weights binary, many binary, indices binary, scales binary, dense binary"


class NotConverged(RuntimeError):
    """Models that are still moving when the rounds are over."""


@dataclass
class Rung:
    """What a model may read: a text column, and blocks of columns, each scaled by itself."""

    text: str | None = None
    blocks: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class SparseFit:
    """A model: its design, the inner fold that it leaves out (None: it takes every row of its design but the test rows), its penalty |w|^2 / (2 c),
    and the stretches of features that it reads (None: all)."""

    design: int
    without: int | None
    c: float
    reads: tuple[tuple[int, int], ...] | None = None

    def mask(self, width: int) -> np.ndarray:
        """1 for features that it reads and the constant, 0 for others."""
        out = np.full(width + 1, 1.0 if self.reads is None else 0.0)
        for start, end in self.reads or ():
            out[start:end] = 1.0
        out[-1] = 1.0
        return out


@dataclass
class Shared:
    """Rows of COUNTS, and what makes them rows of a design: the place of each of its terms and its idf, the mean and the spread of each
    value of its blocks, and whether it has inner folds."""

    rows: DataFrame
    parts: int
    width: int
    places: list[np.ndarray]
    idf: list[np.ndarray]
    mean: list[np.ndarray]
    spread: list[np.ndarray]
    inner: list[bool]


def vocabularies(df: DataFrame, terms: Column, fold: str, k: int, *, unit: str = "term", least_docs: int = 2, most_terms: int = 50_000, buckets: int = 64) -> list[dict[str, tuple[int, float]]]:
    """For each fold the terms of the other folds: term -> (place, idf). Terms of fewer than least_docs rows are left out; of the others the
    most_terms with the most occurrences stay, ties by term. `terms` are a row's terms, or the words that they are made of where `unit` is "word" or "char".

    Terms are counted once for all folds, by numbers within a task's batches, and dealt to buckets, of which each sends what may be among the most:
    a bucket has all counts of its terms. What comes to the driver is bounded by k * most_terms."""
    rows = df.select(F.col(fold).cast("int").alias("f"), terms.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", unit):
                f = part.column("f").fill_null(k).to_numpy(zero_copy_only=False)
                f = np.where((f < 0) | (f > k), k, f)  # rows of other folds are training rows of all
                for found, row, term, tf in counted(part.column("t"), unit):
                    cell = term * (k + 1) + f[row]
                    sums = [np.bincount(cell, w, len(found) * (k + 1)).astype(np.int64).reshape(-1, k + 1) for w in (None, tf)]
                    if len(found):
                        yield in_buckets(found, [x[:, g] for x in sums for g in range(k + 1)], buckets)

    def most(table: pa.Table) -> pa.Table:
        found = merged(table.column("data"))
        sums = np.stack([found.column(c).to_numpy() for c in found.column_names[1:]], axis=1).reshape(-1, 2, k + 1)
        outside = sums.sum(axis=2, keepdims=True) - sums[:, :, :k]  # rows and occurrences outside each fold
        kept = np.zeros(len(found), bool)
        for f in range(k):
            own = np.flatnonzero(outside[:, 0, f] >= least_docs)
            if len(own) > most_terms:
                few = pa.table([found.column("term").take(pa.array(own)), pa.array(outside[own, 1, f])], names=["term", "tf"])
                own = own[pc.sort_indices(few, [("tf", "descending"), ("term", "ascending")]).to_numpy()[:most_terms]]
            kept[own] = True
        at = np.flatnonzero(kept)
        return pa.table([found.column("term").take(pa.array(at)), *[pa.array(outside[at, o, f]) for f in range(k) for o in range(2)]], names=["term", *[f"{o}{f}" for f in range(k) for o in ("df", "tf")]])

    seen = rows.mapInArrow(run, DEALT).groupBy("bucket").applyInArrow(most, "term string, " + ", ".join(f"{o}{f} long" for f in range(k) for o in ("df", "tf")))
    kept = stored(seen, "terms")
    rows_of = {r["f"]: r["n"] for r in rows.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
    out: list[dict[str, tuple[int, float]]] = []
    for f in range(k):
        train = sum(n for g, n in rows_of.items() if g != f)
        best = kept.where(F.col(f"df{f}") >= least_docs).select("term", F.col(f"df{f}").alias("df"), F.col(f"tf{f}").alias("tf")).orderBy(F.desc("tf"), "term").limit(most_terms).collect()
        # in the order of Spark's strings, which is that of their bytes
        out.append({r["term"]: (i, float(np.log((1 + train) / (1 + r["df"])) + 1)) for i, r in enumerate(sorted(best, key=lambda r: r["term"].encode()))})
    drop_stored(kept)
    return out


def _scales(df: DataFrame, columns: list[str], fold: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each column over the rows outside each fold (k by columns), in two passes. A constant column has deviation 1."""

    def sums(shift: np.ndarray | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((k, len(columns) + 1))
            for batch in batches:
                x, f = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, len(columns))), batch["f"].to_numpy()
                for g in range(k):
                    own = x[f == g]
                    total[g, :-1] += own.sum(axis=0) if shift is None else ((own - shift) ** 2).sum(axis=0)
                    total[g, -1] += len(own)
            yield pd.DataFrame([c for g in range(k) for c in cut(g, total[g])], columns=COLUMNS)

        return run

    rows = df.select(F.col(fold).cast("int").alias("f"), F.array(*[_dense(c) for c in columns]).alias("x"))
    first = added(rows.mapInPandas(sums(None), PARTS))
    per = np.array([whole(first, g, len(columns) + 1) for g in range(k)])
    centre = per[:, :-1].sum(axis=0) / max(per[:, -1].sum(), 1.0)
    second = added(rows.mapInPandas(sums(centre), PARTS))
    spread = np.array([whole(second, g, len(columns) + 1)[:-1] for g in range(k)])
    n = np.maximum(per[:, -1].sum() - per[:, -1], 1.0)[:, None]
    mean = (per[:, :-1].sum(axis=0) - per[:, :-1]) / n
    # squares around the common centre, moved to the mean of each design
    deviation = np.sqrt(np.maximum((spread.sum(axis=0) - spread) / n - (mean - centre) ** 2, 0.0))
    return mean, np.where(deviation < 1e-12, 1.0, deviation)


def _dense(c: str) -> Column:
    """The value as a double, 0 where it is null or not finite."""
    v = F.col(c).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def designs(df: DataFrame, rung: Rung, *, id: str, label: str, fold: str, inner: str | None, k: int, least_docs: int = 2, most_terms: int = 50_000, packed: bool = False) -> tuple[DataFrame | Shared, list[dict[str, int]]]:
    """(rows, widths): every row once for each fold's design, stored, and for each design the number of features by block.

    A text is the tf-idf of its words and word pairs and that of its runs of three to five characters, each of length 1,
    together of length 1. A dense block is z-scores over the square root of its width. `inner` is an array of the
    row's inner fold in each design. Rows of null label or fold take no part. With `packed`, every row is stored once for all designs (Shared)."""
    if rung.text is None and not rung.blocks:
        raise ValueError("a rung has a text or a block")
    spark = df.sparkSession
    # rows are dealt while they are small, before they are cut into terms and written out for each design
    df = df.where(F.col(label).isNotNull() & F.col(fold).isNotNull())
    size = 0 if rung.text is None else df.agg(F.sum(F.length(rung.text))).collect()[0][0] or 0
    # several tasks for each core, else some wait for the last; more of them where texts are many
    tasks = max(size // BUCKET, min(size // LEAST, 4 * spark.sparkContext.defaultParallelism))
    df = df.repartition(tasks, F.col(id)) if tasks else df.repartition(F.col(id))
    kinds, books = {}, []
    if rung.text is not None:
        kinds = {"words": "word", "chars": "char"}
        buckets = max(64, size // BUCKET)
        for unit in kinds.values():
            books.append(vocabularies(df, words(F.col(rung.text), unit), fold, k, unit=unit, least_docs=least_docs, most_terms=most_terms, buckets=buckets))
    scales = {name: _scales(df, columns, fold, k) for name, columns in rung.blocks.items()}
    widths = [{**{n: len(b[f]) for n, b in zip(kinds, books, strict=True)}, **{n: len(c) for n, c in rung.blocks.items()}} for f in range(k)]
    columns = [F.col(id).cast("long").alias("id"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"), (F.col(inner) if inner else F.lit(None)).cast("array<int>").alias("inner")]
    columns += [words(F.col(rung.text), unit).alias(n) for n, unit in kinds.items()]
    if packed:
        columns.append(F.array(*[_dense(c) for cs in rung.blocks.values() for c in cs]).cast("array<double>").alias("dense"))
        return _shared(df.select(*columns), kinds, books, list(scales.values()), k), widths
    columns += [F.array(*[_dense(c) for c in cs]).alias(f"b_{n}") for n, cs in rung.blocks.items()]
    shared = spark.sparkContext.broadcast(([[(list(own), np.array([idf for _, idf in own.values()])) for own in book] for book in books], scales))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, scales = shared.value
        known = [[(pa.array(terms, pa.string()), idf) for terms, idf in book] for book in books]
        for whole_batch in batches:
            for batch in slices(whole_batch, "chars", "char") if kinds else [whole_batch]:
                n = batch.num_rows
                seen = [list(counted(batch.column(c), unit)) for c, unit in kinds.items()]
                for f in range(k):
                    found, offset = [], 0
                    for book, parts in zip(known, seen, strict=True):
                        terms, idf = book[f]
                        own = [(row, places(names, terms)[term], tf) for names, row, term, tf in parts]
                        row, at, tf = (np.concatenate(x) for x in zip(*own, strict=True))
                        row, at, tf = row[at >= 0], at[at >= 0], tf[at >= 0]
                        value = (1 + np.log(tf)) * idf[at]
                        found.append((row, at + offset, value / lengths(value, row, n)[row]))
                        offset += len(terms)
                    if found:
                        length = np.sqrt(sum(lengths(value, row, n) ** 2 for row, _, value in found))
                        found = [(row, at, value / length[row]) for row, at, value in found]
                    for name, (mean, deviation) in scales.items():
                        x = batch.column(f"b_{name}").flatten().to_numpy(zero_copy_only=False).reshape(n, len(mean[f]))
                        x = (x - mean[f]) / deviation[f] / np.sqrt(len(mean[f]))
                        found.append((np.repeat(np.arange(n), len(mean[f])), np.tile(np.arange(len(mean[f])) + offset, n), x.reshape(-1)))
                        offset += len(mean[f])
                    row, at, value = (np.concatenate(x) for x in zip(*found, strict=True))
                    order = np.argsort(row * (offset + 1) + at)
                    start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
                    inner = batch.column("inner")
                    inner = np.full(n, -1) if inner.null_count == n else pc.list_element(inner, f).fill_null(-1).to_numpy(zero_copy_only=False)
                    cells = [_cells(start, x[order].astype(t)) for x, t in ((at, np.int32), (value, np.float64))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, f), pa.int32()), *[batch.column(c) for c in ("id", "y", "fold")], pa.array(inner, pa.int32()), *cells], names=["design", "id", "y", "fold", "inner", "indices", "vals"])

    return stored(df.select(*columns).mapInArrow(run, DESIGN), "designs"), widths


def _place_type(width: int) -> type:
    """What holds the places of terms."""
    return np.uint16 if width <= 1 << 16 else np.int32


def _shared(rows: DataFrame, kinds: dict[str, str], books: list[list[dict[str, tuple[int, float]]]], scales: list[tuple[np.ndarray, np.ndarray]], k: int) -> Shared:
    """Rows of words and values, with their terms counted once for all designs, stored."""
    every = [sorted({t for own in book for t in own}, key=str.encode) for book in books]
    offset = [0, *np.cumsum([len(terms) for terms in every]).tolist()]
    number = [{t: i + start for i, t in enumerate(terms)} for terms, start in zip(every, offset, strict=False)]
    none = [np.zeros(0)]
    at = [np.concatenate([np.array([n[t] for t in book[f]], np.int64) for n, book in zip(number, books, strict=True)] or [np.zeros(0, np.int64)]) for f in range(k)]
    idf = [np.concatenate([np.array([i for _, i in book[f].values()], np.float64) for book in books] or none) for f in range(k)]
    mean = [np.concatenate([m[f] for m, _ in scales] or none) for f in range(k)]
    spread = [np.concatenate([d[f] * np.sqrt(len(d[f])) for _, d in scales] or none) for f in range(k)]
    squares = np.zeros((k, offset[-1]))
    for f in range(k):
        squares[f, at[f]] = idf[f] ** 2
    parts = len(kinds)
    shared = rows.sparkSession.sparkContext.broadcast((every, squares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, squares = shared.value
        known = [pa.array(terms, pa.string()) for terms in every]
        for whole_batch in batches:
            for batch in slices(whole_batch, "chars", "char") if parts else [whole_batch]:
                n, found = batch.num_rows, []
                for p, (name, unit) in enumerate(kinds.items()):
                    for names, row, term, tf in counted(batch.column(name), unit):
                        place = places(names, known[p])[term]
                        there = place >= 0
                        found.append((row[there] * parts + p, tf[there], place[there] + offset[p]))
                part, tf, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
                part, tf, place = _sorted(part, tf, place)
                weight = 1 + np.log(tf)
                length = np.stack([np.sqrt(np.bincount(part, weight * weight * s.take(place), n * parts)) for s in squares], axis=1).reshape(n, parts, k)
                # each part of length 1, those that a row has together of length 1
                together = np.sqrt((length > 0).sum(axis=1, keepdims=True))
                scale = np.divide(1.0, length * together, out=np.zeros(length.shape), where=length > 0)
                first = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(tf, prepend=-1) != 0))  # a run of terms of one count
                inner = batch.column("inner")
                inner = np.full((n, k), -1) if inner.null_count == n else np.stack([pc.list_element(inner, f).fill_null(-1).to_numpy(zero_copy_only=False) for f in range(k)], axis=1)
                dense = batch.column("dense").flatten().to_numpy(zero_copy_only=False)
                many = lambda of: np.append(0, np.cumsum(np.bincount(of // max(parts, 1), minlength=n)))
                even = lambda x: np.arange(n + 1) * (x.size // max(n, 1))
                runs, own = np.bincount(part[first], minlength=n * parts), many(part[first])
                cells = [
                    (even(inner), inner, np.int32), (even(runs), runs, np.int32), (own, weight[first], np.float64), (own, np.diff(first, append=len(part)), np.int32), (many(part), place, _place_type(offset[-1])),
                    (even(scale), scale, np.float64), (even(dense), dense, np.float64),
                ]
                packed = [_cells(start, np.ascontiguousarray(x, t).reshape(-1), True) for start, x, t in cells]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "y", "fold")], *packed], names=["id", "y", "fold", "inner", "runs", "weights", "many", "indices", "scales", "dense"])

    table = stored(rows.mapInArrow(run, COUNTS), "designs")
    has = rows.agg(*[F.max(F.get("inner", F.lit(f))).alias(f"i{f}") for f in range(k)]).collect()[0]
    return Shared(table, parts, offset[-1], at, idf, mean, spread, [h is not None and h >= 0 for h in has])


def _sorted(*keys: np.ndarray) -> list[np.ndarray]:
    """The arrays ordered by the first, then the next, and so on."""
    bounds = [int(x.max(initial=0)) + 1 for x in keys]
    both = ordered(*zip(keys, bounds, strict=True))
    if both is None:
        order = np.lexsort(keys[::-1])
        return [x[order] for x in keys]
    out = []
    for bound in reversed(bounds):
        width = max(bound - 1, 1).bit_length()
        out.append(both & ((1 << width) - 1))
        both = both >> width
    return out[::-1]


def _cells(start: np.ndarray, values: np.ndarray, packed: bool = False) -> pa.Array:
    """Values cut at `start` into lists of them, or into their bytes."""
    if not packed:
        return pa.ListArray.from_arrays(pa.array(start), pa.array(values))
    return pa.Array.from_buffers(pa.binary(), len(start) - 1, [None, pa.py_buffer((start * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _values(cells: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The number of values of each row, and the values."""
    if not pa.types.is_binary(cells.type):
        return pc.list_value_length(cells).to_numpy(zero_copy_only=False), cells.flatten().to_numpy(zero_copy_only=False)
    size, (_, ends, data) = np.dtype(kind).itemsize, cells.buffers()
    ends = np.frombuffer(ends, np.int32, len(cells) + 1, cells.offset * 4)
    return np.diff(ends) // size, np.frombuffer(data, kind, (ends[-1] - ends[0]) // size, ends[0]) if data is not None else np.zeros(0, kind)


#: Values of the rows that are worked on at once: what is made of them stays in a core's cache.
STEP = 1 << 18

#: The same of rows that all designs share, of which a model takes a part.
SHARED_STEP = 1 << 19


class Rows:
    """Rows of one design, in compressed form; models have a constant after their last feature."""

    def __init__(self, columns: list[np.ndarray], sizes: np.ndarray, at: np.ndarray, value: np.ndarray):
        self.id, self.y, self.fold, self.inner = columns
        self.sizes, self.at, self.value = sizes, at.astype(np.intp), value
        self.filled = sizes > 0
        self.start = (np.cumsum(sizes) - sizes)[self.filled]

    def times(self, weights: np.ndarray) -> np.ndarray:
        """The value of each row for a model's weights."""
        out = np.full(len(self.sizes), weights[-1])
        if len(self.start):
            out[self.filled] += np.add.reduceat(self.value * weights.take(self.at), self.start)
        return out

    def back(self, residuals: np.ndarray, width: int) -> np.ndarray:
        """The sum of each feature and of the constant, for residuals of rows."""
        return np.append(np.bincount(self.at, self.value * np.repeat(residuals, self.sizes), width), residuals.sum())


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, Rows]]:
    """The rows of each design of a batch, about STEP values at a time, and one row at least."""
    for d in sorted(pc.unique(batch.column("design")).to_pylist()):
        own = batch.filter(pc.equal(batch.column("design"), d))
        columns = [own.column(c).to_numpy(zero_copy_only=False) for c in ("id", "y", "fold", "inner")]
        (sizes, at), (_, value) = _values(own.column("indices"), np.int32), _values(own.column("vals"), np.float64)
        ends = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            before = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(ends, before + STEP, "right")), first + 1)
            yield d, Rows([c[first:last] for c in columns], sizes[first:last], at[before : ends[last - 1]], value[before : ends[last - 1]])
            first = last


class Counts:
    """Rows that all designs share, in compressed form."""

    def __init__(self, batch: pa.RecordBatch, parts: int, width: int, k: int, columns: int):
        n = batch.num_rows
        flat = {c: _values(batch.column(c), kind)[1] for c, kind in (("inner", np.int32), ("runs", np.int32), ("weights", np.float64), ("many", np.int32), ("indices", _place_type(width)), ("scales", np.float64), ("dense", np.float64))}
        self.id, self.y, self.fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "y", "fold"))
        self.inner, self.runs = flat["inner"].reshape(n, k), flat["runs"].reshape(n, parts)
        self.scales, self.dense = flat["scales"].reshape(n, parts, k), flat["dense"].reshape(n, columns)
        self.weights, self.many, self.at = flat["weights"], flat["many"], flat["indices"]
        #: where the runs and the terms of each row start, and those of the last end
        self.run = np.append(0, np.cumsum(self.runs.sum(axis=1, dtype=np.int64)))
        self.term = np.append(0, np.cumsum(self.many, dtype=np.int64))[self.run]

    def used(self, design: int, fits: list[SparseFit]) -> Iterator[tuple[np.ndarray, list[int]]]:
        """Rows that the design's models take, and which models do: those of each inner fold that a model leaves out, and all others."""
        left = self.fold != design
        for g in sorted({f.without for f in fits} - {None}):
            own = left & (self.inner[:, design] == g)
            left &= ~own
            yield np.flatnonzero(own), [i for i, f in enumerate(fits) if f.without != g]
        yield np.flatnonzero(left), list(range(len(fits)))

    def left_out(self, design: int, without: int | None) -> np.ndarray:
        return np.flatnonzero(self.fold == design if without is None else (self.fold != design) & (self.inner[:, design] == without))

    def of(self, design: int, rows: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> Own:
        def taken(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            return np.concatenate([x[:0], *[x[a:b] for a, b in zip(bounds[rows].tolist(), bounds[rows + 1].tolist(), strict=True)]])

        return Own(self.y[rows], self.runs[rows].reshape(-1), taken(self.weights, self.run), taken(self.many, self.run), taken(self.at, self.term).astype(np.intp), self.scales[rows, :, design], (self.dense[rows] - mean) / spread)


class Own:
    """Rows of a design: the runs of terms of one count that their parts have, what each part is scaled by, and the values of their
    blocks. A model has weights of all terms, of these values, and a constant."""

    def __init__(self, y: np.ndarray, runs: np.ndarray, weights: np.ndarray, many: np.ndarray, at: np.ndarray, scales: np.ndarray, dense: np.ndarray):
        self.y, self.runs, self.weights, self.many, self.at, self.scales, self.dense = y, runs, weights, many, at, scales, dense
        self.start = np.cumsum(many) - many
        self.filled = runs > 0
        self.first = (np.cumsum(runs) - runs)[self.filled]

    def times(self, weights: np.ndarray) -> np.ndarray:
        terms, text = len(weights) - 1 - self.dense.shape[1], np.zeros(self.scales.shape)
        if len(self.first):
            text.reshape(-1)[self.filled] = np.add.reduceat(np.add.reduceat(weights.take(self.at), self.start) * self.weights, self.first)
        return (text * self.scales).sum(axis=1) + self.dense @ weights[terms:-1] + weights[-1]

    def add(self, total: np.ndarray, residuals: np.ndarray) -> None:
        """Add to the sums of terms, values, and the constant, for residuals of rows."""
        n = self.dense.shape[1]
        terms = len(total) - 2 - n
        if len(self.first):
            run = np.repeat((residuals[:, None] * self.scales).reshape(-1), self.runs) * self.weights
            total[:terms] += np.bincount(self.at, np.repeat(run, self.many), terms)
        total[terms : terms + n] += residuals @ self.dense
        total[terms + n] += residuals.sum()


def _counts(batch: pa.RecordBatch, parts: int, width: int, k: int, columns: int) -> Iterator[Counts]:
    """The rows of a batch, about SHARED_STEP terms at a time, and one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column("indices")).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(_place_type(width)).itemsize)
    first = 0
    while first < len(ends):
        last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SHARED_STEP, "right")), first + 1)
        yield Counts(batch.slice(first, last - first), parts, width, k, columns)
        first = last


def _by_design(fits: list[SparseFit], which: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i in which:
        out.setdefault(fits[i].design, []).append(i)
    return out


def _for_all(shared: Shared, design: int, weights: np.ndarray) -> np.ndarray:
    """A model's weights, in the terms that all designs share."""
    n, out = len(shared.idf[design]), np.zeros(shared.width)
    out[shared.places[design]] = weights[:n] * shared.idf[design]
    return np.append(out, weights[n:])


def _few(rows: DataFrame) -> DataFrame:
    """The rows in two tasks for each core at most, since each task sends what all models are."""
    return rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)


def _passed_shared(shared: Shared, fits: list[SparseFit], points: list[np.ndarray | None]) -> list[tuple[float, np.ndarray] | None]:
    """_passed for rows that all designs share: a model works on no rows but those that it takes."""
    asked = _by_design(fits, [i for i, p in enumerate(points) if p is not None])
    spark, parts, terms, mean, spread = shared.rows.sparkSession, shared.parts, shared.width, shared.mean, shared.spread
    sent = spark.sparkContext.broadcast([None if p is None else _for_all(shared, f.design, p) for f, p in zip(fits, points, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in _counts(batch, parts, terms, len(mean), len(mean[0])):
                for d, which in asked.items():
                    for rows, models in x.used(d, [fits[i] for i in which]):
                        if not len(rows) or not models:
                            continue
                        own = x.of(d, rows, mean[d], spread[d])
                        for i in (which[m] for m in models):
                            z = own.times(sent.value[i])
                            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                            if i not in total:
                                total[i] = np.zeros(terms + len(mean[d]) + 2)
                            own.add(total[i], p - own.y)
                            total[i][-1] += (np.logaddexp(0, z) - own.y * z).sum()
        for i, g in total.items():
            slot, stretch, data = zip(*cut(i, g), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(stretch, pa.int32()), pa.array(data, pa.binary())], names=COLUMNS)

    found = added(_few(shared.rows).mapInArrow(run, PARTS))
    sent.unpersist()
    out: list[tuple[float, np.ndarray] | None] = [None] * len(fits)
    for d, which in asked.items():
        for i in which:
            both = whole(found, i, terms + len(mean[d]) + 2)
            out[i] = (float(both[-1]), np.append(both[:terms][shared.places[d]] * shared.idf[d], both[terms:-1]))
    return out


def _passed(rows: DataFrame | Shared, widths: list[int], fits: list[SparseFit], points: list[np.ndarray | None]) -> list[tuple[float, np.ndarray] | None]:
    """(loss, gradient) of the data at each model's point; models without a point are left out."""
    if isinstance(rows, Shared):
        return _passed_shared(rows, fits, points)
    asked = _by_design(fits, [i for i, p in enumerate(points) if p is not None])
    shared = rows.sparkSession.sparkContext.broadcast(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, x in _rows(batch):
                for i in asked.get(d, []):
                    z = x.times(shared.value[i])
                    use = (x.fold != d) & (x.inner != (fits[i].without if fits[i].without is not None else -2))
                    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    both = np.append(x.back((p - x.y) * use, widths[d]), ((np.logaddexp(0, z) - x.y * z) * use).sum())
                    total[i] = total[i] + both if i in total else both
        for i, g in total.items():
            slot, stretch, data = zip(*cut(i, g), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(stretch, pa.int32()), pa.array(data, pa.binary())], names=COLUMNS)

    # designs that no model asks about aren't read
    found = added(rows.where(F.col("design").isin(list(asked))).mapInArrow(run, PARTS))
    shared.unpersist()
    out: list[tuple[float, np.ndarray] | None] = [None] * len(fits)
    for d, which in asked.items():
        for i in which:
            both = whole(found, i, widths[d] + 2)
            out[i] = (float(both[-1]), both[:-1])
    return out


class Descent:
    """L-BFGS of one model: asks for loss and gradient at `point`, and is told them."""

    def __init__(self, width: int, c: float, tolerance: float):
        self.c, self.tolerance = c, tolerance
        self.at = self.point = np.zeros(width + 1)
        self.loss, self.gradient, self.first, self.pairs, self.step, self.done = None, None, None, [], 1.0, False

    def told(self, loss: float, gradient: np.ndarray) -> None:
        loss, gradient = loss * self.c + 0.5 * float(self.point @ self.point), gradient * self.c + self.point
        if self.loss is None:
            self.first = max(1.0, float(np.abs(gradient).max()))
        elif not loss <= self.loss + 1e-4 * self.step * float(self.gradient @ self.way) + 1e-12 * abs(self.loss):
            self.step *= 0.5  # too far
            self.point = self.at + self.step * self.way
            self.done = self.step < 1e-10
            return
        else:
            s, y = self.point - self.at, gradient - self.gradient
            if s @ y > 1e-12 * float(y @ y):
                self.pairs = [*self.pairs[-MEMORY + 1 :], (s, y, 1 / float(s @ y))]
        self.at, self.loss, self.gradient = self.point, loss, gradient
        if np.abs(gradient).max() <= self.tolerance * self.first:
            self.done = True
            return
        q, steps = gradient.copy(), []
        for s, y, r in reversed(self.pairs):
            a = r * float(s @ q)
            steps.append(a)
            q -= a * y
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y, r), a in zip(self.pairs, reversed(steps), strict=True):
            q += s * (a - r * float(y @ q))
        self.way = -q
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / float(np.abs(gradient).sum()))
        self.point = self.at + self.step * self.way


def _need(widths: list[int], fits: list[SparseFit]) -> int:
    """Bytes that the driver holds for models."""
    return sum((widths[f.design] + 1) * 8 * (2 * MEMORY + 4) for f in fits)


def fitted(rows: DataFrame | Shared, widths: list[int], fits: list[SparseFit], *, rounds: int = 200, tolerance: float = 1e-5, most_bytes: int = MOST_BYTES) -> list[np.ndarray]:
    """Weights of each model, the constant last (it is penalised like the others).

    The largest component of a gradient has to fall to `tolerance` of what it was at 0 (of 1 at least), or NotConverged
    names the models. The driver holds 2 * MEMORY + 4 vectors a model; models that would need more than most_bytes are refused."""
    need = _need(widths, fits)
    if need > most_bytes:
        raise ValueError(f"{len(fits)} models need {need} bytes on the driver: fit fewer at once, or lower most_terms")
    models = [Descent(widths[f.design], f.c, tolerance) for f in fits]
    for _ in range(rounds):
        for f, m, found in zip(fits, models, _passed(rows, widths, fits, [None if m.done else m.point for m in models]), strict=True):
            if found is not None:
                # a weight whose gradient is always 0 stays 0
                m.told(found[0], found[1] * f.mask(widths[f.design]))
        if all(m.done for m in models):
            return [m.at for m in models]
    raise NotConverged(f"{sum(not m.done for m in models)} of {len(models)} models after {rounds} rounds: {[f for f, m in zip(fits, models, strict=True) if not m.done][:3]}")


VALUES = "model int, id long, y double, value double"


def scored(rows: DataFrame | Shared, widths: list[int], fits: list[SparseFit], weights: list[np.ndarray]) -> DataFrame:
    """(model, id, y, value): the value of each model for the rows that it left out: those of its inner fold, or of the design's own fold."""
    if isinstance(rows, Shared):
        return _scored_shared(rows, fits, weights)
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, x in _rows(batch):
                for i, fit in enumerate(fits):
                    if fit.design != d:
                        continue
                    use = (x.fold == d) if fit.without is None else (x.fold != d) & (x.inner == fit.without)
                    if use.any():
                        value = x.times(shared.value[i])[use]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), i), pa.int32()), *[pa.array(v) for v in (x.id[use], x.y[use], value)]], names=["model", "id", "y", "value"])

    return rows.mapInArrow(run, VALUES)


def _scored_shared(shared: Shared, fits: list[SparseFit], weights: list[np.ndarray]) -> DataFrame:
    asked: dict[tuple[int, int | None], list[int]] = {}
    for i, f in enumerate(fits):
        asked.setdefault((f.design, f.without), []).append(i)
    parts, width, mean, spread = shared.parts, shared.width, shared.mean, shared.spread
    sent = shared.rows.sparkSession.sparkContext.broadcast([_for_all(shared, f.design, w) for f, w in zip(fits, weights, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _counts(batch, parts, width, len(mean), len(mean[0])):
                for (d, without), which in asked.items():
                    rows = x.left_out(d, without)
                    if not len(rows):
                        continue
                    own = x.of(d, rows, mean[d], spread[d])
                    for i in which:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), i), pa.int32()), *[pa.array(v) for v in (x.id[rows], own.y, own.times(sent.value[i]))]], names=["model", "id", "y", "value"])

    return shared.rows.mapInArrow(run, VALUES)


def chosen_penalties(rows: DataFrame | Shared, widths: list[int], grid: list[float], inner_k: int, **options) -> list[float]:
    """For each design the penalty of the grid with the best mean AUROC over its inner folds (those of one class are passed over), the first
    of equals; 1.0 where no inner fold has both classes, or where there are none."""
    return _penalties(rows, widths, [None], grid, inner_k, **options)[0]


#: What the models of a rung read of each design; None: everything.
Reads = list[tuple[tuple[int, int], ...]] | None


def _penalties(rows: DataFrame | Shared, widths: list[int], rungs: list[Reads], grid: list[float], inner_k: int, **options) -> list[list[float]]:
    """chosen_penalties of several rungs over the same rows, whose models are fitted together."""
    out = [[1.0] * len(widths) for _ in rungs]
    if not inner_k:
        there = set()
    elif isinstance(rows, Shared):
        there = {d for d, has in enumerate(rows.inner) if has}
    else:
        there = {r["design"] for r in rows.where("inner >= 0").select("design").distinct().collect()}
    keys = [(n, d, c) for n in range(len(rungs)) for d in range(len(widths)) if d in there for c in grid for _ in range(inner_k)]
    fits = [SparseFit(d, g, c, reads and reads[d]) for reads in rungs for d in range(len(widths)) if d in there for c in grid for g in range(inner_k)]
    if not fits:
        return out
    weights = fitted(rows, widths, fits, **options)
    found = {r["model"]: r["auroc"] for r in auroc(scored(rows, widths, fits, weights), "value", "y", ["model"]).collect() if r["auroc"] is not None}
    for n in range(len(rungs)):
        for d in range(len(widths)):
            best = -1.0
            for c in grid:
                own = [found[i] for i, key in enumerate(keys) if key == (n, d, c) and i in found]
                if own and np.mean(own) > best + 1e-12:
                    best, out[n][d] = float(np.mean(own)), c
    return out


def _side_by_side(rungs: dict[str, Rung]) -> dict[tuple[str, tuple[str, ...]], str]:
    """The blocks of all rungs, each once, by name and columns, and what each is called in a design that has them all."""
    every = dict.fromkeys((b, tuple(columns)) for r in rungs.values() for b, columns in r.blocks.items())
    return {block: f"{i}_{block[0]}" for i, block in enumerate(every)}


def ladder(
    df: DataFrame, rungs: dict[str, Rung], *, id: str, label: str, group: str, fold: str, k: int, grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), inner_k: int = 3, seed: int = 0, least_docs: int = 2, most_terms: int = 50_000, **options,
) -> tuple[DataFrame, DataFrame]:
    """(scores, report): out-of-fold values of every rung over the same outer folds, and what each fold chose.

    scores are (id, y, fold, oof_<rung>...); report is (rung, fold, c, features, blocks). In each fold the penalty is chosen by
    inner folds of whole groups, which no row of the fold is part of; where the other folds don't allow inner folds with both
    classes, it is 1.0. Rungs differ in what they read and in nothing else. Rows of null label, group or fold take no part;
    ids must be unique."""
    from .sampling import stratified_group_folds

    rows = df.where(F.col(label).isNotNull() & F.col(group).isNotNull() & F.col(fold).isNotNull())
    dealt, cells = rows, []
    for f in range(k if inner_k else 0):
        try:
            inner = stratified_group_folds(rows.where(F.col(fold) != f).select(id, label, group), group, label, inner_k, seed).select(id, F.col("fold").alias(f"inner_{f}"))
        except ValueError:
            cells.append(F.lit(-1))
            continue
        dealt = dealt.join(inner, id, "left")
        cells.append(F.coalesce(F.col(f"inner_{f}"), F.lit(-1)))
    dealt = stored(dealt.withColumn("inner_", F.array(*cells) if cells else F.lit(None).cast("array<int>")).drop(*[f"inner_{f}" for f in range(k)]), "dealt")
    if not all(r.text is not None or r.blocks for r in rungs.values()):
        raise ValueError("a rung has a text or a block")
    own, chosen = {}, {}
    # rungs of the same text share its terms and rows: a row is written once with the blocks of all, and the models of a rung pass over those of others
    for text in dict.fromkeys(r.text for r in rungs.values()):
        group = {n: r for n, r in rungs.items() if r.text == text}
        called = _side_by_side(group)
        table, blocks = designs(dealt, Rung(text, {c: list(columns) for (_, columns), c in called.items()}), id=id, label=label, fold=fold, inner="inner_", k=k, least_docs=least_docs, most_terms=most_terms, packed=True)
        widths, reads = [sum(b.values()) for b in blocks], {}
        for name, rung in group.items():
            named = {**({"words": "words", "chars": "chars"} if text is not None else {}), **{called[b, tuple(columns)]: b for b, columns in rung.blocks.items()}}
            ends = [dict(zip(b, np.cumsum(list(b.values())).tolist(), strict=True)) for b in blocks]
            reads[name] = [tuple((ends[d][b] - blocks[d][b], ends[d][b]) for b in blocks[d] if b in named) for d in range(k)]
            chosen[name] = [{named[b]: n for b, n in blocks[d].items() if b in named} for d in range(k)]
        # as many rungs at once as the driver may hold
        every = [SparseFit(d, None, 1.0) for d in range(k) for _ in range(max(len(grid) * inner_k, 1))]
        many = max(1, options.get("most_bytes", MOST_BYTES) // max(_need(widths, every), 1))
        for at in range(0, len(group), many):
            names = list(group)[at : at + many]
            penalties = _penalties(table, widths, [reads[n] for n in names], list(grid), inner_k, **options)
            fits = [SparseFit(d, None, c, reads[n][d]) for n, cs in zip(names, penalties, strict=True) for d, c in enumerate(cs)]
            values = stored(scored(table, widths, fits, fitted(table, widths, fits, **options)), "rung")
            for i, n in enumerate(names):
                own[n] = (values.where((F.col("model") >= i * k) & (F.col("model") < (i + 1) * k)).select("id", "y", (F.col("model") - i * k).alias("fold"), F.col("value").alias(f"oof_{n}")), penalties[i])
        drop_stored(table.rows)
    scores, report = None, []
    for name in rungs:
        values, penalties = own[name]
        scores = values if scores is None else scores.join(values.select("id", f"oof_{name}"), "id")
        report += [(name, d, float(c), sum(chosen[name][d].values()), ", ".join(f"{b} {n}" for b, n in chosen[name][d].items())) for d, c in enumerate(penalties)]
    return scores, df.sparkSession.createDataFrame(report, "rung string, fold int, c double, features int, blocks string")


def prefixed(df: DataFrame, *prefixes: str) -> list[str]:
    """The columns whose names start with one of the prefixes, in order."""
    return [c for c in df.columns if c.startswith(prefixes)]


def by_family(
    df: DataFrame, families: dict[str, list[str]], *, id: str, label: str, group: str, base: str, seeds: tuple[int, ...] = (0, 1, 2), k: int = 5, c: float = 1.0, rounds: int = 200, **options,
) -> tuple[DataFrame, DataFrame]:
    """(runs, increments): every family of columns through the same grouped folds, for each seed.

    runs are (family, seed, rows, folds, auroc, auprc) of out-of-fold values; a fold in which training or test rows have one class is passed over with
    its rows. increments are (family, rows, mean_auroc, increment, low, high, above_zero): the mean AUROC over seeds, its lead over the base
    family's, and the interval of the lead in AUROC by paired bootstrap over groups, on the rows that both have a value for under the first seed. Rows of null label
    or group take no part; values that are null or not finite count as 0. ids must be unique."""
    from .ranking import average_precision
    from .sampling import folds
    from .stats import paired_bootstrap

    rows = df.where(F.col(label).isNotNull() & F.col(group).isNotNull())
    runs, first = None, {}
    for seed in seeds:
        dealt = stored(folds(rows, group, k, seed), "family-folds")
        counts = {r["fold"]: (r["n"], r["p"]) for r in dealt.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("p")).collect()}
        n, p = (sum(x[i] for x in counts.values()) for i in (0, 1))
        open_ = [f for f, (m, q) in counts.items() if 0 < q < m and 0 < p - q < n - m]
        for name, columns in families.items():
            table, blocks = designs(dealt, Rung(None, {name: columns}), id=id, label=label, fold="fold", inner=None, k=k)
            widths = [sum(b.values()) for b in blocks]
            fits = [SparseFit(f, None, c) for f in open_]
            values = stored(scored(table, widths, fits, fitted(table, widths, fits, **options)), "family-values")
            one = auroc(values, "value", "y").join(F.broadcast(average_precision(values, "value", "id", "y"))).select(
                F.lit(name).alias("family"), F.lit(seed).alias("seed"), (F.col("positives") + F.col("negatives")).alias("rows"), F.lit(len(open_)).alias("folds"), "auroc", "auprc",
            )
            runs = one if runs is None else runs.unionByName(one)
            if seed == seeds[0]:
                first[name] = values.select("id", "y", F.col("value").alias(f"v_{name}"))
    means = runs.groupBy("family").agg(F.avg("auroc").alias("mean_auroc"))
    groups = rows.select(F.col(id).cast("long").alias("id"), F.col(group).alias("group_"))
    out = None
    for name in families:
        if name == base:
            continue
        met = first[base].join(first[name].drop("y"), "id").join(groups, "id")
        got = paired_bootstrap(met, "group_", "y", f"v_{base}", f"v_{name}", rounds).select("low", "high")
        one = met.agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(got)).select(F.lit(name).alias("family"), "rows", "low", "high", F.coalesce(F.col("low") > 0, F.lit(False)).alias("above_zero"))
        out = one if out is None else out.unionByName(one)
    own = means.where(F.col("family") == base).select(F.col("mean_auroc").alias("base_"))  # one row
    lead = means.join(F.broadcast(own)).select("family", "mean_auroc", (F.col("mean_auroc") - F.col("base_")).alias("increment"))
    return runs, out.join(lead, "family").select("family", "rows", "mean_auroc", "increment", "low", "high", "above_zero")
