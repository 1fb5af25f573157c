"""Terms of texts, counted in batches: words and pairs of words, or runs of the characters of words.

Spark cuts texts into words. A task gets them as Arrow, numbers the distinct words of a batch, and sorts and counts numbers:
terms are written out once a batch, and runs of characters are cut once for each distinct word of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a text by unit of its terms.
WORDS = {"word": r"(?U)\b\w\w+\b", "char": r"\S+"}

#: Words that are counted at once. A row is never cut, so a larger one is a batch of its own.
BATCH = {"word": 1 << 20, "char": 1 << 19, "term": 1 << 20}


def words(text: Column, unit: str) -> Column:
    """The words of a text in lower case, none of a null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS[unit]), F.lit(0))


def slices(batch: pa.RecordBatch, column: str, unit: str) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows that hold BATCH words together, or one row that holds more."""
    sizes = np.cumsum(pc.list_value_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(int(np.searchsorted(sizes, before + BATCH[unit], "right")), start + 1)
        yield batch.slice(start, end - start)
        start = end


def _runs(word: str, low: int, high: int) -> list[str]:
    w = f" {word} "
    return [w[i : i + size] for size in range(low, high + 1) if len(w) >= size or size == low for i in range(max(len(w) - size + 1, 1))]


def _distinct_runs(words: pa.Array, low: int, high: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(names, length, flat) by size of the runs: the distinct runs, how many each word has, and which, one word after another. Letters
    are numbered, so that a run is one number; where that takes more than 63 bits, runs are numbered as strings."""
    joined = " " + "  ".join(words.to_pylist()) + " " if len(words) else ""
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    letters = np.unique(codes)
    bits = len(letters).bit_length()
    if bits * high > 63:
        numbers: dict[str, int] = {}
        runs = [[numbers.setdefault(r, len(numbers)) for r in _runs(w, low, high)] for w in words.to_pylist()]
        yield pa.array(list(numbers), pa.string()), np.array([len(r) for r in runs], np.int64), np.array([i for r in runs for i in r], np.int64)
        return
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))
    number = np.append(np.searchsorted(letters, codes) + 1, np.zeros(high, np.int64)).astype(np.int64)
    for n in range(low, high + 1):
        length = np.maximum(size - n + 1, int(n == low))
        at = np.flatnonzero(left >= n)
        short = n == low and bool((size < low).any())
        if short:
            at = np.sort(np.append(at, (np.cumsum(size) - size)[size < low]))
        key = np.zeros(len(at), np.int64)
        for j in range(n):
            own = number[at + j]
            key = (key << bits) | (np.where(left[at] > j, own, 0) if short else own)  # a word that is shorter ends in zeros
        seen, flat = np.unique(key, return_inverse=True)
        yield _named(seen, n, bits, letters), length, flat


def _named(keys: np.ndarray, n: int, bits: int, letters: np.ndarray) -> pa.Array:
    """The strings of runs that are numbers of letters."""
    found = (keys[:, None] >> (bits * np.arange(n - 1, -1, -1))) & ((1 << bits) - 1)
    there = found > 0
    codes = letters[found[there] - 1]
    width = np.zeros(found.shape, np.int64)
    width[there] = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    ends = np.append(0, np.cumsum(width.sum(axis=1))).astype(np.int32)
    return pa.StringArray.from_buffers(len(keys), pa.py_buffer(ends), pa.py_buffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode()))


def ordered(*keys: tuple[np.ndarray, int]) -> np.ndarray | None:
    """Numbers below their bounds, as one each, ascending by the first, then the next; None where that takes more than 63 bits."""
    bits = [max(int(bound) - 1, 1).bit_length() for _, bound in keys]
    if sum(bits) > 63:
        return None
    out = keys[0][0].astype(np.int64)
    for (key, _), width in zip(keys[1:], bits[1:], strict=True):
        out <<= width
        out |= key
    out.sort()
    return out


def _counted(key: np.ndarray, rows: int, tf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) for occurrences as term * rows + row, each row and term once, by term and row."""
    if tf is None:
        key = np.sort(key)
    elif len(key):
        most = int(tf.max()) + 1
        both = ordered((key, int(key.max()) + 1), (tf, most))  # numbers sort much faster by themselves than their places do
        if both is None:
            order = np.argsort(key)
            key, tf = key[order], tf[order]
        else:
            width = (most - 1).bit_length()
            key, tf = both >> width, both & ((1 << width) - 1)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(first, append=len(key)) if tf is None else np.add.reduceat(tf, first) if len(first) else tf
    return key[first] % rows, key[first] // rows, tf


def _renumbered(term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of an ascending array, and the place of each among them."""
    new = np.diff(term, prepend=-1) != 0
    return term[new], np.cumsum(new) - 1


def counted(lists: pa.ListArray, unit: str, sizes: tuple[int, int] = (3, 5)) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(names, row, term, tf) for rows of words, in parts that have no term in common: each row and term once, by term, and names[term].
    A null among the words parts texts of the same row: no pair goes over it. The unit "term" counts what it is given."""
    rows = max(len(lists), 1)
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    names, there = coded.dictionary, coded.indices.is_valid().to_numpy(zero_copy_only=False)
    code = coded.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    own = _counted(code[there] * rows + row[there], rows)
    if unit != "char":
        yield names, *own
    if unit == "term":
        return
    if unit == "word":
        pair = there[1:] & there[:-1] & (row[1:] == row[:-1])
        at, term, tf = _counted((code[:-1][pair] * len(names) + code[1:][pair]) * rows + row[1:][pair], rows)
        seen, term = _renumbered(term)
        a, b = (names.take(pa.array(x)) for x in np.divmod(seen, max(len(names), 1)))
        yield pc.binary_join_element_wise(a, b, " "), at, term, tf
        return
    at, word, tf = own
    for names, length, flat in _distinct_runs(names, *sizes):
        start, many = np.cumsum(length) - length, length[word]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[word], many)
        yield names, *_counted(flat[place] * rows + np.repeat(at, many), rows, np.repeat(tf, many))


def places(names: pa.Array, terms: pa.Array) -> np.ndarray:
    """The place of each name among terms, -1 where it is none of them."""
    return pc.index_in(names, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def lengths(value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The Euclidean length of each row."""
    return np.sqrt(np.bincount(row, value * value, rows))


#: What buckets are dealt as: terms with their counts as the bytes of an Arrow stream.
DEALT = "bucket int, data binary"


def _hashes(names: pa.Array) -> np.ndarray:
    """A number of 64 bits for each string, the same wherever it is met."""
    names = pa.concat_arrays([names.cast(pa.string())])
    _, ends, data = names.buffers()
    ends = np.frombuffer(ends, np.int32, len(names) + 1, names.offset * 4).astype(np.int64)
    size, out = np.diff(ends), np.zeros(len(names), np.uint64)
    if ends[-1] > ends[0]:
        letters = np.frombuffer(data, np.uint8, ends[-1] - ends[0], ends[0]).astype(np.uint64) + np.uint64(1)
        place = np.arange(len(letters)) - np.repeat(ends[:-1] - ends[0], size)
        power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
        letters *= power.take(place)
        out[size > 0] = np.add.reduceat(letters, (ends[:-1] - ends[0])[size > 0])
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def in_buckets(names: pa.Array, counts: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Terms and their counts as rows of DEALT: a term is in the same bucket wherever it is counted."""
    bucket = (_hashes(names) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    table = pa.table([names, *[pa.array(c, pa.int32()) for c in counts]], names=["term", *[f"n{i}" for i in range(len(counts))]]).take(pa.array(order)).combine_chunks()
    seen, first = np.unique(bucket[order], return_index=True)
    data = []
    for start, end in zip(first.tolist(), [*first.tolist()[1:], len(bucket)], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table.slice(start, end - start))
        data.append(sink.getvalue())
    return pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array([d.to_pybytes() for d in data], pa.binary())], names=["bucket", "data"])


def merged(data: pa.ChunkedArray) -> pa.Table:
    """The terms of a bucket, each once, with the sums of its counts."""
    every = pa.concat_tables([pa.ipc.open_stream(d.as_buffer()).read_all() for d in data])
    counts = every.column_names[1:]
    return every.group_by("term").aggregate([(c, "sum") for c in counts]).select(["term", *[f"{c}_sum" for c in counts]]).rename_columns(["term", *counts])
