"""Best-fit packing of documents into sequences, by large-item matching.

How full a sequence gets depends on the lengths alone, and there are at most `capacity` of them. So lengths are
counted first, and the plan is made for counts: what it says of a length holds for all its pieces at once, and its size is
bounded by the capacity, not by the table. Pieces above one third of the capacity pair at most twice a sequence: from
the longest on, each is matched with the longest that still fits (as few sequences as such pieces can have). Shorter ones
follow, longest first, each in the narrowest gap that takes it, and a new sequence opens where none does.

Pieces then get their number among those of equal length from stored range partitions, and the plan turns length and number
into a sequence and a place in it. A third of all documents may share one length: it is spread over many ranges.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import ranged
from .bpe import byte_letters, merged, packed_merges
from .common import drop_stored, small_batches, stored

Class = tuple[int, list[tuple[int, int]]]


def plan(counts: dict[int, int], capacity: int) -> list[Class]:
    """(sequences, [(length, copies), ...]): how many sequences are filled alike, and with what, in order."""
    left = {s: n for s, n in counts.items() if n}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    gaps: dict[int, list[list]] = {}  # gap -> [sequences, content]
    order: list[int] = []  # gaps there are, ascending

    def put(gap: int, n: int, content: tuple) -> None:
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append([n, content])

    # content is a linked list: (what came before, length, copies)
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        n = left[s]
        at = bisect_left(large, capacity - s + 1) - 1
        if at >= 0 and large[at] == s and n == 1:
            at -= 1  # not with itself
        if at < 0:
            put(capacity - s, n, (None, s, 1))
            left[s] = 0
        elif large[at] == s:
            put(capacity - 2 * s, n // 2, (None, s, 2))
            left[s] = n % 2
        else:
            t = large[at]
            m = min(n, left[t])
            put(capacity - s - t, m, ((None, s, 1), t, 1))
            left[s] -= m
            left[t] -= m
            if not left[t]:
                large.pop(at)
        if not left[s]:
            large.pop()
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(order, s)
            if at == len(order):  # open new ones
                each = capacity // s
                if n // each:
                    put(capacity - each * s, n // each, (None, s, each))
                if n % each:
                    put(capacity - n % each * s, 1, (None, s, n % each))
                break
            gap = order[at]
            there, content = gaps[gap][-1]
            each = gap // s
            full = min(there, n // each)
            rest = n - full * each if full < there else 0
            taken = full + (rest > 0)
            if taken == there:
                gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                gaps[gap][-1][0] -= taken
            if full:
                put(gap - each * s, full, (content, s, each))
            if rest:
                put(gap - rest * s, 1, (content, s, rest))
            n -= full * each + rest
    out = []
    for gap in order:
        for n, content in gaps[gap]:
            held = []
            while content:
                held.append(content[1:])
                content = content[0]
            out.append((n, held[::-1]))
    return out


class Places:
    """The plan by length: where the piece of a length with number r (from 0) goes."""

    def __init__(self, classes: list[Class]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}  # length -> (first number, copies, first sequence, offset)
        used: dict[int, int] = {}
        first = 0
        for n, content in classes:
            offset = 0
            for length, copies in content:
                rows.setdefault(length, []).append((used.get(length, 0), copies, first, offset))
                used[length] = used.get(length, 0) + n * copies
                offset += length * copies
            first += n
        self.rows, self.sequences = {s: np.array(r, np.int64).T for s, r in rows.items()}, first

    def of(self, length: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, copies, first, offset = self.rows[length]
        at = np.searchsorted(start, numbers, "right") - 1
        inner = numbers - start[at]
        return first[at] + inner // copies[at], offset[at] + inner % copies[at] * length


class Encoder:
    """Ids as the tokenizers library gives them for a vocabulary file, without added special tokens, truncation or padding.

    For a byte-level vocabulary whose ids rise with the ranks of its merges and whose every token is what its own letters
    merge to, merging by id is the same as merging by rank, so tiktoken may do it (some four times faster). Texts with code points whose class (letter,
    number, space) the two libraries see differently, and texts that tiktoken refuses, go to the tokenizers library; so do all texts
    for any other kind of file."""

    def __init__(self, content: str, odd: str | None):
        import re

        self.content, self.library, self.fast, self.odd = content, None, None, None
        if odd is not None:
            import tiktoken

            j = json.loads(content)
            special = {t["content"]: t["id"] for t in j["added_tokens"]}
            byte = {c: bytes([b]) for b, c in enumerate(byte_letters())}
            ranks = {b"".join(byte[c] for c in token): i for token, i in j["model"]["vocab"].items() if token not in special}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.odd = re.compile(f"[{odd}]") if odd else None

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and (self.odd is None or not self.odd.search(text)):
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except BaseException as e:  # a very long run without a break is more than its pattern can take
                if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                    raise
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.content)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


#: Fixed value: how byte-level vocabularies of this kind cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _odd() -> str:
    """The code points whose class the two libraries see differently, for a character class of a pattern."""
    import tiktoken
    from tokenizers import Regex, pre_tokenizers

    every = [chr(c) for c in chain(range(0xD800), range(0xE000, 0x110000))]
    odd: set[str] = set()
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        one = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        cut = pre_tokenizers.Split(Regex(name), "removed")
        for at in range(0, len(every), 65_536):
            text = "".join(every[at : at + 65_536])
            odd |= set(bytes(one.encode_ordinary(text)).decode()) ^ (set(text) - set("".join(p for p, _ in cut.pre_tokenize_str(text))))
    return "".join(f"\\U{ord(c):08x}" for c in sorted(odd))


def prepared(path: str) -> tuple[str, str | None]:
    """The content of a vocabulary file and what Encoder needs besides: None where only the tokenizers library will do."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    j = json.loads(content)
    model, cut = j["model"], j.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not j.get("normalizer")
    marks = [t for t in j["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if not plain or not level or marks:
        return content, None
    ids = {t: i for t, i in model["vocab"].items() if t not in {a["content"] for a in j["added_tokens"]}}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [ids[a + b] for a, b in pairs]
    letters = byte_letters()
    merges = packed_merges({(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)})
    whole = set(letters) <= set(ids) and len(ids) == 256 + len(set(made)) and all(x < y for x, y in zip(made, made[1:], strict=False)) and max(ids[c] for c in letters) < min(made, default=256)
    whole = whole and all(merged([ids[c] for c in a + b], merges) == [i] for (a, b), i in zip(pairs, made, strict=True))
    return content, _odd() if whole else None


def pieces(docs: DataFrame, vocabulary: str, *, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: documents as ids of the vocabulary followed by `end`, and
    those of more than `capacity` ids cut into pieces of that many, the first of which takes what is left over."""
    shared = docs.sparkSession.sparkContext.broadcast(prepared(vocabulary))
    fields = "start: bigint, length: bigint, ids_crc32: bigint" + ", ids: array<int>" * with_ids

    @F.pandas_udf(f"array<struct<{fields}>>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = Encoder(*shared.value)
        for texts in parts:
            out = []
            for text in texts:
                ids = np.append(encode(text or ""), end).astype("<u4")
                ends = range(len(ids) % capacity or capacity, len(ids) + 1, capacity)
                row = []
                for e in ends:
                    start = max(0, e - capacity)
                    start = 0 if e == ends[0] else start
                    own = ids[start:e]
                    row.append({"start": start, "length": e - start, "ids_crc32": zlib.crc32(own.tobytes())} | ({"ids": own.astype(np.int32)} if with_ids else {}))
                out.append(row)
            yield pd.Series(out)

    return docs.select("doc_id", F.posexplode(cut(F.col("text"))).alias("piece", "p")).select("doc_id", "piece", "p.*")


def packed(docs: DataFrame, vocabulary: str, *, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Every piece of every document and its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null text is empty, and an empty text is the id `end` alone. Texts of any length are encoded whole. Pieces of equal
    length are numbered by doc_id (nulls first), piece and digest; rows said twice are packed twice. An empty table gives no rows. Only doc_id and text are
    read, whatever other columns are called. The same table gives the same plan again; rows that are equal may change places.

    The driver holds one count for each length there is, at most `capacity`, and the plan made of them."""
    with small_batches(docs.sparkSession):
        cut = stored(pieces(docs, vocabulary, capacity=capacity, end=end, with_ids=with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity)))
    held = ranged(cut.withColumn("tie", F.monotonically_increasing_id()), [F.asc("length"), F.asc_nulls_first("doc_id"), F.asc("piece"), F.asc("ids_crc32"), F.asc("tie")])
    drop_stored(cut)
    # one row for each length and range that meet: as many as there are lengths and ranges together
    parts = held.groupBy("length", "pid_").agg(F.count(F.lit(1)).alias("n_"), F.min("ln_").alias("first_"))
    before = {(r["length"], r["pid_"]): r for r in parts.collect()}
    base: dict[int, int] = {}
    shift = []
    for length, pid in sorted(before):
        shift.append((length, pid, base.get(length, 0) - before[length, pid]["first_"]))
        base[length] = base.get(length, 0) + before[length, pid]["n_"]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        out = np.zeros((2, len(length)), np.int64)
        lengths, numbers = length.to_numpy(), number.to_numpy()
        for s in np.unique(lengths):
            at = lengths == s
            out[:, at] = places.value.of(int(s), numbers[at])
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    table = docs.sparkSession.createDataFrame(shift, "length long, pid_ long, shift_ long")
    met = held.join(F.broadcast(table), ["length", "pid_"]).withColumn("place_", place("length", F.col("ln_") + F.col("shift_")))
    return met.select("doc_id", "piece", "start", "length", "ids_crc32", "place_.sequence_id", "place_.offset", *["ids"] * with_ids)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, documents): the sequences themselves, of pieces with ids. A sequence holds at most `capacity` ids."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed_pieces.groupBy("sequence_id").agg(rows.alias("r")).select("sequence_id", F.flatten("r.ids").alias("ids"), F.col("r.doc_id").alias("documents"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))
