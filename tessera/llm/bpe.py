"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are the leaves; leaf i of the tree holds the rank of the merge of symbol i with its right
neighbour, and every inner node the smaller of its two, the left one on ties, so the root names the leftmost
merge of lowest rank. A merge changes three leaves at most, each updated along its path to the root, until
the root holds no merge. Words are remembered up to a fixed number, so the tree runs once for most.

The vocabulary file is a parameter; its path must be readable where the driver runs, and its content goes
to the executors as a broadcast of fixed size.
"""

from __future__ import annotations

import array
import hashlib
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

NONE = 1 << 62
#: Fixed value: the one normaliser that is supported.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@dataclass
class Vocabulary:
    """What encoding and decoding need of a vocabulary file of the tokenizers library with a BPE model."""

    ids: dict[str, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    suffix: str
    special: dict[str, int]
    pattern: str
    tokens: dict[int, str] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """The vocabulary of a file. What Codec doesn't do as the file asks is refused: another normaliser than NFC, white space to a space and
        lower case, another cut than by a pattern of words into bytes, options of the model, a decoder, marks that take space with them."""
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        pattern = cls._checked(j)
        ids = j["model"]["vocab"]
        merges = {}
        for rank, pair in enumerate(j["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges[ids[a], ids[b]] = (rank, ids[a + b])
        special = {t["content"]: t["id"] for t in j["added_tokens"]}
        return cls(ids, merges, j["model"]["end_of_word_suffix"] or "", special, pattern, {i: t for t, i in (ids | special).items()})

    @staticmethod
    def _checked(j: dict) -> str:
        """The word pattern of a file that Codec can follow, else an error."""
        model, cut = j["model"], j.get("pre_tokenizer") or {}
        parts = cut.get("pretokenizers") or [{}, {}]
        asked = {
            "normalizer": j.get("normalizer") == NORMALISER,
            "pre_tokenizer": cut.get("type") == "Sequence" and [p.get("type") for p in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not (parts[1]["add_prefix_space"] or parts[1]["use_regex"]),
            "model": model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")),
            "decoder": j.get("decoder") is None,
            "added_tokens": not any(t[k] for t in j["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
        }
        if bad := [name for name, fine in asked.items() if not fine]:
            raise ValueError(f"this vocabulary file has another {' and '.join(bad)} than is supported")
        return parts[0]["pattern"]["Regex"]


#: A merge as one number: its rank above, the symbol that it makes in so many bits below.
SYMBOL_BITS = 24
SYMBOL = (1 << SYMBOL_BITS) - 1


def packed_merges(merges: dict[tuple[int, int], tuple[int, int]]) -> dict[int, dict[int, int]]:
    """left symbol -> right symbol -> rank and made symbol as one number, which sorts by rank."""
    out: dict[int, dict[int, int]] = {}
    for (left, right), (rank, symbol) in merges.items():
        out.setdefault(left, {})[right] = rank << SYMBOL_BITS | symbol
    return out


def merged(symbols: list[int], merges: dict[int, dict[int, int]]) -> list[int]:
    """Apply packed_merges, lowest rank first and leftmost of equal ranks, until no adjacent pair has one.

    A segment tree of minima: leaf size + i is the merge of symbol i with its right neighbour. Written out in one place, since words
    are short and many, so calls cost."""
    n = len(symbols)
    if n < 2:
        return symbols
    none: dict[int, int] = {}
    get = merges.get
    size = 1 << (n - 2).bit_length()
    tree = [NONE] * size
    tree += [get(a, none).get(b, NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
    tree += [NONE] * (2 * size - len(tree))
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left <= right else right
    if tree[1] == NONE:
        return symbols

    def put(at: int, merge: int) -> None:
        """A point update, up to where nothing changes."""
        tree[at] = merge
        while at > 1:
            other = tree[at ^ 1]
            if other < merge:
                merge = other
            at >>= 1
            if tree[at] == merge:
                break
            tree[at] = merge

    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree[1]) != NONE:
        at = 1
        while at < size:  # the left child where both hold the least
            at *= 2
            if tree[at] != least:
                at += 1
        i = at - size
        j = after[i]
        symbols[i] = symbol = least & SYMBOL
        symbols[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            put(j + size, NONE)
        if k < n:
            before[k] = i
            put(at, get(symbol, none).get(symbols[k], NONE))
        else:
            put(at, NONE)
        h = before[i]
        if h >= 0:
            put(h + size, get(symbols[h], none).get(symbol, NONE))
    return [s for s in symbols if s >= 0]


class Codec(dict):
    """Encoder and decoder of a vocabulary of lower-cased words: NFC, lower case, words by pattern, bytes as letters.

    As a dictionary it maps a word to the bytes of its ids, up to a fixed number of words in two generations: when the younger is full it
    becomes the older one, from which words that come again are taken over, so that frequent words stay."""

    def __init__(self, vocabulary: Vocabulary, most_words: int = 500_000):
        import regex

        super().__init__()
        self.v, self.most = vocabulary, most_words
        self.old: dict[str, bytes] = {}
        self.inner = [vocabulary.ids.get(c) for c in byte_letters()]
        self.last = [vocabulary.ids.get(c + vocabulary.suffix) for c in byte_letters()]
        self.merges = packed_merges(vocabulary.merges)
        self.letters = byte_letters()
        self.names = [vocabulary.tokens.get(i) for i in range(max(vocabulary.tokens, default=-1) + 1)]
        self.word = regex.compile(vocabulary.pattern).findall
        self.starts = {s[0] for s in vocabulary.special}
        self.mark = regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            data = word.encode("utf-8", "replace")
            ids = [self.inner[b] for b in data[:-1]]
            ids.append(self.last[data[-1]])
            if None in ids:  # a byte that the vocabulary has no token for is left out
                ids = [i for i in ids if i is not None]
            out = array.array("I", merged(ids, self.merges)).tobytes()
        if len(self) >= self.most // 2:
            self.old = self.copy()
            self.clear()
        self[word] = out
        return out

    def normalised(self, text: str) -> str:
        import unicodedata

        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower case letter by letter: a final sigma is no special case
            text = text.replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str) -> array.array:
        out = array.array("I")
        if self.mark is None or not any(c in text for c in self.starts):
            out.frombytes(b"".join(map(self.__getitem__, self.word(self.normalised(text)))))
            return out
        at = 0
        for m in [*self.mark.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            out.frombytes(b"".join(map(self.__getitem__, self.word(self.normalised(part)))))
            if m:
                out.append(self.v.special[m[0]])
                at = m.end()
        return out

    def decode(self, ids) -> str:
        """Tokens joined by a space: the vocabulary file names no decoder. Unknown ids are left out."""
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except (IndexError, TypeError):
            return " ".join([self.v.tokens[i] for i in ids if i in self.v.tokens])

    def text(self, ids) -> str:
        """The words that the ids stand for, each followed by a space."""
        byte = {c: b for b, c in enumerate(self.letters)}
        joined, special = "", set(self.v.special.values())
        for i in ids:
            joined += f" {self.v.tokens[i]} " if i in special else self.v.tokens[i].replace(self.v.suffix, " ")
        return bytes(b for c in joined for b in ([byte[c]] if c in byte else c.encode())).decode("utf-8", "replace")


#: The codec of this worker process, which outlives a task.
_kept: list[Codec] = []


def kept_codec(vocabulary: Vocabulary) -> Codec:
    """The codec of a vocabulary, with the words that earlier tasks of this process met."""
    if not _kept or _kept[0].v is not vocabulary:
        _kept[:] = [Codec(vocabulary)]
    return _kept[0]


def encoded(docs: DataFrame, vocabulary: str, *, with_ids: bool = False) -> DataFrame:
    """docs with a struct column (n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids) appended under a
    free name like `bpe`. A null text counts as empty and gives no ids. The decoded text is `decode` of the ids. Texts of any length are
    encoded whole, each by one task; repeated rows get the same result each; an empty table stays empty; other columns pass,
    whatever their names. A vocabulary file that asks for what is not supported is an error."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary))
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    @F.pandas_udf(schema)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = kept_codec(shared.value)
        for texts in parts:
            rows = []
            for text in texts:
                ids = codec.encode(text or "")
                decoded = codec.decode(ids)
                if sys.byteorder == "big":
                    ids.byteswap()
                row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, list(ids)) if with_ids else row)
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return docs.withColumn(fresh(docs, "bpe"), run("text"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "bpe.*")
