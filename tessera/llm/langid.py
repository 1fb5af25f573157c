"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed
against it into phrases, each the longest match that the sample holds, and the language that needs the
fewest phrases, normalised by the sample's size, wins; a letter that its sample does not hold costs as much as
a phrase of the longest sample, so that a short sample does not win by what it lacks. The automata become tables of transitions in
which a failed match leads straight to the start of the next phrase, so that a batch of texts is parsed in
step: one look-up per character and language. Every letter of a sample counts: a language's most frequent
letters have columns in its table, its other letters are found among sorted transitions. Texts are cut into
segments of SEGMENT characters for this. Every segment is first parsed as if it began a text; those that the parse
before enters in another state are parsed again from there until they fall in with what was found, which is soon,
and so on until nothing changes. The result is the parse of the whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, fresh, held_out

#: Characters of a segment, and how many segments are parsed in step. They change speed and memory, not results.
SEGMENT, PIECES = 512, 4096
#: Columns of a language's table: 0 is what its sample does not hold, 1 is anything but a letter, others are its most
#: frequent letters. Its other letters are numbered on from there. How many have columns changes speed, not results.
COLUMNS = 128


def letters(text: str) -> str:
    """The text in lower case with every run of other code points than letters as one space."""
    return "".join(c if c.isalpha() else " " for c in text.lower())


class Automaton:
    """Suffix automaton of a sequence of symbols: states, links and transitions built online in linear time."""

    def __init__(self, symbols: Iterator[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for c in symbols:
            new = self._state({}, self.length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[new] = q
                else:
                    copy = self._state(dict(self.next[q]), self.length[p] + 1)
                    self.link[copy] = self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = self.link[new] = copy
            last = new

    def _state(self, following: dict[int, int], length: int) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1


@dataclass
class Language:
    """Transitions of one language, as twice the next state, plus 1 if a phrase ended. State 0 is the root.

    table[state * width + column] is for columns below width. Of the others, keys holds state * letters + column of
    every transition that does not end a phrase, in order; those of the root come first and are complete."""

    column: np.ndarray
    letters: int
    width: int
    table: np.ndarray
    keys: np.ndarray
    values: np.ndarray

    def step(self, state: np.ndarray, column: np.ndarray, rare: bool) -> np.ndarray:
        if not rare:
            return self.table[state * self.width + column]
        far = np.flatnonzero(column >= self.width)
        got = self.table[state * self.width + np.where(column < self.width, column, 0)]
        key = state[far] * self.letters + column[far]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        got[far] = np.where(self.keys[at] == key, self.values[at], self.values[column[far] - self.width] | 1)
        return got


@dataclass
class Model:
    """Symbols of all letters of the samples from 2 on (0 is what no sample holds, 1 is anything but a letter), and the tables."""

    langs: list[str]
    symbols: dict[str, int]
    tables: list[Language]
    cost: np.ndarray


def _language(text: str, symbols: dict[str, int]) -> Language:
    found = Counter(c for c in text if c != " ")
    column = np.zeros(len(symbols) + 2, np.int64)
    column[1] = 1
    for i, c in enumerate(sorted(found, key=lambda c: (-found[c], c))):
        column[symbols[c]] = i + 2
    letters = len(found) + 2
    width = min(letters, COLUMNS)
    a = Automaton(int(column[1 if c == " " else symbols[c]]) for c in text)
    root = np.ones(width, np.int32)  # an unknown symbol is a phrase by itself
    for c, s in a.next[0].items():
        if c < width:
            root[c] = s * 2 + 1
    table = np.tile(root, (len(a.next), 1))
    far: list[tuple[int, int]] = []
    for s, following in enumerate(a.next):
        for c, t in following.items():
            if c < width:
                table[s, c] = t * 2
            else:
                far.append((s * letters + c, t * 2))
    # the first symbol of a text opens a phrase: counted from the root, so no flag there
    table[0] = np.where(root == 1, root, root & ~1)
    far.sort()
    return Language(column, letters, width, table.ravel(), np.array([k for k, _ in far], np.int64), np.array([v for _, v in far], np.int32))


def trained(samples: dict[str, list[str]]) -> Model:
    """A model of the texts of each language, all of which count whole."""
    joined = {lang: letters("\n".join(texts)) for lang, texts in sorted(samples.items())}
    joined = {lang: " ".join(t.split()) for lang, t in joined.items()}
    joined = {lang: t for lang, t in joined.items() if t}
    symbols = {c: i + 2 for i, c in enumerate(sorted({c for t in joined.values() for c in t if c != " "}))}
    cost = np.array([math.log2(max(2, len(t))) for t in joined.values()])
    return Model(list(joined), symbols, [_language(t, symbols) for t in joined.values()], cost)


class Parser:
    def __init__(self, model: Model):
        self.m = model
        self.kind = np.min_scalar_type(len(model.symbols) + 1)
        self.absent = np.array([t.column == 0 for t in model.tables], np.int64).T
        self.symbol = np.full(0x110000, -1, np.int32)  # of each code point, filled in as they are met

    def _symbol(self, point: int) -> int:
        c = chr(point).lower()
        c = c if len(c) == 1 else chr(point)
        return self.m.symbols.get(c, 0) if c.isalpha() else 1

    def coded(self, text: str) -> tuple[np.ndarray, bool]:
        """Symbols of the text, with runs of other code points than letters as one; whether it has a letter."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.symbol[points]
        new = out < 0
        if new.any():
            for p in np.unique(points[new]):
                self.symbol[p] = self._symbol(int(p))
            out = self.symbol[points]
        out = out.astype(self.kind)
        other = out == 1
        keep = np.ones(len(out), bool)
        keep[1:] = ~(other[1:] & other[:-1])
        return out[keep], bool((~other).any())

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases that each language needs for each text, in (text, language)."""
        counts = np.zeros((len(coded), len(self.m.langs)), np.int64)
        counts[[i for i, x in enumerate(coded) if len(x)]] = 1
        pieces = [(i, s, min(s + SEGMENT, len(x))) for i, x in enumerate(coded) for s in range(0, len(x), SEGMENT)]
        carried = np.zeros(len(self.m.langs), np.int64)  # states in which the piece before a window ends
        for at in range(0, len(pieces), PIECES):
            carried = self._window(coded, pieces[at : at + PIECES], carried, counts)
        return counts

    def _window(self, coded: list[np.ndarray], part: list[tuple[int, int, int]], carried: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Adds the phrase ends of successive pieces to counts; the states in which the last piece ends."""
        lens = np.array([e - s for _, s, e in part])
        order = np.argsort(-lens, kind="stable")
        place = np.empty(len(part), np.int64)
        place[order] = np.arange(len(part))
        size = lens[order]
        before = np.array([place[j - 1] if s and j else -1 for j, (_, s, _) in enumerate(part)])[order]  # the piece that a piece continues
        owners = np.array([part[j][0] for j in order])
        grid = np.zeros((int(size[0]), len(part)), np.int32)
        for p, j in enumerate(order):
            i, s, e = part[j]
            grid[: e - s, p] = coded[i][s:e]
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # pieces that are at least so long
        ends = np.empty(len(self.m.tables), np.int64)
        for g, language in enumerate(self.m.tables):
            columns = language.column[grid]
            rare = (columns >= language.width).any(axis=1)
            start = np.zeros(len(part), np.int64)
            if part[0][1]:
                start[place[0]] = carried[g]
            trace = np.zeros(grid.shape, np.int32)
            state = start
            for row, (n, r) in enumerate(zip(live, rare, strict=True)):
                trace[row, :n] = got = language.step(state[:n], columns[row, :n], r)
                state = got >> 1
            while True:
                last = trace[size - 1, np.arange(len(part))] >> 1
                enters = np.where(before >= 0, last[before], start)
                active = np.flatnonzero(enters != start)
                if not len(active):
                    break
                start = enters
                state, row = enters[active].astype(np.int64), 0
                while len(active):
                    got = language.step(state, columns[row, active], rare[row])
                    other = got != trace[row, active]
                    trace[row, active] = got
                    row += 1
                    other &= size[active] > row
                    active, state = active[other], got[other] >> 1
            np.add.at(counts[:, g], owners, (trace & 1).sum(axis=0))
            ends[g] = last[place[-1]]
        return ends

    def missing(self, coded: list[np.ndarray]) -> np.ndarray:
        """Letters of each text that the sample of each language does not hold, in (text, language)."""
        return np.array([np.bincount(x, minlength=len(self.absent)) @ self.absent for x in coded], np.int64).reshape(len(coded), len(self.m.langs))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.m.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        coded, spoken = zip(*(self.coded(t or "") for t in texts), strict=True) if texts else ((), ())
        bits = self.phrases(list(coded)) * self.m.cost + self.missing(list(coded)) * (self.m.cost.max() - self.m.cost)
        size = np.array([max(1, len(x)) for x in coded])
        rate = bits / size[:, None]  # bits a character
        best = rate.argmin(axis=1)
        share = np.exp2(-(rate - rate.min(axis=1, keepdims=True)) * np.minimum(size, 64)[:, None])
        score = 1 / share.sum(axis=1)
        return [self.m.langs[b] if s else "und" for b, s in zip(best, spoken, strict=True)], [float(x) if s else 0.0 for x, s in zip(score, spoken, strict=True)]


def sampled_passages(docs: DataFrame, per_lang: int, passage_chars: int) -> dict[str, list[str]]:
    """A passage of each of at most per_lang training documents of every language, documents in the order of a hash of doc_id.

    Whole texts are divided into passages of passage_chars characters, and a hash of doc_id says which one stands for its document,
    so beginnings count no more than what follows. The ranking keeps per_lang rows of each language within each task, so a hot
    language is not gathered. What comes to the driver is bounded by per_lang * passage_chars characters a language."""
    passages = F.ceil(F.length("text") / passage_chars)
    at = F.pmod(F.xxhash64("doc_id", F.lit(13)), passages) * passage_chars
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull() & ~held_out(3, 1)).select("doc_id", "lang", F.substring(F.col("text"), (at + 1).cast("int"), F.lit(passage_chars)).alias("text"))
    order = F.xxhash64("doc_id", F.lit(7))
    light = rows.select("lang", "doc_id").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))).where(F.col("r") <= per_lang).select("lang", "doc_id").distinct()
    out: dict[str, list[str]] = {}
    for r in rows.join(F.broadcast(light), ["lang", "doc_id"]).orderBy("lang", order, "doc_id", "text").collect():  # per_lang documents a language
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def fitted(docs: DataFrame, *, per_lang: int = 40, passage_chars: int = 600) -> Model:
    """A model learned from documents whose crc32(doc_id) mod 3 is not 1: a passage of passage_chars characters of each of at
    most per_lang documents of each language. Reads text, lang and doc_id.

    Null and empty texts, null ids and null languages teach nothing; equal rows of a document count as often as they stand;
    an empty table gives a model without languages."""
    return trained(sampled_passages(docs, per_lang, passage_chars))


def identified(docs: DataFrame, model: Model, *, most_bytes: int = 1 << 30) -> DataFrame:
    """docs with a struct column (lang_pred, score) appended under a free name like `language`.

    Null texts and texts without a letter are `und` with score 0, as are all texts for a model without
    languages. score is the winner's share of 2 ** -(bits a character * min(characters, 64)). Ties go to the
    language that comes first in code point order. Texts of any length are parsed whole; repeated rows get the same
    result each; an empty table stays empty. Other columns pass, whatever their names.

    The model is broadcast, some five megabytes a language at the default sample; one of more than most_bytes is refused.
    """
    size = sum(t.table.nbytes for t in model.tables)
    if size > most_bytes:
        raise ValueError(f"a model of {len(model.langs)} languages and {size} bytes: learn from a smaller sample, or allow most_bytes")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = Parser(shared.value)
        for texts in parts:
            langs, scores = [], []
            for at in range(0, len(texts), 1000):
                a, b = parser.predict(list(texts.iloc[at : at + 1000]))
                langs += a
                scores += b
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn(fresh(docs, "language"), run("text"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identified(docs.select("doc_id", "text"), fitted(docs))
    return out.select("doc_id", F.coalesce(crc_of_id() % 3 == 1, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")
