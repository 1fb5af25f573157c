"""Toxicity by maximum-scoring segments.

Every token carries a score: the log-odds that a toxic rather than a clean document holds it, smoothed by a
Dirichlet prior in proportion to the token's overall frequency, shrunk towards 0 by how little its deviance
exceeds chance, less a small drift. All maximal segments of positive total are found in one pass in linear time. The significance of
a segment follows the extreme-value law of random sequences: lambda solves sum p(s) exp(lambda s) = 1 over the
token scores of clean text, K comes from the maxima of clean documents. A document's evidence is the sum of
what its significant segments exceed chance by, and a logistic curve fitted out of fold turns it into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out, labelled_texts, sampled_labels

_TOKEN = re.compile(r"[^\W_]+")
#: A token that was too rare to be scored goes by its first STEM letters, at half their score.
STEM, LONG = 4, 6
#: Standard deviations of deviance up to which a log-odds counts as chance.
CAUTION = 3.3


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, total) of a sequence, in linear time.

    Only tokens of positive score can begin or end one, so runs of others enter as one sum."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at end, nearest earlier one with a smaller sum before
    for at in up.tolist():
        start, end, low, high = at, at + 1, float(total[at]), float(total[at + 1])
        back = len(kept) - 1
        while True:
            while back >= 0 and kept[back][2] >= low:
                back = kept[back][4]
            if back < 0 or kept[back][3] >= high:
                kept.append((start, end, low, high, back))
                break
            start, low = kept[back][0], kept[back][2]
            del kept[back:]
            back -= 1
    return [(s, e, h - l) for s, e, l, h, _ in kept]


class Lexicon(dict):
    """Score of each token; those not stated are scored by their stem and remembered up to a fixed number."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], drift: float):
        super().__init__({w: s - drift for w, s in words.items()})
        self.stated, self.stems, self.drift, self.size = dict(self), stems, drift, len(words)

    def __missing__(self, word: str) -> float:
        if len(self) > self.size + 100_000:
            self.clear()
            self.update(self.stated)
        got = (self.stems.get(word[:STEM], 0.0) / 2 if len(word) >= LONG else 0.0) - self.drift
        self[word] = got
        return got

    def scores(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))

    def __reduce__(self):
        return (_lexicon, ({w: s + self.drift for w, s in self.stated.items()}, self.stems, self.drift))


def _lexicon(words, stems, drift):
    return Lexicon(words, stems, drift)


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, least: int = 2) -> np.ndarray:
    """Cautious log-odds of features, from the numbers of documents of either class that hold each; 0 for features that
    fewer than `least` documents hold, and for those whose deviance from equal rates may be chance."""
    n = n_toxic + n_clean
    prior = max(10.0, 0.02 * n)
    both = toxic + clean
    extra = prior * both / n
    p, q = (np.minimum((x + extra) / (size + prior), 1 - 1e-9) for x, size in ((toxic, n_toxic), (clean, n_clean)))
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.log(p / (1 - p)) - np.log(q / (1 - q))
        # deviance of the two counts from equal rates; it holds for counts of 0, where a normal error does not
        deviance = 2 * sum(np.where(x > 0, x * np.log(x * n / (both * size)), 0.0) for x, size in ((toxic, n_toxic), (clean, n_clean)) if size)
        return np.where((both >= least) & (deviance > CAUTION**2), d * (1 - CAUTION**2 / deviance), 0.0)


class Corpus:
    """Labelled documents as numbers: the words of each in order, the distinct ones, and the distinct beginnings of long ones."""

    def __init__(self, docs: list[list[str]]):
        index: dict[str, int] = {}
        starts: dict[str, int] = {}
        self.docs = [np.fromiter((index.setdefault(w, len(index)) for w in d), np.int64, len(d)) for d in docs]
        self.words = list(index)
        self.start = np.array([starts.setdefault(w[:STEM], len(starts)) if len(w) >= LONG else -1 for w in self.words], np.int64)
        self.starts = list(starts)
        self.kinds = [np.unique(d) for d in self.docs]
        self.kinds_of_start = [np.unique(x[x >= 0]) for x in (self.start[k] for k in self.kinds)]

    def held(self, lists: list[np.ndarray], rows: np.ndarray, size: int) -> np.ndarray:
        """How many of the documents `rows` have each number in their list."""
        return np.bincount(np.concatenate([lists[i] for i in rows] or [np.empty(0, np.int64)]), minlength=size).astype(np.float64)

    def lexicon(self, rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, Lexicon]:
        """Scores learned from the documents `rows`: of each word of the corpus, and as a lexicon."""
        toxic, clean = rows[y[rows] == 1], rows[y[rows] == 0]
        a, b = (self.held(self.kinds, r, len(self.words)) for r in (toxic, clean))
        odds = log_odds(a, b, len(toxic), len(clean))
        # tokens that are not rare are settled, even at 0
        settled = (odds != 0) | (b >= 3)
        # only toxic stems: a token that is merely unknown shall not speak for a document
        stems = np.maximum(log_odds(*(self.held(self.kinds_of_start, r, len(self.starts)) for r in (toxic, clean)), len(toxic), len(clean), least=5), 0.0)
        used = np.concatenate([self.docs[i] for i in clean] or [np.empty(0, np.int64)])
        drift = max(0.05, 2 * float(np.maximum(odds, 0.0)[used].sum()) / max(1, len(used)))
        table = np.where(settled, odds, np.where(self.start >= 0, np.append(stems, 0.0)[self.start] / 2, 0.0)) - drift
        words = {self.words[i]: float(odds[i]) for i in np.flatnonzero(settled)}
        return table, Lexicon(words, {self.starts[i]: float(stems[i]) for i in np.flatnonzero(stems)}, drift)


@dataclass
class Model:
    lexicon: Lexicon
    scale: float = 1.0  # lambda
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    seen: dict = field(default_factory=dict)

    def evidence(self, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """Sum of -log E over significant segments (E < 1) of a document's token scores, and those segments."""
        if not len(scores):
            return 0.0, []
        chance = self.log_k + math.log(len(scores))
        found = [(s, e, self.scale * x - chance) for s, e, x in segments(scores)]
        found = [f for f in found if f[2] > 0]
        return sum(f[2] for f in found), found

    def score(self, words: list[str]) -> tuple[float, list[tuple[int, int, float]]]:
        x, found = self.evidence(self.lexicon.scores(words))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log1p(x) + self.offset)))), found


def karlin(scores: np.ndarray) -> float:
    """lambda > 0 with mean exp(lambda * score) = 1; 1 if no score is positive."""
    if not len(scores) or scores.max() <= 0 or scores.mean() >= 0:
        return 1.0
    values, counts = np.unique(scores, return_counts=True)
    p = counts / counts.sum()
    low, high = 0.0, 50.0 / values.max()
    for _ in range(80):
        mid = (low + high) / 2
        if (p * np.exp(np.minimum(mid * values, 600))).sum() > 1:
            high = mid
        else:
            low = mid
    return max(1e-3, (low + high) / 2)


def calibrated(model: Model, scored: list[np.ndarray]) -> Model:
    """lambda and K from the token scores of clean documents.

    Scores that are log-odds of one token law against the one that clean documents follow have a lambda of 1. The prior draws scores
    towards 0, and a fitted lambda would stretch them back beyond what the labels say, so 1 is the most that is taken."""
    scored = [s for s in scored if len(s)]
    if scored:
        model.scale = min(1.0, karlin(np.concatenate(scored)))
        # mean of a Gumbel law: lambda * S - log n = log K + Euler's constant
        top = [model.scale * max((x for _, _, x in segments(s)), default=0.0) - math.log(len(s)) for s in scored]
        model.log_k = float(np.mean(top)) - 0.5772
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted, slightly penalised logistic regression, by Newton's method."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * (p - y)) + 1e-3 * w
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def trained(texts: list[str], labels: list[int], shares: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model of labelled texts. shares: how many documents of the corpus each row of label 0 and 1 stands for.
    The logistic curve sees every text as scored by a lexicon that was made without it (three folds)."""
    y = np.array(labels, int)
    if not len(y) or y.min(initial=1) == y.max(initial=0):
        base = float(y.mean()) if len(y) else 0.5
        return Model(Lexicon({}, {}, 0.05), offset=math.log((base + 1e-3) / (1 - base + 1e-3)))
    corpus, fold, x = Corpus([tokens(t) for t in texts]), np.arange(len(y)) % 3, np.zeros(len(y))

    def model(rows: np.ndarray) -> tuple[np.ndarray, Model]:
        table, lexicon = corpus.lexicon(rows, y)
        return table, calibrated(Model(lexicon), [table[corpus.docs[i]] for i in rows if not y[i]])

    for k in range(3):
        table, part = model(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            x[i] = math.log1p(part.evidence(table[corpus.docs[i]])[0])
    _, out = model(np.arange(len(y)))
    out.slope, out.offset = logistic(x, y, np.where(y == 1, shares[1], shares[0]))
    return out


def fitted(docs: DataFrame, labels: DataFrame, *, column: str = "toxic", per_class: int = 3000) -> Model:
    """A model fitted on the driver on at most per_class labelled training documents of either class, each whole.
    Training rows are those whose crc32(doc_id) mod 5 is not 0.

    Null texts count as empty; null ids and labels are left out; a document labelled twice counts with its larger label,
    and one that is there twice counts twice. Without labels of both classes the model gives every document the share
    of label 1 (0.5 without any)."""
    rows = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(5, 0)).groupBy(column).count().collect()
    number = {int(r[column]): r["count"] for r in rows}
    sample = sampled_labels(labels, column, per_class)
    got = labelled_texts(docs, sample).select("text", "y", F.xxhash64("doc_id", F.lit(5)).alias("h")).toPandas().sort_values(["h", "text"])
    share = tuple(max(1.0, number.get(c, 0) / per_class) for c in (0, 1))
    return trained(got["text"].tolist(), got["y"].tolist(), share)


def scored(docs: DataFrame, model: Model, *, spans: bool = False) -> DataFrame:
    """docs with a struct column (score and, if asked for, spans: start and end token and significance of each toxic
    passage) appended under a free name like `toxicity`. Null and empty texts get the score of no evidence. Texts of any
    length count whole, repeated rows get the same score each, an empty table stays empty, other columns pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "score double" + ", spans array<struct<start: int, end: int, significance: double>>" * spans

    @F.pandas_udf(schema)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in parts:
            out = [m.score(tokens(t or "")) for t in texts]
            rows = {"score": [s for s, _ in out]}
            if spans:
                rows["spans"] = [[{"start": a, "end": b, "significance": x} for a, b, x in f] for _, f in out]
            yield pd.DataFrame(rows)

    return docs.withColumn(fresh(docs, "toxicity"), run("text"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "toxicity.score", (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"))
