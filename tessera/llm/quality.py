"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded as a vector: hashed counts of its
words, and what they look like (length, letters, digits, marks, capitals, repetition). A passage vector h is
a learned projection; gated attention softmax(w . (tanh(V h) * sigmoid(U h))) weighs the passages of a
document, and a logistic unit scores the weighted representation. Everything is learned from document labels
alone, on the driver, from a bounded sample; the executors get the weights (under 100 kB).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out, labelled_texts, sampled_labels

PASSAGE, BUCKETS = 96, 96
_MARK = re.compile(r"[^\w\s]")
LOOKS = 14


def _look(word: str) -> list[float]:
    """What a word looks like, in LOOKS numbers."""
    n = len(word)
    letters = sum(c.isalpha() for c in word)
    digits = sum(c.isdigit() for c in word)
    marks = n - letters - digits
    tail = n - len(word.rstrip("".join({c for c in word if not c.isalnum()}))) if marks else 0
    return [
        1.0,
        min(n, 40) / 10,
        letters / n,
        digits / n,
        marks / n,
        float(letters == 0),
        float(word[0].isupper()),
        float(letters > 1 and word.isupper()),
        float(word[-1] in ".!?"),
        float(word[-1] in ",;:"),
        float(tail >= 2),
        float("|" in word or "_" in word),
        float("<" in word or ">" in word or "{" in word or "}" in word or "=" in word),
        float("@" in word or "://" in word or "www." in word),
    ]


class Words(dict):
    """A number for each word, with its hash bucket and looks in tables; starts anew after a fixed number of words."""

    MOST = 300_000

    def __init__(self):
        super().__init__()
        self.bucket, self.look = np.zeros(1024, np.int64), np.zeros((1024, LOOKS), np.float32)

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i >= len(self.bucket):
            self.bucket = np.concatenate([self.bucket, np.zeros_like(self.bucket)])
            self.look = np.concatenate([self.look, np.zeros_like(self.look)])
        self.bucket[i] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        self.look[i] = _look(word)
        self[word] = i
        return i

    def renewed(self) -> Words:
        return Words() if len(self) > self.MOST else self


WIDTH = BUCKETS + LOOKS + 3


def passages(text: str | None, known: Words) -> np.ndarray:
    """(passages, WIDTH) vectors of the whole text; one of zeros for a text without words."""
    words = (text or "").split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    n = len(ids)
    # passages of near equal length
    parts = max(1, round(n / PASSAGE))
    starts = np.arange(parts, dtype=np.int64) * n // parts
    owner = np.repeat(np.arange(parts), np.diff(np.append(starts, n)))
    size = np.bincount(owner, minlength=parts).astype(np.float32)[:, None]
    counts = np.bincount(owner * BUCKETS + known.bucket[ids], minlength=parts * BUCKETS).reshape(parts, BUCKETS).astype(np.float32)
    look = np.add.reduceat(known.look[ids], starts, axis=0) / size
    again = np.zeros(n, np.float32)
    again[1:] = ids[1:] == ids[:-1]
    repeat = np.add.reduceat(again, starts)[:, None] / size
    spread = (counts > 0).sum(axis=1, keepdims=True) / np.minimum(size, BUCKETS)
    return np.concatenate([np.sqrt(counts / size), look, repeat, spread, np.log(size) / 5], axis=1).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    std: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: float

    def scores(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag of passages, and the attention on each passage; bag i begins at row starts[i]."""
        f = _forward(self, (x - self.mean) / self.std, starts)
        return f["p"], f["a"][:, 0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(m: Model, x: np.ndarray, starts: np.ndarray) -> dict:
    size = np.diff(np.append(starts, len(x)))
    h = np.tanh(x @ m.w1 + m.b1)
    t, g = np.tanh(h @ m.v), _sigmoid(h @ m.u)
    e = (t * g) @ m.w
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts, axis=0), size, axis=0))
    a = e / np.repeat(np.add.reduceat(e, starts, axis=0), size, axis=0)
    z = np.add.reduceat(a * h, starts, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ m.c + m.b)[:, 0], "size": size}


def gradients(m: Model, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the weighted sum of the bags' log losses by each part of the model. x is already standardised."""
    f = _forward(m, x, starts)
    d = ((f["p"] - y) * weight)[:, None]
    out = {"c": f["z"].T @ d, "b": d.sum()}
    dz = np.repeat(d @ m.c.T, f["size"], axis=0)
    da = (dz * f["h"]).sum(axis=1, keepdims=True)
    mean_da = np.repeat(np.add.reduceat(f["a"] * da, starts, axis=0), f["size"], axis=0)
    de = f["a"] * (da - mean_da)
    tg = f["t"] * f["g"]
    out["w"] = tg.T @ de
    dt, dg = (de @ m.w.T) * f["g"] * (1 - f["t"] ** 2), (de @ m.w.T) * tg * (1 - f["g"])
    out["v"], out["u"] = f["h"].T @ dt, f["h"].T @ dg
    dh = (dz * f["a"] + dt @ m.v.T + dg @ m.u.T) * (1 - f["h"] ** 2)
    out["w1"], out["b1"] = x.T @ dh, dh.sum(axis=0)
    return out


def trained(bags: list[np.ndarray], labels: list[int], weights: np.ndarray | None = None, *, hidden: int = 24, gates: int = 12, epochs: int = 40, batch: int = 64, rate: float = 4e-3, seed: int = 3) -> Model:
    """A model of labelled bags, by Adam on the weighted log loss with a penalty on the weights."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    flat = np.concatenate(bags) if bags else np.zeros((1, WIDTH), np.float32)
    mean, std = flat.mean(axis=0), np.maximum(flat.std(axis=0), 0.02)
    scale = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b)).astype(np.float32)
    base = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    m = Model(mean, std, scale(WIDTH, hidden), np.zeros(hidden, np.float32), scale(hidden, gates), scale(hidden, gates), scale(gates, 1), np.zeros((hidden, 1), np.float32), float(np.log(base / (1 - base))))
    if not len(y) or y.min() == y.max():
        return m
    weight = np.ones(len(y), np.float32) if weights is None else weights.astype(np.float32)
    weight = weight / weight.mean()
    names = ["w1", "b1", "v", "u", "w", "c", "b"]
    first = {k: np.zeros_like(np.asarray(getattr(m, k), np.float32)) for k in names}
    second = {k: np.zeros_like(first[k]) for k in names}
    step = 0
    bags = [((b - mean) / std).astype(np.float32) for b in bags]
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x = np.concatenate([bags[i] for i in part])
            starts = np.concatenate(([0], np.cumsum([len(bags[i]) for i in part])[:-1]))
            grads = gradients(m, x, starts, y[part], weight[part] / len(part))
            step += 1
            now = rate * (1 - epoch / epochs)
            for k in names:
                value = np.asarray(getattr(m, k), np.float32)
                grad = grads[k] + (1e-4 * value if k not in ("b", "b1") else 0)
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                value = value - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(m, k, float(value) if k == "b" else value.astype(np.float32))
    return m


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Words()
    for batch in batches:
        bags = []
        for text in batch["text"]:
            known = known.renewed()
            bags.append(passages(text, known).tobytes())
        yield pd.DataFrame({"h": batch["h"], "y": batch["y"], "bag": bags})


def fitted(docs: DataFrame, labels: DataFrame, *, column: str = "quality", per_class: int = 2500) -> Model:
    """A model fitted on the driver on at most per_class labelled training documents of either class, with all their
    passages, as documents are scored. Classes keep their shares of the labels.

    Null and empty texts are one passage of zeros; null ids and labels are left out; a document labelled twice counts
    with its larger label, and one that is there twice counts twice. Without labels of both classes the model gives every
    document the share of label 1 (0.5 without any)."""
    rows = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(5, 0)).groupBy(column).count().collect()
    number = {int(r[column]): r["count"] for r in rows}
    texts = labelled_texts(docs, sampled_labels(labels, column, per_class))
    got = texts.select(F.xxhash64("doc_id", F.lit(3)).alias("h"), "y", "text").mapInPandas(_bags, "h long, y int, bag binary").toPandas()
    got = got.sort_values(["h", "y", "bag"])
    share = np.array([max(1.0, number.get(c, 0) / per_class) for c in (0, 1)])
    y = got["y"].to_numpy(int)
    return trained([np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got["bag"]], y.tolist(), share[y] if len(y) else None)


def scored(docs: DataFrame, model: Model, *, attention: bool = False) -> DataFrame:
    """docs with a struct column (score and, if asked for, the attention on each passage) appended under a free name
    like `quality`. Null and empty texts are one passage of zeros. Texts of any length count whole, repeated rows get the
    same score each, an empty table stays empty, other columns pass, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "score double" + ", attention array<float>" * attention

    @F.pandas_udf(schema)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Words()
        for texts in parts:
            out, weights = [], []
            for at in range(0, len(texts), 256):
                bags = []
                for text in texts.iloc[at : at + 256]:
                    known = known.renewed()
                    bags.append(passages(text, known))
                starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1])).astype(np.int64)
                p, a = shared.value.scores(np.concatenate(bags), starts)
                out += p.astype(float).tolist()
                weights += np.split(a, starts[1:])
            rows = {"score": out}
            if attention:
                rows["attention"] = weights
            yield pd.DataFrame(rows)

    return docs.withColumn(fresh(docs, "quality"), run("text"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "quality.score", (F.col("quality.score") >= 0.3).cast("int").alias("predicted"))
