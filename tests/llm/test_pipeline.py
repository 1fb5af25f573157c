"""The pipeline against a brute-force version, and the registry."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tessera.llm import bpe, mixing, near_dedup, registry, toxicity


def test_registry():
    names = list(registry.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(registry.ORACLES) <= set(names)
    found = __spark_entry__.queries()
    assert set(names) | {"pipeline"} <= set(found)
    assert len(corpus_pipeline.STAGES) == 5


def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        out.append(docs.cache())
    return out


def test_each_stage_equals_its_brute_force_version(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages_ = dict(corpus_pipeline.STAGES)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]

    def stored(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    # toxicity: the model's own scores, one by one
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = stored(stages_["toxicity"](spark, docs, sf), "a")
    assert kept.columns == columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    want = {i for i, r in rows.items() if model.score(toxicity.tokens(r["text"] or ""))[0] < 0.5}
    assert {r["doc_id"] for r in kept.collect()} == want

    # exact copies: the largest id of each text
    unique = stored(stages_["exact_dedup"](spark, kept, sf), "b")
    last = {}
    for i in sorted(want):
        last[rows[i]["text"] or ""] = i
    assert unique.columns == columns and {r["doc_id"] for r in unique.collect()} == set(last.values())

    # near copies: all pairs of shingle sets
    near = stored(stages_["near_dedup"](spark, unique, sf), "c")
    words = near_dedup._Words()
    sets = {i: set(near_dedup.shingle_set(rows[i]["text"], 5, words).tolist()) for i in last.values()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    stay = {i for i in sets if find(i) == i}
    assert near.columns == columns and {r["doc_id"] for r in near.collect()} == stay

    # the mix: words of each source, whole documents but for the last
    mix = stored(stages_["mixing"](spark, near, sf), "d")
    sizes = Counter()
    for i in stay:
        sizes[rows[i]["source"]] += len(rows[i]["text"].split())
    target = {s: int(t) for s, _, t in mixing.targets(list(sizes.items()))}
    got, cut = Counter(), defaultdict(int)
    for r in mix.collect():
        got[r["source"]] += len(r["text"].split())
        assert rows[r["doc_id"]]["text"].startswith(r["text"])
        assert r["n_chars"] == len(r["text"])
        cut[r["source"]] += r["text"] != rows[r["doc_id"]]["text"]
    assert dict(got) == {s: t for s, t in target.items() if t} and max(cut.values()) <= 1

    # tokens: document by document
    import public_tokenizers

    codec = bpe.Codec(bpe.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json")))
    tokens = stages_["bpe"](spark, mix, sf).collect()
    want = Counter((r["doc_id"], hashlib.sha256(codec.encode(r["text"]).tobytes()).hexdigest()) for r in mix.collect())
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in tokens) == want


def test_run_equals_its_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, stages(spark, sf)[-1].collect()))


def test_pipeline_takes_nulls_and_nothing(spark, sf, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", None, None, 5), (3, "a b c", None, None, 5), (None, "x y", "de", "t", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for name, rows in (("some", docs), ("none", docs.where(F.lit(False)))):
        d = str(tmp_path / name)
        rows.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        got = corpus_pipeline.run(spark, d).count()
        assert got >= 2 if name == "some" else got == 0
