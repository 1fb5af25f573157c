"""Quality, toxicity, language and BPE."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, quality, toxicity

LONG = "word " * 30000


def edge_docs(spark):
    return spark.createDataFrame([(1, "some words here"), (2, ""), (3, None), (4, LONG), (5, "\n\t \x00"), (5, "x"), (None, "no id"), (6, "a" * 100000)], "doc_id long, text string").withColumns({"score": F.lit("x"), "held_out": F.lit(1), "toxicity": F.lit(2), "quality": F.lit(3), "language": F.lit(4), "bpe": F.lit(5)})


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def separate(scores, y):
    s, y = np.asarray(scores), np.asarray(y)
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])


# ---- toxicity


def brute_segments(scores):
    """Maximal segments by definition: the best segment, then the same on either side."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return brute_segments(scores[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


def test_segments_equal_the_definition():
    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.choice([-3.1, -1.7, -0.3, 0.9, 2.3]) + rng.random() * 0.01 for _ in range(rng.randint(0, 25))]
        got = toxicity.segments(np.array(scores))
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re", "la", "so") for b in ("na", "to", "ri", "ma", "lu", "pe")]
    bad = ["vilebad", "vilework", "uglyrot", "uglyman", "grimfool"]
    out = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(rng.randint(3, 6)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        out.append((i, " ".join(words), y))
    return out


def test_toxicity_held_out_accuracy(spark):
    rows = toxic_corpus(700, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 2 or i < 50] + [(1, 1, rows[1][2]), (9999, 1, 1), (None, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()}
    out = [(got[i], y) for i, _, y in rows if crc(i, 5) == 0]
    assert np.mean([(s >= 0.5) == y for s, y in out]) > 0.97


def test_log_odds_equal_the_formula():
    """Each token by itself, from plain counts."""
    rows = toxic_corpus(120, 4)
    docs, y = [t.split() for _, t, _ in rows], np.array([k for *_, k in rows])
    corpus = toxicity.Corpus(docs)
    at = np.flatnonzero(np.arange(len(y)) % 3)
    table, lexicon = corpus.lexicon(at, y)
    n1, n0 = int(y[at].sum()), int((1 - y[at]).sum())
    n, prior = n1 + n0, max(10.0, 0.02 * (n1 + n0))

    def odds(a, b, least):
        if a + b < least:
            return 0.0
        p, q = (a + prior * (a + b) / n) / (n1 + prior), (b + prior * (a + b) / n) / (n0 + prior)
        dev = 2 * sum(x * math.log(x * n / ((a + b) * m)) for x, m in ((a, n1), (b, n0)) if x)
        d = math.log(p / (1 - p)) - math.log(q / (1 - q))
        return d * (1 - toxicity.CAUTION**2 / dev) if dev > toxicity.CAUTION**2 else 0.0

    held = lambda k, test: sum(any(map(test, docs[i])) for i in at if y[i] == k)
    word = {w: odds(held(1, lambda v, w=w: v == w), held(0, lambda v, w=w: v == w), 2) for w in corpus.words}
    clean = {w: held(0, lambda v, w=w: v == w) for w in corpus.words}
    stem = {s: max(0.0, odds(held(1, lambda v, s=s: len(v) >= 6 and v[:4] == s), held(0, lambda v, s=s: len(v) >= 6 and v[:4] == s), 5)) for s in {w[:4] for w in corpus.words if len(w) >= 6}}
    used = [w for i in at if not y[i] for w in docs[i]]
    drift = max(0.05, 2 * sum(max(0.0, word[w]) for w in used) / len(used))
    want = [(word[w] if word[w] or clean[w] >= 3 else stem[w[:4]] / 2 if len(w) >= 6 else 0.0) - drift for w in corpus.words]
    assert np.allclose(table, want) and np.allclose(lexicon.scores(corpus.words), want)
    assert max(word.values()) > 1


def test_calibration_equals_its_definition():
    rng = np.random.default_rng(4)
    scores = [rng.choice([-0.4, -0.1, 0.6], p=[0.6, 0.2, 0.2], size=rng.integers(20, 200)) for _ in range(80)]
    model = toxicity.calibrated(toxicity.Model(toxicity.Lexicon({}, {}, 0.0)), [*scores, np.empty(0)])
    flat = np.concatenate(scores)
    scale = toxicity.karlin(flat)
    assert abs(np.mean(np.exp(scale * flat)) - 1) < 1e-6 and model.scale == min(1.0, scale)
    best = [max((s for *_, s in brute_segments(list(x))), default=0.0) for x in scores[:20]]
    again = toxicity.calibrated(toxicity.Model(toxicity.Lexicon({}, {}, 0.0)), scores[:20])
    assert abs(again.log_k - (np.mean([again.scale * b - math.log(len(x)) for b, x in zip(best, scores[:20], strict=True)]) - 0.5772)) < 1e-9


def test_logistic_curve_is_the_best_one():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=400), rng.uniform(0.5, 3, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(int)
    loss = lambda a, b: (w * np.logaddexp(0, np.where(y == 1, -1, 1) * (a * x + b))).sum() + 5e-4 * (a * a + b * b)
    a, b = toxicity.logistic(x, y, w)
    assert all(loss(a, b) <= loss(a + da, b + db) for da, db in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)))


def test_toxicity_on_documents_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.scored(docs, toxicity.fitted(docs, labels)).join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id")
    out = [(r["s"], r["y"]) for r in got.select("doc_id", F.col("toxicity.score").alias("s"), "y").collect() if crc(r["doc_id"], 5) == 0]
    assert np.mean([(s >= 0.5) == y for s, y in out]) > 0.95


def test_long_documents_teach_too(spark):
    rows = [(i, "vilebad " + "bana " * 6000 if i % 2 else "good day to all " + "bana " * 6000) for i in range(60)]
    labels = [(i, 1, i % 2) for i in range(60)]
    model = toxicity.fitted(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.lexicon["vilebad"] > 1


def test_toxic_spans(spark):
    rows = toxic_corpus(400, 2)
    model = toxicity.trained([t for _, t, _ in rows], [y for *_, y in rows])
    text = "bana " * 100 + "vilebad uglyrot vilework " + "bana " * 300
    row = toxicity.scored(spark.createDataFrame([(text,)], "text string"), model, spans=True).collect()[0]["toxicity"]
    assert [(s["start"], s["end"]) for s in row["spans"]] == [(100, 103)] and row["score"] > 0.5


def test_toxicity_edges(spark):
    model = toxicity.trained(["bad bad", "good", "fine", "bad man"] * 5, [1, 0, 0, 1] * 5)
    df = edge_docs(spark)
    out = toxicity.scored(df, model)
    assert out.columns[:-1] == df.columns and out.count() == 8
    assert all(0 <= r[0]["score"] <= 1 for r in out.select(F.col(out.columns[-1])).collect())
    assert toxicity.scored(df.where("doc_id > 99"), model).count() == 0
    empty = toxicity.fitted(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert 0 <= empty.score([])[0] <= 1


# ---- quality


def test_quality_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fitted(docs, labels)
    got = quality.scored(docs, model).join(labels.select("doc_id", F.col("quality").alias("y")), "doc_id")
    rows = got.select("doc_id", F.col("quality.score").alias("s"), "y").collect()
    out = [(r["s"], r["y"]) for r in rows if crc(r["doc_id"], 5) == 0]
    assert separate(*zip(*out, strict=True)) > 0.97
    assert np.mean([(s >= 0.3) == y for s, y in out]) > 0.95


def random_model(rng):
    f = lambda *shape: rng.normal(0, 0.3, shape)
    w = quality.WIDTH
    return quality.Model(np.zeros(w), np.ones(w), f(w, 5), f(5), f(5, 4), f(5, 4), f(4, 1), f(5, 1), 0.3)


def plain_scores(m, bags):
    """The forward pass passage by passage."""
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    out = []
    for bag in bags:
        hs, es = [], []
        for x in bag:
            h = [math.tanh(sum(x[i] * m.w1[i, j] for i in range(len(x))) + m.b1[j]) for j in range(len(m.b1))]
            t = [math.tanh(sum(h[j] * m.v[j, g] for j in range(len(h)))) for g in range(m.v.shape[1])]
            s = [sigmoid(sum(h[j] * m.u[j, g] for j in range(len(h)))) for g in range(m.v.shape[1])]
            es.append(math.exp(sum(a * b * m.w[g, 0] for g, (a, b) in enumerate(zip(t, s, strict=True)))))
            hs.append(h)
        z = [sum(e * h[j] for e, h in zip(es, hs, strict=True)) / sum(es) for j in range(len(m.b1))]
        out.append(sigmoid(sum(a * m.c[j, 0] for j, a in enumerate(z)) + m.b))
    return out


def test_scores_equal_the_formula():
    rng = np.random.default_rng(3)
    m, bags = random_model(rng), [rng.normal(size=(k, quality.WIDTH)) for k in (1, 4, 2, 40)]
    p, _ = m.scores(np.concatenate(bags), np.array([0, 1, 5, 7]))
    assert np.allclose(p, plain_scores(m, bags))


def test_gradients_equal_differences():
    rng = np.random.default_rng(7)
    m, bags = random_model(rng), [rng.normal(size=(k, quality.WIDTH)) for k in (1, 3, 5)]
    x, starts, y, weight = np.concatenate(bags), np.array([0, 1, 4]), np.array([1, 0, 1]), np.array([0.2, 0.5, 0.3])

    def loss():
        p, _ = m.scores(x, starts)
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    got = quality.gradients(m, x, starts, y, weight)
    for name in ("w1", "b1", "v", "u", "w", "c"):
        part = getattr(m, name)
        for _ in range(6):
            at = tuple(rng.integers(n) for n in part.shape)
            part[at] += 1e-5
            up = loss()
            part[at] -= 2e-5
            down = loss()
            part[at] += 1e-5
            assert abs(got[name][at] - (up - down) / 2e-5) < 1e-7, name
    m.b += 1e-5
    up = loss()
    m.b -= 2e-5
    assert abs(got["b"] - (up - loss()) / 2e-5) < 1e-7


def test_training_learns():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(k, quality.WIDTH)).astype(np.float32) + 0.8 * (k % 2) for k in rng.integers(1, 6, 120)]
    y = [len(b) % 2 for b in bags]
    model = quality.trained(bags, y, epochs=25)
    starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))
    p, a = model.scores(np.concatenate(bags), starts)
    assert np.mean((p > 0.5) == np.array(y)) > 0.95
    assert np.allclose(np.add.reduceat(a, starts), 1, atol=1e-4)


def test_one_bad_passage_gets_the_attention():
    rng = np.random.default_rng(5)
    bags, y = [], []
    for i in range(300):
        b = rng.normal(size=(6, quality.WIDTH)).astype(np.float32)
        if i % 2:
            b[rng.integers(6), :10] += 3
        bags.append(b)
        y.append(i % 2)
    model = quality.trained(bags, y)
    p, a = model.scores(np.concatenate(bags), np.arange(0, 1800, 6))
    assert np.mean((p > 0.5) == np.array(y)) > 0.9
    hits = [a[6 * i : 6 * i + 6].argmax() == bags[i][:, :10].sum(axis=1).argmax() for i in range(1, 300, 2)]
    assert np.mean(hits) > 0.7


def test_quality_edges(spark):
    df = edge_docs(spark)
    model = quality.trained([quality.passages(t, quality.Words()) for t in ("a b", "|| | ##", "c d", "## ||")], [1, 0, 1, 0])
    out = quality.scored(df, model, attention=True)
    rows = out.select(F.col(out.columns[-1]).alias("q"), "text").collect()
    assert len(rows) == 8 and all(0 <= r["q"]["score"] <= 1 for r in rows)
    assert max(len(r["q"]["attention"]) for r in rows) == round(30000 / quality.PASSAGE)
    assert quality.scored(df.where("doc_id > 99"), model).count() == 0
    assert quality.fitted(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int, toxic int")) is not None


# ---- language


def cross_parse(text, sample):
    """Phrases of the greedy parse by definition, with unknown symbols ending a phrase."""
    n, i = 1, 0
    k = 0
    for k in range(len(text)):
        if text[i : k + 1] not in sample:
            n += 1
            i = k if text[k] in sample else k + 1
    return n


def test_phrases_equal_the_definition():
    rng = random.Random(6)
    samples = {lang: ["".join(rng.choice(alphabet) for _ in range(400))] for lang, alphabet in (("a", "abcde "), ("b", "abxyz "))}
    model = langid.trained(samples)
    parser = langid.Parser(model)
    joined = {lang: " ".join(langid.letters(t[0]).split()) for lang, t in samples.items()}
    texts = ["".join(rng.choice("abcdexyz ") for _ in range(n)) for n in (0, 1, 5, 60, 300)]
    coded = [parser.coded(t)[0] for t in texts]
    counts = parser.phrases(coded)
    back = {s: c for c, s in model.symbols.items()} | {1: " ", 0: "?"}
    for i, x in enumerate(coded):
        plain = "".join(back[int(s)] for s in x)
        if plain:
            assert counts[i].tolist() == [cross_parse(plain, joined[lang]) for lang in model.langs]


@pytest.mark.parametrize(("segment", "pieces"), [(16, 5), (512, 4096), (7, 1)])
def test_long_texts_are_parsed_whole(monkeypatch, segment, pieces):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    monkeypatch.setattr(langid, "PIECES", pieces)
    rng = random.Random(9)
    samples = {lang: ["".join(rng.choice(alphabet) for _ in range(700))] for lang, alphabet in (("a", "abcde "), ("b", "abxyz "), ("c", "ab "))}
    model = langid.trained(samples)
    parser, joined = langid.Parser(model), [" ".join(langid.letters(samples[g][0]).split()) for g in model.langs]
    texts = ["".join(rng.choice("abcdexyzq ") for _ in range(n)) for n in (3, 1300, 0, 700, 16, 17)] + [joined[0], joined[1] * 3, joined[2][40:] + "q" * 40 + joined[2]]
    coded = [parser.coded(t)[0] for t in texts]
    back = {s: c for c, s in model.symbols.items()} | {1: " ", 0: "?"}
    for x, found in zip(coded, parser.phrases(coded), strict=True):
        plain = "".join(back[int(s)] for s in x)
        assert found.tolist() == ([cross_parse(plain, j) for j in joined] if plain else [0] * 3)
    assert parser.phrases([parser.coded(joined[0])[0]])[0, 0] == 1


def test_every_letter_of_a_sample_counts():
    rng = random.Random(8)
    # three scripts of over 190 letters each: 260 syllables, 400 ideographs, 300 other ideographs; and Adlam, which has capitals beyond 0x3000
    scripts = {"am": range(0x1200, 0x1200 + 330), "ja": range(0x4E00, 0x4E00 + 400), "zh": range(0x6000, 0x6000 + 300), "ff": range(0x1E922, 0x1E944)}
    alphabets = {lang: [chr(p) for p in points if chr(p).isalpha()] for lang, points in scripts.items()}

    def words(lang, n):
        return " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 6))) for _ in range(n))

    samples = {lang: [words(lang, 900)] for lang in alphabets}
    model = langid.trained(samples)
    joined = {lang: " ".join(langid.letters(t[0]).split()) for lang, t in samples.items()}
    assert set(model.symbols) == set("".join(joined.values())) - {" "}
    parser = langid.Parser(model)
    texts = [(lang, words(lang, n)) for lang in alphabets for n in (1, 3, 40)] + [(None, words("ja", 5) + "x" + words("zh", 5) + "\u9fa5 a" + words("am", 9))]
    coded = [parser.coded(t)[0] for _, t in texts]
    back = {s: c for c, s in model.symbols.items()} | {1: " ", 0: "?"}
    for x, found in zip(coded, parser.phrases(coded), strict=True):
        assert found.tolist() == [cross_parse("".join(back[int(s)] for s in x), joined[lang]) for lang in model.langs]
    got, _ = parser.predict([t for _, t in texts])
    assert [(g, lang) for g, (lang, _) in zip(got, texts, strict=True) if lang and g != lang] == []
    assert parser.predict([words("ff", 9).upper()])[0] == ["ff"]
    # a sample a tenth as long neither loses its own texts nor wins those of the others
    parser = langid.Parser(langid.trained({lang: [words(lang, 300 if lang == "zh" else 3000)] for lang in ("am", "ja", "zh")}))
    texts = [(lang, words(lang, 30)) for lang in ("am", "ja", "zh") for _ in range(20)]
    assert parser.predict([t for _, t in texts])[0] == [lang for lang, _ in texts]


def test_suffix_automaton_holds_all_substrings():
    text = [int(c) for c in "0110100110010110"]
    a = langid.Automaton(iter(text))

    def holds(part):
        s = 0
        for c in part:
            if c not in a.next[s]:
                return False
            s = a.next[s][c]
        return True

    parts = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    assert all(map(holds, parts)) and len(a.next) <= 2 * len(text)
    assert not holds((0, 0, 0))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identified(docs, langid.fitted(docs)).select("doc_id", "lang", "language.lang_pred").collect()
    held = [r for r in out if crc(r["doc_id"], 3) == 1]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98


def test_sample_is_spread_over_all_documents(spark):
    ids = [i for i in range(200) if crc(i, 3) != 1][:40]
    marks = {i: chr(0x4E00 + i) for i in ids}
    docs = spark.createDataFrame([(i, "xx", marks[i] * 3000) for i in ids], "doc_id long, lang string, text string")
    assert set(langid.fitted(docs).symbols) == set(marks.values())
    # what stands for a document may come from anywhere in it: its passages are numbered in letters
    parts = spark.createDataFrame([(i, "xx", "".join(chr(0x5000 + p) * 50 for p in range(40))) for i in ids], "doc_id long, lang string, text string")
    taken = {t[0] for t in langid.sampled_passages(parts, 40, 50)["xx"]}
    assert len(taken) > 15 and all(t == t[0] * 50 for t in langid.sampled_passages(parts, 40, 50)["xx"])
    assert sum(map(len, langid.sampled_passages(parts, 7, 50)["xx"])) == 350
    last = spark.createDataFrame([(ids[0], "xx", "a" * 5)], "doc_id long, lang string, text string")
    assert langid.sampled_passages(last, 40, 3)["xx"][0] in ("aaa", "aa") and langid.sampled_passages(last, 40, 5) == {"xx": ["aaaaa"]}
    with pytest.raises(ValueError, match="smaller sample"):
        langid.identified(docs, langid.fitted(docs), most_bytes=1000)


def test_language_edges(spark):
    model = langid.trained({"en": ["the cat and the dog"], "de": ["der Hund und die Katze"], "zh": ["我们 在 这里"]})
    df = edge_docs(spark).unionByName(edge_docs(spark).limit(1).withColumn("text", F.lit("我们在")))
    out = langid.identified(df, model)
    rows = [(r["text"], r[out.columns[-1]]) for r in out.collect()]
    assert [p["lang_pred"] for t, p in rows if not t or not any(c.isalpha() for c in t)] == ["und"] * 3
    assert [p["lang_pred"] for t, p in rows if t == "我们在"] == ["zh"]
    assert all(0 <= p["score"] <= 1 for _, p in rows)
    nothing = langid.fitted(df.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    out = langid.identified(df, nothing)
    assert {r["lang_pred"] for r in out.select(f"{out.columns[-1]}.*").collect()} == {"und"}
    assert langid.identified(df.where("doc_id > 99"), model).count() == 0


def test_repeated_rows_and_ties(spark):
    model = langid.trained({"b": ["same text here"], "a": ["same text here"]})
    rows = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (2, "zzz qqq")], "doc_id long, text string")
    got = langid.identified(rows, model).select("doc_id", "language.*").collect()
    assert [r["lang_pred"] for r in got] == ["a"] * 3 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    toxic = toxicity.trained(["bad bad", "good"] * 9, [1, 0] * 9)
    good = quality.trained([quality.passages(t, quality.Words()) for t in ("a b", "|| | ##")], [1, 0])
    for out in (toxicity.scored(rows, toxic), quality.scored(rows, good)):
        got = out.select("doc_id", F.col(out.columns[-1])["score"].alias("s")).collect()
        assert len(got) == 3 and len({r["s"] for r in got if r["doc_id"] == 1}) == 1


# ---- BPE

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", " ", "Hello  World's <|endoftext|> ΑΣ Σ İstanbul ﬁ 12 a b\ttest… é é", "<|startoftext|>x <|ENDOFTEXT|><|endoftext|>", "don't !!! 日本語 \U0001f600\x00\x01​� ", "a" * 500, "I'LL we'Ve 'S 'd'm", "ǅ ẞ Å Ω K ſ", "１２ ½ ² Ⅷ ٣", "<|endoftext", "x" * 3000 + "!" * 999, "ẛ̣ ̈́ क्षि ไทย 한국어"]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library():
    t, codec = reference(), bpe.Codec(bpe.Vocabulary.read(VOCABULARY), most_words=50)
    rng = random.Random(1)
    texts = HARD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x370, 0x500), rng.randrange(0x4E00, 0x4F00)])) for _ in range(60)) for _ in range(400)]
    for text in texts:
        ids = t.encode(text, add_special_tokens=False).ids
        assert list(codec.encode(text)) == ids, text
        assert codec.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_bpe_on_documents(spark, sf):
    t = reference()
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (None, LONG)], "doc_id long, text string"))
    out = bpe.encoded(df.withColumn("bpe", F.lit(1)), VOCABULARY, with_ids=True)
    for r in out.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        got = r[out.columns[-1]]
        assert (got["n_tokens"], got["ids"]) == (len(ids), ids)
        assert got["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encoded(df.where("doc_id > 10000000"), VOCABULARY).count() == 0


def test_other_vocabulary_files_are_refused(tmp_path):
    import json
    from pathlib import Path

    j = json.loads(Path(VOCABULARY).read_text())
    changes = {"normalizer": None, "decoder": {"type": "BPEDecoder"}, "pre_tokenizer": {"type": "Whitespace"}, "model": {**j["model"], "unk_token": "x"}, "added_tokens": [{**j["added_tokens"][0], "lstrip": True}]}
    for name, value in changes.items():
        (tmp_path / "v.json").write_text(json.dumps({**j, name: value}))
        with pytest.raises(ValueError, match=name):
            bpe.Vocabulary.read(str(tmp_path / "v.json"))
    with pytest.raises(ValueError, match="pre_tokenizer"):
        bpe.Vocabulary.read(VOCABULARY.replace("word_bpe_49k", "byte_bpe_50k"))
    # marks are found whatever they begin with
    added = [{**t, "content": t["content"].replace("<|", "[[")} for t in j["added_tokens"]]
    (tmp_path / "v.json").write_text(json.dumps({**j, "added_tokens": added}))
    codec = bpe.Codec(bpe.Vocabulary.read(str(tmp_path / "v.json")))
    assert added[1]["id"] in codec.encode(f"a {added[1]['content']} b")


def test_words_come_back():
    codec = bpe.Codec(bpe.Vocabulary.read(VOCABULARY))
    assert codec.text(codec.encode("Crème brûlée, 日本!")).split() == ["crème", "brûlée", ",", "日本", "!"]


def test_segment_tree_equals_plain_merging():
    rng = random.Random(5)
    merges = {(a, b): (rng.randrange(10**6), rng.randrange(6, 12)) for a in range(12) for b in range(12) if rng.random() < 0.4}

    def plain(s):
        s = list(s)
        while True:
            pairs = [(merges[p][0], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in merges]
            if not pairs:
                return s
            _, i = min(pairs)
            s[i : i + 2] = [merges[s[i], s[i + 1]][1]]

    for _ in range(500):
        word = [rng.randrange(6) for _ in range(rng.randint(0, 30))]
        assert bpe.merged(list(word), bpe.packed_merges(merges)) == plain(word)
