"""Collocations, importance resampling and toxicity against plain versions, with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.llm import collocations, resampling, toxicity
from framewright.llm.queries import op11_toxicity, op13_resampling

LANGS = "doc_id long, text string, lang string"


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def plain_collocations(rows, least, top=2000):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for at in range(len(words) - size + 1):
                    f[lang, tuple(words[at : at + size])] += 1
    often = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    gone, out = set(), {}
    for (lang, words), a in often.items():
        for size in range(2, len(words)):
            for at in range(len(words) - size + 1):
                inner = words[at : at + size]
                if 100 * a >= 80 * f[lang, inner]:
                    gone.add((lang, inner))
    for (lang, words), a in often.items():
        if (lang, words) not in gone:
            score, k = min((2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def crowd(seed, docs, words=30):
    draw = np.random.default_rng(seed)
    vocabulary = [f"v{k}" for k in range(12)] + ["Éa", "a\x01b", "a\x00", "naïve", "ß"]
    weights = np.array([1 / (k + 1) for k in range(len(vocabulary))])
    rows = []
    for k in range(docs):
        words_of = draw.choice(vocabulary, int(draw.integers(0, words)), p=weights / weights.sum())
        gaps = draw.choice([" ", "  ", "\t", ". ", ", ", "\n"], len(words_of), p=[0.7, 0.05, 0.05, 0.1, 0.05, 0.05])
        rows.append((k, "".join(w + g for w, g in zip(words_of, gaps)), ["de", "fr", None][k % 3]))
    hot = " ".join(["new york city hall"] * 400)
    return rows + [(900, None, "de"), (901, "", None), (902, " \t\n.", "fr"), (903, hot, "en"), (903, hot, "en"), (None, hot + " of", "en"), (904, "x y " * 15_000, "en")]


@pytest.mark.parametrize("least,tasks", [(30, 1 << 20), (7, 40)])
def test_collocations(spark, monkeypatch, least, tasks):
    monkeypatch.setattr(collocations, "TASK_ROWS", tasks)  # few rows a task: most phrases lie across tasks
    rows = crowd(1, 120)
    docs = spark.createDataFrame(rows, LANGS).withColumn("n", F.lit("mine")).withColumn("phrase", F.lit(1))
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=least).collect())
    assert got == plain_collocations([r[1:] for r in rows], least)
    assert len(got) > 5 and collocations.collocations(docs, least=least, top=3).groupBy("lang").count().where("count > 3").count() == 0


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], LANGS)
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "a b", "de"), (2, None, None)], LANGS)).count() == 0


def test_quicksort_counts_every_prefix():
    draw = np.random.default_rng(3)
    table = np.vstack([draw.integers(0, 2, 3000), draw.integers(0, 4, (4, 3000))])
    for k in range(3, 5):
        table[k][draw.random(3000) < 0.2] = -1
        table[k][table[k - 1] < 0] = -1
    n = draw.integers(1, 5, 3000)
    got = {(d, tuple(table[: d + 1, p])): w for d, p, w in collocations.quicksorted(table, n, 40)}
    want = Counter()
    for row, c in zip(table.T, n.tolist()):
        for d in range(2, 5):
            if row[d] >= 0:
                want[d, tuple(row[: d + 1])] += c
    assert {k: w for k, w in got.items() if w >= 40} == {k: w for k, w in want.items() if w >= 40}
    ends = {tuple(min(map(tuple, table.T))), tuple(max(map(tuple, table.T)))}
    assert all(any(e[: d + 1] == p for e in ends) for (d, p), w in got.items() if w < 40)


def plain_resampling(docs, items, longest, buckets, least_words, seed=2024):
    def spans(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text))
        return words, [zlib.crc32(" ".join(words[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(words) - n + 1)]

    s, t = (Counter(b for x in texts for b in spans(x)[1]) for texts in ([d[1] for d in docs], items))
    every_s, every_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (every_s + buckets)) / ((s[b] + 1) * (every_t + buckets)))) for b in range(buckets)]
    rows = []
    for d, text in docs:
        words, found = spans(text)
        weight, score = sum(gain[b] for b in found), None
        if d is not None:
            h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(words), len(found), weight, score, None])
    able = sorted((r for r in rows if r[4] is not None and r[1] >= least_words), key=lambda r: (-r[4], r[0]))
    for rank, row in enumerate(able[: len(able) * 10 // 100], 1):
        row[5] = rank
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(spark, longest):
    rows = [r[:2] for r in crowd(2, 150)] + [(k, "One TWO three É4 " * 6) for k in (950, 951, 951)] + [(960, "w " * 40_000)]
    items = ["one two three", None, "v1 v2-v3 naïve"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("score", F.lit("mine")).withColumn("rank", F.lit(0))
    target = spark.createDataFrame([(x,) for x in items], "text string")
    found = resampling.resampled(docs, target, longest=longest, buckets=97, least_words=4)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_resampling(rows, items, longest, 97, 4)
    kept = resampling.drawn(docs, target, longest=longest, buckets=97, least_words=4)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in found.where("rank is not null").collect()}


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id long, text string")
    assert resampling.resampled(none, none).count() == 0
    assert sorted(((r.doc_id, r.n_features, r.rank) for r in resampling.resampled(some, none).collect()), key=str) == [(1, 0, None), (2, 0, None), (None, 3, None)]


def test_features_in_small_parts(monkeypatch):
    texts = pa.array(["b a", None, "", "--", "Ä b a b", "a"] * 3)
    whole = resampling.features(texts, 1000, 1, 2)
    monkeypatch.setattr(resampling, "PART", 3)
    parts = [resampling.features(t, 1000, 1, 2) for _, t in resampling._blocks(texts)]
    assert all(np.array_equal(w, np.concatenate(p)) for w, p in zip(whole, zip(*parts)))


def test_label_model_finds_accuracies_and_correlations():
    """Votes drawn from known rates, two voters being copies of each other."""
    draw, n, m = np.random.default_rng(4), 60_000, len(toxicity.VOTERS)
    y = draw.random(n) < 0.15
    on, off = np.where(toxicity.SIDE > 0, 0.35, 0.3), np.where(toxicity.SIDE > 0, 0.02, 0.9)
    votes = np.where(y[:, None], draw.random((n, m)) < on, draw.random((n, m)) < off)
    votes[:, 1] = votes[:, 0]
    sums = votes.astype(np.int64).T @ votes.astype(np.int64)
    model = toxicity.label_model(n, sums, 0.15)
    assert np.abs(model["on"] - on).max() < 0.06 and np.abs(model["off"] - off).max() < 0.03
    assert model["correlation"][0, 1] > 0.9 and model["weight"][0] < 0.7 < np.delete(model["weight"], [0, 1]).min()
    shares = np.array([toxicity.posterior(v, model) for v in votes[:3000]])
    assert ((shares > 0.5) == y[:3000]).mean() > 0.97


def plain_score(text, model):
    place = {c: k for k, c in enumerate(model["clues"].tolist())}
    found = {place[c] for t in toxicity.tokens_of(text) for c in toxicity.clues_of(t) if c in place}
    z = sum(model["weights"][p] for p in sorted(found)) + model["intercept"]
    return 1 / (1 + math.exp(-max(-30, min(30, z / model["temperature"]))))


def test_toxicity(spark):
    draw = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(500):
        words = [f"w{x}" for x in draw.integers(0, 300, int(draw.integers(1, 60)))]
        bad = k % 5 == 0
        if bad:
            words.insert(int(draw.integers(0, len(words) + 1)), f"{'grumpf' if k % 2 else 'snarkel'}{'aeiou'[int(draw.integers(5))]}")
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    rows += [(600, None), (601, ""), (None, "w1 grumpfx w2"), (602, "w5 " * 30_000 + "snarkely"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("label", F.lit(7))
    known = spark.createDataFrame(labels + [(3, None), (None, 1), (5, 0)], "doc_id long, toxic int").where("doc_id is null or doc_id % 3 <> 1")
    model = toxicity.learn(docs, known)
    got = [(r.doc_id, r.text, r.s) for r in docs.select("doc_id", "text", toxicity.score(docs, model).alias("s")).collect()]
    assert len(got) == len(rows) and all(abs(s - plain_score(t, model)) < 1e-9 for _, t, s in got)
    right = [(s >= 0.7) == (d % 5 == 0) for d, _, s in got if d is not None and d < 500 and d % 3 == 1]
    assert np.mean(right) > 0.98
    assert all(s >= 0.7 for d, t, s in got if d in (None, 602)) and all(s < 0.7 for d, t, s in got if d in (600, 601))
    assert model["label_model"]["on"].max() > 0.3
    # Votes of all documents, counted again by a plain loop.
    voters = toxicity.Voters(model["entries"])
    n, sums = toxicity.vote_sums(docs, model["entries"])
    votes = np.array([voters.votes(t) for _, t in rows]).astype(int)
    assert n == len(rows) and np.array_equal(sums, votes.T @ votes)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0.5), ([(1, 0)], 1e-6), ([(1, 1), (2, 1)], 1 - 1e-6)):
        model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [pytest.approx(want)] * 2 == [r.s for r in docs.select(toxicity.score(docs, model).alias("s")).collect()]
    none = docs.limit(0)
    assert none.select(toxicity.score(none, toxicity.learn(none, spark.createDataFrame([], "doc_id long, toxic int")))).count() == 0


def test_queries_carry_the_contract(spark):
    folder = "/root/testdata/sf0.001"
    toxic = op11_toxicity(spark, folder)
    assert toxic.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert op13_resampling(spark, folder).count() == toxic.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
