"""The url filter recomputed plainly: every split of short names, every Bayes sum, very long words and hosts, ties of rules."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import urls

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"))
LONG = "donaudampfschifffahrtsgesellschaft"


def words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def best_split(piece, counts):
    """All splits, by cost; of equal costs the one whose last part begins latest, then the part before it, and so on."""
    total = max(sum(counts.values()), 1)
    cost = lambda w: math.log(counts[w] / total) if w in counts else -math.log(total) - len(w) * math.log(10)
    found = []
    for cuts in itertools.product([0, 1], repeat=len(piece) - 1):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(piece)]
        parts = [piece[a:b] for a, b in zip(at, at[1:])]
        found.append((sum(cost(w) for w in parts), parts))
    top = max(c for c, _ in found)
    return [p for c, p in found if c > top - 1e-9]


@pytest.fixture(scope="module")
def pages(spark):
    draw = np.random.default_rng(1)
    stems = ["sky", "blue", "lake", "sun", "sea", "skylake", "a", "bl"]
    rows = []
    for k in range(160):
        host = "".join(draw.choice(stems, int(draw.integers(1, 4)))) + str(draw.choice([".com", ".net", ".org", "-x.example.com"]))
        path = str(draw.choice(["/es/", "/en/", "/", "/news/12", "/Blue_sky"]))
        rows.append((k, f"http://{host}{path}?q=1", f"<title>{' '.join(draw.choice(stems[:5], 4))} {LONG}</title>"))
    rows += [(200, f"http://{LONG}.org/", None), (201, "http://" + "q" * 300 + ".org/" + "p/" * 5000, ""), (202, None, None), (202, None, None), (None, "http://sky.net/es/", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("score", F.lit("mine")).withColumn("word", F.lit(1))


def test_segments_equal_every_split(spark, pages):
    counts = {r.word: r.n for r in urls.word_counts(pages).collect()}
    assert counts[LONG] == 160  # words of any length are counted
    names = ["bluesky", "skylake", "sunsea", "seabluexx", "zzz", "a", "blsky", "lakesunsky"]
    got = {r.piece: r.words for r in urls.segmented(spark.createDataFrame([(n,) for n in [*names, LONG, "x" * 300]], "piece string"), urls.word_counts(pages)).collect()}
    assert all(got[n] in best_split(n, counts) for n in names)
    assert got[LONG] == [LONG] and "".join(got["x" * 300]) == "x" * 300


def test_scores_equal_plain_sums(spark, pages):
    rows = [(r.page_id, r.host, r.path, r.rule, r.verdict, r.score) for r in urls.judged(pages, RULES).collect()]
    assert len(rows) == pages.count()
    counts = urls.word_counts(pages)
    pieces = sorted({w for r in rows for w in words(r[1])})
    split = {r.piece: r.words for r in urls.segmented(spark.createDataFrame([(p,) for p in pieces], "piece string"), counts).collect()}
    action = {rule: a for a, rule in RULES}

    def features(host, path):
        return [f"h:{w}" for p in words(host) for w in split[p]], ["p:" + (w if not w.isdigit() else "#") for w in words(path)]

    seen, decided = {"block": Counter(), "allow": Counter()}, Counter()
    for _, host, path, rule, _, _ in rows:
        if rule is not None:
            decided[action[rule]] += 1
            for part in features(host, path):
                seen[action[rule]].update(part)
    vocabulary = {w for _, h, p, *_ in rows for part in features(h, p) for w in part}
    size, sums = len(vocabulary), {a: sum(c.values()) for a, c in seen.items()}
    prior = math.log((decided["block"] + 1) / (decided["allow"] + 1))
    for _, host, path, rule, verdict, score in rows:
        want = prior
        for w in itertools.chain(*features(host, path)):
            if seen["block"][w] + seen["allow"][w]:
                want += math.log((seen["block"][w] + 1) / (sums["block"] + size)) - math.log((seen["allow"][w] + 1) / (sums["allow"] + size))
        assert score == pytest.approx(want, abs=1e-9) and verdict == (action[rule] if rule else "block" if want > 1e-12 else "allow")


def test_equal_rules_take_the_later_name(spark):
    rows = spark.createDataFrame([(1, "http://a.b.org/", "")], "page_id long, url string, html string")
    for rules in ((("block", "org/"), ("allow", "org/")), (("allow", "org/"), ("block", "org/"))):
        assert urls.judged(rows, rules).first().verdict == "block"
