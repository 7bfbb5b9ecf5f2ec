"""Toxicity by weak supervision: many voters, a generative label model of their votes, a linear classifier.

Clues of a word are the word and its beginnings of 4, 5 and 6 letters. Lexicons are mined, not written down: the clues that
labelled documents of label 1 hold far oftener than others (log-likelihood ratio and lift), split into lexicons by kind and number. A
lexicon votes toxic where a text has one of its clues. Further voters look at patterns of tokens (masked letters, drawn-out
letters, digits or signs for letters, shouting, heaps of exclamation marks), at several or dense clues, and, for clean, at
texts without any. Each voter votes one way or abstains.

The label model sees votes only, over all documents: the fractions and pairwise fractions of votes. If voters are independent
given the label, their correlations are the products v_j v_k of each voter's correlation with the label; v is fitted to the
pairs, the pairs that disagree most are taken for dependent and left out, and so on. v and the share of label 1 give how
often a voter votes on either side; the correlations left over say how far its vote repeats that of others, and weigh it down.

A document's posterior label comes from its votes. On at most ``max_labelled`` labelled documents a logistic regression is
fitted to posterior labels, over the clues that tell the sides apart; a fifth of them sets its temperature. Documents are
scored by it alone, so a text is judged by more clues than the lexicons hold.

Scale: lexicons and classifier come from a bounded sample (``max_labelled`` documents of the smallest hashes of their ids; of
texts with the same least hash of a window of ``WINDOW`` words, most of them near copies, one is taken); clues are counted by Spark and only the first ``ENTRIES`` and ``CLUES`` of them reach the driver.
Votes are summed in the tasks: a task sends one number for each pair of voters. All texts are read twice, whole.

Defined results: a null or empty text has no clues and scores what the intercept says. Without labels of both kinds every score is
the share of label 1 (0.5 without any). Repeated rows are scored each, also those with a null id; rows of ``labels``
without label or id are not used, and of labels repeated for an id the largest counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import Memo, text_batches
from framewright.session import materialise

LETTERS = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W\d_][*#@$%&]{2,}[^\W\d_]*$|[^\W\d_][*#@$%&]+[^\W\d_]")
DRAWN_OUT = re.compile(rb"([a-z])\1{3,}")
SIGNS_FOR_LETTERS = re.compile(r"[^\W\d_][013457$@]+[^\W\d_]")
STORM = re.compile(rb"[!?]{3,}")
# Marks that part tokens; those that may stand inside a masked or respelled word stay.
MARKS = bytes(32 if chr(c) in ".,;:!?\"()[]{}<>|/" else c for c in range(256))
CAPITALS = bytes(range(65, 91))
KINDS = (0, 4, 5, 6)  # the whole word, and beginnings of so many letters
SHARDS = 4  # lexicons of a kind
ENTRIES = 4096  # of all lexicons
CLUES = 8192  # of the classifier
STRONG = 15.1  # log-likelihood ratio beyond which chance gives one clue in ten thousand
LIFT = 10  # a lexicon's clues are so many times as frequent under label 1
WINDOW = 4  # words of the windows by which near copies are known
MASK, LONG, SIGN = (1 << k for k in range(3))
VOTERS = ([f"lexicon {('word', 'beginning')[size > 0]} {size or ''} {shard}" for size in KINDS for shard in range(SHARDS)]
          + ["two clues", "four clues", "dense clues", "masked", "drawn out", "signs", "storm", "shouting"]
          + ["no clue", "no word clue", "no clue in a long text", "no pattern"])
SIDE = np.array([1.0] * (len(VOTERS) - 4) + [-1.0] * 4)
FIRST = np.array([0.5] * (len(KINDS) * SHARDS + 3) + [0.1] * 5 + [-0.5] * 3 + [-0.1])


def clues_of(token: bytes) -> list[int]:
    """Numbers of a lower-case token's clues; the kind stands in the lowest two bits."""
    if token.isalpha():
        words = [(token, token)]
    else:
        words = [(w, w.encode("utf-8", "surrogatepass")) for w in LETTERS.findall(token.decode("utf-8", "surrogatepass"))]
    digest, out = xxhash.xxh3_64_intdigest, []
    for word, raw in words:
        out.append((digest(raw, 0) >> 1) & ~3)
        for kind in range(1, len(KINDS)):
            if len(word) <= KINDS[kind]:
                break
            part = word[: KINDS[kind]]
            out.append((digest(part if word is raw else part.encode("utf-8", "surrogatepass"), kind) >> 1) & ~3 | kind)
    return out


def flags_of(token: bytes) -> int:
    drawn = bool(DRAWN_OUT.search(token)) * LONG
    if token.isalpha():
        return drawn
    text = token.decode("utf-8", "surrogatepass")
    return drawn + bool(MASKED.search(text)) * MASK + bool(SIGNS_FOR_LETTERS.search(text)) * SIGN


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(MARKS).split()


class Voters:
    """The votes of a text, for given lexicon entries (numbers of clues)."""

    def __init__(self, entries: list[int]):
        entries = set(entries)

        def look(token: bytes) -> tuple[tuple[int, ...], int]:
            return tuple(c for c in clues_of(token) if c in entries), flags_of(token)

        self.seen = Memo(look)

    def votes(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(VOTERS), bool)
        tokens, lexicons = Counter(tokens_of(text)), len(KINDS) * SHARDS
        hits, words, dense, marked = set(), set(), 0, 0
        seen = self.seen
        for token, n in tokens.items():
            found, flags = seen[token]
            if found:
                hits.update(found)
                words.add(found[-1] >> 2)
                dense += n
            marked |= flags
        for c in hits:
            out[(c & 3) * SHARDS + (c >> 2) % SHARDS] = True
        total = sum(tokens.values())
        out[lexicons : lexicons + 3] = len(words) >= 2, len(words) >= 4, dense * 100 >= max(total, 1)
        raw = (text or "").encode("utf-8", "surrogatepass")
        upper, loud = len(raw) - len(raw.translate(None, CAPITALS)), bool(STORM.search(raw))
        shouting = upper > 20 and upper * 10 >= len(raw) * 3
        pattern = (bool(marked & MASK), bool(marked & LONG), bool(marked & SIGN), loud, shouting)
        out[lexicons + 3 : lexicons + 8] = pattern
        out[lexicons + 8 :] = not hits, not out[:SHARDS].any(), not hits and total >= 50, not any(pattern)
        return out


def likelihood_ratio(pos: np.ndarray, neg: np.ndarray, all_pos: float, all_neg: float) -> np.ndarray:
    """Signed log-likelihood ratio of clues found in ``pos`` of ``all_pos`` and ``neg`` of ``all_neg`` documents."""
    both, total = pos + neg, all_pos + all_neg

    def term(found, expected):
        return np.where(found > 0, found * np.log(np.maximum(found, 1e-12) / np.maximum(expected, 1e-12)), 0)

    parts = ((pos, both * all_pos), (neg, both * all_neg), (all_pos - pos, (total - both) * all_pos), (all_neg - neg, (total - both) * all_neg))
    g = 2 * sum(term(found, expected / total) for found, expected in parts)
    return np.where(pos * all_neg >= neg * all_pos, g, -g)


def _clue_counts(rows: DataFrame, judge, shared) -> DataFrame:
    """(clue, pos, neg): how many texts of ``rows`` (text, label) have a clue, by ``judge(text, label, shared value)`` in 0 to 1."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, extra = Memo(lambda t: tuple(clues_of(t)), 200_000), shared.value
        state: dict = {}
        for batch in batches:
            clues, shares = [np.zeros(0, np.int64)], [np.zeros(0)]
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.fromiter({c for t in set(tokens_of(text)) for c in memo[t]}, np.int64)
                clues.append(own)
                shares.append(np.full(len(own), judge(text, label, extra, state)))
            clue, place = np.unique(np.concatenate(clues), return_inverse=True)
            pos, n = np.bincount(place, np.concatenate(shares), len(clue)), np.bincount(place, minlength=len(clue))
            yield pa.RecordBatch.from_arrays([pa.array(clue), pa.array(pos), pa.array(n - pos)], ["clue", "pos", "neg"])

    found = rows.select("text", "label").mapInArrow(counted, "clue long, pos double, neg double")
    return found.groupBy("clue").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


@F.arrow_udf(T.LongType())
def least_window(texts: pa.Array) -> pa.Array:
    """The least hash of a text's windows; near copies mostly share it."""
    out = []
    for text in texts.to_pylist():
        words = (text or "").split()
        number = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        size = min(WINDOW, len(words))
        value = np.zeros(max(len(words) - size + 1, 1), np.uint64)
        for k in range(size):
            value = (value ^ number[k : len(words) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        out.append(int(value.min() >> np.uint64(1)))
    return pa.array(out, pa.int64())


def _ratio(pos: float, neg: float) -> Column:
    """``likelihood_ratio`` as a column; both totals are above 0."""
    def term(found, expected):
        return F.when(found > 0, found * F.log(found / expected)).otherwise(0.0)

    p, n, total = F.col("pos"), F.col("neg"), pos + neg
    both = p + n
    g = 2 * (term(p, both * pos / total) + term(n, both * neg / total) + term(pos - p, (total - both) * pos / total) + term(neg - n, (total - both) * neg / total))
    return F.when(p * neg >= n * pos, g).otherwise(-g)


def vote_sums(docs: DataFrame, entries: list[int], text: str = "text") -> tuple[int, np.ndarray]:
    """The number of all texts, and how many of them each pair of voters votes on."""
    shared, m = docs.sparkSession.sparkContext.broadcast(entries), len(VOTERS)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, sums, n = Voters(shared.value), np.zeros((m, m), np.int64), 0
        for batch in batches:
            if batch.num_rows:
                votes = np.stack([voters.votes(t) for t in batch.column(0).to_pylist()]).astype(np.int64)
                sums += votes.T @ votes
                n += len(votes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, m * m)), pa.array(np.append(n, sums.ravel()))], ["cell", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(summed, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(m * m + 1, np.int64)
    out[rows.column("cell").to_numpy() + 1] = rows.column("n").to_numpy()
    return int(out[0]), out[1:].reshape(m, m)


def label_model(n: int, sums: np.ndarray, prior: float, rounds: int = 8, apart: float = 0.08) -> dict:
    """Of each voter how often it votes on either side (``on``, ``off``) and how far its vote counts (``weight``), from pairwise votes."""
    m = len(sums)
    mean = np.diag(sums) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 0))
    active = (np.diag(sums) >= 3) & (np.diag(sums) <= n - 3) if n else np.zeros(m, bool)
    scale = np.where(active, spread, 1)
    r = np.where(np.outer(active, active), (sums / max(n, 1) - np.outer(mean, mean)) / np.outer(scale, scale), 0)
    used = np.outer(active, active) & ~np.eye(m, dtype=bool)
    v = np.where(active, FIRST, 0.0)
    for _ in range(rounds):
        for _ in range(50):
            for j in np.flatnonzero(active):
                below = (used[j] * v * v).sum()
                if below > 1e-9:
                    v[j] = SIDE[j] * min(max(SIDE[j] * (used[j] * r[j] * v).sum() / below, 0.0), 0.98)
        left = np.where(used, np.abs(r - np.outer(v, v)), 0)
        # The most dependent pairs leave, but each voter keeps three partners.
        worst = np.argwhere(np.triu(left) > max(apart, np.quantile(left[used], 0.9) if used.any() else 1))
        gone = 0
        for j, k in sorted(worst.tolist(), key=lambda p: -left[p[0], p[1]]):
            if used[j].sum() > 3 and used[k].sum() > 3:
                used[j, k] = used[k, j] = False
                gone += 1
        if not gone:
            break
    side = math.sqrt(max(prior * (1 - prior), 1e-9))
    moved = v * spread / side
    on = np.clip(mean + moved * (1 - prior), 1e-4, 1 - 1e-4)
    off = np.clip(mean - moved * prior, 1e-4, 1 - 1e-4)
    within = np.sqrt(np.maximum(1 - v * v, 0.02))
    rest = np.where(np.outer(active, active), (r - np.outer(v, v)) / np.outer(within, within), 0)
    np.fill_diagonal(rest, 1)
    weight = np.clip(np.linalg.solve(np.clip(np.abs(rest), 0, 1) * (1 - 0.1 * ~np.eye(m, dtype=bool)) + 0.05 * np.eye(m), np.ones(m)), 0.02, 1)
    return {"prior": prior, "on": on, "off": off, "weight": np.where(active, weight, 0), "accuracy": v, "correlation": rest}


def posterior(votes: np.ndarray, model: dict) -> float:
    """The probability of label 1 given the votes of a text."""
    on, off = model["on"], model["off"]
    each = np.where(votes, np.log(on / off), np.log((1 - on) / (1 - off)))
    p = min(max(model["prior"], 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-min(max(math.log(p / (1 - p)) + float(model["weight"] @ each), -30), 30)))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray, size: int, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float, float]:
    """Weights, intercept and temperature of a logistic regression on sets of clue places, labels in 0 to 1."""
    weights = np.zeros(size)
    if not len(y) or y.max() - y.min() < 1e-3:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return weights, math.log(share / (1 - share)), 1.0
    order = np.random.default_rng(11).permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]

    def flat(chosen):
        return np.concatenate([rows[i] for i in chosen]).astype(np.int64), np.repeat(np.arange(len(chosen)), [len(rows[i]) for i in chosen])

    place, own = flat(used)
    theta, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = np.bincount(own, theta[place], len(used)) + theta[-1]
        wrong = (_logistic(z) - y[used]) / len(used)
        slope = np.append(np.bincount(place, wrong[own], size) + decay * theta[:-1], wrong.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    temperature = 1.0
    if len(held):
        place, own = flat(held)
        z = np.bincount(own, theta[place], len(held)) + theta[-1]

        def loss(t: float) -> float:
            p = np.clip(_logistic(z / t), 1e-9, 1 - 1e-9)
            return -(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean()

        temperature = float(min(np.geomspace(0.25, 4, 33), key=loss))
    return theta[:-1], float(theta[-1]), temperature


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", max_labelled: int = 12_000) -> dict:
    """Lexicons and classifier from the rows of ``labels`` (at most ``max_labelled``), the label model from votes on all ``docs``."""
    spark = docs.sparkSession
    text_batches(spark)
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    # At most max_labelled rows of two numbers: a broadcast of known size.
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    chosen = docs.select("doc_id", F.col(text).cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    first = F.struct(F.xxhash64("text").alias("h"), "text", "label")
    sample = materialise(chosen.groupBy(least_window(F.col("text")).alias("w")).agg(F.min(first).alias("s")).select("s.text", "s.label"), "labelled")
    counts = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    plain = {"clues": np.zeros(0, np.int64), "weights": np.zeros(0), "intercept": 0.0, "temperature": 1.0, "label_model": None, "entries": []}
    if not pos or not neg:
        share = min(max(pos / (pos + neg) if pos + neg else 0.5, 1e-6), 1 - 1e-6)
        return plain | {"intercept": math.log(share / (1 - share))}
    nothing = spark.sparkContext.broadcast(None)
    ratio = _clue_counts(sample, lambda text, label, extra, state: float(label), nothing)
    ratio = ratio.where(F.col("pos") * neg >= (F.col("neg") + 0.5) * pos * LIFT).select("clue", _ratio(float(pos), float(neg)).alias("g"))
    entries = [r.clue for r in ratio.where(F.col("g") >= STRONG).orderBy(F.col("g").desc(), "clue").limit(ENTRIES).collect()]
    prior = pos / (pos + neg)
    model = label_model(*vote_sums(docs, entries, text), prior)
    shared = spark.sparkContext.broadcast((entries, model))

    def judged(text, label, extra, state):
        if "voters" not in state:
            state["voters"] = Voters(extra[0])
        return posterior(state["voters"].votes(text), extra[1])

    weighed = materialise(_clue_counts(sample, judged, shared), "clues")
    n = pos + neg

    @F.arrow_udf(T.DoubleType())
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        state: dict = {}
        for texts in batches:
            yield pa.array([judged(t, None, shared.value, state) for t in texts.to_pylist()], pa.float64())

    y = np.array([r.y for r in sample.select(judge(F.col("text")).alias("y")).collect()])
    share = float(np.clip(y.sum(), 1e-3, n - 1e-3))
    telling = weighed.where(F.col("pos") + F.col("neg") >= 3).select("clue", F.abs(_ratio(share, n - share)).alias("g"))
    clues = np.sort(np.array([r.clue for r in telling.orderBy(F.col("g").desc(), "clue").limit(CLUES).collect()], np.int64))
    places = spark.sparkContext.broadcast(clues)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = _places(places.value)
        for texts in batches:
            yield pa.array([sorted({p for t in set(tokens_of(x)) for p in memo[t]}) for x in texts.to_pylist()], pa.list_(pa.int32()))

    rows = sample.select(judge(F.col("text")).alias("y"), found(F.col("text")).alias("x"), F.xxhash64("text").alias("h")).toArrow()
    order = np.argsort(rows.column("h").to_numpy(), kind="stable")
    x, y = rows.column("x").to_pylist(), rows.column("y").to_numpy()
    weights, intercept, temperature = fit([np.array(x[i], np.int64) for i in order], y[order], len(clues))
    return {"clues": clues, "weights": weights, "intercept": intercept, "temperature": temperature, "label_model": model, "entries": entries}


def _places(clues: np.ndarray) -> Memo:
    """Token to the places of its clues in the classifier."""
    place = {c: k for k, c in enumerate(clues.tolist())}
    return Memo(lambda token: tuple(place[c] for c in clues_of(token) if c in place))


def score(docs: DataFrame, model: dict, text: str = "text") -> Column:
    """The probability of label 1 for a text column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("clues", "weights", "intercept", "temperature")})

    @F.arrow_udf(T.DoubleType())
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        memo, weights = _places(m["clues"]), m["weights"].tolist()
        for texts in batches:
            sums = [sum(weights[p] for p in sorted({p for t in set(tokens_of(x)) for p in memo[t]})) for x in texts.to_pylist()]
            yield pa.array(_logistic((np.array(sums, np.float64) + m["intercept"]) / m["temperature"]), pa.float64())

    return judge.asNondeterministic()(F.col(text))
