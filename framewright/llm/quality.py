"""Document quality: random-indexing word vectors, pooled, and a two-layer network.

Random indexing: every word number has a sparse vector of +1 and -1; a word's vector is the sum
of those of its neighbours over the whole corpus. Words are hashed to ``WORDS`` numbers, so the
sums (exact integers, merged by block of numbers) and their broadcast have a fixed size.

A document is described by mean and deviation of its word vectors, the mean index vector of its
tokens' shapes (letter case, digits, punctuation, a repeat of the token before), and its length.
The network is fitted with numpy on at most ``max_labelled`` labelled documents, those of the
smallest hashes of their ids; a part of them, not used for fitting, sets the temperature.

Defined results: a null or empty text is scored from a description of zeros. Without labels of
both kinds every score is the share of label 1 (0.5 without any). Repeated rows are scored each;
rows of ``labels`` without a label or an id are not used, and of labels repeated for an id the smallest counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import Memo, text_batches

WORDS, SHAPES, DIM, SHAPE_DIM, TERMS = 1 << 14, 1 << 12, 64, 32, 4
BLOCK = 256  # word numbers whose sums travel together
REACH = 2
TOKENS = 1 << 16
_PART = 1 << 20
_SHAPE = bytes.maketrans(bytes(range(256)), bytes(88 if 65 <= c <= 90 else 120 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in range(256)))
_RUN = re.compile(rb"(.)\1+")
_EDGE = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _number(token: bytes) -> int:
    """A token's word number and shape number in one integer."""
    shape = _RUN.sub(rb"\1", token.translate(_SHAPE))
    return xxhash.xxh3_64_intdigest(token.strip(_EDGE).lower()) % WORDS * SHAPES + xxhash.xxh3_64_intdigest(shape) % (SHAPES // 2)


_numbers = Memo(_number, 200_000)


def index_vectors(count: int, dim: int, seed: int) -> np.ndarray:
    """TERMS entries of +1 or -1 in each of ``count`` vectors."""
    draw = np.random.default_rng(seed)
    out = np.zeros((count, dim), np.int16)
    places = draw.random((count, dim)).argsort(1)[:, :TERMS]
    np.put_along_axis(out, places, draw.choice([-1, 1], (count, TERMS)).astype(np.int16), 1)
    return out


def token_parts(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and shape numbers of a text in parts of TOKENS tokens at most."""
    raw, at, before = (text or "").encode("utf-8", "surrogatepass"), 0, -1
    while at < len(raw):
        end = raw.find(b" ", at + _PART)
        end = len(raw) if end < 0 else end
        tokens = raw[at:end].split()
        both = np.fromiter(map(_numbers.__getitem__, tokens), np.int64, len(tokens))
        for k in range(0, len(both), TOKENS):
            part = both[k : k + TOKENS]
            same = part == np.concatenate(([before], part[:-1]))
            before = part[-1]
            yield part // SHAPES, part % SHAPES + same * (SHAPES // 2)
        at = end


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = index_vectors(WORDS, DIM, 1)
    sums, seen = np.zeros((WORDS, DIM), np.int64), np.zeros(WORDS, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for words, _ in token_parts(text):
                seen += np.bincount(words, minlength=WORDS)
                own = index[words]
                near = np.zeros_like(own)
                for d in range(1, REACH + 1):
                    near[d:] += own[:-d]
                    near[:-d] += own[d:]
                order = np.argsort(words, kind="stable")
                words = words[order]
                first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
                sums[words[first]] += np.add.reduceat(near[order], first, axis=0, dtype=np.int64)
    for block in range(WORDS // BLOCK):
        part = slice(block * BLOCK, (block + 1) * BLOCK)
        if seen[part].any():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.column_stack((sums[part], seen[part])).tobytes()], pa.binary())], ["block", "sums"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[block] = held.get(block, 0) + np.frombuffer(raw, np.int64)
    for block, total in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([total.tobytes()], pa.binary())], ["block", "sums"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """WORDS unit vectors: the mean neighbour of each word, less that of all words."""
    text_batches(docs.sparkSession)
    ddl = "block long, sums binary"
    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_sums, ddl).repartition("block").mapInArrow(_merge, ddl).collect()
    sums = np.zeros((WORDS, DIM + 1))
    for block, raw in parts:
        sums[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(raw, np.int64).reshape(BLOCK, DIM + 1)
    seen = sums[:, DIM:]
    mean = sums[:, :DIM] / np.maximum(seen, 1)
    mean -= (sums[:, :DIM].sum(0) / max(seen.sum(), 1)) * (seen > 0)
    return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def described(text: str | None, vectors: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    n, first, second, form = 0, np.zeros(DIM), np.zeros(DIM), np.zeros(SHAPE_DIM)
    for words, kinds in token_parts(text):
        own = vectors[words]
        n += len(words)
        first += own.sum(0)
        second += np.einsum("ij,ij->j", own, own)
        form += np.bincount(kinds, minlength=SHAPES) @ shapes
    if not n:
        return np.zeros(2 * DIM + SHAPE_DIM + 1)
    mean = first / n
    return np.concatenate((mean, np.sqrt(np.maximum(second / n - mean * mean, 0)), form / n, [np.log1p(n)]))


def _probabilities(x: np.ndarray, net: dict) -> np.ndarray:
    hidden = np.maximum((x - net["mean"]) / net["scale"] @ net["w1"] + net["b1"], 0)
    return 1 / (1 + np.exp(-np.clip((hidden @ net["w2"] + net["b2"]) / net["temperature"], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> dict:
    """A two-layer network by Adam on four fifths of the rows, its temperature by the likelihood of the rest."""
    net = {"mean": np.zeros(x.shape[1]), "scale": np.ones(x.shape[1]), "w1": np.zeros((x.shape[1], hidden)), "b1": np.zeros(hidden),
           "w2": np.zeros(hidden), "b2": 0.0, "temperature": 1.0}
    if len(set(y.tolist())) < 2:
        share = min(max(y.mean() if len(y) else 0.5, 1e-6), 1 - 1e-6)
        net["b2"] = np.log(share / (1 - share))
        return net
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    net["mean"], net["scale"] = x[used].mean(0), x[used].std(0) + 1e-6
    z = (x - net["mean"]) / net["scale"]
    net["w1"], net["w2"] = draw.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), draw.normal(0, np.sqrt(1 / hidden), hidden)
    names, step = ("w1", "b1", "w2", "b2"), 0
    moved, spread = {k: 0.0 for k in names}, {k: 0.0 for k in names}
    for _ in range(epochs):
        draw.shuffle(used)
        for at in range(0, len(used), batch):
            rows = used[at : at + batch]
            inner = z[rows] @ net["w1"] + net["b1"]
            act = np.maximum(inner, 0)
            wrong = (1 / (1 + np.exp(-np.clip(act @ net["w2"] + net["b2"], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(wrong, net["w2"]) * (inner > 0)
            slopes = {"w1": z[rows].T @ back + decay * net["w1"], "b1": back.sum(0), "w2": act.T @ wrong + decay * net["w2"], "b2": wrong.sum()}
            step += 1
            for k in names:
                moved[k] = 0.9 * moved[k] + 0.1 * slopes[k]
                spread[k] = 0.999 * spread[k] + 0.001 * slopes[k] ** 2
                net[k] = net[k] - rate * (moved[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)
    if len(held):
        def loss(t: float) -> float:
            p = np.clip(_probabilities(x[held], net | {"temperature": t}), 1e-9, 1 - 1e-9)
            return -(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean()

        net["temperature"] = min(np.geomspace(0.25, 8, 41), key=loss)
    return net


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", max_labelled: int = 12_000) -> dict:
    """Word vectors of all ``docs`` and a network fitted on the rows of ``labels`` (at most ``max_labelled`` of them)."""
    vectors, shapes = word_vectors(docs, text), index_vectors(SHAPES, SHAPE_DIM, 2).astype(np.float64)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, shapes))

    @F.arrow_udf(T.BinaryType())
    def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([described(t, *shared.value).tobytes() for t in texts.to_pylist()], pa.binary())

    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    # At most max_labelled rows of two numbers: a broadcast of known size.
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", F.col(text).cast("string").alias("text")).join(F.broadcast(known), "doc_id").select(
        "doc_id", "label", describe(F.col("text")).alias("x")).toArrow().to_pydict()
    order = np.argsort(np.array(rows["doc_id"], np.int64), kind="stable")
    x = np.array([np.frombuffer(rows["x"][i]) for i in order]).reshape(len(order), 2 * DIM + SHAPE_DIM + 1)
    return {"vectors": vectors, "shapes": shapes, "net": fit(x, np.array(rows["label"], np.float64)[order])}


def score(docs: DataFrame, model: dict, text: str = "text") -> Column:
    """The probability of label 1 for a text column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            x = np.array([described(t, m["vectors"], m["shapes"]) for t in texts.to_pylist()])
            yield pa.array(_probabilities(x, m["net"]) if len(x) else [], pa.float64())

    return judge.asNondeterministic()(F.col(text))
