"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-gram buckets are exact over all training rows. The model is a matrix of
log-probabilities, ``BUCKETS`` rows by at most ``max_languages`` columns, so its broadcast
size has a fixed bound. A batch of texts is scored as a sparse matrix: the bucket numbers of
all its n-grams in one array, cut by text, times the matrix.

Defined results: a null text, or one without a letter, is ``und`` with score 0. If no
language could be learned, ``lang_pred`` is null with score 0. Equal scores take the
alphabetically first language. Repeated rows are scored each; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import text_batches

LENGTHS = (1, 2, 3)
BUCKETS = 1 << 16
BLOCK = 400_000  # code points scored at once
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _pieces(texts: Iterable[str | None]) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """Blocks of text pieces, each with the number of its text and how many n-grams may start in it.

    A long text is cut into pieces that overlap by the longest n-gram less one.
    """
    over = max(LENGTHS) - 1
    parts, rows, own, held = [], [], [], 0
    for row, text in enumerate(texts):
        text = (text or "").lower()
        for at in range(0, len(text), BLOCK):
            parts.append(text[at : at + BLOCK + over])
            rows.append(row)
            own.append(min(BLOCK, len(text) - at))
            held += len(parts[-1])
            if held >= BLOCK:
                yield parts, rows, own
                parts, rows, own, held = [], [], [], 0
    if parts:
        yield parts, rows, own


def _buckets(parts: list[str], own: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram length the bucket at every code point (BUCKETS where none starts), and the piece starts."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    place = np.arange(len(codes))
    left = np.repeat(ends, sizes) - place
    owned = place - np.repeat(starts, sizes) < np.repeat(own, sizes)
    found = np.full((len(LENGTHS), len(codes)), BUCKETS, np.int64)
    key = np.zeros(len(codes), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        key = key * _STEP
        key[: len(codes) - n + 1] += codes[n - 1 :]
        if n in LENGTHS:
            hashed = ((key + np.uint64(n)) * _STEP) >> np.uint64(48)
            found[LENGTHS.index(n)] = np.where(owned & (left >= n), hashed.astype(np.int64), BUCKETS)
    return found, starts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def out():
        for lang, sums in held.items():
            hit = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit)), pa.array(hit.astype(np.int32)), pa.array(sums[hit])],
                                             ["lang", "bucket", "n"])
        held.clear()

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            if lang not in held and len(held) >= 64:
                yield from out()
            sums = held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            mine = [texts[i] for i in np.flatnonzero(langs == lang)]
            for parts, _, own in _pieces(mine):
                found = _buckets(parts, own)[0].ravel()
                sums[:BUCKETS] += np.bincount(found, minlength=BUCKETS + 1)[:BUCKETS]
            sums[BUCKETS] += len(mine)  # documents, for the prior
    yield from out()


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", max_languages: int = 400, smoothing: float = 0.5) -> dict:
    """The model of all ``rows`` whose language is not null; over ``max_languages`` of them is an error."""
    text_batches(rows.sparkSession)
    rows = rows.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(max_languages + 1).collect())
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    counts = np.zeros((BUCKETS + 1, len(langs)))
    if langs:
        summed = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        place = {x: i for i, x in enumerate(langs)}
        at = np.array([place[x] for x in summed.column("lang").to_pylist()])
        counts[summed.column("bucket").to_numpy(), at] = summed.column("n").to_numpy()
    grams, documents = counts[:BUCKETS] + smoothing, counts[BUCKETS]
    matrix = np.zeros((BUCKETS + 1, len(langs)))
    matrix[:BUCKETS] = np.log(grams) - np.log(grams.sum(0))
    return {"langs": langs, "matrix": matrix, "prior": np.log(documents / max(documents.sum(), 1))}


def scored(texts: list[str | None], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The best language's number and its posterior probability for each text."""
    matrix = model["matrix"]
    sums = np.tile(model["prior"], (len(texts), 1))
    for parts, rows, own in _pieces(texts):
        found, starts = _buckets(parts, own)
        for buckets in found:
            np.add.at(sums, rows, np.add.reduceat(matrix[buckets], starts, axis=0))
    best = sums.argmax(1)
    weights = np.exp(sums - sums.max(1, keepdims=True))
    return best, weights[np.arange(len(best)), best] / weights.sum(1)


def identified(docs: DataFrame, model: dict, text: str = "text") -> Column:
    """A struct column ``lang_pred``, ``score`` for a text column of ``docs``."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def identify(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = shared.value
        for texts, lettered in batches:
            judged = np.array(lettered.to_pylist(), dtype=bool)
            names, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            if not model["langs"]:
                names[judged] = None
            elif judged.any():
                best, sure = scored([t for t, j in zip(texts.to_pylist(), judged) if j], model)
                names[judged], score[judged] = np.array(model["langs"], dtype=object)[best], sure
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], ["lang_pred", "score"])

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return identify.asNondeterministic()(F.col(text), lettered)
