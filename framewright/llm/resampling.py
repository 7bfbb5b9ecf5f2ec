"""Importance resampling towards a target distribution, over hashed n-grams, with Arrow kernels.

A text is lower-cased (A-Z) and split into words; its features are all runs of ``shortest`` to ``longest`` words,
repeats counted. Words of a batch are dictionary-encoded, so a run is a row of shifted dictionary indices
and only distinct runs are written out and hashed (crc32 modulo ``buckets``). Counts of buckets over all source and all
target texts give each bucket a gain, the logarithm of the smoothed ratio of the two shares in thousandths, floored.
A document's weight is the sum of its features' gains. Gumbel noise from a hash of the document's id makes the
highest scores a draw without replacement in proportion to exp(weight / 1000).

Scale: both passes go through the texts where they lie; what travels is one row of counts for each task and bucket
(the number of buckets is fixed), and the gains, an array of that length, are broadcast. The draw is ordered by ranges of
(score, doc_id), so it may be as large as the corpus: a place is the count of the ranges before it and the place within its own.

Defined results: null and empty texts have no features, weight 0, and are never drawn where ``least_words`` is above 0.
Repeated rows count each. Rows with a null doc_id are weighed but have no noise, hence a null score, and are neither counted
in N nor drawn. Equal scores go by the smaller doc_id; rows that repeat a doc_id with one score are ranked in any
order among themselves. Without source or target texts the counts are 0 and smoothing alone gives the gains.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import text_batches
from framewright.session import materialise

# A word is a run of ASCII letters and digits and of all characters beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PART = 1 << 22  # bytes of text that are split at once
LEAST_WORDS = 20


def _lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one array, and how many each text has."""
    # A text may begin or end with a gap, which leaves an empty word at its edge.
    split = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), GAP)
    words, sizes = pc.list_flatten(split), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    upto = np.concatenate(([0], np.cumsum(real)))
    ends = np.cumsum(sizes)
    return words.filter(pa.array(real)), upto[ends] - upto[ends - sizes]


def _blocks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a batch with about PART bytes of text each, one text at least."""
    texts = texts.cast(pa.large_string())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > PART:
            yield at, texts.slice(at, k - at)
            at, held = k, 0
        held += n
    if at < len(texts):
        yield at, texts.slice(at)


def features(texts: pa.Array, buckets: int, shortest: int = 1, longest: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features text by text, how many features each text has, and how many words."""
    words, sizes = _lists(texts)
    coded = words.dictionary_encode()
    spelled = [w.encode() for w in coded.dictionary.to_pylist()]
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(index))  # words from here to the text's end
    runs, names = index, spelled
    found, owners = [], []
    for n in range(1, longest + 1):
        if n > 1:
            # A run of n words is a run of n - 1 and the word behind it: a pair of indices.
            begins = np.flatnonzero(left >= n)
            pairs, place = np.unique(runs[begins] * len(spelled) + index[begins + n - 1], return_inverse=True)
            names = [names[p // len(spelled)] + b" " + spelled[p % len(spelled)] for p in pairs.tolist()]
            runs = np.zeros(len(index), np.int64)
            runs[begins] = place
        if n >= shortest:
            begins = np.flatnonzero(left >= n)
            hashed = pa.array(np.fromiter((zlib.crc32(name) % buckets for name in names), np.int64, len(names)))
            found.append(hashed.take(pa.array(runs[begins])).to_numpy(zero_copy_only=False))
            owners.append(own[begins])
    bucket, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable") if len(found) > 1 else slice(None)
    return bucket[order], np.bincount(owner, minlength=len(sizes)), sizes


def bucket_counts(docs: DataFrame, buckets: int, shortest: int, longest: int, text: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket; a task sends one row for a bucket it met."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _blocks(batch.column(0)):
                total += np.bincount(features(texts, buckets, shortest, longest)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    text_batches(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored gain of each bucket in thousandths."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + len(s))) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, shortest: int, longest: int, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row of ``docs``."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _blocks(batch.column(1)):
                bucket, counts, words = features(texts, buckets, shortest, longest)
                upto = np.concatenate(([0], np.cumsum(shared.value.take(bucket))))
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *map(pa.array, (words, counts, upto[ends] - upto[ends - counts]))],
                                                 ["doc_id", "n_words", "n_features", "weight"])

    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with their rank from 1 by score descending and doc_id."""
    order = (F.col("score").desc(), F.col("doc_id").asc())
    # Part and place within it are read from the number: 33 bits of place below the part.
    dealt = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "dealt")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each partition of the exchange.
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return dealt.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + place + 1).drop("at", "part", "before")


def resampled(docs: DataFrame, target: DataFrame, *, shortest: int = 1, longest: int = 2, buckets: int = 10_000, share: tuple[int, int] = (10, 100),
              least_words: int = LEAST_WORDS, seed: int = 2024, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for each row of ``docs``; rank is null where a row is not drawn.

    Of the N rows with ``least_words`` words or more, floor(N * share[0] / share[1]) are drawn.
    """
    gain = gains(*(bucket_counts(d, buckets, shortest, longest, text) for d in (docs, target)))
    rows = materialise(weighed(docs, gain, shortest, longest, text).withColumn("score", F.col("weight") + noise(seed)), "weighed")
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False)) & F.col("score").isNotNull()
    count = rows.where(able).count() * share[0] // share[1]
    ranks = placed(rows.where(able)).withColumn("rank", F.when(F.col("rank") <= count, F.col("rank")))
    return ranks.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("bigint")))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs``, all columns as they were; of rows that repeat a doc_id all stay if one is drawn."""
    chosen = resampled(docs, target, **options).where("rank is not null").select("doc_id").distinct()
    return docs.join(materialise(chosen, "drawn"), "doc_id", "left_semi").select(*docs.columns)
