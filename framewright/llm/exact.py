"""Exact deduplication by composable polynomial fingerprints, confirmed chunk by chunk.

The fingerprint of a byte string is its polynomial in a fixed base modulo two primes below
2^31. Fingerprints compose: that of ``a + b`` is that of ``a``, shifted by the base to the
power of ``len(b)``, plus that of ``b``. Chunks are hashed all at once and joined by that rule;
chunks of a document beyond ``spread_bytes`` go to different tasks and their shifted terms are summed.

Equal fingerprints only nominate: all texts of such a group are compared, chunk row by chunk
row, with the group's row of the largest key. Those that differ form a new group and are
compared among themselves, until no text differs, so a collision cannot merge documents.

Defined results: null counts as empty and equals other empty texts. Each row is a document; a
repeated row counts in ``group_size``, and is kept if its doc_id is the largest of its group.
A null doc_id is smaller than any other and kept only if its group has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import fresh, sized, text_batches
from framewright.session import materialise

# Two primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525021)
CHUNK = 1 << 16
KEY = ("h1", "h2", "n_bytes")


def _powers(chunk: int) -> list[np.ndarray]:
    """base^(chunk-1) ... base^0 for each prime: a chunk is multiplied by as many of the last ones as it has bytes."""
    out = []
    for base, prime in zip(BASES, PRIMES):
        powers = [1]
        for _ in range(chunk - 1):
            powers.append(powers[-1] * base % prime)
        out.append(np.array(powers[::-1], np.int64))
    return out


def compose(left: tuple, right: tuple) -> tuple:
    """The fingerprint (h1, h2, length) of two neighbours together."""
    return (*((a * pow(base, right[2], prime) + b) % prime for a, b, base, prime in zip(left, right, BASES, PRIMES)), left[2] + right[2])


def fingerprint(raw: bytes, powers: list[np.ndarray]) -> tuple:
    chunk = len(powers[0])
    whole = len(raw) // chunk * chunk
    body = np.frombuffer(raw, np.uint8)
    parts = []
    if whole:
        grid = body[:whole].reshape(-1, chunk)
        sums = [np.concatenate([part.astype(np.int64) @ p for part in np.array_split(grid, -(-len(grid) // 64))]) % prime
                for p, prime in zip(powers, PRIMES)]
        parts = [(int(a), int(b), chunk) for a, b in zip(*sums)]
    if len(raw) > whole or not parts:
        tail = body[whole:].astype(np.int64)
        parts.append((*(int(tail @ p[chunk - len(tail):]) % prime for p, prime in zip(powers, PRIMES)), len(tail)))
    return reduce(compose, parts)


_PAIR = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])


@F.arrow_udf(T.StructType().add("h1", T.LongType()).add("h2", T.LongType()))
def _hashed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Fingerprints of byte strings, shifted by the number of bytes that follow them."""
    powers = _powers(CHUNK)
    for raws, tails in batches:
        out = []
        for raw, tail in zip(raws, tails.to_pylist()):
            h1, h2, _ = fingerprint(raw.as_buffer(), powers)
            if tail:
                h1, h2 = (h * pow(base, tail, prime) % prime for h, base, prime in zip((h1, h2), BASES, PRIMES))
            out.append({"h1": h1, "h2": h2})
        yield pa.array(out, _PAIR)


def _chunks(raw: Column, size: int) -> Column:
    """(chunk_no, chunk, tail): consecutive chunks of a byte string and the bytes behind each; one for an empty string."""
    n = F.octet_length(raw)
    last = F.greatest(F.lit(0), F.floor((n - 1) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(
        k.alias("chunk_no"), F.substring(raw, k * size + 1, F.lit(size)).alias("chunk"),
        F.greatest(F.lit(0), n - (k + 1) * size).cast("bigint").alias("tail")))


def with_bytes(docs: DataFrame, text: str = "text") -> DataFrame:
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col("doc_id"), raw.cast("binary").alias("raw"), F.sha2(raw.cast("binary"), 256).alias("sha"))


def fingerprints(docs: DataFrame, text: str = "text", spread_bytes: int = 64 << 20) -> DataFrame:
    """A row (doc_id, sha, h1, h2, n_bytes) for each row of ``docs``."""
    text_batches(docs.sparkSession)
    rows = with_bytes(docs, text).withColumn("n_bytes", F.octet_length("raw").cast("bigint"))
    small = rows.where(F.col("n_bytes") <= spread_bytes).select("doc_id", "sha", "n_bytes", _hashed(F.col("raw"), F.lit(0).cast("bigint")).alias("h"))
    small = small.select("doc_id", "sha", "h.h1", "h.h2", "n_bytes")
    spread = rows.where(F.col("n_bytes") > spread_bytes).select("doc_id", "sha", "n_bytes", F.explode(_chunks(F.col("raw"), CHUNK)).alias("c"))
    spread = spread.select("doc_id", "sha", "n_bytes", "c.*").repartition("doc_id", "sha", "chunk_no")
    spread = spread.withColumn("h", _hashed(F.col("chunk"), F.col("tail"))).groupBy("doc_id", "sha", "n_bytes", "chunk_no").agg(
        F.count(F.lit(1)).alias("copies"), F.first("h").alias("h"))
    total = [(F.sum(f"h.{h}") % prime).alias(h) for h, prime in zip(("h1", "h2"), PRIMES)]
    spread = spread.groupBy("doc_id", "sha", "n_bytes").agg(*total, F.max("copies").cast("int").alias("copies"))
    spread = spread.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return small.unionByName(spread.select(small.columns))


def _collisions(docs: DataFrame, marks: DataFrame, text: str) -> DataFrame | None:
    """(h1, h2, n_bytes, sha, part) of texts that differ from their fingerprint's first group; None if there are none."""
    groups = marks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = materialise(marks.join(groups, [*KEY]).select(*KEY, "doc_id", "sha").distinct(), "members")
    m = members.select(*KEY, F.col("doc_id").alias("m_id"), F.col("sha").alias("m_sha"))
    rows = with_bytes(docs, text)
    found = rows.join(sized(m), rows.doc_id.eqNullSafe(m.m_id) & (rows.sha == m.m_sha))
    pieces = materialise(found.select(*KEY, "doc_id", "sha", F.explode(_chunks(F.col("raw"), CHUNK)).alias("c"))
                         .select(*KEY, "doc_id", "sha", "c.chunk_no", "c.chunk"), "pieces")
    apart, part = None, 0
    while True:
        head = members.groupBy(*KEY).agg(F.max(F.struct("doc_id", "sha")).alias("head"))
        first = pieces.join(head, [*KEY]).where((F.struct("doc_id", "sha").eqNullSafe(F.col("head")))).select(
            *KEY, "chunk_no", F.col("chunk").alias("head_chunk")).dropDuplicates([*KEY, "chunk_no"])
        compared = pieces.join(first, [*KEY, "chunk_no"]).select(*KEY, "doc_id", "sha", (F.col("chunk") == F.col("head_chunk")).alias("same"))
        differ = materialise(compared.groupBy(*KEY, "doc_id", "sha").agg(F.min("same").alias("same")).where(~F.col("same")).drop("same"), "differ")
        if differ.isEmpty():
            return apart
        part += 1
        mine = differ.select(*KEY, "sha").distinct().withColumn("part", F.lit(part))
        apart = mine if apart is None else apart.join(mine, [*KEY, "sha"], "left_anti").unionByName(mine)
        members, pieces = differ, materialise(pieces.join(differ, [*KEY, "doc_id", "sha"], "left_semi"), "pieces")


def decided(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """For each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_bytes."""
    marks = materialise(fingerprints(docs, text, **options), "marks")
    apart = _collisions(docs, marks, text)
    marks = marks.withColumn("part", F.lit(0)) if apart is None else marks.join(apart, [*KEY, "sha"], "left").fillna(0, ["part"])
    groups = marks.groupBy(*KEY, "part").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return marks.join(groups, [*KEY, "part"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"), "n_bytes")


def deduplicated(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each text, all columns as they were."""
    judged = materialise(decided(docs, text, **options), "judged")
    of, digest = fresh(docs, "d_id"), fresh(docs, "d_sha")
    dropped = judged.where(~F.col("kept")).select(F.col("doc_id").alias(of), F.col("text_sha256").alias(digest)).distinct()
    dropped = sized(materialise(dropped, "dropped"))
    sha = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256)
    left = docs.join(dropped, docs["doc_id"].eqNullSafe(F.col(of)) & (sha == F.col(digest)), "left_anti")
    repeated = judged.where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return left if repeated.isEmpty() else left.dropDuplicates(["doc_id", text])
