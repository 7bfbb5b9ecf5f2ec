"""Benchmark decontamination with a broadcast set of normalised word windows.

A benchmark item gives every window of ``width`` consecutive words, an item of fewer words
(but not none) its whole sequence as one window. Windows are broadcast as arrays of word
numbers; a benchmark larger than ``block_bytes`` of text goes in blocks of about that size,
one scan column after the other, so no broadcast grows with it. A document's words become
numbers too, its windows of known words are hashed, and every hash hit is verified word by word.

Defined results: null and empty texts have no words and are clean. Items without words, and
null items, give no window; an item with a null id marks words but is not listed. Repeated
rows are judged each. Equal windows of several items list all of them.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import fresh, text_batches

# A-Z in lower case; other ASCII except digits and a-z separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BASE = np.uint64(0x100000001B3)
_PART = 1 << 20

FOUND = T.StructType().add("n_words", T.LongType()).add("spans", T.ArrayType(T.LongType())).add("items", T.ArrayType(T.StringType()))


def word_parts(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in lists of about a megabyte of text, cut between words."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + _PART)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def build_index(items: list[tuple], width: int = 13) -> dict:
    """Arrays of all windows of the items, ordered by length and hash."""
    vocabulary: dict[bytes, int] = {}
    flat, windows = [], []
    for name, text in items:
        words = [w for part in word_parts(text) for w in part]
        if not words:
            continue
        first, size = len(flat), min(width, len(words))
        flat += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        windows += [(size, first + k, name) for k in range(len(words) - size + 1)]
    flat = np.array(flat, np.int32)
    by_length = {}
    for size in sorted({w[0] for w in windows}):
        mine = [w for w in windows if w[0] == size]
        starts = np.array([w[1] for w in mine])
        keys = _hashed(flat, starts, size)
        order = np.argsort(keys, kind="stable")
        by_length[size] = (keys[order], starts[order], [mine[i][2] for i in order])
    return {"vocabulary": vocabulary, "flat": flat, "windows": by_length}


def _hashed(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    key = np.zeros(len(starts), np.uint64)
    for k in range(size):
        key = key * _BASE + ids[starts + k].astype(np.uint64) + np.uint64(1)
    return key


def hits(text: str | None, index: dict) -> tuple[int, list[tuple[int, int]], set]:
    """The number of words, the spans of words hit (merged, in order) and the items that occur."""
    get = index["vocabulary"].get
    parts = [np.fromiter(map(get, words, itertools.repeat(-1)), np.int32, len(words)) for words in word_parts(text)]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    spans, items = [], set()
    known = np.concatenate(([0], np.cumsum(ids >= 0)))
    for size, (keys, starts, names) in index["windows"].items():
        full = np.flatnonzero(known[size:] - known[:-size] == size) if len(ids) >= size else ids[:0]
        if not len(full):
            continue
        mine = _hashed(ids, full, size)
        low, high = np.searchsorted(keys, mine), np.searchsorted(keys, mine, "right")
        for at, a, b in zip(full[low < high], low[low < high], high[low < high]):
            same = [k for k in range(a, b) if np.array_equal(ids[at : at + size], index["flat"][starts[k] : starts[k] + size])]
            if same:
                spans.append((int(at), int(at) + size))
                items.update(names[k] for k in same)
    return len(ids), merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def scanned(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = 13, block_bytes: int = 8 << 20) -> Column:
    """A struct column of type FOUND for a text column of ``docs``; spans alternate start and end in words."""
    text_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).where("text is not null").distinct()  # equal rows would share a block
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = F.lit(None).cast(FOUND)
    for k in range(blocks):
        rows = [tuple(r) for r in items.where(block == k).collect()]
        found = _scan(context.broadcast(build_index(rows, width)))(F.col(text), found)
    return found


def _scan(shared):
    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index = shared.value
        for texts, before in batches:
            out = []
            for text, old in zip(texts.to_pylist(), before.to_pylist()):
                n, spans, items = hits(text, index)
                if old is not None:
                    spans = merged(spans + list(zip(old["spans"][::2], old["spans"][1::2])))
                    items |= set(old["items"])
                out.append({"n_words": n, "spans": [x for s in spans for x in s], "items": sorted(x for x in items if x is not None)})
            yield pa.array(out, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]))

    return scan.asNondeterministic()


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", share: int = 20, **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the spans hit cut out of their texts.

    A document is contaminated when at least one word in ``share`` is hit.
    """
    name = fresh(docs, "found")
    judged = docs.withColumn(name, scanned(docs, benchmark, **options))
    if remove == "documents":
        return judged.where(~contaminated(F.col(name), share)).drop(name)
    text = options.get("text", "text")
    return judged.withColumn(text, F.when(F.size(F.col(name).spans) > 0, cut_spans(F.col(text), F.col(name).spans)).otherwise(F.col(text))).drop(name)


def n_hit(found: Column) -> Column:
    places = F.transform(found.spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda a, x: a + x)


def contaminated(found: Column, share: int = 20) -> Column:
    return (n_hit(found) > 0) & (n_hit(found) * share >= found.n_words)


@F.arrow_udf(T.StringType())
def cut_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, marks in zip(texts.to_pylist(), spans.to_pylist()):
        if not text or not marks:
            out.append(text)
            continue
        raw = text.encode()
        starts, ends = set(marks[::2]), set(marks[1::2])
        at, kept, lost = 0, [], None
        for k, word in enumerate(_WORD.finditer(raw)):
            if k in starts:
                kept.append(raw[at : word.start()])
                lost = True
            if k + 1 in ends and lost:
                at, lost = word.end(), None
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pa.array(out, pa.string())
