"""Repeated passages of more than 50 words: gear-hash chunks nominate, word windows prove.

A passage is a run of at least ``least_words`` = 51 words that stands byte for byte in several documents. A word is
a run of letters and digits (an apostrophe or hyphen may join two); each character of a script without spaces is
a word, and a run of over 64 bytes is cut into words at content-defined places.

Texts are cut into chunks by content. A gear hash rolls over the words (shift left, add the word's gear value; at a shift of
11 bits a word has left after six), and a chunk ends where it is the least of any 12 neighbours rather than where a mask fits: every 12 words then hold
an end without forced cuts, which an insertion would move. A chunk's digest covers the gear windows of both its ends, 7 to 18
words. Ends depend on the words up to 11 places around them only, so in any 51 words the 24 middle places hold two ends or more that are the same
wherever these words stand. Equal digests in several texts nominate: a window of 51 words is looked at only if
all chunks that its middle fixes are shared, and no window of a passage is missed. Windows are compared by 128-bit
digests, and as every word has its window, the union of touching windows ends at the passage's true first and last word.

Equal texts go through once, all their windows being repeated. Keys that hold over a 100,000th of the rows meet their
facts by broadcast, so a passage in a third of all documents is no hot spot.

Windows that overlap are one span; ``least_bytes`` (0: no limit) asks for bytes of the whole span. Only then a span
is split: what an earlier document has is marked for removal, with the first document that has it, and the rest
is kept. A part may therefore have less than 51 words. Parts do not overlap.

Defined results: null, empty and short texts have no passages. A document is a distinct pair of doc_id and text: equal rows
are one, different texts under one id are several with spans of their own, and rows without id come behind all
others (several texts of one id, or without one, in an order of the job's own). The first document keeps a passage, in all others it is marked for removal.
Of one text the windows must fit a task (some 24 bytes a word of its passages).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import met, sized, text_batches
from framewright.llm.minhash import _mixed
from framewright.session import materialise

GEAR = (_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
PART = 1 << 20
BLOCK = 1 << 16  # words, or rows of a batch
LONG_RUN = 64  # bytes of a run without a gap, above which it is cut
INNER = np.isin(np.arange(256), [ord("'"), ord("-")])
WORD = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)])
POWER = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
INVERSE = np.uint64(pow(int(POWER), -1, 1 << 64))
LETTER = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
WINDOWS = pa.schema([("ord", pa.int64()), ("many", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])
GEAR_WORDS = 6  # a word leaves the gear hash after so many
SPAN = T.ArrayType(T.StructType().add("start", T.LongType()).add("stop", T.LongType()).add("first", T.LongType()).add("kept", T.BooleanType()))
SPANS = T.StructType().add("own", SPAN).add("copies", SPAN)


def chunk_ends(raw: bytes, average: int = 24, longest: int = 512) -> np.ndarray:
    """The places behind chunk ends, the text's end included."""
    body, ends = np.frombuffer(raw, np.uint8), []
    for at in range(0, len(body), PART):
        begin = max(0, at - 31)
        gear = GEAR[body[begin : at + PART]]
        for step in (1, 2, 4, 8, 16):  # the hash of twice as many bytes each time
            longer = gear.copy()
            longer[step:] += gear[:-step] << np.uint32(step)
            gear = longer
        low = np.flatnonzero((gear >> np.uint32(16)) < 65536 // average) + begin + 1
        ends.append(low[low > at])
    found = np.unique(np.concatenate([*ends, [len(body)]])) if len(body) else np.zeros(0, np.int64)
    gaps = np.diff(np.concatenate(([0], found)))
    if (gaps > longest).any():
        extra = [np.arange(end - gap + longest, end, longest) for end, gap in zip(found[gaps > longest], gaps[gaps > longest])]
        found = np.unique(np.concatenate([found, *extra]))
    return found


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte behind it."""
    body = np.frombuffer(raw, np.uint8)
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside, opens = WORD[body], None
    if body.max() >= 0xC2:
        after = np.append(body[1:], np.uint8(0))
        for place in np.flatnonzero((body == 0xE2) & ((after == 0x80) | (after == 0x81))).tolist():
            inside[place : place + 3] = False  # dashes, quotation marks, wide spaces
        for place in np.flatnonzero((body == 0xC2) & (after < 0xC0) & (after != 0xAA) & (after != 0xB5) & (after != 0xBA)).tolist():
            inside[place : place + 2] = False
        opens = ((body >= 0xE3) & (body <= 0xE9)) | ((body == 0xF0) & (after >= 0xA0))  # Chinese, Japanese
        opens |= (body == 0xE0) & (after >= 0xB8) & (after <= 0xBB)  # Thai, Lao
        opens |= (body == 0xE1) & (((after >= 0x80) & (after <= 0x82)) | (after == 0x9E) | (after == 0x9F))  # Burmese, Khmer
    joins = np.flatnonzero(INNER[body[1:-1]] & inside[:-2] & inside[2:]) + 1
    inside[joins] = True
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    more = []
    if opens is not None and opens.any():
        first = np.flatnonzero(opens & inside)
        behind = first + np.where(body[first] == 0xF0, 4, 3)
        more += [first, behind[(behind < len(body))]]
    cut = np.unique(np.concatenate(more)) if more else np.zeros(0, np.int64)
    starts, stops = _split(starts, stops, cut)
    long = np.flatnonzero(stops - starts > LONG_RUN)
    if len(long):
        inner = [chunk_ends(raw[starts[k] : stops[k]], 8, LONG_RUN)[:-1] + starts[k] for k in long.tolist()]
        starts, stops = _split(starts, stops, np.concatenate(inner))
    return starts, stops


def _split(starts: np.ndarray, stops: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs cut at those of ``cuts`` (ascending) that lie strictly inside them."""
    if not len(cuts) or not len(starts):
        return starts, stops
    run = np.searchsorted(starts, cuts, "right") - 1
    cuts = cuts[(run >= 0) & (cuts > starts[run]) & (cuts < stops[run])]
    return np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([stops, cuts]))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, base))))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over every ``width`` neighbours."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def _layout(least_words: int) -> tuple[int, int]:
    """Words of the gear hash, and places of which one at least ends a chunk: four times those fit into a passage."""
    gear = max(1, min(GEAR_WORDS, least_words // 8))
    return gear, max(1, (least_words + 3 - gear) // 4)


def chunks(raw: bytes, starts: np.ndarray, stops: np.ndarray, least_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block of words: its first word, the chunk ends (first words of their gear windows, from there) and the digests of the chunks between them."""
    gear, width = _layout(least_words)
    shift, edge = -(-64 // gear), np.zeros(width - 1, np.uint64)
    for at in range(0, len(starts) - least_words + 1, BLOCK):  # blocks overlap, so that each passage is whole in one
        a, b = starts[at : at + BLOCK + least_words - 1], stops[at : at + BLOCK + least_words - 1]
        body = np.frombuffer(raw, np.uint8)[a[0] : b[-1]]
        if len(_POWERS[0]) < len(body):
            _POWERS[:] = _powers(POWER, 2 * len(body)), _powers(INVERSE, 2 * len(body))
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LETTER[body] * _POWERS[0][: len(body)])))

        def digest(first: np.ndarray, last: np.ndarray, upto=upto) -> np.ndarray:
            return _mixed((upto[last] - upto[first]) * _POWERS[1][first] + (last - first).astype(np.uint64))

        first, last = a - a[0], b - a[0]
        word = digest(first, last)
        rolled = word[gear - 1 :].copy()
        for k in range(1, gear):
            rolled += word[gear - 1 - k : len(word) - k] << np.uint64(k * shift)
        value = _mixed(rolled)
        least = _sliding(value, width, np.minimum)
        ends = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == value)
        yield at, ends, digest(first[ends[:-1]], last[ends[1:] + gear - 1]).view(np.int64)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _chunked(least_words: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for text in batch.column("text").to_pylist():
                raw = _bytes(text)
                own.append(np.unique(np.concatenate([np.zeros(0, np.int64), *(k for _, _, k in chunks(raw, *word_places(raw), least_words))])))
            keep = np.array([len(k) > 0 for k in own], bool)
            keys = pa.array([k for k in own if len(k)], pa.list_(pa.int64()))
            whole = batch.select(["doc_id", "d"]).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([whole.column(0), whole.column(1), keys], ["doc_id", "d", "keys"])

    return found


def windows_around(raw: bytes, wanted: np.ndarray | None, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of every window of ``least_words`` words all of whose fixed chunks are ``wanted`` (None: of every window)."""
    starts, stops = word_places(raw)
    gear, width = _layout(least_words)
    chosen = [np.zeros(0, np.int64)]
    if wanted is None:
        chosen.append(np.arange(max(0, len(starts) - least_words + 1)))
    else:
        for at, ends, keys in chunks(raw, starts, stops, least_words):
            first = np.arange(min(BLOCK, len(starts) - least_words + 1 - at))
            strange = np.concatenate(([0], np.cumsum(~np.isin(keys, wanted))))
            low = np.searchsorted(ends, first + width - 1, "left")
            high = np.searchsorted(ends, first + least_words - gear - width + 1, "right") - 1
            chosen.append(first[(high <= low) | (strange[np.maximum(high, 0)] == strange[np.minimum(low, len(keys))])] + at)
    first = np.concatenate(chosen)
    return starts[first], stops[first + least_words - 1]


def _windows(least_words: int):
    digest = xxhash.xxh3_128_digest

    def batch_of(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], schema=WINDOWS)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            for number, many, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("ord", "many", "text", "wanted"))):
                starts, stops = windows_around(raw := _bytes(text), None if many else np.array(wanted, np.int64), least_words)
                for k in range(0, len(starts), BLOCK):
                    a, b = starts[k : k + BLOCK], stops[k : k + BLOCK]
                    key = np.frombuffer(b"".join(digest(raw[i:j]) for i, j in zip(a.tolist(), b.tolist())), np.int64).reshape(-1, 2)
                    rows.append((np.full(len(a), number, np.int64), np.full(len(a), many, bool), a, b, key[:, 0], key[:, 1]))
                    n += len(a)
                    if n >= BLOCK:
                        yield batch_of(rows)
                        rows, n = [], 0
        if rows:
            yield batch_of(rows)

    return windows


def parts_of(start: np.ndarray, stop: np.ndarray, first: np.ndarray, kept: np.ndarray, least_bytes: int) -> list[dict]:
    """The spans of a document's repeated windows, split into parts that do not overlap."""
    order = np.lexsort((stop, start))
    start, stop, first, kept = start[order], stop[order], first[order], kept[order]
    reach = np.maximum.accumulate(stop)
    apart = np.append(True, start[1:] > reach[:-1])
    span = np.cumsum(apart) - 1
    whole = reach[np.append(np.flatnonzero(apart)[1:] - 1, len(stop) - 1)] - start[apart]
    fresh = np.flatnonzero(apart | np.append(True, (first[1:] != first[:-1]) | (kept[1:] != kept[:-1])))
    ends = np.maximum.reduceat(stop, fresh)
    runs = [(s, e, f, k) for s, e, f, k, i in zip(start[fresh].tolist(), ends.tolist(), first[fresh].tolist(), kept[fresh].tolist(), span[fresh].tolist()) if whole[i] >= least_bytes]
    out, at = [], -1
    for s, e, f, k in runs:
        if not k and e > at:
            out.append({"start": max(s, at), "stop": e, "first": f, "kept": False})
            at = e
    gone, mine, at, k = list(out), [], -1, 0
    for s, e, f, stays in runs:
        if stays:
            s = max(s, at)
            while k < len(gone) and gone[k]["stop"] <= s:
                k += 1
            i = k
            while s < e:
                if i == len(gone) or gone[i]["start"] >= e:
                    mine.append({"start": s, "stop": e, "first": f, "kept": True})
                    break
                if gone[i]["start"] > s:
                    mine.append({"start": s, "stop": gone[i]["start"], "first": f, "kept": True})
                s = max(s, gone[i]["stop"])
                i += 1
            at = max(at, e)
    return sorted(out + mine, key=lambda r: r["start"])


def _merged(least_bytes: int):
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("first", pa.int64()), ("kept", pa.bool_())]))

    @F.arrow_udf(SPANS)
    def merge(lists: pa.Array, numbers: pa.Array, many: pa.Array) -> pa.Array:
        rows, ends = lists.flatten(), np.cumsum(np.append(0, lists.value_lengths().to_numpy(zero_copy_only=False)))
        start, stop, first = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop", "first"))
        own, copies = [], []
        for a, b, number, also in zip(ends[:-1].tolist(), ends[1:].tolist(), numbers.to_pylist(), many.to_pylist()):
            kept = first[a:b] == number
            own.append(parts_of(start[a:b], stop[a:b], first[a:b], kept, least_bytes))
            copies.append(parts_of(start[a:b], stop[a:b], first[a:b], np.zeros(b - a, bool), least_bytes) if also else [])
        return pa.StructArray.from_arrays([pa.array(own, span), pa.array(copies, span)], ["own", "copies"])

    return merge


def _digest(text: str):
    return F.unhex(F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 32))


def repeats(docs: DataFrame, text: str = "text", least_words: int = 51, least_bytes: int = 0) -> DataFrame:
    """(doc_id, d, spans): for each document (d: digest of its text) with repeated passages their byte spans, the first document and whether it is kept here."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    rows = rows.withColumn("d", _digest("text"))
    text_batches(docs.sparkSession)
    cut = rows.mapInArrow(_chunked(least_words), "doc_id long, d binary, keys array<long>")
    cut = materialise(cut.withColumn("tid", F.monotonically_increasing_id()), "chunks")

    # One row of each text goes on: that of the smallest doc_id.
    names = cut.select("tid", "doc_id", "d")
    ahead = F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "tid")).tid.alias("head")
    same = names.groupBy("d", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("tid"))
    same = same.groupBy("d").agg(ahead, F.sum("n").alias("c"), (F.count(F.lit(1)) > 1).alias("many")).where("c > 1")
    same = materialise(same, "equal")
    copies = materialise(met(names, same, ["d"], names.count()).where("tid <> head").select("tid", "doc_id", "head"), "copies")
    once = cut.join(sized(copies.select("tid")), "tid", "left_anti")

    marks = once.select("tid", F.explode("keys").alias("key"))
    counted = marks.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    common = materialise(counted.where("c > 1"), "common")
    total = once.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    wanted = met(marks, common, ["key"], total).groupBy("tid").agg(F.collect_list("key").alias("wanted"))
    whole = same.where("many").select(F.col("head").alias("tid"), "many")
    chosen = wanted.join(whole, "tid", "full_outer").withColumns({"many": F.coalesce("many", F.lit(False)), "wanted": F.when(F.col("many").isNull(), F.col("wanted"))})
    ranged = chosen.join(names, "tid").withColumn("blank", F.col("doc_id").isNull()).repartitionByRange("blank", "doc_id", "tid").sortWithinPartitions("blank", "doc_id", "tid")
    chosen = materialise(ranged.drop("blank").withColumn("ord", F.monotonically_increasing_id()), "wanted")

    mine = chosen.select("ord", "many", "wanted", "d", F.col("doc_id").alias("own"))
    near = rows.join(mine, (rows.d == mine.d) & rows.doc_id.eqNullSafe(F.col("own"))).select("ord", "many", "text", "wanted")
    windows = materialise(near.mapInArrow(_windows(least_words), "ord long, many boolean, start long, stop long, k1 long, k2 long"), "windows")
    seen = windows.groupBy("k1", "k2").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.max("many").alias("many"), F.count(F.lit(1)).alias("c"))
    again = materialise(seen.where("first < last or many").select("k1", "k2", "first", "c"), "again")
    found = met(windows.drop("many"), again, ["k1", "k2"], windows.count())
    # Windows of equal rows are equal and vanish in the set.
    spans = found.groupBy("ord").agg(F.collect_set(F.struct("start", "stop", "first")).alias("w"))
    spans = spans.join(chosen.select("ord", "tid", "doc_id", "d", "many"), "ord")
    spans = materialise(spans.withColumn("s", _merged(least_bytes)("w", "ord", "many")).drop("w"), "spans")
    others = copies.select(F.col("doc_id").alias("copy_id"), F.col("head").alias("tid")).distinct()
    others = others.join(spans.where("many"), "tid").where(~F.col("copy_id").eqNullSafe(F.col("doc_id")))
    parts = spans.select("doc_id", "d", F.explode("s.own").alias("p")).unionByName(others.select(F.col("copy_id").alias("doc_id"), "d", F.explode("s.copies").alias("p")))
    parts = materialise(parts.select("doc_id", "d", "p.*"), "parts")
    first = parts.groupBy("first").agg(F.count(F.lit(1)).alias("c")).join(chosen.select(F.col("ord").alias("first"), F.col("doc_id").alias("first_doc_id")), "first")
    named = met(parts, materialise(first, "first"), ["first"], parts.count())
    return named.groupBy("doc_id", "d").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "first_doc_id", "kept"))).alias("spans"))


@F.arrow_udf(T.StringType())
def _cut(texts: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
    out = []
    for text, marks, ends in zip(texts.to_pylist(), starts.to_pylist(), stops.to_pylist()):
        if text and marks:
            raw, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
            for start, stop in zip(marks, ends):
                kept.append(raw[at:start])
                at = max(at, stop)
            # A span may begin or end inside a character; what is left of one is dropped.
            text = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
        out.append(text)
    return pa.array(out, pa.string())


def deduplicated(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with every passage left only in the first document that has it."""
    cuts = repeats(docs, text, **options).select("doc_id", "d", F.filter("spans", lambda s: ~s.kept).alias("cut")).where(F.size("cut") > 0)
    cuts = materialise(cuts.select(F.col("doc_id").alias("cut_id"), "d", F.col("cut.start").alias("cut_start"), F.col("cut.stop").alias("cut_stop")), "cuts")
    own = F.unhex(F.substring(F.sha2(F.col(f"d.{text}").cast("string").cast("binary"), 256), 1, 32))
    joined = docs.alias("d").join(cuts.alias("c"), (own == F.col("c.d")) & F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("c.cut_id")), "left")
    shown = F.when(F.col("c.d").isNull(), F.col(f"d.{text}")).otherwise(_cut(F.col(f"d.{text}"), F.col("c.cut_start"), F.col("c.cut_stop")))
    return joined.select(*(shown.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns))
