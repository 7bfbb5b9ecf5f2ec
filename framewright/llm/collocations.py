"""Phrase collocations: suffix pointers, routed by their leading words and sorted by three-way multikey quicksort.

A text is lower-cased (A-Z), cut into pieces at punctuation and line breaks and those into words. Every word but a piece's
last begins a suffix of at most ``longest`` words. A phrase that occurs ``least`` times holds only words and pairs of neighbours
that do, so words are counted first, then pairs of frequent words (by 64-bit hashes: a collision can only add), and suffixes end
before an infrequent word or pair. Bloom filters of a bounded size tell the frequent ones apart (a false positive costs a
row, never a result). Equal suffixes of a block of texts travel as one row with a count.

The rows are routed by ranges of (language, first word, second word, ...). A frequent leading word is thus cut at its second,
third or last word and never fills one task. In a task multikey three-way quicksort partitions suffix pointers by the
word at the present depth; the weight of an equal partition is the count of a phrase, and it goes on one word deeper,
down to ``longest``. Partitions lighter than ``least`` are abandoned, except those of the first and the last suffix of a
task: their phrases may go on in the neighbouring task, so their parts are emitted and added up.

Everything is per language. Scores, cuts and the phrases of longer candidates are joins of the counted phrases.

Defined results: null texts are empty, a null language is ``und``. Repeated rows and repeated or null ids count each, ids are not
looked at. Ties of score and count go by the phrase in UTF-8 byte order. Without candidates the result has no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import sized, text_batches
from framewright.session import materialise

# Blanks part words; all marks that end a piece become a word of their own, "." (no word holds one).
TABLE = bytes(46 if chr(c) in ".,;:!?\n\x0b\f\r" else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256))
END = b"."
PART = 1 << 20
HELD = 1 << 19  # different words counted by a task before they are sent
BLOCK = 1 << 21  # words combined at once
TASK_ROWS = 1 << 20  # suffix rows sorted by a task
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 27  # of a Bloom filter: 16 MB at most
SLICE = 1 << 18
PROBES = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7], np.uint64)


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text with END between pieces; a long text in parts that end at a blank or a piece's end."""
    raw, at = (text or "").encode("utf-8", "surrogatepass").translate(TABLE), 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= PART else raw.find(END, at + PART) + 1 or len(raw)
        yield raw[at:end].replace(END, b" . ").split(b" ")
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, words in held.items():
            words.pop(END, None)
            words.pop(b"", None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(words.values(), pa.int64())],
                                             ["lang", "w", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = held.setdefault(lang, Counter())
            for words in words_of(text):
                own.update(words)
        if sum(map(len, held.values())) > HELD:
            yield from sent()
    yield from sent()


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed, digest = xxhash.xxh32_intdigest(lang.encode()), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs from the hashes of their words."""
    h = left * PROBES[0] + (right ^ (right >> np.uint64(31))) * PROBES[1]
    return (h ^ (h >> np.uint64(29))) * PROBES[2]


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: dict[str, list[bytes]] = {}
        for lang, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(lang, []).append(w.encode("utf-8", "surrogatepass"))
        found = np.concatenate([np.zeros(0, np.uint64), *(_hashes(*own) for own in words.items())])
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    h = hashes ^ (hashes >> np.uint64(32))
    return ((h[:, None] * PROBES) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


class Bloom:
    """A Bloom filter of 64-bit hashes, put together slice by slice; what reaches the driver is at most MOST_BITS."""

    def __init__(self, hashes: DataFrame):
        wanted, bits = 16 * hashes.count(), LEAST_BITS
        while bits < min(wanted, MOST_BITS):
            bits *= 2

        def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = np.unique(_places(batch.column(0).to_numpy().view(np.uint64), bits))
                yield pa.RecordBatch.from_arrays([pa.array(places // SLICE), pa.array(places % SLICE)], ["slice", "place"])

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                own, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for k in np.unique(own).tolist():
                    held.setdefault(k, np.zeros(SLICE, bool))[place[own == k]] = True
            for k, flags in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(flags).tobytes()], pa.binary())], ["slice", "bits"])

        self.bits, self.flags = bits, np.zeros(bits // 8, np.uint8)
        for k, raw in hashes.mapInArrow(set_bits, "slice long, place long").repartition("slice").mapInArrow(merged, "slice long, bits binary").collect():
            self.flags[k * SLICE // 8 : (k + 1) * SLICE // 8] = np.frombuffer(raw, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = _places(hashes, self.bits)
        return ((self.flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


def _blocks(batches: Iterator[pa.RecordBatch], often: Bloom) -> Iterator[tuple[str, np.ndarray, np.ndarray, list[bytes]]]:
    """(language, word numbers of its texts end to end, hashes by number, words by number), about BLOCK words at a time.

    Infrequent words and the ends of pieces are -1.
    """
    texts: dict[str, list[np.ndarray]] = {}
    numbers: dict[str, defaultdict] = {}
    held = 0

    def done() -> Iterator[tuple[str, np.ndarray, np.ndarray, list[bytes]]]:
        for lang, own in numbers.items():
            words = list(own)
            hashes = _hashes(lang, words)
            place = np.where(often.has(hashes), np.arange(len(words)), -1).astype(np.int32)
            place[0], place[1] = -1, -2  # the end of a piece; nothing between two blanks
            ids = place[np.concatenate(texts.pop(lang))]
            yield lang, ids[ids > -2], hashes, words
        numbers.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = numbers.get(lang)
            if own is None:
                own = numbers[lang] = defaultdict(count().__next__)
                texts[lang] = []
                for mark in (END, b""):  # numbers 0 and 1
                    own[mark]
            for words in words_of(text):
                texts[lang].append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
                held += len(words)
            texts[lang].append(np.zeros(1, np.int32))
            if held > BLOCK:
                yield from done()
                held = 0
    yield from done()


def _pair_counts(often):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, hashes, _ in _blocks(batches, often.value):
            both = (ids[:-1] >= 0) & (ids[1:] >= 0)
            pairs, n = np.unique(ids[:-1][both].astype(np.int64) << 32 | ids[1:][both], return_counts=True)
            found = _pairs(hashes[pairs >> 32], hashes[pairs & 0xFFFFFFFF])
            for at in range(0, len(n), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + (1 << 16)].view(np.int64)), pa.array(n[at : at + (1 << 16)])], ["pair", "n"])

    return run


def combined(ids: np.ndarray, joined: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Different suffixes of a row of word numbers and their counts; a suffix goes on where ``joined`` says so, -1 fills up shorter ones."""
    begins = np.flatnonzero(joined)
    table, going = [ids[begins]], np.ones(len(begins), bool)
    more = np.append(joined, np.zeros(longest, bool))
    for k in range(1, longest):
        going &= more[begins + k - 1]
        table.append(np.where(going, ids[np.minimum(begins + k, len(ids) - 1)], -1))
    table = np.stack(table).astype(np.int64)
    keys = [table[k] + 1 << 32 | table[k + 1] + 1 for k in range(0, longest - 1, 2)] + ([table[-1]] if longest % 2 else [])
    order = np.lexsort(keys[::-1])
    if not len(order):
        return table, np.zeros(0, np.int64)
    changed = np.append(True, np.any([key[order][1:] != key[order][:-1] for key in keys], axis=0))
    first = np.flatnonzero(changed)
    return table[:, order[first]], np.diff(np.append(first, len(order)))


def _suffixes(often, pairs, longest: int):
    names = ["lang", *(f"w{k}" for k in range(longest)), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, hashes, words in _blocks(batches, often.value):
            both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            joined = np.zeros(len(ids), bool)
            different, place = np.unique(ids[both].astype(np.int64) << 32 | ids[both + 1], return_inverse=True)
            joined[both] = pairs.value.has(_pairs(hashes[different >> 32], hashes[different & 0xFFFFFFFF]))[place]
            table, n = combined(ids, joined, longest)
            spelled = pa.array(words, pa.binary()).cast(pa.string())
            for at in range(0, len(n), 1 << 16):
                part = table[:, at : at + (1 << 16)]
                columns = [spelled.take(pa.array(row, mask=row < 0)) for row in part]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * part.shape[1]), *columns, pa.array(n[at : at + (1 << 16)])], names)

    return run


def quicksorted(table: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, pointer, weight) of every phrase of two words and more: its words are the first ``depth`` of the pointer's row.

    ``table`` has a column for each suffix: its language, then its words in numbers that are ordered as they are, -1 behind
    its end. Phrases lighter than ``least`` are left out, unless they begin the first or the last suffix.
    """
    depths, total = table.shape
    if not total:
        return
    edges = np.zeros(total, bool)
    for pick in (np.min, np.max):
        ends = np.arange(total)
        for row in table:
            ends = ends[row[ends] == pick(row[ends])]
        edges[ends] = True
    stack = [(np.arange(total), 0)]
    while stack:
        pointers, depth = stack.pop()
        if n[pointers].sum() < least and not edges[pointers].any():
            continue
        words = table[depth][pointers]
        pivot = words[len(words) >> 1]
        less, more = pointers[words < pivot], pointers[words > pivot]
        same = pointers[words == pivot]
        if len(less):
            stack.append((less, depth))
        if len(more):
            stack.append((more, depth))
        if pivot < 0:
            continue
        weight = int(n[same].sum())
        open_ended = edges[same].any()
        if weight >= least or open_ended:
            if depth >= 2:
                yield depth, int(same[0]), weight
            if depth + 1 < depths:
                stack.append((same, depth + 1))


def _mined(least: int, longest: int):
    types = (pa.string(), pa.string(), pa.int32(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        columns, spelled = [], []
        for k in range(longest + 1):
            coded = whole.column(k).combine_chunks().dictionary_encode()
            own = [None if w is None else w.encode() for w in coded.dictionary.to_pylist()]
            rank = np.zeros(len(own), np.int64)
            rank[sorted(range(len(own)), key=own.__getitem__)] = np.arange(len(own))
            columns.append(np.append(rank, -1)[coded.indices.fill_null(len(own)).to_numpy(zero_copy_only=False)])
            spelled.append(sorted(own))
        table, n = np.stack(columns), whole.column(longest + 1).to_numpy()
        found = [(spelled[0][table[0, p]].decode(), b" ".join(spelled[k][table[k, p]] for k in range(1, d + 1)).decode("utf-8", "surrogatepass"), d, w)
                 for d, p, w in quicksorted(table, n, least)]
        for at in range(0, len(found), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[at : at + (1 << 16)]), types)], ["lang", "phrase", "size", "a"])

    return run


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """Written (lang, phrase, size, a) of all phrases of up to ``longest`` words that occur ``least`` times, and (lang, n) of all words."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    words = materialise(rows.mapInArrow(_counted, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.where(F.col("n") >= least)
    context = docs.sparkSession.sparkContext
    frequent = context.broadcast(Bloom(often.select("lang", "w").mapInArrow(_word_hashes, "h long")))
    pairs = rows.mapInArrow(_pair_counts(frequent), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    joined = context.broadcast(Bloom(materialise(pairs.select("pair"), "pairs")))
    keys = ["lang", *(f"w{k}" for k in range(longest))]
    ddl = ", ".join(f"{k} string" for k in keys) + ", n long"
    suffixes = materialise(rows.mapInArrow(_suffixes(frequent, joined, longest), ddl), "suffixes")
    tasks = max(1, -(-suffixes.count() // TASK_ROWS))
    dealt = suffixes.repartitionByRange(tasks, *keys)
    mined = dealt.mapInArrow(_mined(least, longest), "lang string, phrase string, size int, a long")
    longer = mined.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    single = often.select("lang", F.col("w").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("a"))
    return materialise(single.unionByName(longer), "phrases"), totals


def _part(begin, size):
    return F.array_join(F.slice("words", begin, size), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, covered: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by the score of their weakest cut."""
    counts, totals = phrases(docs, text, lang, least, longest)
    known = sized(counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    found = counts.where("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = found.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    side = lambda name, out: known.select("lang", F.col("part").alias(name), F.col("f").alias(out))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    # Exact: decimals hold 2,000,000 times any count of 64 bits.
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    cuts = cuts.withColumn("score", score)
    worst = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = found.where("size > 2").select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length"))
    inner = inner.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1), lambda b: F.array_join(F.slice("words", b, F.col("length")), " "))).alias("phrase"))
    heaviest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    stays = worst.join(sized(materialise(heaviest, "longer")), ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * covered))
    order = Window.partitionBy("lang").orderBy(F.col("c.score").desc(), F.col("a").desc(), "phrase")
    # A limit on a rank: Spark keeps the first ``top`` of each task before rows are shuffled.
    best = stays.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(sized(materialise(totals, "totals")), "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")
