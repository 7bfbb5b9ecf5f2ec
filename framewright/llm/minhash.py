"""Near-duplicate groups by MinHash with tensored banding, every candidate confirmed.

A document's set is its distinct shingles of ``size`` words. Documents of equal sets form one
class and go through once. Two small collections of ``bands`` hash keys are computed, each of
``rows`` minimum hashes; a table key combines one key of either, so ``bands`` squared tables of
2 x ``rows`` hashes each cost only 2 x ``bands`` x ``rows`` minimum hashes. Two classes of
similarity s share no table with a chance of about 2 (1 - s^rows)^bands: 3.7e-4 at 0.8, 2e-5 at 0.85.

Candidates are compared on full texts in three rounds, each only between classes that are not
yet in one component: the smallest class met in any table; the smallest class of every table;
then every remaining pair of a table. Inside a component no further pair is needed, so a large
group of copies costs about one comparison for each member, and no link between components is lost.

Defined results: texts are split at ASCII white space after A-Z are lowered; with fewer words
than ``size`` the whole sequence is the one shingle; null, empty and blank texts have no set
and are linked with nothing. Every row is judged by its own text: rows that repeat a doc_id with
other texts, or have none, are compared like all others. A component's id is its smallest doc_id, null
if none of its rows has one. Of each component ``deduplicated`` keeps the row of the smallest doc_id (rows without id come
last, of several texts under one id the one of the smallest digest); rows equal in id and text stay or go together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import Memo, fresh, met, shuffled, sized, text_batches
from framewright.llm.components import components
from framewright.session import materialise

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PART = 1 << 20
FEW_PAIRS = 20_000  # so many are broadcast to the texts, which then need no shuffle to meet them
_word = Memo(lambda w: xxhash.xxh3_64_intdigest(w))
SKETCH = T.StructType().add("n", T.LongType()).add("d", T.BinaryType()).add("a", T.ArrayType(T.LongType())).add("b", T.ArrayType(T.LongType()))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Smaller Arrow batches while pairs of texts are compared."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    parts, at = [], 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + _PART)
        end = cut.start() if cut else len(raw)
        words = raw[at:end].split()
        parts.append(np.fromiter(map(_word.__getitem__, words), np.uint64, len(words)))
        at = end
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    size = min(size, len(words))
    if not size:
        return words
    keys = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        keys = keys * _STEP + words[k : len(words) - size + 1 + k]
    return np.unique(_mixed(keys))


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def _sketches(size: int, bands: int, rows: int):
    seeds = _mixed(np.arange(1, 4 * bands * rows + 1, dtype=np.uint64) * _STEP)
    times, plus = seeds[::2, None] | np.uint64(1), seeds[1::2, None]

    def keys(hashes: np.ndarray) -> np.ndarray:
        """2 x bands keys of ``rows`` minimum hashes each."""
        least = np.full(2 * bands * rows, np.iinfo(np.uint64).max)
        for at in range(0, len(hashes), 2048):
            least = np.minimum(least, (hashes[None, at : at + 2048] * times + plus).min(1))
        key = np.arange(2 * bands, dtype=np.uint64)
        for part in (least >> np.uint64(20)).reshape(2 * bands, rows).T:
            key = _mixed(key * _STEP + part)
        return key.view(np.int64)

    @F.arrow_udf(SKETCH)
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                own = shingles(text, size)
                both = keys(own) if len(own) else np.zeros(0, np.int64)
                out.append((len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), both[:bands], both[bands:]))
            n, d, a, b = zip(*out) if out else ((), (), (), ())
            longs = pa.list_(pa.int64())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.array(a, longs), pa.array(b, longs)],
                                             ["n", "d", "a", "b"])

    return sketch.asNondeterministic()


def _linked(size: int, share: int):
    @F.arrow_udf(T.BooleanType())
    def linked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held, own = None, None
        for left, right in batches:
            out = []
            for a, b in zip(left.to_pylist(), right.to_pylist()):
                if b != held:
                    held, own = b, shingles(b, size)
                other = shingles(a, size)
                both = len(np.intersect1d(own, other, assume_unique=True))
                out.append(100 * both >= share * (len(own) + len(other) - both))
            yield pa.array(out, pa.bool_())

    return linked.asNondeterministic()


class _Rounds:
    """Classes whose tables are known, their texts, and what the comparisons have shown so far."""

    def __init__(self, classes: DataFrame, buckets: DataFrame, texts: DataFrame, size: int, share: int):
        self.classes, self.buckets, self.texts, self.linked = classes, buckets, texts, _linked(size, share)
        self.size, self.share = size, share
        self.links, self.checked, self.labels = None, None, None

    def compare(self, pairs: DataFrame) -> None:
        """Pairs (a, b), a > b: remember the links among them and join their components."""
        if self.checked is not None:
            pairs = pairs.join(shuffled(self.checked), ["a", "b"], "left_anti")
        pairs = materialise(pairs, "candidates")
        side = lambda x: self.texts.select(F.col("cid").alias(x), F.col("text").alias(f"{x}_text"))
        with batches_of(pairs.sparkSession, 256):
            judged = sized(pairs, FEW_PAIRS).join(side("a"), "a").join(shuffled(side("b")), "b").withColumn("link", self.linked(F.col("a_text"), F.col("b_text")))
            found = materialise(judged.where("link").select("a", "b").distinct(), "links")
        self.checked = pairs if self.checked is None else self.checked.unionByName(pairs)
        self.links = found if self.links is None else self.links.unionByName(found)
        known = found
        if self.labels is not None:
            known = found.unionByName(self.labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
        self.labels = materialise(components(known), "labels")

    def label(self, rows: DataFrame, name: str, out: str) -> DataFrame:
        labels = sized(self.labels).select(F.col("id").alias(name), F.col("component").alias(out))
        return rows.join(labels, name, "left").withColumn(out, F.coalesce(out, name))

    def smallest_met(self) -> DataFrame:
        return self.buckets.where("cid <> center").groupBy(F.col("cid").alias("a")).agg(F.min("center").alias("b"))

    def table_heads(self) -> DataFrame:
        pairs = self.buckets.where("cid <> center").select(F.col("cid").alias("a"), F.col("center").alias("b")).distinct()
        return self.label(self.label(pairs, "a", "a_label"), "b", "b_label").where("a_label <> b_label").select("a", "b")

    def remaining(self) -> DataFrame:
        """Pairs of one table and two components that may be links; three exact bounds spare the others.

        A class of whose shingles too many are in no other class here has no link. Of two classes,
        neither's own shingles are shared; and parity bitmaps differ in no more places than the sets do.
        Tables that share a key of the first collection are met together, so a pair is not met once a table.
        """
        rows = self._mixed(self.label(self.buckets.select("key", "cid"), "cid", "label"))
        texts = self.texts.join(shuffled(rows.select("cid").distinct()), "cid", "left_semi")
        sets = materialise(texts.select("cid", _sets(self.size)(F.col("text")).alias("s")).select("cid", "s.*").dropDuplicates(["cid"]), "sets")
        tokens = sets.select("cid", F.explode("hashes").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("cid").alias("cid"))
        own = tokens.where("df = 1").groupBy("cid").agg(F.count(F.lit(1)).alias("own"))
        share = self.share
        facts = sets.select("cid", "bits", F.size("hashes").cast("bigint").alias("n")).join(shuffled(own), "cid", "left").fillna(0, ["own"])
        facts = materialise(facts.where((F.col("n") - F.col("own")) * 100 >= F.col("n") * share), "facts")
        rows = self.label(facts.join(shuffled(self.classes), "cid"), "cid", "label").withColumn("key", F.explode("a")).drop("a")
        rows = materialise(self._mixed(rows), "mixed")
        rows = rows.withColumn("spare", (F.col("n") - F.col("own")) * 100 - F.col("n") * share)
        kinds = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.max("spare").alias("spare"), F.min("own").alias("own"),
                                                 F.max("n").alias("n"), F.first("bits").alias("bits"), F.max("cid").alias("cid"), F.first("b").alias("b"))
        kind = lambda p: kinds.select("key", F.col("label").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("c", "spare", "own", "n", "bits", "cid", "b")))
        alone = (F.col("x_c") == 1) & (F.col("y_c") == 1)
        both = kind("x").alias("x").join(shuffled(kind("y")).alias("y"), (F.col("x.key") == F.col("y.key"))
                                         & ((F.col("x_c") < F.col("y_c")) | ((F.col("x_c") == F.col("y_c")) & (F.col("x") < F.col("y"))))
                                         & (F.col("x_spare") >= F.col("y_own") * share) & (F.col("y_spare") >= F.col("x_own") * share)
                                         & (~alone | (F.arrays_overlap("x_b", "y_b") & self._near("x_", "y_")))).select(F.col("x.key").alias("key"), "x", "y", "x_cid", "y_cid", alone.alias("alone"))
        both = materialise(both, "kinds")
        side = lambda label, p: rows.select("key", F.col("label").alias(label), *(F.col(c).alias(p + c) for c in ("cid", "n", "own", "spare", "bits", "b")))
        several = sized(both.where("not alone").select("key", "x", "y"))
        near, far = several.join(side("x", "i_"), ["key", "x"]).alias("near"), shuffled(side("y", "j_")).alias("far")
        met = near.join(far, (F.col("near.key") == F.col("far.key")) & (F.col("near.y") == F.col("far.y"))
                        & (F.col("i_spare") >= F.col("j_own") * share) & (F.col("j_spare") >= F.col("i_own") * share) & F.arrays_overlap("i_b", "j_b") & self._near("i_", "j_"))
        met = met.select("i_cid", "j_cid").unionByName(both.where("alone").select(F.col("x_cid").alias("i_cid"), F.col("y_cid").alias("j_cid")))
        return met.select(F.greatest("i_cid", "j_cid").alias("a"), F.least("i_cid", "j_cid").alias("b")).distinct()

    def _near(self, x: str, y: str):
        """The bitmaps of two sets do not rule out a link."""
        n = F.col(f"{x}n") + F.col(f"{y}n")
        return (n - _apart(f"{x}bits", f"{y}bits")) * (100 + self.share) >= n * 2 * self.share

    def _mixed(self, rows: DataFrame) -> DataFrame:
        """The rows of tables in which several components meet."""
        mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
        return rows.join(shuffled(mixed), "key", "left_semi")


SET = T.StructType().add("hashes", T.ArrayType(T.LongType())).add("bits", T.ArrayType(T.LongType()))


def _sets(size: int):
    @F.arrow_udf(SET)
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                own = shingles(text, size)
                words = 4
                while words * 32 < len(own):  # about two bits for each shingle
                    words *= 2
                flips = np.bincount((own % np.uint64(words * 64)).astype(np.int64), minlength=words * 64) & 1
                out.append((own.view(np.int64), np.packbits(flips.astype(np.uint8)).view(np.int64)))
            hashes, bits = zip(*out) if out else ((), ())
            longs = pa.list_(pa.int64())
            yield pa.StructArray.from_arrays([pa.array(hashes, longs), pa.array(bits, longs)], ["hashes", "bits"])

    return sets.asNondeterministic()


def _apart(left: str, right: str):
    """In how many places two parity bitmaps differ; the longer is folded to the other's length."""
    x, y = F.col(left), F.col(right)

    def folded(bits, length):
        return F.transform(F.sequence(F.lit(0), length - 1), lambda k: F.aggregate(
            F.sequence(k, F.size(bits) - 1, length), F.lit(0).cast("bigint"), lambda acc, at: acc.bitwiseXOR(F.get(bits, at))))

    def differ(p, q):
        return F.aggregate(F.zip_with(p, q, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, k: acc + k)

    return F.when(F.size(x) == F.size(y), differ(x, y)).when(F.size(x) > F.size(y), differ(folded(x, F.size(y)), y)).otherwise(differ(x, folded(y, F.size(x))))


def grouped(docs: DataFrame, text: str = "text", size: int = 5, share: int = 80, bands: int = 12, rows: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id, kept, text_id, stays) for each row of ``docs``, and the confirmed links (a, b) between classes by their smallest doc_id.

    ``kept`` says that doc_id is component_id, ``stays`` that ``deduplicated`` keeps the row; text_id is the text's digest.
    """
    docs = docs.select("doc_id", F.col(text).cast("string").alias("text")).withColumn("text_id", _text_id(F.col("text")))
    sketch = _sketches(size, bands, rows)
    text_batches(docs.sparkSession)
    marks = materialise(docs.select("doc_id", "text_id", sketch(F.col("text")).alias("s")).select("doc_id", "text_id", "s.*"), "sketches")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "text_id"))
    classes = marks.where("n > 0").groupBy("d").agg(head.alias("head"), F.first("a").alias("a"), F.first("b").alias("b"), F.count(F.lit(1)).alias("c"))
    # Numbers of classes rise with their smallest doc_id, so the smallest number of a component tells its smallest doc_id.
    ranged = classes.select("d", "head.*", "a", "b", "c").repartitionByRange("blank", "doc_id", "d").sortWithinPartitions("blank", "doc_id", "d")
    classes = materialise(ranged.withColumn("cid", F.monotonically_increasing_id()), "classes")
    keys = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    keyed = classes.select("cid", F.explode(keys).alias("key"))
    tables = materialise(keyed.groupBy("key").agg(F.min("cid").alias("center"), F.count(F.lit(1)).alias("c")).where("c > 1"), "tables")
    buckets = materialise(met(keyed, tables, ["key"], classes.count() * bands * bands), "buckets")
    named = classes.select("cid", F.col("doc_id").alias("own_id"), F.col("text_id").alias("own_text"))
    involved = buckets.select("cid").distinct().join(shuffled(named), "cid")
    involved = sized(materialise(involved, "involved"))
    texts = docs.join(involved, docs.doc_id.eqNullSafe(F.col("own_id")) & (docs.text_id == F.col("own_text")))
    rounds = _Rounds(classes.select("cid", "a", "b"), buckets, materialise(texts.select("cid", "text"), "texts"), size, share)
    rounds.compare(rounds.smallest_met())
    rounds.compare(rounds.table_heads())
    rounds.compare(rounds.remaining())
    heads = classes.select("cid", "doc_id")
    roots = rounds.labels.groupBy("component").agg(F.count(F.lit(1)).alias("c")).join(shuffled(heads.select(F.col("cid").alias("component"), F.col("doc_id").alias("root"))), "component")
    linked = met(rounds.labels, materialise(roots, "roots"), ["component"], rounds.labels.count()).withColumnRenamed("id", "cid")
    known = classes.select("cid", "d", "c", F.col("doc_id").alias("head_id"), F.col("text_id").alias("head_text")).join(shuffled(linked), "cid", "left")
    leads = F.coalesce(F.col("component") == F.col("cid"), F.lit(True))
    known = known.select("d", "c", F.when(F.col("component").isNull(), F.col("head_id")).otherwise(F.col("root")).alias("component_id"), "head_id", "head_text", leads.alias("leads"))
    judged = met(marks.where("n > 0").select("doc_id", "text_id", "n", "d"), materialise(known, "judged"), ["d"], marks.count())
    stays = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("text_id") == F.col("head_text"))
    judged = judged.select("doc_id", "n", "component_id", "text_id", stays.alias("stays"))
    empty = marks.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "text_id", F.lit(True).alias("stays"))
    out = judged.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), "stays"))
    named = lambda x: shuffled(heads.select(F.col("cid").alias(x), F.col("doc_id").alias(f"{x}_id")))
    links = rounds.links.join(named("a"), "a").join(named("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept", "text_id", "stays"), links


def _text_id(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def deduplicated(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, all columns as they were."""
    judged, _ = grouped(docs, text, **options)
    name, digest = fresh(docs, "gone_id"), fresh(docs, "gone_text")
    gone = materialise(judged.where(~F.col("stays")).select(F.col("doc_id").alias(name), F.col("text_id").alias(digest)).distinct(), "gone")
    same = docs["doc_id"].eqNullSafe(F.col(name)) & (_text_id(docs[text].cast("string")) == F.col(digest))
    return docs.join(sized(gone), same, "left_anti")
