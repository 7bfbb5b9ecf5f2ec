"""Digests, export mapping and streaming over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framewright.operators import evaluation as EV
from framewright.operators import provenance as PV
from framewright.operators import stacking as ST
from framewright.operators.screening import screen
from framewright.plans.evaluation import GAP_CLASS
from framewright.plans.frames import PX_SQL
from framewright.plans.registry import query
from framewright.plans.screening import SCREENED
from framewright.session import shared_folder
from framewright.sources import sinks
from framewright.sources import tables as T
from framewright.streaming import stack as SS

KEY = "capture_id"


def _tree_sql(key: str, leaves: str, block: int, levels: int) -> str:
    """Levels of a digest tree over the numbered leaves (r, leaf): two always hash, above them a group's only digest stands."""
    out, before, at, digest = "", leaves, "r", "leaf"
    for k in range(1, levels + 1):
        hashed = f"sha256(string_agg({digest}, '' ORDER BY {at}))"
        kept = f"CASE WHEN count(*) = 1 AND min({at}) = 0 THEN any_value({digest}) ELSE {hashed} END" if k > 2 else hashed
        out += f", t{k} AS (SELECT {key}, {at} // {block} AS i{k}, {'count(*)' if k == 1 else 'sum(n)'} AS n, {kept} AS d{k} FROM {before} GROUP BY 1, 2)"
        before, at, digest = f"t{k}", f"i{k}", f"d{k}"
    return out + f" SELECT {key}, sum(n)::BIGINT AS leaves, any_value({digest}) AS digest FROM {before} GROUP BY 1"


@query("capture_digest", "AGG-34 FN-11", """
WITH l AS (SELECT source, doc_id, sha256(text) AS leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents)""" + _tree_sql("source", "l", 64, 5))
def capture_digest(spark, folder):
    leaves = T.load(spark, folder, "documents").select("source", "doc_id", F.sha2("text", 256).alias("leaf"))
    return PV.ordered_digest(leaves, ["source"], "doc_id", "leaf", block=64)


@query("selection_digest", "AGG-35 SUP-18", SCREENED + """
, l AS (SELECT capture_id, frame_index, sha256(frame_index || chr(31) || CASE WHEN accepted THEN 'true' ELSE 'false' END) AS leaf,
               row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) - 1 AS r FROM screened)""" + _tree_sql("capture_id", "l", 64, 5))
def selection_digest(spark, folder):
    rows = screen(T.measurements(spark, folder)).select(
        KEY, "frame_index", PV.row_digest("frame_index", "accepted").alias("leaf"))
    return PV.ordered_digest(rows, [KEY], "frame_index", "leaf", block=64)


MEAN = PX_SQL + ", s AS (SELECT capture_id, y, x, avg(v) AS value FROM px GROUP BY 1, 2, 3)"


def mean_stack(spark, folder):
    return ST.normalise(ST.stack(T.frames(spark, folder), [KEY], F.col("pixels"), F.lit(1.0)))


@query("export_codes", "SNK-4 SUP-37", MEAN + """
SELECT capture_id, y, x, floor(least(greatest((value + 0.05) / 0.1, 0), 1) * 65535 + 0.5)::INTEGER AS code FROM s""")
def export_codes(spark, folder):
    code = sinks.to_codes(F.col("value"), F.col("valid"), -0.05, 0.05)
    return ST.place(mean_stack(spark, folder), 8, 8).select(KEY, "y", "x", code.alias("code"))


@query("export_counts", "SNK-4 (clip counts)", MEAN + """
SELECT capture_id, 0::BIGINT AS invalid_samples, count(*) FILTER (WHERE value < -0.02) AS clipped_low_samples, count(*) FILTER (WHERE value > 0.02) AS clipped_high_samples FROM s GROUP BY 1""")
def export_counts(spark, folder):
    return sinks.export_counts(mean_stack(spark, folder), [KEY], -0.02, 0.02)


@query("classification_text", "SNK-8", f"WITH g AS ({T.GAPS_SQL}), c AS (" + GAP_CLASS.format(key="regime") + """)
SELECT regime, printf('regime %s: %s, n=%d, median %.4f [%.4f, %.4f]', regime, label, n, median, p16, p84) AS line FROM c""")
def classification_text(spark, folder):
    return EV.classify_gaps(T.gap_rows(spark, folder), ["regime"]).select("regime", sinks.classification_line().alias("line"))


@query("streamed_stack", "STR-1 STR-2 SNK-5 SRC-12", MEAN + "SELECT capture_id, y, x, round(value, 8) AS value FROM s")
def streamed_stack(spark, folder):
    """The same stack as a stream of files folded batch by batch; the table may be one file or a folder of them."""
    target = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = T.load(spark, folder, "embeddings").schema
    # A file stream takes a single file only by a pattern, and a filter on names would miss the files of a folder.
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder.rstrip('/')}/{{embeddings.parquet}}")
              .select(F.col("label").cast("long").alias(KEY), F.col("vec_id").alias("frame_index"), F.col("embedding").alias("pixels")))
    SS.fold_stream(stream, target, [KEY], F.col("pixels"), F.lit(1.0), {"weight": "equal"}).awaitTermination()
    total = ST.normalise(SS.stack_so_far(spark, target, [KEY]))
    return ST.place(total, 8, 8).select(KEY, "y", "x", F.round("value", 8).alias("value"))
