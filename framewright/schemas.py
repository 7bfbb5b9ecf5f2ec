"""Table schemas, fixed and checked rather than inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FRAMES = ("capture_id string, frame_index bigint, ts_ticks bigint, height int, width int, channels int, color_mode string, "
          "bit_depth int, pixels binary")
MEASUREMENTS = ("capture_id string, frame_index bigint, quality double, width_px double, height_px double, angle_rad double, "
                "status string")
SELECTION = MEASUREMENTS + ", valid boolean, low_quality boolean, width_outlier boolean, height_outlier boolean, accepted boolean"
ACCUMULATOR = "capture_id string, pos int, sum_wv double, sum_w double"
GAPS = "seed int, regime double, crop string, gap string, g double, pathological boolean"


def schema_errors(df: DataFrame, expected: str) -> list[str]:
    """What is wrong with the columns of ``df``; an empty list when nothing is."""
    wanted = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(expected)}
    found = {f.name: f.dataType.simpleString() for f in df.schema}
    missing = [f"missing column {n} {t}" for n, t in wanted.items() if n not in found]
    return missing + [f"column {n} is {found[n]}, expected {t}" for n, t in wanted.items() if n in found and found[n] != t]


def value_errors(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, rows) for every SQL rule that some rows break."""
    broken = [F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in rules.items()]
    counts = df.agg(*broken)
    return counts.unpivot([], list(rules), "rule", "rows").where("rows > 0")


def require(spark: SparkSession, df: DataFrame, expected: str) -> DataFrame:
    errors = schema_errors(df, expected)
    if errors:
        raise ValueError("; ".join(errors))
    return df
