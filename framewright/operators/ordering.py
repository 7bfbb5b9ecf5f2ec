"""Order-dependent operators that survive one group holding most of the rows.

There is one plan. Rows are dealt to tasks by ranges of (group, order, tie) in one exchange and
written in that order, so a group may fill any number of tasks and each task holds a contiguous stretch of
it. A row's number then says its part and its place in the part; one small row for each (group, part)
carries counts, sums or last rows over to the parts behind it. Ranks, running sums, lags and quantiles are exact.

The written rows cut the lineage: parts must not be dealt anew between the pass that sums them up
and the pass that uses the sums. A range of rows equal in (group, order, tie) cannot be split, so ``tie``
should tell rows apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewright.session import materialise

PLACE = (1 << 33) - 1  # a row's number holds its place in the part below its part


def _direction(name: str, descending: bool) -> Column:
    return F.col(name).desc() if descending else F.col(name).asc()


def dealt(df: DataFrame, keys: Sequence[str], order: str, tie: str | None = None, *, descending: bool = False, tie_descending: bool = False,
          partitions: int | None = None) -> DataFrame:
    """The rows, written in ranges of (keys, order, tie), with their part ``_part`` and their number ``_at``."""
    cut = [*[F.col(k).asc() for k in keys], _direction(order, descending)]
    if tie is not None and tie != order:
        cut.append(_direction(tie, tie_descending))
    ranged = df.repartitionByRange(partitions, *cut) if partitions else df.repartitionByRange(*cut)
    rows = materialise(ranged.sortWithinPartitions(*cut).withColumn("_at", F.monotonically_increasing_id()), "dealt")
    return rows.withColumn("_part", F.shiftright("_at", 33))


def _stretches(rows: DataFrame, keys: list[str], totals: list[Column], carried: list[Column]) -> DataFrame:
    """One written row for each (keys, part): what ``carried`` makes of the ``totals`` of the parts before it."""
    each = rows.groupBy(*keys, "_part").agg(*totals)
    found = each.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), *carried)
    return materialise(found, "stretches")


def _joined(rows: DataFrame, stretches: DataFrame, keys: list[str]) -> DataFrame:
    match = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(stretches, match).drop("_p", *[f"_k{i}" for i in range(len(keys))])


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def rank_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    *,
    name: str = "rank",
    size: str | None = None,
    descending: bool = False,
    tie_descending: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Exact 1-based rank of every row in its group, and the group's size in ``size``; (order, tie) must be a total order."""
    keys = list(keys)
    rows = dealt(df, keys, order, tie, descending=descending, tie_descending=tie_descending, partitions=partitions)
    earlier = F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)) - F.col("_first") + 1
    carried = [earlier.alias("_offset")] + ([F.sum("_n").over(Window.partitionBy(*keys)).alias(size)] if size else [])
    stretches = _stretches(rows, keys, [F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")], carried)
    return _joined(rows, stretches, keys).withColumn(name, F.col("_at") + F.col("_offset")).drop("_at", "_part", "_offset")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str | None,
    value: Column,
    *,
    name: str,
    total: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` along (order, tie) in each group, and the group's sum in ``total``."""
    keys = list(keys)
    rows = dealt(df.withColumn("_value", value), keys, order, tie, partitions=partitions)
    carried = [F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_offset")] + (
        [F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else [])
    stretches = _stretches(rows, keys, [F.sum("_value").alias("_n")], carried)
    within = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn(name, F.sum("_value").over(within))
    return _joined(summed, stretches, keys).withColumn(name, F.col(name) + F.col("_offset")).drop("_at", "_part", "_offset", "_value")


def previous_row(df: DataFrame, keys: Sequence[str], order: str, tie: str, value: str, *, name: str, partitions: int | None = None) -> DataFrame:
    """``value`` of the row before this one along (order, tie) in each group, null for the first."""
    keys = list(keys)
    rows = dealt(df, keys, order, tie, partitions=partitions)
    last = F.max_by(F.struct(F.col(value).alias("v")), F.col("_at")).alias("_last")
    stretches = _stretches(rows, keys, [last, F.min("_at").alias("_first")],
                           ["_first", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")).alias("_carried")])
    within = Window.partitionBy(*keys, "_part").orderBy("_at")
    looked = rows.withColumn(name, F.lag(value).over(within))
    found = F.when(F.col("_at") == F.col("_first"), F.col("_carried.v")).otherwise(F.col(name))
    return _joined(looked, stretches, keys).withColumn(name, found).drop("_at", "_part", "_first", "_carried")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], *, partitions: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles, one written row per group and one column per share.

    Rows are first reduced to (group, value, count), so repeated values collapse
    before anything is ordered; null and NaN values are left out.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    counted = (
        df.select(*keys, v.alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    reached = running_sum(counted, keys, "_v", None, F.col("_c"), name="_upto", total="_total", partitions=partitions)
    picks = []
    for name, share in shares.items():
        position = (F.col("_total") - 1) * F.lit(float(share))
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(F.min(F.when(F.col("_upto") > rank, F.col("_v"))).alias(f"{name}_{side}"))
        picks.append(F.max(position - F.floor(position)).alias(f"{name}_part"))
    found = reached.groupBy(*keys).agg(*picks)
    between = [(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_part")).alias(n) for n in shares]
    return materialise(found.select(*keys, *between), "quantiles")


def medians(df: DataFrame, keys: Sequence[str], values: dict[str, str], *, partitions: int | None = None) -> DataFrame:
    """Exact medians of several columns: {output name: input column}.

    The columns are unpivoted so that all of them share one pass and one shuffle.
    """
    keys = list(keys)
    entries = F.array(*[F.struct(F.lit(n).alias("_name"), F.col(c).cast("double").alias("_value")) for n, c in values.items()])
    long = df.select(*keys, F.inline(entries))
    found = quantiles(long, keys + ["_name"], "_value", {"_q": 0.5}, partitions=partitions)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in values])
