"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fold_of(key: str, folds: int) -> Column:
    """The remainder of crc32 of a key's decimal text; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers take whole texts in Arrow batches of ``rows`` at most; Spark's default suits narrow rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


BROADCAST_ROWS = 200_000


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows``, to be joined by a shuffle: Spark never broadcasts either side by its own estimate.

    That counts the bytes of compressed files and nothing that an explode adds, so what it takes for 10 MB may fill the driver.
    """
    return rows.hint("merge")


def sized(small: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow keys, to be broadcast where its counted rows allow (some 20 MB at most) and shuffled beyond.

    Whole texts then stay where they are read while the keys are few.
    """
    return F.broadcast(small) if small.count() <= most_rows else shuffled(small)


def met(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` (``total`` of them) joined with ``facts`` (keys, how many rows have them as ``c``, more).

    Keys of over a 100,000th of the rows (so at most 100,000 keys) are broadcast, the others are shuffled:
    no key makes one task heavy.
    """
    most = max(1000, total // 100_000)
    often = F.broadcast(facts.where(F.col("c") >= most))
    rest = rows.join(often.select(*keys), keys, "left_anti").join(shuffled(facts.where(F.col("c") < most)), keys)
    return rows.join(often, keys).unionByName(rest).drop("c")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Memo(dict):
    """Values of a pure function; emptied when full, so that a task's memory stays bounded."""

    def __init__(self, compute: Callable, most: int = 300_000):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value
