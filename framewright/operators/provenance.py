"""Digests and records that say what a result was made from."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.ordering import rank_rows

BLOCK = 4096


def json_safe(value):
    """Non-finite numbers become null; everything else stays."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def canonical_digest(record: dict) -> str:
    return hashlib.sha256(json.dumps(json_safe(record), sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def mismatches(a: dict, b: dict, *, relative: float = 1e-9, absolute: float = 0.0) -> list[str]:
    """Names whose values differ beyond the tolerance, or that one record lacks."""
    def same(x, y) -> bool:
        if isinstance(x, float) or isinstance(y, float):
            return isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=relative, abs_tol=absolute)
        return x == y

    return sorted(k for k in {*a, *b} if k not in a or k not in b or not same(a[k], b[k]))


def row_digest(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\u001f", *columns), 256)


def _hashed(level: DataFrame, keys: list[str], node: Column) -> DataFrame:
    """The digests under each ``node``, hashed in order."""
    rows = level.groupBy(*keys, node.alias("_block")).agg(F.array_sort(F.collect_list(F.struct("_at", "_d"))).alias("l"), F.sum("leaves").alias("leaves"))
    hashed = F.sha2(F.array_join(F.transform("l", lambda x: x["_d"]), ""), 256)
    return rows.select(*keys, F.col("_block").alias("_at"), "l", hashed.alias("_d"), "leaves")


def _placed(leaves: DataFrame, keys: list[str], order: str, leaf: str) -> DataFrame:
    placed = rank_rows(leaves.select(*keys, order, leaf), keys, order, order, name="_rank")
    return placed.select(*keys, (F.col("_rank") - 1).alias("_at"), F.col(leaf).alias("_d"), F.lit(1).cast("bigint").alias("leaves"))


def ordered_digest(leaves: DataFrame, keys: Sequence[str], order: str, leaf: str, *, block: int = BLOCK) -> DataFrame:
    """One digest per group over its leaf digests in order.

    A tree: digests are hashed in blocks of ``block``, then blocks of those, until one is
    left, so no row ever gathers more than ``block`` digests. The first two levels are always
    hashed; above them a group's only digest stands. The leaves of the largest group are counted
    first and give the number of levels.
    """
    keys = list(keys)
    if block < 2:
        raise ValueError("a block of a digest tree holds two digests at least")
    most = leaves.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    level, depth, nodes = _placed(leaves, keys, order, leaf), 0, most
    while depth < 2 or nodes > 1:
        up = _hashed(level, keys, F.floor(F.col("_at") / block))
        alone = (F.size("l") == 1) & (F.col("l")[0]["_at"] == 0)  # a group with more has a second one in its first block
        level = up.select(*keys, "_at", (F.when(alone, F.col("l")[0]["_d"]).otherwise(F.col("_d")) if depth > 1 else F.col("_d")).alias("_d"), "leaves")
        depth, nodes = depth + 1, -(-nodes // block)
    return level.select(*keys, "leaves", F.col("_d").alias("digest"))


def frame_digests(frames: DataFrame) -> DataFrame:
    """Digest per frame over its sample type and its bytes."""
    return frames.select("capture_id", "frame_index", F.sha2(F.concat(F.encode(F.lit("<u2"), "UTF-8"), "pixels"), 256).alias("leaf"))


EDGE_BYTES = 1 << 16


def file_stamps(path: str) -> dict[str, list]:
    """Size, time and digest of the first and last 64 KiB of a capture file, or of each file of a folder: a cheap proof, not a full hash."""
    import os

    files = sorted(os.path.join(path, n) for n in os.listdir(path)) if os.path.isdir(path) else [path]
    out = {}
    for name in files:
        facts = os.stat(name)
        with open(name, "rb") as file:
            edge = hashlib.sha256(file.read(EDGE_BYTES))
            file.seek(max(0, facts.st_size - EDGE_BYTES))
            edge.update(file.read(EDGE_BYTES))
        out[os.path.basename(name)] = [facts.st_size, facts.st_mtime_ns, edge.hexdigest()]
    return out
