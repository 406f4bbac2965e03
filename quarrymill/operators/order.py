"""Positions in a total order, without a single-task window."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarrymill.plans.storage import stored


def positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """``df`` with the row's number (from 0) in the total order given.

    Rows are range-partitioned and sorted, numbered inside their partition, and
    shifted by the sizes of the partitions before; only those sizes reach the
    driver.  The order should end with a unique column.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(width, *order).sortWithinPartitions(*order)
    local = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, bits = F.shiftright("_at", 33).cast("int"), (1 << 33) - 1
    sizes = sorted((r["p"], r["n"]) for r in local.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts = list(accumulate((n for _, n in sizes), initial=0))[:-1]
    # as an Arrow table, which needs no Python worker; a row a partition
    base = F.broadcast(df.sparkSession.createDataFrame(pa.table({"_part": pa.array([p for p, _ in sizes], pa.int32()), "_start": pa.array(starts, pa.int64())})))
    placed = local.withColumn("_part", part).join(base, "_part")
    return placed.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit(bits))).drop("_at", "_part", "_start")


def lookahead(df: DataFrame, k: int, pos: str = "pos", within: str | None = None) -> DataFrame:
    """Pairs (l, r structs) of each row and the next ``k`` rows in ``pos`` order.

    ``within`` keeps pairs of one partition value; as its rows are neighbours in
    the order, positions need not be counted anew in it.  Each left row is
    copied to two buckets of ``k`` positions and each right row stands in one,
    so this is an equi-join of small buckets, whatever the partition's size.
    """
    whole = F.struct(*[F.col(c) for c in df.columns])
    bucket = F.floor(F.col(pos) / k).cast("long")
    left = df.select(whole.alias("l"), F.explode(F.array(bucket, bucket + 1)).alias("b"))
    right = df.select(whole.alias("r"), bucket.alias("b"))
    near = (F.col(f"r.{pos}") > F.col(f"l.{pos}")) & (F.col(f"r.{pos}") <= F.col(f"l.{pos}") + k)
    if within:
        near &= F.col(f"l.{within}").eqNullSafe(F.col(f"r.{within}"))
    return left.join(right, "b").where(near).select("l", "r")
