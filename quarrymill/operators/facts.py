"""Rows with aggregates over the rows of their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: A key with at least 1/HEAVY of all rows, and more than LEAST, is heavy; there are at most HEAVY such keys.
HEAVY, LEAST = 1000, 10_000


def heavy_keys(df: DataFrame, key: str) -> list:
    """The keys that would make a window's partition large."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    if not most or most <= LEAST or most * HEAVY < total:
        return []
    return [r[0] for r in counts.where((F.col("_n") * HEAVY >= total) & (F.col("_n") > LEAST)).select(key).collect()]


def with_facts(df: DataFrame, key: str, facts: dict[str, Column]) -> DataFrame:
    """``df`` with the aggregates ``facts`` of each row's key, in one shuffle.

    Rows of a null key stay, with null facts.  Light keys are windows.  The facts
    of heavy ones, a bounded number of rows, are folded and broadcast, so no task
    gets all rows of a key.
    """
    hot = heavy_keys(df, key)
    known = df.where(F.col(key).isNotNull())
    light = known.where(~F.col(key).isin(hot)) if hot else known
    over = W.partitionBy(key)
    out = light.withColumns({n: f.over(over) for n, f in facts.items()})
    if hot:
        heavy = known.where(F.col(key).isin(hot))
        folded = heavy.groupBy(key).agg(*[f.alias(n) for n, f in facts.items()])
        out = out.union(heavy.join(F.broadcast(folded), key).select(out.columns))
    kinds = {f.name: f.dataType for f in out.schema}
    alone = df.where(F.col(key).isNull()).withColumns({n: F.lit(None).cast(kinds[n]) for n in facts})
    return out.union(alone.select(out.columns))
