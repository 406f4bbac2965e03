"""Column lists and defaults of tables whose columns vary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrymill.functions import coerce


def ordered(df: DataFrame, first: list[str], private: bool = True) -> DataFrame:
    """Columns of ``first`` that exist, then the others; without ``private`` those beginning with _ go."""
    rest = [c for c in df.columns if c not in first and (private or not c.startswith("_"))]
    return df.select(*[c for c in first if c in df.columns], *rest)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing columns are added, and nulls filled, with the defaults; numeric ones are coerced."""
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            df = df.withColumn(name, F.coalesce(coerce.number(F.col(name)), F.lit(float(value))))
        elif value is not None:
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return df


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, or ValueError naming the columns that it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_nulls(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the columns (name: type) that it lacks, as nulls."""
    return df.withColumns({n: F.lit(None).cast(kind) for n, kind in columns.items() if n not in df.columns})
