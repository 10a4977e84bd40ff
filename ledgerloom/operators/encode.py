"""Column selection, type narrowing, dictionary codes and category domains."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F, types as T

from ..config import RAW_NAMES, RAW_PATTERNS, UNSTABLE_V
from .joins import attach, attach_bounded
from .ranks import ordinal


def columns_like(columns: list[str], *patterns: str, exclude: tuple = ()) -> list[str]:
    """Columns that match a pattern in full, in their order, without those that match an excluded one."""
    hit = lambda c, ps: any(re.fullmatch(p, c) for p in ps)
    return [c for c in columns if hit(c, patterns) and not hit(c, exclude)]


def union_columns(*groups: list[str]) -> list[str]:
    return list(dict.fromkeys(c for g in groups for c in g))


def raw_selection(columns: list[str], top_v: tuple = ()) -> list[str]:
    """Curated raw columns: fixed names, families and frequency columns, without the unstable V range."""
    unstable = {f"V{i}" for i in range(UNSTABLE_V[0], UNSTABLE_V[1] + 1)}
    wanted = set(columns_like(columns, *RAW_PATTERNS)) | set(RAW_NAMES) | set(top_v)
    return union_columns([c for c in columns if c in wanted and c not in unstable])


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; absent ones are NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])


def narrow(df: DataFrame, keep: tuple = ()) -> DataFrame:
    """Doubles to 32 bits, whole numbers to the smallest type their values fit (one row of min and max)."""
    whole = [f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.IntegerType)) and f.name not in keep]
    limits = (df.agg(*[g(c).alias(f"{g.__name__}_{c}") for c in whole for g in (F.min, F.max)]).first()
              if whole else None)

    def smallest(c):
        low, high = limits[f"min_{c}"] or 0, limits[f"max_{c}"] or 0
        for name, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
            if -(1 << bits) <= low and high < (1 << bits):
                return name
        return "bigint"

    return df.select(*[F.col(f.name).cast("float") if isinstance(f.dataType, T.DoubleType) and f.name not in keep
                       else F.col(f.name).cast(smallest(f.name)).alias(f.name) if f.name in whole
                       else F.col(f.name) for f in df.schema])


def first_seen_codes(df: DataFrame, column: str, order: list[str], out: str) -> DataFrame:
    """0, 1, … in the order in which values first appear; missing is -1."""
    first = (df.filter(F.col(column).isNotNull()).groupBy(column)
             .agg(F.min(F.struct(*order)).alias("_first")))
    codes = ordinal(first, ["_first"], "_code").select(column, (F.col("_code") - 1).alias(out))
    return attach(df, codes, [column]).withColumn(out, F.coalesce(out, F.lit(-1)))


def sorted_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """0, 1, … in the sort order of the values; missing is -1."""
    codes = ordinal(df.select(column).filter(F.col(column).isNotNull()).distinct(), [column], "_code")
    codes = codes.select(column, (F.col("_code") - 1).alias(out))
    return attach(df, codes, [column]).withColumn(out, F.coalesce(out, F.lit(-1)))


def pair_codes(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    pair = df.withColumn(out, F.concat_ws("_", F.col(left).cast("string"), F.col(right).cast("string")))
    return sorted_codes(pair, out, f"{out}_code")


def history_domain(df: DataFrame, history: DataFrame, column: str) -> DataFrame:
    """Values the history does not hold become missing."""
    domain = history.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("_known", F.lit(True))
    return attach(df, domain, [column]).withColumn(column, F.when(F.col("_known"), F.col(column))).drop("_known")


def shift_to_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Subtract the column minimum (0 if it has none); missing is -1."""
    lows = df.agg(*[F.coalesce(F.min(c), F.lit(0)).alias(f"_min_{c}") for c in columns]).withColumn("_one", F.lit(1))
    d = attach_bounded(df.withColumn("_one", F.lit(1)), lows, ["_one"])     # one row
    return (d.withColumns({c: F.coalesce(F.col(c) - F.col(f"_min_{c}"), F.lit(-1)) for c in columns})
            .drop("_one", *[f"_min_{c}" for c in columns]))


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in columns})
