"""Value distribution inside an entity and co-occurrence of two columns.

Rows become narrow rows (row number, what is wanted, value) once; counts, totals and lookups run over all wanted columns together, and the
results come back in one join. The number of exchanges does not depend on how much is wanted.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.tokens import token
from .stacked import ROW, numbered, stack, widen


def _key(key: list[str]):
    """The key as one text, different for different keys: every part with its length."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.concat(*[part(c) for c in key])


def value_distributions(df: DataFrame, wanted: list[tuple[list[str], str, str]]) -> DataFrame:
    """Distinct values, share and surprise of the current one, mode share, is-mode, entropy, normalised entropy.

    For every (key, column, prefix); all tables are counted from `df` itself.
    """
    rows = numbered(df)
    long = stack(rows, [{"_k": _key(key), "_v": token(column)} for key, column, _ in wanted], [ROW])
    pairs = long.groupBy("_c", "_k", "_v").agg(F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n").cast("double")
    per_key = pairs.groupBy("_c", "_k").agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_u"), F.max("_n").alias("_mode"),
                                            (F.log(n) - F.sum(F.col("_n") * F.log("_n")) / n).alias("_h"))
    t = long.join(pairs.join(per_key, ["_c", "_k"]), ["_c", "_k", "_v"])
    share = F.col("_n") / F.col("_all")
    # entropy of one value is 0 by definition; the difference of logs may leave a last-digit residue
    h = F.when(F.col("_u") == 1, 0.0).otherwise(F.col("_h"))
    stats = {"nunique": F.col("_u"), "share": share, "surprise": -F.log(F.greatest(share, F.lit(1e-8))), "mode_share": F.col("_mode") / F.col("_all"),
             "is_mode": (F.col("_n") == F.col("_mode")).cast("int"), "entropy": h,
             "normalized_entropy": h / F.log(F.greatest(F.col("_u"), F.lit(2)).cast("double"))}
    return widen(rows, t, {f"{prefix}_{name}": (i, c) for i, (_, _, prefix) in enumerate(wanted) for name, c in stats.items()})


def value_distribution(df: DataFrame, key: list[str], column: str, prefix: str) -> DataFrame:
    return value_distributions(df, [(key, column, prefix)])


def cooccurrences(df: DataFrame, wanted: list[tuple[str, str, str]]) -> DataFrame:
    """Log pair count, both conditional shares, both fan-outs for every (first, second, prefix)."""
    rows = numbered(df)
    long = stack(rows, [{"_a": token(first), "_b": token(second)} for first, second, _ in wanted], [ROW])
    pairs = long.groupBy("_c", "_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    t = pairs
    for side in ("_a", "_b"):
        t = t.join(pairs.groupBy("_c", side).agg(F.sum("_n").alias(f"{side}_n"), F.count(F.lit(1)).alias(f"{side}_u")), ["_c", side])
    t = long.join(t, ["_c", "_a", "_b"])
    stats = {"log_pairs": F.log1p("_n"), "given_first": F.col("_n") / F.col("_a_n"), "given_second": F.col("_n") / F.col("_b_n"),
             "first_nunique": F.col("_a_u"), "second_nunique": F.col("_b_u")}
    return widen(rows, t, {f"{prefix}_{name}": (i, c) for i, (_, _, prefix) in enumerate(wanted) for name, c in stats.items()})


def cooccurrence(df: DataFrame, first: str, second: str, prefix: str) -> DataFrame:
    return cooccurrences(df, [(first, second, prefix)])
