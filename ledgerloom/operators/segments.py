"""Which query rows belong to entities the history knows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import MEMBERSHIP
from ..functions.tokens import all_present, clean_mail, compose, integer_token, origin_day
from .joins import attach, attach_bounded, keep_matching


def uid_metadata(df: DataFrame, dt: str, back: str, card: list[str], mail: str, how: str) -> DataFrame:
    """Three entity keys of decreasing strictness with their validity. Strict does not need the mail part."""
    o = integer_token(origin_day(dt, back, how))
    whole = all_present(*card, back)
    return df.withColumns({"strict_uid": compose(*card, o, mail), "card_uid": compose(*card, o),
                           "mail_uid": compose(o, mail), "strict_valid": whole, "card_valid": whole,
                           "mail_valid": all_present(back, mail)})


def seen(query: DataFrame, history: DataFrame, keys: list[str], valid: str | Column, out: str) -> DataFrame:
    """Flag: the row's valid key occurs on a valid history row."""
    ok = F.col(valid) if isinstance(valid, str) else valid
    known = history.filter(ok).select(*keys).distinct().withColumn("_known", F.lit(True))
    return (attach(query, known, keys)
            .withColumn(out, ok & F.coalesce("_known", F.lit(False))).drop("_known"))


def segments(query: DataFrame, history: DataFrame, out: str = "segment") -> DataFrame:
    """strict: exact entity known; partial: a wider key known; cold: neither. Both sides from `uid_metadata`."""
    d = query
    for name in ("strict", "card", "mail"):
        d = seen(d, history, [f"{name}_uid"], f"{name}_valid", f"_{name}")
    return (d.withColumn(out, F.when(F.col("_strict"), "strict").when(F.col("_card") | F.col("_mail"), "partial")
                         .otherwise("cold")).drop("_strict", "_card", "_mail"))


def repeated_rows(history: DataFrame, key: list[str], valid: str, minimum: int = 2) -> DataFrame:
    """History rows whose valid key occurs at least `minimum` times."""
    ok = history.filter(F.col(valid))
    often = ok.groupBy(*key).count().filter(F.col("count") >= minimum).select(*key)
    return keep_matching(ok, often, key)


def with_client_keys(df: DataFrame, dt: str, back: str, mail: str) -> DataFrame:
    return df.withColumns({"origin": origin_day(dt, back, "round"), "clean_email": clean_mail(mail)})


def _known(d: DataFrame, history: dict[str, Column], query: dict[str, Column], groups: dict) -> DataFrame:
    """The membership columns from the counts of each group."""
    out = {}
    for name, (keys, _) in groups.items():
        h = F.coalesce(history[name], F.lit(0))
        out |= {f"{name}_valid": all_present(*keys).cast("int"), f"{name}_seen": (h > 0).cast("int"), f"{name}_history_count": F.log1p(h),
                f"{name}_query_count": F.log1p(F.coalesce(query[name], F.lit(0)))}
    d = d.withColumns(out)
    names = list(groups)
    strict = F.col(f"{names[0]}_seen") == 1
    broad = F.greatest(*[F.col(f"{n}_seen") for n in names[1:]]) == 1
    return d.withColumns({"segment_strict": strict.cast("int"), "segment_partial": (~strict & broad).cast("int"),
                          "segment_cold": (~strict & ~broad).cast("int"),
                          "seen_keys": sum((F.col(f"{n}_seen") for n in names), F.lit(0))})


def membership(query: DataFrame, history: DataFrame, groups: dict = MEMBERSHIP) -> DataFrame:
    """Per key group: validity, seen, log history count, log query count; then the segment flags.

    The first group is the strict one; any other seen group makes a row partial. Counts are made per side before
    the lookup, so a key that holds most rows is one row of the lookup table.
    """
    d = query
    for name, (keys, _) in groups.items():
        ok = all_present(*keys)
        sides = [side.filter(ok).select(*keys, F.lit(i).alias("_side")) for i, side in enumerate((history, query))]
        counts = (sides[0].unionByName(sides[1]).groupBy(*keys)
                  .agg(F.count_if(F.col("_side") == 0).alias(f"_h_{name}"), F.count_if(F.col("_side") == 1).alias(f"_q_{name}")))
        d = attach(d, counts, list(keys))
    out = _known(d, {n: F.col(f"_h_{n}") for n in groups}, {n: F.col(f"_q_{n}") for n in groups}, groups)
    return out.drop(*[f"_{x}_{n}" for n in groups for x in "hq"])


def fold_membership(df: DataFrame, day: str, folds: tuple, groups: dict = MEMBERSHIP) -> DataFrame:
    """Membership of every fold's validation rows against the rows before that fold's cut.

    One row per key holds the history and validation counts of all folds as arrays: one pass over the rows and one lookup per group, and rows
    are copied into their folds after it.
    """
    t = F.col(day)
    inside = [(t < end, (t >= start) & (F.lit(True) if stop is None else t < stop)) for end, start, stop in folds]
    used = F.lit(False)
    for _, valid in inside:
        used = used | valid
    d = df.filter(used)
    for name, (keys, _) in groups.items():
        counts = df.filter(all_present(*keys)).groupBy(*keys).agg(F.array(*[F.count_if(past) for past, _ in inside]).alias(f"_h_{name}"),
                                                                F.array(*[F.count_if(valid) for _, valid in inside]).alias(f"_q_{name}"))
        d = attach(d, counts, list(keys))
    mine = F.filter(F.array(*[F.when(valid, F.lit(n)) for n, (_, valid) in enumerate(inside)]), lambda x: x.isNotNull())
    d = d.withColumn("fold", F.explode(mine))
    at = lambda x, n: F.get(f"_{x}_{n}", F.col("fold"))
    return _known(d, {n: at("h", n) for n in groups}, {n: at("q", n) for n in groups}, groups).drop(*[f"_{x}_{n}" for n in groups for x in "hq"])


def segment_label(df: DataFrame, out: str = "segment") -> DataFrame:
    return df.withColumn(out, F.when(F.col("segment_strict") == 1, "strict")
                         .when(F.col("segment_partial") == 1, "partial").otherwise("cold"))


def segment_shares(df: DataFrame, segment: str) -> DataFrame:
    n = df.groupBy(segment).count()
    total = n.agg(F.sum("count").alias("_t")).withColumn("_one", F.lit(1))
    return (attach_bounded(n.withColumn("_one", F.lit(1)), total, ["_one"])
            .select(segment, F.col("count").alias("rows"), (F.col("count") / F.col("_t")).alias("share")))
