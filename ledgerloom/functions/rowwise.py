"""Per-row features: time, amount shape, mail, device, column-family statistics.

Every function adds columns to a DataFrame with built-in expressions only.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DAY, DEVICE_BRANDS, MOBILE_BROWSER, MOBILE_DEVICE
from .tokens import col, day_of, token


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def not_negative(c: str | Column) -> Column:
    return F.when(col(c) < 0, F.lit(0.0)).otherwise(col(c))


def add(parts: list[Column]) -> Column:
    """Sum as a balanced tree: a chain of hundreds of additions is too deep for the analyzer."""
    if len(parts) <= 2:
        return parts[0] + parts[1] if len(parts) == 2 else parts[0]
    half = len(parts) // 2
    return add(parts[:half]) + add(parts[half:])


# time -------------------------------------------------------------------------------------------------------
def clock(df: DataFrame, dt: str) -> DataFrame:
    return df.withColumns({"day": day_of(dt), "week": F.floor(F.col(dt) / F.lit(7.0 * DAY)),
                           "hour": F.pmod(F.floor(F.col(dt) / 3600), F.lit(24)),
                           "dayofweek": F.pmod(day_of(dt), F.lit(7))})


def calendar(df: DataFrame, dt: str, epoch: str) -> DataFrame:
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(epoch).cast("timestamp")) + F.col(dt))
    return df.withColumn("_at", at).withColumns({
        "month": F.month("_at"), "dayofmonth": F.dayofmonth("_at"), "weekofyear": F.weekofyear("_at"),
        "is_weekend": (F.weekday("_at") >= 5).cast("int"), "minute": F.minute("_at"),
        "second_of_day": F.pmod(F.col(dt), F.lit(DAY))}).drop("_at")


def cycles(df: DataFrame, dt: str) -> DataFrame:
    turn = lambda period: F.col(dt) * F.lit(2 * math.pi / period)
    return df.withColumns({"hour_sin": F.sin(turn(DAY)), "hour_cos": F.cos(turn(DAY)),
                           "week_sin": F.sin(turn(7 * DAY)), "week_cos": F.cos(turn(7 * DAY))})


def month_index(df: DataFrame, dt: str, epoch: str, out: str = "month_index") -> DataFrame:
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(epoch).cast("timestamp")) + F.col(dt))
    return df.withColumn(out, (F.year(at) - F.year(F.lit(epoch).cast("date"))) * 12 + F.month(at))


# amounts ----------------------------------------------------------------------------------------------------
def amount_shape(df: DataFrame, amount: str) -> DataFrame:
    a = F.col(amount)
    whole = lambda m: (F.pmod(a, F.lit(m)) <= 1e-8).cast("int")
    return df.withColumns({"log1p": F.log1p(a), "cents": F.pmod(F.rint((a - F.floor(a)) * 100), F.lit(100.0)),
                           "is_integer": whole(1.0), "is_round_10": whole(10.0)})


def amount_digits(df: DataFrame, amount: str, endings: tuple = (0, 25, 50, 95, 99)) -> DataFrame:
    a = F.col(amount)
    cents = F.pmod(F.rint(a * 100), F.lit(100.0))
    log = F.log10(not_negative(a) + 0.01)
    return df.withColumns({"log10": log, "magnitude": F.floor(log),
                           "thousandths": F.pmod(F.rint(a * 1000), F.lit(1000.0)),
                           "to_integer": F.abs(a - F.rint(a)), "cent_ending": cents}
                          | {f"ends_{e:02d}": (cents == e).cast("int") for e in endings})


def multiple_distance(df: DataFrame, amount: str, moduli: tuple, zero_tolerance: float | None = None) -> DataFrame:
    out = {}
    for m in moduli:
        rest = F.pmod(F.col(amount), F.lit(float(m)))
        out[f"mod_{m}_distance"] = F.least(rest, m - rest)
        if zero_tolerance is not None:
            out[f"mod_{m}_is_zero"] = (rest <= zero_tolerance).cast("int")
    return df.withColumns(out)


def fraction(df: DataFrame, amount: str, out: str = "fraction") -> DataFrame:
    return df.withColumn(out, F.col(amount) - F.floor(amount))


# days back and counters -------------------------------------------------------------------------------------
def minus_day(df: DataFrame, dt: str, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_minus_day": F.col(c) - F.col(dt) / F.lit(float(DAY)) for c in columns})


def origins(df: DataFrame, dt: str, columns: list[str]) -> DataFrame:
    out = {}
    for c in columns:
        exact = F.col(dt) / F.lit(float(DAY)) - F.col(c)
        out |= {f"{c}_origin": F.rint(exact), f"{c}_origin_week": F.floor(F.rint(exact) / 7),
                f"{c}_origin_distance": F.abs(exact - F.rint(exact))}
    return df.withColumns(out)


def origin_spread(df: DataFrame, dt: str, columns: list[str]) -> DataFrame:
    """Spread of the rounded origins in a row and how many lie within one day of the first column's."""
    exact = [F.rint(F.col(dt) / F.lit(float(DAY)) - F.col(c)) for c in columns]
    d = df.withColumn("_o", F.filter(F.array(*exact), lambda x: x.isNotNull())).withColumn("_first", exact[0])
    d = _array_stats(d, "_o", "origin")
    return d.withColumns({
        "origin_range": F.col("origin_max") - F.col("origin_min"),
        "origin_nunique": F.size(F.array_distinct("_o")),
        "origin_matches": F.size(F.filter("_o", lambda x: F.coalesce(F.abs(x - F.col("_first")) <= 1, F.lit(False)))),
    }).drop("_o", "_first", "origin_min", "origin_max")


def counter_shape(df: DataFrame, columns: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{c}_log1p": F.log1p(not_negative(c)) for c in columns}
                          | {f"{a}_to_{b}": divide(F.col(a), F.col(b)) for a, b in pairs})


# column families --------------------------------------------------------------------------------------------
def _array_stats(df: DataFrame, values: str, prefix: str) -> DataFrame:
    """Mean, sample deviation, min, max of an array of present values."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    d = df.withColumn("_mean", F.try_divide(total, F.size(values)))
    spread = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - F.col("_mean")) * (x - F.col("_mean")))
    return d.withColumns({f"{prefix}_mean": F.col("_mean"),
                          f"{prefix}_std": F.sqrt(F.when(F.size(values) > 1, F.try_divide(spread, F.size(values) - 1))),
                          f"{prefix}_min": F.array_min(values), f"{prefix}_max": F.array_max(values)}).drop("_mean")


def row_stats(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """Missing count, mean, sample deviation, min, max over a family of columns."""
    d = df.withColumn("_x", F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull()))
    d = d.withColumn(f"{prefix}_missing", F.lit(len(columns)) - F.size("_x"))
    return _array_stats(d, "_x", prefix).drop("_x")


def block_summary(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """Ten numbers for a block of columns that are filled together."""
    d = df.withColumn("_x", F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull()))
    d = _array_stats(d, "_x", prefix)
    equal = lambda v: F.size(F.filter("_x", lambda x: x == v))
    return d.withColumns({f"{prefix}_missing_rate": 1 - F.size("_x") / F.lit(float(len(columns))),
                          f"{prefix}_range": F.col(f"{prefix}_max") - F.col(f"{prefix}_min"),
                          f"{prefix}_nunique": F.size(F.array_distinct("_x")), f"{prefix}_zeros": equal(0.0),
                          f"{prefix}_ones": equal(1.0), f"{prefix}_twos": equal(2.0)}).drop("_x")


def missing_count(df: DataFrame, columns: list[str] | None = None, out: str = "row_missing") -> DataFrame:
    gone = [F.col(c).isNull() for c in columns or df.columns]
    if len(gone) <= 50:
        return df.withColumn(out, add([g.cast("int") for g in gone]))
    return df.withColumn(out, F.size(F.filter(F.array(*gone), lambda x: x)))


def presence_mask(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    bits = [F.shiftleft(F.col(c).isNotNull().cast("long"), i) for i, c in enumerate(columns)]
    return df.withColumn(out, add(bits))


def flag_summary(df: DataFrame, columns: list[str], prefix: str = "flags") -> DataFrame:
    """Counts of T, F and missing, and the pattern of all values."""
    count = lambda test: sum((F.coalesce(test(F.col(c)), F.lit(False)).cast("int") for c in columns), F.lit(0))
    return df.withColumns({f"{prefix}_true": count(lambda c: c == "T"), f"{prefix}_false": count(lambda c: c == "F"),
                           f"{prefix}_missing": count(lambda c: c.isNull()),
                           f"{prefix}_pattern": F.concat(*[token(c, "N") for c in columns])})


def drift_flag(df: DataFrame, a: str, b: str, limit: float, out: str) -> DataFrame:
    return df.withColumn(out, (F.abs(F.col(a) - F.col(b)) > limit).cast("int"))


# texts ------------------------------------------------------------------------------------------------------
def mail_match(df: DataFrame, p: str, r: str) -> DataFrame:
    suffix = lambda c: F.substring_index(token(c), ".", -1)
    return df.withColumns({"mail_match": (token(p) == token(r)).cast("int"),
                           "p_suffix": suffix(p), "r_suffix": suffix(r)})


def mail_state(df: DataFrame, p: str, r: str, out: str = "mail_state") -> DataFrame:
    a, b = F.col(p).isNull(), F.col(r).isNull()
    return df.withColumn(out, F.when(a & b, "both_missing").when(a | b, "one_missing")
                         .when(F.col(p) == F.col(r), "same").otherwise("different"))


def device_family(df: DataFrame, device: str, browser: str) -> DataFrame:
    return df.withColumns({"device_family": F.split(token(device), "/", 2)[0],
                           "browser_family": F.trim(F.regexp_replace(token(browser), r"[\d._-]+$", ""))})


def device_brand(df: DataFrame, device: str, out: str = "brand") -> DataFrame:
    low = F.lower(token(device))
    overrides = [F.when(low.rlike(p), name) for p, name in reversed(DEVICE_BRANDS)]
    return df.withColumn(out, F.coalesce(*overrides, F.split(low, "[/ ]", 2)[0]))


def device_flags(df: DataFrame, device: str) -> DataFrame:
    low = F.lower(token(device))
    return df.withColumns({"is_mobile": low.rlike(MOBILE_DEVICE).cast("int"),
                           "has_build": low.contains("build").cast("int")})


def software(df: DataFrame, os: str, browser: str) -> DataFrame:
    """Family and major version of operating system and browser."""
    out = {}
    for name, c in (("os", os), ("browser", browser)):
        low = F.lower(token(c))
        out[f"{name}_name"] = F.trim(F.regexp_replace(low, r"[\d._-]+.*$", ""))
        out[f"{name}_major"] = F.regexp_extract(low, r"(\d+)", 1).try_cast("double")
    low = F.lower(token(browser))
    return df.withColumns(out | {"browser_mobile": low.rlike(MOBILE_BROWSER).cast("int"),
                                 "browser_generic": low.contains("generic").cast("int")})


def screen_size(df: DataFrame, screen: str) -> DataFrame:
    low = F.lower(token(screen))
    side = lambda i: F.regexp_extract(low, r"^(\d+)x(\d+)$", i).try_cast("double")
    d = df.withColumns({"width": side(1), "height": side(2)})
    known = F.col("width").isNotNull() & F.col("height").isNotNull()
    return d.withColumns({"pixels": F.col("width") * F.col("height"), "aspect": divide(F.col("width"), F.col("height")),
                          "known": known.cast("int"),
                          "portrait": F.coalesce(known & (F.col("width") < F.col("height")), F.lit(False)).cast("int")})


def trailing_number(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn(out, F.regexp_extract(token(text), r"(-?\d+)$", 1).try_cast("double"))

