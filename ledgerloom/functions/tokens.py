"""Key tokens: text forms of key parts, origin days, composite keys, mail clean-up."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..config import DAY, GENERIC_MAIL, MISSING


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token(c: str | Column, missing: str = MISSING) -> Column:
    """Text of a value; every missing value is the same token, so missing keys pool. Cast whole floats first."""
    return F.coalesce(col(c).cast("string"), F.lit(missing))


def integer_token(c: str | Column, missing: str = MISSING) -> Column:
    """Text of a number rounded half to even."""
    return token(F.rint(col(c)).cast("long"), missing)


def compose(*parts: str | Column, sep: str = "|") -> Column:
    return F.concat_ws(sep, *[token(p) for p in parts])


def day_of(dt: str | Column) -> Column:
    return F.floor(col(dt) / F.lit(float(DAY)))


def origin_day(dt: str | Column, back: str | Column, how: str) -> Column:
    """First day of an entity. `floor_day`: day minus back; `round`/`floor`: of the exact difference."""
    if how == "floor_day":
        return day_of(dt) - col(back)
    exact = col(dt) / F.lit(float(DAY)) - col(back)
    return {"round": F.rint, "floor": lambda x: F.floor(x).cast("double")}[how](exact)


def clean_mail(c: str | Column, generic: tuple = GENERIC_MAIL) -> Column:
    """Lower case; domains shared by everybody become missing."""
    low = F.lower(col(c))
    return F.when(~low.isin(*[g.lower() for g in generic], *generic), low)


def all_present(*parts: str | Column) -> Column:
    return reduce(lambda a, b: a & b, (col(p).isNotNull() for p in parts))


def seeded(seed: int, row_id: str) -> Column:
    """A number below 16 ** 15 that looks random, the same in every run and in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(row_id)).cast("binary")), 1, 15), 16, 10).cast("bigint")
