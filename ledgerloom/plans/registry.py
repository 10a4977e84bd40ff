"""Registry that binds operators to the test tables, each with the SQL that must give the same rows.

`spec` names the output columns once for both sides: `name:i` integer, `name:f` float, `name:s` string. Floats
are rounded to six decimals (a little off the middle, where means of round amounts tend to lie) and to 32 bits
on both sides, because sums taken in another order differ in the last bits.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.timeline import rows_per_slice
from . import roles


@dataclass(frozen=True)
class Binding:
    name: str
    spec: str
    build: Callable[[roles.Tables], DataFrame]
    sql: str | None


BINDINGS: dict[str, Binding] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.rsplit(":", 1)) for part in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        c = F.col(f"`{name}`")
        if kind == "i":
            c = c.cast("bigint")
        elif kind == "f":
            c = (F.round(c.cast("double") + F.lit(1.3e-7), 6).cast("float").cast("double") + F.lit(0.0))
        else:
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def shape_sql(sql: str, spec: str) -> str:
    out = []
    for name, kind in _columns(spec):
        q = f'"{name}"'
        if kind == "i":
            e = f"CAST({q} AS BIGINT)"
        elif kind == "f":
            e = f"CAST(CAST(round(CAST({q} AS DOUBLE) + CAST(1.3e-7 AS DOUBLE), 6) AS FLOAT) AS DOUBLE) + CAST(0 AS DOUBLE)"
        else:
            e = f"CAST({q} AS VARCHAR)"
        out.append(f"{e} AS {q}")
    return f"SELECT {', '.join(out)} FROM ({sql}) AS answer"


def query(name: str, spec: str, sql: str | None = None):
    def register(build):
        assert name not in BINDINGS, name
        BINDINGS[name] = Binding(name, spec, build, None if sql is None else roles.expand(sql))
        return build
    return register


def runner(binding: Binding) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # let AQE split a skewed side even where that adds an exchange
        spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        return shape(binding.build(roles.Tables(spark, sf_dir)), binding.spec)
    return run


#: queries that also run with keys forced to be cut, against the same SQL: the plan that large tables get
SLICED = ("W1_", "W5_", "W9_", "W11_", "W13_velocity", "A6_", "A7_", "A13_", "A18_", "R1_", "R2_", "R3_", "R4_", "R6_", "B3_",
          "G5_", "G7_", "J9_", "V5_pair_features")


def add_sliced(rows: int = 16) -> None:
    def cut(build):
        def run(t):
            with rows_per_slice(rows):
                return build(t)
        return run
    for name, b in list(BINDINGS.items()):
        if name.startswith(SLICED):
            BINDINGS[f"{name}_sliced"] = Binding(f"{name}_sliced", b.spec, cut(b.build), b.sql)
