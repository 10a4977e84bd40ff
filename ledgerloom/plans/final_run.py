"""The last run of a recipe: query rows scored by ranked sources under weights by segment and horizon, pooled, checked and written."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import blend as bl, checks as ck, folds as fo, ranks as rk
from ..sources import tables as tb
from ..sources.store import save

DIGITS = 12        # scores are rounded to this many digits before they are ranked


def final_scores(query: DataFrame, history: DataFrame, dt: str, segment: str, sources: list[str],
                 weights: dict[float, dict[str, dict[str, float]]], pool: dict, out: str = "prediction") -> DataFrame:
    """`query` with `horizon` (days from the end of the history) and `out`, a rank in (0, 1].

    Sources become ranks over all query rows; `weights` (horizon -> segment -> source) are interpolated to each row's horizon; the mix is pulled
    to that of the row's entity (`pool`: key, method, weight, size, valid) and ranked again.
    """
    d = fo.horizon(query, history, dt)
    d = rk.rank_many(d, [(s, f"_rank_{s}", ()) for s in sources])
    ranked = {h: {g: {f"_rank_{s}": w[s] for s in sources} for g, w in per.items()} for h, per in weights.items()}
    d = bl.horizon_mix(d, segment, "horizon", ranked, "_mix").withColumn("_mix", F.round("_mix", DIGITS))
    d = bl.entity_pull(d, pool["key"], "_mix", pool["weight"], "_pulled", pool["valid"], pool["method"], pool["size"])
    d = save(d.withColumn("_pulled", F.round("_pulled", DIGITS)).drop("_mix", *[f"_rank_{s}" for s in sources]))
    return rk.average_rank(d, "_pulled", out).drop("_pulled")


def report(scores: DataFrame, segment: str, out: str = "prediction") -> DataFrame:
    """Rows, horizons and scores per segment."""
    return scores.groupBy(segment).agg(
        F.count(F.lit(1)).alias("rows"), F.min("horizon").alias("first_horizon"), F.max("horizon").alias("last_horizon"),
        F.min(out).alias("least"), F.max(out).alias("most"), F.avg(out).alias("mean"))


def write_final(scores: DataFrame, template: DataFrame, folder: str, row_id: str, segment: str, sources: list[str],
                out: str = "prediction") -> None:
    """Predictions (CSV), sources beside them (Parquet) and the report (JSON) under `folder`. Scores that do not fit `template`, one row each
    and none beside it, are an error, and nothing is written."""
    scores = save(scores)
    found = ck.output_contract(scores.select(row_id, out), template.select(row_id), row_id, out).first().asDict()
    wrong = {k: n for k, n in found.items() if k != "rows" and n}
    if wrong:
        raise ValueError(f"scores do not fit the template: {wrong}")
    scores.select(row_id, segment, "horizon", *sources, out).write.parquet(f"{folder}/sources")
    tb.write_predictions(scores, f"{folder}/predictions", row_id, out)
    tb.write_report(report(scores, segment, out), f"{folder}/report")
