"""The two feature views of a card-transaction table, from the operators: 712 and 1046 columns.

`build` takes transactions joined to identities, history and query rows together in one frame with a `split` column.
Every family is a table of its own, keyed by the row id and written once; a view joins the families it needs.
The families look at history and query rows alike, except the frequencies, which are counted on history.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F, types as T

from .. import config as cf
from ..functions import rowwise as rw, tokens as tk
from ..operators import causal, distribution as di, encode as en, entity, frequency as fq, graph as gr
from ..sources.store import save

ID, DT, AMT, LABEL = "TransactionID", "TransactionDT", "TransactionAmt", "isFraud"


def numbered(df: DataFrame, pattern: str) -> list[str]:
    return en.columns_like(df.columns, pattern)


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def _new(df: DataFrame, before: DataFrame, drop: tuple = ()) -> list[str]:
    return [c for c in df.columns if c not in before.columns and c not in drop]


def _table(df: DataFrame, columns: list[str]) -> DataFrame:
    return save(df.select(ID, *columns))


def base(raw: DataFrame) -> DataFrame:
    """Raw columns, per-row features, keys, two entity sequences, history frequencies."""
    d = _renamed(rw.clock(raw, DT), {"day": "DT_day", "week": "DT_week", "hour": "DT_hour", "dayofweek": "DT_dayofweek"})
    d = _renamed(rw.amount_shape(d, AMT), {n: f"{AMT}_{n}" for n in ("log1p", "cents", "is_integer", "is_round_10")})
    d = _renamed(rw.mail_match(d, "P_emaildomain", "R_emaildomain"),
                 {"mail_match": "P_R_email_match", "p_suffix": "P_email_suffix", "r_suffix": "R_email_suffix"})
    d = _renamed(rw.device_family(d, "DeviceInfo", "id_31"), {"device_family": "DeviceInfo_family"})
    d = d.withColumns({n: tk.compose(*parts) for n, parts in cf.COARSE_KEYS.items()})
    days = numbered(raw, r"D\d+")
    d = rw.minus_day(d, DT, days)
    whole = {f.name: f.dataType for f in raw.schema}
    ids = [c for c in numbered(raw, r"id_\d+") if isinstance(whole[c], T.NumericType)]
    for name, cols in (("C", numbered(raw, r"C\d+")), ("D", days), ("V", numbered(raw, r"V\d+")), ("id_numeric", ids)):
        d = _renamed(rw.row_stats(d, cols, name), {f"{name}_missing": f"{name}_missing_count"})
    d = save(d)
    d = rw.missing_count(d, [c for c in d.columns if c != "split"], "row_missing_count")
    origin = tk.origin_day(DT, "D1", "floor_day")
    token = tk.integer_token(origin)
    d = d.withColumns({"D1_origin_day": origin, "uid_d1_email": tk.compose(token, "P_emaildomain"),
                       "uid_card_addr_d1": tk.compose("card1", "addr1", token),
                       "uid_card_addr_d1_email": tk.compose("card1", "addr1", token, "P_emaildomain")})
    d = save(d)
    parts = ["count", "order", "order_from_end", "previous_dt", "next_dt", "mean_dt", "std_dt", "median_dt", "time_span", "mean_amt",
             "std_amt", "median_amt", "previous_amt", "next_amt", "amt_to_mean", "amt_zscore"]
    out = d
    for uid in ("uid_d1_email", "uid_card_addr_d1_email"):
        p = f"{uid}_seq"
        seq = entity.sequence(d.select(ID, DT, AMT, uid), [uid], DT, ID, AMT, p)
        out = out.join(_table(seq, [f"{p}_{n}" for n in parts]), ID)
    columns = list(cf.FREQUENCY_COLUMNS)
    freq = fq.frequency(d.select(ID, *columns), d.filter("split = 'history'"), columns)
    return save(out.join(_table(freq, [f"{c}_freq" for c in columns]), ID))


def profile(d: DataFrame) -> DataFrame:
    """Components of the first graph and the profile of each component."""
    g = d.withColumn("origin", F.rint("D1_origin_day"))
    keys = [(list(k), cap) for k, cap in cf.GRAPH_KEYS]
    comp = gr.entity_components(g, ID, keys, cf.COMPONENT_CAP)
    cols = list(dict.fromkeys([ID, DT, AMT, "component", *cf.PROFILE_IDS, *cf.PROFILE_NUMBERS]))
    narrow = save(comp.withColumn("user_valid_link_key_count", gr.key_support([k for k, _ in keys])).select(
        *cols, "user_valid_link_key_count"))
    p = entity.profile(narrow, ["component"], DT, ID, AMT, list(cf.PROFILE_IDS), list(cf.PROFILE_NUMBERS), list(cf.PROFILE_RANGES))
    new = _new(p, narrow, ("user_has_previous", "user_has_next"))
    return _table(p, ["user_valid_link_key_count", *new])


def advanced(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Behaviour so far in the components of the second graph; also (row, component)."""
    g = d.withColumns({"origin": F.rint("D1_origin_day"), "clean_email": tk.clean_mail("P_emaildomain")})
    extra = gr.fuzzy_edges(g, ID, ["card1", "addr1"], DT, "D3", "origin", "ProductCD", "clean_email", "C13")
    comp = gr.entity_components(g, ID, [(list(k), cap) for k, cap in cf.GRAPH2_KEYS], cf.COMPONENT_CAP, extra)
    comp = gr.derived_uids(comp, "component", ["card1", "addr1"], "origin", "clean_email", "ProductCD")
    uids = ["uid_component", "uid_clean_mail", "uid_product"]
    narrow = save(comp.select(*dict.fromkeys([ID, DT, "split", "component", *uids, "D3", *numbered(d, "C13"), *cf.MEMORY_COLUMNS])))
    a = causal.activity(narrow, ["component"], DT, ID, "C13", "D3", "adv_user")
    a = a.withColumn("adv_user_is_singleton", (F.col("adv_user_total_count") == 1).cast("int"))
    for c in cf.MEMORY_COLUMNS:
        a = causal.value_memory(a, ["component"], DT, ID, c, f"adv_user_{c}")
    a = save(a)
    f = fq.frequency(a.select(ID, *uids), a.filter("split = 'history'"), uids)
    a = a.join(_table(f, [f"{u}_freq" for u in uids]), ID)
    return _table(a, [*uids, *_new(a, narrow)]), narrow.select(ID, "component")


def blocks(d: DataFrame, component: DataFrame) -> DataFrame:
    """Row summaries of the V blocks, wide statistics and missing rates per component."""
    cd = [*numbered(d, r"C\d+"), *numbered(d, r"D\d+")]
    rows, rates = d, []
    for a, b in cf.V_BLOCKS:
        cols = [f"V{i}" for i in range(a, b + 1)]
        rows = rw.block_summary(rows, cols, f"vblock_{a}_{b}")
        rates.append(f"vblock_{a}_{b}_missing_rate")
    summary = _new(rows, d)
    rows = save(rows.select(ID, *cd, *cf.TOP_V, *summary).join(component, ID))
    wide = entity.wide_profile(rows, ["component"], cd, list(cf.TOP_V), "wide_user")
    part = _table(wide, _new(wide, rows))
    miss = entity.rate_profile(rows, ["component"], rates, "wide_user")
    return save(rows.select(ID, *summary).join(part, ID).join(_table(miss, _new(miss, rows)), ID))


def calendar(d: DataFrame) -> DataFrame:
    """Calendar parts, amount digits, origins, counter shapes, amount statistics of six keys."""
    days, counters = numbered(d, r"D\d+"), numbered(d, r"C\d+")
    raw = d.select(*dict.fromkeys([ID, DT, AMT, *days, *counters, "D1_origin_day", "card1", "addr1", "ProductCD", "card5", "card4"]))
    c = rw.cycles(rw.calendar(raw, DT, "2017-12-01"), DT)
    c = _renamed(c, {n: f"calendar_{n}" for n in _new(c, raw)})
    before = c
    c = rw.multiple_distance(rw.amount_digits(c, AMT), AMT, (1, 5, 10, 25, 500))
    c = _renamed(c, {n: f"amount_{n}" for n in _new(c, before)})
    c = rw.counter_shape(rw.origin_spread(rw.origins(c, DT, days), DT, days), counters, list(cf.COUNTER_RATIOS))
    out = _table(c, _new(c, raw))
    keyed = save(raw.withColumn("D1_origin_day", F.rint("D1_origin_day")))
    for name, key in cf.AMOUNT_KEYS.items():
        g = entity.amount_groups(keyed.select(*dict.fromkeys([ID, AMT, *key])), list(key), AMT, f"amount_group_{name}")
        out = out.join(_table(g, [c for c in g.columns if c.startswith(f"amount_group_{name}")]), ID)
    return save(out)


def identity(d: DataFrame) -> DataFrame:
    """Device, software, screen, flags and presence masks."""
    i = rw.device_flags(rw.device_brand(d, "DeviceInfo"), "DeviceInfo")
    i = rw.trailing_number(rw.screen_size(rw.software(i, "id_30", "id_31"), "id_33"), "id_34", "match_status")
    i = rw.flag_summary(i, numbered(d, r"M\d+"), "M")
    ids = numbered(d, r"id_\d+")
    i = rw.presence_mask(rw.presence_mask(i, ids[:19], "present_mask_0"), ids[19:], "present_mask_1")
    i = rw.presence_mask(rw.missing_count(i, ids, "_gone"), numbered(d, r"D\d+"), "D_present_mask")
    i = i.withColumn("present_count", F.lit(len(ids)) - F.col("_gone")).drop("_gone")
    i = rw.mail_state(i, "P_emaildomain", "R_emaildomain", "email_state")
    new = _new(i, d)
    return _table(_renamed(i, {n: f"identity_{n}" for n in new}), [f"identity_{n}" for n in new])


def behavior(d: DataFrame, component: DataFrame) -> DataFrame:
    """Value distributions in the component and in the strict entity, co-occurrence of column pairs."""
    cols = list(dict.fromkeys([*cf.BEHAVIOR_COLUMNS, *(c for pair in cf.PAIRS for c in pair), "uid_card_addr_d1_email"]))
    rows = save(d.select(ID, *cols).join(component, ID))
    out = rows.select(ID)
    for name, key in (("component", "component"), ("strict_uid", "uid_card_addr_d1_email")):
        v = di.value_distributions(rows, [([key], c, f"behavior_{name}_{c}") for c in cf.BEHAVIOR_COLUMNS])
        out = out.join(_table(v, _new(v, rows)), ID)
    c = di.cooccurrences(rows, [(a, b, f"cooc_{a}_{b}") for a, b in cf.PAIRS])
    return save(out.join(_table(c, _new(c, rows)), ID))


def amount_patterns(d: DataFrame) -> DataFrame:
    a = rw.multiple_distance(d.select(ID, AMT), AMT, (50, 100, 200), 0.011)
    return _table(_renamed(a, {c: f"{AMT}_{c}" for c in a.columns if c.startswith("mod_")}), [
        f"{AMT}_{c}" for c in a.columns if c.startswith("mod_")])


def build(raw: DataFrame) -> tuple[dict[str, DataFrame], dict[str, list[str]]]:
    """Family tables and the column lists of the views `vblock` and `structured`."""
    b = base(raw)
    adv, component = advanced(b)
    families = {"base": b, "profile": profile(b), "advanced": adv, "block": blocks(b, component), "calendar": calendar(b),
                "identity": identity(b), "behavior": behavior(b, component), "amount": amount_patterns(b)}
    names = {f: [c for c in t.columns if c not in (ID, LABEL, "split")] for f, t in families.items()}
    hidden = {*cf.COARSE_KEYS, *cf.ORIGIN_KEYS}
    dynamics = [c for c in names["base"] if not re.fullmatch(r"V\d+|id_\d+", c) and c not in hidden]
    vblock = en.union_columns(dynamics, names["profile"], names["advanced"], names["block"], names["amount"])
    views = {"vblock": vblock, "structured": en.union_columns(vblock, names["calendar"], names["identity"], names["behavior"])}
    return families, views


def view(families: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Join the families that hold the wanted columns; the others are not read."""
    wanted, out = set(columns), None
    for t in families.values():
        mine = [c for c in t.columns if c in wanted]
        if mine:
            part = t.select(ID, *mine)
            out = part if out is None else out.join(part, ID)
            wanted -= set(mine)
    return out.select(ID, *columns)
