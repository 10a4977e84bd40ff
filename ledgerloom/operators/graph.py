"""Entity graph: rows that share a key are one entity, within limits on group and component size.

Components are found by alternating star contractions (Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii:
"Connected Components in MapReduce and Beyond", 2014): O(log n) rounds, hubs are aggregated before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tokens import all_present, compose, integer_token
from ..sources.store import save
from .joins import attach
from .timeline import Timeline


def linked_groups(df: DataFrame, row_id: str, key: list[str], cap: int | None) -> DataFrame:
    """Valid groups of two rows or more with their first row. A `cap` is part of the entity's meaning: a key shared by more rows
    than that identifies nobody, and such groups are gone before any row is joined. None: no limit."""
    groups = (df.filter(all_present(*key)).groupBy(*key)
              .agg(F.min(row_id).alias("_hub"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2))
    return groups if cap is None else groups.filter(F.col("_n") <= cap)


def star_edges(df: DataFrame, row_id: str, key: list[str], cap: int | None) -> DataFrame:
    """Edges from the first row of each linked group to its other rows."""
    groups = linked_groups(df, row_id, key, cap)
    return (df.filter(all_present(*key)).select(row_id, *key).join(groups, list(key))
            .filter(F.col(row_id) != F.col("_hub"))
            .select(F.col("_hub").alias("a"), F.col(row_id).alias("b"),
                    F.xxhash64(*key).alias("_order")))


def key_statistics(df: DataFrame, row_id: str, key: list[str], cap: int | None, name: str) -> DataFrame:
    """Valid rows, linked groups, oversized groups and edges of one key."""
    sizes = df.filter(all_present(*key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    linked = F.col("n") >= 2 if cap is None else F.col("n").between(2, cap)
    return sizes.agg(F.lit(name).alias("key"), F.sum("n").alias("valid_rows"), F.count_if(linked).alias("linked_groups"),
                     F.count_if(F.lit(False) if cap is None else F.col("n") > cap).alias("oversized_groups"),
                     F.sum(F.when(linked, F.col("n") - 1).otherwise(0)).alias("edges"))


def key_support(keys: list[list[str]]) -> Column:
    return sum((all_present(*k).cast("int") for k in keys), F.lit(0))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge; a component is named by its smallest node."""
    e = save(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        e = save(small)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def capped_components(groups: DataFrame, cap: int) -> DataFrame:
    """(node, component) where no merge exceeds `cap` nodes: links are tried in the order (stage, order, hub).

    `groups` holds links (stage, order, hub, node). The rule is sequential, but a link only depends on the links
    before it that touch the same components. So each round settles every link that is the first pending one of
    all components it touches, which gives exactly the sequential outcome. A link group is bounded by its key's cap.
    """
    link = ["stage", "_order", "hub"]
    pending = save(groups.select(*link, "node").distinct())
    label = save(pending.select(F.explode(F.array("hub", "node")).alias("node")).distinct()
                 .select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size")))
    while True:
        # sizes only grow, so a link that no longer fits never will: it needs no turn
        hub = label.select(F.col("node").alias("hub"), F.col("component").alias("_hc"), F.col("size").alias("_hs"))
        pending = save(pending.join(hub, "hub").join(label, "node").filter(
            (F.col("component") != F.col("_hc")) & (F.col("size") + F.col("_hs") <= cap)).select(*link, "node"))
        if pending.isEmpty():
            return label.select("node", "component")
        ends = pending.select(*link, "node").unionByName(pending.select(*link, F.col("hub").alias("node")).distinct())
        touch = ends.join(label, "node")
        parts = touch.select(*link, "component").distinct()
        first = parts.groupBy("component").agg(F.min(F.struct(*link)).alias("_first"))
        ready = (parts.join(first, "component").groupBy(*link)
                 .agg(F.count_if(F.col("_first") != F.struct(*link)).alias("_wait")).filter("_wait = 0").drop("_wait"))
        members = (touch.join(ready, link).groupBy(*link).agg(F.sort_array(F.collect_list(
            F.struct((F.col("node") != F.col("hub")).alias("late"), "node", "component", "size"))).alias("_m")))
        start = lambda m: F.struct(m["size"].alias("size"), F.array(m["component"]).alias("taken"))
        grow = lambda acc, m: F.when(
            ~F.array_contains(acc["taken"], m["component"]) & (acc["size"] + m["size"] <= cap),
            F.struct((acc["size"] + m["size"]).alias("size"), F.array_append(acc["taken"], m["component"]).alias("taken"))
        ).otherwise(acc)
        merged = members.select(*link, F.aggregate("_m", start(F.col("_m")[0]), grow).alias("_r"))
        moves = merged.select(F.explode("_r.taken").alias("component"), F.array_min("_r.taken").alias("_new"),
                              F.col("_r.size").alias("_size"))
        done = save(merged.select(*link))
        label = save(label.join(moves, "component", "left").select(
            "node", F.coalesce("_new", "component").alias("component"), F.coalesce("_size", "size").alias("size")))
        pending = pending.join(done, link, "left_anti")


def entity_components(df: DataFrame, row_id: str, keys: list[tuple[list[str], int | None]], cap: int | None,
                      extra: DataFrame | None = None, out: str = "component") -> DataFrame:
    """Component of every row: rows linked by any key (or by `extra` edges a, b), at most `cap` rows each (None: no limit).

    A component that needs no cap comes out the same with or without it; only the others take the capped pass.
    """
    stages = [star_edges(df, row_id, list(k), limit).withColumn("stage", F.lit(i)) for i, (k, limit) in enumerate(keys)]
    edges = stages[0]
    for s in stages[1:]:
        edges = edges.unionByName(s)
    if extra is not None:
        edges = edges.unionByName(extra.select("a", "b", F.xxhash64("a", "b").alias("_order"))
                                  .withColumn("stage", F.lit(len(keys))))
    edges = save(edges)
    found = components(edges.select("a", "b"))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    over = sizes.filter(F.lit(False) if cap is None else F.col("_n") > cap)
    if cap is not None and not over.isEmpty():
        big = found.join(over.select("component"), "component", "left_semi")
        inside = edges.join(big.select(F.col("node").alias("a")), "a", "left_semi")
        split = capped_components(inside.select("stage", "_order", F.col("a").alias("hub"), F.col("b").alias("node")), cap)
        found = found.join(over.select("component"), "component", "left_anti").select("node", "component").unionByName(split)
    return attach(df, found.withColumnRenamed("node", row_id).withColumnRenamed("component", out), [row_id]).withColumn(
        out, F.coalesce(out, row_id))


def component_statistics(df: DataFrame, component: str) -> DataFrame:
    n = df.groupBy(component).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("components"), F.count_if(F.col("n") == 1).alias("singletons"),
                 F.count_if(F.col("n") > 1).alias("multirow"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("rows_in_multirow"),
                 F.max("n").alias("largest"))


def fuzzy_edges(df: DataFrame, row_id: str, key: list[str], dt: str, stated_gap: str, origin: str, product: str,
                mail: str, counter: str, max_rows: int | None = None) -> DataFrame:
    """Edges (a earlier, b later) between neighbours in time of the same key whose stated gap fits the real one."""
    tl = Timeline(df.select(row_id, *key, dt, stated_gap, origin, product, mail, counter), key, [dt, row_id], max_rows)
    d = tl.with_neighbours(1, 0)
    was = lambda c: F.lag(c).over(tl.window)
    d = d.withColumns({"_prev": was(row_id), "_gap": (F.col(dt) - was(dt)) / F.lit(86400.0),
                       "_shift": F.abs(F.col(origin) - was(origin)), "_step": F.col(counter) - was(counter),
                       "_mail": F.col(mail) == was(mail), "_product": F.col(product).eqNullSafe(was(product))})
    alike = F.col("_product") | F.coalesce("_mail", F.lit(False)) | F.coalesce(F.col("_step").between(-1, 10), F.lit(False))
    fits = (F.col("_prev").isNotNull() & F.col("_gap").between(0, 120)
            & (F.abs(F.col("_gap") - F.col(stated_gap)) <= 1.5) & (F.col("_shift") <= 35) & alike)
    return tl.settle(d).filter(fits).select(F.col("_prev").alias("a"), F.col(row_id).alias("b"))


def derived_uids(df: DataFrame, component: str, card: list[str], origin: str, mail: str, product: str) -> DataFrame:
    o = integer_token(origin)
    return df.withColumns({"uid_component": F.concat(F.lit("u"), F.col(component).cast("string")),
                           "uid_clean_mail": compose(*card, o, mail), "uid_product": compose(*card, o, product)})
