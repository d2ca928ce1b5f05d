"""DIF-*: structural differences between adjacent versions.

All operators take the graph tables plus ``transitions(project, v_old, v_new)``
and return rows keyed by ``(project, v_old, v_new)``.  Set differences are
computed as one aggregation over the union of both sides
(``bit_or(side)``: 1 = only old, 2 = only new, 3 = both) instead of a pair of
anti joins: one shuffle keyed by the element, with map-side partial
aggregation collapsing parallel edges before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evograph.operators.graph import G, all_nodes, tag_sides

T = ["project", "v_old", "v_new"]
ONLY_OLD, ONLY_NEW, BOTH = 1, 2, 3


def node_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node set of every graph: declared ids plus edge endpoints (may repeat)."""
    ends = edges.select(*G, F.explode(F.array("source", "target")).alias("id"))
    return nodes.select(*G, "id").unionByName(ends)


def node_membership(nodes: DataFrame, edges: DataFrame, transitions: DataFrame) -> DataFrame:
    return (tag_sides(node_ids(nodes, edges), transitions)
            .groupBy(*T, "id").agg(F.bit_or("side").alias("m")))


def edge_membership(edges: DataFrame, transitions: DataFrame) -> DataFrame:
    """Edges compared as (source, target) pairs; the type is ignored."""
    return (tag_sides(edges.select(*G, "source", "target"), transitions)
            .groupBy(*T, "source", "target").agg(F.bit_or("side").alias("m")))


def added_nodes(nodes, edges, transitions) -> DataFrame:
    """DIF-01."""
    return node_membership(nodes, edges, transitions).where(F.col("m") == ONLY_NEW).select(*T, "id")


def removed_nodes(nodes, edges, transitions) -> DataFrame:
    """DIF-02."""
    return node_membership(nodes, edges, transitions).where(F.col("m") == ONLY_OLD).select(*T, "id")


def added_edges(edges, transitions) -> DataFrame:
    """DIF-03."""
    return (edge_membership(edges, transitions).where(F.col("m") == ONLY_NEW)
            .select(*T, "source", "target"))


def removed_edges(edges, transitions) -> DataFrame:
    """DIF-04."""
    return (edge_membership(edges, transitions).where(F.col("m") == ONLY_OLD)
            .select(*T, "source", "target"))


def _count_changes(membership: DataFrame, what: str) -> DataFrame:
    return membership.groupBy(*T).agg(
        F.count_if(F.col("m") == ONLY_NEW).alias(f"added_{what}"),
        F.count_if(F.col("m") == ONLY_OLD).alias(f"removed_{what}"))


def diff_summary(nodes: DataFrame, edges: DataFrame, transitions: DataFrame,
                 cycle_changes: DataFrame | None = None) -> DataFrame:
    """DIF-05: six counts per transition (cycle counts when ``cycle_changes`` is given).

    ``cycle_changes`` is the output of :func:`evograph.operators.cycles.cycle_changes`.
    The per-transition results are tiny, so the final joins are cheap.
    """
    n = _count_changes(node_membership(nodes, edges, transitions), "nodes")
    e = _count_changes(edge_membership(edges, transitions), "edges")
    out = transitions.select(*T).join(n, T, "left").join(e, T, "left")
    cols = ["added_nodes", "removed_nodes", "added_edges", "removed_edges"]
    if cycle_changes is not None:
        c = cycle_changes.groupBy(*T).agg(
            F.count_if(F.col("change") == "new").alias("new_cycles"),
            F.count_if(F.col("change") == "broken").alias("broken_cycles"))
        out = out.join(c, T, "left")
        cols += ["new_cycles", "broken_cycles"]
    return out.select(*T, *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in cols])


METRIC_COLUMNS = ["name", "type", "file_path", "loc", "complexity", "coupling", "inheritance_depth"]


def node_status(nodes: DataFrame, edges: DataFrame, transitions: DataFrame) -> DataFrame:
    """DIF-06: ADDED / REMOVED / UNCHANGED / MODIFIED (any declared attribute differs).

    Implicit endpoints carry no attributes; a node that turns from implicit
    to declared (or back) counts as MODIFIED.
    """
    allv = all_nodes(nodes, edges)
    attrs = [c for c in METRIC_COLUMNS if c in allv.columns]
    rec = F.struct(*attrs, "implicit")
    tagged = tag_sides(allv.select(*G, "id", rec.alias("a")), transitions)
    agg = tagged.groupBy(*T, "id").agg(
        F.bit_or("side").alias("m"),
        F.max(F.when(F.col("side") == 1, F.col("a"))).alias("a_old"),
        F.max(F.when(F.col("side") == 2, F.col("a"))).alias("a_new"))
    status = (F.when(F.col("m") == ONLY_NEW, "ADDED")
               .when(F.col("m") == ONLY_OLD, "REMOVED")
               .when(F.col("a_old").eqNullSafe(F.col("a_new")), "UNCHANGED")
               .otherwise("MODIFIED"))
    cur = F.coalesce("a_new", "a_old")
    return agg.select(*T, "id", status.alias("status"),
                      *[cur[c].alias(c) for c in attrs if c in ("type", "loc", "complexity", "coupling")])


def edge_flags(edges: DataFrame, transitions: DataFrame, new_cycle_edges: DataFrame) -> DataFrame:
    """DIF-07: per collapsed v2 edge, ``is_added`` and ``is_cycle`` (on a new cycle).

    ``new_cycle_edges(project, v_old, v_new, source, target)`` comes from
    :func:`evograph.operators.cycles.cycle_edge_rows` over new cycles.
    """
    mem = edge_membership(edges, transitions).where(F.col("m") != ONLY_OLD)
    on_cycle = new_cycle_edges.select(*T, "source", "target").distinct().withColumn("is_cycle", F.lit(True))
    return (mem.join(on_cycle, [*T, "source", "target"], "left")
            .select(*T, "source", "target", (F.col("m") == ONLY_NEW).alias("is_added"),
                    F.coalesce("is_cycle", F.lit(False)).alias("is_cycle")))


def size_change(versions: DataFrame, transitions: DataFrame) -> DataFrame:
    """DIF-08: LOC and class count of both versions and their change."""
    tagged = tag_sides(versions.select(*G, "total_loc", "total_classes"), transitions)
    both = tagged.groupBy(*T).agg(
        F.max(F.when(F.col("side") == 1, F.col("total_loc"))).alias("loc_v1"),
        F.max(F.when(F.col("side") == 2, F.col("total_loc"))).alias("loc_v2"),
        F.max(F.when(F.col("side") == 1, F.col("total_classes"))).alias("classes_v1"),
        F.max(F.when(F.col("side") == 2, F.col("total_classes"))).alias("classes_v2"))
    return both.select(*T, "loc_v1", "loc_v2", (F.col("loc_v2") - F.col("loc_v1")).alias("loc_change"),
                       "classes_v1", "classes_v2",
                       (F.col("classes_v2") - F.col("classes_v1")).alias("class_change"))
