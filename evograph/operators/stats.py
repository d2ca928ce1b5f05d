"""STA-*: cross-project statistics tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evograph.operators import cycles, diff, graph, metrics
from evograph.operators.graph import G, tag_sides
from evograph.session import cut_lineage

T = ["project", "v_old", "v_new"]

# Version-name prefixes removed for display, and the folder
# that is shown under a shorter name.
TAG_PREFIXES = ["javapoet-", "jsoup-", "gson-parent-", "open-source-java-design-patterns-"]
GRAPH_SUFFIX = "_graph.json"
FOLDER_ALIASES = {"reactive-streams/reactive-streams-jvm": "reactive-streams"}


def project_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """STA-01: classes, raw edges, LOC and average coupling (3 dp) per graph, sorted."""
    sm = metrics.system_metrics(nodes)
    ec = graph.raw_edge_count(edges)
    return (sm.join(ec, G, "left")
            .select(*G, F.col("total_classes").alias("classes"),
                    F.coalesce("raw_edges", F.lit(0)).alias("edges"), F.col("total_loc").alias("loc"),
                    F.round("avg_coupling", 3).alias("avg_coupling"))
            .orderBy(*G))


def _per_version(nodes: DataFrame, edges: DataFrame, transitions: DataFrame, max_len: int,
                 listed: DataFrame) -> DataFrame:
    sm = metrics.system_metrics(nodes)
    pc = edges.select(*G, "source", "target").distinct().groupBy(*G).agg(F.count(F.lit(1)).alias("n_edges"))
    cc = cycles.cycle_counts(edges, edges, max_len, listed).select(*G, "n_cycles")
    per = sm.join(pc, G, "left").join(cc, G, "left")
    tagged = tag_sides(per, transitions)

    def side(c, s):
        return F.max(F.when(F.col("side") == s, F.col(c)))

    return tagged.groupBy(*T).agg(
        side("total_classes", 1).alias("classes_v1"), side("total_classes", 2).alias("classes_v2"),
        side("total_loc", 1).alias("loc_v1"), side("total_loc", 2).alias("loc_v2"),
        side("n_edges", 1).alias("edges_v1"), side("n_edges", 2).alias("edges_v2"),
        side("n_cycles", 1).alias("cycles_v1"), side("n_cycles", 2).alias("cycles_v2"))


def evolution_comparison(nodes: DataFrame, edges: DataFrame, transitions: DataFrame,
                         max_len: int = 5) -> DataFrame:
    """STA-02: sizes and cycle counts of both versions, diff counts, status rule (a).

    Cycle counts are complete up to ``max_len`` (the unbounded listing of the
    original script is replaced by an explicit bound), which the rows state in
    ``length_bound``; ``has_new_cycle`` sees cycles of any length."""
    from evograph.operators.intents import benchmark_status
    listed = cut_lineage(cycles.enumerate_cycles(edges, max_len), "listed")  # feeds counts and changes
    per = _per_version(nodes, edges, transitions, max_len, listed)
    ds = diff.diff_summary(nodes, edges, transitions, cycles.cycle_changes(edges, transitions, max_len, listed))
    out = per.join(cycles.with_exact_verdict(ds, nodes, edges), T).withColumn("length_bound", F.lit(max_len))
    return benchmark_status(out, "a")


def evolution_comparison_fast(nodes: DataFrame, edges: DataFrame, transitions: DataFrame,
                              max_len: int = 5) -> DataFrame:
    """STA-03: the same with new/broken cycles and status rule (b), which sees cycles of any length."""
    from evograph.operators.intents import benchmark_status
    listed = cut_lineage(cycles.enumerate_cycles(edges, max_len), "listed")
    per = _per_version(nodes, edges, transitions, max_len, listed).drop("cycles_v1", "cycles_v2")
    ds = diff.diff_summary(nodes, edges, transitions, cycles.cycle_changes(edges, transitions, max_len, listed))
    return benchmark_status(per.join(cycles.with_exact_verdict(ds, nodes, edges), T), "b")


def display_repo(folder: Column) -> Column:
    """STA-04: folder ``owner_repo`` -> ``owner/repo`` (with the fixed aliases)."""
    name = F.regexp_replace(folder, "_", "/")
    for k, v in FOLDER_ALIASES.items():
        name = F.when(name == k, F.lit(v)).otherwise(name)
    return name


def display_version(file_name: Column) -> Column:
    """STA-04: graph file name -> version label (suffix and known tag prefixes removed)."""
    v = F.replace(file_name, F.lit(GRAPH_SUFFIX), F.lit(""))
    for p in TAG_PREFIXES:
        v = F.replace(v, F.lit(p), F.lit(""))
    return v
