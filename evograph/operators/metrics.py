"""MET-*: degrees, centrality, coupling, hubs, anomalies, system and fan metrics.

Per-graph statistics (node count, mean, population deviation) are computed
with a ``groupBy`` (partial aggregation, one row per graph) and joined back,
never with a window partitioned by graph: a single graph may hold a third of
all nodes and must not land in one task.  Top-k per graph uses
``row_number() <= k``, which Spark plans as a partial ``WindowGroupLimit`` so
only k rows per graph and input partition cross the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evograph.operators.graph import G, all_nodes, simple_edges


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """MET-01: in/out degree on collapsed edges for every node (isolated nodes get 0).

    Output: all GRF-02 node columns plus ``in_deg, out_deg, degree``; a
    self-loop adds one to each, two to the total.
    """
    pairs = edges.select(*G, "source", "target").distinct()
    ends = pairs.select(*G, F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    deg = ends.groupBy(*G, F.col("e.id").alias("id")).agg(
        F.sum("e.i").cast("bigint").alias("in_deg"), F.sum("e.o").cast("bigint").alias("out_deg"))
    return (all_nodes(nodes, edges).join(deg, [*G, "id"], "left")
            .withColumn("in_deg", F.coalesce("in_deg", F.lit(0)).cast("bigint"))
            .withColumn("out_deg", F.coalesce("out_deg", F.lit(0)).cast("bigint"))
            .withColumn("degree", F.col("in_deg") + F.col("out_deg")))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """MET-02: degree / (n - 1) per node; 1.0 for graphs with at most one node."""
    d = degrees(nodes, edges)
    n = d.groupBy(*G).agg(F.count(F.lit(1)).alias("n_nodes"))
    return d.join(n, G).withColumn(
        "centrality",
        F.when(F.col("n_nodes") <= 1, F.lit(1.0))
         .otherwise(F.col("degree") * (F.lit(1.0) / (F.col("n_nodes") - 1))))


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """MET-03: declared coupling, or in+out degree when absent (a stored 0 stays 0)."""
    d = degrees(nodes, edges)
    declared = F.col("coupling") if "coupling" in d.columns else F.lit(None)
    return d.withColumn("coupling_value", F.coalesce(declared, F.col("degree")).cast("bigint"))


def top_hubs(nodes: DataFrame, edges: DataFrame, k: int = 3, centrality: DataFrame | None = None) -> DataFrame:
    """MET-04: the k most central nodes per graph; ties keep node order.

    ``centrality`` may pass a precomputed :func:`degree_centrality` table."""
    c = centrality if centrality is not None else degree_centrality(nodes, edges)
    w = Window.partitionBy(*G).orderBy(F.desc("degree"), "implicit", "ord")
    return (c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(*G, "rank", "id", "centrality", "degree"))


def coupling_anomalies(nodes: DataFrame, edges: DataFrame, degree_table: DataFrame | None = None) -> DataFrame:
    """MET-05: nodes whose coupling exceeds max(3, mean + 2 sigma) (population sigma).

    ``z_score = round((c - mean) / max(0.1, sigma), 2)``; ``implicit, ord`` keep
    the node order used for listing.  ``degree_table`` may pass a
    precomputed :func:`degrees` table.
    """
    d = degree_table if degree_table is not None else degrees(nodes, edges)
    declared = F.col("coupling") if "coupling" in d.columns else F.lit(None)
    c = d.withColumn("coupling_value", F.coalesce(declared, F.col("degree")).cast("bigint"))
    st = c.groupBy(*G).agg(F.avg("coupling_value").alias("mean"),
                           F.stddev_pop("coupling_value").alias("std"))
    thr = F.greatest(F.lit(3.0), F.col("mean") + 2 * F.col("std"))
    return (c.join(st, G)
            .where(F.col("coupling_value") > thr)
            .select(*G, "id", F.col("coupling_value").alias("coupling"),
                    F.round((F.col("coupling_value") - F.col("mean"))
                            / F.greatest(F.lit(0.1), F.col("std")), 2).alias("z_score"),
                    ((F.col("coupling_value") - F.col("mean"))
                     / F.greatest(F.lit(0.1), F.col("std"))).alias("z_raw"),
                    "mean", "std", thr.alias("threshold"), "implicit", "ord"))


def system_metrics(nodes: DataFrame) -> DataFrame:
    """MET-06: total LOC, class count and average coupling of declared nodes."""
    return nodes.groupBy(*G).agg(
        F.sum("loc").cast("bigint").alias("total_loc"),
        F.count(F.lit(1)).alias("total_classes"),
        (F.coalesce(F.sum("coupling"), F.lit(0)) / F.greatest(F.lit(1), F.count(F.lit(1))))
        .alias("avg_coupling"))


def fan_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """MET-07: fanIn / fanOut / coupling over typed, uncollapsed edges (declared nodes)."""
    ends = edges.select(*G, F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    fan = ends.groupBy(*G, F.col("e.id").alias("id")).agg(
        F.sum("e.i").cast("bigint").alias("fan_in"), F.sum("e.o").cast("bigint").alias("fan_out"))
    base = nodes.drop(*[c for c in ("fan_in", "fan_out") if c in nodes.columns])
    return (base.join(fan, [*G, "id"], "left")
            .withColumn("fan_in", F.coalesce("fan_in", F.lit(0)).cast("bigint"))
            .withColumn("fan_out", F.coalesce("fan_out", F.lit(0)).cast("bigint"))
            .withColumn("fan_coupling", F.col("fan_in") + F.col("fan_out")))


def _latest_report_entries(findings: DataFrame) -> DataFrame:
    """A later report entry with the same basename replaces the earlier one."""
    if "report_file" not in findings.columns:
        return findings
    keys = _finding_keys(findings)
    last = findings.groupBy(*keys).agg(F.max("report_file").alias("report_file"))
    return findings.join(last, [*keys, "report_file"], "left_semi")


def _finding_keys(findings: DataFrame) -> list[str]:
    """A basename names a file of one graph when the findings say which."""
    return [*[c for c in G if c in findings.columns], "basename"]


def merge_static_analysis(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """MET-08: attach static-analysis findings to nodes by file basename.

    ``findings([project, version,] basename, rule, ruleset, priority, begin_line, message[, report_file])``;
    findings that name their project and version stay with that graph.
    Findings are counted per basename first (partial aggregation), then one
    equi-join adds ``violation_count`` to every node whose file has that
    basename; a file holding two classes counts for both.  The per-node list
    itself is :func:`node_violations` (long form, no nested collection).
    """
    keys = _finding_keys(findings)
    per_file = (_latest_report_entries(findings).groupBy(*keys)
                .agg(F.count(F.lit(1)).alias("violation_count")))
    base = nodes.withColumn("basename", F.element_at(F.split(F.col("file_path"), "/"), -1))
    return (base.join(per_file, keys, "left")
            .withColumn("violation_count", F.coalesce("violation_count", F.lit(0)).cast("bigint"))
            .drop("basename"))


def node_violations(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """MET-08 (list form): one row per (node, finding)."""
    base = nodes.select(*G, "id", F.element_at(F.split(F.col("file_path"), "/"), -1).alias("basename"))
    return base.join(_latest_report_entries(findings), _finding_keys(findings))


def total_violations(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """System total = sum over nodes of their counts."""
    return (merge_static_analysis(nodes, findings).groupBy(*G)
            .agg(F.sum("violation_count").cast("bigint").alias("total_violations")))


def over_limit(nodes: DataFrame, metric: str, limit: int) -> DataFrame:
    """MET-09: declared nodes whose metric (missing = 0) exceeds ``limit``."""
    return nodes.where(F.coalesce(F.col(metric), F.lit(0)) > limit)


def kpis(versions: DataFrame, transitions: DataFrame, cycle_changes: DataFrame) -> DataFrame:
    """MET-10: LOC, classes, average coupling (2 dp) of the new version and its new-cycle count."""
    v = versions.select(F.col("project"), F.col("version").alias("v_new"),
                        "total_loc", "total_classes", F.round("avg_coupling", 2).alias("avg_coupling"))
    nc = (cycle_changes.where(F.col("change") == "new")
          .groupBy("project", "v_old", "v_new").agg(F.count(F.lit(1)).alias("new_cycles")))
    return (transitions.select("project", "v_old", "v_new").join(v, ["project", "v_new"], "left")
            .join(nc, ["project", "v_old", "v_new"], "left")
            .withColumn("new_cycles", F.coalesce("new_cycles", F.lit(0)).cast("bigint")))
