"""GRF-*: graph normalisation and summary.

A graph is two DataFrames keyed by ``(project, version)``:
``nodes(project, version, id, ..., ord)`` and
``edges(project, version, source, target, type, ord)``.  ``ord`` is the
document position; it decides "last wins" and tie orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

G = ["project", "version"]


def simple_edges(edges: DataFrame) -> DataFrame:
    """GRF-01: collapse parallel edges; the last type in document order wins.

    One aggregation keyed by ``(project, version, source, target)`` with a
    map-side partial aggregate, so duplicates are merged before the shuffle.
    """
    return (edges.groupBy(*G, "source", "target")
            .agg(F.max_by("type", "ord").alias("type"), F.min("ord").alias("ord")))


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """Declared nodes with duplicate ids: last attributes win, first position kept."""
    attrs = [c for c in nodes.columns if c not in (*G, "id", "ord")]
    if not attrs:
        return nodes.groupBy(*G, "id").agg(F.min("ord").alias("ord"))
    last = F.max_by(F.struct(*attrs), "ord").alias("_a")
    return (nodes.groupBy(*G, "id").agg(last, F.min("ord").alias("ord"))
            .select(*G, "id", "_a.*", "ord"))


def endpoint_positions(edges: DataFrame) -> DataFrame:
    """Every edge endpoint with the position where it first appears (source before target)."""
    ends = edges.select(*G, F.explode(F.array(
        F.struct(F.col("source").alias("id"), (F.col("ord") * 2).alias("pos")),
        F.struct(F.col("target").alias("id"), (F.col("ord") * 2 + 1).alias("pos")))).alias("e"))
    return ends.groupBy(*G, F.col("e.id").alias("id")).agg(F.min("e.pos").alias("ord"))


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-02: declared nodes plus attribute-less endpoints (``implicit = true``).

    Order of the node set = declared nodes by ``ord``, then implicit ones by
    first appearance in the edge list.  A node that is declared more than once
    counts once.
    """
    declared = dedupe_nodes(nodes)
    implicit = (endpoint_positions(edges)
                .join(declared.select(*G, "id"), [*G, "id"], "left_anti")
                .withColumn("implicit", F.lit(True)))
    return (declared.withColumn("implicit", F.lit(False))
            .unionByName(implicit, allowMissingColumns=True))


def graph_stats(nodes: DataFrame, edges: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """GRF-03: node and edge count per graph after GRF-01/02 (+ system metrics if given)."""
    n = all_nodes(nodes, edges).groupBy(*G).agg(F.count(F.lit(1)).alias("node_count"))
    e = simple_edges(edges).groupBy(*G).agg(F.count(F.lit(1)).alias("edge_count"))
    out = n.join(e, G, "full").select(
        *G, F.coalesce("node_count", F.lit(0)).alias("node_count"),
        F.coalesce("edge_count", F.lit(0)).alias("edge_count"))
    if versions is not None:
        out = out.join(versions, G, "left")
    return out


def raw_edge_count(edges: DataFrame, nodes_dependencies: DataFrame | None = None) -> DataFrame:
    """GRF-04: edge count without collapsing.

    ``nodes_dependencies(project, version, dependencies ARRAY)`` is the legacy
    layout without top-level edges; its list lengths are summed when a graph
    has no edge rows.
    """
    e = edges.groupBy(*G).agg(F.count(F.lit(1)).alias("raw_edges"))
    if nodes_dependencies is None:
        return e
    d = nodes_dependencies.groupBy(*G).agg(
        F.sum(F.coalesce(F.size("dependencies"), F.lit(0))).alias("dep_edges"))
    return (e.join(d, G, "full")
            .select(*G, F.coalesce("raw_edges", "dep_edges", F.lit(0)).cast("bigint").alias("raw_edges")))


def version_key(version: Column) -> Column:
    """Sort key of a version name: runs of digits compare as numbers (1.9 before 1.10), the rest as text."""
    parts = F.regexp_extract_all(version, F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def part(p: Column) -> Column:
        number = F.when(p.rlike("^[0-9]"), F.regexp_replace(p, "^0+(?=[0-9])", ""))
        # text before numbers; a longer number is a larger one
        return F.struct(F.coalesce(F.length(number), F.lit(0)).alias("n"), F.coalesce(number, p).alias("t"))
    return F.transform(parts, part)


def transitions_from_versions(versions: DataFrame, order_col: str | None = None) -> DataFrame:
    """Adjacent version pairs per project (the version table is one row per graph).

    ``order_col`` names the release time or any other order; without it the
    version names are ordered by :func:`version_key`.
    """
    w = Window.partitionBy("project").orderBy(*([order_col] if order_col else [version_key(F.col("version")), "version"]))
    return (versions.select("project", F.col("version").alias("v_old"),
                            F.lead("version").over(w).alias("v_new"))
            .where(F.col("v_new").isNotNull()))


def tag_sides(df: DataFrame, transitions: DataFrame) -> DataFrame:
    """Attach every graph row to the transitions it takes part in.

    Output keeps the columns of ``df`` (without ``version``) plus
    ``v_old, v_new, side`` where side 1 = old version, 2 = new version.
    A version used by two transitions (v1->v2, v2->v3) appears twice.
    """
    t = transitions.select("project", "v_old", "v_new")
    old = (df.join(t.withColumnRenamed("v_old", "version"), ["project", "version"])
           .withColumnRenamed("version", "v_old").withColumn("side", F.lit(1)))
    new = (df.join(t.withColumnRenamed("v_new", "version"), ["project", "version"])
           .withColumnRenamed("version", "v_new").withColumn("side", F.lit(2)))
    return old.unionByName(new)


def previous_value(df: DataFrame, key: list[str], ts: str, tie: str, value: str, bucket: Column,
                   out: str = "previous") -> DataFrame:
    """``lag(value)`` over ``key`` ordered by ``(ts, tie)``, without sorting a whole key in one task.

    Rows are windowed per ``(key, bucket)`` (e.g. the day of ``ts``); the
    first row of a bucket takes the last value of the key's previous
    non-empty bucket, found on a per-bucket summary (one row per key and
    bucket, partially aggregated).  Exact for any bucket function that is
    monotone in ``ts``.
    """
    b = df.withColumn("_b", bucket)
    w = Window.partitionBy(*key, "_b").orderBy(ts, tie)
    inner = b.withColumn(out, F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = b.groupBy(*key, "_b").agg(F.max_by(value, F.struct(ts, tie)).alias("_last"))
    wb = Window.partitionBy(*key).orderBy("_b")
    prev_bucket = last.select(*key, "_b", F.lag("_last").over(wb).alias("_carry"))
    return (inner.join(prev_bucket, [*key, "_b"], "left")
            .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col(out)))
            .drop("_b", "_first", "_carry"))
