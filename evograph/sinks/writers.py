"""SNK-*: writers and export tables.

Documents (``.graph`` text, graph JSON, reports) are written as ordered
lines: every line carries a sort key, the rows are range-partitioned on
``(graph, key)`` and written with ``partitionBy`` and ``maxRecordsPerFile``.
Concatenating the part files of one graph folder in name order gives the
document, and no graph is ever collected into one row or one task.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

G = ["project", "version"]
T = ["project", "v_old", "v_new"]
MAX_LINES_PER_FILE = 1_000_000

# Layout of the ``.graph`` text format and its type defaults.
GRAPH_SECTION_NODES = "# Nodes: classes and modules"
GRAPH_SECTION_EDGES = "# Edges: dependencies (calls, inheritance, imports)"
DEFAULT_NODE_TYPE = "class"
DEFAULT_EDGE_TYPE = "calls"


def _write_lines(lines: DataFrame, keys: list[str], path: str, n_parts: int | None = None,
                 max_lines: int = MAX_LINES_PER_FILE) -> None:
    """Write ``(keys..., sec, k, line)`` rows so each key folder reads back in order."""
    spark = lines.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (lines.repartitionByRange(n, *keys, "sec", "k")
     .sortWithinPartitions(*keys, "sec", "k")
     .select(*keys, F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy(*keys).option("maxRecordsPerFile", max_lines).text(path))


def graph_text_lines(nodes: DataFrame, edges: DataFrame, versions: DataFrame) -> DataFrame:
    """SNK-01 layout: header, node lines, edge lines; ``(project, version, sec, k, line)``."""
    v = versions.select(*G, *(["language"] if "language" in versions.columns else []))
    lang = F.col("language") if "language" in versions.columns else F.lit(None).cast("string")
    hdr = v.select(*G, F.explode(F.array(
        F.struct(F.lit(0).alias("k"), F.concat(F.lit("# Project: "), F.coalesce(F.col("project"), F.lit("None")))
                 .alias("line")),
        F.struct(F.lit(1).alias("k"), F.concat(F.lit("# Version: "), F.coalesce(F.col("version"), F.lit("None")))
                 .alias("line")),
        F.struct(F.lit(2).alias("k"), F.concat(F.lit("# Language: "), F.coalesce(lang, F.lit("None")))
                 .alias("line")),
        F.struct(F.lit(3).alias("k"), F.lit("").alias("line")),
        F.struct(F.lit(4).alias("k"), F.lit(GRAPH_SECTION_NODES).alias("line")))).alias("h"))
    hdr = hdr.select(*G, F.lit(0).alias("sec"), F.col("h.k").cast("bigint").alias("k"), "h.line")
    nl = nodes.select(*G, F.lit(1).alias("sec"), F.col("ord").cast("bigint").alias("k"),
                      F.concat(F.lit("node: "), F.col("id").cast("string"), F.lit(" ["),
                               F.coalesce("type", F.lit(DEFAULT_NODE_TYPE)), F.lit("]")).alias("line"))
    mid = v.select(*G, F.lit(2).alias("sec"), F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("k"), F.lit("").alias("line")),
        F.struct(F.lit(1).cast("bigint").alias("k"), F.lit(GRAPH_SECTION_EDGES).alias("line")))).alias("m")
    ).select(*G, "sec", "m.k", "m.line")
    el = edges.select(*G, F.lit(3).alias("sec"), F.col("ord").cast("bigint").alias("k"),
                      F.concat(F.lit("edge: "), F.col("source").cast("string"), F.lit(" -> "),
                               F.col("target").cast("string"), F.lit(" ["),
                               F.coalesce("type", F.lit(DEFAULT_EDGE_TYPE)), F.lit("]")).alias("line"))
    return hdr.unionByName(nl).unionByName(mid).unionByName(el)


def write_graph_text(nodes: DataFrame, edges: DataFrame, versions: DataFrame, path: str, **kw) -> None:
    """SNK-01: one ``.graph`` document per (project, version) folder."""
    _write_lines(graph_text_lines(nodes, edges, versions), G, path, **kw)


#: Namespace of the terms below; a parameter of the writers.
NAMESPACE = "https://example.org/architecture#"
# The terms of a graph document's context that are not in the namespace by their own name.
DOCUMENT_TERMS = {
    "projectName": "projectName",
    "version": "versionString",
    "language": "language",
    "extractedAt": "extractedAt",
    "extractionStart": "extractionStart",
    "extractionEnd": "extractionEnd",
    "systemMetrics": "systemMetrics",
    "nodes": "hasEntity",
    "edges": "hasDependency",
    "id": "@id",
    "type": "@type",
}
ENTITY_TERMS = {
    "class": "ClassEntity",
    "interface": "InterfaceEntity",
    "module": "ModuleEntity",
    "package": "ModuleEntity",
    "file": "ModuleEntity",
    "function": "FunctionEntity",
    "calls": "Dependency",
    "inherits": "Dependency",
    "inheritance": "Dependency",
    "imports": "Dependency",
    "implements": "Dependency",
    "aggregates": "Dependency",
    "depends_on": "Dependency",
}


def document_context(namespace: str = NAMESPACE) -> dict:
    """The context of a graph document with its terms in ``namespace``."""
    ends = {end: {"@id": namespace + end, "@type": "@id"} for end in ("source", "target")}
    return {"@vocab": namespace, **DOCUMENT_TERMS, **ends, **{t: namespace + e for t, e in ENTITY_TERMS.items()}}


def graph_json_lines(nodes: DataFrame, edges: DataFrame, versions: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """SNK-02 layout: a JSON document per graph, one node / edge object per line.

    The document is the one that :func:`evograph.sources.readers.read_graphs` takes: context,
    coordinates, system metrics, plain node and edge objects.  Every element also carries its
    position ``ord``, so a line can be parsed on its own
    (:func:`evograph.sources.readers.read_graph_parts`).  Separating commas lead each element line
    except the first of its array (found with a per-graph ``min``, one value per graph).
    """
    sm = [c for c in ("total_loc", "total_classes", "avg_coupling") if c in versions.columns]
    sys_metrics = F.struct(*[F.col(c).alias(n) for c, n in
                             zip(sm, ["totalLinesOfCode", "totalClasses", "averageCoupling"][:len(sm)])])
    optional = [(c, n) for c, n in [("language", "language"), ("extracted_at", "extractedAt")] if c in versions.columns]
    fields = F.to_json(F.struct(F.col("project").alias("projectName"), F.col("version").alias("version"),
                                *[F.col(c).alias(n) for c, n in optional], sys_metrics.alias("systemMetrics")))
    head = versions.select(*G, F.lit(0).alias("sec"), F.lit(0).cast("bigint").alias("k"), F.concat(
        F.lit('{"@context": ' + json.dumps(document_context(namespace)) + ", "), F.substring(fields, F.lit(2), F.length(fields) - 2),
        F.lit(', "nodes": [')).alias("line"))
    metric_cols = [(c, n) for c, n in [("loc", "loc"), ("complexity", "complexity"), ("fan_in", "fanIn"),
                                       ("fan_out", "fanOut"), ("coupling", "coupling"),
                                       ("inheritance_depth", "inheritanceDepth")] if c in nodes.columns]
    node_obj = F.to_json(F.struct(
        F.col("id").cast("string").alias("id"), F.col("name").alias("name"), F.col("type").alias("type"),
        F.col("file_path").alias("filePath"), F.struct(*[F.col(c).alias(n) for c, n in metric_cols]).alias("metrics"),
        F.col("ord").alias("ord")))
    first_n = nodes.groupBy(*G).agg(F.min("ord").alias("_first"))
    nl = nodes.join(first_n, G).select(
        *G, F.lit(1).alias("sec"), F.col("ord").cast("bigint").alias("k"),
        F.concat(F.when(F.col("ord") == F.col("_first"), F.lit("")).otherwise(F.lit(",")), node_obj).alias("line"))
    mid = versions.select(*G, F.lit(2).alias("sec"), F.lit(0).cast("bigint").alias("k"),
                          F.lit('], "edges": [').alias("line"))
    first_e = edges.groupBy(*G).agg(F.min("ord").alias("_first"))
    edge_obj = F.to_json(F.struct(F.col("source").cast("string").alias("source"),
                                  F.col("target").cast("string").alias("target"), F.col("type").alias("type"),
                                  F.col("ord").alias("ord")))
    el = edges.join(first_e, G).select(
        *G, F.lit(3).alias("sec"), F.col("ord").cast("bigint").alias("k"),
        F.concat(F.when(F.col("ord") == F.col("_first"), F.lit("")).otherwise(F.lit(",")), edge_obj).alias("line"))
    tail = versions.select(*G, F.lit(4).alias("sec"), F.lit(0).cast("bigint").alias("k"), F.lit("]}").alias("line"))
    return head.unionByName(nl).unionByName(mid).unionByName(el).unionByName(tail)


def write_graph_json(nodes: DataFrame, edges: DataFrame, versions: DataFrame, path: str, namespace: str = NAMESPACE, **kw) -> None:
    """SNK-02: graph documents (systemMetrics, nodes, edges), one folder per graph.

    Element ``ord`` values must be unique within a graph (positions).
    """
    _write_lines(graph_json_lines(nodes, edges, versions, namespace), G, path, **kw)


# The 33 exported queue columns, in export order.
EXPORT_COLUMNS = [
    "id", "owner", "repo", "stars", "tag1", "tag2", "status", "processed_at", "language",
    "extraction_start_at", "extraction_end_at", "loc_v1", "loc_v2", "classes_v1", "classes_v2",
    "coupling_v1", "coupling_v2", "conforms_v1", "conforms_v2", "added_nodes", "removed_nodes",
    "added_edges", "removed_edges", "new_cycles", "broken_cycles", "intent_status",
    "top_hubs", "coupling_anomalies", "report_content",
    "graph_v1_path", "graph_v2_path", "report_path", "error_msg",
]


def export_inventory(inventory: DataFrame, include_all: bool = False) -> DataFrame:
    """SNK-03: the export table (33 columns), crawled rows only unless ``include_all``,
    newest ``processed_at`` first."""
    from evograph.operators.inventory import align_schema
    q = align_schema(inventory)
    q = q.withColumn("id", F.col("repo_key") if "repo_key" in q.columns else F.lit(None).cast("bigint"))
    if not include_all:
        q = q.where(F.col("status") == "crawled")
    return q.select(*EXPORT_COLUMNS).orderBy(F.desc_nulls_last("processed_at"), "owner", "repo")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; fields quoted only when they hold a comma, quote or newline."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"') \
        .option("quoteAll", False).csv(path)


def export_graphs(inventory: DataFrame, graph_nodes: DataFrame, graph_edges: DataFrame, versions: DataFrame,
                  path: str, include_all: bool = False) -> DataFrame:
    """SNK-04: export both graphs of the selected queue rows as ``.graph`` documents.

    The queue names a graph by ``(graph_project, tag1)`` / ``(graph_project, tag2)``;
    graphs that do not exist are skipped (semi join).  Returns the exported keys.
    """
    q = inventory if include_all else inventory.where(F.col("status") == "crawled")
    want = (q.select(F.col("graph_project").alias("project"), F.explode(F.array("tag1", "tag2")).alias("version"))
            .distinct())
    present = want.join(versions.select(*G), G, "left_semi")
    n = graph_nodes.join(present, G, "left_semi")
    e = graph_edges.join(present, G, "left_semi")
    write_graph_text(n, e, versions.join(present, G, "left_semi"), path)
    return present


def ecosystem_summary(inventory: DataFrame, per_transition: DataFrame, cycles_per_version: DataFrame) -> DataFrame:
    """SNK-05: per repository status, language, versions, classes, LOC, coupling, cycles, verdict."""
    c = cycles_per_version.select(F.col("project").alias("graph_project"), F.col("version").alias("tag2"),
                                  F.col("n_cycles").alias("cycles_v2"))
    pt = per_transition.select(F.col("project").alias("graph_project"), F.col("v_old").alias("tag1"),
                               F.col("v_new").alias("tag2"), "classes_v2", "loc_v2", "coupling_v2",
                               "new_cycles", "intent_status")
    return (inventory.select("owner", "repo", "status", "language", "graph_project", "tag1", "tag2")
            .join(pt, ["graph_project", "tag1", "tag2"], "left")
            .join(c, ["graph_project", "tag2"], "left")
            .select("owner", "repo", "status", "language", "tag1", "tag2", "classes_v2", "loc_v2",
                    F.round("coupling_v2", 2).alias("coupling_v2"), "cycles_v2", "new_cycles",
                    F.when(F.col("intent_status").isNull(), F.lit(None))
                     .when(F.col("intent_status") == "VIOLATION", F.lit("NON-CONFORMANT"))
                     .otherwise(F.lit("CONFORMANT")).alias("conformance")))


def class_diff_table(nodes: DataFrame, transitions: DataFrame) -> DataFrame:
    """SNK-06: every node of the new version, ADDED or UNCHANGED, with its metrics."""
    newv = nodes.join(transitions.select("project", F.col("v_new").alias("version"), "v_old"), G)
    oldv = nodes.select("project", F.col("version").alias("v_old"), "id").withColumn("_old", F.lit(True))
    return (newv.join(oldv, ["project", "v_old", "id"], "left")
            .select("project", "v_old", F.col("version").alias("v_new"), "id",
                    F.when(F.col("_old").isNull(), "ADDED").otherwise("UNCHANGED").alias("status"),
                    "loc", "complexity", "coupling", "type"))


def write_reports(report_lines: DataFrame, path: str, **kw) -> None:
    """SNK-07: one text report per transition folder (``project=/v_old=/v_new=``),
    streamed line by line in report order."""
    lines = report_lines.select(*T, F.col("sec").cast("int").alias("sec"),
                                F.struct("sub", "k1", "k2").alias("k"), "line")
    spark = report_lines.sparkSession
    n = kw.get("n_parts") or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (lines.repartitionByRange(n, *T, "sec", "k").sortWithinPartitions(*T, "sec", "k")
     .select(*T, F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy(*T).option("maxRecordsPerFile", MAX_LINES_PER_FILE).text(path))


def report_file_name(v_old, v_new):
    """Report file name of a transition: ``{tag1}_to_{tag2}_analysis.txt``."""
    return F.concat(v_old, F.lit("_to_"), v_new, F.lit("_analysis.txt"))
