"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query reads the driver tables through :mod:`evograph.fixtures` (whole
tables, no sampling) and returns the operator's result with the same column
names as the matching oracle SQL in :mod:`evograph.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evograph import fixtures as fx
from evograph.operators import cycles, diff, graph, metrics
from evograph.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _graph(spark, sf):
    """The fixture graph, written once per query as Parquet (it feeds many branches)."""
    edges = materialize(fx.dep_edges(spark, sf), "dep-edges")
    nodes = materialize(fx.dep_nodes(spark, sf, edges), "dep-nodes")
    return nodes, edges


def _g(spark, sf):
    nodes, edges = _graph(spark, sf)
    # written, so that its size is known before it is joined with the edges
    return nodes, edges, materialize(fx.dep_transitions(spark, sf, edges), "dep-transitions")


def _r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# ------------------------------------------------------------------ GRF

@register("grf_simple_edges")
def q_simple_edges(spark, sf):
    return graph.simple_edges(fx.dep_edges(spark, sf))


@register("grf_all_nodes")
def q_all_nodes(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.all_nodes(nodes, edges).select(
        "project", "version", "id", "name", "type", "file_path", "loc", "complexity", "coupling",
        "inheritance_depth", "ord", "implicit")


@register("grf_graph_stats")
def q_graph_stats(spark, sf):
    nodes, edges = _graph(spark, sf)
    st = graph.graph_stats(nodes, edges, metrics.system_metrics(nodes))
    return st.select("project", "version", "node_count", "edge_count", "total_loc", "total_classes",
                     _r6("avg_coupling"))


@register("grf_raw_edge_count")
def q_raw_edge_count(spark, sf):
    return graph.raw_edge_count(fx.dep_edges(spark, sf))


# ------------------------------------------------------------------ DIF

@register("dif_added_nodes")
def q_added_nodes(spark, sf):
    return diff.added_nodes(*_g(spark, sf))


@register("dif_removed_nodes")
def q_removed_nodes(spark, sf):
    return diff.removed_nodes(*_g(spark, sf))


@register("dif_added_edges")
def q_added_edges(spark, sf):
    _, edges, tr = _g(spark, sf)
    return diff.added_edges(edges, tr)


@register("dif_removed_edges")
def q_removed_edges(spark, sf):
    _, edges, tr = _g(spark, sf)
    return diff.removed_edges(edges, tr)


@register("dif_diff_summary")
def q_diff_summary(spark, sf):
    nodes, edges, tr = _g(spark, sf)
    return diff.diff_summary(nodes, edges, tr, cycles.cycle_changes(edges, tr))


@register("dif_node_status")
def q_node_status(spark, sf):
    return diff.node_status(*_g(spark, sf))


@register("dif_edge_flags")
def q_edge_flags(spark, sf):
    _, edges, tr = _g(spark, sf)
    new = cycles.cycle_changes(edges, tr).where(F.col("change") == "new")
    return diff.edge_flags(edges, tr, cycles.cycle_edge_rows(new, ["project", "v_old", "v_new"]))


@register("dif_size_change")
def q_size_change(spark, sf):
    nodes, edges, tr = _g(spark, sf)
    return diff.size_change(metrics.system_metrics(nodes), tr)


# ------------------------------------------------------------------ CYC

@register("cyc_scc_labels")
def q_scc_labels(spark, sf):
    nodes, edges = _graph(spark, sf)
    return cycles.scc_labels(graph.all_nodes(nodes, edges), edges)


@register("cyc_simple_cycles")
def q_simple_cycles(spark, sf):
    return cycles.simple_cycles(fx.dep_edges(spark, sf), 5).select(
        "project", "version", "cycle_str", "length", "n_cycles", "length_bound")


@register("cyc_cycle_changes")
def q_cycle_changes(spark, sf):
    _, edges, tr = _g(spark, sf)
    return cycles.cycle_changes(edges, tr).drop("cycle")


@register("cyc_has_new_cycle")
def q_has_new_cycle(spark, sf):
    return cycles.has_new_cycle(*_g(spark, sf))


@register("cyc_updated_labels")
def q_updated_labels(spark, sf):
    nodes, edges, tr = _g(spark, sf)
    nodes = materialize(graph.all_nodes(nodes, edges).select("project", "version", "id"), "all-nodes")
    old = tr.select("project", F.col("v_old").alias("version")).distinct()
    g = ["project", "version"]
    labels = cycles.scc_labels(nodes.join(old, g, "left_semi"), edges.join(old, g, "left_semi"))
    return cycles.update_labels(labels, nodes, edges, tr)


@register("cyc_exact_counts")
def q_exact_counts(spark, sf):
    edges = materialize(fx.season_edges(spark, sf), "season-edges")
    return cycles.exact_cycle_counts(edges, edges)


@register("cyc_canonical_cycle")
def q_canonical_cycle(spark, sf):
    cyc = cycles.enumerate_cycles(fx.dep_edges(spark, sf), 5)
    k = (F.col("length") / 2).cast("int")
    rotated = F.concat(F.slice("cycle", k + 1, F.col("length") - k), F.slice("cycle", F.lit(1), k))
    return cyc.select("project", "version", cycles.cycle_string(F.col("cycle")).alias("cycle_str"),
                      cycles.cycle_string(rotated).alias("rotated_str"),
                      cycles.cycle_string(cycles.canonical_cycle(rotated)).alias("canonical_str"))


@register("cyc_cycle_edges")
def q_cycle_edges(spark, sf):
    cyc = cycles.enumerate_cycles(fx.dep_edges(spark, sf), 5)
    return cyc.select("project", "version", cycles.cycle_string(F.col("cycle")).alias("cycle_str"),
                      F.posexplode(cycles.cycle_edge_pairs(F.col("cycle"))).alias("pos", "e")
                      ).select("project", "version", "cycle_str", (F.col("pos") + 1).cast("bigint").alias("pos"),
                               "e.source", "e.target")


@register("cyc_cycle_counts")
def q_cycle_counts(spark, sf):
    edges = fx.dep_edges(spark, sf)
    return cycles.cycle_counts(edges, edges, 5)


# ------------------------------------------------------------------ MET

@register("met_degrees")
def q_degrees(spark, sf):
    return metrics.degrees(*_graph(spark, sf)).select(
        "project", "version", "id", "in_deg", "out_deg", "degree", "implicit")


@register("met_degree_centrality")
def q_centrality(spark, sf):
    return metrics.degree_centrality(*_graph(spark, sf)).select(
        "project", "version", "id", "n_nodes", _r6("centrality"))


@register("met_coupling")
def q_coupling(spark, sf):
    return metrics.coupling(*_graph(spark, sf)).select("project", "version", "id", "coupling_value")


@register("met_top_hubs")
def q_top_hubs(spark, sf):
    return metrics.top_hubs(*_graph(spark, sf), k=3).select(
        "project", "version", "rank", "id", _r6("centrality"), "degree")


@register("met_coupling_anomalies")
def q_anomalies(spark, sf):
    return metrics.coupling_anomalies(*_graph(spark, sf)).select(
        "project", "version", "id", "coupling", "z_score", _r6("mean"), _r6("std"), _r6("threshold"))


@register("met_system_metrics")
def q_system_metrics(spark, sf):
    nodes, _ = _graph(spark, sf)
    return metrics.system_metrics(nodes).select("project", "version", "total_loc", "total_classes",
                                                _r6("avg_coupling"))


@register("met_fan_metrics")
def q_fan_metrics(spark, sf):
    return metrics.fan_metrics(*_graph(spark, sf)).select(
        "project", "version", "id", "fan_in", "fan_out", "fan_coupling")


@register("met_merge_static_analysis")
def q_merge_static(spark, sf):
    nodes, _ = _graph(spark, sf)
    return metrics.merge_static_analysis(nodes, fx.violations(spark, sf)).select(
        "project", "version", "id", "violation_count")


@register("met_over_limit")
def q_over_limit(spark, sf):
    nodes, _ = _graph(spark, sf)
    a = metrics.over_limit(nodes, "coupling", 7).select(
        "project", "version", "id", F.lit("coupling").alias("metric"),
        F.coalesce("coupling", F.lit(0)).alias("value"))
    b = metrics.over_limit(nodes, "inheritance_depth", 3).select(
        "project", "version", "id", F.lit("inheritance_depth").alias("metric"),
        F.coalesce("inheritance_depth", F.lit(0)).alias("value"))
    return a.unionByName(b)


@register("met_kpis")
def q_kpis(spark, sf):
    nodes, edges, tr = _g(spark, sf)
    return metrics.kpis(metrics.system_metrics(nodes), tr, cycles.cycle_changes(edges, tr)).select(
        "project", "v_old", "v_new", "total_loc", "total_classes", "avg_coupling", "new_cycles")


# ------------------------------------------------------------------ INT

from evograph.operators import intents as it  # noqa: E402
from evograph.plans import evolution  # noqa: E402

INTENTS = fx.FIXTURE_INTENTS


def _judged(spark, sf, resolve=True):
    nodes, edges, tr = _g(spark, sf)
    s = diff.diff_summary(nodes, edges, tr, cycles.cycle_changes(edges, tr))
    s = cycles.with_exact_verdict(s, nodes, edges)
    return it.intent_status(it.intent_violations(s, INTENTS, resolve=resolve))


def _judged_cols(df):
    return df.select(*diff.T, F.size("violations").cast("bigint").alias("n_violations"),
                     F.array_join("violations", " | ").alias("violations"),
                     F.size("conflicts").cast("bigint").alias("n_conflicts"), "intent_status")


@register("int_intent_violations")
def q_intent_violations(spark, sf):
    return _judged_cols(_judged(spark, sf, resolve=False))


@register("int_limit_violations")
def q_limit_violations(spark, sf):
    nodes, edges, tr = _g(spark, sf)
    return it.limit_violations(nodes, tr, INTENTS)


@register("int_resolve_conflicts")
def q_resolve_conflicts(spark, sf):
    return _judged_cols(_judged(spark, sf, resolve=True))


@register("int_report_lines")
def q_report_lines(spark, sf):
    nodes, edges, tr = _g(spark, sf)
    p = evolution.evolution_parts(nodes, edges, tr, INTENTS)
    return it.report_lines(p["judged"], p["hubs"], p["anomalies"])


@register("int_intent_status")
def q_intent_status(spark, sf):
    nodes, edges, tr = _g(spark, sf)
    j = _judged(spark, sf)
    lim = it.limit_violations(nodes, tr, INTENTS)
    return it.dashboard_status(j, lim, INTENTS).select(*diff.T, "intent_status", "conformance")


@register("int_benchmark_status")
def q_benchmark_status(spark, sf):
    from evograph.operators import stats
    nodes, edges, tr = _g(spark, sf)
    cmp_ = stats.evolution_comparison(nodes, edges, tr)
    a = it.benchmark_status(cmp_, "a").withColumnRenamed("status", "status_a")
    b = it.benchmark_status(a, "b").withColumnRenamed("status", "status_b")
    return b.select(*diff.T, "status_a", "status_b")


@register("int_analysis_prompt")
def q_analysis_prompt(spark, sf):
    nodes, edges, tr = _g(spark, sf)
    return it.analysis_prompt(nodes, edges, tr, INTENTS)


@register("int_report_from_payload")
def q_report_from_payload(spark, sf):
    nodes, edges, tr = _g(spark, sf)
    s = diff.diff_summary(nodes, edges, tr, cycles.cycle_changes(edges, tr))
    s = cycles.with_exact_verdict(s, nodes, edges)
    payload = s.select("project", F.to_json(F.struct(F.struct(
        F.col("v_old").alias("version_old"), F.col("v_new").alias("version_new"),
        F.col("added_nodes").alias("addedNodes"), F.col("removed_nodes").alias("removedNodes"),
        F.col("added_edges").alias("addedEdges"), F.col("removed_edges").alias("removedEdges"),
        F.col("new_cycles").alias("newCycles"), F.col("broken_cycles").alias("brokenCycles"),
        F.col("has_new_cycle").alias("hasNewCycle"))
        .alias("diff"))).alias("payload"))
    ps = it.payload_summary(payload)
    j = it.intent_status(it.intent_violations(ps, intents_col="intents"))
    return _judged_cols(j)


@register("int_language_terms")
def q_language_terms(spark, sf):
    inv = fx.inventory(spark, sf).select("owner", "repo", "language")
    return it.language_terms(inv)


@register("int_evolution_analysis")
def q_evolution(spark, sf):
    nodes, edges, tr = _g(spark, sf)
    return evolution.evolution_analysis(nodes, edges, tr, INTENTS)


@register("int_evolution_reuse")
def q_evolution_reuse(spark, sf):
    """A first run analyses two projects and stores the result; the second takes it from there by content."""
    nodes, edges, tr = _g(spark, sf)
    tr = materialize(tr, "reuse-all")
    prints = materialize(evolution.graph_fingerprints(nodes, edges), "fingerprints")
    early = tr.where(F.col("project").isin("1-URGENT", "5-LOW"))
    _, stored = evolution.analyse_changed(nodes, edges, early, prints)
    out, _ = evolution.analyse_changed(nodes, edges, tr, prints, materialize(stored, "stored"))
    return out


@register("int_evolution_analysis_for")
def q_evolution_for(spark, sf):
    nodes, edges, tr = _g(spark, sf)
    return evolution.evolution_analysis_for(nodes, edges, tr, "3-MEDIUM", intents=INTENTS).drop("report")


# ------------------------------------------------------------------ VAL

from evograph.operators import quality  # noqa: E402


@register("val_class_metric_violations")
def q_val_class(spark, sf):
    nodes, _ = _graph(spark, sf)
    return quality.class_metric_violations(nodes)


@register("val_edge_endpoint_violations")
def q_val_edges(spark, sf):
    return quality.edge_endpoint_violations(*_graph(spark, sf)).select(
        "project", "version", "source", "target", "type", "property")


@register("val_entity_types")
def q_val_entity_types(spark, sf):
    nodes, _ = _graph(spark, sf)
    return quality.entity_types(nodes).select("project", "version", "id", "type", "entity_class",
                                              "is_software_entity")


@register("val_inferred_entities")
def q_val_inferred(spark, sf):
    nodes, edges = _graph(spark, sf)
    return quality.inferred_entities(graph.all_nodes(nodes, edges)).select(
        "project", "version", "id", "is_entity")


@register("val_conformance_flags")
def q_val_conformance(spark, sf):
    nodes, edges = _graph(spark, sf)
    return quality.conformance_flags(nodes, edges, edges)


@register("val_schema_violations")
def q_val_schema(spark, sf):
    nodes, edges = _graph(spark, sf)
    versions = metrics.system_metrics(nodes).withColumn("language", F.lit("Java"))
    return (quality.schema_violations(versions, nodes, edges)
            .groupBy("project", "version", "scope", "rule").agg(F.count(F.lit(1)).alias("n")))


@register("val_license_audit")
def q_val_license(spark, sf):
    return quality.license_audit(fx.files(spark, sf))


@register("val_license_missing")
def q_val_license_missing(spark, sf):
    return quality.license_missing(fx.files(spark, sf))


@register("val_unique_key_check")
def q_val_unique(spark, sf):
    return quality.unique_key_check(fx.discovered(spark, sf))


# ------------------------------------------------------------------ INV

from evograph.operators import inventory as inv  # noqa: E402

NOW = fx.NOW


def _batch(spark, sf):
    return inv.assign_workers(inv.next_batch(fx.inventory(spark, sf), 50, NOW), 4)


def _claims(spark, sf):
    b = _batch(spark, sf)
    return b.select("owner", "repo", F.concat(F.lit("worker-"), F.col("worker_no").cast("string")).alias("worker_id"))


@register("inv_upsert_discovered")
def q_upsert(spark, sf):
    return inv.upsert_discovered(fx.inventory(spark, sf), fx.discovered(spark, sf)).select(
        "owner", "repo", "stars", "language", "status")


@register("inv_star_ranges")
def q_star_ranges(spark, sf):
    return inv.assign_range(fx.discovered(spark, sf), 0).select(
        "owner", "repo", "seq", "stars", "range_idx", "low", "high")


@register("inv_next_batch")
def q_next_batch(spark, sf):
    return inv.next_batch(fx.inventory(spark, sf), 50, NOW).select("owner", "repo", "stars", "status")


@register("inv_assign_workers")
def q_assign_workers(spark, sf):
    return _batch(spark, sf).select("owner", "repo", "worker_no")


@register("inv_apply_claims")
def q_apply_claims(spark, sf):
    new, _ = inv.apply_claims(fx.inventory(spark, sf), _claims(spark, sf), NOW)
    return new.select("owner", "repo", "status", "claimed_at", "worker_id")


@register("inv_claim_history")
def q_claim_history(spark, sf):
    _, hist = inv.apply_claims(fx.inventory(spark, sf), _claims(spark, sf), NOW)
    return hist


@register("inv_apply_status")
def q_apply_status(spark, sf):
    new, _ = inv.apply_status(fx.inventory(spark, sf), fx.status_updates(spark, sf))
    return new.select("owner", "repo", "status", "error_msg", "processed_at")


@register("inv_status_history")
def q_status_history(spark, sf):
    _, hist = inv.apply_status(fx.inventory(spark, sf), fx.status_updates(spark, sf))
    return hist


@register("inv_apply_heartbeats")
def q_heartbeats(spark, sf):
    return inv.apply_heartbeats(fx.inventory(spark, sf), fx.heartbeats(spark, sf)).select(
        "owner", "repo", "status", "claimed_at")


@register("inv_requeue_stale")
def q_requeue(spark, sf):
    new, _ = inv.requeue_stale(fx.inventory(spark, sf), NOW)
    return new.select("owner", "repo", "status", "worker_id", "claimed_at")


@register("inv_stale_history")
def q_requeue_hist(spark, sf):
    _, hist = inv.requeue_stale(fx.inventory(spark, sf), NOW)
    return hist


@register("inv_current_status")
def q_current_status(spark, sf):
    return inv.current_status(fx.status_events(spark, sf))


@register("inv_align_schema")
def q_align_schema(spark, sf):
    legacy = fx.inventory(spark, sf).select("owner", "repo", "stars", "status")
    return inv.align_schema(legacy)


@register("inv_status_counts")
def q_status_counts(spark, sf):
    return inv.status_counts(fx.inventory(spark, sf))


@register("inv_recent_transitions")
def q_recent(spark, sf):
    return inv.recent_transitions(fx.status_events(spark, sf), fx.inventory(spark, sf), 10)


@register("inv_missing_metrics")
def q_missing(spark, sf):
    return inv.missing_metrics(fx.inventory(spark, sf)).select("owner", "repo")


def per_transition_metrics(nodes, edges, tr, intents=INTENTS, listed=None):
    """Derived queue columns for every transition (INV-14 input)."""
    p = evolution.evolution_parts(nodes, edges, tr, intents, listed=listed)
    sm = metrics.system_metrics(nodes)
    conf = quality.conformance_flags(nodes, edges, edges).select("project", "version", "conforms")
    per = sm.join(conf, ["project", "version"], "left")
    tagged = graph.tag_sides(per, tr)

    def side(c, s):
        return F.max(F.when(F.col("side") == s, F.col(c)))

    sizes = tagged.groupBy(*diff.T).agg(
        side("total_loc", 1).alias("loc_v1"), side("total_loc", 2).alias("loc_v2"),
        side("total_classes", 1).alias("classes_v1"), side("total_classes", 2).alias("classes_v2"),
        side("avg_coupling", 1).alias("coupling_v1"), side("avg_coupling", 2).alias("coupling_v2"),
        side("conforms", 1).alias("conforms_v1"), side("conforms", 2).alias("conforms_v2"))
    strings = inv.hub_and_anomaly_strings(p["hubs"], p["anomalies"], tr)
    return (p["judged"].drop("violations", "conflicts").join(sizes, diff.T).join(strings, diff.T))


@register("inv_backfill_metrics")
def q_backfill(spark, sf):
    nodes, edges, tr = _g(spark, sf)
    queue = inv.align_schema(fx.inventory(spark, sf))
    out = inv.backfill_metrics(queue, per_transition_metrics(nodes, edges, tr))
    return out.select("owner", "repo", "status", "loc_v1", "loc_v2", "classes_v1", "classes_v2",
                      _r6("coupling_v1"), _r6("coupling_v2"), "conforms_v1", "conforms_v2", "added_nodes",
                      "removed_nodes", "added_edges", "removed_edges", "new_cycles", "broken_cycles",
                      "intent_status", "top_hubs", "coupling_anomalies")


@register("inv_hub_and_anomaly_strings")
def q_hub_strings(spark, sf):
    nodes, edges, tr = _g(spark, sf)
    p = evolution.evolution_parts(nodes, edges, tr, INTENTS)
    return inv.hub_and_anomaly_strings(p["hubs"], p["anomalies"], tr)


@register("inv_extraction_duration")
def q_duration(spark, sf):
    return inv.extraction_duration(fx.inventory(spark, sf)).select("owner", "repo", "extraction_seconds")


# ------------------------------------------------------------------ STA

from evograph.operators import stats  # noqa: E402


@register("sta_project_summary")
def q_sta_summary(spark, sf):
    return stats.project_summary(*_graph(spark, sf))


@register("sta_evolution_comparison")
def q_sta_cmp(spark, sf):
    return stats.evolution_comparison(*_g(spark, sf)).select(
        *diff.T, "classes_v1", "classes_v2", "loc_v1", "loc_v2", "edges_v1", "edges_v2", "cycles_v1",
        "cycles_v2", "added_nodes", "removed_nodes", "added_edges", "removed_edges", "status")


@register("sta_evolution_comparison_fast")
def q_sta_cmp_fast(spark, sf):
    return stats.evolution_comparison_fast(*_g(spark, sf)).select(
        *diff.T, "loc_v1", "loc_v2", "classes_v1", "classes_v2", "edges_v1", "edges_v2", "added_nodes",
        "removed_nodes", "added_edges", "removed_edges", "new_cycles", "broken_cycles", "status")


@register("sta_display_names")
def q_sta_names(spark, sf):
    q = fx.inventory(spark, sf)
    folder = F.concat(F.col("language"), F.lit("_"), F.col("owner"))
    prefixes = F.array(*[F.lit(p) for p in stats.TAG_PREFIXES])
    fname = F.concat(F.element_at(prefixes, (F.col("repo_key") % 4 + 1).cast("int")), F.col("repo"),
                     F.lit(stats.GRAPH_SUFFIX))
    return q.select("owner", "repo", stats.display_repo(folder).alias("repo_name"),
                    stats.display_version(fname).alias("version_name"))


# ------------------------------------------------------------------ SRC / SNK

from evograph.session import scratch_path  # noqa: E402
from evograph.sinks import writers  # noqa: E402
from evograph.sources import readers  # noqa: E402


def _versions(nodes):
    return metrics.system_metrics(nodes).withColumn("language", F.lit("Java"))


def _written_graph_text(spark, sf):
    nodes, edges = _graph(spark, sf)
    path = scratch_path(spark, "graph-text")
    writers.write_graph_text(nodes, edges, _versions(nodes), path)
    return readers.read_graph_text(spark, path)


@register("snk_graph_text")
def q_snk_graph_text(spark, sf):
    g = _written_graph_text(spark, sf)
    return g["nodes"].select("project", "version", "id", "type")


@register("src_graph_text")
def q_src_graph_text(spark, sf):
    g = _written_graph_text(spark, sf)
    return g["edges"].select("project", "version", "source", "target", "type")


def _written_graph_json(spark, sf):
    nodes, edges = _graph(spark, sf)
    path = scratch_path(spark, "graph-json")
    writers.write_graph_json(nodes, graph.simple_edges(edges), _versions(nodes), path)
    return readers.read_graph_parts(spark, path)


@register("snk_graph_json")
def q_snk_graph_json(spark, sf):
    g = _written_graph_json(spark, sf)
    return g["nodes"].select("project", "version", "ord", "id", "name", "type", "file_path", "loc", "complexity",
                             "coupling", "inheritance_depth")


@register("src_graph_json")
def q_src_graph_json(spark, sf):
    g = _written_graph_json(spark, sf)
    return g["edges"].select("project", "version", "ord", "source", "target", "type")


def _document_rows(v, n, e):
    """Versions, nodes and edges of graph documents as one table."""
    none = {"t": F.lit(None).cast("string"), "n": F.lit(None).cast("bigint")}
    return (v.select(F.lit("versions").alias("kind"), "project", "version", none["n"].alias("ord"), F.col("language").alias("a"),
                     none["t"].alias("b"), none["t"].alias("type"), F.col("total_loc").alias("n1"), F.col("total_classes").alias("n2"))
            .unionByName(n.select(F.lit("nodes").alias("kind"), "project", "version", "ord", F.col("id").alias("a"),
                                  F.col("name").alias("b"), "type", F.col("loc").alias("n1"), F.col("complexity").alias("n2")))
            .unionByName(e.select(F.lit("edges").alias("kind"), "project", "version", "ord", F.col("source").alias("a"),
                                  F.col("target").alias("b"), "type", none["n"].alias("n1"), none["n"].alias("n2"))))


@register("src_graph_documents")
def q_src_documents(spark, sf):
    path = scratch_path(spark, "graph-documents")
    fx.graph_documents(spark, sf).drop("key").write.json(path)
    t = readers.read_graphs(spark, path, multi_line=False)
    return _document_rows(t["versions"], t["nodes"], t["edges"])


@register("src_search_pages")
def q_src_search(spark, sf):
    d = fx.discovered(spark, sf)
    pages = (d.groupBy(F.floor(F.col("seq") / 100).alias("page"))
             .agg(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws("/", "owner", "repo").alias("full_name"),
                                                       F.col("stars").alias("stargazers_count")))).alias("it"))
             .select(F.transform("it", lambda x: F.struct(x["full_name"].alias("full_name"),
                                                          x["stargazers_count"].alias("stargazers_count")))
                     .alias("items")))
    path = scratch_path(spark, "search-pages")
    pages.write.mode("overwrite").json(path)
    return readers.read_search_pages(spark, path).select("owner", "repo", "stars", "language")


def _tags(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").cast("string").alias("owner"), F.col("o_orderkey").cast("string").alias("repo"),
        F.concat(F.lit("v"), F.col("l_linenumber").cast("string"), F.lit("."), F.col("l_partkey").cast("string"))
        .alias("name"), F.col("l_shipdate").alias("created_at"))


@register("src_adjacent_versions")
def q_src_adjacent(spark, sf):
    return readers.adjacent_versions(_tags(spark, sf))


@register("src_read_inventory")
def q_src_inventory(spark, sf):
    path = scratch_path(spark, "inventory")
    fx.inventory(spark, sf).write.mode("overwrite").parquet(path)
    return readers.read_inventory(spark, path, status="crawled").select(
        "owner", "repo", "stars", "language", "status", "processed_at", "loc_v1", "error_msg")


@register("snk_export_inventory")
def q_snk_export(spark, sf):
    return writers.export_inventory(fx.inventory(spark, sf))


@register("snk_export_graphs")
def q_snk_export_graphs(spark, sf):
    nodes, edges = _graph(spark, sf)
    return writers.export_graphs(fx.inventory(spark, sf), nodes, edges, _versions(nodes),
                                 scratch_path(spark, "export-graphs"))


@register("snk_ecosystem_summary")
def q_snk_ecosystem(spark, sf):
    nodes, edges, tr = _g(spark, sf)
    listed = materialize(cycles.enumerate_cycles(edges, 5), "listed")  # feeds the changes and the counts
    pt = per_transition_metrics(nodes, edges, tr, listed=listed)
    cc = cycles.cycle_counts(edges, edges, 5, listed)
    return writers.ecosystem_summary(fx.inventory(spark, sf), pt, cc)


@register("snk_class_diff_table")
def q_snk_class_diff(spark, sf):
    nodes, edges, tr = _g(spark, sf)
    return writers.class_diff_table(nodes, tr)


@register("snk_write_reports")
def q_snk_reports(spark, sf):
    nodes, edges, tr = _g(spark, sf)
    p = evolution.evolution_parts(nodes, edges, tr, INTENTS)
    path = scratch_path(spark, "reports")
    writers.write_reports(it.report_lines(p["judged"], p["hubs"], p["anomalies"]), path)
    files = readers.list_artifacts(spark, path).where(F.col("file").endswith(".txt"))
    return files.select(F.regexp_extract("folder", r"project=([^/]*)", 1).alias("project_dir"), "length")


@register("snk_report_files")
def q_snk_report_files(spark, sf):
    """The written reports, read back: lines and bytes of each transition."""
    nodes, edges, tr = _g(spark, sf)
    p = evolution.evolution_parts(nodes, edges, tr, INTENTS)
    path = scratch_path(spark, "report-files")
    writers.write_reports(it.report_lines(p["judged"], p["hubs"], p["anomalies"]), path)
    back = spark.read.schema("value string, project string, v_old string, v_new string").text(path)
    return back.groupBy("project", "v_old", "v_new").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("value")).cast("bigint").alias("n_bytes"))


@register("src_list_artifacts")
def q_src_artifacts(spark, sf):
    nodes, edges = _graph(spark, sf)
    path = scratch_path(spark, "artifacts")
    writers.write_graph_text(nodes, edges, _versions(nodes), path)
    return (readers.list_artifacts(spark, path).where(F.col("file").endswith(".txt"))
            .groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes")))


# ------------------------------------------------------------------ EXT

from evograph.operators import extract as ex  # noqa: E402


def _jf(spark, sf):
    return fx.java_files(spark, sf)


@register("ext_java_loc")
def q_ext_loc(spark, sf):
    return _jf(spark, sf).select("project", "version", "path", ex.java_loc(F.col("content")).alias("loc"))


@register("ext_java_complexity")
def q_ext_complexity(spark, sf):
    return _jf(spark, sf).select("project", "version", "path",
                                 ex.java_complexity(F.col("content")).alias("complexity"))


@register("ext_java_package")
def q_ext_package(spark, sf):
    return _jf(spark, sf).select("project", "version", "path", ex.java_package(F.col("content")).alias("package"))


@register("ext_java_imports")
def q_ext_imports(spark, sf):
    return ex.java_imports(_jf(spark, sf))


@register("ext_java_records")
def q_ext_records(spark, sf):
    return ex.java_records(_jf(spark, sf)).select(
        "project", "version", "path", "pos", "name", F.array_join(F.array_sort("refs"), ",").alias("refs"))


@register("ext_java_types")
def q_ext_types(spark, sf):
    return ex.java_types(_jf(spark, sf)).select(
        "project", "version", "path", "pos", "name", "extends",
        F.array_join(F.array_sort("refs"), ",").alias("permits"))


@register("ext_java_nested_types")
def q_ext_nested(spark, sf):
    return ex.nested_types(_jf(spark, sf))


@register("ext_scope_table")
def q_ext_scopes(spark, sf):
    return ex.scope_table(fx.java_scope_files(spark, sf)).select("project", "version", "path", "outer", "name", "depth", "fqcn")


@register("ext_resolve_qualified")
def q_ext_qualified(spark, sf):
    g = ex.build_graph(fx.java_scope_files(spark, sf), scopes=True)
    return g["edges"].where(F.col("type") == "calls").select("project", "version", "source", "target")


@register("ext_declared_index")
def q_ext_index(spark, sf):
    d = ex.declarations(_jf(spark, sf))
    return ex.declared_index(d).select("project", "version", "name", "n_cand",
                                       F.when(F.col("n_cand") == 1, F.col("fqcn")).alias("unique_fqcn"))


@register("ext_token_refs")
def q_ext_tokens(spark, sf):
    f = _jf(spark, sf)
    d = ex.declarations(f)
    return ex.token_refs(f, d, ex.declared_index(d)).select("project", "version", "fqcn", "token")


@register("ext_resolve_refs")
def q_ext_resolve(spark, sf):
    f = _jf(spark, sf)
    d = ex.declarations(f)
    idx = ex.declared_index(d)
    imps = ex._imports_of(f, d)
    return ex.resolve(ex.token_refs(f, d, idx), imps, d, idx).select(
        "project", "version", F.col("fqcn").alias("source"), "target").distinct()


@register("ext_resolve_parent")
def q_ext_parent(spark, sf):
    f = _jf(spark, sf)
    d = ex.declarations(f)
    return ex.resolve_parent(d, ex._imports_of(f, d), ex.declared_index(d))


@register("ext_inheritance_depth")
def q_ext_depth(spark, sf):
    g = ex.build_graph(_jf(spark, sf))
    return g["nodes"].select("project", "version", "id", "inheritance_depth")


@register("ext_import_edges")
def q_ext_import_edges(spark, sf):
    g = ex.build_graph(_jf(spark, sf))
    return g["edges"].where(F.col("type") == "imports").select("project", "version", "source", "target")


@register("ext_build_graph")
def q_ext_build(spark, sf):
    g = ex.build_graph(_jf(spark, sf))
    return g["nodes"].select("project", "version", "id", "name", "file_path", "loc", "complexity",
                             "inheritance_depth", "fan_in", "fan_out", "coupling")


def _pf(spark, sf):
    return fx.python_files(spark, sf)


@register("ext_generic_metrics")
def q_ext_generic_metrics(spark, sf):
    f = fx.files(spark, sf)
    return f.select("project", "version", "path", ex.generic_loc(F.col("content")).alias("loc"),
                    ex.generic_complexity(F.col("content")).alias("complexity"))


@register("ext_generic_imports")
def q_ext_generic_imports(spark, sf):
    return ex.generic_imports(_pf(spark, sf), "python")


@register("ext_generic_mentions")
def q_ext_generic_mentions(spark, sf):
    return ex.generic_mentions(_pf(spark, sf), "python")


@register("ext_build_file_graph")
def q_ext_file_graph(spark, sf):
    g = ex.build_file_graph(_pf(spark, sf), "python")
    return g["nodes"].select("project", "version", "id", "name", "loc", "complexity", "fan_in", "fan_out",
                             "coupling")


def _languages(spark, sf):
    d = fx.table(spark, sf, "documents")
    per = d.groupBy("source", "lang").agg(F.sum("n_chars").alias("n"))
    return per.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("languages"))


@register("ext_major_language")
def q_ext_major(spark, sf):
    return ex.major_language(_languages(spark, sf), ["source"], skip_minor=True)


@register("ext_standard_language")
def q_ext_standard(spark, sf):
    inv = fx.inventory(spark, sf)
    return inv.select("owner", "repo", "language", ex.standard_language(F.col("language")).alias("standard"))


@register("ext_parse_coordinate")
def q_ext_coord(spark, sf):
    inv = fx.inventory(spark, sf)
    coord = (F.when(F.col("stars") % 10 == 0, F.col("owner"))
             .when(F.col("repo_key") % 2 == 0, F.concat("owner", F.lit("/"), "repo", F.lit(" : "), "language"))
             .otherwise(F.concat("owner", F.lit("/"), "repo")))
    p = ex.parse_coordinate(coord)
    return inv.select(coord.alias("coordinate"), p["owner"].alias("p_owner"), p["repo"].alias("p_repo"),
                      p["language"].alias("p_language"), p["error"].alias("error"))


# ------------------------------------------------------------------ STR

from evograph.streaming import jobs as st  # noqa: E402


def _stream(spark, records, build, name, n_files=None):
    """Land ``records`` as files, run ``build(stream)`` to completion, read the sink back."""
    base = scratch_path(spark, name)
    landing = st.land(records, base + "/landing", n_files)
    schema = spark.read.parquet(landing).schema
    src = st.read_stream(spark, landing, schema)
    st.run(build(src), base + "/sink", base + "/checkpoint")
    return st.read_result(spark, base + "/sink"), base


def _merged(spark, records, table, base, max_files):
    """Land ``records``, merge them into ``table`` in several batches, then again from the first with another checkpoint."""
    landing = st.land(records, base + "/landing")
    schema = spark.read.parquet(landing).schema
    for checkpoint in ("/checkpoint", "/again"):  # the second run repeats batch ids: they change nothing
        st.run(st.read_stream(spark, landing, schema, max_files), None, base + checkpoint, batches=table)
    return st.naive_times(table.read())


@register("str_graph_ingest")
def q_str_ingest(spark, sf):
    res, base = _stream(spark, fx.dep_edges(spark, sf), st.graph_ingest, "ingest")
    # a second run over the same checkpoint finds nothing new: exactly-once ingestion
    schema = spark.read.parquet(base + "/landing").schema
    st.run(st.graph_ingest(st.read_stream(spark, base + "/landing", schema)), base + "/sink", base + "/checkpoint")
    return st.read_result(spark, base + "/sink").select("project", "version", "source", "target", "type", "ord")


@register("str_graph_documents")
def q_str_documents(spark, sf):
    base = scratch_path(spark, "documents")
    docs = fx.graph_documents(spark, sf)
    tables = st.document_ingest(spark, base + "/tables")
    # the second drop brings a third of the documents again
    for drop in (docs, docs.where(F.col("key") % 3 == 0)):
        # the text of the documents is several times the tables made of it: files land compressed
        drop.drop("key").write.mode("append").json(base + "/landing", compression="gzip")
        st.run(st.read_documents(spark, base + "/landing", max_files=2), None, base + "/checkpoint", batches=tables)
    return _document_rows(*(tables.read(name) for name in ("versions", "nodes", "edges")))


@register("str_dedupe_discovered")
def q_str_discovered(spark, sf):
    base = scratch_path(spark, "discovered")
    table = st.upsert_discoveries(spark, base + "/table", fx.inventory(spark, sf), buckets=8)
    # a batch holds whatever discoveries its files hold: the merge follows ``seq``, not their order
    records = fx.discovered(spark, sf).repartition(6, "seq")
    return _merged(spark, records, table, base, 2).select("owner", "repo", "stars", "language", "status")


def _events(spark, sf):
    return fx.status_events(spark, sf)


def _closed(spark, sf):
    """The events and one that lets the watermark close all their windows."""
    ev = _events(spark, sf)
    return ev.unionByName(st.closing_event(ev))


@register("str_stale_claims")
def q_str_stale(spark, sf):
    res, _ = _stream(spark, _closed(spark, sf), lambda s: st.stale_claims(s), "stale")
    return res


@register("str_status_counts")
def q_str_counts(spark, sf):
    tumbling, _ = _stream(spark, _closed(spark, sf), lambda s: st.status_counts(s, "1 hour"), "counts-1h")
    sliding, _ = _stream(spark, _closed(spark, sf), lambda s: st.status_counts(s, "1 hour", "15 minutes"),
                         "counts-sliding")
    return tumbling.withColumn("kind", F.lit("tumbling")).unionByName(sliding.withColumn("kind", F.lit("sliding")))


@register("str_worker_sessions")
def q_str_workers(spark, sf):
    res, _ = _stream(spark, _closed(spark, sf), lambda s: st.worker_sessions(s), "workers")
    return res


@register("str_current_status")
def q_str_current(spark, sf):
    base = scratch_path(spark, "current")
    table = st.status_table(spark, base + "/table", buckets=8)
    records = _events(spark, sf).repartition(6, "event_id")
    return _merged(spark, records, table, base, 2).select("owner", "repo", "status", "since")


# ------------------------------------------------------------------ UDF

from evograph.functions import registry  # noqa: E402


@register("udf_register_adapter")
def q_udf_adapters(spark, sf):
    java = fx.java_files(spark, sf)
    py = fx.python_files(spark, sf)
    docs = fx.files(spark, sf).select("project", "version", "path", "language", "content")
    files = java.select("project", "version", "path", "language", "content").unionByName(
        py.select("project", "version", "path", "language", "content")).unionByName(docs)
    g = registry.extract_all(files)
    counts = g["nodes"].groupBy("project", "version", "adapter").agg(F.count(F.lit(1)).alias("n_nodes"))
    return (counts.select("project", "version", F.col("adapter").alias("language"), "n_nodes",
                          F.lit(None).cast("string").alias("error"))
            .unionByName(g["failures"].select("project", "version", F.lower("language").alias("language"),
                                              F.lit(None).cast("bigint").alias("n_nodes"), "error")))


@register("udf_score_reports")
def q_udf_score(spark, sf):
    nodes, edges, tr = _g(spark, sf)
    p = evolution.evolution_parts(nodes, edges, tr, INTENTS)
    report = it.report_text(it.report_lines(p["judged"], p["hubs"], p["anomalies"]))
    # counted and ranked once, for the report and the prompt
    prompts = it.analysis_prompt(nodes, edges, tr, INTENTS, cycle_changes=p["cycle_changes"], summary=p["summary"], hubs=p["hubs"])
    return registry.score_reports(prompts, report, scorer=None)


@register("udf_sql_functions")
def q_udf_sql(spark, sf):
    registry.register_sql_functions(spark)
    cyc = cycles.enumerate_cycles(fx.dep_edges(spark, sf), 5)
    k = (F.col("length") / 2).cast("int")
    rotated = F.concat(F.slice("cycle", k + 1, F.col("length") - k), F.slice("cycle", F.lit(1), k))
    view = f"cyc_{abs(hash(sf)) % 10_000_000}"
    cyc.select("project", "version", cycles.cycle_string(F.col("cycle")).alias("cycle_str"),
               F.transform(rotated, lambda x: F.lpad(x.cast("string"), 12, "0")).alias("rotated")
               ).createOrReplaceTempView(view)
    return spark.sql(f"""
        SELECT project, version, cycle_str,
               array_join(transform(canonical_cycle(rotated), x -> cast(cast(x AS BIGINT) AS STRING)), '>')
                 AS canonical_str,
               standard_language(project) AS std_project,
               coupling_z_score(size(rotated), 2.0, 1.5) AS z
        FROM {view}""")
