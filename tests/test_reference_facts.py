"""Golden facts of the small two-version graph shipped with the original system (as literals)."""
from pyspark.sql import functions as F

from conftest import graph
from evograph.operators import cycles, diff, graph as grf, intents as it, metrics
from evograph.plans import evolution

V1_NODES = [("com.telemetry.Service", "class", 7, 1, 1, 0), ("com.telemetry.Database", "class", 6, 1, 1, 0),
            ("com.telemetry.DataCollector", "class", 10, 2, 2, 0)]
V1_EDGES = [("com.telemetry.Service", "com.telemetry.DataCollector", "calls"),
            ("com.telemetry.DataCollector", "com.telemetry.Database", "calls")]
V2_NODES = V1_NODES + [("com.telemetry.NewUtility", "class", 13, 1, 0, 0)]
V2_EDGES = V1_EDGES + [("com.telemetry.Database", "com.telemetry.Service", "calls")]


def two_versions(spark):
    n1, e1 = graph(spark, V1_NODES, V1_EDGES, version="1.0.0")
    n2, e2 = graph(spark, V2_NODES, V2_EDGES, version="2.0.0")
    tr = spark.createDataFrame([("P", "1.0.0", "2.0.0")], "project string, v_old string, v_new string")
    return n1.unionByName(n2), e1.unionByName(e2), tr


def test_stats_and_diff(spark):
    nodes, edges, tr = two_versions(spark)
    st = {r.version: (r.node_count, r.edge_count) for r in grf.graph_stats(nodes, edges).collect()}
    assert st == {"1.0.0": (3, 2), "2.0.0": (4, 3)}
    cc = cycles.cycle_changes(edges, tr)
    s = diff.diff_summary(nodes, edges, tr, cc).collect()[0]
    assert (s.added_nodes, s.removed_nodes, s.added_edges, s.removed_edges, s.new_cycles, s.broken_cycles) == \
        (1, 0, 1, 0, 1, 0)
    assert [r.id for r in diff.added_nodes(nodes, edges, tr).collect()] == ["com.telemetry.NewUtility"]
    new = cc.collect()[0]
    assert new.change == "new"
    assert new.cycle == ["com.telemetry.DataCollector", "com.telemetry.Database", "com.telemetry.Service"]


def test_system_metrics(spark):
    nodes, _, _ = two_versions(spark)
    sm = {r.version: r for r in metrics.system_metrics(nodes).collect()}
    assert sm["1.0.0"].total_loc == 23 and sm["1.0.0"].total_classes == 3
    assert abs(sm["1.0.0"].avg_coupling - 4 / 3) < 1e-12
    assert sm["2.0.0"].total_loc == 36 and abs(sm["2.0.0"].avg_coupling - 1.0) < 1e-12


def test_violation_report(spark):
    nodes, edges, tr = two_versions(spark)
    out = evolution.evolution_analysis(nodes, edges, tr, ["avoid cyclic dependencies"], with_report=True).collect()[0]
    assert out.intent_status == "VIOLATION"
    assert "VIOLATION: New cyclic dependencies detected (1 new cycles)" in out.report
    assert out.report.startswith("Architectural Evolution Report (Version 1.0.0 -> 2.0.0)\n" + "=" * 59 + "\n")
    assert "   * Action required: Break the newly introduced dependency cycle(s)" in out.report
    assert out.report.endswith("\n")


def test_conflict_resolution(spark):
    s = spark.createDataFrame([("P", "a", "b", 12, 0, 30, 0, 2, 0)],
                              "project string, v_old string, v_new string, added_nodes int, removed_nodes int, "
                              "added_edges int, removed_edges int, new_cycles int, broken_cycles int")
    its = ["avoid cyclic dependencies", "minimize changes and complexity increase"]
    r = it.intent_violations(s, its, resolve=True).collect()[0]
    assert len(r.violations) == 2 and r.violations[1].startswith("RESOLVED:")
    assert len(r.conflicts) == 2
    raw = it.intent_violations(s, its, resolve=False).collect()[0]
    assert [v.split(":")[0] for v in raw.violations] == ["VIOLATION", "VIOLATION"]
    # "no cycles" alone raises no violation but can trigger the conflict log (documented quirk)
    q = it.intent_status(it.intent_violations(s, ["no cycles", "stability"])).collect()[0]
    assert q.intent_status == "CONFORMING" and len(q.conflicts) == 2


def test_anomalies_and_hubs(spark):
    # star: hub with 6 spokes; coupling missing -> degree; population sigma
    nodes = [("h", "class", 1, 1, None, 0)] + [(f"s{i}", "class", 1, 1, None, 0) for i in range(6)]
    edges = [("h", f"s{i}", "calls") for i in range(6)]
    n, e = graph(spark, nodes, edges)
    hubs = metrics.top_hubs(n, e, 3).orderBy("rank").collect()
    assert [h.id for h in hubs] == ["h", "s0", "s1"]       # ties keep node order
    assert abs(hubs[0].centrality - 1.0) < 1e-12
    an = metrics.coupling_anomalies(n, e).collect()
    assert [a.id for a in an] == ["h"] and an[0].coupling == 6
    mean, std = 12 / 7, (sum((x - 12 / 7) ** 2 for x in [6] + [1] * 6) / 7) ** 0.5
    assert an[0].z_score == round((6 - mean) / std, 2)
    assert it.python_float_str(F.lit(3.0)) is not None


def test_single_node_centrality_and_self_loop(spark):
    n, e = graph(spark, [("a", "class", 1, 1, 0, 0)], [("a", "a", "calls")])
    c = metrics.degree_centrality(n, e).collect()[0]
    assert c.centrality == 1.0 and c.degree == 2
    cyc = cycles.enumerate_cycles(e, 5).collect()
    assert [r.cycle for r in cyc] == [["a"]]
    assert metrics.coupling(n, e).collect()[0].coupling_value == 0   # a stored 0 stays 0
