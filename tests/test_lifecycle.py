"""Cases where keys repeat, versions are many and cycles are long."""
import datetime as dt

from conftest import graph
from pyspark.sql import functions as F

from evograph.functions import registry
from evograph.operators import cycles, diff, extract, graph as gr, intents, inventory, metrics, quality
from evograph.sources import readers

NOW = "2024-01-02 12:00:00"
T0 = dt.datetime(2024, 1, 2, 10)


def queue(spark):
    rows = [("o", "a", "pending", None, None), ("o", "b", "crawled", None, None),
            ("o", "c", "processing", "w9", dt.datetime(2023, 12, 1)), ("o", "d", "processing", "w8", dt.datetime(2024, 1, 2, 11, 59))]
    return spark.createDataFrame(rows, "owner string, repo string, status string, worker_id string, claimed_at timestamp_ntz")


def test_one_claim_per_claimable_row(spark):
    claims = spark.createDataFrame([("o", r, w) for r in "abcd" for w in ("w2", "w1")], "owner string, repo string, worker_id string")
    new, hist = inventory.apply_claims(queue(spark), claims, NOW)
    got = {r["repo"]: (r["status"], r["worker_id"]) for r in new.collect()}
    assert got == {"a": ("processing", "w1"), "b": ("crawled", None), "c": ("processing", "w1"), "d": ("processing", "w8")}
    assert {(r["repo"], r["from_status"]) for r in hist.collect()} == {("a", "pending"), ("c", "processing")}
    assert quality.unique_key_check(new, ["owner", "repo"]).count() == 0


def test_updates_follow_each_other(spark):
    ups = [("o", "a", "processing", None, T0, 1), ("o", "a", "failed", "x", T0, 2), ("o", "a", "crawled", None, T0 + dt.timedelta(1), 0),
           ("o", "zz", "failed", None, T0, 0)]
    updates = spark.createDataFrame(ups, "owner string, repo string, status string, error_msg string, ts timestamp_ntz, sequence int")
    new, hist = inventory.apply_status(queue(spark), updates)
    assert new.count() == 4 and new.where("repo = 'a'").first()["status"] == "crawled"
    chain = [(r["from_status"], r["to_status"]) for r in hist.orderBy("transitioned_at", F.col("to_status").desc()).collect()]
    assert chain == [("pending", "processing"), ("processing", "failed"), ("failed", "crawled")]


def test_versions_in_numeric_order(spark):
    v = spark.createDataFrame([("p", x) for x in ("1.10.0", "1.9.0", "1.11.0", "1.9", "v2")], "project string, version string")
    got = {(r["v_old"], r["v_new"]) for r in gr.transitions_from_versions(v).collect()}
    assert got == {("1.9", "1.9.0"), ("1.9.0", "1.10.0"), ("1.10.0", "1.11.0"), ("v2", "1.9")}


def test_repeated_nodes_count_once(spark):
    n, e = graph(spark, [("a", "class", 1, 1, 1, 0), ("b", "class", 1, 1, 1, 0), ("a", "class", 5, 1, 1, 0)], [("a", "c", "calls")])
    assert gr.graph_stats(n, e).first()["node_count"] == 3
    assert gr.all_nodes(n, e).where("id = 'a'").first()["loc"] == 5
    assert metrics.degree_centrality(n, e).count() == 3


def ring(n):
    return [(f"n{i}", f"n{(i + 1) % n}", "calls") for i in range(n)]


def test_verdict_sees_cycles_of_any_length(spark):
    nodes = [(f"n{i}", "class", 1, 1, 1, 0) for i in range(9)]
    n1, e1 = graph(spark, nodes, ring(9)[:-1], version="v1")
    n2, e2 = graph(spark, nodes, ring(9), version="v2")
    n, e = n1.unionByName(n2), e1.unionByName(e2)
    tr = spark.createDataFrame([("P", "v1", "v2")], "project string, v_old string, v_new string")
    s = diff.diff_summary(n, e, tr, cycles.cycle_changes(e, tr))
    assert s.first()["new_cycles"] == 0  # beyond the bound of the listing
    s = cycles.with_exact_verdict(s, n, e)
    got = intents.intent_status(intents.intent_violations(s, ["avoid cyclic dependencies"])).first()
    assert got["has_new_cycle"] and got["intent_status"] == "VIOLATION"


def test_statuses_and_reports_see_a_new_cycle_of_six_nodes(spark):
    from evograph.operators import stats
    from evograph.plans import evolution
    nodes = [(f"n{i}", "class", 1, 1, 1, 0) for i in range(6)]
    n1, e1 = graph(spark, nodes, ring(6)[:-1], version="v1")
    n2, e2 = graph(spark, nodes, ring(6), version="v2")
    n, e = n1.unionByName(n2), e1.unionByName(e2)
    tr = spark.createDataFrame([("P", "v1", "v2")], "project string, v_old string, v_new string")
    fast = stats.evolution_comparison_fast(n, e, tr).first()
    assert fast["new_cycles"] == 0 and fast["status"] == "Violation"
    full = stats.evolution_comparison(n, e, tr)
    assert full.first()["has_new_cycle"] and full.first()["length_bound"] == 5
    assert intents.benchmark_status(full, "b").first()["status"] == "Violation"
    p = evolution.evolution_parts(n, e, tr, ["avoid cyclic dependencies"])
    lines = [r["line"] for r in intents.report_lines(p["judged"], p["hubs"], p["anomalies"]).collect()]
    assert intents.REC_CYCLES in lines and intents.REC_CLEAN not in lines
    payload = spark.createDataFrame([('{"diff": {"newCycles": 0, "hasNewCycle": true}}',), ('{"diff": {"newCycles": 0}}',),
                                     ('{"diff": {"newCycles": 2}}',)], "payload string")
    judged = intents.intent_status(intents.intent_violations(intents.payload_summary(payload), intents_col="intents"))
    assert [r["intent_status"] for r in judged.collect()] == ["VIOLATION", "CONFORMING", "VIOLATION"]


def test_findings_stay_with_their_graph(spark):
    n1, _ = graph(spark, [("a", "class", 1, 1, 1, 0)], [("a", "a", "calls")], project="P")
    n2, _ = graph(spark, [("a", "class", 1, 1, 1, 0)], [("a", "a", "calls")], project="Q")
    f = spark.createDataFrame([("P", "v1", "a.java", "r")], "project string, version string, basename string, rule string")
    got = {r["project"]: r["violation_count"] for r in metrics.merge_static_analysis(n1.unionByName(n2), f).collect()}
    assert got == {"P": 1, "Q": 0}


def test_edgeless_graphs_are_judged(spark):
    n, e = graph(spark, [("a", "class", -1, 1, 1, 0)], [("x", "y", "calls")], project="P")
    flags = quality.conformance_flags(n, e.limit(0), e.limit(0)).collect()
    assert len(flags) == 1


def test_builtin_adapters_stay(monkeypatch):
    monkeypatch.setattr(registry, "_ADAPTERS", {})
    registry.register_adapter("Rust", lambda f: {})
    assert {"java", "python", "rust"} <= set(registry.adapters())


def test_nested_types_ignore_literals_and_comments(spark):
    text = ('package p; class X { String s = "{ class No {"; char c = \'{\'; /* class Nor { */ static class In {} }\n'
            '// class Gone {\nclass Y { static class Z { class Deep {} } }')
    f = spark.createDataFrame([("P", "v", "x.java", text), ("P", "v", "y.java", None)], "project string, version string, path string, content string")
    assert sorted(r["fqcn"] for r in extract.nested_types(f).collect()) == ["p.X.In", "p.Y.Z"]


def test_sources_with_bad_bytes(spark, tmpdir_path):
    import os
    os.makedirs(f"{tmpdir_path}/a+b/in")
    with open(f"{tmpdir_path}/a+b/in/X.java", "wb") as o:
        o.write(b"class X { \xff }")
    rows = readers.read_sources(spark, f"{tmpdir_path}/a+b").collect()
    assert [(r["path"], r["content"]) for r in rows] == [("in/X.java", "class X { � }")]
