"""Anchored cycle changes, kept components, exact counts and pointer doubling against brute force."""
import random
import re

import pytest
from pyspark.sql import functions as F

from evograph.operators import cycles, extract
from test_cycles_bruteforce import brute_cycles, tarjan

EDGES = "project string, version string, source long, target long, type string, ord long"


def edge_frame(spark, graphs):
    """graphs: {(project, version): edges}."""
    rows = [(p, v, s, t, "calls", i) for (p, v), es in graphs.items() for i, (s, t) in enumerate(es)]
    return spark.createDataFrame(rows, EDGES)


def two_versions(seed, n_graphs=4, n_nodes=14, n_edges=30, n_changed=8):
    rnd = random.Random(seed)
    out = {}
    for g in range(n_graphs):
        pick = lambda: (rnd.randrange(n_nodes), rnd.randrange(n_nodes))
        old = {pick() for _ in range(n_edges)}
        gone = set(rnd.sample(sorted(old), n_changed))
        out[f"g{g}", "v1"] = sorted(old)
        out[f"g{g}", "v2"] = sorted(old - gone | {pick() for _ in range(n_changed)})
    return out


def pairs_of(spark, graphs):
    return spark.createDataFrame([(p, "v1", "v2") for p, v in graphs if v == "v1"], "project string, v_old string, v_new string")


@pytest.mark.parametrize("max_len", [1, 2, 3, 5, 6])
def test_anchored_changes(spark, max_len):
    graphs = two_versions(max_len)
    got = {(r.project, r.change, tuple(r.cycle)) for r in
           cycles.cycle_changes(edge_frame(spark, graphs), pairs_of(spark, graphs), max_len).collect()}
    want = set()
    for p in {p for p, _ in graphs}:
        old, new = (brute_cycles(graphs[p, v], max_len) for v in ("v1", "v2"))
        want |= {(p, "new", c) for c in new - old} | {(p, "broken", c) for c in old - new}
    assert got == want


def test_each_change_is_told_once(spark):
    graphs = two_versions(9, n_nodes=6, n_edges=20)
    rows = cycles.cycle_changes(edge_frame(spark, graphs), pairs_of(spark, graphs)).collect()
    assert len(rows) == len({(r.project, r.change, r.cycle_str) for r in rows}) > 20


def test_hub_away_from_the_change_is_not_expanded(spark):
    """10^5 edges at an unchanged hub, which is on a cycle with all its users; one new cycle far from it."""
    hub = 10 ** 9
    users = spark.range(50_000).select(F.lit("p").alias("project"), F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("version"),
                                       F.col("id").alias("a"))
    edges = users.select("project", "version", F.col("a").alias("source"), F.lit(hub).alias("target")).unionByName(
        users.select("project", "version", F.lit(hub).alias("source"), F.col("a").alias("target")))
    extra = [("p", "v1", -1, -2), ("p", "v2", -1, -2), ("p", "v2", -2, -1)]
    edges = edges.unionByName(spark.createDataFrame(extra, "project string, version string, source long, target long"))
    tr = spark.createDataFrame([("p", "v1", "v2")], "project string, v_old string, v_new string")
    got = cycles.cycle_changes(edges, tr).collect()
    assert [(r.change, r.cycle) for r in got] == [("new", [-2, -1])]
    # the listing has one cycle a user, and no table over pairs of users
    assert cycles.enumerate_cycles(edges.where("version = 'v1'")).groupBy("length").count().collect() == [(2, 50_000)]


def test_listing_with_and_without_components(spark):
    graphs = {(f"g{i}", "v"): sorted(e) for i, (_, e) in enumerate(two_versions(3).items())}
    e = edge_frame(spark, graphs)
    known = []
    for (p, v), es in graphs.items():
        ns = sorted({x for s in es for x in s})
        known += [(p, v, n, c) for n, c in tarjan(ns, [x for x in es if x[0] != x[1]]).items()]
    for labels in (None, spark.createDataFrame(known, "project string, version string, id long, scc long")):
        rows = cycles.enumerate_cycles(e, 5, labels).collect()
        got = {(r.project, tuple(r.cycle)) for r in rows}
        assert got == {(p, c) for (p, _), es in graphs.items() for c in brute_cycles(es, 5)} and len(got) == len(rows)


def test_kept_labels_equal_fresh_ones(spark):
    graphs = {(f"{p}-{seed}", v): es for seed, n in ((1, 22), (2, 30), (5, 16))
              for (p, v), es in two_versions(seed, n_edges=n, n_changed=4).items()}
    e = edge_frame(spark, graphs)
    nodes = e.select("project", "version", F.explode(F.array("source", "target")).alias("id")).distinct()
    want = {}
    for (p, v), es in graphs.items():
        ns = sorted({x for s in es for x in s})
        want |= {(p, v, n): c for n, c in tarjan(ns, [x for x in es if x[0] != x[1]]).items()}
    old = spark.createDataFrame([(*k, c) for k, c in want.items() if k[1] == "v1"], "project string, version string, id long, scc long")
    got = {(r.project, r.version, r.id): r.scc for r in cycles.update_labels(old, nodes, e, pairs_of(spark, graphs)).collect()}
    assert got == {k: c for k, c in want.items() if k[1] == "v2"}


def test_exact_counts_of_any_length(spark):
    rnd = random.Random(4)
    graphs = {(f"g{i}", "v"): sorted({(rnd.randrange(12), rnd.randrange(12)) for _ in range(26)}) for i in range(6)}
    graphs["ring", "v"] = [(i, (i + 1) % 40) for i in range(40)]
    graphs["line", "v"] = [(i, i + 1) for i in range(9)]
    graphs["self", "v"] = [(1, 1), (1, 2)]
    e = edge_frame(spark, graphs)
    got = {r.project: (r.n_cycles, r.n_self_loops, r.longest, r.length_bound, r.status)
           for r in cycles.exact_cycle_counts(e, e).collect()}
    for (p, _), es in graphs.items():
        c = brute_cycles(es, 40)
        assert got[p] == (len(c), sum(len(x) == 1 for x in c), max(map(len, c), default=0), None, "counted"), p
    assert got["ring"][:3] == (1, 0, 40) and max(v[2] for k, v in got.items() if k[0] == "g") > 5


def test_counts_beyond_a_budget_say_so(spark):
    full = [(i, j) for i in range(9) for j in range(9) if i != j]
    e = edge_frame(spark, {("full", "v"): full, ("pair", "v"): [(1, 2), (2, 1)]})
    labels = spark.createDataFrame([("full", "v", i, 0) for i in range(9)] + [("pair", "v", i, 1) for i in (1, 2)],
                                   "project string, version string, id long, scc long")
    told = lambda **b: {r.project: (r.n_cycles, r.status) for r in cycles.exact_cycle_counts(e, e, labels, **b).collect()}
    assert told()["full"] == (len(brute_cycles(full, 9)), "counted")
    assert told(search_steps=500) == {"full": (None, "not counted: search too long"), "pair": (1, "counted")}
    assert told(shipped_edges=100) == {"full": (None, "not counted: component too large"), "pair": (1, "counted")}


def test_counts_send_the_driver_no_growing_table(spark, monkeypatch):
    """in the rounds of the exact counts every side that grows with the graphs is shuffled, however small it is."""
    unhinted, cut = {}, cycles.cut_lineage

    def told(df, name="round"):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in plan.splitlines() if re.search(r"\bJoin (Inner|Left)", x)]
        seen = unhinted.setdefault(name, [0, 0])
        seen[0] += len(joins)
        seen[1] += sum("strategy=merge" not in x for x in joins)
        return cut(df, name)
    monkeypatch.setattr(cycles, "cut_lineage", told)
    monkeypatch.setattr(cycles, "FEW_LABELS", -1, raising=False)  # no label is few
    rnd = random.Random(11)
    graphs = {(f"g{i}", "v"): sorted({(rnd.randrange(14), rnd.randrange(14)) for _ in range(24)}) for i in range(4)}
    graphs["ring", "v"] = [(i, (i + 1) % 12) for i in range(12)] + [(20 + i, 21 + i) for i in range(6)]
    e = edge_frame(spark, graphs)
    got = {r.project: (r.n_cycles, r.longest) for r in cycles.exact_cycle_counts(e, e).collect()}
    want = {p: brute_cycles(es, 14) for (p, _), es in graphs.items()}
    assert got == {p: (len(c), max(map(len, c), default=0)) for p, c in want.items()}
    assert unhinted["scc-label"][0] >= 6 and unhinted["count-inner"][0] == 2
    # beside the joins with the keys, one row a graph
    left = {n: k for n, (_, k) in unhinted.items() if k}
    assert set(left) <= {"count-core", "count-edges"} and left["count-edges"] == 1, left
    # and a few changed labels may go to the edges
    unhinted.clear()
    monkeypatch.setattr(cycles, "FEW_LABELS", 100_000)
    assert {r.project: (r.n_cycles, r.longest) for r in cycles.exact_cycle_counts(e, e).collect()} == got
    assert unhinted["scc-label"][1] > 0


# ---------------------------------------------------------------- inheritance depth

def slow_depth(extends, parents):
    out = {}
    for c in extends:
        seen, at = [c], c
        while at in parents and parents[at] not in seen:
            at = parents[at]
            seen.append(at)
        out[c] = len(seen) if at in parents else len(seen) - 1 + extends[at]
    return out


def frames(spark, extends, parents):
    d = spark.createDataFrame([("p", "v", c, "x" if e else None) for c, e in extends.items()],
                              "project string, version string, fqcn string, extends string")
    p = spark.createDataFrame([("p", "v", c, t) for c, t in parents.items()],
                              "project string, version string, fqcn string, parent string")
    return d, p


def test_depth_of_random_forests_and_loops(spark):
    rnd = random.Random(8)
    names = [f"c{i}" for i in range(60)]
    extends = {c: rnd.random() < 0.8 for c in names}
    parents = {c: rnd.choice(names) for c in names if extends[c] and rnd.random() < 0.8}
    parents |= {"c1": "c1", "c2": "c3", "c3": "c4", "c4": "c2", "c5": "c2", "c6": "c5"}  # loops and ways to them
    extends |= {c: True for c in parents}
    got = {r.fqcn: r.depth for r in extract.inheritance_depth(*frames(spark, extends, parents)).collect()}
    assert got == slow_depth(extends, parents)
    only_loop = {"a": "b", "b": "a"}
    got = extract.inheritance_depth(*frames(spark, {"a": True, "b": True}, only_loop)).collect()
    assert {(r.fqcn, r.depth) for r in got} == {("a", 2), ("b", 2)}


def test_long_chain_in_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    cut = extract.cut_lineage
    monkeypatch.setattr(extract, "cut_lineage", lambda df, *name: rounds.append(1) or cut(df, *name))
    d, p = frames(spark, {f"c{i}": i > 0 for i in range(n)}, {f"c{i}": f"c{i - 1}" for i in range(1, n)})
    got = extract.inheritance_depth(d, p)
    assert got.agg(F.sum("depth"), F.max("depth")).first() == (n * (n - 1) // 2, n - 1)
    assert len(rounds) - 2 <= 16  # beside the rounds: the classes and the first pointers


def written(monkeypatch):
    """The tables written by the operators of cycles.py, by name."""
    tables, cut = {}, cycles.cut_lineage

    def told(df, name="round"):
        out = cut(df, name)
        tables.setdefault(name, []).append(out)
        return out
    monkeypatch.setattr(cycles, "cut_lineage", told)
    return tables


def sparse_graph(seed, n_nodes=1500, n_edges=4500):
    rnd = random.Random(seed)
    return sorted({(rnd.randrange(n_nodes), rnd.randrange(n_nodes)) for _ in range(n_edges)})


def test_component_is_not_coloured_by_what_leads_to_it(spark, monkeypatch):
    """A large component with nodes before and behind it: one forward and one backward propagation, over numbers alone."""
    tables = written(monkeypatch)
    es = sparse_graph(3)
    nodes = spark.createDataFrame([("p", "v1", i) for i in range(1500)], "project string, version string, id long")
    got = {r.id: r.scc for r in cycles.scc_labels(nodes, edge_frame(spark, {("p", "v1"): es})).collect()}
    want = tarjan(range(1500), es)
    assert got == want
    assert len(tables["scc-ce"]) == 1
    assert all(d.dtypes == [("n", "bigint"), ("c", "bigint"), ("chg", "boolean")] for d in tables["scc-label"])


def test_few_open_paths_reach_the_closing_join(spark, monkeypatch):
    tables = written(monkeypatch)
    graphs = {("p", "v1"): sparse_graph(4), ("p", "v2"): sparse_graph(5)}
    edges = edge_frame(spark, graphs)
    assert {tuple(r.cycle) for r in cycles.enumerate_cycles(edges.where("version = 'v1'")).collect()} == brute_cycles(graphs["p", "v1"], 5)
    got = {(r.change, tuple(r.cycle)) for r in cycles.cycle_changes(edges, pairs_of(spark, graphs)).collect()}
    old, new = (brute_cycles(graphs["p", v], 5) for v in ("v1", "v2"))
    assert got == {("new", c) for c in new - old} | {("broken", c) for c in old - new}
    # about 13 paths of up to 2 edges lead on from an edge, and about 12 nodes lead back to it
    assert tables["cycle-ends"][0].count() < 4500
    assert tables["change-ends"][0].count() < 2 * 4500 * 3


def test_short_new_cycle_is_a_proof(spark, monkeypatch):
    """Only transitions without a short new cycle go through components, which see the long one."""
    asked, real = [], cycles.scc_labels

    def told(nodes, edges):
        asked.append(sorted(r.project for r in edges.select("project").distinct().collect()))
        return real(nodes, edges)
    monkeypatch.setattr(cycles, "scc_labels", told)
    chain = [(i, i + 1) for i in range(1, 9)]
    graphs = {("a", "v1"): [(1, 2)], ("a", "v2"): [(1, 2), (2, 1)], ("b", "v1"): chain, ("b", "v2"): [*chain, (9, 1)],
              ("c", "v1"): chain, ("c", "v2"): [*chain, (1, 9)]}
    nodes = spark.createDataFrame([(p, v, i) for p, v in graphs for i in range(1, 10)], "project string, version string, id long")
    got = {r.project: r.has_new_cycle for r in cycles.has_new_cycle(nodes, edge_frame(spark, graphs), pairs_of(spark, graphs)).collect()}
    assert got == {"a": True, "b": True, "c": False}
    assert asked == [["b", "c"]]


def test_prompt_searches_cycles_once(spark, monkeypatch):
    """The cycle changes are read by three branches of the prompt and written once, or taken from the caller."""
    from evograph.operators import intents
    tables, real = {}, intents.materialize
    monkeypatch.setattr(intents, "materialize", lambda df, name: tables.setdefault(name, real(df, name)))
    graphs = two_versions(1, n_graphs=1)
    edges, tr = edge_frame(spark, graphs), pairs_of(spark, graphs)
    nodes = spark.createDataFrame([("g0", v, i, i, 1) for v in ("v1", "v2") for i in range(14)],
                                  "project string, version string, id long, ord long, coupling long")
    asked = [{"text": "avoid cyclic dependencies"}]
    first = intents.analysis_prompt(nodes, edges, tr, asked).collect()
    assert list(tables) == ["cycle-changes"]
    again = intents.analysis_prompt(nodes, edges, tr, asked, cycle_changes=tables["cycle-changes"]).collect()
    assert again == first and len(first) == 1
    assert len(tables) == 1


def test_resolution_broadcasts_nothing(spark):
    """Sides that grow with the sources stay out of the driver, however small they lie in a shuffle."""
    files = spark.createDataFrame(
        [("p", "v1", f"src/a/C{i}.java", f"package a;\nimport a.C{i + 1};\nclass C{i} {{\n  C{i + 1} next;\n  C{i + 1}.In other;\n"
          "  static class In { }\n}\n") for i in range(20)], "project string, version string, path string, content string")
    decls = extract.scoped_declarations(files, extract.scope_table(files))
    found = extract.resolve_scoped(extract.scoped_refs(files, decls), extract._imports_of(files, decls), decls)
    calls = {(r.fqcn, r.target) for r in found.collect()}
    assert {("a.C0", "a.C1"), ("a.C0", "a.C1.In")} <= calls
    refs = spark.createDataFrame([("p", "v1", "a.C0", "a", "C1")], "project string, version string, fqcn string, package string, token string")
    flat = decls.select("project", "version", "fqcn", "name", "package", "path")
    out = extract.resolve(refs, extract._imports_of(files, flat), flat, extract.declared_index(flat))
    plan = out.select("target")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=merge)") >= 8


def test_counts_and_changes_share_one_listing(spark, monkeypatch):
    """STA-03 lists the cycles of all versions once: counts and changes read that listing."""
    import random
    from evograph.operators import stats
    rnd = random.Random(5)
    rows = [("P", v, n, rnd.randrange(30), rnd.randrange(30), "calls") for v in ("v1", "v2") for n in range(90)]
    edges = spark.createDataFrame(rows, "project string, version string, ord bigint, source bigint, target bigint, type string")
    ids = [("P", v, i, i, f"N{i}", "class", f"{i}.java", i, i % 7, i % 10, i % 5) for v in ("v1", "v2") for i in range(30)]
    nodes = spark.createDataFrame(ids, "project string, version string, ord bigint, id bigint, name string, type string, "
                                       "file_path string, loc bigint, complexity bigint, coupling bigint, inheritance_depth bigint")
    tr = spark.createDataFrame([("P", "v1", "v2")], "project string, v_old string, v_new string")
    # the same changes from changed edges, from a listing of both versions, and by brute force
    want = {}
    for v in ("v1", "v2"):
        want[v] = brute_cycles({(r[3], r[4]) for r in rows if r[1] == v}, 5)
    want = ({("new", c) for c in want["v2"] - want["v1"]} | {("broken", c) for c in want["v1"] - want["v2"]})
    for share in (0.0, 2.0):
        monkeypatch.setattr(cycles, "MANY_CHANGES", share)
        got = [(r.change, tuple(r.cycle)) for r in cycles.cycle_changes(edges, tr).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    calls, search = [], cycles._reached_back
    monkeypatch.setattr(cycles, "_reached_back", lambda *a, **k: calls.append(1) or search(*a, **k))
    row = stats.evolution_comparison_fast(nodes, edges, tr).first()
    assert (row.new_cycles, row.broken_cycles) == (sum(c == "new" for c, _ in want), sum(c == "broken" for c, _ in want))
    # one search for all: none from changed edges beside the listing
    assert len(calls) == 1


def complete(n):
    return [(i, j) for i in range(n) for j in range(n) if i != j]


def test_searches_are_handed_on_until_nothing_is_left(spark, monkeypatch):
    """a component is counted whole however many steps it takes; a search without a step left goes on in the next round."""
    monkeypatch.setattr(cycles, "ROUND_STEPS", 3000, raising=False)
    monkeypatch.setattr(cycles, "COPIED_EDGES", 300, raising=False)
    tables, rnd = written(monkeypatch), random.Random(21)
    # numbers beyond the exact doubles
    graphs = {(f"g{i}", "v"): sorted({(2 ** 60 + rnd.randrange(13), 2 ** 60 + rnd.randrange(13)) for _ in range(34)}) for i in range(4)}
    graphs["full", "v"], graphs["pair", "v"] = complete(8), [(1, 2), (2, 1)]
    e = edge_frame(spark, graphs)
    got = {r.project: (r.n_cycles, r.longest, r.status) for r in cycles.exact_cycle_counts(e, e).collect()}
    want = {p: brute_cycles(es, 13) for (p, _), es in graphs.items()}
    assert got == {p: (len(c), max(map(len, c), default=0), "counted") for p, c in want.items()}
    assert len(tables["count-found"]) > 2


def test_no_component_and_no_root_is_left_out(spark):
    """2,100 nodes in one ring with 2,100 chords back (4,200 edges times nodes are beyond 4 million), and a root of more than 2 million steps."""
    n = 2100
    ladder = [(i, (i + 1) % n) for i in range(n)] + [((i + 1) % n, i) for i in range(n)]
    e = edge_frame(spark, {("ladder", "v"): ladder, ("full", "v"): complete(10)})
    labels = spark.createDataFrame([("ladder", "v", i, 0) for i in range(n)] + [("full", "v", i, 0) for i in range(10)],
                                   "project string, version string, id long, scc long")
    got = {r.project: (r.n_cycles, r.longest, r.status) for r in cycles.exact_cycle_counts(e, e, labels).collect()}
    # a pair of neighbours each, and once around in both directions; sum over k of C(10, k) (k - 1)!
    assert got == {"ladder": (n + 2, n, "counted"), "full": (1_112_073, 10, "counted")}


def test_prompt_lists_are_put_together_from_pieces(spark, monkeypatch):
    """no task collects the items of a whole list; pieces of any size give the same ordered text."""
    import ast
    from evograph.operators import intents
    graphs = two_versions(6, n_graphs=2, n_nodes=40, n_edges=150, n_changed=60)
    edges, tr = edge_frame(spark, graphs), pairs_of(spark, graphs)
    nodes = spark.createDataFrame([(f"g{g}", v, i, 100 - i, 1) for g in range(2) for v in ("v1", "v2") for i in range(0, 40 if v == "v1" else 36)],
                                  "project string, version string, id long, ord long, coupling long")
    asked = [{"text": "avoid cyclic dependencies"}]
    texts = {}
    for size in (10, 1000):
        monkeypatch.setattr(intents, "LIST_PIECE", size, raising=False)
        prompt = intents.analysis_prompt(nodes, edges, tr, asked)
        plan = prompt._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan
        texts[size] = {r.project: r.prompt for r in prompt.collect()}
    assert texts[10] == texts[1000] and len(texts[10]) == 2
    for p, text in texts[10].items():
        old, new = (set(graphs[p, v]) for v in ("v1", "v2"))
        told = {m[1]: (int(m[2]), ast.literal_eval(m[3])) for m in re.finditer(r"- (.+) Count: (\d+) \((\[.*\])\)", text)}
        assert told["Added Edges"] == (len(new - old), sorted(new - old)) and len(new - old) > 40
        assert told["Removed Edges"] == (len(old - new), sorted(old - new))
        cyc = [brute_cycles(g, 5) for g in (old, new)]
        as_text = lambda cs: [list(c) for c in sorted(cs, key=lambda c: ">".join(map(str, c)))]
        assert told["New Cycles"] == (len(cyc[1] - cyc[0]), as_text(cyc[1] - cyc[0]))
        assert told["Broken Cycles"] == (len(cyc[0] - cyc[1]), as_text(cyc[0] - cyc[1]))


def test_prompt_takes_counts_and_hubs_from_the_caller(spark, monkeypatch):
    """report and prompt share counts and hubs; neither is computed again for the prompt."""
    from evograph.operators import diff, intents, metrics
    from evograph.plans import evolution
    graphs = two_versions(2, n_graphs=1)
    edges, tr = edge_frame(spark, graphs), pairs_of(spark, graphs)
    nodes = spark.createDataFrame([("g0", v, i, i, 1) for v in ("v1", "v2") for i in range(14)],
                                  "project string, version string, id long, ord long, coupling long")
    asked = [{"text": "avoid cyclic dependencies"}]
    p = evolution.evolution_parts(nodes, edges, tr, ["avoid cyclic dependencies"])
    want = intents.analysis_prompt(nodes, edges, tr, asked, cycle_changes=p["cycle_changes"]).collect()
    for module, name in ((diff, "diff_summary"), (metrics, "top_hubs")):
        monkeypatch.setattr(module, name, lambda *a, **k: pytest.fail("computed again"))
    got = intents.analysis_prompt(nodes, edges, tr, asked, cycle_changes=p["cycle_changes"], summary=p["summary"], hubs=p["hubs"]).collect()
    assert got == want and len(got) == 1


def test_tables_between_steps_are_written_small(spark):
    """tables between steps are compressed by zstd, which takes less of the shared folder than Spark's default."""
    from evograph.session import materialize
    df = materialize(spark.range(1000).select("id"), "small")
    assert all(f.endswith(".zstd.parquet") for f in df.inputFiles()) and df.count() == 1000
