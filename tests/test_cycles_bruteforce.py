"""Cycle enumeration and SCC labels against brute force on random small graphs."""
import random

from evograph.operators import cycles


def brute_cycles(edges, max_len):
    adj = {}
    for s, t in edges:
        adj.setdefault(s, set()).add(t)
    out = set()
    nodes = sorted({x for e in edges for x in e})

    def dfs(root, cur, path):
        for nx in adj.get(cur, ()):
            if nx == root:
                out.add(tuple(path))
            elif nx > root and nx not in path and len(path) < max_len:
                dfs(root, nx, path + [nx])
    for r in nodes:
        dfs(r, r, [r])
    return out


def tarjan(nodes, edges):
    adj = {n: [] for n in nodes}
    for s, t in edges:
        adj[s].append(t)
    index, low, on, stack, comp, i = {}, {}, set(), [], {}, [0]

    def strong(v):
        index[v] = low[v] = i[0]
        i[0] += 1
        stack.append(v)
        on.add(v)
        for w in adj[v]:
            if w not in index:
                strong(w)
                low[v] = min(low[v], low[w])
            elif w in on:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            members = []
            while True:
                w = stack.pop()
                on.discard(w)
                members.append(w)
                if w == v:
                    break
            for m in members:
                comp[m] = min(members)
    for n in nodes:
        if n not in index:
            strong(n)
    return comp


def random_graphs(seed, n_graphs=3, n_nodes=14, n_edges=30):
    rnd = random.Random(seed)
    out = []
    for g in range(n_graphs):
        es = {(rnd.randrange(n_nodes), rnd.randrange(n_nodes)) for _ in range(n_edges)}
        out.append((f"g{g}", sorted(es)))
    return out


def test_enumeration_matches_bruteforce(spark):
    gs = random_graphs(7)
    rows = [(p, "v", s, t, "calls", i) for p, es in gs for i, (s, t) in enumerate(es)]
    edges = spark.createDataFrame(rows, "project string, version string, source long, target long, type string, ord long")
    got = {}
    for r in cycles.enumerate_cycles(edges, 5).collect():
        got.setdefault(r.project, set()).add(tuple(r.cycle))
    for p, es in gs:
        assert got.get(p, set()) == brute_cycles(es, 5), p


def test_scc_matches_tarjan(spark):
    gs = random_graphs(11, n_edges=22)
    rows = [(p, "v", s, t, "calls", i) for p, es in gs for i, (s, t) in enumerate(es)]
    edges = spark.createDataFrame(rows, "project string, version string, source long, target long, type string, ord long")
    nodes = spark.createDataFrame([(p, "v", n) for p, es in gs for n in sorted({x for e in es for x in e})],
                                  "project string, version string, id long")
    lab = {(r.project, r.id): r.scc for r in cycles.scc_labels(nodes, edges).collect()}
    for p, es in gs:
        ns = sorted({x for e in es for x in e})
        comp = tarjan(ns, [e for e in es if e[0] != e[1]])
        for n in ns:
            assert lab[(p, n)] == comp[n], (p, n)


def test_canonical_and_cycle_edges(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(["c", "a", "b"],)], "c array<string>")
    r = df.select(cycles.canonical_cycle(F.col("c")).alias("x"),
                  cycles.cycle_edge_pairs(F.col("c")).alias("e")).collect()[0]
    assert r.x == ["a", "b", "c"]
    assert [(p.source, p.target) for p in r.e] == [("c", "a"), ("a", "b"), ("b", "c")]
