"""Numbered commits, nested scopes, the positional token index and reuse by content."""
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import graph
from evograph.operators import extract as ex
from evograph.plans import evolution
from evograph.session import materialize
from evograph.streaming import jobs as st
from evograph.streaming import snapshots

EVENT = "owner string, repo string, to_status string, transitioned_at timestamp, event_id long"


def events(spark, rows):
    return spark.createDataFrame(rows, "owner string, repo string, to_status string, t string, event_id long").select(
        "owner", "repo", "to_status", F.col("t").cast("timestamp").alias("transitioned_at"), "event_id")


def rows_of(df, *cols):
    return sorted(tuple(str(r[c]) for c in cols) for r in df.collect())


# ---------------------------------------------------------------- commits

def test_replayed_and_killed_batches(spark, tmpdir_path, monkeypatch):
    table = st.status_table(spark, tmpdir_path + "/t", buckets=4)
    see = lambda **k: rows_of(table.read(**k), "repo", "status", "event_id")
    assert see() == []
    table(events(spark, [("o", "a", "pending", "2024-01-01 00:00:00", 1), ("o", "b", "pending", "2024-01-01 00:00:00", 2),
                         ("o", "a", "done", "2024-01-02 00:00:00", 3)]), 0)
    first = [("a", "done", "3"), ("b", "pending", "2")]
    assert see() == first
    # another content under the same id: the batch was committed, so nothing changes
    table(events(spark, [("o", "a", "x", "2025-01-01 00:00:00", 9)]), 0)
    assert see() == first
    late = events(spark, [("o", "b", "failed", "2023-01-01 00:00:00", 4), ("o", "c", "pending", "2024-01-03 00:00:00", 5),
                          ("o", "a", "tie", "2024-01-02 00:00:00", 2)])

    def killed(*_):
        raise RuntimeError("killed before the commit")
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_commit", killed)
        with pytest.raises(RuntimeError):
            table(late, 1)
    assert see() == first  # the files are there, the commit is not
    table(late, 1)
    assert see() == [("a", "done", "3"), ("b", "pending", "2"), ("c", "pending", "5")]
    assert see(batch=0) == first
    # a table opened again goes on where it was; an empty batch writes nothing
    again = st.status_table(spark, tmpdir_path + "/t", buckets=4)
    again(late.limit(0), 2)
    assert rows_of(again.read(), "repo") == [("a",), ("b",), ("c",)]


def test_only_touched_buckets_are_written(spark, tmpdir_path):
    table = st.status_table(spark, tmpdir_path + "/t", buckets=16)
    table(events(spark, [("o", f"r{i}", "pending", "2024-01-01 00:00:00", i) for i in range(200)]), 0)
    table(events(spark, [("o", "r7", "done", "2024-01-02 00:00:00", 500)]), 1)
    commits = spark.read.parquet(tmpdir_path + "/t/commits").groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in commits} == {0: 16, 1: 1}
    assert table.read().count() == 200 and table.read().where("status = 'done'").count() == 1


def test_discoveries_follow_seq_not_batches(spark, tmpdir_path):
    inv = spark.createDataFrame([("o", "a", 1, "Java", "crawled"), ("o", "b", 2, "Go", "crawled")],
                                "owner string, repo string, stars long, language string, status string")
    table = st.upsert_discoveries(spark, tmpdir_path + "/t", inv, buckets=3)
    d = lambda rows: spark.createDataFrame(rows, "owner string, repo string, stars long, language string, seq long")
    table(d([("o", "a", 50, "Java", 5), ("o", "c", 7, "C", 3)]), 0)
    table(d([("o", "a", 40, "Java", 4), ("o", "c", 8, "C", 9), ("o", "c", 6, "C", 1)]), 1)
    assert rows_of(table.read(), "repo", "stars", "status") == [
        ("a", "50", "crawled"), ("b", "2", "crawled"), ("c", "8", "pending")]


def document(project, n, at="2024-01-01", version="v1"):
    return json.dumps({"projectName": project, "version": version, "language": "Java", "extractedAt": at,
                       "systemMetrics": {"totalLinesOfCode": n, "totalClasses": n},
                       "nodes": [{"id": f"n{i}", "name": f"n{i}", "type": "class", "metrics": {"loc": i}} for i in range(n)],
                       "edges": [{"source": f"n{i}", "target": f"n{i + 1}", "type": "calls"} for i in range(n - 1)]})


def test_documents_become_visible_together(spark, tmpdir_path, monkeypatch):
    land = tmpdir_path + "/land"
    os.makedirs(land)

    def drop(name, *docs):
        with open(f"{land}/{name}.json", "w") as f:
            f.write("\n".join(docs))
    tables = st.document_ingest(spark, tmpdir_path + "/t")
    run = lambda: st.run(st.read_documents(spark, land, max_files=1), None, tmpdir_path + "/ck", batches=tables)
    counts = lambda: {p: tuple(tables.read(t).where(F.col("project") == p).count() for t in ("versions", "nodes", "edges"))
                      for p in ("A", "B")}
    drop("1", document("A", 3), document("B", 2), "{broken")
    run()
    assert counts() == {"A": (1, 3, 2), "B": (1, 2, 1)}
    drop("2", document("A", 3))  # read twice
    run()
    assert counts() == {"A": (1, 3, 2), "B": (1, 2, 1)}
    drop("3", document("B", 5, "2024-02-01"), document("B", 4, "2024-01-15"))

    parse = tables.parse

    def torn(batch):
        out = parse(batch)
        return out | {"edges": out["edges"].withColumn("type", F.raise_error(F.lit("killed")).cast("string"))}
    tables.parse = torn
    with pytest.raises(Exception, match="killed"):
        run()
    assert counts() == {"A": (1, 3, 2), "B": (1, 2, 1)}
    tables.parse = parse
    run()
    assert counts() == {"A": (1, 3, 2), "B": (1, 5, 4)}
    assert tables.read("nodes").where("project = 'B'").agg(F.max("loc")).first()[0] == 4


def test_windows_close_in_append_mode(spark, tmpdir_path):
    ev = events(spark, [("o", "a", "processing", "2024-01-01 00:10:00", 1), ("o", "a", "done", "2024-01-01 00:50:00", 2),
                        ("o", "a", "processing", "2024-01-01 03:00:00", 3)])
    land = st.land(ev.unionByName(st.closing_event(ev)), tmpdir_path + "/land", 1)
    stream = lambda: st.read_stream(spark, land, spark.read.parquet(land).schema)
    st.run(st.status_counts(stream()), tmpdir_path + "/w", tmpdir_path + "/wck")
    assert rows_of(spark.read.parquet(tmpdir_path + "/w"), "window_start", "to_status", "n") == [
        ("2024-01-01 00:00:00", "done", "1"), ("2024-01-01 00:00:00", "processing", "1"), ("2024-01-01 03:00:00", "processing", "1")]
    st.run(st.stale_claims(stream()), tmpdir_path + "/s", tmpdir_path + "/sck")
    assert rows_of(spark.read.parquet(tmpdir_path + "/s"), "session_end", "stale", "n_events") == [
        ("2024-01-01 00:40:00", "True", "1"), ("2024-01-01 01:20:00", "False", "1"), ("2024-01-01 03:30:00", "True", "1")]
    assert st.closing_event(ev.limit(0)).count() == 0


# ---------------------------------------------------------------- scopes

def files(spark, pairs):
    return spark.createDataFrame([("P", "v1", p, c, "Java", len(c)) for p, c in pairs],
                                 "project string, version string, path string, content string, language string, n_bytes long")


CONTAINER = "package com.example;\npublic class Container {\n public static class Item { private int value; }\n public static class Tag {}\n}\n"
CONSUMER = "package com.example;\npublic class Consumer {\n private Container.Item item;\n}\n"
RESPONSE = "package com.model;\npublic class Response {\n public static class Body { public String data; class Deep { class Deeper {} } }\n}\n"
SERVICE = "package com.service;\nimport com.model.Response;\npublic class ApiService {\n private Response.Body body; // Container.Tag\n}\n"
OTHER = ("package com.other;\npublic class Other {\n class Item {} \n void f() { class Local {} }\n Item mine; Response.Body.Deep.Deeper d;\n"
         " String s = \"class Fake { Container.Tag }\";\n}\nclass Second { Item notMine; }\n")


def test_nested_scopes_in_the_graph(spark):
    f = files(spark, [("Container.java", CONTAINER), ("Consumer.java", CONSUMER), ("Response.java", RESPONSE),
                      ("ApiService.java", SERVICE), ("Other.java", OTHER)])
    g = ex.build_graph(f, scopes=True)
    nodes = {r.id: (r.loc, r.complexity) for r in g["nodes"].collect()}
    assert set(nodes) == {"com.example.Container", "com.example.Container.Item", "com.example.Container.Tag", "com.example.Consumer",
                          "com.model.Response", "com.model.Response.Body", "com.service.ApiService", "com.other.Other",
                          "com.other.Other.Item", "com.other.Second"}
    assert nodes["com.example.Container.Item"] == (0, 1)
    edges = {(r.source, r.target, r.type) for r in g["edges"].collect()}
    assert ("com.example.Consumer", "com.example.Container.Item", "calls") in edges
    assert ("com.service.ApiService", "com.model.Response.Body", "calls") in edges
    assert ("com.service.ApiService", "com.model.Response", "calls") in edges
    # two types are called Item: the own scope decides, and only for the type around it
    assert ("com.other.Other", "com.other.Other.Item", "calls") in edges
    assert not any(s == "com.other.Second" and t.endswith("Item") for s, t, _ in edges)
    # comments and literals name nothing, nested types refer to nothing
    assert not any(t.endswith("Tag") and s != "com.example.Container" for s, t, _ in edges)
    assert not any(s in ("com.example.Container.Item", "com.model.Response.Body") for s, _, _ in edges)
    deep = ex.build_graph(f, scopes=True, max_depth=None)
    assert {"com.model.Response.Body.Deep", "com.model.Response.Body.Deep.Deeper"} <= {r.id for r in deep["nodes"].collect()}
    assert ("com.other.Other", "com.model.Response.Body.Deep.Deeper") in {(r.source, r.target) for r in deep["edges"].collect()}


def test_files_with_unmatched_braces_stay_flat(spark):
    g = ex.build_graph(files(spark, [("Odd.java", "package p;\nclass Odd { class In { }\n"), ("Use.java", "package p;\nclass Use { In x; }\n")]), scopes=True)
    assert {r.id for r in g["nodes"].collect()} == {"p.Odd", "p.In", "p.Use"}
    assert ("p.Use", "p.In") in {(r.source, r.target) for r in g["edges"].collect()}


def test_scope_table(spark):
    got = rows_of(ex.scope_table(files(spark, [("r", RESPONSE), ("o", OTHER), ("empty", ""), ("odd", "} } class X { class Y { } } }")])),
                  "path", "outer", "name", "depth")
    assert got == sorted([("o", "None", "Other", "0"), ("o", "Other", "Item", "1"), ("o", "None", "Second", "0"),
                          ("r", "None", "Response", "0"), ("r", "Response", "Body", "1"), ("r", "Response.Body", "Deep", "2"),
                          ("r", "Response.Body.Deep", "Deeper", "3")])


def test_mentions_equal_whole_word_search(spark):
    rng = random.Random(6)
    names = ["a", "b_c", "a-b", "a.b", "--", "-a", "a-", "a b", "a--b", "x.y-z", "é", "a-b-a", "+", "b"]
    bits = ["a", "b", "-", "--", ".", " ", "b_c", "x", "y-z", "é", "\n", "+", "a-b", "x.y-z", "-a", "a-"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in names]
    rows = [("P", "v", f"d/{n}.py", t) for n, t in zip(names, texts)]
    rows += [("P", "v", f"t/t{i}.py", "".join(rng.choice(bits) for _ in range(12))) for i in range(60)]
    f = spark.createDataFrame(rows, "project string, version string, path string, content string")
    got = {(r.source, r.target) for r in ex.generic_mentions(f, "python").collect()}
    want = set()
    for _, _, source, text in rows:
        for _, _, target, _ in rows:
            name = target.rsplit(".", 1)[0].split("/")[-1]
            if source != target and re.search(r"\b" + re.escape(name) + r"\b", text):
                want.add((source, target))
    assert got == want and len({t for _, t in want}) > 10


# ---------------------------------------------------------------- reuse

def test_unchanged_graphs_are_not_read_again(spark):
    parts = [graph(spark, [(f"{p}{v}{i}", "class", 1, 1, 1, 0) for i in range(4)],
                   [(f"{p}{v}0", f"{p}{v}1", "calls"), (f"{p}{v}1", f"{p}{v}{n}", "calls")], p, v)
             for p in "AB" for v, n in (("v1", 2), ("v2", 0))]
    nodes, edges = parts[0]
    for n, e in parts[1:]:
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    tr = spark.createDataFrame([(p, "v1", "v2") for p in "AB"], "project string, v_old string, v_new string")
    prints = evolution.graph_fingerprints(nodes, edges)
    mixed = evolution.graph_fingerprints(nodes.orderBy(F.rand(1)), edges.orderBy(F.rand(2)))
    assert rows_of(prints, "project", "version", "fingerprint") == rows_of(mixed, "project", "version", "fingerprint")
    assert prints.select("fingerprint").distinct().count() == 4
    plain = materialize(evolution.evolution_analysis(nodes, edges, tr), "plain")
    cols = plain.columns
    first, stored = evolution.analyse_changed(nodes, edges, tr, prints)
    assert rows_of(first, *cols) == rows_of(plain, *cols) and first.where("reused").isEmpty()

    def unreadable(df, which):
        broken = F.when(which, F.raise_error(F.lit("read")).cast("string")).otherwise(F.col("project"))
        return df.withColumn("project", broken)
    # nothing changed: no node and no edge is read
    again, same = evolution.analyse_changed(unreadable(nodes, F.lit(True)), unreadable(edges, F.lit(True)), tr, prints, stored)
    assert rows_of(again, *cols) == rows_of(plain, *cols) and again.where("not reused").isEmpty() and same.count() == 2
    # one graph changed: its transition alone is computed
    more = materialize(edges.unionByName(spark.createDataFrame([("B", "v2", 9, "Bv20", "Bv23", "calls")], edges.schema)), "more")
    out, both = evolution.analyse_changed(nodes, more, tr, evolution.graph_fingerprints(nodes, more), stored)
    assert rows_of(out, "project", "reused") == [("A", "True"), ("B", "False")] and both.count() == 3
    assert rows_of(out, *cols) == rows_of(evolution.evolution_analysis(nodes, more, tr), *cols)
    # other intents are another analysis
    assert evolution.intents_key(["avoid cyclic dependencies"]) != evolution.intents_key()


def test_graph_documents_group_once(spark):
    """Documents are built from one grouping of the order lines (besides the join of lines and orders)."""
    from evograph import fixtures as fx
    docs = fx.graph_documents(spark, "/root/testdata/sf0.001")
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ") == 1
    for d in docs.limit(50).collect():
        ends = {x for e in d.edges for x in (e.source, e.target)}
        assert [n.id for n in d.nodes] == sorted(ends, key=int) and len(d.edges) == len({(e.source, e.target) for e in d.edges})


def test_documents_land_compressed(spark, monkeypatch):
    """the landed documents are not the larger part of what the query writes, and all of them arrive."""
    import glob
    from evograph import fixtures as fx
    from evograph.plans import catalog
    bases, path = [], catalog.scratch_path
    monkeypatch.setattr(catalog, "scratch_path", lambda s, name: bases.append(path(s, name)) or bases[-1])
    rows = catalog.QUERIES["str_graph_documents"](spark, "/root/testdata/sf0.001")
    docs = fx.graph_documents(spark, "/root/testdata/sf0.001")
    want = docs.agg(F.count(F.lit(1)), F.sum(F.size("nodes")), F.sum(F.size("edges"))).first()
    assert tuple(want) == tuple(rows.where(F.col("kind") == k).count() for k in ("versions", "nodes", "edges"))
    landed = sum(os.path.getsize(f) for f in glob.glob(bases[0].removeprefix("file:") + "/landing/*.json*"))
    text = docs.drop("key").select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    assert 0 < landed < text / 4
