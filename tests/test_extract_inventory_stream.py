"""Extraction regression facts, inventory lifecycle and streaming exactly-once."""
import os

from pyspark.sql import functions as F

from evograph.operators import extract as ex, inventory as inv
from evograph.streaming import jobs as st

BASE = "package com.example;\n\npublic class BaseService {\n    public void run() {}\n}\n"
MY = ("package com.example;\n\npublic class MyService extends BaseService {\n"
      "    private HelperUtility helper;\n    public void go() { if (helper != null && true) {} }\n}\n")
HELPER = "package com.example;\n\nclass HelperUtility {\n    MyService back;\n}\n"
SHAPES = ("package geo;\npublic sealed interface Shape permits Circle, Square {}\n"
          "final class Circle implements Shape {}\nfinal class Square implements Shape {}\n"
          "record PaymentProcessor(Circle c, AuditLogger log) {}\nclass AuditLogger {}\n")
NESTED = "package com.example;\npublic class Container {\n  public static class Item {}\n  enum Tag { A }\n}\n"


def files(spark, items):
    return spark.createDataFrame([("P", "v1", p, "Java", c) for p, c in items],
                                 "project string, version string, path string, language string, content string")


def test_regression_graph(spark):
    f = files(spark, [("BaseService.java", BASE), ("MyService.java", MY), ("HelperUtility.java", HELPER)])
    g = ex.build_graph(f)
    depth = {r.id: r.inheritance_depth for r in g["nodes"].collect()}
    assert depth == {"com.example.BaseService": 0, "com.example.MyService": 1, "com.example.HelperUtility": 0}
    edges = {(r.source.split(".")[-1], r.target.split(".")[-1], r.type) for r in g["edges"].collect()}
    assert edges == {("MyService", "BaseService", "calls"), ("MyService", "HelperUtility", "calls"),
                     ("HelperUtility", "MyService", "calls"), ("MyService", "BaseService", "inheritance")}
    loc = {r.id.split(".")[-1]: (r.loc, r.complexity) for r in g["nodes"].collect()}
    assert loc["MyService"] == (5, 3)


def test_records_sealed_and_nested(spark):
    f = files(spark, [("geo/Shape.java", SHAPES)])
    d = {r.fqcn: r for r in ex.declarations(f).collect()}
    assert set(d) == {"geo.Shape", "geo.Circle", "geo.Square", "geo.PaymentProcessor", "geo.AuditLogger"}
    assert sorted(d["geo.Shape"].refs) == ["Circle", "Square"]
    assert sorted(d["geo.PaymentProcessor"].refs) == ["AuditLogger", "Circle"]
    n = ex.nested_types(files(spark, [("Container.java", NESTED)])).collect()
    assert sorted(r.fqcn for r in n) == ["com.example.Container.Item", "com.example.Container.Tag"]


def test_language_helpers(spark):
    df = spark.createDataFrame([("javascript",), ("PYTHON3",), ("rust",), ("",)], "l string")
    assert [r.s for r in df.select(ex.standard_language(F.col("l")).alias("s")).collect()] == \
        ["Java", "Python", "Rust", "Java"]
    c = spark.createDataFrame([("a/b:Java",), ("nope",)], "c string").select(ex.parse_coordinate(F.col("c")).alias("p"))
    rows = c.collect()
    assert (rows[0].p.owner, rows[0].p.repo, rows[0].p.language) == ("a", "b", "Java")
    assert rows[1].p.error.startswith("Invalid repository format 'nope'")


def _queue(spark):
    return spark.createDataFrame(
        [("o", f"r{i}", 100 + i, "pending", None, None) for i in range(20)]
        + [("o", "stale", 5, "processing", "2001-07-31 23:00:00", "w9"),
           ("o", "nullclaim", 7, "processing", None, "w8")],
        "owner string, repo string, stars bigint, status string, claimed_at string, worker_id string"
    ).withColumn("claimed_at", F.col("claimed_at").cast("timestamp_ntz"))


def test_claims_disjoint_and_ordered(spark):
    q = _queue(spark)
    b = inv.assign_workers(inv.next_batch(q, 25, "2001-08-01 00:00:00"), 4).collect()
    assert [r.repo for r in b][:3] == ["r19", "r18", "r17"]
    assert len({r.repo for r in b}) == len(b) == 21          # 20 pending + the stale claim
    assert {r.worker_no for r in b} == {0, 1, 2, 3}


def test_requeue_stale(spark):
    new, hist = inv.requeue_stale(_queue(spark), "2001-08-01 00:00:00")
    h = hist.collect()
    assert [(r.repo, r.error_msg) for r in h] == [("stale", "stale reclaim")]
    rows = {r.repo: r for r in new.collect()}
    assert rows["stale"].status == "pending" and rows["stale"].worker_id is None
    assert rows["nullclaim"].status == "processing"        # NULL claimed_at is never stale


def test_upsert_keeps_one_row_per_key(spark):
    q = _queue(spark)
    d = spark.createDataFrame([("o", "r1", 999, "Java", 1), ("o", "new", 1, "Java", 2), ("o", "new", 3, "Go", 3)],
                              "owner string, repo string, stars bigint, language string, seq bigint")
    out = {r.repo: r for r in inv.upsert_discovered(q.withColumn("language", F.lit("java")), d).collect()}
    assert out["r1"].stars == 999 and out["r1"].status == "pending"
    assert out["new"].stars == 3 and out["new"].language == "Go" and out["new"].status == "pending"
    assert len(out) == 23


def test_stream_ingest_exactly_once(spark, tmpdir_path):
    rows = spark.createDataFrame([("P", "v", i, i + 1, "calls", i) for i in range(50)],
                                 "project string, version string, source long, target long, type string, ord long")
    landing = st.land(rows, os.path.join(tmpdir_path, "landing"), 3)
    schema = spark.read.parquet(landing).schema
    for _ in range(2):
        st.run(st.graph_ingest(st.read_stream(spark, landing, schema)), os.path.join(tmpdir_path, "sink"),
               os.path.join(tmpdir_path, "ck"), mode="append")
    assert spark.read.parquet(os.path.join(tmpdir_path, "sink")).count() == 50


def test_resolve_qualified_nested(spark):
    from pyspark.sql import functions as F
    container = "package com.model;\npublic class Response {\n  public static class Body {}\n}\n"
    api = "package com.api;\nimport com.model.Response;\npublic class ApiService { Response.Body b; }\n"
    f = files(spark, [("com/model/Response.java", container), ("com/api/ApiService.java", api)])
    decls = ex.declarations(f)
    nested = ex.nested_types(f).select("project", "version", "fqcn", F.col("inner").alias("name"),
                                       F.lit("com.model").alias("package"), "path")
    decls = decls.select("project", "version", "fqcn", "name", "package", "path").unionByName(nested)
    idx = ex.declared_index(decls)
    imports = ex._imports_of(f, decls)
    refs = spark.createDataFrame([("P", "v1", "com.api.ApiService", "com.api", "Response.Body")],
                                 "project string, version string, fqcn string, package string, token string")
    got = [(r.fqcn, r.target) for r in ex.resolve_qualified(refs, imports, decls, idx).collect()]
    assert got == [("com.api.ApiService", "com.model.Response.Body")]


def test_previous_value_equals_lag(spark):
    from pyspark.sql import Window
    from evograph.operators.graph import previous_value
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    want = {r.event_id: r.p for r in ev.select("event_id", F.lag("event_type").over(w).alias("p")).collect()}
    got = {r.event_id: r.p for r in previous_value(ev, ["user_id"], "ts", "event_id", "event_type",
                                                   F.to_date("ts"), "p").select("event_id", "p").collect()}
    assert got == want
