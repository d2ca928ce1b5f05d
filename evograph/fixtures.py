"""Graph, inventory and corpus tables derived from the driver's TPC-H-like parquet.

Every function takes ``(spark, sf_dir)`` and returns a lazily planned
DataFrame; nothing is collected.  The same definitions are written as DuckDB
CTEs in :mod:`evograph.plans.oracle` so that the oracle and the Spark job see
identical inputs.

Fixed choices of the fixture (shared with the oracle):
  * project = ``o_orderpriority``; node id = part key; an edge joins two
    consecutive lines of one order (order of lines: linenumber, partkey,
    suppkey, extendedprice).
  * version ``v1`` = orders before 1999-01-01, ``v2`` = orders from 1997-01-01.
  * edge type by ``source % 3`` (0 inheritance, 1 imports, 2 calls);
    document order ``ord = source * 1000000 + target``.
  * declared nodes = endpoints except ``id % 50 = 7`` (those stay implicit).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

V1_BEFORE = "1999-01-01"
V2_FROM = "1997-01-01"
NOW = "2001-08-01 00:00:00"
FILE_EXTENSIONS = [".py", ".js", ".html", ".css", ".toml", ".sh", ".ttl", ".txt", ".java", ".gleam",
                   ".erl", ".rs"]
LANGUAGES = ["Java", "Python", "Gleam", "Erlang", "Rust", "JavaScript"]

# Fixed intents of the fixture (mirrors a demo run plus two structured limits).
FIXTURE_INTENTS = [
    {"intent_id": 1, "kind": "text", "text": "avoid cyclic dependencies", "limit": None},
    {"intent_id": 2, "kind": "text", "text": "minimize changes and complexity increase", "limit": None},
    {"intent_id": 3, "kind": "max-coupling", "text": "max coupling", "limit": 7},
    {"intent_id": 4, "kind": "max-inheritance", "text": "max depth", "limit": 3},
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dep_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (uncollapsed, typed) edges ``(project, version, source, target, type, ord)``."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    e0 = (li.join(od, li.l_orderkey == od.o_orderkey)
          .select(F.col("o_orderpriority").alias("project"),
                  F.col("o_orderdate").alias("d"),
                  F.col("l_partkey").alias("source"),
                  F.lead("l_partkey").over(w).alias("target"))
          .where(F.col("target").isNotNull()))
    # one scan feeds both versions: a row goes to v1, v2 or both
    vers = F.filter(
        F.array(F.when(F.col("d") < F.lit(V1_BEFORE).cast("timestamp_ntz"), F.lit("v1")),
                F.when(F.col("d") >= F.lit(V2_FROM).cast("timestamp_ntz"), F.lit("v2"))),
        lambda v: v.isNotNull())
    e = e0.select("project", F.explode(vers).alias("version"), "source", "target")
    return e.select(
        "project", "version", "source", "target",
        F.when(F.col("source") % 3 == 0, "inheritance")
         .when(F.col("source") % 3 == 1, "imports").otherwise("calls").alias("type"),
        (F.col("source") * 1000000 + F.col("target")).alias("ord"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, o_orderpriority, d, source, target): consecutive lines of one order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return (li.join(od, li.l_orderkey == od.o_orderkey)
            .select("o_custkey", "o_orderpriority", F.col("o_orderdate").alias("d"), F.col("l_partkey").alias("source"),
                    F.lead("l_partkey").over(w).alias("target")).where(F.col("target").isNotNull()))


#: Length of a season in months: the graphs are so sparse that cycles are few, but some are long.
SEASON_MONTHS = 6


def season_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse graphs: project = ``o_orderpriority``, version = season of SEASON_MONTHS months."""
    months = F.year("d") * 12 + F.month("d")
    return _lines(spark, sf_dir).select(
        F.col("o_orderpriority").alias("project"),
        F.concat(F.lit("s"), F.floor(months / SEASON_MONTHS).cast("string")).alias("version"), "source", "target")


def graph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph documents, one per customer and year (a handful of orders each); ``key`` is the customer."""
    g = ["o_custkey", "version"]
    kind = F.when(F.col("source") % 3 == 0, "inheritance").when(F.col("source") % 3 == 1, "imports").otherwise("calls")
    e = (_lines(spark, sf_dir).select("o_custkey", F.concat(F.lit("y"), F.year("d").cast("string")).alias("version"),
                                      F.struct("source", "target", kind.alias("type")).alias("e"))
         .where("o_custkey is not null and version is not null"))
    # the nodes of a document are the ends of its own edges: no second grouping
    ends = F.filter(F.concat(F.col("es")["source"], F.col("es")["target"]), lambda x: x.isNotNull())
    docs = (e.groupBy(*g).agg(F.array_sort(F.collect_set("e")).alias("es"))
            .withColumn("ns", F.array_sort(F.array_distinct(ends))))
    text = lambda x: x.cast("string")
    as_node = F.transform("ns", lambda i: F.struct(
        text(i).alias("id"), F.concat(F.lit("P"), text(i)).alias("name"), F.when(i % 2 == 0, "class").otherwise("file").alias("type"),
        F.concat(F.lit("src/"), text(i)).alias("filePath"),
        F.struct((i % 100).alias("loc"), (i % 7).alias("complexity"), (i % 10).alias("coupling"),
                 (i % 5).alias("inheritanceDepth")).alias("metrics")))
    as_edge = F.transform("es", lambda x: F.struct(text(x["source"]).alias("source"), text(x["target"]).alias("target"), x["type"].alias("type")))
    total = F.aggregate("ns", F.lit(0).cast("bigint"), lambda a, i: a + i % 100)
    return docs.select(
        F.col("o_custkey").alias("key"), F.concat(F.lit("c"), text(F.col("o_custkey"))).alias("projectName"), "version",
        F.lit("Java").alias("language"), F.concat(F.substring("version", 2, 4), F.lit("-12-31T00:00:00")).alias("extractedAt"),
        F.struct(total.alias("totalLinesOfCode"), F.size("ns").cast("bigint").alias("totalClasses"),
                 F.lit(None).cast("double").alias("averageCoupling")).alias("systemMetrics"),
        as_node.alias("nodes"), as_edge.alias("edges"))


def dep_nodes(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    """Declared nodes: distinct endpoints joined to ``part``; ``id % 50 = 7`` left implicit."""
    edges = edges if edges is not None else dep_edges(spark, sf_dir)
    ends = (edges.select("project", "version",
                         F.explode(F.array("source", "target")).alias("id"))
            .where(F.col("id") % 50 != 7)
            .distinct())
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    return (ends.join(part, ends.id == part.p_partkey)
            .select("project", "version", "id",
                    F.col("p_name").alias("name"),
                    F.when(F.col("id") % 2 == 0, "class").otherwise("file").alias("type"),
                    F.concat(F.lit("src/"), "p_type", F.lit("/"), "p_name").alias("file_path"),
                    F.col("p_size").cast("bigint").alias("loc"),
                    (F.col("id") % 7).alias("complexity"),
                    F.when(F.col("id") % 4 == 0, F.lit(None).cast("bigint"))
                     .otherwise((F.col("p_size") % 10).cast("bigint")).alias("coupling"),
                    F.when(F.col("id") % 13 == 0, F.lit(None).cast("bigint"))
                     .otherwise(F.col("id") % 5).alias("inheritance_depth"),
                    F.col("id").alias("ord")))


def dep_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = dep_edges(spark, sf_dir)
    return dep_nodes(spark, sf_dir, edges), edges


def dep_transitions(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    """One transition ``v1 -> v2`` per project that has edges in both versions."""
    edges = edges if edges is not None else dep_edges(spark, sf_dir)
    from evograph.operators.graph import transitions_from_versions
    return transitions_from_versions(edges.select("project", "version").distinct())


def dep_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inheritance from ``part``: NULL = no parent, -1 = external parent."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    return part.select(
        k.alias("id"),
        F.when(k % 5 == 0, F.lit(None).cast("bigint"))
         .when(k % 7 == 0, F.lit(-1).cast("bigint"))
         .otherwise(F.floor(k / 2).cast("bigint")).alias("parent"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository queue from ``orders`` (owner = customer, repo = order).

    The graph transition of a row is (``o_orderpriority``, v1, v2); the
    extraction ran from the order date to the last ship date of its lines.
    """
    o = table(spark, sf_dir, "orders")
    last_ship = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
                 .agg(F.max("l_shipdate").alias("last_ship")))
    k = F.col("o_orderkey")
    status = (F.when(F.col("o_orderstatus") == "P", "pending")
               .when(F.col("o_orderstatus") == "O", "processing")
               .when(F.col("o_orderstatus") == "F", "crawled"))
    return o.join(last_ship, o.o_orderkey == last_ship.l_orderkey, "left").select(
        F.col("o_custkey").cast("string").alias("owner"),
        k.cast("string").alias("repo"),
        F.col("o_totalprice").cast("bigint").alias("stars"),
        F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (F.col("o_custkey") % 6 + 1).cast("int"))
         .alias("language"),
        F.lit("v1").alias("tag1"), F.lit("v2").alias("tag2"),
        status.alias("status"),
        F.when((F.col("o_orderstatus") == "O") & (k % 11 != 0), F.col("o_orderdate")).alias("claimed_at"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("w"), (k % 4).cast("string")))
         .alias("worker_id"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("processed_at"),
        F.col("o_orderdate").alias("extraction_start_at"),
        F.col("last_ship").alias("extraction_end_at"),
        F.when(k % 3 == 0, F.lit(None).cast("bigint"))
         .otherwise((k % 1000).cast("bigint")).alias("loc_v1"),
        k.alias("repo_key"),
        F.col("o_orderpriority").alias("graph_project"),
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker heartbeats: one per line of an order, at its ship date."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").cast("string").alias("owner"), F.col("o_orderkey").cast("string").alias("repo"),
        F.col("l_shipdate").alias("ts"))


def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished work: every processing row ends crawled, or failed when it has no LOC."""
    inv = inventory(spark, sf_dir).where(F.col("status") == "processing")
    return inv.select("owner", "repo",
                      F.when(F.col("loc_v1").isNull(), "failed").otherwise("crawled").alias("status"),
                      F.when(F.col("loc_v1").isNull(), F.lit("Validation failed")).alias("error_msg"),
                      F.col("extraction_end_at").alias("ts"), "worker_id")


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status log from ``events``: repo = user, to_status = event type (a view is ``processing``)."""
    from evograph.operators.graph import previous_value
    kind = F.when(F.col("event_type") == "view", "processing").otherwise(F.col("event_type"))
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", kind.alias("event_type"))
    # lag per user, computed per (user, day) so a very active user is not sorted in one task
    ev = previous_value(ev, ["user_id"], "ts", "event_id", "event_type", F.to_date("ts"), "from_status")
    return ev.select(
        F.lit("o").alias("owner"),
        F.col("user_id").cast("string").alias("repo"),
        "from_status",
        F.col("event_type").alias("to_status"),
        F.col("ts").alias("transitioned_at"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("error "), F.col("event_id").cast("string")))
         .alias("error_msg"),
        F.concat(F.lit("w"), (F.col("user_id") % 4).cast("string")).alias("worker_id"),
        "event_id", F.col("user_id").alias("repo_key"))


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results: customers (many rows per (owner, repo)) plus a re-discovery of every
    crawled repository with its current star count; ``seq`` is the discovery order."""
    c = table(spark, sf_dir, "customer")
    fresh = c.select(
        F.col("c_nationkey").cast("string").alias("owner"),
        F.col("c_mktsegment").alias("repo"),
        F.col("c_acctbal").cast("bigint").alias("stars"),
        F.lit("Java").alias("language"),
        F.col("c_custkey").alias("seq"))
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    again = o.select(
        F.col("o_custkey").cast("string").alias("owner"), F.col("o_orderkey").cast("string").alias("repo"),
        (F.col("o_totalprice") * 2).cast("bigint").alias("stars"), F.lit("Java").alias("language"),
        (F.col("o_orderkey") + 1000000000).alias("seq"))
    return fresh.unionByName(again)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text corpus ``(project, version, path, language, content, n_bytes)`` from ``documents``."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("project"),
        F.lit("v1").alias("version"),
        F.concat(F.when(F.col("doc_id") % 10 == 3, F.lit("build/")).otherwise(F.lit("")),
                 "lang", F.lit("/"), F.col("doc_id").cast("string"),
                 F.element_at(F.array(*[F.lit(x) for x in FILE_EXTENSIONS]),
                              (F.col("doc_id") % len(FILE_EXTENSIONS) + 1).cast("int"))).alias("path"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.col("doc_id"))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static-analysis findings from returned lines (basename = part name)."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_linestatus", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .select(F.col("p_name").alias("basename"),
                    F.col("l_linestatus").alias("rule"),
                    F.lit("fixture").alias("ruleset"),
                    F.col("l_linenumber").alias("priority"),
                    F.col("l_quantity").cast("int").alias("begin_line"),
                    F.concat(F.lit("line "), F.col("l_orderkey").cast("string")).alias("message"),
                    (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("report_ord")))


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Java source corpus generated from ``part`` by a fixed rule, one file per part.

    Part ``k`` of brand ``m`` becomes class ``N{k div 7}`` in package
    ``com.p{k mod 7}`` of project ``m`` (simple names repeat across packages,
    so resolution needs imports); its parent follows the inheritance rule of
    :func:`dep_parents`; it references parts ``k+1``, ``k+2`` and ``k+7``
    through fields, comments, explicit and wildcard imports; some files add
    a nested class, a record, a sealed interface, block comments, tab
    indentation or CRLF line ends.
    """
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    k = F.col("p_partkey")

    def name(x):
        return F.concat(F.lit("N"), F.floor(x / 7).cast("bigint").cast("string"))

    def pkg(x):
        return F.concat(F.lit("com.p"), (x % 7).cast("string"))

    s = lambda x: x.cast("string")
    par = F.floor(k / 2).cast("bigint")
    extends = (F.when(k % 5 == 0, F.lit(""))
               .when(k % 7 == 0, F.lit(" extends RuntimeException"))
               .otherwise(F.concat(F.lit(" extends "), name(par))))
    body = F.when(k % 2 == 0, F.lit("        if (a > b && b > 0) { for (int i = 0; i < a; i++) { a--; } }")) \
        .otherwise(F.lit("        while (a > 0 || b > 0) { a--; b--; }"))
    lines = F.array(
        F.concat(F.lit("package "), pkg(k), F.lit(";")),
        F.lit(""),
        F.when(k % 3 == 0, F.concat(F.lit("import "), pkg(k + 1), F.lit("."), name(k + 1), F.lit(";")))
         .when(k % 3 == 1, F.concat(F.lit("import "), pkg(k + 1), F.lit(".*;")))
         .otherwise(F.lit("import static java.util.Collections.emptyList;")),
        F.when(k % 4 == 0, F.concat(F.lit("import "), pkg(par), F.lit("."), name(par), F.lit(";"))).otherwise(F.lit("")),
        F.lit(""),
        F.when(k % 6 == 0, F.lit("/* block comment: if for while */"))
         .otherwise(F.concat(F.lit("// helper for "), name(k + 2))),
        F.when(k % 9 == 0, F.lit("\t// tab indented comment")).otherwise(F.lit("  ")),
        F.concat(F.lit("public class "), name(k), extends, F.lit(" {")),
        F.concat(F.lit("    private "), name(k + 1), F.lit(" next;")),
        F.lit("    void run(int a, int b) {"),
        body,
        F.lit("    }"),
        F.when(k % 4 == 1, F.concat(F.lit("    static class Inner"), s(k % 3), F.lit(" { }"))).otherwise(F.lit("")),
        F.lit("}"),
        F.when(k % 11 == 0, F.concat(F.lit("record R"), s(k), F.lit("("), name(k + 7),
                                      F.lit(" left, java.util.List<String> names) { }"))).otherwise(F.lit("")),
        F.when(k % 13 == 0, F.concat(F.lit("sealed interface S"), s(k), F.lit(" permits "), name(k), F.lit(", "),
                                      name(k + 7), F.lit(" { }"))).otherwise(F.lit("")),
    )
    sep = F.when(k % 17 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    return p.select(
        F.col("p_brand").alias("project"), F.lit("v1").alias("version"),
        F.concat(F.lit("src/com/p"), s(k % 7), F.lit("/"), name(k), F.lit("_"), s(k), F.lit(".java")).alias("path"),
        F.lit("Java").alias("language"),
        F.array_join(lines, "\n").alias("_c"), sep.alias("_sep")
    ).select("project", "version", "path", "language",
             F.regexp_replace("_c", "\n", F.col("_sep")).alias("content")) \
        .withColumn("n_bytes", F.octet_length("content").cast("bigint"))


def java_scope_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`java_files` with one more type per file, ``U{k}``: it holds two levels of nested types and refers to nested types of
    its own, of part ``k+1`` and of part ``k+4`` (imported by even parts), and names others in a comment and a literal only."""
    f = java_files(spark, sf_dir)
    k = F.regexp_extract("path", r"_(\d+)\.java$", 1).cast("bigint")
    s = lambda x: x.cast("string")
    fourth = F.concat(F.lit("U"), s(k + 4), F.lit(".Deep"), s((k + 4) % 3))
    more = F.concat(
        F.lit("\nclass U"), s(k), F.lit(" {\n    N"), s(F.floor((k + 1) / 7).cast("bigint")), F.lit(".Inner"), s((k + 1) % 3),
        F.lit(" part; // N"), s(F.floor(k / 7).cast("bigint")), F.lit(".Inner0 {\n    static class Deep"), s(k % 3),
        F.lit(" { class Deeper { } }\n    Deep"), s(k % 3), F.lit(" own; "), fourth,
        F.lit(" other;\n    String s = \"class Fake { U7.Deep1 }\";\n}\n"),
        F.when(k % 2 == 0, F.concat(F.lit("import com.p"), s((k + 4) % 7), F.lit(".U"), s(k + 4), F.lit(";\n"))).otherwise(F.lit("")))
    return f.withColumn("content", F.concat("content", more)).withColumn("n_bytes", F.octet_length("content").cast("bigint"))


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python corpus generated from ``part``: module ``pkg{k mod 7}/m{k div 7}.py`` of
    project ``p_brand`` imports the modules of parts ``k+1`` (``import``) and
    ``k+2`` (``from .. import``) and mentions the module name of part ``k+3``."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    k = F.col("p_partkey")

    def mod(x):
        return F.concat(F.lit("pkg"), (x % 7).cast("string"), F.lit("."), F.lit("m"),
                        F.floor(x / 7).cast("bigint").cast("string"))

    def base(x):
        return F.concat(F.lit("m"), F.floor(x / 7).cast("bigint").cast("string"))

    content = F.concat_ws(
        "\n",
        F.concat(F.lit("import "), mod(k + 1)),
        F.concat(F.lit("from "), mod(k + 2), F.lit(" import thing")),
        F.lit("# comment line"),
        F.lit(""),
        F.lit("def run(a, b):"),
        F.when(k % 2 == 0, F.lit("    if a and b or a && b:")).otherwise(F.lit("    while a || b:")),
        F.concat(F.lit("        return "), base(k + 3), F.lit(".value")),
        F.lit("    // trailing"))
    return p.select(
        F.col("p_brand").alias("project"), F.lit("v1").alias("version"),
        F.concat(F.lit("src/pkg"), (k % 7).cast("string"), F.lit("/"), base(k), F.lit(".py")).alias("path"),
        F.lit("Python").alias("language"), content.alias("content"))
