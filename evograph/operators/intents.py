"""INT-*: intent conformance, conflict resolution and report rendering.

Intents are a small user-supplied parameter (a list of texts or
``{intent_id, kind, text, limit}`` dicts), so they become literal column
expressions: no cross join with a table is needed.  Reports are produced in
long form (one row per line, ordered by ``(sec, sub, k1, k2)``), so a large
anomaly list never has to be collected into one row; :func:`report_text`
assembles the document when a single string is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evograph.session import materialize

T = ["project", "v_old", "v_new"]

# ---------------------------------------------------------------------------
# Report and message wording that must equal the reference
# output character for character.
TITLE_PREFIX = "Architectural Evolution Report (Version "
RULE = "=" * 59
SEC1 = "1. Structural Changes:"
ADDED_NODES = "   * Added Nodes: "
ADDED_EDGES = "   * Added Dependencies (Edges): "
REMOVED_NODES = "   * Removed Nodes: "
REMOVED_EDGES = "   * Removed Dependencies (Edges): "
SEC2 = "2. Dependency Cycles:"
NEW_CYCLES = "   * New Cycles Detected: "
BROKEN_CYCLES = "   * Broken Cycles: "
SEC3 = "3. Coupling & Complexity Hubs:"
HUBS = "   * Top Coupled Nodes in New Version: "
ANOMALIES_HEAD = "   * Outlier Coupling Anomalies Detected:"
NO_ANOMALIES = "   * Coupling Anomalies: None (all nodes within standard variance)"
SEC4 = "4. Intent Conformance Evaluation:"
ALL_SATISFIED = "   * All intents successfully satisfied. No modularity or cycle violations detected."
SEC5 = "5. Intent Conflict Resolution Log:"
SEC6 = "6. Recommendations:"
REC_CYCLES = "   * Action required: Break the newly introduced dependency cycle(s) to preserve modular boundaries."
REC_CLEAN = "   * Codebase structure is clean. Modularity is preserved."
CYCLE_VIOLATION = ("VIOLATION: New cyclic dependencies detected ({n} new cycles). "
                   "This breaches the intent to '{intent}'.")
CHANGE_VIOLATION = ("VIOLATION: High volume of changes detected (added {nodes} nodes, {edges} edges). "
                    "This breaches the intent to '{intent}'.")
CONFLICT_LINES = [
    "Conflict detected: The intent to 'Avoid cyclic dependencies' requires refactoring actions "
    "(adding/removing classes), which contradicts the intent to 'Minimize changes and complexity increase'.",
    "Resolution: Prioritized cycle prevention (Priority 1) over change minimization (Priority 3). "
    "The system recommends proceeding with refactoring to eliminate circular dependencies.",
]
RESOLVED = "RESOLVED: Overrode 'Minimize changes' to allow structural refactoring for cycle removal."
# Keyword tests on lower-cased intent text.
CYCLE_RULE_KEY = "avoid cyclic"
CHANGE_RULE_KEY = "minimize changes"
CYCLE_INTENT_KEYS = ("cycle", "cyclic")
STABILITY_INTENT_KEYS = ("minimize changes", "stability")
CHANGE_NODE_LIMIT = 10
CHANGE_EDGE_LIMIT = 20
# Structured intent kinds and their default limits.
LIMIT_KINDS = {"max-coupling": ("coupling", 5), "max-inheritance": ("inheritance_depth", 3)}
# Language wording (unit singular, unit plural, cycle term, dependency term, fallback).
LANGUAGE_TERMS = [
    ("Java", "class", "classes", "cycle loops", "edges", False),
    ("Python", "module", "modules", "circular imports", "dependencies", False),
]
OTHER_LANGUAGE_TERMS = ("file", "files", "dependency cycles", "imports", True)
# ---------------------------------------------------------------------------


def normalize_intents(intents) -> list[dict]:
    out = []
    for i, it in enumerate(intents, start=1):
        if isinstance(it, str):
            out.append({"intent_id": i, "kind": "text", "text": it, "limit": None})
        else:
            d = dict(it)
            d.setdefault("intent_id", i)
            d.setdefault("kind", "text")
            d.setdefault("limit", None)
            out.append(d)
    return out


ROW_TYPE = "array<struct<sec:int,sub:int,k1:boolean,k2:bigint,line:string>>"


def intents_column(intents) -> Column:
    """Literal ``array<string>`` of intent texts, in the given order."""
    return F.array(*[F.lit(it["text"]) for it in normalize_intents(intents)]).cast("array<string>")


def intent_violations(summary: DataFrame, intents=None, resolve: bool = True,
                      intents_col: str | None = None) -> DataFrame:
    """INT-01 (+ INT-03 when ``resolve``): ``violations`` and ``conflicts`` arrays per transition.

    ``summary`` carries the DIF-05 counts.  Intents come either from the
    Python list ``intents`` or from an ``array<string>`` column ``intents_col``
    (payload form, INT-08).  Each intent is checked in order, cycle rule first.
    """
    its = F.col(intents_col) if intents_col else intents_column(intents)
    # the exact verdict, where the summary has it; a cycle too long for the listing counts as one
    new_cycle = F.col("has_new_cycle") if "has_new_cycle" in summary.columns else F.col("new_cycles") > 0
    n_cycles = F.greatest("new_cycles", F.lit(1))
    head, tail = CYCLE_VIOLATION.split("{n}")
    c_head, c_rest = CHANGE_VIOLATION.split("{nodes}")
    c_mid, c_tail = c_rest.split("{edges}")
    t_pre, t_post = tail.split("{intent}")
    ct_pre, ct_post = c_tail.split("{intent}")

    def per_intent(t):
        low = F.lower(t)
        cyc = F.when(low.contains(CYCLE_RULE_KEY) & new_cycle, F.concat(
            F.lit(head), n_cycles.cast("string"), F.lit(t_pre), t, F.lit(t_post)))
        chg = F.when(low.contains(CHANGE_RULE_KEY)
                     & ((F.col("added_nodes") > CHANGE_NODE_LIMIT) | (F.col("added_edges") > CHANGE_EDGE_LIMIT)),
                     F.concat(F.lit(c_head), F.col("added_nodes").cast("string"), F.lit(c_mid),
                              F.col("added_edges").cast("string"), F.lit(ct_pre), t, F.lit(ct_post)))
        return F.array(cyc, chg)

    viol = F.filter(F.flatten(F.transform(its, per_intent)), lambda x: x.isNotNull())
    cycle_intent = F.exists(its, lambda t: F.lower(t).contains(CYCLE_INTENT_KEYS[0])
                            | F.lower(t).contains(CYCLE_INTENT_KEYS[1]))
    stability = F.exists(its, lambda t: F.lower(t).contains(STABILITY_INTENT_KEYS[0])
                         | F.lower(t).contains(STABILITY_INTENT_KEYS[1]))
    conflict = F.lit(resolve) & cycle_intent & stability & new_cycle
    resolved = F.concat(F.filter(viol, lambda v: ~F.lower(v).contains(CHANGE_RULE_KEY)),
                        F.array(F.lit(RESOLVED)))
    empty = F.array().cast("array<string>")
    return summary.select(
        "*",
        F.when(conflict, resolved).otherwise(viol).alias("violations"),
        F.when(conflict, F.array(*[F.lit(x) for x in CONFLICT_LINES])).otherwise(empty).alias("conflicts"))


def limit_violations(nodes: DataFrame, transitions: DataFrame, intents) -> DataFrame:
    """INT-02: nodes of the new version above a structured intent's limit (missing metric = 0)."""
    its = [it for it in normalize_intents(intents) if it["kind"] in LIMIT_KINDS]
    newv = nodes.join(transitions.select("project", F.col("v_new").alias("version"), "v_old"),
                      ["project", "version"]).withColumnRenamed("version", "v_new")
    parts = []
    for it in its:
        metric, default = LIMIT_KINDS[it["kind"]]
        limit = it["limit"] if it["limit"] is not None else default
        parts.append(newv.where(F.coalesce(F.col(metric), F.lit(0)) > limit).select(
            *T, F.lit(it["intent_id"]).alias("intent_id"), F.lit(it["kind"]).alias("kind"),
            F.lit(limit).alias("limit"), "id", F.coalesce(F.col(metric), F.lit(0)).alias("value")))
    if not parts:
        return newv.limit(0).select(*T, F.lit(0).alias("intent_id"), F.lit("").alias("kind"),
                                    F.lit(0).alias("limit"), "id", F.lit(0).alias("value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def intent_status(df: DataFrame) -> DataFrame:
    """INT-05: VIOLATION when a violation line is present, else CONFORMING."""
    v = F.exists("violations", lambda x: x.startswith("VIOLATION"))
    return df.withColumn("intent_status", F.when(v, "VIOLATION").otherwise("CONFORMING"))


def dashboard_status(summary: DataFrame, limit_rows: DataFrame, intents) -> DataFrame:
    """INT-05 dashboard form: NON-CONFORMANT on new cycles under a no-cycles intent or
    any coupling-limit offender."""
    its = normalize_intents(intents)
    no_cycles = any(it["kind"] == "no-cycles" for it in its)
    off = (limit_rows.where(F.col("kind") == "max-coupling").groupBy(*T)
           .agg(F.count(F.lit(1)).alias("n_over")))
    s = summary.join(off, T, "left")
    new_cycle = F.col("has_new_cycle") if "has_new_cycle" in summary.columns else F.col("new_cycles") > 0
    bad = (F.lit(no_cycles) & new_cycle) | (F.coalesce("n_over", F.lit(0)) > 0)
    return s.withColumn("conformance", F.when(bad, "NON-CONFORMANT").otherwise("CONFORMANT")).drop("n_over")


def _new_cycle(df: DataFrame) -> Column:
    """The exact verdict where ``df`` has it, else that of the listed cycles."""
    return F.coalesce("has_new_cycle", F.col("new_cycles") > 0) if "has_new_cycle" in df.columns else F.col("new_cycles") > 0


def benchmark_status(df: DataFrame, rule: str = "a") -> DataFrame:
    """INT-06: rule a = more cycles or class growth > 100; rule b = new cycles or added nodes > 100.

    Rule b reads the exact ``has_new_cycle`` where ``df`` has it. Rule a compares the counts of listed cycles, which
    hold up to the ``length_bound`` of the rows."""
    if rule == "a":
        bad = (F.col("cycles_v2") > F.col("cycles_v1")) | (F.col("classes_v2") - F.col("classes_v1") > 100)
    else:
        bad = _new_cycle(df) | (F.col("added_nodes") > 100)
    return df.withColumn("status", F.when(bad, "Violation").otherwise("Satisfied"))


def python_float_str(c: Column) -> Column:
    """Text of ``round(x, 2)`` as Python prints it (2.675 -> 2.67, 3.0 -> 3.0)."""
    return F.call_function("format_number", c, F.lit("0.00")).cast("double").cast("string")


def report_lines(judged: DataFrame, hubs: DataFrame, anomalies: DataFrame) -> DataFrame:
    """INT-04: sectioned report, one row per line.

    ``judged``: DIF-05 counts + ``violations``/``conflicts`` (INT-01/03) per transition.
    ``hubs``: MET-04 rows of the new versions; ``anomalies``: MET-05 rows (with
    ``z_raw``) of the new versions.  Output ``(project, v_old, v_new, sec, sub, k1, k2, line)``.
    """
    def row(sec, sub, text, k1=F.lit(False), k2=F.lit(0).cast("bigint")):
        return F.struct(F.lit(sec).alias("sec"), F.lit(sub).alias("sub"), k1.alias("k1"),
                        k2.cast("bigint").alias("k2"), text.alias("line"))

    L = F.lit
    n_anom = F.coalesce(F.col("n_anom"), L(0))
    hub_names = (hubs.groupBy("project", F.col("version").alias("v_new"))
                 .agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id"))))
                      .alias("h"))
                 .select("project", "v_new", F.array_join(F.transform("h", lambda x: x["id"]), ", ").alias("hubs")))
    anom_n = anomalies.groupBy("project", F.col("version").alias("v_new")).agg(
        F.count(F.lit(1)).alias("n_anom"))
    j = (judged.join(hub_names, ["project", "v_new"], "left").join(anom_n, ["project", "v_new"], "left")
         .withColumn("hubs", F.coalesce("hubs", L(""))))
    s = lambda c: F.col(c).cast("string")
    fixed = F.array(
        row(0, 0, F.concat(L(TITLE_PREFIX), F.col("v_old"), L(" -> "), F.col("v_new"), L(")"))),
        row(0, 1, L(RULE)),
        row(1, 0, L(SEC1)),
        row(1, 1, F.concat(L(ADDED_NODES), s("added_nodes"))),
        row(1, 2, F.concat(L(ADDED_EDGES), s("added_edges"))),
        row(1, 3, F.concat(L(REMOVED_NODES), s("removed_nodes"))),
        row(1, 4, F.concat(L(REMOVED_EDGES), s("removed_edges"))),
        row(1, 5, L("")),
        row(2, 0, L(SEC2)),
        row(2, 1, F.concat(L(NEW_CYCLES), s("new_cycles"))),
        row(2, 2, F.concat(L(BROKEN_CYCLES), s("broken_cycles"))),
        row(2, 3, L("")),
        row(3, 0, L(SEC3)),
        row(3, 1, F.concat(L(HUBS), F.col("hubs"))),
        row(3, 2, F.when(n_anom > 0, L(ANOMALIES_HEAD)).otherwise(L(NO_ANOMALIES))),
        row(3, 9, L("")),
        row(4, 0, L(SEC4)),
        row(6, 0, L("")),
        row(6, 1, L(SEC6)),
        row(6, 2, F.when(_new_cycle(judged), L(REC_CYCLES)).otherwise(L(REC_CLEAN))),
    )
    viol = F.when(F.size("violations") > 0,
                  F.transform("violations", lambda v, i: row(4, 1, F.concat(L("   * "), v), k2=i)))\
        .otherwise(F.array(row(4, 1, L(ALL_SATISFIED))))
    conf = F.when(F.size("conflicts") > 0, F.concat(
        F.array(row(5, 0, L("")), row(5, 1, L(SEC5))),
        F.transform("conflicts", lambda v, i: row(5, 2, F.concat(L("   * "), v), k2=i))))\
        .otherwise(F.array().cast(ROW_TYPE))
    base = (j.select(*T, F.explode(F.concat(fixed, viol, conf)).alias("r"))
            .select(*T, "r.*"))
    an = anomalies.select(
        "project", F.col("version").alias("v_new"), F.lit(3).alias("sec"), F.lit(3).alias("sub"),
        F.col("implicit").alias("k1"), F.col("ord").cast("bigint").alias("k2"),
        F.concat(L("     - "), F.col("id").cast("string"), L(" (coupling: "), F.col("coupling").cast("string"),
                 L(", Z-score: "), python_float_str(F.col("z_raw")), L(")")).alias("line"))
    an = an.join(judged.select(*T), ["project", "v_new"])
    return base.unionByName(an.select(*T, "sec", "sub", "k1", "k2", "line"))


def report_text(lines: DataFrame) -> DataFrame:
    """Assemble the long-form report into one string per transition (ends with a newline)."""
    return (lines.groupBy(*T)
            .agg(F.array_sort(F.collect_list(F.struct("sec", "sub", "k1", "k2", "line"))).alias("ls"))
            .select(*T, F.concat(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n"))
                    .alias("report")))


def language_terms(df: DataFrame, lang_col: str = "language") -> DataFrame:
    """INT-09: unit and cycle wording by language (literal lookup, fixed size)."""
    spark = df.sparkSession
    terms = spark.createDataFrame(
        [(lang, *rest) for lang, *rest in LANGUAGE_TERMS],
        "term_language string, unit_singular string, unit_plural string, cycle_term string, "
        "dep_term string, is_fallback boolean")
    j = df.join(F.broadcast(terms), F.col(lang_col) == F.col("term_language"), "left")
    o = OTHER_LANGUAGE_TERMS
    return j.select(
        *[F.col(c) for c in df.columns],
        F.coalesce("unit_singular", F.lit(o[0])).alias("unit_singular"),
        F.coalesce("unit_plural", F.lit(o[1])).alias("unit_plural"),
        F.coalesce("cycle_term", F.lit(o[2])).alias("cycle_term"),
        F.coalesce("dep_term", F.lit(o[3])).alias("dep_term"),
        F.coalesce("is_fallback", F.lit(o[4])).alias("is_fallback"))


PAYLOAD_SCHEMA = (
    "diff struct<version_old:string, version_new:string, addedNodes:bigint, removedNodes:bigint, "
    "addedEdges:bigint, removedEdges:bigint, newCycles:bigint, brokenCycles:bigint, hasNewCycle:boolean>, "
    "metrics struct<topHubs:array<string>>, intents array<string>")
DEFAULT_PAYLOAD_INTENTS = ["avoid cyclic dependencies"]


def payload_summary(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """INT-08: parse an externally computed diff/metrics JSON with the documented defaults. Without ``hasNewCycle``
    the number of new cycles decides."""
    p = payloads.withColumn("_p", F.from_json(F.col(json_col), PAYLOAD_SCHEMA))
    d = lambda f, dflt: F.coalesce(F.col(f"_p.diff.{f}"), F.lit(dflt))
    return p.select(
        *[c for c in payloads.columns if c != json_col],
        d("version_old", "v1").alias("v_old"), d("version_new", "v2").alias("v_new"),
        d("addedNodes", 0).alias("added_nodes"), d("removedNodes", 0).alias("removed_nodes"),
        d("addedEdges", 0).alias("added_edges"), d("removedEdges", 0).alias("removed_edges"),
        d("newCycles", 0).alias("new_cycles"), d("brokenCycles", 0).alias("broken_cycles"),
        F.coalesce(F.col("_p.diff.hasNewCycle"), F.coalesce(F.col("_p.diff.newCycles"), F.lit(0)) > 0).alias("has_new_cycle"),
        F.coalesce(F.col("_p.metrics.topHubs"), F.array().cast("array<string>")).alias("top_hubs"),
        F.coalesce(F.col("_p.intents"), F.array(*[F.lit(x) for x in DEFAULT_PAYLOAD_INTENTS])).alias("intents"))


# Analysis prompt wording.
PROMPT_HEAD = ("Please analyze the following software architecture evolution and evaluate conformance "
               "to the specified intents.\n\nIntents:\n")
PROMPT_TAIL = ("Generate a report with the following structure:\n1. Structural Changes\n"
               "2. Dependency Cycles\n3. Coupling & Complexity Hubs\n"
               "4. Intent Conformance Evaluation (mark clearly as VIOLATION if any intent is breached)\n"
               "5. Recommendations")


def _py_repr(c: Column, dtype: str) -> Column:
    """Python ``repr`` of an id: numbers as is, strings single-quoted."""
    return c.cast("string") if dtype in ("bigint", "int", "smallint", "tinyint") \
        else F.concat(F.lit("'"), c.cast("string"), F.lit("'"))


#: Items of a prompt's lists that are sorted and joined to text as one piece.
LIST_PIECE = 100_000


def analysis_prompt(nodes: DataFrame, edges: DataFrame, transitions: DataFrame, intents,
                    max_len: int = 5, cycle_changes: DataFrame | None = None, summary: DataFrame | None = None,
                    hubs: DataFrame | None = None) -> DataFrame:
    """INT-07: prompt text per transition for a downstream batch scorer.

    The id lists are ordered (node order for nodes, (source, target) for edges, canonical string for cycles); the text
    grows with the diff, as the original prompt does. The items of all lists are dealt out by ranges of that order, a range
    becomes text on its own, and only these texts are collected per transition: beside its text a task never holds more than
    about LIST_PIECE items. A caller that has the counts (``summary`` with those of :func:`diff.diff_summary`, written) or the
    ``hubs`` of the new versions (three each) hands them on.
    """
    from evograph.operators import cycles, diff, metrics
    from evograph.operators.graph import all_nodes
    dt = dict(nodes.dtypes)["id"]
    nm = diff.node_membership(nodes, edges, transitions)
    em = diff.edge_membership(edges, transitions)
    # three branches read the changes: written once, or handed on by a caller that has them
    cc = materialize(cycles.cycle_changes(edges, transitions, max_len), "cycle-changes") if cycle_changes is None else cycle_changes
    allv = all_nodes(nodes, edges)
    pos = lambda side: (allv.withColumnRenamed("version", side)
                        .select("project", side, "id", "implicit", "ord"))
    lists = ("an", "rn", "ae", "re", "nc", "bc")

    def items(df, k, x, implicit=None, ord_=None, a=None, b=None, text=None):
        """The items of list ``k``: its typed order and the text ``x``; what does not order the list is null."""
        none = F.lit(None)
        order = F.struct((none if implicit is None else F.col(implicit)).cast("boolean").alias("implicit"),
                         (none if ord_ is None else F.col(ord_)).cast(dict(allv.dtypes)["ord"]).alias("ord"),
                         (none if a is None else F.col(a)).cast(dt).alias("a"), (none if b is None else F.col(b)).cast(dt).alias("b"),
                         (none if text is None else F.col(text)).cast("string").alias("text"))
        return df.select(*T, F.lit(lists.index(k)).alias("k"), order.alias("o"), x.alias("x"))

    def node_list(m, side, k):
        return items(nm.where(F.col("m") == m).join(pos(side), ["project", side, "id"]), k, _py_repr(F.col("id"), dt),
                     implicit="implicit", ord_="ord")

    def edge_list(m, k):
        x = F.concat(F.lit("("), _py_repr(F.col("source"), dt), F.lit(", "), _py_repr(F.col("target"), dt), F.lit(")"))
        return items(em.where(F.col("m") == m), k, x, a="source", b="target")

    def cyc_list(ch, k):
        x = F.concat(F.lit("["), F.array_join(F.transform("cycle", lambda v: _py_repr(v, dt)), ", "), F.lit("]"))
        return items(cc.where(F.col("change") == ch), k, x, text="cycle_str")

    every = (node_list(2, "v_new", "an").unionByName(node_list(1, "v_old", "rn"))
             .unionByName(edge_list(2, "ae")).unionByName(edge_list(1, "re"))
             .unionByName(cyc_list("new", "nc")).unionByName(cyc_list("broken", "bc")))
    counted = ["added_nodes", "removed_nodes", "added_edges", "removed_edges", "new_cycles", "broken_cycles"]
    if summary is None:
        summary = cycles.cut_lineage(diff.diff_summary(nodes, edges, transitions, cc), "prompt-summary")
    n = summary.agg(F.sum(sum((F.col(c) for c in counted), F.lit(0)))).first()[0] or 0
    ranges = every.repartitionByRange(max(1, -(-n // LIST_PIECE)), *T, "k", "o").withColumn("piece", F.spark_partition_id())
    pieces = (ranges.groupBy(*T, "k", "piece").agg(F.array_sort(F.collect_list(F.struct("o", "x"))).alias("l"))
              .select(*T, "k", "piece", F.array_join(F.transform("l", lambda e: e["x"]), ", ").alias("txt")))
    piv = pieces.groupBy(*T).agg(F.array_sort(F.collect_list(F.struct("k", "piece", "txt"))).alias("l"))
    if hubs is None:
        new = transitions.select("project", F.col("v_new").alias("version"))
        hubs = metrics.top_hubs(nodes.join(new, ["project", "version"], "left_semi"), edges.join(new, ["project", "version"], "left_semi"))
    hubs = (hubs.groupBy("project", F.col("version").alias("v_new"))
            .agg(F.array_sort(F.collect_list(F.struct("rank", "id", "centrality"))).alias("h"))
            .select("project", "v_new", F.concat(F.lit("["), F.array_join(F.transform("h", lambda x: F.concat(
                F.lit('{"id": '), F.to_json(F.array(x["id"])).substr(F.lit(2), F.length(F.to_json(F.array(x["id"]))) - 2),
                F.lit(', "centrality": '), x["centrality"].cast("string"), F.lit("}"))), ", "), F.lit("]")).alias("hubs_json")))
    intent_lines = "\n".join(f"- {i['text']}" for i in normalize_intents(intents)) + "\n\n"
    j = summary.join(piv, T, "left").join(hubs, ["project", "v_new"], "left")

    def cnt(label, c, k):
        own = F.transform(F.filter("l", lambda e: e["k"] == lists.index(k)), lambda e: e["txt"])
        return [F.lit(f"- {label} Count: "), F.col(c).cast("string"), F.lit(" (["), F.coalesce(F.array_join(own, ", "), F.lit("")),
                F.lit("])\n")]

    text = F.concat(
        F.lit(PROMPT_HEAD + intent_lines + "Structural Diff Report:\n- Version: "), F.col("v_old"), F.lit(" -> "),
        F.col("v_new"), F.lit("\n"),
        *cnt("Added Nodes", "added_nodes", "an"), *cnt("Removed Nodes", "removed_nodes", "rn"),
        *cnt("Added Edges", "added_edges", "ae"), *cnt("Removed Edges", "removed_edges", "re"),
        *cnt("New Cycles", "new_cycles", "nc"), *cnt("Broken Cycles", "broken_cycles", "bc"),
        F.lit("\nCentrality Metrics:\n- Top Hubs: "), F.coalesce("hubs_json", F.lit("[]")), F.lit("\n\n"),
        F.lit(PROMPT_TAIL))
    return j.select(*T, text.alias("prompt"))
