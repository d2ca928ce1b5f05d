"""UDF-*: extension points.

* language adapters (UDF-01): DataFrame -> graph functions chosen per file
  language; files of languages without an adapter become failure rows;
* report scoring (UDF-02): a caller-supplied batch function over prompt
  texts, run inside the tasks with ``mapInPandas``; an empty answer falls back
  to the rule-based report;
* SQL names (UDF-03): SQL-bodied temporary functions, so SQL users get the
  same expressions without any Python in the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

G = ["project", "version"]
Adapter = Callable[[DataFrame], dict]

# Fixed value: failure message for a language without an adapter.
NOT_IMPLEMENTED = "Language adapter for '{language}' is not yet implemented."

_ADAPTERS: dict[str, Adapter] = {}


def register_adapter(language: str, fn: Adapter) -> None:
    """UDF-01: ``fn(files) -> {"nodes", "edges", ...}`` for files of ``language`` (case-insensitive)."""
    _ADAPTERS[language.lower()] = fn


def adapters() -> dict[str, Adapter]:
    """The built-in adapters and the registered ones, which may replace them."""
    from evograph.operators import extract as ex
    return {"java": ex.build_graph, "python": lambda f: ex.build_file_graph(f, "python")} | _ADAPTERS


def extract_all(files: DataFrame) -> dict[str, DataFrame]:
    """Run every registered adapter on its files and union the graphs.

    ``failures`` lists (project, version, language) groups whose language has
    no adapter.  No language list is collected: each adapter filters its own
    files, and the failure rows are an anti-join against the registered names.
    """
    spark = files.sparkSession
    reg = adapters()
    lang = F.lower(F.col("language"))
    nodes, edges = [], []
    for name, fn in reg.items():
        g = fn(files.where(lang == name))
        nodes.append(g["nodes"].select(*G, "id", "name", "type", "file_path", "loc", "complexity", "coupling",
                                       F.lit(name).alias("adapter")))
        edges.append(g["edges"].select(*G, "source", "target", "type", F.lit(name).alias("adapter")))
    known = spark.createDataFrame([(n,) for n in reg], "language_key string")
    failures = (files.select(*G, "language").distinct()
                .join(F.broadcast(known), F.lower(F.col("language")) == F.col("language_key"), "left_anti")
                .select(*G, "language", F.format_string(NOT_IMPLEMENTED.replace("{language}", "%s"),
                                                        F.lower(F.col("language"))).alias("error")))
    out_n, out_e = nodes[0], edges[0]
    for d in nodes[1:]:
        out_n = out_n.unionByName(d)
    for d in edges[1:]:
        out_e = out_e.unionByName(d)
    return {"nodes": out_n, "edges": out_e, "failures": failures}


def score_reports(prompts: DataFrame, fallback: DataFrame, scorer: Callable | None = None,
                  keys=("project", "v_old", "v_new")) -> DataFrame:
    """UDF-02: ``scorer(list[str]) -> list[str | None]`` over the prompt column, in Arrow
    batches inside the tasks; a missing or empty answer falls back to the report."""
    k = list(keys)

    def run(batches):
        for pdf in batches:
            answers = scorer(list(pdf["prompt"])) if scorer else [None] * len(pdf)
            out = pdf[k].copy()
            out["answer"] = [a if a else None for a in answers]
            yield out

    schema = ", ".join(f"{c} string" for c in k) + ", answer string"
    scored = prompts.select(*k, "prompt").mapInPandas(run, schema)
    return (scored.join(fallback.select(*k, "report"), k, "left")
            .select(*k, F.coalesce("answer", "report").alias("answer")))


SQL_FUNCTIONS = {
    "canonical_cycle": ("c ARRAY<STRING>", "ARRAY<STRING>",
                        "concat(slice(c, array_position(c, array_min(c)), size(c) - array_position(c, array_min(c)) + 1), "
                        "slice(c, 1, array_position(c, array_min(c)) - 1))"),
    "standard_language": ("name STRING", "STRING",
                          "CASE WHEN name IS NULL OR name = '' THEN 'Java' "
                          "WHEN contains(lower(name), 'java') THEN 'Java' "
                          "WHEN contains(lower(name), 'python') THEN 'Python' "
                          "WHEN contains(lower(name), 'gleam') THEN 'Gleam' "
                          "WHEN contains(lower(name), 'erlang') THEN 'Erlang' "
                          "ELSE concat(upper(substring(name, 1, 1)), lower(substring(name, 2))) END"),
    "coupling_z_score": ("v DOUBLE, mean DOUBLE, std DOUBLE", "DOUBLE",
                         "round((v - mean) / greatest(0.1, std), 2)"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """UDF-03: create the SQL-bodied temporary functions in the session."""
    for name, (params, ret, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body}")
    return list(SQL_FUNCTIONS)
