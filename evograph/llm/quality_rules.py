"""Quality rules with risk-controlled cutoffs, in built-in column functions only.

``measure`` turns every whole text into counts and ratios. ``cutoffs`` picks, for
each stratum (language) and rule, the strictest cutoff of a fixed grid whose
false-rejection risk is provably at most ``alpha / rules``: the labelled good
documents are the holdout, the false rejections among them are binomial, and the
exact lower tail ``P(Bin(n, alpha / rules) <= k)`` is the p-value of "the risk is
larger". A grid is walked from lenient to strict and stops at the first cutoff
that fails (fixed-sequence testing needs no correction inside a grid); strata and
rules share ``delta`` by Bonferroni. A stratum without enough labels gets no
cutoff and loses no document.

Defined results: a null text has no words (and so fails the base rules); a null
language is a stratum of its own; repeated documents are judged row by row; an
empty ``labels`` gives no cutoffs; extra columns are ignored by ``judge`` and
passed through by ``keep_good``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evograph.session import materialize

#: Base rules of the contract.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

#: Risk levels: false rejections of good documents per stratum, and the chance of breaking that.
ALPHA, DELTA = 0.05, 0.05

#: rule -> (metric, +1 rejects above / -1 rejects below, cutoffs from lenient to strict)
RULES: dict[str, tuple[str, int, list[float]]] = {
    "symbols": ("symbol_ratio", 1, [2.0, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1]),
    "dup_lines": ("dup_line_ratio", 1, [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]),
    "repeats": ("repeat_ratio", 1, [0.29, 0.25, 0.2, 0.15, 0.1]),
    "long_words": ("mean_word_chars", 1, [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0]),
    "short_words": ("mean_word_chars", -1, [1.2, 1.5, 2.0, 2.5, 3.0]),
}
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           "symbol_ratio", "dup_line_ratio", "repeat_ratio", "mean_word_chars", "base_failed"]


def _covered(sorted_pairs: Column) -> Column:
    """Words inside windows that occur at least twice: the size of the union of [place, place + WINDOW)
    over the places whose window hash has an equal neighbour in hash order."""
    n = F.size(sorted_pairs)
    hit = F.filter(sorted_pairs, lambda x, i: (
        (F.get(sorted_pairs, i - 1)["w"] == x["w"]) & (i > 0))
        | ((i < n - 1) & (F.get(sorted_pairs, i + 1)["w"] == x["w"])))
    places = F.array_sort(F.transform(hit, lambda x: x["i"]))
    step = F.aggregate(
        places, F.struct(F.lit(0).cast("long").alias("s"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["s"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("s"), p.alias("last")),
        lambda a: a["s"])
    return step


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus one struct column ``__m`` with the METRICS of each whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, "[ \\t-\\r]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    d = docs.withColumn("__words", words).withColumn("__lines", lines)
    d = d.withColumn("__win", F.transform("__words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words from two halves each
        d = d.withColumn("__win", F.expr(f"transform(__win, (x, i) -> xxhash64(x, get(__win, i + {step})))"))
    d = d.withColumn("__win", F.expr(f"slice(__win, 1, greatest(size(__win) - {WINDOW - 1}, 0))"))
    d = d.withColumn("__some", F.coalesce(F.size(F.array_distinct("__win")) < F.size("__win"), F.lit(False)))
    d = d.withColumn("__pairs", F.when(
        F.col("__some"), F.array_sort(F.transform("__win", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    n = F.size("__words").cast("long")
    n_lines = F.size("__lines").cast("long")
    counts = d.withColumn("__m", F.struct(
        n.alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__some"), _covered(F.col("__pairs"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        n_lines.alias("n_lines")))
    m = F.col("__m")
    over = F.greatest(m["n_words"], F.lit(1)).cast("double")
    return (counts.withColumn("__m", F.struct(
        *[m[c].alias(c) for c in METRICS[:5]],
        (m["n_symbols"] / over).alias("symbol_ratio"),
        (m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1))).alias("dup_line_ratio"),
        (m["n_repeat_words"] / over).alias("repeat_ratio"),
        (m["word_chars"] / over).alias("mean_word_chars"),
        ((m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])).alias("base_failed")))
        .drop("__words", "__lines", "__hash", "__win", "__some", "__pairs"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Exact ``P(Bin(n, p) <= k)`` for ``k < n * p``; 1 otherwise (too large to pass any test)."""
    log_top = (F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")),
                           F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i.cast("double")))
               + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1.0 - p)))
    ratio = F.aggregate(
        F.when(k > 0, F.sequence(k, F.lit(1).cast("long"))).otherwise(F.array().cast("array<long>")),
        F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t")),
        lambda a, j: F.struct(
            (a["s"] + a["t"] * j / (n - j + 1) * ((1 - p) / p)).alias("s"),
            (a["t"] * j / (n - j + 1) * ((1 - p) / p)).alias("t")),
        lambda a: a["s"])
    return F.when(k < n * p, F.exp(log_top) * ratio).otherwise(F.lit(1.0))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per (stratum, rule) that has a safe cutoff: ``stratum, rule, cutoff, n_good, n_rejected``.

    ``measured``: doc_id, stratum and METRICS. A document labelled more than once is good if any label is.
    """
    per_rule = alpha / len(RULES)
    good = (labels.groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__q"))
            .where(F.col("__q") == 1).select("__id"))
    # documents that the base rules reject never meet a cutoff, so they are not in its risk
    held = measured.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("__id"), "left_semi")
    firsts = []
    for rule, (metric, sign, grid) in RULES.items():
        first = F.lit(len(grid))
        for j in reversed(range(len(grid))):  # the first (most lenient) cutoff that rejects the document
            first = F.when(F.col(metric) * sign > grid[j] * sign, F.lit(j)).otherwise(first)
        firsts.append(F.struct(F.lit(rule).alias("rule"), first.alias("first")))
    # at most rules x (grid + 1) rows a stratum leave a task
    seen = (held.select("stratum", F.explode(F.array(*firsts)).alias("x"))
            .groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.first").alias("first")).agg(F.count("*").alias("c")))
    table = seen.groupBy("stratum", "rule").agg(
        F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("first", "c"))).alias("at"))
    strata = table.agg(F.countDistinct("stratum").alias("n_strata"))
    grid_of = F.create_map(*[x for r, (_, _, g) in RULES.items() for x in (F.lit(r), F.array(*map(F.lit, g)))])
    levels = (table.crossJoin(strata)  # one row of counts, not a join of data
              .select("stratum", "rule", "n", "n_strata", "at", F.posexplode(grid_of[F.col("rule")]).alias("j", "cutoff"))
              .withColumn("k", F.aggregate(F.filter(F.map_entries("at"), lambda e: e["key"] <= F.col("j")),
                                           F.lit(0).cast("long"), lambda a, e: a + e["value"]))
              .withColumn("ok", binomial_tail(F.col("k"), F.col("n"), per_rule)
                          <= F.lit(delta) / (F.col("n_strata") * len(RULES))))
    runs = levels.groupBy("stratum", "rule").agg(
        F.max("n").alias("n_good"),
        F.array_sort(F.collect_list(F.struct("j", "ok", "cutoff", "k"))).alias("steps"))
    passed = F.aggregate(F.col("steps"), F.struct(F.lit(True).alias("go"), F.lit(-1).alias("j")),
                         lambda a, s: F.struct((a["go"] & s["ok"]).alias("go"),
                                               F.when(a["go"] & s["ok"], s["j"]).otherwise(a["j"]).alias("j")),
                         lambda a: a["j"])
    return (runs.withColumn("last", passed).where("last >= 0")
            .select("stratum", "rule", F.col("steps")[F.col("last")]["cutoff"].alias("cutoff"), "n_good",
                    F.col("steps")[F.col("last")]["k"].alias("n_rejected")))


def _with_cutoffs(d: DataFrame, cut: DataFrame, stratum: str) -> DataFrame:
    """One map column of cutoffs by rule; the table has a row per stratum, and Spark decides how to join it."""
    table = cut.groupBy(F.col("stratum").alias("__s")).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cut"))
    return d.join(table, F.col(stratum) == F.col("__s"), "left").drop("__s")


def _passes(metric_of) -> Column:
    ok = F.lit(True)
    for rule, (metric, sign, _) in RULES.items():
        c = F.col("__cut")[rule]
        ok = ok & ~F.coalesce(metric_of(metric) * sign > c * sign, F.lit(False))
    return ok


def _stratum(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")


def _measured(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "text", _stratum(docs).alias("stratum"))
    return materialize(measure(d).select("doc_id", "stratum", "__m.*"), "rules")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the METRICS, ``stratum`` and ``kept`` of every document."""
    m = _measured(docs)
    out = _with_cutoffs(m, cutoffs(m, labels, alpha, delta), "stratum")
    return out.withColumn("kept", ~F.col("base_failed") & _passes(F.col)).drop("__cut")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns. The cutoffs come from a first pass
    over the narrow metrics; the second pass measures each row where it lies, so no text is shuffled."""
    cut = materialize(cutoffs(_measured(docs), labels, alpha, delta), "cutoffs")
    plain = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])  # extra columns may clash with ours
    at = {c: f"__c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    s = F.coalesce(F.col(at["lang"]), F.lit("")) if "lang" in at else F.lit("")
    d = _with_cutoffs(measure(plain.withColumn("__stratum", s), text=at["text"]), cut, "__stratum")
    # one conjunct over both sides: a predicate on the measures alone would be pushed below them and inline them
    d = d.where(F.when(F.col("__m.base_failed"), F.lit(False)).otherwise(_passes(lambda m: F.col("__m")[m])))
    return d.select(*plain.columns).toDF(*docs.columns)
