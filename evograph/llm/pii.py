"""Personal data by bootstrapped contextual extraction, in built-in column functions only.

``base_spans`` finds the four fixed kinds with their code-point offsets: the pieces
between the matches and the matches themselves give running lengths. These are the
seeds, with those of a fifth kind: secrets, long runs of letters and digits after a word for a credential, which are
told (and redacted) beside the base kinds. Around seeds and around other identifier-like tokens (five digits or more, or
an ``@``) lexical patterns are induced: the last two words before, the last word
before, and the words on both sides. Pattern and instance form a bipartite graph, scored
in rounds: a pattern's confidence for a kind is the share of its distinct instances
that are of this kind (found ones count by their score), and an instance's score is
``1 - prod(1 - confidence)`` over the trusted patterns that it stands in. Patterns need
``MIN_SEEDS`` distinct seeds and ``MIN_CONFIDENCE``; instances that reach
``MIN_CONFIDENCE`` join the seeds of the next round and keep their kind, so that scores only
rise. Rounds go on until neither the found instances nor their scores (in millionths) change.
Copies of a text add nothing, because instances count once.

Defined results: null and empty texts have no spans; repeated rows get one row each;
empty tables give no patterns; a match that fails its check is dropped without a
second try; extra columns are ignored by ``spans`` and passed through by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evograph.session import materialize

#: The kinds in their order, with patterns that match what the plain forms
#: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``, ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``,
#: ``[0-9]([\x20-]?[0-9])+`` and ``\+[0-9][\x20().0-9-]+[0-9]`` match, but take linear time on
#: long runs (possessive loops do not recurse; look-behinds skip starts inside a run).
KINDS = ["email", "ip", "card", "phone"]
#: Seeds of a fifth kind, which is no base kind: a long run after a word for a credential and ``=`` or ``:``.
SECRET = "secret"
SECRET_PATTERN = (r"(?<=\b(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']{0,1}\s{0,3}[:=]\s{0,3}[\"']{0,1})"
                  r"[A-Za-z0-9+/_-]{20,}+")
MAY_HOLD_SECRET = r"(?i:token|secret|passw|key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9+/_-]{20}"
#: A secret has letters, digits and at least so many different signs.
SECRET_SIGNS = 8
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot hold the kind.
MAY_HOLD = {
    "email": r"@[A-Za-z0-9-]++\.",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"\+[0-9][\x20().0-9-]",
}
MIN_SEEDS, MIN_CONFIDENCE = 5, 0.9
#: Whole scores are millionths, so that sums do not depend on the order of rows.
_ONE = 1_000_000
_BLOCK = 512
_AT = "array<struct<start:int,stop:int,value:string>>"


def _running(d: DataFrame, sizes: str, out: str) -> DataFrame:
    """Adds ``out``: the running sums before each element of ``sizes``, in blocks, so that a long array is not
    copied once an element. Steps are columns: an expression inside a lambda runs again for each element."""
    zero = F.array(F.lit(0))
    d = d.withColumn("__blocks", F.when(F.size(sizes) > 0, F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(sizes) / _BLOCK).cast("int") - 1),
        lambda b: F.aggregate(F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK)), zero,
                              lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))))
    d = d.withColumn("__totals", F.aggregate(
        "__blocks", zero, lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + F.element_at(b, -1)))))
    return d.withColumn(out, F.flatten(F.transform("__blocks", lambda b, i: F.transform(
        F.slice(b, F.lit(1), F.size(b) - 1), lambda x: x + F.get("__totals", i))))).drop("__blocks", "__totals")


def _matches(d: DataFrame, name: str, pattern: str, may_hold: Column) -> DataFrame:
    """Adds ``name``: start, stop (code points) and value of every match, leftmost and not overlapping."""
    t = F.col("__text")
    d = d.withColumn("__hits", F.when(may_hold, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))
    d = d.withColumn("__gaps", F.when(F.size("__hits") > 0, F.transform(
        F.slice(F.split(t, pattern, -1), F.lit(1), F.size("__hits")), lambda x: F.length(x))))
    d = d.withColumn("__sizes", F.when(F.col("__gaps").isNotNull(),
                                       F.zip_with("__gaps", "__hits", lambda g, h: g + F.length(h))))
    d = _running(d, "__sizes", "__before")
    found = F.transform("__hits", lambda h, i: F.struct(
        (F.get("__before", i) + F.get("__gaps", i)).alias("start"),
        (F.get("__before", i) + F.get("__gaps", i) + F.length(h)).alias("stop"), h.alias("value")))
    none = F.array().cast(_AT)
    return (d.withColumn(name, F.when(F.col("__gaps").isNotNull(), found.cast(_AT)).otherwise(none))
            .drop("__hits", "__gaps", "__sizes", "__before"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """Luhn sum of the digits is a multiple of ten."""
    d = F.split(F.reverse(_digits(v)), "")
    each = F.transform(F.filter(d, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    if kind == "ip":
        short = F.transform(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda p: F.when(F.length(p) > 3, F.lit(False)).otherwise(p.cast("int") <= 255))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(v)).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__base``: the base spans (kind, start, stop, value) by kind as listed, then start."""
    d = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    for k in KINDS:
        d = _matches(d, f"__{k}", PATTERNS[k], F.col("__text").rlike(MAY_HOLD[k]))
    def checked(k: str) -> Column:
        return F.transform(F.filter(f"__{k}", lambda m: _holds(k, m["value"])), lambda m: F.struct(
            F.lit(k).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), m["value"].alias("value")))
    parts = [checked(k) for k in KINDS]
    return d.withColumn("__base", F.concat(*parts)).drop(*[f"__{k}" for k in KINDS])


def _secret(v: Column) -> Column:
    return v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= SECRET_SIGNS)


def _context(m: Column) -> list[Column]:
    """Lexical patterns of an instance; words are lower-cased and stripped of punctuation and digits."""
    def words(x: Column) -> Column:
        return F.filter(F.split(F.lower(F.regexp_replace(x, r"[^\p{L}\s:=#@-]|[0-9]", " ")), r"\s+"), lambda w: w != "")
    left = words(F.substring(F.col("__text"), F.greatest(m["start"] - 62, F.lit(1)),
                             F.least(m["start"], F.lit(63))))
    right = words(F.substring(F.col("__text"), m["stop"] + 1, F.lit(48)))
    # without try_element_at a missing neighbour would be an error in ANSI mode
    one, two, after = (F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2)),
                       F.try_element_at(right, F.lit(1)))
    return [F.concat(F.lit("2<"), two, F.lit(" "), one), F.concat(F.lit("1<"), one),
            F.concat(F.lit("<>"), one, F.lit(" _ "), after)]


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base spans and, in ``seen``, all instances (kind or null, span, value, patterns) of every row."""
    d = base_spans(docs.select("doc_id", "text"))
    d = _matches(d, "__keys", SECRET_PATTERN, F.col("__text").rlike(MAY_HOLD_SECRET))
    keys = F.transform(F.filter("__keys", lambda m: _secret(m["value"])), lambda m: F.struct(
        F.lit(SECRET).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), m["value"].alias("value")))
    d = d.withColumn("__secrets", keys)
    d = _matches(d, "__tokens", r"\S++", F.col("__text").rlike(r"(?:[0-9][^\s0-9]*+){5}|@"))
    other = F.filter("__tokens", lambda m: (
        ((F.length(_digits(m["value"])) >= 5) | m["value"].contains("@"))
        & ~F.exists("__base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"]))
        & ~F.exists("__secrets", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"]))))
    d = d.withColumn("__other", F.transform(other, lambda m: F.struct(
        F.lit(None).cast("string").alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"),
        m["value"].alias("value"))))
    seen = F.transform(F.concat("__base", "__secrets", "__other"), lambda m: F.struct(
        m["kind"].alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), m["value"].alias("value"),
        F.array(*_context(m)).alias("patterns")))
    return d.select("doc_id", F.xxhash64("__text").alias("text_hash"), F.col("__base").alias("base"), seen.alias("seen"))


def discover(seen: DataFrame) -> DataFrame:
    """value, kind of the unseen identifiers that trusted patterns find. ``seen``: the table of ``occurrences``."""
    edges = materialize(
        seen.select(F.explode("seen").alias("m"))
        .select(F.explode("m.patterns").alias("pattern"), F.col("m.value").alias("value"), F.col("m.kind").alias("kind"))
        .where("pattern IS NOT NULL").distinct(), "pii_edges")
    total = edges.groupBy("pattern").agg(F.countDistinct("value").alias("n"))
    seeds = materialize(edges.where("kind IS NOT NULL").select("value", "kind", F.lit(_ONE).cast("long").alias("score")).distinct(),
                        "pii_seeds")
    known, before = seeds, (0, None)
    found = seeds.limit(0)
    while True:  # scores are whole, bounded and never fall
        trusted = (edges.select("pattern", "value").distinct().join(known, "value")
                   .groupBy("pattern", F.col("kind").alias("as")).agg(F.sum("score").alias("s"), F.count("*").alias("seeds"))
                   .join(total, "pattern").withColumn("confidence", F.col("s") / (F.col("n") * _ONE))
                   .where((F.col("seeds") >= MIN_SEEDS) & (F.col("confidence") >= MIN_CONFIDENCE)))
        scored = (edges.where("kind IS NULL").join(trusted, "pattern")
                  .groupBy("value", F.col("as").alias("kind"))
                  # a confidence of one would make the product zero for good
                  .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("p"))
                  .select("value", "kind", F.round(F.col("p") * _ONE).cast("long").alias("score"))
                  .where(F.col("score") >= round(MIN_CONFIDENCE * _ONE)))
        # a found instance keeps its kind, and its best score
        old = found.toDF("__value", "__kind", "__score")
        kept = (scored.join(old, F.col("value") == F.col("__value"), "full")
                .select(F.coalesce("__value", "value").alias("value"), F.coalesce("__kind", "kind").alias("kind"),
                        F.when(F.col("kind").eqNullSafe(F.col("__kind")) | F.col("__kind").isNull(),
                               F.greatest("score", "__score")).otherwise(F.col("__score")).alias("score")))
        found = materialize(kept.groupBy("value").agg(
            F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score")), "pii_found")
        now = tuple(found.agg(F.count("*"), F.sum("score")).first())
        if now == before:
            return found.select("value", "kind")
        before = now
        known = seeds.unionByName(found).groupBy("value", "kind").agg(F.max("score").alias("score"))


def _extra(seen: DataFrame) -> DataFrame:
    """doc_id, text_hash and the discovered spans of the rows that have some."""
    each = seen.select("doc_id", "text_hash", F.explode("seen").alias("m"))
    at = ["doc_id", "text_hash", "m.start", "m.stop", "m.value"]
    hits = (each.where("m.kind IS NULL").select(*at).distinct().join(discover(seen), "value")
            .unionByName(each.where(F.col("m.kind") == SECRET).select(*at, F.lit(SECRET).alias("kind")).distinct()))
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("kind", "start", "stop", "value")).alias("extra"))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(
        ":", m["kind"], m["start"].cast("string"), m["stop"].cast("string"))), ",")


def _ordered(spans: Column) -> Column:
    """By kind as listed, then start."""
    rank = F.create_map(*[x for i, k in enumerate([*KINDS, SECRET]) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda m: F.struct(rank[m["kind"]].alias("r"), m["start"].alias("start"), m["stop"].alias("stop"),
                                                  m["kind"].alias("kind"), m["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"),
                                                               m["value"].alias("value")))


def _joined(seen: DataFrame, extra: DataFrame) -> DataFrame:
    e = extra.toDF("__d", "__h", "extra")
    return seen.join(e, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h")), "left").drop("__d", "__h")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, the count of base spans by kind, ``base`` and ``spans`` (all, told as kind:start:end) of every row."""
    seen = materialize(occurrences(docs), "pii_seen")
    out = _joined(seen, _extra(seen))
    every = F.when(F.col("extra").isNull(), F.col("base")).otherwise(_ordered(F.concat("base", "extra")))
    return out.select(
        "doc_id", *[F.expr(f"size(filter(base, m -> m.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS],
        _told(F.col("base")).alias("base"), _told(every).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span of the text replaced by its kind in angle brackets; overlapping spans
    become one, named by the first. The rows keep their columns."""
    extra = materialize(_extra(materialize(occurrences(docs), "pii_seen")), "pii_extra")
    plain = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    doc, text = (f"__c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    d = base_spans(plain, text)
    e = extra.toDF("__d", "__h", "__extra")
    d = d.join(e, F.col(doc).eqNullSafe(F.col("__d")) & (F.xxhash64("__text") == F.col("__h")), "left")
    d = d.withColumn("__all", F.array_sort(F.transform(
        F.concat("__base", F.coalesce("__extra", F.array().cast("array<struct<kind:string,start:int,stop:int,value:string>>"))),
        lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["kind"].alias("kind")))))
    t = F.col("__text")
    step = F.aggregate(
        "__all", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, m: F.when(m["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], m["stop"]).alias("at")))
        .otherwise(F.struct(F.concat(a["out"], F.substring(t, a["at"] + 1, m["start"] - a["at"]),
                                     F.lit("<"), F.upper(m["kind"]), F.lit(">")).alias("out"), m["stop"].alias("at"))),
        lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    d = d.withColumn(text, F.when(F.size("__all") > 0, step).otherwise(F.col(text)))
    return d.select(*plain.columns).toDF(*docs.columns)
