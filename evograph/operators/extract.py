"""EXT-*: source extraction as Spark jobs over a file table.

Input: ``files(project, version, path, content[, language, n_bytes])``.
Per-file measures are regex column expressions; declarations, imports and
word tokens are exploded into long tables; the name-resolution cascade is a
set of equi-joins keyed by ``(project, version, class, token)``; the
inheritance depth doubles ancestor pointers, with a written table per round.
The first pass (declarations) and the second (resolution) meet at the
shuffle on the declared-name index, as the two passes of the original
extractor do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evograph.session import cut_lineage

G = ["project", "version"]

# ---------------------------------------------------------------------------
# Patterns and word lists of the extraction contract.
# White space as Python's str.strip() sees it.
WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_BREAK = r"\r\n|[\n\x{0B}\f\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
JAVA_COMPLEXITY = r"(?U)\b(if|for|while|catch)\b|&&|\|\|"
JAVA_PACKAGE = r"(?U)package\s+([\w\.]+);"
JAVA_IMPORT = r"(?mU)^import\s+([\w\.\*]+);"
JAVA_RECORD = r"(?U)\brecord\s+(\w+)\s*\((.*?)\)"
JAVA_TYPE = (r"(?U)\b(?:sealed\s+|non-sealed\s+)?(?:class|interface|enum)\s+(\w+)"
             r"(?:\s+extends\s+([\w\.]+))?(?:\s+implements\s+([\w\.,\s]+))?(?:\s+permits\s+([\w\.,\s]+))?")
WORD = r"(?U)\b\w+\b"
TOKEN = r"(?U)\w+|\W+"
GENERIC_COMPLEXITY = r"(?U)\b(if|for|while|case|cond|fn|def|match)\b|&&|\|\|"
GENERIC_IMPORTS = {
    "python": (".py", r"(?U)\bimport\s+([\w\.]+)\b|\bfrom\s+([\w\.]+)\s+import\b"),
    "gleam": (".gleam", r"(?U)\bimport\s+([\w\/]+)\b"),
    "erlang": (".erl", r"(?U)-\b(?:include|include_lib)\b\(\"([^\"]+)\"\)"),
    "rust": (".rs", r"(?U)\buse\s+([\w\:]+)\b"),
    "javascript": (".js", None),   # the original pattern has no capture group
    "typescript": (".ts", None),
}
MINOR_LANGUAGES = ["Shell", "HTML", "CSS", "Dockerfile"]
STANDARD_LANGUAGES = [("java", "Java"), ("python", "Python"), ("gleam", "Gleam"), ("erlang", "Erlang")]
# ---------------------------------------------------------------------------


def _lines(content: Column) -> Column:
    return F.split(content, LINE_BREAK)


def java_loc(content: Column) -> Column:
    """EXT-01: lines that are not blank and do not start with ``//`` after stripping."""
    return F.size(F.filter(_lines(content), lambda l: ~l.rlike(f"^{WS}*$") & ~l.rlike(f"^{WS}*//"))).cast("bigint")


def java_complexity(content: Column) -> Column:
    """EXT-02: 1 + keyword (if/for/while/catch), ``&&`` and ``||`` matches."""
    return (F.lit(1) + F.regexp_count(content, F.lit(JAVA_COMPLEXITY))).cast("bigint")


def java_package(content: Column) -> Column:
    """EXT-03: first ``package x.y;`` or ''."""
    return F.regexp_extract(content, JAVA_PACKAGE, 1)


def java_imports(files: DataFrame) -> DataFrame:
    """EXT-04: ``(project, version, path, pos, import)`` in file order; static imports do not match."""
    return files.select(*G, "path", F.posexplode(F.regexp_extract_all("content", F.lit(JAVA_IMPORT), 1))
                        .alias("pos", "import"))


def _clean_type(p: Column) -> Column:
    parts = F.split(F.trim(p), r"\s+")
    t = F.element_at(parts, -2)
    return F.when(F.size(parts) >= 2, F.regexp_replace(t, "<.*?>", ""))


def java_records(files: DataFrame) -> DataFrame:
    """EXT-05: ``record Name(params)`` declarations with their parameter types (generics removed)."""
    names = F.regexp_extract_all("content", F.lit(JAVA_RECORD), 1)
    params = F.regexp_extract_all("content", F.lit(JAVA_RECORD), 2)
    z = files.select(*G, "path", F.posexplode(F.arrays_zip(names.alias("name"), params.alias("params"))).alias("pos", "r"))
    refs = F.filter(F.transform(F.split("r.params", ","), _clean_type), lambda x: x.isNotNull() & (x != ""))
    return z.select(*G, "path", "pos", F.col("r.name").alias("name"), F.array_distinct(refs).alias("refs"))


def java_types(files: DataFrame) -> DataFrame:
    """EXT-06: class / interface / enum declarations with ``extends`` and ``permits``.

    A class literally named ``record`` is skipped.  ``refs`` are the
    permitted subtypes.
    """
    def grp(i):
        return F.regexp_extract_all("content", F.lit(JAVA_TYPE), i)
    z = files.select(*G, "path", F.posexplode(F.arrays_zip(grp(1).alias("name"), grp(2).alias("ext"),
                                                             grp(4).alias("permits"))).alias("pos", "t"))
    permits = F.filter(F.transform(F.split("t.permits", ","), lambda x: F.trim(x)), lambda x: x != "")
    return (z.where(F.col("t.name") != "record")
            .select(*G, "path", "pos", F.col("t.name").alias("name"),
                    F.when(F.col("t.ext") != "", F.col("t.ext")).alias("extends"),
                    F.when(F.col("t.permits") != "", permits).otherwise(F.array().cast("array<string>")).alias("refs")))


def declarations(files: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Declared types with their file measures; one row per FQCN.

    Duplicate FQCNs: a record replaces earlier records (last by path and
    position) and always beats a class declaration; among class
    declarations the first by path and position is kept.  ``keep`` may leave rows out before that.
    """
    f = files.select(*G, "path", "content", java_package(F.col("content")).alias("package"),
                     java_loc(F.col("content")).alias("loc"), java_complexity(F.col("content")).alias("complexity"))
    meta = f.drop("content")
    rec = java_records(files).select(*G, "path", "pos", "name", F.lit(None).cast("string").alias("extends"),
                                     "refs", F.lit(0).alias("kind"))
    typ = java_types(files).select(*G, "path", "pos", "name", "extends", "refs", F.lit(1).alias("kind"))
    d = keep(rec.unionByName(typ)).join(meta, [*G, "path"])
    d = d.withColumn("fqcn", F.when(F.col("package") != "", F.concat_ws(".", "package", "name"))
                     .otherwise(F.col("name")))
    x = F.struct("path", "pos", "name", "extends", "refs", "package", "loc", "complexity")
    is_rec = F.col("kind") == 0
    winners = d.groupBy(*G, "fqcn").agg(
        F.max_by(F.when(is_rec, x), F.when(is_rec, F.struct("path", "pos"))).alias("r"),
        F.min_by(F.when(~is_rec, x), F.when(~is_rec, F.struct("path", "pos"))).alias("c"))
    w = winners.select(*G, "fqcn", F.coalesce("r", "c").alias("x"))
    return w.select(*G, "fqcn", "x.name", "x.package", F.col("x.path").alias("path"), "x.extends", "x.refs",
                    "x.loc", "x.complexity", F.col("x.pos").alias("pos"))


def declared_index(decls: DataFrame) -> DataFrame:
    """EXT-08: simple name -> number of FQCNs and the FQCN when unique."""
    return decls.groupBy(*G, "name").agg(F.countDistinct("fqcn").alias("n_cand"),
                                         F.min("fqcn").alias("fqcn"))


def token_refs(files: DataFrame, decls: DataFrame, index: DataFrame) -> DataFrame:
    """EXT-09: distinct word tokens of a class's file that are declared simple names
    (its own name excepted): ``(project, version, fqcn, package, path, token)``."""
    toks = files.select(*G, "path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(WORD), 0)))
                        .alias("token"))
    known = index.select(*G, F.col("name").alias("token"))
    toks = toks.join(known, [*G, "token"], "left_semi")
    return (decls.select(*G, "fqcn", "name", "package", "path").join(toks, [*G, "path"])
            .where(F.col("token") != F.col("name")).drop("name"))


def _imports_of(files: DataFrame, decls: DataFrame) -> DataFrame:
    imp = java_imports(files)
    return decls.select(*G, "fqcn", "path").join(imp, [*G, "path"]).drop("path")


def resolve(refs: DataFrame, imports: DataFrame, decls: DataFrame, index: DataFrame, ref_col: str = "token",
            use_global: bool = True) -> DataFrame:
    """EXT-10 / EXT-12: the four-step cascade for ``(fqcn, package, ref)`` rows.

    A explicit import ending in ``.ref`` that is a project class (first by
    position) -> B same package -> C first wildcard import whose package holds
    the class -> D the simple name is unique in the project.  Unresolved refs
    are dropped.  Returns ``(project, version, fqcn, ref, target)``.  All sides grow with the sources, so no step broadcasts
    one: many at once, each under the broadcast threshold as it lies in a shuffle, would meet in the driver's memory.
    """
    r = refs.select(*G, "fqcn", "package", F.col(ref_col).alias("ref")).distinct()
    classes = decls.select(*G, F.col("fqcn").alias("cand"))
    last_seg = F.substring_index(F.col("import"), ".", -1)
    explicit = (imports.where(F.col("import").contains(".") & ~F.col("import").endswith(".*"))
                .select(*G, "fqcn", "pos", F.col("import").alias("cand"), last_seg.alias("seg"))
                .join(classes.hint("merge"), [*G, "cand"], "left_semi"))
    a = (r.withColumn("seg", F.substring_index("ref", ".", -1))
         .join(explicit.hint("merge"), [*G, "fqcn", "seg"])
         .where(F.col("cand").endswith(F.concat(F.lit("."), F.col("ref"))))
         .groupBy(*G, "fqcn", "ref").agg(F.min_by("cand", "pos").alias("t_a")))
    same = F.when(F.col("package") != "", F.concat_ws(".", "package", "ref")).otherwise(F.col("ref"))
    b = (r.select(*G, "fqcn", "ref", same.alias("cand")).join(classes.hint("merge"), [*G, "cand"], "left_semi")
         .select(*G, "fqcn", "ref", F.col("cand").alias("t_b")))
    wild = (imports.where(F.col("import").endswith(".*"))
            .select(*G, "fqcn", "pos", F.expr("substring(import, 1, length(import) - 2)").alias("wpkg")))
    c = (r.join(wild.hint("merge"), [*G, "fqcn"]).select(*G, "fqcn", "ref", "pos",
                                          F.concat_ws(".", "wpkg", "ref").alias("cand"))
         .join(classes.hint("merge"), [*G, "cand"], "left_semi")
         .groupBy(*G, "fqcn", "ref").agg(F.min_by("cand", "pos").alias("t_c")))
    uniq = index.where(F.col("n_cand") == 1) if use_global else index.where(F.lit(False))
    d = (r.join(uniq.select(*G, F.col("name").alias("ref"), F.col("fqcn").alias("t_d")).hint("merge"),
                [*G, "ref"]).select(*G, "fqcn", "ref", "t_d"))
    k = [*G, "fqcn", "ref"]
    out = (r.select(*k).join(a.hint("merge"), k, "left").join(b.hint("merge"), k, "left").join(c.hint("merge"), k, "left").join(d.hint("merge"), k, "left")
           .select(*k, F.coalesce("t_a", "t_b", "t_c", "t_d").alias("target")))
    return out.where(F.col("target").isNotNull())


def resolve_qualified(refs: DataFrame, imports: DataFrame, decls: DataFrame, index: DataFrame) -> DataFrame:
    """EXT-11: ``Outer.Inner`` refs: direct ``Outer.Inner`` name lookup, else resolve
    ``Outer`` (import -> package -> wildcard) and append ``.Inner`` when declared."""
    q = refs.where(F.col("token").contains("."))
    direct = (q.join(index.where(F.col("n_cand") == 1).select(*G, F.col("name").alias("token"), F.col("fqcn").alias("t")).hint("merge"),
                     [*G, "token"]).select(*G, "fqcn", F.col("token").alias("ref"), F.col("t").alias("target")))
    outer = q.select(*G, "fqcn", "package", F.substring_index("token", ".", 1).alias("outer"),
                     F.expr("substring(token, length(substring_index(token, '.', 1)) + 2)").alias("inner"), "token")
    res = resolve(outer.withColumnRenamed("outer", "o"), imports, decls, index, ref_col="o", use_global=False) \
        .select(*G, "fqcn", F.col("ref").alias("o"), F.col("target").alias("outer_fqcn"))
    nested = (outer.withColumnRenamed("outer", "o").join(res.hint("merge"), [*G, "fqcn", "o"])
              .select(*G, "fqcn", F.col("token").alias("ref"),
                      F.concat_ws(".", "outer_fqcn", "inner").alias("target"))
              .join(decls.select(*G, F.col("fqcn").alias("target")).hint("merge"), [*G, "target"], "left_semi"))
    return direct.unionByName(nested.join(direct.select(*G, "fqcn", "ref").hint("merge"), [*G, "fqcn", "ref"], "left_anti"))


def resolve_parent(decls: DataFrame, imports: DataFrame, index: DataFrame) -> DataFrame:
    """EXT-12: parent FQCN of every class whose ``extends`` resolves inside the project."""
    refs = decls.where(F.col("extends").isNotNull()).select(*G, "fqcn", "package", F.col("extends").alias("token"))
    return resolve(refs, imports, decls, index).select(*G, "fqcn", F.col("target").alias("parent"))


def _ancestors(links: DataFrame, stops: DataFrame) -> DataFrame:
    """(id, to, d, end): the stop that each node's chain of ``links`` (id, to) ends in and its distance.

    Pointer doubling: a round joins the table of pointers with itself, so pointers that are not at a
    stop yet reach twice as far, and a chain of n nodes takes log2(n) rounds. A round in which no pointer reaches a stop is the
    last: what is left then (``end`` false) runs into a loop, as the members of an open chain closest to its
    stop would have arrived.
    """
    t = cut_lineage(links.select(*G, "id", "to", F.lit(1).cast("bigint").alias("d"), F.lit(False).alias("end")).unionByName(
        stops.select(*G, "id", F.col("id").alias("to"), F.lit(0).cast("bigint").alias("d"), F.lit(True).alias("end"))))
    before = None
    while True:
        left = t.where(~F.col("end")).count()
        if left == 0 or left == before:
            return t
        before = left
        far = t.select(*G, F.col("id").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("end").alias("end2"))
        moved = (t.where(~F.col("end")).join(far, [*G, "to"])
                 .select(*G, "id", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"), F.col("end2").alias("end")))
        t = cut_lineage(t.where("end").unionByName(moved))


def _loop_lengths(links: DataFrame) -> DataFrame:
    """(id, length) of the nodes on a loop; ``links`` (id, to) are those of nodes that run into one.

    Pointers are doubled until their targets no longer become fewer: these are the nodes on loops, a revisited ancestor of
    each other. There the least node of each loop is found by doubling windows, and its members are counted.
    """
    cur = cut_lineage(links.select(*G, "id", "to"))
    before = None
    while True:
        n = cur.select(*G, "to").distinct().count()
        if n == before:
            break
        before = n
        cur = cut_lineage(cur.join(cur.select(*G, F.col("id").alias("to"), F.col("to").alias("to2")), [*G, "to"])
                          .select(*G, "id", F.col("to2").alias("to")))
    on = cur.select(*G, F.col("to").alias("id")).distinct()
    win = cut_lineage(links.join(on, [*G, "id"], "left_semi").select(*G, "id", "to", F.least("id", "to").alias("m")))
    while True:
        nxt = win.select(*G, F.col("id").alias("to"), F.col("to").alias("to2"), F.col("m").alias("m2"))
        win = cut_lineage(win.join(nxt, [*G, "to"]).select(
            *G, "id", F.col("to2").alias("to"), F.least("m", "m2").alias("m"), (F.col("m2") < F.col("m")).alias("fell")))
        if win.where("fell").isEmpty():
            break
        win = win.drop("fell")
    count = win.groupBy(*G, "m").agg(F.count(F.lit(1)).alias("length"))
    return win.join(count, [*G, "m"]).select(*G, "id", "length")


def inheritance_depth(decls: DataFrame, parents: DataFrame) -> DataFrame:
    """EXT-13: 0 without ``extends``; 1 for a parent outside the project; else 1 + the
    parent's depth.  In an inheritance loop a class counts the steps until the
    first class repeats: its way to the loop and once round.  Logarithmic rounds, lineage cut in each."""
    base = cut_lineage(decls.select(*G, F.col("fqcn").alias("id"), F.col("extends").isNotNull().alias("has_ext"))
                       .join(parents.select(*G, F.col("fqcn").alias("id"), F.col("parent").alias("to")), [*G, "id"], "left"))
    links, tops = base.where(F.col("to").isNotNull()).select(*G, "id", "to"), base.where(F.col("to").isNull())
    t = _ancestors(links, tops)
    top = tops.select(*G, F.col("id").alias("to"), F.col("has_ext").cast("bigint").alias("more"))
    out = t.where("end").join(top, [*G, "to"]).select(*G, F.col("id").alias("fqcn"), (F.col("d") + F.col("more")).alias("depth"))
    bound = t.where(~F.col("end")).select(*G, "id")
    if bound.isEmpty():
        return out
    links = cut_lineage(links.join(bound, [*G, "id"], "left_semi"))
    loops = cut_lineage(_loop_lengths(links))
    way = _ancestors(links.join(loops, [*G, "id"], "left_anti"), loops.select(*G, "id"))
    return out.unionByName(way.join(loops.select(*G, F.col("id").alias("to"), "length"), [*G, "to"]).select(
        *G, F.col("id").alias("fqcn"), (F.col("d") + F.col("length")).alias("depth")))


def import_edges(imports: DataFrame, decls: DataFrame, edges: DataFrame) -> DataFrame:
    """EXT-14: an import of another project class not already linked from the class."""
    classes = decls.select(*G, F.col("fqcn").alias("target"))
    e = (imports.select(*G, "fqcn", F.col("import").alias("target"))
         .join(classes.hint("merge"), [*G, "target"], "left_semi").where(F.col("fqcn") != F.col("target")).distinct())
    linked = edges.select(*G, F.col("source").alias("fqcn"), "target")
    return e.join(linked.hint("merge"), [*G, "fqcn", "target"], "left_anti").select(
        *G, F.col("fqcn").alias("source"), "target", F.lit("imports").alias("type"))


# string, character and text-block literals and comments; possessive loops do not recurse on long ones
_JAVA_BLANKS = (r'"""(?s:.*?)"""|"(?:\\.|[^"\\\n])*+"|' + r"'(?:\\.|[^'\\\n])*+'" + r"|//[^\n]*|/\*(?s:.*?)\*/")
_NESTING = r"\b(?:class|interface|enum)\s+[\p{L}\p{Nd}_]+|[{}]"
_DOTTED = r"(?U)\b\w+(?:\.\w+)+"


def java_code(content: Column) -> Column:
    """A Java text whose literals and comments are blank."""
    return F.regexp_replace(F.coalesce(content, F.lit("")), _JAVA_BLANKS, " ")


def scope_table(files: DataFrame) -> DataFrame:
    """EXT-07: every type that stands directly in a file or in another type, with the types around it.

    The braces and declarations of a file are folded in column expressions: the open types are a stack, and a type counts where
    each open brace belongs to one of them (so not inside a method).  Literals and comments do not count. Output
    ``(project, version, path, package, pos, outer, name, depth, fqcn)``: ``outer`` is the dotted name of the
    types around it in the file (null at depth 0).
    """
    tokens = F.regexp_extract_all(java_code(F.col("content")), F.lit(_NESTING), F.lit(0))
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("open"), none.alias("pending"),
                     F.array().cast("array<struct<outer:string,name:string,depth:int>>").alias("found"))

    def step(a, t):
        opens, closes, n = t == "{", t == "}", F.size(a["open"])
        told = opens & a["pending"].isNotNull() & (n == a["depth"])
        depth = F.when(opens, a["depth"] + 1).when(closes, a["depth"] - 1).otherwise(a["depth"])
        row = F.struct(F.when(n > 0, F.array_join(a["open"], ".")).alias("outer"), a["pending"].alias("name"), n.alias("depth"))
        return F.struct(
            depth.alias("depth"),
            F.when(told, F.concat(a["open"], F.array(a["pending"])))
            .when(closes & (n > 0) & (n > a["depth"] - 1), F.slice(a["open"], F.lit(1), n - 1)).otherwise(a["open"]).alias("open"),
            F.when(opens, none).when(closes, a["pending"])
            .otherwise(F.regexp_extract(t, r"([\p{L}\p{Nd}_]+)$", 1)).alias("pending"),
            F.when(told, F.concat(a["found"], F.array(row))).otherwise(a["found"]).alias("found"))
    found = files.select(*G, "path", java_package(F.coalesce("content", F.lit(""))).alias("package"),
                         F.posexplode(F.aggregate(tokens, start, step, lambda a: a["found"])).alias("pos", "n"))
    return found.select(*G, "path", "package", "pos", "n.outer", "n.name", "n.depth", F.concat_ws(
        ".", F.when(F.col("package") != "", F.col("package")), "n.outer", "n.name").alias("fqcn"))


def nested_types(files: DataFrame) -> DataFrame:
    """EXT-07: one level of nested types (``Outer.Inner``) per top-level type:
    ``(project, version, path, outer, inner, fqcn)``."""
    return scope_table(files).where(F.col("depth") == 1).select(*G, "path", "outer", F.col("name").alias("inner"), "fqcn")


def scoped_declarations(files: DataFrame, scopes: DataFrame, max_depth: int | None = 1) -> DataFrame:
    """Declared types with nested ones under their outer type, as :func:`declarations` gives them plus ``qualified``.

    What the flat extraction finds in literals, comments and method bodies does not count, but in files whose braces do not match
    it is all there is.  A nested type has the file, package and imports of its outer type, no lines of its own, complexity 1 and no references.
    ``max_depth`` limits the levels (None: all). ``qualified`` is the name within the package (``Outer.Inner``).
    Of several declarations of one name the first by path and position counts.
    """
    code = files.withColumn("content", java_code(F.col("content")))
    told = scopes.where(F.col("depth") == 0).select(*G, "path", "name").unionByName(java_records(code).select(*G, "path", "name")).distinct()
    # files whose braces match
    sane = code.where(F.regexp_count("content", F.lit(r"\{")) == F.regexp_count("content", F.lit(r"\}"))).select(*G, "path").distinct()
    told = told.join(sane, [*G, "path"], "left_semi")
    flat = declarations(files, lambda d: d.join(told, [*G, "path", "name"], "left_semi").unionByName(
        d.join(sane, [*G, "path"], "left_anti"))).withColumn("qualified", F.col("name"))
    s = scopes.where(F.col("depth") > 0).join(sane, [*G, "path"], "left_semi")
    if max_depth is not None:
        s = s.where(F.col("depth") <= max_depth)
    first = s.groupBy(*G, "fqcn").agg(F.min_by(F.struct("path", "pos", "package", "outer", "name"), F.struct("path", "pos")).alias("x"))
    none = F.lit(None).cast("string")
    nested = (first.join(flat.select(*G, "fqcn"), [*G, "fqcn"], "left_anti")
              .select(*G, "fqcn", "x.name", "x.package", "x.path", none.alias("extends"), F.array().cast("array<string>").alias("refs"),
                      F.lit(0).cast("bigint").alias("loc"), F.lit(1).cast("bigint").alias("complexity"), "x.pos",
                      F.concat_ws(".", "x.outer", "x.name").alias("qualified")))
    return flat.unionByName(nested)


def scoped_refs(files: DataFrame, decls: DataFrame) -> DataFrame:
    """References of the top-level types: words and dotted pairs of their file's code that name a declared type,
    ``(project, version, fqcn, package, token)``. Of a chain ``a.b.c`` the pairs ``a.b`` and ``b.c`` are looked at, and longer
    runs as far as declared names are long."""
    names = decls.select(*G, F.col("name").alias("token")).unionByName(decls.select(*G, F.col("qualified").alias("token"))).distinct()
    longest = decls.agg(F.max(F.size(F.split("qualified", r"\.")))).first()[0] or 1
    code = files.select(*G, "path", java_code(F.col("content")).alias("code"))
    words = F.regexp_extract_all("code", F.lit(WORD), 0)
    chains = F.transform(F.regexp_extract_all("code", F.lit(_DOTTED), 0), lambda c: F.split(c, r"\."))

    def runs(c: Column) -> Column:
        """All runs of 2 to ``longest`` successive parts."""
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.transform(
            F.sequence(F.lit(2), F.least(F.lit(max(2, longest)), F.size(c) - i + 1)), lambda n: F.array_join(F.slice(c, i, n), "."))))
    tokens = code.select(*G, "path", F.explode(F.array_distinct(F.concat(words, F.flatten(F.transform(chains, runs))))).alias("token"))
    tokens = tokens.join(names.hint("merge"), [*G, "token"], "left_semi")
    own = decls.where(F.col("qualified") == F.col("name")).select(*G, "fqcn", "name", "package", "path")
    return own.join(tokens.hint("merge"), [*G, "path"]).where(F.col("token") != F.col("name")).drop("name", "path")


def scoped_index(decls: DataFrame) -> DataFrame:
    """EXT-08 with the qualified names of nested types beside the simple ones."""
    nested = decls.where(F.col("qualified") != F.col("name"))
    return declared_index(decls).unionByName(declared_index(nested.withColumn("name", F.col("qualified"))))


def resolve_scoped(refs: DataFrame, imports: DataFrame, decls: DataFrame) -> DataFrame:
    """EXT-11 in a graph: references, dotted ones too, resolved by the cascade over all declared types, then outwards.

    Simple and qualified names go through :func:`resolve` (imports, package, wildcards, the unique name) and qualified
    ones that leave open through :func:`resolve_qualified`. What several types share is looked up from the inside: in the
    referring type's own scopes, where the one nearest to the outermost type wins.
    """
    index = cut_lineage(scoped_index(decls), "scoped-index")
    k = [*G, "fqcn", "ref"]
    refs = cut_lineage(refs.select(*G, "fqcn", "package", "token").distinct(), "scoped-refs")
    found = cut_lineage(resolve(refs, imports, decls, index), "scoped-found")
    open_ = refs.join(found.withColumnRenamed("ref", "token").hint("merge"), [*G, "fqcn", "token"], "left_anti")
    dotted = resolve_qualified(open_, imports, decls, index)
    # a nested type below the referring one whose dotted name ends with the reference; the shortest is the closest
    below = decls.select(*G, "path", F.col("fqcn").alias("target"), "qualified")
    inner = below.select(*G, "target", F.col("qualified"), F.substring_index("qualified", ".", -1).alias("last"),
                         F.substring_index("qualified", ".", 1).alias("head"), "path")
    own = decls.where(F.col("qualified") == F.col("name")).select(*G, "fqcn", "path", F.col("name").alias("head"))
    near = (open_.withColumn("last", F.substring_index("token", ".", -1)).join(own.hint("merge"), [*G, "fqcn"])
            .join(inner.hint("merge"), [*G, "path", "head", "last"])
            .where(F.endswith(F.col("qualified"), F.concat(F.lit("."), F.col("token"))))
            .groupBy(*G, "fqcn", F.col("token").alias("ref"))
            .agg(F.min_by("target", F.struct(F.size(F.split("qualified", r"\.")).alias("n"), F.col("qualified"))).alias("target")))
    both = found.unionByName(dotted)
    return both.unionByName(near.join(dotted.select(*k).hint("merge"), k, "left_anti"))


def build_graph(files: DataFrame, scopes: bool = False, max_depth: int | None = 1) -> dict[str, DataFrame]:
    """EXT-15: ``nodes``, ``edges`` and ``versions`` of every (project, version) source tree.

    With ``scopes`` nested types are nodes under their outer type (EXT-07, down to ``max_depth`` levels), and
    references are taken from the code alone, dotted names included (EXT-11); without, names are flat and comments count, as
    in files that the original cannot parse.

    ``ord`` of extracted elements is a hash of the declaration, so ties in
    hub rankings break deterministically (the original order depends on the
    file system walk).
    """
    if scopes:
        table = cut_lineage(scope_table(files), "scopes")
        decls = cut_lineage(scoped_declarations(files, table, max_depth))
        imports = cut_lineage(_imports_of(files, decls), "imports")
        resolved = resolve_scoped(scoped_refs(files, decls), imports, decls)
    else:
        decls = cut_lineage(declarations(files))
        imports = _imports_of(files, decls)
        resolved = resolve(token_refs(files, decls, declared_index(decls)), imports, decls, declared_index(decls))
    index = scoped_index(decls) if scopes else declared_index(decls)
    calls = resolved.select(*G, F.col("fqcn").alias("source"), "target", F.lit("calls").alias("type")).distinct()
    parents = cut_lineage(resolve_parent(decls, imports, index))
    inh = parents.select(*G, F.col("fqcn").alias("source"), F.col("parent").alias("target"),
                         F.lit("inheritance").alias("type"))
    ci = calls.unionByName(inh)
    edges = ci.unionByName(import_edges(imports, decls, ci))
    edges = edges.withColumn("ord", F.xxhash64("source", "target", "type"))
    depth = inheritance_depth(decls, parents)
    nodes = (decls.join(depth, [*G, "fqcn"], "left")
             .select(*G, F.col("fqcn").alias("id"), "name", F.lit("class").alias("type"),
                     F.col("path").alias("file_path"), "loc", "complexity",
                     F.coalesce("depth", F.lit(0)).cast("bigint").alias("inheritance_depth"),
                     F.xxhash64("fqcn").alias("ord")))
    from evograph.operators.metrics import fan_metrics
    nodes = fan_metrics(nodes, edges).withColumn("coupling", F.col("fan_coupling")).drop("fan_coupling")
    versions = nodes.groupBy(*G).agg(
        F.sum("loc").cast("bigint").alias("total_loc"), F.count(F.lit(1)).alias("total_classes"),
        (F.sum("coupling") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("avg_coupling"))
    return {"nodes": nodes, "edges": edges, "versions": versions, "decls": decls}


# ------------------------------------------------------------------ generic path

def generic_loc(content: Column) -> Column:
    """EXT-16: lines not blank and not starting with ``#`` or ``//``."""
    return F.size(F.filter(_lines(content), lambda l: ~l.rlike(f"^{WS}*$") & ~l.rlike(f"^{WS}*(#|//)"))).cast("bigint")


def generic_complexity(content: Column) -> Column:
    """EXT-16: 1 + matches of the generic keyword set, ``&&`` and ``||``."""
    return (F.lit(1) + F.regexp_count(content, F.lit(GENERIC_COMPLEXITY))).cast("bigint")


def _base(path: Column) -> Column:
    """Path without its last extension (``a/b.c.py`` -> ``a/b.c``)."""
    return F.when(path.contains("."), F.regexp_extract(path, r"^(.*)\.[^.]*$", 1)).otherwise(path)


def generic_imports(files: DataFrame, language: str) -> DataFrame:
    """EXT-17: import targets by language; a target is a file whose extension-less path
    equals the import path or ends with ``/`` + it.  Suffix matching is an
    equi-join on every path suffix of each candidate file."""
    ext, pat = GENERIC_IMPORTS.get(language.lower(), (None, None))
    src = files.where(F.col("path").endswith(ext)) if ext else files.limit(0)
    if pat is None:
        return src.select(*G, F.col("path").alias("source"), F.col("path").alias("target")).limit(0)
    n_groups = pat.count("(") - pat.count("(?")
    groups = [F.regexp_extract_all("content", F.lit(pat), i) for i in range(1, n_groups + 1)]
    if n_groups == 1:
        found = groups[0]
    else:
        found = F.transform(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)]),
                            lambda z: F.coalesce(*[F.when(z[f"g{i}"] != "", z[f"g{i}"]) for i in range(n_groups)]))
    imp = (src.select(*G, F.col("path").alias("source"), F.explode(found).alias("imp"))
           .where(F.col("imp").isNotNull() & (F.col("imp") != ""))
           .select(*G, "source", F.trim(F.replace(F.replace("imp", F.lit("."), F.lit("/")), F.lit("/py"), F.lit("")))
                   .alias("key")).distinct())
    segs = F.split(_base(F.col("path")), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(segs)),
                           lambda i: F.array_join(F.slice(segs, i, F.size(segs) - i + 1), "/"))
    cand = src.select(*G, F.col("path").alias("target"), F.explode(suffixes).alias("key"))
    return imp.join(cand, [*G, "key"]).select(*G, "source", "target").distinct()


def token_index(files: DataFrame) -> DataFrame:
    """``(project, version, path, pos, token, n)``: a text as words and what stands between them, in order; ``n`` tokens in all."""
    tokens = F.regexp_extract_all("content", F.lit(TOKEN), 0)
    return files.select(*G, "path", F.size(tokens).alias("n"), F.posexplode(tokens).alias("pos", "token"))


def generic_mentions(files: DataFrame, language: str) -> DataFrame:
    """EXT-18: a file mentions another file's base name as a whole word.

    Texts and names are cut into the same tokens (words, and what stands between two words). A whole-word mention is a run of
    the name's tokens in a text; where the name begins or ends between words, a word has to stand beside it.
    A name's rarest word token finds the places where it may stand, by an equi-join with the positional index, and
    every other token has to stand at its distance from there, by another. No text is searched for a name.
    """
    ext = GENERIC_IMPORTS.get(language.lower(), (f".{language.lower()}" if language else ".src", None))[0]
    src = files.where(F.col("path").endswith(ext))
    name = F.element_at(F.split(_base(F.col("path")), "/"), -1)
    parts = F.regexp_extract_all("name", F.lit(TOKEN), 0)
    names = cut_lineage(src.select(*G, F.col("path").alias("target"), name.alias("name")).where(F.col("name") != "")
                        .withColumn("parts", parts), "mention-names")
    part = names.select(*G, "target", F.size("parts").alias("k"), F.posexplode("parts").alias("i", "token"))
    # only tokens of names are of interest
    index = cut_lineage(token_index(src).join(part.select(*G, "token").distinct(), [*G, "token"], "left_semi"), "mention-tokens")
    count = index.groupBy(*G, "token").agg(F.count(F.lit(1)).alias("seen"))
    # the rarest word of a name, or its only token (a name without a word)
    word = F.col("token").rlike(r"(?U)^\w")
    key = (part.join(count, [*G, "token"]).groupBy(*G, "target", "k")
           .agg(F.min_by(F.struct("i", "token"), F.struct((~word).alias("no_word"), "seen", "i")).alias("r"))
           .select(*G, "target", "k", "r.i", "r.token"))
    one = (index.select(*G, F.col("path").alias("source"), "token", "pos", "n").join(key, [*G, "token"])
           .select(*G, "target", "source", "k", "n", F.col("i").alias("at"), (F.col("pos") - F.col("i")).alias("start"))
           .where((F.col("start") >= 0) & (F.col("start") + F.col("k") <= F.col("n"))))
    single = one.where("k = 1").select(*G, "target", "source", "start", "n", "k")
    rest = part.select(*G, "target", "i", "token")
    need = (one.where("k > 1").join(rest, [*G, "target"]).where(F.col("i") != F.col("at"))
            .select(*G, "target", "source", "start", "n", "k", "token", (F.col("start") + F.col("i")).alias("pos")))
    runs = (need.join(index.select(*G, F.col("path").alias("source"), "pos", "token"), [*G, "source", "pos", "token"])
            .groupBy(*G, "target", "source", "start", "n", "k").agg(F.count(F.lit(1)).alias("hit"))
            .where(F.col("hit") == F.col("k") - 1).drop("hit"))
    ends = names.select(*G, "target", F.element_at("parts", 1).rlike(r"(?U)^\w").alias("word_first"),
                        F.element_at("parts", -1).rlike(r"(?U)^\w").alias("word_last"))
    found = single.unionByName(runs).join(ends, [*G, "target"]).where(
        (F.col("word_first") | (F.col("start") > 0)) & (F.col("word_last") | (F.col("start") + F.col("k") < F.col("n"))))
    return found.where(F.col("source") != F.col("target")).select(*G, "source", "target").distinct()


def build_file_graph(files: DataFrame, language: str) -> dict[str, DataFrame]:
    """EXT-19: ``file`` nodes with generic metrics and distinct ``imports`` edges."""
    ext = GENERIC_IMPORTS.get(language.lower(), (f".{language.lower()}" if language else ".src", None))[0]
    src = files.where(F.col("path").endswith(ext))
    edges = (generic_imports(files, language).unionByName(generic_mentions(files, language)).distinct()
             .withColumn("type", F.lit("imports")).withColumn("ord", F.xxhash64("source", "target")))
    nodes = src.select(*G, F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"),
                       F.lit("file").alias("type"), F.col("path").alias("file_path"),
                       generic_loc(F.col("content")).alias("loc"),
                       generic_complexity(F.col("content")).alias("complexity"),
                       F.xxhash64("path").alias("ord"))
    from evograph.operators.metrics import fan_metrics
    nodes = fan_metrics(nodes, edges).withColumn("coupling", F.col("fan_coupling")).drop("fan_coupling")
    versions = nodes.groupBy(*G).agg(
        F.sum("loc").cast("bigint").alias("total_loc"), F.count(F.lit(1)).alias("total_classes"),
        (F.sum("coupling") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("avg_coupling"))
    return {"nodes": nodes, "edges": edges, "versions": versions}


def major_language(langs: DataFrame, key: list[str], skip_minor: bool = False) -> DataFrame:
    """EXT-20: the language with most bytes per key (``langs`` holds a MAP<lang, bytes>
    column ``languages``); the dashboard variant skips minor languages unless alone."""
    m = F.col("languages")
    if skip_minor:
        m = F.when(F.size("languages") > 1, F.map_filter("languages", lambda k, v: ~k.isin(MINOR_LANGUAGES))) \
            .otherwise(F.col("languages"))
    ent = F.map_entries(m)
    best = F.aggregate(ent, F.struct(F.lit(None).cast("string").alias("key"), F.lit(-1).cast("bigint").alias("value")),
                       lambda acc, x: F.when(x["value"] > acc["value"], x).otherwise(acc))
    return langs.select(*key, best["key"].alias("major_language"))


def standard_language(name: Column, compat: bool = True) -> Column:
    """EXT-21: contains java -> Java, python, gleam, erlang, else capitalised; NULL/empty -> Java.

    ``compat=False`` checks exact names first, so "JavaScript" stays JavaScript.
    """
    low = F.lower(name)
    out = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1 << 30)))
    for k, v in reversed(STANDARD_LANGUAGES):
        out = F.when(low.contains(k), F.lit(v)).otherwise(out)
    if not compat:
        out = F.when(low == "javascript", F.lit("Javascript")).otherwise(out)
    return F.when(name.isNull() | (name == ""), F.lit("Java")).otherwise(out)


def parse_coordinate(coord: Column) -> Column:
    """EXT-22: ``owner/repo[:lang]`` -> struct(owner, repo, language, error)."""
    has_lang = coord.contains(":")
    raw = F.when(has_lang, F.trim(F.element_at(F.split(coord, ":"), 1))).otherwise(coord)
    lang = F.when(has_lang, F.trim(F.element_at(F.split(coord, ":"), 2)))
    ok = raw.contains("/")
    return F.struct(F.when(ok, F.substring_index(raw, "/", 1)).alias("owner"),
                    F.when(ok, F.regexp_extract(raw, r"^[^/]*/(.*)$", 1)).alias("repo"),
                    lang.alias("language"),
                    F.when(~ok, F.concat(F.lit("Invalid repository format '"), coord,
                                         F.lit("'. Must be 'owner/repo'."))).alias("error"))
