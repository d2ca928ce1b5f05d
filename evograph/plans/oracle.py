"""DuckDB oracle SQL for the registered queries.

The fixture CTEs restate :mod:`evograph.fixtures` in plain SQL over the
pre-registered driver views; each query appends its own CTEs and final
SELECT.  Aggregates are cast to BIGINT / rounded so both engines print the
same values.
"""

from __future__ import annotations

FIX = """
e0 AS (
  SELECT o_orderpriority AS project, o_orderdate AS d, l_partkey AS source,
         lead(l_partkey) OVER (PARTITION BY l_orderkey
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS target
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
raw_e AS (
  SELECT project, 'v1' AS version, source, target FROM e0
   WHERE d < TIMESTAMP '1999-01-01' AND target IS NOT NULL
  UNION ALL
  SELECT project, 'v2' AS version, source, target FROM e0
   WHERE d >= TIMESTAMP '1997-01-01' AND target IS NOT NULL),
dep_edges AS (
  SELECT project, version, source, target,
         CASE source % 3 WHEN 0 THEN 'inheritance' WHEN 1 THEN 'imports' ELSE 'calls' END AS type,
         source * 1000000 + target AS ord
  FROM raw_e),
ends AS (
  SELECT DISTINCT project, version, id FROM (
    SELECT project, version, source AS id FROM dep_edges
    UNION ALL SELECT project, version, target FROM dep_edges)),
dep_nodes AS (
  SELECT e.project, e.version, e.id, p_name AS name,
         CASE WHEN e.id % 2 = 0 THEN 'class' ELSE 'file' END AS type,
         'src/' || p_type || '/' || p_name AS file_path,
         CAST(p_size AS BIGINT) AS loc, e.id % 7 AS complexity,
         CASE WHEN e.id % 4 = 0 THEN NULL ELSE CAST(p_size % 10 AS BIGINT) END AS coupling,
         CASE WHEN e.id % 13 = 0 THEN NULL ELSE e.id % 5 END AS inheritance_depth,
         e.id AS ord
  FROM ends e JOIN part ON e.id = p_partkey
  WHERE e.id % 50 <> 7),
transitions AS (
  SELECT project, 'v1' AS v_old, 'v2' AS v_new FROM dep_edges
  GROUP BY project HAVING count(DISTINCT version) = 2),
epos AS (
  SELECT project, version, id, min(pos) AS ord FROM (
    SELECT project, version, source AS id, ord * 2 AS pos FROM dep_edges
    UNION ALL SELECT project, version, target, ord * 2 + 1 FROM dep_edges) GROUP BY ALL),
all_nodes AS (
  SELECT project, version, id, name, type, file_path, loc, complexity, coupling,
         inheritance_depth, ord, false AS implicit FROM dep_nodes
  UNION ALL
  SELECT p.project, p.version, p.id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, p.ord, true
  FROM epos p ANTI JOIN dep_nodes n USING (project, version, id)),
pairs AS (SELECT DISTINCT project, version, source, target FROM dep_edges),
deg AS (
  SELECT n.*, CAST(coalesce(i.c, 0) AS BIGINT) AS in_deg, CAST(coalesce(o.c, 0) AS BIGINT) AS out_deg,
         CAST(coalesce(i.c, 0) + coalesce(o.c, 0) AS BIGINT) AS degree
  FROM all_nodes n
  LEFT JOIN (SELECT project, version, target AS id, count(*) AS c FROM pairs GROUP BY ALL) i
    USING (project, version, id)
  LEFT JOIN (SELECT project, version, source AS id, count(*) AS c FROM pairs GROUP BY ALL) o
    USING (project, version, id)),
nn AS (SELECT project, version, count(*) AS n_nodes FROM all_nodes GROUP BY ALL),
cent AS (
  SELECT d.*, nn.n_nodes,
         CASE WHEN nn.n_nodes <= 1 THEN 1.0 ELSE d.degree * (1.0 / (nn.n_nodes - 1)) END AS centrality
  FROM deg d JOIN nn USING (project, version)),
coup AS (SELECT d.*, CAST(coalesce(d.coupling, d.degree) AS BIGINT) AS coupling_value FROM deg d),
sysm AS (
  SELECT project, version, CAST(sum(loc) AS BIGINT) AS total_loc, count(*) AS total_classes,
         coalesce(sum(coupling), 0) / greatest(1, count(*)) AS avg_coupling
  FROM dep_nodes GROUP BY ALL),
node_mem AS (
  SELECT t.project, t.v_old, t.v_new, x.id, bit_or(x.side) AS m FROM transitions t JOIN (
    SELECT project, version, id, CASE version WHEN 'v1' THEN 1 ELSE 2 END AS side FROM (
      SELECT project, version, id FROM dep_nodes
      UNION ALL SELECT project, version, id FROM ends)) x ON x.project = t.project
  GROUP BY ALL),
edge_mem AS (
  SELECT t.project, t.v_old, t.v_new, p.source, p.target,
         bit_or(CASE p.version WHEN 'v1' THEN 1 ELSE 2 END) AS m
  FROM transitions t JOIN pairs p ON p.project = t.project GROUP BY ALL)
"""


def _cycle_sql(max_len: int = 5) -> str:
    """Independent formulation: L-way self join rooted at the smallest node."""
    parts = ["SELECT project, version, CAST(s AS VARCHAR) AS cycle_str, 1 AS length FROM ce WHERE s = t"]
    for L in range(2, max_len + 1):
        al = [f"a{i}" for i in range(L)]
        froms = [f"ce {al[0]}"]
        conds = [f"{al[0]}.t > {al[0]}.s"]
        for i in range(1, L):
            froms.append(f"JOIN ce {al[i]} ON {al[i]}.project = a0.project AND {al[i]}.version = a0.version "
                         f"AND {al[i]}.s = {al[i-1]}.t")
        conds.append(f"{al[L-1]}.t = a0.s")
        # interior nodes: a0.t, a1.t, ..., a{L-2}.t ; all > root and pairwise distinct
        inner = [f"{al[i]}.t" for i in range(L - 1)]
        for x in inner[1:]:
            conds.append(f"{x} > a0.s")
        for i in range(len(inner)):
            for j in range(i + 1, len(inner)):
                conds.append(f"{inner[i]} <> {inner[j]}")
        path = ", ".join(["CAST(a0.s AS VARCHAR)"] + [f"CAST({x} AS VARCHAR)" for x in inner])
        parts.append(f"SELECT a0.project, a0.version, concat_ws('>', {path}) AS cycle_str, {L} AS length "
                     f"FROM {' '.join(froms)} WHERE {' AND '.join(conds)}")
    return ("ce AS (SELECT * FROM (SELECT DISTINCT project, version, source AS s, target AS t FROM dep_edges)),\n"
            "cyc AS (" + "\nUNION ALL\n".join(parts) + ")")


CYC = _cycle_sql(5)

CYC_CHANGES = """
cyc_chg AS (
  SELECT t.project, t.v_old, t.v_new, c.cycle_str, any_value(c.length) AS length,
         bit_or(CASE c.version WHEN 'v1' THEN 1 ELSE 2 END) AS m
  FROM transitions t JOIN cyc c ON c.project = t.project GROUP BY ALL),
cyc_changes AS (
  SELECT project, v_old, v_new, CASE m WHEN 2 THEN 'new' ELSE 'broken' END AS change, cycle_str, length
  FROM cyc_chg WHERE m <> 3)
"""

ANOM = """
anom AS (
  SELECT c.project, c.version, c.id, c.coupling_value AS coupling,
         round((c.coupling_value - s.mean) / greatest(0.1, s.std), 2) AS z_score,
         s.mean, s.std, greatest(3.0, s.mean + 2 * s.std) AS threshold, c.implicit, c.ord
  FROM coup c JOIN (SELECT project, version, avg(coupling_value) AS mean,
                           stddev_pop(coupling_value) AS std FROM coup GROUP BY ALL) s
    USING (project, version)
  WHERE c.coupling_value > greatest(3.0, s.mean + 2 * s.std))
"""

HUBS = """
hubs AS (
  SELECT * FROM (
    SELECT project, version, row_number() OVER (PARTITION BY project, version
             ORDER BY degree DESC, implicit, ord) AS rank, id, centrality, degree
    FROM cent) WHERE rank <= 3)
"""


def w(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


Q: dict[str, str] = {}

Q["grf_simple_edges"] = w(FIX) + """
SELECT project, version, source, target, arg_max(type, ord) AS type, min(ord) AS ord
FROM dep_edges GROUP BY ALL"""

Q["grf_all_nodes"] = w(FIX) + "SELECT * FROM all_nodes"

Q["grf_graph_stats"] = w(FIX) + """
SELECT n.project, n.version, n.node_count, e.edge_count, s.total_loc, s.total_classes,
       round(s.avg_coupling, 6) AS avg_coupling
FROM (SELECT project, version, count(*) AS node_count FROM all_nodes GROUP BY ALL) n
JOIN (SELECT project, version, count(*) AS edge_count FROM pairs GROUP BY ALL) e USING (project, version)
LEFT JOIN sysm s USING (project, version)"""

Q["grf_raw_edge_count"] = w(FIX) + "SELECT project, version, count(*) AS raw_edges FROM dep_edges GROUP BY ALL"

Q["dif_added_nodes"] = w(FIX) + "SELECT project, v_old, v_new, id FROM node_mem WHERE m = 2"
Q["dif_removed_nodes"] = w(FIX) + "SELECT project, v_old, v_new, id FROM node_mem WHERE m = 1"
Q["dif_added_edges"] = w(FIX) + "SELECT project, v_old, v_new, source, target FROM edge_mem WHERE m = 2"
Q["dif_removed_edges"] = w(FIX) + "SELECT project, v_old, v_new, source, target FROM edge_mem WHERE m = 1"

DIFF_SUMMARY = """
diff_summary AS (
  SELECT t.project, t.v_old, t.v_new,
         CAST(coalesce(n.added_nodes, 0) AS BIGINT) AS added_nodes,
         CAST(coalesce(n.removed_nodes, 0) AS BIGINT) AS removed_nodes,
         CAST(coalesce(e.added_edges, 0) AS BIGINT) AS added_edges,
         CAST(coalesce(e.removed_edges, 0) AS BIGINT) AS removed_edges,
         CAST(coalesce(c.new_cycles, 0) AS BIGINT) AS new_cycles,
         CAST(coalesce(c.broken_cycles, 0) AS BIGINT) AS broken_cycles
  FROM transitions t
  LEFT JOIN (SELECT project, v_old, v_new, count_if(m = 2) AS added_nodes, count_if(m = 1) AS removed_nodes
             FROM node_mem GROUP BY ALL) n USING (project, v_old, v_new)
  LEFT JOIN (SELECT project, v_old, v_new, count_if(m = 2) AS added_edges, count_if(m = 1) AS removed_edges
             FROM edge_mem GROUP BY ALL) e USING (project, v_old, v_new)
  LEFT JOIN (SELECT project, v_old, v_new, count_if(change = 'new') AS new_cycles,
                    count_if(change = 'broken') AS broken_cycles FROM cyc_changes GROUP BY ALL) c
    USING (project, v_old, v_new))
"""

Q["dif_diff_summary"] = w(FIX, CYC, CYC_CHANGES, DIFF_SUMMARY) + "SELECT * FROM diff_summary"

Q["dif_node_status"] = w(FIX) + """
, sides AS (
  SELECT t.project, t.v_old, t.v_new, n.*, CASE n.version WHEN 'v1' THEN 1 ELSE 2 END AS side
  FROM transitions t JOIN all_nodes n ON n.project = t.project),
agg AS (
  SELECT project, v_old, v_new, id, bit_or(side) AS m,
    max(CASE WHEN side = 1 THEN struct_pack(name, type, file_path, loc, complexity, coupling, inheritance_depth, implicit) END) AS a_old,
    max(CASE WHEN side = 2 THEN struct_pack(name, type, file_path, loc, complexity, coupling, inheritance_depth, implicit) END) AS a_new
  FROM sides GROUP BY project, v_old, v_new, id)
SELECT project, v_old, v_new, id,
       CASE WHEN m = 2 THEN 'ADDED' WHEN m = 1 THEN 'REMOVED'
            WHEN a_old IS NOT DISTINCT FROM a_new THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status,
       coalesce(a_new, a_old).type AS type, coalesce(a_new, a_old).loc AS loc,
       coalesce(a_new, a_old).complexity AS complexity, coalesce(a_new, a_old).coupling AS coupling
FROM agg"""

Q["dif_edge_flags"] = w(FIX, CYC, CYC_CHANGES) + """
, cyc_e AS (
  SELECT DISTINCT project, v_old, v_new, CAST(parts[i] AS BIGINT) AS source,
         CAST(parts[CASE WHEN i = len(parts) THEN 1 ELSE i + 1 END] AS BIGINT) AS target
  FROM (SELECT *, string_split(cycle_str, '>') AS parts FROM cyc_changes WHERE change = 'new'),
       range(1, 64) r(i) WHERE i <= len(parts))
SELECT m.project, m.v_old, m.v_new, m.source, m.target, m.m = 2 AS is_added,
       c.source IS NOT NULL AS is_cycle
FROM edge_mem m LEFT JOIN cyc_e c USING (project, v_old, v_new, source, target)
WHERE m.m <> 1"""

Q["dif_size_change"] = w(FIX) + """
SELECT t.project, t.v_old, t.v_new, a.total_loc AS loc_v1, b.total_loc AS loc_v2,
       b.total_loc - a.total_loc AS loc_change, a.total_classes AS classes_v1,
       b.total_classes AS classes_v2, b.total_classes - a.total_classes AS class_change
FROM transitions t JOIN sysm a ON a.project = t.project AND a.version = t.v_old
JOIN sysm b ON b.project = t.project AND b.version = t.v_new"""

Q["cyc_simple_cycles"] = w(FIX, CYC) + """
SELECT project, version, cycle_str, length, count(*) OVER (PARTITION BY project, version) AS n_cycles,
       5 AS length_bound FROM cyc"""

Q["cyc_cycle_changes"] = w(FIX, CYC, CYC_CHANGES) + "SELECT * FROM cyc_changes"

# Components: the one of each graph's node of highest degree is what that node reaches and is reached from; no other component
# touches it, so among the other nodes all pairs of reachability are few.
SCC = """
scc_piv AS (SELECT project, version, arg_max(id, struct_pack(d := degree, i := -id)) AS p FROM deg GROUP BY ALL),
scc_fwd AS (
  SELECT * FROM (WITH RECURSIVE f(project, version, id) AS (
    SELECT project, version, p FROM scc_piv
    UNION SELECT e.project, e.version, e.target FROM f JOIN pairs e ON e.project = f.project AND e.version = f.version AND e.source = f.id)
  SELECT * FROM f)),
scc_bwd AS (
  SELECT * FROM (WITH RECURSIVE f(project, version, id) AS (
    SELECT project, version, p FROM scc_piv
    UNION SELECT e.project, e.version, e.source FROM f JOIN pairs e ON e.project = f.project AND e.version = f.version AND e.target = f.id)
  SELECT * FROM f)),
scc_big AS (SELECT * FROM scc_fwd INTERSECT SELECT * FROM scc_bwd),
scc_rest AS (
  SELECT e.* FROM pairs e ANTI JOIN scc_big a ON a.project = e.project AND a.version = e.version AND a.id = e.source
  ANTI JOIN scc_big b ON b.project = e.project AND b.version = e.version AND b.id = e.target),
scc_reach AS (
  SELECT * FROM (WITH RECURSIVE f(project, version, s, t) AS (
    SELECT project, version, source, target FROM scc_rest
    UNION SELECT f.project, f.version, f.s, e.target FROM f JOIN scc_rest e
      ON e.project = f.project AND e.version = f.version AND e.source = f.t)
  SELECT * FROM f)),
scc_small AS (
  SELECT a.project, a.version, a.s AS id, min(a.t) AS least FROM scc_reach a JOIN scc_reach b
    ON b.project = a.project AND b.version = a.version AND b.s = a.t AND b.t = a.s GROUP BY ALL),
scc AS (
  SELECT n.project, n.version, n.id, CASE WHEN g.id IS NOT NULL THEN m.least ELSE coalesce(x.least, n.id) END AS scc
  FROM all_nodes n LEFT JOIN scc_big g USING (project, version, id)
  LEFT JOIN (SELECT project, version, min(id) AS least FROM scc_big GROUP BY ALL) m USING (project, version)
  LEFT JOIN scc_small x USING (project, version, id))
"""
Q["cyc_scc_labels"] = w(FIX, SCC) + "SELECT project, version, id, scc FROM scc"
Q["cyc_updated_labels"] = w(FIX, SCC) + """
SELECT s.project, s.version, s.id, s.scc FROM scc s JOIN transitions t ON t.project = s.project AND t.v_new = s.version"""
Q["cyc_has_new_cycle"] = w(FIX, SCC) + """
, hit AS (
  SELECT m.project, m.v_old, m.v_new, count(*) AS n FROM edge_mem m
  JOIN scc a ON a.project = m.project AND a.version = m.v_new AND a.id = m.source
  JOIN scc b ON b.project = m.project AND b.version = m.v_new AND b.id = m.target
  WHERE m.m = 2 AND a.scc = b.scc GROUP BY ALL)
SELECT t.project, t.v_old, t.v_new, hit.n IS NOT NULL AS has_new_cycle FROM transitions t LEFT JOIN hit USING (project, v_old, v_new)"""

Q["cyc_exact_counts"] = """
WITH l AS (
  SELECT o_orderpriority AS project, 's' || ((year(o_orderdate) * 12 + month(o_orderdate)) // 6) AS version, l_partkey AS s,
         lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT DISTINCT project, version, s, t FROM l WHERE t IS NOT NULL),
rch AS (  -- nodes on a cycle: those that reach themselves
  SELECT * FROM (WITH RECURSIVE f(project, version, s, t) AS (
    SELECT project, version, s, t FROM e
    UNION SELECT f.project, f.version, f.s, e.t FROM f JOIN e ON e.project = f.project AND e.version = f.version AND e.s = f.t)
  SELECT * FROM f WHERE s = t)),
ce AS (SELECT e.* FROM e SEMI JOIN rch a ON a.project = e.project AND a.version = e.version AND a.s = e.s
       SEMI JOIN rch b ON b.project = e.project AND b.version = e.version AND b.s = e.t),
p AS (  -- simple paths from the least node of the cycle
  SELECT * FROM (WITH RECURSIVE f(project, version, r, x, seen) AS (
    SELECT project, version, s, t, [s, t] FROM ce WHERE t > s
    UNION ALL SELECT f.project, f.version, f.r, ce.t, list_append(f.seen, ce.t) FROM f JOIN ce
      ON ce.project = f.project AND ce.version = f.version AND ce.s = f.x AND ce.t > f.r AND NOT list_contains(f.seen, ce.t))
  SELECT * FROM f)),
c AS (SELECT p.project, p.version, len(p.seen) AS length FROM p JOIN ce ON ce.project = p.project AND ce.version = p.version
        AND ce.s = p.x AND ce.t = p.r
      UNION ALL SELECT project, version, 1 FROM ce WHERE s = t)
SELECT g.project, g.version, count(c.length) AS n_cycles, coalesce(count_if(c.length = 1), 0) AS n_self_loops,
       CAST(coalesce(max(c.length), 0) AS BIGINT) AS longest, CAST(NULL AS INTEGER) AS length_bound, 'counted' AS status
FROM (SELECT DISTINCT project, version FROM e) g LEFT JOIN c USING (project, version) GROUP BY ALL"""

Q["cyc_canonical_cycle"] = w(FIX, CYC) + """
, arr AS (SELECT project, version, cycle_str, string_split(cycle_str, '>') AS c,
                 length // 2 AS k FROM cyc),
rot AS (SELECT *, list_concat(list_slice(c, k + 1, len(c)), list_slice(c, 1, k)) AS r FROM arr),
rotn AS (SELECT *, list_transform(r, lambda x: CAST(x AS BIGINT)) AS rn FROM rot),
canon AS (SELECT *, list_position(rn, list_min(rn)) AS p FROM rotn)
SELECT project, version, cycle_str, array_to_string(r, '>') AS rotated_str,
       array_to_string(list_concat(list_slice(rn, p, len(rn)), list_slice(rn, 1, p - 1)), '>') AS canonical_str
FROM canon"""

Q["cyc_cycle_edges"] = w(FIX, CYC) + """
SELECT project, version, cycle_str, CAST(i AS BIGINT) AS pos, CAST(parts[i] AS BIGINT) AS source,
       CAST(parts[CASE WHEN i = len(parts) THEN 1 ELSE i + 1 END] AS BIGINT) AS target
FROM (SELECT *, string_split(cycle_str, '>') AS parts FROM cyc), range(1, 64) r(i)
WHERE i <= len(parts)"""

Q["cyc_cycle_counts"] = w(FIX, CYC) + """
SELECT g.project, g.version, coalesce(c.n, 0) AS n_cycles, coalesce(c.n1, 0) AS n_self_loops,
       coalesce(c.longest, 0) AS longest
FROM (SELECT DISTINCT project, version FROM dep_edges) g
LEFT JOIN (SELECT project, version, count(*) AS n, count_if(length = 1) AS n1, max(length) AS longest
           FROM cyc GROUP BY ALL) c USING (project, version)"""

Q["met_degrees"] = w(FIX) + "SELECT project, version, id, in_deg, out_deg, degree, implicit FROM deg"
Q["met_degree_centrality"] = w(FIX) + \
    "SELECT project, version, id, n_nodes, round(centrality, 6) AS centrality FROM cent"
Q["met_coupling"] = w(FIX) + "SELECT project, version, id, coupling_value FROM coup"
Q["met_top_hubs"] = w(FIX, HUBS) + \
    "SELECT project, version, rank, id, round(centrality, 6) AS centrality, degree FROM hubs"
Q["met_coupling_anomalies"] = w(FIX, ANOM) + """
SELECT project, version, id, coupling, z_score, round(mean, 6) AS mean, round(std, 6) AS std,
       round(threshold, 6) AS threshold FROM anom"""
Q["met_system_metrics"] = w(FIX) + \
    "SELECT project, version, total_loc, total_classes, round(avg_coupling, 6) AS avg_coupling FROM sysm"
Q["met_fan_metrics"] = w(FIX) + """
SELECT n.project, n.version, n.id, CAST(coalesce(i.c, 0) AS BIGINT) AS fan_in,
       CAST(coalesce(o.c, 0) AS BIGINT) AS fan_out,
       CAST(coalesce(i.c, 0) + coalesce(o.c, 0) AS BIGINT) AS fan_coupling
FROM dep_nodes n
LEFT JOIN (SELECT project, version, target AS id, count(*) AS c FROM dep_edges GROUP BY ALL) i
  USING (project, version, id)
LEFT JOIN (SELECT project, version, source AS id, count(*) AS c FROM dep_edges GROUP BY ALL) o
  USING (project, version, id)"""

VIOL = """
viol AS (
  SELECT p_name AS basename, l_linestatus AS rule, l_linenumber AS priority
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R')
"""

Q["met_merge_static_analysis"] = w(FIX, VIOL) + """
SELECT n.project, n.version, n.id, CAST(coalesce(v.c, 0) AS BIGINT) AS violation_count
FROM dep_nodes n LEFT JOIN (SELECT basename, count(*) AS c FROM viol GROUP BY ALL) v
  ON v.basename = string_split(n.file_path, '/')[-1]"""

Q["met_over_limit"] = w(FIX) + """
SELECT project, version, id, 'coupling' AS metric, coalesce(coupling, 0) AS value FROM dep_nodes
WHERE coalesce(coupling, 0) > 7
UNION ALL
SELECT project, version, id, 'inheritance_depth', coalesce(inheritance_depth, 0) FROM dep_nodes
WHERE coalesce(inheritance_depth, 0) > 3"""

Q["met_kpis"] = w(FIX, CYC, CYC_CHANGES) + """
SELECT t.project, t.v_old, t.v_new, s.total_loc, s.total_classes, round(s.avg_coupling, 2) AS avg_coupling,
       CAST(coalesce(c.n, 0) AS BIGINT) AS new_cycles
FROM transitions t LEFT JOIN sysm s ON s.project = t.project AND s.version = t.v_new
LEFT JOIN (SELECT project, v_old, v_new, count(*) AS n FROM cyc_changes WHERE change = 'new' GROUP BY ALL) c
  ON c.project = t.project AND c.v_old = t.v_old AND c.v_new = t.v_new"""


# ------------------------------------------------------------------ INT
def _q(x: str) -> str:
    return x.replace("'", "''")


_CYC_MSG = ("'VIOLATION: New cyclic dependencies detected (' || new_cycles || ' new cycles). "
            "This breaches the intent to ''{i}''.'")
_CHG_MSG = ("'VIOLATION: High volume of changes detected (added ' || added_nodes || ' nodes, ' || "
            "added_edges || ' edges). This breaches the intent to ''{i}''.'")
_RESOLVED = "RESOLVED: Overrode 'Minimize changes' to allow structural refactoring for cycle removal."
_CONFLICTS = [
    "Conflict detected: The intent to 'Avoid cyclic dependencies' requires refactoring actions "
    "(adding/removing classes), which contradicts the intent to 'Minimize changes and complexity increase'.",
    "Resolution: Prioritized cycle prevention (Priority 1) over change minimization (Priority 3). "
    "The system recommends proceeding with refactoring to eliminate circular dependencies.",
]


def _judged(resolve: bool, src: str = "diff_summary",
            intents=("avoid cyclic dependencies", "minimize changes and complexity increase")) -> str:
    """Violations of the fixture intents (both rule intents present -> conflict rule applies)."""
    msgs = []
    for t in intents:
        low = t.lower()
        if "avoid cyclic" in low:
            msgs.append(f"CASE WHEN new_cycles > 0 THEN {_CYC_MSG.format(i=_q(t))} END")
        if "minimize changes" in low:
            msgs.append(f"CASE WHEN added_nodes > 10 OR added_edges > 20 THEN {_CHG_MSG.format(i=_q(t))} END")
    raw = f"list_filter([{', '.join(msgs)}]::VARCHAR[], lambda x: x IS NOT NULL)"
    lows = [t.lower() for t in intents]
    conflict_possible = resolve and any("cycle" in t or "cyclic" in t for t in lows) and \
        any("minimize changes" in t or "stability" in t for t in lows)
    if conflict_possible:
        viol = (f"CASE WHEN new_cycles > 0 THEN list_concat(list_filter({raw}, "
                f"lambda x: NOT contains(lower(x), 'minimize changes')), ['{_q(_RESOLVED)}']) ELSE {raw} END")
        conf = (f"CASE WHEN new_cycles > 0 THEN ['{_q(_CONFLICTS[0])}', '{_q(_CONFLICTS[1])}'] "
                f"ELSE []::VARCHAR[] END")
    else:
        viol, conf = raw, "[]::VARCHAR[]"
    return f"""
judged AS (
  SELECT *, CASE WHEN len(list_filter(violations, lambda v: starts_with(v, 'VIOLATION'))) > 0
                 THEN 'VIOLATION' ELSE 'CONFORMING' END AS intent_status
  FROM (SELECT d.*, {viol} AS violations, {conf} AS conflicts FROM {src} d))
"""


_JCOLS = """
SELECT project, v_old, v_new, CAST(len(violations) AS BIGINT) AS n_violations,
       array_to_string(violations, ' | ') AS violations, CAST(len(conflicts) AS BIGINT) AS n_conflicts,
       intent_status FROM judged"""

Q["int_intent_violations"] = w(FIX, CYC, CYC_CHANGES, DIFF_SUMMARY, _judged(False)) + _JCOLS
Q["int_resolve_conflicts"] = w(FIX, CYC, CYC_CHANGES, DIFF_SUMMARY, _judged(True)) + _JCOLS

Q["int_limit_violations"] = w(FIX) + """
, nv AS (SELECT n.*, t.v_old, t.v_new FROM dep_nodes n JOIN transitions t
         ON n.project = t.project AND n.version = t.v_new)
SELECT project, v_old, v_new, 3 AS intent_id, 'max-coupling' AS kind, 7 AS "limit", id,
       coalesce(coupling, 0) AS value FROM nv WHERE coalesce(coupling, 0) > 7
UNION ALL
SELECT project, v_old, v_new, 4, 'max-inheritance', 3, id, coalesce(inheritance_depth, 0)
FROM nv WHERE coalesce(inheritance_depth, 0) > 3"""

Q["int_intent_status"] = w(FIX, CYC, CYC_CHANGES, DIFF_SUMMARY, _judged(True)) + """
SELECT j.project, j.v_old, j.v_new, j.intent_status,
       CASE WHEN EXISTS (SELECT 1 FROM dep_nodes n WHERE n.project = j.project AND n.version = j.v_new
                         AND coalesce(n.coupling, 0) > 7) THEN 'NON-CONFORMANT' ELSE 'CONFORMANT' END
         AS conformance
FROM judged j"""

_REPORT = """
hubs_v2 AS (SELECT h.project, string_agg(CAST(h.id AS VARCHAR), ', ' ORDER BY h.rank) AS hubs
            FROM hubs h JOIN transitions t ON h.project = t.project AND h.version = t.v_new GROUP BY 1),
anom_v2 AS (SELECT a.*, t.v_old, t.v_new FROM anom a JOIN transitions t
            ON a.project = t.project AND a.version = t.v_new),
n_anom AS (SELECT project, count(*) AS n FROM anom_v2 GROUP BY 1),
jj AS (SELECT j.*, coalesce(h.hubs, '') AS hubs, coalesce(a.n, 0) AS n_anom FROM judged j
       LEFT JOIN hubs_v2 h ON h.project = j.project LEFT JOIN n_anom a ON a.project = j.project),
fixed AS (
  SELECT project, v_old, v_new, x.sec, x.sub, x.line FROM jj, (SELECT unnest([
    {'sec': 0, 'sub': 0, 'line': 'Architectural Evolution Report (Version ' || v_old || ' -> ' || v_new || ')'},
    {'sec': 0, 'sub': 1, 'line': repeat('=', 59)},
    {'sec': 1, 'sub': 0, 'line': '1. Structural Changes:'},
    {'sec': 1, 'sub': 1, 'line': '   * Added Nodes: ' || added_nodes},
    {'sec': 1, 'sub': 2, 'line': '   * Added Dependencies (Edges): ' || added_edges},
    {'sec': 1, 'sub': 3, 'line': '   * Removed Nodes: ' || removed_nodes},
    {'sec': 1, 'sub': 4, 'line': '   * Removed Dependencies (Edges): ' || removed_edges},
    {'sec': 1, 'sub': 5, 'line': ''},
    {'sec': 2, 'sub': 0, 'line': '2. Dependency Cycles:'},
    {'sec': 2, 'sub': 1, 'line': '   * New Cycles Detected: ' || new_cycles},
    {'sec': 2, 'sub': 2, 'line': '   * Broken Cycles: ' || broken_cycles},
    {'sec': 2, 'sub': 3, 'line': ''},
    {'sec': 3, 'sub': 0, 'line': '3. Coupling & Complexity Hubs:'},
    {'sec': 3, 'sub': 1, 'line': '   * Top Coupled Nodes in New Version: ' || hubs},
    {'sec': 3, 'sub': 2, 'line': CASE WHEN n_anom > 0 THEN '   * Outlier Coupling Anomalies Detected:'
        ELSE '   * Coupling Anomalies: None (all nodes within standard variance)' END},
    {'sec': 3, 'sub': 9, 'line': ''},
    {'sec': 4, 'sub': 0, 'line': '4. Intent Conformance Evaluation:'},
    {'sec': 6, 'sub': 0, 'line': ''},
    {'sec': 6, 'sub': 1, 'line': '6. Recommendations:'},
    {'sec': 6, 'sub': 2, 'line': CASE WHEN new_cycles > 0 THEN
        '   * Action required: Break the newly introduced dependency cycle(s) to preserve modular boundaries.'
        ELSE '   * Codebase structure is clean. Modularity is preserved.' END}
  ]) AS x)),
report_lines AS (
  SELECT project, v_old, v_new, sec, sub, false AS k1, CAST(0 AS BIGINT) AS k2, line FROM fixed
  UNION ALL
  SELECT project, v_old, v_new, 4, 1, false, CAST(i AS BIGINT), '   * ' || violations[i + 1]
  FROM (SELECT *, unnest(range(len(violations))) AS i FROM jj WHERE len(violations) > 0)
  UNION ALL
  SELECT project, v_old, v_new, 4, 1, false, CAST(0 AS BIGINT),
         '   * All intents successfully satisfied. No modularity or cycle violations detected.'
  FROM jj WHERE len(violations) = 0
  UNION ALL
  SELECT project, v_old, v_new, 5, 0, false, CAST(0 AS BIGINT), '' FROM jj WHERE len(conflicts) > 0
  UNION ALL
  SELECT project, v_old, v_new, 5, 1, false, CAST(0 AS BIGINT), '5. Intent Conflict Resolution Log:'
  FROM jj WHERE len(conflicts) > 0
  UNION ALL
  SELECT project, v_old, v_new, 5, 2, false, CAST(i AS BIGINT), '   * ' || conflicts[i + 1]
  FROM (SELECT *, unnest(range(len(conflicts))) AS i FROM jj WHERE len(conflicts) > 0)
  UNION ALL
  SELECT project, v_old, v_new, 3, 3, implicit, CAST(ord AS BIGINT),
         '     - ' || id || ' (coupling: ' || coupling || ', Z-score: ' || CAST(z_score AS VARCHAR) || ')'
  FROM anom_v2)
"""

Q["int_report_lines"] = w(FIX, CYC, CYC_CHANGES, DIFF_SUMMARY, _judged(True), HUBS, ANOM, _REPORT) + \
    "SELECT * FROM report_lines"

Q["int_evolution_analysis"] = w(FIX, CYC, CYC_CHANGES, DIFF_SUMMARY, _judged(True), HUBS, ANOM, _REPORT) + """
SELECT project, v_old, v_new, added_nodes, removed_nodes, added_edges, removed_edges, new_cycles,
       broken_cycles, hubs AS top_hubs, CAST(n_anom AS BIGINT) AS n_anomalies,
       CAST(len(violations) AS BIGINT) AS n_violations, intent_status FROM jj"""

Q["int_evolution_reuse"] = Q["int_evolution_analysis"].replace(
    "intent_status FROM jj", "intent_status, project IN ('1-URGENT', '5-LOW') AS reused FROM jj")

Q["int_evolution_analysis_for"] = Q["int_evolution_analysis"].replace(
    "intent_status FROM jj", "intent_status, false AS reused FROM jj WHERE project = '3-MEDIUM'")

_PER_VERSION = """
per_v AS (
  SELECT s.project, s.version, s.total_classes, s.total_loc, e.n_edges, coalesce(c.n, 0) AS n_cycles
  FROM sysm s LEFT JOIN (SELECT project, version, count(*) AS n_edges FROM pairs GROUP BY ALL) e
    USING (project, version)
  LEFT JOIN (SELECT project, version, count(*) AS n FROM cyc GROUP BY ALL) c USING (project, version))
"""

Q["int_benchmark_status"] = w(FIX, CYC, CYC_CHANGES, DIFF_SUMMARY, _PER_VERSION) + """
SELECT d.project, d.v_old, d.v_new,
       CASE WHEN b.n_cycles > a.n_cycles OR b.total_classes - a.total_classes > 100
            THEN 'Violation' ELSE 'Satisfied' END AS status_a,
       CASE WHEN d.new_cycles > 0 OR d.added_nodes > 100 THEN 'Violation' ELSE 'Satisfied' END AS status_b
FROM diff_summary d JOIN per_v a ON a.project = d.project AND a.version = d.v_old
JOIN per_v b ON b.project = d.project AND b.version = d.v_new"""

Q["int_report_from_payload"] = w(FIX, CYC, CYC_CHANGES, DIFF_SUMMARY,
                                 _judged(True, intents=("avoid cyclic dependencies",))) + _JCOLS

INV_FIX = """
inventory AS (
  SELECT CAST(o_custkey AS VARCHAR) AS owner, CAST(o_orderkey AS VARCHAR) AS repo,
         CAST(trunc(o_totalprice) AS BIGINT) AS stars,
         (['Java', 'Python', 'Gleam', 'Erlang', 'Rust', 'JavaScript'])[o_custkey % 6 + 1] AS language,
         'v1' AS tag1, 'v2' AS tag2,
         CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'processing' WHEN 'F' THEN 'crawled' END AS status,
         CASE WHEN o_orderstatus = 'O' AND o_orderkey % 11 <> 0 THEN o_orderdate END AS claimed_at,
         CASE WHEN o_orderstatus = 'O' THEN 'w' || (o_orderkey % 4) END AS worker_id,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS processed_at,
         o_orderdate AS extraction_start_at, ls.last_ship AS extraction_end_at,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 1000 END AS loc_v1,
         o_orderkey AS repo_key, o_orderpriority AS graph_project
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) ls
    ON o_orderkey = ls.l_orderkey)
"""

Q["int_language_terms"] = w(INV_FIX) + """
SELECT owner, repo, language,
       CASE language WHEN 'Java' THEN 'class' WHEN 'Python' THEN 'module' ELSE 'file' END AS unit_singular,
       CASE language WHEN 'Java' THEN 'classes' WHEN 'Python' THEN 'modules' ELSE 'files' END AS unit_plural,
       CASE language WHEN 'Java' THEN 'cycle loops' WHEN 'Python' THEN 'circular imports'
                     ELSE 'dependency cycles' END AS cycle_term,
       CASE language WHEN 'Java' THEN 'edges' WHEN 'Python' THEN 'dependencies' ELSE 'imports' END AS dep_term,
       language NOT IN ('Java', 'Python') AS is_fallback
FROM inventory"""


# ------------------------------------------------------------------ VAL
_MSG = {
    "loc": "Every ClassEntity must have a Lines of Code (loc) metric specified as an integer.",
    "complexity": "Every ClassEntity must have a cyclomatic complexity metric specified as an integer.",
    "inheritanceDepth": "Every ClassEntity must have an inheritance depth metric specified as an integer.",
}

Q["val_class_metric_violations"] = w(FIX) + " UNION ALL ".join(
    f"SELECT project, version, id, '{k}' AS property, '{m}' AS message FROM dep_nodes "
    f"WHERE type = 'class' AND {c} IS NULL"
    for k, m, c in [("loc", _MSG["loc"], "loc"), ("complexity", _MSG["complexity"], "complexity"),
                    ("inheritanceDepth", _MSG["inheritanceDepth"], "inheritance_depth")])

_ENT = """
ent AS (SELECT DISTINCT project, version, id FROM dep_nodes
        WHERE type IN ('class', 'interface', 'module', 'package', 'file', 'function')
           OR loc IS NOT NULL OR complexity IS NOT NULL),
depe AS (SELECT * FROM dep_edges
         WHERE type IN ('calls', 'inherits', 'inheritance', 'imports', 'implements', 'aggregates', 'depends_on')),
endpoint_viol AS (
  SELECT project, version, source, target, type, 'source' AS property FROM depe e
  WHERE NOT EXISTS (SELECT 1 FROM ent n WHERE n.project = e.project AND n.version = e.version AND n.id = e.source)
  UNION ALL
  SELECT project, version, source, target, type, 'target' FROM depe e
  WHERE NOT EXISTS (SELECT 1 FROM ent n WHERE n.project = e.project AND n.version = e.version AND n.id = e.target))
"""

Q["val_edge_endpoint_violations"] = w(FIX, _ENT) + "SELECT * FROM endpoint_viol"

Q["val_entity_types"] = w(FIX) + """
SELECT project, version, id, type,
       CASE type WHEN 'class' THEN 'ClassEntity' WHEN 'interface' THEN 'InterfaceEntity'
                 WHEN 'module' THEN 'ModuleEntity' WHEN 'package' THEN 'ModuleEntity'
                 WHEN 'file' THEN 'ModuleEntity' WHEN 'function' THEN 'FunctionEntity' END AS entity_class,
       type IN ('class', 'interface', 'module', 'package', 'file', 'function') AS is_software_entity
FROM dep_nodes"""

Q["val_inferred_entities"] = w(FIX) + """
SELECT project, version, id,
       coalesce(type IN ('class', 'interface', 'module', 'package', 'file', 'function'), false)
       OR loc IS NOT NULL OR complexity IS NOT NULL AS is_entity
FROM all_nodes"""

Q["val_conformance_flags"] = w(FIX, _ENT) + """
, res AS (
  SELECT project, version FROM dep_nodes WHERE type = 'class' AND loc IS NULL
  UNION ALL SELECT project, version FROM dep_nodes WHERE type = 'class' AND complexity IS NULL
  UNION ALL SELECT project, version FROM dep_nodes WHERE type = 'class' AND inheritance_depth IS NULL
  UNION ALL SELECT project, version FROM endpoint_viol)
SELECT g.project, g.version, CAST(coalesce(r.n, 0) AS BIGINT) AS n_results, coalesce(r.n, 0) = 0 AS conforms
FROM (SELECT DISTINCT project, version FROM dep_edges) g
LEFT JOIN (SELECT project, version, count(*) AS n FROM res GROUP BY ALL) r USING (project, version)"""

Q["val_schema_violations"] = w(FIX) + """
SELECT project, version, scope, rule, count(*) AS n FROM (
  SELECT project, version, 'edge' AS scope, 'enum:type' AS rule FROM dep_edges
  WHERE type NOT IN ('calls', 'inherits', 'imports', 'implements', 'aggregates', 'depends_on')
  UNION ALL
  SELECT project, version, 'node', 'enum:type' FROM dep_nodes
  WHERE type NOT IN ('class', 'interface', 'module', 'package', 'file', 'function')
  UNION ALL
  SELECT project, version, 'node', 'required:name' FROM dep_nodes WHERE name IS NULL)
GROUP BY ALL"""

FILES_FIX = """
files AS (
  SELECT source AS project, 'v1' AS version,
         CASE WHEN doc_id % 10 = 3 THEN 'build/' ELSE '' END || lang || '/' || doc_id ||
         (['.py', '.js', '.html', '.css', '.toml', '.sh', '.ttl', '.txt', '.java', '.gleam', '.erl', '.rs'])
           [doc_id % 12 + 1] AS path,
         lang AS language, text AS content, CAST(strlen(text) AS BIGINT) AS n_bytes, doc_id
  FROM documents)
"""

_LIC = """
lic AS (
  SELECT project, version, path,
         NOT (contains(content, 'Copyright') OR contains(content, 'Apache') OR contains(content, 'License'))
           AND n_bytes > 100 AS missing
  FROM files
  WHERE (path LIKE '%.py' OR path LIKE '%.js' OR path LIKE '%.html' OR path LIKE '%.css'
         OR path LIKE '%.toml' OR path LIKE '%.sh' OR path LIKE '%.ttl')
    AND NOT (contains(regexp_extract(path, '^(.*)/[^/]*$', 1), '.git')
          OR contains(regexp_extract(path, '^(.*)/[^/]*$', 1), '.github')
          OR contains(regexp_extract(path, '^(.*)/[^/]*$', 1), 'dist')
          OR contains(regexp_extract(path, '^(.*)/[^/]*$', 1), 'build')
          OR contains(regexp_extract(path, '^(.*)/[^/]*$', 1), 'node_modules')
          OR contains(regexp_extract(path, '^(.*)/[^/]*$', 1), '.tempmediaStorage')))
"""

Q["val_license_audit"] = w(FILES_FIX, _LIC) + """
SELECT project, version, count(*) AS audited, count_if(missing) AS missing, count_if(missing) = 0 AS ok
FROM lic GROUP BY ALL"""

Q["val_license_missing"] = w(FILES_FIX, _LIC) + "SELECT project, version, path FROM lic WHERE missing"

DISC_FIX = """
discovered AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS owner, c_mktsegment AS repo, CAST(trunc(c_acctbal) AS BIGINT) AS stars,
         'Java' AS language, c_custkey AS seq FROM customer
  UNION ALL
  SELECT CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), CAST(trunc(o_totalprice * 2) AS BIGINT), 'Java',
         o_orderkey + 1000000000 FROM orders WHERE o_orderstatus = 'F')
"""

Q["val_unique_key_check"] = w(DISC_FIX) + \
    "SELECT owner, repo, count(*) AS n FROM discovered GROUP BY ALL HAVING count(*) > 1"


# ------------------------------------------------------------------ INV
NOW_SQL = "TIMESTAMP '2001-08-01 00:00:00'"
CUTOFF = f"({NOW_SQL} - INTERVAL 30 MINUTE)"


def _star_values(min_stars: int) -> str:
    steps = [50, 50, 100, 100, 200, 200, 300, 500, 1000, 2000, 5000, 10000, 30000]
    rows, cur = [], min_stars
    for i, st in enumerate(steps):
        rows.append(f"({i}, {cur}, {cur + st})")
        cur += st + 1
    rows.append(f"({len(steps)}, {cur}, NULL)")
    return "ranges(range_idx, low, high) AS (SELECT * FROM (VALUES " + ", ".join(rows) + "))"


_BATCH = f"""
batch AS (
  SELECT owner, repo, stars, status, row_number() OVER (ORDER BY stars DESC NULLS LAST, owner, repo) AS rk
  FROM inventory WHERE status = 'pending' OR (status = 'processing' AND claimed_at < {CUTOFF})
  ORDER BY stars DESC NULLS LAST, owner, repo LIMIT 50),
claims AS (SELECT owner, repo, 'worker-' || ((rk - 1) % 4) AS worker_id FROM batch)
"""

Q["inv_upsert_discovered"] = w(INV_FIX, DISC_FIX) + """
, last AS (SELECT owner, repo, arg_max(stars, seq) AS d_stars, arg_max(language, seq) AS d_language
           FROM discovered GROUP BY ALL)
SELECT coalesce(i.owner, l.owner) AS owner, coalesce(i.repo, l.repo) AS repo,
       coalesce(l.d_stars, i.stars) AS stars, coalesce(l.d_language, i.language) AS language,
       CASE WHEN i.owner IS NULL THEN 'pending' ELSE i.status END AS status
FROM inventory i FULL JOIN last l ON i.owner = l.owner AND i.repo = l.repo"""

Q["inv_star_ranges"] = w(DISC_FIX, _star_values(0)) + """
SELECT d.owner, d.repo, d.seq, d.stars, r.range_idx, r.low, r.high FROM discovered d
LEFT JOIN ranges r ON d.stars >= r.low AND (r.high IS NULL OR d.stars <= r.high)"""

Q["inv_next_batch"] = w(INV_FIX, _BATCH) + "SELECT owner, repo, stars, status FROM batch"
Q["inv_assign_workers"] = w(INV_FIX, _BATCH) + \
    "SELECT owner, repo, CAST((rk - 1) % 4 AS INTEGER) AS worker_no FROM batch"

Q["inv_apply_claims"] = w(INV_FIX, _BATCH) + f"""
SELECT i.owner, i.repo, CASE WHEN c.owner IS NOT NULL THEN 'processing' ELSE i.status END AS status,
       CASE WHEN c.owner IS NOT NULL THEN {NOW_SQL} ELSE i.claimed_at END AS claimed_at,
       CASE WHEN c.owner IS NOT NULL THEN c.worker_id ELSE i.worker_id END AS worker_id
FROM inventory i LEFT JOIN claims c ON i.owner = c.owner AND i.repo = c.repo"""

Q["inv_claim_history"] = w(INV_FIX, _BATCH) + f"""
SELECT i.owner, i.repo, i.status AS from_status, 'processing' AS to_status, {NOW_SQL} AS transitioned_at,
       CAST(NULL AS VARCHAR) AS error_msg, c.worker_id
FROM inventory i JOIN claims c ON i.owner = c.owner AND i.repo = c.repo"""

_UPD = """
upd AS (SELECT owner, repo, CASE WHEN loc_v1 IS NULL THEN 'failed' ELSE 'crawled' END AS u_status,
               CASE WHEN loc_v1 IS NULL THEN 'Validation failed' END AS u_error,
               extraction_end_at AS u_ts, worker_id AS u_worker
        FROM inventory WHERE status = 'processing')
"""

Q["inv_apply_status"] = w(INV_FIX, _UPD) + """
SELECT i.owner, i.repo, CASE WHEN u.owner IS NOT NULL THEN u.u_status ELSE i.status END AS status,
       CASE WHEN u.owner IS NOT NULL THEN u.u_error ELSE NULL END AS error_msg,
       CASE WHEN u.owner IS NOT NULL THEN u.u_ts ELSE i.processed_at END AS processed_at
FROM inventory i LEFT JOIN upd u ON i.owner = u.owner AND i.repo = u.repo"""

Q["inv_status_history"] = w(INV_FIX, _UPD) + """
SELECT i.owner, i.repo, i.status AS from_status, u.u_status AS to_status, u.u_ts AS transitioned_at,
       u.u_error AS error_msg, u.u_worker AS worker_id
FROM inventory i JOIN upd u ON i.owner = u.owner AND i.repo = u.repo"""

Q["inv_apply_heartbeats"] = w(INV_FIX) + """
, beats AS (SELECT CAST(o_custkey AS VARCHAR) AS owner, CAST(o_orderkey AS VARCHAR) AS repo,
                   max(l_shipdate) AS beat
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT i.owner, i.repo, i.status,
       CASE WHEN i.status = 'processing' AND b.beat IS NOT NULL THEN b.beat ELSE i.claimed_at END AS claimed_at
FROM inventory i LEFT JOIN beats b ON i.owner = b.owner AND i.repo = b.repo"""

_STALE = f"coalesce(status = 'processing' AND claimed_at < {CUTOFF}, false)"

Q["inv_requeue_stale"] = w(INV_FIX) + f"""
SELECT owner, repo, CASE WHEN {_STALE} THEN 'pending' ELSE status END AS status,
       CASE WHEN {_STALE} THEN NULL ELSE worker_id END AS worker_id,
       CASE WHEN {_STALE} THEN NULL ELSE claimed_at END AS claimed_at
FROM inventory"""

Q["inv_stale_history"] = w(INV_FIX) + f"""
SELECT owner, repo, 'processing' AS from_status, 'pending' AS to_status, {NOW_SQL} AS transitioned_at,
       'stale reclaim' AS error_msg, CAST(NULL AS VARCHAR) AS worker_id
FROM inventory WHERE {_STALE}"""

EVENTS_FIX = """
status_events AS (
  SELECT 'o' AS owner, CAST(user_id AS VARCHAR) AS repo,
         lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status,
         event_type AS to_status, ts AS transitioned_at,
         CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error_msg,
         'w' || (user_id % 4) AS worker_id, event_id, user_id AS repo_key
  FROM (SELECT * REPLACE (CASE WHEN event_type = 'view' THEN 'processing' ELSE event_type END AS event_type)
        FROM events))
"""

Q["inv_current_status"] = w(EVENTS_FIX) + """
SELECT owner, repo, to_status AS status, since FROM (
  SELECT *, row_number() OVER (PARTITION BY owner, repo ORDER BY transitioned_at DESC, event_id DESC) AS rn,
         max(transitioned_at) OVER (PARTITION BY owner, repo) AS since
  FROM status_events) WHERE rn = 1"""


def _align_sql() -> str:
    from evograph.operators.inventory import INVENTORY_SCHEMA
    tmap = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP"}
    have = {"owner", "repo", "stars", "status"}
    cols = []
    for f in INVENTORY_SCHEMA.fields:
        t = tmap[f.dataType.simpleString()]
        if f.name in have:
            cols.append(f"CAST({f.name} AS {t}) AS {f.name}")
        elif f.name == "language":
            cols.append(f"CAST('java' AS {t}) AS language")
        else:
            cols.append(f"CAST(NULL AS {t}) AS {f.name}")
    return "SELECT " + ", ".join(cols) + " FROM inventory"


Q["inv_align_schema"] = w(INV_FIX) + _align_sql()
Q["inv_status_counts"] = w(INV_FIX) + "SELECT status, count(*) AS n FROM inventory GROUP BY ALL"

Q["inv_recent_transitions"] = w(INV_FIX, EVENTS_FIX) + """
SELECT i.owner, i.repo, e.from_status, e.to_status, e.transitioned_at, e.error_msg
FROM status_events e JOIN inventory i ON e.repo_key = i.repo_key
ORDER BY e.transitioned_at DESC, e.event_id DESC LIMIT 10"""

Q["inv_missing_metrics"] = w(INV_FIX) + \
    "SELECT owner, repo FROM inventory WHERE status = 'crawled' AND loc_v1 IS NULL"

_STRINGS = """
hub_str AS (SELECT h.project, string_agg(CAST(h.id AS VARCHAR), ', ' ORDER BY h.rank) AS top_hubs
            FROM hubs h JOIN transitions t ON h.project = t.project AND h.version = t.v_new GROUP BY 1),
anom_str AS (SELECT a.project, string_agg(a.id || ' (coupling: ' || a.coupling || ', z-score: '
                                           || CAST(a.z_score AS VARCHAR) || ')', ', ' ORDER BY a.implicit, a.ord)
                                AS coupling_anomalies
             FROM anom a JOIN transitions t ON a.project = t.project AND a.version = t.v_new GROUP BY 1),
strings AS (SELECT t.project, t.v_old, t.v_new, coalesce(h.top_hubs, '') AS top_hubs,
                   coalesce(a.coupling_anomalies, '') AS coupling_anomalies
            FROM transitions t LEFT JOIN hub_str h ON h.project = t.project
            LEFT JOIN anom_str a ON a.project = t.project)
"""

Q["inv_hub_and_anomaly_strings"] = w(FIX, HUBS, ANOM, _STRINGS) + "SELECT * FROM strings"

Q["inv_extraction_duration"] = w(INV_FIX) + """
SELECT owner, repo, date_diff('second', extraction_start_at, extraction_end_at) AS extraction_seconds
FROM inventory"""

_CONF = """
cres AS (
  SELECT project, version FROM dep_nodes WHERE type = 'class' AND inheritance_depth IS NULL
  UNION ALL SELECT project, version FROM endpoint_viol),
conf AS (SELECT g.project, g.version, coalesce(r.n, 0) = 0 AS conforms
         FROM (SELECT DISTINCT project, version FROM dep_edges) g
         LEFT JOIN (SELECT project, version, count(*) AS n FROM cres GROUP BY ALL) r USING (project, version)),
pt AS (
  SELECT j.project, j.v_old, j.v_new, a.total_loc AS loc_v1, b.total_loc AS loc_v2,
         a.total_classes AS classes_v1, b.total_classes AS classes_v2,
         a.avg_coupling AS coupling_v1, b.avg_coupling AS coupling_v2,
         ca.conforms AS conforms_v1, cb.conforms AS conforms_v2,
         j.added_nodes, j.removed_nodes, j.added_edges, j.removed_edges, j.new_cycles, j.broken_cycles,
         j.intent_status, s.top_hubs, s.coupling_anomalies
  FROM judged j
  JOIN sysm a ON a.project = j.project AND a.version = j.v_old
  JOIN sysm b ON b.project = j.project AND b.version = j.v_new
  JOIN conf ca ON ca.project = j.project AND ca.version = j.v_old
  JOIN conf cb ON cb.project = j.project AND cb.version = j.v_new
  JOIN strings s ON s.project = j.project)
"""

_BF_COLS = ["loc_v1", "loc_v2", "classes_v1", "classes_v2", "coupling_v1", "coupling_v2", "conforms_v1",
            "conforms_v2", "added_nodes", "removed_nodes", "added_edges", "removed_edges", "new_cycles",
            "broken_cycles", "intent_status", "top_hubs", "coupling_anomalies"]


def _bf_select() -> str:
    todo = "(i.status = 'crawled' AND i.loc_v1 IS NULL AND p.project IS NOT NULL)"
    out = []
    for c in _BF_COLS:
        src = "i.loc_v1" if c == "loc_v1" else "NULL"
        expr = f"CASE WHEN {todo} THEN p.{c} ELSE {src} END"
        if c.startswith("coupling_v"):
            expr = f"round({expr}, 6)"
        if c == "loc_v1":
            expr = f"CAST({expr} AS BIGINT)"
        out.append(f"{expr} AS {c}")
    return ("SELECT i.owner, i.repo, i.status, " + ", ".join(out) +
            " FROM inventory i LEFT JOIN pt p ON p.project = i.graph_project AND p.v_old = i.tag1 "
            "AND p.v_new = i.tag2")


Q["inv_backfill_metrics"] = w(FIX, CYC, CYC_CHANGES, DIFF_SUMMARY, _judged(True), HUBS, ANOM, _STRINGS,
                              _ENT, _CONF, INV_FIX) + _bf_select()


# ------------------------------------------------------------------ STA
Q["sta_project_summary"] = w(FIX) + """
SELECT s.project, s.version, s.total_classes AS classes, coalesce(e.n, 0) AS edges, s.total_loc AS loc,
       round(s.avg_coupling, 3) AS avg_coupling
FROM sysm s LEFT JOIN (SELECT project, version, count(*) AS n FROM dep_edges GROUP BY ALL) e
  USING (project, version)"""

Q["sta_evolution_comparison"] = w(FIX, CYC, CYC_CHANGES, DIFF_SUMMARY, _PER_VERSION) + """
SELECT d.project, d.v_old, d.v_new, a.total_classes AS classes_v1, b.total_classes AS classes_v2,
       a.total_loc AS loc_v1, b.total_loc AS loc_v2, a.n_edges AS edges_v1, b.n_edges AS edges_v2,
       a.n_cycles AS cycles_v1, b.n_cycles AS cycles_v2, d.added_nodes, d.removed_nodes, d.added_edges,
       d.removed_edges,
       CASE WHEN b.n_cycles > a.n_cycles OR b.total_classes - a.total_classes > 100
            THEN 'Violation' ELSE 'Satisfied' END AS status
FROM diff_summary d JOIN per_v a ON a.project = d.project AND a.version = d.v_old
JOIN per_v b ON b.project = d.project AND b.version = d.v_new"""

Q["sta_evolution_comparison_fast"] = w(FIX, CYC, CYC_CHANGES, DIFF_SUMMARY, _PER_VERSION) + """
SELECT d.project, d.v_old, d.v_new, a.total_loc AS loc_v1, b.total_loc AS loc_v2,
       a.total_classes AS classes_v1, b.total_classes AS classes_v2, a.n_edges AS edges_v1,
       b.n_edges AS edges_v2, d.added_nodes, d.removed_nodes, d.added_edges, d.removed_edges,
       d.new_cycles, d.broken_cycles,
       CASE WHEN d.new_cycles > 0 OR d.added_nodes > 100 THEN 'Violation' ELSE 'Satisfied' END AS status
FROM diff_summary d JOIN per_v a ON a.project = d.project AND a.version = d.v_old
JOIN per_v b ON b.project = d.project AND b.version = d.v_new"""

Q["sta_display_names"] = w(INV_FIX) + """
SELECT owner, repo,
       CASE WHEN replace(language || '_' || owner, '_', '/') = 'reactive-streams/reactive-streams-jvm'
            THEN 'reactive-streams' ELSE replace(language || '_' || owner, '_', '/') END AS repo_name,
       replace(replace(replace(replace(replace(
         (['javapoet-', 'jsoup-', 'gson-parent-', 'open-source-java-design-patterns-'])[repo_key % 4 + 1]
           || repo || '_graph.json',
         '_graph.json', ''), 'javapoet-', ''), 'jsoup-', ''), 'gson-parent-', ''),
         'open-source-java-design-patterns-', '') AS version_name
FROM inventory"""


# ------------------------------------------------------------------ SRC / SNK
Q["snk_graph_text"] = w(FIX) + "SELECT project, version, CAST(id AS VARCHAR) AS id, type FROM dep_nodes"
Q["src_graph_text"] = w(FIX) + """
SELECT project, version, CAST(source AS VARCHAR) AS source, CAST(target AS VARCHAR) AS target, type
FROM dep_edges"""
Q["snk_graph_json"] = w(FIX) + """
SELECT project, version, ord, CAST(id AS VARCHAR) AS id, name, type, file_path, loc, complexity, coupling,
       inheritance_depth FROM dep_nodes"""
Q["src_graph_json"] = w(FIX) + """
SELECT project, version, min(ord) AS ord, CAST(source AS VARCHAR) AS source, CAST(target AS VARCHAR) AS target,
       arg_max(type, ord) AS type FROM dep_edges GROUP BY project, version, source, target"""
Q["src_search_pages"] = w(DISC_FIX) + "SELECT owner, repo, stars, 'java' AS language FROM discovered"
Q["src_adjacent_versions"] = """
WITH tags AS (
  SELECT CAST(o_custkey AS VARCHAR) AS owner, CAST(o_orderkey AS VARCHAR) AS repo,
         'v' || l_linenumber || '.' || l_partkey AS name, l_shipdate AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY owner, repo ORDER BY created_at DESC, name DESC) AS rn FROM tags)
SELECT owner, repo, max(CASE WHEN rn = 2 THEN name END) AS tag1, max(CASE WHEN rn = 1 THEN name END) AS tag2,
       CASE WHEN max(CASE WHEN rn = 2 THEN name END) IS NULL THEN 'Insufficient release tags found' END AS error_msg
FROM r WHERE rn <= 2 GROUP BY owner, repo"""
Q["src_read_inventory"] = w(INV_FIX) + """
SELECT owner, repo, stars, language, status, processed_at, loc_v1, CAST(NULL AS VARCHAR) AS error_msg
FROM inventory WHERE status = 'crawled'"""


def _export_sql() -> str:
    from evograph.sinks.writers import EXPORT_COLUMNS
    have = {"owner", "repo", "stars", "language", "tag1", "tag2", "status", "processed_at",
            "extraction_start_at", "extraction_end_at", "loc_v1"}
    from evograph.operators.inventory import INVENTORY_SCHEMA
    tmap = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP"}
    cols = []
    for c in EXPORT_COLUMNS:
        if c == "id":
            cols.append("repo_key AS id")
        elif c in have:
            cols.append(c)
        else:
            cols.append(f"CAST(NULL AS {tmap[INVENTORY_SCHEMA[c].dataType.simpleString()]}) AS {c}")
    return "SELECT " + ", ".join(cols) + " FROM inventory WHERE status = 'crawled'"


Q["snk_export_inventory"] = w(INV_FIX) + _export_sql()

Q["snk_ecosystem_summary"] = w(FIX, CYC, CYC_CHANGES, DIFF_SUMMARY, _judged(True), HUBS, ANOM, _STRINGS,
                               _ENT, _CONF, INV_FIX) + """
, cv AS (SELECT project, version, count(*) AS n FROM cyc GROUP BY ALL)
SELECT i.owner, i.repo, i.status, i.language, i.tag1, i.tag2, p.classes_v2, p.loc_v2,
       round(p.coupling_v2, 2) AS coupling_v2, coalesce(cv.n, CASE WHEN g.project IS NOT NULL THEN 0 END)
         AS cycles_v2, p.new_cycles,
       CASE WHEN p.intent_status IS NULL THEN NULL WHEN p.intent_status = 'VIOLATION' THEN 'NON-CONFORMANT'
            ELSE 'CONFORMANT' END AS conformance
FROM inventory i
LEFT JOIN pt p ON p.project = i.graph_project AND p.v_old = i.tag1 AND p.v_new = i.tag2
LEFT JOIN (SELECT DISTINCT project, version FROM dep_edges) g ON g.project = i.graph_project AND g.version = i.tag2
LEFT JOIN cv ON cv.project = i.graph_project AND cv.version = i.tag2"""

Q["snk_export_graphs"] = w(FIX, INV_FIX) + """
, want AS (SELECT DISTINCT graph_project AS project, unnest([tag1, tag2]) AS version FROM inventory WHERE status = 'crawled')
SELECT project, version FROM want SEMI JOIN sysm USING (project, version)"""

Q["snk_report_files"] = w(FIX, CYC, CYC_CHANGES, DIFF_SUMMARY, _judged(True), HUBS, ANOM, _REPORT) + """
SELECT project, v_old, v_new, count(*) AS n_lines, CAST(sum(octet_length(encode(line))) AS BIGINT) AS n_bytes
FROM report_lines GROUP BY ALL"""

Q["snk_class_diff_table"] = w(FIX) + """
SELECT t.project, t.v_old, t.v_new, n.id,
       CASE WHEN o.id IS NULL THEN 'ADDED' ELSE 'UNCHANGED' END AS status, n.loc, n.complexity, n.coupling, n.type
FROM transitions t JOIN dep_nodes n ON n.project = t.project AND n.version = t.v_new
LEFT JOIN dep_nodes o ON o.project = t.project AND o.version = t.v_old AND o.id = n.id"""


# ------------------------------------------------------------------ EXT
# Java corpus restated from the generation rule (see fixtures.java_files).
JAVA_FIX = r"""
jparts AS (SELECT p_partkey AS k, p_brand AS project FROM part),
jf0 AS (
  SELECT project, 'v1' AS version, k,
    'src/com/p' || (k % 7) || '/N' || (k // 7) || '_' || k || '.java' AS path,
    array_to_string([
      'package com.p' || (k % 7) || ';',
      '',
      CASE k % 3 WHEN 0 THEN 'import com.p' || ((k + 1) % 7) || '.N' || ((k + 1) // 7) || ';'
                 WHEN 1 THEN 'import com.p' || ((k + 1) % 7) || '.*;'
                 ELSE 'import static java.util.Collections.emptyList;' END,
      CASE WHEN k % 4 = 0 THEN 'import com.p' || ((k // 2) % 7) || '.N' || ((k // 2) // 7) || ';' ELSE '' END,
      '',
      CASE WHEN k % 6 = 0 THEN '/* block comment: if for while */' ELSE '// helper for N' || ((k + 2) // 7) END,
      CASE WHEN k % 9 = 0 THEN chr(9) || '// tab indented comment' ELSE '  ' END,
      'public class N' || (k // 7) ||
        CASE WHEN k % 5 = 0 THEN '' WHEN k % 7 = 0 THEN ' extends RuntimeException'
             ELSE ' extends N' || ((k // 2) // 7) END || ' {',
      '    private N' || ((k + 1) // 7) || ' next;',
      '    void run(int a, int b) {',
      CASE WHEN k % 2 = 0 THEN '        if (a > b && b > 0) { for (int i = 0; i < a; i++) { a--; } }'
           ELSE '        while (a > 0 || b > 0) { a--; b--; }' END,
      '    }',
      CASE WHEN k % 4 = 1 THEN '    static class Inner' || (k % 3) || ' { }' ELSE '' END,
      '}',
      CASE WHEN k % 11 = 0 THEN 'record R' || k || '(N' || ((k + 7) // 7) ||
                                ' left, java.util.List<String> names) { }' ELSE '' END,
      CASE WHEN k % 13 = 0 THEN 'sealed interface S' || k || ' permits N' || (k // 7) || ', N' || ((k + 7) // 7)
                                || ' { }' ELSE '' END
    ], chr(10)) AS c0
  FROM jparts),
jf AS (SELECT project, version, path, 'Java' AS language,
              CASE WHEN k % 17 = 0 THEN replace(c0, chr(10), chr(13) || chr(10)) ELSE c0 END AS content
       FROM jf0)
"""

_WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LB = r"\r\n|[\n\x{0B}\f\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
_JTYPE = (r"\b(?:sealed\s+|non-sealed\s+)?(?:class|interface|enum)\s+(\w+)(?:\s+extends\s+([\w\.]+))?"
          r"(?:\s+implements\s+([\w\.,\s]+))?(?:\s+permits\s+([\w\.,\s]+))?")
_JREC = r"\brecord\s+(\w+)\s*\((.*?)\)"

JDECL = rf"""
jmeta AS (
  SELECT project, version, path, regexp_extract(content, 'package\s+([\w\.]+);', 1) AS package,
         len(list_filter(regexp_split_to_array(content, '{_LB}'),
             lambda l: NOT regexp_matches(l, '^{_WS}*$') AND NOT regexp_matches(l, '^{_WS}*//'))) AS loc,
         1 + len(regexp_extract_all(content, '\b(if|for|while|catch)\b|&&|\|\|')) AS complexity
  FROM jf),
jimp AS (
  SELECT project, version, path, unnest(range(len(l))) AS pos, unnest(l) AS import
  FROM (SELECT *, regexp_extract_all(content, '(?m)^import\s+([\w\.\*]+);', 1) AS l FROM jf)),
jrec AS (
  SELECT project, version, path, unnest(range(len(n))) AS pos, unnest(n) AS name, unnest(p) AS params
  FROM (SELECT *, regexp_extract_all(content, '{_JREC}', 1) AS n, regexp_extract_all(content, '{_JREC}', 2) AS p
        FROM jf)),
jtyp0 AS (
  SELECT project, version, path, unnest(range(len(n))) AS pos, unnest(n) AS name, unnest(e) AS ext,
         unnest(pm) AS permits
  FROM (SELECT *, regexp_extract_all(content, '{_JTYPE}', 1) AS n, regexp_extract_all(content, '{_JTYPE}', 2) AS e,
               regexp_extract_all(content, '{_JTYPE}', 4) AS pm FROM jf)),
jtyp AS (SELECT project, version, path, pos, name, nullif(ext, '') AS ext,
                list_filter(list_transform(string_split(coalesce(permits, ''), ','), lambda x: trim(x)),
                            lambda x: x <> '') AS permits
         FROM jtyp0 WHERE name <> 'record'),
jcand AS (
  SELECT r.project, r.version, r.path, r.pos, r.name, CAST(NULL AS VARCHAR) AS ext, 0 AS kind FROM jrec r
  UNION ALL SELECT project, version, path, pos, name, ext, 1 FROM jtyp),
jdecl AS (
  SELECT * FROM (
    SELECT c.*, m.package, m.loc, m.complexity,
           CASE WHEN m.package <> '' THEN m.package || '.' || c.name ELSE c.name END AS fqcn,
           row_number() OVER (PARTITION BY c.project, c.version,
                                CASE WHEN m.package <> '' THEN m.package || '.' || c.name ELSE c.name END
                              ORDER BY c.kind, CASE WHEN c.kind = 0 THEN c.path END DESC NULLS LAST,
                                       CASE WHEN c.kind = 0 THEN c.pos END DESC NULLS LAST, c.path, c.pos) AS rn
    FROM jcand c JOIN jmeta m USING (project, version, path)) WHERE rn = 1),
jidx AS (SELECT project, version, name, count(DISTINCT fqcn) AS n_cand, min(fqcn) AS fqcn FROM jdecl GROUP BY ALL),
jtok AS (
  SELECT DISTINCT project, version, path, unnest(regexp_extract_all(content, '\b\w+\b')) AS token FROM jf),
jrefs AS (
  SELECT d.project, d.version, d.fqcn, d.package, t.token AS ref
  FROM jdecl d JOIN jtok t ON t.project = d.project AND t.version = d.version AND t.path = d.path
  JOIN (SELECT DISTINCT project, version, name FROM jidx) k
    ON k.project = t.project AND k.version = t.version AND k.name = t.token
  WHERE t.token <> d.name),
jcimp AS (SELECT d.project, d.version, d.fqcn, i.pos, i.import FROM jdecl d JOIN jimp i USING (project, version, path))
"""


def _resolve_sql(refs: str, out: str) -> str:
    return f"""
{out}_a AS (
  SELECT r.project, r.version, r.fqcn, r.ref, arg_min(i.import, i.pos) AS t
  FROM {refs} r JOIN jcimp i ON i.project = r.project AND i.version = r.version AND i.fqcn = r.fqcn
  JOIN jdecl c ON c.project = r.project AND c.version = r.version AND c.fqcn = i.import
  WHERE ends_with(i.import, '.' || r.ref) AND NOT ends_with(i.import, '.*') GROUP BY ALL),
{out}_b AS (
  SELECT r.project, r.version, r.fqcn, r.ref, c.fqcn AS t FROM {refs} r JOIN jdecl c
    ON c.project = r.project AND c.version = r.version
   AND c.fqcn = CASE WHEN r.package <> '' THEN r.package || '.' || r.ref ELSE r.ref END),
{out}_c AS (
  SELECT r.project, r.version, r.fqcn, r.ref, arg_min(c.fqcn, i.pos) AS t
  FROM {refs} r JOIN jcimp i ON i.project = r.project AND i.version = r.version AND i.fqcn = r.fqcn
  JOIN jdecl c ON c.project = r.project AND c.version = r.version
   AND c.fqcn = left(i.import, length(i.import) - 2) || '.' || r.ref
  WHERE ends_with(i.import, '.*') GROUP BY ALL),
{out}_d AS (
  SELECT r.project, r.version, r.fqcn, r.ref, x.fqcn AS t FROM {refs} r JOIN jidx x
    ON x.project = r.project AND x.version = r.version AND x.name = r.ref WHERE x.n_cand = 1),
{out} AS (
  SELECT r.project, r.version, r.fqcn, r.ref, coalesce(a.t, b.t, c.t, d.t) AS target
  FROM (SELECT DISTINCT project, version, fqcn, ref FROM {refs}) r
  LEFT JOIN {out}_a a USING (project, version, fqcn, ref)
  LEFT JOIN {out}_b b USING (project, version, fqcn, ref)
  LEFT JOIN {out}_c c USING (project, version, fqcn, ref)
  LEFT JOIN {out}_d d USING (project, version, fqcn, ref)
  WHERE coalesce(a.t, b.t, c.t, d.t) IS NOT NULL)
"""


JRES = _resolve_sql("jrefs", "jcalls0") + "," + """
jprefs AS (SELECT project, version, fqcn, package, ext AS ref FROM jdecl WHERE ext IS NOT NULL),
""" + _resolve_sql("jprefs", "jpar")

JGRAPH = """
jcalls AS (SELECT DISTINCT project, version, fqcn AS source, target, 'calls' AS type FROM jcalls0),
jinh AS (SELECT project, version, fqcn AS source, target, 'inheritance' AS type FROM jpar),
jci AS (SELECT * FROM jcalls UNION ALL SELECT * FROM jinh),
jimpe AS (
  SELECT DISTINCT i.project, i.version, i.fqcn AS source, i.import AS target, 'imports' AS type
  FROM jcimp i JOIN jdecl c ON c.project = i.project AND c.version = i.version AND c.fqcn = i.import
  WHERE i.fqcn <> i.import
    AND NOT EXISTS (SELECT 1 FROM jci e WHERE e.project = i.project AND e.version = i.version
                    AND e.source = i.fqcn AND e.target = i.import)),
jedges AS (SELECT * FROM jci UNION ALL SELECT * FROM jimpe),
jwalk AS (
  SELECT w.project, w.version, w.fqcn, w.cur, w.steps FROM (
    WITH RECURSIVE walk(project, version, fqcn, cur, seen, steps) AS (
      SELECT project, version, fqcn, fqcn, [fqcn], 0 FROM jdecl
      UNION ALL
      SELECT w.project, w.version, w.fqcn, p.target, list_append(w.seen, p.target), w.steps + 1
      FROM walk w JOIN jpar p ON p.project = w.project AND p.version = w.version AND p.fqcn = w.cur
      WHERE NOT list_contains(w.seen, p.target))
    SELECT *, row_number() OVER (PARTITION BY project, version, fqcn ORDER BY steps DESC) AS rn FROM walk) w
  WHERE w.rn = 1),
jdepth AS (
  SELECT w.project, w.version, w.fqcn,
         CASE WHEN p.target IS NOT NULL OR d.ext IS NOT NULL THEN w.steps + 1 ELSE w.steps END AS depth
  FROM jwalk w LEFT JOIN jpar p ON p.project = w.project AND p.version = w.version AND p.fqcn = w.cur
  JOIN jdecl d ON d.project = w.project AND d.version = w.version AND d.fqcn = w.cur)
"""

# Nested types: tokens with the depth before them; an open brace belongs to the last open brace one level up.
JSCOPE = r"""
jcode AS (
  SELECT project, version, path, regexp_replace(content,
    '"(?:\\.|[^"\\\n])*"|//[^\n]*|/\*(?s:.*?)\*/', ' ', 'g') AS code FROM jf),
jtk0 AS (
  SELECT project, version, path, unnest(range(len(l))) AS i, unnest(l) AS tok
  FROM (SELECT *, regexp_extract_all(code, '\b(?:class|interface|enum)\s+\w+|[{}]') AS l FROM jcode)),
jtk AS (
  SELECT *, coalesce(sum(CASE tok WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (
              PARTITION BY project, version, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d,
         lag(tok) OVER (PARTITION BY project, version, path ORDER BY i) AS prev FROM jtk0),
jopen AS (
  SELECT *, CASE WHEN length(prev) > 1 THEN regexp_extract(prev, '(\w+)$', 1) END AS name,
         max(CASE WHEN d = 0 THEN i END) OVER w AS i0, max(CASE WHEN d = 1 THEN i END) OVER w AS i1
  FROM jtk WHERE tok = '{' WINDOW w AS (PARTITION BY project, version, path ORDER BY i ROWS UNBOUNDED PRECEDING)),
jsc0 AS (SELECT project, version, path, i, name FROM jopen WHERE d = 0 AND name IS NOT NULL),
jsc1 AS (SELECT o.project, o.version, o.path, o.i, t.name AS outer_name, o.name FROM jopen o
         JOIN jsc0 t ON t.project = o.project AND t.version = o.version AND t.path = o.path AND t.i = o.i0
         WHERE o.d = 1 AND o.name IS NOT NULL),
jsc2 AS (SELECT o.project, o.version, o.path, t.outer_name || '.' || t.name AS outer_name, o.name FROM jopen o
         JOIN jsc1 t ON t.project = o.project AND t.version = o.version AND t.path = o.path AND t.i = o.i1
         WHERE o.d = 2 AND o.name IS NOT NULL),
jscopes AS (
  SELECT s.*, CASE WHEN m.package <> '' THEN m.package || '.' ELSE '' END || coalesce(s.outer_name || '.', '') || s.name AS fqcn
  FROM (SELECT project, version, path, CAST(NULL AS VARCHAR) AS outer_name, name, 0 AS depth FROM jsc0
        UNION ALL SELECT project, version, path, outer_name, name, 1 FROM jsc1
        UNION ALL SELECT project, version, path, outer_name, name, 2 FROM jsc2) s JOIN jmeta m USING (project, version, path))
"""
JAVA_SCOPE_FIX = JAVA_FIX.replace("jf AS (", "jfplain AS (").replace("END AS content", "END AS content, k") + r""",
jf AS (
  SELECT project, version, path, language, content || chr(10) || 'class U' || k || ' {' || chr(10) || '    N' || ((k + 1) // 7) || '.Inner'
    || ((k + 1) % 3) || ' part; // N' || (k // 7) || '.Inner0 {' || chr(10) || '    static class Deep' || (k % 3)
    || ' { class Deeper { } }' || chr(10) || '    Deep' || (k % 3) || ' own; U' || (k + 4) || '.Deep' || ((k + 4) % 3)
    || ' other;' || chr(10) || '    String s = "class Fake { U7.Deep1 }";' || chr(10) || '}' || chr(10)
    || CASE WHEN k % 2 = 0 THEN 'import com.p' || ((k + 4) % 7) || '.U' || (k + 4) || ';' || chr(10) ELSE '' END AS content FROM jfplain)
"""
_HEAD, _ = JDECL.split("jidx AS (", 1)
JSDECL = _HEAD.replace("jdecl AS (", "jflat AS (") + JSCOPE + r""",
jdecl AS (
  SELECT project, version, path, name, ext, package, fqcn, name AS qualified, CAST(NULL AS VARCHAR) AS outer_name FROM jflat f
  WHERE f.kind = 0 OR EXISTS (SELECT 1 FROM jscopes s WHERE s.project = f.project AND s.version = f.version AND s.path = f.path
                              AND s.name = f.name AND s.depth = 0)
  UNION ALL
  SELECT s.project, s.version, s.path, s.name, NULL, m.package, s.fqcn, s.outer_name || '.' || s.name, s.outer_name
  FROM jscopes s JOIN jmeta m USING (project, version, path) WHERE s.depth = 1),
jidx AS (
  SELECT project, version, name, count(DISTINCT fqcn) AS n_cand, min(fqcn) AS fqcn FROM (
    SELECT project, version, name, fqcn FROM jdecl
    UNION ALL SELECT project, version, qualified, fqcn FROM jdecl WHERE qualified <> name) GROUP BY ALL),
jtok AS (
  SELECT DISTINCT project, version, path, unnest(regexp_extract_all(code, '\b\w+\b')) AS token FROM jcode
  UNION
  SELECT DISTINCT project, version, path, p[i] || '.' || p[i + 1] FROM (
    SELECT *, unnest(range(1, len(p))) AS i FROM (
      SELECT project, version, path, string_split(unnest(regexp_extract_all(code, '\b\w+(?:\.\w+)+')), '.') AS p FROM jcode))),
jrefs AS (
  SELECT d.project, d.version, d.fqcn, d.package, t.token AS ref
  FROM jdecl d JOIN jtok t ON t.project = d.project AND t.version = d.version AND t.path = d.path
  JOIN (SELECT DISTINCT project, version, name FROM jidx) k ON k.project = t.project AND k.version = t.version AND k.name = t.token
  WHERE t.token <> d.name AND d.qualified = d.name),
jcimp AS (SELECT d.project, d.version, d.fqcn, i.pos, i.import FROM jdecl d JOIN jimp i USING (project, version, path))
"""
Q["ext_scope_table"] = w(JAVA_SCOPE_FIX, _HEAD.rstrip().rstrip(","), JSCOPE) + \
    "SELECT project, version, path, outer_name AS outer, name, depth, fqcn FROM jscopes"
Q["ext_java_nested_types"] = w(JAVA_FIX, _HEAD.rstrip().rstrip(","), JSCOPE) + \
    "SELECT project, version, path, outer_name AS outer, name AS inner, fqcn FROM jscopes WHERE depth = 1"
Q["ext_resolve_qualified"] = w(JAVA_SCOPE_FIX, JSDECL, _resolve_sql("jrefs", "jfound")) + r""",
jleft AS (SELECT r.* FROM jrefs r ANTI JOIN jfound f ON f.project = r.project AND f.version = r.version AND f.fqcn = r.fqcn AND f.ref = r.ref),
jout AS (SELECT DISTINCT project, version, fqcn, package, string_split(ref, '.')[1] AS ref FROM jleft WHERE contains(ref, '.')),
""" + _resolve_sql("jout", "jo") + r""",
jtwo AS (
  SELECT l.project, l.version, l.fqcn, l.ref, c.fqcn AS target FROM jleft l
  LEFT JOIN jo_a a ON a.project = l.project AND a.version = l.version AND a.fqcn = l.fqcn AND a.ref = string_split(l.ref, '.')[1]
  LEFT JOIN jo_b b ON b.project = l.project AND b.version = l.version AND b.fqcn = l.fqcn AND b.ref = string_split(l.ref, '.')[1]
  LEFT JOIN jo_c x ON x.project = l.project AND x.version = l.version AND x.fqcn = l.fqcn AND x.ref = string_split(l.ref, '.')[1]
  JOIN jdecl c ON c.project = l.project AND c.version = l.version
   AND c.fqcn = coalesce(a.t, b.t, x.t) || '.' || string_split(l.ref, '.')[2]
  WHERE contains(l.ref, '.')),
jnear AS (
  SELECT l.project, l.version, l.fqcn, l.ref, n.fqcn AS target FROM jleft l
  JOIN jdecl o ON o.project = l.project AND o.version = l.version AND o.fqcn = l.fqcn AND o.qualified = o.name
  JOIN jdecl n ON n.project = o.project AND n.version = o.version AND n.path = o.path AND n.outer_name = o.name AND n.name = l.ref
  ANTI JOIN jtwo t ON t.project = l.project AND t.version = l.version AND t.fqcn = l.fqcn AND t.ref = l.ref)
SELECT DISTINCT project, version, fqcn AS source, target FROM (
  SELECT project, version, fqcn, target FROM jfound UNION ALL SELECT project, version, fqcn, target FROM jtwo
  UNION ALL SELECT project, version, fqcn, target FROM jnear)"""

Q["ext_java_loc"] = w(JAVA_FIX, JDECL) + "SELECT project, version, path, loc FROM jmeta"
Q["ext_java_complexity"] = w(JAVA_FIX, JDECL) + "SELECT project, version, path, complexity FROM jmeta"
Q["ext_java_package"] = w(JAVA_FIX, JDECL) + "SELECT project, version, path, package FROM jmeta"
Q["ext_java_imports"] = w(JAVA_FIX, JDECL) + "SELECT project, version, path, pos, import FROM jimp"
Q["ext_java_records"] = w(JAVA_FIX, JDECL) + r"""
SELECT project, version, path, pos, name, array_to_string(list_sort(list_distinct(list_filter(list_transform(
         string_split(params, ','), lambda x: CASE WHEN len(regexp_split_to_array(trim(x), '\s+')) >= 2
           THEN regexp_replace(regexp_split_to_array(trim(x), '\s+')[-2], '<.*?>', '', 'g') END),
         lambda x: x IS NOT NULL AND x <> ''))), ',') AS refs
FROM jrec"""
Q["ext_java_types"] = w(JAVA_FIX, JDECL) + """
SELECT project, version, path, pos, name, ext AS extends, array_to_string(list_sort(permits), ',') AS permits
FROM jtyp"""
Q["ext_declared_index"] = w(JAVA_FIX, JDECL) + """
SELECT project, version, name, n_cand, CASE WHEN n_cand = 1 THEN fqcn END AS unique_fqcn FROM jidx"""
Q["ext_token_refs"] = w(JAVA_FIX, JDECL) + "SELECT project, version, fqcn, ref AS token FROM jrefs"
Q["ext_resolve_refs"] = w(JAVA_FIX, JDECL, JRES) + \
    "SELECT DISTINCT project, version, fqcn AS source, target FROM jcalls0"
Q["ext_resolve_parent"] = w(JAVA_FIX, JDECL, JRES) + "SELECT project, version, fqcn, target AS parent FROM jpar"
Q["ext_inheritance_depth"] = w(JAVA_FIX, JDECL, JRES, JGRAPH) + """
SELECT d.project, d.version, d.fqcn AS id, CAST(coalesce(x.depth, 0) AS BIGINT) AS inheritance_depth
FROM jdecl d LEFT JOIN jdepth x USING (project, version, fqcn)"""
Q["ext_import_edges"] = w(JAVA_FIX, JDECL, JRES, JGRAPH) + "SELECT project, version, source, target FROM jimpe"
Q["ext_build_graph"] = w(JAVA_FIX, JDECL, JRES, JGRAPH) + """
SELECT d.project, d.version, d.fqcn AS id, d.name, d.path AS file_path, CAST(d.loc AS BIGINT) AS loc,
       CAST(d.complexity AS BIGINT) AS complexity, CAST(coalesce(x.depth, 0) AS BIGINT) AS inheritance_depth,
       CAST(coalesce(fi.n, 0) AS BIGINT) AS fan_in, CAST(coalesce(fo.n, 0) AS BIGINT) AS fan_out,
       CAST(coalesce(fi.n, 0) + coalesce(fo.n, 0) AS BIGINT) AS coupling
FROM jdecl d LEFT JOIN jdepth x USING (project, version, fqcn)
LEFT JOIN (SELECT project, version, target AS fqcn, count(*) AS n FROM jedges GROUP BY ALL) fi
  USING (project, version, fqcn)
LEFT JOIN (SELECT project, version, source AS fqcn, count(*) AS n FROM jedges GROUP BY ALL) fo
  USING (project, version, fqcn)"""

_GKW = "['if', 'for', 'while', 'case', 'cond', 'fn', 'def', 'match']"
Q["ext_generic_metrics"] = w(FILES_FIX) + rf"""
SELECT project, version, path,
       len(list_filter(regexp_split_to_array(content, '{_LB}'),
           lambda l: NOT regexp_matches(l, '^{_WS}*$') AND NOT regexp_matches(l, '^{_WS}*(#|//)'))) AS loc,
       1 + len(list_filter(regexp_extract_all(content, '[\p{{L}}\p{{Nl}}\p{{Nd}}\p{{M}}_]+'),
                           lambda t: list_contains({_GKW}, t)))
         + len(regexp_extract_all(content, '&&|\|\|')) AS complexity
FROM files"""

PY_FIX = """
pf AS (
  SELECT p_brand AS project, 'v1' AS version,
         'src/pkg' || (p_partkey % 7) || '/m' || (p_partkey // 7) || '.py' AS path, 'Python' AS language,
         array_to_string([
           'import pkg' || ((p_partkey + 1) % 7) || '.m' || ((p_partkey + 1) // 7),
           'from pkg' || ((p_partkey + 2) % 7) || '.m' || ((p_partkey + 2) // 7) || ' import thing',
           '# comment line', '', 'def run(a, b):',
           CASE WHEN p_partkey % 2 = 0 THEN '    if a and b or a && b:' ELSE '    while a || b:' END,
           '        return m' || ((p_partkey + 3) // 7) || '.value',
           '    // trailing'], chr(10)) AS content
  FROM part),
pbase AS (SELECT *, CASE WHEN contains(path, '.') THEN regexp_extract(path, '^(.*)\\.[^.]*$', 1) ELSE path END
                      AS base FROM pf),
pimp AS (
  SELECT DISTINCT project, version, path AS source,
         trim(replace(replace(imp, '.', '/'), '/py', '')) AS key
  FROM (SELECT project, version, path, unnest(list_transform(
                 list_zip(regexp_extract_all(content, '\\bimport\\s+([\\w\\.]+)\\b|\\bfrom\\s+([\\w\\.]+)\\s+import\\b', 1),
                          regexp_extract_all(content, '\\bimport\\s+([\\w\\.]+)\\b|\\bfrom\\s+([\\w\\.]+)\\s+import\\b', 2)),
                 lambda z: coalesce(nullif(z[1], ''), nullif(z[2], '')))) AS imp FROM pf)
  WHERE imp IS NOT NULL AND imp <> ''),
pimports AS (
  SELECT DISTINCT i.project, i.version, i.source, b.path AS target FROM pimp i JOIN pbase b
    ON b.project = i.project AND b.version = i.version AND (b.base = i.key OR ends_with(b.base, '/' || i.key))),
pment AS (
  SELECT DISTINCT t.project, t.version, t.path AS source, b.path AS target
  FROM (SELECT DISTINCT project, version, path, unnest(regexp_extract_all(content, '\\b\\w+\\b')) AS tok FROM pf) t
  JOIN pbase b ON b.project = t.project AND b.version = t.version
   AND string_split(b.base, '/')[-1] = t.tok
  WHERE b.path <> t.path),
pedges AS (SELECT DISTINCT * FROM (SELECT * FROM pimports UNION ALL SELECT * FROM pment))
"""

Q["ext_generic_imports"] = w(PY_FIX) + "SELECT * FROM pimports"
Q["ext_generic_mentions"] = w(PY_FIX) + "SELECT * FROM pment"
Q["ext_build_file_graph"] = w(PY_FIX) + rf"""
SELECT p.project, p.version, p.path AS id, string_split(p.path, '/')[-1] AS name,
       CAST(len(list_filter(regexp_split_to_array(p.content, '{_LB}'),
           lambda l: NOT regexp_matches(l, '^{_WS}*$') AND NOT regexp_matches(l, '^{_WS}*(#|//)'))) AS BIGINT) AS loc,
       CAST(1 + len(regexp_extract_all(p.content, '\b(if|for|while|case|cond|fn|def|match)\b|&&|\|\|')) AS BIGINT)
         AS complexity,
       CAST(coalesce(fi.n, 0) AS BIGINT) AS fan_in, CAST(coalesce(fo.n, 0) AS BIGINT) AS fan_out,
       CAST(coalesce(fi.n, 0) + coalesce(fo.n, 0) AS BIGINT) AS coupling
FROM pf p
LEFT JOIN (SELECT project, version, target AS path, count(*) AS n FROM pedges GROUP BY ALL) fi
  USING (project, version, path)
LEFT JOIN (SELECT project, version, source AS path, count(*) AS n FROM pedges GROUP BY ALL) fo
  USING (project, version, path)"""

Q["ext_major_language"] = """
SELECT source, arg_max(lang, n) AS major_language
FROM (SELECT source, lang, sum(n_chars) AS n FROM documents GROUP BY ALL) GROUP BY source"""

Q["ext_standard_language"] = w(INV_FIX) + """
SELECT owner, repo, language,
       CASE WHEN language IS NULL OR language = '' THEN 'Java'
            WHEN contains(lower(language), 'java') THEN 'Java'
            WHEN contains(lower(language), 'python') THEN 'Python'
            WHEN contains(lower(language), 'gleam') THEN 'Gleam'
            WHEN contains(lower(language), 'erlang') THEN 'Erlang'
            ELSE upper(left(language, 1)) || lower(substr(language, 2)) END AS standard
FROM inventory"""

Q["ext_parse_coordinate"] = w(INV_FIX) + """
, c AS (SELECT CASE WHEN stars % 10 = 0 THEN owner
                    WHEN repo_key % 2 = 0 THEN owner || '/' || repo || ' : ' || language
                    ELSE owner || '/' || repo END AS coordinate FROM inventory),
r AS (SELECT coordinate, CASE WHEN contains(coordinate, ':') THEN trim(string_split(coordinate, ':')[1])
                              ELSE coordinate END AS raw,
             CASE WHEN contains(coordinate, ':') THEN trim(string_split(coordinate, ':')[2]) END AS lang FROM c)
SELECT coordinate, CASE WHEN contains(raw, '/') THEN split_part(raw, '/', 1) END AS p_owner,
       CASE WHEN contains(raw, '/') THEN substr(raw, strpos(raw, '/') + 1) END AS p_repo,
       lang AS p_language,
       CASE WHEN NOT contains(raw, '/') THEN 'Invalid repository format ''' || coordinate ||
            '''. Must be ''owner/repo''.' END AS error
FROM r"""


# ------------------------------------------------------------------ STR
Q["str_graph_ingest"] = w(FIX) + "SELECT project, version, source, target, type, ord FROM dep_edges"
Q["str_graph_documents"] = """
WITH l AS (
  SELECT o_custkey AS k, 'y' || year(o_orderdate) AS version, l_partkey AS s,
         lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT DISTINCT 'c' || k AS project, version, s, t FROM l WHERE t IS NOT NULL),
n AS (SELECT project, version, s AS id FROM e UNION SELECT project, version, t FROM e)
SELECT 'versions' AS kind, project, version, CAST(NULL AS BIGINT) AS ord, 'Java' AS a, CAST(NULL AS VARCHAR) AS b,
       CAST(NULL AS VARCHAR) AS type, CAST(sum(id % 100) AS BIGINT) AS n1, count(*) AS n2 FROM n GROUP BY ALL
UNION ALL
SELECT 'nodes', project, version, row_number() OVER (PARTITION BY project, version ORDER BY id) - 1, CAST(id AS VARCHAR), 'P' || id,
       CASE WHEN id % 2 = 0 THEN 'class' ELSE 'file' END, id % 100, id % 7 FROM n
UNION ALL
SELECT 'edges', project, version, row_number() OVER (PARTITION BY project, version ORDER BY s, t) - 1, CAST(s AS VARCHAR),
       CAST(t AS VARCHAR), CASE s % 3 WHEN 0 THEN 'inheritance' WHEN 1 THEN 'imports' ELSE 'calls' END, NULL, NULL FROM e"""
Q["src_graph_documents"] = Q["str_graph_documents"]
Q["str_dedupe_discovered"] = Q["inv_upsert_discovered"]


def _sessions_sql(keys: str) -> str:
    return f"""
, ev AS (SELECT owner, repo, worker_id, to_status, transitioned_at AS ts, event_id FROM status_events),
g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY {keys} ORDER BY ts, event_id) IS NULL
                       OR ts - lag(ts) OVER (PARTITION BY {keys} ORDER BY ts, event_id) >= INTERVAL 30 MINUTE
                     THEN 1 ELSE 0 END AS brk FROM ev),
s AS (SELECT *, sum(brk) OVER (PARTITION BY {keys} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY {keys}, sid ORDER BY ts DESC, event_id DESC) AS rn FROM s)
SELECT {keys}, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
       max(CASE WHEN rn = 1 THEN to_status END) AS last_status, count(*) AS n_events"""


Q["str_stale_claims"] = "SELECT *, last_status IN ('processing') AS stale FROM (" + w(EVENTS_FIX) + \
    _sessions_sql("owner, repo") + " FROM r GROUP BY owner, repo, sid)"
Q["str_worker_sessions"] = w(EVENTS_FIX) + _sessions_sql("worker_id") + " FROM r GROUP BY worker_id, sid"
Q["str_status_counts"] = w(EVENTS_FIX) + """
SELECT date_trunc('hour', transitioned_at) AS window_start,
       date_trunc('hour', transitioned_at) + INTERVAL 1 HOUR AS window_end, to_status, count(*) AS n,
       'tumbling' AS kind
FROM status_events GROUP BY ALL
UNION ALL
SELECT ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, to_status, count(*) AS n, 'sliding' AS kind
FROM (SELECT to_status, time_bucket(INTERVAL 15 MINUTE, transitioned_at) - k * INTERVAL 15 MINUTE AS ws
      FROM status_events, range(0, 4) t(k)) GROUP BY ALL"""
Q["str_current_status"] = Q["inv_current_status"]


# ------------------------------------------------------------------ UDF
Q["udf_register_adapter"] = w(JAVA_FIX, JDECL, PY_FIX, FILES_FIX) + """
SELECT project, version, 'java' AS language, count(*) AS n_nodes, CAST(NULL AS VARCHAR) AS error
FROM jdecl GROUP BY ALL
UNION ALL
SELECT project, version, 'python', count(*), NULL FROM pf GROUP BY ALL
UNION ALL
SELECT DISTINCT project, version, lower(language), CAST(NULL AS BIGINT),
       'Language adapter for ''' || lower(language) || ''' is not yet implemented.'
FROM files WHERE lower(language) NOT IN ('java', 'python')"""

Q["udf_score_reports"] = w(FIX, CYC, CYC_CHANGES, DIFF_SUMMARY, _judged(True), HUBS, ANOM, _REPORT) + """
SELECT project, v_old, v_new, string_agg(line, chr(10) ORDER BY sec, sub, k1, k2) || chr(10) AS answer
FROM report_lines GROUP BY ALL"""

Q["udf_sql_functions"] = w(FIX, CYC) + """
SELECT project, version, cycle_str, cycle_str AS canonical_str,
       CASE WHEN project IS NULL OR project = '' THEN 'Java'
            WHEN contains(lower(project), 'java') THEN 'Java'
            ELSE upper(left(project, 1)) || lower(substr(project, 2)) END AS std_project,
       round((length - 2.0) / greatest(0.1, 1.5), 2) AS z
FROM cyc"""
