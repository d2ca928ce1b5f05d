"""DuckDB SQL for the operators that SQL can express.

The other operators have brute-force tests: packing (many optimal placements), SimHash (no XXH64 in
SQL), toxicity and quality models (fits), PII (iterative patterns), BPE (tokens).
"""

from evograph.llm.quality_rules import ALPHA, DELTA, MAX_REPEAT_PERCENT, MIN_WORDS, RULES, WINDOW

_GRID = ", ".join(f"('{r}', '{m}', {s}, {j}, {c!r})" for r, (m, s, g) in RULES.items() for j, c in enumerate(g))
_METRIC = "CASE metric " + " ".join(f"WHEN '{m}' THEN {m}" for m in dict.fromkeys(m for m, _, _ in RULES.values())) + " END"

OP3 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
o AS (SELECT doc_id, o, substr(h, 512 * o + 1, 610) AS h  -- blocks, as a substring is found from the start
      FROM (SELECT doc_id, h, unnest(range((len(h) + 511) // 512)) AS o FROM d)),
b AS (SELECT doc_id, 256 * o + i AS i, substr(h, 2 * i + 1, 100) AS k
      FROM (SELECT doc_id, o, h, unnest(range(least(256, len(h) // 2))) AS i FROM o)),
s AS (SELECT * FROM b WHERE len(k) = 100),
m AS (SELECT k, min(doc_id) AS f FROM s GROUP BY k),
c AS (SELECT s.doc_id, s.i FROM s JOIN m USING (k) WHERE m.f < s.doc_id),
t AS (SELECT b.doc_id, b.i, substr(b.k, 1, 2) AS x,
             b.i - max(c.i) OVER (PARTITION BY b.doc_id ORDER BY b.i) < 50 AS gone
      FROM b LEFT JOIN c ON b.doc_id = c.doc_id AND b.i = c.i),
u AS (SELECT doc_id, i, x, coalesce(gone, false) AS gone,
             coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM t),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans,
             string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM u GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(r.n_removed, 0) AS n_removed,
       coalesce(r.n_spans, 0) AS n_spans, sha256(unhex(coalesce(r.kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""

OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS stratum,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (
          SELECT doc_id, i, unnest(range({WINDOW})) AS j FROM (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
base AS (SELECT d.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words,
                CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines
         FROM d LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, n_symbols / greatest(n_words, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
             n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS mean_word_chars,
             n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
held AS (SELECT m.* FROM m SEMI JOIN good USING (doc_id) WHERE NOT base_failed),
grid(rule, metric, sign, j, cutoff) AS (VALUES {_GRID}),
risk AS (SELECT stratum, rule, j, count(*) AS n, count(*) FILTER (({_METRIC}) * sign > cutoff * sign) AS k
         FROM held, grid GROUP BY stratum, rule, j),
tail AS (SELECT stratum, rule, j, CASE WHEN k < n * {ALPHA / len(RULES)!r} THEN list_sum(list_transform(range(k + 1), lambda i:
           exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA / len(RULES)!r}::DOUBLE)
               + (n - i) * ln(1 - {ALPHA / len(RULES)!r}::DOUBLE)))) ELSE 1 END AS p FROM risk),
steps AS (SELECT stratum, rule, j, bool_and(p <= {DELTA!r} / ((SELECT count(DISTINCT stratum) FROM held) * {len(RULES)}))
                 OVER (PARTITION BY stratum, rule ORDER BY j) AS ok FROM tail),
cut AS (SELECT stratum, rule, max(j) AS j FROM steps WHERE ok GROUP BY stratum, rule),
bad AS (SELECT DISTINCT doc_id FROM m JOIN cut USING (stratum) JOIN grid USING (rule, j)
        WHERE ({_METRIC}) * sign > cutoff * sign)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.doc_id IS NULL AS kept FROM m LEFT JOIN bad USING (doc_id)"""

OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""

OP10 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(h, 10 * (k // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31 AS INTEGER) + 1, 1)), '')
        AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""



def _nearest(book: str) -> str:
    """Of every part of every vector: the nearest entry of a codebook table and the squared distance."""
    return f"""SELECT vec_id, p, min(struct_pack(e := e, j := j)) AS m FROM (
  SELECT x.vec_id, x.p, b.j, CAST(sum((x.x - b.x) * (x.x - b.x)) AS BIGINT) AS e
  FROM x JOIN {book} b USING (p, i) GROUP BY x.vec_id, x.p, b.j) GROUP BY vec_id, p"""


def _next_book(near: str, book: str) -> str:
    return f"""SELECT b.p, b.i, b.j, coalesce(s.x, b.x) AS x FROM {book} b LEFT JOIN (
  SELECT x.p, x.i, a.m.j AS j, CAST(floor(sum(x.x) / count(*)) AS BIGINT) AS x
  FROM x JOIN {near} a USING (vec_id, p) GROUP BY x.p, x.i, a.m.j) s USING (p, i, j)"""


OP11 = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 16 = 0
             AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
x AS (SELECT vec_id, d // w AS p, d % w AS i, v[d + 1] AS x FROM (
        SELECT vec_id, v, len(v) // 16 AS w, unnest(range(len(v))) AS d FROM v)),
b0 AS MATERIALIZED (SELECT p, i, dense_rank() OVER (ORDER BY vec_id) - 1 AS j, x FROM x
       WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
a0 AS MATERIALIZED ({_nearest("b0")}),
b1 AS MATERIALIZED ({_next_book("a0", "b0")}),
a1 AS MATERIALIZED ({_nearest("b1")}),
b2 AS MATERIALIZED ({_next_book("a1", "b1")}),
a2 AS MATERIALIZED ({_nearest("b2")}),
c AS (SELECT vec_id, string_agg(printf('%02x', m.j), '' ORDER BY p) AS code, CAST(sum(m.e) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM c JOIN v USING (vec_id) GROUP BY label)
SELECT vec_id, code, error, label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, j, i)) FROM b2) AS codebooks_sha256
FROM c JOIN v USING (vec_id) JOIN l ON v.label IS NOT DISTINCT FROM l.label"""

OP12 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c <> 0)) > 0
             AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
l AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
c AS (SELECT u, min(w) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id"""

OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT *, least(h1, h2) AS a, greatest(h1, h2) - least(h1, h2) AS m,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
                  WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
o AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, m) AS middle, substr(t, a + m + 1) AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN m END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM o"""

ORACLE: dict[str, str] = {"op3_suffix_dedup": OP3, "op4_quality_rules": OP4, "op6_exact_top_k": OP6,
                          "op10_warc_round_trip": OP10, "op11_vector_codes": OP11, "op12_nn_descent": OP12, "op13_fill_in_middle": OP13}
