"""DuckDB SQL for the queries that SQL can express on whole tables."""

ORACLES: dict[str, str] = {}

ORACLES["op10_line_dedup"] = """
WITH l AS (
  SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS x
  FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, i, trim(x, ' ') AS x FROM l WHERE trim(x, ' ') <> ''),
w AS (
  SELECT doc_id, i, x, lead(x) OVER o AS y, lead(i) OVER o AS j FROM t
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, i) AS n FROM w WHERE y IS NOT NULL),
g AS (SELECT doc_id, i FROM p WHERE n > 1 UNION SELECT doc_id, j FROM p WHERE n > 1),
r AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(r.n_lines, 0)::BIGINT AS n_lines, coalesce(r.n_removed, 0)::BIGINT AS n_removed,
       length(coalesce(r.text, ''))::BIGINT AS n_chars, md5(coalesce(r.text, '')) AS text_md5
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+')"

ORACLES["op6_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN w[i:i + 4] ELSE w END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
v AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, v.b FROM r JOIN v ON r.b = v.a),
least_of AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id
FROM documents d JOIN least_of ON a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

# every window that holds a shingle of the item; any other has nothing in common with it
ORACLES["op7_decontamination"] = f"""
WITH b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT row_number() OVER () AS v, item_id, w, len(w) AS size, least(len(w), 5) AS k FROM b WHERE len(w) > 0),
theirs AS (SELECT v, size, k, unnest(list_transform(range(1, size - k + 2), lambda x: w[x:x + k - 1])) AS s FROM i),
own AS (SELECT v, size, k, s, count(*) AS m FROM theirs GROUP BY ALL),
d AS (SELECT row_number() OVER () AS u, doc_id, w FROM (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents)),
ours AS (
  SELECT u, len(w) AS words, k, unnest(range(0, len(w) - k + 1)) AS p, unnest(list_transform(range(1, len(w) - k + 2), lambda x: w[x:x + k - 1])) AS s
  FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
hits AS (SELECT u, words, v, p, size, k, least(size, words) AS many, m, ours.s FROM ours JOIN own USING (s, k)),
win AS (
  SELECT DISTINCT u, v, size, k, many, unnest(range(greatest(0, p + k - many), least(p, words - many) + 1)) AS start FROM hits),
common AS (
  SELECT u, v, win.size, win.k, win.many, start, s, least(count(*), any_value(m)) AS c
  FROM win JOIN hits USING (u, v) WHERE p >= start AND p <= start + win.many - win.k GROUP BY ALL),
sims AS (SELECT u, v, sum(c) / (size - k + 1 + many - k + 1 - sum(c)) AS x FROM common GROUP BY u, v, size, k, many, start)
SELECT doc_id, item_id, round(max(x), 9) AS similarity
FROM sims JOIN i USING (v) JOIN d USING (u) WHERE x >= 0.75 GROUP BY ALL
"""

_NUMBERS = ", ".join(f"('0x' || substr(h, {i * 8 + 1}, 8))::UBIGINT AS h{i + 1}" for i in range(4))

# output and the text made of it again: three marks part an output, wherever a text with none was cut
ORACLES["op11_fill_in_middle"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT *, len(u) AS n, {_NUMBERS} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
       WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
x AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                     ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM x),
parts AS (SELECT *, string_split_regex(output, '<[PSM]>') AS q FROM o)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN q[2] || q[4] || q[3] ELSE q[3] || q[4] || q[2] END) AS restored_sha256
FROM parts
"""

ORACLES["op12_url_filters"] = """
WITH rules(v, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
u AS (
  SELECT row_number() OVER () AS r, page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
best AS (
  SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN best USING (r)
"""

ORACLES["op13_filter_audit"] = """
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least_id FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM t),
f AS (SELECT w.doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
             regexp_matches(text, '[#$%&*|]') AS d, least_id < w.doc_id AS e FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, [a, b, c, d, coalesce(e, false)] AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (
  SELECT a || b || c || d || e AS filter_order
  FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS b), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
       (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS d), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS e)
  WHERE a NOT IN (b, c, d, e) AND b NOT IN (c, d, e) AND c NOT IN (d, e) AND d <> e),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
x AS (
  SELECT m.*, filter_order, step, fails[ascii(filter_order[step]) - 64] AS here,
         list_bool_or([fails[ascii(filter_order[i]) - 64] FOR i IN range(1, step)]) AS before,
         len(list_filter(fails, lambda y: y)) AS failed FROM m, s),
y AS (SELECT *, coalesce(before, false) AS gone FROM x),
first_at AS (
  SELECT part, filter_order[step] AS letter, sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS shapley FROM y GROUP BY ALL)
SELECT y.part, filter_order, step::INT AS step,
       sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN here AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN here AND failed = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
       any_value(shapley)::BIGINT AS shapley
FROM y JOIN first_at ON first_at.part = y.part AND letter = filter_order[step] GROUP BY y.part, filter_order, step
"""
