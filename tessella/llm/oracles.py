"""DuckDB statements whose rows equal those of the queries."""

#: The measures of the quality rules and the verdict on each document's source.
HOST_QUALITY = r"""
WITH w AS (
    SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), r AS (
    SELECT doc_id, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id
), l AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
    SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
), f AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * n_lines AS rule_failed
    FROM m
), h AS (
    SELECT source, count(*) AS n, sum(CASE WHEN rule_failed THEN 1 ELSE 0 END) AS k FROM f GROUP BY source
), p AS (
    SELECT least(greatest(avg(k / n), 1e-3), 1 - 1e-3) AS mu, var_pop(k / n) AS v FROM h
), b AS (
    SELECT mu, least(greatest(CASE WHEN v > 0 THEN mu * (1 - mu) / v - 1 ELSE 1.0 END, 1.0), 1e6) AS s FROM p
), d AS (
    SELECT source, (k + mu * s) / (n + s) AS rate FROM h, b
)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       base_failed, NOT base_failed AND rate <= 0.75 AS kept
FROM f JOIN d ON f.source IS NOT DISTINCT FROM d.source
"""

#: Shingle sets, links by an inverted index, components by recursion.
JACCARD_COMPONENTS = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END, ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, CASE WHEN len(ws) = 0 THEN 1 WHEN len(ws) < 5 THEN 2 ELSE len(ws) - 3 END)) AS i FROM w)
), k AS MATERIALIZED (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS MATERIALIZED (
    SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2) p
    JOIN k x ON x.doc_id = u JOIN k y ON y.doc_id = v WHERE 100 * common >= 80 * (x.n + y.n - common)
), r AS (
    SELECT doc_id, doc_id AS c FROM documents
    UNION
    SELECT e.v, r.c FROM r JOIN e ON e.u = r.doc_id WHERE r.c < e.v
), m AS (
    SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id
)
SELECT documents.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents LEFT JOIN k ON k.doc_id = documents.doc_id LEFT JOIN m ON m.doc_id = documents.doc_id
"""

_ESC = "replace(replace({}, '&', '&amp;'), '<|', '&lt;|')"
#: The digests follow from the turns; the formatted length from how many windows hold each turn (windows of 512 tokens, history of 128).
CHAT_WINDOWS = f"""
WITH RECURSIVE c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), t AS (
    SELECT *, CAST(ceil(strlen(text) / 4) AS BIGINT) + 4 AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS ord FROM c
), p AS (
    SELECT *, coalesce(sum(tok) OVER (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, ord = 1 AND role = 'system' AS sys,
           24 + length(replace({_ESC.format('role')}, chr(10), '&#10;')) + length({_ESC.format('text')}) AS chars FROM t
), q AS (
    SELECT *, sum(CASE WHEN sys THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) AS head, min(CASE WHEN sys THEN NULL ELSE b END) OVER (PARTITION BY conv_id ORDER BY b RANGE BETWEEN 128 PRECEDING AND CURRENT ROW) AS f0 FROM p
), r AS MATERIALIZED (
    SELECT *, CASE WHEN NOT sys AND b - f0 + tok + head <= 512 THEN f0 ELSE b END AS f FROM q
), nx AS MATERIALIZED (
    SELECT a.conv_id, a.ord, min(z.ord) AS nxt FROM r a JOIN r z ON z.conv_id IS NOT DISTINCT FROM a.conv_id AND z.ord > a.ord AND z.b + z.tok > a.b + 512 - CASE WHEN a.ord = 1 THEN 0 ELSE a.head + a.b - a.f END GROUP BY 1, 2
), w AS (
    SELECT conv_id, ord, 0 AS win FROM r WHERE ord = 1
    UNION ALL SELECT w.conv_id, nx.nxt, win + 1 FROM w JOIN nx ON nx.conv_id IS NOT DISTINCT FROM w.conv_id AND nx.ord = w.ord
), h AS (
    SELECT r.conv_id, r.ord, r.b, r.f, win FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.ord = w.ord
), x AS (
    SELECT r.*, 1 + (SELECT count(*) FROM h WHERE h.conv_id IS NOT DISTINCT FROM r.conv_id AND h.win > 0 AND h.ord > r.ord AND (r.sys OR r.b >= h.f)) AS times FROM r
), g AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord) AS said,
           string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY ord) AS loss, CAST(sum(chars * times) AS BIGINT) AS formatted_chars
    FROM x GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

#: The template tree: the recursion takes a level of all pages at a time, windows stand for the nodes and their children.
URL_TEMPLATES = r"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS a FROM pages),
r AS (SELECT page_id, CASE WHEN a > 0 THEN substr(url, a + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
hp AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
ru AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1' WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/' WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM hp),
l0 AS MATERIALIZED (SELECT *, CASE WHEN rule IS NOT NULL THEN CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 1 ELSE 0 END END AS label,
    CASE WHEN path <> '' THEN string_split(replace(regexp_replace(path, '^/', ''), '*', '%2A'), '/') ELSE [] END AS segs FROM ru),
dm AS (SELECT max(len(segs)) AS deepest FROM l0),
l AS (
    SELECT page_id, host, path, rule, label, segs, '' AS template, 0 AS d FROM l0
    UNION ALL
    SELECT page_id, host, path, rule, label, segs, template || CASE WHEN seg IS NULL THEN '' WHEN NOT (kids > 20 AND n < 0.05 * pn)
           AND (kids = 1 OR NOT (m = 0 OR abs(k / m - (coalesce(pk, 0) + 1) / (pm + 2)) <= 1.96 * sqrt((coalesce(pk, 0) + 1) / (pm + 2) * (1 - (coalesce(pk, 0) + 1) / (pm + 2)) / greatest(m, 1)))) THEN '/' || seg ELSE '/*' END, d + 1
    FROM (
        SELECT *, count(*) OVER kid AS n, sum(label) OVER kid AS k, count(label) OVER kid AS m, count(DISTINCT seg) OVER node AS kids, count(*) OVER node AS pn, sum(label) OVER node AS pk, count(label) OVER node AS pm
        FROM (SELECT *, CASE WHEN len(segs) > d THEN segs[d + 1] END AS seg FROM l WHERE d < (SELECT deepest FROM dm))
        WINDOW kid AS (PARTITION BY host, template, seg), node AS (PARTITION BY host, template, seg IS NULL)
    )
),
t AS (SELECT page_id, host, path, rule, label, template FROM l WHERE d = (SELECT deepest FROM dm)),
ct AS (SELECT host, template, sum(label) AS k, count(label) AS m FROM t GROUP BY 1, 2),
ho AS (SELECT host, sum(k) AS k, sum(m) AS m FROM ct GROUP BY 1),
al AS (SELECT CASE WHEN sum(m) > 0 THEN sum(k) / sum(m) ELSE 0 END AS share FROM ho),
pr AS (SELECT host, (coalesce(k, 0) + share * 4) / (m + 4) AS prior FROM ho, al),
sh AS (SELECT ct.host, ct.template, (coalesce(k, 0) + prior * 4) / (m + 4) AS blocked, m > 0 AS seen FROM ct JOIN pr ON pr.host = ct.host)
SELECT page_id, t.host, path, rule, t.template, round(blocked, 6) AS blocked_share,
       CASE WHEN label = 1 THEN 'block' WHEN label = 0 THEN 'allow' WHEN blocked >= 0.8 AND seen THEN 'block' ELSE 'allow' END AS verdict
FROM t JOIN sh ON sh.host = t.host AND sh.template = t.template
"""
