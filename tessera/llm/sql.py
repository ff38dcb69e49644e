"""SQL that gives the rows of the corpus queries that SQL can express, each by a way of its own.

The audit walks through the orders one document profile at a time; near words meet on what is left when one letter is cut; phrases
are joined as text."""

FILTER_AUDIT = r"""
WITH texts AS (SELECT doc_id, COALESCE(text, '') AS t, COALESCE(lang, '') AS part FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM texts),
firsts AS (SELECT t, MIN(doc_id) AS first_id FROM texts GROUP BY t),
marks AS (SELECT doc_id, MAX(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, MAX(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT w.part, COALESCE(m.good, 0) AS good, COALESCE(m.toxic, 0) AS toxic,
    map {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * len(regexp_extract_all(w.t, '[A-Z]')) > 10 * length(w.t), 'D': regexp_matches(w.t, '[#$%&*|]'), 'E': w.doc_id > f.first_id} AS fails
  FROM worded w JOIN firsts f ON w.t = f.t LEFT JOIN marks m ON m.doc_id = w.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS filter, filter_order[1:step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)),
judged AS (SELECT part, good, toxic, count(*) AS n, array_to_string(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x]), '') AS failed FROM docs GROUP BY ALL),
counted AS (SELECT part, filter_order, step, filter,
    SUM(CASE WHEN translate(failed, earlier || filter, '') = failed THEN n ELSE 0 END) AS kept,
    SUM(CASE WHEN contains(failed, filter) AND translate(failed, earlier, '') = failed THEN n ELSE 0 END) AS removed,
    SUM(CASE WHEN contains(failed, filter) AND translate(failed, earlier, '') <> failed THEN n ELSE 0 END) AS redundant,
    SUM(CASE WHEN failed = filter THEN n ELSE 0 END) AS unique_fails,
    SUM(CASE WHEN contains(failed, filter) AND translate(failed, earlier, '') = failed THEN n * good ELSE 0 END) AS good_lost,
    SUM(CASE WHEN contains(failed, filter) AND translate(failed, earlier, '') = failed THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM judged, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(SUM(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""

SPELLING = r"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(0, 256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) WHERE length(r) >= 7 GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(string_split(COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) - 64 AS BIGINT)] END)) AS raw FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, raw), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS h FROM bytes, crc),
words AS (SELECT word, CAST(SUM(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING SUM(n) >= 2),
cuts AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, CAST(length(word) AS INT) + 1)) AS i FROM words)),
near AS (SELECT a.word AS x, b.word AS y FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, c.word FROM words w JOIN cuts c ON w.word = c.rest UNION SELECT c.word, w.word FROM words w JOIN cuts c ON w.word = c.rest),
ranked AS (SELECT x, y, b.n AS n, a.n AS own, row_number() OVER (PARTITION BY x ORDER BY b.n DESC, y) AS r, count(*) OVER (PARTITION BY x) AS n_near FROM near JOIN words a ON a.word = x JOIN words b ON b.word = y),
formed AS (SELECT w.word, CASE WHEN r.n >= 10 * r.own THEN r.y END AS form, w.n, COALESCE(r.n_near, 0) AS n_near, CASE WHEN r.n >= 10 * r.own THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.x = w.word AND r.r = 1),
chain AS (SELECT word, word AS here, 0 AS depth FROM formed UNION ALL SELECT c.word, f.form, c.depth + 1 FROM chain c JOIN formed f ON f.word = c.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, depth) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, e.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM formed f JOIN ends e ON e.word = f.word
"""

PHRASES = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (SELECT COALESCE(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
starts AS (SELECT item, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS a FROM items WHERE len(words) > 0),
windows AS (SELECT DISTINCT item, array_to_string(words[a:a + 9], ' ') AS phrase, len(words[a:a + 9]) AS n FROM starts),
places AS (SELECT rid, words, unnest(range(1, len(words) + 1)) AS p FROM docs),
phrases AS (SELECT rid, p, l.n, array_to_string(words[p:p + l.n - 1], ' ') AS phrase FROM places, (SELECT DISTINCT n FROM windows) l WHERE p + l.n - 1 <= len(words)),
found AS (SELECT f.rid, f.p, f.n, w.item FROM phrases f JOIN windows w ON f.phrase = w.phrase AND f.n = w.n),
hits AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM found) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(COALESCE(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(COALESCE(n.n_items, 0) AS BIGINT) AS n_items,
  sha256(COALESCE(n.names, '')) AS items_sha256, COALESCE(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON d.rid = h.rid LEFT JOIN named n ON d.rid = n.rid
"""

ORACLES = {"op11_filter_audit": FILTER_AUDIT, "op12_spelling_variants": SPELLING, "op13_benchmark_phrases": PHRASES}
