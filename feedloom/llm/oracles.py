"""The operators' queries in SQL, for tables with unique doc_ids of a size that joins of windows allow."""

from __future__ import annotations

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM s),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM g) ON len(w) >= n),
h AS (SELECT doc_id, i, p.n, item_id FROM p JOIN g ON p.n = g.n AND array_to_string(w[i : i + p.n - 1], ' ') = gram),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

LINES = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] AS pair FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM d WHERE len(l) > 1)),
f AS (SELECT pair, min({'doc': doc_id, 'at': i}) AS first FROM p GROUP BY pair),
q AS (SELECT doc_id, i FROM p JOIN f USING (pair) WHERE doc_id <> first.doc OR i > first.at + 1),
g AS (SELECT doc_id, i FROM q UNION SELECT doc_id, i + 1 FROM q),
e AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
k AS (SELECT e.doc_id, count(*) AS n, string_agg(l[i], chr(10) ORDER BY i) AS kept FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text, coalesce(len(l), 0)::BIGINT AS n_lines,
  (coalesce(len(l), 0) - coalesce(n, 0))::BIGINT AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, {_SPACED}) AS w FROM documents),
s AS (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0),
x AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + n - 1], ' ') AS shingle FROM s),
n AS (SELECT doc_id, count(*) AS size FROM x GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM m JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.size + q.size - shared)),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(size, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS least FROM p GROUP BY h),
g AS (SELECT DISTINCT doc_id, place FROM (SELECT doc_id, unnest(range(i, i + 50)) AS place FROM p JOIN f USING (h) WHERE least < doc_id)),
e AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS place FROM d),
k AS (SELECT e.doc_id, count(*) AS n, string_agg(w[e.place], ' ' ORDER BY e.place) AS kept FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.place = g.place GROUP BY e.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
