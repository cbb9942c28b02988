"""DuckDB texts that say the same as queries of this subpackage, from their definitions and not their methods."""

from __future__ import annotations

from .licenses import BASE, NOTICES, TEXTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK = r"[^\x20\x09-\x0D]+"


def plain(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{PLAIN}')"


SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{BLANK}') AS w FROM documents),
p AS (SELECT doc_id, k, hash(list_slice(w, k, k + 49)) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(k) WHERE len(w) >= 50),
f AS (SELECT h, min(doc_id) AS first FROM p GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS i FROM p JOIN f USING (h) WHERE doc_id > first),
words AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_LISTED = ", ".join(f"({i}, '{text}', '{label}', {str(i < len(BASE)).lower()})" for i, (text, label) in enumerate((*BASE, *NOTICES, *TEXTS)))
LICENSES = f"""
WITH t AS (SELECT *, string_split(text, ' ') AS ws, CASE WHEN is_base THEN 2 ELSE 3 END AS g FROM (VALUES {_LISTED}) AS v(t, text, label, is_base)),
tw AS (SELECT t, k, ws[k] AS word FROM t, unnest(range(1, len(ws) + 1)) AS u(k)),
coded AS (SELECT t, word, chr(1 + (row_number() OVER (PARTITION BY t ORDER BY min(k)))::INT) AS code FROM tw GROUP BY t, word),
whole AS (SELECT t, string_agg(code, '' ORDER BY k) AS codes FROM tw JOIN coded USING (t, word) GROUP BY t),
tp AS (SELECT t, g, is_base, k AS place, ws[k] AS w0, ws[k + 1] AS w1, ws[k + 2] AS w2 FROM t, unnest(range(1, len(ws) - g + 2)) AS u(k)),
d AS (SELECT doc_id, {plain('text')} AS w FROM documents),
dp AS (SELECT doc_id, k, w[k] AS w0, w[k + 1] AS w1, w[k + 2] AS w2 FROM d, unnest(range(1, len(w))) AS u(k)),
v AS (SELECT doc_id, t, is_base, g, place, k, k - place AS diagonal, dp.w0, dp.w1, dp.w2 FROM dp JOIN tp ON dp.w0 = tp.w0 AND dp.w1 = tp.w1 AND (is_base OR dp.w2 = tp.w2)),
diag AS (SELECT DISTINCT doc_id, t, is_base, diagonal FROM v),
cut AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) <= CASE WHEN is_base THEN 0 ELSE 2 END THEN 0 ELSE 1 END AS new FROM diag),
isl AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS span FROM cut),
s AS (SELECT doc_id, t, span, min(diagonal) AS start, count(DISTINCT place) AS n, min(k) AS lo, max(k + g - 1) AS hi FROM v JOIN isl USING (doc_id, t, is_base, diagonal) GROUP BY ALL),
likely AS (SELECT s.*, t.label, t.is_base, codes, CASE WHEN is_base THEN 0 ELSE floor(len(ws) * 0.1::DOUBLE + 1e-9) END AS edits
  FROM s JOIN t USING (t) JOIN whole USING (t) WHERE n >= len(ws) - g + 1 - g * CASE WHEN is_base THEN 0 ELSE floor(len(ws) * 0.1::DOUBLE + 1e-9) END),
cover AS (SELECT DISTINCT likely.doc_id, likely.t, likely.span, k + j AS spot, code FROM likely JOIN isl USING (doc_id, t, span) JOIN v USING (doc_id, t, diagonal), unnest(range(v.g)) AS u(j),
  coded WHERE coded.t = likely.t AND coded.word = [w0, w1, w2][j + 1]),
read AS (SELECT doc_id, t, span, string_agg(coalesce(code, chr(1)), '' ORDER BY spot) AS seen
  FROM (SELECT doc_id, t, span, unnest(range(lo, hi + 1)) AS spot FROM likely) LEFT JOIN cover USING (doc_id, t, span, spot) GROUP BY ALL),
ok AS (SELECT *, levenshtein(seen, codes) AS distance, 1 - levenshtein(seen, codes) / length(codes)::DOUBLE AS score FROM likely JOIN read USING (doc_id, t, span)
  WHERE levenshtein(seen, codes) <= edits),
r AS (SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word, max(start) FILTER (is_base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM ok GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN r USING (doc_id)
"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {plain('text')} AS w FROM documents), b AS (SELECT item_id, {plain('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, k, k + least(len(w), 13) - 1) AS g FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(k) WHERE len(w) > 0),
size AS (SELECT DISTINCT len(g) AS n FROM win),
p AS (SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS g FROM d, size, unnest(range(1, len(w) - n + 2)) AS t(k) WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, k, n FROM p JOIN win USING (g)),
words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS i FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.9::DOUBLE),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{BLANK}') AS w FROM documents),
s AS (SELECT doc_id, g, count(*) AS m FROM (SELECT doc_id, list_slice(w, k, k + 4) AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(k) WHERE len(w) > 0) GROUP BY ALL),
z AS (SELECT doc_id, sum(m) AS z FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.m, b.m)) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE i >= 0.8::DOUBLE * (za.z + zb.z - i) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, component_id, CASE WHEN len(w) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY w) END::BIGINT AS n_copies, doc_id = component_id AS kept FROM d JOIN c USING (doc_id)
"""
