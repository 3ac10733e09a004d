"""SQL twins of the queries whose contract SQL can say.

The first ten have none: learnt scores, hashes, library ids and probed lists are held against
brute force in the tests."""

_SUBSTRING = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  g AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS gram
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
  first AS (SELECT gram, min(doc_id) AS least FROM g GROUP BY gram),
  hit AS (SELECT DISTINCT doc_id, p + unnest(range(13)) AS p FROM g JOIN first USING (gram) WHERE least < doc_id),
  gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id),
  kept AS (SELECT d.doc_id, w, coalesce(len(ps), 0) AS n,
             CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END AS k
           FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, CAST(n AS bigint) AS n_removed,
  sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_IMPORTANCE = rf"""
WITH RECURSIVE bit(k, b, v) AS (
    SELECT 0, r, CAST(r AS bigint) FROM range(256) x(r)
    UNION ALL
    SELECT k + 1, b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bit WHERE k < 8),
  crc AS (SELECT list(v ORDER BY b) AS t FROM bit WHERE k = 8),
  found AS (
    SELECT 1 AS part, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
    UNION ALL
    SELECT 2, item_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
    FROM benchmark),
  word AS (SELECT DISTINCT unnest(w) AS w FROM found),
  byte(w, k, c) AS (
    SELECT w, 0, CAST(4294967295 AS bigint) FROM word
    UNION ALL
    SELECT w, k + 1, xor(c >> 8, (SELECT t FROM crc)[xor(c & 255, CAST('0x' || substr(hex(w), 2 * k + 1, 2) AS bigint)) + 1])
    FROM byte WHERE k < octet_length(encode(w))),
  bucket AS (SELECT w, CAST(xor(c, 4294967295) % 10000 AS int) AS b FROM byte WHERE k = octet_length(encode(w))),
  feature AS (SELECT part, doc_id, unnest(w) AS w FROM found),
  n AS (SELECT b, sum((part = 1)::int) AS s, sum((part = 2)::int) AS t FROM feature JOIN bucket USING (w) GROUP BY b),
  whole AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM n),
  gain AS (SELECT b, CAST(floor(1000 * ln((t + 1)::double * (s_all + 10000)::double / ((s + 1)::double * (t_all + 10000)::double))) AS bigint) AS gain
           FROM n, whole),
  per_doc AS (SELECT doc_id, count(*) AS n, sum(gain) AS total FROM feature JOIN bucket USING (w) JOIN gain USING (b) WHERE part = 1 GROUP BY doc_id),
  weighed AS (
    SELECT f.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(total::double / n), 0) AS bigint) AS weight
    FROM found f LEFT JOIN per_doc USING (doc_id) WHERE part = 1),
  scored AS (
    SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS bigint) + 0.5::double) / 4294967296::double))) AS bigint) AS score
    FROM weighed),
  ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT s.doc_id, CAST(n_features AS bigint) AS n_features, weight, score, CASE WHEN r <= 10 * able // 100 THEN r END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)"""

_AUDIT = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  g AS (SELECT DISTINCT lang, source FROM d),
  t AS (SELECT lang, source, unnest(w) AS term FROM d),
  kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
  v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
  c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
  cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k USING (lang)
            LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  p AS (SELECT lang, source, term, n, 1 + 1000000000::hugeint * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p
        FROM cells JOIN v USING (lang)),
  q AS (SELECT lang, term, 1 + 1000000000::hugeint * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
        FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL) JOIN v USING (lang)),
  pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
               FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
      ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
  terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS bigint) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS int) AS rank
FROM pairs
UNION ALL
SELECT lang, source, 'term', item, CAST(value AS bigint), rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS int) AS rank FROM terms)
WHERE rank <= 50"""

ORACLES: dict[str, str] = {
    "op11_substring_dedup": _SUBSTRING,
    "op12_importance_resampling": _IMPORTANCE,
    "op13_source_audit": _AUDIT,
}
