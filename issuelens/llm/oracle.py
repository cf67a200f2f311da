"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

# ASCII letters lower-cased only; words as in the contracts.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP10 = f"""
WITH w AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
  FROM (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM w, unnest(range(1, len(ws) - 6)) AS u(i))),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM win, unnest(range(0, 8)) AS v(k) WHERE c > 1 GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w)
  WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, host, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR 10 * n_symbols > word_chars OR n_dup_lines >= 3) AS f
  FROM b GROUP BY host),
p AS (SELECT avg(f / n) AS mean, var_pop(f / n) AS v FROM h),
s AS (SELECT mean, greatest(1.0, CASE WHEN v > 0 THEN mean * (1 - mean) / v - 1 ELSE 1.0 END) AS k FROM p),
r AS (SELECT host, (f + mean * k) / (n + k) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rate > 0.5 AS kept, b.host, round(rate, 6) AS host_rate
FROM b JOIN r ON b.host IS NOT DISTINCT FROM r.host
"""

OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM d, unnest(range(0, length(h) // 2 - 49)) AS u(p)),
least_id AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM win JOIN least_id USING (s) WHERE m < doc_id),
run AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit),
span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, k),
before AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM span),
gone AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept,
         string_agg(a || ':' || b, ',' ORDER BY a) AS spans
  FROM before JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN gone USING (doc_id)
"""

OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS s FROM w, unnest(range(1, len(ws))) AS u(i)
  UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM comp LEFT JOIN n USING (doc_id)
"""

OP11 = r"""
WITH t AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM t),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, ws[j:j + k - 1] AS g FROM w, unnest([1, 2, 3]) AS u(k), unnest(range(1, len(ws) - k + 2)) AS v(j)),
f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY ALL),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.k, c.g, c.a, j, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1:j] JOIN f y ON y.lang = c.lang AND y.g = c.g[j + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
part AS (
  SELECT lang, g, max(a) AS a FROM (
    SELECT lang, g[1:2] AS g, a FROM cand WHERE k = 3 UNION ALL SELECT lang, g[2:3], a FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN part ON part.lang = b.lang AND part.g = b.g
  WHERE NOT coalesce(100 * part.a >= 50 * b.a, false))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
       score::BIGINT AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""

# crc32 bit by bit over the UTF-8 bytes of the id and the run (digits, a sign and
# a colon, letters of one or two bytes).
OP13 = """
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS i, r, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS r
        FROM documents) WHERE length(r) >= 6 GROUP BY ALL),
byte AS (
  SELECT i, r, c, flatten(list_transform(string_split(i || r, ''), lambda ch:
    CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, unicode(ch)::BIGINT - 64] END)) AS bs FROM runs),
crc AS (
  SELECT i, r, c, xor(4294967295, list_reduce(bs, lambda c, b: xor(c >> 8,
    list_reduce([xor(c, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
  ), 4294967295::BIGINT)) AS h FROM byte),
w AS (
  SELECT CASE WHEN h % 199 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, sum(c)::BIGINT AS n
  FROM crc GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5),
less AS (SELECT word, n, k, word[1:k] || word[k + 2:] AS d FROM w, unnest(range(0, length(word))) AS u(k)),
near AS (
  SELECT x.word AS a, y.word AS b, y.n FROM less x JOIN less y ON x.d = y.d AND x.k = y.k AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM w x JOIN less y ON x.word = y.d
  UNION SELECT y.word, x.word, x.n FROM w x JOIN less y ON x.word = y.d),
top AS (SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS form, max(n) AS form_n FROM near GROUP BY a),
f AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form,
         CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM w LEFT JOIN top ON a = word),
walk AS (
  SELECT word, word AS at, form AS next FROM f
  UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.next)
SELECT f.word, n, n_near, form, form_n, walk.at AS root FROM f JOIN walk ON walk.word = f.word AND walk.next IS NULL
"""

ORACLE = {"op10_quality_rules": OP10, "op11_collocations": OP11, "op13_spelling_variants": OP13, "op6_repeated_substrings": OP6, "op8_minhash": OP8}
