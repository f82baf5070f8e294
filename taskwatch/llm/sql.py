"""SQL (DuckDB) for the queries that SQL can express, written apart from the
operators: parameters are restated here; the license notices, which are data,
are taken from their table."""

from taskwatch.llm.licenses import TEMPLATES

WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, lang IS NULL AS no_lang, coalesce(text, '') AS t,
         """ + WORDS.format("text") + r""" AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, ws[i:i + 4] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) > 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS k FROM win) WHERE k > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, lang, no_lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
r AS (
  SELECT doc_id, lang, no_lang, base_failed, unnest([
    {'s': 'symbols', 'a': n_symbols, 'b': word_chars}, {'s': 'upper', 'a': n_upper, 'b': word_chars},
    {'s': 'bangs', 'a': n_bangs, 'b': word_chars}, {'s': 'dup_lines', 'a': n_dup_lines, 'b': n_lines},
    {'s': 'repeats', 'a': n_repeat_words, 'b': n_words}]) AS x FROM b),
cut AS (
  SELECT unnest([900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 40, 20]) AS cut,
         unnest(range(16)) AS step),
known AS (
  SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
  HAVING min(quality) = max(quality)),
c AS (
  SELECT lang, no_lang, x.s AS signal, step, cut, count(*) FILTER (q = 1) AS n,
         count(*) FILTER (q = 1 AND 1000 * x.a > cut * x.b) AS k,
         count(*) FILTER (q <> 1 AND 1000 * x.a > cut * x.b) AS bad
  FROM r JOIN known USING (doc_id) CROSS JOIN cut WHERE NOT base_failed GROUP BY ALL),
level AS (SELECT 0.05 / (greatest(count(DISTINCT (lang, no_lang)), 1) * 5) AS a FROM c),
p AS (
  SELECT c.*, k < n * 0.004 AND list_sum(list_transform(range(k + 1), lambda j: exp(
           lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln(0.004) + (n - j) * ln(0.996)))) <= a AS ok
  FROM c, level),
sure AS (
  SELECT *, min(ok::INT) OVER (PARTITION BY lang, no_lang, signal ORDER BY step) AS certified FROM p),
best AS (
  SELECT lang, no_lang, signal, arg_max(cut, bad * 100 - step) AS cut
  FROM sure WHERE certified = 1 AND bad > 0 GROUP BY ALL),
hit AS (
  SELECT DISTINCT r.doc_id FROM r JOIN best ON r.lang = best.lang AND r.no_lang = best.no_lang AND x.s = signal
  WHERE 1000 * x.a > cut * x.b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hit) AS kept
FROM b
"""

#: control strings of the chat template, alternatives after their first character
_CONTROL = (r"(<)(\|turn\|>|\|end\|>|\|image\|>|\|audio\|>|\|document\|>|\|/document\|>|\|other\|>|\|endoftext\|>"
            r"|\|im_start\|>|\|im_end\|>|\|system\|>|\|user\|>|\|assistant\|>|s>|/s>|<SYS>>|</SYS>>)")

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '""" + _CONTROL + r"""', '\1\\-\2', 'g'),
         '(\[)(/?INST\])', '\1\\-\2', 'g') AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|>') + length(role) + 1 + length(escaped) + length('<|end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

LINES = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (
  SELECT trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1
  HAVING count(DISTINCT source) + max((source IS NULL)::INT) >= 8),
n AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls, coalesce((SELECT list(line) FROM b), []) AS bs FROM documents),
m AS (
  SELECT *, list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]') AND list_contains(
            bs, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS bad FROM n),
o AS (
  SELECT *, len(bad) > 0 AND len(""" + WORDS.format("array_to_string(bad, chr(10))") + r""")
            <= 0.5 * len(""" + WORDS.format("text") + r""") AS goes FROM m),
f AS (
  SELECT *, CASE WHEN goes THEN array_to_string(list_filter(ls, lambda x: NOT list_contains(bad, x)), chr(10)) ELSE text END AS out
  FROM o)
SELECT doc_id, coalesce(len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))), 0) AS n_lines,
       CASE WHEN goes THEN len(bad) ELSE 0 END AS n_removed, length(out) AS n_chars, sha256(out) AS text_sha256
FROM f
"""

PAGES = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
b AS (
  SELECT page_id, url, list_filter(list_transform(
    string_split(regexp_replace(regexp_replace(replace(x, '<br>', ' '), '</?(p|h1)>', chr(1), 'g'), '<[^>]+>', '', 'g'), chr(1)),
    lambda y: trim(regexp_replace(replace(replace(replace(replace(replace(y, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
              '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))), lambda y: y <> '') AS bs
  FROM a)
SELECT page_id, url, array_to_string(bs, chr(10) || chr(10)) AS text,
       length(array_to_string(bs, chr(10) || chr(10))) AS n_chars
FROM b
"""

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, """ + WORDS.format(
    "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + r""" AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) GROUP BY ALL),
link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE a <> b AND 100 * k >= 90 * (x.n + y.n - k)),
reach AS (
  SELECT a AS doc_id, b AS other FROM link
  UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.other = link.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.other, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS other FROM reach GROUP BY 1) m USING (doc_id)
"""

_TEMPLATES = ", ".join("('{}', '{}')".format(*[x.replace("'", "''") for x in t]) for t in TEMPLATES)

LICENSES = r"""
WITH k(license, text) AS (VALUES """ + _TEMPLATES + r"""),
n AS (
  SELECT license, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM k),
t AS (
  SELECT DISTINCT license, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS theirs FROM n),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
u AS (
  SELECT doc_id, hash(text) AS h, unnest(list_concat(ls, CASE WHEN len(ls) > 1 THEN [text] ELSE [] END)) AS raw,
         unnest(range(len(ls) + (len(ls) > 1)::INT)) AS pos FROM l),
v AS (
  SELECT doc_id, h, pos, string_split(trim(regexp_replace(lower(raw), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w
  FROM u),
o AS (
  SELECT doc_id, h, pos, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS ours FROM v),
m AS (
  SELECT doc_id, h, pos, license, len(list_intersect(ours, theirs)) AS shared, len(ours) + len(theirs) AS total
  FROM o JOIN t ON len(ours) BETWEEN ceil(len(theirs) * 0.8 / 1.2 - 1e-9) AND floor(len(theirs) * 1.2 / 0.8 + 1e-9) AND len(ours) > 0),
b AS (
  SELECT * FROM m WHERE 2 * shared >= 0.8 * total
  QUALIFY row_number() OVER (PARTITION BY doc_id, h, pos ORDER BY shared / total DESC, license, total) = 1)
SELECT doc_id, license, n_hits, shared, total FROM (
  SELECT doc_id, license, count(*) OVER w AS n_hits, shared, total,
         row_number() OVER (PARTITION BY doc_id, license ORDER BY shared / total DESC, total DESC) AS r
  FROM b WINDOW w AS (PARTITION BY doc_id, license)) WHERE r = 1
"""

AUDIT = r"""
WITH f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS fs FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT array_to_string(fs, '') AS filter_order, fs, unnest(range(1, 6)) AS step FROM o),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, """ + WORDS.format("t") + r""" AS ws, doc_id > min(doc_id) OVER (PARTITION BY t) AS dup FROM t),
l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n,
         list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c
                     WHEN 'D' THEN d ELSE e END) AS fails
  FROM (SELECT w.*, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
               100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
               regexp_matches(t, '[#$%&*|]') AS d, coalesce(dup, false) AS e FROM w) v LEFT JOIN l USING (doc_id)
  GROUP BY ALL),
g AS (
  SELECT m.*, filter_order, fs, step, list_contains(fails, fs[step]) AS f,
         len(list_intersect(fails, fs[1:step - 1])) > 0 AS early FROM m, s),
r AS (
  SELECT part, filter_order, step, fs[step] AS x,
         coalesce(sum(n) FILTER (NOT f AND NOT early), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (f AND NOT early), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (f AND early), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = [fs[step]]), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (f AND NOT early AND good = 1), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (f AND NOT early AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM g GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley
FROM r
"""

#: CRC-32 by its table, for each distinct word
IMPORTANCE = r"""
WITH RECURSIVE k AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS step FROM range(256) x(i)
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM k WHERE step < 8),
tbl AS (SELECT list(c ORDER BY byte) AS t FROM k WHERE step = 8),
d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
x AS (SELECT r, unnest(ws) AS w FROM d),
u AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM x UNION SELECT w FROM b)),
z AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2),
              lambda i: ('0x' || h[i:i + 1])::BIGINT)),
            lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM u, tbl),
s AS (SELECT bucket, count(*) AS n FROM x JOIN z USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM b JOIN z USING (w) GROUP BY 1),
g AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM x) + 10000))::DOUBLE
         / ((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM b) + 10000)))) AS gain
  FROM s FULL JOIN t USING (bucket)),
v AS (SELECT r, sum(gain)::BIGINT AS weight FROM x JOIN z USING (w) JOIN g USING (bucket) GROUP BY 1),
y AS (
  SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
         (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN v USING (r)),
q AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM q
"""

ORACLE = {
    "op1_quality_rules": QUALITY,
    "op2_license_scan": LICENSES,
    "op3_chat_format": CHAT,
    "op6_line_dedup": LINES,
    "op9_html_text": PAGES,
    "op10_ngram_jaccard": JACCARD,
    "op11_filter_audit": AUDIT,
    "op13_importance": IMPORTANCE,
}
