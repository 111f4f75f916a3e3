"""DuckDB SQL of the queries that SQL can express."""

QUALITY_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
tri AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS c
  FROM (SELECT k, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT k, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3))),
rep AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE c > 1) GROUP BY k),
ln AS (
  SELECT k, count(*) AS n, count(DISTINCT x) AS u
  FROM (SELECT k, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (
  SELECT d.*, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(ln.n, 0) AS n_lines, CAST(coalesce(ln.n - ln.u, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (k) LEFT JOIN ln USING (k)),
r AS (
  SELECT *, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbols,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats,
         CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m),
v AS (
  SELECT lang, source, u.metric AS metric, u.value AS value
  FROM (SELECT lang, source, unnest([{'metric': 'symbols', 'value': symbols}, {'metric': 'dup_lines', 'value': dup_lines},
                                     {'metric': 'repeats', 'value': repeats}, {'metric': 'word_length', 'value': word_length}]) AS u
        FROM r WHERE NOT base_failed)),
s AS (
  SELECT lang, source, metric, (value >> e) << e AS bucket, count(*) AS n
  FROM (SELECT *, CAST(greatest(0, length(bin(value)) - 6) AS BIGINT) AS e FROM v) GROUP BY ALL),
own AS (
  SELECT lang, source, metric, max(docs) AS docs, min(bucket) FILTER (4 * up >= docs) AS q1,
         min(bucket) FILTER (4 * up >= 3 * docs) AS q3
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS up,
               sum(n) OVER (PARTITION BY lang, source, metric) AS docs FROM s) GROUP BY ALL),
wide AS (
  SELECT lang, metric, min(bucket) FILTER (4 * up >= docs) AS q1, min(bucket) FILTER (4 * up >= 3 * docs) AS q3
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, metric ORDER BY bucket) AS up, sum(n) OVER (PARTITION BY lang, metric) AS docs
        FROM (SELECT lang, metric, bucket, sum(n) AS n FROM s GROUP BY ALL)) GROUP BY ALL),
lim AS (
  SELECT o.lang, o.source, o.metric, CASE WHEN docs < 40 THEN w.q1 ELSE o.q1 END AS q1,
         CASE WHEN docs < 40 THEN w.q3 ELSE o.q3 END AS q3,
         CASE o.metric WHEN 'symbols' THEN 100 WHEN 'word_length' THEN 1000 ELSE 250 END AS slack
  FROM own o JOIN wide w ON o.lang IS NOT DISTINCT FROM w.lang AND o.metric = w.metric),
cut AS (
  SELECT lang, source,
         max(q3 + 3 * (q3 - q1) + slack) FILTER (metric = 'symbols') AS symbols_high,
         max(q3 + 3 * (q3 - q1) + slack) FILTER (metric = 'dup_lines') AS dup_lines_high,
         max(q3 + 3 * (q3 - q1) + slack) FILTER (metric = 'repeats') AS repeats_high,
         max(q3 + 3 * (q3 - q1) + slack) FILTER (metric = 'word_length') AS word_length_high,
         max(q1 - 3 * (q3 - q1) - slack) FILTER (metric = 'word_length') AS word_length_low
  FROM lim GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbols <= symbols_high AND dup_lines <= dup_lines_high AND repeats <= repeats_high
         AND word_length <= word_length_high AND word_length >= word_length_low, false) AS kept,
       CAST(symbols_high AS BIGINT) AS symbols_high, CAST(dup_lines_high AS BIGINT) AS dup_lines_high,
       CAST(repeats_high AS BIGINT) AS repeats_high, CAST(word_length_high AS BIGINT) AS word_length_high,
       CAST(word_length_low AS BIGINT) AS word_length_low
FROM r LEFT JOIN cut ON r.lang IS NOT DISTINCT FROM cut.lang AND r.source IS NOT DISTINCT FROM cut.source
"""

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM d
"""

SUBSTRING_DEDUP = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT k, doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h
  FROM (SELECT *, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT h, min(doc_id) AS first_doc FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT k, p FROM (SELECT k, unnest(generate_series(i, i + 12)) AS p FROM g JOIN f USING (h) WHERE doc_id > first_doc)),
o AS (
  SELECT k, p, word, gone.p IS NOT NULL AS removed
  FROM (SELECT k, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM d) LEFT JOIN gone USING (k, p)),
s AS (
  SELECT k, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT removed) AS kept FROM o GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (k)
"""

NEAR_DEDUP = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS x
  FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 2)
  UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM (SELECT p.doc_id, q.doc_id AS other, count(*) AS common FROM s p JOIN s q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL) c
  JOIN n a ON a.doc_id = c.doc_id JOIN n b ON b.doc_id = c.other
  WHERE 100 * common >= 80 * (a.n + b.n - common)),
reach AS (
  SELECT doc_id AS id, doc_id AS root FROM n
  UNION
  SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id),
c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
"""


def _spans(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    return f"""
SELECT k, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
         'start': CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER),
         'kind': {number}, 'name': '{kind}', 'len': length(m[i]), 'value': v[i]}})) AS s
FROM (SELECT k, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v,
             string_split_regex(t, '{pattern}') AS g FROM d)
WHERE len(m) > 0"""


_ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
)

SECRET_SCAN = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
b AS (
  SELECT * FROM ({_spans('assign', 0, _ASSIGN, 2, 12)}) WHERE length(s.value) >= 12
  UNION ALL SELECT * FROM ({_spans('access', 1, 'AKIA[A-Z0-9]+', 0, 18)}) WHERE length(s.value) >= 18
  UNION ALL SELECT * FROM ({_spans('hex', 2, '[0-9a-f]{16,}', 0, 16)}) WHERE length(s.value) >= 16),
l AS (
  SELECT k, s FROM ({_spans('live', 3, '[A-Za-z0-9+/_=-]{20,}', 0, 20)}) x
  WHERE length(s.value) >= 20 AND regexp_matches(s.value, '[a-z]') AND regexp_matches(s.value, '[A-Z]') AND regexp_matches(s.value, '[0-9]')
    AND len(list_distinct(string_split(s.value, ''))) >= 10
    AND NOT EXISTS (SELECT 1 FROM b WHERE b.k = x.k AND b.s.start < x.s.start + x.s.len AND x.s.start < b.s.start + b.s.len)),
a AS (SELECT * FROM b UNION ALL SELECT * FROM l),
o AS (SELECT s.value AS value, count(DISTINCT coalesce(source, chr(0))) AS owners FROM a JOIN d USING (k) GROUP BY 1),
r AS (SELECT k, s, owners < 3 AS owned FROM a JOIN o ON o.value = s.value),
g AS (
  SELECT k, count(*) FILTER (s.kind = 0) AS n_assign, count(*) FILTER (s.kind = 1) AS n_access, count(*) FILTER (s.kind = 2) AS n_hex,
         string_agg(s.name || ':' || s.start || ':' || (s.start + s.len), ',' ORDER BY s.start, s.kind) FILTER (s.kind < 3) AS base,
         string_agg(s.name || ':' || s.start || ':' || (s.start + s.len), ',' ORDER BY s.start, s.kind) FILTER (s.kind < 3 OR owned) AS spans,
         count(*) FILTER (owned) AS n_owned
  FROM r GROUP BY k)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       CAST(coalesce(n_owned, 0) AS BIGINT) AS n_owned
FROM d LEFT JOIN g USING (k)
"""

CRC = r"""
crc AS (
  SELECT list(list_reduce([k, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY k) AS t
  FROM (SELECT unnest(generate_series(0, 255)) AS k))"""

#: The checksum of the list of bytes {bytes}, with the table t of ``CRC``.
CRC_OF = "xor(list_reduce(list_concat([4294967295], {bytes}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"

CONVERSATION_REPAIR = r"""
WITH RECURSIVE""" + CRC + r""",
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         """ + CRC_OF.format(bytes="list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)") + r""" % 20 AS kind
  FROM conversations, crc),
dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS again FROM raw WHERE kind <> 0)),
num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM dam)),
flt AS (
  SELECT *, left(role, 1) AS ini,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
              WHEN regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS was,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM num),
ins(s, s2, ic, il) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 2, 3, 'I'), (1, 3, 6, 'II'),
         (2, 3, 3, 'I'), (3, 2, 3, 'I')),
edit(s2, ini, letter, ec, s3) AS (
  SELECT s, NULL::VARCHAR, 'D', 4, s FROM (VALUES (0), (1), (2), (3)) AS x(s)
  UNION ALL SELECT s, NULL::VARCHAR, 'R', 3, CASE s WHEN 2 THEN 3 ELSE 2 END FROM (VALUES (0), (1), (2), (3)) AS x(s)
  UNION ALL VALUES (0, 's', 'K', 0, 1), (0, 'u', 'K', 0, 2), (1, 'u', 'K', 0, 2), (2, 'a', 'K', 0, 3), (3, 'u', 'K', 0, 2)),
dp(conv_id, i, s, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': ''} FROM (SELECT DISTINCT conv_id FROM flt)
  UNION ALL
  SELECT f.conv_id, f.i, e.s3,
         min({'cost': (dp.best.cost + ins.ic + e.ec + CASE WHEN e.letter <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END)::BIGINT,
              'audit': dp.best.audit || ins.il || e.letter})
  FROM dp JOIN flt f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN ins ON ins.s = dp.s
       JOIN edit e ON e.s2 = ins.s2 AND (e.ini IS NULL OR e.ini = f.ini) AND (e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY f.conv_id, f.i, e.s3),
fin AS (
  SELECT dp.conv_id, min({'cost': (dp.best.cost + ins.ic)::BIGINT, 'audit': dp.best.audit || ins.il}) AS best
  FROM dp JOIN ins ON ins.s = dp.s AND ins.s2 IN (0, 3)
       JOIN (SELECT DISTINCT conv_id, n FROM flt) l ON l.conv_id IS NOT DISTINCT FROM dp.conv_id AND l.n = dp.i
  GROUP BY dp.conv_id),
spell AS (
  SELECT conv_id, best.audit AS a, unnest(generate_series(1, length(best.audit))) AS p FROM fin),
line AS (
  SELECT s.conv_id, s.p, substr(s.a, s.p, 1) AS letter, f.role, coalesce(f.text, '') AS text,
         row_number() OVER (PARTITION BY s.conv_id ORDER BY s.p) AS q,
         first_value(substr(s.a, s.p, 1) = 'K' AND f.ini = 's') OVER (PARTITION BY s.conv_id ORDER BY s.p) AS sys
  FROM spell s LEFT JOIN flt f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND substr(s.a, s.p, 1) <> 'I'
       AND f.i = length(replace(substr(s.a, 1, s.p), 'I', ''))
  WHERE substr(s.a, s.p, 1) <> 'D'),
mended AS (
  SELECT conv_id, sha256(string_agg(
           CASE WHEN letter = 'K' THEN role WHEN (q - CASE WHEN sys THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
           || ':' || text, chr(10) ORDER BY p)) AS h
  FROM line GROUP BY conv_id),
cnt AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND was || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM flt GROUP BY conv_id)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k
     LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM k.conv_id
     LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM k.conv_id
     LEFT JOIN mended ON mended.conv_id IS NOT DISTINCT FROM k.conv_id
"""

SPELLING_VARIANTS = r"""
WITH RECURSIVE""" + CRC + r""",
run AS (
  SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS x FROM documents WHERE text IS NOT NULL)
  GROUP BY ALL),
chk AS (
  SELECT run, n, """ + CRC_OF.format(bytes="list_transform(range(1, 1 + octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i - 1, 2))::BIGINT)") + r""" AS h
  FROM (SELECT *, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS b FROM run), crc),
w AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM chk)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
del AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT *, unnest(generate_series(1, length(word))) AS i FROM w)),
near AS (
  SELECT a.word AS word, b.word AS near, b.n AS near_n FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM del a JOIN w b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM del a JOIN w b ON a.d = b.word),
f AS (
  SELECT w.word, w.n, coalesce(x.n_near, 0) AS n_near, CASE WHEN x.near_n >= 5 * w.n THEN x.near END AS form,
         CASE WHEN x.near_n >= 5 * w.n THEN x.near_n END AS form_n
  FROM w LEFT JOIN (
    SELECT word, count(*) AS n_near, arg_min(near, {'k': -near_n, 'w': near}) AS near, max(near_n) AS near_n FROM near GROUP BY word) x
  USING (word)),
r(word, root, more) AS (
  SELECT word, word, form FROM f
  UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.more)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.more IS NULL
"""
