"""DuckDB forms of the queries that SQL can express."""

from __future__ import annotations

import re

from . import imatch, importance
from . import quality_rules as rules
from . import sharding


def _sharding() -> str:
    owners = ",".join(map(str, sharding.fill_table(sharding.shard_names(), sharding.SIZE)))
    return f"""
WITH owners AS (SELECT [{owners}] AS shards),
placed AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 15) AS BIGINT) % {sharding.SIZE} AS INTEGER) AS slot
  FROM documents)
SELECT doc_id, slot, CAST(shards[slot + 1] AS INTEGER) AS shard FROM placed, owners
"""


def _quality_rules() -> str:
    count = lambda x, pattern: f"len(regexp_extract_all({x}, '{pattern}'))"
    closing, menu = (re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", p).replace("'", "''") for p in (rules.CLOSING, rules.MENU))
    phrases = " OR ".join(f"contains(lower(l), '{p}')" for p in rules.BOILERPLATE)
    words = f"{rules.NON_SPACE}+"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
word AS (SELECT r, unnest(regexp_extract_all(text, '{words}')) AS w, generate_subscripts(regexp_extract_all(text, '{words}'), 1) AS i FROM docs),
gram AS (SELECT r, i, concat_ws(' ', w, lead(w, 1) OVER a, lead(w, 2) OVER a, lead(w, 3) OVER a, lead(w, 4) OVER a) AS g, lead(w, 4) OVER a AS last
  FROM word WINDOW a AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM gram WHERE last IS NOT NULL) WHERE n > 1),
again AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(5) AS t(j) GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM docs),
full_line AS (SELECT r, l, row_number() OVER (PARTITION BY r, l ORDER BY k) AS nth,
    {count('l', '[A-Z]')} AS upper_n, {count('l', '[a-z]')} AS lower_n, {count('l', rules.NON_SPACE)} AS chars, {count('l', words)} AS words,
    {count('l', f'[!?]{{2,}}({rules.SPACE}|$)')} AS marks, {count('l', rules.SYMBOLS)} AS symbols
  FROM line WHERE regexp_matches(l, '{rules.NON_SPACE}')),
judged AS (SELECT *, nth > 1 OR (upper_n >= 8 AND upper_n > lower_n) OR 5 * marks > words OR 10 * symbols > chars
    OR (words <= 12 AND NOT regexp_matches(rtrim(l, ' '), '{closing}') AND regexp_matches(l, '{menu}')) OR {phrases} AS bad
  FROM full_line),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE bad), 0) AS lost FROM judged GROUP BY r),
base AS (SELECT doc_id, {count('text', words)} AS n_words, {count('text', rules.NON_SPACE)} AS word_chars, {count('text', rules.SYMBOLS)} AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM docs LEFT JOIN lines USING (r) LEFT JOIN again USING (r)),
failed AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= {rules.MAX_LOST_PERCENT} * word_chars AS kept, CAST(lost AS BIGINT) AS lost_chars
FROM failed
"""


REPEATS = """
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS w FROM (SELECT r, h, unnest(range(CAST(len(h) // 2 - 199 AS BIGINT))) AS i FROM doc WHERE len(h) >= 400)),
rep AS (SELECT r, i FROM win WHERE w IN (SELECT w FROM win GROUP BY w HAVING count(*) > 1)),
step AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) > 200 AS apart FROM rep),
run AS (SELECT r, i, count(*) FILTER (WHERE apart) OVER (PARTITION BY r ORDER BY i) AS g FROM step),
span AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM run GROUP BY r, g),
gap AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS since, row_number() OVER (PARTITION BY r ORDER BY lo DESC) = 1 AS last FROM span),
cut AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS head, max(hi) AS tail FROM gap JOIN doc USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM doc LEFT JOIN cut USING (r)
"""

def _dartminhash() -> str:
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    return f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
gram AS (SELECT DISTINCT r, md5(CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END) AS g FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT r, count(*) AS n FROM gram GROUP BY r),
pair AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM pair JOIN size s ON s.r = x JOIN size t ON t.r = y WHERE 10 * c >= 8 * (s.n + t.n - c) UNION ALL SELECT a.r, b.r FROM doc a JOIN doc b ON len(a.w) = 0 AND len(b.w) = 0 AND a.r <> b.r),
reach AS (WITH RECURSIVE t AS (SELECT r AS x, r AS y FROM doc UNION SELECT t.x, link.y FROM t JOIN link ON link.x = t.y) SELECT * FROM t),
class AS (SELECT x AS r, min(doc_id) AS class_id FROM reach JOIN doc ON doc.r = reach.y GROUP BY x)
SELECT doc_id, class_id, doc_id = class_id AS kept FROM doc JOIN class USING (r)
"""


def _imatch() -> str:
    m = imatch
    subsets = ", ".join(f"({s}, {a}, {b}, {limit}, {s % len(m.DENSITIES) * (m.SUBSETS // len(m.DENSITIES)) + s // len(m.DENSITIES)})" for s, (a, b, limit) in enumerate(m.multipliers()))
    code = lambda x: f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"
    number = lambda x: f"CAST('0x' || substr(md5({x}), 1, 7) AS INTEGER) + 1"
    return f"""
WITH subset(s, a, b, lim, place) AS (VALUES {subsets}),
doc AS (SELECT row_number() OVER (ORDER BY doc_id DESC) AS r, doc_id, coalesce(text, '') AS t FROM documents),
nxt AS (SELECT r, doc_id, t, coalesce(lead(t) OVER (ORDER BY r), first_value(t) OVER (ORDER BY r)) AS u FROM doc),
ed AS (SELECT *, left(t, length(t) - length(t) // 2) || CASE WHEN length(t) < 2 THEN '' ELSE left(u, length(t) // 2) END AS e FROM nxt),
kinds AS (SELECT r, 0 AS kind, t FROM ed UNION ALL SELECT r, 1, e FROM ed UNION ALL SELECT r, 2, u FROM ed),
term AS (SELECT DISTINCT r, kind, w FROM (SELECT r, kind, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w FROM kinds)),
lex AS (SELECT w, {code('w')} AS code FROM term WHERE kind = 0 GROUP BY w HAVING count(*) >= greatest(2, {m.LOW} * (SELECT count(*) FROM doc)) AND count(*) <= {m.HIGH} * (SELECT count(*) FROM doc)),
part AS MATERIALIZED (SELECT w, code, s, place FROM lex, subset WHERE (code % {m.PRIME} * a + b) % {m.PRIME} < lim),
met AS (SELECT DISTINCT r, kind FROM term JOIN lex USING (w)),
hashed AS MATERIALIZED (SELECT r, kind, place, {number("string_agg(CAST(code AS VARCHAR), ',' ORDER BY code)")} AS h FROM term JOIN part USING (w) GROUP BY r, kind, place),
full_print AS MATERIALIZED (SELECT k.r, k.kind, p.place, CASE WHEN met.r IS NULL THEN {number("'text:' || md5(k.t)")} ELSE coalesce(h, 0) END AS h
  FROM kinds k CROSS JOIN (SELECT DISTINCT place FROM subset) p LEFT JOIN met ON met.r = k.r AND met.kind = k.kind LEFT JOIN hashed ON hashed.r = k.r AND hashed.kind = k.kind AND hashed.place = p.place),
near AS (SELECT a.r, b.kind, coalesce(CAST(count(*) FILTER (WHERE a.h = b.h AND a.h > 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE a.h + b.h > 0), 0), 0.0) AS n FROM full_print a JOIN full_print b ON a.r = b.r AND a.place = b.place AND a.kind = 0 GROUP BY a.r, b.kind),
print AS (SELECT r, kind, string_agg(CAST(h AS VARCHAR), '.' ORDER BY place) AS f FROM full_print GROUP BY r, kind)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(e) AS edited_sha256, p0.f AS fingerprint, p1.f AS edited_fingerprint, CAST(n1.n AS DOUBLE) AS near_edited, CAST(n2.n AS DOUBLE) AS near_next
FROM ed JOIN print p0 ON p0.r = ed.r AND p0.kind = 0 JOIN print p1 ON p1.r = ed.r AND p1.kind = 1 JOIN near n1 ON n1.r = ed.r AND n1.kind = 1 JOIN near n2 ON n2.r = ed.r AND n2.kind = 2
"""


#: Words of operators 11 to 13, after A-Z are lower-cased.
_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

RANKED = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS length FROM doc WHERE len(w) > 0),
tf AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS t FROM doc) GROUP BY r, t),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
size AS (SELECT r, doc_id, CAST(75 + (25 * CAST(len(w) AS HUGEINT) * docs) // length AS BIGINT) AS m FROM doc, total WHERE len(w) > 0),
item AS (SELECT item_id, t, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, t),
scored AS (SELECT item_id, doc_id, CAST(sum(times * weight.w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM item JOIN tf USING (t) JOIN weight USING (t) JOIN size USING (r) GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def _importance() -> str:
    m = importance
    return f"""
WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS x FROM step WHERE k = 8),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
doc_word AS (SELECT r, unnest(w) AS t FROM doc),
item_word AS (SELECT unnest({_TERMS}) AS t FROM benchmark),
word AS (SELECT DISTINCT t, hex(encode(t)) AS h FROM (SELECT t FROM doc_word UNION ALL SELECT t FROM item_word)),
bucket AS MATERIALIZED (SELECT t, xor(4294967295, list_reduce(
    list_prepend(4294967295, [CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT) FOR k IN range(len(h) // 2)]),
    lambda c, b: xor(c // 256, x[xor(c % 256, b) + 1]))) % {m.BUCKETS} AS b FROM word, crc_table),
s AS (SELECT b, count(*) AS s FROM doc_word JOIN bucket USING (t) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM item_word JOIN bucket USING (t) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + {m.BUCKETS})
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + {m.BUCKETS})))) AS BIGINT) AS g
  FROM (SELECT DISTINCT b FROM bucket) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
weight AS (SELECT r, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM doc_word JOIN bucket USING (t) JOIN gain USING (b) GROUP BY r),
noise AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('{m.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM doc LEFT JOIN weight USING (r)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM noise),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {m.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN rank <= {m.PERCENT} * n // 100 THEN rank END AS BIGINT) AS rank FROM scored LEFT JOIN ranked USING (r)
"""


DECONTAMINATE = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
item AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
piece AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT k FROM piece),
gram AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM doc, size WHERE len(w) >= k)),
met AS MATERIALIZED (SELECT r, i, gram.k, g FROM gram WHERE EXISTS (SELECT 1 FROM piece WHERE piece.k = gram.k AND piece.g = gram.g)),
hit AS (SELECT r, count(DISTINCT i + j) AS n FROM met, range(10) t(j) WHERE j < k GROUP BY r),
of_item AS (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM met JOIN piece USING (k, g) WHERE item_id IS NOT NULL),
named AS (SELECT r, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS ids FROM of_item GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


ORACLES = {"op11_ranked_search": RANKED, "op12_importance": _importance(), "op13_decontaminate": DECONTAMINATE} | {"op1_dartminhash": _dartminhash(), "op8_imatch": _imatch(), "op9_suffix_dedup": REPEATS, "op5_quality_rules": _quality_rules(), "op6_sharding": _sharding()}
