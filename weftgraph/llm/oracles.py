"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import chat
from . import quality_rules as q

_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS k FROM per),
weighed AS (SELECT *, [3, 1, 2][(k - 1) % 3 + 1]::BIGINT AS w, 2 * source_size AS cap FROM placed),
summed AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS weight,
    coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM weighed WINDOW o AS (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), opened AS (SELECT *, 100 * cap * (weight - w_before) >= w * (150 * total - 100 * cap_before) AS is_open FROM summed),
level AS (
  SELECT 150 * total - 100 * cap_before AS rest, weight - w_before AS rest_w FROM opened WHERE is_open
  ORDER BY cap::DOUBLE / w, k LIMIT 1
), rated AS (
  SELECT source, source_size, CASE WHEN is_open THEN (w * rest)::DOUBLE / (rest_w * 100)::DOUBLE ELSE cap::DOUBLE END AS target
  FROM opened LEFT JOIN level ON true
), r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM rated)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN ('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT / 4294967296.0::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN r ON sized.source IS NOT DISTINCT FROM r.source
"""


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_PASSES = f"""
regexp_matches(line, {_lit(q.END)}) AND NOT regexp_matches(line, {_lit(q.STACKED)}) AND NOT regexp_matches(line, {_lit(q.MENU)})
AND 100 * len(regexp_extract_all(line, {_lit(q.SYMBOL)})) <= {q.MAX_SYMBOL_PERCENT} * length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))
AND NOT (regexp_matches(lower(line), {_lit(q.BOILERPLATE)})
  AND 100 * (length(lower(line)) - length(regexp_replace(lower(line), {_lit(q.BOILERPLATE)}, '', 'g'))) >= {q.MIN_BOILERPLATE_PERCENT} * length(lower(line)))
"""

_QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS p, unnest(list_zip(ws[1:len(ws) - 2], ws[2:len(ws) - 1], ws[3:])) AS g FROM w WHERE len(ws) > 2),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
wl AS (SELECT rid, line, min(k) AS k, count(*) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line),
judged AS (
  SELECT rid, sum(n - 1) AS dups, sum(CASE WHEN {_PASSES} THEN length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) ELSE 0 END) AS good FROM wl GROUP BY rid
), base AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, {_lit(q.SYMBOL)}))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(good, 0)::BIGINT AS good
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN judged USING (rid)
), f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * (word_chars - good) <= {q.MAX_LOST_PERCENT} * word_chars AS kept FROM f
"""


#: Base32 of a SHA-1: every 5 hexadecimal digits make 4 characters.
_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS h FROM p),
b AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(8), lambda i: list_reduce(list_transform(range(4), lambda j:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || h[5 * i + 1 : 5 * i + 5])::BIGINT >> (5 * (3 - j))) & 31)::INT + 1]), lambda x, y: x || y)), '') AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first OR first IS NULL THEN NULL ELSE first END::BIGINT AS refers_to
FROM b
"""


_CHAT = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id AS c, turn, role, translate(coalesce(text, ''), chr(1) || chr(2), '  ') AS t FROM conversations),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM m),
p AS (SELECT *, len(regexp_extract_all(regexp_extract(raw, '{chat.MARKS}', 1), '>')) AS marks FROM l),
i AS (
  SELECT rid, k, regexp_replace(raw, '{chat.MARKS}', '') AS body,
    CASE WHEN marks = 0 AND coalesce(lead(marks) OVER w, 0) > 0 AND regexp_matches(raw, '{chat.INTRODUCES}') THEN -1 ELSE marks END AS level FROM p WINDOW w AS (PARTITION BY rid ORDER BY k)
), g AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY k) AS block FROM (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY rid ORDER BY k) THEN 0 ELSE 1 END AS new FROM i)),
b AS (SELECT rid, block, any_value(level) AS level, string_agg(body, chr(10) ORDER BY k) AS text FROM g GROUP BY rid, block),
u AS (
  SELECT DISTINCT rid, block, level, norm FROM (
    SELECT rid, block, level, trim(lower(regexp_replace(x, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS norm FROM (
      SELECT rid, block, level, unnest([text] || string_split(regexp_replace(text, '{chat.SENTENCE}', '\1' || chr(1), 'g'), chr(1)) || string_split(text, chr(10))) AS x FROM b WHERE level >= 0)
  ) WHERE norm <> ''
), o AS (SELECT rid, trim(string_agg(text, chr(10) ORDER BY block), ' ') AS said FROM b WHERE level = 0 GROUP BY rid),
say AS (SELECT DISTINCT c, turn, norm FROM u JOIN m USING (rid) WHERE level = 0 AND c IS NOT NULL AND turn IS NOT NULL),
whole AS (SELECT rid, block, level, trim(lower(regexp_replace(text, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS whole FROM b WHERE level > 0),
passage AS (SELECT DISTINCT rid, level, whole, norm, len(string_split(norm, ' ')) AS n FROM whole JOIN u USING (rid, block, level)),
counted AS (SELECT rid, max(level) AS levels, count(DISTINCT (level, whole, parts)) AS n FROM (SELECT rid, block, level, whole, list(norm ORDER BY norm) AS parts FROM whole JOIN u USING (rid, block, level) GROUP BY ALL) GROUP BY rid),
inside AS (SELECT c, norm, min(turn) AS here FROM say GROUP BY ALL),
found AS (
  SELECT q.*, m.c, m.turn, (SELECT here FROM inside x WHERE x.c = m.c AND x.norm = q.norm AND here < m.turn) AS here,
    CASE WHEN n >= {chat.FAR_WORDS} THEN (SELECT min((x.c, x.here)) FROM inside x WHERE x.norm = q.norm AND x.c <> m.c) END AS far
  FROM passage q JOIN m USING (rid) WHERE m.c IS NOT NULL AND m.turn IS NOT NULL
), best AS (
  SELECT rid, level, whole, max((n, -here)) FILTER (here IS NOT NULL) AS near, min((-n, far)) FILTER (far IS NOT NULL) AS far FROM found GROUP BY ALL
), per AS (
  SELECT rid, count(*) FILTER (near IS NOT NULL OR far IS NOT NULL) AS n_linked, max((-level, -near[2])) FILTER (near IS NOT NULL) AS near_to,
    min((level, far[2][1], far[2][2])) FILTER (near IS NULL AND far IS NOT NULL) AS far_to FROM best GROUP BY rid
), t AS (SELECT DISTINCT c, turn FROM m),
r AS (
  SELECT m.*, coalesce(levels, 0)::BIGINT AS quote_levels, coalesce(n, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked, near_to IS NULL AND far_to IS NOT NULL AS outside, far_to,
    coalesce(near_to[2], CASE WHEN t.turn IS NOT NULL THEN m.turn - 1 END) AS parent, coalesce(o.said, '') AS said
  FROM m LEFT JOIN o USING (rid) LEFT JOIN counted USING (rid) LEFT JOIN per USING (rid) LEFT JOIN t ON t.c = m.c AND t.turn = m.turn - 1
), node AS (SELECT c, turn, min(parent) AS parent FROM r WHERE c IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
th(c, turn, thread, depth) AS (SELECT c, turn, turn, 0 FROM node WHERE parent IS NULL UNION ALL SELECT node.c, node.turn, th.thread, th.depth + 1 FROM th JOIN node ON node.c = th.c AND node.parent = th.turn)
SELECT r.c AS conv_id, r.turn, role, quote_levels, n_quotes, n_linked,
  CASE WHEN outside THEN far_to[2] WHEN parent IS NOT NULL THEN r.c END AS reply_conv, CASE WHEN outside THEN far_to[3] ELSE parent END AS reply_turn, said AS reply_text,
  thread, depth::BIGINT AS depth, CASE WHEN thread IS NOT NULL THEN row_number() OVER (PARTITION BY r.c ORDER BY thread NULLS LAST, r.turn, md5(t), role NULLS FIRST) - 1 END AS place
FROM r LEFT JOIN th ON th.c = r.c AND th.turn = r.turn
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _WARC, "op7_mixing": _MIX, "op8_quality_rules": _QUALITY, "op9_chat_quotes": _CHAT}
