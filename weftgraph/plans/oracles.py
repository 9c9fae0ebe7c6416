"""DuckDB SQL of the graph queries, written against the semantics and not the DataFrame plans."""

from __future__ import annotations

from weftgraph.operators.store import GRACE_SECONDS
from weftgraph.plans import queries as q
from weftgraph.sources import tables as t


def _with(graph: str | None = None, kind: str | None = None, rest: str = "") -> str:
    parts = []
    if graph:
        parts.append(f"edges AS ({t.oracle(t.GRAPHS[graph])})")
    if kind:
        parts.append(f"blocks AS ({t.oracle(t.BLOCKS[kind])})")
    return "WITH RECURSIVE " + ",\n".join([*parts, *([rest] if rest else [])]) + "\n"


_VERSIONS = f"""
b AS ({t.oracle(t.BLOCKS["versions"])}), tomb AS ({t.oracle(t.TOMBSTONES)}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY sequence DESC) AS n FROM (
    SELECT id, sequence, source_uri, metadata_json, content, true AS live FROM b UNION ALL SELECT id, sequence, NULL, NULL, NULL, false FROM tomb)
), live AS (SELECT id, sequence, source_uri, metadata_json, content FROM ranked WHERE n = 1 AND live), ue AS ({t.oracle(q.USER_EDGES)})
"""
_V = f"WITH {_VERSIONS}"
_IDS = "(VALUES " + ", ".join(f"({k}, '{i}')" for k, i in enumerate(q.IDS)) + ") AS w(ord, id)"
_LIVE_UE = "SELECT src, dst, edge_type FROM ue WHERE src IN (SELECT id FROM live) AND dst IN (SELECT id FROM live)"
_EXPIRED = f"{q.NOW_US} > deletion_ts_us + {GRACE_SECONDS * 1_000_000}"


def _reach(start: str, direction: str, depth: int, where: str = "true") -> str:
    """CTE reach(id, depth): least number of moves."""
    move = {"outgoing": "SELECT src AS a, dst AS b FROM edges WHERE {w}", "incoming": "SELECT dst AS a, src AS b FROM edges WHERE {w}"}
    move["bidirectional"] = f"{move['outgoing']} UNION {move['incoming']}"
    return f"""mv AS ({move[direction].format(w=where)}),
walk(id, depth) AS (SELECT '{start}', 0 UNION SELECT mv.b, depth + 1 FROM walk JOIN mv ON mv.a = walk.id WHERE depth < {depth}),
reach AS (SELECT id, min(depth)::INT AS depth FROM walk GROUP BY id)"""


def _bfs(graph: str, start: str, direction: str, depth: int, where: str = "true", tail: str = "SELECT id, depth FROM reach", kind: str | None = None) -> str:
    return _with(graph, kind, _reach(start, direction, depth, where)) + tail


_IN_WS = "SELECT id, depth FROM reach WHERE id IN (SELECT id FROM blocks WHERE json_extract_string(metadata_json, '$.codebase') = '{}')"
_NUM = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_BATCH = "batch AS (SELECT 'user:' || (i % 50) AS id, 3000 + i * 400 AS sequence, 'c' || i AS content, i AS ord FROM range(60) AS r(i)), kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sequence DESC, ord DESC) AS n FROM batch) WHERE n = 1), judged AS (SELECT kept.id, kept.sequence, kept.content, live.sequence IS NOT NULL AND kept.sequence <= live.sequence AS skip FROM kept LEFT JOIN live USING (id))"

_UNIT = """u AS (SELECT id, json_extract_string(metadata_json, '$.codebase') AS ws, json_extract_string(metadata_json, '$.unit_type') AS kind,
  string_split(json_extract_string(metadata_json, '$.unit_id'), ':') AS p, json_extract_string(metadata_json, '$.file_path') AS path FROM blocks)"""


def _words(words: list[str], threshold: float, tail: str) -> str:
    hits = " + ".join(f"contains(content, '{w}')::INT" for w in words)
    return _with(None, "documents") + f"SELECT id, round(s::DOUBLE, 6) AS similarity FROM (SELECT id, (({hits})::FLOAT / {len(words)}::FLOAT)::FLOAT AS s FROM blocks) WHERE s >= {threshold}::FLOAT {tail}"


_CONTEXT = """ws AS (SELECT id FROM blocks WHERE json_extract_string(metadata_json, '$.codebase') = 'ASIA'),
anchors AS (SELECT id FROM ws WHERE id = 'region:2' UNION SELECT id FROM blocks WHERE json_extract_string(metadata_json, '$.codebase') = 'ASIA'
  AND json_extract_string(metadata_json, '$.unit_type') = 'type' AND content = 'NATION_2'),
one AS (SELECT src AS id, 1 AS depth FROM edges WHERE edge_type = 'defined_in' AND dst IN (SELECT id FROM anchors) AND src IN (SELECT id FROM ws)),
two(id, depth) AS (SELECT id, 0 FROM anchors UNION SELECT dst, depth + 1 FROM two JOIN edges ON src = two.id WHERE depth < 2 AND dst IN (SELECT id FROM ws)),
nodes AS (SELECT id, min(depth)::INT AS depth FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY id)"""


def _parts(x: str, big: int, first: str, small: int, second: str) -> str:
    return f"({x} // {big}) || '{first}' || CASE WHEN {x} % {big} // {small} = 0 THEN '' ELSE ' ' || ({x} % {big} // {small}) || '{second}' END"


_EDGES_OF = """(SELECT concat('src/customer/', c_custkey, '.zig:customer_', c_custkey) AS caller, 'calls' AS edge_type, concat('src/nation/', c_nationkey, '.zig:nation_', c_nationkey) AS callee FROM customer
UNION ALL SELECT concat('src/nation/', n_nationkey, '.zig:nation_', n_nationkey), 'calls_method', concat('src/region/', n_regionkey, '.zig:region_', n_regionkey) FROM nation
UNION ALL SELECT concat('src/region/', r_regionkey, '.zig:Region.name'), 'method_of', concat('src/region/', (SELECT max(r_regionkey::VARCHAR) FROM region), '.zig:Region') FROM region)"""
#: path, unit, kind, parent, first and last line, edges, content without the file's other units.
_UNITS_OF = """u(path, unit, kind, parent, line_start, line_end, n_edges, content) AS (
SELECT concat('src/customer/', c_custkey, '.zig'), concat('customer_', c_custkey), 'function', NULL, 1, 4, 2, concat('pub fn customer_', c_custkey, '() void {', chr(10), '    nation_', c_nationkey, '();', chr(10), '    ledger.post("{", ', c_custkey, ');', chr(10), '}') FROM customer
UNION ALL SELECT concat('src/nation/', n_nationkey, '.zig'), 'region', 'import', NULL, 1, 1, 0, 'const region = @import("region.zig")' FROM nation
UNION ALL SELECT concat('src/nation/', n_nationkey, '.zig'), concat('nation_', n_nationkey), 'function', NULL, 2, 4, 1, concat('pub fn nation_', n_nationkey, '() void {', chr(10), '    region.region_', n_regionkey, '();', chr(10), '}') FROM nation
UNION ALL SELECT concat('src/region/', r_regionkey, '.zig'), 'Region', 'type', NULL, 1, 3, 0, concat('pub const Region = struct {', chr(10), '    pub fn name() void {}', chr(10), '}') FROM region
UNION ALL SELECT concat('src/region/', r_regionkey, '.zig'), 'Region.name', 'function', 'Region', 2, 2, 1, 'pub fn name() void {}' FROM region
UNION ALL SELECT concat('src/region/', r_regionkey, '.zig'), concat('region_', r_regionkey), 'function', NULL, 4, 6, 0, concat('pub fn region_', r_regionkey, '() void {', chr(10), '    // ', r_name, chr(10), '}') FROM region)"""

#: Of each node before the target, its least shortest path from part:1.
_PATHS = """walk(id, depth, path) AS (SELECT 'part:1', 0, ['part:1'] UNION ALL
  SELECT dst, depth + 1, list_append(path, dst) FROM walk JOIN edges ON src = walk.id WHERE depth < 3),
first AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id), hit AS (SELECT path, depth, path[-2] AS via FROM walk WHERE id = 'part:150'),
best AS (SELECT via, min((hit.depth, path)) AS b FROM hit JOIN first ON first.id = via AND hit.depth = first.depth + 1 GROUP BY via)"""


def _ingestion() -> dict[str, str]:
    doc = _with(None, "documents")
    lines = "len(content) - len(replace(content, chr(10), '')) + 1"
    info = _with(None, "units", "i AS (SELECT id, source_uri AS uri, content AS preview, strlen(metadata_json)::BIGINT AS metadata_size FROM blocks)")
    return {
        "ingest_files": f"SELECT CASE WHEN path LIKE 'src/customer/%' THEN 'c.zig' WHEN path LIKE 'src/nation/%' THEN 'n.zig' ELSE 'r.zig' END AS kind, content FROM ({t.oracle(t.FILES)})",
        "ingest_units": f"WITH {_UNITS_OF} SELECT path, unit, kind, parent, line_start::INT AS line_start, line_end::INT AS line_end, n_edges::INT AS n_edges FROM u",
        "ingest_blocks": f"WITH {_UNITS_OF} SELECT sha256('w' || chr(31) || path || ':' || unit || chr(31) || line_start)[1:32] AS id, concat('file://', path, '#L', line_start, '-', line_end) AS source_uri, path || ':' || unit AS unit_id, content FROM u",
        "ingest_edges": f"SELECT caller, edge_type, callee FROM {_EDGES_OF}",
        "ingest_unresolved": "SELECT 'calls_method' AS edge_type, 'post' AS target, count(*) AS n FROM customer",
        "ingest_texts": f"""WITH f AS ({t.oracle(t.TEXTS)}) SELECT sha256('w' || chr(31) || path || ':document' || chr(31) || '1')[1:32] AS id, concat('file://', path, '#L1-', {lines}) AS source_uri,
  CASE WHEN ends_with(path, '.md') THEN 'text/markdown' ELSE 'text/plain' END AS content_type, strlen(content)::BIGINT AS bytes FROM f""",
        "validate_blocks": f"""WITH f AS ({t.oracle(t.FAULTY)}) SELECT event_id, array_to_string(list_filter([CASE WHEN id = '' THEN 'id' END, CASE WHEN sequence <= 0 THEN 'sequence' END, CASE WHEN source_uri = '' THEN 'uri_empty' END,
  CASE WHEN NOT json_valid(metadata_json) THEN 'metadata_json' END, CASE WHEN content = '' THEN 'content_empty' END], lambda x: x IS NOT NULL), ',') AS errors FROM f""",
        "put_sequences": _V + f", docs AS ({t.oracle(t.BLOCKS['documents'])}) SELECT id, (greatest((SELECT max(sequence) FROM b), (SELECT max(sequence) FROM tomb)) + row_number() OVER (ORDER BY sequence))::BIGINT AS sequence FROM docs WHERE content <> ''",
        "delete_then_current": _V + f"SELECT id, sequence, source_uri FROM live WHERE id NOT IN {q.IDS[:2]}",
        "replay_blocks": _V + "SELECT id, sequence, source_uri FROM live",
        "replay_edges": _V + _LIVE_UE,
        "model_text": doc + f""", s AS (SELECT *, (({' + '.join(f"contains(content, '{w}')::INT" for w in q.MIXED.split(' '))})::FLOAT / {len(q.MIXED.split(' '))}::FLOAT)::FLOAT AS s FROM blocks),
o AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS ord FROM s WHERE s >= 0.6::FLOAT)
SELECT ord::INT AS ord, concat_ws(chr(10), '--- BEGIN CONTEXT BLOCK ---', concat('Block ', ord, ' (ID: ', id, ', Similarity: ', printf('%.3f', s::DOUBLE), '):'), concat('Source: ', source_uri), concat('Sequence: ', sequence),
  concat('Metadata: ', metadata_json), concat('Content: ', content), '--- END CONTEXT BLOCK ---') AS text FROM o WHERE ord <= 100""",
        "json_lines": info + "SELECT to_json({'id': id, 'uri': uri, 'preview': preview, 'metadata_size': metadata_size})::VARCHAR AS line FROM i",
        "csv_lines": info + """SELECT concat(id, ',"', replace(uri, '"', '""'), '","', replace(preview, '"', '""'), '",', metadata_size) AS line FROM i""",
        "workspace_status": _with("trade", "units") + """SELECT ws AS codebase, printf('%.1f ' || CASE WHEN x < 1048576 THEN 'KB' WHEN x < 1073741824 THEN 'MB' ELSE 'GB' END, round(x / CASE WHEN x < 1048576 THEN 1024.0::DOUBLE WHEN x < 1073741824 THEN 1048576.0::DOUBLE ELSE 1073741824.0::DOUBLE END, 1)) AS size,
  CASE WHEN n = 0 THEN 'never synced' WHEN 3700 - n <= 3600 THEN 'synced' ELSE 'sync needed' END AS status
FROM (SELECT ws, count(*) AS n, count(*) * 2048 + coalesce(sum(e), 0) * 64 AS x FROM (SELECT id, json_extract_string(metadata_json, '$.codebase') AS ws FROM blocks) LEFT JOIN (SELECT src AS id, count(*) AS e FROM edges GROUP BY 1) USING (id) WHERE ws IS NOT NULL GROUP BY ws)""",
    }


def oracle_sql() -> dict[str, str]:
    doc, ev = _with(None, "documents"), _with(None, "events")
    lang = "json_extract_string(metadata_json, '$.lang')"
    out = {
        "scan_all": _V + "SELECT id, sequence, source_uri, metadata_json, content FROM live",
        "mvcc_latest": _V + "SELECT id, sequence, source_uri FROM live",
        "find_block": _V + "SELECT id, sequence, source_uri FROM live WHERE id = 'user:7'",
        "find_blocks": _V + f"SELECT ord::BIGINT AS ord, id, sequence FROM live JOIN {_IDS} USING (id)",
        "block_exists": _V + f"SELECT DISTINCT id, id IN (SELECT id FROM live) AS present FROM {_IDS}",
        "count_existing": _V + f"SELECT count(*) AS n FROM live JOIN {_IDS} USING (id)",
        "block_sequence": _V + "SELECT sequence FROM live WHERE id = 'user:3'",
        "block_count": _V + "SELECT count(*) AS versions, count(DISTINCT id) AS ids FROM b",
        "result_state": _V + "SELECT run, CASE run WHEN 2 THEN 0 ELSE n END AS n, run = 2 OR n = 0 AS is_empty FROM (SELECT count(*) AS n FROM live), (VALUES (0), (1), (2)) AS r(run)",
        "out_edges": _with("trade") + "SELECT src, dst, edge_type FROM edges WHERE src = 'order:1'",
        "in_edges": _with("trade") + f"SELECT src, dst, edge_type FROM edges WHERE dst = '{q.START}'",
        "edge_count": _with("trade") + "SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type",
        "live_edges": _V + _LIVE_UE,
        "invalid_edges": _V + """SELECT src, dst, CASE WHEN s AND d THEN 'source_missing,target_missing' WHEN s THEN 'source_missing' ELSE 'target_missing' END AS errors
FROM (SELECT *, src NOT IN (SELECT id FROM live) AS s, dst NOT IN (SELECT id FROM live) AS d FROM ue) WHERE s OR d""",
        "put_edges": _V + f"SELECT src, dst, edge_type FROM ue WHERE src < 'user:2' UNION {_LIVE_UE}",
        "remove_edge": "SELECT concat('nation:', n_nationkey) AS src, concat('region:', n_regionkey) AS dst, 'defined_in' AS edge_type FROM nation WHERE NOT (n_nationkey = 3 AND n_regionkey = 3)",
        "flush_sorted": _V + "SELECT id, sequence, source_uri FROM live",
        "shadowed": _V + "SELECT id, sequence, source_uri FROM b WHERE EXISTS (SELECT 1 FROM tomb WHERE tomb.id = b.id AND tomb.sequence > b.sequence)",
        "tombstone_gc": _V + f"SELECT id, sequence, {_EXPIRED} AS expired FROM tomb",
        "next_sequence": _V + "SELECT (1 + greatest((SELECT max(sequence) FROM b), (SELECT max(sequence) FROM tomb)))::BIGINT AS next_sequence",
        "compact_blocks": _V + "SELECT id, sequence, source_uri FROM live",
        "compact_tombstones": _V + f"SELECT id, sequence, deletion_ts_us FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sequence DESC) AS n FROM tomb) WHERE n = 1 AND NOT ({_EXPIRED})",
        "compact_edges": _V + _LIVE_UE,
        "block_info": _with(None, "units") + "SELECT id, source_uri[:256] AS uri, content[:256] AS preview, strlen(metadata_json)::BIGINT AS metadata_size FROM blocks",
        "batch_upsert": _V + ", " + _BATCH + " SELECT id, sequence::BIGINT AS sequence, content FROM judged WHERE NOT skip",
        "batch_overwrite": _V + ", " + _BATCH + " SELECT id, sequence::BIGINT AS sequence, content FROM judged",
        "batch_statistics": _V + ", " + _BATCH + """ SELECT 60::BIGINT AS submitted, (60 - count(*))::BIGINT AS duplicates, count(*) FILTER (skip) AS conflicts, count(*) FILTER (NOT skip) AS written,
  ((60 - count(*) + count(*) FILTER (skip)) * 100 // 60)::BIGINT AS dedup_percent, count(*) FILTER (NOT skip) * 100.0::DOUBLE / 60 AS success_percent FROM judged""",
        "filter_numeric": doc + "SELECT id FROM blocks WHERE strlen(content) > 2000",
        "filter_lexical": doc + "SELECT id FROM blocks WHERE source_uri >= 'doc://src3/100'",
        "filter_metadata_json": ev + "SELECT id FROM blocks WHERE json_extract_string(metadata_json, '$.k')::DOUBLE > 50",
        "filter_metadata_textual": ev + f"""SELECT id FROM (SELECT id, regexp_extract(metadata_json, '"k":[ "]*([^",]*)', 1) AS v FROM blocks)
WHERE CASE WHEN regexp_matches(v, '{_NUM}') THEN try_cast(v AS DOUBLE) > 50 ELSE v > '50' END""",
        "filter_tree": doc + f"SELECT id FROM blocks WHERE (contains(content, 'the') AND ends_with(source_uri, '7')) OR NOT ({lang} = 'en' OR starts_with(content, 'D'))",
        "filter_sequence": ev + "SELECT id, sequence FROM blocks WHERE sequence <= 500 AND sequence <> 42",
        "filter_decoded": doc + "SELECT id FROM blocks WHERE starts_with(content, 'T') AND sequence < 150.5",
        "filter_page": ev + "SELECT id FROM blocks WHERE content = 'view' ORDER BY id LIMIT 100 OFFSET 50",
        "filter_statistics": ev + """SELECT count(*) AS scanned, count(*) FILTER (content = 'view') AS matches, greatest(0, least(100, count(*) FILTER (content = 'view') - 50))::BIGINT AS returned,
  count(*) FILTER (content = 'view') > 150 AS has_more FROM blocks""",
        "edge_filter": _with("trade") + "SELECT edge_type, count(*) AS n FROM edges WHERE edge_type NOT IN ('contains', 'depends_on') GROUP BY 1",
        "workspace_filter": doc + f"SELECT id FROM blocks WHERE {lang} = 'fr'",
        "find_by_name": _with(None, "units", _UNIT) + """SELECT id FROM u WHERE ws = 'ASIA' AND ((kind = 'function' AND len(p) > 1 AND p[-1] = 'Customer#000000007') OR (kind = 'type' AND len(p) > 1 AND p[-1] = 'NATION_2'))""",
        "find_by_qualified_name": _with(None, "units", _UNIT) + "SELECT id FROM u WHERE ws = 'AFRICA' AND kind = 'function' AND len(p) > 2 AND p[-2] = 'NATION_10' AND p[-1] = 'Customer#000000003'",
        "find_by_file_path": _with(None, "units", _UNIT) + "SELECT id FROM u WHERE ws = 'EUROPE' AND path = 'src/geo.zig'",
        "structured_query": _with(None, "units", _UNIT) + "SELECT id FROM u WHERE ws = 'ASIA' AND kind = 'function' AND len(p) > 1 AND p[-1] = 'Customer#000000007'",
        "keyword_search": _words(q.MIXED.split(" "), 0.6, "ORDER BY s DESC, id LIMIT 100"),
        "keyword_all": _words("idiot  clown the".split(" "), 0.5, ""),
        "bfs_incoming": _bfs("trade", q.START, "incoming", 3),
        "bfs_outgoing": _bfs("parts", "part:1", "outgoing", 3),
        "bfs_bidirectional": _bfs("trade", "region:1", "bidirectional", 2),
        "bfs_typed": _bfs("trade", q.START, "incoming", 4, "edge_type IN ('defined_in', 'references')"),
        "bfs_limited": _bfs("trade", q.START, "incoming", 2, tail="SELECT id, depth FROM reach ORDER BY depth, id LIMIT 40"),
        "bfs_walks": _with("event_types", None, """walk(id, depth, path) AS (SELECT 'view', 0, 'view' UNION ALL
  SELECT dst, depth + 1, path || '>' || dst FROM walk JOIN edges ON src = walk.id WHERE depth < 4 AND dst <> 'view')""") + "SELECT id, depth, path FROM walk",
        "astar": _bfs("parts", "part:2", "outgoing", 2),
        "cheapest": _with("trade", None, f"""walk(id, depth, cost) AS (SELECT '{q.START}', 0, 0.0::DOUBLE UNION
  SELECT src, depth + 1, cost + CASE edge_type WHEN 'defined_in' THEN 1.0 WHEN 'references' THEN 2.0 ELSE 4.0 END FROM walk JOIN edges ON dst = walk.id WHERE depth < 3)""") + "SELECT id, min(cost) AS cost FROM walk GROUP BY id",
        "bidirectional_search": _bfs("parts", "part:1", "outgoing", 2),
        "meet_in_middle": _bfs("parts", "part:1", "outgoing", 6, tail="SELECT depth AS hops FROM reach WHERE id = 'part:150'"),
        "strongly_connected": "WITH n AS (SELECT *, concat('turn:', conv_id, ':', turn) AS id FROM conversations), e AS (SELECT conv_id, min(turn) AS first FROM n GROUP BY conv_id) "
        "SELECT DISTINCT id, min(id) OVER (PARTITION BY conv_id) AS component FROM n "
        "UNION SELECT x, x FROM (SELECT concat('turn:', conv_id // 2, ':', first) AS x FROM e WHERE conv_id BETWEEN 1 AND 7) WHERE x NOT IN (SELECT id FROM n)",
        "topological_sort": _with("trade", None, "walk(id, level) AS (SELECT 'order:1', 0 UNION SELECT dst, level + 1 FROM walk JOIN edges ON src = walk.id WHERE level < 8)") + "SELECT id, max(level)::INT AS level FROM walk GROUP BY id",
        "topological_cycle": "SELECT ''::VARCHAR AS id, 0::INT AS level WHERE false",
        "has_cycle": _with("event_types", None, "r(a, b) AS (SELECT src, dst FROM edges UNION SELECT r.a, dst FROM r JOIN edges ON src = r.b)") + "SELECT count(*) > 0 AS has_cycle, 'event_types' AS graph FROM r WHERE a = b AND (a = 'view' OR a IN (SELECT b FROM r WHERE a = 'view')) UNION ALL SELECT false, 'trade'",
        "paths_between": _with("parts", None, _PATHS) + "SELECT array_to_string(b[2], '>') AS path, b[1]::INT AS hops FROM best ORDER BY b[1], b[2] LIMIT 100",
        "paths_over": _with("parts", None, _PATHS) + "SELECT array_to_string(b[2], '>') AS path, b[1]::INT AS hops FROM best ORDER BY b[1], b[2] LIMIT 100",
        "dfs_tree": _with("trade", None, """walk(id, depth, path) AS (SELECT 'region:2', 0, ['region:2'] UNION ALL
  SELECT src, depth + 1, list_append(path, src) FROM walk JOIN edges ON dst = walk.id WHERE depth < 2 AND edge_type = 'defined_in')""")
        + "SELECT (row_number() OVER (ORDER BY list_append(path, chr(1114111)) DESC) - 1)::INT AS ord, id, depth, array_to_string(path, '>') AS path FROM walk",
        "traverse_dispatch": _with("trade", None, _reach("order:1", "outgoing", 4))
        + "SELECT a AS algorithm, id FROM reach, (VALUES ('breadth_first', 4), ('depth_first', 4), ('astar', 4), ('bidirectional', 2), ('topological', 4)) AS v(a, most) WHERE depth <= most UNION ALL SELECT 'strongly_connected', 'order:1'",
        "find_callers": _bfs("trade", "nation:1", "incoming", 3, kind="units", tail=_IN_WS.format("AMERICA")),
        "find_callees": _bfs("trade", "customer:3", "outgoing", 4, kind="units", tail=_IN_WS.format("AFRICA")),
        "find_references": _bfs("trade", "region:3", "bidirectional", 3, kind="units", tail=_IN_WS.format("EUROPE")),
        "k_hop": _with("parts", None, "walk(id, depth) AS (SELECT dst, 1 FROM edges WHERE src = 'part:1' UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = walk.id WHERE depth < 2)") + "SELECT DISTINCT id FROM walk",
        "can_reach": _bfs("trade", "nation:1", "outgoing", 10, "edge_type = 'defined_in'", tail="SELECT count(*) > 0 AS reachable, 'region:1' AS target FROM reach WHERE id = 'region:1' UNION ALL SELECT count(*) > 0, 'region:2' FROM reach WHERE id = 'region:2'"),
        "traversal_summary": _bfs("turns", "turn:3:0", "outgoing", 10, tail="SELECT count(*) AS blocks_traversed, max(depth)::INT AS max_depth_reached FROM reach"),
        "context_nodes": _with("trade", "units", _CONTEXT) + "SELECT id, depth FROM nodes",
        "context_edges": _with("trade", "units", _CONTEXT) + "SELECT DISTINCT src, dst, edge_type FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)",
        "context_metrics": _with("trade", "units", _CONTEXT) + "SELECT count(*) AS nodes, max(depth) AS max_depth, count(*) FILTER (depth = 0) AS anchors FROM nodes",
        "context_cost": "SELECT (10 * 2 + 5 * 2 * 4)::BIGINT AS micros, (2 * 10000)::BIGINT AS kilobytes, 10 * 2 + 5 * 2 * 4 > 1000000 OR 2 * 10000 > 100000 AS exceeds_limits",
        "context_utilization": _with("trade", "units", _CONTEXT) + """SELECT n AS node_count, e AS edge_count, n * 100 // 10000 AS node_percent, e * 100 // 40000 AS edge_percent
FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)) AS e)""",
        "context_neighbours": _with("trade", "units", _CONTEXT) + """SELECT DISTINCT dst AS id, 'out' AS way FROM edges WHERE src = 'nation:2' AND dst IN (SELECT id FROM nodes)
UNION ALL SELECT DISTINCT src, 'in' FROM edges WHERE dst = 'nation:2' AND src IN (SELECT id FROM nodes)""",
        "context_dangling": _with("trade", "units", _CONTEXT) + """SELECT src, dst, edge_type, CASE WHEN src NOT IN (SELECT id FROM nodes) THEN 'source' ELSE 'target' END AS missing
FROM edges WHERE edge_type = 'defined_in' AND (src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes))""",
        "metadata_index": doc + "SELECT DISTINCT json_extract_string(metadata_json, '$.source') AS value, id FROM blocks",
        "metadata_values": ev + "SELECT DISTINCT json_extract_string(metadata_json, '$.k') AS value FROM blocks",
        "index_stats": doc + """SELECT count(*) AS unique_values, sum(n)::BIGINT AS total_blocks, max(n) AS max_per_value, count(*)::DOUBLE / sum(n) AS selectivity,
  count(*)::DOUBLE / sum(n) < 0.5 AND max(n) < sum(n) // 2 AS is_selective FROM (SELECT json_extract_string(metadata_json, '$.source') AS v, count(DISTINCT id) AS n FROM blocks GROUP BY 1)""",
        "degree": _with("trade") + "SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY id",
        "workspace_stats": _with("trade", "units") + """SELECT ws AS codebase, count(*) AS block_count, coalesce(sum(e), 0)::BIGINT AS edge_count, (count(*) * 2048 + coalesce(sum(e), 0) * 64)::BIGINT AS estimated_bytes
FROM (SELECT id, json_extract_string(metadata_json, '$.codebase') AS ws FROM blocks) LEFT JOIN (SELECT src AS id, count(*) AS e FROM edges GROUP BY 1) USING (id) WHERE ws IS NOT NULL GROUP BY ws""",
        "storage_stats": _V + "SELECT (SELECT count(*) FROM b) AS versions, (SELECT count(*) FROM live) AS live_blocks, (SELECT count(*) FROM ue) AS edges, (SELECT sum(strlen(content))::BIGINT FROM live) AS content_bytes",
        "memory_pressure": _with("trade", "units") + """SELECT ws AS codebase, CASE WHEN x >= 0.8 THEN 'high' WHEN x >= 0.5 THEN 'medium' ELSE 'low' END AS pressure
FROM (SELECT ws, (count(*) * 2048 + coalesce(sum(e), 0) * 64)::DOUBLE / 819200 AS x FROM (SELECT id, json_extract_string(metadata_json, '$.codebase') AS ws FROM blocks) LEFT JOIN (SELECT src AS id, count(*) AS e FROM edges GROUP BY 1) USING (id) WHERE ws IS NOT NULL GROUP BY ws)""",
        "latency_stats": """SELECT event_type, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type""",
        "formats": f"""SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', round(b / 1024.0::DOUBLE, 1)) WHEN b < 1073741824 THEN printf('%.1f MB', round(b / 1048576.0::DOUBLE, 1)) ELSE printf('%.1f GB', round(b / 1073741824.0::DOUBLE, 1)) END AS bytes,
  CASE WHEN s < 0 THEN 'in future' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN {_parts('s', 3600, 'h', 60, 'm')} || ' ago' ELSE (s // 86400) || 'd ago' END AS ago,
  CASE WHEN u < 60 THEN u || 's' WHEN u < 3600 THEN {_parts('u', 60, 'm', 1, 's')} WHEN u < 86400 THEN {_parts('u', 3600, 'h', 60, 'm')} ELSE {_parts('u', 86400, 'd', 3600, 'h')} END AS uptime
FROM (SELECT doc_id, n_chars * n_chars AS b, n_chars * n_chars - 3600 AS s, n_chars * n_chars AS u FROM documents)""",
    }
    return out | _ingestion()
