"""Graphs over the relational test tables. The SQL runs alike in Spark and in the oracle's engine; the two large graphs have plans of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.session import table

GRAPHS = {
    "trade": """
SELECT concat('nation:', n_nationkey) AS src, concat('region:', n_regionkey) AS dst, 'defined_in' AS edge_type FROM {nation}
UNION SELECT concat('customer:', c_custkey), concat('nation:', c_nationkey), 'defined_in' FROM {customer}
UNION SELECT concat('supplier:', s_suppkey), concat('nation:', s_nationkey), 'defined_in' FROM {supplier}
UNION SELECT concat('order:', o_orderkey), concat('customer:', o_custkey), 'references' FROM {orders}
UNION SELECT concat('order:', l_orderkey), concat('part:', l_partkey), 'contains' FROM {lineitem}
UNION SELECT concat('order:', l_orderkey), concat('supplier:', l_suppkey), 'depends_on' FROM {lineitem}""",
    "event_flow": """
SELECT src, dst, 'calls' AS edge_type FROM (
  SELECT concat('event:', event_id) AS src, concat('event:', lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS dst,
    lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {events}) AS e WHERE nxt IS NOT NULL""",
    "event_types": """
SELECT DISTINCT event_type AS src, nxt AS dst, 'calls' AS edge_type FROM (
  SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {events}) AS e WHERE nxt IS NOT NULL AND nxt <> event_type""",
    "parts": """
SELECT DISTINCT concat('part:', l_partkey) AS src, concat('part:', nxt) AS dst, 'references' AS edge_type FROM (
  SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nxt FROM {lineitem}) AS l WHERE nxt IS NOT NULL AND nxt <> l_partkey""",
    # Each conversation's turns in a ring, and the first eight conversations in a tree: many strong components.
    "rings": """
SELECT concat('turn:', a.conv_id, ':', a.turn) AS src, concat('turn:', a.conv_id, ':', a.turn + 1) AS dst, 'calls' AS edge_type
FROM {conversations} AS a JOIN {conversations} AS b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
UNION SELECT concat('turn:', conv_id, ':', max(turn)), concat('turn:', conv_id, ':', min(turn)), 'calls' FROM {conversations} GROUP BY conv_id
UNION SELECT concat('turn:', conv_id, ':', min(turn)), concat('turn:', CAST(floor(conv_id / 2) AS BIGINT), ':', min(turn)), 'references' FROM {conversations} WHERE conv_id BETWEEN 1 AND 7 GROUP BY conv_id""",
    "turns": """
SELECT concat('turn:', a.conv_id, ':', a.turn) AS src, concat('turn:', a.conv_id, ':', a.turn + 1) AS dst, 'calls' AS edge_type
FROM {conversations} AS a JOIN {conversations} AS b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
}

BLOCKS = {
    # Code-like units with names, types and workspaces.
    "units": """
SELECT concat('region:', r_regionkey) AS id, CAST(r_regionkey + 1 AS BIGINT) AS sequence, concat('geo://', r_name) AS source_uri,
  concat('{{"unit_type": "const", "unit_id": "src/geo.zig:', r_name, '", "codebase": "', r_name, '"}}') AS metadata_json, r_name AS content FROM {region}
UNION ALL SELECT concat('nation:', n_nationkey), CAST(n_nationkey + 1 AS BIGINT), concat('geo://', r_name, '/', n_name),
  concat('{{"unit_type": "type", "unit_id": "src/geo.zig:', n_name, '", "codebase": "', r_name, '", "file_path": "src/geo.zig"}}'), n_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT concat('customer:', c_custkey), CAST(c_custkey + 1 AS BIGINT), concat('crm://', c_mktsegment, '/', c_custkey),
  concat('{{"unit_type": "function", "unit_id": "src/crm.zig:', n_name, ':', c_name, '", "codebase": "', r_name, '", "segment": "', c_mktsegment, '", "balance": ', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR(20)), '}}'), concat(c_name, ' ', c_mktsegment)
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT concat('supplier:', s_suppkey), CAST(s_suppkey + 1 AS BIGINT), concat('crm://supplier/', s_suppkey),
  concat('{{"unit_type": "var", "unit_id": "src/supply.zig:', s_name, '", "codebase": "', r_name, '"}}'), s_name
  FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT concat('part:', p_partkey), CAST(p_partkey + 1 AS BIGINT), concat('part://', p_brand, '/', p_partkey), concat('{{"unit_type": "test", "size": ', CAST(p_size AS VARCHAR(20)), '}}'), p_name FROM {part}
UNION ALL SELECT concat('order:', o_orderkey), CAST(o_orderkey + 1 AS BIGINT), concat('order://', o_orderpriority), concat('{{"unit_type": "import", "status": "', o_orderstatus, '"}}'), o_orderpriority FROM {orders}""",
    "documents": """
SELECT concat('doc:', doc_id) AS id, doc_id + 1 AS sequence, concat('doc://', source, '/', doc_id) AS source_uri,
  concat('{{"lang": "', lang, '", "source": "', source, '", "n_chars": ', CAST(n_chars AS VARCHAR(20)), ', "codebase": "', lang, '"}}') AS metadata_json, text AS content FROM {documents}""",
    "events": """
SELECT concat('event:', event_id) AS id, event_id + 1 AS sequence, concat('event://', event_type, '/', event_id) AS source_uri, props AS metadata_json, event_type AS content FROM {events}""",
    # A change log by user: every event is a version, an error is a deletion.
    "versions": """
SELECT concat('user:', user_id) AS id, event_id + 1 AS sequence, concat('event://', event_type) AS source_uri, props AS metadata_json, event_type AS content FROM {events} WHERE event_type <> 'error'""",
    "turns": """
SELECT concat('turn:', conv_id, ':', turn) AS id, turn + 1 AS sequence, concat('chat://', conv_id) AS source_uri, concat('{{"role": "', role, '", "codebase": "', role, '"}}') AS metadata_json, text AS content FROM {conversations}""",
}

TOMBSTONES = "SELECT concat('user:', user_id) AS id, event_id + 1 AS sequence, (event_id + 1) * 1000000 AS deletion_ts_us FROM {events} WHERE event_type = 'error'"

#: Source files (path, content) that say in code what the tables say: customers call their nation, nations their region.
FILES = """
SELECT concat('src/customer/', c_custkey, '.zig') AS path,
  concat('pub fn customer_', c_custkey, '() void {{', chr(10), '    nation_', c_nationkey, '();', chr(10), '    ledger.post("{{", ', c_custkey, ');', chr(10), '}}', chr(10)) AS content FROM {customer}
UNION ALL SELECT concat('src/nation/', n_nationkey, '.zig'),
  concat('const region = @import("region.zig");', chr(10), 'pub fn nation_', n_nationkey, '() void {{', chr(10), '    region.region_', n_regionkey, '();', chr(10), '}}', chr(10)) FROM {nation}
UNION ALL SELECT concat('src/region/', r_regionkey, '.zig'),
  concat('pub const Region = struct {{', chr(10), '    pub fn name() void {{}}', chr(10), '}};', chr(10), 'pub fn region_', r_regionkey, '() void {{', chr(10), '    // ', r_name, chr(10), '}}', chr(10)) FROM {region}"""

TEXTS = "SELECT concat('docs/', doc_id, CASE WHEN lang = 'en' THEN '.md' ELSE '.txt' END) AS path, text AS content FROM {documents}"

#: The same change log as VERSIONS and TOMBSTONES, and edges between users who act one after another, as rows of one log.
LOG = """
SELECT 'put' AS kind, concat('user:', user_id) AS id, event_id + 1 AS sequence, concat('event://', event_type) AS source_uri, props AS metadata_json, event_type AS content,
  CAST(NULL AS BIGINT) AS deletion_ts_us, CAST(NULL AS VARCHAR(10)) AS dst, CAST(NULL AS VARCHAR(10)) AS edge_type FROM {events} WHERE event_type <> 'error'
UNION ALL SELECT 'delete', concat('user:', user_id), event_id + 1, NULL, NULL, NULL, (event_id + 1) * 1000000, NULL, NULL FROM {events} WHERE event_type = 'error'
UNION ALL SELECT 'edge', concat('user:', user_id), NULL, NULL, NULL, NULL, NULL, concat('user:', nxt), 'calls' FROM (
  SELECT user_id, lead(user_id) OVER (PARTITION BY event_type, floor(event_id / 512) ORDER BY ts, event_id) AS nxt FROM {events}) AS e WHERE nxt IS NOT NULL"""

#: Blocks of which many break a write rule.
FAULTY = """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('event:', event_id) END AS id, event_id % 5 AS sequence, CASE WHEN event_type = 'view' THEN '' ELSE 'u' END AS source_uri,
  CASE WHEN event_id % 3 = 0 THEN '{{bad' ELSE props END AS metadata_json, CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS content FROM {events}"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


#: The parts of the trade graph, none of which overlap: table, prefix and key of either end, edge type.
TRADE = (
    ("nation", "nation:", "n_nationkey", "region:", "n_regionkey", "defined_in"),
    ("customer", "customer:", "c_custkey", "nation:", "c_nationkey", "defined_in"),
    ("supplier", "supplier:", "s_suppkey", "nation:", "s_nationkey", "defined_in"),
    ("orders", "order:", "o_orderkey", "customer:", "o_custkey", "references"),
    ("lineitem", "order:", "l_orderkey", "part:", "l_partkey", "contains"),
    ("lineitem", "order:", "l_orderkey", "supplier:", "l_suppkey", "depends_on"),
)
#: Rows that one task holds while it makes rows distinct or orders them.
TASK_ROWS = 500_000


def _dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by its keys over tasks of about TASK_ROWS rows, however many rows there are; a given number is not coalesced."""
    return df.repartition(max(-(-rows // TASK_ROWS), min(-(-rows // 10_000), df.sparkSession.sparkContext.defaultParallelism), 1), *keys)


def _named(pairs: DataFrame, src: str, dst: str, kind: str) -> DataFrame:
    return pairs.select(F.concat(F.lit(src), "a").alias("src"), F.concat(F.lit(dst), "b").alias("dst"), F.lit(kind).alias("edge_type"))


def _trade(spark: SparkSession, sf_dir: str, repeats: bool) -> DataFrame:
    """Dealt by their source, so that what is counted by source after meets in one task; sources have few edges."""
    out = None
    for name, src, a, dst, b, kind in TRADE:
        pairs = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(a).alias("a"), F.col(b).alias("b"))
        part = _named(pairs if repeats else _dealt(pairs, pairs.count(), "a").distinct(), src, dst, kind)
        out = part if out is None else out.unionByName(part)
    return out


def _parts(spark: SparkSession, sf_dir: str, repeats: bool) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    rows = lines.count()
    follows = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    pairs = _dealt(lines, rows, "l_orderkey").select(F.col("l_partkey").alias("a"), follows.alias("b")).filter("b IS NOT NULL AND a <> b")
    return _named(pairs if repeats else _dealt(pairs, rows, "a", "b").distinct(), "part:", "part:", "references")


#: GRAPHS of many rows, with the same edges: keys are made distinct as numbers and named after, and tasks are of bounded size.
PLANS = {"trade": _trade, "parts": _parts}


def view(spark: SparkSession, sf_dir: str, graph: str, repeats: bool = False) -> DataFrame:
    """The edge set of a graph, not written: for a query that reads it once, or that takes repeated edges, which need no shuffle."""
    return PLANS[graph](spark, sf_dir, repeats) if graph in PLANS else _run(spark, sf_dir, GRAPHS[graph])


def edges(spark: SparkSession, sf_dir: str, graph: str) -> DataFrame:
    """The edge set of a graph, written once: traversals read it many times."""
    return table(view(spark, sf_dir, graph), "edges")


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Any of the other views."""
    return _run(spark, sf_dir, sql)


def blocks(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _run(spark, sf_dir, BLOCKS[kind])


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, TOMBSTONES)


def oracle(sql: str) -> str:
    """The same view as text for the oracle."""
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return sql.replace("{{", "{").replace("}}", "}")
