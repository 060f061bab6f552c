"""Derived views over the base tables.

The SQL text of each view runs unchanged in Spark and in the checking engine.
``{name}`` stands for a base table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from stmtwarden.shape_columns import ROWS as SHAPE_COLUMNS
from stmtwarden.shapes import SHAPE_COUNT, SHAPE_VALUES

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["statement_log"] = """
SELECT event_id AS id, ts, CONCAT('p', user_id % 3) AS project_id, CONCAT('i', user_id % 7) AS instance_id,
  CONCAT('db', user_id % 5) AS schema_name, CONCAT('u', user_id % 20) AS db_user,
  CONCAT('10.0.', user_id % 4, '.', user_id % 250) AS endpoint, value AS query_time, event_id % 1000 AS rows_examined,
  CASE event_type
    WHEN 'click' THEN CONCAT('SELECT * FROM orders WHERE o_custkey = ', user_id)
    WHEN 'view' THEN CONCAT('select o_orderkey from orders where o_orderpriority like ''%', event_id % 10, ''' order by rand()')
    WHEN 'purchase' THEN CONCAT('UPDATE customer SET c_acctbal = ', event_id % 500, ' WHERE c_custkey = ', user_id)
    WHEN 'signup' THEN CONCAT('INSERT INTO customer VALUES (', event_id, ', ''name', user_id, ''')')
    ELSE 'DELETE FROM lineitem' END AS sql_text
FROM {events}
"""

# Many statement shapes, so that every text rule meets statements that break it.
VIEWS["statement_corpus"] = f"""
SELECT o.o_orderkey AS id, o.o_custkey AS task_id, s.k AS shape_id,
  REPLACE(s.shape, '#', CONCAT('', o.o_orderkey)) AS sql_text
FROM {{orders}} o JOIN (VALUES {SHAPE_VALUES}) AS s(k, shape) ON o.o_orderkey % {SHAPE_COUNT} = s.k
"""

VIEWS["task_sql"] = """
SELECT o_orderkey AS id, o_custkey AS task_id, CONCAT('f', o_orderkey % 3, '.sql') AS source_file,
  CASE SUBSTRING(o_orderpriority, 1, 1) WHEN '1' THEN 'error' WHEN '2' THEN 'warn' WHEN '3' THEN 'notice' ELSE 'normal' END AS audit_level,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'initialized' END AS exec_status,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE MD5(CONCAT(o_orderpriority, o_orderstatus)) END AS audit_fingerprint
FROM {orders}
"""

# One row per result of a statement; a statement may have none.
VIEWS["task_results"] = """
SELECT id AS sql_id, task_id, audit_level AS level, CONCAT('rule_', id % 9) AS rule_name,
  CONCAT('message ', id % 9) AS message, id % 11 = 0 AS execution_failed FROM {task_sql} WHERE id % 6 <> 0
UNION ALL
SELECT id AS sql_id, task_id, 'notice' AS level, 'rule_extra' AS rule_name, 'second message' AS message,
  id % 13 = 0 AS execution_failed FROM {task_sql} WHERE id % 4 = 0
"""

VIEWS["audit_files"] = """
SELECT DISTINCT o_custkey * 3 + o_orderkey % 3 AS id, o_custkey AS task_id, CONCAT('f', o_orderkey % 3, '.sql') AS file_name,
  o_orderkey % 3 AS exec_order, TIMESTAMP '2024-01-01 00:00:00' AS created_at
FROM {orders}
"""

VIEWS["tasks"] = """
SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS instance_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'exec_failed' WHEN 'MACHINERY' THEN 'audited' ELSE 'exec_succeeded' END AS status,
  TIMESTAMP '2024-01-01 00:00:00' AS exec_start_at, c_custkey * 7 % 600 AS exec_seconds
FROM {customer}
"""

VIEWS["workflows"] = """
SELECT o_orderkey AS id, o_custkey AS task_id, CONCAT('p', o_custkey % 10) AS project_id, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderpriority = '1-URGENT' THEN 'exec_failed'
    WHEN o_orderpriority = '2-HIGH' THEN 'rejected' WHEN o_orderpriority = '3-MEDIUM' THEN 'wait_for_audit'
    WHEN o_orderpriority = '5-LOW' THEN 'canceled' ELSE 'executing' END AS status,
  CONCAT('subject ', o_orderkey % 97) AS subject, CONCAT('u', o_custkey % 40) AS creator, CONCAT('u', o_orderkey % 40) AS assignee
FROM {orders}
"""

# Instances a workflow runs on; the pair may repeat.
VIEWS["workflow_instances"] = """
SELECT l_orderkey AS workflow_id, l_suppkey AS instance_id, l_partkey AS task_id, l_linenumber % 2 = 0 AS is_executed,
  l_shipdate AS scheduled_at, CONCAT('v', l_linenumber) AS version, CONCAT('u', l_suppkey % 40) AS execution_assignee
FROM {lineitem}
"""

# Steps: each order is a step of its customer's workflow.
VIEWS["workflow_steps"] = """
SELECT o_orderkey AS id, o_custkey AS workflow_id, o_orderdate AS operate_at,
  CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'initialized' ELSE 'rejected' END AS state,
  CASE WHEN o_orderkey % 3 = 0 THEN 'sql_execute' ELSE 'sql_review' END AS step_type, CONCAT('u', o_orderkey % 40) AS assignee
FROM {orders}
"""

VIEWS["step_workflows"] = """
SELECT c_custkey AS id, c_name AS subject, TIMESTAMP '1994-03-01 10:20:30' AS created_at,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey END AS current_step_id,
  CASE WHEN c_custkey % 4 = 0 THEN 'rejected' ELSE 'wait_for_execution' END AS status, CONCAT('u', c_custkey % 40) AS creator
FROM {customer}
"""

VIEWS["reports"] = """
SELECT event_id AS id, user_id AS scan_plan_id, CONCAT('i', user_id % 7) AS instance_name,
  CASE WHEN user_id % 2 = 0 THEN 'mysql' ELSE 'oracle' END AS db_type, CONCAT('p', user_id % 10) AS project_id,
  ts AS created_at, event_id * 37 % 101 AS score
FROM {events}
"""

# Statements of reports: the orders table keyed back to reports by number.
VIEWS["report_sql"] = """
SELECT o_orderkey AS id, o_custkey * 5 AS report_id, CONCAT('SELECT ', o_orderkey) AS sql_text,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CONCAT('rule_', o_orderkey % 9) END AS audit_result
FROM {orders}
"""

VIEWS["audit_records"] = """
SELECT o_orderkey AS id, CONCAT('r', o_orderkey) AS audit_record_id, o_orderdate AS created_at, CONCAT('u', o_custkey % 40) AS creator,
  CONCAT('tag', o_orderkey % 12, ',team', o_custkey % 5) AS tags, o_custkey AS task_id, CONCAT('p', o_custkey % 10) AS project_id
FROM {orders}
"""

VIEWS["scan_plans"] = """
SELECT c_custkey AS id, CONCAT('p', c_custkey % 10) AS project_id, CONCAT('i', c_nationkey) AS instance_id, CONCAT('plan ', c_custkey) AS name,
  CASE WHEN c_custkey % 3 = 0 THEN 'oracle' ELSE 'mysql' END AS db_type,
  CASE WHEN c_acctbal < 1000 THEN 'disabled' ELSE 'normal' END AS active_status, c_custkey % 40 AS create_user_id,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'abnormal' ELSE 'normal' END AS last_collection_status,
  DATE '2024-01-01' + CAST(c_custkey % 90 AS INT) AS updated_on, c_custkey % 17 = 0 AS is_deleted
FROM {customer}
"""

VIEWS["plan_types"] = """
SELECT o_orderkey AS id, o_custkey AS plan_id, o_orderkey % 23 = 0 AS is_deleted,
  CASE SUBSTRING(o_orderpriority, 1, 1) WHEN '1' THEN 'slow_log' WHEN '2' THEN 'top_sql' WHEN '3' THEN 'processlist'
    WHEN '4' THEN 'schema_meta' ELSE 'audit_log' END AS plan_type
FROM {orders}
"""

# Governed records with their state.
VIEWS["sql_records"] = """
SELECT o_orderkey AS id, MD5(CONCAT('s', o_orderkey)) AS sql_id,
  CASE SUBSTRING(o_orderpriority, 1, 1) WHEN '1' THEN 'slow_log' WHEN '2' THEN 'top_sql' WHEN '3' THEN 'processlist'
    WHEN '4' THEN 'schema_meta' ELSE 'audit_log' END AS source,
  o_custkey AS source_id, CONCAT('p', o_custkey % 10) AS project_id, CONCAT('i', o_custkey % 25) AS instance_id,
  CONCAT('db', o_custkey % 5) AS schema_name, CONCAT('SELECT * FROM t', o_orderkey % 300, ' WHERE a = ?') AS sql_fingerprint,
  CONCAT('SELECT * FROM t', o_orderkey % 300, ' WHERE a = ', o_orderkey) AS sql_text,
  o_orderkey * 31 % 5000 AS counter, o_orderkey * 17 % 997 AS query_time_avg, o_orderkey * 13 % 100003 AS row_examined_avg,
  CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE CONCAT('u', o_custkey % 20) END AS db_user,
  CONCAT('m', o_custkey % 30) AS schema_meta_name, CONCAT('10.0.', o_custkey % 4, '.', o_orderkey % 250) AS endpoint,
  CASE o_orderkey % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' WHEN 2 THEN 'notice' ELSE 'normal' END AS audit_level,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CONCAT('rule_', o_orderkey % 9) END AS rule_a,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CONCAT('rule_', o_orderkey % 7) END AS rule_b,
  CASE WHEN o_orderkey % 5 = 0 THEN 'high' ELSE NULL END AS priority,
  CASE o_orderkey % 8 WHEN 0 THEN 'solved' WHEN 1 THEN 'ignored' ELSE 'unhandled' END AS status,
  CONCAT('u', o_orderkey % 40) AS assignee, o_orderdate AS last_receive_timestamp, o_orderdate AS first_appeared_at,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN TIMESTAMP '1995-06-01 00:00:00' ELSE TIMESTAMP '1999-01-01 00:00:00' END AS last_audit_time,
  o_orderdate AS updated_at, o_orderkey % 29 = 0 AS is_deleted
FROM {orders}
"""

VIEWS["rules"] = """
SELECT CONCAT('rule_', n_nationkey % 11) AS rule_name, CASE WHEN n_nationkey >= 11 THEN 'oracle' ELSE 'mysql' END AS db_type,
  n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'notice' END AS level, 'built-in' AS kind
FROM {nation} WHERE n_nationkey < 22
"""

VIEWS["rule_tags"] = """
SELECT DISTINCT CONCAT('rule_', p_partkey % 11) AS rule_name, CASE WHEN p_size % 2 = 0 THEN 'mysql' ELSE 'oracle' END AS db_type,
  CONCAT('tag', p_size % 6) AS tag
FROM {part} WHERE p_size % 6 <> 5
"""

VIEWS["rule_categories"] = """
SELECT n_nationkey AS id, CONCAT('category', n_regionkey) AS category, CONCAT('tag', n_nationkey % 10) AS tag FROM {nation} WHERE n_nationkey < 10
"""

VIEWS["custom_rules"] = """
SELECT p_partkey AS id, p_type AS rule_type, DATE '2024-01-01' + CAST(p_partkey % 300 AS INT) AS created_on, p_name AS name FROM {part}
"""

VIEWS["catalog_columns"] = """
SELECT CONCAT('t', p_partkey % 200) AS table_name, CONCAT('c', CAST(FLOOR(p_partkey / 200) AS BIGINT)) AS column_name, p_type AS data_type,
  p_size AS column_width, p_partkey < 150 AS is_primary_key, p_size % 3 = 0 AS is_nullable,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END AS column_comment
FROM {part}
"""

# Full catalogue: the columns above with every attribute the lint job reads.
VIEWS["schema_columns"] = """
SELECT CONCAT(CASE WHEN p_partkey % 200 % 19 = 0 THEN 'Tab' ELSE 't' END, p_partkey % 200) AS table_name,
  CASE p_size WHEN 1 THEN 'CREATE_TIME' WHEN 2 THEN 'UPDATE_TIME' WHEN 3 THEN 'select' WHEN 4 THEN 'CamelCase' WHEN 5 THEN '1st-col'
    ELSE CONCAT('c', CAST(FLOOR(p_partkey / 200) AS BIGINT)) END AS column_name,
  CAST(FLOOR(p_partkey / 200) AS BIGINT) AS ordinal,
  CASE p_size % 14 WHEN 0 THEN 'bigint' WHEN 1 THEN 'timestamp' WHEN 2 THEN 'datetime' WHEN 3 THEN 'varchar' WHEN 4 THEN 'char'
    WHEN 5 THEN 'text' WHEN 6 THEN 'blob' WHEN 7 THEN 'float' WHEN 8 THEN 'decimal' WHEN 9 THEN 'enum' WHEN 10 THEN 'set'
    WHEN 11 THEN 'geometry' WHEN 12 THEN 'int' ELSE 'double' END AS data_type,
  p_size * 30 AS column_width, p_size % 4 = 1 AS is_unsigned, p_partkey < 150 AS is_primary_key, p_size % 3 = 0 AS is_nullable,
  p_partkey < 60 OR p_size = 40 AS is_auto_increment,
  CASE WHEN p_size % 5 = 0 THEN 'CURRENT_TIMESTAMP' WHEN p_size % 5 = 1 THEN '0' ELSE NULL END AS default_value,
  CASE WHEN p_size % 10 = 0 THEN 'on update CURRENT_TIMESTAMP' ELSE '' END AS extra,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END AS column_comment,
  CASE WHEN p_size % 7 = 0 THEN 'latin1' WHEN p_size % 14 IN (3, 4, 5) THEN 'utf8mb4' ELSE NULL END AS charset,
  CASE WHEN p_size % 7 = 0 THEN 'latin1_swedish_ci' WHEN p_size % 14 IN (3, 4, 5) THEN 'utf8mb4_0900_ai_ci' ELSE NULL END AS collation_name
FROM {part}
"""

VIEWS["schema_tables"] = """
SELECT CONCAT(CASE WHEN n % 19 = 0 THEN 'Tab' ELSE 't' END, n) AS table_name, CASE WHEN n % 3 = 0 THEN 'shop_DB' ELSE 'shop' END AS schema_name,
  CASE WHEN n % 8 = 0 THEN 'MyISAM' ELSE 'InnoDB' END AS engine, CASE WHEN n % 9 = 0 THEN 'latin1' ELSE 'utf8mb4' END AS charset,
  CASE WHEN n % 9 = 0 THEN 'latin1_swedish_ci' ELSE 'utf8mb4_0900_ai_ci' END AS collation_name,
  CASE WHEN n % 5 = 0 THEN '' ELSE 'described' END AS table_comment, n % 13 = 0 AS is_partitioned, n % 12 AS auto_increment_start,
  n * 97777 AS table_rows, n * 23 AS size_mb, n % 15 = 0 AS has_foreign_key
FROM (SELECT DISTINCT p_partkey % 200 AS n FROM {part}) AS x
"""

VIEWS["catalog_indexes"] = """
SELECT DISTINCT CONCAT('t', l_suppkey) AS table_name, CONCAT('idx_', l_orderkey % 5) AS index_name,
  l_linenumber AS seq, CONCAT('c', (l_orderkey % 5 + l_linenumber) % 8) AS column_name
FROM {lineitem} WHERE l_linenumber <= 1 + l_orderkey % 5
"""

# The same indexes with attributes and some extra ones that repeat or are prefixes.
VIEWS["schema_indexes"] = """
SELECT table_name, index_name, CAST(seq AS BIGINT) AS seq, column_name, index_name = 'idx_4' AS is_unique,
  CASE WHEN index_name = 'idx_3' THEN 'FULLTEXT' WHEN index_name = 'idx_2' THEN 'SPATIAL' ELSE 'BTREE' END AS index_type, 'INDEX' AS constraint_type,
  (seq * 37 + LENGTH(table_name) * 11) % 90 AS cardinality
FROM {catalog_indexes}
UNION ALL
SELECT table_name, 'copy_of_1' AS index_name, CAST(seq AS BIGINT) AS seq, column_name, FALSE AS is_unique, 'BTREE' AS index_type,
  'INDEX' AS constraint_type, 50 AS cardinality
FROM {catalog_indexes} WHERE index_name = 'idx_1'
UNION ALL
SELECT table_name, 'PRIMARY' AS index_name, CAST(seq AS BIGINT) AS seq, column_name, TRUE AS is_unique, 'BTREE' AS index_type,
  'PRIMARY KEY' AS constraint_type, 100 AS cardinality
FROM {catalog_indexes} WHERE index_name = 'idx_2'
"""

VIEWS["plan_rows"] = """
SELECT l_orderkey AS sql_id, l_linenumber AS select_id, CONCAT('t', l_suppkey) AS table_name,
  CASE l_returnflag WHEN 'A' THEN 'ALL' WHEN 'N' THEN 'index' ELSE 'ref' END AS access_type,
  CASE WHEN l_returnflag = 'A' THEN '' ELSE 'idx_1' END AS key_used, l_partkey * 13 AS rows_est,
  CASE WHEN l_linestatus = 'F' THEN 'Using where; Using filesort' ELSE 'Using temporary' END AS extra
FROM {lineitem}
"""

VIEWS["lock_waits"] = """
SELECT event_id AS id, user_id AS granted_trx, (user_id * 7 + 3) % 150 AS waiting_trx, ts AS wait_started,
  CASE WHEN event_id % 2 = 0 THEN 'TABLE' ELSE 'RECORD' END AS lock_type, CONCAT('t', user_id % 8) AS object_name,
  CONCAT('db', user_id % 3) AS database_name, user_id % 6 AS scan_plan_id
FROM {events} WHERE event_type = 'error'
"""

VIEWS["metric_records"] = """
SELECT CONCAT('s', user_id) AS sql_id, ts AS record_begin_at, ts AS record_end_at,
  CASE WHEN event_type = 'click' THEN 'explain_cost' ELSE 'query_time_avg' END AS metric_name, CAST(value AS DECIMAL(20,4)) AS metric_value,
  event_id AS record_id
FROM {events}
"""

# Oracle-style statement statistics and sessions.
VIEWS["statement_stats"] = """
SELECT o_orderkey AS sql_id, o_orderkey % 3 AS child_number, CONCAT('SELECT ', o_orderkey) AS sql_text, o_custkey AS user_id,
  o_orderkey % 40 AS executions, o_orderkey * 7919 % 1000003 AS elapsed_time, o_orderkey * 104729 % 1000033 AS cpu_time,
  o_orderkey * 1299709 % 1000037 AS disk_reads, o_orderkey * 15485863 % 1000039 AS buffer_gets, o_orderdate AS last_active_time
FROM {orders}
"""

VIEWS["db_users"] = """
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 13 = 0 THEN 'SYS' WHEN c_custkey % 13 = 1 THEN 'SYSTEM' ELSE c_name END AS username
FROM {customer}
"""

VIEWS["sessions"] = """
SELECT event_id AS sid, user_id * 20 AS sql_id, user_id * 20 % 3 AS child_number,
  CASE WHEN event_type = 'error' THEN 'BACKGROUND' ELSE 'USER' END AS session_type,
  CASE WHEN event_id % 2 = 0 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status, CONCAT('u', user_id % 20) AS username,
  event_id % 400 AS seconds_in_call, CASE WHEN event_id % 9 = 0 THEN 'information_schema' ELSE CONCAT('db', user_id % 5) END AS schema_name,
  CASE WHEN event_id % 10 = 0 THEN '' ELSE CONCAT('SELECT ', user_id) END AS sql_text
FROM {events}
"""

# A script of several statements per order, with comments and line breaks.
VIEWS["sql_scripts"] = """
SELECT CONCAT('/scripts/', o_orderkey, '.sql') AS path,
  CONCAT('-- file ', o_orderkey, '; header', CHR(10), 'SELECT * FROM orders WHERE o_orderkey = ', o_orderkey, ';', CHR(10), CHR(10),
    'UPDATE customer SET c_name = ''a;b''', CHR(10), 'WHERE c_custkey = ', o_custkey, ';  ', CHR(10), '/* tail */ DELETE FROM part; ', CHR(10)) AS content
FROM {orders}
"""

VIEWS["mapper_files"] = """
SELECT CONCAT('/mappers/', o_orderkey, '.xml') AS path,
  CONCAT('<mapper namespace="m', o_orderkey, '">', CHR(10), '<select id="q1" resultType="x">SELECT * FROM orders WHERE o_orderkey = ', o_orderkey,
    '</select>', CHR(10), '<update id="q2">UPDATE customer SET c_name = ''a'' WHERE c_custkey &lt; ', o_custkey, '</update>', CHR(10), '</mapper>') AS content
FROM {orders}
"""


def _values(rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


# Columns of the statements in ``statement_corpus``.
VIEWS["statement_columns"] = f"""
SELECT o.o_orderkey AS id, v.table_name, v.column_name, v.clause, v.position, v.operator, v.func AS function, v.literal_kind, v.other_table, v.other_column, v.with_or
FROM {{orders}} o JOIN {_values(SHAPE_COLUMNS)}
  AS v(k, table_name, column_name, clause, position, operator, func, literal_kind, other_table, other_column, with_or) ON o.o_orderkey % {SHAPE_COUNT} = v.k
"""

# Catalogue of the tables those statements name.
VIEWS["corpus_columns"] = "SELECT * FROM " + _values([
    ("customer", "c_custkey", "bigint", 20, True, True, None, None),
    ("customer", "c_name", "varchar", 2500, False, False, "utf8mb4", "utf8mb4_0900_ai_ci"),
    ("customer", "c_nationkey", "int", 10, False, False, None, None),
    ("customer", "c_acctbal", "decimal", 12, False, False, None, None),
    ("orders", "o_orderkey", "bigint", 20, True, False, None, None),
    ("orders", "o_custkey", "varchar", 20, False, False, "latin1", "latin1_swedish_ci"),
    ("orders", "o_orderpriority", "varchar", 15, False, False, "latin1", "latin1_swedish_ci"),
    ("orders", "o_totalprice", "decimal", 12, False, False, None, None),
    ("orders", "o_comment", "text", 3000, False, False, "utf8mb4", "utf8mb4_0900_ai_ci"),
    ("lineitem", "l_orderkey", "bigint", 20, False, False, None, None),
    ("lineitem", "l_partkey", "int", 10, False, False, None, None),
    ("part", "p_partkey", "int", 10, True, False, None, None),
    ("part", "p_name", "varchar", 55, False, False, "utf8mb4", "utf8mb4_0900_ai_ci"),
    ("t", "a", "int", 10, False, False, None, None),
    ("t", "b", "int", 10, False, False, None, None),
    ("t", "c", "json", 0, False, False, None, None),
]) + " AS v(table_name, column_name, data_type, column_width, is_primary_key, is_auto_increment, charset, collation_name)"

VIEWS["corpus_indexes"] = "SELECT * FROM " + _values([
    ("customer", "PRIMARY", 1, "c_custkey", True),
    ("customer", "idx_bal_name", 1, "c_acctbal", False),
    ("customer", "idx_bal_name", 2, "c_name", False),
    ("orders", "PRIMARY", 1, "o_orderkey", True),
    ("orders", "idx_cust_price", 1, "o_custkey", False),
    ("orders", "idx_cust_price", 2, "o_totalprice", False),
    ("part", "PRIMARY", 1, "p_partkey", True),
    ("t", "idx_b", 1, "b", False),
    ("t", "idx_b", 2, "a", False),
]) + " AS v(table_name, index_name, seq, column_name, is_unique)"

VIEWS["corpus_selectivity"] = "SELECT table_name, column_name, CAST(selectivity AS DOUBLE) AS selectivity FROM " + _values([
    ("customer", "c_custkey", 100.0), ("customer", "c_name", 60.0), ("customer", "c_nationkey", 1.5), ("customer", "c_acctbal", 40.0),
    ("orders", "o_orderkey", 100.0), ("orders", "o_custkey", 30.0), ("orders", "o_orderpriority", 5.0), ("orders", "o_totalprice", 90.0),
    ("orders", "o_comment", 95.0), ("lineitem", "l_orderkey", 25.0), ("lineitem", "l_partkey", 20.0), ("part", "p_partkey", 100.0),
    ("part", "p_name", 80.0), ("t", "a", 50.0), ("t", "b", 70.0), ("t", "c", 90.0),
]) + " AS v(table_name, column_name, selectivity)"

# Every statement but each seventh scans.
VIEWS["corpus_plans"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'ref' WHEN o_orderkey % 7 = 1 THEN 'index' ELSE 'ALL' END AS access_type FROM {orders}
"""


_REF = re.compile(r"\{(\w+)\}")


def references(text: str) -> list[str]:
    return sorted(set(_REF.findall(text)))


def with_clause(names) -> list[tuple[str, str]]:
    """(name, SQL) of the named views and all they rest on, in dependency order."""
    done: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in done or name not in VIEWS:
            return
        for ref in references(VIEWS[name]):
            visit(ref)
        done[name] = _REF.sub(r"\1", VIEWS[name]).strip()

    for name in names:
        visit(name)
    return list(done.items())


#: Bytes of a lone file that is worth dealing out, and beyond which it has row groups enough for Spark to cut it.
LONE_FILE = (1 << 20, 64 << 20)


def dealt_out(table: DataFrame) -> DataFrame:
    """A table in one file of one row group is one task's work in all that follows: its rows are dealt out over the processors. Larger ones stay as read."""
    spark, files = table.sparkSession, table.inputFiles()
    if len(files) != 1 or spark.sparkContext.defaultParallelism < 2:
        return table
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return table.repartition(spark.sparkContext.defaultParallelism) if LONE_FILE[0] <= size <= LONE_FILE[1] else table


class Tables:
    """Base tables of one folder and the views over them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in BASE_TABLES):
            raise AttributeError(name)
        if name not in self._cache:
            if name in BASE_TABLES:
                self._cache[name] = dealt_out(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))
            else:
                text = VIEWS[name]
                self._cache[name] = self.spark.sql(text, **{r: getattr(self, r) for r in references(text)})
        return self._cache[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{r: getattr(self, r) for r in references(text)})
