"""Adapter views as SQL text that Spark and DuckDB read alike.

``{name}`` refers to a test table or to another adapter. Each view reads whole tables; its rows grow with them.
Servers, databases, groups and tables of the imaginary fleet are derived from the keys, so their number grows too.
"""

from __future__ import annotations

import re

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations")


def text(expression: str) -> str:
    return f"CAST({expression} AS VARCHAR(20))"


def whole(expression: str) -> str:
    return f"CAST(floor({expression}) AS BIGINT)"


def named(prefix: str, expression: str) -> str:
    return f"concat('{prefix}', {text(expression)})"


def place(key: str) -> str:
    """Server and database of a catalog object, from its key."""
    return f"{named('srv', f'{key} % 10')} AS server_name, {named('db', f'{key} % 4')} AS database_name"


def seconds_after(start: str, seconds: str) -> str:
    return f"{start} + INTERVAL '1' SECOND * CAST({seconds} AS INT)"


IO_SERVER = f"{named('srv', whole('l_suppkey / 10e0'))} AS server_name"
IO_FILE = "CAST(l_suppkey % 5 + 1 AS INT) AS database_id, CAST(l_linenumber AS INT) AS file_id"

ADAPTERS: dict[str, str] = {}

# --- counters: monthly polls, counters restart every year, keys with no activity in a month miss that poll
ADAPTERS["io_snapshots"] = f"""
WITH b AS (
  SELECT {IO_SERVER}, {IO_FILE}, date_trunc('month', l_shipdate) AS collect_date,
    sum(CASE WHEN l_linestatus = 'O' THEN {whole('l_quantity')} ELSE 0 END) AS r,
    sum(CASE WHEN l_linestatus = 'F' THEN {whole('l_quantity')} ELSE 0 END) AS w,
    sum(CASE WHEN l_linestatus = 'O' THEN {whole('l_extendedprice')} ELSE 0 END) AS rb,
    sum(CASE WHEN l_linestatus = 'F' THEN {whole('l_extendedprice')} ELSE 0 END) AS wb
  FROM {{lineitem}} GROUP BY 1, 2, 3, 4)
SELECT server_name, database_id, file_id, collect_date,
  CAST(sum(r) OVER y AS BIGINT) AS num_of_reads, CAST(sum(rb) OVER y * 64 AS BIGINT) AS num_of_bytes_read,
  CAST(sum(r) OVER y * 3 AS BIGINT) AS io_stall_read_ms, CAST(sum(w) OVER y AS BIGINT) AS num_of_writes,
  CAST(sum(wb) OVER y * 64 AS BIGINT) AS num_of_bytes_written, CAST(sum(w) OVER y * 2 AS BIGINT) AS io_stall_write_ms,
  CAST(sum(r * 3 + w * 2) OVER y AS BIGINT) AS io_stall_ms
FROM b WINDOW y AS (PARTITION BY server_name, database_id, file_id, year(collect_date) ORDER BY collect_date
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

ADAPTERS["vfs"] = f"""
SELECT {IO_SERVER}, {IO_FILE},
  CAST(sum({whole('l_quantity')}) AS BIGINT) AS num_of_reads,
  CAST(sum({whole('l_extendedprice')}) AS BIGINT) AS num_of_bytes_read,
  CAST(sum({whole('l_quantity')}) * 3 AS BIGINT) AS io_stall_read_ms, CAST(count(*) AS BIGINT) AS num_of_writes,
  CAST(count(*) * 8192 AS BIGINT) AS num_of_bytes_written, CAST(count(*) * 2 AS BIGINT) AS io_stall_write_ms,
  CAST(sum({whole('l_quantity')}) * 3 + count(*) * 2 AS BIGINT) AS io_stall_ms
FROM {{lineitem}} GROUP BY 1, 2, 3"""

ADAPTERS["files"] = f"""
SELECT {IO_SERVER}, {IO_FILE}, {named('db', 'l_suppkey % 5 + 1')} AS database_name,
  {named('f', 'l_linenumber')} AS file_name, CASE WHEN l_linenumber = 7 THEN 'LOG' ELSE 'ROWS' END AS type_desc,
  concat(CASE WHEN l_linenumber % 2 = 0 THEN 'd' ELSE 'e' END, ':/data/f') AS physical_name,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1000 ELSE 0 END) AS BIGINT) AS size_pages,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 600 + l_linenumber ELSE 0 END) AS BIGINT) AS used_pages
FROM {{lineitem}} GROUP BY 1, 2, 3, 4, 5, 6, 7"""

# --- waits: daily polls, one restart on the 15th, one benign type, some lower-case and uncategorised types
ADAPTERS["wait_names"] = """
SELECT * FROM (VALUES (0, 'LCK_M_X'), (1, 'LCK_M_S'), (2, 'LATCH_EX'), (3, 'PAGELATCH_SH'), (4, 'PAGEIOLATCH_SH'),
  (5, 'CXPACKET'), (6, 'WRITELOG'), (7, 'ASYNC_NETWORK_IO'), (8, 'SOS_SCHEDULER_YIELD'), (9, 'HADR_SYNC_COMMIT'),
  (10, 'SLEEP_TASK'), (11, 'BACKUPIO'), (12, 'MSQL_DQ'), (13, 'THREADPOOL'), (14, 'lck_m_u'), (15, 'LATCHX'),
  (16, 'HTBUILD'), (17, 'PREEMPTIVE_OS_FILEOPS'), (18, 'HADR_THROTTLE_LOG_RATE_GOVERNOR'), (19, 'sleep_custom'))
  AS v(i, wait_type)"""

ADAPTERS["wait_snapshots"] = f"""
WITH d AS (
  SELECT {named('srv', whole('user_id / 15e0'))} AS server_name, date_trunc('day', ts) AS collect_date, wait_type,
    sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) AS c, sum({whole('value * 100')}) AS t,
    max({whole('value * 100')}) AS m
  FROM {{events}} JOIN {{wait_names}} n ON n.i = event_id % 20 GROUP BY 1, 2, 3)
SELECT server_name, collect_date, wait_type, CAST(sum(c) OVER y AS BIGINT) AS waiting_tasks_count,
  CAST(sum(t) OVER y AS BIGINT) AS wait_time_ms, CAST(max(m) OVER y AS BIGINT) AS max_wait_time_ms,
  CAST(floor(sum(t) OVER y * 0.1e0) AS BIGINT) AS signal_wait_time_ms
FROM d WINDOW y AS (PARTITION BY server_name, wait_type, CASE WHEN day(collect_date) >= 15 THEN 1 ELSE 0 END
                    ORDER BY collect_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

# --- capture sessions, tablespaces, schemas
ADAPTERS["capture_sessions"] = f"""
SELECT {named('srv', 's_nationkey')} AS server_name, s_suppkey AS address,
  CASE WHEN s_suppkey % 3 = 0 THEN 'queries' ELSE {named('session', 's_suppkey % 7')} END AS name,
  {whole('s_acctbal * 4096')} AS total_buffer_size, 'drop_event' AS buffer_policy_desc, 'flush_on_close' AS flag_desc,
  s_suppkey % 4 AS dropped_event_count, CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE 0 END AS dropped_buffer_count,
  'server' AS session_source
FROM {{supplier}}"""
ADAPTERS["capture_targets"] = f"""
SELECT {named('srv', 's_nationkey')} AS server_name, s_suppkey AS event_session_address, n_name AS target_name,
  concat('<target>', {text('s_suppkey')}, '</target>') AS target_data
FROM {{supplier}} JOIN {{nation}} ON n_nationkey % 5 = s_suppkey % 6"""
ADAPTERS["tablespaces"] = f"""
SELECT {named('srv', 'l_suppkey % 10')} AS server_name, {named('space', 'l_partkey % 17')} AS spcname,
  {named('/data/', 'l_partkey % 17')} AS location, CAST(sum({whole('l_extendedprice')}) * 8192 AS BIGINT) AS size_bytes
FROM {{lineitem}} GROUP BY 1, 2, 3"""
ADAPTERS["namespaces"] = f"""
SELECT {place('c_custkey')},
  CASE c_custkey % 9 WHEN 0 THEN {named('pg_temp_', 'c_custkey')} WHEN 1 THEN 'information_schema'
    ELSE {named('schema', 'c_custkey')} END AS nspname,
  {named('role', 'c_nationkey')} AS owner,
  CASE WHEN c_custkey % 4 = 0 THEN NULL 
    ELSE split(concat({named('role=UC/', 'c_nationkey')}, ';', {named('=U/', 'c_custkey % 5')}), ';') END AS nspacl,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS description
FROM {{customer}}"""

# --- events and traces
ADAPTERS["captured_events"] = f"""
SELECT event_id, ts, user_id, props,
  CASE event_type WHEN 'signup' THEN 'rpc_completed' WHEN 'purchase' THEN 'sql_batch_completed'
    WHEN 'view' THEN 'sql_statement_completed' WHEN 'click' THEN 'sql_transaction' ELSE 'error_reported' END
    AS object_name,
  {whole('value * 10000')} AS duration, CAST(event_id % 4 AS INT) AS transaction_state,
  CASE WHEN event_id % 5 = 0 THEN 1480 ELSE 35264 END AS error_number,
  CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 = 1
    THEN 'Microsoft SQL Server Management Studio - Transact-SQL IntelliSense'
    ELSE {named('app', 'user_id % 3')} END AS client_app_name,
  CASE WHEN event_type = 'error' AND value < 2 THEN 1 ELSE 0 END AS is_malformed
FROM {{events}}"""

ADAPTERS["trace"] = f"""
SELECT {named('srv', 'user_id % 10')} AS server_name, {named('db', 'user_id')} AS database_name,
  CAST(90 + event_id % 8 AS INT) AS event_class, {named('file', 'user_id % 3')} AS file_name,
  {whole('value * 100000')} AS duration, date_trunc('minute', ts) AS start_time,
  {seconds_after("date_trunc('minute', ts)", 'event_id % 50')} AS end_time,
  {whole('value')} AS integer_data, {whole('value * 1000')} AS reads, {named('host', 'user_id % 7')} AS host_name
FROM {{events}}"""

ADAPTERS["trace_databases"] = f"""
SELECT {named('srv', 'user_id % 10')} AS server_name, {named('db', 'user_id')} AS name,
  {seconds_after("date_trunc('day', min(ts))", '5 * 86400')} AS create_date
FROM {{events}} GROUP BY user_id"""

# --- replication: groups of three replicas times four databases, one customer row per replica and database
GROUP = whole("c_custkey / 12e0")
GROUP_SERVER = f"{named('srv', f'{GROUP} % 7')} AS server_name, {GROUP} AS group_id"
DATABASE_NO = whole("(c_custkey % 12) / 3e0")
REPLICA = f"{GROUP} * 3 + c_custkey % 3 AS replica_id"
REPLICA_NAME = f"{named('node', f'{GROUP} * 3 + c_custkey % 3')}"
COMMIT = seconds_after("TIMESTAMP '2024-01-01 00:00:00'", "5000 - (c_custkey % 3) * 97 - c_custkey % 1000")
LSN = "CAST(c_custkey * 1000 AS DECIMAL(25,0))"

ADAPTERS["replica_states"] = f"""
SELECT {GROUP_SERVER}, {GROUP} * 4 + {DATABASE_NO} AS group_database_id, {REPLICA}, {DATABASE_NO} + 5 AS database_id,
  CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS is_local,
  CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS is_primary_replica,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE 'SYNCHRONIZED' END AS synchronization_state_desc,
  1 AS is_commit_participant,
  CASE WHEN c_nationkey % 5 = 0 THEN 'NOT_HEALTHY' ELSE 'HEALTHY' END AS synchronization_health_desc,
  CASE WHEN c_nationkey % 11 = 0 THEN NULL ELSE c_nationkey % 2 END AS is_suspended,
  CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE 'SUSPEND_FROM_USER' END AS suspend_reason_desc,
  {LSN} AS recovery_lsn, {LSN} AS truncation_lsn, {LSN} AS last_sent_lsn,
  CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE {COMMIT} END AS last_sent_time, {LSN} AS last_received_lsn,
  CASE WHEN c_nationkey % 8 = 0 THEN NULL ELSE {COMMIT} END AS last_received_time, {LSN} AS last_hardened_lsn,
  {COMMIT} AS last_hardened_time, CASE WHEN c_nationkey % 5 = 1 THEN NULL ELSE {LSN} END AS last_redone_lsn,
  CASE WHEN c_nationkey % 5 = 1 THEN NULL ELSE {COMMIT} END AS last_redone_time,
  {whole('abs(c_acctbal)')} AS log_send_queue_size,
  CAST(CASE WHEN c_nationkey % 9 = 0 THEN NULL ELSE c_nationkey % 3 * 100 END AS BIGINT) AS log_send_rate,
  CAST(c_custkey * 1000 AS BIGINT) AS redo_queue_size,
  CAST(CASE WHEN c_nationkey % 4 = 0 THEN 0 WHEN c_nationkey % 4 = 1 THEN NULL ELSE c_nationkey * 3 + 1 END AS BIGINT)
    AS redo_rate,
  CAST(CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE 7 END AS BIGINT) AS filestream_send_rate, {LSN} AS end_of_log_lsn,
  CASE WHEN c_nationkey % 6 = 0 THEN NULL ELSE {LSN} END AS last_commit_lsn,
  CASE WHEN c_nationkey % 6 = 0 THEN NULL ELSE {COMMIT} END AS last_commit_time
FROM {{customer}}"""

ADAPTERS["groups"] = f"""
SELECT DISTINCT {GROUP_SERVER}, {named('ag', GROUP)} AS name FROM {{customer}}"""

ADAPTERS["replicas"] = f"""
SELECT DISTINCT {GROUP_SERVER}, {REPLICA}, {REPLICA_NAME} AS replica_server_name,
  CAST(c_custkey % 3 % 2 AS INT) AS availability_mode,
  CASE WHEN c_custkey % 3 % 2 = 1 THEN 'SYNCHRONOUS_COMMIT' ELSE 'ASYNCHRONOUS_COMMIT' END AS availability_mode_desc,
  CASE WHEN c_custkey % 3 = 2 THEN 'MANUAL' ELSE 'AUTOMATIC' END AS failover_mode_desc,
  CASE WHEN c_custkey % 3 = 0 THEN 'NO' ELSE 'ALL' END AS secondary_role_allow_connections_desc
FROM {{customer}}"""

ADAPTERS["cluster_databases"] = f"""
SELECT DISTINCT {GROUP_SERVER}, {GROUP} * 4 + {DATABASE_NO} AS group_database_id,
  {named('app', f'{GROUP} * 4 + {DATABASE_NO}')} AS database_name
FROM {{customer}}"""

ADAPTERS["group_states"] = f"""
SELECT {GROUP_SERVER}, min(CASE WHEN c_custkey % 3 = 0 THEN {REPLICA_NAME} END) AS primary_replica
FROM {{customer}} GROUP BY 1, 2"""

ADAPTERS["replica_roles"] = f"""
SELECT DISTINCT {named('srv', f'{GROUP} % 7')} AS server_name, {REPLICA},
  CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS INT) AS role,
  CASE WHEN c_custkey % 3 = 0 THEN 'PRIMARY' WHEN {GROUP} % 2 = 0 THEN 'SECONDARY' END AS role_desc,
  CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS is_local
FROM {{customer}}"""

# Besides the databases with a state, every replica has one that has not joined yet and has none.
ADAPTERS["cluster_states"] = f"""
SELECT {named('srv', f'{GROUP} % 7')} AS server_name, {REPLICA}, {GROUP} * 4 + {DATABASE_NO} AS group_database_id,
  {named('app', f'{GROUP} * 4 + {DATABASE_NO}')} AS database_name, 1 AS is_database_joined,
  CASE WHEN c_nationkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 2 AS INT) END AS is_failover_ready
FROM {{customer}}
UNION ALL
SELECT DISTINCT {named('srv', f'{GROUP} % 7')}, {REPLICA}, -1 - {GROUP}, {named('new', GROUP)}, 0, 0 FROM {{customer}}"""

# --- backups and jobs
ADAPTERS["backupset"] = f"""
SELECT {named('srv', 'o_custkey % 10')} AS server_name, o_orderkey AS media_set_id,
  {named('db', 'o_custkey')} AS database_name,
  CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'L' ELSE 'I' END AS type, o_orderdate AS backup_start_date,
  {seconds_after('o_orderdate', f"{whole('o_totalprice')} % 90000")} AS backup_finish_date,
  {whole('o_totalprice')} * 1024 AS compressed_backup_size
FROM {{orders}}"""

ADAPTERS["backup_media"] = f"""
SELECT {named('srv', 'o_custkey % 10')} AS server_name, o_orderkey AS media_set_id,
  {named('dev', 'o_orderkey % 5')} AS logical_device_name, {named('/backup/', 'o_orderkey')} AS physical_device_name
FROM {{orders}}"""

ADAPTERS["databases"] = f"""
SELECT {named('srv', 'c_custkey % 10')} AS server_name, CAST(c_custkey AS INT) AS database_id,
  CASE WHEN c_custkey = 77 THEN 'SYSDBA' ELSE {named('db', 'c_custkey')} END AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'SIMPLE' WHEN 'MACHINERY' THEN 'BULK_LOGGED' ELSE 'FULL' END
    AS recovery_model_desc,
  CASE WHEN c_nationkey = 3 THEN 'OFFLINE' ELSE 'ONLINE' END AS state_desc, 150 AS compatibility_level,
  c_nationkey % 2 = 0 AS is_read_only,
  {seconds_after("TIMESTAMP '2020-01-01 00:00:00'", 'c_custkey % 10000')} AS create_date,
  'Latin1_General_CI_AS' AS collation_name
FROM {{customer}}"""

ADAPTERS["grouped_databases"] = f"""
SELECT {named('srv', 's_suppkey % 10')} AS server_name, CAST(s_suppkey AS INT) AS database_id, s_nationkey AS replica
FROM {{supplier}} UNION ALL
SELECT {named('srv', 's_suppkey % 10')}, CAST(s_suppkey AS INT), s_nationkey + 1 FROM {{supplier}}"""

ADAPTERS["database_files"] = f"""
SELECT {named('srv', 'o_custkey % 10')} AS server_name, CAST(o_custkey AS INT) AS database_id,
  CASE o_orderstatus WHEN 'F' THEN 'ROWS' WHEN 'O' THEN 'LOG' ELSE 'FILESTREAM' END AS type_desc,
  {whole('o_totalprice')} AS size_pages
FROM {{orders}}"""

ADAPTERS["jobs"] = f"""
SELECT {named('srv', 'c_custkey % 10')} AS server_name, c_custkey AS job_id,
  concat(CASE WHEN c_mktsegment = 'BUILDING' THEN 'dba_' ELSE 'job_' END, c_name) AS name,
  CASE WHEN c_nationkey % 3 = 0 THEN 0 ELSE 1 END AS enabled,
  {seconds_after("TIMESTAMP '2019-01-01 00:00:00'", 'c_custkey % 10000')} AS date_created
FROM {{customer}}"""

# The highest customer keys never ran: their orders are credited to the job of half the key.
ADAPTERS["job_history"] = f"""
SELECT {named('srv', f"{whole('o_custkey / 2e0')} % 10")} AS server_name, {whole('o_custkey / 2e0')} AS job_id,
  CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INT) AS run_date,
  CAST(o_orderkey % 30 * 10000 + o_orderkey % 60 * 100 + o_custkey % 60 AS INT) AS run_duration
FROM {{orders}}"""

# --- principals
ADAPTERS["principals"] = f"""
SELECT {place('c_custkey')}, c_custkey AS principal_id, {named('dom/user', 'c_custkey')} AS name,
  CASE WHEN c_nationkey % 2 = 0 THEN 'WINDOWS' ELSE 'INSTANCE' END AS authentication_type_desc
FROM {{customer}}"""

ADAPTERS["permissions"] = f"""
SELECT {place('o_custkey')}, o_custkey AS grantee_principal_id,
  CASE o_orderstatus WHEN 'F' THEN 'OBJECT_OR_COLUMN' WHEN 'O' THEN 'SCHEMA' ELSE 'DATABASE' END AS class_desc,
  CASE o_orderstatus WHEN 'F' THEN o_orderkey % 120 * 20 + o_custkey % 20 WHEN 'O' THEN o_orderkey % 6 ELSE 0 END
    AS major_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'SELECT' ELSE 'EXECUTE' END AS permission_name, 'GRANT' AS state_desc,
  CASE WHEN o_orderkey % 2 = 0 THEN 'SL' ELSE 'EX' END AS type
FROM {{orders}}"""

ADAPTERS["role_members"] = f"""
SELECT DISTINCT {place('o_custkey')}, o_custkey % 20 + o_orderkey % 3 * 20 AS role_principal_id,
  o_custkey AS member_principal_id
FROM {{orders}}"""

# --- storage catalogs: tables are parts, indexes and partitions come from their line items
SCHEMA_NO = whole("p_partkey / 20e0") + " % 5"
INDEX_NO = "CAST(CASE WHEN l_linenumber = 1 AND l_partkey % 4 = 0 THEN 0 ELSE l_linenumber END AS INT)"
HOBT = "object_id * 100 + line * 10 + part"
PART_KEYS = f"""l_partkey AS object_id, {INDEX_NO} AS index_id, CAST(l_linenumber AS BIGINT) AS line,
  l_suppkey % 3 + 1 AS part"""

ADAPTERS["tables_catalog"] = f"""
SELECT {place('p_partkey')}, p_partkey AS object_id, {SCHEMA_NO} AS schema_id, {named('sch', SCHEMA_NO)} AS schema_name,
  {named('T_Reservation', 'p_partkey')} AS name, CASE WHEN p_size = 50 THEN 1 ELSE 0 END AS is_ms_shipped,
  {seconds_after("TIMESTAMP '2018-01-01 00:00:00'", 'p_partkey % 10000')} AS create_date,
  {seconds_after("TIMESTAMP '2021-01-01 00:00:00'", 'p_partkey % 10000')} AS modify_date
FROM {{part}}"""

ADAPTERS["schemas"] = f"""
SELECT DISTINCT {place('p_partkey')}, {SCHEMA_NO} AS schema_id, {named('sch', SCHEMA_NO)} AS name FROM {{part}}"""

ADAPTERS["types"] = """
SELECT * FROM (VALUES (56, 56, 'int'), (127, 127, 'bigint'), (167, 167, 'varchar'), (231, 231, 'nvarchar'),
  (231, 256, 'sysname'), (61, 61, 'datetime'), (106, 106, 'decimal'), (106, 300, 'Money_Alias'))
  AS v(system_type_id, user_type_id, name)"""

ADAPTERS["columns"] = f"""
SELECT {place('object_id')}, object_id, column_id, {named('c', 'column_id')} AS name,
  CASE column_id WHEN 1 THEN 56 WHEN 2 THEN 167 WHEN 3 THEN 231 WHEN 4 THEN 61 ELSE 106 END AS system_type_id,
  CASE column_id WHEN 1 THEN 56 WHEN 2 THEN 167 WHEN 3 THEN 256 WHEN 4 THEN 61 WHEN 5 THEN 106 ELSE 300 END
    AS user_type_id,
  CASE column_id WHEN 1 THEN 4 WHEN 2 THEN -1 WHEN 3 THEN 256 WHEN 4 THEN 8 ELSE 9 END AS max_length,
  CASE WHEN column_id >= 5 THEN 18 ELSE 0 END AS precision, CASE WHEN column_id >= 5 THEN 2 ELSE 0 END AS scale,
  CASE WHEN column_id IN (2, 3) THEN 'Latin1_General_CI_AS' END AS collation_name,
  CASE WHEN column_id = 1 THEN 0 ELSE 1 END AS is_nullable, CASE WHEN column_id = 1 THEN 1 ELSE 0 END AS is_identity
FROM (SELECT DISTINCT l_partkey AS object_id, CAST(l_suppkey % 6 + 1 AS INT) AS column_id FROM {{lineitem}}) x"""

ADAPTERS["indexes"] = f"""
SELECT {place('object_id')}, object_id, index_id, concat('ix_', {text('object_id')}, ']', {text('index_id')}) AS name,
  CASE index_id WHEN 0 THEN 'HEAP' WHEN 1 THEN 'CLUSTERED' WHEN 7 THEN 'CLUSTERED COLUMNSTORE' ELSE 'NONCLUSTERED' END
    AS type_desc,
  CAST(CASE index_id WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 7 THEN 5 ELSE 2 END AS INT) AS type,
  CASE WHEN index_id IN (1, 3) THEN 1 ELSE 0 END AS is_unique,
  CASE WHEN index_id = 1 OR (index_id = 3 AND object_id % 4 = 0) THEN 1 ELSE 0 END AS is_primary_key,
  0 AS is_unique_constraint, CASE WHEN index_id = 5 THEN '([c1]>(0))' END AS filter_definition,
  CASE WHEN index_id = 5 THEN 1 ELSE 0 END AS has_filter, CAST(object_id % 5 + index_id % 2 AS INT) AS data_space_id,
  1 AS allow_page_locks, 1 AS allow_row_locks, 0 AS is_hypothetical, CAST(index_id * 10 AS INT) AS fill_factor
FROM (SELECT DISTINCT l_partkey AS object_id, {INDEX_NO} AS index_id FROM {{lineitem}}) x"""

# Heaps have no index columns.
ADAPTERS["index_columns"] = f"""
SELECT {place('object_id')}, object_id, index_id, column_id, position AS index_column_id,
  CASE WHEN column_id >= 5 THEN 0 ELSE position END AS key_ordinal,
  CASE WHEN column_id >= 5 THEN 1 ELSE 0 END AS is_included_column,
  CASE WHEN column_id = 4 THEN 1 ELSE 0 END AS is_descending_key,
  CASE WHEN column_id = 1 THEN 1 ELSE 0 END AS partition_ordinal
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY object_id, index_id ORDER BY column_id) AS INT) AS position
      FROM (SELECT DISTINCT l_partkey AS object_id, {INDEX_NO} AS index_id, CAST(l_suppkey % 6 + 1 AS INT) AS column_id
            FROM {{lineitem}}) d) x
WHERE index_id > 0"""

ADAPTERS["index_usage"] = f"""
SELECT {place('object_id')}, * FROM (
  SELECT l_partkey AS object_id, {INDEX_NO} AS index_id,
    CAST(sum(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) AS BIGINT) AS user_seeks,
    CAST(sum(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) AS BIGINT) AS user_scans,
    CAST(sum(CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END) AS BIGINT) AS user_lookups,
    CAST(count(*) AS BIGINT) AS user_updates,
    max(CASE WHEN l_discount > 0.08 THEN l_shipdate END) AS last_user_seek,
    max(CASE WHEN l_tax > 0.07 THEN l_shipdate END) AS last_user_scan,
    max(CASE WHEN l_quantity > 49 THEN l_shipdate END) AS last_user_lookup, max(l_shipdate) AS last_user_update
  FROM {{lineitem}} GROUP BY 1, 2 HAVING sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) > 0) x"""

ADAPTERS["partitions"] = f"""
SELECT {place('object_id')}, object_id, index_id, {HOBT} AS hobt_id, {HOBT} AS partition_id,
  CAST(part AS INT) AS partition_number, CAST((object_id + part) % 3 AS INT) AS data_compression, rows
FROM (SELECT {PART_KEYS}, CAST(sum({whole('l_quantity')}) AS BIGINT) AS rows FROM {{lineitem}} GROUP BY 1, 2, 3, 4) x"""

ADAPTERS["allocation_units"] = f"""
SELECT {place('object_id')}, {HOBT} AS container_id, type_desc, total_pages, used_pages
FROM (SELECT {PART_KEYS}, l_returnflag AS type_desc, CAST(count(*) * 500 AS BIGINT) AS total_pages,
        CAST(count(*) * 400 + sum(l_linenumber) AS BIGINT) AS used_pages
      FROM {{lineitem}} GROUP BY 1, 2, 3, 4, 5) x"""

ADAPTERS["partition_stats"] = f"""
SELECT {place('object_id')}, object_id, index_id, {HOBT} AS partition_id, CAST(n * 500 AS BIGINT) AS reserved_page_count,
  CAST(n * 400 + lines AS BIGINT) AS used_page_count, CAST(n * 300 AS BIGINT) AS in_row_data_page_count,
  CAST(n * 300 AS BIGINT) AS in_row_reserved_page_count, CAST(lines AS BIGINT) AS lob_used_page_count,
  CAST(lines * 2000 AS BIGINT) AS lob_reserved_page_count, row_overflow_used_page_count, row_count
FROM (SELECT {PART_KEYS}, count(*) AS n, sum(l_linenumber) AS lines,
        CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS row_overflow_used_page_count,
        CAST(sum({whole('l_quantity * l_quantity')}) AS BIGINT) AS row_count
      FROM {{lineitem}} GROUP BY 1, 2, 3, 4) x"""

ADAPTERS["internal_tables"] = f"""
SELECT {place('p_partkey')}, p_partkey AS object_id,
  CASE p_size % 5 WHEN 0 THEN 202 WHEN 1 THEN 204 WHEN 2 THEN 216 ELSE 300 END AS internal_type
FROM {{part}}"""

ADAPTERS["partition_schemes"] = f"""
SELECT DISTINCT {place('p_partkey')}, CAST(1 AS INT) AS data_space_id, 11 AS function_id, 'ps_month' AS name
FROM {{part}}
UNION ALL
SELECT DISTINCT {place('p_partkey')}, CAST(4 AS INT), 12, 'ps_orphan' FROM {{part}}"""

ADAPTERS["partition_functions"] = f"""
SELECT DISTINCT {place('p_partkey')}, 11 AS function_id, 'pf_month' AS name FROM {{part}}"""

ADAPTERS["filegroups"] = f"""
SELECT DISTINCT {place('p_partkey')}, CAST(p_partkey % 2 * 2 AS INT) AS data_space_id, 'PRIMARY' AS name FROM {{part}}
UNION ALL
SELECT DISTINCT {place('p_partkey')}, CAST(3 AS INT), 'FG_HISTORY' FROM {{part}}"""

# --- buffer cache: one row per page; line 7 is an unused buffer; relations of another database do not resolve
ADAPTERS["buffer_pages"] = f"""
SELECT {named('srv', 'l_partkey % 10')} AS server_name, l_partkey AS relfilenode,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_suppkey % 3 = 0 THEN {named('db', 'l_suppkey % 4')}
    ELSE {named('db', 'l_partkey % 4')} END AS database_name,
  CAST(l_orderkey % 6 AS INT) AS usagecount, l_returnflag = 'R' AS isdirty
FROM {{lineitem}}"""

ADAPTERS["relations"] = f"""
SELECT {place('p_partkey')}, p_partkey AS relfilenode,
  CASE WHEN p_size > 45 THEN 'pg_catalog' ELSE p_brand END AS nspname, {named('rel', whole('p_partkey / 40e0'))} AS relname,
  CASE WHEN p_size % 10 = 0 THEN 'm' ELSE 'r' END AS relkind,
  CAST(CASE WHEN p_partkey % 8 = 0 THEN 0 ELSE p_size * 81920 END AS BIGINT) AS relation_bytes,
  CAST(p_size * 90000 AS BIGINT) AS table_bytes, CAST(p_size * 90000 + p_partkey * 10000 AS BIGINT) AS total_bytes
FROM {{part}}"""

ADAPTERS["database_sizes"] = f"""
SELECT {place('p_partkey')}, CAST(sum(p_size) * 12345 AS BIGINT) AS database_bytes FROM {{part}} GROUP BY 1, 2"""

# --- bloat: tables of up to eight attributes
TABLE_NO = named("t", whole("p_partkey / 8e0"))
OWNER = f"{named('srv', whole('p_partkey / 8e0') + ' % 10')} AS server_name, " \
        f"{named('db', whole('p_partkey / 8e0') + ' % 4')} AS database_name, " \
        f"{named('sch', whole('p_partkey / 8e0') + ' % 3')} AS schemaname"
PG_TABLE = f"CASE WHEN {whole('p_partkey / 8e0')} % 17 = 0 THEN concat('pg_', {TABLE_NO}) ELSE {TABLE_NO} END"

ADAPTERS["column_stats"] = f"""
SELECT {OWNER}, CASE WHEN p_partkey % 8 = 7 THEN concat({PG_TABLE}, '_i3') ELSE {PG_TABLE} END AS tablename,
  {named('a', 'p_partkey % 8')} AS attname,
  CAST(CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_partkey % 8 END AS DOUBLE) / 8 AS null_frac,
  CASE WHEN p_size > 48 THEN NULL ELSE p_size END AS avg_width,
  CASE WHEN p_size % 7 = 0 THEN 'name' ELSE 'integer' END AS type_name
FROM {{part}}"""

ADAPTERS["index_pages"] = f"""
SELECT {OWNER}, {PG_TABLE} AS tablename, concat({PG_TABLE}, '_i', {text('p_partkey % 8')}) AS indexname,
  'r' AS relkind, CASE WHEN p_size % 11 = 0 THEN 'gin' ELSE 'btree' END AS access_method,
  CAST(p_size * 1000 AS DOUBLE) AS reltuples,
  CAST(CASE WHEN p_size % 13 = 0 THEN 0 ELSE p_size * 4 END AS INT) AS relpages,
  concat('a', {text('p_partkey % 4 + 4')}, ' a', {text('p_partkey % 4')}) AS key_columns
FROM {{part}}"""

ADAPTERS["table_pages"] = f"""
SELECT {OWNER}, {PG_TABLE} AS tablename, CAST(sum(p_size) * 100 AS DOUBLE) AS reltuples,
  CAST(sum(p_size) * 2 AS INT) AS relpages
FROM {{part}} GROUP BY 1, 2, 3, 4"""

# --- statements, sessions, locks
ADAPTERS["statements"] = f"""
SELECT {named('srv', 'user_id % 10')} AS server_name, props AS query, CAST(count(*) AS BIGINT) AS calls,
  CAST(sum({whole('value * 100')}) AS DOUBLE) AS total_time, CAST(max({whole('value')}) AS DOUBLE) AS stddev_time
FROM {{events}} GROUP BY 1, 2"""

ADAPTERS["sessions"] = f"""
SELECT {place('user_id')}, event_id AS pid,
  CASE event_type WHEN 'view' THEN 'idle' WHEN 'click' THEN 'idle in transaction' ELSE 'active' END AS state,
  {named('user', 'user_id')} AS usename, ts AS query_start,
  concat('select ', props, ' from a_table_with_a_rather_long_name where id = 1') AS query
FROM {{events}}"""

ADAPTERS["locks"] = f"""
SELECT {place('user_id')}, CASE WHEN event_type = 'error' THEN -1 - event_id ELSE event_id END AS pid,
  CASE WHEN value > 20 THEN 'relation' ELSE 'transactionid' END AS locktype,
  CASE WHEN value > 20 THEN user_id END AS relation, CASE WHEN value > 20 THEN NULL ELSE event_id END AS transactionid,
  'AccessShareLock' AS mode, event_id % 3 = 0 AS granted, {named('3/', 'event_id')} AS virtualtransaction
FROM {{events}}"""

ADAPTERS["settings"] = f"""
SELECT DISTINCT {named('srv', 'user_id % 10')} AS server_name, 'max_connections' AS name, '2000' AS setting
FROM {{events}}"""

ADAPTERS["connection_limits"] = f"""
SELECT DISTINCT {place('p_partkey')}, CAST(CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE 1000 END AS BIGINT) AS datconnlimit
FROM {{part}}"""

# --- statistics
ADAPTERS["database_stats"] = f"""
SELECT {named('srv', 'c_custkey % 10')} AS server_name, {named('db', 'c_custkey')} AS database_name,
  CAST(CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE abs({whole('c_acctbal')}) END AS BIGINT) AS blks_read,
  CAST(CASE WHEN c_nationkey % 10 = 0 THEN 0 ELSE c_custkey * 77 + 5 END AS BIGINT) AS blks_hit,
  CAST(CASE WHEN c_nationkey % 3 = 0 THEN 0 ELSE c_nationkey * 2.5e0 END AS DOUBLE) AS blk_read_time,
  CAST(c_custkey % 9 AS BIGINT) AS temp_files, CAST(c_custkey * 9999 AS BIGINT) AS temp_bytes,
  CAST(c_custkey % 4 AS BIGINT) AS conflicts, CAST(c_custkey % 3 AS BIGINT) AS deadlocks,
  CASE WHEN c_nationkey % 7 = 0 THEN NULL
    ELSE {seconds_after("TIMESTAMP '2023-12-01 00:00:00'", 'c_custkey')} END AS stats_reset,
  CAST(c_custkey * 7340033 AS BIGINT) AS size_bytes
FROM {{customer}}"""

ADAPTERS["stat_databases"] = f"""
SELECT {named('srv', 'o_custkey % 10')} AS server_name, {named('db', 'o_custkey')} AS database_name FROM {{orders}}"""

ADAPTERS["table_io"] = f"""
SELECT {named('srv', 'l_suppkey % 3')} AS server_name, {named('db', 'l_suppkey % 2')} AS database_name,
  {named('sch', 'l_suppkey % 4')} AS schemaname, {named('t', 'l_suppkey')} AS relname,
  CAST(CASE WHEN l_suppkey % 11 = 0 THEN 0 WHEN l_suppkey % 13 = 0 THEN NULL ELSE sum(floor(l_quantity)) END AS BIGINT)
    AS heap_blks_read,
  CAST(CASE WHEN l_suppkey % 11 = 0 THEN 0 ELSE sum(floor(l_quantity)) * 9 END AS BIGINT) AS heap_blks_hit,
  CAST(CASE WHEN l_suppkey % 11 = 0 THEN 0 WHEN l_suppkey % 4 = 0 THEN NULL ELSE count(*) END AS BIGINT)
    AS idx_blks_read,
  CAST(CASE WHEN l_suppkey % 11 = 0 THEN 0 WHEN l_suppkey % 4 = 0 THEN NULL ELSE count(*) * 20 END AS BIGINT)
    AS idx_blks_hit,
  CAST(CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 11 = 0 THEN 0 ELSE 3 END AS BIGINT) AS toast_blks_read,
  CAST(CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 11 = 0 THEN 0 ELSE 30 END AS BIGINT) AS toast_blks_hit,
  CAST(0 AS BIGINT) AS tidx_blks_read, CAST(NULL AS BIGINT) AS tidx_blks_hit,
  CAST(CASE WHEN l_suppkey % 11 = 0 THEN 0 ELSE count(*) END AS BIGINT) AS n_live_tup,
  CAST(CASE WHEN l_suppkey % 11 = 0 THEN 0
    ELSE sum(CASE WHEN l_returnflag = 'R' AND l_suppkey % 3 > 0 THEN 1 ELSE 0 END) END AS BIGINT) AS n_dead_tup,
  max(l_shipdate) AS last_vacuum, min(l_shipdate) AS last_autovacuum
FROM {{lineitem}} GROUP BY l_suppkey"""

ADAPTERS["index_scans"] = f"""
SELECT {place('p_partkey')}, {named('sch', 'p_partkey % 4')} AS schemaname, {named('rel', 'p_partkey')} AS relname,
  {named('ix', 'p_partkey')} AS indexrelname, CAST(p_size * 4 AS BIGINT) AS idx_scan,
  CAST(p_partkey * 3 AS BIGINT) AS idx_tup_read, CAST(p_partkey * 2 AS BIGINT) AS idx_tup_fetch,
  CAST(p_partkey * 5000 AS BIGINT) AS size_bytes
FROM {{part}}"""


def inputs_of(name: str) -> list[str]:
    """Test tables and adapters an adapter refers to, in order of appearance."""
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", ADAPTERS[name])))


def duckdb_ctes(*names: str) -> str:
    """The named adapters, and those they need, as a WITH list for DuckDB."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered or name in BASE_TABLES:
            return
        for needed in inputs_of(name):
            visit(needed)
        ordered.append(name)

    for name in names:
        visit(name)
    bodies = [f"{n} AS ({ADAPTERS[n].format(**{i: i for i in inputs_of(n)})}\n)" for n in ordered]
    return "WITH " + ",\n".join(bodies)
