"""The expected result of every registered query, as DuckDB SQL over the same adapter views.

The SQL is written independently of the operators: previous snapshots by self-join, ranks by plain windows, lists by
string_agg, rounding by integer arithmetic.
"""

from __future__ import annotations

from statloom.fixtures import queries as q
from statloom.fixtures.adapters import BASE_TABLES, duckdb_ctes
from statloom.operators.waits import BENIGN_WAITS

ORACLES: dict[str, str] = {}


def oracle(name: str, views: str, sql: str) -> None:
    ORACLES[name] = f"{duckdb_ctes(*views.split())}{sql}" if views else sql


# ------------------------------------------------------------------------------------------------- SQL fragments

def half_up(n: str, d: str, digits: int) -> str:
    """n / d rounded half away from zero, by integers; NULL for d = 0."""
    scale = 10 ** digits
    n, d = f"CAST({n} AS HUGEINT)", f"CAST({d} AS HUGEINT)"
    exact = f"(2 * abs({n}) * {scale} + {d}) // (2 * nullif({d}, 0))"
    return f"(sign({n}) * CAST({exact} AS DOUBLE) / {scale})"


def pct(part: str, total: str, digits: int) -> str:
    return half_up(f"(100 * ({part}))", f"({total})", digits)


def pretty(size: str) -> str:
    s = f"CAST({size} AS BIGINT)"

    def scaled(power: int) -> str:
        return f"((abs({s}) + {2 ** (10 * power - 1)}) // {2 ** (10 * power)})"

    sign = f"CASE WHEN {s} < 0 THEN '-' ELSE '' END"
    return (f"CASE WHEN abs({s}) < 10240 THEN {sign} || abs({s}) || ' bytes' "
            f"WHEN {scaled(1)} < 10240 THEN {sign} || {scaled(1)} || ' kB' "
            f"WHEN {scaled(2)} < 10240 THEN {sign} || {scaled(2)} || ' MB' "
            f"WHEN {scaled(3)} < 10240 THEN {sign} || {scaled(3)} || ' GB' "
            f"ELSE {sign} || {scaled(4)} || ' TB' END")


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def names(*columns: str) -> str:
    return ", ".join(columns)


SRV_DB = "server_name, database_name"
TABLE = "server_name, database_name, object_id"
INDEX = f"{TABLE}, index_id"

# ---------------------------------------------------------------------------------------------- counters and waits
IO = ("num_of_reads", "num_of_bytes_read", "io_stall_read_ms", "num_of_writes", "num_of_bytes_written",
      "io_stall_write_ms", "io_stall_ms")

oracle("io_snapshot_enrich", "vfs files", f"""
SELECT v.*, f.database_name, f.file_name, f.type_desc, upper(substr(f.physical_name, 1, 1)) AS drive,
  TIMESTAMP '{q.ENRICH_AS_OF}' AS collect_date
FROM vfs v JOIN files f USING (server_name, database_id, file_id)""")

NUMBERED = """, n AS (SELECT *, dense_rank() OVER (PARTITION BY server_name ORDER BY collect_date) AS poll FROM {0})"""
IO_PAIRS = """FROM n c JOIN n p ON p.server_name = c.server_name AND p.database_id = c.database_id
  AND p.file_id = c.file_id AND p.poll = c.poll - 1"""
IO_DELTAS = ("c.server_name, c.database_id, c.file_id, c.collect_date, "
             + names(*[f"greatest(c.{x} - p.{x}, 0) AS {x}" for x in IO]))
IO_DELTA_SQL = (NUMBERED.format("io_snapshots")
                + f"\nSELECT {IO_DELTAS} {IO_PAIRS} WHERE c.num_of_reads + c.num_of_writes > 0")
oracle("io_counter_delta", "io_snapshots", IO_DELTA_SQL)


def alert_sql(read_ms: int, write_ms: int, reads: int, writes: int) -> str:
    return NUMBERED.format("io_snapshots") + f"""
SELECT {IO_DELTAS} {IO_PAIRS}
WHERE c.io_stall_read_ms >= p.io_stall_read_ms + {read_ms} OR c.io_stall_write_ms >= p.io_stall_write_ms + {write_ms}
  OR c.num_of_reads >= p.num_of_reads + {reads} OR c.num_of_writes >= p.num_of_writes + {writes}"""


oracle("io_threshold_alert", "io_snapshots", alert_sql(25, 50, 100, 200))
oracle("io_threshold_alert_job", "io_snapshots", alert_sql(50, 10, 100, 200))


def per_op(amount: str, ops: str) -> str:
    return big(f"CASE WHEN {ops} > 0 THEN ({amount}) // nullif({ops}, 0) ELSE 0 END")


def mb_rate(size: str, ms: str) -> str:
    return f"CASE WHEN {ms} > 0 THEN {half_up(f'(({size}) // 1048576) * 1000', ms, 2)} ELSE 0e0 END"


OPS, MOVED = "(num_of_reads + num_of_writes)", "(num_of_bytes_read + num_of_bytes_written)"
oracle("io_readable", "io_snapshots", NUMBERED.format("io_snapshots") + f""", d AS (
SELECT {IO_DELTAS} {IO_PAIRS} WHERE c.num_of_reads + c.num_of_writes > 0)
SELECT *, {per_op('num_of_bytes_read', 'num_of_reads')} AS avg_bytes_by_read,
  {per_op('io_stall_read_ms', 'num_of_reads')} AS avg_read_latency_ms,
  {mb_rate('num_of_bytes_read', 'io_stall_read_ms')} AS read_mb_sec,
  {per_op('num_of_bytes_written', 'num_of_writes')} AS avg_bytes_by_write,
  {per_op('io_stall_write_ms', 'num_of_writes')} AS avg_write_latency_ms,
  {mb_rate('num_of_bytes_written', 'io_stall_write_ms')} AS write_mb_sec,
  {per_op(MOVED, OPS)} AS avg_bytes_by_io, {per_op('io_stall_ms', OPS)} AS avg_latency_ms,
  {mb_rate(MOVED, 'io_stall_ms')} AS io_mb_sec
FROM d""")

RETENTION_SQL = f"""
SELECT * FROM io_snapshots WHERE collect_date >= TIMESTAMP '{q.PURGE_AS_OF}' - INTERVAL 18 MONTH"""
oracle("retention_purge", "io_snapshots", RETENTION_SQL)

BENIGN = ", ".join(f"'{w}'" for w in BENIGN_WAITS)
KEPT = f", kept AS (SELECT * FROM wait_snapshots WHERE upper(wait_type) NOT IN ({BENIGN}) AND waiting_tasks_count > 0)"
oracle("wait_snapshot_filter", "wait_snapshots", f"{KEPT} SELECT * FROM kept")

WAIT_HISTORY = KEPT + NUMBERED.format("kept") + """, h AS (
SELECT c.server_name, c.collect_date, c.wait_type, c.waiting_tasks_count, c.max_wait_time_ms,
  greatest(c.wait_time_ms - coalesce(p.wait_time_ms, c.wait_time_ms), 0) AS wait_time_ms,
  greatest(c.signal_wait_time_ms - coalesce(p.signal_wait_time_ms, c.signal_wait_time_ms), 0) AS signal_wait_time_ms
FROM n c JOIN n p ON p.server_name = c.server_name AND p.wait_type = c.wait_type AND p.poll = c.poll - 1)"""
oracle("wait_delta", "wait_snapshots", f"{WAIT_HISTORY} SELECT * FROM h")
oracle("wait_top_n", "wait_snapshots", f"""{WAIT_HISTORY}
SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY server_name, collect_date ORDER BY wait_time_ms DESC, wait_type)
  <= 10""")

# The categories of the twenty wait types the adapter uses, looked up by hand.
CATEGORIES = """, cat AS (SELECT * FROM (VALUES ('Lock', 'LCK_M_X'), ('Lock', 'LCK_M_S'), ('Lock', 'lck_m_u'),
  ('Latch', 'LATCH_EX'), ('Latch', 'LATCHX'), ('Buffer Latch', 'PAGELATCH_SH'), ('Buffer IO', 'PAGEIOLATCH_SH'),
  ('Parallelism', 'CXPACKET'), ('Parallelism', 'HTBUILD'), ('Tran Log IO', 'WRITELOG'),
  ('Network IO', 'ASYNC_NETWORK_IO'), ('Replication', 'HADR_SYNC_COMMIT'), ('Idle', 'SLEEP_TASK'),
  ('Idle', 'sleep_custom'), ('Other Disk IO', 'BACKUPIO'), ('Preemptive', 'PREEMPTIVE_OS_FILEOPS'),
  ('Log Rate Governor', 'HADR_THROTTLE_LOG_RATE_GOVERNOR')) AS v(wait_category, wait_type)),
lit AS (SELECT * FROM (VALUES ('Unknown', 'Unknown'), ('Cpu', 'SOS_SCHEDULER_YIELD'), ('Worker Thread', 'THREADPOOL'),
  ('Compilation', 'RESOURCE_SEMAPHORE_QUERY_COMPILE')) AS v(wait_category, wait_type))"""
oracle("wait_categorize", "wait_snapshots", f"""{CATEGORIES}
SELECT wait_category, wait_type FROM cat WHERE wait_type IN (SELECT wait_type FROM wait_snapshots)
UNION ALL SELECT wait_category, wait_type FROM lit""")
oracle("wait_category_rollup", "wait_snapshots", f"""{WAIT_HISTORY}{CATEGORIES}
SELECT h.server_name, h.collect_date, coalesce(m.wait_category, 'Unknown') AS wait_category,
  {big('sum(h.wait_time_ms)')} AS wait_time_ms, {big('sum(h.signal_wait_time_ms)')} AS signal_wait_time_ms
FROM h LEFT JOIN (SELECT * FROM cat UNION ALL SELECT * FROM lit) m ON m.wait_type = h.wait_type
GROUP BY 1, 2, 3""")

# --------------------------------------------------------------------------------------------------------- events
SLOW = f"""duration >= {q.SLOW_US} AND object_name <> 'error_reported'
  AND (object_name <> 'sql_transaction' OR transaction_state = 1 OR transaction_state = 2)"""
oracle("slow_event_filter", "captured_events", f"\nSELECT * FROM captured_events WHERE {SLOW}")

SHRED = """
SELECT ts AS timestamp, object_name AS event_name, 'exec proc' || user_id AS sql_text, CASE WHEN event_id % 7 = 0 THEN '  select ' || props || chr(10) || ' '
    ELSE 'select ' || props END AS statement,
  duration * 2 + CASE WHEN event_id % 11 = 0 THEN 3000000000 ELSE 0 END AS cpu_time, duration, event_id * 3 AS logical_reads,
  event_id AS physical_reads, event_id % 10 AS writes,
  CASE WHEN event_id % 9 > 0 THEN event_id % 100 END AS row_count, 'proc' || user_id AS object_name,
  'user' || user_id AS username, 'db' || (user_id % 5) AS database_name, client_app_name,
  'host' || (user_id % 9) AS client_hostname, CAST(event_id * 7919 AS VARCHAR) AS query_hash,
  CAST(event_id * 104729 AS VARCHAR) AS plan_handle, CAST(user_id AS INT) AS session_id,
  event_id + 1 AS transaction_id, event_id AS event_sequence
FROM captured_events WHERE is_malformed = 0 AND client_app_name LIKE 'app%'"""
oracle("event_shred", "captured_events", SHRED)
oracle("event_rejects", "captured_events", """
SELECT object_name, count(*) AS rejects FROM captured_events WHERE is_malformed = 1 GROUP BY 1""")
oracle("failover_events", "captured_events", """
SELECT ts AS timestamp, CAST(error_number AS INT) AS error_number, 'state of group ' || user_id AS message
FROM captured_events WHERE object_name = 'error_reported' AND is_malformed = 0 AND error_number = 1480""")
oracle("autogrowth_events", "trace trace_databases", """
SELECT dense_rank() OVER (PARTITION BY t.server_name, t.database_name ORDER BY t.start_time DESC) % 2 AS band,
  t.event_class, t.server_name, t.database_name, t.file_name, t.duration // 1000 AS duration_ms, t.start_time,
  t.end_time, t.integer_data * 8 / 1024e0 AS change_in_size_mb
FROM trace t JOIN trace_databases d ON d.server_name = t.server_name AND d.name = t.database_name
WHERE t.event_class IN (92, 93, 94, 95) AND t.end_time > d.create_date""")
oracle("trace_by_host", "trace", """
SELECT duration // 1000000 AS duration_sec, reads * 8 // 1024 AS reads_mb, * FROM trace WHERE host_name = 'host3'""")

# ---------------------------------------------------------------------------------------------------- replication
LSNS = ("recovery_lsn", "truncation_lsn", "last_sent_lsn", "last_received_lsn", "last_hardened_lsn",
        "last_redone_lsn", "end_of_log_lsn", "last_commit_lsn")
REDO = "CASE WHEN redo_rate > 0 THEN redo_queue_size // nullif(redo_rate, 0) END"


def minutes(digits: int) -> str:
    return f"CASE WHEN redo_rate > 0 THEN {half_up(REDO, '60', digits)} END"


oracle("replica_status", "replica_states cluster_databases groups replicas", f"""
SELECT s.server_name, r.replica_server_name, d.database_name, g.name AS ag_name,
  {names(*[f'CAST(s.{x} AS BIGINT) AS {x}' for x in LSNS])},
  s.is_local, s.is_primary_replica, s.synchronization_state_desc, s.is_commit_participant,
  s.synchronization_health_desc, s.is_suspended, s.suspend_reason_desc, s.last_sent_time, s.last_received_time,
  s.last_hardened_time, s.last_redone_time, s.log_send_queue_size, s.log_send_rate, s.redo_queue_size, s.redo_rate,
  s.filestream_send_rate, s.last_commit_time, {minutes(6)} AS est_redo_completion_time_min
FROM replica_states s JOIN cluster_databases d USING (server_name, group_id, group_database_id)
  JOIN groups g USING (server_name, group_id) JOIN replicas r USING (server_name, group_id, replica_id)""")

AS_OF = f"TIMESTAMP '{q.LATENCY_AS_OF}'"
STYLE = "'%d %b %Y %H:%M:%S'"
oracle("replica_latency", "replica_states", f""", s AS (
  SELECT *, date_diff('second', last_commit_time, {AS_OF}) AS late, {REDO} AS redo FROM replica_states)
SELECT server_name, group_id, database_id, replica_id, strftime(last_commit_time, {STYLE}) AS last_commit_time,
  (late // 3600) || ' hour(s), ' || (late // 60 % 60) || ' min, ' || (late % 60) || ' sec' AS time_behind_primary,
  late AS time_behind_primary_sec, log_send_queue_size, redo_queue_size, redo_rate,
  strftime({AS_OF} + INTERVAL 1 MINUTE * (redo // 60), {STYLE}) AS estimated_completion_time,
  {half_up('redo', '60', 2)} AS estimated_recovery_time_minutes, redo AS estimated_recovery_time_seconds,
  strftime({AS_OF}, {STYLE}) AS current_time, synchronization_health_desc, synchronization_state_desc
FROM s WHERE last_redone_time IS NOT NULL""")

oracle("group_mode", "groups replicas group_states", """
SELECT g.server_name, g.name AS ag_name, r.replica_server_name,
  CASE WHEN t.primary_replica = r.replica_server_name THEN 1 ELSE 0 END AS is_primary_server,
  r.availability_mode AS synchronous, r.secondary_role_allow_connections_desc AS readable_secondary,
  r.failover_mode_desc
FROM groups g JOIN replicas r USING (server_name, group_id) JOIN group_states t USING (server_name, group_id)""")

NEVER = "TIMESTAMP '1900-01-01 00:00:00'"
oracle("replica_dashboard", "groups replicas cluster_states replica_states replica_roles", f""", p AS (
  SELECT s.server_name, s.group_id, s.database_id, s.last_commit_time
  FROM replica_states s JOIN replica_roles o USING (server_name, replica_id) WHERE o.role = 1)
SELECT a.server_name, g.name AS availability_group_name, a.replica_server_name AS availability_replica_server_name,
  c.database_name AS availability_database_name, coalesce(c.is_failover_ready, 0) AS is_failover_ready,
  coalesce(o.role_desc, '3') AS replica_role, a.availability_mode_desc AS availability_mode,
  {big('''CASE WHEN c.is_failover_ready = 1 THEN 0
    ELSE coalesce(date_diff('second', s.last_commit_time, p.last_commit_time), 0) END''')} AS estimated_data_loss_sec,
  coalesce(CASE WHEN s.redo_rate <> 0 THEN CAST(s.redo_queue_size AS DOUBLE) / s.redo_rate END, -1e0)
    AS estimated_recovery_time_sec,
  coalesce(s.is_suspended, 0) AS is_suspended, coalesce(s.suspend_reason_desc, '-') AS suspend_reason,
  coalesce(s.synchronization_state_desc, '0') AS synchronization_state,
  coalesce(s.last_received_time, {NEVER}) AS last_received_time,
  coalesce(s.last_redone_time, {NEVER}) AS last_redone_time, coalesce(s.last_sent_time, {NEVER}) AS last_sent_time,
  coalesce(s.log_send_queue_size, -1) AS log_send_queue_size, coalesce(s.log_send_rate, -1) AS log_send_rate_kb_sec,
  coalesce(s.redo_queue_size, -1) AS redo_queue_size_kb, coalesce(s.redo_rate, -1) AS redo_rate_kb_sec,
  coalesce(CASE WHEN s.log_send_rate <> 0 THEN CAST(s.log_send_queue_size AS DOUBLE) / s.log_send_rate END, -1e0)
    AS synchronization_performance,
  coalesce(s.filestream_send_rate, -1) AS filestream_send_rate, coalesce(c.is_database_joined, 0) AS is_joined,
  o.is_local, CAST(coalesce(s.last_commit_lsn, 0) AS BIGINT) AS last_commit_lsn,
  coalesce(s.last_commit_time, {NEVER}) AS last_commit_time,
  CAST(coalesce(s.last_hardened_lsn, 0) AS BIGINT) AS last_hardened_lsn,
  coalesce(s.last_hardened_time, {NEVER}) AS last_hardened_time,
  CAST(coalesce(s.last_received_lsn, 0) AS BIGINT) AS last_received_lsn,
  CAST(coalesce(s.last_redone_lsn, 0) AS BIGINT) AS last_redone_lsn
FROM groups g JOIN replicas a ON a.server_name = g.server_name AND a.group_id = g.group_id
  JOIN cluster_states c ON c.server_name = a.server_name AND c.replica_id = a.replica_id
  LEFT JOIN replica_states s ON s.server_name = c.server_name AND s.replica_id = c.replica_id
    AND s.group_database_id = c.group_database_id
  LEFT JOIN p ON p.server_name = s.server_name AND p.group_id = s.group_id AND p.database_id = s.database_id
  JOIN replica_roles o ON o.server_name = a.server_name AND o.replica_id = a.replica_id""")

oracle("last_log_backup", "databases backupset grouped_databases", """
SELECT d.server_name, d.name AS database_name,
  (SELECT max(b.backup_finish_date) FROM backupset b
   WHERE b.server_name = d.server_name AND b.database_name = d.name AND b.type = 'L') AS last_backup_log,
  d.recovery_model_desc, d.state_desc,
  CASE WHEN EXISTS (SELECT 1 FROM grouped_databases h WHERE h.server_name = d.server_name
                    AND h.database_id = d.database_id) THEN 'AAG' ELSE 'STANDALONE' END AS hadr
FROM databases d WHERE d.recovery_model_desc <> 'SIMPLE'""")

# ------------------------------------------------------------------------------------- backups, jobs and inventory
SIZE_MB = half_up("compressed_backup_size", "1048576", 2)
oracle("backup_history", "backupset backup_media", f""", b AS (
  SELECT *, date_diff('second', backup_start_date, backup_finish_date) AS s
  FROM backupset JOIN backup_media USING (server_name, media_set_id))
SELECT server_name, media_set_id, database_name, type, backup_finish_date, {SIZE_MB} AS compressed_backup_size_mb,
  logical_device_name, physical_device_name, s AS duration_sec,
  lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':'
    || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS hours_minutes
FROM b QUALIFY row_number() OVER (PARTITION BY server_name, database_name
  ORDER BY backup_finish_date DESC, media_set_id, physical_device_name) <= 100""")
oracle("backup_last_n", "backupset", f""", b AS (
  SELECT *, date_diff('second', backup_start_date, backup_finish_date) AS s FROM backupset
  QUALIFY row_number() OVER (PARTITION BY server_name, database_name, type
    ORDER BY backup_start_date DESC, backup_finish_date DESC, media_set_id) <= 10)
SELECT server_name, database_name, type, media_set_id, backup_start_date, backup_finish_date, s AS duration_sec,
  (s // 86400) || 'd ' || strftime(TIMESTAMP '2000-01-01 00:00:00' + INTERVAL 1 SECOND * (s % 86400), '%H:%M:%S')
    || ':000' AS duration,
  {SIZE_MB} AS compressed_backup_size_mb
FROM b""")
oracle("database_inventory", "database_files databases", f"""
SELECT d.server_name, d.name AS database_name, f.type_desc, {big('sum(f.size_pages) // 128')} AS size_mb, d.state_desc,
  d.compatibility_level, d.is_read_only, d.create_date, d.collation_name, d.recovery_model_desc
FROM database_files f JOIN databases d USING (server_name, database_id)
WHERE d.database_id > 4 AND lower(d.name) <> 'sysdba' GROUP BY ALL""")
oracle("job_inventory", "jobs job_history", f"""
SELECT j.server_name, j.name AS job_name, j.date_created, j.enabled, max(h.run_date) AS last_run_date,
  {big('''sum(run_duration // 10000 * 3600 + run_duration // 100 % 100 * 60 + run_duration % 100)
    // count(run_duration)''')} AS avg_run_duration_sec
FROM jobs j LEFT JOIN job_history h USING (server_name, job_id)
WHERE j.name NOT ILIKE 'DBA%' GROUP BY j.server_name, j.job_id, j.name, j.date_created, j.enabled""")
oracle("permission_report", "permissions principals tables_catalog schemas", """
SELECT m.server_name, m.database_name, p.name AS principal_name, p.authentication_type_desc,
  CASE m.class_desc
    WHEN 'OBJECT_OR_COLUMN' THEN (SELECT max(t.name) FROM tables_catalog t WHERE t.server_name = m.server_name
      AND t.database_name = m.database_name AND t.object_id = m.major_id)
    WHEN 'SCHEMA' THEN (SELECT max(s.name) FROM schemas s WHERE s.server_name = m.server_name
      AND s.database_name = m.database_name AND s.schema_id = m.major_id) END AS object_name,
  m.class_desc, m.permission_name, m.state_desc, m.type
FROM permissions m JOIN principals p ON p.server_name = m.server_name AND p.database_name = m.database_name
  AND p.principal_id = m.grantee_principal_id""")
oracle("role_members", "role_members principals", """
SELECT l.server_name, l.database_name, r.name AS role, u.name AS member
FROM role_members l
  JOIN principals r ON r.server_name = l.server_name AND r.database_name = l.database_name
    AND r.principal_id = l.role_principal_id
  JOIN principals u ON u.server_name = l.server_name AND u.database_name = l.database_name
    AND u.principal_id = l.member_principal_id""")

# --------------------------------------------------------------------------------------- storage, columns, indexes
oracle("biggest_tables", "tables_catalog partitions allocation_units", f"""
SELECT t.server_name, t.database_name, t.name AS table_name, max(p.rows) AS nb_rows, count(*) AS nb_partition,
  {big('sum(a.total_pages) // 128')} AS size_mb, {big('sum(a.used_pages) // 128')} AS data_size_mb,
  {big('sum(a.total_pages - a.used_pages) // 128')} AS non_data_size_mb
FROM tables_catalog t JOIN partitions p USING ({TABLE})
  JOIN allocation_units a ON a.server_name = p.server_name AND a.database_name = p.database_name
    AND a.container_id = p.hobt_id
GROUP BY 1, 2, 3 HAVING sum(a.total_pages) // 128 > 100""")

FULL_NAME = "t.schema_name || '.' || t.name"
oracle("table_columns", "columns types tables_catalog", f"""
SELECT c.server_name, c.database_name, {FULL_NAME} AS table_name, c.name AS column_name, c.column_id,
  y.name AS type_name, c.max_length, c.precision, c.scale, c.collation_name, c.is_nullable, c.is_identity
FROM columns c JOIN tables_catalog t USING ({TABLE}) JOIN types y USING (system_type_id, user_type_id)""")
oracle("column_type_search", "columns types tables_catalog", f"""
SELECT c.server_name, c.database_name, t.name AS table_name, c.name AS column_name, c.column_id, c.is_nullable,
  c.is_identity, y.name AS type_name, c.max_length
FROM tables_catalog t JOIN columns c USING ({TABLE}) JOIN types y USING (system_type_id, user_type_id)
WHERE t.name ILIKE '%reservation%' AND y.name NOT IN ('int', 'bigint', 'varchar', 'nvarchar', 'bit')""")

IX_COL = f"""index_columns ic JOIN columns c ON c.server_name = ic.server_name AND c.database_name = ic.database_name
  AND c.object_id = ic.object_id AND c.column_id = ic.column_id"""
PLACE = "{0}.server_name = {1}.server_name AND {0}.database_name = {1}.database_name"


def on_index(a: str, b: str) -> str:
    return f"{PLACE.format(a, b)} AND {a}.object_id = {b}.object_id AND {a}.index_id = {b}.index_id"


SPACES = f"""
  LEFT JOIN partition_schemes ps ON {PLACE.format('ps', 'i')} AND ps.data_space_id = i.data_space_id
  LEFT JOIN partition_functions pf ON {PLACE.format('pf', 'ps')} AND pf.function_id = ps.function_id
  LEFT JOIN filegroups fg ON {PLACE.format('fg', 'i')} AND fg.data_space_id = i.data_space_id"""
CATALOG = "tables_catalog indexes index_columns columns"
oracle("partition_key_ordinals", f"{CATALOG} types partition_schemes partition_functions filegroups", f""", pt AS (
  SELECT DISTINCT i.server_name, i.database_name, i.object_id
  FROM indexes i JOIN partition_schemes s ON {PLACE.format('s', 'i')} AND s.data_space_id = i.data_space_id)
SELECT i.server_name, i.database_name, t.name AS table_name, i.index_id, i.name AS index_name,
  coalesce(pf.name, 'NonAligned') AS partition_function, coalesce(ps.name, fg.name) AS partition_scheme_or_filegroup,
  ic.partition_ordinal, ic.key_ordinal, ic.is_included_column, c.name AS column_name, y.name AS data_type_name,
  c.is_identity, ic.is_descending_key, i.filter_definition
FROM pt JOIN tables_catalog t USING ({TABLE}) JOIN indexes i USING ({TABLE})
  JOIN index_columns ic ON {on_index('ic', 'i')}
  JOIN columns c ON {PLACE.format('c', 'ic')} AND c.object_id = ic.object_id AND c.column_id = ic.column_id
  JOIN types y ON y.system_type_id = c.system_type_id AND y.user_type_id = c.user_type_id{SPACES}""")

TABLE_PAGES = f""", pages AS (
  SELECT {TABLE}, sum(reserved_page_count) AS reserved, sum(used_page_count) AS used,
    sum(lob_used_page_count + row_overflow_used_page_count
        + CASE WHEN index_id < 2 THEN in_row_data_page_count ELSE 0 END) AS data,
    {big('sum(CASE WHEN index_id < 2 THEN row_count ELSE 0 END)')} AS row_count
  FROM partition_stats GROUP BY ALL),
extra AS (
  SELECT {TABLE}, sum(p.reserved_page_count) AS xreserved, sum(p.used_page_count) AS xused
  FROM partition_stats p JOIN internal_tables x USING ({TABLE})
  WHERE x.internal_type IN (202, 204, 211, 212, 213, 214, 215, 216) GROUP BY ALL),
sizes AS (
  SELECT {TABLE}, {FULL_NAME} AS table_name, t.is_ms_shipped, row_count,
    {big('(reserved + coalesce(xreserved, 0)) // 128')} AS reserved_mb, {big('data // 128')} AS data_mb,
    {big('greatest(used + coalesce(xused, 0) - data, 0) // 128')} AS index_mb,
    {big('greatest(reserved + coalesce(xreserved, 0) - used - coalesce(xused, 0), 0) // 128')} AS unused_mb
  FROM pages LEFT JOIN extra USING ({TABLE}) JOIN tables_catalog t USING ({TABLE}))"""
oracle("table_size", "partition_stats internal_tables tables_catalog", f"""{TABLE_PAGES}
SELECT {SRV_DB}, table_name, row_count, reserved_mb, data_mb, index_mb, unused_mb FROM sizes""")
oracle("table_size_limit", "partition_stats internal_tables tables_catalog columns", f"""{TABLE_PAGES}, w AS (
  SELECT {TABLE}, {big('sum(max_length)')} AS max_row_size_bytes FROM columns WHERE max_length > -1 GROUP BY ALL),
e AS (SELECT *, max_row_size_bytes * row_count // 1048576 AS estimated_mb FROM sizes JOIN w USING ({TABLE})
  WHERE is_ms_shipped = 0 AND reserved_mb > 10)
SELECT {SRV_DB}, table_name, row_count, reserved_mb, data_mb, max_row_size_bytes, estimated_mb, index_mb, unused_mb,
  CASE WHEN estimated_mb > 0 THEN 10 * reserved_mb > 8 * estimated_mb END AS near_estimate,
  data_mb > estimated_mb AS over_estimate
FROM e""")

SIZES = f"""isize AS (
  SELECT p.server_name, p.database_name, p.object_id, p.index_id, {big('sum(a.total_pages) // 128')} AS index_size_mb
  FROM partitions p JOIN allocation_units a ON {PLACE.format('a', 'p')} AND a.container_id = p.hobt_id GROUP BY ALL)"""


def listed(expression: str, order: str, condition: str) -> str:
    return f"string_agg({expression}, ', ' ORDER BY {order}) FILTER (WHERE {condition})"


LISTS = f"""lists AS (
  SELECT ic.server_name, ic.database_name, ic.object_id, ic.index_id,
    {listed('c.name', 'ic.index_column_id', 'true')} AS columns_all,
    {listed('c.name', 'ic.index_column_id', 'ic.is_included_column = 0')} AS columns_key,
    {listed('c.name', 'ic.index_column_id', 'ic.is_included_column = 1')} AS columns_included
  FROM {IX_COL} GROUP BY 1, 2, 3, 4)"""
FINGERPRINTS = f""", {SIZES}, {LISTS}, fp AS (
  SELECT {INDEX}, t.schema_name, t.name AS table_name, i.name AS index_name, i.type_desc, i.is_unique,
    i.is_primary_key, i.is_unique_constraint, columns_all, columns_key, columns_included, index_size_mb
  FROM indexes i JOIN tables_catalog t USING ({TABLE}) JOIN isize USING ({INDEX}) LEFT JOIN lists USING ({INDEX})
  WHERE t.is_ms_shipped = 0)"""
FP_VIEWS = f"{CATALOG} partitions allocation_units"
oracle("index_fingerprint", FP_VIEWS, f"{FINGERPRINTS} SELECT * FROM fp")

PAIR = ("is_unique", "is_primary_key", "is_unique_constraint", "index_size_mb", "type_desc")


def pair_columns(columns: str) -> str:
    fields = ["a.server_name", "a.database_name", "a.schema_name", "a.table_name"]
    for side, no in (("a", 1), ("b", 2)):
        fields += [f"{side}.index_id AS index{no}_id", f"{side}.index_name AS index{no}_name",
                   f"{side}.{columns} AS index{no}_columns", *[f"{side}.{f} AS index{no}_{f}" for f in PAIR]]
    return names(*fields)


SAME_TABLE = f"{PLACE.format('b', 'a')} AND b.object_id = a.object_id"
oracle("duplicate_indexes", FP_VIEWS, f"""{FINGERPRINTS}
SELECT {pair_columns('columns_all')} FROM fp a JOIN fp b ON {SAME_TABLE} AND a.index_id < b.index_id
WHERE a.columns_all = b.columns_all""")
oracle("duplicate_indexes_prefix", FP_VIEWS, f"""{FINGERPRINTS}
SELECT {pair_columns('columns_all')} FROM fp a JOIN fp b ON {SAME_TABLE} AND a.index_id <> b.index_id
WHERE starts_with(a.columns_all || ', ', b.columns_all || ', ')
  AND (a.columns_all <> b.columns_all OR a.index_id < b.index_id)""")


def bracket(name: str) -> str:
    return f"'[' || replace({name}, ']', ']]') || ']'"


oracle("duplicate_indexes_keys", FP_VIEWS, f"""{FINGERPRINTS}
SELECT {pair_columns('columns_key')}, a.columns_included AS index1_included, b.columns_included AS index2_included,
  'DROP INDEX ' || {bracket('b.index_name')} || ' ON ' || {bracket('a.schema_name')} || '.' || {bracket('a.table_name')}
    || ';' AS cmd_drop
FROM fp a JOIN fp b ON {SAME_TABLE} AND a.index_id < b.index_id WHERE a.columns_key = b.columns_key""")

oracle("index_detail", FP_VIEWS, f""", {SIZES}
SELECT i.server_name, i.database_name, {FULL_NAME} AS table_name, i.index_id, i.type_desc, i.name AS index_name,
  c.name AS column_name, ic.index_column_id, i.is_primary_key, i.is_unique, i.is_unique_constraint, ic.key_ordinal,
  ic.is_included_column, z.index_size_mb AS size_mb
FROM {IX_COL} JOIN indexes i ON {on_index('i', 'ic')} JOIN isize z ON {on_index('z', 'i')}
  JOIN tables_catalog t ON {PLACE.format('t', 'i')} AND t.object_id = i.object_id""")
oracle("nonclustered_pk", "indexes tables_catalog partitions allocation_units", f""", {SIZES}
SELECT i.server_name, i.database_name, t.name AS table_name, i.index_id, i.type_desc, i.name AS index_name,
  i.is_primary_key, i.is_unique, i.is_unique_constraint, z.index_size_mb AS size_mb
FROM indexes i JOIN tables_catalog t USING ({TABLE}) JOIN isize z USING ({INDEX})
WHERE i.is_primary_key = 1 AND i.index_id <> 1 AND t.is_ms_shipped = 0""")

USAGE = ("user_seeks", "user_scans", "user_lookups", "user_updates",
         "last_user_seek", "last_user_scan", "last_user_lookup", "last_user_update")
oracle("unused_indexes", f"{FP_VIEWS} index_usage", f"""{FINGERPRINTS}
SELECT {SRV_DB}, schema_name, table_name, index_name, {names(*USAGE)}, index_size_mb AS size_mb, columns_key,
  columns_included, 'DROP INDEX ' || {bracket('index_name')} || ' ON ' || {bracket('schema_name')} || '.'
    || {bracket('table_name')} || ';' AS cmd_drop
FROM fp JOIN index_usage u USING ({INDEX})
WHERE user_seeks = 0 AND user_scans = 0 AND user_lookups = 0 AND is_primary_key = 0 AND is_unique = 0
  AND index_id > 1""")
oracle("index_columns_search", f"{CATALOG} types", f"""
SELECT i.server_name, i.database_name, t.name AS table_name, i.index_id, i.name AS index_name, i.type_desc,
  i.is_primary_key, i.is_unique, c.name AS column_name, c.is_nullable, c.is_identity, y.name AS type_name,
  c.max_length, ic.index_column_id, ic.key_ordinal, ic.partition_ordinal, ic.is_included_column
FROM {IX_COL} JOIN indexes i ON {on_index('i', 'ic')}
  JOIN tables_catalog t ON {PLACE.format('t', 'i')} AND t.object_id = i.object_id
  JOIN types y ON y.system_type_id = c.system_type_id AND y.user_type_id = c.user_type_id
WHERE t.name ILIKE '%reservation_%'""")
oracle("index_usage_search", "indexes index_usage tables_catalog", f"""
SELECT i.server_name, i.database_name, t.name AS table_name, i.index_id, i.name AS index_name, i.type_desc,
  i.is_primary_key, i.is_unique, {names(*[f'u.{c}' for c in USAGE])}
FROM index_usage u JOIN indexes i USING ({INDEX}) JOIN tables_catalog t USING ({TABLE})
WHERE lower(t.name) LIKE '%reservation%'""")
oracle("index_columns_outer", CATALOG, f"""
SELECT i.server_name, i.database_name, {FULL_NAME} AS table_name, i.index_id, i.name AS index_name, i.type_desc,
  i.is_primary_key, i.is_unique, x.column_name, x.is_nullable, x.is_identity
FROM indexes i JOIN tables_catalog t USING ({TABLE})
  LEFT JOIN (SELECT ic.*, c.name AS column_name, c.is_nullable, c.is_identity FROM {IX_COL}) x
    ON {on_index('x', 'i')}""")

COMPRESSED = """CASE WHEN {list} IS NOT NULL THEN 'DATA_COMPRESSION = {kind} '
  || CASE WHEN ps.name IS NULL THEN '' ELSE ' ON PARTITIONS (' || {list} || ')' END END"""
oracle("index_definition", f"{CATALOG} index_usage partitions partition_stats partition_schemes partition_functions "
       "filegroups", f""", defs AS (
  SELECT ic.server_name, ic.database_name, ic.object_id, ic.index_id,
    {listed(bracket('c.name') + " || CASE ic.is_descending_key WHEN 1 THEN ' DESC' ELSE '' END", 'ic.key_ordinal',
            'ic.key_ordinal > 0')} AS keylist,
    {listed(bracket('c.name'), 'c.name', 'ic.is_included_column = 1')} AS inclist,
    max(CASE WHEN ic.partition_ordinal = 1 THEN {bracket('c.name')} END) AS pcol
  FROM {IX_COL} GROUP BY 1, 2, 3, 4),
figs AS (
  SELECT p.server_name, p.database_name, p.object_id, p.index_id,
    {half_up('sum(s.in_row_reserved_page_count) * 8', '1048576', 1)} AS in_row,
    {half_up('sum(s.lob_reserved_page_count) * 8', '1048576', 1)} AS lob, {big('sum(s.row_count)')} AS row_count,
    count(s.partition_id) AS n, {listed('CAST(p.partition_number AS VARCHAR)', 'p.partition_number',
                                        'p.data_compression = 1')} AS rowlist,
    {listed('CAST(p.partition_number AS VARCHAR)', 'p.partition_number', 'p.data_compression = 2')} AS pagelist
  FROM partitions p LEFT JOIN partition_stats s ON {PLACE.format('s', 'p')} AND s.partition_id = p.partition_id
  GROUP BY 1, 2, 3, 4)
SELECT i.server_name, i.database_name, {FULL_NAME} AS table_name,
  greatest(u.last_user_seek, u.last_user_scan, u.last_user_lookup) AS last_user_read, u.last_user_update,
  CASE WHEN i.index_id = 0 THEN '/* No create statement (Heap) */' ELSE
    CASE WHEN i.is_primary_key = 1
      THEN 'ALTER TABLE ' || {bracket('t.schema_name')} || '.' || {bracket('t.name')} || ' ADD CONSTRAINT '
        || {bracket('i.name')} || ' PRIMARY KEY ' || CASE WHEN i.index_id > 1 THEN 'NONCLUSTERED ' ELSE 'CLUSTERED ' END
      ELSE 'CREATE ' || CASE WHEN i.is_unique = 1 THEN 'UNIQUE ' ELSE '' END
        || CASE WHEN i.index_id > 1 THEN 'NONCLUSTERED ' ELSE 'CLUSTERED ' END || 'INDEX ' || {bracket('i.name')}
        || ' ON ' || {bracket('t.schema_name')} || '.' || {bracket('t.name')} || ' ' END
    || '(' || keylist || ')' || coalesce(' INCLUDE (' || inclist || ')', '')
    || coalesce(' WHERE ' || i.filter_definition, '')
    || coalesce(' WITH (' || nullif(concat_ws(', ', {COMPRESSED.format(list='rowlist', kind='ROW')},
         {COMPRESSED.format(list='pagelist', kind='PAGE')}), '') || ')', '')
    || ' ON '
    || CASE WHEN ps.name IS NULL THEN coalesce({bracket('fg.name')}, '') ELSE ps.name || ' (' || pcol || ')' END
    || ';' END AS index_create_statement,
  i.index_id, i.name AS index_name, f.in_row AS reserved_in_row_gb, f.lob AS reserved_lob_gb, f.row_count,
  u.user_seeks, u.user_scans, u.user_lookups, u.user_updates AS queries_that_modified,
  coalesce(f.n, 0) AS partition_count, i.allow_page_locks, i.allow_row_locks, i.is_hypothetical, i.has_filter,
  i.fill_factor, i.is_unique, coalesce(pf.name, '/* Not partitioned */') AS partition_function,
  coalesce(ps.name, fg.name) AS partition_scheme_or_filegroup, t.create_date AS table_created_date,
  t.modify_date AS table_modify_date
FROM indexes i JOIN tables_catalog t USING ({TABLE}) LEFT JOIN index_usage u ON {on_index('u', 'i')}
  LEFT JOIN defs d ON {on_index('d', 'i')} LEFT JOIN figs f ON {on_index('f', 'i')}{SPACES}
WHERE i.type < 3""")

oracle("file_space", "files", f""", f AS (
  SELECT server_name, database_name, file_name, substr(physical_name, 1, 1) AS drive, size_pages // 128 AS size_mb,
    used_pages // 128 AS space_used_mb, (size_pages - used_pages) // 128 AS free_mb FROM files)
SELECT *, {pct('space_used_mb', 'size_mb', 2)} AS percent_space_used, {pct('free_mb', 'size_mb', 2)} AS percent_free
FROM f""")

# --------------------------------------------------------------------------------------------------- buffer cache
B = q.SHARED_BUFFERS
CACHED = (f"n * 8192 AS buffered_bytes, {pretty('n * 8192')} AS buffered, "
          f"{pct('n', str(B), 1)} AS buffers_percent")
REL = "server_name, database_name, relfilenode"
COUNTED = f"""rn AS (
  SELECT {REL}, r.nspname, r.relname, r.relation_bytes, r.table_bytes, count(*) AS n
  FROM buffer_pages p JOIN relations r USING ({REL}) GROUP BY ALL)"""


def top(n: int, tie: str) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY {SRV_DB} ORDER BY n DESC, {tie}) <= {n}"


oracle("cache_by_relation", "buffer_pages relations", f""", {COUNTED}
SELECT {SRV_DB}, relname, {CACHED}, {pct('n * 8192', 'table_bytes', 1)} AS percent_of_relation
FROM rn {top(10, 'relname, relfilenode')}""")
oracle("cache_by_relation_nonempty", "buffer_pages relations", f""", {COUNTED}
SELECT {SRV_DB}, nspname, relname, {CACHED}, {pct('n * 8192', 'relation_bytes', 1)} AS percent_of_relation
FROM rn WHERE relation_bytes > 0 {top(10, 'relname, relfilenode')}""")
oracle("cache_usage_count", "buffer_pages relations", f"""
SELECT {SRV_DB}, relname, usagecount, count(*) AS buffers FROM buffer_pages JOIN relations USING ({REL})
GROUP BY ALL""")
oracle("cache_top_relations", "buffer_pages relations", f""", c AS (
  SELECT {SRV_DB}, relname, count(*) AS n FROM buffer_pages JOIN relations USING ({REL}) GROUP BY ALL)
SELECT {SRV_DB}, relname, n AS buffers FROM c {top(20, 'relname')}""")
oracle("cache_usage_dirty", "buffer_pages", """
SELECT server_name, usagecount, isdirty, count(*) AS buffers FROM buffer_pages GROUP BY ALL""")
PER_DB = f"dbn AS (SELECT {SRV_DB}, count(*) AS n FROM buffer_pages GROUP BY ALL)"
oracle("cache_by_database", "buffer_pages", f", {PER_DB} SELECT {SRV_DB}, {CACHED} FROM dbn")
oracle("cache_by_database_ratio", "buffer_pages database_sizes", f""", {PER_DB}
SELECT {SRV_DB}, {CACHED}, database_bytes, {pretty('database_bytes')} AS database_size,
  {pct('n * 8192', 'database_bytes', 1)} AS percent_database_in_cache
FROM dbn LEFT JOIN database_sizes USING ({SRV_DB})""")
SHARE = (f"{SRV_DB}, nspname, relname, {CACHED}, {pct('n * 8192', 'relation_bytes', 1)} AS percent_of_relation, "
         f"{pct('n * 8192', 'database_bytes', 1)} AS percent_of_total_database_size")
oracle("cache_share_total", "buffer_pages relations database_sizes", f""", {COUNTED}, t AS (
  SELECT {SRV_DB}, count(*) AS total FROM buffer_pages GROUP BY ALL)
SELECT {SHARE}, {pct('n', 'total', 1)} AS percent_database_in_cache
FROM rn JOIN t USING ({SRV_DB}) LEFT JOIN database_sizes USING ({SRV_DB})
WHERE relation_bytes > 0 {top(10, 'nspname, relname, relfilenode')}""")
oracle("cache_share_window", "buffer_pages relations database_sizes", f""", {COUNTED}, w AS (
  SELECT *, sum(n) OVER (PARTITION BY {SRV_DB}) AS total FROM rn WHERE relation_bytes > 0)
SELECT {SHARE}, {pct('n', 'total', 1)} AS percent_database_in_cache
FROM w LEFT JOIN database_sizes USING ({SRV_DB}) {top(10, 'nspname, relname, relfilenode')}""")

# ---------------------------------------------------------------------------------- sizes, bloat, sessions, ratios
oracle("tablespace_sizes", "tablespaces", f"""
SELECT *, {pretty('size_bytes')} AS size FROM tablespaces""")
oracle("schema_privileges", "namespaces", f"""
SELECT {SRV_DB}, nspname AS name, owner, nspacl[1] || chr(10) || nspacl[2] AS access_privileges, description FROM namespaces
WHERE nspname NOT LIKE 'pg\\_%' ESCAPE '\\' AND nspname <> 'information_schema'""")
oracle("capture_status", "capture_sessions capture_targets", """
SELECT s.server_name, s.name, s.total_buffer_size // 1048576 AS total_buffer_size_mb, s.buffer_policy_desc, t.target_name,
  t.target_data, s.flag_desc, s.dropped_event_count, s.dropped_buffer_count, s.session_source
FROM capture_sessions s, capture_targets t
WHERE s.server_name = t.server_name AND s.address = t.event_session_address AND s.name = 'queries'""")
oracle("relation_disk_usage", "relations", f"""
SELECT {SRV_DB}, nspname, relname, relation_bytes, {pretty('relation_bytes')} AS size FROM relations
WHERE nspname <> 'pg_catalog' AND nspname <> 'information_schema'
QUALIFY row_number() OVER (PARTITION BY {SRV_DB} ORDER BY relation_bytes DESC, nspname, relname) <= 30""")
oracle("relation_size_split", "relations", f"""
SELECT {SRV_DB}, nspname, relname, relkind, total_bytes, {pretty('total_bytes')} AS total_size,
  {pretty('relation_bytes')} AS relation_size, {pretty('total_bytes - relation_bytes')} AS index_size FROM relations
QUALIFY row_number() OVER (PARTITION BY {SRV_DB} ORDER BY total_bytes DESC, nspname, relname) <= 10""")
oracle("database_size", "database_sizes", f"""
SELECT {SRV_DB}, database_bytes, {pretty('database_bytes')} AS size FROM database_sizes""")
oracle("size_pretty", "relations", f"""
SELECT {SRV_DB}, relname, relation_bytes, total_bytes, {pretty('relation_bytes')} AS relation_size,
  {pretty('total_bytes')} AS total_size FROM relations""")
oracle("table_row_counts", "", " UNION ALL ".join(
    f"SELECT '{t}' AS tablename, count(*) AS nb_tuples FROM {t}" for t in BASE_TABLES))

OWNED = "server_name, database_name, schemaname, tablename"
oracle("index_bloat", "index_pages column_stats", f""", k AS (
  SELECT *, unnest(string_split(key_columns, ' ')) AS attname FROM index_pages
  WHERE access_method = 'btree' AND relkind = 'r' AND relpages > 0 AND NOT starts_with(tablename, 'pg_')),
s AS (
  SELECT k.server_name, k.database_name, k.schemaname, k.tablename, k.indexname, k.reltuples, k.relpages,
    CASE WHEN max(coalesce(c.null_frac, 0)) = 0 THEN 2 ELSE 6 END AS hdr,
    sum((1 - coalesce(c.null_frac, 0)) * coalesce(c.avg_width, 1024)) AS w, bool_or(c.type_name = 'name') AS is_na
  FROM k JOIN column_stats c ON c.server_name = k.server_name AND c.database_name = k.database_name
    AND c.schemaname = k.schemaname AND c.attname = k.attname
    AND (c.tablename = k.tablename OR c.tablename = k.indexname)
  GROUP BY ALL),
wd AS (SELECT *, hdr + (8 - hdr) + w + CASE WHEN w = 0 THEN 8
    ELSE (8 - CAST(round_even(w, 0) AS BIGINT) % 8) % 8 END AS width FROM s),
e AS (SELECT *, CAST(coalesce(1 + ceil(reltuples / floor(8152 / (4 + width))), 0) AS BIGINT) AS est FROM wd)
SELECT {OWNED}, indexname, CAST(8192 AS BIGINT) * relpages AS real_bytes, 8192 * est AS estimated_bytes,
  8192 * (relpages - est) AS bloat_bytes, {pretty('8192 * relpages')} AS real_size,
  {pretty('8192 * est')} AS estimated_size, {pretty('8192 * (relpages - est)')} AS bloat_size,
  {half_up('100 * (relpages - est)', 'relpages', 1)} AS bloat_ratio, is_na
FROM e""")

oracle("table_bloat", "column_stats table_pages index_pages", f""", s AS (
  SELECT {OWNED}, sum((1 - null_frac) * avg_width) AS w, max(null_frac) AS mx,
    24 + count(*) FILTER (WHERE null_frac <> 0) // 8 AS nh
  FROM column_stats GROUP BY ALL),
h AS (SELECT *, w + 23 + 1 AS dh, mx * (nh + (4 - nh % 4) % 4) AS nh2 FROM s),
j AS (
  SELECT {OWNED}, t.reltuples, t.relpages,
    CAST(ceil(t.reltuples * (dh + CASE WHEN dh % 4 = 0 THEN 0 ELSE 4 - dh % 4 END + nh2 + 4) / 8172e0) AS BIGINT)
      AS otta,
    coalesce(i.indexname, '?') AS iname, CAST(coalesce(i.reltuples, 0) AS BIGINT) AS ituples,
    CAST(coalesce(i.relpages, 0) AS BIGINT) AS ipages,
    CAST(coalesce(ceil(i.reltuples * (dh - 12) / 8172e0), 0) AS BIGINT) AS iotta
  FROM h JOIN table_pages t USING ({OWNED}) LEFT JOIN index_pages i USING ({OWNED}))
SELECT {OWNED}, CAST(reltuples AS BIGINT) AS reltuples, CAST(relpages AS BIGINT) AS relpages, otta,
  CASE WHEN otta = 0 OR otta IS NULL THEN 0e0 ELSE {half_up('relpages', 'otta', 1)} END AS tbloat,
  relpages - otta AS wasted_pages, 8192 * (relpages - otta) AS wasted_bytes,
  {pretty('8192 * (relpages - otta)')} AS wasted_size, iname, ituples, ipages, iotta,
  CASE WHEN iotta = 0 OR ipages = 0 THEN 0e0 ELSE {half_up('ipages', 'iotta', 1)} END AS ibloat,
  greatest(ipages - iotta, 0) AS wasted_ipages, 8192 * greatest(ipages - iotta, 0) AS wasted_ibytes,
  {pretty('8192 * greatest(ipages - iotta, 0)')} AS wasted_isize
FROM j WHERE relpages - otta > 0 OR ipages - iotta > 10""")

oracle("statement_top", "statements", """
SELECT server_name, total_time / 1000 / 60 AS total_min, total_time / calls AS avg_ms, stddev_time, calls, query
FROM statements QUALIFY row_number() OVER (PARTITION BY server_name ORDER BY total_time DESC, query) <= 100""")

LOCKS = """
SELECT l.server_name, l.database_name, l.pid, l.locktype, l.virtualtransaction, l.transactionid, r.nspname, r.relname,
  l.mode, l.granted, date_trunc('second', s.query_start) AS query_start, substr(s.query, 1, 60) AS query
FROM locks l LEFT JOIN relations r ON r.server_name = l.server_name AND r.database_name = l.database_name
  AND r.relfilenode = l.relation
  {0} JOIN sessions s ON s.server_name = l.server_name AND s.pid = l.pid
WHERE l.pid <> 17"""
oracle("lock_activity", "locks relations sessions", LOCKS.format("LEFT"))
oracle("lock_activity_inner", "locks relations sessions", LOCKS.format("INNER"))
oracle("session_counts", "sessions", """
SELECT server_name, 'total' AS kind, NULL AS name, count(*) AS sessions FROM sessions GROUP BY 1
UNION ALL SELECT server_name, 'database', database_name, count(*) FROM sessions GROUP BY 1, 3
UNION ALL SELECT server_name, 'state', state, count(*) FROM sessions GROUP BY 1, 3""")
oracle("connection_headroom", "sessions settings connection_limits", """
, u AS (SELECT server_name, database_name, count(*) AS n FROM sessions GROUP BY 1, 2)
SELECT l.server_name, l.database_name, coalesce(u.n, 0) AS sessions, l.datconnlimit,
  CASE WHEN l.datconnlimit <> -1 THEN l.datconnlimit - coalesce(u.n, 0) END AS database_headroom,
  CAST(m.setting AS BIGINT) AS max_connections,
  CAST(m.setting AS BIGINT) - (SELECT count(*) FROM sessions s WHERE s.server_name = l.server_name) AS server_headroom
FROM connection_limits l LEFT JOIN u USING (server_name, database_name)
  LEFT JOIN settings m ON m.server_name = l.server_name AND m.name = 'max_connections'""")
oracle("long_sessions", "sessions", f"""
SELECT {SRV_DB}, pid, date_diff('second', query_start, TIMESTAMP '{q.SESSIONS_AS_OF}') AS age_sec, usename,
  substr(query, 1, 49) AS query, state, query_start
FROM sessions WHERE pid <> 17 AND state <> 'idle'""")
oracle("database_stats", "database_stats", f"""
SELECT {SRV_DB}, {pretty('size_bytes')} AS size,
  CASE WHEN blks_read > 0 THEN {pct('blks_hit', 'blks_hit + blks_read', 2)} END AS hit_ratio,
  date_diff('second', stats_reset, TIMESTAMP '{q.STATS_AS_OF}') AS stat_uptime_sec, temp_files,
  {pretty('temp_bytes')} AS temp_size, conflicts, deadlocks
FROM database_stats""")
oracle("database_hit_ratio", "database_stats stat_databases", f"""
SELECT {SRV_DB}, blks_read, blks_hit, {pct('blks_hit', 'blks_hit + blks_read', 2)} AS blks_hit_ratio
FROM database_stats JOIN (SELECT DISTINCT * FROM stat_databases) USING ({SRV_DB})""")
oracle("global_hit_ratio", "table_io", f""", g AS (
  SELECT {SRV_DB}, {big('sum(heap_blks_read)')} AS heap_read, {big('sum(heap_blks_hit)')} AS heap_hit
  FROM table_io GROUP BY ALL)
SELECT *, {pct('heap_hit', 'heap_hit + heap_read', 2)} AS hit_ratio FROM g""")


def four(kind: str) -> str:
    return " + ".join(f"coalesce({p}_blks_{kind}, 0)" for p in ("heap", "idx", "toast", "tidx"))


oracle("table_hit_ratio", "table_io", f""", r AS (
  SELECT {SRV_DB}, relname AS table_name, {four('read')} AS d, {four('hit')} AS c FROM table_io
  UNION ALL SELECT {SRV_DB}, 'all', {big(f"sum({four('read')})")}, {big(f"sum({four('hit')})")} FROM table_io
  GROUP BY 1, 2)
SELECT {SRV_DB}, table_name, d AS disk_hits, {pct('d', 'd + c', 2)} AS percent_disk_hits,
  {pct('c', 'd + c', 2)} AS percent_cache_hits, d + c AS total_hits FROM r WHERE d + c > 0""")
HEAP_READ, HEAP_HIT = "heap_blks_read + coalesce(idx_blks_read, 0)", "heap_blks_hit + coalesce(idx_blks_hit, 0)"
oracle("table_hit_ratio_simple", "table_io", f""", r AS (
  SELECT {SRV_DB}, schemaname, relname, {HEAP_READ} AS from_disk, {HEAP_HIT} AS from_cache,
    coalesce(idx_blks_read, 0) AS id, coalesce(idx_blks_hit, 0) AS ic FROM table_io
  UNION ALL SELECT {SRV_DB}, '-ALL-', '-ALL-', {big(f'sum({HEAP_READ})')}, {big(f'sum({HEAP_HIT})')},
    sum(coalesce(idx_blks_read, 0)), sum(coalesce(idx_blks_hit, 0)) FROM table_io GROUP BY 1, 2)
SELECT {SRV_DB}, schemaname, relname, from_disk, from_cache,
  {pct('from_cache', 'from_cache + from_disk', 2)} AS cache_hit_ratio, {pct('ic', 'ic + id', 2)} AS index_hit_ratio
FROM r""")
oracle("dead_tuple_ratio", "table_io", f"""
SELECT {SRV_DB}, schemaname, relname, n_live_tup, n_dead_tup,
  100 * n_dead_tup // nullif(n_dead_tup + n_live_tup, 0) AS vacuum_ratio,
  CASE WHEN n_live_tup > 0 AND 5 * n_dead_tup >= n_live_tup + n_dead_tup
    THEN 'WARNING - VACCUM Frequency could be low' END AS vacuum_warning, last_vacuum, last_autovacuum
FROM table_io""")
oracle("low_use_indexes", "index_scans", f"""
SELECT *, {pretty('size_bytes')} AS size FROM index_scans WHERE idx_scan < 101""")
oracle("read_throughput", "database_stats", f"""
SELECT {SRV_DB}, CASE WHEN sum(blk_read_time) > 0 THEN CAST(sum(blks_read) AS DOUBLE) / sum(blk_read_time) END
  AS blocks_per_ms
FROM database_stats GROUP BY ALL""")

# ------------------------------------------------------------------------------- streaming: the batch answer again
ORACLES["stream_counter_delta"] = ORACLES["io_counter_delta"]
ORACLES["stream_threshold_alert"] = ORACLES["io_threshold_alert"]
ORACLES["stream_wait_delta"] = ORACLES["wait_delta"]
oracle("stream_slow_events", "captured_events", f"{SHRED} AND {SLOW}")
ORACLES["stream_retention"] = ORACLES["retention_purge"]
oracle("history_compaction", "io_snapshots", " SELECT * FROM io_snapshots")

# A poll that comes after all others up to 15 is late for every key that has been seen in one of them.
TARDY = NUMBERED.format("io_snapshots") + f""", k AS (
SELECT c.*, c.poll = {q.LATE_POLL} AND EXISTS (SELECT 1 FROM n p WHERE p.server_name = c.server_name
  AND p.database_id = c.database_id AND p.file_id = c.file_id AND p.poll > {q.LATE_POLL} AND p.poll <= 15) AS late
FROM n c)"""
oracle("stream_late_snapshots", "io_snapshots", f"""{TARDY}
SELECT server_name, database_id, file_id, collect_date, poll AS snapshot_no, {names(*IO)} FROM k WHERE late""")
oracle("stream_deltas_routed", "io_snapshots", f"""{TARDY}, f AS (SELECT * FROM k WHERE NOT late)
SELECT {IO_DELTAS} {IO_PAIRS.replace("n c JOIN n p", "f c JOIN f p")} WHERE c.num_of_reads + c.num_of_writes > 0""")
ORACLES["stream_events_routed"] = ORACLES["stream_slow_events"]
ORACLES["stream_event_rejects"] = ORACLES["event_rejects"]
ORACLES["event_files"] = ORACLES["event_shred"]
ORACLES["event_file_rejects"] = ORACLES["event_rejects"]
ORACLES["stream_event_files"] = ORACLES["stream_slow_events"]


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)