"""Input contracts: the columns each exported telemetry table must carry, checked when an operator is called.

The check reads only the analysed schema, so it costs no job. Extra columns are always allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SERVER = ("server_name",)
DATABASE = ("server_name", "database_name")
TABLE = (*DATABASE, "object_id")
INDEX = (*TABLE, "index_id")

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FAMILIES = {
    "text": (T.StringType, T.VarcharType, T.CharType),
    "int": _INTEGRAL,
    "number": (*_INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType),
    "time": (T.TimestampType, T.TimestampNTZType, T.DateType),
    "list": (T.ArrayType,),
    "flag": (T.BooleanType, *_INTEGRAL),
}

_IO = ("num_of_reads:int num_of_bytes_read:int io_stall_read_ms:int num_of_writes:int num_of_bytes_written:int"
       " io_stall_write_ms:int io_stall_ms:int")

INPUTS: dict[str, str] = {
    # counters and waits
    "virtual_file_stats": f"server_name:text database_id:int file_id:int {_IO}",
    "io_snapshots": f"server_name:text database_id:int file_id:int collect_date:time {_IO}",
    "files": "server_name:text database_id:int file_id:int database_name:text file_name:text type_desc:text"
             " physical_name:text",
    "file_sizes": "server_name:text database_id:int database_name:text file_name:text physical_name:text"
                  " size_pages:int used_pages:int",
    "wait_snapshots": "server_name:text wait_type:text collect_date:time waiting_tasks_count:int wait_time_ms:int"
                      " max_wait_time_ms:int signal_wait_time_ms:int",
    # events
    "captured_events": "object_name:text duration:int transaction_state:int",
    "event_documents": "object_name:text event_xml:text",
    "trace": "server_name:text database_name:text event_class:int file_name:text duration:int start_time:time"
             " end_time:time integer_data:int reads:int host_name:text",
    # replication
    "replica_states": "server_name:text group_id:int group_database_id:int replica_id:int database_id:int"
                      " last_commit_time:time redo_queue_size:int redo_rate:int",
    "groups": "server_name:text group_id:int name:text",
    "replicas": "server_name:text group_id:int replica_id:int replica_server_name:text",
    "cluster_databases": "server_name:text group_id:int group_database_id:int database_name:text",
    "group_states": "server_name:text group_id:int primary_replica:text",
    "replica_roles": "server_name:text replica_id:int role:int role_desc:text",
    "cluster_states": "server_name:text replica_id:int group_database_id:int database_name:text"
                      " is_database_joined:int is_failover_ready:int",
    # backups, jobs, principals
    "backupset": "server_name:text database_name:text type:text media_set_id:int backup_start_date:time"
                 " backup_finish_date:time compressed_backup_size:int",
    "backup_media": "server_name:text media_set_id:int logical_device_name:text physical_device_name:text",
    "databases": "server_name:text database_id:int name:text recovery_model_desc:text state_desc:text",
    "database_details": "server_name:text database_id:int name:text state_desc:text compatibility_level:int"
                        " is_read_only:flag create_date:time collation_name:text recovery_model_desc:text",
    "database_files": "server_name:text database_id:int type_desc:text size_pages:int",
    "jobs": "server_name:text job_id:int name:text enabled:flag date_created:time",
    "job_history": "server_name:text job_id:int run_date:int run_duration:int",
    "principals": "server_name:text database_name:text principal_id:int name:text",
    "permissions": "server_name:text database_name:text grantee_principal_id:int class_desc:text major_id:int"
                   " permission_name:text state_desc:text type:text",
    "role_members": "server_name:text database_name:text role_principal_id:int member_principal_id:int",
    # storage catalogs
    "tables": "server_name:text database_name:text object_id:int schema_name:text name:text is_ms_shipped:flag",
    "columns": "server_name:text database_name:text object_id:int column_id:int name:text system_type_id:int"
               " user_type_id:int max_length:int is_nullable:flag is_identity:flag",
    "types": "system_type_id:int user_type_id:int name:text",
    "indexes": "server_name:text database_name:text object_id:int index_id:int name:text type:int type_desc:text"
               " is_unique:flag is_primary_key:flag is_unique_constraint:flag",
    "index_columns": "server_name:text database_name:text object_id:int index_id:int column_id:int"
                     " index_column_id:int key_ordinal:int is_included_column:flag",
    "index_usage": "server_name:text database_name:text object_id:int index_id:int user_seeks:int user_scans:int"
                   " user_lookups:int user_updates:int last_user_seek:time last_user_scan:time"
                   " last_user_lookup:time last_user_update:time",
    "partitions": "server_name:text database_name:text object_id:int index_id:int hobt_id:int rows:int",
    "allocation_units": "server_name:text database_name:text container_id:int total_pages:int used_pages:int",
    "partition_stats": "server_name:text database_name:text object_id:int index_id:int reserved_page_count:int"
                       " used_page_count:int in_row_data_page_count:int lob_used_page_count:int"
                       " row_overflow_used_page_count:int row_count:int",
    "internal_tables": "server_name:text database_name:text object_id:int internal_type:int",
    # buffer cache, sizes, bloat, statistics
    "buffer_pages": "server_name:text database_name:text relfilenode:int usagecount:int isdirty:flag",
    "relations": "server_name:text database_name:text relfilenode:int nspname:text relname:text relation_bytes:int",
    "database_sizes": "server_name:text database_name:text database_bytes:int",
    "tablespaces": "server_name:text spcname:text location:text size_bytes:int",
    "namespaces": "server_name:text database_name:text nspname:text owner:text nspacl:list description:text",
    "capture_sessions": "server_name:text address:int name:text total_buffer_size:int buffer_policy_desc:text"
                        " flag_desc:text dropped_event_count:int dropped_buffer_count:int session_source:text",
    "capture_targets": "server_name:text event_session_address:int target_name:text target_data:text",
    "column_stats": "server_name:text database_name:text schemaname:text tablename:text attname:text"
                    " null_frac:number avg_width:int",
    "index_pages": "server_name:text database_name:text schemaname:text tablename:text indexname:text"
                   " reltuples:number relpages:int",
    "table_pages": "server_name:text database_name:text schemaname:text tablename:text reltuples:number relpages:int",
    "statements": "server_name:text query:text calls:int total_time:number stddev_time:number",
    "sessions": "server_name:text database_name:text pid:int state:text query_start:time query:text",
    "locks": "server_name:text database_name:text pid:int locktype:text relation:int mode:text granted:flag"
             " virtualtransaction:text",
    "database_stats": "server_name:text database_name:text blks_read:int blks_hit:int",
    "table_io": "server_name:text database_name:text schemaname:text relname:text heap_blks_read:int"
                " heap_blks_hit:int idx_blks_read:int idx_blks_hit:int",
    "table_tuples": "server_name:text database_name:text schemaname:text relname:text n_live_tup:int n_dead_tup:int",
    "index_scans": "server_name:text database_name:text schemaname:text relname:text indexrelname:text idx_scan:int"
                   " idx_tup_read:int idx_tup_fetch:int size_bytes:int",
}


def check(df: DataFrame, name: str) -> DataFrame:
    """Return ``df`` if it carries every column of contract ``name`` with a fitting type, else raise ``ValueError``."""
    have = {f.name.lower(): f.dataType for f in df.schema.fields}
    problems = []
    for item in INPUTS[name].split():
        column, family = item.split(":")
        kind = have.get(column)
        if kind is None:
            problems.append(f"missing column {column}")
        elif not isinstance(kind, (*_FAMILIES[family], T.NullType)):
            problems.append(f"column {column} is {kind.simpleString()}, expected {family}")
    if problems:
        raise ValueError(f"input '{name}': " + "; ".join(problems))
    return df
