"""Replication health of availability groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.contracts import SERVER, check
from statloom.functions import seconds_between, whole_div
from statloom.functions.times import as_timestamp

GROUP = (*SERVER, "group_id")
GROUP_DATABASE = (*GROUP, "group_database_id")
GROUP_REPLICA = (*GROUP, "replica_id")
DAY_TIME = "dd MMM yyyy HH:mm:ss"


def _redo_seconds() -> Column:
    """Whole seconds to replay the redo queue; NULL unless the rate is positive."""
    return F.when(F.col("redo_rate") > 0, whole_div(F.col("redo_queue_size"), F.col("redo_rate")))


def _minutes(seconds: Column, kind: str) -> Column:
    return (seconds.cast("decimal(19,0)") / 60).cast(kind)


def replica_status(
    states: DataFrame, cluster_databases: DataFrame, groups: DataFrame, replicas: DataFrame,
) -> DataFrame:
    """One row per replica and database with names resolved and the estimated redo time in minutes."""
    check(states, "replica_states")
    check(cluster_databases, "cluster_databases")
    check(groups, "groups")
    check(replicas, "replicas")
    joined = (states
              .join(cluster_databases.select(*GROUP_DATABASE, "database_name"), list(GROUP_DATABASE))
              .join(groups.select(*GROUP, F.col("name").alias("ag_name")), list(GROUP))
              .join(replicas.select(*GROUP_REPLICA, "replica_server_name"), list(GROUP_REPLICA)))
    first = ["server_name", "replica_server_name", "database_name", "ag_name"]
    keys = {*GROUP_DATABASE, *GROUP_REPLICA, "database_id"}
    rest = [c for c in states.columns if c not in keys]
    return (joined.select(*first, *rest, _minutes(_redo_seconds(), "decimal(24,6)")
                          .alias("est_redo_completion_time_min"))
            .orderBy("server_name", "ag_name", "replica_server_name", "database_name"))


def replica_latency(states: DataFrame, as_of) -> DataFrame:
    """How far each replica is behind at ``as_of`` and when its redo queue should be empty.

    Only replicas that ever replayed something are listed. The completion time adds whole minutes.
    """
    check(states, "replica_states")
    now = as_timestamp(as_of)
    behind = seconds_between(F.col("last_commit_time"), now)
    redo = _redo_seconds()
    done = F.timestamp_add("MINUTE", whole_div(redo, 60).cast("int"), now)
    text = F.concat(whole_div(behind, 3600).cast("string"), F.lit(" hour(s), "),
                    whole_div(behind % 3600, 60).cast("string"), F.lit(" min, "),
                    (behind % 60).cast("string"), F.lit(" sec"))
    return (states.filter(F.col("last_redone_time").isNotNull())
            .select("server_name", "group_id", "database_id", "replica_id",
                    F.date_format("last_commit_time", DAY_TIME).alias("last_commit_time"),
                    text.alias("time_behind_primary"), behind.alias("time_behind_primary_sec"),
                    "log_send_queue_size", "redo_queue_size", "redo_rate",
                    F.date_format(done, DAY_TIME).alias("estimated_completion_time"),
                    _minutes(redo, "decimal(10,2)").alias("estimated_recovery_time_minutes"),
                    redo.alias("estimated_recovery_time_seconds"),
                    F.date_format(now, DAY_TIME).alias("current_time"),
                    "synchronization_health_desc", "synchronization_state_desc"))


def group_mode(groups: DataFrame, replicas: DataFrame, group_states: DataFrame) -> DataFrame:
    """Replicas of every group with their modes; the primary of a group comes first."""
    check(groups, "groups")
    check(replicas, "replicas")
    check(group_states, "group_states")
    is_primary = F.when(F.col("primary_replica") == F.col("replica_server_name"), 1).otherwise(0)
    return (replicas
            .join(groups.select(*GROUP, F.col("name").alias("ag_name")), list(GROUP))
            .join(group_states.select(*GROUP, "primary_replica"), list(GROUP))
            .select("server_name", "ag_name", "replica_server_name", is_primary.alias("is_primary_server"),
                    F.col("availability_mode").alias("synchronous"),
                    F.col("secondary_role_allow_connections_desc").alias("readable_secondary"),
                    "failover_mode_desc")
            .orderBy("server_name", "ag_name", F.col("is_primary_server").desc(), "replica_server_name"))


def _seconds_to_drain(queue: str, rate: str) -> Column:
    """Queue over rate in seconds; −1 when either is unknown or nothing moves."""
    ratio = F.col(queue).cast("double") / F.nullif(F.col(rate), F.lit(0)).cast("double")
    return F.coalesce(ratio, F.lit(-1.0))


def replica_dashboard(
    groups: DataFrame,
    replicas: DataFrame,
    cluster_states: DataFrame,
    states: DataFrame,
    roles: DataFrame,
    ag_name: str | None = None,
) -> DataFrame:
    """28 columns per replica and database: data loss, recovery and synchronisation estimates, missing values filled.

    ``ag_name`` restricts the report to one group and raises ``ValueError`` if there is none of that name (the only
    eager step, a one-row lookup). The primary's last commit is looked up by server, group and database, so that
    database ids that repeat in another group cannot multiply rows.
    """
    check(groups, "groups")
    check(replicas, "replicas")
    check(cluster_states, "cluster_states")
    check(states, "replica_states")
    check(roles, "replica_roles")
    if ag_name is not None:
        groups = groups.filter(F.col("name") == ag_name)
        if groups.isEmpty():
            raise ValueError(f"no availability group named {ag_name!r}")

    primaries = roles.filter(F.col("role") == 1).select(*SERVER, "replica_id")
    primary_commit = (states.join(primaries, [*SERVER, "replica_id"], "left_semi")
                      .select(*GROUP, "database_id", F.col("last_commit_time").alias("_primary_commit")))
    local = (states.withColumnRenamed("is_local", "_state_is_local")
             .join(primary_commit, [*GROUP, "database_id"], "left"))
    joined = (replicas.join(groups.select(*GROUP, "name"), list(GROUP))
              .join(cluster_states.select(*SERVER, "replica_id", "group_database_id", "database_name",
                                          "is_database_joined", "is_failover_ready"), [*SERVER, "replica_id"])
              .join(local.drop("group_id"), [*SERVER, "replica_id", "group_database_id"], "left")
              .join(roles.select(*SERVER, "replica_id", "role_desc", F.col("is_local").alias("_role_is_local")),
                    [*SERVER, "replica_id"]))

    never = F.lit("1900-01-01").cast(states.schema["last_commit_time"].dataType)

    def filled(name: str, default) -> Column:
        default = default if isinstance(default, Column) else F.lit(default)
        return F.coalesce(F.col(name), default)

    loss = F.when(F.col("is_failover_ready") == 1, F.lit(0)).otherwise(
        F.coalesce(seconds_between(F.col("last_commit_time"), F.col("_primary_commit")), F.lit(0)))
    return joined.select(
        "server_name",
        F.col("name").alias("availability_group_name"),
        F.col("replica_server_name").alias("availability_replica_server_name"),
        F.col("database_name").alias("availability_database_name"),
        filled("is_failover_ready", 0).alias("is_failover_ready"),
        filled("role_desc", "3").alias("replica_role"),
        F.col("availability_mode_desc").alias("availability_mode"),
        loss.cast("bigint").alias("estimated_data_loss_sec"),
        _seconds_to_drain("redo_queue_size", "redo_rate").alias("estimated_recovery_time_sec"),
        filled("is_suspended", 0).alias("is_suspended"),
        filled("suspend_reason_desc", "-").alias("suspend_reason"),
        filled("synchronization_state_desc", "0").alias("synchronization_state"),
        filled("last_received_time", never).alias("last_received_time"),
        filled("last_redone_time", never).alias("last_redone_time"),
        filled("last_sent_time", never).alias("last_sent_time"),
        filled("log_send_queue_size", -1).alias("log_send_queue_size"),
        filled("log_send_rate", -1).alias("log_send_rate_kb_sec"),
        filled("redo_queue_size", -1).alias("redo_queue_size_kb"),
        filled("redo_rate", -1).alias("redo_rate_kb_sec"),
        _seconds_to_drain("log_send_queue_size", "log_send_rate").alias("synchronization_performance"),
        filled("filestream_send_rate", -1).alias("filestream_send_rate"),
        filled("is_database_joined", 0).alias("is_joined"),
        F.col("_role_is_local").alias("is_local"),
        filled("last_commit_lsn", 0).alias("last_commit_lsn"),
        filled("last_commit_time", never).alias("last_commit_time"),
        filled("last_hardened_lsn", 0).alias("last_hardened_lsn"),
        filled("last_hardened_time", never).alias("last_hardened_time"),
        filled("last_received_lsn", 0).alias("last_received_lsn"),
        filled("last_redone_lsn", 0).alias("last_redone_lsn"),
    ).orderBy("server_name", "availability_replica_server_name", "availability_database_name")


def last_log_backup(databases: DataFrame, backups: DataFrame, states: DataFrame) -> DataFrame:
    """Latest log backup of every database not in the SIMPLE recovery model, and whether it is in a group.

    Databases never backed up stay with NULL. Backups are reduced to one time per database before the join.
    """
    check(databases, "databases")
    check(backups, "backupset")
    latest = (backups.filter(F.col("type") == "L").groupBy("server_name", F.col("database_name").alias("name"))
              .agg(F.max("backup_finish_date").alias("last_backup_log")))
    grouped = states.select("server_name", "database_id").distinct().withColumn("_in_group", F.lit(True))
    return (databases.filter(F.col("recovery_model_desc") != "SIMPLE")
            .join(latest, ["server_name", "name"], "left")
            .join(grouped, ["server_name", "database_id"], "left")
            .select("server_name", F.col("name").alias("database_name"), "last_backup_log", "recovery_model_desc",
                    "state_desc", F.when(F.col("_in_group"), "AAG").otherwise("STANDALONE").alias("hadr")))
