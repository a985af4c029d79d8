"""Databases, permissions and roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.contracts import DATABASE, check
from statloom.functions import like_any_case, pages_to_mb

LAST_SYSTEM_DATABASE_ID = 4


def database_inventory(files: DataFrame, databases: DataFrame, skipped: str = "sysdba") -> DataFrame:
    """Size per database and file type with the state of the database; system databases and ``skipped`` left out.

    Files are summed per database and type first, so the join sees one row per database and type.
    """
    check(files, "database_files")
    check(databases, "database_details")
    sizes = (files.filter(F.col("database_id") > LAST_SYSTEM_DATABASE_ID)
             .groupBy("server_name", "database_id", "type_desc").agg(F.sum("size_pages").alias("_pages")))
    return (sizes.join(databases.filter(F.lower("name") != skipped.lower()), ["server_name", "database_id"])
            .select("server_name", F.col("name").alias("database_name"), "type_desc",
                    pages_to_mb(F.col("_pages")).alias("size_mb"), "state_desc", "compatibility_level",
                    "is_read_only", "create_date", "collation_name", "recovery_model_desc"))


def permission_report(
    permissions: DataFrame, principals: DataFrame, tables: DataFrame, schemas: DataFrame,
    principal: str | None = None,
) -> DataFrame:
    """Permissions of one principal (or all) with the name of what they apply to.

    Object permissions resolve to the object name and schema permissions to the schema name; others have none.
    """
    check(permissions, "permissions")
    check(principals, "principals")
    who = principals if principal is None else principals.filter(F.col("name") == principal)
    who = who.select(*DATABASE, F.col("principal_id").alias("grantee_principal_id"),
                     F.col("name").alias("principal_name"), "authentication_type_desc")
    named = (tables.select(*DATABASE, F.lit("object").alias("_kind"), F.col("object_id").cast("bigint").alias("_id"),
                           F.col("name").alias("object_name"))
             .unionByName(schemas.select(*DATABASE, F.lit("schema").alias("_kind"),
                                         F.col("schema_id").cast("bigint").alias("_id"),
                                         F.col("name").alias("object_name"))))
    kind = (F.when(like_any_case(F.col("class_desc"), "OBJECT%"), "object")
            .when(F.upper("class_desc") == "SCHEMA", "schema").otherwise("none"))
    # One left join on (kind, id): no NULL keys, so rows without a name do not pile up in one partition.
    return (permissions.withColumns({"_kind": kind, "_id": F.col("major_id").cast("bigint")})
            .join(who, [*DATABASE, "grantee_principal_id"])
            .join(named, [*DATABASE, "_kind", "_id"], "left")
            .select(*DATABASE, "principal_name", "authentication_type_desc", "object_name", "class_desc",
                    "permission_name", "state_desc", "type"))


def role_members(members: DataFrame, principals: DataFrame) -> DataFrame:
    """Role and member names: the membership table resolved twice against the principals."""
    check(members, "role_members")
    check(principals, "principals")
    roles = principals.select(*DATABASE, F.col("principal_id").alias("role_principal_id"), F.col("name").alias("role"))
    grantees = principals.select(*DATABASE, F.col("principal_id").alias("member_principal_id"),
                                 F.col("name").alias("member"))
    return (members.join(roles, [*DATABASE, "role_principal_id"])
            .join(grantees, [*DATABASE, "member_principal_id"])
            .select(*DATABASE, "role", "member"))
