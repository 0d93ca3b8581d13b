"""Tenant isolation: every read goes through a context that filters rows, every write is checked against it."""

from __future__ import annotations

import uuid

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Roles by rank; any other role ranks below all of them.
RANKS = {"viewer": 0, "agent": 1, "admin": 2, "owner": 3}


@dataclass(frozen=True)
class TenantContext:
    """organization_id None without admin: no rows at all. admin: every row."""

    organization_id: int | None = None
    admin: bool = False

    def visible(self, df: DataFrame, column: str = "organization_id") -> DataFrame:
        if self.admin:
            return df
        return df.where(F.lit(False)) if self.organization_id is None else df.where(F.col(column) == self.organization_id)

    def checked(self, rows: DataFrame, column: str = "organization_id") -> DataFrame:
        """rows to be written; the job fails if one belongs to another tenant."""
        if self.admin:
            return rows
        mine = F.col(column).eqNullSafe(F.lit(self.organization_id))
        return rows.withColumn(column, F.when(mine, F.col(column)).otherwise(F.raise_error(F.lit("row of another tenant"))))


def rank(role: Column) -> Column:
    out = F.lit(-1)
    for name, value in RANKS.items():
        out = F.when(role == name, F.lit(value)).otherwise(out)
    return out


def at_least(role: Column, least: str) -> Column:
    return rank(role) >= RANKS[least]


#: The session variable that SQL users set to their organization.
TENANT = "tenant_id"


def tenant_views(spark: SparkSession, tables: dict[str, DataFrame], column: str = "organization_id") -> None:
    """Views under these names that show the rows of the organization in the session variable tenant_id, and none
    while it is null: SET VAR tenant_id = 3.

    The tables below them have names that cannot be guessed. A query keeps the organization that was set when it was
    made, whatever is set before it runs.
    """
    spark.sql(f"DECLARE OR REPLACE VARIABLE {TENANT} INT DEFAULT NULL")
    for name, rows in tables.items():
        hidden = f"rows_{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(hidden)
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT * FROM {hidden} WHERE {column} = session.{TENANT}")


def channel_function(spark: SparkSession, channels: str, name: str = "channel_by_key") -> None:
    """A SQL table function over a view of channels (id, kind, organization_id, config): those whose configuration
    has the value at the key; through a tenant's view, only the tenant's."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(path STRING, value STRING) RETURNS TABLE (id BIGINT, kind STRING, organization_id INT)
      RETURN SELECT id, kind, organization_id FROM {channels} WHERE get_json_object(config, '$.' || {name}.path) = {name}.value""")
