"""Get-or-create of resources and scopes by the hash of what they say.

The attributes are written with sorted keys first, so that their order makes no other resource. An id is a hash
of the content hash, so it is the same in every run and needs no counter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for a missing resource and a missing scope.
UNKNOWN_RESOURCE, UNKNOWN_SCOPE = '{"service.name":"unknown"}', "unknown"


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("__", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def id_of(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def with_resource_hash(df: DataFrame) -> DataFrame:
    """Sets ``ResourceHash`` over ``ResourceSchemaUrl`` and ``ResourceAttributesJson``, a missing resource being
    the unknown one."""
    df = df.withColumn("ResourceAttributesJson", F.coalesce("ResourceAttributesJson", F.lit(UNKNOWN_RESOURCE)))
    return df.withColumn("ResourceHash", content_hash(F.col("ResourceSchemaUrl"), F.col("ResourceAttributesJson")))


def with_scope_hash(df: DataFrame) -> DataFrame:
    df = df.withColumn("ScopeName", F.coalesce("ScopeName", F.lit(UNKNOWN_SCOPE)))
    return df.withColumn("ScopeHash", content_hash(F.col("ScopeName"), F.col("ScopeVersion"), F.col("ScopeSchemaUrl"), F.col("ScopeAttributesJson")))


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row per key. Equal rows go first, by hash: keeping the first text of each key instead sorts all rows before the shuffle."""
    return rows.distinct().dropDuplicates([key])


def resources_of(df: DataFrame) -> DataFrame:
    """The distinct resources of rows with a resource hash."""
    rows = df.select("ResourceHash", F.col("ResourceSchemaUrl").alias("SchemaUrl"), F.col("ResourceAttributesJson").alias("AttributesJson"))
    return _one_each(rows, "ResourceHash").select(id_of(F.col("ResourceHash")).alias("Id"), "ResourceHash", "SchemaUrl", "AttributesJson")


def scopes_of(df: DataFrame) -> DataFrame:
    rows = df.select("ScopeHash", F.col("ScopeName").alias("Name"), F.col("ScopeVersion").alias("Version"), F.col("ScopeSchemaUrl").alias("SchemaUrl"), F.col("ScopeAttributesJson").alias("AttributesJson"))
    return _one_each(rows, "ScopeHash").select(id_of(F.col("ScopeHash")).alias("Id"), "Name", "Version", "SchemaUrl", "ScopeHash", "AttributesJson")


def new_rows(incoming: DataFrame, existing: DataFrame | None, key: str | list[str]) -> DataFrame:
    """Incoming rows, one per key, whose key the stored ones don't have."""
    keys = [key] if isinstance(key, str) else key
    one = incoming.dropDuplicates(keys)
    return one if existing is None else one.join(existing.select(*keys), keys, "left_anti")
