"""Tenants, default paths and the organisation rows a user still needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizgrove.functions import paths


def home_paths(users: DataFrame, user_org: DataFrame, orgs: DataFrame) -> DataFrame:
    """Per user: shortest organisation path, tenant and default path."""
    # Distinct pairs first: a user or an organisation listed many times travels once.
    placed = user_org.select("user_id", "org_id").distinct().join(orgs.select("org_id", "org_path"), "org_id")
    shortest = placed.groupBy("user_id").agg(
        F.min(F.struct(F.octet_length("org_path").alias("size"), F.col("org_path"))).getField("org_path").alias("home_path")
    )
    known = orgs.select(F.col("org_path").alias("school_path")).distinct().withColumn("known", F.lit(True))
    return (
        users.select("user_id")
        .join(shortest, "user_id", "left")
        .withColumn("tenant", F.coalesce(paths.tenant(F.col("home_path")), paths.fallback_tenant(F.col("user_id"))))
        .withColumn("school_path", paths.leading(F.col("home_path"), 2))
        .join(known, "school_path", "left")
        .select(
            "user_id",
            "home_path",
            "tenant",
            F.when(F.col("known"), F.col("school_path")).otherwise(F.col("tenant")).alias("default_path"),
        )
    )


def missing_nodes(homes: DataFrame, user_org: DataFrame, orgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Organisation and membership rows to insert so that every user has a tenant and a private node."""
    roots = homes.filter(F.col("home_path").isNull()).select(
        "user_id",
        F.col("tenant").alias("org_id"),
        F.concat("tenant", F.lit("根")).alias("org_name"),
        F.col("tenant").alias("org_path"),
    )
    private = homes.select(
        "user_id",
        paths.private_org_id(F.col("user_id")).alias("org_id"),
        F.lit("私有").alias("org_name"),
        paths.private_path(F.col("tenant"), F.col("user_id")).alias("org_path"),
    )
    wanted = roots.unionByName(private)
    org_rows = wanted.select("org_id", "org_name", "org_path").join(orgs.select("org_id"), "org_id", "left_anti")
    member_rows = wanted.select("user_id", "org_id", "org_path").join(
        user_org.select("user_id", "org_id"), ["user_id", "org_id"], "left_anti"
    )
    return org_rows, member_rows


def tenant_tree(tenants: DataFrame, orgs: DataFrame) -> DataFrame:
    """Organisations below each tenant: the slash-free path starts with the tenant text."""
    known = orgs.select("org_id", "org_name", "org_path")
    heads = F.explode(paths.prefixes(paths.path_key(F.col("org_path"), "compat"), "compat"))
    keyed = known.select(heads.alias("tenant"), "*")
    return tenants.select("tenant").distinct().join(keyed, "tenant")
