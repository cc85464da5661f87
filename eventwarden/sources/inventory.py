"""Host and account inventory discovered from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults and name hints of discovered entities.
DEFAULT_CRITICALITY = 3
PRIVILEGED_NAMES = ["root", "administrator", "admin"]


def guess_os(host: Column) -> Column:
    name = F.upper(host)
    return (
        F.when(name.startswith("WIN") | name.contains("WINDOWS"), "windows")
        .when(name.startswith("MAC") | name.contains("DARWIN"), "macos").otherwise("linux")
    )


def guess_user_type(user: Column) -> Column:
    name = F.lower(user)
    service = name.startswith("svc") | name.startswith("service") | name.startswith("sa-") | name.endswith("-svc") | name.endswith("$")
    cloud = name.startswith("arn:") | name.startswith("aws-") | name.startswith("role/") | name.contains("-admin")
    return F.when(service, "service").when(cloud, "cloud").otherwise("human")


def discover_hosts(events: DataFrame) -> DataFrame:
    seen = events.filter(F.col("host").isNotNull()).groupBy(F.col("host").alias("host_id")).agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    return seen.select(
        "host_id", F.col("host_id").alias("hostname"), guess_os(F.col("host_id")).alias("os_family"),
        F.lit(None).cast("string").alias("ip_address"), F.lit("unknown").alias("environment"),
        F.lit(DEFAULT_CRITICALITY).alias("criticality"), F.lit(False).alias("is_isolated"), "first_seen", "last_seen",
    )


def discover_users(events: DataFrame) -> DataFrame:
    seen = events.filter(F.col("user").isNotNull()).groupBy(F.col("user").alias("user_id")).agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    return seen.select(
        "user_id", F.col("user_id").alias("display_name"), guess_user_type(F.col("user_id")).alias("user_type"),
        F.lower("user_id").isin(PRIVILEGED_NAMES).alias("is_privileged"), F.lit(False).alias("is_disabled"),
        "first_seen", "last_seen",
    )


def upsert_inventory(known: DataFrame, discovered: DataFrame, key: str) -> DataFrame:
    """Known rows keep their attributes and widen their seen span; new entities are added."""
    fresh = discovered.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in discovered.columns if c != key])
    joined = known.join(fresh, key, "full_outer")
    columns = []
    for name in known.columns:
        if name == key:
            columns.append(F.col(key))
        elif name == "first_seen":
            columns.append(F.least("first_seen", "_first_seen").alias(name))
        elif name == "last_seen":
            columns.append(F.greatest("last_seen", "_last_seen").alias(name))
        else:
            columns.append(F.coalesce(F.col(name), F.col(f"_{name}")).alias(name))
    return joined.select(*columns)
