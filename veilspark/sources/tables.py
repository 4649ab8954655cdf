"""Tables a job leaves behind: audit events, the vault, sanitised rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = (
    "ts timestamp, request_id string, tool_name string, action string, categories_detected map<string,bigint>, "
    "total_entities_secured bigint, overhead_ms double, verification_passed boolean, blocked boolean, error_type string, "
    "sanitized_payload_sha256 string"
)
VAULT_SCHEMA = "request_id string, pii_type string, value string, token string, client_id string, created_at timestamp, day date"


def write_audit(events: DataFrame, path: str) -> None:
    """Append audit events as JSON lines."""
    events.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def write_vault(vault: DataFrame, vault_root: str, sanitized_root: str) -> None:
    """A10: append vault rows, partitioned by day. The vault holds plain values, so it must not lie
    under the root of what is handed on (nor the other way round)."""
    a, b = (p.rstrip("/") + "/" for p in (vault_root, sanitized_root))
    if a.startswith(b) or b.startswith(a):
        raise ValueError("vault and sanitised rows need separate roots")
    vault.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(vault_root)


def read_vault(spark: SparkSession, vault_root: str, since: str | None = None) -> DataFrame:
    """The vault, of the days from ``since`` on (only their partitions are read)."""
    vault = spark.read.schema(VAULT_SCHEMA).parquet(vault_root)
    return vault.filter(F.col("day") >= F.to_date(F.lit(since))) if since else vault


def write_sanitized(sanitized: DataFrame, root: str, key_col: str = "request_id") -> None:
    """Rows that went out under ``good``, blocked ones, which carry no payload, under ``blocked``."""
    status = ["action", "counts", "total_detected", "verification_passed"]
    sanitized.filter("not blocked").select(key_col, "tool", "sanitized", *status).write.mode("append").parquet(f"{root}/good")
    sanitized.filter("blocked").select(key_col, "tool", "block_reason", *status).write.mode("append").parquet(f"{root}/blocked")
