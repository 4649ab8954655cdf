"""Reports and batch control over sanitised tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import checks
from veilspark.operators.policy import category_col
from veilspark.sources.requests import parse_payload


def parse_requests(df: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """A2: (rows with a VARIANT ``payload``, rows whose text is no JSON even after repair)."""
    read = df.withColumn("payload", parse_payload(F.col(text_col)))
    return read.filter("payload is not null"), read.filter("payload is null").drop("payload")


def api_payload(body: Column) -> Column:
    """A5, API form: the body's ``payload`` if it has one, else the body."""
    return F.coalesce(F.try_variant_get(body, "$.payload", "variant"), body)


def exposed_only(entities: DataFrame) -> DataFrame:
    """Entities that carry a value rather than a mere mention."""
    return entities.filter("exposed")


def reliability_stats(sanitized: DataFrame) -> DataFrame:
    """Shares of requests that went out, and that the policy let pass but the leak check found
    values in, in percent (two decimals)."""
    percent = lambda c: F.round(100 * F.avg(c.cast("int")), 2)
    leaked = (F.col("leaks") > 0) & (F.col("action") != "BLOCKED_POLICY_VIOLATION")
    return sanitized.agg(percent(~F.col("blocked")).alias("success_rate"), percent(leaked).alias("leak_rate"))


def active_vaults(vault: DataFrame) -> DataFrame:
    """Number of requests with rows in the vault."""
    return vault.agg(F.count_distinct("request_id").alias("active_vaults"))


def detection_report(entities: DataFrame, key_cols: list[str]) -> DataFrame:
    """Different values per text with type, category, first place and number of places."""
    kind = category_col(F.col("pii_type"), F.col("category")).alias("category")
    return entities.select(*key_cols, "pii_type", kind, "value", "start").groupBy(*key_cols, "pii_type", "category", "value").agg(
        F.min("start").cast("long").alias("first_start"), F.count(F.lit(1)).alias("places"))


def restore_order(results: DataFrame, idx_col: str = "idx") -> DataFrame:
    """results in input order."""
    return results.orderBy(idx_col)


def slice_results(results: DataFrame, start: int, stop: int, idx_col: str = "idx") -> DataFrame:
    """results with start <= idx < stop."""
    return results.filter((F.col(idx_col) >= start) & (F.col(idx_col) < stop))


def batch_status(sanitized: DataFrame) -> DataFrame:
    """Adds success, error and error_type; failed rows stay in the table."""
    kinds = {"BLOCKED_POLICY_VIOLATION": "FirewallBlockedError", "BLOCKED_LEAKAGE_DETECTED": "PIILeakageDetectedError", "BLOCKED_INTERNAL_ERROR": "InternalError"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("action"))
    return sanitized.withColumns({"success": ~F.col("blocked"), "error": F.when(F.col("blocked"), F.col("block_reason")), "error_type": kind})


def batch_errors(status: DataFrame, key_col: str = "request_id") -> DataFrame:
    """The list of errors."""
    return status.filter("not success").select(key_col, "error_type", "error")


def stop_on_error(status: DataFrame) -> DataFrame:
    """The same rows; reading a failed one ends the job with its error."""
    failed = F.raise_error(F.concat(F.col("error_type"), F.lit(": "), F.col("error"))).cast("boolean")
    return status.filter(F.when(F.col("success"), F.lit(True)).otherwise(failed))


def payload_text(payload: Column) -> Column:
    """A payload as text."""
    return F.to_json(payload)


def payload_hash(payload: Column) -> Column:
    """I8: SHA-256 of the payload's text, empty if there is none."""
    return F.coalesce(F.sha2(payload_text(payload), 256), F.lit(""))


def round_ms(duration: Column) -> Column:
    """Durations to three decimals (rates take two)."""
    return F.round(duration, 3)


def check_column(df: DataFrame, col: str, kind: str) -> DataFrame:
    """Valid, invalid and null counts and the valid share of a column of card, Aadhaar, SSN or IP numbers."""
    value = F.col(col)
    ok = {
        "luhn": lambda: checks.luhn_ok(value), "verhoeff": lambda: checks.verhoeff_ok(value),
        "ssn": lambda: F.when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), checks.ssa_ok(*[F.try_element_at(F.split(value, "-"), F.lit(i)) for i in (1, 2, 3)])),
        "ip": lambda: F.when(value.rlike(r"^\d{1,9}(\.\d{1,9}){3}$"), checks.octets_ok(value)),
    }[kind]()
    ok = F.coalesce(ok, F.lit(False))
    return df.agg(
        F.count_if(value.isNotNull() & ok).alias("valid"), F.count_if(value.isNotNull() & ~ok).alias("invalid"),
        F.count_if(value.isNull()).alias("nulls"), F.round(F.avg(F.when(value.isNotNull(), ok.cast("double"))), 6).alias("valid_share"))
