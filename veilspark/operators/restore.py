"""Verify, restore, purge and audit jobs.

A vault is summed up to one row per request (token -> value and client), which is bounded by one
request, and joined once by request id; everything else happens inside the response's row, so a
response keeps its own text however many responses and leaves a request has. The same join works
for a stream of responses against a vault table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import fixed as X
from veilspark.functions.rewrite import token_pattern
from veilspark.functions.spans import let
from veilspark.session import ensure_checkpoint_dir


def vault_maps(vault: DataFrame, key_col: str = "request_id") -> DataFrame:
    """One row per request: ``__vault``, token -> (value, client). A token listed for several leaves counts once."""
    held = vault.groupBy(F.col("request_id").alias(key_col), "token").agg(F.min(F.struct("value", "client_id")).alias("v"))
    entry = F.struct("token", F.struct(F.col("v.value").alias("value"), F.col("v.client_id").alias("client")).alias("v"))
    return held.filter(F.col("token").isNotNull()).groupBy(key_col).agg(F.map_from_entries(F.collect_list(entry)).alias("__vault"))


def replaced(text: Column, vault: Column, pattern: str, client: Column | None) -> Column:
    """(restored, restored_count) of one text: known tokens of this client become their values."""

    def known(token: Column) -> Column:
        entry = F.element_at(vault, token)
        if client is None:
            return entry["value"]
        bound = entry["client"].isNull() | F.coalesce(F.lower(entry["client"]) == F.lower(client), F.lit(False))
        return F.when(bound, entry["value"])

    def rebuild(b: Column) -> Column:
        pieces = F.transform(b["tokens"], lambda t, i: F.concat(b["gaps"][i], F.coalesce(b["values"][i], t)))
        return F.struct(
            F.concat(F.array_join(pieces, ""), F.element_at(b["gaps"], -1)).alias("restored"),
            F.size(F.filter(b["values"], lambda v: v.isNotNull())).cast("long").alias("restored_count"))

    def look_up(b: Column) -> Column:
        values = F.transform(b["tokens"], known)
        return let(F.struct(b["tokens"].alias("tokens"), b["gaps"].alias("gaps"), values.alias("values")), rebuild)

    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    same = F.struct(text.alias("restored"), F.lit(0).cast("long").alias("restored_count"))
    found = let(F.struct(tokens.alias("tokens"), F.split(text, pattern, -1).alias("gaps")), look_up)
    return F.when(vault.isNotNull() & text.rlike(pattern), found).otherwise(same)


def restore_text(
    responses: DataFrame,
    vault: DataFrame,
    key_col: str = "request_id",
    text_col: str = "response",
    client_col: str | None = None,
    prefix: str = X.TOKEN_PREFIX,
    suffix: str = X.TOKEN_SUFFIX,
    allow_restoration: bool = True,
) -> DataFrame:
    """responses(key, text[, client]) + vault -> (..., restored, restored_count).

    Every response row is restored by itself. Unknown or foreign tokens stay as they are; a
    response whose request has no vault is returned unchanged with zero restored. With a client
    column, a value bound to a client is given to the same client only (case ignored; not to a null
    one), an unbound value to all.
    """
    if not allow_restoration:
        return responses.withColumn("restored", F.col(text_col)).withColumn("restored_count", F.lit(0).cast("long"))
    client = F.col(client_col) if client_col else None
    out = responses.join(vault_maps(vault, key_col), key_col, "left")
    out = out.withColumn("__r", replaced(F.col(text_col), F.col("__vault"), token_pattern(prefix, suffix), client))
    return out.withColumn("restored", F.col("__r.restored")).withColumn("restored_count", F.col("__r.restored_count")).drop("__r", "__vault")


def restore_batch(responses: DataFrame, vault: DataFrame, key_col: str = "request_id", text_col: str = "response",
                  client_col: str | None = None, purge: bool = True) -> tuple[DataFrame, DataFrame]:
    """Restored responses, and the vault without the requests that were answered."""
    restored = restore_text(responses, vault, key_col, text_col, client_col)
    return restored, purge_vault(vault, responses.select(key_col), key_col) if purge else vault


def verify_no_leak(sanitized: DataFrame, vault: DataFrame, key_col: str = "request_id", text_col: str = "sanitized") -> DataFrame:
    """Per sanitised row, how many of its request's vault values still occur in it, and their
    lengths only, never the values."""
    values = vault.groupBy(F.col("request_id").alias(key_col)).agg(F.array_sort(F.collect_set("value")).alias("__values"))
    out = sanitized.select(key_col, text_col).join(values, key_col, "left")
    found = F.filter(F.coalesce("__values", F.array().cast("array<string>")),
                     lambda v: (F.length(v) > 0) & F.coalesce(F.col(text_col).contains(v), F.lit(False)))
    return out.withColumn("__found", found).select(
        key_col, F.size("__found").cast("long").alias("leak_count"),
        F.sort_array(F.transform("__found", lambda v: F.length(v))).alias("leak_value_lengths"),
        (F.size("__found") == 0).alias("verification_passed"))


#: Characters of secrets whose automaton one task holds at a time.
AUTOMATON_CHARS = 8_000_000


def _secret_blocks(secrets: DataFrame, column: str, chars: int):
    """The different secrets in blocks of about ``chars`` characters, one after the other on the driver.
    They are materialised, as their own job would run again for the sum and for every block."""
    ensure_checkpoint_dir(secrets.sparkSession)
    kept = secrets.select(F.col(column).cast("string").alias("s")).filter(F.length("s") > 0).distinct().checkpoint()
    total = kept.agg(F.sum(F.length("s"))).first()[0] or 0
    blocks = -(-total // chars)
    for i in range(blocks):
        block = [r["s"] for r in kept.filter(F.pmod(F.xxhash64("s"), F.lit(blocks)) == i).toLocalIterator()]
        if block:
            yield block


def audit_wire(sent: DataFrame, secrets: DataFrame, text_col: str = "payload", secret_col: str = "secret", chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Sent rows that hold any of the secrets.

    Each block of secrets becomes one Aho-Corasick automaton per task, which reads every text once, so the
    work is the texts' length per block and nothing is shuffled. With several blocks the rows they find
    (only those) are united by row; rows equal in all columns are found together.
    """
    spark = sent.sparkSession

    def scan(words) -> DataFrame:
        def run(batches):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for w in words.value:
                automaton.add_word(w, 1)
            automaton.make_automaton()
            for batch in batches:
                hits = [t is not None and next(automaton.iter(t), None) is not None for t in batch.column("__text").to_pylist()]
                yield batch.filter(pa.array(hits, pa.bool_())).drop_columns(["__text"])

        return run

    rows = sent.withColumn("__text", F.col(text_col).cast("string"))
    found = [rows.mapInArrow(scan(spark.sparkContext.broadcast(block)), sent.schema) for block in _secret_blocks(secrets, secret_col, chars)]
    if len(found) < 2:
        return found[0] if found else sent.limit(0)
    named = lambda df: df.select(F.xxhash64(*sent.columns).alias("__row"), F.xxhash64(F.lit(1), *sent.columns).alias("__more"))
    hit = named(found[0])
    for more in found[1:]:
        hit = hit.unionByName(named(more))
    keyed = sent.withColumns({"__row": F.xxhash64(*sent.columns), "__more": F.xxhash64(F.lit(1), *sent.columns)})
    return keyed.join(hit.distinct(), ["__row", "__more"], "left_semi").drop("__row", "__more")


def purge_vault(vault: DataFrame, purged_ids: DataFrame, key_col: str = "request_id") -> DataFrame:
    """Vault without the purged requests (left-anti); a second restore then gives nothing."""
    return vault.join(purged_ids.select(F.col(key_col).alias("request_id")).distinct(), "request_id", "left_anti")


def write_vault_days(vault: DataFrame, path: str) -> None:
    """A10: vault rows appended to a table partitioned by the day of their creation."""
    vault.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def purge_vault_days(spark: SparkSession, path: str, tombstones: DataFrame, key_col: str = "request_id") -> int:
    """G5 on the stored vault: the requests named in ``tombstones`` are forgotten. Only the day partitions that hold
    any of them are written anew (dynamic overwrite; the rest keeps its files), a day left without rows goes.
    Returns the number of days touched. The new rows are set aside in the shared checkpoint folder first, as
    a table can't be overwritten while it is read; a job that fails before the overwrite changes nothing."""
    ensure_checkpoint_dir(spark)
    ids = tombstones.select(F.col(key_col).cast("string").alias("request_id")).distinct()
    held = spark.read.parquet(path)
    touched = [r["day"] for r in held.join(ids, "request_id", "left_semi").select("day").distinct().collect()]  # one row a day
    if not touched:
        return 0
    kept = held.filter(F.col("day").isin(touched)).join(ids, "request_id", "left_anti").checkpoint()
    left = {r["day"] for r in kept.select("day").distinct().collect()}
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    emptied = [d for d in touched if d not in left]
    if emptied:
        jvm = spark._jvm.org.apache.hadoop.fs
        for day in emptied:
            folder = jvm.Path(f"{path}/day={day.isoformat()}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(touched)


def audit_events(sanitized: DataFrame, key_col: str, tool_col: str = "tool") -> DataFrame:
    """G1: one event per request, no raw values. Blocked requests carry empty counts (the
    counts of a request that raised are never attached to its metrics)."""
    empty = F.create_map().cast("map<string,bigint>")
    counts = F.when(F.col("blocked"), empty).otherwise(F.col("counts"))
    return sanitized.select(
        F.current_timestamp().alias("ts"),
        F.col(key_col).cast("string").alias("request_id"),
        F.col(tool_col).alias("tool_name"),
        F.col("action"),
        counts.alias("categories_detected"),
        F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x).alias("total_entities_secured"),
        F.lit(None).cast("double").alias("overhead_ms"),
        F.col("verification_passed"),
        F.col("blocked"),
        F.when(F.col("action") == "BLOCKED_POLICY_VIOLATION", F.lit("FirewallBlockedError"))
        .when(F.col("action") == "BLOCKED_LEAKAGE_DETECTED", F.lit("PIILeakageDetectedError"))
        .when(F.col("action") == "BLOCKED_INTERNAL_ERROR", F.col("error_type") if "error_type" in sanitized.columns else F.lit("Exception"))
        .alias("error_type"),
        F.coalesce(F.sha2(F.col("sanitized"), 256), F.lit("")).alias("sanitized_payload_sha256"),
    )


def batch_summary(sanitized: DataFrame, restored: DataFrame | None = None) -> DataFrame:
    """Items, succeeded, failed, detected and restored, one global aggregation over both tables."""
    zero = F.lit(0).cast("long")
    rows = sanitized.select(F.lit(1).cast("long").alias("i"), "blocked", "total_detected", zero.alias("r"))
    if restored is not None:
        rows = rows.unionByName(restored.select(zero.alias("i"), F.lit(None).cast("boolean").alias("blocked"), zero.alias("total_detected"),
                                                F.col("restored_count").alias("r")))
    out = rows.agg(
        F.sum("i").alias("total_items"), F.count_if(~F.col("blocked")).alias("succeeded"), F.count_if("blocked").alias("failed"),
        F.sum("total_detected").alias("total_detected"), F.sum("r").alias("total_restored"))
    return out if restored is not None else out.drop("total_restored")


def audit_totals(audit: DataFrame) -> DataFrame:
    """E5: number of events and entities secured, by action."""
    return audit.groupBy("action").agg(
        F.count(F.lit(1)).alias("events"), F.sum("total_entities_secured").alias("entities_secured")
    )


def vault_stats(vault: DataFrame) -> DataFrame:
    """Distinct tokens and the set of values per request (bounded by one request)."""
    return vault.groupBy("request_id").agg(
        F.count_distinct("token").alias("token_count"), F.count_distinct("value").alias("value_count"),
        F.array_sort(F.collect_set("value")).alias("original_values"))


def restored_totals(restored: DataFrame, key_col: str = "request_id") -> DataFrame:
    """Tokens restored per request, and over all requests in the row marked ``overall``."""
    sums = restored.rollup(key_col).agg(F.sum("restored_count").alias("restored"), (F.grouping(key_col) == 1).alias("overall"))
    return sums.select(key_col, "overall", "restored")


def recent_events(audit: DataFrame, n: int = 50) -> DataFrame:
    """the last ``n`` events, oldest first (a top-k, the limit is the feature)."""
    return audit.orderBy(F.col("ts").desc(), F.col("request_id").desc()).limit(n).orderBy("ts", "request_id")


def latency_stats(df: DataFrame, col: str, accuracy: int = 10_000) -> DataFrame:
    """Min / max / mean, and approximate median / p95 / p99 (rank error at most 1 / accuracy),
    whose sketches are merged instead of all values meeting in one task."""
    c = F.col(col)
    return df.agg(
        F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"),
        *[F.percentile_approx(c, p, accuracy).alias(name) for name, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))])


def latency_sketches(df: DataFrame, col: str, ts_col: str, window: str = "1 minute", k: int = 200, watermark: str | None = None) -> DataFrame:
    """E6 over time: per event-time window one row (window_start, n, min, max, total, sketch) that can be stored and
    merged later; the sketch is a KLL quantile sketch of ``k``. On a stream give a watermark."""
    rows = df.withWatermark(ts_col, watermark) if watermark else df
    c = F.col(col).cast("double")
    return rows.groupBy(F.window(ts_col, window)).agg(
        F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("total"), F.kll_sketch_agg_double(c, F.lit(k)).alias("sketch"),
    ).select(F.col("window.start").alias("window_start"), "n", "min", "max", "total", "sketch")


def merged_latency(sketches: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """Min, max, mean, median, p95, p99 over any union of windows, from their stored rows alone. The quantiles'
    rank error is that of the sketch (about 1.3 % at k = 200), however often it was merged."""
    out = sketches.groupBy(*(by or [])).agg(
        F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("total").alias("__total"), F.kll_merge_agg_double("sketch").alias("__sketch"))
    at = lambda q: F.kll_sketch_get_quantile_double("__sketch", F.lit(q))
    return out.withColumns({"mean": F.col("__total") / F.col("n"), "median": at(0.5), "p95": at(0.95), "p99": at(0.99)}).drop("__total", "__sketch")


def absent_share(sanitized: DataFrame, planted: DataFrame, key_col: str, text_col: str = "sanitized", value_col: str = "value") -> DataFrame:
    """Share of planted values (key, value) that don't occur in their request's sanitised text."""
    j = planted.select(key_col, value_col).join(sanitized.select(key_col, text_col), key_col, "left")
    seen = F.coalesce(F.col(text_col).contains(F.col(value_col)), F.lit(False))
    return j.agg(F.avg((~seen).cast("double")).alias("absent_rate"))


def round_trip_accuracy(original: DataFrame, restored: DataFrame, key_col: str, orig_col: str, rest_col: str) -> DataFrame:
    """Share of rows whose restored text equals the original."""
    j = original.select(key_col, orig_col).join(restored.select(key_col, rest_col), key_col)
    return j.agg(F.avg(F.col(orig_col).eqNullSafe(F.col(rest_col)).cast("double")).alias("round_trip_rate"))
