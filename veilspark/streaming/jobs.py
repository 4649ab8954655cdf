"""Structured Streaming jobs.

The reference keeps a live vault per request id between a request and its response; here
that life cycle is tables plus streams: sanitised rows, vault rows and audit rows are
written per micro-batch (idempotent by batch id), responses meet the vault table in a
stream-static join, and audit outcomes are counted in event-time windows with a watermark.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from veilspark.functions import fixed as X
from veilspark.functions.rewrite import token_pattern
from veilspark.operators.restore import audit_events, replaced, restore_text
from veilspark.plans.sanitize import Firewall


def sanitize_stream(fw: Firewall, stream: DataFrame, text_col: str, key_col: str, tool=None):
    """The stateless sanitise chain on a stream (same expressions as the batch job). Base64
    carriers need the batch form: ``run_sanitize_stream``."""
    return fw.sanitize(stream, text_col, key_col, tool if tool is not None else "*")


def vault_sink(fw: Firewall, out_dir: str, vault_dir: str, text_col: str, key_col: str):
    """``foreachBatch`` writer that sanitises a micro-batch and writes its rows, vault and audit.

    The vault holds plain values and so has a root of its own, apart from what is handed on.

    Each table is written under ``batch_id=<n>`` with overwrite, so a replayed micro-batch
    (after a lost executor or a restart) replaces its own output instead of duplicating it.
    Blocked rows carry no payload and no vault.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = fw.sanitize(batch, text_col, key_col).persist()
        try:
            sanitized = batch.select(key_col, "tool", "sanitized", "blocked", "block_reason", "action", "counts",
                                     "total_detected", "verification_passed")
            sanitized.write.mode("overwrite").parquet(f"{out_dir}/sanitized/batch_id={batch_id}")
            Firewall.vault_rows(batch, key_col).write.mode("overwrite").parquet(f"{vault_dir}/batch_id={batch_id}")
            audit_events(batch, key_col).write.mode("overwrite").json(f"{out_dir}/audit/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write


def run_sanitize_stream(fw: Firewall, stream: DataFrame, text_col: str, key_col: str, out_dir: str,
                        vault_dir: str, checkpoint_dir: str, available_now: bool = True):
    """S1 + S2 as a running query."""
    q = stream.writeStream.foreachBatch(vault_sink(fw, out_dir, vault_dir, text_col, key_col)).option("checkpointLocation", checkpoint_dir)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()


def restore_stream(responses: DataFrame, vault_table: DataFrame, key_col: str = "request_id", text_col: str = "response"):
    """S3: responses (stream) meet the vault (table); unknown ids pass unchanged."""
    return restore_text(responses, vault_table, key_col, text_col)


def restore_streams(responses: DataFrame, requests: DataFrame, within: str = "1 hour", late: str = "10 minutes",
                    client_col: str | None = None, prefix: str = X.TOKEN_PREFIX, suffix: str = X.TOKEN_SUFFIX) -> DataFrame:
    """S3, both sides streams: ``responses`` (request_id, ts, response[, client]) meet ``requests`` (request_id, ts, vault:
    array of pii_type, value, token; client_id if bound), in whatever order they come.

    A response is restored with the vault of its request if it was given at most ``within`` after it. It
    waits for the vault until the watermark (``late`` behind the latest event) says that none can come;
    then it passes unchanged, as does a response too late or with an unknown id. A response that is itself
    older than the watermark when it comes is dropped by Spark's rule for late rows. State is what lies
    within that time of the watermark, on either side. Adds restored and restored_count.
    """
    client_id = F.col("client_id") if "client_id" in requests.columns else F.lit(None).cast("string")
    entry = lambda v: F.struct(v["token"].alias("key"), F.struct(v["value"].alias("value"), client_id.alias("client")).alias("value"))
    held = requests.select(F.col("request_id").alias("__id"), F.col("ts").alias("__ts"), F.map_from_entries(F.transform("vault", entry)).alias("__vault"))
    left, right = responses.withWatermark("ts", late), held.withWatermark("__ts", late)
    met = left.join(right, F.expr(f"request_id = __id AND ts >= __ts AND ts <= __ts + INTERVAL {within}"), "leftOuter")
    done = met.withColumn("__r", replaced(F.col("response"), F.col("__vault"), token_pattern(prefix, suffix), F.col(client_col) if client_col else None))
    return done.withColumns({"restored": F.col("__r.restored"), "restored_count": F.col("__r.restored_count")}).drop("__r", "__id", "__ts", "__vault")


class LiveVault(StatefulProcessor):
    """A request's vault as map state, token -> value, each entry with a time to live of its own; the first response
    is restored and purges it. Rows of one key and batch are taken in the order of ``seq``, requests first."""

    def __init__(self, ttl_ms: int, pattern: str):
        self.ttl_ms, self.pattern = ttl_ms, pattern

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.found = re.compile(self.pattern)
        self.vault = handle.getMapState("vault", "token string", "value string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        events = pd.concat(list(rows)).sort_values(["seq", "kind"], kind="stable")
        out = []
        for kind, seq, text, vault in zip(events["kind"], events["seq"], events["text"], events["vault"]):
            if kind == "request":
                for token, value in dict(vault or {}).items():
                    self.vault.updateValue((token,), (value,))
                continue
            tokens = {m[0] for m in self.found.finditer(text or "")}
            known = {t: self.vault.getValue((t,))[0] for t in tokens if self.vault.containsKey((t,))}
            count = sum(m[0] in known for m in self.found.finditer(text or ""))
            out.append((key[0], seq, self.found.sub(lambda m: known.get(m[0], m[0]), text) if count else text, count))
            self.vault.clear()
        if out:
            yield pd.DataFrame(out, columns=["request_id", "seq", "restored", "restored_count"])

    def close(self) -> None:
        pass


def vault_state(events: DataFrame, ttl: str = "1 hour", pattern: str | None = None) -> DataFrame:
    """Live vaults as keyed state. ``events``: a stream of (request_id, kind, seq, text, vault), kind
    ``request`` with a vault (token -> value) or ``response`` with a text. A request's vault is kept
    until its first response, which is restored and purges it, or until an entry's time to live is
    over; a response without a live vault passes unchanged. Output: request_id, seq, restored,
    restored_count. The state of a key is one request's vault, one map entry per token; only the tokens
    that a text holds are looked up. Needs the RocksDB state store (``use_rocksdb``).
    """
    milliseconds = int(pd.Timedelta(ttl).total_seconds() * 1000)
    return events.groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=LiveVault(milliseconds, pattern or token_pattern()),
        outputStructType="request_id string, seq long, restored string, restored_count long", outputMode="append", timeMode="ProcessingTime")


def use_rocksdb(spark) -> None:
    """The state store that map state with a time to live is kept in."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def audit_stream(audit: DataFrame, window: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """Running counts of events by outcome in event-time windows."""
    return (
        audit.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window), "action")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("total_entities_secured").alias("entities_secured"))
    )
