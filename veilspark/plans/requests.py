"""Whole requests: leaves of a payload through the sanitise chain and back.

All leaves of a request share one shuffle by request id: the vault is assigned over them in walking
order, and block decision, counts and leak check are the request's. A request that can't be read, or
that any leaf blocks, is blocked as a whole and sends nothing.

Tables of requests are joined by sorting (``by_sorting``): the optimiser judges them by the size of the
compressed input files, far below that of texts, vaults and rewritten payloads, and would broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed as X
from veilspark.functions.rewrite import token_pattern
from veilspark.operators.restore import replaced, vault_maps
from veilspark.plans.sanitize import INTERNAL_ERROR, Firewall
from veilspark.sources.requests import ancestors, as_json, replace_leaves, tool_of, walk_json

UNREADABLE = INTERNAL_ERROR


def by_sorting(requests: DataFrame) -> DataFrame:
    """A table that grows with the requests, as one side of a join: shuffled and sorted by its key, never broadcast."""
    return requests.hint("merge")


def _regrouped(leaves: DataFrame, key_col: str, column: str, alias: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("n", F.col(column).alias("x")))), lambda p: p["x"]).alias(alias)


def sanitize_requests(fw: Firewall, df: DataFrame, key_col: str = "request_id", payload_col: str = "payload",
                      tool: Column | None = None) -> DataFrame:
    """(key, VARIANT payload) -> key, tool, sanitized (JSON text, null if blocked), blocked,
    block_reason, action, error_type, counts, total_detected, leaks, verification_passed, vault."""
    tool_c = tool if tool is not None else tool_of(F.col(payload_col))
    read = df.select(F.col(key_col), tool_c.alias("tool"), as_json(F.col(payload_col)).alias("json")).withColumn("w", walk_json("json"))
    leaves = read.select(key_col, "tool", F.posexplode("w.leaves").alias("n", "leaf")).select(key_col, "tool", "n", "leaf.field", "leaf.text")
    done = fw.sanitize(leaves, "text", key_col, F.col("tool"), field_col="field", order_col="n")
    done = done.withColumn("rewritten", F.coalesce("sanitized", F.lit("")))
    # an error in any leaf stops the request before a policy or leak block in an earlier one
    blocked = F.min(F.when(F.col("blocked"), F.struct(F.col("error_type").isNull().alias("last"), "n", "action", "block_reason", "error_type")))
    types = F.flatten(F.collect_list(F.flatten(F.transform(F.map_entries("counts"), lambda e: F.array_repeat(e["key"], e["value"].cast("int"))))))
    per = done.groupBy(key_col).agg(
        _regrouped(done, key_col, "rewritten", "texts"), blocked.alias("stop"), types.alias("types"),
        F.sum("leaks").alias("leaks"), F.first("vault").alias("vault"))
    out = read.join(by_sorting(per), key_col, "left")
    unread = ~F.coalesce(F.col("w.ok"), F.lit(False))
    unread_type = F.when(unread, F.lit("ValueError"))
    stopped = unread | F.col("stop").isNotNull()
    names = F.array_sort(F.array_distinct(F.coalesce("types", F.array().cast("array<string>"))))
    counts = F.map_from_arrays(names, F.transform(names, lambda t: F.size(F.filter("types", lambda x: x == t)).cast("long")))
    return out.select(
        key_col, "tool",
        replace_leaves("json", F.when(~stopped, F.coalesce("texts", F.array().cast("array<string>")))).alias("sanitized"),
        stopped.alias("blocked"),
        F.when(unread, F.lit("Payload could not be read")).otherwise(F.col("stop.block_reason")).alias("block_reason"),
        F.when(unread, F.lit(UNREADABLE)).otherwise(F.coalesce("stop.action", F.lit("SANITIZED_AND_FORWARDED"))).alias("action"),
        F.coalesce(unread_type, F.col("stop.error_type")).alias("error_type"),
        counts.alias("counts"), F.coalesce(F.size("types"), F.lit(0)).cast("long").alias("total_detected"),
        F.coalesce("leaks", F.lit(0)).cast("long").alias("leaks"),
        (~stopped & (F.coalesce("leaks", F.lit(0)) == 0)).alias("verification_passed"),
        F.coalesce("vault", F.array().cast("array<struct<pii_type:string,value:string,token:string>>")).alias("vault"))


def restore_fields(responses: DataFrame, vault: DataFrame, key_col: str = "request_id", payload_col: str = "response",
                   client_col: str | None = None, fields: list[str] | None = None,
                   prefix: str = X.TOKEN_PREFIX, suffix: str = X.TOKEN_SUFFIX) -> DataFrame:
    """Responses (key, JSON text) with the tokens in their string leaves restored. Adds restored
    (JSON text) and restored_count; text that isn't JSON is returned as it is.

    ``fields`` are keys or dotted paths without list positions; a leaf is restored if its own or any
    of its ancestors' key or path is among them (null: all leaves, none listed: no leaf).
    """
    client = F.col(client_col) if client_col else None
    rows = responses.join(by_sorting(vault_maps(vault, key_col)), key_col, "left").withColumn("__w", walk_json(payload_col))
    if fields is not None:
        rows = rows.withColumn("__above", ancestors(payload_col))
        allowed = F.array(*[F.lit(f) for f in fields]).cast("array<string>")

    def one(leaf: Column, i: Column) -> Column:
        same = F.struct(leaf["text"].alias("restored"), F.lit(0).cast("long").alias("restored_count"))
        done = replaced(leaf["text"], F.col("__vault"), token_pattern(prefix, suffix), client)
        return done if fields is None else F.when(F.coalesce(F.arrays_overlap(F.get(F.col("__above"), i), allowed), F.lit(False)), done).otherwise(same)

    rows = rows.withColumn("__r", F.transform("__w.leaves", one))
    texts = F.transform("__r", lambda r: r["restored"])
    counted = F.aggregate("__r", F.lit(0).cast("long"), lambda n, r: n + r["restored_count"])
    return rows.withColumn("restored", F.coalesce(replace_leaves(F.col(payload_col), F.when(F.col("__w.ok"), texts)), F.col(payload_col))).withColumn(
        "restored_count", F.when(F.col("__w.ok"), counted).otherwise(F.lit(0).cast("long"))).drop("__w", "__r", "__vault", "__above")


def protect(fw: Firewall, df: DataFrame, tool_fn, key_col: str = "request_id", payload_col: str = "payload",
            fields: list[str] | None = None) -> DataFrame:
    """Sanitise, let ``tool_fn`` (a DataFrame function from key and sent JSON text to key and
    ``response``) answer the requests that were not blocked, restore the answers (in ``fields`` only, if given), and return the
    envelope: key, tool, sent, raw_response, restored, restored_count, blocked, block_reason, action,
    counts, total_detected. Blocked requests never reach the function and have no response."""
    done = sanitize_requests(fw, df, key_col, payload_col)
    sent = done.filter("not blocked").select(key_col, F.col("sanitized").alias("sent"))
    answers = tool_fn(sent).select(key_col, "response")
    restored = restore_fields(answers, Firewall.vault_rows(done, key_col), key_col, fields=fields)
    return done.join(by_sorting(restored), key_col, "left").select(
        key_col, "tool", F.col("sanitized").alias("sent"), F.col("response").alias("raw_response"), "restored",
        F.coalesce("restored_count", F.lit(0).cast("long")).alias("restored_count"), "blocked", "block_reason", "action", "counts", "total_detected")
