"""Request tables and JSON payloads.

Payloads of unknown shape are Spark ``VARIANT`` values. Their string leaves are listed by one Arrow
function per batch of rows (a stack, no recursion and no depth limit of our own), in an order that
``replace_leaves`` uses to put rewritten texts back.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import fixed as X


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet", key_cols: list[str] | None = None) -> DataFrame:
    """A1: a request table with ``request_id``: the given one, else a hash of the key columns (all
    columns by default, the payload too; a null differs from an empty text). Rows that are equal in
    all of them are numbered, so that every request has its own id. A column ``idx`` in the input
    keeps the input position; without one there is no position to keep and none is made up."""
    df = spark.read.format(fmt).load(path)
    keys = key_cols or df.columns
    parts = [F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}) for c in keys]
    content = F.sha2(F.concat_ws("\u0001", *parts), 256)
    given = F.col("request_id").cast("string") if "request_id" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("__content", content).withColumn("__given", given)
    order = [c for c in ("idx",) if c in df.columns] or [F.lit(0)]
    nth = F.row_number().over(Window.partitionBy("__content").orderBy(*order))
    derived = F.when(nth == 1, F.col("__content")).otherwise(F.concat_ws("-", "__content", nth.cast("string")))
    return df.withColumn("request_id", F.coalesce("__given", derived)).drop("__content", "__given")


def parse_payload(text: Column) -> Column:
    """A2: parse JSON text; on failure repair unquoted keys and bare-word values and try again."""
    repaired = text
    for pattern, replacement in X.JSON_REPAIRS:
        repaired = F.regexp_replace(repaired, pattern, replacement)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(repaired))


def tool_of(payload: Column) -> Column:
    """A4: ``payload.tool`` when the payload is an object, else ``*``."""
    return F.coalesce(F.try_variant_get(payload, "$.tool", "string"), F.lit("*"))


def unwrap_envelope(payload: Column) -> Column:
    """A5: an object with ``payload`` and without ``tool`` is a batch item: use the inner payload."""
    inner = F.try_variant_get(payload, "$.payload", "variant")
    has_tool = F.try_variant_get(payload, "$.tool", "variant").isNotNull()
    return F.when(inner.isNotNull() & ~has_tool, inner).otherwise(payload)


def from_tool_calls(df: DataFrame) -> DataFrame:
    """A3: function-call envelope ``(id, type, function{name, arguments JSON text})`` ->
    ``(tool_call_id, tool, payload)``; unparsable arguments become ``{"raw_arguments": text}``,
    a missing name ``unknown_tool``."""
    args = F.col("function.arguments")
    parsed = F.try_parse_json(args)
    raw = F.parse_json(F.to_json(F.struct(args.alias("raw_arguments"))))
    tool = F.coalesce(F.col("function.name"), F.lit("unknown_tool"))
    payload = F.to_variant_object(F.struct(tool.alias("tool"), F.coalesce(parsed, raw).alias("arguments")))
    return df.select(F.col("id").alias("tool_call_id"), tool.alias("tool"), payload.alias("payload"))


LEAF = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "field", "text")])
WALKED = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("leaves", T.ArrayType(LEAF))])


def _walk(value, replace=None):
    """String leaves (path, field, text) of a JSON value in order, without recursion; with
    ``replace`` (texts in the same order) also the value with its leaves replaced."""
    out, top = [], [value]
    todo = [(top, 0, "$", None)]
    while todo:
        box, key, path, name = todo.pop()
        v = box[key]
        if isinstance(v, str):
            if replace is not None:
                box[key] = replace[len(out)]
            out.append((path, name, v))
        elif isinstance(v, dict):
            todo.extend((v, k, f"{path}.{k}", k) for k in reversed(list(v)))
        elif isinstance(v, list):
            todo.extend((v, i, f"{path}[{i}]", name) for i in range(len(v) - 1, -1, -1))
    return out, top[0]


@F.pandas_udf(WALKED)
def walk_json(texts: pd.Series) -> pd.DataFrame:
    def one(text):
        try:
            found = _walk(json.loads(text))[0]
        except (ValueError, RecursionError, TypeError):
            return False, []
        return True, [{"path": p, "field": f, "text": t} for p, f, t in found]

    rows = [one(t) for t in texts]
    return pd.DataFrame({"ok": [r[0] for r in rows], "leaves": [r[1] for r in rows]})


def _above(value) -> list[list[str]]:
    """Per string leaf, in ``_walk``'s order: the keys on the way to it and the dotted paths of its
    ancestors and itself (list positions don't count, empty names neither)."""
    out, todo = [], [(value, (), "")]
    while todo:
        v, names, path = todo.pop()
        if isinstance(v, str):
            out.append(list(dict.fromkeys(names)))
        elif isinstance(v, dict):
            for k in reversed(list(v)):
                below = f"{path}.{k}" if path else k
                todo.append((v[k], (*names, *(x for x in (k, below) if x)), below))
        elif isinstance(v, list):
            todo.extend((x, names, path) for x in reversed(v))
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def ancestors(texts: pd.Series) -> pd.Series:
    """The names above every string leaf of a JSON text (null if it can't be read)."""
    def one(text):
        try:
            return _above(json.loads(text))
        except (ValueError, RecursionError, TypeError):
            return None

    return texts.map(one)


ancestors = ancestors.asNondeterministic()


# Said to vary so that the optimiser doesn't move the call into an array function, where it can't run.
walk_json = walk_json.asNondeterministic()


@F.pandas_udf(T.StringType())
def replace_leaves(texts: pd.Series, leaves: pd.Series) -> pd.Series:
    """B2: JSON texts with their string leaves replaced, in walking order; all else keeps its place."""
    return pd.Series([None if v is None else json.dumps(_walk(json.loads(t), list(v))[1], ensure_ascii=False) for t, v in zip(texts, leaves)], dtype=object)


def as_json(payload: Column) -> Column:
    """JSON text of a VARIANT payload."""
    return F.to_json(payload)


def explode_leaves(df: DataFrame, key_col: str, payload_col: str) -> DataFrame:
    """B1: leaves (key, n, path, field, text) of a VARIANT payload column, at any depth, in one pass.

    A payload nested deeper than a JSON parser can read has no leaves here; callers that send data
    on must look at ``walk_json(...).ok`` and block such a request (``plans.requests`` does).
    """
    walked = df.select(F.col(key_col), walk_json(as_json(F.col(payload_col))).alias("__w"))
    return walked.select(key_col, F.posexplode_outer("__w.leaves").alias("n", "leaf")).filter("n is not null").select(key_col, "n", "leaf.*")


def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request table derived from ``conversations``: one tool call per turn."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    tool = F.when(F.col("turn") % 3 == 0, F.lit("send_email")).when(F.col("turn") % 3 == 1, F.lit("search_web")).otherwise(
        F.lit("internal_kms")
    )
    payload = F.to_json(
        F.struct(
            tool.alias("tool"),
            F.struct(F.col("text").alias("message"), F.col("role").alias("role"), F.col("turn").alias("turn"),
                     F.array(F.col("role"), F.lit("x")).alias("tags")).alias("arguments"),
        )
    )
    return conv.select(
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("request_id"),
        F.parse_json(payload).alias("payload"),
    )
