"""The entity record and small array helpers shared by all detectors.

An entity is one struct; a detector maps a text column to ``array<entity>``. Keeping
entities as an array inside the row means detection, overlap resolution, policy and
rewriting of one text all happen in the same task without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY_STRUCT = T.StructType(
    [
        T.StructField("pii_type", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("value", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("category", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("related_entity", T.StringType()),
        T.StructField("exposed", T.BooleanType()),
        T.StructField("det_rank", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
    ]
)
ENTITY_ARRAY = T.ArrayType(ENTITY_STRUCT)
ENTITY_FIELDS = [f.name for f in ENTITY_STRUCT.fields]


def empty_entities() -> Column:
    return F.array().cast(ENTITY_ARRAY)


def make_entity(
    pii_type: Column | str,
    start: Column,
    end: Column,
    value: Column,
    confidence: Column | float,
    category: Column | str | None = None,
    evidence: Column | str | None = None,
    related: Column | str | None = None,
    exposed: Column | bool = True,
) -> Column:
    def lit(v, dtype):
        if isinstance(v, Column):
            return v.cast(dtype)
        return F.lit(v).cast(dtype)

    return F.struct(
        lit(pii_type, "string").alias("pii_type"),
        lit(start, "int").alias("start"),
        lit(end, "int").alias("end"),
        lit(value, "string").alias("value"),
        lit(confidence, "double").alias("confidence"),
        lit(category, "string").alias("category"),
        lit(evidence, "string").alias("evidence"),
        lit(related, "string").alias("related_entity"),
        lit(exposed, "boolean").alias("exposed"),
        F.lit(0).alias("det_rank"),
        F.lit(0).alias("seq"),
    )


def overlaps(a: Column, b: Column) -> Column:
    """Half-open intervals [start, end) intersect."""
    return ~((a["end"] <= b["start"]) | (a["start"] >= b["end"]))


def contains_span(outer: Column, inner: Column) -> Column:
    return (outer["start"] <= inner["start"]) & (outer["end"] >= inner["end"])


def keep_not_contained(cands: Column, element_type: T.DataType) -> Column:
    """Walk candidates in order, drop one lying inside (or equal to) an earlier kept one."""
    init = F.array().cast(T.ArrayType(element_type))
    return F.aggregate(
        cands,
        init,
        lambda acc, c: F.when(F.exists(acc, lambda k: contains_span(k, c)), acc).otherwise(
            F.array_append(acc, c)
        ),
    )


def keep_not_overlapping(cands: Column, seed: Column, element_type: T.DataType) -> Column:
    """Walk candidates in order; keep one only if it overlaps neither ``seed`` nor an earlier kept one."""
    init = F.array().cast(T.ArrayType(element_type))
    return F.aggregate(
        cands,
        init,
        lambda acc, c: F.when(
            F.exists(seed, lambda k: overlaps(k, c)) | F.exists(acc, lambda k: overlaps(k, c)), acc
        ).otherwise(F.array_append(acc, c)),
    )


def sort_by_start(arr: Column) -> Column:
    """Stable sort by start (ties keep array order)."""
    indexed = F.transform(arr, lambda e, i: F.struct(e["start"].alias("s"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(indexed), lambda x: x["e"])


def number_seq(arr: Column, det_rank: int) -> Column:
    """Stamp detector rank and position so later tie-breaks are total and deterministic."""
    return F.transform(
        arr,
        lambda e, i: e.withField("det_rank", F.lit(det_rank)).withField("seq", i.cast("int")),
    )
