"""User-supplied detectors and external annotations.

* ``regex_detector``: a pattern run with the span technique; an optional validator is a
  Column function (preferred, stays in the JVM) or a Python callable applied to the short
  array of matched values by an Arrow UDF; optional context words anywhere in the text.
* ``function_detector``: a Python callable per text through an Arrow UDF, a slice of texts at a time; its
  output may be spans, (start, end[, value[, confidence]]) tuples, dicts or plain strings
  (every occurrence). A failing callable yields no entities.
* ``locate_annotations``: entities named by an outside analyser (value, type, confidence)
  are located in their text by an equi-join on the document key and a quoted-literal span
  search.
"""

from __future__ import annotations

import re
from typing import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import fixed as X
from veilspark.functions.entity import empty_entities, make_entity
from veilspark.functions.normalize import by_slices
from veilspark.functions.spans import SPAN_TYPE, _starts, spans
from veilspark.operators.detect import Detector
from veilspark.operators.policy import category_col


def regex_detector(
    pii_type: str,
    pattern: str,
    confidence: float = 1.0,
    validator: Callable[[Column], Column] | None = None,
    context_words: list[str] | None = None,
    flags: str = "",
    name: str | None = None,
    python_validator: Callable[[str], bool] | None = None,
) -> Detector:
    """C28. ``flags`` are Java inline flags, e.g. ``"i"``. ``validator`` maps the value's column to a
    boolean column; ``python_validator`` takes one value and runs in an Arrow function."""
    pat = (f"(?{flags})" if flags else "") + pattern

    def matches(text: Column) -> Column:
        s = F.coalesce(spans(text, pat), F.array().cast("array<struct<start:int,end:int,value:string,match:string>>"))
        s = F.filter(s, lambda m: F.length(m["value"]) > 0)
        if validator is not None:
            s = F.filter(s, lambda m: F.coalesce(validator(m["value"]), F.lit(False)))
        return s

    def entities(text: Column, s: Column) -> Column:
        out = F.transform(s, lambda m: make_entity(pii_type, m["start"], m["end"], m["value"], confidence))
        if context_words:
            lt = F.lower(text)
            cond = F.lit(False)
            for w in context_words:
                cond = cond | lt.contains(w.lower())
            out = F.when(cond, out).otherwise(empty_entities())
        return out

    def fn(text: Column) -> Column:
        return entities(text, matches(text))

    def df_fn(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        """Matches, the Python answers for their values, and what is left, as columns one after the other."""
        text = F.col(text_col)
        df = df.withColumn("__m", F.coalesce(matches(text), F.array().cast(SPAN_TYPE))).withColumn("__v", F.transform("__m", lambda m: m["value"]))
        df = df.withColumn("__ok", _py_validator(python_validator)("__v"))
        passed = F.filter("__m", lambda m, i: F.coalesce(F.get(F.col("__ok"), i), F.lit(False)))
        return df.withColumn(out_col, F.coalesce(entities(text, passed), empty_entities())).drop("__m", "__v", "__ok")

    label = name or f"custom_regex_{pii_type}"
    if python_validator is not None:
        return Detector(label, None, (pii_type,), df_fn=df_fn)
    return Detector(label, fn, (pii_type,))


def _py_validator(fn: Callable):
    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def check(values: pd.Series) -> pd.Series:
        def one(arr):
            if arr is None:
                return None
            out = []
            for v in arr:
                try:
                    out.append(bool(fn(v)))
                except Exception:  # an error counts as "not valid"
                    out.append(False)
            return out

        return values.map(one)

    return check.asNondeterministic()  # keeps the call out of array functions, where it can't run


FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("value", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
        ]
    )
)


READ = T.StructType([T.StructField("found", FOUND), T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])

READ_ARROW = pa.struct([
    ("found", pa.list_(pa.field("element", pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("confidence", pa.float64())])))),
    ("type", pa.string()), ("text", pa.string())])


def span_reader(detector: Callable, confidence: float, on_error: str) -> Callable:
    """text -> (spans, error): what the callable returned, brought into one shape.

    Items may be (start, end[, value[, confidence]]), dicts or plain strings (every occurrence). The
    callable's own error gives no spans, and an item that can't be read is left out (``on_error="skip"``), or
    either is passed on as the text's error (``"fail"``).
    """

    def from_parts(text: str, item) -> list[tuple]:
        start, end, *rest = item
        value = str(rest[0]) if rest else text[int(start) : int(end)]
        return [(int(start), int(end), value, float(rest[1]) if len(rest) > 1 else confidence)]

    def from_fields(text: str, item) -> list[tuple]:
        start, end = int(item["start"]), int(item["end"])
        return [(start, end, str(item.get("value", text[start:end])), float(item.get("confidence", confidence)))]

    def from_word(text: str, item) -> list[tuple]:
        return [(m.start(), m.end(), item, confidence) for m in re.finditer(re.escape(item), text)] if item else []

    shapes = {tuple: from_parts, list: from_parts, dict: from_fields, str: from_word}

    def read(text: str | None) -> tuple[list[tuple], Exception | None]:
        try:
            items = list(detector(text) or []) if text else []
        except Exception as e:
            return [], e if on_error == "fail" else None
        out = []
        for item in items:
            shape = next((f for kind, f in shapes.items() if isinstance(item, kind)), None)
            try:
                out += shape(text, item) if shape else []
            except (KeyError, TypeError, ValueError, IndexError) as e:
                if on_error == "fail":
                    return [], e
        return out, None

    return read


def function_detector(pii_type: str, detector: Callable, confidence: float = 1.0, name: str | None = None, on_error: str = "skip") -> Detector:
    """Per-text Python callback (Arrow batches), normalised to entity spans; errors go by row to
    the chain's error column (P11), see ``span_reader``."""
    label = name or f"custom_fn_{pii_type}"
    read = span_reader(detector, confidence, on_error)

    @F.arrow_udf(READ)
    def run(texts: pa.Array) -> pa.Array:
        def one(text: str | None) -> dict:
            found, e = read(text)
            return {"found": [dict(start=s, end=e, value=v, confidence=c) for s, e, v, c in found],
                    "type": type(e).__name__ if e else None, "text": str(e) if e else None}

        return by_slices(texts, lambda part: [one(t) for t in part], READ_ARROW)

    run = run.asNondeterministic()  # keeps the call out of array functions, where it can't run

    def df_fn(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        error = F.when(F.col("__f.type").isNotNull(), F.struct(F.col("__f.type").alias("type"), F.col("__f.text").alias("text")))
        found = F.transform("__f.found", lambda f: make_entity(pii_type, f["start"], f["end"], f["value"], f["confidence"]))
        return df.withColumn("__f", run(F.col(text_col))).withColumn(f"__error_{label}", error).withColumn(out_col, F.coalesce(found, empty_entities())).drop("__f")

    return Detector(label, None, (pii_type,), df_fn=df_fn, error_col=f"__error_{label}")


def detect_udtf(df: DataFrame, text_col: str, key_col: str, pii_type: str, detector: Callable, confidence: float = 1.0) -> DataFrame:
    """C29 as an Arrow table function over the table (key, text): one row per entity (key_col, pii_type, start, end,
    value, confidence, error). A text that the callable fails on, or whose answer can't be read, is one row
    with the error's type and no span. The function's schema is enforced by Arrow. (Spark 4.1 has no lateral
    join with Arrow table functions, so the key goes through it as text.)"""
    read = span_reader(detector, confidence, "fail")

    @F.arrow_udtf(returnType="key string, pii_type string, start int, end int, value string, confidence double, error string")
    class Spans:
        def eval(self, rows: pa.RecordBatch):
            out = []
            for key, text in zip(rows.column("key").to_pylist(), rows.column("text").to_pylist()):
                found, error = read(text)
                out += [(key, pii_type, s, e, v, c, None) for s, e, v, c in found]
                if error is not None:
                    out.append((key, pii_type, None, None, None, None, type(error).__name__))
            names = ["key", "pii_type", "start", "end", "value", "confidence", "error"]
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string()]
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.table([pa.array(c, k) for c, k in zip(columns, types)], names)

    table = df.select(F.col(key_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    found = Spans(table.asTable())
    return found.select(F.col("key").cast(df.schema[key_col].dataType).alias(key_col), *found.columns[1:])


# ---------------------------------------------------------------------------
# A12 / C31 external annotations
# ---------------------------------------------------------------------------
ANNOTATION = T.ArrayType(
    T.StructType(
        [
            T.StructField("value", T.StringType()),
            T.StructField("type", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("context", T.StringType()),
        ]
    )
)


def read_annotations(df: DataFrame, key_col: str, json_col: str) -> DataFrame:
    """``{"entities": [{value, type, confidence, context}, ...]}`` -> one row per annotation."""
    ents = F.from_json(F.get_json_object(F.col(json_col), "$.entities"), ANNOTATION)
    return df.select(key_col, F.inline_outer(ents)).filter(F.col("value").isNotNull())


def locate_annotations(texts: DataFrame, annotations: DataFrame, key_col: str, text_col: str = "text") -> DataFrame:
    """Where each annotated value occurs in its text: all occurrences in the value's own case,
    then, after the last of them, those in any case. Unknown types map to EMAIL; the type's category
    and the annotation's context (as evidence) are kept."""
    alias = F.create_map(*[x for k, v in X.ANNOTATION_TYPE_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    a = annotations.select(
        key_col,
        F.trim(F.col("value")).alias("__v"),
        F.coalesce(F.element_at(alias, F.upper(F.trim(F.coalesce(F.col("type"), F.lit("EMAIL"))))), F.lit("EMAIL")).alias("pii_type"),
        F.coalesce(F.col("confidence"), F.lit(0.95)).alias("confidence"),
        F.col("context").alias("evidence"),
    ).filter(F.length("__v") > 0)
    j = texts.select(key_col, F.col(text_col).alias("__t")).join(a, key_col)
    # pattern per row: a quoted literal (an end-of-quote inside the value is split out)
    quoted = F.concat(F.lit("\\Q"), F.replace(F.col("__v"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    j = j.withColumn("__exact", quoted).withColumn("__any", F.concat(F.lit("(?iu)"), quoted))
    j = j.withColumn("__gaps", F.split("__t", F.col("__exact"), -1)).withColumn("__rest", F.element_at("__gaps", -1))
    first = _starts(F.regexp_extract_all("__t", F.col("__exact"), F.lit(0)), F.col("__gaps"))
    offset = F.length("__t") - F.length("__rest")
    then = _starts(F.regexp_extract_all("__rest", F.col("__any"), F.lit(0)), F.split("__rest", F.col("__any"), -1))
    j = j.withColumn("__st", F.concat(first, F.transform(then, lambda s: s + offset)))
    return j.select(key_col, "pii_type", F.explode("__st").alias("start"), "confidence", "evidence", "__v", "__t").select(
        key_col, "pii_type", "start", (F.col("start") + F.length("__v")).alias("end"),
        F.expr("substring(__t, start + 1, length(__v))").alias("value"), "confidence",
        category_col(F.col("pii_type")).alias("category"), "evidence")
