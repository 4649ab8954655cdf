"""Positions of all regex matches as a Spark column expression.

Spark has no "all match positions" function. With ``m = regexp_extract_all(t, p, 0)``
and ``g = split(t, p, -1)`` (both walk the text with the same left-to-right ``find``),
match *i* starts at ``len(g[0]) + len(m[0]) + ... + len(g[i])``. One ``aggregate``
over the (short) match array turns that into offsets, so everything stays inside the
JVM; no Python per row.

Offsets are 0-based code-point offsets, ``end`` exclusive (``substring`` is 1-based).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN_STRUCT = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("value", T.StringType()),
        T.StructField("match", T.StringType()),
    ]
)
SPAN_TYPE = T.ArrayType(SPAN_STRUCT)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` as a lambda variable.

    Column expressions referenced several times inside higher-order lambdas are
    re-evaluated per element; binding them first keeps every scan of a text single.
    """
    return F.transform(F.array(value), fn)[0]


def _starts(matches: Column, gaps: Column) -> Column:
    init = F.struct(F.lit(0).alias("pos"), F.array().cast(T.ArrayType(T.IntegerType())).alias("starts"))
    return F.aggregate(
        F.transform(matches, lambda m, i: F.struct(F.length(m).alias("ml"), F.length(gaps[i]).alias("gl"))),
        init,
        lambda acc, p: F.struct(
            (acc["pos"] + p["gl"] + p["ml"]).alias("pos"),
            F.array_append(acc["starts"], acc["pos"] + p["gl"]).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end,value,match>> of all non-overlapping matches.

    ``group`` > 0 reports that capture group; the pattern must be written so the
    group is a suffix of the match (cue first, value last), which holds for every
    context pattern used here. Null text gives null.
    """
    pat = F.lit(pattern)
    parts = [
        F.regexp_extract_all(text, pat, F.lit(0)).alias("m"),
        F.split(text, pattern, -1).alias("g"),
    ]
    if group:
        parts.append(F.regexp_extract_all(text, pat, F.lit(group)).alias("k"))

    def build(b: Column) -> Column:
        def with_starts(st: Column) -> Column:
            if not group:
                return F.transform(
                    b["m"],
                    lambda m, i: F.struct(
                        st[i].alias("start"), (st[i] + F.length(m)).alias("end"), m.alias("value"), m.alias("match")
                    ),
                )
            return F.transform(
                b["m"],
                lambda m, i: F.struct(
                    (st[i] + F.length(m) - F.length(b["k"][i])).alias("start"),
                    (st[i] + F.length(m)).alias("end"),
                    b["k"][i].alias("value"),
                    m.alias("match"),
                ),
            )

        return let(_starts(b["m"], b["g"]), with_starts)

    return F.when(text.isNotNull(), let(F.struct(*parts), build))


#: Code points that are no characters, set round matches; ``without_marks`` takes them out of a text.
MARK, INNER = "\ufdd0", "\ufdd1"


def without_marks(text: Column) -> Column:
    """``text`` with another such code point in place of the marks: as long, and safe for ``marked_spans``."""
    return F.when(text.contains(MARK) | text.contains(INNER), F.translate(text, MARK + INNER, "\ufdd2\ufdd2")).otherwise(text)


def marked_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """The same as ``spans`` for a text without marks, in one scan by the pattern: every match is set between marks,
    then the text is cut at them, which takes no pattern. Gaps and matches alternate."""
    inside = f"$0{INNER}${group}" if group else "$0"
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(MARK + inside + MARK)), MARK, -1)

    def cut(p: Column) -> Column:
        found, gaps = F.filter(p, lambda x, i: i % 2 == 1), F.filter(p, lambda x, i: i % 2 == 0)
        if not group:
            return let(F.struct(found.alias("m"), gaps.alias("g")), build)
        whole = F.transform(found, lambda x: F.substring_index(x, INNER, 1))
        return let(F.struct(whole.alias("m"), F.transform(found, lambda x: F.substring_index(x, INNER, -1)).alias("k"), gaps.alias("g")), build)

    def build(b: Column) -> Column:
        value = (lambda m, i: b["k"][i]) if group else (lambda m, i: m)
        return let(_starts(b["m"], b["g"]), lambda st: F.transform(b["m"], lambda m, i: F.struct(
            (st[i] + F.length(m) - F.length(value(m, i)) if group else st[i]).alias("start"), (st[i] + F.length(m)).alias("end"),
            value(m, i).alias("value"), m.alias("match"))))

    return F.when(text.isNotNull(), let(pieces, cut))


def gated_marked_spans(text: Column, pattern: str, gate: Column | None = None, group: int = 0) -> Column:
    """``marked_spans`` evaluated only where the cheap ``gate`` predicate holds (CASE WHEN is lazy)."""
    if gate is None:
        return F.coalesce(marked_spans(text, pattern, group), empty_spans())
    return F.when(gate, marked_spans(text, pattern, group)).otherwise(empty_spans())


def empty_spans() -> Column:
    return F.array().cast(SPAN_TYPE)


def gated_spans(text: Column, pattern: str, gate: Column | None = None, group: int = 0) -> Column:
    """``spans`` evaluated only where the cheap ``gate`` predicate holds (CASE WHEN is lazy)."""
    if gate is None:
        return F.coalesce(spans(text, pattern, group), empty_spans())
    return F.when(gate, spans(text, pattern, group)).otherwise(empty_spans())


def first_span(text: Column, pattern: str) -> Column:
    """First match only: start from the length of the text before it (``split`` with limit 2)."""
    m = F.regexp_extract(text, pattern, 0)
    before = F.split(text, pattern, 2)[0]
    return F.when(
        text.rlike(pattern),
        F.struct(
            F.length(before).alias("start"),
            (F.length(before) + F.length(m)).alias("end"),
            m.alias("value"),
            m.alias("match"),
        ),
    )
