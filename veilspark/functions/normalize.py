"""Evasion defence on text.

Spark has no NFKC function, so normalisation is the one Arrow UDF in the
data path; pure-ASCII values never reach it. Dropping
invisible code points and escaping forged token brackets are plain JVM expressions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import fixed as X

#: Texts that a Python worker holds as Python strings at a time; the rest of its batch stays in Arrow's buffers.
SLICE = 64


def by_slices(texts: pa.Array, fn: Callable[[list], list], kind: pa.DataType) -> pa.Array:
    """``fn`` over an Arrow array, slice after slice."""
    done = [pa.array(fn(texts.slice(at, SLICE).to_pylist()), kind) for at in range(0, len(texts), SLICE)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    def one(v: str | None) -> str | None:
        return v if v is None or v.isascii() else unicodedata.normalize("NFKC", v)

    return by_slices(texts, lambda part: [one(v) for v in part], pa.string())


def strip_invisible(text: Column) -> Column:
    """Drop the nine invisible code points (``translate`` with an empty target deletes)."""
    gone = "".join(X.INVISIBLE_CHARS)
    return F.when(text.rlike(f"[{gone}]"), F.translate(text, gone, "")).otherwise(text)


def normalize_unicode(text: Column, use_nfkc: bool = True) -> Column:
    """NFKC (Arrow UDF) then strip invisible characters. Plain ASCII texts, which NFKC leaves as
    they are and which hold no invisible character, go to Python as nulls and are not walked again."""
    odd = text.rlike(r"[^\x00-\x7F]")
    t = F.coalesce(nfkc(F.when(odd, text)), text) if use_nfkc else text
    return F.when(odd, strip_invisible(t)).otherwise(text)


def escape_delimiters(text: Column, prefix: str = X.TOKEN_PREFIX, suffix: str = X.TOKEN_SUFFIX) -> Column:
    """Token brackets that arrive in the input become visible markers, so nobody can forge a token."""
    return F.replace(F.replace(text, F.lit(prefix), F.lit(X.FORGED_PREFIX_MARK)), F.lit(suffix), F.lit(X.FORGED_SUFFIX_MARK))
