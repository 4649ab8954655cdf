"""Checksum and shape predicates as Spark column expressions (I1-I7, I13 helpers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import fixed as X


def digits_of(value: Column) -> Column:
    """Keep only the ASCII digits."""
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn_ok(value: Column) -> Column:
    """13-19 digits, not all zero, mod-10 checksum (built-in ``luhn_check``)."""
    d = digits_of(value)
    return F.length(d).between(13, 19) & d.rlike("[1-9]") & F.call_function("luhn_check", d)


def _flat_literal(table: list[list[int]]) -> Column:
    return F.array(*[F.lit(v) for row in table for v in row])


def verhoeff_ok(value: Column) -> Column:
    """Verhoeff checksum over the digits (dihedral-group tables), folded with ``aggregate``."""
    d = digits_of(value)
    rev = F.reverse(d)
    dt = _flat_literal(X.VERHOEFF_D)
    pt = _flat_literal(X.VERHOEFF_P)
    n = F.length(d)
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    check = F.aggregate(
        idx,
        F.lit(0),
        lambda c, i: F.element_at(
            dt,
            c * 10
            + F.element_at(pt, (i % 8) * 10 + F.substring(rev, i + 1, 1).cast("int") + 1)
            + 1,
        ),
    )
    return (n > 0) & (check == 0)


def ssa_ok(area: Column, group: Column, serial: Column) -> Column:
    """I4: area not 000 / 666 / 900-999, group not 00, serial not 0000."""
    a = area.cast("int")
    return (a != 0) & (a != 666) & ~a.between(900, 999) & (group != "00") & (serial != "0000")


def octets_ok(value: Column) -> Column:
    """Four dot-separated octets, each 0-255."""
    parts = F.split(value, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda o: o.cast("int").between(0, 255))


def looks_like_date(value: Column) -> Column:
    """ISO-shaped date text."""
    return value.rlike(X.PHONE_DATE_SHAPE)
