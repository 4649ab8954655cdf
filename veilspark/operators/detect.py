"""Pattern detectors (C1-C9) and the detector registry.

Every detector is a plain function ``text Column -> array<entity> Column``. The
registry concatenates the arrays of the chosen detectors inside one ``select`` so a
text is read once per pattern, inside whole-stage pipelines, with no shuffle.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import checks
from veilspark.functions import fixed as X
from veilspark.functions.entity import (
    empty_entities,
    keep_not_contained,
    keep_not_overlapping,
    make_entity,
    number_seq,
    sort_by_start,
)
from veilspark.functions.spans import SPAN_TYPE, gated_spans, let, spans

SPAN_ELEM = SPAN_TYPE.elementType

#: The first error of a row's detectors, as ``DetectorSet.apply`` leaves it.
ERROR_COL = "__error"
ERROR_TYPE = "struct<type:string,text:string>"

# Built column expressions: building a detector costs thousands of JVM round trips, while the
# resulting unresolved expression can be reused by any DataFrame of the same session that has the
# same text column name. The key holds the builder function itself, so it can't be taken for
# another one; the least recently used expressions go first.
_EXPR_CACHE: OrderedDict = OrderedDict()
_EXPR_CACHE_SIZE = 128


def cached_expr(df: DataFrame, maker: Callable, text_col: str, build: Callable[[], Column]) -> Column:
    key = (df.sparkSession, maker, text_col)
    if key not in _EXPR_CACHE:
        _EXPR_CACHE[key] = build()
        while len(_EXPR_CACHE) > _EXPR_CACHE_SIZE:
            _EXPR_CACHE.popitem(last=False)
    _EXPR_CACHE.move_to_end(key)
    return _EXPR_CACHE[key]


def _char_at(text: Column, pos0: Column) -> Column:
    """Character at 0-based offset (empty string outside the text)."""
    return F.when((pos0 >= 0) & (pos0 < F.length(text)), F.substring(text, pos0 + 1, 1)).otherwise(F.lit(""))


def _is_digit(ch: Column) -> Column:
    return ch.rlike("^[0-9]$")


# ---------------------------------------------------------------------------
# C1 / C2 email
# ---------------------------------------------------------------------------
def detect_email_expr(text: Column) -> Column:
    def trim_tail(arr: Column) -> Column:
        arr = F.transform(arr, lambda s: s.withField("value", F.regexp_replace(s["value"], r"[.,;:!?)]+$", "")))
        return F.transform(arr, lambda s: s.withField("end", s["start"] + F.length(s["value"])))

    valid_std = F.filter(
        trim_tail(spans(text, X.EMAIL_PATTERN, 1)),
        lambda s: s["value"].contains("@") & F.substring_index(s["value"], "@", -1).contains("."),
    )

    def build(valid: Column) -> Column:
        obf_kept = keep_not_overlapping(trim_tail(spans(text, X.EMAIL_OBFUSCATED_PATTERN, 1)), valid, SPAN_ELEM)
        std_e = F.transform(
            valid, lambda s: make_entity("EMAIL", s["start"], s["end"], s["value"], X.CONFIDENCE["EMAIL"])
        )
        obf_e = F.transform(
            obf_kept,
            lambda s: make_entity("EMAIL", s["start"], s["end"], s["value"], X.CONFIDENCE["EMAIL_OBFUSCATED"]),
        )
        return F.concat(std_e, obf_e)

    out = let(valid_std, build)
    # '@' for plain addresses; for the obfuscated form a bracketed "at" or " at word." / " at word dot".
    gate = text.contains("@") | text.rlike(
        r"(?i)\[at\]|\(at\)|\sat\s+[a-z0-9.-]+(?:\.[a-z]|\s*\[dot\]|\s*\(dot\)|\s+dot\s)"
    )
    return F.when(gate, out).otherwise(empty_entities())


# ---------------------------------------------------------------------------
# C3 phone
# ---------------------------------------------------------------------------
def detect_phone_expr(text: Column) -> Column:
    cands = F.concat(*[spans(text, p, 0) for p in X.PHONE_PATTERNS])
    # Trimming of quotes / punctuation / unbalanced closing brackets: the patterns start
    # with '+', '(' or a digit and end in a digit, so only the bracket rule can apply.
    cands = F.filter(
        cands,
        lambda s: F.length(checks.digits_of(s["value"])).between(10, 15) & ~checks.looks_like_date(s["value"]),
    )
    kept = sort_by_start(keep_not_contained(cands, SPAN_ELEM))
    out = F.transform(kept, lambda s: make_entity("PHONE", s["start"], s["end"], s["value"], X.CONFIDENCE["PHONE"]))
    return F.when(ten_digits(text), out).otherwise(empty_entities())


def ten_digits(text: Column) -> Column:
    """Necessary for a phone number: ten digits anywhere, with any separators."""
    return text.rlike("[0-9]") & (F.regexp_count(text, F.lit("[0-9]")) >= 10)


# ---------------------------------------------------------------------------
# C4 SSN
# ---------------------------------------------------------------------------
def detect_ssn_expr(text: Column) -> Column:
    s = gated_spans(text, X.SSN_PATTERN, text.rlike(r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}"))
    ok = F.filter(
        s,
        lambda m: checks.ssa_ok(
            F.substring(m["value"], 1, 3), F.substring(m["value"], 5, 2), F.substring(m["value"], 8, 4)
        ),
    )
    return F.transform(ok, lambda m: make_entity("SSN", m["start"], m["end"], m["value"], X.CONFIDENCE["SSN"]))


# ---------------------------------------------------------------------------
# C5 payment card
# ---------------------------------------------------------------------------
def detect_card_expr(text: Column, check_luhn: bool = True) -> Column:
    s = gated_spans(text, X.CARD_PATTERN, text.rlike(r"[0-9]{4}"))

    def bounded(m: Column) -> Column:
        b1 = _char_at(text, m["start"] - 1)
        b2 = _char_at(text, m["start"] - 2)
        a1 = _char_at(text, m["end"])
        a2 = _char_at(text, m["end"] + 1)
        before_bad = _is_digit(b1) | ((b1 == "-") & _is_digit(b2))
        after_bad = _is_digit(a1) | ((a1 == "-") & _is_digit(a2))
        cond = ~before_bad & ~after_bad
        if check_luhn:
            cond = cond & checks.luhn_ok(m["value"])
        return cond

    ok = F.filter(s, bounded)
    return F.transform(
        ok, lambda m: make_entity("CREDIT_CARD", m["start"], m["end"], m["value"], X.CONFIDENCE["CREDIT_CARD"])
    )


# ---------------------------------------------------------------------------
# C6 IPv4
# ---------------------------------------------------------------------------
def detect_ipv4_expr(text: Column) -> Column:
    s = gated_spans(text, X.IPV4_PATTERN, text.rlike(r"[0-9]\.[0-9]"))
    ok = F.filter(s, lambda m: checks.octets_ok(m["value"]))
    return F.transform(
        ok, lambda m: make_entity("IP_ADDRESS", m["start"], m["end"], m["value"], X.CONFIDENCE["IP_ADDRESS"])
    )


# ---------------------------------------------------------------------------
# C7 API keys
# ---------------------------------------------------------------------------
def detect_api_key_expr(text: Column) -> Column:
    cands = F.concat(*[spans(text, p, 0) for p in X.API_KEY_PATTERNS])
    kept = sort_by_start(keep_not_contained(cands, SPAN_ELEM))
    out = F.transform(
        kept,
        lambda m: make_entity(
            "API_KEY", m["start"], m["end"], m["value"], X.CONFIDENCE["API_KEY"], category=X.CREDENTIAL
        ),
    )
    gate = F.lit(False)
    for lit_ in ["sk-", "AKIA", "ghp_", "github_pat_", "sk_", "rk_"]:
        gate = gate | text.contains(lit_)
    gate = gate | F.lower(text).contains("bearer")
    return F.when(gate, out).otherwise(empty_entities())


# ---------------------------------------------------------------------------
# C8 PAN, C9 Aadhaar
# ---------------------------------------------------------------------------
def detect_pan_expr(text: Column) -> Column:
    s = gated_spans(text, X.PAN_PATTERN, text.rlike(r"[A-Z]{5}[0-9]{4}[A-Z]"))
    return F.transform(s, lambda m: make_entity("PAN_CARD", m["start"], m["end"], m["value"], X.CONFIDENCE["PAN_CARD"]))


def detect_aadhaar_expr(text: Column, check_verhoeff: bool = True) -> Column:
    s = gated_spans(text, X.AADHAAR_PATTERN, text.rlike(r"[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}"), group=1)
    cond = lambda m: F.length(checks.digits_of(m["value"])) == 12
    if check_verhoeff:
        ok = F.filter(s, lambda m: cond(m) & checks.verhoeff_ok(m["value"]))
    else:
        ok = F.filter(s, cond)
    return F.transform(ok, lambda m: make_entity("AADHAAR", m["start"], m["end"], m["value"], X.CONFIDENCE["AADHAAR"]))


# ---------------------------------------------------------------------------
# Registry
# ---------------------------------------------------------------------------
@dataclass
class Detector:
    """A named detector.

    ``fn(text) -> array<entity>`` for single-expression detectors, or
    ``df_fn(df, text_col, out_col) -> df`` for staged ones (the context chain).
    ``types`` lists the types it may emit (for B6 / Q16).
    """

    name: str
    fn: Callable[[Column], Column] | None = None
    types: tuple[str, ...] = ()
    # Filter output by enabled type (our fix of Q16 for the context detector).
    filter_types: bool = False
    df_fn: Callable | None = None
    # Column in which ``df_fn`` leaves the error (type and text) of a row it failed on.
    error_col: str | None = None


@dataclass
class DetectorSet:
    """Ordered detectors. Order is the tie-break rank (``det_rank``) of overlap resolution."""

    detectors: list[Detector] = field(default_factory=list)
    enabled_types: frozenset[str] | None = None

    def register(self, det: Detector, priority: bool = False) -> "DetectorSet":
        """Add a detector first (priority) or last; only changes the built plan."""
        if priority:
            self.detectors.insert(0, det)
        else:
            self.detectors.append(det)
        return self

    def copy(self) -> "DetectorSet":
        return DetectorSet(list(self.detectors), self.enabled_types)

    def apply(self, df: DataFrame, text_col: str, out_col: str = "entities") -> DataFrame:
        """One concatenated entity array for all detectors (one pass, no unions)."""
        text = F.col(text_col)
        tmp = []
        for rank, det in enumerate(self.detectors):
            col = f"__det_{rank}"
            if det.df_fn is not None:
                df = det.df_fn(df, text_col, col)
            else:
                expr = cached_expr(df, det.fn, text_col, lambda: F.coalesce(det.fn(text), empty_entities()))
                df = df.withColumn(col, expr)
            tmp.append((rank, det, col))
        parts = []
        for rank, det, col in tmp:
            arr = F.col(col)
            if det.filter_types and self.enabled_types is not None:
                allowed = F.array(*[F.lit(t) for t in sorted(self.enabled_types)])
                arr = F.filter(arr, lambda e: F.array_contains(allowed, e["pii_type"]))
            parts.append(number_seq(arr, rank))
        if not parts:
            out = empty_entities()
        else:
            out = F.concat(*parts) if len(parts) > 1 else parts[0]
        failed = [det.error_col for _, det, _ in tmp if det.error_col]
        df = df.withColumn(ERROR_COL, F.coalesce(*[F.col(c) for c in failed], F.lit(None).cast(ERROR_TYPE)) if failed else F.lit(None).cast(ERROR_TYPE))
        # Empty / null text gives no entities.
        out = F.when(F.coalesce(F.length(text), F.lit(0)) > 0, out).otherwise(empty_entities())
        return df.withColumn(out_col, out).drop(*[c for _, _, c in tmp], *failed)


PATTERN_DETECTORS = {
    "EMAIL": lambda cfg: Detector("email", detect_email_expr, ("EMAIL",)),
    "PHONE": lambda cfg: Detector("phone", detect_phone_expr, ("PHONE",)),
    "SSN": lambda cfg: Detector("ssn", detect_ssn_expr, ("SSN",)),
    "CREDIT_CARD": lambda cfg: Detector(
        "card", lambda t: detect_card_expr(t, cfg.get("check_luhn", True)), ("CREDIT_CARD",)
    ),
    "IP_ADDRESS": lambda cfg: Detector("ipv4", detect_ipv4_expr, ("IP_ADDRESS",)),
    "API_KEY": lambda cfg: Detector("api_key", detect_api_key_expr, ("API_KEY",)),
    "PAN_CARD": lambda cfg: Detector("pan", detect_pan_expr, ("PAN_CARD",)),
    "AADHAAR": lambda cfg: Detector(
        "aadhaar", lambda t: detect_aadhaar_expr(t, cfg.get("check_verhoeff", True)), ("AADHAAR",)
    ),
}


def default_detectors(
    enabled_types=None,
    check_luhn: bool = True,
    check_verhoeff: bool = True,
    enable_context: bool = True,
    filter_context_types: bool = True,
) -> DetectorSet:
    """Choose detectors by config; un-chosen ones never enter the plan."""
    enabled = frozenset(enabled_types) if enabled_types is not None else frozenset(X.ALL_TYPES)
    cfg = {"check_luhn": check_luhn, "check_verhoeff": check_verhoeff}
    ds = DetectorSet(enabled_types=enabled)
    for t, make in PATTERN_DETECTORS.items():
        if t in enabled:
            ds.register(make(cfg))
    if enable_context:
        from veilspark.operators.context import add_context_entities

        ds.register(
            Detector("context", None, tuple(X.ALL_TYPES), filter_types=filter_context_types, df_fn=add_context_entities)
        )
    return ds


def pattern_only(kinds) -> DetectorSet:
    return default_detectors(enabled_types=kinds, enable_context=False)


# ---------------------------------------------------------------------------
# DataFrame-level operators
# ---------------------------------------------------------------------------
def with_entities(df: DataFrame, text_col: str, detectors: DetectorSet, out_col: str = "entities") -> DataFrame:
    """Add ``out_col`` = array<entity> for ``text_col`` (narrow transformation)."""
    return detectors.apply(df, text_col, out_col).drop(ERROR_COL)


def explode_entities(df: DataFrame, key_cols: list[str], arr_col: str = "entities") -> DataFrame:
    """Array of entities -> one row per entity (generator, no shuffle)."""
    # ``inline_outer`` + a filter above it: a plain generator makes Catalyst infer
    # ``size(arr) > 0`` and push it under the projections, copying the whole detector
    # expression into the filter.
    return df.select(*key_cols, F.inline_outer(arr_col)).filter(F.col("pii_type").isNotNull())


def detect(df: DataFrame, text_col: str, key_cols: list[str], detectors: DetectorSet) -> DataFrame:
    """``detect_x(df, text_col, key_cols) -> entities`` (one row per entity)."""
    return explode_entities(with_entities(df.select(*key_cols, text_col), text_col, detectors), key_cols)


def detect_kind(df: DataFrame, text_col: str, key_cols: list[str], kind: str, **cfg) -> DataFrame:
    det = PATTERN_DETECTORS[kind](cfg)
    return detect(df, text_col, key_cols, DetectorSet([det]))


def prefilter(df: DataFrame, text_col: str, kinds) -> DataFrame:
    """Keep rows that can hold a match of any chosen kind (cheap necessary patterns)."""
    cheap = {
        "EMAIL": "@|(?i)\\bat\\b|\\[at\\]|\\(at\\)",
        "SSN": "[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}",
        "CREDIT_CARD": "[0-9]{4}",
        "IP_ADDRESS": "[0-9]\\.[0-9]",
        "API_KEY": "sk-|AKIA|ghp_|github_pat_|sk_|rk_|(?i)bearer",
        "PAN_CARD": "[A-Z]{5}[0-9]{4}[A-Z]",
        "AADHAAR": "[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}",
    }
    conds = [ten_digits(F.col(text_col)) if k == "PHONE" else F.col(text_col).rlike(cheap[k]) for k in kinds]
    return df.filter(reduce(lambda a, b: a | b, conds, F.lit(False)))
