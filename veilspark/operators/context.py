"""Context detectors (B9-B13, C10-C27) as Spark column expressions.

The stages run in a fixed order because several of them skip a candidate whose span
was already reported by an earlier stage (same span, or inside one). Each stage's
result is bound once with ``let`` and handed to the next stage, so the whole chain is
a single projection over the text column: no Python, no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import checks
from veilspark.functions import fixed as X
from veilspark.functions.entity import contains_span, empty_entities, make_entity
from veilspark.functions.spans import first_span, let, spans

W = X.CONTEXT_WINDOW_CHARS

REL_STRUCT = T.StructType(
    [
        T.StructField("subject", T.StringType()),
        T.StructField("predicate", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

CATEGORY_OF = {t: X.CREDENTIAL for t in X.CREDENTIAL_TYPES}
CATEGORY_OF.update({t: X.BUSINESS_CONFIDENTIAL for t in X.BUSINESS_TYPES})
CATEGORY_OF.update({t: X.PERSONAL_INFO for t in X.PERSONAL_TYPES})


# ---------------------------------------------------------------------------
# B10 / B11 / B12 / B13 helpers
# ---------------------------------------------------------------------------
def context_window(text: Column, start: Column, end: Column, n: int = W) -> Column:
    """Lower-cased text from ``start - n`` to ``end + n`` (clipped)."""
    lo = F.greatest(start - n, F.lit(0))
    hi = F.least(end + n, F.length(text))
    return F.lower(F.substring(text, lo + 1, hi - lo))


def _whole_word(phrase: str) -> bool:
    return len(phrase) <= 4 and " " not in phrase


def phrase_hit(lower_text: Column, phrase: str) -> Column:
    """One phrase on already lower-cased text: word-bounded when short and single-word."""
    if _whole_word(phrase):
        return lower_text.rlike(r"\b" + re.escape(phrase) + r"\b")
    return lower_text.contains(phrase)


def phrase_regex(phrases: list[str]) -> str:
    alts = [(r"\b" + re.escape(p) + r"\b") if _whole_word(p) else re.escape(p) for p in phrases]
    return "(?:" + "|".join(alts) + ")"


def has_phrase(lower_text: Column, pii_type: str) -> Column:
    """B11 (boolean): any phrase of the type, as one alternation regex."""
    return lower_text.rlike(phrase_regex(X.PHRASES[pii_type]))


def first_phrase(lower_text: Column, pii_type: str) -> Column:
    """B11 (evidence): first phrase of the type in list order that is present."""
    return F.coalesce(*[F.when(phrase_hit(lower_text, p), F.lit(p)) for p in X.PHRASES[pii_type]])


def operational_stop(window: Column, value: Column, prefixes: tuple[str, str]) -> Column:
    """A stop-phrase is present and ``<prefix> value`` occurs in the window."""
    any_stop = F.lit(False)
    for s in X.OPERATIONAL_STOPWORDS:
        any_stop = any_stop | window.contains(s)
    near = window.contains(F.concat(F.lit(prefixes[0]), value)) | window.contains(F.concat(F.lit(prefixes[1]), value))
    return any_stop & near


def name_stop(value: Column) -> Column:
    """A word of the candidate is a name stop word."""
    words = F.split(F.lower(value), r"\s+")
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in X.NAME_STOPWORDS]))


def _rel_struct(text: Column) -> Column:
    p = F.lit(X.RELATIONSHIP_PATTERN)
    parts = F.struct(
        F.regexp_extract_all(text, p, F.lit(1)).alias("a"),
        F.regexp_extract_all(text, p, F.lit(2)).alias("b"),
        F.regexp_extract_all(text, p, F.lit(3)).alias("c"),
    )
    return let(
        parts,
        lambda z: F.transform(
            z["a"],
            lambda s, i: F.struct(
                F.trim(s).alias("subject"),
                F.lower(F.trim(z["b"][i])).alias("predicate"),
                F.trim(z["c"][i]).alias("value"),
            ),
        ),
    )


def related_subject(rels: Column, value: Column, hints: list[str]) -> Column:
    """First relationship whose value equals the candidate or whose predicate names a hint."""
    def ok(r: Column) -> Column:
        c = r["value"] == value
        for h in hints:
            c = c | r["predicate"].contains(h)
        return c

    return F.get(F.filter(rels, ok), 0)["subject"]


def extract_relationships(df, text_col: str, key_cols: list[str]):
    """C27 as a table: one row per (subject, predicate, value) triple."""
    return df.select(*key_cols, F.explode(_rel_struct(F.col(text_col))).alias("r")).select(*key_cols, "r.*")


# ---------------------------------------------------------------------------
# Stage helpers
# ---------------------------------------------------------------------------
def _same_span_exists(acc: Column, s: Column) -> Column:
    return F.exists(acc, lambda e: (e["start"] == s["start"]) & (e["end"] == s["end"]))


def _inside_existing(acc: Column, s: Column) -> Column:
    return F.exists(acc, lambda e: contains_span(e, s))


def _ent(t, s, conf, evidence, related=None):
    return make_entity(t, s["start"], s["end"], s["value"], conf, CATEGORY_OF.get(t, X.PERSONAL_INFO), evidence, related)


# ---------------------------------------------------------------------------
# C10 transmission intent
# ---------------------------------------------------------------------------
def intent_entities(text: Column, lower: Column | None = None) -> Column:
    lower = F.lower(text) if lower is None else lower
    has_verb = F.lit(False)
    for v in X.SEND_VERBS:
        has_verb = has_verb | lower.contains(v)
    has_target = F.lit(False)
    for t in X.EXTERNAL_TARGETS:
        has_target = has_target | lower.contains(t)
    ordered = [
        (t, p)
        for t, phrases in X.PHRASES.items()
        if CATEGORY_OF.get(t) in (X.CREDENTIAL, X.BUSINESS_CONFIDENTIAL)
        for p in phrases
    ]
    hit = F.coalesce(
        *[F.when(phrase_hit(lower, p), F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"))) for t, p in ordered]
    )

    def build(h: Column) -> Column:
        idx = F.call_function("locate", h["p"], lower) - 1
        ln = F.length(h["p"])
        cat = F.coalesce(
            F.element_at(F.create_map(*[x for t in X.PHRASES for x in (F.lit(t), F.lit(CATEGORY_OF[t]))]), h["t"]),
            F.lit(X.CREDENTIAL),
        )
        e = make_entity(
            h["t"], idx, idx + ln, F.substring(text, idx + 1, ln), X.CONTEXT_CONFIDENCE["INTENT"], cat,
            "asks to send it to an outside target",
        )
        return F.when(h.isNotNull(), F.array(e)).otherwise(empty_entities())

    return F.when(has_verb & has_target, let(hit, build)).otherwise(empty_entities())


# ---------------------------------------------------------------------------
# C11-C14 candidates with a context window
# ---------------------------------------------------------------------------
def _windowed(text: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(
        F.coalesce(spans(text, pattern, group), F.array().cast("array<struct<start:int,end:int,value:string,match:string>>")),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
                           context_window(text, s["start"], s["end"]).alias("w")),
    )


def pin_entities(text: Column, rels: Column) -> Column:
    cands = F.filter(
        _windowed(text, X.PIN_CANDIDATE),
        lambda c: ~operational_stop(c["w"], c["value"], ("port ", "year ")) & has_phrase(c["w"], "PIN"),
    )
    return F.transform(
        cands,
        lambda c: _ent(
            "PIN", c, X.CONTEXT_CONFIDENCE["PIN"],
            F.concat(F.lit("PIN cue nearby ("), first_phrase(c["w"], "PIN"), F.lit(")")),
            related_subject(rels, c["value"], X.PIN_SUBJECT_HINTS),
        ),
    )


def password_entities(text: Column) -> Column:
    s = F.coalesce(spans(text, X.PASSWORD_PATTERN, 1), F.array().cast("array<struct<start:int,end:int,value:string,match:string>>"))
    reject = F.array(*[F.lit(w) for w in X.PASSWORD_REJECT_WORDS])
    ok = F.filter(s, lambda m: (F.length(m["value"]) >= 4) & ~F.array_contains(reject, F.lower(m["value"])))
    return F.transform(
        ok, lambda m: _ent("PASSWORD", m, X.CONTEXT_CONFIDENCE["PASSWORD"], "follows a password cue")
    )


def cvv_entities(text: Column, acc: Column) -> Column:
    cands = F.filter(
        _windowed(text, X.CVV_CANDIDATE),
        lambda c: ~_same_span_exists(acc, c) & has_phrase(c["w"], "CVV"),
    )
    return F.transform(
        cands,
        lambda c: _ent(
            "CVV", c, X.CONTEXT_CONFIDENCE["CVV"],
            F.concat(F.lit("CVV cue nearby ("), first_phrase(c["w"], "CVV"), F.lit(")")),
        ),
    )


def otp_entities(text: Column, acc: Column) -> Column:
    cands = F.filter(
        _windowed(text, X.OTP_CANDIDATE),
        lambda c: ~_same_span_exists(acc, c) & has_phrase(c["w"], "OTP"),
    )
    return F.transform(
        cands, lambda c: _ent("OTP", c, X.CONTEXT_CONFIDENCE["OTP"], "one-time code cue nearby")
    )


# ---------------------------------------------------------------------------
# C15-C17 first-marker detectors
# ---------------------------------------------------------------------------
def _first_literal_marker(
    text: Column, markers: list[tuple[str, str]], conf: float, evidence: str, lower: Column | None = None
) -> Column:
    lower = F.lower(text) if lower is None else lower
    hit = F.coalesce(
        *[F.when(lower.contains(m), F.struct(F.lit(m).alias("m"), F.lit(t).alias("t"))) for m, t in markers]
    )

    def build(h: Column) -> Column:
        idx = F.call_function("locate", h["m"], lower) - 1
        ln = F.length(h["m"])
        e = make_entity(h["t"], idx, idx + ln, F.substring(text, idx + 1, ln), conf, X.BUSINESS_CONFIDENTIAL, evidence)
        return F.when(h.isNotNull(), F.array(e)).otherwise(empty_entities())

    return let(hit, build)


def system_prompt_entities(text: Column, lower: Column | None = None) -> Column:
    return _first_literal_marker(
        text, [(m, "INTERNAL_SYSTEM_INSTRUCTIONS") for m in X.SYSTEM_PROMPT_MARKERS],
        X.CONTEXT_CONFIDENCE["INTERNAL_SYSTEM_INSTRUCTIONS"], "names system instructions",
        lower,
    )


def db_marker_entities(text: Column, lower: Column | None = None) -> Column:
    return _first_literal_marker(
        text, X.DB_MARKERS, X.CONTEXT_CONFIDENCE["DB"], "names a database or staff records", lower
    )


def source_code_entities(text: Column) -> Column:
    # (?d): only '\n' ends a line for '.', as in Python; (?i) as in the marker search.
    pats = ["(?di)" + p for p in X.SOURCE_CODE_MARKERS]
    hit = F.coalesce(*[first_span(text, p) for p in pats])
    e = make_entity(
        "CONFIDENTIAL_SOURCE_CODE", hit["start"], hit["end"], hit["value"], X.CONTEXT_CONFIDENCE["CONFIDENTIAL_SOURCE_CODE"],
        X.BUSINESS_CONFIDENTIAL, "looks like source code",
    )
    return F.when(hit.isNotNull(), F.array(e)).otherwise(empty_entities())


# ---------------------------------------------------------------------------
# C18-C24 cue + value detectors
# ---------------------------------------------------------------------------
_EMPTY_SPANS = "array<struct<start:int,end:int,value:string,match:string>>"


def _cue_spans(text: Column, pattern: str) -> Column:
    return F.coalesce(spans(text, pattern, 1), F.array().cast(_EMPTY_SPANS))


def medical_entities(text: Column) -> Column:
    return F.transform(
        _cue_spans(text, X.MEDICAL_PATTERN),
        lambda m: _ent("MEDICAL_DIAGNOSIS", m, X.CONTEXT_CONFIDENCE["MEDICAL_DIAGNOSIS"], "follows a diagnosis cue"),
    )


def salary_entities(text: Column) -> Column:
    return F.transform(
        _cue_spans(text, X.SALARY_PATTERN),
        lambda m: _ent("SALARY_INFO", m, X.CONTEXT_CONFIDENCE["SALARY_INFO"], "follows a pay cue"),
    )


def dob_entities(text: Column, acc: Column) -> Column:
    ok = F.filter(_cue_spans(text, X.DOB_PATTERN), lambda m: ~_same_span_exists(acc, m))
    return F.transform(
        ok,
        lambda m: _ent("DATE_OF_BIRTH", m, X.CONTEXT_CONFIDENCE["DATE_OF_BIRTH"],
                       "date after a birth cue"),
    )


def licence_entities(text: Column, acc: Column) -> Column:
    stops = F.array(*[F.lit(s) for s in X.OPERATIONAL_STOPWORDS])
    ok = F.filter(
        _cue_spans(text, X.LICENCE_PATTERN),
        lambda m: m["value"].rlike("[0-9]") & ~F.array_contains(stops, F.lower(m["value"])) & ~_same_span_exists(acc, m),
    )
    return F.transform(
        ok, lambda m: _ent("DRIVERS_LICENSE", m, X.CONTEXT_CONFIDENCE["DRIVERS_LICENSE"], "follows a driving licence cue")
    )


def name_entities(text: Column, acc: Column) -> Column:
    ok = F.filter(
        _cue_spans(text, X.PERSON_NAME_PATTERN),
        lambda m: ~name_stop(m["value"]) & ~_inside_existing(acc, m),
    )
    return F.transform(
        ok,
        lambda m: _ent("PERSON_NAME", m, X.CONTEXT_CONFIDENCE["PERSON_NAME"],
                       "capitalised name after a role or name cue"),
    )


def passport_entities(text: Column, acc: Column) -> Column:
    ok = F.filter(_cue_spans(text, X.PASSPORT_PATTERN), lambda m: ~_same_span_exists(acc, m))
    return F.transform(ok, lambda m: _ent("PASSPORT", m, X.CONTEXT_CONFIDENCE["PASSPORT"], "follows a passport cue"))


def ssn_context_entities(text: Column, acc: Column) -> Column:
    allow = F.array(*[F.lit(v) for v in X.SSN_CONTEXT_ALLOW])

    def valid(m: Column) -> Column:
        parts = F.split(m["value"], "[- ]")
        area = F.get(parts, 0).cast("int")
        rules_ok = (
            (area != 0) & (area != 666) & (F.get(parts, 1) != "00") & (F.get(parts, 2) != "0000")
            & ~(area.between(900, 999) & ~F.array_contains(allow, m["value"]))
        )
        return F.when(F.size(parts) == 3, rules_ok).otherwise(F.lit(True))

    ok = F.filter(_cue_spans(text, X.SSN_CONTEXT_PATTERN), lambda m: valid(m) & ~_inside_existing(acc, m))
    return F.transform(ok, lambda m: _ent("SSN", m, X.CONTEXT_CONFIDENCE["SSN"], "follows an SSN cue"))


# ---------------------------------------------------------------------------
# C25 / C26 Indian identifiers in context
# ---------------------------------------------------------------------------
def aadhaar_context_entities(text: Column, acc: Column, rels: Column) -> Column:
    cands = F.filter(
        _windowed(text, X.AADHAAR_PATTERN),
        lambda c: ~_same_span_exists(acc, c)
        & (F.length(checks.digits_of(c["value"])) == 12)
        & ~operational_stop(c["w"], c["value"], ("order ", "port "))
        & has_phrase(c["w"], "AADHAAR"),
    )

    def ent(c: Column) -> Column:
        v_ok = checks.verhoeff_ok(c["value"])
        ev = F.concat(
            F.lit("Aadhaar cue nearby ("), first_phrase(c["w"], "AADHAAR"), F.lit(")"),
            F.when(v_ok, F.lit(", check digit right")).otherwise(F.lit("")),
        )
        conf = F.when(v_ok, F.lit(X.CONTEXT_CONFIDENCE["AADHAAR_VALID"])).otherwise(F.lit(X.CONTEXT_CONFIDENCE["AADHAAR"]))
        return _ent("AADHAAR", c, conf, ev, related_subject(rels, c["value"], X.AADHAAR_SUBJECT_HINTS))

    return F.transform(cands, ent)


def pan_context_entities(text: Column, acc: Column) -> Column:
    cands = F.filter(_windowed(text, X.PAN_CONTEXT_PATTERN), lambda c: ~_same_span_exists(acc, c))

    def ent(c: Column) -> Column:
        ph = first_phrase(c["w"], "PAN_CARD")
        ev = F.concat(
            F.lit("PAN shape with a known holder letter"),
            F.when(ph.isNotNull(), F.concat(F.lit(", cue nearby ("), ph, F.lit(")"))).otherwise(F.lit("")),
        )
        return _ent("PAN_CARD", c, X.CONTEXT_CONFIDENCE["PAN_CARD"], ev)

    return F.transform(cands, ent)


# ---------------------------------------------------------------------------
# The whole chain
# ---------------------------------------------------------------------------
# Literal gates: every phrase / cue of a stage contains at least one of these (checked
# below), so "no literal in the lower-cased text" proves the stage has nothing to find.
GATE_LITERALS = {
    "PIN": ["pin", "atm", "debit", "card's secret"],
    "CVV": ["cvv", "cvc", "cid", "security", "verification", "back of the card"],
    "OTP": ["otp", "code", "one-time", "one time"],
    "AADHAAR": ["adha", "uid", "national id"],
}
for _t, _lits in GATE_LITERALS.items():
    for _p in X.PHRASES[_t]:
        assert any(_l in _p for _l in _lits), (_t, _p)


def _any_literal(lt: Column, literals: list[str]) -> Column:
    cond = F.lit(False)
    for lit_ in literals:
        cond = cond | lt.contains(lit_)
    return cond


CONTEXT_STAGES = [
    # (name, gate(text, lower_text) -> Column or None, builder(text, acc, rels, lower_text) -> array<entity>)
    ("intent", None, lambda t, a, r, lt: intent_entities(t, lt)),
    ("pin", lambda t, lt: _any_literal(lt, GATE_LITERALS["PIN"]), lambda t, a, r, lt: pin_entities(t, r)),
    ("password", lambda t, lt: _any_literal(lt, ["password", "passcode", "login secret", "sign-in code"]),
     lambda t, a, r, lt: password_entities(t)),
    ("cvv", lambda t, lt: _any_literal(lt, GATE_LITERALS["CVV"]), lambda t, a, r, lt: cvv_entities(t, a)),
    ("otp", lambda t, lt: _any_literal(lt, GATE_LITERALS["OTP"]), lambda t, a, r, lt: otp_entities(t, a)),
    ("system_prompt", None, lambda t, a, r, lt: system_prompt_entities(t, lt)),
    ("source_code", lambda t, lt: _any_literal(
        lt, ["def", "class", "import", "#include", "proprietary code", "internal repository code", "trade secret algorithms"]),
     lambda t, a, r, lt: source_code_entities(t)),
    ("db_marker", None, lambda t, a, r, lt: db_marker_entities(t, lt)),
    ("medical", lambda t, lt: _any_literal(lt, ["diagnos", "health condition:", "medical report:"]),
     lambda t, a, r, lt: medical_entities(t)),
    ("salary", lambda t, lt: _any_literal(lt, ["salary", "compensation", "annual ctc"]),
     lambda t, a, r, lt: salary_entities(t)),
    ("dob", lambda t, lt: _any_literal(lt, ["dob", "birth", "born"]), lambda t, a, r, lt: dob_entities(t, a)),
    ("licence", lambda t, lt: lt.contains("driv") | lt.rlike(r"\bdl"), lambda t, a, r, lt: licence_entities(t, a)),
    ("name", lambda t, lt: t.rlike("[A-Z][a-z]+\\s+[A-Z][a-z]"), lambda t, a, r, lt: name_entities(t, a)),
    ("passport", lambda t, lt: _any_literal(lt, ["passport", "travel"]), lambda t, a, r, lt: passport_entities(t, a)),
    ("ssn", lambda t, lt: _any_literal(lt, ["ssn", "social"]), lambda t, a, r, lt: ssn_context_entities(t, a)),
    ("aadhaar", lambda t, lt: _any_literal(lt, GATE_LITERALS["AADHAAR"]),
     lambda t, a, r, lt: aadhaar_context_entities(t, a, r)),
    ("pan", lambda t, lt: t.rlike("[0-9]{4}[A-Za-z]"), lambda t, a, r, lt: pan_context_entities(t, a)),
]


def add_context_entities(df, text_col: str, out_col: str, stages=None):
    """Run the context stages in order as successive projections.

    Each stage reads the entities of the earlier stages (``acc``) from a column, so every
    stage is computed once; Catalyst keeps these projections apart (their expressions are
    not cheap) and pipelines them in one whole-stage pipeline: still one pass, no shuffle.
    """
    text = F.col(text_col)
    rels_col, acc_col, lt_col = "__ctx_rels", "__ctx_acc", "__ctx_lt"
    rels = F.when(text.contains("'"), _rel_struct(text)).otherwise(F.array().cast(T.ArrayType(REL_STRUCT)))
    df = df.withColumn(lt_col, F.lower(text)).withColumn(rels_col, rels).withColumn(acc_col, empty_entities())
    lt = F.col(lt_col)
    from veilspark.operators.detect import cached_expr

    for name, gate, build in stages or CONTEXT_STAGES:
        def make(build=build, gate=gate):
            stage = build(text, F.col(acc_col), F.col(rels_col), lt)
            if gate is not None:
                stage = F.when(gate(text, lt), stage).otherwise(empty_entities())
            return F.concat(F.col(acc_col), stage)

        df = df.withColumn(acc_col, cached_expr(df, build, text_col, make))
    nonempty = F.coalesce(F.length(text), F.lit(0)) > 0
    return df.withColumn(out_col, F.when(nonempty, F.col(acc_col)).otherwise(empty_entities())).drop(
        rels_col, acc_col, lt_col
    )
