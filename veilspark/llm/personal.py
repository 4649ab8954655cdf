"""Personal data: base patterns, and candidates judged by boosted trees [native].

Base spans (email, ip, card, phone) are the leftmost matches of fixed patterns that pass their
check. Further generators propose spans with high recall, also such that overlap or lie inside a
base match that failed (a phone number with a card number after it). Boosted trees score each
candidate from its format (digits, groups, checksum, neighbours) and its context (cue words before
it); a candidate above its kind's threshold that overlaps no span taken before it is added.

The trees are fitted on the driver from a bounded sample per kind: spans of the ``TRAIN_DOCS``
texts with the smallest hashes among those that have the kind, ``TRAIN_ROWS`` rows at most for all
kinds. Positive rows are base spans, as they are and restated as the generators would meet them (``a [at] b``,
``1[.]2``, dots in a card, a phone number without its plus). Negative rows are the same spans made wrong in both
forms (checksum broken, part too large, digits cut, ending of one letter or a host of digits, glued to a word) and
what stands in the documents' prose: hits of the generators and runs of digits (dates, amounts, order numbers)
that fail their kind's check. The thresholds, the lowest with ``PRECISION``, come from the spans of all documents. The
trees are written out as one SQL expression, so scoring runs inside Spark's own functions.

The patterns are stated so that Java's matcher neither recurses nor rescans: a repeated group
becomes a class over a copy of the text in which doubled separators are masked (same length).

Defined cases: null text is an empty one; offsets are code points; repeated rows and null ids give
one row each; a kind without base spans takes the highest threshold of the others; an empty table, or one
without any base span, adds nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import gated_spans
from veilspark.llm.common import cut

KINDS = ["email", "ip", "card", "phone"]
TRAIN_DOCS = 2000
TRAIN_ROWS = 20_000
PRECISION = 0.995
TREES = 24
DEPTH = 3
#: Bins of the margin per unit.
BINS = 256
RATE = 0.3

_LOCAL = r"[A-Za-z0-9._%+\u0001-]"
#: Base patterns over masked text; \u0001 stands for a dot beside another dot.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9-]"
IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9][0-9 -]{10,}[0-9]"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IP_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
IP6 = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
#: Further generators: (kind, pattern, cheap condition that every match implies).
GENERATORS = [
    (3, r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])", "contains(t, '+')"),
    (3, r"\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])", "contains(t, '+')"),
    (3, r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", "t rlike '[0-9]{3}[ .-][0-9]{4}'"),
    (3, r"(?<![0-9])00[1-9][0-9]{0,2}[ .-][0-9]{2,4}[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])", "contains(t, '00')"),
    (2, r"(?<![0-9])[0-9]{13,19}(?![0-9])", "t rlike '[0-9]{13}'"),
    (2, r"(?<![0-9])[0-9]{4}(?:[ .-][0-9]{4}){3}(?![0-9])", "t rlike '[0-9]{4}[ .-][0-9]{4}'"),
    (2, r"(?<![0-9])[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5}(?![0-9])", "t rlike '[0-9]{4}[ .-][0-9]{6}'"),
    (0, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,4}",
     "t rlike '[\\\\[(]at[\\\\])]'"),
    (1, r"(?<![0-9.])[0-9]{1,3}(?:[\[(]\.[\])][0-9]{1,3}){3}(?![0-9])", "contains(t, '.]') or contains(t, '.)')"),
    (1, rf"(?<![0-9A-Fa-f:]){IP6}(?![0-9A-Fa-f:])", rf"t rlike '{IP6}'"),
]
#: Digits with separators, as they stand in dates, amounts, order and article numbers.
NUMBERS = r"(?<![0-9])[0-9][0-9 ().:/-]{5,40}[0-9](?![0-9])"
#: Words before a span that tell its kind, in KINDS' order.
CUES = ["e-?mail|contact|write|courriel|correo", "ip|server|host|address|adresse", "card|visa|master|credit|karte|carte|tarjeta", "tel|phone|call|mobile|fax|anruf"]
FEATURES = ["kind", "digits", "length", "luhn", "plus", "groups", "longest", "glued_before", "glued_after", "digit_before", "bracket", "parts", "cue", "letters", "ending"]


def _spans(masked: str, pattern: str, gate: str, kind: int, check: str | None = None) -> Column:
    found = gated_spans(F.expr(masked), pattern, F.expr(gate))
    ok = F.filter(found, lambda m: _check(check, m["value"])) if check else found
    return F.transform(ok, lambda m: F.struct(m["start"].alias("s"), F.lit(kind).alias("kind"), m["end"].alias("e")))


def _check(kind: str, value: Column) -> Column:
    """Whether a base match of the kind passes."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def with_base(docs: DataFrame, text_col: str) -> DataFrame:
    """row (all columns), t (text), base (array of s, kind, e in order)."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    dots = r"regexp_replace(translate(t, '\u0001', '\u0002'), '(?<=\\.)\\.|\\.(?=\\.)', '\u0001')"
    gaps = "regexp_replace(t, '(?<=[ -])[ -]|[ -](?=[ -])', 'x')"
    base = F.concat(
        _spans(dots, EMAIL, "contains(t, '@')", 0, "email"),
        _spans("t", IP, r"t rlike '[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]'", 1, "ip"),
        _spans(gaps, CARD, "t rlike '[0-9][0-9 -]{10,}[0-9]'", 2, "card"),
        _spans("t", PHONE, "contains(t, '+')", 3, "phone"),
    )
    return rows.withColumn("base", F.array_sort(base))


def with_candidates(rows: DataFrame) -> DataFrame:
    """Adds ``cands``: base spans and what the generators find, each once, with its features."""
    found = F.concat(F.col("base"), *[_spans("t", p, gate, kind) for kind, p, gate in GENERATORS])
    rows = rows.withColumn("found", F.array_distinct(found))
    texts = F.expr("""transform(found, x -> named_struct('s', x.s, 'kind', x.kind, 'e', x.e, 'base', array_contains(base, x),
        'v', substring(t, x.s + 1, x.e - x.s), 'before', lower(substring(t, greatest(x.s - 30, 0) + 1, least(x.s, 30))), 'after', substring(t, x.e + 1, 1)))""")
    return rows.withColumn("cands", F.transform(texts, lambda x: F.struct(
        *[x[c].alias(c) for c in ("s", "kind", "e", "base", "v")], features(x["kind"], x["v"], x["before"], x["after"]).alias("f"))))


def features(kind: Column, value: Column, before: Column, after: Column) -> Column:
    """Numbers of FEATURES for a span from its text, the text before it and the character after it."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    runs = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    cue = F.lit(False)
    for k, words in enumerate(CUES):
        cue = cue | ((kind == k) & before.rlike(f"\\b(?:{words})"))
    valid = value.rlike(IP_PARTS) | F.regexp_replace(value, r"[\[\]()]", "").rlike(IP_PARTS) | value.rlike(f"^{IP6}$")
    numbers = [
        kind, F.length(digits), F.length(value), F.coalesce(F.call_function("luhn_check", digits), F.lit(False)), value.contains("+"), F.size(runs),
        F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)), before.rlike(r"[\p{L}0-9]$"), after.rlike(r"^[\p{L}0-9]"),
        before.rlike("[0-9][ .-]?$"), value.rlike(r"[(\[]"), valid, cue, F.length(F.regexp_replace(value, "[^A-Za-z]", "")), value.rlike(r"[\])\.][ ]?[A-Za-z]{2,}$"),
    ]
    return F.array(*[n.cast("int") for n in numbers])


def known_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """h (hash of the text), s, kind, base, v, before, after: the base spans of all different texts, and spans beside
    them that fail their kind's check (base false). Written once."""
    rows = with_base(docs.filter(F.col(text_col).isNotNull()).select(text_col), text_col)
    runs = gated_spans(F.col("t"), NUMBERS, F.col("t").rlike("[0-9][0-9 ().:/-]{5}"))
    beside = F.concat(*[_spans("t", p, gate, kind) for kind, p, gate in GENERATORS],
                      *[F.transform(runs, lambda m, k=k: F.struct(m["start"].alias("s"), F.lit(k).alias("kind"), m["end"].alias("e"))) for k in (2, 3)])
    rows = rows.withColumn("beside", F.array_distinct(beside))
    spans = F.expr("""concat(transform(base, x -> named_struct('s', x.s, 'kind', x.kind, 'e', x.e, 'base', true)),
        transform(filter(beside, x -> not exists(base, b -> b.s < x.e and x.s < b.e)), x -> named_struct('s', x.s, 'kind', x.kind, 'e', x.e, 'base', false)))""")
    rows = rows.select(F.xxhash64("t").alias("h"), "t", spans.alias("all")).filter(F.size("all") > 0).select("h", "t", F.inline("all"))
    context = [F.expr("lower(substring(t, greatest(s - 30, 0) + 1, least(s, 30)))").alias("before"), F.expr("substring(t, e + 1, 1)").alias("after")]
    named = rows.select("h", "s", "kind", "base", F.expr("substring(t, s + 1, e - s)").alias("v"), *context)
    return cut(named.filter(F.col("base") | fails(F.col("kind"), F.col("v"))).distinct())


def fails(kind: Column, value: Column) -> Column:
    """Whether a span can't be of its kind, by the check of the kind's digits or ending."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    address = F.regexp_replace(value, r"[\[\]()]", "")
    date = value.rlike(r"^[0-9]{4}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}\b|^[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}\b|[0-9]:[0-9]")
    return (
        F.when(kind == 0, ~value.rlike(r"[\])\. ][A-Za-z]{2,}$"))
        .when(kind == 1, ~(address.rlike(IP_PARTS) | value.rlike(f"^{IP6}$")))
        .when(kind == 2, ~(F.length(digits).between(12, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))))
        .otherwise(date | ~F.length(digits).between(9, 15)))


def restated(kind: Column, value: Column, odd: Column) -> Column:
    """A base span's text as the further generators would meet it, in one of two ways."""
    email = F.when(odd, F.regexp_replace(value, "@", " [at] ")).otherwise(F.regexp_replace(F.regexp_replace(value, "@", "(at)"), r"\.([A-Za-z0-9-]+)$", "(dot)$1"))
    bare = F.regexp_replace(value, "[ -]", "")
    card = F.when(odd, F.regexp_replace(bare, "([0-9]{4})(?=[0-9])", "$1.")).otherwise(bare)
    phone = F.when(odd, F.regexp_replace(value, r"^\+", "00")).otherwise(F.regexp_replace(value, r"^\+[0-9]{1,3}[ .-]?", ""))
    return F.when(kind == 0, email).when(kind == 1, F.regexp_replace(value, r"\.", "[.]")).when(kind == 2, card).otherwise(phone)


def judged_rows(spans: DataFrame) -> DataFrame:
    """h, s, kind, y (1 base span, 0 made wrong or failing its check), f and whether the row is held back."""
    v, kind, context = F.col("v"), F.col("kind"), [F.col("before"), F.col("after")]
    odd = F.pmod(F.xxhash64("h", "s", F.lit(1)), F.lit(2)) == 0
    turned = F.concat(F.expr("substring(v, 1, length(v) - 1)"), ((F.expr("try_cast(right(v, 1) as int)") + 1) % 10).cast("string"))
    ending = F.when(odd, F.regexp_replace(v, r"\.[^.]*$", ".q")).otherwise(F.regexp_replace(v, "@.*$", "@17.4"))
    wrong = F.when(kind == 0, ending).when(kind == 1, F.regexp_replace(v, "^[0-9]+", "777")).when(kind == 2, turned).otherwise(F.expr("substring(v, 1, 7)"))
    wrong = F.coalesce(wrong, F.lit("?"))
    made = F.array(
        F.struct(F.lit(1).alias("y"), features(kind, v, *context).alias("f")),
        F.struct(F.lit(1).alias("y"), features(kind, restated(kind, v, odd), *context).alias("f")),
        F.struct(F.lit(0).alias("y"), features(kind, wrong, *context).alias("f")),
        F.struct(F.lit(0).alias("y"), features(kind, restated(kind, wrong, odd), *context).alias("f")),
        F.struct(F.lit(0).alias("y"), F.when(kind > 0, features(kind, v, F.lit("a"), F.lit("a"))).alias("f")))
    prose = F.array(F.struct(F.lit(0).alias("y"), features(kind, v, *context).alias("f")))
    rows = F.when(F.col("base"), made).otherwise(prose)
    return spans.select("h", "s", "kind", (F.pmod(F.xxhash64("h", "s"), F.lit(10)) < 3).alias("held"), F.explode(rows).alias("r")).select(
        "h", "s", "kind", "held", "r.y", "r.f").filter("f is not null")


def training_rows(spans: DataFrame) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """Features and labels of rows not held back, and per kind the last hash of its sample (None: no such span)."""
    lasts = [spans.filter("base").filter(F.col("kind") == k).select("h").distinct().orderBy("h").limit(TRAIN_DOCS).agg(F.max("h")).first()[0] for k in range(len(KINDS))]
    got = []
    for k, last in enumerate(lasts):
        if last is not None:
            rows = judged_rows(spans.filter((F.col("kind") == k) & (F.col("h") <= last))).filter("not held")
            got += rows.orderBy(F.xxhash64("h", "s"), "y", "f").limit(TRAIN_ROWS // len(KINDS)).select("y", "f").collect()
    return np.array([r["f"] for r in got], float).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], float), lasts


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
    """A regression tree: a number, or (feature, split, left, right)."""
    best = (1e-6, None)
    total = grad.sum() ** 2 / (hess.sum() + 1)
    for k in range(x.shape[1]) if depth else ():
        values = np.unique(x[:, k])
        if len(values) > 32:
            values = np.unique(np.quantile(values, np.linspace(0, 1, 33)))
        for split in (values[1:] + values[:-1]) / 2:
            left = x[:, k] < split
            gl, hl = grad[left].sum(), hess[left].sum()
            gain = gl**2 / (hl + 1) + (grad.sum() - gl) ** 2 / (hess.sum() - hl + 1) - total
            if gain > best[0]:
                best = (gain, (k, float(split)))
    if best[1] is None:
        return float(RATE * grad.sum() / (hess.sum() + 1))
    k, split = best[1]
    left = x[:, k] < split
    return k, split, _grow(x[left], grad[left], hess[left], depth - 1), _grow(x[~left], grad[~left], hess[~left], depth - 1)


def _predict(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    k, split, a, b = tree
    return np.where(x[:, k] < split, _predict(a, x), _predict(b, x))


def fit(x: np.ndarray, y: np.ndarray) -> list:
    """Boosted trees for the logistic loss."""
    trees, margin = [], np.zeros(len(x))
    for _ in range(TREES if len(x) else 0):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, y - p, p * (1 - p), DEPTH)
        trees.append(tree)
        margin += _predict(tree, x)
    return trees


def limits_of(spans: DataFrame, trees: list, lasts: list[int | None]) -> list[float | None]:
    """Per kind the margin from which PRECISION holds over the base spans of all documents (None: no span of the kind).

    Margins are counted in bins. Rows that the trees may have learnt from count only for a kind with
    too few others to tell PRECISION.
    """
    learnt = F.expr("not held and h <= CASE kind " + " ".join(f"WHEN {k} THEN {v}L" if v > -(1 << 63) else f"WHEN {k} THEN h" for k, v in enumerate(lasts) if v is not None) + " END")
    bins = judged_rows(spans).withColumn("x", F.struct("f")).select("kind", "y", learnt.alias("learnt"), F.floor(F.expr(f"({margin_of(trees)}) * {BINS}")).alias("bin"))
    counts = bins.groupBy("kind", "learnt", "bin").agg(F.sum("y").alias("good"), F.count("*").alias("all")).collect()
    limits: list[float | None] = []
    for kind in range(len(KINDS)):
        of = [r for r in counts if r["kind"] == kind] if lasts[kind] is not None else []
        fresh = [r for r in of if not r["learnt"]]
        if sum(r["good"] for r in fresh) * (1 - PRECISION) >= 1:
            of = fresh
        levels = sorted({r["bin"] for r in of}, reverse=True)
        good = total = 0
        lowest = None
        for k, level in enumerate(levels):
            good += sum(r["good"] for r in of if r["bin"] == level)
            total += sum(r["all"] for r in of if r["bin"] == level)
            if good >= PRECISION * total:
                lowest = k
        # half way to the next lower bin seen
        below = -1.0 if lowest is None or lowest + 1 == len(levels) else (levels[lowest + 1] + 1) / BINS
        limits.append(None if lowest is None else max(0.0, (levels[lowest] / BINS + below) / 2))
    # without base spans there is nothing to calibrate on: as strict as the strictest kind
    known = [m for m in limits if m is not None]
    return [max(known) if m is None and known and lasts[k] is None else m for k, m in enumerate(limits)]


def _sql(tree) -> str:
    if isinstance(tree, float):
        return f"{tree:.9f}D"
    k, split, a, b = tree
    return f"CASE WHEN x.f[{k}] < {split:.6f}D THEN {_sql(a)} ELSE {_sql(b)} END"


def margin_of(trees: list) -> str:
    return " + ".join(map(_sql, trees)) or "0D"


def find_personal(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row (all columns of ``docs``), t (its text), base and spans: arrays of (s, kind, e) in order."""
    known = known_spans(docs, text_col)
    x, y, lasts = training_rows(known)
    trees = fit(x, y)
    limits = limits_of(known, trees, lasts) if any(v is not None for v in lasts) else [None] * len(KINDS)
    rows = with_candidates(with_base(docs, text_col))
    margin = margin_of(trees)
    limit = "CASE x.kind " + " ".join(f"WHEN {k} THEN {m:.9f}D" for k, m in enumerate(limits) if m is not None) + " END"
    if all(m is None for m in limits):
        limit = "cast(null as double)"
    scored = F.expr(f"transform(filter(cands, c -> not c.base), x -> named_struct('m', -({margin}), 'ok', ({margin}) >= {limit}, 's', x.s, 'kind', x.kind, 'e', x.e))")
    rows = rows.withColumn("scored", scored)
    # of spans of one kind inside each other the longest stands for all
    rows = rows.withColumn("passed", F.expr("filter(scored, x -> x.ok)")).withColumn("passed", F.expr(
        "filter(passed, x -> not exists(passed, y -> y.kind = x.kind and y.s <= x.s and y.e >= x.e and y.e - y.s > x.e - x.s))"))
    added = F.expr("""aggregate(array_sort(passed), base, (taken, x) ->
        if(exists(taken, y -> y.s < x.e and x.s < y.e), taken, array_append(taken, named_struct('s', x.s, 'kind', x.kind, 'e', x.e))))""")
    return rows.select("row", "t", "base", F.array_sort(added).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.kind + 1), x.s, x.e)), ',')")


def redact(found: DataFrame, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The rows of ``find_personal`` with every span replaced by its kind's mark; overlapping spans become one."""
    marks = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    text = F.expr(f"""aggregate(spans, named_struct('at', 0, 'out', ''), (a, x) ->
        if(x.s < a.at, named_struct('at', greatest(a.at, x.e), 'out', a.out),
           named_struct('at', x.e, 'out', concat(a.out, substring(t, a.at + 1, x.s - a.at), element_at(array({marks}), x.kind + 1)))),
        a -> concat(a.out, substring(t, a.at + 1)))""")
    rows = found.withColumn("_text", F.when(F.size("spans") == 0, F.col(f"row.{text_col}")).otherwise(text))
    columns = []
    for c in found.schema["row"].dataType.names:
        if c == text_col:
            columns.append(F.col("_text").alias(c))
        elif c == count_col:
            columns.append(F.when(F.size("spans") == 0, F.col(f"row.{c}")).otherwise(F.length("_text")).cast("long").alias(c))
        else:
            columns.append(F.col(f"row.{c}").alias(c))
    return rows.select(*columns)
