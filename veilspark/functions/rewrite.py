"""Replacement values and text splicing as column expressions."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import fixed as X
from veilspark.functions.entity import ENTITY_STRUCT, overlaps

L = X.MASK_LABELS


def _last(v: Column, n: int) -> Column:
    return F.substring(v, -n, n)


def mask_col(value: Column, pii_type: Column, category: Column) -> Column:
    """Partial masking by type (credentials never partially shown)."""
    user = F.substring_index(value, "@", 1)
    domain = F.substring(value, F.length(user) + 2, 1 << 30)
    email = F.when(
        value.contains("@"),
        F.concat(
            F.when(F.length(user) > 2, F.concat(F.substring(user, 1, 1), F.lit("***"), _last(user, 1))).otherwise(
                F.lit("***")
            ),
            F.lit("@"),
            domain,
        ),
    ).otherwise(F.lit(L["EMAIL_NO_AT"]))
    n_digits = F.length(F.regexp_replace(value, r"[^0-9]", ""))
    dob_parts = F.split(value, r"[-/.]")
    dob = F.when(
        (F.length(value) >= 8) & value.rlike(r"[-/.]") & (F.size(dob_parts) == 3),
        F.when(F.length(F.get(dob_parts, 0)) == 4, F.concat(F.lit("****-**-"), F.get(dob_parts, 2))).when(
            F.length(F.get(dob_parts, 2)) == 4, F.concat(F.get(dob_parts, 0), F.lit("-**-****"))
        ),
    )
    dob = F.coalesce(dob, F.lit(L["DOB_OTHER"]))
    words = F.filter(F.split(F.trim(value), r"\s+"), lambda w: F.length(w) > 0)
    name = F.when(
        F.size(words) > 0,
        F.array_join(
            F.transform(words, lambda w: F.when(F.length(w) > 1, F.concat(F.substring(w, 1, 1), F.lit("***"))).otherwise(w)),
            " ",
        ),
    ).otherwise(F.lit(L["NAME_EMPTY"]))
    ip_parts = F.split(value, r"\.")
    ip = F.when(
        F.size(ip_parts) == 4, F.concat(F.get(ip_parts, 0), F.lit("."), F.get(ip_parts, 1), F.lit(".*.*"))
    ).otherwise(F.lit(L["IP_OTHER"]))
    t = pii_type
    return (
        F.when(category == X.CREDENTIAL, F.lit(L["CREDENTIAL"]))
        .when(
            category == X.BUSINESS_CONFIDENTIAL,
            F.coalesce(
                F.element_at(
                    F.create_map(*[x for k in X.BUSINESS_TYPES[:4] for x in (F.lit(k), F.lit(L[k]))]), t
                ),
                F.lit(L["BUSINESS_OTHER"]),
            ),
        )
        .when(t == "EMAIL", email)
        .when(t == "PHONE", F.when(n_digits >= 4, F.concat(F.lit("***-***-"), _last(value, 4))).otherwise(F.lit(L["PHONE_SHORT"])))
        .when(t == "CREDIT_CARD", F.concat(F.lit("****-****-****-"), _last(value, 4)))
        .when(t == "SSN", F.concat(F.lit("***-**-"), _last(value, 4)))
        .when(t == "AADHAAR", F.concat(F.lit("XXXX-XXXX-"), _last(value, 4)))
        .when(t == "PAN_CARD", F.concat(F.substring(value, 1, 2), F.lit("***"), _last(value, 2)))
        .when(
            t == "PASSPORT",
            F.when(F.length(value) >= 4, F.concat(F.substring(value, 1, 2), F.lit("*****"), _last(value, 2))).otherwise(
                F.lit(L["PASSPORT_SHORT"])
            ),
        )
        .when(
            t == "BANK_ACCOUNT",
            F.when(F.length(value) >= 4, F.concat(F.lit("******"), _last(value, 4))).otherwise(F.lit(L["BANK_SHORT"])),
        )
        .when(t == "DATE_OF_BIRTH", dob)
        .when(t == "PERSON_NAME", name)
        .when(
            t == "DRIVERS_LICENSE",
            F.when(F.length(value) >= 6, F.concat(F.substring(value, 1, 3), F.lit("*****"), _last(value, 3))).otherwise(
                F.lit(L["DL_SHORT"])
            ),
        )
        .when(t == "SALARY_INFO", F.lit(L["SALARY_INFO"]))
        .when(t == "MEDICAL_DIAGNOSIS", F.lit(L["MEDICAL_DIAGNOSIS"]))
        .when(t == "BIOMETRIC_TEMPLATE", F.lit(L["BIOMETRIC_TEMPLATE"]))
        .when(t == "HOME_ADDRESS", F.lit(L["HOME_ADDRESS"]))
        .when(t == "IP_ADDRESS", ip)
        .otherwise(F.concat(F.lit("["), t, F.lit("_MASKED]")))
    )


def redact_col(pii_type: Column, entity_category: Column, simple: bool = False) -> Column:
    """``[REDACTED]`` (simple mode), ``[REDACTED_CREDENTIAL]`` or ``[REDACTED_<TYPE>]``."""
    if simple:
        return F.lit("[REDACTED]")
    return F.when(entity_category == X.CREDENTIAL, F.lit("[REDACTED_CREDENTIAL]")).otherwise(
        F.concat(F.lit("[REDACTED_"), pii_type, F.lit("]"))
    )


# ---------------------------------------------------------------------------
# Tokens (P4, P5, D11)
# ---------------------------------------------------------------------------
def derived_salt(request_id: Column, secret: str, client_id: Column | None = None) -> Column:
    """16-byte salt derived from a job secret and the request id (deterministic under retries).

    Secret and id are parted by a zero character. With a client id the salt is bound to it: first
    16 bytes of SHA-256(salt || client).
    """
    salt = F.unhex(F.substring(F.sha2(F.concat(F.lit(secret + "\u0000"), request_id.cast("string")), 256), 1, 32))
    if client_id is not None:
        bound = F.unhex(F.substring(F.sha2(F.concat(salt, F.encode(client_id, "UTF-8")), 256), 1, 32))
        salt = F.when(client_id.isNotNull(), bound).otherwise(salt)
    return salt


HASH_LENGTH = 8


def token_hash(salt: Column, pii_type: Column, value: Column, length: int = HASH_LENGTH) -> Column:
    """First 8 hex of SHA-256(salt || "TYPE:value")."""
    key = F.encode(F.concat(pii_type, F.lit(":"), value), "UTF-8")
    return F.substring(F.sha2(F.concat(salt, key), 256), 1, length)


def rehash(h: Column, counter: Column, length: int = HASH_LENGTH) -> Column:
    """P5: collision fallback, first 8 hex of SHA-256("<h>_<counter>"), h being the first hash."""
    return F.substring(F.sha2(F.concat(h, F.lit("_"), counter.cast("string")), 256), 1, length)


def make_token(pii_type: Column, h: Column, prefix: str = X.TOKEN_PREFIX, suffix: str = X.TOKEN_SUFFIX) -> Column:
    return F.concat(F.lit(prefix), pii_type, F.lit("_"), h, F.lit(suffix))


def token_pattern(prefix: str = X.TOKEN_PREFIX, suffix: str = X.TOKEN_SUFFIX) -> str:
    import re

    return re.escape(prefix) + X.TOKEN_BODY + re.escape(suffix)


def token_parts(token: Column, prefix: str = X.TOKEN_PREFIX, suffix: str = X.TOKEN_SUFFIX) -> Column:
    """Split a token into (type, hash)."""
    import re

    pat = "^" + re.escape(prefix) + r"([a-zA-Z0-9_\-]+)_([a-zA-Z0-9]+)" + re.escape(suffix) + "$"
    return F.struct(F.regexp_extract(token, pat, 1).alias("pii_type"), F.regexp_extract(token, pat, 2).alias("hash"))


VAULT_ENTRY = T.StructType(
    [
        T.StructField("pii_type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("token", T.StringType()),
    ]
)


def assign_tokens(pairs: Column, salt: Column, prefix: str = X.TOKEN_PREFIX, suffix: str = X.TOKEN_SUFFIX,
                  length: int = HASH_LENGTH) -> Column:
    """F1 + P4 + P5 inside one row: distinct (type, value) pairs in first-seen order ->
    array<struct<pii_type, value, token>>. A token already held by a different value is re-hashed
    from the first hash with counters 1, 2, ... until one is free; there are more counters than
    tokens held, and should all of their short hashes be taken, the whole hash is used."""
    init = F.array().cast(T.ArrayType(VAULT_ENTRY))

    def taken(acc: Column, tok: Column, value: Column) -> Column:
        return F.exists(acc, lambda x: (x["token"] == tok) & (x["value"] != value))

    def step(acc: Column, p: Column) -> Column:
        h0 = token_hash(salt, p["pii_type"], p["value"], length)
        t0 = make_token(p["pii_type"], h0, prefix, suffix)
        tries = F.transform(
            F.sequence(F.lit(1), F.size(acc) + 1), lambda k: make_token(p["pii_type"], rehash(h0, k, length), prefix, suffix))
        free = F.get(F.filter(tries, lambda t: ~taken(acc, t, p["value"])), 0)
        whole = make_token(p["pii_type"], token_hash(salt, p["pii_type"], p["value"], 64), prefix, suffix)
        tok = F.when(~taken(acc, t0, p["value"]), t0).otherwise(F.coalesce(free, whole))
        entry = F.struct(p["pii_type"].alias("pii_type"), p["value"].alias("value"), tok.alias("token"))
        return F.when(
            F.exists(acc, lambda x: (x["pii_type"] == p["pii_type"]) & (x["value"] == p["value"])), acc
        ).otherwise(F.array_append(acc, entry))

    return F.aggregate(pairs, init, step)


# ---------------------------------------------------------------------------
# Overlap resolution and splicing
# ---------------------------------------------------------------------------
#: Up to so many entities the spans kept are compared one by one inside the row's expression.
FEW_ENTITIES = 64


def kept_spans(starts: list[int], ends: list[int]) -> list[int]:
    """Indices of the spans to keep, given in order of preference: those that overlap no span kept before.

    The spans kept never overlap, so sorted by start they are sorted by end too, and one binary search finds the only
    neighbours that can meet a new one: n log n searches for any number of entities.
    """
    firsts: list[int] = []
    lasts: list[int] = []
    kept = []
    for i, (a, b) in enumerate(zip(starts, ends)):
        at = bisect_left(firsts, b)  # spans kept from here on start at or after b
        if at and lasts[at - 1] > a:
            continue
        firsts.insert(at, a)
        lasts.insert(at, b)
        kept.append(i)
    return kept


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _kept_spans(starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else kept_spans(a.tolist(), b.tolist()) for a, b in zip(starts, ends)], dtype=object)


_kept_spans = _kept_spans.asNondeterministic()  # keeps the call out of array functions, where it can't run


def ordered_entities(entities: Column) -> Column:
    """by length and confidence, both descending, then detector rank and position."""
    keyed = F.transform(
        entities,
        lambda e: F.struct(
            (-(e["end"] - e["start"])).alias("k1"),
            (-e["confidence"]).alias("k2"),
            e["det_rank"].alias("k3"),
            e["seq"].alias("k4"),
            e.alias("e"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda x: x["e"])


def keep_greedily(ordered: Column) -> Column:
    """Entities in order of preference that overlap none kept before, each compared with all kept."""
    init = F.array().cast(T.ArrayType(ENTITY_STRUCT))
    return F.aggregate(
        ordered,
        init,
        lambda acc, c: F.when(F.exists(acc, lambda k: overlaps(k, c)), acc).otherwise(F.array_append(acc, c)),
    )


def resolve_overlaps(entities: Column) -> Column:
    """Order by (length desc, confidence desc, detector rank, position), keep greedily."""
    return keep_greedily(ordered_entities(entities))


def with_resolved(df: DataFrame, found_col: str, out_col: str) -> DataFrame:
    """D6 for tables whose texts may hold thousands of entities.

    Texts of up to FEW_ENTITIES entities are settled in the JVM; the spans of longer lists cross to an
    Arrow function as two arrays of numbers and come back as the indices to keep.
    """
    df = df.withColumn("__ordered", ordered_entities(F.col(found_col)))
    many = F.size("__ordered") > FEW_ENTITIES
    starts, ends = F.transform("__ordered", lambda e: e["start"]), F.transform("__ordered", lambda e: e["end"])
    df = df.withColumn("__keep", _kept_spans(F.when(many, starts), F.when(many, ends)))
    chosen = F.transform("__keep", lambda i: F.get(F.col("__ordered"), i))
    return df.withColumn(out_col, F.when(many, chosen).otherwise(keep_greedily(F.col("__ordered")))).drop("__ordered", "__keep")


def by_start(arr: Column) -> Column:
    keyed = F.transform(arr, lambda e: F.struct(e["start"].alias("s"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: x["e"])


def splice(text: Column, pieces: Column) -> Column:
    """Rebuild the text from the gaps between non-overlapping spans sorted by start and
    their replacements (``pieces``: array<struct<start, end, repl>>)."""
    n = F.size(pieces)

    def piece(p: Column, i: Column) -> Column:
        prev_end = F.when(i == 0, F.lit(0)).otherwise(pieces[i - 1]["end"])
        return F.concat(F.substring(text, prev_end + 1, p["start"] - prev_end), p["repl"])

    head = F.array_join(F.transform(pieces, piece), "")
    tail_from = F.when(n == 0, F.lit(0)).otherwise(F.element_at(pieces, -1)["end"])
    return F.when(n == 0, text).otherwise(F.concat(head, F.substring(text, tail_from + 1, 1 << 30)))
