"""P12 ``sanitize``: the whole per-text chain as narrow DataFrame transformations.

normalise (B3, B4) -> base64 pass (C32, P9) -> detect (C33) -> resolve overlaps (D6) ->
decide actions (P1) -> tokens / vault (P4, P5, F1) -> replacements (P6, P7) -> splice (P8)
-> block decision (P10) -> leak check (D7) -> counts (E1, E2).

For a table of texts (one request per row) nothing here shuffles: every step is a
projection over the row, in one stage (the array functions inside run interpreted). Two cases
add a shuffle: requests of several rows (``plans.requests``) share one by request id, and rows with
base64 carriers, and only those, are dealt by row to scan each carrier by itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import fixed as X
from veilspark.functions.entity import ENTITY_STRUCT
from veilspark.functions.normalize import escape_delimiters, normalize_unicode
from veilspark.functions.rewrite import (
    HASH_LENGTH,
    assign_tokens,
    by_start,
    derived_salt,
    mask_col,
    redact_col,
    resolve_overlaps,
    splice,
)
from veilspark.operators.detect import ERROR_COL, DetectorSet, default_detectors
from veilspark.operators.policy import BLOCK, MASK, PASS, REDACT, TOKENIZE, Policy, category_col

INTERNAL_ERROR = "BLOCKED_INTERNAL_ERROR"

KEPT_STRUCT = T.StructType(
    ENTITY_STRUCT.fields
    + [
        T.StructField("action", T.StringType()),
        T.StructField("repl", T.StringType()),
    ]
)
B64_STRUCT = T.StructType(KEPT_STRUCT.fields + [T.StructField("carrier", T.StringType())])


@dataclass
class Firewall:
    """Configuration of a sanitise job (FirewallConfig + policy + detectors)."""

    secret: str = field(repr=False)  # salts are derived from it: keep it out of logs and code
    policy: Policy = field(default_factory=Policy)
    detectors: DetectorSet = field(default_factory=default_detectors)
    prefix: str = X.TOKEN_PREFIX
    suffix: str = X.TOKEN_SUFFIX
    strict: bool = True  # fail_safe_strict: a leak blocks the request
    leak_scope: str = "all"  # "all" non-passed values (our fix of Q10) or "tokenized" (as the reference)
    scan_base64: bool = True
    hash_length: int = HASH_LENGTH
    use_nfkc: bool = True

    # ------------------------------------------------------------------
    def sanitize(
        self,
        df: DataFrame,
        text_col: str,
        key_col: str,
        tool: Column | str = "*",
        field_col: str | None = None,
        client_col: str | None = None,
        order_col: str | None = None,
    ) -> DataFrame:
        """Add sanitisation columns to ``df`` (one row = one text of one request).

        With ``order_col`` a request may have several rows, in this order: they share one vault (so
        a value has one token and two values never share one), and every row carries it.

        Output columns: ``tool, clean, kept, vault, sanitized, blocked, block_reason, action,
        counts, total_detected, leaks, verification_passed, error_type``.
        """
        tool_c = F.lit(tool) if isinstance(tool, str) else tool
        field_c = F.col(field_col) if field_col else F.lit(None).cast("string")
        client_c = F.col(client_col) if client_col else None
        text = F.col(text_col)

        df = df.withColumn("tool", tool_c)
        # B3 + B4
        df = df.withColumn("clean", escape_delimiters(normalize_unicode(text, self.use_nfkc), self.prefix, self.suffix))
        df = df.withColumn("__salt", derived_salt(F.col(key_col), self.secret, client_c))

        # C32 base64 carriers: decode, keep valid UTF-8, scan each decoded text by itself.
        df = df.withColumn("__field", field_c)
        if self.scan_base64:
            df = self._base64_stage(df)
        else:
            df = df.withColumn("__b64", F.array().cast(T.ArrayType(B64_STRUCT)))
        df = df.withColumn("__scan", self._hide_carriers())
        field_c = F.col("__field")

        # C33 + D6
        df = self.detectors.apply(df, "__scan", "__found")
        failed = F.col(ERROR_COL).isNotNull()
        df = df.withColumn("__res", resolve_overlaps(F.col("__found")))

        # P1 per kept entity
        pol = self.policy
        df = df.withColumn(
            "__acted",
            F.transform(
                F.col("__res"),
                lambda e: e.withField(
                    "__act",
                    pol.action_col(F.col("tool"), e["pii_type"], field_c, category_col(e["pii_type"], e["category"])),
                ),
            ),
        )
        # Tokens in processing order (base64 first, then right-to-left)
        main_tok = F.filter(
            F.reverse(by_start(F.col("__acted"))), lambda e: e["__act"] == TOKENIZE
        )
        pairs = F.concat(
            F.transform(F.col("__b64"), lambda b: F.struct(b["pii_type"].alias("pii_type"), b["value"].alias("value"))),
            F.transform(main_tok, lambda e: F.struct(e["pii_type"].alias("pii_type"), e["value"].alias("value"))),
        )
        if order_col:
            of_request = Window.partitionBy(key_col)
            mine = F.struct(F.col(order_col).alias("o"), pairs.alias("p"))
            df = df.withColumn("__pairs", F.flatten(F.transform(F.array_sort(F.collect_list(mine).over(of_request)), lambda x: x["p"])))
            pairs = F.col("__pairs")
        df = df.withColumn("vault", assign_tokens(pairs, F.col("__salt"), self.prefix, self.suffix, self.hash_length))

        # P6/P7 replacement per kept entity
        simple = pol.simple_redaction

        def with_repl(e: Column) -> Column:
            act = e["__act"]
            tok = F.get(F.filter(F.col("vault"), lambda v: (v["pii_type"] == e["pii_type"]) & (v["value"] == e["value"])), 0)[
                "token"
            ]
            span = F.substring(F.col("__scan"), e["start"] + 1, e["end"] - e["start"])
            own_cat = F.coalesce(e["category"], F.lit(X.PERSONAL_INFO))
            repl = (
                F.when(act == TOKENIZE, tok)
                .when(act == REDACT, redact_col(e["pii_type"], own_cat, simple))
                .when(act == MASK, mask_col(e["value"], e["pii_type"], category_col(e["pii_type"])))
                .otherwise(span)
            )
            return F.struct(*[e[f.name].alias(f.name) for f in ENTITY_STRUCT.fields], act.alias("action"), repl.alias("repl"))

        df = df.withColumn("kept", by_start(F.transform(F.col("__acted"), with_repl)))

        # P10 block decision (base64 block first, then the right-most blocked entity)
        kept = F.col("kept")
        b64_block = F.get(F.filter(F.col("__b64"), lambda b: b["action"] == BLOCK), 0)
        main_block = F.get(F.reverse(F.filter(kept, lambda e: e["action"] == BLOCK)), 0)
        policy_reason = F.coalesce(
            F.when(
                b64_block.isNotNull(),
                F.concat(F.lit("policy: tool "), F.col("tool"), F.lit(" may not get "), b64_block["pii_type"], F.lit(" (found in base64)")),
            ),
            F.when(
                main_block.isNotNull(),
                F.concat(
                    F.lit("policy: tool "), F.col("tool"), F.lit(" may not get "), main_block["pii_type"],
                    F.lit(" ("), F.coalesce(main_block["category"], F.lit(X.PERSONAL_INFO)), F.lit(")"),
                ),
            ),
        )
        df = df.withColumn("__policy_block", policy_reason)

        # P8 splice (pieces sorted by start; PASS pieces reproduce the original span)
        df = df.withColumn(
            "__pieces",
            F.transform(kept, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["repl"].alias("repl"))),
        ).withColumn("__rewritten", self._with_carrier_tokens(splice(F.col("__scan"), F.col("__pieces"))))

        # D7 leak check on the rewritten text (values only, never reported)
        if self.leak_scope == "tokenized":
            values = F.transform(F.col("vault"), lambda v: v["value"])
        else:
            values = F.array_distinct(
                F.concat(
                    F.transform(F.col("vault"), lambda v: v["value"]),
                    F.transform(F.filter(kept, lambda e: e["action"] != PASS), lambda e: e["value"]),
                )
            )
        df = df.withColumn(
            "leaks",
            F.size(F.filter(values, lambda v: (F.length(v) > 0) & F.col("__rewritten").contains(v))).cast("long"),
        )

        leak_block = (F.col("leaks") > 0) & F.lit(self.strict)
        blocked = failed | F.col("__policy_block").isNotNull() | leak_block
        # Strict jobs name the kind of error only, lenient ones give its text
        failure = F.concat(F.lit("inspection failed: "), F.col(ERROR_COL)["type"]) if self.strict else F.concat_ws(": ", F.col(ERROR_COL)["type"], F.col(ERROR_COL)["text"])
        df = (
            df.withColumn("verification_passed", ~failed & F.col("__policy_block").isNull() & (F.col("leaks") == 0))
            .withColumn("blocked", blocked)
            .withColumn(
                "action",
                F.when(failed, F.lit(INTERNAL_ERROR))
                .when(F.col("__policy_block").isNotNull(), F.lit("BLOCKED_POLICY_VIOLATION"))
                .when(leak_block, F.lit("BLOCKED_LEAKAGE_DETECTED"))
                .otherwise(F.lit("SANITIZED_AND_FORWARDED")),
            )
            .withColumn(
                "block_reason",
                F.coalesce(
                    F.when(failed, failure),
                    F.col("__policy_block"),
                    F.when(
                        leak_block,
                        F.concat(
                            F.lit("leak check: "), F.col("leaks").cast("string"), F.lit(" value(s) left in the rewritten text"),
                        ),
                    ),
                ),
            )
            .withColumn("error_type", F.col(ERROR_COL)["type"])
            .withColumn("sanitized", F.when(~F.col("blocked"), F.col("__rewritten")))
        )

        # E1 / E2 counts (every kept entity counts, PASS too; base64 hits included)
        types = F.concat(F.transform(F.col("__b64"), lambda b: b["pii_type"]), F.transform(kept, lambda e: e["pii_type"]))
        df = df.withColumn("__types", types)
        df = df.withColumn(
            "counts",
            F.map_from_arrays(
                F.array_sort(F.array_distinct(F.col("__types"))),
                F.transform(
                    F.array_sort(F.array_distinct(F.col("__types"))),
                    lambda t: F.size(F.filter(F.col("__types"), lambda x: x == t)).cast("long"),
                ),
            ),
        ).withColumn("total_detected", F.size(F.col("__types")).cast("long"))
        return df.drop("__salt", "__found", "__res", "__acted", "__policy_block", "__rewritten", "__types", "__scan", "__pieces", "__b64", "__field", "__pairs", ERROR_COL)

    # ------------------------------------------------------------------
    def _base64_stage(self, df: DataFrame) -> DataFrame:
        """Adds ``__b64``, the entities found in the base64 carriers of ``clean``, in carrier order.

        Rows without a carrier pass by. The carriers of the others become rows, each decoded text is
        scanned alone, and the entities come back by the row's number.
        """
        if df.isStreaming:
            raise ValueError("base64 carriers are scanned in batches: use run_sanitize_stream, or scan_base64=False")
        clean = F.col("clean")
        decoded = F.transform(
            F.regexp_extract_all(clean, F.lit(X.BASE64_CANDIDATE), F.lit(0)),
            lambda c: F.struct(c.alias("carrier"), F.call_function("try_to_binary", c, F.lit("base64")).cast("string").alias("txt")))
        valid = F.filter(
            decoded, lambda d: d["txt"].isNotNull() & (F.length(d["txt"]) > 0) & F.call_function("is_valid_utf8", d["txt"]))
        # base64 runs are at least 12 characters of the alphabet
        none = F.array().cast("array<struct<carrier:string,txt:string>>")
        # A row number beside the carriers keeps the filters on them, and with these copies of the decoding and of
        # the text's normalisation, from being pushed below: either is worked out once per row and branch.
        df = df.withColumn("__src", F.when(clean.rlike("[A-Za-z0-9+/]{12}"), valid).otherwise(none))
        df = df.withColumn("__held", F.coalesce(F.size("__src"), F.lit(0)) > 0).withColumn("__at", F.monotonically_increasing_id())
        held = F.col("__held") & (F.col("__at") >= 0)
        empty = F.array().cast(T.ArrayType(B64_STRUCT))
        plain = df.filter(~held).drop("__src", "__held", "__at").withColumn("__b64", empty)
        # The row itself goes with its first carrier, so the carriers need no second reading of it and no join.
        row = [c for c in df.columns if c not in ("__src", "__held", "__at")]
        carriers = df.filter(held).select("tool", "__field", "__at", F.struct(*row).alias("__row"), F.posexplode("__src").alias("__n", "__c"))
        carriers = carriers.withColumn("__row", F.when(F.col("__n") == 0, F.col("__row"))).withColumn("__txt", F.col("__c.txt"))
        found = self.detectors.apply(carriers, "__txt", "__found")
        act = lambda e: self.policy.action_col(
            F.col("tool"), e["pii_type"], F.col("__field"), category_col(e["pii_type"], e["category"]))
        ents = F.transform(F.col("__found"), lambda e: F.struct(
            *[e[f.name].alias(f.name) for f in ENTITY_STRUCT.fields], act(e).alias("action"),
            F.lit(None).cast("string").alias("repl"), F.col("__c.carrier").alias("carrier")))
        back = found.select("__at", "__n", "__row", ents.alias("__e")).groupBy("__at").agg(
            F.first("__row", ignorenulls=True).alias("__row"),
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__e"))), lambda x: x["__e"])).alias("__b64"))
        back = back.select("__row.*", F.coalesce("__b64", empty).alias("__b64"))
        # A row number that is looked at keeps the optimiser from copying all that follows into both branches.
        both = plain.unionByName(back).withColumn("__at", F.monotonically_increasing_id())
        return both.filter("__at >= 0").drop("__at")

    @staticmethod
    def _mark(i: Column) -> Column:
        """What stands for the i-th carrier while the text is scanned, between two code points that
        are no characters (and are taken out of such a text)."""
        return F.concat(F.lit("\ufdd0"), i.cast("string"), F.lit("\ufdd1"))

    def _shown(self) -> Column:
        """Carriers that get a token, each once, with the (type, value) it stands for."""
        live = F.filter(F.col("__b64"), lambda b: b["action"] != BLOCK)
        init = F.array().cast("array<struct<carrier:string,pii_type:string,value:string>>")
        return F.aggregate(live, init, lambda acc, b: F.when(F.exists(acc, lambda x: x["carrier"] == b["carrier"]), acc).otherwise(
            F.array_append(acc, F.struct(b["carrier"].alias("carrier"), b["pii_type"].alias("pii_type"), b["value"].alias("value")))))

    def _hide_carriers(self) -> Column:
        marked = F.transform(self._shown(), lambda c, i: F.struct(c["carrier"].alias("carrier"), self._mark(i).alias("mark")))
        hidden = F.aggregate(marked, F.translate("clean", "\ufdd0\ufdd1", ""), lambda acc, c: F.replace(acc, c["carrier"], c["mark"]))
        return F.when(F.size("__b64") > 0, hidden).otherwise(F.col("clean"))

    def _with_carrier_tokens(self, text: Column) -> Column:
        """Every occurrence of a carrier becomes the token that the vault holds for its decoded value."""
        def token(c: Column) -> Column:
            return F.get(F.filter(F.col("vault"), lambda v: (v["pii_type"] == c["pii_type"]) & (v["value"] == c["value"])), 0)["token"]

        marked = F.transform(self._shown(), lambda c, i: F.struct(self._mark(i).alias("mark"), token(c).alias("token")))
        return F.when(F.size("__b64") > 0, F.aggregate(marked, text, lambda acc, c: F.replace(acc, c["mark"], c["token"]))).otherwise(text)

    # ------------------------------------------------------------------
    @staticmethod
    def vault_rows(sanitized: DataFrame, key_col: str, client_col: str | None = None) -> DataFrame:
        """A10: vault table rows (request_id, pii_type, value, token, client_id, created_at).

        Blocked requests keep no vault (purged at once, G5). They are emptied in the generator: a filter on
        ``blocked`` would be pushed to the source with a copy of the whole chain for every use in it."""
        client = F.col(client_col) if client_col else F.lit(None).cast("string")
        kept = F.when(~F.col("blocked"), F.col("vault"))
        return (
            sanitized.withColumn("__kept", kept)
            .select(F.col(key_col).alias("request_id"), client.alias("client_id"), F.inline_outer("__kept"))
            .filter(F.col("token").isNotNull())
            .select("request_id", "pii_type", "value", "token", "client_id", F.current_timestamp().alias("created_at"))
        )
