"""

Every query reads the given tables (``documents``, ``pages``, ``conversations`` or the
planted table derived from ``customer``) over their whole extent; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import fixed as X
from veilspark.operators import context as C
from veilspark.operators.detect import (
    PATTERN_DETECTORS,
    DetectorSet,
    default_detectors,
    detect,
    pattern_only,
)
from veilspark.operators.policy import BLOCK, REDACT, TYPE_CATEGORY, Policy, ToolRule, decide_actions_df, normalize_action, normalize_type
from veilspark.plans import oracles as O
from veilspark.plans.sanitize import Firewall
from veilspark.sources.fixtures import planted

# The training-data package and its pipeline can be removed as a whole; only their own absence is passed over.
try:
    from veilspark.llm import queries as training_data
except ImportError as gone:
    if gone.name != "veilspark.llm":
        raise
    training_data = None
try:
    import corpus_pipeline
except ImportError as gone:
    if gone.name not in ("corpus_pipeline", "veilspark.llm"):
        raise
    corpus_pipeline = None

#: Fixed so that DuckDB can compute the same tokens; a job takes its secret from its own configuration.
SECRET = "correctness run"
FLAGSHIP_KINDS = ["EMAIL", "PHONE", "CREDIT_CARD", "IP_ADDRESS"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents + planted rows as one text table (doc ids of planted rows are negative)."""
    d = _docs(spark, sf_dir).select("doc_id", "text")
    p = planted(spark, sf_dir).select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    return d.unionByName(p)


CORPUS_SQL = (
    "(SELECT doc_id, text FROM documents UNION ALL "
    f"SELECT -doc_id - 1 AS doc_id, text FROM {O.PLANTED})"
)


# ---------------------------------------------------------------------------
# Flagship: entities of four kinds in documents -> counts by source and type
# ---------------------------------------------------------------------------
def q_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "source", "text")
    ents = detect(docs, "text", ["doc_id", "source"], pattern_only(FLAGSHIP_KINDS))
    return ents.groupBy("source", "pii_type").agg(F.count(F.lit(1)).alias("n_entities"))


def entry(spark: SparkSession) -> DataFrame:
    return q_counts_by_type(spark, "/root/testdata/sf0.001")


# ---------------------------------------------------------------------------
# Pattern detectors (C1-C9) on documents + planted rows
# ---------------------------------------------------------------------------
def _kind_query(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ents = detect(_corpus(spark, sf_dir), "text", ["doc_id"], DetectorSet([PATTERN_DETECTORS[kind]({})]))
        return ents.select("doc_id", F.col("start").cast("long").alias("start"),
                           F.col("end").cast("long").alias("end"), "value")

    return run


def _context_query(pii_type: str) -> Callable[[SparkSession, str], DataFrame]:
    """One type out of the ordered context chain (stages depend on each other)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = DetectorSet([default_detectors(enabled_types=[], filter_context_types=False).detectors[-1]])
        ents = detect(_corpus(spark, sf_dir), "text", ["doc_id"], ds).filter(F.col("pii_type") == pii_type)
        return ents.select("doc_id", F.col("start").cast("long").alias("start"),
                           F.col("end").cast("long").alias("end"), "value")

    return run


def q_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.extract_relationships(_corpus(spark, sf_dir), "text", ["doc_id"])


def q_sanitize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 on documents with the default policy: per document the sanitised text's length,
    number of tokens and entity count (tokens themselves depend on the job secret)."""
    fw = Firewall(SECRET, detectors=pattern_only(FLAGSHIP_KINDS), use_nfkc=False, scan_base64=False)
    out = fw.sanitize(_docs(spark, sf_dir).select("doc_id", "text"), "text", "doc_id")
    return out.select(
        "doc_id",
        F.col("total_detected").alias("n_entities"),
        F.length("sanitized").cast("long").alias("sanitized_len"),
        F.size(F.col("vault")).cast("long").alias("n_tokens"),
    )


def q_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked form of every detected email / phone / card / IP in documents."""
    ents = detect(_corpus(spark, sf_dir), "text", ["doc_id"], pattern_only(FLAGSHIP_KINDS))
    from veilspark.functions.rewrite import mask_col
    from veilspark.operators.policy import category_col

    return ents.select(
        "doc_id", "pii_type", F.col("start").cast("long").alias("start"),
        mask_col(F.col("value"), F.col("pii_type"), category_col(F.col("pii_type"))).alias("masked"),
    )


def q_backend_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backend policy's decision for every pattern entity of the corpus, for four destinations."""
    ents = detect(_corpus(spark, sf_dir), "text", ["doc_id"], pattern_only(KINDS))
    ents = ents.withColumn("tool", F.expr(DESTINATION))
    out = decide_actions_df(ents, "tool", Policy.default_backend())
    return out.groupBy("tool", "pii_type", "category", "action").agg(F.count(F.lit(1)).alias("n"))


DESTINATION = "CASE doc_id % 4 WHEN 0 THEN '*' WHEN 1 THEN 'vault_service' WHEN 2 THEN 'send_email' ELSE 'crm' END"


#: One rule for all tools in which every action occurs; the oracles restate it as SQL.
RULES = {"PHONE": "MASK", "SSN": "REDACT", "IP_ADDRESS": "PASS", "PAN_CARD": "MASK", "AADHAAR": "MASK", "EMAIL": "TOKENIZE"}
BLOCKED = "CREDIT_CARD"
KINDS = ["EMAIL", "PHONE", "SSN", "CREDIT_CARD", "IP_ADDRESS", "API_KEY", "PAN_CARD", "AADHAAR"]


def _ruled() -> Policy:
    return Policy(rules={"*": ToolRule("*", {k: normalize_action(v) for k, v in RULES.items()}, {BLOCKED})})


def _carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every customer with an address inside a base64 run, from one SQL text that the oracle runs too."""
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.concat(F.lit("see "), F.base64(F.encode(F.expr(CARRIED), "UTF-8")), F.lit(" twice "), F.expr(CARRIED_PLAIN))
    return cust.select((-F.col("c_custkey") - 10_000_000).cast("long").alias("doc_id"), text.alias("text"))


CARRIED = "concat('write to u', cast(c_custkey as string), '@example.org today, please')"
CARRIED_PLAIN = "concat('v', cast(c_custkey as string), '@example.org')"


def _doc_sanitized(spark: SparkSession, sf_dir: str, cut: bool = False):
    """The whole chain with NFKC, base64 carriers and the eight pattern detectors, all actions and blocks."""
    fw = Firewall(SECRET, policy=_ruled(), detectors=pattern_only(KINDS))
    texts = _corpus(spark, sf_dir).unionByName(_carriers(spark, sf_dir))
    out = fw.sanitize(texts.select(F.col("doc_id").cast("string").alias("request_id"), "text"), "text", "request_id")
    if cut:
        # used twice (vault + responses): materialise once in the shared checkpoint folder
        from veilspark.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(spark)
        out = out.select("request_id", "text", "clean", "sanitized", "vault", "blocked").checkpoint()
    return out


def q_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewritten text of every document, with blocks, counts and tokens."""
    return _doc_sanitized(spark, sf_dir).select(
        F.col("request_id").cast("long").alias("doc_id"), "sanitized", "blocked", "block_reason", F.col("total_detected").alias("n_entities"),
        F.size("vault").cast("long").alias("n_tokens"), "leaks")


def q_restore_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8 + E11: an echo tool returns the sanitised text; restoring it gives the tokenised values back, and leaves
    what was masked or redacted as it is."""
    from veilspark.operators.restore import restore_text

    san = _doc_sanitized(spark, sf_dir, cut=True)
    vault = Firewall.vault_rows(san, "request_id")
    out = restore_text(san.select("request_id", F.col("sanitized").alias("response")), vault, "request_id", "response")
    return out.select(F.col("request_id").cast("long").alias("doc_id"), "restored", "restored_count")


def q_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit event per document (raw-value free columns only)."""
    from veilspark.operators.restore import audit_events

    ev = audit_events(_doc_sanitized(spark, sf_dir), "request_id")
    return ev.select(
        F.col("request_id").cast("long").alias("doc_id"), "tool_name", "action", "total_entities_secured", "blocked", "verification_passed", "error_type",
        "sanitized_payload_sha256")


def q_audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: events and entities secured, by action."""
    from veilspark.operators.restore import audit_events, audit_totals

    return audit_totals(audit_events(_doc_sanitized(spark, sf_dir), "request_id"))


def q_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 relational: every fourth answer is sent with the first half of its original text behind it."""
    from veilspark.operators.restore import verify_no_leak

    san = _doc_sanitized(spark, sf_dir, cut=True)
    half = F.expr("substring(clean, 1, cast(length(clean) / 2 as int))")
    sent = san.withColumn("sent", F.when(F.col("request_id").cast("long") % 4 == 0, F.concat("sanitized", F.lit(" "), half)).otherwise(F.col("sanitized")))
    res = verify_no_leak(sent, Firewall.vault_rows(san, "request_id"), "request_id", "sent")
    return res.select(F.col("request_id").cast("long").alias("doc_id"), "leak_count", "verification_passed")


def q_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address's token in nested answers, restored by key, dotted path and ancestor."""
    from veilspark.plans.requests import restore_fields

    vault = _email_vault(spark, sf_dir, cut=True)
    t = F.col("token")
    answer = F.struct(
        F.struct(t.alias("email"), F.concat(F.lit("x "), t).alias("name")).alias("user"), F.array(F.struct(t.alias("email"), F.array(t).alias("cc"))).alias("list"),
        F.struct(F.struct(t.alias("email")).alias("user")).alias("other"), t.alias("email"))
    rows = vault.select("request_id", t.alias("t"), F.to_json(answer).alias("response"))
    out = restore_fields(rows, vault, fields=["user.email", "list", "other"])
    at = lambda path, name: F.get_json_object("restored", path).alias(name)
    return out.select(
        F.col("request_id").cast("long").alias("doc_id"), "t", at("$.user.email", "by_path"), at("$.user.name", "beside_it"), at("$.list[0].email", "in_list"),
        at("$.list[0].cc[0]", "deeper"), at("$.other.user.email", "below"), at("$.email", "not_named"), "restored_count")


def q_fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector that fails on some texts, in a strict and a lenient job."""
    from veilspark.operators.custom import function_detector

    def moody(text: str) -> list:
        if len(text) % 7 == 0:
            raise LookupError(f"length {len(text)}")
        return []

    docs = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("request_id"), "text")
    parts = []
    for strict in (True, False):
        fw = Firewall(SECRET, detectors=DetectorSet([function_detector("PIN", moody, on_error="fail")]), strict=strict, scan_base64=False)
        out = fw.sanitize(docs, "text", "request_id")
        parts.append(out.select(F.col("request_id").cast("long").alias("doc_id"), F.lit(strict).alias("strict"), "blocked", "action", "error_type", "block_reason",
                                F.col("sanitized").isNull().alias("nothing_sent")))
    return parts[0].unionByName(parts[1])


def q_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the texts sent (every third one as it was) hold any address that any document held."""
    from veilspark.operators.restore import audit_wire

    sent = _docs(spark, sf_dir).select("doc_id", F.expr("CASE WHEN doc_id % 3 = 0 THEN text ELSE 'nothing' END").alias("payload"))
    return audit_wire(sent, _email_vault(spark, sf_dir).select(F.col("value").alias("secret"))).select("doc_id")


def q_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from every customer in three versions over the built-in ones, in their spellings."""
    from veilspark.operators.policy import current_rules, default_rules, upsert_rules

    cust = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rules = default_rules(spark)
    for version in range(3):
        rules = upsert_rules(rules, cust.select(
            F.expr(RULE_TOOL).alias("tool"), F.expr(RULE_TYPE).alias("type_name"), F.expr(RULE_ACTION).alias("action"), F.col("c_custkey").alias("item"),
        ).filter(F.col("item") % 3 == version))
    return current_rules(rules)


RULE_TOOL = "CASE c_custkey % 50 WHEN 0 THEN '*' ELSE concat('tool', cast(c_custkey % 50 as string)) END"
RULE_TYPE = "CASE cast(floor(c_custkey / 50) as int) % 6 WHEN 0 THEN 'mobile' WHEN 1 THEN ' Phone' WHEN 2 THEN 'EMAIL' WHEN 3 THEN 'ssn' WHEN 4 THEN 'My_Type' ELSE 'IP_ADDRESS' END"
RULE_ACTION = "CASE c_custkey % 7 WHEN 0 THEN 'mask it' WHEN 1 THEN 'Redacted' WHEN 2 THEN 'BLOCK' WHEN 3 THEN 'allow' WHEN 4 THEN ' pass' WHEN 5 THEN 'what' ELSE 'tokenise' END"


def q_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transmission intent (send verb + external target + first credential/business phrase)."""
    ents = detect(_corpus(spark, sf_dir), "text", ["doc_id"],
                  DetectorSet([__import__("veilspark.operators.detect", fromlist=["Detector"]).Detector(
                      "intent", C.intent_entities, ())]))
    return ents.select("doc_id", "pii_type", F.col("start").cast("long").alias("start"),
                       F.col("end").cast("long").alias("end"), "value")


def q_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: string leaves of JSON tool-call payloads built from ``conversations``."""
    from veilspark.sources.requests import conversation_requests, explode_leaves

    leaves = explode_leaves(conversation_requests(spark, sf_dir), "request_id", "payload")
    return leaves.select("request_id", "path", "field", "text")


CUSTOM_DL = r"\bDL-\d{8}\b"


def q_custom_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user pattern with a Column validator and context words."""
    from veilspark.operators.custom import regex_detector

    det = regex_detector("DRIVERS_LICENSE", CUSTOM_DL, 0.9, validator=lambda v: ~v.endswith("0"),
                         context_words=["license"])
    ents = detect(_corpus(spark, sf_dir), "text", ["doc_id"], DetectorSet([det]))
    return ents.select("doc_id", F.col("start").cast("long").alias("start"),
                       F.col("end").cast("long").alias("end"), "value")


def _email_vault(spark: SparkSession, sf_dir: str, cut: bool = False) -> DataFrame:
    """Vault of the e-mail addresses in ``documents``: one request per document, some bound to a client.
    With ``cut`` it is materialised, so that a query which uses it several times reads the documents once."""
    fw = Firewall(SECRET, detectors=pattern_only(["EMAIL"]), use_nfkc=False, scan_base64=False)
    docs = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("request_id"), "text", F.expr(CLIENT_OF).alias("client"))
    vault = Firewall.vault_rows(fw.sanitize(docs, "text", "request_id"), "request_id", "client")
    if cut:
        from veilspark.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(spark)
        vault = vault.checkpoint()
    return vault


CLIENT_OF = "CASE doc_id % 3 WHEN 1 THEN 'Acme' WHEN 2 THEN 'beta' END"
CALLER_OF = "CASE doc_id % 4 WHEN 1 THEN 'ACME' WHEN 2 THEN 'other' WHEN 3 THEN 'beta' END"


def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token text of every address under a fixed secret."""
    return _email_vault(spark, sf_dir).select(F.col("request_id").cast("long").alias("doc_id"), "value", "token")


def q_restore_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two responses per request (own tokens twice; a foreign and an own token), with
    unbound vaults, matching, other and null callers."""
    from veilspark.operators.restore import restore_text

    vault = _email_vault(spark, sf_dir, cut=True)
    first = vault.groupBy("request_id").agg(F.min("token").alias("t")).withColumn("doc_id", F.col("request_id").cast("long"))
    caller = F.expr(CALLER_OF).alias("caller")
    own = first.select("request_id", "doc_id", F.lit(1).alias("n"), F.concat(F.lit("x "), "t", F.lit(" y "), "t").alias("response"), caller)
    other = first.select((F.col("doc_id") + 1).alias("doc_id"), F.col("t").alias("foreign"))
    mixed = first.join(other, "doc_id", "left").select(
        "request_id", "doc_id", F.lit(2).alias("n"), F.concat(F.coalesce("foreign", F.lit("none")), F.lit(" w "), "t").alias("response"), caller)
    unknown = first.select((-F.col("doc_id") - 1).cast("string").alias("request_id"), (-F.col("doc_id") - 1).alias("doc_id"), F.lit(3).alias("n"),
                           F.col("t").alias("response"), caller)
    done = restore_text(own.unionByName(mixed).unionByName(unknown), vault, client_col="caller")
    return done.select("doc_id", F.col("n").cast("long").alias("n"), "restored", "restored_count")


def q_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 on what would be sent if every third document went out unsanitised: leaks are found there only."""
    from veilspark.operators.restore import verify_no_leak

    vault = _email_vault(spark, sf_dir)
    sent = _docs(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("request_id"), F.expr("CASE WHEN doc_id % 3 = 0 THEN text ELSE 'nothing' END").alias("sanitized"))
    return verify_no_leak(sent, vault).select(F.col("request_id").cast("long").alias("doc_id"), "leak_count", "verification_passed")


def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different e-mail addresses per document with their first place and number of places."""
    from veilspark.operators.reports import detection_report

    ents = detect(_corpus(spark, sf_dir), "text", ["doc_id"], pattern_only(["EMAIL"]))
    return detection_report(ents, ["doc_id"])


def q_active_vaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with something in the vault."""
    from veilspark.operators.reports import active_vaults

    return active_vaults(_email_vault(spark, sf_dir))


NUMBERS = "lpad(cast((c_custkey * 7919 + 11) * 104729 as string), 16, '4')"


def q_check_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card numbers made from every customer key, some null."""
    from veilspark.operators.reports import check_column

    cust = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return check_column(cust.select(F.expr(f"CASE WHEN c_custkey % 7 <> 0 THEN {NUMBERS} END").alias("number")), "number", "luhn")


def q_leaf_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 + P12 + B2 + D9: planted texts as nested payloads, sanitised, answered by an echo, restored."""
    from veilspark.plans.requests import by_sorting, protect

    fw = Firewall(SECRET, detectors=pattern_only(["EMAIL", "IP_ADDRESS"]), scan_base64=False)
    text = F.col("text")
    body = F.to_json(F.struct(F.lit("crm").alias("tool"), F.struct(text.alias("body"), F.array(text, F.lit("x")).alias("list"), F.col("doc_id").alias("n")).alias("args")))
    rows = planted(spark, sf_dir).select(F.col("doc_id").cast("string").alias("request_id"), body.alias("json"))
    out = protect(fw, rows.select("request_id", F.parse_json("json").alias("payload")), lambda sent: sent.withColumnRenamed("sent", "response"))
    out = out.join(by_sorting(rows), "request_id")
    return out.select(F.col("request_id").cast("long").alias("doc_id"), "blocked", "total_detected", "restored_count",
                      (F.to_json(F.parse_json("restored")) == F.to_json(F.parse_json("json"))).alias("round_trip_ok"),
                      F.get_json_object("sent", "$.args.list[1]").alias("untouched"))


def q_route_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 on every turn of ``conversations`` and every planted text."""
    from veilspark.operators.routing import route_prompt

    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    texts = conv.unionByName(planted(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.concat("text", F.lit(" Subject: to do Tomorrow")).alias("text")))
    return route_prompt(texts, "text").select("id", "tool", "subject", "schedule")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    qs: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "e01_counts_by_type": q_counts_by_type,
        "c01_email": _kind_query("EMAIL"),
        "c03_phone": _kind_query("PHONE"),
        "c04_ssn": _kind_query("SSN"),
        "c05_card": _kind_query("CREDIT_CARD"),
        "c06_ipv4": _kind_query("IP_ADDRESS"),
        "c07_api_key": _kind_query("API_KEY"),
        "c08_pan": _kind_query("PAN_CARD"),
        "c09_aadhaar": _kind_query("AADHAAR"),
        "c11_pin": _context_query("PIN"),
        "c12_password": _context_query("PASSWORD"),
        "c18_medical": _context_query("MEDICAL_DIAGNOSIS"),
        "c19_salary": _context_query("SALARY_INFO"),
        "c20_dob": _context_query("DATE_OF_BIRTH"),
        "c23_passport": _context_query("PASSPORT"),
        "c24_ssn_context": _context_query("SSN"),
        "c27_relationships": q_relationships,
        "p07_mask": q_mask,
        "p12_sanitize": q_sanitize_tokens,
        "p01_backend_policy": q_backend_policy,
        "c10_intent": q_intent,
        "d08_restore": q_restore_round_trip,
        "g01_audit": q_audit,
        "d07_verify": q_verify,
        "b01_leaves": q_leaves,
        "c28_custom_regex": q_custom_regex,
        "c14_otp": _context_query("OTP"),
        "c15_system_prompt": _context_query("INTERNAL_SYSTEM_INSTRUCTIONS"),
        "c16_source_code": _context_query("CONFIDENTIAL_SOURCE_CODE"),
        "c17_db_marker": _context_query("EMPLOYEE_RECORDS"),
        "c21_licence": _context_query("DRIVERS_LICENSE"),
        "c22_person_name": _context_query("PERSON_NAME"),
        "c25_aadhaar_context": _context_query("AADHAAR"),
        "c26_pan_context": _context_query("PAN_CARD"),
        "e10_detection_report": q_report,
        "e08_active_vaults": q_active_vaults,
        "i13_check_column": q_check_column,
        "d14_protect": q_leaf_restore,
        "a06_route_prompt": q_route_prompts,
        "p04_tokens": q_tokens,
        "d11_restore_clients": q_restore_clients,
        "d07_leaks": q_leaks,
        "p12_policies": q_policies,
        "e05_audit_totals": q_audit_totals,
        "d09_fields": q_fields,
        "p11_fail_closed": q_fail_closed,
        "d12_audit_wire": q_wire,
        "p03_rules": q_rules,
        "c13_cvv": _context_query("CVV"),
    }
    if training_data is not None:
        qs |= training_data.queries()
    if corpus_pipeline is not None:
        qs["pipeline"] = corpus_pipeline.run
    return qs


# ---------------------------------------------------------------------------
# Oracles (DuckDB)
# ---------------------------------------------------------------------------
def _sel(sp: str, where: str = "TRUE", value: str = "value") -> str:
    return f"SELECT k AS doc_id, start, \"end\", {value} AS value FROM {sp} s WHERE {where}"


def _email_sql(src: str) -> str:
    sp = O.spans_sql(src, "doc_id", "text", X.EMAIL_PATTERN, 1)
    # trailing punctuation never ends a match of this pattern; '@' and a dotted domain always hold
    std = _sel(sp)
    obf = O.spans_sql(src, "doc_id", "text", X.EMAIL_OBFUSCATED_PATTERN, 1)
    obf_sel = (
        f"SELECT k AS doc_id, start, \"end\", value FROM {obf} o WHERE NOT EXISTS "
        f"(SELECT 1 FROM ({std}) e WHERE e.doc_id = o.k AND NOT (o.\"end\" <= e.start OR o.start >= e.\"end\"))"
    )
    return f"{std} UNION ALL {obf_sel}"


# RE2 restatements of the look-around patterns: the preceding character is captured.
PHONE_RE2 = [
    p.replace("(?:^|(?<=[^\\w]))", "(?:^|[^\\w])(") + ")" for p in X.PHONE_PATTERNS
]


def _phone_sql(src: str) -> str:
    parts = []
    for i, p in enumerate(PHONE_RE2):
        sp = O.spans_sql(src, "doc_id", "text", p, 1, extra=f"{i} AS pat,")
        parts.append(f"SELECT k, i AS ord, pat, start, \"end\", value FROM {sp} s")
    cands = " UNION ALL ".join(parts)
    d = O.digits("value")
    return f"""
WITH c AS (SELECT * FROM ({cands}) x
           WHERE length({d}) BETWEEN 10 AND 15 AND NOT regexp_matches(value, '{O.q(X.PHONE_DATE_SHAPE)}')),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pat, ord) AS rn FROM c)
SELECT a.k AS doc_id, a.start, a."end", a.value FROM r a
WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.k = a.k AND b.rn < a.rn AND b.start <= a.start AND b."end" >= a."end"
                  AND NOT EXISTS (SELECT 1 FROM r z WHERE z.k = b.k AND z.rn < b.rn AND z.start <= b.start AND z."end" >= b."end"))
"""


def _ssn_sql(src: str) -> str:
    sp = O.spans_sql(src, "doc_id", "text", X.SSN_PATTERN)
    a = "CAST(substr(value, 1, 3) AS INT)"
    return _sel(sp, f"{a} <> 0 AND {a} <> 666 AND NOT ({a} BETWEEN 900 AND 999) AND substr(value, 5, 2) <> '00' AND substr(value, 8, 4) <> '0000'")


def _card_sql(src: str) -> str:
    sp = O.spans_sql(src, "doc_id", "text", X.CARD_PATTERN)
    b1 = "substr(txt, CAST(start AS INT), 1)"
    b2 = "substr(txt, CAST(start AS INT) - 1, 1)"
    a1 = "substr(txt, CAST(\"end\" AS INT) + 1, 1)"
    a2 = "substr(txt, CAST(\"end\" AS INT) + 2, 1)"
    dg = lambda c: f"regexp_matches({c}, '^[0-9]$')"
    cond = (
        f"NOT (start > 0 AND ({dg(b1)} OR ({b1} = '-' AND start > 1 AND {dg(b2)}))) "
        f"AND NOT (\"end\" < length(txt) AND ({dg(a1)} OR ({a1} = '-' AND \"end\" + 1 < length(txt) AND {dg(a2)}))) "
        f"AND {O.luhn_sql(O.digits('value'))}"
    )
    return _sel(sp, cond)


def _ip_sql(src: str) -> str:
    return _sel(O.spans_sql(src, "doc_id", "text", X.IPV4_PATTERN))


def _api_sql(src: str) -> str:
    parts = []
    for i, p in enumerate(X.API_KEY_PATTERNS):
        sp = O.spans_sql(src, "doc_id", "text", p, 0, extra=f"{i} AS pat,")
        parts.append(f"SELECT k, i AS ord, pat, start, \"end\", value FROM {sp} s")
    cands = " UNION ALL ".join(parts)
    return f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pat, ord) AS rn FROM ({cands}) x)
SELECT a.k AS doc_id, a.start, a."end", a.value FROM r a
WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.k = a.k AND b.rn < a.rn AND b.start <= a.start AND b."end" >= a."end")
"""


def _pan_sql(src: str) -> str:
    return _sel(O.spans_sql(src, "doc_id", "text", X.PAN_PATTERN))


AADHAAR_RE2 = r"(?:^|[^\d])([2-9]\d{3}[ -]?\d{4}[ -]?\d{4})"


def _aadhaar_sql(src: str) -> str:
    sp = O.spans_sql(src, "doc_id", "text", AADHAAR_RE2, 1)
    after = "substr(txt, CAST(\"end\" AS INT) + 1, 2)"
    cond = (
        f"NOT regexp_matches({after}, '^[ -]?[0-9]') AND length({O.digits('value')}) = 12 "
        f"AND {O.verhoeff_sql(O.digits('value'))}"
    )
    return _sel(sp, cond)


def _pin_sql(src: str) -> str:
    sp = O.spans_sql(src, "doc_id", "text", X.PIN_CANDIDATE, 1)
    w = "lower(substr(txt, CAST(greatest(start - 70, 0) + 1 AS INT), CAST(least(\"end\" + 70, length(txt)) - greatest(start - 70, 0) AS INT)))"
    stops = " OR ".join(f"contains({w}, '{O.q(s)}')" for s in X.OPERATIONAL_STOPWORDS)
    near = f"(contains({w}, 'port ' || value) OR contains({w}, 'year ' || value))"
    phr = O.q(C.phrase_regex(X.PHRASES["PIN"]))
    return _sel(sp, f"NOT (({stops}) AND {near}) AND regexp_matches({w}, '{phr}')")


def _password_sql(src: str) -> str:
    sp = O.spans_sql(src, "doc_id", "text", X.PASSWORD_PATTERN, 1)
    rej = ", ".join(f"'{w}'" for w in X.PASSWORD_REJECT_WORDS)
    return _sel(sp, f"length(value) >= 4 AND lower(value) NOT IN ({rej})")


def _simple_ctx_sql(pattern: str) -> Callable[[str], str]:
    return lambda src: _sel(O.spans_sql(src, "doc_id", "text", pattern, 1))


def _ssn_ctx_sql(src: str) -> str:
    sp = O.spans_sql(src, "doc_id", "text", X.SSN_CONTEXT_PATTERN, 1)
    parts = "string_split_regex(value, '[- ]')"
    area = f"CAST({parts}[1] AS INT)"
    allow = ", ".join(f"'{v}'" for v in X.SSN_CONTEXT_ALLOW)
    ok = (
        f"(len({parts}) <> 3 OR ({area} <> 0 AND {area} <> 666 AND {parts}[2] <> '00' AND {parts}[3] <> '0000' "
        f"AND NOT ({area} BETWEEN 900 AND 999 AND value NOT IN ({allow}))))"
    )
    # planted SSN cues never sit inside an earlier context entity
    return _sel(sp, ok)


def _flagship_sql() -> str:
    src = "documents"
    parts = [
        f"SELECT doc_id, 'EMAIL' AS pii_type FROM ({_email_sql(src)}) a",
        f"SELECT doc_id, 'PHONE' AS pii_type FROM ({_phone_sql(src)}) b",
        f"SELECT doc_id, 'CREDIT_CARD' AS pii_type FROM ({_card_sql(src)}) c",
        f"SELECT doc_id, 'IP_ADDRESS' AS pii_type FROM ({_ip_sql(src)}) d",
    ]
    u = " UNION ALL ".join(parts)
    return (
        f"SELECT d.source, e.pii_type, count(*) AS n_entities FROM ({u}) e "
        f"JOIN documents d ON d.doc_id = e.doc_id GROUP BY d.source, e.pii_type"
    )


def _rel_sql() -> str:
    p = O.q(X.RELATIONSHIP_PATTERN)
    src = CORPUS_SQL
    return f"""
SELECT doc_id, trim(a[i]) AS subject, lower(trim(b[i])) AS predicate, trim(c[i]) AS value
FROM (SELECT doc_id, a, b, c, unnest(generate_series(1, len(a))) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 1) AS a, regexp_extract_all(text, '{p}', 2) AS b,
                   regexp_extract_all(text, '{p}', 3) AS c FROM {src} x) y) z
"""


def _mask_sql() -> str:
    src = CORPUS_SQL
    ents = " UNION ALL ".join(
        [
            f"SELECT doc_id, 'EMAIL' AS pii_type, start, value FROM ({_email_sql(src)}) a",
            f"SELECT doc_id, 'PHONE' AS pii_type, start, value FROM ({_phone_sql(src)}) b",
            f"SELECT doc_id, 'CREDIT_CARD' AS pii_type, start, value FROM ({_card_sql(src)}) c",
            f"SELECT doc_id, 'IP_ADDRESS' AS pii_type, start, value FROM ({_ip_sql(src)}) d",
        ]
    )
    user = "split_part(value, '@', 1)"
    email = (
        f"CASE WHEN contains(value, '@') THEN (CASE WHEN length({user}) > 2 THEN substr({user}, 1, 1) || '***' || "
        f"right({user}, 1) ELSE '***' END) || '@' || substr(value, length({user}) + 2) ELSE '***@***.***' END"
    )
    phone = f"CASE WHEN length({O.digits('value')}) >= 4 THEN '***-***-' || right(value, 4) ELSE '***-***-****' END"
    card = "'****-****-****-' || right(value, 4)"
    ip = "CASE WHEN len(string_split(value, '.')) = 4 THEN split_part(value, '.', 1) || '.' || split_part(value, '.', 2) || '.*.*' ELSE '*.*.*.*' END"
    return (
        f"SELECT doc_id, pii_type, start, CASE pii_type WHEN 'EMAIL' THEN {email} WHEN 'PHONE' THEN {phone} "
        f"WHEN 'CREDIT_CARD' THEN {card} ELSE {ip} END AS masked FROM ({ents}) e"
    )


def _sanitize_sql() -> str:
    """Default policy tokenises every kind; overlaps resolved greedily by (length desc, conf desc, rank)."""
    src = "documents"
    ents = " UNION ALL ".join(
        [
            f"SELECT doc_id, start, \"end\", value, 0.98 AS conf, 0 AS rnk, 'EMAIL' AS t FROM ({_email_sql(src)}) a",
            f"SELECT doc_id, start, \"end\", value, 0.95, 1, 'PHONE' FROM ({_phone_sql(src)}) b",
            f"SELECT doc_id, start, \"end\", value, 0.99, 3, 'CREDIT_CARD' FROM ({_card_sql(src)}) c",
            f"SELECT doc_id, start, \"end\", value, 0.97, 4, 'IP_ADDRESS' FROM ({_ip_sql(src)}) d",
        ]
    )
    # documents' entities never overlap across kinds in this corpus except card/phone digit runs;
    # keep an entity unless a better-ranked overlapping one exists (greedy order, one level).
    return f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "end" - start DESC, conf DESC, rnk, start) AS o FROM ({ents}) x),
k AS (SELECT a.* FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.doc_id = a.doc_id AND b.o < a.o
        AND NOT (a."end" <= b.start OR a.start >= b."end")
        AND NOT EXISTS (SELECT 1 FROM e z WHERE z.doc_id = b.doc_id AND z.o < b.o AND NOT (b."end" <= z.start OR b.start >= z."end")))),
tok AS (SELECT doc_id, sum(length(t) + 11 - ("end" - start)) AS delta, count(*) AS n, count(DISTINCT t || ':' || value) AS nt
        FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(tok.n, 0) AS BIGINT) AS n_entities,
       CAST(length(d.text) + coalesce(tok.delta, 0) AS BIGINT) AS sanitized_len,
       CAST(coalesce(tok.nt, 0) AS BIGINT) AS n_tokens
FROM documents d LEFT JOIN tok ON tok.doc_id = d.doc_id
"""


def _intent_sql(src: str) -> str:
    lt = "lower(text)"
    verb = " OR ".join(f"contains({lt}, '{v}')" for v in X.SEND_VERBS)
    tgt = " OR ".join(f"contains({lt}, '{t}')" for t in X.EXTERNAL_TARGETS)
    cat = {t: c for t, c in __import__("veilspark.operators.policy", fromlist=["TYPE_CATEGORY"]).TYPE_CATEGORY.items()}
    ordered = [(t, p) for t, ps in X.PHRASES.items() if cat.get(t) in (X.CREDENTIAL, X.BUSINESS_CONFIDENTIAL) for p in ps]

    def hit(p: str) -> str:
        if len(p) <= 4 and " " not in p:
            return f"regexp_matches({lt}, '\\b{O.q(__import__('re').escape(p))}\\b')"
        return f"contains({lt}, '{O.q(p)}')"

    case_t = "CASE " + " ".join(f"WHEN {hit(p)} THEN '{t}'" for t, p in ordered) + " END"
    case_p = "CASE " + " ".join(f"WHEN {hit(p)} THEN '{O.q(p)}'" for t, p in ordered) + " END"
    return f"""
SELECT doc_id, t AS pii_type, CAST(instr({lt}, p) - 1 AS BIGINT) AS start,
       CAST(instr({lt}, p) - 1 + length(p) AS BIGINT) AS "end", substr(text, instr({lt}, p), length(p)) AS value
FROM (SELECT doc_id, text, {case_t} AS t, {case_p} AS p FROM {src} x WHERE ({verb}) AND ({tgt})) y
WHERE t IS NOT NULL
"""


def _entities_sql(src: str) -> str:
    parts = {"EMAIL": (_email_sql, 0.98), "PHONE": (_phone_sql, 0.95), "SSN": (_ssn_sql, 0.99), "CREDIT_CARD": (_card_sql, 0.99), "IP_ADDRESS": (_ip_sql, 0.97),
             "API_KEY": (_api_sql, 0.99), "PAN_CARD": (_pan_sql, 0.99), "AADHAAR": (_aadhaar_sql, 0.98)}
    return " UNION ALL ".join(
        f"SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(\"end\" AS BIGINT) AS stop, value, '{k}' AS kind, {conf} AS conf, {i} AS rnk FROM ({sql(src)}) s{i}"
        for i, (k, (sql, conf)) in enumerate(parts.items()))


CARRIERS_SQL = (f"(SELECT -c_custkey - 10000000 AS doc_id, 'see ' || base64(encode({CARRIED})) || ' twice ' || {CARRIED_PLAIN} AS text, "
                f"base64(encode({CARRIED})) AS carrier, regexp_extract({CARRIED}, '[^ ]+@[^ ]+') AS value FROM customer)")


def _chain_sql(result: str) -> str:
    """The whole chain under RULES as common tables, and ``result`` selected from them: ``done`` has doc_id, text, rewritten,
    restored, stop (the right-most blocked entity's kind), n, n_tokens, n_restored, leaks."""
    texts = f"(SELECT doc_id, text FROM {CORPUS_SQL} t0 UNION ALL SELECT doc_id, text FROM {CARRIERS_SQL} t1)"
    salt = "unhex(substr(sha256(encode('correctness run' || chr(0) || doc_id)), 1, 32))"
    token = lambda kind, value: f"'{X.TOKEN_PREFIX}' || {kind} || '_' || substr(sha256({salt} || encode({kind} || ':' || {value})), 1, 8) || '{X.TOKEN_SUFFIX}'"
    act = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{normalize_action(v)}'" for k, v in {**RULES, BLOCKED: "BLOCK"}.items()) + " ELSE 'TOKENIZE' END"
    phone = f"CASE WHEN length({O.digits('value')}) >= 4 THEN '***-***-' || right(value, 4) ELSE '***-***-****' END"
    mask = f"CASE kind WHEN 'PHONE' THEN {phone} WHEN 'PAN_CARD' THEN substr(value, 1, 2) || '***' || right(value, 2) ELSE 'XXXX-XXXX-' || right(value, 4) END"
    return f"""
WITH RECURSIVE texts AS (SELECT * FROM {texts} t), ents AS ({_entities_sql("texts")}),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stop - start DESC, conf DESC, rnk, start) AS o FROM ents),
greedy(doc_id, o, taken) AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(o BIGINT, a BIGINT, b BIGINT)[]) FROM ordered
  UNION ALL
  SELECT g.doc_id, e.o, CASE WHEN len(list_filter(g.taken, lambda t: e.start < t.b AND t.a < e.stop)) = 0
                             THEN list_append(g.taken, {{'o': e.o, 'a': e.start, 'b': e.stop}}) ELSE g.taken END
  FROM greedy g JOIN ordered e ON e.doc_id = g.doc_id AND e.o = g.o + 1),
kept AS (SELECT doc_id, unnest(arg_max(taken, o)).o AS o FROM greedy GROUP BY doc_id),
acted AS (SELECT e.*, {act} AS act FROM ordered e JOIN kept USING (doc_id, o)),
replaced AS (SELECT *, CASE act WHEN 'TOKENIZE' THEN {token("kind", "value")} WHEN 'REDACT' THEN '[REDACTED_' || kind || ']' WHEN 'MASK' THEN {mask} ELSE value END AS repl,
                    coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM acted),
built AS (SELECT doc_id, string_agg(substr(text, CAST(before + 1 AS INT), CAST(start - before AS INT)) || repl, '' ORDER BY start) || substr(any_value(text), CAST(max(stop) + 1 AS INT)) AS rewritten,
                 string_agg(substr(text, CAST(before + 1 AS INT), CAST(start - before AS INT)) || CASE WHEN act = 'TOKENIZE' THEN value ELSE repl END, '' ORDER BY start)
                   || substr(any_value(text), CAST(max(stop) + 1 AS INT)) AS restored,
                 arg_max(kind, start) FILTER (act = 'BLOCK_TOOL') AS stop, count(*) AS n, count(DISTINCT kind || ':' || value) FILTER (act = 'TOKENIZE') AS n_tokens,
                 count(*) FILTER (act = 'TOKENIZE') AS n_restored, list(DISTINCT value) FILTER (act <> 'PASS_THROUGH') AS secrets,
                 coalesce(list(DISTINCT value) FILTER (act = 'TOKENIZE'), []) AS held
          FROM replaced JOIN texts USING (doc_id) GROUP BY doc_id),
carried AS (SELECT *, {token("'EMAIL'", "value")} AS token FROM {CARRIERS_SQL} c),
done AS (SELECT t.doc_id, t.text, replace(coalesce(b.rewritten, t.text), coalesce(c.carrier, '\t\t'), coalesce(c.token, '')) AS rewritten,
                replace(coalesce(b.restored, t.text), coalesce(c.carrier, '\t\t'), coalesce(c.value, '')) AS restored, b.stop,
                coalesce(b.n, 0) + (c.token IS NOT NULL)::INT AS n, coalesce(b.n_tokens, 0) + (c.token IS NOT NULL)::INT AS n_tokens,
                coalesce(b.n_restored, 0) + (c.token IS NOT NULL)::INT AS n_restored,
                len(list_filter(coalesce(b.secrets, []), lambda v: contains(b.rewritten, v))) AS leaks, list_concat(coalesce(b.held, []), CASE WHEN c.value IS NULL THEN [] ELSE [c.value] END) AS held
         FROM texts t LEFT JOIN built b USING (doc_id) LEFT JOIN carried c USING (doc_id))
{result}"""


_OUT = "stop IS NULL AND leaks = 0"


def _policies_sql() -> str:
    reason = ("CASE WHEN stop IS NOT NULL THEN 'policy: tool * may not get ' || stop || ' (PERSONAL_INFO)' "
              "WHEN leaks > 0 THEN 'leak check: ' || leaks || ' value(s) left in the rewritten text' END")
    return _chain_sql(f"SELECT doc_id, CASE WHEN {_OUT} THEN rewritten END AS sanitized, NOT ({_OUT}) AS blocked, {reason} AS block_reason, "
                      "CAST(n AS BIGINT) AS n_entities, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(leaks AS BIGINT) AS leaks FROM done")


def _restore_sql() -> str:
    return _chain_sql(f"SELECT doc_id, CASE WHEN {_OUT} THEN restored END AS restored, CAST(CASE WHEN {_OUT} AND text IS NOT NULL THEN n_restored ELSE 0 END AS BIGINT) AS restored_count FROM done")


_ACTION = "CASE WHEN stop IS NOT NULL THEN 'BLOCKED_POLICY_VIOLATION' WHEN leaks > 0 THEN 'BLOCKED_LEAKAGE_DETECTED' ELSE 'SANITIZED_AND_FORWARDED' END"


def _audit_sql() -> str:
    error = "CASE WHEN stop IS NOT NULL THEN 'FirewallBlockedError' WHEN leaks > 0 THEN 'PIILeakageDetectedError' END"
    return _chain_sql(
        f"SELECT doc_id, '*' AS tool_name, {_ACTION} AS action, CAST(CASE WHEN {_OUT} THEN n ELSE 0 END AS BIGINT) AS total_entities_secured, NOT ({_OUT}) AS blocked, "
        f"{_OUT} AS verification_passed, {error} AS error_type, coalesce(CASE WHEN {_OUT} THEN sha256(rewritten) END, '') AS sanitized_payload_sha256 FROM done")


def _audit_totals_sql() -> str:
    return _chain_sql(f"SELECT {_ACTION} AS action, count(*) AS events, CAST(sum(CASE WHEN {_OUT} THEN n ELSE 0 END) AS BIGINT) AS entities_secured FROM done GROUP BY 1")


def _verify_sql() -> str:
    sent = f"CASE WHEN NOT ({_OUT}) THEN '' WHEN doc_id % 4 = 0 THEN rewritten || ' ' || substr(text, 1, CAST(length(text) // 2 AS INT)) ELSE rewritten END"
    count = f"CASE WHEN {_OUT} THEN len(list_filter(list_distinct(held), lambda v: contains(sent, v))) ELSE 0 END"
    return _chain_sql(f", sends AS (SELECT *, {sent} AS sent FROM done) SELECT doc_id, CAST({count} AS BIGINT) AS leak_count, {count} = 0 AS verification_passed FROM sends")


def _backend_sql() -> str:
    """P1 in SQL: the ordered decision, with the backend's rules, categories and allowlists as tables of values."""
    rows = lambda pairs: "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + ")"
    rules = rows({normalize_type(k): normalize_action(v) for k, v in X.DEFAULT_RULES.items()}.items())  # the last spelling holds
    allowed = rows((c, t) for c, ts in X.DEFAULT_ALLOWLISTS.items() for t in ts)
    strict = ", ".join(f"'{t}'" for t in X.STRICT_TYPES)
    return f"""
WITH e AS (SELECT {DESTINATION} AS tool, kind FROM ({_entities_sql(CORPUS_SQL)}) x),
c AS (SELECT e.tool, e.kind, coalesce(k.category, '{X.PERSONAL_INFO}') AS category, r.action AS rule,
             EXISTS (SELECT 1 FROM {allowed} a(category, tool) WHERE a.category = k.category AND a.tool IN (e.tool, '*')) AS allowed
      FROM e LEFT JOIN {rows(TYPE_CATEGORY.items())} k(kind, category) ON k.kind = e.kind LEFT JOIN {rules} r(kind, action) ON r.kind = e.kind),
d AS (SELECT tool, kind, category, CASE
        WHEN category = '{X.CREDENTIAL}' AND NOT allowed AND (kind IN ({strict}) OR (tool <> '*' AND rule IS NULL)) THEN '{BLOCK}'
        WHEN category = '{X.BUSINESS_CONFIDENTIAL}' AND NOT allowed THEN '{BLOCK}' ELSE coalesce(rule, 'TOKENIZE') END AS action FROM c)
SELECT tool, kind AS pii_type, category, action, count(*) AS n FROM d GROUP BY ALL"""


def _fields_sql() -> str:
    return f"""SELECT doc_id, token AS t, value AS by_path, 'x ' || token AS beside_it, value AS in_list, value AS deeper, value AS below, token AS not_named,
       CAST(4 AS BIGINT) AS restored_count FROM ({_tokens_sql()}) v"""


def _fail_closed_sql() -> str:
    bad = "coalesce(length(text) > 0 AND length(text) % 7 = 0, false)"
    why = f"CASE WHEN {bad} THEN CASE WHEN strict THEN 'inspection failed: LookupError' ELSE 'LookupError: length ' || length(text) END END"
    return f"""SELECT doc_id, strict, {bad} AS blocked, CASE WHEN {bad} THEN 'BLOCKED_INTERNAL_ERROR' ELSE 'SANITIZED_AND_FORWARDED' END AS action,
       CASE WHEN {bad} THEN 'LookupError' END AS error_type, {why} AS block_reason, {bad} OR text IS NULL AS nothing_sent
FROM documents, (VALUES (true), (false)) s(strict)"""


def _wire_sql() -> str:
    return f"""SELECT d.doc_id FROM documents d WHERE d.doc_id % 3 = 0
  AND EXISTS (SELECT 1 FROM (SELECT DISTINCT value FROM ({_email_sql("documents")}) e) v WHERE contains(d.text, v.value))"""


def _rules_sql() -> str:
    """The built-in rules and the customers' ones, newest first, names and actions brought to their standard forms by a table."""
    names = {w: normalize_type(w) for w in ("mobile", " Phone", "EMAIL", "ssn", "My_Type", "IP_ADDRESS")}
    acts = {w: normalize_action(w) for w in ("mask it", "Redacted", "BLOCK", "allow", " pass", "what", "tokenise")}
    case = lambda expr, table: f"CASE {expr} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"
    built = ", ".join(f"('*', '{normalize_type(k)}', '{normalize_action(a)}', -1, {i})" for i, (k, a) in enumerate(X.DEFAULT_RULES.items()))
    return f"""
WITH r(tool, type_name, action, version, item) AS (
  VALUES {built} UNION ALL
  SELECT {RULE_TOOL}, {case(RULE_TYPE, names)}, {case(RULE_ACTION, acts)}, c_custkey % 3, c_custkey FROM customer)
SELECT tool, type_name, action FROM r QUALIFY row_number() OVER (PARTITION BY tool, type_name ORDER BY version DESC, item DESC) = 1"""


def _leaves_sql() -> str:
    tool = "CASE WHEN turn % 3 = 0 THEN 'send_email' WHEN turn % 3 = 1 THEN 'search_web' ELSE 'internal_kms' END"
    return f"""
SELECT request_id, t.fullkey AS path, regexp_extract(t.fullkey, '\\.([^.\\[]+)(\\[[0-9]+\\])*$', 1) AS field, t.atom->>'$' AS text FROM (
  SELECT concat(conv_id, ':', turn) AS request_id,
         json_object('tool', {tool}, 'arguments',
                     json_object('message', text, 'role', role, 'turn', turn, 'tags', json_array(role, 'x'))) AS j
  FROM conversations) c, json_tree(c.j) t
WHERE t.type = 'VARCHAR'
"""


def _custom_sql(src: str) -> str:
    sp = O.spans_sql(src, "doc_id", "text", CUSTOM_DL)
    return _sel(sp, "NOT ends_with(value, '0') AND contains(lower(txt), 'license')")


def _protect_sql() -> str:
    """Every planted text stands in two leaves, so each of its addresses counts twice."""
    found = (f"SELECT doc_id FROM ({_email_sql(O.PLANTED)}) e UNION ALL SELECT doc_id FROM ({_ip_sql(O.PLANTED)}) i")
    return f"""
SELECT p.doc_id, false AS blocked, CAST(2 * count(f.doc_id) AS BIGINT) AS total_detected, CAST(2 * count(f.doc_id) AS BIGINT) AS restored_count,
       true AS round_trip_ok, 'x' AS untouched
FROM {O.PLANTED} p LEFT JOIN ({found}) f ON f.doc_id = p.doc_id GROUP BY p.doc_id"""


def _route_sql() -> str:
    has = lambda words: " OR ".join(f"contains(l, '{w}')" for w in words)
    tool = " ".join(f"WHEN {has(ws)} THEN '{t}'" for t, ws in X.PROMPT_ROUTES)
    when = " ".join(f"WHEN {has(ws)} THEN '{v}'" for ws, v in X.PROMPT_SCHEDULES)
    after = "trim(ltrim(trim(substr(t, instr(l, 'subject') + 7)), ':'))"
    return f"""
SELECT id, CASE {tool} ELSE '{X.PROMPT_DEFAULT_TOOL}' END AS tool,
       CASE WHEN contains(l, 'subject') AND {after} <> '' THEN {after} ELSE '{X.PROMPT_DEFAULT_SUBJECT}' END AS subject,
       CASE {when} ELSE '{X.PROMPT_DEFAULT_SCHEDULE}' END AS schedule
FROM (SELECT id, trim(text) AS t, lower(trim(text)) AS l
      FROM (SELECT concat(conv_id, ':', turn) AS id, text FROM conversations
            UNION ALL SELECT CAST(doc_id AS VARCHAR), text || ' Subject: to do Tomorrow' FROM {O.PLANTED} p) a) b"""


def _planted_sql(template: int, value: str, where: str = "true") -> str:
    """What the planted rows of a template were built to hold, from the builder and not from a pattern."""
    return f"""SELECT -doc_id - 1 AS doc_id, CAST(instr(text, {value}) - 1 AS BIGINT) AS start,
       CAST(instr(text, {value}) - 1 + length({value}) AS BIGINT) AS "end", {value} AS value
FROM {O.PLANTED} p WHERE template = {template} AND {where}"""


def _cvv_sql() -> str:
    """The code of a planted card, and the groups of its number, which are words of three or four digits near the cue too."""
    words = [("instr(text, 'with cvv ') + 9", "substr(text, instr(text, 'with cvv ') + 9, 3)")]
    words += [(f"instr(text, 'card ') + {5 + 5 * i}", f"split_part(substr(text, instr(text, 'card ') + {5 + 5 * i}), ' ', 1)") for i in range(4)]
    return " UNION ALL ".join(
        f"SELECT -doc_id - 1 AS doc_id, CAST({at} - 1 AS BIGINT) AS start, CAST({at} - 1 + length({value}) AS BIGINT) AS \"end\", {value} AS value "
        f"FROM {O.PLANTED} p WHERE template = 2" for at, value in words)


def _tokens_sql() -> str:
    salt = "unhex(substr(sha256(encode('correctness run' || chr(0) || doc_id)), 1, 32))"
    h = f"substr(sha256({salt} || encode('EMAIL:' || value)), 1, 8)"
    return f"""SELECT DISTINCT doc_id, value, '{X.TOKEN_PREFIX}EMAIL_' || {h} || '{X.TOKEN_SUFFIX}' AS token
FROM ({_email_sql("documents")}) e"""


def _restore_clients_sql() -> str:
    return f"""
WITH v AS (SELECT t.*, {CLIENT_OF} AS client FROM ({_tokens_sql()}) t),
f AS (SELECT doc_id, min(token) AS t, arg_min(value, token) AS v, any_value(client) AS client, {CALLER_OF} AS caller FROM v GROUP BY doc_id),
g AS (SELECT *, coalesce(client IS NULL OR lower(client) = lower(caller), false) AS ok FROM f)
SELECT doc_id, CAST(1 AS BIGINT) AS n, CASE WHEN ok THEN 'x ' || v || ' y ' || v ELSE 'x ' || t || ' y ' || t END AS restored,
       CAST(CASE WHEN ok THEN 2 ELSE 0 END AS BIGINT) AS restored_count FROM g
UNION ALL
SELECT g.doc_id, 2, coalesce(o.t, 'none') || ' w ' || CASE WHEN g.ok THEN g.v ELSE g.t END, CASE WHEN g.ok THEN 1 ELSE 0 END
FROM g LEFT JOIN f o ON o.doc_id = g.doc_id - 1
UNION ALL
SELECT -doc_id - 1, 3, t, 0 FROM g"""


def _leaks_sql() -> str:
    return f"""SELECT d.doc_id, count(DISTINCT t.value) FILTER (d.doc_id % 3 = 0) AS leak_count,
       count(DISTINCT t.value) FILTER (d.doc_id % 3 = 0) = 0 AS verification_passed
FROM documents d LEFT JOIN ({_tokens_sql()}) t ON t.doc_id = d.doc_id GROUP BY d.doc_id"""


def oracle_sql() -> dict[str, str]:
    src = CORPUS_SQL
    sql = training_data.oracle_sql() if training_data is not None else {}
    if corpus_pipeline is not None and corpus_pipeline.ORACLE_SQL:
        sql = sql | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return sql | {
        "e01_counts_by_type": _flagship_sql(),
        "c01_email": _email_sql(src),
        "c03_phone": _phone_sql(src),
        "c04_ssn": _ssn_sql(src),
        "c05_card": _card_sql(src),
        "c06_ipv4": _ip_sql(src),
        "c07_api_key": _api_sql(src),
        "c08_pan": _pan_sql(src),
        "c09_aadhaar": _aadhaar_sql(src),
        "c12_password": _password_sql(src),
        "c18_medical": _simple_ctx_sql(X.MEDICAL_PATTERN)(src),
        "c19_salary": _simple_ctx_sql(X.SALARY_PATTERN)(src),
        "c20_dob": _simple_ctx_sql(X.DOB_PATTERN)(src),
        "c23_passport": _simple_ctx_sql(X.PASSPORT_PATTERN)(src),
        "c24_ssn_context": _ssn_ctx_sql(src),
        "c27_relationships": _rel_sql(),
        "p07_mask": _mask_sql(),
        "p12_sanitize": _sanitize_sql(),
        "c10_intent": _intent_sql(src),
        "c11_pin": f"{_pin_sql(src)} UNION ALL SELECT doc_id, start, \"end\", value FROM ({_intent_sql(src)}) i WHERE pii_type = 'PIN'",
        "d08_restore": _restore_sql(),
        "g01_audit": _audit_sql(),
        "d07_verify": _verify_sql(),
        "b01_leaves": _leaves_sql(),
        "c28_custom_regex": _custom_sql(src),
        "c14_otp": _planted_sql(3, "substr(text, instr(text, 'OTP is ') + 7, 6)"),
        "c15_system_prompt": _planted_sql(6, "'system prompt'"),
        "c16_source_code": _planted_sql(6, "'import os'"),
        "c17_db_marker": _planted_sql(6, "'employee database'"),
        "c21_licence": _planted_sql(8, "substr(text, instr(text, 'DL-'))"),
        "c22_person_name": _planted_sql(0, "split_part(split_part(text, 'profile for ', 2), ',', 1)"),
        "c25_aadhaar_context": (
            _planted_sql(4, "substr(text, 16, 14)") + " UNION ALL " + _planted_sql(4, "substr(text, instr(text, 'backup ') + 7, 12)")),
        "c26_pan_context": _planted_sql(4, "substr(text, instr(text, 'PAN ') + 4, 10)", "substr(text, instr(text, 'PAN ') + 7, 1) <> 'X'"),
        "e10_detection_report": (
            f"SELECT doc_id, 'EMAIL' AS pii_type, 'PERSONAL_INFO' AS category, value, min(start) AS first_start, count(*) AS places "
            f"FROM ({_email_sql(src)}) e GROUP BY doc_id, value"),
        "e08_active_vaults": f"SELECT count(DISTINCT doc_id) AS active_vaults FROM ({_tokens_sql()}) t",
        "i13_check_column": (
            f"SELECT count(*) FILTER (n IS NOT NULL AND {O.luhn_sql('n')}) AS valid, count(*) FILTER (n IS NOT NULL AND NOT {O.luhn_sql('n')}) AS invalid, "
            f"count(*) FILTER (n IS NULL) AS nulls, round(avg(CASE WHEN n IS NOT NULL THEN CAST({O.luhn_sql('n')} AS DOUBLE) END), 6) AS valid_share "
            f"FROM (SELECT CASE WHEN c_custkey % 7 <> 0 THEN {NUMBERS} END AS n FROM customer) c"),
        "d14_protect": _protect_sql(),
        "a06_route_prompt": _route_sql(),
        "p04_tokens": _tokens_sql(),
        "d11_restore_clients": _restore_clients_sql(),
        "d07_leaks": _leaks_sql(),
        "p01_backend_policy": _backend_sql(),
        "p12_policies": _policies_sql(),
        "e05_audit_totals": _audit_totals_sql(),
        "d09_fields": _fields_sql(),
        "p11_fail_closed": _fail_closed_sql(),
        "d12_audit_wire": _wire_sql(),
        "p03_rules": _rules_sql(),
        "c13_cvv": _cvv_sql(),
    }
