from pyspark.sql import functions as F

from veilspark.operators.policy import BLOCK, MASK, PASS, REDACT, TOKENIZE, Policy, ToolRule


def decide(spark, policy, rows):
    df = spark.createDataFrame(rows, "tool string, pii_type string, field string")
    out = df.select(policy.action_col(F.col("tool"), F.col("pii_type"), F.col("field")).alias("a")).collect()
    return [r.a for r in out]


def test_default_policy(spark):
    p = Policy()
    got = decide(spark, p, [
        ("*", "EMAIL", None), ("*", "PIN", None), ("*", "API_KEY", None), ("send_email", "API_KEY", None),
        ("*", "CONFIDENTIAL_SOURCE_CODE", None), ("internal_git_repo", "CONFIDENTIAL_SOURCE_CODE", None),
        ("vault_service", "PIN", None),
    ])
    assert got == [TOKENIZE, BLOCK, TOKENIZE, BLOCK, BLOCK, TOKENIZE, TOKENIZE]


def test_tool_rules(spark):
    p = Policy()
    p.set_rule("EMAIL", "mask", "crm")
    p.set_rule("phone_number", "redact")  # alias -> PHONE on '*'
    p.add_rule(ToolRule("mailer", actions={"EMAIL": "PASS"}, blocked={"SSN"}, whitelisted_fields={"to"},
                        credential_exceptions={"API_KEY"}))
    got = decide(spark, p, [
        ("crm", "EMAIL", None), ("crm", "PHONE", None), ("other", "PHONE", None), ("mailer", "EMAIL", None),
        ("mailer", "SSN", None), ("mailer", "SSN", "to"), ("mailer", "API_KEY", None),
    ])
    # a tool rule replaces the '*' rule: crm has no PHONE action -> default
    assert got == [MASK, TOKENIZE, REDACT, PASS, BLOCK, PASS, REDACT]


def test_backend_rules(spark):
    p = Policy.default_backend()
    got = decide(spark, p, [("*", "SSN", None), ("*", "IP_ADDRESS", None), ("*", "EMAIL", None), ("*", "API_KEY", None)])
    assert got == [REDACT, MASK, TOKENIZE, BLOCK]
