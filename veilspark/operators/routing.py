"""Free prompts become tool calls by ordered keyword rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed as X


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _first_rule(lower: Column, rules: list[tuple[list[str], str]], default: str) -> Column:
    """The value of the first rule one of whose words occurs."""
    out = F.lit(default)
    for words, value in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | lower.contains(w)
        out = F.when(hit, F.lit(value)).otherwise(out)
    return out


def route_prompt(df: DataFrame, text_col: str) -> DataFrame:
    """Adds tool, subject, schedule, message and, for a prompt that is itself a JSON object, ``payload``
    (VARIANT), whose own tool counts. Null prompts route like empty ones."""
    text = _strip(F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("message", text).withColumn("__l", F.lower("message"))
    given = F.when(F.col("message").startswith("{") & F.col("message").endswith("}"), F.try_parse_json("message"))
    df = df.withColumn("payload", given)
    lower = F.col("__l")
    after = F.expr("substring(message, instr(__l, 'subject') + 7)")
    subject = _strip(F.regexp_replace(_strip(after), "^:+", ""))
    subject = F.when(lower.contains("subject") & (subject != ""), subject).otherwise(F.lit(X.PROMPT_DEFAULT_SUBJECT))
    routed = _first_rule(lower, [(words, tool) for tool, words in X.PROMPT_ROUTES], X.PROMPT_DEFAULT_TOOL)
    return df.withColumns({
        "tool": F.coalesce(F.try_variant_get("payload", "$.tool", "string"), routed),
        "subject": subject,
        "schedule": _first_rule(lower, X.PROMPT_SCHEDULES, X.PROMPT_DEFAULT_SCHEDULE),
    }).drop("__l")
