"""Faults that were found in the library, each with a case that shows it."""

from pyspark.sql import functions as F

from veilspark.operators.custom import function_detector, locate_annotations, regex_detector
from veilspark.operators.detect import DetectorSet, detect, detect_kind, pattern_only, prefilter
from veilspark.operators.policy import Policy, ToolRule, decide_actions_df, decide_actions_joined
from veilspark.operators.restore import audit_wire, batch_summary, latency_stats, purge_vault, restore_batch, restore_text, verify_no_leak
from veilspark.plans.sanitize import Firewall
from veilspark.streaming.jobs import restore_stream, run_sanitize_stream


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


def test_digit_spaced_phone_numbers(spark):
    rows = texts(spark, "9 8 7 6 5 4 3 2 1 0", "98 76 54 32 10", "9876543210", "12 34", None)
    assert sorted(r["id"] for r in detect_kind(rows, "text", ["id"], "PHONE").collect()) == [0, 1, 2]
    assert sorted(r["id"] for r in prefilter(rows, "text", ["PHONE"]).collect()) == [0, 1, 2]


def test_many_custom_detectors_of_one_type(spark):
    words = [c * 3 for c in "ABCDEFGHIJ"]
    rows = texts(spark, " ".join(words))
    for w in words:
        found = detect(rows, "text", ["id"], DetectorSet([regex_detector("THING", w)])).collect()
        assert [r["value"] for r in found] == [w]


def test_python_validator_and_broken_items(spark):
    rows = texts(spark, "ID-10 ID-11 word")
    det = regex_detector("THING", r"ID-\d+", python_validator=lambda v: v[-1] != "0")
    assert [r["value"] for r in detect(rows, "text", ["id"], DetectorSet([det])).collect()] == ["ID-11"]
    odd = function_detector("THING", lambda t: [{"start": "x"}, ("a", "b"), 5, None, {"start": 0, "end": 5}, "word", (6,)])
    assert sorted(r["value"] for r in detect(rows, "text", ["id"], DetectorSet([odd])).collect()) == ["ID-10", "word"]


def test_annotations_in_other_case(spark):
    rows = texts(spark, "Foo Bar and foo bar and FOO BAR", "foo bar then Foo Bar then foo bar")
    notes = spark.createDataFrame([(0, "Foo Bar", "PERSON_NAME", 0.9, "why"), (1, "Foo Bar", "PERSON_NAME", None, None)],
                                  "id int, value string, type string, confidence double, context string")
    got = sorted((r["id"], r["start"], r["value"], r["category"], r["evidence"]) for r in locate_annotations(rows, notes, "id").collect())
    assert [g[:3] for g in got] == [(0, 0, "Foo Bar"), (0, 12, "foo bar"), (0, 24, "FOO BAR"), (1, 13, "Foo Bar"), (1, 26, "foo bar")]
    assert got[0][3:] == ("PERSONAL_INFO", "why")


def vault(spark):
    return spark.createDataFrame(
        [("r1", "EMAIL", "a@b.com", "⟦EMAIL_0000000a⟧", None), ("r1", "EMAIL", "a@b.com", "⟦EMAIL_0000000a⟧", None), ("r1", "PHONE", "555", "⟦PHONE_0000000b⟧", None),
         ("r2", "EMAIL", "c@d.com", "⟦EMAIL_0000000c⟧", "Acme")], "request_id string, pii_type string, value string, token string, client_id string")


RESPONSES = [
    ("r1", "x ⟦EMAIL_0000000a⟧ y", None, "x a@b.com y", 1), ("r1", "z ⟦PHONE_0000000b⟧ w ⟦EMAIL_0000000a⟧⟦EMAIL_0000000a⟧", "any", "z 555 w a@b.coma@b.com", 3),
    ("r1", "⟦EMAIL_0000000c⟧", None, "⟦EMAIL_0000000c⟧", 0), ("r2", "⟦EMAIL_0000000c⟧!", "ACME", "c@d.com!", 1), ("r2", "⟦EMAIL_0000000c⟧!", "other", "⟦EMAIL_0000000c⟧!", 0),
    ("r2", "⟦EMAIL_0000000c⟧!", None, "⟦EMAIL_0000000c⟧!", 0), ("r3", "⟦EMAIL_0000000c⟧ plain", "ACME", "⟦EMAIL_0000000c⟧ plain", 0), ("r1", None, None, None, 0)]


def test_several_responses_of_a_request(spark):
    rows = spark.createDataFrame(RESPONSES, "request_id string, response string, caller string, want string, n long")
    for r in restore_text(rows, vault(spark), client_col="caller").collect():
        assert (r["restored"], r["restored_count"]) == (r["want"], r["n"])
    restored, left = restore_batch(rows.filter("request_id = 'r1'"), vault(spark), client_col="caller")
    assert restored.count() == 4 and {r["request_id"] for r in left.collect()} == {"r2"}
    assert purge_vault(left, rows).count() == 0


def test_leaks_are_found_per_row(spark):
    sent = spark.createDataFrame([("r1", "x a@b.com 555"), ("r1", "clean"), ("r9", "a@b.com")], "request_id string, sanitized string")
    got = sorted((r["request_id"], r["leak_count"], tuple(r["leak_value_lengths"]), r["verification_passed"]) for r in verify_no_leak(sent, vault(spark)).collect())
    assert got == [("r1", 0, (), True), ("r1", 2, (3, 7), False), ("r9", 0, (), True)]


def test_secrets_on_the_wire(spark):
    sent = spark.createDataFrame([(1, "the secret number is here"), (2, "the secret numbe"), (3, "ab"), (4, None), (5, "")], "id int, payload string")
    secrets = spark.createDataFrame([("secret number",), ("b",), ("",), (None,)], "secret string")
    assert sorted(r["id"] for r in audit_wire(sent, secrets).collect()) == [1, 2, 3]
    assert audit_wire(sent, secrets.filter("secret = 'secret number'")).count() == 1
    assert audit_wire(sent, secrets.limit(0)).count() == 0


def test_policy_tables_agree_with_the_compiled_policy(spark):
    policy = Policy(default_action="MASK").set_rule("EMAIL", "mask", "crm").set_rule("phone_number", "redact")
    policy.add_rule(ToolRule("mailer", actions={"EMAIL": "PASS", "API_KEY": "token"}, blocked={"SSN"}, whitelisted_fields={"to"}, credential_exceptions={"PIN"}))
    rules = spark.createDataFrame([(t, k, a) for t, r in policy.rules.items() for k, a in r.actions.items()], "tool string, type_name string, action string")
    tools = spark.createDataFrame([(r.tool, sorted(r.blocked), sorted(r.whitelisted_fields), sorted(r.credential_exceptions)) for r in policy.rules.values()],
                                  "tool string, blocked array<string>, whitelisted_fields array<string>, credential_exceptions array<string>")
    allow = spark.createDataFrame([(c, d) for c, ds in policy.allowlists.items() for d in ds], "category string, destination string")
    kinds = ["EMAIL", "PHONE", "SSN", "PIN", "API_KEY", "CONFIDENTIAL_SOURCE_CODE", "MADE_UP"]
    rows = [(t, k, f, None) for t in ("*", "crm", "mailer", "other", "vault_service", "internal_git_repo") for k in kinds for f in (None, "to")]
    ents = spark.createDataFrame(rows, "tool string, pii_type string, field string, category string")
    key = lambda df: sorted((r["tool"], r["pii_type"], str(r["field"]), r["category"], r["action"]) for r in df.collect())
    assert key(decide_actions_joined(ents, "tool", rules, tools, allow, "field", "MASK")) == key(decide_actions_df(ents, "tool", policy, "field"))


def test_summaries(spark):
    san = spark.createDataFrame([(True, 2), (False, 3), (False, 0)], "blocked boolean, total_detected long")
    res = spark.createDataFrame([(4,), (1,)], "restored_count long")
    assert tuple(batch_summary(san, res).first()) == (3, 2, 1, 5, 5)
    assert tuple(batch_summary(san).first()) == (3, 2, 1, 5)
    row = latency_stats(spark.range(1, 101).selectExpr("cast(id as double) as ms"), "ms").first()
    assert (row["min"], row["max"], row["mean"], row["median"], row["p95"]) == (1, 100, 50.5, 50, 95)


def test_streams_equal_batches(spark, tmp_path):
    rows = [("r1", "mail a@b.com"), ("r2", "from 10.0.0.1"), ("r3", "nothing")]
    src, fw = str(tmp_path / "in"), Firewall("k", detectors=pattern_only(["EMAIL", "IP_ADDRESS"]))
    table = spark.createDataFrame(rows, "request_id string, text string")
    table.write.parquet(src)
    stream = spark.readStream.schema(table.schema).parquet(src)
    run_sanitize_stream(fw, stream, "text", "request_id", str(tmp_path / "out"), str(tmp_path / "vault"), str(tmp_path / "c1")).awaitTermination()
    got = sorted((r["request_id"], r["sanitized"]) for r in spark.read.parquet(str(tmp_path / "out/sanitized")).collect())
    assert got == sorted((r["request_id"], r["sanitized"]) for r in fw.sanitize(table, "text", "request_id").collect())
    held = spark.read.parquet(str(tmp_path / "vault")).drop("batch_id")
    answers = str(tmp_path / "answers")
    spark.createDataFrame(got + [("r9", "x")], "request_id string, response string").write.parquet(answers)
    incoming = spark.readStream.schema("request_id string, response string").parquet(answers)
    query = restore_stream(incoming, held).writeStream.format("parquet").option("path", str(tmp_path / "back")).option("checkpointLocation", str(tmp_path / "c2"))
    query.trigger(availableNow=True).start().awaitTermination()
    back = sorted((r["request_id"], r["restored"]) for r in spark.read.parquet(str(tmp_path / "back")).collect())
    assert back == rows + [("r9", "x")]


def test_live_vaults_in_stream_state(spark, tmp_path):
    from veilspark.streaming.jobs import audit_stream, use_rocksdb, vault_state

    use_rocksdb(spark)
    schema = "request_id string, kind string, seq long, text string, vault map<string,string>"
    token = "⟦EMAIL_0000000a⟧"
    batches = [
        [("a", "request", 1, None, {token: "a@b.com"}), ("b", "request", 1, None, {token: "c@d.com"}), ("b", "response", 2, f"hi {token}", None)],
        [("a", "response", 2, f"x {token} ⟦EMAIL_0000000b⟧", None), ("a", "response", 3, f"again {token}", None), ("z", "response", 1, token, None), ("z", "response", 2, None, None)],
    ]
    src = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        query = vault_state(spark.readStream.schema(schema).json(src)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        # a query with timeouts always has another batch to look for them, so it is run for one batch at a time
        run = query.option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        assert run.awaitTermination(60)
    got = sorted((r["request_id"], r["seq"], r["restored"], r["restored_count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 2, "x a@b.com ⟦EMAIL_0000000b⟧", 1), ("a", 3, f"again {token}", 0), ("b", 2, "hi c@d.com", 1), ("z", 1, token, 0), ("z", 2, None, 0)]

    events = str(tmp_path / "audit")
    spark.sql("select timestamp'2026-01-01 00:00:10' ts, 'A' action, 2L total_entities_secured union all select timestamp'2026-01-01 00:00:50', 'A', 3L "
              "union all select timestamp'2026-01-01 01:00:00', 'B', 1L").write.parquet(events)
    stream = spark.readStream.schema("ts timestamp, action string, total_entities_secured long").parquet(events)
    audit_stream(stream).writeStream.format("memory").queryName("audit_counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["action"], r["events"], r["entities_secured"]) for r in spark.table("audit_counts").collect()) == [("A", 2, 5), ("B", 1, 1)]
