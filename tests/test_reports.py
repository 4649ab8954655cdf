"""Sinks, reports and batch control."""

import json

import pytest
from pyspark.sql import functions as F

from veilspark.operators import reports as R
from veilspark.operators.detect import detect, pattern_only
from veilspark.operators.restore import audit_events, restore_text
from veilspark.plans.requests import protect
from veilspark.plans.sanitize import Firewall
from veilspark.sources import tables as S

ROWS = [("r1", "mail a@b.com and a@b.com", 0), ("r2", "from 10.0.0.1", 1), ("r3", "my ATM PIN is 4821", 2), ("r4", None, 3)]


@pytest.fixture(scope="module")
def done(spark):
    fw = Firewall("k", use_nfkc=True, scan_base64=False)
    return fw.sanitize(spark.createDataFrame(ROWS, "request_id string, text string, idx int"), "text", "request_id").cache()


def test_written_tables_restore(spark, done, tmp_path):
    vault, out = str(tmp_path / "vault"), str(tmp_path / "out")
    S.write_vault(Firewall.vault_rows(done, "request_id"), vault, out)
    S.write_sanitized(done, out)
    S.write_audit(audit_events(done, "request_id"), str(tmp_path / "audit"))
    with pytest.raises(ValueError):
        S.write_vault(Firewall.vault_rows(done, "request_id"), out + "/vault", out)
    good = spark.read.parquet(out + "/good")
    back = restore_text(good, S.read_vault(spark, vault, "2000-01-01"), text_col="sanitized").collect()
    assert {r["request_id"]: r["restored"] for r in back if r["restored"]} == {"r1": ROWS[0][1], "r2": ROWS[1][1]}
    assert S.read_vault(spark, vault, "2999-01-01").count() == 0
    assert [r["request_id"] for r in spark.read.parquet(out + "/blocked").collect()] == ["r3"]
    assert S.read_audit(spark, str(tmp_path / "audit")).filter("blocked").count() == 1


def test_batch_control(done):
    status = R.batch_status(done)
    assert {(r["request_id"], r["error_type"]) for r in R.batch_errors(status).collect()} == {("r3", "FirewallBlockedError")}
    assert R.stop_on_error(status.filter("success")).count() == 3
    with pytest.raises(Exception, match="FirewallBlockedError"):
        R.stop_on_error(status).collect()
    assert [r["idx"] for r in R.restore_order(R.slice_results(done, 1, 3)).collect()] == [1, 2]
    assert tuple(R.reliability_stats(done).first()) == (75.0, 0.0)
    assert R.active_vaults(Firewall.vault_rows(done, "request_id")).first()[0] == 2


def test_report_and_checks(spark):
    rows = spark.createDataFrame([(1, "a@b.com x c@d.com y a@b.com")], "id int, text string")
    ents = detect(rows, "text", ["id"], pattern_only(["EMAIL"]))
    got = {(r["value"], r["category"], r["first_start"], r["places"]) for r in R.detection_report(R.exposed_only(ents), ["id"]).collect()}
    assert got == {("a@b.com", "PERSONAL_INFO", 0, 2), ("c@d.com", "PERSONAL_INFO", 10, 1)}
    values = spark.createDataFrame([("4111111111111111",), ("4111111111111112",), (None,)], "v string")
    assert tuple(R.check_column(values, "v", "luhn").first()) == (1, 1, 1, 0.5)
    ssn = spark.createDataFrame([("123-45-6789",), ("000-45-6789",), ("x",), (None,)], "v string")
    assert tuple(R.check_column(ssn, "v", "ssn").first())[:3] == (1, 2, 1)
    ips = spark.createDataFrame([("1.2.3.4",), ("256.1.1.1",)], "v string")
    assert tuple(R.check_column(ips, "v", "ip").first())[:3] == (1, 1, 0)


def test_payload_columns(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "{a: yes, b: no}"), (3, "{{{"), (4, '{"payload": {"x": "y"}, "tool": "t"}')], "id int, text string")
    good, bad = R.parse_requests(df, "text")
    assert {r["id"] for r in good.collect()} == {1, 2, 4} and {r["id"] for r in bad.collect()} == {3}
    inner = good.filter("id = 4").select(R.payload_text(R.api_payload(F.col("payload"))).alias("p"), R.payload_hash(F.col("payload")).alias("h")).first()
    assert json.loads(inner["p"]) == {"x": "y"} and len(inner["h"]) == 64
    assert spark.range(1).select(R.round_ms(F.lit(1.23456)).alias("x")).first()["x"] == 1.235


def test_protect_envelope(spark):
    rows = [("r1", {"tool": "crm", "to": "a@b.com"}), ("r2", {"tool": "crm", "x": "my ATM PIN is 4821"})]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows], "request_id string, j string").select("request_id", F.parse_json("j").alias("payload"))
    out = {r["request_id"]: r for r in protect(Firewall("k", scan_base64=False), df, lambda sent: sent.withColumnRenamed("sent", "response")).collect()}
    assert "a@b.com" not in out["r1"]["sent"] and json.loads(out["r1"]["restored"]) == rows[0][1] and out["r1"]["restored_count"] == 1
    assert out["r2"]["blocked"] and out["r2"]["sent"] is None and out["r2"]["raw_response"] is None


def test_prompts_and_totals(spark):
    from veilspark.operators.restore import absent_share, restored_totals, vault_stats
    from veilspark.operators.routing import route_prompt

    texts = ["please charge my card tomorrow", " subject : : Hello there ", '{"tool": "crm", "x": 1}', "{broken}", None, "deploy at 3 PM", "Email the PIN"]
    got = [(r["tool"], r["subject"], r["schedule"]) for r in route_prompt(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text").orderBy("i").collect()]
    none, now = "Leave Notification", "Immediate"
    assert got == [("stripe_payment", none, "Tomorrow"), ("send_email", ": Hello there", now), ("crm", none, now), ("send_email", none, now),
                   ("send_email", none, now), ("cloud_deploy", none, "3:00 PM"), ("send_email", none, now)]
    done = spark.createDataFrame([("a", 2), ("a", 1), (None, 4)], "request_id string, restored_count long")
    assert {tuple(r) for r in restored_totals(done).collect()} == {("a", False, 3), (None, False, 4), (None, True, 7)}
    vault = spark.createDataFrame([("a", "t1", "v1"), ("a", "t2", "v2"), ("a", "t1", "v1")], "request_id string, token string, value string")
    assert tuple(vault_stats(vault).first()) == ("a", 2, 2, ["v1", "v2"])
    sent = spark.createDataFrame([("a", "has v1"), ("b", None)], "request_id string, sanitized string")
    assert absent_share(sent, vault.dropDuplicates(), "request_id").first()[0] == 0.5
