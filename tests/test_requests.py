"""Whole requests: leaves, request-wide vault, base64 carriers, restore of fields, blocking."""

import base64
import json

from pyspark.sql import functions as F

from veilspark.operators.detect import default_detectors, pattern_only
from veilspark.operators.policy import Policy, ToolRule
from veilspark.plans.requests import UNREADABLE, restore_fields, sanitize_requests
from veilspark.plans.sanitize import Firewall
from veilspark.sources.requests import explode_leaves, read_requests

KINDS = ["EMAIL", "IP_ADDRESS"]


def requests(spark, payloads):
    rows = [(k, json.dumps(v) if not isinstance(v, str) else v) for k, v in payloads.items()]
    return spark.createDataFrame(rows, "request_id string, json string").select("request_id", F.parse_json("json").alias("payload"))


def nested(depth, leaf):
    value = leaf
    for i in range(depth):
        value = {"k": [value, 7, None, True]} if i % 2 else [{"deep": value}]
    return {"tool": "crm", "args": value}


PAYLOADS = {
    "r1": {"tool": "crm", "to": "a@x.com", "body": "write a@x.com from 10.0.0.1", "n": 3, "list": ["b@x.com", 1.5, None, {"to": "a@x.com"}]},
    "r2": nested(10, "deep c@x.com"),
    "r3": {"tool": "crm", "n": 1},
    "r4": {"tool": "crm", "a": "My ATM PIN is 4821", "b": "a@x.com"},
    "r5": "\"just d@x.com\"",
}


def test_leaves_at_any_depth(spark):
    leaves = explode_leaves(requests(spark, {"r": nested(60, "x"), "s": [1, "y", ["z"]]}), "request_id", "payload").collect()
    got = sorted((r["request_id"], r["field"], r["text"]) for r in leaves if r["text"] != "crm")
    assert [(k, t) for k, _, t in got] == [("r", "x"), ("s", "y"), ("s", "z")]
    assert {r["path"] for r in leaves if r["request_id"] == "s"} == {"$[1]", "$[2][0]"}


def test_request_round_trip(spark):
    fw = Firewall("k", detectors=default_detectors(), scan_base64=False, use_nfkc=False)
    out = sanitize_requests(fw, requests(spark, PAYLOADS)).cache()
    got = {r["request_id"]: r for r in out.collect()}
    assert set(got) == set(PAYLOADS)
    assert got["r4"]["blocked"] and got["r4"]["sanitized"] is None and "PIN" in got["r4"]["block_reason"]
    tokens = {v["value"]: v["token"] for v in got["r1"]["vault"]}
    assert set(tokens) == {"a@x.com", "b@x.com", "10.0.0.1"}
    sent = json.loads(got["r1"]["sanitized"])
    assert sent["to"] == tokens["a@x.com"] == sent["list"][3]["to"] and sent["n"] == 3 and sent["list"][1:3] == [1.5, None]
    assert sent["body"] == f"write {tokens['a@x.com']} from {tokens['10.0.0.1']}"
    assert got["r1"]["counts"]["EMAIL"] == 4 and got["r1"]["total_detected"] == 5 and got["r1"]["verification_passed"]
    assert json.loads(got["r3"]["sanitized"]) == PAYLOADS["r3"] and got["r3"]["vault"] == []

    vault = Firewall.vault_rows(out, "request_id")
    back = restore_fields(out.filter("not blocked").select("request_id", F.col("sanitized").alias("response")), vault)
    restored = {r["request_id"]: (json.loads(r["restored"]), r["restored_count"]) for r in back.collect()}
    assert restored["r1"] == (PAYLOADS["r1"], 5) and restored["r2"] == (PAYLOADS["r2"], 1) and restored["r5"] == ("just d@x.com", 1)

    some = restore_fields(out.filter("request_id = 'r1'").select("request_id", F.col("sanitized").alias("response")), vault, fields=["to"])
    value = json.loads(some.first()["restored"])
    assert value["to"] == "a@x.com" == value["list"][3]["to"] and value["body"] == sent["body"]


def test_unreadable_payload_is_blocked_and_the_job_goes_on(spark, monkeypatch):
    import veilspark.plans.requests as plan

    read = plan.walk_json
    monkeypatch.setattr(plan, "walk_json", lambda c: read(F.when(F.col("request_id") == "r5", F.lit("{")).otherwise(F.col(c))))
    got = {r["request_id"]: r for r in sanitize_requests(Firewall("k", detectors=pattern_only(KINDS), scan_base64=False), requests(spark, PAYLOADS)).collect()}
    assert got["r5"]["blocked"] and got["r5"]["action"] == UNREADABLE and got["r5"]["sanitized"] is None
    assert not got["r1"]["blocked"]


def test_forced_collisions_keep_values_apart(spark):
    text = " ".join(f"u{i}@x.com" for i in range(12))
    fw = Firewall("k", detectors=pattern_only(["EMAIL"]), scan_base64=False, hash_length=1)
    out = sanitize_requests(fw, requests(spark, {"r": {"a": text, "b": text[::1]}})).cache()
    row = out.first()
    assert len({v["token"] for v in row["vault"]}) == len({v["value"] for v in row["vault"]}) == 12
    back = restore_fields(out.select("request_id", F.col("sanitized").alias("response")), Firewall.vault_rows(out, "request_id")).first()
    assert json.loads(back["restored"]) == {"a": text, "b": text} and back["restored_count"] == 24


def b64(text, raw=False):
    return base64.b64encode(text if raw else text.encode()).decode()


def test_base64_carriers_are_scanned_one_by_one(spark):
    one, two, odd = b64("mail e@x.com please"), b64("from 10.1.2.3 and f@x.com"), b64("a@x.com\n;\nb@x.com and more")
    rows = [("1", f"see {one} and {two} and {one}"), ("2", odd), ("3", b64(b"\xff\xfe\xfd\xfc\xfb\xfa\xf9\xf8\xf7", True)), ("4", "plain e@x.com"), ("5", None),
            ("6", f"{b64('please send it to them')} {b64('my ATM PIN here, external assistant')}")]
    fw = Firewall("k", detectors=default_detectors(), use_nfkc=False)
    out = fw.sanitize(spark.createDataFrame(rows, "request_id string, text string"), "text", "request_id").cache()
    got = {r["request_id"]: r for r in out.collect()}
    tokens = {v["value"]: v["token"] for v in got["1"]["vault"]}
    assert set(tokens) == {"e@x.com", "10.1.2.3", "f@x.com"}
    first = tokens["e@x.com"]
    assert got["1"]["sanitized"].startswith(f"see {first} and ") and got["1"]["sanitized"].endswith(f" and {first}")
    assert one not in got["1"]["sanitized"] and two not in got["1"]["sanitized"]
    assert got["2"]["counts"] == {"EMAIL": 2} and got["3"]["sanitized"] == rows[2][1] and got["4"]["counts"] == {"EMAIL": 1}
    assert not got["6"]["blocked"]  # verb and phrase stand in different carriers


def test_blocked_type_in_a_carrier_and_whitelisted_field(spark):
    policy = Policy().add_rule(ToolRule("*", blocked={"EMAIL"}, whitelisted_fields={"note"}))
    fw = Firewall("k", policy=policy, detectors=pattern_only(["EMAIL"]), use_nfkc=False)
    rows = spark.createDataFrame([("1", "body", b64("mail e@x.com please")), ("2", "note", b64("mail e@x.com please"))], "request_id string, field string, text string")
    got = {r["request_id"]: r["blocked"] for r in fw.sanitize(rows, "text", "request_id", field_col="field").collect()}
    assert got == {"1": True, "2": False}


def test_request_ids(spark, tmp_path):
    rows = [("a", None, "b"), ("a", "b", None), ("a", "b", None), (None, None, None)]
    spark.createDataFrame(rows, "payload string, x string, y string").write.parquet(str(tmp_path / "p"))
    ids = [r["request_id"] for r in read_requests(spark, str(tmp_path / "p")).collect()]
    assert len(set(ids)) == 4 and all(ids)
    spark.createDataFrame([("p",), ("q",)], "payload string").write.parquet(str(tmp_path / "q"))
    assert len({r["request_id"] for r in read_requests(spark, str(tmp_path / "q")).collect()}) == 2
