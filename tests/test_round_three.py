"""Fields by path, errors by row, many overlaps, secrets on the wire, rule versions, purges, sketches, table functions, streams."""

import datetime as dt
import json
import os
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from veilspark.functions.rewrite import FEW_ENTITIES, kept_spans, with_resolved
from veilspark.operators import policy as P
from veilspark.operators.custom import detect_udtf, function_detector
from veilspark.operators.detect import DetectorSet, detect, pattern_only
from veilspark.operators.restore import (
    audit_events, audit_wire, latency_sketches, merged_latency, purge_vault_days, write_vault_days)
from veilspark.plans.requests import restore_fields, sanitize_requests
from veilspark.plans.sanitize import INTERNAL_ERROR, Firewall
from veilspark.sources.requests import _above, _walk


# --- D9 ---------------------------------------------------------------------------------------------
def walk_allowed(item, allowed, restore, key=None, parent=False, path=""):
    """What restoring allowed fields of a nested value means."""
    here = allowed is None or parent or (bool(key) and key in allowed) or (bool(path) and path in allowed)
    if isinstance(item, str):
        return restore(item) if here else item
    if isinstance(item, dict):
        return {k: walk_allowed(v, allowed, restore, k, here, f"{path}.{k}" if path else k) for k, v in item.items()}
    if isinstance(item, list):
        return [walk_allowed(v, allowed, restore, key, here, path) for v in item]
    return item


T1, T2 = "⟦EMAIL_0000000a⟧", "⟦EMAIL_0000000b⟧"
NESTED = {
    "user": {"email": T1, "name": f"x {T2}", "": T1},
    "list": [{"email": T2}, T1, [[{"deep": {"email": T1, "n": 1}}]]],
    "email": T1, "other": {"user": {"x": T2}, "list.email": T1}, "n": None, "": {"email": T2, "b": T1},
}


@pytest.mark.parametrize("fields", [None, [], ["user"], ["user.email"], ["list.email"], ["list"], ["email"], ["list.deep.email"], ["deep"],
                                    ["other.user"], ["user.x"], ["list[0].email"], ["nothing"], [""], ["user.email", "other.list.email"], ["b"]])
def test_fields_by_name_path_and_ancestor(spark, fields):
    values = {T1: "a@x.com", T2: "b@x.com"}
    vault = spark.createDataFrame([("r", t, v, None) for t, v in values.items()], "request_id string, token string, value string, client_id string")
    rows = spark.createDataFrame([("r", json.dumps(NESTED)), ("r", json.dumps(T1)), ("r", "no json " + T1), ("r", None)], "request_id string, response string")
    got = [r["restored"] for r in restore_fields(rows, vault, fields=fields).collect()]

    def restore(text):
        for t, v in values.items():
            text = text.replace(t, v)
        return text

    want = [walk_allowed(v, None if fields is None else set(fields), restore) for v in (NESTED, T1)]
    assert [json.loads(g) for g in got[:2]] == want and got[2:] == ["no json " + T1, None]


def test_names_come_in_the_order_of_the_leaves():
    assert len(_above(NESTED)) == len(_walk(NESTED)[0])
    last = {p: a for (p, _, _), a in zip(_walk(NESTED)[0], _above(NESTED))}
    assert last["$.list[2][0][0].deep.email"] == ["list", "deep", "list.deep", "email", "list.deep.email"]


# --- P11 --------------------------------------------------------------------------------------------
@pytest.fixture
def moody():
    def detector(text):
        if "boom" in text:
            raise RuntimeError("secret detail " + text)
        if "odd" in text:
            return [("x", None)]
        return [(text.index("code"), text.index("code") + 4)] if "code" in text else []

    return detector


ROWS = [("1", "the code here"), ("2", "boom now"), ("3", "odd one"), ("4", "a@x.com"), ("5", None), ("6", "")]


@pytest.mark.parametrize("strict", [True, False])
def test_a_failing_detector_blocks_its_row_alone(spark, moody, strict):
    fw = Firewall("k", detectors=pattern_only(["EMAIL"]).register(function_detector("PIN_CODE", moody, on_error="fail")), strict=strict, scan_base64=False)
    out = fw.sanitize(spark.createDataFrame(ROWS, "request_id string, text string"), "text", "request_id").cache()
    got = {r["request_id"]: r for r in out.collect()}
    for k, kind, text in (("2", "RuntimeError", "secret detail boom now"), ("3", "ValueError", "invalid literal")):
        r = got[k]
        assert r["blocked"] and r["sanitized"] is None and r["action"] == INTERNAL_ERROR and r["error_type"] == kind and not r["verification_passed"]
        assert kind in r["block_reason"] and (text in r["block_reason"]) == (not strict)
    assert got["1"]["counts"] == {"PIN_CODE": 1} and got["4"]["counts"] == {"EMAIL": 1}
    assert not any(got[k]["blocked"] for k in "1456")
    events = {r["request_id"]: r for r in audit_events(out, "request_id").collect()}
    assert events["2"]["error_type"] == "RuntimeError" and events["4"]["error_type"] is None and events["2"]["sanitized_payload_sha256"] == ""
    assert Firewall.vault_rows(out, "request_id").filter("request_id in ('2', '3')").count() == 0


def test_skipped_errors_give_no_rows(spark, moody):
    fw = Firewall("k", detectors=DetectorSet([function_detector("PIN_CODE", moody)]), scan_base64=False)
    got = {r["request_id"]: r["blocked"] for r in fw.sanitize(spark.createDataFrame(ROWS, "request_id string, text string"), "text", "request_id").collect()}
    assert not any(got.values())


def test_an_error_in_one_leaf_blocks_the_request(spark, moody):
    rows = [("1", {"a": "code", "b": "boom"}), ("2", {"a": "code"})]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows], "request_id string, j string").select("request_id", F.parse_json("j").alias("payload"))
    fw = Firewall("k", detectors=DetectorSet([function_detector("PIN_CODE", moody, on_error="fail")]), scan_base64=False)
    got = {r["request_id"]: r for r in sanitize_requests(fw, df).collect()}
    assert got["1"]["action"] == INTERNAL_ERROR and got["1"]["error_type"] == "RuntimeError" and got["1"]["sanitized"] is None
    assert not got["2"]["blocked"] and "PIN_CODE" in got["2"]["sanitized"]


# --- D6 ---------------------------------------------------------------------------------------------
def greedy(spans):
    kept = []
    for i, (a, b) in enumerate(spans):
        if all(b <= spans[k][0] or a >= spans[k][1] for k in kept):
            kept.append(i)
    return kept


def test_binary_search_keeps_what_comparing_all_keeps():
    rng = random.Random(6)
    for t in range(300):
        spans = [(a, a + rng.randint(0 if t % 3 else 1, 12)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 40)))]
        assert kept_spans([a for a, _ in spans], [b for _, b in spans]) == greedy(spans)


def test_twenty_thousand_overlapping_entities(spark):
    rng = random.Random(7)
    sizes = [20_000, FEW_ENTITIES + 1, FEW_ENTITIES, 3, 0]
    base = dict(pii_type="EMAIL", value="v", category=None, evidence=None, related_entity=None, exposed=True)
    rows = []
    for k, n in enumerate(sizes):
        ents = []
        for i in range(n):
            a = rng.randint(0, 3 * n)
            ents.append(Row(**base, start=a, end=a + rng.randint(1, 30), confidence=rng.choice([0.9, 0.95]), det_rank=rng.randint(0, 3), seq=i))
        rows.append((k, ents))
    kind = ("array<struct<pii_type:string,value:string,category:string,evidence:string,related_entity:string,exposed:boolean,"
            "start:int,end:int,confidence:double,det_rank:int,seq:int>>")
    from veilspark.functions.entity import ENTITY_FIELDS

    table = spark.createDataFrame(rows, f"id int, raw {kind}")
    ordered_fields = F.transform("raw", lambda e: F.struct(*[e[f].alias(f) for f in ENTITY_FIELDS]))
    got = {r["id"]: [e["seq"] for e in r["res"]] for r in with_resolved(table.withColumn("found", ordered_fields), "found", "res").select("id", "res").collect()}
    for k, ents in rows:
        order = sorted(ents, key=lambda e: (-(e.end - e.start), -e.confidence, e.det_rank, e.seq))
        keep = kept_spans([e.start for e in order], [e.end for e in order])
        assert got[k] == [order[i].seq for i in keep]


# --- D12 --------------------------------------------------------------------------------------------
@pytest.mark.parametrize("chars", [10_000, 5])
def test_secrets_on_the_wire(spark, chars):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 5))) for _ in range(12)] + ["", None]
    sent = [(i, "".join(rng.choices("abcdé ", k=rng.randint(0, 12)))) for i in range(120)] + [(200, None), (7, "abc"), (7, "abc")]
    got = audit_wire(spark.createDataFrame(sent, "id int, payload string"), spark.createDataFrame([(w,) for w in words], "secret string"), chars=chars).collect()
    want = [(i, t) for i, t in sent if t is not None and any(w and w in t for w in words)]
    assert sorted(tuple(r) for r in got) == sorted(want) and 0 < len(want) < len(sent)


# --- A7, P3, D2 -------------------------------------------------------------------------------------
def test_rule_versions(spark, tmp_path):
    rules = P.read_rules(spark, str(tmp_path / "none.json"), with_defaults=True)
    assert rules.count() == len(P.X.DEFAULT_RULES)
    (tmp_path / "bad.json").write_text("{not json")
    assert P.read_rules(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "r.json").write_text('{"PII_RULES": {"MOBILE": "mask it", "EMAIL": "block", "PHONE": "Redacted"}}')
    read = P.read_rules(spark, str(tmp_path / "r.json"), with_defaults=True)
    now = {(r["tool"], r["type_name"]): r["action"] for r in P.current_rules(read).collect()}
    assert now[("*", "PHONE")] == P.REDACT and now[("*", "EMAIL")] == P.BLOCK and now[("*", "SSN")] == P.REDACT
    more = spark.createDataFrame([("*", "mobile", "allow", 0), ("crm", "EMAIL", "mask", 0), ("crm", "email", "token", 0)], "tool string, type_name string, action string, item long")
    later = P.upsert_rules(read, more)
    now = {(r["tool"], r["type_name"]): r["action"] for r in P.current_rules(later.repartition(5)).collect()}
    assert now[("*", "PHONE")] == P.PASS and now[("crm", "EMAIL")] == P.MASK and now[("*", "EMAIL")] == P.BLOCK
    whole = P.replace_rules(later, spark.createDataFrame([("*", "SSN", "mask")], "tool string, type_name string, action string"))
    now = {(r["tool"], r["type_name"]): r["action"] for r in P.current_rules(whole).collect()}
    assert {k for k in now if k[0] == "*"} == {("*", "SSN")} and now[("*", "SSN")] == P.MASK


def test_rules_reach_the_next_micro_batch(spark, tmp_path):
    """A job that reads its rules per micro-batch follows the table."""
    table, src, out = str(tmp_path / "rules"), str(tmp_path / "in"), str(tmp_path / "out")
    P.default_rules(spark).write.parquet(table)
    empty = spark.createDataFrame([], "tool string, blocked array<string>, whitelisted_fields array<string>, credential_exceptions array<string>")
    allow = spark.createDataFrame([], "category string, destination string")
    schema = "id int, tool string, pii_type string, category string"

    def write(batch, batch_id):
        rules = spark.read.parquet(table)
        P.decide_actions_joined(batch, "tool", rules, empty, allow).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    for i in range(2):
        spark.createDataFrame([(i, "*", "EMAIL", None)], schema).write.mode("append").json(src)
        stream = spark.readStream.schema(schema).json(src).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c"))
        stream.trigger(availableNow=True).start().awaitTermination()
        P.upsert_rules(spark.read.parquet(table), spark.createDataFrame([("*", "EMAIL", "block")], "tool string, type_name string, action string")).filter(
            "version >= 0").write.mode("append").parquet(table)
    got = {r["id"]: r["action"] for r in spark.read.parquet(out).collect()}
    assert got == {0: P.TOKENIZE, 1: P.BLOCK}


# --- A10, G5 ----------------------------------------------------------------------------------------
def test_purge_touches_only_the_days_it_must(spark, tmp_path):
    path = str(tmp_path / "vault")
    days = [dt.datetime(2026, 1, d, 12) for d in (1, 2, 3, 3)]
    rows = [(f"r{i}", "EMAIL", f"{i}@x.com", f"t{i}", None, d) for i, d in enumerate(days)]
    write_vault_days(spark.createDataFrame(rows, "request_id string, pii_type string, value string, token string, client_id string, created_at timestamp"), path)
    files = lambda day: sorted((f, os.stat(f"{path}/day={day}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/day={day}"))
    before = files("2026-01-01")
    gone = spark.createDataFrame([("r2",), ("r1",), ("unknown",), (None,)], "request_id string")
    assert purge_vault_days(spark, path, gone) == 2
    assert sorted(r["request_id"] for r in spark.read.parquet(path).collect()) == ["r0", "r3"]
    assert files("2026-01-01") == before and not os.path.exists(f"{path}/day=2026-01-02")
    assert purge_vault_days(spark, path, gone) == 0


# --- E6 ---------------------------------------------------------------------------------------------
def test_stored_sketches_merge_to_the_whole(spark, tmp_path):
    rng = random.Random(9)
    values = [(dt.datetime(2026, 1, 1) + dt.timedelta(seconds=i // 10), rng.lognormvariate(1, 1)) for i in range(20_000)]
    table = spark.createDataFrame(values, "ts timestamp, ms double").repartition(7)
    latency_sketches(table, "ms", "ts").write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 34
    whole, ordered = merged_latency(stored).first(), sorted(v for _, v in values)
    assert whole["n"] == 20_000 and whole["min"] == ordered[0] and whole["max"] == ordered[-1] and abs(whole["mean"] - sum(ordered) / 20_000) < 1e-9
    for name, q in (("median", 0.5), ("p95", 0.95), ("p99", 0.99)):
        rank = sum(v <= whole[name] for v in ordered) / 20_000
        assert abs(rank - q) < 0.0133 * 2
    hours = merged_latency(stored, [F.date_trunc("hour", "window_start").alias("hour")]).collect()
    assert sum(r["n"] for r in hours) == 20_000

    src = str(tmp_path / "in")
    table.write.parquet(src)
    stream = latency_sketches(spark.readStream.schema(table.schema).parquet(src), "ms", "ts", watermark="1 minute")
    stream.writeStream.format("memory").queryName("latency").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert merged_latency(spark.table("latency")).first()["n"] == 20_000


# --- C29 --------------------------------------------------------------------------------------------
def test_table_function_equals_column_form(spark):
    def words(text):
        if "boom" in text:
            raise RuntimeError("x")
        return [(text.index("code"), text.index("code") + 4, "code", 0.5), {"start": 0, "end": 1}, "e"] if "code" in text else []

    rows = spark.createDataFrame([(i, t, "k") for i, (_, t) in enumerate(ROWS)], "id int, text string, value string")
    got = detect_udtf(rows, "text", "id", "PIN_CODE", words, 0.7)
    want = detect(rows, "text", ["id"], DetectorSet([function_detector("PIN_CODE", words, 0.7)])).select("id", "pii_type", "start", "end", "value", "confidence")
    spans = sorted(tuple(r) for r in got.filter("error is null").drop("error").collect())
    assert spans == sorted(tuple(r) for r in want.collect()) and len(spans) == 6
    assert [(r["id"], r["error"]) for r in got.filter("error is not null").collect()] == [(1, "RuntimeError")]
    assert dict(got.dtypes)["start"] == "int" and dict(got.dtypes)["confidence"] == "double"


# --- S3, S4 -----------------------------------------------------------------------------------------
def test_two_streams_meet_in_any_order(spark, tmp_path):
    from veilspark.streaming.jobs import restore_streams

    at = lambda m: dt.datetime(2026, 1, 1, 10) + dt.timedelta(minutes=m)
    vault = lambda v: [Row(pii_type="EMAIL", value=v, token=T1)]
    rq = "request_id string, ts timestamp, vault array<struct<pii_type:string,value:string,token:string>>"
    rs = "request_id string, ts timestamp, response string, n int"
    far = [("zz", at(500), [])]
    requests = [[("a", at(0), vault("a@x.com"))], [("b", at(5), vault("b@x.com"))], [("c", at(1), vault("c@x.com"))], far]
    responses = [[("b", at(6), f"early {T1}", 1), ("a", at(1), f"x {T1}", 2)], [("a", at(2), f"again {T1} {T2}", 3), ("u", at(3), T1, 4)],
                 [("c", at(90), f"late {T1}", 5), ("b", at(7), None, 6)], [("zz", at(500), "end", 7)], [("zz", at(501), "end", 8)]]
    for i in range(5):
        if i < len(requests):
            spark.createDataFrame(requests[i], rq).coalesce(1).write.mode("append").json(str(tmp_path / "rq"))
        spark.createDataFrame(responses[i], rs).coalesce(1).write.mode("append").json(str(tmp_path / "rs"))
        met = restore_streams(spark.readStream.schema(rs).json(str(tmp_path / "rs")), spark.readStream.schema(rq).json(str(tmp_path / "rq")),
                              within="1 hour", late="100 minutes")
        q = met.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        q.trigger(availableNow=True).start().awaitTermination()
    got = {r["n"]: (r["restored"], r["restored_count"]) for r in spark.read.parquet(str(tmp_path / "out")).filter("request_id <> 'zz'").collect()}
    assert got == {1: ("early b@x.com", 1), 2: ("x a@x.com", 1), 3: (f"again a@x.com {T2}", 1), 4: (T1, 0), 5: (f"late {T1}", 0), 6: (None, 0)}


def test_vault_entries_expire(spark, tmp_path):
    from veilspark.streaming.jobs import use_rocksdb, vault_state

    use_rocksdb(spark)
    schema = "request_id string, kind string, seq long, text string, vault map<string,string>"
    batches = [[("a", "request", 1, None, {T1: "a@x.com"}), ("b", "request", 1, None, {T1: "b@x.com"}), ("b", "response", 2, f"in time {T1}", None)],
               [("a", "response", 2, f"too late {T1}", None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = vault_state(stream, ttl="2 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        assert q.trigger(once=True).start().awaitTermination(90)
        time.sleep(2.5)
    got = sorted((r["request_id"], r["restored"], r["restored_count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", f"too late {T1}", 0), ("b", "in time b@x.com", 1)]
