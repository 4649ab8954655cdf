from pyspark.sql import functions as F

from veilspark.operators.detect import default_detectors
from veilspark.operators.restore import purge_vault, restore_text
from veilspark.plans.sanitize import Firewall

ROWS = [
    ("r1", "mail alex@example.com twice alex@example.com, call +1 (555) 123-4567"),
    ("r2", "mail alex@example.com from another request"),
    ("r3", "My ATM PIN is 4821"),
    ("r4", "plain text"),
]


def test_sanitize_restore_round_trip(spark):
    df = spark.createDataFrame(ROWS, "request_id string, text string")
    fw = Firewall("test secret", detectors=default_detectors(enable_context=True))
    out = fw.sanitize(df, "text", "request_id").select("request_id", "text", "clean", "sanitized", "blocked", "vault").cache()
    res = {r.request_id: r for r in out.collect()}
    # same value twice in one request -> one token; same value in two requests -> two tokens
    v1 = {(v.pii_type, v.value): v.token for v in res["r1"].vault}
    v2 = {(v.pii_type, v.value): v.token for v in res["r2"].vault}
    assert res["r1"].sanitized.count(v1[("EMAIL", "alex@example.com")]) == 2
    assert v1[("EMAIL", "alex@example.com")] != v2[("EMAIL", "alex@example.com")]
    assert "alex@example.com" not in res["r1"].sanitized
    # a strict credential blocks the whole request and nothing is sent
    assert res["r3"].blocked and res["r3"].sanitized is None
    assert res["r4"].sanitized == "plain text"

    vault = Firewall.vault_rows(out, "request_id")
    resp = out.select("request_id", F.col("sanitized").alias("response"))
    restored = {r.request_id: r for r in restore_text(resp, vault).collect()}
    assert restored["r1"].restored == ROWS[0][1] and restored["r1"].restored_count == 3
    assert restored["r2"].restored == ROWS[1][1]

    # a foreign token (from r1) in r2's response stays unchanged
    foreign = spark.createDataFrame([("r2", "echo " + v1[("EMAIL", "alex@example.com")])], "request_id string, response string")
    r = restore_text(foreign, vault).collect()[0]
    assert r.restored_count == 0 and r.restored == "echo " + v1[("EMAIL", "alex@example.com")]

    # after purge a second restore gives nothing
    purged = purge_vault(vault, spark.createDataFrame([("r1",)], "request_id string"))
    r = restore_text(resp.filter("request_id = 'r1'"), purged).collect()[0]
    assert r.restored_count == 0
