"""Findings of round three that were mended later: the base64 stage's readings of its input."""

import base64

from pyspark.sql import functions as F

from veilspark.functions.normalize import normalize_unicode
from veilspark.operators.detect import pattern_only
from veilspark.plans.sanitize import Firewall

HIDDEN = base64.b64encode(b"write to ann@example.org today, please").decode()
OTHER = base64.b64encode(b"call 10.20.30.40 or bob@example.org").decode()


def test_base64_stage_reads_its_input_twice_and_normalises_once_per_reading(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("request_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    out = Firewall("k", detectors=pattern_only(["EMAIL"])).sanitize(rows, "text", "request_id").select("request_id", "sanitized")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and plan.count("Range (") == 2


def test_copies_nulls_and_rows_of_several_carriers_keep_their_rows(spark):
    texts = [f"see {HIDDEN} and {OTHER}", f"see {HIDDEN}", f"see {HIDDEN}", "no carrier", None, f"{OTHER} {HIDDEN} {OTHER}"]
    rows = spark.createDataFrame([("1" if i in (1, 2) else str(i) if i else None, t, i) for i, t in enumerate(texts)], "request_id string, text string, n int")
    fw = Firewall("k", detectors=pattern_only(["EMAIL", "IP_ADDRESS"]))
    got = {r["n"]: r for r in fw.sanitize(rows.repartition(3), "text", "request_id").collect()}
    assert len(got) == 6 and [got[i]["total_detected"] for i in range(6)] == [3, 1, 1, 0, 0, 5]
    assert got[1]["sanitized"] == got[2]["sanitized"] and HIDDEN not in got[1]["sanitized"] and got[4]["sanitized"] is None
    assert got[3]["sanitized"] == "no carrier"


def test_invisible_characters_go_from_any_text(spark):
    texts = ["plain", "a​b", "é­", "ﬁn", "", None, "​"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string")
    for use, want in ((True, ["plain", "ab", "é", "fin", "", None, ""]), (False, ["plain", "ab", "é", "ﬁn", "", None, ""])):
        got = rows.select("n", normalize_unicode(F.col("text"), use).alias("t")).orderBy("n").collect()
        assert [r["t"] for r in got] == want
