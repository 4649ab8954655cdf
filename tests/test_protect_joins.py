"""tables of whole requests are never broadcast, however small the optimiser takes them to be."""

from pyspark.sql import functions as F

from veilspark.operators.detect import pattern_only
from veilspark.plans.requests import protect
from veilspark.plans.sanitize import Firewall

ROWS = [("a", '{"tool":"crm","args":{"body":"mail x1@ex.com","list":["x1@ex.com","x"]}}'), ("b", '{"n":1}'), ("c", None)]
# a request id that comes twice: either row is answered with the leaves of both
PLAIN = [("d", '{"n":1}'), ("d", '{"n":2}')]


def _done(spark, rows, folder):
    spark.createDataFrame(rows, "request_id string, json string").write.parquet(str(folder / "requests"))  # a small file, to the optimiser
    df = spark.read.parquet(str(folder / "requests")).select("request_id", F.try_parse_json("json").alias("payload"))
    return protect(Firewall("k", detectors=pattern_only(["EMAIL"]), scan_base64=False), df, lambda sent: sent.withColumnRenamed("sent", "response"))


def test_request_tables_are_joined_by_sorting(spark, tmp_path):
    plan = _done(spark, ROWS, tmp_path)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_every_request_is_answered(spark, tmp_path):
    out = {r["request_id"]: r for r in _done(spark, ROWS, tmp_path).collect()}
    assert set(out) == {"a", "b", "c"}
    assert "x1@ex.com" not in out["a"]["sent"] and "x1@ex.com" in out["a"]["restored"] and out["a"]["restored_count"] == 2
    assert (out["b"]["sent"], out["b"]["restored"], out["b"]["blocked"]) == ('{"n": 1}', '{"n": 1}', False)
    assert out["c"]["blocked"] and out["c"]["restored"] is None


def test_repeated_request_ids_keep_their_rows(spark, tmp_path):
    out = _done(spark, PLAIN, tmp_path).collect()
    assert sorted(r["sent"] for r in out) == ['{"n": 1}'] * 2 + ['{"n": 2}'] * 2
