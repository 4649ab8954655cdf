"""Findings of round three: the work a job does for one read of its texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators.detect import pattern_only
from veilspark.operators.restore import audit_wire
from veilspark.plans.sanitize import Firewall


def test_vault_rows_run_the_chain_once(spark):
    fw = Firewall("s", detectors=pattern_only(["EMAIL"]), use_nfkc=False, scan_base64=False)
    df = spark.createDataFrame([("a", "to x@example.org and y@example.org"), ("b", "none"), ("c", None)], "request_id string, text string")
    vault = Firewall.vault_rows(fw.sanitize(df, "text", "request_id"), "request_id")
    assert sorted((r["request_id"], r["value"]) for r in vault.collect()) == [("a", "x@example.org"), ("a", "y@example.org")]
    plan = vault._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 8  # four for the chain; 48 with its copies in a pushed filter


def test_vault_rows_leave_out_blocked_requests(spark):
    from veilspark.operators.policy import Policy, ToolRule

    fw = Firewall("s", policy=Policy(rules={"*": ToolRule("*", {}, {"IP_ADDRESS"})}), detectors=pattern_only(["EMAIL", "IP_ADDRESS"]), scan_base64=False)
    df = spark.createDataFrame([("a", "x@example.org at 10.0.0.1"), ("b", "y@example.org")], "request_id string, text string")
    vault = Firewall.vault_rows(fw.sanitize(df, "text", "request_id"), "request_id")
    assert [(r["request_id"], r["value"]) for r in vault.collect()] == [("b", "y@example.org")]


def test_secrets_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    secrets = spark.range(30).select(F.concat(F.lit("secret-"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("secret"))
    sent = spark.createDataFrame([(1, "has secret-007"), (2, "no"), (3, "secret-029 secret-001"), (4, None)], "id long, payload string")
    found = audit_wire(sent, secrets.mapInArrow(count, "secret string"), chars=60)
    assert sorted(r["id"] for r in found.collect()) == [1, 3]
    assert seen.value == 30


def test_queries_that_use_the_vault_often_read_the_documents_once(spark, tmp_path):
    import __spark_entry__ as E

    rows = [(i, f"write to u{i}@example.org") for i in range(1, 7)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query in (E.q_restore_clients, E.q_fields):
        out = query(spark, str(tmp_path))
        assert out.inputFiles() == []  # only the materialised vault is read
        assert {r["doc_id"] for r in out.collect()} >= set(range(1, 7))


def test_python_workers_hold_few_texts_at_a_time():
    """NFKC and user functions see slices of their batch, whatever its length, and lose nothing of it."""
    import pyarrow as pa

    from veilspark.functions.normalize import SLICE, by_slices

    texts = [None if i % 5 == 0 else f"t{i}" for i in range(3 * SLICE + 7)]
    sizes = []
    out = by_slices(pa.array(texts), lambda part: sizes.append(len(part)) or part, pa.string())
    assert out.to_pylist() == texts and max(sizes) == SLICE
    assert by_slices(pa.array([], pa.string()), lambda part: part, pa.string()).to_pylist() == []
