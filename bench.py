"""Headline throughput benchmark.

Runs the headline jobs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line. A warm-up pass on the smallest scale
factor builds the (memoised) detector expressions and JIT-compiles generated code first,
as a long-running job would have done; its time is reported separately.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from veilspark.operators.detect import default_detectors, detect, pattern_only  # noqa: E402
from veilspark.operators.restore import audit_events, restore_text  # noqa: E402
from veilspark.plans.sanitize import Firewall  # noqa: E402
from veilspark.session import build_session  # noqa: E402

FLAGSHIP = ["EMAIL", "PHONE", "CREDIT_CARD", "IP_ADDRESS"]


def jobs(spark, sf_dir, parts):
    """Headline queries as functions that build a DataFrame."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    if docs.rdd.getNumPartitions() < parts:
        # The bench's table is one small file, which Spark reads as one split; large tables have splits enough.
        docs = docs.repartition(parts)
    det_all = default_detectors()
    fw = Firewall("bench")
    requests = docs.select(F.col("doc_id").cast("string").alias("request_id"), "text")

    def flagship():
        ents = detect(docs, "text", ["doc_id", "source"], pattern_only(FLAGSHIP))
        return ents.groupBy("source", "pii_type").count()

    def detect_all():
        return detect(docs.select("doc_id", "text"), "text", ["doc_id"], det_all).groupBy("pii_type").count()

    def sanitize():
        out = fw.sanitize(requests, "text", "request_id")
        return audit_events(out, "request_id").groupBy("action").agg(F.sum("total_entities_secured"))

    def round_trip():
        out = fw.sanitize(requests, "text", "request_id")
        out = out.select("request_id", "clean", "sanitized", "vault", "blocked").checkpoint()
        vault = Firewall.vault_rows(out, "request_id")
        resp = out.select("request_id", F.col("sanitized").alias("response"), "clean")
        r = restore_text(resp, vault, "request_id", "response")
        return r.agg(F.sum("restored_count"), F.avg(F.col("restored").eqNullSafe(F.col("clean")).cast("double")))

    return {"q_flagship_counts": flagship, "q_detect_all": detect_all, "q_sanitize": sanitize, "q_round_trip": round_trip}


def timed(fn):
    """Seconds to build, plan and run a query (a checkpoint inside counts as building)."""
    t0 = time.time()
    df = fn()
    t1 = time.time()
    df._jdf.queryExecution().executedPlan()
    t2 = time.time()
    df.collect()
    return [round(x, 3) for x in (t1 - t0, t2 - t1, time.time() - t2)]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    ncpu = int(cpus) if cpus.isdigit() else os.cpu_count()
    spark = build_session(cpus=cpus, app="veilspark-bench", shuffle_partitions=max(ncpu * 2, 8))
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    t0 = time.time()
    if os.path.isdir(warm_dir):
        for fn in jobs(spark, warm_dir, ncpu).values():
            fn().collect()
    warm = time.time() - t0

    parts = {name: timed(fn) for name, fn in jobs(spark, sf_dir, ncpu * 2).items()}
    times = {name: round(sum(p), 3) for name, p in parts.items()}

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_docs, n_chars = docs.agg(F.count(F.lit(1)), F.sum(F.length("text"))).collect()[0]
    san = times["q_sanitize"]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "total_headline_sec",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "build_plan_run_sec": parts,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "cpus": ncpu,
                "warmup_sec": round(warm, 3),
                "sanitize_docs_per_sec": round(n_docs / san, 1),
                "sanitize_mb_per_sec": round(n_chars / san / 1e6, 3),
                "sanitize_mb_per_sec_core": round(n_chars / san / 1e6 / ncpu, 3),
            }
        )
    )


if __name__ == "__main__":
    main()
