"""Sharding: a Feistel permutation with cycle walking over global row numbers [native].

Every row gets a global number 0..N-1 in a fixed order, the number is permuted by a keyed Feistel
network on the mixed-radix domain a x b >= N (a = ceil(sqrt N), b = ceil(N / a)), and the permuted
position alone gives the place: ``shard = position % shards``, ``slot = position // shards``. So
the counts of two shards differ by one at most (law ``rows``), slots are gapless, and shard and
slot of a row number can be computed (and inverted) without the table.

Global row numbers without one big sort: rows fall into ``BUCKETS`` hash buckets, the bucket
counts (a bounded table) give each bucket's offset, and a window numbers the rows of a bucket.
The order is (bucket, id, size, text checksum): a function of the rows alone, so a task that runs
again gives the same numbers. Rows equal in all three are interchangeable.

Cycle walking: a position >= N is permuted again until it falls below N. Only the a*b - N < a
positions outside can prolong a walk, so the longest walk is found exactly by walking those
positions (at most sqrt(N) rows) before the plan is built; no walk is ever cut off.

Defined cases: null text has size 8 and checksum 0; null ids are ordinary keys; repeated rows get
one place each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import cut

BUCKETS = 4096
ROUNDS = 6


def number_rows(rows: DataFrame, order: list[str], out: str = "row_number") -> tuple[DataFrame, int]:
    """``rows`` with a global number 0..N-1 in column ``out``, and N."""
    keyed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int"))
    counts = dict(keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect())  # BUCKETS rows at most
    offsets, total = [], 0
    for b in range(BUCKETS):
        offsets.append(total)
        total += counts.get(b, 0)
    starts = F.from_json(F.lit(json.dumps(offsets)), "array<bigint>")
    w = Window.partitionBy("_bucket").orderBy(*order)
    numbered = keyed.withColumn(out, F.row_number().over(w) - 1 + F.element_at(starts, F.col("_bucket") + 1))
    return numbered.drop("_bucket"), total


def _radix(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def permute_once(df: DataFrame, col: str, n: int, key: int) -> DataFrame:
    """``col`` (a number below a * b) replaced by its image under the Feistel network.

    Even rounds add a keyed hash of the right half to the left one modulo a, odd rounds the other
    way modulo b: each round can be undone, so the whole is a permutation of 0..a*b-1.
    """
    a, b = _radix(n)
    df = df.withColumn("_l", F.expr(f"{col} div {b}")).withColumn("_r", F.col(col) % b)

    def mixed(i: int, half: str, mod: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(key).cast("long"), F.lit(i), F.col(half)), F.lit(mod).cast("long"))

    for i in range(ROUNDS):
        if i % 2 == 0:
            df = df.withColumn("_l", (F.col("_l") + mixed(i, "_r", a)) % a)
        else:
            df = df.withColumn("_r", (F.col("_r") + mixed(i, "_l", b)) % b)
    return df.withColumn(col, F.col("_l") * b + F.col("_r")).drop("_l", "_r")


def longest_walk(spark, n: int, key: int) -> int:
    """Steps after which every walk that starts below ``n`` is below ``n`` again (none for no rows).

    The positions outside are written after each step, so that the plan of a step never holds the steps before.
    """
    if not n:
        return 0
    a, b = _radix(n)
    outside = spark.range(n, a * b).select(F.col("id").alias("x"))
    steps = 1
    while not outside.isEmpty():
        outside = cut(permute_once(outside, "x", n, key)).filter(F.col("x") >= n)
        steps += 1
    return steps


def permute(df: DataFrame, col: str, n: int, key: int) -> DataFrame:
    """The keyed permutation of 0..n-1 applied to ``col``; a table without rows comes back as it is."""
    for step in range(longest_walk(df.sparkSession, n, key)):
        if step == 0:
            df = permute_once(df, col, n, key)
        else:
            df = df.withColumn("_was", F.col(col))
            df = permute_once(df, col, n, key)
            df = df.withColumn(col, F.when(F.col("_was") < n, F.col("_was")).otherwise(F.col(col))).drop("_was")
    return df


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, key: int = 42) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias(id_col),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, n = number_rows(rows, [id_col, "size", "text_crc32"], "position")
    placed = permute(numbered, "position", n, key)
    return placed.select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("position") % shards).cast("int").alias("shard"),
        F.expr(f"position div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
