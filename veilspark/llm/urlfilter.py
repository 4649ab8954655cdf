"""URL filter: domain and path rules, then a Bloom filter cascade with exact answers.

Rules (host, path) fit their host and its subdomains where the url's path starts with the rule's;
the longest decides. Where none fits, the listed keys decide: a key is host + path, and the listed
keys are encoded in a cascade over the corpus's whole key universe. Level 1 is a Bloom filter of
the listed keys; level 2 one of the unlisted keys that pass level 1; level 3 one of the listed
keys that pass level 2; and so on until no false positive is left. A key's answer is the parity of
the first level that it fails, which is exact for every key of the universe, and no page is joined
with the list.

The universe is dealt into hash shards of about ``KEYS_PER_SHARD`` distinct keys (two 64-bit hashes
each), one cascade per shard, so a task holds a bounded number of keys. Pages are answered with the
cascades at hand in blocks of at most ``BLOCK_BYTES`` (measured, not assumed); each page is
answered in the block that holds its shard.

Defined cases: a null url or one without ``://`` has empty host and path, and the empty key is
looked up like any other; repeated rows give one row each; an empty table gives an empty result;
without listed keys everything unruled is allowed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import cut

KEYS_PER_SHARD = 50_000
BLOCK_BYTES = 64_000_000
MAX_LEVELS = 200
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Words of host names whose urls the query lists.
LISTED_WORDS = ["adult", "ads", "bets", "casino", "pills", "porn", "spam", "warez"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does."""
    rule = verdict = None
    for said, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (rule, verdict) if rules else (F.lit(None).cast("string"),) * 2


def has_word(host: Column, words: list[str]) -> Column:
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, words)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, probes: int) -> list[np.ndarray]:
    step = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    a, b = _mix(h1 + step), _mix(h2 ^ step) | np.uint64(1)
    return [(a + np.uint64(i) * b) % np.uint64(bits) for i in range(probes)]


def _passes(filt: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    ok = np.ones(len(places[0]), bool)
    for p in places:
        ok &= (filt[p >> np.uint64(3)] >> (p & np.uint64(7)).astype("u1")) & 1 != 0
    return ok


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Levels (bits, probes, filter) of one shard's cascade."""
    levels: list[tuple[int, int, bytes]] = []
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        if len(levels) >= MAX_LEVELS:
            raise ValueError("two keys share both hashes")
        rate = min(0.5, len(inside) / (2 * len(outside))) if not levels and len(outside) else 0.5
        probes = max(1, round(math.log2(1 / rate)))
        bits = max(8, math.ceil(len(inside) * probes / math.log(2)))
        filt = np.zeros((bits + 7) // 8, "u1")
        for p in _places(h1[inside], h2[inside], len(levels), bits, probes):
            np.bitwise_or.at(filt, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype("u1"))
        wrong = outside[_passes(filt, _places(h1[outside], h2[outside], len(levels), bits, probes))]
        levels.append((bits, probes, filt.tobytes()))
        inside, outside = wrong, inside
    return levels


def is_listed(levels: list[tuple[int, int, bytes]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    answer = np.full(len(h1), len(levels) % 2 == 1)
    alive = np.arange(len(h1))
    for k, (bits, probes, filt) in enumerate(levels):
        ok = _passes(np.frombuffer(filt, "u1"), _places(h1[alive], h2[alive], k, bits, probes))
        answer[alive[~ok]] = k % 2 == 1
        alive = alive[ok]
    return answer


def build_cascades(keys: DataFrame) -> tuple[DataFrame, int]:
    """Table (shard, levels, size) from the universe ``keys`` (h1, h2, listed), and the number of shards."""
    universe = cut(keys.groupBy("h1", "h2").agg(F.max("listed").alias("listed")))
    shards = max(1, -(-universe.count() // KEYS_PER_SHARD))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = build_levels(pdf["h1"].to_numpy().view("u8"), pdf["h2"].to_numpy().view("u8"), pdf["listed"].to_numpy(bool))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "levels": [[{"bits": b, "probes": p, "filter": f} for b, p, f in levels]],
                             "size": [sum(len(f) for _, _, f in levels)]})

    schema = "shard long, levels array<struct<bits: long, probes: int, filter: binary>>, size long"
    built = universe.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInPandas(build, schema)
    return cut(built), shards


def _answer(rows: DataFrame, cascades: dict[int, list[tuple[int, int, bytes]]]) -> DataFrame:
    def run(batches):
        for batch in batches:
            shard = np.asarray(batch.column("shard"))
            h1, h2 = (np.asarray(batch.column(c)).view("u8") for c in ("h1", "h2"))
            listed = np.zeros(len(shard), bool)
            for s in np.unique(shard):
                here = np.flatnonzero(shard == s)
                listed[here] = is_listed(cascades.get(int(s), []), h1[here], h2[here])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(listed)], [*batch.schema.names, "listed"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("listed", T.BooleanType())]))


def filter_urls(pages: DataFrame, listed_key, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, listed, verdict. ``listed_key(host, path)`` tells which keys
    of the universe are listed; it is asked only when the cascades are built."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    key = F.concat("host", "path")
    rows = rows.withColumns({"h1": F.xxhash64(key), "h2": F.xxhash64(F.lit(1), key)})
    cascades, shards = build_cascades(rows.select("h1", "h2", listed_key(F.col("host"), F.col("path")).alias("listed")))
    rows = rows.withColumn("shard", F.pmod("h1", F.lit(shards)))
    sizes = cascades.select("shard", "size").orderBy("shard").toLocalIterator()
    blocks, held = [[0, shards]], 0
    for s, size in sizes:
        if held and held + size > BLOCK_BYTES:
            blocks[-1][1], held = s, 0
            blocks.append([s, shards])
        held += size
    out = None
    for a, b in blocks:
        within = (F.col("shard") >= a) & (F.col("shard") < b)
        block = {r["shard"]: [(x["bits"], x["probes"], bytes(x["filter"])) for x in r["levels"]] for r in cascades.filter(within).toLocalIterator()}
        part = _answer(rows if len(blocks) == 1 else rows.filter(within), block)
        out = part if out is None else out.unionByName(part)
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(id_col, "host", "path", rule.alias("rule"), "listed", verdict.alias("verdict"))


def oracle_sql() -> str:
    """The same verdicts in DuckDB SQL, with the listed words looked up directly."""
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, said) for said, h, p in cases]
    rule = " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits)
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)
    words = ", ".join(f"'{w}'" for w in LISTED_WORDS)
    return f"""
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN list_has_any(string_split_regex(host, '[.-]'), [{words}]) THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages) p
"""
