"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits lie on a ring of ``SEGMENTS`` segments. If two differ in at most t bits,
then from some segment on every chain of l consecutive segments differs in at most l * t / m bits
(the pigeonring principle). With t = 4 and m = 7 the budgets of chains of 1 to 7 segments are
0, 1, 1, 2, 2, 3, 4. Candidates come from an equi-join on chains of three segments (27 or 28 bits):
one side gives its chain as it is, the other also with each zero bit of the second and third
segment set, so that the pair is found whichever side has the differing bit. Then the chain is
checked over all lengths, and what is left by the full Hamming distance. Beyond ``MANY`` fingerprints, where chance
alone would fill a key of 27 bits, the chains have five segments (45 bits) and may differ in two bits: one side
gives each of them with any one bit turned, the other with any one zero bit set, so that they meet half way.

Only distinct fingerprints take part (copies are one row), links go through ``components`` and
every document gets the smallest id reachable.

Defined cases: null and empty texts have fingerprint zero, which links like any other; fewer words
than a shingle are one shingle; repeated rows and ids are judged each by itself; null ids are never
the smallest unless a component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import cut
from veilspark.llm.components import components

SHINGLE = 4
DISTANCE = 4
SEGMENTS = 7
CHAIN = 3
LONG_CHAIN = 5
MANY = 1 << 29
SEED = 42
#: Bits of a byte, highest first.
BITS = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1).astype("i8")


def _fingerprint(text: bytes | None, shingle: int) -> int:
    """The 64-bit fingerprint as a signed long."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        stops = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *stops[:-shingle].tolist()]
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (stops[shingle - 1 :] - 1).tolist())]
    data = np.array(hashes, ">u8").view("u1").reshape(-1, 8)
    places = np.bincount((data + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    ones = (places @ BITS).ravel()  # how many hashes have each bit set, highest first
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Column of fingerprints (signed longs) of a text column."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_fingerprint(t, shingle) for t in texts], dtype="int64")

    return run(text.cast("binary"))


def ring(segments: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment, the wider ones first."""
    wide, out, at = 64 % segments, [], 0
    for i in range(segments):
        n = 64 // segments + (i < wide)
        out.append((at, n))
        at += n
    return out


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(segments: list[tuple[int, int]], first: int, length: int) -> int:
    mask = 0
    for k in range(length):
        at, n = segments[(first + k) % len(segments)]
        mask |= ((1 << n) - 1) << at
    return mask


def near_pairs(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, chain: int = CHAIN) -> DataFrame:
    """Pairs (u, v), u < v, of the distinct longs in column ``fp`` within the distance.

    The join key is the chain's bits in place plus the number of its first segment. The chain's
    budget must allow two differing bits at most, and none in its first segment.
    """
    parts, budget = ring(segments), [k * distance // segments for k in range(segments + 1)]
    if budget[1] != 0 or budget[chain] > 2:
        raise ValueError("the chain may allow two differing bits, and none in its first segment")
    fp = F.col("fp")
    plain, probes = [], []
    for i in range(segments):
        kept = fp.bitwiseAND(F.lit(_long(_mask(parts, i, chain))))
        key = lambda bits: F.struct(F.lit(i).alias("i"), bits.alias("bits"))  # noqa: B023, E731
        free = [F.lit(_long(1 << b)) for k in range(1, chain) for b in range(*(lambda s: (s[0], s[0] + s[1]))(parts[(i + k) % segments]))]
        plain.append(key(kept))
        probes.append(key(kept))
        if budget[chain] == 2:
            plain += [key(kept.bitwiseXOR(bit)) for bit in free]
        if budget[chain]:
            probes += [F.when(fp.bitwiseAND(bit) == 0, key(kept.bitwiseOR(bit))) for bit in free]
    have = prints.select(fp.alias("v"), F.inline(F.array(*plain)))
    ask = prints.select(fp.alias("u"), F.inline(F.array_compact(F.array(*probes))))
    found = ask.join(have, ["i", "bits"]).filter("u <> v").withColumn("x", F.col("u").bitwiseXOR(F.col("v")))
    viable = F.lit(False)
    for i in range(segments):
        ok = F.col("i") == i
        for length in range(1, segments):
            ok = ok & (F.bit_count(F.col("x").bitwiseAND(F.lit(_long(_mask(parts, i, length))))) <= budget[length])
        viable = viable | ok
    close = found.filter(viable).filter(F.bit_count("x") <= distance)
    return close.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE, more: list[Column] | None = None) -> DataFrame:
    """Per row: id (and ``more``), fp (signed long), group (smallest fingerprint of the component)
    and component_id (the smallest id in it)."""
    rows = cut(docs.select(F.col(id_col).alias(id_col), *(more or []), fingerprint(F.col(text_col), shingle).alias("fp")))
    prints = cut(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    chain = CHAIN if prints.count() <= MANY else LONG_CHAIN
    roots = components(near_pairs(prints.select("fp"), distance, chain=chain))
    grouped = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("root", "fp"))
    ids = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    classes = grouped.select("fp", "group").join(ids, "group")
    return rows.join(classes, "fp")
