import random

from xxhash import xxh64_intdigest

from pyspark.sql import functions as F

import pytest

from veilspark.llm import simhash as S
from veilspark.llm.components import components

RNG = random.Random(2)
BASE = [" ".join(RNG.choices([f"word{i}" for i in range(300)], k=400)) for _ in range(6)]
NEAR = [" ".join(w if RNG.random() > 0.004 else "changed" for w in b.split()) for b in BASE for _ in range(6)]
DOCS = list(enumerate(BASE + NEAR + BASE[:2])) + [(500, None), (501, ""), (502, "  \n "), (None, BASE[0]), (503, "one two"), (504, "ONE two"), (7, "repeated row"), (7, "repeated row"), (505, "a " * 50_000)]


def fingerprint(text):
    w = ("" if text is None else "".join(c.lower() if c.isascii() else c for c in text)).encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs):
    prints = [fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(docs, prints))), key=repr)


def test_equals_brute_force(frame):
    got = S.near_duplicates(frame(DOCS, "doc_id bigint, text string"))
    got = got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(DOCS)


def test_empty_table(frame):
    assert S.near_duplicates(frame([], "doc_id bigint, text string")).collect() == []


@pytest.mark.parametrize("chain", [S.CHAIN, S.LONG_CHAIN])
def test_no_pair_is_lost(spark, chain):
    prints = [RNG.getrandbits(64) for _ in range(60)]
    for p in prints[:60]:
        for k in range(1, 6):
            q = p
            for b in RNG.sample(range(64), k):
                q ^= 1 << b
            prints.append(q)
    signed = sorted({S._long(p) for p in prints})
    got = {tuple(r) for r in S.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp bigint"), chain=chain).collect()}
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert got == want


def test_components_of_a_path_a_star_and_a_cycle(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 9)] + [(200, 201), (201, 202), (202, 200), (200, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u bigint, v bigint")).collect()))
    assert got == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(9)}, 200: 200, 201: 200, 202: 200}
