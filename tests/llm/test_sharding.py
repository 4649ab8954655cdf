import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm import sharding as S

DOCS = [(i, f"text {i % 7} é", "en") for i in range(500)] + [(None, None, None), (None, "", None), (3, "x" * 300_000, "en")] + [(77, "twin", "en")] * 5


def test_rows_law_places_every_row_once(frame, rows):
    got = S.shard_rows(frame(DOCS, "doc_id bigint, text string, lang string"))
    out = got.collect()
    assert len(out) == len(DOCS)
    counts = Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(24))
    for s, n in counts.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in DOCS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    assert {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}


def test_same_places_whatever_the_partitions(frame, rows):
    df = frame(DOCS, "doc_id bigint, text string, lang string")
    assert rows(S.shard_rows(df)) == rows(S.shard_rows(df.repartition(7, "text")))
    assert rows(S.shard_rows(df)) != rows(S.shard_rows(df, key=1))


def test_empty_table(frame):
    assert S.shard_rows(frame([], "doc_id bigint, text string")).collect() == []


def test_walk_is_a_permutation(spark):
    for n in (1, 2, 3, 5, 10, 26, 101, 1000):
        got = S.permute(spark.range(n).withColumnRenamed("id", "x"), "x", n, 5).collect()
        assert sorted(r["x"] for r in got) == list(range(n))


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 10**12))
def test_domain_exceeds_rows_by_less_than_its_root(n):
    a, b = S._radix(n)
    assert 0 <= a * b - n < a and a - 1 < n**0.5 + 1
