import random

import pytest

import corpus_pipeline as C

RNG = random.Random(12)


def prose(n):
    return " ".join("".join(RNG.choices(["the", "ing", "er", "and", "sh", "wh", "tion", "of"], k=RNG.randint(1, 4))) for _ in range(n))


ITEM = prose(20)
COPY = prose(120)
DOCS = (
    [(i, prose(RNG.randint(30, 200)), "en", "s", 0) for i in range(30)]
    + [(50, COPY, "en", "s", 0), (40, COPY, "en", "s", 0), (40, COPY, "en", "s", 0), (60, "12 34", None, None, 0), (61, None, "en", None, None), (62, "", "en", "s", 0)]
    + [(70, prose(30) + " " + ITEM + " " + prose(20), "en", "s", 0), (None, prose(80) + " me@mail.example.com", "en", "s", 0)]
)


@pytest.fixture
def tables(tmp_path, frame):
    frame(DOCS, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    frame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, tables)
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k + 1 < len(C.STAGES):
            assert docs.columns == columns
            kept.append(sorted((r["doc_id"] for r in docs.collect()), key=repr))
    given = sorted((d[0] for d in DOCS), key=repr)
    no_language = [i for i in given if i not in (60, 61, 62)]
    assert kept[0] == no_language
    once = sorted(set(no_language) - {50}, key=repr)
    assert kept[1] == once
    assert kept[2] == [i for i in once if i != 70] == kept[3]
    redacted = spark.read.parquet(f"{tmp_path}/stage3").filter("doc_id is null").first()
    assert redacted["text"].endswith(" [EMAIL]") and redacted["n_chars"] == len(redacted["text"])
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(kept[3])


def test_empty_documents(spark, tables, tmp_path):
    empty = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        empty = stage(spark, empty, tables)
        assert empty.collect() == []
        empty = spark.createDataFrame([], empty.schema)
