"""A training corpus from ``documents`` in five stages, each an operator of ``veilspark.llm``.

Every stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and its result is
written as Parquet and read again for the next. All but the last return the columns of ``documents``.
Null texts have no language, so the first stage drops them; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate as D
from veilspark.llm import langid, packing, personal, simhash
from veilspark.llm.common import cut, table

#: Language profiles and tokens have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter are rejected."""
    found = langid.identify(docs, langid.train(docs))
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).select("row.*")


def _whole(docs: DataFrame) -> Column:
    """All columns as one, so that their names can't clash with a stage's own."""
    return F.struct(*[F.col(c) for c in docs.columns]).alias("row")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id (then text hash)."""
    content = F.xxhash64("text").alias("content")
    found = simhash.near_duplicates(docs, more=[content])
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "content")).alias("first")).select("first.*")
    rows = docs.select(_whole(docs), F.col("doc_id").alias("id"), content)
    same = rows["id"].eqNullSafe(first["doc_id"]) & (rows["content"] == first["content"])
    return rows.join(first, same, "left_semi").dropDuplicates(["id", "content"]).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; equal texts are judged alike, null texts stay."""
    texts = docs.select(F.md5(F.col("text").cast("binary")).alias("key"), "text")
    hit = D.decontaminate(texts, table(spark, sf_dir, "benchmark"), id_col="key").filter("contaminated").select("key").distinct()
    return docs.select(_whole(docs), F.md5(F.col("text").cast("binary")).alias("key")).join(hit, "key", "left_anti").select("row.*")


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks."""
    return personal.redact(personal.find_personal(docs), count_col="n_chars" if "n_chars" in docs.columns else None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with sequence and offset."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between stages the table is written to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
