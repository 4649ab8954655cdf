"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (``DIM`` places, from a fixed seed). An n-gram of
three symbols is the product of its letters' vectors, the first two moved round by two and one
places (permute and bind); a text is the sum of its n-grams' vectors (bundle), a language the sum
over its training texts, each weighted to length one so that long texts don't drown the others. A
text gets the language whose prototype has the largest cosine to it.

Symbols are lower-cased letters and the gap between words (n-grams with the gap inside are left
out). The sum over n-grams is counts times n-gram vectors, made per block of texts from the letter
vectors, so nothing grows with the vocabulary. Training adds up one vector per language in each
task; Spark sums them (languages x DIM numbers reach the driver, at most ``MAX_LANGUAGES``).

Defined cases: null text or text without a letter gets ``und`` with score 0, as does everything
if there is no training row; ties go to the language first in order; the score is the cosine,
0 at least. Training rows are those with a text and a language whose crc32(id) mod 4 is not 2;
a null id counts as not held out. Repeated rows are judged each by itself.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 512
SYMBOLS = 128
SEED = 7
BLOCK_TEXTS = 256
BLOCK_CHARS = 1_000_000
MAX_LANGUAGES = 2000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _symbol_of() -> np.ndarray:
    """Code point -> symbol: 1 to 26 for a to z, 27 and on for other letters (some share one), else 0."""
    table = np.zeros(0x110000, "u1")
    for cp in range(0x110000):
        if unicodedata.category(chr(cp))[0] == "L":
            table[cp] = 27 + cp % (SYMBOLS - 27)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, DIM)).astype("i1") * 2 - 1


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Vectors (int8) of n-gram codes: permuted letter vectors bound by multiplication."""
    letters = _letters()
    a, b, c = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram codes of some texts, and (text, place among the codes, count) of what they hold."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    symbols = _symbol_of()[points].astype("i8")
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower])
    kept = (symbols != 0) | (np.concatenate(([1], symbols[:-1])) != 0)
    symbols, owner = np.concatenate(([0], symbols[kept], [0])), np.concatenate(([0], owner[kept], [0]))
    middle = np.flatnonzero(symbols[1:-1]) + 1
    codes = (symbols[middle - 1] * SYMBOLS + symbols[middle]) * SYMBOLS + symbols[middle + 1]
    place = np.zeros(SYMBOLS**3, "i8")
    place[codes] = 1
    known = np.flatnonzero(place)
    place[known] = np.arange(len(known))
    cells = np.bincount(owner[middle] * len(known) + place[codes], minlength=0)
    held = np.flatnonzero(cells)
    return known, held // max(1, len(known)), held % max(1, len(known)), cells[held].astype("f4")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        at = total = 0
        for i, t in enumerate(texts):
            total += len(t)
            if total >= BLOCK_CHARS or i + 1 - at >= BLOCK_TEXTS or i == len(texts) - 1:
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, total = i + 1, 0


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, scaled to length one."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch, texts in _blocks(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            known, owner, place, count = gram_counts(texts)
            if not len(known):
                continue
            vectors = gram_vectors(known)
            weight = count / np.sqrt(np.bincount(owner, count * count, len(texts)))[owner]
            for lang in set(langs):
                of = langs[owner] == lang
                total = np.bincount(place[of], weight[of], len(known)) @ vectors
                sums[lang] = sums.get(lang, 0) + total
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], ["lang", "vector"])

    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
    parts = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    got = sorted((r["lang"], [x["x"] for x in r["v"]]) for r in found.limit(MAX_LANGUAGES + 1).collect())
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    protos = np.array([v for _, v in got]).reshape(len(got), DIM)
    return [k for k, _ in got], protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: row (all its columns), lang_pred, score."""
    names, protos = model
    protos = protos.T.astype("f4")

    def run(texts: list[str]) -> tuple[list[str], list[float]]:
        known, owner, place, count = gram_counts(texts)
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not len(known) or not names:
            return langs, scores
        vectors = gram_vectors(known)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if a == b:
                continue
            bundle = count[a:b] @ vectors[place[a:b]].astype("f4")
            cosines = bundle @ protos / max(float(np.linalg.norm(bundle)), 1e-12)
            best = int(np.argmax(cosines))
            langs[i], scores[i] = names[best], min(1.0, max(0.0, float(cosines[best])))
        return langs, scores

    def whole(batches):
        for batch, texts in _blocks(batches):
            langs, scores = run(texts)
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in rest), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*rest, "lang_pred", "score"])

    # all columns of docs ride along in a struct, so their names can't clash
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return packed.mapInArrow(whole, schema)
