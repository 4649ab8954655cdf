"""Quality rules with an isolation forest on rule statistics.

Every document gets rule statistics (counts first, then ratios that don't depend on its length).
The forest is fitted on a bounded sample: the ``SAMPLE`` documents with the smallest hash of id and
text, ``TREES`` trees of ``PER_TREE`` of them each, split at random values of random statistics. A
document's score is 2 ** (-mean path length / expected path length); documents that random splits
set apart early score high. Scores of all labelled documents are counted in ``BINS`` bins by
label, and the threshold is the bin edge with the largest difference between the share of bad
documents above it and ``KEEP_WEIGHT`` times the share of good ones above it.

Base rules come first: fewer than 50 words, or more than half of the words in repeated windows of
three words, fail; the forest judges the rest.

Defined cases: null text is an empty one (no words: fails the base rule); repeated rows and ids are
judged each by itself, a label counts for every row with its id; null ids have no label; without
labels of both kinds nothing is rejected beyond the base rules; empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import cut

SAMPLE = 8192
TREES = 128
PER_TREE = 256
BINS = 500
KEEP_WEIGHT = 4.0
SEED = 11
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["word_length", "symbols", "dup_lines", "repeats", "capitals", "marks", "line_ends", "lone_signs"]
_SPACE = b" \t\n\r\x0b\x0c"
_ASCII_CAPITALS = bytes(range(65, 91))
_MARKS = b"!?.,;:'\"-()[]{}/\\_=+~^@`"
_CONTINUED = bytes(range(0x80, 0xC0))


def _count(text: bytes, some: bytes) -> int:
    return len(text) - len(text.translate(None, some))


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that occur twice or more in the text."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    n, covered = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + 3 - max(i, covered)
            covered = i + 3
    return n


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """(COUNTS, RATIOS) of one text."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = len(text) - _count(text, _SPACE) - _count(text, _CONTINUED)
    symbols = _count(text, SYMBOLS)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dups = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    counts = [n, chars, symbols, dups, repeats]
    w, c, m = max(n, 1), max(chars, 1), max(len(lines), 1)
    capitals = _count(text, _ASCII_CAPITALS)
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines)
    lone = sum(1 for x in words if len(x) == 1 and not x.isalnum())
    ratios = [chars / w, symbols / w, dups / m, repeats / w, capitals / c, _count(text, _MARKS) / w,
              ends / m, lone / w]
    return counts, ratios


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, a hash of id and text, COUNTS and the array ``ratios``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [statistics(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([g[0][k] for g in got], pa.int64()) for k in range(len(COUNTS))]
            ratios = pa.array([g[1] for g in got], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), *columns, ratios], ["id", "hash", *COUNTS, "ratios"])

    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("hash", T.LongType()),
        *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("ratios", T.ArrayType(T.DoubleType()))])
    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("hash"), F.col(text_col).cast("binary").alias("text"),
    ).mapInArrow(run, schema)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _grow(points: np.ndarray, depth: int, limit: int, rng: np.random.Generator, nodes: list[list[float]]) -> int:
    """Adds the tree of ``points`` to ``nodes`` [statistic, split, left, right, path length]; its root's number."""
    me = len(nodes)
    nodes.append([-1, 0, me, me, depth + _expected(len(points))])
    low, high = points.min(axis=0), points.max(axis=0)
    varying = np.flatnonzero(high > low)
    if depth < limit and len(points) > 1 and len(varying):
        k = int(rng.choice(varying))
        at = rng.uniform(low[k], high[k])
        left = points[:, k] < at
        if left.any() and not left.all():
            a = _grow(points[left], depth + 1, limit, rng, nodes)
            b = _grow(points[~left], depth + 1, limit, rng, nodes)
            nodes[me] = [k, at, a, b, 0]
    return me


def fit_forest(sample: np.ndarray) -> list[np.ndarray]:
    """TREES trees, each an array with a row per node."""
    rng, trees = np.random.default_rng(SEED), []
    for _ in range(TREES if len(sample) else 0):
        points = sample[rng.choice(len(sample), min(PER_TREE, len(sample)), replace=False)]
        nodes: list[list[float]] = []
        _grow(points, 0, max(1, int(np.ceil(np.log2(len(points) + 1)))), rng, nodes)
        trees.append(np.array(nodes))
    return trees


def anomaly(trees: list[np.ndarray], size: int, x: np.ndarray) -> np.ndarray:
    """Scores in (0, 1) of the rows of ``x``."""
    total = np.zeros(len(x))
    for t in trees:
        at = np.zeros(len(x), "i8")
        rows = np.arange(len(x))
        while True:
            node = t[at]
            inner = node[:, 0] >= 0
            if not inner.any():
                break
            k = np.where(inner, node[:, 0], 0).astype("i8")
            at = np.where(inner, np.where(x[rows, k] < node[:, 1], node[:, 2], node[:, 3]), at).astype("i8")
        total += t[at, 4]
    return 2.0 ** (-total / max(1, len(trees)) / max(_expected(min(size, PER_TREE)), 1e-9))


def draw(stats: DataFrame) -> np.ndarray:
    """Ratios of the SAMPLE documents with the smallest hashes; the hash limit keeps what tasks send to about as many."""
    pool = stats.filter("n_words >= 50")
    share = min(1.0, 1.25 * SAMPLE / max(1, pool.count()))
    low = pool.filter(F.col("hash") <= int(-(2**63) + share * (2**64 - 2048)))
    got = low.orderBy("hash", "ratios").select("ratios").limit(SAMPLE).collect()
    return np.array([r["ratios"] for r in got]).reshape(-1, len(RATIOS))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> DataFrame:
    """Per row: id, COUNTS, score, base_failed, kept."""
    stats = cut(measure(docs, id_col, text_col))
    sample = draw(stats)
    trees, size = fit_forest(sample), len(sample)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("ratios").to_pylist()).reshape(-1, len(RATIOS))
            rest = [n for n in batch.schema.names if n not in ("ratios", "hash")]
            score = anomaly(trees, size, x) if trees else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(score)], [*rest, "score"])

    schema = T.StructType([f for f in stats.schema.fields if f.name not in ("ratios", "hash")] + [T.StructField("score", T.DoubleType())])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = cut(stats.mapInArrow(run, schema).withColumn("base_failed", failed))
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna()
    bins = scored.filter(~F.col("base_failed")).join(named, "id").groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin"), "label").count()
    threshold = calibrate([tuple(r) for r in bins.filter("label in (0, 1)").collect()])  # BINS x 2 rows at most
    return scored.select(
        F.col("id").alias(id_col), *COUNTS, "score", "base_failed",
        (~F.col("base_failed") & (F.col("score") < threshold)).alias("kept"))


def calibrate(bins: list[tuple[int, int, int]]) -> float:
    """The score from which documents are rejected, from counts (bin, label, documents); 2 if none."""
    counts = np.zeros((BINS + 2, 2))
    for b, label, n in bins:
        counts[b, label] += n
    total = counts.sum(axis=0)
    if not total.all():
        return 2.0
    above = counts[::-1].cumsum(axis=0)[::-1] / total
    gain = above[:, 0] - KEEP_WEIGHT * above[:, 1]
    best = int(np.argmax(gain))
    return best / BINS if gain[best] > 0 else 2.0
