"""Hard negatives by exact integer inner products, several candidates to one multiplication.

Components are whole numbers (``floor(256 * x)``). Kronecker packing: the components of several candidates, made
positive by a bias, are put into separated fields of one wide integer, so one multiplication by an anchor's
(biased) component multiplies all of them, and the sum over the components holds every candidate's product
sum in its own field. The bias is taken off exactly with the sums of the components. A field is as wide as the
largest sum that the data allow; the wide integers are held in doubles, whose 53 bits are
exact, so the multiplications of a block are one matrix product. Where not even one field fits into
53 bits (components of many thousands), the wide integer is a Python integer of any width.

1. Rows that take part are written once with whole components. Anchors are dealt into blocks of at most ``ANCHOR_BYTES``; per
   block the anchors are broadcast (their size is known), every task passes its rows by them and keeps, per
   anchor, only what the result can need; the tasks' findings are merged by a window per anchor
   and written, then the next block follows. No pair of rows is ever shuffled.
2. First pass: the best ``positives`` rows of an anchor's own label. A task multiplies rows and anchors of equal
   labels only. Second pass: for every (anchor, positive) the best rows of other labels whose score is within
   [``share`` of the positive's score, the positive's score], compared in whole numbers.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; a shorter
vector ends in zeros; repeated ids are rows of their own (an anchor row is left out of its own positives, its
copies are not; ties of score and id are interchangeable); a positive score below zero has no negatives (80 % of it
is more than it); an empty table or one without anchors gives an empty result; other columns are ignored. A score
beyond 63 bits ends the job with an error, and whole components beyond 63 bits are not distinguished.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import cut

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
SHARE = 80  # percent
ANCHOR_BYTES = 32 << 20
ROWS_AT_ONCE = 2048
ANCHORS_AT_ONCE = 1024
EXACT_BITS = 53


# --- packed products -------------------------------------------------------------------------------
def fields(width: int, low: int, high: int) -> tuple[int, int]:
    """(bits of a field, fields of one wide integer) for vectors of ``width`` components from ``low`` to ``high``."""
    bits = max(1, (width * (high - low) ** 2).bit_length())
    return bits, EXACT_BITS // bits


class Packed:
    """Candidates' components in wide integers: ``products`` gives all exact scores of some anchors."""

    def __init__(self, rows: np.ndarray, low: int, high: int):
        self.n, self.width = rows.shape
        self.low = low
        self.bits, self.per = fields(self.width, low, high)
        self.wide = self.per == 0
        if self.wide:
            biased, self.per = rows.astype(object) - low, self.n
            self.integers = [sum(int(c) << (self.bits * t) for t, c in enumerate(column)) for column in biased.T]
        else:
            biased = rows - low
            padded = np.concatenate((biased, np.zeros((-self.n % self.per, self.width), "i8"))).reshape(-1, self.per, self.width)
            self.integers = (padded << (self.bits * np.arange(self.per))[None, :, None]).sum(axis=1).astype("f8")
        self.sums = biased.sum(axis=1)

    def products(self, anchors: np.ndarray) -> np.ndarray:
        """Scores, anchors by candidates: the fields hold the sums of (x - low)(a - low), and
        xa = (x - low)(a - low) + low (x - low) + low (a - low) + low^2."""
        biased = anchors.astype(object) - self.low if self.wide else anchors - self.low
        mask = (1 << self.bits) - 1
        if self.wide:
            out = np.empty((len(anchors), self.n), object)
            for i, a in enumerate(biased):
                total = sum(int(c) * w for c, w in zip(a, self.integers))
                out[i] = [(total >> (self.bits * t)) & mask for t in range(self.n)]
        else:
            total = (biased.astype("f8") @ self.integers.T).astype("i8")
            out = np.empty((len(anchors), len(self.integers) * self.per), "i8")
            for t in range(self.per):
                out[:, t :: self.per] = (total >> (self.bits * t)) & mask
            out = out[:, : self.n]
        return out + self.low * self.sums[None, :] + self.low * biased.sum(axis=1)[:, None] + self.width * self.low * self.low


def _best(score: np.ndarray, ident: np.ndarray, group: np.ndarray, keep: int) -> np.ndarray:
    """Indices of the first ``keep`` rows of every group: higher scores first, ties by smaller id."""
    order = np.lexsort((ident, -score, group))
    g = group[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, "i8")
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[rank < keep]


class _Kept:
    """The best rows per group seen so far, cut back whenever they have doubled."""

    def __init__(self, keep: int, groups: int):
        self.keep, self.limit = keep, max(2 * keep * groups, 100_000)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, group, score, ident) -> None:
        if len(group):
            self.parts.append((group, score, ident))
            self.size += len(group)
            if self.size > self.limit:
                self.parts = [self.settled()]
                self.size = len(self.parts[0][0])

    def settled(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")
        group, score, ident = (np.concatenate([p[j] for p in self.parts]) for j in range(3))
        at = _best(score, ident, group, self.keep)
        return group[at], score[at], ident[at]


# --- rows ------------------------------------------------------------------------------------------
def whole_rows(rows: DataFrame, label: Column | None, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """The rows that take part: row (a name for each), id, label, comps (array<bigint>)."""
    vec = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vec.isNotNull() & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.filter(F.coalesce(fine, F.lit(False)))
    comps = F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE))
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                       (F.col(label_col) if label is None else label).cast("long").alias("label"), comps.alias("comps"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), "i8")
    if len(lists):
        sizes = np.diff(np.asarray(lists.offsets))
        values = np.asarray(lists.flatten())
        at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(np.arange(len(lists)), sizes), at] = values
    return out


def _blocks_of(anchors: DataFrame, width: int):
    """The anchors in blocks of at most ANCHOR_BYTES, one after the other, each as a table on the driver."""
    per = max(1, ANCHOR_BYTES // (8 * max(width, 1) + 64))
    n = anchors.count()
    parts = -(-4 * n // (3 * per)) if n > per else 1
    for p in range(parts):
        block = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(parts)) == p).toArrow().combine_chunks()
        for at in range(0, block.num_rows, per):
            yield block.slice(at, per)


def _scan(rows: DataFrame, anchors: dict, keep: int, groups: int, width: int, low: int, high: int, pick) -> DataFrame:
    """(group, score, id) of what ``pick`` finds for the anchors in every task's rows, the best ``keep`` per group."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        held, kept = sent.value, _Kept(keep, groups)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids, labels, names = (np.asarray(part.column(c)).astype("i8") for c in ("id", "label", "row"))
                pick(held, kept, ids, labels, names, _matrix(part.column("comps"), width), low, high)
        group, score, ident = kept.settled()
        yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(score, pa.int64()), pa.array(ident, pa.int64())], ["group", "score", "id"])

    found = rows.mapInArrow(run, "group long, score long, id long")
    w = Window.partitionBy("group").orderBy(F.desc("score"), "id")
    out = cut(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep))
    sent.destroy()
    return out


def _same_label(held, kept, ids, labels, names, comps, low, high) -> None:
    for label in np.unique(labels):
        mine = np.flatnonzero(held["label"] == label)
        at = np.flatnonzero(labels == label)
        if not len(mine):
            continue
        packed = Packed(comps[at], low, high)
        for s in range(0, len(mine), ANCHORS_AT_ONCE):
            anchors = mine[s : s + ANCHORS_AT_ONCE]
            score = packed.products(held["comps"][anchors])
            other = held["row"][anchors][:, None] != names[at][None, :]
            keep = held["keep"]
            if len(at) > keep + 1 and score.dtype != object:
                # all that reach the score of the keep-th best of this block (an anchor itself may be among them)
                floor = -np.partition(-score, keep, axis=1)[:, keep : keep + 1]
                other &= score >= floor
            i, j = np.nonzero(other)
            kept.add(anchors[i], score[i, j].astype("i8"), ids[at][j])


def _within(held, kept, ids, labels, names, comps, low, high) -> None:
    packed = Packed(comps, low, high)
    for s in range(0, len(held["label"]), ANCHORS_AT_ONCE):
        anchors = np.arange(s, min(s + ANCHORS_AT_ONCE, len(held["label"])))
        score = packed.products(held["comps"][anchors])
        goals = held["goals"][anchors]  # positive scores, highest first; the rest is filled with held["none"]
        real = goals != held["none"]
        last = np.where(real, goals, goals[:, :1]).min(axis=1)
        near = (score * 100 >= SHARE * last[:, None]) & (score <= goals[:, :1]) & real[:, :1] & (held["label"][anchors][:, None] != labels[None, :])
        i, j = np.nonzero(near)
        if not len(i):
            continue
        value, ident = score[i, j].astype("i8"), ids[j]
        for k in range(goals.shape[1]):
            goal = goals[i, k]
            hit = real[i, k] & (100 * value >= SHARE * goal) & (value <= goal)
            kept.add(anchors[i[hit]] * goals.shape[1] + k, value[hit], ident[hit])


def hard_negatives(rows: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Per anchor row (where ``anchor`` holds, a condition on column ``id``) and positive: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score. ``label`` replaces the label column."""
    spark = rows.sparkSession
    held = cut(whole_rows(rows, label, id_col, vec_col, label_col))
    width, low, high = held.agg(F.coalesce(F.max(F.size("comps")), F.lit(0)), F.coalesce(F.min(F.array_min("comps")), F.lit(0)),
                                F.coalesce(F.max(F.array_max("comps")), F.lit(0))).first()
    low, high = min(low, 0), max(high, 0)  # zeros end shorter vectors
    out = []
    for block in _blocks_of(held.filter(anchor), width):
        n = block.num_rows
        if not n:
            continue
        comps = _matrix(block.column("comps").combine_chunks(), width)
        own = {"label": np.asarray(block.column("label")), "row": np.asarray(block.column("row")), "comps": comps, "keep": positives}
        first = _scan(held, own, positives, n, width, low, high, _same_label)
        found = first.toPandas()  # at most ``positives`` rows per anchor of the block
        none = np.iinfo("i8").min
        goals = np.full((n, positives), none, "i8")
        goals[found["group"], found["rank"] - 1] = found["score"]
        second = _scan(held, own | {"goals": goals, "none": none}, negatives, n * positives, width, low, high, _within)
        names = spark.createDataFrame(pd.DataFrame({"group": found["group"] * positives + found["rank"] - 1, "positive_score": found["score"],
                                                    "positive_id": found["id"], "anchor_id": np.asarray(block.column("id"))[found["group"]]}).astype("int64"),
                                      "group long, positive_score long, positive_id long, anchor_id long")
        out.append(second.join(F.broadcast(names), "group").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def oracle_sql() -> str:
    """The registered query in DuckDB: all scores of the anchors, then two rankings."""
    return """
WITH r AS (SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS comps
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.comps, b.comps) AS BIGINT) AS score
      FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS k
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, CAST(k AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 5"""
