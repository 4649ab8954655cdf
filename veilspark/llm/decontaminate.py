"""Benchmark decontamination: a prefix-filtered set join of document words with item windows.

A window is ``size`` consecutive item words (an item with fewer words is one window). A document
holds a window only if it holds every shingle (up to three words) of it, so one necessary shingle
per window, the rarest in the corpus, is enough to find all candidates (prefix filter for
containment 1):

1. windows and their shingles are made from the items; how often each item shingle occurs in the
   corpus is counted over all documents (counts are summed in the task before the shuffle);
   windows with a shingle that never occurs are dropped;
2. the rarest shingle of each window is its prefix. Documents are scanned once more; places whose
   shingle hash is in a bit table of the prefixes (at most ``FILTER_BITS`` bits, whatever the
   benchmark) go on with the words around them;
3. these join the windows by shingle hash; the position of the shingle in the window gives the
   start, which must lie in the document with room for the whole window (positional and length
   bounds), and the words must equal the window's (exact check);
4. hit words of a document are the union of its windows' ranges.

Rows keep their identity by a row number given after the scan was written (``cut``), so repeated
rows and repeated or null ids are judged each by itself. Null text and texts without words give
n_words 0 and no hits; items without words have no windows; a null item id is not listed; an empty
benchmark leaves every document clean; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import cut

WINDOW = 10
SHINGLE = 3
FILTER_BITS = 1 << 26
BLOCK_BYTES = 2_000_000

#: Byte -> lower-cased byte of a word, or 0 for a byte between words.
WORD_BYTE = np.zeros(256, "u1")
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        WORD_BYTE[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        WORD_BYTE[_b] = _b + 32
POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, "u8"), dtype="u8")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """Words of some texts: ``doc`` (text number), ``starts``, ``ends`` in ``data``, and hashes."""

    def __init__(self, texts: list[bytes]):
        self.data = WORD_BYTE[np.frombuffer(b"\x00".join(texts), "u1")]
        inside = self.data != 0
        edge = np.diff(inside.astype("i1"), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.doc = np.searchsorted(firsts, self.starts, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # first word of each text
        if len(self.starts):
            at = np.flatnonzero(inside)
            place = at - np.repeat(self.starts, self.ends - self.starts)
            part = self.data[at].astype("u8") * POWERS[place & (len(POWERS) - 1)]
            heads = np.cumsum(self.ends - self.starts) - (self.ends - self.starts)
            self.hash = _mix(np.add.reduceat(part, heads))
        else:
            self.hash = np.zeros(0, "u8")

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the first words of all ``k``-word shingles, and the shingles' hashes."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, "i8"), np.zeros(0, "u8")
        h = np.full(n, k, "u8")
        for j in range(k):
            h = _mix(h * np.uint64(0x94D049BB133111EB) + self.hash[j : j + n])
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, h[at]

    def text(self, i: int, j: int) -> list[str]:
        return [self.data[a:b].tobytes().decode() for a, b in zip(self.starts[i:j], self.ends[i:j])]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Parts of the batches with about BLOCK_BYTES of text, and their words."""
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        at = total = 0
        for i, t in enumerate(texts):
            total += len(t)
            if total >= BLOCK_BYTES or i == len(texts) - 1:
                yield batch.slice(at, i + 1 - at), Words(texts[at : i + 1])
                at, total = i + 1, 0


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """item, words, n, and shingles (hash, place) of every window."""

    def run(batches):
        for batch, words in _blocks(batches):
            ids, out = batch.column("item").to_pylist(), []
            grams = {}
            for k in range(1, SHINGLE + 1):
                at, h = words.shingles(k)
                grams[k] = dict(zip(at.tolist(), h.view("i8").tolist()))
            for i, item in enumerate(ids):
                a, b = words.first[i], words.first[i + 1]
                n = min(size, b - a)
                k = min(SHINGLE, n)
                for s in range(a, b - n + 1) if n else ():
                    out.append({"item": item, "n": n, "words": words.text(s, s + n),
                                "shingles": [{"hash": grams[k][s + j], "place": j} for j in range(n - k + 1)]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    schema = T.StructType([
        T.StructField("item", T.StringType()), T.StructField("n", T.IntegerType()),
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("shingles", T.ArrayType(T.StructType([
            T.StructField("hash", T.LongType()), T.StructField("place", T.IntegerType())]))),
    ])
    arrow = pa.schema([("item", pa.string()), ("n", pa.int32()), ("words", pa.list_(pa.string())),
                       ("shingles", pa.list_(pa.struct([("hash", pa.int64()), ("place", pa.int32())])))])
    return items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def bit_table(hashes: DataFrame, col: str) -> np.ndarray:
    """Two bits of each hash in 256 bits a hash, FILTER_BITS at most; a fuller table only lets more places pass."""
    n = hashes.count()
    bits = min(FILTER_BITS, 1 << max(10, (256 * n).bit_length()))
    low, high = F.col(col).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(F.col(col), 32).bitwiseAND(F.lit(bits - 1))
    places = hashes.select(F.explode(F.array(low, high)).alias("place"))
    words = places.select(F.shiftright("place", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(place & 63L as int))").alias("bit"))
    table = np.zeros(bits // 64, "u8")
    got = words.groupBy("word").agg(F.bit_or("bit").alias("value")).toArrow()  # bits / 64 rows at most
    table[got["word"].to_numpy()] = got["value"].to_numpy().view("u8")
    return table


def _in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    def bit(place: np.ndarray) -> np.ndarray:
        place = place & np.uint64(len(table) * 64 - 1)
        return (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0

    found = bit(hashes)
    found[found] = bit(hashes[found] >> np.uint64(32))
    return found


def shingle_counts(docs: DataFrame, text_col: str, table, lengths: list[int]) -> DataFrame:
    """How often each shingle in the bit table occurs: (hash, n), summed within the tasks first."""

    def run(batches):
        for _, words in _blocks(batches):
            found = [h[_in_table(table.value, h)] for k in lengths for h in (words.shingles(k)[1],)]
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view("i8")), pa.array(n)], ["hash", "n"])

    return (docs.select(F.col(text_col).alias("text")).mapInArrow(run, "hash long, n long")
            .groupBy("hash").agg(F.sum("n").alias("n")))


def candidates(docs: DataFrame, id_col: str, text_col: str, table, lengths: list[int], size: int) -> DataFrame:
    """Per document: id, n_words, and the places of prefix shingles with the words around them."""
    place_type = pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("around", pa.list_(pa.string()))])

    def run(batches):
        for batch, words in _blocks(batches):
            places: list[list] = [[] for _ in range(batch.num_rows)]
            for k in lengths:
                at, h = words.shingles(k)
                hit = _in_table(table.value, h)
                for p, x in zip(at[hit].tolist(), h[hit].view("i8").tolist()):
                    d = words.doc[p]
                    a, b = max(words.first[d], p - size + 1), min(words.first[d + 1], p + size)
                    places[d].append({"hash": x, "at": p - words.first[d], "before": p - a, "around": words.text(a, b)})
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(words.first)), pa.array(places, pa.list_(place_type))], ["id", "n_words", "places"])

    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("places", T.ArrayType(T.StructType([
            T.StructField("hash", T.LongType()), T.StructField("at", T.IntegerType()),
            T.StructField("before", T.IntegerType()), T.StructField("around", T.ArrayType(T.StringType()))]))),
    ])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def prefix_windows(docs: DataFrame, text_col: str, windows: DataFrame) -> DataFrame:
    """Windows that may occur, each with its rarest shingle: hash, place, item, n, words."""
    sc = docs.sparkSession.sparkContext
    shingles = windows.select("item", "n", "words", F.inline("shingles"))
    lengths = _lengths(windows)
    if not lengths:
        return shingles.select("hash", "place", "item", "n", "words")
    counts = shingle_counts(docs, text_col, sc.broadcast(bit_table(shingles.select("hash").distinct(), "hash")), lengths)
    known = cut(shingles.join(counts.withColumnRenamed("n", "often"), "hash", "left"))
    rarest = F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "hash", "place"))
    best = known.groupBy("item", "n", "words").agg(rarest.alias("best")).filter("best.often > 0")
    return cut(best.select("best.hash", "best.place", "item", "n", "words"))


def _lengths(windows: DataFrame) -> list[int]:
    return sorted(r[0] for r in windows.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect())


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, n_items, items (sorted strings), contaminated."""
    sc = docs.sparkSession.sparkContext
    windows = cut(item_windows(items, item_col, item_text_col, size))
    prefixes = prefix_windows(docs, text_col, windows)
    table = sc.broadcast(bit_table(prefixes.select("hash").distinct(), "hash"))
    rows = cut(candidates(docs, id_col, text_col, table, _lengths(prefixes), size))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    found = (
        rows.filter(F.size("places") > 0).select("row", "n_words", F.inline("places")).join(prefixes, "hash")
        .withColumn("start", F.col("at") - F.col("place"))
        .filter("start >= 0 and start + n <= n_words and place <= before")
        .filter("slice(around, before - place + 1, n) = words")
        .select("row", "start", (F.col("start") + F.col("n")).alias("stop"), "item")
    )
    before = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))))
    hits = found.withColumn("new", new).groupBy("row").agg(
        F.sum("new").cast("long").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    return rows.drop("places").join(hits, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def oracle_sql() -> str:
    """The same result from plain window matching in DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS g
        FROM (SELECT item, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
              FROM (SELECT item, w, least({WINDOW}, len(w)) AS n FROM iw WHERE len(w) > 0) a) b),
dg AS (SELECT r, n, i, list_slice(w, i, i + n - 1) AS g
       FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM win) k WHERE len(w) >= n) c),
hit AS (SELECT r, i, dg.n, item FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) h GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos ON dw.r = pos.r LEFT JOIN its ON dw.r = its.r
"""
