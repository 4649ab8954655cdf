"""Best-fit packing by minimum bin slack: documents into as few sequences as possible.

1. ``tokenise``: each document becomes its token ids plus an end id, cut into pieces of at most
   ``capacity`` tokens (only longer documents are cut). Ids are computed per white-space chunk with
   a bounded cache; the vocabulary's pre-tokens never span white space, so joining the chunks' ids
   equals encoding the text at once (tested). The pieces are written once (``cut``).
2. ``plan_bins``: only the histogram of piece lengths (at most ``capacity`` rows, whatever the
   input) goes to the driver. Per bin, the longest piece left is taken and a subset-sum over the
   lengths left, one bit per reachable fill, finds the fullest feasible combination; the bin is
   repeated as often as the counts allow and removed. A plan is a few thousand patterns at any size.
3. Pieces of one length are interchangeable: each gets its rank within its length (counted in
   salted buckets, so a hot length is not one task) and the rank gives the bin and the offset.

Defined cases: null or empty text is the end id alone (one piece of length 1); repeated rows are
packed once each; null ids are ordinary; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import cut

CAPACITY = 2048
CACHE_CHUNKS = 600_000
ROWS_PER_BUCKET = 200_000


class ChunkIds(dict):
    """White-space chunk (bytes) -> little-endian uint32 ids; emptied when it holds too many.

    A chunk of Latin letters, digits and ASCII signs is put together from its pre-tokens (runs of letters, single
    digits, runs of signs), which the normaliser only lower-cases: these go to the tokenizer's model at once, each
    of them once, whatever signs stand beside it. Chunks with an apostrophe (contractions), a "<" (special tokens) or
    any other sign take the whole tokenizer.
    """

    PRE_TOKENS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(plain)]
        self.byte_letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _model_ids(self, piece: bytes) -> bytes:
        if piece.isascii():
            word = piece.lower().decode()
        else:
            word = piece.decode().lower().encode().decode("latin-1").translate(self.byte_letters)
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(word)])

    def __missing__(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters only
            data = self._model_ids(chunk)
        elif chunk[:-1].isalpha() and chunk[-1:] in (b",", b"."):
            data = self[chunk[:-1]] + self[chunk[-1:]]
        elif (pieces := self.PRE_TOKENS.findall(chunk)) == [chunk]:
            data = self._model_ids(chunk)
        elif b"".join(pieces) == chunk:
            data = b"".join([self[p] for p in pieces])
        else:
            data = np.array(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        self[chunk] = data
        return data


def lowered(text: bytes) -> bytes:
    """The text in lower case where the normaliser gives the same ids for it: in Latin-1 there is nothing to compose
    before it lower-cases. A "<|" may begin a special token, which is looked for before that."""
    if b"<|" in text:
        return text
    if text.isascii():
        return text.lower()
    letters = text.decode()
    try:
        letters.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return letters.lower().encode()


def _tokeniser(path: str, capacity: int, end_id: int, keep_ids: bool):
    width = 4 * capacity
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ChunkIds(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys = part.column(0)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                rows: list[int] = []
                out: list[tuple] = []
                for i, text in enumerate(texts):
                    data = b"".join([ids[c] for c in lowered(text).split()]) + end if text else end
                    for k, a in enumerate(range(0, len(data), width)):
                        piece = data[a : a + width]
                        rows.append(i)
                        out.append((k, a // 4, len(piece) // 4, zlib.crc32(piece), piece))
                columns = [keys.take(pa.array(rows, pa.int64()))]
                columns += [pa.array([o[0] for o in out], pa.int32())]
                columns += [pa.array([o[j] for o in out], pa.int64()) for j in (1, 2, 3)]
                names = [batch.schema.names[0], "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(o[4], "<u4").astype("i4") for o in out], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def tokenise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
             capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32 (and ids)."""
    fields = [
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return docs.select(id_col, text_col).mapInArrow(_tokeniser(path, capacity, end_id, keep_ids), T.StructType(fields))


def fullest(available: list[tuple[int, int]], room: int) -> dict[int, int]:
    """Uses per length of the fullest combination within ``room``; ``available``: (length, count),
    long lengths first, which are preferred among equally full combinations."""
    reach, stages = 1, []
    mask = (1 << (room + 1)) - 1
    for length, count in available:
        left, step = min(count, room // length), 1
        while left > 0:
            take = min(step, left)
            stages.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    fill, uses = reach.bit_length() - 1, {}
    for length, take, before in reversed(stages):
        if not before >> fill & 1:
            uses[length] = uses.get(length, 0) + take
            fill -= length * take
    return uses


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """Patterns (first bin, number of bins, uses per length) that use up ``counts``."""
    left = {length: n for length, n in counts.items() if n > 0}
    patterns, bins = [], 0
    while left:
        order = sorted(left, reverse=True)
        seed = order[0]
        available = [(x, left[x] - (x == seed)) for x in order]
        uses = fullest(available, capacity - seed)
        uses[seed] = uses.get(seed, 0) + 1
        times = min(left[x] // u for x, u in uses.items())
        for x, u in uses.items():
            left[x] -= u * times
            if not left[x]:
                del left[x]
        patterns.append((bins, times, uses))
        bins += times
    return patterns


def _placer(patterns: list[tuple[int, int, dict[int, int]]]):
    """Adds sequence_id and offset from (length, rank): binary search in the intervals of ranks."""
    at: dict[int, int] = {}
    rows = []
    for first, times, uses in patterns:
        offset = 0
        for length in sorted(uses, reverse=True):
            u = uses[length]
            rows.append((length, at.get(length, 0), first, u, offset))
            at[length] = at.get(length, 0) + u * times
            offset += u * length
    rows.sort()
    plan = np.array(rows, "i8").reshape(-1, 5)
    lengths, starts = np.unique(plan[:, 0], return_index=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("rank"))
            row = np.empty(len(length), "i8")
            for x in np.unique(length):
                k = np.searchsorted(lengths, x)
                lo = starts[k]
                hi = starts[k + 1] if k + 1 < len(starts) else len(plan)
                here = length == x
                row[here] = lo + np.searchsorted(plan[lo:hi, 1], rank[here], side="right") - 1
            nth = rank - plan[row, 1]
            seq = plan[row, 2] + nth // plan[row, 3]
            offset = plan[row, 4] + (nth % plan[row, 3]) * length
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in keep] + [pa.array(seq), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and the offset they are packed at."""
    pieces = cut(tokenise(docs, path, id_col, text_col, capacity, end_id, keep_ids))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    buckets = max(1, -(-sum(counts.values()) // ROWS_PER_BUCKET))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "_bucket").count().select(
        "length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_bucket").orderBy(id_col, "piece", "ids_crc32")
    ranked = keyed.withColumn("_nth", F.row_number().over(within) - 1).join(starts, ["length", "_bucket"])
    named = ranked.select(*pieces.columns, (F.col("_first") + F.col("_nth")).alias("rank"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return named.mapInArrow(_placer(plan_bins(counts, capacity)), schema)
