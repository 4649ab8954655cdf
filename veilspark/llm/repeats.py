"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Every byte that a ``LENGTH``-byte string covers which also starts anywhere else is removed. Strings of
that length are called windows here.

1. Narrowing. A window's anchor is the smallest hash among its ``GRAM``-byte pieces; equal windows have
   equal anchors, so only windows of one anchor need comparing. Consecutive windows with the same
   anchor form a segment (its bytes: the windows' union). Segments are counted by content: one that
   occurs twice is repeated as a whole, and one whose anchor occurs once is not repeated at all
   (unless the anchor occurs twice within it). What is left, one copy of each different segment of
   a shared anchor, goes on; nothing is dropped that could match.
   Repeated anchors are looked up in a bit table while that fits its bound (one that isn't repeated and
   passes costs room, nothing else), and by a semi-join beyond it.
2. Merging. Segments are dealt by anchor into buckets of about ``BUCKET_BYTES``. In a bucket they are split
   into shards of ``SHARD_BYTES``; each shard's suffixes are sorted and kept as its Burrows-Wheeler
   transform (an end mark of its own per segment). The shards' transforms are merged by refining their
   interleave: it starts with the rows dealt by first symbol, shard after shard, and each pass refines only the
   blocks that still hold several rows, to up to twice the depth, by the block of the row that the
   transforms' successor function leads to. Rows of one shard are in order already, so a block is refined by
   merging the shards' runs; no suffix is compared or sorted again. Where a pass parts neighbours, their
   common prefix is the distance jumped plus the least common prefix between the blocks they jumped to.
   Intervals whose common prefix reaches ``LENGTH`` are the repeated intervals.
3. An anchor whose different segments exceed ``GROUP_BYTES`` is split by further symbols: windows with the anchor in the
   same stretch of offsets share the bytes around it that all of them hold, so these bytes are the next anchor.
   Halving the stretch level by level, a group gets ever more bytes in common, the whole window at last, so
   every group comes to fit. Pieces that occur twice as a whole are repeated; one of them stays to be compared.
Defined cases: null text is empty; texts below the length lose nothing; strings never cross
documents; overlaps within one document count; repeated rows and ids are documents of their own
(copies repeat each other); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm import decontaminate
from veilspark.llm.common import cut
from veilspark.llm.decontaminate import _in_table, bit_table

LENGTH = 400
GRAM = 32
BUCKET_BYTES = 600_000
SHARD_BYTES = 150_000
ROWS_AT_ONCE = 500
GROUP_BYTES = 2_000_000
KEY = ["k1", "k2", "id"]
SEGMENT = ["anchor", "windows", "content"]


# --- narrowing -----------------------------------------------------------------------------------
def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every ``size``-byte piece, put together from pieces of 1, 2, 4, ... bytes."""
    mask = (1 << 64) - 1
    # pieces of 2**k bytes; the wanted size is the sum of some of them
    pieces, powers, k = {1: data.astype("u8") + np.uint64(1)}, {1: base}, 1
    while 2 * k <= size:
        h = pieces[k]
        pieces[2 * k] = h[: len(h) - k] * np.uint64(powers[k]) + h[k:]
        powers[2 * k] = powers[k] * powers[k] & mask
        k *= 2
    n, out, at = len(data) - size + 1, None, 0
    while k:
        if size & k:
            part = pieces[k][at : at + n]
            out = part if out is None else out * np.uint64(powers[k]) + part
            at += k
        k //= 2
    return _mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    y, k = x, 1
    while 2 * k <= width:
        y = np.minimum(y[: len(y) - k], y[k:])
        k *= 2
    rest = width - k
    return np.minimum(y[: len(y) - rest], y[rest:]) if rest else y


def segments(text: bytes) -> list[tuple[int, int, int, int, bool]]:
    """(anchor, windows, content hash, start, whether the anchor occurs in it twice) of a text's segments."""
    from xxhash import xxh3_64_intdigest

    if len(text) < LENGTH:
        return []
    width = LENGTH - GRAM + 1
    x = gram_hashes(np.frombuffer(text, "u1"), GRAM)
    y = sliding_min(x, width)
    starts = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1])))
    counts = np.diff(np.append(starts, len(y)))
    anchors = y[starts]
    out = []
    for a, n, s in zip(anchors.tolist(), counts.tolist(), starts.tolist()):
        twice = np.count_nonzero(x[s : s + n + width - 1] == a) > 1
        out.append((a, n, xxh3_64_intdigest(text[s : s + n + LENGTH - 1]), s, twice))
    return out


def _few(batches):
    """The batches in parts of ROWS_AT_ONCE rows, so that what is made of a part stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def places(rows: DataFrame) -> DataFrame:
    """All segments of all texts: KEY, SEGMENT, start, twice."""
    names = [*KEY, *SEGMENT, "start", "twice"]

    def run(batches):
        for batch in _few(batches):
            keys, owner, found = [np.asarray(batch.column(c)) for c in KEY], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                got = segments(text)
                found += got
                owner += [i] * len(got)
            at = np.array(owner, "i8")
            columns = list(zip(*found)) if found else [[]] * 5
            longs = [pa.array(np.array(c, "u8").view("i8")) for c in columns[:4]]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[at]) for k in keys), *longs, pa.array(columns[4], pa.bool_())], names)

    schema = ", ".join(f"{c} long" for c in names[:-1]) + ", twice boolean"
    return rows.filter(F.octet_length("text") >= LENGTH).select(*KEY, F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


# --- transforms ------------------------------------------------------------------------------------
def transform(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of some segments and, for each row, its place in their concatenation.

    Symbols are byte + 1, the end mark is 0. Suffixes are sorted to a depth of 7 * 2**7 = 896 bytes,
    over twice the depth that the merge asks for; rows equal so far keep their order.
    """
    pad = 7
    lengths = np.array([len(p) for p in parts])
    firsts = np.cumsum(lengths + pad) - lengths - pad
    symbols = np.zeros(int((lengths + pad).sum()) + pad, "u8")
    inside = np.repeat(firsts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    symbols[inside] = np.frombuffer(b"".join(parts), "u1").astype("u8") + np.uint64(1)
    ends = firsts + lengths
    places = np.sort(np.concatenate((inside, ends)))
    end_of = np.zeros(len(symbols), "i8")
    end_of[places] = np.repeat(ends, lengths + 1)
    key = np.zeros(len(symbols) - pad, "u8")
    for j in range(pad):
        key = (key << np.uint64(9)) | symbols[j : j + len(key)]
    order = places[np.argsort(key[places], kind="stable")]
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank = np.zeros(len(symbols), "i8")
    n = len(order)
    spots = np.arange(n)
    depth = pad
    while True:
        group = np.maximum.accumulate(np.where(new, spots, 0))
        rank[order] = group
        rank[ends] = 0
        alone = new & np.concatenate((new[1:], [True]))
        alone[: len(parts)] = True  # the end marks
        if alone.all() or depth >= 7 * 2**7:
            break
        active = np.flatnonzero(~alone)
        rows = order[active]
        pair = group[active] * n + rank[np.minimum(rows + depth, end_of[rows])]
        by = np.argsort(pair, kind="stable")
        order[active] = rows[by]
        pair = pair[by]
        new[active[1:]] = (pair[1:] != pair[:-1])
        new[active[0]] = True
        depth *= 2
    before = np.where(np.isin(order, firsts), 0, symbols[np.maximum(order - 1, 0)]).astype("u2")
    joined = order - pad * (np.searchsorted(firsts, order, side="right") - 1)  # place without the pads; end marks one past
    return before, joined


class Least:
    """Least value of any stretch of an array."""

    def __init__(self, values: np.ndarray):
        self.tiers, k = [values], 1
        while 2 * k <= len(values):
            self.tiers.append(np.minimum(self.tiers[-1][:-k], self.tiers[-1][k:]))
            k *= 2

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least of ``values[first..last]``, both included."""
        tier = np.frexp((last - first + 1).astype("f8"))[1] - 1
        out = np.empty(len(first), self.tiers[0].dtype)
        for t in np.unique(tier).tolist():
            at = np.flatnonzero(tier == t)
            out[at] = np.minimum(self.tiers[t][first[at]], self.tiers[t][last[at] - (1 << t) + 1])
        return out


def interleave(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged transforms of some shards: rows in order (numbered shard after shard) and the common
    prefix of each row with the one before it, as far as ``depth`` symbols (the first row has 0)."""
    successors, symbols, base = [], [], 0
    for bwt in shards:
        nxt = np.argsort(bwt, kind="stable")  # counting sort of symbols: the successor function read off a transform
        ends = int(np.count_nonzero(bwt == 0))
        nxt[:ends] = np.arange(ends)  # an end mark is followed by nothing: it stays
        successors.append(nxt + base)
        symbols.append(bwt[nxt] if ends == 0 else np.concatenate((np.zeros(ends, bwt.dtype), bwt[nxt[ends:]])))
        base += len(bwt)
    n, first = base, np.concatenate(symbols)
    step = {1: np.concatenate(successors)}
    order = np.argsort(first, kind="stable")  # dealt by first symbol, shard after shard
    sorted_first = first[order]
    prefix = np.full(n, depth, "u2")
    prefix[np.concatenate(([True], (sorted_first[1:] != sorted_first[:-1]) | (sorted_first[1:] == 0)))] = 0  # end marks are all different
    new = prefix == 0
    place = np.empty(n, "i8")  # of a row: the place of its block's first row
    reached = 1
    while True:
        block = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        place[order] = block
        more = ~new | np.concatenate((~new[1:], [False]))  # in blocks of several rows
        if reached >= depth or not more.any():
            break
        ahead = min(reached, depth - reached)
        jump = step.get(ahead)
        if jump is None:
            jump = np.arange(n)
            for bit, s in step.items():
                if ahead & bit:
                    jump = s[jump]
        active = np.flatnonzero(more)
        rows = order[active]
        met = place[jump[rows]]
        by = np.argsort(block[active] * n + met, kind="stable")  # merges the runs of the shards, block by block
        rows, met = rows[by], met[by]
        order[active] = rows
        parted = np.flatnonzero((block[active][1:] == block[active][:-1]) & (met[1:] != met[:-1])) + 1
        starts = np.flatnonzero(new)
        which = np.cumsum(new) - 1  # block number of a place
        least = Least(prefix[starts])
        prefix[active[parted]] = ahead + least.between(which[met[parted - 1]] + 1, which[met[parted]])
        new[active[parted]] = True
        reached += ahead
        if reached < depth and ahead == reached // 2:
            step[reached] = step[ahead][step[ahead]]
    return order, prefix


def repeated_runs(parts: list[bytes], length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> list[tuple[int, int, int]]:
    """(part, first, stop): runs of windows, by their offset in the part, that occur twice or more in the parts."""
    shards, at, size = [[]], [[]], 0
    for i, p in enumerate(parts):
        if shards[-1] and size + len(p) > shard_bytes:
            shards.append([])
            at.append([])
            size = 0
        shards[-1].append(p)
        at[-1].append(i)
        size += len(p)
    built = [transform(s) for s in shards]
    order, prefix = interleave([b for b, _ in built], length)
    alike = prefix >= length
    twice = np.zeros(len(order), bool)
    twice[order[alike | np.concatenate((alike[1:], [False]))]] = True
    out, row = [], 0
    for (bwt, place), members, texts in zip(built, at, shards):
        lengths = np.array([len(t) for t in texts])
        firsts = np.cumsum(lengths) - lengths
        hit = np.zeros(int(lengths.sum()) + 1, bool)
        rows = twice[row : row + len(bwt)]
        rows[: len(texts)] = False  # end marks
        hit[place[rows]] = True
        row += len(bwt)
        for i, a, n in zip(members, firsts.tolist(), lengths.tolist()):
            own = hit[a : a + n - length + 1]
            if n >= length and own.any():
                edge = np.flatnonzero(np.diff(own.astype("i1"), prepend=0, append=0))
                out += [(i, int(x), int(y)) for x, y in zip(edge[::2], edge[1::2])]
    return out


def _listed_in(rows: DataFrame, columns: list[str], listed: DataFrame) -> DataFrame:
    """Rows whose columns are in ``listed``: by a bit table while that fits its bound, which lets a few others pass
    that later steps drop, and spares the shuffle of a join; by a semi-join beyond."""
    hashes = listed.select(F.xxhash64(*columns).alias("h")).distinct()
    if hashes.count() > decontaminate.FILTER_BITS // 16:
        return rows.join(listed.select(*columns).distinct(), columns, "left_semi").select(*rows.columns)
    table = rows.sparkSession.sparkContext.broadcast(bit_table(hashes, "h"))

    def run(batches):
        for batch in batches:
            hit = _in_table(table.value, np.asarray(batch.column("h")).view("u8"))
            yield batch.filter(pa.array(hit)).drop_columns(["h"])

    return rows.withColumn("h", F.xxhash64(*columns)).mapInArrow(run, rows.schema)


# --- the whole -----------------------------------------------------------------------------------
PIECE = "grp long, anchor long, windows long, content long, first long, held long, bytes binary"


def _cut_out(segment_rows: DataFrame) -> DataFrame:
    """PIECE and ``hot`` from texts with the list of segments wanted of them: each segment is one piece, its anchor the group."""

    def run(batches):
        for batch in _few(batches):
            out = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                for w in wanted:
                    data = text[w["start"] : w["start"] + w["windows"] + LENGTH - 1]
                    out.append((w["anchor"], w["anchor"], w["windows"], w["content"], 0, w["windows"], data, w["hot"]))
            columns = list(zip(*out)) if out else [[]] * 8
            types = [pa.int64()] * 6 + [pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["grp", *SEGMENT, "first", "held", "bytes", "hot"])

    return segment_rows.select("text", "wanted").mapInArrow(run, PIECE + ", hot boolean")


def _in_buckets(pieces: DataFrame, buckets: int) -> DataFrame:
    """SEGMENT, first, stop of repeated windows, by merged transforms of the pieces of each bucket of groups."""
    order = [*SEGMENT, "first"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(order).sort_values(order, ignore_index=True)
        runs = repeated_runs(list(pdf["bytes"]))
        at = [r[0] for r in runs]
        offset = pdf["first"].to_numpy()[at]
        return pd.DataFrame({**{c: pdf[c].to_numpy()[at] for c in SEGMENT}, "first": offset + [r[1] for r in runs], "stop": offset + [r[2] for r in runs]})

    bucket = F.pmod(F.xxhash64("grp"), F.lit(buckets)).alias("bucket")
    return pieces.select(bucket, *order, "bytes").groupBy("bucket").applyInPandas(run, "anchor long, windows long, content long, first long, stop long")


def split_piece(data: bytes, held: int, anchor: int, stretch: int, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(group, first, windows): the runs of a piece's windows that have ``anchor`` in the same stretch of offsets, and
    the hash of the bytes round the anchor that every window with it there holds."""
    from xxhash import xxh3_64_intdigest

    spots = np.flatnonzero(gram_hashes(np.frombuffer(data, "u1"), GRAM) == np.uint64(anchor & (1 << 64) - 1))
    windows = np.arange(held)
    spot = spots[np.searchsorted(spots, windows)]  # the first one in the window
    part = (spot - windows) // stretch
    edge = np.flatnonzero(np.concatenate(([True], (spot[1:] != spot[:-1]) | (part[1:] != part[:-1]))))
    out = []
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), held]):
        i, p = int(part[a]), int(spot[a])
        common = data[p - i * stretch : p - (i + 1) * stretch + 1 + length]
        out.append((xxh3_64_intdigest(common, seed=i), a, b - a))
    return out


def _split(pieces: DataFrame, stretch: int) -> DataFrame:
    """PIECE and ``own``, the hash of a piece's bytes, with groups that share more bytes."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        names = ["grp", *SEGMENT, "first", "held", "bytes", "own"]
        for batch in _few(batches):
            out = []
            for row in batch.to_pylist():
                for group, first, held in split_piece(row["bytes"], row["held"], row["anchor"], stretch):
                    data = row["bytes"][first : first + held + LENGTH - 1]
                    out.append((group, row["anchor"], row["windows"], row["content"], row["first"] + first, held, data, xxh3_64_intdigest(data)))
            columns = list(zip(*out)) if out else [[]] * 8
            signed = lambda c: pa.array(np.array(c, "u8").view("i8"))
            longs = [pa.array(c, pa.int64()) for c in columns[1:6]]
            yield pa.RecordBatch.from_arrays([signed(columns[0]), *longs, pa.array(columns[6], pa.binary()), signed(columns[7])], names)

    return pieces.mapInArrow(run, PIECE + ", own long")


def repeated_marks(cand: DataFrame, counts: DataFrame) -> DataFrame:
    """SEGMENT and ``marks``, the runs (first, stop) of repeated windows: one row per different segment that has any."""
    size = F.sum(F.col("windows") + LENGTH - 1)
    anchors = counts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), size.alias("size"))
    whole = counts.filter("n > 1").select(*SEGMENT, F.lit(0).cast("long").alias("first"), F.col("windows").alias("stop"))
    needed = cut(counts.join(anchors, "anchor").filter("kinds > 1 or (n = 1 and twice)").withColumn("hot", F.col("size") > GROUP_BYTES))
    total = needed.filter("not hot").agg(size).first()[0] or 0
    one = F.struct(*SEGMENT, F.col("at.start").alias("start"), "hot").alias("w")
    wanted = needed.select("at.*", one).groupBy(*KEY).agg(F.collect_list("w").alias("wanted"))
    pieces = cut(_cut_out(cand.join(wanted, KEY)))
    runs, stretch = [_in_buckets(pieces.filter("not hot"), max(1, -(-total // BUCKET_BYTES)))], LENGTH - GRAM + 1
    large = None if needed.filter("hot").isEmpty() else pieces.filter("hot").drop("hot")
    while large is not None:
        stretch = -(-stretch // 2)
        finer = cut(_split(large, stretch).dropDuplicates(["grp", *SEGMENT, "first"]))
        same = ["grp", "held", "own"]
        alike = cut(finer.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*SEGMENT, "first")).alias("one")))
        runs.append(finer.join(alike.filter("n > 1").select(*same), same, "left_semi").select(*SEGMENT, "first", (F.col("first") + F.col("held")).alias("stop")))
        # of equal pieces one stays, and groups of a single piece have nothing to compare
        groups = alike.groupBy("grp").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("held") + LENGTH - 1).alias("size")).filter("kinds > 1")
        hot = F.col("size") > (GROUP_BYTES if stretch > 1 else 1 << 62)
        kept = cut(alike.join(groups, "grp").select("grp", "one.*", hot.alias("hot"), (F.col("held") + LENGTH - 1).alias("bytes")))
        total = kept.filter("not hot").agg(F.sum("bytes")).first()[0] or 0
        left = cut(finer.drop("own").join(kept.drop("bytes"), ["grp", *SEGMENT, "first"]).select("grp", *SEGMENT, "first", "held", "bytes", "hot"))
        runs.append(_in_buckets(left.filter("not hot"), max(1, -(-total // BUCKET_BYTES))))
        large = None if kept.filter("hot").isEmpty() else left.filter("hot").drop("hot")
    found = whole
    for more in runs:
        found = found.unionByName(more)
    # a segment's runs meet in one row before any join, so near copies, which have many runs, add no rows to it
    all_of_it, run = F.max(F.col("stop") - F.col("first")) == F.col("windows"), F.struct("first", "stop")
    entire = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("windows").alias("stop")))
    return found.groupBy(*SEGMENT).agg(F.when(all_of_it, entire).otherwise(F.collect_set(run)).alias("marks"))


def _unite(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["first"], s["stop"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: id, n_bytes, spans (removed byte ranges), n_removed, kept_sha256 (and kept, the bytes left)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("given"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"),
                       F.xxhash64(id_col).alias("id"), text.alias("text"))
    found = cut(places(rows))
    shared = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), F.max("twice").alias("twice")).filter("times > 1 or twice")
    repeated = cut(_listed_in(found, ["anchor"], shared))
    counts = cut(repeated.groupBy(*SEGMENT).agg(
        F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.min(F.struct(*KEY, "start")).alias("at")))
    cand = cut(_listed_in(rows.select(*KEY, F.col("text").cast("binary").alias("text")), KEY, repeated))
    marks = repeated_marks(cand, counts)
    placed = F.transform("marks", lambda m: F.struct(
        (F.col("start") + m["first"]).alias("first"), (F.col("start") + m["stop"] + LENGTH - 1).alias("stop")))
    spans = repeated.join(marks, SEGMENT).groupBy(*KEY).agg(F.flatten(F.collect_list(placed)).alias("spans"))

    def finish(batches):
        for batch in _few(batches):
            out = []
            for data, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                runs = _unite(found)
                kept = b"".join(data[b:c] for b, c in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(data)]))
                out.append(([{"start": a, "end": b} for a, b in runs], hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            columns = [pa.array([o[0] for o in out], span_type), pa.array([o[1] for o in out], pa.string())]
            if keep_text:
                columns.append(pa.array([o[2] for o in out], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), *columns], [*KEY, "runs", "left_sha", *(["left"] if keep_text else [])])

    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = "k1 long, k2 long, id long, runs array<struct<start: long, end: long>>, left_sha string" + (", left binary" if keep_text else "")
    done = cand.join(spans, KEY).mapInArrow(finish, schema).dropDuplicates(KEY)
    plain = rows.select("given", *KEY, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), *(["text"] if keep_text else []))
    out = plain.join(done, KEY, "left")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    columns = [F.col("given").alias(id_col), "n_bytes", F.coalesce("runs", none).alias("spans"),
               F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]), F.lit(0).cast("long")).alias("n_removed"),
               F.coalesce("left_sha", "sha").alias("kept_sha256")]
    if keep_text:
        columns.append(F.coalesce("left", F.col("text").cast("binary")).alias("kept"))
    return out.select(*columns)
