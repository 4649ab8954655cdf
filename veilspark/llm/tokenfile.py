"""Token ids on disk: Re-Pair grammar compression per shard, with random access.

1. The rows are dealt and sorted by id (``repartitionByRange``); each task turns its stretch of documents
   into token ids, in order, and closes a shard whenever ``SHARD_TOKENS`` ids have come together.
2. A shard is compressed by Re-Pair: frequent pairs of neighbouring symbols are replaced by
   nonterminals, round after round. A round replaces many pairs at once: where pairs overlap, the more
   frequent one wins, and a pair becomes a rule if at least ``MIN_USES`` places are left to it. Rounds
   end when one saves less than ``LEAST_GAIN`` of the symbols. Pairs never span documents, so each
   document is a run of symbols of its own.
3. A shard is one row of a Parquet dataset (written by Spark, so any store and lost executors are
   fine): the task's number and the shard's within it, the ids that the task wrote before it, the
   document ids, the number of symbols of each document and the ``grammar``: little-endian header
   (``GRP1``, width of a symbol in bytes, first nonterminal, number of rules, number of symbols), left
   and right sides of the rules, their expansion lengths (8 bytes each) and the symbols.
4. Reading: expansion lengths turn a token range into a symbol range by one running sum and a binary search,
   so ``decode`` expands only the symbols asked for. Starts over all files come from the sizes of
   the tasks' stretches (one number per task, as many as the write has partitions).

Order: ascending id, nulls first; rows with equal ids by the hash of their text. Rows equal in
both are interchangeable; they can't be parted, but a task streams them, a shard at a time.

Defined cases: null or empty text is the end id alone; repeated rows are documents of their own; an
empty table gives files without shards and an empty result; other columns are ignored; a text
longer than a shard is a shard of its own.
"""

from __future__ import annotations

import gc
import re
import struct
import uuid
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import shared_folder

SHARD_TOKENS = 1 << 18
MIN_USES = 8
LEAST_GAIN = 0.05
BLOCK_BYTES = 8 << 20
CACHE_PIECES = 300_000
HEADER = struct.Struct("<4sIQQQ")


# --- ids -------------------------------------------------------------------------------------------
class PieceIds(dict):
    """Piece of a text (with the blank before it) -> uint32 ids as bytes; a cache of two generations.

    Texts are parted at single blanks between two other characters, where the pre-tokenizer always
    starts a new pre-token. None marks a piece with white space at an edge: there the blanks are not single.
    """

    #: the pre-tokens of a byte-level vocabulary; a fixed value of the tokenizer file
    PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.tokenize = tokenizer.model.tokenize
        self.pre_tokens = regex.compile(self.PRE_TOKENS).findall
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(plain)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.letters = "".join(letters[b] for b in range(256))
        self.blank = self.letters[32]
        self.before: dict[str, bytes | None] = {}
        self.signs: dict[str, bytes] = {}
        self.ends = {sign: self._model(sign) for sign in ".,;:!?"}

    def _model(self, token: str) -> bytes:
        if not token.isascii() or not token.isalpha():
            token = charmap_decode(token.encode(), "strict", self.letters)[0]
        return array("I", [t.id for t in self.tokenize(token)]).tobytes()

    def _token(self, token: str) -> bytes:
        """Ids of a pre-token: words with a blank are pieces; the others, mostly signs, have a table of their own."""
        if token[0] == " " and token[1:].isalpha():
            return self[token[1:]]
        data = self.signs.get(token)
        if data is None:
            if len(self.signs) >= CACHE_PIECES // 4:
                self.signs.clear()
            data = self.signs[token] = self._model(token)
        return data

    def text(self, text: str) -> bytes:
        return b"".join([self._token(t) for t in self.pre_tokens(text)])

    def __missing__(self, piece: str) -> bytes | None:
        if len(self) >= CACHE_PIECES:
            self.before = dict(self)  # the frequent ones come back from there
            self.clear()
        if piece in self.before:
            data = self.before[piece]
        elif piece.isalpha():  # one pre-token
            letters = piece if piece.isascii() else charmap_decode(piece.encode(), "strict", self.letters)[0]
            data = array("I", [t.id for t in self.tokenize(self.blank + letters)]).tobytes()
        elif piece[:-1].isalpha() and (end := self.ends.get(piece[-1])):
            data = self[piece[:-1]] + end
        elif not piece or piece[0].isspace() or piece[-1].isspace():
            data = None
        else:
            data = self.text(" " + piece)
        self[piece] = data
        return data

    def whole(self, text: str) -> bytes:
        """Ids of a text with any white space."""
        first, *others = self.SINGLE_BLANK.split(text)
        ids = [self.text(first)]
        for p in others:
            known = self[p]
            ids.append(self.text(" " + p) if known is None else known)
        return b"".join(ids)


_KNOWN: dict[str, PieceIds] = {}


def pieces_of(path: str) -> PieceIds:
    """One cache per Python worker and vocabulary."""
    if path not in _KNOWN:
        _KNOWN[path] = PieceIds(path)
    return _KNOWN[path]


def token_ids(texts: pa.Array, known: PieceIds, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts, each with the end id, one after the other, and the number of each."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.split_pattern(texts, " ")
    offsets = np.asarray(lists.offsets).astype("i8")
    coded = lists.flatten().dictionary_encode()
    # by way of NumPy, which makes the strings in one go; Arrow's own list makes a scalar of each first
    pieces, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices).astype("i4")
    data = list(map(known.__getitem__, pieces))
    edged = np.array([d is None for d in data], bool)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    odd = np.zeros(len(texts), bool)  # with blanks beside other white space
    odd[owner[edged[code]]] = True
    # the first piece has no blank before it; a text with odd blanks is one piece
    own = [known.whole(texts[i].as_py()) if o else known.text(pieces[c]) for i, (o, c) in enumerate(zip(odd.tolist(), code[offsets[:-1]].tolist()))]
    n = len(data)
    code[odd[owner]] = n
    code[offsets[:-1]] = n + 2 + np.arange(len(own))
    code = np.insert(code, offsets[1:], n + 1)
    data = [d or b"" for d in data] + [b"", np.array([end_id], "<u4").tobytes()] + own
    # numbers of 32 bits: a block, or a text of its own, has fewer ids
    size = np.array([len(d) for d in data], "i4") >> 2
    start = np.cumsum(size, dtype="i4") - size
    each = size[code]
    at = np.cumsum(each, dtype="i4") - each
    ids = np.frombuffer(b"".join(data), "<u4")[np.repeat(start[code] - at, each) + np.arange(int(at[-1] + each[-1]), dtype="i4")]
    return ids, np.add.reduceat(each.astype("i8"), offsets[:-1] + np.arange(len(texts)))


# --- grammar ---------------------------------------------------------------------------------------
def _chosen(seq: np.ndarray, closing: np.ndarray, min_uses: int) -> np.ndarray:
    """Places of pairs to replace, no two overlapping: the locally most frequent ones.

    Frequencies are counted by an 18-bit hash, which only orders the pairs; rules are made by exact counts.
    """
    mixed = (seq[:-1] * np.uint32(0x9E3779B1)) ^ (seq[1:] * np.uint32(0x85EBCA77))
    h = (mixed >> np.uint32(14)).astype("i8")
    c = np.bincount(h, minlength=1 << 18).astype("i4")[h]
    c[closing[:-1] | (c < min_uses)] = 0
    n = len(c)
    before, after = np.concatenate(([0], c[:-1])), np.concatenate((c[1:], [0]))
    # among equal neighbours every second place is taken, from the second on where the place before is more frequent
    new = before != c
    new[0] = True
    first = np.maximum.accumulate(np.where(new, np.arange(n, dtype="i4"), 0))
    skip = (before > c)[first]
    return np.flatnonzero((c > 0) & (c >= after) & (((np.arange(n, dtype="i4") - first) & 1) == skip))


def compress(ids: np.ndarray, counts: np.ndarray, min_uses: int = MIN_USES, least_gain: float = LEAST_GAIN) -> tuple[bytes, np.ndarray]:
    """Grammar of the ids of some documents, ``counts`` of each, and the symbols of each document."""
    seq = ids.astype("u4")
    closing = np.zeros(len(seq), bool)
    closing[np.cumsum(counts) - 1] = True
    base = int(seq.max()) + 1 if len(seq) else 0
    left, right, size = np.zeros(0, "u4"), np.zeros(0, "u4"), np.zeros(0, "u8")
    while len(seq) > 1:
        at = _chosen(seq, closing, min_uses)
        key = seq[at].astype("u8") << np.uint64(32) | seq[at + 1]
        ordered = np.sort(key)
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(key) else np.zeros(0, "i8")
        rules = ordered[edge[np.diff(np.append(edge, len(key))) >= min_uses]]
        if not len(rules):
            break
        which = np.minimum(np.searchsorted(rules, key), len(rules) - 1)
        used = rules[which] == key
        at, which = at[used], which[used]
        new_left, new_right = (rules >> np.uint64(32)).astype("u4"), (rules & np.uint64(0xFFFFFFFF)).astype("u4")
        width = lambda s: np.append(size, np.uint64(1))[np.maximum(s.astype("i8") - base, -1)]
        grown = width(new_left) + width(new_right)
        seq[at] = base + len(left) + which
        closing[at] = closing[at + 1]
        left, right, size = np.append(left, new_left), np.append(right, new_right), np.append(size, grown)
        rest = np.ones(len(seq), bool)
        rest[at + 1] = False
        was = len(seq)
        seq, closing = seq[rest], closing[rest]
        if len(at) - 2 * len(rules) < least_gain * was:
            break
    wide = 2 if base + len(left) <= 1 << 16 else 4
    as_bytes = [x.astype(f"<u{wide}").tobytes() for x in (left, right)] + [size.astype("<u8").tobytes(), seq.astype(f"<u{wide}").tobytes()]
    ends = np.flatnonzero(closing)
    return HEADER.pack(b"GRP1", wide, base, len(left), len(seq)) + b"".join(as_bytes), np.diff(ends, prepend=-1)


class Grammar:
    """A shard's grammar, read without expanding its symbols."""

    def __init__(self, data: bytes):
        mark, wide, self.base, rules, symbols = HEADER.unpack_from(data)
        if mark != b"GRP1":
            raise ValueError("not a grammar")
        at, parts = HEADER.size, []
        for kind, n in ((f"<u{wide}", rules), (f"<u{wide}", rules), ("<u8", rules), (f"<u{wide}", symbols)):
            parts.append(np.frombuffer(data, kind, n, at).astype("i8"))
            at += parts[-1].size * int(kind[-1])
        self.left, self.right, self.size, self.symbols = parts
        self.widths = np.append(self.size, 1)[np.maximum(self.symbols - self.base, -1)]  # the last stands for terminals
        self._expanded: np.ndarray | None = None

    @property
    def expanded(self) -> np.ndarray:
        """Ids of all rules' expansions, one after the other."""
        if self._expanded is None:
            seq = self.base + np.arange(len(self.left))
            while (rule := seq >= self.base).any():
                at = np.cumsum(1 + rule) - 1 - rule
                out = np.empty(len(seq) + int(rule.sum()), "i8")
                out[at[~rule]] = seq[~rule]
                out[at[rule]] = self.left[seq[rule] - self.base]
                out[at[rule] + 1] = self.right[seq[rule] - self.base]
                seq = out
            self._expanded = seq
        return self._expanded

    def expand(self, first: int, stop: int) -> np.ndarray:
        """Ids of the symbols ``first`` to ``stop``."""
        symbols, each = self.symbols[first:stop], self.widths[first:stop]
        start = np.append(np.cumsum(self.size) - self.size, 0)
        plain = symbols < self.base
        source = np.concatenate((self.expanded, symbols))
        start = np.where(plain, len(self.expanded) + np.arange(len(symbols)), start[np.where(plain, -1, symbols - self.base)])
        at = np.cumsum(each) - each
        return source[np.repeat(start - at, each) + np.arange(int(each.sum()))].astype("<u4")

    def decode(self, first: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``first`` to ``stop`` of the shard; only the symbols that hold them are expanded."""
        reach = np.cumsum(self.widths)
        total = int(reach[-1]) if len(reach) else 0
        first, stop = min(first, total), total if stop is None else min(stop, total)
        if first >= stop:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(reach, first, side="right"), np.searchsorted(reach, stop, side="left") + 1
        skip = first - int(reach[a] - self.widths[a])
        return self.expand(a, b)[skip : skip + stop - first]


# --- files -----------------------------------------------------------------------------------------
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about BLOCK_BYTES of text."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype("i8")
        block = (np.cumsum(sizes) - sizes) // BLOCK_BYTES
        edges = [*np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def _writer(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, known = TaskContext.get().partitionId(), pieces_of(path)
        gc.disable()  # millions of small strings and no cycles: collections would take a third of the time
        names = ["part", "shard", "first", "n_ids", "doc_ids", "doc_symbols", "grammar"]
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        shard = first = waiting = 0

        def close() -> pa.RecordBatch:
            nonlocal shard, first, waiting, held
            keys = pa.concat_arrays([k for k, _, _ in held])
            ids, counts = (np.concatenate([h[j] for h in held]) for j in (1, 2))
            grammar, symbols = compress(ids, counts)
            row = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
                   pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                   pa.array([symbols], pa.list_(pa.int64())), pa.array([grammar], pa.binary())]
            shard, first, waiting, held = shard + 1, first + len(ids), 0, []
            return pa.RecordBatch.from_arrays(row, names)

        for block in _blocks(batches):
            ids, counts = token_ids(block.column(1), known, end_id)
            ends, at, row = np.cumsum(counts), 0, 0
            while row < len(counts):
                # documents until the shard is full, one at least
                full = int(np.searchsorted(ends, at + shard_tokens - waiting, side="left")) + 1
                stop = min(max(full, row + 1), len(counts))
                held.append((block.column(0).slice(row, stop - row), ids[at : ends[stop - 1]], counts[row:stop]))
                waiting += int(ends[stop - 1]) - at
                at, row = int(ends[stop - 1]), stop
                if waiting >= shard_tokens:
                    yield close()
        if held:
            yield close()
        gc.enable()

    return run


def write_tokens(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Token files of ``docs`` in ``folder`` (new), by the tokenizer file at ``path``.

    The write has as many tasks as ``spark.sql.shuffle.partitions`` says.
    """
    spark = docs.sparkSession
    key = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    kinds = [("part", T.IntegerType()), ("shard", T.IntegerType()), ("first", T.LongType()), ("n_ids", T.LongType()),
             ("doc_ids", T.ArrayType(key)), ("doc_symbols", T.ArrayType(T.LongType())), ("grammar", T.BinaryType())]
    schema = T.StructType([T.StructField(n, k) for n, k in kinds])
    dealt.mapInArrow(_writer(path, end_id, shard_tokens), schema).write.parquet(folder)


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards of token files with ``start``, the number of ids in all shards before."""
    files = spark.read.parquet(folder)
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one number per writing task
    starts, before = [], 0
    for part in sorted(totals):
        starts.append((part, before))
        before += totals[part]
    base = F.broadcast(spark.createDataFrame(starts, "part int, base long"))
    return files.join(base, "part").withColumn("start", F.col("base") + F.col("first")).drop("base", "first")


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Every document of token files: id, start, n_tokens, ids_crc32 (and ids)."""
    files = shards(spark, folder)
    key = files.schema["doc_ids"].dataType.elementType

    def run(batches):
        for batch in batches:
            columns = [batch.column(c) for c in ("start", "doc_ids", "doc_symbols", "grammar")]
            for row in range(batch.num_rows):
                start, symbols, data = columns[0][row].as_py(), np.asarray(columns[2][row].values), columns[3][row].as_py()
                grammar = Grammar(data)
                ids = grammar.decode()
                counts = np.add.reduceat(grammar.widths, np.cumsum(symbols) - symbols)
                ends = np.cumsum(counts)
                raw, begins = memoryview(ids.tobytes()), (ends - counts)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                out = [columns[1][row].values, pa.array(start + begins), pa.array(counts), pa.array(crc, pa.int64())]
                names = [id_col, "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1]), pa.int32()), pa.array(ids.astype("i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    kinds = [(id_col, key), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())]
    if keep_ids:
        kinds.append(("ids", T.ArrayType(T.IntegerType())))
    wanted = files.select("start", "doc_ids", "doc_symbols", "grammar")
    return wanted.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in kinds]))


def read_range(spark: SparkSession, folder: str, first: int, stop: int) -> DataFrame:
    """Ids ``first`` to ``stop`` of the whole corpus as rows (start, ids), one per shard that holds some."""
    hit = shards(spark, folder).filter((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > first))

    def run(batches):
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("grammar").to_pylist()):
                a = max(first - start, 0)
                ids = Grammar(data).decode(a, stop - start).astype("i4")
                yield pa.RecordBatch.from_arrays([pa.array([start + a]), pa.array([ids], pa.list_(pa.int32()))], ["start", "ids"])

    return hit.select("start", "grammar").mapInArrow(run, "start long, ids array<int>")


def encode_corpus(docs: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """``docs`` written as token files (to a new folder beside the checkpoints if none is given) and read back."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-files-{uuid.uuid4()}"
    write_tokens(docs, folder, path, id_col, text_col, end_id)
    return read_tokens(spark, folder, id_col)
