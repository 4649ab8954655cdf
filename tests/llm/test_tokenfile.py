import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilspark.llm import tokenfile as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
RNG = random.Random(11)
WORDS = ["alpha", "Beta,", "gämma", "12", "3.4", "it's", "x;", "日本", "end.\nNew", "<|endoftext|>", "ab cd", "'ll"]
TEXTS = ["", None, " ", "a  b", " a", "a ", "\n", "x \n y", "　 x y", "abc\x1c d e", "he'll 'd", "a\u0085 b", "word " * 4000, "z" * 5000, "same text", "same text"] + [
    RNG.choice([" ", " ", "\n", "  "]).join(RNG.choices(WORDS, k=RNG.randint(1, 60))) for _ in range(150)]
DOCS = [(None if i == 5 else 3 if i == 9 else 7 * i % 1009, t) for i, t in enumerate(TEXTS)]


def brute(docs):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    ids = [(d, tok.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in docs]
    return ids


def ordered(docs, got):
    """The documents in the order of the files; among equal ids the files' order is taken as it is."""
    by_id = {}
    for d, ids in brute(docs):
        by_id.setdefault(d, []).append(ids)
    out, start = [], 0
    for d, ids in sorted(((r["doc_id"], list(r["ids"])) for r in got), key=lambda x: (x[0] is not None, x[0] or 0)):
        assert ids in by_id[d]
        by_id[d].remove(ids)
    assert not any(by_id.values())
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
        out.append(r["doc_id"])
    assert out == sorted(out, key=lambda d: (d is not None, d or 0))
    return start


@pytest.mark.parametrize("shard_tokens", [T.SHARD_TOKENS, 500])
def test_files_round_trip(spark, frame, tmp_path, shard_tokens):
    folder = str(tmp_path / "files")
    T.write_tokens(frame(DOCS, "doc_id bigint, text string"), folder, PATH, shard_tokens=shard_tokens)
    got = T.read_tokens(spark, folder, keep_ids=True).collect()
    total = ordered(DOCS, got)
    flat = [i for r in sorted(got, key=lambda r: r["start"]) for i in r["ids"]]
    for a, b in [(0, total), (17, 18), (total // 3, total // 2), (total - 5, total + 5), (total, total + 1)]:
        parts = sorted((tuple(r) for r in T.read_range(spark, folder, a, b).collect()))
        assert [i for _, ids in parts for i in ids] == flat[a:b]


def test_whole_operator(frame):
    got = T.encode_corpus(frame(DOCS, "doc_id bigint, text string"), PATH)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    want = sorted((len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for _, i in brute(DOCS))
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got.collect()) == want


def test_empty_table(spark, frame):
    assert T.encode_corpus(frame([], "doc_id bigint, text string"), PATH).collect() == []


def test_string_ids(frame):
    rows = [("b", "x y"), ("a", "z")]
    got = T.encode_corpus(frame(rows, "doc_id string, text string"), PATH).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == ["a", "b"] and got[0]["start"] == 0


@pytest.mark.parametrize("seed", range(30))
def test_grammar_is_lossless_and_random_access(seed):
    rng = np.random.default_rng(seed)
    top = int(rng.choice([2, 3, 50, 50257, 1 << 31]))
    counts = rng.integers(1, 60, rng.integers(1, 200))
    ids = rng.integers(0, top, counts.sum()).astype("u4")
    if seed % 3 == 0:
        ids[:] = 5  # one long run
    if seed % 3 == 1:
        ids = np.resize(ids[:37], len(ids))
    data, symbols = T.compress(ids, counts, min_uses=int(rng.choice([2, 8])), least_gain=float(rng.choice([0.0, 0.05])))
    g = T.Grammar(data)
    assert (g.decode() == ids).all() and symbols.sum() == len(g.symbols)
    assert (np.add.reduceat(g.widths, np.cumsum(symbols) - symbols) == counts).all()
    for _ in range(20):
        a, b = sorted(rng.integers(0, len(ids) + 3, 2).tolist())
        assert (g.decode(a, b) == ids[a:b]).all()


def test_grammar_shrinks_repeats():
    ids = np.tile(np.arange(100, dtype="u4"), 500)
    data, _ = T.compress(ids, np.array([len(ids)]))
    g = T.Grammar(data)
    assert len(g.symbols) < len(ids) // 50 and g.size.max() >= 64
    # pairs never span documents
    data, symbols = T.compress(ids, np.full(500, 100))
    assert len(symbols) == 500 and (T.Grammar(data).decode() == ids).all()


def test_empty_grammar():
    data, symbols = T.compress(np.zeros(0, "u4"), np.zeros(0, "i8"))
    assert len(T.Grammar(data).decode()) == 0 and len(symbols) == 0
