import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilspark.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = [(1, "The quick brown fox."), (2, ""), (3, None), (None, "null id"), (4, "long words, " * 3000), (5, "same"), (5, "same"), (6, "<|endoftext|> 'S ́x é ß 123")]


def test_pieces_and_places(frame):
    out = P.pack(frame(DOCS, "doc_id bigint, text string", clash=False).withColumnRenamed("x", "y"), PATH, capacity=64, keep_ids=True).collect()
    whole = Tokenizer.from_file(PATH)
    want = []
    for d, t in DOCS:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), 64)):
            part = ids[a : a + 64]
            want.append((d, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in out), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == -(-sum(w[3] for w in want) // 64)


def test_clashing_columns_and_empty_table(frame):
    assert P.pack(frame(DOCS[:2], "doc_id bigint, text string"), PATH).count() == 2
    assert P.pack(frame([], "doc_id bigint, text string"), PATH).collect() == []


def test_chunks_give_the_ids_of_the_whole():
    whole, ids, rng = Tokenizer.from_file(PATH), P.ChunkIds(PATH), random.Random(1)
    signs = ["a", "B", "'s", "'S", "́", "é", "J̌", " ", " ", "\n", "\t", "\x0b", "\x1c", "<|endoftext|>", "<|", "1", "23", "!", ".", ",", "Σ", "中", "\U0001f600", "\x85", "‍", "\r"]
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randint(1, 12)))
        got = np.frombuffer(b"".join(ids[c] for c in text.encode().split()), "<u4").tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids


def test_lowered_texts_give_the_same_ids():
    whole, ids, rng = Tokenizer.from_file(PATH), P.ChunkIds(PATH), random.Random(2)
    plain = ["Ab", "É", "À", "Þ", "ß", "ÿ", "×", "÷", "µ", "ª", "\xa0", "\xad", "'S", "'", "(5", "%%", "_", "`~", "7", "x", " ", "\n", ".", ",", "..,"]
    other = ["J\u030c", "İ", "Ω", "K", "<", "|", "<|ENDOFTEXT|>", "<|endoftext|>", "<|STARTOFTEXT|>", "\x00", "\x85"]
    for n in range(4000):
        text = "".join(rng.choices(plain + other * (n % 2), k=rng.randint(1, 12)))
        got = np.frombuffer(b"".join([ids[c] for c in P.lowered(text.encode()).split()]), "<u4").tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids, text
    assert P.lowered(b"<|ENDOFTEXT|>") == b"<|ENDOFTEXT|>" and P.lowered("J\u030c".encode()) == "J\u030c".encode()


def test_model_is_asked_once_per_run_of_letters(monkeypatch):
    ids, asked = P.ChunkIds(PATH), []
    one = P.ChunkIds._model_ids
    monkeypatch.setattr(P.ChunkIds, "_model_ids", lambda self, piece: asked.append(piece) or one(self, piece))
    monkeypatch.setattr(ids, "tokenizer", None)  # none of these takes the whole tokenizer
    text = "Word word, WORD. (word) word&&& word%%% Été été, (583) word583 word"
    for c in P.lowered(text.encode()).split():
        ids[c]
    assert len(asked) == len(set(asked))
    assert sum(p.isalpha() for p in asked) == 1 and "été".encode() in asked


def test_full_cache_is_emptied_and_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(P, "CACHE_CHUNKS", 3)
    whole, ids = Tokenizer.from_file(PATH), P.ChunkIds(PATH)
    for text in ["a, b. (c)", "d12 e' f", "a, b. (c) ééé%%"] * 2:
        got = np.frombuffer(b"".join([ids[c] for c in text.encode().split()]), "<u4").tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids and len(ids) <= 3


@pytest.mark.parametrize("seed", range(5))
def test_fullest_combination_is_the_best(seed):
    rng = random.Random(seed)
    available = sorted({rng.randint(1, 30): rng.randint(1, 3) for _ in range(6)}.items(), reverse=True)
    sums = {0}
    for x, n in available:
        sums = {s + x * k for s in sums for k in range(n + 1)}
    uses = P.fullest(available, 50)
    assert sum(x * u for x, u in uses.items()) == max(s for s in sums if s <= 50)
    assert all(u <= dict(available)[x] for x, u in uses.items())


def test_plan_uses_every_piece_once():
    counts = {5: 7, 9: 100, 31: 3, 64: 2, 1: 11}
    left = dict(counts)
    bins = 0
    for first, times, uses in P.plan_bins(counts, 64):
        assert first == bins and sum(x * u for x, u in uses.items()) <= 64
        bins += times
        for x, u in uses.items():
            left[x] -= u * times
    assert not any(left.values())
