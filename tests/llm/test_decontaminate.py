import random
import re

from pyspark.sql import functions as F

from veilspark.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RNG = random.Random(4)
VOCAB = [f"w{i}" for i in range(40)] + ["é", "the", "of"]


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def text(n):
    return " ".join(RNG.choices(VOCAB, k=n))


ITEMS = [(1, text(25)), (2, text(10)), (3, "Alpha, beta!"), (4, "solo"), (5, None), (6, " ,. "), (7, text(12)), (7, text(12)), (None, text(11)), (8, "the of the of the of the of the of the of")]
DOCS = (
    [(i, text(RNG.randint(0, 60))) for i in range(60)]
    + [(100 + i, text(5) + " " + " ".join(words(t)[a : a + n]).upper() + ";" + text(4)) for i, (_, t) in enumerate(ITEMS) for a in (0, 2) for n in (9, 10, 13)]
    + [(200, None), (None, ITEMS[0][1]), (201, ""), (202, "alpha-BETA alpha beta solo"), (203, ITEMS[1][1]), (203, ITEMS[1][1]), (204, "the of " * 3000 + ITEMS[6][1])]
)


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            v = words(x)
            n = min(10, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
        out.append((d, len(w), len(hit), len(found), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=repr)


def test_equals_brute_force(frame):
    docs, items = frame(DOCS, "doc_id bigint, text string"), frame(ITEMS, "item_id bigint, text string")
    got = D.decontaminate(docs, items).collect()
    assert sorted(((*r[:4], tuple(r[4]), r[5]) for r in got), key=repr) == brute(DOCS, ITEMS)


def test_empty_tables(frame):
    docs, items = frame(DOCS[:5], "doc_id bigint, text string"), frame(ITEMS, "item_id bigint, text string")
    none = frame([], "doc_id bigint, text string"), frame([], "item_id bigint, text string")
    assert D.decontaminate(none[0], items).collect() == []
    assert D.decontaminate(docs, none[1]).filter(F.col("contaminated") | (F.col("n_hit") > 0)).count() == 0
