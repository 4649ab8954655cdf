import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm import quality as Q

RNG = random.Random(5)
WORDS = ["".join(RNG.choices(["an", "er", "ü", "sto", "ne", "ri", "ver", "gre"], k=RNG.randint(1, 4))) for _ in range(800)]


def prose(n):
    out = []
    while len(out) < n:
        s = RNG.choices(WORDS, k=RNG.randint(5, 14))
        s[0], s[-1] = s[0].capitalize(), s[-1] + "."
        out += s
    return " ".join(out)


def junk(n):
    return " ".join(w + RNG.choice(["***", "###", "%%%", "$$$"]) for w in RNG.choices(WORDS, k=n))


GOOD = [(i, prose(RNG.randint(60, 400))) for i in range(400)]
BAD = [(1000 + i, junk(RNG.randint(60, 300))) for i in range(60)]
EDGE = [(2000, None), (2001, ""), (None, prose(80)), (2002, "be " * 30_000), (2003, prose(20)), (2004, GOOD[0][1]), (2004, GOOD[0][1]), (2005, "a\nb\na\n \n\nb")]


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for x in tri:
        seen[x] = seen.get(x, 0) + 1
    hit = {i + k for i, x in enumerate(tri) if seen[x] > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\t\n\x0b\x1c\x85 |#", max_size=60))
def test_counts_equal_brute_force(t):
    assert Q.statistics(t.encode())[0] == brute(t)


def test_forest_rejects_what_stands_out(frame):
    docs = frame(GOOD + BAD + EDGE, "doc_id bigint, text string")
    labels = frame([(i, 1) for i, _ in GOOD[::2]] + [(i, 0) for i, _ in BAD[::2]], "doc_id bigint, quality int")
    got = Q.judge(docs, labels).collect()
    assert len(got) == len(GOOD + BAD + EDGE)
    texts = dict(GOOD + BAD + EDGE)
    for r in got:
        assert [r[c] for c in Q.COUNTS] == brute(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    judged = {r["doc_id"] for r in got if not r["base_failed"]}
    good, bad = {i for i, _ in GOOD} & judged, {i for i, _ in BAD} & judged
    assert len(kept & good) >= 0.92 * len(good) and len(kept & bad) <= 0.03 * len(bad)


def test_no_labels_and_empty_tables(frame):
    docs, none = frame(GOOD[:20] + EDGE, "doc_id bigint, text string"), frame([], "doc_id bigint, quality int")
    assert all(r["kept"] != r["base_failed"] for r in Q.judge(docs, none).collect())
    assert Q.judge(frame([], "doc_id bigint, text string"), none).collect() == []


def test_calibration_keeps_the_good():
    assert Q.calibrate([]) == 2.0 and Q.calibrate([(10, 1, 5)]) == 2.0
    assert 260 / Q.BINS < Q.calibrate([(200, 1, 90), (260, 1, 1), (300, 0, 50)]) <= 300 / Q.BINS


def test_isolated_points_score_high():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, len(Q.RATIOS)))
    trees = Q.fit_forest(x)
    far = np.full((1, len(Q.RATIOS)), 8.0)
    assert Q.anomaly(trees, len(x), far)[0] > Q.anomaly(trees, len(x), x).max() - 0.05
