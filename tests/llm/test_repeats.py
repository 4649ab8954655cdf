import hashlib
import random

import pytest

from pyspark.sql import functions as F
from veilspark.llm import repeats as R

RNG = random.Random(6)


def noise(n):
    return "".join(RNG.choices("abcdefgh é\n", k=n))


PASSAGE = noise(700)
DOCS = (
    [(i, noise(RNG.randint(0, 1500))) for i in range(25)]
    + [(100 + i, noise(RNG.randint(0, 600)) + PASSAGE[a:b] + noise(RNG.randint(0, 600))) for i, (a, b) in enumerate([(0, 700), (100, 650), (0, 395), (250, 700), (0, 420)])]
    + [(200, None), (201, ""), (202, "be " * 4000), (203, "x" * 400), (204, "x" * 401), (None, PASSAGE), (205, PASSAGE[:380] + PASSAGE[:380])]
    + [(206, noise(900))] * 2
    + [(207, DOCS_TEXT := noise(1000)), (208, DOCS_TEXT), (209, DOCS_TEXT[:500] + "Q" + DOCS_TEXT[501:])]
)


def brute(docs, n=R.LENGTH):
    data, seen, out = [(t or "").encode() for _, t in docs], {}, []
    for b in data:
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] = seen.get(b[i : i + n], 0) + 1
    for (d, _), b in zip(docs, data):
        gone = bytearray(len(b) + 1)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group, bits", [(R.GROUP_BYTES, 1 << 26), (1500, 1 << 26), (500, 16)])
def test_equals_brute_force(frame, monkeypatch, group, bits):
    monkeypatch.setattr(R, "GROUP_BYTES", group)  # small: groups are split level by level
    monkeypatch.setattr(R.decontaminate, "FILTER_BITS", bits)  # small: semi-joins in place of bit tables
    got = R.remove_repeats(frame(DOCS, "doc_id bigint, text string"), keep_text=True)
    got = got.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), "kept_sha256", "kept").collect()
    assert sorted(((*r[:5], bytes(r[5])) for r in got), key=repr) == brute(DOCS)


def test_near_copies_make_one_row_of_marks_per_segment(frame, monkeypatch):
    monkeypatch.setattr(R, "GROUP_BYTES", 500)
    one, seen = noise(1000), []
    docs = [(i, one[:at] + "Z" + one[at + 1 :]) for i, at in enumerate(range(100, 1000, 90))] + [(50, one), (51, one)]
    marks = R.repeated_marks
    monkeypatch.setattr(R, "repeated_marks", lambda *a: seen.append(marks(*a)) or seen[0])
    got = R.remove_repeats(frame(docs, "doc_id bigint, text string"), keep_text=True)
    got = got.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), "kept_sha256", "kept").collect()
    assert sorted(((*r[:5], bytes(r[5])) for r in got), key=repr) == brute(docs)
    assert seen[0].count() == seen[0].select(*R.SEGMENT).distinct().count()


def test_empty_table(frame):
    assert R.remove_repeats(frame([], "doc_id bigint, text string")).collect() == []


def test_merged_transforms_find_all_repeats():
    for t in range(200):
        n = RNG.choice([5, 8, 13, 20])
        parts = [bytes(RNG.choices(b"ab\x00\xff" if t % 2 else b"a", k=RNG.randint(n, 80))) for _ in range(RNG.randint(1, 8))]
        seen = {}
        for p in parts:
            for i in range(len(p) - n + 1):
                seen[p[i : i + n]] = seen.get(p[i : i + n], 0) + 1
        want = {(k, i) for k, p in enumerate(parts) for i in range(len(p) - n + 1) if seen[p[i : i + n]] > 1}
        got = {(k, i) for k, a, b in R.repeated_runs(parts, n, RNG.choice([50, 200, 10_000])) for i in range(a, b)}
        assert got == want


def test_interleave_gives_order_and_common_prefixes():
    for t in range(150):
        depth = RNG.choice([1, 3, 8, 20])
        shards = [[bytes(RNG.choices(b"ab" if t % 2 else b"a", k=RNG.randint(1, 30))) for _ in range(RNG.randint(1, 4))] for _ in range(RNG.randint(1, 4))]
        built = [R.transform(s) for s in shards]
        order, prefix = R.interleave([b for b, _ in built], depth)
        suffixes = []
        for (_, place), parts in zip(built, shards):
            ends = [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
            text = b"".join(parts)
            # the end marks come first, one per part
            suffixes += [b""] * len(parts) + [text[p : min(e for e in ends if e > p)] for p in place[len(parts) :].tolist()]
        merged = [suffixes[i] for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(len(suffixes)))
        assert [m[:depth] for m in merged] == sorted(m[:depth] for m in merged)
        for a, b, k in zip(merged, merged[1:], prefix[1:].tolist()):
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert k == min(same, depth)


def test_pieces_of_a_group_share_bytes_and_keep_equal_windows_together():
    common = noise(60)
    texts = [noise(RNG.randint(0, 380)) + common + noise(RNG.randint(0, 380)) for _ in range(6)]
    texts += [t + noise(20) for t in texts]
    for t in texts:
        for anchor, held, _, start, _ in R.segments(t.encode()):
            data = t.encode()[start : start + held + R.LENGTH - 1]
            for stretch in (185, 47, 2, 1):
                got = R.split_piece(data, held, anchor, stretch)
                assert [(f, f + n) for _, f, n in got] == list(zip([f for _, f, _ in got], [f for _, f, _ in got][1:] + [held]))
                if stretch == 1:
                    assert all(n == 1 for _, _, n in got)


def test_transform_can_be_undone():
    parts = [b"banana", b"ananas", b"\x00\xff"]
    bwt, place = R.transform(parts)
    text = b"".join(parts)
    rest = [text[p : sum(map(len, parts[: k + 1]))] for k in range(3) for p in range(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1])))]
    assert len(bwt) == len(text) + 3 and sorted(bwt.tolist()) == sorted([b + 1 for b in text] + [0] * 3)
    ends = {sum(map(len, parts[: k + 1])) for k in range(3)}
    suffixes = [text[p : min(e for e in ends if e > p)] for p in place[3:].tolist()]
    assert suffixes == sorted(rest)
