import hashlib
import random
import zlib

import pytest

from veilspark.llm import merkle as M

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"
RNG = random.Random(13)
ROWS = (
    [(i, "web", RNG.choice(["en", "en", "en", "de", "é", "z"]), i * 3, f"text {i} é") for i in range(200)]
    + [(200 + i, None, None, None, None) for i in range(3)] + [(None, "s", "en", 5, "x"), (7, "web", "en", 21, "again"), (7, "web", "en", 21, "again")]
    + [(900, "a", "lone", 1, ""), (901, "b" * 3000, "", 2, "y" * 70_000)]
)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def way(tiers, i):
    out = []
    for nodes in tiers[:-1]:
        out.append((i & 1, nodes[i ^ 1] if i ^ 1 < len(nodes) else None))
        i >>= 1
    return out


def changed(row):
    hit = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
    return (*row[:3], row[3] + 1, row[4]) if hit else row


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = way(trees[g], i) + way(top, k)
            node = leaf(changed(r))
            for right, other in steps:
                node = h(node) if other is None else h(other, node) if right else h(node, other)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*(o for _, o in steps if o)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def run(frame, rows, height):
    got = M.manifest(frame(rows, SCHEMA), claimed=M.tampered(), height=height)
    return sorted((tuple(r) for r in got.drop("sides", "siblings").collect()), key=repr)


@pytest.mark.parametrize("height", [2, M.HEIGHT])
def test_equals_brute_force(frame, height):
    want = brute(ROWS)
    assert run(frame, ROWS, height) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 1, "x")], [(i, "a", None, 1, "x") for i in range(9)], [(1, None, f"g{i}", 1, "x") for i in range(9)]])
def test_small_tables(frame, rows):
    assert run(frame, rows, 2) == brute(rows)


def test_proof_folds_to_the_root_and_nothing_else_does(frame):
    got = M.manifest(frame(ROWS, SCHEMA)).collect()
    assert all(r["verified"] for r in got)
    for r in got[:40]:
        assert M.fold(r["leaf"], r["sides"], r["siblings"]) == r["root"]
        assert M.fold(h("forged"), r["sides"], r["siblings"]) != r["root"]
