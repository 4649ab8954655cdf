import random
import re

import numpy as np

from veilspark.llm import urlfilter as U

RNG = random.Random(3)
HOSTS = ["a.example.org", "example.org", "EXAMPLE.ORG", "x.example.com", "org", "notorg", "free-bets.example.net", "bets.net", "alphabets.net", "www.spam-farm.example.com", "ß.Ä.net", "com"]
PATHS = ["", "/", "/es/1", "/en/1", "/en/12?x=/de/", "/fr/#q", "/de/", "/de", "?q=1", "#x", "/es", "/a b\nc"]
URLS = [RNG.choice(["http://", "https://", "://", "x://y://"]) + h + p for h in HOSTS for p in PATHS] + [None, "", "no url", "http:/x", "http://", "a" * 100_000 + "://org/"]
PAGES = list(enumerate(URLS)) + [(None, "http://free-bets.example.net/"), (5, URLS[5]), (5, URLS[5])]


def brute(page, url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    rule = max((r for r in U.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
    listed = bool(set(re.split("[.-]", host)) & set(U.LISTED_WORDS))
    return page, host, path, rule and rule[1] + rule[2], rule[0] if rule else "block" if listed else "allow"


def test_equals_brute_force(frame):
    got = U.filter_urls(frame(PAGES, "page_id bigint, url string"), lambda h, p: U.has_word(h, U.LISTED_WORDS)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute(*p) for p in PAGES), key=repr)


def test_blocks_of_shards_give_the_same(frame, monkeypatch):
    pages = frame(PAGES, "page_id bigint, url string")
    listed = lambda h, p: U.has_word(h, U.LISTED_WORDS)
    one = sorted(map(tuple, U.filter_urls(pages, listed).collect()), key=repr)
    monkeypatch.setattr(U, "KEYS_PER_SHARD", 10)
    monkeypatch.setattr(U, "BLOCK_BYTES", 30)
    assert sorted(map(tuple, U.filter_urls(pages, listed).collect()), key=repr) == one


def test_empty_table(frame):
    assert U.filter_urls(frame([], "page_id bigint, url string"), lambda h, p: U.has_word(h, U.LISTED_WORDS)).collect() == []


def test_cascade_is_exact_for_every_key():
    rng = np.random.default_rng(1)
    for n, share in ((0, 0.5), (1, 0.5), (500, 0.0), (500, 1.0), (20_000, 0.02), (20_000, 0.5), (20_000, 0.97)):
        h1, h2 = (rng.integers(0, 2**64, n, dtype="u8") for _ in range(2))
        listed = rng.random(n) < share
        levels = U.build_levels(h1, h2, listed)
        assert (U.is_listed(levels, h1, h2) == listed).all()
        if n == 20_000:
            assert sum(len(f) for _, _, f in levels) < n * 2
