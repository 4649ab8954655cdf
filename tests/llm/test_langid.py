import random

import numpy as np

from veilspark.llm import langid as L

RNG = random.Random(8)
PARTS = {"en": ["the", "ing", "th", "er", "and", "sh", "wh", "tion"], "de": ["sch", "ung", "ein", "der", "ä", "ich", "ver"], "es": ["ción", "ado", "que", "os", "ñ", "lla", "el"]}


def text(lang, n):
    return " ".join("".join(RNG.choices(PARTS[lang], k=RNG.randint(1, 3))).capitalize() for _ in range(n)) + "."


DOCS = [(i, text(lang, RNG.randint(20, 200)), lang) for i in range(240) for lang in [RNG.choice(list(PARTS))]]
EDGE = [(900, None, "en"), (901, "", "en"), (902, "123 !!", "de"), (None, text("de", 50), None), (903, text("es", 20_000), None), (904, "ß", "de"), (905, text("en", 30), None), (905, text("en", 30), None)]


def test_held_out_accuracy_and_edge_cases(frame):
    docs = frame(DOCS + EDGE, "doc_id bigint, text string, lang string")
    model = L.train(docs)
    assert model[0] == ["de", "en", "es"]
    got = L.identify(docs.select("doc_id", "text"), model).select("row.doc_id", L.held_out("row.doc_id").alias("held"), "lang_pred", "score").collect()
    assert len(got) == len(DOCS + EDGE)
    truth = {i: lang for i, _, lang in DOCS}
    held = [r for r in got if r["held"] and r["doc_id"] in truth]
    assert len(held) > 30 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
    by = {r["doc_id"]: r for r in got}
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert by[None]["lang_pred"] == "de" and by[903]["lang_pred"] == "es" and not by[None]["held"]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_held_out_rows_is_never_learned(frame, spark):
    import zlib

    docs = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in DOCS]
    assert "zz" not in L.train(frame(docs, "doc_id bigint, text string, lang string"))[0]


def test_empty_tables(frame):
    none = frame([], "doc_id bigint, text string, lang string")
    model = L.train(none)
    assert L.identify(none, model).collect() == []
    got = L.identify(frame(DOCS[:3], "doc_id bigint, text string, lang string"), model).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}


def test_counts_equal_brute_force():
    texts = ["Ab c", "", "été-été", "A", "xYz xyz"]
    known, owner, place, count = L.gram_counts(texts)
    table = L._symbol_of()
    for i, t in enumerate(texts):
        want = {}
        for w in "".join(c if table[ord(c)] else " " for c in t.lower()).split():
            s = [0, *(int(table[ord(c)]) for c in w), 0]
            for a, b, c in zip(s, s[1:], s[2:]):
                code = (a * L.SYMBOLS + b) * L.SYMBOLS + c
                want[code] = want.get(code, 0) + 1
        mine = owner == i
        assert dict(zip(known[place[mine]].tolist(), count[mine].tolist())) == want


def test_gram_vectors_bind_permuted_letters():
    letters = L._letters()
    code = np.array([(3 * L.SYMBOLS + 5) * L.SYMBOLS + 7])
    assert (L.gram_vectors(code)[0] == np.roll(letters[3], 2) * np.roll(letters[5], 1) * letters[7]).all()
