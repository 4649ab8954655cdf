import random
import re

from veilspark.llm import personal as P

RNG = random.Random(9)
PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(t):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, t or "") if passes(kind, m[0]))


def card(n=16):
    d = "4" + "".join(RNG.choices("0123456789", k=n - 2))
    return next(d + c for c in "0123456789" if luhn(d + c))


def phone():
    return f"+1 ({RNG.randint(200, 999)}) 555-{RNG.randint(1000, 9999)}"


def ip():
    return ".".join(str(RNG.randint(0, 255)) for _ in range(4))


def mail():
    return "".join(RNG.choices("abcdef", k=6)) + ".7@mail.example.com"


PLAIN = [(i, f"Some words here {RNG.choice([card, phone, ip, mail])()} and, more words. Écrit {RNG.choice([card, phone, ip, mail])()} fin.") for i in range(300)]
TRICKY = [
    "", None, "no data at all", "a..b@c.d..e@f.g", "x@y.z@w.v", "@a.b", "a@b", "a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.01 1.2.3", "999.1.2.3.4",
    "4111 1111 1111 1111", "4111-1111  1111-1111", "4111111111111111 4111111111111111", "+1 2 3", "+1234567890123456", "+12(34).56-78 90", "++1 555 555 5555", "1 " * 6000, "." * 3000 + "@" * 3000,
    "\U0001f600 me@x.org \U0001f600 10.0.0.1", "7" * 50_000, "a" * 50_000 + "@b.c", "\u0001@a.b \u0001..x@y.z", "0" * 12, "a@b.c..d.e@f.g.h", "a." * 3000 + "b@" + "c." * 3000 + "d"]
DOCS = PLAIN + [(1000 + i, t) for i, t in enumerate(TRICKY)] + [(None, mail()), (5, "twice 10.0.0.7"), (5, "twice 10.0.0.7")]
GLUED = [(2000 + i, f"call {phone()} {card()} now") for i in range(5)]


def test_base_equals_brute_force_and_stays(frame):
    got = P.find_personal(frame(DOCS, "doc_id bigint, text string")).collect()
    assert len(got) == len(DOCS)
    for r in got:
        want = base(r["row"]["text"])
        assert [tuple(x) for x in r["base"]] == want
        spans = [tuple(x) for x in r["spans"]]
        assert spans == sorted(spans) and set(want) <= set(spans)
    clean = [r for r in got if r["row"]["text"] == "no data at all"]
    assert clean[0]["spans"] == []


def test_adds_what_failed_matches_hide(frame):
    got = P.find_personal(frame(PLAIN + GLUED, "doc_id bigint, text string")).collect()
    for r in got:
        if r["row"]["doc_id"] >= 2000:
            t = r["row"]["text"]
            assert r["base"] == [] and [(t[x["s"] : x["e"]], x["kind"]) for x in r["spans"]] == [(t[5:22], 3), (t[23:39], 2)]


def test_redaction_keeps_the_rest(frame):
    docs = frame([(1, "to a@b.cd, 10.0.0.1!", 20), (2, None, None), (3, "plain", 5), (4, "\U0001f600 +1 (555) 555-0199 x", 21)], "doc_id bigint, text string, n_chars bigint")
    got = {r["doc_id"]: r for r in P.redact(P.find_personal(docs), count_col="n_chars").collect()}
    assert got[1]["text"] == "to [EMAIL], [IP]!" and got[1]["n_chars"] == 17
    assert got[2]["text"] is None and got[3]["text"] == "plain" and got[3]["n_chars"] == 5
    assert got[4]["text"] == "\U0001f600 [PHONE] x"
    assert set(got[1].asDict()) == set(docs.columns)


def test_empty_table(frame):
    assert P.find_personal(frame([], "doc_id bigint, text string")).collect() == []


def test_plan_has_no_python(frame):
    found = P.find_personal(frame(PLAIN[:50], "doc_id bigint, text string"))
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString().replace("ExistingRDD", ""))


def test_a_rare_kind_is_judged_by_its_own_spans(frame, monkeypatch):
    monkeypatch.setattr(P, "TRAIN_DOCS", 40)
    monkeypatch.setattr(P, "TRAIN_ROWS", 800)
    many = [(i, f"write to {mail()} soon") for i in range(1500)] + [(3000 + i, f"my card {card()} and tel {phone()} here") for i in range(6)]
    got = P.find_personal(frame(many + GLUED, "doc_id bigint, text string")).collect()
    for r in got:
        if 2000 <= r["row"]["doc_id"] < 3000:
            t = r["row"]["text"]
            assert [(t[x["s"] : x["e"]], x["kind"]) for x in r["spans"]] == [(t[5:22], 3), (t[23:39], 2)]


def obfuscated(kind):
    d = card()
    v = {
        0: RNG.choice([f"{mail().split('.')[0]} [at] corp.example.org", f"{RNG.choice(['ann', 'joe'])}{RNG.randint(1, 99)}(at)site(dot)example(dot)com"]),
        1: "[.]".join(str(RNG.randint(0, 255)) for _ in range(4)),
        2: RNG.choice([".".join(d[i : i + 4] for i in range(0, 16, 4))]),
        3: RNG.choice([f"({RNG.randint(200, 999)}) 555-{RNG.randint(1000, 9999)}", f"001 {RNG.randint(200, 999)} 555 {RNG.randint(1000, 9999)}"]),
    }[kind]
    return obfuscated(kind) if base(v) else v


CUE = ["please write to", "the server at", "charge my card", "call me on"]
CLEAN = ["on 2024-01-15 we sold 1234567 items at 12.50", "we met [at] noon and left", "order number 4111-1111-1111-1112 came", "see version 1.2.3 of it",
         "from 1999 to 2004, pages 12-17 and 101-150", "x [at] 4.b is no address", "invoice 12/03/2021 no 88 77 66", "time 10:30:00 to 11:45:00", "weights 0.25 0.50 0.75 1.00"]


def test_recall_of_planted_spans_that_the_base_misses(frame):
    rows = [(i, f"Some words {CUE[k]} {[mail, ip, card, phone][k]()} and more {CLEAN[i % len(CLEAN)]}.") for i in range(800) for k in (i % 4,)]
    planted = [(10_000 + i, i % 4, obfuscated(i % 4)) for i in range(200)]
    rows += [(d, f"Hello, {CUE[k]} {v} if you can.") for d, k, v in planted]
    clean = [(20_000 + i, f"A text {i}: {CLEAN[i % len(CLEAN)]}, that is all.") for i in range(180)]
    got = {r["row"]["doc_id"]: r for r in P.find_personal(frame(rows + clean, "doc_id bigint, text string")).collect()}
    for kind in range(4):
        caught = [any(x["kind"] == kind and got[d]["row"]["text"][x["s"] : x["e"]] == v for x in got[d]["spans"]) for d, k, v in planted if k == kind]
        assert not any(got[d]["base"] for d, k, v in planted if k == kind)
        assert sum(caught) >= 0.9 * len(caught), (kind, sum(caught), len(caught))
    wrong = [got[d]["row"]["text"] for d, _ in clean if got[d]["spans"]]
    assert len(wrong) <= 0.02 * len(clean), wrong[:5]
