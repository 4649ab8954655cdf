from veilspark.llm import wrapper as W


def page(title, paras, host="h.example.net", menu="a b", extra=""):
    links = "".join(f'<li><a href="/{m}">{m}</a></li>' for m in menu.split())
    body = "".join(f"<p>{p}</p>" for p in paras)
    return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
            f"<nav><ul>{links}</ul></nav><!-- x --><div class=\"ad\">Buy {title}</div>{extra}"
            f"<article><h1>{title}</h1>{body}</article><div id='comments'><p>nice {title}</p></div><footer>&copy; {title}</footer></body></html>")


def plain(title, paras):
    """The same without an article element: content is found by what varies."""
    body = "".join(f"<p>{p}" for p in paras)
    return f"<html><body><div class=top>Site of all</div><div class=c1><h1>{title}</h1>{body}</div><div class=c2>Always the same</div><form>{title}<input></form></body></html>"


PAGES = (
    [(i, f"http://h.example.net/{i}", page(f"Title {i}", [f"First {i}  of &amp; text.", f"Second <b>bold</b>{i}&nbsp;x<br>line"], menu="m n o"[: 1 + 2 * (i % 3)])) for i in range(8)]
    + [(100 + i, f"http://p.example.net/{i}", plain(f"Plain {i}", [f"One {i} is long enough to matter", f"Two {i}"])) for i in range(5)]
    + [(200, "http://single.example.net/", page("Only", ["Alone here"])), (201, None, page("Nowhere", ["Null url"])), (202, "http://n.example.net/", None),
       (203, "http://n.example.net/x", ""), (None, "http://h.example.net/9", page("Title 9", ["Null id"])), (3, "http://h.example.net/3", page("Title 3", ["Again"])),
       (204, "http://deep.example.net/", "<div>" * 3000 + "<article><p>deep text</p></article>" + "</div>" * 3000),
       (205, "http://long.example.net/", page("Long", ["word " * 30_000])), (206, "http://b.example.net/", "<p>broken < 3 & <article><p>in <b>it<p>more</article><footer>no"),
       (207, "http://header.example.net/", "<header>Site</header><article><header><h1>Head</h1></header><p>Body</p><aside>side</aside><script>x</article></script></article>")]
)


def texts(frame, pages, clash=True):
    return {(r["page_id"], r["url"]): r["text"] for r in W.main_text(frame(pages, "page_id bigint, url string, html string", clash)).collect()}


def test_articles_without_boilerplate(frame):
    rows = frame(PAGES, "page_id bigint, url string, html string")
    got = W.main_text(rows).collect()
    assert len(got) == len(PAGES)
    by = {(r["page_id"], r["url"]): r["text"] for r in got}
    for i in range(8):
        if i != 3:
            assert by[(i, f"http://h.example.net/{i}")] == f"Title {i}\nFirst {i} of & text.\nSecond bold{i} x line"
    for i in range(5):
        assert by[(100 + i, f"http://p.example.net/{i}")] == f"Plain {i}\nOne {i} is long enough to matter\nTwo {i}"
    assert by[(200, "http://single.example.net/")] == "Only\nAlone here"
    assert by[(201, None)] == "Nowhere\nNull url"
    assert by[(202, "http://n.example.net/")] == "" and by[(203, "http://n.example.net/x")] == ""
    assert by[(None, "http://h.example.net/9")] == "Title 9\nNull id"
    assert "deep text" in by[(204, "http://deep.example.net/")]
    assert by[(205, "http://long.example.net/")] == "Long\n" + ("word " * 30_000).strip()
    assert by[(206, "http://b.example.net/")].split("\n")[-2:] == ["in it", "more"]
    assert by[(207, "http://header.example.net/")] == "Head\nBody"


def test_constant_nodes_are_template(frame):
    pages = [(i, f"http://h.example.net/{i}", f"<article><h1>T{i}</h1><div>Read our terms</div><p>Text of page {i}</p></article>") for i in range(6)]
    assert texts(frame, pages)[(2, "http://h.example.net/2")] == "T2\nText of page 2"


def test_empty_table(frame):
    assert W.main_text(frame([], "page_id bigint, url string, html string")).collect() == []


def test_simple_tree_matching():
    def tree(label, *kids):
        return {"label": label, "kids": list(kids), "n": 1, "low": 0, "high": 0, "chars": 0, "links": 0}

    a = tree("a", tree("b", tree("x")), tree("c"), tree("d"))
    b = tree("a", tree("c"), tree("b", tree("x"), tree("y")), tree("d"))
    assert W.matching(a, b, {})[0] == 4
    assert W.matching(a, tree("z"), {})[0] == 0
    merged = W.merge(a, b)
    assert [k["label"] for k in merged["kids"]] == ["c", "b", "c", "d"] or [k["label"] for k in merged["kids"]] == ["b", "c", "b", "d"]


def test_each_template_of_a_host_has_its_content(frame):
    for host in ("http://two.example.net/", "/no-scheme/"):
        one = [(i, f"{host}{i}", f"<body><nav>Menu</nav><article><h1>A{i}</h1><p>Text of article {i}, long enough</p></article><footer>F</footer></body>") for i in range(14)]
        two = [(100 + i, f"{host}m{i}", f"<body><nav>Menu</nav><main><h1>M{i}</h1><p>Other text {i}</p></main><footer>F</footer></body>") for i in range(4)]
        three = [(200 + i, f"{host}d{i}", f"<body><nav>Menu</nav><div class=b><h2>D{i}</h2><p>Third kind {i}</p></div><footer>F</footer></body>") for i in range(2)]
        by = {k[0]: v for k, v in texts(frame, one + two + three).items()}
        assert by == ({i: f"A{i}\nText of article {i}, long enough" for i in range(14)} | {100 + i: f"M{i}\nOther text {i}" for i in range(4)}
                      | {200 + i: f"D{i}\nThird kind {i}" for i in range(2)})


def test_what_only_copies_share_is_no_template(frame):
    table = "<table><tr><td>Only in one article</td></tr></table>"
    large = [(i, f"http://large.example.net/{i}", f"<article><h1>T{i}</h1><div>Read our terms</div><p>Text of page {i}</p></article>") for i in range(12)]
    copies = [(100 + i, f"http://large.example.net/c{i}", f"<article><h1>Copy</h1><div>Read our terms</div><p>Copied text here</p>{table}</article>") for i in range(4)]
    adverts = [(200 + i, f"http://same.example.net/{i}", f"<nav>Menu {i}</nav><div class=ad>Buy {i}</div><article><h1>Same</h1><p>Copied text</p></article>") for i in range(5)]
    slots = [(300 + i, f"http://slot.example.net/{i}", f"<div class=x>Buy {i}</div><article><h1>Same</h1><p>Copied text that is much longer than the box</p></article>") for i in range(5)]
    by = {k[0]: v for k, v in texts(frame, large + copies + adverts + slots).items()}
    for i in range(12):
        assert by[i] == f"T{i}\nText of page {i}"
    for i in range(4):
        assert by[100 + i] == "Copy\nCopied text here\nOnly in one article"
    for i in range(5):
        assert by[200 + i] == "Same\nCopied text"
        assert by[300 + i] == "Same\nCopied text that is much longer than the box"


def test_names_bar_no_content(frame):
    article = "<article><div class=article-header><h1>Head {0}</h1></div><p>Text of page {0}</p></article>"
    wrappers = ['<div class="content has-sidebar">', "<div id=page class=no-sidebar>", "<div role=navigation>", "<form id=all>", "<div class=sidebar-right>", "<div class='post sidebar'>"]
    rest = ["<div class='comment-list'><article class=comment>Nice {0}</article></div>", "<div class=cookie-banner>Take {0}</div>", "<ul class=main-nav><li>Go {0}</ul>", "<div id=sidebar>Side {0}</div>"]
    pages = [(10 * k + i, f"http://w{k}.example.net/{i}", f"<body>{w}{article.format(i)}</div>{''.join(rest).format(i)}</body>") for k, w in enumerate(wrappers) for i in range(4)]
    pages += [(100 + i, f"http://bare.example.net/{i}", f"<body><div class=sidebar><h1>Head {i}</h1><p>Text of page {i}</p></div><div class=ad>Buy {i}</div></body>") for i in range(4)]
    pages += [(200 + i, f"http://all.example.net/{i}", f"<body><div class=comments><h1>Head {i}</h1><p>Text of page {i}</p></div></body>") for i in range(4)]
    for (k, _), v in texts(frame, pages).items():
        assert v == f"Head {k % 10}\nText of page {k % 10}", k


def test_elements_below_the_depth_limit_end_where_they_end(frame):
    deep = "<div>" * 150 + "<p>Deep {0}</p><nav><div>Menu {0}</div></nav><div class=comments><p>Nice {0}</p></div><p>Deeper {0}</p>" + "</div>" * 150
    pages = [(i, f"http://deep.example.net/{i}", f"<body><div><article><h1>T{i}</h1>{deep.format(i)}<p>After {i}</p></article></div><div>Around {i}</div></body>") for i in range(4)]
    for (i, _), v in texts(frame, pages).items():
        assert v == f"T{i}\nDeep {i}\nDeeper {i}\nAfter {i}"


def neutral(i, rng, host="http://plain.example.net/"):
    """A page whose parts have names that say nothing; its article is the longest part, its menu is links."""
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))
    menu = "".join(f"<div><a href=/{k}>{words(1)}</a></div>" for k in range(rng.randint(3, 7)))
    title, body = words(5), [words(rng.randint(10, 60)) for _ in range(rng.randint(2, 6))]
    parts = [f"<div class=c1>{menu}</div>", "<div class=c2>Our shop is open on all days of the week</div>", f"<div class=c3>{words(6)}</div>",
             f"<div class=c4><h1>{title}</h1>{''.join(f'<p>{b}</p>' for b in body)}</div>", f"<div class=c5>{words(4)}</div>"]
    return (i, f"{host}{i}", f"<html><body>{''.join(parts)}</body></html>"), "\n".join([title, *body])


def test_induction_alone_finds_the_content_of_neutral_pages(frame):
    import random

    rng = random.Random(2)
    made = [neutral(i, rng, f"http://h{i % 5}.example.net/") for i in range(200)]
    for names in (True, False):
        got = {r["page_id"]: r["text"] for r in W.main_text(frame([p for p, _ in made], "page_id bigint, url string, html string"), names=names).collect()}
        right = sum(got[p[0]] == text for p, text in made)
        assert right > 0.95 * len(made), right


def test_content_named_as_boilerplate_is_not_taken_for_its_length(frame):
    pages = [(i, f"http://c.example.net/{i}", f"<body><article><h1>T{i}</h1><p>Short {i}</p></article><div id=comments>{''.join(f'<p>long reader comment {i} {k}</p>' for k in range(40))}</div></body>") for i in range(6)]
    assert texts(frame, pages) == {(i, f"http://c.example.net/{i}"): f"T{i}\nShort {i}" for i in range(6)}


def test_many_skeletons_merge_in_rounds_and_lists_need_no_broadcast(frame, monkeypatch):
    monkeypatch.setattr(W, "FAN", 2)
    monkeypatch.setattr(W, "KEEP_BYTES", 0)
    pages = [(i, f"http://r.example.net/{i}", f"<body><nav>Menu</nav><article class=k{'abcdefghijklm'[i % 13]}><h1>A{i}</h1><p>Text of article {i}</p></article></body>") for i in range(26)]
    assert texts(frame, pages) == {(i, f"http://r.example.net/{i}"): f"A{i}\nText of article {i}" for i in range(26)}
