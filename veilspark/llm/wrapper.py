"""Main text of web pages by wrapper induction per host.

A page is read as a tree of block elements (inline markup is text). Siblings that repeat, such as
paragraphs and list items, are one node, so the tree is a short skeleton and pages of one template
share it. Per host:

1. pages are counted per skeleton, with a summary of each node's text (equal on all pages or not,
   characters, characters in links); summaries are made in the task first, so a host with a third
   of all pages is still a few rows;
2. skeletons are aligned by simple tree matching (the largest matching of two ordered trees that
   keeps labels, order and parents) and merged into the host's template, in rounds of ``FAN`` trees a
   group, so that no group grows with the host;
3. template nodes whose text is the same on all pages that have them, these being all pages of
   their template and with ``MIN_PAGES`` different contents at least, are template; the others are
   slots. The slots' text decides on the content first: it is the subtree that 80 % of the text outside of
   links leads to, step by step. Names (of elements, and in class, id and role, see ``bar``) decide where
   there is no such subtree below the page's body, or where it is named as boilerplate, and on what inside of
   the content is navigation, advert, notice, form or comment;
4. each skeleton is aligned with its host's template, which tells its constant nodes and the host's
   usual content subtree; a skeleton with less than half of its text there (another template on
   the same host, or unrelated pages of the empty host) gets a content subtree of its own. Pages
   are read again and joined with the nodes to keep by host and skeleton: these lists are broadcast while they
   are at most ``KEEP_BYTES``, so no page is shuffled and a hot host is no task of its own; beyond, the join deals
   the pages out by host and skeleton and leaves hot pairs to Spark's split of skewed joins.

Defined cases: null html is an empty page with empty text; a null url or one without ``://`` has
the empty host; copies of a content count once, and a host with fewer than ``MIN_PAGES`` different
contents has no constant nodes (nothing to compare); a page without text but constant text keeps
that; repeated rows and ids give one row each; elements nested deeper
than ``MAX_DEPTH`` count as part of the element there, or of the boilerplate they are in; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import cut
from veilspark.llm.urlfilter import host_of

MIN_PAGES = 3
MAX_DEPTH = 100
#: Constant text is copied content if it is so many times the varying text of its page.
COPIED = 4
FAN = 64
KEEP_BYTES = 32 << 20
FLUSH_SKELETONS = 20_000

RAW = "script|style|title|textarea|noscript|iframe|template|svg|math|select|object|canvas|audio|video"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>]*?/>|[^>]*>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<rest2>[^>]*)>|<[!?/][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[a-z]+(?:[0-9]{1,2}(?![0-9]))?")
FLOW = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr address details summary".split())
BOXES = set("html head body div section article main nav aside header footer form fieldset menu dialog center".split())
VOID = set("hr".split())
#: Elements that end an open one of the same kind or of the kinds listed, up to the nearest other box.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BOILERPLATE = set("head nav aside footer form fieldset menu dialog".split())
BOILERPLATE_WORDS = set(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "comment comments reply replies disqus sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead notice notices alert popup modal newsletter subscribe subscription signup login share "
    "social related recommended widget toolbar pagination pager hidden".split())
CONTENT_WORDS = set("article main post entry content story".split())
#: First words that make a compound name tell of a state of the page, as in ``has-sidebar``.
STATES = set("has have no not with without hide show use enable disable".split())
#: Last words of a compound name that do not change what it names, as in ``comment-list``.
NEUTRAL = CONTENT_WORDS | set(
    "list lists item items box boxes bar area section block wrap wrapper container inner outer link links button buttons "
    "top bottom left right primary secondary body text unit slot group panel row col column form icons".split())
#: Names that are never those of an element around the whole page.
PARTS_OF_PAGES = set(
    "ad ads advert advertisement advertising sponsor sponsored comment comments reply replies disqus related recommended "
    "breadcrumb breadcrumbs pagination pager".split())
#: Elements that may stand around the whole page.
AROUND = set("form fieldset menu dialog".split())


class Node:
    __slots__ = ("label", "kids", "number", "chars", "links", "texts")

    def __init__(self, label: str):
        self.label, self.kids, self.number, self.texts, self.chars, self.links = label, [], 0, [], 0, 0


def label_of(tag: str, rest: str) -> str:
    """Element with the names of its class, id and role, their words joined by ``-``; numbers
    are left out but for one or two digits right behind letters, as in ``col2`` (not ``post-12``)."""
    words = set()
    if rest and not rest.isspace():
        for name, value in ATTRIBUTE.findall(rest):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                words.update(w for w in ("-".join(NAME.findall(x)) for x in value.split()) if w)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                words.add("hidden")
    return ".".join([tag, *sorted(words)])


def read_page(source: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in order (children after parents) and blocks (node number, text)."""
    root = Node("")
    stack, blocks = [(root, "")], []
    text: list[str] = []
    linked, in_link = 0, False
    opened: dict[str, int] = {}

    def named(label: str) -> bool:
        return naming(label)[0] in BOILERPLATE or bool(naming(label)[1])

    def close_block() -> None:
        nonlocal linked
        words = " ".join(entities.unescape("".join(text)).split()) if text else ""
        if words:
            node = stack[-1][0]
            node.texts.append(words)
            node.chars += len(words)
            node.links += min(linked, len(words))
            blocks.append((node, words))
        text.clear()
        linked = 0

    def pop_to(k: int) -> None:
        close_block()
        for _, tag in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    at = 0
    for m in TOKEN.finditer(source):
        if m.start() > at:
            text.append(source[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m["raw"]:
                text.append(" ")
            continue
        tag = tag.lower()
        if tag not in FLOW and tag not in BOXES:
            if tag == "a":
                in_link = not (m["end"] or m["end2"])
            elif tag == "br":
                text.append(" ")
            continue
        if m["end"] or m["end2"]:
            if not opened.get(tag):
                if tag in FLOW and any(map(opened.get, BOXES)):
                    close_block()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] == tag:
                    pop_to(k)
                    break
                if stack[k][1] in BOXES and tag in FLOW:
                    close_block()
                    break
            continue
        close_block()
        if stack[-1][1] == "p":
            pop_to(len(stack) - 1)
        for k in range(len(stack) - 1, 0, -1):
            if not any(map(opened.get, ENDS.get(tag, ()))):
                break
            if stack[k][1] in ENDS[tag]:
                pop_to(k)
            elif stack[k][1] in BOXES or stack[k][1] in ("ul", "ol", "dl", "table"):
                break
        if tag in VOID:
            continue
        label, parent = label_of(tag, m["rest"] or m["rest2"]), stack[-1][0]
        if len(stack) > MAX_DEPTH and (named(parent.label) or not named(label)):
            # no node of its own, but its end tag has to find it
            stack.append((parent, tag))
            opened[tag] = opened.get(tag, 0) + 1
            continue
        kids = parent.kids
        if tag in FLOW:
            node = next((x for x in kids if x.label == label), None)
        else:
            node = kids[-1] if kids and kids[-1].label == label else None
        if node is None:
            kids.append(node := Node(label))
        stack.append((node, tag))
        opened[tag] = opened.get(tag, 0) + 1
    text.append(source[at:])
    close_block()
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(nodes)
        nodes.append(node)
        todo.extend(reversed(node.kids))
    return nodes, [(n.number, words) for n, words in blocks]


@lru_cache(maxsize=100_000)
def naming(label: str) -> tuple[str, frozenset[str], bool]:
    """Tag of a label, the boilerplate words that its names end in, and whether a name is one of content."""
    tag, *names = label.split(".")
    found, content = set(), False
    for name in names:
        words = [w.rstrip("0123456789") for w in name.split("-")]
        while len(words) > 1 and words[-1] in NEUTRAL and BOILERPLATE_WORDS & set(words[:-1]):
            words.pop()
        last = words[-1]
        if last not in BOILERPLATE_WORDS or words[0] in STATES:
            content = content or bool(CONTENT_WORDS & set(words))
        elif last not in ("header", "footer", "banner", "masthead") or not CONTENT_WORDS & set(words):
            found.add(last)
    return tag, frozenset(found), content


def bar(shape: list[tuple[str, list[int], int, int]]) -> list[bool]:
    """Per node (label, children's numbers, characters, those in links; parents first): whether it is boilerplate.

    That is an element or a name of boilerplate, with all inside. A name does not count beside one of
    content, nor where the element holds ``main``, all articles or, without any, most of the text; nor
    does any if no text were left.
    """
    size = len(shape)
    names = [naming(label) for label, *_ in shape]
    fixed, inside = [False] * size, [False] * size
    for i, (_, kids, *_) in enumerate(shape):
        tag = names[i][0]
        inside[i] = inside[i] or tag in ("article", "main")
        fixed[i] = fixed[i] or tag in BOILERPLATE and tag not in AROUND or tag == "header" and not inside[i]
        for k in kids:
            fixed[k], inside[k] = fixed[i], inside[i]
    mains, articles, sums = [0] * size, [0] * size, [0] * size
    for i in reversed(range(size)):
        (_, kids, chars, links), (tag, words, _) = shape[i], names[i]
        if not fixed[i]:
            mains[i] = (tag == "main") + sum(mains[k] for k in kids)
            articles[i] = (tag == "main" or tag == "article" and not words & PARTS_OF_PAGES) + sum(articles[k] for k in kids)
            sums[i] = max(0, chars - 2 * links) + sum(sums[k] for k in kids)
    barred = list(fixed)
    for i, (_, kids, *_) in enumerate(shape):
        tag, words, content = names[i]
        if tag == "article":
            words = words & {"comment", "comments", "ad", "ads", "related"}
        elif tag in ("html", "body", "main") or content:
            words = frozenset()
        elif words == {"header"} and inside[i]:
            words = frozenset()
        if words or tag in AROUND:
            holds = mains[i] or 0 < articles[i] == articles[0] or not articles[0] and 2 * sums[i] > sums[0]
            barred[i] = barred[i] or not holds or bool(words & PARTS_OF_PAGES) and not mains[i]
        for k in kids:
            barred[k] = barred[k] or barred[i]
    if not any(chars and not out for (_, _, chars, _), out in zip(shape, barred)):
        return fixed
    return barred


def set_barred(nodes: list[dict]) -> None:
    place = {id(x): i for i, x in enumerate(nodes)}
    for x, barred in zip(nodes, bar([(x["label"], [place[id(k)] for k in x["kids"]], x["chars"], x["links"]) for x in nodes])):
        x["barred"] = barred


def skeleton(nodes: list[Node]) -> str:
    return json.dumps([[n.label, [k.number for k in n.kids]] for n in nodes], separators=(",", ":"))


def _signed(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def summarise(pages: DataFrame) -> DataFrame:
    """(host, skeleton, node, n, low, high, chars, links, seen) from (host, html), one row per node.

    ``seen`` holds up to ``MIN_PAGES`` hashes of different contents (all that is not boilerplate), at
    the first node only.
    """

    def run(batches):
        held: dict[tuple[str, str], list] = {}

        def rows():
            out = [(h, s, k, n, *v, None if k else contents) for (h, s), (n, values, contents) in held.items() for k, v in enumerate(values)]
            held.clear()
            columns = list(zip(*out)) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                nodes, _ = read_page(source or "")
                key = (host, skeleton(nodes))
                barred = bar([(x.label, [k.number for k in x.kids], x.chars, x.links) for x in nodes])
                content = _signed("\n".join(t for x, out in zip(nodes, barred) if not out for t in x.texts))
                seen = [(_signed("\n".join(x.texts)), x.chars, x.links) for x in nodes]
                if key not in held:
                    held[key] = [1, [[h, h, c, k] for h, c, k in seen], [content]]
                else:
                    held[key][0] += 1
                    contents = held[key][2]
                    if len(contents) < MIN_PAGES and content not in contents:
                        contents.append(content)
                    for v, (h, c, k) in zip(held[key][1], seen):
                        v[0], v[1], v[2], v[3] = min(v[0], h), max(v[1], h), v[2] + c, v[3] + k
            if len(held) > FLUSH_SKELETONS:
                yield rows()
        yield rows()

    names = ["host", "skeleton", "node", "n", "low", "high", "chars", "links", "seen"]
    types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int64())]
    schema = "host string, skeleton string, node int, n long, low long, high long, chars long, links long, seen array<long>"
    parts = pages.select("host", "html").mapInArrow(run, schema)
    return parts.groupBy("host", "skeleton", "node").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("chars").alias("chars"), F.sum("links").alias("links"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))), 1, MIN_PAGES).alias("seen"))


def tree_of(shape: str, values: list[dict]) -> dict:
    """Nested template of one skeleton: label, n, low, high, chars, links, seen, number, kids."""
    nodes = [{"label": label, **v, "number": i} for i, ((label, _), v) in enumerate(zip(json.loads(shape), values))]
    for node, (_, kids) in zip(nodes, json.loads(shape)):
        node["kids"] = [nodes[k] for k in kids]
    return nodes[0]


def matching(a: dict, b: dict, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the largest matching of two trees, and the matched children."""
    if a["label"] != b["label"]:
        return 0, []
    key = (id(a), id(b))
    if key not in memo:
        rows, cols = len(a["kids"]), len(b["kids"])
        best = [[0] * (cols + 1) for _ in range(rows + 1)]
        score = [[matching(x, y, memo)[0] for y in b["kids"]] for x in a["kids"]]
        for i in range(1, rows + 1):
            for j in range(1, cols + 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + score[i - 1][j - 1])
        pairs, i, j = [], rows, cols
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        memo[key] = (1 + best[rows][cols], pairs[::-1])
    return memo[key]


def merge(a: dict, b: dict, memo: dict | None = None) -> dict:
    """``b`` merged into the template ``a``; children without a partner are added in place."""
    memo = {} if memo is None else memo
    partner = {j: i for i, j in matching(a, b, memo)[1]}
    for k in ("n", "chars", "links"):
        a[k] += b[k]
    a["seen"] = sorted({*a.get("seen", ()), *b.get("seen", ())})[:MIN_PAGES]
    a["low"], a["high"] = min(a["low"], b["low"]), max(a["high"], b["high"])
    kids, taken = [], 0
    for j, y in enumerate(b["kids"]):
        if j in partner:
            kids += a["kids"][taken : partner[j]]
            kids.append(merge(a["kids"][partner[j]], y, memo))
            taken = partner[j] + 1
        else:
            kids.append(y)
    a["kids"] = kids + a["kids"][taken:]
    return a


def merge_all(trees: list[dict]) -> dict:
    """Template of all trees, the frequent ones first."""
    trees = sorted(trees, key=lambda t: (-t["n"], json.dumps(t, sort_keys=True)))
    out = trees[0]
    for t in trees[1:]:
        out = merge(out, t)
    return out


def in_order(tree: dict) -> list[dict]:
    return [tree, *(x for k in tree["kids"] for x in in_order(k))]


def _weigh(nodes: list[dict], free: str) -> None:
    """Sets ``mass``, the text outside of links in the free nodes of each subtree."""
    for x in reversed(nodes):
        x["mass"] = (max(0, x["chars"] - 2 * x["links"]) if x[free] else 0) + sum(k["mass"] for k in x["kids"])


def _steps(top: dict) -> dict:
    """From ``top`` into the child that holds 80 % of the mass, as long as there is one that is a box."""
    while True:
        heavy = [k for k in top["kids"] if 10 * k["mass"] >= 8 * top["mass"] > 0 and k["label"].split(".")[0] in BOXES]
        if not heavy:
            return top
        top = heavy[0]


def choose(nodes: list[dict], offered: dict | None = None, names: bool = True) -> dict:
    """The content subtree: ``offered`` or the first named so, if it holds half of the free text; else by steps into the child with 80%."""
    _weigh(nodes, "free")
    named = [x for x in nodes if names and not x["barred"] and (naming(x["label"])[0] in ("article", "main") or naming(x["label"])[2])]
    top = next((x for x in ([offered] if offered else []) + named if 2 * x["mass"] >= nodes[0]["mass"] and x["mass"]), None)
    return top or _steps(nodes[0])


def bare(nodes: list[dict]) -> None:
    """Without names only the page's head is boilerplate."""
    for x in nodes:
        x["barred"] = x.get("barred", False) or x["label"] == "head"
        for k in x["kids"]:
            k["barred"] = x["barred"]


def mark_content(template: dict, names: bool = True) -> dict:
    """Sets ``constant`` (equal wherever it is, in ``MIN_PAGES`` different contents) and ``top`` (the host's usual content subtree) on the template's nodes.

    The subtree is found without names; they decide where that ends at the page's body, or at boilerplate.
    """
    nodes = in_order(template)
    (set_barred if names else bare)(nodes)
    for x in nodes:
        x["constant"] = bool(len(x["seen"]) >= MIN_PAGES and x["low"] == x["high"] and x["chars"])
        x["slot"] = not x["constant"] and 2 * x["links"] <= x["chars"] and x["label"] != "head"
        x["free"] = not x["barred"] and not x["constant"]
    _weigh(nodes, "slot")
    top = _steps(nodes[0])
    if names and (top["barred"] or top["label"].split(".")[0] in ("", "html", "body")):
        top = choose(nodes)
    for x in nodes:
        x["top"] = x is top
        del x["seen"]
    return template


def kept_nodes(template: dict, tree: dict, names: bool = True) -> tuple[list[int], list[int]]:
    """Numbers of a skeleton's nodes to keep, those of its own content subtree that are neither boilerplate nor constant,
    and of all that are not boilerplate, for pages without text in the former.

    The host's usual content subtree is taken where it holds half of this skeleton's text, so pages
    of another template than most of their host's have their own. Constant is what is equal on all
    pages that have it and on no fewer pages than the skeleton's largest slot, which are those of
    its template. Where that would be more than ``COPIED`` times the rest, the pages are copies of one
    content in which something small varies, and nothing is constant.
    """
    nodes = in_order(tree)
    (set_barred if names else bare)(nodes)
    memo: dict = {}

    def walk(t: dict, s: dict) -> None:
        s["partner"] = t
        for i, j in matching(t, s, memo)[1]:
            walk(t["kids"][i], s["kids"][j])

    walk(template, tree)
    slots = [x for x in nodes if not x["barred"] and "partner" in x and x["partner"]["low"] != x["partner"]["high"]]
    pages = max(((x["chars"] - 2 * x["links"], x["partner"]["n"]) for x in slots), default=(0, None))[1]

    def constant(x: dict) -> bool:
        t = x.get("partner")
        return pages is not None and t is not None and t["constant"] and t["n"] >= pages and x["low"] == x["high"] == t["low"]

    same = {id(x) for x in nodes if not x["barred"] and constant(x)}
    if sum(x["chars"] for x in nodes if id(x) in same) > COPIED * sum(x["chars"] for x in nodes if not x["barred"] and id(x) not in same):
        same = set()
    for x in nodes:
        x["free"] = not x["barred"] and id(x) not in same and (names or 2 * x["links"] <= x["chars"])
    top = choose(nodes, next((x for x in nodes if "partner" in x and x["partner"]["top"]), None), names)
    return [x["number"] for x in in_order(top) if x["free"]], [x["number"] for x in nodes if not x["barred"]]


def induce(pages: DataFrame, names: bool = True) -> DataFrame:
    """(host, skeleton, keep, spare) for all skeletons of all hosts."""
    value = F.struct("node", F.struct("n", "low", "high", "chars", "links", "seen").alias("v"))
    stats = cut(summarise(pages).groupBy("host", "skeleton").agg(F.transform(F.array_sort(F.collect_list(value)), lambda x: x.v).alias("values")))
    counted = ("n", "low", "high", "chars", "links")

    def tree(shape: str, values) -> dict:
        seen = [int(x) for x in values[0]["seen"]]
        return tree_of(shape, [{k: int(x[k]) for k in counted} | {"seen": seen} for x in values])

    def planted(frames):
        for pdf in frames:
            yield pd.DataFrame({"host": pdf["host"], "template": [json.dumps(tree(s, v)) for s, v in zip(pdf["skeleton"], pdf["values"])]})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "template": [json.dumps(merge_all([json.loads(t) for t in pdf["template"]]))]})

    def marked(frames):
        for pdf in frames:
            yield pd.DataFrame({"host": pdf["host"], "template": [json.dumps(mark_content(json.loads(t), names)) for t in pdf["template"]]})

    def align(frames):
        for pdf in frames:
            keep = [kept_nodes(json.loads(t), tree(s, v), names) for t, s, v in zip(pdf["template"], pdf["skeleton"], pdf["values"])]
            yield pd.DataFrame({"host": pdf["host"], "skeleton": pdf["skeleton"], "keep": [k for k, _ in keep], "spare": [k for _, k in keep]})

    templates = stats.select("host", "skeleton", "values").mapInPandas(planted, "host string, template string")
    while True:
        # a host's trees are dealt into groups of about FAN, until each host has one
        groups = templates.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("groups"))
        dealt = templates.join(groups, "host").withColumn("part", F.pmod(F.xxhash64("template"), F.col("groups")))
        several = not groups.filter("groups > 1").isEmpty()
        templates = dealt.select("host", "part", "template").groupBy("host", "part").applyInPandas(merged, "host string, template string")
        if not several:
            break
        templates = cut(templates)
    return stats.join(templates.mapInPandas(marked, "host string, template string"), "host").mapInPandas(align, "host string, skeleton string, keep array<int>, spare array<int>")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """Per row: id, url, host, text. ``names=False`` goes by the induced templates alone."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    keep = cut(induce(rows, names)).withColumn("skeleton", F.xxhash64("skeleton"))
    size = keep.agg(F.sum(F.length("host") + 4 * (F.size("keep") + F.size("spare")) + 64)).first()[0] or 0
    if size <= KEEP_BYTES:
        keep = F.broadcast(keep)

    def read(batches):
        for batch in batches:
            shapes, blocks = [], []
            for source in batch.column("html").to_pylist():
                nodes, found = read_page(source or "")
                shapes.append(skeleton(nodes))
                blocks.append([{"node": n, "text": t} for n, t in found])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "url", "host")), pa.array(shapes, pa.string()), pa.array(blocks, block_type)],
                ["id", "url", "host", "shape", "blocks"])

    block_type = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))
    schema = T.StructType([
        rows.schema["id"], rows.schema["url"], T.StructField("host", T.StringType()), T.StructField("shape", T.StringType()),
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("node", T.IntegerType()), T.StructField("text", T.StringType())])))])
    read_rows = rows.mapInArrow(read, schema).withColumn("skeleton", F.xxhash64("shape")).drop("shape")
    def kept(nodes: str):
        return F.array_join(F.transform(F.filter("blocks", lambda b: F.array_contains(nodes, b.node)), lambda b: b.text), "\n")

    text = F.coalesce(F.nullif(kept("keep"), F.lit("")), kept("spare"), F.lit(""))
    return read_rows.join(keep, ["host", "skeleton"], "left").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", text.alias("text"))
