"""Main text of web pages by wrapper induction over the pages of a host.

Pages are parsed to trees of block elements; siblings of one label are one slot. The different layouts
of a host each give a wrapper, the layout's most frequent tree. Every different page is aligned with
the wrapper that simple tree matching pairs best with it, and each text is counted in the slot where it
stands. A text that returns in its slot on most of the pages aligned there, while the pages
themselves differ, is constant: template. What varies is content, unless an element says of itself that
it is furniture (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments):
kinds and names of elements are evidence about slots that vary, and the weaker names give way to an
element that holds an article or most of the page's text that varies.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import bounded_batches, cut, fresh, keep, scratch, text_of
from tidewright.llm.url_filter import host_of

#: Different pages on which a text must return to be template, in slots outside of an article and inside,
#: and their least share of the pages aligned with the slot.
AGREE, AGREE_INSIDE, SHARE = 3, 5, 0.5
#: Code points of a text that marks pages as versions of one article if it is the longest of both.
SAME = 200
#: Least share of a host's pages that makes a layout a wrapper of its own; rarer ones go by the best other.
LAYOUT = 0.05
#: Bytes of wrappers that are sent to every task; beyond, pages are joined with them by host.
SENT = 32 << 20

# Kinds of HTML elements and names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol"
    " optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split())
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("nav footer aside menu dialog button select input label head search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies reply respond".split())
STRONG_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored cookie cookies consent gdpr popup modal overlay newsletter subscribe nav menu navbar navigation breadcrumb breadcrumbs"
    " footer sidebar related recommended recommendations share sharing social pagination pager".split()
)
WEAK_NAMES = frozenset("aside widget widgets promo promotion banner notice notices alert subscription signup header masthead discussion form search login toolbar".split())
CONTENT_NAMES = frozenset("article post entry story content main text body".split())
MODIFIERS = frozenset("with without no not has is hide show".split())

_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z0-9]+")
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")

#: What an element says of itself: nothing, or how far that is to be believed.
NONE, WEAK, STRONG, COMMENTS, KIND = range(5)


@functools.lru_cache(20_000)
def looks(tag: str, attributes: str) -> tuple[str, int]:
    """The label of an element, its kind and first class, and the evidence that it is furniture."""
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    names = found.get("class", "").split()
    own = found.get("id", "").strip()
    label = re.sub(r"\d+", "#", ".".join([tag, *(names[:1] or [own] * bool(own))])).replace("|", "/").replace(" ", "_")
    if tag in FURNITURE or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return label, KIND
    evidence = NONE
    if tag not in ("html", "body", "main"):
        evidence = STRONG if found.get("role", "") in FURNITURE_ROLES else WEAK if tag in ("form", "header") else NONE
        for name in [*names, *own.split()]:
            words = [x.rstrip("0123456789") or x for x in _NAME.findall(name)]
            if not words or words[0] in MODIFIERS:
                continue
            said = set(words)
            if said & COMMENT_NAMES:
                evidence = max(evidence, COMMENTS)
            elif said & STRONG_NAMES:
                evidence = max(evidence, STRONG)
            elif said & WEAK_NAMES and not said & CONTENT_NAMES:
                evidence = max(evidence, WEAK)
    return label, evidence


class Page:
    """tags, labels, evidence and parents of the elements in page order, the root first, and runs: (element,
    text) for each stretch of text between block boundaries, white space as single spaces."""

    def __init__(self, html: str):
        self.tags, self.labels, self.evidence, self.parents = ["html"], ["html"], [NONE], [-1]
        self._stack = [("html", 0)]
        self._open: dict[str, list[int]] = {}  # where in the stack each kind of element stands
        self._run: dict[int, int] = {}  # the run that goes on, of each open element
        self._runs: list[tuple[int, list[str]]] = []
        self._parse(html)
        self.runs = [(n, " ".join(words)) for n, parts in self._runs if (words := unescape("".join(parts)).split())]
        del self._stack, self._open, self._run, self._runs

    def _text(self, text: str) -> None:
        node = self._stack[-1][1]
        if node not in self._run:
            self._run[node] = len(self._runs)
            self._runs.append((node, []))
        self._runs[self._run[node]][1].append(text)

    def _push(self, tag: str, node: int) -> None:
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, node))

    def _cut(self, at: int) -> None:
        """Closes all elements from that place of the stack on."""
        while len(self._stack) > at:
            tag, node = self._stack.pop()
            self._open[tag].pop()
            self._run.pop(node, None) if node != self._stack[-1][1] else None
            if tag in BLOCK:
                self._run.pop(self._stack[-1][1], None)

    def _close(self, tags, bounds) -> None:
        """Closes the innermost of tags unless one of bounds is opened inside it."""
        place = max((self._open[t][-1] for t in tags if self._open.get(t)), default=-1)
        if place > 0 and (place == len(self._stack) - 1 or place > max((self._open[t][-1] for t in bounds if self._open.get(t)), default=-1)):
            self._cut(place)

    def _parse(self, html: str) -> None:
        """Tags that are missing or crossed are closed as browsers do; inline elements leave their text
        to the block around them. Linear in the page's length, whatever it holds."""
        at, size, quotes = 0, len(html), True
        while at < size:
            begin = html.find("<", at)
            if begin < 0:
                self._text(html[at:])
                return
            if begin > at:
                self._text(html[at:begin])
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 4)
                at = size if end < 0 else end + 3
                continue
            if html.startswith("<![CDATA[", begin):
                end = html.find("]]>", begin)
                self._text(html[begin + 9 : size if end < 0 else end].replace("&", "&amp;"))
                at = size if end < 0 else end + 3
                continue
            if html.startswith(("<!", "<?"), begin):
                end = html.find(">", begin)
                at = size if end < 0 else end + 1
                continue
            m = _TAG.match(html, begin)
            if m is None:
                self._text("<")
                at = begin + 1
                continue
            end = _INSIDE.match(html, m.end()).end() if quotes else html.find(">", m.end())
            if quotes and html[end : end + 1] != ">":
                quotes = False  # a quote that never ends: from here on tags end at the first >
                end = html.find(">", m.end())
            attributes = html[m.end() : size if end < 0 else end]
            at = size if end < 0 else end + 1
            if end < 0:
                return  # a tag that never ends
            if html[begin + 1] == "/":
                self._ends(m[1].lower())
            elif (raw := self._starts(m[1].lower(), attributes)) is not None:
                found = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.I).search(html, at)
                end = html.find(">", found.end()) if found else -1
                at = size if end < 0 else end + 1

    def _starts(self, tag: str, attributes: str) -> str | None:
        """The tag's name if what follows is no markup."""
        if tag in ("html", "body"):
            return None
        if tag in RAW and not attributes.endswith("/"):
            return tag
        if tag in VOID:
            self._text(" ")
            if tag == "hr":
                self._close(("p",), BLOCK - {"p"})
                self._run.pop(self._stack[-1][1], None)
            return None
        if tag in CLOSES_P and self._open.get("p"):
            self._close(("p",), BLOCK - {"p"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        label, evidence = looks(tag, attributes)
        if tag in BLOCK or evidence != NONE:
            if tag in BLOCK:
                self._run.pop(self._stack[-1][1], None)
            self.tags.append(tag)
            self.labels.append(label)
            self.evidence.append(evidence)
            self.parents.append(self._stack[-1][1])
            self._push(tag, len(self.tags) - 1)
        elif self._open.get(tag):  # an inline element of the kind of one that counts: their ends pair
            self._push(tag, self._stack[-1][1])
        return None

    def _ends(self, tag: str) -> None:
        places = self._open.get(tag)
        if tag == "br":
            self._text(" ")
        elif places and tag not in ("html", "body") and (tag in BLOCK or not any(t in BLOCK for t, _ in self._stack[places[-1] + 1 : places[-1] + 50])):
            self._cut(places[-1])


# -- slots ----------------------------------------------------------------------------------------


def slots(page: Page) -> tuple[str, list[int]]:
    """The tree of the page's slots, "parent label" joined by |, parents first; and each element's slot."""
    number: dict[tuple[int, str], int] = {(-1, page.labels[0]): 0}
    of = [0] * len(page.labels)
    for k in range(1, len(page.labels)):
        of[k] = number.setdefault((of[page.parents[k]], page.labels[k]), len(number))
    return "|".join(f"{parent} {label}" for parent, label in number), of


def text_sum(text: str) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 1) >> 1  # a long, never negative
    return x or 1


def layout(shape: str) -> str:
    """What tells a host's layouts apart: the slots of the first two levels below the root."""
    tree = [x.partition(" ") for x in shape.split("|")]
    top = {k for k, (p, _, _) in enumerate(tree) if p == "0"}
    return "|".join(sorted({label for p, _, label in tree if p == "0"} | {f"{tree[int(p)][2]} {label}" for p, _, label in tree if int(p) in top}))


def _tree(shape: str) -> tuple[list[int], list[str], list[list[int]]]:
    parents, labels = [], []
    for x in shape.split("|"):
        p, _, label = x.partition(" ")
        parents.append(int(p))
        labels.append(label)
    children: list[list[int]] = [[] for _ in labels]
    for k, p in enumerate(parents[1:], 1):
        children[p].append(k)
    return parents, labels, children


@functools.lru_cache(20_000)
def align(page: str, wrapper: str) -> tuple[int, ...]:
    """For each slot of the page the slot of the wrapper that simple tree matching pairs it with, or
    -1: equal labels pair, children pair in order, and the pairs are as many as possible.

    No two siblings have one label, so a slot can only pair with the one of the same path; which of
    them do is the heaviest increasing sequence among each slot's children, its subtrees being weighed
    before it."""
    _, la, ca = _tree(page)
    _, lb, cb = _tree(wrapper)
    if la[0] != lb[0]:
        return (-1,) * len(la)
    to = [-1] * len(la)
    to[0] = 0
    for a in range(len(la)):  # parents come first
        if to[a] >= 0 and ca[a]:
            own = {lb[k]: k for k in cb[to[a]]}
            for k in ca[a]:
                to[k] = own.get(la[k], -1)
    weight, chosen = [1] * len(la), [[] for _ in la]
    for a in range(len(la) - 1, -1, -1):
        pairs = [k for k in ca[a] if to[k] >= 0]
        if pairs:
            chosen[a], more = _heaviest(pairs, to, weight)
            weight[a] += more
    out = [-1] * len(la)
    todo = [0]
    while todo:
        a = todo.pop()
        out[a] = to[a]
        todo += chosen[a]
    return tuple(out)


def _heaviest(pairs: list[int], to: list[int], weight: list[int]) -> tuple[list[int], int]:
    """Of pairs, the subsequence with increasing to and the largest sum of weights, and that sum."""
    # Ends of sequences, by to; a heavier sequence always ends later.
    ends: list[int] = []
    sums: list[int] = []
    nodes: list[int] = []
    before: dict[int, int] = {}
    for k in pairs:
        at = bisect_left(ends, to[k])
        total = weight[k] + (sums[at - 1] if at else 0)
        before[k] = nodes[at - 1] if at else -1
        stop = at
        while stop < len(ends) and sums[stop] <= total:
            stop += 1
        ends[at:stop], sums[at:stop], nodes[at:stop] = [to[k]], [total], [k]
    out, k = [], nodes[-1]
    while k >= 0:
        out.append(k)
        k = before[k]
    return out, sums[-1]


def nearest(shape: str, wrappers: list[str]) -> tuple[int, tuple[int, ...]]:
    """Which wrapper pairs most slots with the page's, the first of equally good ones, and how."""
    found = [align(shape, w) for w in wrappers]
    best = max(range(len(found)), key=lambda k: (sum(x >= 0 for x in found[k]), -k))
    return best, found[best]


# -- text -----------------------------------------------------------------------------------------


def content(page: Page, template: set[int]) -> list[str]:
    """Texts of the runs, in page order, that belong to the page's main text. template: numbers of the
    runs that are constant over the host."""
    n = len(page.tags)
    held = [0] * n  # text that varies, in and below each element
    heading = [t in HEADINGS for t in page.tags]
    for k, (node, text) in enumerate(page.runs):
        if k not in template:
            held[node] += len(text)
    for k in range(n - 1, 0, -1):
        held[page.parents[k]] += held[k]
        heading[page.parents[k]] |= heading[k]

    # What each element says, and the worst that it or one around it says.
    says, worst, inside = [NONE] * n, [NONE] * n, [False] * n
    for k in range(1, n):
        p = page.parents[k]
        own_heading = page.tags[k] == "header" and page.evidence[k] == WEAK and inside[p] and heading[k]  # an article's
        says[k] = NONE if own_heading else page.evidence[k]
        worst[k] = max(worst[p], says[k])
        inside[k] = inside[p] or page.tags[k] in MAIN
    mains: list[int] = []
    for limit in (NONE, WEAK, STRONG):
        mains = [k for k in range(1, n) if page.tags[k] in MAIN and says[k] <= WEAK and worst[page.parents[k]] <= limit]
        if mains:
            break
    free = set(mains)  # what an article stands in can't be furniture, whatever its name
    for k in mains:
        while (k := page.parents[k]) >= 0 and k not in free:
            free.add(k)

    starts, whole = set(mains), held[0]
    within, out = [not mains] + [False] * (n - 1), [False] * n
    for k in range(1, n):
        p = page.parents[k]
        within[k] = within[p] or k in starts
        most = says[k] == WEAK and 2 * held[k] > whole or says[k] == STRONG and 10 * held[k] > 9 * whole and heading[k]
        out[k] = out[p] or says[k] != NONE and k not in free and not most
    return [text for k, (node, text) in enumerate(page.runs) if within[node] and not out[node] and k not in template]


def main_text(html: str, wrappers: list[str] | None = None, constant: list[dict] | None = None) -> str:
    """The main text of a page. wrappers: those of its host; constant: (wrapper, slot, sum) of the texts
    that are template."""
    page = Page(html)
    template: set[int] = set()
    if wrappers and constant:
        shape, of = slots(page)
        which, to = nearest(shape, wrappers)
        fixed = {(x["slot"], x["sum"]) for x in constant if x["wrapper"] == which}
        template = {k for k, (node, text) in enumerate(page.runs) if (to[of[node]], text_sum(text)) in fixed} if fixed else template
    return "\n\n".join(content(page, template))


# -- wrappers -------------------------------------------------------------------------------------


def skeleton(html: str) -> tuple[str, str, bytes, bytes, int]:
    """(layout, shape, slots and sums of the texts, identity) of a page, each text once. Pages whose
    longest text is the same, and no short line, have one identity; others have each their own."""
    page = Page(html)
    shape, of = slots(page)
    found = sorted({(of[node], text_sum(text)) for node, text in page.runs})
    longest = max((text for _, text in page.runs), key=lambda t: (len(t), t), default="")
    identity = text_sum(longest if len(longest) >= SAME else repr(found))
    return layout(shape), shape, np.array([s for s, _ in found], np.int32).tobytes(), np.array([x for _, x in found], np.int64).tobytes(), identity


def _within_main(wrapper: str) -> list[bool]:
    parents, labels, _ = _tree(wrapper)
    out = [False] * len(labels)
    for k in range(1, len(labels)):
        out[k] = out[parents[k]] or re.split(r"[.]", labels[k])[0] in MAIN
    return out


def wrappers(pages: DataFrame, *, url: str = "url", html: str = "html", agree: int = AGREE, agree_inside: int = AGREE_INSIDE, share: float = SHARE) -> DataFrame:
    """(host, wrappers, constant): each host's wrappers, and the texts that are constant in their slots
    as (wrapper, slot, sum); only hosts that have any. Pages that are copies of each other count once, and
    a text that only versions of one article share is not template."""
    bounded_batches(pages.sparkSession)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*(skeleton(t) for t in b.column(1).to_pylist()), strict=True)) or [[]] * 5
            kinds = pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64()
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["host", "layout", "shape", "slots", "sums", "identity"])

    own = cut(pages.select(host_of(F.col(url)).alias("host"), text_of(pages[html]).alias("_h")).mapInArrow(parsed, "host string, layout string, shape string, slots binary, sums binary, identity bigint").distinct(), "skeletons")
    counted = own.groupBy("host", "layout", "shape").agg(F.count(F.lit(1)).alias("n"))
    layouts = counted.groupBy("host", "layout").agg(F.max(F.struct("n", "shape")).alias("x"), F.sum("n").alias("pages"))
    most = layouts.groupBy("host").agg(F.max(F.struct("pages", "x.shape")).alias("top"), F.sum("pages").alias("all")).where(F.col("all") >= agree)
    big = layouts.join(most, "host").where((F.col("pages") >= LAYOUT * F.col("all")) & (F.col("pages") >= agree)).select("host", (-F.col("pages")).alias("p"), "x.shape")
    more = big.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("p", "shape"))).alias("l"))  # 1 / LAYOUT at most
    shapes = F.array_union(F.array("top.shape"), F.coalesce(F.col("l.shape"), F.array().cast("array<string>")))
    best = cut(most.join(more, "host", "left").select("host", shapes.alias("wrappers")), "wrappers")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple, list] = {}
            for host, shape, slot, total, identity, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                which, to = nearest(shape, known)
                for w in {x for x in to if x >= 0}:  # the page has the slot
                    seen.setdefault((host, which, w, 0), [0, 0, 0])[0] += 1
                pairs = {(to[s], x) for s, x in zip(np.frombuffer(slot, np.int32).tolist(), np.frombuffer(total, np.int64).tolist(), strict=True)}
                for w, x in pairs:
                    if w >= 0:
                        own = seen.setdefault((host, which, w, x), [0, identity, identity])
                        own[0] += 1
                        own[1], own[2] = min(own[1], identity), max(own[2], identity)
            rows = [(*key, *value) for key, value in seen.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["host", "wrapper", "slot", "sum", "n", "lo", "hi"])

    aligned = own.join(best, "host").select("host", "shape", "slots", "sums", "identity", "wrappers")
    texts = aligned.mapInArrow(summed, "host string, wrapper int, slot int, sum bigint, n bigint, lo bigint, hi bigint").groupBy("host", "wrapper", "slot", "sum").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    texts = cut(texts.where((F.col("sum") == 0) | (F.col("n") >= min(agree, agree_inside)) & (F.col("lo") < F.col("hi"))), "slots")
    place = ["host", "wrapper", "slot"]
    found = texts.where("sum <> 0").join(texts.where("sum = 0").select(*place, F.col("n").alias("pages")), place).where(F.col("n") >= F.col("pages") * share)
    lists = found.groupBy("host").agg(F.collect_list(F.struct("wrapper", "slot", "sum", "n")).alias("constant"))  # 1 / share texts for each of a page's

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for known, constant in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                inside = [_within_main(w) for w in known]
                out.append([{k: x[k] for k in ("wrapper", "slot", "sum")} for x in constant if x["n"] >= (agree_inside if inside[x["wrapper"]][x["slot"]] else agree)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.struct([("wrapper", pa.int32()), ("slot", pa.int32()), ("sum", pa.int64())])))], names=["host", "wrappers", "constant"])

    return cut(best.join(lists, "host").select("host", "wrappers", "constant").mapInArrow(settled, "host string, wrappers array<string>, constant array<struct<wrapper:int,slot:int,sum:bigint>>").where("size(constant) > 0"), "templates")


def extract(pages: DataFrame, *, url: str = "url", html: str = "html", agree: int = AGREE, agree_inside: int = AGREE_INSIDE, share: float = SHARE, sent: int = SENT) -> DataFrame:
    """pages, without html, with text: the main text of each page, its blocks joined by two line
    ends; empty if there is none. Null html counts as empty, null urls are one host, pages are read
    whole, however deep or broken, repeated rows give a row each, an empty table an empty result; a
    column named text is replaced."""
    with scratch(pages.sparkSession):
        found = keep(wrappers(pages, url=url, html=html, agree=agree, agree_inside=agree_inside, share=share))
    size = found.agg(F.sum(F.length(F.array_join("wrappers", "")) + 16 * F.size("constant"))).first()[0] or 0
    rest = [c for c in pages.columns if c not in (html, "text")]
    host = fresh(pages.columns, "_host")
    found = found.toDF(host, "_w", "_c")
    own = pages.select(*rest, host_of(F.col(url)).alias(host), text_of(pages[html]).alias("_h"))
    joined = own.join(F.broadcast(found) if size <= sent else found, host, "left").select(*(own[c] for c in rest), own["_h"], found["_w"], found["_c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = b.num_columns
            out = [main_text(*row) for row in zip(*(b.column(k).to_pylist() for k in range(last - 3, last)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(out, pa.string())], names=[*b.schema.names[:-3], "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*rest).schema), "text string"])
    return joined.mapInArrow(run, schema)
