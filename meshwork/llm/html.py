"""Main text of web pages by union-free wrapper inference.

A page's tag stream is read as a tree of labelled elements and text slots. Equal
neighbours fold into repeated groups, so each page is a regular expression
without unions of its own. Expressions of one host are aligned one after the
other: elements with equal labels merge, what one side lacks becomes optional,
one against many becomes repeated, and texts that differ become slots. The
outcome, the host's wrapper, says for each text slot whether its texts are main
text. Each page is matched against its host's wrapper, place by place, and its main
text is what its slots of that kind hold, inside of articles too.

Merging wrappers is the operation that merges pages. So tasks merge the pages
they hold, and a second step merges one partial wrapper a task and host: a host
with a third of all pages sends no more rows than others.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import html
import itertools
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import arrow_map, materialize, slices

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)>|<[!?/][^>]*>""", re.S)
_NAMED = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_WORD = re.compile("[a-z]+")

#: Fixed values of HTML: elements without content, with raw text, and inline ones.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the first kind ends an open element of the second.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: What isn't main text: elements, and words of class, id and role.
_OUT = frozenset("head script style noscript template nav footer aside form button select textarea input iframe object svg canvas audio video dialog menu title".split())
_OUT_WORDS = frozenset("ad ads advert adverts advertisement advertisements banner sponsor sponsored promo sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus replies widget toolbar pagination pager search skip complementary contentinfo".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN = frozenset(["article", "main"])
_MAIN_WORDS = frozenset("main article articlebody".split())

#: Outside of articles, the share of link characters above which a block is mostly links: a menu has little besides.
LINKS = 0.8

#: Bits of the table that an alignment keeps at once; above, one side is halved first.
TABLE_BITS = 1 << 26


def label_of(tag: str, attributes: str) -> str:
    """The element's name with the words of its class, id, role and itemprop."""
    if "=" not in attributes:
        return tag
    words = {w for k, v in _NAMED.findall(attributes) if k.lower() in ("class", "id", "role", "itemprop") for w in _WORD.findall(v.lower())}
    return " ".join([tag, *sorted(words)]) if words else tag


#: What ``events`` gives: an element opens (label), the innermost one closes, a text (block, raw text).
OPEN, CLOSE, TEXT = range(3)


class _Open:
    """The open elements: their names, how often each is open, and the places of those that aren't inline."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.number: Counter[str] = Counter()
        self.solid: list[int] = []

    def push(self, tag: str) -> None:
        if tag not in _INLINE:
            self.solid.append(len(self.names))
        self.names.append(tag)
        self.number[tag] += 1

    def cut(self, depth: int) -> int:
        """Closes down to ``depth`` elements; how many those are."""
        gone = len(self.names) - depth
        for tag in self.names[depth:]:
            self.number[tag] -= 1
        del self.names[depth:]
        while self.solid and self.solid[-1] >= depth:
            self.solid.pop()
        return gone

    def end(self, tag: str) -> int:
        """An end tag closes the innermost element of its name and all within; one without an element closes none."""
        if not self.number[tag]:
            return 0
        depth = len(self.names) - 1
        while self.names[depth] != tag:
            depth -= 1
        return self.cut(depth)

    def start(self, tag: str) -> int:
        """What a start tag closes: open elements that it ends, behind inline ones."""
        ends = _ENDS.get(tag, set()) | (set() if tag in _INLINE else {"p"})
        gone = 0
        while self.solid and self.names[self.solid[-1]] in ends:
            gone += self.cut(self.solid[-1])
        return gone


def events(page: str) -> Iterator[tuple[int, str | int, str]]:
    """The page as (OPEN, label, ""), (CLOSE, number of elements, "") and (TEXT, block, raw text), in order and in linear time."""
    open_ = _Open()
    at, block = 0, 0
    while at < len(page):
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            yield TEXT, block, page[at:end]
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in _INLINE:
            block += 1
        if m[1]:
            if gone := open_.end(tag):
                yield CLOSE, gone, ""
            continue
        if tag in _VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in _RAW:
            found = _raw_end(tag).search(page, at)
            stop = found.start() if found else len(page)
            if tag == "textarea":
                yield OPEN, tag, ""
                yield TEXT, block, page[at:stop]
                yield CLOSE, 1, ""
            at = found.end() if found else len(page)
            continue
        if gone := open_.start(tag):
            yield CLOSE, gone, ""
        open_.push(tag)
        yield OPEN, label_of(tag, m[3]), ""


@functools.lru_cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


def deep() -> None:
    """Lets trees be as deep as pages are: calls among Python functions take no C stack."""
    sys.setrecursionlimit(1 << 30)


# A node is [label, flags, pages, chars, constant, children]; flags: 1 optional, 2 repeated.
# A text slot's label is "#"; constant is its text, or of a long text its
# digest, as long as all agree, else None.


def _leaf(text: str) -> list:
    text = " ".join(text.split())
    return ["#", 0, 1, len(text), text if len(text) <= 200 else "\0" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), []]


def merge(a: list, b: list, *, apart: bool = True) -> list:
    """One node for two with equal labels; ``apart``: of different pages."""
    return [a[0], a[1] | b[1], a[2] + b[2] if apart else max(a[2], b[2]), a[3] + b[3], a[4] if a[4] == b[4] else None, align(a[5], b[5], apart=apart)]


def units(labels: list[str]) -> list[int]:
    """Each label's place in the sequence without its repeats: neighbours, or groups of any size, that come again take the places of the first.

    Small groups go first. Sequences are compared with themselves as arrays, so that
    wide elements cost array operations alone.
    """
    number = {x: k for k, x in enumerate(set(labels))}
    if len(number) == len(labels):
        return list(range(len(labels)))
    if len(number) == 1:
        return [0] * len(labels)
    ids = np.array([number[x] for x in labels], dtype=np.int32)
    place = np.arange(len(ids))
    size = 1
    while 2 * size <= len(ids):
        same = ids[size:] == ids[:-size]
        if np.count_nonzero(same) >= size:
            breaks = np.flatnonzero(np.r_[True, ~same, True])
            runs = np.diff(breaks) - 1
            if (long := np.flatnonzero(runs >= size)).size:
                to, kept = np.arange(len(ids)), np.ones(len(ids), dtype=bool)
                for k in long:
                    first, n = breaks[k], runs[k] // size * size
                    to[first + size : first + size + n] = np.resize(to[first : first + size], n)
                    kept[first + size : first + size + n] = False
                place = (np.cumsum(kept) - 1)[to][place]
                ids = ids[kept]
        size += 1
    return place.tolist()


def fold(nodes: list) -> list:
    """Equal neighbours, alone or in groups of any size, become repeated ones."""
    out: list = []
    for node, k in zip(nodes, units([x[0] for x in nodes]), strict=True):
        if k == len(out):
            out.append(node)
        else:
            out[k] = merge(out[k], node, apart=False)
            out[k][1] |= 2
    return out


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """After each of a's labels: the bits k for which b[: k + 1] has no more in common with a so far than b[:k]."""
    of: dict[str, int] = {}
    for k, x in enumerate(b):
        of[x] = of.get(x, 0) | 1 << k
    whole = (1 << len(b)) - 1
    row = whole
    for x in a:
        hit = row & of.get(x, 0)
        row = (row + hit | row - hit) & whole
        yield row


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The places in a and in b of a longest common subsequence, by bit rows; a is halved while their table is large."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    first = [(k, k) for k in range(head)]
    last = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(x) > 1 and len(x) * len(y) > TABLE_BITS:
        half = len(x) // 2
        left, right = 0, 0
        for left in _rows(x[:half], y):
            pass
        for right in _rows(x[half:][::-1], y[::-1]):
            pass
        best = have = (~right & (1 << len(y)) - 1).bit_count()
        cut = 0
        for k in range(len(y)):
            have += (~left >> k & 1) - (~right >> len(y) - 1 - k & 1)
            if have > best:
                best, cut = have, k + 1
        pairs = common(x[:half], y[:cut]) + [(i + half, j + cut) for i, j in common(x[half:], y[cut:])]
    else:
        rows, pairs = list(_rows(x, y)), []
        i, j = len(x), len(y)
        while i and j:
            if rows[i - 1] >> j - 1 & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i - 1] >> j - 1 & 1:
                j -= 1
                pairs.append((i, j))
        pairs.reverse()
    return first + [(i + head, j + head) for i, j in pairs] + last


def align(a: list, b: list, *, apart: bool = True) -> list:
    """The alignment of two sequences of nodes; what one side lacks is optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merge(x, y, apart=apart) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for to_i, to_j in [*common([x[0] for x in a], [x[0] for x in b]), (len(a), len(b))]:
        out += [[x[0], x[1] | 1, *x[2:]] for x in a[i:to_i] + b[j:to_j]]
        if to_i < len(a):
            out.append(merge(a[to_i], b[to_j], apart=apart))
        i, j = to_i + 1, to_j + 1
    return fold(out) if apart else out


def expression(page: str) -> list:
    """The page's own expression: its root's children. Elements without text are left out."""
    root: list = ["", 0, 1, 0, None, []]
    path: list[list | str] = [root]  # open elements: nodes, and labels of those that had no text yet
    made = 1

    def close() -> None:
        nonlocal made
        node = path.pop()
        if made > len(path):
            made = len(path)
            node[5] = fold(node[5])

    for kind, value, text in events(page):
        if kind == OPEN:
            path.append(value)
        elif kind == CLOSE:
            for _ in range(value):
                close()
        elif text.strip():
            for k in range(made, len(path)):
                path[k] = [path[k], 0, 1, 0, None, []]
                path[k - 1][5].append(path[k])
            made = len(path)
            path[-1][5].append(_leaf(text))
    while len(path) > 1:
        close()
    return fold(root[5])


def written(nodes: list) -> str:
    """Nodes, whose last entry holds their children or a value, as JSON of one flat list with their depths."""
    flat: list = []
    todo = [(0, x) for x in reversed(nodes)]
    while todo:
        depth, node = todo.pop()
        held = isinstance(node[-1], list)
        flat.append([depth, held, *(node[:-1] if held else node)])
        if held:
            todo += [(depth + 1, x) for x in reversed(node[-1])]
    return json.dumps(flat)


def read(text: str) -> list:
    """The nodes that ``written`` wrote."""
    under: list[list] = [[]]
    for depth, held, *node in json.loads(text):
        if held:
            node.append([])
        del under[depth + 1 :]
        under[-1].append(node)
        if held:
            under.append(node[-1])
    return under[0]


@functools.lru_cache(1 << 16)
def _out(label: str, inside: bool) -> bool:
    tag, *words = label.split(" ")
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":  # comments are often articles of their own; other words name what belongs to the article
        return "comment" in words
    if tag in _OUT or tag == "header" and not inside:  # an article's own header has its title
        return True
    return not (inside and (tag in _INLINE or tag in _HEADS)) and any(w in _OUT_WORDS for w in words)  # within an article inline elements are words of its sentences, headings its own


@functools.lru_cache(1 << 16)
def _main(label: str) -> bool:
    tag, *words = label.split(" ")
    return tag in _MAIN or any(w in _MAIN_WORDS for w in words)


def slots(wrapper: list, pages: int) -> list:
    """The wrapper as [label, flags, kind of a text slot or children of an element] nodes.

    Kinds: 2 varies within an article, 3 is fixed there, 1 varies outside and isn't
    mostly links, 0 is neither. A slot is fixed if its text is the same on most of
    the host's pages and the host has enough to tell. The slots between two block
    tags go together: none is fixed beside one that varies, and all are links if
    more than LINKS of their characters on all pages are. A fixed heading of an
    article stays where something varies under it, before the next heading.
    """
    runs: list[list[tuple[list, int, bool, bool, bool, bool]]] = [[]]
    headed = [False]

    def begin(head: bool) -> None:
        runs.append([])
        headed.append(head)

    def walk(nodes: list, dropped: bool, inside: bool, linked: bool, head: bool) -> list:
        out = []
        for label, flags, seen, chars, constant, children in nodes:
            if label == "#":
                out.append([label, flags, 0])
                if not dropped:
                    fixed = constant is not None and seen >= 3 and seen * 2 > pages
                    runs[-1].append((out[-1], chars, inside, linked, fixed, constant is None))
                continue
            tag = label.split(" ", 1)[0]
            if tag not in _INLINE:
                begin(head or tag in _HEADS)
            out.append([label, flags, walk(children, dropped or _out(label, inside), inside or _main(label), linked or tag == "a", head or tag in _HEADS)])
            if tag not in _INLINE:
                begin(head)
        return out

    out = walk(wrapper, False, False, False, False)
    over = under = False  # whether the block behind is a heading, and whether something varies from there to the next one
    for run, head in zip(reversed(runs), reversed(headed), strict=True):
        if not run:
            continue
        varies = any(v for *_, v in run)
        if head:
            varies = varies or under and run[0][2]
        else:
            under = run[0][2] and (varies or under and not over)
        over = head
        links = sum(n for _, n, _, linked, _, _ in run if linked) > LINKS * sum(n for _, n, *_ in run)
        for node, _, inside, _, fixed, _ in run:
            fixed = fixed and not varies
            node[2] = (3 if fixed else 2) if inside else int(not links and not fixed)
    return out


def positions(wrapper: list, labels: list[str]) -> list[int]:
    """The wrapper's node for each of a page's neighbours, -1 for none.

    The neighbours fold as the wrapper's did. What is left is aligned with the nodes
    that all pages have, as many as can be, then between these with the others. Where
    neighbours still have no place, those next to a repeated node go on in the
    repeated nodes around it.
    """
    by: dict[str, list[int]] = {}
    for j, node in enumerate(wrapper):
        by.setdefault(node[0], []).append(j)
    if all(len(js) == 1 for js in by.values()):
        return [by.get(x, (-1,))[0] for x in labels]
    place = units(labels)
    folded = [""] * (max(place, default=-1) + 1)
    for k, x in zip(place, labels, strict=True):
        folded[k] = x
    names = [x[0] for x in wrapper]
    needed = [j for j, x in enumerate(wrapper) if not x[1] & 1]
    node_of, i, j = [-1] * len(folded), 0, 0
    for to_i, n in [*common(folded, [names[k] for k in needed]), (len(folded), len(needed))]:
        to_j = needed[n] if n < len(needed) else len(names)
        for at, k in common(folded[i:to_i], names[j:to_j]):
            node_of[i + at] = j + k
        if to_i < len(folded):
            node_of[to_i] = to_j
        i, j = to_i + 1, to_j + 1
    out = [node_of[k] for k in place]
    _go_on(out, labels, wrapper, by, 1)
    _go_on(out, labels, wrapper, by, -1)
    return out


def _go_on(out: list[int], labels: list[str], wrapper: list, by: dict[str, list[int]], step: int) -> None:
    """Gives neighbours without a node that of their label which comes next, in steps of ``step``, in the ring of repeated nodes around the last one."""
    ring: list[tuple[int, int]] = []  # for each node, the repeated nodes around it
    at = 0
    for repeated, nodes in itertools.groupby(wrapper, lambda x: bool(x[1] & 2)):
        n = len(list(nodes))
        ring += [(at, at + n if repeated else at)] * n
        at += n
    near = -1
    for i in range(len(labels))[::step]:
        if out[i] < 0 <= near and ring[near][0] < ring[near][1]:
            js = by.get(labels[i], [])
            low, high = (bisect.bisect_left(js, x) for x in ring[near])
            if low < high:
                k = bisect.bisect_right(js, near) if step > 0 else bisect.bisect_left(js, near) - 1
                out[i] = js[k] if low <= k < high else js[low if step > 0 else high - 1]
        near = out[i] if out[i] >= 0 else near


def kinds_of(page: list[tuple[int, str | int, str]], wrapper: list) -> list[int]:
    """The kind of each of a page's texts (of its events): that of the slot at its place in the host's wrapper."""
    root: list = []
    open_: list[list] = [root]
    n = 0
    for kind, value, text in page:
        if kind == OPEN:
            open_.append([])
            open_[-2].append((value, open_[-1]))
        elif kind == CLOSE:
            del open_[len(open_) - value :]
        else:
            if text.strip():
                open_[-1].append(("#", n))
            n += 1
    kinds = [0] * n
    bare = _without_text(root)

    def walk(nodes: list, known: list, dropped: bool, inside: bool) -> None:
        nodes = [x for x in nodes if x[0] == "#" or id(x[1]) not in bare]
        for (label, held), j in zip(nodes, positions(known, [x[0] for x in nodes]), strict=True):
            if label == "#":  # a text without a slot counts as one that varies
                kinds[held] = known[j][2] if j >= 0 else 0 if dropped else 2 if inside else 1
            else:
                walk(held, known[j][2] if j >= 0 else [], dropped or _out(label, inside), inside or _main(label))

    walk(root, wrapper, False, False)
    return kinds


def _without_text(root: list) -> set[int]:
    """The identities of the child lists of elements without any text."""
    order: list[list] = [root]
    for nodes in order:
        order += [held for label, held in nodes if label != "#"]
    bare: set[int] = set()
    for nodes in reversed(order):
        if all(label != "#" and id(held) in bare for label, held in nodes):
            bare.add(id(nodes))
    return bare


def extract(page: str, wrapper: list) -> str:
    """The page's main text under its host's slots.

    Fixed texts of an article are its text only if it has no other: the host's
    pages then are copies, of which nothing can be told.
    """
    parsed = list(events(page))
    found = [(kind, block, text) for kind, (block, text) in zip(kinds_of(parsed, wrapper), [x[1:] for x in parsed if x[0] == TEXT], strict=True)]
    held = {k for k, _, t in found if t.strip()}
    best = next((k for k in (2, 3) if k in held), 1)
    parts: list[str] = []
    last = None
    for kind, block, text in found:
        if kind == best or not text.strip():
            if block != last:
                parts.append("\0")
                last = block
            parts.append(text)
    joined = "".join(parts).split("\0")
    return " ".join(t for b in joined if (t := " ".join(html.unescape(b).split())))


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", flush: int = 16 << 20) -> DataFrame:
    """host and its wrapper with each text slot's kind (JSON), from all of its pages.

    A task gives out the partial wrappers it holds once the longest page of each
    of their hosts come to ``flush`` characters.
    """
    rows = pages.select(host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        held: dict[str, tuple[int, list]] = {}
        longest: dict[str, int] = {}

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([written(w) for _, w in held.values()], pa.string())], names=["host", "pages", "wrapper"])

        for batch in slices(batches, 64):
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = expression(page)
                n, w = held.get(host, (0, None))
                held[host] = (n + 1, own if w is None else align(w, own))
                longest[host] = max(len(page), longest.get(host, 1000))
            if sum(longest.values()) > flush:
                yield given()
                held, longest = {}, {}
        if held:
            yield given()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        host, n, w = None, 0, None

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([written(slots(w, n))], pa.string())], names=["host", "slots"])

        for batch in slices(batches, 64):
            for h, k, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if h != host and w is not None:
                    yield given()
                    n, w = 0, None
                host, n, w = h, n + k, read(text) if w is None else align(w, read(text))
        if w is not None:
            yield given()

    parts = arrow_map(rows, partial, "host string, pages long, wrapper string")
    return arrow_map(parts.repartition("host").sortWithinPartitions("host", "pages", "wrapper"), whole, "host string, slots string")


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty page has the empty text. Pages without a host share one
    wrapper. Pages that are cut off, unclosed elements and stray tags are read as
    they come, in time linear in the page, however long or deep. Repeated rows
    repeat their results; an empty table gives no rows; other columns are ignored.
    """
    known = materialize(wrappers(pages, url_col=url_col, html_col=html_col), "html-wrappers")
    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(url_col).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        host, known_slots = None, []
        for batch in slices(batches, 64):
            out = []
            for text, h, s in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if h != host:
                    host, known_slots = h, read(s)
                out.append(extract(text, known_slots))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_map(rows.join(known, "host").select("page_id", "url", "html", "host", "slots"), run, f"page_id {kind}, url string, text string, n_chars long")
