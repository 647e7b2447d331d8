"""Main-text extraction with wrappers inferred by union-free regular expressions.

Every page is a stream of tags and texts. Tags make a page's expression, texts
become slots. Within a page, neighbouring repeats of the same run of items are
folded into a repeated group. Same-host expressions are then aligned one after
another: equal items merge, repeated groups merge with repeated groups, and
what has no partner becomes an optional group. The result is the host's
wrapper; each of its text slots records how many pages fill it and whether all
of them fill it with one text.

Main text is what fills the wrapper's main slots. A page is matched against its host's
wrapper, which gives each of its blocks a slot; the slot decides:

* parts that never hold the article (menus, headers, footers, asides, adverts,
  notices, forms, scripts, comments) make no slots;
* pages with an article element, or else a main element, and pages without have slots of their
  own; of the former, those within that element are main;
* of the latter, a slot is main except for its template texts: those that every page filling the slot has in it, where
  these pages differ elsewhere (copies of a page count as one). So the same words are template in one slot and
  text in another.

Which parts are outside is read from element names and, for want of better, from a list of class and
id words; a mark by such a word falls where it would leave a page without its article or without most of its text. Header elements
inside an article belong to it; articles inside marked parts (reader comments, teasers) do not count.

Scale: pages shrink to (host, expression) rows with slot statistics inside each
map task, so a host with a third of all pages sends a row for each of its
expressions from a task; expressions are aligned in chunks by their hash and the
chunks' wrappers again, in the same order however the pages are split, and page
texts never shuffle unless the wrappers outgrow the session's broadcast
threshold, when the join is an ordinary one that AQE may split.

Defined results: null or empty html gives an empty text; a page whose url has
no host belongs to the host ``''``; unclosed, unknown and stray tags are
tolerated; truncated comments and scripts end with the page; repeated rows each
keep theirs; an empty table gives an empty result; other columns pass through,
and names beginning with ``_hx_`` are reserved.
"""

from __future__ import annotations

import heapq
import html as references
import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby
from math import isqrt
from operator import itemgetter

import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import spool

MASKS = 1 << 29               # bits of ready masks that an alignment keeps
CHUNKS = (4096, 16, 16)       # groups of a host's distinct expressions, then of their wrappers
HELD = 100_000                # blocks of distinct expressions that a task holds before it sends them
SHAPES = 64                   # expressions whose blocks' slots a wrapper keeps ready
MATCHERS = 256                # wrappers that a task keeps ready
LONG_PATH = 400               # characters of a slot's path, beyond which its beginning is a hash
#: Fixed values of HTML: elements without an end tag, elements whose content is not markup,
#: inline elements (they do not break a block), and elements that close an open paragraph.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title svg math iframe object select".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
             "strike strong sub sup time tt u var".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
             "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary "
             "table tbody td tfoot th thead tr ul".split())
#: Elements and class or id words of page parts that are not the article. A class or id counts only as a whole
#: token: such words and the places and shapes they come with (site-header, main_nav), nothing else (related-work).
OUTSIDE = set("head nav header footer aside form button script style noscript template textarea title svg math "
              "iframe object select dialog menu label".split())
OUTSIDE_WORD = regex.compile(
    r"(?:^|\s)(?=\S)(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|sticky|fixed|mobile|cookie|"
    r"social|post|article|entry|user|email|site-?wide)[_-]+)*"
    r"(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|notice|gdpr|popup|modal|"
    r"sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|foot|comments?|replies|disqus|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget|pagination|pager|toolbar)"
    r"(?:[_-]+(?:ads?|banner|consent|notice|popup|modal|sidebar|menu|nav|navigation|header|footer|comments?|signup|"
    r"share|sharing|widget|toolbar|bar|box|container|wrapper|wrap|inner|list|links?|items?|section|block|area|form|"
    r"buttons?|icons?|posts?|articles?|slot|unit|left|right|top|bottom|primary|secondary|main|\d+))*(?=$|\s)", regex.I)
OUTSIDE_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "dialog", "alert"}
ARTICLE = {"article", "main"}
PLAIN = {"html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6"}        # never marked by an attribute
SOFT = {"form"}                                                             # marked as by an attribute
TAG = regex.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
                    regex.S)
ATTR = regex.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", regex.I | regex.S)
SELF_CLOSED = regex.compile(r"""(?:^|[\s"'])/\s*$""")                        # not the end of an unquoted value
ODD = regex.compile(r"[^\w:.-]")                                            # never part of a name in a path or a shape
COMMENTS = regex.compile(r"(?:comments?|replies|disqus)", regex.I)          # such marks do not fall for their length
SPACE = regex.compile(r"\s+")
HOST = r"^[^:/]*:?//([^/?#]*)"


# ------------------------------------------------------- token streams

def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): ``open``, ``close`` and ``text`` tokens; comments,
    declarations and the content of raw elements are skipped."""
    at = 0
    n = len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at:m.start()]
        at = m.end()
        slash, name, rest = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)   # 4-6: a tag with an unclosed quote
        if name is None:
            continue
        name = name.lower()
        if not name.isalnum():
            name = ODD.sub("_", name)
        if slash:
            yield "close", name, ""
            continue
        yield "open", name, rest
        if name in RAW and not SELF_CLOSED.search(rest):
            end = regex.compile(rf"</{regex.escape(name)}\s*>", regex.I).search(page, at)
            yield "close", name, ""
            at = end.end() if end else n


def label(name: str, attrs: str) -> str:
    """A tag as it stands in an expression: its name, and ``!`` if its class, id or role names a part outside."""
    if name in OUTSIDE:
        return name + "!"
    if name in PLAIN:
        return name
    for a, v in ATTR.findall(attrs) if attrs else ():
        a, v = a.lower(), v.strip("\"'")
        if (a in ("class", "id") and OUTSIDE_WORD.search(v)) or (a == "role" and v.lower() in OUTSIDE_ROLE) \
                or a == "hidden" or (a == "style" and regex.search(r"display\s*:\s*none", v, regex.I)):
            return name + "!"
    return name


class Tree:
    """The elements of a page. A path is its innermost element, so a block costs the same at any depth. ``mark`` is the
    nearest mark by an attribute at or above an element (0: none), ``hard`` whether a mark by name lies at or above it."""

    def __init__(self):
        self.up, self.label, self.mark, self.hard = [0], [""], [0], [False]
        self.above = [0]                                 # of a mark: the next mark around it
        self.stuck = {0: False}                          # of a mark: it is one of comments
        self.open = [0]
        self.at: dict[str, list[int]] = defaultdict(list)    # places of the open elements of a label

    def push(self, label: str, soft: bool, stuck: bool) -> int:
        top = self.open[-1]
        if soft:
            self.above.append(self.mark[top])
            self.stuck[len(self.above) - 1] = stuck
        self.up.append(top)
        self.label.append(label)
        self.mark.append(len(self.above) - 1 if soft else self.mark[top])
        self.hard.append(self.hard[top] or (label.endswith("!") and not soft))
        self.at[label].append(len(self.open))
        self.open.append(len(self.up) - 1)
        return self.open[-1]

    def cut(self, place: int) -> None:
        """Closes the element at a place of the open ones, and all within it."""
        while len(self.open) > place:
            self.at[self.label[self.open.pop()]].pop()

    def last(self, *labels: str) -> int:
        """The place of the innermost open element of these labels, 0 if there is none."""
        return max((self.at[x][-1] for x in labels if x in self.at and self.at[x]), default=0)

    def fallen(self, blocks: list[tuple[int, str]], frames: list[int]) -> set[int]:
        """The marks that fall. While no frame is free of marks, the outermost mark falls that holds more than half of the
        page's text outside the parts marked by name (a mark of comments only if it holds all of it)."""
        free = {0}
        if len(self.above) == 1:
            return free
        held = [0] * len(self.above)
        for k, text in blocks:
            if not self.hard[k]:
                held[self.mark[k]] += len(text)
        within = defaultdict(list)
        for m in range(len(held) - 1, 0, -1):            # a mark's number is larger than those around it
            held[self.above[m]] += held[m]
            within[self.above[m]].append(m)
        total = held[0]
        waiting = {self.mark[k] for k in frames if not self.hard[k]}
        ready: list[tuple[int, int]] = []
        last = 0
        while not (waiting & {last}):
            for m in within[last]:
                if held[m] and (held[m] == total if self.stuck[m] else 2 * held[m] > total):
                    heapq.heappush(ready, (-held[m], m))
            if not ready:
                break
            last = heapq.heappop(ready)[1]
            free.add(last)
        return free


def parse(page: str | None) -> tuple[list[tuple[str | None, str]], str | None]:
    """(path, text) of every block of a page, in order, and the page's frame: ``article`` or else ``main`` if it
    has such an element, even an empty one, that is not in a part outside. A path is the labels of the open elements but
    inline ones, None in a part outside; the beginning of a very long one is a hash, after which an article and a main
    element in it are named again.

    Inline elements do not break a block; ``br`` and all others do."""
    tree = Tree()
    blocks: list[tuple[int, str]] = []
    frames: list[tuple[str, int]] = []
    held: list[str] = []
    where = 0

    def flush():
        text = SPACE.sub(" ", references.unescape("".join(held))).strip()
        held.clear()
        return text

    for kind, name, rest in tokens(page or ""):
        if kind == "text":
            if not held:
                where = tree.open[-1]
            held.append(rest)
            continue
        own = name if kind == "close" or (name == "header" and tree.last("article")) else label(name, rest)
        if name not in INLINE or own.endswith("!") or (kind == "close" and tree.last(name + "!")):
            if held and (text := flush()):
                blocks.append((where, text))
        if kind == "open":
            if name in BLOCKS and (i := tree.last("p")):    # a block closes an open paragraph
                tree.cut(i)
            if name == "li" and (i := tree.last("li")) > tree.last("ul", "ol"):
                tree.cut(i)                             # an item closes the open item of its own list
            if name not in VOID and not SELF_CLOSED.search(rest):
                soft = own.endswith("!") and (name in SOFT or name not in OUTSIDE)
                k = tree.push(own, soft, soft and COMMENTS.search(rest) is not None)
                if name in ARTICLE:
                    frames.append((name, k))
        elif i := tree.last(name, name + "!"):
            tree.cut(i)
    if held and (text := flush()):
        blocks.append((where, text))
    free = tree.fallen(blocks, [k for _, k in frames])
    paths = {0: ""}

    def path(k: int) -> str | None:
        if tree.hard[k] or tree.mark[k] not in free:
            return None
        chain = []
        while k not in paths:
            chain.append(k)
            k = tree.up[k]
        s = paths[k]
        for k in reversed(chain):
            name = tree.label[k].rstrip("!")
            if name not in INLINE:
                s = f"{s}/{name}" if s else name
                if len(s) > LONG_PATH:
                    names = s.split("/")
                    s = "/".join(["~" + xxhash.xxh3_128_hexdigest(s), *(x for x in sorted(ARTICLE) if x in names)])
            paths[k] = s
        return s
    kinds = {name for name, k in frames if path(k) is not None}
    return [(path(k), text) for k, text in blocks], "article" if "article" in kinds else "main" if kinds else None


# ------------------------------------------------- union-free expressions
# An item is [path, blocks, first, last, common] for a slot with its place, or ["+", items] for a repeated
# and ["?", items] for an optional group. first and last are the smallest and largest hash of the pages that
# fill it (equal for one page and its copies), common the hashes of the texts that all of them have in it.

def same(a: list, b: list) -> bool:
    """Whether two items can stand for each other."""
    if a[0] in ("+", "?") or b[0] in ("+", "?"):
        if a[0] == b[0]:
            return len(a[1]) == len(b[1]) and all(map(same, a[1], b[1]))
        if a[0] in ("+", "?") and len(a[1]) == 1:        # a run or an optional item may be a single one
            return same(a[1][0], b)
        return b[0] in ("+", "?") and len(b[1]) == 1 and same(a, b[1][0])
    return a[0] == b[0]


def merged(a: list, b: list, one_page: bool = False) -> list:
    """One item for both: of different pages, or of one page, whose texts add up."""
    if a[0] in ("+", "?") and a[0] == b[0]:
        return [a[0], [merged(x, y, one_page) for x, y in zip(a[1], b[1])]]
    if a[0] in ("+", "?"):
        return [a[0], [merged(a[1][0], b, one_page)]]
    if b[0] in ("+", "?"):
        return [b[0], [merged(a, b[1][0], one_page)]]
    return [a[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3]), a[4] | b[4] if one_page else a[4] & b[4]]


def _halved(parts: list[list]) -> list:
    """One run for several that stand for each other, merged by halves: texts of a long run are copied log n times."""
    while len(parts) > 1:
        odd = parts[len(parts) // 2 * 2:]
        parts = [[merged(x, y, True) for x, y in zip(a, b)] for a, b in zip(parts[::2], parts[1::2])] + odd
    return parts[0]


def fold(items: list, one_page: bool = False) -> list:
    """Neighbouring repeats of a run of items become a repeated group; short runs first."""
    for width in range(1, 5):
        out: list = []
        i = 0
        while i < len(items):
            run = items[i:i + width]
            parts = [run]
            j = i + width
            while len(run) == width and j + width <= len(items) and all(map(same, run, items[j:j + width])):
                nxt = items[j:j + width]
                parts.append(nxt)
                if not one_page or any(x[0] in ("+", "?") or y[0] in ("+", "?") for x, y in zip(run, nxt)):
                    run = [merged(x, y, one_page) for x, y in zip(run, nxt)]      # may have become a group
                j += width
            if j > i + width:
                if one_page:
                    run = _halved(parts)
                out.append(run[0] if width == 1 and run[0][0] == "+" else ["+", run])
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _core(item: list) -> str:
    """The shape of an item without runs and optional groups of a single one: equal for items that are :func:`same`."""
    while item[0] in ("+", "?") and len(item[1]) == 1:
        item = item[1][0]
    return f"({' '.join(map(_core, item[1]))}){item[0]}" if item[0] in ("+", "?") else item[0]


def _partners(a: list, b: list) -> tuple[list[str], list[str], dict[str, list[str]]]:
    """The items' shapes, and for each shape of ``a`` those of ``b`` that can stand for it."""
    left, right = ([shape([x]) for x in items] for items in (a, b))
    cores: dict[str, list[str]] = defaultdict(list)
    ofs = dict(zip(right, b))
    for s, y in ofs.items():
        cores[_core(y)].append(s)
    return left, right, {s: [t for t in cores.get(_core(x), ()) if same(x, ofs[t])] for s, x in dict(zip(left, a)).items()}


def steps(a: list, b: list) -> Iterator[tuple[int | None, int | None]]:
    """Walks two expressions along their longest common items: (i, j) of items that stand for each other, (i, None) and
    (None, j) of those without a partner.

    Of several such ways it takes the one that pairs items as early as it can and then leaves ``a`` first. The table of
    lengths is kept as one bit for each cell, 1 where the length is that of the cell to the right; a row is made of the one
    below by a few operations on whole numbers, and only every sqrt(n)-th row is kept, the others are made again."""
    at = 0
    while at < min(len(a), len(b)) and same(a[at], b[at]):
        yield at, at
        at += 1
    n, m = len(a) - at, len(b) - at
    if not (n and m):
        yield from ((i, None) for i in range(at, len(a)))
        yield from ((None, j) for j in range(at, len(b)))
        return
    left, right, partners = _partners(a[at:], b[at:])
    spots: dict[str, list[int]] = defaultdict(list)      # bits of a shape: the last item of b has bit 0
    for k, s in enumerate(reversed(right)):
        spots[s].append(k)
    full = (1 << m) - 1
    masks: dict[str, int] = {}

    def mask(s: str) -> int:
        if s in masks:
            return masks[s]
        places = [k for t in partners[s] for k in spots[t]]
        if len(places) <= 8:
            return sum(1 << k for k in places)
        bits = bytearray(m // 8 + 1)
        for k in places:
            bits[k >> 3] |= 1 << (k & 7)
        got = int.from_bytes(bits, "little")
        if len(masks) * m < MASKS:
            masks[s] = got
        return got

    def above(row: int, s: str) -> int:
        if not partners[s]:
            return row
        u = row & mask(s)
        return ((row + u) | (row - u)) & full
    width = isqrt(n) + 1
    kept = {n: full}
    row = full
    for i in range(n - 1, -1, -1):
        row = above(row, left[i])
        if i % width == 0:
            kept[i] = row
    i = j = 0
    low = full                                           # the bits of the items of b from j on
    rows: list[int] = []                                 # from row ``i`` of a block down to the next kept one, last first
    while i < n and j < m:
        if right[j] in partners[left[i]]:
            yield at + i, at + j
            i, j, low = i + 1, j + 1, low >> 1
        else:
            if not rows:
                end = min((i // width + 1) * width, n)
                rows = [kept[end]]
                for r in range(end - 1, i - 1, -1):
                    rows.append(above(rows[-1], left[r]))
            if rows[-1] is rows[-2] or (rows[-1] & low).bit_count() == (rows[-2] & low).bit_count():
                yield at + i, None                       # as long without this item
                i += 1
            else:
                yield None, at + j
                j, low = j + 1, low >> 1
                continue
        if rows:
            rows.pop()
            if len(rows) == 1:
                rows = []
    yield from ((i, None) for i in range(at + i, len(a)))
    yield from ((None, j) for j in range(at + j, len(b)))


def align(a: list, b: list) -> list:
    """One expression that both match: longest common items merge, the rest becomes optional."""
    return fold(_align_in_order(a, b))


def _align_in_order(a: list, b: list) -> list:
    """The items of both, merged and optional ones, in the order of :func:`steps`."""
    out: list = []
    for i, j in steps(a, b):
        if i is not None and j is not None:
            out.append(merged(a[i], b[j]))
        else:
            x = b[j] if i is None else a[i]
            out.append(x if x[0] == "?" else ["?", [x]])
    return out


def expression(page: str | None) -> list:
    return page_items(*parse(page))[0]


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def page_items(found: list[tuple[str | None, str]], frame: str | None) -> tuple[list, list[str]]:
    """A page's expression over its blocks in no part outside, and the texts of these blocks. A slot's ``blocks`` are
    block numbers here. Slots of pages with a frame bear its name; their texts need no statistics."""
    paths = [f"{frame}>{path}" if frame else path for path, _ in found if path is not None]
    texts = [text for path, text in found if path is not None]
    whole = 0 if frame else xxhash.xxh64_intdigest("\n".join(x for pair in zip(paths, texts) for x in pair)) >> 1
    return fold([[p, [i], whole, whole, frozenset() if frame else frozenset([digest(t)])]
                 for i, (p, t) in enumerate(zip(paths, texts))], True), texts


def counted(items: list) -> list:
    """Items with numbers of blocks in place of the blocks."""
    return [[x[0], counted(x[1])] if x[0] in ("+", "?") else [x[0], len(x[1]), *x[2:]] for x in items]


def dumped(items: list) -> str:
    return json.dumps(items, default=sorted)


def loaded(text: str) -> list:
    def sets(items: list) -> list:
        return [[x[0], sets(x[1])] if x[0] in ("+", "?") else [*x[:4], frozenset(x[4])] for x in items]
    return sets(json.loads(text))


def aligned(by_shape: dict[str, list]) -> list:
    """One expression for several, in the order of their shapes."""
    w: list | None = None
    for s in sorted(by_shape):
        w = by_shape[s] if w is None else align(w, by_shape[s])
    return w


def shape(items: list) -> str:
    return " ".join(f"({shape(x[1])}){x[0]}" if x[0] in ("+", "?") else x[0] for x in items)


def slots(items: list) -> Iterator[list]:
    for x in items:
        if x[0] in ("+", "?"):
            yield from slots(x[1])
        else:
            yield x


# ------------------------------------------------- pages against a wrapper

def verdicts(items: list) -> list:
    """What matching needs of a wrapper: slots as [path, verdict], groups as they are. A verdict is True (main), False
    (not main), or the hashes of the slot's template texts."""
    out: list = []
    for x in items:
        if x[0] == "?":
            out += verdicts(x[1])                        # an optional item is an item that a page may lack
        elif x[0] == "+":
            out.append(["+", verdicts(x[1])])
        else:
            frame, _, path = x[0].rpartition(">")
            out.append([x[0], frame in path.split("/") if frame else sorted(x[4]) if x[2] != x[3] and x[4] else True])
    return out


def matched(wrapper: list, items: list) -> list[tuple[list, list | None]]:
    """(page slot, wrapper slot or None) of every slot of a page's expression: the longest common items."""
    pairs: list[tuple[list, list | None]] = []

    def pair(w: list, x: list) -> None:
        if x[0] == "+":
            for i, y in enumerate(x[1]):
                pair(w[1][i] if w[0] == "+" else w, y)
        else:
            while w[0] == "+":                           # a run of what was a run in some pages, too
                w = w[1][0]
            pairs.append((x, w))
    for i, j in steps(wrapper, items):
        if i is not None and j is not None:
            pair(wrapper[i], items[j])
        elif j is not None:
            pairs += [(y, None) for y in slots([items[j]])]
    return pairs


class Matcher:
    """Extracts pages with a host's wrapper; what an expression's shape means is worked out once."""

    def __init__(self, wrapper: str | None):
        self.wrapper = json.loads(wrapper) if wrapper else []
        self.known: dict[str, list] = {}

    def text(self, page: str | None) -> str:
        items, blocks = page_items(*parse(page))
        s = shape(items)
        if s not in self.known:
            if len(self.known) >= SHAPES:
                self.known.clear()
            at = {id(x): i for i, x in enumerate(slots(items))}
            got = sorted((at[id(x)], w[1] if w else True) for x, w in matched(self.wrapper, items))
            self.known[s] = [v if isinstance(v, bool) else frozenset(v) for _, v in got]
        main = []
        for x, v in zip(slots(items), self.known[s]):
            if v is not False:
                main += x[1] if v is True else [i for i in x[1] if digest(blocks[i]) not in v]
        return "\n".join(blocks[i] for i in sorted(main))


# ---------------------------------------------------------------- Spark

def _host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(""))


def page_shapes(pages: DataFrame) -> DataFrame:
    """(_hx_host, shape, items): a row for each distinct expression of a host and task, or several where a task holds much."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, list]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(h, s, dumped(i)) for h, own in held.items() for s, i in own.items()]
            held.clear()
            return pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows)], ["_hx_host", "shape", "items"])
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                items, texts = page_items(*parse(page))
                items = counted(items)
                own, s = held.setdefault(host, {}), shape(items)
                if s in own:
                    own[s] = [merged(x, y) for x, y in zip(own[s], items)]
                    continue
                own[s] = items
                size += 1 + len(texts)
                if size > HELD:
                    yield out()
                    size = 0
        if held:
            yield out()
    return pages.select(_host().alias("_hx_host"), "html").mapInArrow(run, "_hx_host string, shape string, items string")


def infer(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(_hx_host, wrapper, verdicts): each host's wrapper as JSON, and what matching needs of it."""
    kind = "_hx_host string, shape string, items string"

    def merge(rows: Iterable[tuple[str, str]]) -> list:
        own: dict[str, list] = {}
        for s, items in rows:
            got = loaded(items)
            own[s] = [merged(x, y) for x, y in zip(own[s], got)] if s in own else got
        return aligned(own)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            got = pa.record_batch([pa.array(c, pa.string()) for c in zip(*done)], ["_hx_host", "shape", "items"])
            done.clear()
            return got
        done: list[tuple[str, str, str]] = []
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for (host, _), group in groupby(rows, itemgetter(0, 1)):
            w = merge(row[2:] for row in group)
            done.append((host, shape(w), dumped(w)))
            if len(done) >= 500:
                yield out()
        if done:
            yield out()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        w = merge(zip(pdf["shape"], pdf["items"]))
        return pd.DataFrame({"_hx_host": pdf["_hx_host"].iloc[:1], "wrapper": [dumped(w)], "verdicts": [json.dumps(verdicts(w))]})
    # rows that merge are those of equal shapes or hashes, whatever tasks they come from
    rows = page_shapes(pages)
    for k in CHUNKS:
        rows = rows.select("_hx_host", F.pmod(F.xxhash64("shape"), F.lit(k)).alias("_c"), "shape", "items") \
            .repartition("_hx_host", "_c").sortWithinPartitions("_hx_host", "_c").mapInArrow(part, kind)
    return rows.groupBy("_hx_host").applyInPandas(whole, "_hx_host string, wrapper string, verdicts string")


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``pages`` (html dropped) with ``text``."""
    sp = spool(spark)
    wrappers = sp.put(infer(spark, pages)).select("_hx_host", F.col("verdicts").alias("_hx_wrapper"))
    carried = [c for c in pages.columns if c not in ("html", "text")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema if f.name in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers: dict[str | None, Matcher] = {}
        for b in batches:
            texts = []
            for page, wrapper in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if wrapper not in matchers:
                    if len(matchers) >= MATCHERS:
                        matchers.clear()
                    matchers[wrapper] = Matcher(wrapper)
                texts.append(matchers[wrapper].text(page))
            yield pa.record_batch([*(b.column(i) for i in range(len(carried))), pa.array(texts, pa.string())],
                                  [*carried, "text"])
    named = pages.withColumn("_hx_host", _host()).join(wrappers, "_hx_host", "left")
    return named.select(*carried, "html", "_hx_wrapper").mapInArrow(run, schema + "text string")
