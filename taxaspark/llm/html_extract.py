"""Main-text extraction by equivalence classes of page tokens.

Pages of one host are dealt into groups of about ``GROUP_PAGES`` by a hash of the page; a group
is what the template is deduced from.  A page becomes a list of tokens: the opening and
closing tags of its blocks, told apart by their path, and the words of its text, told apart by
path and by whether they begin or end a block.

1. Tokens with the same vector of occurrence counts over the group's pages form an
   equivalence class.  It counts if it stands in half of the pages, and in ``MIN_PAGES``,
   and has ``MIN_TOKENS`` tokens.
2. It is valid if its tokens repeat in one order in every page; tokens that come in another
   order by chance are taken out, the one out of place by most first.
3. Valid classes that do not cross nest into the template: in each page all occurrences of
   one lie within slots (gaps between successive tokens) of the other.
4. A block whose words all belong to one class of the template is template text.  All other
   text stands in the template's slots and varies.
5. The article is the element of the template, standing once in a page, that holds the text
   that varies: from the page's root down, as long as a part holds at least half of it and
   leaves out no heading and no fifth of it.  ``article`` and ``main`` decide ties: such a
   part is entered although it leaves something out, and not left again.
6. What the page has in that element's slots is extracted.

Elements that are no article text by their role are left out of both: navigation, asides,
footers, forms, scripts; and containers with a class or id that says advert, comments and the
like (``NAMED``), or a vaguer one (``VAGUE``) if they are mostly links.  An element that
holds the page's first heading or an ``article`` is never one of them.

A page that lacks the template's element (cut short, or of another template) is judged by its
own structure; so are hosts with fewer than ``MIN_PAGES`` different pages, which have no
template text.  If all text in the article's slots is template text, it stays.

Text: character references decoded, white space within a block one space, blocks
trimmed, empty ones left out, joined by a line feed.  A null or empty page gives an
empty text, and so does a page that ends before its article starts (no end tags, and only
blocks that stand before the article on its host).  Null urls are one
host without a name.  Repeated rows give a row each and count once for the template; extra
columns are ignored; an empty table gives no rows.

A host of many pages is many groups, so no task holds a whole host.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import grouped
from .scratch import Scratch

GROUP_PAGES = 48
GROUP_BYTES = 4 << 20
SALTS = 32
MIN_PAGES = 4
MIN_TOKENS = 3

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*.?true", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: never text of a page
SILENT = set("script style noscript iframe template head title svg object canvas noembed noframes xmp textarea select option button dialog".split())
#: parts of a page beside its article
BESIDE = set("nav aside footer form menu".split())
BESIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu", "menubar"}
CONTAINERS = {"div", "section", "aside", "ul", "ol", "dl", "table", "header", "footer", "details", "center", "nav", "span"}
#: words of class and id values that name what a container holds
NAMED = set("ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent notice notices popup modal overlay newsletter subscribe signup share sharing social sidebar breadcrumb breadcrumbs nav navbar navigation menu pagination pager toolbar masthead comments comment disqus".split())
#: words that do so only for a list of links
VAGUE = set("related recommended header footer side search widget login reply replies respond tags banner subscription aside promotion".split())


def tokens(html: str) -> list[tuple[str, str, str]]:
    """(kind, name, rest): kind is open, close or text; rest is the attributes or the text."""
    out, at, n = [], 0, len(html)
    for m in iter(lambda: _TOKEN.search(html, at), None):
        if m.start() > at:
            out.append(("text", "", html[at : m.start()]))
        at = m.end()
        slash, name, rest, end = (m[1], m[2], m[3], m[4]) if m[2] else (m[5], m[6], m[7], m[8])
        if not name or not end:  # a comment or declaration, or a tag that the page's end cuts off
            if at >= n:
                break
            continue
        name = name.lower()
        if slash:
            out.append(("close", name, ""))
            continue
        out.append(("open", name, rest))
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = close.start() if close else n
        if at >= n:
            break
    if at < n:
        tail = html[at:]
        cut = re.search(r"<(?:[a-zA-Z/!?][^>]*)?\Z", tail)
        out.append(("text", "", tail[: cut.start()] if cut else tail))
    return out


def signature(name: str, rest: str) -> tuple[str, str]:
    """The element's name with class and id (runs of digits alike), and its role: silent, beside, vague, main or none."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(rest)} if "=" in rest else {}
    sig = name
    if found:
        sig += "".join(f".{v}" for v in sorted(_DIGITS.sub("0", found.get("class", "")).split())) + (f"#{_DIGITS.sub('0', found['id'])}" if found.get("id") else "")
    if name in SILENT or rest and name not in ("body", "html") and _HIDDEN.search(rest):
        return sig, "silent"
    if name in ("article", "main") or found.get("role") in ("article", "main"):
        return sig, "main"
    if name in BESIDE or found.get("role") in BESIDE_ROLES:
        return sig, "beside"
    if found and name in CONTAINERS:
        words = set(re.split(r"[^a-z0-9]+", found.get("class", "") + " " + found.get("id", "")))
        if words & NAMED:
            return sig, "beside"
        if words & VAGUE:
            return sig, "vague"
    return sig, "vague" if name == "header" else ""


class Page:
    """A page's elements in order with their paths, and its text in blocks of (element, text) pieces."""

    __slots__ = ("paths", "parents", "names", "roles", "links", "order", "blocks", "cut", "out")

    def __init__(self, html: str):
        self.paths: list[str] = ["#"]
        self.parents: list[int] = [-1]
        self.names: list[str] = ["#"]
        self.roles: list[str] = [""]
        self.links: list[bool] = [False]
        self.order: list[tuple[str, int]] = []  # ("<", element), ("/", element) or ("b", block)
        self.blocks: list[list[tuple[int, str]]] = []
        self.cut = True  # no end of body or html
        stack = [0]
        opened: Counter = Counter()
        part: list[tuple[int, str]] = []

        def end_block() -> None:
            nonlocal part
            if any(not said.isspace() for _, said in part):
                self.order.append(("b", len(self.blocks)))
                self.blocks.append(part)
            part = []

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                e = stack.pop()
                opened[self.names[e]] -= 1
                if self.names[e] in BLOCKS:
                    end_block()
                    self.order.append(("/", e))

        def nearest(name: str) -> int:
            return next(i for i in range(len(stack) - 1, -1, -1) if self.names[stack[i]] == name)

        for kind, name, rest in tokens(html):
            if kind == "text":
                part.append((stack[-1], rest))
            elif kind == "close":
                if name in ("body", "html"):
                    self.cut = False
                if opened[name]:
                    pop_to(nearest(name))
                elif name in ("p", "br"):
                    end_block()
            else:
                if name in CLOSES_P and opened["p"]:
                    pop_to(nearest("p"))
                elif name in ("li", "td", "th", "tr", "dd", "dt", "option") and self.names[stack[-1]] == name:
                    pop_to(len(stack) - 1)
                if name in BLOCKS:
                    end_block()
                if name in VOID or rest.endswith("/") and name in ("svg", "path"):
                    if name in ("br", "wbr"):
                        part.append((stack[-1], " "))
                    continue
                sig, role = signature(name, rest)
                up = stack[-1]
                path = self.paths[up]
                # inline elements do not lengthen paths, and very deep ones share their last
                self.paths.append(f"{path}/{sig}" if name in BLOCKS and path.count("/") < 40 else path)
                self.parents.append(up)
                self.names.append(name)
                self.roles.append(role)
                self.links.append(self.links[up] or name == "a")
                e = len(self.names) - 1
                stack.append(e)
                opened[name] += 1
                if name in BLOCKS:
                    self.order.append(("<", e))
        pop_to(1)
        end_block()
        self.out = self._left_out()

    def _left_out(self) -> list[bool]:
        """Whether an element is no article text by its role or an outer one's."""
        n = len(self.names)
        holds = [False] * n  # the first heading or an article
        first = next((e for e in range(n) if self.names[e] == "h1"), None)
        for e in range(n - 1, 0, -1):
            holds[e] = holds[e] or e == first or self.roles[e] == "main"
            holds[self.parents[e]] = holds[self.parents[e]] or holds[e]
        size, linked = [0] * n, [0] * n
        for block in self.blocks:
            for e, said in block:
                size[e] += len(said)
                linked[e] += len(said) if self.links[e] else 0
        for e in range(n - 1, 0, -1):
            size[self.parents[e]] += size[e]
            linked[self.parents[e]] += linked[e]
        out = [False] * n
        for e in range(1, n):
            role = self.roles[e]
            vague = role == "vague" and (2 * linked[e] >= size[e] or self.names[e] == "header" and self.names[self.parents[e]] in ("body", "html", "#"))
            out[e] = out[self.parents[e]] or role == "silent" or (role == "beside" or vague) and not holds[e]
        return out

    def tags(self) -> list[str]:
        """Block elements in page order, by path."""
        return [self.paths[e] for kind, e in self.order if kind == "<"]

    def said(self, b: int) -> list[str]:
        """Words of a block, all pieces."""
        return "".join(x for _, x in self.blocks[b]).split()

    def text(self, root: str | None, dropped: set[int]) -> str:
        """Blocks within elements of path ``root`` that are not left out, but those ``dropped``."""
        inside = [False] * len(self.names)
        for e in range(1, len(inside)):
            inside[e] = inside[self.parents[e]] or self.paths[e] == root and self.names[e] in BLOCKS and not self.out[e]
        if root == "#":
            inside = [True] * len(inside)
        parts = ("".join(x for e, x in block if inside[e] and not self.out[e]) for b, block in enumerate(self.blocks) if b not in dropped)
        return "\n".join(x for x in (_SPACE.sub(" ", unescape(p)).strip() for p in parts) if x)


class Class:
    """An equivalence class: its tokens in order, and for each page the places of its occurrences (k x tokens)."""

    __slots__ = ("tokens", "places")

    def __init__(self, members: list[int], places: list[np.ndarray]):
        self.tokens, self.places = members, places


class Template:
    """Tokens of a group's different pages, and the valid nested classes among them."""

    def __init__(self, pages: list[Page]):
        self.pages = pages
        self.sequences: list[np.ndarray] = []
        self.spans: list[list[tuple[int, int]]] = []  # of each block's words in the sequence
        self.classes: list[Class] = []
        number = count().__next__
        self.tags: dict[str, int] = defaultdict(number)
        words_of: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(number))
        for page in pages if len(pages) >= MIN_PAGES else ():
            seq, spans = [], [(0, 0)] * len(page.blocks)
            for kind, k in page.order:
                if kind != "b":
                    seq.append(self.tags[kind + page.paths[k]])
                    continue
                words = page.said(k)
                words[0] = "^" + words[0]
                words[-1] += "$"
                spans[k] = (len(seq), len(seq) + len(words))
                seq += map(words_of[page.paths[page.blocks[k][0][0]]].__getitem__, words)
            self.sequences.append(np.array(seq, np.int64))
            self.spans.append(spans)
        self.size = number()
        if self.sequences:
            self.classes = nest([c for c in (in_order(*x) for x in self.vectors()) if c])

    def vectors(self) -> list[tuple[list[int], list[np.ndarray]]]:
        """Classes by equal vectors, best supported first: tokens, and per page their places (k x tokens)."""
        n, size = len(self.pages), self.size
        counts = [np.bincount(s, minlength=size) for s in self.sequences]
        support = sum((c > 0).astype(np.int64) for c in counts)
        common = np.flatnonzero((2 * support >= n) & (support >= MIN_PAGES))
        table = np.stack([c[common] for c in counts], axis=1)
        groups: dict[bytes, list[int]] = defaultdict(list)
        for k, row in enumerate(table):
            groups[row.tobytes()].append(k)
        groups = [g for g in groups.values() if len(g) >= MIN_TOKENS]
        groups.sort(key=lambda g: (-int((table[g[0]] > 0).sum()), -len(g), g[0]))
        of, rank = np.full(size, -1), np.zeros(size, np.int64)
        for c, g in enumerate(groups):
            of[common[g]], rank[common[g]] = c, np.arange(len(g))
        places: list[list[np.ndarray]] = [[] for _ in groups]
        for seq in self.sequences:
            at = np.flatnonzero(of[seq] >= 0)
            order = np.lexsort((at, rank[seq[at]], of[seq[at]]))
            at = at[order]
            edges = np.searchsorted(of[seq[at]], np.arange(len(groups) + 1))
            for c, g in enumerate(groups):
                places[c].append(at[edges[c] : edges[c + 1]].reshape(len(g), -1).T)
        return [(common[g].tolist(), p) for g, p in zip(groups, places)]

    def constant(self, i: int) -> set[int]:
        """Blocks of page i whose words all belong to one class."""
        if not self.classes:
            return set()
        of = np.full(self.size, -1)
        for c, found in enumerate(self.classes):
            of[found.tokens] = c
        mine, out = of[self.sequences[i]], set()
        for b, (s, e) in enumerate(self.spans[i]):
            if mine[s] >= 0 and (mine[s:e] == mine[s]).all():
                out.add(b)
        return out

    def once(self) -> set[str]:
        """Paths of template elements that stand once in each page that has them."""
        name = {k: t for t, k in self.tags.items()}
        return {name[t][1:] for c in self.classes if all(len(p) <= 1 for p in c.places) for t in c.tokens if name.get(t, "")[:1] == "<"}


def in_order(members: list[int], places: list[np.ndarray]) -> Class | None:
    """The class with its tokens in the order they have in all occurrences, without those out of order; None if too few are left."""
    rows = np.concatenate(places)
    keep = np.arange(len(members))
    while len(keep) >= MIN_TOKENS:
        ranks = rows[:, keep].argsort(axis=1).argsort(axis=1)
        spread = ranks.max(axis=0) - ranks.min(axis=0)
        if not spread.any():
            break
        keep = np.delete(keep, len(keep) - 1 - int(spread[::-1].argmax()))
    if len(keep) < MIN_TOKENS:
        return None
    keep = keep[rows[0, keep].argsort()]
    places = [p[:, keep] for p in places]
    for p in places:  # an occurrence ends before the next begins
        if len(p) > 1 and not (p[:-1, -1] < p[1:, 0]).all():
            return None
    return Class([members[k] for k in keep], places)


def within_gaps(inner: np.ndarray, outer: np.ndarray) -> bool:
    """Whether no token of ``outer`` stands between tokens of one occurrence of ``inner``."""
    at = outer.reshape(-1)
    return not len(inner) or bool((np.searchsorted(at, inner[:, 0]) == np.searchsorted(at, inner[:, -1])).all())


def nest(classes: list[Class]) -> list[Class]:
    """Classes, best first, that nest with each one kept before."""
    kept: list[Class] = []
    for c in classes:
        if all(within_gaps(p, q) or within_gaps(q, p) for k in kept for p, q in zip(c.places, k.places)):
            kept.append(c)
    return kept


def article_path(pages: list[Page], constant: list[set[int]], once: set[str]) -> str | None:
    """The element (by path, of ``once``) that holds the text that varies."""
    inside: Counter = Counter()
    heads: Counter = Counter()
    named: set[str] = set()
    for page, same in zip(pages, constant):
        named.update(p for p, role, out in zip(page.paths, page.roles, page.out) if role == "main" and not out)
        mine: Counter = Counter()
        for b, block in enumerate(page.blocks):
            if b in same:
                continue
            e = block[0][0]
            n = sum(len(x.strip()) for k, x in block if not page.out[k] and not page.links[k])
            if n:
                mine[page.paths[e]] += n
                if any(page.names[k] in HEADINGS for k, _ in block):
                    heads[page.paths[e]] += n
        inside.update(mine)
    if not inside:
        return None

    def total(of: Counter, path: str) -> int:
        return sum(n for p, n in of.items() if (p + "/").startswith(path + "/"))

    here, parts = "#", {p: total(inside, p) for p in once}
    now = sum(inside.values())
    while True:
        deeper = [p for p, n in parts.items() if p.startswith(here + "/") and 2 * n >= now and n]
        if not deeper:
            return here
        nxt = min(deeper, key=lambda p: (-parts[p], len(p), p))
        if here in named:
            return here
        lost, headless = now - parts[nxt], total(heads, here) > total(heads, nxt)
        if lost * 5 > now or headless:
            ahead = [p for p in deeper if p in named]
            if not ahead:
                return here
            nxt = min(ahead, key=lambda p: (len(p), p))
        here, now = nxt, parts[nxt]


def around(pages: list[Page], path: str | None) -> tuple[set[str], set[str]]:
    """Paths of blocks that stand before the template's article on some page that has it, and those that only follow it."""
    before, after = set(), set()
    for page in pages:
        if path in page.paths:
            tags = page.tags()
            at = tags.index(path) if path in tags else len(tags)
            before.update(tags[:at])
            after.update(t for t in tags[at + 1 :] if not t.startswith(path + "/"))
    return before, after - before


def alone(page: Page) -> str | None:
    """The article's path by this page's own structure."""
    seen = Counter(page.tags())
    return article_path([page], [set()], {p for p, n in seen.items() if n == 1})


def extract_group(htmls: list[str]) -> list[str]:
    """Main texts of pages that share a host."""
    distinct = list(dict.fromkeys(htmls))
    pages = [Page(h) for h in distinct]
    template = Template(pages)
    constant = [template.constant(i) for i in range(len(pages))]
    path = article_path(pages, constant, template.once()) if template.classes else None
    before, after = around(pages, path)
    out = {}
    for html, page, same in zip(distinct, pages, constant):
        own = path
        if own is None or own != "#" and own not in page.paths:
            own = alone(page)
            here = set(page.tags())
            if page.cut and path is not None and here <= before and not here & after and "main" not in page.roles:
                own = None  # cut before its article began
        text = page.text(own, same) if own is not None else ""
        out[html] = text or (page.text(own, set()) if own is not None and same else "")
    return [out[h] for h in htmls]


SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def dealt(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, part, page_id, url, html: each (host, part) is a group of bounded size, by hash of the page."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    mark = F.xxhash64("page_id", "url")
    size = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_PAGES), F.ceil(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))) / GROUP_BYTES))
    large = pages.groupBy(host.alias("of")).agg(size.cast("bigint").alias("parts")).where("parts > 1")
    # A table's size is known, so Spark broadcasts it only under its threshold; beyond that, salts make a hot host many tasks.
    large = scratch.write(large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "large_hosts")
    rows = pages.select("page_id", "url", "html", host.alias("host"), mark.alias("mark"), F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int").alias("own"))
    rows = rows.join(large, (rows["host"] == large["of"]) & (rows["own"] == large["salt"]), "left")
    return rows.select("host", F.pmod("mark", F.coalesce("parts", F.lit(1))).alias("part"), "page_id", "url", "html", F.xxhash64("host", F.pmod("mark", F.coalesce("parts", F.lit(1)))).alias("group"), "mark")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "group"):
            texts = extract_group([h or "" for h in group["html"].to_pylist()])
            cols = [group["page_id"].combine_chunks().cast(pa.int64()), group["url"].combine_chunks(), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    rows = dealt(pages.select("page_id", "url", "html"), Scratch(pages.sparkSession, "html"))
    return rows.repartition("group").sortWithinPartitions("group", "mark").select("page_id", "url", "html", "group").mapInArrow(run, SCHEMA)
